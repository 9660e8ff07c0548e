"""Value formats, URL security, macros and SIMID."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlint_spark.functions.values import (
    MACROS,
    among,
    data_uri_is_html,
    has_illegal_uri_char,
    is_data_uri,
    is_hhmmss,
    is_simid,
    is_simid_near_miss,
    is_time_or_percent,
    is_uri_like,
    is_xs_boolean,
    is_xs_integer,
    is_zero_duration,
    macro_tokens,
    simid_url_insecure,
    taxonomy_host,
    trimmed,
    valid_tracking_event,
)
from adlint_spark.operators.detect import MACRO_ELEMENTS, URL_ELEMENTS
from adlint_spark.operators.rules.spec import INLINE, TEXT, V, VAST, VISITED, WRAPPER, Rule, any_grand, at, attr, fact, has, inside, is_v4, lacks, leaf, on, rule

SPEC, XSD, BEST, SIMID = "VAST spec", "VAST XSD", "revenue impact", "IAB SIMID"
LINEAR = f"{INLINE}/Creatives/Creative/Linear"


def _v4_inside(name: str):
    return ~inside(name) | F.coalesce(is_v4(), F.lit(False))


def xs_types() -> list[Rule]:
    wrapper = VAST & (F.col("trail") == WRAPPER)
    return [
        *(rule("VAST-4.0-wrapper-bool-attr", "W", XSD, f"{a} is not a boolean", "Wrapper", wrapper & ~is_xs_boolean(attr(a)), mode="schema", suffix=f"[@{a}]", spec="IAB VAST 4.2 XSD") for a in ("followAdditionalWrappers", "allowMultipleAds", "fallbackOnNoAd")),
        rule("VAST-4.1-expires-integer", "W", XSD, "Expires is not an integer", "Expires", VISITED & ~is_xs_integer(TEXT), spec="IAB VAST 4.2 XSD"),
    ]


def taxonomy_authority() -> list[Rule]:
    out = []
    for name, trails, least in (("category", (f"{INLINE}/Category", f"{WRAPPER}/Category"), 2), ("blockedadcategories", (f"{WRAPPER}/BlockedAdCategories",), 3)):
        here = VAST & on(*trails) & (V >= least) & ~lacks("authority")
        host = taxonomy_host(attr("authority"))
        known = host.isin("iabtechlab.com", "iab.com") | host.endswith(".iabtechlab.com")
        element, version = ("Category", "4.0") if least == 2 else ("BlockedAdCategories", "4.1")
        out += [
            rule(f"VAST-{version}-{name}-authority-not-uri", "W", "RFC 3986", "the authority has no well-formed host", element, here & host.isNull(), mode="last", suffix="[@authority]", spec="IAB VAST 4.0 §2.3.3" if least == 2 else "IAB VAST 4.1 §2.3.2"),
            rule(f"VAST-{version}-{name}-authority-unknown", "I", "inferred", "the authority is not a known one", element, here & ~known, mode="last", suffix="[@authority]", spec="IAB Tech Lab Content Taxonomy"),
        ]
    return out


def formats() -> list[Rule]:
    media = VISITED & _v4_inside("NonLinear")
    duration = VISITED & _v4_inside("NonLinear") & (TEXT != "")
    tracking = VISITED & ~inside("Verification")
    event = attr("event")
    wrong = event.isNotNull() & ~valid_tracking_event(event, V)
    removed = (V >= 2) & event.isin("fullscreen", "exitFullscreen")
    linear = at(LINEAR, f"{WRAPPER}/Creatives/Creative/Linear")
    low, high = attr("minBitrate"), attr("maxBitrate")
    return [
        rule("VAST-2.0-duration-format", "E", SPEC, "Duration is not HH:MM:SS", "Duration", duration & ~is_hhmmss(TEXT), spec="IAB VAST 2.0 §2.3.5.1"),
        rule("VAST-2.0-duration-zero", "W", BEST, "Duration is zero", "Duration", duration & is_hhmmss(TEXT) & is_zero_duration(TEXT), spec="IAB VAST 2.0 §2.3.5.1"),
        rule("VAST-2.0-mediafile-delivery-enum", "E", XSD, "delivery is neither progressive nor streaming", "MediaFile", media & ~attr("delivery").isin("progressive", "streaming"), suffix="[@delivery]", spec="IAB VAST 2.0 §2.3.5.2"),
        rule("VAST-3.0-minmaxbitrate-pair", "E", SPEC, "one of minBitrate and maxBitrate is missing", "MediaFile", media & (low.isNull() != high.isNull()), spec="IAB VAST 3.0 §2.3.5.2"),
        rule("VAST-3.0-bitrate-conflict", "W", SPEC, "bitrate stands beside minBitrate or maxBitrate", "MediaFile", media & ~lacks("bitrate") & (low.isNotNull() | high.isNotNull()), spec="IAB VAST 3.0 §2.3.5.2"),
        rule("VAST-3.0-skipoffset-format", "W", SPEC, "skipoffset is neither a time nor a percentage", "Linear", linear & ~is_time_or_percent(attr("skipoffset")), suffix="[@skipoffset]", spec="IAB VAST 3.0 §2.3.6"),
        rule("VAST-3.0-skip-event-no-skipoffset", "W", SPEC, "a skip event, and no skipoffset", "Linear", linear & lacks("skipoffset") & any_grand("TrackingEvents", lambda g: (g["name"] == "Tracking") & (g["attr"]["event"] == "skip")), suffix="/TrackingEvents", spec="IAB VAST 3.0 §2.3.6"),
        rule("VAST-3.0-progress-offset-format", "W", SPEC, "offset is neither a time nor a percentage", "Tracking", tracking & (event == "progress") & ~is_time_or_percent(attr("offset")), suffix="[@offset]", spec="IAB VAST 3.0 §2.3.6"),
        rule("VAST-4.0-tracking-event-removed", "W", SPEC, "the event is no longer in use", "Tracking", tracking & wrong & removed, suffix="[@event]", spec="IAB VAST 4.0 §2.3.6"),
        rule("VAST-4.1-tracking-event-value", "E", XSD, "the event is not in this version's list", "Tracking", tracking & wrong & ~F.coalesce(removed, F.lit(False)), each=F.array(F.concat(F.lit('[@event="'), event, F.lit('"]'))), spec="IAB VAST 4.2 §2.3.6"),
        rule("VAST-4.1-adtype-value", "W", XSD, "adType is unknown", "Ad", VAST & (F.col("trail") == "VAST/Ad") & (V >= 3) & ~attr("adType").isin("video", "audio", "hybrid"), suffix="[@adType]", spec="IAB VAST 4.1 §2.2.1"),
        rule("VAST-4.1-companion-renderingmode-value", "W", XSD, "renderingMode is unknown", "Companion", VISITED & (V >= 3) & ~attr("renderingMode").isin("default", "end-card", "concurrent"), suffix="[@renderingMode]", spec="IAB VAST 4.1 §2.3.8"),
        rule("VAST-3.0-companion-required-attr", "W", XSD, "required is unknown", "CompanionAds", VISITED & ~attr("required").isin("all", "any", "none"), suffix="[@required]", spec="IAB VAST 3.0 §2.3.8"),
        rule("VAST-3.0-adparameters-xmlencoded-value", "W", XSD, "xmlEncoded is not a boolean", "AdParameters", VISITED & ~is_xs_boolean(attr("xmlEncoded")), suffix="[@xmlEncoded]", spec="IAB VAST 3.0 §2.3.5.3"),
    ]


def security() -> list[Rule]:
    here = VAST & (inside("InLine") | inside("Wrapper") | F.col("name").isin("InLine", "Wrapper"))
    tag = at(f"{WRAPPER}/VASTAdTagURI")
    plain = leaf() & (TEXT != "") & ~F.col("has_cdata") & TEXT.contains(":")  # most leaves have no URL, which is told without a pattern
    names = " ".join([*URL_ELEMENTS, "MediaFile", "Tracking"])
    others = " ".join([*URL_ELEMENTS, "Tracking"])
    checks = [(here, "pos", names, others), (tag, "sem", "VASTAdTagURI", "VASTAdTagURI")]  # an ad tag is checked a second time
    return [
        rule("VAST-2.0-mediafile-https", "W", BEST, "a MediaFile URL is not secure", "MediaFile", here & TEXT.startswith("http://"), mode="pos", spec="IAB VAST 2.0 §2.3.5.2"),
        rule("VAST-2.0-url-cdata", "W", SPEC, "a URL is not in a CDATA section", "", here & plain & is_uri_like(TEXT), mode="pos", spec="IAB VAST 2.0 §2"),
        *(r for on, mode, some, unsafe in checks for r in (
            rule("VAST-2.0-tracking-https", "W", BEST, "a tracking URL is not secure", unsafe, on & TEXT.startswith("http://"), mode=mode, spec="IAB VAST 2.0 §2"),
            rule("VAST-2.0-url-empty", "E", SPEC, "a URL is empty", some, on & (TEXT == ""), mode=mode, located="none", spec="IAB VAST 2.0 §2"),
            rule("VAST-2.0-url-invalid", "W", "RFC 3986", "a URL is not an absolute URL", some, on & (TEXT != "") & ~is_uri_like(TEXT), mode=mode, located="none", spec="IAB VAST 2.0 §2"),
        )),
    ]


def macros() -> list[Rule]:
    here = VAST & (inside("InLine") | inside("Wrapper") | (F.col("trail") == "VAST/Error"))
    tokens = macro_tokens(TEXT)
    known = lambda t: among(F.upper(t), MACROS)
    names, can = " ".join(MACRO_ELEMENTS), TEXT.contains("[")
    wrong_place = F.exists(tokens, lambda t: ((F.upper(t) == "ERRORCODE") & (F.col("name") != "Error")) | ((F.upper(t) == "REASON") & ~((F.col("name") == "Tracking") & F.coalesce(attr("event") == "verificationNotExecuted", F.lit(False)))))
    return [
        rule("VAST-2.0-macro-unknown", "W", SPEC, "an unknown macro", names, here & can & F.exists(tokens, lambda t: ~known(t)), mode="pos", spec="IAB VAST 4.2 §6"),
        rule("VAST-2.0-macro-lowercase", "W", SPEC, "a macro is not in upper case", names, here & can & F.exists(tokens, lambda t: known(t) & (t != F.upper(t))), mode="pos", spec="IAB VAST 4.2 §6"),
        rule("VAST-4.1-macro-deprecated", "I", SPEC, "a macro is out of use", names, here & can & (V >= 3) & F.exists(tokens, lambda t: F.upper(t).isin("CONTENTPLAYHEAD", "MEDIAPLAYHEAD")), mode="pos", spec="IAB VAST 4.1 §6"),
        rule("VAST-2.0-macro-wrong-context", "I", SPEC, "a macro stands where it has no value", names, here & can & wrong_place, mode="pos", spec="IAB VAST 4.2 §6"),
        rule("VAST-2.0-macro-uri-unencoded", "W", "RFC 3986", "a URL with macros has characters that must be encoded", names, here & can & (F.size(tokens) > 0) & has_illegal_uri_char(TEXT), mode="pos", spec="RFC 3986 §2.1"),
    ]


def simid() -> list[Rule]:
    api, own = attr("apiFramework"), fact("apiFramework")
    creative = f"{INLINE}/Creatives/Creative"
    holders = [f"{c}/NonLinearAds/NonLinear" for c in (creative, f"{WRAPPER}/Creatives/Creative")]
    file = at(f"{LINEAR}/MediaFiles/InteractiveCreativeFile", *(f"{h}/MediaFiles/InteractiveCreativeFile" for h in holders)) & is_simid(api)
    # a frame counts if its NonLinear is meant for SIMID, or else if it is itself
    frame = VAST & F.col("main") & on(*(f"{h}/IFrameResource" for h in holders)) & (F.coalesce(is_simid(own), F.lit(False)) | is_simid(api))
    nonlinear, linear = at(*holders) & is_simid(api), at(LINEAR)
    meant = lambda g: (g["name"] == "InteractiveCreativeFile") & is_simid(g["attr"]["apiFramework"])
    has_simid = any_grand("MediaFiles", meant)
    playable = any_grand("MediaFiles", lambda g: (g["name"] == "MediaFile") & (g["attr"]["type"].rlike("^(video|audio)/") | (g["attr"]["type"] == "application/x-mpegURL")))
    progressive = any_grand("MediaFiles", lambda g: (g["name"] == "MediaFile") & (g["attr"]["delivery"] == "progressive"))
    started = any_grand("TrackingEvents", lambda g: (g["name"] == "Tracking") & (g["attr"]["event"] == "interactiveStart"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    url = TEXT
    data, html = F.coalesce(is_data_uri(url), F.lit(False)), no(attr("type") == "text/html")
    v10, v11 = "IAB SIMID 1.0 §5", "IAB SIMID 1.1 §3.5.1"
    return [
        rule("SIMID-1.0-simid-type-required", "E", SIMID, "a SIMID file has no type text/html", "InteractiveCreativeFile", file & html, v10),
        rule("SIMID-1.0-simid-url-empty", "E", SIMID, "a SIMID file has no URL", "InteractiveCreativeFile", file & (url == ""), "IAB SIMID 1.0 §3.1"),
        rule("SIMID-1.0-simid-url-https", "E", SIMID, "a SIMID URL is not secure", "InteractiveCreativeFile", file & (url != "") & ~data & simid_url_insecure(url), "IAB SIMID 1.0 §3.1"),
        rule("SIMID-1.0-simid-url-data-html", "E", SIMID, "a SIMID data URL is not HTML", "InteractiveCreativeFile", file & data & ~data_uri_is_html(url), "IAB SIMID 1.0 §3.1"),
        rule("SIMID-1.0-simid-url-data-html", "E", SIMID, "a SIMID data URL is not HTML", "IFrameResource", frame & data & ~data_uri_is_html(url), "IAB SIMID 1.0 §3.1", mode="last"),
        rule("SIMID-1.0-simid-apiframework-case", "W", SIMID, "the apiFramework is SIMID in upper case", "InteractiveCreativeFile", file & is_simid_near_miss(api), v10),
        rule("SIMID-1.0-simid-apiframework-case", "W", SIMID, "the apiFramework is SIMID in upper case", "NonLinear", nonlinear & is_simid_near_miss(api), v10),
        rule("SIMID-1.0-simid-apiframework-case", "W", SIMID, "the apiFramework is SIMID in upper case", "IFrameResource", frame & is_simid_near_miss(api), v10, mode="last"),
        rule("SIMID-1.0-simid-variable-duration-value", "W", SIMID, "variableDuration is not true", "InteractiveCreativeFile", file & (attr("variableDuration") != "true"), v10),
        rule("SIMID-1.0-simid-mediafile-required", "E", SIMID, "SIMID has no playable MediaFile", "Linear", linear & has_simid & no(playable), "IAB SIMID 1.0 §3.4"),
        rule("SIMID-1.0-simid-ssai-no-client", "I", BEST, "SIMID beside a Mezzanine has no progressive MediaFile", "Linear", linear & has_simid & any_grand("MediaFiles", lambda g: g["name"] == "Mezzanine") & no(progressive), "IAB VAST 4.1 §1.1.2"),
        rule("SIMID-1.0-simid-interactive-start", "I", SIMID, "SIMID has no interactiveStart event", "Linear", linear & has_simid & (V >= 4) & no(started), "IAB VAST 4.2 interactiveStart", suffix="/TrackingEvents"),
        rule("SIMID-1.1-nonlinear-simid-no-iframe", "E", SIMID, "a SIMID NonLinear has no IFrameResource", "NonLinear", nonlinear & ~has("IFrameResource") & no(has_simid), v11),
        rule("SIMID-1.1-iframe-simid-type-required", "W", SIMID, "a SIMID frame has no type text/html", "IFrameResource", frame & html, v11, mode="last"),
        rule("SIMID-1.1-iframe-simid-url-empty", "E", SIMID, "a SIMID frame has no URL", "IFrameResource", frame & (url == ""), v11, mode="last"),
        rule("SIMID-1.1-iframe-simid-url-https", "E", SIMID, "a SIMID frame's URL is not secure", "IFrameResource", frame & (url != "") & ~data & simid_url_insecure(url), v11, mode="last"),
    ]


FAMILIES = {f.__name__: f for f in (xs_types, taxonomy_authority, formats, security, macros, simid)}
