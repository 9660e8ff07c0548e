"""The CTV addendum's extensions and the CTV ad portfolio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlint_spark.functions.values import is_data_uri, data_uri_is_html, is_percent, is_registry, is_mime, is_uri_like, is_whole, is_xs_boolean, simid_url_insecure, trimmed
from adlint_spark.operators.rules.spec import INLINE, TEXT, V, VISITED, WRAPPER, Rule, any_grand, any_kid, at, attr, fact, has, inside, is_v4, lacks, leaf, rule, told

ADDENDUM, PORTFOLIO, XSD, SIMID = "IAB CTV Addendum 2024", "IAB CTV Ad Portfolio", "VAST XSD", "IAB SIMID"
JULY = "IAB CTV Addendum 2024 (July 2024)"


def _paid(kind: str) -> Column:
    """The payload itself, of a standardised extension of that type in its place and shape."""
    return F.expr(f"paid and payload = '{kind}' and name = '{kind}' and (left(trail, length(trail) - length(name) - 1) like '%Extension' or native is not null)")


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _extra(allowed: list[str]) -> Column:
    own = F.coalesce("bare_attrs", F.map_keys("attr"))
    return F.transform(F.array_except(own, F.expr("array(" + ", ".join(f"'{a}'" for a in allowed) + ")")), lambda a: F.concat(F.lit("[@"), a, F.lit("]")))


def _attributes(name: str, here: Column, allowed: list[str], legacy: str | None) -> list[Rule]:
    """Unknown attributes of a payload; in a legacy extension one more names what it is bound to."""
    old = inside("Extension")
    told = ("VAST-2.0-unknown-attribute", "W", XSD, "an unknown attribute", name)
    sides = [(here & old, [*allowed, legacy]), (here & ~old, allowed)] if legacy else [(here, allowed)]
    return [rule(*told, side & (F.size(_extra(some)) > 0), "IAB VAST 2.0 §2", each=_extra(some)) for side, some in sides]


def _text_only(payload: str) -> list[Rule]:
    """Children of a payload that holds text."""
    below = F.expr(f"paid and payload = '{payload}' and left(trail, length(trail) - length(name) - 1) like '%Extension/{payload}'")
    return [rule("VAST-2.0-text-only-element", "E", XSD, "an element that holds text has children", "", below, "IAB VAST 2.0 §2", mode="up", each=F.array(F.concat(F.lit("/"), F.col("name"))), gate="payload is not null")]


def ctv_addendum() -> list[Rule]:
    extension = VISITED & fact("#ctv").isNotNull()
    uid, mez, icf, icon = (_paid(k) for k in ("UniversalAdId", "Mezzanine", "InteractiveCreativeFile", "Icon"))
    bound, several = fact("#bind"), fact("#creatives").cast("int") > 1
    text = TEXT
    registry = attr("idRegistry")
    unknown = text == "unknown"
    no_registry = registry.isNull() | ((trimmed(registry) == "") & ~unknown)
    low, high = attr("minBitrate"), attr("maxBitrate")
    html = has("HTMLResource")
    data = F.coalesce(is_data_uri(text), F.lit(False))
    payloads = any_kid(lambda k: k["name"] == "HTMLResource")
    count = lambda kid: F.expr(f"length(kid_names) - length(replace(kid_names, '/{kid}/', ''))") / (len(kid) + 2)
    no_data = data & (F.expr("trim(substring(text, instr(text, ',') + 1)) = ''") | (F.instr(TEXT, ",") == 0))
    bad_html = any_kid(lambda k: (k["name"] == "HTMLResource") & ((k["text"] == "") | ~k["has_cdata"]))
    wrong_payload = no_data | (F.expr("replace(replace(kid_names, '/HTMLResource/', ''), '/AdParameters/', '') <> ''")) | (count("HTMLResource") > 1) | (count("AdParameters") > 1) | (html & (text != "")) | (payloads & bad_html)
    inner = lambda name: F.expr(f"paid and payload = 'InteractiveCreativeFile' and left(trail, length(trail) - length(name) - 1) like '%Extension/InteractiveCreativeFile' and name = '{name}'")
    names = lambda *xs: " ".join(xs)
    bindable = names("UniversalAdId", "Mezzanine", "InteractiveCreativeFile")
    any_paid = uid | mez | icf
    below = F.array(F.concat(F.lit("/"), F.col("name")))
    media = ["id", "delivery", "type", "width", "height", "codec", "fileSize", "mediaType"]
    return [
        rule("VAST-2.0-ctv-extension-location", "W", ADDENDUM, "this extension has no place here in this version", "Extension CreativeExtension", extension & ~F.col("fits"), JULY),
        rule("VAST-2.0-ctv-extension-payload", "E", ADDENDUM, "the extension does not hold just the element of its type", "Extension CreativeExtension", extension & F.col("fits") & ~told("#shaped"), JULY),
        # identifiers
        rule("VAST-2.0-ctv-universaladid-registry", "E", ADDENDUM, "idRegistry is missing", "UniversalAdId", uid & no_registry, JULY),
        rule("VAST-2.0-ctv-universaladid-registry-format", "W", ADDENDUM, "idRegistry is no registry", "UniversalAdId", uid & ~no_registry & ~(unknown & (trimmed(registry) == "")) & ~is_registry(registry), JULY),
        rule("VAST-2.0-ctv-universaladid-content", "E", ADDENDUM, "UniversalAdId has no content", "UniversalAdId", uid & (text == ""), JULY),
        *_text_only("UniversalAdId"),
        *_attributes("UniversalAdId", uid, ["idRegistry"], "creativeId"),
        # mezzanines
        *(rule("VAST-2.0-ctv-mezzanine-values", "E", ADDENDUM, f"{a} has a wrong value", "Mezzanine", mez & ~(is_mime(attr(a)) if a == "type" else is_whole(attr(a))), JULY, suffix=f"[@{a}]") for a in ("width", "height", "type")),
        *_text_only("Mezzanine"),
        *_attributes("Mezzanine", mez, media, "mediaFileId"),
        rule("VAST-2.0-mediafile-delivery-enum", "E", XSD, "delivery is neither progressive nor streaming", "Mezzanine", mez & ~attr("delivery").isin("progressive", "streaming"), suffix="[@delivery]", spec="IAB VAST 2.0 §2.3.5.2"),
        rule("VAST-3.0-minmaxbitrate-pair", "E", "VAST spec", "one of minBitrate and maxBitrate is missing", "Mezzanine", mez & (low.isNull() != high.isNull()), spec="IAB VAST 3.0 §2.3.5.2"),
        rule("VAST-3.0-bitrate-conflict", "W", "VAST spec", "bitrate stands beside minBitrate or maxBitrate", "Mezzanine", mez & ~lacks("bitrate") & (low.isNotNull() | high.isNotNull()), spec="IAB VAST 3.0 §2.3.5.2"),
        rule("VAST-2.0-url-empty", "E", "revenue impact", "a URL is empty", "Mezzanine", mez & (TEXT == ""), located="none", spec="IAB VAST 2.0 §2"),
        rule("VAST-2.0-url-invalid", "W", "RFC 3986", "a URL is not an absolute URL", "Mezzanine", mez & (TEXT != "") & ~is_uri_like(TEXT), located="none", spec="IAB VAST 2.0 §2"),
        # interactive files
        rule("VAST-2.0-ctv-interactive-api", "E", ADDENDUM, "the apiFramework is not SIMID", "InteractiveCreativeFile", icf & _no(attr("apiFramework") == "SIMID"), JULY),
        rule("SIMID-1.0-simid-type-required", "E", SIMID, "a SIMID file has no type text/html", "InteractiveCreativeFile", icf & _no(attr("type") == "text/html"), JULY),
        rule("VAST-2.0-ctv-interactive-duration", "E", ADDENDUM, "variableDuration is no boolean", "InteractiveCreativeFile", icf & ~attr("variableDuration").isin("true", "false", "1", "0"), JULY),
        rule("VAST-2.0-ctv-interactive-payload", "E", ADDENDUM, "the file is neither a URL nor one HTMLResource", "InteractiveCreativeFile", icf & wrong_payload, JULY),
        *_attributes("InteractiveCreativeFile", icf, ["type", "apiFramework", "variableDuration"], "mediaFileId"),
        rule("VAST-2.0-unknown-attribute", "W", XSD, "an unknown attribute", "HTMLResource", inner("HTMLResource") & (F.size(F.coalesce("bare_attrs", F.map_keys("attr"))) > 0), "IAB VAST 2.0 §2", each=F.transform(F.coalesce("bare_attrs", F.map_keys("attr")), lambda a: F.concat(F.lit("[@"), a, F.lit("]")))),
        rule("VAST-2.0-unknown-attribute", "W", XSD, "an unknown attribute", "AdParameters", inner("AdParameters") & (F.size(_extra(["xmlEncoded"])) > 0), "IAB VAST 2.0 §2", each=_extra(["xmlEncoded"])),
        rule("VAST-3.0-adparameters-xmlencoded-value", "W", XSD, "xmlEncoded is not a boolean", "AdParameters", inner("AdParameters") & ~is_xs_boolean(attr("xmlEncoded")), suffix="[@xmlEncoded]", spec="IAB VAST 3.0 §2.3.5.3"),
        rule("VAST-2.0-text-only-element", "E", XSD, "an element that holds text has children", "", F.expr("paid and payload = 'InteractiveCreativeFile' and left(trail, length(trail) - length(name) - 1) rlike 'Extension/InteractiveCreativeFile/(HTMLResource|AdParameters)$'"), "IAB VAST 2.0 §2", mode="up", each=below, gate="payload is not null"),
        rule("SIMID-1.0-simid-url-empty", "E", SIMID, "a SIMID file has no URL", "InteractiveCreativeFile", icf & ~html & (text == ""), "IAB SIMID 1.0 §3.1"),
        rule("SIMID-1.0-simid-url-data-html", "E", SIMID, "a SIMID data URL is not HTML", "InteractiveCreativeFile", icf & ~html & data & ~data_uri_is_html(text), "IAB SIMID 1.0 §3.1"),
        rule("SIMID-1.0-simid-url-https", "E", SIMID, "a SIMID URL is not secure", "InteractiveCreativeFile", icf & ~html & (text != "") & ~data & simid_url_insecure(text), "IAB SIMID 1.0 §3.1"),
        rule("VAST-2.0-url-invalid", "W", "RFC 3986", "a URL is not an absolute URL", "InteractiveCreativeFile", icf & ~html & text.startswith("https://") & ~is_uri_like(TEXT), located="none", spec="IAB VAST 2.0 §2"),
        rule("SIMID-1.0-simid-mediafile-required", "E", SIMID, "the extension is bound to no playable MediaFile", "InteractiveCreativeFile", icf & bound.isin("local", "matched", "first") & ~told("#playable"), "IAB SIMID 1.0 §3.4"),
        # icons, of extensions and others
        rule("VAST-2.0-ctv-icon-regs", "E", ADDENDUM, "regs is neither 0 nor 1", "Icon", (icon | (VISITED & (~inside("NonLinearAds") | F.coalesce(is_v4(), F.lit(False))))) & ~attr("regs").isin("0", "1"), JULY),
        # bindings
        rule("VAST-2.0-ctv-binding-unmatched", "E", ADDENDUM, "the extension's id fits not just one element of the ad", bindable, any_paid & (bound == "unmatched"), JULY),
        rule("VAST-2.0-ctv-binding-implicit", "I", ADDENDUM, "the extension names none of several creatives", bindable, any_paid & (bound == "first") & several, JULY),
    ]


def ctv_portfolio() -> list[Rule]:
    known = V.isNotNull()
    v4 = F.coalesce(is_v4(), F.lit(False))
    creative = [f"{c}/Creatives/Creative" for c in (INLINE, WRAPPER)]
    nonlinear = at(*(f"{c}/NonLinearAds/NonLinear" for c in creative)) & v4
    files = at(*(f"{c}/NonLinearAds/NonLinear/MediaFiles" for c in creative)) & v4
    frames = F.expr(f"vast and main and trail in ({', '.join(repr(f'{c}/NonLinearAds/NonLinear/IFrameResource') for c in creative)})") & v4
    blocks = [f"{c}/Extensions/Extension" for c in (INLINE, WRAPPER)]
    extension = at(*blocks) & known
    portfolio, adcom = extension & told("#portfolio"), extension & told("#adcom") & v4
    signals = F.expr("vast and main and trail in (" + ", ".join(f"'{b}/{s}'" for b in blocks for s in ("plcmt", "pos", "playbackmethod", "attr")) + ")") & known
    shape, number = fact("#signal"), F.expr("try_cast(trim(text) as bigint)")
    signal = signals & ((shape == "portfolio") | ((shape == "adcom") & v4))
    whole = TEXT.rlike(r"^[+-]?[0-9]+$") & number.isNotNull()
    plcmt = fact("#plcmt").cast("bigint")
    fits = F.when(plcmt.isin(5, 6), number.isin(7, 8)).when(plcmt == 7, number.isin(5, 9, 10, 14, 15)).when(plcmt == 8, number.isin(11, 12, 13, 16, 17))
    owner = F.when(number.isin(8, 9), 5).when(number.isin(10, 11), 6)
    contradicts = F.coalesce(owner != plcmt, F.lit(True)) & (owner.isNotNull() | plcmt.isin(5, 6))
    holds = fact("#files")
    own_files = at(*(f"{b}/MediaFiles" for b in blocks)) & known & fact("#holds").isNotNull()
    native = told("#native")
    several = fact("#creatives").cast("int") > 1
    qr = [f"{c}/CreativeExtensions/CreativeExtension" for c in creative] + [f"{b}/CreativeExtensions/CreativeExtension" for b in blocks]
    code = at(*qr) & known & (F.expr("trail not like '%/Extension/%'") | told("#in_portfolio"))
    place = at(*(f"{q}/QrCodePosition" for q in qr)) & known & (F.col("name_idx") == 0) & (F.expr("trail not like '%/Extension/%'") | told("#in_portfolio"))
    size = at(*(f"{q}/QrCodeSize" for q in qr)) & known & (F.col("name_idx") == 0) & (F.expr("trail not like '%/Extension/%'") | told("#in_portfolio"))
    geometry = has("QrCodePosition") | has("QrCodeSize")
    spec = "IAB CTV Ad Portfolio for VAST 2.0"
    delivery, table = "IAB CTV Ad Portfolio §Secure Interactive Ad Units", "IAB CTV Ad Portfolio §Format-to-Signal Reference Table"
    value = lambda name, level, text, wrong, spec: rule(f"VAST-4.4-adcom-{name}", level, PORTFOLIO, text, name.partition("-")[0], signal & whole & wrong, spec)
    video = any_grand("MediaFiles", lambda g: (g["name"] == "MediaFile") & F.lower(trimmed(g["attr"]["type"])).startswith("video/"))
    return [
        rule("VAST-4.4-version-attribute", "I", XSD, "VAST 4.4 is a draft", "VAST", F.expr("vast and depth = 0") & (V == 6), "IAB vast_4.4.xsd (draft annotation)", suffix="@version"),
        # nonlinear ads
        rule("VAST-4.4-nonlinear-no-renderable-asset", "W", PORTFOLIO, "an interactive file has no fallback", "MediaFiles", files & has("InteractiveCreativeFile") & ~has("MediaFile") & ~told("#classic"), f"{delivery} (Fallback Media)"),
        rule("VAST-4.4-nonlinear-mediafiles-empty", "E", PORTFOLIO, "MediaFiles has nothing to render", "MediaFiles", files & ~has("InteractiveCreativeFile") & ~has("MediaFile") & ~told("#classic"), "IAB CTV Ad Portfolio §Signaling the Five Non-Linear CTV Formats"),
        rule("VAST-4.4-nonlinear-simid-iframe", "I", PORTFOLIO, "a SIMID frame is the old form", "IFrameResource", frames & told("#media") & (F.upper(attr("apiFramework")) == "SIMID"), delivery),
        rule("VAST-4.4-nonlinear-video-no-duration", "W", PORTFOLIO, "a video has no Duration", "NonLinear", nonlinear & has("MediaFiles") & F.coalesce(video, F.lit(False)) & ~has("Duration"), "IAB CTV Ad Portfolio §Handling Duration"),
        # signals
        rule("VAST-4.4-adcom-extension-unknown-signal", "W", PORTFOLIO, "the type is no signal", "Extension", adcom & ~trimmed(attr("type")).isin("plcmt", "pos", "playbackmethod", "attr"), "IAB CTV Ad Portfolio §Purpose of VAST ext", suffix="@type"),
        rule("VAST-4.4-adcom-extension-type-mismatch", "W", PORTFOLIO, "the extension holds another signal than its type", "plcmt pos playbackmethod attr", signal & (shape == "adcom") & fact("#type").isin("plcmt", "pos", "playbackmethod", "attr") & (fact("#type") != F.col("name")), "IAB CTV Ad Portfolio §Purpose of VAST ext"),
        rule("VAST-4.4-adcom-signal-not-integer", "E", PORTFOLIO, "the signal is not a whole number", "plcmt pos playbackmethod attr", signal & ~whole, "IAB AdCOM 1.0 enumerated lists"),
        value("plcmt-value", "W", "plcmt is not between 1 and 9", ~number.between(1, 9), "IAB AdCOM List: Plcmt Subtypes - Video"),
        value("playbackmethod-value", "W", "playbackmethod is not between 1 and 11", ~number.between(1, 11), "IAB AdCOM List: Playback Methods"),
        value("pos-value", "W", "pos is not between 0 and 17", ~number.between(0, 17), "IAB AdCOM List: Placement Positions"),
        value("attr-not-motion", "I", "attr is not between 19 and 23", ~number.between(19, 23), "IAB CTV Ad Portfolio §Declaring Creative Experience with battr and attr"),
        value("pos-format-mismatch", "W", "pos does not fit plcmt", plcmt.between(1, 9) & number.between(1, 17) & ~fits, table),
        value("playbackmethod-format-mismatch", "W", "playbackmethod does not fit plcmt", plcmt.between(1, 9) & number.between(1, 11) & contradicts, table),
        # the container for 2.0
        rule("VAST-2.0-ctv-portfolio-creative-id-required", "E", PORTFOLIO, "the extension names none of several creatives", "Extension", portfolio & fact("#declared").isNull() & several, f"{spec} §Implementation", suffix="/CreativeId"),
        rule("VAST-2.0-ctv-portfolio-creative-id-unmatched", "E", PORTFOLIO, "CreativeId fits no creative", "CreativeId", at(*(f"{b}/CreativeId" for b in blocks)) & known & told("#unmatched"), f"{spec} §Implementation"),
        rule("VAST-2.0-ctv-portfolio-mediafiles-required", "E", PORTFOLIO, "the extension has no MediaFiles", "Extension", portfolio & holds.isNull() & ~native, f"{spec} §Media file delivery", suffix="/MediaFiles"),
        rule("VAST-2.0-ctv-portfolio-mediafiles-empty", "E", PORTFOLIO, "MediaFiles has nothing to render", "MediaFiles", own_files & ~fact("#holds").rlike("[mi]"), f"{spec} §Media file delivery"),
        rule("VAST-2.0-ctv-portfolio-no-renderable-asset", "W", PORTFOLIO, "an interactive file has no fallback", "MediaFiles", own_files & fact("#holds").contains("i") & ~fact("#holds").contains("m") & ~native, f"{spec} §SIMID interactive creative delivery"),
        rule("VAST-2.0-ctv-portfolio-no-duration", "W", PORTFOLIO, "a timed asset has no Duration", "Extension", portfolio & holds.rlike("[iv]") & ~has("Duration"), f"{spec} §Duration and tracking"),
        # QR codes
        *(rule("VAST-4.4-qrcode-position-attrs", "E", XSD, f"QrCodePosition has no {a}", "QrCodePosition", place & lacks(a), "IAB vast_4.4.xsd vastQrCodePosition_type", suffix=f"@{a}") for a in ("xPosition", "yPosition")),
        *(rule("VAST-4.4-qrcode-position-percent", "E", XSD, f"{a} is not a percentage", "QrCodePosition", place & ~is_percent(attr(a)), "IAB vast_4.4.xsd vastPercent_type", suffix=f"@{a}") for a in ("xPosition", "yPosition")),
        rule("VAST-4.4-qrcode-size-attr", "E", XSD, "QrCodeSize has no size", "QrCodeSize", size & lacks("size"), "IAB vast_4.4.xsd vastQrCodeSize_type"),
        rule("VAST-4.4-qrcode-size-percent", "E", XSD, "size is not a percentage", "QrCodeSize", size & ~is_percent(attr("size")), "IAB vast_4.4.xsd vastPercent_type", suffix="@size"),
        rule("VAST-4.4-qrcode-missing-scan-url", "W", PORTFOLIO, "a QR code has no QrCodeScanUrl", "CreativeExtension", code & geometry & ~has("QrCodeScanUrl"), "IAB CTV Ad Portfolio §QR Code Signaling"),
        rule("VAST-4.4-qrcode-missing-image-url", "W", PORTFOLIO, "a QR code has no QrCodeImageUrl", "CreativeExtension", code & geometry & ~has("QrCodeImageUrl"), "IAB CTV Ad Portfolio §QR Code Signaling"),
    ]


FAMILIES = {f.__name__: f for f in (ctv_addendum, ctv_portfolio)}
