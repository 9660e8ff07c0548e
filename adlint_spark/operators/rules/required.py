"""Required elements and attributes, structure, consistency, deprecation and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlint_spark.functions.values import among, VERSIONS, is_omid_vendor, is_vendor_key, trimmed
from adlint_spark.operators.rules.spec import INLINE, TEXT, V, VAST, VISITED, WRAPPER, Rule, any_kid, at, attr, by_level, fact, has, inside, is_v4, lacks, on, rule, told

SPEC, XSD, BEST, GUESS = "VAST spec", "VAST XSD", "revenue impact", "inferred"
LINEAR = f"{INLINE}/Creatives/Creative/Linear"


def root() -> list[Rule]:
    top = (F.col("depth") == 0) & F.col("parse_error").isNull() & (F.col("document_type") == "VAST")
    return [
        *by_level(rule("VAST-2.0-root-element", "E", SPEC, "the root element is not VAST", "", top & (F.col("root_name") != "VAST"), mode="root", spec="IAB VAST 2.0 §2"), "W", F.col("root_name") == "VideoAdServingTemplate"),
        rule("VAST-2.0-root-version", "E", SPEC, "VAST has no version", "VAST", top & VAST & lacks("version"), spec="IAB VAST 2.0 §2.1"),
        rule("VAST-2.0-root-version-value", "W", XSD, "the version is unknown", "VAST", top & VAST & ~attr("version").isin(*VERSIONS, "2.0.1"), suffix="[@version]", spec="IAB VAST 2.0 §2.1"),
        rule("VAST-4.0-wrapper-root-error", "W", SPEC, "Error stands beside Ad", "VAST", top & VAST & is_v4() & has("Ad") & has("Error"), spec="IAB VAST 4.0 §2.1"),
    ]


def ad_choice() -> list[Rule]:
    return [rule("VAST-2.0-ad-has-inline-or-wrapper", "E", SPEC, "an Ad holds one of InLine and Wrapper", "Ad", VAST & (F.col("trail") == "VAST/Ad") & (has("InLine") == has("Wrapper")), spec="IAB VAST 2.0 §2.2")]


def inline_required() -> list[Rule]:
    here = at(INLINE)
    return [
        rule("VAST-2.0-inline-adsystem", "E", SPEC, "InLine has no AdSystem", "InLine", here & ~has("AdSystem"), spec="IAB VAST 2.0 §2.3.1"),
        rule("VAST-2.0-inline-adtitle", "E", SPEC, "InLine has no AdTitle", "InLine", here & ~has("AdTitle"), spec="IAB VAST 2.0 §2.3.2"),
        rule("VAST-2.0-inline-impression", "E", SPEC, "InLine has no Impression", "InLine", here & ~has("Impression"), spec="IAB VAST 2.0 §2.3.4"),
        rule("VAST-2.0-inline-creatives", "E", SPEC, "InLine has no Creatives", "InLine", here & ~has("Creatives"), spec="IAB VAST 2.0 §2.3.5"),
        rule("VAST-2.0-inline-creatives", "E", SPEC, "Creatives has no Creative", "Creatives", at(f"{INLINE}/Creatives") & ~has("Creative"), located="up", spec="IAB VAST 2.0 §2.3.5"),
        rule("VAST-4.1-adservingid-present", "E", SPEC, "InLine has no AdServingId", "InLine", here & (V >= 3) & ~has("AdServingId"), spec="IAB VAST 4.1 §3.4.1"),
    ]


def wrapper_required() -> list[Rule]:
    here = at(WRAPPER)
    return [
        rule("VAST-2.0-wrapper-adsystem", "E", SPEC, "Wrapper has no AdSystem", "Wrapper", here & ~has("AdSystem"), spec="IAB VAST 2.0 §2.3.1"),
        rule("VAST-2.0-wrapper-impression", "E", SPEC, "Wrapper has no Impression", "Wrapper", here & ~has("Impression"), spec="IAB VAST 2.0 §2.3.4"),
        rule("VAST-2.0-wrapper-vastadtaguri", "E", SPEC, "Wrapper has no VASTAdTagURI", "Wrapper", here & ~has("VASTAdTagURI"), spec="IAB VAST 2.0 §2.4"),
    ]


def linear_required() -> list[Rule]:
    return [
        rule("VAST-2.0-linear-duration", "E", SPEC, "Linear has no Duration", "Linear", at(LINEAR) & ~has("Duration"), spec="IAB VAST 2.0 §2.3.5.1"),
        rule("VAST-2.0-linear-mediafiles", "E", SPEC, "Linear has no MediaFiles", "Linear", at(LINEAR) & ~has("MediaFiles"), spec="IAB VAST 2.0 §2.3.5.2"),
        rule("VAST-2.0-linear-mediafiles", "E", SPEC, "MediaFiles has no MediaFile", "MediaFiles", at(f"{LINEAR}/MediaFiles") & ~has("MediaFile"), located="up", spec="IAB VAST 2.0 §2.3.5.2"),
    ]


def media_attributes() -> list[Rule]:
    here = VISITED & (~inside("NonLinear") | F.coalesce(is_v4(), F.lit(False)))
    return [
        rule("VAST-2.0-mediafile-delivery", "E", SPEC, "MediaFile has no delivery", "MediaFile", here & lacks("delivery"), spec="IAB VAST 2.0 §2.3.5.2"),
        rule("VAST-2.0-mediafile-type", "E", SPEC, "MediaFile has no type", "MediaFile", here & lacks("type"), spec="IAB VAST 2.0 §2.3.5.2"),
        rule("VAST-2.0-mediafile-dimensions", "E", SPEC, "MediaFile has no width", "MediaFile", here & lacks("width"), spec="IAB VAST 2.0 §2.3.5.2"),
        rule("VAST-2.0-mediafile-dimensions", "E", SPEC, "MediaFile has no height", "MediaFile", here & lacks("height"), spec="IAB VAST 2.0 §2.3.5.2"),
    ]


def universal_ad_id() -> list[Rule]:
    creative, here = at(f"{INLINE}/Creatives/Creative"), at(f"{INLINE}/Creatives/Creative/UniversalAdId")
    empty = TEXT == ""
    return [
        rule("VAST-4.0-universaladid-present", "E", SPEC, "Creative has no UniversalAdId", "Creative", creative & is_v4() & ~has("UniversalAdId"), spec="IAB VAST 4.0 §3.8.1"),
        rule("VAST-4.0-universaladid-idregistry", "E", SPEC, "UniversalAdId has no idRegistry", "UniversalAdId", here & (F.col("name_idx") == 0) & lacks("idRegistry"), located="up", spec="IAB VAST 4.0 §3.8.1"),
        rule("VAST-4.0-universaladid-idvalue", "E", SPEC, "UniversalAdId has neither idValue nor content", "UniversalAdId", here & (V == 2) & lacks("idValue") & empty, spec="IAB VAST 4.0 §2.3.5.3"),
        rule("VAST-4.1-universaladid-idvalue-removed", "W", SPEC, "idValue is no longer in use", "UniversalAdId", here & (V >= 3) & ~lacks("idValue"), spec="IAB VAST 4.1 §2.3.5.3"),
        rule("VAST-4.1-universaladid-content", "E", SPEC, "UniversalAdId has no content", "UniversalAdId", here & (V >= 3) & lacks("idValue") & empty, spec="IAB VAST 4.1 §2.3.5.3"),
    ]


def resources() -> list[Rule]:
    creative = f"{INLINE}/Creatives/Creative"
    none = ~(has("StaticResource") | has("IFrameResource") | has("HTMLResource"))
    return [
        rule("VAST-2.0-companion-resource", "E", SPEC, "Companion has no resource", "Companion", at(f"{creative}/CompanionAds/Companion") & none, spec="IAB VAST 2.0 §2.3.7"),
        rule("VAST-2.0-nonlinear-resource", "E", SPEC, "NonLinear has no resource", "NonLinear", at(f"{creative}/NonLinearAds/NonLinear") & none & ~has("MediaFiles"), spec="IAB VAST 2.0 §2.3.6.1"),
        rule("VAST-4.0-companion-clicktracking-id", "E", SPEC, "CompanionClickTracking has no id", "CompanionClickTracking", VAST & on(f"{creative}/CompanionAds/Companion/CompanionClickTracking") & lacks("id"), mode="last", spec="IAB VAST 4.0 §2.3.8"),
    ]


def icons() -> list[Rule]:
    here = VISITED & (~inside("NonLinearAds") | F.coalesce(is_v4(), F.lit(False)))
    five = ("program", "width", "height", "xPosition", "yPosition")
    missing = F.lit(False)
    for a in five:
        missing = missing | lacks(a)
    fallback = VISITED & (V >= 4) & (lacks("width") | lacks("height"))
    return [
        *(rule(f"VAST-3.0-icon-{a.lower()}", "E", SPEC, f"Icon has no {a}", "Icon", here & lacks(a) & ~F.coalesce(is_v4(), F.lit(False)), spec="IAB VAST 3.0 §2.3.6.4") for a in five),
        *(rule(f"VAST-3.0-icon-{a.lower()}", "W", SPEC, f"Icon has no {a}", "Icon", here & lacks(a) & is_v4(), spec="IAB VAST 4.3 §3.11.1", default="E") for a in five),
        rule("VAST-3.0-icon-resource", "E", SPEC, "Icon has no resource", "Icon", here & ~(has("StaticResource") | has("IFrameResource") | has("HTMLResource")), spec="IAB VAST 3.0 §2.3.6.4"),
        rule("VAST-3.0-icon-attrs", "W", SPEC, "Icon lacks attributes", "Icon", here & missing, spec="IAB VAST 3.0 §2.4.2"),
        rule("VAST-4.2-icon-fallback-image-width-height", "W", SPEC, "IconClickFallbackImage has no width or height", "IconClickFallbackImage", fallback & F.col("trail").endswith("/Icon/IconClicks/IconClickFallbackImages/IconClickFallbackImage"), mode="last", spec="IAB VAST 4.2 §2.3.6.4"),
    ]


def mezzanine() -> list[Rule]:
    here = VISITED & (V >= 3)
    return [rule(f"VAST-4.1-mezzanine-{a}", "E", SPEC, f"Mezzanine has no {a}", "Mezzanine", here & lacks(a), spec="IAB VAST 4.1 §2.3.5.2") for a in ("delivery", "type", "width", "height")]


def taxonomy() -> list[Rule]:
    return [
        rule("VAST-4.0-category-authority", "E", SPEC, "Category has no authority", "Category", VAST & on(f"{INLINE}/Category", f"{WRAPPER}/Category") & lacks("authority"), mode="last", spec="IAB VAST 4.0 §2.3.3"),
        rule("VAST-4.1-blockedadcategories-no-authority", "W", SPEC, "BlockedAdCategories has no authority", "BlockedAdCategories", VAST & (F.col("trail") == f"{WRAPPER}/BlockedAdCategories") & lacks("authority"), mode="last", spec="IAB VAST 4.1 §2.3.2"),
    ]


def pricing() -> list[Rule]:
    here = at(f"{INLINE}/Pricing", f"{WRAPPER}/Pricing")
    return [
        rule("VAST-3.0-pricing-model", "E", SPEC, "Pricing has no model", "Pricing", here & lacks("model"), spec="IAB VAST 3.0 §2.3.10"),
        rule("VAST-3.0-pricing-currency", "E", SPEC, "Pricing has no currency", "Pricing", here & lacks("currency"), spec="IAB VAST 3.0 §2.3.10"),
        rule("VAST-3.0-pricing-currency-format", "W", "ISO 4217", "the currency is not three letters", "Pricing", here & ~attr("currency").rlike("^[A-Za-z]{3}$"), suffix="[@currency]", spec="IAB VAST 3.0 §2.3.10"),
        rule("VAST-3.0-pricing-model-case", "W", XSD, "the model has upper-case letters", "Pricing", here & (V == 1) & attr("model").rlike("[A-Z]"), suffix="[@model]", spec="IAB VAST 3.0 §2.3.10"),
    ]


def verification() -> list[Rule]:
    block = f"{INLINE}/AdVerifications", f"{WRAPPER}/AdVerifications"
    gate = F.col("trail").startswith(INLINE) | F.coalesce(V >= 3, F.lit(False))
    here = VAST & F.col("first") & on(*(f"{b}/Verification" for b in block)) & gate
    js = VAST & on(*(f"{b}/Verification/JavaScriptResource" for b in block)) & gate
    exe = VAST & on(*(f"{b}/Verification/ExecutableResource" for b in block)) & gate
    early = V < 3
    vendor = attr("vendor")
    api = lambda k: F.lower(trimmed(k["attr"]["apiFramework"])) == "omid"
    omid = F.coalesce(is_omid_vendor(vendor), F.lit(False)) | F.coalesce(any_kid(lambda k: k["name"].isin("JavaScriptResource", "ExecutableResource") & api(k)), F.lit(False))
    omid_parent = F.coalesce(is_omid_vendor(fact("vendor")), F.lit(False)) | told("#omid")
    parameters = any_kid(lambda k: (k["name"] == "VerificationParameters") & (k["text"] != ""))
    again = told("#again")
    tracked = VAST & on(*(f"{b}/Verification/TrackingEvents/Tracking" for b in block)) & gate
    failed = attr("event") == "verificationNotExecuted"
    return [
        rule("VAST-4.1-verification-no-resource", "W", SPEC, "Verification has no resource", "Verification", here & ~(has("JavaScriptResource") | has("ExecutableResource")), spec="IAB VAST 4.1 §2.4"),
        *by_level(rule("VAST-4.1-verification-vendor", "E", SPEC, "Verification has no vendor", "Verification", here & vendor.isNull(), spec="IAB VAST 4.1 §3.17"), "W", early),
        rule("VAST-4.1-verification-vendor-format", "W", SPEC, "the vendor is not a vendor key", "Verification", here & vendor.isNotNull() & ~is_vendor_key(vendor), spec="IAB VAST 4.1 §3.17"),
        rule("VAST-4.1-verification-duplicate-vendor", "W", SPEC, "a vendor stands twice", "Verification", here & again, spec="IAB VAST 4.1 §3.17"),
        rule("VAST-4.1-verification-parameters", "W", SPEC, "OMID has no VerificationParameters", "Verification", here & omid & ~parameters, spec="IAB VAST 4.3 §3.17.5"),
        rule("VAST-4.1-verification-tracking-reason", "W", SPEC, "verificationNotExecuted has no [REASON]", "Tracking", tracked & failed & ~(TEXT.contains("[REASON]") | F.lower(TEXT).contains("%5breason%5d")), spec="IAB VAST 4.3 §3.17.4"),
        rule("VAST-4.1-tracking-event-value", "E", XSD, "Verification knows only verificationNotExecuted", "Tracking", tracked & attr("event").isNotNull() & ~failed, suffix="[@event]", spec="IAB VAST 4.3 §3.17.4"),
        *by_level(rule("VAST-4.1-js-resource-apiframework", "E", SPEC, "JavaScriptResource has no apiFramework", "JavaScriptResource", js & lacks("apiFramework"), mode="last", spec="IAB VAST 4.1 §3.17.1"), "W", early),
        rule("VAST-4.1-js-resource-apiframework-value", "W", SPEC, "an OMID script's apiFramework is omid", "JavaScriptResource", js & omid_parent & (attr("apiFramework") != "omid"), mode="last", spec="IAB VAST 4.1 §3.17.1"),
        rule("VAST-4.1-js-resource-https", "W", BEST, "an OMID script is not secure", "JavaScriptResource", js & omid_parent & TEXT.startswith("http://"), mode="last", spec="IAB VAST 4.1 §3.17.1"),
        rule("VAST-4.3-js-resource-browser-optional", "W", SPEC, "JavaScriptResource has no browserOptional", "JavaScriptResource", js & lacks("browserOptional"), mode="last", spec="IAB VAST 4.3 §3.17.1"),
        rule("VAST-4.1-exec-resource-apiframework", "E", SPEC, "ExecutableResource has no apiFramework", "ExecutableResource", exe & lacks("apiFramework"), mode="last", spec="IAB VAST 4.1 §3.17.2"),
        rule("VAST-4.1-exec-resource-apiframework-value", "W", SPEC, "the apiFramework is not omid", "ExecutableResource", exe & omid_parent & (attr("apiFramework") != "omid"), mode="last", spec="IAB VAST 4.1 §3.17.2"),
        rule("VAST-4.1-exec-resource-type", "E", SPEC, "ExecutableResource has no type", "ExecutableResource", exe & lacks("type"), mode="last", spec="IAB VAST 4.1 §3.17.2"),
        rule("VAST-4.1-exec-resource-https", "W", BEST, "ExecutableResource is not secure", "ExecutableResource", exe & omid_parent & TEXT.startswith("http://"), mode="last", spec="IAB VAST 4.1 §3.17.2"),
    ]


def interactive_file() -> list[Rule]:
    here = VISITED & (~inside("NonLinear") | F.coalesce(is_v4(), F.lit(False)))
    return [
        rule("VAST-4.0-interactive-creative-no-api", "W", SPEC, "InteractiveCreativeFile has no apiFramework", "InteractiveCreativeFile", here & lacks("apiFramework"), spec="IAB VAST 4.0 §2.3.5.4"),
        rule("VAST-4.1-interactive-creative-type", "W", "IANA Media Types", "InteractiveCreativeFile has no type", "InteractiveCreativeFile", here & lacks("type"), spec="IAB VAST 4.1 §3.9.3"),
    ]


def structure() -> list[Rule]:
    ads = F.filter("kids", lambda k: k["name"] == "Ad")
    numbered = F.size(F.filter(ads, lambda k: k["attr"]["sequence"].isNotNull()))
    top = F.col("depth") == 0
    singular = {
        "InLine": "AdSystem AdTitle AdServingId Creatives Advertiser Description Survey Expires Pricing ViewableImpression AdVerifications Extensions",
        "Wrapper": "AdSystem VASTAdTagURI Creatives Pricing ViewableImpression AdVerifications Extensions",
        "Linear": "Duration MediaFiles VideoClicks TrackingEvents Icons AdParameters",
        "Creative": "Linear NonLinearAds CompanionAds CreativeExtensions",
        "NonLinear": "AdParameters NonLinearClickThrough",
        "Companion": "AdParameters AltText CompanionClickThrough TrackingEvents CreativeExtensions",
        "VideoClicks": "ClickThrough",
        "Icon": "IconClicks",
        "Verification": "TrackingEvents VerificationParameters",
    }
    found = lambda k: F.length("kid_names") - F.length(F.replace("kid_names", F.concat(F.lit("/"), k, F.lit("/")), F.lit("")))
    twice = lambda kids: F.filter(F.expr("array(" + ", ".join(f"'{k}'" for k in kids) + ")"), lambda k: found(k) >= 2 * (F.length(k) + 2))
    return [
        rule("VAST-2.0-wrapper-depth", "E", SPEC, "the wrapper chain is too long", "", top & F.col("parse_error").isNull() & (F.col("document_type") == "VAST") & (F.col("wrapper_depth") > F.col("max_wrapper_depth")), mode="top", located="none", spec="IAB VAST 4.x §2.3"),
        rule("VAST-2.0-ad-sequence", "W", SPEC, "some Ads have a sequence, some have none", "VAST", top & VAST & (F.size(ads) >= 2) & (numbered > 0) & (numbered < F.size(ads)), located="none", spec="IAB VAST 2.0 §2.2"),
        *(
            rule("VAST-2.0-duplicate-singular-element", "E", XSD, "an element stands twice", parent, F.col("twins") & (VISITED | F.col("paid")) & (F.size(twice(kids.split())) > 0), each=F.transform(twice(kids.split()), lambda k: F.concat(F.lit("/"), k)), spec="IAB VAST 4.2 XSD")
            for parent, kids in singular.items()
        ),
    ]


def consistency() -> list[Rule]:
    top = F.col("depth") == 0
    urls = F.filter(F.transform(F.filter("kids", lambda k: k["name"] == "Impression"), lambda k: k["text"]), lambda x: x != "")
    # a Wrapper counts only where there is no InLine; such Ads are reported anyway
    here = at(INLINE, WRAPPER)
    return [
        rule("VAST-2.0-parse-error", "E", "W3C XML 1.0", "the document is not well formed", "", (F.col("node_id") == 0) & F.col("parse_error").isNotNull(), mode="top", located="none", spec="IAB VAST 2.0 §2"),
        rule("VAST-2.0-version-mismatch", "W", GUESS, "the structure is of a later version", "VAST", top & VAST & ~F.col("version.consistent"), located="none", spec="IAB VAST 2.0 §2.1"),
        rule("VAST-2.0-duplicate-impression", "W", BEST, "an Impression URL stands twice", "InLine Wrapper", here & (F.size(F.array_distinct(urls)) < F.size(urls)), suffix="/Impression", located="none", spec="IAB VAST 2.0 §2.3.3"),
    ]


def escaped() -> list[Rule]:
    # told before the parse, and carried through it
    return [rule("VAST-2.0-json-escaped", "E", "W3C XML 1.0", "the document is JSON-escaped", "", (F.col("node_id") == 0) & F.col("was_escaped"), spec="W3C XML 1.0", mode="none", located="none")]


def deprecated() -> list[Rule]:
    media = VAST & (F.col("trail") == f"{LINEAR}/MediaFiles/MediaFile") & F.col("first")
    api = attr("apiFramework")
    vpaid = F.lower(api) == "vpaid"
    return [
        rule("VAST-4.0-conditionalad", "W", SPEC, "conditionalAd is out of use", "Ad", VAST & (F.col("trail") == "VAST/Ad") & (V >= 3) & ~lacks("conditionalAd"), spec="IAB VAST 4.1 §2.2.1"),
        rule("VAST-4.1-survey-deprecated", "W", SPEC, "Survey is out of use", "InLine Wrapper", at(INLINE, WRAPPER) & (V >= 3) & has("Survey"), suffix="/Survey", spec="IAB VAST 4.1 §4"),
        rule("VAST-4.1-vpaid-apiframework", "W", SPEC, "VPAID is out of use", "MediaFile", media & (V >= 3) & vpaid, spec="IAB VAST 4.1 §2.3.5.1"),
        rule("VAST-4.0-mediafile-apiframework", "I", SPEC, "MediaFile has an apiFramework", "MediaFile", media & (V >= 2) & api.isNotNull() & ~((V >= 3) & vpaid), spec="IAB VAST 4.0 §2.3.5.2"),
        rule("VAST-2.0-flash-mediafile", "W", GUESS, "a Flash file", "MediaFile", media & F.lower(attr("type")).contains("flash"), spec="IAB VAST 2.0 §2.3.5.2"),
        rule("VAST-2.0-mediafile-image", "W", BEST, "an image as MediaFile", "MediaFile", media & F.lower(attr("type")).startswith("image/"), spec="IAB VAST 2.0 §2.3.5.2"),
    ]


def ambiguous() -> list[Rule]:
    creative = f"{INLINE}/Creatives/Creative"
    quartiles = ("start", "firstQuartile", "midpoint", "thirdQuartile", "complete")
    no_size = lacks("width") | lacks("height")
    events = any_kid(lambda k: (k["name"] == "Tracking") & k["attr"]["event"].isin(*quartiles))
    return [
        rule("VAST-3.0-progress-offset", "E", SPEC, "a progress event has no offset", "Tracking", VAST & (F.col("trail") == f"{LINEAR}/TrackingEvents/Tracking") & F.col("first") & (attr("event") == "progress") & lacks("offset"), spec="IAB VAST 3.0 §2.3.6"),
        rule("VAST-2.0-nonlinear-dimensions", "W", SPEC, "NonLinear has no width or height", "NonLinear", at(f"{creative}/NonLinearAds/NonLinear") & no_size, spec="IAB VAST 2.0 §2.3.6.1"),
        rule("VAST-2.0-companion-dimensions", "W", SPEC, "Companion has no width or height", "Companion", at(f"{creative}/CompanionAds/Companion") & no_size, spec="IAB VAST 2.0 §2.3.7.1"),
        rule("VAST-4.0-wrapper-clickthrough", "W", SPEC, "a Wrapper has a ClickThrough", "VideoClicks", at(f"{WRAPPER}/Creatives/Creative/Linear/VideoClicks") & V.between(2, 3) & has("ClickThrough"), suffix="/ClickThrough", spec="IAB VAST 4.0 §2.4.1"),
        rule("VAST-2.0-linear-tracking-quartiles", "W", BEST, "Linear has no quartile events", "Linear", at(LINEAR) & ~has("TrackingEvents"), spec="IAB VAST 4.1 §3.14.2"),
        rule("VAST-2.0-linear-tracking-quartiles", "W", BEST, "Linear has no quartile events", "TrackingEvents", at(f"{LINEAR}/TrackingEvents") & ~events, mode="up", located="up", spec="IAB VAST 4.1 §3.14.2"),
    ]


def ctv() -> list[Rule]:
    files = at(f"{LINEAR}/MediaFiles") & (V >= 3)
    creatives = F.coalesce(fact("#creatives").cast("int"), F.lit(0))
    return [
        rule("VAST-4.1-mezzanine-recommended", "I", BEST, "MediaFiles has no Mezzanine", "MediaFiles", files & ~has("Mezzanine"), spec="IAB VAST 4.1 §3.9.2"),
        rule("VAST-4.1-vpaid-in-interactive-context", "W", BEST, "VPAID beside an InteractiveCreativeFile", "MediaFile", at(f"{LINEAR}/MediaFiles/MediaFile") & (V >= 3) & (F.lower(attr("apiFramework")) == "vpaid") & told("#icf"), spec="IAB VAST 4.1 §2.4.3"),
        # once for each creative that has media files
        rule("VAST-4.1-ad-serving-id-empty", "W", GUESS, "AdServingId is empty", "AdServingId", at(f"{INLINE}/AdServingId") & (V >= 3) & (TEXT == "") & (creatives > 0), each=F.array_repeat(F.lit(""), creatives), spec="IAB VAST 4.1 §3.4.1"),
    ]


# Placeholder titles and systems.
TITLES = "ad;ads;ad 1;ad1;adtitle;ad title;title;untitled;unknown;test;test ad;testing;sample;sample ad;placeholder;default;demo;n/a;na;none;null;tbd;todo;vast ad;video ad".split(";")
SYSTEMS = "adsystem;ad system;adserver;ad server;server;system;unknown;test;testing;sample;placeholder;default;demo;n/a;na;none;null;tbd;todo".split(";")


def quality() -> list[Rule]:
    low = F.lower(TEXT)
    system = at(f"{INLINE}/AdSystem", f"{WRAPPER}/AdSystem")
    return [
        rule("VAST-2.0-adtitle-quality", "W", BEST, "AdTitle is a placeholder", "AdTitle", at(f"{INLINE}/AdTitle") & among(low, ["", *TITLES]), spec="IAB VAST 2.0 §2"),
        rule("VAST-2.0-adsystem-quality", "I", BEST, "AdSystem is a placeholder", "AdSystem", system & among(low, ["", *SYSTEMS]), spec="IAB VAST 2.0 §2"),
        rule("VAST-2.0-adsystem-no-version", "I", BEST, "AdSystem has no version", "AdSystem", system & lacks("version"), spec="IAB VAST 2.0 §2"),
    ]


FAMILIES = {f.__name__: f for f in (root, ad_choice, inline_required, wrapper_required, linear_required, media_attributes, universal_ad_id, resources, icons, mezzanine, taxonomy, pricing, verification, interactive_file, structure, consistency, escaped, deprecated, ambiguous, ctv, quality)}
