"""DAAST audio ads."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlint_spark.functions.values import among, is_hhmmss, is_time_or_percent, trimmed
from adlint_spark.operators.rules.spec import on, TEXT, Rule, attr, has, lacks, rule

SPEC, XSD, GUESS = "IAB DAAST", "DAAST XSD", "inferred"
EVENTS = "creativeView start firstQuartile midpoint thirdQuartile complete mute unmute pause rewind resume skip progress".split()


def audio() -> list[Rule]:
    daast = (F.col("root_name") == "DAAST") & F.col("parse_error").isNull()
    at = lambda *trails: daast & F.col("first") & on(*trails)
    times = lambda kid: F.expr(f"(length(kid_names) - length(replace(kid_names, '/{kid}/', ''))) / {len(kid) + 2}")
    once = lambda *trails: at(*trails) & (F.col("name_idx") == 0)
    inline, wrapper = "DAAST/Ad/InLine", "DAAST/Ad/Wrapper"
    linear = f"{inline}/Creatives/Creative/Linear"
    media, tracking = at(f"{linear}/MediaFiles/MediaFile"), at(f"{linear}/TrackingEvents/Tracking", f"{wrapper}/Creatives/Creative/Linear/TrackingEvents/Tracking")
    price, event = at(f"{inline}/Pricing", f"{wrapper}/Pricing"), attr("event")
    error = daast & on("DAAST/Error")
    return [
        rule("DAAST-1.0-root-version", "E", SPEC, "DAAST has no version", "DAAST", at("DAAST") & lacks("version"), spec="IAB DAAST 1.0 §3.1.1"),
        rule("DAAST-1.0-root-version-value", "W", XSD, "the version is unknown", "DAAST", at("DAAST") & ~trimmed(attr("version")).isin("1.0", "1.1"), suffix="[@version]", spec="IAB DAAST 1.0 §3.1.1"),
        rule("DAAST-1.0-root-has-ad-or-error", "E", SPEC, "DAAST has neither Ad nor Error", "DAAST", at("DAAST") & ~has("Ad") & ~has("Error"), spec="IAB DAAST 1.0 §3.1.2"),
        rule("DAAST-1.0-ad-has-inline-or-wrapper", "E", SPEC, "an Ad holds one of InLine and Wrapper", "Ad", at("DAAST/Ad") & (times("InLine") + times("Wrapper") != 1), spec="IAB DAAST 1.0 §3.1.2"),
        rule("DAAST-1.0-inline-adtitle", "E", SPEC, "InLine has no AdTitle", "InLine", at(inline) & ~has("AdTitle"), spec="IAB DAAST 1.0 §3.1.4.1"),
        rule("DAAST-1.0-inline-impression", "E", SPEC, "InLine has no Impression", "InLine", at(inline) & ~has("Impression"), spec="IAB DAAST 1.0 §3.1.4.1"),
        rule("DAAST-1.0-inline-category", "E", SPEC, "InLine has no Category", "InLine", at(inline) & ~has("Category"), spec="IAB DAAST 1.0 §3.1.4.1"),
        rule("DAAST-1.0-inline-creatives", "E", SPEC, "InLine has no Creatives", "InLine", at(inline) & ~has("Creatives"), spec="IAB DAAST 1.0 §3.1.6"),
        rule("DAAST-1.0-inline-creatives", "E", SPEC, "InLine has no Creative", "Creatives", at(f"{inline}/Creatives") & ~has("Creative"), mode="up", located="up", spec="IAB DAAST 1.0 §3.1.6"),
        rule("DAAST-1.0-wrapper-daastadtaguri", "E", SPEC, "Wrapper has no DAASTAdTagURI", "Wrapper", at(wrapper) & ~has("DAASTAdTagURI"), spec="IAB DAAST 1.0 §3.3.1.1"),
        rule("DAAST-1.0-wrapper-vast-adtaguri", "W", GUESS, "Wrapper has a VASTAdTagURI", "VASTAdTagURI", once(f"{wrapper}/VASTAdTagURI"), spec="IAB DAAST 1.0 §3.3.1.1"),
        rule("DAAST-1.0-wrapper-impression", "E", SPEC, "Wrapper has no Impression", "Wrapper", at(wrapper) & ~has("Impression"), spec="IAB DAAST 1.0 §3.3.1.1"),
        rule("DAAST-1.0-videoclicks-element", "W", GUESS, "VideoClicks in an audio ad", "VideoClicks", once(f"{linear}/VideoClicks"), spec="IAB DAAST 1.0 §3.2.1.6"),
        rule("DAAST-1.0-audiointeractions-renamed", "W", SPEC, "AudioInteractions is now AdInteractions", "AudioInteractions", once(f"{linear}/AudioInteractions", f"{wrapper}/Creatives/Creative/Linear/AudioInteractions"), spec="IAB DAAST 1.1 Document Updates"),
        rule("DAAST-1.0-linear-duration", "E", SPEC, "Linear has no Duration", "Linear", at(linear) & ~has("Duration"), spec="IAB DAAST 1.0 §3.2.1.2"),
        rule("DAAST-1.0-duration-format", "E", SPEC, "Duration is not HH:MM:SS", "Duration", at(f"{linear}/Duration") & (TEXT != "") & ~is_hhmmss(TEXT), spec="IAB DAAST 1.0 §3.2.1.2"),
        rule("DAAST-1.0-linear-mediafiles", "E", SPEC, "Linear has no MediaFiles", "Linear", at(linear) & ~has("MediaFiles"), spec="IAB DAAST 1.0 §3.2.1.3"),
        rule("DAAST-1.0-linear-mediafiles", "E", SPEC, "Linear has no MediaFile", "MediaFiles", at(f"{linear}/MediaFiles") & ~has("MediaFile"), mode="up", located="up", spec="IAB DAAST 1.0 §3.2.1.3"),
        rule("DAAST-1.0-mediafile-delivery", "E", SPEC, "MediaFile has no delivery", "MediaFile", media & lacks("delivery"), spec="IAB DAAST 1.0 §3.2.1.4"),
        rule("DAAST-1.0-mediafile-delivery-enum", "E", XSD, "delivery is neither progressive nor streaming", "MediaFile", media & ~attr("delivery").isin("progressive", "streaming"), suffix="[@delivery]", spec="IAB DAAST 1.0 §3.2.1.4"),
        rule("DAAST-1.0-mediafile-type", "E", SPEC, "MediaFile has no type", "MediaFile", media & lacks("type"), spec="IAB DAAST 1.0 §3.2.1.4"),
        rule("DAAST-1.0-mediafile-audio-type", "W", GUESS, "the type is not audio", "MediaFile", media & attr("type").startswith("video/"), suffix="[@type]", spec="IAB DAAST 1.0 §3.2.1.4"),
        rule("DAAST-1.0-mediafile-id", "W", XSD, "MediaFile has no id", "MediaFile", media & lacks("id"), spec="IAB DAAST 1.0 §3.2.1.4"),
        rule("DAAST-1.0-mediafile-url-empty", "E", SPEC, "MediaFile has no URL", "MediaFile", media & (TEXT == ""), spec="IAB DAAST 1.0 §3.2.1.4"),
        rule("DAAST-1.0-tracking-event-value", "E", XSD, "the event is unknown", "Tracking", tracking & ~among(event, EVENTS), suffix="[@event]", spec="IAB DAAST 1.0 §3.2.1.7"),
        rule("DAAST-1.0-progress-offset", "E", SPEC, "a progress event has no offset", "Tracking", tracking & (event == "progress") & lacks("offset"), spec="IAB DAAST 1.0 §3.2.4.3"),
        rule("DAAST-1.0-progress-offset", "E", SPEC, "a progress event has no fitting offset", "Tracking", tracking & (event == "progress") & ~is_time_or_percent(trimmed(attr("offset"))), suffix="[@offset]", spec="IAB DAAST 1.0 §3.2.4.3"),
        rule("DAAST-1.0-pricing-model", "E", SPEC, "Pricing has no model", "Pricing", price & lacks("model"), spec="IAB DAAST 1.0 §3.1.4.2"),
        rule("DAAST-1.0-pricing-model-value", "W", XSD, "the model is unknown", "Pricing", price & ~F.lower(attr("model")).isin("cpm", "cpc", "cpe", "cpv", "cpo"), suffix="[@model]", spec="IAB DAAST 1.0 §3.1.4.2"),
        rule("DAAST-1.0-pricing-currency", "E", SPEC, "Pricing has no currency", "Pricing", price & lacks("currency"), spec="IAB DAAST 1.0 §3.1.4.2"),
        rule("DAAST-1.0-error-url-empty", "W", SPEC, "Error has no URL", "Error", error & (TEXT == ""), mode="last", spec="IAB DAAST 1.0 §3.1.3"),
        rule("DAAST-1.0-error-tracking-macro", "I", SPEC, "Error has no [ERRORCODE]", "Error", error & (TEXT != "") & ~TEXT.contains("[ERRORCODE]"), mode="last", spec="IAB DAAST 1.0 §3.1.3"),
    ]


FAMILIES = {"audio": audio}
