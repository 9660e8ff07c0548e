"""VMAP playlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlint_spark.functions.values import is_break_type, is_hhmmss, is_time_offset, trimmed
from adlint_spark.operators.rules.spec import TEXT, Rule, any_grand, attr, count_of, fact, has, kids_at, lacks, rule

SPEC = "IAB VMAP"
EVENTS = ("breakStart", "breakEnd", "error")


NAMESPACE = "http://www.iab.net/videosuite/vmap"


def playlist() -> list[Rule]:
    vmap = (F.col("root_name") == "VMAP") & F.col("parse_error").isNull()
    at = lambda trail: vmap & (F.col("trail") == trail)
    # only the first AdSource of a break is read
    source = at("VMAP/AdBreak/AdSource") & (F.col("name_idx") == 0)
    brk, tracking = at("VMAP/AdBreak"), at("VMAP/AdBreak/TrackingEvents/Tracking")
    inside = lambda name: at(f"VMAP/AdBreak/AdSource/{name}") & F.col("main")
    content = count_of("VASTAdData") + count_of("AdTagURI") + count_of("CustomAdData")
    other = lambda *names: (lambda k: ~k["name"].isin(*names))
    some = lambda *names: F.exists("kids", other(*names))
    event, offset = attr("event"), trimmed(attr("timeOffset"))
    plays = any_grand("VASTAdData", lambda g: g["name"] == "VAST") & fact("#companions").isNull()
    displays = F.exists(F.split(fact("breakType"), ","), lambda t: trimmed(t) == "display")
    return [
        rule("VMAP-1.0-root-version", "E", SPEC, "VMAP has no version", "VMAP", at("VMAP") & lacks("version"), spec="IAB VMAP 1.0.1 §2.3"),
        rule("VMAP-1.0-root-version-value", "W", SPEC, "the version is not 1.0", "VMAP", at("VMAP") & (trimmed(attr("version")) != "1.0"), suffix="[@version]", spec="IAB VMAP 1.0.1 §2.3"),
        rule("VMAP-1.0-root-namespace", "W", SPEC, "VMAP does not declare its namespace", "VMAP", at("VMAP") & ~F.exists(F.map_values("attr"), lambda x: trimmed(x) == NAMESPACE), spec="IAB VMAP 1.0.1 §2.2"),
        rule("VMAP-1.0-root-unknown-child", "E", SPEC, "VMAP has an unknown child", "VMAP", at("VMAP") & some("AdBreak", "Extensions"), each=kids_at(other("AdBreak", "Extensions")), spec="IAB VMAP 1.0.1 §2.3.1"),
        rule("VMAP-1.0-adbreak-timeoffset", "E", SPEC, "AdBreak has no timeOffset", "AdBreak", brk & lacks("timeOffset"), spec="IAB VMAP 1.0.1 §2.3.1"),
        rule("VMAP-1.0-adbreak-timeoffset-format", "E", SPEC, "timeOffset is not a time offset", "AdBreak", brk & ~is_time_offset(attr("timeOffset")), suffix="[@timeOffset]", spec="IAB VMAP 1.0.1 §2.3.1"),
        rule("VMAP-1.0-adbreak-breaktype", "E", SPEC, "AdBreak has no breakType", "AdBreak", brk & lacks("breakType"), spec="IAB VMAP 1.0.1 §2.3.1"),
        rule("VMAP-1.0-adbreak-breaktype-value", "E", SPEC, "breakType is unknown", "AdBreak", brk & ~is_break_type(attr("breakType")), suffix="[@breakType]", spec="IAB VMAP 1.0.1 §2.3.1"),
        rule("VMAP-1.0-adbreak-repeatafter-format", "W", SPEC, "repeatAfter is not HH:MM:SS", "AdBreak", brk & ~is_hhmmss(trimmed(attr("repeatAfter"))), suffix="[@repeatAfter]", spec="IAB VMAP 1.0.1 §2.3.1"),
        rule("VMAP-1.0-repeatafter-conflict", "W", SPEC, "a break that comes once can't repeat", "AdBreak", brk & ~lacks("repeatAfter") & offset.isin("start", "end"), spec="IAB VMAP 1.0.1 §2.3.1", suffix="[@repeatAfter]"),
        rule("VMAP-1.0-adbreak-unknown-child", "E", SPEC, "AdBreak has an unknown child", "AdBreak", brk & some("AdSource", "TrackingEvents", "Extensions"), each=kids_at(other("AdSource", "TrackingEvents", "Extensions")), spec="IAB VMAP 1.0.1 §2.3.1"),
        rule("VMAP-1.0-adbreak-multiple-adsource", "E", SPEC, "AdBreak has several AdSources", "AdSource", at("VMAP/AdBreak/AdSource") & (F.col("name_idx") == 1), suffix="[1]", spec="IAB VMAP 1.0.1 §2.3.2"),
        *(rule("VMAP-1.0-adsource-bool-attr", "W", SPEC, f"{a} is not a boolean", "AdSource", source & ~trimmed(attr(a)).isin("true", "false"), suffix=f"[@{a}]", spec="IAB VMAP 1.0.1 §2.3.2") for a in ("allowMultipleAds", "followRedirects")),
        rule("VMAP-1.0-adsource-content", "E", SPEC, "AdSource has not just one content", "AdSource", source & (content != 1), spec="IAB VMAP 1.0.1 §2.3.2"),
        rule("VMAP-1.0-display-break-no-companions", "I", SPEC, "a display break's ads have no CompanionAds", "AdSource", source & plays & displays, spec="IAB VMAP 1.0.1 §2.3.1", suffix="/VASTAdData"),
        rule("VMAP-1.0-adtaguri-empty", "E", SPEC, "AdTagURI is empty", "AdTagURI", inside("AdTagURI") & (TEXT == ""), spec="IAB VMAP 1.0.1 §2.3.2"),
        rule("VMAP-1.0-adtaguri-cdata", "E", SPEC, "AdTagURI is not in a CDATA section", "AdTagURI", inside("AdTagURI") & (TEXT != "") & ~F.col("has_cdata"), spec="IAB VMAP 1.0.1 §2.3.2"),
        rule("VMAP-1.0-customaddata-cdata", "E", SPEC, "CustomAdData is not in a CDATA section", "CustomAdData", inside("CustomAdData") & (TEXT != "") & ~F.col("has_cdata"), spec="IAB VMAP 1.0.1 §2.3.2"),
        rule("VMAP-1.0-vastaddata-vast-root", "E", SPEC, "VASTAdData has no VAST", "VASTAdData", inside("VASTAdData") & ~has("VAST"), spec="IAB VMAP 1.0.1 §2.3.2"),
        rule("VMAP-1.0-embedded-vast-version", "I", SPEC, "VAST in a playlist is of version 3.0", "VAST", F.col("base").isNotNull() & (F.col("depth") == 0) & (trimmed(attr("version")) != "3.0"), spec="IAB VMAP 1.0.1 §3.2", suffix="[@version]"),
        rule("VMAP-1.0-trackingevents-unknown-child", "E", SPEC, "TrackingEvents has an unknown child", "TrackingEvents", at("VMAP/AdBreak/TrackingEvents") & some("Tracking"), each=kids_at(other("Tracking")), spec="IAB VMAP 1.0.1 §2.3.3"),
        rule("VMAP-1.0-tracking-event", "E", SPEC, "Tracking has no event", "Tracking", tracking & event.isNull(), spec="IAB VMAP 1.0.1 §2.3.3"),
        rule("VMAP-1.0-tracking-event-value", "E", SPEC, "the event is unknown", "Tracking", tracking & ~event.isin(*EVENTS), suffix="[@event]", spec="IAB VMAP 1.0.1 §2.3.3"),
        rule("VMAP-1.0-error-tracking-macro", "I", SPEC, "an error event has no [ERROR_CODE]", "Tracking", tracking & (event == "error") & ~TEXT.contains("[ERROR_CODE]"), spec="IAB VMAP 1.0.1 §2.5"),
        rule("VMAP-1.0-tracking-url-empty", "E", SPEC, "Tracking has no URL", "Tracking", tracking & (TEXT == ""), spec="IAB VMAP 1.0.1 §2.3.3"),
    ]


FAMILIES = {"playlist": playlist}
