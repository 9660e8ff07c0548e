import json
import time
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlint_spark import streaming
from adlint_spark.functions import values
from adlint_spark.jobs import queries as jobs
from adlint_spark.operators import chains, detect, fix, tallies, verdicts
from adlint_spark.operators.rules import REVENUE, find_rule, rule_catalog
from adlint_spark.sources import corpus, io, planted, shred

CLEAN = (
    '<VAST version="4.2"><Ad id="1"><InLine><AdSystem version="1">acme</AdSystem><AdTitle>Spring sale</AdTitle><AdServingId>s</AdServingId>'
    '<Impression><![CDATA[https://a.com/i]]></Impression><Creatives><Creative><UniversalAdId idRegistry="r">u</UniversalAdId><Linear><Duration>00:00:30</Duration>'
    '<TrackingEvents><Tracking event="start"><![CDATA[https://a.com/t]]></Tracking></TrackingEvents><MediaFiles>'
    '<Mezzanine delivery="progressive" type="video/mp4" width="1" height="1"><![CDATA[https://a.com/z]]></Mezzanine>'
    '<MediaFile delivery="progressive" type="video/mp4" width="1" height="1"><![CDATA[https://a.com/m]]></MediaFile></MediaFiles></Linear></Creative></Creatives></InLine></Ad></VAST>'
)
#: name -> (document, rules that it must have, in all)
CASES = {
    "clean": (CLEAN, []),
    "no impression": (CLEAN.replace("<Impression><![CDATA[https://a.com/i]]></Impression>", ""), ["VAST-2.0-inline-impression"]),
    "duration": (CLEAN.replace("00:00:30", "30s"), ["VAST-2.0-duration-format"]),
    "zero": (CLEAN.replace("00:00:30", "00:00:00"), ["VAST-2.0-duration-zero"]),
    "plain and insecure": (CLEAN.replace("<![CDATA[https://a.com/m]]>", "http://a.com/m"), ["VAST-2.0-mediafile-https", "VAST-2.0-url-cdata"]),
    "unknown child": (CLEAN.replace("<Creatives>", "<Bogus/><Creatives>"), ["VAST-2.0-inline-unknown-child"]),
    "unknown attribute": (CLEAN.replace('<Ad id="1"', '<Ad id="1" colour="red"'), ["VAST-2.0-unknown-attribute"]),
    "namespaced attribute": (CLEAN.replace('<Ad id="1"', '<Ad id="1" xmlns:x="u" x:colour="red"'), []),
    "twice": (CLEAN.replace("<AdTitle>", "<AdTitle>Other</AdTitle><AdTitle>"), ["VAST-2.0-duplicate-singular-element"]),
    "macros": (CLEAN.replace("a.com/i", "a.com/i?[cachebusting][NOPE]"), ["VAST-2.0-macro-lowercase", "VAST-2.0-macro-unknown"]),
    "event": (CLEAN.replace('event="start"', 'event="fullscreen"'), ["VAST-2.0-linear-tracking-quartiles", "VAST-4.0-tracking-event-removed"]),
    "version": (CLEAN.replace('"4.2"', '"3.0"'), ["VAST-2.0-version-mismatch"]),
    "dimensions": (CLEAN.replace('<MediaFile delivery="progressive" type="video/mp4" width="1" height="1">', '<MediaFile delivery="progressive" type="video/mp4">'), ["VAST-2.0-mediafile-dimensions", "VAST-2.0-mediafile-dimensions"]),
    "malformed": (CLEAN[:-7], ["VAST-2.0-parse-error"]),
    "doctype": ("<!DOCTYPE VAST>" + CLEAN, ["VAST-2.0-parse-error"]),
    "empty": ("", ["VAST-2.0-parse-error"]),
    "null": (None, ["VAST-2.0-parse-error"]),
    "escaped": (CLEAN.replace('"', '\\"'), ["VAST-2.0-json-escaped"]),
    "root": ("<Foo/>", ["VAST-2.0-root-element"]),
    "playlist": ('<VMAP version="1.0" xmlns="http://www.iab.net/videosuite/vmap"><AdBreak timeOffset="x"/></VMAP>', ["VMAP-1.0-adbreak-breaktype", "VMAP-1.0-adbreak-timeoffset-format"]),
    "audio": ('<DAAST version="1.0"/>', ["DAAST-1.0-root-has-ad-or-error"]),
    "tag twice": ('<VAST version="3.0"><Ad><Wrapper><AdSystem version="1">a</AdSystem><Impression><![CDATA[https://a.com]]></Impression><VASTAdTagURI/></Wrapper></Ad></VAST>', ["VAST-2.0-url-empty", "VAST-2.0-url-empty"]),
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(k, x) for k, (x, _) in CASES.items()], "doc_id string, xml string")


@pytest.fixture(scope="module")
def validated(documents):
    rows, findings = verdicts.validate(documents)
    return rows.collect(), findings.collect()


def test_each_case_has_its_findings(validated):
    found = {k: [] for k in CASES}
    for r in validated[1]:
        found[r.doc_id].append(r.rule_id)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, (_, v) in CASES.items()}


def test_verdicts_count_findings(validated, documents):
    for r in validated[0]:
        own = [f.severity for f in validated[1] if f.doc_id == r.doc_id]
        assert (r.errors, r.warnings, r.infos, r.valid) == (own.count("error"), own.count("warning"), own.count("info"), "error" not in own)
    one_pass = {r.doc_id: (r.errors, r.warnings, r.infos) for r in verdicts.verdicts_of(documents).collect()}
    assert one_pass == {r.doc_id: (r.errors, r.warnings, r.infos) for r in validated[0]}


def test_catalog(spark):
    rows = rule_catalog(spark).collect()
    assert len({r.rule_id for r in rows}) == len(rows) == 246 and {r.rule_id for r in rows if r.revenue_impact} == set(REVENUE) and len(REVENUE) == 15


def test_stream_finds_escaped_documents_too(spark, documents, validated, tmp_path):
    documents.write.parquet(str(tmp_path / "in"))
    stream = io.stream_documents(spark, str(tmp_path / "in"), documents.schema)
    query = streaming.validate_stream(stream).writeStream.format("memory").queryName("all_found").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: tuple(str(r[c]) for c in verdicts.FINDING_KEY)
    assert sorted(map(key, spark.table("all_found").collect())) == sorted(map(key, validated[1]))


def test_event_stream_equals_batch(spark, tmp_path):
    events = corpus.verdict_events(spark, "/root/testdata/sf0.001")
    events.write.parquet(str(tmp_path / "e"))
    stream = streaming.dedupe_events(streaming.event_time(io.stream_documents(spark, str(tmp_path / "e"), events.schema), "400 days"))
    query = streaming.rejections(stream).writeStream.format("memory").queryName("rejected").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("rejected").count() == streaming.rejections(events.dropDuplicates(["event_id"])).count() > 0


def test_policies(spark, validated):
    rows = spark.createDataFrame([("a", "p", "r1", "error"), ("b", "p", "r2", "error"), ("c", None, "r1", "error")], "doc_id string, policy_id string, rule_id string, severity string")
    policy = spark.createDataFrame([("p", "r1", "off"), ("p", "r2", "info")], "policy_id string, rule_id string, level string")
    assert sorted((r.doc_id, r.severity) for r in verdicts.apply_policy(rows, policy).collect()) == [("b", "info"), ("c", "error")]


def test_chain_stops_at_its_depth(spark):
    hop = lambda n: f'<VAST><Ad><Wrapper><VASTAdTagURI> <![CDATA[ u{n} ]]> </VASTAdTagURI></Wrapper></Ad></VAST>'
    answers = spark.createDataFrame([(f"u{k}", hop(k + 1)) for k in range(20)], "url string, xml string")
    roots = spark.createDataFrame([("x", "u0"), ("y", "u18"), ("z", "none")], "root_id string, url string")
    rows = chains.resolve_chains(roots, answers).collect()
    assert sorted((r.root_id, r.depth) for r in rows) == [*(("x", d) for d in range(6)), ("y", 0), ("y", 1), ("y", 2), ("z", 0)]


def test_repairs(spark):
    xml = '<VAST><Ad conditionalAd="false" id="1"><InteractiveCreativeFile apiFramework=" simid " variableDuration="yes">HTTP://a.com</InteractiveCreativeFile></Ad></VAST>'
    r = fix.fix(spark.createDataFrame([("d", xml), ("e", None), ("f", "<VAST/>")], "doc_id string, xml string")).collect()
    assert r[0].xml == '<VAST><Ad id="1"><InteractiveCreativeFile apiFramework="SIMID" variableDuration="true" type="text/html">https://a.com</InteractiveCreativeFile></Ad></VAST>'
    assert [(a.rule_id, a.n, a.path) for a in r[0].applied] == [
        ("SIMID-1.0-simid-url-https", 1, "/VAST"), ("SIMID-1.0-simid-apiframework-case", 1, "/VAST"), ("SIMID-1.0-simid-variable-duration-value", 1, "/VAST"),
        ("SIMID-1.0-simid-type-required", 1, "/VAST"), ("VAST-4.0-conditionalad", 1, "/VAST"),
    ]
    assert r[1].xml is None and r[1].applied == [] and r[2].applied == []


#: text -> (repaired text, repairs)
REPAIRED = {
    '<VAST version="2.0" xmlns:xsi="http://a.com"/>': ('<VAST version="2.0" xmlns:xsi="https://a.com"/>', {}),
    '<T><![CDATA[<x apiFramework="simid">]]></T>': ('<T><![CDATA[<x apiFramework="simid">]]></T>', {}),
    '<T><!-- <x apiFramework="simid"> --><?p <x apiFramework="simid">?></T>': ('<T><!-- <x apiFramework="simid"> --><?p <x apiFramework="simid">?></T>', {}),
    "<T><x a='>' apiFramework='Simid'/></T>": ("<T><x a='>' apiFramework='SIMID'/></T>", {"SIMID-1.0-simid-apiframework-case": 1}),
    '<T><x:apiFramework x:apiFramework="simid"/></T>': ('<T><x:apiFramework x:apiFramework="simid"/></T>', {}),
    '<T><NonLinear apiFramework="SIMID"><IFrameResource /></NonLinear><IFrameResource apiFramework="SIMID"/></T>': (
        '<T><NonLinear apiFramework="SIMID"><IFrameResource type="text/html"/></NonLinear><IFrameResource apiFramework="SIMID"/></T>', {"SIMID-1.1-iframe-simid-type-required": 1},
    ),
    '<T><NonLinear/><IFrameResource apiFramework="SIMID"/></T>': ('<T><NonLinear/><IFrameResource apiFramework="SIMID"/></T>', {}),
    '<T><InteractiveCreativeFile apiFramework="SIMID" type="x" variableDuration="false"/></T>': ('<T><InteractiveCreativeFile apiFramework="SIMID" type="x" variableDuration="false"/></T>', {}),
    # not well formed: the second tag is scanned and not parsed
    '<T><InteractiveCreativeFile apiFramework="SIMID"/></U><InteractiveCreativeFile apiFramework="SIMID"/>': ('<T><InteractiveCreativeFile apiFramework="SIMID"/></U><InteractiveCreativeFile apiFramework="SIMID"/>', {}),
    "<Ad conditionalAd= x/>": ("<Ad x/>".replace(" x", " x"), {"VAST-4.0-conditionalad": 1}),
    '<Ad  \t conditionalAd="true" conditionalAd=\'no\' id="1"/>': ('<Ad id="1"/>', {"VAST-4.0-conditionalad": 1}),
    '<Ad conditionalAd="open': ("<Ad", {"VAST-4.0-conditionalad": 1}),
}


@pytest.mark.parametrize("text", REPAIRED)
def test_repaired_texts(text):
    assert fix.repaired(text) == REPAIRED[text]


def test_repairs_of_frames_and_urls_as_parsed(spark):
    xml = (
        '<VAST><Ad><InLine><Impression>http://a</Impression><Creatives><Creative><NonLinearAds><NonLinear apiFramework="simid"><IFrameResource type="t">http://b</IFrameResource>'
        "<StaticResource>http://c</StaticResource></NonLinear></NonLinearAds><Linear><MediaFiles><MediaFile> HTTP://d</MediaFile></MediaFiles></Linear></Creative></Creatives></InLine></Ad></VAST>"
    )
    documents = spark.createDataFrame([("a", xml), ("b", xml[:-7])], "doc_id string, xml string")
    report = {(r.doc_id, r.rule_id): r.n for r in fix.fix_report(fix.fix(documents)).collect()}
    want = {"VAST-2.0-mediafile-https": 1, "VAST-2.0-tracking-https": 1, "SIMID-1.1-iframe-simid-url-https": 1, "SIMID-1.0-simid-apiframework-case": 1}
    assert report == {(d, k): n for d in "ab" for k, n in want.items()}
    hits = {r.doc_id: tuple(r)[1:] for r in fix.https_hits(verdicts.elements(verdicts.prepared(documents))).collect()}
    assert hits == {"a": (1, 1, 0, 1), "b": (1, 1, 0, 1)}
    left = fix.remaining(fix.fix(documents))
    assert not {r.rule_id for r in left.collect()} & set(want)


def test_repair_queries_see_every_document(spark):
    """Document by document from the texts themselves: a malformed one has a status and no repair."""
    ready = verdicts.prepared(corpus.ad_corpus(spark, "/root/testdata/sf0.001")).select("doc_id", "xml").collect()

    def parses(xml):
        try:
            ElementTree.fromstring(xml)
        except ElementTree.ParseError:
            return False
        return True

    insecure = {r.doc_id: r.xml.lower().count("http://") for r in ready if parses(r.xml) and "http://" in r.xml.lower()}
    assert any("http://" in r.xml and not parses(r.xml) for r in ready)
    assert {r.doc_id: r.n for r in jobs.https_upgrades(spark, "/root/testdata/sf0.001").collect()} == insecure
    assert [tuple(r) for r in jobs.fix_report(spark, "/root/testdata/sf0.001").collect()] == [("VAST-2.0-mediafile-https", len(insecure), sum(insecure.values()))]
    versions = jobs.detected_versions(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n for r in versions) == len(ready) and sum(r.n for r in versions if r.input_status == "malformed") == sum(not parses(r.xml) for r in ready)


def test_values(spark):
    uris = {"https://a.com/x": True, "https://[DOMAIN]/x": False, "https://a.com/[X]": True, "a.com": False, "data:x": True, "about:blank": True, "mailto:a": True, "http://": False}
    rows = spark.createDataFrame(list(uris.items()), "u string, want boolean").filter(values.is_uri_like(F.col("u")) != F.col("want"))
    assert rows.count() == 0
    callers = spark.createDataFrame([(" a ", "a"), (None, "anonymous"), ("b c", "anonymous"), ("x" * 65, "anonymous")], "c string, want string")
    assert callers.filter(values.normalize_caller(F.col("c")) != F.col("want")).count() == 0


def test_result_documents(spark, documents):
    rows, findings = verdicts.validate(documents.filter("doc_id = 'duration'"))
    body = json.loads(io.result_document(rows, findings).collect()[0].json)
    issue = body["issues"][0]
    assert list(body) == ["document_type", "version", "input_status", "issues", "summary"] and body["summary"] == {"errors": 1, "warnings": 0, "infos": 0, "valid": False}
    assert (body["version"], body["input_status"], issue["id"], issue["spec_ref"]) == ("4.2", "supported", "VAST-2.0-duration-format", "IAB VAST 2.0 §2.3.5.1")
    line = json.loads(io.ndjson_document(rows, findings).collect()[0].json)
    assert list(line) == ["file", "document_type", "version", "valid", "summary", "issues"] and line["summary"] == {"errors": 1, "warnings": 0, "infos": 0}
    assert (line["file"], line["version"], line["valid"], line["issues"]) == ("duration", "4.2", False, body["issues"])
    rows, findings = verdicts.validate(documents.filter("doc_id = 'root'"))
    assert json.loads(io.result_document(rows, findings).collect()[0].json)["version"] is None and json.loads(io.ndjson_document(rows, findings).collect()[0].json)["version"] == "unknown"


def test_detection(spark):
    got = detect.inspect(spark.createDataFrame([("a", CLEAN)], "doc_id string, xml string")).collect()[0]
    assert (got.ad_type, got.ad_system, got.duration, got.impressions, got.trackings) == ("InLine", "acme", "00:00:30", 1, 1)
    assert tallies.gap_check(*[spark.range(k).withColumnRenamed("id", "event_id") for k in (5, 4, 3)]).collect()[0].lost == 1


NAMESPACE = "http://www.iab.net/videosuite/vmap"
#: name -> (document, findings that it must have among others: rule, path, line and column or None)
PLACES = {
    "playlist": (
        f'<VMAP version="1.0" xmlns:v="{NAMESPACE}"><AdBreak timeOffset="start" breakType="display" repeatAfter="00:00:10"><AdSource><VASTAdData><VAST version="2.0"><Ad><InLine/></Ad></VAST></VASTAdData></AdSource><AdSource/></AdBreak></VMAP>',
        [
            ("VMAP-1.0-repeatafter-conflict", "/VMAP/AdBreak[0][@repeatAfter]", None),
            ("VMAP-1.0-display-break-no-companions", "/VMAP/AdBreak[0]/AdSource/VASTAdData", None),
            ("VMAP-1.0-embedded-vast-version", "/VMAP/AdBreak[0]/AdSource/VASTAdData/VAST[@version]", None),
            ("VMAP-1.0-adbreak-multiple-adsource", "/VMAP/AdBreak[0]/AdSource[1]", None),
            ("VAST-2.0-inline-impression", "/VMAP/AdBreak[0]/AdSource/VASTAdData/VAST/Ad[0]/InLine", None),
        ],
    ),
    "vendors": (
        CLEAN.replace("<Creatives>", '<AdVerifications><Verification vendor="a.com-omid"/><Verification vendor=" A.com-omid"/></AdVerifications><Creatives>'),
        [("VAST-4.1-verification-duplicate-vendor", "/VAST/Ad[0]/InLine/AdVerifications/Verification[1]", None)],
    ),
    "vpaid": (
        CLEAN.replace("<MediaFile ", '<InteractiveCreativeFile apiFramework="simid" type="text/html">https://a.com</InteractiveCreativeFile><MediaFile apiFramework="VPAID" delivery="progressive"/><MediaFile apiFramework="vpaid" '),
        [
            ("VAST-4.1-vpaid-in-interactive-context", "/VAST/Ad[0]/InLine/Creatives/Creative[0]/Linear/MediaFiles/MediaFile[0]", None),
            ("VAST-4.1-vpaid-in-interactive-context", "/VAST/Ad[0]/InLine/Creatives/Creative[0]/Linear/MediaFiles/MediaFile[1]", None),
            ("SIMID-1.0-simid-apiframework-case", "/VAST/Ad[0]/InLine/Creatives/Creative[0]/Linear/MediaFiles/InteractiveCreativeFile[0]", None),
            ("SIMID-1.0-simid-interactive-start", "/VAST/Ad[0]/InLine/Creatives/Creative[0]/Linear/TrackingEvents", None),
        ],
    ),
    "events": (
        CLEAN.replace('event="start"', 'event="x"').replace("</TrackingEvents>", '<Tracking event="skip"><![CDATA[https://a.com/t]]></Tracking></TrackingEvents>'),
        [
            ("VAST-4.1-tracking-event-value", '/VAST/Ad[0]/InLine/Creatives/Creative[0]/Linear/TrackingEvents/Tracking[0][@event="x"]', None),
            ("VAST-3.0-skip-event-no-skipoffset", "/VAST/Ad[0]/InLine/Creatives/Creative[0]/Linear/TrackingEvents", None),
        ],
    ),
    "child": ('<VAST version="2.0">\n<Ad>\n <InLine><AdTitle>t</AdTitle>\n  <Odd/></InLine></Ad></VAST>', [("VAST-2.0-inline-unknown-child", "/VAST/Ad[0]/InLine/Odd", (4, 3))]),
    "empty id": (CLEAN.replace("<AdServingId>s", "<AdServingId>"), [("VAST-4.1-ad-serving-id-empty", "/VAST/Ad[0]/InLine/AdServingId", None)]),
    "audio": ('<DAAST version="1.1"><Error/><Error/></DAAST>', [("DAAST-1.0-error-url-empty", "/DAAST/Error[1]", None)]),
    "lower case": ('\\n<vast version=\\"2.0\\"></vast>', [("VAST-2.0-json-escaped", None, None), ("VAST-2.0-root-element", "/", (2, 1))]),
}


def test_findings_name_their_places(spark):
    rows = spark.createDataFrame([(k, x) for k, (x, _) in PLACES.items()], "doc_id string, xml string")
    found = verdicts.validate(rows)[1].collect()
    for name, (_, want) in PLACES.items():
        own = [r for r in found if r.doc_id == name]
        for rule, path, place in want:
            hits = [r for r in own if r.rule_id == rule and r.path == path and (place is None or (r.line, r.col) == place)]
            assert len(hits) == 1, (name, rule, path, [(r.rule_id, r.path, r.line, r.col) for r in own])
    assert all(r.spec_ref for r in found)


def test_policies_decide_verdicts(spark):
    rows = spark.createDataFrame([("a", "p", CLEAN.replace("00:00:30", "30s")), ("b", None, CLEAN.replace("00:00:30", "30s"))], "doc_id string, policy_id string, xml string")
    policy = spark.createDataFrame([("p", "VAST-2.0-duration-format", "warning"), ("p", "VAST-2.0-duration-format", "zzz")], "policy_id string, rule_id string, level string")
    got = {r.doc_id: (r.errors, r.warnings, r.valid) for r in verdicts.verdicts_of(rows, policy).collect()}
    assert got == {"a": (0, 1, True), "b": (1, 0, False)}
    # an unknown level alone changes nothing; of two levels the strictest counts
    for levels, want in ((["zzz"], (1, 0)), (["aaa", "info"], (0, 0)), (["off", "warning"], (0, 1)), (["off"], (0, 0))):
        policy = spark.createDataFrame([("p", "VAST-2.0-duration-format", x) for x in levels], "policy_id string, rule_id string, level string")
        assert {(r.errors, r.warnings) for r in verdicts.verdicts_of(rows.filter("doc_id = 'a'"), policy).collect()} == {want}
        assert sum(r.severity == "error" for r in verdicts.apply_policy(verdicts.validate(rows.filter("doc_id = 'a'"))[1], policy).collect()) == want[0]


def test_policies_are_checked(spark):
    rows = [("p", "VAST-2.0-no-such", "off", 5), ("p", "VAST-2.0-duration-format", "zzz", 300), ("q", "VAST-2.0-duration-format", "off", 0), ("r", "VAST-1.0-none", None, None)]
    policy = spark.createDataFrame(rows, "policy_id string, rule_id string, level string, max_wrapper_depth int")
    found = {r.policy_id: (r.unknown_rules, r.bad_levels, r.bad_depth) for r in verdicts.check_policy(policy, rule_catalog(spark)).collect()}
    assert found == {"p": (["VAST-2.0-no-such"], ["zzz"], 300), "r": (["VAST-1.0-none"], ["null"], None)}
    with pytest.raises(ValueError, match="unknown rule IDs: VAST-1.0-none, VAST-2.0-no-such"):
        verdicts.check_policy(policy, rule_catalog(spark), strict=True)
    with pytest.raises(ValueError, match="300 exceeds the maximum of 255"):
        verdicts.check_policy(spark.createDataFrame([("p", "VAST-2.0-duration-format", "off", 300)], policy.schema), rule_catalog(spark), strict=True)
    assert verdicts.check_policy(policy.filter("policy_id = 'q'"), rule_catalog(spark), strict=True).count() == 0


def test_inspection_takes_the_last_value(spark):
    xml = '<VAST version="2.0"><Ad><InLine><AdSystem>one</AdSystem><AdSystem>two</AdSystem><!-- <Impression>x</Impression> --><x:Impression xmlns:x="u">i</x:Impression><Creatives><Creative><Linear><Duration><![CDATA[00:00:10]]></Duration></Linear></Creative></Creatives></InLine></Ad></VAST>'
    got = detect.inspect(spark.createDataFrame([("a", xml)], "doc_id string, xml string")).collect()[0]
    assert (got.ad_system, got.impressions, got.duration) == ("two", 0, "00:00:10")
    # up to the error, where there is one
    broken = '<VAST version="2.0"><Ad><InLine><AdSystem>one</AdSystem><AdSystem>two</AdSystem><Impression>x</Impression><Impression/></Foo><Impression>y</Impression>'
    rows = spark.createDataFrame([("a", broken), ("b", "no markup"), ("c", "<VAST><Ad><Wrapper><VASTAdTagURI>u</VASTAdTagURI>")], "doc_id string, xml string")
    got = {r.doc_id: (r.ad_type, r.ad_system, r.impressions, r.wrapper_uri) for r in detect.inspect(rows).collect()}
    assert got == {"a": ("InLine", "two", 1, None), "b": (None, None, 0, None), "c": ("Wrapper", None, 0, "u")}
    # rules leave such elements out
    assert [r.rule_id for r in verdicts.validate(rows.filter("doc_id = 'a'"))[1].collect()] == ["VAST-2.0-parse-error"]


def test_messages_become_verdicts_or_errors(spark, documents, validated, tmp_path):
    shape = "request_id string, document string, wrapper_depth int, max_wrapper_depth int, forced_version string, rule_overrides map<string,string>, hit int, first int"
    messages = spark.createDataFrame([(k, x, None, 0, None, None, 1, 2) for k, (x, _) in CASES.items()], shape)
    more = [
        ("deep", CLEAN, 256, 0, None, None), ("deeper", CLEAN, 0, 999, None, None), ("version", CLEAN, 0, 0, "9.9", None), ("rules", CLEAN, 0, 0, None, {"Z": "off", "A": "off"}),
        ("level", CLEAN, 0, 0, None, {"VAST-2.0-duration-format": "zzz"}), ("large", "<" * (4 << 20) + "<", 0, 0, None, None), ("chain", CLEAN, 6, 0, None, None),
        ("silent", CLEAN.replace("00:00:30", "30s"), 0, 0, None, {"VAST-2.0-duration-format": "off"}), ("soft", CLEAN.replace("00:00:30", "30s"), 0, 0, None, {"VAST-2.0-duration-format": "info"}),
        ("clean", CLEAN, 0, 0, "3.0", None), (None, None, None, None, None, None),
    ]
    more = spark.createDataFrame([(*m, 1, 2) for m in more], shape)
    messages.unionByName(more).repartition(3).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        batch = streaming.validate_messages(spark.read.parquet(str(tmp_path / "in"))).collect()
        stream = streaming.validate_messages(io.stream_documents(spark, str(tmp_path / "in"), shape))
        query = stream.writeStream.format("memory").queryName("all_verdicts").trigger(availableNow=True).start()
        query.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda r: json.dumps(r.asDict(True), sort_keys=True)
    assert sorted(map(key, spark.table("all_verdicts").collect())) == sorted(map(key, batch)) and len(batch) == len(CASES) + 11
    errors = {r.request_id: (r.error.code, r.error.message) for r in batch if r.error}
    assert set(errors) == {"deep", "deeper", "version", "rules", "level", "large"} and all((r.verdict is None) == (r.error is not None) for r in batch)
    assert errors["deep"] == (3, "wrapper_depth 256 exceeds the maximum of 255") and errors["rules"] == (3, "unknown rule IDs in rule_overrides: A, Z") and errors["large"][0] == 11
    fine = [r for r in batch if r.request_id in CASES and r.verdict and not (r.request_id == "clean" and r.verdict.version.declared == "3.0")]
    assert {r.request_id: (r.verdict.errors, r.verdict.warnings, r.verdict.infos, r.verdict.valid) for r in fine} == {r.doc_id: (r.errors, r.warnings, r.infos, r.valid) for r in validated[0]}
    own = {r.request_id: r.verdict for r in batch if r.verdict and r.request_id not in CASES}
    assert [f.rule_id for f in own["chain"].findings] == ["VAST-2.0-wrapper-depth"] and own["silent"].findings == [] and own["soft"].valid and [f.severity for f in own["soft"].findings] == ["info"]
    assert [f.rule_id for f in own[None].findings] == ["VAST-2.0-parse-error"]


def test_late_events_are_set_apart(spark, tmp_path):
    source = tmp_path / "source"
    rows = [[(1, 100_000), (2, 200_000)], [(3, 150_000), (4, 300_000), (5, 139_999)], [(6, 240_000), (7, 239_999), (8, 10)]]
    kept = []
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, "event_id long, occurred_at_ms long").coalesce(1).write.mode("append").parquet(str(source))
        query = streaming.count_late(io.stream_documents(spark, str(source), "event_id long, occurred_at_ms long"), 60_000, str(tmp_path / "out"), lambda df, n: kept.extend(r.event_id for r in df.collect()))
        query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        assert k == len(rows) - 1 or len(kept) >= k
    late = [r.event_id for r in spark.read.schema("event_id long, occurred_at_ms long, batch long").parquet(str(tmp_path / "out" / "late")).collect()]
    assert sorted(late) == [5, 7, 8] and sorted(kept) == [1, 2, 3, 4, 6]
    stored = spark.createDataFrame([(k, t) for k, b in enumerate(rows) for _, t in b], "batch int, occurred_at_ms long")
    assert sorted(tuple(r) for r in tallies.late_report(stored, "batch", 60_000).collect()) == [(0, 2, 0), (1, 3, 1), (2, 3, 2)]


def test_windows_run_as_streams(spark, tmp_path):
    events = corpus.verdict_events(spark, "/root/testdata/sf0.001")
    events.write.parquet(str(tmp_path / "e"))
    stream = streaming.dedupe_events(streaming.event_time(io.stream_documents(spark, str(tmp_path / "e"), events.schema), "400 days"))
    batch = events.withColumn("ts", F.timestamp_millis("occurred_at_ms")).dropDuplicates(["event_id"])
    for name, make in (("verdicts", streaming.windowed_verdicts), ("rates", streaming.windowed_error_rate), ("revenue", lambda e: streaming.windowed_revenue(e, sorted(REVENUE)))):
        query = make(stream).writeStream.format("memory").outputMode("complete").queryName(f"windowed_{name}").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert sorted(map(str, spark.table(f"windowed_{name}").collect())) == sorted(map(str, make(batch).collect()))
    tops = []
    query = streaming.windowed_rules(stream, "1 day").writeStream.outputMode("complete").foreachBatch(lambda df, _: tops.extend(map(str, streaming.top_of_windows(df, 2).collect()))).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert set(map(str, streaming.top_of_windows(streaming.windowed_rules(batch, "1 day"), 2).collect())) <= set(tops)


def test_quantiles_by_rank(spark):
    rows = [(k % 3, float((k * 7919) % 1000) ** 3 / 7) for k in range(500)] + [(7, 2.5)] * 4 + [(8, -1.0), (8, 3.0), (9, None)]
    log = spark.createDataFrame(rows, "concurrency int, seconds double").selectExpr("*", "'ok' as status")
    wanted = (0.0, 0.25, 0.5, 0.99, 1.0)
    got = {(r.concurrency, r["quantile"]): r.x for r in tallies.quantiles(log, "concurrency", "seconds", wanted).collect()}
    want = {(r.concurrency, q): v for q in wanted for r in log.filter("seconds is not null").groupBy("concurrency").agg(F.percentile("seconds", F.lit(q)).alias("v")).collect() for v in [r.v]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert tallies.quantiles(log.filter("false"), "concurrency", "seconds", wanted).count() == 0


def test_many_siblings_are_read_in_time(spark):
    many = '<VAST version="4.2"><Ad><InLine><Creatives><Creative><Linear><MediaFiles>' + '<MediaFile apiFramework="VPAID"/>' * 99_000 + "</MediaFiles></Linear></Creative></Creatives></InLine></Ad></VAST>"
    vendors = '<VAST version="4.2"><Ad><InLine><AdVerifications>' + "".join(f'<Verification vendor="v{k}"/>' for k in range(49_000)) * 2 + "</AdVerifications></InLine></Ad></VAST>"
    began = time.time()
    for text, rows in ((many, 99_007), (vendors, 98_004)):
        out = shred._Rows()
        out.add(("x", None, None, False, None, 0, 5, None), *shred.parse(text))
        batch = out.batch()
        assert batch.num_rows == rows
    assert sum(m is not None and dict(m).get("#again") == "1" for m in batch.column("facts").to_pylist()) == 49_000
    assert time.time() - began < 20


def test_table_function_equals_the_shredder(spark, documents):
    shred.register_shred_xml(spark)
    documents.createOrReplaceTempView("texts")
    columns = ["doc_id", "node_id", "parent_id", "depth", "name", "name_idx", "text", "line", "col", "attr"]
    got = spark.sql("select d.doc_id, e.* from texts d, lateral shred_xml(d.xml) e").select(columns)
    want = shred.shred(documents).filter("name <> '__empty__'").select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_extension_bindings(spark):
    doc = planted.ADDENDUM.text.replace("{k}", "1")
    nodes = verdicts.elements(verdicts.prepared(spark.createDataFrame([("a", doc.strip()), ("b", doc.strip().replace('creativeId="c1"', ""))], "doc_id string, xml string")))
    rows = {(r.doc_id, r.kind): (r.status, r.target_name, r.playable) for r in detect.bind_ctv_extensions(nodes).collect()}
    assert rows[("a", "UniversalAdId")] == ("matched", "Creative", False) and rows[("b", "UniversalAdId")][0] == "first" and rows[("a", "InteractiveCreativeFile")] == ("matched", "MediaFile", True)
    text = planted.PORTFOLIO.text.replace("{k}", "1").strip()
    nodes = verdicts.elements(verdicts.prepared(spark.createDataFrame([("a", text), ("b", text.replace("<CreativeId>c2", "<CreativeId>c9")), ("c", text.replace("<CreativeId>c2</CreativeId>", ""))], "doc_id string, xml string")))
    assert {r.doc_id: (r.status, r.creatives, r.native) for r in detect.bind_portfolio(nodes).collect()} == {"a": ("matched", 2, False), "b": ("unmatched", 2, False), "c": ("unnamed", 2, False)}


def test_events_round_trip_and_evolve(spark, documents, tmp_path):
    rows, findings = verdicts.validate(documents)
    stamped = verdicts.stamp_provenance(rows.drop("caller"), "1", verdicts.catalog_digest(rule_catalog(spark)).first().digest, "2")
    received = documents.selectExpr("doc_id", "'c' as caller", "timestamp '2024-01-01 00:00:00' as received_at")
    events = io.validation_events(stamped, findings, received)
    events.write.parquet(str(tmp_path / "events"))
    query = io.write_events(io.stream_documents(spark, str(tmp_path / "events"), events.schema), str(tmp_path / "json"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    back = io.read_events(spark, str(tmp_path / "json"))
    assert sorted(map(str, back.collect())) == sorted(map(str, spark.read.parquet(str(tmp_path / "events")).select(back.columns).collect()))

    def read(*lines):
        path = tmp_path / f"lines{len(list(tmp_path.iterdir()))}"
        path.mkdir()
        (path / "x.json").write_text("\n".join(lines))
        return io.read_events(spark, str(path)).collect()

    old, new = read('{"event_id":"a","occurred_at_ms":1,"document_type":"VAST","valid":true}', '{"event_id":"b","occurred_at_ms":2,"document_type":"HTML","valid":false,"errors":1,"later":{"x":1},"findings":[{"rule_id":"r","severity":"FATAL","weight":3}]}')
    assert (old.errors, old.findings, old.caller) == (0, [], None) and (new.document_type, new.findings[0].severity) == ("UNKNOWN", "UNKNOWN")
    for bad in ('{"occurred_at_ms":1}', '{"event_id":"a"}', '{"event_id":"a","occurred_at_ms":"soon"}', '{"event_id":"a","occurred_at_ms":1,"findings":"none"}', "not json"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            read(bad)
    schema = T.StructType.fromDDL
    now = schema(io.EVENT_SCHEMA)
    assert io.compatible(schema("event_id string, errors int"), now) == [] and io.compatible(schema("event_id string, errors smallint"), now) == []
    assert io.compatible(schema("event_id long"), now) == ["event_id is bigint, not string"] and io.compatible(schema("caller string"), schema("event_id string not null")) == ["event_id is required and missing"]
    assert io.compatible(schema("findings array<struct<rule_id:int>>"), now) == ["findings: rule_id is int, not string"]


def test_files_summaries_and_catalogs(spark, documents, tmp_path):
    (tmp_path / "good.xml").write_text(CLEAN)
    (tmp_path / "bad.xml").write_bytes(b"<VAST>\xff</VAST>")
    assert {r.doc_id.rpartition("/")[2]: (r.xml, r.valid_utf8) for r in io.read_ad_files(spark, str(tmp_path / "*.xml"), binary=True).collect()} == {"good.xml": (CLEAN, True), "bad.xml": (None, False)}
    assert {r.doc_id.rpartition("/")[2] for r in io.read_ad_files(spark, str(tmp_path / "*.xml")).collect()} == {"good.xml", "bad.xml"}
    rows, findings = verdicts.validate(documents)
    top = tallies.top_rules(findings, 3)
    body = json.loads(io.corpus_summary_json(tallies.corpus_summary(rows), top, sorted(REVENUE)).first().value)["summary"]
    assert body["total_inputs"] == len(CASES) and [t["id"] for t in body["top_rules"]] == [r.rule_id for r in top.collect()]
    fixed = fix.fix(documents)
    io.write_fixed(fixed, fix.remaining(fixed), str(tmp_path / "fixed"))
    assert {r.doc_id: r.remaining for r in spark.read.parquet(str(tmp_path / "fixed")).collect()}["duration"] == {"VAST-2.0-duration-format": 1}
    assert verdicts.gate(rows).first().passed is False and verdicts.gate(rows, no_fail=True).first().passed and verdicts.gate(rows.filter("errors = 0"), fail_on_warning=True).first().passed is False
    digest = verdicts.catalog_digest(rule_catalog(spark)).first().digest
    assert digest == verdicts.catalog_digest(rule_catalog(spark).repartition(4)).first().digest and len(digest) == 71
    described = rule_catalog(spark).filter("ordinal > 0").selectExpr("rule_id", "case when ordinal = 1 then 'none' else default_severity end as severity").unionByName(spark.createDataFrame([("X", "info")], "rule_id string, severity string"))
    assert sorted(r.status for r in verdicts.catalog_vs_docs(rule_catalog(spark), described).collect()) == ["extra", "missing", "severity"]
    assert find_rule(spark, "VAST-2.0-parse-error").count() == 1 and rule_catalog(spark, ["IAB VMAP"]).count() == 25
    left, right = findings.filter("doc_id <> 'zero'"), findings.filter("doc_id <> 'duration'")
    assert sorted((r.side, r.doc_id) for r in verdicts.diff_findings(left, right).collect()) == [("left", "duration"), ("right", "zero")]
    masked = documents.filter("doc_id = 'clean'").select(detect.mask_templates(F.col("xml"), r"a\.com").alias("x")).first().x
    assert "a.com" not in masked and detect.PLACEHOLDER_URL in masked
    policies = tmp_path / "policies"
    policies.mkdir()
    (policies / "p.csv").write_text("policy_id,rule_id,level\np,r, OFF \n")
    assert [tuple(r) for r in io.read_policies(spark, str(policies)).collect()] == [("p", "r", "off")]
    table = documents.selectExpr("*", "0 as max_wrapper_depth")
    table.write.parquet(str(tmp_path / "table"))
    assert {r.max_wrapper_depth for r in io.read_ad_table(spark, str(tmp_path / "table")).collect()} == {5}


@pytest.mark.parametrize("sheet", planted.SHEETS.values(), ids=lambda s: s.name)
def test_sheets_are_clean_without_their_plants(spark, sheet):
    lines = sheet.text.strip("\n").split("\n")
    assert all(1 <= n <= len(lines) for p in sheet.plants for n in p.lines)
    rows = spark.createDataFrame([("a", "\n".join(lines).replace("{k}", "1"))], "doc_id string, xml string")
    assert [(r.rule_id, r.path) for r in verdicts.validate(rows)[1].collect()] == []


def test_named_elements_are_those_of_the_whole_table(spark):
    """Elements of some names, and roots where asked for, are the rows that the whole table has of them."""
    documents = corpus.ad_corpus(spark, "/root/testdata/sf0.001").filter("cast(doc_id as long) < 300")
    columns = [c for c in shred.NODE_SCHEMA.names if c not in ("attr", "facts", "kids", "grand")]
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    whole = shred.shred(documents)
    assert rows(shred.shred(documents, names=["Tracking"], roots=False)) == rows(whole.filter("name = 'Tracking'"))
    assert rows(shred.shred(documents, names=["Ad"])) == rows(whole.filter("name = 'Ad' or node_id = 0"))


def test_texts_of_the_corpus_are_not_shuffled(spark):
    """Only the tables' short rows are dealt out; nothing is shuffled once there are texts."""
    plan = corpus.ad_corpus(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert shuffles and all("REPARTITION_BY_NUM" in line for line in shuffles)
    assert "l_extendedprice" not in plan


def test_detection_is_one_projection(spark):
    """Each projection over the elements copies their wide rows."""
    documents = spark.createDataFrame([("a", "<VAST/>")], "doc_id string, xml string")
    plan = verdicts.elements(documents)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert above.count("Project [") == 1


def test_planted_documents_are_dealt_to_all_cores(spark):
    """The keys of very many documents fit a file of one part."""
    documents = planted.planted_documents(spark, "/root/testdata/sf0.001", next(iter(planted.SHEETS.values())))
    assert documents.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
