"""Plain documents taken apart all at once, and kinds of elements whose URLs differ in digits."""

import pyarrow as pa
import pytest

from adlint_spark.operators import chains, detect, verdicts
from adlint_spark.operators.rules import run_rules
from adlint_spark.sources import planted, shred
from tests.test_kinds import OTHER, PLAIN

AD = (
    '<VAST version="4.2"><Ad id="{k}" sequence="1"><InLine><AdSystem version="1">acme</AdSystem><AdServingId>s</AdServingId><Impression><![CDATA[https://a{k}.example.com/i/{k}?c=[{m}]]]></Impression>'
    "<Creatives><Creative><Linear skipoffset='10%'><Duration>00:00:30</Duration><TrackingEvents><Tracking event='start'> https://b.example.com:{k}/ </Tracking></TrackingEvents>"
    "<MediaFiles><MediaFile delivery='progressive' type='video/mp4' width='1' height='1'>\n<![CDATA[http://c.example.com/]]><![CDATA[{k}]]></MediaFile></MediaFiles></Linear></Creative></Creatives></InLine></Ad></VAST>"
)
OWN = (None, None, False, None, 0, 5, None)


@pytest.mark.parametrize("text", ["<a><![CDATA[x> y</a>", "<a><![CDATA[></a>", "<a><b/><![CDATA[]]]>"])
def test_sections_left_open_are_no_plain_documents(text):
    assert shred.parse_plain(text, {}) is None and shred.parse(text)[0].error


def test_documents_taken_apart_at_once_have_the_rows_of_each():
    texts = [*PLAIN, *OTHER, "", "[CDATA[<a/>", *(AD.replace("{k}", str(k)) for k in range(5)), *(s.text.strip().replace("{k}", "7") for s in planted.SHEETS.values())]
    whole = AD.replace("{k}", "3")
    for n, piece in enumerate(("<x>", "</x>", "<x:y/>", "<![CDATA[ z ]]>", "<![CDATA[", "]]>", "&", "é", "<", ">", " \n", "w")):
        texts += [whole[:k] + piece + whole[k:] for k in range(n, len(whole), 9)]
    column = pa.array(["<skipped/>", *texts]).slice(1)
    found, known = shred._Plain(column, {}), {}
    once, each = shred._Rows(), shred._Rows()
    once.add_plain([(str(i), *OWN) for i in range(len(texts))], found)
    assert sorted([*found.documents, *found.left]) == list(range(len(texts))) and len(found.documents) > 120
    for i in found.documents.tolist():
        each.add((str(i), *OWN), *shred.parse_plain(texts[i], known))
    assert not each.facts and not each.payloads and not each.vendors
    assert once.batch().to_pylist() == each.batch().to_pylist()


def test_urls_that_differ_in_digits_are_of_one_kind(spark):
    texts = [AD.replace("{k}", str(k)).replace("{m}", m) for k in range(10, 40) for m in ("CACHEBUSTING", f"M{k}", "cachebusting")]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id string, xml string").coalesce(1)
    kinds = shred.shred(documents, kinds=True)
    assert kinds.filter("name in ('Impression', 'Tracking', 'MediaFile')").count() == 5
    rows = lambda nodes: sorted(map(repr, run_rules(nodes).collect()))
    ready = verdicts.prepared(documents)
    each = rows(verdicts.elements(ready))
    assert each == rows(verdicts.kinds(ready)) and len(each) > 100


def test_digits_of_encoded_characters_count():
    texts = pa.array(["https://a1.b/%5breason%5d", "https://a1.b/%4breason%4d", "https://a1.b/2", "https://a3.b/4", "00:00:30", "http://a9.b/2"])
    alike = shred._digits_alike(texts, [True] * 6).to_pylist()
    assert alike == [*texts.to_pylist()[:2], "https://a0.b/0", "https://a0.b/0", "00:00:30", "http://a0.b/0"]


def test_a_document_is_one_row_before_it_is_shuffled_for_inspection(spark):
    ad = "<Ad><InLine><AdSystem>a</AdSystem><AdTitle>{}</AdTitle><Impression>u</Impression><Impression/><Creatives/></InLine></Ad>"
    texts = [f"<VAST>{ad.format('x')}{ad.format('')}</VAST>", "", None, "<VAST><Ad><Wrapper><VASTAdTagURI>u</VASTAdTagURI><AdTitle/>", "<VMAP><AdBreak><AdSource><VASTAdData><VAST><Ad><InLine/></Ad></VAST></VASTAdData></AdSource></AdBreak></VMAP>", "<Tracking>x</Tracking>"] * 2
    documents = spark.createDataFrame([(str(min(i, 10)), x) for i, x in enumerate(texts)], "doc_id string, xml string").coalesce(1)
    rows = shred.shred(documents, names=detect._INSPECTED, summed=(detect._inspected, detect._INSPECTED_TYPE))
    assert rows.count() == len(texts)
    found = {r.pop("doc_id"): tuple(r.values()) for r in (x.asDict() for x in detect.inspect(documents).collect())}
    assert len(found) == 11
    assert found["0"] == ("InLine", "a", "x", None, 2, 0, 0, None) == found["6"]
    assert found["1"] == found["2"] == (None, None, None, None, 0, 0, 0, None)
    assert found["3"] == ("Wrapper", None, None, None, 0, 0, 0, "u") and found["4"][0] is None and found["5"][5] == 1
    assert found["10"] == (None, None, None, None, 0, 1, 0, None)


def test_last_hops_are_told_without_a_shuffle(spark):
    tag = "<VAST><Ad><Wrapper><VASTAdTagURI>{}</VASTAdTagURI></Wrapper></Ad></VAST>"
    responses = spark.createDataFrame([*((f"u{i}", tag.format(f"u{i + 1}")) for i in range(9)), ("e", "<VAST/>"), ("b", tag.format(" ")), ("d", tag.format("gone")), ("s", tag.format("s"))], "url string, xml string")
    roots = spark.createDataFrame([(f"r{i}", f"u{i}") for i in range(9)] + [(f"q{u}", u) for u in ("e", "b", "d", "s", "gone")], "root_id string, url string")
    hops = chains.resolve_chains(roots, responses).localCheckpoint()
    deepest = {r["root_id"]: r["d"] for r in hops.groupBy("root_id").agg({"depth": "max"}).toDF("root_id", "d").collect()}
    found = chains.last_hops(hops).select("root_id", "depth").collect()
    assert len(found) == len(deepest) == 14 and {r["root_id"]: r["depth"] for r in found} == deepest
