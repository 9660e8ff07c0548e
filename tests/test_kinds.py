"""Elements by kind, and the parse of plain documents."""

import pytest

from adlint_spark.operators import verdicts
from adlint_spark.operators.rules import run_rules
from adlint_spark.sources import corpus, planted, shred

DATA = "/root/testdata/sf0.001"
PLAIN = [
    "<a/>", " <a/> ", "<a></a>\n\n", "<a> x <b/> y </a>", "<a><![CDATA[]]></a>", "<a><![CDATA[x]]>y<![CDATA[<b>]]></a>", "<a\n b='1'\n>\nx\n</a\n>", "<a>x>y</a>", "<a x=\"it's\"/>",
    "<a:b xmlns:a='u' a:x='1' x='2'/>", "<a x=''/>", "<a>" * 128 + "</a>" * 128,
]
OTHER = [
    "", "<a>", "<a></b>", "<a x='1' x='2'/>", "<a>&amp; x</a>", "<a>é</a>", "x<a/>", "<a/>x", "<a/><b/>", "<a>\r\n</a>", "<a b='x>y'/>", '<a b="x\ty"/>', "<a>]]></a>", "<a><!-- c -->x</a>", '<?xml version="1.0"?><a/>',
    "<a><", "<a>\x01</a>", "<!DOCTYPE a><a/>", "<a b='&lt;'/>", "<1/>", "<a b='x'c='y'/>", "< a/>", "<a>x</ a>", "<![CDATA[x]]><a/>", "<a>" * 129 + "</a>" * 129,
]


def _told(parsed):
    tree, data = parsed
    return vars(tree), data


@pytest.mark.parametrize("text", PLAIN)
def test_plain_documents_are_parsed_alike(text):
    known = {}
    assert _told(shred.parse_plain(text, known)) == _told(shred.parse_plain(text, known)) == _told(shred.parse(text))


@pytest.mark.parametrize("text", OTHER)
def test_other_documents_are_left_to_the_parser(text):
    assert shred.parse_plain(text, {}) is None


def _odd_documents(spark):
    sheets = [planted.planted_documents(spark, DATA, s).limit(60) for s in planted.SHEETS.values()]
    rows = corpus.ad_corpus(spark, DATA).filter("cast(doc_id as long) < 400").select("doc_id", "policy_id", "caller", "xml")
    for n, sheet in enumerate(sheets):
        rows = rows.unionByName(sheet.selectExpr(f"concat('{n}-', doc_id) as doc_id", "'p' as policy_id", "doc_id as caller", "xml"))
    twice = "<VAST><Ad id='{}'><InLine><Impression>{}</Impression><Impression>{}</Impression></InLine></Ad></VAST>"
    more = [(f"t{k}", "p", None, twice.format(k, *two)) for k, two in enumerate((("u", "u"), ("u", "v"), ("v", "v"), ("", ""), ("w", "u")))] + [("e", None, "c", ""), ("n", None, "c", None)]
    return rows.unionByName(spark.createDataFrame(more, rows.schema)).repartition(3, "doc_id").localCheckpoint()


def test_kinds_have_the_findings_of_all_elements(spark):
    documents = verdicts.prepared(_odd_documents(spark))
    rows = lambda nodes: sorted(map(repr, run_rules(nodes).collect()))
    each = rows(verdicts.elements(documents))
    assert each == rows(verdicts.kinds(documents)) and len(each) > 1000


def test_kinds_are_few_and_their_members_all_elements(spark):
    """Most elements are like those of other documents: rules look at a fraction."""
    documents = planted.planted_documents(spark, DATA, planted.ADDENDUM).coalesce(1)
    place = ["doc_id", "caller", "policy_id", "line", "col", "up_line", "up_col"]
    members = shred.shred(documents, kinds=True).selectExpr("node_id", "inline(members)")
    every = shred.shred(documents).filter("node_id > 0")
    assert sorted(map(repr, members.filter("node_id > 0").select(place).collect())) == sorted(map(repr, every.select(place).collect()))
    assert shred.shred(documents, kinds=True).count() * 10 < every.count()


def test_documents_of_one_shape_are_looked_at_once(monkeypatch):
    """What follows from a document's elements is found out once for its shape, and is the same."""
    texts = [planted.ADDENDUM.text.strip().replace("{k}", str(k)) for k in range(20)] + [planted.PORTFOLIO.text.strip().replace("{k}", str(k)) for k in range(20)]
    texts += [x.replace('creativeId="c1"', 'creativeId="c9"') for x in texts[:2]] + [x.replace("<CreativeId>c2", "<CreativeId>c9") for x in texts[20:22]]
    looked = []
    whole = shred._shape
    monkeypatch.setattr(shred, "_shape", lambda tree: looked.append(1) or whole(tree))

    def rows(shapes):
        out, known = shred._Rows(), {}
        for text in texts:
            out.add(("x", None, None, False, None, 0, 5, None), *shred.parse_plain(text, known), shapes)
        return out.batch().to_pylist()

    once = rows({})
    assert len(looked) == 4
    assert once == rows(None) and len(looked) == 4 + len(texts)
