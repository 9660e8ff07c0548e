"""Documents that differ in digits alone which no rule tells apart are parsed once."""

import pyarrow as pa

from adlint_spark.operators import verdicts
from adlint_spark.operators.rules import run_rules
from adlint_spark.sources import planted, shred

DATA = "/root/testdata/sf0.001"
AD = '<VAST version="4.2"><Ad id="{i}"><InLine><AdTitle>{t}</AdTitle><AdServingId>s{i}</AdServingId><Impression><![CDATA[https://a.b/{i}]]></Impression><Creatives><Creative><Linear><Duration>00:00:{d}</Duration></Linear></Creative></Creatives>{x}</InLine></Ad></VAST>'
OWN = ("d", None, None, False, None, 0, 5, None)


def _ad(i=10, t="Spring 10", d="30", x=""):
    return AD.format(i=i, t=t, d=d, x=x)


def _keys(*texts, own=OWN):
    # repeated, so that there is something to gain
    return shred._Alike().keys(pa.array([*texts] * 3), [own] * (3 * len(texts)))[: len(texts)]


def test_digits_that_no_rule_tells_apart_give_equal_keys(spark):
    from adlint_spark.operators.rules import required

    one, other = _keys(_ad(), _ad(i=99, t="Spring 55"))
    assert one is not None and one == other
    one, *others = _keys(_ad(), _ad(d="31"), _ad(i=9), _ad(x="<Error>https://a.b/%51</Error>"), _ad(t="Spring  9"))
    assert one not in others and None not in others
    for a, b in (("<Error>https://a.b/%51</Error>", "<Error>https://a.b/%52</Error>"), ('<Tracking a=">https://1">', '<Tracking a=">https://2">'), ("<AdTitle>ad 1</AdTitle>", "<AdTitle>ad 2</AdTitle>"), ("<AdTitle> ad 1 </AdTitle>", "<AdTitle> ad 2 </AdTitle>"), ('<Creative id="1"/>', '<Creative id="2"/>'), ("<Error>1</Error>", "<Error>2</Error>")):
        assert len(set(_keys(_ad(x=a), _ad(x=b)))) == 2, a
    assert _keys("", _ad(x="<Impression>u</Impression>"), _ad(x="<Error>&#49;</Error>"), "<VMAP/>") == [None] * 4
    assert not any(len(t) >= shred._TITLE_CHARS and any(c.isdigit() for c in t) for t in required.TITLES)
    assert shred._Alike().keys(pa.array([_ad(x="x" * k) for k in range(9)]), [OWN] * 9) == [None] * 9


def test_copies_have_the_findings_of_their_own(spark):
    texts = [_ad(i=i, t=t, d=d, x=x) for i in (10, 11, 205) for t in ("ad 1", "ad 2", "ad 10", "Spring 1") for d in ("00", "30", "77") for x in ("", "<Error>http://a.b/1?[M1]</Error>", "<Impression>https://a.b/10</Impression>", "\n<Bogus/>\n")]
    rows = [(f"{n}-{k}", f"c{k}", x) for k in range(4) for n, x in enumerate([*texts, None, "", "<VAST"])]
    documents = spark.createDataFrame(rows, "doc_id string, caller string, xml string")
    for name in ("content", "ctv_addendum", "playlist"):
        documents = documents.unionByName(planted.planted_documents(spark, DATA, planted.SHEETS[name]).selectExpr(f"concat('{name}', doc_id) as doc_id", "doc_id as caller", "xml"))
    documents = verdicts.prepared(documents.coalesce(1).localCheckpoint())
    found = lambda nodes: sorted(map(repr, run_rules(nodes).collect()))
    each = found(verdicts.elements(documents))
    assert each == found(verdicts.kinds(documents)) and len(each) > 2000


def test_documents_of_a_sheet_are_few_kinds(spark):
    documents = planted.planted_documents(spark, DATA, planted.SHEETS["content"]).coalesce(1)
    kinds = shred.shred(documents, kinds=True)
    assert kinds.count() * 25 < kinds.selectExpr("sum(size(members))").first()[0]


def test_documents_of_the_inline_sheet_are_parsed_once():
    texts = [planted.SHEETS["inline"].text.strip().replace("{k}", str(k)) for k in range(1000, 1050)]
    assert len(set(shred._Alike().keys(pa.array(texts), [OWN] * 50))) == 1


def test_documents_of_the_portfolio_sheet_are_parsed_once():
    texts = [planted.SHEETS["ctv_portfolio"].text.strip().replace("{k}", str(k)) for k in range(1000, 1050)]
    assert len(set(shred._Alike().keys(pa.array(texts), [OWN] * 50))) == 1


def test_what_if_looks_at_kinds(spark):
    from adlint_spark.sources import corpus

    documents = corpus.ad_corpus(spark, DATA).filter("cast(doc_id as long) < 300")
    changed = verdicts.what_if_version(documents, "4.1")
    assert "members" in changed._jdf.queryExecution().analyzed().toString()
    ready = verdicts.prepared(documents)
    nodes = shred.shred(ready)
    both = verdicts.diff_findings(run_rules(verdicts.with_detection(nodes)), run_rules(verdicts.with_detection(nodes, "4.1")))
    place = ["side", *verdicts.FINDING_KEY]
    rows = sorted(map(repr, changed.select(place).collect()))
    assert rows == sorted(map(repr, both.select(place).collect())) and rows


def test_messages_are_folded_by_their_number(spark):
    """Kinds scatter a document's findings over its batch; two batches of the shredder, small Arrow batches and repeated ids."""
    from adlint_spark import streaming
    from adlint_spark.sources import corpus

    documents = corpus.ad_corpus(spark, DATA).selectExpr("cast(cast(doc_id as long) % 700 as string) as request_id", "doc_id", "xml").coalesce(1).localCheckpoint()
    rows = streaming.validate_messages(documents.selectExpr("request_id", "xml as document"))
    assert "members" in rows._jdf.queryExecution().analyzed().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        said = [(r["request_id"], r["verdict"]["errors"], r["verdict"]["document_type"], sorted((f["rule_id"], f["path"] or "", f["line"] or 0, f["col"] or 0) for f in r["verdict"]["findings"])) for r in rows.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = {r["doc_id"]: r["request_id"] for r in documents.select("doc_id", "request_id").collect()}
    wanted: dict = {d: [] for d in ids}
    errors = dict.fromkeys(ids, 0)
    for f in run_rules(verdicts.elements(verdicts.prepared(documents.select("doc_id", "xml")))).collect():
        wanted[f["doc_id"]].append((f["rule_id"], f["path"] or "", f["line"] or 0, f["col"] or 0))
        errors[f["doc_id"]] += f["severity"] == "error"
    assert sorted((r, e, repr(f)) for r, e, _, f in said) == sorted((ids[d], errors[d], repr(sorted(f))) for d, f in wanted.items())


def test_repairs_without_their_report_are_the_same(spark):
    from adlint_spark.operators import fix
    from adlint_spark.sources import corpus

    texts = [r["xml"] for r in corpus.ad_corpus(spark, DATA).limit(300).collect()]
    texts += [None, "", "HTTP://a", "<a>http://b</a>", "<MediaFile>hTTp://b</MediaFile>", "<Wrapper><VASTAdTagURI> http://x </VASTAdTagURI></Wrapper>", "<NonLinear apiFramework='simid'/>", "<Ad conditionalAd='1'>http://x</Ad>", "<MediaFile>http://é</MediaFile>"]
    documents = spark.createDataFrame([(str(k), x) for k, x in enumerate(texts)], "doc_id string, xml string").coalesce(1)
    told = {r["doc_id"]: (r["xml"], {a["rule_id"]: a["n"] for a in r["applied"] or ()}) for r in fix.fix(documents).collect()}
    wanted = {str(k): (None, {}) if x is None else fix.repaired(x) for k, x in enumerate(texts)}
    assert told == wanted
    silent = fix.fix(documents, told=False)
    assert silent.columns == ["doc_id", "xml"] and {r["doc_id"]: r["xml"] for r in silent.collect()} == {d: x for d, (x, _) in wanted.items()}


def test_table_function_gives_the_named_elements_alone(spark):
    from adlint_spark.sources import corpus

    texts = [r["xml"] for r in corpus.ad_corpus(spark, DATA).limit(100).collect()] + [None, "", "<Ad>", "<a>\n<Ad x:y='1'>é</Ad><Ad/></a>", "<a>\n<Ad x:y='1' xmlns:x='u'>é</Ad><Ad/></a>"]
    function = shred.ShredXml()
    for x in texts:
        every = list(function.eval(x))
        assert list(function.eval(x, ["Ad", "Error"])) == [r for r in every if r[3] in ("Ad", "Error")]
    shred.register_shred_xml(spark)
    spark.createDataFrame([(x,) for x in texts], "xml string").createOrReplaceTempView("some_documents")
    both = [spark.sql(f"SELECT e.* FROM some_documents d, LATERAL shred_xml(d.xml{more}) e WHERE e.name IN ('Ad', 'Error')").collect() for more in ("", ", array('Ad', 'Error')")]
    assert sorted(map(repr, both[0])) == sorted(map(repr, both[1])) and len(both[0]) > 300


def test_a_document_is_one_row_before_verdicts_are_shuffled(spark):
    """Findings are summed by document in the task; documents of one doc_id count as one, and a policy changes nothing where it has no levels."""
    from adlint_spark.sources import corpus

    documents = corpus.ad_corpus(spark, DATA).selectExpr("cast(cast(doc_id as long) % 700 as string) as doc_id", "caller", "policy_id", "xml").coalesce(1).localCheckpoint()
    rows = verdicts._by_document(verdicts.with_detection(shred.shred(verdicts.prepared(documents), kinds=True, counted=True)))
    assert rows.count() == documents.count()
    found = {r["doc_id"]: r["meta"]["caller"] for r in rows.collect()}
    assert found.keys() == {r["doc_id"] for r in documents.collect()}
    told = ["doc_id", "errors", "warnings", "infos", "valid"]
    none = spark.createDataFrame([], "policy_id string, rule_id string, level string")
    every = verdicts.verdicts_of(documents).select(told).collect()
    assert len(every) == 700 and sorted(map(repr, every)) == sorted(map(repr, verdicts.verdicts_of(documents, none).select(told).collect()))
