import collections

from pyspark.sql import functions as F

import corpus_pipeline
from adlint_spark.llm import langid, quality
from adlint_spark.llm.common import cut_lineage, held_in, table
from adlint_spark.llm.mixing import mixed
from adlint_spark.llm.queries import MIX_MOST, MIX_WEIGHTS

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = table(spark, SF, "documents")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = cut_lineage(stage(spark, docs, SF))
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert 0 < counts[2] < counts[1] <= counts[0] < table(spark, SF, "documents").count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_empty_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, 0), (None, "the thing of it", "en", "s", 3), (2, "", "en", None, 0), (3, "the and of", "en", "s", 1), (3, "the and of", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as kept", "2 as score")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SF).collect()


def near_kept(rows):
    """The rows that stay, in plain Python: the first of each group of linked 5-word shingle sets."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    sets = []
    for i in order:
        w = (rows[i][1] or "").lower().split()
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(order)))
    for b in range(len(order)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return collections.Counter(tuple(rows[order[k]]) for k in range(len(order)) if group[k] == k)


def counted(df):
    return collections.Counter(tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect())


def test_near_duplicates_are_decided_by_row(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (1, "something else that nothing else here is like"), (2, text), (None, text), (None, "only these words have no id"), (None, "only these words have no id"), (3, None), (3, ""), (3, "a b"), (4, "A  b")]
    rows = [(*r, "en", "s", len(r[1] or "")) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert counted(corpus_pipeline.near_duplicate_stage(spark, docs, SF)) == near_kept(rows)


def test_exact_rows_of_each_stage(spark):
    docs = cut_lineage(table(spark, SF, "documents").select(corpus_pipeline.COLUMNS))
    rows = [tuple(r) for r in docs.collect()]
    labels = table(spark, SF, "labels").filter(held_in(F.col("doc_id"), 5, 0))
    score = {r.doc_id: r.s for r in quality.with_score(docs, quality.train(docs, labels, "quality"), "s").collect()}
    assert counted(corpus_pipeline.quality_stage(spark, docs, SF)) == collections.Counter(r for r in rows if score[r[0]] >= 0.3)
    model = langid.train(docs.filter(held_in(F.col("doc_id"), 3, 1)))
    told = {r.doc_id: r for r in langid.with_language(docs, model).collect()}
    assert counted(corpus_pipeline.language_stage(spark, docs, SF)) == collections.Counter(r for r in rows if told[r[0]].lang_pred != "und" and told[r[0]].score >= 0.5)
    assert counted(corpus_pipeline.near_duplicate_stage(spark, docs, SF)) == near_kept(rows)
    copies = {r.doc_id: r["__copies"] for r in mixed(docs, MIX_WEIGHTS, MIX_MOST).collect()}
    assert counted(corpus_pipeline.mixing_stage(spark, docs, SF)) == collections.Counter({r: copies[r[0]] for r in rows if copies[r[0]]})
    coded = corpus_pipeline.encoding_stage(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in coded) == sorted(r[0] for r in rows)
    assert all(r.n_tokens == len(r.ids) for r in coded) and all(r.round_trip for r in coded)
