import random

import numpy as np
import pyarrow as pa

from adlint_spark.llm.neardup import near_duplicates
from adlint_spark.llm.neardup_kernel import linked_stars, min_max_bands, shingle_sets


def words_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles_of(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ümlaut", "ÉTÉ", "A", "漢字"]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            base = words_of(rng.choice(texts))
            for _ in range(rng.randrange(4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "\t"]).join(base))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 6, 40, 90]))))
    return list(enumerate(texts))


def test_equals_brute_force(docs_of):
    rows = corpus(150, 3)
    got = near_duplicates(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_null_empty_blank_repeated_and_clashing_columns(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \t\n", 9), (4, "a b", 9), (5, "A  B", 9), (5, "A  B", 9), (None, "a b", 9), (7, "x " * 50_000, 9), (8, "x " * 60_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").selectExpr("*", "1 as bands", "2 as bucket")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True), (7, 1, 7, True), (8, 1, 7, False)}


def test_empty_table(docs_of):
    assert near_duplicates(docs_of([])).count() == 0


def test_chain_of_links_is_one_component(docs_of):
    base = [f"t{k}" for k in range(100)]
    rows = [(k, " ".join(base[k * 8 :] + [f"u{j}" for j in range(k * 8)])) for k in range(6)]
    got = near_duplicates(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_signatures_are_unbiased():
    a, b = np.unique(np.random.default_rng(1).integers(0, 2**62, 900).astype(np.uint64)), None
    b = np.concatenate([a[:600], np.random.default_rng(2).integers(0, 2**62, 300).astype(np.uint64)])
    bands = min_max_bands(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 2000, 1)
    share = (bands[0] == bands[1]).mean()
    assert abs(share - 0.5) < 0.04  # 600 of 1200


def test_linked_stars_compares_all_of_a_group():
    sets = [np.arange(0, 100), np.arange(10, 110), np.arange(20, 120), np.arange(500, 600)]
    root, member = linked_stars(np.array([7, 3, 5, 1]), np.concatenate(sets).astype(np.int64), np.array([100] * 4), 75)
    assert sorted(zip(member.tolist(), root.tolist(), strict=True)) == [(5, 3), (7, 3)]


def test_sets_of_long_and_short_texts():
    texts = ["a b c d e f", "a b c", "", None, "B C D E F"]
    out = [h[o[i] : o[i + 1]] for h, o in shingle_sets(pa.array(texts), 5) for i in range(len(o) - 1)]
    assert [len(s) for s in out] == [2, 1, 0, 0, 1] and out[4][0] in out[0]


def test_repeated_doc_ids_with_several_texts(docs_of):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(docs_of([(5, a), (5, b), (6, a), (7, b), (8, a + " x y z q w e r t"), (None, a)])).collect() if r.doc_id is not None)
    assert got == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


def test_hot_keys_join_like_others(spark):
    from adlint_spark.llm.common import hot_join

    left = spark.createDataFrame([(1, n) for n in range(500)] + [(k, 0) for k in range(2, 40)], "k int, n int")
    right = left.groupBy("k").count().withColumnRenamed("count", "w").withColumn("v", left.k * 10)
    assert sorted(map(tuple, hot_join(left, right, ["k"], "w").select("k", "n", "v").collect())) == sorted((r.k, r.n, r.k * 10) for r in left.collect())
