import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adlint_spark.llm import adaptive, phrases, whitening
from adlint_spark.llm.queries import op11_multiplicity_whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- whitening


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as n", "2 as component", "3 as key", "4 as rows")


def plain_whitening(rows, most, once=False):
    """{vec_id: [(deviation, whitened, explained)]} from whole numbers, with the axes' signs of the larger entry."""
    ints = [(i, tuple(math.floor(64 * float(x)) + 1_000_000 for x in v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    length = max(collections.Counter(len(v) for _, v in ints).items(), key=lambda t: (t[1], t[0]))[0]
    ints = [(i, v) for i, v in ints if len(v) == length]
    fit = sorted({v for _, v in ints}) if once else [v for _, v in ints]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([s // n for s in sums], float), np.array([s % n / n for s in sums])
    centre = lambda v: (np.array(v, float) - mean[0]) - mean[1]
    y = np.array([centre(v) for v in fit])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > e[0] * 1e-12).sum()))
    return n, {
        (i, v): (sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)), centre(v) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov)) for i, v in ints
    }, ints


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_equals_plain_numpy(spark, weights):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (rng.normal(size=6) * [5, 3, 2, 1, 1, 0.5]).astype(np.float32)]) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(120)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    rows += [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [1.0] * 3)]
    n, want, ints = plain_whitening(rows, 4, weights == "one")
    got = whitening.whiten(vectors_of(spark, rows).repartition(5), 4, weights=weights).collect()
    assert len(got) == len(ints) and {r.n for r in got} == {n}
    by_id = collections.defaultdict(list)
    for (i, _), w in want.items():
        by_id[i].append(w)
    pivot = next(r for r in got if r.vec_id == 0)
    sign = np.sign(np.array(pivot.whitened)) * np.sign(by_id[0][0][1])
    for r in got:
        assert any(r.deviation == d and np.allclose(np.array(r.whitened) * sign, z, atol=1e-9) and np.allclose(r.explained, x, rtol=1e-9) for d, z, x in by_id[r.vec_id])
        assert r.identity_error < 1e-9 if weights == "counts" else r.identity_error < 1e-6


def test_whitening_of_large_flat_and_no_vectors(spark):
    big = [(i, [1e30 * (i % 2), float(i), -1e300]) for i in range(8)]
    got = whitening.whiten(vectors_of(spark, big, "double")).collect()
    assert len(got) == 8 and all(r.deviation is None and len(r.whitened) == 1 for r in got)  # beyond 64 bits; the large component outweighs the other
    flat = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.deviation, r.whitened, r.identity_error) for r in flat] == [(0, [], None)] * 2
    assert whitening.whitened_components(vectors_of(spark, [(1, [1.0, 2.0])])).count() == 0
    for none in ([], [(1, None)], [(1, [])]):
        assert whitening.whitened_components(vectors_of(spark, none)).collect() == []


def test_deviations_are_exact_on_both_ways():
    rng = np.random.default_rng(1)
    for scale, n in ((100, 10), (1 << 20, 50_000), (1 << 40, 10)):
        parts, rest = rng.integers(-scale, scale, (20, 7)), rng.integers(0, n, 7)
        want = [sum((n * int(x) - int(r)) ** 2 for x, r in zip(row, rest, strict=True)) for row in parts]
        assert whitening.deviations(parts, rest, n) == [w if w < 1 << 63 else None for w in want]
    x, w = rng.integers(-(1 << 42), 1 << 42, (30, 3)), rng.integers(1, 1 << 30, 30)
    assert whitening.exact_sums(x, w) == [sum(int(a) * int(b) for a, b in zip(x[:, k], w, strict=True)) for k in range(3)]


def test_whitening_query_on_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, want, _ = plain_whitening([(r.vec_id, r.embedding) for r in rows], 32)
    by_id = {i: w for (i, _), w in want.items()}
    got = collections.defaultdict(dict)
    for r in op11_multiplicity_whitening(spark, SF).collect():
        got[r.vec_id][r.component] = r
    assert set(got) == set(by_id)
    for i, parts in got.items():
        deviation, z, share = by_id[i]
        assert sorted(parts) == list(range(1, len(z) + 1)) and {r.deviation for r in parts.values()} == {deviation} and {r.n for r in parts.values()} == {n}
        assert np.allclose(np.abs([parts[k].whitened for k in sorted(parts)]), np.abs(z), atol=1e-7)
        assert np.allclose([parts[k].explained for k in sorted(parts)], share, rtol=1e-9) and all(r.identity_error < 1e-4 for r in parts.values())


# ---------------------------------------------------------------- adaptive rules


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)]


def test_text_counts_equal_plain_python():
    rng = random.Random(8)
    texts = ["", "  \n\t", "one", "a b c a b c", "x\nx\n\n x\nx", "é#ü*\r\nß | ß\nß | ß", None, "\n", "end\n", "a b c d\na b c d\n", "w " * 3000 + "#"]
    texts += ["".join(rng.choice(["ab ", "cd ", "é ", "\n", "# ", "\t", "ab cd ef "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = adaptive.text_counts(pa.array(texts, pa.string()))
    assert got.tolist() == [plain_counts(t) for t in texts]
    assert adaptive.text_counts(pa.array([], pa.string())).shape == (0, 6)


def test_value_ranges_rise_and_know_their_least(spark):
    values = sorted({*range(300), *(1 << k for k in range(45)), *((1 << k) + 7 for k in range(45)), *random.Random(1).sample(range(1 << 40), 200)})
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", adaptive.value_range(F.col("v")).alias("b")).select("v", "b", adaptive.least_of(F.col("b")).alias("least")).orderBy("v").collect()
    assert all(a.b <= b.b for a, b in zip(rows, rows[1:], strict=False))
    assert all(r.least <= r.v <= r.least * (1 + 1 / 64) + 1 for r in rows)
    least = spark.createDataFrame([(r.least,) for r in rows], "v long").select("v", adaptive.value_range(F.col("v")).alias("b")).collect()
    assert [r.b for r in rows] == [r.b for r in least]


def plain_adaptive(rows, least_rows):
    counted = [(lang, source, plain_counts(text)) for _, text, lang, source in rows]
    failed = [c[0] < 50 or 100 * c[5] > 50 * c[0] for _, _, c in counted]
    at = dict(zip(adaptive.COUNTS, range(6), strict=True))
    value = lambda m, c: m.scale * c[at[m.part]] // c[at[m.of]] if c[at[m.of]] else 0

    def floor(v):
        if v <= 0:
            return 0
        k = v.bit_length() - 1
        return (((v << 6) >> k << k) + 63) >> 6

    out = []
    for (lang, source, c), bad in zip(counted, failed, strict=True):
        outside = []
        for m in adaptive.MEASURES:
            for group in (lambda x: (x[0], x[1]) == (lang, source), lambda x: x[0] == lang, lambda x: True):
                some = sorted(floor(value(m, x[2])) for x, b in zip(counted, failed, strict=True) if not b and group(x))
                if len(some) >= least_rows:
                    break
            if bad:
                continue
            q1, q3 = (some[math.ceil(k * len(some) / 4) - 1] for k in (1, 3))
            wide = m.reach * (q3 - q1) + m.slack
            if value(m, c) > q3 + wide or m.below and value(m, c) < q1 - wide:
                outside.append(m.name)
        out.append((*c[:3], *c[4:], bad, not bad and not outside, outside))
    return out


def adaptive_rows(seed=2):
    rng = random.Random(seed)
    text = lambda n, junk="": " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) + junk for _ in range(n))
    rows = [(i, text(rng.randint(40, 120), "##" if i % 11 == 0 and i % 3 else ""), ["en", "de", None][i % 3], ["a", None][i % 2]) for i in range(90)]
    rows += [(200 + i, text(60), "xx", f"s{i}") for i in range(4)]
    rows += [(300, None, "en", "a"), (301, "", "en", "a"), (302, " \n", None, None), (303, "word " * 200, "en", "a"), (304, "long" * 9000 + " " + text(80), "de", None), (0, text(70), "en", "a"), (None, text(70), "en", "a")]
    rows += [(400 + i, text(60) + "\n" + "\n".join(["the same line"] * i), "en", "a") for i in range(6)]
    return rows


def test_adaptive_rules_equal_plain_python(spark, docs_of):
    rows = adaptive_rows()
    docs = docs_of(rows).selectExpr("*", "1 as n_words", "2 as kept", "3 as fence", "4 as rows", "5 as measure").repartition(4)
    got = adaptive.adaptive_rules(docs, least_rows=10).collect()
    mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, tuple(r.failed)) for r in got]
    want = [(row[0], *w[:7], tuple(w[7])) for row, w in zip(rows, plain_adaptive(rows, 10), strict=True)]
    assert collections.Counter(mine) == collections.Counter(want)
    assert any(not r.kept and not r.base_failed for r in got) and any(r.kept for r in got)


def test_sketches_merge_by_adding(spark, docs_of):
    docs = docs_of(adaptive_rows()).selectExpr("doc_id", "text", "coalesce(lang, '') as lang", "coalesce(source, '') as source")
    counts = adaptive.with_counts(docs, "doc_id", "lang", "source").cache()
    parts = [counts.filter(f"doc_id % 3 <=> {k}") for k in (0, 1, 2, "null")]
    pieces = adaptive.sketches(parts[0], ["lang"])
    for p in parts[1:]:
        pieces = pieces.unionByName(adaptive.sketches(p, ["lang"]))
    whole = adaptive.quartiles(adaptive.sketches(counts, ["lang"]), ["lang"])
    assert sorted(map(tuple, adaptive.quartiles(adaptive.merged(pieces, ["lang"]), ["lang"]).collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, adaptive.merged(adaptive.sketches(counts, ["lang", "source"]), ["lang"]).collect())) == sorted(map(tuple, adaptive.sketches(counts, ["lang"]).collect()))


def test_adaptive_rules_without_rows(docs_of):
    assert adaptive.adaptive_rules(docs_of([])).count() == 0
    only = adaptive.adaptive_rules(docs_of([(1, None), (2, "few words")])).collect()
    assert [(r.base_failed, r.kept, r.failed) for r in only] == [(True, False, [])] * 2


# ---------------------------------------------------------------- phrases


def plain_collocations(rows, least, most_words=5, top=2000):
    count, words_of = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang, text = lang if lang is not None else "und", text or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(ws)
            for k in range(1, most_words + 1):
                for i in range(len(ws) - k + 1):
                    count[lang, tuple(ws[i : i + k])] += 1
    frequent = {p: f for p, f in count.items() if f >= least}
    out = []
    for (lang, p), a in frequent.items():
        if len(p) < 2 or any(g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and f >= a for (g, q), f in frequent.items()):
            continue
        score, _, left, right = min((1000 * a * words_of[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, words_of[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, k + 1, *x[1:]) for k, x in enumerate(mine[:top])]
    return sorted(ranked)


def phrase_rows():
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "a", "ünder", "cat's", "#", "new", "york", "city", "x" * 40]
    rows = []
    for i in range(160):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((text + "New York  City Hall is. " * (i % 3), ["en", "de", None, "und"][i % 4]))
    rows += [(None, "en"), ("", "en"), (" , ", None), ("la la la la la la la", "fr"), ("la la la la", "fr"), ("solo", "it"), ("q " * 30_000, "en"), ("é\x00z w " * 20, "fr")]
    return rows


@pytest.mark.parametrize(("bits", "top"), [(26, 2000), (7, 5)])
def test_collocations_equal_plain_python(spark, bits, top):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as n", "2 as phrase", "3 as f", "4 as words").repartition(6)
    got = phrases.collocations(docs, least=9, top=top, bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 9, top=top)


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, None)], [("one two", "en")]):
        assert phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), least=2).collect() == []


def test_scores_pass_64_bits(spark):
    rows = [("big small " * 3 + ", ", "en")] * 3
    assert sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), least=3).collect()) == plain_collocations(rows, 3)
    one = spark.sql("select cast(90000000000000000 as decimal(17,0)) * cast(90000000000000000 as decimal(17,0)) * cast(1000 as decimal(4,0)) div (cast(90000000000000000 as decimal(19,0)) * cast(80000000000000001 as decimal(19,0)))").first()[0]
    assert one == 1000 * 9 * 10**16 * 9 * 10**16 // (9 * 10**16 * (8 * 10**16 + 1))


def test_misra_gries_keeps_every_frequent_key_in_any_order():
    rng = np.random.default_rng(3)
    least = 40
    for _ in range(20):
        keys = rng.zipf(1.3, 6000).astype(np.uint64)
        parts = np.array_split(keys, 7)
        capacity = len(keys) // least + 1
        whole = phrases.MisraGries(capacity)
        for p in parts:
            whole.merge(p, np.ones(len(p), np.int64))
        merged = phrases.MisraGries(capacity)
        for p in parts:  # summaries of parts, merged
            own = phrases.MisraGries(capacity)
            own.merge(p, np.ones(len(p), np.int64))
            merged.merge(own.h, own.n, own.lost)
        exact = collections.Counter(keys.tolist())
        for s in (whole, merged):
            held = dict(zip(s.h.tolist(), s.n.tolist(), strict=True))
            assert len(held) <= capacity and s.lost < least
            assert all(held.get(k, 0) + s.lost >= n for k, n in exact.items()) and all(held[k] <= exact[k] for k in held)
            assert {k for k, n in exact.items() if n >= least} <= set(held)


def test_survivors_hold_all_frequent_phrases_with_small_summaries(spark):
    rng = random.Random(9)
    rows = [(" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(80)), "en") for _ in range(120)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    counts = phrases.gram_counts(docs, (1, 2), None, None)
    exact, mass = collections.Counter(), collections.Counter()
    for r in counts.collect():
        if r.keys is None:
            mass[r.bucket] += r.mass
        else:
            for k, n in zip(np.frombuffer(r.keys, np.uint32).tolist(), np.frombuffer(r.counts, np.uint32).tolist(), strict=True):
                exact[r.bucket << 54 | k << 22] += n
    total = collections.Counter()
    for h, n in exact.items():
        total[h >> 54] += n
    assert total == mass and sum(total.values()) == 120 * (80 + 79)
    kept = {r.h % (1 << 64) for r in phrases.survivors(counts, 50).collect()}
    assert {h for h, n in exact.items() if n >= 50} <= kept and len(kept) > 10
