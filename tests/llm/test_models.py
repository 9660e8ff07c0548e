import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adlint_spark.llm import langid, ppm, quality
from adlint_spark.llm.common import held_in
from adlint_spark.llm.grams import distinct_features, word_shapes
from adlint_spark.llm.pieces import decode, encode, load_vocabulary
from adlint_spark.llm.pieces_kernel import Vocabulary, encode_texts, piece_key
from adlint_spark.llm.queries import TOKENIZERS
from adlint_spark.llm.topk import search, top_k, va_file, query_blocks, whole_vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- top-k


def brute_top(rows, every, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints.setdefault(i, []).append([math.floor(256 * x) for x in v])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for q in ints:
        if q % every == 0:
            scores = sorted(((max(dot(a, b) for a in ints[q] for b in ints[c]), c) for c in ints if c != q), key=lambda x: (-x[0], x[1]))
            out += [(q, n + 1, c, s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as n")


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)]  # ties
    rows += [(7, rows[8][1]), (50, rows[9][1]), (400, None), (401, [1.0] * 11 + [None]), (402, [float("nan")] * 12), (None, rows[1][1]), (403, [0.5] * 3), (404, [])]
    got = [tuple(r) for r in top_k(vectors_of(spark, rows)).collect()]
    assert sorted(got) == brute_top(rows, 50, 5)


def test_top_k_over_many_blocks_and_large_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in (1e6 * rng.normal(size=5)).astype(np.float32)]) for i in range(200)]
    v = whole_vectors(vectors_of(spark, rows).repartition(3), 256)
    got = search(va_file(v, bits=3, block_rows=16), query_blocks(v.filter("vec_id % 20 = 0"), 4), 3, lanes=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 20, 3)
    assert top_k(vectors_of(spark, []), 50).count() == 0
    assert top_k(vectors_of(spark, [(0, [1.0])]), 50).count() == 0


# ---------------------------------------------------------------- language ID


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.languages(docs, lambda c: held_in(c, 3, 1)).join(docs, "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 30 and sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(docs_of):
    rows = [(k, t, lang, None) for k, (t, lang) in enumerate([("the of and to in that it", "en"), ("der die und das ist nicht", "de"), ("le la les des une est", "fr")] * 20)]
    rows += [(100, None, "en", None), (101, "", None, None), (102, "123 !!", "de", None), (103, "das und die", None, None), (104, "das und die " * 30_000, None, None)]
    got = {r.doc_id: r for r in langid.languages(docs_of(rows), lambda c: held_in(c, 3, 1)).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102, 103, 104)] == ["und", "und", "und", "de", "de"]
    assert got[101].ambiguous and got[101].score == 0
    assert langid.languages(docs_of([]), lambda c: held_in(c, 3, 1)).count() == 0
    assert {r.lang_pred for r in langid.languages(docs_of([(1, "abc"), (2, "d")]), lambda c: held_in(c, 3, 1)).collect()} == {"und"}


def test_codes_correct_errors():
    for n in (3, 4, 5, 12):
        codes = langid.codewords(n)
        gap = min((a != b).sum() for a, b in itertools.combinations(codes, 2))
        assert len({tuple(c) for c in codes.T}) == codes.shape[1]
        for k, flips in itertools.product(range(n), itertools.combinations(range(min(6, codes.shape[1])), (gap - 1) // 2)):
            sent = codes[k].copy()
            sent[list(flips)] *= -1
            assert langid.decode(codes, sent[None], 4.0)[0][0] == k


@pytest.mark.parametrize("n", range(1, 21))
def test_codes_end_and_differ_for_every_number_of_languages(n):
    codes = langid.codewords(n)
    assert codes.shape[0] == n and set(codes.ravel()) <= {1.0, -1.0} and len({tuple(c * c[0]) for c in codes.T}) == codes.shape[1]
    if n > 1:
        assert (np.abs(codes.sum(axis=0)) < n).all() and min((a != b).sum() for a, b in itertools.combinations(codes, 2)) >= min(codes.shape[1], 2 ** (min(n, 5) - 2))


def test_eight_languages_are_told_apart(docs_of):
    words = ["the of and", "der die das", "le la les", "el los una", "il gli che", "och det som", "ja ei se", "nie jest na"]
    rows = [(k, w, f"l{k % 8}", None) for k, w in enumerate(words * 6)]
    got = langid.languages(docs_of(rows), lambda c: F.lit(True)).collect()
    assert all(r.lang_pred == f"l{r.doc_id % 8}" for r in got)


# ---------------------------------------------------------------- quality


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels, lambda c: held_in(c, 5, 0)).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_edge_cases(spark, docs_of):
    docs = docs_of([(k, t) for k, t in enumerate(["fine words here", "BAD!! BAD!!", None, "", "x " * 100_000] * 10)]).selectExpr("*", "1 as score", "2 as label")
    labels = spark.createDataFrame([(k, 1 - k % 5 % 2, 0) for k in range(50)] + [(None, 1, 0), (3, None, 0), (4, 7, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels, lambda c: held_in(c, 5, 0)).collect()}
    assert len(got) == 50 and got[2].score == got[3].score and got[0].score > got[1].score
    one = quality.quality_scores(docs, labels.filter("quality = 1"), lambda c: held_in(c, 5, 0)).select("score").distinct().collect()
    assert len(one) == 1 and one[0].score > 0.5
    assert quality.quality_scores(docs.limit(0), labels.limit(0), lambda c: held_in(c, 5, 0)).count() == 0


def test_quality_learns_from_eight_thousand_rows(spark, docs_of, monkeypatch):
    docs = docs_of([(k, f"word{k % 2}") for k in range(8200)])
    labels = spark.range(8200).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda features, label: seen.append(len(label)))
    quality.train(docs, labels, "quality")
    assert seen == [8000]


def test_dual_coordinate_descent_finds_the_optimum():
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    v = [np.ones(len(f), np.float32) for f in x]
    w = quality.dual_coordinate_descent(x, v, y, np.full(60, 0.7), 4000)
    value = lambda w: 0.5 * w @ w + 0.7 * sum(max(0.0, 1 - y[i] * w[x[i]].sum()) for i in range(60))
    assert all(value(w) <= value(w + 0.02 * rng.normal(size=len(w)) * (np.arange(len(w)) < 30)) + 1e-3 for _ in range(200))


# ---------------------------------------------------------------- language model


def brute_ppm(train, text, order):
    """Prediction by partial matching in plain dictionaries: escape method D, update and symbol exclusion."""
    pad = lambda t: bytes([ppm.START]) * order + t.encode() + bytes([ppm.END])
    table = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in train:
        b = pad(t)
        for i in range(order, len(b)):
            table[order][b[i - order : i]][b[i]] += 1
    for k in range(order - 1, -1, -1):
        for context, symbols in table[k + 1].items():
            for s in symbols:
                table[k][context[1:]][s] += 1
    total, b = 0.0, pad(text)
    for i in range(order, len(b)):
        out = set()
        for k in range(order, -1, -1):
            symbols = {s: n for s, n in table[k].get(b[i - k : i], {}).items() if s not in out}
            if not symbols:
                continue
            mass = sum(symbols.values())
            if b[i] in symbols:
                total += math.log10((symbols[b[i]] - 0.5) / mass)
                break
            total += math.log10(0.5 * len(symbols) / mass)
            out |= set(symbols)
        else:
            total -= math.log10(max(256 - len(table[0].get(b"", {})), 1))
    return total


def test_ppm_equals_brute_force(docs_of):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["ab", "abc", "Bca", "é", "cab", "x\ty"]) for _ in range(rng.randrange(12)))) for k in range(60)] + [(60, None), (61, "zz Q"), (62, "漢 ab " * 400)]
    got = {r.doc_id: r for r in ppm.lm_scores(docs_of(rows), lambda c: held_in(c, 7, 2), order=3, max_head=3).collect()}
    learn = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(t)] + [None]
    c = collections.Counter(w for t in learn for w in tokens(t))
    n, kinds = sum(c.values()), len(c)
    for i, t in rows:
        r, w = got[i], tokens(t or "")
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in c for x in w), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + kinds + 1)) for x in w))
        assert r.score == pytest.approx(brute_ppm(learn, t or "", 3))


def test_ppm_without_rows(docs_of):
    assert ppm.lm_scores(docs_of([]), lambda c: held_in(c, 7, 2)).count() == 0
    r = ppm.lm_scores(docs_of([(1, "ab"), (1, "ab")]), lambda c: F.lit(False)).collect()
    assert len(r) == 2 and r[0].score == pytest.approx(-3 * math.log10(256)) and (r[0].n_known, r[0].train_tokens) == (0, 0)


def test_ppm_bounds_its_model_by_the_most_frequent_contexts(docs_of):
    docs = docs_of([(k, "abab" * (k + 1) + f"q{k}") for k in range(30)])
    small = ppm.train(docs, 4, 40, 10)[0]
    assert all(len(level.cells) <= 40 for level in small.levels[2:]) and np.isfinite(ppm.log_probability(small.levels, ppm.context_keys(np.frombuffer(b"zabq", np.uint8), np.array([0, 4]), 4)[0])).all()


@pytest.mark.parametrize("max_cells", [1, 12, 60])
def test_ppm_with_few_contexts_sent_equals_brute_force(docs_of, max_cells):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["ab", "abc", "Bca", "é", "cab", "x\ty", f"q{k % 9}z"]) for _ in range(rng.randrange(14)))) for k in range(70)] + [(70, None), (71, "zz Q"), (72, "漢 ab " * 40)]
    docs, learn = docs_of(rows), [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    model = ppm.train(docs, 5, max_cells, 3)[0]
    assert all(len(level.cells) <= max_cells for level in model.levels[2:])
    got = {r.doc_id: r for r in ppm.lm_scores(docs, lambda c: held_in(c, 7, 2), max_cells=max_cells, max_head=3).collect()}
    assert [got[i].score for i, _ in rows] == pytest.approx([brute_ppm(learn, t or "", 5) for _, t in rows])


# ---------------------------------------------------------------- SentencePiece

TEXTS = ["", "   ", "  a  b\n c\t d 漢字 é \x00x", None, "aaaaaaa bbbbbb", "tttt", "x" * 700, "<s> </s> <0x0A> 🎉🎉", "http://www.example.com/a_b?c=d&&&###", "\n\n\n", "the " * 5000, "Thinanre*** of the  things"]


def test_pieces_equal_the_library(docs_of):
    import sentencepiece

    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    vocabulary = load_vocabulary(path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = decode(encode(docs_of(list(enumerate(TEXTS))).selectExpr("*", "1 as ids", "2 as decoded"), vocabulary), vocabulary).collect()
    for r in rows:
        assert list(r.ids) == library.encode(r.text or "") and r.decoded == (r.text or ""), r.text
    assert encode(docs_of([]), vocabulary).count() == 0


def test_space_mark_itself_comes_back_as_a_space(docs_of):
    vocabulary = load_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    assert decode(encode(docs_of([(1, "a▁b")]), vocabulary), vocabulary).collect()[0].decoded == "a b"


def test_unigram_scores_find_the_best_segmentation():
    pieces = {"▁": -3.0, "a": -4.0, "b": -4.5, "c": -5.0, "ab": -5.5, "abc": -9.0, "bc": -4.0, "▁a": -4.2, "▁ab": -9.5, "ca": -6.0}
    names = sorted(pieces, key=lambda p: int(piece_key(np.array([[ord(c) for c in p]], np.uint32))[0]))
    keys = np.array([piece_key(np.array([[ord(c) for c in p]], np.uint32))[0] for p in names], np.uint64)
    vocabulary = Vocabulary(keys, np.arange(len(names)), np.array([pieces[p] for p in names]), 3, np.full(256, 99), [], True)

    def best(word):
        scores = {0: (0.0, ())}
        for j in range(1, len(word) + 1):
            scores[j] = max((scores[i][0] + pieces[word[i:j]], scores[i][1] + (word[i:j],)) for i in range(max(0, j - 3), j) if word[i:j] in pieces)
        return scores[len(word)]

    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    ids, offs = encode_texts(vocabulary, pa.array(words))[0]
    for k, w in enumerate(words):
        assert sum(pieces[names[i]] for i in ids[offs[k] : offs[k + 1]]) == pytest.approx(best("▁" + w)[0])


# ---------------------------------------------------------------- plain versions of the classifiers


def test_languages_equal_plain_output_codes(docs_of):
    from adlint_spark.llm.grams import byte_grams

    rng = random.Random(3)
    words = {"aa": ["the", "of", "and", "to"], "bb": ["der", "die", "und", "zu"], "cc": ["le", "la", "et", "aux"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 9))), lang, None) for k, lang in enumerate(list(words) * 12)]
    rows += rows[:2] + [(90, None, "aa", None), (91, "", None, None), (92, "und la", None, None)]
    got = [r.asDict() for r in langid.languages(docs_of(rows).selectExpr("*", "1 as score", "2 as lang_pred"), lambda c: held_in(c, 3, 1)).collect()]
    grams = lambda t, k: [(t.encode().lower() + b"\0\0\0")[i : i + k] for i in range(len(t.encode()))]
    bucket = lambda g: int(byte_grams(np.frombuffer(g, np.uint8), np.array([0, len(g)]), (len(g),), langid.BITS, True)[0][0])
    learn = [(t, lang) for i, t, lang, _ in rows if t is not None and lang and zlib.crc32(str(i).encode()) % 3 != 1]
    names = sorted({lang for _, lang in learn})
    share = {}
    for lang in names:
        for k in langid.ORDERS:
            c = collections.Counter(bucket(g) for t, x in learn if x == lang for g in grams(t, k))
            total = sum(c.values()) + 0.5 * 2**langid.BITS
            share[lang, k] = lambda b, c=c, total=total: (c[b] + 0.5) / total
    codes = langid.codewords(len(names))

    def predict(text):
        margins = []
        for bit in range(codes.shape[1]):
            up, down = ([n for n, c in zip(names, codes[:, bit]) if c == s] for s in (1, -1))
            margin = 0.0
            for k in langid.ORDERS:
                gs = [bucket(g) for g in grams(text, k)]
                odds = [math.log(sum(share[n, k](b) for n in up) / len(up)) - math.log(sum(share[n, k](b) for n in down) / len(down)) for b in gs]
                margin += sum(odds) / len(gs) / len(langid.ORDERS)
            margins.append(margin)
        loss = [sum(math.log1p(math.exp(-4.0 * m * c)) for m, c in zip(margins, word)) for word in codes]
        best = min(range(len(names)), key=lambda i: loss[i])
        return names[best], 1 / sum(math.exp(min(loss) - x) for x in loss)

    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _, _ in rows if i == r["doc_id"])
        if text:
            lang, score = predict(text)
            assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, rel=1e-4)
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0)


def test_word_shapes_come_from_the_text_alone():
    texts = ["fine text", "good text", "text fine", "", "  ", "fine fine fine", "longworda longwordb longwordb", "text fine", "fine"]

    def features(order):
        data = [texts[i].encode() for i in order]
        offs = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        found, cuts = distinct_features(np.frombuffer(b"".join(data), np.uint8), offs, quality.BITS)
        return {i: found[cuts[n] : cuts[n + 1]].tolist() for n, i in enumerate(order)}

    alone = {i: features([i])[i] for i in range(len(texts))}
    rng = random.Random(3)
    for _ in range(20):
        order = rng.sample(range(len(texts)), rng.randint(1, len(texts)))
        assert features(order) == {i: alone[i] for i in order}
    # words of over eight bytes are compared whole
    pair = np.frombuffer(b"longworda longwordb longwordb", np.uint8)
    shape, _ = word_shapes(pair, np.array([0, len(pair)]))
    assert (shape & np.uint64(1)).tolist() == [0, 0, 1]


def test_quality_equals_plain_naive_bayes_support_vectors(spark, docs_of):

    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["fine", "good", "text", "Sun"] if k % 2 else ["BAD!!", "xx", "$$$", "text"]) for _ in range(rng.randrange(1, 12)))) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(docs_of(rows), labels, lambda c: held_in(c, 5, 0)).collect()}
    feats = lambda t: distinct_features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), quality.BITS)[0].tolist()
    own = {i: feats(t) for i, t in rows}
    mixed = sorted((i * 0x9E3779B1 % 1_000_003, i) for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 0)
    ids = [i for _, i in mixed]
    y = [1.0 if i % 2 else -1.0 for i in ids]
    learn = [n for n in range(len(ids)) if n % 5 != 4]
    seen = {s: collections.Counter(f for n in learn if y[n] == s for f in own[ids[n]]) for s in (1.0, -1.0)}
    total = {s: sum(seen[s].values()) + 2**quality.BITS for s in seen}
    ratio = lambda f: math.log((seen[1.0][f] + 1) / total[1.0]) - math.log((seen[-1.0][f] + 1) / total[-1.0])
    vector = {i: {f: ratio(f) for f in own[i]} for i in own}
    vector = {i: {f: x / max(math.sqrt(sum(v * v for v in d.values())), 1e-6) for f, x in d.items()} for i, d in vector.items()}
    cost = {s: len(ids) / (2 * y.count(s)) for s in (1.0, -1.0)}
    w, alpha, order = collections.Counter(), [0.0] * len(learn), np.random.default_rng(7)
    for _ in range(15):
        moved = 0.0
        for a in order.permutation(np.arange(len(learn))):
            d, s = vector[ids[learn[a]]], y[learn[a]]
            new = min(max(alpha[a] - (s * sum(w[f] * x for f, x in d.items()) - 1) / sum(x * x for x in d.values()), 0.0), cost[s])
            for f, x in d.items():
                w[f] += (new - alpha[a]) * s * x
            moved, alpha[a] = max(moved, abs(new - alpha[a])), new
        if moved < 1e-3:
            break
    margin = {i: sum(w[f] * x for f, x in d.items()) for i, d in vector.items()}
    check = [n for n in range(len(ids)) if n % 5 == 4]
    slope, intercept = quality.logistic(np.array([margin[ids[n]] for n in check]), np.array([y[n] for n in check]))
    for i in own:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(slope * margin[i] + intercept))), abs=1e-5)


def test_score_column_is_replaced_and_repeated_documents_count_once(spark, docs_of):
    docs = docs_of([(k, "good text" if k % 2 else "BAD!!") for k in range(40)] * 3).selectExpr("*", "0.5D as score")
    model = quality.train(docs, spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as quality"), "quality")
    rows = quality.with_score(docs, model).collect()
    assert len(rows) == 120 and rows[1].score > rows[0].score and rows[0].score != 0.5
