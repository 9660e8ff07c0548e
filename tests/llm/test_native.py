import hashlib
import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from adlint_spark.llm.fingerprint import edited_fingerprints
from adlint_spark.llm.mixing import mixed
from adlint_spark.llm.sharding import rendezvous, shard_documents
from adlint_spark.llm.urlfilter import build_cascade, filter_urls

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def test_shards_follow_the_key_and_slots_have_no_gaps(docs_of):
    rows = [(k, f"text {k % 50}" if k % 7 else None) for k in range(2000)]
    got = shard_documents(docs_of(rows), [1.0] * 24).collect()
    assert len(got) == 2000
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
        text = rows[r.doc_id][1]
        assert r.size == len((text or "").encode()) + 8 and (r.text_crc32 is None) == (text is None)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(24))
    moved = sum(r.grown_shard == 24 for r in got)
    assert 40 < moved < 130  # 1 / 25 of 2000


def test_shards_by_weight(spark):
    n = spark.range(20_000).select(rendezvous(F.col("id"), [1.0, 0.0, 3.0]).alias("s")).groupBy("s").count().collect()
    n = {r["s"]: r["count"] for r in n}
    assert set(n) == {0, 2} and abs(n[2] / 20_000 - 0.75) < 0.02


def test_shards_of_repeated_null_and_no_rows(docs_of):
    got = shard_documents(docs_of([(None, "a"), (None, "b"), (1, "x"), (1, "x"), (2, "")]), [1.0] * 3).collect()
    assert len(got) == 5 and len({(r.shard, r.slot) for r in got}) == 5
    assert shard_documents(docs_of([]), [1.0] * 3).count() == 0


def targets(sizes):
    """The contract's resharing, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        out = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if out[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def test_mix_comes_near_its_targets(docs_of):
    rows = [(k, "w " * (1 + (k * 7919) % 400), None, [None, "a", "b", "b", "b", "c"][k % 6]) for k in range(3000)]
    got = mixed(docs_of(rows)).select("doc_id", "source", "__size", "__source_size", "__target", "__copies").collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["__size"]
    want = targets(sizes)
    for s, size in sizes.items():
        mine = [r for r in got if r.source == s]
        assert mine[0]["__source_size"] == size and mine[0]["__target"] == pytest.approx(want[s])
        taken = sum(r["__copies"] * r["__size"] for r in mine)
        assert abs(taken - want[s]) <= 3 * 400
    assert max(r["__copies"] for r in got) <= 3


def test_mix_of_edge_cases(docs_of):
    got = mixed(docs_of([(1, None, None, "a"), (2, "", None, "a"), (3, "x", None, None), (3, "x", None, None), (None, "y " * 9, None, "b")])).collect()
    assert len(got) == 5 and all(0 <= r["__copies"] <= 3 for r in got) and {r["__size"] for r in got} == {0, 1, 9}
    assert mixed(docs_of([])).count() == 0
    assert mixed(docs_of([(1, "", None, "a")])).collect()[0]["__target"] == 0.0


def host_rules(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    urls = [None, "", "no scheme/en/", "http://EXAMPLE.com/en/7x?y#z", "http://a.example.com/en/8", "http://example.com", "http://com/en/", "https://x.net/de/81", "https://b.example.net/de/8/q", "ftp://x.org/es/", "http://xorg/es/1", "a://b://c.org/es/", "http://notexample.com/en/7", "http://x.com:80/en/1", "http://é.com/en/?", "http://.com/en/", "http://x.org/e"] + [f"http://h{k}.example.{t}/{p}/{k}" for k in range(40) for t in ("com", "net", "org") for p in ("en", "de", "es")]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] * 2, "page_id long, url string").selectExpr("*", "1 as verdict", "2 as keys")
    got = filter_urls(pages, RULES).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == host_rules(urls[r.page_id]), urls[r.page_id]
    assert filter_urls(pages.limit(0), RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("cast(id as string) as key")
    listed = universe.filter("cast(key as int) % 9 = 0")
    cascade = build_cascade(listed, universe, (3, 3))
    assert len(cascade.levels) > 3
    wrong = universe.filter(cascade.has(F.col("key")) != (F.col("key").cast("int") % 9 == 0))
    assert wrong.count() == 0
    assert build_cascade(listed.limit(0), universe).levels == ()


def brute_fingerprint(text, bins=128, bits=8):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return []
    least = {}
    for i in range(max(1, len(w) - 4)):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        signed = h - (1 << 64) if h >= 1 << 63 else h
        b = signed % bins
        least[b] = min(least.get(b, 1 << 47), h >> 17)
    chain = lambda *xs: chain_hash(xs)
    out = []
    for b in range(bins):
        v = least[b] if b in least else min(((chain(b, x) >> (bits + 1)) << bits) + (least[x] & 255) for x in least)
        out.append(v & 255)
    return out


def chain_hash(xs):
    h = 42
    for x in xs:
        h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
    return h


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def test_fingerprints_equal_brute_force(docs_of):
    texts = ["", None, "one", "One  two three", "a b c d e f g", "x y " * 300, "é漢 " * 9 + "🎉", "z"] + [" ".join(f"w{(k * j) % 97}" for j in range(k)) for k in range(1, 40)]
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in edited_fingerprints(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = brute_fingerprint(t), brute_fingerprint(edited), brute_fingerprint(following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(f"{x:02x}" for x in a), "".join(f"{x:02x}" for x in b))
        assert math.isclose(r.near_edited, brute_likeness(a, b)) and math.isclose(r.near_next, brute_likeness(a, c))


def test_fingerprints_of_edge_cases(docs_of):
    assert edited_fingerprints(docs_of([])).count() == 0
    one = edited_fingerprints(docs_of([(5, "abcd")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    got = edited_fingerprints(docs_of([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(got) == 3
