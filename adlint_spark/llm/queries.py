"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlint_spark.llm.adaptive import LEAST_ROWS, MEASURES, SHARP, adaptive_rules
from adlint_spark.llm.common import LOWER, UPPER, held_in, table
from adlint_spark.llm.fingerprint import edited_fingerprints
from adlint_spark.llm.langid import languages
from adlint_spark.llm.mixing import mixed
from adlint_spark.llm.neardup import near_duplicates
from adlint_spark.llm.phrases import collocations
from adlint_spark.llm.pieces import encode, load_vocabulary
from adlint_spark.llm.ppm import lm_scores
from adlint_spark.llm.quality import quality_scores
from adlint_spark.llm.sharding import shard_documents
from adlint_spark.llm.topk import top_k
from adlint_spark.llm.urlfilter import filter_urls
from adlint_spark.llm.whitening import whitened_components

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}')"


SHARDS = 24
MIX_WEIGHTS = (1, 2, 3)
MIX_MOST = 3
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op2_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"), lambda doc_id: held_in(doc_id, 3, 1))


#: Where the vocabulary files of public tokenizers lie; the driver reads the one that is used.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, their number, and whether decoding them gives the text back."""
    vocabulary = load_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, checked="round_trip")
    return rows.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "round_trip")


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_MOST)
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def op6_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: held_in(doc_id, 5, 0))


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), lambda doc_id: held_in(doc_id, 7, 2))


def op10_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_multiplicity_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


def op12_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules(table(spark, sf_dir, "documents")).drop("failed")


def op13_misra_gries_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _shard_sql(shards: int) -> str:
    """The last of the highest-scoring shards, as ties go to the larger number; equal weights leave the largest u."""
    scores = ", ".join(f"{{'s': 1.0 / -ln((('0x' || substr(md5(k || '/{i}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}), 'i': {i}}}" for i in range(shards))
    return f"list_max([{scores}]).i"


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)::INT AS rank,
       c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id QUALIFY rank <= 5
"""

OP4_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, (coalesce(strlen(text), 0) + 8)::BIGINT AS size, CASE WHEN text IS NOT NULL THEN
          xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::BIGINT)),
              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS text_crc32
      FROM documents, crc),
s AS (SELECT *, {_shard_sql(SHARDS)} AS shard, {_shard_sql(SHARDS + 1)} AS grown_shard,
             ('0x' || substr(md5(k || '/' || coalesce(text_crc32::VARCHAR, '')), 20, 8))::BIGINT % 64 AS slice FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s
"""

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5('1/' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][((nth - 1) % 3 + 1)::INT] AS weight FROM s),
-- sources that the level of all the others would put above their cap leave, round by round
fill AS (SELECT 0 AS round, nth, weight, 3 * source_size AS cap, false AS capped, sum(source_size) OVER () / sum(weight) OVER () AS level FROM w
         UNION ALL
         SELECT round + 1, nth, weight, cap, out, level_next FROM (
             SELECT *, (sum(cap) FILTER (out) OVER ()) AS caps, (sum(cap) OVER () / 3 - coalesce(sum(cap) FILTER (out) OVER (), 0)) / nullif(sum(weight) FILTER (NOT out) OVER (), 0) AS level_next
             FROM (SELECT *, capped OR cap <= level * weight AS out FROM fill)) WHERE round < (SELECT count(*) FROM w)),
t AS (SELECT nth, (CASE WHEN capped THEN cap ELSE level * weight END)::DOUBLE AS target FROM fill WHERE round = (SELECT count(*) FROM w)),
r AS (SELECT w.source, w.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('1/' || coalesce(source, '')), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r} AS u FROM w JOIN t USING (nth)),
c AS (SELECT *, ('0x' || substr(o, 1, 8))::BIGINT % 64 AS slice, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) * 16 +
          CASE WHEN length(bin(size)) > 3 THEN (size * 8) >> (length(bin(size)) - 1)::INT ELSE size * 8 END END AS class FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slice, size, o, doc_id) AS n FROM c)
SELECT p.doc_id, p.size, r.source_size, r.target, (floor(u + rate * n) - floor(u + rate * (n - 1)))::BIGINT * p.size AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""

OP6_SQL = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(verdict, h, start) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
best AS (SELECT page_id, host, path, arg_max(h || start, length(h || start)) AS rule, arg_max(verdict, length(h || start)) AS verdict
         FROM (SELECT DISTINCT * FROM p) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN best b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
"""

OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s
       FROM w, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
          JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""

_VALUES = ", ".join(f"('{m.name}', CASE WHEN {m.of} > 0 THEN {m.scale} * {m.part} // {m.of} ELSE 0 END)" for m in MEASURES)
_FENCES = ", ".join(f"('{m.name}', {m.reach}, {m.slack}, {str(m.below).lower()})" for m in MEASURES)

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS nth, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
wins AS (SELECT nth, i, w[i : i + 2] AS g FROM d, unnest(generate_series(1, len(w) - 2)) AS u(i) WHERE len(w) > 2),
twice AS (SELECT nth, i FROM wins QUALIFY count(*) OVER (PARTITION BY nth, g) > 1),
covered AS (SELECT nth, count(DISTINCT i + o) AS n FROM twice, unnest([0, 1, 2]) AS u(o) GROUP BY nth),
lines AS (SELECT nth, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM d, unnest(string_split(t, chr(10))) AS u(line) WHERE regexp_matches(line, '{_WORD}') GROUP BY nth),
c AS (SELECT d.nth, doc_id, lang, source, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM d LEFT JOIN lines USING (nth) LEFT JOIN covered USING (nth)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS (SELECT nth, lang, source, measure, value, CASE WHEN value <= 0 THEN 0 ELSE (length(bin(value)) << {SHARP + 1}) + ((value << {SHARP}) >> (length(bin(value)) - 1)) END AS bucket
      FROM (SELECT nth, lang, source, unnest([{_VALUES}]) AS m, m[1] AS measure, m[2]::BIGINT AS value FROM b WHERE NOT base_failed)),
levels AS (SELECT 0 AS level, lang, source, measure, bucket FROM v UNION ALL SELECT 1, lang, NULL, measure, bucket FROM v UNION ALL SELECT 2, NULL, NULL, measure, bucket FROM v),
sk AS (SELECT level, lang, source, measure, bucket, count(*) AS n FROM levels GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM sk),
q AS (SELECT level, lang, source, measure, max(total) AS total, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM cum GROUP BY ALL),
e AS (SELECT * EXCLUDE (q1, q3), CASE WHEN q1 <= 0 THEN 0 ELSE (((q1 % {1 << SHARP + 1}) << ((q1 >> {SHARP + 1}) - 1)) + {(1 << SHARP) - 1}) >> {SHARP} END AS low,
             CASE WHEN q3 <= 0 THEN 0 ELSE (((q3 % {1 << SHARP + 1}) << ((q3 >> {SHARP + 1}) - 1)) + {(1 << SHARP) - 1}) >> {SHARP} END AS high FROM q),
f AS (SELECT e.*, CASE WHEN below THEN low - (high - low) * reach - slack ELSE -1 END AS least, high + (high - low) * reach + slack AS most
      FROM e JOIN (VALUES {_FENCES}) AS r(measure, reach, slack, below) USING (measure)),
fit AS (SELECT v.nth, bool_and(value BETWEEN CASE WHEN a.total >= {LEAST_ROWS} THEN a.least WHEN l.total >= {LEAST_ROWS} THEN l.least ELSE g.least END
                                 AND CASE WHEN a.total >= {LEAST_ROWS} THEN a.most WHEN l.total >= {LEAST_ROWS} THEN l.most ELSE g.most END) AS within
        FROM v JOIN f a ON a.level = 0 AND a.measure = v.measure AND a.lang IS NOT DISTINCT FROM v.lang AND a.source IS NOT DISTINCT FROM v.source
        JOIN f l ON l.level = 1 AND l.measure = v.measure AND l.lang IS NOT DISTINCT FROM v.lang JOIN f g ON g.level = 2 AND g.measure = v.measure GROUP BY v.nth)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND coalesce(within, false) AS kept
FROM b LEFT JOIN fit USING (nth)
"""

OP13_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
           FROM documents, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS u(piece)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS f
      FROM p, unnest(generate_series(1, 5)) AS x(k), unnest(generate_series(1, len(w) - k + 1)) AS y(i) WHERE len(w) >= k GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.phrase, c.k, c.f AS a, cut, h.f AS l, t.f AS r, n.n, (1000 * c.f::HUGEINT * n.n::HUGEINT // (h.f::HUGEINT * t.f::HUGEINT))::BIGINT AS score
         FROM c JOIN n ON n.lang = c.lang JOIN unnest(generate_series(1, 4)) AS x(cut) ON cut < c.k
         JOIN c h ON h.lang = c.lang AND h.phrase = array_to_string(string_split(c.phrase, ' ')[1 : cut], ' ')
         JOIN c t ON t.lang = c.lang AND t.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
left_ AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.f >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))::INT AS rank, phrase, a, l, r, n, score FROM left_ QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_va_topk": OP1_SQL, "op4_rendezvous_shards": OP4_SQL, "op5_systematic_mix": OP5_SQL, "op6_bloom_cascade": OP6_SQL, "op7_minmax_neardup": OP7_SQL, "op12_adaptive_rules": OP12_SQL, "op13_misra_gries_phrases": OP13_SQL}
