"""MinHash near-duplicate detection with min-max hashing, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlint_spark.llm.common import cut_lineage, hot_join, map_batches
from adlint_spark.llm.neardup_kernel import linked_stars, min_max_bands, shingle_sets

#: A group that compares shingle sets holds two blocks of at most about this many shingles (8 bytes each).
BLOCK_SHINGLES = 1 << 20


def signatures(docs: DataFrame, width: int = 5, permutations: int = 64, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): size and 128-bit fingerprint of each text's shingle set, band keys.

    ``docs`` has doc_id and text. A null, empty or blank text has n_shingles 0 and no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, batch.column("text")
            for hashes, offs in shingle_sets(texts, width):
                n, count = len(offs) - 1, np.diff(offs)
                full = np.flatnonzero(count)
                prints = np.zeros((2, n), np.uint64)
                with np.errstate(over="ignore"):
                    for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                        x = hashes * np.uint64(odd)
                        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
                        if len(full):
                            prints[k, full] = np.add.reduceat(x ^ (x >> np.uint64(32)), offs[:-1][full])
                bands = min_max_bands(hashes, offs, permutations, rows)
                ends = np.concatenate([[0], np.cumsum((count > 0) * bands.shape[1])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), pa.array(count.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in prints), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )
                at += n

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def full_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, shingles): the distinct shingle hashes of each text, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for hashes, offs in shingle_sets(batch.column("text"), width):
                n = len(offs) - 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["doc_id", "shingles"])
                at += n

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, shingles array<long>")


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(bucket, one, two, rep): groups of representatives that share a band, cut into pairs of blocks of bounded size.

    ``reps`` has rep, n_shingles, bands. Buckets with the same members count once.
    """
    rows = reps.select(F.explode("bands").alias("bucket"), "rep", "n_shingles")
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("least"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.sum("n_shingles").alias("weight"))
    buckets = buckets.filter("members > 1").groupBy("members", "least", "who").agg(F.min("bucket").alias("bucket"), F.max("weight").alias("weight"))
    blocks = F.ceil(F.col("weight") / BLOCK_SHINGLES)
    buckets = cut_lineage(buckets.select("bucket", "members", blocks.alias("blocks")))
    rows = hot_join(rows.select("bucket", "rep"), buckets, ["bucket"], "members")
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks"))
    # the row's block meets every other one once; block pairs are (smaller, larger), a single block is (0, 0)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return rows.withColumn("own", own).withColumn("other", other).select("bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "rep")


def confirmed_links(docs: DataFrame, groups: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(rep, root): for every component that the confirmed links of a group form, a link from each member to the least one."""
    involved = groups.select(F.col("rep").alias("doc_id")).distinct()
    sets = full_sets(docs.join(involved, "doc_id", "left_semi"), width)

    def run(key: tuple, part: pa.Table) -> pa.Table:
        rep = part.column("rep").to_numpy()
        sets = part.column("shingles").combine_chunks()
        root, member = linked_stars(rep, sets.flatten().to_numpy(), sets.value_lengths().to_numpy(), percent)
        return pa.table({"rep": pa.array(member), "root": pa.array(root)})

    rows = groups.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    return rows.groupBy("bucket", "one", "two").applyInArrow(run, "rep long, root long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over ``links`` (rep, root), by label spreading and pointer jumping."""
    edges = cut_lineage(links.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(links.select("root", "rep")).filter("a <> b").distinct())
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = cut_lineage(labels)
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = cut_lineage(spread.join(up, "next").select("node", F.least("next", "jump").alias("label"), "old"))
        still = moved.filter("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not still:
            return labels.withColumnRenamed("label", "component")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, permutations: int = 64, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text).

    Shingles are ``width`` consecutive words (runs of bytes other than ASCII white space, A-Z lower-cased), or the
    whole sequence of a shorter text. Two documents are linked if ``100 * intersection >= percent * union`` of their
    shingle sets; component_id is the least doc_id reachable. Equal sets are grouped first, so copies cost one
    representative. Candidates share a band of ``rows`` signature values; each of ``permutations`` hash evaluations
    gives two, the minimum and the maximum. With 64 and 4 a pair at similarity 0.75 is missed with probability
    5e-6, one at 0.8 with 5e-8. Every candidate group is compared on full sets, in block pairs of bounded size.

    Texts that are null, empty or blank have n_shingles 0 and are linked with nothing. A null doc_id can't be
    named by a link: its row has a null component_id and is kept. Rows that repeat a doc_id with one text have one
    result; with several texts each row has the component of its own set, and sets whose least doc_id is the same one
    count as linked. No rows give no rows. Other columns are ignored.
    """
    base = cut_lineage(signatures(docs.select("doc_id", "text"), width, permutations, rows))
    some = base.filter("n_shingles > 0 and doc_id is not null")
    reps = cut_lineage(some.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
    groups = cut_lineage(candidate_groups(reps))
    links = confirmed_links(docs, groups, width, percent)
    return finish(base, reps.drop("bands"), components(links))


def finish(base: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """Every row with its set's representative and that one's component. Sets meet their components first, then rows their sets."""
    keys = ["n_shingles", "set_a", "set_b"]
    sets = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    sets = cut_lineage(sets.select(*keys, "copies", F.coalesce("component", "rep").alias("component")))
    # rows without words or without doc_id have no set
    rows = hot_join(base.filter("n_shingles > 0 and doc_id is not null").select("doc_id", *keys), sets, keys, "copies")
    rest = base.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    rows = rows.select("doc_id", "n_shingles", "component").unionByName(rest)
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
