"""SentencePiece encoding and decoding of whole columns by a batched Viterbi search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from adlint_spark.llm.common import map_batches
from adlint_spark.llm.pieces_kernel import SPACE, Vocabulary, decode_ids, encode_runs, make_merges, piece_key


def load_vocabulary(path: str) -> Vocabulary:
    """The pieces and scores of a SentencePiece model file that the driver can open; tasks get them with the plan.

    Unigram and BPE models without text normalisation are read; others raise ValueError.
    """
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kinds = type(proto).SentencePiece
    spec, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or kind not in (1, 2):
        raise ValueError("a unigram or BPE model without normalisation is needed")
    ordinary = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in ordinary):
        raise ValueError("pieces that span words can't be read")
    keys = np.empty(len(ordinary), np.uint64)
    lengths = np.array([len(p) for p, _, _ in ordinary])
    for m in np.unique(lengths):
        rows = np.flatnonzero(lengths == m)
        keys[rows] = piece_key(np.array([[ord(c) for c in ordinary[k][0]] for k in rows], np.uint32))
    turn = np.argsort(keys)
    ordinary = [ordinary[k] for k in turn]
    unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), 0)
    byte_ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
    text = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else " ⁇ ".encode() if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
    scores = np.array([s for _, _, s in ordinary])
    return Vocabulary(
        keys[turn], np.array([i for _, i, _ in ordinary]), scores, int(lengths.max()),
        np.array([byte_ids.get(f"<0x{b:02X}>", unknown) for b in range(256)]), text, spec.add_dummy_prefix,
        make_merges([p for p, _, _ in ordinary], scores) if kind == 2 else None,
    )


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", checked: str = "") -> DataFrame:
    """``docs`` with the column ``ids``, array<int>, the best segmentation of each whole text.

    Under a unigram model that is the one with the highest sum of scores; under a BPE model the one that merging gives, found
    in the same lattice with pieces that can't stand side by side kept apart. Characters without a piece become
    their bytes (the unknown id if the model has none). A null or empty text has no ids. Repeated rows are encoded
    alike; a column that has the name already is replaced. ``checked`` names a further column that tells whether decoding
    the ids gives the text back (null counts as empty). No rows give no rows. Very long texts are read whole, in memory in proportion to the longest.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of the size of the model file
    kept = [c for c in docs.columns if c not in (ids, checked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for tokens, offs in encode_runs(sent.value, batch.column(text)):
                n = len(offs) - 1
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(tokens))
                columns, names = [*(batch.column(c).slice(at, n) for c in kept), lists], [*kept, ids]
                if checked:
                    was = batch.column(text).slice(at, n).to_pylist()
                    columns.append(pa.array([a == (b or "") for a, b in zip(decode_ids(sent.value, tokens, offs), was, strict=True)], pa.bool_()))
                    names.append(checked)
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += n

    schema = docs.select(kept).schema.add(ids, T.ArrayType(T.IntegerType()))
    return map_batches(docs, run, schema.add(checked, "boolean") if checked else schema)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the column ``text``, the text of each list of ids; null and empty lists give the empty text.

    ``decode(encode(x))`` is x, but for the space mark U+2581 itself, which comes back as a space, and characters that a model
    without bytes lacks. An id that is null or outside the model raises an error.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten().to_numpy()
            out = decode_ids(sent.value, flat, np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, text])

    return map_batches(docs, run, docs.select(kept).schema.add(text, "string"))
