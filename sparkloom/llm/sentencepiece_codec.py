"""SentencePiece encoding and decoding of whole texts by a streaming Viterbi search.

The search (``pieces.Encoder``) keeps the places that a piece can still reach
and commits ids whenever all surviving paths share a boundary. It finds the most
probable segmentation under the probabilities that ``lm_score`` sums over.

Null texts have null ids, empty texts have none; a text that holds U+2581
itself comes back with a space there (``round_trip`` false). Texts of any length
are encoded whole. Of equally probable segmentations that whose pieces are
longest from the end on is taken. Repeated rows are encoded alike; an empty
table gives no rows. Other columns are kept; ``ids``, ``n_ids``, ``ids_sha256`` and
``round_trip`` replace columns of these names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy
from .pieces import Vocabulary, decode, encode

_NEW = [("ids", T.ArrayType(T.IntegerType())), ("n_ids", T.LongType()), ("ids_sha256", T.StringType()), ("round_trip", T.BooleanType())]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` with the ids of each text, their number, the SHA-256 of them as little-endian 32-bit integers, and whether decoding gives the text back.

    Without ``with_ids`` the ids stay in the worker and only their digests leave.
    """
    kept = [f for f in docs.schema.fields if f.name not in {n for n, _ in _NEW}]
    new = [(n, t) for n, t in _NEW if with_ids or n != "ids"]
    at = [f.name for f in kept].index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            found, counts, digests, same = [], [], [], []
            for text in b.column(at).to_pylist():
                if text is None:
                    found.append(None)
                    counts.append(0)
                    digests.append(None)
                    same.append(True)
                    continue
                ids = encode(v, text)
                flat = np.array(ids, np.int32)
                found.append(flat)
                counts.append(len(ids))
                digests.append(hashlib.sha256(flat.astype("<i4").tobytes()).hexdigest())
                same.append(decode(v, ids) == text)
            cols = {"n_ids": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "round_trip": pa.array(same, pa.bool_())}
            if with_ids:
                ends = np.append(0, np.cumsum(counts)).astype(np.int32)
                values = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int32)])
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([x is None for x in found]))
            yield pa.RecordBatch.from_arrays([*b.columns, *(cols[n] for n, _ in new)], names=[*b.schema.names, *(n for n, _ in new)])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(tidy(run), T.StructType([*kept, *(T.StructField(n, t) for n, t in new)]))


def decode_documents(coded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``coded`` with the text of its ids; null ids give null."""
    kept = [f for f in coded.schema.fields if f.name != text_col]
    at = [f.name for f in kept].index(ids_col)
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            texts = [None if ids is None else decode(v, ids) for ids in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    return coded.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(tidy(run), T.StructType([*kept, T.StructField(text_col, T.StringType())]))
