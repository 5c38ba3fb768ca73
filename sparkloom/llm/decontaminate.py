"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: a shard holds the postings (term ->
sorted token positions) of every token of a bounded run of documents and is one
stored row. A test phrase is answered inside each shard by intersecting
offset-adjusted position lists, beginning with the term that is rarest in the
whole corpus. No posting is shuffled; only term counts and hits are.

Two kinds of matches are returned. Exact: a window of ``window`` consecutive
words of an item. Proximity: all words of an item's rarest window, each as
often as there, within ``window + SLOP`` words of one document in any order.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
Null and empty texts have no words; their rows are returned with zeros. Texts
of any length are read whole; one of more than ``SHARD_TOKENS`` words is a
shard of its own. Repeated documents are judged row by row, null ids as well.
Items without words have no windows; an item of fewer than ``window`` words is
one window. Repeated items are looked up once and listed once. Items with a
null id mark words but are not listed. Windows of equally rare words are taken
in the order of the item. Without items no word is hit; without documents there
are no rows. Other columns of either table are left alone, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, tidy

#: A shard is closed at this many tokens; one longer document is a shard of its own.
SHARD_TOKENS = 1_000_000
#: Test items are looked up in blocks of at most about this many bytes of text.
BLOCK_BYTES = 4 << 20
#: Words that may stand between those of a proximity match.
SLOP = 5

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

SHARD = "shard bigint, docs array<bigint>, starts array<int>, lengths array<int>, terms array<binary>, counts array<int>, positions binary"
_BIG = pa.schema(
    [
        ("shard", pa.int64()),
        ("docs", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int32())),
        ("lengths", pa.list_(pa.int32())),
        ("terms", pa.list_(pa.binary())),
        ("counts", pa.list_(pa.int32())),
        ("positions", pa.binary()),
    ]
)


def words(text: bytes | str | None) -> list[bytes]:
    """The words of one text."""
    if not text:
        return []
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_FOLD).split()


def _shard(number: int, docs: list, ids: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
    lengths = np.array([len(x) for x in ids], np.int32)
    starts = np.zeros(len(ids), np.int32)
    starts[1:] = np.cumsum(lengths[:-1] + 1)  # one empty place between documents: no phrase crosses it
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    place = np.arange(len(flat), dtype=np.int32) + np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    order = np.argsort(flat, kind="stable")
    flat, place = flat[order], place[order]
    at = np.flatnonzero(np.diff(flat, prepend=-1))
    counts = np.diff(np.append(at, len(flat)))
    gaps = np.diff(place, prepend=0)
    gaps[at] = place[at]  # gaps within a term's list store smaller than positions
    row = {
        "shard": number, "docs": docs, "starts": starts, "lengths": lengths, "terms": [names[t] for t in flat[at]],
        "counts": counts.astype(np.int32), "positions": gaps.astype("<i4").tobytes(),
    }
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _BIG], schema=_BIG)


def store_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of all words of ``docs``, one row a shard (``SHARD``), written to the shared folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = defaultdict(count().__next__)
        held, ids, size = [], [], 0
        number = (TaskContext.get().partitionId() << 32) - 1
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = words(text)
                ids.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                held.append(doc)
                size += len(found) + 1
                if size >= SHARD_TOKENS:
                    number += 1
                    yield _shard(number, held, ids, list(known))
                    held, ids, size = [], [], 0
                    known = defaultdict(count().__next__)
        if held:
            yield _shard(number + 1, held, ids, list(known))

    at = scratch(docs.sparkSession, "postings")
    docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")).mapInArrow(tidy(run), SHARD).write.option("compression", "zstd").parquet(at)
    return docs.sparkSession.read.schema(SHARD).parquet(at)


def term_counts(index: DataFrame) -> DataFrame:
    """t (binary) and n, the number of times it occurs in the corpus; written to the shared folder."""
    at = scratch(index.sparkSession, "terms")
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    pairs.groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.counts").alias("n")).write.option("compression", "zstd").parquet(at)
    return index.sparkSession.read.schema("t binary, n bigint").parquet(at)


class Shard:
    """Lookups in one shard of terms by their number in ``asked``."""

    def __init__(self, b: pa.RecordBatch, k: int, asked: pa.Array):
        self.starts, self.lengths = (np.array(b.column(c)[k].values, np.int64) for c in ("starts", "lengths"))
        self.gaps = np.frombuffer(b.column("positions")[k].as_py(), "<i4").astype(np.int64)
        self.ends = np.cumsum(np.array(b.column("counts")[k].values, np.int64))
        self.of = pc.fill_null(pc.index_in(asked, value_set=b.column("terms")[k].values), -1).to_numpy(zero_copy_only=False)
        self.read: dict[int, np.ndarray] = {}

    def postings(self, term: int) -> np.ndarray:
        """The places of a term that the shard has."""
        if term not in self.read:
            i = self.of[term]
            self.read[term] = np.cumsum(self.gaps[(self.ends[i - 1] if i else 0) : self.ends[i]])
        return self.read[term]

    def phrase(self, terms: list[int], order: list[int]) -> np.ndarray:
        """Places at which ``terms`` stand one after another. ``order``: offsets, the rarest term's first."""
        found = self.postings(terms[order[0]]) - order[0]
        for k in order[1:]:
            at = self.postings(terms[k])
            i = np.searchsorted(at, found + k)
            found = found[at[np.minimum(i, len(at) - 1)] == found + k]
            if not len(found):
                break
        return found

    def near(self, terms: list[int], order: list[int], slop: int) -> list[tuple[int, int]]:
        """Spans of at most ``len(terms) + slop`` words that hold all ``terms``, each as often as asked, in any order.

        One span is returned for each place of the rarest term: the narrowest, then the leftmost.
        """
        need: dict[int, int] = defaultdict(int)
        for t in terms:
            need[t] += 1
        reach, rare, out = len(terms) + slop, terms[order[0]], set()
        places = self.postings(rare)
        for k in order[1:]:  # places without the next term around them go
            at = self.postings(terms[k])
            i = np.searchsorted(at, places - reach + 1)
            places = places[(i < len(at)) & (at[np.minimum(i, len(at) - 1)] < places + reach)]
            if not len(places):
                return []
        lists = {t: self.postings(t) for t in need}
        for p in places.tolist():
            d = int(np.searchsorted(self.starts, p, "right")) - 1
            lo, hi = self.starts[d], self.starts[d] + self.lengths[d]
            local = sorted((int(x), t) for t, at in lists.items() for x in at[np.searchsorted(at, max(lo, p - reach + 1)) : np.searchsorted(at, min(hi, p + reach))])
            have: dict[int, int] = defaultdict(int)
            missing, left, best = len(need), 0, None
            for right, (x, t) in enumerate(local):
                have[t] += 1
                missing -= have[t] == need[t]
                while not missing:
                    y, u = local[left]
                    if y <= p <= x and x - y < reach and (best is None or x - y < best[1] - best[0]):
                        best = (y, x)
                    have[u] -= 1
                    missing += have[u] < need[u]
                    left += 1
            if best:
                out.add((best[0], best[1] + 1))
        return sorted(out)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


class Plan:
    """A block's distinct windows as rows of term numbers, by length, and the proximity window of each item."""

    def __init__(self, terms: list[bytes], counts: np.ndarray, items: list[np.ndarray], window: int):
        self.asked = pa.array(terms, pa.binary())
        self.windows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.near: list[tuple[int, list[int], list[int]]] = []
        by: dict[int, list[int]] = defaultdict(list)
        for k, x in enumerate(items):
            if len(x):
                by[min(window, len(x))].append(k)
        for n, members in sorted(by.items()):
            views = [np.lib.stride_tricks.sliding_window_view(items[k], n) for k in members]
            owner = np.repeat(np.array(members), [len(v) for v in views])
            rows = np.concatenate(views)
            known = (counts[rows] > 0).all(1)  # a word that the corpus doesn't have answers no phrase
            rows, owner = rows[known], owner[known]
            if not len(rows):
                continue
            found, inverse = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([inverse.ravel(), owner], 1), axis=0)
            ends = np.searchsorted(pairs[:, 0], np.arange(len(found) + 1))
            self.windows.append((found, np.argsort(counts[found], 1, kind="stable"), pairs[:, 1], ends))
            rarity = np.sort(counts[rows], 1)
            first: dict[int, tuple] = {}
            for i, k in enumerate(owner.tolist()):
                if k not in first or tuple(rarity[i].tolist()) < first[k][0]:
                    first[k] = (tuple(rarity[i].tolist()), i)
            for k, (_, i) in first.items():
                self.near.append((k, rows[i].tolist(), np.argsort(counts[rows[i]], kind="stable").tolist()))

    def exact(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, length and item of every hit."""
        at, length, item = [_NONE], [_NONE], [_NONE]
        for rows, order, owners, ends in self.windows:
            for u in np.flatnonzero((shard.of[rows] >= 0).all(1)).tolist():
                found = shard.phrase(rows[u].tolist(), order[u].tolist())
                if len(found):
                    for k in owners[ends[u] : ends[u + 1]].tolist():
                        at.append(found)
                        length.append(np.full(len(found), rows.shape[1]))
                        item.append(np.full(len(found), k))
        return np.concatenate(at), np.concatenate(length), np.concatenate(item)

    def close(self, shard: Shard, slop: int) -> list[tuple[int, int, int]]:
        """Item, start and stop of every proximity match."""
        return [(k, lo, hi) for k, terms, order in self.near if (shard.of[terms] >= 0).all() for lo, hi in shard.near(terms, order, slop)]


_NONE = np.zeros(0, np.int64)


def _plan(items: list[tuple], counts: DataFrame, window: int):
    """What a block's plan is made of: terms, their counts, and the items as term numbers. Its size is bounded by the block's."""
    found = [words(t) for _, t in items]
    terms = sorted({w for x in found for w in x})
    at = {t: i for i, t in enumerate(terms)}
    n = np.zeros(len(terms), np.int64)
    asked = counts.sparkSession.createDataFrame([(bytearray(t),) for t in terms], "t binary")
    for r in counts.join(F.broadcast(asked), "t").collect():  # no more rows than the block has terms
        n[at[bytes(r.t)]] = r.n
    return terms, n, [np.array([at[w] for w in x], np.int32) for x in found], window


_HIT = "shard bigint, doc int, spans array<struct<at: int, stop: int>>, items array<string>, near array<string>"


def _look_up(index: DataFrame, made_of: tuple, names: list[str | None], slop: int) -> DataFrame:
    """By document with a hit of the block: its merged spans of hit words, the items, and those with a proximity match."""
    shared = index.sparkSession.sparkContext.broadcast((made_of, names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_of, names = shared.value
        plan = Plan(*made_of)
        for b in batches:
            for k, number in enumerate(b.column("shard").to_pylist()):
                shard = Shard(b, k, plan.asked)
                at, length, item = plan.exact(shard)
                docs: dict[int, tuple] = defaultdict(lambda: ([], set(), set()))
                doc = shard.doc_of(at)
                order = np.lexsort((at, doc))
                for d, lo, n, i in zip(*(x[order].tolist() for x in (doc, at - shard.starts[doc], length, item)), strict=True):
                    spans, found, _ = docs[d]
                    if spans and lo <= spans[-1]["stop"]:
                        spans[-1]["stop"] = max(spans[-1]["stop"], lo + n)
                    else:
                        spans.append({"at": lo, "stop": lo + n})
                    found.add(names[i])
                for i, lo, _ in plan.close(shard, slop):
                    docs[int(shard.doc_of(np.array([lo]))[0])][2].add(names[i])
                if docs:
                    cols = [[number] * len(docs), list(docs), *([f(x[j]) for x in docs.values()] for j, f in ((0, list), (1, _listed), (2, _listed)))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _HITS, strict=True)], schema=_HITS)

    return index.mapInArrow(tidy(run), _HIT)


_HITS = pa.schema(
    [("shard", pa.int64()), ("doc", pa.int32()), ("spans", pa.list_(pa.struct([("at", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))]
)


def _listed(names: set[str | None]) -> list[str]:
    return sorted(x for x in names if x is not None)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[list[tuple]]:
    """The test items in blocks, one at a time on the driver, each of a size that is checked before it gets there."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).where(F.col("t").isNotNull()).distinct()
    size = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield [(r.i, r.t) for r in part.orderBy("i", "t").collect()]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slop: int = SLOP
) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit (words inside an occurring window), item_ids and near_ids (of items with a proximity match), both sorted as strings."""
    spark = docs.sparkSession
    index = store_index(docs, id_col, text_col)
    counts = term_counts(index)
    path = scratch(spark, "hits")
    spark.createDataFrame([], _HIT).write.parquet(f"{path}/block=0")
    for k, items in enumerate(_items(benchmark, item_col, item_text_col), 1):
        _look_up(index, _plan(items, counts, window), [i for i, _ in items], slop).write.parquet(f"{path}/block={k}")
    hits = spark.read.schema(_HIT).parquet(path)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["end"], x["at"]))).alias("n"), F.greatest(a["end"], x["stop"]).alias("end")),
        lambda a: a["n"],
    )
    listed = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    hits = hits.groupBy("shard", "doc").agg(covered.alias("n_hit"), listed("items").alias("item_ids"), listed("near").alias("near_ids"))
    rows = index.select("shard", F.posexplode(F.arrays_zip("docs", "lengths")).alias("doc", "x"))
    none = F.array().cast("array<string>")
    return rows.join(hits, ["shard", "doc"], "left").select(
        F.col("x.docs").alias("doc_id"),
        F.col("x.lengths").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("near_ids", none).alias("near_ids"),
    )


def proximity_matches(index: DataFrame, counts: DataFrame, phrases: list[str], slop: int = SLOP) -> DataFrame:
    """Places where all words of a phrase stand within its length plus ``slop`` words of a stored index: doc_id, phrase, start, stop (word numbers).

    Phrases without words match nothing.
    """
    asked = [(p, p) for p in dict.fromkeys(phrases) if words(p)]
    longest = max((len(words(p)) for p, _ in asked), default=1)
    shared = index.sparkSession.sparkContext.broadcast((_plan(asked, counts, longest), [p for p, _ in asked]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_of, names = shared.value
        plan = Plan(*made_of)
        for b in batches:
            for k in range(b.num_rows):
                shard, out = Shard(b, k, plan.asked), []
                docs = b.column("docs")[k].as_py()
                for i, lo, hi in plan.close(shard, slop):
                    d = int(shard.doc_of(np.array([lo]))[0])
                    out.append((docs[d], names[i], lo - int(shard.starts[d]), hi - int(shard.starts[d])))
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "phrase", "start", "stop"), map(list, zip(*out, strict=True)), strict=True)))

    return index.mapInArrow(tidy(run), "doc_id bigint, phrase string, start bigint, stop bigint")
