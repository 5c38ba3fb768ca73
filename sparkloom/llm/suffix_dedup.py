"""Suffix-array dedup: remove every byte that a repeated string of ``length`` bytes covers.

A full suffix array of the corpus is not needed for that. Every window of
``length`` bytes picks an anchor by its content alone (the least hash among its
``GRAM``-byte substrings), so equal windows have their anchors at the same
place. A context is what the windows of one anchor cover; only contexts whose
anchor occurs more than once can hold a repeated window:

1. anchors are counted by hash, and those that occur once are left out;
2. equal contexts become one entry with their number, so copies cost nothing;
3. every entry goes through a distributed merge sort of suffixes, in the order
   of (hash of the anchor, suffix from the anchor on). Tasks sort and
   front-code runs, and cut them at even steps of the hash, so that ranges need
   no sample. In each range a loser tree merges the runs; it knows how much of
   its prefix each head shares with the last suffix put out and never compares
   that again;
4. neighbours that share an anchor form a group. The common prefixes right of
   the anchor and the common suffixes left of it tell which windows are equal.

An anchor in more than ``HOT`` contexts (the edge of a very common passage) is
not compared in one group. Its contexts are cut into ``CLASSES`` by where the
anchor stands in the window; windows of a class share a longer anchor, and what
is equal within a class becomes one entry again. Classes that are still hot
are cut into single windows, each its own anchor. All are entries of the sort.

Matches never cross documents. Null texts are empty. Texts may be of any
length; they are looked at in parts. Repeated rows are copies of each other.
Offsets count bytes of UTF-8. Empty tables give empty results. Other columns
are kept. A row is known by a 128-bit hash of its id and text, and equal
contexts by a 128-bit hash of their bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, groups_of, key_filter, let_through, scratch, tidy

LENGTH = 200
GRAM = 64
#: Bytes of a text that are looked at together.
PART = 1 << 18
#: Entries of a range, about.
RANGE_ROWS = 40_000
#: Contexts of an anchor that are compared as one group, at most, and the classes that those of others are cut into.
HOT = 2048
CLASSES = 8
#: Groups up to this size are compared pair by pair.
SMALL = 8

_RNG = np.random.default_rng(20240302)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POS = np.uint64(20)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 14)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every run of windows with one anchor: hash and place of the anchor, first and last window start."""
    found: list[tuple] = []
    for at in range(0, max(0, len(text) - length + 1), PART):
        part = np.frombuffer(text, np.uint8, min(len(text) - at, PART + length - 1), at)
        up, down = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:-1], out=total[1:])
        h = (total[gram:] - total[:-gram]) * down[: len(part) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        width = length - gram + 1
        n = len(h)
        rows = -(-n // width)
        value = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        value[:n] = (h >> _POS << _POS) | np.arange(n, dtype=np.uint64)
        grid = value.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        starts = len(part) - length + 1
        place = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:] - 1, starts - 1)
        p = place[first]
        # the least of many hashes is small; mixed again they are spread evenly
        found.append((h[p] * _BASE, p + at, first + at, last + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """How many bytes two strings share from the start; ``known`` of them aren't looked at."""
    m = min(len(a), len(b))
    x, y = a[known:m], b[known:m]
    if x == y:
        return m
    return known + (8 * len(x) - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()) // 8


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix lengths of sorted strings with the one before, and what follows."""
    shared = [common_prefix(a, b) for a, b in zip([b"", *strings], strings, strict=False)]
    return shared, [s[k:] for s, k in zip(strings, shared, strict=True)]


def front_decode(shared: Iterable[int], tails: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
    s = b""
    for k, t in zip(shared, tails, strict=True):
        s = s[:k] + t
        yield s, k


def merge_suffixes(runs: list[Iterable[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(string, prefix shared with the one before, run) of sorted runs of (string, prefix shared with the one before in its run).

    A loser keeps the length of the prefix it shares with the string that beat
    it, so a match begins behind what both sides are known to share, and needs
    no look at the strings if these lengths differ: the longer one is smaller.
    """
    its = [iter(r) for r in runs]
    size = 1
    while size < max(1, len(its)):
        size *= 2
    text: list[bytes | None] = [None] * size
    known = [0] * size

    def step(i: int) -> None:
        text[i], known[i] = next(its[i], (None, 0)) if i < len(its) else (None, 0)

    def match(a: int, b: int) -> tuple[int, int]:
        x, y = text[a], text[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        k = common_prefix(x, y, known[a])
        a_first = (len(x) < len(y) or len(x) == len(y) and a < b) if k == min(len(x), len(y)) else x[k] < y[k]
        win, lose = (a, b) if a_first else (b, a)
        known[lose] = k
        return win, lose

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for i in range(size):
        step(i)
        known[i] = 0
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = match(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if size > 1 else 0
    while text[top] is not None:
        yield text[top], known[top], top
        step(top)
        node = (top + size) // 2
        while node:
            top, losers[node] = match(top, losers[node])
            node //= 2


def equal_windows(right: list[int], lefts: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each of a group's contexts the offsets (first, last) of its windows that another context holds too.

    ``right``: prefix shared with the one before, right of the anchor;
    ``lefts``: what stands left of it, read backwards; a window at offset o
    holds o bytes left of the anchor, ``low`` <= o <= ``high``.
    """
    n = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n <= SMALL:
        for i in range(n):
            r = length
            for j in range(i + 1, n):
                r = min(r, right[j])
                lo = max(length - r, int(low[i]), int(low[j]))
                hi = min(int(high[i]), int(high[j]))
                if lo <= hi and lo <= (l := common_prefix(lefts[i], lefts[j])):
                    out[i].append((lo, min(l, hi)))
                    out[j].append((lo, min(l, hi)))
        return out
    order = sorted(range(n), key=lefts.__getitem__)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    left = np.array([0] + [common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)])
    rights = np.array(right)
    rights[0] = 0
    for o in range(int(low.min()), int(high.max()) + 1):
        open_ = np.flatnonzero((low <= o) & (o <= high))
        if len(open_) < 2:
            continue
        key = np.cumsum(rights < length - o)[open_] * (n + 1) + np.cumsum(left < o)[back[open_]]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        for i in open_[count[inverse] > 1].tolist():
            if out[i] and out[i][-1][1] == o - 1:
                out[i][-1] = (out[i][-1][0], o)
            else:
                out[i].append((o, o))
    return out


def _pack(p, first, last):
    """First window start, anchor and last window start in one number."""
    return (first << 20) | ((p - first) << 10) | (last - first)


def _unpack(at: int) -> tuple[int, int, int]:
    first = at >> 20
    return first + (at >> 10 & 0x3FF), first, first + (at & 0x3FF)


def classes_of(length: int, gram: int) -> list[tuple[int, int]]:
    """By tag the offsets (first, last) of an anchor in its windows: all; then those of each class; then each alone.

    The windows of a tag share ``length - last + first`` bytes from ``first`` bytes left of the anchor on.
    """
    wide = length - gram
    step = -(-(wide + 1) // CLASSES)
    return [(0, wide), *((a, min(wide, a + step - 1)) for a in range(0, wide + 1, step)), *((o, o) for o in range(wide + 1))]


_KEPT = "h bigint, c binary, rid binary, at bigint"
_ENTRY = "h bigint, tag int, c binary, n bigint, rid binary, at bigint"
_FOUND = "c binary, low int, high int"


def repeated_spans(source: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """rid, start and stop of runs of repeated windows; ``source``: rid (binary), text (binary)."""
    spark = source.sparkSession

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [anchors(t, length, gram)[0] for t in b.column(0).to_pylist()]
            value, n = np.unique(np.concatenate(h), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(value.view(np.int64)), "n": pa.array(n)})

    long = source.where(F.octet_length("text") >= length)
    # the keys of a join are tables of their own, not sums above a shuffle: only then can Spark split a hot key's rows
    often = cut(long.select("text").mapInArrow(tidy(hashes), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ats, cs, rids = [], [], [], []
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, p, first, last = anchors(text, length, gram)
                at = _pack(p, first, last)
                # where a context's anchor is belongs to the context
                cs += [_digest(text[i : j + length], k, 0) for i, j, k in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)]
                rids += [rid] * len(h)
                hs.append(h.view(np.int64))
                ats.append(at)
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(cs, pa.binary()), pa.array(rids, pa.binary()), pa.array(np.concatenate(ats))], names=["h", "c", "rid", "at"])

    path = scratch(spark, "anchors")
    long.select("rid", "text").mapInArrow(tidy(places), _KEPT).join(often, "h", "left_semi").write.parquet(path)
    kept = spark.read.schema(_KEPT).parquet(path)
    contexts = _entries(kept.select("h", F.lit(0).alias("tag"), "c", F.lit(1).cast("bigint").alias("n"), "rid", "at"))
    hot = _hot(contexts)
    if hot is None:
        found = _compare(source, contexts, length, gram)
    else:
        classes, of_class = _cut_up(source, contexts.join(hot, "h", "left_semi"), False, length, gram)
        entries = contexts.join(hot, "h", "left_anti")
        still = _hot(classes)
        if still is not None:
            windows, of_window = _cut_up(source, classes.join(still, "h", "left_semi"), True, length, gram)
            entries = entries.unionByName(windows)
            classes = classes.join(still, "h", "left_anti")
        found = _compare(source, entries.unionByName(classes), length, gram)
        if still is not None:
            found = found.unionByName(_passed_on(found, of_window))
        found = found.unionByName(_passed_on(found, of_class))
    p = F.shiftright("at", 20) + F.shiftright("at", 10).bitwiseAND(0x3FF)
    return kept.join(found, "c").select("rid", (p - F.col("high")).alias("start"), (p - F.col("low") + length).alias("stop"))


def _digest(data: bytes, at: int, tag: int) -> bytes:
    """What equal entries of a tag share: their bytes, and where the anchor stands in them."""
    return xxhash.xxh3_128_digest(data, (at & 0xFFFFF) << 8 | tag)


def _entries(rows: DataFrame) -> DataFrame:
    """Rows of equal content (``c``) as one, written."""
    path = scratch(rows.sparkSession, "entries")
    found = rows.groupBy("c").agg(F.min(F.struct("h", "tag", "rid", "at")).alias("x"), F.sum("n").alias("n"))
    found.select("x.h", "x.tag", "c", "n", "x.rid", "x.at").write.parquet(path)
    return rows.sparkSession.read.schema(_ENTRY).parquet(path)


def _hot(entries: DataFrame) -> DataFrame | None:
    """The anchors with more than ``HOT`` different entries, if any."""
    hot = cut(entries.groupBy("h").count().where(F.col("count") > HOT).select("h"))
    return None if hot.isEmpty() else hot


def _gathered(source: DataFrame, entries: DataFrame) -> DataFrame:
    """rid, text and xs (h, tag, c, n and at of the entries in it) of the rows that stand for an entry.

    A repeated row comes as often as it is there; that its entries are then met again changes nothing, as they count as repeated.
    """
    texts = let_through(source.select("rid", "text"), "rid", key_filter(entries, "rid"))
    lists = entries.groupBy("rid").agg(F.collect_list(F.struct("h", "tag", "c", "n", "at")).alias("xs"))
    return texts.join(lists, "rid").select("rid", "text", "xs")


def _cut_up(source: DataFrame, entries: DataFrame, single: bool, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The entries cut into classes or single windows: new entries, without those whose anchor occurs once, and c and whole (the c of the entry cut) of every part."""
    tags = classes_of(length, gram)
    singles = len(tags) - (length - gram + 1)
    chosen = range(singles, len(tags)) if single else range(1, singles)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for rid, text, xs in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for x in xs:
                    p, first, last = _unpack(x["at"])
                    p += tags[x["tag"]][0]  # where the anchor of the whole context stands
                    for tag in chosen:
                        a, z = tags[tag]
                        start, stop = max(first, p - z), min(last, p - a)
                        if start > stop:
                            continue
                        at = _pack(p - a, start, stop)
                        h = xxhash.xxh3_64_intdigest(text[p - a : p - z + length], tag)
                        row = (h - (1 << 64) if h >> 63 else h, tag, _digest(text[start : stop + length], at, tag), x["n"], rid, at, x["c"])
                        for c, value in zip(cols, row, strict=True):
                            c.append(value)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "tag", "c", "n", "rid", "at", "whole"])

    path = scratch(source.sparkSession, "parts")
    _gathered(source, entries).mapInArrow(tidy(run), f"{_ENTRY}, whole binary").write.parquet(path)
    parts = source.sparkSession.read.schema(f"{_ENTRY}, whole binary").parquet(path)
    found = _entries(parts.select("h", "tag", "c", "n", "rid", "at"))
    often = cut(found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    return found.join(often, "h", "left_semi"), parts.select("c", "whole")


def _passed_on(found: DataFrame, parts: DataFrame) -> DataFrame:
    """What was found for parts, for the wholes that hold them."""
    return parts.join(found, "c").select(F.col("whole").alias("c"), "low", "high")


def _compare(source: DataFrame, entries: DataFrame, length: int, gram: int) -> DataFrame:
    """c, low and high: the entries' windows that occur again, by the offsets of the anchor in them."""
    spark = source.sparkSession
    tags = classes_of(length, gram)
    ranges = max(1, -(-entries.count() // RANGE_ROWS))

    def suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        before = None
        for b in batches:
            for rid, text, xs in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if rid == before:
                    continue
                before = rid
                for x in xs:
                    p, first, last = _unpack(x["at"])
                    key = (x["h"] & _ALL).to_bytes(8) + bytes((x["tag"],)) + text[p : last + length]
                    held.append((key, text[first:p][::-1], x["c"], p - first, p - last, min(x["n"], 2)))
                    if len(held) >= RANGE_ROWS:
                        yield from _runs(held, ranges)
                        held = []
        if held:
            yield from _runs(held, ranges)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups_of(batches, "range"):
            yield from _groups(t, tags, length)

    runs = _gathered(source, entries).mapInArrow(tidy(suffixes), "range bigint, shared binary, sizes binary, tails binary, left_sizes binary, lefts binary, cs binary, rows binary")
    found = runs.repartition("range").sortWithinPartitions("range").mapInArrow(tidy(join), _FOUND)
    path = scratch(spark, "found")
    found.write.parquet(path)
    return spark.read.schema(_FOUND).parquet(path)


_ALL = (1 << 64) - 1
#: Bytes of an entry's key before its suffix: hash of the anchor, and tag.
PREFIX = 9


def _runs(held: list[tuple], ranges: int) -> Iterator[pa.RecordBatch]:
    """Sorted front-coded runs of what a task holds, one a range."""
    held.sort()
    at = 0
    number = [int.from_bytes(x[0][:8]) * ranges >> 64 for x in held]
    while at < len(held):
        end = bisect_right(number, number[at], at)
        rows = held[at:end]
        shared, tails = front_code([x[0] for x in rows])
        lefts = [x[1] for x in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([number[at]], pa.int64())]
            + [
                pa.array([x], pa.binary())
                for x in (
                    np.array(shared, "<i4").tobytes(), np.array([len(x) for x in tails], "<i4").tobytes(), b"".join(tails),
                    np.array([len(x) for x in lefts], "<i4").tobytes(), b"".join(lefts), b"".join(x[2] for x in rows),
                    np.array([x[3:] for x in rows], "<i4").tobytes(),
                )
            ],
            names=["range", "shared", "sizes", "tails", "left_sizes", "lefts", "cs", "rows"],
        )
        at = end


def _pieces(sizes: bytes, data: bytes) -> Iterator[bytes]:
    at = 0
    for n in np.frombuffer(sizes, "<i4").tolist():
        yield data[at : at + n]
        at += n


def _groups(t: pa.Table, tags: list[tuple[int, int]], length: int) -> Iterator[pa.RecordBatch]:
    """Merge a range's runs and compare the entries of each anchor."""
    runs, lefts, rows = [], [], []
    for r in t.to_pylist():
        runs.append(front_decode(np.frombuffer(r["shared"], "<i4").tolist(), _pieces(r["sizes"], r["tails"])))
        lefts.append(_pieces(r["left_sizes"], r["lefts"]))
        numbers = np.frombuffer(r["rows"], "<i4").reshape(-1, 3).tolist()
        rows.append(zip(_pieces(np.full(len(numbers), 16, "<i4").tobytes(), r["cs"]), numbers, strict=True))
    out: list[tuple[bytes, int, int]] = []
    group: list[tuple] = []  # shared prefix, left, c, (high, low, n)
    shift = 0

    def close() -> None:
        if len(group) == 1:
            _, _, c, (high, low, n) = group[0]
            if n > 1:
                out.append((c, low + shift, high + shift))
            return
        high, low = (np.array([g[3][k] for g in group]) for k in (0, 1))
        for (_, _, c, (up, down, n)), spans in zip(group, equal_windows([g[0] for g in group], [g[1] for g in group], low, high, length), strict=True):
            # what stands for several equal contexts occurs again as a whole
            out.extend((c, a + shift, b + shift) for a, b in (spans if n == 1 else [(down, up)]))

    for key, shared, run in merge_suffixes(runs):
        first, last = tags[key[PREFIX - 1]]
        if shared < PREFIX + length - last + first and group:
            close()
            group = []
        shift = first
        c, row = next(rows[run])
        group.append((shared - PREFIX, next(lefts[run]), c, row))
        if len(out) >= 10_000:
            yield _found(out)
            out = []
    if group:
        close()
    if out:
        yield _found(out)


def _found(out: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["c", "low", "high"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_NEW = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, kept (binary: the bytes left).

    Columns of these names are replaced.
    """
    others = [c for c in docs.columns if c != text_col and c not in _NEW]
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(bytearray()))
    known = F.when(F.col(id_col).isNull(), "null").otherwise(F.concat(F.lit("id "), F.col(id_col).cast("string"), F.lit("\n")))
    source = docs.select(F.unhex(F.md5(F.concat(known.cast("binary"), text))).alias("rid"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))
    path = scratch(docs.sparkSession, "spans")
    found = repeated_spans(source.select("rid", "text"), length, gram)
    # a repeated row finds its spans once more with each copy
    found.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).write.parquet(path)
    spans = docs.sparkSession.read.schema("rid binary, spans array<struct<start: bigint, stop: bigint>>").parquet(path)
    bits = key_filter(spans, "rid")
    hit = let_through(source, "rid", bits).join(spans, "rid").select("text", "spans", "row")
    row = hit.schema["row"].dataType

    def cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                gone = merged([(x["start"], x["stop"]) for x in found])
                edges = [0, *(e for s in gone for e in s), len(text)]
                kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                rows.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(2), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["row", *_NEW])

    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BinaryType()]
    some = hit.mapInArrow(tidy(cut_out), T.StructType([T.StructField("row", row), *(T.StructField(n, k) for n, k in zip(_NEW, kinds, strict=True))]))
    def plain(rows: DataFrame) -> DataFrame:
        return rows.select(
            "rid",
            "row",
            F.octet_length("text").cast("bigint").alias("n_bytes"),
            F.lit(0).cast("bigint").alias("n_removed"),
            F.lit(0).cast("bigint").alias("n_spans"),
            F.sha2("text", 256).alias("kept_sha256"),
            (F.col("text") if with_text else F.lit(None).cast("binary")).alias("kept"),
        )

    # what a row without repeats returns is taken before the join, so that no text is shuffled unless asked for, and then
    # only those that the filter holds
    if with_text:
        rest = plain(let_through(source, "rid", bits)).join(spans.select("rid"), "rid", "left_anti")
        rest = rest.unionByName(plain(let_through(source, "rid", bits, held=False))).drop("rid")
    else:
        rest = plain(source).join(spans.select("rid"), "rid", "left_anti").drop("rid")
    return some.unionByName(rest).select("row.*", *(_NEW if with_text else _NEW[:-1]))
