"""Non-code ranges of source text: comments, strings, characters and header names, by a scanner whose chunks compose.

A lines table (doc, line_no, line) is cut into chunks of lines. What a chunk
does to the scanner is a small map from the state in which it is entered to the
state in which it is left: code, a line comment that a backslash carries on, a
block comment, a string or character that a backslash carries on, or a raw
string with its delimiter. A state that a map doesn't name is left as it was
entered, so the delimiters of a whole text need not be known. Maps compose, and
composing is associative: they are put together ``FAN`` at a time, level by
level, and entry states come back down the same levels, so a text of any length
is scanned in parallel and no task holds more than ``FAN`` maps or one chunk.

Then each chunk is scanned from its entry state. A range within a chunk is
complete; one that is still open at the end of a chunk ends where the first
later chunk that closes it says so, or at the end of the text.

Ranges are byte places (end excluded): line comments end before their newline
and go on behind a backslash at its end; block comments, strings and raw strings
without an end go to the end of the text, but a string or character ends before
a newline without backslash. Prefixes (``u8``, ``u``, ``U``, ``L``) belong to
their string or character. Ticks within numbers are no characters. Nested names
of headers are ranges in ``#include <..>`` lines only. Null lines count as
empty; a table without lines gives no ranges; rows of other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

#: Lines of a chunk, and maps that one step puts together.
LINES = 256
FAN = 64

#: States besides raw strings, whose state is ``R`` and the delimiter.
CODE, LINE, BLOCK, STRING, CHAR = "c", "/", "*", '"', "'"
_NEXT = re.compile(
    rb"""^[ \t]*\#[ \t]*include[ \t]*(?P<header><[^>\n]*>)
    |(?P<raw>(?:u8|[uUL])?R"(?P<delimiter>[^\s()\\"]{0,16})\()
    |(?P<string>(?:u8|[uUL])?")
    |(?P<char>(?:u8|[uUL])?')
    |(?P<line>//)
    |(?P<block>/\*)
    |[0-9](?:'?[0-9A-Za-z_.\x80-\xff])*
    |[A-Za-z_\x80-\xff][0-9A-Za-z_\x80-\xff]*""",
    re.VERBOSE | re.MULTILINE,
)
_LINE_END = re.compile(rb"(?:[^\\\n]|\\\r?\n|\\)*")
_STRING_END = {q: re.compile(rb"(?:[^\\\n%b]|\\\r?\n|\\.)*" % q.encode()) for q in (STRING, CHAR)}
_RAW_END = re.compile(rb"\)([^\s()\\\"]{0,16})\"")
_KIND = {"raw": "raw_string", "string": "string", "char": "char", "line": "comment", "block": "comment", "header": "header"}
KIND_OF = {LINE: "comment", BLOCK: "comment", STRING: "string", CHAR: "char"}


def closed(data: bytes, at: int, state: str) -> int | None:
    """Where a state ends that holds at ``at``; None if it still holds at the end of ``data``."""
    if state == BLOCK or state[0] == "R":
        mark = b"*/" if state == BLOCK else b")" + state[1:].encode("latin-1") + b'"'
        end = data.find(mark, at)
        return None if end < 0 else end + len(mark)
    end = (_LINE_END if state == LINE else _STRING_END[state]).match(data, at).end()
    if end == len(data):
        return None
    return end + (data[end : end + 1] == state.encode())


def scan(data: bytes, state: str, found: list | None = None, known: dict[int, str] | None = None, seen: list[int] | None = None) -> str:
    """The state after ``data``, entered in ``state``.

    ``found`` gets (start, end or None, kind, whether it began before). ``known``: state at the end of a scan that goes
    on in code from a place; ``seen`` gets these places.
    """
    at = 0
    if state != CODE:
        end = closed(data, 0, state)
        if found is not None:
            found.append((0, end, KIND_OF.get(state, "raw_string"), True))
        if end is None:
            return state
        at = end
    while True:
        if known and at in known:
            return known[at]
        if seen is not None:
            seen.append(at)
        m = _NEXT.search(data, at)
        if m is None:
            return CODE
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "delimiter" else "raw"
        if kind is None:
            continue
        start, end = m.span(kind)
        if kind != "header":
            state = {"raw": "R", "string": STRING, "char": CHAR, "line": LINE, "block": BLOCK}[kind]
            if kind == "raw":
                state += m["delimiter"].decode("latin-1")
            end = closed(data, at, state)
        if found is not None:
            found.append((start, end, _KIND[kind], False))
        if end is None:
            return state
        at = end


def transitions(data: bytes) -> dict[str, str]:
    """What a chunk does to each state; states that are not named stay."""
    places: list[int] = []
    out = {CODE: scan(data, CODE, seen=places)}
    known = dict.fromkeys(places, out[CODE])
    for state in (LINE, BLOCK, STRING, CHAR, *sorted({"R" + m[1].decode("latin-1") for m in _RAW_END.finditer(data)})):
        out[state] = scan(data, state, known=known)
    return {k: v for k, v in out.items() if k != v}


def chunks_of(lines: DataFrame, size: int = LINES) -> DataFrame:
    """(doc, chunk, data: the lines with their ends, in bytes)."""
    rows = lines.select("doc", "line_no", F.coalesce("line", F.lit("")).alias("line"), F.floor((F.col("line_no") - 1) / size).cast("bigint").alias("chunk"))
    listed = F.array_sort(F.collect_list(F.struct("line_no", "line")))  # no more than ``size``
    joined = F.concat(F.array_join(F.transform(listed, lambda x: x.line), "\n"), F.lit("\n"))
    return rows.groupBy("doc", "chunk").agg(joined.cast("binary").alias("data"))


def _mapped(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return df.mapInArrow(fn, f"doc {df.schema['doc'].dataType.simpleString()}, {schema}")


def chunk_maps(chunks: DataFrame) -> DataFrame:
    """(doc, chunk, n_bytes, map)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x.as_py() for x in b.column("data")]
            maps = pa.array([list(transitions(x).items()) for x in data], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("chunk"), pa.array([len(x) for x in data], pa.int64()), maps], names=["doc", "chunk", "n_bytes", "map"])

    return _mapped(chunks, run, "chunk bigint, n_bytes bigint, map map<string,string>")


def applied(m: Column, state: Column) -> Column:
    return F.coalesce(F.try_element_at(m, state), state)


def composed(maps: Column) -> Column:
    """One map that does what the maps of a list do one after another."""
    keys = F.array_distinct(F.flatten(F.transform(maps, F.map_keys)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(maps, k, lambda s, m: applied(m, s))))


def entered(maps: DataFrame, fan: int = FAN) -> DataFrame:
    """``maps`` (doc, chunk, n_bytes, map) with the state and the byte place at which each chunk is entered.

    Steps are put together ``fan`` at a time until a document is one step; then
    each step gives its members their state, from the top down.
    """
    levels = [maps.select("doc", F.col("chunk").alias("at"), "n_bytes", "map")]
    most = maps.agg(F.max("chunk")).first()[0] or 0
    ordered = F.array_sort(F.collect_list(F.struct("at", "n_bytes", "map")), lambda a, b: (a["at"] - b["at"]).cast("int"))
    while most:
        most //= fan
        groups = levels[-1].groupBy("doc", F.floor(F.col("at") / fan).cast("bigint").alias("up")).agg(ordered.alias("steps"))
        total = F.aggregate("steps", F.lit(0).cast("bigint"), lambda s, x: s + x.n_bytes)
        groups = cut(groups)
        levels.append(groups.select("doc", F.col("up").alias("at"), total.alias("n_bytes"), composed(F.transform("steps", lambda x: x.map)).alias("map"), "steps"))
    state = levels[-1].select("doc", "at", F.lit(CODE).alias("state"), F.lit(0).cast("bigint").alias("start"))
    for level in levels[:0:-1]:
        rows = level.select("doc", "at", "steps").join(state, ["doc", "at"])
        begin = F.struct("state", "start", F.array().cast("array<struct<at:bigint,state:string,start:bigint>>").alias("out"))
        step = F.aggregate(
            "steps",
            begin,
            lambda s, x: F.struct(
                applied(x.map, s.state).alias("state"), (s.start + x.n_bytes).alias("start"), F.concat(s.out, F.array(F.struct(x["at"].alias("at"), s.state.alias("state"), s.start.alias("start")))).alias("out")
            ),
            lambda s: s.out,
        )
        state = rows.select("doc", F.explode(step).alias("x")).select("doc", "x.at", "x.state", "x.start")
    return state.withColumnRenamed("at", "chunk")


_TOKEN = re.compile(rb"[A-Za-z_\x80-\xff][0-9A-Za-z_\x80-\xff]*|[0-9](?:'?[0-9A-Za-z_.\x80-\xff])*|::|->|[^\s]")


def tokens(lines: DataFrame, size: int = LINES, fan: int = FAN) -> DataFrame:
    """(doc, line_no, at, token): names, numbers, ``::``, ``->`` and other characters one by one, outside non-code ranges."""
    chunks = cut(chunks_of(lines, size))
    states = entered(cut(chunk_maps(chunks)), fan)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i, (chunk, data, state, start) in enumerate(zip(*(b.column(c).to_pylist() for c in ("chunk", "data", "state", "start")), strict=True)):
                found: list = []
                scan(data, state, found)
                code = bytearray(data)
                for a, e, *_ in found:
                    e = len(data) if e is None else e
                    code[a:e] = re.sub(rb"[^\n]", b" ", data[a:e])
                line, last = chunk * size + 1, 0
                for m in _TOKEN.finditer(code):
                    line += code.count(b"\n", last, m.start())
                    last = m.start()
                    for col, x in zip(out, (i, line, start + m.start(), m[0].decode()), strict=True):
                        col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(out[0], pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], kinds, strict=True))], names=["doc", "line_no", "at", "token"])

    return cut(_mapped(chunks.join(states, ["doc", "chunk"]), run, "line_no bigint, at bigint, token string"))


def pieces_of(chunks: DataFrame) -> DataFrame:
    """(doc, chunk, start, end, kind): ranges of ``chunks`` (doc, chunk, data, state), in bytes of the chunk; null where they go beyond it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, (chunk, data, state) in enumerate(zip(*(b.column(c).to_pylist() for c in ("chunk", "data", "state")), strict=True)):
                found: list = []
                scan(data, state, found)
                for a, e, kind, before in found:
                    for col, x in zip(out, (i, chunk, None if before else a, e, kind), strict=True):
                        col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(out[0], pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], kinds, strict=True))], names=["doc", "chunk", "start", "end", "kind"])

    return _mapped(chunks, run, "chunk bigint, start bigint, end bigint, kind string")


def assembled(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """(doc, start, end, kind) from pieces and the places of chunks (doc, chunk, start, n_bytes)."""
    at = states.select("doc", "chunk", F.col("start").alias("_at"))
    pieces = cut(pieces.join(at, ["doc", "chunk"]).select("doc", "chunk", (F.col("start") + F.col("_at")).alias("start"), (F.col("end") + F.col("_at")).alias("end"), "kind"))
    whole = pieces.where("start IS NOT NULL AND end IS NOT NULL").select("doc", "start", "end", "kind")
    # at most two pieces of a chunk are open: the one that it is entered in and the one that it is left in
    later = Window.partitionBy("doc").orderBy("chunk", F.col("start").asc_nulls_first()).rowsBetween(1, Window.unboundedFollowing)
    ends = F.first("end", ignorenulls=True).over(later)
    size_of = states.groupBy("doc").agg((F.sum("n_bytes") - 1).alias("_size"))
    open_ = pieces.where("start IS NULL OR end IS NULL").withColumn("_end", ends).where("start IS NOT NULL").join(size_of, "doc")
    found = open_.select("doc", "start", F.coalesce("_end", "_size").alias("end"), "kind")
    return whole.unionByName(found).withColumn("end", F.col("end").cast("bigint"))


def non_code_ranges(lines: DataFrame, size: int = LINES, fan: int = FAN) -> DataFrame:
    """(doc, start, end, kind) of all comments, strings, raw strings, characters and header names."""
    chunks, pieces = stored_scan(lines, size, fan)
    return assembled(pieces, chunks)


def stored_scan(lines: DataFrame, size: int = LINES, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """What a later ``rescan`` needs: chunks (doc, chunk, n_lines, n_bytes, map, state, start) and pieces (doc, chunk, start, end, kind)."""
    data = cut(chunks_of(lines, size))
    maps = cut(chunk_maps(data))
    states = cut(entered(maps, fan))
    n = data.select("doc", "chunk", _n_lines(F.col("data")).alias("n_lines"))
    chunks = cut(maps.join(states, ["doc", "chunk"]).join(n, ["doc", "chunk"]).select("doc", "chunk", "n_lines", "n_bytes", "map", "state", "start"))
    return chunks, cut(pieces_of(data.join(states, ["doc", "chunk"])))


def _n_lines(data: Column) -> Column:
    text = F.decode(data, "ISO-8859-1")
    return (F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("bigint")


def edited_chunks(lines: DataFrame, edits: DataFrame, size: int = LINES) -> DataFrame:
    """Chunks of ``lines`` by their old numbers, where ``edits`` (doc, line_no, lines: array, empty to delete) stand for lines."""
    rows = lines.join(edits.select("doc", "line_no", F.col("lines").alias("_new")), ["doc", "line_no"], "left")
    rows = rows.select("doc", "line_no", F.coalesce("_new", F.array(F.coalesce("line", F.lit("")))).alias("x"), F.floor((F.col("line_no") - 1) / size).cast("bigint").alias("chunk"))
    listed = F.array_sort(F.collect_list(F.struct("line_no", "x")))
    ended = F.transform(F.flatten(F.transform(listed, lambda r: r.x)), lambda line: F.concat(line, F.lit("\n")))
    return rows.groupBy("doc", "chunk").agg(F.array_join(ended, "").cast("binary").alias("data"))


def rescan(chunks: DataFrame, pieces: DataFrame, lines: DataFrame, edits: DataFrame, size: int = LINES, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored scan after ``edits``: chunks, pieces, and (doc, n_rescanned): lines that were read again.

    Only chunks with an edit get a new map. All entry states follow from maps, and
    only chunks with an edit, or whose entry state is not the stored one, are read
    again: what follows an edit is left alone as soon as the states agree. Pieces
    are kept in bytes of their chunk, so places behind an edit move with the
    running sum of the chunks' sizes. A chunk may become empty.
    """
    touched = edits.select("doc", F.floor((F.col("line_no") - 1) / size).cast("bigint").alias("chunk")).distinct()
    on = ["doc", "chunk"]
    with_chunk = lines.withColumn("chunk", F.floor((F.col("line_no") - 1) / size).cast("bigint"))
    anew = cut(edited_chunks(with_chunk.join(touched, on, "left_semi").drop("chunk"), edits, size))
    maps = chunk_maps(anew).join(anew.select(*on, _n_lines(F.col("data")).alias("n_lines")), on)
    old = chunks.select(*on, "n_lines", "n_bytes", "map", F.col("state").alias("before"))
    maps = cut(old.join(touched, on, "left_anti").unionByName(maps.join(old.select(*on, "before"), on)))
    states = entered(maps.select(*on, "n_bytes", "map"), fan)
    now = cut(maps.join(states, on))
    moved = now.where("state <> before").select(*on).join(touched, on, "left_anti")
    again = edited_chunks(with_chunk.join(moved, on, "left_semi").drop("chunk"), edits, size)
    dirty = cut(anew.unionByName(again).join(now.select(*on, "state", "n_lines"), on))
    fresh = pieces_of(dirty.drop("n_lines"))
    kept = pieces.join(dirty.select(*on), on, "left_anti").unionByName(fresh)
    return now.drop("before"), cut(kept), dirty.groupBy("doc").agg(F.sum("n_lines").alias("n_rescanned"))
