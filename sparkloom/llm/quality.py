"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every word has a sparse random index vector; its word vector is the sum of the
index vectors of its neighbours. Words are hashed into a fixed number of
buckets, so the table has one size whatever the corpus. Beside each word
stands its shape (letters by case, digits, marks as they are, runs shortened).
Word vectors are learnt from all documents, with the labels unseen; the network
is fitted on a bounded sample of labelled ones (``SAMPLE_DOCS``, chosen by a hash
of the id).

Null and empty texts are scored from a zero vector. Texts and tokens of any
length are read whole. Repeated documents get the same score; conflicting labels
of an id go by majority, ties to 1; null labels are left out. Without labels of
both kinds the score is the share of label 1 (one half without any). An empty
table gives no rows. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sample_test, tidy

#: Labelled documents that are learnt from, at most (about).
SAMPLE_DOCS = 6000
BUCKETS = 1 << 14
SIZE = 64
#: Non-zero places of an index vector, and neighbours on each side.
PLACES = 4
REACH = 2
HIDDEN = 32
#: Tokens that are counted together, blocks of buckets that a task's sums are sent in, and shares of the tasks that are added up apart at first.
HELD_TOKENS = 500_000
BLOCKS = 16
SHARES = 64
#: Buckets up to which pairs are counted in a table.
FEW = 1000
#: Tokens that a worker remembers.
MEMO_SIZE = 400_000

_MARKS = re.compile(r"([^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*)|([^\W\d_]+)|(\d+)|((.)\5*)", re.S)


def shape(token: str) -> str:
    """The form of a token: a for letters with lower case among them, A for others, 0 for digits, marks at most twice."""
    return "".join("a" if m[1] else "A" if m[2] else "0" if m[3] else m[4][:2] for m in _MARKS.finditer(token))


_NO_WORD = re.compile(r"[\W_]+")
#: What this process knows of tokens and shapes; it serves all tasks that it runs.
_tokens: dict[str, int] = {}
_shapes: dict[str, int] = {}


def buckets(token: str) -> int:
    """Bucket of the word (its letters and digits, lower-cased) and of the shape, in one number."""
    low, last = token.lower(), token[-1:]
    if token.isascii() and token.isalpha():  # by far the most; the same as by the patterns
        word, form = low, "A" if token.isupper() else "a"
    elif token.isascii() and token[:-1].isalpha() and not last.isalnum():
        word, form = low[:-1], ("A" if token.isupper() else "a") + last
    else:
        word, form = _NO_WORD.sub("", low), shape(token)
    if form not in _shapes:
        if len(_shapes) > MEMO_SIZE:
            _shapes.clear()
        _shapes[form] = zlib.crc32(b"shape " + form.encode("utf-8", "replace")) % BUCKETS
    return (zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS) * BUCKETS + _shapes[form]


def _ids(text: str | None) -> np.ndarray:
    found = text.split() if text else []
    if len(_tokens) > MEMO_SIZE:
        _tokens.clear()
    for t in set(found):
        if t not in _tokens:
            _tokens[t] = buckets(t)
    return np.fromiter(map(_tokens.__getitem__, found), np.int64, len(found))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, SIZE, (BUCKETS, PLACES)), rng.choice([-1.0, 1.0], (BUCKETS, PLACES))


def context_sums(flat: np.ndarray, total: np.ndarray) -> None:
    """Add to every bucket of ``flat`` the index vectors of its neighbours; ``REACH`` times -1 stand between documents."""
    place, sign = index_vectors()
    for lo in range(0, len(flat), HELD_TOKENS):
        for off in range(1, REACH + 1):
            right = flat[lo + off : lo + off + HELD_TOKENS]
            left = flat[lo : lo + len(right)]
            ok = (left >= 0) & (right >= 0)
            left, right = left[ok], right[ok]
            seen = np.flatnonzero(np.bincount(np.concatenate([left, right]), minlength=BUCKETS))
            if len(seen) <= FEW:  # pairs of few buckets, as shapes are, are counted before they are spread
                at = np.zeros(BUCKETS, np.int64)
                at[seen] = np.arange(len(seen))
                n = np.bincount(at[left] * len(seen) + at[right], minlength=len(seen) ** 2)
                pair = np.flatnonzero(n)
                left, right, n = seen[pair // len(seen)], seen[pair % len(seen)], n[pair]
            else:
                n = 1
            for x, y in ((left, right), (right, left)):
                weight = sign[y] * (n if isinstance(n, int) else n[:, None])
                total += np.bincount((x[:, None] * SIZE + place[y]).ravel(), weight.ravel(), BUCKETS * SIZE).astype(np.int64)


_SUMS = pa.schema([("block", pa.int32()), ("at", pa.binary()), ("v", pa.binary())])


def _packed(k: int, part: np.ndarray) -> pa.RecordBatch:
    """A block's buckets that anything was added to, with their sums in the fewest bytes that hold them."""
    at = np.flatnonzero(part.any(1)).astype("<i4")
    v = part[at]
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if not v.size or np.abs(v).max() <= np.iinfo(t).max)
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.tobytes()]), pa.array([v.astype(kind).tobytes()])], schema=_SUMS)


def _spread(part: np.ndarray, at: bytes, v: bytes) -> None:
    """Add what ``_packed`` made to a block."""
    where = np.frombuffer(at, "<i4")
    if len(where):
        part[where] += np.frombuffer(v, f"<i{len(v) // (len(where) * SIZE)}").reshape(-1, SIZE)


def task_sums(docs: DataFrame, text_col: str) -> DataFrame:
    """By task and block of buckets: the buckets that the task's texts added to, and their sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * SIZE, np.int64)
        held, size = [], 0
        gap = np.full(REACH, -1)

        def count() -> None:
            flat = np.concatenate(held)
            apart = flat < 0
            for ids in (flat // BUCKETS, flat % BUCKETS):
                context_sums(np.where(apart, -1, ids), total)

        for b in batches:
            for text in b.column(0).to_pylist():
                ids = _ids(text)
                held += [ids, gap]
                size += len(ids) + 1
                if size >= HELD_TOKENS:
                    count()
                    held, size = [], 0
        if held:
            count()
        for k, part in enumerate(total.reshape(BLOCKS, -1, SIZE)):
            if part.any():
                yield _packed(k, part)

    return docs.select(text_col).mapInArrow(tidy(run), "block int, at binary, v binary")


def word_vectors(docs: DataFrame, text_col: str) -> np.ndarray:
    """The buckets' vectors, of length one, from all texts of ``docs``.

    A task returns whole numbers for the buckets it saw. They are summed in a
    tree: by block and one of SHARES shares of the tasks, then by block, so that
    no task adds up all others'. What reaches the driver has a fixed size.
    """

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, at, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                _spread(sums.setdefault(k, np.zeros((BUCKETS // BLOCKS, SIZE), np.int64)), at, v)
        for k, part in sums.items():
            yield _packed(k, part)

    level = task_sums(docs, text_col)
    for keys in (("block", F.spark_partition_id() % SHARES), ("block",)):
        level = level.repartition(*keys).mapInArrow(tidy(add), level.schema)
    total = np.zeros((BLOCKS, BUCKETS // BLOCKS, SIZE), np.int64)
    for r in level.collect():  # a row a block
        _spread(total[r.block], bytes(r.at), bytes(r.v))
    return normed(total.reshape(BUCKETS, SIZE).astype(float))


def normed(total: np.ndarray) -> np.ndarray:
    """Sums as vectors of length one, after what all of them share is taken out."""
    seen = np.abs(total).sum(1) > 0
    if seen.any():
        size = np.linalg.norm(total[seen], axis=1, keepdims=True)
        total[seen] -= (total[seen] / size).mean(0) * size
    return (total / np.maximum(1e-9, np.linalg.norm(total, axis=1, keepdims=True))).astype(np.float32)


def features(vectors: np.ndarray, text: str | None) -> np.ndarray:
    """Mean vectors of words and of shapes, length, and the shares of repeated neighbours and of distinct tokens."""
    both = _ids(text)
    n = len(both)
    out = np.zeros(2 * SIZE + 3)
    if n:
        seen, count = np.unique(both, return_counts=True)
        weight = (count / n).astype(np.float32)
        out[:SIZE] = weight @ vectors[seen // BUCKETS]
        out[SIZE : 2 * SIZE] = weight @ vectors[seen % BUCKETS]
        out[-3:] = np.log1p(n) / 10, np.mean(both[1:] == both[:-1]) if n > 1 else 0, len(seen) / n
    return out


@dataclass
class Network:
    """Two layers, and the temperature that its logits are divided by."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """Full-batch Adam on four fifths of the rows; the temperature is chosen on the rest."""
    one = np.ones(1)
    if len(y) < 10 or y.min() == y.max():
        return Network(one, one, one, one, one, 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, spread = x[fit].mean(0), x[fit].std(0) + 1e-3
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    xs, ys = (x[fit] - mean) / spread, y[fit]
    for t in range(1, steps + 1):
        h = np.tanh(xs @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - ys) / len(ys)
        e = d[:, None] * p[2] * (1 - h * h)
        grads = [xs.T @ e + decay * p[0], e.sum(0), h.T @ d + decay * p[2], d.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, spread, p[0], p[1], p[2], float(p[3][0]), 1.0)
    z, yh = net.logits(x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, z / t) - yh * z / t) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _features_of(rows: DataFrame, id_col: str, extra: list[str], text_col: str, vectors, net: Network | None) -> DataFrame:
    """The extra columns with each text's features, or with its score if there is a network."""
    shared = rows.sparkSession.sparkContext.broadcast((vectors, net))
    kept = [id_col, *extra]
    kinds = dict(rows.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for b in batches:
            x = np.stack([features(vectors, t) for t in b.column(len(kept)).to_pylist()])
            last = pa.array(net.probabilities(x)) if net else pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], last], names=[*kept, "x"])

    return rows.select(*kept, text_col).mapInArrow(tidy(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "x double" if net else "x binary"]))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``id_col`` and the calibrated probability ``score`` of label 1 for every row of ``docs``; ``labels`` are the rows that may be learnt from."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    chosen = known.where(sample_test(sample_docs, known.count(), id_col))
    # about sample_docs rows of two numbers, so their size is known; of repeated ids the least text is learnt from
    sample = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), id_col)
    sample = cut(sample.groupBy(id_col).agg(F.min(text_col).alias(text_col), F.max("y").alias("y")))
    vectors = word_vectors(docs, text_col)
    rows = _features_of(sample, id_col, ["y"], text_col, vectors, None).collect()
    rows.sort(key=lambda r: (r[0], r.x))
    x = np.array([np.frombuffer(bytes(r.x), "<f4") for r in rows], np.float64).reshape(len(rows), 2 * SIZE + 3)
    net = train(x, np.array([r.y for r in rows]))
    return _features_of(docs, id_col, [], text_col, vectors, net).withColumnRenamed("x", "score")
