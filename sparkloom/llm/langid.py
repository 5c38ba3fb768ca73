"""Language identification of whole texts, also of mixed ones.

Words are runs of letters. The script of a word (a Unicode range) narrows the
languages to those that were seen in it; each candidate scores the word by
character n-grams; a Viterbi search over the words, with a penalty for every
switch, labels spans. The text's language is that of most letters.

Learning reads a bounded, documented sample of labelled texts per language.

A text without any word in such a script takes the languages that were seen in
its scripts at all, or else every one, as candidates; its score is then low.

Null texts and texts without a letter are ``und`` with score 0. Texts of any
length are read whole, in chunks of words. Ties between languages go to the
smaller name. Repeated rows are labelled alike. Without any training text every
text is ``und``; an empty table gives no rows. Other columns are kept, except
``lang_pred``, ``score`` and ``spans``, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sample_bound, tidy

UNKNOWN = "und"
#: Texts that a language is learnt from, at most (about; chosen by a hash of the row).
SAMPLE_PER_LANGUAGE = 3000
#: Cost in nats of a switch between two words.
SWITCH = 9.0
#: Longest n-gram of characters; words carry a mark at both ends.
GRAM = 3
#: A language is a candidate for a script that makes up this share of its letters.
SCRIPT_SHARE = 0.02
#: Words that a worker remembers.
MEMO_SIZE = 150_000
#: Words of a chunk of the search; with more languages than MANY texts are not cut.
CHUNK = 256
MANY = 16

#: First code points of Unicode blocks of letters, and the script that begins there.
SCRIPT_STARTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
)
_STARTS = [a for a, _ in SCRIPT_STARTS]
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def script(word: str) -> str:
    """The script of a word's first letter."""
    i = bisect_right(_STARTS, ord(word[0])) - 1
    return SCRIPT_STARTS[i][1] if i >= 0 else "Other"


def grams(word: str) -> list[str]:
    """N-grams of the marked word, of the longest kind that fits at each place."""
    w = f"^{word}$"
    return [w[max(0, i - GRAM) : i] for i in range(2, len(w) + 1)]


@dataclass
class Model:
    """``languages`` in order; ``grams``: n-gram to row of ``weights``, whose last row is an unseen one's; ``scripts``: script to who uses it; ``seen``: to who was seen in it at all."""

    languages: list[str]
    grams: dict[str, int]
    weights: np.ndarray
    scripts: dict[str, np.ndarray]
    rows: dict[str, int]
    scores: np.ndarray
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def widened(self) -> Model:
        """The same with candidates for every script: the languages seen in it, or else all."""
        every = np.ones(len(self.languages), bool)
        scripts = {s: self.seen.get(s, every) for _, s in SCRIPT_STARTS} if self.languages else {}
        return Model(self.languages, self.grams, self.weights, scripts, {}, np.zeros((0, len(self.languages))))

    def learn_words(self, texts: list[list[str]]) -> None:
        """Score the words not yet remembered: a row of ``scores`` each, or -1 if no language uses their script."""
        if len(self.rows) > MEMO_SIZE:
            self.rows, self.scores = {}, self.scores[:0]
        new = sorted({w for words in texts for w in words if w not in self.rows})
        open_ = [(w, x) for w in new if (x := self.scripts.get(script(w))) is not None]
        self.rows.update(dict.fromkeys(new, -1))
        if not open_:
            return
        found = [grams(w) for w, _ in open_]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(map(self.grams.get, chain.from_iterable(found), repeat(len(self.weights) - 1)), np.int64, size.sum())
        total = np.add.reduceat(self.weights[flat], np.append(0, np.cumsum(size[:-1])))
        base = len(self.scores)
        self.scores = np.concatenate([self.scores, np.where(np.array([x for _, x in open_]), total, -1e9)])
        self.rows.update((w, base + i) for i, (w, _) in enumerate(open_))


def _sampled(training: DataFrame, text_col: str, lang_col: str, most: int) -> DataFrame:
    """Rows by a hash of all their columns, so that a language whose texts are all the same is sampled too."""
    rows = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(*(F.col(f"`{c}`") for c in training.columns)).bitwiseAND((1 << 63) - 1).alias("part"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    bound = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, sample_bound(most, n))]) if sizes else None
    return rows.where(F.col("part") <= bound[F.col("lang")]).select("lang", "text") if sizes else rows.limit(0).select("lang", "text")


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from the labelled rows of ``training``, of each language about ``per_language`` texts at most."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in _WORD.findall(text.lower()))
        out: Counter = Counter()
        for (lang, w), n in seen.items():
            out[lang, 1, script(w)] += n * len(w)
            for g in grams(w):
                out[lang, 0, g] += n
        if out:
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in out], "kind": pa.array([k[1] for k in out], pa.int32()), "gram": [k[2] for k in out], "n": list(out.values())})

    counts = _sampled(training, text_col, lang_col, per_language).mapInArrow(tidy(count), "lang string, kind int, gram string, n bigint")
    rows = counts.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")).collect()  # bounded by the sample
    languages = sorted({r.lang for r in rows})
    at = {k: i for i, k in enumerate(languages)}
    table: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for r in rows:
        (scripts if r.kind else table).setdefault(r.gram, np.zeros(len(languages)))[at[r.lang]] = r.n
    total = sum(table.values(), np.zeros(len(languages)))
    letters = np.maximum(1, sum(scripts.values(), np.zeros(len(languages))))
    spread = total + 0.5 * (len(table) + 1)
    weights = np.log((np.array([*table.values(), np.zeros(len(languages))]) + 0.5) / spread)
    used = {s: n / letters >= SCRIPT_SHARE for s, n in scripts.items()}
    return Model(languages, {g: i for i, g in enumerate(table)}, weights, {s: u for s, u in used.items() if u.any()}, {}, np.zeros((0, len(languages))), {s: n > 0 for s, n in scripts.items()})


def paths(model: Model, texts: list[list[str]]) -> list[np.ndarray]:
    """For each text's words the index of their language, -1 for a word in a script that none uses.

    Texts are cut into chunks that take their steps together, as array work.
    Each chunk is searched from every state it may be entered in, and the
    chunks of a text are then joined by the best total: the path is that of
    one search over the whole text.
    """
    k = len(model.languages)
    model.learn_words(texts)
    ids = [np.fromiter(map(model.rows.__getitem__, words), np.int64, len(words)) for words in texts]
    out = [np.full(len(x), -1, np.int64) for x in ids]
    known = [np.flatnonzero(x >= 0) for x in ids]
    size = np.array([len(x) for x in known], np.int64)
    if not size.sum():
        return out
    score = model.scores[np.concatenate([x[i] for x, i in zip(ids, known, strict=True)])]
    chunk = CHUNK if k <= MANY else int(size.max())
    starts = k if k <= MANY else 1
    first = np.append(0, np.cumsum(size))
    per = -(-size // chunk)
    text = np.repeat(np.arange(len(size)), per)  # of each chunk, in order
    place = np.arange(len(text)) - np.repeat(np.append(0, np.cumsum(per)[:-1]), per)
    begin = first[text] + place * chunk
    length = np.minimum(chunk, first[text + 1] - begin)
    order = np.argsort(-length, kind="stable")
    at, n = begin[order], length[order]
    alive = np.searchsorted(-n, -np.arange(n[0]), "left")  # how many chunks are longer than t words
    now = np.full((len(n), starts, k), -1e18)
    now[:, np.arange(starts), np.arange(starts)] = 0.0
    if starts == 1:
        now[:] = 0.0
    came, states = [], np.arange(k, dtype=np.int16)
    for t in range(n[0]):
        m = alive[t]
        before = now[:m]
        top = before.argmax(-1)[..., None]
        gain = np.take_along_axis(before, top, -1) - SWITCH
        stay = before >= gain
        came.append(np.where(stay, states, top.astype(np.int16)))
        now[:m] = np.where(stay, before, gain) + score[at[:m] + t][:, None, :]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    enter, leave = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    value = np.zeros((len(size), starts))
    chosen = {}
    for j in range(per.max()):  # the j-th chunk of every text that has one
        c = np.flatnonzero(place == j)
        total = value[text[c]][:, :, None] + now[back[c]]
        chosen[j] = (c, total.argmax(1))
        best = np.zeros((len(size), k)) if starts == 1 else value
        best[text[c]] = total.max(1)
        value = best
    end = value.argmax(1)
    for j in range(per.max() - 1, -1, -1):
        c, frm = chosen[j]
        leave[c] = end[text[c]]
        enter[c] = frm[np.arange(len(c)), leave[c]]
        end[text[c]] = enter[c]
    label = np.empty(first[-1], np.int64)
    state, start = leave[order], enter[order] if starts > 1 else np.zeros(len(n), np.int64)
    for t in range(n[0] - 1, -1, -1):
        m = alive[t]
        label[at[:m] + t] = state[:m]
        state[:m] = came[t][np.arange(m), start[:m], state[:m]]
    for i, x in enumerate(known):
        out[i][x] = label[first[i] : first[i + 1]]
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score (the share of letters in spans of that language) and, if asked for, spans (lang, start, stop in characters).

    The score of a text without any word in a learned script is divided by the
    number of languages and one more, which stands for those not learned.
    """
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    if with_spans:
        new.append(T.StructField("spans", T.ArrayType(span)))
    kept = [f for f in docs.schema.fields if f.name not in {"lang_pred", "score", "spans"}]
    at = [f.name for f in kept].index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        wide = m.widened()
        k = len(m.languages)
        for b in batches:
            texts = [x or "" for x in b.column(at).to_pylist()]
            words = [_WORD.findall(x.lower()) for x in texts]
            found = paths(m, words)
            lost = [i for i, x in enumerate(found) if len(x) and x.max() < 0]
            for i, x in zip(lost, paths(wide, [words[i] for i in lost]), strict=True):
                found[i] = x
            chance = dict.fromkeys(lost, k + 1)
            preds, scores, spans = [], [], []
            for i, (x, ws, label) in enumerate(zip(texts, words, found, strict=True)):
                size = np.fromiter(map(len, ws), np.float64, len(ws))
                by = np.bincount(label[label >= 0], size[label >= 0], minlength=k) if len(ws) and k else np.zeros(0)
                best = int(by.argmax()) if by.sum() > 0 else -1
                preds.append(m.languages[best] if best >= 0 else UNKNOWN)
                scores.append(float(by[best] / size.sum()) / chance.get(i, 1) if best >= 0 else 0.0)
                if with_spans:
                    spans.append(_spans(m, x, label))
            cols = [pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *(f.name for f in new)])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(tidy(run), T.StructType([*kept, *new]))


def _spans(m: Model, text: str, label: np.ndarray) -> list[dict]:
    out: list[dict] = []
    low = text.lower()
    if len(low) != len(text):  # letters that change length: places are then those of the lower-cased text
        text = low
    for w, x in zip(_WORD.finditer(low), label.tolist(), strict=True):
        name = m.languages[x] if x >= 0 else UNKNOWN
        if out and out[-1]["lang"] == name:
            out[-1]["stop"] = w.end()
        else:
            out.append({"lang": name, "start": w.start(), "stop": w.end()})
    return out
