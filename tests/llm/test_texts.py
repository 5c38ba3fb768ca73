"""Language identification, SentencePiece coding, scoring, quality and decontamination against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkloom.llm import decontaminate as dc
from sparkloom.llm import langid, lm_score, pieces, quality
from sparkloom.llm.queries import PIECES, QUERIES
from sparkloom.llm.sentencepiece_codec import decode_documents, encode_documents

from .helpers import DOCS, awkward, documents


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PIECES)


def plain_viterbi(v, s):
    best = [0.0] + [-math.inf] * len(s)
    for i in range(1, len(s) + 1):
        for j in range(max(0, i - v.longest), i):
            k = v.ids.get(s[j:i])
            if k is not None:
                best[i] = max(best[i], best[j] + v.log_probs[k])
        if s[i - 1] not in v.ids:
            best[i] = max(best[i], best[i - 1] + v.byte * len(s[i - 1].encode()))
    return best[-1]


def test_streaming_viterbi_is_the_best_path(vocabulary):
    v, rng = vocabulary, random.Random(1)
    byte = set(v.byte_ids)
    for n in (1, 5, 60, 700, 3000):
        s = "".join(rng.choice(["the", "ing", "x", "日", "é", "\U0001f600", "zq", "▁", "▁of"]) for _ in range(n))
        ids = pieces.best_path(v, s)
        assert pieces.decode(v, list(ids)) == s.replace("▁", " ")[s[0] == "▁" :]
        assert sum(v.byte if i in byte else v.log_probs[i] for i in ids) == pytest.approx(plain_viterbi(v, s), abs=1e-3)
        encoder, parts = pieces.Encoder(v), []
        while s:  # the same in whatever parts the text comes
            k = rng.randrange(1, 50)
            parts += encoder.feed(s[:k])
            s = s[k:]
        assert tuple(parts + encoder.finish()) == ids
    for _ in range(200):  # within one window too
        s = "".join(rng.choice(["the", "in", "x", "日", "é", "\U0001f600", "▁", "▁of"]) for _ in range(rng.randrange(1, 7)))[: v.longest]
        encoder = pieces.Encoder(v)
        assert pieces.best_path(v, s) == tuple(encoder.feed(s) + encoder.finish())


def test_stream_keeps_a_window_only(vocabulary):
    rng = random.Random(15)
    for unit in (["the quick brown fox "], ["日", "本", "語", "x"], ["ing", "er", "zq"], ["a"]):
        encoder, out, most = pieces.Encoder(vocabulary), [], 0
        text = "".join(rng.choice(unit) for _ in range(10_000))
        for k in range(0, len(text), 500):
            out += encoder.feed(text[k : k + 500].replace(" ", pieces.SPACE))
            most = max(most, len(encoder.best))
        out += encoder.finish()
        assert pieces.decode(vocabulary, out) == text
        assert most < 200 or unit == ["a"]  # paths through a run of one letter never meet


def test_agreement_with_the_library(vocabulary, spark, sf_dir):
    """The vocabulary's own encoding merges by rank; the share of piece boundaries in common is a figure of the README."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def ends(ids):
        return set(itertools.accumulate(len(vocabulary.bytes_of[i]) for i in ids))

    both = union = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").collect():
        mine, theirs = ends(pieces.encode(vocabulary, r.text)), ends(library.encode(r.text))
        both, union = both + len(mine & theirs), union + len(mine | theirs)
    print("boundaries in common", both / union)
    assert both / union > 0.75


def test_segments_change_nothing(vocabulary):
    text = "Some  words, and (marks)!\nA new line\tand more...   end "
    whole = pieces.best_path(vocabulary, pieces.SPACE + text.replace(" ", pieces.SPACE))
    assert pieces.encode(vocabulary, text) == list(whole)


def test_round_trip_of_awkward_texts(spark, vocabulary):
    coded = encode_documents(awkward(spark), vocabulary)
    rows = coded.collect()
    assert all(r.round_trip for r in rows) and {r.n_ids for r in rows if not r.text} == {0}
    back = decode_documents(coded.drop("text"), vocabulary)
    assert sorted((r.doc_id or 0, r.text or "") for r in back.collect()) == sorted((r.doc_id or 0, r.text or "") for r in rows)
    one = next(r for r in rows if r.doc_id == 1)
    assert one.ids_sha256 == hashlib.sha256(np.array(one.ids, "<i4").tobytes()).hexdigest()


def test_marginal_sums_all_segmentations(vocabulary):
    probs, byte, table = {p: vocabulary.log_probs[i] for p, i in vocabulary.ids.items()}, vocabulary.byte, vocabulary.table()
    assert sum(map(math.exp, probs.values())) + 256 * math.exp(byte) == pytest.approx(1)

    def brute(s):
        if not s:
            return 1.0
        total = sum(math.exp(probs[s[:j]]) * brute(s[j:]) for j in range(1, len(s) + 1) if s[:j] in probs)
        return total + (math.exp(byte * len(s[0].encode())) * brute(s[1:]) if s[0] not in probs else 0)

    for s in ("▁hello", "▁éሴx", "aaaaaa", "\U0001f600"):
        assert pieces.log_marginal(table, byte, s) == pytest.approx(math.log(brute(s)), rel=1e-12)


def test_units_hold_all_segments_and_their_tree_sums_alike(vocabulary):
    table, byte = vocabulary.table(), vocabulary.byte
    root = pieces.tree(table, byte)
    for t in ("", " ", "a b", "  a   b ", "a\u2581b c", "a\u2581 b", "two\nlines, \tand  more!!", "\u5317\u4eac\u3002 \u4e2d", "\U0001f600 \u1234x" * 30, "word " * 9):
        cut = [s for u in pieces.units(t) for s in vocabulary.segment(u)]
        assert cut == pieces.segments(vocabulary, t)
        for s in cut:
            assert pieces.log_marginal_of(root, table, byte, s) == pytest.approx(pieces.log_marginal(table, byte, s), rel=1e-12)
    odd = "\u1234" * 40  # its plain probability is too small for a double
    assert pieces.log_marginal_of(root, table, byte, odd) == pieces.log_marginal(table, byte, odd) < -700


def test_lm_counts_by_units_are_those_of_whole_texts(spark, vocabulary):
    texts = ["The cat,  the\ncat. ", " a\u2581b A\u2581 b", "x" * 50 + ", y" * 3, "bad \ufffd The", None, "", "The cat, the cat." * 3]
    words, parts = collections.Counter(), collections.Counter()
    for t in texts:
        words.update([*lm_score.tokens((t or "").encode()), b""])
        parts.update(s.encode() if len(s) <= pieces.MEMO_CHARS else b"" for s in pieces.segments(vocabulary, t or ""))
    rows = lm_score.count_training(documents(spark, texts), vocabulary).collect()
    assert {bytes(r.word): r.n for r in rows if not r.part} == words
    assert {bytes(r.word): r.n for r in rows if r.part and r.n} == parts


@pytest.mark.parametrize("head", [0, 5, 10_000])
def test_lm_base_against_plain_counts(spark, vocabulary, head):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("The the A a bb ccc Ddd éé".split()) for _ in range(rng.randrange(30))) for _ in range(40)] + [None, "", "\t new \x0b word"]
    docs = documents(spark, texts)
    train = docs.where("doc_id % 3 <> 0")
    c = collections.Counter()
    for i, t in enumerate(texts):
        if i % 3:
            c.update([*lm_score.tokens((t or "").encode()), b""])
    n, v = sum(c.values()), len(c)
    for r in lm_score.score_documents(docs, train, vocabulary, head_words=head).collect():
        t = [*lm_score.tokens((texts[r.doc_id] or "").encode()), b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert (r.score == 0) == (not texts[r.doc_id])


def test_lm_score_learns_from_training_texts(spark, vocabulary):
    rng = random.Random(4)
    made = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)]
    texts = [" ".join(rng.choice(made) for _ in range(40)) for _ in range(80)] + ["qxj zzwq unseen words"]
    docs = documents(spark, texts)
    found = {r.doc_id: r for r in lm_score.score_documents(docs, docs.where("doc_id % 4 <> 0 AND doc_id < 80"), vocabulary).collect()}
    held = [found[i] for i in range(0, 80, 4)]
    # words that training holds are about as likely to the model as to the base, and no score is missing or infinite
    assert sum(r.score for r in held) > 1.2 * sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found.values())
    # seen and unseen segments share one distribution: what is learnt takes from the rest
    table, byte, whole = lm_score.learn(lm_score.count_training(docs, vocabulary).where("part").drop("part"), vocabulary)
    assert sum(math.exp(x) for x in table.values() if x <= 0) + 256 * math.exp(byte) == pytest.approx(1)
    assert sum(math.exp(x) for x in whole.values()) <= 1 + 1e-9


def test_lm_meets_awkward_and_empty_tables(spark, vocabulary):
    d = awkward(spark)
    assert lm_score.score_documents(d, d, vocabulary).count() == d.count()
    assert lm_score.score_documents(d, d.limit(0), vocabulary).where("n_known > 0").count() == 0
    assert lm_score.score_documents(d.limit(0), d.limit(0), vocabulary).count() == 0


def test_language_held_out_accuracy(spark, sf_dir):
    found = QUERIES["op1_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = found.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a >= 0.97 and 0 <= r.lo and r.hi <= 1


def test_language_paths_against_plain_search(monkeypatch):
    rng = random.Random(3)
    grams = {g: i for i, g in enumerate(["^ab", "bc$", "abc", "^xy", "yz$", "xyz"])}
    m = lambda k: langid.Model([f"l{i}" for i in range(k)], grams, np.random.default_rng(k).normal(-5, 4, (len(grams) + 1, k)), {"Latin": np.ones(k, bool)}, {}, np.zeros((0, k)))
    texts = [[rng.choice(["abc", "xyz", "abz", "q", "日"]) for _ in range(n)] for n in (0, 1, 3, 40, 200)]
    monkeypatch.setattr(langid, "CHUNK", 7)
    for k in (1, 3, 20):
        model = m(k)
        for words, got in zip(texts, langid.paths(model, texts)):
            known = [w for w in words if model.rows[w] >= 0]
            assert [g == -1 for g in got] == [model.rows[w] < 0 for w in words]
            if not known:
                continue
            s = np.array([model.scores[model.rows[w]] for w in known])
            value, back = s[0].copy(), []
            for x in s[1:]:
                top = value.argmax()
                stay = value >= value[top] - langid.SWITCH
                back.append(np.where(stay, np.arange(k), top))
                value = np.where(stay, value, value[top] - langid.SWITCH) + x
            path = [int(value.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            mine = [g for g in got if g >= 0]
            score = lambda p: sum(s[i][j] for i, j in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in itertools.pairwise(p))
            assert score(mine) == pytest.approx(score(path[::-1]))


def test_mixed_language_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    en, fr = (docs.where((F.col("lang") == x) & (F.col("n_chars") > 300)).first().text[:250] for x in ("en", "fr"))
    r = langid.identify(documents(spark, [en + " " + fr]), model, with_spans=True).first()
    assert {s.lang for s in r.spans} >= {"en", "fr"} and len(r.spans) <= 6


def test_language_meets_awkward_and_empty_tables(spark):
    d = awkward(spark)
    rows = {r.doc_id: r for r in langid.identify(d, langid.fit(d)).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (2, 3, 4, 8)) and rows[1].lang_pred == "en"
    none = langid.fit(d.limit(0))
    assert {r.lang_pred for r in langid.identify(d, none).collect()} == {"und"}
    assert langid.identify(d.limit(0), langid.fit(d)).count() == 0


def test_quality_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has a handful of labels
    found = QUERIES["op10_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = found[found.quality == 1].score.to_numpy(), found[found.quality == 0].score.to_numpy()
    if len(good) and len(bad):
        assert (good[:, None] > bad[None]).mean() >= 0.9
    assert found.score.between(0, 1).all()


def test_quality_meets_awkward_tables(spark):
    d = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality.score_documents(d, labels)
    assert got.count() == d.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert {r.score for r in quality.score_documents(d, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(d.limit(0), labels).count() == 0


def plain_contamination(texts, items, window=13):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = dc.words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[s : s + window])].add(i)
    out = []
    for t in texts:
        w, hit, found = dc.words(t), set(), set()
        for p, names in wins.items():
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    found |= names
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_against_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    rng = random.Random(4)
    words = [f"a{i}" for i in range(6)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, make(15)), (2, make(3)), (3, None), (4, ""), (None, make(4)), (1, make(5)), (10, "A1, a2-a3")]
    texts = [make(rng.randrange(60)) for _ in range(25)] + [items[0][1] + " tail", None, "", items[0][1].upper()]
    texts += texts[:2]
    got = dc.decontaminate(documents(spark, texts, [*range(29), 0, 1]), spark.createDataFrame(items, "item_id long, text string"))
    want = sorted((i, *x) for i, x in zip([*range(29), 0, 1], plain_contamination(texts, items)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got.collect()) == want


def test_decontamination_meets_awkward_and_empty_tables(spark):
    d = awkward(spark)
    items = spark.createDataFrame([(1, "same text twice"), (2, None)], "item_id long, text string")
    got = dc.decontaminate(d, items)
    assert got.count() == d.count() and {r.doc_id for r in got.where("n_hit > 0").collect()} == {6}
    assert dc.decontaminate(d, items.limit(0)).where("n_hit > 0").count() == 0
    assert dc.decontaminate(d.limit(0), items).count() == 0


def test_proximity(spark):
    d = documents(spark, ["red x blue y green", "green blue far far far far far far red", "blue green red", "red blue red green"])
    index = dc.store_index(d)
    ask = lambda *phrases: {(r.doc_id, r.phrase, r.start, r.stop) for r in dc.proximity_matches(index, dc.term_counts(index), list(phrases), slop=2).collect()}
    assert ask("red blue green", "", "red absent") == {(0, "red blue green", 0, 5), (2, "red blue green", 0, 3), (3, "red blue green", 1, 4)}
    assert ask("red red green") == {(3, "red red green", 0, 4)}


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_near_items_against_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    rng = random.Random(14)
    vocabulary = [f"a{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((4, 3, 9, 5, 2))] + [(9, "a1 nowhere"), (10, None)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(30)] + [None, ""]
    freq = collections.Counter(w for t in texts for w in dc.words(t))
    want = collections.defaultdict(set)
    for i, t in items:
        w = dc.words(t)
        rows = [w[s : s + 4] for s in range(max(1, len(w) - 3) if w else 0)]
        rows = [r for r in rows if all(freq[x] for x in r)]
        if rows:
            pick = collections.Counter(min(rows, key=lambda r: sorted(freq[x] for x in r)))
            n = sum(pick.values())
            for d, text in enumerate(texts):
                x = dc.words(text)
                if any(not pick - collections.Counter(x[s : s + n + 1]) for s in range(len(x))):
                    want[d].add(str(i))
    got = dc.decontaminate(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window=4, slop=1).collect()
    assert {r.doc_id: set(r.near_ids) for r in got} == {d: want[d] for d in range(len(texts))}
    assert any(want.values())


def test_crc_split_is_that_of_the_id_as_text(spark):
    from sparkloom.llm.common import remainder

    got = {r.id: r.m for r in spark.range(50).select("id", remainder("id", 7).alias("m")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 for i in range(50)}


def test_every_text_with_a_letter_gets_a_learned_language(spark):
    train = [(i, f"the plain words of this text are english {i}", "en", "s", 0) for i in range(20)]
    train += [(100 + i, f"die einfachen worte hier sind deutsch {i}", "de", "s", 0) for i in range(20)]
    train += [(200, "ελληνικά " + "noch ein deutscher satz mit vielen worten " * 40, "de", "s", 0)]  # under SCRIPT_SHARE
    model = langid.fit(spark.createDataFrame(train, DOCS))
    texts = ["ελληνικά γράμματα", "кириллица здесь", "日本語", "ｆｕｌｌ", "the plain words кириллица", "12 !?"]
    got = {r.doc_id: r for r in langid.identify(documents(spark, texts), model, with_spans=True).collect()}
    assert got[0].lang_pred == "de"
    assert all(got[i].lang_pred in ("de", "en") and 0 < got[i].score <= 1 / 3 for i in range(4))
    assert got[4].lang_pred == "en" and got[4].score == pytest.approx(13 / 22) and [s.lang for s in got[4].spans] == ["en", "und"]
    assert got[5].lang_pred == "und" and got[5].score == 0


def plain_language(train, text, switch=langid.SWITCH):
    """Fit and search as the docstring says it, word by word."""
    def grams(w):
        w = f"^{w}$"
        return [w[max(0, i - 3) : i] for i in range(2, len(w) + 1)]

    word = lambda t: __import__("regex").findall(r"\p{L}[\p{L}\p{M}]*", t.lower())
    counts, letters = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for t, lang in train:
        for w in word(t):
            counts[lang].update(grams(w))
            letters[lang][langid.script(w)] += len(w)
    langs = sorted(counts)
    every = {g for c in counts.values() for g in c}
    total = {x: sum(counts[x].values()) for x in langs}
    score = lambda x, w: sum(math.log((counts[x][g] + 0.5) / (total[x] + 0.5 * (len(every) + 1))) for g in grams(w))
    used = lambda x, s: letters[x][s] / sum(letters[x].values()) >= langid.SCRIPT_SHARE
    words = [w for w in word(text) if any(used(x, langid.script(w)) for x in langs)]
    best = {x: (0.0, []) for x in langs}
    for w in words:
        top = max(best, key=lambda x: best[x][0])
        new = {}
        for x in langs:
            value, path = max((best[x][0], best[x][1]), (best[top][0] - switch, best[top][1]), key=lambda p: p[0])
            new[x] = (value + (score(x, w) if used(x, langid.script(w)) else -1e9), [*path, x])
        best = new
    path = max(best.values(), key=lambda p: p[0])[1]
    by = collections.Counter()
    for w, x in zip(words, path):
        by[x] += len(w)
    found = min(by, key=lambda x: (-by[x], x))
    return found, by[found] / sum(len(w) for w in word(text))


def test_language_fit_and_prediction_against_plain_version(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and length(text) between 20 and 1500").orderBy("doc_id").collect()
    train, ask = [(r.text, r.lang) for r in rows[:60] if r.lang], [r.text for r in rows[60:100]]
    ask += [a[:200] + " " + b[:200] for a, b in zip(ask[:8], ask[8:16])] + [ask[0] + " λόγος", "кириллица " + ask[1]]
    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, (t, g) in enumerate(train)], DOCS)
    got = {r.doc_id: r for r in langid.identify(documents(spark, ask), langid.fit(docs)).collect()}
    for i, t in enumerate(ask):
        lang, share = plain_language(train, t)
        assert (got[i].lang_pred, pytest.approx(got[i].score)) == (lang, share)


def test_word_vectors_against_plain_sums(spark, monkeypatch):
    rng = random.Random(41)
    texts = [" ".join(rng.choice(["Alpha", "beta,", "77", "x", "--"]) for _ in range(rng.randrange(12))) for _ in range(30)] + [None, "", "z" * 5000]
    place, sign = quality.index_vectors()
    total = np.zeros((quality.BUCKETS, quality.SIZE))
    for t in texts:
        both = [quality.buckets(x) for x in (t or "").split()]
        for ids in ([b // quality.BUCKETS for b in both], [b % quality.BUCKETS for b in both]):
            for i, x in enumerate(ids):
                for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                    if i != j:
                        for p, s in zip(place[ids[j]], sign[ids[j]]):
                            total[x, p] += s
    many_total = 20 * total  # ``normed`` changes what it is given
    got = quality.word_vectors(documents(spark, texts).repartition(3), "text")
    assert np.allclose(got, quality.normed(total), atol=1e-6)
    many = documents(spark, texts * 20).repartition(60)
    assert np.allclose(quality.word_vectors(many, "text"), quality.normed(many_total), atol=1e-6)
    # a task sends the buckets that it saw, each at least one of its words or shapes
    sent = sum(len(r.at) // 4 for r in quality.task_sums(many, "text").collect())
    assert sent <= 20 * sum(2 * len(set((t or "").split())) for t in texts)
    flat = np.concatenate([np.array([1, 2, 1, 3]), np.full(quality.REACH, -1), np.array([2])])
    whole, parts = np.zeros(quality.BUCKETS * quality.SIZE, np.int64), np.zeros(quality.BUCKETS * quality.SIZE, np.int64)
    quality.context_sums(flat, whole)
    monkeypatch.setattr(quality, "HELD_TOKENS", 2)
    monkeypatch.setattr(quality, "FEW", 0)
    quality.context_sums(flat, parts)
    assert (whole == parts).all() and whole.any()


def test_fast_ways_to_a_bucket_change_nothing():
    for token in ("word", "WORD", "Word", "word,", "WORD!", "w_", "_", "a1", "1", "ß", "É!", "ａ", "don't", "x--", "", "word\x00"):
        word = "".join(c for c in token.lower() if c.isalnum())
        want = zlib.crc32(word.encode()) % quality.BUCKETS * quality.BUCKETS + zlib.crc32(b"shape " + quality.shape(token).encode()) % quality.BUCKETS
        assert quality.buckets(token) == want, token


def test_shapes_of_whole_tokens():
    assert quality.shape("Abc-12--") == "a-0--" and quality.shape("X" * 1000 + "1") == "A0" and quality.shape("a" * 30 + "!!!!") == "a!!"


def test_network_gradient_and_calibration():
    rng = np.random.default_rng(42)
    x = rng.normal(size=(3000, 6))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))).astype(float)
    net = quality.train(x, y)
    p = net.probabilities(x)
    for lo in np.arange(0, 1, 0.2):  # the mean of the labels in a bin is near the mean of the probabilities
        inside = (p >= lo) & (p < lo + 0.2)
        if inside.sum() > 50:
            assert abs(y[inside].mean() - p[inside].mean()) < 0.08
    z = (x - net.mean) / net.spread
    assert np.allclose(net.logits(x), np.tanh(z @ net.w1 + net.b1) @ net.w2 + net.b2)


def test_scores_are_those_of_features_and_network(spark):
    rng = random.Random(43)
    texts = [" ".join(rng.choice(["good", "Fine", "text", "words"] if i % 2 else ["###", "buy!!!", "1234", "CLICK"]) for _ in range(20)) for i in range(80)] + [None, ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    vectors = quality.word_vectors(docs, "text")
    x = np.stack([quality.features(vectors, t) for t in texts])
    rows = sorted((i, x[i].astype("<f4").tobytes(), float(i % 2)) for i in range(60))
    net = quality.train(np.array([np.frombuffer(b, "<f4") for _, b, _ in rows], np.float64), np.array([y for _, _, y in rows]))
    assert got == pytest.approx(dict(enumerate(net.probabilities(x).tolist())), abs=1e-4)
    assert min(got[i] for i in range(61, 80, 2)) > max(got[i] for i in range(60, 80, 2))


def test_quality_learns_one_text_of_a_repeated_id(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    one = labels.first().doc_id
    copies = spark.range(10_000).select(F.lit(one).alias("doc_id"), F.concat(F.lit("copy "), (F.col("id") % 5).cast("string")).alias("text"))
    seen, plain = [], quality.train
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append(len(y)) or plain(x, y))
    assert quality.score_documents(docs.unionByName(copies), labels).count() == docs.count() + 10_000
    assert seen == [labels.distinct().count()] or seen[0] <= labels.count()
