"""Nearest neighbours, near duplicates, suffix dedup, WARC, URLs and the merge trees against plain versions."""

import collections
import hashlib
import heapq
import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkloom.llm import ann, components, loser_tree, suffix_dedup, urls, warc
from sparkloom.llm import near_duplicates as nd

from .helpers import awkward, documents, words_text


def test_traverse_follows_the_sums():
    rng = np.random.default_rng(1)
    d1, d2, size = rng.random(7), rng.random(5), rng.integers(0, 3, (7, 5))
    got = ann.traverse(d1, d2, size, 10**9, 1.0)
    want = sorted(((d1[i] + d2[j], i, j) for i in range(7) for j in range(5) if size[i, j]))
    assert [d1[i] + d2[j] for i, j in got] == pytest.approx([w[0] for w in want]) and len(set(got)) == len(want)


@pytest.mark.parametrize("block", [16_384, 40])
def test_ann_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[50:150] = v[50]  # one vector many times
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [1.0] * 3, 1), (None, [1.0] * 8, 1), (404, [1.0, None] + [0.0] * 6, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in ann.search(table, F.col("vec_id") % 10 == 0, k=5, gather=10**6).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 10))
    x = v.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(400) if i != q)[:5]
        found.sort()
        assert [f[1] for f in found] == [i for _, i in want] and [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert [f[2] for f in found] == pytest.approx([d for d, _ in want], rel=1e-12, abs=0)


def clustered(rng, n, size=32, centres=60):
    at = rng.normal(size=(centres, size))
    v = at[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, size))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_ann_recall_as_shipped(spark, kind):
    rng = np.random.default_rng(21)
    v = clustered(rng, 3000) if kind == "clustered" else rng.normal(size=(3000, 32))
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.search(table, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 50):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 600 >= 0.9


def test_ann_visits_few_cells_of_clustered_vectors():
    rng = np.random.default_rng(22)
    v = clustered(rng, 8000)
    books = [ann.codebook(v[:, k : k + 16], round(8000**0.5 / 4)) for k in (0, 16)]
    d = [ann.squared(v[:, k : k + 16], b) for k, b in zip((0, 16), books)]
    at = [x.argmin(1) for x in d]
    size = np.zeros((len(books[0]), len(books[1])), np.int64)
    np.add.at(size, tuple(at), 1)
    near = ann.nearness(v, tuple(books), 10, ann.RECALL)
    share = [sum(size[c] for c in ann.traverse(d[0][q], d[1][q], size, ann.GATHER, near)) / 8000 for q in range(0, 8000, 100)]
    assert np.mean(share) < 0.2


def test_ann_keeps_doubles(spark):
    rows = [(0, [0.1, 0.3]), (1, [0.1, 0.5]), (2, [1e200, 0.0]), (3, [3e200, 0.0]), (4, [1e-200, 2e-200])]
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 2, 4)).collect()}
    assert got[0, 1] == 0.5 - 0.3 and got[2, 3] == 2e200 and got[0, 4] == pytest.approx(0.1**0.5) and len(got) == 12
    assert got[4, 0] == got[0, 4] and got[2, 0] == 1e200


def test_samples_of_any_size():
    from sparkloom.llm.common import sample_bound

    for n in (1, 10**6, 10**12, 10**15):
        assert 0 < sample_bound(20_000, n) < 1 << 63
    assert sample_bound(20_000, 10**12) / 2**63 == pytest.approx(2e-8)


def test_ann_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.search(few, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert ann.search(few.limit(0), F.col("vec_id") == 0).count() == 0


def plain_groups(texts):
    sets = [set(nd.shingles((t or "").encode()).tolist()) for t in texts]
    up, links = list(range(len(texts))), [0] * len(texts)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [(i, root(i), links[i]) for i in range(len(texts))]


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = words_text(rng, 120).split()
        texts.append(" ".join(base))
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [words_text(rng, 50) for _ in range(10)] + ["one two", "one two", "", None, "", "Ja Ja Ja Ja Ja Ja Ja", "ja ja ja ja ja ja"]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in nd.similar_groups(documents(spark, texts)).collect())
    assert got == plain_groups(texts)


@pytest.mark.parametrize("sparse", [0, 10**6])
def test_linked_counts_exactly(monkeypatch, sparse):
    monkeypatch.setattr(nd, "SPARSE", sparse)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))).astype(np.uint64) for _ in range(40)]
    pairs = np.array(list(itertools.combinations(range(40), 2)))[::2]
    want = {(i, j) for i, j in pairs.tolist() if 2 * len(set(sets[i]) & set(sets[j])) >= len(set(sets[i]) | set(sets[j]))}
    assert set(map(tuple, nd.linked(sets, pairs, Fraction(1, 2)).tolist())) == want
    assert not len(nd.linked(sets, pairs[:0], Fraction(1, 2)))


def test_pruning_keeps_what_may_reach_the_threshold():
    need = nd.least_matches(0.8, 1e-6)
    assert list(need) == [32, 64, 96, 128] and all(0 < need[n] < 0.8 * n for n in need)
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    c = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    sig = np.stack([nd.minhash(np.unique(x)) for x in (a, b, c)])
    assert nd.survivors(sig, np.zeros(3, int), need).tolist() == [[0, 1]]
    agreed = [k for k in range(nd.BANDS) if (sig[0, 4 * k : 4 * k + 4] == sig[1, 4 * k : 4 * k + 4]).all()]
    assert [k for k in range(nd.BANDS) if len(nd.survivors(sig, np.zeros(3, int), need, k))] == agreed[:1]


def test_near_duplicates_meet_awkward_and_empty_tables(spark):
    d = awkward(spark)
    got = nd.similar_groups(d).collect()
    assert len(got) == d.count() and {(r.doc_id, r.n_links) for r in got if r.n_links} == {(6, 1)}
    assert nd.similar_groups(d.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)]
    got = {r.id: r.root for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        assert got.get(v, v) == min(seen)


def test_loser_tree():
    rng = random.Random(9)
    for n in range(6):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(8))) for _ in range(n)]
        assert [x for _, x in loser_tree.merge(runs, lambda x: x)] == list(heapq.merge(*runs))


def test_suffix_merge_knows_prefixes():
    rng = random.Random(10)
    for n in (0, 1, 2, 5, 9):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(30))) for _ in range(n)]
        coded = [suffix_dedup.front_code(r) for r in runs]
        assert [[s for s, _ in suffix_dedup.front_decode(*c)] for c in coded] == runs
        out = list(suffix_dedup.merge_suffixes([suffix_dedup.front_decode(*c) for c in coded]))
        assert [s for s, _, _ in out] == sorted(itertools.chain(*runs))
        assert [k for _, k, _ in out] == [suffix_dedup.common_prefix(a, b) for a, b in zip([b"", *(s for s, _, _ in out)], [s for s, _, _ in out])]


def test_anchors_depend_on_content(monkeypatch):
    rng = random.Random(11)
    body = bytes(rng.choice(b"abcd ") for _ in range(900))
    where = lambda t, part: {(s, p - s) for _, p, a, b in zip(*(x.tolist() for x in suffix_dedup.anchors(t, 50, 16))) for s in range(a, b + 1)}
    base = where(body, None)
    assert {s for s, _ in base} == set(range(851))
    moved = where(b"prefix" + body, None)
    assert all((s + 6, o) in moved for s, o in base)
    monkeypatch.setattr(suffix_dedup, "PART", 100)
    assert where(body, None) == base


@pytest.mark.parametrize("length,gram,seed,hot", [(20, 8, 1, 2048), (30, 4, 2, 3), (60, 20, 3, 1), (60, 20, 4, 2048)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, length, gram, seed, hot):
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", 50)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh") for _ in range(2500))
    texts = [None, "", "short", "ab" * 40, "ab" * 45, "xyz" * 200]
    for _ in range(60):
        a = rng.randrange(2300)
        x = list(base[a : a + rng.randrange(500)])
        for _ in range(rng.randrange(6)):
            if x:
                x[rng.randrange(len(x))] = rng.choice("éß日q")
        texts.append("".join(x))
    texts += ["".join(rng.choice("klmno") for _ in range(50)) + base[100:190] + "".join(rng.choice("klmno") for _ in range(50)) for _ in range(12)]  # a passage in many surroundings
    ids = [*range(len(texts)), 7, 8]
    texts += texts[7:9]
    d = spark.createDataFrame([(i, t, "mine") for i, t in zip(ids, texts)], "doc_id long, text string, n_bytes string")
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    want = []
    for i, x in zip(ids, raw):
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if n[x[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    got = suffix_dedup.dedup(d, length=length, gram=gram, with_text=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == sorted(want)


def test_suffix_dedup_meets_awkward_and_empty_tables(spark):
    d = awkward(spark)
    assert suffix_dedup.dedup(d).count() == d.count()
    assert suffix_dedup.dedup(d.limit(0)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string")


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    big, odd = "x" * 1000, "\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(i, f"http://b.example.org/{i % 3}", big, "k") for i in range(12)] + [(20, "http://a.example.org", "x" * 999, "k"), (21, None, "x" * 999, "k")]
    rows += [(22, "bad\r\nurl", odd, "k"), (23, "http://c.org/é", odd, "k"), (24, "u", None, "k"), (25, "u", "", None), (11, "u", big, "k"), (None, "u", big, "k")]
    got = warc.round_trip(pages(spark, rows)).orderBy("range", "place").collect()
    assert [(r.key, r.time) for r in got] == sorted((r.key, r.time) for r in got)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        copies = [j for j, _, g, _ in rows if (g or "").encode() == raw and j is not None]
        keep = max(copies) if len(raw) >= 1000 else i
        want.append((i or -1, len(raw), hashlib.sha1(raw).hexdigest(), "response" if i == keep else "revisit", None if i == keep else keep))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted((*w[:4], -1 if w[4] is None else w[4]) for w in want)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_of_long_payloads_in_many_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 5)
    monkeypatch.setattr(warc, "DRAWN", 2)
    rng = random.Random(23)
    long = ["".join(rng.choice("abcdefgh<> ") for _ in range(3_000_000)) for _ in range(2)]
    rows = [(i, f"http://h{i % 4}.org/{i}", long[i] if i < 2 else long[0] if i == 2 else f"<p>{i}</p>" * 300, "k") for i in range(40)]
    got = warc.round_trip(pages(spark, rows).coalesce(1)).orderBy("range", "place").collect()
    assert [(r.key, r.time) for r in got] == sorted((r.key, r.time) for r in got) and len({r.range for r in got}) > 2
    assert {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in got} == {i: (len(h), "revisit" if i == 0 else "response", 2 if i == 0 else None) for i, _, h, _ in rows}


def test_warc_archives_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ROWS", 2)
    rng = random.Random(24)
    rows = [(i, "http://h.org/", rng.randbytes(1_000_000).hex(), "k") for i in range(12)]
    table = pages(spark, rows).coalesce(1)
    warc.write_archives(table, str(tmp_path / "a"))
    sizes = [r.length for r in spark.read.format("binaryFile").load(str(tmp_path / "a")).select("length").collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * warc.CHUNK + 2_000_000
    assert warc.read_index(spark, str(tmp_path / "a"), warc.splitters(table, "page_id", "url")).count() == 12


def test_warc_members_are_plain_gzip():
    import gzip

    for raw in (b"", b"abc" * 1000, bytes(range(256)) * 70_000):
        data = b"".join(warc.member(raw) + b"\0" for _ in range(2))
        assert gzip.decompress(data) == raw * 2
        assert [c for _, _, c in warc.members(data)] == ([raw] * 2 if raw else [])


def plain_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    k = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [h + p for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=len, default=None)


def test_url_rules_and_templates(spark):
    from sparkloom.llm.queries import URL_RULES

    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.org/es/1?x#y", "http://example.org?q=/es/", "http://a.b.com/de/x", "http://com/fr/", "http://xorg/", "x://É.org/#/f", "http://example.org/en/12", "http://example.orgs/en/1"]
    rows = [(i, u, None, None) for i, u in enumerate(odd)]
    rows += [(100 + i, f"http://shop.com/de/item/{i}", None, None) for i in range(30)] + [(200 + i, f"http://shop.com/en/item/{i}", None, None) for i in range(30)]
    got = {r.page_id: r for r in urls.filter_urls(pages(spark, rows), URL_RULES).collect()}
    verdict = {h + p: v for h, p, v in URL_RULES}
    for i, u, _, _ in rows:
        host, path, rule = plain_rule(u, URL_RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict[rule] if rule else got[i].verdict in ("allow", "block")
    assert got[105].template == "/de/item/<n>" and got[105].purity > 0.8 and got[205].verdict == "allow"
    assert urls.filter_urls(pages(spark, []), URL_RULES).count() == 0


def plain_templates(shapes):
    """shape -> template of one host's shapes (segments, n, labelled, blocked), by recursion."""
    out = {}

    def go(rows, done):
        by = collections.defaultdict(list)
        for r in rows:
            by[r[0][len(done)]].append(r)
        total = [sum(r[k] for r in rows) for k in (2, 3)]
        pooled = collections.defaultdict(list)
        for seg, members in by.items():
            n, labelled, blocked = (sum(r[k] for r in members) for k in (1, 2, 3))
            other = total[0] - labelled
            merged = len(by) > urls.FAN and n < urls.THIN
            if labelled and other:
                share = total[1] / total[0]
                error = (share * (1 - share) * (1 / labelled + 1 / other)) ** 0.5
                merged |= abs(blocked / labelled - (total[1] - blocked) / other) <= urls.SIMILAR * error
            pooled["*" if merged else seg] += members
        for seg, members in pooled.items():
            here = [*done, seg]
            ended = [r for r in members if len(r[0]) == len(here)]
            for r in ended:
                out[r[0]] = here
            if len(members) == 1 and not ended:
                out[members[0][0]] = [*here, *members[0][0][len(here) :]]
            elif rest := [r for r in members if len(r[0]) > len(here)]:
                go(rest, here)

    go(shapes, [])
    return {"/" + "/".join(k): "/" + "/".join(v) for k, v in out.items()}


@pytest.mark.parametrize("seed, small", [(31, 1000), (32, 1000), (33, 1), (34, 12)])
def test_url_templates_against_plain_recursion(spark, seed, small):
    rng = random.Random(seed)
    shapes = {}
    for _ in range(120):
        segs = tuple(rng.choice("abcdefghijklmnopq"[: rng.choice([2, 17])]) for _ in range(rng.randrange(1, 6)))
        n = rng.randrange(1, 12)
        labelled = rng.randrange(n + 1)
        shapes[segs] = (n, labelled, rng.randrange(labelled + 1))
    rows = [("h", "/" + "/".join(k), *v) for k, v in shapes.items()] + [("other", "/a/b", 1, 0, 0)]
    got = {(r.host, r.shape): r.template for r in urls.templates(spark.createDataFrame(rows, "host string, shape string, n long, labelled long, blocked long"), small).collect()}
    want = plain_templates([(k, *v) for k, v in shapes.items()])
    assert got == {("h", k): t for k, t in want.items()} | {("other", "/a/b"): "/a/b"}
    assert any("*" in t for t in want.values())


@pytest.mark.parametrize("small", [1, 1000])
def test_urls_that_share_a_thousand_segments(spark, small):
    deep = "/".join(f"s{'x' * (i % 3)}" for i in range(1000))
    shapes = [f"/{deep}/{end}" for end in ("a", "b/c", "b", "d" * 9)] + [f"/{deep}"]
    table = spark.createDataFrame([("h", x, 9, 0, 0) for x in shapes], "host string, shape string, n long, labelled long, blocked long")
    assert sorted((r.shape, r.template) for r in urls.templates(table, small).collect()) == sorted((x, x) for x in shapes)


def test_urls_long_repeated_and_with_clashing_columns(spark):
    rules = [("a.net", "/x/", "block")]
    long = "http://a.net/" + "/".join(f"s{i % 7}x{'y' * (i % 5)}" for i in range(300)) + "?" + "q" * 100_000
    rows = [(1, long, "mine"), (1, long, "mine"), (2, "http://a.net/x/1", "mine"), (3, "http://A.net" + "/z" * 150, None), (4, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string").withColumns({c: F.lit("mine") for c in ("path", "template", "under", "seg", "shape", "n")})
    got = urls.filter_urls(table, rules).collect()
    assert sorted((r.page_id, r.host, r.verdict) for r in got) == [(1, "a.net", "allow"), (1, "a.net", "allow"), (2, "a.net", "block"), (3, "a.net", "allow"), (4, "", "allow")]
    assert {r.shape for r in got} == {"mine"} and next(r for r in got if r.page_id == 3).path == "/z" * 150


def test_url_templates_reject_by_purity(spark):
    rules = [("bad.net", "/x/1", "block"), ("good.net", "/", "allow")]
    rows = [(i, f"http://bad.net/x/{i}", None, None) for i in range(100, 200)] + [(i, f"http://bad.net/x/{i}", None, None) for i in range(200, 300)] + [(i, f"http://good.net/y/{i}", None, None) for i in range(300, 340)]
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages(spark, rows), rules).collect()}
    assert {got[i] for i in range(100, 300)} == {"block"}  # no rule decides 200 and on; their template's labels all say block
    assert {got[i] for i in range(300, 340)} == {"allow"}


def test_url_templates_tell_deep_branches_apart(spark):
    rules = [("h.net", "/a/b/c/d/e/f/bad/1", "block"), ("h.net", "/a/b/c/d/e/f/good/1", "allow")]
    rows = [(n + i, f"http://h.net/a/b/c/d/e/f/{w}/{100 + i}", None, None) for n, w in ((0, "bad"), (1000, "good")) for i in range(200)]
    got = {r.page_id: r for r in urls.filter_urls(pages(spark, rows), rules).collect()}
    assert got[150].template == "/a/b/c/d/e/f/bad/<n>" and got[1150].template == "/a/b/c/d/e/f/good/<n>"
    assert {got[i].verdict for i in range(200)} == {"block"} and {got[1000 + i].verdict for i in range(200)} == {"allow"}


def test_repeated_rows_take_no_places_of_other_ids(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 8)).astype(np.float32)
    v[:20] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(0, [float(x) for x in v[0]])] * 10
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id").isin(0, 5, 15), k=10, gather=10**6).collect()
    for q in (0, 5, 15):
        got = [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
        assert got == [i for i in range(20) if i != q][:10]


def test_suffix_dedup_of_ten_thousand_copies_of_a_row(spark):
    text = " ".join(f"word{i * i % 101} and{i}" for i in range(60)) + " end"
    docs = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(2, "a text of its own")], "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(docs).collect())
    assert got == {(1, len(text), 1): 10_000, (2, 0, 0): 1}


def test_warc_of_ten_thousand_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 500)
    rows = spark.range(10_000).select(F.lit(7).cast("long").alias("page_id"), F.lit("http://h/a").alias("url"))
    rows = rows.unionByName(spark.createDataFrame([(i, f"http://h/{i}") for i in range(100)], "page_id long, url string"))
    first, inner = warc.splitters(rows, "page_id", "url")
    assert len(first) <= warc.PARTS and len(set(first)) == len(first)
    assert sum(len(r.cuts) for r in inner.collect()) <= 101
