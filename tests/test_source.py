"""Scanning and structure of source text against plain versions that read it character by character."""

import random
import re

import pytest
from pyspark.sql import functions as F
from sparkloom.operators import scanning, scopes, symbols, trees

LINES = "doc long, line_no long, line string"


def lines_of(spark, texts):
    rows = [(d, n, line) for d, t in texts.items() for n, line in enumerate(t.split("\n"), 1)]
    return spark.createDataFrame(rows, LINES)


def plain_ranges(text):
    """One character after another, over Latin-1 text."""
    out, i, n, fresh = [], 0, len(text), True

    def quoted(i, q):
        while i < n and text[i] != q and text[i] != "\n":
            i += 2 if text[i] == "\\" and not text.startswith("\\\r\n", i) else 3 if text[i] == "\\" else 1
        return min(n, i + (i < n and text[i] == q))

    while i < n:
        c = text[i]
        header = fresh and re.compile(r"[ \t]*#[ \t]*include[ \t]*(<[^>\n]*>)").match(text, i)
        fresh = c == "\n"
        if header:
            out.append((*header.span(1), "header"))
            i = header.end()
        elif text.startswith("//", i):
            j = i
            while j < n and text[j] != "\n":
                j += 3 if text.startswith("\\\r\n", j) else 2 if text.startswith("\\\n", j) else 1
            out.append((i, min(j, n), "comment"))
            i = j
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
            out.append((i, j, "comment"))
            i = j
        elif c.isascii() and c.isdigit():
            i += 1
            while i < n and (text[i].isalnum() or text[i] in "_." or ord(text[i]) > 127 or text[i] == "'" and i + 1 < n and (text[i + 1].isalnum() or text[i + 1] in "_." or ord(text[i + 1]) > 127)):
                i += 1
        else:
            prefix = next((p for p in ("u8", "u", "U", "L", "") if text.startswith(p, i) and (text[i + len(p) : i + len(p) + 1] or " ") in "\"'R"), None)
            j = i + len(prefix or "")
            raw = prefix is not None and re.compile(r'R"([^\s()\\"]{0,16})\(').match(text, j)
            if raw:
                e = text.find(")" + raw[1] + '"', raw.end())
                e = n if e < 0 else e + len(raw[1]) + 2
                out.append((i, e, "raw_string"))
                i = e
            elif prefix is not None and text[j : j + 1] in ('"', "'") and j < n:
                e = quoted(j + 1, text[j])
                out.append((i, e, "string" if text[j] == '"' else "char"))
                i = e
            elif c.isalnum() or c == "_" or ord(c) > 127:
                while i < n and (text[i].isalnum() or text[i] == "_" or ord(text[i]) > 127):
                    i += 1
            else:
                i += 1
    return out


def made_up(rng, n):
    parts = ["//", "/*", "*/", '"', "'", "\\", "\\\n", "\n", "\n", 'R"(', ')"', 'R"x(', ')x"', 'u8R"y(', ')y"', "u8", "L", "R", "#include <a/b>\n", "\n# include <x", "1'000", "7", "name", " ", "é", "(", ")", "{", "}", ";", "\\\r\n"]
    return "".join(rng.choice(parts) for _ in range(n))


def ranges(spark, texts, **kw):
    found = scanning.non_code_ranges(lines_of(spark, texts), **kw).collect()
    return sorted((r.doc, r.start, r.end, r.kind) for r in found)


@pytest.mark.parametrize("size, fan", [(1, 2), (2, 3), (256, 64)])
def test_non_code_ranges_equal_a_plain_scanner(spark, size, fan):
    rng = random.Random(size)
    texts = {d: made_up(rng, rng.randrange(150)) for d in range(60)}
    want = sorted((d, len(t[:a].encode()), len(t[:e].encode()), k) for d, t in texts.items() for a, e, k in plain_ranges(t))
    assert ranges(spark, texts, size=size, fan=fan) == want


def test_a_range_over_many_chunks_and_levels(spark):
    text = "a /* b" + "\nfiller 'x" * 100 + '\n*/ c R"q(' + '\n"' * 80 + '\n)q" d // e'
    assert ranges(spark, {1: text, 2: "", 3: "/*"}, size=1, fan=2) == [(1, *x) for x in plain_ranges(text)] + [(3, 0, 2, "comment")]
    assert scanning.non_code_ranges(lines_of(spark, {1: ""}).limit(0)).count() == 0


def test_maps_of_chunks_compose(spark):
    rng = random.Random(9)
    for _ in range(200):
        a, b = (made_up(rng, 12).encode() + b"\n" for _ in range(2))
        one, two, both = scanning.transitions(a), scanning.transitions(b), scanning.transitions(a + b)
        for s in {*"c/*\"'", *one, *two, *both, "Rother"}:
            assert two.get(one.get(s, s), one.get(s, s)) == both.get(s, s), (a, b, s)


def plain_tokens(text):
    code = list(text)
    for a, e, _ in plain_ranges(text):
        code[a:e] = ["\n" if c == "\n" else " " for c in text[a:e]]
    out = []
    for m in re.finditer(r"[A-Za-z_\x80-￿][0-9A-Za-z_\x80-￿]*|[0-9](?:'?[0-9A-Za-z_.\x80-￿])*|::|->|[^ \t\r\n\f\v]", "".join(code)):
        out.append((text.count("\n", 0, m.start()) + 1, len(text[: m.start()].encode()), m[0]))
    return out


def test_tokens_equal_a_plain_scanner(spark):
    rng = random.Random(4)
    texts = {d: made_up(rng, rng.randrange(120)) for d in range(40)}
    got = sorted(tuple(r) for r in scanning.tokens(lines_of(spark, texts), 2, 3).collect())
    assert got == sorted((d, *t) for d, text in texts.items() for t in plain_tokens(text))


def plain_braces(tokens):
    stack, out = [], {}
    for _, at, t in tokens:
        if t == "{":
            stack.append(at)
            out[at] = None
        elif t == "}" and stack:
            out[stack.pop()] = at
    return out


SOURCE = """\
#include <vector>
namespace a :: b { // {
template < class T > class C final : public B<T> {
  int m = 1;
  void f(int a, char c) const {
    for (int i = 0; i < a; i++) { g("}"); }
    auto l = [&](int x) { return x; };
    int list[] = { 1, 2 };
    if (c == '{') { } else { }
  }
  ~C() noexcept { }
};
#if X
enum class E { A, B };
#  ifdef Y
struct S * make() { }
#  else
#define Z(x) {
#  endif
#elif W
#endif
union U {
"""


def test_scopes_of_a_source(spark):
    tokens = scanning.tokens(lines_of(spark, {1: SOURCE + "\n", 2: "}{", 3: ""}))
    got = {(r.start_line, r.end_line, r.kind, r.name) for r in scopes.scopes(tokens).where("doc = 1").collect()}
    last = SOURCE.count("\n")
    assert got == {
        (2, last, "namespace", "a::b"), (3, 12, "template", None), (3, 12, "type", "C"), (5, 10, "function", "f"), (6, 6, "block", None), (7, 7, "lambda", None), (8, 8, "list", None),
        (9, 9, "block", None), (11, 11, "function", "~C"), (14, 14, "type", "E"), (16, 16, "function", "make"), (22, last, "type", "U"),
        (13, 21, "preprocessor", None), (15, 19, "preprocessor", None), (17, 19, "preprocessor", None), (20, 21, "preprocessor", None), (18, 18, "preprocessor", "Z"),
    }
    spans = {(r.start, r.end, r.body) for r in scopes.scopes(tokens).where("doc = 2").collect()}
    assert spans == {(1, 2, 1)}


def test_braces_match_as_with_a_stack(spark):
    rng = random.Random(6)
    texts = {d: "".join(rng.choice(["{", "}", "{", "}", "x ", "\n", ";", '"}"']) for _ in range(rng.randrange(80))) for d in range(40)}
    tokens = scanning.tokens(lines_of(spark, texts))
    got = {(r.doc, r["at"]): r.close for r in scopes.matched(tokens.where("token IN ('{', '}')"), F.col("token") == "{").collect()}
    assert got == {(d, a): c for d, t in texts.items() for a, c in plain_braces(plain_tokens(t)).items()}


def random_tree(rng, start, end, depth=0):
    """Nested spans of made-up kinds."""
    out = [(start, end, rng.choice("abcd"))]
    at = start + rng.randrange(2)
    while at < end - 1 and depth < 6:
        stop = min(end, at + 1 + rng.randrange(end - at))
        out += random_tree(rng, at, stop, depth + 1)
        at = stop + rng.randrange(2)
    return out


class Node:
    def __init__(self, span):
        (self.start, self.end, self.kind), self.kids = span, []

    def walk(self, stops=(), root=True):
        """Document order, not below stops; ``root``: whether the root is asked too."""
        if root:
            yield self
        if not root or self.kind not in stops:
            for k in self.kids:
                yield from k.walk(stops)


def plain_tree(spans):
    """Nodes in document order, with parents."""
    order, stack, nodes = sorted(spans, key=lambda x: (x[0], -x[1], x[2])), [], []
    for s in order:
        n = Node(s)
        while stack and stack[-1].end <= n.start:
            stack.pop()
        n.level, n.parent, n.pre = len(stack), stack[-1].pre if stack else None, len(nodes)
        if stack:
            stack[-1].kids.append(n)
        stack.append(n)
        nodes.append(n)
    return nodes


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(12)
    spans = {d: [x for a in range(0, 240, 80) for x in random_tree(rng, a, a + 78)] for d in range(8)}
    nodes = trees.labelled(spark.createDataFrame([(d, *s) for d, t in spans.items() for s in t], "doc long, start long, end long, kind string"))
    return nodes, {d: plain_tree(t) for d, t in spans.items()}


def test_labels(forest):
    got = sorted((r.doc, r.pre, r.start, r.end, r.kind, r.level, r.parent, r.size) for r in forest[0].collect())
    assert got == [(d, n.pre, n.start, n.end, n.kind, n.level, n.parent, sum(1 for _ in n.walk()) - 1) for d, t in forest[1].items() for n in t]


@pytest.mark.parametrize("root", [True, False])
def test_first_descendant(forest, root):
    got = {(r.doc, r.a): r.b for r in trees.first_descendant(forest[0], F.col("kind") == "a", F.col("kind").isin("b", "c"), root).collect()}
    want = {(d, n.pre): next((x.pre for x in n.walk("bc", root) if x.kind == "a"), None) for d, t in forest[1].items() for n in t}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_rightmost_descendant_and_children(forest):
    got = {(r.doc, r.a): r.b for r in trees.rightmost_descendant(forest[0], F.col("kind").isin("a", "d"), F.col("kind") == "b").collect()}
    want = {(d, n.pre): max(((x.start, x.pre) for x in n.walk("b") if x.kind in "ad"), default=(0, None))[1] for d, t in forest[1].items() for n in t}
    assert got == {k: v for k, v in want.items() if v is not None}
    kids = {(r.doc, r.a): r.b for r in trees.children(forest[0], "c").collect()}
    want = {(d, n.pre): next((k.pre for k in n.kids if k.kind == "c"), None) for d, t in forest[1].items() for n in t}
    assert kids == {k: v for k, v in want.items() if v is not None}


def plain_paths(nodes, path, at=None):
    """Matches of the rest of a path below ``at``."""
    if not path:
        return [()]
    (axis, kind), rest = path[0], path[1:]
    below = nodes if at is None else at.kids if axis == "/" else list(at.walk(root=False))
    return [(n.pre, *m) for n in below if n.kind == kind for m in plain_paths(nodes, rest, n)]


@pytest.mark.parametrize("path", [[("//", "a")], [("//", "a"), ("//", "a"), ("//", "b")], [("//", "a"), ("/", "b"), ("//", "c")], [("//", "b"), ("//", "c"), ("/", "c")]])
def test_paths(forest, path):
    got = sorted(tuple(r) for r in trees.path_matches(forest[0], path).collect())
    assert got == sorted((d, *m) for d, t in forest[1].items() for m in plain_paths(t, path))


def test_twigs_with_and_without_ranges(spark, forest):
    nodes, plain = forest
    stem, branches = [("//", "a"), ("//", "b")], [[("//", "c")], [("/", "d")]]
    want = {(d, *s, *x, *y) for d, t in plain.items() for s in plain_paths(t, stem) for x in plain_paths(t, branches[0], t[s[-1]]) for y in plain_paths(t, branches[1], t[s[-1]])}
    got = trees.twig_matches(nodes, stem, branches)
    assert want and sorted(tuple(r) for r in got.collect()) == sorted(want)
    ranges = {d: [(d * 9, d * 9 + 4), (150, 151), (7, 7)] for d in range(0, 8, 2)}
    changed = spark.createDataFrame([(d, *r) for d, rs in ranges.items() for r in rs], "doc long, start long, end long")
    touched = {m for m in want if any(s < e and plain[m[0]][m[1]].start < e and s < plain[m[0]][m[1]].end for s, e in ranges.get(m[0], []))}
    assert sorted(tuple(r) for r in trees.twig_matches(nodes, stem, branches, changed).collect()) == sorted(touched)
    assert trees.twig_matches(trees.labelled(spark.createDataFrame([], "doc long, start long, end long, kind string")), stem, branches).count() == 0


DECLARED = """\
namespace a::n1 {
template <class T, class U> struct Box : Base<T> {
  const std::map<int, T> items, *more = f(x, y), last;
  explicit Box(int size, const T& init = T()) : n(size) { }
  ~Box() { return; }
  static Box<T>* make(unsigned long k);
  virtual void g() const = 0;
  bool operator==(const Box& other) const { return n == other.n; }
};
enum class Color : char { red };
struct Fwd;
struct Fwd object;
int x = 1, y[3], *z;
x = y * z;
f(x);
return x;
delete x;
auto l = [](int p, char) { go(p); };
for (auto& item : list) { }
for (int i = 0; i < n; i++) { a + b; }
if (x * y) { }
using T = int;
}
"""


def test_declarations(spark):
    tokens = scanning.tokens(lines_of(spark, {1: DECLARED}))
    found = symbols.declarations(scopes.statements(tokens)).collect()
    line = {t[1]: t[0] for t in plain_tokens(DECLARED)}
    assert {(line[r["at"]], r.name, r.kind) for r in found} == {
        (1, "n1", "namespace"), (2, "Box", "type"), (3, "items", "variable"), (3, "more", "variable"), (3, "last", "variable"), (4, "Box", "function"), (4, "size", "parameter"), (4, "init", "parameter"), (5, "Box", "function"),
        (6, "make", "function"), (7, "g", "function"), (8, "operator", "function"), (8, "other", "parameter"), (10, "Color", "type"), (11, "Fwd", "type"), (12, "object", "variable"), (13, "x", "variable"), (13, "y", "variable"), (13, "z", "variable"),
        (18, "l", "variable"), (18, "p", "parameter"), (19, "item", "variable"), (20, "i", "variable"),
    }


def plain_meaning(nodes, declared, used):
    """Innermost declaration by walking up. ``nodes``: a plain tree; declared: (at, name, scope), used: (at, name, scope)."""
    out = {}
    for at, name, scope in used:
        now, steps = scope, 0
        while True:
            here = [a for a, n, s in declared if n == name and s == now and (a < at or now >= 0 and nodes[now].kind == "type")]
            if here:
                out[at] = (max([a for a in here if a < at], default=min(here)), steps)
                break
            if now < 0:
                break
            now, steps = (-1 if nodes[now].parent is None else nodes[now].parent), steps + 1
    return out


@pytest.fixture(scope="module")
def named(spark):
    """A random tree of scopes with declarations and uses at random places."""
    rng = random.Random(21)
    plain, rows, declared, used = {}, [], {}, {}
    for d in range(6):
        spans = [(a, e, {"a": "type", "b": "function", "c": "block", "d": "namespace"}[k]) for a, e, k in random_tree(rng, 2, 200)]
        plain[d] = plain_tree(spans)
        rows += [(d, *s) for s in spans]
        at = rng.sample(range(205), 120)
        scope = lambda p, d=d: max((n.pre for n in plain[d] if n.start <= p < n.end), key=lambda i, d=d: plain[d][i].level, default=-1)
        every = [(p, rng.choice("xyzw"), scope(p)) for p in at]
        declared[d], used[d] = every[:50], every[50:]
    nodes = trees.labelled(spark.createDataFrame(rows, "doc long, start long, end long, kind string"))
    decl = spark.createDataFrame([(d, a, n, "variable", a) for d, t in declared.items() for a, n, _ in t], "doc long, at long, name string, kind string, head long")
    use = spark.createDataFrame([(d, 1, a, n) for d, t in used.items() for a, n, _ in t], "doc long, line_no long, at long, name string")
    return nodes, symbols.declared_in(decl, nodes).cache(), symbols.placed(use, nodes, 2 * F.col("at")).cache(), plain, declared, used


def test_every_reference_means_the_innermost_visible_declaration(named):
    nodes, decl, use, plain, declared, used = named
    assert {(r.doc, r["at"]): r.scope for r in decl.collect()} == {(d, a): s for d, t in declared.items() for a, _, s in t}
    got = {(r.doc, r["at"]): (r.decl, r.steps) for r in symbols.resolve(use, decl, symbols.ancestors(nodes)).collect()}
    assert got == {(d, a): m for d in plain for a, m in plain_meaning(plain[d], declared[d], used[d]).items()}


def test_ancestors_by_doubling(spark):
    chain = trees.labelled(spark.createDataFrame([(1, i, 200 - i, "k") for i in range(37)], "doc long, start long, end long, kind string"))
    got = {(r.pre, r.above): r.steps for r in symbols.ancestors(chain).collect()}
    assert got == {(i, j): i - j for i in range(37) for j in range(-1, i + 1)}


def test_a_rename_without_objection_keeps_every_meaning(spark, named):
    nodes, decl, use, plain, declared, used = named
    above = symbols.ancestors(nodes).cache()
    found = symbols.resolve(use, decl, above).cache()
    wanted = decl.where("name IN ('x', 'y')").select("doc", F.col("at").alias("decl"), F.when(F.col("name") == "x", "y").otherwise("w").alias("new"))
    plans = symbols.rename_plan(wanted, decl, found, use, above).collect()
    free = changed = 0
    for p in plans:
        d = p.doc
        before = plain_meaning(plain[d], declared[d], used[d])
        mine = {p.decl} | {a for a, m in before.items() if m[0] == p.decl}
        assert p.n == len(mine)
        put = lambda rows: [(a, p.new if a in mine else n, s) for a, n, s in rows]  # noqa: B023, E731
        after = plain_meaning(plain[d], put(declared[d]), put(used[d]))
        same = all(after.get(a, (None,))[0] == m[0] for a, m in before.items())
        if not p.captured and not p.shadows:
            free += 1
            assert same
        changed += not same
    assert free and changed


def test_names_are_replaced_at_byte_places(spark):
    lines = lines_of(spark, {1: "é = é + ab; ab\nab"})
    starts = spark.createDataFrame([(1, 1, 0), (1, 2, 17)], "doc long, line_no long, start long")
    places = spark.createDataFrame([(1, 1, 0, "é", "long"), (1, 1, 10, "ab", "x"), (1, 2, 17, "ab", "ü")], "doc long, line_no long, at long, old string, new string")
    got = {r.line_no: r.line for r in symbols.renamed_lines(lines, starts, places).collect()}
    assert got == {1: "long = é + x; ab", 2: "ü"}


@pytest.mark.parametrize("size, fan", [(1, 2), (4, 3)])
def test_a_rescan_equals_a_scan_of_the_edited_text(spark, size, fan):
    rng = random.Random(31)
    texts = {d: made_up(rng, rng.randrange(20, 200)) for d in range(40)}
    stored = scanning.stored_scan(lines_of(spark, texts), size, fan)
    edits, after = [], {}
    for d, t in texts.items():
        lines = t.split("\n")
        new = [[x] for x in lines]
        for i in rng.sample(range(len(lines)), min(len(lines), rng.randrange(4))):
            new[i] = [made_up(rng, 5).replace("\n", "") for _ in range(rng.randrange(3))]
            edits.append((d, i + 1, new[i]))
        after[d] = "\n".join(x for xs in new for x in xs)
    changed = spark.createDataFrame(edits, "doc long, line_no long, lines array<string>")
    chunks, pieces, n = scanning.rescan(*stored, lines_of(spark, texts), changed, size, fan)
    got = sorted((r.doc, r.start, r.end, r.kind) for r in scanning.assembled(pieces, chunks).collect())
    want = sorted((d, len(t[:a].encode()), len(t[:e].encode()), k) for d, t in after.items() for a, e, k in plain_ranges(t))
    assert [x for x in got if x[1] < x[2]] == want
    read = {r.doc: r.n_rescanned for r in n.collect()}
    assert set(read) <= {d for d, *_ in edits} and 0 < sum(read.values()) < sum(t.count("\n") + 1 for t in after.values())


def test_a_rescan_stops_where_the_states_agree(spark):
    text = "int a;\n" * 50 + "/* b\n" * 20 + "*/\n" + "int c;\n" * 50
    lines = lines_of(spark, {1: text, 2: text})
    stored = scanning.stored_scan(lines, 5, 4)
    edit = lambda line, *new: spark.createDataFrame([(1, line, list(new))], "doc long, line_no long, lines array<string>")
    read = lambda e: {r.doc: r.n_rescanned for r in scanning.rescan(*stored, lines, e, 5, 4)[2].collect()}
    assert read(edit(12, "int x; // y")) == {1: 5}
    assert read(edit(12, "int x; /* y", "z")) == {1: 6 + 35 + 5}  # until the text is in a comment anyway


def test_unmatched_brackets_against_stacks(spark):
    rng = random.Random(12)
    rows = [(d, i // 5, i, rng.choice("{}()[]a;")) for d in range(12) for i in range(rng.randrange(60))]
    want = set()
    for d in range(12):
        for o, c in ("{}", "()", "[]"):
            stack = []
            for _, _, i, t in (r for r in rows if r[0] == d):
                if t == o:
                    stack.append(i)
                elif t == c and stack:
                    stack.pop()
                elif t == c:
                    want.add((d, i))
            want |= {(d, i) for i in stack}
    got = scopes.unmatched(spark.createDataFrame(rows, "doc long, line_no long, at long, token string")).collect()
    assert len(got) == len(rows) and {(r.doc, r["at"]) for r in got if r.bad} == want
