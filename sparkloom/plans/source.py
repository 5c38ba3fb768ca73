"""Queries on source text: the lines of ``documents`` stand for a source file by a made-up rule.

The rule turns blocks of 24 lines into nested scopes with comments, strings and
directives that hold brackets and quotes; the documents' own words and lengths
give what they contain. Documents end anywhere in a block, so brackets, comments
and strings stay open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, scanning, scopes as op, symbols, trees
from ..operators.lineage import cut
from ..operators.lookups import error_stats
from ..session import table
from . import texts
from .registry import query

_N = "length(line)"
_BLOCK = [
    "' }' || repeat(' }', CAST(line_no % 48 / 24 AS INT))",
    f"'namespace n' || ({_N} % 3) || ' {{'",
    "'/* ' || line",
    f"'\" { chr(123) } */ int v' || ({_N} % 7) || ' = 1' || chr(39) || '000; // }}'",
    f"'class C' || ({_N} % 4) || ' : public B {{'",
    f"' int m' || ({_N} % 5) || ';'",
    f"' void f' || ({_N} % 6) || '(int v' || ({_N} % 7) || ', char c) {{'",
    "'  s = \"{ ' || chr(92) || '\" ' || replace(line, '\"', '') || ' }\";'",
    f"'  if (v' || ({_N} % 7) || ' > ' || chr(39) || '{{' || chr(39) || ') {{'",
    f"'   int v' || ({_N} % 7) || ' = m' || ({_N} % 5) || ';'",
    "'   t = R\"x( /*'",
    "line",
    f"')\" )x\"; v' || ({_N} % 7) || ' = 2;'",
    "'  }'",
    f"'  for (int i = 0; i < v' || ({_N} % 7) || '; i++) {{ v' || ({_N} % 5) || ' += i; }}'",
    "' }'",
    f"'#if A' || ({_N} % 3)",
    f"' int g' || ({_N} % 5) || '() const {{ return m' || ({_N} % 5) || '; }}'",
    "'#else'",
    "' enum E { X, Y };'",
    "'#endif'",
    "'};'",
    "'// tail ' || chr(92)",
    "' goes on \" {'",
]
SOURCE = "CASE line_no % 24 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_BLOCK)) + " END"

#: All of a text in pieces: comments, strings, characters and raw strings, numbers, names, blanks and single characters.
_PIECES = r"""(?s)//(?:[^\\\n]|\\\r?\n|\\)*|/\*.*?(?:\*/|\z)|(?:u8|[uUL])?R"\(.*?(?:\)"|\z)|(?:u8|[uUL])?R"x\(.*?(?:\)x"|\z)|(?:u8|[uUL])?"(?:[^"\\\n]|\\\r?\n|\\[^\n])*"?|(?:u8|[uUL])?''(?:[^''\\\n]|\\\r?\n|\\[^\n])*''?|[0-9](?:''?[0-9A-Za-z_.\x{80}-\x{10FFFF}])*|[A-Za-z_\x{80}-\x{10FFFF}][0-9A-Za-z_\x{80}-\x{10FFFF}]*|::|->|[ \t\r\f\v]+|."""
_SCAN = rf"""{texts._lines(SOURCE)},
whole AS (SELECT doc, string_agg(line, chr(10) ORDER BY line_no) AS text FROM c GROUP BY doc),
cutup AS (SELECT doc, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (SELECT doc, regexp_extract_all(text, '{_PIECES}') AS p FROM whole)),
placed AS (SELECT *, sum(octet_length(encode(piece))) OVER (PARTITION BY doc ORDER BY i)::BIGINT AS stop, 1 + sum(length(piece) - length(replace(piece, chr(10), ''))) OVER (PARTITION BY doc ORDER BY i) - length(piece) + length(replace(piece, chr(10), '')) AS line_no FROM cutup),
kinds AS (SELECT *, stop - octet_length(encode(piece)) AS pos, CASE WHEN piece LIKE '//%' OR piece LIKE '/*%' THEN 'comment' WHEN regexp_matches(piece, '^(u8|[uUL])?R"') THEN 'raw_string' WHEN regexp_matches(piece, '^(u8|[uUL])?"') THEN 'string' WHEN regexp_matches(piece, '^(u8|[uUL])?''') THEN 'char' END AS kind FROM placed),
tokens AS (SELECT doc, line_no::BIGINT AS line_no, pos, piece AS token, stop FROM kinds WHERE kind IS NULL AND NOT regexp_matches(piece, '^\s+$'))"""


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.lines(spark, sf_dir, SOURCE)


def source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.tokens(source_lines(spark, sf_dir))


@query(f"WITH {_SCAN} SELECT doc, pos AS start, stop AS \"end\", kind FROM kinds WHERE kind IS NOT NULL")
def non_code_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.non_code_ranges(source_lines(spark, sf_dir))


@query(f"WITH {_SCAN} SELECT doc, line_no, pos AS \"at\", token FROM tokens")
def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_tokens(spark, sf_dir)


_BRACES = """
b AS (SELECT doc, pos, line_no, token = '{' AS o, sum(CASE WHEN token = '{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc ORDER BY pos) AS r FROM tokens WHERE token IN ('{', '}')),
low AS (SELECT *, coalesce(min(r) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
ok AS (SELECT doc, pos, line_no, o, r - least(0, before, r) + CASE WHEN o THEN 0 ELSE 1 END AS depth FROM low WHERE r >= least(0, before)),
pairs AS (
  SELECT a.doc, a.pos AS body, a.line_no, z.pos AS close, z.line_no AS close_line
  FROM ok a LEFT JOIN LATERAL (SELECT pos, line_no FROM ok z WHERE z.doc = a.doc AND z.depth = a.depth AND z.pos > a.pos AND NOT z.o ORDER BY pos LIMIT 1) z ON true WHERE a.o)"""


@query(f"WITH {_SCAN}, {_BRACES} SELECT doc, body AS \"at\", close FROM pairs")
def matched_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.matched(source_tokens(spark, sf_dir).where("token IN ('{', '}')"), F.col("token") == "{")
    return found.select("doc", "at", "close")


_CONTROL = "^(else|if|for|while|switch|do|try|catch)\\b"
_SCOPES = rf"""{_BRACES},
firsts AS (SELECT *, first_value(token) OVER (PARTITION BY doc, line_no ORDER BY pos) AS f FROM tokens),
code AS (SELECT *, sum((token IN ('{{', '}}'))::INT) OVER (PARTITION BY doc ORDER BY pos) - (token IN ('{{', '}}'))::INT AS part FROM firsts WHERE f <> '#'),
paren AS (SELECT *, sum(CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY doc, part ORDER BY pos) AS r FROM code),
depth AS (SELECT *, token IN ('{{', '}}') OR token = ';' AND r - least(0, min(r) OVER (PARTITION BY doc, part ORDER BY pos)) = 0 AS ends FROM paren),
seg AS (SELECT *, sum(ends::INT) OVER (PARTITION BY doc ORDER BY pos) - ends::INT AS seg FROM depth),
statement AS (
  SELECT doc, seg, min(pos) FILTER (NOT ends) AS start, max(stop) FILTER (NOT ends) AS stop, min(line_no) FILTER (NOT ends) AS line_no, coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (NOT ends), '') AS head,
    max(token) FILTER (ends) AS ends, max(pos) FILTER (ends) AS body, max(line_no) FILTER (ends) AS body_line
  FROM seg GROUP BY doc, seg),
ending AS (SELECT doc, max(stop) AS last, max(line_no) AS last_line FROM tokens GROUP BY doc),
kinded AS (
  SELECT *, CASE WHEN regexp_matches(head, '^namespace\b') THEN 'namespace' WHEN regexp_matches(head, '^(class|struct|union|enum)\b') AND NOT contains(head, '(') THEN 'type'
    WHEN regexp_matches(head, '{_CONTROL}') OR head = '' THEN 'block' WHEN NOT contains(head, '(') OR regexp_matches(head, '(=|return|,|\()$') THEN 'list' ELSE 'function' END AS kind
  FROM statement WHERE ends = '{{'),
scope AS (
  SELECT k.doc, coalesce(start, k.body) AS start, coalesce(close + 1, last) AS "end", k.body, coalesce(k.line_no, body_line) AS start_line, coalesce(close_line, last_line) AS end_line, kind,
    nullif(CASE kind WHEN 'namespace' THEN regexp_extract(head, '^namespace (\w+)', 1) WHEN 'type' THEN regexp_extract(head, '^(?:class |struct |union |enum )+(\w+)', 1) WHEN 'function' THEN regexp_extract(head, '^[^(]*?(\w+) \(', 1) END, '') AS name
  FROM kinded k JOIN pairs p ON k.doc = p.doc AND k.body = p.body JOIN ending e ON k.doc = e.doc)"""
_DIRECTIVES = """
words AS (SELECT doc, pos, line_no, lead(token) OVER w AS word, row_number() OVER w AS n, max(stop) OVER (PARTITION BY doc, line_no) AS stop, token FROM tokens WINDOW w AS (PARTITION BY doc, line_no ORDER BY pos)),
d AS (SELECT * FROM words WHERE n = 1 AND token = '#'),
condition AS (
  SELECT d.doc, d.pos AS start, d.line_no, d.word, first(z.pos ORDER BY z.pos) AS z, first(z.stop ORDER BY z.pos) AS zs, first(z.line_no ORDER BY z.pos) AS zl
  FROM d LEFT JOIN d z ON z.doc = d.doc AND z.pos > d.pos AND z.word = 'endif' WHERE d.word IN ('if', 'else') GROUP BY ALL)"""


@query(
    f"""WITH {_SCAN}, {_SCOPES}, {_DIRECTIVES} SELECT doc, start, "end", body, start_line, end_line, kind, name FROM scope
    UNION ALL SELECT doc, start, coalesce(CASE word WHEN 'if' THEN zs ELSE z END, last), start, line_no, coalesce(zl, last_line), 'preprocessor', NULL FROM condition JOIN ending USING (doc)"""
)
def source_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.scopes(source_tokens(spark, sf_dir))


@query(
    f"""WITH {_SCAN}, {_SCOPES}, u AS (SELECT doc, pos, token FROM tokens WHERE regexp_matches(token, '^[vm][0-9]$')),
    q AS (SELECT u.*, s.start, s.kind, row_number() OVER (PARTITION BY u.doc, u.pos ORDER BY s."end" - s.start, s.start DESC) AS r FROM u JOIN scope s ON s.doc = u.doc AND u.pos BETWEEN s.start AND s."end" - 1)
    SELECT doc, pos AS "at", token, start, kind FROM q WHERE r = 1"""
)
def innermost_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope around each use of a variable."""
    tokens = source_tokens(spark, sf_dir)
    spans = op.scopes(tokens).where("kind <> 'preprocessor'").select("doc", "start", (F.col("end") - 1).alias("last"), "kind")
    found = joins.point_in_interval(tokens.where("token RLIKE '^[vm][0-9]$'"), spans, ["doc"], "at", "start", "last", 512)
    return joins.innermost(found, ["doc", "at"], "start", "last").select("doc", "at", "token", "start", "kind")


def source_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scopes that nest, as labelled nodes."""
    return trees.labelled(op.scopes(source_tokens(spark, sf_dir), conditions=False).where("kind <> 'template'").select("doc", "start", "end", "kind"))


_NODES = f"""{_SCAN}, {_SCOPES},
node AS (SELECT doc, start, "end", kind, row_number() OVER (PARTITION BY doc ORDER BY start, "end" DESC, kind) - 1 AS pre FROM scope),
inside AS (SELECT a.doc, a.pre AS a, a.kind AS a_kind, a.start AS a_start, a."end" AS a_end, b.pre AS b, b.kind AS b_kind, b.start AS b_start FROM node a JOIN node b ON a.doc = b.doc AND b.pre > a.pre AND b.start < a."end"),
levels AS (SELECT doc, b, count(*) AS level, max(a) AS parent FROM inside GROUP BY doc, b)"""


@query(f"WITH {_NODES} SELECT n.doc, n.start, n.pre, coalesce(level, 0) AS level, parent, (SELECT count(*) FROM inside i WHERE i.doc = n.doc AND i.a = n.pre) AS size FROM node n LEFT JOIN levels l ON l.doc = n.doc AND l.b = n.pre")
def tree_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_nodes(spark, sf_dir).select("doc", "start", "pre", "level", "parent", "size")


@query(f"WITH {_NODES} SELECT doc, a, b_kind AS kind, count(*) AS n FROM inside GROUP BY ALL")
def descendants_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = source_nodes(spark, sf_dir)
    pairs = trees.descendants(nodes, nodes)
    return pairs.join(nodes.select("doc", F.col("pre").alias("b"), "kind"), ["doc", "b"]).groupBy("doc", "a", "kind").agg(F.count("*").alias("n"))


#: Targets are blocks; a search doesn't go below functions.
_REACHED = f"""{_NODES},
bar AS (SELECT doc, b, max(a) AS bar FROM inside WHERE a_kind = 'function' GROUP BY doc, b)"""


@query(f"WITH {_REACHED} SELECT i.doc, a, min(i.b) AS b FROM inside i LEFT JOIN bar r ON r.doc = i.doc AND r.b = i.b WHERE b_kind = 'block' AND a >= coalesce(bar, -1) GROUP BY ALL")
def first_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.first_descendant(source_nodes(spark, sf_dir), F.col("kind") == "block", F.col("kind") == "function", root=False)


@query(
    f"""WITH {_REACHED}, self AS (SELECT doc, a, b, b_start FROM inside WHERE b_kind = 'block' UNION ALL SELECT doc, pre, pre, start FROM node WHERE kind = 'block')
    SELECT s.doc, a, max_by(s.b, (b_start, s.b)) AS b FROM self s LEFT JOIN bar r ON r.doc = s.doc AND r.b = s.b WHERE a = s.b OR a > coalesce(bar, -1) GROUP BY ALL"""
)
def rightmost_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.rightmost_descendant(source_nodes(spark, sf_dir), F.col("kind") == "block", F.col("kind") == "function")


_TWIG = f"""{_NODES},
twig AS (
  SELECT x.doc, x.a AS n0, x.b AS n1, y.b AS n2, z.b AS n3, x.a_start, x.a_end
  FROM inside x JOIN levels l ON l.doc = x.doc AND l.b = x.b AND l.parent = x.a JOIN inside y ON y.doc = x.doc AND y.a = x.b JOIN inside z ON z.doc = x.doc AND z.a = x.b
  WHERE x.a_kind = 'namespace' AND x.b_kind = 'type' AND y.b_kind = 'function' AND z.b_kind = 'block')"""


@query(f"WITH {_TWIG} SELECT doc, n0, n1, n2, n3 FROM twig")
def tree_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that stand in a namespace, with each of their functions and blocks."""
    return trees.twig_matches(source_nodes(spark, sf_dir), [("//", "namespace"), ("/", "type")], [[("//", "function")], [("//", "block")]])


@query(f"WITH {_TWIG} SELECT doc, n0, n1, n2, n3 FROM twig WHERE a_start < 40 * (doc % 25) + 30 AND 40 * (doc % 25) < a_end")
def tree_patterns_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("doc"), (40 * (F.col("doc_id") % 25)).alias("start"), (40 * (F.col("doc_id") % 25) + 30).alias("end"))
    return trees.twig_matches(source_nodes(spark, sf_dir), [("//", "namespace"), ("/", "type")], [[("//", "function")], [("//", "block")]], changed)


_WORDS = "('int', 'void', 'char', 'class', 'public', 'enum', 'if', 'for', 'return', 'const', 'namespace', 'else')"
_DECLARED = f"""{_NODES},
around AS (SELECT doc, seg, pos, stop, token, r, lag(token) OVER (PARTITION BY doc ORDER BY pos) AS p, lead(token) OVER (PARTITION BY doc ORDER BY pos) AS n FROM seg),
decl AS (
  SELECT a.doc, a.pos, token AS name, s.start AS head,
    CASE WHEN p = 'namespace' THEN 'namespace' WHEN p IN ('class', 'enum') THEN 'type' WHEN n = '(' THEN 'function' WHEN a.r > 0 AND k.kind = 'function' THEN 'parameter' ELSE 'variable' END AS kind
  FROM around a JOIN statement s USING (doc, seg) LEFT JOIN kinded k USING (doc, seg)
  WHERE regexp_matches(token, '^[A-Za-z_]') AND token NOT IN {_WORDS} AND (p IN ('namespace', 'class', 'enum') OR p IN ('int', 'void', 'char') AND n IN ('(', '=', ';', ',', ')')))"""


def source_declared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens, what they declare and their statements."""
    tokens = source_tokens(spark, sf_dir)
    found = cut(op.statements(tokens))
    return tokens, cut(symbols.declarations(found)), found


@query(f"WITH {_DECLARED} SELECT doc, pos AS \"at\", name, kind, head FROM decl")
def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_declared(spark, sf_dir)[1]


_MEANT = f"""{_DECLARED},
leveled AS (SELECT n.*, coalesce(level, 0) AS level FROM node n LEFT JOIN levels l ON l.doc = n.doc AND l.b = n.pre),
owned AS (
  SELECT d.doc, d.pos, d.name, d.kind, coalesce(max_by(n.pre, n.level), -1) AS scope, coalesce(max(n.level), -1) AS level
  FROM decl d LEFT JOIN leveled n ON n.doc = d.doc AND CASE WHEN d.kind IN ('variable', 'parameter') THEN n.start <= d.pos AND d.pos < n."end" ELSE n.start < d.head AND d.head < n."end" END GROUP BY ALL),
own AS (SELECT o.*, coalesce(n.kind = 'type', false) AS member FROM owned o LEFT JOIN leveled n ON n.doc = o.doc AND n.pre = o.scope),
every AS (SELECT doc, line_no, pos, token AS name, lag(token) OVER (PARTITION BY doc ORDER BY pos) AS p FROM tokens),
used AS (
  SELECT e.doc, e.line_no, e.pos, e.name, coalesce(max_by(n.pre, n.level), -1) AS scope, coalesce(max(n.level), -1) AS level
  FROM every e LEFT JOIN leveled n ON n.doc = e.doc AND n.start <= e.pos AND e.pos < n."end"
  WHERE regexp_matches(name, '^[A-Za-z_]') AND name NOT IN {_WORDS} AND coalesce(p NOT IN ('.', '->', '::', '#'), true) AND (e.doc, e.pos) NOT IN (SELECT (doc, pos) FROM decl) GROUP BY ALL),
up AS (SELECT doc, b AS pre, a AS above FROM inside UNION ALL SELECT doc, pre, pre FROM node UNION ALL SELECT doc, pre, -1 FROM node UNION ALL SELECT DISTINCT doc, -1, -1 FROM tokens),
meant AS (
  SELECT u.doc, u.line_no, u.pos, u.name, u.scope, u.level, o.pos AS decl, u.level - o.level AS steps
  FROM used u JOIN up ON up.doc = u.doc AND up.pre = u.scope JOIN own o ON o.doc = u.doc AND o.name = u.name AND o.scope = up.above AND (o.member OR o.pos < u.pos)
  QUALIFY row_number() OVER (PARTITION BY u.doc, u.pos ORDER BY o.level DESC, (o.pos < u.pos) DESC, CASE WHEN o.pos < u.pos THEN -o.pos ELSE o.pos END) = 1)"""


def source_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Declarations and uses with their scopes, the ancestors of scopes, and what the uses mean."""
    tokens, declared, found = source_declared(spark, sf_dir)
    nodes = trees.labelled(op.scopes(tokens, found, conditions=False).where("kind <> 'template'").select("doc", "start", "end", "kind"))
    used = cut(symbols.placed(symbols.references(tokens, declared), nodes, 2 * F.col("at")))
    declared, above = cut(symbols.declared_in(declared, nodes)), symbols.ancestors(nodes)
    return declared, used, above, cut(symbols.resolve(used, declared, above))


@query(f"WITH {_MEANT} SELECT doc, pos AS \"at\", name, decl, steps FROM meant")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_names(spark, sf_dir)[3].select("doc", "at", "name", "decl", F.col("steps").cast("bigint").alias("steps"))


_PLANNED = f"""{_MEANT},
wanted AS (SELECT doc, pos AS decl, name AS old, scope AS own, member, level, CASE WHEN pos % 2 = 0 THEN 'w' || name ELSE 'm' || (pos % 5) END AS new FROM own WHERE name LIKE 'v_' AND kind IN ('variable', 'parameter')),
mine AS (SELECT w.*, m.pos, m.scope, m.steps FROM wanted w JOIN (SELECT doc, pos, scope, decl, steps FROM meant UNION ALL SELECT doc, pos, scope, pos, 0 FROM own) m USING (doc, decl)),
capture AS (
  SELECT m.doc, m.decl, m.pos FROM mine m JOIN up ON up.doc = m.doc AND up.pre = m.scope JOIN own o ON o.doc = m.doc AND o.name = m.new AND o.scope = up.above AND (o.member OR o.pos < m.pos)
  WHERE o.level >= m.level GROUP BY ALL),
shadow AS (SELECT w.doc, w.decl, count(*) AS n FROM wanted w JOIN meant m ON m.doc = w.doc AND m.name = w.new JOIN up ON up.doc = m.doc AND up.pre = m.scope AND up.above = w.own WHERE m.level - w.level < m.steps AND (w.member OR w.decl < m.pos) GROUP BY ALL),
planned AS (
  SELECT doc, decl, old, new, count(*) AS n, (SELECT count(*) FROM capture c WHERE c.doc = m.doc AND c.decl = m.decl) AS captured, coalesce((SELECT s.n FROM shadow s WHERE s.doc = m.doc AND s.decl = m.decl), 0) AS shadows
  FROM mine m GROUP BY doc, decl, old, new)"""


def source_renames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    declared, used, above, meant = source_names(spark, sf_dir)
    new = F.when(F.col("at") % 2 == 0, F.concat(F.lit("w"), "name")).otherwise(F.concat(F.lit("m"), (F.col("at") % 5).cast("string")))
    wanted = declared.where("name LIKE 'v_' AND kind IN ('variable', 'parameter')").select("doc", F.col("at").alias("decl"), new.alias("new"))
    return declared, meant, symbols.rename_plan(wanted, declared, meant, used, above)


@query(f"WITH {_PLANNED} SELECT * FROM planned")
def rename_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_renames(spark, sf_dir)[2]


@query(
    f"""WITH {_PLANNED}, place AS (SELECT m.doc, m.pos, m.old, m.new FROM mine m JOIN planned USING (doc, decl) WHERE captured = 0 AND shadows = 0),
    pieces AS (SELECT k.doc, k.line_no, k.pos, CASE WHEN p.new IS NULL THEN piece ELSE p.new END AS piece FROM kinds k LEFT JOIN place p ON p.doc = k.doc AND p.pos = k.pos),
    text AS (SELECT doc, string_agg(piece, '' ORDER BY pos) AS text FROM pieces GROUP BY doc),
    again AS (SELECT doc, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no FROM (SELECT doc, string_split(text, chr(10)) AS a FROM text))
    SELECT c.doc, c.line_no, c.line AS before, a.line AS after FROM c JOIN again a USING (doc, line_no) WHERE c.line <> a.line"""
)
def renamed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that change where every rename without objection is made."""
    declared, meant, plan = source_renames(spark, sf_dir)
    free = cut(plan.where("captured = 0 AND shadows = 0"))
    lines = source_lines(spark, sf_dir)
    starts = cut(texts.op.offsets(lines).select("doc", "line_no", "start", (F.col("start") + F.octet_length("line")).alias("last")))
    places = meant.select("doc", "at", "decl").unionByName(declared.select("doc", "at", F.col("at").alias("decl"))).join(free, ["doc", "decl"])
    lined = joins.point_in_interval(places.select("doc", "at", "old", "new"), starts, ["doc"], "at", "start", "last", 4096)
    done = symbols.renamed_lines(lines.withColumn("before", F.col("line")), starts.drop("last"), lined.select("doc", "line_no", "at", "old", "new"))
    return done.where("before <> line").select("doc", "line_no", "before", F.col("line").alias("after"))


_EDITED = _SCAN.replace("whole AS (SELECT doc, string_agg(line, chr(10) ORDER BY line_no) AS text FROM c GROUP BY doc)", """again AS (SELECT doc, line_no, 0 AS part, CASE WHEN doc % 2 = 0 AND line_no % 29 = 5 THEN '/* new' ELSE line END AS line FROM c WHERE NOT (doc % 2 = 0 AND line_no % 29 = 17)
  UNION ALL SELECT doc, line_no, 1, line FROM c WHERE doc % 2 = 0 AND line_no % 29 = 5),
whole AS (SELECT doc, string_agg(line, chr(10) ORDER BY line_no, part) AS text FROM again GROUP BY doc)""")  # fmt: skip


@query(f"WITH {_EDITED} SELECT doc, pos AS start, stop AS \"end\", kind FROM kinds WHERE kind IS NOT NULL")
def rescanned_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of edited documents from the stored scan of what they were before."""
    lines = cut(source_lines(spark, sf_dir))
    changed = lines.where("doc % 2 = 0 AND line_no % 29 IN (5, 17)")
    new = F.when(F.col("line_no") % 29 == 5, F.array(F.lit("/* new"), "line")).otherwise(F.array().cast("array<string>"))
    stored = scanning.stored_scan(lines, 16)
    chunks, pieces, _ = scanning.rescan(*stored, lines, changed.select("doc", "line_no", new.alias("lines")), 16)
    return scanning.assembled(pieces, chunks)


LABELS = f"CASE line_no % 3 WHEN 0 THEN 'C' || ({_N} % 3) || '(int a) : m' || ({_N} % 5) || ' (a), k' || ({_N} % 4) || '(2) {{ }} // : m1(' WHEN 1 THEN 'x = m' || ({_N} % 5) || '(1);' ELSE 'f(q, m' || ({_N} % 5) || ');' END"


@query(
    f"""WITH {_SCAN.replace(SOURCE, LABELS)}, named AS (SELECT doc, pos, line_no, token AS name, lag(token) OVER w AS p, lag(line_no) OVER w AS pl, lead(token) OVER w AS n, lead(line_no) OVER w AS nl FROM tokens WINDOW w AS (PARTITION BY doc ORDER BY pos)),
    covered AS (SELECT DISTINCT doc, name FROM named WHERE regexp_matches(name, '^[mk][0-9]$') AND pos % 7 < 3)
    SELECT doc, name, min(pos) AS "at" FROM named SEMI JOIN covered USING (doc, name) WHERE p IN (':', ',') AND pl = line_no AND n = '(' AND nl = line_no AND pos % 7 >= 3 GROUP BY doc, name"""
)
def uncovered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = scanning.tokens(texts.lines(spark, sf_dir, LABELS))
    covered = tokens.where("token RLIKE '^[mk][0-9]$' AND at % 7 < 3").select("doc", F.col("token").alias("name"), "at")
    return symbols.uncovered_labels(tokens, covered)


@query(
    rf"""WITH {_SCAN}, b AS (SELECT doc, pos, line_no, token IN ('{{', '(', '[') AS o, CASE WHEN token IN ('{{', '}}') THEN 1 WHEN token IN ('(', ')') THEN 2 WHEN token IN ('[', ']') THEN 3 ELSE 0 END AS pair FROM tokens),
    s AS (SELECT *, sum(CASE WHEN pair = 0 THEN 0 WHEN o THEN 1 ELSE -1 END) OVER (PARTITION BY doc, pair ORDER BY pos) AS s FROM b),
    e AS (SELECT doc, line_no, CASE WHEN o THEN coalesce(min(s) OVER (PARTITION BY doc, pair ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) >= s, true) ELSE pair > 0 AND s < least(0, coalesce(min(s) OVER (PARTITION BY doc, pair ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) END AS bad FROM s)
    SELECT doc, round(count(*) FILTER (bad) / count(*), 9) AS ratio, count(*) FILTER (bad) AS errors, coalesce(list_sort(list(DISTINCT line_no) FILTER (bad)), []) AS lines FROM e GROUP BY doc"""
)
def source_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = op.unmatched(source_tokens(spark, sf_dir)).select("doc", F.col("line_no").alias("line"), "bad")
    return error_stats(nodes, ["doc"]).withColumn("ratio", F.round("ratio", 9))
