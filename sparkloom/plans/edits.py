"""Queries on edits and on what stands in lines, over documents, conversations and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits as op
from ..operators.texts import line_edits
from ..session import table
from . import texts
from .registry import ORACLES, query

_KE = "ke AS (SELECT doc_id AS doc, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines FROM documents)"


@query(f"WITH {_KE} SELECT doc, len(lines)::INT AS n, sum(octet_length(encode(x)))::BIGINT AS bytes FROM (SELECT doc, lines, unnest(lines) AS x FROM ke) GROUP BY doc, lines")
def kept_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), op.kept_ends(F.col("text")).alias("lines"))
    return rows.where(F.size("lines") > 0).select("doc", F.size("lines").alias("n"), F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x)).alias("bytes"))


_PICK = "coalesce(lines[{}], 'none')"
_EDITS = f"""[{{'line': 2, 'before': CASE WHEN doc % 5 = 0 THEN 'other' ELSE {_PICK.format(2)} END, 'after': 'new 2' || chr(10)}}, {{'line': 3, 'before': '', 'after': 'put in' || chr(10)}}, {{'line': 5, 'before': {_PICK.format(5)}, 'after': ''}},
  {{'line': 6, 'before': CASE doc % 3 WHEN 0 THEN {_PICK.format(6)} WHEN 1 THEN {_PICK.format(7)} ELSE {_PICK.format(5)} END, 'after': 'new 6' || chr(10)}}]"""


@query(
    f"""WITH RECURSIVE {_KE}, e AS (SELECT doc, lines, len(lines) AS n, {_EDITS} AS edits FROM ke),
    s AS (SELECT doc, lines, n, edits, 1 AS k, 0 AS src, 0 AS off, '' AS out FROM e UNION ALL
      SELECT doc, lines, n, edits, k + 1, CASE WHEN skip THEN src WHEN adds OR NOT same THEN pos ELSE pos + 1 END, CASE WHEN skip THEN off WHEN adds THEN off + 1 WHEN same AND drops THEN off - 1 ELSE off END,
        CASE WHEN skip THEN out WHEN adds OR (same AND NOT drops) THEN out || array_to_string(lines[src + 1 : pos], '') || x.after ELSE out || array_to_string(lines[src + 1 : pos], '') END
      FROM (SELECT *, (adds AND ix > n) OR (NOT adds AND ix >= n) OR ix < 0 AS skip, pos < n AND coalesce(lines[pos + 1] = x.before, false) AS same FROM
        (SELECT *, x.before = '' AND x.after <> '' AS adds, x.before <> '' AND x.after = '' AS drops, greatest(src, least(ix, n)) AS pos FROM (SELECT *, edits[k] AS x, edits[k].line - 1 + off AS ix FROM s WHERE k <= len(edits)))))
    SELECT doc, md5(out || array_to_string(lines[src + 1 :], '')) AS text FROM s WHERE k = len(edits) + 1"""
)
def lenient_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "doc_id", "text").where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), op.kept_ends(F.col("text")).alias("lines"))
    d = F.col("doc")
    pick = lambda k: F.coalesce(F.get("lines", F.lit(k - 1)), F.lit("none"))
    made = [
        (2, F.when(d % 5 == 0, "other").otherwise(pick(2)), F.lit("new 2\n")), (3, F.lit(""), F.lit("put in\n")), (5, pick(5), F.lit("")),
        (6, F.when(d % 3 == 0, pick(6)).when(d % 3 == 1, pick(7)).otherwise(pick(5)), F.lit("new 6\n")),
    ]
    edits = F.array(*(F.struct(F.lit(k).alias("line"), b.alias("before"), a.alias("after")) for k, b, a in made))
    return rows.select("doc", F.md5(op.lenient(F.col("lines"), edits).cast("binary")).alias("text"))


_XT = "xt AS (SELECT conv_id * 1000 + turn AS k, text AS a, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'new ' || text WHEN 2 THEN replace(text, 'e', 'é') ELSE substr(text, 1, 20) || 'x' || chr(10) || substr(text, 30) END AS b FROM conversations)"
_POINT = "(len({0}) - len(replace({0}, '0a', '')))"


@query(
    f"""WITH {_XT}, h AS (SELECT k, regexp_extract_all(lower(hex(encode(a))), '..') AS x, regexp_extract_all(lower(hex(encode(b))), '..') AS y FROM xt),
    f AS (SELECT *, least(len(x), len(y)) AS m, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i]), true) - 1, least(len(x), len(y))) AS front FROM h),
    g AS (SELECT *, coalesce(list_position(list_transform(range(0, m - front), lambda i: x[len(x) - i] <> y[len(y) - i]), true) - 1, m - front) AS back FROM f),
    p AS (SELECT k, front, len(x) - back AS oe, len(y) - back AS ne, x[:front] AS s, x[:len(x) - back] AS o, y[:len(y) - back] AS n FROM g)
    SELECT k, front::INT AS start, oe::INT AS old_end, ne::INT AS new_end, len(list_filter(s, lambda c: c = '0a'))::INT AS start_row, (coalesce(list_position(list_reverse(s), '0a') - 1, len(s)))::INT AS start_column,
      len(list_filter(o, lambda c: c = '0a'))::INT AS old_row, (coalesce(list_position(list_reverse(o), '0a') - 1, len(o)))::INT AS old_column, len(list_filter(n, lambda c: c = '0a'))::INT AS new_row, (coalesce(list_position(list_reverse(n), '0a') - 1, len(n)))::INT AS new_column FROM p"""
)
def edit_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").selectExpr(
        "conv_id * 1000 + turn AS k", "text AS a",
        "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'new ' || text WHEN 2 THEN replace(text, 'e', 'é') ELSE substr(text, 1, 20) || 'x' || char(10) || substr(text, 30) END AS b",
    )
    return rows.select("k", op.byte_extent("a", "b").alias("x")).select("k", "x.*")


_DEC = f"ac AS ({ORACLES['line_diff']}), dc AS (SELECT doc, line_no, before, after FROM ac WHERE doc % 4 = 0 OR (doc % 4 = 1 AND line_no < 3) UNION ALL SELECT doc, 1 AS line_no, 'x' AS before, 'y' AS after FROM b WHERE line_no = 1 AND doc % 7 = 0 AND doc NOT IN (SELECT doc FROM ac))"


@query(
    f"""WITH {texts._CV}, {_DEC}, t AS (SELECT DISTINCT doc FROM b), n AS (SELECT t.doc, (SELECT count(*) FROM dc WHERE dc.doc = t.doc) AS n_declared, (SELECT count(*) FROM ac WHERE ac.doc = t.doc) AS n_actual FROM t)
    SELECT doc, CASE WHEN n_actual = 0 AND n_declared > 0 THEN 'cleared' WHEN n_actual = n_declared THEN 'kept' ELSE 'normalized' END AS status, n_declared, n_actual FROM n"""
)
def edit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = texts._versions(spark, sf_dir)
    actual = line_edits(before, after)
    stale = before.where("line_no = 1 AND doc % 7 = 0").join(actual.select("doc").distinct(), "doc", "left_anti").select("doc", F.col("line_no"), F.lit("x").alias("before"), F.lit("y").alias("after"))
    declared = actual.where("doc % 4 = 0 OR (doc % 4 = 1 AND line_no < 3)").unionByName(stale)
    return op.coverage(before, after, declared)


@query("SELECT conv_id * 1000 + turn AS k, md5(CASE WHEN turn % 2 = 0 THEN text ELSE text || '!' END) AS text FROM conversations")
def stabilized_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.md5(op.stabilized(t, F.concat(t, F.lit("!")), F.col("turn") % 2).cast("binary")).alias("text"))


CODE = """CASE line_no % 14 WHEN 0 THEN 'int x' || length(line) || ' = 1;' WHEN 1 THEN 'auto m = std::map<int, a = b>();' WHEN 2 THEN '  Foo(const Foo& o = {}) = delete;' WHEN 3 THEN '// a = b' WHEN 4 THEN 'f(a = ' || length(line) || ') == c = d;'
  WHEN 5 THEN 'std::map<int, std::vector<int>> v = w;' WHEN 6 THEN 's += "a = b"; t = u' WHEN 7 THEN 'virtual ~Bar() = default; // x = y' WHEN 8 THEN 'a <= b; c >= d; e != f; g = h' WHEN 9 THEN 'é << 2 = 3' WHEN 10 THEN '{ x = 1 } y = 2'
  WHEN 11 THEN 'c = \\'=\\'; d' WHEN 12 THEN 'q("\\\\" = ") ; z = 1' ELSE line END"""
_CL = texts._lines(CODE.replace("\\'", "''").replace("\\\\", "\\"))
_HEAD = "regexp_extract(line, '^(.*)= {0}', 1, 's')"


@query(
    f"""WITH {_CL} SELECT doc, line_no, CASE WHEN contains(line, '= delete') AND contains({_HEAD.format('delete')}, '(') THEN octet_length(encode({_HEAD.format('delete')})) ELSE octet_length(encode({_HEAD.format('default')})) END::INT AS place FROM c
    WHERE NOT (ltrim(line) LIKE '//%' OR ltrim(line) LIKE '#%') AND ((contains(line, '= delete') AND contains({_HEAD.format('delete')}, '(')) OR (contains(line, '= default') AND contains({_HEAD.format('default')}, '(')))"""
)
def clause_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.lines(spark, sf_dir, CODE).select("doc", "line_no", op.clause_at(F.col("line")).alias("place")).where("place IS NOT NULL")


_ST = "{'par': %s, 'ang': %s, 'bra': %s, 'quote': %s, 'skip': %s, 'found': %s, 'c': '', 'next': '', 'prev': '', 'rest': '', 'i': 0::BIGINT}"


def _to(**k: str) -> str:
    return _ST % tuple(k.get(f, f"s.{f}") for f in ("par", "ang", "bra", "quote", "skip", "found"))


_FLAT, _EQ = "(s.par = 0 AND s.bra = 0)", "(x.c = '=' AND s.par = 0 AND s.bra = 0 AND s.ang <= 0)"


@query(
    f"""WITH {_CL}, d AS (SELECT DISTINCT line, string_split(line, '') AS cs FROM c WHERE contains(line, '=') AND NOT (ltrim(line) LIKE '//%' OR ltrim(line) LIKE '#%')),
    z AS (SELECT line, cs, list_transform(range(1, len(cs) + 1), lambda i: {{'par': 0, 'ang': 0, 'bra': 0, 'quote': '', 'skip': 0, 'found': -1::BIGINT, 'c': cs[i], 'next': coalesce(cs[i + 1], ''), 'prev': CASE WHEN i > 1 THEN cs[i - 1] ELSE '' END, 'rest': ltrim(substr(line, i + 1)), 'i': i - 1}}) AS xs FROM d),
    r AS (SELECT line, cs, list_reduce(list_prepend({{'par': 0, 'ang': 0, 'bra': 0, 'quote': '', 'skip': 0, 'found': -1::BIGINT, 'c': '', 'next': '', 'prev': '', 'rest': '', 'i': 0::BIGINT}}, xs), lambda s, x: CASE WHEN s.found >= 0 THEN s WHEN s.skip > 0 THEN {_to(skip='s.skip - 1')}
      WHEN s.quote <> '' AND x.c = '\\' THEN {_to(skip='1')} WHEN s.quote <> '' THEN {_to(quote="CASE WHEN x.c = s.quote THEN '' ELSE s.quote END")} WHEN x.c IN ('"', '''') THEN {_to(quote='x.c')}
      WHEN x.c = '(' THEN {_to(par='s.par + 1')} WHEN x.c = ')' THEN {_to(par='s.par - 1')} WHEN x.c = '{{' THEN {_to(bra='s.bra + 1')} WHEN x.c = '}}' THEN {_to(bra='s.bra - 1')}
      WHEN x.c = '<' AND {_FLAT} AND x.next = '<' THEN {_to(skip='1')} WHEN x.c = '<' AND {_FLAT} THEN {_to(ang='s.ang + 1')}
      WHEN x.c = '>' AND {_FLAT} AND s.ang > 0 AND x.next = '>' THEN {_to(ang='greatest(s.ang - 2, 0)', skip='1')} WHEN x.c = '>' AND {_FLAT} AND s.ang > 0 THEN {_to(ang='s.ang - 1')}
      WHEN {_EQ} AND x.next = '=' THEN {_to(skip='1')} WHEN {_EQ} AND x.prev NOT IN ('!', '<', '>', '+', '-', '*', '/', '%', '&', '|', '^') AND NOT (x.rest LIKE 'delete%' OR x.rest LIKE 'default%') THEN {_to(found='x.i')} ELSE s END).found AS k FROM z)
    SELECT doc, line_no, octet_length(encode(array_to_string(cs[:k], '')))::INT AS place FROM c JOIN r USING (line) WHERE k >= 0"""
)
def assignment_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.lines(spark, sf_dir, CODE).select("doc", "line_no", op.assignment_at(F.col("line")).alias("place")).where("place IS NOT NULL")


TYPES = ["float", "double", "int", "char", "unsigned int", "unsigned long", "long long", "unsigned long long", "long double", "short int", "unsigned short", "bool", "long", "signed char", "unsigned"]
KINDS = ["Float", "LongDouble", "ULongLong", "Int", "Bool", "UShort", "Float128", "Long"]


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


@query(
    f"""WITH t AS (SELECT p_partkey, {_list(TYPES)}[1 + (p_partkey % {len(TYPES)})::INT] AS n, {_list(KINDS)}[1 + (p_size % {len(KINDS)})::INT] AS k FROM part)
    SELECT p_partkey, CASE n WHEN 'float' THEN 'f' WHEN 'unsigned int' THEN 'U' WHEN 'unsigned long' THEN 'UL' WHEN 'long long' THEN 'LL' WHEN 'unsigned long long' THEN 'ULL' WHEN 'long double' THEN 'L' WHEN 'unsigned short' THEN 'U' WHEN 'long' THEN 'L' WHEN 'unsigned' THEN 'U' WHEN 'bool' THEN NULL ELSE '' END AS written,
      CASE k WHEN 'Float' THEN 'f' WHEN 'LongDouble' THEN 'L' WHEN 'ULongLong' THEN 'ULL' WHEN 'Int' THEN '' WHEN 'UShort' THEN 'U' WHEN 'Float128' THEN 'Q' WHEN 'Long' THEN 'L' END AS kind FROM t"""
)
def type_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", op.type_suffix(pick(TYPES, "p_partkey")).alias("written"), op.kind_suffix(pick(KINDS, "p_size")).alias("kind"))


OLD = "CASE line_no % 6 WHEN 0 THEN '} // end ' || length(line) WHEN 1 THEN '  A(A) = delete;' WHEN 2 THEN '// x(y) = delete;' WHEN 3 THEN 'B() = default;' ELSE line END"
NEW = "CASE line_no % 6 WHEN 0 THEN '    }  //  end  ' || length(line) WHEN 1 THEN 'A(A)  =  delete;' WHEN 3 THEN 'B()=default;' ELSE '  ' || line END"
_KEY = "regexp_replace(line, '[ \\t\\n\\f\\r]', '', 'g')"


@query(
    f"""WITH {texts._L}, o AS (SELECT doc, line_no, {OLD} AS line FROM l), nw AS (SELECT doc, line_no, {NEW} AS line FROM l WHERE line_no % 7 > 0),
    b AS (SELECT doc, line AS old, {_KEY} AS key, row_number() OVER (PARTITION BY doc, {_KEY} ORDER BY line_no) AS r FROM o
      WHERE (contains(line, '// end ') AND contains(line, '}}')) OR (NOT (ltrim(line) LIKE '//%' OR ltrim(line) LIKE '#%') AND (contains({_KEY}, ')=delete;') OR contains({_KEY}, ')=default;')) AND contains({_KEY}, '('))),
    a AS (SELECT doc, line_no, line, {_KEY} AS key, row_number() OVER (PARTITION BY doc, {_KEY} ORDER BY line_no) AS r FROM nw)
    SELECT a.doc, line_no, md5(coalesce(old, line)) AS line FROM a LEFT JOIN b ON a.doc = b.doc AND a.key = b.key AND a.r = b.r AND a.key <> ''"""
)
def sensitive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = texts.lines(spark, sf_dir, NEW).where("line_no % 7 > 0")
    return op.keep_sensitive(texts.lines(spark, sf_dir, OLD), after).select("doc", "line_no", F.md5(F.col("line").cast("binary")).alias("line"))


@query(f"WITH {texts._L}, s AS (SELECT doc, line_no, octet_length(encode(line)) AS n, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc ORDER BY line_no) - octet_length(encode(line)) - 1 AS start FROM l) SELECT doc, line_no, start::BIGINT AS start, (start + n)::BIGINT AS stop FROM s")
def line_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.line_bounds(texts.lines(spark, sf_dir)).select("doc", "line_no", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


@query("SELECT p_partkey, nullif(regexp_extract(substr('  ' || p_name || ' = 12 + ' || p_type, (1 + p_size % 9)::INT), '[A-Za-z_][A-Za-z0-9_]*'), '') AS name FROM part")
def identifiers_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("  "), "p_name", F.lit(" = 12 + "), "p_type")
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size").select("p_partkey", op.identifier_at(line, (1 + F.col("p_size") % 9).cast("int")).alias("name"))


@query(
    """SELECT p_partkey, list_filter(range(0, length(p_name)), lambda i: substr(p_name, i + 1, 1) = 'a') AS places, strpos(p_type, 'T') - 1 AS first, regexp_matches(p_name, '(^|[^A-Za-z0-9_])part($|[^A-Za-z0-9_])') AS word, length(p_type) - length(ltrim(p_type)) AS lead, regexp_full_match(p_brand, '(.)') AS same FROM part"""
)
def text_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand")
    return p.select(
        "p_partkey", F.transform(op.occurrences_of(F.col("p_name"), "a"), lambda i: i.cast("bigint")).alias("places"), (F.instr("p_type", "T") - 1).cast("bigint").alias("first"), op.whole_word(F.col("p_name"), "part").alias("word"),
        (F.length("p_type") - F.length(F.ltrim("p_type"))).cast("bigint").alias("lead"), F.col("p_brand").rlike("^(.)\\1*$").alias("same"),
    )


BLOCKS = "CASE line_no % 10 WHEN 1 THEN 'namespace a' || line_no || ' {' WHEN 2 THEN 'class B : public C {' WHEN 3 THEN '  int f() {' WHEN 4 THEN '  }' WHEN 5 THEN '};' WHEN 6 THEN 'struct {' WHEN 7 THEN '} // end old' WHEN 8 THEN '} }' WHEN 9 THEN '}' ELSE 'x' END"
_RE_OPEN = op.OPENER.replace("'", "''")


@query(
    f"""WITH {texts._lines(BLOCKS)}, r AS (SELECT *, sum(length(line) - length(replace(line, '{{', '')) - length(line) + length(replace(line, '}}', ''))) OVER (PARTITION BY doc ORDER BY line_no) AS aft FROM c),
    b AS (SELECT *, coalesce(lag(aft) OVER (PARTITION BY doc ORDER BY line_no), 0) AS bef FROM r), o AS (SELECT doc, line_no AS i, aft AS depth, rtrim(regexp_extract(line, '{_RE_OPEN}', 1) || ' ' || regexp_extract(line, '{_RE_OPEN}', 2)) AS label FROM b WHERE regexp_matches(line, '{_RE_OPEN}') AND aft > bef),
    x AS (SELECT doc, line_no, line, unnest(range(aft::BIGINT + 1, bef::BIGINT + 1)) AS depth FROM b WHERE aft < bef), p AS (SELECT o.doc, x.line_no, x.line, o.depth, label, row_number() OVER (PARTITION BY o.doc, o.i ORDER BY x.line_no) AS r, o.i FROM o JOIN x ON x.doc = o.doc AND x.depth = o.depth AND x.line_no > o.i),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc, line_no ORDER BY depth, i DESC) AS k FROM p WHERE r = 1)
    SELECT doc, line_no, line AS before, regexp_replace(line, '\\s+$', '') || ' // end ' || label AS after FROM q WHERE k = 1 AND contains(line, '}}') AND NOT contains(line, '//')"""
)
def end_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.end_comments(texts.lines(spark, sf_dir, BLOCKS))


GUARDS = "CASE WHEN doc % 3 = 0 AND line_no = 2 THEN '#pragma  once' WHEN doc % 4 = 0 AND line_no = 1 THEN '#ifndef X' || doc || '_' WHEN doc % 8 = 0 AND line_no = 2 THEN '#define X' || doc || '_' WHEN doc % 8 = 4 AND line_no = 2 THEN '#define Y_' ELSE line END"


@query(
    f"""WITH {texts._lines(GUARDS)}, p AS (SELECT doc FROM c GROUP BY doc), o AS (SELECT DISTINCT doc FROM c WHERE regexp_matches(trim(regexp_replace(line, '\\s+', ' ', 'g')), '^# ?pragma once$')),
    t AS (SELECT doc, line_no, regexp_extract(trim(regexp_replace(line, '\\s+', ' ', 'g')), '^# ?ifndef ([A-Za-z_][A-Za-z0-9_]*)', 1) AS n FROM c), f AS (SELECT doc, line_no, regexp_extract(trim(regexp_replace(line, '\\s+', ' ', 'g')), '^# ?define ([A-Za-z_][A-Za-z0-9_]*)', 1) AS n FROM c),
    g AS (SELECT DISTINCT t.doc FROM t JOIN f ON t.doc = f.doc AND t.n = f.n AND f.line_no > t.line_no WHERE t.n <> '')
    SELECT doc, 1 + doc % 3 AS line_no, '#pragma once' AS after FROM p WHERE doc NOT IN (SELECT doc FROM o) UNION ALL SELECT doc, 1, '#ifndef FILE' || doc || '_H_' FROM p WHERE doc NOT IN (SELECT doc FROM g)"""
)
def include_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = texts.lines(spark, sf_dir, GUARDS)
    docs = lines.select("doc").distinct()
    return op.include_guards(lines, docs.select("doc", F.format_string("FILE%d_H_", "doc").alias("macro")), docs.select("doc", (1 + F.col("doc") % 3).alias("line_no")), "both")


VOIDS = "CASE line_no % 8 WHEN 0 THEN 'int  f ();' WHEN 1 THEN '  static const Foo* get( void ) const {' WHEN 2 THEN 'return g();' WHEN 3 THEN 'bool operator()();' WHEN 4 THEN 'void h(int a);' WHEN 5 THEN 'virtual ~Bar ()' WHEN 6 THEN 'k();' ELSE line END"


@query(
    f"""WITH {texts._lines(VOIDS)}, v AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*(return|else|new|delete|throw|case|goto|using|typedef)\\b') OR contains(line, 'operator') THEN line ELSE regexp_replace(line, '{op.EMPTY_PARAMETERS}', '\\1\\2(void)\\3') END AS after FROM c)
    SELECT doc, line_no, after FROM v WHERE after <> line"""
)
def void_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts.lines(spark, sf_dir, VOIDS).withColumn("after", op.void_parameters(F.col("line")))
    return rows.where("after <> line").select("doc", "line_no", "after")


@query(
    f"""WITH n AS (SELECT p_partkey, ['getName', 'get_name', 's_BigName', 'MAX_SIZE', 'int', 'HTTPServer', 'm_x', 'aB2C'][1 + (p_partkey % 8)::INT] AS name, ['', 's_', 'm_'][1 + (p_size % 3)::INT] AS prefix FROM part),
    b AS (SELECT *, CASE WHEN prefix <> '' AND starts_with(name, prefix) THEN substr(name, length(prefix) + 1) ELSE name END AS bare FROM n),
    s AS (SELECT *, prefix || lower(regexp_replace(regexp_replace(bare, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS new FROM b)
    SELECT p_partkey, new AS name FROM s WHERE name NOT IN ('int', 'MAX_SIZE', 'm_x') AND NOT regexp_matches(name, '^[CS]_[A-Z_][A-Z0-9_]*$|^[cs]_[a-z_][a-z0-9_]*$') AND new <> name
    UNION ALL SELECT p_partkey, new FROM s WHERE name = 'm_x' AND new <> name"""
)
def naming_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    name = pick("p_partkey", "getName", "get_name", "s_BigName", "MAX_SIZE", "int", "HTTPServer", "m_x", "aB2C")
    found = table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", op.suggested_name(name, pick("p_size", "", "s_", "m_")).alias("name"))
    return found.where("name IS NOT NULL")
