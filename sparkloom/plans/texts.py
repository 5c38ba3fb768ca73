"""Text queries over the lines of ``documents`` and over names in the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as fn
from ..operators import texts as op
from ..session import table
from .registry import query

_L = """l AS (SELECT doc, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (SELECT doc_id AS doc, string_split(text, chr(10)) AS a FROM documents))"""
COMMENTS = """CASE line_no % 9 WHEN 1 THEN '  //' || repeat('-', CAST(1 + length(line) % 70 AS INT)) WHEN 2 THEN '// ' || substr(line, 1, CAST(1 + length(line) % 30 AS INT)) WHEN 3 THEN ''
  WHEN 4 THEN '// Helpers' WHEN 5 THEN '//-----' WHEN 6 THEN '// User Defined Macros' WHEN 7 THEN ' //---' WHEN 8 THEN '  #define X' || length(line) ELSE line END"""
ALIGN = """CASE line_no % 6 WHEN 0 THEN 'x' || repeat('y', CAST(length(line) % 12 AS INT)) || '  = ' || length(line) WHEN 1 THEN 'v = ' || line_no WHEN 2 THEN '//--' WHEN 3 THEN 'long name = 1' ELSE substr(line, 1, 8) END"""
DIRECTIVES = """line || CASE line_no % 11 WHEN 3 THEN ' mjf:disable dash_comment' WHEN 7 THEN ' mjf:enable *' WHEN 9 THEN ' mjf:ignore snake, dash_comment' ELSE '' END"""
_S = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def lines(spark: SparkSession, sf_dir: str, shown: str = "line") -> DataFrame:
    return op.explode_lines(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").selectExpr("doc", "line_no", f"{shown} AS line")


def _lines(shown: str) -> str:
    return f"{_L}, c AS (SELECT doc, line_no, {shown} AS line FROM l)"


@query(f"WITH {_L} SELECT doc, line_no, octet_length(encode(line))::BIGINT AS n_bytes, line LIKE '% ' AS trailing FROM l")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc", "line_no", F.octet_length("line").cast("bigint").alias("n_bytes"), F.col("line").endswith(" ").alias("trailing"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS newlines, contains(text, chr(13) || chr(10)) AS crlf, text LIKE '%' || chr(10) AS ends FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", (F.length(t) - F.length(F.replace(t, F.lit("\n")))).cast("bigint").alias("newlines"), t.contains("\r\n").alias("crlf"), t.endswith("\n").alias("ends")
    )


@query(f"WITH {_L} SELECT doc, line_no, (sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc ORDER BY line_no) - octet_length(encode(line)) - 1)::BIGINT AS start FROM l")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.offsets(lines(spark, sf_dir)).select("doc", "line_no", "start")


@query(f"WITH {_lines(COMMENTS)} SELECT doc, count(*) AS lines, (count(*) FILTER ({_S.format('line')} LIKE '#%') * 10000) // count(*) AS macro_bp, (count(*) FILTER ({_S.format('line')} LIKE '//%') * 10000) // count(*) AS comment_bp FROM c GROUP BY doc")
def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.density(lines(spark, sf_dir, COMMENTS))


_T = f"""t AS (SELECT *, {_S.format('line')} AS s FROM c),
k AS (SELECT *, s LIKE '//%' AND {_S.format('substr(s, 3)')} <> '' AND NOT regexp_matches({_S.format('substr(s, 3)')}, '^-+$') AS title FROM t)"""


@query(
    f"""WITH {_lines(COMMENTS)}, {_T}, n AS (SELECT *, coalesce(lag(CASE WHEN title THEN octet_length(encode(s)) END) OVER w, lead(CASE WHEN title THEN octet_length(encode(s)) END) OVER w) AS tl FROM k WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
    d AS (SELECT *, CASE WHEN octet_length(encode(s)) >= 50 THEN 64 ELSE 28 END AS base FROM n WHERE regexp_matches(s, '^//-+$'))
    SELECT doc, line_no, line AS before, regexp_extract(line, '^\\s*') || '//' || repeat('-', CASE WHEN tl IS NOT NULL THEN greatest(base, tl, 28) ELSE base END - 2) AS after FROM d
    WHERE line <> regexp_extract(line, '^\\s*') || '//' || repeat('-', CASE WHEN tl IS NOT NULL THEN greatest(base, tl, 28) ELSE base END - 2)"""
)
def dash_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dash_comments(lines(spark, sf_dir, COMMENTS))


TITLES = {"helpers": "Utilities", "user defined macros": "Macros"}


@query(f"WITH {_lines(COMMENTS)}, {_T} SELECT doc, line_no, line AS before, '// ' || CASE lower({_S.format('substr(s, 3)')}) WHEN 'helpers' THEN 'Utilities' ELSE 'Macros' END AS after FROM k WHERE title AND lower({_S.format('substr(s, 3)')}) IN ('helpers', 'user defined macros')")
def section_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.section_titles(lines(spark, sf_dir, COMMENTS), TITLES)


@query(
    f"""WITH {_lines(COMMENTS)}, m AS (SELECT doc, min(line_no) AS mk FROM c WHERE line LIKE '// %' GROUP BY doc),
    s AS (SELECT c.doc, mk, min(CASE WHEN {_S.format('line')} <> '' THEN line_no END) AS stop, max(line_no) AS last FROM c JOIN m USING (doc) WHERE line_no > mk GROUP BY c.doc, mk)
    SELECT m.doc, m.mk AS line_no, coalesce(stop - m.mk - 1, last - m.mk, 0) AS blanks FROM m LEFT JOIN s USING (doc)"""
)
def blank_run_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.blanks_after(lines(spark, sf_dir, COMMENTS), F.col("line").startswith("// "))


@query(
    f"""WITH {_lines(COMMENTS)}, w AS (SELECT *, lag(line) OVER w AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS d FROM c WINDOW w AS (PARTITION BY doc ORDER BY line_no))
    SELECT doc, line_no + 2 AS line_no FROM w WHERE contains(lower(line), 'user defined macros') AND regexp_matches({_S.format('a')}, '^//-*$') AND regexp_matches({_S.format('b')}, '^//-*$') AND ltrim(d) LIKE '#define%'"""
)
def macro_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.macro_headers(lines(spark, sf_dir, COMMENTS))


@query(
    f"""WITH {_lines(DIRECTIVES)}, a AS (SELECT *, CASE line_no % 11 WHEN 3 THEN 'disable' WHEN 7 THEN 'enable' WHEN 9 THEN 'ignore' END AS act FROM c),
    s AS (SELECT *, last_value(CASE WHEN act <> 'ignore' THEN act END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM a)
    SELECT doc, line_no FROM s WHERE coalesce(st = 'disable', false) OR coalesce(act IN ('disable', 'ignore'), false)"""
)
def suppression_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.disabled_lines(lines(spark, sf_dir, DIRECTIVES), "dash_comment")


_AL = f"""{_lines(ALIGN)}, h AS (SELECT *, line LIKE '% = %' AND line NOT LIKE '//%' AS h, {_S.format('line')} = '' OR regexp_matches({_S.format('line')}, '^//(-|$)') AS clean FROM c),
dd AS (SELECT *, sum((NOT h AND NOT clean)::INT) OVER (PARTITION BY doc ORDER BY line_no) AS dirty FROM h),
hh AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER w <= 2 AND dirty = lag(dirty) OVER w THEN 0 ELSE 1 END AS new FROM dd WHERE h WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
gg AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY line_no) AS g, rtrim(substr(line, 1, instr(line, ' = '))) AS p, substr(line, instr(line, ' = ') + 1) AS rest FROM hh),
xx AS (SELECT *, max(octet_length(encode(p))) OVER (PARTITION BY doc, g) AS m, count(*) OVER (PARTITION BY doc, g) AS n FROM gg)"""


@query(f"WITH {_AL} SELECT doc, line_no, line AS before, p || repeat(' ', m + 1 - octet_length(encode(p))) || rest AS after FROM xx WHERE n >= 2 AND line <> p || repeat(' ', m + 1 - octet_length(encode(p))) || rest")
def align_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir, ALIGN)
    return op.align_groups(rows, F.col("line").contains(" = ") & ~F.col("line").startswith("//"), F.instr("line", F.lit(" = ")))


@query(
    f"""WITH {_L}, k AS (SELECT *, CASE WHEN length(line) < 200 THEN length(line) // 50 END AS k FROM l), f AS (SELECT *, CASE WHEN lag(line_no) OVER w = line_no - 1 AND lag(k) OVER w = k THEN 0 ELSE 1 END AS new FROM k WHERE k IS NOT NULL WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY line_no) AS g FROM f)
    SELECT doc, min(line_no) AS line_no, count(*) AS n, string_agg(line, '|' ORDER BY line_no) AS merged FROM g GROUP BY doc, g HAVING count(*) >= 2"""
)
def compact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.runs_of(lines(spark, sf_dir), F.when(F.length("line") < 200, F.floor(F.length("line") / 50)), least=2)


@query(
    """WITH o AS (SELECT o_custkey AS k, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + o_orderkey % 90 AS e FROM orders),
    w AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM o),
    g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM w) SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, g"""
)
def interval_merge_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.merge_intervals(_intervals(spark, sf_dir), ["k"], "s", "e")


@query(
    """WITH o AS (SELECT o_custkey AS k, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + o_orderkey % 90 AS e FROM orders),
    w AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM o),
    g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM w) SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, g"""
)
def interval_merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.merge_intervals(_intervals(spark, sf_dir), ["k"], "s", "e", adjacent=1)


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    s = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
    return o.select(F.col("o_custkey").alias("k"), s.alias("s"), (s + F.col("o_orderkey") % 90).alias("e"))


_CV = """cv AS (SELECT conv_id, turn, string_split(text, chr(10)) AS a FROM conversations),
b AS (SELECT conv_id * 1000 + turn AS doc, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM cv),
af AS (SELECT doc, line_no + CASE WHEN doc % 3 = 0 THEN 1 ELSE 0 END AS line_no, CASE WHEN line_no = 2 THEN '*' || line ELSE line END AS line FROM b UNION ALL SELECT DISTINCT doc, 1, 'new' FROM b WHERE doc % 3 = 0)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select((F.col("conv_id") * 1000 + F.col("turn")).alias("d"), "text")
    before = op.explode_lines(c, "d", "text")
    put = F.col("doc") % 3 == 0
    moved = before.select("doc", (F.col("line_no") + F.when(put, 1).otherwise(0)).alias("line_no"), F.when(F.col("line_no") == 2, F.concat(F.lit("*"), "line")).otherwise(F.col("line")).alias("line"))
    return before, moved.unionByName(before.where(put).select("doc", F.lit(1).cast("bigint").alias("line_no"), F.lit("new").alias("line")).distinct())


@query(
    f"""WITH {_CV}, n AS (SELECT doc, max(b.line_no) AS nb FROM b GROUP BY doc), m AS (SELECT doc, max(line_no) AS na FROM af GROUP BY doc),
    p AS (SELECT b.doc, min(b.line_no) - 1 AS p FROM b JOIN af USING (doc, line_no) WHERE b.line <> af.line GROUP BY b.doc),
    z AS (SELECT n.doc, nb, na, coalesce(p, least(nb, na)) AS p FROM n JOIN m USING (doc) LEFT JOIN p USING (doc)),
    r AS (SELECT z.doc, min(nb - b.line_no) AS s FROM z JOIN b USING (doc) JOIN af ON af.doc = z.doc AND na - af.line_no = nb - b.line_no WHERE b.line <> af.line GROUP BY z.doc),
    y AS (SELECT z.*, least(coalesce(s, 1000000000), least(nb, na) - p) AS s FROM z LEFT JOIN r USING (doc)),
    x AS (SELECT doc, line_no, line FROM b JOIN y USING (doc) WHERE line_no > p AND line_no <= nb - s), w AS (SELECT doc, line_no, line FROM af JOIN y USING (doc) WHERE line_no > p AND line_no <= na - s)
    SELECT doc, line_no, coalesce(x.line, '') AS before, coalesce(w.line, '') AS after FROM x FULL JOIN w USING (doc, line_no) WHERE coalesce(x.line, '') <> coalesce(w.line, '')"""
)
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.line_edits(*_versions(spark, sf_dir))


@query(
    f"""WITH {_CV}, e AS (SELECT doc, line_no, CASE WHEN doc % 5 = 0 AND line_no = 2 THEN line || '?' ELSE line END AS before, '*' || line AS after FROM b WHERE line_no % 2 = 0),
    j AS (SELECT b.doc, b.line_no, coalesce(e.after, line) AS line, coalesce(e.before <> line, false) AS bad, e.after FROM b LEFT JOIN e USING (doc, line_no))
    SELECT doc, CASE WHEN NOT bool_or(bad) THEN string_agg(line, chr(10) ORDER BY line_no) END AS text, count(after) AS n_edits FROM j GROUP BY doc"""
)
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, _ = _versions(spark, sf_dir)
    wrong = (F.col("doc") % 5 == 0) & (F.col("line_no") == 2)
    edits = before.where("line_no % 2 = 0").select("doc", "line_no", F.when(wrong, F.concat("line", F.lit("?"))).otherwise(F.col("line")).alias("before"), F.concat(F.lit("*"), "line").alias("after"))
    return op.apply_edits(before, edits)


@query(f"WITH {_CV} SELECT af.doc, af.line_no, coalesce(o.line, af.line) AS line FROM af LEFT JOIN (SELECT * FROM b WHERE line_no % 2 = 0) o USING (doc, line_no)")
def reverted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _versions(spark, sf_dir)
    return op.reverted(after, before, before.where("line_no % 2 = 0").select("doc", "line_no"))


@query(f"WITH {_L} SELECT doc, (line_no - 1) // 5 AS region, min(line_no) AS first, max(line_no) AS last FROM l GROUP BY ALL")
def line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("doc", F.floor((F.col("line_no") - 1) / 5).alias("region")).agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))


@query("""SELECT p_partkey, name, translate(regexp_replace(regexp_replace(name, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS snake
  FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'HTTPServer' || p_size || 'Name' WHEN 1 THEN upper(p_name[1]) || p_name[2:] || 'X' ELSE 'get' || p_type || 'Of' || p_size || 'A' END AS name FROM part)""")
def snake_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", "name", fn.to_snake(F.col("name")).alias("snake"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size").selectExpr(
        "p_partkey", "p_size", "CASE p_partkey % 3 WHEN 0 THEN 'HTTPServer' || p_size || 'Name' WHEN 1 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) || 'X' ELSE 'get' || p_type || 'Of' || p_size || 'A' END AS name"
    )


_IDS = "SELECT p_partkey AS id, replace(CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN 'C_' || upper(p_name) WHEN 3 THEN 's_' || p_name ELSE p_type END, ' ', '_') AS n FROM part"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type").selectExpr(
        "p_partkey AS id", "replace(CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN 'C_' || upper(p_name) WHEN 3 THEN 's_' || p_name ELSE p_type END, ' ', '_') AS n"
    )


@query(
    f"""SELECT id, regexp_matches(n, '^[a-z_][a-z0-9_]*$') AS snake, regexp_matches(n, '^[A-Z_][A-Z0-9_]*$') AS upper_snake,
      n = '' OR regexp_matches(n, '^[a-z_][a-z0-9_]*$') OR (regexp_matches(n, '^[A-Z0-9_]+$') AND contains(n, '_')) AS passes,
      regexp_matches(n, '^[A-Z_][A-Z0-9_]*$') OR regexp_matches(n, '^[CS]_[A-Z_][A-Z0-9_]*$') OR regexp_matches(n, '^[cs]_[a-z_][a-z0-9_]*$') AS constant,
      n LIKE 's\\_%' ESCAPE '\\' OR n LIKE 'm\\_%' ESCAPE '\\' AS prefixed FROM ({_IDS})"""
)
def case_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return _ids(spark, sf_dir).select(
        "id", fn.is_snake(n).alias("snake"), fn.is_upper_snake(n).alias("upper_snake"), fn.passes_snake(n).alias("passes"), fn.is_constant_like(n).alias("constant"), fn.has_prefix(n, ["s_", "m_"]).alias("prefixed")
    )


_W = f"{_L}, w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(line, '[A-Za-z]+'))) AS w FROM l)"
_NAMES = "['co_await', 'char8_t', 'const_cast', 'co_routine', 'char64_t', 'co_yield', 'reinterpret_cast', 'final_', 'not_eq', 'char32_t', 'co_return', 'char16_t', 'int8_t']"


@query(f"WITH {_W}, n AS (SELECT w FROM w UNION SELECT {_NAMES}[1 + (p_partkey % 13)::INT] FROM part) SELECT w FROM n WHERE w IN ({', '.join(repr(k) for k in fn.KEYWORDS)})")
def keyword_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lines(spark, sf_dir).select(F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z]+"), 0)).alias("w")).select(F.lower("w").alias("w"))
    names = table(spark, sf_dir, "part", "p_partkey").select(F.expr(f"element_at(array{_NAMES.replace('[', '(').replace(']', ')')}, int(1 + p_partkey % 13))").alias("w"))
    return w.unionByName(names).where(fn.is_keyword(F.col("w"))).distinct()


@query(
    """SELECT id, CASE WHEN NOT regexp_matches(lit, '[.eE]') THEN NULL WHEN regexp_replace(regexp_replace(lit, '[fFlL]$', ''), '(\\.[0-9]*?)0+$', '\\1') || 'f' <> lit
      THEN regexp_replace(regexp_replace(lit, '[fFlL]$', ''), '(\\.[0-9]*?)0+$', '\\1') || 'f' END AS as_float,
      CASE WHEN regexp_matches(lit, '[.eE]') THEN NULL WHEN regexp_replace(lit, '[uUlL]+$', '') || 'U' <> lit THEN regexp_replace(lit, '[uUlL]+$', '') || 'U' END AS as_unsigned
    FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size || '.' || p_partkey % 100 || '00' WHEN 1 THEN p_size || '.50f' WHEN 2 THEN p_size || 'UL' ELSE p_size::VARCHAR END AS lit FROM part)"""
)
def numeric_literal_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN p_size || '.' || p_partkey % 100 || '00' WHEN 1 THEN p_size || '.50f' WHEN 2 THEN p_size || 'UL' ELSE CAST(p_size AS STRING) END AS lit"
    )
    return p.select("id", fn.rewrite_number(F.col("lit"), F.lit("f"), F.lit(True)).alias("as_float"), fn.rewrite_number(F.col("lit"), F.lit("U"), F.lit(False)).alias("as_unsigned"))


@query(
    """SELECT id, CASE WHEN rest = '' OR NOT starts_with(op, 'operator') THEN op WHEN regexp_matches(rest, '^[A-Za-z0-9_]') THEN 'operator ' || rest ELSE 'operator' || rest END AS op
    FROM (SELECT *, regexp_extract(op, '^operator\\s*(.*)$', 1) AS rest FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'operator  ==' WHEN 1 THEN 'operator   ' || p_type WHEN 2 THEN 'operator' ELSE p_name END AS op FROM part))"""
)
def operator_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_name").selectExpr("p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN 'operator  ==' WHEN 1 THEN 'operator   ' || p_type WHEN 2 THEN 'operator' ELSE p_name END AS op")
    return p.select("id", fn.operator_name(F.col("op")).alias("op"))


@query("SELECT page_id, CASE WHEN regexp_matches(c, '^[0-9]') THEN 'H_' ELSE '' END || CASE c WHEN '' THEN 'HEADER' ELSE c END || '_' AS macro FROM (SELECT page_id, regexp_replace(regexp_replace(translate(url, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS c FROM pages)")
def guard_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", fn.guard_macro(F.col("url")).alias("macro"))


@query("SELECT p_partkey, [x - 1 for x in range(1, length(name) + 1) if regexp_matches(name[x], '[A-Z]')]::INT[] AS at FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'HTTPServer' || p_size || 'Name' WHEN 1 THEN upper(p_name[1]) || p_name[2:] || 'X' ELSE 'get' || p_type || 'Of' || p_size || 'A' END AS name FROM part)")
def capital_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", fn.capital_positions(F.col("name")).alias("at"))


@query("SELECT o_custkey, CASE WHEN len(a) > 3 THEN array_to_string(a[1:3], ', ') || ' (+' || (len(a) - 3) || ' more)' ELSE array_to_string(a, ', ') END AS hint FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY o_custkey)")
def line_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    return o.select("o_custkey", fn.line_hint(F.col("a"), 3).alias("hint"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name || CASE p_partkey % 3 WHEN 0 THEN '_test' WHEN 1 THEN '_benchmark' ELSE '' END, '(_test|_benchmark)$', ''), '^_+|_+$', '', 'g') AS stem FROM part")
def consensus_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    k = F.col("p_partkey") % 3
    return p.select("p_partkey", fn.consensus_stem(F.concat("p_name", F.when(k == 0, "_test").when(k == 1, "_benchmark").otherwise(""))).alias("stem"))


@query("SELECT p_partkey, p_name AS base, CASE p_partkey % 3 WHEN 0 THEN 'm_' WHEN 1 THEN 'g_' ELSE 'l_' END || CASE WHEN p_size % 2 = 0 THEN 's_' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'c_' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN 'p_' ELSE '' END AS prefix FROM part")
def stacked_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    s, k = F.col("p_size"), F.col("p_partkey") % 3
    scope = F.when(k == 0, "field").when(k == 1, "global").otherwise("local")
    return p.select(
        "p_partkey", fn.base_type(F.concat(F.lit("const std::ns::"), "p_name")).alias("base"), fn.stacked_prefix(scope, s % 2 == 0, s % 3 == 0, F.lit(False), s % 5 == 0).alias("prefix")
    )


@query()
def keyword_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical signs as words, outside string literals (text approximation); RE2 has no lookaround for an oracle."""
    rows = lines(spark, sf_dir, "substr(line, 1, 8) || '&&' || substr(line, 9, 4) || ' ||!' || line_no")
    return rows.select("doc", "line_no", fn.keyword_operators(F.col("line")).alias("line"))


_INC = """i AS (SELECT page_id, split_part(url, '/', 3) AS file, CASE WHEN page_id % 3 = 0 THEN '<' ELSE '"' END AS q, split_part(url, '/', 4) || CASE page_id % 4 WHEN 0 THEN '' ELSE '/' || page_id || '.h' END AS h, page_id % 10 = 1 AS main FROM pages),
k AS (SELECT *, CASE WHEN main THEN 'main' WHEN q = '<' THEN CASE WHEN contains(h, '.') OR contains(h, '/') THEN 'third_party' ELSE 'std' END WHEN lower(h) LIKE 'en%' THEN 'project' ELSE 'local' END AS grp FROM i)"""


@query(f"WITH {_INC} SELECT page_id, grp, row_number() OVER (PARTITION BY file ORDER BY CASE grp WHEN 'main' THEN 0 WHEN 'std' THEN 1 WHEN 'third_party' THEN 2 WHEN 'project' THEN 3 ELSE 4 END, lower(h), page_id) AS place FROM k")
def include_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    p = table(spark, sf_dir, "pages", "page_id", "url")  # a host stands for a file, a page for an include
    q = F.when(F.col("page_id") % 3 == 0, "<").otherwise('"')
    h = F.concat(F.split_part("url", F.lit("/"), F.lit(4)), F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("/"), "page_id", F.lit(".h"))))
    grp = fn.include_group(q, h, F.col("page_id") % 10 == 1, ["en"])
    rank = F.when(grp == "main", 0).when(grp == "std", 1).when(grp == "third_party", 2).when(grp == "project", 3).otherwise(4)
    rows = p.select("page_id", grp.alias("grp"), rank.alias("r"), F.lower(h).alias("h"), F.split_part("url", F.lit("/"), F.lit(3)).alias("file"))
    return rows.select("page_id", "grp", F.row_number().over(Window.partitionBy("file").orderBy("r", "h", "page_id")).cast("bigint").alias("place"))
