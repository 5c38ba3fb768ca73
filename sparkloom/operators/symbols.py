"""Declarations from the tokens of a statement, name lookup through scopes, and renames that it allows.

Declarations are found by row patterns: each token of a statement becomes one
letter of its class, and regular expressions over these letters, which run as
automata over the ordered rows of the statement, give the places of names.
This reads text and is no compiler: macros stay as they stand, enumerators are
not declared, and members after ``.``, ``->`` and ``::`` are not looked up.

A reference means the declaration of its name in the innermost scope around it
that has one. The scopes around a scope come from a table of ancestors that is
built by doubling: ways of up to 2, 4, 8, .. steps, so a depth of d takes about
log2(d) joins. Members of types are visible in all of the type, other names
only behind their declaration; of several in one scope the last before the
reference counts, or the first of a type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import KEYWORDS
from .joins import point_in_interval
from .lineage import cut

# Words of the language by what they do in a declaration.
MODIFIERS = "const constexpr consteval constinit static inline virtual extern mutable explicit friend register thread_local typename unsigned signed volatile typedef".split()
BUILTIN = "auto bool char char8_t char16_t char32_t double float int long short void wchar_t".split()
TYPES = "class enum struct union".split()

_CLASSES = {w: "K" for w in KEYWORDS} | {w: "M" for w in MODIFIERS} | {w: "B" for w in BUILTIN} | {w: "T" for w in TYPES} | {"namespace": "N", "template": "P", "operator": "O", "::": "S", "->": "A"}
_NAME = r"I(?:SI)*(?:<[^;{}()]*>)?"
_TYPE = rf"M*(?:B[BM]*|T?{_NAME})M*"
#: Over letters; group 1 is what stands before the name.
VARIABLE = rf"^({_TYPE}[*&]*)I(?:$|[=,\[])"
FUNCTION = rf"^((?:{_TYPE}[*&]*|M+)?(?:I(?:<[^()]*>)?S)*~?)(?:I|O[^(]*?)\("
PROTOTYPE = rf"^((?:{_TYPE}[*&]*|M+)(?:IS)*)[IO]\((?:\)|[MBT]|{_NAME}[*&]*I).*\)?(?:[MK&]|=[0K])*$"
TYPE = r"^((?:M|\[\[[^\]]*\]\])*T+(?:\[\[[^\]]*\]\])?)I(?:I|:|$)"
NAMESPACE = r"^(M*N(?:IS)*)I$"
_NESTED = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
MORE = rf"{_NESTED}|,[*&]*I(?=$|[=,\[])|."
PARAMETER = rf"[(,]{_TYPE}[*&]*I(?=[,)=\[])|."
IN_HEAD = rf"[(;]{_TYPE}[*&]*I(?=[=:])|."


def letters(tokens: Column) -> Column:
    """The classes of an array of tokens (structs), one letter each."""
    known = F.create_map(*[F.lit(x) for kv in _CLASSES.items() for x in kv])
    one = lambda t: F.coalesce(
        F.try_element_at(known, t), F.when(t.rlike(r"^[A-Za-z_\x{80}-\x{10FFFF}]"), "I").when(t.rlike("^[0-9]"), "0").when((F.length(t) == 1) & ~t.rlike("[A-Za-z]"), t).otherwise(".")
    )
    return F.array_join(F.transform(tokens, lambda x: one(x.token)), "")


def _places(text: Column, pattern: str, at: Column) -> Column:
    """Where the matches of all but the last alternative of ``pattern`` end, counted from ``at``."""
    pieces = F.regexp_extract_all(text, F.lit(pattern), 0)
    # runs through the pieces with the length so far
    walked = F.aggregate(
        pieces,
        F.struct(at.cast("int").alias("n"), F.array().cast("array<int>").alias("out")),
        lambda s, p: F.struct((s.n + F.length(p)).cast("int").alias("n"), F.when((F.length(p) > 1) & p.endswith("I"), F.concat(s.out, F.array((s.n + F.length(p) - 1).cast("int")))).otherwise(s.out).alias("out")),
        lambda s: s.out,
    )
    return walked


def declarations(statements: DataFrame) -> DataFrame:
    """(doc, at, name, kind, head): names that ``statements`` declare; ``head`` is where the statement begins."""
    rows = statements.where("n > 0").withColumn("_l", letters(F.col("tokens")))
    skip = F.length(F.regexp_extract("_l", r"^(?:P<[^;{}]*?>)*", 0))  # templates
    rows = rows.withColumns({"_skip": skip, "_l": F.substring("_l", skip + 1, F.length("_l"))})
    text, body = F.col("_l"), F.col("ends") == "{"
    before = lambda p: F.length(F.regexp_extract("_l", p, 1))
    one = lambda p: F.array(before(p).cast("int"))
    none = F.array().cast("array<int>")
    is_type = text.rlike(TYPE) & ~text.contains("(") & (body | text.rlike(r"^M*T+I$"))
    is_function = ~is_type & F.when(body, text.rlike(FUNCTION)).otherwise(text.rlike(PROTOTYPE))
    is_variable = ~is_type & ~is_function & text.rlike(VARIABLE)
    more = _places(F.substring("_l", before(VARIABLE) + 2, F.length("_l")), MORE, before(VARIABLE) + 1)
    found = {
        "namespace": F.when(body & text.rlike(NAMESPACE), one(NAMESPACE)),
        "type": F.when(is_type, one(TYPE)),
        "function": F.when(is_function, F.when(body, one(FUNCTION)).otherwise(one(PROTOTYPE))),
        "variable": F.concat(F.when(is_variable, F.concat(one(VARIABLE), more)).otherwise(none), F.when(body & ~is_function, _places(text, IN_HEAD, F.lit(0))).otherwise(none)),
        "parameter": F.when(body & (is_function | text.rlike(r"\[[^\]]*\]\(")), _places(text, PARAMETER, F.lit(0))),
    }
    kinded = lambda k: lambda i: F.struct(F.lit(k).alias("kind"), i.alias("i"))
    listed = F.flatten(F.array(*[F.transform(F.coalesce(v, none), kinded(k)) for k, v in found.items()]))
    rows = rows.select("doc", F.col("at").alias("head"), "tokens", "_skip", F.explode(listed).alias("x"))
    token = F.element_at("tokens", F.col("x.i") + F.col("_skip") + 1)
    rows = rows.select("doc", token["at"].alias("at"), token.token.alias("name"), F.col("x.kind").alias("kind"), "head")
    return rows.groupBy("doc", "at", "name", "head").agg(F.min("kind").alias("kind")).select("doc", "at", "name", "kind", "head")


def references(tokens: DataFrame, declared: DataFrame) -> DataFrame:
    """(doc, line_no, at, name): names that are used, and no declarations, members or words of the language."""
    w = Window.partitionBy("doc").orderBy("at")
    rows = tokens.withColumn("_p", F.lag("token").over(w))
    name = F.col("token").rlike(r"^[A-Za-z_\x{80}-\x{10FFFF}]") & ~F.col("token").isin(*KEYWORDS)
    rows = rows.where(name & ~F.coalesce(F.col("_p").isin(".", "->", "::", "#"), F.lit(False)))
    return rows.select("doc", "line_no", "at", F.col("token").alias("name")).join(declared, ["doc", "at"], "left_anti")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(doc, pre, above, steps): every node with itself and all nodes above it, to the document (-1)."""
    jump = cut(nodes.select("doc", "pre", F.coalesce("parent", F.lit(-1)).cast("bigint").alias("above"), F.lit(1).alias("steps")))
    paths, length = jump, 1
    while not jump.isEmpty():
        on = paths.select("doc", F.col("pre").alias("above"), F.col("above").alias("_a"), F.col("steps").alias("_s"))
        longer = jump.join(on, ["doc", "above"]).select("doc", "pre", F.col("_a").alias("above"), (F.col("steps") + F.col("_s")).alias("steps"))
        paths = cut(paths.unionByName(longer))
        length *= 2
        jump = paths.where(F.col("steps") == length)
    own = nodes.select("doc", "pre", F.col("pre").alias("above"), F.lit(0).alias("steps"))
    return paths.unionByName(own)


def placed(points: DataFrame, nodes: DataFrame, at: Column, bucket: int = 1024) -> DataFrame:
    """``points`` (doc, at, ..) with ``scope``: pre of the innermost node around twice the place ``at`` (odd: between two bytes); -1 for none."""
    rows = points.withColumn("_p", at)
    spans = nodes.select("doc", "pre", F.col("level").alias("_level"), (2 * F.col("start")).alias("_s"), (2 * F.col("end") - 2).alias("_e"))
    inside = point_in_interval(rows.select("doc", "at", "_p"), spans, ["doc"], "_p", "_s", "_e", 2 * bucket)
    inside = inside.groupBy("doc", "at").agg(F.max_by("pre", "_level").alias("scope"))
    return rows.drop("_p").join(inside, ["doc", "at"], "left").withColumn("scope", F.coalesce("scope", F.lit(-1)).cast("bigint"))


def declared_in(declared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Declarations with the scope that they belong to: what opens a scope is declared around it."""
    outer = F.col("kind").isin("namespace", "type", "function")
    rows = placed(declared, nodes, F.when(outer, 2 * F.col("head") - 1).otherwise(2 * F.col("at")))
    kinds = nodes.select("doc", F.col("pre").alias("scope"), (F.col("kind") == "type").alias("member"))
    return rows.join(kinds, ["doc", "scope"], "left").withColumn("member", F.coalesce("member", F.lit(False)))


def resolve(used: DataFrame, declared: DataFrame, above: DataFrame) -> DataFrame:
    """``used`` (doc, at, name, scope, ..) with ``decl``, the place of the declaration that it means, and ``steps`` to its scope; others are left out."""
    chain = used.join(above.withColumnRenamed("pre", "scope"), ["doc", "scope"])
    chain = chain.unionByName(used.where("scope = -1").withColumns({"above": F.lit(-1).cast("bigint"), "steps": F.lit(0)}))
    d = declared.select("doc", "name", F.col("scope").alias("above"), F.col("at").alias("decl"), "member")
    found = chain.join(d, ["doc", "above", "name"]).where(F.col("member") | (F.col("decl") < F.col("at")))
    before = F.col("decl") < F.col("at")
    nearest = Window.partitionBy("doc", "at").orderBy("steps", F.desc(before), F.when(before, -F.col("decl")).otherwise(F.col("decl")))
    return found.withColumn("_r", F.row_number().over(nearest)).where("_r = 1").drop("_r", "above", "member")


def rename_plan(wanted: DataFrame, declared: DataFrame, resolved: DataFrame, used: DataFrame, above: DataFrame) -> DataFrame:
    """(doc, decl, old, new, n, captured, shadows): ``wanted`` (doc, decl, new) with the number of its places and what stands against it.

    ``captured``: places where the new name would mean another declaration, in a scope that is as near or nearer.
    ``shadows``: uses of the new name that mean a declaration farther out and would mean the renamed one.
    """
    d = declared.select("doc", F.col("at").alias("decl"), F.col("name").alias("old"), F.col("scope").alias("own"), F.col("member").alias("own_member"))
    plan = cut(wanted.join(d, ["doc", "decl"]))
    places = resolved.select("doc", "at", "decl", "scope", "steps").unionByName(plan.select("doc", F.col("decl").alias("at"), "decl", F.col("own").alias("scope"), F.lit(0).alias("steps")))
    mine = cut(plan.join(places, ["doc", "decl"]))
    n = mine.groupBy("doc", "decl").agg(F.count("*").alias("n"))
    # the new name at each of the places
    seen = resolve(mine.select("doc", "at", F.col("new").alias("name"), "scope", F.col("decl").alias("mine"), F.col("steps").alias("far")), declared, above)
    captured = seen.where("steps <= far").groupBy("doc", F.col("mine").alias("decl")).agg(F.count("*").alias("captured"))
    # uses of the new name below the renamed declaration's scope
    now = resolved.select("doc", "at", F.col("name").alias("new"), F.col("scope").alias("pre"), F.col("steps").alias("far"))
    chain = above.unionByName(used.where("scope = -1").select("doc", F.lit(-1).cast("bigint").alias("pre"), F.lit(-1).cast("bigint").alias("above"), F.lit(0).alias("steps")).distinct())
    under = plan.join(now, ["doc", "new"]).join(chain.withColumnRenamed("above", "own"), ["doc", "pre", "own"])
    shadows = under.where("steps < far AND (own_member OR decl < at)").groupBy("doc", "decl").agg(F.count("*").alias("shadows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return plan.join(n, ["doc", "decl"]).join(captured, ["doc", "decl"], "left").join(shadows, ["doc", "decl"], "left").select("doc", "decl", "old", "new", "n", zero("captured"), zero("shadows"))


def renamed_lines(lines: DataFrame, starts: DataFrame, places: DataFrame) -> DataFrame:
    """``lines`` with names replaced at byte places: ``places`` (doc, line_no, at, old, new); ``starts`` (doc, line_no, start)."""
    on = ["doc", "line_no"]
    listed = places.join(starts, on).groupBy(*on).agg(F.reverse(F.array_sort(F.collect_set(F.struct((F.col("at") - F.col("start")).cast("int").alias("i"), "old", "new")))).alias("_xs"))
    raw = lambda c: c.cast("binary")
    put = lambda s, x: F.concat(F.substring(s, F.lit(1), x["i"]), raw(x["new"]), F.substring(s, x["i"] + 1 + F.octet_length(x["old"]), F.octet_length(s)))
    rows = lines.join(listed, on, "left")
    return rows.withColumn("line", F.when(F.col("_xs").isNull(), F.col("line")).otherwise(F.aggregate("_xs", raw(F.col("line")), put).cast("string"))).drop("_xs")


def uncovered_labels(tokens: DataFrame, covered: DataFrame) -> DataFrame:
    """(doc, name, at): the first constructor-initialiser label of each name that ``covered`` (doc, name, at) has places of, but not this one.

    A label stands behind ``:`` or ``,`` and before ``(``, on one line.
    """
    w = Window.partitionBy("doc").orderBy("at")
    beside = lambda shift, *words: shift("token").over(w).isin(*words) & (shift("line_no").over(w) == F.col("line_no"))
    rows = tokens.withColumn("_l", beside(F.lag, ":", ",") & beside(F.lead, "(")).where("_l").select("doc", "at", F.col("token").alias("name"))
    names = covered.select("doc", "name").distinct()
    return rows.join(names, ["doc", "name"]).join(covered.select("doc", "name", "at"), ["doc", "name", "at"], "left_anti").groupBy("doc", "name").agg(F.min("at").alias("at"))
