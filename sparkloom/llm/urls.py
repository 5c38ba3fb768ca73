"""URL filter: rules first, then a path-template tree with smoothed labelled purity.

URLs that a rule decides are the labelled ones. Per host, paths form a tree,
which is generalised from the root down, one level at a time. Segments that look
variable (numbers, long hexadecimal strings) become wildcards, as do the thin
branches of a node that has many; branches whose share of blocked labels doesn't
differ significantly from their siblings' are merged. What stands below merged
branches is pooled, and the next level is judged on the pooled counts. A
template whose smoothed share of blocked labels is high, on enough labels, is
rejected; URLs of such templates that no rule decides are blocked, all others
allowed.

Null URLs and those without ``://`` have an empty host and path and are a
template like any other. URLs of any length are read to their end. Repeated URLs are counted with
their number and get one verdict. Of rules that fit the longest wins, of equally
long ones the last in the order of (host, path, verdict). An empty table gives no
rows. Other columns are kept, except those of the result's names.
Work is on counts by host and path: DataFrame functions by level for nodes of many
shapes, and one Arrow step for those of few, which it finishes at any depth.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clustered, cut, groups_of, tidy

#: Shapes of a node that one step finishes, at most.
SMALL = 1000

#: A node of more branches than FAN merges those with fewer than THIN URLs.
FAN = 12
THIN = 5
#: Branches within so many standard errors of their siblings are merged.
SIMILAR = 1.96
#: Labels a template needs, the weight of the overall share in its own, and the share at which it is rejected.
SUPPORT = 5
SMOOTH = 2.0
REJECT = 0.8

Rule = tuple[str, str, str]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (as text; null if none) and its verdict. ``rules``: host, path, allow or block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path with its variable segments as wildcards."""
    segs = F.split(F.regexp_replace(path, "^/", ""), "/")
    shown = F.transform(segs, lambda s: F.regexp_replace(F.regexp_replace(s, "^[0-9a-fA-F-]{12,}$", "<x>"), "[0-9]+", "<n>"))
    return F.concat(F.lit("/"), F.array_join(shown, "/"))


def generalised(shapes: list[tuple[list[str], int, int, int]]) -> list[list[str]]:
    """The template segments of each of a node's shapes (segments below the node, n, labelled, blocked)."""
    out: list[list[str]] = [[] for _ in shapes]
    open_ = [[i for i, x in enumerate(shapes) if x[0]]]
    while open_:
        node = open_.pop()
        level = len(out[node[0]])
        sums: dict[str, list[int]] = {}
        for i in node:
            segs, *counts = shapes[i]
            old = sums.setdefault(segs[level], [0, 0, 0])
            sums[segs[level]] = [x + y for x, y in zip(old, counts, strict=True)]
        labelled, blocked = (sum(x[k] for x in sums.values()) for k in (1, 2))
        below: dict[str, list[int]] = {}
        for i in node:
            seg = shapes[i][0][level]
            wild = _merges(sums[seg], len(sums), labelled, blocked)
            out[i].append("*" if wild else seg)
            below.setdefault("*" if wild else seg, []).append(i)
        for group in below.values():
            going = [i for i in group if len(group) > 1 and len(shapes[i][0]) > level + 1]
            for i in group:
                if len(group) == 1:
                    out[i].extend(shapes[i][0][level + 1 :])
            if going:
                open_.append(going)
    return out


def _merges(counts: list[int], fan: int, all_labelled: int, all_blocked: int) -> bool:
    n, labelled, blocked = counts
    if fan > FAN and n < THIN:
        return True
    others = all_labelled - labelled
    if not labelled or not others:
        return False
    share = all_blocked / all_labelled
    error = math.sqrt(share * (1 - share) * (1 / labelled + 1 / others))
    return abs(blocked / labelled - (all_blocked - blocked) / others) <= SIMILAR * error


def templates(shapes: DataFrame, small: int = SMALL) -> DataFrame:
    """host, shape and template of every row of ``shapes`` (host, shape, n, labelled, blocked; one row a shape).

    A node of at most ``small`` shapes is finished in one step, whatever its depth.
    The others go on by one level where their shapes part; what all shapes of a
    node have in common is passed over at once. So a round splits a node of more
    than ``small`` shapes, and long paths cost no rounds.
    """
    # under: a hash of the generalised segments above, by which a node is known
    rows = shapes.withColumns({"s": F.split(F.substring("shape", 2, 1 << 30), "/"), "under": F.lit(""), "done": F.array().cast("array<string>")})
    rows = rows.select("host", "shape", "n", "labelled", "blocked", "s", "under", "done")
    finished = None

    def add(part: DataFrame) -> None:
        nonlocal finished
        finished = part if finished is None else finished.unionByName(part)

    while True:
        left = F.slice("s", F.size("done") + 1, F.size("s"))
        rows = rows.withColumn("rest", left)
        nodes = rows.groupBy("host", "under").agg(F.count("*").alias("shapes"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        # the number of segments that the least and the greatest have in common, as all between them do
        both = F.zip_with(F.slice("low", 1, F.least(F.size("low"), F.size("high"))), F.slice("high", 1, F.least(F.size("low"), F.size("high"))), lambda a, b: a == b)
        apart = F.array_position(both, F.lit(False))
        common = F.when(apart > 0, apart - 1).otherwise(F.size(both)).cast("int")
        # a shape that ends with the common segments keeps the last of them for this level, and so do the others
        skip = common - (common >= F.size("low")).cast("int")
        rows = cut(rows.join(cut(nodes.select("host", "under", "shapes", skip.alias("skip"))), ["host", "under"]))
        few = rows.where(F.col("shapes") <= small)
        add(cut(_finished(few)))
        rows = rows.where(F.col("shapes") > small)
        if rows.isEmpty():
            return finished
        rows = rows.withColumn("done", F.concat("done", F.slice("rest", F.lit(1), F.col("skip"))))
        rows = rows.withColumn("seg", F.element_at("s", F.size("done") + 1))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        branches = rows.groupBy("host", "under", "seg").agg(*sums)
        above = cut(branches.groupBy("host", "under").agg(F.count("*").alias("fan"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked")))
        others = F.col("all_labelled") - F.col("labelled")
        share = F.col("all_blocked") / F.col("all_labelled")
        error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / others))
        apart = F.col("blocked") / F.col("labelled") - (F.col("all_blocked") - F.col("blocked")) / others
        similar = (F.col("labelled") > 0) & (others > 0) & (F.abs(apart) <= SIMILAR * error)
        thin = (F.col("fan") > FAN) & (F.col("n") < THIN)
        merged = cut(branches.join(above, ["host", "under"]).where(thin | F.coalesce(similar, F.lit(False))).select("host", "under", "seg", F.lit("*").alias("wild")))
        named = rows.join(merged, ["host", "under", "seg"], "left").withColumn("seg", F.coalesce("wild", "seg"))
        named = cut(named.select("host", "shape", "n", "labelled", "blocked", "s", F.md5(F.concat("under", F.lit("/"), "seg")).alias("under"), F.array_append("done", F.col("seg")).alias("done")))
        ended = F.size("s") <= F.size("done")
        add(named.where(ended).select("host", "shape", F.concat(F.lit("/"), F.array_join("done", "/")).alias("template")))
        rows = named.where(~ended)


def _finished(rows: DataFrame) -> DataFrame:
    """host, shape and template of the rows of small nodes: those alone as they are, the others node by node."""
    whole = rows.where("shapes = 1").select("host", "shape", F.concat(F.lit("/"), F.array_join(F.concat("done", "rest"), "/")).alias("template"))
    several = rows.where("shapes > 1").select(F.md5(F.concat_ws("/", F.length("host"), "host", "under")).alias("node"), "host", "shape", "n", "labelled", "blocked", "done", "rest")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups_of(batches, "node"):
            counts = [t.column(c).to_pylist() for c in ("rest", "n", "labelled", "blocked")]
            found = generalised(list(zip(*counts, strict=True)))
            shown = ["/" + "/".join(a + b) for a, b in zip(t.column("done").to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("host").combine_chunks(), t.column("shape").combine_chunks(), pa.array(shown, pa.string())], names=["host", "shape", "template"])

    return whole.unionByName(clustered(several, "node").mapInArrow(tidy(run), "host string, shape string, template string"))


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity (the template's smoothed share of blocked labels)."""
    new = {"host", "path", "rule", "verdict", "template", "purity"}
    host, path = parts(F.col(url_col))
    rows = pages.select(*(f"`{c}`" for c in pages.columns if c not in new), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decided": verdict})
    rows = rows.withColumn("_shape", shape(F.col("path")))
    shapes = rows.groupBy("host", F.col("_shape").alias("shape")).agg(
        F.count("*").alias("n"), F.count("decided").alias("labelled"), F.count(F.when(F.col("decided") == "block", 1)).alias("blocked")
    )
    shapes = cut(shapes)
    total = shapes.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).first()
    prior = (total.b or 0) / total.l if total.l else 0.0
    of = cut(templates(shapes))
    counted = shapes.join(of, ["host", "shape"]).groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + SMOOTH * prior) / (F.col("labelled") + SMOOTH)
    judged = cut(counted).select("host", "template", purity.alias("purity"), ((F.col("labelled") >= SUPPORT) & (purity >= REJECT)).alias("bad"))
    known = cut(of.join(judged, ["host", "template"])).withColumnRenamed("shape", "_shape")
    found = rows.join(known, ["host", "_shape"], "left")
    return found.withColumn("verdict", F.coalesce("decided", F.when(F.col("bad"), "block").otherwise("allow"))).drop("decided", "bad", "_shape")
