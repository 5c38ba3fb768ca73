"""Lookups and merges: declarations at a place, companions, consensus arguments, snapshots of learning, graph updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graphs import replace_edges
from .lineage import cut
from .ranking import numbered

# What a source's compile arguments score for another's, the least score, and how many sets are taken.
SOURCE_SCORE = {"directory": 6, "extension": 2, "stem": 10, "prefix": 6, "include": 1}
SOURCE_LEAST, SETS = 12, 6
# Shares of the new observation in a node's and a metric's consensus, and what a failed parse is worth.
NODE_SHARE, METRIC_SHARE, FAILED = 0.15, 0.10, 0.5

#: Values of a symbol that its averages are made from: what comes before so many others weighs less than 1e-46.
LATEST = 1024
# Folders whose files belong together.
HEADER_DIRS, SOURCE_DIRS = ("include", "inc"), ("src", "source")
#: About how many paths and listed companions a cell of pairs has at most, and how many pairs a task makes.
BLOCK, LISTED, PAIRS = 512, 4096, 20_000_000


def declaration_at(places: DataFrame, decls: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """``places`` (keys, line, column) with the declaration there: at the place, or else the nearest on the line, or else that of a reference at the place.

    ``decls``: keys, line, column, id; ``refs``: the same. Of equally near ones
    the left one is taken, of several at one place the smallest id. The nearest
    is found by running lasts from both sides, so a line of any length is sorted, not paired.
    """
    at = [*keys, "line"]
    cells = decls.groupBy(*at, "column").agg(F.min("id").alias("id"))
    both = places.withColumn("_q", F.lit(1)).unionByName(cells.withColumn("_q", F.lit(0)), allowMissingColumns=True)
    found = F.when(F.col("_q") == 0, F.struct("column", "id"))
    left = F.last(found, ignorenulls=True).over(Window.partitionBy(*at).orderBy("column", "_q").rowsBetween(Window.unboundedPreceding, 0))
    right = F.last(found, ignorenulls=True).over(Window.partitionBy(*at).orderBy(F.desc("column"), "_q").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumns({"_l": left, "_r": right}).where("_q = 1")
    nearer = F.when(F.col("_l").isNull(), F.col("_r.id")).when(F.col("_r").isNull(), F.col("_l.id")).when(F.col("column") - F.col("_l.column") <= F.col("_r.column") - F.col("column"), F.col("_l.id")).otherwise(F.col("_r.id"))
    known = decls.select(F.col("id").alias("_via")).distinct()
    via = refs.groupBy(*at, "column").agg(F.min("id").alias("_via")).join(known, "_via", "left_semi")
    return rows.drop("id").withColumn("id", nearer).join(via, [*at, "column"], "left").withColumn("id", F.coalesce("id", "_via")).drop("_q", "_l", "_r", "_via")


def source_consensus(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """For each target (path, dir, stem, ext) the best entries (path, dir, stem, ext, args, include) with distinct arguments.

    Only a common stem, or a common folder with one stem beginning the other,
    can reach the least score, so pairs come from equi-joins alone: by stem and
    extension, by stem and folder, and by folder and the beginnings of a stem.
    A score depends on folder, stem, extension and includes, so targets alike
    in these are one, and so are entries with the same arguments, of which the
    first by path stands for all.
    """
    of = [F.col(c).alias(f"_{c}") for c in ("dir", "stem", "ext")]
    t = targets.select(*of).distinct()
    e = entries.groupBy("dir", "stem", "ext", "args", "include").agg(F.min("path").alias("path"))
    by_ext = t.join(e, (F.col("_stem") == F.col("stem")) & (F.col("_ext") == F.col("ext")))
    by_dir = t.join(e, (F.col("_stem") == F.col("stem")) & (F.col("_dir") == F.col("dir")) & (F.col("_ext") != F.col("ext")))
    starts = lambda d, c: d.withColumn("_b", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda n: F.substring(F.col(c), F.lit(1), n)))).where(F.length("_b") < F.length(c))
    same_dir = F.col("_dir") == F.col("dir")
    longer = t.join(starts(e, "stem"), same_dir & (F.col("_stem") == F.col("_b"))).drop("_b")
    shorter = starts(t, "_stem").join(e, same_dir & (F.col("_b") == F.col("stem"))).drop("_b")
    pairs = by_ext.unionByName(by_dir).unionByName(longer).unionByName(shorter)
    named = (F.col("_stem") != "") & (F.col("stem") != "")
    s = SOURCE_SCORE
    score = (
        F.when((F.col("_dir") != "") & (F.col("_dir") == F.col("dir")), s["directory"]).otherwise(0)
        + F.when((F.col("_ext") != "") & (F.col("_ext") == F.col("ext")), s["extension"]).otherwise(0)
        + F.when(named & (F.col("_stem") == F.col("stem")), s["stem"]).when(named & (F.col("stem").startswith(F.col("_stem")) | F.col("_stem").startswith(F.col("stem"))), s["prefix"]).otherwise(0)
        + F.when((F.col("_dir") != "") & F.col("include").contains(F.col("_dir")), s["include"]).otherwise(0)
    )
    rows = pairs.withColumn("score", score).where(F.col("score") >= SOURCE_LEAST)
    key = ["_dir", "_stem", "_ext"]
    best = rows.groupBy(*key, "args").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("x"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("x.s", "x.path"))
    best = best.withColumn("place", place).where(F.col("place") <= SETS)
    found = targets.select(F.col("path").alias("target"), *of).distinct().join(best, key)
    return found.select("target", F.col("x.path").alias("path"), (-F.col("x.s")).alias("score"), "args", "place")


def context_kind(exact: Column, header: Column, paired: Column, consensus: Column, source: Column) -> Column:
    """How well a file's compile arguments are known, from the numbers of argument sets of each kind."""
    return (
        F.when(exact, "exact").when(header & (paired > 0), "paired").when(header & (consensus > 0), "header").when(header, "none").when(source > 0, "source").otherwise("none")
    )


def folded(start: Column, share: float, n: Column, sums: Column, first: Column) -> Column:
    """An exponential average after ``n`` values: from ``start``, or from the first value where it is unset.

    ``sums``: the values, each times share * (1 - share) ** (values after it).
    """
    rest = F.pow(F.lit(1.0 - share), n)
    unset = sums + first * (F.pow(F.lit(1.0 - share), n - 1) - share * F.pow(F.lit(1.0 - share), n - 1))
    return F.when(start.isNull() | (start <= 0), unset).otherwise(start * rest + sums)


def graph_upsert(nodes: DataFrame, metrics: DataFrame, edges: DataFrame, parses: DataFrame, symbols: DataFrame, references: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, metrics and edges after parses of files, as if they came one after another by path.

    nodes: id, consensus; metrics: id, n_refs, n_files, score; parses: file,
    success; symbols: file, id; references: file, id, n. Edges of the parsed
    files are replaced; counts are refreshed for the symbols that were seen,
    referred to, or lost an edge. Those seen without references count one.
    """
    seen = symbols.distinct().join(parses, "file").withColumn("v", F.when(F.col("success"), 1.0).otherwise(FAILED))
    # a value's weight falls with the files after it, below any double's precision long before LATEST of them
    after = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("file")))
    ranked = seen.withColumn("_a", after).where(F.col("_a") <= LATEST).withColumn("_a", F.col("_a") - 1)
    weigh = lambda share: F.sum(F.col("v") * share * F.pow(F.lit(1.0 - share), F.col("_a")))
    latest = ranked.groupBy("id").agg(weigh(NODE_SHARE).alias("node"), weigh(METRIC_SHARE).alias("metric"))
    sums = seen.groupBy("id").agg(F.count("*").alias("n"), F.min_by("v", "file").alias("first")).join(latest, "id")
    targets = references.groupBy("file", "id").agg(F.sum(F.greatest("n", F.lit(1))).alias("n"))
    last = parses.groupBy().agg(F.max_by("success", "file").alias("s"))  # one row
    stub = F.when(F.col("s"), 1.0).otherwise(FAILED)
    stubs = targets.select("id").distinct().join(nodes.select("id"), "id", "left_anti").join(sums.select("id"), "id", "left_anti").crossJoin(F.broadcast(last)).select("id", stub.alias("consensus"))
    moved = nodes.join(sums, "id", "full").select("id", F.when(F.col("n").isNull(), F.col("consensus")).otherwise(folded(F.col("consensus"), NODE_SHARE, F.col("n"), F.col("node"), F.col("first"))).alias("consensus"))
    files = parses.select(F.col("file").alias("src"))
    fresh = lambda d, kind, w: d.select(F.col("file").alias("src"), F.col("id").alias("dst"), F.lit(kind).alias("kind"), w.cast("bigint").alias("weight"), F.lit(now).cast("bigint").alias("last_seen"))
    contains, refers = fresh(symbols.distinct(), "contains", F.lit(1)), fresh(targets, "reference", F.col("n"))
    gone = edges.join(files, "src", "left_semi").select(F.col("dst").alias("id"))
    out = replace_edges(replace_edges(edges, files, contains, "contains"), files, refers, "reference")
    affected = gone.union(symbols.select("id")).union(references.select("id")).distinct()
    counts = out.join(affected.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(
        F.count_if(F.col("kind") == "contains").alias("_f"), F.coalesce(F.sum(F.when(F.col("kind") == "reference", F.col("weight"))), F.lit(0)).alias("_r")
    )
    counts = affected.join(counts, "id", "left").join(sums.select("id", "n", "metric", "first"), "id", "left")
    joined = metrics.join(counts.withColumn("_touched", F.lit(True)), "id", "full")
    refs = F.coalesce("_r", F.lit(0))
    touched = F.col("_touched").isNotNull()
    new = joined.select(
        "id",
        F.when(touched, F.when((refs == 0) & F.col("n").isNotNull(), 1).otherwise(refs)).otherwise(F.col("n_refs")).alias("n_refs"),
        F.when(touched, F.coalesce("_f", F.lit(0))).otherwise(F.col("n_files")).alias("n_files"),
        F.when(F.col("n").isNull(), F.coalesce("score", F.lit(0.0))).otherwise(folded(F.col("score"), METRIC_SHARE, F.col("n"), F.col("metric"), F.col("first"))).alias("score"),
    )
    return moved.unionByName(stubs), new, out


def removed_targets(edges: DataFrame, files: DataFrame, fresh: DataFrame, kind: str) -> DataFrame:
    """Targets that files lose when their edges of a kind are replaced."""
    own = edges.where(F.col("kind") == kind).join(files.select("src"), "src", "left_semi")
    return own.join(fresh.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst").distinct()


def accumulated(stages: list[DataFrame]) -> DataFrame:
    """The rows of all stages, each with its place."""
    out = stages[0].withColumn("stage", F.lit(0))
    for i, s in enumerate(stages[1:], 1):
        out = out.unionByName(s.withColumn("stage", F.lit(i)), allowMissingColumns=True)
    return out


def counter_diff(before: DataFrame, after: DataFrame, keys: list[str], counters: list[str], last: list[str] = (), growing: list[str] = ()) -> DataFrame:
    """What counters gained since a snapshot, not below 0, without rows that gained nothing.

    Columns in ``last`` are taken as they are now; those in ``growing`` only if
    they are above the snapshot's, else 0.
    """
    old = before.select(*keys, *(F.col(c).alias(f"_{c}") for c in (*counters, *growing)))
    rows = after.join(old, keys, "left")
    gain = {c: F.greatest(F.col(c) - F.coalesce(f"_{c}", F.lit(0)), F.lit(0)) for c in counters}
    gain |= {c: F.when(F.col(c) > F.coalesce(f"_{c}", F.lit(0)), F.col(c)).otherwise(0.0) for c in growing}
    out = rows.select(*keys, *(x.alias(c) for c, x in gain.items()), *last)
    some = F.lit(False)
    for c in counters:
        some = some | (F.col(c) > 0)
    return out.where(some)


def scalar_merge(shards: DataFrame, keys: list[str], default: float = 0.5, variance: float = 0.1) -> DataFrame:
    """estimate, variance and n of scalar filters that saw shards (estimate, variance, n) of a key: means by observations."""
    n = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / n
    rows = shards.groupBy(*keys).agg(n.alias("n_all"), mean("estimate").alias("e"), mean("variance").alias("v"))
    none = F.col("n_all") == 0
    held = F.least(F.greatest("e", F.lit(0.0)), F.lit(1.0))
    return rows.select(*keys, F.when(none, default).otherwise(held).alias("estimate"), F.when(none, variance).otherwise(F.greatest("v", F.lit(1e-12))).alias("variance"), F.col("n_all").alias("n"))


def overlap(a: Column, b: Column) -> Column:
    """Whether two sets share an element, and the shared ones in order."""
    return F.struct(F.coalesce(F.arrays_overlap(a, b), F.lit(False)).alias("any"), F.array_sort(F.array_intersect(a, b)).alias("shared"))


def modifiers(lookups: DataFrame, files: DataFrame, blocks: DataFrame) -> DataFrame:
    """The product of a policy's modifiers for a file kind and a block kind; 1 where nothing is known."""
    f = files.select("policy", "file_kind", F.col("modifier").alias("_f"))
    b = blocks.select("policy", "block_kind", F.col("modifier").alias("_b"))
    joined = lookups.join(f, ["policy", "file_kind"], "left").join(b, ["policy", "block_kind"], "left")
    return joined.withColumn("modifier", F.coalesce("_f", F.lit(1.0)) * F.coalesce("_b", F.lit(1.0))).drop("_f", "_b")


def range_drift(before: DataFrame, after: DataFrame, edited: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """By ``keys`` the scopes (kind, s, e) that only one version has, near an edited line (local) and not (remote)."""
    cols = [*keys, "kind", "s", "e"]
    b, a = before.select(*cols).distinct(), after.select(*cols).distinct()
    moved = b.join(a, cols, "left_anti").unionByName(a.join(b, cols, "left_anti"))
    width = max(1, radius)
    cell = lambda c: F.floor(c / width)
    reach = moved.withColumn("_c", F.explode(F.sequence(cell(F.col("s") - radius), cell(F.col("e") + radius))))
    lines = edited.select(*keys, "line", cell(F.col("line")).alias("_c")).distinct()
    near = reach.join(lines, [*keys, "_c"]).where((F.col("line") >= F.col("s") - radius) & (F.col("line") <= F.col("e") + radius)).select(*cols).distinct()
    marked = moved.join(near.withColumn("_near", F.lit(True)), cols, "left")
    return marked.groupBy(*keys).agg(F.count_if(F.col("_near").isNotNull()).alias("local"), F.count_if(F.col("_near").isNull()).alias("remote"))


def migrated_locally(gone: DataFrame, after: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Declarations (id, line, kind, n_refs) of ``gone`` that stand within ``tolerance`` lines of their old place in ``after`` (id, line, kind, n_refs).

    One does if it has the same id, or is the only one of its kind on its line,
    or has the kind and at least all but one of the references.
    """
    alone = F.count("*").over(Window.partitionBy(*keys, "line", "kind"))
    width = 2 * tolerance + 1
    new = after.select(*keys, F.col("id").alias("_id"), F.col("line").alias("_line"), F.col("kind").alias("_kind"), F.col("n_refs").alias("_n"), alone.alias("_alone"), F.floor(F.col("line") / width).alias("_c"))
    old = gone.where("line > 0").withColumn("_c", F.explode(F.array_distinct(F.array(F.floor((F.col("line") - tolerance) / width), F.floor((F.col("line") + tolerance) / width)))))
    close = F.abs(F.col("line") - F.col("_line")) <= tolerance
    same = (F.col("_id") == F.col("id")) | ((F.col("_kind") == F.col("kind")) & ((F.col("_alone") == 1) | (F.col("n_refs") == 0) | (F.col("_n") >= F.col("n_refs") - 1)))
    return old.join(new, [*keys, "_c"]).where(close & same).select(*keys, "id").distinct()


def relaxes(kinds: Column, context: Column, n_edited: Column, severe: Column, weighted: Column, near: Column) -> Column:
    """Whether grown diagnostics are let pass because the compile arguments are only inferred.

    ``kinds``: what failed; ``near``: whether a new diagnostic is close to an edit.
    """
    others = F.array(*map(F.lit, ("readiness", "identity", "reference", "scope", "tree_error", "tree_ratio")))
    only = F.array_contains(kinds, "diagnostics") & ~F.arrays_overlap(kinds, others)
    paired = (context == "paired") & (severe <= 8) & (weighted <= 48) & (n_edited > 0)
    shared = context.isin("header", "source") & (severe <= 1) & (weighted <= 10) & (n_edited > 0) & ~near
    return only & (paired | shared)


def culprits(edits: DataFrame, lines: DataFrame, decls: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Policies of edits on culprit lines, and on the lines of declarations that a culprit line declares or first refers to.

    ``lines``: keys, line, backtrack; ``decls``: keys, id, line; ``refs``: keys, id, first (line).
    """
    back = lines.where("backtrack")
    own = back.join(decls, [*keys, "line"]).select(*keys, "id")
    used = back.join(refs.withColumnRenamed("first", "line"), [*keys, "line"]).select(*keys, "id")
    through = own.union(used).distinct().join(decls, [*keys, "id"]).select(*keys, "line")
    all_lines = lines.select(*keys, "line").union(through).distinct()
    return edits.where("line > 0 AND policy <> ''").join(all_lines, [*keys, "line"], "left_semi").select(*keys, "policy").distinct()


def header_order(blocks: DataFrame, header: DataFrame, keys: list[str]) -> DataFrame:
    """Source blocks (name, start) in the order of the header's declarations (name, place, access), with position, access and whether a section begins.

    Duplicates of a name are paired in order; blocks beyond them follow in the
    order of the source, with the access of the name's last declaration. Names
    that the header lacks are left out.
    """
    nth = lambda by: F.row_number().over(Window.partitionBy(*keys, "name").orderBy(by))
    h = header.select(*keys, "name", "place", "access", nth("place").alias("_k"))
    last = header.groupBy(*keys, "name").agg(F.max_by("access", "place").alias("_last"))
    b = blocks.withColumn("_k", nth("start")).join(last, [*keys, "name"])
    rows = b.join(h, [*keys, "name", "_k"], "left").withColumn("access", F.coalesce("access", "_last"))
    w = Window.partitionBy(*keys).orderBy(F.col("place").asc_nulls_last(), "start")
    out = rows.withColumn("position", F.row_number().over(w)).withColumn("section", F.coalesce(F.lag("access").over(w) != F.col("access"), F.lit(True)))
    return out.select(*keys, "name", "start", "access", "position", "section")


def companions(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Existing companions (companion) of files (path, dir, stem, header): the same stem in the folder or in its twin, of the other kind.

    ``listing``: path, dir, stem, header. A twin has one folder of headers for one of sources in its place, or the other way round.

    The pairs grow with the square of a stem's files in a folder and are counted first, by place. Each place is cut
    into cells of some paths and some companions, and cells are dealt into as many tasks as the pairs ask for: what
    moves is a row for each path and a list for each cell, and pairs are only made behind that.
    """
    segs = F.split("dir", "/")
    swap = lambda s, a, b: F.when(F.lower(s).isin(*a), F.array(*map(F.lit, b))).when(F.lower(s).isin(*b), F.array(*map(F.lit, a))).otherwise(F.array().cast("array<string>"))
    twins = F.flatten(F.transform(F.sequence(F.lit(0), F.size(segs) - 1), lambda i: F.transform(swap(F.get(segs, i), HEADER_DIRS, SOURCE_DIRS), lambda r: F.array_join(F.transform(segs, lambda s, k: F.when(k == i, r).otherwise(s)), "/"))))
    at = ["_d", "stem", "_h"]
    folders = files.select("dir").distinct().select("dir", F.explode(F.array_distinct(F.concat(F.array("dir"), twins))).alias("_d"))  # twins cost more than a join
    places = files.join(folders, "dir").select("path", "_d", "stem", (~F.col("header")).alias("_h")).distinct()
    # a path that is listed once meets a place once, so of all pairs only those with paths listed in several places have to be made distinct
    listed = listing.groupBy(F.col("path").alias("companion")).agg(F.collect_set(F.struct(F.col("dir").alias("_d"), "stem", F.col("header").alias("_h"))).alias("xs"))
    others = listed.select("companion", (F.size("xs") > 1).alias("_many"), F.explode("xs").alias("x")).select("companion", "_many", "x.*")
    met = others.groupBy(*at, "_many").agg(F.count("*").alias("_c")).join(places.groupBy(*at).agg(F.count("*").alias("_p")), at)
    cells = cut(met.select(*at, "_many", (F.col("_p") * F.col("_c")).alias("_n"), F.ceil(F.col("_p") / BLOCK).alias("_is"), F.ceil(F.col("_c") / LISTED).alias("_js")))
    sums = {r["_many"]: r.n for r in cells.groupBy("_many").agg(F.sum("_n").alias("n")).collect()}  # two rows at most
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(many: bool) -> DataFrame:
        n, cell = max(least, sums.get(many, 0) // PAIRS + 1), [*at, "_i", "_j"]
        own = cells.where(F.col("_many") == many).select(*at, "_is", "_js")
        all_of = lambda c: F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)
        asked = places.join(own, at).select(*at, "path", F.pmod(F.xxhash64("path"), "_is").alias("_i"), F.explode(all_of("_js")).alias("_j"))
        some = others.where(F.col("_many") == many).join(own, at).withColumn("_j", F.pmod(F.xxhash64("companion"), "_js"))
        blank = F.array_repeat(F.lit(None), F.count_if(F.col("companion").isNull()).cast("int"))  # a list leaves it out
        lists = some.groupBy(*at, "_is", "_j").agg(F.concat(F.collect_list("companion"), blank).alias("cs")).withColumn("_i", F.explode(all_of("_is"))).drop("_is")
        return asked.repartition(n, *cell).join(lists.repartition(n, *cell).hint("shuffle_hash"), cell).select("path", F.explode("cs").alias("companion"))

    return pairs(False).unionByName(pairs(True).distinct()) if True in sums else pairs(False)


def first_companion(source: DataFrame, listing: DataFrame, roots: list[str], extensions: list[str]) -> DataFrame:
    """The first existing header of each source (path, dir, stem): beside it, then under the roots, by extension. ``listing``: dir, stem, ext, path."""
    places = F.array(*(F.struct(F.lit(i).alias("i"), d.alias("dir"), F.lit(e).alias("ext")) for i, (d, e) in enumerate((d, e) for d in (F.col("_dir"), *map(F.lit, roots)) for e in extensions)))
    asked = source.select(F.col("path").alias("source"), F.col("dir").alias("_dir"), "stem").withColumn("x", F.explode(places)).select("source", "stem", "x.*")
    return asked.join(listing, ["dir", "stem", "ext"]).groupBy("source").agg(F.min_by("path", "i").alias("header"))


def seeded(learnt: DataFrame, stored: DataFrame) -> DataFrame:
    """What was learnt, or what a store holds if that is nothing."""
    return stored if learnt.isEmpty() else learnt


def retry_sums(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """attempts and successes by strategy and context."""
    return outcomes.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"))


def signature(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """A value of each key's rows that doesn't depend on their order: the XOR of their hashes (60 bits of MD5)."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return rows.groupBy(*keys).agg(F.bit_xor(h).alias("signature"))


def unique_at(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A table of declarations or references in order, one row for each place and id, numbered within its file."""
    once = rows.dropDuplicates([*keys, *order])
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def changed_features(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached features of files with the size and time that they were taken at, and the files without."""
    keys = ["path", "size", "mtime"]
    return files.join(cache, keys), files.join(cache.select(*keys), keys, "left_anti")


def registry_order(policies: DataFrame, settings: DataFrame) -> DataFrame:
    """Enabled policies of a run in the order of the registry (place)."""
    return numbered(policies.join(settings.where("enabled").select("policy"), "policy", "left_semi"), ["run"], ["place"])


def observations(results: DataFrame) -> DataFrame:
    """What a scheduler keeps of results: path, size, lines, wall_ns, penalty_ns and error."""
    return results.select("path", F.octet_length("text").cast("bigint").alias("size"), (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("bigint").alias("lines"), (F.col("ms") * 1_000_000).cast("bigint").alias("wall_ns"), (F.col("retries") * 1_000_000).cast("bigint").alias("penalty_ns"), F.col("error").isNotNull().alias("error"))


def finalized(benchmark: DataFrame, gate: DataFrame) -> DataFrame:
    """By run the accuracy that goes into the rollout: the benchmark's, or the gate's where there was no benchmark."""
    cols = ["precision", "recall", "match_ratio", "samples"]
    g = gate.select("run", *(F.col(c).alias(f"_{c}") for c in cols))
    rows = benchmark.withColumn("_b", F.lit(True)).join(g, "run", "full")
    return rows.select("run", *(F.coalesce(c, f"_{c}").alias(c) for c in cols), F.when(F.col("_b"), "benchmark").otherwise("gate").alias("source"))


def scope_integrity(before: DataFrame, drift: DataFrame, counts: DataFrame, keys: list[str], tolerance: int, penalty: int) -> DataFrame:
    """severity, regressed and penalty by ``keys``, from the drift of scope counts (drift) and ranges (local, remote); ``before``: keys, n scopes."""
    rows = before.join(drift, keys, "left").join(counts, keys, "left").na.fill(0, ["local", "remote", "drift"])
    moved = F.col("drift") + F.col("remote")
    bad = (F.col("drift") > tolerance) | (F.col("remote") > tolerance)
    severity = F.least(moved / F.greatest("n", F.lit(1)), F.lit(1.0))
    return rows.select(*keys, severity.alias("severity"), bad.alias("regressed"), F.when(bad, penalty).otherwise(0).alias("penalty"))


def macro_touches(edited: DataFrame, ranges: DataFrame, keys: list[str], width: int = 16) -> DataFrame:
    """By ``keys`` the edited lines (an ordered array) inside macro ranges (s, e) of either version."""
    cells = ranges.distinct().withColumn("_c", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    lines = edited.select(*keys, "line").distinct().withColumn("_c", F.floor(F.col("line") / width))
    hit = lines.join(cells, [*keys, "_c"]).where((F.col("line") >= F.col("s")) & (F.col("line") <= F.col("e"))).select(*keys, "line").distinct()
    return hit.groupBy(*keys).agg(F.array_sort(F.collect_list("line")).alias("lines"))


def error_stats(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Of a tree's nodes (line, bad) the share that are errors or missing, and the lines that these begin on."""
    bad = F.count_if("bad")
    return nodes.groupBy(*keys).agg((bad / F.count("*")).alias("ratio"), bad.alias("errors"), F.array_sort(F.collect_set(F.when(F.col("bad"), F.col("line")))).alias("lines"))


def to_cache(results: DataFrame, fingerprint: str) -> DataFrame:
    """Results (path, text and more) as cache rows: key (path, checksum and length of the text, fingerprint) and payload (JSON)."""
    raw = F.col("text").cast("binary")
    key = F.concat_ws("|", "path", F.concat_ws("-", F.lower(F.hex(F.crc32(raw))), F.octet_length(raw).cast("string")), F.lit(fingerprint))
    return results.select(key.alias("key"), F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("payload"))


def from_cache(rows: DataFrame, schema) -> DataFrame:
    """The results of cache rows."""
    return rows.select(F.from_json("payload", schema).alias("r")).select("r.*")


def renamed(lines: DataFrame, occurrences: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, line_no, line) with names replaced at their places: occurrences (keys, line_no, column from 1, old, new).

    From the right, so that places stay; a place where the old name doesn't stand is passed over.
    """
    at = [*keys, "line_no"]
    places = occurrences.groupBy(*at).agg(F.reverse(F.array_sort(F.collect_set(F.struct("column", "old", "new")))).alias("xs"))
    put = lambda s, x: F.when(F.substring(s, x["column"], F.length(x["old"])) == x["old"], F.concat(F.substring(s, F.lit(1), x["column"] - 1), x["new"], F.substring(s, x["column"] + F.length(x["old"]), F.length(s)))).otherwise(s)
    rows = lines.join(places, at, "left")
    return rows.withColumn("line", F.when(F.col("xs").isNull(), F.col("line")).otherwise(F.aggregate("xs", F.col("line"), put))).drop("xs")
