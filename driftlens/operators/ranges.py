"""Interval joins: facts at rows, spans and outside findings brought to the hunks that cover them.

Every join has the equi-key (review, file, bin of rows), so rows meet by hash or sort-merge with the interval as a residual
filter, never in a nested loop, and a file's rows are dealt by their place in it. Tables: hunks (review, file, hunk, n0, n1 new rows, o0, o1 old rows, both inclusive, the empty side
ending before it starts), facts (review, file, row_no, name, kind), spans (review, file, name, lo, hi, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["review", "file"]
HUNK = [*KEY, "hunk"]


#: Rows of a bin: points and ranges meet by bin, so a file with very many of both is cut.
BIN = 64


def inside(points: DataFrame, row: str, ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """Points with each range of their file that holds them, ends included: ranges are put in the bins that they touch, a
    point is in one, so every pair meets once."""
    p = points.withColumn("_bin", F.floor(F.col(row) / BIN))
    r = ranges.where(F.col(hi) >= F.col(lo)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / BIN), F.floor(F.col(hi) / BIN))))
    return p.join(r, [*KEY, "_bin"]).where(F.col(row).between(F.col(lo), F.col(hi))).drop("_bin")


def covered(facts: DataFrame, hunks: DataFrame, row: str = "row_no", lo: str = "n0", hi: str = "n1") -> DataFrame:
    """Facts with each hunk whose range holds their row."""
    return inside(facts, row, hunks, lo, hi)


def overlapping(spans: DataFrame, hunks: DataFrame) -> DataFrame:
    """Spans with each hunk that they share a row with."""
    return spans.join(hunks, KEY).where((F.col("lo") <= F.col("n1")) & (F.col("hi") >= F.col("n0")))


def names(condition=None):
    """Sorted distinct names, comma-joined, of the rows that fulfil a condition."""
    value = F.col("name") if condition is None else F.when(condition, F.col("name"))
    return F.array_join(F.array_sort(F.collect_set(value)), ",")


def category(hunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Definition if a definition row is inside, else import if an import row is, else other."""
    found = covered(facts, hunks.select(*HUNK, "n0", "n1")).groupBy(*HUNK).agg(F.max((F.col("kind") == "def").cast("int")).alias("d"), F.max((F.col("kind") == "import").cast("int")).alias("i"))
    said = F.when(F.col("d") == 1, "definition").when(F.col("i") == 1, "import").otherwise("other")
    return hunks.select(*HUNK).join(found, HUNK, "left").select(*HUNK, said.alias("category"))


def innermost(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """The smallest span that holds a hunk's first new row; ties: the earlier, then by name."""
    held = inside(hunks.select(*HUNK, "n0"), "n0", spans, "lo", "hi")
    best = held.groupBy(*HUNK).agg(F.min_by("name", F.struct(F.col("hi") - F.col("lo"), "lo", "name")).alias("enclosing"))
    return hunks.select(*HUNK).join(best, HUNK, "left")


def symbols(hunks: DataFrame, facts: DataFrame) -> DataFrame:
    """What a hunk declares, imports and uses (uses without declared or imported names)."""
    inside = covered(facts, hunks.select(*HUNK, "n0", "n1")).groupBy(*HUNK)
    got = inside.agg(
        F.collect_set(F.when(F.col("kind") == "def", F.col("name"))).alias("d"),
        F.collect_set(F.when(F.col("kind") == "import", F.col("name"))).alias("i"),
        F.collect_set(F.when(F.col("kind").isin("use", "member"), F.col("name"))).alias("u"),
    )
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return got.select(*HUNK, joined(F.array_except("d", "i")).alias("declared"), joined(F.col("i")).alias("imports"), joined(F.array_except(F.array_except("u", "d"), "i")).alias("uses"))


def member_only(hunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Names all of whose uses in a hunk are member accesses."""
    uses = covered(facts, hunks.select(*HUNK, "n0", "n1")).where(F.col("kind").isin("use", "member"))
    each = uses.groupBy(*HUNK, "name").agg(F.min((F.col("kind") == "member").cast("int")).alias("all_member")).where("all_member = 1")
    return each.groupBy(*HUNK).agg(names().alias("member_uses"))


def smells(hunks: DataFrame, spans: DataFrame, lines: int = 60, depth: int = 4, params: int = 6) -> DataFrame:
    """Structural notes on definitions that start in a hunk: at least so many lines, levels or parameters."""
    starts = inside(spans, "lo", hunks.select(*HUNK, "n0", "n1"), "n0", "n1")
    worst = starts.groupBy(*HUNK).agg(F.max(F.col("hi") - F.col("lo") + 1).alias("lines"), F.max("depth").alias("depth"), F.max("params").alias("params"))
    said = [F.when(F.col(c) >= limit, F.concat(F.lit(f"{text} "), F.col(c).cast("string"))) for c, limit, text in (("lines", lines, "large:"), ("depth", depth, "deep:"), ("params", params, "params:"))]
    return worst.select(*HUNK, F.concat_ws("; ", *said).alias("notes")).where("notes <> ''")


def advisories(hunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Named facts attached to hunks, each (name, kind) once in a hunk."""
    return covered(facts, hunks.select(*HUNK, "n0", "n1")).select(*HUNK, "name", "kind").dropDuplicates()


def place_findings(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Each outside finding with the first hunk, in reading order, that covers its line; without one: unplaced (null)."""
    met = covered(findings, hunks.select(*HUNK, "n0", "n1")).groupBy(*KEY, "row_no", "name", "kind").agg(F.min("hunk").alias("hunk"))
    every = findings.select(*KEY, "row_no", "name", "kind").dropDuplicates()
    return every.join(met, [*KEY, "row_no", "name", "kind"], "left")


def place_coverage(lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """Executed and executable lines of each hunk that has any. lines: review, file, row_no, hits."""
    inside = covered(lines, hunks.select(*HUNK, "n0", "n1"))
    return inside.groupBy(*HUNK).agg(F.count_if(F.col("hits") > 0).alias("executed"), F.count("*").alias("executable"))


def wave(hunks: DataFrame, new_lines: DataFrame, old_lines: DataFrame) -> DataFrame:
    """The latest wave among a hunk's new lines, else among its old ones. lines: review, file, row_no, wave."""
    new = covered(new_lines, hunks.select(*HUNK, "n0", "n1")).groupBy(*HUNK).agg(F.max("wave").alias("new_wave"))
    old = covered(old_lines, hunks.select(*HUNK, "o0", "o1"), lo="o0", hi="o1").groupBy(*HUNK).agg(F.max("wave").alias("old_wave"))
    both = hunks.select(*HUNK).join(new, HUNK, "left").join(old, HUNK, "left")
    return both.select(*HUNK, F.coalesce("new_wave", "old_wave").alias("wave"))


def metric_deltas(old: DataFrame, new: DataFrame, hunks: DataFrame) -> DataFrame:
    """Definitions unique by name on both sides whose figures moved, given to the first hunk that touches the new span."""

    def unique(x: DataFrame) -> DataFrame:
        return x.withColumn("times", F.count("*").over(Window.partitionBy(*KEY, "name"))).where("times = 1").drop("times")

    was = unique(old).select(*KEY, "name", F.col("params").alias("params_was"), F.col("depth").alias("depth_was"))
    both = unique(new).join(was, [*KEY, "name"]).where("params <> params_was or depth <> depth_was")
    touched = overlapping(both, hunks.select(*HUNK, "n0", "n1").where("n1 >= n0"))
    return touched.groupBy(*KEY, "name", "params_was", F.col("params").alias("params_now"), "depth_was", F.col("depth").alias("depth_now")).agg(F.min("hunk").alias("hunk"))


def removed_in(removals: DataFrame, hunks: DataFrame) -> DataFrame:
    """Each removed row with the first hunk whose old range holds it."""
    held = covered(removals, hunks.select(*HUNK, "o0", "o1"), lo="o0", hi="o1")
    return held.groupBy(*KEY, "row_no", "name").agg(F.min("hunk").alias("hunk"))


def matched(hunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Hunks with a pattern's row among their new rows: a range semi-join."""
    h, r = hunks.alias("h"), rows.alias("r")
    on = (F.col("h.review") == F.col("r.review")) & (F.col("h.file") == F.col("r.file")) & F.col("r.row_no").between(F.col("h.n0"), F.col("h.n1"))
    return h.join(r, on, "left_semi").select(*HUNK)


def split_insertions(hunks: DataFrame, spans: DataFrame, most: int = 60) -> DataFrame:
    """Pure insertions whose last row is more than ``most`` after the first, cut at every span start inside."""
    pure = hunks.where((F.col("o1") < F.col("o0")) & (F.col("n1") - F.col("n0") > most)).select(*HUNK, "n0", "n1")
    cuts = inside(spans, "lo", pure, "n0", "n1").where("lo > n0").select(*HUNK, "n1", F.col("lo").alias("start"))
    starts = cuts.unionByName(pure.select(*HUNK, "n1", F.col("n0").alias("start"))).dropDuplicates()
    following = F.lead("start").over(Window.partitionBy(*HUNK).orderBy("start"))
    return starts.select(*HUNK, "start", F.coalesce(following - 1, F.col("n1")).alias("stop"))


def leading_cut(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """The first span start strictly inside each hunk: where its leading insertion ends."""
    held = inside(spans, "lo", hunks.select(*HUNK, "n0", "n1"), "n0", "n1").where("lo > n0")
    return held.groupBy(*HUNK).agg(F.min("lo").alias("cut"))


def relocate(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """Anchors (id, file, start, hash) at the same place if the hash still stands there, else at the nearest line with the
    hash (ties: the earlier), else stale (null). lines: file, row_no, hash."""
    met = anchors.join(lines, ["file", "hash"]).groupBy("id", "file", "start", "hash").agg(F.min_by("row_no", F.struct(F.abs(F.col("row_no") - F.col("start")), "row_no")).alias("place"))
    return anchors.select("id", "file", "start", "hash").join(met, ["id", "file", "start", "hash"], "left")


def note_on(notes: DataFrame, hunks: DataFrame) -> DataFrame:
    """(note, review, file, hunk): the first hunk of the file that meets a note's old or new rows; an empty side meets nothing.

    notes: note, review, file, o0, o1 (null: no old rows), n0, n1, from 1 and inclusive."""

    def met(lo: str, hi: str) -> DataFrame:
        bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(b) / BIN)))
        n = notes.where(F.col(hi) >= F.col(lo)).select("note", *KEY, F.col(lo).alias("a"), F.col(hi).alias("b")).withColumn("_bin", bins("a", "b"))
        h = hunks.where(F.col(hi) >= F.col(lo)).select(*HUNK, lo, hi).withColumn("_bin", bins(lo, hi))
        return n.join(h, [*KEY, "_bin"]).where((F.col("a") <= F.col(hi)) & (F.col("b") >= F.col(lo))).select("note", *HUNK)

    return met("o0", "o1").unionByName(met("n0", "n1")).groupBy("note", *KEY).agg(F.min("hunk").alias("hunk"))


def shape(hunks: DataFrame, spans: DataFrame, nesting: DataFrame, declared: DataFrame, uses: DataFrame) -> DataFrame:
    """Largest lines, parameters and nesting of what a hunk's new rows start, and whether a definition among them names itself
    more often than it is declared.

    spans: review, file, name, lo, hi, params; nesting: review, file, row_no, depth; declared: review, file, name, lo, hi, rows
    of a declaration; uses: review, file, row_no, name."""
    own = [*KEY, "name", "lo", "hi"]
    s = spans.select(*own, "params").dropDuplicates()
    d = s.withColumnRenamed("lo", "start")
    held = inside(uses.withColumnRenamed("name", "used"), "row_no", s, "lo", "hi").where("used = name").groupBy(*own).agg(F.count("*").alias("named"))
    told = inside(d, "start", declared.select(*KEY, F.col("name").alias("told"), F.col("lo").alias("from"), F.col("hi").alias("to")), "from", "to")
    told = told.where("told = name").groupBy(*KEY, "name", F.col("start").alias("lo"), "hi").agg(F.count("*").alias("declarations"))
    each = s.join(held, own, "left").join(told, own, "left").na.fill(0, ["named", "declarations"])
    rows = hunks.select(*HUNK, "n0", "n1")
    started = inside(each, "lo", rows, "n0", "n1").groupBy(*HUNK).agg(F.max(F.col("hi") - F.col("lo") + 1).alias("lines"), F.max("params").alias("params"), F.bool_or(F.col("named") > F.col("declarations")).alias("recursive"))
    deep = covered(nesting, rows).groupBy(*HUNK).agg(F.max("depth").alias("nesting"))
    return hunks.select(*HUNK).join(started, HUNK, "left").join(deep, HUNK, "left").na.fill(0, ["lines", "params", "nesting"]).na.fill(False, ["recursive"])
