"""Symbols before and after: what was added, removed, renamed, moved, and who uses what.

Tables: defs (file, name, header, body), defines and uses (grp, file, symbol).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def joined(column: str):
    return F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ",")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (file, name): added, removed, or kept with or without an equal header and body."""
    was = old.groupBy("file", "name").agg(F.min("header").alias("h0"), F.min("body").alias("b0"))
    now = new.groupBy("file", "name").agg(F.min("header").alias("h1"), F.min("body").alias("b1"))
    said = (
        F.when(F.col("b0").isNull(), "added")
        .when(F.col("b1").isNull(), "removed")
        .when(F.col("h0") != F.col("h1"), "signature")
        .when(F.col("b0") != F.col("b1"), "body")
        .otherwise("same")
    )
    return was.join(now, ["file", "name"], "full_outer").select("file", "name", said.alias("change"))


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Removed (name, body) that newly appear in exactly one other file."""
    key = ["file", "name", "body"]
    gone = old.select(*key).dropDuplicates().join(new.select("file", "name").dropDuplicates(), ["file", "name"], "left_anti")
    came = new.select(*key).dropDuplicates().join(old.select("file", "name").dropDuplicates(), ["file", "name"], "left_anti").withColumnRenamed("file", "target")
    pairs = gone.join(came, ["name", "body"]).where("file <> target")
    return pairs.groupBy("file", "name", "body").agg(F.min("target").alias("target"), F.countDistinct("target").alias("n")).where("n = 1").drop("n")


def rename_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Removed and added definitions of a file with equal bodies: the best (smallest) partner of each removed one, where mutual."""
    gone = old.join(new.select("file", "name").dropDuplicates(), ["file", "name"], "left_anti").select("file", "body", F.col("name").alias("before")).dropDuplicates()
    came = new.join(old.select("file", "name").dropDuplicates(), ["file", "name"], "left_anti").select("file", "body", F.col("name").alias("after")).dropDuplicates()
    pairs = gone.join(came, ["file", "body"]).select("file", "before", "after").dropDuplicates()
    first = lambda by: F.row_number().over(Window.partitionBy("file", by).orderBy("before", "after"))
    return pairs.withColumn("i", first("before")).withColumn("j", first("after")).where("i = 1 and j = 1").select("file", "before", "after")


def body_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names on both sides with an equal header and different bodies."""
    o = old.select("file", "name", "header", F.col("body").alias("was"))
    n = new.select("file", "name", "header", F.col("body").alias("now"))
    return o.join(n, ["file", "name", "header"]).where("was <> now").select("file", "name", "header").dropDuplicates()


def removals(old: DataFrame, new: DataFrame, renamed: DataFrame) -> DataFrame:
    """Old definitions that are neither there any more nor renamed."""
    gone = old.select("file", "name").dropDuplicates().join(new.select("file", "name"), ["file", "name"], "left_anti")
    return gone.join(renamed.select("file", F.col("before").alias("name")), ["file", "name"], "left_anti")


def invert(pairs: DataFrame) -> DataFrame:
    """symbol -> its groups, ascending."""
    return pairs.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_set("grp")), lambda g: g.cast("string")), ",").alias("grps"))


def edges(defines: DataFrame, uses: DataFrame, cross_file: bool = True) -> DataFrame:
    """(src, dst, symbol): a user of a symbol that exactly one group defines; one edge a pair, by its smallest symbol."""
    sole = defines.groupBy("symbol").agg(F.min("grp").alias("src"), F.min("file").alias("src_file"), F.countDistinct("grp").alias("n")).where("n = 1").drop("n")
    met = uses.join(sole, "symbol").where(F.col("grp") != F.col("src"))
    if not cross_file:
        met = met.where("file = src_file")
    return met.groupBy("src", F.col("grp").alias("dst")).agg(F.min("symbol").alias("symbol"))


def fan_in(defines: DataFrame, uses: DataFrame) -> DataFrame:
    """A ledger row for each (group, symbol) defined: how many other groups use it."""
    met = defines.select("grp", "symbol").join(uses.select("symbol", F.col("grp").alias("user")), "symbol", "left")
    return met.groupBy("grp", "symbol").agg(F.countDistinct(F.when(F.col("user") != F.col("grp"), F.col("user"))).alias("used_by"))


def undefined_members(declared: DataFrame, initialised: DataFrame, before: DataFrame) -> DataFrame:
    """Declared members that are neither initialised nor were there before."""
    return declared.join(initialised, ["file", "name"], "left_anti").join(before, ["file", "name"], "left_anti").dropDuplicates()


def containment(defines: DataFrame, homes: DataFrame) -> DataFrame:
    """(parent, child): groups whose enclosing name another group of the file defines; once a pair."""
    d = defines.select(F.col("grp").alias("parent"), "file", "symbol")
    h = homes.select(F.col("grp").alias("child"), "file", F.col("scope").alias("symbol"))
    return h.join(d, ["file", "symbol"]).where("parent <> child").select("parent", "child").dropDuplicates()


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots (key, content, place) compared: New, Changed, Moved, Same or Gone."""
    o = old.select("key", F.col("content").alias("c0"), F.col("place").alias("p0"))
    n = new.select("key", F.col("content").alias("c1"), F.col("place").alias("p1"))
    said = F.when(F.col("c0").isNull(), "New").when(F.col("c1").isNull(), "Gone").when(F.col("c0") != F.col("c1"), "Changed").when(F.col("p0") != F.col("p1"), "Moved").otherwise("Same")
    return o.join(n, "key", "full_outer").select("key", said.alias("delta"))


def migrate(notes: DataFrame, renamed: DataFrame) -> DataFrame:
    """Notes (file, name, note) under the new names of renamed symbols."""
    r = renamed.select("file", F.col("before").alias("name"), "after")
    return notes.join(r, ["file", "name"], "left").select("file", F.coalesce("after", "name").alias("name"), "note")


def nth(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with their number among those of an equal key: the identity that survives a reload."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long") - 1)


def arity(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls (file, name, given) outside the one [required, total] that their name has everywhere."""
    one = definitions.groupBy("name").agg(F.min("required").alias("required"), F.min("total").alias("total"), F.countDistinct("required", "total").alias("n")).where("n = 1").drop("n")
    return calls.join(one, "name").where("given < required or given > total").groupBy("name", "required", "total").agg(F.count("*").alias("calls"))


def incomplete_renames(renamed: DataFrame, new: DataFrame, uses: DataFrame) -> DataFrame:
    """Old names that nothing defines any more but something still uses."""
    return renamed.select("file", F.col("before").alias("name")).join(new.select("name"), "name", "left_anti").join(uses.select(F.col("symbol").alias("name")), "name", "left_semi").select("file", "name").dropDuplicates()


def consumers(files: DataFrame, needles: DataFrame, most_files: int = 200, most_bytes: int = 512 * 1024, most_total: int = 8 * 1024 * 1024) -> DataFrame:
    """Files (repo, path, content) that hold a needle, in path order, until a repository's caps of files and bytes are reached.

    Needles (needle) are the imports of one change: a stated, small set, so they become one pattern of the scan."""
    pattern = "|".join("\\Q" + r["needle"].replace("\\E", "\\E\\\\E\\Q") + "\\E" for r in needles.select("needle").dropDuplicates().orderBy("needle").collect())
    hit = files.withColumn("size", F.octet_length("content").cast("long")).where(F.col("size") <= most_bytes)
    hit = hit.where(F.col("content").rlike(pattern) if pattern else F.lit(False))
    by = Window.partitionBy("repo").orderBy("path")
    x = hit.withColumn("n", F.row_number().over(by)).withColumn("total", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where((F.col("n") <= most_files) & (F.col("total") <= most_total)).select("repo", "path", "size")


def symbol_history(touches: DataFrame, at: DataFrame, most: int = 10) -> DataFrame:
    """The nearest commits before and after each point that touch its symbol. touches: symbol, time, sha; at: symbol, point."""
    x = touches.join(at, "symbol").where("time <> point").withColumn("side", F.when(F.col("time") < F.col("point"), "before").otherwise("after"))
    gap = F.when(F.col("time") < F.col("point"), F.col("point") - F.col("time")).otherwise(F.col("time") - F.col("point"))
    place = F.row_number().over(Window.partitionBy("symbol", "point", "side").orderBy(gap, "sha"))
    return x.withColumn("place", place).where(F.col("place") <= most).select("symbol", "point", "side", "place", "sha")


def stale_strings(texts: DataFrame, renamed: DataFrame) -> DataFrame:
    """Quoted dotted paths in texts (id, text) that still name an old place (before, after)."""
    quoted = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit("[\"']([A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z0-9_]+)+)[\"']"), 1)).alias("before"))
    return quoted.join(renamed, "before").select("id", "before", "after").dropDuplicates()


def own_bound(uses: DataFrame, bound: DataFrame, imported: DataFrame) -> DataFrame:
    """Uses (grp, file, symbol) of names that the file binds itself and does not import."""
    return uses.join(bound.select("file", "symbol"), ["file", "symbol"], "left_semi").join(imported.select("file", "symbol"), ["file", "symbol"], "left_anti")


def relation(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """Whether the first of a pair (a, b) reaches the second, the other way round, or neither. reach: start, node."""
    r = reach.select(F.col("start").alias("a"), F.col("node").alias("b"), F.lit(1).alias("down"))
    s = reach.select(F.col("node").alias("a"), F.col("start").alias("b"), F.lit(1).alias("up"))
    said = F.when(F.col("down") == 1, "before").when(F.col("up") == 1, "after").otherwise("free")
    return pairs.join(r, ["a", "b"], "left").join(s, ["a", "b"], "left").select("a", "b", said.alias("relation"))


def extractions(old: DataFrame, new: DataFrame, least: int = 3) -> DataFrame:
    """New definitions with ``least`` lines or more of which at least so many and half left one old definition of the file.

    old, new: file, name, line. The source must still be there without those lines; the one that gave most, then the first."""
    added = new.join(old.select("file", "name").dropDuplicates(), ["file", "name"], "left_anti")
    sizes = added.groupBy("file", "name").agg(F.count_distinct("line").alias("size")).where(F.col("size") >= least)
    left = old.join(new.select("file", "name").dropDuplicates(), ["file", "name"], "left_semi").join(new, ["file", "name", "line"], "left_anti").select("file", "line", F.col("name").alias("source")).dropDuplicates()
    shared = added.dropDuplicates().join(left, ["file", "line"]).groupBy("file", "name", "source").agg(F.count_distinct("line").alias("shared"))
    good = shared.join(sizes, ["file", "name"]).where((F.col("shared") >= least) & (2 * F.col("shared") >= F.col("size")))
    return good.groupBy("file", "name").agg(F.min_by("source", F.struct(-F.col("shared"), F.col("source"))).alias("source"), F.max("shared").alias("shared"))


def local_definitions(defines: DataFrame, locals_: DataFrame) -> DataFrame:
    """(grp, symbol, lo, hi): rows that see a group's definition, for symbols that no hunk of the group defines for its whole file.

    defines: grp, hunk, symbol; locals_: hunk, symbol, lo, hi."""
    met = defines.select("grp", "hunk", "symbol").dropDuplicates().join(locals_, ["hunk", "symbol"], "left")
    whole = met.where("lo is null").select("grp", "symbol").dropDuplicates()
    return met.where("lo is not null").join(whole, ["grp", "symbol"], "left_anti").select("grp", "symbol", "lo", "hi")
