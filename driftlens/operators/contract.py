"""Callers against a changed callee. Tables: old and new (name, params, defaults, raised, entered: arrays of strings), calls
(id, name, positional, keywords, caught, spread, untouched)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both(old: DataFrame, new: DataFrame) -> DataFrame:
    """Callables defined once on each side, their columns as was_ and now_."""
    once = lambda x: x.join(x.groupBy("name").count().where("count = 1").select("name"), "name", "left_semi")
    columns = [c for c in old.columns if c != "name"]
    return once(old).withColumnsRenamed({c: f"was_{c}" for c in columns}).join(once(new).withColumnsRenamed({c: f"now_{c}" for c in columns}), "name")


def positions_shifted(old: DataFrame, new: DataFrame, calls: DataFrame) -> DataFrame:
    """Untouched calls that pass by position the first parameter that now stands elsewhere."""
    moved = F.filter(F.sequence(F.lit(1), F.size("was_params")), lambda k: F.array_contains("now_params", F.element_at("was_params", k)) & (F.array_position("now_params", F.element_at("was_params", k)) != k))
    x = both(old, new).where("size(was_params) > 0").select("name", F.get(moved, F.lit(0)).alias("k"), "was_params").where("k is not null")
    return calls.where("untouched and not spread").join(x, "name").where("positional >= k").select("id", "name", F.element_at("was_params", F.col("k")).alias("parameter"))


def keywords_dropped(old: DataFrame, new: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls that pass by name a parameter that is gone."""
    x = both(old, new).select("name", F.array_except("was_params", "now_params").alias("gone"))
    y = calls.join(x, "name").withColumn("dropped", F.array_sort(F.array_intersect("keywords", "gone")))
    return y.where("size(dropped) > 0").select("id", "name", F.array_join("dropped", ",").alias("dropped"))


def defaults_changed(old: DataFrame, new: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls that rely on the first default that changed: neither spread, by name, nor by position."""
    changed = F.filter(F.sequence(F.lit(1), F.least(F.size("was_defaults"), F.size("now_defaults"))), lambda k: F.element_at("was_defaults", k) != F.element_at("now_defaults", k))
    x = both(old, new).where("least(size(was_defaults), size(now_defaults)) > 0").select("name", F.get(changed, F.lit(0)).alias("k"), "now_params").where("k is not null")
    y = calls.where("not spread").join(x, "name").where("positional < k and not coalesce(array_contains(keywords, get(now_params, k - 1)), false)")
    return y.select("id", "name", F.col("k").cast("long").alias("position"))


def handlers_missed(old: DataFrame, new: DataFrame, calls: DataFrame) -> DataFrame:
    """Guarded calls that catch what is no longer raised and none of what is raised now."""
    x = both(old, new).select("name", F.array_except("was_raised", "now_raised").alias("gone"), F.array_except("now_raised", "was_raised").alias("came")).where("size(gone) > 0 and size(came) > 0")
    return calls.join(x, "name").where("arrays_overlap(caught, gone) and not arrays_overlap(caught, came) and not array_contains(caught, 'Exception')").select("id", "name")


def guarantees_dropped(old: DataFrame, new: DataFrame) -> DataFrame:
    """Callables that enter fewer contexts than before, and which they left."""
    x = both(old, new).where("size(now_entered) < size(was_entered)").withColumn("lost", F.array_sort(F.array_except("was_entered", "now_entered")))
    return x.where("size(lost) > 0").select("name", F.array_join("lost", ",").alias("lost"))


def overrides_left(old: DataFrame, new: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides (name, owner, params) that still have the old parameter list of a method whose list changed."""
    x = both(old, new).where("was_params <> now_params").select("name", "was_params")
    return overrides.join(x, "name").where("params = was_params").select("name", "owner")


def unimplemented(abstract: DataFrame, subclasses: DataFrame, methods: DataFrame) -> DataFrame:
    """Subclasses (base, owner) that lack a new abstract method (base, name). methods: owner, name."""
    return subclasses.join(abstract, "base").join(methods, ["owner", "name"], "left_anti").select("base", "owner", "name")


def enum_values_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members (owner, member, value) of an equal name with another value."""
    return old.withColumnRenamed("value", "was").join(new.withColumnRenamed("value", "now"), ["owner", "member"]).where("was <> now")


def loosened_tests(old: DataFrame, new: DataFrame, pattern: str) -> DataFrame:
    """Tests (id, text) with fewer matches of an assertion pattern than before."""
    n = lambda side, name: side.select("id", F.regexp_count("text", F.lit(pattern)).alias(name))
    return n(old, "was").join(n(new, "now"), "id").where("now < was").select("id", F.col("was").cast("long").alias("was"), F.col("now").cast("long").alias("now"))


def discarded_awaits(old: DataFrame, new: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls whose result is discarded of what became asynchronous. old, new: name, asynchronous; calls: id, name, discarded."""
    became = new.where("asynchronous").join(old.where("not asynchronous").select("name"), "name", "left_semi").select("name").dropDuplicates()
    return calls.where("discarded").join(became, "name", "left_semi").select("id", "name")


def duplicated_helpers(added: DataFrame, least: float = 0.9) -> DataFrame:
    """Added functions (file, name, lines) of one name in two files whose line sets are nearly equal; said of the later file.

    The name is the join key; pairs of files of one name are compared by their lines."""
    a, b = added.select(F.col("file").alias("first"), "name", F.col("lines").alias("l0")), added.select("file", "name", "lines")
    share = F.size(F.array_intersect("l0", "lines")) * 2 / (F.size("l0") + F.size("lines"))
    return a.join(b, "name").where((F.col("first") < F.col("file")) & (F.size("lines") >= 3) & (F.size("l0") >= 3)).where(share >= least).groupBy("name", "file").agg(F.min("first").alias("first"))


def caller_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """New calls (file, row, name, via_self, text), each with whether its file already had the same call."""
    key = ["file", "name", "via_self", "text"]
    seen = old.select(*key).dropDuplicates().withColumn("untouched", F.lit(True))
    return new.join(seen, key, "left").select("file", "row", "name", "via_self", F.coalesce("untouched", F.lit(False)).alias("untouched"))


def callers(sites: DataFrame, index: DataFrame) -> DataFrame:
    """Calls that reach each changed callable (site, file, name, method): one by its bare name from anywhere, a method through
    its own object from inside its file."""
    x = index.withColumnsRenamed({"file": "at", "via_self": "method"}).join(sites, ["name", "method"])
    return x.where(~F.col("method") | (F.col("at") == F.col("file"))).select("site", "at", "row", "untouched")


def getter_flipped(old: DataFrame, new: DataFrame, reads: DataFrame, named: DataFrame) -> DataFrame:
    """Members that turned from method to property or back, and the uses that still follow the old form.

    old, new: file, owner, name, getter; reads: file, row, name, called; named (file, owner): files that name a class. A use
    in another file counts if that file names the owner. Members that stand twice on a side are left out."""
    key = ["file", "owner", "name"]
    once = lambda x, c: x.groupBy(*key).agg(F.count("*").alias("n"), F.first("getter").alias(c)).where("n = 1").drop("n")
    flips = once(old, "was").join(once(new, "now"), key).where("was <> now and owner is not null")
    uses = flips.select(*key, F.col("now").alias("called")).join(reads.withColumnRenamed("file", "at"), ["name", "called"])
    known = named.select(F.col("file").alias("at"), "owner").dropDuplicates().withColumn("names", F.lit(True))
    stale = uses.join(known, ["at", "owner"], "left").where((F.col("at") == F.col("file")) | F.col("names"))
    now = F.when(F.col("called"), "property").otherwise("method")
    return stale.groupBy(*key, now.alias("now")).agg(F.count("*").alias("uses"), F.min("at").alias("first_file"))
