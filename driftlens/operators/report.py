"""Grouping, ranking and neighbours: groups of hunks, caps, notes, coverage, orders and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators.graph import cut

HUNK = ["review", "file", "hunk"]
DAY = 86400


def group_hunks(hunks: DataFrame) -> DataFrame:
    """Hunks of a file by scope; groups are numbered in the order of their first hunk."""
    first = hunks.groupBy("review", "file", "scope").agg(F.min("hunk").alias("first"), F.count("*").alias("members"))
    number = F.row_number().over(Window.partitionBy("review").orderBy("file", "first")).cast("long") - 1
    return first.select("review", number.alias("grp"), "file", "scope", "first", "members")


def cap_repeats(findings: DataFrame, cap: int = 3) -> DataFrame:
    """At most ``cap`` findings of a rule in a file; the last of them says how many more there are."""
    by = Window.partitionBy("review", "file", "rule")
    x = findings.withColumn("i", F.row_number().over(by.orderBy("hunk", "row_no"))).withColumn("n", F.count("*").over(by)).where(F.col("i") <= cap)
    more = F.when((F.col("i") == cap) & (F.col("n") > cap), F.concat(F.lit(" (and "), (F.col("n") - cap).cast("string"), F.lit(" more in this file)"))).otherwise("")
    return x.select("review", "file", "rule", "hunk", "row_no", F.concat("message", more).alias("message"))


def changeset_notes(files: DataFrame, many: int = 10) -> DataFrame:
    """Per review: whether code changed without a test, and how many files have ``many`` hunks or more."""
    return files.groupBy("review").agg(
        (F.bool_or(F.col("kind") == "code") & ~F.bool_or(F.col("kind") == "test")).alias("untested"),
        F.count_if(F.col("hunks") >= many).alias("churned"),
    )


def file_history(commits: DataFrame, at: str, days: int = 90, cap: int = 50) -> DataFrame:
    """Per path: commits and fixes from ``days`` before ``at`` on, each capped; a path that a commit lists twice counts twice."""
    since = F.to_timestamp(F.lit(at)) - F.expr(f"INTERVAL {days} DAYS")
    recent = commits.where(F.col("at_time") >= since)
    fixed = F.count_if(F.lower("subject").rlike("(^|[^a-z0-9_])(fix|bug|regress|revert|1-urgent)"))
    return recent.groupBy("path").agg(F.least(F.count("*"), F.lit(cap)).alias("commits"), F.least(fixed, F.lit(cap)).alias("fixes"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges out of and into each node."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("edges_out"), F.sum("i").alias("edges_in"))


def coverage(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges whose ends are both reviewed, and approvals ahead of what they depend on. marks: node, at."""
    s, d = marks.select(F.col("node").alias("src"), F.col("at").alias("src_at")), marks.select(F.col("node").alias("dst"), F.col("at").alias("dst_at"))
    both = edges.join(s, "src", "left").join(d, "dst", "left")
    return both.agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("src_at").isNotNull() & F.col("dst_at").isNotNull()).alias("reviewed"),
        F.count_if(F.col("dst_at").isNotNull() & (F.col("src_at").isNull() | (F.col("src_at") > F.col("dst_at")))).alias("out_of_order"),
    )


def audit(rows: DataFrame, reason: str) -> DataFrame:
    """Rows by reason with a total."""
    return rows.rollup(reason).agg(F.count("*").alias("n")).select(F.coalesce(reason, F.lit("total")).alias("reason"), "n")


def first_failing(rows: DataFrame, predicates: list[tuple[str, Column]]) -> DataFrame:
    """How many hidden rows each predicate accounts for: a row is charged to the first that fails."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(predicates):
        reason = F.when(~holds, name).otherwise(reason)
    return rows.select(F.coalesce(reason, F.lit("shown")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def top_level(findings: DataFrame, key: list[str]) -> DataFrame:
    """The hardest finding level of each key: note, warn or verdict."""
    rank = F.when(F.col("level") == "verdict", 2).when(F.col("level") == "warn", 1).otherwise(0)
    worst = findings.groupBy(*key).agg(F.max(rank).alias("rank"))
    return worst.select(*key, F.get(F.array(F.lit("note"), F.lit("warn"), F.lit("verdict")), F.col("rank")).alias("level"))


def suggestions(dismissed: DataFrame, least: int = 3) -> DataFrame:
    """Rules of which at least so many distinct findings were dismissed, and what to do with them."""
    n = dismissed.groupBy("rule").agg(F.count_distinct("key").alias("dismissed"), F.max("level").alias("level")).where(F.col("dismissed") >= least)
    return n.select("rule", "dismissed", F.when(F.col("level") == "warn", "lower to note").otherwise("disable").alias("advice"))


def placements(hunks: DataFrame, position: str) -> DataFrame:
    """Number of each hunk in file order, and its rank in its file along the reading order."""
    number = F.row_number().over(Window.partitionBy("review").orderBy("file", "hunk")).cast("long") - 1
    rank = F.row_number().over(Window.partitionBy("review", "file").orderBy(position, "hunk")).cast("long") - 1
    return hunks.select(*HUNK, number.alias("id"), rank.alias("order_index"))


def near(hunks: DataFrame, most: int = 9) -> DataFrame:
    """Neighbours in a file, none of them noise, at most so many unchanged lines apart."""
    by = Window.partitionBy("review", "file").orderBy("hunk")
    x = hunks.where("not noise").withColumn("before", F.lag("hunk").over(by)).withColumn("gap", F.col("n0") - F.lag("n1").over(by) - 1)
    return x.where(F.col("gap") <= most).select("review", "file", F.col("before").alias("a"), F.col("hunk").alias("b"), "gap")


def replaced_nearby(hunks: DataFrame, reach: int = 2, most: int = 3) -> DataFrame:
    """For each pure deletion the nearest hunk within reach that grew by half of it or more; ties: the earlier."""
    cut = hunks.where("added = 0 and removed > 0").select("review", "file", "hunk", "o0", "o1", "removed")
    grown = hunks.where("added > removed").select("review", "file", F.col("hunk").alias("other"), F.col("o0").alias("p0"), F.col("o1").alias("p1"), (F.col("added") - F.col("removed")).alias("growth"))
    gap = F.when(F.col("other") < F.col("hunk"), F.col("o0") - F.col("p1") - 1).otherwise(F.col("p0") - F.col("o1") - 1)
    met = cut.join(grown, ["review", "file"]).where((F.abs(F.col("other") - F.col("hunk")) <= reach) & (2 * F.col("growth") >= F.col("removed"))).withColumn("gap", gap).where(F.col("gap") <= most)
    best = met.groupBy("review", "file", "hunk").agg(F.min_by("other", F.struct("gap", "other")).alias("other"))
    return best.select("review", "file", "hunk", "other", F.when(F.col("other") < F.col("hunk"), "above").otherwise("below").alias("side"))


def worst(rows: DataFrame, measures: list[str], key: list[str], names: list[str], most: int = 3) -> DataFrame:
    """The rows of largest measures of each key, and how many more there are."""
    by = Window.partitionBy(*key)
    x = rows.withColumn("place", F.row_number().over(by.orderBy(*[F.desc(m) for m in measures], *names))).withColumn("n", F.count("*").over(by))
    return x.where(F.col("place") <= most).select(*key, "place", *names, F.greatest(F.col("n") - most, F.lit(0).cast("long")).alias("more"))


def runs(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Gaps and islands: runs of equal values along an order."""
    by = Window.partitionBy(*key).orderBy(*order)
    x = rows.withColumn("starts", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(by))).cast("int"), F.lit(1))).withColumn("run", F.sum("starts").over(by))
    return x.groupBy(*key, "run", value).agg(F.count("*").alias("length"))


def strategy_file(groups: DataFrame) -> DataFrame:
    """Groups of a review by file, then first row."""
    place = F.row_number().over(Window.partitionBy("review").orderBy("file", "first", "grp")).cast("long") - 1
    return groups.select("review", "grp", place.alias("place"))


def strategy_defs_first(groups: DataFrame) -> DataFrame:
    """Groups by the least category rank of those joined with them, then by file and first row."""
    least = F.min("rank").over(Window.partitionBy("review", "joined"))
    x = groups.withColumn("least", least)
    place = F.row_number().over(Window.partitionBy("review").orderBy("least", "file", "first", "grp")).cast("long") - 1
    return x.select("review", "grp", place.alias("place"))


def following(rows: DataFrame, key: list[str], order: list[str], wanted: Column) -> DataFrame:
    """For each wanted row of a key the next wanted one."""
    by = Window.partitionBy(*key).orderBy(*order)
    return rows.where(wanted).select(*key, *order, *[F.lead(c).over(by).alias(f"next_{c}") for c in order])


def name_list(rows: DataFrame, key: list[str], value: str, shown: int = 3) -> DataFrame:
    """The first names of each key and how many more there are, as text."""
    got = rows.groupBy(*key).agg(F.array_sort(F.collect_set(value)).alias("v"))
    more = F.when(F.size("v") > shown, F.concat(F.lit(" and "), (F.size("v") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return got.select(*key, F.concat(F.array_join(F.slice("v", 1, shown), ", "), more).alias("text"))


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Rows with their place from 0 in a total order, without bringing them to one task: ranges are sorted each by itself
    and start after the rows of the ranges before them, which the driver adds up (one number for each range)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before, total = [], 0
    counts = dict(dealt.groupBy("_part").count().collect())
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    first = F.get(F.array(*[F.lit(n).cast("long") for n in before or [0]]), F.col("_part"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") - 1
    return dealt.withColumn(name, first + inside).drop("_part")


def clipped(s: Column, most: int) -> Column:
    """At most so many characters: cut at the last space if that is in the second half, with an ellipsis."""
    head = F.substring(s, 1, most - 1)
    space = F.instr(F.reverse(head), F.lit(" "))
    place = F.char_length(head) - space
    cut_ = F.when((space > 0) & (place > most // 2), F.regexp_replace(F.substring(head, F.lit(1), place), r"\s+$", "")).otherwise(head)
    return F.when(F.char_length(s) <= most, s).otherwise(F.concat(cut_, F.lit("…")))


#: Fixed value: characters kept free for the note on what was left out.
SUFFIX = 12


def fitted(pieces: Column, budget: int = 240) -> Column:
    """Those pieces that still fit the budget, in order and joined by '; ', then how many were left out; if the first
    does not fit and no other does, its beginning."""
    most = budget - SUFFIX
    fold = F.aggregate(
        pieces,
        F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda acc, p: F.when(
            F.char_length(acc["s"]) + F.char_length(p) + F.when(acc["s"] == "", 0).otherwise(2) <= most,
            F.struct(F.when(acc["s"] == "", p).otherwise(F.concat(acc["s"], F.lit("; "), p)).alias("s"), acc["n"].alias("n")),
        ).otherwise(F.struct(acc["s"].alias("s"), (acc["n"] + 1).alias("n"))),
    )
    alone = (fold["s"] == "") & (F.size(pieces) > 0)
    text = F.when(alone, clipped(F.get(pieces, F.lit(0)), most)).otherwise(fold["s"])
    n = fold["n"] - F.when(alone, 1).otherwise(0)
    return F.when(n > 0, F.concat(text, F.lit("; +"), n.cast("string"), F.lit(" more"))).otherwise(text)


#: What stands before an identifier's next word, and what parts identifiers.
HUMP = r"\p{IsLowercase}(?=\p{IsUppercase})|\p{IsUppercase}(?=\p{IsUppercase}\p{IsLowercase})"
APART = r"[^\p{IsAlphabetic}\p{N}]+"


def pieces_of(text: Column) -> Column:
    """Lower-case words of identifiers: cut at what is neither letter nor number and at humps; no single characters or bare numbers."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, HUMP, "$0 ")), APART), lambda x: (F.char_length(x) > 1) & ~x.rlike("^[0-9]+$"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, top: int = 20) -> DataFrame:
    """Okapi BM25 over the words of identifiers (``pieces_of``): the best documents of each query. docs: id, text; queries: query, text.

    Query terms are distinct; idf is ln(1 + (N - df + 0.5) / (df + 0.5)). Document counts are joined to the terms of
    queries only, so what is not asked for is dropped before the join.
    """
    terms = queries.select("query", F.explode(F.array_distinct(pieces_of(F.col("text")))).alias("term"))
    words = docs.select("id", pieces_of(F.coalesce("text", F.lit(""))).alias("w"))
    sized = words.select("id", F.size("w").alias("len"))
    totals = sized.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"))
    asked = terms.select("term").dropDuplicates()
    tf = words.select("id", F.size("w").alias("len"), F.explode("w").alias("term")).join(asked, "term", "left_semi").groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    one = totals.first()  # two numbers
    idf = F.log(1 + (F.lit(one["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(one["mean_len"])))
    scored = terms.join(tf.join(df, "term").select("id", "term", weight.alias("w")), "term").groupBy("query", "id").agg(F.sum("w").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= top).select("query", "place", "id", F.round("score", 4).alias("score"))


def winnow(files: DataFrame, globs: list[str], declared: DataFrame, skip_generated: bool = True) -> DataFrame:
    """Paths, each with why it is dropped (generated, globbed, declared) or null where it stays. declared: path, attribute, value
    as a repository's attributes state them."""
    says = ((F.col("attribute") == "linguist-generated") & F.col("value").isin("set", "true")) | ((F.col("attribute") == "diff") & (F.col("value") == "unset"))
    marked = declared.where(says).select("path").dropDuplicates().withColumn("said", F.lit(True))
    skip = F.lit(skip_generated)
    path = F.col("path")
    why = F.when(skip & text.is_generated(path), "generated").when(~text.selected(path, globs), "globbed").when(skip & F.col("said"), "declared")
    return files.join(marked, "path", "left").withColumn("dropped", why).drop("said")


def tally(winnowed: DataFrame) -> DataFrame:
    """Paths seen, and dropped for each reason."""
    of = lambda r: F.count_if(F.col("dropped") == r).alias(r)
    return winnowed.agg(F.count("*").alias("seen"), of("generated"), of("globbed"), of("declared"))
