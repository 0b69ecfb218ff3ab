"""Scores and their evaluation: logistic inference with contributions, policy, ranking metrics, samples, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.graph import cut

from driftlens.operators.report import ranked


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic(rows: DataFrame, vector: str, weights: list[float], bias: float) -> DataFrame:
    """p: the logistic model's probability for a vector column."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    dot = F.aggregate(F.zip_with(F.col(vector), w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, x: t + x)
    return rows.withColumn("p", sigmoid(dot + bias))


def top_contributions(rows: DataFrame, key: list[str], vector: str, weights: list[float], most: int = 3) -> DataFrame:
    """The positions of largest absolute contribution, ties in the order of positions."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    x = rows.select(*key, F.posexplode(F.zip_with(F.col(vector), w, lambda a, b: F.round(a.cast("double") * b, 6))).alias("feature", "value"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.abs("value")), "feature"))
    return x.withColumn("place", place).where(F.col("place") <= most).select(*key, "place", "feature", "value")


def policy(p: Column, noise: Column, hide: float = 0.9, unhide: float = 0.2) -> Column:
    """What the model changes: unhid a noise hunk, hid another, or nothing."""
    return F.when(noise & (p < unhide), "unhid").when(~noise & (p >= hide), "hid")


def auc(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half. rows: score, label 0/1.

    Distinct scores are dealt in ranges; a range is ranked by itself and starts after the counts of the ranges before it.
    """
    by = by or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    dealt = cut(each.repartitionByRange(parts, *by, "score").withColumn("_part", F.spark_partition_id()))
    until = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges_ = dealt.groupBy(*by, "_part").agg(F.sum("n").alias("n"))  # a number for each range and group
    starts = ranges_.select(*by, "_part", until(Window.partitionBy(*by).orderBy("_part")).alias("start"))
    ranked = dealt.withColumn("inside", until(Window.partitionBy(*by, "_part").orderBy("score"))).join(starts.hint("broadcast") if not by else starts, [*by, "_part"])
    ranked = ranked.withColumn("mid", F.col("start") + F.col("inside") + (F.col("n") + 1) / 2)
    got = ranked.groupBy(*by).agg(F.sum(F.col("mid") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"))
    return got.select(*by, F.round((F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0)), 6).alias("auc"))


def calibration(rows: DataFrame) -> DataFrame:
    """Brier score, and errors at thresholds 0.1 to 0.9, in one pass over the rows."""
    at = lambda k: F.lit(k) / 10
    sums = [F.count_if((F.col("score") >= at(k)) & (F.col("label") == 0)).alias(f"h{k}") for k in range(1, 10)]
    sums += [F.count_if((F.col("score") < at(k)) & (F.col("label") == 1)).alias(f"m{k}") for k in range(1, 10)]
    one = rows.agg(*sums, F.round(F.avg(F.pow(F.col("score") - F.col("label"), 2)), 6).alias("brier"))
    each = F.array(*[F.struct(at(k).alias("threshold"), F.col(f"h{k}").alias("wrong_hides"), F.col(f"m{k}").alias("missed")) for k in range(1, 10)])
    return one.select(F.explode(each).alias("x"), "brier").where("brier is not null").select("x.threshold", "x.wrong_hides", "x.missed", "brier")


def rates(rows: DataFrame, cuts: list[str], value: str) -> DataFrame:
    """Count and rate of a 0/1 value over all rows and by each cut, in one pass."""
    sets = ", ".join(f"({c})" for c in cuts)
    view = rows.select(*cuts, F.col(value).alias("value"))
    labels = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in cuts)
    picked = ", ".join(f"CAST({c} AS STRING)" for c in cuts)
    return rows.sparkSession.sql(
        f"SELECT CASE {labels} ELSE 'all' END AS cut, coalesce({picked}, '') AS part, count(*) AS n, round(avg(value), 6) AS rate FROM {{view}} GROUP BY GROUPING SETS ({sets}, ())", view=view
    )


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Quadratic-weighted agreement of two integer ratings."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.pow(F.col("a") - F.col("b"), 2)).alias("seen"))
    chance = left.crossJoin(right).agg(F.sum(F.col("na") * F.col("nb") * F.pow(F.col("a") - F.col("b"), 2)).alias("chance"))  # of the few ratings
    return total.crossJoin(chance).select(F.round(1 - F.col("seen") * F.col("total") / F.nullif(F.col("chance"), F.lit(0.0)), 6).alias("kappa"))


def percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Nearest ranks as floor(n * p) of the sorted values: p50, p90, p99 and the largest."""
    w = Window.partitionBy(*by)
    x = rows.withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    at = lambda p: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col(value)))
    return x.groupBy(*by).agg(F.count("*").alias("n_rows"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max(value).alias("most"))


def pairwise(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of pairs of one key with different labels that the score orders as the label does, ties half.

    Pairs are counted from scores and labels: per key and score the rows of each label, and running sums.
    """
    each = rows.groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    under = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = each.withColumn("won", F.col("pos") * (under + F.col("neg") / 2))
    got = x.groupBy(*by).agg(F.sum("won").alias("won"), (F.sum("pos") * F.sum("neg")).alias("pairs")).where("pairs > 0")
    return got.select(*by, F.col("pairs").cast("long").alias("pairs"), F.round(F.col("won") / F.col("pairs"), 6).alias("accuracy"))


def tertiles(rows: DataFrame) -> DataFrame:
    """Label rate in each third of the scores; the first thirds take what does not divide."""
    x = ranked(rows, ["score", "key"])
    n = rows.count()
    size, more = n // 3, n % 3
    edges = [size + (more > 0), 2 * size + (more > 0) + (more > 1)]
    third = F.when(F.col("rank") < edges[0], 1).when(F.col("rank") < edges[1], 2).otherwise(3)
    return x.groupBy(third.alias("third")).agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("rate"))


def stratified(rows: DataFrame, stratum: str, order: list[Column], quota: int) -> DataFrame:
    """The first ``quota`` rows of each stratum and the weight each stands for."""
    by = Window.partitionBy(stratum)
    x = rows.withColumn("place", F.row_number().over(by.orderBy(*order))).withColumn("n", F.count("*").over(by)).where(F.col("place") <= quota)
    return x.select("key", stratum, F.round(F.col("n") / F.least(F.col("n"), F.lit(quota)), 6).alias("weight"))


def tree_value(tree: dict) -> Column:
    """A decision tree compiled to nested conditions. A node has feature, threshold, left and right, a leaf has value; a row
    goes left if its feature as a 32-bit float is at most the threshold."""
    if "value" in tree:
        return F.lit(float(tree["value"]))
    low = F.col(tree["feature"]).cast("float") <= F.lit(float(tree["threshold"])).cast("float")
    return F.when(low, tree_value(tree["left"])).otherwise(tree_value(tree["right"]))


def ensemble(rows: DataFrame, trees: list[dict], bias: float = 0.0) -> DataFrame:
    """p: the sigmoid of all trees' values in double precision."""
    total = F.lit(float(bias))
    for t in trees:
        total = total + tree_value(t)
    return rows.withColumn("p", sigmoid(total))
