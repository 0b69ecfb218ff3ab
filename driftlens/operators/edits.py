"""Edits that recur, features of hunks and trained heads.

``same_edits`` joins hunks that make an equal change: an equal token swap, or equal changed lines of eight letters or digits or
more. Sets are connected components of the bipartite graph of hunks and edits, so three hunks that share edits in
pairs are one set; it counts only if it spans two homes.
"""

from __future__ import annotations

import hashlib

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.operators.graph import components

#: Words of templates, extents and categories that become columns, in this order.
CATEGORIES = ("import", "definition", "other")
EXTENTS = ("whitespace", "formatting", "edited", "rewritten", "added", "removed")
PLAIN = ("noise", "comment", "test_path", "lines_added", "lines_removed", "defines", "uses", "edges_out", "edges_in", "has_history", "churn", "fixes")


def same_edits(hunks: DataFrame, least: int = 8) -> DataFrame:
    """(node, cluster) for hunks (node, home, edit) that share an edit over two homes or more. edit: text of the change.

    A set is the star of an edit's hunks, joined where hunks have several edits; an edit's hunks are linked to its first
    only, so a frequent edit gives as many links as it has hunks."""
    big = hunks.where(F.length(F.regexp_replace("edit", "[^A-Za-z0-9]", "")) >= least)
    first = big.groupBy("edit").agg(F.min("node").alias("first"), F.count_distinct("home").alias("homes")).where("homes >= 2")
    return components(big.join(first, "edit").where("node <> first").select(F.col("first").alias("src"), F.col("node").alias("dst")).dropDuplicates())


def joined_groups(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Groups (grp, node) renumbered: those that hold hunks of one set get the least group of the set."""
    met = groups.join(sets, "node", "left")
    least = met.where("cluster is not null").groupBy("cluster").agg(F.min("grp").alias("least"))
    return met.join(least, "cluster", "left").select("node", F.coalesce("least", "grp").alias("grp"))


def columns() -> list[str]:
    """The features in their order."""
    return [*PLAIN, *[f"category_{c}" for c in CATEGORIES], *[f"extent_{e}" for e in (*EXTENTS, "none")], "rationale_words", "rationale_clauses", "rationale_commas", "rationale_more"]


def schema_hash(names: list[str], version: int = 1) -> str:
    """FNV-1a of the version and the names, as 16 hex digits: it moves if a column does."""
    h = 14695981039346656037
    for b in (f"v{version}\n" + "\n".join(names)).encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return f"{h:016x}"


def features(hunks: DataFrame) -> DataFrame:
    """One wide projection of hunks that have the plain columns, category, extent and rationale; all doubles."""
    hot = lambda c, values, name: [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{name}_{v}") for v in values]
    count = lambda p: F.regexp_count(F.coalesce("rationale", F.lit("")), F.lit(p)).cast("double")
    return hunks.select(
        "node",
        *[F.col(c).cast("double").alias(c) for c in PLAIN],
        *hot("category", CATEGORIES, "category"),
        *hot("extent", EXTENTS, "extent"),
        F.col("extent").isNull().cast("double").alias("extent_none"),
        count(r"\S+").alias("rationale_words"),
        (count(";") + 1).alias("rationale_clauses"),
        count(",").alias("rationale_commas"),
        count(r"and \d+ more").alias("rationale_more"),
    )


def fingerprint(rows: list[tuple], digits: int = 4) -> str:
    """A hash of a few reference rows' values, to notice when values drift while names stay."""
    return hashlib.sha256("\n".join(",".join(f"{x:.{digits}f}" for x in r) for r in rows).encode()).hexdigest()[:16]


def fit_head(rows: DataFrame, names: list[str], label: str = "label", weight: str | None = None):
    """A logistic head over named features, trained by Spark ML; returns (weights, bias) in the features' own units."""
    assembled = VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="keep").transform(rows)
    head = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01, maxIter=50, standardization=True, **({"weightCol": weight} if weight else {}))
    model = head.fit(assembled)
    return list(model.coefficients), float(model.intercept)


def later_fix(hunks: DataFrame, fixes: DataFrame, days: int) -> DataFrame:
    """Whether lines that a hunk (path, lo, hi, at) wrote are deleted by a fix (path, line, fixed_at) within so many days."""
    window = F.expr(f"INTERVAL {days} DAYS")
    met = hunks.join(fixes, "path").where((F.col("fixed_at") > F.col("at")) & (F.col("fixed_at") <= F.col("at") + window) & F.col("line").between(F.col("lo"), F.col("hi")))
    blamed = met.select("node").dropDuplicates().withColumn("later_fix", F.lit(True))
    return hunks.join(blamed, "node", "left").select("node", F.coalesce("later_fix", F.lit(False)).alias("later_fix"))
