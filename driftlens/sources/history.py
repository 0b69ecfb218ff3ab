"""Exported version-control text as tables: commit logs with renames followed, blame lines as waves, status lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log(texts: DataFrame) -> DataFrame:
    """(review, commit, time, subject, status, path, old_path) of logs (review, text): records that start with U+001E, a line
    ``seconds TAB subject``, then a line ``status TAB path [TAB new path]`` for each file. commit counts from the newest."""
    record = texts.select("review", F.posexplode(F.filter(F.split("text", "\x1e"), lambda r: r != "")).alias("commit", "record"))
    head = F.split(F.substring_index("record", "\n", 1), "\t", 2)
    lines = F.filter(F.slice(F.split("record", "\n"), 2, 1 << 30), lambda x: x.contains("\t"))
    x = record.select("review", F.col("commit").cast("long").alias("commit"), F.get(head, F.lit(0)).try_cast("long").alias("time"), F.get(head, F.lit(1)).alias("subject"), F.explode(lines).alias("line"))
    part = F.split("line", "\t")
    moved = F.size(part) > 2
    return x.where("time is not null").select("review", "commit", "time", "subject", F.substring("line", 1, 1).alias("status"), F.when(moved, part[2]).otherwise(part[1]).alias("path"), F.when(moved, part[1]).alias("old_path"))


def followed(changes: DataFrame) -> DataFrame:
    """The same rows with ``current``: the name that a path has after all later renames. One ordered pass for each review."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["commit", "path"], kind="stable")
        now: dict[str, str] = {}
        out = []
        for _, rows in pdf.groupby("commit", sort=True):
            out += [now.get(p, p) for p in rows["path"]]
            for p, old in zip(rows["path"], rows["old_path"], strict=True):
                if isinstance(old, str):
                    now[old] = now.get(p, p)
        return pdf.assign(current=out)

    return changes.groupBy("review").applyInPandas(run, changes.schema.simpleString()[7:-1] + ",current:string")


def within(changes: DataFrame, at: str, days: int = 90, cap: int = 50) -> DataFrame:
    """Per review and current name the commits and fixes of the last days before the column ``at`` (seconds), each capped.

    A commit that lists a path twice counts twice; commits after ``at`` count too, as there is no upper bound."""
    fix = F.lower("subject").rlike("(^|[^a-z0-9_])(fix|bug|regress|revert)")
    recent = changes.where(F.col("time") >= F.col(at) - days * 86400)
    return recent.groupBy("review", "current").agg(F.least(F.count("*"), F.lit(cap)).alias("churn"), F.least(F.count_if(fix), F.lit(cap)).alias("fixes"))


def line_waves(blame: DataFrame, waves: DataFrame) -> DataFrame:
    """(path, side, line, wave): blamed lines (path, side, line, sha) with the number of the wave (sha, wave) that wrote them."""
    return blame.join(waves, "sha").select("path", "side", "line", "wave")


def status(texts: DataFrame) -> DataFrame:
    """(review, state, path) of NUL-separated status lists: two letters, a space, the path; a rename's source follows and is skipped."""
    x = texts.select("review", F.posexplode(F.split("text", "\x00")).alias("place", "entry"))
    ahead = F.lag("entry").over(Window.partitionBy("review").orderBy("place"))
    kept = x.withColumn("source", F.coalesce(F.substring(ahead, 1, 1).isin("R", "C") & (F.substring(ahead, 3, 1) == " "), F.lit(False))).where("not source and length(entry) > 3")
    return kept.select("review", F.trim(F.substring("entry", 1, 2)).alias("state"), F.substring("entry", 4, 1 << 30).alias("path"))
