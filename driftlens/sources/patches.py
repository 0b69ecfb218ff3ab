"""Unified diffs, SARIF and lcov as tables, and hunks and findings as text: all in built-in functions but for patch apply."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def split_patch(patches: DataFrame) -> DataFrame:
    """(id, file, path, diff): a patch of many files cut at its ``diff --git`` lines; the path is the new name, else the old one."""
    part = patches.select("id", F.posexplode(F.filter(F.split("patch", r"(?m)^(?=diff --git )"), lambda x: x.startswith("diff --git "))).alias("file", "diff"))
    name = lambda sign: F.regexp_extract("diff", rf"(?m)^{sign} (?:[ab]/)?([^\t\n]+)", 1)
    new, old = name(r"\+\+\+"), name("---")
    return part.select("id", "file", F.when((new != "") & (new != "/dev/null"), new).otherwise(old).alias("path"), "diff")


def hunk_headers(diffs: DataFrame) -> DataFrame:
    """(id, file, hunk, o0, o1, n0, n1) from the @@ lines; a count is 1 unless given; a start of 0 only with a count of 0."""
    line = diffs.select("id", "file", F.posexplode(F.split("diff", "\n", -1)).alias("place", "line")).where(F.col("line").rlike(HEADER))
    number = lambda k: F.try_to_number(F.regexp_extract("line", HEADER, k), F.lit("9999999999")).cast("long")
    count = lambda k: F.when(F.regexp_extract("line", HEADER, k) == "", F.lit(1).cast("long")).otherwise(number(k))
    x = line.select("id", "file", "place", number(1).alias("os"), count(2).alias("oc"), number(3).alias("ns"), count(4).alias("nc"))
    x = x.where("(os > 0 or oc = 0) and (ns > 0 or nc = 0)")
    start = lambda s, c: F.when(F.col(c) == 0, F.col(s) + 1).otherwise(F.col(s))
    x = x.withColumn("hunk", F.row_number().over(Window.partitionBy("id", "file").orderBy("place")).cast("long") - 1)
    return x.select("id", "file", "hunk", start("os", "oc").alias("o0"), (start("os", "oc") + F.col("oc") - 1).alias("o1"), start("ns", "nc").alias("n0"), (start("ns", "nc") + F.col("nc") - 1).alias("n1"))


def applied(old: str | None, diff: str) -> str | None:
    """The new text, or nothing if a context or deleted line does not stand where the diff says."""
    source = (old or "").split("\n")
    out, at = [], 0
    body = None
    for line in diff.split("\n"):
        m = re.match(HEADER, line)
        if m:
            start = int(m[1]) - (0 if m[2] == "0" else 1)
            if start < at or start > len(source):
                return None
            out += source[at:start]
            at, body = start, True
        elif body and line[:1] in (" ", "-"):
            if at >= len(source) or source[at] != line[1:]:
                return None
            if line[0] == " ":
                out.append(line[1:])
            at += 1
        elif body and line[:1] == "+":
            out.append(line[1:])
    return "\n".join(out + source[at:])


@F.pandas_udf(T.StringType())
def apply(old: pd.Series, diff: pd.Series) -> pd.Series:
    return pd.Series([applied(o, d) for o, d in zip(old, diff, strict=True)])


def sides(changes: DataFrame) -> DataFrame:
    """New texts recovered where they are missing: old and diff applied, else the added lines of a new file; problems say what failed."""
    added = F.array_join(F.transform(F.filter(F.split("diff", "\n", -1), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substring(x, 2, 1 << 30)), "\n")
    built = F.when(F.col("new").isNotNull(), F.col("new")).when(F.col("old").isNotNull() & F.col("diff").isNotNull(), apply("old", "diff")).when(F.col("diff").contains("--- /dev/null"), added)
    x = changes.withColumn("new_text", built)
    return x.withColumn("problem", F.when(F.col("new_text").isNull() & F.col("diff").isNotNull(), "the diff does not apply"))


SARIF = "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"


def sarif(documents: DataFrame) -> DataFrame:
    """(tool, rule, level, message, path, line) of SARIF documents in a column json; without a message a result is left out."""
    run = documents.select(F.explode(F.from_json("json", SARIF)["runs"]).alias("run"))
    found = run.select(F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r")).select("tool", "r", F.explode("r.locations").alias("at"))
    level = F.when(F.col("r.level").isin("error", "warning"), "warn").otherwise("note")
    path = F.regexp_replace(F.regexp_replace(F.col("at.physicalLocation.artifactLocation.uri"), "^file://", ""), r"^\./", "")
    return found.where("r.message.text is not null").select("tool", F.col("r.ruleId").alias("rule"), level.alias("level"), F.col("r.message.text").alias("message"), path.alias("path"), F.col("at.physicalLocation.region.startLine").alias("line"))


def to_sarif(findings: DataFrame, tool: str) -> DataFrame:
    """One SARIF document of findings (id, rule, level, message, path, lo, hi); rules in the order in which they first come up."""
    region = F.struct(F.col("lo").alias("startLine"), F.col("hi").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct("id", F.struct(F.col("rule").alias("ruleId"), F.when(F.col("level") == "note", "note").otherwise("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")).alias("r"))
    rules = findings.groupBy("rule").agg(F.min("id").alias("first")).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "rule"))), lambda x: F.struct(x["rule"].alias("id"))).alias("rules"))
    results = findings.agg(F.transform(F.array_sort(F.collect_list(result)), lambda x: x["r"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return rules.crossJoin(results).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("json"))


def lcov(lines: DataFrame) -> DataFrame:
    """(path, line, hits) of tracefile lines (trace, place, value): the file is the last SF line before; repeated lines keep the most hits."""
    file = F.when(F.col("value").startswith("SF:"), F.substring("value", 4, 1 << 30)).when(F.col("value") == "end_of_record", "")
    x = lines.withColumn("path", F.last(file, ignorenulls=True).over(Window.partitionBy("trace").orderBy("place"))).where(F.col("value").startswith("DA:") & (F.col("path") != ""))
    part = F.split(F.substring("value", 4, 1 << 30), ",")
    hit = x.select("path", F.get(part, F.lit(0)).try_cast("int").alias("line"), F.get(part, F.lit(1)).try_cast("long").alias("hits"))
    return hit.where("line is not null and hits is not null").groupBy("path", "line").agg(F.max("hits").alias("hits"))


def json_rows(rows: DataFrame, key: Column) -> DataFrame:
    """Rows as JSON without what is null or empty."""
    return rows.select(key.alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("json"))
