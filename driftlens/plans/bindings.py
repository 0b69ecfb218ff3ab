"""The driver's tables read as review tables: the same portable SQL makes the input of a query and of its oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> SQL over the tables and earlier bindings.
BINDINGS: dict[str, str] = {}

# Lines of an order are the hunks of a review; rows count within a file, both sides, with gaps of unchanged lines.
BINDINGS["hunks"] = """
SELECT review, file, hunk, CAST(n0 AS BIGINT) AS n0, CAST(n0 + added - 1 AS BIGINT) AS n1, CAST(o0 AS BIGINT) AS o0, CAST(o0 + removed - 1 AS BIGINT) AS o1,
       added, removed, noise, symbol, scope, priority
FROM (
  SELECT *, 1 + (sum(gap + added) OVER w) - added AS n0, 1 + (sum(gap + removed) OVER w) - removed AS o0
  FROM (
    SELECT l_orderkey AS review, l_partkey % 2 AS file,
           CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS hunk,
           CAST(floor(l_quantity) AS BIGINT) % 6 AS added, l_suppkey % 4 AS removed, CAST(floor(l_extendedprice) AS BIGINT) % 15 AS gap,
           l_returnflag = 'R' AS noise, l_partkey AS symbol, l_suppkey % 3 AS scope, CAST(l_linenumber AS BIGINT) % 3 AS priority
    FROM lineitem
  ) x
  WINDOW w AS (PARTITION BY review, file ORDER BY hunk)
) y
"""

# Facts of a file: names at rows, as definitions, imports, uses or member accesses.
BINDINGS["facts"] = """
SELECT l_orderkey AS review, l_suppkey % 2 AS file, 1 + (l_suppkey * 7 + l_linenumber * 3) % 60 AS row_no,
       concat('n', CAST(l_partkey % 40 AS VARCHAR(20))) AS name,
       CASE l_linenumber % 4 WHEN 0 THEN 'def' WHEN 1 THEN 'import' WHEN 2 THEN 'use' ELSE 'member' END AS kind
FROM lineitem
"""

# Definition spans with their figures.
BINDINGS["spans"] = """
SELECT l_orderkey AS review, l_partkey % 2 AS file, concat('d', CAST(l_suppkey % 30 AS VARCHAR(20))) AS name,
       1 + l_partkey % 40 AS lo, 1 + l_partkey % 40 + CAST(floor(l_quantity) AS BIGINT) * 2 AS hi, l_suppkey % 9 AS params, CAST(l_linenumber AS BIGINT) % 6 AS depth
FROM lineitem
"""

# Definitions before and after a change, a file being a supplier.
BINDINGS["old_defs"] = """
SELECT DISTINCT l_suppkey AS file, l_partkey AS name, l_linenumber % 2 AS header, concat('b', CAST(l_partkey % 17 AS VARCHAR(20)), l_returnflag) AS body
FROM lineitem WHERE l_linestatus = 'O'
"""
BINDINGS["new_defs"] = """
SELECT DISTINCT l_suppkey AS file, l_partkey AS name, l_linenumber % 2 AS header, concat('b', CAST(l_partkey % 17 AS VARCHAR(20)), l_returnflag) AS body
FROM lineitem WHERE l_linestatus <> 'O'
"""

# Groups define the part of their first line and use the others.
BINDINGS["defines"] = "SELECT DISTINCT l_orderkey AS grp, l_suppkey % 5 AS file, l_partkey AS symbol FROM lineitem WHERE l_linenumber = 1"
BINDINGS["uses"] = "SELECT DISTINCT l_orderkey AS grp, l_suppkey % 5 AS file, l_partkey AS symbol FROM lineitem WHERE l_linenumber <> 1"

# Edges that go up in number: an order to later ones that use what it alone defines.
BINDINGS["dag"] = """
SELECT DISTINCT d.grp AS src, u.grp AS dst
FROM (SELECT symbol, min(grp) AS grp FROM defines GROUP BY symbol HAVING count(*) = 1) d JOIN uses u ON d.symbol = u.symbol
WHERE d.grp < u.grp
"""

BINDINGS["history"] = """
SELECT o_orderkey AS sha, o_orderdate AS at_time, o_orderpriority AS subject, l_partkey AS path
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
"""

BINDINGS["scored"] = """
SELECT d.doc_id AS key, d.lang AS stratum, d.source AS repo, l.quality AS label, l.toxic AS other,
       CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

NEEDS = {"dag": ("defines", "uses")}


def parts(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in (*NEEDS.get(n, ()), n) if x not in out]
    return out


def with_sql(*names: str) -> str:
    """A WITH clause that defines the bindings."""
    return "WITH " + ", ".join(f"{n} AS ({BINDINGS[n]})" for n in parts(names))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a binding made of tables, without leaving views behind."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in BINDINGS[name] or any(t in BINDINGS[n] for n in NEEDS.get(name, ()))}
    sql = BINDINGS[name]
    for n in NEEDS.get(name, ()):
        frames[n] = load(spark, sf_dir, n)
    sql = re.sub(r"\b(" + "|".join(frames) + r")\b(?=\s|$|\))", lambda m: "{" + m[1] + "}", sql)
    return spark.sql(sql, **frames)
