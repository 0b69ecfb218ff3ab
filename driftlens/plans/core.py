"""Registered queries of the relational operators, each bound to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import graph, model, ranges, report, symbols
from driftlens.plans.bindings import load, with_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, needs: tuple[str, ...], sql: str | None = None):
    """Registers a function of the loaded inputs as a query; sql follows the inputs' WITH clause."""

    def keep(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[load(spark, sf_dir, n) for n in needs])

        query.__name__ = name
        QUERIES[name] = query
        if sql is not None:
            from driftlens.plans.bindings import BINDINGS

            bound = [n for n in needs if n in BINDINGS]
            head = with_sql(*bound) if bound else ""
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE"):
                ORACLE_SQL[name] = (head.replace("WITH ", "WITH RECURSIVE ", 1) + ", " if head else "WITH RECURSIVE ") + body[len("WITH RECURSIVE") :].strip()
            elif body.upper().startswith("WITH "):
                ORACLE_SQL[name] = (head + ", " if head else "WITH ") + body[5:]
            else:
                ORACLE_SQL[name] = f"{head} {body}"
        return f

    return keep


# The flagship: definitions before uses, over the acyclic def-use binding.


@register("reading_order", ("defines", "uses"))
def _(defines, uses):
    edges = symbols.edges(defines, uses)
    half = lambda c: F.floor(F.col(c) / 1000).cast("long")
    nodes = defines.unionByName(uses).groupBy("grp").agg(F.min("file").alias("file"))
    nodes = nodes.select(half("grp").alias("review"), F.col("grp").alias("node"), (F.col("grp") % 3).alias("priority"), F.col("file").cast("long").alias("file"), F.col("grp").alias("row_no"))
    inside = edges.select(half("src").alias("review"), "src", "dst").where(half("src") == half("dst"))
    return graph.reading_order(nodes, inside)


# Interval joins.

COVER = "f.review = h.review AND f.file = h.file AND f.row_no BETWEEN h.n0 AND h.n1"


@register("hunk_category", ("hunks", "facts"), f"""
SELECT h.review, h.file, h.hunk, CASE WHEN max(CASE WHEN f.kind = 'def' THEN 1 ELSE 0 END) = 1 THEN 'definition'
       WHEN max(CASE WHEN f.kind = 'import' THEN 1 ELSE 0 END) = 1 THEN 'import' ELSE 'other' END AS category
FROM hunks h LEFT JOIN facts f ON {COVER} GROUP BY ALL""")
def _(hunks, facts):
    return ranges.category(hunks, facts)


@register("innermost_container", ("hunks", "spans"), """
SELECT h.review, h.file, h.hunk, first(s.name ORDER BY s.hi - s.lo, s.lo, s.name) AS enclosing
FROM hunks h LEFT JOIN spans s ON s.review = h.review AND s.file = h.file AND h.n0 BETWEEN s.lo AND s.hi GROUP BY ALL""")
def _(hunks, spans):
    return ranges.innermost(hunks, spans)


@register("hunk_symbols", ("hunks", "facts"), f"""
WITH x AS (SELECT h.review, h.file, h.hunk,
  list_distinct(list(f.name) FILTER (f.kind = 'def')) AS d, list_distinct(list(f.name) FILTER (f.kind = 'import')) AS i,
  list_distinct(list(f.name) FILTER (f.kind IN ('use', 'member'))) AS u FROM hunks h JOIN facts f ON {COVER} GROUP BY ALL),
y AS (SELECT review, file, hunk, coalesce(d, []) AS d, coalesce(i, []) AS i, coalesce(u, []) AS u FROM x)
SELECT review, file, hunk, array_to_string(list_sort(list_filter(d, lambda z: NOT list_contains(i, z))), ',') AS declared,
       array_to_string(list_sort(i), ',') AS imports,
       array_to_string(list_sort(list_filter(u, lambda z: NOT list_contains(i, z) AND NOT list_contains(d, z))), ',') AS uses FROM y""")
def _(hunks, facts):
    return ranges.symbols(hunks, facts)


@register("member_only_uses", ("hunks", "facts"), f"""
WITH x AS (SELECT h.review, h.file, h.hunk, f.name FROM hunks h JOIN facts f ON {COVER} WHERE f.kind IN ('use', 'member')
GROUP BY ALL HAVING count(*) = count(*) FILTER (f.kind = 'member'))
SELECT review, file, hunk, string_agg(name, ',' ORDER BY name) AS member_uses FROM x GROUP BY ALL""")
def _(hunks, facts):
    return ranges.member_only(hunks, facts)


@register("structural_smells", ("hunks", "spans"), """
WITH x AS (SELECT h.review, h.file, h.hunk, max(s.hi - s.lo + 1) AS l, max(s.depth) AS d, max(s.params) AS p
FROM hunks h JOIN spans s ON s.review = h.review AND s.file = h.file AND s.lo BETWEEN h.n0 AND h.n1 GROUP BY ALL)
SELECT review, file, hunk, concat_ws('; ', CASE WHEN l >= 60 THEN 'large: ' || l END, CASE WHEN d >= 4 THEN 'deep: ' || d END, CASE WHEN p >= 6 THEN 'params: ' || p END) AS notes
FROM x WHERE l >= 60 OR d >= 4 OR p >= 6""")
def _(hunks, spans):
    return ranges.smells(hunks, spans)


@register("advisories", ("hunks", "facts"), f"SELECT DISTINCT h.review, h.file, h.hunk, f.name, f.kind FROM hunks h JOIN facts f ON {COVER}")
def _(hunks, facts):
    return ranges.advisories(hunks, facts)


@register("place_findings", ("hunks", "facts"), f"""
SELECT f.review, f.file, f.row_no, f.name, f.kind, min(h.hunk) AS hunk FROM facts f LEFT JOIN hunks h ON {COVER} GROUP BY ALL""")
def _(hunks, facts):
    return ranges.place_findings(facts, hunks)


@register("hunk_coverage", ("hunks", "facts"), f"""
SELECT h.review, h.file, h.hunk, count(*) FILTER (f.kind <> 'use') AS executed, count(*) AS executable FROM hunks h JOIN facts f ON {COVER} GROUP BY ALL""")
def _(hunks, facts):
    return ranges.place_coverage(facts.withColumn("hits", (F.col("kind") != "use").cast("int")), hunks)


@register("hunk_wave", ("hunks", "facts"), f"""
WITH n AS (SELECT h.review, h.file, h.hunk, max(CAST(substr(f.name, 2) AS INTEGER)) AS w FROM hunks h JOIN facts f ON {COVER} GROUP BY ALL),
o AS (SELECT h.review, h.file, h.hunk, max(CAST(substr(f.name, 2) AS INTEGER)) AS w FROM hunks h JOIN facts f ON {COVER.replace('n0', 'o0').replace('n1', 'o1')} GROUP BY ALL)
SELECT h.review, h.file, h.hunk, coalesce(n.w, o.w) AS wave FROM hunks h LEFT JOIN n USING (review, file, hunk) LEFT JOIN o USING (review, file, hunk)""")
def _(hunks, facts):
    lines = facts.withColumn("wave", F.substring("name", 2, 9).cast("int"))
    return ranges.wave(hunks, lines, lines)


@register("readability_deltas", ("hunks", "spans"), """
WITH s AS (SELECT *, count(*) OVER (PARTITION BY review, file, name) AS c FROM spans),
b AS (SELECT review, file, name, lo, hi, params % 4 AS params_was, params AS params_now, depth % 2 AS depth_was, depth AS depth_now FROM s WHERE c = 1)
SELECT b.review, b.file, b.name, params_was, params_now, depth_was, depth_now, min(h.hunk) AS hunk
FROM b JOIN hunks h ON h.review = b.review AND h.file = b.file AND b.lo <= h.n1 AND b.hi >= h.n0 AND h.n1 >= h.n0
WHERE params_was <> params_now OR depth_was <> depth_now GROUP BY ALL""")
def _(hunks, spans):
    old = spans.withColumns({"params": F.col("params") % 4, "depth": F.col("depth") % 2})
    return ranges.metric_deltas(old, spans, hunks)


@register("removals_in_hunks", ("hunks", "facts"), f"""
SELECT f.review, f.file, f.row_no, f.name, min(h.hunk) AS hunk FROM facts f JOIN hunks h ON {COVER.replace('n0', 'o0').replace('n1', 'o1')} WHERE f.kind = 'def' GROUP BY ALL""")
def _(hunks, facts):
    return ranges.removed_in(facts.where("kind = 'def'"), hunks)


@register("pattern_hunks", ("hunks", "facts"), f"SELECT h.review, h.file, h.hunk FROM hunks h WHERE EXISTS (SELECT 1 FROM facts f WHERE {COVER} AND f.kind = 'member')")
def _(hunks, facts):
    return ranges.matched(hunks, facts.where("kind = 'member'"))


@register("split_insertions", ("hunks", "spans"), """
WITH p AS (SELECT * FROM hunks WHERE o1 < o0 AND n1 - n0 > 3),
s AS (SELECT review, file, hunk, n1, n0 AS start FROM p UNION SELECT p.review, p.file, p.hunk, p.n1, s.lo FROM p JOIN spans s ON s.review = p.review AND s.file = p.file AND s.lo > p.n0 AND s.lo <= p.n1)
SELECT review, file, hunk, start, coalesce(lead(start) OVER (PARTITION BY review, file, hunk ORDER BY start) - 1, n1) AS stop FROM s""")
def _(hunks, spans):
    return ranges.split_insertions(hunks, spans, most=3)


@register("leading_cut", ("hunks", "spans"), """
SELECT h.review, h.file, h.hunk, min(s.lo) AS cut FROM hunks h JOIN spans s ON s.review = h.review AND s.file = h.file AND s.lo > h.n0 AND s.lo <= h.n1 GROUP BY ALL""")
def _(hunks, spans):
    return ranges.leading_cut(hunks, spans)


@register("relocate_comments", ("lineitem",), """
WITH a AS (SELECT l_orderkey AS id, l_suppkey AS file, l_returnflag || l_linestatus || (l_orderkey % 5) AS hash, min(l_partkey) AS start FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
l AS (SELECT l_suppkey AS file, l_partkey + 1 AS row_no, l_returnflag || l_linestatus || (l_orderkey % 5) AS hash FROM lineitem WHERE l_linenumber > 1)
SELECT a.id, a.file, a.start, a.hash, first(l.row_no ORDER BY abs(l.row_no - a.start), l.row_no) AS place FROM a LEFT JOIN l ON l.file = a.file AND l.hash = a.hash GROUP BY ALL""")
def _(lineitem):
    x = lineitem.withColumn("hash", F.concat("l_returnflag", "l_linestatus", (F.col("l_orderkey") % 5).cast("string")))
    first = x.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("file"), "hash").agg(F.min("l_partkey").alias("start"))
    return ranges.relocate(first, x.where("l_linenumber > 1").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") + 1).alias("row_no"), "hash"))


# Symbols of both sides.

DEFS = ("old_defs", "new_defs")
RENAMED = """r0 AS (SELECT DISTINCT o.file, o.name AS before, n.name AS after FROM old_defs o JOIN new_defs n ON o.file = n.file AND o.body = n.body
WHERE NOT EXISTS (SELECT 1 FROM new_defs x WHERE x.file = o.file AND x.name = o.name) AND NOT EXISTS (SELECT 1 FROM old_defs x WHERE x.file = n.file AND x.name = n.name)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY file, before ORDER BY before, after) AS i, row_number() OVER (PARTITION BY file, after ORDER BY before, after) AS j FROM r0),
renamed AS (SELECT file, before, after FROM r1 WHERE i = 1 AND j = 1)"""


def bodies(defs: DataFrame) -> DataFrame:
    """Bodies without the side's own flag, so that both sides can agree."""
    return defs.withColumn("body", F.regexp_extract("body", "^b[0-9]+", 0)).dropDuplicates()


PLAIN = "old_defs AS (SELECT DISTINCT file, name, header, regexp_extract(body, '^b[0-9]+') AS body FROM old0), new_defs AS (SELECT DISTINCT file, name, header, regexp_extract(body, '^b[0-9]+') AS body FROM new0)"


@register("symbol_changes", DEFS, """
WITH o AS (SELECT file, name, min(header) AS h0, min(body) AS b0 FROM old_defs GROUP BY ALL), n AS (SELECT file, name, min(header) AS h1, min(body) AS b1 FROM new_defs GROUP BY ALL)
SELECT coalesce(o.file, n.file) AS file, coalesce(o.name, n.name) AS name,
CASE WHEN b0 IS NULL THEN 'added' WHEN b1 IS NULL THEN 'removed' WHEN h0 <> h1 THEN 'signature' WHEN b0 <> b1 THEN 'body' ELSE 'same' END AS change
FROM o FULL JOIN n ON o.file = n.file AND o.name = n.name""")
def _(old, new):
    return symbols.changes(old, new)


MOVED = """
WITH o AS (SELECT DISTINCT l_suppkey % 50 AS file, l_partkey * 10 + l_linenumber AS name, l_partkey % 7 AS body FROM lineitem WHERE l_linestatus = 'O'),
n AS (SELECT DISTINCT l_suppkey % 50 AS file, l_partkey * 10 + l_linenumber AS name, l_partkey % 7 AS body FROM lineitem WHERE l_linestatus <> 'O'),
g AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.file = o.file AND n.name = o.name)), c AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.file = o.file AND n.name = o.name))
SELECT g.file, g.name, g.body, min(c.file) AS target FROM g JOIN c ON g.name = c.name AND g.body = c.body AND g.file <> c.file GROUP BY ALL HAVING count(DISTINCT c.file) = 1"""


@register("moves", ("lineitem",), MOVED)
def _(lineitem):
    x = lineitem.select((F.col("l_suppkey") % 50).alias("file"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("name"), (F.col("l_partkey") % 7).alias("body"), "l_linestatus", "l_orderkey")
    return symbols.moves(x.where("l_linestatus = 'O'"), x.where("l_linestatus <> 'O'"))


def flat(sql: str) -> str:
    """The old and new definitions with plain bodies, under the names that the SQL uses."""
    return "WITH " + PLAIN.replace("old0", "old_defs").replace("new0", "new_defs").replace("old_defs AS", "od AS").replace("new_defs AS", "nd AS") + ", " + sql.replace("old_defs", "od").replace("new_defs", "nd")


@register("renames", DEFS, flat(RENAMED + " SELECT file, before, after FROM renamed"))
def _(old, new):
    return symbols.rename_candidates(bodies(old), bodies(new))


@register("removals", DEFS, flat(RENAMED + """ SELECT DISTINCT o.file, o.name FROM old_defs o WHERE NOT EXISTS (SELECT 1 FROM new_defs x WHERE x.file = o.file AND x.name = o.name)
AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file = o.file AND r.before = o.name)"""))
def _(old, new):
    return symbols.removals(bodies(old), bodies(new), symbols.rename_candidates(bodies(old), bodies(new)))


@register("incomplete_renames", (*DEFS, "uses"), flat(RENAMED + """ SELECT DISTINCT r.file, r.before AS name FROM renamed r WHERE NOT EXISTS (SELECT 1 FROM new_defs n WHERE n.name = r.before) AND EXISTS (SELECT 1 FROM uses u WHERE u.symbol = r.before)"""))
def _(old, new, uses):
    return symbols.incomplete_renames(symbols.rename_candidates(bodies(old), bodies(new)), new, uses)


@register("note_migration", DEFS, flat(RENAMED + """ SELECT o.file, coalesce(r.after, o.name) AS name, 'note ' || o.name AS note FROM (SELECT DISTINCT file, name FROM old_defs) o LEFT JOIN renamed r ON r.file = o.file AND r.before = o.name"""))
def _(old, new):
    notes = old.select("file", "name").dropDuplicates().withColumn("note", F.concat(F.lit("note "), F.col("name").cast("string")))
    return symbols.migrate(notes, symbols.rename_candidates(bodies(old), bodies(new)))


@register("body_only_edits", DEFS, "SELECT DISTINCT o.file, o.name, o.header FROM old_defs o JOIN new_defs n ON o.file = n.file AND o.name = n.name AND o.header = n.header AND o.body <> n.body")
def _(old, new):
    return symbols.body_only(old, new)


@register("inverted_index", ("uses",), "SELECT symbol, string_agg(CAST(grp AS VARCHAR), ',' ORDER BY grp) AS grps FROM (SELECT DISTINCT symbol, grp FROM uses) GROUP BY symbol")
def _(uses):
    return symbols.invert(uses)


EDGES = """e AS (SELECT s.src, u.grp AS dst, min(u.symbol) AS symbol FROM uses u JOIN (SELECT symbol, min(grp) AS src FROM defines GROUP BY symbol HAVING count(DISTINCT grp) = 1) s ON s.symbol = u.symbol WHERE u.grp <> s.src GROUP BY ALL)"""


@register("def_use_edges", ("defines", "uses"), f"WITH {EDGES} SELECT * FROM e")
def _(defines, uses):
    return symbols.edges(defines, uses)


@register("ledger_fan_in", ("defines", "uses"), "SELECT d.grp, d.symbol, count(DISTINCT CASE WHEN u.grp <> d.grp THEN u.grp END) AS used_by FROM defines d LEFT JOIN uses u ON u.symbol = d.symbol GROUP BY ALL")
def _(defines, uses):
    return symbols.fan_in(defines, uses)


@register("uninitialised_members", DEFS, """
SELECT DISTINCT file, name FROM new_defs n WHERE NOT EXISTS (SELECT 1 FROM new_defs i WHERE i.file = n.file AND i.name = n.name AND i.header = 1) AND NOT EXISTS (SELECT 1 FROM old_defs o WHERE o.file = n.file AND o.name = n.name)""")
def _(old, new):
    return symbols.undefined_members(new.select("file", "name"), new.where("header = 1"), old)


@register("containment_edges", ("defines", "uses"), "SELECT DISTINCT d.grp AS parent, u.grp AS child FROM uses u JOIN defines d ON d.file = u.file AND d.symbol = u.symbol WHERE d.grp <> u.grp")
def _(defines, uses):
    return symbols.containment(defines, uses.withColumnRenamed("symbol", "scope"))


@register("run_comparison", ("orders",), """
WITH o AS (SELECT o_custkey AS key, max(o_orderkey) AS c, max(o_totalprice) AS p FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL), n AS (SELECT o_custkey AS key, max(o_orderkey) AS c, max(o_totalprice) AS p FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL)
SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'New' WHEN n.key IS NULL THEN 'Gone' WHEN o.c <> n.c THEN 'Changed' WHEN o.p <> n.p THEN 'Moved' ELSE 'Same' END AS delta FROM o FULL JOIN n ON o.key = n.key""")
def _(orders):
    snap = lambda x: x.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("content"), F.max("o_totalprice").alias("place"))
    return symbols.compare_runs(snap(orders.where("o_orderstatus <> 'F'")), snap(orders.where("o_orderstatus <> 'O'")))


@register("reload_identity", ("hunks",), "SELECT review, file, hunk, scope, row_number() OVER (PARTITION BY review, file, scope ORDER BY hunk) - 1 AS nth FROM hunks")
def _(hunks):
    return symbols.nth(hunks.select("review", "file", "hunk", "scope"), ["review", "file", "scope"], ["hunk"])


@register("arity_check", ("lineitem",), """
WITH d AS (SELECT l_orderkey AS name, min(l_linenumber % 3) AS required, min(l_linenumber % 3 + 1) AS total FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 HAVING count(DISTINCT l_linenumber % 3) = 1)
SELECT d.name, d.required, d.total, count(*) AS calls FROM lineitem l JOIN d ON d.name = l.l_orderkey WHERE l.l_linestatus <> 'O' AND (l.l_linenumber % 5 < d.required OR l.l_linenumber % 5 > d.total) GROUP BY ALL""")
def _(lineitem):
    d = lineitem.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("name"), (F.col("l_linenumber") % 3).alias("required"), (F.col("l_linenumber") % 3 + 1).alias("total"))
    return symbols.arity(d, lineitem.where("l_linestatus <> 'O'").select(F.col("l_orderkey").alias("name"), (F.col("l_linenumber") % 5).alias("given")))


# Groups, ranks and neighbours.


@register("group_hunks", ("hunks",), """
WITH g AS (SELECT review, file, scope, min(hunk) AS first, count(*) AS members FROM hunks GROUP BY ALL) SELECT review, row_number() OVER (PARTITION BY review ORDER BY file, first) - 1 AS grp, file, scope, first, members FROM g""")
def _(hunks):
    return report.group_hunks(hunks)


@register("cap_repeats", ("facts",), """
WITH x AS (SELECT review, file, kind AS rule, CAST(substr(name, 2) AS INTEGER) AS hunk, row_no, name AS message FROM facts),
y AS (SELECT review % 100 AS review, file, rule, hunk, row_no, min(message) AS message FROM x GROUP BY review % 100, file, rule, hunk, row_no),
z AS (SELECT *, row_number() OVER (PARTITION BY review, file, rule ORDER BY hunk, row_no) AS i, count(*) OVER (PARTITION BY review, file, rule) AS n FROM y)
SELECT review, file, rule, hunk, row_no, message || CASE WHEN i = 3 AND n > 3 THEN ' (and ' || (n - 3) || ' more in this file)' ELSE '' END AS message FROM z WHERE i <= 3""")
def _(facts):
    x = facts.select((F.col("review") % 100).alias("review"), "file", F.col("kind").alias("rule"), F.substring("name", 2, 9).cast("int").alias("hunk"), "row_no", F.col("name").alias("message"))
    return report.cap_repeats(x.groupBy("review", "file", "rule", "hunk", "row_no").agg(F.min("message").alias("message")))


@register("changeset_notes", ("lineitem",), """
WITH f AS (SELECT l_suppkey AS review, l_shipdate AS d, CASE WHEN l_partkey % 40 = 0 THEN 'test' WHEN l_partkey % 3 = 0 THEN 'docs' ELSE 'code' END AS kind, count(*) AS hunks FROM lineitem GROUP BY l_suppkey, l_shipdate, kind)
SELECT review, bool_or(kind = 'code') AND NOT bool_or(kind = 'test') AS untested, count(*) FILTER (hunks >= 2) AS churned FROM f GROUP BY review""")
def _(lineitem):
    kind = F.when(F.col("l_partkey") % 40 == 0, "test").when(F.col("l_partkey") % 3 == 0, "docs").otherwise("code")
    return report.changeset_notes(lineitem.groupBy(F.col("l_suppkey").alias("review"), "l_shipdate", kind.alias("kind")).agg(F.count("*").alias("hunks")), many=2)


@register("file_history", ("history",), """
SELECT path, least(count(*), 50) AS commits, least(count(*) FILTER (regexp_matches(lower(subject), '(^|[^a-z0-9_])(fix|bug|regress|revert|1-urgent)')), 50) AS fixes
FROM history WHERE at_time >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY GROUP BY path""")
def _(history):
    return report.file_history(history, "1998-01-01")


@register("degrees", ("dag",), "SELECT node, CAST(sum(o) AS BIGINT) AS edges_out, CAST(sum(i) AS BIGINT) AS edges_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM dag UNION ALL SELECT dst, 0, 1 FROM dag) x GROUP BY node")
def _(dag):
    return report.degrees(dag)


@register("review_coverage", ("dag", "orders"), """
WITH m AS (SELECT o_orderkey AS node, o_orderdate AS at FROM orders WHERE o_orderstatus <> 'P')
SELECT count(*) AS edges, count(*) FILTER (s.at IS NOT NULL AND d.at IS NOT NULL) AS reviewed, count(*) FILTER (d.at IS NOT NULL AND (s.at IS NULL OR s.at > d.at)) AS out_of_order
FROM dag LEFT JOIN m s ON s.node = dag.src LEFT JOIN m d ON d.node = dag.dst""")
def _(dag, orders):
    return report.coverage(dag, orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("node"), F.col("o_orderdate").alias("at")))


@register("audit", ("events",), "SELECT coalesce(event_type, 'total') AS reason, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def _(events):
    return report.audit(events, "event_type")


@register("hidden_breakdown", ("hunks",), """
SELECT CASE WHEN noise THEN 'noise' WHEN NOT (added > 1) THEN 'size' WHEN NOT (scope <> 2) THEN 'scope' ELSE 'shown' END AS reason, count(*) AS n FROM hunks GROUP BY 1""")
def _(hunks):
    return report.first_failing(hunks, [("noise", ~F.col("noise")), ("size", F.col("added") > 1), ("scope", F.col("scope") != 2)])


@register("view_filter", ("hunks",), "SELECT review, file, hunk FROM hunks WHERE NOT noise AND added > 1 AND scope <> 2")
def _(hunks):
    return hunks.where("not noise and added > 1 and scope <> 2").select("review", "file", "hunk")


@register("top_level", ("facts",), """
SELECT review, file, CASE max(CASE kind WHEN 'def' THEN 2 WHEN 'import' THEN 1 ELSE 0 END) WHEN 2 THEN 'verdict' WHEN 1 THEN 'warn' ELSE 'note' END AS level FROM facts GROUP BY review, file""")
def _(facts):
    return report.top_level(facts.withColumn("level", F.when(F.col("kind") == "def", "verdict").when(F.col("kind") == "import", "warn").otherwise("note")), ["review", "file"])


@register("dismiss_suggestions", ("events",), """
SELECT user_id AS rule, count(DISTINCT event_id) AS dismissed, CASE WHEN max(CASE WHEN event_type = 'view' THEN 'warn' ELSE 'note' END) = 'warn' THEN 'lower to note' ELSE 'disable' END AS advice FROM events WHERE event_type IN ('error', 'view') GROUP BY user_id HAVING count(DISTINCT event_id) >= 3""")
def _(events):
    x = events.where("event_type in ('error', 'view')").select(F.col("user_id").alias("rule"), F.col("event_id").alias("key"), F.when(F.col("event_type") == "view", "warn").otherwise("note").alias("level"))
    return report.suggestions(x)


@register("placements", ("hunks",), """
SELECT review, file, hunk, row_number() OVER (PARTITION BY review ORDER BY file, hunk) - 1 AS id, row_number() OVER (PARTITION BY review, file ORDER BY priority, hunk) - 1 AS order_index FROM hunks""")
def _(hunks):
    return report.placements(hunks, "priority")


@register("near_links", ("hunks",), """
WITH x AS (SELECT review, file, hunk, lag(hunk) OVER w AS a, n0 - lag(n1) OVER w - 1 AS gap FROM hunks WHERE NOT noise WINDOW w AS (PARTITION BY review, file ORDER BY hunk))
SELECT review, file, a, hunk AS b, gap FROM x WHERE gap <= 9""")
def _(hunks):
    return report.near(hunks)


@register("replaced_nearby", ("hunks",), """
WITH x AS (SELECT c.review, c.file, c.hunk, g.hunk AS other, CASE WHEN g.hunk < c.hunk THEN c.o0 - g.o1 - 1 ELSE g.o0 - c.o1 - 1 END AS gap FROM hunks c JOIN hunks g ON c.review = g.review AND c.file = g.file
WHERE c.added = 0 AND c.removed > 0 AND g.added > g.removed AND abs(g.hunk - c.hunk) <= 2 AND 2 * (g.added - g.removed) >= c.removed),
y AS (SELECT review, file, hunk, first(other ORDER BY gap, other) AS other FROM x WHERE gap <= 3 GROUP BY ALL) SELECT *, CASE WHEN other < hunk THEN 'above' ELSE 'below' END AS side FROM y""")
def _(hunks):
    return report.replaced_nearby(hunks)


@register("worst_regressions", ("spans",), """
WITH x AS (SELECT review, name, lo, hi, depth, params, row_number() OVER (PARTITION BY review ORDER BY depth DESC, params DESC, name, lo, hi) AS place, count(*) OVER (PARTITION BY review) AS n FROM spans)
SELECT review, place, name, lo, hi, greatest(n - 3, 0) AS more FROM x WHERE place <= 3""")
def _(spans):
    return report.worst(spans, ["depth", "params"], ["review"], ["name", "lo", "hi"]).withColumn("place", F.col("place").cast("long"))


@register("hunk_runs", ("hunks",), """
WITH x AS (SELECT *, CASE WHEN noise IS DISTINCT FROM lag(noise) OVER w OR hunk = 0 THEN 1 ELSE 0 END AS s FROM hunks WINDOW w AS (PARTITION BY review, file ORDER BY hunk)),
y AS (SELECT *, sum(s) OVER (PARTITION BY review, file ORDER BY hunk) AS run FROM x) SELECT review, file, CAST(run AS BIGINT) AS run, noise, count(*) AS length FROM y GROUP BY ALL""")
def _(hunks):
    return report.runs(hunks, ["review", "file"], ["hunk"], "noise")


@register("strategy_file", ("hunks",), "WITH g AS (SELECT review, file * 10 + scope AS grp, file, min(n0) AS first FROM hunks GROUP BY ALL) SELECT review, grp, row_number() OVER (PARTITION BY review ORDER BY file, first, grp) - 1 AS place FROM g")
def _(hunks):
    return report.strategy_file(hunks.groupBy("review", (F.col("file") * 10 + F.col("scope")).alias("grp"), "file").agg(F.min("n0").alias("first")))


@register("strategy_defs_first", ("hunks",), """
WITH g AS (SELECT review, file * 10 + scope AS grp, file, scope AS joined, min(n0) AS first, min(priority) AS rank FROM hunks GROUP BY ALL), m AS (SELECT *, min(rank) OVER (PARTITION BY review, joined) AS least FROM g)
SELECT review, grp, row_number() OVER (PARTITION BY review ORDER BY least, file, first, grp) - 1 AS place FROM m""")
def _(hunks):
    g = hunks.groupBy("review", (F.col("file") * 10 + F.col("scope")).alias("grp"), "file", F.col("scope").alias("joined")).agg(F.min("n0").alias("first"), F.min("priority").alias("rank"))
    return report.strategy_defs_first(g)


@register("finding_navigation", ("events",), "SELECT user_id, ts, event_id, lead(ts) OVER w AS next_ts, lead(event_id) OVER w AS next_event_id FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(events):
    return report.following(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")


@register("name_lists", ("uses",), """
WITH x AS (SELECT grp, list_sort(list(DISTINCT symbol)) AS v FROM uses GROUP BY grp) SELECT grp, array_to_string(v[1:3], ', ') || CASE WHEN len(v) > 3 THEN ' and ' || (len(v) - 3) || ' more' ELSE '' END AS text FROM x""")
def _(uses):
    return report.name_list(uses, ["grp"], "symbol")


@register("fragment_budget", ("uses",))
def _(uses):
    pieces = F.transform(F.array_sort(F.collect_set("symbol")), lambda s: F.concat(F.lit("uses symbol "), s.cast("string")))
    return uses.groupBy("grp").agg(report.fitted(pieces, 60).alias("text"))


@register("search", ("documents", "benchmark"), r"""
WITH q AS (SELECT DISTINCT item_id AS query, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+'))) AS term FROM benchmark),
w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+')) AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS m FROM w),
t AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM w) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT q.query, t.id, sum(ln(1 + (n.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.l / n.m))) AS score FROM q JOIN t ON t.term = q.term JOIN d ON d.term = t.term CROSS JOIN n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS place FROM s) SELECT query, CAST(place AS INTEGER) AS place, id, round(score, 4) AS score FROM r WHERE place <= 20""")
def _(documents, benchmark):
    return report.bm25(documents.select(F.col("doc_id").alias("id"), "text"), benchmark.select(F.col("item_id").alias("query"), "text"))


# Graphs.


@register("clusters", ("dag",), """
WITH RECURSIVE b AS (SELECT src AS a, dst AS b FROM dag UNION SELECT dst, src FROM dag), r(node, root) AS (SELECT a, a FROM b UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node) SELECT node, min(root) AS cluster FROM r GROUP BY node""")
def _(dag):
    return graph.components(dag)


@register("downstream_closure", ("dag",), "WITH RECURSIVE r(start, node) AS (SELECT src, dst FROM dag UNION SELECT r.start, d.dst FROM r JOIN dag d ON d.src = r.node) SELECT DISTINCT start, node FROM r")
def _(dag):
    return graph.closure(dag, dag.select(F.col("src").alias("start")).dropDuplicates())


@register("upstream_closure", ("dag",), "WITH RECURSIVE r(start, node) AS (SELECT dst, src FROM dag UNION SELECT r.start, d.src FROM r JOIN dag d ON d.dst = r.node) SELECT DISTINCT start, node FROM r")
def _(dag):
    turned = dag.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.closure(turned, turned.select(F.col("src").alias("start")).dropDuplicates())


@register("dependency_levels", ("dag",), "WITH RECURSIVE r(node, level) AS (SELECT src, 0 FROM dag UNION SELECT d.dst, r.level + 1 FROM r JOIN dag d ON d.src = r.node) SELECT node, max(level) AS level FROM r GROUP BY node")
def _(dag):
    return graph.levels(dag)


@register("import_cycles", ("lineitem",))
def _(lineitem):
    e = lineitem.select((F.col("l_suppkey") % 97).alias("src"), (F.col("l_partkey") % 97).alias("dst")).dropDuplicates()
    return graph.import_cycles(e, e.where("src > dst"))


# Scores.


@register("auc", ("scored",), """
WITH s AS (SELECT score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY score), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS mid FROM s)
SELECT round((sum(mid * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))), 6) AS auc FROM r""")
def _(scored):
    return model.auc(scored.select("score", "label"))


@register("calibration", ("scored",), """
SELECT t.i / 10 AS threshold, count(*) FILTER (score >= t.i / 10 AND label = 0) AS wrong_hides, count(*) FILTER (score < t.i / 10 AND label = 1) AS missed, round(avg((score - label) ** 2), 6) AS brier FROM scored, range(1, 10) t(i) GROUP BY t.i""")
def _(scored):
    return model.calibration(scored.select("score", "label"))


@register("judged_rates", ("scored",), """
SELECT CASE WHEN grouping(stratum) = 0 THEN 'stratum' WHEN grouping(repo) = 0 THEN 'repo' ELSE 'all' END AS cut, coalesce(stratum, repo, '') AS part, count(*) AS n, round(avg(label), 6) AS rate FROM scored GROUP BY GROUPING SETS ((stratum), (repo), ())""")
def _(scored):
    return model.rates(scored, ["stratum", "repo"], "label")


@register("agreement", ("scored",), """
WITH c AS (SELECT label AS a, other AS b, count(*) AS n FROM scored GROUP BY ALL), l AS (SELECT a, sum(n) AS na FROM c GROUP BY a), r AS (SELECT b, sum(n) AS nb FROM c GROUP BY b),
t AS (SELECT sum(n) AS total, sum(n * (a - b) ** 2) AS seen FROM c), e AS (SELECT sum(na * nb * (a - b) ** 2) AS chance FROM l, r) SELECT round(1 - seen * total / chance, 6) AS kappa FROM t, e""")
def _(scored):
    return model.kappa(scored, "label", "other")


@register("census", ("documents",), """
WITH x AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, count(*) AS n_rows, max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) THEN n_chars END) AS p50, max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) THEN n_chars END) AS p90,
max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.99) AS BIGINT)) THEN n_chars END) AS p99, max(n_chars) AS most FROM x GROUP BY lang""")
def _(documents):
    return model.percentiles(documents, "n_chars", ["lang"])


@register("pairwise_accuracy", ("scored",), """
SELECT p.repo, count(*) AS pairs, round(avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END), 6) AS accuracy FROM scored p JOIN scored q ON p.repo = q.repo AND p.label = 1 AND q.label = 0 GROUP BY p.repo""")
def _(scored):
    return model.pairwise(scored, ["repo"])


@register("tertiles", ("scored",), "WITH x AS (SELECT label, ntile(3) OVER (ORDER BY score, key) AS third FROM scored) SELECT CAST(third AS INTEGER) AS third, count(*) AS n, round(avg(label), 6) AS rate FROM x GROUP BY 1")
def _(scored):
    return model.tertiles(scored)


@register("stratified_sample", ("scored",), """
WITH x AS (SELECT key, stratum, row_number() OVER (PARTITION BY stratum ORDER BY score, key) AS i, count(*) OVER (PARTITION BY stratum) AS n FROM scored) SELECT key, stratum, round(n / least(n, 20), 6) AS weight FROM x WHERE i <= 20""")
def _(scored):
    return model.stratified(scored, "stratum", [F.col("score"), F.col("key")], 20)


WEIGHTS = [((7 * k) % 11 - 5) / 10 for k in range(64)]
SQL_WEIGHTS = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"


@register("logistic_inference", ("embeddings",), f"""
WITH x AS (SELECT vec_id, label, 1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * {SQL_WEIGHTS}[i])) - 0.5))) AS p FROM embeddings)
SELECT vec_id, round(p, 4) AS p, CASE WHEN label % 2 = 0 AND p < 0.2 THEN 'unhid' WHEN label % 2 <> 0 AND p >= 0.9 THEN 'hid' END AS changed FROM x""")
def _(embeddings):
    x = model.logistic(embeddings, "embedding", WEIGHTS, -0.5)
    return x.select("vec_id", text.round4(F.col("p")).alias("p"), model.policy(F.col("p"), F.col("label") % 2 == 0).alias("changed"))


@register("top_contributions", ("embeddings",), f"""
WITH x AS (SELECT vec_id, i - 1 AS feature, round(CAST(embedding[i] AS DOUBLE) * {SQL_WEIGHTS}[i], 6) AS value FROM embeddings, range(1, 65) t(i)),
y AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(value) DESC, feature) AS place FROM x) SELECT vec_id, CAST(place AS INTEGER) AS place, CAST(feature AS INTEGER) AS feature, value FROM y WHERE place <= 3""")
def _(embeddings):
    return model.top_contributions(embeddings, ["vec_id"], "embedding", WEIGHTS)


# Scalar functions.


@register("text_functions", ("documents",), r"""
WITH d AS (SELECT doc_id, '  ' || text || ' ' AS t, source || '/pkg/mod_' || doc_id % 5 || CASE doc_id % 3 WHEN 0 THEN '/__init__.py' ELSE '/a.test.py' END AS p FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS squeezed, regexp_extract('a.b:' || doc_id, '[^.:]*$', 0) AS bare,
replace(regexp_replace(regexp_replace(p, '\.[^./]*$', ''), '(^|/)(__init__|index|mod)$', ''), '/', '.') AS module,
CASE WHEN regexp_matches(p, '[_.](test|spec)\.[^/]*$') THEN 'test' ELSE 'code' END AS kind FROM d""")
def _(documents):
    tail = F.when(F.col("doc_id") % 3 == 0, "/__init__.py").otherwise("/a.test.py")
    x = documents.select("doc_id", F.concat(F.lit("  "), "text", F.lit(" ")).alias("t"), F.concat("source", F.lit("/pkg/mod_"), (F.col("doc_id") % 5).cast("string"), tail).alias("p"))
    return x.select("doc_id", text.squeeze(F.col("t")).alias("squeezed"), text.bare_name(F.concat(F.lit("a.b:"), F.col("doc_id").cast("string"))).alias("bare"), text.module_of(F.col("p")).alias("module"), text.path_kind(F.col("p")).alias("kind"))


NAMES = ("README", "a.md", "CHANGES.txt", "b.rs", "c.json", "package-lock.json", "Makefile", "CMakeLists.txt", "d.adoc", "e.unknown", "f.test.ts", "g.min.js", "h_pb2.py", "i.snap", "j.py", "k.generated.ts")
FOLDERS = ("", "docs/", "src/", ".github/x/", "lib/vendor/y/", "tests/")


@register("path_kinds", ("documents",), f"""
WITH d AS (SELECT doc_id, [{", ".join(f"'{x}'" for x in FOLDERS)}][doc_id % {len(FOLDERS)} + 1] AS f, [{", ".join(f"'{x}'" for x in NAMES)}][CAST(floor(doc_id / {len(FOLDERS)}) AS BIGINT) % {len(NAMES)} + 1] AS n FROM documents),
x AS (SELECT doc_id, f || n AS path, n, f, n IN ('package-lock.json') OR n LIKE '%.min.js' OR ends_with(n, '_pb2.py') OR n LIKE '%.snap' OR n LIKE '%.generated.%' OR f = 'lib/vendor/y/' AS generated FROM d)
SELECT doc_id, path, generated, CASE WHEN n IN ('README', 'a.md', 'CHANGES.txt') THEN 'docs' WHEN f = 'tests/' OR n = 'f.test.ts' THEN 'test' WHEN f = 'docs/' AND n IN ('e.unknown', 'i.snap') OR n = 'd.adoc' THEN 'docs'
WHEN n IN ('c.json', 'package-lock.json', 'Makefile', 'CMakeLists.txt', 'e.unknown', 'i.snap') OR f = '.github/x/' OR generated THEN 'chore' ELSE 'code' END AS kind FROM x""")
def _(documents):
    at = lambda values, k: F.get(F.array(*[F.lit(x) for x in values]), k.cast("int"))
    path = F.concat(at(FOLDERS, F.col("doc_id") % len(FOLDERS)), at(NAMES, F.floor(F.col("doc_id") / len(FOLDERS)) % len(NAMES)))
    x = documents.select("doc_id", path.alias("path"))
    return x.select("doc_id", "path", text.is_generated(F.col("path")).alias("generated"), text.path_kind(F.col("path")).alias("kind"))


@register("path_selection", ("pages",), r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS p FROM pages) SELECT page_id, p AS path FROM p WHERE (regexp_matches(p, '^/en/.*$') OR regexp_matches(p, '^/(de|fr)/.*$')) AND NOT regexp_matches(p, '^.*\.html$')""")
def _(pages):
    x = pages.select("page_id", F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1).alias("path"))
    return x.where(text.selected(F.col("path"), ["/en/*", "!*.html", "/{de,fr}/*"]))
