"""Registered queries of classification, contracts, rules, differences, sources and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.operators import classify, contract, diff, edits, extract, graph, model, rules, symbols
from driftlens.plans import review
from driftlens.plans.bindings import BINDINGS, load
from driftlens.plans.core import QUERIES, register
from driftlens.sources import patches
from driftlens.streaming import state

# Callables: the parts of an order, before and after, in the order of their lines.
for side, flag in (("old_calls", "<> 'R'"), ("new_calls", "<> 'A'")):
    BINDINGS[side] = f"""
SELECT l_orderkey AS name, concat('p', CAST(l_partkey % 12 AS VARCHAR(20))) AS item, min(l_linenumber) AS place, min(l_suppkey % 3) AS dflt FROM lineitem WHERE l_returnflag {flag} GROUP BY l_orderkey, concat('p', CAST(l_partkey % 12 AS VARCHAR(20)))
"""
BINDINGS["sites"] = """
SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey AS name, CAST(min(l_suppkey) % 4 AS BIGINT) AS positional, concat('p', CAST(min(l_partkey) % 12 AS VARCHAR(20))) AS keyword, min(l_suppkey) % 7 = 0 AS spread, min(l_partkey) % 2 = 0 AS untouched
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""


def callables(rows: DataFrame) -> DataFrame:
    got = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "item", "dflt"))).alias("r"))
    items = F.transform("r", lambda x: x["item"])
    return got.select("name", items.alias("params"), F.transform("r", lambda x: x["dflt"].cast("string")).alias("defaults"), items.alias("raised"), items.alias("entered"))


def sites(rows: DataFrame) -> DataFrame:
    return rows.select("id", "name", "positional", F.array("keyword").alias("keywords"), F.array("keyword").alias("caught"), "spread", "untouched")


CALLS = ("old_calls", "new_calls", "sites")
PARAMS = """o AS (SELECT name, list(item ORDER BY place, item, dflt) AS p, list(CAST(dflt AS VARCHAR) ORDER BY place, item, dflt) AS d FROM old_calls GROUP BY name),
n AS (SELECT name, list(item ORDER BY place, item, dflt) AS p, list(CAST(dflt AS VARCHAR) ORDER BY place, item, dflt) AS d FROM new_calls GROUP BY name),
b AS (SELECT o.name, o.p AS wp, n.p AS np, o.d AS wd, n.d AS nd FROM o JOIN n ON o.name = n.name)"""


@register("positions_shifted", CALLS, f"""WITH {PARAMS}, k AS (SELECT name, wp, list_filter(range(1, len(wp) + 1), lambda i: list_contains(np, wp[i]) AND list_position(np, wp[i]) <> i)[1] AS k FROM b)
SELECT s.id, s.name, k.wp[k.k] AS parameter FROM sites s JOIN k ON k.name = s.name WHERE k.k IS NOT NULL AND s.untouched AND NOT s.spread AND s.positional >= k.k""")
def _(old, new, calls):
    return contract.positions_shifted(callables(old), callables(new), sites(calls))


@register("keywords_dropped", CALLS, f"""WITH {PARAMS} SELECT s.id, s.name, s.keyword AS dropped FROM sites s JOIN b ON b.name = s.name WHERE list_contains(wp, s.keyword) AND NOT list_contains(np, s.keyword)""")
def _(old, new, calls):
    return contract.keywords_dropped(callables(old), callables(new), sites(calls))


@register("defaults_changed", CALLS, f"""WITH {PARAMS}, k AS (SELECT name, np, list_filter(range(1, least(len(wd), len(nd)) + 1), lambda i: wd[i] <> nd[i])[1] AS k FROM b)
SELECT s.id, s.name, k.k AS position FROM sites s JOIN k ON k.name = s.name WHERE k.k IS NOT NULL AND NOT s.spread AND s.positional < k.k AND k.np[k.k] <> s.keyword""")
def _(old, new, calls):
    return contract.defaults_changed(callables(old), callables(new), sites(calls))


@register("handlers_missed", CALLS, f"""WITH {PARAMS} SELECT s.id, s.name FROM sites s JOIN b ON b.name = s.name WHERE list_contains(wp, s.keyword) AND NOT list_contains(np, s.keyword) AND len(list_filter(np, lambda x: NOT list_contains(wp, x))) > 0""")
def _(old, new, calls):
    return contract.handlers_missed(callables(old), callables(new), sites(calls))


@register("guarantees_dropped", CALLS[:2], f"""WITH {PARAMS} SELECT name, array_to_string(list_sort(list_filter(wp, lambda x: NOT list_contains(np, x))), ',') AS lost FROM b WHERE len(np) < len(wp) AND len(list_filter(wp, lambda x: NOT list_contains(np, x))) > 0""")
def _(old, new):
    return contract.guarantees_dropped(callables(old), callables(new))


@register("overrides_left", CALLS[:2], f"""WITH {PARAMS} SELECT b.name, o2.name AS owner FROM b JOIN (SELECT name, name - 1 AS base, list(item ORDER BY place, item, dflt) AS p FROM old_calls GROUP BY name) o2 ON o2.base = b.name WHERE wp <> np AND o2.p = wp""")
def _(old, new):
    subs = callables(old).select((F.col("name") - 1).alias("name"), F.col("name").alias("owner"), "params")
    return contract.overrides_left(callables(old), callables(new), subs)


@register("unimplemented_abstract", ("lineitem",), """
WITH a AS (SELECT DISTINCT l_suppkey AS base, l_partkey % 50 AS name FROM lineitem WHERE l_linenumber = 1), s AS (SELECT DISTINCT l_suppkey AS base, l_orderkey AS owner FROM lineitem WHERE l_linenumber = 2), m AS (SELECT DISTINCT l_orderkey AS owner, l_partkey % 50 AS name FROM lineitem)
SELECT a.base, s.owner, a.name FROM a JOIN s ON a.base = s.base WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.owner = s.owner AND m.name = a.name)""")
def _(x):
    name = (F.col("l_partkey") % 50).alias("name")
    a = x.where("l_linenumber = 1").select(F.col("l_suppkey").alias("base"), name).dropDuplicates()
    s = x.where("l_linenumber = 2").select(F.col("l_suppkey").alias("base"), F.col("l_orderkey").alias("owner")).dropDuplicates()
    return contract.unimplemented(a, s, x.select(F.col("l_orderkey").alias("owner"), name))


@register("enum_values_changed", ("customer",), """
SELECT a.c_nationkey AS owner, a.c_custkey AS member, floor(a.c_acctbal / 1000) AS was, floor(b.c_acctbal / 1000) AS now FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey + 25 = b.c_custkey WHERE floor(a.c_acctbal / 1000) <> floor(b.c_acctbal / 1000)""")
def _(customer):
    value = F.floor(F.col("c_acctbal") / 1000).cast("double").alias("value")
    old = customer.select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("member"), value)
    return contract.enum_values_changed(old, customer.select(F.col("c_nationkey").alias("owner"), (F.col("c_custkey") - 25).alias("member"), value))


TURNS = "SELECT a.conv_id, a.turn, a.text AS old, b.text AS new FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = b.role AND b.turn = a.turn + 2"
BINDINGS["revisions"] = TURNS


@register("loosened_tests", ("revisions",), """
WITH x AS (SELECT conv_id * 100 + turn AS id, len(regexp_extract_all(old, 'th|en')) AS was, len(regexp_extract_all(new, 'th|en')) AS now FROM revisions) SELECT id, was, now FROM x WHERE now < was""")
def _(revisions):
    ident = (F.col("conv_id") * 100 + F.col("turn")).alias("id")
    return contract.loosened_tests(revisions.select(ident, F.col("old").alias("text")), revisions.select(ident, F.col("new").alias("text")), "th|en")


@register("became_async", ("lineitem",), """
WITH o AS (SELECT DISTINCT l_partkey AS name FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber % 2 = 1), n AS (SELECT DISTINCT l_partkey AS name FROM lineitem WHERE l_linestatus <> 'O' AND l_linenumber % 2 = 0)
SELECT l_orderkey AS id, l_partkey AS name FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT name FROM o) AND l_partkey IN (SELECT name FROM n)""")
def _(x):
    side = lambda c: x.where(c).select(F.col("l_partkey").alias("name"), (F.col("l_linenumber") % 2 == 0).alias("asynchronous"))
    calls = x.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("name"), (F.col("l_returnflag") == "R").alias("discarded"))
    return contract.discarded_awaits(side("l_linestatus = 'O'"), side("l_linestatus <> 'O'"), calls)


@register("duplicated_helpers", ("lineitem",), """
WITH f AS (SELECT l_suppkey % 20 AS file, l_shipdate AS name, list_distinct(list(l_linenumber)) AS lines FROM lineitem GROUP BY 1, 2)
SELECT a.name, b.file, min(a.file) AS first FROM f a JOIN f b ON a.name = b.name AND a.file < b.file WHERE len(a.lines) >= 3 AND len(b.lines) >= 3 AND len(list_intersect(a.lines, b.lines)) * 2 / (len(a.lines) + len(b.lines)) >= 0.9 GROUP BY 1, 2""")
def _(x):
    return contract.duplicated_helpers(x.groupBy((F.col("l_suppkey") % 20).alias("file"), F.col("l_shipdate").alias("name")).agg(F.collect_set("l_linenumber").alias("lines")))


# Classification.

BINDINGS["kinds"] = """
SELECT l_orderkey AS review, CASE l_suppkey % 5 WHEN 0 THEN 'docs' WHEN 1 THEN 'test' WHEN 2 THEN 'chore' ELSE 'code' END AS path_kind,
CASE l_partkey % 5 WHEN 0 THEN 'Format' WHEN 1 THEN 'Pattern' WHEN 2 THEN 'Edit' WHEN 3 THEN 'Comment' ELSE 'Move' END AS kind, CASE l_partkey % 6 WHEN 1 THEN 'Guard' WHEN 2 THEN 'Async' ELSE NULL END AS intent, l_quantity > 40 AS adds_name FROM lineitem
"""


@register("change_label", ("kinds",), """
WITH x AS (SELECT review, bool_or(path_kind = 'code') AS code, bool_or(path_kind = 'test') AS test, bool_or(path_kind = 'chore') AS chore, list(kind) FILTER (path_kind = 'code') AS k,
bool_or(path_kind = 'code' AND coalesce(intent = 'Guard', false)) AS fix, bool_or(path_kind = 'code' AND adds_name) AS named FROM kinds GROUP BY review)
SELECT review, CASE WHEN NOT code AND NOT test AND NOT chore THEN 'docs' WHEN NOT code AND test THEN 'test' WHEN NOT code THEN 'chore'
WHEN list_contains(k, 'Comment') AND len(list_filter(k, lambda z: z NOT IN ('Comment', 'Format'))) = 0 THEN CASE WHEN test THEN 'test' ELSE 'docs' END
WHEN len(list_filter(k, lambda z: z NOT IN ('Format', 'Comment', 'Move'))) = 0 THEN 'refactor' WHEN fix THEN 'fix-candidate' WHEN named THEN 'feature' WHEN test THEN 'fix-candidate' ELSE 'change' END AS label FROM x""")
def _(kinds):
    return classify.label(kinds)


@register("change_verdict", ("kinds",), """
SELECT review, CASE WHEN bool_and(path_kind = 'docs' OR kind IN ('Format', 'Move', 'Comment')) THEN 'preserving' WHEN bool_or(path_kind IN ('code', 'chore') AND kind = 'Pattern') THEN 'changes' ELSE 'unknown' END AS verdict FROM kinds GROUP BY review""")
def _(kinds):
    return classify.verdict(kinds)


@register("rationale", ("hunks", "facts"), """
WITH s AS (SELECT h.review, h.file, h.hunk, h.noise, h.added, h.removed, string_agg(DISTINCT CASE WHEN f.kind = 'def' THEN f.name END, ',' ORDER BY CASE WHEN f.kind = 'def' THEN f.name END) AS d FROM hunks h LEFT JOIN facts f ON f.review = h.review AND f.file = h.file AND f.row_no BETWEEN h.n0 AND h.n1 GROUP BY ALL)
SELECT review, file, hunk, CASE WHEN noise THEN 'formatting only' WHEN d <> '' THEN 'adds ' || d WHEN added > 0 THEN 'adds ' || added || ' lines' ELSE 'removes ' || removed || ' lines' END AS rationale FROM s""")
def _(hunks, facts):
    from driftlens.operators.ranges import HUNK, covered, names

    d = covered(facts, hunks.select(*HUNK, "n0", "n1")).groupBy(*HUNK).agg(names(F.col("kind") == "def").alias("declared"))
    x = hunks.join(d, HUNK, "left")
    none = F.lit("")
    return x.select(*HUNK, classify.rationale(F.col("noise"), none, F.coalesce("declared", none), none, none, F.col("added"), F.col("removed")).alias("rationale"))


@register("member_diff", ("customer",), """
WITH o AS (SELECT c_nationkey AS container, c_custkey % 100 AS name, min(floor(c_acctbal / 2000)) AS text FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1, 2), n AS (SELECT c_nationkey AS container, (c_custkey + 1) % 100 AS name, min(floor(c_acctbal / 2000)) AS text FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1, 2),
x AS (SELECT coalesce(o.container, n.container) AS container, lpad(CAST(coalesce(o.name, n.name) AS VARCHAR), 3, '0') AS name, o.text AS was, n.text AS now FROM o FULL JOIN n ON o.container = n.container AND o.name = n.name),
y AS (SELECT container, coalesce(list_sort(list(name) FILTER (was IS NULL)), []) AS a, coalesce(list_sort(list(name) FILTER (now IS NULL)), []) AS r, coalesce(list_sort(list(name) FILTER (was <> now)), []) AS c FROM x GROUP BY container)
SELECT container, array_to_string(a[1:3], ', ') AS added, array_to_string(r[1:3], ', ') AS removed, array_to_string(c[1:3], ', ') AS changed FROM y WHERE len(a) + len(r) + len(c) > 0""")
def _(customer):
    side = lambda c, k: customer.where(c).groupBy(F.col("c_nationkey").alias("container"), F.lpad(((F.col("c_custkey") + k) % 100).cast("string"), 3, "0").alias("name")).agg(F.min(F.floor(F.col("c_acctbal") / 2000)).alias("text"))
    return classify.member_diff(side("c_custkey % 2 = 0", 0), side("c_custkey % 2 = 1", 1))


RULES = [
    rules.Rule("long-english", lang=("en",), max_lines=2000, warn="too long", priority=2),
    rules.Rule("symbols", text="[#$%]{3}", note="symbols", verdict="noise", hides=True),
    rules.Rule("tests", path="src1*", path_not="src1?", test=False),
]


@register("rule_findings", ("documents",), """
WITH d AS (SELECT doc_id, source AS path, lang, text, n_chars AS lines, doc_id % 9 = 0 AS test FROM documents)
SELECT doc_id, 'long-english' AS rule, 'note' AS level, 'warn' AS original, 'too long' AS message FROM d WHERE lang = 'en' AND lines > 2000
UNION ALL SELECT doc_id, 'symbols', l, l, m FROM d, (VALUES ('note', 'symbols'), ('verdict', 'noise')) v(l, m) WHERE regexp_matches(text, '[#$%]{3}')
UNION ALL SELECT doc_id, 'tests', 'note', 'note', 'tests' FROM d WHERE path LIKE 'src1%' AND length(path) <> 5 AND NOT test""")
def _(documents):
    return rules.findings(units(documents), RULES, ["doc_id"], {"long-english": "note"})


def units(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("source").alias("path"), "lang", "text", F.col("n_chars").alias("lines"), (F.col("doc_id") % 9 == 0).alias("test"))


@register("rule_effects", ("documents",), """
SELECT doc_id, coalesce(regexp_matches(text, '[#$%]{3}'), false) AS hidden, CASE WHEN lang = 'en' AND n_chars > 2000 THEN 2 ELSE 0 END AS priority FROM documents""")
def _(documents):
    return rules.effects(units(documents), RULES, ["doc_id"])


# Differences.


def revisions(x: DataFrame) -> DataFrame:
    return x.select(F.col("conv_id").alias("review"), F.col("turn").alias("file"), "old", "new")


@register("file_hunks", ("revisions",))
def _(x):
    return diff.file_hunks(revisions(x))


@register("line_delta", ("revisions",), """
WITH l AS (SELECT conv_id AS review, turn AS file, unnest(string_split(coalesce(old, ''), chr(10))) AS line, -1 AS d FROM revisions UNION ALL SELECT conv_id, turn, unnest(string_split(coalesce(new, ''), chr(10))), 1 FROM revisions),
s AS (SELECT review, file, line, sum(d) AS d FROM l GROUP BY ALL) SELECT review, file, CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS removed FROM s GROUP BY review, file""")
def _(x):
    return diff.line_delta(revisions(x))


@register("refined_lines", ("revisions",))
def _(x):
    return diff.refined(x.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.split("old", "\n").alias("old"), F.split("new", "\n").alias("new")))


# Syntax: an order's lines as a Python module, each a function that calls another.


def modules(lineitem: DataFrame) -> DataFrame:
    s = lambda c: c.cast("string")
    body = lambda x: F.concat(F.lit("def f"), s(x["l_partkey"]), F.lit("(a):\n    return g"), s(x["l_suppkey"]), F.lit("(a)\n"))
    review = F.floor(F.col("l_orderkey") / 1000).cast("long").alias("review")
    # Dealt by review once: its files, and their places in it, are made where its lines are.
    x = lineitem.select(review, F.col("l_orderkey").alias("file"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("piece")).repartition("review")
    got = x.groupBy("review", "file").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return got.select("review", "file", F.lit("python").alias("lang"), F.array_join(F.transform("pieces", body), "").alias("text"))


@register("python_facts", ("lineitem",), """
WITH x AS (SELECT l_orderkey AS file, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
SELECT file, 'def' AS kind, 'f' || l_partkey AS name, 2 * k - 1 AS row_no, 2 * k AS hi FROM x UNION ALL SELECT file, 'call', 'g' || l_suppkey, 2 * k, 2 * k FROM x""")
def _(lineitem):
    return extract.facts(modules(lineitem)).where("kind in ('def', 'call')").select("file", "kind", "name", "row_no", "hi")


@register("whole_review", ("lineitem",))
def _(lineitem):
    m = modules(lineitem)
    place = F.row_number().over(Window.partitionBy("review").orderBy("file")).cast("long") - 1
    old = F.regexp_replace("text", r"g(\d)", r"h$1")
    changes = m.select("review", place.alias("file"), F.concat(F.lit("src/m"), F.col("file").cast("string"), F.lit(".py")).alias("path"), old.alias("old"), F.col("text").alias("new"))
    return review.hunks(changes).select("review", "file", "hunk", "o0", "o1", "n0", "n1", "shape", "category", "declared", "uses", "rationale")


# Sources and sinks.


def patch_text() -> F.Column:
    body = lambda: F.expr("concat('@@ -', l_partkey, if(l_suppkey % 3 = 0, '', concat(',', l_suppkey % 3)), ' +', l_partkey + 1, ',', l_linenumber % 4, ' @@ f', '\\n context\\n')")
    return F.concat(F.lit("diff --git a/f"), F.col("l_suppkey").cast("string"), F.lit(" b/f"), F.col("l_suppkey").cast("string"), F.lit("\n--- a/f"), F.col("l_suppkey").cast("string"), F.lit("\n+++ b/f"), F.col("l_suppkey").cast("string"), F.lit("\n"), body())


def patch_table(lineitem: DataFrame) -> DataFrame:
    pieces = lineitem.select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_suppkey", "l_partkey", patch_text().alias("t")).alias("s"))
    return pieces.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "").alias("patch"))


@register("split_patch", ("lineitem",), """
SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS INTEGER) AS file, 'f' || l_suppkey AS path FROM lineitem""")
def _(lineitem):
    return patches.split_patch(patch_table(lineitem)).select("id", "file", "path")


@register("patch_hunks", ("lineitem",), """
WITH x AS (SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS INTEGER) AS file, l_partkey AS os, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE l_suppkey % 3 END AS oc, l_partkey + 1 AS ns, CAST(l_linenumber % 4 AS BIGINT) AS nc FROM lineitem)
SELECT id, file, CAST(0 AS BIGINT) AS hunk, os AS o0, os + oc - 1 AS o1, CASE WHEN nc = 0 THEN ns + 1 ELSE ns END AS n0, CASE WHEN nc = 0 THEN ns ELSE ns + nc - 1 END AS n1 FROM x WHERE os > 0""")
def _(lineitem):
    return patches.hunk_headers(patches.split_patch(patch_table(lineitem)))


@register("sarif_round_trip", ("nation",), "SELECT 'tool' AS tool, n_name AS rule, CASE WHEN n_nationkey % 2 = 0 THEN 'warn' ELSE 'note' END AS level, 'm' || n_nationkey AS message, 'r' || n_regionkey AS path, n_nationkey AS line FROM nation")
def _(nation):
    level = F.when(F.col("n_nationkey") % 2 == 0, "warn").otherwise("note")
    found = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("rule"), level.alias("level"), F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("message"), F.concat(F.lit("./r"), F.col("n_regionkey").cast("string")).alias("path"), F.col("n_nationkey").alias("lo"), F.col("n_nationkey").alias("hi"))
    return patches.sarif(patches.to_sarif(found, "tool"))


@register("lcov", ("lineitem",), "SELECT 'f' || l_suppkey AS path, CAST(l_partkey AS INTEGER) AS line, max(CAST(floor(l_quantity) AS BIGINT)) AS hits FROM lineitem GROUP BY 1, 2")
def _(lineitem):
    rows = lineitem.select(F.col("l_orderkey").alias("trace"), F.posexplode(F.array(F.concat(F.lit("SF:f"), F.col("l_suppkey").cast("string")), F.concat_ws(",", F.concat(F.lit("DA:"), F.col("l_partkey").cast("string")), F.floor("l_quantity").cast("string")), F.lit("end_of_record"))).alias("k", "value"), F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("o"))
    return patches.lcov(rows.select("trace", F.struct("o", "k").alias("place"), "value"))


# Recurring edits, features, labels from later fixes.


@register("same_edits", ("lineitem",))
def _(lineitem):
    x = lineitem.select(F.col("l_orderkey").alias("node"), F.col("l_orderkey").alias("home"), F.concat(F.lit("edit number "), F.col("l_partkey").cast("string")).alias("edit")).dropDuplicates()
    return edits.same_edits(x)


@register("feature_vector", ("hunks",), """
SELECT review * 1000000 + file * 1000 + hunk AS node, CAST(noise AS INTEGER)::DOUBLE AS noise, 0.0::DOUBLE AS comment, (file = 1)::INTEGER::DOUBLE AS test_path, added::DOUBLE AS lines_added, removed::DOUBLE AS lines_removed, priority::DOUBLE AS defines, scope::DOUBLE AS uses,
0.0::DOUBLE AS edges_out, 0.0::DOUBLE AS edges_in, 1.0::DOUBLE AS has_history, 0.0::DOUBLE AS churn, 0.0::DOUBLE AS fixes, (scope = 0)::INTEGER::DOUBLE AS category_import, (scope = 1)::INTEGER::DOUBLE AS category_definition, (scope = 2)::INTEGER::DOUBLE AS category_other,
0.0::DOUBLE AS extent_whitespace, 0.0::DOUBLE AS extent_formatting, (added > 0 AND removed > 0)::INTEGER::DOUBLE AS extent_edited, 0.0::DOUBLE AS extent_rewritten, (removed = 0)::INTEGER::DOUBLE AS extent_added, (added = 0 AND removed > 0)::INTEGER::DOUBLE AS extent_removed, 0.0::DOUBLE AS extent_none,
3.0::DOUBLE AS rationale_words, 2.0::DOUBLE AS rationale_clauses, 0.0::DOUBLE AS rationale_commas, 0.0::DOUBLE AS rationale_more FROM hunks""")
def _(hunks):
    zero = F.lit(0)
    x = hunks.select((F.col("review") * 1000000 + F.col("file") * 1000 + F.col("hunk")).alias("node"), "noise", zero.alias("comment"), (F.col("file") == 1).alias("test_path"), F.col("added").alias("lines_added"), F.col("removed").alias("lines_removed"), F.col("priority").alias("defines"), F.col("scope").alias("uses"),
                     zero.alias("edges_out"), zero.alias("edges_in"), F.lit(1).alias("has_history"), zero.alias("churn"), zero.alias("fixes"), F.get(F.array(*[F.lit(c) for c in edits.CATEGORIES]), F.col("scope").cast("int")).alias("category"),
                     classify.extent(F.col("added"), F.col("removed"), F.lit(1.0), F.lit(False)).alias("extent"), F.lit("adds x; edits").alias("rationale"))
    return edits.features(x)


@register("later_fix", ("lineitem",), """
WITH h AS (SELECT l_orderkey * 10 + l_linenumber AS node, l_suppkey AS path, l_partkey AS lo, l_partkey + 20 AS hi, min(l_shipdate) AS at FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2, 3, 4), f AS (SELECT l_suppkey AS path, l_partkey AS line, l_shipdate AS fixed_at FROM lineitem WHERE l_returnflag = 'R')
SELECT node, EXISTS (SELECT 1 FROM h g JOIN f ON f.path = g.path WHERE g.node = h.node AND f.fixed_at > g.at AND f.fixed_at <= g.at + INTERVAL 90 DAY AND f.line BETWEEN g.lo AND g.hi) AS later_fix FROM h""")
def _(x):
    h = x.where("l_returnflag = 'A'").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"), F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + 20).alias("hi")).agg(F.min("l_shipdate").alias("at"))
    f = x.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("line"), F.col("l_shipdate").alias("fixed_at"))
    return edits.later_fix(h, f, 90)


TREES = [
    {"feature": "added", "threshold": 2.5, "left": {"value": 0.3}, "right": {"feature": "removed", "threshold": 0.5, "left": {"value": 0.1}, "right": {"value": -0.7}}},
    {"feature": "scope", "threshold": 1.0, "left": {"value": -0.2}, "right": {"value": 0.4}},
]


@register("tree_inference", ("hunks",), """
SELECT review, file, hunk, round(1 / (1 + exp(-(0.1 + CASE WHEN added <= 2.5 THEN 0.3 WHEN removed <= 0.5 THEN 0.1 ELSE -0.7 END + CASE WHEN scope <= 1 THEN -0.2 ELSE 0.4 END))), 4) AS p FROM hunks""")
def _(hunks):
    return model.ensemble(hunks, TREES, 0.1).select("review", "file", "hunk", F.round("p", 4).alias("p"))


@register("consumers", ("documents",), """
WITH x AS (SELECT source AS repo, doc_id AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE (contains(text, 'idiot') OR contains(text, 'th.')) AND octet_length(encode(text)) <= 524288),
y AS (SELECT *, row_number() OVER w AS n, sum(size) OVER (PARTITION BY repo ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM x WINDOW w AS (PARTITION BY repo ORDER BY path)) SELECT repo, path, size FROM y WHERE n <= 5 AND t <= 20000""")
def _(documents):
    needles = documents.sparkSession.createDataFrame([("idiot",), ("th.",)], "needle string")
    return symbols.consumers(documents.select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), F.col("text").alias("content")), needles, 5, most_total=20000)


@register("symbol_history", ("lineitem",), """
WITH t AS (SELECT DISTINCT l_partkey AS symbol, l_orderkey AS time, l_orderkey * 10 AS sha FROM lineitem), a AS (SELECT l_partkey AS symbol, min(l_orderkey) + 2000 AS point FROM lineitem GROUP BY 1),
x AS (SELECT t.symbol, a.point, CASE WHEN time < point THEN 'before' ELSE 'after' END AS side, sha, row_number() OVER (PARTITION BY t.symbol, point, time < point ORDER BY abs(time - point), sha) AS place FROM t JOIN a ON a.symbol = t.symbol WHERE time <> point) SELECT symbol, point, side, CAST(place AS INTEGER) AS place, sha FROM x WHERE place <= 10""")
def _(x):
    touches = x.select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("time"), (F.col("l_orderkey") * 10).alias("sha")).dropDuplicates()
    return symbols.symbol_history(touches, x.groupBy(F.col("l_partkey").alias("symbol")).agg((F.min("l_orderkey") + 2000).alias("point")))


@register("stale_strings", ("orders",), """
SELECT o_orderkey AS id, 'pkg.m' || o_custkey AS before, 'new.m' || o_custkey AS after FROM orders WHERE o_custkey % 3 = 0""")
def _(orders):
    name = lambda p: F.concat(F.lit(p), F.col("o_custkey").cast("string"))
    texts = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("x = 'pkg.m"), F.col("o_custkey").cast("string"), F.lit("' or \"other.y\" or pkg.m1")).alias("text"))
    return symbols.stale_strings(texts, orders.where("o_custkey % 3 = 0").select(name("pkg.m").alias("before"), name("new.m").alias("after")).dropDuplicates())


@register("own_bound", ("defines", "uses"), "SELECT u.grp, u.file, u.symbol FROM uses u WHERE EXISTS (SELECT 1 FROM defines d WHERE d.file = u.file AND d.symbol = u.symbol) AND NOT EXISTS (SELECT 1 FROM uses i WHERE i.file = u.file AND i.symbol = u.symbol AND i.grp % 3 = 0)")
def _(defines, uses):
    return symbols.own_bound(uses, defines, uses.where("grp % 3 = 0")).select("grp", "file", "symbol")


@register("pair_relation", ("dag",), """
WITH RECURSIVE r(start, node) AS (SELECT src, dst FROM dag UNION SELECT r.start, d.dst FROM r JOIN dag d ON d.src = r.node), p AS (SELECT DISTINCT src AS a, src + 100 AS b FROM dag UNION SELECT dst, src FROM dag)
SELECT a, b, CASE WHEN f.start IS NOT NULL THEN 'before' WHEN g.start IS NOT NULL THEN 'after' ELSE 'free' END AS relation
FROM p LEFT JOIN (SELECT DISTINCT start, node FROM r) f ON f.start = a AND f.node = b LEFT JOIN (SELECT DISTINCT start, node FROM r) g ON g.start = b AND g.node = a""")
def _(dag):
    pairs = dag.select(F.col("src").alias("a"), (F.col("src") + 100).alias("b")).union(dag.select("dst", "src")).dropDuplicates()
    return symbols.relation(pairs, graph.closure(dag, dag.select(F.col("src").alias("start")).dropDuplicates()))


@register("extractions", ("lineitem",), """
WITH o AS (SELECT DISTINCT l_suppkey % 20 AS file, l_linenumber AS name, l_partkey % 60 AS line FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT DISTINCT l_suppkey % 20 AS file, l_linenumber + CASE WHEN l_orderkey % 2 = 0 THEN 10 ELSE 0 END AS name, l_partkey % 60 AS line FROM lineitem WHERE l_returnflag = 'R'),
a AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.file = n.file AND o.name = n.name)), z AS (SELECT file, name, count(DISTINCT line) AS size FROM a GROUP BY ALL HAVING count(DISTINCT line) >= 3),
l AS (SELECT DISTINCT file, line, name AS source FROM o WHERE EXISTS (SELECT 1 FROM n WHERE n.file = o.file AND n.name = o.name) AND NOT EXISTS (SELECT 1 FROM n WHERE n.file = o.file AND n.name = o.name AND n.line = o.line)),
s AS (SELECT a.file, a.name, l.source, count(DISTINCT a.line) AS shared FROM a JOIN l ON l.file = a.file AND l.line = a.line GROUP BY ALL) SELECT s.file, s.name, first(source ORDER BY shared DESC, source) AS source, max(shared) AS shared FROM s JOIN z ON z.file = s.file AND z.name = s.name WHERE shared >= 3 AND 2 * shared >= size GROUP BY ALL""")
def _(x):
    file, line = (F.col("l_suppkey") % 20).alias("file"), (F.col("l_partkey") % 60).alias("line")
    old = x.where("l_returnflag = 'A'").select(file, F.col("l_linenumber").alias("name"), line).dropDuplicates()
    name = F.col("l_linenumber") + F.when(F.col("l_orderkey") % 2 == 0, 10).otherwise(0)
    return symbols.extractions(old, x.where("l_returnflag = 'R'").select(file, name.alias("name"), line).dropDuplicates())


# State over time.


def drifting(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))


@register("debounced_drift", ("events",), """
WITH x AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events), y AS (SELECT key, ts, sum(s) OVER (PARTITION BY key ORDER BY ts) AS run FROM x)
SELECT key, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 2 HOUR) AS stop_us, count(*) AS changes FROM y GROUP BY key, run""")
def _(events):
    return state.debounced(drifting(events), "2 hours").select("key", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "changes")


@register("mark_expiry", ("orders",), "SELECT o_orderkey AS key FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY")
def _(orders):
    kept, _ = state.expired(orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at")), F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))
    return kept.select("key")


@register("waves", ("events",), """
WITH x AS (SELECT user_id AS key, epoch_us(ts) AS ts, event_type AS content, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_type)) SELECT key, ts, content, row_number() OVER (PARTITION BY key ORDER BY ts, content) AS wave FROM x WHERE content IS DISTINCT FROM b""")
def _(events):
    return state.waves(events.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("content")))


@register("merge_state", ("events",), """
SELECT key, content FROM (SELECT user_id AS key, event_type AS content, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) x WHERE i = 1""")
def _(events):
    x = events.select(F.col("user_id").alias("key"), F.col("event_type").alias("content"), "event_id")
    return state.upsert(x.where("event_id % 2 = 0"), x.where("event_id % 2 = 1"), ["key"], "event_id").select("key", "content")


@register("idle_slots", ("events",), """
WITH x AS (SELECT user_id AS key, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT key, epoch_us(ts + INTERVAL 30 MINUTE) AS dropped_us FROM x WHERE n IS NULL OR n - ts >= INTERVAL 30 MINUTE""")
def _(events):
    return state.debounced(drifting(events), "30 minutes").select("key", F.unix_micros("stop").alias("dropped_us"))


@register("hunk_churn", ("history",), """
WITH x AS (SELECT DISTINCT path, sha, at_time FROM history), y AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY at_time DESC, sha DESC) AS i, count(*) OVER (PARTITION BY path) AS n FROM x) SELECT path, least(n, 20) AS commits, n > 20 AS capped, sha AS last FROM y WHERE i = 1""")
def _(history):
    x = history.select("path", "sha", "at_time").dropDuplicates()
    got = x.groupBy("path").agg(F.count("*").alias("n"), F.max_by("sha", F.struct("at_time", "sha")).alias("last"))
    return got.select("path", F.least("n", F.lit(20)).alias("commits"), (F.col("n") > 20).alias("capped"), "last")


def debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The debounce over a stream of the events, replayed to its end."""
    import uuid

    from driftlens.operators.graph import cut

    cut(spark.range(1))  # makes sure of a shared folder
    sc = spark.sparkContext
    folder = (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()).rstrip("/")
    events = load(spark, sf_dir, "events")
    path = f"{folder}/events-{uuid.uuid4().hex}"
    events.write.parquet(path)
    shape = lambda x: state.debounced(drifting(x).withWatermark("ts", "1 day"), "2 hours")
    return state.replay(spark, path, events.schema.simpleString()[7:-1].replace(":", " "), shape, f"{folder}/drift-{uuid.uuid4().hex}", f"{folder}/state-{uuid.uuid4().hex}")


QUERIES["debounce_stream"] = debounce_stream
