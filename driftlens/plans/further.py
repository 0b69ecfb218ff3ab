"""Registered queries of rule conditions, callers, shapes, scopes, winnowing, names, notices, directives and kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import classify, contract, narrate, ranges, report, rules, symbols
from driftlens.plans.bindings import BINDINGS
from driftlens.plans.core import register

# Conditions of rules: a line of an order is a hunk with the figures of two definitions.
BINDINGS["ruled"] = """
SELECT l_orderkey AS review, l_linenumber AS hunk, concat('m', CAST(l_partkey % 30 AS VARCHAR(20))) AS import, concat('x', CAST(l_suppkey % 12 AS VARCHAR(20))) AS member, l_linenumber % 2 = 0 AS comment,
       l_partkey % 3 = 0 AS recursive, CAST(floor(l_quantity) AS BIGINT) AS file_lines, CASE WHEN l_returnflag <> 'N' THEN CAST(l_linenumber AS BIGINT) * 8 END AS old_file_lines,
       CASE WHEN l_suppkey % 2 = 0 THEN 'class' ELSE 'definition' END AS enclosing_kind, l_returnflag = 'R' AS bare, CAST(l_linenumber % 3 AS BIGINT) AS nest0, CAST(l_suppkey % 6 AS BIGINT) AS nest1, CAST(l_partkey % 20 AS BIGINT) AS lines0
FROM lineitem
"""
CONDITIONS = [
    rules.Rule("imports", imports="m1*", container_without="x1?"),
    rules.Rule("grown", max_nesting_delta=1, max_lines_delta=5),
    rules.Rule("file", max_file_lines=30),
    rules.Rule("self", enclosing_kind="class", comment=False, recursive=True),
    rules.Rule("members", container_with="x1*", member_uninitialized=True),
]


@register("rule_conditions", ("ruled",), """
WITH r AS (SELECT *, nest1 - nest0 > 1 AND file_lines - lines0 > 5 AS f, nest0 - nest1 > 1 AND lines0 - file_lines > 5 AS g FROM ruled),
y AS (SELECT review, hunk, CASE WHEN f THEN 'f: nesting ' || nest0 || ' → ' || nest1 || ', lines ' || lines0 || ' → ' || file_lines END AS sf, CASE WHEN g THEN 'g: nesting ' || nest1 || ' → ' || nest0 || ', lines ' || file_lines || ' → ' || lines0 END AS sg FROM r)
SELECT review, hunk, 'imports' AS rule, NULL AS grown FROM r WHERE starts_with(import, 'm1') AND NOT regexp_matches(member, '^x1.$')
UNION ALL SELECT review, hunk, 'grown', coalesce(sf, sg) FROM y WHERE sf IS NOT NULL OR sg IS NOT NULL
UNION ALL SELECT review, hunk, 'file', NULL FROM r WHERE file_lines > 30 AND coalesce(old_file_lines <= 30, true)
UNION ALL SELECT review, hunk, 'self', NULL FROM r WHERE enclosing_kind = 'class' AND NOT comment AND recursive
UNION ALL SELECT review, hunk, 'members', NULL FROM r WHERE starts_with(member, 'x1') AND bare""")
def _(ruled):
    figures = lambda nest, lines: F.struct(*[F.lit(0).cast("long").alias(m) if c is None else F.col(c).alias(m) for m, c in zip(rules.FIGURES, (nest, lines, None, None, None, None))])
    delta = lambda name, was, now: F.struct(F.lit(name).alias("name"), figures(*was).alias("was"), figures(*now).alias("now"))
    a, b = ("nest0", "lines0"), ("nest1", "file_lines")
    some = F.when(F.col("bare"), F.array(F.lit("u"))).otherwise(F.array().cast("array<string>"))
    x = ruled.withColumns({"imports": F.array("import"), "members": F.array("member"), "uninitialised": some, "deltas": F.array(delta("f", a, b), delta("g", b, a))})
    x = x.withColumn("grown", CONDITIONS[1].grown())
    found = rules.findings(x, CONDITIONS, ["review", "hunk", "grown"])
    return found.select("review", "hunk", "rule", F.when(F.col("rule") == "grown", F.col("grown")).alias("grown"))


# Callers.

BINDINGS["new_sites"] = "SELECT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS row, l_partkey % 100 AS name, l_suppkey % 3 = 0 AS via_self, concat('f(', l_returnflag, ')') AS text FROM lineitem WHERE l_linenumber % 2 = 0"
BINDINGS["old_sites"] = "SELECT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS row, l_partkey % 100 AS name, l_suppkey % 3 = 0 AS via_self, concat('f(', l_returnflag, ')') AS text FROM lineitem WHERE l_linenumber % 2 = 1"


@register("caller_index", ("old_sites", "new_sites"), """
SELECT n.file, n.row, n.name, n.via_self, EXISTS (SELECT 1 FROM old_sites o WHERE o.file = n.file AND o.name = n.name AND o.via_self = n.via_self AND o.text = n.text) AS untouched FROM new_sites n""")
def _(old, new):
    return contract.caller_index(old, new)


@register("callers", ("old_sites", "new_sites", "orders"), """
SELECT o.o_orderkey AS site, n.file AS at, n.row, EXISTS (SELECT 1 FROM old_sites p WHERE p.file = n.file AND p.name = n.name AND p.via_self = n.via_self AND p.text = n.text) AS untouched
FROM orders o JOIN new_sites n ON n.name = o.o_custkey AND n.via_self = (o.o_orderkey % 2 = 0) WHERE (o.o_orderkey % 2 = 1 OR n.file = o.o_orderkey)""")
def _(old, new, orders):
    site = F.col("o_orderkey")
    return contract.callers(orders.select(site.alias("site"), site.alias("file"), F.col("o_custkey").alias("name"), (site % 2 == 0).alias("method")), contract.caller_index(old, new))


@register("getter_flipped", ("lineitem",), """
WITH o AS (SELECT l_suppkey AS file, l_linenumber AS owner, l_partkey AS name, bool_and(l_returnflag = 'R') AS getter FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2, 3 HAVING count(*) = 1),
n AS (SELECT l_suppkey AS file, l_linenumber % 4 AS owner, l_partkey AS name, bool_and(l_returnflag = 'N') AS getter FROM lineitem WHERE l_linenumber % 4 > 0 GROUP BY 1, 2, 3 HAVING count(*) = 1),
f AS (SELECT n.* FROM n JOIN o ON n.file = o.file AND n.owner = o.owner AND n.name = o.name WHERE n.getter <> o.getter),
u AS (SELECT l_suppkey AS at, l_partkey AS name, l_linenumber > 3 AS called FROM lineitem)
SELECT f.file, f.owner, f.name, CASE WHEN f.getter THEN 'property' ELSE 'method' END AS now, count(*) AS uses, min(u.at) AS first_file FROM f JOIN u ON u.name = f.name AND u.called = f.getter
WHERE u.at = f.file OR EXISTS (SELECT 1 FROM lineitem z WHERE z.l_suppkey = u.at AND z.l_linenumber = f.owner AND z.l_returnflag = 'A') GROUP BY 1, 2, 3, 4""")
def _(x):
    file, name = F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("name")
    old = x.where("l_linestatus = 'O'").select(file, F.col("l_linenumber").alias("owner"), name, (F.col("l_returnflag") == "R").alias("getter"))
    new = x.where("l_linenumber % 4 > 0").select(file, (F.col("l_linenumber") % 4).alias("owner"), name, (F.col("l_returnflag") == "N").alias("getter"))
    reads = x.select(file, F.col("l_orderkey").alias("row"), name, (F.col("l_linenumber") > 3).alias("called"))
    return contract.getter_flipped(old, new, reads, x.where("l_returnflag = 'A'").select(file, F.col("l_linenumber").alias("owner")))


# Notes, shapes and scopes.


@register("note_on", ("hunks", "spans"), """
WITH n AS (SELECT DISTINCT name || '-' || lo || '-' || hi AS note, review, file, CASE WHEN params % 2 = 0 THEN lo + 30 END AS a, CASE WHEN params % 2 = 0 THEN hi + 5 END AS b, lo AS c, lo + 2 AS d FROM spans)
SELECT n.note, n.review, n.file, min(h.hunk) AS hunk FROM n JOIN hunks h ON h.review = n.review AND h.file = n.file
WHERE coalesce(a <= b AND h.o1 >= h.o0 AND a <= h.o1 AND b >= h.o0, false) OR (h.n1 >= h.n0 AND c <= h.n1 AND d >= h.n0) GROUP BY 1, 2, 3""")
def _(hunks, spans):
    was = lambda c: F.when(F.col("params") % 2 == 0, c)
    notes = spans.select(F.concat_ws("-", "name", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("note"), "review", "file", was(F.col("lo") + 30).alias("o0"), was(F.col("hi") + 5).alias("o1"), F.col("lo").alias("n0"), (F.col("lo") + 2).alias("n1"))
    return ranges.note_on(notes.dropDuplicates(), hunks)


@register("def_shape", ("hunks", "spans", "facts"), """
WITH s AS (SELECT DISTINCT review, file, name, lo, hi, params FROM spans), f AS (SELECT review, file, row_no, replace(name, 'n', 'd') AS name, kind FROM facts),
e AS (SELECT s.*, (SELECT count(*) FROM f WHERE f.review = s.review AND f.file = s.file AND f.name = s.name AND f.kind <> 'def' AND f.row_no BETWEEN s.lo AND s.hi) > (SELECT count(*) FROM f WHERE f.review = s.review AND f.file = s.file AND f.name = s.name AND f.kind = 'def' AND s.lo BETWEEN f.row_no AND f.row_no + 3) AS own FROM s),
d AS (SELECT h.review, h.file, h.hunk, max(e.hi - e.lo + 1) AS lines, max(e.params) AS params, bool_or(e.own) AS recursive FROM hunks h JOIN e ON e.review = h.review AND e.file = h.file AND e.lo BETWEEN h.n0 AND h.n1 GROUP BY ALL),
g AS (SELECT h.review, h.file, h.hunk, max(f.row_no % 5) AS nesting FROM hunks h JOIN f ON f.review = h.review AND f.file = h.file AND f.row_no BETWEEN h.n0 AND h.n1 GROUP BY ALL)
SELECT h.review, h.file, h.hunk, coalesce(d.lines, 0) AS lines, coalesce(d.params, 0) AS params, coalesce(g.nesting, 0) AS nesting, coalesce(d.recursive, false) AS recursive
FROM hunks h LEFT JOIN d ON d.review = h.review AND d.file = h.file AND d.hunk = h.hunk LEFT JOIN g ON g.review = h.review AND g.file = h.file AND g.hunk = h.hunk""")
def _(hunks, spans, facts):
    named = facts.withColumn("name", F.regexp_replace("name", "n", "d"))
    declared = named.where("kind = 'def'").select("review", "file", "name", F.col("row_no").alias("lo"), (F.col("row_no") + 3).alias("hi"))
    return ranges.shape(hunks, spans, facts.select("review", "file", "row_no", (F.col("row_no") % 5).alias("depth")), declared, named.where("kind <> 'def'").select("review", "file", "row_no", "name"))


@register("local_definitions", ("lineitem",), """
WITH d AS (SELECT DISTINCT l_orderkey AS grp, l_orderkey * 10 + l_linenumber AS hunk, l_partkey % 3 AS symbol FROM lineitem), l AS (SELECT l_orderkey * 10 + l_linenumber AS hunk, l_partkey % 3 AS symbol, l_linenumber AS lo, l_linenumber + l_suppkey % 50 AS hi FROM lineitem WHERE l_suppkey % 2 = 0)
SELECT d.grp, d.symbol, l.lo, l.hi FROM d JOIN l ON l.hunk = d.hunk AND l.symbol = d.symbol
WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.grp = d.grp AND e.symbol = d.symbol AND NOT EXISTS (SELECT 1 FROM l m WHERE m.hunk = e.hunk AND m.symbol = e.symbol))""")
def _(x):
    hunk, symbol = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hunk"), (F.col("l_partkey") % 3).alias("symbol")
    spans = x.where("l_suppkey % 2 = 0").select(hunk, symbol, F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + F.col("l_suppkey") % 50).alias("hi"))
    return symbols.local_definitions(x.select(F.col("l_orderkey").alias("grp"), hunk, symbol), spans)


# Files that stay.

BINDINGS["touched"] = """
SELECT concat(CASE l_linenumber % 4 WHEN 0 THEN 'src/a' WHEN 1 THEN 'lib/vendor/b' WHEN 2 THEN 'docs/c' ELSE 'src/d' END, CAST(l_orderkey AS VARCHAR(20)), CASE l_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.min.js' WHEN 2 THEN '.rs' ELSE '.md' END) AS path, l_suppkey % 7 AS mark
FROM lineitem
"""
WINNOWED = """WITH d AS (SELECT DISTINCT path FROM touched WHERE mark IN (0, 1, 2)),
y AS (SELECT path, CASE WHEN regexp_matches(path, '/vendor/') OR ends_with(path, '.min.js') THEN 'generated' WHEN NOT starts_with(path, 'src/') OR ends_with(path, '.md') THEN 'globbed' WHEN path IN (SELECT path FROM d) THEN 'declared' END AS dropped FROM (SELECT DISTINCT path FROM touched) t)"""


def winnowed(touched):
    at = lambda v: F.when(F.col("mark") == 0, v[0]).when(F.col("mark") == 1, v[1]).when(F.col("mark") == 2, v[2]).when(F.col("mark") == 3, v[3])
    declared = touched.where("mark < 5").select("path", F.coalesce(at(("linguist-generated", "linguist-generated", "diff", "diff")), F.lit("linguist-generated")).alias("attribute"), F.coalesce(at(("set", "true", "unset", "set")), F.lit("false")).alias("value"))
    return report.winnow(touched.select("path").dropDuplicates(), ["src/*", "!*.md"], declared)


@register("winnow", ("touched",), f"{WINNOWED} SELECT path, dropped FROM y")
def _(touched):
    return winnowed(touched)


@register("winnow_tally", ("touched",), f"{WINNOWED} SELECT count(*) AS seen, count(*) FILTER (dropped = 'generated') AS generated, count(*) FILTER (dropped = 'globbed') AS globbed, count(*) FILTER (dropped = 'declared') AS declared FROM y")
def _(touched):
    return report.tally(winnowed(touched))


# Names.

BINDINGS["modules_named"] = """
SELECT o_orderkey AS id, concat(CASE o_orderkey % 3 WHEN 0 THEN 'src/pkg/m' WHEN 1 THEN 'pkg/m' ELSE 'm' END, CAST(o_custkey % 10 AS VARCHAR(20)), CASE o_orderkey % 4 WHEN 0 THEN '/__init__.py' WHEN 1 THEN '.d.ts' ELSE '.py' END) AS path,
       concat(CASE o_custkey % 4 WHEN 0 THEN './' WHEN 1 THEN '../' WHEN 2 THEN 'pkg.' ELSE 'pkg::' END, 'm', CAST(o_orderkey % 10 AS VARCHAR(20)), CASE o_custkey % 3 WHEN 0 THEN '.js' WHEN 1 THEN '' ELSE '/' END) AS module
FROM orders
"""


@register("module_names", ("modules_named",), r"""
WITH x AS (SELECT *, string_split(regexp_replace(path, '\.[^.]*$', ''), '/') AS p0, split_part(list_extract(string_split(path, '/'), -1), '.', 1) AS stem, regexp_replace(module, '[./]+$', '') AS trimmed FROM modules_named),
y AS (SELECT *, CASE WHEN p0[-1] = '__init__' THEN p0[1:-2] ELSE p0 END AS parts FROM x)
SELECT id, array_to_string(parts, '|') AS parts, regexp_replace(replace(regexp_replace(regexp_replace(module, '^[./]+', ''), '\.(js|py)$', ''), '/', '.'), '^$', '') AS dotted,
ends_with('.' || array_to_string(parts, '.'), '.pkg.m' || (id % 10)) AS named, coalesce(list_filter(regexp_split_to_array(module, '[/.]'), lambda s: s NOT IN ('', 'js', 'ts'))[-1] = stem, false) AS of_file, list_filter(regexp_split_to_array(module, '[./:]'), lambda s: s <> '')[-1] = stem AS of_module,
'pkg.' || stem AS qualified FROM y""")
def _(x):
    parts = text.module_parts(F.col("path"))
    own = F.concat(F.lit("pkg.m"), (F.col("id") % 10).cast("string"))
    return x.select("id", F.array_join(parts, "|").alias("parts"), text.dotted(F.col("module")).alias("dotted"), text.names_module(own, parts).alias("named"), text.names_file(F.col("module"), F.col("path")).alias("of_file"),
                    text.module_matches(F.col("path"), F.col("module")).alias("of_module"), text.qualified_name(text.file_stem(F.col("path")), F.lit("pkg")).alias("qualified"))


@register("symbol_identity", ("lineitem",), """
SELECT l_orderkey AS node, string_agg('n' || (l_partkey % 40) || chr(31) || l_returnflag || chr(31) || CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_linenumber ELSE '' END, chr(30) ORDER BY 'n' || (l_partkey % 40), l_returnflag, CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_linenumber ELSE '' END) AS identity FROM lineitem GROUP BY 1""")
def _(x):
    one = F.struct(F.concat(F.lit("n"), (F.col("l_partkey") % 40).cast("string")).alias("name"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("s"), F.col("l_linenumber").cast("string"))).alias("scope"))
    return x.groupBy(F.col("l_orderkey").alias("node")).agg(text.symbols_identity(F.collect_list(one)).alias("identity"))


# Notices and directives: an order's lines as a hunk of text.

BINDINGS["notices"] = """
SELECT l_orderkey AS review, l_linenumber AS place, concat(CASE l_partkey % 6 WHEN 0 THEN '// Copyright (C) 20' WHEN 1 THEN '# Copyright 2015-20' WHEN 2 THEN '/* SPDX-FileCopyrightText: 20' WHEN 3 THEN '// the above copyright notice ' WHEN 4 THEN '(c) copyright  ' ELSE 'x = ' END,
  CAST(10 + l_suppkey % 15 AS VARCHAR(20)), CASE l_partkey % 4 WHEN 0 THEN ', 2024  Some   One' WHEN 1 THEN '' WHEN 2 THEN ' (c) OTHERS' ELSE ' Some One' END) AS line FROM lineitem
"""


@register("copyright_lines", ("notices",), r"""
WITH x AS (SELECT *, lower(line) AS l FROM notices), y AS (SELECT *, CASE WHEN contains(l, 'spdx-filecopyrighttext:') THEN regexp_extract(l, 'spdx-filecopyrighttext:(.*)$', 1) WHEN contains(l, 'copyright') THEN regexp_extract(l, '^.*?copyright(.*)$', 1) END AS rest FROM x)
SELECT review, line, contains(l, 'spdx-filecopyrighttext') OR regexp_matches(l, 'copyright *([(]c[)]|[0-9])') AS notice, nullif(trim(regexp_replace(ltrim(regexp_replace(ltrim(rest, '0123456789 ,-'), '^[(]c[)]', ''), '0123456789 ,-'), ' +', ' ', 'g')), '') AS holder FROM y""")
def _(x):
    line = F.col("line")
    return x.select("review", "line", text.names_copyright(line).alias("notice"), text.copyright_holder(line).alias("holder"))


BINDINGS["guards"] = """
SELECT review, place, CASE WHEN place = 1 AND k % 3 > 0 THEN '#  ifdef  A // x' WHEN place = last AND k % 3 > 1 THEN '#endif /* A */' WHEN pick = 0 THEN '#ifndef B' WHEN pick = 1 THEN '# else' WHEN pick < 4 THEN '#endif' WHEN pick = 4 THEN '#include <x>' ELSE 'x();' END AS line
FROM (SELECT l_orderkey AS review, l_orderkey % 5 AS k, l_partkey % 7 AS pick, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, count(*) OVER (PARTITION BY l_orderkey) AS last FROM lineitem) x
"""


@register("conditional_directives", ("guards",), r"""
WITH w AS (SELECT *, regexp_extract(line, '^# *([a-z]+)', 1) AS word FROM guards), d AS (SELECT *, CASE WHEN word IN ('ifdef', 'ifndef', 'if') THEN 1 WHEN word = 'endif' THEN -1 ELSE 0 END AS d, word IN ('ifdef', 'ifndef', 'if', 'else', 'elif', 'endif') AS c FROM w),
s AS (SELECT *, sum(d) OVER (PARTITION BY review ORDER BY place) AS depth FROM d),
g AS (SELECT review, bool_and(c) AS all_c, min_by(c, place) AS first, min_by(line, place) AS line, min_by(d, place) = 1 AND coalesce(min(place) FILTER (depth <= 0) = max(place), false) AND max_by(depth, place) = 0 AS whole FROM s GROUP BY review)
SELECT review, '#' || trim(regexp_replace(regexp_replace(regexp_replace(line, '^# *', ''), '(/[*]|//).*$', ''), ' +', ' ', 'g')) AS directive, whole FROM g WHERE first AND (all_c OR whole)""")
def _(x):
    got = x.groupBy("review").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda r: r["line"]).alias("lines"))
    said = classify.conditional_directive(classify.bare(F.col("lines")), F.lit(True))
    return got.select("review", said.alias("s")).where("s is not null").select("review", F.col("s.text").alias("directive"), F.col("s.whole").alias("whole"))


@register("hunk_kind", ("lineitem",), """
WITH x AS (SELECT l_orderkey AS review, l_linenumber AS hunk, l_partkey % 2 = 0 AS code, l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT review, hunk, CASE WHEN p % 23 = 0 THEN 'Edit' WHEN p % 19 = 0 THEN 'Comment' WHEN s % 13 = 0 THEN 'Format' WHEN code AND s % 7 = 0 THEN 'Rename' WHEN code AND s % 5 = 0 THEN CASE WHEN p % 4 = 0 THEN 'Move' ELSE 'Edit' END WHEN code AND p % 11 = 0 THEN 'Move' WHEN code AND p % 7 = 0 THEN 'Reorder'
WHEN code AND s % 11 = 0 THEN 'Extract' WHEN code AND p % 5 = 0 THEN 'Constant' WHEN s % 4 = 0 THEN 'Pattern' WHEN p % 3 = 0 THEN 'Value' ELSE 'Edit' END AS kind FROM x""")
def _(x):
    zero = lambda c, k: F.col(c) % k == 0
    p, s = "l_partkey", "l_suppkey"
    known = F.when(zero(p, 4), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    imports = F.when(zero(s, 5), classify.import_kind(F.array(F.lit("a")), known))
    intent = F.when(zero(s, 4), "Guard").when(zero(s, 3), "NamesLiteral")
    kind = classify.hunk_kind(zero(p, 23), zero(p, 19), zero(s, 13), zero(p, 2), zero(s, 7), imports, zero(p, 11), zero(p, 7), zero(s, 11), zero(p, 5), intent, zero(p, 3))
    return x.select(F.col("l_orderkey").alias("review"), F.col("l_linenumber").alias("hunk"), kind.alias("kind"))


# Narration: the facts of a hunk from an order's line.

BINDINGS["told"] = """
SELECT l_orderkey AS review, l_linenumber AS hunk, CAST(l_partkey % 4 AS BIGINT) AS old_lines, CAST(floor(l_quantity) AS BIGINT) % 7 AS new_lines, l_returnflag = 'R' AS noisy, l_suppkey % 3 = 0 AS import, l_partkey AS p, l_suppkey AS s,
       CASE WHEN l_partkey % 2 = 0 THEN concat('Outer.f', CAST(l_suppkey % 9 AS VARCHAR(20))) END AS home FROM lineitem
"""
SAY = """WITH y AS (SELECT *, CASE p % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'a, b' WHEN 2 THEN 'a, b, c' WHEN 3 THEN 'a, b, c, and 1 more' ELSE '' END AS names, CASE WHEN home IS NULL THEN '' ELSE ' in ' || home END AS loc FROM told)"""


def named(n):
    return F.slice(F.array(*[F.lit(x) for x in "abcd"]), 1, n)


def narrated(told):
    p, s, old, new = F.col("p"), F.col("s"), F.col("old_lines"), F.col("new_lines")
    names = named(F.when(p % 5 == 4, 0).otherwise(p % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    home = narrate.label(F.col("home"))
    no = F.lit(False)
    noise = narrate.noise(F.col("noisy"), F.col("import"), names, no, new, named(F.when(s % 2 == 0, 2).otherwise(0)), s % 7 == 0, s % 5 == 0)
    imports = narrate.imported(F.col("import"), names, F.array(F.lit("a")), F.create_map(F.lit("b"), F.lit("z")), new, s % 4 == 0, s % 2 == 1)
    shift = narrate.switched(F.when(s % 11 == 0, "commented out").when(s % 11 == 1, "uncommented").when(s % 11 == 2, "code to comment"), none, old, home)
    comment = narrate.commented(s % 13 == 0, old, new, home)
    i = F.struct(F.when(p % 7 == 0, "Boundary").when(p % 7 == 1, "Guard").alias("tag"), F.lit("x < 1").alias("old"), F.lit("x <= 1").alias("new"), F.lit("x is None").alias("text"), F.when(s % 2 == 0, "Return").otherwise("out").alias("word"), F.lit(2).alias("count"), no.alias("flag"), none.alias("func"))
    one = narrate.single(F.when(p % 7 == 2, "Num").when(p % 7 == 3, "Arg"), F.when(p % 7 == 2, F.lit("3")).otherwise(""), F.lit(", 5"), home)
    contained = narrate.contained(home, old, new, no, none, narrate.intent(i, home), one)
    shape = narrate.shaped(old == 0, contained, no, none, none, narrate.sized(old, new, F.when(s % 6 == 0, "#ifdef A"), F.when(s % 5 == 0, "below")))
    return told.select("review", "hunk", F.coalesce(noise, imports, shift, comment, shape).alias("said"))


register("narration", ("told",), f"""{SAY},
z AS (SELECT *, CASE WHEN old_lines = 1 THEN '1 line' ELSE old_lines || ' lines' END AS lo, CASE WHEN greatest(new_lines, 1) = 1 THEN '1 line' ELSE new_lines || ' lines' END AS ln, CASE WHEN s % 2 = 1 THEN 're-export' ELSE 'import' END AS noun FROM y),
c AS (SELECT *, CASE WHEN noisy AND NOT (import AND (new_lines > 0 OR names <> '')) THEN CASE WHEN import AND new_lines = 0 AND s % 2 = 0 THEN 'moves import a, b' WHEN s % 7 = 0 THEN 'generated file' WHEN s % 5 = 0 THEN 'copyright notice' ELSE 'formatting only' END
WHEN import AND new_lines > 0 THEN CASE WHEN names = '' THEN noun ELSE CASE WHEN s % 4 = 0 THEN 'moves ' ELSE 'changes ' END || noun || ' ' || names END
WHEN import AND names <> '' THEN CASE p % 5 WHEN 0 THEN 'removes ' || noun || ' a' WHEN 1 THEN 'renames import b → z; removes ' || noun || ' a' WHEN 2 THEN 'renames import b → z; removes ' || noun || ' a, c' ELSE 'renames import b → z; removes ' || noun || ' a, c, d' END
WHEN s % 11 = 0 THEN 'comments out code' || loc WHEN s % 11 = 1 THEN 'uncomments code' || loc WHEN s % 11 = 2 THEN 'replaces ' || lo || ' with ' || CASE WHEN old_lines = 1 THEN 'a comment' ELSE 'comments' END || loc
WHEN s % 13 = 0 THEN CASE WHEN old_lines = 0 THEN 'adds comment' || replace(loc, ' in ', ' to ') WHEN new_lines = 0 THEN 'removes comment' || replace(loc, ' in ', ' from ') ELSE 'edits comment' || loc END
WHEN home IS NOT NULL THEN CASE p % 7 WHEN 0 THEN 'changes boundary x < 1 → x <= 1' || loc WHEN 1 THEN CASE WHEN s % 2 = 0 THEN 'returns early' ELSE 'jumps to out' END || ' when x is None' || loc WHEN 2 THEN 'changes 3 → , 5' || loc WHEN 3 THEN 'adds argument 5' || loc
ELSE CASE WHEN old_lines > 0 OR new_lines <= 3 THEN 'edits ' || home ELSE 'adds ' || new_lines || ' lines to ' || home END END
WHEN s % 6 = 0 AND new_lines = 0 AND s % 5 <> 0 THEN 'removes #ifdef A' WHEN s % 6 = 0 AND old_lines = 0 THEN 'adds #ifdef A'
WHEN new_lines = 0 AND old_lines > 0 THEN CASE WHEN s % 5 = 0 THEN 'replaces ' || lo || ', added below' ELSE 'removes ' || lo END WHEN old_lines = 0 THEN 'adds ' || ln ELSE 'edits ' || ln END AS said FROM z)
SELECT review, hunk, said FROM c""")(narrated)
