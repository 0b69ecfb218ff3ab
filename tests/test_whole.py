"""Queries run on whole tables: results against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from driftlens.operators import graph
from driftlens.plans import bindings
from driftlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def lines(spark, rows):
    """A lineitem table of (l_orderkey, l_linenumber, l_partkey, l_suppkey)."""
    x = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long")
    return x.withColumns({"l_quantity": F.lit(1.0), "l_extendedprice": F.lit(1.0), "l_returnflag": F.lit("A"), "l_linestatus": F.lit("O")})


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        for table in ("lineitem", "part"):  # the loader takes l_partkey for a mention of part
            lines(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return str(tmp_path)

    return write


def test_reading_order_has_far_edges(spark, folder):
    # 900 defines 7 and comes first by priority only if the edge to 303 is lost.
    sf = folder([(900, 1, 7, 1), (302, 1, 8, 1), (302, 2, 7, 1)])
    got = [r["node"] for r in QUERIES["reading_order"](spark, sf).orderBy("place").collect()]
    assert got == [900, 302]


def test_reading_order_puts_definitions_first(spark):
    place = {r["node"]: r["place"] for r in QUERIES["reading_order"](spark, SF).collect()}
    defines, uses = (bindings.load(spark, SF, n).collect() for n in ("defines", "uses"))
    by = {}
    for d in defines:
        by.setdefault(d["symbol"], set()).add(d["grp"])
    edges = {(min(by[u["symbol"]]), u["grp"]) for u in uses if len(by.get(u["symbol"], ())) == 1}
    inside = [(a, b) for a, b in edges if a < b and a // 1000 == b // 1000 and b - a >= 400]
    back = {(b, a) for a, b in edges}
    assert inside and all(place[a] < place[b] for a, b in inside if not back & {(a, b)})


def whole_edges(spark):
    defines, uses = (bindings.load(spark, SF, n).collect() for n in ("defines", "uses"))
    by = {}
    for d in defines:
        by.setdefault(d["symbol"], []).append(d["grp"])
    return {(by[u["symbol"]][0], u["grp"]) for u in uses if len(by.get(u["symbol"], ())) == 1 and by[u["symbol"]][0] < u["grp"]}


def got(spark, name, sf=SF):
    return {tuple(r) for r in QUERIES[name](spark, sf).collect()}


def reach(edges):
    """node -> all that it leads to."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for a in out:
        open_, seen = [a], set()
        while open_:
            for b in out.get(open_.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    open_.append(b)
        found[a] = seen
    return found


def test_whole_clusters(spark):
    edges = whole_edges(spark)
    assert any(b - a >= 400 for a, b in edges)
    both = reach(edges | {(b, a) for a, b in edges})
    assert got(spark, "clusters") == {(a, min(r | {a})) for a, r in both.items()}


def test_whole_degrees_levels_and_coverage(spark):
    edges = whole_edges(spark)
    nodes = {x for e in edges for x in e}
    assert got(spark, "degrees") == {(x, sum(a == x for a, _ in edges), sum(b == x for _, b in edges)) for x in nodes}
    level = {}
    for x in sorted(nodes):
        level[x] = max((level[a] + 1 for a, b in edges if b == x), default=0)
    assert got(spark, "dependency_levels") == set(level.items())
    at = {r["o_orderkey"]: r["o_orderdate"] for r in bindings.load(spark, SF, "orders").where("o_orderstatus <> 'P'").collect()}
    out_of_order = sum(b in at and (a not in at or at[a] > at[b]) for a, b in edges)
    assert got(spark, "review_coverage") == {(len(edges), sum(a in at and b in at for a, b in edges), out_of_order)}


def test_whole_closures_and_pair_relation(spark):
    edges = whole_edges(spark)
    down = reach(edges)
    assert any(a % 10 for a in down)
    assert got(spark, "downstream_closure") == {(a, b) for a, r in down.items() for b in r}
    assert got(spark, "upstream_closure") == {(b, a) for a, r in down.items() for b in r}
    pairs = {(a, a + 100) for a, _ in edges} | {(b, a) for a, b in edges}
    said = lambda a, b: "before" if b in down.get(a, ()) else "after" if a in down.get(b, ()) else "free"
    assert got(spark, "pair_relation") == {(a, b, said(a, b)) for a, b in pairs}


def test_whole_review_has_every_change(spark):
    x = bindings.load(spark, SF, "lineitem").select("l_orderkey").distinct().count()
    assert QUERIES["whole_review"](spark, SF).select("review", "file").distinct().count() == x


def test_whole_tables_of_lines(spark):
    x = bindings.load(spark, SF, "lineitem").collect()
    key = lambda r: (r["l_suppkey"] % 50, r["l_partkey"] * 10 + r["l_linenumber"])
    was, now = ({key(r) for r in x if (r["l_linestatus"] == "O") == old} for old in (True, False))
    came = {}
    for file, name in now - was:
        came.setdefault(name, set()).add(file)
    found = {(f, n, n // 10 % 7, *(came.get(n, set()) - {f})) for f, n in was - now if len(came.get(n, set()) - {f}) == 1}
    assert got(spark, "moves") == found

    methods = {(r["l_orderkey"], r["l_partkey"] % 50) for r in x}
    abstract = {(r["l_suppkey"], r["l_partkey"] % 50) for r in x if r["l_linenumber"] == 1}
    subs = {(r["l_suppkey"], r["l_orderkey"]) for r in x if r["l_linenumber"] == 2}
    by = {}
    for b, n in abstract:
        by.setdefault(b, set()).add(n)
    assert got(spark, "unimplemented_abstract") == {(b, o, n) for b, o in subs for n in by.get(b, ()) if (o, n) not in methods}

    homes = {}
    for r in x:
        homes.setdefault(r["l_partkey"], set()).add(r["l_orderkey"])
    links = {(min(h), o) for h in homes.values() for o in h if o != min(h)}
    both = reach(links | {(b, a) for a, b in links})
    assert got(spark, "same_edits") == {(a, min(r | {a})) for a, r in both.items()}


def test_whole_extractions(spark):
    x = bindings.load(spark, SF, "lineitem").collect()
    old, new = {}, {}
    for r in x:
        line = r["l_partkey"] % 60
        if r["l_returnflag"] == "A":
            old.setdefault((r["l_suppkey"] % 20, r["l_linenumber"]), set()).add(line)
        if r["l_returnflag"] == "R":
            new.setdefault((r["l_suppkey"] % 20, r["l_linenumber"] + (10 if r["l_orderkey"] % 2 == 0 else 0)), set()).add(line)
    want = set()
    for (file, name), body in new.items():
        if (file, name) in old or len(body) < 3:
            continue
        gave = sorted((-len(body & (o - new[f, n])), n) for (f, n), o in old.items() if f == file and (f, n) in new)
        gave = [(-k, n) for k, n in gave if -k >= 3 and -2 * k >= len(body)]
        if gave:
            want.add((file, name, gave[0][1], gave[0][0]))
    assert got(spark, "extractions") == want


def way_back(edges, a, b):
    """Edges of the shortest cycle over the edge a to b."""
    front, seen, k = {b}, set(), 1
    while front:
        front, k = {d for s, d in edges if s in front} - seen, k + 1
        if a in front:
            return k
        seen |= front


def test_long_import_cycles(spark):
    edges = [(k, k + 1) for k in range(12)] + [(12, 0), (3, 20), (20, 20), (21, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    found = {tuple(r) for r in graph.import_cycles(df, df).collect()}
    assert found == {(a, b, k) for a, b in edges if (k := way_back(edges, a, b))} and (12, 0, 13) in found
    assert graph.import_cycles(df, df.limit(0)).count() == 0


def test_whole_import_cycles(spark):
    x = bindings.load(spark, SF, "lineitem").collect()
    edges = {(r["l_suppkey"] % 97, r["l_partkey"] % 97) for r in x}
    assert got(spark, "import_cycles") == {(a, b, k) for a, b in edges if a > b and (k := way_back(edges, a, b))}


def test_whole_text_functions(spark):
    texts = {r["doc_id"]: r["text"] for r in bindings.load(spark, SF, "documents").collect()}
    assert max(map(len, texts.values())) > 80
    want = {d: re.sub(r"[ \t\n\v\f\r]+", " ", t).strip(" ") for d, t in texts.items()}
    assert {r["doc_id"]: r["squeezed"] for r in QUERIES["text_functions"](spark, SF).collect()} == want
