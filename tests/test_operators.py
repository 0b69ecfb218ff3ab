from pyspark.sql import Row
from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import classify, graph, model, ranges, report, rules, symbols
from driftlens.sources import patches


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


def test_fnv(spark):
    assert int(one(spark, text.fnv1a(F.col("s")), s="hello")) == 11831194018420276491
    assert int(one(spark, text.fnv1a(F.col("s")), s="")) == 14695981039346656037


def test_names(spark):
    assert one(spark, text.first_sentence(F.col("s")), s="One. Two.") == "One."
    assert one(spark, text.unquote(F.col("s")), s="'a b'") == "a b"
    assert one(spark, text.constant_name(F.col("s")), s="x.MAX_N") and not one(spark, text.constant_name(F.col("s")), s="NULL")
    assert one(spark, text.language(F.col("p"), F.col("t")), p="a/x.C", t="") == "cpp"
    assert one(spark, text.language(F.col("p"), F.col("t")), p="run", t="#!/usr/bin/env -S python3.12\n") == "python"
    assert one(spark, text.language(F.col("p"), F.col("t")), p="run", t="none") is None
    assert one(spark, text.url_fields(F.col("q")), q="a=1+2&b=%41") == {"a": "1 2", "b": "A"}
    holder = text.copyright_holder(F.col("s"))
    assert one(spark, holder, s="// Copyright (C) 2011-2024 Some  One") == "some one" and one(spark, holder, s="no notice") is None
    assert one(spark, text.is_generated(F.col("p")), p="x/vendor/a.c") and not one(spark, text.is_generated(F.col("p")), p="a.c")


def test_order_breaks_cycles(spark):
    nodes = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 2, 5, 0, 1), (1, 3, 0, 0, 2)], "review long, node long, priority long, file long, row_no long")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 2, 3)], "review long, src long, dst long")
    got = [r["node"] for r in graph.reading_order(nodes, edges).orderBy("place").collect()]
    assert got == [2, 1, 3]


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.components(none).count() == graph.levels(none).count() == 0


def test_patch_of_a_new_file(spark):
    d = "diff --git a/n b/n\n--- /dev/null\n+++ b/n\n@@ -0,0 +1,2 @@\n+a\n+b"
    x = spark.createDataFrame([(None, None, d), ("q\n", None, "@@ -1 +1 @@\n-z\n+y")], "old string, new string, diff string")
    rows = {r["new_text"]: r["problem"] for r in patches.sides(x).collect()}
    assert rows == {"a\nb": None, None: "the diff does not apply"}


def test_rules(spark):
    assert rules.problems([{"name": "a", "odd": 1}, {"name": "a"}]) == ["a: given twice", "a: unknown condition odd"]
    kept = rules.layered([[rules.Rule("a"), rules.Rule("b")], [rules.Rule("a", note="n")]], ["b*"])
    assert [(r.name, r.note) for r in kept] == [("a", "n")]


def test_growth_limits(spark):
    figures = lambda n, k: Row(**{m: n if m == "nesting" else k for m in rules.FIGURES})
    x = spark.createDataFrame([Row(key=1, deltas=[Row(name="f", was=figures(1, 0), now=figures(4, 9)), Row(name="g", was=figures(1, 0), now=figures(4, 2))]), Row(key=2, deltas=[Row(name="h", was=figures(4, 9), now=figures(1, 0))])])
    r = rules.Rule("grown", max_nesting_delta=2, max_lines_delta=5)
    assert [(v["key"], v["rule"]) for v in rules.findings(x, [r], ["key"]).collect()] == [(1, "grown")]
    assert [v["g"] for v in x.orderBy("key").select(r.grown().alias("g")).collect()] == ["f: nesting 1 → 4, lines 0 → 9", None]


def test_copyright_notice(spark):
    def said(old, new, o0, o1, n0, n1):
        lines = lambda v: F.array(*[F.lit(t) for t in v]) if v else F.array().cast("array<string>")
        return spark.range(1).select(classify.copyright_notice(lines(old), lines(new), *map(F.lit, (o0, o1, n0, n1)), F.lit("py")).alias("x")).first()["x"]

    a, b, c = "# Copyright 2020 One", "# Copyright 2020-2024 One", "# Copyright 2024 Two"
    assert said([a, "x = 1"], [b, "x = 1"], 1, 1, 1, 1)
    assert not said([a, "x = 1"], [c, "x = 1"], 1, 1, 1, 1)  # a holder is lost
    assert not said(["x = 1", a], ["x = 1", b], 2, 2, 2, 2)  # code above
    assert not said([a, "x = 1"], ["x = 1"], 1, 1, 1, 0)  # nothing stays
    assert said(["x = 1"], [a, "x = 1"], 1, 0, 1, 1)


def test_annotations(spark):
    lines = F.split("s", "\n")
    said = lambda s: one(spark, classify.annotations_only(classify.bare(lines)), s=s)
    assert said("@a\n\n  @b(1)") and not said("@a\ndef f():") and not said("")


def test_comments(spark):
    c = lambda *x: F.array(*[F.lit(v) for v in x])
    row = spark.range(1).select(classify.comment_only(c("# a", "")).alias("a"), classify.shift(c("x()"), c("# x()")).alias("b"), classify.shift(c("// x()"), c("x()")).alias("c")).first()
    assert row["a"] and row["b"] == "commented out" and row["c"] == "uncommented"


def budgeted(pieces, budget):
    """What fits of pieces, by the definition of report.fitted."""
    most, kept, left = budget - 12, "", 0
    for p in pieces:
        if len(kept) + (2 if kept else 0) + len(p) <= most:
            kept += ("; " if kept else "") + p
        else:
            left += 1
    if pieces and not kept:
        head = pieces[0][: most - 1]
        place = head.rfind(" ")
        kept = pieces[0] if len(pieces[0]) <= most else (head[:place].rstrip() if place > most // 2 else head) + "…"
        left -= 1
    return kept + (f"; +{left} more" if left else "")


def test_budget(spark):
    cases = [["aaaa", "bbbb", "cccc"], ["aaaa", "b" * 30, "cc"], ["a" * 50], ["word after word and more words", "x" * 40], [], ["one two three four fi" + "v" * 20, "z"]]
    for budget in (23, 24, 40):
        x = spark.createDataFrame([(c,) for c in cases], "p array<string>").select("p", report.fitted(F.col("p"), budget).alias("t"))
        for r in x.collect():
            assert r["t"] == budgeted(r["p"], budget) and len(r["t"]) <= budget


def test_words_of_identifiers(spark):
    row = spark.createDataFrame([("parseHTTPReply a_b x 12 naïveÉtat v2",)], "t string").select(report.pieces_of(F.col("t")).alias("w")).first()
    assert row["w"] == ["parse", "http", "reply", "naïve", "état", "v2"]


def test_exact_auc(spark):
    rows = [(0.12341, 1, "a"), (0.12342, 0, "a"), (0.5, 1, "a"), (0.5, 0, "a"), (0.9, 1, "b"), (0.1, 0, "b"), (0.95, 0, "b")]
    x = spark.createDataFrame(rows, "score double, label int, g string")

    def wanted(rs):
        pairs = [1.0 if p > q else 0.5 if p == q else 0.0 for p, a, _ in rs if a for q, b, _ in rs if not b]
        return round(sum(pairs) / len(pairs), 6)

    assert model.auc(x.drop("g")).first()["auc"] == wanted(rows)
    assert {r["g"]: r["auc"] for r in model.auc(x, ["g"]).collect()} == {g: wanted([r for r in rows if r[2] == g]) for g in "ab"}


def test_points_in_ranges(spark):
    ranges_ = [(1, 0, k, 130 * k, 130 * k + 70) for k in range(30)] + [(1, 0, 99, 40, 39), (2, 0, 1, 0, 1000)]
    points = [(r, 0, k) for r in (1, 2) for k in range(0, 4000, 7)]
    got = ranges.inside(spark.createDataFrame(points, "review long, file long, row_no long"), "row_no", spark.createDataFrame(ranges_, "review long, file long, hunk long, n0 long, n1 long"), "n0", "n1")
    want = sorted((r, p, h) for r, _, p in points for q, _, h, lo, hi in ranges_ if q == r and lo <= p <= hi)
    assert sorted((x["review"], x["row_no"], x["hunk"]) for x in got.collect()) == want


def test_file_gate(spark):
    d = spark.createDataFrame([(1, 0, 7), (2, 0, 8), (3, 1, 8)], "grp long, file long, symbol long")
    u = spark.createDataFrame([(5, 0, 7), (6, 1, 7), (6, 1, 8)], "grp long, file long, symbol long")
    assert {tuple(r) for r in symbols.edges(d, u).collect()} == {(1, 5, 7), (1, 6, 7)}
    assert {tuple(r) for r in symbols.edges(d, u, cross_file=False).collect()} == {(1, 5, 7)}


def test_token_intents(spark):
    pairs = {("<", "<="): "Boundary", ("==", "!="): "Inverts", ("", "not"): "Inverts", ("3", "MAX_N"): "NamesLiteral", ("", "async"): "Async", ("", "and ok"): "Condition", ("1", "2"): "Value", ("a", "b"): None, (None, None): None}
    x = spark.createDataFrame(list(pairs), "o string, n string").select("o", "n", classify.token_intent(F.col("o"), F.col("n")).alias("i"))
    assert {(r["o"], r["n"]): r["i"] for r in x.collect()} == pairs
