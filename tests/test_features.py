from pyspark.sql import functions as F

from driftlens.functions.text import fnv1a
from driftlens.operators import edits, model, report
from driftlens.sources import history, patches


def test_schema_hash_is_fnv(spark):
    names = edits.columns()
    text = "v1\n" + "\n".join(names)
    got = spark.createDataFrame([(text,)], "s string").select(fnv1a(F.col("s")).alias("h")).first()["h"]
    assert f"{int(got):016x}" == edits.schema_hash(names) != edits.schema_hash(names[1:])
    assert edits.fingerprint([(1.0, 2.0)]) != edits.fingerprint([(1.0, 2.1)])


def test_head_learns(spark):
    rows = spark.range(200).select((F.col("id") % 10).cast("double").alias("a"), F.lit(1.0).alias("b"), ((F.col("id") % 10) > 4).cast("int").alias("label"))
    weights, bias = edits.fit_head(rows, ["a", "b"])
    scored = model.logistic(rows.withColumn("v", F.array("a", "b")), "v", weights, bias).select("label", F.col("p").alias("score"))
    assert model.auc(scored).first()["auc"] == 1.0


def test_joined_groups(spark):
    groups = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "grp long, node long")
    sets = spark.createDataFrame([(10, 10), (30, 10)], "node long, cluster long")
    assert {tuple(r) for r in edits.joined_groups(groups, sets).select("node", "grp").collect()} == {(10, 1), (20, 2), (30, 1)}


def test_same_edits_need_two_homes_and_eight_letters(spark):
    rows = [(1, 1, "long enough"), (2, 2, "long enough"), (3, 1, "one home only"), (4, 1, "one home only"), (5, 1, "x=1"), (6, 2, "x=1")]
    got = edits.same_edits(spark.createDataFrame(rows, "node long, home long, edit string"))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1)}


def test_ranks_over_ranges(spark):
    x = report.ranked(spark.range(1000).select((F.lit(999) - F.col("id")).alias("v")), ["v"])
    assert x.where("rank <> v").isEmpty() and x.count() == 1000
    assert report.ranked(spark.range(0).select(F.col("id").alias("v")), ["v"]).count() == 0


def test_waves_of_lines_and_json(spark):
    blame = spark.createDataFrame([("a", "new", 1, "s1")], "path string, side string, line int, sha string")
    waves = spark.createDataFrame([("s1", 3)], "sha string, wave int")
    assert history.line_waves(blame, waves).first()["wave"] == 3
    assert patches.json_rows(spark.createDataFrame([(1, None)], "a int, b string"), F.lit("k")).first()["json"] == '{"a":1}'
