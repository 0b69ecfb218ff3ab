from driftlens.sources import history, rulefiles


def test_log_follows_renames(spark):
    text = "\x1e300\tfix: b\nM\tc.py\n\x1e200\trename\nR100\tb.py\tc.py\n\x1e100\tadd\nA\tb.py\nM\tx.py\n"
    x = history.followed(history.log(spark.createDataFrame([(1, text)], "review long, text string")))
    got = {(r["time"], r["path"], r["current"]) for r in x.collect()}
    assert got == {(300, "c.py", "c.py"), (200, "c.py", "c.py"), (100, "b.py", "c.py"), (100, "x.py", "x.py")}
    from pyspark.sql import functions as F

    counts = {(r["current"], r["churn"], r["fixes"]) for r in history.within(x.withColumn("at", F.lit(300)), "at", cap=2).collect()}
    assert counts == {("c.py", 2, 1), ("x.py", 1, 0)}


def test_status(spark):
    text = " M a.py\x00R  new.py\x00old.py\x00?? u.py\x00"
    got = {(r["state"], r["path"]) for r in history.status(spark.createDataFrame([(1, text)], "review long, text string")).collect()}
    assert got == {("M", "a.py"), ("R", "new.py"), ("??", "u.py")}


def test_rule_files(tmp_path):
    (tmp_path / "base.toml").write_text('[levels]\na = "note"\n[[rule]]\nname = "a"\nmax-lines = 3\nwarn = "w"\n[[rule]]\nname = "b"\nnoise = true\n')
    (tmp_path / "top.toml").write_text('include = ["base.toml", "gone.toml"]\ndisable = ["b*"]\ncatalog = false\n[[rule]]\nname = "a"\nwhen = { path = "*.py", odd = 1 }\nnote = "n"\n')
    got = rulefiles.read(tmp_path / "top.toml")
    assert [(r.name, r.path, r.note, r.max_lines) for r in got.rules] == [("a", "*.py", "n", None)]
    assert got.levels == {"a": "note"} and got.catalog is False
    assert got.problems == ["a: unknown condition odd", "gone.toml: FileNotFoundError"]
    assert rulefiles.read(tmp_path / "base.toml").rules[1].hides
