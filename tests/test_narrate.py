"""Lines on hunks, on facts made by hand."""

from pyspark.sql import functions as F

from driftlens.functions import text
from driftlens.operators import narrate


def said(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*x):
    return F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")


def gone(*x):
    one = [F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.lit(p).cast("string").alias("path")) for k, n, p in x]
    return F.array(*one)


def pattern(tag, old="", new="", text="", word="", count=1, flag=False, func=None):
    values = {"tag": tag, "old": old, "new": new, "text": text, "word": word, "count": count, "flag": flag, "func": func}
    return F.struct(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in values.items()])


def test_lists_and_labels(spark):
    assert said(spark, narrate.listed(arr("a", "b", "c"))) == "a, b, c"
    assert said(spark, narrate.listed(arr("a", "b", "c", "d", "e"))) == "a, b, c, and 2 more"
    assert said(spark, narrate.listed(arr())) is None
    assert said(spark, narrate.label(F.lit('describe "x" > it "fails"'))) == 'it "fails"'
    assert said(spark, narrate.label(F.lit("Project > Install"))) == "Project > Install"
    assert len(said(spark, narrate.label(F.lit("n" * 80)))) == 60


def test_quotes(spark):
    un = lambda s: said(spark, text.unquote(F.lit(s)))
    assert un("'\"a\"'") == "a" and un('say "hi"') == 'say "hi"' and un('"') == '"' and un("''") == ""
    assert said(spark, text.quoted(F.lit('a"b'))) == "'a\"b'" and said(spark, text.quoted(F.lit("ab"))) == '"ab"'


def test_removals(spark):
    assert said(spark, narrate.removals(gone(("def", "f", None), ("def", "f", None), ("import", "m", None)))) == "removes f; removes import m"
    assert said(spark, narrate.removals(gone(("moved", "f", "a.py"), ("moved", "g", "b.py"), ("moved", "h", "a.py")))) == "moves f, h to a.py; moves g to b.py"
    many = gone(("def", "f", None), ("section", "s", None), ("import", "m", None), ("moved", "g", "b.py"))
    assert said(spark, narrate.removals(many)) == "removes f; removes section s, and 2 more"
    assert said(spark, narrate.removals(F.filter(many, lambda r: F.lit(False)))) is None


def test_patterns(spark):
    home = F.lit("A.f")
    say = lambda *a, **k: said(spark, narrate.intent(pattern(*a, **k), home))
    assert say("Guard", text="x" * 41, word="Raise") == "adds a guard clause to A.f"
    assert say("WrapsTry", text="", count=3, word="try", new="KeyError") == "wraps 3 lines in try KeyError in A.f"
    assert say("Condition", text="b > 1", word="narrows", flag=True) == "narrows condition with b > 1 in A.f"
    assert say("Condition", text="b > 1", word="widens") == "widens condition by dropping b > 1 in A.f"
    assert say("Boundary", old="(", new=")", text="<", word="<=") == "changes boundary < → <= in A.f"
    assert say("Inverts", old="(", new=")") == "inverts condition in A.f"
    assert say("NamesLiteral", old="(", new="LIMIT") == "replaces a literal with constant LIMIT in A.f"
    assert say("DefaultParam", text="k", func="B.g") == "adds optional parameter k to g in A.f"
    assert say("Async", flag=True, func="f") == "makes A.f async"
    assert say("Async", func=None) == "makes a callback synchronous in A.f"
    assert say("SwapsCall", old="a", new="b") == "calls b instead of a in A.f"
    assert say("ReplacedByCall", new="b", word="loop") == "replaces a loop with a call to b in A.f"
    assert say("None") is None


def test_single_and_value(spark):
    home = F.lit("f")
    say = lambda r, o, n: said(spark, narrate.single(F.lit(r), F.lit(o), F.lit(n), home))
    assert say("Str", "'a'", "'b'") == 'changes "a" → "b" in f' and say("Str", "'-'", "'b'") == "changes a string in f"
    assert say("Ident", "a", "b") == "replaces a with b in f" and say("Arg", "k, ", "") == "removes argument k in f" and say("Num", "", "3") is None
    value = lambda left, o, n: said(spark, narrate.value(arr("M.LIMIT"), F.lit(left), F.lit("Num"), F.lit(o), F.lit(n)))
    assert value("LIMIT = ", "30", "60") == "changes M.LIMIT: 30 → 60" and value("OTHER = ", "30", "60") is None and value("LIMIT = ", "30", "30") is None


def test_shapes(spark):
    no, none, three = F.lit(False), F.lit(None).cast("string"), F.lit(3)
    member = lambda o, n, where: said(spark, narrate.members(arr("adds a", "removes b", "adds c"), F.lit(o), F.lit(n), no, where))
    assert member(0, 2, none) == "adds a; adds c" and member(2, 0, none) == "removes b" and member(2, 0, F.lit("below")) is None and member(1, 1, none) is None
    block = lambda d: said(spark, narrate.contained(F.lit("f"), F.lit(0), three, no, F.lit(d), none, none))
    assert block("#ifdef A") == "adds #ifdef A to f" and block("#if A \\") == "adds an #if block to f"
    assert said(spark, narrate.contained(F.lit("f"), F.lit(0), three, F.lit(True), none, none, none)) == "adds f"
    assert said(spark, narrate.shaped(no, none, F.lit(True), F.lit("removes f"), none, F.lit("x"))) == "deletes the file"
    assert said(spark, narrate.shaped(no, none, no, F.lit("removes f"), none, F.lit("x"))) == "removes f"
    assert said(spark, narrate.switched(F.lit("code to comment"), F.lit("removes f"), three, none)) == "removes f, replaced by comments"
