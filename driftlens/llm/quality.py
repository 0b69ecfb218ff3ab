"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

``measured`` adds the figures, ``verdict`` compiles a table of rules over them, ``filtered`` drops what
the rules reject. Everything is a row-wise projection: no exchange, and no state beyond one row.

Defined cases: a null or empty text has no words, so every count is 0 and the base rule rejects it;
repeated rows and null ids pass through as they are; other columns are left alone (``measured`` renames
those that clash, see ``common.apart``); an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import apart, at, documents

#: White space that ends words, and the characters that count as symbols.
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were "
    "le la les de des du et un une en que qui dans pour sur est au par elle il "
    "der die das und ein eine zu den von mit ist nicht auf im dem es "
    "el los las del y por con para su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= value <= high; None leaves that side open."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are over n_words, n_lines or n_chars and only judged after the base rule.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 1.5, 25.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.01, None),
    Rule("exclamations_per_word", "n_exclamations / n_words", None, 0.5),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
)
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COLUMNS = ("n_stop_words", "n_exclamations", "n_lines")


def let(value: Column, body) -> Column:
    """body over value computed once: inside a higher-order function Spark would else compute it for each element."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), "")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are sorted by (hash, start); neighbours with the same hash and the same words are repeats, and
    each repeated start covers up to the next one. Sorting keeps it n log n for any text.
    """

    def same(w, a, b):
        return (a["h"] == b["h"]) & (w[a["i"]] == w[b["i"]]) & (w[a["i"] + 1] == w[b["i"] + 1]) & (w[a["i"] + 2] == w[b["i"] + 2])

    def covered(starts):
        return F.aggregate(
            F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        )

    def repeated(w, s):
        starts = F.transform(
            s,
            lambda e, k: F.when(
                F.coalesce((k > 0) & same(w, e, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(w, e, F.get(s, k + 1)), F.lit(False)), e["i"]
            ),
        )
        return let(F.sort_array(F.filter(starts, lambda x: x.isNotNull())), covered)

    def windows(w):
        at_ = F.sequence(F.lit(0), F.size(w) - 3)
        return F.sort_array(F.transform(at_, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(windows(w), lambda s: repeated(w, s))))


def figures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    spaceless = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    per_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    per_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "w": per_words,
        "l": per_lines,
        "word_chars": F.char_length(spaceless).cast("long"),
        "n_symbols": count_of(text, SYMBOLS).cast("long"),
        "n_exclamations": count_of(text, "!").cast("long"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules=RULES) -> Column:
    """The table of rules as one boolean column over the figures; a ratio over nothing passes."""
    ok = F.lit(True)
    for r in rules:
        value = F.expr(r.value.replace(" / ", " / nullif(") + ", 0)") if " / " in r.value else F.expr(r.value)
        for bound, holds in ((r.low, value >= F.lit(r.low)), (r.high, value <= F.lit(r.high))):
            if bound is not None:
                ok = ok & F.coalesce(holds, F.lit(True))
    return ok


def measured(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents with all figures, base_failed and kept."""
    own = (*BASE_COLUMNS, *MORE_COLUMNS, "base_failed", "kept")
    place = at(docs, "text")
    docs = apart(docs, *own, "_m")
    text = docs.columns[place]
    rest = [F.col(f"`{c}`") for c in docs.columns]
    x = docs.select(*rest, F.struct(*[v.alias(k) for k, v in figures(F.col(f"`{text}`").cast("string")).items()]).alias("_m"))
    x = x.select(
        *rest,
        F.col("_m.w.n_words").alias("n_words"),
        F.col("_m.word_chars").alias("word_chars"),
        F.col("_m.n_symbols").alias("n_symbols"),
        F.col("_m.l.n_dup_lines").alias("n_dup_lines"),
        F.col("_m.w.n_repeat_words").alias("n_repeat_words"),
        F.col("_m.w.n_stop_words").alias("n_stop_words"),
        F.col("_m.n_exclamations").alias("n_exclamations"),
        F.col("_m.l.n_lines").alias("n_lines"),
    )
    return x.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: doc_id, the base figures, base_failed, kept."""
    return measured(documents(docs), rules).select("doc_id", *BASE_COLUMNS, "base_failed", "kept")


def filtered(docs: DataFrame, rules=RULES) -> DataFrame:
    """The kept documents with their own columns only."""
    names = docs.columns
    own = (*BASE_COLUMNS, *MORE_COLUMNS, "base_failed", "kept", "_m")
    places = [f"_{i}" for i in range(len(names))]
    text = at(docs, "text")
    places[text] = "text"
    x = measured(docs.toDF(*places), rules).where("kept")
    return x.drop(*own).toDF(*names)


def oracle(rules=RULES) -> str:
    """The same as DuckDB SQL over documents."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    holds = " AND ".join(
        f"coalesce({r.value.replace(' / ', '::DOUBLE / nullif(') + ', 0)'} {op} {bound}, true)" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None
    )
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid
), f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations,
         len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN cov USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {holds}) AS kept
FROM f
"""
