"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised to their words (A-Z lower-cased, words of digits, a-z and non-ASCII characters) joined by
single spaces. A pattern is a window of WINDOW words of an item with a space at both ends (an item with
fewer words is one window); one scan of a document's normalised text finds every occurrence of every window. Hits
are mapped to words and, where there are any, to code point offsets of the original text.

The patterns are the benchmark's, not the documents', and are broadcast. If they exceed BLOCK_BYTES they are cut into
blocks, each scanned with its own automaton against all documents, with a stored table between. A worker holds one
automaton, a batch of texts bounded by bytes (a longer text is a batch alone) and the hits of one text.

Defined cases: a null or empty text, document or item, has no words: no hits, no windows; repeated items and
items with equal windows are all named; a null item id is named ``null``; rows are kept whatever their id; an
empty benchmark hits nothing; an empty table gives an empty table; clashing columns see ``common.apart``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.llm.common import LONG, STRING, apart, at, pick, stored, text_mapped

WINDOW = 10
#: Bytes of patterns in one automaton; a pattern byte is a node at most.
BLOCK_BYTES = 4_000_000
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
NORMAL = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("lo", LONG), T.StructField("hi", LONG)]))
FIELDS = {"n_words": LONG, "n_hit": LONG, "hits": SPANS, "items": T.ArrayType(STRING)}


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def windows(text: bytes | None, size: int = WINDOW) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def blocks(benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[dict[bytes, list[str]]]:
    """Windows and the ids of their items, in blocks of bounded bytes, of which the driver holds two. Equal windows of a block
    share a pattern; at least one block comes."""
    out, held = {}, 0
    rows = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    for r in rows.distinct().toLocalIterator():
        for w in windows(r["text"].encode() if r["text"] else None, size):
            if held >= block_bytes:
                yield out
                out, held = {}, 0
            out.setdefault(w, []).append(r["item"])
            held += len(w) + len(r["item"])
    yield out


def automaton(patterns: dict[bytes, list[str]]):
    """Keys are bytes read as Latin-1, so that a character is a byte."""
    built = ahocorasick.Automaton()
    for w, items in patterns.items():
        built.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, items))
    if patterns:
        built.make_automaton()
    return built


def spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code point offsets of the original text: normalising keeps byte places."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    raw = np.frombuffer(text, np.uint8)
    code_points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"lo": int(code_points[places[a][0]]), "hi": int(code_points[places[b - 1][1]])} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def scan(text: bytes | None, built) -> tuple[int, np.ndarray | None, set[str]]:
    words = words_of(text)
    if not words or not len(built):
        return len(words), None, set()
    line = b" " + b" ".join(words) + b" "
    found = list(built.iter(line.decode("latin-1")))
    if not found:
        return len(words), None, set()
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    last = np.searchsorted(gaps, [e for e, _ in found])
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, last, -1)
    np.add.at(edge, last - [n for _, (n, _) in found], 1)
    lists = {id(items): items for _, (_, items) in found}
    return len(words), np.cumsum(edge[:-1]) > 0, {i for items in lists.values() for i in items}


_BUILT: dict[str, object] = {}


def ready(name: str, patterns) -> object:
    """One automaton for each worker; name: of the block of patterns."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = automaton(patterns.value)
    return _BUILT[name]


def scanned(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """The documents with n_words, n_hit, hits (spans of the original) and items (sorted ids)."""
    place = at(docs, "text")
    docs = apart(docs, *FIELDS, "_text")
    text, x, names = docs.columns[place], docs, [n for k, n in enumerate(docs.columns) if keep_text or k != place]
    if docs.schema.fields[place].dataType != STRING:
        x = docs.withColumn("_text", F.col(f"`{text}`").cast("string"))
        x, text = x if keep_text else x.drop(text), "_text"
    n, coming = 0, blocks(benchmark, size, block_bytes)
    patterns = next(coming)
    while patterns is not None:
        after = next(coming, None)
        sent, name = docs.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex

        def make(sent=sent, name=name):
            built = ready(name, sent)

            def run(texts):
                out = ([], [], [], [])
                for t in texts:
                    n, hit, items = scan(t, built)
                    row = (n, 0, [], []) if hit is None else (n, int(hit.sum()), spans(t, hit), sorted(items))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                return out

            return run

        fields = {"n_words": LONG, f"_n{n}": LONG, f"_h{n}": SPANS, f"_i{n}": T.ArrayType(STRING)}
        alone = n == 0 and after is None
        x = text_mapped(x.drop("n_words"), text, make, fields, [c for c in x.columns if c != "n_words" and (not alone or c in names)])
        n, patterns = n + 1, after
        x = x if after is None else stored(x, "decontam")
    if n == 1:
        return x.withColumnsRenamed({"_n0": "n_hit", "_h0": "hits", "_i0": "items"}).select(*[F.col(f"`{c}`") for c in names], *FIELDS)
    return several(x, names, text, n)


def several(x: DataFrame, names: list[str], text: str, n: int) -> DataFrame:
    """Hits of several automata as one: runs are merged and words counted by the runs' words."""
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"_i{k}") for k in range(n)]))))
    spans_ = F.array_sort(F.flatten(F.array(*[F.col(f"_h{k}") for k in range(n)])))
    merged = F.aggregate(
        spans_,
        F.lit([]).cast(SPANS),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["lo"] <= F.element_at(acc, -1)["hi"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), F.greatest(F.element_at(acc, -1)["hi"], s["hi"]).alias("hi")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    x = x.select(*[F.col(f"`{c}`") for c in names], "n_words", merged.alias("hits"), items.alias("items"), F.col(f"`{text}`").alias("_text"))
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    counted = F.aggregate("hits", F.lit(0).cast("long"), lambda t, s: t + F.regexp_count(F.lower(F.substring(F.col("_text"), (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int"))), F.lit(word)))
    return x.withColumn("n_hit", counted).select(*[F.col(f"`{c}`") for c in names], *FIELDS)


def items_digest(items: Column) -> Column:
    return F.sha2(F.encode(F.array_join(F.array_sort(items), ","), "UTF-8"), 256)


def judged(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits, one row per document."""
    x = scanned(pick(docs, "doc_id", "text"), benchmark, keep_text=False, **how)
    return x.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "hits")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without a hit, their own columns only."""
    names = docs.columns
    places = [f"_{k}_" for k in range(len(names))]
    places[at(docs, "text")] = "text"
    return scanned(docs.toDF(*places), benchmark, **how).where("n_hit = 0").drop(*FIELDS).toDF(*names)
