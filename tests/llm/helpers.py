"""Brute-force versions of the operators' contracts, and odd tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, "x"),
    (2, "", "x"),
    (3, " \n\t ", "y"),
    (4, "one two", "y"),
    (5, " ".join(f"w{k}" for k in range(20000)), "z"),
    (6, "same words here again and more " * 30, "z"),
    (6, "same words here again and more " * 30, "z"),
    (None, "a text without an id", None),
    (7, "same words here again and more " * 30, "z"),
    (8, "<|endoftext|> 'S É́ 日本\n\n x  y\t<|startoftext|> </s>[INST]", None),
]
SCHEMA = "doc_id long, text string, source string"


def odd(spark, **clash):
    df = spark.createDataFrame(ODD, SCHEMA)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(value).alias(name) for name, value in clash.items()])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return (text or "").encode().split()


def fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(items, near):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if near(items[a], items[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(items))]


def substring(docs, window):
    split = [(d, words(t)) for d, t in docs]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = True
        out.append((d, len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def contaminated(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = terms(t)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i) if i is not None else "null")
    out = []
    for d, t in docs:
        w, hit, found = terms(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def pairs(df):
    return [(r[0], r[1]) for r in df.collect()]
