"""Toxicity: a convolutional text classifier trained in numpy.

Words (A-Z lower-cased; digits, a-z, non-ASCII characters) get the sum of two hashed embeddings, so that two words share
a vector only if both halves of their hash agree. Filters of several widths run over the words, the largest
response of each filter over the whole text is pooled, and a linear layer gives the logit. Thresholds are
calibrated by language, as guessed from the text's own function words, on rows left out of the fit; the score moves
each language's threshold to THRESHOLD.

Fitting uses a bounded sample: at most PER_CLASS labelled ids of each class, the first by a hash of the id, as far as they have
a text of at most SAMPLE_BYTES. It runs on the driver over hashed words only. Scoring reads every whole text in pieces of PIECE words
and is one pass without exchange; after fitting, a filter's response is a sum of table rows.

Defined cases: null and empty texts have no words and get the score of the padding alone; texts shorter than a filter are
padded; repeated rows score alike; a null doc_id is held out of the labels and not ``held_out``; without
labels of both classes every score is 0; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import BINARY, DOUBLE, documents, pick, text_mapped
from driftlens.llm.decontam import NORMAL

BUCKETS = 1 << 16
DIMENSIONS = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
PER_CLASS = 2500
SAMPLE_BYTES = 100_000
EPOCHS = 8
BATCH = 128
RATE = 0.05
SEED = 7
#: Words of fewer texts of the sample are left out before the filters, as are words that the sample lacks.
MIN_TEXTS = 4
#: Share of words that a training step hides, so that one telling word is enough.
HIDDEN = 0.3
THRESHOLD = 0.3
#: Words scored at once.
PIECE = 1 << 15
#: Function words that tell a language; the first list is English, then French, German, Spanish.
LANGUAGES = (
    "the of and to is that it was with be by this are from which have",
    "le les des du et un une que qui dans pour sur au par elle il",
    "der die das und ein eine zu den von mit ist nicht auf dem",
    "el los las del y con para su lo como se es al por",
)


def hashed(text: bytes | None) -> np.ndarray:
    words = text.translate(NORMAL).split() if text else []
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def language_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of function words of one language only, and their languages."""
    known: dict[int, int] = {}
    shared = set()
    for k, words in enumerate(LANGUAGES):
        for w in words.split():
            h = zlib.crc32(w.encode())
            if known.setdefault(h, k) != k:
                shared.add(h)
    keys = np.array(sorted(set(known) - shared), np.uint32)
    return keys, np.array([known[int(k)] for k in keys], np.int64)


def language(hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> int:
    """The language with most function words; the first where there are none."""
    keys, names = table
    place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return int(np.bincount(names[place[keys[place] == hashes]], minlength=len(LANGUAGES)).argmax())


@dataclass
class Model:
    left: np.ndarray  # embedding of a hash's low half
    right: np.ndarray  # embedding of its high half
    filters: list[np.ndarray]  # for each width: (width, DIMENSIONS, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    cuts: np.ndarray  # logit at which a language's rows become positive
    known: tuple[np.ndarray, np.ndarray]  # for each half the values that a known word has

    @classmethod
    def fresh(cls) -> Model:
        r = np.random.default_rng(SEED)
        table = lambda: r.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
        filters = [r.normal(0, (w * DIMENSIONS) ** -0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = len(WIDTHS) * FILTERS
        return cls(table(), table(), filters, np.zeros(n, np.float32), r.normal(0, 0.3, n).astype(np.float32), 0.0, np.zeros(len(LANGUAGES)), (np.ones(BUCKETS, bool), np.ones(BUCKETS, bool)))

    def only_known(self, hashes: np.ndarray) -> np.ndarray:
        return hashes[self.known[0][hashes & (BUCKETS - 1)] & self.known[1][hashes >> 16]]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each half the responses of all filter places to a word; the last row is the padding's."""
        flat = np.concatenate([f[k] for f in self.filters for k in range(len(f))], axis=1)
        zero = np.zeros((1, flat.shape[1]), np.float32)
        return np.concatenate([self.left @ flat, zero]), np.concatenate([self.right @ flat, zero])


def responses(parts: np.ndarray) -> np.ndarray:
    """Filter responses at each start, from each word's responses at all filter places; the last starts are dropped."""
    n, out, column = len(parts) - max(WIDTHS) + 1, [], 0
    for w in WIDTHS:
        total = parts[:n, column : column + FILTERS].copy()
        for k in range(1, w):
            total += parts[k : n + k, column + k * FILTERS : column + (k + 1) * FILTERS]
        out.append(total)
        column += w * FILTERS
    return np.concatenate(out, axis=1)


def padded(hashes: np.ndarray) -> np.ndarray:
    """Rows of the tables, all padding: one for each word and so many that every word starts every filter."""
    return np.full(max(1, len(hashes)) + max(WIDTHS) - 1, BUCKETS, np.int64)


def halves(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = padded(hashes), padded(hashes)
    low[: len(hashes)] = hashes & (BUCKETS - 1)
    high[: len(hashes)] = hashes >> 16
    return low, high


def pooled(hashes: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The largest response of each filter over the whole text."""
    low, high = halves(hashes)
    best, reach = None, max(WIDTHS) - 1
    for k in range(0, len(low) - reach, PIECE):
        got = responses(tables[0][low[k : k + PIECE + reach]] + tables[1][high[k : k + PIECE + reach]]).max(0)
        best = got if best is None else np.maximum(best, got)
    return best


def logit(hashes: np.ndarray, model: Model, tables) -> float:
    return float((pooled(hashes, tables) + model.bias) @ model.weight + model.offset)


def step(model: Model, batch: list[np.ndarray], labels: np.ndarray, seen: dict) -> None:
    """One step of Adagrad on the logistic loss; only the pooled places of a text have a gradient."""
    flat = np.concatenate([f[k] for f in model.filters for k in range(len(f))], axis=1)
    pieces = [halves(h) for h in batch]
    low, high = (np.concatenate([p[s] for p in pieces]) for s in (0, 1))
    ends = np.cumsum([len(p[0]) for p in pieces])
    starts = np.concatenate([[0], ends[:-1]])
    zero = np.zeros((1, DIMENSIONS), np.float32)
    words = np.concatenate([model.left, zero])[low] + np.concatenate([model.right, zero])[high]
    parts = words @ flat
    n_filters = len(model.weight)
    place = np.empty((len(batch), n_filters), np.int64)
    peak = np.empty((len(batch), n_filters), np.float32)
    for d, (a, z) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        z_ = responses(parts[a:z])
        at = z_.argmax(0)
        place[d], peak[d] = a + at, z_[at, np.arange(n_filters)]
    said = 1 / (1 + np.exp(-np.clip((peak + model.bias) @ model.weight + model.offset, -30, 30)))
    wrong = ((said - labels) / len(batch)).astype(np.float32)
    down = wrong[:, None] * model.weight[None]
    grads = {"weight": (peak + model.bias).T @ wrong, "bias": down.sum(0), "offset": np.float32(wrong.sum())}
    touched, pushes = [], []
    for k, w in enumerate(WIDTHS):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        g = np.zeros_like(model.filters[k])
        for j in range(w):
            at = place[:, own] + j
            x = words[at]  # texts, filters, dimensions
            g[j] = np.einsum("nfd,nf->df", x, down[:, own])
            touched.append(at.reshape(-1))
            pushes.append((down[:, own, None] * model.filters[k][j].T[None]).reshape(-1, DIMENSIONS))
        grads[f"filter{k}"] = g
    at, push = np.concatenate(touched), np.concatenate(pushes)
    for name, rows, table in (("left", low[at], model.left), ("right", high[at], model.right)):
        real = rows < BUCKETS
        unique, inverse = np.unique(rows[real], return_inverse=True)
        total = np.zeros((len(unique), DIMENSIONS), np.float32)
        np.add.at(total, inverse, push[real])
        memory = seen.setdefault(name, np.full(BUCKETS, 1e-8, np.float32))
        memory[unique] += (total**2).mean(1)
        table[unique] -= RATE * total / np.sqrt(memory[unique])[:, None]
    for name, g in grads.items():
        memory = seen[name] = seen.get(name, 1e-8) + g**2
        move = (RATE * g / np.sqrt(memory)).astype(np.float32)
        if name == "offset":
            model.offset -= float(move)
        elif name.startswith("filter"):
            model.filters[int(name[6:])] -= move
        else:
            setattr(model, name, getattr(model, name) - move)


def fit(texts: list[np.ndarray], labels: np.ndarray) -> Model | None:
    """texts: hashed words. A fifth of the rows is left out and calibrates the cuts of the languages."""
    if len(set(labels.tolist())) < 2:
        return None
    model, r, seen = Model.fresh(), np.random.default_rng(SEED), {}
    words, times = np.unique(np.concatenate([np.unique(t) for t in texts]), return_counts=True)
    often = words[times >= MIN_TEXTS]
    for known, half in zip(model.known, (often & (BUCKETS - 1), often >> 16), strict=True):
        known[:] = False
        known[half] = True
    whole, texts = texts, [model.only_known(t) for t in texts]
    order = r.permutation(len(texts))
    aside, own = order[: len(texts) // 5], order[len(texts) // 5 :]
    for _ in range(EPOCHS):
        own = r.permutation(own)
        for k in range(0, len(own), BATCH):
            rows = own[k : k + BATCH]
            shown = [t[r.random(len(t)) >= HIDDEN] for t in (texts[i] for i in rows)]
            step(model, shown, labels[rows].astype(np.float32), seen)
    tables, table = model.tables(), language_table()
    if not len(aside):
        aside = own
    logits = np.array([logit(texts[i], model, tables) for i in aside])
    spoken = np.array([language(whole[i], table) for i in aside])
    common = cut(logits, labels[aside])
    for k in range(len(LANGUAGES)):
        mine = spoken == k
        both = mine.sum() >= 30 and len(set(labels[aside][mine].tolist())) == 2
        model.cuts[k] = cut(logits[mine], labels[aside][mine]) if both else common
    return model


def cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap between logits that divides the classes with the least balanced error."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order] == 1
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    raised = 1 - np.concatenate([[0], np.cumsum(~y)]) / max(1, (~y).sum())
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    worst = 2 * raised + missed  # a false alarm among many clean rows costs more
    best = np.flatnonzero(worst == worst.min())
    return float(edges[best].mean())


def fold(ident: Column) -> Column:
    return F.pmod(F.crc32(F.encode(ident.cast("string"), "UTF-8")), F.lit(4))


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, toxic and hashed words of the bounded sample; of rows with one id the first by their words.

    Ids are chosen from the labels alone and, being at most 2 * per_class, are broadcast: no text is moved.
    """
    own = pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [own.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for label in (0, 1)]
    rows = documents(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    found = text_mapped(rows, "text", lambda: lambda texts: ([hashed(t).tobytes() for t in texts],), {"words": BINARY}, ["doc_id", "toxic"])
    return found.groupBy("doc_id", "toxic").agg(F.min("words").alias("words"))


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    rows = sorted(sample(docs, labels, per_class).collect(), key=lambda r: (r["doc_id"], r["toxic"], r["words"]))
    return fit([np.frombuffer(r["words"], np.uint32) for r in rows], np.array([r["toxic"] for r in rows], np.int64))


def judged(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    model = trained(docs, labels, per_class)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        if model is None:
            return lambda texts: ([0.0] * len(texts),)
        tables, table = model.tables(), language_table()
        lift = np.log(THRESHOLD / (1 - THRESHOLD))

        def score(text: bytes | None) -> float:
            words = hashed(text)
            x = logit(model.only_known(words), model, tables) - model.cuts[language(words, table)] + lift
            return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

        return lambda texts: ([score(t) for t in texts],)

    x = text_mapped(documents(docs), "text", make, {"score": DOUBLE}, ["doc_id"])
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return x.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
