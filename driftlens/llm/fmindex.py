"""Substring dedup: compressed FM-indexes of shards, searched backwards for matching statistics.

A window is WINDOW consecutive words. Equal windows have the same minimizer (the smallest hash of their parts of
PARTS[0] words, the first of equal ones), so a shard is a minimizer, and a document's windows with one minimizer in one
place are a segment of fewer than 2 * WINDOW words: every window occurrence lies in one segment of one shard. Minimizers
that occur once in all documents need no index. Equal segments of a shard are one row with a weight, summed before they
are exchanged; a passage that many documents share is one segment.

A shard of more than SHARD different segments (a line in many contexts) is cut again: its segments' windows by the
minimizers of their next longer parts, and these once more by whole windows, where a shard is one window. Found intervals
go back from segments to what they were cut from. So one index holds INDEX_WORDS words and one shard at most, and its
size doesn't depend on how often a passage occurs.

An index holds the Burrows-Wheeler transform of its segments, words numbered, as a wavelet tree in matrix form: one packed
bit vector for each bit of the numbers, with rank counts of 16 bits a word of 64 and 32 bits each 512, so 1.3 bits for
each bit of the transform. Segments stream through it as lanes that all step backwards together. A lane holds the
longest match that starts at its place and whose weight (copies of the segments in the interval) is two or more: its
matching statistic. Where the match can't be extended it is shortened at its end to the next longer interval, by the
longest common prefixes at the interval's edges. Reported are the matches of WINDOW words or more.

Equal texts are one text with a number of copies. Texts are stored once, bucketed by their key, and later stages
join figures to them without moving them. A batch of texts is bounded by bytes; a longer text is a batch alone, whose
arrays take about twenty times its bytes.

Defined cases: null and empty texts have no words; texts of fewer than WINDOW words lose nothing; of equal texts all
lose all windows; repeated rows are copies; null ids pass; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.llm.common import INT, LONG, STRING, at, documents, forget, merged, schema, scratch, small_batches, stored, trimmed

WINDOW = 35
#: Words of the parts whose smallest hash names a shard, and of those that cut shards again; the last is the window.
PARTS = (12, 24, WINDOW)
#: Different segments of a minimizer that go to one index; larger shards are cut again.
SHARD = 2000
#: Words after which a task closes an index and starts the next.
INDEX_WORDS = 700_000
#: Words whose bytes are summed at once.
DIGITS = 1 << 14
#: Segments of a batch that goes out.
ROWS = 20_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of the texts of a batch, end to end."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        some = pc.greater(pc.binary_length(texts), 0)
        blank = pc.and_(some, pc.equal(pc.binary_length(pc.list_element(lists, 0)), 0)) if len(texts) else some
        self.lists = lists
        self.words, ends = lists.values, lists.offsets.to_numpy()
        # A text without words has an empty one.
        self.none = pc.or_(pc.invert(some), blank).to_numpy(zero_copy_only=False)
        self.first, self.count = ends[:-1], np.where(self.none, 0, np.diff(ends))

    def normal(self) -> pa.Array:
        """Each text as its words, joined by a space."""
        return pc.binary_join(self.lists, " ")

    def hashes(self) -> np.ndarray:
        """A number for each word: its bytes as digits, modulo 2 ** 64, by running sums over a bounded number of words."""
        data = np.frombuffer(self.words.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(self.words.buffers()[1], np.int32)[self.words.offset : self.words.offset + len(self.words) + 1] if len(self.words) else np.zeros(1, np.int32)
        out = np.empty(len(self.words), np.uint64)
        for k in range(0, len(out), DIGITS):
            edge = ends[k : k + DIGITS + 1].astype(np.int64) - ends[k]
            powers = np.full(edge[-1] + 1, MULTIPLIER)
            powers[0] = 1
            powers = np.cumprod(powers)
            digits = data[ends[k] : ends[k] + edge[-1]].astype(np.uint64) + np.uint64(1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digits * powers[:-1])])
            inverse = np.full(edge[-1] + 1, pow(int(MULTIPLIER), -1, 1 << 64), np.uint64)
            inverse[0] = 1
            out[k : k + DIGITS] = (total[edge[1:]] - total[edge[:-1]]) * np.cumprod(inverse)[edge[:-1]]
        return out ^ out >> np.uint64(31)

    def minimizers(self, window: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of window starts with one minimizer: text, hash as a signed number, first start, last start (in ``words``)."""
        base, n = self.hashes(), len(self.words) - part + 1
        if n <= window - part:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        h = np.zeros(n, np.uint64)
        for k in range(part):
            h = h * MULTIPLIER + base[k : k + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        span = window - part + 1
        least = np.empty(n - span + 1, np.int64)
        for k in range(0, len(least), 1 << 16):  # bounded memory for very long texts
            seen = np.lib.stride_tricks.sliding_window_view(h[k : k + (1 << 16) + span - 1], span)
            least[k : k + len(seen)] = seen.argmin(1) + np.arange(k, k + len(seen))
        fits = np.maximum(self.count - window + 1, 0)
        text = np.repeat(np.arange(len(self.count)), fits)
        start = np.arange(len(text)) + np.repeat(self.first - np.concatenate([[0], np.cumsum(fits)[:-1]]), fits)
        least = least[start]
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])) if len(text) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(text)]])[: len(first)] - 1
        return text[first], h[least[first]].view(np.int64), start[first], start[last]

    def joined(self, first: np.ndarray, last: np.ndarray) -> Iterator[str]:
        """Words first to last, joined by spaces, a bounded number of rows at a time."""
        whole = pa.ListArray.from_arrays(pa.array([0, len(self.words)], pa.int32()), self.words.cast(pa.binary()))
        line = pc.binary_join(whole, b" ")[0].as_py()
        ends = np.cumsum(pc.binary_length(self.words).to_numpy().astype(np.int64) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        return map(line.__getitem__, map(slice, starts[first].tolist(), (ends[last] - 1).tolist()))


class FmIndex:
    """Counts of patterns in weighted sequences of numbers from 1; patterns up to ``depth`` symbols.

    symbols: the sequences end to end; sizes: of each.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, weights: np.ndarray, depth: int):
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1])
        text = np.zeros(n, np.int64)
        text[np.delete(np.arange(n), ends - 1)] = symbols
        ranks, order, step = [text.astype(np.int32)], np.argsort(text), 1
        while step < min(depth, n):
            following = np.zeros(n, np.int64)
            following[: n - step] = ranks[-1][step:] + np.int64(1)
            key = ranks[-1] * np.int64(n + 2) + following
            order = np.argsort(key)  # equal ones in any order: no pattern is longer
            ordered = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            ranks.append(rank)
            step *= 2
        self.prefixes(ranks, order, np.repeat(ends - 1, sizes + 1) - np.arange(n))
        self.weights = weights
        self.weight = np.concatenate([[0], np.cumsum(np.repeat(weights, sizes + 1)[order])])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        transform = text[order - 1].astype(np.int32)
        self.n, self.levels = n, max(1, int(text.max()).bit_length())
        self.bits: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []
        self.inside: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bit = (transform >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 512 + 512, np.uint8)]), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.bits.append(packed)
            self.blocks.append(before[::8].astype(np.uint32))
            self.inside.append((before - np.repeat(before[::8], 8)).astype(np.uint16))
            self.zeros.append(n - int(bit.sum()))
            transform = np.concatenate([transform[bit == 0], transform[bit == 1]])
        # From a symbol's places on the last level to the suffixes that start with it.
        every = np.arange(len(self.first))
        self.shift = self.first - self.last(every, np.zeros(len(every), np.int64))

    def prefixes(self, ranks: list[np.ndarray], order: np.ndarray, left: np.ndarray) -> None:
        """Longest common prefix of each suffix and the one before it, -1 at both edges, under minima of 2, 4, 8, ... of them."""
        n = len(order)
        a, b, same = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
        for k in reversed(range(len(ranks))):
            inside = np.maximum(a, b) < n
            more = np.zeros(n - 1, bool)
            more[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            for x in (a, b, same):
                x += more * (1 << k)
        common = np.full(n + 1, -1, np.int32)
        common[1:n] = np.minimum(same, left[order[1:]])
        self.common = [common]
        while len(self.common[-1]) > 1:
            row = self.common[-1]
            row = np.concatenate([row, [np.iinfo(np.int32).max]]) if len(row) % 2 else row
            self.common.append(np.minimum(row[::2], row[1::2]).astype(np.int32))

    def last(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where each place is on the last level if its symbol is followed down."""
        for k, level in enumerate(reversed(range(self.levels))):
            word = place >> 6
            part = np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            seen = self.blocks[k][word >> 3].astype(np.int64) + self.inside[k][word] + part
            place = np.where((symbol >> level & 1).astype(bool), seen + self.zeros[k], place - seen)
        return place

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put before each."""
        got = self.last(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.shift[symbol]] * 2)
        return got[: len(lo)], got[len(lo) :]

    def nearest(self, place: np.ndarray, below: np.ndarray, step: int) -> np.ndarray:
        """The first place from each on, in the direction of step, whose common prefix is below a number."""
        place, found = place.copy(), np.full(len(place), -1)
        for k, row in enumerate(self.common):
            open_ = np.flatnonzero(found < 0)
            if not len(open_):
                break
            # Of the two places of a block the one further on is looked at here, both otherwise with their block.
            edge = open_[place[open_] % 2 == (step > 0)]
            hit = row[place[edge]] < below[edge]
            found[edge[hit]] = k
            place[edge[~hit]] += step
            rest = np.flatnonzero(found < 0)
            place[rest] >>= 1
        for k in range(int(found.max(initial=0)), 0, -1):
            down = np.flatnonzero(found >= k)
            inner = 2 * place[down] + (step < 0)
            place[down] = inner + np.where(self.common[k - 1][inner] < below[down], 0, step)
        return place

    def shorter(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of matches the longest beginnings with a larger interval: interval and length."""
        size = np.maximum(self.common[0][lo], self.common[0][hi]).astype(np.int64)
        return self.nearest(lo, size, -1), self.nearest(hi, size, 1), np.maximum(size, 0)

    def repeated(self, symbols: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, start, end) of the matches of weight two or more that are ``window`` symbols long or more and can't
        be extended backwards, by the matching statistics of the index's sequences. One of weight two matches itself."""
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        whole = np.flatnonzero((sizes >= window) & (self.weights >= 2))
        lane = np.flatnonzero((sizes >= window) & (self.weights < 2))
        place, size = sizes[lane].copy(), np.zeros(len(lane), np.int64)
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), self.n)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(whole, np.zeros(len(whole), np.int64), sizes[whole])]
        while len(lane):
            new_lo, new_hi = self.back(symbols[base[lane] + place - 1], lo, hi)
            good = self.weight[new_hi] - self.weight[new_lo] >= 2
            lo, hi, place, size = np.where(good, new_lo, lo), np.where(good, new_hi, hi), place - good, size + good
            over = ~good | (place == 0)
            told = over & (size >= window)
            out.append((lane[told], place[told], (place + size)[told]))
            bad = np.flatnonzero(~good)
            if len(bad):
                empty = bad[size[bad] == 0]
                place[empty] -= 1
                some = bad[size[bad] > 0]
                lo[some], hi[some], size[some] = self.shorter(lo[some], hi[some])
            # Ends never grow, so a match that is to hold a window must end a window from the start or later.
            stay = (place > 0) & ((place + size >= window) | ~over)
            if not stay.all():
                lane, place, size, lo, hi = (x[stay] for x in (lane, place, size, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def keyed(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def named(docs: DataFrame) -> DataFrame:
    """doc_id and the key of its text (null: empty)."""
    return documents(docs).select("doc_id", *keyed(F.coalesce("text", F.lit(""))))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """k1, k2, text, copies: stored once, bucketed by key. The catalog holds the table only while it is resolved."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    x = documents(docs).select(*keyed(text), text.alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    path = scratch(spark, "texts")
    name = "driftlens_" + path.rpartition("-")[2]
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x.repartition(buckets, "k1", "k2").write.bucketBy(buckets, "k1", "k2").option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay: the path is given
    return out


SEGMENTS = schema(anchor=LONG, o1=LONG, o2=LONG, start=INT, copies=LONG, words=STRING)
SEGMENTS_ARROW = pa.schema([("anchor", pa.int64()), ("o1", pa.int64()), ("o2", pa.int64()), ("start", pa.int32()), ("copies", pa.int64()), ("words", pa.string())])
FOUND = schema(s1=LONG, s2=LONG, lo=INT, hi=INT)
FOUND_ARROW = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def anchors(texts: DataFrame, window: int, part: int) -> DataFrame:
    """k1, k2, anchor, n: segments with that minimizer in all copies of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, anchor, _, _ = Words(b.column(2)).minimizers(window, part)
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])])) if len(text) else order
            n = np.diff(np.concatenate([new, [len(text)]])) * b.column(3).to_numpy()[text[new]]
            own = pa.array(text[new])
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(anchor[new], pa.int64()), pa.array(n, pa.int64())], names=["k1", "k2", "anchor", "n"])

    return texts.select("k1", "k2", "text", "copies").mapInArrow(trimmed(run), schema(k1=LONG, k2=LONG, anchor=LONG, n=LONG))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) + np.uint64(1)) * MULTIPLIER ^ b.view(np.uint64)


def cut(window: int, part: int):
    """Segments of rows (o1, o2, text, copies and the wanted minimizers, or an anchor that stays part of the new one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, more = Words(b.column(2)), b.column(4)
            text, anchor, first, last = words.minimizers(window, part)
            if pa.types.is_list(more.type):
                # Should two pairs mix to the same number, a segment goes along that meets no other.
                asked = mixed(np.repeat(np.arange(len(more)), pc.list_value_length(more).to_numpy()), more.flatten().to_numpy().astype(np.int64))
                keep = np.isin(mixed(text, anchor), asked)
                text, anchor, first, last = (x[keep] for x in (text, anchor, first, last))
            elif len(text):
                anchor = mixed(more.to_numpy().view(np.uint64)[text], anchor).view(np.int64)
            lines = words.joined(first, last + window - 1)
            start = (first - words.first[text]).astype(np.int32)
            for k in range(0, len(text), ROWS):
                own = pa.array(text[k : k + ROWS])
                line = pa.array([next(lines) for _ in range(len(own))], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(anchor[k : k + ROWS], pa.int64()), b.column(0).take(own), b.column(1).take(own), pa.array(start[k : k + ROWS]), b.column(3).take(own), line], schema=SEGMENTS_ARROW)

    return trimmed(run)


def searched(window: int, depth: int):
    """Found intervals of segment rows (anchor, s1, s2, weight, words) that are sorted by anchor."""

    def search(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        s1, s2, weight, words = (pa.concat_arrays([b.column(k) for b in held]) for k in (1, 2, 3, 4))
        lists = pc.split_pattern(words, " ")
        symbols = lists.values.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        row, lo, hi = FmIndex(symbols, sizes, weight.to_numpy(), depth).repeated(symbols, sizes, window)
        own = pa.array(row)
        return pa.RecordBatch.from_arrays([s1.take(own), s2.take(own), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], schema=FOUND_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, last = [], 0, None
        for b in batches:
            anchor = b.column(0).to_numpy()
            if not len(anchor):
                continue
            size = pc.count_substring(b.column(4), " ").to_numpy().astype(np.int64) + 1
            new = np.flatnonzero(np.concatenate([[anchor[0] != last], anchor[1:] != anchor[:-1]]))
            before = np.concatenate([[0], np.cumsum(size)])
            lo = 0
            while (k := np.searchsorted(before[new], INDEX_WORDS - words + before[lo])) < len(new):
                held.append(b.slice(lo, new[k] - lo))
                yield search(held)
                held, words, lo = [], 0, int(new[k])
            held.append(b.slice(lo))
            words, last = words + int(before[-1] - before[lo]), anchor[-1]
        if held:
            yield search(held)

    return trimmed(run)


def intervals(rows: DataFrame, window: int, parts: tuple[int, ...], shard: int) -> DataFrame:
    """o1, o2, spans: what of the owners of segments (a stored table, deleted here) is repeated. parts[0] has cut them.

    The spans of an owner are bounded by its words. The result is stored; segments are left behind as places.
    """
    keys = [F.xxhash64("anchor", "words").alias("s1"), F.xxhash64("words", "anchor").alias("s2")]
    distinct = stored(rows.groupBy("anchor", "words").agg(F.sum("copies").alias("weight")).select("anchor", "words", "weight", *keys), "segments")
    places = stored(rows.select("o1", "o2", "start", *keys), "places")
    forget(rows)
    sizes = stored(distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).where("weight > 1").select("anchor", "n"), "shards")
    small = distinct.join(sizes.where(F.col("n") <= shard) if len(parts) > 1 else sizes, "anchor", "left_semi")
    small = small.select("anchor", "s1", "s2", "weight", "words").repartition("anchor").sortWithinPartitions("anchor")
    found = small.mapInArrow(searched(window, 2 * window - parts[0] + 1), FOUND).groupBy("s1", "s2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    found, again = stored(found, "found"), None
    both = found
    large = sizes.where(F.col("n") > shard).select("anchor")
    if len(parts) > 1 and not large.isEmpty():
        hot = distinct.join(large, "anchor", "left_semi").select(F.col("s1").alias("o1"), F.col("s2").alias("o2"), "words", F.col("weight").alias("copies"), "anchor")
        again = intervals(stored(hot.mapInArrow(cut(window, parts[1]), SEGMENTS), "cut-again"), window, parts[1:], shard)
        both = found.unionByName(again.withColumnsRenamed({"o1": "s1", "o2": "s2"}))
    forget(distinct, sizes)
    moved = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("start")).alias("lo"), (s["hi"] + F.col("start")).alias("hi")))
    out = stored(places.join(both, ["s1", "s2"]).groupBy("o1", "o2").agg(F.flatten(F.collect_list(moved)).alias("spans")), "spans")
    forget(places, found, *([again] if again else []))
    return out


def repeats(texts: DataFrame, window: int = WINDOW, parts: tuple[int, ...] = PARTS, shard: int = SHARD) -> DataFrame:
    """k1, k2, spans, stored: for each distinct text with any, the word intervals whose windows also start elsewhere."""
    small_batches(texts.sparkSession)
    seen = stored(anchors(texts, window, parts[0]), "anchors")
    often = seen.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    wanted = seen.join(often, "anchor").groupBy("k1", "k2").agg(F.collect_list("anchor").alias("anchors"))
    asked = texts.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "copies", "anchors")
    rows = stored(asked.mapInArrow(cut(window, parts[0]), SEGMENTS), "text-segments")
    forget(seen)
    return intervals(rows, window, parts, shard).withColumnsRenamed({"o1": "k1", "o2": "k2"})


WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RESULT = schema(k1=LONG, k2=LONG, n_words=LONG, n_removed=LONG, kept=STRING, text=STRING)


def cleaned(docs: DataFrame, window: int = WINDOW, parts: tuple[int, ...] = PARTS, shard: int = SHARD) -> DataFrame:
    """For each distinct text: n_words, n_removed, kept (its words joined by a space) and text (the original without the
    removed words and the white space after them)."""
    texts = distinct_texts(docs)
    spans = repeats(texts, window, parts, shard)
    x = texts.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "spans")
    arrow = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("text", pa.string())])

    def one(text: bytes, copies: int, spans: list | None) -> tuple:
        words = text.split()
        if copies > 1 and len(words) >= window:
            return len(words), len(words), b"", b""
        if not spans:
            return len(words), 0, b" ".join(words), text
        edge = np.zeros(len(words) + 1, np.int32)
        for s in spans:
            edge[s["lo"]] += 1
            edge[s["hi"]] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        places = [m.span() for m in WORD.finditer(text)] + [(len(text), len(text))]
        kept = np.flatnonzero(~gone).tolist()
        left = text[: places[0][0]] + b"".join([text[places[k][0] : places[k + 1][0]] for k in kept])
        return len(words), int(gone.sum()), b" ".join([words[k] for k in kept]), left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Most texts stay as they are: their words are joined by Arrow.
            whole = pc.and_(pc.equal(b.column(3), 1), b.column(4).is_null())
            texts, rest = b.column(2).filter(whole), b.filter(pc.invert(whole))
            same = Words(texts)
            got = [one(t, c, s) for t, c, s in zip(rest.column(2).cast(pa.binary()).to_pylist(), rest.column(3).to_pylist(), rest.column(4).to_pylist(), strict=True)]
            cut_ = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            plain = [pa.array(same.count, pa.int64()), pa.array(np.zeros(len(texts), np.int64)), same.normal(), texts]
            places = [np.flatnonzero(whole), np.flatnonzero(pc.invert(whole))]
            new = [merged(b.num_rows, [(places[0], p), (places[1], c.cast(p.type))]) for p, c in zip(plain, cut_, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *new], schema=arrow)

    return x.mapInArrow(trimmed(run), RESULT)


def judged(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    figures = cleaned(docs, **how).select("k1", "k2", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
    return named(docs).join(figures, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """The documents with their texts cut, their own columns only; a null text stays null."""
    names, place = docs.columns, at(docs, "text")
    x = docs.toDF(*[f"_{k}" for k in range(len(names))])
    text = F.col(f"_{place}").cast("string")
    x = x.withColumns({c: e for c, e in zip(("k1", "k2"), keyed(F.coalesce(text, F.lit(""))), strict=True)})
    new = cleaned(docs, **how).select("k1", "k2", F.col("text").alias("_new"))
    y = x.join(new, ["k1", "k2"])
    return y.select(*[F.when(F.col(f"_{k}").isNotNull(), F.col("_new")).alias(f"_{k}") if k == place else F.col(f"_{k}") for k in range(len(names))]).toDF(*names)
