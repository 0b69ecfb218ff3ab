"""SimHash near-duplicates: fingerprints of word shingles, linked through sharded BK-trees.

``fingerprints``: 64 bits from the XXH64 of each shingle. ``linked``: fingerprints that differ in at most RADIUS bits are
linked. They are shard by pigeonhole: of RADIUS + 1 blocks of bits at least one must be equal, so a shard is a block
and its value, and every link lies in some shard. A shard above SHARD fingerprints is cut again by the bits that are
left, which holds for links by the same argument and ends, because d free bits allow 2 ** d fingerprints. A task builds
a shard's BK-tree (children keyed by their integer distance to the parent) and follows only edges within the radius;
it emits a star of each connected part, never all pairs. Trees go to the tasks that ask them by the exchange that
brings the shard together, not by the driver: a broadcast would gather all documents' fingerprints there.

``components`` joins the stars by alternating large-star and small-star steps, each a stored table. A task first replaces
its own links by stars of the same connected parts; at most SMALL links lie in one partition, where that leaves stars of
whole components, and the steps are taken without an exchange.

``near_duplicates`` groups documents of a given Jaccard similarity. Fingerprints of the distinct shingles, linked as above
within NEAR_RADIUS bits, make the first groups, whose links exact shingle sets confirm. At similarity 0.8 fingerprints differ
by 10 bits on average, so what lies beyond the radius is looked for as well: shards are the smallest shingle hashes that
documents share, an upper bound of the shingles in common links the pairs that may be similar, and exact shingle sets decide
inside each candidate group that is not yet known to be connected.

Defined cases: null and empty texts, and texts of white space, have no words and fingerprint zero, linked like any
other; texts with fewer words than a shingle are one shingle; repeated rows each get a row; a null doc_id never is a
component's smallest unless it has no other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from driftlens.llm.common import BINARY, LONG, at, documents, forget, schema, small_batches, stored, text_mapped, trimmed

WORDS = 3
RADIUS = 2
SEED = 42
#: Fingerprints in one tree; larger shards are cut.
SHARD = 1024
#: Fingerprints, at most, whose rows are named by broadcast: 16 bytes each.
MOST_HOT = 100_000
#: Shingles hashed at once.
PIECE = 1 << 16
#: Links that a task contracts at once, and those of a graph that lies in one partition: 16 bytes each.
SMALL = 1 << 18

#: Near-duplicates of the pipeline: shingle words, bits that linked fingerprints differ in at most, least Jaccard similarity,
#: and values of a sketch. Two bottom-8 sketches at similarity 0.8 share no value with a probability below 0.2 ** 8.
NEAR_WORDS = 5
NEAR_RADIUS = 3
SIMILARITY = 0.8
SKETCH = 8
#: Bands of the documents of hot sketch values, and hashes of each: at similarity 0.8 two documents share no band with a
#: probability of about (1 - 0.8 ** 4) ** 22, below 1e-5.
BANDS = 22
BAND = 4
#: Documents, and their shingles, that a verifying task holds twice at most.
BLOCK = 512
BLOCK_SHINGLES = 2_000_000


def shingles(text: bytes | None, words: int) -> Iterator[list[int]]:
    """Hashes of the shingles, a bounded list at a time."""
    parts = text.lower().split() if text else []
    if not parts:
        return
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(parts) - words + 1)
    stops = ends[min(words, len(parts)) - 1 :] - 1
    for k in range(0, n, PIECE):
        cut = map(slice, starts[k : min(n, k + PIECE)].tolist(), stops[k : k + PIECE].tolist())
        yield list(map(xxh64_intdigest, map(line.__getitem__, cut), repeat(SEED)))


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """As a signed 64-bit number."""
    return majority(shingles(text, words))


def majority(pieces: Iterable) -> int:
    """The bits set in over half of the hashes, which come a bounded list at a time."""
    ones, n = np.zeros(64, np.int64), 0
    for got in pieces:
        ones += np.unpackbits(np.array(got, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(got)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp for each row."""
    return text_mapped(documents(docs), "text", lambda: lambda texts: ([fingerprint(t, words) for t in texts],), {"fp": LONG}, ["doc_id"])


class BkTree:
    """Node k has value values[k]; children[k] maps a distance to the child at it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, k = len(self.values) - 1, 0
        while new and k != new:
            d = (self.values[k] ^ value).bit_count()
            k = self.children[k].setdefault(d, new)

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes within the radius."""
        found, open_ = [], [0] if self.values else []
        while open_:
            k = open_.pop()
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            edges = self.children[k]
            if len(edges) <= 2 * radius:
                open_ += [c for e, c in edges.items() if d - radius <= e <= d + radius]
            else:
                open_ += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found


def root(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = k = parent[parent[k]]
    return k


def stars(members: list[tuple[int, int]], radius: int) -> Iterator[tuple[int, int]]:
    """(name, centre) for the members (name, fingerprint) of each connected part, but for its centre."""
    tree, parent = BkTree(), []
    for k, (_, fp) in enumerate(members):
        parent.append(k)
        for other in tree.near(fp % 2**64, radius):
            a, b = root(parent, other), root(parent, k)
            parent[max(a, b)] = min(a, b)
        tree.add(fp % 2**64)
    for k, (name, _) in enumerate(members):
        if (r := root(parent, k)) != k:
            yield name, members[r][0]


def shard_links(radius: int):
    """Links of sorted rows (key columns, name, fp), a shard at a time."""

    def rows(batches):
        for b in batches:
            *keys, names, fps = (c.to_pylist() for c in b.columns)
            yield from zip(zip(*keys, strict=True), names, fps, strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for _, group in groupby(rows(batches), key=lambda r: r[0]):
            members = [(name, fp) for _, name, fp in group]
            if len(members) > 1:
                for a, b in stars(members, radius):
                    left.append(a)
                    right.append(b)
            if len(left) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def cut(mask: int, parts: int) -> list[int]:
    """The mask with each of ``parts`` shares of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k * len(free) // parts : (k + 1) * len(free) // parts]) for k in range(parts)]


def sharded(fps: DataFrame, radius: int) -> DataFrame:
    """(mask, value, name, fp): each fingerprint under the keys of its shards; shards of one are left out."""

    def keyed(x: DataFrame, masks: Column) -> DataFrame:
        x = x.select("fp", F.explode(masks).alias("mask"))
        return x.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), F.col("fp").alias("name"), "fp")

    masks = [signed(m) for m in cut(0, radius + 1)]
    rows, done = keyed(fps, F.array(*[F.lit(m).cast("long") for m in masks])), []
    while True:
        sizes = rows.groupBy("mask", "value").count()
        hot = stored(sizes.where(F.col("count") > SHARD).drop("count"), "hot-shards")
        if hot.isEmpty():
            return union([*done, rows])
        rows = stored(rows, "shards")
        done.append(rows.join(hot, ["mask", "value"], "left_anti"))
        options = [m for m in masks if m % 2**64 != 2**64 - 1]
        finer = F  # one flat choice: nested ones overflow the driver's stack when shards are cut several times
        for m in options:
            finer = finer.when(F.col("mask") == m, F.array(*[F.lit(signed(c)).cast("long") for c in cut(m % 2**64, radius + 1)]))
        rows = keyed(rows.join(hot, ["mask", "value"], "left_semi").select("fp", finer.alias("finer")), F.col("finer")).distinct()
        masks = [signed(c) for m in options for c in cut(m % 2**64, radius + 1)]


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints are within the radius. fps: distinct fp."""
    rows = sharded(fps, radius)
    return rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(trimmed(shard_links(radius)), schema(a=LONG, b=LONG))


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (node, smallest node) of the connected parts of links (a, b), at most SMALL links and a batch at a time."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, ends = np.unique(np.concatenate([b.column(k).to_numpy() for k in (0, 1) for b in held]), return_inverse=True)
        parent = list(range(len(nodes)))
        for x, y in zip(*(e.tolist() for e in np.split(ends, 2)), strict=True):
            x, y = root(parent, x), root(parent, y)
            parent[max(x, y)] = min(x, y)
        least = np.array([root(parent, k) for k in range(len(parent))])
        leaf = np.flatnonzero(least != np.arange(len(least)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf], pa.int64()), pa.array(nodes[least[leaf]], pa.int64())], names=["a", "b"])

    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held, n = [*held, b], n + b.num_rows
        if n > SMALL:
            yield star(held)
            held, n = [], 0
    if held:
        yield star(held)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component; nodes without links have no row."""

    def state(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def stars(x: DataFrame) -> DataFrame:
        return x.mapInArrow(trimmed(contracted), schema(a=LONG, b=LONG))

    # Links are stored first: to contract them in the tasks that find them would keep twice the Python workers.
    links = stored(links.where("a <> b").select("a", "b"), "links")
    if links.count() > SMALL:
        found, links = links, stored(stars(links), "contracted")
        forget(found, collect=False)
    few = links.count() <= SMALL
    # Tables of one partition are joined and grouped where they lie.
    placed = (lambda x: x.coalesce(1)) if few else (lambda x: x)
    edges = stored(stars(placed(links)) if few else links.distinct(), "stars")
    forget(links, collect=False)
    known = state(placed(edges))
    while known[0]:
        near = placed(edges)
        both = placed(near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, large = edges, stored(large.where("a <> b").distinct(), "large-star")
        far = placed(large)
        least = far.groupBy("a").agg(F.min("b").alias("m"))
        small = far.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(placed(small).where("a <> b").distinct(), "small-star")
        forget(before, large, collect=False)
        now = state(placed(edges))
        if now == known:
            break
        known = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def judged(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row."""
    fps = stored(fingerprints(docs, words), "fingerprints")
    first = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    groups = components(linked(first.select("fp"), radius))
    named = first.join(groups, first["fp"] == groups["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = stored(named.join(least, "root").select("fp", "n", "component_id"), "named-fingerprints")
    # Rows of a fingerprint that many share stay where they are: there are at most MOST_HOT such fingerprints.
    hot = F.col("n") > max(SHARD, (first.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    few = F.broadcast(names.where(hot).drop("n"))
    out = fps.join(few, "fp").unionByName(fps.join(few, "fp", "left_anti").join(names.where(~hot).drop("n"), "fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by Jaccard similarity of shingle sets.


def banded(h: np.ndarray) -> np.ndarray:
    """A number for each band of a set of hashes: its BAND smallest hashes in as many of all BANDS * BAND bins; bands without any: -1."""
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    np.minimum.at(least, (h >> np.uint64(32)) % np.uint64(BANDS * BAND), h)
    out = np.zeros(BANDS, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BAND):
            out = (out ^ least[k::BAND]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out = out * np.uint64(2 * BANDS) + np.arange(BANDS, dtype=np.uint64) * np.uint64(2)
    out[least.reshape(BANDS, BAND).min(1) == 2**64 - 1] = 2**64 - 1
    return out.view(np.int64)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """row, words, fp, n, counts, sketch, bands for documents with columns row and text, all of the set of distinct shingles.

    words: a digest of the sequence of words; fp: the fingerprint; n: the number of shingles; counts: how many fall in each bucket of the hash, a byte a bucket, 255 at most; sketch: the smallest
    hashes, ascending; bands: see ``banded``. There are a quarter to a half as many buckets as shingles, a power of two,
    64 at least.
    """

    def one(text: bytes | None) -> tuple[bytes, int, int, bytes, list[int], list[int]]:
        h, line = shingle_set(text, words), b" ".join((text or b"").lower().split())
        buckets = 1 << max(6, (len(h) // 4).bit_length())
        counts = np.minimum(np.bincount((h % buckets).astype(np.int64), minlength=buckets), 255).astype(np.uint8)
        bands = banded(h)
        fp = majority(h[k : k + PIECE] for k in range(0, len(h), PIECE))
        return hashlib.sha256(line).digest(), fp, len(h), counts.tobytes(), h[:SKETCH].view(np.int64).tolist(), bands[bands != -1].tolist()

    def make():
        return lambda texts: tuple(map(list, zip(*[one(t) for t in texts], strict=True))) if texts else ([], [], [], [], [], [])

    return text_mapped(docs, "text", make, {"words": BINARY, "fp": LONG, "n": LONG, "counts": BINARY, "sketch": T.ArrayType(LONG), "bands": T.ArrayType(LONG)}, ["row"])


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    got = [np.array(x, "<u8") for x in shingles(text, words)]
    return np.unique(np.concatenate(got)) if got else np.zeros(0, "<u8")


def folded(counts: np.ndarray) -> np.ndarray:
    """The counts in half as many buckets."""
    return np.minimum(counts.reshape(2, -1).sum(0, dtype=np.int64), 255).astype(np.uint8)


class Bound:
    """Counts of members in the order of their n: no two sets share more than the smaller count of each bucket.

    What a count of 255 leaves out is added as a whole.
    """

    def __init__(self, n: np.ndarray, counts: list[bytes], least: float):
        self.n, self.least, self.counts, self.levels = n, least, [np.frombuffer(c, np.uint8) for c in counts], {}
        for buckets, same in groupby(range(len(counts)), key=lambda k: len(counts[k])):
            same = list(same)
            table = np.stack([self.counts[k] for k in same])
            self.levels[buckets] = same[0], table, n[same] - table.sum(1, dtype=np.int64)

    def similar(self, k: int, low: int) -> list[int]:
        """Which of low..k-1 may have the least similarity to k; their n must not be below half of k's."""
        found, mine, high = [], self.counts[k], k
        while low < high:
            if len(mine) in self.levels:
                first, table, over = self.levels[len(mine)]
                begin = max(low, first)
                most = np.minimum(table[begin - first : high - first], mine).sum(1, dtype=np.int64)
                most += np.minimum(over[begin - first : high - first], self.n[k] - mine.sum(dtype=np.int64))
                fits = (1 + self.least) * most >= self.least * (self.n[begin:high] + self.n[k]) - 1e-6
                found += (begin + np.flatnonzero(fits)).tolist()
                high = begin
            mine = folded(mine)
        return found


def linked_rows(batches: Iterator[pa.RecordBatch], keys: int, links) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each group of rows that agree in the first columns; rows are sorted by them."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    left: list[int] = []
    right: list[int] = []
    for _, group in groupby(rows, key=lambda r: r[:keys]):
        for a, b in links([r[keys:] for r in group]):
            left.append(a)
            right.append(b)
        if len(left) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
            left, right = [], []
    yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def bounded_stars(least: float):
    """Links of rows (key, row, n, counts) sorted by key.

    The bound links whatever may be of the least similarity; a star for each connected part goes out. Fingerprints do not
    help here: of two texts with nothing but a common line in 500 pairs one is within 20 bits, which joins a hot shard.
    """

    def links(members: list[tuple]) -> Iterator[tuple[int, int]]:
        members.sort(key=lambda m: (m[1], m[0]))
        parent, n = list(range(len(members))), np.array([m[1] for m in members], np.int64)
        bound, low = Bound(n, [m[2] for m in members], least), 0
        for k in range(len(members)):
            while n[low] < least * n[k]:
                low += 1
            for m in bound.similar(k, low):
                if (a := root(parent, m)) != (b := root(parent, k)):
                    parent[max(a, b)] = min(a, b)
        for k in range(len(members)):
            if (r := root(parent, k)) != k:
                yield members[k][0], members[r][0]

    return trimmed(lambda batches: linked_rows(batches, 1, links))


def candidates(sketches: DataFrame, least: float) -> DataFrame:
    """Links whose components hold every pair of documents that share a sketch value and have the least similarity.

    Shards are the documents of a sketch value. What a shard of more than SHARD documents has goes by bands instead, in
    shards of a band; a band that more than SHARD of those share is one star: its documents are of one component without
    being compared, which costs the verification and loses nothing.
    """
    keys = stored(sketches.select("row", F.explode("sketch").alias("key")), "sketch-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    small = keys.join(sizes.where(F.col("n") <= SHARD).select("key"), "key")
    hot = keys.join(sizes.where(F.col("n") > SHARD).select("key"), "key").select("row").distinct()
    bands = stored(sketches.select("row", "bands").join(hot, "row").select("row", F.explode("bands").alias("key")), "band-keys")
    sizes = stored(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1"), "band-sizes")
    small = small.unionByName(bands.join(sizes.where(F.col("n") <= SHARD).select("key"), "key"))
    rows = small.join(sketches.select("row", "n", "counts"), "row").select("key", "row", "n", "counts")
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(bounded_stars(least), schema(a=LONG, b=LONG))
    wide = bands.join(sizes.where(F.col("n") > SHARD).select("key", "first"), "key").select(F.col("row").alias("a"), F.col("first").alias("b")).where("a <> b")
    return found.unionByName(wide)


def similar(own: np.ndarray, other: np.ndarray, least: float) -> bool:
    small, large = (own, other) if len(own) <= len(other) else (other, own)
    if not len(small) or len(small) < least * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both >= least * (len(small) + len(large) - both)


def verified(words: int, least: float):
    """Links of exact similarity, from rows (key, row, part, text) sorted by key. Rows of one part are known to be
    connected; those that are connected already are not compared again."""

    def links(members: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = sorted(((row, part, shingle_set(text, words)) for row, part, text in members), key=lambda m: len(m[2]))
        parent, first, low = list(range(len(sets))), {}, 0
        for k, (_, part, _) in enumerate(sets):
            parent[k] = first.setdefault(part, k)
        for k, (row, _, own) in enumerate(sets):
            while len(sets[low][2]) < least * len(own):
                low += 1
            for m in range(k - 1, low - 1, -1):
                if (a := root(parent, m)) != (b := root(parent, k)) and similar(sets[m][2], own, least):
                    parent[max(a, b)] = min(a, b)
                    yield row, sets[m][0]

    return trimmed(lambda batches: linked_rows(batches, 1, links))


def parted(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of (group, row, n) with part: the smallest row of those that links connect them to."""
    roots = components(links).select(F.col("node").alias("row"), F.col("root").alias("part"))
    return groups.drop("part").join(roots, "row", "left").select("group", "row", "n", F.coalesce("part", "row").alias("part"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """group, blocks: as many as hold at most BLOCK rows and BLOCK_SHINGLES shingles each, about."""
    return rows.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def fingerprint_groups(sketches: DataFrame, radius: int) -> DataFrame:
    """group, row, n of documents whose fingerprints are linked, group being the fingerprint of smallest number; none alone."""
    roots = components(linked(sketches.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    whole = sketches.select("fp", "row", "n").join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("group"), "row", "n")
    return whole.join(whole.groupBy("group").count().where("count > 1").select("group"), "group")


def exact(groups: DataFrame, texts: DataFrame, words: int, least: float, given: DataFrame | None = None) -> DataFrame:
    """All links that connect the documents of each candidate group (group, row, n) by exact similarity, those given included.
    What these connect is not compared again, and groups that they connect as a whole are not read.

    Each text goes to one block of its group first, then one document of each connected part does, until the parts of a
    group fit a block or no longer meet. What is not in a group's largest part by then is compared with all of the
    group's other parts, in pairs of blocks: that has as many rows as there are documents outside, not pairs of copies.
    """

    def compared(rows: DataFrame) -> DataFrame:
        x = rows.select("key", "row", "part").join(texts, "row").select("key", "row", "part", "text")
        return stored(x.repartition("key").sortWithinPartitions("key").mapInArrow(verified(words, least), schema(a=LONG, b=LONG)), "exact-links")

    def dealt(rows: DataFrame, seed: int) -> DataFrame:
        block = F.pmod(F.xxhash64("row", F.lit(seed)), F.col("blocks"))
        return rows.join(blocks_of(rows), "group").withColumn("key", F.struct("group", block.alias("block")))

    rows = stored(groups.withColumn("part", F.col("row")) if given is None else parted(groups, given), "candidate-groups")
    asked, links, known, seed = rows, given, None, 0
    if given is not None:
        several = rows.groupBy("group").agg(F.count_distinct("part").alias("parts")).where("parts > 1").select("group")
        asked = stored(rows.join(several, "group", "left_semi"), "groups-in-parts")
    while True:
        found = compared(dealt(asked, seed))
        links = found if links is None else links.unionByName(found)
        rows = stored(parted(rows, links), "parts")
        several = rows.groupBy("group").agg(F.count_distinct("part").alias("parts")).where("parts > 1")
        asked = stored(rows.where("row = part").join(several, "group", "left_semi"), "one-of-each-part")
        # Groups that a single block has seen as a whole are done.
        wide = blocks_of(rows.join(several.select("group"), "group", "left_semi")).where("blocks > 1").select("group")
        asked = stored(asked.join(wide, "group", "left_semi"), "open-parts")
        n = asked.count()
        if not n:
            return links
        if known is not None and n > 0.7 * known:
            break
        known, seed = n, seed + 1
    # The rest: rows outside the largest part of their group meet every block.
    left = rows.join(asked.select("group").distinct(), "group", "left_semi")
    size = left.groupBy("group", "part").agg(F.count("*").alias("size"))
    largest = size.groupBy("group").agg(F.max_by("part", F.struct("size", "part")).alias("largest"))
    left = stored(left.join(largest, "group").withColumn("outside", F.col("part") != F.col("largest")), "unconnected")
    few = blocks_of(left.where("outside")).withColumnRenamed("blocks", "few")
    many = blocks_of(left.where("not outside")).withColumnRenamed("blocks", "many")
    left = left.join(few, "group").join(many, "group")
    own, other = F.pmod(F.xxhash64("row"), F.col("few")).cast("int"), F.pmod(F.xxhash64("row"), F.col("many")).cast("int")
    # A block of those outside meets each of them once, as (least, greatest), and each block of the largest part.
    apart = left.where("outside").select("group", "row", "part", "few", "many", own.alias("own"))
    inner = apart.select("row", "part", "group", "own", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("o"))
    inner = inner.select(F.struct("group", F.lit(0).alias("kind"), F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j")).alias("key"), "row", "part")
    outer = apart.select("row", "part", "group", "own", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("o"))
    outer = outer.select(F.struct("group", F.lit(1).alias("kind"), F.col("own").alias("i"), F.col("o").alias("j")).alias("key"), "row", "part")
    main = left.where("not outside").select("row", "part", "group", other.alias("o"), F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"))
    main = main.select(F.struct("group", F.lit(1).alias("kind"), F.col("i"), F.col("o").alias("j")).alias("key"), "row", "part")
    return links.unionByName(compared(inner.unionByName(outer).unionByName(main)))


def near_duplicates(docs: DataFrame, words: int = NEAR_WORDS, least: float = SIMILARITY, radius: int = NEAR_RADIUS) -> DataFrame:
    """row, root for documents with columns row (a distinct long) and text; equal words collapse first.

    row and root are of the same group if a chain of documents, each at least ``least`` similar to the next, joins them;
    root is its smallest row. Every row has a row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # All rows are sketched where they lie; to choose one of equal words first would exchange the texts.
    every = stored(sketched(docs.select("row", "text"), words), "all-sketches")
    named = stored(every.select("row", "words"), "equal-words")
    first = stored(named.groupBy("words").agg(F.min("row").alias("row")), "distinct-words")
    sketches = stored(every.drop("words").join(first.select("row"), "row", "left_semi"), "sketches")
    forget(every)
    texts = docs.select("row", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    near = stored(fingerprint_groups(sketches, radius), "fingerprint-groups")
    confirmed = stored(exact(near, texts, words, least), "confirmed-links")
    # What the radius leaves out.
    groups = components(candidates(sketches, least))
    whole = groups.select(F.col("node").alias("row"), F.col("root").alias("group")).unionByName(groups.select(F.col("root").alias("row"), F.col("root").alias("group")).distinct())
    whole = stored(whole.join(sketches.select("row", "n"), "row").select("group", "row", "n"), "candidates")
    forget(sketches)
    roots = components(exact(whole, texts, words, least, confirmed))
    forget(near, confirmed, whole)
    kept = first.select("words", "row").join(roots.withColumnRenamed("node", "row"), "row", "left").select("words", F.coalesce("root", "row").alias("root"))
    return named.join(kept, "words").select("row", "root")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents of smallest (doc_id, place) of each group of near-duplicates, their own columns only."""
    names = docs.columns
    ident, text = at(docs, "doc_id"), at(docs, "text")
    x = docs.toDF(*[f"_{k}" for k in range(len(names))])
    own = (F.col(f"_{ident}").cast("long").alias("doc_id"), F.col(f"_{text}").cast("string").alias("text"), F.struct(*x.columns).alias("all"))
    numbered = stored(x.select(*own, F.monotonically_increasing_id().alias("row")), "near-rows")
    groups = near_duplicates(numbered.select("row", "text"), **how)
    ids = groups.join(numbered.select("row", "doc_id"), "row")
    keep = ids.groupBy("root").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    return numbered.join(keep.select("row"), "row", "left_semi").select("all.*").toDF(*names)
