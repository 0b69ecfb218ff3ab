"""Sharding by histogram sort: splitters found by counting exact bytes below probes, then one exchange.

Rows are ordered by (XXH64 of the text, doc_id), so copies of a text stand together and a group larger than
a shard is cut between ids. The law is ``bytes``. A probe round counts bytes and rows in the bins of those
intervals that still hold a target and reads only their rows; each round narrows an interval by up to 2 ** BITS
until its bytes are within TOLERANCE of a shard or it is a single row, so a shard differs from total / shards
by no more than the larger of TOLERANCE and one row. The driver holds at most COUNTERS counters, or two a target.

Where a shard exceeds PART_BYTES it is cut into parts by further splitters of the same kind, so that the one
exchange deals parts, not shards, to tasks; the rows counted below each splitter then give a part's first slot.

Defined cases: a null text has size 16 and counts as empty; null ids sort first; rows equal in text and id
share a place in the order and so a shard, their slots are dealt in any order; with fewer rows than shards
some shards stay empty; an empty table gives an empty table; columns that clash with size, shard and slot
are renamed, see ``common.apart``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import apart, at, stored

SHARDS = 40
OVERHEAD = 16
#: Bits of the key that a probe round resolves.
BITS = 10
#: Share of a shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.0005
PART_BYTES = 512_000_000
#: Counters that the driver holds in a round; with more targets a round resolves fewer bits.
COUNTERS = 1 << 21
SIGN = 2**63


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def unsigned(key: Column) -> Column:
    """Signed order becomes unsigned order."""
    return key.bitwiseXOR(F.lit(-SIGN).cast("long"))


def signed(edge: int) -> int:
    """The key at an edge of unsigned bins."""
    return edge - SIGN


def probe(keys: DataFrame, key: str, targets: list[int], near: float) -> list[tuple[int, int, int, int]]:
    """For each target (bytes below, in the order of key): (edge, bytes below it, bytes at it, rows at it).

    The edge is unsigned, from 0 to 2 ** 64. Bytes at it are 0 unless many rows share the one key there and
    their bytes exceed near; else the edge is the end of the last interval that is nearest to the target.
    """
    out: dict[int, tuple[int, int, int, int]] = {}
    shift, live = 64, {0: [(k, 0) for k in range(len(targets))]}
    while live:
        step = min(max(1, min(BITS, (COUNTERS // len(live)).bit_length() - 1)), shift)
        shift -= step
        rows = keys.select(F.shiftrightunsigned(unsigned(F.col(key)), shift).alias("bin") if shift else unsigned(F.col(key)).alias("bin"), "size")
        if shift + step < 64:
            rows = rows.where(F.shiftrightunsigned("bin", step).isin(list(live)))
        bins: dict[int, list[tuple[int, int, int]]] = {}
        for r in rows.groupBy("bin").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
            b = r["bin"] % 2**64
            bins.setdefault(b >> step, []).append((b, r["b"], r["n"]))
        then: dict[int, list[tuple[int, int]]] = {}
        for prefix, wanted in live.items():
            inside = sorted(bins.get(prefix, []))
            for k, base in wanted:
                below = base
                for b, size, n in inside:
                    if below + size > targets[k]:
                        break
                    below += size
                if n > 1 and size > near and shift:
                    then.setdefault(b, []).append((k, below))
                elif n > 1 and size > near:
                    out[k] = (b, below, size, n)
                elif targets[k] - below <= below + size - targets[k]:
                    out[k] = (b << shift, below, 0, 0)
                else:
                    out[k] = ((b + 1) << shift, below + size, 0, 0)
        live = then
    return [out[k] for k in range(len(targets))]


def splitters(keys: DataFrame, parts: int, near: float, total: int) -> list[tuple[int, int] | None]:
    """parts - 1 boundaries (hash, id): a row stands right of one if it is not below it; None: all rows are below.

    keys has hash, id and size, without nulls, a row for each document.
    """
    targets = [total * k // parts for k in range(1, parts)]
    found = probe(keys, "hash", targets, near)
    bounds: list[tuple[int, int] | None] = [(signed(e), -SIGN) if e < 2**64 else None for e, _, _, _ in found]
    for hot in {e for e, _, size, _ in found if size}:
        places = [k for k, x in enumerate(found) if x[0] == hot and x[2]]
        inner = probe(keys.where(F.col("hash") == signed(hot)), "id", [targets[k] - found[k][1] for k in places], near)
        for k, (e, below, size, n) in zip(places, inner, strict=True):
            # Rows equal in text and id cannot be told apart: they stay together.
            bounds[k] = (signed(hot), signed(e)) if e < 2**64 else (signed(hot) + 1, -SIGN) if signed(hot) + 1 < SIGN else None
    return bounds


def not_below(hash_: Column, ident: Column, bound: tuple[int, int] | None) -> Column:
    if bound is None:
        return F.lit(0)
    return ((hash_ > F.lit(bound[0])) | ((hash_ == F.lit(bound[0])) & (ident >= F.lit(bound[1])))).cast("int")


def place(hash_: Column, ident: Column, bounds: list, each: int) -> Column:
    """Number of the part: coarse comparisons with every each-th boundary, then those within the shard."""
    shard = sum((not_below(hash_, ident, b) for b in bounds[each - 1 :: each]), F.lit(0))
    if each == 1:
        return shard
    last = (SIGN - 1, SIGN - 1)
    longs = "array<array<struct<h:bigint,i:bigint>>>"
    groups = [[b or last for b in bounds[k * each : (k + 1) * each - 1]] for k in range((len(bounds) + 1) // each)]
    inner = F.array(*[F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.lit(i).cast("long").alias("i")) for h, i in g]) for g in groups]).cast(longs)
    own, mine = F.struct(hash_.alias("h"), ident.alias("i")), F.get(inner, shard)
    # Boundaries ascend: the number of those that the row isn't below, by halving.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(each.bit_length()))])
    passed = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(mine, n + step - 1) <= own, n + step).otherwise(n))
    return shard * each + passed


def sharded(docs: DataFrame, shards: int = SHARDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents with size, shard (0 to shards - 1) and slot (gapless from 0 in each shard, in key order)."""
    i, j = at(docs, "doc_id"), at(docs, "text")
    docs = apart(docs, "size", "shard", "slot", "_h", "_i", "_part", "_first")
    ident, text = F.col(f"`{docs.columns[i]}`").cast("long"), F.col(f"`{docs.columns[j]}`").cast("string")
    hash_, ident = F.xxhash64(F.coalesce(text, F.lit(""))), F.coalesce(ident, F.lit(-SIGN).cast("long"))
    keys = stored(docs.select(hash_.alias("hash"), ident.alias("id"), size_of(text).alias("size")), "shard-keys")
    total = keys.agg(F.sum("size").alias("s")).first()["s"] or 0
    each = max(1, -(-total // (shards * part_bytes)))
    bounds = splitters(keys, shards * each, TOLERANCE * total / shards, total) if total else []
    x = docs.select(*[F.col(f"`{c}`") for c in docs.columns], size_of(text).alias("size"), hash_.alias("_h"), ident.alias("_i"))
    x = x.withColumn("_part", place(F.col("_h"), F.col("_i"), bounds, each))
    # The one exchange of texts: a part's rows meet in a task, which sorts them with spill.
    x = x.withColumn("slot", F.row_number().over(Window.partitionBy("_part").orderBy("_h", "_i")).cast("long") - 1)
    x = x.withColumn("shard", F.floor(F.col("_part") / each).cast("int"))
    if each > 1:
        counted = dict(keys.groupBy(place(F.col("hash"), F.col("id"), bounds, each).alias("p")).count().collect())
        first = [sum(counted.get(q, 0) for q in range(p - p % each, p)) for p in range(shards * each)]
        x = x.withColumn("slot", F.col("slot") + F.get(F.array(*[F.lit(n).cast("long") for n in first]), F.col("_part")))
    return x.drop("_h", "_i", "_part", "_first").select(*docs.columns, "size", "shard", "slot")
