"""Token-id files: canonical length-limited Huffman coding from global counts, decoded by table in blocks.

``tokenised`` encodes documents once and stores their ids. ``write`` counts all ids, makes a canonical code of at most
LIMIT bits (package-merge), sorts the documents by id over ranges and writes segments: whole documents, about
SEGMENT ids, their code bits, and the bit offset of every BLOCK-th id. ``read`` decodes each segment on its own: all its
blocks advance together, a table lookup of LIMIT bits each, so no block waits for another.

Format: a folder with ``codes`` (id, bits: canonical codes go by bits, then id) and ``segments`` (Parquet rows: part and seq
in ascending document order, base: ids before it in its part, n_ids, doc_ids, doc_counts, offsets, data; numbers
little-endian, code bits from each byte's highest bit). The driver holds the counts of the vocabulary and one total for
each part; nothing that grows with the documents.

Defined cases: null text is empty and has the end id only; the strings of special tokens in a text are those tokens, as in
the library; equal ids of documents stand side by side, ordered by their token ids; a null doc_id comes first; an
empty table gives an empty folder that reads as no rows.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftlens.llm.common import BINARY, BYTE_LETTERS, INT, LONG, Pieces, documents, joined, lettered, merged, schema, scratch, small_batches, stored, text_mapped

LIMIT = 16
BLOCK = 512
SEGMENT = 500_000
#: Distinct pieces and words that a worker remembers, and pieces that the library gets at once.
MOST_PIECES = 400_000
MOST_WORDS = 1_000_000
CALL = 20_000
#: Pieces of Latin letters and then ASCII marks, in Arrow's patterns.
PLAIN = r"^(?P<word>\n?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
#: Two characters of white space side by side, in Arrow's patterns; a space that starts a piece, in Python's.
DOUBLE_SPACE = r"[\s\v\x1c-\x1f\x85\pZ]{2}"
SAFE_SPACE = re.compile(r" (?=\S)")
SEGMENTS = schema(part=INT, seq=LONG, base=LONG, n_ids=LONG, doc_ids=BINARY, doc_counts=BINARY, offsets=BINARY, data=BINARY)
DECODED = schema(doc_id=LONG, start=LONG, n_tokens=LONG, ids=BINARY)
NULL_ID = -(2**63)


class Ids:
    """Ids of whole texts by a byte-level tokenizer of the tokenizers library.

    A space before a character that isn't white space always starts a new piece of the pre-tokenizer, and so does a
    line feed between such characters. Texts are cut there, pieces are numbered by Arrow, the library encodes each
    piece that the worker does not know, and the ids of a text's pieces are gathered end to end. Keys of pieces:
    without mark, a space stands before; from a line feed on, as it is; the first after two line feeds.

    Most pieces are PLAIN: letters and then ASCII marks, which the pre-tokenizer always parts. They are cut by Arrow
    as well; the library's model gets each word of letters once, in the alphabet of bytes. The rest goes through the
    whole library, as all pieces do if the tokenizer's normaliser or pre-tokenizer is another one.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.type = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.pieces, self.words = Pieces(self.learn, MOST_PIECES), Pieces(self.learn_words, MOST_WORDS)
        j = json.loads(spec)
        cut = j["pre_tokenizer"] or {}
        self.plain = j["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")

    def raw(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.type == "<u2" else "I"
        return [array(code, e.ids).tobytes() for k in range(0, len(texts), CALL) for e in self.library.encode_batch_fast(texts[k : k + CALL], add_special_tokens=False)]

    def learn(self, pieces: pa.Array) -> list[pa.Array]:
        """Ids of distinct pieces."""
        found = pc.extract_regex(pieces, PLAIN if self.plain else "(?P<word>$.)(?P<marks>)")
        there = found.is_valid()
        word, marks = (pc.fill_null(found.field(k), "") for k in (0, 1))
        # Marks after a word have no space before them: a key of their own.
        parts = pc.binary_join_element_wise(word, pc.binary_join_element_wise("\v", marks, ""), "\n\n")
        lists = pc.split_pattern(parts.filter(there), "\n\n")
        places, rest = np.flatnonzero(there), pieces.filter(pc.invert(there))
        texts = [p[2:] if p.startswith("\n\n") else p if p.startswith("\n") else " " + p for p in rest.to_pylist()]
        ids = [(places, joined(self.words.of(lists.values)[0], lists)), (np.flatnonzero(pc.invert(there)), pa.array(self.raw(texts), pa.binary()))]
        return [merged(len(pieces), ids)]

    def learn_words(self, words: pa.Array) -> list[pa.Array]:
        """Ids of distinct words, each a piece without marks, and of marks after a \\v."""
        code, cut = "H" if self.type == "<u2" else "I", self.library.model.tokenize
        space, feed = BYTE_LETTERS[0x20], BYTE_LETTERS[0x0A]

        def tokens(w: str) -> list[int]:
            if w[0] == "\v":
                return [t.id for t in cut(w[1:])] if len(w) > 1 else []
            return [t.id for k in ((feed, lettered(w[1:])) if w[0] == "\n" else (space + lettered(w),)) for t in cut(k)]

        ids = map(tokens, words.to_pylist())
        return [pa.array([array(code, x).tobytes() for x in ids], pa.binary())]

    def known(self, lists: pa.ListArray) -> pa.Array:
        return joined(self.pieces.of(lists.values)[0], lists)

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text, as binary."""
        texts = texts.fill_null("")
        whole, spaced = pa.array(np.zeros(len(texts), bool)), pc.match_substring_regex(texts, DOUBLE_SPACE)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        kind = np.where(whole.to_numpy(zero_copy_only=False), 2, spaced.to_numpy(zero_copy_only=False).astype(int))
        parts = []
        for k in (0, 1, 2):
            places = np.flatnonzero(kind == k)
            own = texts.take(pa.array(places))
            if k == 0:
                got = self.known(pc.split_pattern(pc.binary_join_element_wise("\n\n", pc.replace_substring(own, "\n", " \n"), ""), " ")) if len(own) else None
            elif k == 1:
                got = self.known(pa.array([SAFE_SPACE.split("\n\n" + t) for t in own.to_pylist()], pa.list_(pa.string())))
            else:
                got = pa.array(self.raw(own.to_pylist()), pa.binary())
            if len(own):
                parts.append((places, got))
        return merged(len(texts), parts) if parts else pa.array([], pa.binary())


_READY: dict[int, Ids] = {}


def ready(spec: str) -> Ids:
    key = hash(spec)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Ids(spec)
    return _READY[key]


def tokenised(docs: DataFrame, tokenizer: str, end: int = 0) -> tuple[DataFrame, str]:
    """doc_id and ids (binary, of the numpy type returned) with the end id appended."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    kind, sent = Ids(spec).type, docs.sparkSession.sparkContext.broadcast(spec)

    def make():
        coder = ready(sent.value)
        tail = np.array([end], coder.type).tobytes()
        return lambda texts: [pc.binary_join_element_wise(coder.encode(texts), tail, b"")]

    return text_mapped(documents(docs), "text", make, {"ids": BINARY}, ["doc_id"], arrow=True), kind


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol by package-merge; 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        bits[used] = 1
        return bits
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    weights, levels = leaf, []
    for _ in range(limit - 1):
        pairs = len(weights) // 2
        packages = weights[: 2 * pairs].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, packages])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < len(leaf))
        weights = both[sort]
    take = 2 * (len(leaf) - 1)
    length = np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    length[:take] += 1
    bits[order] = length
    return bits


def canonical(bits: np.ndarray) -> np.ndarray:
    """Codes that ascend by (bits, symbol)."""
    codes = np.zeros(len(bits), np.uint64)
    used = np.flatnonzero(bits)
    order = used[np.lexsort((used, bits[used]))]
    code, last = 0, 0
    for s in order.tolist():
        code <<= int(bits[s]) - last
        last = int(bits[s])
        codes[s] = code
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of ids, and the bit offset of every BLOCK-th."""
    width = bits[ids]
    ends = np.cumsum(width)
    at = ends - width
    word = at >> 5
    value = codes[ids] << (64 - width - (at & 31)).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::BLOCK].astype("<u8")


class Table:
    """Decoding table: for every string of ``limit`` bits its first symbol and that symbol's bits."""

    def __init__(self, bits: np.ndarray):
        self.limit = max(1, int(bits.max(initial=0)))
        codes, used = canonical(bits), np.flatnonzero(bits)
        order = used[np.lexsort((used, bits[used]))]
        run = 1 << (self.limit - bits[order])
        self.symbol, self.width = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.int64)
        self.symbol[: run.sum()] = np.repeat(order, run)
        self.width[: run.sum()] = np.repeat(bits[order], run)

    def unpack(self, data: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint64)
        window = raw[:-4] << np.uint64(32) | raw[1:-3] << np.uint64(24) | raw[2:-2] << np.uint64(16) | raw[3:-1] << np.uint64(8) | raw[4:]
        at, last = offsets.astype(np.int64), len(window) - 1
        out = np.empty((min(BLOCK, n), len(at)), np.uint32)
        drop, mask = np.int64(40 - self.limit), np.uint64((1 << self.limit) - 1)
        for k in range(len(out)):
            seen = window[np.minimum(at >> 3, last)] >> (drop - (at & 7)).astype(np.uint64) & mask
            out[k] = self.symbol[seen]
            at += self.width[seen]
        return out.T.reshape(-1)[:n] if len(at) > 1 else out[:, 0][:n]


def counted(ids: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs, over all documents; the driver gets one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))
            if len(got) > len(total):
                total, got = got, total
            total[: len(got)] += got
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, schema(id=LONG, n=LONG)).groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([0, *(r["id"] + 1 for r in rows)]), np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write(ids: DataFrame, kind: str, path: str) -> None:
    """ids: a stored table of doc_id and ids (binary of numpy type kind); path: a new folder all executors reach."""
    spark = ids.sparkSession
    bits = code_lengths(counted(ids, kind))
    used = np.flatnonzero(bits).tolist()
    spark.createDataFrame([(i, int(bits[i])) for i in used], "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    sent = spark.sparkContext.broadcast(bits)
    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("base", pa.int64()), ("n_ids", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "doc_counts", "offsets", "data"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codes, bits = TaskContext.get().partitionId(), canonical(sent.value), sent.value
        seq = base = n = 0
        docs: list[int] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            data, offsets = pack(np.concatenate(held), codes, bits)
            sizes = np.array([len(h) for h in held], "<u8")
            row = {"part": part, "seq": seq, "base": base, "n_ids": n, "doc_ids": np.array(docs, "<i8").tobytes(), "doc_counts": sizes.tobytes(), "offsets": offsets.tobytes(), "data": data}
            return pa.RecordBatch.from_pylist([row], arrow)

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, kind)
                docs.append(NULL_ID if doc is None else doc)
                held.append(own)
                n += len(own)
                if n >= SEGMENT:
                    yield close()
                    seq, base, n, docs, held = seq + 1, base + n, 0, [], []
        if held:
            yield close()

    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = ids.select("doc_id", "ids").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(run, SEGMENTS).write.option("compression", "uncompressed").parquet(f"{path}/segments")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary, 32-bit little-endian)."""
    code = {r["id"]: r["bits"] for r in spark.read.schema("id long, bits int").parquet(f"{path}/codes").collect()}
    bits = np.zeros(max([0, *(i + 1 for i in code)]), np.int64)
    bits[list(code)] = list(code.values())
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    sums = dict(segments.groupBy("part").agg(F.sum("n_ids")).collect())
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]
    sent = spark.sparkContext.broadcast((bits, before))
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, before = sent.value
        table = Table(bits)
        for b in batches:
            for r in b.to_pylist():
                ids = table.unpack(r["data"], np.frombuffer(r["offsets"], "<u8"), r["n_ids"]).astype("<u4")
                ends = np.cumsum(np.frombuffer(r["doc_counts"], "<u8").astype(np.int64))
                starts = np.concatenate([[0], ends[:-1]])
                docs = [None if d == NULL_ID else d for d in np.frombuffer(r["doc_ids"], "<i8").tolist()]
                raw = ids.tobytes()
                first = before[r["part"]] + r["base"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(first + starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array([raw[4 * a : 4 * z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    schema=arrow,
                )

    small_batches(spark)
    return segments.mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """Documents tokenised, written to files in the shared folder and read back."""
    spark = docs.sparkSession
    ids, kind = tokenised(docs, tokenizer, end)
    path = scratch(spark, "token-ids")
    write(stored(ids, "ids"), kind, path)
    return read(spark, path)
