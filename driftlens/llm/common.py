"""What the training-data operators share: column choice, scratch tables and the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of an Arrow batch; a batch of whole texts must fit in a worker many times over. A longer text is a batch alone.
BATCH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(df: DataFrame, name: str) -> int:
    """Place of a column: the first of exactly this name, else the first that differs in case only."""
    names = df.columns
    if name in names:
        return names.index(name)
    folded = [x.lower() for x in names]
    if name.lower() in folded:
        return folded.index(name.lower())
    raise ValueError(f"no column {name} among {names}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table has, clashing names included."""
    places = [at(df, n) for n in names]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(n) for i, n in zip(places, names, strict=True)])


def documents(df: DataFrame) -> DataFrame:
    """doc_id as long and text as string."""
    return pick(df, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def apart(df: DataFrame, *taken: str) -> DataFrame:
    """The table with every column renamed that an operator's own columns would clash with.

    A clash is judged without case; a renamed column gets ``_in`` as often as needed.
    """
    seen, out = {t.lower() for t in taken}, []
    for name in df.columns:
        while name.lower() in seen:
            name += "_in"
        seen.add(name.lower())
        out.append(name)
    return df.toDF(*out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where the master is local."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="driftlens-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame, collect: bool = True) -> None:
    """Deletes stored tables once all that reads them is stored as well.

    With collect the driver's garbage goes too: Spark keeps the shuffle files of ended jobs until then.
    """
    for t in tables:
        removed(t.sparkSession, t.scratch_path)
    if collect and tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def drop_scratch(spark: SparkSession) -> None:
    """Deletes this application's scratch tables; call it once its results have been written."""
    removed(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts within a worker's memory, whatever the texts' lengths.

    The setting stays, as plans run after their operator has returned; it bounds batches and changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(key).rstrip("bB")
    if not known.isdigit() or not 0 < int(known) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def hex_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


LONG, INT, STRING, DOUBLE, BOOL, BINARY = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.BinaryType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def text_mapped(df: DataFrame, text: str, make, fields: dict[str, T.DataType], keep: list[str] | None = None, arrow: bool = False) -> DataFrame:
    """The kept columns and new ones that a function of whole texts gives, batch by batch.

    make() is called once in each task and returns a function from a list of texts as UTF-8 bytes (or None), or with
    arrow from an Arrow array of them, to a list of new columns; batches are streamed, so a task holds one batch.
    """
    small_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    place, kept = df.columns.index(text), [df.columns.index(k) for k in keep]
    out = T.StructType([df.schema.fields[k] for k in kept] + [T.StructField(n, t) for n, t in fields.items()])
    kinds = to_arrow_schema(T.StructType(out.fields[len(kept) :])).types

    def run(batches):
        function = make()
        for b in batches:
            new = function(b.column(place) if arrow else b.column(place).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *(v if arrow else pa.array(v, t) for v, t in zip(new, kinds, strict=True))], names=out.names)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(trimmed(run), out)


def trimmed(run):
    """The same, and memory that it has freed goes back to the system: a worker stays for tasks of other operators."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return task


class Pieces:
    """What a function gives for pieces of texts, kept for pieces seen lately.

    learn: from an Arrow array of distinct pieces to a list of arrays of their values. Pieces and values are held in Arrow
    arrays. When there are more than ``most`` pieces, or PIECE_BYTES times as many bytes, those not asked for since the
    last time go; if that leaves more than half, all go.
    """

    PIECE_BYTES = 64

    def __init__(self, learn, most: int):
        self.learn, self.most = learn, most
        self.keys, self.values, self.used = pa.array([], pa.string()), None, np.zeros(0, bool)

    def of(self, pieces: pa.Array) -> list[pa.Array]:
        """The values of each piece, in order; equal pieces cost a hash lookup each."""
        coded = pieces.dictionary_encode()
        places = pc.index_in(coded.dictionary, value_set=self.keys)
        new = coded.dictionary.filter(pc.is_null(places))
        self.used[places.drop_null().to_numpy()] = True
        if len(new) or self.values is None:
            learnt = self.learn(new)
            self.values = [pa.concat_arrays([v, n]) for v, n in zip(self.values, learnt, strict=True)] if self.values else learnt
            self.keys = pa.concat_arrays([self.keys, new])
            full, first = places.to_numpy(zero_copy_only=False), len(self.used)
            missing = np.isnan(full) if full.dtype.kind == "f" else np.zeros(len(full), bool)
            full = np.where(missing, first + np.cumsum(missing) - 1, full).astype(np.int32)
            self.used = np.concatenate([self.used, np.ones(len(new), bool)])
        else:
            full = places.to_numpy()
        at_ = pa.array(full[coded.indices.to_numpy()])
        out = [v.take(at_) for v in self.values]
        if self.share() > 1:
            self.filter(self.used)
            if self.share() > 0.5:
                self.filter(np.zeros(len(self.used), bool))
        return out

    def share(self) -> float:
        """How much of what may be held is held."""
        held = self.keys.nbytes + sum(v.nbytes for v in self.values)
        return max(len(self.keys) / self.most, held / (self.most * self.PIECE_BYTES))

    def filter(self, stay: np.ndarray) -> None:
        mask = pa.array(stay)
        self.keys, self.values = self.keys.filter(mask), [v.filter(mask) for v in self.values]
        self.used = np.zeros(len(self.keys), bool)


def byte_letters() -> dict[int, str]:
    """The alphabet of byte-level tokenizers: a byte that prints stands for itself, others are numbered from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


def lettered(word: str) -> str:
    """A word in that alphabet; no controls or spaces in it if it is ASCII."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)


def joined(values: pa.Array, lists: pa.ListArray) -> pa.Array:
    """The values of each list of pieces end to end, as binary."""
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, values.cast(pa.binary())), b"")


def merged(n: int, parts: list[tuple[np.ndarray, pa.Array]]) -> pa.Array:
    """One array of n values from arrays of the values at some places each."""
    if len(parts) == 1:
        return parts[0][1]
    places = np.empty(n, np.int64)
    places[np.concatenate([p for p, _ in parts])] = np.arange(n)
    return pa.concat_arrays([v for _, v in parts]).take(pa.array(places))
