"""Chat formatting by event sourcing: logs are folded into final messages and rendered with a loss mask.

An event has conv_id, message (the message's place in its conversation), seq, kind, role and text. Kinds:
``start`` opens a message with its role, ``delta`` appends a streamed piece, ``edit`` replaces the text,
``regenerate`` empties it for new deltas, ``delete`` removes the message. Logs are partitioned by conversation and
sorted by (message, seq); one pass folds a message at a time, so a task holds one message and one output
part, however long a conversation is. Long conversations are written as several parts.

Template: a turn of the assistant is ``<s>role\\ntext</s>``, any other turn ``[INST]role\\ntext[/INST]``. Roles are
percent-encoded. In texts a backslash is doubled and a control string gets a backslash after its first
character, so that no control string is left; ``plain`` undoes both.

Defined cases: null text and null role are empty; null message or seq sort first; ties in (message, seq)
go by kind, role and text (rows of a table are a message each, ties by a hash of role and text); a message without a ``start`` has an
empty role; a null conv_id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.llm.common import INT, LONG, STRING, pick, schema, small_batches, stored

CONTROL = re.compile(r"(\[(?=/?INST\])|<(?=/?s>))")
TOKEN = re.compile(r"(\[INST\]|\[/INST\]|<s>|</s>)")
#: Characters after which a conversation goes on in a new part.
PART_CHARS = 1_000_000
PARTS = schema(conv_id=LONG, part=INT, formatted=STRING, loss=T.ArrayType(T.StructType([T.StructField("lo", INT), T.StructField("hi", INT)])))
DIGESTS = schema(conv_id=LONG, n_turns=LONG, turns_sha256=STRING, loss_chars=LONG, loss_sha256=STRING, formatted_chars=LONG)


def escaped(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def plain(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the place of its text in it."""
    mine = role == "assistant"
    head = f"{'<s>' if mine else '[INST]'}{quote(role, safe='')}\n"
    body = escaped(text)
    return f"{head}{body}{'</s>' if mine else '[/INST]'}", len(head), len(head) + len(body)


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn."""
    pieces = TOKEN.split(formatted)
    for k in range(1, len(pieces), 4):
        role, _, body = pieces[k + 1].partition("\n")
        yield unquote(role), plain(body)


def events_of(turns: DataFrame) -> DataFrame:
    """The log of a table of finished turns: a start and one delta for each row."""
    x = pick(turns, "conv_id", "turn", "role", "text")
    x = x.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.monotonically_increasing_id().alias("row")).alias("m"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    both = F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"), F.col("role").alias("role"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit(1).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text").alias("text")),
    )
    return x.select("conv_id", F.col("m.turn").alias("message"), F.xxhash64("role", "text").alias("tie"), F.col("m.row").alias("row"), F.explode(both).alias("e")).select("conv_id", "message", "tie", "row", "e.*")


def ordered(log: DataFrame) -> DataFrame:
    """Partitioned by conversation and sorted as the fold needs it."""
    extra = [c for c in ("tie", "row") if c in log.columns]
    return log.repartition("conv_id").sortWithinPartitions("conv_id", "message", *extra, "seq", "kind", "role", "text")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def folded(events: Iterator[dict]) -> Iterator[tuple[object, str, str]]:
    """Final messages (conv_id, role, text) of a sorted log."""
    key, role, text, alive = None, "", [], False
    for e in events:
        now = (e["conv_id"], e["message"], e.get("row"))
        if now != key:
            if alive:
                yield key[0], role, "".join(text)
            key, role, text, alive = now, "", [], True
        kind = e["kind"]
        if kind == "start":
            role = e["role"] or ""
        elif kind == "delta":
            text.append(e["text"] or "")
        elif kind == "edit":
            text = [e["text"] or ""]
        elif kind == "regenerate":
            text = []
        elif kind == "delete":
            alive = False
    if alive:
        yield key[0], role, "".join(text)


def render_log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    held = 0
    at, open_, part, pieces, loss, size = None, False, 0, [], [], 0

    def close() -> None:
        nonlocal held
        out.append({"conv_id": at, "part": part, "formatted": "".join(pieces), "loss": loss})
        held += size

    for conv, role, text in folded(rows(batches)):
        if open_ and conv != at:
            close()
            part, pieces, loss, size = 0, [], [], 0
        elif open_ and size >= PART_CHARS:
            close()
            part, pieces, loss, size = part + 1, [], [], 0
        if held >= PART_CHARS:
            yield pa.RecordBatch.from_pylist(out, ARROW_PARTS)
            out, held = [], 0
        at, open_ = conv, True
        turn, lo, hi = rendered(role, text)
        if role == "assistant":
            loss.append({"lo": size + lo, "hi": size + hi})
        pieces.append(turn)
        size += len(turn)
    if open_:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, ARROW_PARTS)


def digest_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    at, open_ = None, False
    n = chars = total = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def close() -> dict:
        return {"conv_id": at, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total}

    for r in rows(batches):
        if open_ and r["conv_id"] != at:
            out.append(close())
            n = chars = total = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
        at, open_ = r["conv_id"], True
        for role, text in parsed(r["formatted"]):
            n += 1
            turns.update(f"{role}\n{text}\n".encode())
        for span in r["loss"]:
            text = plain(r["formatted"][span["lo"] : span["hi"]])
            chars += len(text)
            loss.update(text.encode())
        total += len(r["formatted"])
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, ARROW_DIGESTS)
            out = []
    if open_:
        out.append(close())
    if out:
        yield pa.RecordBatch.from_pylist(out, ARROW_DIGESTS)


ARROW_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))])
ARROW_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def formatted(log: DataFrame) -> DataFrame:
    """Rendered conversations: conv_id, part, formatted, loss (code point spans of assistant texts in the part)."""
    small_batches(log.sparkSession)
    return ordered(log).mapInArrow(render_log, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, parsed from its parts in order: counts and digests."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(digest_parts, DIGESTS)


def written(log: DataFrame) -> DataFrame:
    """The rendered parts after a round through files of the shared folder."""
    return stored(formatted(log), "chat")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: two turns whose texts are control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
