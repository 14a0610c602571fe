"""Token ids as fixed-stride binary shards in training order.

The token stream of a table (documents in file order, an end mark after each)
is cut into sequences of equal length. A keyed Feistel permutation, cycle-walked
to the number of sequences, gives every sequence its global slot without any
table of slots, and a slot is found again by the inverse. Shard s holds the
slots from s * per_shard on, one record of fixed stride per slot, so record k
starts at byte k * stride: reading is sequential and resumes at any slot.

A first scan counts tokens per input split, which gives each split its place in
the stream; a second cuts sequences. Each sequence is shuffled once, to the
task that writes its shard. Spark's text sink writes the records; its line end
is the two-byte mark that closes each record and shows torn writes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtriage.llm.common import text_or_empty

#: Tokens of a sequence, sequences of a shard, input splits of one call.
LENGTH, PER_SHARD, MAX_SPLITS = 1_024, 8_192, 2_000_000
ROUNDS = 8
MARK = "\n\n"
_ENCODERS: dict = {}


class Permutation:
    """Keyed bijection of [0, n): a balanced Feistel network over the next even number of bits.

    Values beyond n - 1 are permuted again until they fall inside (cycle
    walking, fewer than four steps on average).
    """

    def __init__(self, n: int, key: str):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        digest = hashlib.sha512(key.encode()).digest()
        self.keys = np.frombuffer(digest, dtype="<u8")[:ROUNDS]

    def _round(self, value: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (value + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _walk(self, values, keys, forward: bool) -> np.ndarray:
        out = np.asarray(values, dtype=np.uint64).copy()
        todo = np.arange(len(out))
        low = np.uint64((1 << self.half) - 1)
        shift = np.uint64(self.half)
        while len(todo):
            x = out[todo]
            left, right = x >> shift, x & low
            for key in keys:
                if forward:
                    left, right = right, left ^ self._round(right, key)
                else:
                    left, right = right ^ self._round(left, key), left
            out[todo] = x = (left << shift) | right
            todo = todo[x >= np.uint64(self.n)]
        return out.astype(np.int64)

    def slots(self, sequences) -> np.ndarray:
        return self._walk(sequences, self.keys, True)

    def sequences(self, slots) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], False)


class Encoder:
    """Byte-pair ids of whole texts as 16-bit numbers, by the library's own encoder; nothing is cached."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if len(ranks) > 0xFFFF:
            raise ValueError("ids beyond 16 bits")
        self.end = len(ranks)
        self._encoding = tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as bytes."""
        return [np.array(self._encoding.encode_ordinary(t.decode()), dtype="<u2").tobytes() for t in texts]

    def count(self, texts: list[bytes]) -> list[int]:
        """Numbers of ids of each text."""
        return [len(self._encoding.encode_ordinary(t.decode())) for t in texts]


def encoder(path: str, pattern: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, pattern)
    return _ENCODERS[path]


def _in_slices(texts: list[bytes], work, slice_bytes: int = 1 << 20) -> Iterator:
    """Results of ``work`` for each text, computed for about a megabyte at a time."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= slice_bytes or i + 1 == len(texts):
            yield from work(texts[start : i + 1])
            start, size = i + 1, 0


_WHERE = ("file_path", "file_block_start")


def write_shards(
    docs: DataFrame,
    folder: str,
    path: str,
    pattern: str,
    key: str,
    text: str = "text",
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
) -> dict:
    """Write the shards below ``folder``; returns tokens, sequences, shards, length, per_shard, key.

    ``docs`` must read files as they are (for derived rows write a table first):
    a row's place in the stream is its place in the files, so a repeated task
    writes the same bytes. A null or empty text gives its end mark only, so do
    repeated rows each time. The last sequence is filled with end marks. No rows
    give no shards. At most two million input splits (a few bytes each) are
    broadcast; more fail before any work.
    """
    spark = docs.sparkSession
    placed = docs.select(
        # the hidden file column, found even where the data has a column of that name
        docs.metadataColumn("_metadata")[_WHERE[0]].alias("file"), docs.metadataColumn("_metadata")[_WHERE[1]].alias("block"),
        text_or_empty(text).alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            # One more for the end mark.
            sizes = pa.array([n + 1 for n in _in_slices(texts, engine.count)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], names=["file", "block", "n"])

    splits = (
        placed.mapInArrow(count, "file string, block long, n long")
        .groupBy("file", "block")
        .agg(F.sum("n").alias("n"))
        .limit(MAX_SPLITS + 1)
        .toPandas()
        .sort_values(["file", "block"])
    )
    if len(splits) > MAX_SPLITS:
        raise ValueError("too many input splits for one call; raise spark.sql.files.maxPartitionBytes")
    tokens = int(splits.n.sum())
    total = -(-tokens // length)
    made = {
        "tokens": tokens, "sequences": total, "shards": -(-total // per_shard),
        "length": length, "per_shard": per_shard, "key": key,
    }
    if not total:
        return made
    starts = spark.sparkContext.broadcast(
        dict(zip(zip(splits.file, splits.block.tolist()), (splits.n.cumsum() - splits.n).tolist()))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, order = encoder(path, pattern), Permutation(total, key)
        at, where, buffer = 0, None, bytearray()
        end = np.array([engine.end], dtype="<u2").tobytes()
        size = 2 * length

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            """Whole sequences of the buffer, and what is left of it at the end of a split."""
            nonlocal at, buffer
            spots, parts = [], []
            start = 0
            while start < len(buffer):
                room = size - 2 * (at % length)
                if len(buffer) - start < room and not last:
                    break
                part = bytes(buffer[start : start + room])
                spots.append(at)
                parts.append(part)
                start += len(part)
                at += len(part) // 2
            del buffer[:start]
            if parts:
                spot = np.array(spots, dtype=np.int64)
                slot = order.slots(spot // length)
                columns = [slot // per_shard, slot, spot % length]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(parts, type=pa.binary())], names=["shard", "slot", "place", "ids"]
                )

        for batch in batches:
            files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for here, ids in zip(zip(files, blocks), _in_slices(texts, engine.encode)):
                if here != where:
                    yield from full(True)
                    where, at = here, starts.value[here]
                buffer += ids
                buffer += end
                if len(buffer) >= 512 * size:
                    yield from full(False)
        yield from full(True)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of a slot follow each other; a record is one slot's parts, filled up."""
        end = np.array([encoder(path, pattern).end], dtype="<u2").tobytes()
        now, parts = None, []
        for batch in batches:
            shards, records = [], []
            for shard, slot, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if now and now[1] != slot:
                    shards.append(now[0])
                    records.append(b"".join(parts))
                    parts = []
                now = (shard, slot)
                parts.append(ids)
            yield _records(shards, records, length, end)
        if now:
            yield _records([now[0]], [b"".join(parts)], length, end)

    pieces = placed.mapInArrow(cut, "shard long, slot long, place long, ids binary")
    (
        pieces.repartitionById(made["shards"], F.col("shard").cast("int"))
        .sortWithinPartitions("shard", "slot", "place")
        .mapInArrow(join, "shard long, record binary")
        .select("shard", F.col("record").cast("string").alias("record"))
        .write.partitionBy("shard")
        .option("lineSep", MARK)
        .text(folder)
    )
    return made


def _records(shards: list[int], records: list[bytes], length: int, end: bytes) -> pa.RecordBatch:
    filled = [r + end * (length - len(r) // 2) for r in records]
    return pa.RecordBatch.from_arrays(
        [pa.array(shards, type=pa.int64()), pa.array(filled, type=pa.binary())], names=["shard", "record"]
    )


def read_slots(spark: SparkSession, folder: str, made: dict, first: int = 0, last: int | None = None) -> DataFrame:
    """slot, sequence, shard and ids (16-bit little-endian) of the slots in [first, last).

    Only the shards of the range are opened, so a run resumes at any slot. A
    record without its closing mark, or a shard of the wrong size, fails.
    """
    last = made["sequences"] if last is None else min(last, made["sequences"])
    length, per_shard = made["length"], made["per_shard"]
    stride = 2 * length + len(MARK)
    if first >= last:
        return spark.createDataFrame([], "slot long, sequence long, shard long, ids binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Permutation(made["sequences"], made["key"])
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                held = min(per_shard, made["sequences"] - shard * per_shard)
                if len(data) != held * stride:
                    raise ValueError(f"shard {shard} has {len(data)} bytes for {held} records of {stride}")
                begin = max(0, first - shard * per_shard)
                stop = min(held, last - shard * per_shard)
                for start in range(begin, stop, 1_024):
                    places = range(start, min(stop, start + 1_024))
                    records = [data[p * stride : (p + 1) * stride] for p in places]
                    if any(r[-len(MARK) :] != MARK.encode() for r in records):
                        raise ValueError(f"shard {shard} holds a torn record")
                    slots = np.array(places, dtype=np.int64) + shard * per_shard
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(slots),
                            pa.array(order.sequences(slots)),
                            pa.array(np.full(len(slots), shard, dtype=np.int64)),
                            pa.array([r[: -len(MARK)] for r in records], type=pa.binary()),
                        ],
                        names=["slot", "sequence", "shard", "ids"],
                    )

    files = spark.read.format("binaryFile").option("basePath", folder).load(folder)
    wanted = files.where(F.col("shard").between(first // per_shard, (last - 1) // per_shard))
    return wanted.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(
        cut, "slot long, sequence long, shard long, ids binary"
    )
