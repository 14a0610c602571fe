"""Alignment of two tokenizations of the same bytes by pointer jumping.

A text is encoded by a byte-level BPE (A, over space+text) and by a
SentencePiece model (B, which adds the space itself). Each token covers a byte
range; every token points to the farthest-right token that overlaps it (an A
token to the B token over its last byte when that ends later, else itself; a
B token to the A token over its last byte, which wins ties). Successor
doubling (p = p[p], vectorised) converges in log steps to the terminal token
of each component; tokens sharing a terminal form a group, and the groups are
exactly the runs between offsets where an A and a B token end together.

Links are the A-B occurrence pairs that end together. Their id pairs are
counted corpus-wide by Spark (partial aggregation, so a frequent pair never
lands in one task whole); each document then looks its links up in the
counted table of pairs linked more than once (absent pairs were linked once),
broadcast as sorted arrays when a row count proves it small, joined by a
shuffle otherwise.

A can be encoded by the ranks file of the same vocabulary (``a_ranks``); the
ids are those of the json (equal on every text of the check tables), token
bytes come from the json's entries.

Defined results: null, empty texts, and texts whose joined token bytes differ
from space+text (an unknown piece, say) have no tokens: zeros and an empty
``groups_sha256``; strings of special tokens are plain text; very long texts
are encoded whole; repeated rows give equal rows and count each time; columns
named like the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowtriage.llm.common import TEXT, text_or_empty, without
from flowtriage.sources.workspace import durable

#: Pairs of the counted table at most for a broadcast lookup (about 17 bytes each).
BROADCAST_PAIRS = 4_000_000
#: Room of a B id in a packed pair.
_SHIFT = 16
SPACE = "▁"


def _byte_level_table() -> dict[str, int]:
    """The public byte-level rule: printable Latin-1 bytes stand for themselves, the rest for 256 onwards in order."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars, extra = {}, 0
    for b in range(256):
        if b in kept:
            chars[chr(b)] = b
        else:
            chars[chr(256 + extra)] = b
            extra += 1
    return chars


class _Ranks:
    """A's encoder from the ranks of the same vocabulary: the same ids, about four times faster than the json's."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]


@lru_cache(maxsize=4)
def tokenizers(a_path: str, b_path: str, a_ranks: tuple[str, str] | None = None):
    """Both tokenizers and the bytes of every id, once per worker; token bytes always come from A's json entries."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    table = _byte_level_table()
    if a_ranks:  # only the entries are needed: read them from the json, build no second encoder
        import json

        with open(a_path, encoding="utf-8") as source:
            spec = json.load(source)
        entries = {i: token for token, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        names = [entries.get(i, "") for i in range(max(entries) + 1)]
    else:
        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        names = [a.id_to_token(i) or "" for i in range(a.get_vocab_size(with_added_tokens=True))]
    a_bytes = [bytes(table[c] for c in token) if all(c in table for c in token) else token.encode() for token in names]
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if b.is_byte(i):
            b_bytes.append(bytes([int(piece[3:5], 16)]))
        else:
            b_bytes.append(piece.replace(SPACE, " ").encode())
    lengths = (np.array([len(x) for x in a_bytes], dtype=np.int64), np.array([len(x) for x in b_bytes], dtype=np.int64))
    if a_ranks:
        a = _Ranks(*a_ranks)
    return a, b, a_bytes, b_bytes, lengths, _digits(max(len(a_bytes), len(b_bytes)))


def encode_a(a, texts: list[str]) -> list[list[int]]:
    if isinstance(a, _Ranks):
        return a.encode_all(texts)
    return [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of every id as a row of bytes, and their count."""
    width = len(str(size))
    table, counts = np.zeros((size, width), dtype=np.uint8), np.zeros(size, dtype=np.int64)
    for i in range(size):
        text = str(i).encode()
        table[i, : len(text)] = np.frombuffer(text, dtype=np.uint8)
        counts[i] = len(text)
    return table, counts


def group_string(a_ids, b_ids, a_last, b_last, digits) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: every group's A ids, then its B ids, groups in order; built without a loop over tokens."""
    table, counts = digits
    group = np.concatenate([np.cumsum(np.r_[0, a_last[:-1]]) * 2, np.cumsum(np.r_[0, b_last[:-1]]) * 2 + 1])
    order = np.argsort(group, kind="stable")
    ids = np.concatenate([a_ids, b_ids])[order]
    marks = np.concatenate([np.where(a_last, ord("|"), ord(",")), np.where(b_last, ord(";"), ord(","))])[order]
    n, width = len(ids), table.shape[1]
    rows = np.zeros((n, width + 1), dtype=np.uint8)
    rows[:, :width] = table[ids]
    used = counts[ids]
    rows[np.arange(n), used] = marks
    used = used + 1
    used[-1] -= 1  # nothing after the last B id
    return rows[np.arange(width + 1)[None, :] < used[:, None]].tobytes()


def groups(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Terminal A token of every token (A tokens first, then B) by pointer jumping."""
    na = len(a_end)
    a_over_b = np.searchsorted(b_end, a_end - 1, side="right")  # B token over an A token's last byte
    b_over_a = np.searchsorted(a_end, b_end - 1, side="right")  # A token over a B token's last byte
    point = np.concatenate([np.where(b_end[a_over_b] > a_end, na + a_over_b, np.arange(na)), b_over_a])
    while True:
        ahead = point[point]
        if np.array_equal(ahead, point):
            return point
        point = ahead


def align(text: bytes, a_ids: list[int], b_ids: list[int], a_bytes, b_bytes, lengths, digits):
    """n_a, n_b, n_groups, n_links, groups string and packed links of one text (zeros when the bytes disagree)."""
    target = b" " + text
    if not text or b"".join(map(a_bytes.__getitem__, a_ids)) != target or b"".join(map(b_bytes.__getitem__, b_ids)) != target:
        return 0, 0, 0, 0, b"", _NO_LINKS
    a_ids, b_ids = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
    a_end, b_end = np.cumsum(lengths[0][a_ids]), np.cumsum(lengths[1][b_ids])
    terminal = groups(a_end, b_end)
    na = len(a_ids)
    ta, tb = terminal[:na], terminal[na:]
    a_last = np.r_[ta[1:] != ta[:-1], True]
    b_last = np.r_[tb[1:] != tb[:-1], True]
    ends, ai, bi = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
    links = (a_ids[ai] << _SHIFT) | b_ids[bi]
    return na, len(b_ids), int(a_last.sum()), len(ends), group_string(a_ids, b_ids, a_last, b_last, digits), links


_NO_LINKS = np.zeros(0, dtype=np.int64)
#: Texts encoded and aligned at a time; bounds a task's memory beside the texts themselves.
CHUNK = 256


FIELDS = (
    T.StructField("n_a", T.LongType()),
    T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()),
    T.StructField("links", T.ArrayType(T.LongType())),
)


def aligned(
    docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: Sequence[str] | None = None,
    a_ranks: tuple[str, str] | None = None,
) -> DataFrame:
    """Every row with counts, its groups' hash and its packed links; one pass, no shuffle.

    ``a_ranks`` (ranks file of A's vocabulary, split pattern) encodes A by those
    ranks instead of the json; the ids must be the json's (tests hold them equal).
    """
    kept = without(docs, [f.name for f in FIELDS] + ["n_best", "count_sum"]) if keep is None else list(keep)
    kept = [c for c in kept if c.lower() not in {f.name for f in FIELDS}]
    schema = T.StructType([*(docs.schema[c] for c in kept), *FIELDS])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, a_bytes, b_bytes, lengths, digits = tokenizers(a_path, b_path, a_ranks)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                texts = [t or b"" for t in part.column(len(kept)).cast(pa.binary()).to_pylist()]
                words = [t.decode("utf-8", "replace") for t in texts]
                a_all = encode_a(a, [" " + w for w in words])
                b_all = b.encode(words)
                out = [align(t, x, y, a_bytes, b_bytes, lengths, digits) for t, x, y in zip(texts, a_all, b_all)]
                links = [o[5] for o in out]
                offsets = np.r_[0, np.cumsum([len(x) for x in links])].astype(np.int32)
                columns = [part.column(i) for i in range(len(kept))] + [
                    pa.array([o[k] for o in out], pa.int64()) for k in range(4)
                ] + [
                    pa.array([hashlib.sha256(o[4]).hexdigest() if o[0] else "" for o in out], pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([_NO_LINKS, *links]), pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(*kept, text_or_empty(text).alias(TEXT)).mapInArrow(run, schema)


@contextmanager
def _arrow_rows(spark, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs run inside; the session's setting is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(min(rows, int(before or rows))))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def pair_counts(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair, count, best) of pairs linked more than once, and (b, top) for every B id.

    A pair that is absent was linked once: its count is 1, and it is the best
    of its B id when that id's top is 1. Leaving those out keeps the table to
    at most half the links, and exact.
    """
    counted = links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    top = counted.groupBy(b_id.alias("b")).agg(F.max("count").alias("top"))
    repeated = counted.where(F.col("count") > 1).join(top, b_id == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("top")).alias("best")
    )
    return repeated, top


def align_corpus(
    docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: Sequence[str] | None = None,
    a_ranks: tuple[str, str] | None = None,
) -> DataFrame:
    """Every row with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    with _arrow_rows(spark, CHUNK):  # a batch of very long texts must not reach a worker whole
        found = durable(aligned(docs, a_path, b_path, text, keep, a_ranks), "alignment")
    repeated, top = pair_counts(found)
    repeated = durable(repeated, "alignment-pairs")
    tops = top.toArrow()  # at most one row per B id
    n_pairs = repeated.count()
    rest = [c for c in found.columns if c != "links"]
    if n_pairs <= BROADCAST_PAIRS:
        table = repeated.orderBy("pair").toArrow()  # proven at most BROADCAST_PAIRS rows
        single_best = np.zeros(1 << _SHIFT, dtype=bool)
        single_best[tops.column("b").to_numpy()] = tops.column("top").to_numpy() == 1
        shared = spark.sparkContext.broadcast((
            table.column("pair").to_numpy(), table.column("count").to_numpy().astype(np.int64),
            table.column("best").to_numpy(zero_copy_only=False), single_best,
        ))
        schema = T.StructType([*(found.schema[c] for c in rest), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokenizers.cache_clear()  # a reused worker needs no encoder here
            keys, counts, best, lone_best = shared.value
            for whole in batches:
                for start in range(0, whole.num_rows, CHUNK):  # bounded arrays however many links a batch has
                    batch = whole.slice(start, CHUNK)
                    lists = batch.column("links")
                    offsets = lists.offsets.to_numpy()
                    offsets = offsets - offsets[0]
                    pairs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                    known = (keys[at] == pairs) if len(keys) else np.zeros(len(pairs), dtype=bool)
                    count = np.where(known, counts[at] if len(keys) else 1, 1)
                    good = np.where(known, best[at] if len(keys) else False, lone_best[pairs & ((1 << _SHIFT) - 1)])
                    ends = np.cumsum(np.r_[0, good.astype(np.int64)]), np.cumsum(np.r_[0, count])
                    n_best = ends[0][offsets[1:]] - ends[0][offsets[:-1]]
                    count_sum = ends[1][offsets[1:]] - ends[1][offsets[:-1]]
                    columns = [batch.column(c) for c in rest] + [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*rest, "n_best", "count_sum"])

        return found.mapInArrow(look, schema)
    b_id = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    keyed = found.withColumn("_row", F.monotonically_increasing_id())
    links = keyed.select("_row", F.explode("links").alias("pair"))
    looked = (
        links.join(repeated, "pair", "left")
        .join(F.broadcast(top), b_id == F.col("b"))  # at most one row per B id
        .select("_row", F.coalesce("count", F.lit(1)).alias("count"), F.coalesce("best", F.col("top") == 1).alias("best"))
    )
    sums = looked.groupBy("_row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    return (
        keyed.join(sums, "_row", "left")
        .select(*rest, F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"))
    )
