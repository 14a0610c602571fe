"""SimHash near-duplicates with pigeonring filtering.

A fingerprint bit is set if it is set in more than half of the shingle hashes
of a text. The 64 bits form a ring of three segments. If two fingerprints
differ in at most two bits, then from some segment on every chain of l
consecutive segments differs in at most 2 l / 3 bits, rounded down: none in the
first, at most one in the first two. So they agree in a whole segment and in at
least one half of the next: the bucket key. Within a bucket the longer chains
are tested first, then the full distance.

A bucket larger than a worker should compare pairwise (near copies crowd into
few buckets) is linked exactly in linear size instead: two fingerprints are at
most two bits apart if and only if some value is at most one bit from both, so
each of its fingerprints emits its 65 such values and links to the least
fingerprint that shares one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowtriage.llm.common import map_texts, slices
from flowtriage.llm.components import smallest_reachable
from flowtriage.sources.workspace import durable

WORDS, BITS, SEED = 3, 2, 42
#: A bucket with more fingerprints is linked through one-bit neighbours.
PAIRWISE = 256
#: Fixed layout: [lowest bit, bits] of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    counts = np.zeros(64, dtype=np.int64)
    lanes = np.uint64(0x0101010101010101)
    for start in range(0, len(hashes), 255 * 512):
        part = hashes[start : start + 255 * 512]
        full = len(part) // 255 * 255
        blocks = [part[:full].reshape(255, -1)] if full else []
        if full < len(part):
            blocks.append(part[full:].reshape(-1, 1))
        for block in blocks:
            for shift in range(8):
                sums = ((block >> np.uint64(shift)) & lanes).sum(axis=0, dtype=np.uint64)
                counts[shift::8] += sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text; zero if it has no words."""
    from xxhash import xxh64_intdigest

    parts: list[bytes] = []
    counts, total = np.zeros(64, dtype=np.int64), 0
    for part in slices(text.lower()):
        # The last words of a slice begin shingles that end in the next.
        parts = parts[-(words - 1) :] + part.split() if words > 1 else part.split()
        if words == 3:
            shingles = [xxh64_intdigest(b"%b %b %b" % w, SEED) for w in zip(parts, parts[1:], parts[2:])]
        else:
            shingles = [xxh64_intdigest(b" ".join(parts[i : i + words]), SEED) for i in range(len(parts) - words + 1)]
        counts += _bit_counts(np.array(shingles, dtype=np.uint64))
        total += len(shingles)
    if not total:
        return xxh64_intdigest(b" ".join(parts), SEED) if parts else 0
    set_bits = np.flatnonzero(2 * counts > total)
    return int(np.bitwise_or.reduce(np.uint64(1) << set_bits.astype(np.uint64))) if len(set_bits) else 0


def fingerprints(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = WORDS
) -> DataFrame:
    """``keep`` and the fingerprint as a signed long (its bits), one row per row."""

    def make():
        def work(texts: list[bytes]):
            return [np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)]

        return work

    return map_texts(docs, text, keep, [T.StructField("fingerprint", T.LongType())], make)


def _segment(value, segment: int):
    low, bits = SEGMENTS[segment]
    return F.shiftrightunsigned(value, low).bitwiseAND((1 << bits) - 1)


def _keys(value):
    """Six bucket keys: segment i whole, and a half of segment i + 1."""
    keys = []
    for i in range(3):
        whole, (low, bits) = _segment(value, i), SEGMENTS[(i + 1) % 3]
        for half, (start, width) in enumerate(((low, bits // 2), (low + bits // 2, bits - bits // 2))):
            part = F.shiftrightunsigned(value, start).bitwiseAND((1 << width) - 1)
            keys.append(F.lit((2 * i + half) << 40).bitwiseOR(F.shiftleft(whole, 14)).bitwiseOR(part))
    return F.array(*keys)


def _close_pairs(values: np.ndarray, start: int, bits: int) -> list[tuple[int, int]]:
    """Links inside one bucket: chains of one and two segments from ``start``, then all 64 bits."""
    found = []
    masks = [np.uint64(((1 << b) - 1) << low) for low, b in (SEGMENTS[(start + k) % 3] for k in range(3))]
    for i in range(len(values) - 1):
        differing = values[i] ^ values[i + 1 :]
        chain = np.zeros(len(differing), dtype=np.uint8)
        alive = np.arange(len(differing))
        for k, mask in enumerate(masks):
            chain[alive] += np.bitwise_count(differing[alive] & mask)
            alive = alive[chain[alive] <= bits * (k + 1) // 3]
        found += [(int(values[i]), int(values[i + 1 + j])) for j in alive]
    return found


def links(distinct: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at most two bits apart.

    Every fingerprint is connected to all within two bits of it, directly in
    small buckets and through a common neighbour's least fingerprint in large
    ones. ``distinct`` has one column ``fingerprint`` without repetitions.
    """
    keyed = distinct.select("fingerprint", F.explode(_keys(F.col("fingerprint"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = sizes.where(F.col("n") > pairwise).select("key")
    small = keyed.join(sizes.where(F.col("n") <= pairwise), "key", "left_semi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for key, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.sort(members.values.to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
                for x, y in _close_pairs(values, (key >> 40) // 2, BITS):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"]
            )

    near = (
        small.groupBy("key").agg(F.collect_list("fingerprint").alias("members")).mapInArrow(compare, "a long, b long")
    )
    one = F.lit(1).cast("long")
    around = F.array(
        F.col("fingerprint"), *[F.col("fingerprint").bitwiseXOR(F.shiftleft(one, k)) for k in range(64)]
    )
    hot = keyed.join(crowded, "key", "left_semi").select("fingerprint").distinct()
    shared = durable(hot.select("fingerprint", F.explode(around).alias("near")), "simhash-near")
    hubs = shared.groupBy("near").agg(F.min("fingerprint").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = (
        shared.join(hubs.select("near", "hub"), "near")
        .where(F.col("fingerprint") != F.col("hub"))
        .select(F.col("fingerprint").alias("a"), F.col("hub").alias("b"))
    )
    return near.unionByName(stars).distinct()


def shown(value: str) -> Column:
    """A fingerprint as 16 hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    pairwise: int = PAIRWISE,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the least doc_id reachable over links.

    One row per row of ``docs``; exact copies meet in one fingerprint before
    anything is compared. Texts without words, null and empty ones included,
    have the fingerprint zero and are linked like any other. A null id stays
    null and takes no part in the choice of component_id (null only if all ids
    of a component are). No link is lost whatever the sizes of the groups.
    """
    marked = durable(
        fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words), "simhash"
    )
    distinct = durable(
        marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-distinct"
    )
    component = smallest_reachable(links(distinct.select("fingerprint"), pairwise), distinct, "fingerprint", "least")
    by_print = distinct.join(component, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "least").alias("component_id")
    )
    # As a table, so that both sides of the join are plain shuffles, whose hot fingerprints Spark splits.
    by_print = durable(by_print, "simhash-components")
    return marked.join(by_print, "fingerprint").select("doc_id", shown("fingerprint").alias("fingerprint"), "component_id")
