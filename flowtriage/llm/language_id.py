"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. One binary classifier per bit tells
the languages whose bit is 1 from those whose bit is 0; each is a naive Bayes
model over hashed byte n-grams (1 to 4 bytes of the lower-cased text, words
parted by one space). Decoding sums a logistic loss per bit between the
classifier's margin and each codeword and chooses the codeword of least loss;
a small gap to the second one flags the prediction as ambiguous.

Training reads the n-gram counts of every training document once: each task
sums its documents' counts per language, Spark sums those per (language,
bucket). The model is languages x BUCKETS counts, then bits x BUCKETS weights:
its size is fixed by the parameters, never by the corpus, and only that is
broadcast.

Defined results:

- A null text, or one without a letter, gives ``und`` with score 0.0 and is
  not ambiguous; with no training language at all every row gives ``und``.
- One training language: every text with a letter gets it with score 1.0.
- Very long texts are read whole, n-grams of a slice at a time. Letters are
  those of Unicode; n-grams see A-Z lower-cased and bytes of other scripts.
- Repeated rows are scored alike and each counts in training.
- A null doc_id or lang keeps the row out of training; it is still scored.
- Columns named like the results are replaced; an empty table gives none.
- More than MAX_LANGUAGES distinct training languages raise ValueError before
  any count reaches the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowtriage.llm.common import map_texts, slices, without

#: Hash buckets of n-grams; n-gram lengths in bytes; additive smoothing; loss gap under which a row is ambiguous.
BUCKETS, ORDERS, ALPHA, GAP = 1 << 18, (1, 2, 3, 4), 0.5, 1.0
#: Exhaustive codes up to this many languages, random dense codes with CODE_BITS_PER_LOG2 x log2(L) bits above.
EXHAUSTIVE, CODE_BITS_PER_LOG2 = 7, 10
#: N-grams a training task holds before it counts them (8 bytes each).
COUNT_CHUNK = 1 << 22
#: Languages a model may learn at most: the driver builds languages x BUCKETS counts (2 MB each).
MAX_LANGUAGES = 256
#: Language of texts without letters.
UNDEFINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER, _HIGH = re.compile(rb"[A-Za-z]"), re.compile(rb"[\x80-\xff]")
#: Byte map before n-grams: A-Z to a-z, other ASCII but a-z to a space, bytes of other scripts kept.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, remainder 2 of 4; a null id is not held out (and not trained on)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def ngram_buckets(text: bytes) -> np.ndarray:
    """Bucket of every byte n-gram of a UTF-8 text, A-Z lower-cased and other ASCII but a-z turned into spaces."""
    parts = []
    for piece in slices(b" " + text.translate(_WORD_BYTES) + b" "):
        data = np.frombuffer(piece, dtype=np.uint8).astype(np.uint64)
        h = np.zeros(len(data), dtype=np.uint64)
        for n in ORDERS:
            if len(data) < n:
                break
            h = h[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] + np.uint64(n)
            parts.append((h * _MULTIPLY) >> np.uint64(64 - BUCKETS.bit_length() + 1))
    return np.concatenate(parts).astype(np.intp) if parts else np.zeros(0, dtype=np.intp)


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (bool(_HIGH.search(text)) and bool(_LETTER.search(text.decode("utf-8", "replace"))))


def codewords(n: int) -> np.ndarray:
    """Rows of +1/-1, one per language: all splits for few languages, the best of seeded random codes beyond."""
    if n < 2:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        columns = [[1 if (split >> (n - 1 - r)) & 1 or r == 0 else -1 for r in range(n)] for split in range(2 ** (n - 1) - 1)]
        return np.array(columns, dtype=float).T
    bits = math.ceil(CODE_BITS_PER_LOG2 * math.log2(n))
    rng, best, spread = np.random.default_rng(0), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        distance = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if distance > spread:
            best, spread = code, distance
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, +1/-1
    weights: np.ndarray  # bits x BUCKETS, float32: log-likelihood ratio of each bucket per bit

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNDEFINED, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        grams = ngram_buckets(text)
        margin = np.take(self.weights, grams, axis=1).sum(axis=1, dtype=np.float64) / math.sqrt(max(len(grams), 1))
        loss = np.logaddexp(0.0, -margin[None, :] * self.code).sum(axis=1)
        order = np.lexsort((np.arange(len(loss)), loss))
        first, second = order[0], order[1]
        share = float(1.0 / np.exp(loss[first] - loss).sum())
        return self.languages[first], min(max(share, 0.0), 1.0), bool(loss[second] - loss[first] < GAP)


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language of one task; n-grams wait in groups of at most COUNT_CHUNK before they are counted."""
    sums: dict[str, np.ndarray] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def count(lang: str) -> None:
        found = np.bincount(np.concatenate(waiting.pop(lang)), minlength=BUCKETS)
        sums[lang] = sums[lang] + found if lang in sums else found
        sizes[lang] = 0

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            grams = ngram_buckets(text)
            waiting.setdefault(lang, []).append(grams)
            sizes[lang] = sizes.get(lang, 0) + len(grams)
            if sizes[lang] >= COUNT_CHUNK:
                count(lang)
    for lang in list(waiting):
        count(lang)
    for lang, found in sums.items():
        where = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(where), pa.string()), pa.array(where, pa.int32()), pa.array(found[where], pa.int64())],
            names=["lang", "bucket", "n"],
        )


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Counts of every training row (lang not null, doc_id not held out), naive Bayes weights per bit."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    found = rows.agg(F.count_distinct(F.col(lang).cast("string"))).first()[0]
    if found > MAX_LANGUAGES:
        raise ValueError(f"{found} training languages; at most {MAX_LANGUAGES} fit the driver's count table")
    counted = (
        rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))
        .mapInArrow(_count_partition, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    table = counted.toArrow()  # at most languages x BUCKETS rows
    languages = tuple(sorted(set(table.column("lang").to_pylist())))
    code = codewords(len(languages))
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        place = {name: i for i, name in enumerate(languages)}
        which = np.array([place[name] for name in table.column("lang").to_pylist()], dtype=np.int64)
        counts[which, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    log_p = np.log((counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * BUCKETS)) if languages else counts
    weights = np.zeros((code.shape[1], BUCKETS), dtype=np.float32)
    for k in range(code.shape[1]):
        on, off = code[:, k] > 0, code[:, k] < 0
        mix_on = np.logaddexp.reduce(log_p[on], axis=0) - math.log(on.sum())
        mix_off = np.logaddexp.reduce(log_p[off], axis=0) - math.log(off.sum())
        weights[k] = mix_on - mix_off
    return Model(languages, code, weights)


RESULTS = (
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("ambiguous", T.BooleanType()),
)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Every row with held_out, lang_pred, score and ambiguous; no shuffle, the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        found = shared.value

        def work(texts: list[bytes]) -> list[list]:
            out = [found.predict(t) for t in texts]
            return [[o[0] for o in out], [o[1] for o in out], [o[2] for o in out]]

        return work

    flagged = docs.withColumn("held_out", held_out(doc_id))
    kept = without(flagged, [f.name for f in RESULTS]) if keep is None else [c for c in keep if c != "held_out"] + ["held_out"]
    return map_texts(flagged, text, kept, RESULTS, make)
