"""Token counts of whole texts by a two-tier lookup of pre-token lengths.

Tokenizers of this kind never join characters across white space, so the count
of a text is the sum over its white-space pre-tokens. Tier one is a broadcast
table of frequent pre-tokens and their lengths; a miss is encoded by the
tokenizer itself, in batches, and remembered in the worker's bounded cache.
Pre-tokens are never shuffled; the scan is the only pass over the corpus.

Special strings inside a text hold no white space and are met inside one
pre-token, where the tokenizer treats them as it always does.
"""

from __future__ import annotations

import os
from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame, functions as F, types as T

from flowtriage.llm.common import SLICE, map_texts, slices

#: Entries of tier one, documents it is gathered from, entries of a worker's cache.
FREQUENT, SAMPLED_DOCS, CACHED = 65_536, 2_000, 400_000
#: Longer pre-tokens are encoded each time and remembered nowhere.
LONGEST = 48
PER_DOC = 4_096

_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    """One tokenizer per worker process."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _TOKENIZERS[path] = loaded
    return _TOKENIZERS[path]


def _lengths(path: str, words: list[bytes]) -> list[int]:
    found = _tokenizer(path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    return [len(e) for e in found]


def frequent_lengths(
    docs: DataFrame, text: str, path: str, entries: int = FREQUENT, sampled_docs: int = SAMPLED_DOCS
) -> tuple[bytes, bytes]:
    """Tier one, compact: the pre-tokens as one line-separated blob, their lengths as 16-bit numbers.

    Gathered from about ``sampled_docs`` documents (at most 4,096 pre-tokens of
    each): a warm start only, no result depends on which entries it holds.
    """
    import numpy as np

    share = min(1.0, sampled_docs / max(1, docs.count()))

    def make():
        def work(texts: list[bytes]):
            found = [Counter(w for w in t.split() if len(w) <= LONGEST).most_common(PER_DOC) for t in texts]
            return [[b"\n".join(w for w, _ in c).decode() for c in found], [[n for _, n in c] for c in found]]

        return work

    fields = [T.StructField("words", T.StringType()), T.StructField("counts", T.ArrayType(T.LongType()))]
    total: Counter = Counter()
    for row in map_texts(docs.sample(share, seed=11), text, [], fields, make).toLocalIterator():
        total.update(dict(zip(row.words.encode().split(b"\n"), row.counts)))
    words = [w for w, _ in total.most_common(entries) if w]
    return b"\n".join(words), np.array(_lengths(path, words), dtype=np.uint16).tobytes()


def count_tokens(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    max_tokens: int = 2_048,
    cached: int = CACHED,
    frequent: tuple[bytes, bytes] | None = None,
) -> DataFrame:
    """``keep``, n_bytes, n_tokens, over_limit of every row.

    A null or empty text has no tokens. Repeated rows and equal ids give a row
    each; an empty table an empty result. Input columns named like a result are
    replaced. A pre-token longer than 48 bytes, up to a whole text without white
    space, is encoded on its own.
    """
    blob = docs.sparkSession.sparkContext.broadcast(frequent or frequent_lengths(docs, text, path))

    def make():
        import numpy as np

        words, lengths = blob.value
        first = dict(zip(words.split(b"\n"), np.frombuffer(lengths, np.uint16).tolist())) if words else {}
        known = dict(first)

        def lengths(group: list[tuple[int, bytes]], counts: list[int]) -> None:
            nonlocal known
            split = [part.split() for _, part in group]
            missing = set(chain.from_iterable(split)).difference(known)
            if missing:
                if len(known) + len(missing) > len(first) + cached:
                    known = dict(first)
                    missing = set(chain.from_iterable(split)).difference(known)
                fresh = list(missing)
                known.update(zip(fresh, _lengths(path, fresh)))
            get = known.__getitem__
            for (i, _), words in zip(group, split):
                counts[i] += sum(map(get, words))
            for word in missing:
                if len(word) > LONGEST:
                    del known[word]

        def work(texts: list[bytes]):
            counts, group, size = [0] * len(texts), [], 0
            for i, part in ((i, part) for i, text in enumerate(texts) for part in slices(text)):
                group.append((i, part))
                size += len(part)
                if size >= SLICE:
                    lengths(group, counts)
                    group, size = [], 0
            lengths(group, counts)
            return [[len(t) for t in texts], counts, [n > max_tokens for n in counts]]

        return work

    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
    return map_texts(docs, text, keep, fields, make)
