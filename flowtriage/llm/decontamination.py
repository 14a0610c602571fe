"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items form one automaton. Documents stream through it a
word at a time; the state keeps the longest suffix of the words read so far
that occurs in an item. Where it is at least a window long, the words under it
are hit; items shorter than a window count when they occur whole. No document
word is shuffled: one scan, and the automaton is the only thing broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from itertools import chain

from pyspark.sql import DataFrame, functions as F, types as T

from flowtriage.llm.common import map_texts, plain_word_parts, plain_words

#: Words of a window; words all items of one automaton may have together.
WINDOW, MAX_ITEM_WORDS = 10, 4_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class ItemAutomaton:
    """Suffix automaton over the word sequences of the items.

    Every item ends in a mark of its own that no document word equals, so no
    match runs over the end of an item.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last, ends = 0, []
        for number, (_, words) in enumerate(items):
            for word in words:
                last = self._add(last, self.words.setdefault(word, len(self.words)))
                ends.append((last, number))
            last = self._add(last, -1 - number)
        self._index(items, ends)

    def _add(self, last: int, symbol: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in nxt[at]:
            nxt[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = nxt[at][symbol]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and nxt[at].get(symbol) == target:
                    nxt[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        return new

    def _index(self, items, ends) -> None:
        """Per state: the ancestor that stands for the last window, and short items that end there."""
        size = self.window
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.last_window = [-1] * len(order)
        for state in order[1:]:
            above = self.link[state]
            if self.length[state] >= size:
                self.last_window[state] = state if self.length[above] < size else self.last_window[above]
        held: dict[int, set[int]] = {}
        for state, number in ends:
            for at in {self.last_window[state]} - {-1}:
                held.setdefault(at, set()).add(number)
        whole: dict[int, dict[int, int]] = {}
        for number, (_, words) in enumerate(items):
            if 0 < len(words) < size:
                state = 0
                for word in words:
                    state = self.next[state][self.words[word]]
                whole.setdefault(state, {})[number] = len(words)
        self.items_of = {k: tuple(v) for k, v in held.items()}
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        for state in order[1:]:
            found = self.short.get(self.link[state], ())
            found += tuple((n, number) for number, n in whole.get(state, {}).items())
            if found:
                self.short[state] = found
        self.names = [name for name, _ in items]

    def hits(self, words: Iterable[bytes]) -> tuple[list[list[int]], set[int]]:
        """Merged [first, last] spans of hit words, and the numbers of the items found."""
        nxt, link, length = self.next, self.link, self.length
        short, size, last_window = self.short, self.window, self.last_window
        spans: list[list[int]] = []
        windows: set[int] = set()
        found: set[int] = set()
        state = matched = 0
        for place, word in enumerate(map(self.words.get, words)):
            if word is None:
                state = matched = 0
                continue
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word not in nxt[state]:
                continue
            state = nxt[state][word]
            matched += 1
            reach = 0
            if matched >= size:
                reach = matched
                windows.add(last_window[state])
            if state in short:
                for n, number in short[state]:
                    if n <= matched:
                        found.add(number)
                        reach = max(reach, n)
            if reach:
                first = place - reach + 1
                while spans and first <= spans[-1][1] + 1:
                    first = min(first, spans.pop()[0])
                spans.append([first, place])
        for at in windows:
            found.update(self.items_of[at])
        return spans, found


def build_automaton(items: DataFrame, item_id: str, text: str, window: int = WINDOW, limit: int = MAX_ITEM_WORDS):
    """The items' automaton, built on the driver; test sets are small and their size is checked first.

    More than ``limit`` words fail with a message: decontaminate then in groups
    of items, one call after the other.
    """
    size = items.agg(F.sum(F.length(text))).first()[0] or 0
    if size > 16 * limit:
        raise ValueError(f"test items of {size} characters exceed the bound for one automaton; pass them in groups")
    rows = items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))
    return ItemAutomaton([(r[0], plain_words((r[1] or "").encode())) for r in rows], window)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_span: int = 1,
    max_coverage: float = 0.5,
) -> DataFrame:
    """``keep`` plus what occurs of the items in each document and the text without it.

    n_words, n_hit, n_items, item_ids (sorted strings), items_sha256, spans
    ([first word, last word], at least ``min_span`` words), coverage
    (n_hit / n_words), rejected (coverage above ``max_coverage``) and
    clean_text: the text without the words from the first to the last of each
    span; the original text if there is none.

    Null and empty texts have no words and stay as they are, as do all texts if
    there are no items. Equal items are all found; items without an id hit
    words and are counted but appear in no list. Equal documents give equal rows. Input columns
    named like a result are replaced.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(build_automaton(items, item_id, item_text, window))

    def make():
        tree = automaton.value
        names = tree.names

        def one(text_bytes: bytes):
            n_words = 0

            def counted(part: list[bytes]) -> list[bytes]:
                nonlocal n_words
                n_words += len(part)
                return part

            spans, found = tree.hits(chain.from_iterable(map(counted, plain_word_parts(text_bytes))))
            hit = sum(b - a + 1 for a, b in spans)
            ids = sorted({names[i] for i in found} - {None})
            coverage = hit / n_words if n_words else 0.0
            clean = text_bytes
            cut = [s for s in spans if s[1] - s[0] + 1 >= min_span]
            if cut:
                rest, at, ahead, start = [], 0, iter(cut), 0
                first, last = next(ahead)
                for place, word in enumerate(_WORD.finditer(text_bytes)):
                    if place == first:
                        start = word.start()
                    if place == last:
                        rest.append(text_bytes[at:start])
                        at = word.end()
                        first, last = next(ahead, (-1, -1))
                        if last < 0:
                            break
                clean = b"".join([*rest, text_bytes[at:]])
            digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
            n_items = len(ids) + sum(names[i] is None for i in found)
            return n_words, hit, n_items, ids, digest, cut, coverage, coverage > max_coverage, clean.decode()

        return lambda texts: list(zip(*map(one, texts)))

    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("coverage", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
        T.StructField("clean_text", T.StringType()),
    ]
    return map_texts(docs, text, keep, fields, make)
