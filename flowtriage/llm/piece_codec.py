"""SentencePiece BPE encoding and decoding by a prefix table.

A piece sequence is the encoding of its text exactly if every two neighbours
are compatible, that is, if their joint text is encoded as these two. So each
prefix of a word has one last piece that belongs to its encoding: of all
vocabulary pieces that end there (an automaton lists them), the one that is
compatible with the last piece of the prefix before it. One pass over the word
fills the table; ids are read from its end backwards.

No piece holds a space after another character or a line break, so words are
encoded one at a time, and each worker remembers the ids of words it has met.
"""

from __future__ import annotations

import hashlib
import re
from array import array

from pyspark.sql import DataFrame, types as T

from flowtriage.llm.common import map_texts, slices

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
#: Entries of a worker's caches: words, and piece pairs tested.
WORDS, PAIRS = 400_000, 1_500_000
#: Longer words are encoded each time.
LONGEST = 64
_CHUNK = re.compile(rb" *[^ \n]+|\n| +")
#: Where a long text may be cut: before the first space of a run, and before a line break.
_PART = re.compile(rb"(?<! ) |\n")
_CODECS: dict = {}


class PieceCodec:
    """Encoder and decoder of one model; the model file gives pieces and scores only."""

    def __init__(self, path: str, words: int = WORDS, pairs: int = PAIRS):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.pieces: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [-1] * 256
        self.byte_of: dict[int, int] = {}
        self.surface: list[bytes] = []
        self.automaton = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            elif model.is_control(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace(SPACE, " ").encode())
                if not model.is_unused(i):
                    self.pieces[piece] = i
                    self.score[piece] = model.get_score(i)
                    self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        if min(self.byte_id) < 0 or any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("the model lacks byte pieces or has pieces across words")
        self.begins = {i for p, i in self.pieces.items() if p[0] == SPACE}
        self.controls = {i for i, s in enumerate(self.surface) if not s}
        self._compatible: dict[tuple[str, str], bool] = {}
        self._ids: dict[bytes, bytes] = {}
        self._words, self._pairs = words, pairs

    def _merge(self, text: str) -> list[str]:
        """Encoding of a short text by merging: the best-scored pair first, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._compatible.get(key)
        if known is None:
            known = self._compatible[key] = self._merge(left + right) == [left, right]
            if len(self._compatible) > self._pairs:
                self._compatible.clear()
        return known

    def split(self, word: str) -> list[str]:
        """Pieces of a word (spaces already marked); a character outside the vocabulary stands alone."""
        last = list(word)
        tested = self._compatible
        filled = -1
        for end, (n, piece) in self.automaton.iter(word):
            if end == filled:
                continue
            if n <= end:
                left = last[end - n]
                fits = tested.get((left, piece))
                if not (self._fits(left, piece) if fits is None else fits):
                    continue
            last[end] = piece
            filled = end
        pieces, end = [], len(word) - 1
        while end >= 0:
            pieces.append(last[end])
            end -= len(last[end])
        pieces.reverse()
        return pieces

    def _word_ids(self, chunk: bytes) -> bytes:
        ids = array("I")
        for piece in self.split(chunk.decode().replace(" ", SPACE)):
            number = self.pieces.get(piece)
            if number is None:
                ids.extend(self.byte_id[b] for b in piece.encode())
            else:
                ids.append(number)
        return ids.tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids with begin and end, as unsigned 32-bit little-endian numbers."""
        if not text:
            return array("I", [self.begin, self.end]).tobytes()
        if _SPACE_BYTES in text:
            text = text.replace(_SPACE_BYTES, b" ")
        begin, end = (array("I", [i]).tobytes() for i in (self.begin, self.end))
        return b"".join([begin, *map(self._part_ids, slices(b" " + text, cut=_PART)), end])

    def _part_ids(self, part: bytes) -> bytes:
        chunks = _CHUNK.findall(part)
        known = self._ids
        fresh = set(chunks).difference(known)
        if fresh:
            if len(known) + len(fresh) > self._words:
                known.clear()
                fresh = set(chunks)
            for chunk in fresh:
                known[chunk] = self._word_ids(chunk)
        ids = b"".join(map(known.__getitem__, chunks))
        for chunk in fresh:
            if len(chunk) > LONGEST:
                del known[chunk]
        return ids

    def decode(self, ids: bytes) -> bytes:
        """Text of an id sequence, in UTF-8; bytes that are no character become U+FFFD each."""
        numbers = array("I")
        numbers.frombytes(ids)
        numbers = numbers.tolist()
        if not self.controls.isdisjoint(numbers[1:-1]):
            return self._decode_parts(numbers)
        first = next((i for i in numbers if i not in self.controls), None)
        joined = b"".join(map(self.surface.__getitem__, numbers))
        if first in self.begins:
            joined = joined[1:]
        try:
            joined.decode()
            return joined
        except UnicodeDecodeError:
            return _repaired(joined)

    def _decode_parts(self, numbers: list[int]) -> bytes:
        """Control ids in the midst of a sequence part the bytes beside them."""
        parts: list[list[int]] = [[]]
        for number in numbers:
            if number in self.controls:
                parts.append([])
            else:
                parts[-1].append(number)
        parts = [p for p in parts if p]
        out = [_repaired(b"".join(map(self.surface.__getitem__, p))) for p in parts]
        if parts and parts[0][0] in self.begins:
            out[0] = out[0][1:]
        return b"".join(out)


def _repaired(data: bytes) -> bytes:
    """Every byte that begins no whole character is replaced on its own."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                data[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            out.append(data[at : at + n])
            at += n
            break
        else:
            out.append(b"\xef\xbf\xbd")
            at += 1
    return b"".join(out)


def codec(path: str) -> PieceCodec:
    """One codec per worker process, so its caches outlive a task."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_decode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    contents: bool = True,
) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256 and, with ``contents``, ids and decoded.

    ``ids`` is binary, 32-bit little-endian numbers with begin and end. A null
    or empty text has these two only and decodes to an empty one. Whole texts of
    any length; equal rows give equal rows; an empty table an empty result.
    Input columns named like a result are replaced. No shuffle.
    """

    def make():
        engine = codec(path)

        def work(texts: list[bytes]):
            ids = [engine.encode(t) for t in texts]
            decoded = [engine.decode(i) for i in ids]
            found = [
                [len(i) // 4 for i in ids],
                [hashlib.sha256(i).hexdigest() for i in ids],
                [hashlib.sha256(d).hexdigest() for d in decoded],
            ]
            return [*found, ids, [d.decode() for d in decoded]] if contents else found

        return work

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if contents:
        fields += [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return map_texts(docs, text, keep, fields, make)
