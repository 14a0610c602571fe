"""Decontamination, token counts, piece codec and SimHash against brute force and the public libraries."""

import hashlib
import random
import re
from array import array

import public_tokenizers
import pytest
from xxhash import xxh64_intdigest

from flowtriage.llm import common, decontamination, piece_codec, simhash, token_counts
from flowtriage.llm.common import SLICE, plain_word_parts, plain_words, slices

TABLE = "doc_id long, text string, n_words string, fingerprint int, n_tokens string"
COUNTS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "old", 7, "old") for i, t in enumerate(texts)], TABLE)


def odd_texts(seed, n=150):
    rnd = random.Random(seed)
    bits = ["a", "B", "the ", "ing", " ", "  ", "\n", "\t", "é", "Σ", "日本", "́", "'s", "12", "<|endoftext|>", "</s>",
            "▁", " ", "\x1c", "🎉", "\r\n", "!", "loser", "ﬁ"]
    made = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 40))) for _ in range(n)]
    return [None, "", " ", "x" * 5_000, "word " * 60_000, "same", "same", *made]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = odd_texts(1)
    library = Tokenizer.from_file(COUNTS)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for cached in (token_counts.CACHED, 5):
        found = token_counts.count_tokens(frame(spark, texts), COUNTS, max_tokens=20, cached=cached).orderBy("doc_id").collect()
        assert [r.n_tokens for r in found] == want
        assert [r.n_bytes for r in found] == [len((t or "").encode()) for t in texts]
        assert [r.over_limit for r in found] == [n > 20 for n in want]
    kept = token_counts.count_tokens(frame(spark, ["a"]), COUNTS, keep=("doc_id", "n_tokens", "fingerprint"))
    assert kept.columns == ["doc_id", "fingerprint", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.count_tokens(frame(spark, []), COUNTS).count() == 0


def test_long_text_is_counted_in_slices():
    text = b"abc de\n" * 400_000
    parts = list(slices(text))
    assert len(parts) > 2 and max(map(len, parts)) < SLICE + 16
    assert b"".join(parts) == text and sum(len(p.split()) for p in parts) == len(text.split())
    assert list(slices(b"")) == [b""] and list(slices(b"x" * 10, 3)) == [b"x" * 10]


def test_results_do_not_depend_on_the_slices(monkeypatch):
    whole = piece_codec.codec(PIECES)
    for text in odd_texts(11, 60)[5:]:
        data = (text * 3).encode()
        want = whole.encode(data), simhash.fingerprint(data), list(plain_word_parts(data))[0]
        small = lambda text, size=3, cut=common._SPACE: slices(text, 3, cut)
        with monkeypatch.context() as patch:
            for module in (piece_codec, simhash, common):
                patch.setattr(module, "slices", small)
            parts = [w for part in plain_word_parts(data) for w in part]
            assert (whole.encode(data), simhash.fingerprint(data), parts) == want


def test_piece_codec_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts(2)
    found = piece_codec.encode_decode(frame(spark, texts), PIECES).orderBy("doc_id").collect()
    for row, text in zip(found, texts, strict=True):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert array("I", bytes(row.ids)).tolist() == ids and row.n_tokens == len(ids)
        assert row.decoded == library.decode(ids)
        assert row.ids_sha256 == hashlib.sha256(bytes(row.ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
    assert piece_codec.encode_decode(frame(spark, []), PIECES).count() == 0


def test_any_ids_decode_as_the_library_does():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    engine, rnd = piece_codec.codec(PIECES), random.Random(4)
    for _ in range(3_000):
        ids = [rnd.choice([rnd.randrange(300), rnd.randrange(32_000)]) for _ in range(rnd.randrange(9))]
        assert engine.decode(array("I", ids).tobytes()).decode() == library.decode(ids), ids


def test_a_full_cache_changes_nothing():
    small, full = piece_codec.PieceCodec(PIECES, words=3, pairs=3), piece_codec.codec(PIECES)
    for text in odd_texts(3, 40)[5:]:
        assert small.encode(text.encode()) == full.encode(text.encode())


def brute_hits(items, words, window):
    hit, found = set(), set()
    for name, item in items:
        runs = [item[i : i + window] for i in range(len(item) - window + 1)] if len(item) >= window else [item] * bool(item)
        for run in runs:
            for i in range(len(words) - len(run) + 1):
                if words[i : i + len(run)] == run:
                    hit.update(range(i, i + len(run)))
                    found.add(name)
    return hit, found


def test_automaton_against_brute_force():
    rnd = random.Random(6)
    for _ in range(1_500):
        letters = [b"a", b"b", b"c"][: rnd.randrange(1, 4)]
        items = [(str(i), [rnd.choice(letters) for _ in range(rnd.randrange(9))]) for i in range(rnd.randrange(6))]
        words = [rnd.choice([*letters, b"z"]) for _ in range(rnd.randrange(40))]
        spans, found = decontamination.ItemAutomaton(items, 4).hits(words)
        hit, names = brute_hits(items, words, 4)
        assert {i for a, b in spans for i in range(a, b + 1)} == hit
        assert {items[k][0] for k in found} == names


def test_decontamination_cuts_spans_and_rejects(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(10, item), (9, item), (2, "Short One"), (3, None), (4, ""), (None, "lone words")], "item_id long, text string")
    texts = [
        None, "", "clean text about nothing", f"Before, {item.upper()}! after it all goes on and on and on, and on and on",
        item, "a short-one b", "short", "lone words stay here", "é ONE two", item,
    ]
    found = decontamination.decontaminate(frame(spark, texts), items, keep=("doc_id", "n_words", "text")).orderBy("doc_id").collect()
    assert [r.n_hit for r in found] == [0, 0, 0, 11, 11, 2, 0, 2, 0, 11]
    assert found[3].item_ids == ["10", "9"] and found[3].n_items == 2
    assert found[3].clean_text == "Before, ! after it all goes on and on and on, and on and on"
    assert found[3].items_sha256 == hashlib.sha256(b"10,9").hexdigest()
    assert [r.rejected for r in found] == [False] * 4 + [True] + [False] * 4 + [True]
    assert found[5].clean_text == "a  b" and found[7].item_ids == [] and found[7].n_items == 1
    assert found[0].clean_text == "" and found[0].n_words == 0
    none = decontamination.decontaminate(frame(spark, texts), items.limit(0)).collect()
    assert {r.n_hit for r in none} == {0} and len(none) == len(texts)
    assert decontamination.decontaminate(frame(spark, []), items).count() == 0
    with pytest.raises(ValueError):
        decontamination.build_automaton(items, "item_id", "text", limit=1)


def test_words_follow_the_contract():
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for text in odd_texts(8)[1:]:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        assert plain_words(text.encode()) == [w.encode() for w in pattern.findall(lower)]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(prints)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(prints))]


def test_fingerprints_and_components(spark):
    rnd = random.Random(9)
    texts = [*odd_texts(7, 60), *("w%d x y z" % (i % 5) for i in range(40))]
    texts += [" ".join(rnd.choice("abcdef") for _ in range(3_000)) for _ in range(5)]
    found = simhash.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    prints = [slow_fingerprint(t or "") for t in texts]
    assert [r.fingerprint for r in found] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in found] == slow_components(prints, range(len(prints)))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    alone = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")).collect()
    assert [r.component_id for r in alone] == [None, None]


@pytest.mark.parametrize("pairwise", [3, 1_000])
def test_no_link_is_lost_in_small_or_crowded_buckets(spark, pairwise):
    rnd = random.Random(10)
    prints = {rnd.getrandbits(64) for _ in range(50)}
    for centre in list(prints)[:12]:
        for _ in range(40):
            flipped = centre
            for bit in rnd.sample(range(64), rnd.randrange(1, 5)):
                flipped ^= 1 << bit
            prints.add(flipped)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fingerprint long, least long")
    edges = simhash.links(nodes.select("fingerprint"), pairwise)
    for a, b in edges.collect():
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2
    named = simhash.smallest_reachable(edges, nodes, "fingerprint", "least")
    got = {r.fingerprint: r.component_id for r in named.collect()}
    assert [got.get(p, i) for i, p in enumerate(signed)] == slow_components(prints, range(len(prints)))
