"""The pipeline on planted documents: the bad ones go, the clean ones stay, every stage takes effect."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest

import corpus_pipeline
from flowtriage.llm.common import plain_words
from tests.llm.test_text_operators import brute_hits, slow_components, slow_fingerprint

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"bench{i}" for i in range(30))


def planted():
    """(documents, labels): clean texts, toxic ones, copies, near copies and benchmark passages."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    texts = [" ".join(word() for _ in range(rnd.randrange(40, 200))) for _ in range(120)]
    for _ in range(20):  # toxic
        texts.append(" ".join([*(word() for _ in range(rnd.randrange(40, 200))), "some vilest nonsense", word()]))
    texts += [texts[1], texts[1], texts[4]]  # copies
    texts.append(texts[7] + " end")  # near copy
    texts.append(f"{texts[8]} {PASSAGE.upper()} {texts[10]}")  # passage inside a long text
    texts.append(PASSAGE)  # nothing but the passage
    texts += [None, "", "", None]
    labels = [(i, 1, int("vilest" in (t or ""))) for i, t in enumerate(texts) if i % 5 or "vilest" in (t or "")]
    return texts, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    texts, labels = planted()
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    frame.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, "short item")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "benchmark_decontamination", "piece_codec",
    ]


def test_pipeline_against_brute_force(spark, folder):
    import sentencepiece

    texts, _ = planted()
    clean = [(i, t) for i, t in enumerate(texts) if "vilest" not in (t or "")]
    prints = [slow_fingerprint(t or "") for _, t in clean]
    group = slow_components(prints, [i for i, _ in clean])
    kept = [(i, t) for (i, t), g in zip(clean, group) if i == g]
    want = {}
    items = [("1", plain_words(PASSAGE.encode())), ("2", [b"short", b"item"])]
    for i, text in kept:
        words = plain_words((text or "").encode())
        hit, _ = brute_hits(items, words, 10)
        if words and len(hit) / len(words) > 0.5:
            continue
        want[i] = text if not hit else text.replace(PASSAGE.upper(), "")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(found) == set(want)
    for i, text in want.items():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert found[i].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()


def test_every_stage_keeps_the_columns_and_survives_odd_rows(spark, folder):
    docs = spark.createDataFrame(
        [(None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (None, None, None, None, None), (3, "a b c", "en", "s", 5),
         (3, "a b c", "en", "s", 5), (4, f"x {PASSAGE} y", None, "s", None), (5, "long " * 50_000, "en", "s", 1)],
        DOCUMENTS,
    )
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, folder)
            assert out.schema.names == frame.schema.names, name
            assert out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, folder).count() == frame.count()
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 3), (False, 4), (False, 5), (True, 0)]
