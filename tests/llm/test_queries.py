"""The registered queries over whole small tables, against brute force where SQL cannot express them."""

import hashlib
import html
import re
from array import array
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
from flowtriage.llm import token_shards
from tests.compare import duck
from tests.llm.test_text_operators import slow_components, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are absent")
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def tables():
    return duck(FOLDER)


def texts(tables):
    return tables.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def test_one_query_for_each_operator():
    for n in range(1, 11):
        assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in QUERIES


def test_toxic_documents_are_found(spark, tables):
    found = {r.doc_id: r.toxic for r in QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = duck("/root/testdata/sf0.01").execute("SELECT doc_id, toxic FROM labels").fetchall()
    assert len(found) == 1_000
    assert sum(found[i] == bool(t) for i, t in labels) >= 0.98 * len(labels)


def test_shards(spark, tables):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = token_shards.Encoder(path, public_tokenizers.PATTERN)._encoding
    ids = [i for (t,) in tables.execute("SELECT coalesce(text, '') FROM documents").fetchall() for i in (*library.encode_ordinary(t), 50_256)]
    ids += [50_256] * (-len(ids) % 1_024)
    want = [hashlib.sha256(r.tobytes()).hexdigest() for r in np.array(ids, dtype="<u2").reshape(-1, 1_024)]
    found = QUERIES["op2_token_shards"](spark, FOLDER).collect()
    assert {r.sequence: r.ids_sha256 for r in found} == dict(enumerate(want))
    assert sorted(r.slot for r in found) == list(range(len(want)))


def test_token_counts(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op5_token_counts"](spark, FOLDER).collect()}
    for doc, text in texts(tables):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert found[doc] == (len(text.encode()), n, n > 2_048)


def test_page_text(spark, tables):
    found = {r.page_id: r for r in QUERIES["op7_page_text"](spark, FOLDER).collect()}
    for page, source in tables.execute("SELECT page_id, html FROM pages").fetchall():
        article = re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(x for x in parts if x)
        assert found[page].text == want and found[page].n_chars == len(want)


def test_simhash(spark, tables):
    rows = texts(tables)
    prints = [slow_fingerprint(t) for _, t in rows]
    want = dict(zip([i for i, _ in rows], zip([f"{p:016x}" for p in prints], slow_components(prints, [i for i, _ in rows]))))
    found = QUERIES["op8_simhash"](spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == want


def test_piece_codec(spark, tables):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in QUERIES["op10_piece_codec"](spark, FOLDER).collect()}
    for doc, text in texts(tables):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert found[doc].n_tokens == len(ids)
        assert found[doc].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert found[doc].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
