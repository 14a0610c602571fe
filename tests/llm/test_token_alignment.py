"""Cross-tokenizer alignment against plain cuts, corpus counts and odd inputs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowtriage.llm import token_alignment as A

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def components(a_len, b_len):
    """Groups by union of overlapping ranges, pair by pair."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    a_rng = list(zip(a_end - a_len, a_end))
    b_rng = list(zip(b_end - b_len, b_end))
    nodes = a_rng + b_rng
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (s1, e1) in enumerate(a_rng):
        for j, (s2, e2) in enumerate(b_rng):
            if s1 < e2 and s2 < e1:
                parent[find(i)] = find(len(a_rng) + j)
    return [find(x) for x in range(len(nodes))]


def test_pointer_jumping_equals_components():
    rnd = random.Random(3)
    for _ in range(200):
        total = rnd.randrange(1, 60)
        cuts_a = sorted(rnd.sample(range(1, total), rnd.randrange(0, total))) if total > 1 else []
        cuts_b = sorted(rnd.sample(range(1, total), rnd.randrange(0, total))) if total > 1 else []
        a_len = np.diff([0, *cuts_a, total])
        b_len = np.diff([0, *cuts_b, total])
        got = A.groups(np.cumsum(a_len), np.cumsum(b_len))
        want = components(a_len, b_len)
        same = lambda labels: [[labels[i] == labels[j] for j in range(len(labels))] for i in range(len(labels))]
        assert same(got.tolist()) == same(want)
        assert len(set(got.tolist())) == len(set(np.cumsum(a_len)) & set(np.cumsum(b_len)))


def brute(texts):
    """Per text: (n_a, n_b, n_groups, n_links, groups string, links) by cutting at common ends."""
    a, b, a_bytes, b_bytes = A.tokenizers(*PATHS)[:4]
    out = []
    for text in texts:
        if not text:
            out.append((0, 0, 0, 0, "", []))
            continue
        ai = a.encode(" " + text, add_special_tokens=False).ids
        bi = b.encode(text)
        want = (" " + text).encode()
        if b"".join(a_bytes[i] for i in ai) != want or b"".join(b_bytes[i] for i in bi) != want:
            out.append((0, 0, 0, 0, "", []))
            continue
        ae = np.cumsum([len(a_bytes[i]) for i in ai]).tolist()
        be = np.cumsum([len(b_bytes[i]) for i in bi]).tolist()
        common = sorted(set(ae) & set(be))
        groups, x, y = [], 0, 0
        for end in common:
            ga, gb = [], []
            while x < len(ai) and ae[x] <= end:
                ga.append(ai[x]); x += 1
            while y < len(bi) and be[y] <= end:
                gb.append(bi[y]); y += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        links = [(ai[ae.index(e)], bi[be.index(e)]) for e in common]
        out.append((len(ai), len(bi), len(groups), len(links), ";".join(groups), links))
    return out


TEXTS = [
    "Hello world.", None, "", "  two  spaces\nand a line", "<|endoftext|> and </s> <s> stay text",
    "Größe café naïve 日本語 🙂", "x" * 300000 + " end", "Hello world.", "tab\there", "​﻿ odd",
]


RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("limit,ranks", [(A.BROADCAST_PAIRS, None), (0, None), (A.BROADCAST_PAIRS, RANKS), (0, RANKS)])
def test_corpus_against_brute_force(spark, monkeypatch, limit, ranks):
    monkeypatch.setattr(A, "BROADCAST_PAIRS", limit)
    monkeypatch.setattr(A, "CHUNK", 3)  # batches and slices of three texts
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_best string")
    got = {r.doc_id: r for r in A.align_corpus(df, *PATHS, a_ranks=ranks).collect()}
    want = brute(TEXTS)
    counts = Counter(p for w in want for p in w[5])
    top = Counter()
    for (ai, bi), n in counts.items():
        top[bi] = max(top[bi], n)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == w[:4]
        assert r.groups_sha256 == (hashlib.sha256(w[4].encode()).hexdigest() if w[0] else "")
        assert r.count_sum == sum(counts[p] for p in w[5])
        assert r.n_best == sum(counts[p] == top[p[1]] for p in w[5])
    assert got[1].n_a == 0 and got[2].groups_sha256 == "" and got[1].n_best == 0
    assert (got[0].n_a, got[0].groups_sha256) == (got[7].n_a, got[7].groups_sha256)
    assert got[6].n_a > 0 and got[4].n_a > 0


def test_ranks_give_the_json_ids():
    a = A.tokenizers(*PATHS)[0]
    fast = A.tokenizers(*PATHS, RANKS)[0]
    texts = [" " + t for t in TEXTS if t] + [" <|endoftext|>x", " \u00a0\u2028 a\r\n\r\n  b"]
    assert A.encode_a(fast, texts) == A.encode_a(a, texts)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert A.align_corpus(empty, *PATHS).count() == 0


def test_query_shape(spark):
    from flowtriage.llm.queries import op12_token_alignment

    got = op12_token_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert got.where("n_links > n_groups or n_best > n_links").count() == 0
