"""Toxicity, token shards, WARC, chat formatting, page text and metric tree on small fixtures."""

import gzip
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowtriage.llm import chat_format, metric_tree, page_text, token_shards, toxicity, warc


# --- toxicity


def toxic_table(spark, n=600):
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        words = [rnd.choice(["alpha", "beta", "gamma", "delta", "plain"]) for _ in range(rnd.randrange(5, 40))]
        bad = i % 4 == 0
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(["vileness", "vilest", "VILE!"]))
        if i % 7 == 0:
            words.append("rough")
        rows.append((i, " ".join(words), int(i % 7 == 0), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, rough int, toxic int")


def test_chain_on_held_out_rows(spark):
    rows = toxic_table(spark)
    docs = rows.select("doc_id", "text", F.lit("x").alias("p_toxic"), F.lit(1).alias("_fold"))
    fitted = toxicity.fit_chain(docs, rows.where("doc_id < 300"), ("rough", "toxic"))
    assert len(fitted.before[1]) == 1 and fitted.words.shape == (2, toxicity.FEATURES)
    found = toxicity.score_chain(docs, fitted, keep=("doc_id", "p_toxic")).join(rows, "doc_id").where("doc_id >= 300")
    right = found.where((F.col("rejected").cast("int") == F.col("toxic"))).count()
    assert right >= 290


def test_chain_without_labels_nulls_and_one_class(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, a int, b int")
    scored = toxicity.score_chain(docs, toxicity.fit_chain(docs, none, ("a", "b"))).collect()
    assert len(scored) == 5 and not any(r.rejected for r in scored)
    one = spark.createDataFrame([(3, 1, None), (3, 0, None), (1, 1, None), (None, 1, 1)], "doc_id long, a int, b int")
    scored = toxicity.score_chain(docs, toxicity.fit_chain(docs, one, ("a", "b"))).collect()
    assert all(r.p_a > 0.99 and r.p_b < 0.01 for r in scored)
    assert toxicity.score_chain(docs.limit(0), toxicity.fit_chain(docs, one, ("a",))).count() == 0


# --- token shards


def test_permutation_is_a_bijection_with_an_inverse():
    for n in (1, 2, 3, 7, 100, 4_097):
        order = token_shards.Permutation(n, "key")
        slots = order.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert (order.sequences(slots) == np.arange(n)).all()
    other = token_shards.Permutation(4_097, "other").slots(np.arange(4_097))
    assert (other != slots).any()


def test_shards_hold_the_stream_in_slot_order(spark, tmp_path):
    import tiktoken

    rnd = random.Random(2)
    texts = [None, "", "\n\n", " a  b ", *("word%d and more\ntext " % rnd.randrange(50) * rnd.randrange(1, 60) for _ in range(60))]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    rows.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = token_shards.write_shards(
        docs, str(tmp_path / "out"), path, public_tokenizers.PATTERN, "k", length=16, per_shard=32
    )
    engine = token_shards.Encoder(path, public_tokenizers.PATTERN)
    placed = docs.select("text", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()
    stream = [i for r in placed for i in (*engine._encoding.encode_ordinary(r.text or ""), 50_256)]
    assert made["tokens"] == len(stream) and made["shards"] == -(-made["sequences"] // 32) > 1
    stream += [50_256] * (-len(stream) % 16)
    want = np.array(stream, dtype="<u2").reshape(-1, 16)
    found = token_shards.read_slots(spark, str(tmp_path / "out"), made).orderBy("slot").collect()
    assert [r.slot for r in found] == list(range(made["sequences"]))
    for r in found:
        assert bytes(r.ids) == want[r.sequence].tobytes() and r.shard == r.slot // 32
    again = token_shards.read_slots(spark, str(tmp_path / "out"), made, 30, 70).orderBy("slot").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in found[30:70]]
    (file,) = (tmp_path / "out" / "shard=0").glob("part*")
    assert file.stat().st_size == 32 * 34
    file.write_bytes(file.read_bytes()[:-3])
    for check in (tmp_path / "out" / "shard=0").glob(".*.crc"):
        check.write_bytes(b"")
        check.unlink()
    with pytest.raises(Exception, match="bytes for 32 records"):
        token_shards.read_slots(spark, str(tmp_path / "out"), made).count()


def test_no_rows_make_no_shards(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    made = token_shards.write_shards(
        docs, str(tmp_path / "out"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "k"
    )
    assert made["sequences"] == 0 and token_shards.read_slots(spark, str(tmp_path / "out"), made).count() == 0


# --- WARC

LONG = "long enough to be recorded once " * 8


def page_rows(spark):
    rows = [
        (1, "http://a/", LONG), (2, "http://a/x y", LONG), (3, None, None), (4, "http://b/", ""), (5, "http://b/", "é" * 40),
        (6, "http://b/", "é" * 40), (7, "http://c/", "é" * 50), (8, "http://c/", "é" * 50), (8, "http://c/", "é" * 50), (None, "u", LONG),
        (7, "http://c/", "é" * 50), (9, "http://d/", "WARC/1.1\r\n\r\n\x1f" * 30),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))


def test_archives_round_trip(spark, tmp_path):
    warc.write_archives(page_rows(spark), str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert all(r.reason is None for r in found) and len(found) == 12
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in found)
    assert ("1", "response", None) in kinds and ("2", "revisit", "1") in kinds and ("null", "revisit", "1") in kinds
    assert kinds.count(("7", "response", None)) == 2 and kinds.count(("8", "revisit", "7")) == 2
    assert ("5", "response", None) in kinds and ("6", "response", None) in kinds
    html = {r.page_id: (r.html or "").encode() for r in page_rows(spark).collect()}
    for r in found:
        body = html[None if r.record_id == "null" else int(r.record_id)]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert bytes(r.payload) == (body if r.record_type == "response" else b"")
    for file in (tmp_path / "w").glob("part*"):
        assert gzip.decompress(file.read_bytes()).count(b"WARC-Record-ID") >= 1 if file.stat().st_size else True
    warc.write_archives(page_rows(spark).limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def members(n):
    made = []
    for i in range(n):
        body = (f"page {i} " * 30).encode()
        made.append(warc.build_record(i, f"http://h/{i}", body, hashlib.sha256(body).hexdigest(), None))
    return made


def names(found):
    return [f.headers["warc-record-id"] if not f.reason else (f.start, f.end) for f in found]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_goes_on_after_damage(packed):
    parts = [gzip.compress(m, mtime=0) if packed else m for m in members(5)]
    whole = b"".join(parts)
    ids = [f"<urn:page:{i}>" for i in range(5)]
    assert names(warc.salvage(whole)) == ids
    a, b = len(parts[0]), len(parts[0]) + len(parts[1])
    damaged = bytearray(whole)
    damaged[b - 40 : b - 30] = b"##########"
    assert names(warc.salvage(bytes(damaged))) == [ids[0], (a, b), *ids[2:]]
    assert names(warc.salvage(b"junk" + whole)) == [(0, 4), *ids]
    cut = whole[: a + 30] + whole[b:]
    assert names(warc.salvage(cut)) == [ids[0], (a, a + 30), *ids[2:]]
    assert names(warc.salvage(whole[:-20])) == [*ids[:4], (len(whole) - len(parts[4]), len(whole) - 20)]
    assert names(warc.salvage(b"")) == [] and names(warc.salvage(b"\0\0")) == []
    assert names(warc.salvage(b"\x1f\x8b\x08 nothing")) == [(0, 11)]


def test_salvage_random_damage_loses_only_touched_records():
    rnd = random.Random(5)
    parts = [gzip.compress(m, mtime=0) for m in members(20)]
    starts = np.cumsum([0, *map(len, parts)])
    for _ in range(100):
        data = bytearray(b"".join(parts))
        spots = [rnd.randrange(len(data)) for _ in range(3)]
        for s in spots:
            data[s] ^= 1 << rnd.randrange(8)
        hit = {int(np.searchsorted(starts, s, "right")) - 1 for s in spots}
        got = {f.headers["warc-record-id"] for f in warc.salvage(bytes(data)) if not f.reason}
        assert {f"<urn:page:{i}>" for i in range(20) if i not in hit} <= got


def test_salvage_within_members_of_several_records():
    rnd = random.Random(6)
    records = []
    for i in range(40):
        body = "".join(rnd.choice("abcdefghij <>") for _ in range(6_000)).encode()
        records.append(warc.build_record(i, f"http://h/{i}", body, hashlib.sha256(body).hexdigest(), None))
    ids = [f"<urn:page:{i}>" for i in range(40)]
    for level in (0, 6):  # stored, packed
        one, last = gzip.compress(b"".join(records[:30]), level, mtime=0), gzip.compress(b"".join(records[30:]), level, mtime=0)
        n = len(one)
        # A damaged first version line loses the first record only.
        first = gzip.compress(b"X" + b"".join(records)[1:], level, mtime=0)
        assert names(warc.salvage(first)) == [(0, len(first)), *ids[1:]]
        # Cut short: all complete records, and a gap for the rest.
        got = list(warc.salvage(one[: n * 2 // 3]))
        assert names(got)[:-1] == ids[: len(got) - 1] and 18 <= len(got) - 1 <= 20
        assert got[-1].reason == "member" and got[-1].end == n * 2 // 3 and got[-1].start == got[0].end > n // 2
        # A wrong check sum: all records whose digest holds, none twice, and the next member whole.
        damaged = bytearray(one + last)
        damaged[n - 6] ^= 1
        got = names(warc.salvage(bytes(damaged)))
        assert [g for g in got if isinstance(g, str)] == ids and len(got) == 41
        # Damage in the middle: what lies before it, and the next member whole.
        damaged = bytearray(one + last)
        damaged[n // 2 : n // 2 + 40] = b"#" * 40
        got = [g for g in names(warc.salvage(bytes(damaged))) if isinstance(g, str)]
        assert len(set(got)) == len(got) and {*ids[:14], *ids[30:]} <= set(got)
        # Two broken members one after the other.
        damaged = one[:-100] + last[:-100]
        got = names(warc.salvage(damaged))
        assert [g for g in got if isinstance(g, str)] == [*ids[:29], *ids[30:39]]
    # Records without a digest of their own are kept from a member cut short, not from a damaged one.
    again = warc.build_record(1, None, b"x" * 200, "0" * 64, 0)
    packed = gzip.compress(again + records[0] + again, mtime=0)
    assert names(warc.salvage(packed[:-1]))[:3] == [ids[1], ids[0], ids[1]]
    wrong = packed[:-8] + bytes([packed[-8] ^ 1]) + packed[-7:]
    assert [f.reason or f.headers["warc-record-id"] for f in warc.salvage(wrong)] == ["member", ids[0], "member"]
    # Members within members, nothing, and no end of members.
    assert names(warc.salvage(gzip.compress(gzip.compress(records[0])))) == ids[:1]
    deep = records[0]
    for _ in range(50):
        deep = gzip.compress(deep)
    assert [f.reason for f in warc.salvage(deep)] == ["member"] and len(names(warc.salvage(gzip.compress(b"")))) == 1


def test_large_records_are_padded_not_cut():
    body = b"0" * (17 << 20)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    member = packer.compress(warc.build_record(1, None, body, hashlib.sha256(body).hexdigest(), None)) + packer.flush()
    assert member[-1] != 0
    assert [len(f.payload) for f in warc.salvage(member + b"\0" + gzip.compress(members(1)[0]))] == [len(body), 210]


# --- chat formatting

TEXTS = ["", "</s>[INST] ok [/INST]", "<\\\\|im_end|>", "a<|im_end|>\n<|im_start|>user\nx", "<<SYS>>", "\\", "<", "plain\n", "<\\/s>[", "é🎉[INST]"]


def test_escaping_is_reversible(spark):
    rnd = random.Random(3)
    made = ["".join(rnd.choice(["<", "\\", "|im_end|>", "/s>", "s>", "[", "INST]", "/INST]", "x", "\n", "|x|>"]) for _ in range(12)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in TEXTS + made], "t string")
    found = rows.select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e"))).collect()
    for r in found:
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|im_end|>", "</s>", "[INST]", "[/INST]", "<|x|>"))


def test_control_strings_of_any_name_are_escaped(spark):
    rnd = random.Random(10)
    marks = ["<|reserved_special_token_7|>", "<|" + "long-name_" * 9 + "|>", "<|é.1|>", "<|a[INST]|>", "<|[/INST]x|>", "[|x-1|>"]
    made = ["".join(rnd.choice(["<", "[", "\\", "|", "|>", "a-1", "INST]", "/s>", " ", "é", *marks]) for _ in range(14)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in [*marks, *made]], "t string")
    for r in rows.select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(m in r.e for m in (*marks, "[INST]", "</s>"))


def test_layouts_become_the_same_turns(spark, tmp_path):
    lines = [
        {"id": 1, "prompt": "p", "response": "r"},
        {"id": 2, "prompt": "p"},
        {"id": 3, "instruction": "i", "input": "in", "output": "o"},
        {"id": 4, "instruction": "i", "output": "o", "system": "s"},
        {"id": 5, "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None}, {"role": None, "content": "x"}]},
        {"id": 6, "exchanges": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "tool", "value": "t"}]},
        {"id": 7, "messages": []},
        {"id": 8},
        {"id": 9, "prompt": "p", "messages": [{"role": "user", "content": "u"}]},
        {"id": 10, "instruction": "i"},
    ]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, lines)))
    rows = spark.read.json(str(tmp_path / "x.json")).withColumn("turns", F.lit("old")).withColumn("formatted", F.lit(0))
    found = {r.id: r for r in chat_format.canonical_turns(rows).collect()}
    got = {i: [(t.role, t.text) for t in r.turns] if r.turns is not None else None for i, r in found.items()}
    assert got == {
        1: [("user", "p"), ("assistant", "r")],
        2: [("user", "p"), ("assistant", "")],
        3: [("user", "i\n\nin"), ("assistant", "o")],
        4: [("system", "s"), ("user", "i"), ("assistant", "o")],
        5: [("user", "u"), ("assistant", ""), ("", "x")],
        6: [("user", "h"), ("assistant", "g"), ("tool", "t")],
        7: [], 8: None, 9: None, 10: None,
    }
    assert found[8].layout == found[9].layout == found[10].layout == "unknown"
    made = chat_format.read_formatted(chat_format.format_turns(chat_format.canonical_turns(rows))).collect()
    for r in made:
        if r.turns is None:
            assert r.formatted is None and r.read_turns is None
        else:
            assert r.read_turns == r.turns
            assert r.trained_text == "".join(t.text for t in r.turns if t.role == "assistant")
            assert len(r.formatted) == sum(sum(m) for m in r.loss_mask)


def test_chats_of_any_shape_round_trip(spark):
    rnd = random.Random(4)
    rows = []
    for chat in range(60):
        for turn in range(rnd.randrange(1, 7)):
            rows.append((chat, turn, rnd.choice(["user", "assistant", "system", "a\nb c", None]), rnd.choice([*TEXTS, None])))
    rows += [(70, 1, "user", "tie"), (70, 1, "user", "tie"), (70, 1, "assistant", "tie"), (71, None, "user", "x"), (None, 0, "user", "y")]
    rows += [(80, i, "user" if i % 2 == 0 else "assistant", "long " * 50) for i in range(2_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    chats = chat_format.format_turns(chat_format.canonical_turns(chat_format.lay_out(turns)))
    found = chat_format.read_formatted(chats).collect()
    assert {r.conv_id for r in found} == set(want) and len(found) == len(want)
    for r in found:
        assert [(t.role, t.text) for t in r.read_turns] == [(role, text) for _, role, text in sorted(want[r.conv_id])]
    assert chat_format.lay_out(turns.limit(0)).count() == 0


def test_formatting_runs_no_python(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    chats = chat_format.read_formatted(chat_format.format_turns(chat_format.canonical_turns(chat_format.lay_out(turns))))
    plan = chats._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# --- page text

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>";</script></head><body class="has-sidebar">'
    "<header>Site</header><nav><ul><li>Menu</li></ul></nav><!-- <article> --><div class=\"ad\">Buy</div>"
    "<article><h1>Head &amp; more &am</h1><p><b>One  two<br>three<p>Four <i>fi</i>ve&nbsp;six</p>"
    '<form>Send</form><aside>Aside</aside><div class="comments"><p>Nice!</p></div><div id=x>Last</div></article><footer>&copy; me'
)


def test_marked_article():
    main = [t for k, t in page_text.blocks(PAGE) if k == page_text.TEXT]
    assert main == ["Head & more &am", "One two three", "Four five six", "Last"]
    unclosed = "<article><p class=notice>No<p>Yes<ul><li class=ad>No<li>Yes two</ul><p>Yes three</article>After"
    assert page_text.blocks(unclosed) == [
        (page_text.NO_TEXT, "No"), (page_text.TEXT, "Yes"), (page_text.NO_TEXT, "No"), (page_text.TEXT, "Yes two"),
        (page_text.TEXT, "Yes three"), (page_text.OPEN, "After"),
    ]
    assert page_text.blocks("") == [] and page_text.blocks("<p>") == []
    assert page_text.blocks("a < b <p>c</p> <script>x") == [(page_text.OPEN, "a < b"), (page_text.OPEN, "c")]


def test_open_pages_lose_what_other_pages_of_the_host_repeat(spark):
    menu = "home news about contact imprint terms privacy help login register now"
    rows = [(i, f"http://H.example/{i}", f"<div>{menu}</div><div>w{i} unique text number {i} with its own words x{i}</div>") for i in range(4)]
    rows += [
        (10, "http://h.example/a", f"<nav>{menu}</nav><article>{menu}</article>"), (11, "http://other/", f"<div>{menu}</div>"),
        (12, None, None), (13, "http://third/", f"<div>{menu}</div>"), (13, "http://third/", f"<div>{menu}</div>"), (None, "bad url", "<p>x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("uid", F.lit(1))
    found = {(r.page_id, r.url): r.text for r in page_text.main_text(pages).collect()}
    for i in range(4):
        assert found[i, f"http://H.example/{i}"] == f"w{i} unique text number {i} with its own words x{i}"
    assert found[10, "http://h.example/a"] == menu and found[11, "http://other/"] == menu
    assert found[12, None] == "" and found[13, "http://third/"] == menu and found[None, "bad url"] == "x"
    assert page_text.main_text(pages).count() == len(rows) and page_text.main_text(pages.limit(0)).count() == 0


def test_open_blocks_beside_marked_parts(spark):
    menu = "home news about contact imprint terms privacy help login register now"
    rows = [
        (1, "<div class=story>long unique text</div><article class=comment>hi</article>"),
        (2, f"<div>{menu}</div><div>Headline two</div><article class='post has-sidebar'><p>Card two</article><div>{menu} and more</div>"),
        (3, f"<p>{menu}</p><article>Three<aside>No</aside></article><p>After three</p><main id=sidebar>Side</main>"),
    ]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in page_text.main_text(pages).collect()}
    assert found == {1: "long unique text", 2: "Headline two\nCard two\nand more", 3: "Three\nAfter three"}


def test_repeated_runs_against_brute_force(spark):
    rnd = random.Random(7)
    pages = [[rnd.choice("abc") for _ in range(rnd.randrange(0, 60))] for _ in range(25)]
    rows = [(i, f"http://h/{i}", f"<p>{' '.join(p)}</p>") for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in page_text.main_text(frame, min_words=5).collect()}
    grams = {}
    for i, p in enumerate(pages):
        for j in range(len(p) - 4):
            grams.setdefault(tuple(p[j : j + 5]), set()).add(i)
    for i, p in enumerate(pages):
        covered = {k for j in range(len(p) - 4) if len(grams[tuple(p[j : j + 5])]) > 1 for k in range(j, j + 5)}
        assert found[i] == " ".join(w for k, w in enumerate(p) if k not in covered)


def test_repeated_runs_within_known_boilerplate(spark):
    rnd = random.Random(9)
    pages = [[(rnd.choice(["footer", "p"]), [rnd.choice("abc") for _ in range(rnd.randrange(0, 25))]) for _ in range(4)] for _ in range(25)]
    rows = [(i, f"http://h/{i}", "".join(f"<{tag}>{' '.join(w)}</{tag}>" for tag, w in p)) for i, p in enumerate(pages)]
    notice = "all rights reserved by the owners of this site and others"
    rows += [
        (100, "http://g/0", f"<footer>Copyright 2024 Example. {notice}</footer>"),
        (101, "http://g/1", f"<div>{notice}</div><div>unique</div>"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: (r.text, r.n_repeated) for r in page_text.main_text(frame, min_words=5).collect()}
    assert found[100] == ("", 0) and found[101] == ("unique", len(notice.split()))
    streams = [[(w, tag == "p") for tag, words in p for w in words] for p in pages]
    grams = {}
    for i, s in enumerate(streams):
        for j in range(len(s) - 4):
            grams.setdefault(tuple(w for w, _ in s[j : j + 5]), set()).add(i)
    for i, (p, s) in enumerate(zip(pages, streams)):
        covered = {k for j in range(len(s) - 4) if len(grams[tuple(w for w, _ in s[j : j + 5])]) > 1 for k in range(j, j + 5)}
        lines, at = [], 0
        for tag, words in p:
            kept = [w for k, w in enumerate(words, at) if k not in covered]
            lines += [" ".join(kept)] if tag == "p" and kept else []
            at += len(words)
        assert found[i] == ("\n".join(lines), sum(is_open for k, (_, is_open) in enumerate(s) if k in covered))


# --- metric tree


def brute_top(rows, top):
    sound = [(i, np.floor(1024 * np.array(v, dtype=np.float64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in sound)
    sound = [(i, np.pad(v, (0, width - len(v)))) for i, v in sound]
    queries = {}
    for i, v in sound:
        if i % 100 == 0 and (i not in queries or tuple(v) < tuple(queries[i])):
            queries[i] = v
    want = []
    for q, v in queries.items():
        scored = sorted((-int(v @ w), i) for i, w in sound if i != q)[:top]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    return sorted(want)


@pytest.mark.parametrize(("leaf", "node", "block"), [(8, 50, 3), (128, 4_096, 8_192)])
def test_search_is_exact(spark, monkeypatch, leaf, node, block):
    monkeypatch.setattr(metric_tree, "LEAF", leaf)
    monkeypatch.setattr(metric_tree, "NODE", node)
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + rnd.normal(size=5) * 0.05).astype(np.float32).tolist()) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(900, 1_005)]  # ties
    rows += [(7, rows[7][1]), (100, rows[100][1]), (2_000, [1.0, 2.0]), (2_001, None), (2_100, [None, 1.0]), (2_200, [float("nan")]),
             (2_300, [float("inf")]), (None, [1.0]), (2_400, []), (2_500, [0.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit("x"))
    found = metric_tree.search(frame, block=block)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 10)


def test_search_of_few_or_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (5, [2.0]), (100, [-1.0])], "vec_id long, embedding array<float>")
    assert metric_tree.search(frame).count() == 4
    assert metric_tree.search(frame.where("vec_id = 5")).count() == 0
    assert metric_tree.search(frame.limit(0)).count() == 0
    assert metric_tree.search(frame.where("vec_id = 0")).count() == 0


def test_shards_of_a_table_with_a_metadata_column(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 5), ("clash",), i) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, _metadata struct<file_path:string>, extra long").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = token_shards.write_shards(docs, str(tmp_path / "out"), path, public_tokenizers.PATTERN, "k", length=16, per_shard=8)
    engine = token_shards.Encoder(path, public_tokenizers.PATTERN)
    assert made["tokens"] == sum(len(engine._encoding.encode_ordinary(r[1])) + 1 for r in rows)
    assert token_shards.read_slots(spark, str(tmp_path / "out"), made).count() == made["sequences"]


def test_metric_tree_refuses_scores_beyond_64_bits(spark):
    big = spark.createDataFrame([(0, [3.0e6] * 300), (1, [1.0] * 300), (100, [2.0e6] * 300)], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        metric_tree.search(big).count()
    fine = spark.createDataFrame([(0, [3.0e3] * 300), (1, [1.0] * 300), (100, [2.0e3] * 300)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in metric_tree.search(fine).orderBy("query_id", "rank").collect()] == [100, 1, 0, 1]
