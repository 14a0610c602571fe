"""Conversation repair against a plain dynamic programme over whole strings."""

import hashlib
import random
import re
import zlib

import pytest

from flowtriage.llm import conversation_repair as C

LEGAL = {"su", "ua", "au"}
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FILL = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(turn, role, text, c) for c in ((0, 1) if code == 3 else (0,))]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3]))


def faults(rows):
    seen, found = set(), []
    for _, role, text, _ in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            found.append("blank")
        elif (role, text) in seen:
            found.append("dup")
        elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
            found.append("cut")
        else:
            found.append("")
        seen.add((role, text))
    return found


def best(rows, kinds):
    """Least (cost, audit) from every (row, state) by a full table of strings."""
    n, inf = len(rows), (10**9, "")
    table = {}
    for i in range(n, -1, -1):
        cur = {q: (0, "") if i == n and q in (0, 3) else inf for q in range(4)}
        if i < n:
            role, kind = rows[i][1], kinds[i]
            extra = 3 if kind == "cut" else 0
            for q in range(4):
                options = [(4 + table[i + 1][q][0], "D" + table[i + 1][q][1])]
                if kind not in ("blank", "dup"):
                    if (q, role[:1]) in NEXT:
                        t = table[i + 1][NEXT[q, role[:1]]]
                        options.append((extra + t[0], "K" + t[1]))
                    if FILL[q][:1] != role[:1]:
                        t = table[i + 1][NEXT[q, FILL[q][:1]]]
                        options.append((3 + extra + t[0], "R" + t[1]))
                cur[q] = min(options)
        for _ in range(5):
            for q in range(4):
                t = cur[NEXT[q, FILL[q][:1]]]
                cur[q] = min(cur[q], (3 + t[0], "I" + t[1]))
        table[i] = cur
    return table[0][0]


def brute(rows):
    convs = sorted({r[0] for r in rows}, key=lambda c: (c is not None, c or 0))
    out = {}
    for conv in convs:
        mine = damage([r for r in rows if r[0] == conv])
        kinds = faults(mine)
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        inits = [r[1][:1] for r in mine]
        illegal = sum(a + b not in LEGAL for a, b in zip(inits, inits[1:]))
        cost, audit = best(mine, kinds) if mine else (0, "")
        lines, q, i = [], 0, 0
        for letter in audit:
            if letter == "I":
                lines.append(f"{FILL[q]}:")
                q = NEXT[q, FILL[q][:1]]
            elif letter == "D":
                i += 1
            elif letter == "K":
                lines.append(f"{mine[i][1]}:{mine[i][2]}")
                q = NEXT[q, mine[i][1][:1]]
                i += 1
            else:
                lines.append(f"{FILL[q]}:{mine[i][2]}")
                q = NEXT[q, FILL[q][:1]]
                i += 1
        out[conv] = (gaps, kinds.count("blank"), kinds.count("dup"), kinds.count("cut"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, convs=40):
    rnd = random.Random(seed)
    texts = ["Hello there.", "ok", "  ", "", None, "Sure! ", "why?", "a.b", "Thanks. ", "same."]
    roles = ["user", "assistant", "system", None, "tool", "user", "assistant"]
    rows = []
    for c in range(convs):
        for t in range(rnd.randrange(0, 12)):
            rows.append((c if c % 13 else None, rnd.choice([t, t, t, None, t - 1]), rnd.choice(roles), rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = random_rows(block)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(df).collect()}
    assert got == brute(rows)


def test_empty_dropped_and_extra_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(empty).count() == 0
    # a conversation whose only row is dropped (code 0) keeps its id with zeros
    dropped = next((c, t) for c in range(200) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped[0], dropped[1], "user", "hi.", 1, "x")], "conv_id long, turn long, role string, text string, pos int, blk string")
    (row,) = C.repair(df).collect()
    assert tuple(row) == (dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_text_and_repeated_rows(spark):
    rows = [(1, 0, "user", "word " * 200000 + "."), (1, 0, "user", "word " * 200000 + "."), (1, 1, "assistant", "fine.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(df).collect()}
    assert got == brute(rows)


def test_query_over_the_table(spark):
    from flowtriage.llm.queries import op13_conversation_repair

    got = op13_conversation_repair(spark, "/root/testdata/sf0.001")
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:9] for r in got.collect()} == brute(rows)
