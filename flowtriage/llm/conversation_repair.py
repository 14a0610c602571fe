"""Conversation structure repair by a square-root checkpointed dynamic programme.

Rows of a conversation are read in order and each is kept (K), given another
role (R, to user or assistant), deleted (D), or preceded by inserted empty
turns (I), so that the role initials read ``(s?(ua)+)?`` at least cost; of
the cheapest edit strings the ASCII-least wins. The cost-to-go of a position
is a vector over four states of that pattern (nothing yet, after s, after u,
after a).

The programme is split into blocks of BLOCK consecutive rows, the checkpoints:

1. every block gives its min-plus transfer matrix (4 x 4) at once;
2. a conversation's matrices, one per block, are folded from the end: the
   cost-to-go vector at every block end is all that is stored;
3. every block recomputes its own vectors from its end vector and walks
   forward greedily (least letter that stays optimal) from each of the four
   states it might be entered in;
4. the walks are chained from the first block, which fixes the entry state
   and so the edits of every block.

No step holds more than a block's rows, or a conversation's block summaries
(one per BLOCK rows); the repaired text is hashed in one ordered pass.

Defined results: null role or text count as one space (so a null text is
blank); a null turn sorts first, rows of one turn by role, text, then copy; a
null conv_id is a conversation of its own; a conversation whose rows are all
dropped has zero counts, cost 0, empty audit and the hash of the empty string;
repeated rows are duplicates after their first; columns beside conv_id, turn,
role and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from flowtriage.sources.workspace import durable

#: Rows per block (checkpoint spacing).
BLOCK = 1024
#: Edit costs.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Faults, first that holds: none, blank, duplicate, truncated.
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Role initials s, u, a, anything else.
INITIAL = {"s": 0, "u": 1, "a": 2}
#: States: start, after s, after u, after a; where each role initial leads (-1: not allowed).
_NEXT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: The state an inserted or re-roled turn leads to, and its role.
_INSERT_TO, _INSERT_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_ACCEPT = (0, 3)
_INF = 1 << 40
_SPACE = r"[\x20\x09-\x0D]"


def _relax(v: list[int]) -> list[int]:
    """Inserts before a row: v[q] = min(v[q], INSERT + v[insert_to(q)]), to the fixed point."""
    for _ in range(4):
        v = [min(v[q], INSERT + v[_INSERT_TO[q]]) for q in range(4)]
    return [min(x, _INF) for x in v]


def _moves(q: int, initial: int, fault: int, ahead: list[int], here: list[int]):
    """(letter, cost, next state, cost-to-go after) of every edit of a row in state q, in ASCII order."""
    extra = TRUNCATED if fault == CUT else 0
    yield "D", DELETE, q, ahead[q]
    yield "I", INSERT, _INSERT_TO[q], here[_INSERT_TO[q]]
    if fault in (BLANK, DUPLICATE):
        return
    if initial < 3 and _NEXT[q][initial] >= 0:
        yield "K", KEEP + extra, _NEXT[q][initial], ahead[_NEXT[q][initial]]
    if (2 if q == 2 else 1) != initial:
        yield "R", REROLE + extra, _INSERT_TO[q], ahead[_INSERT_TO[q]]


def _back(ahead: list[int], initial: int, fault: int) -> list[int]:
    """Cost-to-go before a row from that after it."""
    here = [DELETE + a for a in ahead]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        for q in range(4):
            to = _NEXT[q][initial] if initial < 3 else -1
            if to >= 0:
                here[q] = min(here[q], KEEP + extra + ahead[to])
            if (2 if q == 2 else 1) != initial:
                here[q] = min(here[q], REROLE + extra + ahead[_INSERT_TO[q]])
    return _relax(here)


def end_vector() -> list[int]:
    return _relax([0 if q in _ACCEPT else _INF for q in range(4)])


def transfer(initials, faults) -> list[list[int]]:
    """Least cost from each state before the first row to each state after the last (inserts after it excluded)."""
    columns = [[0 if q == t else _INF for q in range(4)] for t in range(4)]
    for i in range(len(initials) - 1, -1, -1):
        columns = [_back(c, initials[i], faults[i]) for c in columns]
    return [[columns[t][q] for t in range(4)] for q in range(4)]


def walk(initials, faults, end: list[int], last: bool, start: int) -> tuple[int, int, list[str], str]:
    """Exit state, cost, one token per row (its inserts then its letter) and the inserts after the end."""
    n = len(initials)
    values: list = [None] * (n + 1)
    values[n] = list(end)
    for i in range(n - 1, -1, -1):
        values[i] = _back(values[i + 1], initials[i], faults[i])
    q, cost, tokens, token = start, 0, [], ""
    i = 0
    while i < n:
        for letter, step, to, rest in _moves(q, initials[i], faults[i], values[i + 1], values[i]):
            if step + rest == values[i][q]:
                break
        cost += step
        token += letter
        q = to
        if letter != "I":
            tokens.append(token)
            token, i = "", i + 1
    tail = ""
    while last and q not in _ACCEPT:
        tail, cost, q = tail + "I", cost + INSERT, _INSERT_TO[q]
    return q, cost, tokens, tail


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, with their place, role initial and first fault."""
    conv, turn = F.col("conv_id"), F.col("turn")
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    code = F.crc32(key) % 20
    rows = (
        conversations.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"))
        .withColumn("_code", code)
        .where(F.col("_code") != 0)
        .withColumn("text", F.when(F.col("_code") == 1, F.lit("")).when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("_code") == 4, F.lit("user")).otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    placed = rows.withColumn("pos", F.row_number().over(order) - 1)
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("pos")
    first = F.substring("role", 1, 1)
    fault = (
        F.when(~F.col("text").rlike(f"[^{_SPACE[1:-1]}]"), F.lit(BLANK))
        .when(F.row_number().over(seen) > 1, F.lit(DUPLICATE))
        .when(~F.col("text").rlike(f"[.!?]{_SPACE}*\\z"), F.lit(CUT))
        .otherwise(F.lit(NONE))
    )
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return placed.select(
        "conv_id", "turn", "role", "text", "pos", (F.col("pos") / F.lit(BLOCK)).cast("long").alias("blk"),
        initial.alias("initial"), fault.alias("fault"),
    )


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def _transfers(rows: list[tuple]) -> list[tuple]:
    """Rows (conv_id, blk, pos, initial, fault, role) of one block: its matrix, inner illegal pairs, first and last role."""
    initials, faults, roles = [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]
    illegal = sum(not _legal(a, b) for a, b in zip(roles, roles[1:]))
    matrix = [x for line in transfer(initials, faults) for x in line]
    return [(rows[0][0], rows[0][1], matrix, illegal, roles[0], roles[-1])]


def _ends(blocks: list[tuple]) -> list[tuple]:
    """Block summaries of one conversation in order: the cost-to-go vector at each block end, folded from the last."""
    v, out = end_vector(), []
    illegal = sum(b[3] for b in blocks) + sum(not _legal(a[5], b[4]) for a, b in zip(blocks, blocks[1:]))
    for k in range(len(blocks) - 1, -1, -1):
        conv, blk, matrix = blocks[k][:3]
        out.append((conv, blk, list(v), k == len(blocks) - 1, illegal))
        v = [min(min(matrix[q * 4 + t] + v[t] for t in range(4)), _INF) for q in range(4)]
    return out[::-1]


def _walks(rows: list[tuple]) -> list[tuple]:
    """Rows (conv_id, blk, pos, initial, fault, end, last) of one block: a walk from each entry state."""
    initials, faults = [r[3] for r in rows], [r[4] for r in rows]
    out = []
    for q in range(4):
        exit_state, cost, tokens, tail = walk(initials, faults, rows[0][5], rows[0][6], q)
        out.append((rows[0][0], rows[0][1], q, exit_state, cost, "".join(tokens) + tail, tokens, tail, len(rows)))
    return out


def _chain(walks: list[tuple]) -> list[tuple]:
    """Rows (conv_id, blk, entry, exit) of one conversation by block and entry: the entry state of every block."""
    q, chosen, by = 0, [], {}
    for conv, blk, entry, exit_state in walks:
        by[blk, entry] = exit_state
    for blk in sorted({w[1] for w in walks}):
        chosen.append((walks[0][0], blk, q))
        q = by[blk, q]
    return chosen


def by_group(df: DataFrame, keys: list[str], order: list[str], work, schema: str) -> DataFrame:
    """``work`` on the rows of every group, groups dealt by key and read in order; many groups to an Arrow batch.

    A task holds one group's rows at a time (a block, or a conversation's block summaries).
    """
    out_schema = T._parse_datatype_string(schema)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, done = None, [], []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                key = values[:width]
                if rows and key != current:
                    done += work(rows)
                    rows = []
                current = key
                rows.append(values)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(out_schema.names, r)) for r in done], schema=_arrow(out_schema))
                done = []
        if rows:
            done += work(rows)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(out_schema.names, r)) for r in done], schema=_arrow(out_schema))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired rows in (conversation, place) order: one SHA-256 per conversation, carried across batches."""
    current, digest, state, first = object(), None, 0, True
    done = []

    def finish():
        if digest is not None:
            done.append((current, digest.hexdigest()))

    for batch in batches:
        for conv, token, role, text in zip(batch["conv_id"], batch["token"], batch["role"], batch["text"]):
            conv = None if pd.isna(conv) else int(conv)
            if digest is None or conv != current:
                finish()
                current, digest, state, first = conv, hashlib.sha256(), 0, True
            for letter in token:
                if letter == "D":
                    continue
                if letter == "K":
                    line, state = f"{role}:{text}", _NEXT[state][INITIAL.get(role[:1], 3)]
                else:  # I or R
                    line = f"{_INSERT_ROLE[state]}:{text if letter == 'R' else ''}"
                    state = _INSERT_TO[state]
                digest.update(("" if first else "\n").encode() + line.encode())
                first = False
        if len(done) > 1000:
            yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"])
            done = []
    finish()
    yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame) -> DataFrame:
    """One row per original conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = durable(damaged(conversations), "repair-rows")
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id"))
    blocks = by_group(
        rows.select("conv_id", "blk", "pos", "initial", "fault", "role"), ["conv_id", "blk"], ["pos"], _transfers,
        "conv_id long, blk long, matrix array<long>, illegal long, first_role string, last_role string",
    )
    ends = durable(
        by_group(blocks, ["conv_id"], ["blk"], _ends, "conv_id long, blk long, end array<long>, last boolean, illegal long"),
        "repair-ends",
    )
    walks = durable(
        by_group(
            rows.alias("l")
            .join(ends.alias("r"), same & (F.col("l.blk") == F.col("r.blk")))
            .select("l.conv_id", "l.blk", "pos", "initial", "fault", "end", "last"),
            ["conv_id", "blk"], ["pos"], _walks,
            "conv_id long, blk long, entry int, exit int, cost long, piece string, tokens array<string>, tail string, n_rows long",
        ),
        "repair-walks",
    )
    entries = by_group(walks.select("conv_id", "blk", "entry", "exit"), ["conv_id"], ["blk", "entry"], _chain, "conv_id long, blk long, entry int")
    chosen = durable(
        walks.alias("l").join(entries.alias("r"), same & (F.col("l.blk") == F.col("r.blk")) & (F.col("l.entry") == F.col("r.entry")))
        .select("l.conv_id", "l.blk", "cost", "piece", "tokens", "tail", "n_rows"),
        "repair-chosen",
    )
    edits = chosen.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", "piece"))), lambda s: s["piece"]), "").alias("audit"),
    )
    tokens = chosen.select("conv_id", "blk", F.posexplode("tokens").alias("i", "token")).select(
        "conv_id", (F.col("blk") * BLOCK + F.col("i")).alias("pos"), "token"
    ).unionByName(
        chosen.where(F.col("tail") != "").select("conv_id", (F.col("blk") * BLOCK + F.col("n_rows")).alias("pos"), F.col("tail").alias("token"))
    )
    lines = (
        tokens.alias("l")
        .join(rows.alias("r"), same & (F.col("l.pos") == F.col("r.pos")), "left")
        .select("l.conv_id", "l.pos", "token", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "pos")
    )
    hashes = lines.mapInPandas(_hash, "conv_id long, repaired_sha256 string")
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *(F.count(F.when(F.col("fault") == code, 1)).alias(name) for name, code in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))),
    )
    illegal = ends.groupBy("conv_id").agg(F.max("illegal").alias("illegal"))
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (counts, illegal, edits, hashes):
        out = out.alias("l").join(part.alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")), "left").select("l.conv_id", *[f"r.{c}" for c in part.columns if c != "conv_id"], *[f"l.{c}" for c in out.columns if c != "conv_id"])
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id",
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
