"""Chat formatting by schema fingerprints, in DataFrame expressions only.

Rows of one frame may hold chats in different layouts: a prompt with a
response, an instruction with an output, lists of messages. The nested field
paths that a row fills are hashed; the hash selects a declarative mapping, and
that yields canonical turns (role, text). Turns become one string with marks;
control strings inside texts get a backslash that reading takes off again.

A row's conversation is one value by contract, so all its expressions are
linear in its length: nothing looks up positions in the whole string.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowtriage.llm.common import without

#: Fixed marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
#: An opener and backslashes before the rest of a control string, which may hold the opener of
#: another. More or fewer backslashes within a rest leave it one, so one more backslash after
#: each opener is undone by one less.
_CONTROL = r"(<|\[)(\\*)(?=\|[^\s<|>]+\|>|/?s>|/?INST\]|/?SYS>)"
_ESCAPED = r"(<|\[)\\(\\*)(?=\|[^\s<|>]+\|>|/?s>|/?INST\]|/?SYS>)"
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Layout:
    """Field paths that must be filled, those that may be, and the turns they hold as a SQL expression."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: str


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', coalesce(cast({text} AS STRING), ''))"


LAYOUTS = (
    Layout(
        "prompt", ("prompt",), ("response",),
        f"array({_turn(repr('user'), 'prompt')}, {_turn(repr('assistant'), 'response')})",
    ),
    Layout(
        "instruction", ("instruction", "output"), ("system", "input"),
        "filter(array("
        f"IF(system IS NULL, NULL, {_turn(repr('system'), 'system')}), "
        + _turn("'user'", "concat_ws('\\n\\n', cast(instruction AS STRING), cast(input AS STRING))")
        + f", {_turn(repr('assistant'), 'output')}), t -> t IS NOT NULL)",
    ),
    Layout(
        "messages", ("messages[]",), ("messages[].role", "messages[].content"),
        f"transform(messages, m -> {_turn('coalesce(cast(m.role AS STRING), ' + repr('') + ')', 'm.content')})",
    ),
    Layout(
        "exchanges", ("exchanges[]",), ("exchanges[].from", "exchanges[].value"),
        "transform(exchanges, m -> "
        + _turn("CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(m.from, '') END", "m.value")
        + ")",
    ),
)


def field_paths(schema: T.StructType, columns: Sequence[str]) -> list[tuple[str, Column]]:
    """Sorted nested paths of the columns, each with the condition that a row fills it."""
    found: list[tuple[str, Column]] = []

    def walk(path: str, kind: T.DataType, filled) -> None:
        """filled(test): the condition that some value at this path passes ``test``."""
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                walk(
                    f"{path}.{field.name}", field.dataType,
                    lambda test, name=field.name: filled(lambda value: test(value.getField(name))),
                )
        elif isinstance(kind, T.ArrayType):
            found.append((f"{path}[]", filled(lambda value: value.isNotNull())))
            if isinstance(kind.elementType, T.StructType):
                walk(f"{path}[]", kind.elementType, lambda test: filled(lambda value: F.exists(value, test)))
        else:
            found.append((path, filled(lambda value: value.isNotNull())))

    for name in columns:
        walk(name, schema[name].dataType, lambda test, name=name: test(F.col(f"`{name}`")))
    return sorted(found, key=lambda x: x[0])


def _hash(paths: Sequence[str]) -> Column:
    """A constant: the hash of a set of paths."""
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def _hashes(layout: Layout) -> list[Column]:
    """The hashes of the required paths with every choice of optional ones."""
    choices = (c for n in range(len(layout.optional) + 1) for c in combinations(layout.optional, n))
    return [_hash([*layout.required, *c]) for c in choices]


def canonical_turns(df: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Add layout, layout_hash and turns (array of role and text) to every row.

    Only columns that a layout names take part; others pass through, and those
    called like a result are replaced. A row whose filled paths fit no layout,
    an all-null row included, is kept with layout 'unknown' and null turns.
    Null texts are empty, an empty list of messages has no turns.
    """
    named = {p.split("[")[0].split(".")[0] for x in layouts for p in (*x.required, *x.optional)}
    kept = without(df, ["layout", "layout_hash", "turns"])
    present = [c for c in kept if c in named]
    frame = df.select(*kept)
    paths = field_paths(frame.schema, present)
    known = {p for p, _ in paths}
    frame = frame.withColumns({c: F.lit(None).cast("string") for c in sorted(named - set(present)) if c})
    filled = F.array(*[F.when(test, F.lit(path)) for path, test in paths]) if paths else F.array().cast("array<string>")
    frame = frame.withColumn("layout_hash", F.xxhash64(F.array_join(filled, "\n")))
    usable = [x for x in layouts if set(x.required) <= known]
    layout, turns = F.lit(UNKNOWN), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in reversed(usable):
        fits = F.col("layout_hash").isin(*_hashes(x))
        layout, turns = F.when(fits, F.lit(x.name)).otherwise(layout), F.when(fits, F.expr(x.turns)).otherwise(turns)
    return frame.withColumns({"layout": layout, "turns": turns}).select(*kept, "layout", "layout_hash", "turns")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2")


def format_turns(df: DataFrame, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """Add formatted and loss_mask for the column ``turns``.

    loss_mask has an entry per turn: before, trained and after are numbers of
    characters, and all of them together make up ``formatted``; ``trained``
    covers the text of turns whose role is listed. Null turns give nulls, no
    turns an empty string and an empty mask.
    """

    def marked(turn: Column) -> Column:
        head = F.concat(F.lit(START), F.url_encode(turn["role"]), F.lit("\n"))
        return F.struct(
            head.alias("head"), escape(turn["text"]).alias("body"), turn["role"].isin(*trained).alias("trained")
        )

    def masked(part: Column) -> Column:
        head, body = F.length(part["head"]), F.length(part["body"])
        return F.struct(
            F.when(part["trained"], head).otherwise(head + body).alias("before"),
            F.when(part["trained"], body).otherwise(0).alias("trained"),
            F.lit(len(END)).alias("after"),
        )

    parts = df.select(*without(df, ["formatted", "loss_mask", "_parts"]), F.transform("turns", marked).alias("_parts"))
    return parts.withColumns({
        "formatted": F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""),
        "loss_mask": F.transform("_parts", masked),
    }).drop("_parts")


def read_formatted(df: DataFrame) -> DataFrame:
    """Add read_turns and trained_text, from the columns formatted and loss_mask alone."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    frame = df.select(*without(df, ["read_turns", "trained_text", "_pieces"]), pieces.alias("_pieces"))
    frame = frame.withColumn("_pieces", F.slice("_pieces", 1, F.size("_pieces") - 1))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = F.url_decode(F.substr(head, F.lit(len(START) + 1)))
        return F.struct(
            role.alias("role"), unescape(F.substr(piece, F.length(head) + 2)).alias("text")
        )

    under = F.zip_with(
        "_pieces", "loss_mask", lambda piece, m: unescape(F.substr(piece, m["before"] + 1, m["trained"]))
    )
    return frame.withColumns({
        "read_turns": F.transform("_pieces", turn), "trained_text": F.array_join(under, "")
    }).drop("_pieces")


def lay_out(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Chats stored a turn per row, as one row per chat in the layout that fits its shape.

    Columns: conv_id, prompt, response, system, instruction, output, messages,
    exchanges. Turns are ordered by turn, role and text, so equal turn numbers
    and repeated rows have a fixed place. Null roles and texts are empty.
    """
    chats = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                )
            )
        ).alias("_all")
    )
    roles = F.transform("_all", lambda t: t["role"])
    shape = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), "prompt")
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), "instruction")
        .when(F.forall(roles, lambda r: r.isin("user", "assistant")), "exchanges")
        .otherwise("messages")
    )
    chats = chats.withColumn("_shape", shape)

    def text(name: str, place: int) -> Column:
        return F.when(F.col("_shape") == name, F.col("_all")[place]["text"])

    human = F.transform(
        "_all",
        lambda t: F.struct(
            F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["text"].alias("value")
        ),
    )
    messages = F.transform("_all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return chats.select(
        "conv_id",
        text("prompt", 0).alias("prompt"),
        text("prompt", 1).alias("response"),
        text("instruction", 0).alias("system"),
        text("instruction", 1).alias("instruction"),
        text("instruction", 2).alias("output"),
        F.when(F.col("_shape") == "messages", messages).alias("messages"),
        F.when(F.col("_shape") == "exchanges", human).alias("exchanges"),
    )
