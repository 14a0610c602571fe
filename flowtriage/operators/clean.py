"""Unify column dialects into the canonical flow schema and drop broken rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from flowtriage import schema as S
from flowtriage.functions.flow import is_finite, lenient_double


# Output name -> (accepted normalised headers, type).
TRANSPORT_COLUMNS = {
    "src_ip": (("src ip", "src_ip", "source ip"), "string"),
    "src_port": (("src port", "src_port", "source port"), "int"),
}


def normalise_headers(columns: Iterable[str], aliases: Mapping[str, str] = S.COLUMN_ALIASES) -> list[str | None]:
    """Lower-case canonical name per input column, None for a repeated one.

    A name may repeat before aliasing (two spellings of one header) or only
    after it (two dialects of one feature); either way the first column wins.
    """
    seen_raw: set[str] = set()
    seen_final: set[str] = set()
    resolved: list[str | None] = []
    for column in columns:
        raw = str(column).strip().lower()
        final = aliases.get(raw, raw).lower()
        if raw in seen_raw or final in seen_final:
            resolved.append(None)
        else:
            resolved.append(final)
            seen_final.add(final)
        seen_raw.add(raw)
    return resolved


def with_normalised_headers(df: DataFrame) -> DataFrame:
    """Rename every column to its lower-case canonical name; drop repeats."""
    names = normalise_headers(df.columns)
    positional = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return positional.select(
        *[F.col(f"_c{i}").alias(name) for i, name in enumerate(names) if name is not None]
    )


def feature_source(feature: str, available: set[str], fallbacks: bool) -> str | None:
    """Which normalised column supplies a feature, if any."""
    candidates = [feature.lower(), feature.lower().replace(" ", "_")]
    if fallbacks:
        for column in S.FEATURE_FALLBACKS.get(feature, ()):
            # The fallback column has itself been renamed by the alias step.
            candidates += [column, S.COLUMN_ALIASES.get(column, column).lower()]
    return next((c for c in candidates if c in available), None)


def feature_coverage(columns: Iterable[str], fallbacks: bool = False) -> int:
    """How many canonical features a table with these columns can supply."""
    available = {n for n in normalise_headers(columns) if n}
    return sum(feature_source(f, available, fallbacks) is not None for f in S.FEATURES)


def canonicalise(
    df: DataFrame,
    on_bad: str = "drop",
    fallbacks: bool = False,
    keep: Mapping[str, Column | str] | None = None,
    units: Mapping[str, float] | None = None,
    transport: bool = False,
) -> DataFrame:
    """Project any dialect to the 61 features plus ``Label``.

    ``on_bad="drop"`` removes rows holding a missing or infinite value,
    ``"zero"`` replaces such values by 0. ``keep`` carries extra columns of the
    input through (output name -> input column) so raw attributes stay aligned
    with the cleaned row without a join. ``units`` multiplies single features.
    Everything is one projection and one filter, so column pruning reaches the
    scan: features nobody selects afterwards are only read for the filter.
    ``transport`` adds nullable ``src_ip`` and ``src_port``.
    """
    if on_bad not in ("drop", "zero"):
        raise ValueError("on_bad must be 'drop' or 'zero'")
    carried = {
        f"_keep_{name}": (source if isinstance(source, Column) else df[source])
        for name, source in (keep or {}).items()
    }
    names = normalise_headers(df.columns)
    flat = df.select("*", *[c.alias(n) for n, c in carried.items()])
    positional = flat.toDF(*[f"_c{i}" for i in range(len(names))], *carried)
    position = {name: f"_c{i}" for i, name in enumerate(names) if name is not None}

    output: list[Column] = []
    checked: list[Column] = []
    for feature in S.FEATURES:
        source = feature_source(feature, set(position), fallbacks)
        if source is None:
            output.append(F.lit(0.0).cast("float").alias(feature))
            continue
        raw = F.col(position[source])
        if on_bad == "zero":
            value = lenient_double(raw)
        else:
            value = raw.try_cast("double")
            checked.append(is_finite(value))
        factor = (units or {}).get(feature)
        output.append((value * factor if factor else value).cast("float").alias(feature))
    if "label" in position:
        label = F.col(position["label"]).cast("string")
        if on_bad == "drop":
            checked.append(label.isNotNull())
    else:
        label = F.lit("Unknown")
    output.append(label.alias("Label"))
    output += [F.col(c).alias(c.removeprefix("_keep_")) for c in carried]
    if transport:
        for name, (spellings, kind) in TRANSPORT_COLUMNS.items():
            found = next((position[n] for n in spellings if n in position), None)
            value = F.lit(None) if found is None else F.col(found)
            output.append((value.try_cast(kind) if found else value.cast(kind)).alias(name))

    condition = None
    for test in checked:
        condition = test if condition is None else condition & test
    kept = positional if condition is None else positional.filter(condition)
    return kept.select(*output)


def drop_bad_rows(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop rows whose listed numeric columns hold null, NaN or an infinity."""
    condition = F.lit(True)
    for column in columns:
        condition = condition & is_finite(F.col(column))
    return df.filter(condition)


def coverage_filter(df: DataFrame, label: Column, coverage: Column, benign_min: int = 20, attack_min: int = 11) -> DataFrame:
    """Keep rows whose source table supplies enough features for their class."""
    benign = F.lower(F.trim(label)) == "benign"
    return df.filter(F.when(benign, coverage >= benign_min).otherwise(coverage >= attack_min))


def before_after_sample(df: DataFrame, raw_columns: list[str], order: str, label: str, rows: int = 5) -> DataFrame:
    """The first rows as read (text, with NaN/Inf spelled out) and as cleaned."""
    def shown(name: str) -> Column:
        c = F.col(name)
        if dict(df.dtypes)[name] in ("double", "float"):
            c = F.when(F.isnan(c) | c.isNull(), "NaN").when(F.abs(c) == float("inf"), "Inf").otherwise(c.cast("string"))
        return F.coalesce(c.cast("string"), F.lit("NaN")).alias(name)

    numeric = [n for n, t in df.dtypes if n in raw_columns and t in ("double", "float", "int", "bigint")]
    before = df.orderBy(order).limit(rows).select(
        F.lit("raw").alias("view"), F.col(order).alias("row_id"), *[shown(c) for c in raw_columns],
        F.lit(None).cast("string").alias("is_threat"),
    )
    after = drop_bad_rows(df, numeric).orderBy(order).limit(rows).select(
        F.lit("processed").alias("view"), F.col(order).alias("row_id"),
        *[
            (F.bround(F.col(c).cast("double"), 4) if c in numeric else F.col(c)).cast("string").alias(c)
            for c in raw_columns
        ],
        (F.lower(F.trim(F.col(label))) != "benign").cast("int").cast("string").alias("is_threat"),
    )
    return before.unionByName(after)
