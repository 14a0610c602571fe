"""Expressions over flow attributes: labels, ports, cleaning, source keys."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from flowtriage import schema as S


def literal_map(entries: Mapping) -> Column:
    """A constant map column for small fixed lookup tables."""
    cells = []
    for key, value in entries.items():
        cells += [F.lit(key), F.lit(value)]
    return F.create_map(*cells)


def binary_label(label: Column) -> Column:
    """0 for benign (any case, any padding), 1 for every other label."""
    return (F.lower(F.trim(label)) != "benign").cast("int")


def ground_truth(label: Column) -> Column:
    """Like ``binary_label`` but null for unlabelled rows, so metrics skip them."""
    key = F.lower(F.trim(label))
    return F.when(key.isNotNull() & ~key.isin("unknown", ""), (key != "benign").cast("int"))


def family(label: Column) -> Column:
    """Canonical attack family; labels without an alias pass through trimmed."""
    trimmed = F.trim(label)
    return F.coalesce(F.try_element_at(literal_map(S.LABEL_FAMILIES), F.lower(trimmed)), trimmed)


def matches_attack_type(label: Column, attack_type: str) -> Column:
    """True when the label contains any keyword of the attack type ('all' = any attack)."""
    key = F.lower(F.trim(label))
    hit = key != "benign"
    words = S.ATTACK_KEYWORDS.get(attack_type.lower(), ())
    if not words:
        return hit
    found = F.lit(False)
    for word in words:
        found = found | F.contains(key, F.lit(word))
    return hit & found


def is_finite(value: Column) -> Column:
    """True for ordinary numbers; NaN sorts above infinity, null stays null."""
    return F.abs(value.cast("double")) < float("inf")


def finite_or_null(value: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(is_finite(value), value.cast("double"))


def lenient_double(value: Column) -> Column:
    """Anything that is not a finite number (text, null, NaN, infinity) becomes 0."""
    return F.coalesce(finite_or_null(value.try_cast("double")), F.lit(0.0))


def port_class(port: Column) -> Column:
    """0 web, 1 auth/service, 2 other."""
    return (
        F.when(port.isin(*S.WEB_PORTS), 0).when(port.isin(*S.AUTH_PORTS), 1).otherwise(2)
    )


def on_service_port(ports: Iterable[int], *candidates: Column) -> Column:
    """True when any candidate port column, read as a number, is in ``ports``."""
    wanted = [float(p) for p in ports]
    hit = F.lit(False)
    for candidate in candidates:
        hit = hit | F.coalesce(candidate.try_cast("double").isin(*wanted), F.lit(False))
    return hit


def source_key(src_ip: Column | None, dst_port: Column, prefix: str = "row_") -> Column:
    """Source address when present, else a key derived from the destination port."""
    fallback = F.concat(F.lit(prefix), dst_port.cast("int").cast("string"))
    return fallback if src_ip is None else F.coalesce(src_ip.cast("string"), fallback)


def phase_load(phase: Column) -> Column:
    """Analyst load of a 0-based phase; the last phase sticks."""
    loads = F.array(*[F.lit(v) for v in S.LOAD_PHASES])
    return F.element_at(loads, F.least(phase, F.lit(len(S.LOAD_PHASES) - 1)) + 1)


def suspicion_score(
    severity: Column,
    event_type: Column,
    is_internal_src: Column,
    country: Column,
    process: Column,
) -> Column:
    """Additive rule score of a SOC event, capped at 0.95."""
    # Rule names and weights.
    suspicious_types = ("autorun_entry", "service_install", "scheduled_task_created")
    suspicious_processes = ("powershell.exe",)
    rules = (
        (severity >= 3, 0.15),
        (severity == 4, 0.10),
        (event_type.isin(*suspicious_types), 0.35),
        (is_internal_src == 0, 0.05),
        (country == "CN", 0.10),
        (process.isin(*suspicious_processes), 0.12),
    )
    total = F.lit(0.04)
    for condition, weight in rules:
        total = total + F.when(condition, weight).otherwise(0.0)
    return F.least(total, F.lit(0.95))


def soc_message_field(msg: Column, field: str) -> Column:
    """One value out of a ``k=v; k=v`` message."""
    return F.try_element_at(F.str_to_map(msg, F.lit("; "), F.lit("=")), F.lit(field))


def micros_of(ts: Column, kind: str) -> Column:
    """Microseconds on a time axis; zone-less timestamps ignore the session zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(ts.cast("timestamp"))
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("long")
    return F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000 + minutes * 60_000_000 + second


def hash_order(row_id: Column, seed: int | str | Column) -> Column:
    """A reproducible shuffle key: the same rows always sort the same way."""
    suffix = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), suffix))
