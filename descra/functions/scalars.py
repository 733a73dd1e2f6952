"""Scalar functions, as Spark columns where they apply to data and plain Python where they apply to settings."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def q6(x: Column) -> Column:
    """Six decimals by floor, which every engine computes alike."""
    return F.floor(x * 1e6 + F.lit(0.5)) / F.lit(1e6)


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def residue_number(text: Column) -> tuple[Column, Column]:
    """Number and insertion code ('' for none) of a residue field; null numbers for anything else."""
    pattern = r"^\s*(-?\d+)([A-Za-z]?)\s*$"
    ok = text.rlike(pattern)
    return F.when(ok, F.regexp_extract(text, pattern, 1).cast("int")), F.when(ok, F.regexp_extract(text, pattern, 2))


def insertion_code(code: Column) -> Column:
    """'' for blanks and placeholders, never null, so that keys join."""
    return F.coalesce(F.regexp_replace(F.trim(code), r"^[?.]$", ""), F.lit(""))


def motif_count(text: Column, motif: str) -> Column:
    """Occurrences, overlapping ones too."""
    return F.regexp_count(text, F.lit(f"(?={re.escape(motif)})"))


def shell_volume(start: float | Column, width: float | Column) -> Column:
    outer, inner = F.pow(F.lit(start) + F.lit(width), F.lit(3.0)), F.pow(F.lit(start), F.lit(3.0))
    return F.lit(4.0 / 3.0 * math.pi) * (outer - inner)


def shell_name(start: float, width: float) -> str:
    """4w3A; a fraction is written with p."""
    token = lambda x: f"{x:g}".replace(".", "p")
    return f"{token(start)}w{token(width)}A"


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"[^a-zA-Z0-9_.-]+", "_"), r"^_+|_+$", "")


def path_token(name: str, most: int = 96) -> str:
    """A name that is too long for a path keeps its head and gains a digest."""
    if len(name) <= most:
        return name
    return f"{name[: most - 15]}_{hashlib.sha256(name.encode()).hexdigest()[:14]}"


def feature_budget(n: Column, share: float = 0.15) -> Column:
    return F.greatest(F.lit(1), F.floor(n * share).cast("int"))


def subsample_fraction(n: Column) -> Column:
    return F.greatest(F.lit(0.4), F.least(F.lit(0.8), 1.0 / F.log10(n + 5)))


def subsample_count(n: Column) -> Column:
    return F.greatest(F.lit(100), F.least(F.lit(300), F.bround(500.0 / F.log10(n)).cast("int")))


def as_bool(value, name: str = "value") -> bool:
    if isinstance(value, bool):
        return value
    text = str(value).strip().lower()
    if text in ("true", "yes", "on", "1"):
        return True
    if text in ("false", "no", "off", "0"):
        return False
    raise ValueError(f"{name} must be true or false, not {value!r}")


def as_int(value, name: str = "value") -> int:
    if isinstance(value, bool) or (isinstance(value, float) and not value.is_integer()):
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    try:
        return int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a whole number, not {value!r}") from None


def as_list(value, name: str = "value") -> list[str]:
    if value is None:
        return []
    if isinstance(value, str):
        return [x.strip() for x in value.split(",") if x.strip()]
    if isinstance(value, (list, tuple)):
        return [str(x).strip() for x in value]
    raise ValueError(f"{name} must be a list, not {value!r}")
