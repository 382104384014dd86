"""Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cachesight.schema import SPLITS


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def split_name(c: Column, mode: str = "strict") -> Column:
    """Trimmed, lower-case, ``validation`` as ``val``. Other values raise (strict), stay (passthrough) or become ``other``."""
    v = F.lower(F.trim(c.cast("string")))
    known = F.when(v == "validation", "val").when(v.isin(*SPLITS), v)
    if mode == "strict":
        return known.otherwise(F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(v, F.lit("null")))))
    return known.otherwise(v if mode == "passthrough" else F.lit("other"))


def text_key(*columns: str, separator: str = "|") -> Column:
    """One string of several columns; nulls count as empty, so that positions never shift."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def pseudonym(c: Column, salt: str, digits: int = 24) -> Column:
    """``obj_`` and the first hex digits of the SHA-256 of salt|value; null stays null."""
    return F.concat(F.lit("obj_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), c.cast("string")), 256), 1, digits))


def pseudonym_list(c: Column, salt: str) -> Column:
    """Each element of a list joined by bars."""
    return F.array_join(F.transform(F.split(c, r"\|"), lambda x: pseudonym(x, salt)), "|")


def stable_score(*parts: Column) -> Column:
    """16 hex digits that order like a hash of the parts; text of a fixed width sorts like the number."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def odd_hash(*parts: Column) -> Column:
    """Parity of the last byte of a SHA-256: a coin that every engine tosses alike."""
    return F.conv(F.right(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(1)), 16, 10).cast("int") % 2 == 1


def sign(c: Column, tolerance: float = 1e-12) -> Column:
    return F.when(c > tolerance, 1).when(c < -tolerance, -1).otherwise(0)


def safe_ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def linear_score(intercept: float, coefficients: dict[str, float], means: dict[str, float]) -> Column:
    """Intercept and weighted features; what is not finite counts as the feature's mean."""
    terms = [F.when(finite(F.col(c)), F.col(c)).otherwise(means.get(c, 0.0)) * w for c, w in coefficients.items()]
    return reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))


def in_windows(t: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether t lies in one of the inclusive ranges."""
    return reduce(lambda a, b: a | b, [t.between(lo, hi) for lo, hi in ranges], F.lit(False))


def size_category(rows: Column) -> Column:
    """The names of size classes of published tables."""
    steps = [(1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"), (10_000_000, "1M<n<10M"), (100_000_000, "10M<n<100M"), (1_000_000_000, "100M<n<1B")]
    return reduce(lambda a, s: a.when(rows < s[0], s[1]), steps[1:], F.when(rows < steps[0][0], steps[0][1])).otherwise("n>1B")


def output_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_")


def byte_size(c: Column) -> Column:
    """A number of bytes with one decimal (halves to even) in the largest unit of 1024 that it reaches; bytes without one."""
    steps = [(4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")]
    out = F.lit(None).cast("string")
    for k, (power, unit) in enumerate(steps):
        shown = F.concat(F.format_string("%.1f", F.bround(c / F.lit(1024.0**power), 1)), F.lit(f" {unit}"))
        out = F.when(c >= 1024**power, shown) if k == 0 else out.when(c >= 1024**power, shown)
    return out.otherwise(F.concat(c.cast("string"), F.lit(" B")))


def reader_name(c: Column, names: dict[str, str]) -> Column:
    """The name that readers see; a value without one stays."""
    if not names:
        return c
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[c], c)
