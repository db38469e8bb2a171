"""Scalars of texts: quoted locators, slugs, numbers with units, JSON points with tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units and their sizes (fixed values).
COUNT_UNITS = (("P", 10**15), ("T", 10**12), ("B", 10**9), ("M", 10**6), ("K", 10**3))
BYTE_UNITS = ((" PB", 1024**5), (" TB", 1024**4), (" GB", 1024**3), (" MB", 1024**2), (" KB", 1024))
POINTS = "array<struct<q:double,tau:double,tauTilde:double,sd:double,s:double>>"
SPECTRUM = "array<struct<alpha:double,f:double>>"


def quoted(text: Column) -> Column:
    """Percent-encoded, with a space as %20 and ~ and * as a URL path has them."""
    out = F.regexp_replace(F.url_encode(text), r"\+", "%20")
    return F.regexp_replace(F.regexp_replace(out, "%7E", "~"), r"\*", "%2A")


def gap_locator(scan: Column, source_id: Column, bucket_start: Column) -> Column:
    """The locator of a bucket that a CSV scan had no row for."""
    return F.concat_ws("/", F.lit("gap://csv"), quoted(scan), quoted(source_id), bucket_start.cast("string"))


def path_part(text: Column) -> Column:
    """Other characters than letters, digits, dot, underscore and dash become one dash; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def one_decimal(value: Column) -> Column:
    """A number from 1 on with one decimal, rounded as its exact binary value is, halves up; below 2^14."""

    def tenths(bits: int) -> Column:
        m = (value * float(1 << bits)).cast("long")  # exact
        return F.shiftright(m, bits) * 10 + F.shiftright(m.bitwiseAND((1 << bits) - 1) * 10 + (1 << (bits - 1)), bits)

    n = F.when(value >= 1024, tenths(48)).otherwise(tenths(52))
    return F.concat(F.floor(n / 10).cast("long").cast("string"), F.lit("."), (n % 10).cast("string"))


def with_unit(value: Column, units=COUNT_UNITS, plain: str = "") -> Column:
    """A whole number with one decimal and the largest unit that it reaches."""
    out = F.concat(value.cast("string"), F.lit(plain))
    for unit, size in reversed(units):
        out = F.when(value >= size, F.concat(one_decimal(value.cast("double") / float(size)), F.lit(unit))).otherwise(out)
    return out


def structure_points(json: Column) -> Column:
    """(q, tau, sd) of a JSON list; bad JSON is an empty list, tau falls back on tauTilde, sd on s, both on 0."""
    points = F.coalesce(F.from_json(json, POINTS), F.array().cast(POINTS))
    number = lambda *names: lambda p: F.coalesce(*[p[n] for n in names], F.lit(0.0))
    return F.transform(points, lambda p: F.struct(p["q"].alias("q"), number("tau", "tauTilde")(p).alias("tau"), number("sd", "s")(p).alias("sd")))


def spectrum_points(json: Column) -> Column:
    return F.coalesce(F.from_json(json, SPECTRUM), F.array().cast(SPECTRUM))


def ranges(points: Column, *fields: str) -> list[Column]:
    """Number of points, and least and greatest value of each field."""
    out = [F.size(points).alias("n_points")]
    for f in fields:
        values = points.getField(f)
        out += [F.array_min(values).alias(f"{f}_min"), F.array_max(values).alias(f"{f}_max")]
    return out


def error_bars(points: Column) -> Column:
    """(q, low, high): tau less and plus sd."""
    return F.transform(points, lambda p: F.struct(p["q"].alias("q"), (p["tau"] - p["sd"]).alias("low"), (p["tau"] + p["sd"]).alias("high")))
