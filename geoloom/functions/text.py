"""Text and number formats as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road name parts and their short forms, in the order in which they are applied.
ROAD_PARTS = ((" Boulevard", " Blvd"), (" Circle", " Cir"), (" Drive", " Dr"), (" Street", " St"), (" Avenue", " Ave"), (" Place", " Pl"), (" Court", " Ct"), (" Lane", " Ln"), (" Road", " Rd"), (" Trail", " Trl"), (" Parkway", " Pkwy"), (" Highway", " Hwy"), ("South ", "S "), ("North ", "N "), ("East ", "E "), ("West ", "W "))


def short_road(name: Column) -> Column:
    for long, short in ROAD_PARTS:
        name = F.replace(name, F.lit(long), F.lit(short))
    return name


def elevation(text: Column) -> Column:
    """Metres of an elevation tag: a number, then metres or feet; null for anything else, 0 below zero, 65535 at most."""
    clean = F.trim(text)
    number = F.regexp_extract(clean, r"^([^\s,a-zA-Z']+)\s*(.*)$", 1).try_cast("double")
    unit = F.lower(F.trim(F.regexp_extract(clean, r"^([^\s,a-zA-Z']+)\s*(.*)$", 2)))
    metres = F.when(unit.isin("", "m"), number).when(unit.isin("ft", "feet", "'"), number * 0.3048)
    return F.when(metres.isNotNull(), F.when((metres <= 0) | F.isnan(metres) | (F.abs(metres) == float("inf")), 0).otherwise(F.least(F.round(metres), F.lit(65535.0)))).cast("int")


def csv_field(text: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line end."""
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def hex_colour(text: Column) -> Column:
    """struct(r, g, b, a) in 0..1 of #RGB, #RGBA, #RRGGBB or #RRGGBBAA, with or without #; null for anything else."""
    digits = F.regexp_replace(text, "^#", "")
    doubled = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    full = F.when(F.length(doubled) == 6, F.concat(doubled, F.lit("ff"))).otherwise(doubled)
    part = lambda i: (F.conv(F.substring(full, 2 * i + 1, 2), 16, 10).cast("double") / 255).cast("float")
    ok = full.rlike("^[0-9a-fA-F]{8}$")
    return F.when(ok, F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"), part(3).alias("a")))


def first_bytes(text: Column, n: int) -> Column:
    """The first n bytes of the UTF-8 form; may end inside a character."""
    return F.substring(F.encode(text, "UTF-8"), 1, n)


def micro(degrees: Column) -> Column:
    """Millionths of a degree, cut off towards zero."""
    return (degrees * 1_000_000).cast("int")


def centi(degrees: Column) -> Column:
    return (degrees * 100).cast("int")


def chunk(blob: Column, i: Column, size: int) -> Column:
    """The i-th chunk of a blob; an error beyond the last."""
    count = F.ceil(F.octet_length(blob) / size)
    part = F.substring(blob, (i * size + 1).cast("int"), F.lit(size))
    return F.when(F.when((i < 0) | (i >= count), F.raise_error(F.lit("chunk out of range"))).isNull(), part)


def chunk_count(blob: Column, size: int) -> Column:
    return F.ceil(F.octet_length(blob) / size).cast("int")


def big_endian_int(blob: Column, first_byte: int) -> Column:
    """A signed 32-bit number of a blob (first_byte from 0)."""
    unsigned = F.conv(F.hex(F.substring(blob, first_byte + 1, 4)), 16, 10).cast("long")
    return F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned).cast("int")


def feature_estimate(file_bytes: Column) -> Column:
    """Features expected in a map extract of this size: ten thousand per MB, 1024 at least."""
    return F.greatest(F.lit(1024), F.floor(file_bytes / (1024 * 1024)) * 10_000).cast("long")


def memory_estimate(file_bytes: Column) -> Column:
    return feature_estimate(file_bytes) * 256


def next_diff_url(base: Column, sequence: Column) -> Column:
    """Address of the diff after ``sequence``: the number in three groups of three digits, the first longer from a thousand million on; null without a number."""
    n = sequence + 1
    by = lambda d: F.call_function("div", n, F.lit(d))  # noqa: E731  exact, as doubles are not beyond 2^53
    url = F.format_string("%s/%03d/%03d/%03d.osc.gz", F.regexp_replace(base, "/+$", ""), by(1_000_000), by(1000) % 1000, n % 1000)
    return F.when(n.isNotNull(), url)
