"""Digests with exact byte layouts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_64 = 18446744073709551616.0


#: Fixed value: white space, Unicode's too.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ENDS = rf"^{BLANK}+|{BLANK}+$"


def clean_text(c: Column) -> Column:
    """Null as '', white space of any kind at both ends removed."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), ENDS, "")


def stable_digest(seed: int, *values: Column) -> Column:
    """SHA-256 of seed::v1::v2... over cleaned values, as lowercase hex."""
    return F.sha2(F.concat_ws("::", F.lit(str(int(seed))), *map(clean_text, values)), 256)


def leading_uint64(hex_digest: Column) -> Column:
    """The first eight bytes, big-endian, as decimal(20,0): unsigned values don't fit a long."""
    return F.conv(F.substring(hex_digest, 1, 16), 16, 10).cast("decimal(20,0)")


def stable_fraction(seed: int, value: Column) -> Column:
    """A fraction in [0, 1] from SHA-256 of seed::value; through double, as decimals would keep other digits."""
    return leading_uint64(F.sha2(F.concat(F.lit(f"{int(seed)}::"), value.cast("string")), 256)).cast("double") / F.lit(TWO_64)


def condition_seed(*parts: Column) -> Column:
    """A seed above 2**63 at times: the leading bytes of SHA-256 of the parts joined by '|'."""
    return leading_uint64(F.sha2(F.concat_ws("|", *parts), 256))


def image_digest(height: Column, width: Column, pixels: Column, channels: int = 3) -> Column:
    """SHA-256 over 'HxWxC|' (masks: 'HxW|') and the raw bytes."""
    shape = F.concat(height.cast("string"), F.lit("x"), width.cast("string"), F.lit(f"x{channels}|" if channels > 1 else "|"))
    return F.sha2(F.concat(shape.cast("binary"), pixels), 256)


def packed_digest(shape: list[Column], pixels: Column) -> Column:
    """SHA-256 over the shape as little-endian 64-bit integers and the raw bytes."""

    def little(c: Column) -> Column:
        digits = F.lpad(F.hex(c.cast("long")), 16, "0")
        return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2))))

    return F.sha2(F.concat(*map(little, shape), pixels), 256)


def ordered_digest(line: Column) -> Column:
    """Aggregate: SHA-256 over a group's lines in order, one after the other. The group must fit one task."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ""), 256)


def length_prefixed(*fields: Column) -> Column:
    """Fields as length:value, joined by the unit separator: no two lists of fields give one text."""
    return F.concat_ws("\x1f", *(F.concat(F.length(f).cast("string"), F.lit(":"), f) for f in map(lambda c: F.coalesce(c.cast("string"), F.lit("")), fields)))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))
