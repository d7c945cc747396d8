"""Scalar rules: identifiers, sources, numbers, bits, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digests import clean_text

#: Splits that evaluation seals.
PROTECTED = ["val", "validation", "test", "test_v3", "ph2", "external", "external_audit"]


def first_present(*candidates: Column) -> Column:
    """The first that isn't blank, trimmed; null if all are."""
    return F.coalesce(*(F.nullif(clean_text(c), F.lit("")) for c in candidates))


def path_stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.nullif(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), F.lit(""))


def sample_id(path: Column, *candidates: Column) -> Column:
    return F.coalesce(first_present(*candidates), path_stem(clean_text(path)))


def split_group(group: Column, patient: Column, lesion: Column, duplicate: Column, image: Column, original: Column) -> Column:
    """The precedence group, patient, lesion, duplicate; empty text counts as missing."""
    full = lambda c: c.isNotNull() & (c.cast("string") != "")
    rest = F.when(full(duplicate), duplicate).when(full(image), image).otherwise(original)
    return (
        F.when(full(group), group.cast("string"))
        .when(full(patient), F.concat(F.lit("patient:"), patient))
        .when(full(lesion), F.concat(F.lit("lesion:"), lesion))
        .otherwise(F.concat(F.lit("duplicate:"), rest))
    )


def record_group(digest: Column, image: Column, original: Column) -> Column:
    full = lambda c: c.isNotNull() & (c != "")
    return F.when(full(digest), F.concat(F.lit("exact:"), digest)).when(full(image), F.concat(F.lit("isic:"), image)).otherwise(F.concat(F.lit("record:"), F.coalesce(original, F.lit(""))))


def source_tokens(c: Column) -> Column:
    """Lower case, '-' and '/' as '_', empty tokens dropped."""
    return F.array_join(F.filter(F.split(F.lower(clean_text(c)), "[-/_]"), lambda x: x != ""), "_")


def is_protected(*columns: Column, names: list[str] | None = None) -> Column:
    out = F.lit(False)
    for c in columns:
        v = source_tokens(c)
        out = out | v.isin(names or PROTECTED) | F.array_contains(F.split(v, "_"), "ph2")
    return out


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def shown_number(c: Column, digits: int = 4) -> Column:
    return F.when(is_finite(c), F.format_string(f"%.{digits}f", c)).otherwise("not computable")


def is_canonical_id(c: Column, prefix: str) -> Column:
    """Begins with the prefix, printable ASCII, no '|'."""
    return F.coalesce(c.startswith(prefix) & c.rlike(r"^[\x20-\x7B\x7D\x7E]+$"), F.lit(False))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def quantized(c: Column) -> Column:
    """A value in [0, 1] as a byte, halves up."""
    return F.floor(c * 255.0 + 0.5).cast("int")


def sigmoid(c: Column) -> Column:
    clipped = F.greatest(F.lit(-80.0), F.least(F.lit(80.0), c))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def tex_escape(c: Column) -> Column:
    """The characters that TeX reads as commands."""
    c = F.replace(c, F.lit("\\"), F.lit("\\textbackslash{}"))
    for x in "&%$#_":
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def phrase(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def basename(c: Column) -> Column:
    return F.lower(F.element_at(F.split(c, "/"), -1))
