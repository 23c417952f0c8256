"""Quality flags and validity of feature rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import vocab
from labelloom.functions.vectors import is_zero_vector

EMPTY_FLAGS = "cast(map() as map<string,boolean>)"


def merge_flags(first: Column, second: Column) -> Column:
    """Union of two flag maps, the second one winning on equal names."""
    a = F.coalesce(first, F.expr(EMPTY_FLAGS))
    b = F.coalesce(second, F.expr(EMPTY_FLAGS))
    return F.map_concat(F.map_filter(a, lambda name, _: ~F.map_contains_key(b, name)), b)


def flag_when(name: str, condition: Column) -> Column:
    """A map holding the flag where *condition* is true, else an empty map."""
    return F.when(condition, F.create_map(F.lit(name), F.lit(True))).otherwise(F.expr(EMPTY_FLAGS))


def has_flag(flags: Column, name: str) -> Column:
    """True only when the flag is present and set."""
    return F.coalesce(F.try_element_at(flags, F.lit(name)), F.lit(False))


def apply_quality_flags(
    flags: Column,
    confidence: Column,
    min_confidence: float,
    visible_landmarks: Column | None = None,
    min_visible_landmarks: int | None = None,
) -> Column:
    """Flags plus `low_confidence` and `insufficient_landmarks` by threshold."""
    result = merge_flags(flags, flag_when("low_confidence", confidence < min_confidence))
    if visible_landmarks is not None and min_visible_landmarks is not None:
        few = visible_landmarks < min_visible_landmarks
        result = merge_flags(result, flag_when("insufficient_landmarks", few))
    return result


def is_valid_row(extraction_ok: Column, flags: Column, family: Column, inline: Column) -> Column:
    """False for failed extractions and for all-zero geometric vectors.

    Appearance rows may be all zero and still valid.
    """
    geometric = F.coalesce(family.isin(*vocab.GEOMETRIC_FAMILIES), F.lit(False))
    return (
        F.coalesce(extraction_ok, F.lit(True))
        & ~has_flag(flags, "detection_failed")
        & ~(geometric & is_zero_vector(inline))
    )


def is_filtered_family(family: Column) -> Column:
    """Families whose invalid rows are left out when a matrix is read."""
    return F.coalesce(family.isin(*vocab.GEOMETRIC_FAMILIES) | family.contains("hybrid"), F.lit(False))


def coverage_label(label: Column) -> Column:
    """Label used in coverage tables; blank and null become `_unknown_`."""
    blank = label.isNull() | (F.trim(label) == "")
    return F.when(blank, F.lit(vocab.UNKNOWN_COVERAGE_LABEL)).otherwise(label)


def flags_to_json(flags: Column) -> Column:
    """Flags as a JSON string, for text sinks."""
    return F.to_json(flags)


def flags_from_json(text: Column) -> Column:
    """Flags back from their JSON string."""
    return F.from_json(text, "map<string,boolean>")
