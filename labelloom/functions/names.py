"""Resolution of metric, family and algorithm names."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import vocab


def metric_name(name: str) -> str:
    """Stored key of a metric."""
    return vocab.METRIC_ALIASES.get(str(name).strip(), str(name).strip())


def metric_name_column(name: Column) -> Column:
    """Stored key of a metric, for a column of names."""
    pairs = [F.lit(part) for pair in vocab.METRIC_ALIASES.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.trim(name)), F.trim(name))


def report_metrics(config: Mapping[str, Any] | None) -> list[str]:
    """Scalar metrics of a report in order, each once; the defaults if none is named."""
    config = config or {}
    wanted = list(config.get("report") or [])
    if not wanted:
        wanted = [config["primary"]] if config.get("primary") else []
        wanted += list(config.get("secondary") or [])
    names = [n for n in dict.fromkeys(map(metric_name, wanted)) if n not in vocab.NON_SCALAR_METRICS]
    return names or list(vocab.REPORT_METRICS)


def primary_metric(config: Mapping[str, Any] | None) -> str:
    """Metric a leaderboard is ranked by."""
    named = (config or {}).get("primary")
    return metric_name(named) if named else report_metrics(config)[0]


def stored_family(family: str) -> str:
    """Family value stored in the matrix for an experiment's family name."""
    return vocab.FEATURE_FAMILIES.get(family, family)


def stored_family_column(family: Column) -> Column:
    """`stored_family` for a column of names."""
    pairs = [F.lit(part) for pair in vocab.FEATURE_FAMILIES.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), family), family)


def algorithm_name(name: str) -> str:
    """Current name of an algorithm."""
    return vocab.ALGORITHM_ALIASES.get(name, name)


def algorithm_name_column(name: Column) -> Column:
    """`algorithm_name` for a column of names."""
    pairs = [F.lit(part) for pair in vocab.ALGORITHM_ALIASES.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)
