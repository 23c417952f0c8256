"""Expressions over predictions and probability vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import vocab


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(str(v)) for v in values]).cast("array<string>")


def prediction_confidence(
    probabilities: Column, predicted: Column, classes: Sequence[str] | None = None
) -> Column:
    """Probability of the predicted class, else the greatest one; null without any."""
    best = F.array_max(probabilities)
    if classes is None:
        return best
    position = F.array_position(_strings(classes), predicted.cast("string")).cast("int")
    own = F.try_element_at(probabilities, F.nullif(position, F.lit(0)))
    return F.coalesce(own, best)


def mask_unknown(predicted: Column, allowed: Sequence[str], other: str = vocab.UNKNOWN_LABEL) -> Column:
    """Predictions outside *allowed* as one bucket label."""
    return F.when(predicted.isin(list(allowed)), predicted).otherwise(F.lit(other))


def restricted_argmax(probabilities: Column, classes: Sequence[str], allowed: Sequence[str]) -> Column:
    """Class with the greatest probability among *allowed*, the first one on ties."""
    wanted = set(map(str, allowed))
    indices = [i for i, name in enumerate(classes) if str(name) in wanted]
    if not indices:
        raise ValueError("no allowed label among the classes of the model")
    names = _strings([classes[i] for i in indices])
    scores = F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.get(probabilities, i))
    choice = F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))
    error = F.raise_error(F.lit(f"expected {len(classes)} probabilities")).cast("string")
    return F.when(F.size(probabilities) == len(classes), choice).otherwise(error)


def deployment_recommendation(retention: Column, absolute_drop: Column, compatible: Column) -> Column:
    """Short recommendation code from retention and drop."""
    return (
        F.when(~compatible, F.lit("resolve_mismatch"))
        .when((retention >= 0.85) & (absolute_drop <= 0.10), F.lit("deploy_and_monitor"))
        .when(retention >= 0.70, F.lit("deploy_with_caution"))
        .otherwise(F.lit("do_not_deploy"))
    )


# Texts that go with the codes of `deployment_recommendation`.
RECOMMENDATION_TEXT = {
    "resolve_mismatch": "Schema or labels of the two domains differ; resolve this before deploying.",
    "deploy_and_monitor": "Retention across domains is acceptable; deploy and monitor failing classes.",
    "deploy_with_caution": "Moderate shift; add thresholds and debouncing and work on the worst classes.",
    "do_not_deploy": "Large loss of accuracy; mitigate (retrain, adapt or restrict classes) first.",
}
