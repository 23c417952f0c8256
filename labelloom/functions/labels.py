"""Column expressions for ids, labels and capture contexts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import vocab


def sample_id(dataset: Column, relative_path: Column) -> Column:
    """First 16 hex digits of sha256(`dataset:relative_path`)."""
    return F.substring(F.sha2(F.concat_ws(":", dataset, relative_path), 256), 1, 16)


def label_key(label: Column) -> Column:
    """Trimmed, lower-case label with `-` and blank as `_`."""
    return F.translate(F.lower(F.trim(label)), "- ", "__")


def _key(text: str) -> str:
    return text.strip().lower().replace("-", "_").replace(" ", "_")


def _lookup(entries: Mapping[str, str], key: Column) -> Column:
    """Value of *key* in a small literal map, null when absent."""
    if not entries:
        return F.lit(None).cast("string")
    flat = [F.lit(part) for pair in sorted(entries.items()) for part in pair]
    return F.try_element_at(F.create_map(*flat), key)


def _aliases(dataset_name: str, overrides: Mapping[str, str] | None, align: bool) -> dict[str, str]:
    merged = dict(vocab.TREE_LABEL_ALIASES) if align else {}
    merged.update(vocab.DATASET_LABEL_ALIASES.get(dataset_name, {}))
    merged.update({_key(k): str(v) for k, v in (overrides or {}).items()})
    return merged


def normalize_label(
    raw: Column,
    dataset_name: str,
    *,
    label_aliases: Mapping[str, str] | None = None,
    canonical_labels: Sequence[str] | None = None,
    align_to_canonical: bool = False,
) -> Column:
    """Resolve a raw label: exact vocabulary, aliases, folded vocabulary, own key.

    An empty label is an error.
    """
    stripped = F.trim(raw)
    key = label_key(raw)
    canonical = list(canonical_labels or [])
    folded = {_key(name): name for name in sorted(canonical, reverse=True)}
    exact = F.when(stripped.isin(canonical), stripped) if canonical else F.lit(None).cast("string")
    resolved = F.coalesce(
        exact,
        _lookup(_aliases(dataset_name, label_aliases, align_to_canonical), key),
        _lookup(folded, key),
        key,
    )
    empty = raw.isNull() | (stripped == "")
    return F.when(empty, F.raise_error(F.lit("empty raw label")).cast("string")).otherwise(resolved)


def normalize_labels_by_dataset(
    raw: Column,
    dataset: Column,
    *,
    label_aliases: Mapping[str, str] | None = None,
    canonical_labels: Sequence[str] | None = None,
    align_to_canonical: bool = False,
) -> Column:
    """`normalize_label` for a table holding several datasets.

    A row without a dataset name follows the tree dataset's aliases.
    """
    options = {
        "label_aliases": label_aliases,
        "canonical_labels": canonical_labels,
        "align_to_canonical": align_to_canonical,
    }
    name = F.coalesce(F.nullif(dataset, F.lit("")), F.lit(vocab.TREE_DATASET))
    branch = None
    for known, aliases in vocab.DATASET_LABEL_ALIASES.items():
        if aliases:
            value = normalize_label(raw, known, **options)
            branch = F.when(name == known, value) if branch is None else branch.when(name == known, value)
    other = normalize_label(raw, "", **options)
    return other if branch is None else branch.otherwise(other)


def is_label_folder(name: Column) -> Column:
    """True for a numbered label folder such as `01_palm`."""
    return F.trim(name).rlike(vocab.LABEL_FOLDER_PATTERN)


def label_from_paths(relative_path: Column, image_path: Column) -> Column:
    """The numbered label folder in the relative path, else in the image path."""

    def found(path: Column) -> Column:
        text = F.translate(path, "\\", "/")
        return F.nullif(F.regexp_extract(text, vocab.LABEL_IN_PATH_PATTERN, 1), F.lit(""))

    return F.coalesce(found(relative_path), found(image_path))


def repaired_raw_label(dataset: Column, raw: Column, relative_path: Column, image_path: Column) -> Column:
    """Raw label of a tree row, recovered from its paths when it is no label token."""
    text = F.trim(raw)
    known = F.lower(text).isin(list(vocab.TREE_LABEL_ALIASES))
    token = text.rlike(vocab.LABEL_FOLDER_PATTERN) | known
    broken = ~token | text.rlike(vocab.SUBJECT_FOLDER_PATTERN)
    return F.when(
        (dataset == vocab.TREE_DATASET) & broken,
        F.coalesce(label_from_paths(relative_path, image_path), text),
    ).otherwise(text)


def parse_context(text: Column) -> Column:
    """Capture context from JSON; other non-empty text becomes `{raw: text}`."""
    parsed = F.from_json(text, "map<string,string>")
    empty = F.expr("cast(map() as map<string,string>)")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), empty)
        .when(parsed.isNotNull(), parsed)
        .otherwise(F.create_map(F.lit("raw"), text))
    )
