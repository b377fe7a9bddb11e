"""Settings: defaults, merged with what a caller gives and checked."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

#: Defaults of both analysers. Fixed values.
FORMAT = {
    "feature_extractor": {
        "left_siblings_window": 5, "right_siblings_window": 5, "parents_depth": 2, "no_labels_on_right": True, "select_features_number": 500, "cutoff_label_support": 80,
        "node_features": ["start_line", "start_col"], "left_features": ["length", "diff_offset", "diff_col", "diff_line", "internal_type", "label", "reserved", "roles"],
        "right_features": ["length", "internal_type", "reserved", "roles"], "parent_features": ["internal_type", "roles"],
    },
    "trainable_rules": {"prune_branches_algorithms": ["reduced-error"], "top_down_greedy_budget": [False, 0.5], "prune_attributes": True, "attribute_similarity_threshold": 0.98, "confidence_threshold": 0.8, "prune_dataset_ratio": 0.2, "n_estimators": 10},
    "line_length_limit": 500, "lower_bound_instances": 500, "overall_size_limit": 5 << 20, "lines_ratio_train_trigger": 0.2, "confidence_threshold": 0.92, "support_threshold": 80,
}
TYPOS = {
    "neighbors_number": 0, "edit_dist_number": 16, "max_distance": 2, "radius": 3, "n_candidates": 3, "confidence_threshold": 0.2, "train_rounds": 40, "depth": 5, "line_length_limit": 500, "overall_size_limit": 5 << 20,
}


def merged(base: Mapping[str, Any], own: Mapping[str, Any] | None) -> dict[str, Any]:
    """Both settings, deeply; the second one's values win. Neither is changed."""
    out = dict(base)
    for key, value in (own or {}).items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def checked(base: Mapping[str, Any], own: Mapping[str, Any] | None, at: str = "") -> dict[str, Any]:
    """merged(), but a name that the base lacks, or a value of another kind, is an error."""
    for key, value in (own or {}).items():
        if key not in base:
            raise ValueError(f"unknown setting {at}{key}")
        if isinstance(base[key], Mapping):
            checked(base[key], value, f"{at}{key}.")
        elif not isinstance(value, type(base[key])) and not (isinstance(base[key], float) and isinstance(value, int)):
            raise ValueError(f"setting {at}{key} takes {type(base[key]).__name__}, not {value!r}")
    return merged(base, own)


def by_language(settings: Mapping[str, Any], languages: list[str]) -> dict[str, dict[str, Any]]:
    """A language's settings: those for all under "global", and its own, which win."""
    return {name: merged(settings.get("global", {}), settings.get(name)) for name in languages}
