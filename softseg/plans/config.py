"""Configuration of a run: sections with defaults, and nothing else."""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy

from softseg.operators import compliance, fuzzify, rules
from softseg.operators.indicators import DAYS_PER_MONTH
from softseg.sources.files import load_yaml, merged

DEFAULTS: dict[str, dict] = {
    "data": {"root": "data/sample", "user_id_col": "user_id", "period_start": None, "period_end": None},
    "compliance": {"direct_identifiers": list(compliance.DIRECT_IDENTIFIERS), "content_columns": list(compliance.CONTENT_COLUMNS), "age_bins": [18, 25, 35, 45, 55, 65, 100], "min_group_size": compliance.MIN_GROUP, "require_consent": True, "pseudonymise": True, "pseudonym_salt": "salt"},
    "indicators": {"working_hours": {"a": 6, "b": 8, "c": 16, "d": 18}, "days_per_month": DAYS_PER_MONTH},
    "fuzzification": {"default_normalisation": "log_minmax", "features": list(fuzzify.DEFAULT_FEATURES), "alpha_levels": list(fuzzify.ALPHA_LEVELS), "shift_patterns": fuzzify.SHIFT_WINDOWS, "shift_pattern_column": "shift_pattern"},
    "rules": {"enabled": False, "rules": list(rules.DEFAULT_RULES), "context_terms": rules.CONTEXT_TERMS},
    "reduction": {"enabled": True, "n_components": 0.9, "max_components": 20, "standardise_before_pca": False, "scaling": "none", "clustering_space": "pca"},
    "clustering": {"method": "fcm", "k": 4, "k_min": 2, "k_max": 10, "m": 2.0, "eta": 2.0, "a": 1.0, "b": 1.0, "pfcm_gamma_scale": 1.0, "max_iter": 300, "tol": 1e-5, "n_restarts": 30, "seed": 1, "compare_methods": ["fcm", "pfcm", "gk", "kmeans", "ahc"]},
    "evaluation": {"fsi_alpha": 1.0, "max_silhouette_samples": 5000, "stability_runs": 10, "expert_ratings_file": None, "interpretability_weights": {}},
    "output": {"root": "outputs", "run_name": "run"},
}
#: Lists whose entries are mappings of their own, which are taken as they are.
_FREE = {("fuzzification", "shift_patterns"), ("rules", "context_terms"), ("evaluation", "interpretability_weights"), ("indicators", "working_hours")}


def config(given: Mapping | None = None) -> dict[str, dict]:
    """Defaults with what is given over them; unknown names are errors."""
    out = deepcopy(DEFAULTS)
    for section, values in (given or {}).items():
        if section not in out:
            raise KeyError(f"unknown section {section!r}")
        if not isinstance(values, Mapping):
            raise TypeError(f"section {section!r} is not a mapping")
        for k, v in values.items():
            if k not in out[section]:
                raise KeyError(f"unknown key {section}.{k}")
            out[section][k] = deepcopy(v) if (section, k) in _FREE or not isinstance(v, Mapping) else merged(out[section][k] or {}, v)
    return out


def from_yaml(path: str) -> dict[str, dict]:
    return config(load_yaml(path))
