"""Fuzzy rules: IF context attributes are in terms, THEN weights, indicators or shift windows change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softseg.functions.membership import membership

from .quantiles import exact_quantiles

# Terms of the context attributes, and the default rules.
CONTEXT_TERMS = {
    "hierarchy_score": {"low": {"family": "sigmoidal", "params": [-1.5, 3.0]}, "high": {"family": "sigmoidal", "params": [1.5, 6.0]}},
    "broadcast_stream_share": {"low": {"family": "trapezoidal", "params": [0.0, 0.0, 0.3, 0.5]}, "high": {"family": "trapezoidal", "params": [0.45, 0.65, 1.0, 1.0]}},
    "accessible_streams": {"small": {"family": "trapezoidal", "params": [0, 0, 4, 8]}, "large": {"family": "trapezoidal", "params": [6, 10, 1000, 1000]}},
}
DEFAULT_RULES = (
    {"name": "top_down_communication", "if": [{"attribute": "hierarchy_score", "is": "low"}, {"attribute": "broadcast_stream_share", "is": "high"}], "operator": "and",
     "then": [{"action": "scale_weight", "features": ["posting", "commenting"], "factor": 0.5}, {"action": "scale_weight", "features": ["reactions"], "factor": 1.5}]},
    {"name": "opportunity_to_interact", "if": [{"attribute": "accessible_streams", "is": "small"}],
     "then": [{"action": "relative_indicator", "indicators": ["topic_accesses_per_month", "reactions_per_month", "comments_per_month"], "denominator": "accessible_streams"}]},
    {"name": "operational_rhythm", "if": [{"attribute": "employee_category", "equals": "shift-based"}], "then": [{"action": "set_shift_pattern", "from_column": "shift_pattern"}]},
)
SHIFT_THRESHOLD = 0.5
_ACTIONS = ("scale_weight", "relative_indicator", "set_shift_pattern")


@dataclass
class Effect:
    """What the rules do, as expressions over the joined frame."""

    strengths: dict[str, Column] = field(default_factory=dict)
    weights: dict[str, Column] = field(default_factory=dict)
    indicators: dict[str, Column] = field(default_factory=dict)
    shift_pattern: Column | None = None

    def weight_of(self, attribute: str) -> Column:
        """Weight of a fuzzy attribute: that of its feature."""
        return self.weights.get(attribute.split("__")[0], F.lit(1.0))

    def weighted(self, attributes: Sequence[str]) -> list[Column]:
        return [(F.col(a) * self.weight_of(a)).alias(a) for a in attributes]


class RuleLayer:
    def __init__(self, rules: Sequence[Mapping] = DEFAULT_RULES, context_terms: Mapping = CONTEXT_TERMS, enabled: bool = True) -> None:
        self.rules, self.enabled = list(rules), enabled
        self.terms = {a: {t: membership(m) for t, m in terms.items()} for a, terms in context_terms.items()}
        for rule in self.rules:
            if rule.get("operator", "and") not in ("and", "or") or not rule.get("if"):
                raise ValueError(f"rule {rule.get('name')!r} needs antecedents joined by 'and' or 'or'")
            for then in rule["then"]:
                if then["action"] not in _ACTIONS:
                    raise ValueError(f"unknown action {then['action']!r}")

    def degree(self, part: Mapping, columns: Sequence[str]) -> Column:
        name = part["attribute"]
        if name not in columns:
            raise KeyError(f"no context attribute {name!r}")
        if "equals" in part:
            out = F.when(F.col(name) == part["equals"], 1.0).otherwise(0.0)
        else:
            shape = self.terms[name][part["is"]]
            out = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(shape.of(F.col(name)), F.lit(0.0))))
        return F.lit(1.0) - out if part.get("not") else out

    def strength(self, rule: Mapping, columns: Sequence[str]) -> Column:
        parts = [self.degree(p, columns) for p in rule["if"]]
        if len(parts) == 1:
            return parts[0]
        return (F.greatest if rule.get("operator") == "or" else F.least)(*parts)

    def apply(self, frame: DataFrame, features: Sequence[str]) -> Effect:
        """Rules one after another; ``frame`` has the indicators and the context of every user.

        The only job is one aggregation for the medians of denominators.
        """
        one, out = F.lit(1.0), Effect(weights={f: F.lit(1.0) for f in features})
        if not self.enabled:
            out.strengths = {r["name"]: F.lit(0.0) for r in self.rules}
            return out
        below = sorted({t["denominator"] for r in self.rules for t in r["then"] if t["action"] == "relative_indicator"})
        found = exact_quantiles(frame, {d: F.when(F.col(d) > 0, F.col(d).cast("double")) for d in below}, (0.5,))
        medians = {d: q for d, (q,) in found.items()}
        for rule in self.rules:
            s = self.strength(rule, frame.columns)
            out.strengths[rule["name"]] = s
            for then in rule["then"]:
                if then["action"] == "scale_weight":
                    for f in then["features"]:
                        if f not in out.weights:
                            raise KeyError(f"no fuzzy variable {f!r}")
                        out.weights[f] = out.weights[f] * (one + s * F.lit(float(then["factor"]) - 1.0))
                elif then["action"] == "relative_indicator":
                    d = F.col(then["denominator"]).cast("double")
                    ratio = F.coalesce(F.when(d > 0, F.lit(medians[then["denominator"]]) / d), one)
                    for i in then["indicators"]:
                        x = out.indicators.get(i, F.col(i))
                        out.indicators[i] = (one - s) * x + s * x * ratio
                else:
                    value = F.col(then["from_column"]) if "from_column" in then else F.lit(then["pattern"])
                    chosen = F.when(s >= then.get("threshold", SHIFT_THRESHOLD), value)
                    out.shift_pattern = chosen if out.shift_pattern is None else F.coalesce(chosen, out.shift_pattern)
        return out

    def describe(self) -> list[str]:
        """Rules as sentences."""
        said = lambda p: f"{p['attribute']} {'== ' + str(p['equals']) if 'equals' in p else ('is not ' if p.get('not') else 'is ') + p['is']}"
        ends = lambda t: f"{t['action']}({', '.join(f'{k}={v}' for k, v in t.items() if k != 'action')})"
        return [f"IF {f' {r.get('operator', 'and').upper()} '.join(map(said, r['if']))} THEN {'; '.join(map(ends, r['then']))}" for r in self.rules]
