"""The whole run: case tables to clusters, profiles and reports.

Tables of users stay in Spark; each step writes its result to the shared folder,
so later steps have short plans.  What the driver holds is models, group figures
and reports.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softseg.operators import clustering, compliance, fuzzify, heuristics, indicators, profiles, reduce, rules, scale, validity
from softseg.operators.clustering import Clusters
from softseg.operators.vectors import totals, vector_frame
from softseg.sources.files import jsonable, write_json
from softseg.sources.schema import CaseTables
from softseg.sources.store import materialise

from .config import config as make_config


@dataclass
class Result:
    """Frames by artefact name, group figures by name, and the fitted models."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    figures: dict[str, object] = field(default_factory=dict)
    model: Clusters | None = None
    pca: reduce.Components | None = None
    timings: dict[str, float] = field(default_factory=dict)


def _options(cfg: dict, method: str) -> dict:
    c = cfg["clustering"]
    common = {"m": c["m"], "max_iter": c["max_iter"], "tol": c["tol"]}
    return {"fcm": common, "gk": common, "pfcm": {**common, "eta": c["eta"], "a": c["a"], "b": c["b"], "scale": c["pfcm_gamma_scale"]}, "kmeans": {"max_iter": c["max_iter"]}, "ahc": {}}[method]


def profile_z(frame: DataFrame, columns: list[str]) -> np.ndarray:
    """z-scores of the clusters' weighted means, by the population's deviation."""
    rows = frame.select(F.concat(F.array(*[F.col(c).cast("double") for c in columns]), "u").alias("x"))
    d, k = len(columns), frame.select(F.size("u")).first()[0]
    t = totals(rows, lambda b: np.concatenate([[len(b)], b[:, :d].sum(0), (b[:, :d] ** 2).sum(0), b[:, d:].sum(0), (b[:, d:].T @ b[:, :d]).ravel()]), 1 + 2 * d + k + k * d)
    n, mean = t[0], t[1 : 1 + d] / t[0]
    spread = np.sqrt(np.maximum(t[1 + d : 1 + 2 * d] / n - mean**2, 0))
    centers = t[1 + 2 * d + k :].reshape(k, d) / np.maximum(t[1 + 2 * d : 1 + 2 * d + k], 1e-12)[:, None]
    return (centers - mean) / np.where(spread > 1e-12, spread, 1.0)


def evaluate(model: Clusters, rows: DataFrame, runs: list[Clusters], values: DataFrame, columns: list[str], cfg: dict, violations: list[str], ratings: float | None = None) -> dict:
    """Separation, stability, interpretability and privacy of one fitted method."""
    frame = materialise(model.assign(rows), "assigned")
    e = cfg["evaluation"]
    # The queries are a bounded sample, a documented setting; each is compared with all rows.
    asked = validity.sample(frame, e["max_silhouette_samples"], cfg["clustering"]["seed"])
    out: dict = {"method": model.method, "separation": validity.separation(frame, model.fuzzy, asked=asked)}
    if model.method == "ahc":
        out["stability"] = validity.subsample_stability(rows, lambda r, s: clustering.ward(r, model.k, seed=s), min(3, e["stability_runs"]))
    else:
        out["stability"] = validity.stability(rows, runs[: e["stability_runs"]])
    entropy = validity.classification_entropy(frame).first()["normalised_entropy"]
    z = profile_z(frame.select("id", "u").join(values.withColumnRenamed(values.columns[0], "id"), "id"), columns)
    parts = {"clarity": profiles.dominance_clarity(z), "transparency": profiles.transparency(entropy, model.fuzzy), "consistency": ratings}
    out["interpretability"] = profiles.interpretability(parts, e["interpretability_weights"])
    sizes = [r["count"] for r in frame.groupBy("label").count().collect()]
    out["privacy"] = profiles.privacy(model.fuzzy, sizes, violations, cfg["compliance"]["min_group_size"])
    if model.fuzzy:
        out |= {"partition_coefficient": validity.partition_coefficient(frame).first()[0], "classification_entropy": validity.classification_entropy(frame).first()[0], "xie_beni": validity.xie_beni(frame, model.centers, model.m).first()[0] if model.method != "gk" else None}
    return out


def run(case: CaseTables, given: dict | None = None, compare: bool = True, select_k: bool = True, ratings: DataFrame | None = None) -> Result:
    """Every step on ``case``; the tables are read, never changed."""
    cfg, out = make_config(given), Result()
    began = time.time()

    def done(step: str) -> None:
        nonlocal began
        out.timings[step], began = time.time() - began, time.time()

    comp, key = cfg["compliance"], case.user_id_col
    period = indicators.Period.of(case.api_events, case.period_start, case.period_end)
    period = indicators.Period(period.start, period.end, cfg["indicators"]["days_per_month"])
    case, coverage = compliance.apply_consent(case, comp["require_consent"])
    if comp["pseudonymise"]:
        case = compliance.pseudonymise(case, comp["pseudonym_salt"])
    case, dropped = compliance.drop_content(case, comp["content_columns"])
    users, identifiers = compliance.drop_columns(case.users, comp["direct_identifiers"])
    case = case.changed(users=users)
    demographics = compliance.generalise_demographics(users, comp["age_bins"], key)
    done("compliance")

    w = cfg["indicators"]["working_hours"]
    base = indicators.indicators(case.api_events, case.users, period, key, work_from=float(w["b"]), work_to=float(w["c"]))
    base = materialise(base, "indicators")
    heuristic = materialise(heuristics.heuristic_attributes(case), "heuristics")
    demographics = materialise(demographics, "demographics")
    frame = materialise(base.join(demographics, key, "left").join(heuristic, key, "left"), "users")
    out.frames |= {"user_indicators": base, "indicator_summary": indicators.summary(base.select(key, *indicators.SCALARS)), "user_heuristic_attributes": heuristic, "user_compliant_demographics": demographics}
    done("indicators")

    fz = cfg["fuzzification"]
    engine = fuzzify.Fuzzifier(fz["features"], fz["default_normalisation"], fz["shift_patterns"], fz["alpha_levels"], comp["min_group_size"])
    layer = rules.RuleLayer(cfg["rules"]["rules"], cfg["rules"]["context_terms"], cfg["rules"]["enabled"])
    effect = layer.apply(frame, [f.name for f in engine.features])
    changed = frame.select(*[effect.indicators.get(c, F.col(c)).alias(c) for c in frame.columns])
    pattern = F.col(fz["shift_pattern_column"]) if fz["shift_pattern_column"] in frame.columns else None
    if effect.shift_pattern is not None:
        pattern = effect.shift_pattern if pattern is None else F.coalesce(effect.shift_pattern, pattern)
    fuzzy = materialise(engine.fit(changed).transform(changed, key, pattern), "fuzzy")
    weights = frame.select(key, *[c.alias(f"_{n}") for n, c in effect.weights.items()])
    weighted = fuzzy.join(weights, key).select(key, *[(F.col(a) * F.col(f"_{a.split('__')[0]}")).alias(a) for a in engine.columns])
    strengths = frame.select(key, *[s.alias(n) for n, s in effect.strengths.items()])
    out.frames |= {"user_fuzzy_vectors": fuzzy, "rule_firing_strengths": strengths, "alpha_cut_segments": fuzzify.alpha_report(fuzzy, engine.columns, engine.levels, engine.minimum), "segment_stability": fuzzify.segment_stability(fuzzy, engine.columns)}
    report = compliance.assess(engine.columns, coverage, compliance.demographic_group_sizes(demographics))
    out.figures |= {"membership_functions": engine.describe(), "fuzzy_rules": layer.describe(), "compliance_report": {"violations": report.violations, "coverage": report.coverage, "smallest_group": report.smallest_group, "level": report.level, "dropped_identifiers": identifiers, "dropped_content": dropped}}
    done("fuzzification")

    red = cfg["reduction"]
    vectors = materialise(vector_frame(scale.scale(weighted, engine.columns, red["scaling"]), engine.columns, key), "vectors")
    rows = vectors
    if red["enabled"] and red["clustering_space"] == "pca":
        out.pca = reduce.fit_pca(vectors, red["n_components"], red["max_components"], red["standardise_before_pca"], tuple(engine.columns))
        rows = materialise(out.pca.transform(vectors, "pc").select("id", F.col("pc").alias("x")), "components")
        out.frames["user_principal_components"] = rows
        out.figures |= {"pca_explained_variance": out.pca.variance_table(), "pca_loadings": out.pca.loadings()}
    done("reduction")

    c = cfg["clustering"]
    k = c["k"]
    if select_k or k is None:
        metrics = validity.k_metrics(rows, range(c["k_min"], c["k_max"] + 1), min(5, c["n_restarts"]), c["m"], c["seed"], c["max_iter"], c["tol"], validity.sample(rows, cfg["evaluation"]["max_silhouette_samples"], c["seed"]))
        out.figures |= {"k_selection_metrics": metrics, "k_selection_suggestions": validity.suggest_k(metrics)}
        k = k or out.figures["k_selection_suggestions"]["recommended"]
    done("k selection")
    seeds = range(c["seed"], c["seed"] + c["n_restarts"])
    best, runs = clustering.with_restarts(c["method"], rows, k, seeds, **_options(cfg, c["method"]))
    out.model = best
    assigned = materialise(best.assign(rows), "memberships")
    out.frames["user_memberships"] = assigned.select(F.col("id").alias(key), "u", "label")
    if best.method == "pfcm":
        out.frames["user_typicalities"] = clustering.typicality_frame(best, rows)
    done("clustering")

    labelled = materialise(assigned.select(F.col("id").alias(key), "u", "label").join(frame, key), "labelled")
    averages = profiles.feature_averages(labelled)
    means = {r["cluster"]: r.asDict() for r in averages.collect()}
    out.figures["cluster_archetypes"] = profiles.label_archetypes(means)
    out.frames |= {
        "cluster_feature_averages": averages,
        "cluster_feature_averages_membership_weighted": profiles.feature_averages(labelled, weighted=True),
        "cluster_distribution": profiles.membership_distribution(assigned),
        "cluster_dominant_attributes": profiles.dominant_attributes(fuzzy.join(assigned.select(F.col("id").alias(key), "u"), key), engine.columns),
        "cluster_pairwise_overlap": profiles.pairwise_overlap(assigned),
        "cluster_overlap_summary": profiles.overlap_summary(assigned),
    }
    done("profiles")
    if compare:
        numeric = [n for n in (*indicators.SCALARS, "hierarchy_score", "group_memberships", "accessible_streams", "broadcast_stream_share", "posts_authored", "engaging_posts_authored", "post_interactions") if n in frame.columns]
        full = materialise(vector_frame(scale.full_resolution(frame.select(key, *numeric), numeric), numeric, key), "full")
        table = []
        for method in c["compare_methods"]:
            space = full if method in ("kmeans", "ahc") else rows
            fitted, all_runs = (best, runs) if method == best.method else clustering.with_restarts(method, space, k, list(seeds)[: cfg["evaluation"]["stability_runs"]], **_options(cfg, method))
            table.append(evaluate(fitted, space, all_runs, frame.select(key, *numeric) if space is full else fuzzy, numeric if space is full else engine.columns, cfg, report.violations, profiles.semantic_consistency(ratings)))
        out.figures["method_comparison"] = table
        done("comparison")
    return out


def write(result: Result, root: str, fmt: str = "parquet") -> None:
    """Frames as tables below ``root``, figures as JSON, and a report."""
    for name, frame in result.frames.items():
        flat = frame if fmt == "parquet" else frame.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in frame.dtypes])
        flat.write.mode("overwrite").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(f"{root}/{name}")
    for name, value in {**result.figures, "timings": result.timings}.items():
        write_json(value, Path(root) / f"{name}.json")
    m = result.model
    write_json(jsonable({"method": m.method, "k": m.k, "centers": m.centers, "objective": m.objective, "iterations": m.iterations, "converged": m.converged, "seed": m.seed}), Path(root) / "clustering_result.json")
    (Path(root) / "report.md").write_text(report(result))


def report(result: Result) -> str:
    """Group figures in Markdown; no row of a user is in it."""
    names = result.figures["cluster_archetypes"]
    lines = ["# Segmentation report", "", f"Method {result.model.method}, {result.model.k} clusters.", "", "## Clusters", ""]
    for r in sorted(result.frames["cluster_distribution"].collect(), key=lambda r: r["cluster"]):
        lines.append(f"- {names.get(r['cluster'], ('Segment', 0))[0]}: {r['size']} users, {100 * r['share']:.1f} %, mass {r['mass']:.1f}")
    lines += ["", "## Mean indicators", ""]
    for r in sorted(result.frames["cluster_feature_averages"].collect(), key=lambda r: r["cluster"]):
        said = (f"{c} {100 * r[c]:.1f} %" if "share" in c else f"{c} {r[c]:.2f}" for c in profiles.PROFILE_INDICATORS)
        lines.append(f"- {names[r['cluster']][0]}: {', '.join(said)}")
    lines += ["", "## Alpha-cuts", ""]
    for r in result.frames["alpha_cut_segments"].filter("attribute like '%\\\\_\\\\_high'").orderBy("attribute", "alpha").collect():
        lines.append(f"- {r['attribute']} at {r['alpha']}: " + (f"{r['size']} users, {100 * r['share']:.1f} %" if r["reportable"] else "too few users to report"))
    for r in result.figures.get("method_comparison", ()):
        lines.append(f"- {r['method']}: separation {r['separation']:.2f}, interpretability {r['interpretability']:.2f}, privacy {r['privacy']}")
    return "\n".join(lines) + "\n"
