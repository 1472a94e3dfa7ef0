"""Case tables from CSV files, YAML configuration, and sinks."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from datetime import datetime
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SCHEMAS, CaseTables

OPTIONAL = ("consent",)


def read_csv(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """``root/name.csv`` or its gzipped form, columns by name; what the file lacks is null.

    A gzipped file is one partition, so it is dealt out again.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in (f"{root}/{name}.csv", f"{root}/{name}.csv.gz"):
        at = hadoop(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            break
    else:
        raise FileNotFoundError(f"neither {root}/{name}.csv nor {root}/{name}.csv.gz exists")
    raw = spark.read.csv(path, header=True)
    if path.endswith(".gz"):
        raw = raw.repartition(spark.sparkContext.defaultParallelism)
    wanted = [c.strip().split(" ") for c in (schema or SCHEMAS[name]).split(",")]
    cols = [F.expr(f"try_cast(`{c}` as {t})").alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in wanted]
    known = {c for c, _ in wanted}
    return raw.select(*cols, *[F.col(f"`{c}`") for c in raw.columns if c not in known])


def load_case(spark: SparkSession, root: str, period_start: datetime | None = None, period_end: datetime | None = None, user_id_col: str = "user_id") -> CaseTables:
    """All tables below ``root``; consent may be missing.  The window is given or that of all events."""
    found = {}
    for name in SCHEMAS:
        try:
            found[name] = read_csv(spark, root, name)
        except FileNotFoundError:
            if name not in OPTIONAL:
                raise
    for name in ("users", "api_events"):
        if user_id_col not in found[name].columns:
            raise KeyError(f"{name} has no column {user_id_col!r}")
    if period_start is None or period_end is None:
        first, last = found["api_events"].agg(F.min("timestamp"), F.max("timestamp")).first()
        period_start, period_end = period_start or first, period_end or last
    return CaseTables(**found, period_start=period_start, period_end=period_end, user_id_col=user_id_col)


def write_case(case: CaseTables, root: str, compress_events: bool = True) -> None:
    """Every table as a CSV folder of one file name each; events gzipped."""
    for name, table in case.tables().items():
        options = {"header": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
        if name == "api_events" and compress_events:
            options["compression"] = "gzip"
        table.write.mode("overwrite").options(**options).csv(f"{root}/{name}.csv")


def merged(base: Mapping, over: Mapping) -> dict:
    """Mappings merge deeply; anything else, lists too, is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load_yaml(path: str, _open: tuple[Path, ...] = ()) -> dict:
    """A YAML file over those it includes, whose paths are relative to it."""
    here = Path(path).resolve()
    if here in _open:
        raise ValueError(f"{here} includes itself")
    data = yaml.safe_load(here.read_text()) or {}
    if not isinstance(data, Mapping):
        raise TypeError(f"{here} is not a mapping")
    data = dict(data)
    include = data.pop("include", [])
    base: dict = {}
    for other in [include] if isinstance(include, str) else include:
        base = merged(base, load_yaml(str(here.parent / other), (*_open, here)))
    return merged(base, data)


def jsonable(value):
    """Numbers, arrays and mappings as JSON has them; NaN is null."""
    if isinstance(value, Mapping):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [jsonable(v) for v in value]
    if hasattr(value, "tolist"):
        return jsonable(value.tolist())
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value.isoformat() if isinstance(value, datetime) else value


def write_json(value, path: Path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(jsonable(value), indent=2, default=str))
