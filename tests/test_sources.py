import json

import pytest
from pyspark.sql import functions as F

from softseg.operators import clustering
from softseg.plans import cli, config, figures, segmentation
from softseg.sources import files, sample
from softseg.sources.schema import EVENT_TYPES, SCHEMAS
from softseg.streaming import daily


@pytest.fixture(scope="module")
def case(spark):
    made, truth = sample.generate(spark, sample.Options(150, 21, 3))
    return made.changed(**{n: t.cache() for n, t in made.tables().items()}), truth.cache()


def test_generated_tables_hold_together(case):
    made, truth = case
    t = made.tables()
    assert t["users"].count() == truth.count() == 150 and set(t) == set(SCHEMAS)
    assert t["api_events"].join(t["users"], "user_id", "left_anti").count() == 0
    assert {r[0] for r in t["api_events"].select("event_type").distinct().collect()} <= set(EVENT_TYPES)
    posts = t["posts"]
    assert posts.count() == t["api_events"].filter("event_type = 'post.created'").count() == posts.select("post_id").distinct().count()
    for name in ("comments", "reactions"):
        assert t[name].count() > 0 and t[name].join(posts, "post_id", "left_anti").count() == 0
    counted = t["comments"].groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))
    assert posts.join(counted, "post_id", "left").filter("comment_count <> coalesce(n, 0)").count() == 0
    assert "text" not in {c for x in t.values() for c in x.columns}
    assert made.api_events.filter((F.col("timestamp") < F.lit(made.period_start)) | (F.col("timestamp") > F.lit(made.period_end))).count() == 0


def test_same_seed_same_tables(spark, case):
    again, _ = sample.generate(spark, sample.Options(150, 21, 3))
    assert again.api_events.repartition(3).exceptAll(case[0].api_events).count() == 0


def test_csv_round_trip(spark, case, tmp_path):
    files.write_case(case[0], str(tmp_path))
    back = files.load_case(spark, str(tmp_path))
    assert {n: t.count() for n, t in back.tables().items()} == {n: t.count() for n, t in case[0].tables().items()}
    assert back.users.schema["age"].dataType.simpleString() == "int" and back.period_start is not None
    with pytest.raises(FileNotFoundError, match="csv.gz"):
        files.read_csv(spark, str(tmp_path), "missing", "a int")


def test_yaml_includes(tmp_path):
    (tmp_path / "base.yaml").write_text("clustering: {k: 3, compare_methods: [fcm]}\nrules: {enabled: true}\n")
    (tmp_path / "run.yaml").write_text("include: base.yaml\nclustering: {m: 1.5, compare_methods: [gk]}\n")
    got = config.from_yaml(str(tmp_path / "run.yaml"))
    assert (got["clustering"]["k"], got["clustering"]["m"], got["clustering"]["compare_methods"], got["rules"]["enabled"]) == (3, 1.5, ["gk"], True)
    (tmp_path / "loop.yaml").write_text("include: loop.yaml\n")
    with pytest.raises(ValueError):
        files.load_yaml(str(tmp_path / "loop.yaml"))
    with pytest.raises(KeyError):
        config.config({"clustering": {"other": 1}})
    with pytest.raises(TypeError):
        config.config({"clustering": 3})


def test_daily_stream_equals_batch(spark, case, tmp_path):
    case[0].api_events.drop("object_type", "object_id").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    query = daily.write_daily(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    closed = batch.agg(F.max("timestamp")).first()[0].date()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    want = daily.daily_counts(batch).filter(F.col("day") < F.date_sub(F.lit(closed), 1))
    assert want.count() > 0 and want.exceptAll(streamed).count() == 0
    assert daily.roll_up(spark, str(tmp_path / "out")).count() > 0


def test_whole_run(spark, case, tmp_path):
    made, truth = case
    settings = {"clustering": {"n_restarts": 2, "max_iter": 6, "k_min": 3, "k_max": 4, "compare_methods": ["fcm", "kmeans"]}, "evaluation": {"stability_runs": 2}, "compliance": {"min_group_size": 5}, "rules": {"enabled": True}}
    result = segmentation.run(made, settings)
    assert result.model.k == 4 and result.figures["compliance_report"]["violations"] == []
    n = result.frames["user_memberships"].count()
    assert n == made.consent.filter("consent = 1").count() and all(r[0].startswith("p") for r in result.frames["user_memberships"].select("user_id").take(3))
    assert {r["method"] for r in result.figures["method_comparison"]} == {"fcm", "kmeans"} and len(result.figures["k_selection_metrics"]) == 2
    segmentation.write(result, str(tmp_path / "run"))
    assert "## Clusters" in (tmp_path / "run" / "report.md").read_text()
    assert json.loads((tmp_path / "run" / "clustering_result.json").read_text())["k"] == 4
    assert spark.read.parquet(str(tmp_path / "run" / "user_fuzzy_vectors")).count() == n
    grid = figures.contour_grid(result.frames["user_principal_components"], result.model.centers[:, :2], side=10)
    assert grid.count() == 100 and figures.scatter(result.model.assign(result.frames["user_principal_components"]), 50).count() == 50
    assert figures.heatmap(result.model.assign(result.frames["user_principal_components"]), 20).count() == 20
    assert isinstance(result.model, clustering.Clusters) and truth.count() == 150


def test_command_line(spark, tmp_path, capsys):
    cli.main(["describe"])
    assert "IF accessible_streams is small THEN" in capsys.readouterr().out
    cli.main(["plot-data", "--out", str(tmp_path)])
    assert spark.read.csv(str(tmp_path / "shift_patterns"), header=True).count() == 6 * 481
    spark.createDataFrame([("a", "{x: 1}")], "actor_id string, event_type_counts string").write.csv(str(tmp_path / "cells"), header=True)
    cli.main(["unpack-events", "--input", str(tmp_path / "cells"), "--out", str(tmp_path / "wide")])
    assert spark.read.csv(str(tmp_path / "wide"), header=True).columns == ["actor_id", "x"]
