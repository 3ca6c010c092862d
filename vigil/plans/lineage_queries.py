"""Lineage queries over stand-in tables derived from the given tables.

Stand-ins (deterministic; every row of the source table becomes a lineage row):
  runs            one per order: run_id = 'run-<o_orderkey>', started = o_orderdate,
                  accuracy = o_totalprice / (o_totalprice + 50000)
  model_versions  the runs that pass the gate, numbered by (started, run_id)
  model_aliases   every registered version promoted at its run's start time
  metric_history  one per event: metric from event_type, value = value / (value + 50)
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.plans import lineage
from vigil.plans.catalog import register, rounded
from vigil.sources import tables

# Fixed stand-in mapping of event types onto the five monitoring gauges.
GAUGE_OF_EVENT = {
    "view": "model_accuracy",
    "click": "drift_score",
    "error": "semantic_drift_ks",
    "purchase": "centroid_drift",
    "signup": "spread_drift",
}
ALERT_THRESHOLD = 0.5


def runs(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return o.select(
        F.format_string("run-%d", F.col("o_orderkey")).alias("run_id"),
        F.col("o_orderdate").alias("started"),
        (F.col("o_totalprice") / (F.col("o_totalprice") + F.lit(50000.0))).alias("accuracy"),
    )


def run_metrics(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.select(F.col("started").alias("ts"), "run_id", F.lit("test_accuracy_score").alias("metric"),
                    F.col("accuracy").alias("value"))


def versions(spark, sf_dir):
    return lineage.register_passing(runs(spark, sf_dir))


def alias_events(v):
    """Every registered version promoted at its run's start time (no join: the version
    rows carry the start time)."""
    return v.select("name", F.lit(lineage.PROD_ALIAS).alias("alias"), "version", F.col("started").alias("ts"))


def metric_history(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    gauge = F.create_map(*[x for k, v in GAUGE_OF_EVENT.items() for x in (F.lit(k), F.lit(v))])
    return e.select(
        "ts",
        F.format_string("user-%d", F.col("user_id")).alias("run_id"),
        F.col("event_id").alias("batch_id"),
        gauge[F.col("event_type")].alias("metric"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("value"),
    )


_RUNS = """runs AS (SELECT 'run-' || o_orderkey AS run_id, o_orderdate AS started,
                 o_totalprice / (o_totalprice + 50000.0) AS accuracy FROM orders)"""
_VERS = """vers AS (SELECT 'sentiment-classifier' AS name,
                 CAST(row_number() OVER (ORDER BY started, run_id) AS INTEGER) AS version,
                 run_id, started, accuracy FROM runs WHERE accuracy > 0.8)"""
_HIST = """hist AS (SELECT ts, 'user-' || user_id AS run_id, event_id AS batch_id,
       CASE event_type WHEN 'view' THEN 'model_accuracy' WHEN 'click' THEN 'drift_score'
            WHEN 'error' THEN 'semantic_drift_ks' WHEN 'purchase' THEN 'centroid_drift'
            WHEN 'signup' THEN 'spread_drift' END AS metric,
       value / (value + 50.0) AS value FROM events)"""
_STAMP = "strftime(started + INTERVAL 7 HOUR, '%Y%m%d_%H%M%S')"


@register(
    "gate_register",
    f"""WITH {_RUNS}, {_VERS}
SELECT name, version, run_id, 'runs:/' || run_id || '/sentiment-model' AS path, round(accuracy, 6) AS accuracy,
       'sentiment_model_v' || version || '_' || {_STAMP} AS run_name FROM vers""",
)
def q_gate_register(spark, sf_dir):
    v = lineage.register_passing(runs(spark, sf_dir))
    return rounded(
        v.select(
            "name", "version", "run_id", "path", "accuracy",
            lineage.run_name(F.col("version"), lineage.local_stamp(v, "started")).alias("run_name"),
        )
    )


@register("next_version", f"WITH {_RUNS} SELECT count(*) + 1 AS next_version FROM runs")
def q_next_version(spark, sf_dir):
    return lineage.next_version(runs(spark, sf_dir))


@register(
    "latest_candidate",
    f"""WITH {_RUNS}, {_VERS}
SELECT name, max(version) AS version, arg_max(run_id, version) AS run_id, round(arg_max(accuracy, version), 6) AS accuracy
FROM vers GROUP BY name""",
)
def q_latest_candidate(spark, sf_dir):
    return rounded(lineage.latest_versions(versions(spark, sf_dir)))


@register(
    "current_alias",
    f"""WITH {_RUNS}, {_VERS}
SELECT name, 'prod' AS alias, arg_max(version, (started, version)) AS version FROM vers GROUP BY name""",
)
def q_current_alias(spark, sf_dir):
    return lineage.current_alias(alias_events(versions(spark, sf_dir)))


@register(
    "champion_lookup",
    f"""WITH {_RUNS}, {_VERS},
cur AS (SELECT name, arg_max(version, (started, version)) AS version FROM vers GROUP BY name)
SELECT cur.name, cur.version, coalesce(v.run_id, 'N/A') AS run_id, round(coalesce(r.accuracy, 0.0), 6) AS accuracy
FROM cur LEFT JOIN vers v ON v.name = cur.name AND v.version = cur.version
LEFT JOIN runs r ON r.run_id = v.run_id""",
)
def q_champion_lookup(spark, sf_dir):
    v = versions(spark, sf_dir)
    return rounded(lineage.champion(alias_events(v), v, run_metrics(spark, sf_dir)))


@register(
    "champion_vs_candidate",
    f"""WITH {_RUNS}, {_VERS},
cur AS (SELECT name, arg_max(version, (started, version)) AS version FROM vers GROUP BY name),
ch AS (SELECT cur.name, cur.version, coalesce(r.accuracy, 0.0) AS accuracy FROM cur
       LEFT JOIN vers v ON v.name = cur.name AND v.version = cur.version LEFT JOIN runs r ON r.run_id = v.run_id),
ca AS (SELECT name, max(version) AS version, arg_max(accuracy, version) AS accuracy FROM vers GROUP BY name)
SELECT coalesce(ch.name, ca.name) AS name, ch.version AS champion_version, round(ch.accuracy, 6) AS champion_accuracy,
       ca.version AS candidate_version, round(ca.accuracy, 6) AS candidate_accuracy
FROM ch FULL OUTER JOIN ca ON ch.name = ca.name""",
)
def q_champion_vs_candidate(spark, sf_dir):
    v = versions(spark, sf_dir)
    champ = lineage.champion(alias_events(v), v, run_metrics(spark, sf_dir))
    return rounded(lineage.champion_vs_candidate(champ, lineage.latest_versions(v)))


@register(
    "metric_latest",
    f"""WITH {_HIST}
SELECT metric, round(arg_max(value, (ts, batch_id)), 6) AS value, max(ts) AS ts FROM hist GROUP BY metric""",
)
def q_metric_latest(spark, sf_dir):
    return rounded(lineage.latest_metrics(metric_history(spark, sf_dir)))


@register(
    "drift_alerts",
    f"""WITH {_HIST}
SELECT ts, run_id, batch_id, metric, round(value, 6) AS value FROM hist
WHERE metric = 'drift_score' AND value > {ALERT_THRESHOLD}""",
)
def q_drift_alerts(spark, sf_dir):
    return rounded(lineage.drift_alerts(metric_history(spark, sf_dir), ALERT_THRESHOLD))


@register(
    "local_time_format",
    """SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local_ts,
       strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d-%H-%M-%S') AS snapshot_tag FROM events""",
)
def q_local_time_format(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("event_id", "ts")
    return e.select(
        "event_id",
        lineage.local_stamp(e, "ts", fmt="yyyy-MM-dd HH:mm:ss").alias("local_ts"),
        lineage.local_stamp(e, "ts", fmt="yyyy-MM-dd-HH-mm-ss").alias("snapshot_tag"),
    )
