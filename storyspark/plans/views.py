"""Canonical operator inputs built from the shared test tables.

Each view has a SQL twin (``*_SQL``) used as a CTE by the DuckDB checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.operators.ordered import Blocks


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the files give fewer splits than that (one small file, say).

    Inputs with enough splits, that is all large ones, are left alone: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


BEAT_TYPES = {"signup": "hook", "view": "evidence", "click": "escalation", "error": "warning", "purchase": "reveal"}


def _pick(values: list[str], n) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


ROLES = ["character", "evidence", "location", "symbol"]
LAYOUTS = ["safe_subject", "evidence_card", "title_card"]
EMOTIONS = ["fear", "calm", "rage", "grief", "neutral"]
MOTIONS = ["static_hold", "impact_shake", "subject_push", "slow_pan"]


def beats(spark: SparkSession, sf: str) -> DataFrame:
    """events as storyboards: one script per user, one beat per event."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("script_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value", "props")
    b = Blocks.adaptive(ev, "script_id", ["ts", "event_id"]).scan(totals={"t0": ("min", "ts")}).numbered("idx")
    start = (F.unix_micros("ts") - F.unix_micros("t0")) / F.lit(1e6)
    b = b.select(start_s=start).neighbours(_next=("start_s", 1))
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    kind = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(v)) for e, v in BEAT_TYPES.items()])
    return b.df.withColumn("asset", k).select(
        "script_id", "idx", kind.alias("beat_type"), (F.col("value") / 500).alias("intensity"),
        "start_s", F.coalesce(F.col("_next"), F.col("start_s") + 3600).alias("end_s"),
        F.col("asset").cast("string").alias("asset_id"),
        F.concat(F.lit("cast"), F.col("asset") % 3).alias("character"),
        F.concat(F.lit("arc"), F.col("asset") % 2).alias("arc"),
        _pick(ROLES, F.col("asset")).alias("visual_role"),
        _pick(LAYOUTS, F.col("asset")).alias("layout_mode"),
        _pick(EMOTIONS, F.col("asset")).alias("emotion"),
        _pick(MOTIONS, F.col("asset")).alias("motion_preset"),
        F.concat(F.lit("query "), F.col("asset") % 10).alias("query"),
        F.concat("event_type", F.lit(" scene "), F.col("asset") % 7).alias("subtitle_text"),
        "event_id",
    )


def _pick_sql(values: list[str]) -> str:
    return "list_extract([" + ",".join(f"'{v}'" for v in values) + f"], CAST(k % {len(values)} + 1 AS INTEGER))"


BEATS_SQL = f"""
ev0 AS (
  SELECT user_id AS script_id, event_id, event_type, value, ts,
         CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS start_s
  FROM events),
beats AS (
  SELECT script_id, idx,
         CASE event_type WHEN 'signup' THEN 'hook' WHEN 'view' THEN 'evidence' WHEN 'click' THEN 'escalation'
              WHEN 'error' THEN 'warning' WHEN 'purchase' THEN 'reveal' END AS beat_type,
         value / 500 AS intensity, start_s,
         coalesce(lead(start_s) OVER (PARTITION BY script_id ORDER BY idx), start_s + 3600) AS end_s,
         CAST(k AS VARCHAR) AS asset_id, 'cast' || (k % 3) AS character, 'arc' || (k % 2) AS arc,
         {_pick_sql(ROLES)} AS visual_role, {_pick_sql(LAYOUTS)} AS layout_mode,
         {_pick_sql(EMOTIONS)} AS emotion, {_pick_sql(MOTIONS)} AS motion_preset,
         'query ' || (k % 10) AS query, event_type || ' scene ' || (k % 7) AS subtitle_text, event_id
  FROM ev0)"""


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """part as an asset catalog."""
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("category"),
        F.element_at(F.split(name, " "), -1).alias("character"),
        F.concat_ws(" / ", "p_type", F.element_at(F.split(name, " "), 1)).alias("arc"),
        F.concat_ws(", ", F.element_at(F.split(name, " "), 1), F.lower("p_type"),
                    F.concat(F.lit("mood"), F.col("p_size") % 7)).alias("emotion"),
        F.when(F.col("p_size") % 4 == 0, "arc_card").otherwise("character").alias("visual_type"),
        (1 + F.col("p_size") % 5).cast("int").alias("importance"),
        F.concat(F.split(name, " "), F.array(F.lower("p_type"), F.lower("p_brand"))).alias("tags"),
    )


CATALOG_SQL = """
catalog AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS category,
         list_extract(string_split(p_name, ' '), -1) AS character,
         p_type || ' / ' || list_extract(string_split(p_name, ' '), 1) AS arc,
         list_extract(string_split(p_name, ' '), 1) || ', ' || lower(p_type) || ', mood' || (p_size % 7) AS emotion,
         CASE WHEN p_size % 4 = 0 THEN 'arc_card' ELSE 'character' END AS visual_type,
         CAST(1 + p_size % 5 AS INTEGER) AS importance,
         list_concat(string_split(p_name, ' '), [lower(p_type), lower(p_brand)]) AS tags
  FROM part)"""
