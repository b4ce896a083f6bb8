"""Emotion curve: per-beat composite, exponential smoothing, summary and shape."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions.rules import EMOTION_RULES, detect_emotion
from storyspark.operators.folds import Fold, sequence_fold
from storyspark.operators.ordered import Blocks

K, O = "script_id", "idx"

# fixed values: beat type -> base score, valence, energy, spike
BEAT_PROFILES = {
    "hook": (0.82, 0.10, 0.88, True), "setup": (0.38, 0.05, 0.35, False), "mystery": (0.62, -0.05, 0.65, False),
    "contradiction": (0.68, -0.15, 0.72, False), "evidence": (0.45, 0.08, 0.42, False), "escalation": (0.72, -0.10, 0.78, False),
    "reveal": (0.88, 0.15, 0.90, True), "payoff": (0.95, 0.40, 0.85, True), "warning": (0.78, -0.45, 0.82, False),
    "cta": (0.25, 0.20, 0.18, False),
}
OTHER_PROFILE = (0.45, 0.0, 0.42, False)
FLOORS = {"hook": 0.78, "reveal": 0.82, "payoff": 0.90}
CTA_CEILING = 0.30


def _profile(n: int) -> Column:
    return F.coalesce(*[F.when(F.col("_beat") == b, F.lit(p[n])) for b, p in BEAT_PROFILES.items()], F.lit(OTHER_PROFILE[n]))


def emotion_points(df: DataFrame, text: str = "text", confidence: str = "confidence", rules=EMOTION_RULES,
                   floors: dict[str, float] | None = None, cta_ceiling: float = CTA_CEILING, unicode: bool = True,
                   key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """Unsmoothed score, valence, energy and label of each beat.

    Only a call-to-action looks at the previous score (-.10 above .7), and its own score stays
    at or below the ceiling, so it never feeds another one: two look-backs are exact as long
    as the ceiling is at most .7.
    """
    if cta_ceiling > 0.7:
        raise ValueError("cta_ceiling above .7 would chain beats")
    floors = floors or FLOORS
    beat = F.lower(F.trim(F.coalesce(F.nullif(F.col("beat_type"), F.lit("")), F.lit("evidence"))))
    b = Blocks.dense(df, key, order, block_rows).scan(totals={"_n": ("count", F.lit(1))})
    b = b.select(_beat=beat, _emo=detect_emotion(F.col(text), rules, unicode)).neighbours(_prev=("_beat", -1))
    i, n, prev, me = F.col(order), F.col("_n"), F.coalesce(F.col("_prev"), F.lit("")), F.col("_beat")
    place = F.when(n > 1, F.lit(0.08) * F.sin(i / F.greatest(F.lit(1), n - 1) * F.lit(math.pi) * F.lit(0.9))).otherwise(0.0)
    momentum = (
        F.when(me.isin("escalation", "evidence") & prev.isin("escalation", "evidence", "setup"), 0.06)
        .when((me == "reveal") & prev.isin("escalation", "mystery", "contradiction"), 0.08)
        .when((me == "payoff") & prev.isin("reveal", "escalation", "warning"), 0.06).otherwise(0.0))
    trust = (F.coalesce(F.col(confidence), F.lit(0.5)) - 0.5) * 0.08
    boost, shift = F.col("_emo.boost"), F.col("_emo.valence")
    raw = _profile(0) + boost + place + momentum + trust
    clamp = lambda c, lo=0.0: F.greatest(F.lit(lo), F.least(F.lit(1.0), c))

    def ruled(score: Column) -> Column:
        out = F
        for name, floor in floors.items():
            out = out.when(me == name, F.greatest(score, F.lit(floor)))
        return out.when(me == "cta", F.least(score, F.lit(cta_ceiling))).otherwise(score)

    b = b.select(_first=clamp(ruled(raw)), _raw=raw, position_mod=place, momentum_mod=momentum, confidence_mod=trust,
                 text_boost=boost, label=F.col("_emo.label"), spike=_profile(3),
                 valence=clamp(_profile(1) + shift * 0.5, -1.0), energy=clamp(_profile(2) + boost * 0.5),
                 curve_position=F.when(n > 1, F.round(i / F.greatest(F.lit(1), n - 1), 3)).otherwise(0.5))
    b = b.neighbours(_before=("_first", -1))
    drop = F.when((me == "cta") & (F.coalesce(F.col("_before"), F.lit(0.0)) > 0.7), -0.10).otherwise(0.0)
    score = clamp(ruled(F.col("_raw") + drop))
    return b.df.withColumns({"score": score, "momentum_mod": F.col("momentum_mod") + drop, "beat_count": n}).drop(
        "_beat", "_emo", "_prev", "_first", "_raw", "_before", "_n")


def _smooth_step(alpha: float, ceiling: float):
    def step(state, row):
        score, spike, beat, n = row
        prev = state[0]
        if prev is None or spike or n <= 2 or alpha <= 0:
            return [score], (score,)
        mixed = alpha * prev + (1 - alpha) * score
        if beat == "cta":
            mixed = min(mixed, ceiling)
        mixed = max(0.0, min(1.0, mixed))
        return [mixed], (mixed,)

    return step


def smooth_curve(points: DataFrame, alpha: float = 0.15, cta_ceiling: float = CTA_CEILING, keep: list[str] | None = None,
                 key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """Exponential smoothing; spikes stay as they are and restart it.

    The weight of an old value falls below double precision within a few dozen beats, so the
    block guess of the fold is exact at once.
    """
    keep = keep or [c for c in points.columns if c not in (key, order, "score")]
    fold = Fold([None], _smooth_step(max(0.0, min(1.0, alpha)), cta_ceiling), ["score", "spike", "beat_type", "beat_count"], "score double")
    return sequence_fold(points, fold, keep, key, order, block_rows)


def curve_summary(points: DataFrame, key: str = K, order: str = O) -> DataFrame:
    """Mean, peak, trough, spikes, arc shape, dominant label and valence trend per script."""
    s, i = F.col("score"), F.col(order)
    n = F.col("beat_count")
    third, two = F.floor(n / 3), F.floor(n * 2 / 3)
    part = lambda c: F.coalesce(F.sum(F.when(c, s)), F.lit(0.0))
    # per (key, label) first, then per key: one pass gives the label counts and everything else
    labels = points.groupBy(key, "label").agg(
        F.count(F.lit(1)).alias("c"), F.min(order).alias("f"), F.max(n).alias("n"), F.sum(s).alias("sum"), F.max(s).alias("hi"), F.min(s).alias("lo"),
        F.max(F.struct(s.alias("s"), (-i).alias("i"), F.col("beat_type").alias("b"))).alias("peak"), F.count_if("spike").alias("spikes"),
        F.sum("valence").alias("val"), part(i < third).alias("s1"), part((i >= third) & (i < two)).alias("s2"), part(i >= two).alias("s3"))
    whole = labels.groupBy(key).agg(
        F.max("n").alias("beat_count"), (F.sum("sum") / F.sum("c")).alias("mean"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("peak").alias("peak"),
        F.sum("spikes").alias("spike_count"), (F.sum("val") / F.sum("c")).alias("val"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("s3").alias("s3"),
        F.max_by("label", F.struct("c", -F.col("f"))).alias("dominant_emotion"))
    whole = whole.withColumn("peak", F.struct((-F.col("peak.i")).alias("i"), F.col("peak.b").alias("b")))
    n = F.col("beat_count")
    third, two = F.floor(n / 3), F.floor(n * 2 / 3)
    a1 = F.col("s1") / F.greatest(F.lit(1), third)
    a2 = F.col("s2") / F.greatest(F.lit(1), third)
    a3 = F.col("s3") / F.greatest(F.lit(1), n - two)
    at = F.col("peak.i") / F.greatest(F.lit(1), n - 1)
    shape = (F.when(n < 3, "flat").when(at >= 0.7, "rising_climax").when(at <= 0.2, "front_loaded")
             .when((a2 > a1) & (a2 > a3), "mountain").when((a1 > a2) & (a3 > a2), "valley")
             .when(F.col("hi") - F.col("lo") < 0.15, "flat").otherwise("wave"))
    trend = F.when(n < 2, "neutral").when(F.col("val") > 0.15, "positive").when(F.col("val") < -0.15, "negative").otherwise("mixed")
    return whole.select(
        key, "beat_count", F.round("mean", 3).alias("mean_intensity"), F.round("hi", 3).alias("peak_intensity"),
        F.col("peak.i").alias("peak_index"), F.col("peak.b").alias("peak_beat_type"), F.round("lo", 3).alias("trough_intensity"),
        F.round(F.col("hi") - F.col("lo"), 3).alias("intensity_range"), "spike_count", shape.alias("arc_shape"),
        "dominant_emotion", trend.alias("valence_trend"))


def spike_rows(points: DataFrame, key: str = K, order: str = O) -> DataFrame:
    """The spike positions, one per row."""
    return points.filter("spike").select(key, F.col(order).alias("spike_idx"))
