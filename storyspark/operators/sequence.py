"""Ordered-sequence operators: memory, rhythm, acts, carry-forward, expansion, allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyspark.operators.ordered import Blocks, number_rows

K, O = "script_id", "idx"


# ---- W12, A6, A7: asset memory -----------------------------------------------------------

def track_reuse(df: DataFrame, asset: str = "asset_id", min_gap: int = 5, key: str = K, order: str = O,
                block_rows: int | None = None) -> DataFrame:
    """First appearance, earlier uses, beats since the last use, and reuse issues.

    (script, asset) groups may be huge too, so they go through adaptive blocks.
    """
    b = Blocks.adaptive(df, [key, asset], [order], block_rows).scan(
        running={"_uses": ("count", F.lit(1)), "_prev": ("last", order, "before")})
    gap = F.coalesce(F.col(order) - F.col("_prev"), F.lit(-1))
    reveal = F.lower(F.coalesce(F.col("beat_type"), F.lit(""))) == "reveal"
    return b.df.withColumns({
        "reuse_count": F.col("_uses") - 1, "is_first": F.col("_uses") == 1, "beats_since_last": gap,
        "spoiled_reveal": reveal & (F.col("_uses") > 1), "premature_reuse": (gap > 0) & (gap < min_gap),
    }).drop("_uses", "_prev")


def reuse_summary(tracked: DataFrame, asset: str = "asset_id", key: str = K) -> DataFrame:
    """Two-step distinct: (script, asset) first, so a hot script never meets in one task."""
    per_asset = tracked.groupBy(key, asset).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("spoiled_reveal").cast("int") + F.col("premature_reuse").cast("int")).alias("issues"))
    return per_asset.groupBy(key).agg(
        F.sum("n").alias("beat_count"), F.count(F.lit(1)).alias("unique_assets"),
        F.sum(F.col("n") - 1).alias("total_reuses"), F.sum("issues").alias("issue_count"))


def asset_memory(df: DataFrame, asset: str = "asset_id", key: str = K, order: str = O) -> DataFrame:
    return df.groupBy(key, asset).agg(
        F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), F.count(F.lit(1)).alias("times_used"))


def memory_scores(candidates: DataFrame, memory: DataFrame, now: str = "at_idx", asset: str = "asset_id", key: str = K,
                  recent: int = 3, callback_gap: int = 8) -> DataFrame:
    """Reuse, fatigue, allowance and callback scores of (script, asset, time) candidates."""
    j = candidates.join(memory, [key, asset], "left")
    seen, uses = F.col("times_used").isNotNull(), F.col("times_used")
    since = F.col(now) - F.col("last_seen")
    idle = F.greatest(F.lit(0), since)
    reuse = (F.lit(1.0) / (uses + 1)) * 0.4 + F.least(idle / 5.0, F.lit(1.0)) * 0.6
    fatigue = F.greatest(F.lit(0.0), F.least(uses / 5.0, F.lit(1.0)) - F.least(idle / 10.0, F.lit(0.5)))
    callback = F.coalesce(F.col("is_callback"), F.lit(False)) if "is_callback" in candidates.columns else F.lit(False)
    finale = F.upper(F.coalesce(F.col("beat_type"), F.lit(""))).isin("PAYOFF", "FINALE") \
        if "beat_type" in candidates.columns else F.lit(False)
    recently = seen & (since <= recent)
    return j.withColumns({
        "reuse_score": F.when(seen, F.least(F.greatest(reuse, F.lit(0.0)), F.lit(1.0))).otherwise(1.0),
        "fatigue_score": F.when(seen, fatigue).otherwise(0.0),
        "seen_recently": F.coalesce(recently, F.lit(False)),
        "allowed": callback | ~F.coalesce(recently, F.lit(False)),
        "callback_ok": F.coalesce(seen & (finale | (since >= callback_gap)), F.lit(False)),
    })


# ---- W13, W14, A8: rhythm ----------------------------------------------------------------------

ENERGETIC_BEATS, QUIET_BEATS = ["hook", "climax", "payoff", "action"], ["evidence", "context", "resolution"]
HOT_EMOTIONS, COLD_EMOTIONS = ["fear", "rage", "shock", "triumph"], ["grief", "calm", "sadness"]
STRONG_MOTIONS, STILL_MOTIONS = ["impact_shake", "dramatic_push", "climax_zoom"], ["static_hold", "grief_hold"]


def beat_energy() -> Column:
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    x = F.coalesce(F.col("intensity"), F.lit(0.5))
    e = F.lit(0.5) + F.when(low("beat_type").isin(ENERGETIC_BEATS), 0.2).when(low("beat_type").isin(QUIET_BEATS), -0.15).otherwise(0.0)
    e = e + F.when(low("emotion").isin(HOT_EMOTIONS), x * 0.3).when(low("emotion").isin(COLD_EMOTIONS), x * -0.2).otherwise(0.0)
    e = e + F.when(low("motion_preset").isin(STRONG_MOTIONS), 0.15).when(low("motion_preset").isin(STILL_MOTIONS), -0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), e))


def visual_rhythm(df: DataFrame, key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """Energy, tempo and whether the step to either neighbour exceeds .4."""
    b = Blocks.dense(df, key, order, block_rows).select(energy=beat_energy())
    b = b.neighbours(_p=("energy", -1), _n=("energy", 1))
    e = F.col("energy")
    return b.df.withColumns({
        "tempo": F.when(e > 0.7, "fast").when(e < 0.4, "slow").otherwise("moderate"),
        "contrast_target": F.when(F.coalesce(F.abs(e - F.col("_p")) > 0.4, F.lit(False))
                                  | F.coalesce(F.abs(F.col("_n") - e) > 0.4, F.lit(False)), "high_contrast").otherwise("smooth_blend"),
    }).drop("_p", "_n")


def streak_issues(df: DataFrame, value: str = "energy", max_high: int = 3, max_low: int = 4, high: float = 0.75,
                  low: float = 0.35, key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """A streak that grows past its limit gives an issue and starts over."""
    x, i = F.col(value), F.col(order)
    b = Blocks.dense(df, key, order, block_rows).scan(running={
        "_nh": ("last", F.when(~(x > high), i)), "_nl": ("last", F.when(~(x < low), i))})
    up, down = i - F.coalesce(F.col("_nh"), F.lit(-1)), i - F.coalesce(F.col("_nl"), F.lit(-1))
    mark = lambda n, cap, kind: F.when((n > 0) & (n % (cap + 1) == 0), F.struct(
        F.lit(kind).alias("issue_type"), (i - cap).alias("first_idx"), i.alias("last_idx")))
    found = F.array_compact(F.array(mark(up, max_high, "fatigue"), mark(down, max_low, "boredom")))
    return b.df.select(key, F.explode(found).alias("q")).select(key, "q.*")


def rhythm_summary(rhythm: DataFrame, issues: DataFrame, key: str = K) -> DataFrame:
    n = issues.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return rhythm.groupBy(key).agg(
        F.count(F.lit(1)).alias("beat_count"), F.avg("energy").alias("avg_energy"),
        F.count_if(F.col("contrast_target") == "high_contrast").alias("high_contrast_transitions"),
    ).join(n, key, "left").select(key, "beat_count", "avg_energy", "high_contrast_transitions",
                                  F.coalesce("n", F.lit(0)).alias("issue_count"))


# ---- W16: acts ------------------------------------------------------------------------------------

def narrative_arc(df: DataFrame, act_1: float = 0.20, act_2: float = 0.50, key: str = K, order: str = O,
                  block_rows: int | None = None) -> DataFrame:
    """Act by position, pacing target and significance."""
    b = Blocks.dense(df, key, order, block_rows).scan(totals={"_n": ("count", F.lit(1))})
    i, n, beat = F.col(order), F.col("_n"), F.lower(F.coalesce(F.col("beat_type"), F.lit("neutral")))
    end1 = F.greatest(F.lit(1), F.floor(n * F.lit(act_1)))
    end2 = F.greatest(end1 + 1, F.floor(n * F.lit(act_1 + act_2)))
    act = F.when(i < end1, "Act 1").when(i < end2, "Act 2").otherwise("Act 3")
    pacing = (
        F.when(beat.isin("hook", "escalation", "payoff", "climax", "action"), "fast")
        .when(beat.isin("evidence", "explanation", "context", "resolution"), "slow")
        .when(i == 0, "fast")
        .when(act == "Act 3", F.when(i < n - 1, "fast").otherwise("slow"))
        .otherwise("moderate"))
    weight = F.when(beat.isin("hook", "reveal", "payoff", "reversal"), "high").when(
        beat.isin("escalation", "evidence", "cta"), "medium").otherwise("low")
    return b.df.withColumns({"act": act, "pacing_target": pacing, "arc_significance": weight}).drop("_n")


def arc_summary(planned: DataFrame, act_1: float = 0.20, act_2: float = 0.50, key: str = K) -> DataFrame:
    """Act sizes by the act limits (a one-beat script counts -1 beats in act 3, as in the rule)."""
    n = F.col("beat_count")
    end1 = F.greatest(F.lit(1), F.floor(n * F.lit(act_1)))
    end2 = F.greatest(end1 + 1, F.floor(n * F.lit(act_1 + act_2)))
    return planned.groupBy(key).agg(
        F.count(F.lit(1)).alias("beat_count"), F.count_if(F.col("arc_significance") == "high").alias("high_significance_beats"),
    ).withColumns({"act_1_count": end1, "act_2_count": end2 - end1, "act_3_count": n - end2})


# ---- W17: carry forward --------------------------------------------------------------------------------

def carry_entity(df: DataFrame, entities: str = "entities", role: str = "visual_role", fallback: str = "protagonist",
                 key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """First entity of the beat, else the location, else the last assigned pair, else the default."""
    r = F.lower(F.coalesce(F.col(role), F.lit("character")))
    named = F.size(F.coalesce(F.col(entities), F.array().cast("array<string>"))) > 0
    own = F.when(named, F.struct(F.get(F.col(entities), 0).alias("entity"),
                                 F.when(r == "character", "character").otherwise("object").alias("type"))).when(
        r == "location", F.struct(F.lit("Current Arc/Location").alias("entity"), F.lit("location").alias("type")))
    b = Blocks.dense(df, key, order, block_rows).scan(running={"_held": ("last", own)})
    entity = F.coalesce(F.col("_held.entity"), F.lit(fallback))
    why = F.when(named, F.concat(F.lit("Derived from context_entities: "), entity)).when(
        r == "location", "Visual role is location").otherwise(F.concat(F.lit("Fallback to "), entity, F.lit(" (carryover or default)")))
    return b.df.withColumns({"entity": entity, "entity_type": F.coalesce(F.col("_held.type"), F.lit("character")),
                             "reasoning": why}).drop("_held")


def entity_summary(assigned: DataFrame, key: str = K) -> DataFrame:
    per = assigned.groupBy(key, "entity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("entity_type") == "character").alias("c"),
        F.count_if(F.col("entity_type") == "location").alias("l"))
    return per.groupBy(key).agg(F.sum("n").alias("beat_count"), F.count(F.lit(1)).alias("unique_entities"),
                                F.sum("c").alias("character_beats"), F.sum("l").alias("location_beats"))


# ---- W31: boundary and word-hit events -------------------------------------------------------------------

EDGE_PUNCTUATION = r"""^[.,!?;:'"\-]+|[.,!?;:'"\-]+$"""


def transition_events(df: DataFrame, transition: str = "transition_type", target: str = "target_word",
                      text: str = "subtitle_text", key: str = K, order: str = O) -> DataFrame:
    """Cuts with a transition, and bass hits where a marked word is expected to be spoken.

    One row can give both, so the two kinds come from one scan.
    """
    t = F.coalesce(F.nullif(F.col(transition), F.lit("")), F.lit("default"))
    start, end = F.col("start_s"), F.col("end_s")
    cut = F.when((F.col(order) > 0) & start.isNotNull() & (F.lower(t) != "none"),
                 F.struct(start.alias("time_s"), t.alias("transition")))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, EDGE_PUNCTUATION, ""))
    want = F.lower(F.trim(F.coalesce(F.col(target), F.lit(""))))
    at = F.array_position(bare, want)
    hit = F.when((want != "") & (at > 0) & (end > start), F.struct(
        (start + (at - 1) / F.size(words) * (end - start)).alias("time_s"), F.lit("bass_hit").alias("transition")))
    return df.select(key, order, F.explode(F.array_compact(F.array(cut, hit))).alias("e")).select(key, order, "e.*")


# ---- W36 - W39, W45: allocation, sampling, expansion -------------------------------------------------------

def proportional_times(lines: DataFrame, words: str = "words", start: str = "start_s", end: str = "end_s",
                       key: str = K, order: str = O, min_s: float = 0.35, block_rows: int | None = None) -> DataFrame:
    """Time per line by word share (at least ``min_s``), cut at the end; the last shown line takes the rest.

    ``start`` / ``end`` are the key's own range, repeated on its rows.
    """
    b = Blocks.dense(lines, key, order, block_rows).scan(totals={"_w": ("sum", words)})
    span = F.greatest(F.lit(0.1), F.col(end) - F.col(start))
    share = F.greatest(F.lit(min_s), span * F.col(words) / F.greatest(F.lit(1), F.col("_w")))
    b = b.select(_d=share).scan(running={"_to": ("sum", "_d")}, totals={"_last": ("max", order)})
    at = F.col(start) + F.col("_to") - F.col("_d")
    until = F.least(F.col(start) + F.col("_to"), F.col(end))
    return b.df.withColumns({"line_start": at, "line_end": F.when(F.col(order) == F.col("_last"), F.col(end)).otherwise(until)}) \
        .filter(F.col("line_start") < F.col(end)).drop("_w", "_d", "_to", "_last")


def largest_remainder(df: DataFrame, value: str, total: str, key: str, order: str, out: str = "frames",
                      block_rows: int | None = None) -> DataFrame:
    """Integer shares that add up to ``total``: +1 by largest remainder, or -1 from the smallest
    positive ones; one pass."""
    base = F.floor(F.col(value))
    rows = df.withColumns({"_b": base, "_r": F.col(value) - base})
    ranked = Blocks.adaptive(rows.withColumn("_minus", -F.col("_r")), key, ["_minus", order], block_rows).scan(
        running={"_down": ("count", F.lit(1))}, totals={"_sum": ("sum", "_b"), "_n": ("count", F.lit(1))}).df
    ranked = Blocks.adaptive(ranked, key, ["_r", order], block_rows).scan(running={"_up": ("count", F.lit(1))}).df
    short = F.col(total) - F.col("_sum")
    got = F.col("_b") + F.when(F.col("_down") <= short, 1).when((F.col("_up") <= -short) & (F.col("_b") > 0), -1).otherwise(0)
    return ranked.withColumn(out, got.cast("long")).select(*df.columns, out)


def even_sample(df: DataFrame, k: Column, key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """``k`` evenly spaced rows of each key (all rows of shorter keys); each row decides alone.

    Row i is taken when i = floor(j*(n-1)/(k-1)) for some j: the j that can reach i is
    ceil(i*(k-1)/(n-1)).
    """
    b = Blocks.dense(df, key, order, block_rows).scan(totals={"_n": ("count", F.lit(1))}).select(_k=k.cast("long"))
    i, n, kk = F.col(order), F.col("_n"), F.greatest(F.lit(1), F.col("_k"))
    j = F.expr(f"(({order} * (greatest(1, _k) - 1)) + _n - 2) div greatest(1, _n - 1)")
    hit = F.expr(f"({order} * (greatest(1, _k) - 1) + _n - 2) div greatest(1, _n - 1) * (_n - 1) div greatest(1, greatest(1, _k) - 1) = {order}")
    take = F.when(n <= kk, F.lit(True)).when(kk == 1, i == 0).otherwise(hit & (j <= kk - 1))
    slot = F.when(n <= kk, i).when(kk == 1, F.lit(0)).otherwise(j)
    return b.df.filter(take).withColumns({"slot": slot.cast("long"), "slots": F.least(n, kk).cast("long")}).drop("_n", "_k")


def expand_parallel(df: DataFrame, pacing: str = "pacing_intent", query: str = "query") -> DataFrame:
    """Rows marked parallel_cut become two half-length rows."""
    mark = F.lower(F.trim(F.coalesce(F.col(pacing), F.lit("")))) == "parallel_cut"
    mid = F.col("start_s") + (F.col("end_s") - F.col("start_s")) / 2.0
    fields = ["start_s", "end_s", query, "summary", "transition_type", pacing]

    def half(start, end, q, s, t):
        return F.struct(F.lit(0 if end is not None and start is None else 1).alias("half"),
                        (start if start is not None else F.col("start_s")).alias("start_s"),
                        (end if end is not None else F.col("end_s")).alias("end_s"), q.alias(query), s.alias("summary"),
                        t.alias("transition_type"), F.lit("rapid_montage").alias(pacing))

    q0, s0 = F.coalesce(F.col(query), F.lit("")), F.coalesce(F.col("summary"), F.lit(""))
    first = half(None, mid, F.col(query), F.col("summary"), F.coalesce(F.col("transition_type"), F.lit("crossfade")))
    second = half(mid, None, F.trim(F.concat(F.trim(q0), F.lit(" alternate view"))), F.trim(F.concat(s0, F.lit(" (alt angle)"))),
                  F.lit("crossfade"))
    same = F.struct(F.lit(0).alias("half"), *[F.col(c) for c in fields])
    rest = [c for c in df.columns if c not in fields]
    return df.select(*rest, F.explode(F.when(mark, F.array(first, second)).otherwise(F.array(same))).alias("_x")).select(*rest, "_x.*")


CAMERA_GOALS = {  # fixed values
    "character": "face_lock_push", "evidence": "inspect_detail", "object": "object_reveal", "location": "wide_context_pan",
    "symbol": "centered_icon_hold", "comparison": "two_subject_scan", "timeline": "left_to_right_progression",
    "section_card": "readable_hold", "quote_card": "readable_hold", "cta_card": "readable_hold",
}
TRANSITION_BY_BEAT = {  # fixed values
    "hook": "crossfade", "setup": "fade_eased", "evidence": "crossfade", "reveal": "zoom_dissolve", "twist": "glitch_cut",
    "escalation": "whip_pan_right", "payoff": "fade_eased", "resolution": "fade_eased", "cta": "fade_eased",
}


def lookup(values: dict[str, str], c: Column, default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def camera_plan(df: DataFrame, key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """Camera goal per role; a repeated moving preset asks for another framing."""
    b = Blocks.dense(df, key, order, block_rows).neighbours(_p=("motion_preset", -1))
    goal = lookup(CAMERA_GOALS, F.coalesce(F.col("visual_role"), F.lit("character")), "support_narration")
    repeat = (F.col("_p") == F.col("motion_preset")) & ~F.col("motion_preset").isin("title_card_hold", "static_hold", "")
    x = F.coalesce(F.nullif(F.col("intensity"), F.lit(0.0)), F.lit(0.45))
    return b.df.withColumns({
        "camera_goal": F.when(F.coalesce(repeat, F.lit(False)), F.concat(goal, F.lit("_alternate_framing"))).otherwise(goal),
        "motion_intensity": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.15), x)), 2),
        "transition_in": lookup(TRANSITION_BY_BEAT, F.coalesce(F.col("beat_type"), F.lit("")), "crossfade"),
    }).drop("_p")


def latest_status(log: DataFrame, session: str = "session_id", stage: str = "stage", at: str = "updated_at",
                  tie: str = "seq", status: str = "status", error: str = "error") -> DataFrame:
    """Newest entry per session and per (session, stage) from an append-only status log.

    The error column is null again once a later entry has none, because it comes from the newest one.
    """
    newest = F.max_by(F.struct(stage, status, error, at), F.struct(F.col(at), F.col(tie)))
    per_stage = log.groupBy(session, stage).agg(
        F.max_by(F.struct(status, at), F.struct(F.col(at), F.col(tie))).alias("s"), newest.alias("l"),
        F.max(F.struct(F.col(at), F.col(tie))).alias("o"))
    whole = per_stage.groupBy(session).agg(
        F.max_by("l", "o").alias("l"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(stage), F.col("s"))))).alias("steps"))
    return whole.select(session, F.col(f"l.{stage}").alias("stage"), F.col(f"l.{status}").alias("status"),
                        F.col(f"l.{error}").alias("error"), F.col(f"l.{at}").alias("updated_at"), "steps")


def upload_status(df: DataFrame, path: str = "image_path", key: str = K) -> DataFrame:
    got = F.count_if(F.coalesce(F.col(path), F.lit("")) != "")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("total"), got.alias("uploaded")).withColumns({
        "missing": F.col("total") - F.col("uploaded"), "complete": (F.col("total") > 0) & (F.col("total") == F.col("uploaded"))})


def cue_groups(cues: DataFrame, key: str = K, who: str = "character", label: str = "expression", order: str = O,
               first_texts: int = 4) -> DataFrame:
    """Cues per (script, character, label): count, span and the first texts (bounded)."""
    g = number_rows(cues, [key, who, label], [order], out="_pos")
    return g.groupBy(key, who, label).agg(
        F.count(F.lit(1)).alias("cue_count"), F.min("start_s").alias("first_start"), F.max("end_s").alias("last_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_pos") < first_texts, F.struct("_pos", "text")))),
                                 lambda x: x["text"]), " | ").alias("context"))
