"""Storyboard audits: repetition runs, droughts, flat stretches, hooks, diversity, gates.

Every check returns long rows (one per violation, one per fix), so the output of a very
long sequence never has to fit one row.  Sequences are read through ``Blocks``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions.text import clean_prompt
from storyspark.operators.ordered import Blocks, label_runs

K, O = "script_id", "idx"

# fixed values: fix suggestions by position
ALT_VISUAL_ROLES = ["evidence", "symbol", "location", "comparison", "timeline", "object", "quote_card", "section_card"]
ALT_BEAT_TYPES = ["mystery", "contradiction", "reveal", "evidence", "escalation"]
STATIC_MOTIONS = ["static_hold", "hold_still", "evidence_hold", ""]
DEDUCTION = {"critical": 20, "high": 12, "medium": 8, "low": 4}  # hundredths
OTHER_DEDUCTION = 5
RETENTION_GRADES = [("A", 90), ("B", 75), ("C", 60), ("D", 40)]
DIVERSITY_WEIGHTS = {"character": 0.30, "arc": 0.25, "composition": 0.25, "emotion": 0.20}
DIVERSITY_GRADES = [("A", 0.15), ("B", 0.30), ("C", 0.50), ("D", 0.70)]
SUGGESTIONS = {
    "character": [
        "Switch to a different character's perspective",
        "Use a location or object shot instead of character close-up",
        "Show a symbol or abstract visual related to the narration",
        "Use a wide establishing shot or environment",
    ],
    "arc": [
        "Transition to a flashback or flash-forward in a different arc",
        "Use a comparison/contrast visual from another location",
        "Show a map, timeline, or abstract representation",
    ],
    "composition": [
        "Switch visual_role (e.g., character → evidence → symbol)",
        "Change layout_mode (e.g., safe_subject → title_card → bleed)",
        "Use a split-screen or comparison layout",
        "Switch to a quote_card or section_card for variety",
    ],
    "emotion": [
        "Introduce tonal contrast — shift to a different emotional register",
        "Use visual pacing: insert a calm setup beat between intense moments",
        "Vary the color palette to signal emotional change",
    ],
}
REJECTED_NOTE = "⚠ REJECTED — replace this section to reduce visual monotony"


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _low(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


# ---- W1: runs -----------------------------------------------------------------------------

def find_runs(df: DataFrame, value: str, key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """Runs of two or more equal non-empty values: value, start, length."""
    return (
        label_runs(df, value, key, order, block_rows)
        .filter(F.coalesce(F.col(value), F.lit("")) != "")
        .groupBy(key, "run_start", F.col(value).alias("run_value"))
        .agg(F.count(F.lit(1)).alias("run_length"))
        .filter("run_length > 1")
    )


# ---- W2 - W6: retention checks ---------------------------------------------------------------

def _violation(name: str, severity: Column, first: Column, last: Column, fixes: Column, message: Column, key: str) -> list:
    return [F.col(key), F.lit(name).alias("check_name"), severity.alias("severity"), first.cast("long").alias("first_idx"),
            last.cast("long").alias("last_idx"), fixes.cast("long").alias("n_fixes"), message.alias("message")]


def long_run_violations(df: DataFrame, value: str, name: str, max_run: int, high_from: int, label: str,
                        verb: str, key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """Runs longer than ``max_run``; severity is high from ``high_from`` beats on."""
    max_run = max(1, max_run)
    n, first = F.col("run_length"), F.col("run_start")
    last = first + n - 1
    text = F.concat(F.lit(f"{label} '"), F.col("run_value"), F.lit(f"' {verb} "), n, F.lit(" consecutive beats (indices "),
                    first, F.lit("–"), last, F.lit(f"). Limit is {max_run}."))
    return find_runs(df, value, key, order, block_rows).filter(n > max_run).select(*_violation(
        name, F.when(n >= high_from, "high").otherwise("medium"), first, last, n - max_run, text, key))


def same_character(df: DataFrame, value: str = "character", max_run: int = 3, **kw) -> DataFrame:
    return long_run_violations(df, value, "same_character", max_run, max(1, max_run) + 2, "Character", "appears in", **kw)


def same_arc(df: DataFrame, value: str = "arc", max_run: int = 4, **kw) -> DataFrame:
    return long_run_violations(df, value, "same_arc", max_run, max(1, max_run) + 3, "Arc", "stays for", **kw)


def long_run_fixes(df: DataFrame, value: str, max_run: int, action: str, priority: str, role: Column,
                   key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """One fix row per beat beyond the limit: each row knows its place in its run."""
    rows = label_runs(df, value, key, order, block_rows).filter(
        (F.col("run_pos") >= max(1, max_run)) & (F.coalesce(F.col(value), F.lit("")) != ""))
    return rows.select(key, F.col(order).alias("target_index"), F.lit(action).alias("action"),
                       F.lit(priority).alias("priority"), F.lit("visual_role").alias("field"), role.alias("new_value"))


def same_character_fixes(df: DataFrame, value: str = "character", max_run: int = 3, order: str = O, **kw) -> DataFrame:
    return long_run_fixes(df, value, max_run, "swap_character", "high", pick(ALT_VISUAL_ROLES, F.col(order)), order=order, **kw)


def same_arc_fixes(df: DataFrame, value: str = "arc", max_run: int = 4, **kw) -> DataFrame:
    return long_run_fixes(df, value, max_run, "change_arc", "medium", F.lit("comparison"), **kw)


def reveal_drought(df: DataFrame, gap_limit: float = 30.0, floor: float = 10.0, key: str = K, order: str = O,
                   block_rows: int | None = None) -> DataFrame:
    """Stretches between reveal/payoff starts (and to the end) longer than ``gap_limit`` seconds.

    Members of a stretch are the beats from its opening reveal up to the beat before the
    closing one; beats are expected in start order.
    """
    limit = max(floor, gap_limit)
    hit = F.when(_low("beat_type").isin("reveal", "payoff"), F.struct(F.col(order).alias("i"), F.col("start_s").alias("t")))
    b = Blocks.dense(df, key, order, block_rows).scan(
        running={"_before": ("last", hit, "before")},
        totals={"_final": ("last", hit), "_n": ("count", F.lit(1)), "_end": ("last", "end_s")},
    )
    i = F.col(order)
    closing = F.when(hit.isNotNull() & (i > 0), F.struct(
        F.coalesce(F.col("_before.i"), F.lit(-1)).alias("from_idx"), (i - 1).alias("last_idx"),
        (F.col("start_s") - F.coalesce(F.col("_before.t"), F.lit(0.0))).alias("gap")))
    open_from = F.coalesce(F.col("_final.i"), F.lit(-1))
    trailing = F.when((i == F.col("_n") - 1) & (open_from < F.col("_n") - 1), F.struct(
        open_from.alias("from_idx"), i.alias("last_idx"),
        (F.col("_end") - F.coalesce(F.col("_final.t"), F.lit(0.0))).alias("gap")))
    rows = b.df.select(key, F.explode(F.array_compact(F.array(closing, trailing))).alias("d")).filter(F.col("d.gap") > limit)
    first, last, gap = F.greatest(F.col("d.from_idx"), F.lit(0)), F.col("d.last_idx"), F.col("d.gap")
    mid = first + F.floor((last - first + 1) / 2)
    text = F.concat(F.format_string("No reveal/payoff for %.0fs (beats ", gap), first, F.lit("–"), last,
                    F.lit(f"). Limit is {limit:.0f}s."))
    return rows.select(*_violation("no_reveal_drought", F.lit("critical"), first, last, F.lit(2), text, key),
                       gap.alias("gap_s"), mid.cast("long").alias("mid_idx"), pick(ALT_BEAT_TYPES, mid).alias("alt_beat"))


def flat_emotion(df: DataFrame, intensity: str = "intensity", max_step: float = 0.10, max_range: float = 0.15,
                 key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """First window of four beats whose intensity neither rises nor varies."""
    x0 = F.coalesce(F.col(intensity), F.lit(0.0))
    b = Blocks.dense(df, key, order, block_rows).select(_x0=x0)
    b = b.neighbours(_x1=("_x0", 1), _x2=("_x0", 2), _x3=("_x0", 3))
    xs = [F.col(f"_x{n}") for n in range(4)]
    step = F.greatest(F.lit(0.0), *[xs[n + 1] - xs[n] for n in range(3)])
    low, high = F.least(*xs), F.greatest(*xs)
    flat = b.df.filter(xs[3].isNotNull() & (step <= max_step) & (high - low < max_range))
    first = flat.groupBy(key).agg(F.min_by(
        F.struct(F.col(order).alias("i"), low.alias("lo"), high.alias("hi"), step.alias("up")), F.col(order)).alias("w"))
    i = F.col("w.i")
    text = F.concat(F.lit("Flat emotional curve across beats "), i, F.lit("–"), i + 3)
    return first.select(*_violation("flat_emotion", F.lit("medium"), i, i + 3, F.lit(2), text, key),
                        F.col("w.lo").alias("low"), F.col("w.hi").alias("high"), F.col("w.up").alias("max_increase"))


def weak_hook(df: DataFrame, min_intensity: float = 0.6, key: str = K, order: str = O) -> DataFrame:
    """Problems of the opening beat, one row per script that has any."""
    beat, motion = _low("beat_type"), _low("motion_preset")
    x = F.coalesce(F.col("intensity"), F.lit(0.0))
    has = {c: c in df.columns for c in ("text_overlay", "emphasis_words")}
    overlay = F.coalesce(F.col("text_overlay"), F.lit("")) == "" if has["text_overlay"] else F.lit(True)
    words = F.coalesce(F.size("emphasis_words"), F.lit(0)) <= 0 if has["emphasis_words"] else F.lit(True)
    problems = F.array_compact(F.array(
        F.when(beat != "hook", F.concat(F.lit("First beat is beat_type='"), beat, F.lit("', not 'hook'"))),
        F.when(x < min_intensity, F.format_string(f"Hook emotion intensity is %.2f (minimum: {min_intensity:.2f})", x)),
        F.when(overlay & words, F.lit("Hook has no text_overlay or emphasis_words")),
        F.when(motion.isin(*STATIC_MOTIONS), F.concat(F.lit("Hook motion_preset='"), motion, F.lit("' is too static"))),
    ))
    rows = df.filter(F.col(order) == 0).withColumn("_p", problems).filter(F.size("_p") > 0)
    severity = F.when((beat != "hook") | (x < 0.3), "critical").otherwise("high")
    return rows.select(*_violation("weak_hook", severity, F.lit(0), F.lit(0), F.size("_p"),
                                   F.concat(F.lit("Weak hook: "), F.array_join("_p", "; ")), key))


VIOLATION_COLUMNS = [K, "check_name", "severity", "first_idx", "last_idx", "n_fixes", "message"]


def retention_violations(df: DataFrame, character: str = "character", arc: str = "arc", max_same_character: int = 3,
                         max_same_arc: int = 4, reveal_gap_limit: float = 30.0, hook_min_intensity: float = 0.6,
                         block_rows: int | None = None) -> DataFrame:
    """All five checks in one long table."""
    parts = [
        same_character(df, character, max_same_character, block_rows=block_rows),
        same_arc(df, arc, max_same_arc, block_rows=block_rows),
        reveal_drought(df, reveal_gap_limit, block_rows=block_rows),
        flat_emotion(df, block_rows=block_rows),
        weak_hook(df, hook_min_intensity),
    ]
    return reduce(DataFrame.unionByName, [p.select(*VIOLATION_COLUMNS) for p in parts])


def grade_by_floor(points: Column) -> Column:
    out = F
    for letter, floor in RETENTION_GRADES:
        out = out.when(points >= floor, letter)
    return out.otherwise("F")


def retention_report(df: DataFrame, violations: DataFrame, key: str = K) -> DataFrame:
    """Score, grade and counts per script; scripts without violations score 1.0.

    Deductions are added in hundredths, so a score on a grade limit does not depend on the
    order of additions.
    """
    cost = F.coalesce(*[F.when(F.col("severity") == s, F.lit(v)) for s, v in DEDUCTION.items()], F.lit(OTHER_DEDUCTION))
    # both inputs are reduced to one row per script before they meet
    found = violations.groupBy(key).agg(
        F.count(F.lit(1)).alias("v"), F.sum("n_fixes").alias("fx"), F.sum(cost).alias("cost"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in DEDUCTION],
        *[F.count_if(F.col("check_name") == c).alias(f"{c}_count")
          for c in ("same_character", "same_arc", "no_reveal_drought", "flat_emotion", "weak_hook")],
    )
    counts = [c for c in found.columns if c.endswith("_count")]
    points = F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.col("cost"), F.lit(0)))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("beat_count")).join(found, key, "left").select(
        key, "beat_count", F.coalesce("v", F.lit(0)).alias("violation_count"), F.coalesce("fx", F.lit(0)).alias("total_fixes"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        (points / 100).alias("score"), grade_by_floor(points).alias("grade"))


# ---- W7, W8, A4: look-back diversity ---------------------------------------------------------

def composition_label(role: str = "visual_role", layout: str = "layout_mode") -> Column:
    part = lambda c, d: F.lower(F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))))
    return F.concat_ws("_", part(role, "character"), part(layout, "safe_subject"))


def repeat_penalty(value: Column, back: list[Column], position: Column) -> Column:
    """Share of look-back values equal to this one plus .10 per unbroken repeat (at most .25)."""
    filled = F.coalesce(value, F.lit(""))
    same = [(F.coalesce(b, F.lit("")) == filled) & (filled != "") for b in back]
    hits = reduce(lambda a, b: a + b, [m.cast("int") for m in same])
    streak = F.lit(0)
    for m in reversed(same):
        streak = F.when(m, streak + 1).otherwise(0)
    seen = F.least(position, F.lit(len(back)))
    return F.when(hits > 0, F.least(F.lit(1.0), hits / seen + F.least(F.lit(0.25), F.lit(0.10) * streak))).otherwise(0.0)


def repetition_columns(df: DataFrame, back: dict[str, list[Column]], threshold: float = 0.7, weights: dict[str, float] | None = None, order: str = O) -> DataFrame:
    """``df`` with penalties, ``repetition_score`` and ``rejected``: d_<dim> of each row against the values ``back`` of the rows before it."""
    weights = weights or DIVERSITY_WEIGHTS
    out = df.withColumns({f"{d}_penalty": repeat_penalty(F.col(f"d_{d}"), b, F.col(order)) for d, b in back.items()})
    total = reduce(lambda a, c: a + c, [F.lit(weights.get(d, 0.25)) * F.col(f"{d}_penalty") for d in back])
    out = out.withColumn("repetition_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3))
    return out.withColumn("rejected", F.col("repetition_score") > threshold)


def diversity_scores(df: DataFrame, dims: dict[str, Column] | None = None, lookback: int = 3, threshold: float = 0.7,
                     weights: dict[str, float] | None = None, key: str = K, order: str = O,
                     block_rows: int | None = None) -> DataFrame:
    """Repetition score of each beat against the ``lookback`` beats before it."""
    lookback = max(1, lookback)
    dims = dims or {"character": F.col("character"), "arc": F.col("arc"),
                    "composition": composition_label(), "emotion": F.col("emotion")}
    b = Blocks.dense(df, key, order, block_rows).select(**{f"d_{d}": c for d, c in dims.items()})
    b = b.neighbours(**{f"_{d}{n}": (f"d_{d}", -n) for d in dims for n in range(1, lookback + 1)})
    i = F.col(order)
    out = repetition_columns(b.df, {d: [F.col(f"_{d}{n}") for n in range(1, lookback + 1)] for d in dims}, threshold, weights, order)
    hints = [F.when(F.col("rejected"), F.lit(REJECTED_NOTE))] + [
        F.when(F.col(f"{d}_penalty") > 0, pick(SUGGESTIONS[d], i)) for d in dims if d in SUGGESTIONS]
    notes = []
    for d in dims:
        p, v = F.col(f"{d}_penalty"), F.col(f"d_{d}")
        seen = F.least(i, F.lit(lookback))
        text = {
            "character": F.concat(F.lit("Same character '"), v, F.lit("' repeated in "), F.floor(p * seen).cast("string"),
                                  F.lit("/"), seen.cast("string"), F.lit(" recent beats")),
            "arc": F.concat(F.lit("Same arc/location '"), v, F.lit("' repeated")),
        }.get(d, F.concat(F.lit(f"Same {d} '"), v, F.lit("' repeated")))
        notes.append(F.when(p > 0, text))
    notes = F.array_compact(F.array(*notes))
    notes = F.when(i == 0, F.array(F.lit("Opening beat — no repetition possible"))).when(
        F.size(notes) == 0, F.array(F.lit("Good visual diversity — no repetition detected"))).otherwise(notes)
    drop = [f"_{d}{n}" for d in dims for n in range(1, lookback + 1)]
    return out.withColumns({"suggestions": F.array_compact(F.array(*hints)), "notes": notes}).drop(*drop)


def diversity_of_latest(df: DataFrame, key: str = K, order: str = O, lookback: int = 3, **kw) -> DataFrame:
    """Score of the newest beat of each script only: earlier rows beyond the look-back are cut first."""
    last = df.groupBy(key).agg(F.max(order).alias("_last"))
    tail = df.join(last, key).filter(F.col(order) >= F.col("_last") - lookback)
    scored = diversity_scores(tail, key=key, order=order, lookback=lookback, **kw)
    return scored.filter(F.col(order) == F.col("_last")).drop("_last")


def diversity_summary(scored: DataFrame, key: str = K, order: str = O) -> DataFrame:
    s = F.col("repetition_score")
    mean = F.avg(s)
    grade = F
    for letter, top in DIVERSITY_GRADES:
        grade = grade.when(F.col("_mean") <= top, letter)
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("beat_count"), F.count_if("rejected").alias("rejected_count"),
        mean.alias("_mean"), F.max(s).alias("max_repetition"), F.min(s).alias("min_repetition"),
    ).select(key, "beat_count", "rejected_count", F.round("_mean", 3).alias("mean_repetition"), "max_repetition",
             "min_repetition", grade.otherwise("F").alias("diversity_grade"))


def diversity_distribution(scored: DataFrame, dims=("character", "composition", "arc"), top: int = 5,
                           key: str = K, order: str = O) -> DataFrame:
    """Most used values per script and dimension; ties keep the value seen first."""
    from pyspark.sql import Window

    long = scored.select(key, order, F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(f"d_{d}").alias("label")) for d in dims])).alias("p"))
    counts = long.filter(F.coalesce(F.col("p.label"), F.lit("")) != "").groupBy(key, "p.dimension", "p.label").agg(
        F.count(F.lit(1)).alias("uses"), F.min(order).alias("first_idx"))
    w = Window.partitionBy(key, "dimension").orderBy(F.desc("uses"), "first_idx")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


# ---- W10, W11: per-slide scores -----------------------------------------------------------------

def simple_diversity(df: DataFrame, query: str = "query", role: str = "visual_role", entities: str = "entities",
                     key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """1 minus .35 query repeat, .22 role in all of the last three, .15 same entity set."""
    top3 = F.array_sort(F.array_distinct(F.slice(F.coalesce(F.col(entities), F.array().cast("array<string>")), 1, 3)))
    b = Blocks.dense(df, key, order, block_rows).select(_q=_low(query), _r=_low(role), _e=top3)
    b = b.neighbours(**{f"{c}{n}": (c, -n) for c in ("_q", "_r", "_e") for n in (1, 2, 3)})
    i = F.col(order)
    q = reduce(lambda a, c: a | c, [F.coalesce(F.col(f"_q{n}") == F.col("_q"), F.lit(False)) for n in (1, 2, 3)])
    r = reduce(lambda a, c: a & c, [F.coalesce(F.col(f"_r{n}") == F.col("_r"), i < n) for n in (1, 2, 3)])
    empty = F.array().cast("array<string>")
    union = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.col(f"_e{n}"), empty) for n in (1, 2, 3)])))
    flags = {"query_repeats": (F.col("_q") != "") & q & (i > 0), "role_overused": (F.col("_r") != "") & r & (i > 0),
             "same_entities": (F.size("_e") > 0) & (F.col("_e") == union) & (i > 0)}
    score = F.lit(1.0) - flags["query_repeats"].cast("int") * F.lit(0.35) - flags["role_overused"].cast("int") * F.lit(0.22) \
        - flags["same_entities"].cast("int") * F.lit(0.15)
    names = {"query_repeats": "query repeats nearby", "role_overused": "visual role is overused", "same_entities": "same entity cluster"}
    notes = F.array_compact(F.array(*[F.when(flags[f], F.lit(t)) for f, t in names.items()]))
    note = F.when(i == 0, "Opening visual establishes the palette.").when(
        F.size(notes) == 0, "role/query/entity mix changes from nearby slides").otherwise(F.array_join(notes, "; "))
    drop = ["_q", "_r", "_e"] + [f"{c}{n}" for c in ("_q", "_r", "_e") for n in (1, 2, 3)]
    return b.df.withColumns({"visual_diversity_score": F.round(score, 2), "diversity_notes": note}).drop(*drop)


def slide_retention(df: DataFrame, key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """Per-slide retention score and the edits it triggers (expects a diversity score)."""
    b = Blocks.dense(df, key, order, block_rows).scan(totals={"_n": ("count", F.lit(1))})
    i, beat, layout = F.col(order), F.col("beat_type"), F.col("layout_mode")
    # a zero diversity or intensity counts as missing, as for any falsy value
    div = F.coalesce(F.nullif(F.col("visual_diversity_score"), F.lit(0.0)), F.lit(0.7))
    x = F.coalesce(F.nullif(F.col("intensity"), F.lit(0.0)), F.lit(0.4))
    score = F.lit(0.45) + F.when(beat.isin("hook", "reveal", "payoff"), 0.18).otherwise(0.08) + F.lit(0.14) * div + F.lit(0.12) * x
    no_overlay = F.coalesce(F.col("text_overlay"), F.lit("")) == ""
    low = div < 0.55
    swap = low & ~F.coalesce(F.col("motion_preset"), F.lit("")).isin("title_card_hold", "reveal_zoom")
    actions = F.array_compact(F.array(
        F.when((i == 0) & no_overlay, F.lit("added hook overlay")),
        F.when((beat == "hook") & (layout == "safe_subject"), F.lit("converted hook to readable title_card")),
        F.when(low, F.lit("flagged nearby visual repetition")),
        F.when((F.col("_n") > 1) & (i == F.col("_n") - 1) & (beat != "cta"), F.lit("final slide should resolve or invite response")),
    ))
    overlay = clean_prompt(F.col("summary"), 56)
    return b.df.withColumns({
        "retention_score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2), "retention_actions": actions,
        "text_overlay": F.when((i == 0) & no_overlay, overlay).otherwise(F.col("text_overlay")),
        "layout_mode": F.when((beat == "hook") & (layout == "safe_subject"), "title_card").otherwise(layout),
        "motion_preset": F.when(swap, F.when(beat == "reveal", "reveal_zoom").otherwise("subject_push")).otherwise(F.col("motion_preset")),
    }).drop("_n")


# ---- W15, A11, P7, A12: gates --------------------------------------------------------------------

def gate_issues(df: DataFrame, score: str = "emotion_score", score_scale: float = 100.0, asset: str = "asset_id",
                transition: str = "transition_type", motion: str = "motion_preset", key: str = K, order: str = O,
                block_rows: int | None = None) -> DataFrame:
    """Long reveals, weak hooks, low-energy streaks and repeats of the previous beat."""
    s = F.coalesce(F.col(score), F.lit(0.0)) * F.lit(100.0 / score_scale)
    b = Blocks.dense(df, key, order, block_rows).select(_s=s)
    b = b.neighbours(_pa=(asset, -1), _pt=(transition, -1), _pm=(motion, -1))
    b = b.scan(running={"_reset": ("last", F.when(F.col("_s") >= 30, F.col(order)))})
    i = F.col(order)
    streak = F.when(F.col("_s") < 30, i - F.coalesce(F.col("_reset"), F.lit(-1))).otherwise(0)
    beat = F.upper(F.coalesce(F.col("beat_type"), F.lit("")))
    dur = F.coalesce(F.col("duration"), F.lit(0.0)) if "duration" in df.columns else F.col("end_s") - F.col("start_s")
    same = lambda now, prev: (F.coalesce(F.col(now), F.lit("")) != "") & (F.col(now) == F.col(prev))

    def issue(cond, severity, rule, detail):
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.alias("detail")))

    found = F.array_compact(F.array(
        issue((beat == "REVEAL") & (dur > 8.0), "ERROR", "reveal_too_long", F.lit("Maximum allowed is 8s.")),
        issue((beat == "HOOK") & (F.col("_s") < 70), "WARNING", "hook_too_weak", F.lit("Should be >= 70.")),
        issue(streak > 2, "WARNING", "low_energy_streak", F.concat(F.lit("streak of "), streak)),
        issue(same(asset, "_pa"), "WARNING", "repeated_asset", F.col(asset)),
        issue(same(transition, "_pt"), "INFO", "repeated_transition", F.col(transition)),
        issue(same(motion, "_pm"), "INFO", "repeated_motion", F.col(motion)),
    ))
    return b.df.select(key, i.alias(order), F.explode(found).alias("q")).select(key, order, "q.*")


def gate_verdict(df: DataFrame, issues: DataFrame, failing: str = "ERROR", key: str = K) -> DataFrame:
    """passed = no issue of the failing severity; issue-free scripts pass."""
    bad = issues.groupBy(key).agg(F.count(F.lit(1)).alias("i"), F.count_if(F.col("severity") == failing).alias("f"))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("beat_count")).join(bad, key, "left").select(
        key, "beat_count", F.coalesce("i", F.lit(0)).alias("issue_count"), F.coalesce("f", F.lit(0)).alias("failing_count"),
        (F.coalesce("f", F.lit(0)) == 0).alias("passed"))


REQUIRED_DEFAULTS = {"beat_type": "neutral", "visual_role": "character", "motion_preset": "static_hold"}


def autofix(df: DataFrame) -> DataFrame:
    """Required keys filled with their defaults."""
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in REQUIRED_DEFAULTS.items()})


def required_key_issues(df: DataFrame, key: str = K, order: str = O) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    row = lambda cond, sev, msg: F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(msg).alias("detail")))
    found = [row(blank(c), "warning", f"Missing {c}. Auto-fixed to '{d}'.") for c, d in REQUIRED_DEFAULTS.items()]
    found.append(row(blank("subtitle_text") & blank("summary"), "critical", "Beat has no subtitle_text and no summary."))
    found.append(row(F.col("start_s").isNull() | F.col("end_s").isNull(), "warning", "Missing start_time or end_time."))
    return df.select(key, order, F.explode(F.array_compact(F.array(*found))).alias("q")).select(key, order, "q.*")


def visual_quality_report(df: DataFrame, wide: bool = True, query: str = "query", transition: str = "transition_type",
                          image: str = "image_path", confidence: str = "asset_confidence", key: str = K, order: str = O,
                          block_rows: int | None = None) -> DataFrame:
    """Counts that decide whether a storyboard needs a review, one row per script."""
    hold = 8.0 if wide else 5.5
    runs = label_runs(df.withColumn("_q", _low(query)), "_q", key, order, block_rows)
    n, events = F.col("slide_count"), F.col("transition_count")
    report = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("slide_count"),
        F.count_if((F.col("_q") != "") & (F.col("run_pos") >= 2)).alias("repeated_query_hits"),
        F.count_if(F.col("end_s") - F.col("start_s") > hold).alias("overlong_holds"),
        F.count_if((F.coalesce(F.col(image), F.lit("")) == "") & (F.col("_q") == "")).alias("missing_assets"),
        F.count_if(F.coalesce(F.nullif(F.col(confidence), F.lit(0.0)), F.lit(1.0)) < 0.55).alias("low_confidence"),
        F.count_if((F.col(order) > 0) & ~F.coalesce(F.lower(transition), F.lit("")).isin("", "none")).alias("transition_count"),
    ).withColumn("transition_dense", events > F.greatest(F.lit(2.0), n * F.lit(0.85)))
    risky = (F.col("repeated_query_hits") + F.col("overlong_holds") + F.col("missing_assets") + F.col("low_confidence") > 0)
    return report.withColumn("status", F.when(risky | F.col("transition_dense"), "review").otherwise("ok"))
