"""Timed intervals: overlap and nearest joins, gaps, repair, merging, cue preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.operators.ordered import Blocks, number_rows
from storyspark.session import packed

K, O = "script_id", "idx"

# fixed values: summaries that only lead over to the next slide
FILLER_PHRASES = ["get this.", "it's both.", "trick question.", "but here's the question.", "but that's not all.",
                  "trick question", "get this", "it's both", "but here's the question", "but that's not all"]
LONG_FORM_LABELS = ["serious", "happy", "excited", "angry", "surprised", "sad", "worried", "smirking", "confident",
                    "intense", "embarrassed"]


def joined_text(order: Column, text: Column, sep: str = " ") -> Column:
    """Texts of a group in order; meant for groups that are one output value."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), sep)


# ---- J6, J7: overlap and nearest joins ------------------------------------------------------

#: Least level: intervals up to a quarter of a second share it.  Times beyond FAR share their outermost cells.
LEAST_LEVEL, FAR = -2, 1e15


def _level(start: Column, end: Column) -> Column:
    """Exponent of the least power of two that is as long as the interval."""
    return F.greatest(F.ceil(F.log2(F.greatest(F.least(F.abs(end - start), F.lit(FAR)), F.lit(2.0**LEAST_LEVEL)))), F.lit(LEAST_LEVEL)).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(F.greatest(F.least(at, F.lit(FAR)), F.lit(-FAR)) / F.pow(F.lit(2.0), level)).cast("long")


def overlap_pairs(lines: DataFrame, slides: DataFrame, key: str = K) -> DataFrame:
    """Pairs of line and slide that overlap in time.

    Time is cut into cells of 2 ** n seconds at every level n.  An interval belongs to the level of its
    own length, where it touches two cells, or three.  A line meets the slides of its level and of
    all longer ones in those cells, a slide the longer lines in theirs; levels without an interval
    are left out.  So an interval is a few rows a level however long it is, and a wrong end costs as
    much as a right one.  A pair is kept only in the first cell both touch.
    ``lines`` / ``slides`` need start_s and end_s (rows without either overlap nothing); all their other columns are prefixed l_ / s_.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        first, last = F.least("start_s", "end_s"), F.greatest("start_s", "end_s")
        cols = [F.col(key)] + [F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key]
        return df.filter(F.col("start_s").isNotNull() & F.col("end_s").isNotNull()).select(
            *cols, first.alias(f"_{p}0"), last.alias(f"_{p}1"), _level(F.col("start_s"), F.col("end_s")).alias(f"_{p}n"))

    def present(df: DataFrame, p: str) -> DataFrame:
        return F.broadcast(df.agg(F.sort_array(F.collect_set(f"_{p}n")).alias("_levels")))  # one row of some fifty numbers at most

    def touched(df: DataFrame, p: str) -> DataFrame:
        """One row for each cell at ``_at``; ``_{p}c`` is the first of them."""
        first = _cell(F.col(f"_{p}0"), F.col("_at"))
        spread = df.withColumn(f"_{p}c", first).withColumn("_cell", F.explode(F.sequence(first, _cell(F.col(f"_{p}1"), F.col("_at")))))
        return spread.drop(f"_{p}0", f"_{p}1", f"_{p}n")  # only what the pair needs goes to its cells

    # each side is read three times: once for its levels, and in both directions
    left, right = packed(side(lines, "l")), packed(side(slides, "s"))
    levels = {"l": present(left, "l"), "s": present(right, "s")}

    def meet(small: DataFrame, sp: str, large: DataFrame, lp: str, same: bool) -> DataFrame:
        """Intervals of ``large`` in the cells of their own level, and those of ``small`` in the cells of all levels above their own (and at it, if ``same``)."""
        up = F.filter("_levels", lambda n: n >= F.col(f"_{sp}n") if same else n > F.col(f"_{sp}n"))
        searching = touched(small.crossJoin(levels[lp]).withColumn("_at", F.explode(up)).drop("_levels"), sp)
        staying = touched(large.withColumn("_at", F.col(f"_{lp}n")), lp)
        return searching.join(staying, [key, "_at", "_cell"])

    helpers = ["_at", "_cell", "_lc", "_sc"]
    joined = meet(left, "l", right, "s", True).unionByName(meet(right, "s", left, "l", False))
    return joined.filter((F.col("l_end_s") > F.col("s_start_s")) & (F.col("l_start_s") < F.col("s_end_s"))
                         & (F.col("_cell") == F.greatest("_lc", "_sc"))).drop(*helpers)


def overlapping_lines(lines: DataFrame, slides: DataFrame, key: str = K, order: str = O) -> DataFrame:
    """(key, slide, position, line, text): the lines of each slide in time order, one row each.

    The long form of ``overlapping_text``: a slide over a whole script is many rows, numbered in blocks.
    """
    said = lines.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).filter("text <> ''")
    pairs = overlap_pairs(said.select(key, order, "start_s", "end_s", "text"), slides.select(key, order, "start_s", "end_s"), key)
    rows = pairs.select(key, F.col(f"s_{order}").alias(order), F.col("l_start_s").alias("_from"), F.col(f"l_{order}").alias("line"), F.col("l_text").alias("text"))
    return number_rows(rows, [key, order], ["_from", "line"], out="position").drop("_from")


def overlapping_text(lines: DataFrame, slides: DataFrame, key: str = K, order: str = O) -> DataFrame:
    """Slide with the text of its lines in time order; slides without lines keep an empty text."""
    said = lines.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).filter("text <> ''")
    pairs = overlap_pairs(said.select(key, order, "start_s", "end_s", "text"), slides.select(key, order, "start_s", "end_s"), key)
    text = pairs.groupBy(key, F.col(f"s_{order}").alias(order)).agg(
        joined_text(F.struct("l_start_s", f"l_{order}"), F.col("l_text")).alias("_text"), F.count(F.lit(1)).alias("_n"))
    return slides.join(text, [key, order], "left").withColumns({
        "subtitle_text": F.coalesce("_text", F.lit("")), "line_count": F.coalesce("_n", F.lit(0))}).drop("_text", "_n")


def snap_to_nearest(points: DataFrame, starts: DataFrame, value: str = "start_s", tolerance: float = 0.18, key: str = K,
                    order: str = O, out: str = "snapped") -> DataFrame:
    """Point moved to the nearest start within the tolerance; equal distance takes the earlier one.

    Starts are reduced to distinct values; point and start meet on tolerance-wide buckets.
    """
    cell = lambda c: F.floor(c / tolerance).cast("long")
    near = starts.select(key, F.col("start_s").alias("_s")).distinct().withColumn("_cell", cell(F.col("_s")))
    at = F.col(value)
    probe = points.select(key, order, at.alias("_v"), F.explode(F.array(*[cell(at) + n for n in (-1, 0, 1)])).alias("_cell"))
    gap = F.abs(F.col("_s") - F.col("_v"))
    best = probe.join(near, [key, "_cell"]).filter(gap <= tolerance).groupBy(key, order).agg(
        F.min_by("_s", F.struct(gap, F.col("_s"))).alias("_best"))
    return points.join(best, [key, order], "left").withColumn(out, F.coalesce("_best", at)).drop("_best")


# ---- J8: aligning model cues with subtitle lines --------------------------------------------------

def align_cues(lines: DataFrame, cues: DataFrame, max_shift: float = 2.0, narrator: str = "narrator", key: str = K, order: str = O,
               block_rows: int | None = None) -> DataFrame:
    """Label and character for every line; line times win over cue times.

    The n-th line of a text takes the n-th cue of that text; a line left over takes the unused
    cue at its own position if that starts within ``max_shift`` seconds.  Each cue is used at
    most once.  All text matches are made before positions are used (the published loop lets a
    position take a cue that a later line's text would have matched).
    """
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"\s+", " ")))
    said = number_rows(lines.withColumn("_t", plain), [key, "_t"], [order], "_k", block_rows)
    given = cues.select(key, F.col(order).alias("_j"), plain.alias("_t"), F.col("start_s").alias("_cs"), F.lower(F.trim("expression")).alias("_e"), F.lower(F.trim("character")).alias("_c"))
    given = number_rows(given, [key, "_t"], ["_j"], "_k", block_rows)
    texts = given.filter("_t <> ''").select(key, "_t", "_k", F.col("_j").alias("_jt"), F.col("_e").alias("_et"), F.col("_c").alias("_ct"))
    first = said.join(texts, [key, "_t", "_k"], "left")
    used = first.filter("_jt IS NOT NULL").select(key, F.col("_jt").alias("_j"))
    spare = given.join(used, [key, "_j"], "left_anti").select(key, F.col("_j").alias(order), "_cs", "_e", "_c")
    both = first.join(spare, [key, order], "left")
    by_place = F.col("_jt").isNull() & (F.abs(F.col("_cs") - F.col("start_s")) <= max_shift)
    pick = lambda t, p, d: F.coalesce(F.nullif(F.when(F.col("_jt").isNotNull(), F.col(t)).when(by_place, F.col(p)), F.lit("")), F.lit(d))
    return both.withColumns({"expression": pick("_et", "_e", "neutral"), "character": pick("_ct", "_c", narrator)}).select(
        *[c for c in lines.columns if c not in ("expression", "character")], "expression", "character")


# ---- W20 - W22: gaps and repair -----------------------------------------------------------------

def fill_gaps(df: DataFrame, total: str = "total_s", key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """Placeholder rows before late starts and after the last end; ``kind`` tells them apart."""
    b = Blocks.dense(df, key, order, block_rows).neighbours(_end=("end_s", -1)).scan(totals={"_n": ("count", F.lit(1))})
    before, i = F.coalesce(F.col("_end"), F.lit(0.0)), F.col(order)
    piece = lambda cond, kind, s, e: F.when(cond, F.struct(F.lit(kind).alias("kind"), s.alias("start_s"), e.alias("end_s")))
    start, end, stop = F.col("start_s"), F.col("end_s"), F.col(total)
    parts = F.array_compact(F.array(
        piece(start > before, "Silence/Transition", before, start),
        piece(F.lit(True), "slide", start, end),
        piece((i == F.col("_n") - 1) & (end < stop), "Ending/Outro", end, stop)))
    return b.df.select(key, order, F.explode(parts).alias("p")).select(key, order, "p.*")


def repair_cuts(df: DataFrame, cut: str = "snapped", total: str = "total_s", key: str = K, order: str = O,
                step: float = 0.05, block_rows: int | None = None) -> DataFrame:
    """Contiguous cuts: first at 0, each at least ``step`` after the one before, ends at the next cut.

    cut_i = step*i + running max of (min(cut, total) - step*i), with 0 at i = 0; the first cut
    may push later ones but is never past them, so one running maximum is enough.
    """
    i = F.col(order)
    stop = F.greatest(F.col(total), F.lit(0.0))
    lift = F.when(i == 0, F.lit(0.0)).otherwise(F.least(F.col(cut), stop) - F.lit(step) * i)
    b = Blocks.dense(df, key, order, block_rows).scan(running={"_m": ("max", lift)})
    b = Blocks.dense(b.df.withColumn("new_start", F.lit(step) * i + F.col("_m")), key, order, block_rows)
    b = b.neighbours(_next=("new_start", 1))
    end = F.coalesce(F.col("_next"), stop)
    fixed = F.when(end <= F.col("new_start"), F.least(stop, F.col("new_start") + step)).otherwise(end)
    return b.df.withColumn("new_end", fixed).drop("_m", "_next")


def trim_overlaps(df: DataFrame, text: str = "text", key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """End moved to 1 ms before the next start when they overlap; empty texts dropped afterwards."""
    b = Blocks.dense(df, key, order, block_rows).neighbours(_next=("start_s", 1))
    end = F.when(F.col("end_s") > F.col("_next"), F.col("_next") - 0.001).otherwise(F.col("end_s"))
    return b.df.withColumns({"end_s": end, text: F.trim(F.coalesce(F.col(text), F.lit("")))}).filter(F.col(text) != "").drop("_next")


# ---- W23 - W25: merging neighbours -----------------------------------------------------------------

def merge_same(df: DataFrame, same_on: list[str], text: str = "text", key: str = K, order: str = O,
               block_rows: int | None = None) -> DataFrame:
    """Consecutive rows with equal ``same_on`` values become one row with the texts joined."""
    b = Blocks.dense(df, key, order, block_rows).neighbours(**{f"_{c}": (c, -1) for c in same_on})
    same = F.lit(True)
    for c in same_on:
        same = same & (F.col(f"_{c}") == F.col(c))
    return b.runs(same & (F.col(order) > 0)).df.groupBy(key, "run_start", *same_on).agg(
        F.count(F.lit(1)).alias("merged_rows"), joined_text(F.col(order), F.col(text)).alias(text))


def merge_cues(df: DataFrame, label: str = "expression", slack: float = 0.05, key: str = K, order: str = O,
               block_rows: int | None = None) -> DataFrame:
    """Consecutive cues of one label that touch; the merged end is the last cue's end, not the latest."""
    b = Blocks.dense(df, key, order, block_rows).neighbours(_l=(label, -1), _e=("end_s", -1))
    same = (F.lower(F.col("_l")) == F.lower(F.col(label))) & (F.col("start_s") <= F.col("_e") + slack)
    return b.runs(same).df.groupBy(key, "run_start").agg(
        F.min_by(label, order).alias(label), F.min_by("start_s", order).alias("start_s"),
        F.max_by("end_s", order).alias("end_s"), F.count(F.lit(1)).alias("merged_rows"))


def absorb_fillers(df: DataFrame, summary: str = "summary", phrases: list[str] | None = None, key: str = K, order: str = O,
                   block_rows: int | None = None) -> DataFrame:
    """Filler rows lengthen the kept row before them; fillers at the start disappear."""
    low = F.lower(F.trim(F.coalesce(F.col(summary), F.lit(""))))
    filler = F.lit(False)
    for p in phrases or FILLER_PHRASES:
        filler = filler | low.contains(p)
    b = Blocks.dense(df, key, order, block_rows).scan(running={"_keep": ("last", F.when(~filler, F.col(order)))})
    return b.df.filter(F.col("_keep").isNotNull()).groupBy(key, F.col("_keep").alias(order)).agg(
        F.min_by(summary, order).alias(summary), F.min_by("start_s", order).alias("start_s"),
        F.max_by("end_s", order).alias("end_s"), (F.count(F.lit(1)) - 1).alias("absorbed"))


# ---- W26 - W28, W29 core: intervals and cues ---------------------------------------------------------

def merge_intervals(df: DataFrame, gap: float = 0.15, drop_invalid: bool = True, key: list[str] | str = K, order: str = O,
                    block_rows: int | None = None) -> DataFrame:
    """Overlapping or near intervals joined; source_count rows each."""
    key = [key] if isinstance(key, str) else list(key)
    rows = df.filter(F.col("end_s") > F.col("start_s")) if drop_invalid else df
    b = Blocks.adaptive(rows, key, ["start_s", order], block_rows).scan(running={"_seen": ("max", "end_s", "before")})
    new = F.col("_seen").isNull() | (F.col("start_s") > F.col("_seen") + gap)
    b = b.scan(running={"_island": ("last", F.when(new, F.struct("start_s", order)))})
    return b.df.groupBy(*key, "_island").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("source_count")).drop("_island")


def sanitize_intervals(df: DataFrame, max_s: float = 8.0, key: list[str] | str = K, order: str = O,
                       block_rows: int | None = None) -> DataFrame:
    """Clamp an end past the next start, cap the length, drop empty ones (they still count as next)."""
    key = [key] if isinstance(key, str) else list(key)
    b = Blocks.adaptive(df, key, ["start_s", order], block_rows).numbered("_pos").neighbours(_next=("start_s", 1))
    s, e, n = F.col("start_s"), F.col("end_s"), F.col("_next")
    end = F.when(e > n, F.greatest(s + 0.05, n - 0.01)).otherwise(e)
    end = F.when(end - s > max_s, s + max_s).otherwise(end)
    return b.df.filter(e > s).withColumns({"end_s": F.round(end, 3), "start_s": F.round(s, 3)}).drop("_pos", "_next")


def prepare_cues(df: DataFrame, label: str = "expression", who: str = "character", narrator: str = "narrator",
                 wide: bool = False, gap: float = 0.85, key: str = K, order: str = O, block_rows: int | None = None) -> DataFrame:
    """Neutral and empty cues dropped; per character a repeated label is one cue.

    A repeat extends the kept cue while it starts within ``gap`` of its end; after the first
    larger pause the rest of that label run is ignored.
    """
    rows = df.withColumns({
        label: F.lower(F.trim(F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("neutral")))),
        who: F.lower(F.trim(F.coalesce(F.nullif(F.col(who), F.lit("")), F.lit(narrator))))})
    rows = rows.filter((F.col(label) != "neutral") & (F.col("end_s") > F.col("start_s")))
    if wide:
        return rows.filter(F.col(label).isin(LONG_FORM_LABELS)).select(
            key, who, label, "start_s", "end_s", F.lit(1).cast("long").alias("cue_rows"))
    b = Blocks.adaptive(rows, [key, who], ["start_s", order], block_rows).numbered("_pos")
    b = b.neighbours(_l=(label, -1), _e=("end_s", -1)).runs(F.col("_l") == F.col(label), "_run")
    broken = (F.col("_pos") > F.col("_run")) & (F.col("start_s") > F.col("_e") + gap)
    b = b.scan(running={"_cut": ("last", F.when(broken, F.col("_pos")))})
    kept = b.df.filter(F.col("_cut").isNull() | (F.col("_cut") < F.col("_run")))
    return kept.groupBy(key, who, "_run").agg(
        F.min_by(label, "_pos").alias(label), F.min("start_s").alias("start_s"), F.max_by("end_s", "_pos").alias("end_s"),
        F.count(F.lit(1)).alias("cue_rows")).drop("_run")


def as_of(left: DataFrame, right: DataFrame, value: str, at: str = "start_s", right_at: str = "start_s", nxt: bool = False,
          key: str = K, out: str = "found", block_rows: int | None = None) -> DataFrame:
    """Latest right value at or before (``nxt``: earliest strictly after) each left row, by a merged scan."""
    sign = -1.0 if nxt else 1.0
    # at equal times a right row must come first looking back, and last looking ahead
    pack = [F.col(c) for c in left.columns]
    a = left.select(key, (F.col(at) * sign).cast("double").alias("_t"), F.lit(0.0 if nxt else 1.0).alias("_side"),
                    F.struct(*pack).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    z = right.select(key, (F.col(right_at) * sign).cast("double").alias("_t"), F.lit(1.0 if nxt else 0.0).alias("_side"),
                     F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    b = Blocks.adaptive(a.unionByName(z), key, ["_t", "_side"], block_rows).scan(running={"_hit": ("last", "_v")})
    return b.df.filter(F.col("_row").isNotNull()).select("_row.*", F.col("_hit").alias(out))
