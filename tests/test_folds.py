"""Sequential folds: against plain loops, and the same answer with keys cut into small blocks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from storyspark.functions import text
from storyspark.operators import curve, folds, planners
from storyspark.operators.ordered import number_rows

N = 90


def beats(spark, seed=1, scripts=("a", "b")):
    rng = random.Random(seed)
    rows, t = [], {s: 0.0 for s in scripts}
    for _ in range(N):
        s = rng.choice(scripts + (scripts[0],) * 2)
        t[s] += rng.random() * 4
        rows.append((s, t[s], t[s] + rng.random() * 5, rng.choice(["hook", "reveal", "evidence", "escalation", "cta", "payoff"]),
                     rng.choice(["fear", "rage", "calm", "neutral", "revelation"]), rng.random(), rng.choice(["character", "symbol"]),
                     rng.choice(["crossfade", "zoom_dissolve", "fade", "none", "iris_wipe"]), " ".join(["word"] * rng.randrange(1, 6)) + rng.choice(["", ".", " then"])))
    df = spark.createDataFrame(rows, "script_id string, start_s double, end_s double, beat_type string, emotion string, intensity double, visual_role string, transition string, text string")
    return number_rows(df, "script_id", ["start_s"])


def table(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


FOLDS = {
    "smooth": (lambda d, n: curve.smooth_curve(d.withColumns({"score": F.col("intensity"), "spike": F.col("beat_type").isin("hook", "reveal", "payoff"), "beat_count": F.lit(N)}), block_rows=n), ("script_id", "idx", "score")),
    "motion": (lambda d, n: planners.plan_motion(d, block_rows=n), ("script_id", "idx", "style", "reasoning")),
    "transitions": (lambda d, n: planners.plan_transitions(d.withColumn("emotion_score", F.lit(50.0)), block_rows=n), ("script_id", "idx", "transition_type")),
    "sounds": (lambda d, n: planners.plan_sounds(d.withColumn("time_s", F.col("start_s")), d.sparkSession.createDataFrame(
        [(s,) for s in planners.GENTLE_SOUNDS + planners.IMPACT_SOUNDS], "stem string"), block_rows=n), ("script_id", "idx", "stem")),
    "overlaps": (lambda d, n: planners.drop_overlapping(d, block_rows=n), ("script_id", "idx", "end_s")),
}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_blocks_do_not_change_the_fold(spark, name):
    run, cols = FOLDS[name]
    d = beats(spark)
    assert table(run(d, None), *cols) == table(run(d, 16), *cols)


def per_script(d, *cols):
    out = {}
    for r in sorted(d.collect(), key=lambda r: (r.script_id, r.idx)):
        out.setdefault(r.script_id, []).append(tuple(r[c] for c in cols))
    return out


def test_drop_overlapping_loop(spark):
    d = beats(spark, 2)
    want = []
    for s, rows in per_script(d, "idx", "start_s", "end_s").items():
        last = -1.0
        for i, a, z in rows:
            if last - a > 0.1:
                continue
            want.append((s, i))
            last = max(last, z)
    assert table(planners.drop_overlapping(d), "script_id", "idx") == sorted(want)


def test_group_short_lines_loop(spark):
    d = beats(spark, 3)
    want = []
    for s, rows in per_script(d, "idx", "text").items():
        i = 0
        while i < len(rows):
            first, words, body = rows[i][0], len(rows[i][1].split()), rows[i][1]
            i += 1
            while words < 3 and i < len(rows):
                body += " " + rows[i][1]
                words = len(body.split())
                i += 1
            want.append((s, first, body))
    assert table(planners.group_short_lines(d), "script_id", "idx", "text") == sorted(want)


def test_chunk_lines_loop(spark):
    d = beats(spark, 4)
    want = []
    for s, rows in per_script(d, "start_s", "end_s", "text").items():
        done, cur = [], []
        for line in rows:
            if cur and line[1] - cur[0][0] > 5.5:
                done.append(cur)
                cur = [line]
                continue
            cur.append(line)
            length = line[1] - cur[0][0]
            if length >= 1.6 and line[2].strip().endswith((".", "!", "?")):
                done.append(cur)
                cur = []
            elif length >= 5.5 * 0.8 and "then" in " ".join(x[2] for x in cur):
                done.append(cur)
                cur = []
        if cur:
            if done and cur[-1][1] - cur[0][0] < 1.6:
                done[-1] += cur
            else:
                done.append(cur)
        want += [(s, n, c[0][0], c[-1][1], len(c)) for n, c in enumerate(done)]
    assert table(planners.chunk_lines(d), "script_id", "chunk", "start_s", "end_s", "line_count") == sorted(want)


def test_motion_invariants(spark):
    for s, rows in per_script(planners.plan_motion(beats(spark, 5)), "style").items():
        styles = [r[0] for r in rows]
        assert all(not (a == b == c) for a, b, c in zip(styles, styles[1:], styles[2:]))
        assert styles.count("reveal_zoom") <= max(2, int(len(styles) * 0.3))


def test_group_words_stop_at_gap(spark):
    w = spark.createDataFrame([("s", i, i * 1.0, i + 0.9, f"w{i}") for i in range(9)], "script_id string, idx long, start_s double, end_s double, word string")
    gaps = spark.createDataFrame([("s", 2.95), ("s", 7.5)], "script_id string, start_s double")
    assert [r[2] for r in table(planners.group_words(w, gaps), "script_id", "idx", "text")] == ["w0 w1 w2", "w3 w4 w5 w6", "w7", "w8"]


def test_text_folds_against_loops(spark):
    rng = random.Random(9)
    docs = [" ".join(" ".join(rng.choice(["a", "bb", "ccc", "dddd"]) for _ in range(rng.randrange(1, 9))) + rng.choice(".!?") for _ in range(rng.randrange(1, 14))) for _ in range(30)]

    def segments(t):
        out, cur, n = [], [], 0
        for s in [x for x in re.split(r"(?<=[.!?])\s+", t) if x]:
            w = len(s.split())
            if cur and n >= 7 and n + w > 16:
                out.append(" ".join(cur))
                cur, n = [], 0
            cur.append(s)
            n += w
            if n >= 16:
                out.append(" ".join(cur))
                cur, n = [], 0
        if cur:
            if out and n < 7:
                out[-1] += " " + " ".join(cur)
            else:
                out.append(" ".join(cur))
        return out

    def wrap(t):
        lines, cur = [], []
        for w in t.split():
            if cur and len(" ".join(cur + [w])) > 28:
                lines.append(" ".join(cur))
                cur = [w]
            else:
                cur.append(w)
        if cur:
            lines.append(" ".join(cur))
        return "\\N".join([lines[0], " ".join(lines[1:])] if len(lines) > 2 else lines)

    def chunks(t, size=40, keep=1):
        out, cur, n = [], [], 0
        for s in re.split(r"(?<=[.!?])\s+", t):
            if n + len(s) > size and cur:
                out.append(" ".join(cur))
                held = " ".join(cur[-keep:])
                cur, n = [held], len(held)
            cur.append(s)
            n += len(s)
        return out + ([" ".join(cur)] if cur else [])

    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id int, text string")
    c = F.col("text")
    got = d.select("id", text.segment_script(c).alias("s"), text.wrap_lines(c).alias("w"), text.chunk_sentences(c, 40, 1).alias("c"), text.tts_chunks(c, 30).alias("t")).collect()
    for r in got:
        assert r.s == segments(docs[r.id])
        assert r.w == wrap(docs[r.id])
        assert r.c == chunks(docs[r.id])
        assert all(len(x) <= 30 for x in r.t) and " ".join(r.t) == docs[r.id]


def test_enrich_cues_loop(spark):
    rng = random.Random(12)
    kinds = ["serious", "intense", "worried"]
    rows, t = [], 0.0
    for i in range(60):
        t += rng.choice([0.5, 1.0, 2.5, 4.0])
        rows.append(("s", i, t, t + 1.0, " ".join(["w"] * rng.randrange(2, 6)), rng.choice(kinds)))
    lines = spark.createDataFrame(rows, "script_id string, idx long, start_s double, end_s double, text string, kind string")
    cues = spark.createDataFrame([("s", 0, 3.0, "serious"), ("s", 1, rows[9][2], "intense")], "script_id string, idx long, start_s double, expression string")
    total = rows[-1][3] - rows[0][2]
    short = total < 120
    target = max(3, min(9, int(total / 7) + 1)) if short else max(8, min(28, int(total / 22)))
    gap, least = (5.5, 3) if short else (14.0, 5)
    taken, last, before, want = {3.0, round(rows[9][2], 1)}, -999.0, "intense", []
    for _, i, start, _, body, kind in rows:
        if start - last < gap or round(start, 1) in taken or len(body.split()) < least:
            continue
        label = planners.ALTERNATE_LABELS.get(kind, "serious") if kind == before else kind
        want.append((i, label))
        last, before = start, label
        if 2 + len(want) >= target:
            break
    made = planners.enrich_cues(lines, cues, F.col("kind"))
    assert table(made.filter("source = 'heuristic_enrichment' AND character = 'narrator'"), "idx", "expression") == want
    assert made.count() == len(want) + cues.count() and [r.start_s for r in made.orderBy("cue_no").collect()] == sorted(r.start_s for r in made.collect())


def test_choices_never_repeat(spark):
    for rows in per_script(planners.choose_cuts_and_moves(beats(spark, 6)), "transition_type", "motion").values():
        assert all(a[0] != b[0] and a[1] != b[1] for a, b in zip(rows, rows[1:]))
    for rows in per_script(planners.plan_transitions(beats(spark, 7).withColumn("emotion_score", F.lit(80.0))), "transition_type", "duration").values():
        kinds = [r[0] for r in rows]
        assert all(not (a == b == c) for a, b, c in zip(kinds, kinds[1:], kinds[2:]))


@pytest.mark.parametrize("blocks", [5, 10, 20])
def test_rounds_do_not_grow_with_blocks(spark, blocks):
    rows = [("k", i, float(i), i + 0.5, f"w{i}") for i in range(blocks * 8)]
    words = spark.createDataFrame(rows, "script_id string, idx long, start_s double, end_s double, word string")
    got = {r.idx: r.word_count for r in planners.group_words(words, block_rows=8).collect()}
    assert got == {i: min(5, blocks * 8 - i) for i in range(0, blocks * 8, 5)} and folds._ROUNDS[-1] == 0
    lines = words.withColumnRenamed("word", "text")
    got = {r.idx: r.line_count for r in planners.group_short_lines(lines, block_rows=8).collect()}
    assert got == {i: min(3, blocks * 8 - i) for i in range(0, blocks * 8, 3)} and folds._ROUNDS[-1] == 0


@pytest.mark.parametrize("blocks", [5, 10, 20])
def test_use_counts_make_few_rounds(spark, blocks):
    """Transitions that come up a few times in a long script: counts differ from block to block until they saturate."""
    rows = [("k", i, "reveal" if i % 37 == 5 else "twist" if i % 53 == 9 else "warning", "neutral", 50.0) for i in range(blocks * 64)]
    beats_ = spark.createDataFrame(rows, "script_id string, idx long, beat_type string, emotion string, emotion_score double")
    plain = {r.idx: r.transition_type for r in planners.plan_transitions(beats_, block_rows=10**6).collect()}
    assert {r.idx: r.transition_type for r in planners.plan_transitions(beats_, block_rows=64).collect()} == plain
    assert folds._ROUNDS[-1] <= 6  # not one a block
