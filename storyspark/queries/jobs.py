"""Registered end-to-end jobs and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyspark.operators import composition, slides, vector
from storyspark.plans import jobs
from storyspark.plans.views import BEATS_SQL, beats, catalog, table
from storyspark.queries import intervals  # noqa: F401  (its SQL is a part of the jobs')
from storyspark.queries.beats import DAY, RHYTHM_CTES
from storyspark.queries.registry import SQL, register
from storyspark.queries.search import CENTROIDS, EDGES_SQL, centroids, heads
from storyspark.queries.text import CHUNK_SQL, CREDITS, DOC_BEAT_RULES, DOC_EMOTIONS, DOC_ESCALATION, QUALITY_CTES, ROLLUP_SQL, docs
from storyspark.streaming import jobs as streaming

SUMMARY = ("script_id:i beat_count:i mean_intensity:d peak_intensity:d peak_index:i peak_beat_type:s trough_intensity:d intensity_range:d "
           "spike_count:i arc_shape:s dominant_emotion:s valence_trend:s")


@register("e1_script_to_curve", SUMMARY)
def e1(spark, sf):
    d = docs(spark, sf).withColumnRenamed("doc_id", "script_id")
    return jobs.script_to_curve(d, beat_rules=DOC_BEAT_RULES, escalation=DOC_ESCALATION, emotion_rules=DOC_EMOTIONS, unicode=False)["summary"]


# energy streaks at the job's limits: over 0.75 more than three times, under 0.35 more than four times
STREAKS_SQL = RHYTHM_CTES.split("isl AS (")[0] + """
isl AS (SELECT *, sum(CAST(NOT energy > 0.75 AS INTEGER)) OVER w AS hg, sum(CAST(NOT energy < 0.35 AS INTEGER)) OVER w AS lg FROM rh WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
strk AS (SELECT script_id FROM (SELECT *, row_number() OVER (PARTITION BY script_id, hg ORDER BY idx) AS n FROM isl WHERE energy > 0.75) WHERE n % 4 = 0
         UNION ALL SELECT script_id FROM (SELECT *, row_number() OVER (PARTITION BY script_id, lg ORDER BY idx) AS n FROM isl WHERE energy < 0.35) WHERE n % 5 = 0)"""


@register("e2_storyboard_audit", "script_id:i beat_count:i retention_score:d retention_grade:s mean_repetition:d diversity_grade:s unique_assets:i memory_issues:i avg_energy:d rhythm_issues:i passed:b", f"""
SELECT r.script_id, r.beat_count, r.score AS retention_score, r.grade AS retention_grade, d.mean_repetition, d.diversity_grade, m.unique_assets, m.issue_count AS memory_issues,
       y.avg_energy, coalesce(s.n, 0) AS rhythm_issues, true AS passed
FROM ({SQL['a5_retention_report']}) r JOIN ({SQL['a4_diversity_summary']}) d USING (script_id) JOIN ({SQL['a6_reuse_summary']}) m USING (script_id)
JOIN (SELECT script_id, avg(energy) AS avg_energy FROM rh GROUP BY script_id) y USING (script_id) LEFT JOIN (SELECT script_id, count(*) AS n FROM strk GROUP BY script_id) s USING (script_id)""", STREAKS_SQL)
def e2(spark, sf):
    return jobs.storyboard_audit(beats(spark, sf), reveal_gap_limit=DAY)["report"]


def _digest_sql(stage: str, name: str, check: str) -> str:
    # energies are not rounded themselves, and the twin has six places of them
    return f"SELECT '{stage}' AS stage, script_id, count(*) AS rows, round({check}, {2 if stage == 'rhythm' else 4}) AS total FROM ({SQL[name]}) GROUP BY script_id"


@register("e2_all_results", "stage:s script_id:i rows:i total:d", " UNION ALL ".join([
    _digest_sql("acts", "w16_narrative_arc", "count(*) FILTER (arc_significance = 'high')"), _digest_sql("violations", "a5b_retention_violations", "sum(first_idx)"),
    _digest_sql("rhythm", "w13_visual_rhythm", "sum(energy)"), _digest_sql("memory", "w12_reuse_tracking", "count(*) FILTER (spoiled_reveal) + count(*) FILTER (premature_reuse)"),
    _digest_sql("diversity", "w7_lookback_repetition", "sum(repetition_score)"), _digest_sql("motion", "w41_motion_details", "sum(motion_intensity)"),
    _digest_sql("transitions", "w42_plan_transitions", "sum(duration)"),
    *(f"SELECT '{stage}', script_id, count(*), 0 FROM beats GROUP BY script_id" for stage in ("assets", "composition", "output"))]), BEATS_SQL)
def e2_all(spark, sf):
    """Every result of the job, as rows and a total per script."""
    out = jobs.storyboard_audit(beats(spark, sf), reveal_gap_limit=DAY)
    totals = {"acts": F.count_if(F.col("arc_significance") == "high"), "violations": F.sum("first_idx"), "rhythm": F.sum("energy"), "diversity": F.sum("repetition_score"),
              "memory": F.count_if("spoiled_reveal") + F.count_if("premature_reuse"), "motion": F.sum("motion_intensity"), "transitions": F.sum("duration")}
    rows = None
    for stage, df in out.items():
        if stage != "report":
            one = df.groupBy("script_id").agg(F.count(F.lit(1)).alias("rows"), F.round(totals.get(stage, F.lit(0)).cast("double"), 2 if stage == "rhythm" else 4).alias("total")).withColumn("stage", F.lit(stage))
            rows = one if rows is None else rows.unionByName(one)
    return rows


STAGED_SQL = BEATS_SQL + f""",
tt AS (SELECT b.script_id, b.idx, b.beat_type, b.asset_id, b.start_s / 36000 AS start_s, b.end_s / 36000 AS end_s, c.score * 100 AS s, t.transition_type, m.style AS motion_preset
       FROM beats b JOIN ({SQL['w19_smoothed_curve']}) c USING (script_id, idx) JOIN ({SQL['w42_plan_transitions']}) t USING (script_id, idx) JOIN ({SQL['w41_plan_motion']}) m USING (script_id, idx)),
gl AS (SELECT *, lag(asset_id) OVER w AS pa, lag(transition_type) OVER w AS pt, lag(motion_preset) OVER w AS pm, sum(CAST(s >= 30 AS INTEGER)) OVER w AS grp
       FROM tt WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
gs AS (SELECT *, CASE WHEN s < 30 THEN sum(CAST(s < 30 AS INTEGER)) OVER (PARTITION BY script_id, grp ORDER BY idx) ELSE 0 END AS streak FROM gl),
gn AS (SELECT script_id, CAST(beat_type = 'reveal' AND end_s - start_s > 8 AS INTEGER) AS failing,
              CAST(beat_type = 'hook' AND s < 70 AS INTEGER) + CAST(streak > 2 AS INTEGER) + CAST(coalesce(asset_id = pa, false) AS INTEGER)
              + CAST(coalesce(transition_type = pt, false) AS INTEGER) + CAST(coalesce(motion_preset = pm, false) AS INTEGER) AS others FROM gs)"""


@register("e3_staged_storyboard", "script_id:i beat_count:i issue_count:i failing_count:i passed:b shown:i memory_rows:i", """
SELECT script_id, count(*) AS beat_count, sum(failing + others) AS issue_count, sum(failing) AS failing_count, sum(failing) = 0 AS passed, CASE WHEN sum(failing) = 0 THEN count(*) ELSE 0 END AS shown,
       count(*) AS memory_rows FROM gn GROUP BY script_id""", STAGED_SQL)
def e3(spark, sf):
    """The verdict, with the rows of the output (of scripts that pass) and of the memory."""
    # one event hour counts as one second, so that some scripts pass the eight-second reveal rule
    b = beats(spark, sf).withColumns({"start_s": F.col("start_s") / 36000, "end_s": F.col("end_s") / 36000})
    out = jobs.staged_storyboard(b)
    rows = lambda stage, name: out[stage].groupBy("script_id").agg(F.count(F.lit(1)).alias(name))
    both = out["verdict"].join(rows("output", "shown"), "script_id", "left").join(rows("memory", "memory_rows"), "script_id", "left")
    return both.withColumn("shown", F.coalesce("shown", F.lit(0)))


@register("e4_subtitles_to_slides", "script_id:i idx:i half:i start_s:d end_s:d query:s beat_type:s visual_role:s layout_mode:s motion_preset:s sfx_cue:s asset_confidence:d")
def e4(spark, sf):
    b = beats(spark, sf).withColumns({"start_s": F.col("start_s") / 20000, "end_s": F.col("end_s") / 20000})
    lines = b.select("script_id", "idx", "start_s", "end_s", F.concat("subtitle_text", F.lit(".")).alias("text"))
    from storyspark.operators.ordered import number_rows

    cand = b.filter("beat_type IN ('hook', 'reveal')").select(
        "script_id", F.col("idx").alias("_i"), "start_s", (F.col("end_s") + 6).alias("end_s"), F.col("query"), F.col("subtitle_text").alias("summary"),
        F.array("character").alias("entities"), F.when(F.col("asset_id").cast("long") % 6 == 0, "parallel_cut").otherwise("standard").alias("pacing_intent"))
    cand = number_rows(cand, "script_id", ["_i"]).drop("_i")
    total = b.groupBy("script_id").agg((F.max("end_s") + 1).alias("total_s"))
    return jobs.subtitles_to_slides(lines, cand, total, entities=["click", "purchase", "signup"], unicode=False)["expanded"]


@register("e5_retrieval_context", "query_id:s context:s", """
SELECT query_id, string_agg('- ' || chunk || ' (Character: label' || label || ')', chr(10) ORDER BY rank) AS context
FROM (SELECT s.query_id, s.label, r.chunk, row_number() OVER (PARTITION BY s.query_id ORDER BY s.similarity DESC, sha256('docs' || chr(1) || r.doc_id || chr(1) || r.chunk_no || chr(1) || r.chunk)) AS rank
      FROM sim s JOIN (SELECT doc_id, generate_subscripts(l, 1) - 1 AS chunk_no, unnest(l) AS chunk FROM ch) r ON r.doc_id = s.vec_id QUALIFY rank <= 5)
GROUP BY query_id""", CHUNK_SQL + "," + CENTROIDS)
def e5(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.concat(F.lit("label"), "label").alias("character"))
    best = jobs.retrieval(docs(spark, sf), e, centroids(spark, sf), qvector="q")["best"]
    # a chunk of a document without a label keeps its rank, but has no line
    return vector.context_text(best.withColumn("text", F.when(F.col("character").isNotNull(), F.col("text")))).withColumn("context", F.nullif("context", F.lit("")))


@register("e6_page_context", "source:s total_pages:i usable_pages:i score:d context_chars:i level:s usable:b", ROLLUP_SQL, QUALITY_CTES)
def e6(spark, sf):
    # two candidates per page: the text itself and its upper-case form, which scores the same and loses the tie
    d = docs(spark, sf).select("source", F.col("doc_id").alias("page"), F.posexplode(F.array("text", F.upper("text"))).alias("candidate", "text"))
    return jobs.page_context(d, "source", "page", patterns=CREDITS, unicode=False)["verdict"]


@register("e7_relationships", "src:i dst:i score:d relationship:s narration_boost:d rank:i", """
SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) AS rank
FROM (SELECT src, dst, CASE WHEN m THEN 'rivals' ELSE type END AS relationship, CASE WHEN m THEN 0.28e0 ELSE 0.0 END AS narration_boost,
             least(1.0, greatest(0.0, weight + CASE WHEN m THEN 0.28e0 ELSE 0.0 END + importance / 5.0e0 * 0.10e0)) AS score
      FROM (SELECT e.src, e.dst, e.type, e.weight, c.importance,
                   regexp_matches(n.told, '\\b' || c.name || '\\b') OR regexp_matches(n.told, '\\b' || c.character || '\\b') AS m
            FROM ed e JOIN catalog c ON c.id = e.dst JOIN (SELECT id, lower('a rival of ' || name || ' and red gear') AS told FROM heads) n ON n.id = e.src))
QUALIFY rank <= 10""", EDGES_SQL)
def e7(spark, sf):
    n = catalog(spark, sf)
    h = heads(n)
    narration = h.select(F.col("id").alias("src"), F.concat_ws(" ", F.lit("a rival of"), "name", F.lit("and red gear")).alias("narration"))
    return jobs.relationship_job(n, h.select("id"), narration=narration)["ranked"]


LAYERS_SQL = BEATS_SQL + """,
sx AS (SELECT *, CASE WHEN visual_role = 'character' THEN CASE beat_type WHEN 'hook' THEN 'hero_reveal' WHEN 'reveal' THEN 'hero_reveal' WHEN 'escalation' THEN 'hero_reveal' WHEN 'warning' THEN 'character_dread' ELSE 'character_context' END
                    WHEN visual_role = 'evidence' THEN 'evidence_inspect' WHEN visual_role = 'symbol' THEN 'symbol_dramatic' ELSE 'establishing_wide' END AS st,
              CASE WHEN intensity = 0 THEN 0.4e0 ELSE intensity END AS x FROM beats)"""


@register("f33_composition_layers", "script_id:i idx:i strategy:s names:s layer_count:i", """
SELECT script_id, idx, st AS strategy, array_to_string(l[1:8], ',') AS names, least(8, len(l)) AS layer_count
FROM (SELECT *, list_filter(list_concat(['background', CASE WHEN emotion IN ('grief', 'fear') THEN 'bg_mood' WHEN beat_type = 'reveal' THEN 'bg_blur' END,
        CASE st WHEN 'hero_reveal' THEN 'foreground_character' WHEN 'character_context' THEN 'foreground_character' WHEN 'character_dread' THEN 'foreground_character'
                WHEN 'evidence_inspect' THEN 'foreground_evidence' WHEN 'symbol_dramatic' THEN 'foreground_symbol' END],
        (CASE emotion WHEN 'fear' THEN ['vignette_red', 'chromatic_shift'] WHEN 'rage' THEN ['red_tint', 'impact_lines'] WHEN 'grief' THEN ['desaturation', 'rain_particles'] ELSE ['subtle_vignette'] END)[1:CASE WHEN x < 0.5 THEN 1 ELSE 2 END],
        [CASE WHEN layout_mode IN ('evidence_card', 'title_card') THEN 'editorial_panel' END, 'headline', 'subtitle_zone', 'camera_motion']), lambda y: y IS NOT NULL) AS l FROM sx)""", LAYERS_SQL)
def f33(spark, sf):
    b = beats(spark, sf).withColumns({"entities": F.array("character"), "text_overlay": F.col("subtitle_text")})
    out = composition.plan_composition(b)
    return out.withColumns({"names": F.array_join(F.transform("layers", lambda x: x["name"]), ","), "layer_count": F.size("layers")})


@register("f33_simple_layers", "script_id:i idx:i names:s", """
SELECT script_id, idx, 'background_asset' || CASE WHEN layout_mode IN ('evidence_card', 'title_card') THEN ',editorial_panel' ELSE '' END || ',headline' AS names FROM beats""", BEATS_SQL)
def f33_simple(spark, sf):
    out = composition.simple_layers(beats(spark, sf).withColumn("text_overlay", F.col("subtitle_text")))
    return out.withColumn("names", F.array_join(F.transform("composition_layers", lambda x: x["name"]), ","))


# ---- streaming ------------------------------------------------------------------------------------

def event_stream(spark, sf):
    ev = streaming.read_table_stream(spark, sf, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return ev.select(F.col("user_id").alias("script_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value", k.alias("k"))


@register("r1_asset_memory_stream", "script_id:i asset_id:s first_us:i last_us:i times_used:i", """
SELECT user_id AS script_id, regexp_extract(props, '(\\d+)', 1) AS asset_id, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) AS times_used FROM events GROUP BY ALL""")
def r1(spark, sf):
    s = event_stream(spark, sf).withColumn("asset_id", F.col("k").cast("string"))
    rows = streaming.asset_memory(s, streaming.job_folder(spark, "memory"))
    return rows.withColumns({"first_us": F.unix_micros("first_seen"), "last_us": F.unix_micros("last_seen")})


@register("r2_score_new_beats", "script_id:i idx:i repetition_score:d rejected:b", """
SELECT script_id, idx, repetition_score, repetition_score > 0.7 AS rejected FROM (
SELECT script_id, idx, round(least(1.0, 0.30e0 * character_penalty + 0.25e0 * arc_penalty), 3) AS repetition_score FROM (
SELECT script_id, idx, CASE WHEN c1 + c2 + c3 = 0 THEN 0.0 ELSE least(1.0, (c1 + c2 + c3) / CAST(least(idx, 3) AS DOUBLE) + least(0.25e0, 0.10e0 * (c1 + c1 * c2 + c1 * c2 * c3))) END AS character_penalty,
       CASE WHEN a1 + a2 + a3 = 0 THEN 0.0 ELSE least(1.0, (a1 + a2 + a3) / CAST(least(idx, 3) AS DOUBLE) + least(0.25e0, 0.10e0 * (a1 + a1 * a2 + a1 * a2 * a3))) END AS arc_penalty
FROM (SELECT script_id, idx, CAST(coalesce(lag(character, 1) OVER w = character, false) AS INTEGER) AS c1, CAST(coalesce(lag(character, 2) OVER w = character, false) AS INTEGER) AS c2,
             CAST(coalesce(lag(character, 3) OVER w = character, false) AS INTEGER) AS c3, CAST(coalesce(lag(arc, 1) OVER w = arc, false) AS INTEGER) AS a1,
             CAST(coalesce(lag(arc, 2) OVER w = arc, false) AS INTEGER) AS a2, CAST(coalesce(lag(arc, 3) OVER w = arc, false) AS INTEGER) AS a3
      FROM beats WINDOW w AS (PARTITION BY script_id ORDER BY idx))))""", BEATS_SQL)
def r2(spark, sf):
    s = event_stream(spark, sf).withColumns({"character": F.concat(F.lit("cast"), F.col("k") % 3), "arc": F.concat(F.lit("arc"), F.col("k") % 2)})
    return streaming.score_new_beats(s, streaming.job_folder(spark, "scores"), ["ts", "event_id"], dims={"character": F.col("character"), "arc": F.col("arc")})


@register("r3_session_status_stream", "session_id:i stage:s status:s", """
SELECT user_id AS session_id, event_type AS stage, CASE WHEN value > 60 THEN 'failed' ELSE 'done' END AS status FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def r3(spark, sf):
    s = event_stream(spark, sf).select(F.col("script_id").alias("session_id"), F.col("event_type").alias("stage"), "ts", F.col("event_id").alias("seq"),
                                       F.when(F.col("value") > 60, "failed").otherwise("done").alias("status"))
    return streaming.session_status(s, streaming.job_folder(spark, "sessions"))


# ---- W40: refined slides ---------------------------------------------------------------------------

@register("w40_refine_slides", "script_id:i idx:i query:s subtitle_text:s beat_type:s end_s:d", """
SELECT s.script_id, s.idx, any_value(s.said) AS query, coalesce(string_agg(l.subtitle_text || '.', ' ' ORDER BY l.start_s, l.idx), '') AS subtitle_text, any_value(s.beat_type) AS beat_type,
       any_value(s.end_s / 20000) AS end_s
FROM (SELECT *, CASE WHEN idx > min(idx) OVER (PARTITION BY script_id, query) THEN query || ' alternate scene' ELSE query END AS said
      FROM (SELECT * REPLACE (CASE beat_type WHEN 'warning' THEN 'payoff' ELSE beat_type END AS beat_type) FROM beats)) s
LEFT JOIN beats l ON l.script_id = s.script_id AND l.end_s > s.start_s AND l.start_s < s.end_s GROUP BY s.script_id, s.idx""", BEATS_SQL)
def w40(spark, sf):
    """Slides with the text of their lines; a query that an earlier slide has asks for another scene."""
    b = beats(spark, sf).withColumns({"start_s": F.col("start_s") / 20000, "end_s": F.col("end_s") / 20000})
    lines = b.select("script_id", "idx", "start_s", "end_s", F.concat("subtitle_text", F.lit(".")).alias("text"))
    shown = b.select("script_id", "idx", "start_s", "end_s", F.when(F.col("beat_type") == "warning", "payoff").otherwise(F.col("beat_type")).alias("beat_type"), "query",
                     F.lit("A summary that is long enough").alias("summary"), F.array().cast("array<string>").alias("entities"), F.lit(0.5).alias("asset_confidence"))
    return slides.refine_slides(shown, lines, unicode=False)
