"""End-to-end jobs: compositions of the operators, each a DataFrame in and DataFrames out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.functions import rules, text
from storyspark.operators import audit, composition, curve, graph, intervals, planners, sequence, slides, vector
from storyspark.operators.ordered import from_one_row, number_rows
from storyspark.session import cut_lineage, packed

K, O = "script_id", "idx"


def script_beats(scripts: DataFrame, key: str = K, body: str = "text", beat_rules=rules.BEAT_RULES, escalation=rules.ESCALATION_WORDS, unicode: bool = True) -> DataFrame:
    """Segments of each script with beat type and confidence."""
    s = scripts.select(key, text.segment_script(F.col(body)).alias("_s"))
    # an inner explode would get a filter inferred that cuts the text again
    s = from_one_row(s.select(key, F.size("_s").alias("total"), F.posexplode_outer("_s").alias(O, "text")).filter(F.col(O).isNotNull()), O)
    return s.withColumns(rules.beat_columns(F.col("text"), F.col(O), F.col("total"), beat_rules, escalation, unicode))


def script_to_curve(scripts: DataFrame, key: str = K, emotion_rules=rules.EMOTION_RULES, unicode: bool = True, **kw) -> dict[str, DataFrame]:
    """E1: script text to beats, smoothed curve and summary."""
    beats = script_beats(scripts, key, unicode=unicode, **kw)
    # only what a curve point shows goes through the fold; texts and score maps stay with the beats
    raw = curve.emotion_points(beats.select(key, O, "beat_type", "text", "confidence"), rules=emotion_rules, unicode=unicode, key=key)
    shown = ["beat_type", "label", "valence", "energy", "spike", "curve_position", "beat_count"]
    points = curve.smooth_curve(raw, keep=shown, key=key)
    return {"beats": beats, "curve": points, "summary": curve.curve_summary(points, key)}


def storyboard_audit(beats: DataFrame, reveal_gap_limit: float = 30.0, style: str = "clean_pro", seed: int = 0, key: str = K) -> dict[str, DataFrame]:
    """E2: acts, retention, rhythm, assets, memory, diversity, layers, motion, transitions, gate, output."""
    b = slides.legacy_shape(beats) if "duration" not in beats.columns else beats
    ents = b if "entities" in b.columns else b.withColumn("entities", F.array("character"))
    acts = sequence.narrative_arc(ents)
    violations = audit.retention_violations(b, reveal_gap_limit=reveal_gap_limit)
    rhythm = sequence.visual_rhythm(b)
    streaks = sequence.streak_issues(rhythm)
    memory = sequence.track_reuse(b)
    diversity = audit.diversity_scores(b)
    layers = composition.plan_composition(ents)
    motion = planners.plan_motion(b)
    moves = planners.plan_transitions(b.withColumn("emotion_score", F.col("intensity") * 100), style, seed=seed)
    fixed = audit.autofix(b.withColumn("summary", F.col("subtitle_text")) if "summary" not in b.columns else b)
    issues = audit.required_key_issues(b.withColumn("summary", F.col("subtitle_text")) if "summary" not in b.columns else b)
    report = audit.retention_report(b, violations).select(key, "beat_count", F.col("score").alias("retention_score"), F.col("grade").alias("retention_grade"))
    report = report.join(audit.diversity_summary(diversity).select(key, "mean_repetition", "diversity_grade"), key)
    report = report.join(sequence.reuse_summary(memory).select(key, "unique_assets", F.col("issue_count").alias("memory_issues")), key)
    report = report.join(sequence.rhythm_summary(rhythm, streaks).select(key, "avg_energy", F.col("issue_count").alias("rhythm_issues")), key)
    report = report.join(audit.gate_verdict(b, issues, "critical").select(key, "passed"), key)
    return {"acts": acts, "violations": violations, "rhythm": rhythm, "assets": sequence.carry_entity(ents), "memory": memory, "diversity": diversity,
            "composition": layers, "motion": motion, "transitions": moves, "issues": issues, "output": slides.legacy_shape(fixed), "report": report}


def staged_storyboard(beats: DataFrame, score_scale: float = 100.0, style: str = "clean_pro", seed: int = 0, key: str = K) -> dict[str, DataFrame]:
    """E3: emotion, layers, motion, transitions, memory, gate, output.  Scripts with an ERROR stop: they leave the output."""
    points = curve.smooth_curve(curve.emotion_points(beats, "subtitle_text", "intensity"))
    # three planners read the scored beats, and four results the planned ones
    scored = beats.join(points.select(key, O, F.col("score").alias("_score")), [key, O]).withColumn("emotion_score", F.col("_score") * score_scale).drop("_score")
    scored = cut_lineage(scored)
    moves = planners.plan_transitions(scored, style, seed=seed)
    motion = planners.plan_motion(scored)
    full = scored.drop("motion_preset").join(moves.select(key, O, "transition_type"), [key, O]).join(
        motion.select(key, O, F.col("style").alias("motion_preset")), [key, O])
    full = cut_lineage(full)
    issues = audit.gate_issues(full, score_scale=score_scale)
    verdict = audit.gate_verdict(full, issues)
    passed = verdict.filter("passed").select(key)
    return {"issues": issues, "verdict": verdict, "memory": sequence.track_reuse(full),
            "output": slides.legacy_shape(composition.plan_composition(full).join(passed, key, "left_semi"))}


def auditable(df: DataFrame, key: str = K) -> DataFrame:
    """Slides with the columns that the audit reads; what a slide lacks is null, its asset is its query."""
    kinds = {"emotion": "string", "intensity": "double", "asset_id": "string", "subtitle_text": "string", "summary": "string", "query": "string", "entities": "array<string>"}
    out = df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})
    own = [c for c in ("character", "arc") if c in df.columns]
    found = slides.audit_features(out.drop(*own)).drop("emotion_key").withColumn(
        "asset_id", F.coalesce(F.nullif("asset_id", F.lit("")), F.nullif("query", F.lit("")), F.concat(F.lit("unknown_"), F.col(O).cast("string"))))
    return found if not own else found.drop(*own).join(df.select(key, O, *own), [key, O])


def subtitles_to_slides(lines: DataFrame, candidates: DataFrame, total_s: DataFrame, aliases: Sequence[tuple[str, str]] = (), entities: Sequence[str] = (),
                        hooks: Sequence[tuple[str, str]] = (), profile: str = "short_vertical", key: str = K, unicode: bool = True, style: str = "clean_pro",
                        seed: int = 0) -> dict[str, DataFrame]:
    """E4: subtitle lines and candidate slides to split, refined, repaired, audited and expanded slides.

    ``total_s``: key and total_s, the length of each script.  A part of a split slide takes the entities and the query of its own text, if that has any.
    Every result of the audit (E2) comes along as ``audit_`` and its name; the slides that are expanded carry its motion and its transition.
    """
    clean, candidates = packed(intervals.trim_overlaps(lines)), packed(candidates)
    long = (F.col("end_s") - F.col("start_s")) > planners.SLIDE_MAX_S
    pairs = intervals.overlap_pairs(clean.filter("text <> ''").select(key, O, "start_s", "end_s", "text"),
                                    candidates.filter(long).select(key, O, "start_s", "end_s"), key)
    inner = pairs.select(key, F.col("s_idx").alias("slide"), F.col("l_start_s").alias("start_s"), F.col("l_end_s").alias("end_s"), F.col("l_text").alias("text"),
                         F.col(f"l_{O}").alias("_l"))
    inner = number_rows(packed(inner), [key, "slide"], ["start_s", "_l"], out=O)
    chunks = planners.chunk_lines(inner, key=[key, "slide"])
    many = chunks.groupBy(key, "slide").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    parts = chunks.join(many.drop("_n"), [key, "slide"]).select(key, F.col("slide").alias(O), F.col("chunk"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"),
                                                                F.col("text").alias("_text"), slides.summarize_window(F.col("text"), F.lit(""), unicode=unicode).alias("_sum"))
    split = candidates.join(parts, [key, O], "left").withColumns({
        "start_s": F.coalesce("_s", "start_s"), "end_s": F.coalesce("_e", "end_s"), "summary": F.coalesce(F.nullif(F.col("_sum"), F.lit("")), F.col("summary")),
        "_part": F.coalesce("chunk", F.lit(0))}).drop("_s", "_e", "_sum", "chunk")
    empty = F.array().cast("array<string>")
    given = F.coalesce("entities", empty) if "entities" in candidates.columns else empty
    split = split.withColumn("_own", graph.context_entities(F.concat_ws(" ", "_text", "summary"), aliases, entities, 3))
    split = split.withColumn("entities", F.when(F.col("_text").isNotNull() & (F.size("_own") > 0), F.col("_own")).otherwise(given))
    split = split.withColumn("query", F.coalesce(slides.infer_query(F.col("_text"), hooks, graph.context_entities(F.col("_text"), aliases, entities, 3), F.col("entities"),
                                                                    unicode=unicode), F.col("query"))).drop("_own", "_text")
    # everything after this point reads the split slides several times
    split = packed(number_rows(packed(split.withColumnRenamed(O, "_slide")), key, ["start_s", "_part"], out=O).drop("_slide", "_part"))
    refined = packed(slides.refine_slides(split, clean, aliases, entities, hooks, profile=profile, unicode=unicode))
    # only times go through the repair; the slides meet them once
    times = intervals.repair_cuts(intervals.snap_to_nearest(refined.select(key, O, "start_s"), clean).join(total_s, key))
    cut = refined.join(times.select(key, O, "new_start", "new_end"), [key, O]).withColumns({"start_s": F.col("new_start"), "end_s": F.col("new_end")})
    cut = packed(cut.drop("new_start", "new_end"))  # all stages of the audit read it
    audited = storyboard_audit(auditable(cut, key), style=style, seed=seed, key=key)
    planned = audited["transitions"].select(key, O, "transition_type", F.col("duration").alias("transition_duration")).join(
        audited["motion"].select(key, O, F.struct("style", "motion_intensity", "camera_goal", "easing").alias("motion")), [key, O])
    shown = slides.legacy_shape(audited["output"].join(planned, [key, O])).withColumn("transition_in", F.col("transition_type"))
    return {"lines": clean, "refined": refined, "slides": cut, **{f"audit_{name}": df for name, df in audited.items()}, "expanded": sequence.expand_parallel(shown)}


def retrieval(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, chunk_size: int = 500, overlap_sentences: int = 1, collection: str = "docs",
              key: str = "doc_id", qvector: str = "embedding") -> dict[str, DataFrame]:
    """E5: chunks with content ids, their vectors (given by chunk), top-k per query, context text."""
    chunks = docs.select(key, F.posexplode(text.chunk_sentences(F.col("text"), chunk_size, overlap_sentences)).alias("chunk_no", "text"))
    rows = vector.collection_rows(chunks, collection, parts=(key, "chunk_no", "text"))
    stored = rows.join(vectors, [key, "chunk_no"]) if "chunk_no" in vectors.columns else rows.join(vectors, key)
    hits = vector.top_k_vectors(stored, queries, k, "id", "embedding", qvector=qvector)
    best = hits.join(stored.select("id", "text", *(["character"] if "character" in stored.columns else [])), "id")
    if "character" not in best.columns:
        best = best.withColumn("character", F.lit(""))
    return {"rows": rows, "hits": hits, "best": best, "context": vector.context_text(best)}


def page_context(candidates: DataFrame, doc: str = "doc_id", page: str = "page", confidence: str | None = None, **kw) -> dict[str, DataFrame]:
    """E6: best text per page among its candidates, document verdict, usable context pieces in page order."""
    q = text.with_text_quality(candidates, confidence=confidence, **kw)
    order = F.struct(F.col("quality_score"), -F.col("candidate"))
    best = q.groupBy(doc, page).agg(F.max_by(F.struct("clean_text", "quality_score", "quality_level", "usable"), order).alias("b")).select(doc, page, "b.*")
    best = best.withColumn("clean_text", F.when(F.col("usable"), F.col("clean_text")).otherwise(""))
    verdict = text.quality_rollup(best, doc, page)
    pieces = best.filter("usable").join(verdict.filter("usable").select(doc), doc, "left_semi").select(
        doc, page, F.concat(F.lit("Page "), F.col(page).cast("string"), F.lit(": "), F.col("clean_text")).alias("piece"))
    return {"pages": best, "verdict": verdict, "context": pieces}


def relationship_job(nodes: DataFrame, sources: DataFrame, curated: DataFrame | None = None, narration: DataFrame | None = None, k: int = 10,
                     generic_tags: Sequence[str] = (), unicode: bool = True) -> dict[str, DataFrame]:
    """E7: catalog to edges to ranked relationships, optionally boosted by a narration per source."""
    edges = graph.combine_edges(graph.mine_edges(nodes, sources, curated, generic_tags))
    mentions = None
    if narration is not None:
        names = nodes.select(F.col("id").alias("node_id"), F.explode(F.array_distinct(F.filter(F.array("name", "character"), lambda x: F.coalesce(x, F.lit("")) != ""))).alias("term"))
        mentions = graph.narration_mentions(narration, names, unicode=unicode)
    return {"edges": edges, "ranked": graph.rank_relationships(edges, nodes, k, mentions)}
