"""Queries over storyboards built from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyspark.operators import audit, curve, sequence
from storyspark.plans.views import BEATS_SQL, beats
from storyspark.queries.registry import register

DAY = 86400.0

# ---- runs and retention -----------------------------------------------------------------------

RUNS = """
%(v)s_run AS (
  SELECT script_id, %(v)s AS run_value, min(idx) AS run_start, count(*) AS run_length
  FROM (SELECT script_id, idx, %(v)s,
               idx - row_number() OVER (PARTITION BY script_id, %(v)s ORDER BY idx) AS g FROM beats)
  GROUP BY script_id, %(v)s, g HAVING count(*) > 1)"""


@register("w1_runs", "script_id:i run_value:s run_start:i run_length:i", "SELECT * FROM beat_type_run", BEATS_SQL + "," + RUNS % {"v": "beat_type"})
def w1_runs(spark, sf):
    return audit.find_runs(beats(spark, sf), "beat_type")


VIOLATION = "script_id:i check_name:s severity:s first_idx:i last_idx:i n_fixes:i message:s"
W2_SQL = """
SELECT script_id, 'same_character' AS check_name, CASE WHEN run_length > 4 THEN 'high' ELSE 'medium' END AS severity,
       run_start AS first_idx, run_start + run_length - 1 AS last_idx, run_length - 3 AS n_fixes,
       'Character ''' || run_value || ''' appears in ' || run_length || ' consecutive beats (indices ' || run_start || '–'
       || (run_start + run_length - 1) || '). Limit is 3.' AS message
FROM character_run WHERE run_length > 3"""
W3_SQL = """
SELECT script_id, 'same_arc' AS check_name, CASE WHEN run_length <= 6 THEN 'medium' ELSE 'high' END AS severity,
       run_start AS first_idx, run_start + run_length - 1 AS last_idx, run_length - 4 AS n_fixes,
       'Arc ''' || run_value || ''' stays for ' || run_length || ' consecutive beats (indices ' || run_start || '–'
       || (run_start + run_length - 1) || '). Limit is 4.' AS message
FROM arc_run WHERE run_length > 4"""
W2_CTES = BEATS_SQL + "," + RUNS % {"v": "character"}
W3_CTES = BEATS_SQL + "," + RUNS % {"v": "arc"}


@register("w2_same_character", VIOLATION, W2_SQL, W2_CTES)
def w2(spark, sf):
    return audit.same_character(beats(spark, sf))


@register("w2_same_character_fixes", "script_id:i target_index:i action:s priority:s field:s new_value:s", """
SELECT script_id, t AS target_index, 'swap_character' AS action, 'high' AS priority, 'visual_role' AS field,
       list_extract(['evidence','symbol','location','comparison','timeline','object','quote_card','section_card'], CAST(t % 8 + 1 AS INTEGER)) AS new_value
FROM (SELECT script_id, unnest(range(run_start + 3, run_start + run_length)) AS t FROM character_run WHERE run_length > 3)""", W2_CTES)
def w2_fixes(spark, sf):
    return audit.same_character_fixes(beats(spark, sf))


@register("w3_same_arc", VIOLATION, W3_SQL, W3_CTES)
def w3(spark, sf):
    return audit.same_arc(beats(spark, sf))


@register("w3_same_arc_fixes", "script_id:i target_index:i action:s priority:s field:s new_value:s", """
SELECT script_id, t AS target_index, 'change_arc' AS action, 'medium' AS priority, 'visual_role' AS field, 'comparison' AS new_value
FROM (SELECT script_id, unnest(range(run_start + 4, run_start + run_length)) AS t FROM arc_run WHERE run_length > 4)""", W3_CTES)
def w3_fixes(spark, sf):
    return audit.same_arc_fixes(beats(spark, sf))


DROUGHT_CTES = """
ends AS (SELECT script_id, count(*) AS n, max_by(end_s, idx) AS end_s FROM beats GROUP BY script_id),
rev AS (SELECT script_id, idx, start_s, lag(idx, 1, -1) OVER w AS from_idx, lag(start_s, 1, 0.0) OVER w AS from_s
        FROM beats WHERE beat_type IN ('reveal', 'payoff') WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
lastrev AS (SELECT script_id, max(idx) AS i, max(start_s) AS s FROM rev GROUP BY script_id),
gaps AS (
  SELECT script_id, from_idx, idx - 1 AS last_idx, start_s - from_s AS gap, from_s AS lo, start_s AS hi FROM rev WHERE idx > 0
  UNION ALL
  SELECT e.script_id, coalesce(l.i, -1), e.n - 1, e.end_s - coalesce(l.s, 0.0), coalesce(l.s, 0.0), e.end_s
  FROM ends e LEFT JOIN lastrev l USING (script_id) WHERE coalesce(l.i, -1) < e.n - 1),
members AS (
  SELECT g.script_id, g.from_idx, g.gap, list(b.idx ORDER BY b.idx) AS m
  FROM gaps g JOIN beats b ON b.script_id = g.script_id AND b.start_s >= g.lo AND b.start_s < g.hi AND b.idx <= g.last_idx
  WHERE g.gap > 86400.0 GROUP BY ALL),
droughts AS (
  SELECT script_id, 'no_reveal_drought' AS check_name, 'critical' AS severity, m[1] AS first_idx, m[len(m)] AS last_idx, 2 AS n_fixes,
         printf('No reveal/payoff for %.0fs (beats ', gap) || m[1] || '–' || m[len(m)] || '). Limit is 86400s.' AS message,
         gap AS gap_s, m[len(m) // 2 + 1] AS mid_idx,
         list_extract(['mystery','contradiction','reveal','evidence','escalation'], CAST(m[len(m) // 2 + 1] % 5 + 1 AS INTEGER)) AS alt_beat
  FROM members)"""


@register("w4_reveal_drought", VIOLATION + " gap_s:d mid_idx:i alt_beat:s", "SELECT * FROM droughts", BEATS_SQL + "," + DROUGHT_CTES)
def w4(spark, sf):
    return audit.reveal_drought(beats(spark, sf), gap_limit=DAY)


FLAT_CTES = """
fwin AS (
  SELECT script_id, idx, intensity AS x0, lead(intensity, 1) OVER w AS x1, lead(intensity, 2) OVER w AS x2, lead(intensity, 3) OVER w AS x3
  FROM beats WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
fcheck AS (
  SELECT script_id, idx, least(x0, x1, x2, x3) AS lo, greatest(x0, x1, x2, x3) AS hi, greatest(0.0, x1 - x0, x2 - x1, x3 - x2) AS up
  FROM fwin WHERE x3 IS NOT NULL),
flats AS (
  SELECT script_id, 'flat_emotion' AS check_name, 'medium' AS severity, idx AS first_idx, idx + 3 AS last_idx, 2 AS n_fixes,
         'Flat emotional curve across beats ' || idx || '–' || (idx + 3) AS message, lo AS low, hi AS high, up AS max_increase
  FROM fcheck WHERE up <= 0.1 AND hi - lo < 0.15
  QUALIFY row_number() OVER (PARTITION BY script_id ORDER BY idx) = 1)"""


@register("w5_flat_emotion", VIOLATION + " low:d high:d max_increase:d", "SELECT * FROM flats", BEATS_SQL + "," + FLAT_CTES)
def w5(spark, sf):
    return audit.flat_emotion(beats(spark, sf))


HOOK_SQL = """
hooks AS (
  SELECT script_id, 'weak_hook' AS check_name, CASE WHEN beat_type <> 'hook' OR intensity < 0.3 THEN 'critical' ELSE 'high' END AS severity,
         0 AS first_idx, 0 AS last_idx, len(p) AS n_fixes, 'Weak hook: ' || array_to_string(p, '; ') AS message
  FROM (SELECT *, list_filter([
          CASE WHEN beat_type <> 'hook' THEN 'First beat is beat_type=''' || beat_type || ''', not ''hook''' END,
          CASE WHEN intensity < 0.6 THEN printf('Hook emotion intensity is %.2f (minimum: 0.60)', intensity) END,
          'Hook has no text_overlay or emphasis_words',
          CASE WHEN motion_preset IN ('static_hold', 'hold_still', 'evidence_hold', '') THEN 'Hook motion_preset=''' || motion_preset || ''' is too static' END],
          lambda x: x IS NOT NULL) AS p FROM beats WHERE idx = 0) WHERE len(p) > 0)"""


@register("w6_weak_hook", VIOLATION, "SELECT * FROM hooks", BEATS_SQL + "," + HOOK_SQL)
def w6(spark, sf):
    return audit.weak_hook(beats(spark, sf))


AUDIT_CTES = ",".join([BEATS_SQL, RUNS % {"v": "character"}, RUNS % {"v": "arc"}, DROUGHT_CTES, FLAT_CTES, HOOK_SQL, f"""
viol AS (
  SELECT * FROM ({W2_SQL}) UNION ALL SELECT * FROM ({W3_SQL})
  UNION ALL SELECT script_id, check_name, severity, first_idx, last_idx, n_fixes, message FROM droughts
  UNION ALL SELECT script_id, check_name, severity, first_idx, last_idx, n_fixes, message FROM flats
  UNION ALL SELECT * FROM hooks),
perscript AS (
  SELECT script_id, count(*) AS v, sum(n_fixes) AS fx,
         sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 12 WHEN 'medium' THEN 8 WHEN 'low' THEN 4 ELSE 5 END) AS cost,
         count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count,
         count(*) FILTER (severity = 'medium') AS medium_count, count(*) FILTER (severity = 'low') AS low_count,
         count(*) FILTER (check_name = 'same_character') AS same_character_count, count(*) FILTER (check_name = 'same_arc') AS same_arc_count,
         count(*) FILTER (check_name = 'no_reveal_drought') AS no_reveal_drought_count,
         count(*) FILTER (check_name = 'flat_emotion') AS flat_emotion_count, count(*) FILTER (check_name = 'weak_hook') AS weak_hook_count
  FROM viol GROUP BY script_id)"""])


@register("a5b_retention_violations", VIOLATION, "SELECT * FROM viol", AUDIT_CTES)
def a5b(spark, sf):
    return audit.retention_violations(beats(spark, sf), reveal_gap_limit=DAY)


REPORT = ("script_id:i beat_count:i violation_count:i total_fixes:i critical_count:i high_count:i medium_count:i low_count:i "
          "same_character_count:i same_arc_count:i no_reveal_drought_count:i flat_emotion_count:i weak_hook_count:i score:d grade:s")


@register("a5_retention_report", REPORT, """
SELECT script_id, beat_count, coalesce(v, 0) AS violation_count, coalesce(fx, 0) AS total_fixes, coalesce(critical_count, 0) AS critical_count,
       coalesce(high_count, 0) AS high_count, coalesce(medium_count, 0) AS medium_count, coalesce(low_count, 0) AS low_count,
       coalesce(same_character_count, 0) AS same_character_count, coalesce(same_arc_count, 0) AS same_arc_count,
       coalesce(no_reveal_drought_count, 0) AS no_reveal_drought_count, coalesce(flat_emotion_count, 0) AS flat_emotion_count,
       coalesce(weak_hook_count, 0) AS weak_hook_count, pts / 100.0 AS score,
       CASE WHEN pts >= 90 THEN 'A' WHEN pts >= 75 THEN 'B' WHEN pts >= 60 THEN 'C' WHEN pts >= 40 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT *, greatest(0, 100 - coalesce(cost, 0)) AS pts
      FROM (SELECT script_id, count(*) AS beat_count FROM beats GROUP BY script_id) LEFT JOIN perscript USING (script_id))""", AUDIT_CTES)
def a5(spark, sf):
    b = beats(spark, sf)
    return audit.retention_report(b, audit.retention_violations(b, reveal_gap_limit=DAY))


# ---- look-back diversity -----------------------------------------------------------------------

def _penalty(d: str) -> str:
    m = [f"CAST(coalesce(lag({d}, {n}) OVER w = {d}, false) AS INTEGER)" for n in (1, 2, 3)]
    return f"{m[0]} AS {d}1, {m[1]} AS {d}2, {m[2]} AS {d}3"


def _score(d: str) -> str:
    return (f"CASE WHEN {d}1 + {d}2 + {d}3 = 0 THEN 0.0 ELSE least(1.0, ({d}1 + {d}2 + {d}3) / CAST(least(idx, 3) AS DOUBLE) "
            f"+ least(0.25e0, 0.10e0 * ({d}1 + {d}1 * {d}2 + {d}1 * {d}2 * {d}3))) END AS {d}_penalty")


DIMS = ("character", "arc", "composition", "emotion")
DIVERSITY_CTES = BEATS_SQL + ", bf AS (SELECT *, visual_role || '_' || layout_mode AS composition FROM beats), " + f"""
lb AS (SELECT script_id, idx, {', '.join(DIMS)}, {', '.join(_penalty(d) for d in DIMS)} FROM bf WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
pn AS (SELECT script_id, idx, {', '.join(DIMS)}, {', '.join(_score(d) for d in DIMS)} FROM lb),
sc AS (SELECT *, round(greatest(0.0, least(1.0, 0.30e0 * character_penalty + 0.25e0 * arc_penalty + 0.25e0 * composition_penalty
       + 0.20e0 * emotion_penalty)), 3) AS repetition_score FROM pn),
dv AS (SELECT *, repetition_score > 0.7 AS rejected FROM sc)"""


def _diversity(spark, sf):
    return audit.diversity_scores(beats(spark, sf))


PENALTIES = "script_id:i idx:i character_penalty:d arc_penalty:d composition_penalty:d emotion_penalty:d repetition_score:d rejected:b"


@register("w7_lookback_repetition", PENALTIES, "SELECT * FROM dv", DIVERSITY_CTES)
def w7(spark, sf):
    return _diversity(spark, sf)


_SUGGEST = {d: "[" + ",".join("'" + t.replace("'", "''") + "'" for t in audit.SUGGESTIONS[d]) + "]" for d in DIMS}


@register("w7_suggestions", "script_id:i idx:i suggestions:s", f"""
SELECT script_id, idx, array_to_string(list_filter([
  CASE WHEN rejected THEN '{audit.REJECTED_NOTE}' END,
  {', '.join(f"CASE WHEN {d}_penalty > 0 THEN list_extract({_SUGGEST[d]}, CAST(idx % {len(audit.SUGGESTIONS[d])} + 1 AS INTEGER)) END" for d in DIMS)}],
  lambda x: x IS NOT NULL), ' | ') AS suggestions FROM dv""", DIVERSITY_CTES)
def w7_suggestions(spark, sf):
    return _diversity(spark, sf).withColumn("suggestions", F.array_join("suggestions", " | "))


@register("w8_latest_beat_repetition", PENALTIES, """
SELECT * FROM dv QUALIFY row_number() OVER (PARTITION BY script_id ORDER BY idx DESC) = 1""", DIVERSITY_CTES)
def w8(spark, sf):
    return audit.diversity_of_latest(beats(spark, sf))


@register("a4_diversity_summary", "script_id:i beat_count:i rejected_count:i mean_repetition:d max_repetition:d min_repetition:d diversity_grade:s", """
SELECT script_id, count(*) AS beat_count, count(*) FILTER (rejected) AS rejected_count, round(avg(repetition_score), 3) AS mean_repetition,
       max(repetition_score) AS max_repetition, min(repetition_score) AS min_repetition,
       CASE WHEN avg(repetition_score) <= 0.15 THEN 'A' WHEN avg(repetition_score) <= 0.30 THEN 'B' WHEN avg(repetition_score) <= 0.50 THEN 'C'
            WHEN avg(repetition_score) <= 0.70 THEN 'D' ELSE 'F' END AS diversity_grade
FROM dv GROUP BY script_id""", DIVERSITY_CTES)
def a4(spark, sf):
    return audit.diversity_summary(_diversity(spark, sf))


@register("a4_diversity_distribution", "script_id:i dimension:s label:s uses:i first_idx:i rank:i", """
SELECT *, row_number() OVER (PARTITION BY script_id, dimension ORDER BY uses DESC, first_idx) AS rank
FROM (SELECT script_id, dimension, label, count(*) AS uses, min(idx) AS first_idx
      FROM (SELECT script_id, idx, 'character' AS dimension, character AS label FROM dv
            UNION ALL SELECT script_id, idx, 'composition', composition FROM dv UNION ALL SELECT script_id, idx, 'arc', arc FROM dv)
      GROUP BY ALL)
QUALIFY rank <= 5""", DIVERSITY_CTES)
def a4_distribution(spark, sf):
    return audit.diversity_distribution(_diversity(spark, sf))


SIMPLE_CTES = BEATS_SQL + """,
en AS (SELECT *, list_sort(list_distinct([character, arc])) AS e FROM beats),
sl AS (SELECT script_id, idx, intensity, beat_type, layout_mode, motion_preset, query, visual_role, e,
         coalesce(lag(query, 1) OVER w = query, false) OR coalesce(lag(query, 2) OVER w = query, false) OR coalesce(lag(query, 3) OVER w = query, false) AS q,
         idx > 0 AND coalesce(lag(visual_role, 1) OVER w = visual_role, idx < 1) AND coalesce(lag(visual_role, 2) OVER w = visual_role, idx < 2)
           AND coalesce(lag(visual_role, 3) OVER w = visual_role, idx < 3) AS r,
         list_sort(list_distinct(list_concat(coalesce(lag(e, 1) OVER w, []), coalesce(lag(e, 2) OVER w, []), coalesce(lag(e, 3) OVER w, [])))) = e AND idx > 0 AS s
       FROM en WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
sd AS (SELECT *, round(1.0e0 - CAST(q AS INTEGER) * 0.35e0 - CAST(r AS INTEGER) * 0.22e0 - CAST(s AS INTEGER) * 0.15e0, 2) AS visual_diversity_score,
         CASE WHEN idx = 0 THEN 'Opening visual establishes the palette.' WHEN NOT (q OR r OR s) THEN 'role/query/entity mix changes from nearby slides'
              ELSE array_to_string(list_filter([CASE WHEN q THEN 'query repeats nearby' END, CASE WHEN r THEN 'visual role is overused' END,
                   CASE WHEN s THEN 'same entity cluster' END], lambda x: x IS NOT NULL), '; ') END AS diversity_notes,
         count(*) OVER (PARTITION BY script_id) AS n FROM sl)"""


def _simple(spark, sf):
    return audit.simple_diversity(beats(spark, sf).withColumn("entities", F.array("character", "arc")))


@register("w10_simple_diversity", "script_id:i idx:i visual_diversity_score:d diversity_notes:s", "SELECT * FROM sd", SIMPLE_CTES)
def w10(spark, sf):
    return _simple(spark, sf)


@register("w11_slide_retention", "script_id:i idx:i retention_score:d actions:s new_layout:s new_motion:s", """
SELECT script_id, idx, round(least(1.0, 0.45e0 + CASE WHEN beat_type IN ('hook', 'reveal', 'payoff') THEN 0.18e0 ELSE 0.08e0 END
         + 0.14e0 * visual_diversity_score + 0.12e0 * intensity), 2) AS retention_score,
       array_to_string(list_filter([CASE WHEN idx = 0 THEN 'added hook overlay' END,
         CASE WHEN beat_type = 'hook' AND layout_mode = 'safe_subject' THEN 'converted hook to readable title_card' END,
         CASE WHEN visual_diversity_score < 0.55 THEN 'flagged nearby visual repetition' END,
         CASE WHEN n > 1 AND idx = n - 1 AND beat_type <> 'cta' THEN 'final slide should resolve or invite response' END],
         lambda x: x IS NOT NULL), '; ') AS actions,
       CASE WHEN beat_type = 'hook' AND layout_mode = 'safe_subject' THEN 'title_card' ELSE layout_mode END AS new_layout,
       CASE WHEN visual_diversity_score < 0.55 THEN CASE WHEN beat_type = 'reveal' THEN 'reveal_zoom' ELSE 'subject_push' END ELSE motion_preset END AS new_motion
FROM sd""", SIMPLE_CTES)
def w11(spark, sf):
    rows = _simple(spark, sf).withColumns({"text_overlay": F.lit(""), "summary": F.col("subtitle_text")})
    out = audit.slide_retention(rows)
    return out.withColumns({"actions": F.array_join("retention_actions", "; "), "new_layout": F.col("layout_mode"), "new_motion": F.col("motion_preset")})


# ---- memory -------------------------------------------------------------------------------------

MEMORY_CTES = BEATS_SQL + """,
mem AS (SELECT script_id, idx, asset_id, row_number() OVER w - 1 AS reuse_count, coalesce(idx - lag(idx) OVER w, -1) AS beats_since_last, beat_type
        FROM beats WINDOW w AS (PARTITION BY script_id, asset_id ORDER BY idx)),
tr AS (SELECT *, reuse_count = 0 AS is_first, beat_type = 'reveal' AND reuse_count > 0 AS spoiled_reveal,
              beats_since_last > 0 AND beats_since_last < 5 AS premature_reuse FROM mem)"""


@register("w12_reuse_tracking", "script_id:i idx:i asset_id:s reuse_count:i is_first:b beats_since_last:i spoiled_reveal:b premature_reuse:b",
          "SELECT * FROM tr", MEMORY_CTES)
def w12(spark, sf):
    return sequence.track_reuse(beats(spark, sf))


@register("a6_reuse_summary", "script_id:i beat_count:i unique_assets:i total_reuses:i issue_count:i", """
SELECT script_id, count(*) AS beat_count, count(DISTINCT asset_id) AS unique_assets, count(*) - count(DISTINCT asset_id) AS total_reuses,
       sum(CAST(spoiled_reveal AS INTEGER) + CAST(premature_reuse AS INTEGER)) AS issue_count FROM tr GROUP BY script_id""", MEMORY_CTES)
def a6(spark, sf):
    return sequence.reuse_summary(sequence.track_reuse(beats(spark, sf)))


MEMORY_STATE = BEATS_SQL + """,
ms AS (SELECT script_id, asset_id, min(idx) AS first_seen, max(idx) AS last_seen, count(*) AS times_used FROM beats GROUP BY ALL),
ln AS (SELECT script_id, count(*) AS at_idx FROM beats GROUP BY script_id),
al AS (SELECT DISTINCT asset_id FROM beats)"""


@register("a7_asset_memory", "script_id:i asset_id:s first_seen:i last_seen:i times_used:i", "SELECT * FROM ms", MEMORY_STATE)
def a7(spark, sf):
    return sequence.asset_memory(beats(spark, sf))


@register("a7_memory_scores", "script_id:i idx:i asset_id:s reuse_score:d fatigue_score:d allowed:b callback_ok:b", """
SELECT b.script_id, b.idx, b.asset_id,
       CASE WHEN m.n IS NULL THEN 1.0 ELSE 0.4e0 / (m.n + 1) + 0.6e0 * least((l.at_idx + 2 - m.s) / 5.0e0, 1.0) END AS reuse_score,
       CASE WHEN m.n IS NULL THEN 0.0 ELSE greatest(0.0, least(m.n / 5.0e0, 1.0) - least((l.at_idx + 2 - m.s) / 10.0e0, 0.5)) END AS fatigue_score,
       m.n IS NULL OR (l.at_idx + 2 - m.s) > 3 AS allowed,
       m.n IS NOT NULL AND (l.at_idx + 2 - m.s) >= 8 AS callback_ok
FROM beats b JOIN ln l USING (script_id)
LEFT JOIN (SELECT script_id, asset_id, times_used AS n, last_seen AS s FROM ms WHERE times_used > 1) m USING (script_id, asset_id)""", MEMORY_STATE)
def a7_scores(spark, sf):
    b = beats(spark, sf)
    # candidates: every beat's own asset two beats after the script; the memory knows repeated assets only
    memory = sequence.asset_memory(b).filter("times_used > 1")
    size = b.groupBy("script_id").agg((F.count(F.lit(1)) + 2).alias("at_idx"))
    return sequence.memory_scores(b.select("script_id", "idx", "asset_id").join(size, "script_id"), memory)


# ---- rhythm, acts, carry-forward -------------------------------------------------------------------

RHYTHM_CTES = BEATS_SQL + """,
en AS (SELECT script_id, idx, greatest(0.0, least(1.0, 0.5e0
    + CASE WHEN beat_type IN ('hook', 'climax', 'payoff', 'action') THEN 0.2e0 WHEN beat_type IN ('evidence', 'context', 'resolution') THEN -0.15e0 ELSE 0.0 END
    + CASE WHEN emotion IN ('fear', 'rage', 'shock', 'triumph') THEN intensity * 0.3e0 WHEN emotion IN ('grief', 'calm', 'sadness') THEN intensity * -0.2e0 ELSE 0.0 END
    + CASE WHEN motion_preset IN ('impact_shake', 'dramatic_push', 'climax_zoom') THEN 0.15e0 WHEN motion_preset IN ('static_hold', 'grief_hold') THEN -0.2e0 ELSE 0.0 END)) AS energy
  FROM beats),
rh AS (SELECT *, CASE WHEN energy > 0.7 THEN 'fast' WHEN energy < 0.4 THEN 'slow' ELSE 'moderate' END AS tempo,
         CASE WHEN coalesce(abs(energy - lag(energy) OVER w) > 0.4, false) OR coalesce(abs(lead(energy) OVER w - energy) > 0.4, false)
              THEN 'high_contrast' ELSE 'smooth_blend' END AS contrast_target
       FROM en WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
isl AS (SELECT *, sum(CAST(NOT energy > 0.65 AS INTEGER)) OVER w AS hg, sum(CAST(NOT energy < 0.45 AS INTEGER)) OVER w AS lg
        FROM rh WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
iss AS (
  SELECT script_id, 'fatigue' AS issue_type, idx - 2 AS first_idx, idx AS last_idx
  FROM (SELECT *, row_number() OVER (PARTITION BY script_id, hg ORDER BY idx) AS n FROM isl WHERE energy > 0.65) WHERE n % 3 = 0
  UNION ALL
  SELECT script_id, 'boredom', idx - 3, idx
  FROM (SELECT *, row_number() OVER (PARTITION BY script_id, lg ORDER BY idx) AS n FROM isl WHERE energy < 0.45) WHERE n % 4 = 0)"""


@register("w13_visual_rhythm", "script_id:i idx:i energy:d tempo:s contrast_target:s", "SELECT * FROM rh", RHYTHM_CTES)
def w13(spark, sf):
    return sequence.visual_rhythm(beats(spark, sf))


STREAK = {"max_high": 2, "max_low": 3, "high": 0.65, "low": 0.45}


@register("w14_streak_issues", "script_id:i issue_type:s first_idx:i last_idx:i", "SELECT * FROM iss", RHYTHM_CTES)
def w14(spark, sf):
    return sequence.streak_issues(sequence.visual_rhythm(beats(spark, sf)), **STREAK)


@register("a8_rhythm_summary", "script_id:i beat_count:i avg_energy:d high_contrast_transitions:i issue_count:i", """
SELECT script_id, beat_count, avg_energy, high_contrast_transitions, coalesce(n, 0) AS issue_count
FROM (SELECT script_id, count(*) AS beat_count, avg(energy) AS avg_energy, count(*) FILTER (contrast_target = 'high_contrast') AS high_contrast_transitions
      FROM rh GROUP BY script_id) LEFT JOIN (SELECT script_id, count(*) AS n FROM iss GROUP BY script_id) USING (script_id)""", RHYTHM_CTES)
def a8_rhythm(spark, sf):
    r = sequence.visual_rhythm(beats(spark, sf))
    return sequence.rhythm_summary(r, sequence.streak_issues(r, **STREAK))


ARC_CTES = BEATS_SQL + """,
sz AS (SELECT script_id, idx, beat_type, count(*) OVER (PARTITION BY script_id) AS n FROM beats),
lim AS (SELECT *, greatest(1, CAST(floor(n * 0.2e0) AS BIGINT)) AS e1,
               greatest(greatest(1, CAST(floor(n * 0.2e0) AS BIGINT)) + 1, CAST(floor(n * 0.7e0) AS BIGINT)) AS e2 FROM sz),
ac AS (SELECT *, CASE WHEN idx < e1 THEN 'Act 1' WHEN idx < e2 THEN 'Act 2' ELSE 'Act 3' END AS act FROM lim),
pl AS (SELECT *, CASE WHEN beat_type IN ('hook', 'escalation') THEN 'fast' WHEN beat_type = 'evidence' THEN 'slow'
                 WHEN idx = 0 THEN 'fast' WHEN act = 'Act 3' THEN CASE WHEN idx < n - 1 THEN 'fast' ELSE 'slow' END ELSE 'moderate' END AS pacing_target,
              CASE WHEN beat_type IN ('hook', 'reveal') THEN 'high' WHEN beat_type IN ('escalation', 'evidence') THEN 'medium' ELSE 'low' END AS arc_significance
       FROM ac)"""


@register("w16_narrative_arc", "script_id:i idx:i act:s pacing_target:s arc_significance:s", "SELECT * FROM pl", ARC_CTES)
def w16(spark, sf):
    return sequence.narrative_arc(beats(spark, sf))


@register("a8_arc_summary", "script_id:i beat_count:i act_1_count:i act_2_count:i act_3_count:i high_significance_beats:i", """
SELECT script_id, count(*) AS beat_count, any_value(e1) AS act_1_count, any_value(e2 - e1) AS act_2_count, any_value(n - e2) AS act_3_count,
       count(*) FILTER (arc_significance = 'high') AS high_significance_beats FROM pl GROUP BY script_id""", ARC_CTES)
def a8_arc(spark, sf):
    return sequence.arc_summary(sequence.narrative_arc(beats(spark, sf)))


CARRY_CTES = BEATS_SQL + """,
own AS (SELECT script_id, idx, CASE WHEN CAST(asset_id AS BIGINT) % 3 = 0 THEN character WHEN visual_role = 'location' THEN 'Current Arc/Location' END AS e,
               CASE WHEN CAST(asset_id AS BIGINT) % 3 = 0 THEN CASE WHEN visual_role = 'character' THEN 'character' ELSE 'object' END
                    WHEN visual_role = 'location' THEN 'location' END AS t FROM beats),
cf AS (SELECT script_id, idx, coalesce(last_value(e IGNORE NULLS) OVER w, 'protagonist') AS entity, coalesce(last_value(t IGNORE NULLS) OVER w, 'character') AS entity_type
       FROM own WINDOW w AS (PARTITION BY script_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _carried(spark, sf):
    some = F.when(F.col("asset_id").cast("long") % 3 == 0, F.array("character")).otherwise(F.array().cast("array<string>"))
    return sequence.carry_entity(beats(spark, sf).withColumn("entities", some))


@register("w17_carry_forward", "script_id:i idx:i entity:s entity_type:s", "SELECT * FROM cf", CARRY_CTES)
def w17(spark, sf):
    return _carried(spark, sf)


@register("a8_entity_summary", "script_id:i beat_count:i unique_entities:i character_beats:i location_beats:i", """
SELECT script_id, count(*) AS beat_count, count(DISTINCT entity) AS unique_entities, count(*) FILTER (entity_type = 'character') AS character_beats,
       count(*) FILTER (entity_type = 'location') AS location_beats FROM cf GROUP BY script_id""", CARRY_CTES)
def a8_entities(spark, sf):
    return sequence.entity_summary(_carried(spark, sf))


# ---- gates --------------------------------------------------------------------------------------------

GATE_CTES = BEATS_SQL + """,
tt AS (SELECT *, 'cut' || (CAST(asset_id AS BIGINT) % 4) AS transition_type, intensity * 100 AS s FROM beats),
gl AS (SELECT *, lag(asset_id) OVER w AS pa, lag(transition_type) OVER w AS pt, lag(motion_preset) OVER w AS pm,
              sum(CAST(s >= 30 AS INTEGER)) OVER w AS grp FROM tt WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
gs AS (SELECT *, CASE WHEN s < 30 THEN sum(CAST(s < 30 AS INTEGER)) OVER (PARTITION BY script_id, grp ORDER BY idx) ELSE 0 END AS streak FROM gl),
gi AS (
  SELECT script_id, idx, 'ERROR' AS severity, 'reveal_too_long' AS rule, 'Maximum allowed is 8s.' AS detail FROM gs WHERE beat_type = 'reveal' AND end_s - start_s > 8
  UNION ALL SELECT script_id, idx, 'WARNING', 'hook_too_weak', 'Should be >= 70.' FROM gs WHERE beat_type = 'hook' AND s < 70
  UNION ALL SELECT script_id, idx, 'WARNING', 'low_energy_streak', 'streak of ' || CAST(streak AS BIGINT) FROM gs WHERE streak > 2
  UNION ALL SELECT script_id, idx, 'WARNING', 'repeated_asset', asset_id FROM gs WHERE asset_id = pa
  UNION ALL SELECT script_id, idx, 'INFO', 'repeated_transition', transition_type FROM gs WHERE transition_type = pt
  UNION ALL SELECT script_id, idx, 'INFO', 'repeated_motion', motion_preset FROM gs WHERE motion_preset = pm)"""


def _gated(spark, sf):
    return beats(spark, sf).withColumns({
        "transition_type": F.concat(F.lit("cut"), F.col("asset_id").cast("long") % 4), "emotion_score": F.col("intensity") * 100})


@register("w15_gate_issues", "script_id:i idx:i severity:s rule:s detail:s", "SELECT * FROM gi", GATE_CTES)
def w15(spark, sf):
    return audit.gate_issues(_gated(spark, sf))


@register("a11_gate_verdict", "script_id:i beat_count:i issue_count:i failing_count:i passed:b", """
SELECT script_id, beat_count, coalesce(i, 0) AS issue_count, coalesce(f, 0) AS failing_count, coalesce(f, 0) = 0 AS passed
FROM (SELECT script_id, count(*) AS beat_count FROM beats GROUP BY script_id)
LEFT JOIN (SELECT script_id, count(*) AS i, count(*) FILTER (severity = 'ERROR') AS f FROM gi GROUP BY script_id) USING (script_id)""", GATE_CTES)
def a11(spark, sf):
    b = _gated(spark, sf)
    return audit.gate_verdict(b, audit.gate_issues(b))


P7_CTES = BEATS_SQL + """,
holes AS (SELECT script_id, idx, CASE WHEN CAST(asset_id AS BIGINT) % 9 = 0 THEN NULL ELSE beat_type END AS beat_type,
                 CASE WHEN CAST(asset_id AS BIGINT) % 8 = 0 THEN '' ELSE visual_role END AS visual_role,
                 CASE WHEN CAST(asset_id AS BIGINT) % 7 = 0 THEN NULL ELSE motion_preset END AS motion_preset,
                 CASE WHEN CAST(asset_id AS BIGINT) % 11 = 0 THEN '' ELSE subtitle_text END AS subtitle_text,
                 CASE WHEN CAST(asset_id AS BIGINT) % 13 = 0 THEN NULL ELSE end_s END AS end_s FROM beats)"""


def _holes(spark, sf):
    k = F.col("asset_id").cast("long")
    return beats(spark, sf).withColumns({
        "beat_type": F.when(k % 9 != 0, F.col("beat_type")), "visual_role": F.when(k % 8 == 0, "").otherwise(F.col("visual_role")),
        "motion_preset": F.when(k % 7 != 0, F.col("motion_preset")), "subtitle_text": F.when(k % 11 == 0, "").otherwise(F.col("subtitle_text")),
        "end_s": F.when(k % 13 != 0, F.col("end_s")), "summary": F.lit("")})


@register("p7_required_key_issues", "script_id:i idx:i severity:s detail:s", """
SELECT script_id, idx, 'warning' AS severity, 'Missing beat_type. Auto-fixed to ''neutral''.' AS detail FROM holes WHERE coalesce(beat_type, '') = ''
UNION ALL SELECT script_id, idx, 'warning', 'Missing visual_role. Auto-fixed to ''character''.' FROM holes WHERE coalesce(visual_role, '') = ''
UNION ALL SELECT script_id, idx, 'warning', 'Missing motion_preset. Auto-fixed to ''static_hold''.' FROM holes WHERE coalesce(motion_preset, '') = ''
UNION ALL SELECT script_id, idx, 'critical', 'Beat has no subtitle_text and no summary.' FROM holes WHERE coalesce(subtitle_text, '') = ''
UNION ALL SELECT script_id, idx, 'warning', 'Missing start_time or end_time.' FROM holes WHERE end_s IS NULL""", P7_CTES)
def p7(spark, sf):
    return audit.required_key_issues(_holes(spark, sf))


@register("p7_autofix", "script_id:i idx:i beat_type:s visual_role:s motion_preset:s", """
SELECT script_id, idx, coalesce(nullif(beat_type, ''), 'neutral') AS beat_type, coalesce(nullif(visual_role, ''), 'character') AS visual_role,
       coalesce(nullif(motion_preset, ''), 'static_hold') AS motion_preset FROM holes""", P7_CTES)
def p7_fix(spark, sf):
    return audit.autofix(_holes(spark, sf))


@register("a12_visual_quality_report", "script_id:i slide_count:i repeated_query_hits:i overlong_holds:i missing_assets:i low_confidence:i transition_count:i transition_dense:b status:s", """
SELECT *, transition_count > greatest(2.0, slide_count * 0.85e0) AS transition_dense,
       CASE WHEN repeated_query_hits + overlong_holds + missing_assets + low_confidence > 0 OR transition_count > greatest(2.0, slide_count * 0.85e0)
            THEN 'review' ELSE 'ok' END AS status
FROM (SELECT script_id, count(*) AS slide_count, count(*) FILTER (pos >= 3) AS repeated_query_hits, count(*) FILTER (end_s - start_s > 8.0) AS overlong_holds,
             0 AS missing_assets, count(*) FILTER (CASE WHEN intensity = 0 THEN 1.0 ELSE intensity END < 0.55) AS low_confidence,
             count(*) FILTER (idx > 0 AND CAST(asset_id AS BIGINT) % 3 > 0) AS transition_count
      FROM (SELECT *, row_number() OVER (PARTITION BY script_id, query, g ORDER BY idx) AS pos
            FROM (SELECT *, idx - row_number() OVER (PARTITION BY script_id, query ORDER BY idx) AS g FROM beats)) GROUP BY script_id)""", BEATS_SQL)
def a12(spark, sf):
    b = beats(spark, sf)
    k = b["asset_id"].cast("long") % 3
    return audit.visual_quality_report(b.withColumns({
        "image_path": F.lit(""), "asset_confidence": F.col("intensity"), "transition_type": F.when(k > 0, F.concat(F.lit("cut"), k)).otherwise("none")}))


# ---- curve -----------------------------------------------------------------------------------------------

LEX = [(r"\b(error)\b", "tension", -0.35, 0.15), (r"\b(purchase|signup)\b", "hope", 0.45, 0.10), (r"\b(click|error)\b", "shock", -0.10, 0.25)]

def _case(n: int) -> str:
    lit = lambda v: str(v).lower() if isinstance(v, bool) else f"{v}e0"
    return "CASE beat_type " + " ".join(f"WHEN '{b}' THEN {lit(p[n])}" for b, p in curve.BEAT_PROFILES.items()) + f" ELSE {lit(curve.OTHER_PROFILE[n])} END"


CURVE_CTES = BEATS_SQL + f""",
ce AS (SELECT script_id, idx, beat_type, intensity, count(*) OVER (PARTITION BY script_id) AS n, coalesce(lag(beat_type) OVER (PARTITION BY script_id ORDER BY idx), '') AS prev,
         CASE WHEN regexp_matches(subtitle_text, '\\b(click|error)\\b') THEN 0.25e0 WHEN regexp_matches(subtitle_text, '\\b(purchase|signup)\\b') THEN 0.10e0 ELSE 0.0 END AS boost,
         CASE WHEN regexp_matches(subtitle_text, '\\b(click|error)\\b') THEN 'shock' WHEN regexp_matches(subtitle_text, '\\b(purchase|signup)\\b') THEN 'hope' ELSE 'curious' END AS label,
         CASE WHEN regexp_matches(subtitle_text, '\\b(click|error)\\b') THEN -0.10e0 WHEN regexp_matches(subtitle_text, '\\b(purchase|signup)\\b') THEN 0.45e0 ELSE 0.0 END AS shift
       FROM beats),
cr AS (SELECT *, {_case(0)} + boost + CASE WHEN n > 1 THEN 0.08e0 * sin(idx / CAST(greatest(1, n - 1) AS DOUBLE) * pi() * 0.9e0) ELSE 0.0 END
         + CASE WHEN beat_type IN ('escalation', 'evidence') AND prev IN ('escalation', 'evidence', 'setup') THEN 0.06e0
                WHEN beat_type = 'reveal' AND prev IN ('escalation', 'mystery', 'contradiction') THEN 0.08e0
                WHEN beat_type = 'payoff' AND prev IN ('reveal', 'escalation', 'warning') THEN 0.06e0 ELSE 0.0 END
         + (intensity - 0.5e0) * 0.08e0 AS raw, {_case(3)} AS spike,
         greatest(-1.0, least(1.0, {_case(1)} + shift * 0.5e0)) AS valence, greatest(0.0, least(1.0, {_case(2)} + boost * 0.5e0)) AS energy FROM ce),
cp AS (SELECT *, greatest(0.0, least(1.0, CASE beat_type WHEN 'hook' THEN greatest(raw, 0.78e0) WHEN 'reveal' THEN greatest(raw, 0.82e0)
         WHEN 'payoff' THEN greatest(raw, 0.90e0) WHEN 'cta' THEN least(raw, 0.30e0) ELSE raw END)) AS score0 FROM cr),
cs AS (
  SELECT script_id, idx, n, spike, score0, score0 AS score FROM cp WHERE idx = 0
  UNION ALL
  SELECT p.script_id, p.idx, p.n, p.spike, p.score0, CASE WHEN p.spike OR p.n <= 2 THEN p.score0 ELSE greatest(0.0, least(1.0, 0.15e0 * c.score + 0.85e0 * p.score0)) END
  FROM cs c JOIN cp p ON p.script_id = c.script_id AND p.idx = c.idx + 1),
cx AS (SELECT cp.script_id, cp.idx, cp.beat_type, cp.n, cp.spike, cp.valence, cp.label, cs.score FROM cp JOIN cs USING (script_id, idx))"""


def _points(spark, sf):
    return curve.emotion_points(beats(spark, sf), "subtitle_text", "intensity", LEX, unicode=False)


@register("w18_emotion_points", "script_id:i idx:i score:d valence:d energy:d label:s spike:b",
          "SELECT script_id, idx, score0 AS score, valence, energy, label, spike FROM cp", CURVE_CTES)
def w18(spark, sf):
    return _points(spark, sf)


@register("w19_smoothed_curve", "script_id:i idx:i score:d", "SELECT script_id, idx, score FROM cs", CURVE_CTES)
def w19(spark, sf):
    return curve.smooth_curve(_points(spark, sf))


@register("a2_curve_summary", "script_id:i beat_count:i mean_intensity:d peak_intensity:d peak_index:i peak_beat_type:s trough_intensity:d intensity_range:d spike_count:i arc_shape:s dominant_emotion:s valence_trend:s", """
SELECT script_id, n AS beat_count, round(m, 3) AS mean_intensity, round(hi, 3) AS peak_intensity, pi AS peak_index, pb AS peak_beat_type,
       round(lo, 3) AS trough_intensity, round(hi - lo, 3) AS intensity_range, sp AS spike_count,
       CASE WHEN n < 3 THEN 'flat' WHEN pi / CAST(greatest(1, n - 1) AS DOUBLE) >= 0.7 THEN 'rising_climax' WHEN pi / CAST(greatest(1, n - 1) AS DOUBLE) <= 0.2 THEN 'front_loaded'
            WHEN a2 > a1 AND a2 > a3 THEN 'mountain' WHEN a1 > a2 AND a3 > a2 THEN 'valley' WHEN hi - lo < 0.15 THEN 'flat' ELSE 'wave' END AS arc_shape,
       dominant_emotion, CASE WHEN n < 2 THEN 'neutral' WHEN v > 0.15 THEN 'positive' WHEN v < -0.15 THEN 'negative' ELSE 'mixed' END AS valence_trend
FROM (SELECT script_id, any_value(n) AS n, avg(score) AS m, max(score) AS hi, min(score) AS lo, arg_max(idx, (score, -idx)) AS pi, arg_max(beat_type, (score, -idx)) AS pb,
             count(*) FILTER (spike) AS sp, avg(valence) AS v,
             coalesce(sum(score) FILTER (idx < n // 3), 0.0) / greatest(1, any_value(n) // 3) AS a1,
             coalesce(sum(score) FILTER (idx >= n // 3 AND idx < 2 * n // 3), 0.0) / greatest(1, any_value(n) // 3) AS a2,
             coalesce(sum(score) FILTER (idx >= 2 * n // 3), 0.0) / greatest(1, any_value(n) - 2 * any_value(n) // 3) AS a3 FROM cx GROUP BY script_id)
JOIN (SELECT script_id, arg_max(label, (c, -f)) AS dominant_emotion FROM (SELECT script_id, label, count(*) AS c, min(idx) AS f FROM cx GROUP BY ALL) GROUP BY script_id) USING (script_id)""", CURVE_CTES)
def a2(spark, sf):
    return curve.curve_summary(curve.smooth_curve(_points(spark, sf)))


# ---- expansion, camera, status -----------------------------------------------------------------------------------

@register("w39_parallel_cuts", "script_id:i idx:i half:i start_2us:i end_2us:i query:s summary:s transition_type:s pacing_intent:s", """
SELECT *, round(start_s * 2e6) AS start_2us, round(end_s * 2e6) AS end_2us FROM (
SELECT script_id, idx, 0 AS half, start_s, CASE WHEN p THEN start_s + (end_s - start_s) / 2.0 ELSE end_s END AS end_s, query, subtitle_text AS summary,
       'cut' AS transition_type, CASE WHEN p THEN 'rapid_montage' ELSE 'standard' END AS pacing_intent
FROM (SELECT *, CAST(asset_id AS BIGINT) % 5 = 0 AS p FROM beats)
UNION ALL
SELECT script_id, idx, 1, start_s + (end_s - start_s) / 2.0, end_s, query || ' alternate view', subtitle_text || ' (alt angle)', 'crossfade', 'rapid_montage'
FROM beats WHERE CAST(asset_id AS BIGINT) % 5 = 0)""", BEATS_SQL)
def w39(spark, sf):
    b = beats(spark, sf)
    out = sequence.expand_parallel(b.withColumns({
        "pacing_intent": F.when(F.col("asset_id").cast("long") % 5 == 0, "parallel_cut").otherwise("standard"),
        "summary": F.col("subtitle_text"), "transition_type": F.lit("cut")}))
    # a middle lies on half a microsecond: whole numbers of those compare exactly
    return out.withColumns({"start_2us": F.round(F.col("start_s") * 2e6), "end_2us": F.round(F.col("end_s") * 2e6)})


@register("w45_camera_plan", "script_id:i idx:i camera_goal:s motion_intensity:d transition_in:s", """
SELECT script_id, idx, g || CASE WHEN coalesce(p = motion_preset, false) AND motion_preset NOT IN ('title_card_hold', 'static_hold') THEN '_alternate_framing' ELSE '' END AS camera_goal,
       round(least(1.0, greatest(0.15, CASE WHEN intensity = 0 THEN 0.45 ELSE intensity * 1.0007e0 END)), 2) AS motion_intensity,
       CASE beat_type WHEN 'reveal' THEN 'zoom_dissolve' WHEN 'escalation' THEN 'whip_pan_right' ELSE 'crossfade' END AS transition_in
FROM (SELECT *, lag(motion_preset) OVER (PARTITION BY script_id ORDER BY idx) AS p,
             CASE visual_role WHEN 'character' THEN 'face_lock_push' WHEN 'evidence' THEN 'inspect_detail' WHEN 'location' THEN 'wide_context_pan' ELSE 'centered_icon_hold' END AS g FROM beats)""", BEATS_SQL)
def w45(spark, sf):
    # the factor keeps two-decimal ties out of the comparison
    return sequence.camera_plan(beats(spark, sf).withColumn("intensity", F.col("intensity") * 1.0007))


@register("w31_transition_events", "script_id:i idx:i time_s:d transition:s", """
SELECT script_id, idx, start_s AS time_s, motion_preset AS transition FROM beats WHERE idx > 0
UNION ALL SELECT script_id, idx, start_s + (1 / 3.0e0) * (end_s - start_s), 'bass_hit' FROM beats WHERE beat_type = 'reveal' AND end_s > start_s""", BEATS_SQL)
def w31(spark, sf):
    b = beats(spark, sf)
    return sequence.transition_events(b.withColumns({"transition_type": F.col("motion_preset"), "target_word": F.when(F.col("beat_type") == "reveal", "Scene").otherwise("")}))


LOG = ", log AS (SELECT user_id AS session_id, event_type AS stage, ts, event_id, CASE WHEN value > 60 THEN 'failed' ELSE 'done' END AS status, CASE WHEN value > 60 THEN 'value too high' END AS error FROM events)"


@register("s14_latest_status", "session_id:i stage:s status:s error:s steps:s", """
SELECT l.session_id, l.stage, l.status, l.error, s.steps FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1) l
JOIN (SELECT session_id, string_agg(stage || '=' || status, ',' ORDER BY stage) AS steps
      FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY session_id, stage ORDER BY ts DESC, event_id DESC) = 1) GROUP BY session_id) s USING (session_id)""", LOG.lstrip(", "))
def s14(spark, sf):
    from storyspark.plans.views import table

    bad = F.col("value") > 60
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("stage"), F.when(bad, "failed").otherwise("done").alias("status"),
        F.when(bad, "value too high").alias("error"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    out = sequence.latest_status(log)
    pairs = F.transform(F.array_sort(F.map_entries("steps")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["status"]))
    return out.withColumn("steps", F.array_join(pairs, ","))


@register("p14_upload_status", "script_id:i total:i uploaded:i missing:i complete:b", """
SELECT script_id, count(*) AS total, count(*) FILTER (intensity >= 0.02) AS uploaded, count(*) FILTER (intensity < 0.02) AS missing,
       count(*) FILTER (intensity < 0.02) = 0 AS complete FROM beats GROUP BY script_id""", BEATS_SQL)
def p14(spark, sf):
    return sequence.upload_status(beats(spark, sf).withColumn("image_path", F.when(F.col("intensity") >= 0.02, F.concat(F.lit("img/"), "asset_id"))))
