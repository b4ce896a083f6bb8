"""Queries over timed intervals, cues and allocations."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyspark.functions.rules import expression_label
from storyspark.operators import intervals, planners, sequence
from storyspark.operators.ordered import number_rows
from storyspark.plans.views import BEATS_SQL, beats, table
from storyspark.queries.registry import register

SLIDES_SQL = BEATS_SQL + """,
slides AS (SELECT script_id, idx, start_s, start_s + 100000 AS end_s FROM beats WHERE beat_type = 'hook')"""


def _slides(b):
    return b.filter("beat_type = 'hook'").select("script_id", "idx", "start_s", (F.col("start_s") + 100000).alias("end_s"))


@register("j6_overlapping_text", "script_id:i idx:i subtitle_text:s line_count:i", """
SELECT s.script_id, s.idx, coalesce(string_agg(l.subtitle_text, ' ' ORDER BY l.start_s, l.idx), '') AS subtitle_text, count(l.idx) AS line_count
FROM slides s LEFT JOIN beats l ON l.script_id = s.script_id AND l.end_s > s.start_s AND l.start_s < s.end_s GROUP BY s.script_id, s.idx""", SLIDES_SQL)
def j6(spark, sf):
    b = beats(spark, sf)
    lines = b.select("script_id", "idx", "start_s", "end_s", F.col("subtitle_text").alias("text"))
    return intervals.overlapping_text(lines, _slides(b))


@register("j6_overlap_lines", "script_id:i idx:i position:i line:i text:s", """
SELECT s.script_id, s.idx, row_number() OVER (PARTITION BY s.script_id, s.idx ORDER BY l.start_s, l.idx) - 1 AS position, l.idx AS line, l.subtitle_text AS text
FROM (SELECT script_id, idx, start_s, CASE WHEN idx % 9 = 0 THEN start_s + 31536000 ELSE end_s END AS end_s FROM slides) s
JOIN beats l ON l.script_id = s.script_id AND l.end_s > s.start_s AND l.start_s < s.end_s""", SLIDES_SQL)
def j6_lines(spark, sf):
    """Every ninth slide has a wrong end, a year later."""
    b = beats(spark, sf)
    wrong = _slides(b).withColumn("end_s", F.when(F.col("idx") % 9 == 0, F.col("start_s") + 31_536_000).otherwise(F.col("end_s")))
    return intervals.overlapping_lines(b.select("script_id", "idx", "start_s", "end_s", F.col("subtitle_text").alias("text")), wrong)


@register("j7_snap_to_nearest", "script_id:i idx:i snapped:d", """
SELECT p.script_id, p.idx, coalesce(arg_min(r.start_s, (abs(r.start_s - p.start_s), r.start_s)), any_value(p.start_s)) AS snapped
FROM slides p LEFT JOIN (SELECT script_id, start_s FROM beats WHERE beat_type = 'reveal') r
  ON r.script_id = p.script_id AND abs(r.start_s - p.start_s) <= 7200 GROUP BY p.script_id, p.idx""", SLIDES_SQL)
def j7(spark, sf):
    b = beats(spark, sf)
    return intervals.snap_to_nearest(_slides(b), b.filter("beat_type = 'reveal'"), tolerance=7200.0)


@register("j8_align_cues", "script_id:i idx:i expression:s character:s", """
SELECT l.script_id, l.idx, coalesce(CASE WHEN t.idx IS NOT NULL THEN t.emotion WHEN abs(p.start_s + 1 - l.start_s) <= 2 THEN p.emotion END, 'neutral') AS expression,
       coalesce(CASE WHEN t.idx IS NOT NULL THEN t.character WHEN abs(p.start_s + 1 - l.start_s) <= 2 THEN p.character END, 'narrator') AS character
FROM (SELECT *, row_number() OVER (PARTITION BY script_id, subtitle_text ORDER BY idx) AS k FROM beats) l
LEFT JOIN cue t ON t.script_id = l.script_id AND t.txt = l.subtitle_text AND t.k = l.k
LEFT JOIN (SELECT * FROM cue c WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY script_id, subtitle_text ORDER BY idx) AS k FROM beats) b
           WHERE b.script_id = c.script_id AND b.subtitle_text = c.txt AND b.k = c.k)) p ON p.script_id = l.script_id AND p.idx = l.idx""", BEATS_SQL + """,
cue AS (SELECT *, row_number() OVER (PARTITION BY script_id, txt ORDER BY idx) AS k
        FROM (SELECT *, CASE WHEN CAST(asset_id AS BIGINT) % 4 = 0 THEN subtitle_text || ' changed' ELSE subtitle_text END AS txt FROM beats WHERE CAST(asset_id AS BIGINT) % 5 > 0))""")
def j8(spark, sf):
    b = beats(spark, sf).withColumn("text", F.col("subtitle_text"))
    k = F.col("asset_id").cast("long")
    cues = b.filter(k % 5 > 0).select("script_id", "idx", (F.col("start_s") + 1).alias("start_s"), F.col("emotion").alias("expression"), "character",
                                      F.when(k % 4 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))
    return intervals.align_cues(b.select("script_id", "idx", "start_s", "text"), cues)


SHORT = BEATS_SQL + """,
sh AS (SELECT script_id, idx, start_s, start_s + least(end_s - start_s, 20000) AS end_s, subtitle_text, emotion, character, beat_type, asset_id,
              max(start_s) OVER (PARTITION BY script_id) + 50000 AS total_s FROM beats)"""


def _short(spark, sf, cap=20000):
    b = beats(spark, sf)
    total = b.groupBy("script_id").agg((F.max("start_s") + 50000).alias("total_s"))
    return b.withColumn("end_s", F.col("start_s") + F.least(F.col("end_s") - F.col("start_s"), F.lit(cap))).join(total, "script_id")


@register("w20_fill_gaps", "script_id:i idx:i kind:s start_s:d end_s:d", """
SELECT script_id, idx, 'slide' AS kind, start_s, end_s FROM sh
UNION ALL SELECT * FROM (SELECT script_id, idx, 'Silence/Transition', coalesce(lag(end_s) OVER (PARTITION BY script_id ORDER BY idx), 0.0) AS a, start_s AS z FROM sh) WHERE z > a
UNION ALL SELECT script_id, idx, 'Ending/Outro', end_s, total_s FROM sh WHERE end_s < total_s AND idx = (SELECT max(idx) FROM sh s2 WHERE s2.script_id = sh.script_id)""", SHORT)
def w20(spark, sf):
    return intervals.fill_gaps(_short(spark, sf))


@register("w21_repair_cuts", "script_id:i idx:i new_start:d new_end:d", """
SELECT script_id, idx, c AS new_start, CASE WHEN coalesce(lead(c) OVER w, total) <= c THEN least(total, c + 0.05) ELSE coalesce(lead(c) OVER w, total) END AS new_end
FROM (SELECT script_id, idx, total, 0.05e0 * idx + max(CASE WHEN idx = 0 THEN 0.0 ELSE least(cut, total) - 0.05e0 * idx END)
             OVER (PARTITION BY script_id ORDER BY idx) AS c
      FROM (SELECT script_id, idx, start_s / 400000 AS cut, max(start_s) OVER (PARTITION BY script_id) / 500000 AS total FROM beats))
WINDOW w AS (PARTITION BY script_id ORDER BY idx)""", BEATS_SQL)
def w21(spark, sf):
    b = beats(spark, sf)
    total = b.groupBy("script_id").agg((F.max("start_s") / 500000).alias("total_s"))
    return intervals.repair_cuts(b.withColumn("snapped", F.col("start_s") / 400000).join(total, "script_id"))


@register("w22_trim_overlaps", "script_id:i idx:i start_s:d end_s:d text:s", """
SELECT script_id, idx, start_s, CASE WHEN e > nx THEN nx - 0.001 ELSE e END AS end_s, text
FROM (SELECT script_id, idx, start_s, start_s + 30000 AS e, lead(start_s) OVER (PARTITION BY script_id ORDER BY idx) AS nx,
             CASE WHEN CAST(asset_id AS BIGINT) % 7 = 0 THEN '' ELSE subtitle_text END AS text FROM beats) WHERE text <> ''""", BEATS_SQL)
def w22(spark, sf):
    b = beats(spark, sf)
    return intervals.trim_overlaps(b.withColumns({
        "end_s": F.col("start_s") + 30000, "text": F.when(F.col("asset_id").cast("long") % 7 == 0, " ").otherwise(F.col("subtitle_text"))}))


TALK = """
tk AS (SELECT conv_id AS script_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, CASE WHEN length(text) % 3 = 0 THEN 'a' ELSE 'b' END AS who,
              'dialogue' AS kind, text FROM conversations)"""


@register("w23_merge_dialogue", "script_id:i run_start:i who:s merged_rows:i text:s", """
SELECT script_id, min(idx) AS run_start, who, count(*) AS merged_rows, string_agg(text, ' ' ORDER BY idx) AS text
FROM (SELECT *, idx - row_number() OVER (PARTITION BY script_id, who ORDER BY idx) AS g FROM tk) GROUP BY script_id, who, g""", TALK)
def w23(spark, sf):
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("script_id"), "turn", "text",
                                                 F.when(F.length("text") % 3 == 0, "a").otherwise("b").alias("who"), F.lit("dialogue").alias("kind"))
    return intervals.merge_same(number_rows(t, "script_id", ["turn"]), ["who", "kind"])


@register("w24_merge_cues", "script_id:i run_start:i expression:s start_s:d end_s:d merged_rows:i", """
SELECT script_id, min(idx) AS run_start, any_value(emotion) AS expression, min(start_s) AS start_s, arg_max(end_s, idx) AS end_s, count(*) AS merged_rows
FROM (SELECT *, sum(n) OVER (PARTITION BY script_id ORDER BY idx) AS g
      FROM (SELECT *, CASE WHEN lag(emotion) OVER w = emotion AND start_s <= lag(end_s) OVER w + 9000 THEN 0 ELSE 1 END AS n FROM sh WINDOW w AS (PARTITION BY script_id ORDER BY idx)))
GROUP BY script_id, g""", SHORT)
def w24(spark, sf):
    return intervals.merge_cues(_short(spark, sf).withColumnRenamed("emotion", "expression"), slack=9000.0)


@register("w25_absorb_fillers", "script_id:i idx:i summary:s start_s:d end_s:d absorbed:i", """
SELECT script_id, min(idx) AS idx, arg_min(subtitle_text, idx) AS summary, min(start_s) AS start_s, arg_max(end_s, idx) AS end_s, count(*) - 1 AS absorbed
FROM (SELECT *, sum(CAST(NOT contains(subtitle_text, 'click') AS INTEGER)) OVER (PARTITION BY script_id ORDER BY idx) AS g FROM sh)
WHERE g > 0 GROUP BY script_id, g""", SHORT)
def w25(spark, sf):
    return intervals.absorb_fillers(_short(spark, sf), "subtitle_text", ["click"]).withColumnRenamed("subtitle_text", "summary")


MERGE_SQL = """
SELECT script_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS source_count
FROM (SELECT *, sum(n) OVER (PARTITION BY script_id ORDER BY start_s, idx) AS g
      FROM (SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY script_id ORDER BY start_s, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5000
                           THEN 0 ELSE 1 END AS n FROM sh))
GROUP BY script_id, g"""


@register("w26_merge_intervals", "script_id:i start_s:d end_s:d source_count:i", MERGE_SQL, SHORT)
def w26(spark, sf):
    return intervals.merge_intervals(_short(spark, sf), gap=5000.0)


@register("w27_sanitize_intervals", "script_id:i idx:i start_s:d end_s:d", """
SELECT script_id, idx, round(start_s, 3) AS start_s, round(CASE WHEN e1 - start_s > 50000 THEN start_s + 50000 ELSE e1 END, 3) AS end_s
FROM (SELECT script_id, idx, start_s + 0.0002371 AS start_s, CASE WHEN e > nx THEN greatest(start_s + 0.0502371, nx + 0.0002371 - 0.01) ELSE e END AS e1
      FROM (SELECT script_id, idx, start_s, start_s + 0.0002371 + (end_s - start_s) * 1.2e0 AS e, lead(start_s) OVER (PARTITION BY script_id ORDER BY start_s, idx) AS nx FROM beats))""", BEATS_SQL)
def w27(spark, sf):
    b = beats(spark, sf)
    moved = F.col("start_s") + 0.0002371   # keeps three-decimal ties out of the comparison
    return intervals.sanitize_intervals(b.withColumns({"end_s": moved + (F.col("end_s") - F.col("start_s")) * 1.2, "start_s": moved}), max_s=50000.0)


PREPARE_SQL = """
SELECT script_id, character, any_value(emotion) AS expression, min(start_s) AS start_s, arg_max(end_s, idx) AS end_s, count(*) AS cue_rows
FROM (SELECT *, sum(brk) OVER (PARTITION BY script_id, character, run ORDER BY idx) AS broken
      FROM (SELECT *, CASE WHEN same AND start_s > pe + 200000 THEN 1 ELSE 0 END AS brk, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY script_id, character ORDER BY idx) AS run
            FROM (SELECT *, coalesce(lag(emotion) OVER w = emotion, false) AS same, lag(end_s) OVER w AS pe
                  FROM sh WHERE emotion <> 'neutral' WINDOW w AS (PARTITION BY script_id, character ORDER BY start_s, idx))))
WHERE broken = 0 GROUP BY script_id, character, run"""


@register("w28_prepare_cues", "script_id:i character:s expression:s start_s:d end_s:d cue_rows:i", PREPARE_SQL, SHORT)
def w28(spark, sf):
    return intervals.prepare_cues(_short(spark, sf).withColumnRenamed("emotion", "expression"), gap=200000.0)


@register("a13_cue_groups", "script_id:i character:s expression:s cue_count:i first_start:d last_end:d context:s", """
SELECT script_id, character, emotion AS expression, count(*) AS cue_count, min(start_s) AS first_start, max(end_s) AS last_end,
       string_agg(subtitle_text, ' | ' ORDER BY idx) FILTER (n <= 4) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY script_id, character, emotion ORDER BY idx) AS n FROM sh) GROUP BY ALL""", SHORT)
def a13(spark, sf):
    cues = _short(spark, sf).withColumnRenamed("emotion", "expression").withColumn("text", F.col("subtitle_text"))
    return sequence.cue_groups(cues)


# ---- folds ------------------------------------------------------------------------------------------

@register("w35_drop_overlapping", "script_id:i idx:i start_s:d end_s:d", """
SELECT script_id, idx, start_s, end_s FROM keep WHERE kept""", BEATS_SQL + """,
lg AS (SELECT script_id, idx, start_s, start_s + 25000 AS end_s FROM beats),
keep AS (
  SELECT script_id, idx, start_s, end_s, true AS kept, end_s AS m FROM lg WHERE idx = 0
  UNION ALL
  SELECT l.script_id, l.idx, l.start_s, l.end_s, NOT (k.m - l.start_s > 0.1), CASE WHEN k.m - l.start_s > 0.1 THEN k.m ELSE greatest(k.m, l.end_s) END
  FROM keep k JOIN lg l ON l.script_id = k.script_id AND l.idx = k.idx + 1)""")
def w35(spark, sf):
    b = beats(spark, sf)
    return planners.drop_overlapping(b.withColumn("end_s", F.col("start_s") + 25000))


@register("w32_group_short_lines", "script_id:i idx:i start_s:d end_s:d text:s line_count:i", """
SELECT g.script_id, first AS idx, min(b.start_s) AS start_s, arg_max(b.end_s, b.idx) AS end_s, string_agg(b.w, ' ' ORDER BY b.idx) AS text, count(*) AS line_count
FROM g JOIN ln b USING (script_id, idx) GROUP BY g.script_id, first""", BEATS_SQL + """,
ln AS (SELECT script_id, idx, start_s, end_s, string_split(subtitle_text, ' ')[1] AS w FROM beats),
g AS (SELECT script_id, idx, 0::BIGINT AS first, 1 AS n FROM ln WHERE idx = 0
      UNION ALL SELECT l.script_id, l.idx, CASE WHEN g.n < 3 THEN g.first ELSE l.idx END, CASE WHEN g.n < 3 THEN g.n + 1 ELSE 1 END
      FROM g JOIN ln l ON l.script_id = g.script_id AND l.idx = g.idx + 1)""")
def w32(spark, sf):
    return planners.group_short_lines(beats(spark, sf).withColumn("text", F.split("subtitle_text", " ")[0]))


ENRICH_SQL = BEATS_SQL + """,
ln AS (SELECT script_id, idx, start_s / sc AS s, end_s / sc AS e, subtitle_text || [' of the truth', ' why so', ' so sad', ' dream'][k4 + 1] AS t,
              ['confident', 'surprised', 'worried', CASE WHEN idx < 3 THEN 'excited' ELSE 'serious' END][k4 + 1] AS lab, [6, 5, 5, 4][k4 + 1] AS words, beat_type, intensity, emotion, character
       FROM (SELECT *, CAST(CAST(asset_id AS BIGINT) % 4 AS INTEGER) AS k4, CASE WHEN script_id % 2 = 0 THEN 25000 ELSE 2000 END AS sc FROM beats)),
gv AS (SELECT * FROM ln WHERE beat_type = 'reveal' AND intensity > 0.3 AND (script_id % 3 > 0 OR idx % 20 = 0)),
gh AS (SELECT script_id, count(*) AS have, max(s) AS late, arg_max(emotion, (s, idx)) AS prev FROM gv WHERE emotion <> 'neutral' GROUP BY script_id),
pn AS (SELECT script_id, coalesce(prev, '') AS prev, CASE WHEN t < 120 THEN 5.5e0 ELSE 14.0e0 END AS gap, CASE WHEN t < 120 THEN 3 ELSE 5 END AS least_words, greatest(1, target - have) AS room
       FROM (SELECT script_id, t, prev, coalesce(have, 0) AS have, coalesce(late, -1) AS late,
                    CASE WHEN t < 120 THEN greatest(3, least(9, CAST(floor(t / 7) AS BIGINT) + 1)) ELSE greatest(8, least(28, CAST(floor(t / 22) AS BIGINT))) END AS target
             FROM (SELECT script_id, arg_max(e, idx) - arg_min(s, idx) AS t FROM ln GROUP BY script_id) LEFT JOIN gh USING (script_id))
       WHERE t > 0 AND NOT (have >= target AND (late >= t * 0.72e0 OR t >= 120))),
lr AS (
  SELECT script_id, CAST(-1 AS BIGINT) AS idx, CAST(NULL AS DOUBLE) AS last, prev, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS made FROM pn
  UNION ALL
  SELECT script_id, idx, CASE WHEN ok THEN s ELSE last END, CASE WHEN ok THEN x ELSE prev END, n + CAST(ok AS INTEGER), CASE WHEN ok THEN x END
  FROM (SELECT l.script_id, l.idx, l.s, r.last, r.prev, r.n,
               l.words >= p.least_words AND r.n < p.room AND (r.last IS NULL OR l.s - r.last >= p.gap)
                 AND NOT EXISTS (SELECT 1 FROM gv g WHERE g.script_id = l.script_id AND g.emotion <> 'neutral' AND round(g.s, 1) = round(l.s, 1)) AS ok,
               CASE WHEN l.lab <> r.prev THEN l.lab ELSE CASE l.lab WHEN 'serious' THEN 'confident' WHEN 'confident' THEN 'serious' WHEN 'surprised' THEN 'intense' WHEN 'worried' THEN 'serious'
                    WHEN 'excited' THEN 'confident' ELSE 'serious' END END AS x
        FROM lr r JOIN ln l ON l.script_id = r.script_id AND l.idx = r.idx + 1 JOIN pn p ON p.script_id = l.script_id))"""


@register("w29_enrich_cues", "script_id:i cue_no:i idx:i start_s:d text:s expression:s character:s source:s", """
SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY start_s, added, idx) - 1 AS cue_no, idx, start_s, text, expression, character, source
FROM (SELECT script_id, idx, s AS start_s, t AS text, emotion AS expression, character, 'given' AS source, 0 AS added FROM gv
      UNION ALL SELECT script_id, idx, s, t, made, 'narrator', 'heuristic_enrichment', 1 FROM lr JOIN ln USING (script_id, idx) WHERE made IS NOT NULL)""", ENRICH_SQL)
def w29(spark, sf):
    """Half of the scripts are short, the others long."""
    b = beats(spark, sf)
    scale = F.when(F.col("script_id") % 2 == 0, 25000).otherwise(2000)
    ending = F.get(F.array(*[F.lit(x) for x in (" of the truth", " why so", " so sad", " dream")]), (F.col("asset_id").cast("long") % 4).cast("int"))
    lines = b.withColumns({"start_s": F.col("start_s") / scale, "end_s": F.col("end_s") / scale, "text": F.concat("subtitle_text", ending), "expression": F.col("emotion")})
    given = lines.filter("beat_type = 'reveal' AND intensity > 0.3 AND (script_id % 3 > 0 OR idx % 20 = 0)")
    return planners.enrich_cues(lines, given, expression_label(F.col("text"), F.col("idx"), False))


SOUND_EVENTS = ["crossfade", "zoom_dissolve", "whip_pan_right", "iris_wipe", "none", "fade", "whip_pan_odd", "unheard"]
SOUND_SQL = BEATS_SQL + """,
hv AS (SELECT list(DISTINCT ['whoosh-wind', 'swoosh-sound-effects', 'reverse_whoosh', 'impact_hit', 'sub_boom', 'fast-whoosh', 'riser'][CAST(idx % 7 AS INTEGER) + 1]) AS have FROM beats),
sn AS (SELECT * FROM (VALUES
  (0, 'crossfade', ['swoosh-sound-effects', 'whoosh-wind', 'soft_whoosh', 'reverse_whoosh', 'slide']), (1, 'zoom_dissolve', ['impact_hit', 'sub_boom', 'riser', 'reverse_whoosh']),
  (2, 'whip_pan_right', ['fast-whoosh']), (3, 'iris_wipe', ['riser']), (4, 'none', CAST([] AS VARCHAR[])),
  (5, 'fade', ['swoosh-sound-effects', 'whoosh-wind', 'soft_whoosh', 'reverse_whoosh', 'slide']), (6, 'whip_pan_odd', ['fast-whoosh']), (7, 'unheard', ['whoosh-wind'])) v(k, tr, names)),
ev AS (SELECT script_id, idx, start_s / 3600 AS hr, tr, names, have, list_concat(list_slice(names, idx % greatest(1, len(names)) + 1, len(names)), list_slice(names, 1, idx % greatest(1, len(names)))) AS ring
       FROM beats JOIN sn ON k = CAST(asset_id AS BIGINT) % 8, hv),
cue AS (
  SELECT DISTINCT script_id, CAST(-1 AS BIGINT) AS idx, CAST(NULL AS DOUBLE) AS hr, '' AS tr, CAST(NULL AS VARCHAR) AS stem, '' AS before, CAST(NULL AS DOUBLE) AS cue_at, CAST(NULL AS DOUBLE) AS hit_at FROM beats
  UNION ALL
  SELECT script_id, idx, hr, tr, stem, coalesce(stem, before), CASE WHEN stem IS NULL THEN cue_at ELSE hr END, CASE WHEN stem = 'impact_hit' THEN hr ELSE hit_at END
  FROM (SELECT e.script_id, e.idx, e.hr, e.tr, c.before, c.cue_at, c.hit_at,
          CASE WHEN c.cue_at IS NOT NULL AND e.hr - c.cue_at < 4.75e0 THEN NULL
               WHEN list_contains(e.names, 'impact_hit') AND list_contains(e.have, 'impact_hit') AND (c.hit_at IS NULL OR e.hr - c.hit_at >= 14.0e0) AND c.before <> 'impact_hit' THEN 'impact_hit'
               ELSE coalesce(list_filter(e.ring, lambda x: list_contains(e.have, x) AND NOT (x = c.before AND len(e.names) > 1)
                                                   AND (x <> 'impact_hit' OR c.hit_at IS NULL OR e.hr - c.hit_at >= 14.0e0))[1],
                             list_filter(e.names, lambda x: list_contains(e.have, x))[1]) END AS stem
        FROM cue c JOIN ev e ON e.script_id = c.script_id AND e.idx = c.idx + 1))"""


@register("w30_plan_sounds", "script_id:i idx:i time_s:d transition:s stem:s", "SELECT script_id, idx, hr AS time_s, tr AS transition, stem FROM cue WHERE stem IS NOT NULL", SOUND_SQL)
def w30(spark, sf):
    b = beats(spark, sf)
    pick = lambda names, c: F.get(F.array(*[F.lit(x) for x in names]), (c % len(names)).cast("int"))
    stems = b.select(pick(["whoosh-wind", "swoosh-sound-effects", "reverse_whoosh", "impact_hit", "sub_boom", "fast-whoosh", "riser"], F.col("idx")).alias("stem"))
    return planners.plan_sounds(b.withColumns({"time_s": F.col("start_s") / 3600, "transition": pick(SOUND_EVENTS, F.col("asset_id").cast("long"))}), stems)


CHUNK_CTES = BEATS_SQL + """,
ln AS (SELECT script_id, idx, start_s / 20000 AS s, end_s / 20000 AS e, subtitle_text || CASE WHEN CAST(asset_id AS BIGINT) % 4 = 0 THEN '.' ELSE ' then' END AS t FROM beats),
st AS (
  SELECT script_id, idx, idx AS first, s AS since, t AS said,
         NOT ((e - s >= 1.6e0 AND suffix(t, '.')) OR (e - s >= 5.5e0 * 0.8e0 AND regexp_matches(t, 'then'))) AS open FROM ln WHERE idx = 0
  UNION ALL
  SELECT script_id, idx, first, since, said, over OR NOT ((e - since >= 1.6e0 AND suffix(t, '.')) OR (e - since >= 5.5e0 * 0.8e0 AND regexp_matches(said, 'then')))
  FROM (SELECT l.script_id, l.idx, l.e, l.t, p.open AND l.e - p.since > 5.5e0 AS over,
               CASE WHEN p.open AND NOT (l.e - p.since > 5.5e0) THEN p.first ELSE l.idx END AS first, CASE WHEN p.open AND NOT (l.e - p.since > 5.5e0) THEN p.since ELSE l.s END AS since,
               CASE WHEN p.open AND NOT (l.e - p.since > 5.5e0) THEN p.said || ' ' || l.t ELSE l.t END AS said
        FROM st p JOIN ln l ON l.script_id = p.script_id AND l.idx = p.idx + 1)),
ck AS (SELECT st.script_id, first, min(s) AS s, arg_max(e, idx) AS e, count(*) AS n, row_number() OVER (PARTITION BY st.script_id ORDER BY first) - 1 AS c,
              count(*) OVER (PARTITION BY st.script_id) AS total FROM st JOIN ln USING (script_id, idx) GROUP BY st.script_id, first),
cm AS (SELECT *, CASE WHEN c = total - 1 AND c > 0 AND e - s < 1.6e0 THEN c - 1 ELSE c END AS chunk FROM ck)"""


@register("w33_chunk_lines", "script_id:i chunk:i start_s:d end_s:d text:s line_count:i", """
SELECT cm.script_id, chunk, min(ln.s) AS start_s, arg_max(ln.e, ln.idx) AS end_s, string_agg(ln.t, ' ' ORDER BY ln.idx) AS text, count(*) AS line_count
FROM cm JOIN st USING (script_id, first) JOIN ln ON ln.script_id = st.script_id AND ln.idx = st.idx GROUP BY cm.script_id, chunk""", CHUNK_CTES)
def w33(spark, sf):
    b = beats(spark, sf)
    text = F.concat("subtitle_text", F.when(F.col("asset_id").cast("long") % 4 == 0, ".").otherwise(" then"))
    return planners.chunk_lines(b.select("script_id", "idx", (F.col("start_s") / 20000).alias("start_s"), (F.col("end_s") / 20000).alias("end_s"), text.alias("text")))


@register("w34_group_words", "script_id:i idx:i start_s:d end_s:d text:s word_count:i", """
SELECT g.script_id, first AS idx, min(b.start_s) AS start_s, arg_max(b.end_s, b.idx) AS end_s, string_agg(b.beat_type, ' ' ORDER BY b.idx) AS text, count(*) AS word_count
FROM g JOIN beats b USING (script_id, idx) GROUP BY g.script_id, first""", BEATS_SQL + """,
wd AS (SELECT script_id, idx, end_s, min(CASE WHEN beat_type = 'reveal' THEN start_s END) OVER (PARTITION BY script_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM beats),
g AS (SELECT script_id, idx, idx AS first, 1 AS n, ahead AS stop, NOT coalesce(end_s > ahead, false) AS open FROM wd WHERE idx = 0
      UNION ALL
      SELECT script_id, idx, CASE WHEN more THEN pf ELSE idx END, CASE WHEN more THEN pn + 1 ELSE 1 END, CASE WHEN more THEN ps ELSE ahead END, more OR NOT coalesce(end_s > ahead, false)
      FROM (SELECT w.*, p.first AS pf, p.n AS pn, p.stop AS ps, p.open AND p.n < 5 AND NOT coalesce(w.end_s > p.stop, false) AS more
            FROM g p JOIN wd w ON w.script_id = p.script_id AND w.idx = p.idx + 1))""")
def w34(spark, sf):
    b = beats(spark, sf)
    gaps = b.filter("beat_type = 'reveal'").select("script_id", "start_s")
    return planners.group_words(b.withColumn("word", F.col("beat_type")), gaps)


_LADDER = ("list_filter([over_, prim, fall, 'subject_push', 'slow_pan', 'stable_pan', 'hold_still'], lambda x: x IS NOT NULL AND x <> shown AND NOT (x = l1 AND x = l2) "
           "AND NOT (x = 'reveal_zoom' AND rv >= cap))[1]")
MOTION_CTES = BEATS_SQL + f""",
mc AS (SELECT script_id, idx, intensity, visual_role, CASE beat_type WHEN 'hook' THEN 'dramatic_push' WHEN 'reveal' THEN 'reveal_zoom' END AS over_,
              CASE emotion WHEN 'fear' THEN 'dramatic_push' WHEN 'calm' THEN 'slow_pan' WHEN 'rage' THEN 'impact_shake' WHEN 'grief' THEN 'grief_hold' ELSE 'subject_push' END AS prim,
              CASE emotion WHEN 'fear' THEN 'tension_drift' WHEN 'calm' THEN 'evidence_hold' WHEN 'rage' THEN 'dramatic_push' ELSE 'slow_pan' END AS fall,
              greatest(2, CAST(floor(count(*) OVER (PARTITION BY script_id) * 0.30e0) AS BIGINT)) AS cap FROM beats),
mo AS (
  SELECT script_id, idx, coalesce(over_, prim) AS chosen, '' AS before, CAST(coalesce(over_, prim) = 'reveal_zoom' AS INTEGER) AS reveals FROM mc WHERE idx = 0
  UNION ALL
  SELECT script_id, idx, chosen, l1, rv + CAST(chosen = 'reveal_zoom' AS INTEGER)
  FROM (SELECT script_id, idx, l1, rv, coalesce({_LADDER}, 'slow_push') AS chosen
        FROM (SELECT m.script_id, m.idx, m.over_, m.prim, m.fall, m.cap, p.chosen AS l1, p.before AS l2, p.reveals AS rv,
                     CASE WHEN p.chosen IN ('stable_pan', 'hold_still', 'slow_push') THEN 'subject_push' ELSE p.chosen END AS shown
              FROM mo p JOIN mc m ON m.script_id = p.script_id AND m.idx = p.idx + 1))),
ms AS (SELECT script_id, idx, CASE WHEN chosen IN ('stable_pan', 'hold_still', 'slow_push') THEN 'subject_push' ELSE chosen END AS style FROM mo)"""


@register("w41_plan_motion", "script_id:i idx:i style:s", "SELECT * FROM ms", MOTION_CTES)
def w41_styles(spark, sf):
    return planners.plan_motion(beats(spark, sf))


@register("w41_motion_details", "script_id:i idx:i style:s motion_intensity:d camera_goal:s transition:s easing:s duration_modifier:d reasoning:s", """
SELECT script_id, idx, style, round(greatest(0.0, least(1.0, intensity * 0.6e0 + v.base * 0.4e0)), 4) AS motion_intensity,
       CASE WHEN style IN ('dramatic_push', 'reveal_zoom', 'climax_zoom', 'impact_shake') THEN v.goal ELSE CASE visual_role WHEN 'character' THEN 'face_lock_push' WHEN 'evidence' THEN 'inspect_detail'
            WHEN 'location' THEN 'wide_context_pan' WHEN 'symbol' THEN 'centered_icon_hold' ELSE v.goal END END AS camera_goal, v.transition, v.easing, v.length AS duration_modifier,
       CASE WHEN chosen = over_ THEN 'beat override' WHEN chosen = prim THEN 'emotion' WHEN chosen = fall THEN 'emotion fallback'
            WHEN chosen IN ('subject_push', 'slow_pan', 'stable_pan', 'hold_still') THEN 'default' ELSE 'exhausted' END AS reasoning
FROM ms JOIN mc USING (script_id, idx) JOIN mo USING (script_id, idx) JOIN (VALUES
  ('dramatic_push', 'urgent_face_lock', 0.85e0, 'ease_out_expo', 0.8e0, 'zoom_dissolve'), ('reveal_zoom', 'slow_reveal_to_subject', 0.88e0, 'ease_in_out_cubic', 1.1e0, 'zoom_dissolve'),
  ('slow_pan', 'inspect_evidence', 0.45e0, 'ease_in_out_quad', 1.3e0, 'crossfade'), ('subject_push', 'face_lock_push', 0.65e0, 'ease_out_quad', 1.0e0, 'crossfade'),
  ('tension_drift', 'uneasy_slow_drift', 0.70e0, 'ease_in_sine', 1.2e0, 'crossfade'), ('impact_shake', 'impact_reaction', 0.92e0, 'ease_out_bounce', 0.6e0, 'hard_cut'),
  ('grief_hold', 'still_contemplation', 0.35e0, 'ease_in_out_quad', 1.5e0, 'fade_eased'), ('evidence_hold', 'inspect_detail', 0.40e0, 'ease_in_out_quad', 1.2e0, 'crossfade'))
  v(name, goal, base, easing, length, transition) ON v.name = ms.style""", MOTION_CTES)
def w41(spark, sf):
    return planners.plan_motion(beats(spark, sf))


DRAW = "CAST(('0x' || substr(sha1(script_id || ':' || idx || ':{}'), 1, 8)) AS BIGINT) / 4294967296.0e0"
TRANSITION_SQL = BEATS_SQL + f""",
sm AS (SELECT * FROM (VALUES
  ('reveal', 0, 'zoom_dissolve', 50), ('reveal', 1, 'iris_wipe', 50), ('reveal', 2, 'radial_wipe', 40),
  ('twist', 0, 'glitch_cut', 60), ('twist', 1, 'zoom_dissolve', 40), ('twist', 2, 'whip_pan_right', 30),
  ('escalation', 0, 'whip_pan_left', 50), ('escalation', 1, 'whip_pan_right', 50), ('escalation', 2, 'motion_slide_left', 40), ('escalation', 3, 'motion_slide_right', 40), ('escalation', 4, 'cube_rotation', 30),
  ('other', 0, 'crossfade', 40), ('other', 1, 'fade_eased', 40), ('other', 2, 'motion_slide_right', 20)) v(g, place, name, points)),
bn AS (SELECT * FROM (VALUES (10, 'fade_eased', 20), (11, 'crossfade', 20), (12, 'zoom_dissolve', 20), (13, 'motion_slide_left', 10), (14, 'motion_slide_right', 10)) v(place, name, points)),
cd AS (SELECT g, list({{'name': name, 'v': v, 'p': p}} ORDER BY p) AS c FROM (
         SELECT g, name, sum(points) AS v, min(place) AS p FROM (SELECT * FROM sm UNION ALL SELECT g, place, name, points FROM bn, (SELECT DISTINCT g FROM sm)) GROUP BY g, name) GROUP BY g),
ev AS (SELECT script_id, idx, intensity, beat_type, emotion, c, {DRAW.format('0')} AS draw FROM beats JOIN cd ON g = CASE WHEN beat_type = 'reveal' THEN 'reveal' WHEN emotion = 'fear' THEN 'twist'
         WHEN beat_type = 'escalation' OR emotion = 'rage' THEN 'escalation' ELSE 'other' END),
tr AS (
  SELECT DISTINCT script_id, CAST(-1 AS BIGINT) AS idx, '' AS name, '' AS prev, CAST([] AS VARCHAR[]) AS hist FROM beats
  UNION ALL
  SELECT script_id, idx, near[1 + least(len(near) - 1, CAST(floor(draw * len(near)) AS BIGINT))].n, name, list_append(hist, near[1 + least(len(near) - 1, CAST(floor(draw * len(near)) AS BIGINT))].n)
  FROM (SELECT *, list_filter(r, lambda x: x.s <= r[1].s + 15) AS near
        FROM (SELECT e.script_id, e.idx, e.draw, t.name, t.hist,
                     list_sort(list_transform(list_filter(e.c, lambda x: NOT (x.name = t.name AND x.name = t.prev)), lambda x:
                       {{'s': -(x.v + greatest(0, 30 - least(5 * len(list_filter(t.hist, lambda h: h = x.name)), 20) - CASE WHEN x.name = t.name THEN 15 ELSE 0 END)), 'p': x.p, 'n': x.name}})) AS r
              FROM tr t JOIN ev e ON e.script_id = t.script_id AND e.idx = t.idx + 1)))"""


@register("w42_plan_transitions", "script_id:i idx:i transition_type:s duration:d intensity:d reason:s", """
SELECT script_id, idx, name AS transition_type, 'Semantic match for ' || upper(beat_type) || '/' || emotion || '/standard under clean_pro style' AS reason, round(least(2.0, greatest(0.2, (1.0e0 - intensity * 100 / 200.0e0) * 1.2e0)), 2) AS duration,
       round(least(1.0, greatest(0.1, (0.5e0 + intensity * 100 / 200.0e0) * 0.7e0)), 2) AS intensity FROM tr JOIN ev USING (script_id, idx)""", TRANSITION_SQL)
def w42(spark, sf):
    return planners.plan_transitions(beats(spark, sf).withColumn("emotion_score", F.col("intensity") * 100))


CHOICE_SQL = BEATS_SQL + f""",
mv AS (SELECT script_id, idx, end_s / 20000 - start_s / 20000 AS d, {DRAW.format('0cut')} AS dc, {DRAW.format('0move')} AS dm,
         CASE WHEN end_s / 20000 - start_s / 20000 < 1.4 THEN [{{'n': 'static_hold', 'w': 0.55e0}}, {{'n': 'hold_still', 'w': 0.25e0}}, {{'n': 'slow_push', 'w': 0.20e0}}]
              WHEN beat_type IN ('hook', 'reveal') THEN [{{'n': 'impact_zoom', 'w': 0.28e0}}, {{'n': 'slow_push', 'w': 0.24e0}}, {{'n': 'static_hold', 'w': 0.18e0}}, {{'n': 'diagonal_pan', 'w': 0.16e0}}, {{'n': 'pull_out', 'w': 0.14e0}}]
              ELSE [{{'n': 'slow_push', 'w': 0.26e0}}, {{'n': 'static_hold', 'w': 0.22e0}}, {{'n': 'stable_pan', 'w': 0.18e0}}, {{'n': 'diagonal_pan', 'w': 0.14e0}}, {{'n': 'hold_still', 'w': 0.12e0}}, {{'n': 'pull_out', 'w': 0.08e0}}] END AS moves
       FROM beats),
ct AS (SELECT *, CASE WHEN d < 2 THEN [{{'n': 'fade_eased', 'w': 0.38e0}}, {{'n': 'crossfade', 'w': 0.32e0}}, {{'n': 'fade', 'w': 0.18e0}}, {{'n': 'iris_wipe', 'w': 0.12e0}}]
              WHEN d < 4 THEN [{{'n': 'crossfade', 'w': 0.34e0}}, {{'n': 'fade_eased', 'w': 0.28e0}}, {{'n': 'zoom_dissolve', 'w': 0.18e0}}, {{'n': 'iris_wipe', 'w': 0.12e0}}, {{'n': 'radial_wipe', 'w': 0.08e0}}]
              ELSE [{{'n': 'crossfade', 'w': 0.30e0}}, {{'n': 'fade_eased', 'w': 0.24e0}}, {{'n': 'zoom_dissolve', 'w': 0.20e0}}, {{'n': 'iris_wipe', 'w': 0.14e0}}, {{'n': 'radial_wipe', 'w': 0.12e0}}] END AS cuts FROM mv),
ch AS (
  SELECT DISTINCT script_id, CAST(-1 AS BIGINT) AS idx, '' AS cut, '' AS move FROM beats
  UNION ALL
  SELECT script_id, idx, coalesce(list_filter(oc, lambda x, i: list_sum(list_transform(oc[1:i], lambda y: y.w)) >= dc * list_sum(list_transform(oc, lambda y: y.w)))[1], oc[len(oc)]).n,
         coalesce(list_filter(om, lambda x, i: list_sum(list_transform(om[1:i], lambda y: y.w)) >= dm * list_sum(list_transform(om, lambda y: y.w)))[1], om[len(om)]).n
  FROM (SELECT c.script_id, c.idx, c.dc, c.dm, list_filter(c.cuts, lambda x: x.n <> h.cut) AS oc, list_filter(c.moves, lambda x: x.n <> h.move) AS om
        FROM ch h JOIN ct c ON c.script_id = h.script_id AND c.idx = h.idx + 1))"""


@register("w43_choose_cuts_and_moves", "script_id:i idx:i transition_type:s motion:s", "SELECT script_id, idx, cut AS transition_type, move AS motion FROM ch WHERE idx >= 0", CHOICE_SQL)
def w43(spark, sf):
    return planners.choose_cuts_and_moves(beats(spark, sf).withColumns({"start_s": F.col("start_s") / 20000, "end_s": F.col("end_s") / 20000}))


# ---- allocation and sampling -----------------------------------------------------------------------------

@register("w36_proportional_times", "script_id:i idx:i line_start:d line_end:d", """
SELECT script_id, idx, a AS line_start, CASE WHEN idx = last THEN z ELSE least(a + d, z) END AS line_end
FROM (SELECT *, 10.0e0 + sum(d) OVER (PARTITION BY script_id ORDER BY idx) - d AS a
      FROM (SELECT script_id, idx, z, greatest(0.35e0, (z - 10.0e0) * w / greatest(1, sum(w) OVER (PARTITION BY script_id))) AS d, max(idx) OVER (PARTITION BY script_id) AS last
            FROM (SELECT script_id, idx, CAST(length(subtitle_text) AS BIGINT) AS w, 10.0e0 + 20.0e0 + script_id % 7 AS z FROM beats)))
WHERE a < z - 0.000001""", BEATS_SQL)
def w36(spark, sf):
    b = beats(spark, sf).select("script_id", "idx", F.length("subtitle_text").alias("words"), F.lit(10.0).alias("start_s"),
                                (F.lit(30.0) + F.col("script_id") % 7).alias("end_s"))
    return sequence.proportional_times(b).filter(F.col("line_start") < F.col("end_s") - 0.000001)


ORDER_SHARES = """
sv AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, l_extendedprice / 997 AS v FROM lineitem),
st AS (SELECT *, CAST(floor(sum(v) OVER (PARTITION BY k)) AS BIGINT) + k % 5 - 2 AS total FROM sv),
sr AS (SELECT *, floor(v) AS b, v - floor(v) AS r, CAST(sum(floor(v)) OVER (PARTITION BY k) AS BIGINT) AS s FROM st)"""


@register("w37_largest_remainder", "k:i i:i frames:i", """
SELECT k, i, b + CASE WHEN dn <= total - s THEN 1 WHEN up <= s - total AND b > 0 THEN -1 ELSE 0 END AS frames
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r DESC, i) AS dn, row_number() OVER (PARTITION BY k ORDER BY r, i) AS up FROM sr)""", ORDER_SHARES)
def w37(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = number_rows(rows, "k", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], out="i")
    rows = rows.select("k", "i", (F.col("l_extendedprice") / 997).alias("v"))
    total = rows.groupBy("k").agg((F.floor(F.sum("v")) + F.col("k") % 5 - 2).alias("total"))
    return sequence.largest_remainder(rows.join(total, "k"), "v", "total", "k", "i")


@register("w38_even_sample", "script_id:i idx:i slot:i slots:i start_s:d end_s:d", """
SELECT script_id, idx, slot, slots, 90.0e0 * slot / slots AS start_s, 90.0e0 * (slot + 1) / slots AS end_s
FROM (SELECT b.script_id, b.idx, b.idx AS slot, n AS slots FROM beats b JOIN sz USING (script_id) WHERE n <= 66
      UNION ALL
      SELECT b.script_id, b.idx, j AS slot, 66 FROM sz JOIN (SELECT unnest(range(66)) AS j) ON true JOIN beats b ON b.script_id = sz.script_id AND b.idx = j * (n - 1) // 65 WHERE n > 66)""",
          BEATS_SQL + ", sz AS (SELECT script_id, count(*) AS n FROM beats GROUP BY script_id)")
def w38(spark, sf):
    # 90 seconds of audio at 1.35 s per picture: at most 66 pictures
    out = sequence.even_sample(beats(spark, sf).select("script_id", "idx"), F.floor(F.lit(90.0) / 1.35))
    step = F.lit(90.0) / F.col("slots")
    return out.withColumns({"start_s": step * F.col("slot"), "end_s": step * (F.col("slot") + 1)})
