"""Queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyspark.functions import rules, text
from storyspark.operators import graph, search
from storyspark.operators.ordered import number_rows
from storyspark.plans.views import BEATS_SQL, beats, spread, table
from storyspark.queries.registry import register
from storyspark.sources import web

# word boundaries differ between engines next to accented letters, so compared texts are ASCII
DOCS_SQL = "docs AS (SELECT doc_id, source, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM documents)"
TALK_SQL = "talk AS (SELECT conv_id, turn, role, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM conversations)"
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
TOKENS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({SQUEEZE}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def docs(spark, sf):
    rows = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return rows.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))


def talk(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))


def segments(spark, sf):
    """Sentences of each document with their place and number."""
    s = docs(spark, sf).select("doc_id", text.sentences(F.col("text")).alias("s"))
    # an inner explode would get a filter inferred that splits again
    return s.select("doc_id", F.size("s").alias("total"), F.posexplode_outer("s").alias("idx", "text")).filter("idx IS NOT NULL")


SEGMENTS_SQL = DOCS_SQL + f""",
sl AS (SELECT doc_id, {SENTENCES.format('text')} AS s FROM docs),
segs AS (SELECT doc_id, len(s) AS total, generate_subscripts(s, 1) - 1 AS idx, unnest(s) AS text FROM sl)"""

def C():
    return F.col("text")


@register("f2_clean_text", "doc_id:i cleaned:s", """
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[^\\w\\s.,!?-]', '', 'g'),
       '\\.{2,}', '...', 'g'), '!{2,}', '!', 'g'), '\\?{2,}', '?', 'g')) AS cleaned FROM docs""", DOCS_SQL)
def f2(spark, sf):
    return docs(spark, sf).withColumn("cleaned", text.clean_text(C(), False))


NAMES = ["Then", "Wh", "Ist", "The "]


@register("f3_first_name_in", "doc_id:i name:s", """
SELECT doc_id, CASE WHEN contains(lower(text), 'then') THEN 'Then' WHEN contains(lower(text), 'wh') THEN 'Wh' WHEN contains(lower(text), 'ist') THEN 'Ist'
       WHEN contains(lower(text), 'the ') THEN 'The ' ELSE 'unknown' END AS name FROM docs""", DOCS_SQL)
def f3(spark, sf):
    return docs(spark, sf).withColumn("name", text.first_name_in(C(), NAMES))


@register("f4_speech_type", "conv_id:i turn:i kind:s", f"""
SELECT conv_id, turn, CASE WHEN starts_with(text, '...') OR suffix(text, '...') THEN 'thought' WHEN len({TOKENS.format('text')}) > 20 THEN 'narration' ELSE 'dialogue' END AS kind FROM talk""", TALK_SQL)
def f4(spark, sf):
    return talk(spark, sf).withColumn("kind", text.speech_type(C()))


@register("f5_dialogue_line", "conv_id:i turn:i line:s", "SELECT conv_id, turn, role || ': ' || text AS line FROM talk", TALK_SQL)
def f5(spark, sf):
    return talk(spark, sf).withColumn("line", text.dialogue_line(F.col("role"), C()))


QUALITY_CTES = DOCS_SQL + """,
cl AS (SELECT doc_id, source, trim(regexp_replace(array_to_string(list_filter(list_transform(
         regexp_split_to_array(regexp_replace(text, '\\.\\s{2,}', '.' || chr(1), 'g'), '[\\r\\n\\x01]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))),
         lambda x: x <> '' AND NOT regexp_matches(x, '(?i)\\bread on\\b|\\btwitter\\b|\\bscanlation\\b|\\bwhhe')), ' '), '\\s+', ' ', 'g')) AS c FROM docs),
wd AS (SELECT doc_id, source, c, length(c) AS n, regexp_extract_all(c, '[A-Za-z][A-Za-z''-]+') AS w FROM cl),
tk AS (SELECT doc_id, max(k) AS top, sum(k) AS cnt FROM (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, regexp_replace(lower(unnest(w)), '^''+|''+$', '', 'g') AS x FROM wd) WHERE x <> '' GROUP BY ALL) GROUP BY doc_id),
qf AS (SELECT wd.doc_id, source, c, n, len(w) AS many, length(regexp_replace(c, '[^A-Za-z]', '', 'g')) / CAST(greatest(1, n) AS DOUBLE) AS a,
              length(regexp_replace(c, '[A-Za-z0-9\\s.,!?;:''"\\-()\\[\\]{}&/% ]', '', 'g')) / CAST(greatest(1, n) AS DOUBLE) AS g,
              coalesce(tk.top / CAST(tk.cnt AS DOUBLE), 0.0) AS r, length(array_to_string(w, '')) / CAST(greatest(1, len(w)) AS DOUBLE) AS avl
       FROM wd LEFT JOIN tk USING (doc_id)),
qs AS (SELECT *, least(a / 0.72e0, 1.0) * 0.25e0 + greatest(0.0, 1.0 - g / 0.18e0) * 0.20e0 + least(many / 45.0e0, 1.0) * 0.20e0 + greatest(0.0, 1.0 - r / 0.35e0) * 0.15e0
              + greatest(0.0, least(avl / 4.0e0, 1.0)) * 0.08e0 + 0.5e0 * 0.12e0 AS s FROM qf),
ql AS (SELECT *, s >= 0.45 AND many >= 8 AND g < 0.22 AS usable, round(s, 3) AS quality_score FROM qs)"""
CREDITS = [r"\bread on\b", r"\btwitter\b", r"\bscanlation\b", r"\bwhhe"]


def quality(spark, sf):
    return text.with_text_quality(docs(spark, sf), patterns=CREDITS, unicode=False)


@register("f6_text_quality", "doc_id:i quality_score:d quality_level:s usable:b word_count:i char_count:i alpha_ratio:d garbage_ratio:d repeated_ratio:d", """
SELECT doc_id, quality_score, CASE WHEN usable AND s >= 0.72 THEN 'good' WHEN usable THEN 'fair' ELSE 'poor' END AS quality_level, usable, many AS word_count, n AS char_count,
       round(a, 3) AS alpha_ratio, round(g, 3) AS garbage_ratio, round(r, 3) AS repeated_ratio FROM ql""", QUALITY_CTES)
def f6(spark, sf):
    return quality(spark, sf)


@register("f8_strip_credit_lines", "doc_id:i clean_text:s", "SELECT doc_id, c AS clean_text FROM cl", QUALITY_CTES)
def f8(spark, sf):
    return docs(spark, sf).withColumn("clean_text", text.strip_credit_lines(C(), CREDITS))


ROLLUP_SQL = """
SELECT source, count(*) AS total_pages, count(*) FILTER (usable) AS usable_pages, round(sum(CAST(round(quality_score * 1000) AS BIGINT)) / CAST(count(*) AS DOUBLE) / 1000, 3) AS score,
       greatest(0, coalesce(sum(length('Page ' || doc_id || ': ') + n + 1) FILTER (usable AND n > 0), 0) - 1) AS context_chars,
       CASE WHEN avg(quality_score) >= 0.72 THEN 'good' WHEN avg(quality_score) >= 0.45 THEN 'fair' ELSE 'poor' END AS level,
       greatest(0, coalesce(sum(length('Page ' || doc_id || ': ') + n + 1) FILTER (usable AND n > 0), 0) - 1) >= 350 AND count(*) FILTER (usable) >= greatest(2, count(*) // 5) AS usable
FROM ql GROUP BY source"""


@register("a10_quality_rollup", "source:s total_pages:i usable_pages:i score:d context_chars:i level:s usable:b", ROLLUP_SQL, QUALITY_CTES)
def a10(spark, sf):
    return text.quality_rollup(quality(spark, sf), "source", "doc_id")


@register("t2_best_candidate", "source:s doc_id:i quality_score:d best_text:s", """
SELECT source, doc_id, quality_score, CASE WHEN usable THEN c ELSE '' END AS best_text FROM ql
QUALIFY row_number() OVER (PARTITION BY source ORDER BY quality_score DESC, doc_id) = 1""", QUALITY_CTES)
def t2(spark, sf):
    q = quality(spark, sf)
    best = q.groupBy("source").agg(F.max_by(F.struct("doc_id", "quality_score", "usable", "clean_text"), F.struct("quality_score", -F.col("doc_id"))).alias("b"))
    return best.select("source", "b.doc_id", "b.quality_score", F.when(F.col("b.usable"), F.col("b.clean_text")).otherwise("").alias("best_text"))


@register("p12_usable_context", "doc_id:i context:s", "SELECT doc_id, CASE WHEN usable AND length(trim(c)) > 0 THEN c END AS context FROM ql", QUALITY_CTES)
def p12(spark, sf):
    return quality(spark, sf).withColumn("context", text.usable_context(F.col("usable"), F.col("clean_text")))


@register("f7_garbled_share", "doc_id:i ocr_quality:d", f"""
SELECT doc_id, CASE WHEN len(w) = 0 THEN 1.0 ELSE 1.0 - len(list_filter(w, lambda x: length(x) > 20 OR regexp_matches(x, '[^\\x00-\\x7F]{{3,}}')
       OR regexp_matches(x, '[A-Za-z]{{12,}}\\d|\\d[A-Za-z]{{12,}}'))) / CAST(len(w) AS DOUBLE) END AS ocr_quality
FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)""")
def f7(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).withColumn("ocr_quality", text.garbled_share(C()))


@register("f9_chapter_number", "doc_id:i number:i", """
SELECT doc_id, CAST(coalesce(nullif(regexp_extract(text, '(?i)chapters?\\s*[-_:]?\\s*(\\d{3,5})', 1), ''), nullif(regexp_extract(text, '(?i)\\bch(?:apter)?\\.?\\s*(\\d{3,5})\\b', 1), ''),
       nullif(regexp_extract(text, '\\b(\\d{3,5})\\b', 1), '')) AS INTEGER) AS number FROM docs""", DOCS_SQL)
def f9(spark, sf):
    return docs(spark, sf).withColumn("number", text.chapter_number(C()))


@register("f12_counts", "doc_id:i words:i first_sentence:s opening:s", f"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_''-]+')) AS words, trim(list_extract(string_split(regexp_replace({SQUEEZE.format('text')}, '([.!?])\\s+', '\\1' || chr(1)), chr(1)), 1)) AS first_sentence,
       array_to_string(({TOKENS.format('text')})[1:35], ' ') AS opening FROM docs""", DOCS_SQL)
def f12(spark, sf):
    return docs(spark, sf).withColumns({"words": text.word_count(C(), False), "first_sentence": text.first_sentence(C()), "opening": text.opening_text(C())})


@register("f13_keywords", "doc_id:i kept:i terms:s", f"""
SELECT doc_id, len(k) AS kept, array_to_string(list_sort(k), ',') AS terms
FROM (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z'']{{2,}}')), lambda x: NOT list_contains([{','.join("'" + w + "'" for w in text.STOPWORDS)}], x)) AS k FROM docs)""", DOCS_SQL)
def f13(spark, sf):
    return docs(spark, sf).withColumn("k", text.keywords(C())).select("doc_id", F.size("k").alias("kept"), F.array_join(F.array_sort("k"), ",").alias("terms"))


ENTITY_TERMS = ["the", "then", "whst", "in the", "nd"]


@register("f14_named_entities", "doc_id:i entities:i", """
SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\b(the|then|whst|in the|nd)\\b'), lambda x: lower(x)))) AS entities FROM docs""", DOCS_SQL)
def f14(spark, sf):
    return docs(spark, sf).withColumn("entities", text.named_entity_count(C(), ENTITY_TERMS, False))


_CTA = "[" + ",".join(f"'{p}'" for p in text.CTA_PHRASES) + "]"
PAYOFF_SQL = f"""
pay AS (SELECT doc_id, len(list_filter(m[greatest(1, len(m) - 3):], lambda x: NOT suffix(x, '?') AND len(regexp_extract_all(x, '[A-Za-z0-9_''-]+')) >= 8)) > 0 AS payoff
        FROM (SELECT doc_id, list_filter(s, lambda x: len(list_filter({_CTA}, lambda p: contains(lower(x), p))) = 0) AS m FROM sl))"""


@register("f15_hook_and_payoff", "doc_id:i question_hook:b payoff:b", f"""
SELECT doc_id, regexp_matches(text, '(?i)^\\s*({'|'.join(text.QUESTION_STARTS)})\\b') AND suffix(trim(text), '?') AS question_hook, payoff FROM docs JOIN pay USING (doc_id)""",
          SEGMENTS_SQL + "," + PAYOFF_SQL)
def f15(spark, sf):
    return docs(spark, sf).withColumns({"question_hook": text.is_question_hook(C()), "payoff": text.has_declarative_payoff(C(), unicode=False)})


@register("f16_validate_script", "doc_id:i errors:s warnings:s", f"""
SELECT d.doc_id, array_to_string(list_filter([CASE WHEN n > 110 THEN 'too_long' END, CASE WHEN n < 75 THEN 'too_short' END, CASE WHEN suffix(hook, '?') THEN 'question_hook' END,
         CASE WHEN NOT regexp_matches(opening, '(?i)\\b(whst|ndble|chapter\\s+\\d+)\\b') THEN 'no_anchor' END, CASE WHEN e < 2 THEN 'few_entities' END, CASE WHEN NOT payoff THEN 'no_payoff' END], lambda x: x IS NOT NULL), ',') AS errors,
       array_to_string(list_filter([CASE WHEN e >= 2 AND e < 4 THEN 'thin_entities' END, CASE WHEN regexp_matches(text, '(?i)\\b(i think maybe|maybe|it feels like|i''m starting to think|what if)\\b') THEN 'hedging' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z0-9_''-]+')) AS n, trim(list_extract(string_split(regexp_replace({SQUEEZE.format('text')}, '([.!?])\\s+', '\\1' || chr(1)), chr(1)), 1)) AS hook,
             array_to_string(({TOKENS.format('text')})[1:35], ' ') AS opening, len(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\b(the|then|whst|in the|nd)\\b'), lambda x: lower(x)))) AS e FROM docs) d JOIN pay USING (doc_id)""",
          SEGMENTS_SQL + "," + PAYOFF_SQL)
def f16(spark, sf):
    d = docs(spark, sf).withColumns({"script": C(), "title": F.col("text"), "description": F.lit("x"), "hashtags": F.lit("#x")})
    out = text.validate_script(d, ["whst", "ndble"], ENTITY_TERMS, unicode=False)
    return out.withColumns({"errors": F.array_join("errors", ","), "warnings": F.array_join("warnings", ",")})


# ---- rule scoring ----------------------------------------------------------------------------------

DOC_BEAT_RULES = [
    ("setup", r"\b(the|der)\b", 0.28, "setup phrase"), ("mystery", r"\b(whst|nd|un)\b", 0.34, "mystery signal"),
    ("contradiction", r"\b(of|le)\b", 0.34, "contrast signal"), ("evidence", r"\b(and|la|und)\b", 0.34, "evidence signal"),
    ("escalation", r"\b(to|de|in)\b", 0.28, "escalation signal"), ("reveal", r"\b(is|est)\b", 0.36, "reveal signal"),
    ("payoff", r"\b(er|en)\b", 0.36, "payoff signal"), ("warning", r"\b(on|des)\b", 0.34, "warning signal"),
]
DOC_ESCALATION = ["to", "de", "in"]


def _beat_score_sql(label: str) -> str:
    pos = {
        "hook": "CASE WHEN total <= 1 THEN 0.18e0 ELSE 0.0 END + CASE WHEN total > 1 AND idx = 0 THEN 0.34e0 ELSE 0.0 END + CASE WHEN contains(text, '?') AND idx = 0 THEN 0.18e0 ELSE 0.0 END",
        "setup": "CASE WHEN p >= 0.05 AND p <= 0.35 THEN 0.18e0 ELSE 0.0 END", "evidence": "CASE WHEN p >= 0.20 AND p <= 0.70 THEN 0.12e0 ELSE 0.0 END",
        "escalation": "CASE WHEN p >= 0.35 AND p <= 0.78 THEN 0.10e0 ELSE 0.0 END + CASE WHEN len(regexp_extract_all(text, '(?i)\\b(to|de|in)\\b')) >= 2 THEN 0.14e0 ELSE 0.0 END",
        "reveal": "CASE WHEN p >= 0.55 AND p <= 0.88 THEN 0.13e0 ELSE 0.0 END", "payoff": "CASE WHEN total <= 1 THEN 0.12e0 ELSE 0.0 END + CASE WHEN p >= 0.70 THEN 0.15e0 ELSE 0.0 END",
        "warning": "CASE WHEN p >= 0.70 THEN 0.08e0 ELSE 0.0 END", "cta": "CASE WHEN total > 1 AND idx = total - 1 THEN 0.22e0 ELSE 0.0 END",
        "mystery": "CASE WHEN contains(text, '?') THEN 0.16e0 ELSE 0.0 END",
        "contradiction": "CASE WHEN regexp_matches(text, '(?i)\\bnot\\b.{0,45}\\bbut\\b|\\bbut\\b.{0,45}\\bactually\\b') THEN 0.22e0 ELSE 0.0 END",
    }[label]
    hits = "".join(f" + CASE WHEN regexp_matches(text, '(?i){pat}') THEN {w}e0 ELSE 0.0 END" for lab, pat, w, _ in DOC_BEAT_RULES if lab == label)
    return f"round(greatest(0.0, least(1.0, 0.04e0 + {pos}{hits})), 2)"


_PRIO = "CASE WHEN idx = 0 THEN {0} WHEN idx = total - 1 THEN {1} ELSE {2} END".format(
    *["[" + ",".join(f"'{x}'" for x in names) + "]" for names in (rules.OPENING_PRIORITY, rules.CLOSING_PRIORITY, rules.MIDDLE_PRIORITY)])
BEAT_CLASS_CTES = SEGMENTS_SQL + f""",
ps AS (SELECT *, CASE WHEN total > 1 THEN idx / CAST(greatest(1, total - 1) AS DOUBLE) END AS p, {_PRIO} AS prio FROM segs),
bl AS (SELECT doc_id, idx, list_sort([{', '.join(f"{{'s': -({_beat_score_sql(b)}), 'r': list_position(prio, '{b}'), 'b': '{b}'}}" for b in rules.BEAT_TYPES)}])[1] AS best FROM ps)"""


def classified(spark, sf):
    s = segments(spark, sf)
    return s.withColumns(rules.beat_columns(C(), F.col("idx"), F.col("total"), DOC_BEAT_RULES, DOC_ESCALATION, False))


@register("f18_classify_beats", "doc_id:i idx:i beat_type:s confidence:d", "SELECT doc_id, idx, best.b AS beat_type, -best.s AS confidence FROM bl", BEAT_CLASS_CTES)
def f18(spark, sf):
    return classified(spark, sf)


DOC_INTENT_RULES = [("DREAM", r"\b(signup)\b", 0.50, "d"), ("FEAR", r"\b(error)\b", 0.52, "f"), ("WARNING", r"\b(view)\b", 0.28, "w"), ("REVEAL", r"\b(purchase|click)\b", 0.31, "r")]
_INTENT_PRIO = {k: "[" + ",".join(f"'{x}'" for x in v) + "]" for k, v in rules.INTENT_PRIORITY.items()}


def _intent_sql(label: str) -> str:
    out = "0.03e0"
    for b, (lab, w, _) in rules.BEAT_PRIORS.items():
        if lab == label:
            out += f" + CASE WHEN beat_type = '{b}' THEN {w}e0 ELSE 0.0 END"
    for lab, pat, w, _ in DOC_INTENT_RULES:
        if lab == label:
            out += f" + CASE WHEN regexp_matches(blob, '{pat}') THEN {w}e0 ELSE 0.0 END"
    if label == "CHARACTER":
        out += " + 0.06e0"
    if label == "LOCATION":
        out += " + CASE WHEN regexp_matches(blob, '\\b(arc1)\\b') THEN 0.22e0 ELSE 0.0 END"
    if label == "SYMBOL":
        out += " + CASE WHEN regexp_matches(blob, '\\b(scene 3)\\b') THEN 0.20e0 ELSE 0.0 END"
    return f"round(greatest(0.0, least(1.0, {out})), 2)"


@register("f19_classify_intents", "script_id:i idx:i intent:s confidence:d", f"""
SELECT script_id, idx, best.b AS intent, -best.s AS confidence FROM (
  SELECT script_id, idx, list_sort([{', '.join(f"{{'s': -({_intent_sql(i)}), 'r': list_position(prio, '{i}'), 'b': '{i}'}}" for i in rules.INTENTS)}])[1] AS best
  FROM (SELECT *, subtitle_text || ' ' || arc AS blob, CASE WHEN beat_type = 'warning' THEN {_INTENT_PRIO['warning']} ELSE {_INTENT_PRIO['']} END AS prio FROM beats))""", BEATS_SQL)
def f19(spark, sf):
    b = beats(spark, sf)
    return b.withColumns(rules.intent_columns(F.col("beat_type"), F.col("subtitle_text"), F.array("arc"), DOC_INTENT_RULES, ["arc1"], ["scene 3"], False))


DOC_EMOTIONS = [(r"\b(the|le)\b", "grief", -0.55, 0.20), (r"\b(of|de)\b", "tension", -0.35, 0.15), (r"\b(nd|un)\b", "hope", 0.45, 0.20), (r"\b(whst|der)\b", "rage", -0.30, 0.22)]


@register("f20_detect_emotion", "doc_id:i idx:i label:s valence:d boost:d", """
SELECT doc_id, idx, b.l AS label, b.v AS valence, -b.b AS boost FROM (
  SELECT doc_id, idx, list_sort(list_filter([CASE WHEN regexp_matches(text, '(?i)\\b(the|le)\\b') THEN {'b': -0.20e0, 'r': 1, 'l': 'grief', 'v': -0.55e0} END,
    CASE WHEN regexp_matches(text, '(?i)\\b(of|de)\\b') THEN {'b': -0.15e0, 'r': 2, 'l': 'tension', 'v': -0.35e0} END,
    CASE WHEN regexp_matches(text, '(?i)\\b(nd|un)\\b') THEN {'b': -0.20e0, 'r': 3, 'l': 'hope', 'v': 0.45e0} END,
    CASE WHEN regexp_matches(text, '(?i)\\b(whst|der)\\b') THEN {'b': -0.22e0, 'r': 4, 'l': 'rage', 'v': -0.30e0} END,
    {'b': 0.0e0, 'r': 0, 'l': 'curious', 'v': 0.0e0}], lambda x: x IS NOT NULL))[1] AS b FROM segs)""", SEGMENTS_SQL)
def f20(spark, sf):
    return segments(spark, sf).withColumn("e", rules.detect_emotion(C(), DOC_EMOTIONS, False)).select("doc_id", "idx", "e.label", "e.valence", "e.boost")


def _first_sql(pairs, default="NULL") -> str:
    return "CASE " + " ".join("WHEN regexp_matches(text, '(?i){0}') THEN '{1}'".format(p.replace("'", "''"), v) for p, v in pairs) + f" ELSE {default} END"


@register("f21_first_match_classifiers", "doc_id:i idx:i emotion:s emotion_intensity:d beat:s role:s kind:s expression:s", f"""
SELECT doc_id, idx, emotion, CASE WHEN beat = 'hook' THEN greatest(x, 0.76e0) WHEN beat = 'reveal' THEN greatest(x, 0.82e0) ELSE x END AS emotion_intensity, beat, role,
       CASE WHEN role IN ('object', 'symbol', 'location', 'comparison', 'timeline') THEN role ELSE {_first_sql(rules.ASSET_TYPE_RULES, "'character'")} END AS kind, expression
FROM (SELECT *, CASE emotion WHEN 'grief' THEN 0.78e0 WHEN 'tension' THEN 0.72e0 WHEN 'intrigue' THEN 0.68e0 WHEN 'hope' THEN 0.55e0 WHEN 'resolution' THEN 0.28e0 ELSE 0.35e0 END AS x,
      CASE WHEN beat = 'hook' THEN 'section_card' WHEN beat = 'cta' THEN 'cta_card' ELSE coalesce({_first_sql(rules.ROLE_RULES)},
        CASE WHEN contains(text, '"') OR (contains(text, '''') AND length(text) < 140) THEN 'quote_card' END, CASE WHEN regexp_matches(text, '(?i){rules.PROOF}') THEN 'evidence' END, 'character') END AS role
      FROM (SELECT *, coalesce({_first_sql(rules.STATE_RULES)}, CASE WHEN beat = 'cta' THEN 'resolution' END, 'curious') AS emotion
            FROM (SELECT *, CASE WHEN idx = 0 THEN 'hook' WHEN idx >= total - 1 THEN 'cta' ELSE coalesce({_first_sql(rules.PRODUCTION_BEAT_RULES)}, CASE WHEN idx <= 2 THEN 'setup' END, 'evidence') END AS beat,
                  CASE WHEN {_first_sql(rules.EXPRESSION_RULES, "'serious'")} = 'excited' AND idx >= 3 THEN 'serious' ELSE {_first_sql(rules.EXPRESSION_RULES, "'serious'")} END AS expression FROM segs)))""", SEGMENTS_SQL)
def f21(spark, sf):
    s = segments(spark, sf).withColumn("beat", rules.production_beat(C(), F.col("idx"), F.col("total"), False))
    s = s.withColumns({**rules.emotion_state(C(), F.col("beat"), F.col("idx"), F.col("total"), False), "role": rules.visual_role(F.col("beat"), C(), False),
                       "expression": rules.expression_label(C(), F.col("idx"), False)})
    return s.withColumn("kind", rules.asset_type(F.col("role"), F.lit(""), C(), False))


@register("f21_source_intents", "doc_id:i idx:i intent:s sources:s wants:s", """
SELECT doc_id, idx, intent, CASE intent WHEN 'oparchive_first' THEN 'oparchive,fandom,cse' WHEN 'branding' THEN 'fandom,cse,oparchive' ELSE 'fandom,oparchive,cse' END AS sources,
       CASE WHEN w THEN 'symbol' WHEN l THEN 'location' ELSE 'character' END AS wants
FROM (SELECT doc_id, idx, CASE WHEN contains(b, 'outan') THEN 'branding' WHEN contains(b, 'panel') OR contains(b, 'oda') THEN 'fandom_first'
        WHEN contains(b, ' arc') OR contains(b, ' war') OR contains(b, ' vs ') THEN 'scene_panel' WHEN contains(b, 'onth') AND contains(b, 'erst') THEN 'scene_panel'
        WHEN contains(b, 'onth') OR contains(b, 'erst') THEN 'oparchive_first' WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 3 THEN 'scene_panel' ELSE 'oparchive_first' END AS intent,
        contains(b, 'the ') AS w, contains(b, 'and') AS l FROM (SELECT doc_id, idx, text, lower(text) AS b FROM segs))""", SEGMENTS_SQL)
def f21_sources(spark, sf):
    s = segments(spark, sf)
    intent = rules.broll_intent(C(), F.lit(""), F.array().cast("array<string>"), branding=["outan"], meta=["panel", "oda"], places=["onth", "erst"], unicode=False)
    s = s.withColumn("intent", intent)
    return s.withColumns({"sources": F.array_join(rules.source_order(F.col("intent")), ","), "wants": rules.asset_kind_intent(C(), symbol=["the "], location=["and"])})


@register("f22_intent_strength", "script_id:i idx:i primary_intent:s intent_strength:d", """
SELECT script_id, idx, CASE beat_type WHEN 'hook' THEN 'curiosity_gap' WHEN 'evidence' THEN 'proof' WHEN 'reveal' THEN 'reversal' ELSE 'support' END AS primary_intent,
       round(least(1.0, 0.45e0 + CASE WHEN beat_type IN ('hook', 'reveal', 'payoff') THEN 0.18e0 ELSE 0.08e0 END + CASE WHEN CAST(asset_id AS BIGINT) % 2 = 0 THEN 0.10e0 ELSE 0.0 END), 2) AS intent_strength FROM beats""", BEATS_SQL)
def f22(spark, sf):
    b = beats(spark, sf)
    return b.withColumns(rules.intent_strength(F.col("beat_type"), F.when(F.col("asset_id").cast("long") % 2 == 0, "why").otherwise("")))


@register("f26_window_summary", "doc_id:i idx:i summary:s", """
SELECT doc_id, idx, CASE WHEN c = '' THEN 'none' WHEN regexp_matches(c, '(?i)\\bwhst\\b') THEN 'about whst'
       ELSE regexp_replace(substr(c, 1, 110), '[ ,.;]+$', '') END AS summary
FROM (SELECT doc_id, idx, regexp_replace(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 150), '[ ,.;]+$', '') AS c FROM segs)""", SEGMENTS_SQL)
def f26(spark, sf):
    from storyspark.operators.slides import summarize_window

    return segments(spark, sf).withColumn("summary", summarize_window(C(), F.lit("none"), [(r"\bwhst\b", "about whst")], unicode=False))


@register("f29_keyword_boost", "doc_id:i idx:i boosted:i", """
SELECT doc_id, idx, len(list_filter(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda w: trim(regexp_replace(w, '[^\\w\\s''-]', '', 'g'))), lambda w:
  w <> '' AND (regexp_matches(w, '(?i)^(\\d{4}|\\d{3,}|\\d{1,3}(?:,\\d{3})+|chapter\\s*\\d+|arc|final|saga|revealed?|truth)$') OR (upper(w) = w AND lower(w) <> w AND length(w) > 2)
  OR (regexp_matches(w, '^[A-Z]') AND length(w) > 3 AND NOT lower(w) IN ('the', 'and', 'for', 'with') AND (contains(lower(w), 'wh') OR contains(lower(w), 'th')))))) AS boosted FROM segs""", SEGMENTS_SQL)
def f29(spark, sf):
    return segments(spark, sf).withColumn("boosted", F.size(F.filter(text.tokens(C()), lambda w: text.is_keyword_boost(w, ["wh", "th"]))))


@register("w44_phrase_keywords", "doc_id:i idx:i keywords:s", f"""
SELECT doc_id, idx, CASE WHEN len(best) > 0 THEN array_to_string(list_transform(list_sort(list_transform(best, lambda x: {{'i': x.i, 'w': x.w}})), lambda x: x.w), ' ')
       WHEN idx % 3 = 0 THEN longest ELSE '' END AS keywords
FROM (SELECT doc_id, idx, list_sort(list({{'s': -sc, 'i': i, 'w': w}}) FILTER (sc > 0))[1:2] AS best, arg_max(w, (length(regexp_replace(w, '\\W+', '', 'g')), -i)) AS longest
      FROM (SELECT *, CASE WHEN c = '' OR length(c) <= 2 OR lower(c) IN ({','.join("'" + w + "'" for w in text.KEYWORD_STOPWORDS)}) THEN 0 ELSE
              1 + CASE WHEN boost THEN 5 ELSE 0 END + CASE WHEN contains(lower(c), 'wh') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(c, '^[A-Z]') AND length(c) > 3 THEN 3 ELSE 0 END
              + CASE WHEN length(c) >= 7 THEN 2 ELSE 0 END + CASE WHEN i = 0 OR i = n - 1 THEN 1 ELSE 0 END END AS sc
            FROM (SELECT *, regexp_matches(c, '(?i)^(\\d{{4}}|\\d{{3,}}|chapter\\s*\\d+|arc|final|saga|revealed?|truth)$') OR (upper(c) = c AND lower(c) <> c AND length(c) > 2)
                         OR (regexp_matches(c, '^[A-Z]') AND length(c) > 3 AND NOT lower(c) IN ('the', 'and', 'for', 'with') AND contains(lower(c), 'wh')) AS boost
                  FROM (SELECT *, trim(regexp_replace(w, '[^\\w''-]', '', 'g')) AS c
                        FROM (SELECT doc_id, idx, len(ws) AS n, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM (SELECT doc_id, idx, {TOKENS.format('text')} AS ws FROM segs)))))
      GROUP BY doc_id, idx)""", SEGMENTS_SQL)
def w44(spark, sf):
    return segments(spark, sf).withColumn("keywords", F.array_join(text.phrase_keywords(text.tokens(C()), F.col("idx"), ["wh"]), " "))


@register("f30_time_codes", "script_id:i idx:i code:s back:d", """
SELECT script_id, idx, (sec // 3600) || ':' || lpad(CAST((sec // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') || '.25' AS code, sec + 0.25 AS back
FROM (SELECT script_id, idx, CAST(floor(start_s) AS BIGINT) AS sec FROM beats)""", BEATS_SQL)
def f30(spark, sf):
    b = beats(spark, sf).withColumn("code", text.format_time(F.floor("start_s") + 0.25))
    return b.withColumn("back", text.parse_time(F.col("code")))


@register("f35_char_sum_pick", "script_id:i idx:i place:s", """
SELECT script_id, idx, list_extract(['bottom_right', 'mid_right', 'bottom_left', 'mid_left', 'top_right'],
       CAST((list_sum(list_transform(string_split(emotion, ''), lambda c: ascii(c))) + idx) % 5 + 1 AS INTEGER)) AS place FROM beats""", BEATS_SQL)
def f35(spark, sf):
    return beats(spark, sf).withColumn("place", text.char_sum_pick(F.col("emotion"), F.col("idx"), ["bottom_right", "mid_right", "bottom_left", "mid_left", "top_right"]))


@register("p6_coerce_json", "event_id:i k:i tag:s", """
SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, 'neutral' AS tag FROM events""")
def p6(spark, sf):
    from storyspark.operators.slides import coerce_struct

    e = table(spark, sf, "events")
    e = e.withColumn("p", coerce_struct(F.col("props"), "k long, tag string", {"k": F.lit(-1).cast("long"), "tag": F.lit("neutral")}))
    return e.select("event_id", "p.k", "p.tag")


@register("p11_expression_label", "event_id:i label:s", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'excited' WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'worried' WHEN 'error' THEN 'angry' ELSE 'neutral' END AS label FROM events""")
def p11(spark, sf):
    from storyspark.operators.slides import expression_label

    e = table(spark, sf, "events")
    raw = F.when(F.col("event_type") == "signup", " Hype").when(F.col("event_type") == "view", "calm").when(F.col("event_type") == "click", "some fear here").when(
        F.col("event_type") == "error", "ANGRY").otherwise("whatever")
    return e.withColumn("label", expression_label(raw))


# ---- folds over one text --------------------------------------------------------------------------

# greedy grouping in SQL: every part becomes a state of its own, and states are merged from left to right
NO_TEXT = "CAST([] AS VARCHAR[])"
PARTS = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def _packed(tokens: str, limit: int) -> str:
    """Tokens joined to pieces of at most ``limit`` characters."""
    merged = f"""list_reduce(list_transform({tokens}, lambda x: {{'d': {NO_TEXT}, 'c': x}}), lambda a, b: CASE WHEN length(a.c) + 1 + length(b.c) > {limit}
      THEN {{'d': list_append(a.d, a.c), 'c': b.c}} ELSE {{'d': a.d, 'c': a.c || ' ' || b.c}} END)"""
    return f"CASE WHEN len({tokens}) = 0 THEN {NO_TEXT} ELSE list_transform([{merged}], lambda z: list_append(z.d, z.c))[1] END"


CHUNK_SQL = DOCS_SQL + f""",
pt AS (SELECT doc_id, list_transform({PARTS.format("coalesce(text, '')")}, lambda x: {{'d': {NO_TEXT}, 'c': [x], 'n': length(x)}}) AS p FROM docs),
rd AS (SELECT doc_id, list_reduce(p, lambda a, b: CASE WHEN a.n + b.n > 500
         THEN {{'d': list_append(a.d, array_to_string(a.c, ' ')), 'c': list_concat([a.c[-1]], b.c), 'n': length(a.c[-1]) + b.n}}
         ELSE {{'d': a.d, 'c': list_concat(a.c, b.c), 'n': a.n + b.n}} END) AS z FROM pt),
ch AS (SELECT doc_id, list_append(z.d, array_to_string(z.c, ' ')) AS l FROM rd)"""


@register("f1_chunk_sentences", "doc_id:i chunk_no:i chunk:s", "SELECT doc_id, generate_subscripts(l, 1) - 1 AS chunk_no, unnest(l) AS chunk FROM ch", CHUNK_SQL)
def f1(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(text.chunk_sentences(C(), 500, 1)).alias("chunk_no", "chunk"))


SEGMENT_SQL = DOCS_SQL + f""",
pt AS (SELECT doc_id, list_prepend({{'d': {NO_TEXT}, 'c': {NO_TEXT}, 'n': 0}}, list_transform({SENTENCES.format("coalesce(text, '')")},
         lambda x: {{'d': {NO_TEXT}, 'c': [x], 'n': CAST(len({TOKENS.format("x")}) AS INTEGER)}})) AS p FROM docs),
rd AS (SELECT doc_id, list_reduce(p, lambda a, b:
         CASE WHEN a.n >= 7 AND a.n + b.n > 16 AND b.n >= 16 THEN {{'d': list_concat(list_append(a.d, array_to_string(a.c, ' ')), b.c), 'c': {NO_TEXT}, 'n': 0}}
              WHEN a.n >= 7 AND a.n + b.n > 16 THEN {{'d': list_append(a.d, array_to_string(a.c, ' ')), 'c': b.c, 'n': b.n}}
              WHEN a.n + b.n >= 16 THEN {{'d': list_append(a.d, array_to_string(list_concat(a.c, b.c), ' ')), 'c': {NO_TEXT}, 'n': 0}}
              ELSE {{'d': a.d, 'c': list_concat(a.c, b.c), 'n': a.n + b.n}} END) AS z FROM pt),
sg AS (SELECT doc_id, CASE WHEN len(z.c) = 0 THEN z.d WHEN len(z.d) > 0 AND z.n < 7
         THEN list_append(z.d[1:len(z.d) - 1], z.d[-1] || ' ' || array_to_string(z.c, ' ')) ELSE list_append(z.d, array_to_string(z.c, ' ')) END AS l FROM rd)"""


@register("f17_segment_script", "doc_id:i idx:i segment:s", "SELECT doc_id, generate_subscripts(l, 1) - 1 AS idx, unnest(l) AS segment FROM sg", SEGMENT_SQL)
def f17(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(text.segment_script(C())).alias("idx", "segment"))


TTS_SQL = DOCS_SQL + f""",
pa AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')), '\\n\\s*\\n+'),
         lambda x: {SQUEEZE.format("x")}), lambda x: x <> '') AS ps FROM docs),
pp AS (SELECT doc_id, generate_subscripts(ps, 1) AS n, unnest(ps) AS p FROM pa),
st AS (SELECT doc_id, n, p, list_filter(list_transform({PARTS.format("p")}, lambda x: trim(x)), lambda x: x <> '') AS s FROM pp),
el AS (SELECT doc_id, n, p, list_transform(s, lambda x: CASE WHEN length(x) > 250 THEN {{'d': {_packed(TOKENS.format("x"), 250)}, 'c': '', 'long': true}}
         ELSE {{'d': {NO_TEXT}, 'c': x, 'long': false}} END) AS e FROM st),
rd AS (SELECT doc_id, n, p, list_reduce(e, lambda a, b:
         CASE WHEN b.long THEN {{'d': list_concat(list_concat(a.d, CASE WHEN a.c <> '' THEN [a.c] ELSE {NO_TEXT} END), b.d), 'c': '', 'long': true}}
              WHEN a.c <> '' AND length(a.c) + 1 + length(b.c) > 250 THEN {{'d': list_append(a.d, a.c), 'c': b.c, 'long': false}}
              ELSE {{'d': a.d, 'c': trim(a.c || ' ' || b.c), 'long': false}} END) AS z FROM el),
ck AS (SELECT doc_id, flatten(list(CASE WHEN length(p) <= 250 THEN [p] WHEN z.c <> '' THEN list_append(z.d, z.c) ELSE z.d END ORDER BY n)) AS l FROM rd GROUP BY doc_id)"""


@register("f27_tts_chunks", "doc_id:i chunk_no:i chunk:s", "SELECT doc_id, generate_subscripts(l, 1) - 1 AS chunk_no, unnest(l) AS chunk FROM ck", TTS_SQL)
def f27(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(text.tts_chunks(C(), 250)).alias("chunk_no", "chunk"))


@register("f28_wrap_lines", "doc_id:i idx:i wrapped:s", """
SELECT doc_id, idx, CASE WHEN len(l) > 2 THEN l[1] || '\\N' || array_to_string(l[2:], ' ') ELSE array_to_string(l, '\\N') END AS wrapped FROM wl""",
          SEGMENTS_SQL + f""",
wl AS (SELECT doc_id, idx, {_packed("t", 28)} AS l FROM (SELECT doc_id, idx, {TOKENS.format("text")} AS t FROM segs))""")
def f28(spark, sf):
    return segments(spark, sf).withColumn("wrapped", text.wrap_lines(C()))


NORMAL_SQL = DOCS_SQL + f""",
md AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\*{{1,3}}(.+?)\\*{{1,3}}', '\\1', 'g'), '_{{1,3}}(.+?)_{{1,3}}', '\\1', 'g'), '\\[.*?\\]', '', 'g') AS t FROM docs),
pa AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(t, '^\\s+|\\s+$', '', 'g')), '\\n\\s*\\n+'), lambda x:
         regexp_replace(trim(regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), '\\s*\\n\\s*', ' ', 'g')), lambda x: x <> '') AS ps FROM md),
se AS (SELECT doc_id, ps, list_filter(list_transform({PARTS.format("coalesce(ps[1], '')")}, lambda x: trim(x)), lambda x: x <> '') AS s FROM pa),
nm AS (SELECT doc_id, array_to_string(CASE WHEN len(ps) = 1 AND len(s) > 3 AND len(regexp_extract_all(ps[1], '[A-Za-z0-9_''-]+')) > 140
         THEN list_transform(range(0, (len(s) + 1) // 2), lambda i: array_to_string(s[2 * i + 1:2 * i + 2], ' ')) ELSE ps END, chr(10) || chr(10)) AS normalized FROM se)"""


@register("f11_normalize_paragraphs", "doc_id:i paragraphs:i normalized:s",
          "SELECT doc_id, len(string_split(normalized, chr(10) || chr(10))) AS paragraphs, normalized FROM nm", NORMAL_SQL)
def f11(spark, sf):
    d = docs(spark, sf).withColumn("normalized", text.normalize_paragraphs(C()))
    return d.withColumn("paragraphs", F.size(F.split("normalized", "\n\n")))


# ---- lexicons ------------------------------------------------------------------------------------------

LEX_SQL = DOCS_SQL + """,
lx AS (SELECT item_id, lower(array_to_string(unnest([w[1:2], w[2:4], w[5:9], w[3:3]]), ' ')) AS term
       FROM (SELECT item_id, regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), '[A-Za-z]+') AS w FROM benchmark)),
lh AS (SELECT DISTINCT d.doc_id, l.item_id FROM docs d JOIN lx l ON l.term <> '' AND regexp_matches(lower(d.text), '\\b' || l.term || '\\b'))"""


def lexicon(spark, sf):
    """Runs of one, two, three and five words of each benchmark item as a lexicon of names."""
    w = F.regexp_extract_all(F.regexp_replace("text", r"[^\x00-\x7F]", "x"), F.lit("([A-Za-z]+)"), 1)
    runs = F.array(*[F.array_join(F.slice(w, a, n), " ") for a, n in ((1, 2), (2, 3), (5, 5), (3, 1))])
    return table(spark, sf, "benchmark").select("item_id", F.explode(F.transform(runs, F.lower)).alias("term"))


@register("j1_lexicon_entities", "doc_id:i entities:s", """
SELECT doc_id, string_agg('item' || item_id, ',' ORDER BY item_id) AS entities
FROM (SELECT * FROM lh QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY item_id) <= 8) GROUP BY doc_id""", LEX_SQL)
def j1(spark, sf):
    lex = lexicon(spark, sf).select("term", F.concat(F.lit("item"), "item_id").alias("canonical"), F.lit(1).alias("alias_first"), F.col("item_id").alias("pos"))
    # terms are exact letter words: text words are joined by one space, so a break or comma between them is no hit
    out = graph.entities_by_join(docs(spark, sf), lex, 8, tid="doc_id")
    return out.withColumn("entities", F.array_join("entities", ","))


@register("j12_narration_mentions", "doc_id:i item_id:i boost:d kind:s", """
SELECT doc_id, item_id, 0.20e0 + CASE WHEN s IS NOT NULL THEN 0.08e0 ELSE 0.0 END AS boost, s AS kind
FROM lh JOIN (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\bwhst\\b') THEN 'opposes' WHEN regexp_matches(text, '(?i)\\bndble|nthe\\b') THEN 'rivals' END AS s FROM docs) USING (doc_id)
WHERE doc_id <> item_id""", LEX_SQL)
def j12(spark, sf):
    narration = docs(spark, sf).select(F.col("doc_id").alias("src"), F.col("text").alias("narration"))
    names = lexicon(spark, sf).withColumnRenamed("item_id", "node_id")
    out = graph.narration_mentions(narration, names, rules=[(r"\bwhst\b", "opposes"), (r"\bndble|nthe\b", "rivals")], unicode=False)
    return out.select(F.col("src").alias("doc_id"), F.col("dst").alias("item_id"), "boost", F.col("narration_type").alias("kind"))


REL = [(r"\bwhst\b", "opposes"), (r"\bndble|nthe\b", "allies_with")]


@register("w46_relation_rows", "doc_id:i idx:i source:s target:s relationship:s", """
SELECT doc_id, idx, e[1] AS source, unnest(e[2:3]) AS target, CASE WHEN regexp_matches(text, '(?i)\\bwhst\\b') THEN 'opposes' WHEN regexp_matches(text, '(?i)\\bndble|nthe\\b') THEN 'allies_with' ELSE 'associated_with' END AS relationship
FROM (SELECT doc_id, idx, text, list_filter([CASE WHEN regexp_matches(lower(text), '\\bthe\\b') THEN 'the' END, CASE WHEN regexp_matches(lower(text), '\\bof\\b') THEN 'of' END,
      CASE WHEN regexp_matches(lower(text), '\\band\\b') THEN 'and' END, CASE WHEN regexp_matches(lower(text), '\\bwhst\\b') THEN 'whst' END, CASE WHEN regexp_matches(lower(text), '\\bto\\b') THEN 'to' END], lambda x: x IS NOT NULL)[1:4] AS e FROM segs)
WHERE len(e) >= 2""", SEGMENTS_SQL)
def w46(spark, sf):
    s = segments(spark, sf).withColumn("e", graph.context_entities(C(), [], ["the", "of", "and", "whst", "to"], 8))
    return text.relation_rows(s, "e", C(), REL, False)


@register("a14_script_context", "source:s context:s", """
SELECT source, substr(string_agg(text, ' ' ORDER BY doc_id), 1, 3000) AS context FROM docs GROUP BY source""", DOCS_SQL)
def a14(spark, sf):
    d = number_rows(docs(spark, sf), "source", ["doc_id"])
    return text.leading_text(d, 3000, key="source")


# ---- pages -------------------------------------------------------------------------------------------------

HTML_TEXT = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>', ' ', 'g'), "
             "'(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</p>|</h[1-6]>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g'), '^$', '')")
UNESCAPE = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', chr(160)), '&#39;', ''''), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@register("s7_html_to_text", "page_id:i content:s", f"SELECT page_id, {UNESCAPE.format(HTML_TEXT)} AS content FROM pages")
def s7(spark, sf):
    return table(spark, sf, "pages").withColumn("content", web.html_to_text(F.col("html")))


@register("s8_links", "page_id:i pos:i url:s title:s", rf"""
SELECT page_id, pos, url, trim(regexp_replace({UNESCAPE.format("regexp_replace(raw, '(?s)<[^>]+>', ' ', 'g')")}, '[\s' || chr(160) || ']+', ' ', 'g')) AS title
FROM (SELECT page_id, generate_subscripts(u, 1) - 1 AS pos, unnest(u) AS url, unnest(r) AS raw
      FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1) AS u, regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2) AS r FROM pages))""")
def s8(spark, sf):
    return web.extract_links(table(spark, sf, "pages"), "page_id", "html")


@register("t4_multi_key_sort", "lang:s rank:i page_id:i url_hash:s", """
SELECT lang, rank, page_id, url_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, reused, kind, url, page_id) AS rank
  FROM (SELECT page_id, url, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, length(html) // 1000 AS score, CASE WHEN contains(url, '?') THEN 1 ELSE 0 END AS reused,
               CASE WHEN contains(url, 'https') THEN 0 ELSE 1 END AS kind, md5(regexp_replace(url, '[?#].*$', '')) AS url_hash FROM pages)) WHERE rank <= 5""")
def t4(spark, sf):
    p = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.floor(F.length("html") / 1000).alias("score"),
        F.col("url").contains("?").cast("int").alias("reused"), F.when(F.col("url").contains("https"), 0).otherwise(1).alias("kind"), search.url_hash(F.col("url")).alias("url_hash"))
    return search.top_k(p, 5, [F.desc("score"), F.col("reused"), F.col("kind"), F.col("url"), F.col("page_id")], "lang")
