"""Slide normalising and refining: enumerations, defaults, texts, queries, adapters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions import rules
from storyspark.functions.text import clean_prompt, dedupe_words, let, norm_key, sanitize_query
from storyspark.operators.graph import context_entities
from storyspark.operators.intervals import overlapping_text
from storyspark.operators.ordered import Blocks
from storyspark.operators.search import rank_for_beat
from storyspark.operators.sequence import TRANSITION_BY_BEAT, lookup
from storyspark.session import packed

K, O = "script_id", "idx"

# fixed values
PRODUCTION_BEATS = ["hook", "setup", "evidence", "reveal", "twist", "escalation", "payoff", "resolution", "cta"]
ROLES = ["character", "evidence", "location", "object", "symbol", "comparison", "timeline", "quote_card", "section_card", "title_card",
         "cta_card", "evidence_card"]
LAYOUTS = {"short_vertical": ["safe_subject", "title_card", "evidence_card", "quote_card"],
           "long_youtube": ["horizontal_feature", "section_card", "evidence_card", "quote_card", "split_context"]}
MOTIONS = ["subject_push", "reveal_zoom", "wide_pan", "evidence_hold", "title_card_hold", "slow_push", "pull_out", "diagonal_pan",
           "impact_zoom", "stable_pan", "hold_still", "static_hold"]
EFFECT_ONLY = ["flash_frame", "impact_shake", "red_eye_flash", "glitch", "dark_vignette", "desaturation", "chromatic_shift", "slow_push_in",
               "morph", "bass_hit"]
MOTION_ONLY = ["slow_push_in", "slow_push", "pull_out", "pull_out_zoom", "reveal_zoom", "impact_zoom", "wide_pan", "stable_pan", "diagonal_pan",
               "subject_push", "evidence_hold", "hold_still", "title_card_hold", "dramatic_push", "push_in", "creep_in"]
TARGET_STOPWORDS = ["a", "an", "the", "is", "was", "were", "are", "be", "been", "not", "no", "nor", "but", "or", "and", "if", "in", "on", "to",
                    "of", "at", "by", "for", "it", "its", "so", "as", "he", "she", "his", "her", "him", "we", "us", "our", "they", "do", "did",
                    "had", "has", "have", "will", "can", "may", "that", "this", "with", "from", "who", "what", "how"]
BRIEF_EFFECTS = ["impact_shake", "red_eye_flash", "glitch", "chromatic_shift"]
PACINGS = ["rapid_montage", "hold_frame", "dramatic_pause", "parallel_cut", "standard"]
LABELS = ["neutral", "serious", "happy", "excited", "angry", "surprised", "sad", "worried", "smirking", "confident", "intense", "embarrassed"]
LABEL_ALIASES = {"emotion": "neutral", "emotional": "sad", "calm": "neutral", "hype": "excited", "shock": "surprised", "fear": "worried",
                 "annoyed": "angry", "determined": "intense", "battle": "intense", "laugh": "happy", "smile": "happy"}
SAFE_TRANSITIONS = ["fade", "fade_eased", "crossfade", "zoom_dissolve", "iris_wipe", "radial_wipe"]
FLIPS = {"slide_left": "slide_right", "slide_right": "slide_left", "motion_slide_left": "motion_slide_right",
         "motion_slide_right": "motion_slide_left", "whip_pan_left": "whip_pan_right", "whip_pan_right": "whip_pan_left"}


def _s(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _low(c: str | Column) -> Column:
    return F.lower(F.trim(_s(c)))


def _in(c: Column, values: Sequence[str], default: Column) -> Column:
    return F.when(c.isin(*values), c).otherwise(default)


# ---- P6, P9 - P11 ------------------------------------------------------------------------

def coerce_struct(c: Column, ddl: str, defaults: dict[str, Column]) -> Column:
    """JSON text as a struct with defaults; a plain string or null becomes the defaults."""
    s = F.from_json(F.when(F.startswith(F.trim(c), F.lit("{")), c), ddl)
    return F.struct(*[F.coalesce(s[k], d).alias(k) for k, d in defaults.items()])


def emotion_struct(c: Column) -> Column:
    """Emotion given as JSON object or plain label."""
    plain = F.when(~F.startswith(F.trim(c), F.lit("{")) & (F.trim(c) != ""), F.trim(c))
    return coerce_struct(c, "emotion string, intensity double", {"emotion": F.coalesce(plain, F.lit("neutral")), "intensity": F.lit(0.5)})


def normalize_profile(c: Column, default: str = "short_vertical") -> Column:
    t = _low(c)
    return _in(t, list(LAYOUTS), F.lit(default))


def normalize_style(c: Column, styles: Sequence[str], default: str) -> Column:
    return _in(_low(c), styles, F.lit(default))


def safe_transition(c: Column) -> Column:
    """Directional transitions replaced by calm ones."""
    t = F.when(_low(c) == "", "crossfade").otherwise(_low(c))
    starts = lambda *p: F.lit(False) if not p else F.startswith(t, F.lit(p[0])) | starts(*p[1:])
    return (F.when(t.isin(*SAFE_TRANSITIONS, "none"), t).when(starts("whip_pan", "motion_slide", "slide_"), "crossfade")
            .when(starts("cube_rotation"), "iris_wipe").when(starts("page_curl") | (t == "water_ripple"), "fade_eased").otherwise(t))


def flip_transition(c: Column) -> Column:
    return F.coalesce(lookup(FLIPS, c), c)


def match_pan(c: Column, next_pan: Column) -> Column:
    """Horizontal transitions turned to the direction of the next pan (lr / rl)."""
    want = F.when(next_pan == "lr", "right").otherwise("left")
    return F.when(c.isin(*FLIPS), F.concat(F.regexp_replace(c, "(left|right)$", ""), want)).otherwise(c)


def expression_label(c: Column, labels: Sequence[str] = LABELS, aliases: dict[str, str] | None = None) -> Column:
    """Known label, alias, first known word in it, else neutral."""
    table = aliases or LABEL_ALIASES
    t = F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit("neutral"))))
    known = lambda x: F.when(x.isin(*labels), x).otherwise(lookup(table, x))
    words = F.filter(F.transform(F.split(t, "[^a-z]+"), known), lambda x: x.isNotNull())
    return F.coalesce(known(t), F.get(words, 0), F.lit("neutral"))


# ---- P5: defaults by role ---------------------------------------------------------------------

CARD_ROLES = ["title_card", "section_card", "cta_card"]
PROOF_ROLES = ["evidence", "evidence_card", "timeline", "object", "symbol"]


def default_layout(profile: Column, beat: Column, role: Column) -> Column:
    wide = (F.when(role.isin(*CARD_ROLES) | beat.isin("hook", "payoff"), "section_card").when(role.isin(*PROOF_ROLES), "evidence_card")
            .when(role == "quote_card", "quote_card").when(role == "comparison", "split_context").otherwise("horizontal_feature"))
    tall = (F.when(role.isin(*CARD_ROLES), "title_card").when(role.isin(*PROOF_ROLES), "evidence_card")
            .when(role == "quote_card", "quote_card").otherwise("safe_subject"))
    return F.when(profile == "long_youtube", wide).otherwise(tall)


def default_motion(profile: Column, beat: Column, layout: Column) -> Column:
    return (F.when(layout.isin("title_card", "section_card") | (beat == "cta"), "title_card_hold").when(beat == "reveal", "reveal_zoom")
            .when((profile == "long_youtube") & (layout == "horizontal_feature"), "wide_pan").when(beat.isin("evidence", "setup"), "evidence_hold")
            .otherwise("subject_push"))


def overlay_text(summary: Column, beat: Column, role: Column) -> Column:
    shown = role.isin(*CARD_ROLES, "evidence", "evidence_card", "quote_card", "timeline", "comparison")
    t = clean_prompt(summary, 82)
    return F.when(~shown | (t == ""), "").when(beat == "cta", "Comment your theory").otherwise(t)


FOCUS = {  # fixed values
    "evidence": "The specific evidence or canon behavior behind: ", "evidence_card": "The specific evidence or canon behavior behind: ",
    "quote_card": "The key thesis line the viewer should remember: ", "object": "The object or power that makes this narration concrete: ",
    "location": "The place or arc that grounds this beat in canon: ", "symbol": "The symbol/institution that carries the meaning of this beat: ",
    "comparison": "The contrast the viewer should compare on screen: ", "timeline": "The sequence of time or escalation behind: ",
}
PURPOSE_BY_ROLE = {
    "character": "Identify the person driving the beat.", "evidence": "Prove the claim with a concrete canon beat.",
    "location": "Ground the argument in a recognizable arc or place.", "object": "Make an abstract idea tangible through an object or power.",
    "symbol": "Represent a faction, ideology, or larger theme.", "comparison": "Show the contrast that makes the argument clear.",
    "timeline": "Show escalation or change over time.", "quote_card": "Make the thesis line stick.", "section_card": "Signal a new argument section.",
}
PURPOSE_BY_BEAT = {  # beat -> (with a text, without one)
    "hook": ("Create curiosity and establish stakes: ", "Create curiosity and establish stakes."),
    "setup": ("Set up the core idea the viewer must understand: ", "Set up the core idea."),
    "reveal": ("Reveal the turn or hidden implication: ", "Reveal the turn."),
    "payoff": ("Pay off the argument with a clear takeaway: ", "Pay off the argument."),
}


def viewer_focus(summary: Column, subtitle: Column, beat: Column, role: Column) -> Column:
    t = clean_prompt(F.when(_s(summary) != "", summary).otherwise(subtitle), 120)
    out = F.when(t == "", "A clear canon visual that supports this narration beat.").when(beat == "hook", F.concat(F.lit("The opening visual question: "), t))
    for r, lead in FOCUS.items():
        out = out.when(role == r, F.concat(F.lit(lead), t))
    return out.when(beat == "cta", "A clean outro/CTA visual that leaves the topic in mind.").otherwise(
        F.concat(F.lit("The concrete scene, character, object, or location that makes this beat visible: "), t))


def visual_purpose(summary: Column, subtitle: Column, beat: Column, role: Column) -> Column:
    t = clean_prompt(F.when(_s(summary) != "", summary).otherwise(subtitle), 100)
    out = F.when(beat == "cta", "Close the video and keep the topic/question memorable.")
    for b, (lead, bare) in PURPOSE_BY_BEAT.items():
        out = out.when(beat == b, F.when(t != "", F.concat(F.lit(lead), t)).otherwise(bare))
    return out.otherwise(lookup(PURPOSE_BY_ROLE, role, "Support the narration with a concrete visual function."))


def upload_brief(query: Column, focus: Column, default: str = "Choose a clear image that directly supports this narration beat.") -> Column:
    q, f = clean_prompt(query, 80), clean_prompt(focus, 120)
    return F.when((q != "") & (f != ""), F.concat(F.lit("Choose an image showing "), q, F.lit(". It should communicate: "), f)).when(
        q != "", F.concat(F.lit("Choose a clear image showing "), q, F.lit("."))).otherwise(default)


def emphasis_words(text: Column, entities: Column, terms: str = r"chapter\s+\w+", limit: int = 4) -> Column:
    found = F.regexp_extract_all(_s(text), F.lit(rf"(?iU)\b({terms})\b"), 1)
    return F.slice(F.array_distinct(F.filter(F.concat(entities, F.transform(found, lambda x: F.trim(x))), lambda x: x != "")), 1, limit)


# ---- P4: production defaults --------------------------------------------------------------------------

def production_defaults(df: DataFrame, profile: str = "short_vertical", canonical: Sequence[str] = (), key: str = K, order: str = O,
                        block_rows: int | None = None, unicode: bool = True) -> DataFrame:
    """Every enumeration clamped to its valid set, conflicting cues cleared, texts filled.

    Needs the slide columns of the model reply parser plus subtitle_text, entities, start_s, end_s.
    """
    missing = {c: F.lit(None).cast(t) for c, t in (
        ("beat_type", "string"), ("visual_role", "string"), ("layout_mode", "string"), ("motion_preset", "string"), ("text_overlay", "string"),
        ("transition_in", "string"), ("sfx_cue", "string"), ("target_word", "string"), ("pacing_intent", "string"), ("subtitle_text", "string"),
        ("visual_purpose", "string"), ("viewer_focus", "string"), ("manual_upload_brief", "string"), ("director_note", "string"),
        ("effect_cues", "array<string>"), ("emphasis_words", "array<string>"), ("entities", "array<string>"), ("asset_confidence", "double"),
    ) if c not in df.columns}
    b = Blocks.dense(df.withColumns(missing) if missing else df, key, order, block_rows).scan(totals={"_n": ("count", F.lit(1))})
    i, n = F.col(order), F.col("_n")
    empty = F.array().cast("array<string>")
    prof = F.lit(profile)
    text = F.trim(F.concat_ws(" ", F.nullif(_s("subtitle_text"), F.lit("")), F.nullif(_s("summary"), F.lit(""))))
    out = b.df.withColumns({"_text": text, "entities": F.coalesce("entities", empty)})
    t = F.col("_text")
    out = out.withColumn("beat_type", _in(_low("beat_type"), PRODUCTION_BEATS, rules.production_beat(t, i, n, unicode)))
    beat = F.col("beat_type")
    out = out.withColumn("visual_role", _in(_low("visual_role"), ROLES, rules.visual_role(beat, t, unicode)))
    role = F.col("visual_role")
    out = out.withColumn("layout_mode", _in(_low("layout_mode"), LAYOUTS[profile], default_layout(prof, beat, role)))
    out = out.withColumn("motion_preset", _in(_low("motion_preset"), MOTIONS, default_motion(prof, beat, F.col("layout_mode"))))
    cut = F.when((_low("transition_in") == "") | _low("transition_in").isin(*EFFECT_ONLY), lookup(TRANSITION_BY_BEAT, beat, "crossfade")).otherwise(_low("transition_in"))
    asked = _low("sfx_cue")
    own = F.when((asked == "none") | (asked == cut) | (_s("target_word") != ""), "").otherwise(asked)
    either = lambda c, alt: F.when(_s(c) != "", F.col(c)).otherwise(alt)
    focus = clean_prompt(either("viewer_focus", viewer_focus(F.col("summary"), F.col("subtitle_text"), beat, role)), 160)
    names = [c.lower() for c in canonical]
    known = F.exists(F.split(F.lower(_s("query")), r"\s+"), lambda w: w.isin(*names)) if names else F.lit(False)
    conf = F.when(F.col("asset_confidence").isNull(), rules.asset_confidence(F.col("query"), t, F.col("entities"), unicode=unicode)).when(
        known, F.col("asset_confidence")).otherwise(F.least(F.col("asset_confidence"), F.lit(0.55)))
    pace = _in(_low("pacing_intent"), PACINGS, F.lit("standard"))
    length = F.col("end_s") - F.col("start_s")
    cues = F.filter(F.coalesce("effect_cues", empty), lambda c: ~F.lower(F.trim(c)).isin(*MOTION_ONLY)
                    & ~((length < 0.5) & F.lower(F.trim(c)).isin(*BRIEF_EFFECTS)))
    target = _low("target_word")
    return out.withColumns({
        "text_overlay": clean_prompt(either("text_overlay", overlay_text(F.col("summary"), beat, role)), 90),
        "emphasis_words": F.coalesce("emphasis_words", emphasis_words(t, F.col("entities"))),
        "transition_in": cut,
        "sfx_cue": F.when(beat == "cta", "mouse_click").when(beat == "hook", "pop").when(own != "", own).otherwise(cut),
        "visual_purpose": clean_prompt(either("visual_purpose", visual_purpose(F.col("summary"), F.col("subtitle_text"), beat, role)), 180),
        "viewer_focus": focus, "manual_upload_brief": clean_prompt(either("manual_upload_brief", upload_brief(F.col("query"), focus)), 220),
        "asset_confidence": conf, "pacing_intent": pace, "effect_cues": cues,
        "target_word": F.when(target.isin(*TARGET_STOPWORDS), "").otherwise(target), "director_note": _s("director_note"),
        "end_s": F.when((pace == "rapid_montage") & (length > 2.0), F.col("start_s") + 2.0).otherwise(F.col("end_s")),
        "visual_source": F.lit("asset_search"),
    }).drop("_n", "_text")


# ---- W9: feature columns ---------------------------------------------------------------------------

PLACE_TAGS = ["island", "village", "castle", "sea", "ship", "tower"]


def audit_features(df: DataFrame, terms: Sequence[str] = rules.ARC_LOCATION_TERMS, entities: str = "entities", asset_entities: str = "asset_entities",
                   tags: str = "search_tags", query: str = "query", emotion: str = "emotion") -> DataFrame:
    """character, arc and emotion keys of a beat with their fallbacks.

    With several arcs in a text the alphabetically first is taken (the published rule walks a
    set and has no order).
    """
    has = lambda c: c in df.columns
    first = lambda c: norm_key(F.get(F.col(c), 0)) if has(c) else F.lit("")
    word = F.get(F.filter(F.split(_s(query), r"\s+"), lambda w: F.length(w) > 2), 0)
    who = F.coalesce(F.nullif(first(entities), F.lit("")), F.nullif(first(asset_entities), F.lit("")), norm_key(word))
    blob = F.lower(F.concat_ws(" ", _s("subtitle_text"), _s("summary") if has("summary") else F.lit(""), _s(query)))
    arc = F
    for term in sorted(terms):
        arc = arc.when(blob.contains(term), "".join(ch for ch in term if ch.isalnum()))
    place = F.lit("")
    if has(tags):
        place = norm_key(F.get(F.filter(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: rules.contains_any(F.lower(t), PLACE_TAGS)), 0))
    return df.withColumns({"character": who, "arc": arc.otherwise(place), "emotion_key": norm_key(F.col(emotion))})


# ---- P8: output shape -----------------------------------------------------------------------------------

def legacy_shape(df: DataFrame) -> DataFrame:
    """Defaults of the output format: motion from a nested plan, transition, lifted tags, duration."""
    has = lambda c: c in df.columns
    cols = {}
    if has("motion"):
        cols["motion_preset"] = F.when((_s("motion_preset") == "") | (F.col("motion_preset") == "none"), F.coalesce(F.col("motion.style"), F.lit("none"))).otherwise(F.col("motion_preset"))
    if has("transition_type"):
        unset = (_s("transition_in") == "") | (F.col("transition_in") == "crossfade") if has("transition_in") else F.lit(True)
        cols["transition_in"] = F.when(unset & (_s("transition_type") != ""), F.col("transition_type")).otherwise(F.col("transition_in") if has("transition_in") else F.lit("crossfade"))
    if not has("search_tags") and has("asset_metadata"):
        cols["search_tags"] = F.col("asset_metadata.search_tags")
    if not has("duration"):
        cols["duration"] = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    return df.withColumns(cols)


# ---- F24 - F26, W40: queries and summaries ------------------------------------------------------------------

def asset_metadata(df: DataFrame, assets: DataFrame | None = None, key: Sequence[str] = (K, O), k: int = 3, places: Sequence[str] = rules.ARC_LOCATION_TERMS,
                   unicode: bool = True) -> DataFrame:
    """Struct of query, type, entities, tags, source order and confidence; with ``assets`` also their ``k`` best by the composite rank."""
    text = F.concat_ws(" ", _s("subtitle_text"), _s("summary"), _s("viewer_focus"))
    kind = rules.asset_type(_s("visual_role"), F.col("query"), text, unicode)
    tags = F.slice(F.split(dedupe_words(F.concat_ws(" ", "query", F.array_join(F.slice("entities", 1, 3), " "), kind)), " "), 1, 10)
    conf = F.coalesce(F.col("asset_confidence"), rules.asset_confidence(F.col("query"), text, F.col("entities"), unicode=unicode))
    fields = [F.col("query").alias("query"), kind.alias("asset_type"), F.slice("entities", 1, 6).alias("entities"), tags.alias("search_tags"),
              F.array(F.lit("upload"), F.lit("vivre_card"), F.lit("manual_asset_search")).alias("source_priority"), conf.alias("confidence")]
    if assets is None:
        return df.withColumn("asset_metadata", F.struct(*fields))
    place = F.struct(*key).alias("query_id")
    asked = df.select(place, F.concat_ws(" ", "query", text).alias("text"), "entities", tags.alias("tags"), F.col("emotion") if "emotion" in df.columns else F.lit("").alias("emotion"))
    ranked = rank_for_beat(assets, asked, k, places=places).join(assets.select("id", "name"), "id")
    best = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "name", F.round("score", 4).alias("score")))),
                                                      lambda r: F.struct(r["id"].alias("id"), r["name"].alias("name"), r["score"].alias("score"))).alias("_ranked"))
    out = df.join(best.select("query_id.*", "_ranked"), list(key), "left")
    return out.withColumn("asset_metadata", F.struct(*fields, F.col("_ranked").alias("ranked_assets"))).drop("_ranked")


def summarize_window(text: Column, fallback: Column, hooks: Sequence[tuple[str, str]] = (), subjects: str | None = None, unicode: bool = True) -> Column:
    """Known summary for a text that fires a rule, else the text itself, cut short."""
    c = clean_prompt(text, 150)
    trim = lambda n: F.regexp_replace(F.substring(c, 1, n), r"[ ,.;]+$", "")
    plain = trim(110)
    if subjects:
        who = F.regexp_extract(c, rules.rx(rf"\b({subjects})\b", unicode), 1)
        plain = F.when(who != "", F.concat(who, F.lit(": "), trim(90))).otherwise(plain)
    return F.when(c == "", fallback).otherwise(F.coalesce(rules.first_match(c, hooks, None, unicode), plain) if hooks else plain)


BAD_QUERY = (r"\b(model\s+\w+|hito\s+hito|gear\s+v\b|laboratory|battlefield|manga\s+panel|stretching|aura|thermodynamic|kinetic|infographic|diagram|"
             r"explosion|internal\s+friction|comparison\s+chart|theories)\b")  # fixed value
NOT_SEARCHABLE = (r"\b(thermodynamic|kinetic|friction|pressure|elastic|detonat|explosion|internal\s+blast|diagram|infographic|two\s+devil\s+fruit\s+rule|"
                  r"vs\s+normal|energy\s+expansion|mythical\s+zoan\s+property|abstract)\b")  # fixed value


def infer_query(text: Column, hooks: Sequence[tuple[str, str]], found: Column, given: Column, fallback: str = "Logo", unicode: bool = True) -> Column:
    """Query of the first hook that fires, else from the entities in the text, else the given ones; null without any."""
    own = F.array_join(F.slice(found, 1, 2), " ")
    anchors = F.array_join(F.slice(given, 1, 2), " ")
    pick = F.when(F.size(found) > 0, sanitize_query(own, text, found, fallback=fallback)).when(
        F.size(given) > 0, sanitize_query(anchors, text, given, fallback=fallback))
    return F.when(_s(text) != "", F.coalesce(rules.first_match(text, hooks, None, unicode), pick) if hooks else pick)


def plan_query(query: Column, context: Column, inferred: Column, entities: Column, fallback: str = "Logo", unicode: bool = True) -> Column:
    """A searchable query: unsearchable ideas give way to the inferred query, one word gets an entity added."""
    bad = lambda c, p: c.rlike(rules.rx(p, unicode))
    names = F.array_join(F.slice(entities, 1, 2), " ")

    def usable(q):
        weak = (q == "") | bad(q, BAD_QUERY) | bad(F.concat_ws(" ", context, q), NOT_SEARCHABLE)
        return F.when(weak, F.coalesce(inferred, q)).otherwise(q)

    def fuller(q):
        lone = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) == 1
        extra = F.get(F.filter(F.slice(entities, 2, 2), lambda e: F.lower(e) != F.lower(q)), 0)
        return F.when((q == "") | bad(q, BAD_QUERY), F.when(F.size(entities) > 0, names).otherwise(fallback)).when(
            lone & extra.isNotNull(), F.concat_ws(" ", q, extra)).otherwise(q)

    planned = let(let(F.trim(_s(query)), usable), fuller)
    return dedupe_words(let(planned, lambda q: sanitize_query(q, context, entities, fallback=fallback)))


def refine_slides(slides: DataFrame, lines: DataFrame, aliases: Sequence[tuple[str, str]] = (), entities: Sequence[str] = (), hooks: Sequence[tuple[str, str]] = (),
                  hints: Sequence[tuple[str, str]] = (), fallback: str = "Logo", profile: str = "short_vertical", key: str = K, order: str = O,
                  block_rows: int | None = None, unicode: bool = True) -> DataFrame:
    """Text per slide, queries aligned with it, repeats made different, confidence, production defaults.

    "Seen before" only asks whether an earlier slide of the script has the same base query, so
    it is a first-position aggregate per (script, query), not a running map.
    """
    known = lambda c, n: context_entities(c, aliases, entities, n)
    s = overlapping_text(lines, slides, key, order)
    empty = F.array().cast("array<string>")
    given = F.coalesce(F.col("entities"), empty) if "entities" in slides.columns else empty
    s = s.withColumns({"_given": given, "_heard": known(F.col("subtitle_text"), 3), "_both": F.trim(F.concat_ws(" ", "subtitle_text", _s("summary")))})
    s = s.withColumn("_inferred", infer_query(F.col("subtitle_text"), hooks, F.col("_heard"), F.col("_given"), fallback, unicode))
    q = _s("query")
    few = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) < 2
    s = s.withColumn("_q", F.when(few & F.col("_inferred").isNotNull(), F.col("_inferred")).otherwise(q))
    mine = known(F.concat_ws(" ", _s("summary"), q), 6)
    s = s.withColumn("_q", sanitize_query(F.when(F.col("_q") != "", F.col("_q")).otherwise(fallback), F.col("_both"),
                                          F.when(F.size(mine) > 0, mine).otherwise(F.col("_given")), fallback=fallback))
    # queries are first counted, then joined with their counts, and their keys measured
    s = packed(s.withColumn("_base", F.lower("_q")))
    firsts = s.groupBy(key, "_base").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_uses"))
    s = s.join(firsts, [key, "_base"])
    hint = rules.first_match(F.col("_both"), hints, "", unicode) if hints else F.lit("")
    lead = F.get("_heard", 0)
    again = F.when(lead.isNotNull() & ~F.contains("_base", F.lower(lead)), sanitize_query(F.concat_ws(" ", lead, "_q"), F.col("_both"), F.col("_given"), fallback=fallback)).otherwise(
        F.when((hint != "") & ~F.contains("_base", F.lower(hint)), F.concat_ws(" ", "_q", hint)).otherwise(F.concat(F.col("_q"), F.lit(" alternate scene"))))
    s = s.withColumn("query", dedupe_words(F.when(F.col(order) > F.col("_first"), again).otherwise(F.col("_q"))))
    s = s.withColumn("query", plan_query(F.col("query"), F.col("_both"), F.col("_inferred"), F.col("_given"), fallback, unicode))
    return _with_duplicates(s, key, order, block_rows).withColumns({
        "asset_confidence": rules.asset_confidence(F.col("query"), F.col("subtitle_text"), F.col("_given"), F.col("_dup"), unicode=unicode),
        "summary": F.when((F.col("subtitle_text") != "") & (F.length(_s("summary")) < 12), F.when(_s("summary") != "", F.col("summary")).otherwise(
            F.substring("subtitle_text", 1, 80))).otherwise(F.col("summary")),
    }).drop("_given", "_heard", "_both", "_inferred", "_q", "_base", "_first", "_uses", "_dup", "line_count").transform(
        lambda d: production_defaults(d, profile, [*entities, *[n for _, n in aliases]], key, order, block_rows, unicode))


def _with_duplicates(s: DataFrame, key: str, order: str, block_rows: int | None) -> DataFrame:
    """Earlier slides with the same base query, per slide."""
    b = Blocks.adaptive(s, [key, "_base"], [order], block_rows).scan(running={"_seen": ("count", F.lit(1))})
    return b.df.withColumn("_dup", F.col("_seen") - 1).drop("_seen")
