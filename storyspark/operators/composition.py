"""Layer plans: strategy by beat and role, effects by emotion, text and motion layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.operators.sequence import lookup

# fixed values: beat type -> visual role -> strategy

STRATEGIES = {
    "hook": {"character": "hero_reveal", "title_card": "title_splash", "section_card": "title_splash", "symbol": "symbol_dramatic",
             "location": "establishing_wide", "evidence": "evidence_inspect"},
    "setup": {"character": "character_context", "location": "establishing_wide", "evidence": "evidence_inspect", "symbol": "symbol_dramatic",
              "object": "object_focus", "comparison": "split_compare", "timeline": "timeline_progression"},
    "evidence": {"evidence": "evidence_inspect", "character": "character_context", "object": "object_focus", "quote_card": "quote_emphasis",
                 "symbol": "symbol_dramatic", "location": "establishing_wide", "comparison": "split_compare", "timeline": "timeline_progression"},
    "reveal": {"character": "hero_reveal", "symbol": "symbol_dramatic", "evidence": "evidence_inspect", "object": "object_focus",
               "location": "establishing_wide", "comparison": "split_compare"},
    "twist": {"character": "character_dread", "symbol": "symbol_dramatic", "evidence": "evidence_inspect", "object": "object_focus",
              "comparison": "split_compare"},
    "escalation": {"character": "hero_reveal", "symbol": "symbol_dramatic", "evidence": "evidence_inspect", "comparison": "split_compare",
                   "object": "object_focus", "location": "establishing_wide"},
    "payoff": {"character": "hero_reveal", "symbol": "symbol_dramatic", "location": "establishing_wide", "object": "object_focus",
               "evidence": "evidence_inspect", "comparison": "split_compare"},
    "resolution": {"character": "character_context", "symbol": "symbol_dramatic", "location": "establishing_wide", "quote_card": "quote_emphasis"},
    "warning": {"character": "character_dread", "symbol": "symbol_dramatic"},
    "cta": {"cta_card": "cta_clean", "section_card": "cta_clean"},
}
# emotion -> (effect, layer type) in order
EFFECTS = {
    "grief": [("desaturation", "color_filter"), ("rain_particles", "particle")],
    "tension": [("vignette_dark", "vignette"), ("film_grain", "texture")],
    "fear": [("vignette_red", "vignette"), ("chromatic_shift", "distortion")],
    "rage": [("red_tint", "color_filter"), ("impact_lines", "overlay")],
    "shock": [("flash_white", "flash"), ("shake_effect", "camera_shake")],
    "hope": [("warm_glow", "color_filter"), ("light_rays", "particle")],
    "triumph": [("golden_glow", "color_filter"), ("sparkle_particles", "particle")],
    "intrigue": [("vignette_subtle", "vignette"), ("mist_overlay", "particle")],
    "revelation": [("light_bloom", "bloom"), ("radial_blur", "blur")],
}
OTHER_EFFECTS = [("subtle_vignette", "vignette")]
CUE_EFFECTS = {"impact_shake": "camera_shake", "flash_frame": "flash", "red_eye_flash": "red_flash", "slow_push_in": "motion",
               "glitch": "distortion", "dark_vignette": "vignette", "desaturation": "color_filter"}
CAMERA_STYLES = {"hook": "push_in_fast", "reveal": "slow_zoom_reveal", "payoff": "dramatic_push", "setup": "slow_pan_right",
                 "evidence": "subtle_drift", "escalation": "accelerating_push", "warning": "uneasy_drift", "cta": "static_hold"}
PANEL_LAYOUTS = ["title_card", "section_card", "evidence_card", "quote_card", "split_context"]
FOREGROUNDS = {  # strategy -> name, source prefix, fit, position, animation
    "symbol_dramatic": ("foreground_symbol", "symbol: ", "contain", "center", "pop_scale"),
    "object_focus": ("foreground_object", "object: ", "contain", "center", "zoom_in"),
    "evidence_inspect": ("foreground_evidence", "evidence: ", "safe_contain", "center", "fade_in"),
    "quote_emphasis": ("foreground_evidence", "evidence: ", "safe_contain", "center", "fade_in"),
    "split_compare": ("foreground_compare_left", "compare_a: ", "contain", "left_half", "fade_in"),
}
PEOPLE = {"hero_reveal": "zoom_in", "character_context": "fade_in", "character_dread": "slow_drift"}
SCREEN_TYPES = ["particle", "bloom", "flash"]


def strategy(beat_type: Column, role: Column) -> Column:
    own = {f"{b}/{r}": s for b, roles in STRATEGIES.items() for r, s in roles.items()}
    other = {r: s for r, s in STRATEGIES["evidence"].items()}
    return F.coalesce(lookup(own, F.concat_ws("/", beat_type, role)), lookup(other, role), F.lit("character_context"))


def _layer(name, category, source, kind, fit="cover", opacity=1.0, blend="normal", position="full", animation="none", metadata=None) -> Column:
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), c(v).cast("string"))]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(c(name).alias("name"), c(category).alias("category"), F.lit(0).alias("z_index"), c(source).alias("source"), c(kind).alias("type"),
                    c(fit).alias("fit"), c(opacity).cast("double").alias("opacity"), c(blend).alias("blend_mode"), c(position).alias("position"),
                    c(animation).alias("animation"), meta.alias("metadata"))


def plan_composition(df: DataFrame, max_layers: int = 8, effects: bool = True) -> DataFrame:
    """Adds ``strategy`` and ``layers`` (array of structs with ascending z_index).

    Background, treatment and foreground always stay; every later layer is added while fewer
    than ``max_layers`` are there, which for an ordered list is a slice.
    """
    max_layers = max(3, max_layers)
    has = lambda c: c in df.columns
    low = lambda c, d: F.lower(F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)))) if has(c) else F.lit(d)
    beat, role, layout, emotion = low("beat_type", "evidence"), low("visual_role", "character"), low("layout_mode", "safe_subject"), low("emotion", "")
    pacing = low("pacing_intent", "standard")
    x = F.coalesce(F.nullif(F.col("intensity"), F.lit(0.0)), F.lit(0.4))
    empty = F.array().cast("array<string>")
    query = F.coalesce(F.col("query"), F.lit(""))
    ents = F.coalesce(F.col("entities"), empty) if has("entities") else empty
    overlay = F.coalesce(F.col("text_overlay"), F.lit("")) if has("text_overlay") else F.lit("")
    words = F.coalesce(F.col("emphasis_words"), empty) if has("emphasis_words") else empty
    cues = F.transform(F.coalesce(F.col("effect_cues"), empty), lambda c: F.lower(F.trim(c))) if has("effect_cues") else empty
    df = df.withColumn("strategy", strategy(beat, role))
    st = F.col("strategy")
    person = st.isin(*PEOPLE)

    back = F.when(person, F.when(query != "", F.concat(F.lit("environment: "), query)).otherwise("abstract background")).when(
        st == "establishing_wide", F.when(query != "", F.concat(F.lit("wide shot: "), query)).otherwise("landscape establishing")).otherwise(
            F.when(query != "", query).otherwise("abstract background"))
    fixed = [_layer("background", "background", back, "image", F.when(layout.isin("safe_subject", "horizontal_feature"), "safe_contain").otherwise("cover"),
                    animation="slow_drift", metadata={"role": "environment", "search_entities": F.array_join(F.slice(ents, 1, 3), ",")})]
    fixed.append(F.when(st.isin("cta_clean", "title_splash"), _layer("bg_darken", "background", "gradient_overlay", "gradient", opacity=0.55, blend="multiply",
                                                                       metadata={"gradient": "top_transparent_to_bottom_black"}))
                 .when(emotion.isin("grief", "tension", "fear", "dread"), _layer("bg_mood", "background", "mood_overlay", "gradient",
                                                                                 opacity=F.least(F.lit(0.5), x * 0.5), blend="multiply", metadata={"mood": emotion}))
                 .when(beat.isin("reveal", "payoff"), _layer("bg_blur", "background", "depth_blur", "blur", opacity=0.3,
                                                             metadata={"blur_radius": "8", "purpose": "focus_subject"})))
    who = F.coalesce(F.get(ents, 0), F.lit("character"))
    front = F.when(person, _layer("foreground_character", "foreground", F.concat(F.lit("character: "), who), "image", "contain", position="center",
                                  animation=lookup(PEOPLE, st), metadata={"character": who, "cutout": "true"}))
    for name, (layer, prefix, fit, pos, anim) in FOREGROUNDS.items():
        front = front.when(st == name, _layer(layer, "foreground", F.concat(F.lit(prefix), query), "image", fit, position=pos, animation=anim, metadata={"type": layer}))
    fixed.append(front)

    parts = [F.array_compact(F.array(*fixed))]
    if effects:
        def effect(name, kind):
            return _layer(name, "effect", kind, kind, opacity=F.least(F.lit(0.8), x * 0.6 + 0.1), blend="screen" if kind in SCREEN_TYPES else "normal",
                          animation="pulse_glow" if kind == "particle" else "fade_in")

        made = F.coalesce(*[F.when(emotion == e, F.array(*[effect(*d) for d in defs])) for e, defs in EFFECTS.items()], F.array(*[effect(*d) for d in OTHER_EFFECTS]))
        parts.append(F.slice(made, F.lit(1), F.when(x < 0.5, 1).otherwise(2)))
    known = F.filter(cues, lambda c: c.isin(*CUE_EFFECTS))
    parts.append(F.transform(known, lambda c: _layer(c, "effect", c, lookup(CUE_EFFECTS, c))))
    panel_style = F.when(layout.isin(*PANEL_LAYOUTS), layout).otherwise("title_card")
    has_panel = (layout.isin(*PANEL_LAYOUTS) | st.isin("title_splash", "cta_clean", "quote_emphasis")) & (pacing != "rapid_montage")
    speed = F.least(F.lit(1.0), x * 0.5 + 0.3)
    camera = lookup(CAMERA_STYLES, beat, "subtle_drift")
    motion = F.coalesce(F.nullif(low("motion_preset", ""), F.lit("")), camera)
    headed = st.isin("title_splash", "cta_clean")
    parts.append(F.array_compact(F.array(
        F.when(has_panel, _layer("editorial_panel", "text", "panel", "shape", opacity=0.75, blend="multiply",
                                 position=F.when(panel_style.isin("evidence_card", "quote_card"), "lower_third").otherwise("full"),
                                 animation="fade_in", metadata={"style": panel_style})),
        F.when(overlay != "", _layer("headline", "text", overlay, "text", "contain", position=F.when(headed, "headline").otherwise("lower_third"),
                                     animation=F.when(beat == "hook", "typewriter").otherwise("slide_up"),
                                     metadata={"font_size": F.when(beat.isin("hook", "payoff"), "xl").otherwise("lg"), "max_lines": "2"})),
        F.when(F.size(words) > 0, _layer("emphasis_tags", "text", F.array_join(F.slice(words, 1, 4), ", "), "text_tags", "contain", 0.9,
                                         position=F.when(overlay != "", "badge").otherwise("lower_third"), animation="pop_scale")),
        _layer("subtitle_zone", "text", "subtitle", "reserved_zone", "contain", 0.0, position="subtitle", metadata={"purpose": "subtitle_safe_area"}),
        F.when(pacing != "hold_frame", _layer("camera_motion", "motion", camera, "camera", animation=camera, metadata={
            "motion_preset": motion, "speed": F.round(speed, 2), "intensity": F.round(x, 2), "parallax": beat.isin("hook", "reveal", "payoff")})),
    )))
    layers = F.slice(F.concat(*parts), 1, max_layers)
    return df.withColumn("layers", F.transform(layers, lambda layer, i: layer.withField("z_index", i)))


def simple_layers(df: DataFrame, default_query: str = "Logo") -> DataFrame:
    """Short layer list: picture, panel, headline, terms."""
    layout = F.col("layout_mode")
    layer = lambda n, k, s: F.struct(F.lit(n).alias("name"), F.lit(k).alias("type"), s.alias("source"))
    words = F.coalesce(F.col("emphasis_words"), F.array().cast("array<string>")) if "emphasis_words" in df.columns else F.array().cast("array<string>")
    overlay = F.coalesce(F.col("text_overlay"), F.lit("")) if "text_overlay" in df.columns else F.lit("")
    return df.withColumn("composition_layers", F.array_compact(F.array(
        layer("background_asset", "image", F.coalesce("query", F.lit(default_query))),
        F.when(layout.isin(*PANEL_LAYOUTS), layer("editorial_panel", "shape", layout)),
        F.when(overlay != "", layer("headline", "text", overlay)),
        F.when(F.size(words) > 0, layer("emphasis_terms", "text_tags", F.array_join(F.slice(words, 1, 4), ", "))))))
