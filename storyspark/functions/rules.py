"""Two rule helpers (first match, summed scores) and the rule tables that use them.

A rule set is plain data, compiled to one ``CASE WHEN`` / sum expression that Catalyst
plans with the scan.  Callers may pass their own rules for another domain.

``unicode=True`` makes word characters and boundaries follow Unicode; turn it off where
plain ASCII classes are wanted.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str, unicode: bool = True) -> str:
    return ("(?iU)" if unicode else "(?i)") + _first_letters(pattern) + pattern


def _first_letters(pattern: str) -> str:
    """Look-ahead for the letters that a list of ``words`` begins with; nothing for other patterns.

    It holds wherever the list does, and is a far cheaper test at every other character than a word boundary.
    """
    inner = re.fullmatch(r"\\b\(([^()\[\]]+)\)\\b", pattern)
    terms = inner.group(1).split("|") if inner else []
    plain = [re.match(r"[A-Za-z0-9](?![?*{])", t) for t in terms]
    return "(?=[" + "".join(sorted({m.group(0).lower() for m in plain})) + "])" if plain and all(plain) else ""


def words(*terms: str) -> str:
    return r"\b(" + "|".join(terms) + r")\b"


def matches(text: Column, pattern: str, unicode: bool = True) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rx(pattern, unicode))


def first_match(text: Column, rules: Sequence[tuple[str, object]], default: object = None, unicode: bool = True) -> Column:
    """Value of the first rule (pattern, value) whose pattern is found."""
    out = F
    for pattern, value in rules:
        out = out.when(matches(text, pattern, unicode), F.lit(value))
    return out.otherwise(F.lit(default)) if rules else F.lit(default)


def score_rules(labels: Sequence[str], base: float, parts: Sequence[tuple[str, Column, float | Column, str]]) -> tuple[dict, dict]:
    """Per label: clipped, rounded score and the reasons that fired.

    ``parts`` are (label, condition, weight, reason); weights add to ``base``.
    """
    scores, reasons = {}, {}
    for label in labels:
        mine = [p for p in parts if p[0] == label]
        total = F.lit(base)
        for _, cond, weight, _ in mine:
            total = total + F.when(cond, weight if isinstance(weight, Column) else F.lit(weight)).otherwise(0.0)
        scores[label] = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2)
        reasons[label] = F.array_compact(F.array(*[F.when(c, F.lit(r)) for _, c, _, r in mine])) if mine \
            else F.array().cast("array<string>")
    return scores, reasons


def best_label(scores: dict[str, Column], priority: Column | Sequence[str]) -> Column:
    """struct(score, label): highest score, ties by place in the priority list."""
    order = priority if isinstance(priority, Column) else F.array(*[F.lit(p) for p in priority])
    ranked = F.array_max(F.array(*[
        F.struct(s.alias("score"), (-F.array_position(order, F.lit(label))).alias("rank"), F.lit(label).alias("label"))
        for label, s in scores.items()]))
    return ranked


# ---- F18: story beats -------------------------------------------------------------------------
# fixed values

BEAT_TYPES = ["hook", "setup", "mystery", "contradiction", "evidence", "escalation", "reveal", "payoff", "warning", "cta"]
ESCALATION_WORDS = ["then", "even", "worse", "bigger", "more", "until", "suddenly", "stakes", "consequence", "now", "not only"]
BEAT_RULES = [
    ("hook", words("what if", "why", "nobody", "most fans", "hidden truth", "secret truth", "this changes everything", "you missed"), 0.34, "hook phrase"),
    ("hook", r"\b(chapter|episode)\s+\w+", 0.12, "canon opener"),
    ("setup", words("starts?", "begins?", "first", "before", "context", "inside", "at the start", "sets up"), 0.28, "setup phrase"),
    ("mystery", words("mystery", "secret", "hidden", "clue", "unknown", "missing", "impossible", "question", "why", "nobody knows"), 0.34, "mystery signal"),
    ("contradiction", words("but", "however", "yet", "unlike", "instead", "opposite", "contradiction", "doesn'?t fit", "should not"), 0.34, "contrast signal"),
    ("evidence", words("chapter", "episode", "panel", "scene", "canon", "shows?", "says?", "proves?", "because", "arc", "page", "flashback"), 0.34, "evidence signal"),
    ("escalation", words(*ESCALATION_WORDS), 0.28, "escalation signal"),
    ("reveal", words("reveal", "truth", "actually", "real reason", "turns out", "we realize", "means", "the answer", "that is why"), 0.36, "reveal signal"),
    ("payoff", words("payoff", "this means", "therefore", "so the point", "takeaway", "changes everything", "in the end", "finally"), 0.36, "payoff signal"),
    ("warning", words("warning", "danger", "threat", "careful", "unless", "risk", "terrifying", "doomed", "if this is true", "bad news"), 0.34, "warning signal"),
    ("cta", words("follow", "subscribe", "comment", "tell me", "share", "what do you think", "prove me wrong", "like and subscribe"), 0.52, "CTA phrase"),
]
CONTRAST = r"\bnot\b.{0,45}\bbut\b|\bbut\b.{0,45}\bactually\b"
OPENING_PRIORITY = ["hook", "mystery", "contradiction", "setup", "evidence", "warning", "reveal", "escalation", "payoff", "cta"]
CLOSING_PRIORITY = ["cta", "payoff", "warning", "reveal", "escalation", "evidence", "contradiction", "mystery", "setup", "hook"]
MIDDLE_PRIORITY = ["reveal", "contradiction", "evidence", "mystery", "escalation", "warning", "payoff", "setup", "hook", "cta"]


def beat_columns(text: Column, index: Column, total: Column, rules: Sequence[tuple] = BEAT_RULES,
                 escalation: Sequence[str] = ESCALATION_WORDS, unicode: bool = True) -> dict[str, Column]:
    """beat_type, confidence, per-type scores and the winning type's signals."""
    p = F.when(total > 1, index / F.greatest(F.lit(1), total - 1))
    alone, many = total <= 1, total > 1
    inside = lambda lo, hi: many & (p >= lo) & (p <= hi)
    parts = [
        ("hook", alone, 0.18, "single-segment opening"), ("payoff", alone, 0.12, "single-segment close"),
        ("hook", many & (index == 0), 0.34, "opening segment"),
        ("setup", inside(0.05, 0.35), 0.18, "early setup position"),
        ("evidence", inside(0.20, 0.70), 0.12, "middle evidence position"),
        ("escalation", inside(0.35, 0.78), 0.10, "middle escalation position"),
        ("reveal", inside(0.55, 0.88), 0.13, "late reveal position"),
        ("payoff", many & (p >= 0.70), 0.15, "closing payoff position"),
        ("warning", many & (p >= 0.70), 0.08, "late warning position"),
        ("cta", many & (index == total - 1), 0.22, "final segment"),
    ]
    parts += [(label, matches(text, pattern, unicode), w, why) for label, pattern, w, why in rules]
    asks = F.coalesce(text, F.lit("")).contains("?")
    many_terms = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rx(words(*escalation), unicode))) >= 2
    parts += [
        ("contradiction", matches(text, CONTRAST, unicode), 0.22, "not/but or but/actually contrast"),
        ("mystery", asks, 0.16, "question mark"), ("hook", asks & (index == 0), 0.18, "opening question"),
        ("escalation", many_terms, 0.14, "multiple escalation signals"),
    ]
    parts = [(a, F.coalesce(c, F.lit(False)), w, r) for a, c, w, r in parts]
    scores, reasons = score_rules(BEAT_TYPES, 0.04, parts)
    lists = [F.array(*[F.lit(x) for x in names]) for names in (OPENING_PRIORITY, CLOSING_PRIORITY, MIDDLE_PRIORITY)]
    priority = F.when(index == 0, lists[0]).when(index == total - 1, lists[1]).otherwise(lists[2])
    return _decided(scores, reasons, priority, "beat_type")


def _decided(scores, reasons, priority, name) -> dict[str, Column]:
    best = best_label(scores, priority)
    why = F.try_element_at(F.create_map(*[x for k, v in reasons.items() for x in (F.lit(k), v)]), best["label"])
    return {name: best["label"], "confidence": best["score"],
            "confidence_scores": F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), v)]), "matched_signals": why}


# ---- F19: visual intents -----------------------------------------------------------------------
# fixed values

INTENTS = ["DREAM", "FEAR", "WARNING", "MYSTERY", "CONTRADICTION", "EVIDENCE", "ESCALATION", "REVEAL", "PAYOFF", "CTA",
           "CHARACTER", "LOCATION", "SYMBOL"]
BEAT_PRIORS = {
    "hook": ("MYSTERY", 0.16, "hook curiosity prior"), "setup": ("CHARACTER", 0.10, "setup anchor prior"),
    "mystery": ("MYSTERY", 0.30, "story beat prior"), "contradiction": ("CONTRADICTION", 0.30, "story beat prior"),
    "evidence": ("EVIDENCE", 0.30, "story beat prior"), "escalation": ("ESCALATION", 0.30, "story beat prior"),
    "reveal": ("REVEAL", 0.30, "story beat prior"), "payoff": ("PAYOFF", 0.30, "story beat prior"),
    "warning": ("WARNING", 0.34, "story beat prior"), "cta": ("CTA", 0.40, "story beat prior"),
}
INTENT_RULES = [
    ("DREAM", words("dream", "dreams", "ambition", "promise", "future", "freedom", "pirate king", "goal", "hope"), 0.50, "dream/ambition language"),
    ("FEAR", words("fear", "afraid", "terrified", "weak", "helpless", "trauma", "panic", "haunted", "loss", "pain"), 0.52, "fear/vulnerability language"),
    ("WARNING", words("monster", "warning", "danger", "threat", "risk", "doomed", "bad news", "terrifying", "evil", "villain", "destroy"), 0.48, "warning/threat language"),
    ("MYSTERY", words("mystery", "secret", "hidden", "clue", "unknown", "question", "why", "impossible", "missing"), 0.36, "mystery language"),
    ("CONTRADICTION", words("but", "however", "yet", "unlike", "instead", "opposite", "contradiction", "doesn'?t fit", "should not"), 0.36, "contrast language"),
    ("EVIDENCE", words("evidence", "chapter", "episode", "panel", "scene", "canon", "proves?", "shows?", "because", "flashback"), 0.36, "proof/canon language"),
    ("ESCALATION", words("then", "even", "worse", "bigger", "stakes", "consequence", "until", "suddenly", "not only"), 0.34, "escalation language"),
    ("REVEAL", words("reveal", "truth", "actually", "turns out", "real reason", "we realize", "means", "answer"), 0.38, "reveal language"),
    ("PAYOFF", words("payoff", "this means", "therefore", "takeaway", "changes everything", "in the end", "finally"), 0.38, "payoff language"),
    ("CTA", words("follow", "subscribe", "comment", "tell me", "share", "what do you think", "prove me wrong"), 0.52, "CTA language"),
]
PLACES = ["elbaf", "wano", "egghead", "ohara", "jaya", "mary geoise", "marineford", "sabaody", "baratie", "island", "village", "kingdom", "room"]
SYMBOLS = ["nika", "joy boy", "poneglyph", "world government", "five elders", "flag", "logo", "throne", "crown", "fruit", "sword", "straw hat"]
INTENT_PRIORITY = {
    "warning": ["WARNING", "FEAR", "MYSTERY", "ESCALATION", "REVEAL", "EVIDENCE", "CONTRADICTION", "DREAM", "PAYOFF", "CTA", "CHARACTER", "LOCATION", "SYMBOL"],
    "cta": ["CTA", "PAYOFF", "WARNING", "DREAM", "CHARACTER", "LOCATION", "SYMBOL", "MYSTERY", "FEAR", "EVIDENCE", "REVEAL", "ESCALATION", "CONTRADICTION"],
    "": ["WARNING", "FEAR", "DREAM", "REVEAL", "MYSTERY", "CONTRADICTION", "EVIDENCE", "ESCALATION", "PAYOFF", "CTA", "SYMBOL", "LOCATION", "CHARACTER"],
}


def intent_columns(beat_type: Column, text: Column, entities: Column | None = None, rules: Sequence[tuple] = INTENT_RULES,
                   places: Sequence[str] = PLACES, symbols: Sequence[str] = SYMBOLS, unicode: bool = True) -> dict[str, Column]:
    """intent, confidence, per-intent scores and signals."""
    beat = F.lower(F.trim(F.coalesce(beat_type, F.lit(""))))
    named = entities if entities is not None else F.array().cast("array<string>")
    count = F.size(named)
    blob = F.trim(F.concat_ws(" ", F.nullif(F.coalesce(text, F.lit("")), F.lit("")), F.nullif(F.array_join(named, " "), F.lit(""))))
    parts = [(label, beat == b, w, why) for b, (label, w, why) in BEAT_PRIORS.items()]
    parts += [(label, matches(blob, pattern, unicode), w, why) for label, pattern, w, why in rules]
    parts += [
        ("CHARACTER", count > 0, F.least(F.lit(0.18), F.lit(0.06) * count), "named entities present"),
        ("LOCATION", matches(blob, words(*places), unicode), 0.22, "location/entity anchor"),
        ("SYMBOL", matches(blob, words(*symbols), unicode), 0.20, "symbol/object anchor"),
    ]
    scores, reasons = score_rules(INTENTS, 0.03, parts)
    lists = {k: F.array(*[F.lit(x) for x in v]) for k, v in INTENT_PRIORITY.items()}
    priority = F.when(beat == "warning", lists["warning"]).when(beat == "cta", lists["cta"]).otherwise(lists[""])
    return _decided(scores, reasons, priority, "intent")


# ---- F20: dominant emotion -------------------------------------------------------------------------
# fixed values: (pattern, label, valence shift, intensity boost)

EMOTION_RULES = [
    (words("death", "died", "kill", "murder", "pain", "sacrifice", "betrayal", "cry", "tears", "alone", "weak", "suffer"), "grief", -0.55, 0.20),
    (words("danger", "threat", "villain", "war", "fight", "destroy", "monster", "evil", "terror", "dread", "doom"), "tension", -0.35, 0.15),
    (words("secret", "hidden", "truth", "mystery", "impossible", "twist", "clue", "unknown", "why"), "intrigue", -0.05, 0.12),
    (words("dream", "freedom", "joy", "hope", "promise", "future", "win", "victory", "dawn", "liberation"), "hope", 0.45, 0.10),
    (words("fear", "afraid", "terrified", "helpless", "panic", "haunted", "trauma"), "fear", -0.50, 0.18),
    (words("rage", "fury", "furious", "anger", "wrath", "vengeance"), "rage", -0.30, 0.22),
    (words("love", "bond", "protect", "save", "friend", "family", "brother", "crew", "nakama"), "bond", 0.35, 0.08),
    (words("shock", "impossible", "unbelievable", "no way", "can't be"), "shock", -0.10, 0.25),
    (words("reveal", "truth", "actually", "turns out", "real reason", "the answer"), "revelation", 0.15, 0.18),
]


def detect_emotion(text: Column, rules: Sequence[tuple] = EMOTION_RULES, unicode: bool = True) -> Column:
    """struct(boost, rank, label, valence): highest boost, ties to the first rule; curious when
    nothing fires, neutral for an empty text."""
    row = lambda b, r, n, v: F.struct(F.lit(b).alias("boost"), F.lit(r).alias("rank"), F.lit(n).alias("label"), F.lit(v).alias("valence"))
    hits = [F.when(matches(text, p, unicode), row(boost, -i, label, shift)) for i, (p, label, shift, boost) in enumerate(rules)]
    best = F.array_max(F.array(row(0.0, 1, "curious", 0.0), *hits))
    return F.when(F.coalesce(text, F.lit("")) == "", row(0.0, 1, "neutral", 0.0)).otherwise(best)


# ---- F21, F31: first-match classifiers ------------------------------------------------------------------
# fixed values

STATE_RULES = [
    (words("death", "died", "pain", "fear", "trauma", "loss", "sacrifice", "betrayal", "cry", "alone", "weak"), "grief"),
    (words("danger", "threat", "villain", "war", "fight", "destroy", "monster", "evil"), "tension"),
    (words("secret", "hidden", "truth", "mystery", "impossible", "twist", "reveal"), "intrigue"),
    (words("dream", "freedom", "joy", "hope", "promise", "future", "win"), "hope"),
]
STATE_VALUES = {"grief": (-0.55, 0.78), "tension": (-0.35, 0.72), "intrigue": (0.1, 0.68), "hope": (0.45, 0.55),
                "resolution": (0.25, 0.28), "curious": (0.0, 0.35)}


def emotion_state(text: Column, beat_type: Column, index: Column, total: Column, unicode: bool = True) -> dict[str, Column]:
    label = F.coalesce(first_match(text, STATE_RULES, None, unicode), F.when(beat_type == "cta", "resolution"), F.lit("curious"))
    # the label is a look-up key, spelled once a column: a CASE over its values would find it anew for each
    value = lambda n: F.try_element_at(F.create_map(*[F.lit(x) for k, v in STATE_VALUES.items() for x in (k, v[n])]), label)
    strong = F.greatest(value(1), F.when(beat_type == "hook", 0.76).when(beat_type == "reveal", 0.82))
    return {"emotion": label, "emotion_intensity": strong, "valence": value(0),
            "curve_position": F.round(index / F.greatest(F.lit(1), total - 1), 2)}


PRODUCTION_BEAT_RULES = [
    (words("follow", "comment", "subscribe", "tell me", "like"), "cta"),
    (words("twist", "shocking", "but actually", "plot twist", "never expected", "impossible", "what if", "turns out"), "twist"),
    (words("escalat", "stronger", "even more", "worse", "intensif", "on top of that", "not only", "also", "furthermore"), "escalation"),
    # the published pattern has an unbalanced bracket and cannot run; these are its words
    (words("reveal", "truth", "secret", "hidden", "clue", "impossible", "danger", "real reason"), "reveal"),
    (words("answer", "resolution", "ending", "finally", "in the end", "closure", "conclusion", "that's why"), "resolution"),
    (r"\bpayoff|means|proves|changes|therefore|because|so this\b", "payoff"),
]


def production_beat(text: Column, index: Column, total: Column, unicode: bool = True) -> Column:
    return F.when(index == 0, "hook").when(index >= F.greatest(F.lit(0), total - 1), "cta").otherwise(
        F.coalesce(first_match(text, PRODUCTION_BEAT_RULES, None, unicode), F.when(index <= 2, "setup"), F.lit("evidence")))


ROLE_RULES = [
    (r"\b(vs\.?|versus|opposite|unlike|contrast|compared|both|difference)\b", "comparison"),
    (words("years?", "decades?", "century", "timeline", "chapter", "episode", "before", "after", "eventually", "first", "then", "finally"), "timeline"),
    (words("fruit", "sword", "weapon", "poneglyph", "flag", "logo", "symbol", "crown", "throne", "ship", "map", "scar", "chains?"), "object"),
    (words("jaya", "marineford", "elbaf", "wano", "egghead", "ohara", "mary geoise", "impel down", "sabaody", "baratie", "thriller bark", "island", "village", "kingdom", "room"), "location"),
    (words("world government", "five elders", "holy knights", "nika", "joy boy", "will of d", "straw hat", "pirate flag"), "symbol"),
    (r"\bchapter|episode|sbs|quote|said|says\b", "evidence"),
]
PROOF = words("proves", "evidence", "because", "therefore", "choice", "decision", "action", "behavior", "consequence", "betrayal", "sacrifice")


def visual_role(beat_type: Column, text: Column, unicode: bool = True) -> Column:
    t = F.coalesce(text, F.lit(""))
    quoted = t.contains('"') | (t.contains("'") & (F.length(t) < 140))
    return F.when(beat_type == "hook", "section_card").when(beat_type == "cta", "cta_card").otherwise(F.coalesce(
        first_match(t, ROLE_RULES, None, unicode), F.when(quoted, "quote_card"),
        F.when(matches(t, PROOF, unicode), "evidence"), F.lit("character")))


ASSET_TYPE_RULES = [
    (words("island", "village", "kingdom", "jaya", "baratie", "elbaf", "wano", "egghead", "ohara", "marineford", "sabaody"), "location"),
    (words("fruit", "sword", "knife", "ship", "map", "poneglyph", "throne", "chains?", "stairs?", "scar", "flag", "logo"), "object"),
    (words("world government", "nika", "joy boy", "jolly roger", "sun god", "void century"), "symbol"),
]


def asset_type(role: Column, query: Column, text: Column, unicode: bool = True) -> Column:
    fixed = role.isin("object", "symbol", "location", "comparison", "timeline")
    return F.when(fixed, role).otherwise(first_match(F.concat_ws(" ", query, text), ASSET_TYPE_RULES, "character", unicode))


EXPRESSION_RULES = [
    (words("shocking", "terrifying", "danger", "monster", "consume", "sacrifice", "warning", "evil"), "intense"),
    (words("question", "why", "how", "what if", "twist", "mystery", "reveal") + r"|\?", "surprised"),
    (words("fear", "weak", "terrified", "tragic", "alone", "sad", "cry", "vulnerable"), "worried"),
    (words("proves", "means", "truth", "because", "therefore", "clearly", "exactly"), "confident"),
    (words("hook", "payoff", "dream", "freedom", "ultimate", "final"), "excited"),
]


def expression_label(text: Column, index: Column, unicode: bool = True) -> Column:
    early = F.when(index >= 3, "serious").otherwise("excited")  # no rule is tried twice
    return first_match(text, [(p, early if label == "excited" else label) for p, label in EXPRESSION_RULES], "serious", unicode)


RELATION_RULES = [
    (r"\bvs\.?|versus|fight|defeat|humiliat|oppos", "opposes"),
    (r"\bcrew|protect|save|friend|ally|loyal", "allies_with"),
    (r"\btrain|teacher|student|mentor|learn", "mentor_link"),
    (r"\bfather|son|brother|family|lineage|inherited", "family_or_lineage"),
    (r"\bbetray|manipulat|use|exploit", "exploits"),
    (r"\bcontrast|unlike|opposite|mirror", "contrasts"),
]
NARRATION_SIGNALS = [
    (r"\bvs\.?|versus|fight|defeat|clash|oppos|kill|attack", "opposes"),
    (r"\bcrew|protect|save|friend|ally|loyal|trust|together|join", "allies_with"),
    (r"\brival|compete|surpass|stronger|challenge", "rivals"),
    (r"\btrain|teacher|student|mentor|learn|taught|inspire", "mentor_link"),
    (r"\bfather|son|brother|sister|family|lineage|inherit|blood|child|mother", "family_or_lineage"),
    (r"\bbetray|manipulat|use|exploit|trick|decei", "exploits"),
    (r"\bcontrast|unlike|opposite|mirror|foil|parallel", "contrasts"),
]

# simple containment classifiers
META_TERMS = ["oda", "eiichiro", "interview", "author", "creator", "weekly shonen", "shonen jump", "chapter 1", "chapter one",
              "manga panel", "panel", "screenshot", "flashback"]
BRANDING_TERMS = ["logo", "outro", "grand line map", "map", "subscribe", "follow"]
ARC_LOCATION_TERMS = ["egghead", "marineford", "wano", "thriller bark", "dressrosa", "elbaf", "laugh tale", "laughtale",
                      "whole cake", "enies lobby", "ohara", "sabaody", "impel down", "skypiea", "water 7", "reverie",
                      "mary geoise", "mariejois", "onigashima"]
SOURCE_ORDER = {
    "fandom_first": ["fandom", "oparchive", "cse"], "oparchive_first": ["oparchive", "fandom", "cse"],
    "branding": ["fandom", "cse", "oparchive"], "scene_panel": ["fandom", "oparchive", "cse"],
}


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.coalesce(text, F.lit("")).contains(t)
    return out


def count_terms(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(0)
    for t in terms:
        out = out + F.coalesce(text, F.lit("")).contains(t).cast("int")
    return out


def broll_intent(query: Column, summary: Column, entities: Column, names: Sequence[str] = (), branding=BRANDING_TERMS,
                 meta=META_TERMS, places=ARC_LOCATION_TERMS, unicode: bool = True) -> Column:
    """Which picture source to try first."""
    q, s = F.coalesce(query, F.lit("")), F.coalesce(summary, F.lit(""))
    blob = F.lower(F.concat_ws(" ", q, s, F.array_join(entities, " ")))
    hits = count_terms(blob, places)
    named = matches(blob, words(*names), unicode) if names else F.lit(False)
    many_words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) >= 3
    return (
        F.when(contains_any(blob, branding), "branding")
        .when(contains_any(blob, meta), "fandom_first")
        .when(contains_any(blob, [" arc", " war", " vs "]), "scene_panel")
        .when((hits >= 2) | ((hits > 0) & contains_any(blob, ["longer than", "compared"])), "scene_panel")
        .when(hits > 0, "oparchive_first")
        .when(F.size(entities) > 0, "oparchive_first")
        .when(named, "oparchive_first")
        .when(many_words, "scene_panel")
        .otherwise("oparchive_first"))


def source_order(intent: Column) -> Column:
    return F.coalesce(*[F.when(intent == k, F.array(*[F.lit(x) for x in v])) for k, v in SOURCE_ORDER.items()],
                      F.array(*[F.lit(x) for x in SOURCE_ORDER["oparchive_first"]]))


def simple_beat(text: Column, index: Column, total: Column, cta: Sequence[str], reveal: Sequence[str], payoff: Sequence[str],
                emotional: Sequence[str]) -> Column:
    """Beat by term lists, passed in by the caller."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(contains_any(t, cta) | (index >= F.greatest(F.lit(0), total - 1)), "cta").when(
        contains_any(t, reveal), "reveal").when(contains_any(t, [*payoff, *emotional]), "payoff").when(index == 0, "hook").otherwise("evidence")


SYMBOL_WORDS = ["logo", "outro", "subscribe", "follow", "grand line map", "map", "cta", "end card", "jolly roger", " jolly ", "flag",
                "pirates", " pirate", "crew", " fleet", "emblem"]
LOCATION_WORDS = ["island", "village", "town", "kingdom", "arc", "marineford", "ohara", "baratie", "harbor", "port"]


def asset_kind_intent(text: Column, places: Sequence[str] = (), symbol=SYMBOL_WORDS, location=LOCATION_WORDS) -> Column:
    """symbol, location or character still; ``places`` are known place names."""
    t = F.lower(F.coalesce(text, F.lit("")))
    goa = t.contains("kingdom") & t.contains("goa")
    return F.when(contains_any(t, symbol) | goa, "symbol").when(contains_any(t, [*places, *location]), "location").otherwise("character")


def word_style(word: Column, lexicons: dict[str, Sequence[str]]) -> Column:
    """First lexicon with a term inside the word, else proper_noun for a capitalised word, else other."""
    w = F.coalesce(word, F.lit(""))
    out = F
    for name, terms in lexicons.items():
        out = out.when(contains_any(F.lower(w), terms), name)
    return out.when(w.rlike(r"^[A-Z][a-z]+$") & (F.length(w) > 2), "proper_noun").otherwise("other")


# ---- F22, F23, F31 ----------------------------------------------------------------------------------------

INTENT_BY_BEAT = {"hook": "curiosity_gap", "setup": "context_setup", "evidence": "proof", "reveal": "reversal",
                  "payoff": "takeaway", "cta": "conversion"}  # fixed values


def intent_strength(beat_type: Column, purpose: Column) -> dict[str, Column]:
    strong = beat_type.isin("hook", "reveal", "payoff")
    x = F.lit(0.45) + F.when(strong, 0.18).otherwise(0.08) + F.when(F.coalesce(purpose, F.lit("")) != "", 0.10).otherwise(0.0)
    return {"primary_intent": F.coalesce(*[F.when(beat_type == k, F.lit(v)) for k, v in INTENT_BY_BEAT.items()], F.lit("support")),
            "intent_strength": F.round(F.least(F.lit(1.0), x), 2)}


PLACE_HINT = r"\bchapter|arc|island|village|bark|lobby|garden|elbaf|ohara|wano|marineford\b"


def asset_confidence(query: Column, text: Column, entities: Column, duplicates: Column | int = 0, hint: str = PLACE_HINT,
                     unicode: bool = True) -> Column:
    q = F.coalesce(query, F.lit(""))
    two = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) >= 2
    named = F.exists(entities, lambda e: F.contains(F.lower(q), F.lower(e)))
    dup = duplicates if isinstance(duplicates, Column) else F.lit(duplicates)
    x = F.lit(0.35) + F.when(two, 0.22).otherwise(0.0) + F.when(named, 0.20).otherwise(0.0) \
        + F.when(matches(F.concat_ws(" ", q, text), hint, unicode), 0.15).otherwise(0.0) - F.least(F.lit(0.20), dup * F.lit(0.08))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 2)
