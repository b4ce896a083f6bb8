"""Text columns: cleaning, quality, counting, chunking, numbers, script rules.

All functions return Column expressions (no Python per row).  ``unicode=False`` restricts
word classes to ASCII.  Folds over one text run as ``aggregate`` over its own parts: they
carry positions, not growing strings, and a text never leaves its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions.rules import contains_any, matches, rx, words

SENTENCE_END = r"(?<=[.!?])\s+"
EMPTY = "array<string>"


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once: a lambda variable, not a copied expression."""
    return F.get(F.transform(F.array(value), body), 0)


def norm_key(c: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(_s(c)), "[^a-z0-9]+", "")


def split_csv(c: Column) -> Column:
    return F.filter(F.transform(F.split(_s(c), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(_s(c), r"\s+"), lambda w: w != "")


def squeeze(c: Column) -> Column:
    # a single space stays as it is, so that only other white space is a match to replace
    return F.trim(F.regexp_replace(_s(c), r"\s{2,}|[^\S ]", " "))


def sentences(c: Column) -> Column:
    # squeezed text has single spaces only: the cut looks back from a space, not at every character
    return F.filter(F.split(squeeze(c), r" (?<=[.!?] )"), lambda x: x != "")


def clean_prompt(c: Column, max_len: int = 260) -> Column:
    """Whitespace squeezed, cut to ``max_len``, trailing separators removed."""
    return F.regexp_replace(F.substring(squeeze(c), 1, max_len), r"[ ,.;]+$", "")


# ---- F2 - F5 -----------------------------------------------------------------------------

def clean_text(c: Column, unicode: bool = True) -> Column:
    """Odd characters dropped, repeated end marks reduced."""
    word = rx(r"[^\w\s.,!?-]", unicode).replace("(?i)", "") if not unicode else r"(?U)[^\w\s.,!?-]"
    out = F.regexp_replace(_s(c), r"\s+", " ")
    for pattern, repl in ((word, ""), (r"\.{2,}", "..."), (r"!{2,}", "!"), (r"\?{2,}", "?")):
        out = F.regexp_replace(out, pattern, repl)
    return F.trim(out)


def first_name_in(c: Column, names: Sequence[str], default: str = "unknown") -> Column:
    low = F.lower(_s(c))
    return F.coalesce(*[F.when(low.contains(n.lower()), F.lit(n)) for n in names], F.lit(default))


def speech_type(c: Column) -> Column:
    t = _s(c)
    return F.when(t.startswith("...") | t.endswith("..."), "thought").when(F.size(tokens(t)) > 20, "narration").otherwise("dialogue")


def dialogue_line(who: Column, c: Column) -> Column:
    return F.concat(who, F.lit(": "), c)


# ---- F6, F8: text quality --------------------------------------------------------------------
# fixed values: lines with one of these are scan credits

CREDIT_PATTERNS = [r"\btcb\s*scans?\b", r"\btcbonepiecechapters\.com\b", r"\breall?cbscans\b", r"\bread on\b", r"\btwitter\b",
                   r"\bscanlation\b", r"\bmanga_light\b"]
MIN_USABLE = 0.45
ALLOWED_PUNCTUATION = ".,!?;:'\"-()[]{}&/% "


def strip_credit_lines(c: Column, patterns: Sequence[str] = CREDIT_PATTERNS) -> Column:
    parts = F.transform(F.split(_s(c), r"[\r\n]+|(?<=\.)\s{2,}"), squeeze)
    bad = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return squeeze(F.array_join(F.filter(parts, lambda x: (x != "") & ~x.rlike(bad)), " "))


def _longest_repeat(toks: Column) -> Column:
    """Most frequent token's count: longest run of equal neighbours in the sorted tokens.

    In sorted tokens a run is longer than ``n`` where a token equals the one ``n`` places before it,
    so the fold over places carries one number.
    """
    return let(F.sort_array(toks), lambda s: F.aggregate(
        F.sequence(F.lit(0), F.size(s) - 1), F.lit(0), lambda n, i: F.when(F.get(s, i) == F.get(s, i - n), n + 1).otherwise(n)))


def with_text_quality(df: DataFrame, text: str = "text", confidence: str | None = None,
                      patterns: Sequence[str] = CREDIT_PATTERNS, unicode: bool = True) -> DataFrame:
    """Adds clean_text, quality_score, quality_level, usable, counts and ratios."""
    # whole runs are dropped at once
    letters = r"\P{L}+" if unicode else "[^A-Za-z]+"
    keep = r"[\p{L}\p{N}\s.,!?;:'\"\-()\[\]{}&/% ]+" if unicode else r"[A-Za-z0-9\s.,!?;:'\"\-()\[\]{}&/% ]+"
    t, n = F.col("clean_text"), F.greatest(F.lit(1), F.col("char_count"))
    # one projection per step: each is read by several later expressions and stays evaluated once
    out = df.withColumn("clean_text", strip_credit_lines(F.col(text), patterns))
    out = out.withColumns({"_found": F.regexp_extract_all(t, F.lit(r"([A-Za-z][A-Za-z'\-]+)"), 1), "char_count": F.length(t)})
    out = out.withColumns({
        "_toks": F.filter(F.transform("_found", lambda w: F.btrim(F.lower(w), F.lit("'"))), lambda w: w != ""),
        "word_count": F.size("_found"), "_letters": F.length(F.array_join("_found", "")),
        "alpha_ratio": F.length(F.regexp_replace(t, letters, "")) / n, "garbage_ratio": F.length(F.regexp_replace(t, keep, "")) / n})
    out = out.withColumn("repeated_ratio", F.when(F.size("_toks") > 0, _longest_repeat(F.col("_toks")) / F.size("_toks")).otherwise(0.0))
    conf = F.lit(0.5) if confidence is None else F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence) / 100.0)), F.lit(0.5))
    a, g, many = F.col("alpha_ratio"), F.col("garbage_ratio"), F.col("word_count")
    out = out.withColumn("raw_score", (
        F.least(a / F.lit(0.72), F.lit(1.0)) * 0.25 + F.greatest(F.lit(0.0), F.lit(1.0) - g / F.lit(0.18)) * 0.20
        + F.least(many / F.lit(45.0), F.lit(1.0)) * 0.20 + F.greatest(F.lit(0.0), F.lit(1.0) - F.col("repeated_ratio") / F.lit(0.35)) * 0.15
        + F.greatest(F.lit(0.0), F.least(F.col("_letters") / F.greatest(F.lit(1), many) / F.lit(4.0), F.lit(1.0))) * 0.08 + conf * 0.12))
    s = F.col("raw_score")
    usable = (s >= MIN_USABLE) & (F.col("word_count") >= 8) & (F.col("garbage_ratio") < 0.22)
    return out.withColumns({
        "quality_score": F.round(s, 3), "usable": usable,
        "quality_level": F.when(usable & (s >= 0.72), "good").when(usable, "fair").otherwise("poor"),
        **{c: F.round(c, 3) for c in ("alpha_ratio", "garbage_ratio", "repeated_ratio")}}).drop("raw_score", "_found", "_toks", "_letters")


def quality_rollup(pages: DataFrame, doc: str = "doc_id", page: str = "page", clean: str = "clean_text") -> DataFrame:
    """Document verdict from its pages: mean score, level, usable pages, usable context length.

    The context length is that of "Page N: text" lines of usable pages joined by newlines; it
    is computed as a sum, so no document text is assembled to measure it.
    """
    used = F.col("usable") & (F.length(clean) > 0)
    part = F.length(F.concat(F.lit("Page "), F.col(page).cast("string"), F.lit(": "))) + F.length(clean)
    agg = pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("total_pages"), F.count_if("usable").alias("usable_pages"),
        # scores have three decimals: added as whole thousandths, the mean does not depend on the order
        (F.sum(F.round(F.col("quality_score") * 1000).cast("long")) / F.count(F.lit(1)) / 1000).alias("_avg"),
        F.sum(F.when(used, part + 1)).alias("_len"))
    length = F.greatest(F.lit(0), F.coalesce("_len", F.lit(0)) - 1)
    n = F.col("total_pages")
    return agg.select(
        doc, "total_pages", "usable_pages", F.round("_avg", 3).alias("score"), length.alias("context_chars"),
        F.when(F.col("_avg") >= 0.72, "good").when(F.col("_avg") >= MIN_USABLE, "fair").otherwise("poor").alias("level"),
        ((length >= 350) & (F.col("usable_pages") >= F.greatest(F.lit(2), F.floor(n / 5)))).alias("usable"))


def usable_context(usable: Column, text: Column) -> Column:
    """The text when it may be used as context, else null."""
    return F.when(usable & (F.length(F.trim(_s(text))) > 0), text)


def garbled_share(c: Column) -> Column:
    """1 minus the share of garbled tokens; 1.0 for no tokens."""
    t = tokens(c)
    bad = F.filter(t, lambda w: (F.length(w) > 20) | w.rlike(r"[^\x00-\x7F]{3,}") | w.rlike(r"[A-Za-z]{12,}\d|\d[A-Za-z]{12,}"))
    return F.when(F.size(t) == 0, 1.0).otherwise(F.lit(1.0) - F.size(bad) / F.size(t))


# ---- F9: first number --------------------------------------------------------------------------

def chapter_number(c: Column) -> Column:
    """First 3-5 digit number, preferring one named as a chapter."""
    t = _s(c)
    hits = [F.nullif(F.regexp_extract(t, "(?i)" + p, 1), F.lit("")) for p in
            (r"chapters?\s*[-_:]?\s*(\d{3,5})", r"\bch(?:apter)?\.?\s*(\d{3,5})\b", r"\b(\d{3,5})\b")]
    return F.coalesce(*hits).cast("int")


def title_has_chapter(title: Column, n: Column) -> Column:
    """"chapter n" in the title, or n inside a range a-b."""
    t = F.regexp_replace(_s(title), r"\s+", " ")
    lone = F.exists(F.regexp_extract_all(t, F.lit(r"(?i)\bchapter\s+(\d+)\b"), 1), lambda x: F.ltrim(x, F.lit("0")) == n.cast("string"))
    pat = r"\b(\d{3,5})\s*[-–]\s*(\d{3,5})\b"
    spans = F.arrays_zip(F.regexp_extract_all(t, F.lit(pat), 1).alias("a"), F.regexp_extract_all(t, F.lit(pat), 2).alias("b"))
    return (_s(title) != "") & n.isNotNull() & (n != 0) & (lone | F.exists(spans, lambda x: (x["a"].cast("int") <= n) & (n <= x["b"].cast("int"))))


# ---- F10: numbers in words --------------------------------------------------------------------------
# fixed values

ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
        "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
NUMBER_WORDS = {**{w: i for i, w in enumerate(ONES)}, **{w: 10 * i for i, w in enumerate(TENS) if w}}


def int_to_words(n: Column) -> Column:
    """English words below 100,000 (also negative); other numbers stay digits."""
    ones, tens = F.array(*[F.lit(w) for w in ONES]), F.array(*[F.lit(w) for w in TENS])
    at = lambda arr, i: F.get(arr, i.cast("int"))
    div = lambda x, d: F.floor(x / d).cast("long")

    def below_100(x):
        two = F.when(x % 10 == 0, at(tens, div(x, 10))).otherwise(F.concat_ws(" ", at(tens, div(x, 10)), at(ones, x % 10)))
        return F.when(x < 20, at(ones, x)).otherwise(two)

    def below_1000(x):
        head = F.concat(at(ones, div(x, 100)), F.lit(" hundred"))
        return F.when(x < 100, below_100(x)).when(x % 100 == 0, head).otherwise(F.concat_ws(" ", head, below_100(x % 100)))

    m = F.abs(n.cast("long"))
    head = F.concat(below_1000(div(m, 1000)), F.lit(" thousand"))
    big = F.when(m % 1000 == 0, head).otherwise(F.concat_ws(" ", head, below_1000(m % 1000)))
    said = F.when(m < 1000, below_1000(m)).when(m < 100000, big).otherwise(m.cast("string"))
    return F.when(n < 0, F.concat(F.lit("minus "), said)).otherwise(said)


def words_to_int(c: Column) -> Column:
    """Number at the start of a text of number words; null when there is none."""
    known = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("cur"), F.lit(False).alias("saw"), F.lit(False).alias("end"))

    def step(acc, w):
        v = F.try_element_at(known, w)
        hundred, thousand = (w == "hundred") & acc["saw"], (w == "thousand") & acc["saw"]
        at_least = F.greatest(acc["cur"], F.lit(1))
        total = F.when(thousand, acc["total"] + at_least * 1000).otherwise(acc["total"])
        cur = F.when(v.isNotNull(), acc["cur"] + v).when(hundred, at_least * 100).when(thousand, F.lit(0)).otherwise(acc["cur"])
        stop = v.isNull() & ~hundred & ~thousand & (w != "and")
        move = lambda new, old: F.when(acc["end"], old).otherwise(new)
        return F.struct(move(total, acc["total"]).alias("total"), move(cur, acc["cur"]).alias("cur"),
                        (acc["saw"] | (v.isNotNull() & ~acc["end"])).alias("saw"), (acc["end"] | stop).alias("end"))

    return F.aggregate(F.regexp_extract_all(F.lower(_s(c)), F.lit("([a-z]+)"), 1), start, step,
                       lambda a: F.when(a["saw"], a["total"] + a["cur"]))


def digits_to_words(c: Column) -> Column:
    """Numbers inside a text written as words: the text is cut at numbers and joined again."""
    pat = r"\b\d{1,5}(?:,\d{3})*\b"
    t = _s(c)
    said = F.transform(F.regexp_extract_all(t, F.lit(f"({pat})"), 1), lambda x: int_to_words(F.regexp_replace(x, ",", "").cast("long")))
    return let(said, lambda words: F.array_join(F.transform(F.split(t, pat), lambda r, i: F.concat(r, F.coalesce(F.get(words, i), F.lit("")))), ""))


# ---- F11 - F15: script features -----------------------------------------------------------------------

def normalize_paragraphs(c: Column) -> Column:
    """Markdown and brackets removed; one long paragraph is cut into pairs of sentences."""
    t = F.regexp_replace(_s(c), r"\*{1,3}(.+?)\*{1,3}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"_{1,3}(.+?)_{1,3}", "$1"), r"\[.*?\]", "")
    paras = F.filter(F.transform(F.split(F.trim(F.regexp_replace(t, r"^\s+|\s+$", "")), r"\n\s*\n+"),
                                 lambda p: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(p, r"[ \t]+", " "), r"^\s+|\s+$", "")), r"\s*\n\s*", " ")),
                     lambda p: p != "")
    split = lambda p: F.filter(F.transform(F.split(F.coalesce(p, F.lit("")), SENTENCE_END), lambda x: F.trim(x)), lambda x: x != "")

    def pairs(ps):
        return let(split(F.get(ps, 0)), lambda sents: F.when(F.size(sents) > 3, F.transform(
            F.sequence(F.lit(0), F.floor((F.size(sents) - 1) / 2).cast("int")), lambda i: F.array_join(F.slice(sents, i * 2 + 1, F.lit(2)), " "))).otherwise(ps))

    return let(paras, lambda ps: F.array_join(F.when((F.size(ps) == 1) & (word_count(F.get(ps, 0)) > 140), pairs(ps)).otherwise(ps), "\n\n"))


def word_count(c: Column, unicode: bool = True) -> Column:
    return F.regexp_count(_s(c), F.lit(r"(?U)[\w'-]+" if unicode else r"[A-Za-z0-9_'-]+"))


def first_sentence(c: Column) -> Column:
    return F.trim(F.coalesce(F.get(F.split(squeeze(c), r"(?<=[.!?।])\s+", 2), 0), F.lit("")))


def opening_text(c: Column, n: int = 35) -> Column:
    return F.array_join(F.slice(tokens(c), 1, n), " ")


# fixed values
STOPWORDS = ["about", "after", "again", "all", "and", "anime", "are", "because", "before", "but", "can", "chapter", "does", "dont",
             "every", "for", "from", "has", "hidden", "how", "into", "its", "just", "like", "manga", "more", "never", "nobody", "not",
             "oda", "one", "piece", "real", "revealed", "secret", "that", "the", "theory", "this", "truth", "was", "what", "when",
             "where", "why", "with", "you", "your"]
CTA_PHRASES = ["follow", "comment", "tell me", "prove me", "drop your", "subscribe", "like this", "check out", "hit follow", "smash",
               "notification"]
QUESTION_STARTS = ["what", "why", "how", "who", "when", "where", "is", "are", "was", "were", "can", "could", "would", "did", "do"]
SPOKEN = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
          "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty",
          "seventy", "eighty", "ninety", "hundred", "thousand"]
SPOKEN_NUMBER = "(?:" + "|".join(SPOKEN) + r")(?:[\s-]+(?:" + "|".join([*SPOKEN, "and"]) + ")){0,5}"
HOLLOW = [r"one\s+\w+,\s+one\s+\w+,\s+and\s+one\s+\w+", r"the scene looks simple(?: at first)?(?:,)? but oda hides",
          "behind the curtain", r"not random(?:\s+\w+)?(?:,)? it was setup", "my payoff is simple"]
HEDGING = ["i think maybe", "maybe", "it feels like", "i'm starting to think", "what if"]
SYNONYMS = {"mariejois": "mary geoise", "mary": "mary geoise", "geoise": "mary geoise", "nika": "sun god", "imu": "im-sama",
            "joyboy": "joy boy", "gorosei": "five elders", "revolutionaries": "revolutionary army", "straw": "straw hat", "hats": "straw hat"}


def keywords(c: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    found = F.regexp_extract_all(F.lower(_s(c)), F.lit(r"([a-z][a-z']{2,})"), 1)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in stopwords]))


def normalized_keywords(c: Column, stopwords: Sequence[str] = STOPWORDS, synonyms: dict[str, str] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (synonyms or SYNONYMS).items() for x in kv])
    return F.array_distinct(F.transform(keywords(c, stopwords), lambda w: F.coalesce(F.try_element_at(table, w), w)))


def named_entity_count(c: Column, entities: Sequence[str], unicode: bool = True) -> Column:
    found = F.regexp_extract_all(_s(c), F.lit(rx(words(*entities), unicode)), 1)
    return F.size(F.array_distinct(F.transform(found, F.lower)))


def chapter_numbers(c: Column) -> Column:
    """Chapter numbers in digits or words, in order."""
    raw = F.regexp_extract_all(_s(c), F.lit(rf"(?i)\bchapter\s+(\d+|{SPOKEN_NUMBER})\b"), 1)
    value = lambda x: F.coalesce(x.try_cast("long"), words_to_int(x).cast("long"))
    return F.filter(F.transform(raw, value), lambda x: x.isNotNull())


def is_question_hook(c: Column) -> Column:
    return matches(_s(c), r"^\s*(" + "|".join(QUESTION_STARTS) + r")\b", False) & F.trim(_s(c)).endswith("?")


def has_declarative_payoff(c: Column, cta: Sequence[str] = CTA_PHRASES, unicode: bool = True) -> Column:
    """One of the last four sentences without a call to action is a statement of eight words or more."""
    meaningful = F.filter(sentences(c), lambda s: ~contains_any(F.lower(s), cta))
    last = let(meaningful, lambda m: F.slice(m, F.greatest(F.lit(1), F.size(m) - 3), F.lit(4)))
    return F.exists(last, lambda s: ~s.endswith("?") & (word_count(s, unicode) >= 8))


def is_generic_topic(c: Column, phrases: Sequence[str] = ("generate a", "narration script", "30-60 second", "script in hindi",
                                                           "script in english", "enter your script", "your script text here")) -> Column:
    t = F.replace(F.lower(F.trim(_s(c))), F.lit("–"), F.lit("-"))
    return (t == "") | contains_any(t, phrases)


def resolve_topic(topic: Column, has_context: Column, chapter: Column, fallback: Column, series: str = "Manga",
                  phrases: Sequence[str] | None = None) -> Column:
    """Explicit topic, else one from the context, else the fallback."""
    generic = is_generic_topic(topic, phrases) if phrases else is_generic_topic(topic)
    from_context = F.when(chapter.isNotNull() & (chapter != 0), F.concat(F.lit(f"{series} Chapter "), chapter.cast("string"), F.lit(" theory"))).otherwise(
        F.lit("Latest manga chapter theory"))
    return F.when(~generic, F.trim(topic)).when(has_context, from_context).otherwise(fallback)


def is_hindi(language: Column) -> Column:
    return F.lower(F.trim(F.coalesce(language, F.lit("english")))).isin("hindi", "hi", "hinglish")


# ---- F16: script rules ------------------------------------------------------------------------------------

WORD_RANGES = {"short_vertical": (75, 110), "long_youtube": (700, 1050)}


def normalize_profile(c: Column) -> Column:
    t = F.lower(F.trim(_s(c)))
    return F.when(t == "long_youtube", t).otherwise("short_vertical")


def validate_script(df: DataFrame, anchors: Sequence[str], entities: Sequence[str], banned_hook: str = r"$^", profile: str = "short_vertical",
                    sections: Sequence[str] = ("title", "script", "description", "hashtags"), chapter: Column | None = None,
                    topic: Column | None = None, unicode: bool = True) -> DataFrame:
    """Adds ``errors`` and ``warnings`` (arrays of rule names) and ``ok`` to rows of script sections."""
    low, high = WORD_RANGES[profile]
    s = _s(F.col("script"))
    feats = {"_n": word_count(s, unicode), "_hook": first_sentence(s), "_open": opening_text(s),
             "_ents": named_entity_count(s, entities, unicode), "_title": normalized_keywords(F.col("title")), "_terms": normalized_keywords(s)}
    out = df.withColumns(feats)
    has = F.trim(s) != ""
    n, hook, ents = F.col("_n"), F.col("_hook"), F.col("_ents")
    anchored = matches(F.col("_open"), words(*anchors, rf"chapter\s+(?:\d+|{SPOKEN_NUMBER})", rf"episode\s+(?:\d+|{SPOKEN_NUMBER})",
                                             "sbs", rf"volume\s+(?:\d+|{SPOKEN_NUMBER})", "arc"), unicode)
    errors = [(F.trim(_s(F.col(c))) == "", f"missing_{c}") for c in sections]
    errors += [
        (has & (n > high), "too_long"), (has & (n < low), "too_short"), (has & matches(hook, banned_hook, unicode), "banned_hook"),
        (has & (is_question_hook(hook) | hook.endswith("?")), "question_hook"), (has & ~anchored, "no_anchor"),
        (has & (ents < 2), "few_entities"), (has & matches(s, words(*HOLLOW), unicode), "hollow"),
        (has & ~has_declarative_payoff(s, unicode=unicode), "no_payoff"),
    ]
    if chapter is not None:
        errors.append((has & chapter.isNotNull() & (chapter != 0) & ~F.array_contains(chapter_numbers(F.col("_open")), chapter.cast("long")), "wrong_chapter"))
    warnings = [
        (has & (ents >= 2) & (ents < 4), "thin_entities"),
        (has & (F.size("_title") > 0) & ~F.arrays_overlap("_title", "_terms"), "title_off_subject"),
        (has & matches(s, words(*HEDGING), unicode), "hedging"),
    ]
    if topic is not None:
        mine, theirs = chapter_numbers(s), chapter_numbers(topic)
        warnings.append((has & (F.size(mine) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(mine, theirs), "topic_chapter_mismatch"))
    pack = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules]))
    out = out.withColumns({"errors": pack(errors), "warnings": pack(warnings)})
    return out.withColumn("ok", F.size("errors") == 0).drop(*feats)


# ---- F1, F17, F27, F28: chunking ---------------------------------------------------------------------------

def segment_script(c: Column, min_words: int = 7, max_words: int = 16) -> Column:
    """Sentences packed into units of about ``min_words`` to ``max_words``; a short tail joins the last one."""
    min_words = max(1, min_words)
    max_words = max(min_words, max_words)
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("n"))

    def step(acc, i, w):
        flush = (acc["n"] >= min_words) & (acc["n"] + w > max_words) & (acc["n"] > 0)
        ends = F.when(flush, F.array_append(acc["ends"], i)).otherwise(acc["ends"])
        n = F.when(flush, F.lit(0)).otherwise(acc["n"]) + w
        full = n >= max_words
        return F.struct(F.when(full, F.array_append(ends, i + 1)).otherwise(ends).alias("ends"), F.when(full, F.lit(0)).otherwise(n).alias("n"))

    def finish(acc, total):
        ends = acc["ends"]
        tail = F.coalesce(F.element_at(ends, F.when(F.size(ends) > 0, -1)), F.lit(0)) < total
        join_last = tail & (F.size(ends) > 0) & (acc["n"] < min_words)
        return F.when(join_last, F.array_append(F.slice(ends, F.lit(1), F.size(ends) - 1), total)).when(
            tail, F.array_append(ends, total)).otherwise(ends)

    def packed(parts):
        sizes = F.transform(parts, lambda s, i: F.struct(i.alias("i"), F.regexp_count(s, F.lit(r"\S+")).alias("w")))
        ends = F.aggregate(sizes, start, lambda acc, x: step(acc, x["i"], x["w"]), lambda acc: finish(acc, F.size(parts)))
        return let(ends, lambda e: _cut(parts, e))

    return let(sentences(c), lambda parts: F.when(F.size(parts) > 0, packed(parts)).otherwise(F.array().cast(EMPTY)))


def _cut(parts: Column, ends: Column, sep: str = " ") -> Column:
    return F.transform(ends, lambda e, i: F.array_join(F.slice(
        parts, F.when(i > 0, F.get(ends, i - 1)).otherwise(0) + 1, e - F.when(i > 0, F.get(ends, i - 1)).otherwise(0)), sep))


def chunk_sentences(c: Column, chunk_size: int = 500, overlap_sentences: int = 50) -> Column:
    """Sentence chunks of about ``chunk_size`` characters; each starts with the last
    ``overlap_sentences`` pieces of the one before (the repeated text counts as one piece).

    A chunk is a run of sentences, so the fold carries where it starts, its pieces and lengths, and
    the texts are joined once at the end.
    """
    zero = F.lit(0)
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), zero.alias("a"), zero.alias("m"), zero.alias("n"), zero.alias("chars"), zero.alias("i"))

    def state(done, a, m, n, chars, i):
        return F.struct(done.alias("done"), a.alias("a"), m.alias("m"), n.alias("n"), chars.alias("chars"), (i + 1).alias("i"))

    def held(acc, parts):
        """First sentence that is repeated, and the characters from there on."""
        last = F.slice(parts, acc["i"] - overlap_sentences + 1, F.lit(overlap_sentences)) if overlap_sentences else F.array().cast(EMPTY)
        some = F.struct((acc["i"] - overlap_sentences).alias("a"), F.aggregate(last, F.lit(0), lambda t, s: t + F.length(s)).alias("chars"))
        return F.when(acc["m"] <= overlap_sentences, F.struct(acc["a"].alias("a"), acc["chars"].alias("chars"))).otherwise(some)

    def step(acc, s, parts):
        size, run = F.length(s), F.struct(acc["a"].alias("a"), acc["i"].alias("b"))
        flush = (acc["n"] + size > chunk_size) & (acc["m"] > 0)
        again = lambda h: state(F.array_append(acc["done"], run), h["a"], F.lit(2), h["chars"] + F.greatest(acc["i"] - h["a"] - 1, F.lit(0)) + size,
                                h["chars"] + size, acc["i"])
        return F.when(flush, let(held(acc, parts), again)).otherwise(state(acc["done"], acc["a"], acc["m"] + 1, acc["n"] + size, acc["chars"] + size, acc["i"]))

    def runs(parts):
        whole = lambda acc: F.when(acc["m"] > 0, F.array_append(acc["done"], F.struct(acc["a"].alias("a"), acc["i"].alias("b")))).otherwise(acc["done"])
        return F.aggregate(parts, start, lambda acc, s: step(acc, s, parts), whole)

    return let(F.split(_s(c), SENTENCE_END), lambda parts: let(runs(parts), lambda found: F.transform(
        found, lambda r: F.array_join(F.slice(parts, r["a"] + 1, r["b"] - r["a"]), " "))))


def _pack(parts: Column, limit: int, sep: int = 1) -> Column:
    """End positions of greedy groups whose joined length stays within ``limit`` (one part may exceed it)."""
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(acc, p):
        size = F.length(p)
        flush = (acc["n"] > 0) & (acc["n"] + sep + size > limit)
        return F.struct(F.when(flush, F.array_append(acc["ends"], acc["i"])).otherwise(acc["ends"]).alias("ends"),
                        F.when(flush | (acc["n"] == 0), size).otherwise(acc["n"] + sep + size).alias("n"), (acc["i"] + 1).alias("i"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["i"] > 0, F.array_append(a["ends"], a["i"])).otherwise(a["ends"]))


def tts_chunks(c: Column, max_chars: int = 250) -> Column:
    """Paragraphs, then sentences, then words packed into chunks of at most ``max_chars``."""
    paras = F.filter(F.transform(F.split(F.trim(F.regexp_replace(_s(c), r"^\s+|\s+$", "")), r"\n\s*\n+"), squeeze), lambda p: p != "")

    def pieces(p):
        # an overlong sentence is cut at words first and stays apart from its neighbours
        sents = F.filter(F.transform(F.split(p, r"(?<=[.!?।])\s+"), lambda x: F.trim(x)), lambda x: x != "")
        runs = F.aggregate(
            sents, F.struct(F.array().cast(EMPTY).alias("done"), F.lit("").alias("cur")),
            lambda a, s: F.when(F.length(s) > max_chars, F.struct(
                F.concat(a["done"], F.when(a["cur"] != "", F.array(a["cur"])).otherwise(F.array().cast(EMPTY)), let(tokens(s), lambda ws: let(_pack(ws, max_chars), lambda e: _cut(ws, e)))).alias("done"),
                F.lit("").alias("cur"))).when((a["cur"] != "") & (F.length(a["cur"]) + 1 + F.length(s) > max_chars), F.struct(
                    F.array_append(a["done"], a["cur"]).alias("done"), s.alias("cur"))).otherwise(F.struct(
                        a["done"].alias("done"), F.trim(F.concat(a["cur"], F.lit(" "), s)).alias("cur"))),
            lambda a: F.when(a["cur"] != "", F.array_append(a["done"], a["cur"])).otherwise(a["done"]))
        return F.when(F.length(p) <= max_chars, F.array(p)).otherwise(runs)

    return F.flatten(F.transform(paras, pieces))


def wrap_lines(c: Column, max_chars: int = 28, max_lines: int = 2, sep: str = "\\N") -> Column:
    """Greedy line wrap; lines beyond ``max_lines`` join the last one."""
    def shaped(lines):
        head = F.slice(lines, 1, max_lines - 1) if max_lines > 1 else F.array().cast(EMPTY)
        rest = F.array_join(F.slice(lines, F.lit(max_lines), F.greatest(F.lit(0), F.size(lines) - max_lines + 1)), " ")
        return F.array_join(F.when(F.size(lines) > max_lines, F.array_append(head, rest)).otherwise(lines), sep)

    return let(tokens(c), lambda t: let(let(_pack(t, max_chars), lambda e: _cut(t, e)), shaped))


# ---- F25, F29, W44: queries and keywords ----------------------------------------------------------------------

def dedupe_words(c: Column) -> Column:
    """First spelling of each word, case-insensitive."""
    def firsts(t):
        return let(F.transform(t, lambda w: F.lower(w)), lambda low: F.filter(t, lambda w, i: F.array_position(low, F.lower(w)) == i + 1))

    return F.array_join(let(tokens(c), firsts), " ")


GENERIC_PHRASES = r"\b(anime screenshot|manga panel|fan art|wallpaper|dramatic|cinematic|close up)\b"


def sanitize_query(query: Column, summary: Column, entities: Column, brand: Sequence[str] = (), fallback: str = "Logo",
                   generic: str = GENERIC_PHRASES, keep: Sequence[str] = (), places: Sequence[str] = ()) -> Column:
    """Search query without generic phrases, with the entities that the text mentions in front.

    ``brand`` words are left out, ``keep`` phrases and stand-alone ``places`` pass unchanged.
    """
    prefix = " ".join(w.title() for w in brand)
    parts = F.struct(F.trim(_s(query)).alias("raw"), _s(summary).alias("said"), entities.alias("ents"))

    def cleaned(p):
        q = squeeze(F.regexp_replace(F.regexp_replace(p["raw"], "(?i)" + generic, ""), r"[^A-Za-z0-9 .'-]", " "))
        return F.struct(p["raw"].alias("raw"), p["said"].alias("said"), p["ents"].alias("ents"), q.alias("q"))

    def anchored(p):
        both = F.lower(F.concat(p["q"], F.lit(" "), p["said"]))
        named = let(both, lambda low: F.slice(F.filter(p["ents"], lambda e: F.regexp_count(
            low, F.concat(F.lit(r"\b\Q"), F.lower(e), F.lit(r"\E\b"))) > 0), 1, 2))
        bare = F.array_join(F.filter(tokens(p["q"]), lambda w: ~F.lower(w).isin(*brand)), " ") if brand else p["q"]
        return F.struct(p["raw"].alias("raw"), p["said"].alias("said"), p["ents"].alias("ents"), p["q"].alias("q"), named.alias("named"), bare.alias("bare"))

    def chosen(p):
        raw, bare, named = p["raw"], p["bare"], p["named"]
        low, head = F.lower(bare), F.array_join(named, " ")
        missing = F.array_join(F.filter(named, lambda e: ~F.contains(low, F.lower(e))), " ")
        full = F.when((low == F.lower(head)) | low.startswith(F.concat(F.lower(head), F.lit(" "))), bare).otherwise(F.trim(F.concat(missing, F.lit(" "), bare)))
        lone = F.when(F.size(tokens(bare)) >= 2, bare).otherwise(F.trim(F.concat(F.lit(prefix + " "), bare)))
        anchor = F.lower(F.array_join(F.slice(p["ents"], 1, 2), " "))
        out = F
        for term in keep:
            out = out.when(F.lower(F.concat(raw, F.lit(" "), p["said"])).contains(term),
                           F.lit(fallback) if ("logo" in term or "outro" in term) else F.when(raw != "", raw).otherwise(fallback))
        if places:
            out = out.when(F.lower(raw).isin(*places), F.when(raw == F.lower(raw), F.initcap(raw)).otherwise(raw))
        words_ = F.when((anchor != "") & F.lower(p["q"]).startswith(anchor), p["q"]).when(F.size(named) > 0, full).otherwise(lone)
        out = out.when(bare != "", dedupe_words(words_)).when(F.size(named) > 0, head)
        return out.otherwise(F.lit(fallback))

    return let(let(let(parts, cleaned), anchored), chosen)


BOOST = r"^(\d{4}|\d{3,}|\d{1,3}(?:,\d{3})+|chapter\s*\d+|arc|final|saga|revealed?|truth)$"


def is_keyword_boost(word: Column, terms: Sequence[str] = (), boost: str = BOOST) -> Column:
    """Numbers and marked words, upper-case words, or capitalised words holding a known term."""
    return let(_bare_word(_s(word), r"(?U)[^\w\s'-]"), lambda w: _boosted(w, terms, boost))


def _boosted(w: Column, terms: Sequence[str], boost: str = BOOST) -> Column:
    """``is_keyword_boost`` of a bare word."""
    known = contains_any(F.lower(w), terms)
    return (w != "") & (w.rlike("(?i)" + boost) | ((F.length(w) > 2) & (F.upper(w) == w) & (F.lower(w) != w))
                        | ((F.length(w) > 3) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin("the", "and", "for", "with") & known))


def _bare_word(word: Column, odd: str) -> Column:
    """Word without ``odd`` characters; plain ASCII words have none and skip the Unicode classes."""
    return F.trim(F.when(word.rlike("[^A-Za-z0-9_'-]"), F.regexp_replace(word, odd, "")).otherwise(word))


KEYWORD_STOPWORDS = ["the", "and", "but", "for", "with", "that", "this", "into", "from", "because", "when", "then", "there", "their",
                     "they", "what", "why", "how", "was", "were", "are", "is", "his", "her", "him", "you"]  # fixed values


def keyword_score(word: Column, position: Column, total: Column, terms: Sequence[str] = ()) -> Column:
    def points(w):
        low = F.lower(w)
        sum_ = (F.lit(1) + F.when(_boosted(w, terms), 5).otherwise(0) + F.when(contains_any(low, terms), 5).otherwise(0)
                + F.when((F.length(w) > 3) & w.rlike(r"^\p{Lu}"), 3).otherwise(0) + F.when(F.length(w) >= 7, 2).otherwise(0)
                + F.when((position == 0) | (position == total - 1), 1).otherwise(0))
        return F.when((w == "") | low.isin(KEYWORD_STOPWORDS) | (F.length(low) <= 2), 0).otherwise(sum_)

    return let(_bare_word(_s(word), r"(?U)[^\w'-]"), points)


def phrase_keywords(words_array: Column, phrase_index: Column, terms: Sequence[str] = ()) -> Column:
    """Up to two best words of a phrase in order; every third phrase without any shows its longest word."""
    empty = F.array().cast(EMPTY)

    def chosen(ws):
        n = F.size(ws)
        scored = F.transform(ws, lambda w, i: F.struct((-keyword_score(w, i, n, terms)).alias("s"), i.alias("i"), w.alias("w")))
        best = F.slice(F.sort_array(F.filter(scored, lambda x: x["s"] < 0)), 1, 2)
        lengths = F.transform(ws, lambda w, i: F.struct(F.length(F.regexp_replace(w, r"(?U)\W+", "")).alias("n"), (-i).alias("i"), w.alias("w")))
        in_order = lambda b: F.transform(F.sort_array(F.transform(b, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))), lambda x: x["w"])
        return let(best, lambda b: F.when(n <= 0, empty).when(F.size(b) > 0, in_order(b)).when(
            phrase_index % 3 == 0, F.array(F.array_max(lengths)["w"])).otherwise(empty))

    return let(words_array, chosen)


# ---- F30: time codes ---------------------------------------------------------------------------------------------

def parse_time(c: Column) -> Column:
    """Seconds from H:MM:SS.cc, M:SS or a plain number; anything else is 0."""
    t = F.trim(_s(c.cast("string")))
    p = F.split(t, ":")
    num, whole = (lambda i: F.get(p, i).try_cast("double")), (lambda i: F.get(p, i).try_cast("int"))
    three = whole(0) * 3600 + whole(1) * 60 + num(2)
    two = whole(0) * 60 + num(1)
    return F.coalesce(F.when(F.size(p) == 3, three).when(F.size(p) == 2, two).when(F.size(p) == 1, num(0)), F.lit(0.0))


def format_time(seconds: Column) -> Column:
    """H:MM:SS.cc"""
    whole = F.floor(seconds)
    return F.concat(F.floor(seconds / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(whole / 60) % 60).cast("string"), 2, "0"), F.lit(":"),
                    F.format_string("%05.2f", seconds - F.floor(seconds / 60) * 60))


def char_sum_pick(label: Column, index: Column, positions: Sequence[str]) -> Column:
    """Position chosen by the sum of character codes plus the index."""
    total = F.aggregate(F.filter(F.split(_s(label), ""), lambda ch: ch != ""), F.lit(0), lambda a, ch: a + F.ascii(ch))
    return F.get(F.array(*[F.lit(p) for p in positions]), ((total + index) % len(positions)).cast("int"))


def relation_rows(df: DataFrame, entities: str, text: Column, rules, unicode: bool = True) -> DataFrame:
    """First entity paired with the next two (of at most four), typed by the first rule that fires."""
    from storyspark.functions.rules import first_match

    four = F.slice(F.col(entities), 1, 4)
    return df.withColumns({"_e": four, "relationship": first_match(text, rules, "associated_with", unicode)}).filter(F.size("_e") >= 2).select(
        *df.columns, F.get("_e", 0).alias("source"), F.explode(F.slice("_e", 2, 2)).alias("target"), "relationship",
        clean_prompt(text, 110).alias("evidence"))


def leading_text(df: DataFrame, limit: int = 3000, text: str = "text", key: str = "script_id", order: str = "idx", block_rows: int | None = None) -> DataFrame:
    """First ``limit`` characters of all lines of a key joined in order.

    A running length decides which lines can matter, so only those few are brought together.
    """
    from storyspark.operators.intervals import joined_text
    from storyspark.operators.ordered import Blocks

    b = Blocks.dense(df, key, order, block_rows).scan(running={"_at": ("sum", F.length(_s(F.col(text))) + 1, "before")})
    near = b.df.filter(F.coalesce("_at", F.lit(0)) < limit)
    return near.groupBy(key).agg(F.substring(joined_text(F.col(order), _s(F.col(text))), 1, limit).alias("context"))
