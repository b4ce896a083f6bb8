"""File-based sources and sinks: catalogs, subtitle files, picture listings, model replies, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.functions.text import let, parse_time, squeeze, tokens
from storyspark.operators.ordered import number_rows
from storyspark.session import packed

ASSET_SCHEMA = ("id string, name string, category string, character string, arc string, emotion string, visual_type string, "
                "importance int, tags array<string>")
CATALOG_FILE_SCHEMA = f"source string, assets array<struct<{', '.join(f'{a}:{b}' for a, b in (x.strip().split(' ', 1) for x in ASSET_SCHEMA.split(',')))}>>"
CORPUS_FILE_SCHEMA = ("episode_info struct<episode_number:int, title:string>, file_name string, "
                      "subtitles array<struct<timestamp:string, text:string>>, _corrupt_record string")


# ---- S1: catalog ----------------------------------------------------------------------------

def load_catalog(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Assets of catalog JSON files; short rows get the defaults."""
    rows = spark.read.schema(CATALOG_FILE_SCHEMA).option("multiLine", True).json(path)
    a = rows.select(F.posexplode("assets").alias("pos", "a")).select("pos", "a.*").filter(F.coalesce("id", F.lit("")) != "")
    texts = ["name", "category", "character", "arc", "emotion", "visual_type"]
    a = a.withColumns({**{c: F.coalesce(c, F.lit("")) for c in texts}, "importance": F.coalesce("importance", F.lit(3)),
                       "tags": F.coalesce("tags", F.array().cast("array<string>"))})
    return a.filter(F.col("category") == category) if category else a


def find_asset(catalog: DataFrame, id: str) -> DataFrame:
    return catalog.filter(F.col("id") == id)


# ---- S2: subtitle corpus ---------------------------------------------------------------------------

def load_subtitle_corpus(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per subtitle line of a folder of nested JSON files; unreadable files are skipped.

    A file is one record, or one a line without ``multi_line``: such files are split between tasks, and only unreadable lines are skipped.
    """
    rows = spark.read.schema(CORPUS_FILE_SCHEMA).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    good = rows.filter(F.col("_corrupt_record").isNull() & F.col("subtitles").isNotNull())
    return good.select(F.col("episode_info.episode_number").alias("episode_number"), F.col("episode_info.title").alias("title"), "file_name",
                       F.posexplode("subtitles").alias("line_no", "s")).select("episode_number", "title", "file_name", "line_no", "s.timestamp", "s.text")


def unreadable_corpus_files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CORPUS_FILE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    # Spark wants one more column next to the corrupt record; it is null for such files anyway
    return rows.filter(F.col("_corrupt_record").isNotNull() & F.col("file_name").isNull()).select(F.input_file_name().alias("path"), "_corrupt_record")


# ---- S3: subtitle events ---------------------------------------------------------------------------------

#: Between the subtitle files of a bundle.
BUNDLE_MARK = "\x1e\x1d\x1e"


def read_event_lines(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Lines of subtitle files with file path and position in the file.

    Spark splits text files, so the position of a line is its place in the whole file, taken
    file by file in one multi-line read; a subtitle file is small.  Hundreds of thousands of them
    come ``bundled``: a text file then holds many, each with its name in a line before it and
    BUNDLE_MARK after it.
    """
    if bundled:
        files = spark.read.text(path, lineSep=BUNDLE_MARK)
        name = F.substring_index("value", "\n", 1)
        files = files.select(name.alias("file"), F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)").alias("value"))
    else:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "value"))


def write_event_bundles(files: DataFrame, path: str) -> None:
    """Subtitle files (``file``: a name without line breaks, ``value``: the whole text) as a few text files."""
    files.select(F.concat("file", F.lit("\n"), "value").alias("value")).write.option("lineSep", BUNDLE_MARK).text(path)


def subtitle_text(c: Column) -> Column:
    """Override tags and backslash commands removed."""
    out = F.regexp_replace(c, r"\{.*?\}", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\\[nNh]", " "), r"\\[^ ]*", "")
    return squeeze(out)


def parse_events(lines: DataFrame, need_section: bool = True, file: str = "file") -> DataFrame:
    """Subtitle rows: storyboard comments, if a file has any, replace its dialogue.

    ``need_section`` takes lines only after [Events] and drops empty texts; without it every
    dialogue line counts and empty texts stay.
    """
    value = F.trim(F.regexp_replace("value", "^﻿", ""))
    low = F.lower(value)
    part = F.split(value, ",", 10)
    p = lines.withColumns({"_p": part, "_low": low})
    if need_section:
        head = p.filter(F.col("_low") == "[events]").groupBy(file).agg(F.min("line_no").alias("_head"))
        p = p.join(head, file).filter(F.col("line_no") > F.col("_head")).drop("_head")
    p = p.filter(F.startswith("_low", F.lit("dialogue:")) | F.startswith("_low", F.lit("comment:"))).filter(F.size("_p") >= 10)
    style, kind = F.lower(F.trim(F.get("_p", 3))), F.trim(F.get(F.split("_low", ":"), 0))
    p = p.withColumns({"story": (kind == "comment"), "_style": style})
    p = p.filter((F.col("story") & (F.col("_style") == "storyboard")) | (~F.col("story") & (F.col("_style") != "storyboard")))
    rows = p.select(file, "line_no", "story", F.trim(F.get("_p", 1)).alias("start"), F.trim(F.get("_p", 2)).alias("end"),
                    subtitle_text(F.trim(F.get("_p", 9))).alias("text"))
    if need_section:
        rows = rows.filter("text <> ''")
    rows = packed(rows)  # read for the stories, the longest file and the result
    has_story = rows.groupBy(file).agg(F.max(F.col("story").cast("int")).alias("_any"))
    rows = rows.join(has_story, file).filter((F.col("_any") == 0) | F.col("story")).drop("_any", "story")
    rows = rows.withColumns({"start_s": parse_time(F.col("start")), "end_s": parse_time(F.col("end")), "word_count": F.size(tokens(F.col("text")))})
    return number_rows(rows, file, ["line_no"], out="idx")


# ---- S4, S12, S13: file listings ------------------------------------------------------------------------------

def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Paths, sizes and times below ``root``; contents are pruned and never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select(
        "path", "length", "modificationTime")


def picture_index(files: DataFrame, root: str) -> DataFrame:
    """Index rows of picture files: name, hint in brackets, kind by folder; hidden folders are skipped."""
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + base.replace(".", r"\."), "")
    rel = F.regexp_replace(rel, "^/", "")
    parts = F.split("relative", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?i)\.png$", "")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(base.rsplit("/", 1)[-1]))
    low = F.lower(parent)
    kind = F.when(low == "characters", "character").when(low.contains("symbol") | low.contains("jolly"), "symbol").when(low == "misc", "location").otherwise("character")
    skipped = F.exists(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), lambda d: d.startswith(".") | d.isin("__pycache__", "node_modules"))
    out = files.withColumn("relative", rel).filter(~skipped)
    return out.select("path", "relative", F.lower("relative").alias("relative_key"), F.lower(F.element_at(parts, -1)).alias("filename"), F.lower(stem).alias("stem"),
                      F.lower(F.trim(F.regexp_extract(stem, r"^([^(]*)", 1))).alias("primary_name"),
                      F.lower(F.trim(F.regexp_replace(F.regexp_extract(stem, r"\((.*)$", 1), r"[)\s]+$", ""))).alias("variant_hint"),
                      low.alias("parent"), kind.alias("asset_kind"), "modificationTime")


def index_is_stale(files: DataFrame, stored: DataFrame | None, built_at) -> bool:
    """True when there is no index, its format is old, or a file is newer than it."""
    if stored is None or "relative_key" not in stored.columns or stored.isEmpty():
        return True
    return not files.filter(F.col("modificationTime") > F.lit(built_at)).isEmpty()


def index_status(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("indexed"), *[F.count_if(F.col("asset_kind") == k).alias(f"{k}s") for k in ("character", "symbol", "location")])


def newest_by_suffix(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Newest file per suffix."""
    kind = F.coalesce(*[F.when(F.col("path").endswith(s), F.lit(s)) for s in suffixes])
    return files.withColumn("suffix", kind).filter("suffix IS NOT NULL").groupBy("suffix").agg(
        F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modified"))


def storage_usage(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
                     F.round(F.coalesce(F.sum("length"), F.lit(0)) / (1024 * 1024), 2).alias("mb"))


def expired_files(files: DataFrame, hours: float, now: Column | None = None) -> DataFrame:
    """Files older than ``hours``: a report, nothing is deleted."""
    age = F.unix_micros(now if now is not None else F.current_timestamp()) - F.unix_micros("modificationTime")
    return files.filter(age > hours * 3600e6)


# ---- S5, S6: model replies ---------------------------------------------------------------------------------------

SLIDE_FIELDS = ["start_time", "end_time", "summary", "image_search_query", "visual_source", "ai_image_prompt", "beat_type", "visual_role", "layout_mode",
                "motion_preset", "text_overlay", "transition_in", "sfx_cue"]
SLIDE_STRUCT = "struct<" + ",".join(f"{f}:string" for f in SLIDE_FIELDS) + ",context_entities:array<string>,emphasis_words:array<string>,asset_confidence:double>"


def _slides_in(json: Column) -> Column:
    """Slides of a reply: an array, one object, or an object that wraps a list."""
    wrapped = F.from_json(json, f"struct<slides:array<{SLIDE_STRUCT}>,segments:array<{SLIDE_STRUCT}>,items:array<{SLIDE_STRUCT}>,data:array<{SLIDE_STRUCT}>>")
    single = F.from_json(json, SLIDE_STRUCT)
    ok = lambda s: s["start_time"].isNotNull() & s["end_time"].isNotNull() & s["summary"].isNotNull()
    none = F.array().cast(f"array<{SLIDE_STRUCT}>")
    keep = lambda a: F.filter(F.coalesce(a, none), ok)
    # a parse is bound to a variable: its fields would otherwise be as many parses
    listed = keep(F.from_json(json, f"array<{SLIDE_STRUCT}>"))
    inner = let(wrapped, lambda w: _first_filled(*[keep(w[k]) for k in ("slides", "segments", "items", "data")]))
    object_ = let(single, lambda s: F.when(ok(s), F.array(s)).otherwise(inner))
    return F.when(F.startswith(F.trim(json), F.lit("[")), listed).when(F.startswith(F.trim(json), F.lit("{")), object_).otherwise(none)


def _first_filled(*lists: Column) -> Column:
    """The first list with an item, else the last one; a list is evaluated once, and only where those before it are empty."""
    first, *rest = lists
    return let(first, lambda x: F.when(F.size(x) > 0, x).otherwise(_first_filled(*rest))) if rest else first


def parse_slide_replies(replies: DataFrame, key: str = "script_id", text: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(slides, rejects).  Code fences are removed; text around the outer brackets is tried without it."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^```(json)?", ""), r"```$", ""))
    bracket = lambda b: F.regexp_extract(b, r"(?s)(\[.*\])", 1)
    parsed = replies.withColumn("_s", let(body, lambda b: _first_filled(_slides_in(b), _slides_in(bracket(b)))))
    # an inner explode would get a filter inferred that parses again
    slides = parsed.select(key, F.posexplode_outer("_s").alias("idx", "s")).filter("idx IS NOT NULL").select(key, F.col("idx").cast("long").alias("idx"), "s.*")
    return slides, parsed.filter(F.size("_s") == 0).drop("_s")


SECTION_NAMES = ["TITLE", "SCRIPT", "DESCRIPTION", "HASHTAGS"]  # fixed values


def split_sections(c: Column) -> dict[str, Column]:
    """Labelled sections of a reply (markdown around labels is tolerated); the last label wins."""
    lead = r"^\s*(?:#+\s*)?(?:[-*]\s*)?\*{0,3}"
    stop = lead + "(?:" + "|".join(SECTION_NAMES) + r")\s*:\*{0,3}"
    out = {}
    for name in SECTION_NAMES:
        found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?ms){lead}{name}\s*:\*{{0,3}}\s*(.*?)(?={stop}|\z)"), 1)
        out[name.lower()] = F.regexp_replace(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")), r"^\s+|\s+$", "")
    return out


# ---- S15: results -----------------------------------------------------------------------------------------------------

def save_rows(df: DataFrame, path: str, fmt: str = "json", by: str | None = "script_id", mode: str = "overwrite") -> None:
    """Slides, cues, manifests or events, one folder per script."""
    if by:  # files of a folder are small and many: a number of tasks that is not cut to their bytes shares them
        # (by a hash of the column: a shuffle by the column itself, which may be there already, would be taken instead)
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(by))
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(by) if by else writer).save(path)


def load_rows(spark: SparkSession, path: str, schema=None, fmt: str = "json") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def load_or_derive_events(spark: SparkSession, path: str, schema, slides: DataFrame, **kw) -> DataFrame:
    """Stored transition events; scripts without any get them derived from their slides."""
    from storyspark.operators.sequence import transition_events

    derived = transition_events(slides, **kw).select("script_id", "time_s", "transition")
    try:
        stored = load_rows(spark, path, schema).select("script_id", "time_s", "transition")
    except Exception as exc:  # the folder may not exist yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return derived
    have = stored.select("script_id").distinct()
    return stored.unionByName(derived.join(have, "script_id", "left_anti"))
