"""HTML columns: plain text, links, chapter sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions.text import let, squeeze, title_has_chapter

# fixed values: the entities that are unescaped; &amp; last
ENTITIES = [("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
LINK = r"""(?is)<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>"""
FOOTERS = ["published by", "view all posts", "leave a reply"]
SECTION_CHARS = 9000


def html_to_text(html: Column) -> Column:
    """Scripts and styles dropped, breaks as newlines, tags dropped, blanks squeezed, entities unescaped."""
    out = F.coalesce(html, F.lit(""))
    for pattern, repl in (
        (r"(?is)<(script|style|noscript).*?</\1>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>|</h[1-6]>", "\n"),
        (r"(?s)<[^>]+>", " "), (r"[ \t]+", " "),
    ):
        out = F.regexp_replace(out, pattern, repl)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def extract_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per link: position, url, title."""
    h = F.coalesce(F.col(html), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(h, F.lit(LINK), 1).alias("u"), F.regexp_extract_all(h, F.lit(LINK), 2).alias("r"))
    return pages.select(key, F.posexplode(pairs).alias("pos", "l")).select(key, "pos", F.col("l.u").alias("url"), squeeze(html_to_text(F.col("l.r"))).alias("title"))


def matching_links(links: DataFrame, site: str, phrase: str, chapter: Column) -> DataFrame:
    """Links of a site whose title has the phrase and the chapter (alone or in a range)."""
    return links.filter(F.col("url").contains(site) & F.lower("title").contains(phrase.lower()) & title_has_chapter(F.col("title"), chapter))


def chapter_section(text: Column, chapter: Column, limit: int | None = SECTION_CHARS) -> Column:
    """Lines from "chapter n" to the next chapter heading or footer, at most ``limit`` characters (None: all).

    Without such a heading: the text from the first mention of the chapter, else all of it.
    """
    n = chapter.cast("string")

    def section(rest):
        ends = F.transform(rest, lambda x, i: ((i > 0) & F.lower(x).rlike(r"^chapter\s+\d{3,5}\b")) | F.lower(x).rlike("^(" + "|".join(FOOTERS) + ")"))
        return let(F.array_position(ends, True), lambda stop: F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest))

    def loose(joined):
        at = F.regexp_instr(joined, F.concat(F.lit(r"(?i)chapter\s+"), n, F.lit(r"\b")))
        return let(at, lambda i: F.when(i > 0, F.substring(joined, i, F.length(joined))).otherwise(joined))

    def chosen(lines):
        mine = F.transform(lines, lambda x: F.regexp_extract(F.lower(x), r"^chapter\s+(\d+)\b", 1) == n)
        return let(F.array_position(mine, True), lambda start: F.when(
            start > 0, squeeze(F.array_join(section(F.slice(lines, F.greatest(start, F.lit(1)).cast("int"), F.size(lines))), " "))).otherwise(
                loose(squeeze(F.array_join(lines, " ")))))

    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), squeeze), lambda x: x != "")
    found = let(lines, chosen)
    return found if limit is None else F.substring(found, 1, limit)
