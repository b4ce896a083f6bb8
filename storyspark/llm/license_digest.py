"""Licence scan by canonical digest.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings,
white space) and its digest is looked up among those of known licences by a hash join.  Texts match
whole or not at all; there is no partial score.  Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.llm.licence_texts import LONG_TEXTS
from storyspark.session import cut_lineage

# Equivalent spellings of the published matching guidelines for licences (variant, kept spelling), in lower case without punctuation.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("noncommercial", "non commercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

#: A line that only names the owner of the copyright: it opens with the sign, or with the word or (c) before a year, a sign, a field to fill in
#: or "by", or ends in (or is) all rights reserved.  A wrapped sentence that opens with the word, and an item (c) of a list, are text.
COPYRIGHT_LINE = (r"(?m)^[^\S\n]*(?:(?:copyright[^\S\n]*:?[^\S\n]*)?(?:©[^\n]*|\(c\)[^\S\n]*(?:copyright[^\S\n]*)?(?:[0-9<\[{]|by\b)[^\n]*)"
                  r"|copyright[^\S\n]*:?[^\S\n]*(?:\(c\)|[0-9<\[{]|by\b)[^\n]*"
                  r"|(?:copyright\b[^\n]*[^\S\n])?all rights reserved[^\S\n]*[.!]?[^\S\n]*)$")

_NOTICES = [  # short notices that stand for a whole licence
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]
_PERMISSION = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
               "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
               "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
               "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_END = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
            "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
            "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_TEXTS = [  # Fixed values: whole licence texts
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software.\n\n" + _PERMISSION),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
]

_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE.",
]
_TITLES = {  # titles that a text has, has not, or has in other words
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License"],
}
_END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the whole licences in their usual variants.

    Short texts with each of their titles or none; longer ones as published, in one line (where
    notices inside are not lines of their own), and without the appendix on how to apply them.
    """
    short = list(_TEXTS)
    for name, parts in (("BSD-2-Clause", [*_BSD[:3], _BSD[4]]), ("BSD-3-Clause", _BSD)):
        for holders in (parts[-1], parts[-1].replace("COPYRIGHT HOLDER OR", "COPYRIGHT HOLDERS OR")):
            short.append((name, "\n\n".join([*parts[:-1], holders])))
            short.append((name, "\n\n".join([parts[0], *(f"{k}. {part}" for k, part in enumerate(parts[1:-1], 1)), holders])))
    short += [(name, text) for name, text in LONG_TEXTS if name in _TITLES]
    found = []
    for name, text in short:
        bare = next((text[len(title):].lstrip() for title in _TITLES[name] if text.startswith(f"{title}\n")), text)
        found += [(name, bare), *((name, f"{title}\n\n{bare}") for title in _TITLES[name])]
    for name, text in LONG_TEXTS:
        if name not in _TITLES:
            body = text.split(_END)[0]
            for variant in dict.fromkeys([text, body, body + _END if _END in text else text]):
                found += [(name, variant), (name, " ".join(variant.split()))]
    return list(dict.fromkeys(found))


def with_canonical(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the canonical form of ``text``.

    Lower case, no copyright lines, words of letters and digits apart by one blank, kept spellings;
    lines stay apart by ``\\n``.  Null stays null.  Words are runs of letters and digits of any
    script; all else is punctuation.  Few texts hold a variant spelling: one scan finds them, and
    only those are rewritten.
    """
    plain = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", " ")
    plain = F.regexp_replace(plain, r" ?\n[ \n]*", "\n")
    plain = F.regexp_replace(plain, r"^[ \n]+|[ \n]+$", "")
    some = r"\b(?:" + "|".join(a for a, _ in SPELLINGS) + r")\b"
    pairs = F.array(*[F.struct(F.lit(rf"\b{a}\b").alias("variant"), F.lit(b).alias("kept")) for a, b in SPELLINGS])
    rewritten = F.aggregate(pairs, F.col(out), lambda acc, p: F.regexp_replace(acc, p["variant"], p["kept"]))
    return df.withColumn(out, plain).withColumn(out, F.when(F.col(out).rlike(some), rewritten).otherwise(F.col(out)))


def digest(canonical_text: Column) -> Column:
    """SHA-256 of a canonical text, in which a line break is a blank; null where nothing is left of it."""
    flat = F.regexp_replace(canonical_text, "\n", " ")
    return F.when(F.length(flat) > 0, F.sha2(flat, 256))


def known_licences(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest) of known texts, the built-in ones by default; texts that share a digest keep the least id."""
    rows = spark.createDataFrame(texts if texts is not None else [*_NOTICES, *whole_texts()], "license_id string, text string")
    return with_canonical(rows, "text", "canon").select("license_id", digest(F.col("canon")).alias("digest")).where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_digest, text_license, n_license_lines, line_licenses) of every row of ``docs``.

    Both the whole text and each of its lines are looked up as entire texts: ``text_license`` is
    the licence that the text is (null if none), ``n_license_lines`` counts the lines that are a
    known text, ``line_licenses`` names their licences once each, sorted, joined by commas (empty
    if none).  A null or empty text, or one of punctuation alone, has no digest and matches nothing.
    Rows are kept apart even if they repeat or share an id; other columns are not read.

    Canonical forms are made once, and only digests go on.  Lines are looked up per distinct text
    (copies of a text share its hits, dropped map-side before the shuffle), and hits return to the
    rows by the digest of the text, which has one row on that side, so that a text that a third of
    the rows share can be split.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    canon = with_canonical(slim, "text", "canon").select("id", "canon")
    units = cut_lineage(canon.select("id", digest(F.col("canon")).alias("text_digest"), F.sha2("canon", 256).alias("content"),
                                     F.transform(F.split("canon", "\n"), lambda line: F.unhex(F.sha2(line, 256))).alias("lines")))
    lines = units.select("content", F.posexplode("lines").alias("line", "digest"))
    hits = lines.join(known.select(F.unhex("digest").alias("digest"), "license_id"), "digest").dropDuplicates(["content", "line"])
    per_text = hits.groupBy("content").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("names"))
    rows = units.drop("lines").join(per_text, "content", "left")
    rows = rows.join(known.withColumnsRenamed({"digest": "text_digest", "license_id": "text_license"}), "text_digest", "left")
    return rows.select(F.col("id").alias(id_col), "text_digest", "text_license", F.coalesce("n", F.lit(0).cast("long")).alias("n_license_lines"),
                       F.coalesce("names", F.lit("")).alias("line_licenses"))


def scan_sql(docs: str = "documents", texts: list[tuple[str, str]] | None = None) -> str:
    """The same scan as DuckDB SQL."""
    def canon(text: str) -> str:
        out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
        for pattern, by in ((r"[^\p{L}\p{N}\n]+", "' '"), (r" ?\n[ \n]*", "chr(10)"), (r"^[ \n]+|[ \n]+$", "''")):
            out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
        for variant, kept in SPELLINGS:
            out = f"regexp_replace({out}, '\\b{variant}\\b', '{kept}', 'g')"
        return out

    flat = "replace({0}, chr(10), ' ')"
    quoted = ", ".join("('{}', '{}')".format(a, t.replace("'", "''")) for a, t in (texts if texts is not None else [*_NOTICES, *whole_texts()]))
    return f"""
WITH known AS (
  SELECT sha256({flat.format("c")}) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {canon("text")} AS c FROM (VALUES {quoted}) k(license_id, text)) WHERE c <> '' GROUP BY 1),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {canon("coalesce(text, '')")} AS c FROM {docs}),
hits AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS names
  FROM (SELECT r, sha256(unnest(string_split(c, chr(10)))) AS digest FROM d) JOIN known USING (digest) GROUP BY r)
SELECT doc_id, CASE WHEN c <> '' THEN sha256({flat.format("c")}) END AS text_digest, k.license_id AS text_license,
  coalesce(n, 0) AS n_license_lines, coalesce(names, '') AS line_licenses
FROM d LEFT JOIN hits USING (r) LEFT JOIN known k ON c <> '' AND k.digest = sha256({flat.format("c")})"""
