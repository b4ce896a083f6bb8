"""Relationship graph: name resolution, edges mined from shared attributes, ranking.

Edges are mined from a set of source nodes, not for all pairs: a hub attribute shared by a
third of the nodes would otherwise emit a ninth of all pairs.  The source side is a query
batch; the work grows with the node table.  Only same-category edges are symmetric by
definition, and the rule itself limits a category to 20 members.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions.rules import NARRATION_SIGNALS, first_match
from storyspark.functions.text import norm_key
from storyspark.operators.search import contained_pairs, top_k
from storyspark.session import cut_lineage

# fixed values
TYPE_PRIORITY = {"opposes": 6, "rivals": 5, "family_or_lineage": 5, "mentor_link": 4, "allies_with": 4, "exploits": 3, "contrasts": 2,
                 "associated_with": 1}
CATEGORY_MEMBERS = (2, 20)  # groups that count as one crew; wider categories say nothing about their members
NODE_ROWS = 100_000  # nodes of a task that mines edges
EDGE = ["src", "dst", "seq", "type", "weight", "evidence"]


# ---- J9: name resolution -----------------------------------------------------------------------

def name_index(nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, node_id, pos): ids win, then aliases, then names; pos is the first insertion.

    ``nodes``: id, name, character, pos; ``aliases``: alias, node_id, pos.
    """
    rows = nodes.select(F.explode(F.array(
        F.struct(norm_key(F.col("name")).alias("key"), F.col("id").alias("node_id"), F.struct(F.lit(1).alias("a"), F.col("pos").cast("long").alias("b"), F.lit(0).alias("c")).alias("pos"), F.lit(2).alias("prio")),
        F.struct(norm_key(F.col("character")).alias("key"), F.col("id").alias("node_id"), F.struct(F.lit(1).alias("a"), F.col("pos").cast("long").alias("b"), F.lit(1).alias("c")).alias("pos"), F.lit(2).alias("prio")),
        F.struct(norm_key(F.col("id").cast("string")).alias("key"), F.col("id").alias("node_id"), F.struct(F.lit(1).alias("a"), F.col("pos").cast("long").alias("b"), F.lit(2).alias("c")).alias("pos"), F.lit(0).alias("prio")),
    )).alias("r")).select("r.*")
    if aliases is not None:
        rows = rows.unionByName(aliases.select(norm_key(F.col("alias")).alias("key"), "node_id", F.struct(
            F.lit(0).alias("a"), F.col("pos").cast("long").alias("b"), F.lit(0).alias("c")).alias("pos"), F.lit(1).alias("prio")))
    return rows.filter("key <> ''").groupBy("key").agg(F.min_by("node_id", F.struct("prio", "pos")).alias("node_id"), F.min("pos").alias("pos"))


def resolve_names(queries: DataFrame, index: DataFrame, name: str = "name", qid: str = "query_id") -> DataFrame:
    """Exact key first; the rest by containment either way, earliest index entry first."""
    q = queries.select(qid, norm_key(F.col(name)).alias("key")).filter("key <> ''")
    exact = q.join(index, "key").select(qid, "node_id", F.lit("exact").alias("how"))
    rest = q.join(index.select("key"), "key", "left_anti").withColumnRenamed("key", "qk")
    keys = index.select(F.col("key").alias("ik"), "node_id", "pos")
    pairs = contained_pairs(rest, keys, "qk", "ik").unionByName(contained_pairs(keys, rest, "ik", "qk").select("qk", "ik")).distinct()
    near = rest.join(pairs, "qk").join(keys, "ik").groupBy(qid).agg(F.min_by("node_id", "pos").alias("node_id")).withColumn("how", F.lit("contained"))
    return exact.unionByName(near)


# ---- J10: edges -----------------------------------------------------------------------------------

def _tokens(c: Column, sep: str) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def _moody() -> Column:
    """Nodes that their emotions link."""
    return (F.coalesce("emotion", F.lit("")) != "") & ~F.lower(F.coalesce("visual_type", F.lit(""))).contains("arc")


def _shared(nodes: DataFrame, sources: DataFrame, tokens: Column, least: int, step: float, cap: float, kind: str, label: str, seq: int, shown: int, parts: int) -> DataFrame:
    owned = nodes.select("id", tokens.alias("_t"))
    mine = owned.select("id", F.explode("_t").alias("t")).join(sources.select("id"), "id", "left_semi").withColumnRenamed("id", "src")
    # dealt by the far end of an edge: its pairs meet where they arise
    both = mine.join(owned.repartition(parts, "id").select(F.col("id").alias("dst"), F.explode("_t").alias("t")), "t").filter("src <> dst").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("t")).alias("ts")).filter(F.col("n") >= least)
    return both.select("src", "dst", F.lit(seq).alias("seq"), F.lit(kind).alias("type"), F.least(F.lit(cap), F.lit(step) * F.col("n")).alias("weight"),
                       F.concat(F.lit(f"{label}: "), F.array_join(F.slice("ts", 1, shown), ", ")).alias("evidence"))


def mine_edges(nodes: DataFrame, sources: DataFrame, curated: DataFrame | None = None, generic_tags: Sequence[str] = (),
               category_members: tuple[int, int] = CATEGORY_MEMBERS, shown: int = 3) -> DataFrame:
    """Edge pieces from each source node; ``combine_edges`` adds them up.

    ``nodes``: id, name, character, category, arc, emotion, visual_type, importance, tags.
    ``curated``: src, dst, type, weight, evidence; its reverse counts .8.
    ``category_members``: sizes of a category whose members are linked with each other (the
    published rule by default); ``shown``: shared tokens named in the evidence.
    """
    kind = F.lower(F.coalesce("visual_type", F.lit("")))
    parts = []
    if curated is not None:
        both = curated.select("src", "dst", "type", "weight", "evidence").unionByName(
            curated.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", (F.col("weight") * 0.8).alias("weight"), "evidence"))
        known = nodes.select("id")
        parts.append(both.filter("src <> dst").join(sources.select(F.col("id").alias("src")), "src", "left_semi").join(
            known.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit(0).alias("seq"), "type", "weight", "evidence"))
    plain = [t for t in generic_tags]
    usable = lambda c: (F.length(c) >= 3) & ~c.isin(*plain) if plain else F.length(c) >= 3
    spread = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // NODE_ROWS))
    named = nodes.select("id", "name", "character").repartition(spread, "id").select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.explode(F.array_distinct(F.transform(
        F.split(F.lower(F.concat_ws(" ", "name", "character")), r"\s+"), norm_key))).alias("t")).filter(usable(F.col("t")))
    tagged = nodes.join(sources.select("id"), "id", "left_semi").select(F.col("id").alias("src"), F.explode("tags").alias("tag")).withColumn(
        "t", norm_key(F.col("tag"))).filter(usable(F.col("t")))
    parts.append(tagged.join(named, "t").filter("src <> dst").select("src", "dst", F.lit(1).alias("seq"), F.lit("associated_with").alias("type"), F.lit(0.12).alias("weight"),
                                                                     F.concat(F.lit("Tag '"), "tag", F.lit("' references "), "dst_name").alias("evidence")))
    people = nodes.filter((kind != "") & ~kind.contains("arc") & ~kind.contains("weapon"))
    parts.append(_shared(people, sources, _tokens(F.col("arc"), "/"), 1, 0.08, 0.25, "associated_with", "Shared arcs", 2, shown, spread))
    moody = nodes.filter(_moody())
    parts.append(_shared(moody, sources, _tokens(F.col("emotion"), ","), 2, 0.05, 0.15, "contrasts", "Shared emotions", 3, shown, spread))
    cats = nodes.filter((F.coalesce("category", F.lit("")) != "") & ~F.col("category").contains("arc"))
    sized = cats.groupBy("category").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(*category_members))
    small = cats.join(sized.select("category"), "category", "left_semi").select("id", "category")
    mine = small.join(sources.select("id"), "id", "left_semi").withColumnRenamed("id", "src")
    parts.append(mine.join(small.withColumnRenamed("id", "dst"), "category").filter("src <> dst").select(
        "src", "dst", F.lit(4).alias("seq"), F.lit("allies_with").alias("type"), F.lit(0.10).alias("weight"), F.concat(F.lit("Same group: "), "category").alias("evidence")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def combine_edges(edges: DataFrame) -> DataFrame:
    """One row per pair: summed weight, strongest type (the later of equals), distinct evidence in order."""
    prio = F.coalesce(*[F.when(F.col("type") == t, F.lit(p)) for t, p in TYPE_PRIORITY.items()], F.lit(0))
    return edges.groupBy("src", "dst").agg(
        F.sum("weight").alias("weight"), F.max_by("type", F.struct(prio, "seq")).alias("type"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"])).alias("evidence"))


# ---- J1, J12: mentions ----------------------------------------------------------------------------------

#: Terms and characters of a lexicon that goes to every task as one automaton; a larger one meets the texts by a join.
MATCHER_TERMS, MATCHER_CHARS = 200_000, 8_000_000


def _is_word(ch: str) -> bool:
    """Characters of words: letters, marks, digits, connectors and joiners."""
    kind = unicodedata.category(ch)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or ch in "\u200c\u200d"


class Matcher:
    """Aho-Corasick automaton over lower-case terms; a term counts where both its ends are word boundaries."""

    def __init__(self, terms: Sequence[str]):
        self.automaton = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            self.automaton.add_word(term, (number, len(term)))
        if terms:
            self.automaton.make_automaton()
        self.known = len(terms)

    def find(self, text: str) -> list[int]:
        """Numbers of the terms in a lower-case text, each once."""
        found: set[int] = set()
        for last, (number, size) in self.automaton.iter(text) if self.known and text else ():
            if number not in found and self._edge(text, last - size + 1) and self._edge(text, last + 1):
                found.add(number)
        return sorted(found)

    @staticmethod
    def _edge(text: str, at: int) -> bool:
        before = at > 0 and _is_word(text[at - 1])
        after = at < len(text) and _is_word(text[at])
        return before != after


def _lexicon(lexicon: DataFrame, term: str) -> DataFrame:
    """``lexicon`` with ``_term``: lower-case terms that hold a word."""
    return lexicon.withColumn("_term", F.lower(F.col(term))).filter(F.col("_term").rlike(r"(?U)\w"))


def lexicon_hits(texts: DataFrame, lexicon: DataFrame, term: str = "term", text: str = "text", tid: str = "text_id") -> DataFrame:
    """(text id, lexicon row) for terms that stand in the text, case aside, between word boundaries.

    A lexicon within MATCHER_TERMS and MATCHER_CHARS goes to every task as one automaton: each
    text is read once where it lies, and only hits move.  A larger one is joined on the first word of its terms; the
    text's pieces from there on come along, so the text itself moves once.
    """
    lex = _lexicon(lexicon, term)
    spelled = lex.select("_term").distinct()
    count, size = spelled.agg(F.count(F.lit(1)), F.sum(F.length("_term"))).first()
    low = texts.select(tid, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    if count <= MATCHER_TERMS and (size or 0) <= MATCHER_CHARS:
        hits = _found_by_automaton(low, sorted(r["_term"] for r in spelled.collect()), tid)
        # a lexicon of this size is bounded
        return hits.join(F.broadcast(lex), "_term").drop("_term")
    return _found_by_join(low, spelled, tid).join(lex, "_term").drop("_term")


def _found_by_automaton(low: DataFrame, terms: list[str], tid: str) -> DataFrame:
    shared = low.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            found = [matcher.find(t.as_py()) for t in batch.column(1)]
            owner = [i for i, f in enumerate(found) for _ in f]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array([shared.value[n] for f in found for n in f], pa.string())], [tid, "_term"])

    return low.mapInArrow(run, f"`{tid}` {low.schema[tid].dataType.simpleString()}, _term string")


def _found_by_join(low: DataFrame, spelled: DataFrame, tid: str) -> DataFrame:
    """Terms by their first word: the pieces (words and what stands between) from each such word on hold the term, if it is there."""
    pieces = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)(\w+|\W+)"), 1)
    is_word = lambda c: c.rlike(r"(?U)^\w")
    own = spelled.withColumn("_p", pieces(F.col("_term"))).withColumn("_lead", F.when(is_word(F.get("_p", 0)), "").otherwise(F.get("_p", 0)))
    own = own.withColumns({"_first": F.when(F.col("_lead") == "", F.get("_p", 0)).otherwise(F.get("_p", 1)),
                           "_core": F.expr("substring(_term, length(_lead) + 1)"), "_size": F.size("_p")})
    longest = F.broadcast(own.agg(F.coalesce(F.max("_size"), F.lit(0)).alias("_longest")))
    cut = low.withColumn("_p", pieces(F.col("_low"))).crossJoin(longest).select(tid, F.posexplode("_p").alias("_at", "_first"), "_p", "_longest").filter(is_word(F.col("_first")))
    # one piece before and one behind decide on the boundaries of terms that start or end with other characters
    around = cut.select(tid, "_first", F.when(F.col("_at") > 0, F.get("_p", F.col("_at") - 1)).otherwise("").alias("_before"), (F.col("_at") > 1).alias("_more"),
                        F.array_join(F.slice("_p", F.col("_at") + 1, F.col("_longest") + 1), "").alias("_rest"))
    met = around.join(own, "_first").filter(F.startswith("_rest", F.col("_core")))
    next_ = F.expr("substring(_rest, length(_core) + 1, 1)")
    ends_in_word = F.col("_core").rlike(r"(?U)\w$")
    follows = next_.rlike(r"(?U)\w")
    starts = (F.col("_lead") == "") | ((F.col("_before") == F.col("_lead")) & F.col("_more"))
    return met.filter(starts & (ends_in_word != follows)).select(tid, "_term").distinct()


#: Names up to which a row expression asks for each on its own; more are found by one automaton.
FEW_NAMES = 16


def context_entities(text: Column, aliases: Sequence[tuple[str, str]], entities: Sequence[str], limit: int = 8) -> Column:
    """Known entities of a text as a row expression: aliases by substring first, then entities on word boundaries."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if len(aliases) + len(entities) > FEW_NAMES:
        return _known_names(list(aliases), list(entities), limit)(low)
    found = [F.when(low.contains(a), F.lit(name)) for a, name in aliases]
    found += [F.when(low.rlike(r"(?U)\b" + re.escape(e.lower()) + r"\b"), F.lit(e)) for e in entities]
    return F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, limit) if found else F.array().cast("array<string>")


def _known_names(aliases: list[tuple[str, str]], entities: list[str], limit: int):
    """The same in one pass over the text."""
    @F.pandas_udf("array<string>")
    def names(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts = ahocorasick.Automaton()
        for number, (part, _) in enumerate(aliases):
            if part:
                parts.add_word(part, [*parts.get(part, []), number])
        if len(parts):
            parts.make_automaton()
        lowered = [e.lower() for e in entities]
        terms = sorted(set(lowered) - {""})
        matcher = Matcher(terms)

        def known(text: str) -> list[str]:
            at = {n for _, numbers in (parts.iter(text) if len(parts) and text else ()) for n in numbers} | {n for n, (part, _) in enumerate(aliases) if not part}
            words = {terms[n] for n in matcher.find(text)}
            return list(dict.fromkeys([aliases[n][1] for n in sorted(at)] + [e for e, low in zip(entities, lowered) if low in words]))[:limit]

        for batch in texts:
            yield batch.map(known)

    return names


def entities_by_join(texts: DataFrame, lexicon: DataFrame, limit: int = 8, text: str = "text", tid: str = "text_id") -> DataFrame:
    """Same for a lexicon table (term, canonical, alias_first, pos): the first ``limit`` names per text, in order."""
    hits = lexicon_hits(texts, lexicon, "term", text, tid).groupBy(tid, "canonical").agg(F.min(F.struct("alias_first", "pos")).alias("o"))
    best = top_k(hits, limit, [F.col("o"), F.col("canonical")], tid)
    return best.groupBy(tid).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "canonical"))), lambda x: x["canonical"]).alias("entities"))


def narration_mentions(narration: DataFrame, names: DataFrame, text: str = "narration", sid: str = "src", rules=NARRATION_SIGNALS, unicode: bool = True) -> DataFrame:
    """(src, dst, boost, type): a named node gives .20, and .08 plus a type when a signal fires in the text.

    ``narration``: src, text; ``names``: term, node_id.
    """
    texts = narration.withColumn("signal", first_match(F.col(text), rules, None, unicode))
    hit = lexicon_hits(texts.select(F.col(sid).alias("text_id"), text), names, "term", text).select(
        F.col("text_id").alias(sid), F.col("node_id").alias("dst")).distinct().filter(F.col(sid) != F.col("dst"))
    return hit.join(texts.select(sid, "signal"), sid).select(
        sid, "dst", (F.lit(0.20) + F.when(F.col("signal").isNotNull(), 0.08).otherwise(0.0)).alias("boost"), F.col("signal").alias("narration_type"))


# ---- J11, J13, A9: ranking --------------------------------------------------------------------------------

def rank_relationships(edges: DataFrame, nodes: DataFrame, k: int = 10, mentions: DataFrame | None = None, min_score: float = 0.0) -> DataFrame:
    """Edge weight + narration boost + importance / 5 * .10, in [0, 1]; top k per source."""
    show = lambda: F.coalesce(F.nullif(F.col("character"), F.lit("")), F.col("name"))
    j = edges.join(nodes.select(F.col("id").alias("dst"), show().alias("target"), "importance"), "dst")
    if mentions is None:
        j = j.withColumns({"boost": F.lit(0.0), "narration_type": F.lit(None).cast("string")})
    else:
        j = j.join(mentions, ["src", "dst"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    bonus = F.col("importance") / F.lit(5.0) * F.lit(0.10)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("weight") + F.col("boost") + bonus)), 9)
    note = F.when(F.col("boost") > 0, F.array(F.format_string("Narration co-occurrence (+%.2f)", F.col("boost")))).otherwise(F.array().cast("array<string>"))
    out = j.select("src", "dst", "target", score.alias("score"), F.coalesce("narration_type", "type").alias("relationship"),
                   F.slice(F.concat("evidence", note), 1, 5).alias("evidence"), F.col("weight").alias("graph_weight"),
                   F.col("boost").alias("narration_boost"), bonus.alias("importance_boost")).filter(F.col("score") >= min_score)
    return top_k(out, k, [F.desc("score"), F.col("dst")], "src")


def mutual_connections(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int = 5, pieces: int = 2) -> DataFrame:
    """Nodes linked from both ends of each pair (pair_id, a, b): mean weight up to 1, ``pieces`` pieces of evidence from each."""
    ea = pairs.join(edges.select(F.col("src").alias("a"), "dst", F.col("weight").alias("wa"), F.col("evidence").alias("va")), "a")
    eb = edges.select(F.col("src").alias("b"), "dst", F.col("weight").alias("wb"), F.col("evidence").alias("vb"))
    both = ea.join(eb, ["b", "dst"]).filter((F.col("dst") != F.col("a")) & (F.col("dst") != F.col("b")))
    score = F.round(F.least(F.lit(1.0), (F.col("wa") + F.col("wb")) / 2), 9)
    out = both.select("pair_id", "dst", score.alias("score"), F.concat(F.slice("va", 1, pieces), F.slice("vb", 1, pieces)).alias("evidence"))
    return top_k(out, k, [F.desc("score"), F.col("dst")], "pair_id").join(
        nodes.select(F.col("id").alias("dst"), F.coalesce(F.nullif(F.col("character"), F.lit("")), F.col("name")).alias("target")), "dst")


def neighbour_groups(nodes: DataFrame, generic_tags: Sequence[str] = (), category_members: tuple[int, int] = CATEGORY_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """((id, group) of the nodes in a group, (id, group) of those that the group links to): the rules of ``mine_edges`` without a pair.

    A node is linked to all members of the groups it looks up: names that a tag of it spells, arcs, pairs of emotions, small categories.
    """
    kind = F.lower(F.coalesce("visual_type", F.lit("")))
    plain = list(generic_tags)
    usable = lambda c: (F.length(c) >= 3) & ~c.isin(*plain) if plain else F.length(c) >= 3
    group = lambda rule, c: F.concat(F.lit(f"{rule}:"), c)
    named = nodes.select("id", F.explode(F.array_distinct(F.transform(F.split(F.lower(F.concat_ws(" ", "name", "character")), r"\s+"), norm_key))).alias("t"))
    tagged = nodes.select("id", F.explode(F.array_distinct(F.transform("tags", norm_key))).alias("t"))
    named, tagged = (d.filter(usable(F.col("t"))).select("id", group("tag", F.col("t")).alias("group")) for d in (named, tagged))
    people = nodes.filter((kind != "") & ~kind.contains("arc") & ~kind.contains("weapon"))
    arcs = people.select("id", F.explode(_tokens(F.col("arc"), "/")).alias("t")).select("id", group("arc", F.col("t")).alias("group"))
    moody = nodes.filter(_moody()).select("id", F.array_sort(_tokens(F.col("emotion"), ",")).alias("e"))
    two = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y: F.concat(x, F.lit("\1"), y))))
    moods = moody.filter(F.size("e") > 1).select("id", F.explode(two).alias("t")).select("id", group("emotion", F.col("t")).alias("group"))
    cats = nodes.filter((F.coalesce("category", F.lit("")) != "") & ~F.col("category").contains("arc"))
    small = cats.groupBy("category").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(*category_members))
    crews = cats.join(small.select("category"), "category", "left_semi").select("id", group("category", F.col("category")).alias("group"))
    both = arcs.unionByName(moods).unionByName(crews)
    return named.unionByName(both), tagged.unionByName(both)


def degree_estimates(nodes: DataFrame, generic_tags: Sequence[str] = (), category_members: tuple[int, int] = CATEGORY_MEMBERS, lg_k: int = 12) -> DataFrame:
    """(id, relationship_estimate) of every node, mined or not: distinct neighbours by HyperLogLog sketches.

    One sketch a group holds its members; a node's neighbours are the union of the sketches that it looks
    up, less itself.  Nodes that look up the same groups share one union, and no pair of nodes is
    written.  The relative standard error is 1.04 / sqrt(2 ** lg_k), 1.6 % by default; a few hundred
    neighbours are counted almost exactly.
    """
    members, lookups = neighbour_groups(nodes, generic_tags, category_members)
    sketches = members.groupBy("group").agg(F.hll_sketch_agg(F.col("id").cast("string"), F.lit(lg_k)).alias("sketch"))
    sets = lookups.groupBy("id").agg(F.sort_array(F.collect_set("group")).alias("groups")).withColumn("key", F.sha2(F.array_join("groups", "\2"), 256))
    each = sets.groupBy("key").agg(F.first("groups").alias("groups")).select("key", F.explode("groups").alias("group"))
    sizes = each.join(sketches, "group").groupBy("key").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(False))).alias("size"))
    itself = lookups.join(members, ["id", "group"], "left_semi").select("id", F.lit(1).alias("self")).distinct()
    found = sets.select("id", "key").join(sizes, "key").join(itself, "id", "left").select(
        "id", F.greatest(F.lit(0), F.col("size") - F.coalesce("self", F.lit(0))).cast("long").alias("relationship_estimate"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("relationship_estimate", F.lit(0)).cast("long").alias("relationship_estimate"))


def exact_degrees(nodes: DataFrame, generic_tags: Sequence[str] = (), category_members: tuple[int, int] = CATEGORY_MEMBERS) -> DataFrame:
    """(id, relationship_count) of every node, as its mined edges give it, without an edge for each pair of nodes.

    Nodes of the same groups have the same neighbours.  Edges are mined between one node of each such
    class and count for as many as the classes hold; a group that links nobody makes no class.  The
    pairs are those of classes: as many as those of nodes only where no two nodes share their groups.
    """
    members, lookups = (d.filter(~F.startswith("group", F.lit("emotion:"))) for d in neighbour_groups(nodes, generic_tags, category_members))
    used = members.select("group").distinct().join(lookups.select("group").distinct(), "group")
    sides = members.withColumn("_m", F.col("group")).withColumn("_l", F.lit(None).cast("string")).unionByName(
        lookups.withColumn("_l", F.col("group")).withColumn("_m", F.lit(None).cast("string")))
    groups = sides.join(used, "group").groupBy("id").agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("_m", "_l")])
    # emotions link by their number, so a repeated one counts again
    moods = nodes.filter(_moody()).select("id", F.explode(_tokens(F.col("emotion"), ",")).alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("_e"))
    none = F.array().cast("array<string>")
    each = nodes.select("id").distinct().join(groups, "id", "left").join(moods, "id", "left").select("id", *[F.coalesce(c, none).alias(c) for c in ("_m", "_l", "_e")])
    keyed = each.withColumn("key", F.sha2(F.to_json(F.struct("_m", "_l", "_e")), 256))
    classes = cut_lineage(keyed.groupBy("key").agg(F.min_by(F.struct("id", "_m", "_l", "_e"), "id").alias("c"), F.count(F.lit(1)).alias("size")).select("key", "c.*", "size"))
    # a category is as small as all its nodes say, not as those mined here
    crew = F.array_contains("_m", F.concat(F.lit("category:"), "category"))
    rows = nodes.join(classes.select("id", "_m"), "id").withColumn("category", F.when(crew, F.col("category")).otherwise("")).drop("_m")
    edges = combine_edges(mine_edges(rows, classes.select("id"), None, generic_tags, category_members))
    others = edges.select("src", "dst").join(classes.select(F.col("id").alias("dst"), "size"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("size").alias("_others"))
    alike = F.when(F.arrays_overlap("_l", "_m") | (F.size("_e") > 1), F.col("size") - 1).otherwise(0)
    degree = classes.join(others, "id", "left").select("key", (F.coalesce("_others", F.lit(0)) + alike).cast("long").alias("relationship_count"))
    return keyed.select("id", "key").join(degree, "key").select("id", "relationship_count")


def node_directory(nodes: DataFrame, edges: DataFrame | None, sources: DataFrame | None = None, estimates: DataFrame | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """Nodes with the number of their relationships in ``edges``, and their names in lower case, by which they are resolved.

    ``sources`` (id) are the nodes whose edges were mined; the number is null for any other node,
    of which nothing is known.  Without it all nodes count as mined.  ``estimates`` (of
    ``degree_estimates``) adds the estimated number for every node.  ``degrees`` (of ``exact_degrees``)
    gives the numbers in place of edges.
    """
    degree = degrees if degrees is not None else edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("relationship_count"))
    out = nodes.join(degree, "id", "left")
    count = F.coalesce("relationship_count", F.lit(0))
    if sources is not None:
        out = out.join(sources.select("id", F.lit(True).alias("_mined")).distinct(), "id", "left")
        count = F.when(F.col("_mined"), count)
    names = F.array_distinct(F.filter(F.array(*[norm_key(F.col(c).cast("string")) for c in ("id", "name", "character")]), lambda x: x != ""))
    columns = ["id", F.coalesce(F.nullif(F.col("character"), F.lit("")), F.col("name")).alias("name"), "category", "importance",
               count.alias("relationship_count"), names.alias("resolvable_names")]
    if estimates is not None:
        out = out.join(estimates, "id", "left")
        columns.append("relationship_estimate")
    return out.select(*columns)


def graph_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, their categories, the edges that were mined and from how many nodes."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"), F.array_sort(F.collect_set(F.when(F.col("category") != "", F.col("category")))).alias("categories")).withColumn("k", F.lit(1))
    e = edges.agg(F.count(F.lit(1)).alias("mined_edges"), F.countDistinct("src").alias("mined_nodes")).withColumn("k", F.lit(1))
    return n.join(e, "k").drop("k")
