"""Catalog search: tag, emotion, arc and composite ranking, catalog and file matching.

No search multiplies queries by assets.  Scores depend on an asset's attributes only, so a batch
first meets *signatures*: distinct combinations of the attributes that it asks about, each with
its k lowest ids.  Of the signatures, a query keeps the k best by score and lowest id; each has an
asset that beats all assets of those left out, so the k best assets are among theirs.  Matches come
from equi-joins on tags, tokens and exploded substrings of short distinct labels.  The composite
ranker adds the best assets by the part of the score every asset has (importance, similarity).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyspark.functions.rules import ARC_LOCATION_TERMS
from storyspark.functions.text import norm_key, split_csv
from storyspark.operators.vector import cosine, top_k_vectors
from storyspark.session import cut_lineage


def top_k(df: DataFrame, k: int, by: Sequence[Column], part: str | Sequence[str] = "query_id", out: str = "rank") -> DataFrame:
    """Best k rows per group.  The row_number filter becomes a group limit before the shuffle."""
    keys = [part] if isinstance(part, str) else list(part)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col(out) <= k)


def contained_pairs(needles: DataFrame, hays: DataFrame, needle: str = "needle", hay: str = "hay") -> DataFrame:
    """Distinct (needle, hay) pairs with the needle inside the hay, as an equi-join.

    Hays are cut into substrings of only the lengths the needles have; these come along as one
    row (as many numbers as the longest needle has characters, at most).  Meant for short labels:
    names, tags, title keys.
    """
    n = needles.select(needle).filter(F.length(needle) > 0).distinct()
    lengths = n.agg(F.sort_array(F.collect_set(F.length(needle))).alias("_sizes"))
    cut = F.flatten(F.transform(F.filter("_sizes", lambda s: s <= F.length(hay)),
                                lambda s: F.transform(F.sequence(F.lit(1), F.length(hay) - s + 1), lambda at: F.substring(F.col(hay), at, s))))
    h = hays.select(hay).filter(F.length(hay) > 0).distinct().crossJoin(F.broadcast(lengths)).select(hay, F.explode(F.array_distinct(cut)).alias(needle))
    return h.join(n, needle).select(needle, hay)


# ---- signatures -----------------------------------------------------------------------------------

def signatures(assets: DataFrame, columns: Sequence[str], k: int, id: str = "id") -> DataFrame:
    """Distinct combinations of ``columns`` with their k lowest ids (``_ids``); the lowest stands for the combination.

    The row_number filter becomes a group limit before the shuffle, so a combination that a third of
    the assets share sends k rows a task.
    """
    lowest = top_k(assets.select(id, *columns), k, [F.col(id)], list(columns), "_n").drop("_n")
    return lowest.groupBy(*columns).agg(F.sort_array(F.collect_list(id)).alias("_ids")).withColumn(id, F.col("_ids")[0])


def _members(ranked: DataFrame, sigs: DataFrame, k: int, by: Sequence[Column], qid: str, id: str) -> DataFrame:
    """The k best assets of each query, from its ranked signatures: k x k rows a query at most."""
    each = ranked.join(sigs.select(id, "_ids"), id).withColumn(id, F.explode("_ids")).drop("_ids")
    return top_k(each, k, by, qid)


def _best_assets(found: DataFrame, sigs: DataFrame, k: int, qid: str, id: str) -> DataFrame:
    by = [F.desc("score"), F.col(id)]
    return _members(top_k(found, k, by, qid).drop("rank"), sigs, k, by, qid, id)


# ---- J2: tags -----------------------------------------------------------------------------------

def _tag_set(c: Column) -> Column:
    return F.filter(F.transform(c, lambda t: F.lower(F.trim(t))), lambda t: t != "")


def asked_tags(assets: DataFrame, asked: DataFrame, tags: Column, id: str = "id") -> DataFrame:
    """(id, _tags): the tags of each asset that some query asks for, sorted; assets without one are left out."""
    owned = assets.select(id, F.explode(tags).alias("_tag"))
    return owned.join(asked.select("_tag").distinct(), "_tag", "left_semi").groupBy(id).agg(F.sort_array(F.collect_list("_tag")).alias("_tags"))


def tag_candidates(sigs: DataFrame, asked: DataFrame, k: int, qid: str = "query_id", id: str = "id") -> DataFrame:
    """(query, signature) pairs that hold the k best signatures of each query by matched tags.

    The tag of a query that most signatures have gives only its k best ones (most copies of the tag,
    then lowest id): a signature that matches by this tag alone loses against them.  All others
    match by a rarer tag too and come from its list.  So one hub tag does not pair its queries with its
    signatures.
    """
    lists = sigs.select(id, F.explode("_tags").alias("_tag")).groupBy("_tag", id).agg(F.count(F.lit(1)).alias("_copies"))
    spread = lists.groupBy("_tag").agg(F.count(F.lit(1)).alias("_sigs"))
    order = Window.partitionBy(qid).orderBy(F.desc("_sigs"), "_tag")
    placed = asked.select(qid, "_tag").join(spread, "_tag").withColumn("_hub", F.row_number().over(order) == 1)
    short = top_k(lists, k, [F.desc("_copies"), F.col(id)], "_tag", "_n")
    hub = placed.filter("_hub").select(qid, "_tag").join(short.select("_tag", id), "_tag").select(qid, id)
    rest = placed.filter("NOT _hub").select(qid, "_tag").join(lists.select("_tag", id), "_tag").select(qid, id)
    return hub.unionByName(rest).distinct()


def tag_search(assets: DataFrame, queries: DataFrame, k: int = 10, tags: str = "tags", qid: str = "query_id", id: str = "id") -> DataFrame:
    """Score = matched tags / asked tags.  A tag listed twice on an asset counts twice."""
    wanted = queries.select(qid, F.array_distinct(_tag_set(F.col(tags))).alias("_q"))
    asked = wanted.select(qid, F.explode("_q").alias("_tag"))
    sigs = signatures(asked_tags(assets, asked, _tag_set(F.col(tags)), id), ["_tags"], k, id)
    pairs = tag_candidates(sigs, asked, k, qid, id).join(sigs.select(id, "_tags"), id).join(wanted, qid)
    hits = pairs.select(qid, id, F.size(F.filter("_tags", lambda t: F.array_contains("_q", t))).cast("long").alias("hits"), F.size("_q").alias("_n"))
    return _best_assets(hits.withColumn("score", F.col("hits") / F.col("_n")).drop("_n"), sigs, k, qid, id)


# ---- J3: emotions --------------------------------------------------------------------------------

def emotion_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(split_csv(c), norm_key), lambda x: x != ""))


def emotion_matches(assets: DataFrame, queries: DataFrame, qid: str = "query_id", id: str = "id", emotion: str = "emotion") -> DataFrame:
    """(query, asset, emotion_match): exact tokens 1.0, containment either way 0.6, over asked tokens."""
    asked = queries.select(qid, emotion_tokens(F.col(emotion)).alias("_q")).select(qid, F.size("_q").alias("_n"), F.explode("_q").alias("qt"))
    owned = assets.select(id, F.explode(emotion_tokens(F.col(emotion))).alias("at"))
    q, a = asked.select("qt").distinct(), owned.select("at").distinct()
    inside = contained_pairs(q, a, "qt", "at").unionByName(contained_pairs(a, q, "at", "qt").select("qt", "at")).distinct()
    pairs = inside.withColumn("_w", F.when(F.col("qt") == F.col("at"), 1.0).otherwise(0.6))
    best = asked.join(pairs, "qt").join(owned, "at").groupBy(qid, id, "_n", "qt").agg(F.max("_w").alias("_w"))
    return best.groupBy(qid, id, "_n").agg((F.sum("_w") / F.first("_n")).alias("emotion_match")).drop("_n")


def emotion_search(assets: DataFrame, queries: DataFrame, k: int = 10, qid: str = "query_id", id: str = "id", emotion: str = "emotion") -> DataFrame:
    sigs = signatures(assets.select(id, F.array_sort(emotion_tokens(F.col(emotion))).alias("_tokens")), ["_tokens"], k, id)
    found = emotion_matches(sigs.withColumn(emotion, F.array_join("_tokens", ",")), queries, qid, id, emotion).withColumn("score", F.round("emotion_match", 9))
    return _best_assets(found, sigs, k, qid, id)


# ---- J4: arcs ----------------------------------------------------------------------------------------

def arc_search(assets: DataFrame, queries: DataFrame, k: int = 10, arc: str = "arc", qid: str = "query_id", id: str = "id") -> DataFrame:
    """Exact key 1.0, key inside 0.7, raw text inside 0.6, arc key (4+ letters) inside the query 0.4.

    The ladder runs over distinct arc texts, each with its k lowest ids.
    """
    sigs = signatures(assets.select(id, F.col(arc).alias("_arc")).filter("_arc <> ''"), ["_arc"], k, id)
    asked = queries.select(qid, norm_key(F.col(arc)).alias("qn"), F.lower(F.trim(F.col(arc))).alias("ql")).filter("ql <> ''")
    parts = sigs.select(
        "_arc", F.explode(F.transform(F.split("_arc", "/"), lambda x: F.lower(F.trim(x)))).alias("part")).withColumn("pn", norm_key(F.col("part")))
    key_in = contained_pairs(asked, parts, "qn", "pn").withColumn("w", F.when(F.col("qn") == F.col("pn"), 1.0).otherwise(0.7))
    raw_in = contained_pairs(asked, parts, "ql", "part").withColumn("w", F.lit(0.6))
    back = contained_pairs(parts.filter(F.length("pn") >= 4), asked, "pn", "qn").withColumn("w", F.lit(0.4))
    ladder = (asked.join(key_in, "qn").join(parts, "pn").select(qid, "_arc", "w")
              .unionByName(asked.join(raw_in, "ql").join(parts, "part").select(qid, "_arc", "w"))
              .unionByName(asked.join(back, "qn").join(parts, "pn").select(qid, "_arc", "w")))
    best = ladder.groupBy(qid, "_arc").agg(F.max("w").alias("score"))
    return _best_assets(best.join(sigs.select("_arc", id), "_arc"), sigs, k, qid, id)


# ---- J5: composite ranker ----------------------------------------------------------------------------

WEIGHTS = {"semantic": 0.35, "tag": 0.20, "emotion": 0.20, "arc": 0.15, "importance": 0.10}
AUTO_WEIGHTS = {"semantic": 0.35, "tag": 0.25, "emotion": 0.25, "arc": 0.15, "importance": 0.10}


def _arc_matches(assets: DataFrame, queries: DataFrame, terms: Sequence[str], text: str, entities: str, qid: str, id: str, arc: str) -> DataFrame:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    keys = F.transform(F.col(entities), norm_key)
    wanted = F.array_compact(F.array(*[F.when(
        low.contains(t) | F.array_contains(keys, "".join(ch for ch in t.lower() if ch.isalnum())), F.lit(t)) for t in terms]))
    asked = queries.filter(low != "").select(qid, F.explode(wanted).alias("_term"))
    arcs = assets.select(F.col(arc).alias("_arc")).filter("_arc <> ''").distinct()
    al, an = F.lower("_arc"), norm_key(F.col("_arc"))
    held = F.array_compact(F.array(*[F.when(al.contains(t), F.struct(F.lit(t).alias("t"), F.lit(1.0).alias("w"))).when(
        an.contains("".join(ch for ch in t if ch.isalnum())), F.struct(F.lit(t).alias("t"), F.lit(0.7).alias("w"))) for t in terms]))
    known = arcs.select("_arc", F.explode(held).alias("h")).select("_arc", F.col("h.t").alias("_term"), F.col("h.w").alias("w"))
    best = asked.join(known, "_term").groupBy(qid, "_arc").agg(F.max("w").alias("arc_match"))
    return best.join(assets.select(id, F.col(arc).alias("_arc")), "_arc").select(qid, id, "arc_match")


def _planned(w: float | Column) -> bool:
    return isinstance(w, Column) or w > 0


def rank_for_beat(assets: DataFrame, beats: DataFrame, k: int = 5, weights: dict[str, float | Column] | None = None, qid: str = "query_id", id: str = "id",
                  vector: str | None = None, qvector: str | None = None, places: Sequence[str] = ARC_LOCATION_TERMS) -> DataFrame:
    """Weighted sum of similarity, tag overlap (sets), emotion, arc and importance / 5.

    ``beats``: query_id, text, entities, tags, emotion (and a vector).  A weight is a number or a
    column of the beats; a component of which the weight is the number 0 is not planned at all.

    Without vectors a query meets signatures only.  With vectors, the best k assets by similarity
    and importance give each query a score that its k-th best asset reaches at least; signatures that could
    not reach it even with a similarity of 1 are left out, and the assets of the others are compared.
    """
    w = {**dict.fromkeys(WEIGHTS, 0.0), **(weights or WEIGHTS)}
    empty = F.array().cast("array<string>")
    ents = F.coalesce(F.col("entities"), empty)
    beats = beats.withColumn("entities", ents).withColumns({f"_w_{c}": F.lit(v) if not isinstance(v, Column) else v for c, v in w.items()})
    heavy = beats.select(qid, *[f"_w_{c}" for c in w])
    semantic = _planned(w["semantic"]) and vector is not None and qvector is not None
    attrs = ["importance"]
    wide = assets
    if _planned(w["tag"]):
        joined = F.array_distinct(_tag_set(F.concat(F.coalesce(F.col("tags"), empty), F.transform(ents, lambda e: F.replace(F.lower(e), F.lit(" "), F.lit("_"))))))
        asked = beats.select(qid, joined.alias("_q")).select(qid, F.size("_q").alias("_n"), F.explode("_q").alias("_tag"))
        wide = wide.join(asked_tags(assets, asked, F.array_distinct(_tag_set(F.col("tags"))), id), id, "left").withColumn("_tags", F.coalesce("_tags", empty))
        attrs.append("_tags")
    if _planned(w["emotion"]):
        wide = wide.withColumn("emotion", F.array_join(F.array_sort(emotion_tokens(F.col("emotion"))), ","))
        attrs.append("emotion")
    if _planned(w["arc"]):
        attrs.append("arc")
    sigs = signatures(wide, attrs, k, id)
    parts = []
    if _planned(w["tag"]):
        parts.append(asked.join(sigs.select(id, F.explode("_tags").alias("_tag")), "_tag").groupBy(qid, id).agg((F.count(F.lit(1)) / F.max("_n")).alias("tag_overlap")))
    if _planned(w["emotion"]):
        parts.append(emotion_matches(sigs, beats, qid, id))
    if _planned(w["arc"]):
        parts.append(_arc_matches(sigs, beats, places, "text", "entities", qid, id, "arc"))
    names = [c for p in parts for c in p.columns if c not in (qid, id)]
    rows = [p.select(qid, id, *[(F.col(c) if c in p.columns else F.lit(None).cast("double")).alias(c) for c in names]) for p in parts]
    # the k most important signatures stand in for every one that matches nothing
    top = sigs.select(id, "importance").orderBy(F.desc(F.coalesce("importance", F.lit(3))), id).limit(k)
    ranked = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(F.coalesce("importance", F.lit(3))), id))).select("_r", id)
    every = beats.select(qid, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_r")).join(ranked, "_r").select(qid, id)
    for p in [every.select(qid, id, *[F.lit(None).cast("double").alias(c) for c in names])] if not semantic else []:
        rows.append(p)
    cand = rows[0] if rows else every.limit(0)
    for p in rows[1:]:
        cand = cand.unionByName(p)
    comp = {"tag": "tag_overlap", "emotion": "emotion_match", "arc": "arc_match"}
    base = F.col("_w_importance") * F.coalesce(F.col("importance"), F.lit(3)) / F.lit(5.0)
    full = cand.groupBy(qid, id).agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in names]) if names else cand.distinct()
    full = full.withColumns({c: F.lit(0.0) for c in comp.values() if c not in names})
    gain = base
    for name, c in comp.items():
        gain = gain + F.col(f"_w_{name}") * F.col(c)
    shown = ["semantic", *comp.values(), "importance_score"]
    full = full.join(sigs.select(id, "importance"), id).join(heavy, qid).withColumns({"importance_score": F.coalesce("importance", F.lit(3)) / 5.0})
    if not semantic:
        scored = full.withColumns({"semantic": F.lit(0.0), "score": F.round(gain, 9)}).filter("score > 0")
        return _best_assets(scored.select(qid, id, "score", *shown), sigs, k, qid, id).select(qid, id, "score", *shown, "rank")

    similar = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col(vector), F.col("_qv"))))
    asking = beats.select(qid, F.col(qvector).alias("_qv"), *[f"_w_{c}" for c in w])
    # importance counts the same for all queries here: each query's weights are divided by that of importance
    scale = F.when(F.col("_w_importance") > 0, F.col("_w_importance")).otherwise(1.0)
    seeds = top_k_vectors(assets.withColumn("_base", F.coalesce("importance", F.lit(3)) / 5.0), asking.withColumns({
        "_pull": F.col("_w_semantic") / scale, "_push": F.when(F.col("_w_importance") > 0, 1.0).otherwise(0.0)}),
        k, id, vector, qid, "_qv", weight="_pull", bonus="_base", bonus_weight="_push", clip=True)
    seeds = seeds.join(heavy, qid).withColumn("_sure", F.col("score") * scale).select(qid, id, "_sure")
    # least() and greatest() skip nulls, in Spark and in SQL: an asset without a vector counts as fully similar, and the k most important of them are seeds as well
    bare = assets.filter(F.col(vector).isNull()).select(id, (F.coalesce("importance", F.lit(3)) / 5.0).alias("_base")).orderBy(F.desc("_base"), id).limit(k)
    seeds = seeds.unionByName(bare.crossJoin(F.broadcast(heavy)).select(qid, id, (F.col("_w_semantic") + F.col("_w_importance") * F.col("_base")).alias("_sure")))
    # a query with k seeds has k assets of at least the least of their scores
    reached = top_k(seeds, k, [F.desc("_sure"), F.col(id)], qid, "_n").groupBy(qid).agg(F.when(F.count(F.lit(1)) >= k, F.min("_sure")).otherwise(0.0).alias("_least"))
    able = full.join(reached, qid, "left").filter(gain + F.col("_w_semantic") + 1e-9 >= F.coalesce("_least", F.lit(0.0)))
    group = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) if c != "_tags" else F.array_join(c, "\1") for c in attrs]
    key = F.xxhash64(*group)
    owners = wide.select(id, vector, "importance", key.alias("_sig"))
    by_sig = able.select(qid, id, *names).join(sigs.select(id, key.alias("_sig")), id).drop(id)
    pairs = by_sig.join(owners.select(F.col(id), "_sig"), "_sig").select(qid, id).unionByName(seeds.select(qid, id)).distinct()
    known = full.select(qid, F.col(id).alias("_rep"), *comp.values()).join(sigs.select(F.col(id).alias("_rep"), key.alias("_sig")), "_rep").drop("_rep")
    out = pairs.join(owners, id).join(known, [qid, "_sig"], "left").join(asking, qid).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in comp.values()})
    out = out.withColumns({"semantic": similar, "importance_score": F.coalesce("importance", F.lit(3)) / 5.0}).withColumn(
        "score", F.round(F.col("_w_semantic") * F.col("semantic") + gain, 9)).filter("score > 0")
    return top_k(out.select(qid, id, "score", *shown), k, [F.desc("score"), F.col(id)], qid)


def request_weights(text: Column, tags: Column, emotion: Column, arc: Column, weights: dict[str, float] | None = None) -> dict[str, Column]:
    """Weights of each request from what it gives: parts it lacks count nothing, the others sum to one."""
    filled = {"semantic": F.coalesce(text, F.lit("")) != "", "tag": F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0,
              "emotion": F.coalesce(emotion, F.lit("")) != "", "arc": F.coalesce(arc, F.lit("")) != ""}
    raw = {c: F.when(filled[c], F.lit(v)).otherwise(0.0) if c in filled else F.lit(v) for c, v in (weights or AUTO_WEIGHTS).items()}
    total = sum(raw.values(), F.lit(0.0))
    return {c: v / total for c, v in raw.items()}


def search(assets: DataFrame, queries: DataFrame, mode: str = "auto", k: int = 10, qid: str = "query_id", id: str = "id", vector: str | None = None,
           qvector: str | None = None, max_k: int | None = None, lexicon: DataFrame | None = None, entity_limit: int = 6,
           places: Sequence[str] = ARC_LOCATION_TERMS) -> DataFrame:
    """One entry point for all modes, over a batch of requests (query_id, text, tags, emotion, arc; nulls and empty values are not given).

    Mode "auto" weighs each request by what it gives; one that gives nothing has no result.  With a
    ``lexicon`` (term, canonical, alias_first, pos) its entities are those its text names, in the
    lexicon's order and at most ``entity_limit``.  ``max_k`` is an upper bound on ``k`` that a service may
    set; by default there is none.
    """
    k = k if max_k is None else min(k, max_k)
    if mode == "tag":
        return tag_search(assets, queries, k, qid=qid, id=id)
    if mode == "emotion":
        return emotion_search(assets, queries, k, qid=qid, id=id)
    if mode == "arc":
        return arc_search(assets, queries, k, qid=qid, id=id)
    if mode == "semantic":
        return top_k_vectors(assets, queries, k, id, vector, qid, qvector, positive=True)
    if mode != "auto":
        raise ValueError(f"unknown mode {mode!r}")
    from storyspark.operators.graph import entities_by_join

    empty = F.array().cast("array<string>")
    queries = queries.drop("entities")
    if lexicon is None:
        queries = queries.withColumn("entities", empty)
    else:
        queries = queries.join(entities_by_join(queries.select(qid, "text"), lexicon, entity_limit, "text", qid), qid, "left").withColumn(
            "entities", F.coalesce("entities", empty))
    text, tags, emotion, arc = (F.col(c) for c in ("text", "tags", "emotion", "arc"))
    something = (F.coalesce(text, F.lit("")) != "") | (F.size(F.coalesce(tags, empty)) > 0) | (F.coalesce(emotion, F.lit("")) != "") | (F.coalesce(arc, F.lit("")) != "")
    return rank_for_beat(assets, queries.filter(something), k, request_weights(text, tags, emotion, arc), qid, id, vector, qvector, places)


# ---- J14, J15: catalog entries -------------------------------------------------------------------------------

# fixed values
IGNORED_WORDS = ["one", "piece", "arc", "chapter"]
ENOUGH_POINTS = 10
#: Entries of a task, and asked words and keys that go to every task; a larger batch is joined by a shuffle.
ENTRY_ROWS, ASKED_ROWS = 100_000, 200_000


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\b[\w'-]+\b)"), 1)


def entry_scores(entries: DataFrame, queries: DataFrame, haystack: Sequence[str] = ("name", "description"), qid: str = "query_id", id: str = "id",
                 query: str = "query", entities: str = "entities", ignored: Sequence[str] = IGNORED_WORDS, minimum: int = ENOUGH_POINTS,
                 status: str = "status") -> DataFrame:
    """Points of catalog entries: name key, name words, other words, entities; below the minimum dropped.

    An entry with the ``status`` "Unknown" loses three points if it has fewer than ENOUGH_POINTS.
    """
    q = queries.select(qid, norm_key(F.col(query)).alias("qn"), F.array_distinct(F.filter(_words(F.col(query)), lambda x: (F.length(x) > 2) & ~x.isin(*ignored))).alias("qw"),
                       _words(F.col(query)).alias("_all"), F.transform(F.coalesce(entities, F.array().cast("array<string>")), norm_key).alias("en"))
    e = entries.select(id, norm_key(F.col("name")).alias("nk"), F.array_distinct(_words(F.col("name"))).alias("nt"),
                       F.array_distinct(F.concat(_words(F.concat_ws(" ", *haystack)), F.regexp_extract_all(F.lower(F.concat_ws(" ", *haystack)), F.lit(r"(?U)(\w+)"), 1))).alias("ht"))
    # a word asked twice counts twice
    words = q.select(qid, F.explode("qw").alias("_w"), "_all").select(qid, F.concat(F.lit("w"), "_w").alias("_token"), F.size(F.filter("_all", lambda x: x == F.col("_w"))).alias("_times")).select(
        qid, "_token", (F.col("_times") * 12).alias("_named"), (F.col("_times") * 2).alias("_told"))
    # the query and its entities: keys that may be inside those of entries
    needles = q.select(qid, F.explode(F.concat(F.array(F.struct(F.col("qn").alias("key"), F.lit(80).alias("same"), F.lit(40).alias("part"))), F.transform(
        "en", lambda k: F.struct(k.alias("key"), F.lit(50).alias("same"), F.lit(25).alias("part"))))).alias("n")).select(qid, "n.*").filter("key <> ''")
    inside = contained_pairs(needles, e.select("nk").filter("nk <> ''"), "key", "nk")
    keys = needles.join(inside, "key").select(qid, F.concat(F.lit("k"), "nk").alias("_token"), F.when(F.col("key") == F.col("nk"), F.col("same")).when(
        F.length("key") >= 5, F.col("part")).otherwise(0).alias("_named"), F.lit(0).alias("_told"))
    asked = cut_lineage(words.unionByName(keys).groupBy(qid, "_token").agg(F.sum("_named").alias("_named"), F.sum("_told").alias("_told")))
    # an entry meets the queries by its words and its key at once; all its points arise where it lies
    held = F.transform(F.array_union("nt", "ht"), lambda w: F.struct(F.concat(F.lit("w"), w).alias("t"), F.array_contains("nt", w).alias("n"), F.array_contains("ht", w).alias("h")))
    key = F.array(F.struct(F.concat(F.lit("k"), F.coalesce("nk", F.lit(""))).alias("t"), F.lit(True).alias("n"), F.lit(False).alias("h")))
    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // ENTRY_ROWS))
    owned = e.repartition(parts, id).select(id, F.explode(F.concat(held, key)).alias("_o")).select(id, F.col("_o.t").alias("_token"), "_o.n", "_o.h")
    met = owned.join(F.broadcast(asked) if asked.count() <= ASKED_ROWS else asked, "_token")
    gained = F.when(F.col("n"), F.col("_named")).otherwise(0) + F.when(F.col("h"), F.col("_told")).otherwise(0)
    total = met.groupBy(qid, id).agg(F.sum(gained).cast("long").alias("score"))
    if status in entries.columns:
        unknown = entries.filter(F.col(status) == "Unknown").select(id, F.lit(True).alias("_unknown"))
        total = total.join(unknown, id, "left").select(qid, id, F.when(F.col("_unknown") & (F.col("score") < ENOUGH_POINTS), F.col("score") - 3).otherwise(F.col("score")).alias("score"))
    return total.filter(F.col("score") >= minimum)


def cascade_candidates(entries: DataFrame, queries: DataFrame, aliases: DataFrame, max_results: int = 5, used: DataFrame | None = None,
                       excluded_terms: Sequence[str] = (), fruit_terms: Sequence[str] = ("fruit",), qid: str = "query_id", id: str = "id") -> DataFrame:
    """Tiered candidates: alias hits +30, entity hits +20, then best islands, characters and fruits.

    ``entries``: id, kind (island / character / devil_fruit), name, url.  ``aliases``: phrase,
    target name, kind.  A later tier joins in only while fewer than ``max_results`` are found.
    ``used`` holds url hashes seen before; they sort behind.
    """
    blob = F.lower(F.concat_ws(" ", "query", F.array_join("entities", " ")))
    q = queries.withColumn("_blob", blob)
    for term in excluded_terms:
        q = q.filter(~F.col("_blob").contains(term))
    keyed = entries.select(id, "kind", norm_key(F.col("name")).alias("nk"))
    words = q.select(qid, F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: _grams(F.col("_blob"), n)))).alias("phrase")).distinct()
    al = aliases.select(F.lower("phrase").alias("phrase"), norm_key(F.col("target")).alias("nk"), "kind")
    t1 = words.join(al, "phrase").join(keyed, ["nk", "kind"]).select(qid, id, F.when(F.col("kind") == "island", 1).otherwise(2).alias("tier"), (-F.length("phrase")).alias("pos"), F.lit(30).alias("bonus"))
    ents = q.select(qid, F.posexplode("entities").alias("pos", "_e")).withColumn("nk", norm_key(F.col("_e")))
    t2 = ents.join(keyed.filter(F.col("kind").isin("island", "character")), "nk").select(
        qid, id, F.lit(3).alias("tier"), (F.col("pos") * 2 + (F.col("kind") == "island").cast("int")).alias("pos"), F.lit(20).alias("bonus"))
    points = entry_scores(entries, q, ("name",), qid, id, minimum=0)
    scored = points.filter("score >= 10").join(entries.select(id, "kind"), id)
    best = lambda kind, n, tier: top_k(scored.filter(F.col("kind") == kind), n, [F.desc("score"), F.col(id)], qid, "pos").select(
        qid, id, F.lit(tier).alias("tier"), "pos", F.lit(0).alias("bonus"))
    fruity = q.filter(F.exists(F.array(*[F.lit(t) for t in fruit_terms]), lambda t: F.contains("_blob", t))).select(qid)
    t5 = best("devil_fruit", max_results, 6).join(fruity, qid, "left_semi")
    rows = t1.unionByName(t2).unionByName(best("island", max(2, max_results // 2), 4)).unionByName(best("character", max_results, 5)).unionByName(t5)
    rows = rows.join(entries.select(id, "kind", "name", "url"), id)
    first = Window.partitionBy(qid, "url").orderBy("tier", "pos", id)
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    found = rows.groupBy(qid).agg(F.count_if(F.col("tier") <= 3).alias("_c3"), F.count_if(F.col("tier") <= 4).alias("_c4"))
    islands_in = F.col("_c3") < max_results
    known = F.when(islands_in, F.col("_c4")).otherwise(F.col("_c3"))
    rows = rows.join(found, qid).filter(
        (F.col("tier") <= 3) | (F.col("tier") == 6) | ((F.col("tier") == 4) & islands_in) | ((F.col("tier") == 5) & (known < max_results)))
    rows = rows.join(points, [qid, id], "left").withColumns({
        "score": F.coalesce("score", F.lit(0)) + F.col("bonus"), "url_hash": url_hash(F.col("url")),
        "type_rank": F.when(F.col("kind") == "character", 0).otherwise(1)})
    if used is None:
        rows = rows.withColumn("reused", F.lit(0))
    else:
        rows = rows.join(used.select("url_hash", F.lit(1).alias("reused")).distinct(), "url_hash", "left").withColumn("reused", F.coalesce("reused", F.lit(0)))
    return top_k(rows.select(qid, id, "kind", "name", "url", "tier", "score", "reused", "type_rank"), max_results,
                 [F.desc("score"), F.col("reused"), F.col("type_rank"), F.col("name"), F.col(id)], qid)


def _grams(text: Column, n) -> Column:
    t = F.regexp_extract_all(text, F.lit(r"(?U)([\w'.-]+)"), 1)
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def url_hash(c: Column) -> Column:
    return F.md5(F.regexp_replace(c, r"[?#].*$", ""))


# ---- J16, J17: picture files -------------------------------------------------------------------------------------

VARIANT_HINT = r"\b(child|pre-timeskip|post-timeskip|hatless|falling|fake|jr\.?|young|old)\b"


def file_scores(files: DataFrame, queries: DataFrame, aliases: DataFrame, branding: Sequence[str] = (), brand_symbol: str = "",
                qid: str = "query_id", query: str = "query", variant_hint: str = VARIANT_HINT) -> DataFrame:
    """Score of indexed files per query: known aliases 22-24 (14 by their first letters), other words 12-16.

    ``files``: path, asset_kind, primary_name, variant_hint, stem.  ``aliases``: alias, asset_kind.
    """
    f = files.withColumn("_blob", F.concat_ws(" ", "primary_name", "variant_hint", "stem")).withColumn("hay", norm_key(F.col("_blob")))
    q = queries.select(qid, norm_key(F.col(query)).alias("qn"), F.lower(F.coalesce(F.col(query), F.lit(""))).alias("ql"))
    al = aliases.select("asset_kind", norm_key(F.col("alias")).alias("needle")).filter("needle <> ''").distinct()
    asked = q.join(contained_pairs(al, q, "needle", "qn"), "qn").join(al, "needle").select(qid, "asset_kind", "needle")
    full = F.when(F.col("asset_kind") == "location", 24).when(F.col("asset_kind") == "symbol", 22).otherwise(16)
    head = F.when(F.col("asset_kind") == "location", 5).otherwise(6)
    by_alias = asked.withColumn("pts", full).unionByName(
        asked.filter("asset_kind <> 'character'").select(qid, "asset_kind", F.substring(F.col("needle"), F.lit(1), head).alias("needle"), F.lit(14).alias("pts")))
    toks = q.select(qid, F.explode(F.split(F.replace(F.col("ql"), F.lit(","), F.lit(" ")), r"\s+")).alias("t")).withColumn("needle", norm_key(F.col("t")))
    toks = toks.filter(F.length("needle") >= 4).select(qid, "needle")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in (("symbol", 12), ("location", 16), ("character", 16))]))
    by_word = toks.withColumn("_k", kinds).select(qid, F.col("_k.k").alias("asset_kind"), "needle", F.col("_k.p").alias("pts"))
    needles = by_alias.unionByName(by_word).groupBy(qid, "asset_kind", "needle").agg(F.max("pts").alias("pts"))
    hits = needles.join(contained_pairs(needles, f), "needle").join(f, ["hay", "asset_kind"])
    exact = (F.col("asset_kind") == "character") & (norm_key(F.col("primary_name")) == F.col("needle"))
    best = hits.groupBy(qid, "path", "asset_kind", "variant_hint", "stem").agg(F.max(F.when(exact, 24).otherwise(F.col("pts"))).alias("score"))
    if branding:
        hit = F.exists(F.array(*[F.lit(b) for b in branding]), lambda b: F.contains("ql", b))
        brand = q.filter(hit).select(qid, F.lit("symbol").alias("asset_kind")).join(
            f.filter((F.col("asset_kind") == "symbol") & F.col("hay").contains("".join(brand_symbol.split()))), "asset_kind")
        best = best.unionByName(brand.select(qid, "path", "asset_kind", "variant_hint", "stem", F.lit(28).alias("score")))
        best = best.groupBy(qid, "path", "asset_kind", "variant_hint", "stem").agg(F.max("score").alias("score"))
    note = F.concat_ws(" ", "variant_hint", "stem")
    off = F.when((F.col("asset_kind") == "symbol") & note.contains("transparent"), 2).when(
        (F.col("asset_kind") == "location") & note.contains("zoomed"), 3).when(
        (F.col("asset_kind") == "character") & (F.coalesce("variant_hint", F.lit("")) != ""),
        F.when(F.col("variant_hint").rlike("(?i)" + variant_hint), 6).otherwise(4)).otherwise(0)
    return best.withColumn("score", F.col("score") - off)


def suggest_files(scores: DataFrame, limit: int = 5, minimum: int = 8, qid: str = "query_id") -> DataFrame:
    return top_k(scores.filter(F.col("score") >= minimum), limit, [F.desc("score"), F.col("path")], qid)


def best_file(scores: DataFrame, kinds: DataFrame, minimum: int = 10, qid: str = "query_id") -> DataFrame:
    """Best file of the kind each query wants (``kinds``: query, asset_kind)."""
    fit = scores.filter(F.col("score") >= minimum).join(kinds, [qid, "asset_kind"])
    return fit.groupBy(qid).agg(F.min_by(F.struct("path", "score"), F.struct(-F.col("score"), F.col("path"))).alias("b")).select(qid, "b.path", "b.score")


def expression_bonus(files: DataFrame, tokens: dict[str, Sequence[str]], expression: Column) -> DataFrame:
    """+6 per expression token in the file name."""
    blob = F.concat_ws(" ", "stem", "variant_hint", "filename")
    out = F
    for label, words in tokens.items():
        total = F.lit(0)
        for w in words:
            total = total + blob.contains(w).cast("int") * 6
        out = out.when(expression == label, total)
    return files.withColumn("expression_score", out.otherwise(blob.contains(expression).cast("int") * 6))


def fill_missing(slides: DataFrame, best: DataFrame, min_confidence: float = 0.55, path: str = "image_path", confidence: str = "asset_confidence",
                 on: Sequence[str] = ("script_id", "idx")) -> DataFrame:
    """Rows without a picture and with enough confidence take their best match; ``resolved`` tells which."""
    blank = F.coalesce(F.col(path), F.lit("")) == ""
    sure = F.coalesce(F.nullif(F.col(confidence), F.lit(0.0)), F.lit(1.0)) >= min_confidence
    j = slides.join(best.select(*on, F.col("path").alias("_best")), list(on), "left")
    got = blank & sure & F.col("_best").isNotNull()
    return j.withColumns({path: F.when(got, F.col("_best")).otherwise(F.col(path)), "resolved": got, "unresolved": blank & ~got}).drop("_best")


# ---- J19: union of catalogs ----------------------------------------------------------------------------------------

def merge_catalogs(sources: Sequence[DataFrame], id: str = "id", order: str = "pos") -> DataFrame:
    """First source and first position win per id.  A min_by aggregate: duplicates combine before the shuffle."""
    parts = [s.withColumn("_src", F.lit(n)) for n, s in enumerate(sources)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (id, "_src")]
    return both.filter(F.coalesce(F.col(id).cast("string"), F.lit("")) != "").groupBy(id).agg(
        F.min_by(F.struct(*rest, "_src"), F.struct("_src", order)).alias("r")).select(id, "r.*").withColumnRenamed("_src", "source_rank")


def embedding_text() -> Column:
    """Catalog row as one line for an encoder."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws(" — ", F.coalesce("name", F.lit("")), F.when(F.col("character") != F.col("name"), part("Character: ", F.col("character"))),
                       part("Arcs: ", F.col("arc")), part("Emotions: ", F.col("emotion")), part("Type: ", F.col("visual_type")),
                       part("Tags: ", F.array_join(F.col("tags"), ", ")))


def catalog_status(assets: DataFrame, tags: str = "tags") -> DataFrame:
    """Rows, categories and distinct tags of a catalog in one row."""
    head = assets.agg(F.count(F.lit(1)).alias("total_records"), F.array_sort(F.collect_set(F.when(F.col("category") != "", F.col("category")))).alias("categories"))
    index = assets.select(F.explode(_tag_set(F.col(tags))).alias("t")).distinct().agg(F.count(F.lit(1)).alias("tag_index_size"))
    return head.withColumn("_k", F.lit(1)).join(index.withColumn("_k", F.lit(1)), "_k").drop("_k")
