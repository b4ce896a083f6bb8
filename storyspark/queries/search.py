"""Queries over the catalog (part), vectors (embeddings) and the relationship graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyspark.functions import rules, text
from storyspark.operators import graph, planners, search, slides, vector
from storyspark.operators.sequence import lookup
from storyspark.plans.views import BEATS_SQL, CATALOG_SQL, beats, catalog, table
from storyspark.queries.registry import register
from storyspark.session import shared_folder

NORM = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '', 'g')"

HEADS_SQL = CATALOG_SQL + """,
heads AS (SELECT category AS query_id, * FROM catalog QUALIFY row_number() OVER (PARTITION BY category ORDER BY importance DESC, id) = 1)"""


def heads(assets):
    """The most important asset of each category, as a query batch."""
    rest = [c for c in assets.columns if c != "category"]
    return assets.groupBy(F.col("category").alias("query_id")).agg(
        F.min_by(F.struct(*rest), F.struct(-F.col("importance"), F.col("id"))).alias("h")).select("query_id", F.col("query_id").alias("category"), "h.*")


@register("s1_catalog_by_category", "id:i name:s category:s importance:i", "SELECT id, name, category, importance FROM catalog WHERE category = 'Brand#7'", CATALOG_SQL)
def s1(spark, sf):
    return catalog(spark, sf).filter("category = 'Brand#7'")


@register("p1_norm_key", "id:i nk:s tk:s", f"SELECT id, {NORM.format('name')} AS nk, {NORM.format('category')} AS tk FROM catalog", CATALOG_SQL)
def p1(spark, sf):
    return catalog(spark, sf).withColumns({"nk": text.norm_key(F.col("name")), "tk": text.norm_key(F.col("category"))})


@register("p2_split_csv", "id:i token:s", """
SELECT id, t AS token FROM (SELECT id, unnest(list_transform(string_split(emotion, ','), lambda x: lower(trim(x)))) AS t FROM catalog) WHERE t <> ''""", CATALOG_SQL)
def p2(spark, sf):
    return catalog(spark, sf).select("id", F.explode(text.split_csv(F.col("emotion"))).alias("token"))


@register("p3_embedding_text", "id:i line:s", """
SELECT id, name || CASE WHEN character <> name THEN ' — Character: ' || character ELSE '' END || ' — Arcs: ' || arc || ' — Emotions: ' || emotion
       || ' — Type: ' || visual_type || ' — Tags: ' || array_to_string(tags, ', ') AS line FROM catalog""", CATALOG_SQL)
def p3(spark, sf):
    return catalog(spark, sf).withColumn("line", search.embedding_text())


RANKED = "query_id:s id:i score:d rank:i"


@register("j2_tag_search", RANKED + " hits:i", """
SELECT query_id, id, hits / CAST(n AS DOUBLE) AS score, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits / CAST(n AS DOUBLE) DESC, id) AS rank
FROM (SELECT q.query_id, a.id, q.n, count(*) AS hits
      FROM (SELECT query_id, len(list_distinct(tags)) AS n, unnest(list_distinct(tags)) AS t FROM heads) q
      JOIN (SELECT id, lower(trim(unnest(tags))) AS t FROM catalog) a ON a.t = q.t GROUP BY ALL) QUALIFY rank <= 10""", HEADS_SQL)
def j2(spark, sf):
    a = catalog(spark, sf)
    return search.tag_search(a, heads(a), 10)


EMOTION_SQL = HEADS_SQL + """,
qe AS (SELECT query_id, unnest(list_distinct(list_transform(string_split(emotion, ','), lambda x: regexp_replace(lower(trim(x)), '[^a-z0-9]+', '', 'g')))) AS t FROM heads),
ae AS (SELECT id, unnest(list_distinct(list_transform(string_split(emotion, ','), lambda x: regexp_replace(lower(trim(x)), '[^a-z0-9]+', '', 'g')))) AS t FROM catalog),
em AS (SELECT query_id, id, sum(w) / any_value(n) AS emotion_match
       FROM (SELECT q.query_id, a.id, q.t, max(CASE WHEN q.t = a.t THEN 1.0e0 ELSE 0.6e0 END) AS w, any_value(c.n) AS n
             FROM qe q JOIN ae a ON contains(q.t, a.t) OR contains(a.t, q.t) JOIN (SELECT query_id, count(*) AS n FROM qe GROUP BY query_id) c ON c.query_id = q.query_id
             WHERE q.t <> '' AND a.t <> '' GROUP BY ALL) GROUP BY query_id, id)"""


@register("j3_emotion_search", RANKED, """
SELECT query_id, id, emotion_match AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(emotion_match, 9) DESC, id) AS rank FROM em QUALIFY rank <= 10""", EMOTION_SQL)
def j3(spark, sf):
    a = catalog(spark, sf)
    return search.emotion_search(a, heads(a), 10)


@register("j4_arc_search", RANKED, """
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM (SELECT q.query_id, a.id, max(CASE WHEN q.n = a.n THEN 1.0 WHEN contains(a.n, q.n) THEN 0.7 WHEN contains(a.p, q.l) THEN 0.6 WHEN length(a.n) >= 4 AND contains(q.n, a.n) THEN 0.4 ELSE 0 END) AS score
      FROM (SELECT r_regionkey || '' AS query_id, regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') AS n, lower(x) AS l
            FROM (SELECT r_regionkey, ['ECONOMY', 'Promo Saga', 'eco', 'small', 'standard blue'][r_regionkey + 1] AS x FROM region)) q
      JOIN (SELECT id, p, regexp_replace(p, '[^a-z0-9]+', '', 'g') AS n FROM (SELECT id, lower(trim(unnest(string_split(arc, '/')))) AS p FROM catalog)) a ON true
      GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 10""", CATALOG_SQL)
def j4(spark, sf):
    names = F.array(*[F.lit(x) for x in ("ECONOMY", "Promo Saga", "eco", "small", "standard blue")])
    q = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("query_id"), F.get(names, F.col("r_regionkey").cast("int")).alias("arc"))
    return search.arc_search(catalog(spark, sf), q, 10)


BEAT_WORDS = ["economy", "small", "blue", "hot"]
RANK_SQL = EMOTION_SQL + """,
pt AS (SELECT h.query_id, a.id, len(list_intersect(list_distinct(h.tags || [lower(replace(h.character, ' ', '_'))]), list_distinct(a.tags))) / CAST(len(list_distinct(h.tags || [lower(replace(h.character, ' ', '_'))])) AS DOUBLE) AS tag_overlap,
              a.importance, a.arc, h.name AS txt FROM heads h JOIN catalog a ON true),
ar AS (SELECT query_id, id, max(CASE WHEN contains(txt, term) AND contains(lower(arc), term) THEN 1.0 ELSE 0.0 END) AS arc_match
       FROM pt JOIN (SELECT unnest(['economy', 'small', 'blue', 'hot']) AS term) ON true GROUP BY ALL),
sc AS (SELECT query_id, id, <tag> * tag_overlap + <emotion> * coalesce(emotion_match, 0.0) + <arc> * coalesce(arc_match, 0.0) + <imp> * importance / 5.0e0 AS score, tag_overlap,
              coalesce(emotion_match, 0.0) AS emotion_match, coalesce(arc_match, 0.0) AS arc_match, importance / 5.0e0 AS importance_score
       FROM pt LEFT JOIN em USING (query_id, id) LEFT JOIN ar USING (query_id, id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= <k>)"""


def _rank_sql(tag: str, emotion: str, arc: str, imp: str, k: int) -> str:
    out = RANK_SQL
    for name, value in (("tag", tag), ("emotion", emotion), ("arc", arc), ("imp", imp), ("k", str(k))):
        out = out.replace(f"<{name}>", value)
    return out


COMPONENTS = RANKED + " tag_overlap:d emotion_match:d arc_match:d importance_score:d"


def _beats_as_queries(a):
    return heads(a).withColumns({"text": F.col("name"), "entities": F.array("character")})


@register("j5_composite_rank", COMPONENTS, "SELECT * FROM rk", _rank_sql("0.20e0", "0.20e0", "0.15e0", "0.10e0", 5))
def j5(spark, sf):
    a = catalog(spark, sf)
    return search.rank_for_beat(a, _beats_as_queries(a), 5, {**search.WEIGHTS, "semantic": 0.0}, places=BEAT_WORDS)


REQUEST_SQL = HEADS_SQL + """,
rq AS (SELECT query_id, CASE WHEN n % 3 > 0 THEN name END AS text, CASE WHEN n % 4 <> 1 THEN tags ELSE [] END AS tags, CASE WHEN n % 5 <> 2 THEN emotion ELSE '' END AS emotion,
              CASE WHEN n % 2 = 0 THEN arc END AS arc FROM (SELECT *, CAST(regexp_extract(category, '[0-9]+') AS INT) AS n FROM heads)),
wt AS (SELECT *, CASE WHEN coalesce(text, '') <> '' THEN 0.35e0 ELSE 0 END AS ws, CASE WHEN len(tags) > 0 THEN 0.25e0 ELSE 0 END AS wg,
              CASE WHEN emotion <> '' THEN 0.25e0 ELSE 0 END AS we, CASE WHEN coalesce(arc, '') <> '' THEN 0.15e0 ELSE 0 END AS wa FROM rq),
nm AS (SELECT query_id, list(c ORDER BY c)[1:6] AS ents FROM rq JOIN (SELECT DISTINCT character AS c FROM catalog) ON list_contains(regexp_extract_all(lower(text), '[a-z]+'), lower(c)) GROUP BY query_id),
rt AS (SELECT query_id, list_distinct(tags || coalesce(list_transform(ents, lambda e: replace(lower(e), ' ', '_')), [])) AS q FROM rq LEFT JOIN nm USING (query_id)),
qe AS (SELECT query_id, unnest(list_distinct(list_transform(string_split(emotion, ','), lambda x: regexp_replace(lower(trim(x)), '[^a-z0-9]+', '', 'g')))) AS t FROM rq),
ae AS (SELECT id, unnest(list_distinct(list_transform(string_split(emotion, ','), lambda x: regexp_replace(lower(trim(x)), '[^a-z0-9]+', '', 'g')))) AS t FROM catalog),
em AS (SELECT query_id, id, sum(w) / any_value(n) AS emotion_match
       FROM (SELECT q.query_id, a.id, q.t, max(CASE WHEN q.t = a.t THEN 1.0e0 ELSE 0.6e0 END) AS w, any_value(c.n) AS n
             FROM qe q JOIN ae a ON contains(q.t, a.t) OR contains(a.t, q.t) JOIN (SELECT query_id, count(*) AS n FROM qe GROUP BY query_id) c ON c.query_id = q.query_id
             WHERE q.t <> '' AND a.t <> '' GROUP BY ALL) GROUP BY query_id, id),
sc AS (SELECT w.query_id, a.id, (wg * coalesce(len(list_intersect(rt.q, list_distinct(a.tags))) / nullif(CAST(len(rt.q) AS DOUBLE), 0), 0) + we * coalesce(emotion_match, 0)
              + wa * CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest(['economy', 'small', 'blue', 'hot']) AS t) WHERE contains(w.text, t) AND contains(lower(a.arc), t)) THEN 1 ELSE 0 END
              + 0.10e0 * a.importance / 5.0e0) / (ws + wg + we + wa + 0.10e0) AS score
       FROM wt w JOIN catalog a ON true JOIN rt ON rt.query_id = w.query_id LEFT JOIN em ON em.query_id = w.query_id AND em.id = a.id
       WHERE ws + wg + we + wa > 0)"""


@register("j5b_auto_search", RANKED, """
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 80""", REQUEST_SQL)
def j5b(spark, sf):
    """A mixed batch: each request gives other parts, and names in its text are its entities."""
    a = catalog(spark, sf)
    n = F.regexp_extract("category", "[0-9]+", 0).cast("int")
    requests = heads(a).select("query_id", F.when(n % 3 > 0, F.col("name")).alias("text"), F.when(n % 4 != 1, F.col("tags")).otherwise(F.array().cast("array<string>")).alias("tags"),
                               F.when(n % 5 != 2, F.col("emotion")).otherwise("").alias("emotion"), F.when(n % 2 == 0, F.col("arc")).alias("arc"))
    known = a.select(F.col("character").alias("term")).distinct()
    known = known.withColumns({"canonical": F.col("term"), "alias_first": F.lit(1), "pos": F.col("term")})
    return search.search(a, requests, "auto", 80, lexicon=known, places=BEAT_WORDS)


# ---- vectors -------------------------------------------------------------------------------------

CENTROIDS = """
ev AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
cen AS (SELECT CAST(label AS VARCHAR) AS query_id, label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM ev GROUP BY ALL) GROUP BY label),
vv AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
sim AS (SELECT c.query_id, v.vec_id, v.label, c.label AS qlabel, list_cosine_similarity(v.e, c.q) AS similarity FROM cen c JOIN vv v ON true)"""


def centroids(spark, sf):
    """Mean vector of each label: (label, position) means are combined before the shuffle."""
    e = table(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("q")).withColumn("query_id", F.col("label").cast("string"))


HIT = "query_id:s vec_id:i similarity:d rank:i"


@register("j20_vector_top_k", HIT, "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sim QUALIFY rank <= 10", CENTROIDS)
def j20(spark, sf):
    return vector.top_k_vectors(table(spark, sf, "embeddings"), centroids(spark, sf), 10, qvector="q")


@register("j20_lists_all_probes", HIT, "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sim QUALIFY rank <= 10", CENTROIDS)
def j20_lists(spark, sf):
    """Inverted lists give the exact result if all of them are probed."""
    index = vector.build_lists(table(spark, sf, "embeddings"))
    return vector.search_lists(index, centroids(spark, sf), 10, len(index.centroids), qvector="q")


@register("j20_lists_recall", "queries:i k:i recall_reached:b", """
SELECT count(*) AS queries, 10 AS k, true AS recall_reached FROM embeddings WHERE vec_id % 5 = 0""")
def j20_recall(spark, sf):
    """Recall of the lists against the exact search, over the whole table and a fifth of it as queries: 0.95 at least.

    These vectors point everywhere alike, the hardest case for lists: it takes four fifths of them.
    """
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector.build_lists(e)
    near = vector.search_lists(index, q, 10, -(-4 * len(index.centroids) // 5)).select("query_id", "vec_id")
    exact = vector.top_k_vectors(e, q, 10).select("query_id", "vec_id")
    found = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return found.agg(F.countDistinct("query_id").alias("queries"), (F.count(F.lit(1)) / F.countDistinct("query_id")).cast("long").alias("k"),
                     (F.count("hit") / F.count(F.lit(1)) >= 0.95).alias("recall_reached"))


@register("j20_vector_top_k_filtered", HIT, """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sim WHERE label = qlabel QUALIFY rank <= 5""", CENTROIDS)
def j20_filtered(spark, sf):
    return vector.top_k_vectors(table(spark, sf, "embeddings"), centroids(spark, sf), 5, qvector="q", same="label")


@register("j21_retrieval_context", "query_id:s context:s", """
SELECT query_id, string_agg('- vector ' || vec_id || ' (Character: label' || label || ')', chr(10) ORDER BY rank) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sim QUALIFY rank <= 5) GROUP BY query_id""", CENTROIDS)
def j21(spark, sf):
    e = table(spark, sf, "embeddings")
    hits = vector.top_k_vectors(e, centroids(spark, sf), 5, qvector="q").join(e.select("vec_id", "label"), "vec_id")
    named = hits.withColumn("character", F.concat(F.lit("label"), "label"))
    # a vector without a label keeps its rank, but has no line
    return vector.context_text(named.withColumn("text", F.when(F.col("character").isNotNull(), F.concat(F.lit("vector "), "vec_id")))).withColumn("context", F.nullif("context", F.lit("")))


@register("j5_semantic_rank", "query_id:s id:i score:d semantic:d tag_overlap:d importance_score:d rank:i", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
FROM (SELECT query_id, vec_id AS id, greatest(0.0, least(1.0, similarity)) AS semantic, CASE WHEN vec_id % 7 = CAST(query_id AS BIGINT) % 7 THEN 1.0 ELSE 0.0 END AS tag_overlap,
             (1 + vec_id % 5) / 5.0e0 AS importance_score,
             0.35e0 * greatest(0.0, least(1.0, similarity)) + 0.20e0 * CASE WHEN vec_id % 7 = CAST(query_id AS BIGINT) % 7 THEN 1.0 ELSE 0.0 END + 0.10e0 * (1 + vec_id % 5) / 5.0e0 AS score FROM sim)
QUALIFY rank <= 8""", CENTROIDS)
def j5_semantic(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("id"), "embedding", (1 + F.col("vec_id") % 5).alias("importance"), F.array(F.concat(F.lit("g"), F.col("vec_id") % 7)).alias("tags"),
                 F.lit("").alias("emotion"), F.lit("").alias("arc"))
    # joins do not meet a null id: the query of rows without a label has a name meanwhile that no label gives
    q = centroids(spark, sf).select(F.coalesce("query_id", F.lit("none")).alias("query_id"), "q", F.array(F.concat(F.lit("g"), F.col("label") % 7)).alias("tags"), F.lit("").alias("text"),
                                    F.array().cast("array<string>").alias("entities"), F.lit("").alias("emotion"))
    ranked = search.rank_for_beat(a, q, 8, {"semantic": 0.35, "tag": 0.20, "importance": 0.10}, vector="embedding", qvector="q")
    return ranked.withColumn("query_id", F.nullif("query_id", F.lit("none")))


@register("s10_collection_rows", "collection:s rows:i ids:i", """
SELECT 'embeddings' AS collection, count(*) AS rows, count(DISTINCT vec_id) AS ids FROM embeddings""")
def s10(spark, sf):
    rows = vector.collection_rows(table(spark, sf, "embeddings").withColumn("text", F.col("vec_id").cast("string")), "embeddings", parts=("vec_id",))
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"))


@register("s10_loaded_twice", "collection:s rows:i ids:i again:i", """
SELECT 'embeddings' AS collection, count(*) AS rows, count(DISTINCT vec_id) AS ids, 0 AS again FROM embeddings""")
def s10_twice(spark, sf):
    """Half of the rows are loaded, then all, then all once more: each is stored once."""
    path = f"{shared_folder(spark).rstrip('/')}/collection-{uuid.uuid4().hex}"
    rows = table(spark, sf, "embeddings").withColumn("text", F.col("vec_id").cast("string"))
    for part in (rows.filter("vec_id % 2 = 0"), rows):
        vector.append_collection(part, path, "embeddings", parts=("vec_id",))
    again = vector.append_collection(rows, path, "embeddings", parts=("vec_id",))
    return spark.read.parquet(path).groupBy("collection").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids")).withColumn("again", F.lit(again))


@register("s11_stale_rows", "doc_id:i content_hash:s", """
SELECT d.doc_id, md5(d.text) AS content_hash FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality = 0""")
def s11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    # vectors are stored for labelled documents; those of low quality were made from an older text
    stored = d.join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.md5(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit(" old")))).alias("content_hash"))
    return vector.stale_rows(d, stored, "doc_id")


@register("s11_stored_status", "current_rows:i reusable:i to_encode:i outdated:i", """
SELECT count(*) AS current_rows, count(*) FILTER (l.quality = 1) AS reusable, count(*) FILTER (l.quality IS NULL OR l.quality = 0) AS to_encode,
       count(*) FILTER (l.quality = 0) AS outdated FROM documents d LEFT JOIN labels l USING (doc_id)""")
def s11_status(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    stored = d.join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.md5(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit(" old")))).alias("content_hash"))
    return vector.stored_status(d, stored, "doc_id")


# ---- graph -----------------------------------------------------------------------------------------

EDGES_SQL = HEADS_SQL + """,
ppl AS (SELECT * FROM catalog WHERE NOT contains(visual_type, 'arc')),
arcs AS (SELECT DISTINCT id, lower(trim(unnest(string_split(arc, '/')))) AS t FROM ppl),
emos AS (SELECT DISTINCT id, lower(trim(unnest(string_split(emotion, ',')))) AS t FROM ppl),
nmt AS (SELECT DISTINCT id, name, regexp_replace(unnest(string_split(lower(name || ' ' || character), ' ')), '[^a-z0-9]+', '', 'g') AS t FROM catalog),
tg AS (SELECT id, tag, regexp_replace(lower(tag), '[^a-z0-9]+', '', 'g') AS t FROM (SELECT id, unnest(tags) AS tag FROM heads)),
cats AS (SELECT category FROM catalog GROUP BY category HAVING count(*) BETWEEN 2 AND 20),
raw AS (
  SELECT a.id AS src, b.id AS dst, 1 AS seq, 'associated_with' AS type, 0.12e0 AS weight, 'Tag ''' || a.tag || ''' references ' || b.name AS evidence
  FROM tg a JOIN nmt b USING (t) WHERE length(a.t) >= 3 AND a.id <> b.id
  UNION ALL
  SELECT src, dst, 2, 'associated_with', least(0.25e0, 0.08e0 * n), 'Shared arcs: ' || array_to_string(ts[1:3], ', ')
  FROM (SELECT a.id AS src, b.id AS dst, count(*) AS n, list(a.t ORDER BY a.t) AS ts FROM arcs a JOIN heads h ON h.id = a.id JOIN arcs b ON a.t = b.t AND a.id <> b.id GROUP BY ALL)
  UNION ALL
  SELECT src, dst, 3, 'contrasts', least(0.15e0, 0.05e0 * n), 'Shared emotions: ' || array_to_string(ts[1:3], ', ')
  FROM (SELECT a.id AS src, b.id AS dst, count(*) AS n, list(a.t ORDER BY a.t) AS ts FROM emos a JOIN heads h ON h.id = a.id JOIN emos b ON a.t = b.t AND a.id <> b.id GROUP BY ALL) WHERE n >= 2
  UNION ALL
  SELECT a.id, b.id, 4, 'allies_with', 0.10e0, 'Same group: ' || a.category FROM heads a JOIN catalog b ON a.category = b.category AND a.id <> b.id WHERE a.category IN (SELECT category FROM cats)),
ed AS (SELECT src, dst, sum(weight) AS weight, arg_max(type, (CASE type WHEN 'allies_with' THEN 4 WHEN 'contrasts' THEN 2 ELSE 1 END, seq)) AS type,
              array_to_string(list_distinct(list(evidence)), '') AS ignored, len(list_distinct(list(evidence))) AS evidence_count FROM raw GROUP BY src, dst)"""


def _nodes(spark, sf):
    return catalog(spark, sf)


def _edges(nodes):
    return graph.combine_edges(graph.mine_edges(nodes, heads(nodes).select("id")))


@register("j10_mine_edges", "src:i dst:i seq:i type:s weight:d evidence:s", "SELECT * FROM raw", EDGES_SQL)
def j10(spark, sf):
    n = _nodes(spark, sf)
    return graph.mine_edges(n, heads(n).select("id"))


@register("a1_combine_edges", "src:i dst:i weight:d type:s evidence_count:i", "SELECT * FROM ed", EDGES_SQL)
def a1(spark, sf):
    return _edges(_nodes(spark, sf)).withColumn("evidence_count", F.size("evidence"))


@register("j13_ranked_relationships", "src:i dst:i score:d relationship:s rank:i", """
SELECT src, dst, score, type AS relationship, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) AS rank
FROM (SELECT src, dst, type, least(1.0, greatest(0.0, weight + importance / 5.0e0 * 0.10e0)) AS score FROM ed JOIN catalog c ON c.id = ed.dst) QUALIFY rank <= 10""", EDGES_SQL)
def j13(spark, sf):
    n = _nodes(spark, sf)
    return graph.rank_relationships(_edges(n), n)


@register("j11_mutual_connections", "pair_id:s dst:i score:d rank:i", """
SELECT pair_id, dst, score, row_number() OVER (PARTITION BY pair_id ORDER BY round(score, 9) DESC, dst) AS rank
FROM (SELECT p.pair_id, x.dst, least(1.0, (x.weight + y.weight) / 2) AS score
      FROM (SELECT category AS pair_id, id AS a, lead(id) OVER (ORDER BY category) AS b FROM heads) p
      JOIN ed x ON x.src = p.a JOIN ed y ON y.src = p.b AND y.dst = x.dst WHERE x.dst NOT IN (p.a, p.b)) QUALIFY rank <= 5""", EDGES_SQL)
def j11(spark, sf):
    n = _nodes(spark, sf)
    h = heads(n)
    # one row per category: neighbours in name order form the pairs
    pairs = h.select(F.col("category").alias("pair_id"), F.col("id").alias("a"), F.lead("id").over(Window.orderBy("category")).alias("b")).filter("b IS NOT NULL")
    return graph.mutual_connections(_edges(n), pairs, n)


@register("a9_node_directory", "id:i name:s category:s importance:i relationship_count:i names:s", f"""
SELECT id, character AS name, category, importance, CASE WHEN id IN (SELECT id FROM heads) THEN coalesce(n, 0) END AS relationship_count,
       id || ',' || {NORM.format('name')} || CASE WHEN {NORM.format('character')} NOT IN ('', {NORM.format('name')}) THEN ',' || {NORM.format('character')} ELSE '' END AS names
FROM catalog LEFT JOIN (SELECT src, count(*) AS n FROM ed GROUP BY src) ON src = id""", EDGES_SQL)
def a9_nodes(spark, sf):
    n = _nodes(spark, sf)
    return graph.node_directory(n, _edges(n), heads(n)).withColumn("names", F.array_join("resolvable_names", ","))


@register("a9_degree_estimates", "id:i relationship_count:i close:b", """
SELECT id, coalesce(n, 0) AS relationship_count, true AS close FROM catalog LEFT JOIN (SELECT src, count(*) AS n FROM ed GROUP BY src) ON src = id""",
          EDGES_SQL.replace(HEADS_SQL, CATALOG_SQL + ",\nheads AS (SELECT * FROM catalog)"))
def a9_degrees(spark, sf):
    """The estimate of every node against its exact number, here mined for all nodes: within 5 % and two."""
    n = _nodes(spark, sf)
    out = graph.node_directory(n, None, estimates=graph.degree_estimates(n), degrees=graph.exact_degrees(n))
    gap = F.abs(F.col("relationship_estimate") - F.col("relationship_count"))
    return out.withColumn("close", gap <= 0.05 * F.col("relationship_count") + 2)


@register("a9_catalog_status", "total_records:i categories:s tag_index_size:i", """
SELECT count(*) AS total_records, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
       (SELECT count(DISTINCT lower(trim(t))) FROM (SELECT unnest(tags) AS t FROM catalog)) AS tag_index_size FROM catalog""", CATALOG_SQL)
def a9_catalog(spark, sf):
    return search.catalog_status(catalog(spark, sf)).withColumn("categories", F.array_join("categories", ","))


@register("a9_graph_status", "node_count:i mined_edges:i mined_nodes:i", """
SELECT (SELECT count(*) FROM catalog) AS node_count, count(*) AS mined_edges, count(DISTINCT src) AS mined_nodes FROM ed""", EDGES_SQL)
def a9_graph(spark, sf):
    n = _nodes(spark, sf)
    return graph.graph_status(n, _edges(n))


NAMES = CATALOG_SQL + f""",
ix0 AS (SELECT {NORM.format("name")} AS k, id, 2 AS prio, id * 3 AS pos FROM catalog UNION ALL SELECT {NORM.format("character")}, id, 2, id * 3 + 1 FROM catalog
        UNION ALL SELECT CAST(id AS VARCHAR), id, 0, id * 3 + 2 FROM catalog),
ix AS (SELECT k, arg_min(id, (prio, pos)) AS id, min(pos) AS pos FROM ix0 GROUP BY k),
qn AS (SELECT s_suppkey AS query_id, regexp_replace(lower(CASE s_suppkey % 5 WHEN 0 THEN 'Gear' WHEN 1 THEN 'The Red Widget' WHEN 2 THEN 'small' WHEN 3 THEN s_name ELSE 'bol' END), '[^a-z0-9]+', '', 'g') AS k FROM supplier)"""


@register("j9_resolve_names", "query_id:i node_id:i how:s", """
SELECT q.query_id, ix.id AS node_id, 'exact' AS how FROM qn q JOIN ix USING (k)
UNION ALL SELECT q.query_id, arg_min(ix.id, ix.pos), 'contained' FROM qn q JOIN ix ON contains(ix.k, q.k) OR contains(q.k, ix.k)
WHERE q.k NOT IN (SELECT k FROM ix) GROUP BY q.query_id""", NAMES)
def j9(spark, sf):
    n = catalog(spark, sf).withColumn("pos", F.col("id"))
    s = table(spark, sf, "supplier")
    m = F.col("s_suppkey") % 5
    name = F.when(m == 0, "Gear").when(m == 1, "The Red Widget").when(m == 2, "small").when(m == 3, F.col("s_name")).otherwise("bol")
    return graph.resolve_names(s.select(F.col("s_suppkey").alias("query_id"), name.alias("name")), graph.name_index(n))


# ---- catalog entries ----------------------------------------------------------------------------------

ENTRY_SQL = HEADS_SQL + """,
qq AS (SELECT query_id, name || ' ' || lower(category) AS query, [character, name] AS ents FROM heads),
qw AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9_''-]+')) AS w FROM qq),
ew AS (SELECT id, unnest(regexp_extract_all(lower(name), '[a-z0-9_''-]+')) AS w FROM catalog),
hw AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(list_concat(regexp_extract_all(lower(name || ' ' || arc), '[a-z0-9_''-]+'), regexp_extract_all(lower(name || ' ' || arc), '[a-z0-9_]+'))) AS w FROM catalog)),
pts AS (
  SELECT query_id, id, count(*) * 12 AS p FROM qw JOIN (SELECT DISTINCT id, w FROM ew) e USING (w) WHERE length(w) > 2 AND w NOT IN ('one', 'piece', 'arc', 'chapter') GROUP BY ALL
  UNION ALL SELECT query_id, id, count(*) * 2 FROM qw JOIN hw USING (w) WHERE length(w) > 2 AND w NOT IN ('one', 'piece', 'arc', 'chapter') GROUP BY ALL
  UNION ALL SELECT query_id, id, CASE WHEN n = k THEN 80 WHEN length(n) >= 5 THEN 40 ELSE 0 END
  FROM (SELECT query_id, regexp_replace(lower(query), '[^a-z0-9]+', '', 'g') AS n FROM qq) JOIN (SELECT id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k FROM catalog) ON contains(k, n)
  UNION ALL SELECT query_id, id, sum(CASE WHEN n = k THEN 50 WHEN length(n) >= 5 THEN 25 ELSE 0 END)
  FROM (SELECT query_id, regexp_replace(lower(unnest(ents)), '[^a-z0-9]+', '', 'g') AS n FROM qq) JOIN (SELECT id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k FROM catalog) ON contains(k, n) GROUP BY ALL),
es AS (SELECT query_id, id, sum(p) AS score FROM pts GROUP BY ALL HAVING sum(p) >= 10)"""


def _entries(spark, sf):
    a = catalog(spark, sf)
    q = heads(a).select("query_id", F.concat_ws(" ", "name", F.lower("category")).alias("query"), F.array("character", "name").alias("entities"))
    return a, q


@register("j14_entry_scores", "query_id:s id:i score:i", "SELECT * FROM es", ENTRY_SQL)
def j14(spark, sf):
    a, q = _entries(spark, sf)
    return search.entry_scores(a, q, ("name", "arc"))


@register("j14_unknown_entries", "query_id:s id:i score:i", """
SELECT query_id, id, score FROM (SELECT query_id, id, CASE WHEN id % 3 = 0 AND score < 10 THEN score - 3 ELSE score END AS score FROM es0) WHERE score >= 1""",
          ENTRY_SQL + ",\nes0 AS (SELECT query_id, id, sum(p) AS score FROM pts GROUP BY ALL)")
def j14_unknown(spark, sf):
    """Entries of unknown status that score little lose three points more."""
    a, q = _entries(spark, sf)
    return search.entry_scores(a.withColumn("status", F.when(F.col("id") % 3 == 0, "Unknown").otherwise("Alive")), q, ("name", "arc"), minimum=1)


@register("t1_top_k_entries", "query_id:s id:i score:i rank:i", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM es QUALIFY rank <= 5", ENTRY_SQL)
def t1(spark, sf):
    a, q = _entries(spark, sf)
    return search.top_k(search.entry_scores(a, q, ("name", "arc")), 5, [F.desc("score"), F.col("id")])


CASCADE_SQL = ENTRY_SQL.replace("name || ' ' || arc", "name") + f""",
en AS (SELECT id, name, ['island', 'character', 'devil_fruit'][CAST(id % 3 AS INTEGER) + 1] AS kind, 'http://img/' || name || '?v=' || (id % 2) AS url, {NORM.format('name')} AS nk FROM catalog),
bl AS (SELECT query_id, ents, lower(query || ' ' || array_to_string(ents, ' ')) AS blob FROM qq),
po AS (SELECT query_id, id, sum(p) AS score FROM pts GROUP BY ALL),
aa AS (SELECT DISTINCT lower(string_split(name, ' ')[1]) AS phrase, {NORM.format('name')} AS nk FROM catalog WHERE id % 30 = 0),
by_kind AS (SELECT query_id, id, kind, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) AS pos FROM po JOIN en USING (id) WHERE score >= 10),
tiers AS (
  SELECT DISTINCT query_id, id, 1 AS tier, -length(phrase) AS pos, 30 AS bonus FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(blob, '[A-Za-z0-9_''.-]+')) AS phrase FROM bl) JOIN aa USING (phrase) JOIN en USING (nk) WHERE kind = 'island'
  UNION ALL SELECT query_id, id, 3, i * 2 + CAST(kind = 'island' AS INTEGER), 20 FROM (SELECT query_id, unnest([0, 1]) AS i, unnest(ents) AS e FROM bl) JOIN en ON nk = {NORM.format('e')} WHERE kind IN ('island', 'character')
  UNION ALL SELECT query_id, id, 4, pos, 0 FROM by_kind WHERE kind = 'island' AND pos <= 2
  UNION ALL SELECT query_id, id, 5, pos, 0 FROM by_kind WHERE kind = 'character' AND pos <= 5
  UNION ALL SELECT query_id, id, 6, pos, 0 FROM by_kind JOIN bl USING (query_id) WHERE kind = 'devil_fruit' AND pos <= 5 AND contains(blob, 'brand#1')),
once AS (SELECT t.*, kind, name FROM tiers t JOIN en USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY tier, pos, id) = 1),
cn AS (SELECT query_id, count(*) FILTER (tier <= 3) AS c3, count(*) FILTER (tier <= 4) AS c4 FROM once GROUP BY query_id)"""


@register("j15_cascading_candidates", "query_id:s id:i kind:s tier:i score:i rank:i", """
SELECT query_id, id, kind, tier, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE WHEN kind = 'character' THEN 0 ELSE 1 END, name, id) AS rank
FROM (SELECT o.*, coalesce(po.score, 0) + bonus AS score FROM once o JOIN cn USING (query_id) LEFT JOIN po USING (query_id, id)
      WHERE tier <= 3 OR tier = 6 OR tier = 4 AND c3 < 5 OR tier = 5 AND CASE WHEN c3 < 5 THEN c4 ELSE c3 END < 5)
QUALIFY rank <= 5""", CASCADE_SQL)
def j15(spark, sf):
    """Aliases are the first words of some entries' names."""
    a, q = _entries(spark, sf)
    kind = F.when(F.col("id") % 3 == 0, "island").when(F.col("id") % 3 == 1, "character").otherwise("devil_fruit")
    e = a.select("id", "name", kind.alias("kind"), F.concat(F.lit("http://img/"), "name", F.lit("?v="), F.col("id") % 2).alias("url"))
    aliases = a.filter("id % 30 = 0").select(F.get(F.split("name", " "), 0).alias("phrase"), F.col("name").alias("target"), F.lit("island").alias("kind")).distinct()
    return search.cascade_candidates(e, q, aliases, fruit_terms=("brand#1",))


FILE_SQL = ENTRY_SQL + f""",
fl AS (SELECT id, ['symbol', 'location', 'character'][CAST(id % 3 AS INTEGER) + 1] AS kind, id % 5 = 0 AS young, {NORM.format('name')} AS nk,
              {NORM.format('name')} || CASE WHEN id % 5 = 0 THEN 'young' ELSE '' END || {NORM.format('name')} AS hay FROM catalog),
al AS (SELECT DISTINCT {NORM.format('character')} AS needle FROM catalog),
asked AS (SELECT query_id, needle FROM qq JOIN al ON needle <> '' AND contains({NORM.format('query')}, needle)),
nd AS (SELECT query_id, kind, needle, max(p) AS p FROM (
    SELECT query_id, 'location' AS kind, needle, 24 AS p FROM asked UNION ALL SELECT query_id, 'symbol', needle, 22 FROM asked
    UNION ALL SELECT query_id, 'location', substr(needle, 1, 5), 14 FROM asked UNION ALL SELECT query_id, 'symbol', substr(needle, 1, 6), 14 FROM asked
    UNION ALL SELECT query_id, k, {NORM.format('t')}, CASE k WHEN 'symbol' THEN 12 ELSE 16 END
    FROM (SELECT query_id, unnest(string_split(replace(lower(query), ',', ' '), ' ')) AS t FROM qq), (SELECT unnest(['symbol', 'location', 'character']) AS k) WHERE length({NORM.format('t')}) >= 4)
  GROUP BY ALL),
sc AS (SELECT query_id, f.kind || '/' || f.id || '.png' AS path, f.kind AS asset_kind,
              max(CASE WHEN f.kind = 'character' AND f.nk = needle THEN 24 ELSE p END) - CASE WHEN f.kind = 'character' AND f.young THEN 6 ELSE 0 END AS score
       FROM nd JOIN fl f ON f.kind = nd.kind AND contains(hay, needle) GROUP BY query_id, f.id, f.kind, f.young)"""


def _picture_scores(spark, sf):
    a, q = _entries(spark, sf)
    kind = F.when(F.col("id") % 3 == 0, "symbol").when(F.col("id") % 3 == 1, "location").otherwise("character")
    files = a.select(F.concat_ws("/", kind, F.concat(F.col("id").cast("string"), F.lit(".png"))).alias("path"), kind.alias("asset_kind"), F.col("name").alias("primary_name"),
                     F.when(F.col("id") % 5 == 0, "young").otherwise("").alias("variant_hint"), F.col("name").alias("stem"))
    aliases = a.groupBy("character").agg(F.count(F.lit(1)).alias("n")).select(F.col("character").alias("alias"), F.explode(F.array(F.lit("symbol"), F.lit("location"))).alias("asset_kind"))
    return search.file_scores(files, q, aliases), q


@register("j16_file_suggestions", "query_id:s path:s asset_kind:s score:i rank:i", """
SELECT query_id, path, asset_kind, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM sc WHERE score >= 8 QUALIFY rank <= 5""", FILE_SQL)
def j16(spark, sf):
    return search.suggest_files(_picture_scores(spark, sf)[0])


@register("j16_best_file", "query_id:s path:s score:i", """
SELECT query_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS n
  FROM sc WHERE score >= 10 AND asset_kind = CASE WHEN contains(query_id, '1') THEN 'character' ELSE 'location' END) WHERE n = 1""", FILE_SQL)
def j16_best(spark, sf):
    scores, q = _picture_scores(spark, sf)
    kinds = q.select("query_id", F.when(F.col("query_id").contains("1"), "character").otherwise("location").alias("asset_kind"))
    return search.best_file(scores, kinds)


@register("f24_asset_metadata", "query_id:s tags:s rank:i id:i score:d", """
SELECT rk.query_id, rank, rk.id, round(rk.score, 4) AS score,
       CASE WHEN contains(' ' || name || ' ', ' ' || character || ' ') THEN name || ' character' ELSE name || ' ' || character || ' character' END AS tags
FROM rk JOIN heads USING (query_id)""", _rank_sql("0.20e0", "0.20e0", "0.15e0", "0.10e0", 3).replace(
    "heads AS (SELECT category", "heads0 AS (SELECT category", 1).replace(",\nqe AS", ",\nheads AS (SELECT * REPLACE (list_distinct(string_split(name, ' ') || [character, 'character']) AS tags) FROM heads0),\nqe AS", 1))
def f24(spark, sf):
    """Metadata of a slide per category, with its three best assets."""
    a = catalog(spark, sf)
    shown = heads(a).select("query_id", F.lit(0).alias("idx"), F.col("name").alias("query"), F.lit("").alias("subtitle_text"), F.lit("").alias("summary"), F.lit("").alias("viewer_focus"),
                            F.lit("character").alias("visual_role"), F.array("character").alias("entities"), "emotion", F.lit(0.5).alias("asset_confidence"))
    out = slides.asset_metadata(shown, a, key=("query_id", "idx"), places=BEAT_WORDS, unicode=False)
    m = F.col("asset_metadata")
    return out.select("query_id", F.array_join(m["search_tags"], " ").alias("tags"), F.posexplode(m["ranked_assets"]).alias("n", "r")).select(
        "query_id", "tags", (F.col("n") + 1).alias("rank"), "r.id", "r.score")


@register("j17_fill_missing", "script_id:i idx:i image_path:s resolved:b unresolved:b", """
SELECT b.script_id, b.idx, CASE WHEN CAST(b.asset_id AS BIGINT) % 2 = 0 THEN 'own/' || b.asset_id WHEN b.intensity >= 0.1 THEN f.path END AS image_path,
       CAST(b.asset_id AS BIGINT) % 2 = 1 AND b.intensity >= 0.1 AND f.path IS NOT NULL AS resolved,
       CAST(b.asset_id AS BIGINT) % 2 = 1 AND NOT (b.intensity >= 0.1 AND f.path IS NOT NULL) AS unresolved
FROM beats b LEFT JOIN (SELECT 'query ' || (p_partkey % 10) AS query, min('file/' || p_name) AS path FROM part GROUP BY 1) f ON f.query = b.query""", BEATS_SQL)
def j17(spark, sf):
    b = beats(spark, sf)
    slides = b.withColumns({"image_path": F.when(F.col("asset_id").cast("long") % 2 == 0, F.concat(F.lit("own/"), "asset_id")),
                            "asset_confidence": F.greatest("intensity", F.lit(1e-9))})
    files = table(spark, sf, "part").groupBy(F.concat(F.lit("query "), F.col("p_partkey") % 10).alias("query")).agg(F.min(F.concat(F.lit("file/"), "p_name")).alias("path"))
    return search.fill_missing(slides, b.join(files, "query").select("script_id", "idx", "path"), 0.1)


@register("j18_rule_matrix", "script_id:i idx:i strategy:s motion:s fallback:s goal:s transition:s", """
SELECT script_id, idx, coalesce(CASE beat_type || '/' || visual_role WHEN 'hook/character' THEN 'hero_reveal' WHEN 'hook/symbol' THEN 'symbol_dramatic' WHEN 'hook/location' THEN 'establishing_wide'
         WHEN 'hook/evidence' THEN 'evidence_inspect' WHEN 'evidence/evidence' THEN 'evidence_inspect' WHEN 'evidence/character' THEN 'character_context' WHEN 'evidence/symbol' THEN 'symbol_dramatic'
         WHEN 'evidence/location' THEN 'establishing_wide' WHEN 'reveal/character' THEN 'hero_reveal' WHEN 'reveal/symbol' THEN 'symbol_dramatic' WHEN 'reveal/evidence' THEN 'evidence_inspect'
         WHEN 'reveal/location' THEN 'establishing_wide' WHEN 'escalation/character' THEN 'hero_reveal' WHEN 'escalation/symbol' THEN 'symbol_dramatic' WHEN 'escalation/evidence' THEN 'evidence_inspect'
         WHEN 'escalation/location' THEN 'establishing_wide' WHEN 'warning/character' THEN 'character_dread' WHEN 'warning/symbol' THEN 'symbol_dramatic' END,
         CASE visual_role WHEN 'evidence' THEN 'evidence_inspect' WHEN 'character' THEN 'character_context' WHEN 'symbol' THEN 'symbol_dramatic' WHEN 'location' THEN 'establishing_wide' END) AS strategy,
       CASE emotion WHEN 'fear' THEN 'dramatic_push' WHEN 'calm' THEN 'slow_pan' WHEN 'rage' THEN 'impact_shake' WHEN 'grief' THEN 'grief_hold' ELSE 'subject_push' END AS motion,
       CASE emotion WHEN 'fear' THEN 'tension_drift' WHEN 'calm' THEN 'evidence_hold' WHEN 'rage' THEN 'dramatic_push' ELSE 'slow_pan' END AS fallback,
       CASE visual_role WHEN 'character' THEN 'face_lock_push' WHEN 'evidence' THEN 'inspect_detail' WHEN 'location' THEN 'wide_context_pan' ELSE 'centered_icon_hold' END AS goal,
       CASE beat_type WHEN 'reveal' THEN 'zoom_dissolve' WHEN 'escalation' THEN 'whip_pan_right' ELSE 'crossfade' END AS transition
FROM beats""", BEATS_SQL)
def j18(spark, sf):
    from storyspark.operators.composition import strategy
    from storyspark.operators.sequence import TRANSITION_BY_BEAT

    b = planners.motion_candidates(beats(spark, sf))
    return b.withColumns({"strategy": strategy(F.col("beat_type"), F.col("visual_role")), "motion": F.col("_primary"), "fallback": F.col("_fallback"),
                          "goal": lookup(planners.ROLE_GOALS, F.col("visual_role")), "transition": lookup(TRANSITION_BY_BEAT, F.col("beat_type"), "crossfade")})


@register("j19_merge_catalogs", "id:s name:s source_rank:i", """
SELECT k AS id, arg_min(name, (src, pos)) AS name, min(src) AS source_rank
FROM (SELECT p_name AS k, p_name || ' of ' || p_brand AS name, 0 AS src, p_partkey AS pos FROM part UNION ALL SELECT s_name, s_name, 1, s_suppkey FROM supplier
      UNION ALL SELECT p_name, 'late copy', 1, 1000000 + p_partkey FROM part) GROUP BY k""")
def j19(spark, sf):
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    first = p.select(F.col("p_name").alias("id"), F.concat("p_name", F.lit(" of "), "p_brand").alias("name"), F.col("p_partkey").alias("pos"))
    second = s.select(F.col("s_name").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("pos")).unionByName(
        p.select(F.col("p_name").alias("id"), F.lit("late copy").alias("name"), (F.col("p_partkey") + 1000000).alias("pos")))
    return search.merge_catalogs([first, second])


@register("set_ops_tags", "id:i common:i either:i only_mine:i", """
SELECT a.id, len(list_intersect(list_distinct(a.tags), list_distinct(h.tags))) AS common, len(list_distinct(list_concat(a.tags, h.tags))) AS either,
       len(list_distinct(a.tags)) - len(list_intersect(list_distinct(a.tags), list_distinct(h.tags))) AS only_mine
FROM catalog a JOIN heads h USING (category)""", HEADS_SQL)
def set_ops(spark, sf):
    a = catalog(spark, sf)
    h = heads(a).select("category", F.col("tags").alias("ht"))
    return a.join(h, "category").select("id", F.size(F.array_intersect("tags", "ht")).alias("common"), F.size(F.array_union("tags", "ht")).alias("either"),
                                        F.size(F.array_except("tags", "ht")).alias("only_mine"))


@register("f23_asset_confidence", "id:i confidence:d", """
SELECT id, round(greatest(0.0, least(1.0, 0.35e0 + CASE WHEN contains(name, ' ') THEN 0.22e0 ELSE 0.0 END + CASE WHEN contains(lower(name), lower(character)) THEN 0.20e0 ELSE 0.0 END
       + CASE WHEN regexp_matches(lower(name || ' ' || arc), '\\bsmall|hot\\b') THEN 0.15e0 ELSE 0.0 END - least(0.20e0, 0.08e0 * (n - 1)))), 2) AS confidence
FROM (SELECT *, count(*) OVER (PARTITION BY category, name) AS n FROM catalog)""", CATALOG_SQL)
def f23(spark, sf):
    a = catalog(spark, sf)
    dup = a.groupBy("category", "name").agg((F.count(F.lit(1)) - 1).alias("dup"))
    return a.join(dup, ["category", "name"]).withColumn("confidence", rules.asset_confidence(
        F.col("name"), F.col("arc"), F.array("character"), F.col("dup"), r"\bsmall|hot\b", False))


@register("f34_deterministic_pick", "id:i pick:s", """
SELECT id, list_extract(['alpha', 'beta', 'gamma', 'delta', 'omega'], CAST(CAST(('0x' || substr(sha1(name || ':' || (id % 3)), 1, 8)) AS BIGINT) % 5 + 1 AS INTEGER)) AS pick FROM catalog""", CATALOG_SQL)
def f34(spark, sf):
    a = catalog(spark, sf)
    return a.withColumn("pick", planners.deterministic_pick(["alpha", "beta", "gamma", "delta", "omega"], F.col("name"), F.col("id") % 3))


@register("f10_int_to_words", "id:i said:s back:i", """
SELECT p_partkey AS id, CASE WHEN p_size < 20 THEN o[p_size + 1] WHEN p_size % 10 = 0 THEN t[p_size // 10 + 1] ELSE t[p_size // 10 + 1] || ' ' || o[p_size % 10 + 1] END AS said, p_size AS back
FROM (SELECT p_partkey, p_size, ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'] AS o,
             ['','','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'] AS t FROM part)""")
def f10(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.int_to_words(F.col("p_size")).alias("said"))
    return p.withColumn("back", text.words_to_int(F.col("said")))


@register("f25_sanitize_query", "id:i deduped:s sanitized:s", """
SELECT id, CASE WHEN character = list_extract(string_split(name, ' '), 1) THEN character ELSE name END AS deduped, name AS sanitized FROM catalog""", CATALOG_SQL)
def f25(spark, sf):
    a = catalog(spark, sf)
    doubled = F.concat_ws(" ", "name", F.upper("name"))
    return a.withColumns({"deduped": text.dedupe_words(doubled), "sanitized": text.sanitize_query(
        F.concat("name", F.lit(" dramatic! close up")), F.col("name"), F.array("character", F.split("name", " ")[0]), fallback="Logo")})
