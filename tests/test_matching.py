"""Interval levels, the multi-pattern matcher, inverted lists and repeated loads against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyspark.operators import graph, intervals, vector

# ---- intervals

LINE = "script_id string, idx long, start_s double, end_s double, text string"


def spans(rng, n, long_share=0.1):
    out = []
    for i in range(n):
        start = round(rng.uniform(-50, 400), 2)
        size = rng.choice([0.0, 0.1, 1.0, 7.9, 8.0, 8.1, 64.0]) if rng.random() > long_share else rng.choice([31_536_000.0, 500.0, 1e300, float("inf")])
        out.append((f"s{rng.randint(0, 1)}", i, start, start + size, f"w{i}"))
    return out + [("s0", n, None, 5.0, "no start"), ("s0", n + 1, 5.0, None, "no end"), ("s1", n + 2, 30.0, 10.0, "backwards"), ("s0", n + 3, 3.0, 4.0, "  ")]


def plain_pairs(lines, slides):
    ok = lambda r: r[2] is not None and r[3] is not None
    return {(a[1], b[1]) for a in lines for b in slides if a[0] == b[0] and ok(a) and ok(b) and a[3] > b[2] and a[2] < b[3]}


def test_overlap_pairs_are_exact(spark):
    rng = random.Random(4)
    lines, slides = spans(rng, 150), spans(rng, 80)
    left, right = spark.createDataFrame(lines, LINE), spark.createDataFrame(slides, LINE).drop("text")
    got = [(r.l_idx, r.s_idx) for r in intervals.overlap_pairs(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(lines, slides)
    assert intervals.overlap_pairs(left.limit(0), right).count() == 0 == intervals.overlap_pairs(left, right.limit(0)).count()


def test_a_slide_of_ages_costs_no_more_than_others(spark):
    # by fixed buckets it would be 10 ** 12 rows
    lines = spark.createDataFrame([("s", i, float(i), i + 0.9, "x") for i in range(500)], LINE)
    slides = spark.createDataFrame([("s", 0, 0.0, 3e13), ("s", 1, 3.0, 4.0)], "script_id string, idx long, start_s double, end_s double")
    assert intervals.overlap_pairs(lines, slides).count() == 501  # the wide slide and all lines; line 3 and the other
    assert intervals.overlap_pairs(slides.withColumn("text", F.lit("x")), lines.drop("text")).count() == 501


def test_overlapping_lines_and_text_agree(spark):
    rng = random.Random(9)
    lines, slides = spans(rng, 60), spans(rng, 20)
    left, right = spark.createDataFrame(lines, LINE), spark.createDataFrame(slides, LINE).drop("text")
    rows = {}
    for r in intervals.overlapping_lines(left, right).orderBy("script_id", "idx", "position").collect():
        rows.setdefault(r.idx, []).append(r.text)
    text = {r.idx: (r.subtitle_text, r.line_count) for r in intervals.overlapping_text(left, right).collect()}
    assert len(text) == len(slides) and all(text[r[1]] == (" ".join(rows.get(r[1], [])), len(rows.get(r[1], []))) for r in slides)


# ---- matcher

TERMS = ["red gear", "Red", "old-town", "mr. x", "naïve plan", "a", "b c d e", "gear 2", "...", "x's", "(blue)", "red", "ünder ground", "don't stop"]
TEXTS = ["The red gear of Mr. X", "redgear red  gear", "old-town; OLD-TOWN", "oldtown old town", "a naïve plan, naïveplan", "b c d e f", "b c  d e", "gear 2gear 2", "gear 20",
         "x's x(blue)x (blue) y", "", None, "Ünder Ground", "don't stop", "they don't stopped", "..."]


def plain_hits(texts, terms):
    found = set()
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for n, term in enumerate(terms):
            if re.search(r"\w", term) and re.search(r"\b" + re.escape(term.lower()) + r"\b", low):
                found.add((i, n))
    return found


@pytest.mark.parametrize("bound", [200_000, 0])
def test_lexicon_hits(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "MATCHER_TERMS", bound)
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "text_id long, text string")
    lexicon = spark.createDataFrame([(t, n) for n, t in enumerate(TERMS)], "term string, n long")
    got = [(r.text_id, r.n) for r in graph.lexicon_hits(texts, lexicon).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_hits(TEXTS, TERMS)
    assert graph.lexicon_hits(texts, lexicon.limit(0)).count() == 0 == graph.lexicon_hits(texts.limit(0), lexicon).count()


def test_many_names_are_found_like_few(spark, monkeypatch):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    aliases, names = [("ear", "Ear"), ("plan", "Plan"), ("red", "red")], [t for t in TERMS if t != "..."]
    monkeypatch.setattr(graph, "FEW_NAMES", 100)
    few = [r.e for r in texts.select(graph.context_entities(F.col("text"), aliases, names, 4).alias("e")).collect()]
    monkeypatch.setattr(graph, "FEW_NAMES", 0)
    many = [r.e for r in texts.select(graph.context_entities(F.col("text"), aliases, names, 4).alias("e")).collect()]
    assert few == many and any(few)


# ---- inverted lists

def test_lists_give_the_exact_result_with_all_probes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(400)] + [(500, None), (501, [0.0] * 8)]
    rows += [(600 + i, rows[3][1]) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector.build_lists(table, lists=12)
    assert index.rows.count() == 451 and index.rows.select("list").distinct().count() <= 12
    key = lambda df: sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 9)) for r in df.collect())
    exact = key(vector.top_k_vectors(table.filter("embedding IS NOT NULL"), queries, 5))
    assert key(vector.search_lists(index, queries, 5, 12)) == exact
    monkeypatch.setattr(vector, "LIST_ROWS", 7)
    monkeypatch.setattr(vector, "LIST_QUERIES", 3)
    assert key(vector.search_lists(index, queries, 5, 99)) == exact
    some = vector.search_lists(index, queries, 5, 6).collect()
    hit = {(q, v) for q, _, v, _ in exact} & {(r.query_id, r.vec_id) for r in some}
    assert len(hit) / len(exact) > 0.75


def test_centroids_are_unit_and_cover_the_rows():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (40, 4)) for c in (-3, 0.5, 2)] + [np.zeros((2, 4))])
    centres = vector.fit_centroids(x, 5)
    assert centres.shape == (5, 4) and np.allclose(np.linalg.norm(centres, axis=1), 1)


# ---- repeated loads

def test_a_load_that_is_run_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(i, f"t{i % 30}") for i in range(60)], "n long, text string")
    assert vector.append_collection(df.filter("n < 20"), path, "one", 4) == 20
    assert vector.append_collection(df, path, "one", 4) == 10  # texts repeat
    assert vector.append_collection(df, path, "one", 4) == 0
    assert vector.append_collection(df.limit(0), path, "one", 4) == 0
    assert vector.append_collection(df.filter("n < 5"), path, "two", 4) == 5
    got = spark.read.parquet(path)
    assert got.groupBy("collection").count().collect() and {r.collection: r["count"] for r in got.groupBy("collection").count().collect()} == {"one": 30, "two": 5}
    assert sorted(r.text for r in got.filter("collection = 'one'").collect()) == sorted({f"t{i}" for i in range(30)})
    assert math.isclose(got.select("id").distinct().count(), 35)


def test_exact_degrees_are_those_of_mined_edges(spark):
    rng = random.Random(2)
    words = ["red", "blue", "gear", "ring", "hot"]
    rows = []
    for i in range(150):
        name = f"{rng.choice(words)} {rng.choice(words)}"
        rows.append((i, name, rng.choice([name.split()[1], None]), f"crew{rng.choice([0, 0, 0, 1, 2, i])}", rng.choice(["Alpha / north", "Beta", "north", None]),
                     rng.choice(["sad, grim, calm", "joy, sad", "grim", "", None]), rng.choice(["character", "arc_card", "weapon", None]), 3, rng.sample(words, 2) + [f"own{i}"]))
    rows += [rows[3], rows[40]]  # rows that come twice
    nodes = spark.createDataFrame(rows, "id long, name string, character string, category string, arc string, emotion string, visual_type string, importance int, tags array<string>")
    pairs = {(r.src, r.dst) for r in graph.mine_edges(nodes, nodes.select("id")).select("src", "dst").collect()}
    want = {i: sum(src == i for src, _ in pairs) for i in range(150)}
    assert {r.id: r.relationship_count for r in graph.exact_degrees(nodes).collect()} == want
    assert len(set(want.values())) > 10


def test_exact_degrees_mine_classes_not_pairs(spark, monkeypatch):
    rows = [(i, f"name{i % 4} last", "last", "crew", "Alpha", "sad, grim", "character", 3, [f"name{i % 4}", f"own{i}"]) for i in range(400)]
    nodes = spark.createDataFrame(rows, "id long, name string, character string, category string, arc string, emotion string, visual_type string, importance int, tags array<string>")
    mined, plain = [], graph.mine_edges
    monkeypatch.setattr(graph, "mine_edges", lambda nodes, *a: (mined.append(nodes.count()), plain(nodes, *a))[1])
    assert {r.relationship_count for r in graph.exact_degrees(nodes).collect()} == {399} and mined == [4]


def test_mined_pairs_are_dealt_by_their_far_end(spark, monkeypatch):
    monkeypatch.setattr(graph, "NODE_ROWS", 10, raising=False)
    rows = [(i, f"name{i % 4} last", "last", "crew", "Alpha", "sad, grim", "character", 3, [f"name{i % 4}", f"own{i}"]) for i in range(90)]
    nodes = spark.createDataFrame(rows, "id long, name string, character string, category string, arc string, emotion string, visual_type string, importance int, tags array<string>").coalesce(1)
    edges = graph.combine_edges(graph.mine_edges(nodes, nodes.filter("id < 2").select("id")))
    assert edges.count() == 2 * 89
    # names, arcs and emotions, each over as many tasks as the nodes ask for
    assert len(re.findall(r"RepartitionByExpression \[id#\d+L\], 9", edges._jdf.queryExecution().analyzed().toString())) == 3
