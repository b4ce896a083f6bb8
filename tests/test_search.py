"""Catalog search on signatures: hub tags, ties and mixed requests against plain scoring."""

import random

import pytest
from pyspark.sql import functions as F

from storyspark.operators import search

ASSET = "id long, tags array<string>, emotion string, arc string, importance int"
WORDS = [f"t{i}" for i in range(12)]


def catalog(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tags = rng.sample(WORDS, rng.randint(0, 4)) + (["hub"] if i % 3 == 0 else []) + (["hub"] if i % 30 == 0 else [])
        rows.append((i, tags + [f"own{i}"], rng.choice(["sad, grim", "joy", "", "joy, sad", None]), rng.choice(["Alpha Town / north", "Beta", None]), rng.choice([1, 3, 5, None])))
    rng.shuffle(rows)
    return rows


def plain_tags(rows, asked, k):
    asked = list(dict.fromkeys(t.strip().lower() for t in asked if t.strip()))
    hits = [(sum(t in asked for t in tags), i) for i, tags, *_ in rows]
    return [(i, h / len(asked)) for h, i in sorted(((h, i) for h, i in hits if h), key=lambda x: (-x[0], x[1]))[:k]]


QUERIES = [("a", ["hub"]), ("b", ["hub", "t1"]), ("c", ["hub", "t1", "t2", "own9"]), ("d", ["T3 ", "t3", "none"]), ("e", []), ("f", ["none"]), ("g", ["hub", "own30", "own33"])]


@pytest.mark.parametrize("k", [1, 4, 25])
def test_tag_search_with_a_hub(spark, k):
    rows = catalog(400)
    assets = spark.createDataFrame(rows, ASSET)
    got = {}
    for r in search.tag_search(assets, spark.createDataFrame(QUERIES, "query_id string, tags array<string>"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got == {q: want for q, tags in QUERIES if (want := plain_tags(rows, tags, k))}


def test_candidates_of_a_hub_tag_are_bounded(spark):
    # every asset has a tag of its own that someone asks for, so there are as many signatures as assets
    rows = [(i, ["hub", f"own{i}"] if i % 3 == 0 else [f"own{i}"], "", "", 1) for i in range(600)]
    asked = [(f"q{i}", ["hub", f"own{i}"]) for i in range(600)]
    assets, queries = spark.createDataFrame(rows, ASSET), spark.createDataFrame(asked, "query_id string, tags array<string>")
    wanted = queries.select("query_id", F.explode("tags").alias("_tag"))
    sigs = search.signatures(search.asked_tags(assets, wanted, F.col("tags")), ["_tags"], 5)
    assert sigs.count() == 600
    pairs = search.tag_candidates(sigs, wanted, 5).count()
    assert pairs <= 600 * 5 + 600  # not 600 x 200
    got = {(r.query_id, r.rank): r.id for r in search.tag_search(assets, queries, 5).collect()}
    assert got["q300", 1] == 300 and got["q300", 2] == 0 and got["q1", 1] == 0 and len(got) == 600 * 5


def test_signatures_share_one_row_per_combination(spark):
    rows = [(i, ["hub"], "joy", "Beta", 3) for i in range(500)]
    sigs = search.signatures(spark.createDataFrame(rows, ASSET), ["tags", "emotion", "arc", "importance"], 4).collect()
    assert len(sigs) == 1 and sigs[0].id == 0 and sigs[0]["_ids"] == [0, 1, 2, 3]


def plain_emotions(text):
    return list(dict.fromkeys("".join(ch for ch in x.lower() if ch.isalnum()) for x in (text or "").split(",") if x.strip()))


def plain_auto(rows, q, k, names):
    text, tags, emotion, arc = q[1:]
    given = {"semantic": bool(text), "tag": bool(tags), "emotion": bool(emotion), "arc": bool(arc)}
    w = {c: v if given.get(c, True) else 0.0 for c, v in search.AUTO_WEIGHTS.items()}
    w = {c: v / sum(w.values()) for c, v in w.items()}
    if not any(given.values()):
        return []
    ents = sorted({n for n in names if n in (text or "").lower().split()})[:6]
    asked = list(dict.fromkeys([t.strip().lower() for t in tags or []] + ents))
    out = []
    for i, own, em, ar, imp in rows:
        a, b = plain_emotions(emotion), plain_emotions(em)
        match = sum(max([1.0 if x == y else 0.6 if x in y or y in x else 0.0 for y in b], default=0.0) for x in a) / len(a) if a else 0.0
        overlap = sum(t in own for t in asked) / len(asked) if asked else 0.0
        place = 1.0 if text and "beta" in text.lower() and "beta" in (ar or "").lower() else 0.0
        score = round(w["tag"] * overlap + w["emotion"] * match + w["arc"] * place + w["importance"] * (3 if imp is None else imp) / 5, 9)
        out.append((-score, i))
    return [(i, -s) for s, i in sorted(out)[:k] if s < 0]


def test_auto_search_weighs_each_request(spark):
    rows = catalog(300)
    requests = [("a", "beta and t2 here", ["hub"], "joy", "Beta"), ("b", None, ["hub", "t1"], None, None), ("c", "", [], "sad", ""), ("d", "t4 t5 alone", None, "", None),
                ("e", None, None, None, None), ("f", None, [], "", "Beta")]
    names = ["t2", "t4", "t5", "t9"]
    lexicon = spark.createDataFrame([(n, n, 1, n) for n in names], "term string, canonical string, alias_first int, pos string")
    got = {}
    frame = spark.createDataFrame(requests, "query_id string, text string, tags array<string>, emotion string, arc string")
    for r in search.search(spark.createDataFrame(rows, ASSET), frame, "auto", 7, lexicon=lexicon, places=["beta"]).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for q in requests:
        want = plain_auto(rows, q, 7, names)
        assert [(i, pytest.approx(s, abs=1e-8)) for i, s in want] == got.get(q[0], [])


def test_similarity_and_matches_are_weighed_together(spark):
    rng = random.Random(5)
    rows = [(i, [WORDS[i % 4]] + (["hub"] if i % 3 == 0 else []), "joy" if i % 7 == 0 else "", "", 1 + i % 5, [rng.gauss(0, 1) for _ in range(5)]) for i in range(300)]
    asked = [(f"q{j}", "", [], ["hub", WORDS[j]], "joy", [rng.gauss(0, 1) for _ in range(5)], [0.35, 0.0, 0.9][j]) for j in range(3)]
    assets = spark.createDataFrame(rows, ASSET + ", vec array<double>")
    beats = spark.createDataFrame(asked, "query_id string, text string, entities array<string>, tags array<string>, emotion string, q array<double>, ws double")
    weights = {"semantic": F.col("ws"), "tag": 0.2, "emotion": 0.2, "importance": 0.1}
    got = {}
    for r in search.rank_for_beat(assets, beats, 6, weights, vector="vec", qvector="q").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))

    def cos(a, b):
        return max(0.0, min(1.0, sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5))

    for q, _, _, tags, _, vec, ws in asked:
        want = sorted((-round(ws * cos(r[5], vec) + 0.2 * sum(t in r[1] for t in tags) / 2 + 0.2 * (r[2] == "joy") + 0.1 * r[4] / 5, 9), r[0]) for r in rows)[:6]
        assert [(i, pytest.approx(-s, abs=1e-8)) for s, i in want] == got[q]


def test_entry_points_arise_where_the_entries_lie(spark, monkeypatch):
    rows = [(i, f"Red Gear {i % 3}" if i % 2 else f"blue ring{i}", "north red gear") for i in range(60)] + [(1, "Red Gear 1", "north red gear")]
    entries = spark.createDataFrame(rows, "id long, name string, arc string").coalesce(1)
    asked = [("a", "the red gear", ["Red Gear 1", "ring"]), ("b", "red red ring4", None), (None, "blue", ["blue"])]
    queries = spark.createDataFrame(asked, "query_id string, query string, entities array<string>").coalesce(1)
    norm = lambda t: "".join(ch for ch in t.lower() if ch.isalnum())
    want = {}
    for q, text, ents in asked:
        words = [w for w in text.lower().split() if len(w) > 2]
        for i, name, arc in rows:
            got = [p for w in words for p, own in ((12, name), (2, f"{name} {arc}")) if w in own.lower().split()]
            key = norm(name)
            for n, same, part in [(norm(text), 80, 40)] + [(norm(e), 50, 25) for e in ents or []]:
                if n in key:
                    got.append(same if n == key else part if len(n) >= 5 else 0)
            if got:
                want[q, i] = want.get((q, i), 0) + sum(got)
    for limit in (200_000, 1):
        monkeypatch.setattr(search, "ASKED_ROWS", limit)
        monkeypatch.setattr(search, "ENTRY_ROWS", 10)
        out = search.entry_scores(entries, queries, ("name", "arc"), minimum=0)
        assert out.rdd.getNumPartitions() >= (7 if limit > 1 else 1)
        assert {(r.query_id, r.id): r.score for r in out.collect()} == want
