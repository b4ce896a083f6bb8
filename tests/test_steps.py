"""Steps that several queries share: what is parsed, computed or held once."""

import numpy as np
from pyspark.sql import functions as F

from storyspark.functions import rules, text
from storyspark.llm import quality_forest
from storyspark.operators import intervals, ordered, vector
from storyspark.plans import jobs
from storyspark.session import packed
from storyspark.sources import files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_replies_are_parsed_once(spark):
    slide = '{"start_time": "1", "end_time": "2", "summary": "a"}'
    replies = spark.createDataFrame([(1, f"```json\n[{slide}]\n```"), (2, f'{{"items": [{slide}, {slide}]}}'), (3, slide), (4, f"so: [{slide}]."), (5, "no")], "script_id long, reply string")
    good, bad = files.parse_slide_replies(replies)
    assert sorted((r.script_id, r.idx) for r in good.collect()) == [(1, 0), (2, 0), (2, 1), (3, 0), (4, 0)]
    assert [r.script_id for r in bad.collect()] == [5]
    assert plan(good).count("from_json") <= 6


def test_sides_of_an_overlap_are_computed_once(spark):
    rows = spark.range(4).select(F.lit("a").alias("script_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("start_s"), (F.col("id") + 1.0).alias("end_s"))
    pairs = intervals.overlap_pairs(rows, rows)
    assert pairs.count() == 4 and "Range" not in plan(pairs)


def test_word_lists_look_ahead(spark):
    pattern = rules.words("doesn'?t fit", "but", "Über")
    assert "(?=" not in rules.rx(pattern)
    assert rules.rx(rules.words("but", "yet"), False) == r"(?i)(?=[by])\b(but|yet)\b"
    seen = spark.createDataFrame([("a BUT b",), ("rebut",), ("yet.",), ("",)], "t string").select(rules.matches(F.col("t"), rules.words("but", "yet"), False).alias("m"))
    assert [r.m for r in seen.collect()] == [True, False, True, False]


def test_text_steps(spark):
    df = spark.createDataFrame([("The the THE 'the' one  \t two. Then\nthree! four",)], "text string")
    got = text.with_text_quality(df, unicode=False).select("word_count", "repeated_ratio", text.sentences(F.col("text")).alias("s")).first()
    assert (got.word_count, got.repeated_ratio) == (9, 0.444)
    assert got.s == ["The the THE 'the' one two.", "Then three!", "four"]


def test_probes_come_in_bounded_steps(spark, monkeypatch):
    monkeypatch.setattr(vector, "PROBE_CELLS", 8)
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    index = vector.build_lists(rows)
    ids = lambda df: sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())
    assert ids(vector.search_lists(index, asked, 3, len(index.centroids))) == ids(vector.top_k_vectors(rows, asked, 3))


def test_threshold_comes_from_all_labelled_rows(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    clean = [(i, " ".join(word() for _ in range(60 + i))) for i in range(30)]
    junk = [(100 + i, "\n".join(["### $$$ " + word()] * 2 + [word() * 9 for _ in range(40)])) for i in range(6)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality"))
    forest = quality_forest.fit(docs, labels, trees=4, sample=3)  # twelve rows grow the trees
    score = {r.doc_id: r.anomaly for r in quality_forest.judge(docs, forest).collect()}
    lowest = max(score[i] for i, _ in clean)
    above = [score[i] for i, _ in junk if score[i] > lowest]
    assert forest.threshold == ((lowest + min(above)) / 2 if above else float("inf"))


def test_texts_do_not_travel_to_their_labels(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = [(i, " ".join(word() for _ in range(40 + i))) for i in range(24)] + [(i, "\n".join(["## " + word()] * 2 + [word() * 9 for _ in range(40)])) for i in range(100, 106)]
    docs = spark.createDataFrame([*rows, rows[3], (None, rows[4][1]), (5, None)], "doc_id long, text string")
    labels = docs.where("doc_id IS NOT NULL AND doc_id % 4 < 3").select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality"))
    plans, write = [], quality_forest.written
    monkeypatch.setattr(quality_forest, "written", lambda df: plans.append(plan(df)) or write(df))
    forest = quality_forest.fit(docs, labels)
    steps = plans[0]  # from the last step down to the scans
    assert 0 <= steps.index("Join") < steps.index("MapInArrow")
    stats = quality_forest.statistics(docs)
    again = quality_forest.fit(stats, labels, text_col=None)
    assert again.threshold == forest.threshold < float("inf")
    judged = lambda df: sorted(map(str, df.collect()))
    assert judged(quality_forest.judge(stats, again, text_col=None)) == judged(quality_forest.judge(docs, forest))


def test_slides_are_audited_before_they_are_expanded(spark):
    said = ["click one.", "nothing here.", "signup two.", "purchase three.", "the end."]
    lines = spark.createDataFrame([("a", i, 4.0 * i, 4.0 * i + 4, t) for i, t in enumerate(said)], "script_id string, idx long, start_s double, end_s double, text string")
    slides = [("a", 0, 0.0, 12.0, "old query", "all of it", ["cast"], "parallel_cut"), ("a", 1, 12.0, 16.0, "next query", "short", ["cast"], "standard")]
    slides = spark.createDataFrame(slides, "script_id string, idx long, start_s double, end_s double, query string, summary string, entities array<string>, pacing_intent string")
    total = spark.createDataFrame([("a", 20.0)], "script_id string, total_s double")
    out = jobs.subtitles_to_slides(lines, slides, total, entities=["click", "purchase", "signup"], unicode=False)
    cut = sorted(out["slides"].collect(), key=lambda r: r.idx)
    assert len(cut) > 2 and cut[0].entities == ["click"]  # the parts of the long slide have their own entities
    report = out["audit_report"].collect()
    assert [(r.beat_count, r.passed) for r in report] == [(len(cut), True)] and report[0].retention_score < 1
    assert {f"audit_{n}" for n in ("acts", "violations", "rhythm", "assets", "memory", "diversity", "composition", "motion", "transitions", "issues", "output")} <= set(out)
    moves = {r.idx: r.transition_type for r in out["audit_transitions"].collect()}
    styles = {r.idx: r.style for r in out["audit_motion"].collect()}
    shown = out["expanded"].collect()
    assert {r.idx for r in shown} == set(moves) == {r.idx for r in cut} and any(r.half == 1 for r in shown)
    assert all(r.transition_in == moves[r.idx] and r.motion.style == styles[r.idx] for r in shown)


def test_packed_tables_keep_rows_and_marks(spark):
    rows = ordered.number_rows(spark.createDataFrame([("a", 2.0), ("a", None), (None, 1.0)], "script_id string, ts double"))
    again = packed(rows)
    assert again.schema["idx"].metadata == rows.schema["idx"].metadata != {}
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert packed(spark.range(2).withColumn("none", F.lit(None))).count() == 2  # no Parquet type
