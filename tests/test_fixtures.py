"""Exact values on small inputs."""

import json
import time

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from storyspark.functions import rules, text
from storyspark.operators import audit, composition, curve, intervals, planners, search, sequence, slides, vector
from storyspark.operators.ordered import number_rows
from storyspark.sources import files, web
from storyspark.streaming import jobs as streaming


def seq(spark, rows, cols):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], f"script_id string, idx long, {cols}")


def test_interval_merge_and_sanitize(spark):
    d = seq(spark, [(8.12, 9.97), (10.01, 11.55), (11.61, 12.85)], "start_s double, end_s double")
    r = intervals.merge_intervals(d).collect()
    assert [(x.start_s, x.end_s, x.source_count) for x in r] == [(8.12, 12.85, 3)]
    assert intervals.merge_intervals(seq(spark, [(0.0, 1.0), (1.3, 2.0)], "start_s double, end_s double")).count() == 2
    d = seq(spark, [(89.80, 91.43), (91.50, 193.86), (92.71, 93.35)], "start_s double, end_s double")
    got = sorted((x.start_s, x.end_s) for x in intervals.sanitize_intervals(d).collect())
    assert got == [(89.8, 91.43), (91.5, 92.7), (92.71, 93.35)]


def test_repair_cuts(spark):
    d = seq(spark, [(0.03, 3.0), (3.30, 6.0), (6.60, 9.0)], "start_s double, end_s double").withColumn("total_s", F.lit(9.5))
    for size in (None, 2):
        r = sorted((x.new_start, x.new_end) for x in intervals.repair_cuts(d.withColumn("snapped", F.col("start_s")), block_rows=size).collect())
        assert r[0][0] == 0 and r[-1][1] == 9.5
        assert all(abs(a[1] - b[0]) < 1e-9 for a, b in zip(r, r[1:]))


def test_gate_counts(spark):
    d = seq(spark, [("evidence", 80.0, 3.0, "a", "fade", "pan"), ("evidence", 80.0, 3.0, "a", "fade", "pan"), ("evidence", 80.0, 3.0, "b", "cut", "zoom")],
            "beat_type string, emotion_score double, duration double, asset_id string, transition_type string, motion_preset string")
    by = {}
    for r in audit.gate_issues(d).collect():
        by[r.severity] = by.get(r.severity, 0) + 1
    assert by == {"WARNING": 1, "INFO": 2}
    d = seq(spark, [("HOOK", 50.0, 2.0, "a", "x", "m"), ("REVEAL", 80.0, 10.0, "b", "y", "n"), ("setup", 20.0, 2.0, "c", "x", "m"), ("setup", 20.0, 2.0, "d", "y", "n"),
                    ("setup", 20.0, 2.0, "e", "x", "m")], "beat_type string, emotion_score double, duration double, asset_id string, transition_type string, motion_preset string")
    sev = sorted(r.severity for r in audit.gate_issues(d).collect())
    assert sev == ["ERROR", "WARNING", "WARNING"]
    assert audit.gate_verdict(d, audit.gate_issues(d)).first().passed is False


def test_curve_limits(spark):
    kinds = ["hook", "setup", "evidence", "escalation", "reveal", "payoff", "warning", "cta"]
    conf = [.85, .7, .6, .65, .9, .85, .7, .5]
    d = seq(spark, [(k, "plain words", c) for k, c in zip(kinds, conf)], "beat_type string, text string, confidence double")
    for size in (None, 3):
        pts = {r.beat_type: r.score for r in curve.smooth_curve(curve.emotion_points(d, block_rows=size), block_rows=size).collect()}
        assert pts["hook"] >= .78 and pts["reveal"] >= .82 and pts["payoff"] >= .90 and pts["cta"] <= .30
    s = curve.curve_summary(curve.smooth_curve(curve.emotion_points(d))).first()
    assert s.beat_count == 8 and s.spike_count == 3 and s.peak_beat_type == "reveal"  # reveal and payoff both reach 1.0


def test_diversity_rejects_repetition(spark):
    d = seq(spark, [("ann", "port", "character", "safe_subject", "fear")] * 5, "character string, arc string, visual_role string, layout_mode string, emotion string")
    rej = [r.rejected for r in sorted(audit.diversity_scores(d).collect(), key=lambda r: r.idx)]
    assert rej[0] is False and any(rej)
    assert [r.rejected for r in sorted(audit.diversity_scores(d, block_rows=4).collect(), key=lambda r: r.idx)] == rej


def test_hot_script_same_answer_in_blocks(spark):
    rows = [("ab"[i % 7 == 0], ["x", "y"][i % 5 == 0], i % 9 / 10.0, i * 3.0, i * 3.0 + 3, ["evidence", "reveal"][i % 13 == 0], "static_hold") for i in range(80)]
    d = seq(spark, rows, "character string, arc string, intensity double, start_s double, end_s double, beat_type string, motion_preset string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(audit.retention_violations(d)) == key(audit.retention_violations(d, block_rows=8))
    d2 = d.withColumn("asset_id", F.col("character"))
    assert key(sequence.track_reuse(d2).orderBy("idx")) == key(sequence.track_reuse(d2, block_rows=6).orderBy("idx"))


def test_even_sample_matches_truncated_linspace(spark):
    import numpy as np

    for n in (1, 5, 23, 40):
        d = spark.createDataFrame([("s", i) for i in range(n)], "script_id string, idx long")
        got = sorted(r.idx for r in sequence.even_sample(d, F.lit(7)).collect())
        assert got == (list(range(n)) if n <= 7 else [j * (n - 1) // 6 for j in range(7)]), n
        if n > 7:
            assert max(abs(a - b) for a, b in zip(got, np.linspace(0, n - 1, 7, dtype=int))) <= 1


def test_text_helpers(spark):
    d = spark.createDataFrame([("Chapter - 1182.pdf",), ("ch.1179.pdf",)], "t string")
    assert [r[0] for r in d.select(text.chapter_number(F.col("t"))).collect()] == [1182, 1179]
    d = spark.createDataFrame([("@@ ## ~~ ^^ <> || == ++", 35.0), ("The crew sails toward the island at dawn. Everyone watches the sea and waits for the storm to pass.", 88.0)], "text string, conf double")
    a, b = text.with_text_quality(d, confidence="conf").collect()
    assert a.quality_level == "poor" and not a.usable and b.usable
    d = spark.createDataFrame([("Secrets of Chapters 1180-1182",)], "t string")
    r = d.select(text.title_has_chapter(F.col("t"), F.lit(1182)), text.title_has_chapter(F.col("t"), F.lit(1183))).first()
    assert tuple(r) == (True, False)
    d = spark.createDataFrame([("intro\nChapter 1180\none two\nthree\nChapter 1181\nother\nLeave a reply",)], "t string")
    assert d.select(web.chapter_section(F.col("t"), F.lit(1180))).first()[0] == "Chapter 1180 one two three"
    assert d.select(text.digits_to_words(F.lit("3 swords in chapter 513 and 12,000 men"))).first()[0] == "three swords in chapter five hundred thirteen and twelve thousand men"
    assert d.select(text.words_to_int(F.lit("five hundred thirteen"))).first()[0] == 513
    got = d.select(*[text.parse_time(F.lit(x)) for x in ("0:01:02.50", "1:30", "7", "junk")], text.format_time(F.lit(3723.456))).first()
    assert tuple(got) == (62.5, 90.0, 7.0, 0.0, "1:02:03.46")
    long = " ".join(["One two three four five six seven eight nine ten."] * 16)
    assert d.select(text.normalize_paragraphs(F.lit("**Bold** [x] text"))).first()[0] == "Bold text"
    assert d.select(F.size(F.split(text.normalize_paragraphs(F.lit(long)), "\n\n"))).first()[0] == 8
    assert d.select(text.is_generic_topic(F.lit("Generate a script"))).first()[0] is True


def test_cue_spacing(spark):
    ev = seq(spark, [(float(t), "fade") for t in (3, 6, 10, 14, 18, 23)], "time_s double, transition string")
    stems = spark.createDataFrame([(s,) for s in planners.GENTLE_SOUNDS + planners.IMPACT_SOUNDS], "stem string")
    cues = [r.stem for r in sorted(planners.plan_sounds(ev, stems).collect(), key=lambda r: r.idx)]
    assert len(cues) < 6 and all(a != b for a, b in zip(cues, cues[1:]))
    ev = seq(spark, [(float(t), "zoom_dissolve") for t in (10, 18, 30)], "time_s double, transition string")
    hits = [r.time_s for r in planners.plan_sounds(ev, stems).collect() if r.stem == "impact_hit"]
    assert sorted(hits) == [10.0, 30.0]


def test_layers_and_defaults(spark):
    d = seq(spark, [("hook", "character", "safe_subject", "fear", 0.8, "q", "Big", ["impact_shake", "reveal_zoom"], None, 0.0, 0.3, "Summary of the scene", "impact_shake", "the")],
            "beat_type string, visual_role string, layout_mode string, emotion string, intensity double, query string, text_overlay string, effect_cues array<string>, pacing_intent string, "
            "start_s double, end_s double, summary string, transition_in string, target_word string")
    layers = composition.plan_composition(d).first().layers
    assert [x.z_index for x in layers] == list(range(len(layers))) and len(layers) <= 8
    assert layers[0].name == "background" and any(x.category == "foreground" for x in layers)
    r = slides.production_defaults(d).first()
    assert r.transition_in == "crossfade" and r.sfx_cue == "pop" and r.target_word == "" and r.effect_cues == [] and r.layout_mode == "safe_subject"
    got = d.select(slides.safe_transition(F.lit("whip_pan_left")), slides.match_pan(F.lit("slide_left"), F.lit("lr")), slides.expression_label(F.lit("very Hype!"))).first()
    assert tuple(got) == ("crossfade", "slide_right", "excited")


def test_beat_and_intent_rules(spark):
    d = spark.createDataFrame([("Why does nobody see the hidden truth?", 0, 3), ("Follow and subscribe for more.", 2, 3)], "t string, i int, n int")
    got = [r[0] for r in d.select(rules.beat_columns(F.col("t"), F.col("i"), F.col("n"))["beat_type"]).collect()]
    assert got == ["hook", "cta"]
    i = rules.intent_columns(F.lit("warning"), F.lit("A monster will destroy the village"), F.array(F.lit("someone")))
    assert d.select(i["intent"]).first()[0] == "WARNING"


def test_vector_top_k_ties_and_passes(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 4)).round(1)
    q = rng.normal(size=(9, 4)).round(1)
    dv = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    dq = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    sims = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    want = {(n, int(i)) for n in range(9) for i in np.lexsort((np.arange(60), -sims[:, n].round(12)))[:3]}
    assert {(r.query_id, r.vec_id) for r in vector.top_k_vectors(dv, dq, 3).collect()} == want
    monkeypatch.setattr(vector, "MAX_QUERY_BYTES", 8 * 4 * 4)
    assert {(r.query_id, r.vec_id) for r in vector.top_k_vectors(dv, dq, 3).collect()} == want


def test_sources(spark, tmp_path):
    (tmp_path / "cat.json").write_text(json.dumps({"source": "x", "assets": [{"id": "a", "name": "A", "category": "c", "importance": 5, "tags": ["t"]}, {"id": "b", "name": "B", "category": "d"}]}))
    rows = {r.id: r for r in files.load_catalog(spark, str(tmp_path / "cat.json")).collect()}
    assert rows["b"].importance == 3 and rows["b"].tags == [] and rows["a"].arc == ""
    sub = tmp_path / "subs"
    sub.mkdir()
    (sub / "one.json").write_text(json.dumps({"episode_info": {"episode_number": 7, "title": "T"}, "file_name": "f", "subtitles": [{"timestamp": "0:01", "text": "hi"}, {"timestamp": "0:02", "text": "yo"}]}))
    (sub / "bad.json").write_text("{not json")
    assert [(r.episode_number, r.line_no, r.text) for r in files.load_subtitle_corpus(spark, str(sub)).collect()] == [(7, 0, "hi"), (7, 1, "yo")]
    assert files.unreadable_corpus_files(spark, str(sub)).count() == 1
    ass = tmp_path / "a.ass"
    ass.write_text("[Script Info]\nDialogue: 0,0:00:00.00,0:00:01.00,Default,,0,0,0,,early\n[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,{\\an8}Hello,\\Nworld\n"
                   "Dialogue: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,,{x}\n")
    lines = files.read_event_lines(spark, str(ass))
    got = files.parse_events(lines).collect()
    assert [(r.text, r.start_s, r.end_s) for r in got] == [("Hello, world", 1.0, 2.5)]
    assert files.parse_events(lines, need_section=False).count() == 3
    ass.write_text(ass.read_text() + "Comment: 0,0:00:05.00,0:00:06.00,Storyboard,,0,0,0,,Whole story line\n")
    assert [r.text for r in files.parse_events(files.read_event_lines(spark, str(ass))).collect()] == ["Whole story line"]
    replies = spark.createDataFrame([("a", '```json\n[{"start_time":"0:0:1","end_time":"0:0:2","summary":"x"},{"summary":"no times"}]\n```'),
                                     ("b", '{"slides":[{"start_time":"1","end_time":"2","summary":"y"}]}'), ("c", 'Here: [{"start_time":"1","end_time":"2","summary":"z"}] done'), ("d", "nothing")],
                                    "script_id string, reply string")
    good, bad = files.parse_slide_replies(replies)
    assert sorted((r.script_id, r.summary) for r in good.collect()) == [("a", "x"), ("b", "y"), ("c", "z")] and [r.script_id for r in bad.collect()] == ["d"]
    body = "**TITLE:** My title\n\nSCRIPT: line one\nline two\n\nDESCRIPTION:\n- a\n\n# HASHTAGS: #x #y"
    r = spark.range(1).select(*[c.alias(k) for k, c in files.split_sections(F.lit(body)).items()]).first()
    assert r.title == "My title" and r.script == "line one\nline two" and r.hashtags == "#x #y"


def test_picture_index(spark, tmp_path):
    for rel in ("characters/Some Name (Young).png", "misc/Town.png", "Symbols and Flags/Crew.png", ".git/x.png", "misc/readme.txt"):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    listed = files.list_files(spark, str(tmp_path), "*.png")
    idx = {r.stem: r for r in files.picture_index(listed, str(tmp_path)).collect()}
    assert {k: v.asset_kind for k, v in idx.items()} == {"some name (young)": "character", "town": "location", "crew": "symbol"}
    assert idx["some name (young)"].primary_name == "some name" and idx["some name (young)"].variant_hint == "young"
    assert files.storage_usage(listed).first().files == 3  # hidden folders are not listed
    assert files.newest_by_suffix(files.list_files(spark, str(tmp_path)), [".txt"]).first().path.endswith("readme.txt")
    assert files.expired_files(listed, 1).count() == 0


def test_sentence_chunks_by_position(spark):
    import random
    import re

    def plain(t, size, overlap):
        done, cur, n = [], [], 0
        for s in re.split(r"(?<=[.!?])\s+", t):
            if n + len(s) > size and cur:
                done.append(" ".join(cur))
                cur = [" ".join(cur[-overlap:]), s]
                n = len(cur[0]) + len(s)
            else:
                cur.append(s)
                n += len(s)
        return done + [" ".join(cur)]

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) + rng.choice(".!?") for _ in range(rng.randint(1, 40))) for _ in range(40)] + [""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size, overlap in ((50, 1), (50, 2), (100, 50), (20, 3)):
        assert [r[0] for r in df.select(text.chunk_sentences(F.col("t"), size, overlap)).collect()] == [plain(t, size, overlap) for t in texts]


def test_contained_pairs_is_exact(spark):
    a = ["ab", "b", "xyz", "abc", ""]
    b = ["abc", "cab", "zzz", "b"]
    da, db = spark.createDataFrame([(x,) for x in a], "needle string"), spark.createDataFrame([(x,) for x in b], "hay string")
    assert {tuple(r) for r in search.contained_pairs(da, db).collect()} == {(x, y) for x in a for y in b if x and x in y}


def test_many_subtitle_files_lie_in_few(spark, tmp_path):
    one = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,Main,,0,0,0,,first, second\r\nDialogue: 0,0:00:03.00,0:00:04.00,Main,,0,0,0,,third\n"
    two = one.replace("Main", "storyboard").replace("Dialogue", "Comment")
    for name, body in (("a", one), ("b", two + one)):
        (tmp_path / "apart" / name).mkdir(parents=True)
        (tmp_path / "apart" / name / "subtitles.ass").write_bytes(body.encode())
    files.write_event_bundles(spark.createDataFrame([("x/a", one), ("x/b", two + one), ("x/c", "")], "file string, value string").coalesce(1), f"{tmp_path}/bundles")
    assert len(list((tmp_path / "bundles").glob("part-*"))) == 1
    rows = lambda df, at: sorted((r.file.split("/")[at], r.idx, r.line_no, r.start_s, r.text) for r in df.collect())
    bundled = rows(files.parse_events(files.read_event_lines(spark, f"{tmp_path}/bundles", bundled=True)), -1)
    assert bundled == rows(files.parse_events(files.read_event_lines(spark, f"{tmp_path}/apart/*")), -2)
    assert [r[4] for r in bundled] == ["first, second", "third"] * 2 and [r[1] for r in bundled] == [0, 1, 0, 1]
    assert files.read_event_lines(spark, f"{tmp_path}/bundles", bundled=True).filter("file = 'x/c'").count() == 1


def test_subtitle_query_writes_few_files(spark, tmp_path, monkeypatch):
    from storyspark.queries import sources

    source = "SELECT * FROM '/root/testdata/sf0.001/events.parquet'"
    con = duckdb.connect()
    con.execute(f"COPY ({source}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS {source}")
    monkeypatch.setattr(sources, "folder", lambda spark, name: f"{tmp_path}/{name}")
    got = entry.queries()["s3_subtitle_events"](spark, str(tmp_path)).collect()
    want = con.execute(entry.oracle_sql()["s3_subtitle_events"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len({r[0] for r in want}) > 4
    assert len(list((tmp_path / "events").rglob("part-*"))) <= 4
