"""Chat formatting, quality rules, byte BPE, quality classifier and licence scan."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from storyspark.llm import byte_bpe, byte_cnn, chat_parts, license_digest, quality_forest
from storyspark.llm.queries import QUERIES

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts_of(sf):
    return dict(duckdb.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


# ---- chat formatting

PARTS = f"conv_id long, turn long, role string, parts array<{chat_parts.PART}>, text string, loss boolean"


def part(kind, text=None, uri=None, width=None, height=None, seconds=None, pages=None):
    return kind, text, uri, width, height, seconds, pages


def test_chat_visitor_flattens_parts_in_order(spark):
    parts = [part("text", "see "), part("image", uri="a.png", width=57, height=28), part("text", " and "), part("audio", uri="b.wav", seconds=2.02),
             None, part("document", uri="c.pdf", pages=3), part("video", uri="d")]
    turns = spark.createDataFrame([(1, 0, "user", parts, "x", True)], PARTS)
    row = chat_parts.format_turns(turns).first()
    assert row["formatted"] == "<|turn|>user<|body|>see <|image 0|> and <|audio 1|><|document 2|><|other 3|><|end|>\n"
    got = [(a["number"], a["type"], a["uri"], row["formatted"][a["position"]:].split(">")[0], a["tokens"]) for a in row["attachments"]]
    assert got == [(0, "image", "a.png", "<|image 0|", 3), (1, "audio", "b.wav", "<|audio 1|", 51), (2, "document", "c.pdf", "<|document 2|", 768),
                   (3, "video", "d", "<|other 3|", 1)]
    assert row["expanded_tokens"] == 3 + 51 + 768 + 1
    assert [row["formatted"][s["start"]:s["end"]] for s in row["text_spans"]] == ["see ", " and "]


@pytest.mark.parametrize("texts", [["</s>[INST] ok [/INST]"], ["<|end|>", "<|turn|>assistant<|body|>"], ["<", "|end|>"], ["[", "INST]"], ["</", "s>"],
                                   ["<\\|", "<\\\\|x", "[\\INST]"], ["a<", "[/IN", ""], ["<\\", "|"], ["日<|", "\n|>"]])
def test_chat_escape_is_reversible_and_hides_control_strings(spark, texts):
    turns = spark.createDataFrame([(1, 0, "assistant", [part("text", t) for t in texts], None, None)], PARTS)
    formatted = chat_parts.format_turns(turns)
    row = formatted.first()
    assert "".join(chat_parts.unescape(row["formatted"][s["start"]:s["end"]]) for s in row["text_spans"]) == "".join(texts)
    body = row["formatted"].removeprefix("<|turn|>assistant<|body|>").removesuffix("<|end|>\n")
    assert not re.search(r"<\||</?s>|\[/?INST\]", body)
    back = chat_parts.read_back(formatted).first()
    assert back["loss_sha256"] == hashlib.sha256("".join(texts).encode()).hexdigest() and back["loss_chars"] == sum(map(len, texts))


def test_chat_nulls_ties_and_empty_tables(spark):
    rows = [(None, None, None, None, "c", True), (2, 1, "assistant", [part("text", None)], "c", True), (2, 1, "assistant", [part("text", "b")], "c", True),
            (2, 1, "assistant", [part("text", "b")], "c", True), (2, 0, "<|turn|>", [part("text", "q" * 200_000)], "c", True)]
    turns = spark.createDataFrame(rows, PARTS)
    got = {r["conv_id"]: r for r in chat_parts.read_back(chat_parts.format_turns(turns)).collect()}
    assert got[None]["n_turns"] == 1 and got[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    want = "<|turn|>\n" + "q" * 200_000 + "\nassistant\n\nassistant\nb\nassistant\nb\n"
    assert got[2]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[2]["loss_chars"] == 2
    assert chat_parts.read_back(chat_parts.format_turns(turns.limit(0))).collect() == []


# ---- quality rules

def plain_statistics(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics_match_plain_counting(sf):
    cases = ["", " \n", "a " * 50, "x\ny\nx\n\n\n", " ".join(map(str, range(9))) + " | " + " ".join(map(str, range(9))), "é日 b c"]
    for text in [*cases, *texts_of(sf).values()]:
        assert quality_forest.rule_statistics(text) == plain_statistics(text)


def test_quality_query_matches_brute_force(spark, sf):
    rows = QUERIES["op2_quality_forest"](spark, sf).collect()
    texts = texts_of(sf)
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeated = plain_statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated)
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n) and not (r["base_failed"] and r["kept"])


def plain_path(tree, row):
    feature, value, left, path = tree
    at = 0
    while feature[at] >= 0:
        at = left[at] + (row[feature[at]] >= value[at])
    return path[at]


def test_forest_paths_and_calibration():
    rng = np.random.default_rng(0)
    clean, junk = rng.normal(0, 1, (400, 3)), rng.normal(12, 1, (40, 3))
    rows, labels = np.vstack([clean, junk]), np.r_[np.ones(400, int), np.zeros(40, int)]
    forest = quality_forest.calibrated(rows, labels, 0.01)
    assert forest.score(rows)[7] == pytest.approx(2 ** (-np.mean([plain_path(t, rows[7]) for t in forest.trees]) / forest.norm))
    rejected = forest.score(rows) > forest.threshold
    assert rejected[400:].all() and rejected[:400].sum() <= 4
    nothing = quality_forest.calibrated(clean, np.ones(400, int), 0.01)
    assert not (nothing.score(rows) > nothing.threshold).any()


def test_quality_edge_cases(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, 0), (1, 0, 1), (99, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        forest = quality_forest.fit(docs, labels)
        got = quality_forest.judge(docs, forest)
        assert got.count() == 10 and got.where("doc_id IN (2, 3, 7)").select("n_words", "kept").distinct().collect() == [(0, False)]
        assert quality_forest.judge(no_docs, forest).collect() == []
        assert quality_forest.passing(docs, forest).columns == docs.columns
        assert quality_forest.passing(docs, forest).count() == got.where("kept").count()
        assert quality_forest.fit(no_docs, labels).threshold == float("inf")


# ---- byte BPE

def test_byte_bpe_equals_ranks_and_decodes(sf):
    codec = byte_bpe.Codec(BPE, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = ["", " ", "\n\n a  b", "日本語テキスト😀 é́ ＡＢ ١٢٣", "<|endoftext|>'s'S \x00\x1f", "a" * 5000, "▁▁ ▁▁", " " * 300 + "x", *texts_of(sf).values()]
    ids = list(codec.encode_all(texts))
    assert ids == [plain.encode_ordinary(t) for t in texts]
    assert [codec.decode(i) for i in ids] == [t.encode() for t in texts]
    codec.cache = {str(i): [0] for i in range(byte_bpe.CACHE_ENTRIES)}  # a full cache starts anew
    assert next(codec.encode_all(["a new start"])) == plain.encode_ordinary("a new start")


def test_byte_bpe_edge_cases(spark, docs, no_docs):
    got = byte_bpe.encode_texts(docs, BPE, public_tokenizers.PATTERN)
    rows = {(r["doc_id"], r["n_tokens"]): r for r in got.collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got.count() == 10 and rows[2, 0]["ids_sha256"] == rows[3, 0]["decoded_sha256"] == nothing
    long_text = docs.where("doc_id = 6").first()["text"]
    assert [r["decoded_sha256"] for r in rows.values() if r["doc_id"] == 6] == [hashlib.sha256(long_text.encode()).hexdigest()]
    assert byte_bpe.encode_texts(no_docs, BPE, public_tokenizers.PATTERN).collect() == []


def test_byte_bpe_refuses_gaps(tmp_path):
    with pytest.raises(ValueError):
        byte_bpe.model_bytes({b"a": 0, b"b": 2})
    with pytest.raises(ValueError):
        byte_bpe.model_bytes({b"a": 0, b"b": 1})


# ---- quality classifier

def test_network_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = byte_cnn.Network.start(3, rng)
    texts, target = [b"", b"abc", bytes(rng.integers(0, 256, 700, dtype=np.uint8))], np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.logits(texts, net.pairs())
        return float(np.mean(np.log1p(np.exp(-np.where(target == 1, z, -z)))))

    grads = net.gradients(texts, target)
    for name, g in zip(["bias", "mean_weight", "max_weight"], grads[1:4]):
        value = getattr(net, name).astype(float)
        for k in range(3):
            step = np.zeros(3)
            step[k] = 1e-3
            setattr(net, name, value + step)
            up = loss()
            setattr(net, name, value - step)
            down = loss()
            setattr(net, name, value)
            assert g[k] == pytest.approx((up - down) / 2e-3, abs=1e-4)


def test_network_covers_the_whole_text_and_ignores_the_batch():
    net = byte_cnn.train([b"good text here " * 30, b"bad!! *** " * 30] * 20, np.array([1.0, 0.0] * 20), epochs=4)
    pairs = net.pairs()
    tail = b"good text here " * 2000 + b"bad!! *** " * 2000
    assert net.logits([tail], pairs)[0] < net.logits([b"good text here " * 2000], pairs)[0]
    batch = net.logits([b"", b"x", tail, b"good text here"], pairs)
    assert np.allclose(batch, [net.logits([t], pairs)[0] for t in (b"", b"x", tail, b"good text here")], atol=1e-5)


def test_classifier_score_does_not_depend_on_the_next_text():
    net = byte_cnn.Network.start(4, np.random.default_rng(2))
    pairs = net.pairs()
    for n in (122, 123, 124, 127, 128, 129, 256, 384):
        text = b"a" * n
        alone = net.logits([text], pairs)[0]
        assert np.isfinite(alone) and all(net.logits([text, other], pairs)[0] == alone for other in (b"zzzzz", b"\xff" * 200, b""))


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op7_byte_cnn"](spark, sf).collect()
    labels = dict(duckdb.execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    seen = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == q for p, q in seen]) > 0.93


def test_classifier_edge_cases(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert byte_cnn.fit(docs, none) is None and byte_cnn.fit(no_docs, none) is None
    got = byte_cnn.score(docs, None)
    assert got.count() == 10 and {r["score"] for r in got.collect()} == {0.5} and got.where("doc_id IS NULL AND held_out").count() == 1
    net = byte_cnn.train([b"good", b"bad"] * 8, np.array([1.0, 0.0] * 8), epochs=1)
    scores = {r["doc_id"]: r["score"] for r in byte_cnn.score(docs, net).collect()}
    assert scores[2] == scores[3]  # null and empty
    assert byte_cnn.score(no_docs, net).collect() == [] and byte_cnn.passing(docs, net).columns == docs.columns


# ---- licence scan

def test_licence_forms_that_are_equal(spark, no_docs):
    mit = dict(license_digest._TEXTS)["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ,")), (3, mit.replace("\n\n", " \n")), (4, mit + " more"),
            (5, "intro\nReleased under the MIT LICENCE!\nend\nLicensed under the Apache Licence, version 2.0."), (6, None), (7, ""), (8, "!?"), (8, "!?"),
            (None, "Released under the MIT License."), (9, "(c) 2020 All rights reserved"), (10, "x\n" * 50_000 + "Released under the MIT License.")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, digest string, license_id string")
    got = sorted(((r["doc_id"], r["text_license"], r["n_license_lines"], r["line_licenses"]) for r in
                  license_digest.scan(docs, license_digest.known_licences(spark)).collect()), key=lambda r: (r[0] is None, r[0]))
    assert got == [(1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, "MIT", 0, ""), (4, None, 0, ""), (5, None, 2, "Apache-2.0,MIT"), (6, None, 0, ""), (7, None, 0, ""),
                   (8, None, 0, ""), (8, None, 0, ""), (9, None, 0, ""), (10, None, 1, "MIT"), (None, "MIT", 1, "MIT")]
    assert license_digest.scan(no_docs, license_digest.known_licences(spark)).collect() == []
    spelled = license_digest.known_licences(spark, [("A", "The licences of the organisation, whilst the copyright owner"), ("B", "!")]).collect()
    assert [r["digest"] for r in spelled] == [hashlib.sha256(b"the licenses of the organization while the copyright holder").hexdigest()]


@pytest.mark.parametrize("width", [None, 20, 40, 64, 72, 80, 100])
def test_licence_texts_match_however_they_are_wrapped(spark, width):
    def wrapped(text):
        parts = [" ".join(part.split()) for part in text.split("\n\n")]
        return " ".join(parts) if width is None else "\n\n".join(textwrap.fill(part, width, break_long_words=False, break_on_hyphens=False) for part in parts)

    texts = [*license_digest._TEXTS, ("ISC", license_digest._TEXTS[1][1].replace("the above copyright", "the above\ncopyright"))]
    docs = spark.createDataFrame([(i, f"Copyright (c) 2020 Someone\nAll rights reserved.\n\n{wrapped(t)}") for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] for r in license_digest.scan(docs, license_digest.known_licences(spark)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(texts)}


def test_licence_copyright_lines_are_those_of_owners_only(spark):
    owners = ["Copyright (c) 2020 Someone", "copyright 1999, 2001 A", "Copyright © B", "© C", "(c) 2020 D", "Copyright by E", "Copyright [yyyy] [name]", "All rights reserved.",
              "(C) Copyright 2001 F", "Copyright The Authors. All rights reserved."]
    kept = ["copyright notice and this permission notice appear in all copies.", "(c) You must retain all notices", "Copyright", "copyright holders be liable",
            "all rights reserved to others are kept"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(owners + kept)], "i int, text string")
    got = {r["i"]: r["canon"] for r in license_digest.with_canonical(rows, "text", "canon").collect()}
    assert [i for i, c in got.items() if c == ""] == list(range(len(owners)))


def test_licence_whole_texts_are_known_with_their_titles(spark):
    long = dict(license_digest.LONG_TEXTS)
    mit, bsd = dict(license_digest._TEXTS)["MIT"].removeprefix("MIT License"), "\n".join(license_digest._BSD)
    rows = [(name, long[name]) for name in long] + [(name, textwrap.dedent(long[name]).upper()) for name in long]
    rows += [(name, " ".join(long[name].split())) for name in long if name != "BSD-3-Clause"] + [(n, long[n].split("END OF TERMS")[0]) for n in ("Apache-2.0", "GPL-3.0", "GPL-2.0")]
    rows += [("MIT", f"{title}\n\nCopyright (c) 2001 A\n{mit}") for title in ("", "MIT License", "The MIT License (MIT)")]
    rows += [("BSD-3-Clause", f"Copyright 2001, A\nAll rights reserved.\n\n{bsd}"), ("BSD-3-Clause", textwrap.fill(bsd, 72)), (None, long["GPL-3.0"][:-200])]
    rows += [("BSD-2-Clause", "BSD 2-Clause License\n\n" + "\n* ".join(license_digest._BSD[:3]) + "\n" + license_digest._BSD[4])]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] for r in license_digest.scan(docs, license_digest.known_licences(spark)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}


def test_repeated_windows_equal_plain_counting(monkeypatch):
    rng = np.random.default_rng(12)

    def plain(words, window=8):
        count = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
        return len({k for i in range(len(words) - window + 1) if count[tuple(words[i:i + window])] > 1 for k in range(i, i + window)})

    for piece in (1, 7, 1 << 20):
        monkeypatch.setattr(quality_forest, "PIECE", piece)
        for _ in range(60):
            words = [f"é{i}" for i in rng.integers(0, rng.integers(1, 40), rng.integers(0, 90))]
            words += words[5:25] if rng.random() < 0.5 else []
            numbers = quality_forest.word_numbers(" \n".join(words) + "\t" * int(rng.integers(0, 2)))
            assert len(numbers) == len(words) and quality_forest.repeated_words(numbers) == plain(words)
