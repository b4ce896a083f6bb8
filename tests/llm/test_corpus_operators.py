"""WARC, line templates, cap filters, packing, BagMinHash, components and the pipeline."""

import collections
import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from storyspark.llm import bag_minhash, bin_slack, cap_filters, line_templates, warc
from storyspark.llm.components import contract
from storyspark.llm.queries import QUERIES

GPT = public_tokenizers.path("byte_bpe_50k.json")


# ---- components

@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components_equal_union_find(spark, kind):
    rng = np.random.default_rng(3)
    edges = {"path": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 200)] + [(7, 7)], "none": [],
             "random": [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)]}[kind]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in contract(spark.createDataFrame(edges + edges, "a long, b long")).collect()}
    for a, b in itertools.combinations([n for n in parent if n in got], 2):
        assert (got[a] == got[b]) == (find(a) == find(b))
    assert all(n in got or all(e == (n, n) for e in edges if n in e) for n in parent)


# ---- WARC

def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, digest string, record string")


def test_warc_round_trip_of_awkward_pages(spark):
    same, tricky = "é" * 500 + "x", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "a\r\n\r\nb" * 300
    rows = [(1, "http://a/\r\nX: y", same), (2, None, same), (3, "http://c", same), (4, "http://d", None), (5, "http://e", ""), (6, "http://f", "\r\n\r\n"),
            (7, "http://g", tricky), (8, "http://h", tricky), (8, "http://h", tricky), (None, "http://i", same), (9, "http://j", "short"), (10, "http://k", "short"),
            (11, "http://l", "z" * 3_000_000), (12, "http://m", "q" * 1000), (13, "http://n", "q" * 1000), (14, "http://o", "r" * 999), (15, "http://p", "r" * 999)]
    got = warc.round_trip(pages(spark, rows)).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        revisit = len(data) >= 1000 and i != max(ids)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert warc.round_trip(pages(spark, rows).limit(0)).collect() == []


def record(kind, name, block=b"", **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": "2020-01-01T00:00:00Z", **{k.replace("_", "-"): v for k, v in more.items()}}
    lines = [f"{k}: {v}" for k, vs in head.items() for v in (vs if isinstance(vs, list) else [vs])]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_warc_assembly_through_either_side_and_one_hop(spark, tmp_path):
    http = {"Content_Type": "application/http"}
    first = [record("warcinfo", "<i>"), record("response", "<r1>", b"HTTP/1.1 200 OK\r\n\r\nbody", **http), record("request", "<q1>", b"GET", WARC_Concurrent_To="<r1>"),
             record("metadata", "<m1>", b"k: v\r\n", WARC_Concurrent_To="<q1>"), record("response", "<r2>", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Concurrent_To=["<q2>", "<m2>"], **http)]
    second = [record("request", "<q2>"), record("metadata", "<m2>"), record("request", "<lost>", WARC_Concurrent_To="<none>"), record("resource", "<r3>", b"raw\x00\xff")]
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, first)))  # one member a record
    (tmp_path / "b.warc").write_bytes(b"".join(second))
    got = {r["capture_id"]: r for r in warc.assemble(spark, str(tmp_path)).collect()}
    ids = lambda rows: [r["record_id"] for r in rows or []]
    assert ids(got["<r1>"]["requests"]) == ["<q1>"] and ids(got["<r1>"]["metadata"]) == ["<m1>"] and got["<r1>"]["response"]["payload"] == b"body"
    assert ids(got["<r2>"]["requests"]) == ["<q2>"] and ids(got["<r2>"]["metadata"]) == ["<m2>"] and got["<r2>"]["response"]["payload_bytes"] == 0
    assert got["<r3>"]["response"]["payload"] == b"raw\x00\xff" and not got["<r3>"]["requests"]
    assert got["<lost>"]["response"] is None and set(got) == {"<r1>", "<r2>", "<r3>", "<lost>", "<i>"}


def test_warc_parser_refuses_cut_archives():
    whole = record("resource", "<r>", b"x" * 100)
    for cut in (whole[:-50], whole[:30]):
        with pytest.raises(ValueError):
            list(warc.parse(cut))
    assert list(warc.parse(b"")) == []


# ---- line templates

def plain_line_dedup(texts, similarity=0.8):
    """The rule on plain lists: {id: text after}."""
    leaves, where = collections.defaultdict(dict), collections.defaultdict(list)
    for i, text in texts.items():
        for k, line in enumerate((text or "").split("\n")):
            words = line_templates.tokens(line)
            if len([w for w in words if w != "<*>"]) >= 5:
                leaves[(len(words), *words[:3])][tuple(words)] = hashlib.blake2b("\x1f".join(words).encode(), digest_size=16).digest()
                where[tuple(words)].append((i, k))
    groups = collections.defaultdict(list)
    for key, lines in leaves.items():
        def parse(items):
            templates, of = [], {}
            for words in items:
                scores = [sum(a == b for a, b in zip(t, words)) for t in templates]
                if scores and max(scores) >= similarity * len(words):
                    k = scores.index(max(scores))
                    templates[k] = tuple(a if a == b else "<*>" for a, b in zip(templates[k], words))
                else:
                    k = len(templates)
                    templates.append(tuple(words))
                of[words] = k
            return templates, of

        digest = lambda w: hashlib.blake2b("\x1f".join(w).encode(), digest_size=16).digest()
        templates, of = parse(sorted(lines, key=lines.get))
        again, merged = parse(sorted(set(templates), key=digest))
        for words in lines:
            groups[key, again[merged[templates[of[words]]]]] += where[words]
    short = collections.defaultdict(list)
    for i, text in texts.items():
        for k, line in enumerate((text or "").split("\n")):
            words = line_templates.tokens(line)
            if len([w for w in words if w != "<*>"]) < 5 and any(c.isalpha() for c in "".join(words)):
                short[tuple(words)].append((i, k))
    drop = collections.defaultdict(set)
    for least, places in [*((2, p) for p in groups.values()), *((10, p) for p in short.values())]:
        ids = {i for i, _ in places}
        for i, k in places:
            if len(ids) >= least and i != min(ids):
                drop[i].add(k)
    return {i: None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if k not in drop[i]) for i, t in texts.items()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_line_templates_equal_the_plain_rule(spark, size):
    sf = f"/root/testdata/{size}"
    texts = dict(duckdb.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    got = {r["doc_id"]: r["text"] for r in QUERIES["op5_line_templates"](spark, sf).collect()}
    assert got == plain_line_dedup(texts) and got != texts


def test_line_templates_of_a_document_with_many_lines(spark):
    lines = [f"every line of this document says the same as number {'x' * (i % 7 + 1)} of the other" for i in range(50_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines[:100])), (2, "\n".join(lines))], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_templates.drop_recurring(docs, counts=True).collect()}
    assert got == {1: ("\n".join(lines[:100]), 100, 0), 2: ("", 50_000, 50_000)}


def test_line_templates_generalise_fields_and_keep_the_first(spark):
    log = "session opened for user {} from host {} at {} with a long list of many words"
    texts = {1: "only here and nowhere else today\n" + log.format("ann", "h1", "10:00"), 2: log.format("bob", "h22", "11:30") + "\nshort line",
             3: log.format("cy", "h3", "09:15"), 4: "short line", 5: None, 6: "", 7: "1 2 3 4 5 6 7\nkept by this one only, I hope", 8: "1 2 3 4 5 6 8"}
    docs = spark.createDataFrame([(i, t, "p", [1]) for i, t in texts.items()], "doc_id long, text string, pos string, drop array<int>")
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(docs).collect()}
    assert got == plain_line_dedup(texts)
    assert got[1] == texts[1] and got[2] == "short line" and got[3] == "" and got[4] == "short line" and got[5] is None and got[7] == texts[7] and got[8] == texts[8]


def test_line_templates_short_lines_need_more_documents(spark):
    texts = {i: f"All rights reserved.\nPage {i}\n}}\n\n42\n" + ("Seldom seen." if i < 9 else "other") for i in range(10)}
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[0] == texts[0] and all(got[i] == "}\n\n42\n" + ("Seldom seen." if i < 9 else "other") for i in range(1, 10))
    few = spark.createDataFrame(list(texts.items())[:9], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(few).collect()} == dict(list(texts.items())[:9])
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(few, short_min_docs=3).collect()}
    assert got[0] == texts[0] and set(got.values()) == {texts[0], "}\n\n42"}


def test_line_templates_streams_merge(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "STREAM_LINES", 3)
    base = "the start of every line is the same and then come {} {} in the middle of it all"
    docs = spark.createDataFrame([(i, base.format(f"a{chr(97 + i)}", f"b{chr(97 + i)}")) for i in range(20)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(docs).collect()}
    assert got[0] and not any(got[i] for i in range(1, 20))


def test_line_templates_do_not_depend_on_the_size_of_a_leaf(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for places, vocabulary, similarity in ((10, 3, 0.8), (5, 6, 0.8), (21, 2, 0.8), (10, 4, 0.5), (6, 9, 0.3)):
        draws = {tuple(map(int, r)) for r in rng.integers(0, vocabulary, (300, places - 3))}
        lines = [["all", "open", "alike", *("<*>" if t == 1 else f"w{chr(97 + t)}" for t in row)] for row in sorted(draws)]
        outcomes = []
        for bound in (10_000, 20, 0):
            monkeypatch.setattr(line_templates, "STREAM_LINES", bound)
            outcomes.append(line_templates.parse(lines, similarity))
        assert outcomes[0] == outcomes[1] == outcomes[2] and 1 <= len(set(outcomes[0])) < len(lines)
    rows = rng.integers(0, 4, (120, 9))
    texts = {i: "all open alike here now " + " ".join(f"w{chr(97 + t)}" for t in row) for i, row in enumerate(rows.tolist())}
    monkeypatch.setattr(line_templates, "STREAM_LINES", 7)
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain_line_dedup(texts) and "" in got.values()


def test_line_templates_edge_cases(spark, docs, no_docs):
    got = line_templates.drop_recurring(docs, counts=True)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"] and got.count() == 10
    rows = collections.Counter((r["doc_id"], r["text"] and r["text"][:10], r["n_dropped"]) for r in got.collect())
    assert rows[5, "", 1] == 2 and rows[None, "", 1] == 1 and rows[2, None, 0] == 1 and rows[5, "other text", 0] == 1
    assert line_templates.drop_recurring(no_docs).collect() == []


# ---- cap filters

def plain_links(rows, similarity=0.98):
    ok = [(k, i, label, np.array(v, float) / np.abs(np.array(v, float)).max()) for k, (i, v, label) in enumerate(rows)
          if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = collections.defaultdict(set)
    for (a, _, la, x), (b, _, lb, y) in itertools.combinations(ok, 2):
        if la == lb and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= similarity:
            links[a].add(b)
            links[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        out.append((i, len(links[k]), min(ids) if ids else None))
    return sorted(out, key=repr)


def test_cap_filters_find_every_link(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for size in (1, 2, 5, 40, 120):
        for _ in range(3):
            centre = rng.normal(size=32)
            for _ in range(size):
                rows.append((n, (centre + rng.normal(size=32) * 0.13).tolist(), n % 2))
                n += 1
    chain = rng.normal(size=32)
    for _ in range(30):
        rows.append((n, chain.tolist(), 7))
        step = rng.normal(size=32)
        chain = chain / np.linalg.norm(chain) + 0.19 * step / np.linalg.norm(step)
        n += 1
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 32, 1), (n + 3, [float("nan")] * 32, 1), (n + 4, [None] * 32, 1), (n + 5, [1.0] * 32, None),
           (n + 6, [1e300] * 32, 3), (n + 7, [1e-300] * 32, 3), (n + 8, [1.0, 2.0], 3), (n + 9, [2.0, 4.0], 3), (n + 10, [5.0], 3), (None, [1.0, 2.0], 3),
           (n + 9, [2.0, 4.0], 3), (n + 9, [9.0, -4.0], 3), (n + 11, [float("inf"), 1.0], 3)]
    rows += odd
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, n int")
    got = cap_filters.near_duplicates(table)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()), key=repr) == plain_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())
    assert cap_filters.near_duplicates(table.limit(0)).collect() == []


def test_cap_filter_cells_do_not_change_links(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "RESIDENTS", 4)
    monkeypatch.setattr(cap_filters, "VISITORS", 6)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.1).tolist(), 0) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = cap_filters.near_duplicates(table)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()), key=repr) == plain_links(rows)


def test_list_decoding_finds_all_directions_of_the_cap():
    code, rng = cap_filters.Code(24, blocks=2, words=16), np.random.default_rng(0)
    x = rng.normal(size=24)
    x /= np.linalg.norm(x)
    home, near = code.decode(x, 0.98)
    y = x @ code.rotation
    every = np.add.outer(code.words[0] @ y[code.cuts[0]], code.words[1] @ y[code.cuts[1]]).ravel()
    cap = 0.98**2 * every.max() - cap_filters.MARGIN * np.sqrt(1 - 0.98**2) * np.sqrt(2 / 24)
    assert home == every.argmax() and sorted(near.tolist()) == np.flatnonzero(every >= cap).tolist()


# ---- packing

def test_packing_is_whole_and_gapless(spark, sf):
    rows = QUERIES["op9_bin_slack"](spark, sf).collect()
    tok = Tokenizer.from_file(GPT)
    want = {}
    for i, text in duckdb.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for piece, n in enumerate([len(ids) % 1024] * (len(ids) % 1024 > 0) + [1024] * (len(ids) // 1024)):
            want[i, piece] = (start, n, zlib.crc32(ids[start:start + n].tobytes()))
            start += n
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    check_places(rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 1024) + 2


def check_places(rows, capacity=1024):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


def test_fullest_combination_is_the_best_sum():
    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 40), 5, replace=False), rng.integers(1, 4, 5))}
        room = int(rng.integers(0, 80))
        items = [n for n, c in counts.items() for _ in range(c)]
        best = max(s for k in range(1 << len(items)) if (s := sum(n for j, n in enumerate(items) if k >> j & 1)) <= room)
        used = bin_slack.fullest(counts, room)
        assert sum(n * c for n, c in used) == best and all(c <= counts[n] for n, c in used)


def test_patterns_use_every_piece_once():
    rng = np.random.default_rng(4)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 101, 60), rng.integers(1, 500, 60))}
    found = bin_slack.patterns(counts, 100)
    spent = collections.Counter()
    for used, times in found:
        assert sum(n * c for n, c in used) <= 100 and times > 0
        for n, c in used:
            spent[n] += c * times
    assert spent == counts


def test_packing_edge_cases(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(bin_slack, "RANK_GROUP", 3)
    got = bin_slack.pack_documents(docs, GPT, public_tokenizers.PATTERN, token_ids=True).collect()
    check_places(got)
    tok = Tokenizer.from_file(GPT)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"], r["length"] if r["doc_id"] in (5, None) else None].append(r)
    long_text = docs.where("doc_id = 6").first()["text"]
    joined = [t for r in sorted(by[6, None], key=lambda r: r["piece"]) for t in r["token_ids"]]
    assert joined == [*tok.encode(long_text, add_special_tokens=False).ids, 2]
    assert [r["token_ids"] for r in by[2, None]] == [[2]] and [r["token_ids"] for r in by[3, None]] == [[2]]
    assert by[8, None][0]["token_ids"] == [*tok.encode(docs.where("doc_id = 8").first()["text"], add_special_tokens=False).ids, 2]
    assert sum(r["doc_id"] == 5 for r in got) == 3
    assert bin_slack.pack_documents(no_docs, GPT, public_tokenizers.PATTERN).collect() == []


# ---- BagMinHash

def bag(text):
    words = (text or "").lower().encode().split()
    return collections.Counter(tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))) if words else collections.Counter()


def plain_classes(texts, similarity=0.8):
    """{id: least id of its class} by comparing all pairs that share a shingle."""
    bags, parent, holders = {i: bag(t) for i, t in texts.items()}, {i: i for i in texts}, collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, b in bags.items():
        for s in b or ["no words"]:
            holders[s].append(i)
    for a, b in {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}:
        union = sum((bags[a] | bags[b]).values())
        if not union or sum((bags[a] & bags[b]).values()) / union >= similarity:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: find(i) for i in texts}


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng, errors = np.random.default_rng(1), []
    for _ in range(40):
        items = np.sort(rng.integers(0, 2**62, 200).astype(np.uint64))
        a = rng.integers(0, 9, 200)
        b = np.where(rng.random(200) < 0.6, a, rng.integers(0, 9, 200))
        bags = [(items[w > 0], w[w > 0]) for w in (a, b)]
        s = bag_minhash.signatures(bags, 512)
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert bag_minhash.overlap(*bags) == pytest.approx(exact)
        errors.append((s[0] == s[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035


def test_signatures_do_not_depend_on_the_batch():
    bags = bag_minhash.shingle_bags([b"one two three four five six seven", b"x", b"a b " * 400, b"one  two\tthree four five six\nseven"])
    together = bag_minhash.signatures(bags)
    assert all((bag_minhash.signatures([b])[0] == together[i]).all() for i, b in enumerate(bags)) and (together[0] == together[3]).all()
    assert [int(c.sum()) for _, c in bags] == [3, 1, 796, 3] and [len(h) for h, _ in bag_minhash.shingle_bags([b"", b" \n"])] == [0, 0]


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_bag_minhash_classes_equal_brute_force(spark, sf_dir):
    texts = dict(duckdb.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    rows = QUERIES["op10_bag_minhash"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == plain_classes(texts)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)


def test_bag_minhash_chains_and_large_groups(spark):
    rng = np.random.default_rng(8)
    words, texts = [f"w{i}" for i in range(200)], {}
    drift = list(words)
    for i in range(40):  # neighbours are near, the ends of the chain are not
        texts[i] = " ".join(drift)
        drift[(i * 7) % 200] = f"n{i}"
    for i in range(100, 180):  # a group of near copies, and copies of some of them
        near = [f"g{k}" for k in range(150)]
        near[int(rng.integers(150))] = f"x{i}"
        texts[i] = texts[i + 100] = " ".join(near)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in bag_minhash.near_duplicates(docs).collect()}
    assert got == plain_classes(texts)
    assert bag_minhash.distinct_documents(docs).count() == len(set(got.values()))


def test_bag_minhash_edge_cases(spark, docs, no_docs):
    rows = bag_minhash.near_duplicates(docs).collect()
    classes = collections.Counter((r["doc_id"], r["class_id"], r["n_copies"], r["kept"]) for r in rows)
    assert classes == collections.Counter({(1, 1, 4, True): 1, (None, 1, 4, False): 1, (5, 1, 4, False): 2, (5, 5, 1, True): 1, (2, 2, 3, True): 1, (3, 2, 3, False): 1,
                                           (7, 2, 3, False): 1, (6, 6, 1, True): 1, (8, 8, 1, True): 1})
    kept = bag_minhash.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 6, 8]
    repeated = docs.where("doc_id = 5")
    assert bag_minhash.distinct_documents(repeated).count() == 2  # two texts under one id, one of them twice
    assert bag_minhash.near_duplicates(no_docs).collect() == [] and bag_minhash.distinct_documents(no_docs).collect() == []


# ---- pipeline

def test_pipeline_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf)
        if name == "packing":
            rows = out.collect()
            check_places(rows)
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept.collect()}
            break
        assert out.columns == docs.columns
        after, before = {r["doc_id"]: r["text"] for r in out.collect()}, {r["doc_id"]: r["text"] for r in kept.collect()}
        if name == "line_dedup":
            assert after == plain_line_dedup(before)
        elif name == "near_dedup":
            assert set(after) == set(plain_classes(before).values())
        else:
            assert set(after) <= set(before)
            good = dict(duckdb.execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
            gone = [i for i in before if i not in after and i in good]
            assert sum(good[i] for i in gone if len(before[i].split()) >= 20) <= 1
        kept = spark.createDataFrame(out.collect(), docs.schema)
    total = corpus_pipeline.run(spark, sf)
    assert total.count() == len(rows)


def test_pipeline_on_awkward_rows(spark, docs, no_docs, sf):
    for rows in (docs.select("doc_id", "text", "kid", "tk"), no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            assert name == "packing" or out.columns == rows.columns
            out.count()


def test_few_vectors_meet_by_chance(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 64))
    x[1:40] = x[0] + rng.normal(size=(39, 64)) * 0.05  # a group of near copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    links, met = cap_filters._links, []
    monkeypatch.setattr(cap_filters, "_links", lambda cells, *rest: met.append(cells.count()) or links(cells, *rest))
    got = cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sum(r["n_links"] for r in got.collect()) == 40 * 39
    assert met[0] < 2 * 1200  # with 16,384 directions at every size, some thirty rows a vector
    assert [cap_filters.words_for(n) for n in (0, 16, 17, 5000, 10**9)] == [128, 128, 256, 4096, cap_filters.MAX_WORDS]
