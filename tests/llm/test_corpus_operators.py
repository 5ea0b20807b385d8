"""Joins, deduplication, mixing and search against brute force, and their edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeline.llm import components, jaccard, mixing, neighbours, quality, substrings

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").lower().encode()
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links, parent = defaultdict(int), {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 10 * len(x & y) >= 8 * len(x | y):
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: (root(i), links[i]) for i, _ in rows}


def near_corpus():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        text = rng.choice(words, 120 + 20 * base)
        for copy in range(12):
            t = text.copy()
            for at in rng.integers(0, len(t), copy // 3):
                t[at] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, " ".join(rng.choice(words, 100))) for i in range(20)]
    return rows


@pytest.mark.parametrize(("small", "block"), [(2000, 2500), (8, 7)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small, block):
    """Also with limits so low that nodes are split again and leaves are cut into blocks."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = [*near_corpus(), (900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, " \n")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute_classes(rows)


def test_pieces_of_comparisons_equal_the_whole(monkeypatch):
    rng = np.random.default_rng(5)
    values = [np.unique(rng.integers(0, 60, n).astype(np.uint64) << np.uint64(58)) for n in (0, 5, 40, 40, 50, 60)]
    left, right = np.arange(6), np.array([5, 0, 3])
    want = np.array([[len(np.intersect1d(values[i], values[j])) for j in right] for i in left])
    others = left[:, None] != right[None]  # a set isn't compared with itself
    for most in (10, 2_000_000):
        monkeypatch.setattr(jaccard, "MOST_AT_ONCE", most)
        assert (jaccard._overlaps(values, left, right) == want)[others].all()
    patterns = {tuple(sorted(rng.choice(4000, n, replace=False).tolist())): i for i, n in enumerate([0, 3, 900, 1500, 2000])}
    got = jaccard._share_nothing(patterns)
    assert got.tolist() == [[not set(a) & set(b) for b in patterns] for a in patterns]


def test_near_duplicates_edge_cases(spark):
    schema = "doc_id long, text string, set_id string, nodes string"
    rows = [(5, "a b c d e f", "x", "y"), (5, "a b c d e f", "x", "y"), (None, "a b c d e f", "x", "y"), (7, None, "x", "y")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in got) == [("5", "None", 2), ("5", "None", 2), ("7", "7", 0), ("None", "None", 2)]
    assert jaccard.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    kept = jaccard.distinct_documents(spark, spark.createDataFrame(rows[:2] + rows[3:], schema), "")
    assert kept.columns == ["doc_id", "text", "set_id", "nodes"] and sorted({r["doc_id"] for r in kept.collect()}) == [5, 7]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def repeat_corpus():
    rng = np.random.default_rng(2)
    words = [f"v{i}" for i in range(3000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage = prose(55)
    rows = [(i, prose(90) + ("\n" + passage + "\n" if i in (3, 8, 9) else " ") + prose(70)) for i in range(15)]
    return passage, rows


def test_repeated_passages_are_found_wherever_they_stand(spark):
    passage, rows = repeat_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substrings.repeated_spans(df).collect()
    assert {r["doc_id"] for r in spans} == {8, 9} and {r["first_doc_id"] for r in spans} == {3}
    text = dict(rows)
    for r in spans:
        cut = text[r["doc_id"]].encode()[r["byte_from"] : r["byte_to"]].decode()
        assert cut.strip() in passage and r["n_words"] == len(cut.split()) >= substrings.MIN_WORDS
    left = {r["doc_id"]: r["text"] for r in substrings.remove_spans(df, substrings.repeated_spans(df)).collect()}
    assert all(left[i] == t for i, t in rows if i not in (8, 9))
    for r in spans:
        raw = text[r["doc_id"]].encode()
        assert left[r["doc_id"]].encode() == raw[: r["byte_from"]] + raw[r["byte_to"] :]


def test_chunks_resist_shifts():
    _, rows = repeat_corpus()
    text = rows[0][1]
    whole, moved = substrings.chunk([text]), substrings.chunk(["an insertion " + text])
    assert len(set(whole[4].tolist()) - set(moved[4].tolist())) <= 2


def test_chunks_tile_the_words():
    texts = ["", "  x ", "один два три " * 30, "De " * 400, "日本語" * 2000, "a" * 5000]
    row, start, end, n, _ = substrings.chunk(texts)
    for i, t in enumerate(texts):
        mine = row == i
        assert n[mine].sum() == len(t.split()) or (i > 3 and n[mine].sum() >= 1)
        assert (start[mine][1:] == end[mine][:-1]).all()
        assert not mine.any() or end[mine][-1] == len(t.encode().rstrip())
        assert all(t.encode()[a:b].decode() for a, b in zip(start[mine], end[mine], strict=True))


def brute_spans(rows, min_words=substrings.MIN_WORDS):
    """Spans by plain loops over bytes, chunks compared as byte strings; (doc_id, from, to, places, chunks, first)."""
    gear = substrings._GEAR.tolist()
    space = b"\t\n\x0b\x0c\r "
    chunks = []
    for doc_id, text in set(rows):
        data = (text or "").encode()
        padded = b"\n" * 16 + data
        after = []  # the hash after each byte of padded
        for i in range(len(padded)):
            h = 0
            for age in range(min(16, i + 1)):
                h = (h + (gear[padded[i - age]] << (2 * age))) & 0xFFFFFFFF
            after.append(h * 0x9E3779B1 & 0xFFFFFFFF)
        places, word, ends = [], 0, {}
        for i, b in enumerate(data):
            if b in space:
                continue
            before = after[15 + i]
            if i == 0 or data[i - 1] in space:
                word = i
                places.append((i, before))
            elif i - word >= substrings.LONG_WORD and before >> 29 == 0 and b & 0xC0 != 0x80:
                places.append((i, before))
            ends[places[-1][0]] = i + 1
        lows = [
            i == 0 or all(h < places[j][1] for j in range(max(0, i - substrings.REACH), i)) and all(h <= places[j][1] for j in range(i + 1, min(len(places), i + substrings.REACH + 1)))
            for i, (_, h) in enumerate(places)
        ]
        firsts = [i for i, low in enumerate(lows) if low]
        for i, j in zip(firsts, [*firsts[1:], len(places)][: len(firsts)], strict=True):
            end = ends[places[j - 1][0]]
            if j < len(places):
                end = min(end, places[j][0])
            touching = places[j][0] if j < len(places) else end
            chunks.append((-1 if doc_id is None else doc_id, text, places[i][0], touching, j - i, data[places[i][0] : end]))
    least = {}
    for doc_id, *_, piece in chunks:
        least[piece] = min(doc_id, least.get(piece, doc_id))
    out, run = [], None
    for doc_id, text, a, b, n, piece in sorted(chunks, key=lambda c: (c[0], c[1], c[2])):
        if least[piece] >= doc_id:
            continue
        if run and run[0] == (doc_id, text) and run[2] == a:
            run = [run[0], run[1], b, run[3] + n, run[4] + 1, min(run[5], least[piece])]
            out[-1] = run
        else:
            run = [(doc_id, text), a, b, n, 1, least[piece]]
            out.append(run)
    return sorted((r[0][0], *r[1:5], None if r[5] < 0 else r[5]) for r in out if r[3] >= min_words)


def test_spans_equal_brute_force(spark):
    """Whole texts of the smallest documents table, with texts without spaces, shared ids, nulls and repeated rows."""
    rng = np.random.default_rng(8)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    glued = "".join(rng.choice(list("日本語文字列検索技術大規模"), 1500))
    rows = [*docs, (None, docs[0][1]), (None, docs[1][1]), (5001, glued), (5002, "序" + glued), (5003, glued[:700] + "x" + glued[700:])]
    rows += [(6001, docs[3][1] + " é"), (6001, "other words first " + docs[3][1]), (6001, docs[3][1] + " é"), (6002, ""), (6003, None)]
    found = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"], r["byte_from"], r["byte_to"], r["n_words"], r["n_chunks"], r["first_doc_id"]) for r in found)
    key = lambda x: (*x[:5], -1 if x[5] is None else x[5])
    assert sorted(map(key, got)) == sorted(map(key, brute_spans(rows)))
    long_spans = {i: sum(b - a for d, a, b, *_ in got if d == i) for i in (5002, 5003, 6001)}
    assert long_spans[5002] > 0.9 * 3 * len(glued) and long_spans[5003] > 0.9 * 3 * len(glued) and long_spans[6001] > 0


def test_spans_of_rows_with_one_id_are_their_own(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    texts = [passage, "é" * 7 + " ü " + passage, passage + " ñ" * 40, "kurz"]
    for ids in ([1, 2, 2, 2], [None, 3, 3, None], [None, None, None, None]):
        rows = list(zip(ids, texts, strict=True))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        left = sorted(r["text"] for r in substrings.remove_spans(df, substrings.repeated_spans(df)).collect())
        assert len(left) == 4 and "kurz" in left and (ids[1] is None or passage in left)
        # Also where texts share an id or have none, the passage stays once.
        assert sum("p40" in t for t in left) == 1


def test_spans_of_very_long_texts(spark):
    text = " ".join(f"t{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, text, 9), (2, "start " + text + " end", 9)], "doc_id long, text string, n_chars long")
    left = {r["doc_id"]: r for r in substrings.remove_spans(df, substrings.repeated_spans(df)).collect()}
    assert left[1]["text"] == text and len(left[2]["text"]) < 200 and left[2]["n_chars"] == len(left[2]["text"])


def test_substring_edge_cases(spark):
    schema = "doc_id long, text string, _spans string, n_chars long"
    long_text = " ".join(f"k{i}" for i in range(60))
    rows = [(1, long_text, "x", 1), (1, long_text, "x", 1), (2, None, "x", None), (3, "", "x", 0), (None, long_text, "x", 1), (4, "é " + long_text, "x", 1)]
    df = spark.createDataFrame(rows, schema)
    spans = substrings.repeated_spans(df)
    assert {r["doc_id"] for r in spans.collect()} == {1, 4}
    out = substrings.remove_spans(df, spans)
    assert out.columns == df.columns and out.count() == 6
    assert all(r["n_chars"] == len(r["text"]) for r in out.filter("doc_id in (1, 4)").collect())
    assert substrings.repeated_spans(df.limit(0)).count() == 0


def test_mix_reaches_targets_and_spares_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = mixing.sized(docs)
    targets = {r["source"]: r for r in mixing.source_targets(sizes).collect()}
    assert sum(t["target"] for t in targets.values()) == pytest.approx(1.5 * sum(t["source_size"] for t in targets.values()))
    a, b = (mixing.mixed_sizes(docs).orderBy("doc_id").collect() for _ in range(2))
    assert a == b
    taken = defaultdict(int)
    for r in a:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(t["target"]) for s, t in targets.items())


def test_schedule_spreads_sources(spark):
    targets = spark.createDataFrame([("a", 100_000, 150_000.0), ("b", 50_000, 50_000.0), (None, 20_000, 40_000.0)], "source string, source_size long, target double")
    slots = mixing.schedule(targets, 100).orderBy("slot").collect()
    per = defaultdict(int)
    for r in slots:
        per[r["source"]] += r["words"]
    assert per == {"a": 150_000, "b": 50_000, None: 40_000}
    half = slots[: len(slots) // 2]
    assert sum(r["source"] == "a" for r in half) / len(half) == pytest.approx(1500 / 2400, abs=0.03)


def test_mix_edge_cases(spark):
    schema = "doc_id long, source string, text string, size string, block string"
    rows = [(1, "a", "x y z", "q", "r"), (1, "a", "x y z", "q", "r"), (2, None, None, "q", "r"), (None, None, "one two", "q", "r"), (3, "b", "", "q", "r")]
    df = spark.createDataFrame(rows, schema)
    got = mixing.mixed_sizes(df).collect()
    assert len(got) == 5 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixed_sizes(df.limit(0)).count() == 0
    assert mixing.mixed_documents(spark, df, "").columns == df.columns


def brute_nearest(ids, x, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), d[i]) for i in order if np.isfinite(d[i])]


def test_nearest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    x, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    got = defaultdict(list)
    for r in neighbours.op10_nearest(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q, found in got.items():
        want = brute_nearest(ids, x, q, 10)
        hits += len({i for i, _ in want} & {i for i, _ in found})
        total += len(want)
        assert found == sorted(found, key=lambda p: (p[1], p[0])) and len(found) == 10
        assert all(s == pytest.approx(np.sqrt(((x[ids == i][0] - x[ids == q][0]) ** 2).sum()), rel=1e-14) for i, s in found)
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0} and hits >= 0.9 * total


@pytest.mark.parametrize("spread", [0.05, 0.5])
def test_nearest_recall_of_a_grown_tree(spark, monkeypatch, spread):
    """More rows than the tree's sample, leaves that are split below the top, and queries and rows in parts."""
    for name, value in {"FIT_ROWS": 600, "GROW_ROWS": 150, "PART_ROWS": 40, "QUERY_ROWS": 7}.items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 6000)] + spread * rng.normal(size=(6000, 16))
    x[100:400] = x[100]  # many equal vectors
    ids = rng.permutation(6000)
    df = spark.createDataFrame([(int(i), row.tolist(), "n", 1) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, node string, part int")
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 6000, 100):
        want = brute_nearest(ids, x, q, 10)
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
        hits += len({i for i, _ in want} & {i for i, _ in got[q]})
        total += 10
    assert hits >= 0.9 * total
    index = neighbours.Index(df.select("vec_id", "embedding"), df.filter("vec_id % 100 = 0").select("vec_id", "embedding"), x[:600].tolist(), 10, 0.95)
    assert len(index.visits) > 1 and index.filed.count() == 6000


@pytest.mark.parametrize("spread", [0.05, 0.5])
def test_nearest_recall_with_the_shipped_limits(spark, spread):
    """More rows than FIT_ROWS, so that the table outgrows the top's sample; limits as they are."""
    rng = np.random.default_rng(8)
    n = neighbours.FIT_ROWS + 4_000
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, n)] + spread * rng.normal(size=(n, 16))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}))
    got = defaultdict(set)
    for r in neighbours.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len(got[q] & {i for i, _ in brute_nearest(np.arange(n), x, q, 10)}) for q in range(0, n, 100))
    assert hits >= 0.9 * 10 * len(range(0, n, 100))


def test_queries_of_another_length_have_no_result(spark):
    rows = [(0, [1.0, 2.0, 3.0])] + [(i, [1.0, float(i), 0.0, 1.0]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id % 30 = 0")).collect()
    assert {r["query_id"] for r in got} == {30}
    assert neighbours.nearest(df, df.filter("vec_id = 0")).count() == 0


def test_top_equals_brute_force():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (500, 4)).astype(float)  # full of ties
    ids = rng.permutation(500)
    found = neighbours._top(rows[:40], ids[:40], rows, ids, 10)
    for q in range(40):
        mine = found[found["query_id"] == ids[q]]
        assert list(zip(mine["vec_id"].tolist(), mine["score"].tolist(), strict=True)) == [(i, d) for i, d in brute_nearest(ids, rows, ids[q], 10)]
    assert len(neighbours._top(rows[:1], ids[:1], rows[:1], ids[:1], 10)) == 0


def test_nearest_of_equal_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(400, [nan, 1.0]), (401, [inf, 1.0]), (402, None), (403, [0.0, 0.0]), (404, [1.0, None]), (405, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, leaf string, part int")
    got = neighbours.nearest(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r["vec_id"])
    assert by == {0: list(range(1, 11)), 100: list(range(10)), 200: list(range(10))}
    few = neighbours.nearest(df.filter("vec_id < 4"), df.filter("vec_id = 0")).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def brute_kept(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    grams = [tuple(words[i : i + 8]) for i in range(n - 7)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    if n < 20 or 100 * len(covered) > 30 * n:
        return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stops = sum(w.strip(".,;:!?").lower() in quality.STOP_WORDS for w in words)
    letters = sum(any(c.isalpha() for c in w) for w in words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (
        2 <= sum(map(len, words)) / n <= 12 and symbols / n <= 0.1 and letters / n >= 0.7 and stops / n >= 0.01
        and (len(lines) - len(set(lines))) / max(len(lines), 1) <= 0.3
    )


def brute_without(rows):
    """(doc_id, text) without the spans of brute_spans."""
    cut = defaultdict(list)
    for doc_id, a, b, *_ in brute_spans(rows):
        cut[doc_id].append((a, b))
    out = []
    for doc_id, text in rows:
        data, at, kept = text.encode(), 0, b""
        for a, b in cut[doc_id]:
            kept, at = kept + data[at:a], b
        out.append((doc_id, (kept + data[at:]).decode()))
    return [(i, t) for i, t in out if t.split()]


def brute_mix(rows):
    """How often the mix takes each of rows (doc_id, text, source), by targets computed one source at a time."""
    size = {i: len(t.split()) for i, t, _ in rows}
    of = defaultdict(list)
    for i, _, s in rows:
        of[s].append(i)
    sources = sorted(of, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in of[s]) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.remove(s)
    times = {}
    for s in sources:
        line, at = sorted(of[s], key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % mixing.BINS, hashlib.md5(str(i).encode()).hexdigest())), 0
        for i in line:
            taken = size[i] * (int(target[s]) // total[s]) + max(0, min(size[i], int(target[s]) % total[s] - at))
            times[i] = -(-taken // size[i])
            at += size[i]
    return times


def test_pipeline_equals_brute_force(spark, monkeypatch, tmp_path):
    """run() over a folder, each stage's whole result against plain loops over the one before."""
    import corpus_pipeline
    from hazeline.llm import common

    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(rng.choice([*["the", "of", "et", "la"] * 20, *[f"wort{i}" for i in range(900)]], n))
    passage = prose(70)
    rows = [(i, "the " + t.replace(" w2", " of w2"), f"s{i % 3}") for i, t in near_corpus()]
    rows += [(200 + i, prose(60) + "\n" + passage + "\n" + prose(50), "s1" if i % 2 else None) for i in range(6)]
    rows += [(300, rows[3][1], "s0"), (300, prose(80), "s0"), (301, rows[3][1], "s2"), (302, prose(40), "s4"), (304, passage, "s1"), (303, prose(600), "s3")]
    rows += [(400, "short text", "s0"), (401, None, "s0"), (402, "", None), (403, "% & # $ " * 30, "s0"), (404, "one line of the text\n" * 12, "s1")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}

    def recording(name, stage):
        def run(spark, docs, sf_dir):
            seen[f"{name} in"] = docs.collect()
            out = stage(spark, docs, sf_dir)
            seen[name], seen[f"{name} columns"] = out.collect(), out.columns
            return out

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [recording(*s) for s in corpus_pipeline.STAGES])
    before = common.n_folders()
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert common.n_folders() == before + len(corpus_pipeline.STAGES)  # the stages' results alone
    names = [n for n, _ in corpus_pipeline.STAGES]
    for earlier, name in zip(names, names[1:], strict=False):
        assert seen[f"{earlier} columns"] == docs.columns and Counter(seen[earlier]) == Counter(seen[f"{name} in"])

    assert Counter(seen["quality_rules"]) == Counter(r for r in seen["quality_rules in"] if brute_kept(r["text"]))
    kept = [(r["doc_id"], r["text"]) for r in seen["quality_rules"]]
    assert 60 < len(kept) < len(rows)

    classes = brute_classes([(n, t) for n, (_, t) in enumerate(kept)])
    groups = defaultdict(set)
    for n, (label, _) in classes.items():
        groups[label].add(kept[n])
    found = [(r["doc_id"], r["text"]) for r in seen["jaccard_join"]]
    assert len(found) == len(groups)
    for group in groups.values():
        mine = [x for x in found if x in group]
        assert len(mine) == 1 and mine[0][0] == min(i for i, _ in group)

    want = brute_without(found)
    assert Counter((r["doc_id"], r["text"]) for r in seen["substring_dedup"]) == Counter(want) and Counter(want) != Counter(found)
    assert all(r["n_chars"] == len(r["text"]) for r in seen["substring_dedup"])

    unique = [r for r in seen["substring_dedup"] if [x["doc_id"] for x in seen["substring_dedup"]].count(r["doc_id"]) == 1]
    assert len(unique) == len(want)
    times = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in unique])
    assert Counter(r["doc_id"] for r in seen["mix_sources"]) == Counter({i: n for i, n in times.items() if n})
    assert {(r["doc_id"], r["text"]) for r in seen["mix_sources"]} <= set(want)

    import public_tokenizers
    import sentencepiece
    from hazeline.llm import pieces

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    ids = Counter((r["doc_id"], tuple(sp.encode(r["text"]))) for r in seen["mix_sources"])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in result.collect()) == ids


def test_mixed_documents_stand_in_the_order_of_the_mix(spark):
    rows = [(i, f"w{i} " + "x y z " * 99, "ab"[i % 2]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [r["doc_id"] for r in mixing.mixed_documents(spark, docs, "").collect()]
    assert Counter(got) == Counter({i: n for i, n in brute_mix(rows).items() if n})
    share = Counter("ab"[i % 2] for i in got)
    for part in np.array_split(np.array(got), 8):  # every stretch has the shares of the whole
        assert (part % 2 == 0).mean() == pytest.approx(share["a"] / len(got), abs=0.12)


def test_one_row_of_each_class_stays(spark):
    t = " ".join(f"q{i}" for i in range(50))
    schema = "doc_id long, text string, first_doc string, row int"
    rows = [(3, t, "x", 1), (5, t + " end", "x", 2), (5, "something else of its own", "x", 3), (7, "alone here", "x", 4), (7, "alone here", "x", 5), (None, "n one", "x", 6), (None, "n two", "x", 7)]
    rows += [(8, None, "x", 8), (8, "", "x", 9), (9, "ALONE here", "x", 10)]
    kept = jaccard.distinct_documents(spark, spark.createDataFrame(rows, schema), "")
    assert kept.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(r["row"] for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 9]


def test_near_duplicates_of_very_long_texts(spark):
    text = " ".join(f"z{i}" for i in range(60_000))
    rows = [(1, text), (2, text + " more words at the end"), (3, " ".join(f"y{i}" for i in range(60_000)))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
