"""Text operators against brute force, libraries and edge cases."""

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazeline.llm import language, pieces, quality, token_counts, token_files, units, warc
from hazeline.llm.registry import QUERIES, SQL
from tests.oracle import assert_equal

SF = "/root/testdata/sf0.001"
LONG = "mot de la passe " * 3000
CASES = [(1, None), (2, ""), (3, "   \n\t"), (4, "Hello  world, the end"), (5, "été ñandú ß 日本 😀\x0b"), (6, LONG), (7, "a b c"), (7, "a b c"), (None, "null id")]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and a column whose name the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_words string, digest string, ids string"
    return spark.createDataFrame([(i, t, "en" if t else None, "s", "x", "y", "z") for i, t in CASES], schema)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert assert_equal(QUERIES[name], SQL[name], spark, "/root/testdata/sf0.01") > 0


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(list("ab#"), 1 + i)) + "\nx\nx\n") for i in range(40)] + [(90, None), (91, ""), (92, "\n\n")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        want = brute_quality(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_edge_cases(spark, docs):
    ruled = quality.quality_rules(docs.withColumn("_words", F.lit("mine")))
    assert ruled.count() == len(CASES) and len(set(ruled.columns)) == len(ruled.columns)
    assert dict(ruled.dtypes)["n_words"] == "bigint" and {r["_words"] for r in ruled.collect()} == {"mine"}
    prose = "The cat and the dog sat on it, while others of them were at the far end by that house for a day in June"
    clash = spark.createDataFrame([(1, prose, "mine", 7.5, "h")], "doc_id long, text string, n_words string, kept double, _hashes string")
    kept = quality.kept_documents(spark, clash, "")
    assert kept.schema == clash.schema and kept.collect() == clash.collect()
    assert quality.quality_rules(docs.limit(0)).count() == 0
    assert quality.kept_documents(spark, docs, "").columns == docs.columns


def test_quality_of_marked_and_many_words(spark):
    """A stop word counts whatever marks follow it, and length alone rejects no text."""
    names = ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7, 11, 17)) + chr(97 + i % 26) * (i % 3) for i in range(30)]
    rows = [(1, " ".join("the..........." for _ in range(30))), (2, "\n".join(f"{n}{i} the{'.' * (i % 20)}" for i in range(60_000) for n in names[:1]))]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_stop_words"] == 30 and got[2]["n_words"] == 120_000 and got[2]["n_stop_words"] == 60_000 and got[2]["kept"]


def test_token_counts(spark, docs, tmp_path):
    t = units.tokenizer(units.TOKENIZER)
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second run finds everything in the cache
        got = token_counts.token_counts(docs, cache).collect()
        want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in CASES)
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert spark.read.parquet(cache).count() == len({x or "" for _, x in CASES})
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_token_files_round_trip(spark, docs, tmp_path):
    t = units.tokenizer(units.TOKENIZER)
    rows = [*CASES, (8, "x<|endoftext|> y"), (9, "two\n\nlines  and spaces ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_files.write_token_files(df, str(tmp_path / "f"))
    got = token_files.read_token_files(spark, str(tmp_path / "f")).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [t.encode(x or "", add_special_tokens=False).ids + [0] for _, x in order]
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == ids
    assert [r["start"] for r in got] == (np.cumsum([0, *map(len, ids)])[:-1]).tolist()
    token_files.write_token_files(df.limit(0), str(tmp_path / "e"))
    assert token_files.read_token_files(spark, str(tmp_path / "e"), digests=True).count() == 0


def library_ids(spark):
    """Every text of the smallest documents table with its ids by the library, in order of doc_id."""
    t = units.tokenizer(units.TOKENIZER)
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    return [(i, x, e.ids) for (i, x), e in zip(rows, t.encode_batch([x for _, x in rows], add_special_tokens=False), strict=True)]


def test_token_queries_equal_library_on_whole_texts(spark):
    want = library_ids(spark)
    got = {r["doc_id"]: r for r in QUERIES["op8_token_counts"](spark, SF).collect()}
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in got.items()} == {i: (len(x.encode()), len(ids), len(ids) > 1024) for i, x, ids in want}
    assert {r["over_limit"] for r in got.values()} == {True, False}
    got = {r["doc_id"]: r for r in QUERIES["op9_token_files"](spark, SF).collect()}
    start = 0
    for i, _, ids in want:
        ids = [*ids, 0]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(want)


def test_equal_rows_are_encoded_once(spark, monkeypatch, tmp_path):
    df = spark.createDataFrame([(None, "some words " * 9)] * 400 + [(1, "other"), (2, None)], "doc_id long, text string").repartition(3)
    fresh = str(tmp_path / "cache")
    got = token_counts.token_counts(df, fresh).collect()
    assert len(got) == 402 and {r["n_tokens"] for r in got if r["doc_id"] is None} == {len(units.tokenizer(units.TOKENIZER).encode("some words " * 9).ids)}
    run = token_counts._encode(units.TOKENIZER, b"v")
    batch = pa.record_batch([pa.array([b"d"] * 5 + [b"e"]), pa.array(["x y"] * 5 + ["z"])], names=["digest", "text"])
    assert sum(b.num_rows for b in run(iter([batch, batch]))) == 2


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_pack_round_trip(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert token_files.unpack(control, data, len(values)).tolist() == values


@lru_cache
def unit_encoder():
    return units.UnitEncoder(units.TOKENIZER, most=200)


SNIPPETS = ["a", "the", " ", "  ", "\n", "\t", "é", "1", "23", "!?", "<|endoftext|>", "'s", "日本", "😀", "\r\n", "x y", " ", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SNIPPETS), max_size=14).map("".join))
def test_unit_encoder_equals_library(text):
    want = units.tokenizer(units.TOKENIZER).encode(text, add_special_tokens=False).ids
    ids, n = unit_encoder().encode([text, "", text])
    assert ids.tolist() == 2 * want and n.tolist() == [len(want), 0, len(want)]


@pytest.fixture(scope="module")
def piece_encoder():
    return pieces.Encoder(pieces.vocabulary(pieces.MODEL))


@pytest.fixture(scope="module")
def processor():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_pieces_equal_library_on_random_text(piece_encoder, processor):
    rng = np.random.default_rng(5)
    parts = [t for t in piece_encoder.v.text if t]
    rows = ["".join(rng.choice(parts, rng.integers(1, 10))).replace("▁", " ") for _ in range(2000)]
    rows += ["".join(rng.choice(list("abcdeést hnio ①"), rng.integers(1, 40))) for _ in range(2000)] + [x or "" for _, x in CASES] + ["", " ", "  ", "a▁b", "<s>"]
    got = [np.frombuffer(b, "<i4").tolist() for b in piece_encoder.encode(rows)]
    assert got == [processor.encode(x) for x in rows]
    assert pieces.decode(piece_encoder.v, [np.array(x, np.int32) for x in got]) == [x.replace("▁", " ") for x in rows]


def test_merges_of_a_piece_come_before_it(piece_encoder):
    """Pairs are decided by merge ranks that grow along every merge tree."""
    v = piece_encoder.v
    for edge in (v.right_edge, v.left_edge):
        child, parent = edge[:, 1], edge[:, 0]
        some = child >= 0
        assert (v.rank[child[some]] < v.rank[parent[some]]).all()


def test_pieces_query(spark, docs, processor):
    got = pieces.digests(docs).collect()
    want = sorted((str(i), zlib.crc32(np.array(processor.encode(x or ""), "<i4").tobytes())) for i, x in CASES)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == want and all(r["round_trip"] for r in got)
    assert pieces.digests(docs.limit(0)).count() == 0


def test_columns_named_as_results_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", 7, "old")], "doc_id long, text string, IDS int, decoded string")
    out = pieces.decoded(pieces.encoded(df))
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert out.first()["decoded"] == "a b"


def test_suffix_automaton_holds_exactly_the_substrings():
    text = [0, 1, 1, 0, 2, 1, 1, 0, 1]
    moves = language.suffix_automaton(text)

    def held(xs):
        at = 0
        for x in xs:
            if x not in moves[at]:
                return False
            at = moves[at][x]
        return True

    inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for n in range(1, 5):
        for k in range(3**n):
            xs = tuple((k // 3**i) % 3 for i in range(n))
            assert held(xs) == (xs in inside)


def test_phrase_counts_equal_brute_force():
    rng = np.random.default_rng(1)
    model = rng.integers(0, 3, 60)
    steps = language._automaton(model, 4)
    text = "".join(map(str, model))
    rows = [rng.integers(0, 4, n) for n in (1, 5, 40, 40)]

    def brute(xs):
        n, held = 1, ""
        for x in map(str, xs):
            if held + x in text:
                held += x
            else:
                n, held = n + 1, x if x in text else ""
        return n

    got = language.phrase_counts(np.concatenate(rows), np.array([len(r) for r in rows]), steps)
    assert got.tolist() == [brute(r) for r in rows]


@pytest.mark.parametrize("letters", [2, 40, 3000])
def test_overlaid_moves_equal_the_automaton(letters):
    text = np.random.default_rng(4).zipf(1.3, 4000) % letters
    moves = language.suffix_automaton(text.tolist())
    a = language.overlaid(moves, letters)
    for state, to in enumerate(moves):
        at = a.base[state] + np.arange(letters)
        assert at.min() >= 0
        found = np.flatnonzero(a.owner[at] == state)
        assert {int(c): int(a.to[at[c]]) for c in found} == to
    assert a.start.tolist() == [moves[0].get(c, 0) for c in range(letters)]


def test_language_sample_is_spread_and_bounded(spark, monkeypatch):
    """Long texts give pieces from all over, copies count once, every piece is whole text of its row."""
    monkeypatch.setattr(language, "PIECES", 30)
    long_text = " ".join(f"w{i}" for i in range(20_000))
    rows = [("a", long_text)] + [("a", "copy " * 300)] * 500 + [("b", "été"), ("b", None), (None, "x y z"), ("c", "")]
    got = language.sample(spark.createDataFrame(rows, "lang string, text string")).collect()
    places = [long_text.index(r["piece"]) for r in got if r["lang"] == "a" and not r["piece"].strip().startswith(("copy", "opy", "py", "y"))]
    assert len(places) >= 28 and max(places) > 0.7 * len(long_text) and sum(r["lang"] == "a" for r in got) == 30
    assert [r["piece"] for r in got if r["lang"] == "b"] == ["été"] and {r["lang"] for r in got} == {"a", "b"}


def test_language_id_is_accurate_and_defined(spark, docs):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op1_language_id(spark, "/root/testdata/sf0.01").join(real.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.filter("lang_pred = lang").count() >= 0.98 * held.count() > 0
    model = list(language.fit(real.select("text", "lang")))
    odd = language.predict(docs, model, F.lit(False)).collect()
    assert len(odd) == len(CASES)
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)} == {"und"} and all(0 <= r["score"] <= 1 for r in odd)
    empty = list(language.fit(docs.filter("lang = 'none'")))
    assert {r["lang_pred"] for r in language.predict(docs, empty, F.lit(False)).collect()} == {"und"}
    assert language.predict(docs.limit(0), model, F.lit(False)).count() == 0


def made_up(seed, n, syllables):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(400)]
    return [" ".join(rng.choice(words, 40)) for _ in range(n)]


@pytest.mark.parametrize("few", [400, 3, 1])
def test_languages_with_little_labelled_text_are_found(spark, few):
    """Two languages of the same letters, one of them with few labelled rows."""
    a, b = made_up(1, 500, ["ta", "no", "ri", "sel", "mu"]), made_up(2, 500, ["at", "on", "ir", "les", "um"])
    labelled = [("aa", x) for x in a[:400]] + [("bb", x) for x in b[:few]]
    models = list(language.fit(spark.createDataFrame(labelled, "lang string, text string")))
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(a[400:] + b[400:])], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(asked, models, F.lit(False)).collect()}
    assert sum(got[i] == "aa" for i in range(100)) > 90
    assert sum(got[i] == "bb" for i in range(100, 200)) > 90


def brute_language(samples, text):
    """The cheapest language by greedy parsing with plain string search, and its phrases."""
    import math

    fold = lambda x: re.sub(r"\x00+", "\x00", "".join(c if c.isalpha() else "\x00" for c in x.lower()))
    known = {c for x in samples.values() for c in fold(x)}
    text = "".join(c if c in known or c == "\x00" else "\x01" for c in fold(text))
    if not text.strip("\x00"):
        return "und", 0
    costs = []
    for lang, x in sorted(samples.items()):
        held = fold(x)
        phrases = 0
        for at in range(0, len(text), language.SEGMENT):
            phrase, phrases = "", phrases + 1
            for c in text[at : at + language.SEGMENT]:
                if phrase + c in held:
                    phrase += c
                else:
                    phrase, phrases = c if c in held else "", phrases + 1
        costs.append((phrases * (math.log(len(held) + 1) + math.log(len(set(held)) + 1)), lang, phrases))
    _, lang, phrases = min(costs)
    return lang, phrases


@pytest.mark.parametrize("block", [100, 1])
def test_predictions_equal_brute_force_on_whole_texts(spark, monkeypatch, block):
    """In one model, and in one for each language."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labelled = real.filter("doc_id % 3 = 0").select("text", "lang")
    monkeypatch.setattr(language, "PIECES", 8)
    monkeypatch.setattr(language, "BLOCK", block)
    per = {}
    for r in language.sample(labelled).orderBy("lang", "at").collect():
        per.setdefault(r["lang"], []).append(r["piece"])
    samples = {k: "\n".join(x) for k, x in per.items()}
    odd = [(9001, None), (9002, "12 !"), (9003, "ünï 漢字 x"), (9003, "ünï 漢字 x"), (9003, "the other")]
    asked = real.filter("doc_id % 20 = 1").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = language.predict(asked, language.fit(labelled), F.lit(False)).collect()
    wanted = sorted((r["doc_id"], *brute_language(samples, r["text"] or "")) for r in asked.collect())
    assert sorted((r["doc_id"], r["lang_pred"], r["n_phrases"]) for r in got) == wanted
    assert all(0 <= r["score"] <= 1 for r in got)


def pages_of(spark, *pages):
    rows = [(i, "http://a/", html) for i, html in enumerate(pages)]
    return warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_warc_records(spark, tmp_path):
    html = "<html><title>A &amp; B</title><script>x</script><body><p>One&nbsp;&#233;&#x41;</p><!-- no --><a href=\"/y\">two</a></body>"
    rows = [(1, "http://a/", html), (2, None, None), (3, "http://b/", ""), (3, "http://b/", "")]
    records = warc.derivatives(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert records.count() == 8
    one = {r["warc_type"]: r for r in records.filter("page_id = 1").collect()}
    assert one["conversion"]["block"] == "A & B\nOne éA\ntwo"
    assert one["conversion"]["refers_to"] == one["metadata"]["refers_to"] != one["metadata"]["derived_id"]
    for a, b in (("conversion", "metadata"), ("metadata", "conversion")):
        assert f"WARC-Concurrent-To: {one[a]['derived_id']}\r\n" in one[b]["headers"]
    assert one["metadata"]["block"].startswith("title: A & B\r\nsource-status: 200\r\n") and "\r\noutlink: /y\r\n" in one["metadata"]["block"]
    assert "WARC-Target-URI" not in records.filter("page_id = 2").first()["headers"]
    warc.write_warc(records, str(tmp_path / "w"))
    text = "".join(r["value"] for r in spark.read.text(str(tmp_path / "w"), wholetext=True).collect())
    assert text.count("WARC/1.1\r\n") == 8 and text.endswith("\r\n\r\n")
    assert warc.derivatives(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_links_and_entities(spark):
    page = (
        "<a href='/one'>x</a><A class=b HREF = /two>x</A><a data-href=\"/no\" href=\"/a?b&amp;c=&#x27;d\">x</a><a name=z>x</a>"
        "<!-- <a href=/comment> --><script>'<a href=\"/script\">'</script>"
        "&amp;lt; &#38;#65; &#x1F600; &#0; &#xD800; &nothing; &eacute; &#9999999; a &b; c"
    )
    got = {r["warc_type"]: r["block"] for r in warc.derivatives(pages_of(spark, page)).collect()}
    links = [x[9:] for x in got["metadata"].split("\r\n") if x.startswith("outlink: ")]
    assert links == ["/one", "/two", "/a?b&c='d"]
    assert got["conversion"] == "xxxx&lt; &#65; \U0001f600 &#0; &#xD800; &nothing; é &#9999999; a &b; c"


def test_warc_keeps_source_headers_and_given_digest(spark):
    head = "HTTP/1.0 404 Not Found\r\nServer: x/1\r\nETag: \"a:b\"\r\nX-Long: one\r\n two\r\nContent-Type: text/plain\r\nbroken"
    rows = [("<urn:1>", "http://a/", "2020-01-01T00:00:00Z", head, "1 < 2 <b>\n", "sha1:GIVEN", "own block", "own text", "h")]
    names = "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string, block string, _text string, headers string"
    records = warc.derivatives(spark.createDataFrame(rows, names))
    assert sorted(records.columns) == sorted(set(records.columns))
    got = {r["warc_type"]: r for r in records.collect()}
    fields = got["metadata"]["block"].split("\r\n")
    assert fields[:6] == ["title: ", "source-status: 404", "source-server: x/1", 'source-etag: "a:b"', "source-x-long: one two", "source-content-type: text/plain"]
    assert "WARC-Source-Payload-Digest: sha1:GIVEN" in got["metadata"]["headers"] and got["metadata"]["refers_to"] == "<urn:1>"
    assert got["conversion"]["block"] == "1 < 2 <b>\n" and got["conversion"]["_text"] == "own text"


def test_warc_of_a_very_long_page(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    got = {r["warc_type"]: r["block"] for r in warc.derivatives(pages_of(spark, f"<p>{words}<p>&copy;{'<b>x</b> ' * 50_000}")).collect()}
    assert got["conversion"] == words + "\n©" + "x " * 49_999 + "x"
