"""Token alignment against plain loops over the libraries' tokens of whole texts."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hazeline.llm import alignment

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def libraries():
    return alignment.ByteTokens(alignment.TOKENIZER), alignment.PieceTokens(alignment.PIECES)


def tokens(libraries, text):
    """(id, start, end) of both sides, from the whole text; nothing where the bytes differ."""
    if not text:
        return [], []
    a, b = libraries
    out = []
    for ids, spelt in ((a.library.encode(" " + text, add_special_tokens=False).ids, a.spelt), (b.library.encode(text), b.spelt)):
        if b"".join(spelt[i] for i in ids) != (" " + text).encode():
            return [], []
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(spelt[i])))
            at += len(spelt[i])
        out.append(side)
    return out


def brute(libraries, rows):
    docs, total = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(libraries, text)
        shared = sorted({e for _, _, e in a} & {e for _, _, e in b})
        cut = lambda side, lo, hi: ",".join(str(i) for i, s, e in side if lo <= s and e <= hi)
        said = ";".join(f"{cut(a, lo, hi)}|{cut(b, lo, hi)}" for lo, hi in zip([0, *shared], shared, strict=False))
        pairs, j = Counter(), 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    pairs[i, b[j][0]] += 1
                j += 1
        total.update(pairs)
        docs.append((doc_id, len(a), len(b), len(shared), pairs, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    best = {}
    for (_, y), n in total.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, n_a, n_b, n_groups, pairs, sha in docs:
        n_best = sum(n for p, n in pairs.items() if total[p] == best[p[1]])
        out.append((doc_id, n_a, n_b, n_groups, sum(pairs.values()), n_best, sum(n * total[p] for p, n in pairs.items()), sha))
    return sorted(map(repr, out))


def queried(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(repr(tuple(r)) for r in alignment.op13_token_alignment(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("head", [1 << 18, 300, 0])
def test_alignment_equals_brute_force(spark, libraries, tmp_path, monkeypatch, head):
    """With all, some and no pairs in the table that workers hold."""
    monkeypatch.setattr(alignment.alignment_scores, "__defaults__", (head,))
    rows = [(r.doc_id, r.text[:1500]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "a  b   "), (1004, "x▁y"), (1005, "<|endoftext|> and </s>"), (1006, "🙂 é 　 \n\n z\t")]
    rows += [(1005, "twice"), (1005, "twice"), (None, "no id")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, n_a string, row int")
    assert queried(spark, df, tmp_path) == brute(libraries, rows)


def test_alignment_of_the_whole_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    got = sorted(repr(tuple(r)) for r in alignment.op13_token_alignment(spark, sf).collect())
    assert got == brute(libraries, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_alignment_of_nothing_and_of_a_very_long_text(spark, libraries, tmp_path):
    schema = "doc_id long, text string"
    assert queried(spark, spark.createDataFrame([], schema), f"{tmp_path}/a") == []
    rows = [(1, "unbroken" * 40_000 + " and so on" * 2000)]
    assert queried(spark, spark.createDataFrame(rows, schema), f"{tmp_path}/b")[0].startswith("(1, ")


@pytest.fixture(scope="module")
def encoder():
    return alignment.TwoTokenizers(alignment.TOKENIZER, alignment.PIECES, most=20)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00")) | st.text(" \t\n.,ab'é ▁1"), max_size=4))
def test_units_give_the_tokens_of_whole_texts(encoder, libraries, rows):
    a, n_a, b, n_b = encoder.encode(rows)
    parts = lambda ids, n: [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []
    for text, x, y in zip(rows, parts(a, n_a), parts(b, n_b), strict=True):
        wanted = tokens(libraries, text)
        assert x == [t[0] for t in wanted[0]]
        assert y == [t[0] for t in wanted[1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 29)), st.sets(st.integers(1, 29))), max_size=3))
def test_groups_are_cut_at_every_shared_end(rows):
    a, b, n_a, n_b = [], [], [], []
    for k, (x, y) in enumerate(rows):
        a += [30 * k + e for e in sorted(x)] + [30 * k + 30]
        b += [30 * k + e for e in sorted(y)] + [30 * k + 30]
        n_a.append(len(x) + 1)
        n_b.append(len(y) + 1)
    starts_a, starts_b = alignment.groups(*[np.array(v, np.int64) for v in (a, b, n_a, n_b)])
    shared = [0, *sorted(set(a) & set(b))][:-1] if a else []
    assert [a[i - 1] if i else 0 for i in starts_a.tolist()] == shared
    assert [b[i - 1] if i else 0 for i in starts_b.tolist()] == shared
