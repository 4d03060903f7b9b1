"""Words and their variants against plain programs."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forgeframe.llm import spelling


def plain_counts(docs, least, often, spoil):
    count = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "a" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if spoil and doc_id is not None and h % spoil == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                count[word] += 1
    return {w: n for w, n in count.items() if n >= often}


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for i, c in itertools.product(range(len(word) + 1), alphabet):
        out |= {word[:i] + c + word[i:], word[:i] + c + word[i + 1 :] if i < len(word) else word}
    return out - {word}


def plain_variants(counts, times):
    alphabet, out = sorted(set("".join(counts))), {}
    for word, n in counts.items():
        near = [w for w in edits(word, alphabet) if w in counts]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        out[word] = [best if best is not None and counts[best] >= times * n else None, len(near)]
    rows = set()
    for word, (form, n_near) in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((word, form, root, counts[word], n_near, counts[form] if form else None))
    return rows


def rows(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@settings(max_examples=300, deadline=None)
@given(st.text("abé漢", min_size=1, max_size=7), st.text("abé漢", min_size=1, max_size=7))
def test_one_apart(a, b):
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if len(a) - len(b) <= 1:
        x, y = (np.array([[ord(c) for c in w]], np.uint32) for w in (a, b))
        assert spelling.one_apart(x, y)[0] == (b in edits(a, "abé漢"))


def test_words_with_odd_rows(spark, odd, none):
    text = "Straße ÀÉÎÕÜß×÷ naïveté don't co-operate " * 30 + "Ÿears Ångström ¿quétal? " * 3
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(k, text) for k in range(40)] + [(7, "a" * 30_000 + " " + "é" * 30_000)] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'mine' AS word", "'mine' AS n")
    for least, often, spoil in ((6, 5, 199), (1, 1, 3), (3, 2, None)):
        got = spelling.word_counts(df, least, often, spoil).collect()
        assert {r["word"]: r["n"] for r in got} == plain_counts(docs, least, often, spoil) and len(got) == len({r["word"] for r in got})
    assert spelling.spelling_variants(spelling.word_counts(none)).collect() == []


@pytest.mark.parametrize(("block", "points"), [(2048, 1 << 20), (3, 1 << 20), (2048, 40)])
def test_variants(spark, monkeypatch, block, points):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "BLOCK_POINTS", points)
    rng = np.random.default_rng(block)
    alphabet, counts = list("abcé"), {}
    for _ in range(25 if block > 3 else 12):
        word = "".join(rng.choice(alphabet, rng.integers(6, 12)))
        for n in (40000, 6000, 900, 100, 100, 12, 12, 5):
            counts.setdefault(word, int(n + rng.integers(0, 3)))
            near = sorted(w for w in edits(word, alphabet) if len(w) >= 6)
            word = near[rng.integers(len(near))]
    counts |= {"aaaaaa": 500, "aaaaaaa": 20, "aaaaaaaa": 500, "aaabaaaa": 5, "ababab": 70, "bababa": 9, "ababaa": 9, "abababa": 9, "漢字漢字漢字漢": 10, "漢字漢字漢字": 2, "x" * 3000: 8, "x" * 2999 + "y": 1}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    want = plain_variants(counts, 5)
    got = spelling.spelling_variants(df, 5)
    assert rows(got) == want and got.count() == len(counts)
    assert any(len({r[0], r[1], r[2]}) == 3 for r in want if r[1])


def test_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()], 6, 2, 7)
    df = spelling.word_counts(docs, 6, 2, 7)
    assert {r["word"]: r["n"] for r in df.collect()} == counts
    assert rows(spelling.spelling_variants(df, 2)) == plain_variants(counts, 2)
