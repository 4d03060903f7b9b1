"""Periodic runs of words against a program that tries every start and period."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forgeframe.llm import periodic, queries


def plain_runs(words, least, times):
    """All runs, by comparing words a period apart, for each period; of equal stretches the smallest period counts."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, found):
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looped(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def row(doc_id, text):
    words = looped(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = plain_runs(words, 24, 3)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines), digest(collapsed(words, found)))


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())


def test_overlap():
    assert periodic.overlap(24, 3) == 16 and periodic.overlap(2, 2) == 1
    for least, times in ((24, 3), (7, 2), (10, 5)):
        assert periodic.overlap(least, times) == min(max(least, times * q) - q for q in range(1, 200))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=5), st.integers(1, 12)), max_size=12), st.sampled_from([(2, 2), (6, 2), (6, 3), (24, 3)]))
def test_main_lorentz(parts, rule):
    words = np.array([ord(c) for text, n in parts for c in text * n], np.int64)
    for cuts in ([0, len(words)], [0, len(words) // 3, len(words)]):
        starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
        got = [tuple(map(int, r)) for r in zip(*periodic.main_lorentz(words, starts, ends, *rule), strict=True)]
        assert got == sorted((s + a, m, q) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for s, m, q in plain_runs(words[a:b].tolist(), *rule))


def test_words_outside_repeated_grams():
    words = np.array([*range(100, 130), *list(range(10)) * 4, *range(200, 230)], np.uint64)
    again = periodic.repeated(words, np.array([0, len(words)]), 16)
    assert again.tolist() == [30 <= i < 70 for i in range(100)]
    assert not periodic.repeated(words, np.array([0, 50, 100]), 16)[50:].any()  # two texts: no gram repeats in its own one


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_against_plain_program(spark, odd, monkeypatch, tmp_path, size):
    monkeypatch.setattr(periodic, "RUN_BYTES", size)
    monkeypatch.setattr(periodic, "PASS", 1 << 19 if size > 300 else 50)
    rng = np.random.default_rng(size)
    docs = []
    for k in range(120 if size > 300 else 40):
        words = [str(w) for w in rng.integers(0, 50, rng.integers(0, 60))]
        for _ in range(rng.integers(0, 4)):
            unit = [str(w) for w in rng.integers(0, 4, rng.integers(1, 14))]
            words += (unit * int(rng.integers(1, 30)))[: int(rng.integers(1, 200))] + ["é漢"] * int(rng.integers(0, 2))
        docs.append((100 + k, "\t \n".join(words) + " " * int(rng.integers(0, 2))))
    docs += [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None] + [(k, " ".join(map(str, range(40)))) for k in range(900, 990)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'mine' AS runs", "'mine' AS n_words").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.op13_repeated_gram_runs(spark, str(tmp_path)))
    slow = {9}  # 20,000 words: too many periods to try; checked below
    assert [r for r in got if r[0] not in slow] == sorted(row(*d) for d in docs if d[0] not in slow)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert [r for r in got if r[0] in slow] == [(9, 1, 0, 20_000, 1, 20_000_000, digest("0,20000,1\n"), digest("word"))] * 2
    assert sum(r[1] for r in got) > 40


def test_odd_rows(spark, odd, none):
    found = {r["text"]: r for r in periodic.periodic_runs(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()}
    assert all(r["collapsed"] == " ".join((t or "").split()) and r["runs"] == [] for t, r in found.items() if t is None or not t.startswith("word "))
    assert periodic.periodic_runs(odd).count() == odd.count() and periodic.periodic_runs(none).collect() == []
    assert [r["n_words"] for r in periodic.periodic_runs(odd.where("doc_id is null")).collect()] == [4]


def test_on_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r[0]: r for r in rows(queries.op13_repeated_gram_runs(spark, sf_dir))}
    assert len(got) == len(docs) and all(got[i] == row(i, t) for i, t in docs if len((t or "").split()) < 3000)
