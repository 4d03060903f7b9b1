"""Operators against plain programs that compare everything with everything."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forgeframe.llm import fmindex, graph, langid, lsh, neardup, packing, quality, queries, substring, vptree
from forgeframe.llm.graph import components
from forgeframe.llm.sql import ORACLES
from forgeframe.llm.textops import ALNUM, LOWER, SPACED, mix, runs, span_hashes, words
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("block", [1 << 18, 40])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK_EDGES", block)
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots(pairs)
    chain = rng.permutation(3000)
    ids, root = graph.contracted(chain[:-1], chain[1:])
    assert len(ids) == 3000 and (root == 0).all()
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.integers(len(w))] = f"e{rng.integers(10**6)}"
    return " ".join(w)


def test_large_group_of_near_copies(spark, monkeypatch):
    """One bucket of hundreds of members: blocks are compared with blocks, no link is lost."""
    monkeypatch.setattr(lsh, "BLOCK", 32)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(rng, base, int(rng.integers(1, 9))) for _ in range(250)] + [edited(rng, [f"v{i}" for i in range(300)], 1) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = list(map(shingles, texts))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = roots(links)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: want.get(i, i) for i in range(len(texts))} and len(set(got.values())) > 20


def test_paragraphs(spark):
    rng = np.random.default_rng(5)
    base = [[f"p{k}w{i}" for i in range(80)] for k in range(6)]
    texts = ["\n".join(edited(rng, base[int(rng.integers(6))], int(rng.integers(0, 4))) for _ in range(3)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places, sets = [], []
    for d, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            places.append((d, at))
            sets.append(shingles(line))
            at += len(line) + 1
    same_as = roots([(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    groups = collections.defaultdict(list)
    for i, r in same_as.items():
        groups[r].append(places[i])
    want = {p for g in groups.values() for p in sorted(g)[1:]}
    got = {(r.doc_id, r.start) for r in substring.repeated_spans(docs).where("kind = 'paragraph'").collect()}
    assert got == want


def fresh_words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**9, n)]


def cut_words(texts, size=substring.RUN):
    """(document, word) of every word in a window of ``size`` words that lies at an earlier place, not overlapping."""
    first, out = {}, set()
    for d, t in enumerate(texts):
        w = t.lower().split()
        for i in range(len(w) - size + 1):
            kept = first.setdefault(tuple(w[i : i + size]), (d, i))
            if kept[0] != d or i - kept[1] >= size:
                out |= {(d, j) for j in range(i, i + size)}
    return out


def found_words(texts, spans):
    """(document, word) of every word in the byte spans."""
    out = set()
    for r in spans:
        raw = texts[r.doc_id].encode()
        before, inside = len(raw[: r.start].split()), len(raw[r.start : r.end].split())
        assert inside == r.words
        out |= {(r.doc_id, j) for j in range(before, before + inside)}
    return out


def test_passages_in_mid_sentence(spark):
    """Passages of 51 words without any stop, put into lines at random places, are found to their ends."""
    rng = np.random.default_rng(11)
    passages = [fresh_words(rng, 51) for _ in range(25)]
    texts = []
    for p in passages:
        for _ in range(2):
            host = fresh_words(rng, int(rng.integers(200, 300)))
            at = int(rng.integers(1, len(host)))
            texts.append(" ".join(host[:at] + p + host[at:]))
    texts += ["a B " * 60, " ".join(fresh_words(rng, 29) * 3), " ".join(fresh_words(rng, 30) * 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found_words(texts, substring.repeated_spans(docs).where("kind = 'passage'").collect())
    assert got == cut_words(texts) and {d for d, _ in got} >= {2 * k + 1 for k in range(25)}


def test_words_that_repeat_nowhere_stay(spark):
    """Fields of a template, and documents of common sentences that share no window with one document, are left alone."""
    rng = np.random.default_rng(13)
    frame = [[*fresh_words(rng, 12), "end."] for _ in range(5)]
    fields = [[fresh_words(rng, 3) for _ in frame] for _ in range(4)]
    texts = [" ".join(w for s, f in zip(frame, own, strict=True) for w in s + f) for own in fields]
    common = [" ".join([*fresh_words(rng, 9), "end."]) for _ in range(4)]
    texts += [f"{' '.join(fresh_words(rng, 40))}. {c}" for c in common] + [" ".join(common)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not cut_words(texts)
    assert {r.doc_id: r.text for r in substring.remove_repeats(docs).collect()} == dict(enumerate(texts))


def test_near_copies_of_wrapped_text(spark):
    """Blocks of lines under 20 words are paragraphs: near copies are found, at whatever width they are wrapped."""
    rng = np.random.default_rng(19)
    base = fresh_words(rng, 120)

    def wrapped(w, n):
        return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))

    other = [*base[:40], "new", *base[41:90], "words", *base[91:]]
    texts = [f"{wrapped(base, 11)}\n\n{wrapped(fresh_words(rng, 60), 12)}", f"{wrapped(fresh_words(rng, 60), 9)}\n \n{wrapped(other, 13)}", "few\nshort\nlines"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    (found,) = substring.repeated_spans(docs).where("kind = 'paragraph'").collect()
    assert (found.doc_id, found.words, found.kept_doc_id) == (1, 120, 0) and texts[1].encode()[found.start : found.end].decode() == wrapped(other, 13)


def test_recall_of_passages(spark):
    """Passages of 51 to 120 words, with and without stops, in hosts with and without: nearly all words are found, no others."""
    rng = np.random.default_rng(23)

    def prose(n, stops):
        w = fresh_words(rng, n)
        return [x + "." if stops and i % 12 == 11 else x for i, x in enumerate(w)]

    texts = []
    for k in range(40):
        passage = prose(int(rng.integers(51, 121)), k % 2)
        for _ in range(3):
            host = prose(int(rng.integers(60, 300)), k % 3)
            at = int(rng.integers(0, len(host)))
            texts.append(" ".join(host[:at] + passage + host[at:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found_words(texts, substring.repeated_spans(docs).where("kind = 'passage'").collect())
    want = cut_words(texts)
    assert len(got & want) >= 0.95 * len(want) and not got - want


def test_passages_over_line_ends(spark):
    """Text wrapped at other widths still repeats."""
    rng = np.random.default_rng(17)
    passage = fresh_words(rng, 200)

    def wrapped(w, n):
        return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))

    texts = [wrapped(fresh_words(rng, 35) + passage + fresh_words(rng, 35), n) for n in (11, 13, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = substring.repeated_spans(docs).collect()
    assert found_words(texts, spans) == cut_words(texts) == {(d, j) for d in (1, 2) for j in range(35, 235)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=6))
def test_fm_index(symbols, phrases):
    symbols = np.array(symbols, np.int64)
    rows = np.array([p + [0] * (5 - len(p)) for p in phrases])
    lengths = np.array([len(p) for p in phrases])
    which, place = fmindex.FMIndex(symbols, 3).occurrences(rows, lengths)
    want = sorted((k, i) for k, p in enumerate(phrases) for i in range(len(symbols)) if symbols[i : i + len(p)].tolist() == p)
    assert sorted(zip(which.tolist(), place.tolist(), strict=True)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=6))
def test_words(texts):
    import re

    for alphabet, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for run in runs(pa.array(texts, pa.string())):
            found = words(run, alphabet)
            got = [[found.lower[a:b].tobytes().decode() for a, b in zip(found.starts[i:j], found.ends[i:j], strict=True)] for i, j in zip(found.of[:-1], found.of[1:], strict=True)]
            lowered = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in texts]
            assert got == [re.findall(pattern, t) for t in lowered[run.first : run.first + len(run)]]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_packing_plan(histogram):
    plan = packing.plan(histogram, 64)
    used = collections.Counter()
    for count, pattern in plan:
        assert sum(pattern) <= 64
        for size in pattern:
            used[size] += count
    assert used == histogram
    taken = collections.defaultdict(list)
    for size, a, b, _, _ in packing.slots(plan):
        taken[size].append((a, b))
    for size, n in histogram.items():
        spans = sorted(taken[size])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 10, (20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(0, 0.3, (3000, 16))).astype(np.float32).astype(float)
    x[100:400] = x[100]
    bound = np.sqrt((x**2).sum(1).max())
    tree = vptree.Tree(np.c_[x, np.sqrt(np.maximum(bound**2 - (x**2).sum(1), 0))])
    q, ids = x[::50], np.arange(3000)
    truth = q @ x.T
    truth[np.arange(len(q)), ids[::50]] = -np.inf
    for factor, least in ((1.0, 1.0), (vptree.RELAXED, 0.9)):
        who, row = vptree.search(tree, q, ids[::50], ids, bound, 10, factor)
        hits = sum(len({*row[who == k]} & {*np.lexsort((ids, -np.round(truth[k], 9)))[:10]}) for k in range(len(q)))
        assert hits >= least * 10 * len(q)


def test_relaxed_search_on_embeddings(spark, sf_dir):
    """Recall of the relaxed factor on the given vectors, against the exact search."""
    v = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    exact, relaxed = ({(r.query_id, r.vec_id) for r in vptree.nearest(v, "vec_id % 20 = 0", 20, f).collect()} for f in (1.0, vptree.RELAXED))
    assert len(exact & relaxed) >= 0.9 * len(exact)


def slow_shares(model, text):
    """One text's languages and shares, letter by letter and word by word."""
    table = {name: row.astype(np.float64) for name, row in zip(model.languages, model.log_likelihood, strict=True)}
    data = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in text.encode())
    p = []
    for w in re.findall(rb"[a-z\x80-\xff]+", data):
        around = b" " + w + b" "
        cells = [(((around[i] << 16 | around[i + 1] << 8 | around[i + 2]) * 2654435769) & 0xFFFFFFFF) >> 16 for i in range(len(w))]
        log = {name: sum(row[c] for c in cells) for name, row in table.items()}
        most = max(log.values())
        p.append({name: math.exp(x - most) + 1e-12 for name, x in log.items()})

    def em(share):
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(share, 0.0)
            for word in p:
                total = max(sum(word[k] * share[k] for k in share), 1e-30)
                for k in share:
                    new[k] += word[k] * share[k] / total / len(p)
            moved = max(abs(new[k] - share[k]) for k in share)
            share = new
            if moved < langid.TOLERANCE:
                break
        return share

    def likelihood(share):
        return sum(math.log(max(sum(word[k] * share[k] for k in share), 1e-30)) for word in p)

    share = em({name: 1 / len(table) for name in table})
    while len(share) > 1:
        least = min(share, key=lambda k: share[k])
        total = sum(share[k] for k in share if k != least)
        fewer = em({k: x / total for k, x in share.items() if k != least})
        if likelihood(fewer) + math.log(len(p) + 1) < likelihood(share):
            break
        share = fewer
    return share


def test_mixtures_one_by_one(spark, sf_dir):
    """Shares against a plain program for each text; and a text alone gives what it gives among others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000")
    model = langid.fit(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    parts = {r.lang: r.text for r in docs.groupBy("lang").agg(F.min("text").alias("text")).collect()}
    texts += [f"{a}\n{b}" for a in parts.values() for b in parts.values()]
    (together,) = runs(pa.array(texts), 1 << 30)
    shares, n = langid.mixtures(model, together)
    for i, text in enumerate(texts):
        (alone,) = runs(pa.array([text]))
        np.testing.assert_array_equal(langid.mixtures(model, alone)[0][0], shares[i])
        want = slow_shares(model, text)
        np.testing.assert_allclose(shares[i], [want.get(k, 0) for k in model.languages], atol=2e-3)
        assert model.languages[shares[i].argmax()] == max(want, key=want.get) or sorted(want.values())[-2] > max(want.values()) - 4e-3


def test_languages_on_held_out(spark, sf_dir):
    out = queries.op4_language_mixture(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_mixture_of_two_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    parts = {r.lang: r.text for r in docs.where("length(text) between 1000 and 3000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = spark.createDataFrame([(1, parts["fr"] + "\n" + parts["de"])], "doc_id long, text string")
    row = langid.detect(mixed, model).first()
    assert set(row.langs) >= {"fr", "de"} and min(row.shares[:2]) > 0.1


def test_packed_ids(spark, sf_dir):
    """Every piece's ids against plain encoding of the whole text; each id in one piece; gapless sequences."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = {d: plain.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    out = queries.op8_histogram_packing(spark, sf_dir).collect()
    assert sorted((r.doc_id, k) for r in out for k in range(r.start, r.start + r.length)) == sorted((d, k) for d, x in ids.items() for k in range(len(x)))
    for r in out:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(placed), [*sorted(placed)[1:], (sum(n for _, n in placed), 0)], strict=True))
    assert sum(map(len, ids.values())) / (2048 * len(by)) > 0.9


def test_quality_one_by_one(spark, sf_dir):
    """Evidence feature by feature, posteriors site by site, against a plain program."""
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    out = {r.doc_id: r for r in queries.op2_quality_empirical_bayes(spark, sf_dir).collect()}
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 3 == 1 for d in docs}
    labelled = spark.createDataFrame([(d.doc_id, d.text, labels[d.doc_id].quality, labels[d.doc_id].toxic) for d in docs if d.doc_id in labels and not held[d.doc_id]], "doc_id long, text string, quality int, toxic int")
    weights = quality.fit_evidence(labelled).weights

    def cell(raw, more=0):
        (run,) = runs(pa.array([raw]), 1 << 30)
        h = span_hashes(LOWER[run.data], np.array([0]), np.array([len(run.data)])) if not more else mix(span_hashes(run.data, np.array([0]), np.array([len(run.data)])) + np.uint64(more))
        return int(h[0] >> np.uint64(64 - quality.CELL_BITS))

    def shape(x, k):
        return int(mix(np.array([x], np.uint64) + np.uint64(k << 32))[0] >> np.uint64(64 - quality.CELL_BITS))

    for d in docs[:80]:
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in d.text))
        marks = re.findall(r"[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]+", d.text)
        own = {cell(w) for w in found}
        upper, letters = len(re.findall("[A-Z]", d.text)), len(re.findall("[A-Za-z]", d.text))
        own_shape = {shape(upper * 10 // max(letters, 1), 1), shape(int(math.log2(len(found) + 1)), 2), shape(len(own) * 10 // max(len(found), 1), 3)}
        for k, t in enumerate(quality.TARGETS):
            want = sum(weights[k][c] for c in own | {cell(m, 1) for m in marks} | own_shape)
            assert abs(want - out[d.doc_id][f"{t}_evidence"]) < 1e-6
    for k, t in enumerate(quality.TARGETS):
        bins = collections.defaultdict(lambda: [0, 0])
        for d in docs:
            if held[d.doc_id] and d.doc_id in labels:
                e = max(-60.0, min(60.0, out[d.doc_id][f"{t}_evidence"])) / quality.BIN
                bins[math.floor(abs(e) + 0.5) * (1 if e >= 0 else -1)][labels[d.doc_id][t]] += 1
        keys = sorted(bins)
        a, b = quality.calibrate(np.array(keys) * quality.BIN, np.array([bins[x][0] for x in keys], float), np.array([bins[x][1] for x in keys], float))

        def sigmoid(x):
            return 1 / (1 + math.exp(-max(-40, min(40, x))))

        share = {d.doc_id: float(labels[d.doc_id][t]) if d.doc_id in labels else sigmoid(out[d.doc_id][f"{t}_evidence"] * a + b) for d in docs}
        mean = sum(share.values()) / len(share)
        hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
        for d in docs:
            hosts[d.source].append(share[d.doc_id])
            paths[d.source, d.lang].append(share[d.doc_id])

        def strength(groups, prior):
            n = sum(map(len, groups.values()))
            m = sum(map(sum, groups.values())) / n
            spread = sum(len(g) * (sum(g) / len(g) - prior(key)) ** 2 for key, g in groups.items()) / n
            noise = sum(prior(key) * (1 - prior(key)) for key in groups) / n
            return min(max(m * (1 - m) / max(spread - noise, 1e-12) - 1, 1), 1e6)

        kh = strength(hosts, lambda _: mean)
        host = {h: (sum(g) + mean * kh) / (len(g) + kh) for h, g in hosts.items()}
        kp = strength(paths, lambda key: host[key[0]])

        def logit(p):
            p = min(max(p, 1e-6), 1 - 1e-6)
            return math.log(p / (1 - p))

        for d in docs:
            g = paths[d.source, d.lang]
            site = (sum(g) - share[d.doc_id] + host[d.source] * kp) / (len(g) - 1 + kp)
            want = sigmoid(out[d.doc_id][f"{t}_evidence"] * a + b - logit(mean) + logit(site))
            assert abs(want - out[d.doc_id][f"p_{t}"]) < 1e-6


def test_quality_on_held_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    out = queries.op2_quality_empirical_bayes(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("toxic", "is_toxic"), "doc_id").toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]]
    assert ((held.p_quality >= 0.5) == (held.quality == 1)).mean() > 0.95
    assert held[held.is_toxic == 1].toxic.mean() > 0.8 and held[held.is_toxic == 0].toxic.mean() < 0.02


def test_pipeline_keeps_and_removes(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()
