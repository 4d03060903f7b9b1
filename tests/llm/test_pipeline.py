"""The pipeline's stages, and all of it, against plain programs on planted documents."""

import itertools
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from forgeframe.llm.decontam import cut
from tests.llm.test_brute_force import roots, shingles

SPACED, WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_near_dedup(docs):
    """Of all pairs of a Jaccard similarity of 0.8 or more, the first of each group stays."""
    sets = {i: shingles(lowered(t)) for i, t in docs if t}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    of = roots(linked)
    return [(i, t) for i, t in docs if of.get(i, i) == i]


def byte_spans(text, pattern, words):
    """Byte ranges of the maximal runs of word numbers."""
    found = [(len(text[: m.start()].encode()), len(text[: m.end()].encode())) for m in re.finditer(pattern, text)]
    spans = []
    for w in sorted(words):
        if spans and w == spans[-1][2] + 1:
            spans[-1][1:] = [found[w][1], w]
        else:
            spans.append([*found[w], w])
    return [{"start": a, "end": b} for a, b, _ in spans]


def plain_repeats(docs, n=30):
    """Windows of 30 words that lie word for word at an earlier place go (lines here are no near copies of each other)."""
    first, out = {}, []
    for i, text in docs:
        words, gone = re.findall(SPACED, lowered(text or "")), set()
        for k in range(len(words) - n + 1):
            window = tuple(words[k : k + n])
            at = first.setdefault(window, (i, k))
            if at != (i, k) and (at[0] != i or k - at[1] >= n):
                gone |= set(range(k, k + n))
        new = cut(text, byte_spans(text, SPACED, gone)) if gone else text
        if not gone or new != "":
            out.append((i, new))
    return out


def plain_decontamination(docs, items, n=10):
    windows = set()
    for item in items:
        words = re.findall(WORD, lowered(item or ""))
        windows |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    sizes, out = {len(w) for w in windows}, []
    for i, text in docs:
        words = re.findall(WORD, lowered(text or ""))
        hit = {x for size in sizes for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in windows for x in range(k, k + size)}
        new = cut(text, byte_spans(text, WORD, hit)) if hit else text
        if not hit or new != "":
            out.append((i, new))
    return out


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvwyéß") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [some(25), some(14), some(4), None, "", some(11)]
    passage, docs = some(70), []
    for k in range(60):
        text = some(rng.randint(60, 200))
        if k % 10 == 3:
            text = f"{some(40)} {passage} {some(50)}"
        if k % 10 == 5:
            text = f"{some(30)}, {items[k % 2]}. {some(30)} {items[2]} {some(9)}"
        docs.append(text)
    docs += [docs[7], docs[8] + " more words", " ".join(docs[9].split()[:-2]), "12 34 ... 56!", "   ", "", None, items[0], items[5].upper(), passage, "Ünï 漢字 x", "é"]
    rows = [(k * 3 % 101, t, rng.choice(["de", "fr", None]), "s", None if t is None else len(t)) for k, t in enumerate(docs)]
    rng.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, sorted((r[0], r[1]) for r in rows), items


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_one_by_one(spark, planted):
    folder, docs, items = planted
    table = spark.read.parquet(f"{folder}/documents.parquet")
    lettered = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    assert texts(corpus_pipeline.language_id(spark, table, folder)) == lettered
    assert texts(corpus_pipeline.near_dedup(spark, table, folder)) == plain_near_dedup(docs)
    one = spark.createDataFrame([(*d, None, None, None) for d in plain_near_dedup(lettered)], SCHEMA)
    repeated = corpus_pipeline.substring_dedup(spark, one, folder)
    assert texts(repeated) == plain_repeats(plain_near_dedup(lettered)) != texts(one)
    clean = corpus_pipeline.decontamination(spark, table, folder)
    assert texts(clean) == plain_decontamination(docs, items) and len(texts(clean)) < len(docs)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean.collect())


def test_whole_pipeline(spark, planted):
    folder, docs, items = planted
    kept = plain_near_dedup([(i, t) for i, t in docs if t and any(c.isalpha() for c in t)])
    kept = plain_decontamination(plain_repeats(kept), items)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept}
    pieces, used = corpus_pipeline.run(spark, folder).collect(), {}
    assert {r.doc_id: r.doc_tokens for r in pieces} == want and 30 < len(want) < len(docs)
    for doc_id, n in want.items():
        own = sorted((r.start, r.length) for r in pieces if r.doc_id == doc_id)
        assert [a for a, _ in own] == [sum(m for _, m in own[:k]) for k in range(len(own))] and sum(m for _, m in own) == n
    for r in pieces:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        places.sort()
        assert [a for a, _ in places] == [sum(m for _, m in places[:k]) for k in range(len(places))] and sum(m for _, m in places) <= 2048
    assert len(used) <= -(-sum(want.values()) // 2048) + 1
