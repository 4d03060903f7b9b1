"""Words that polynomial hashes take for one another are different words here."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forgeframe.llm.decontam import contamination
from forgeframe.llm.neardup import near_duplicates
from forgeframe.llm.substring import repeated_spans
from forgeframe.llm.textops import runs, span_hashes
from forgeframe.llm.tokenize import PieceEncoder


def alternating(n, letters="ab"):
    """The first n letters of the Thue-Morse word."""
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def opposite(word):
    return word.translate(str.maketrans("ab", "ba"))


def hashed(words, kind):
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data])
    return span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends, kind)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5000), st.sampled_from(["ab", "01", "AT", "\x01\x02"]), st.text("ab", max_size=70))
def test_hashes_of_regular_words(n, letters, tail):
    word = alternating(n, letters)
    other = word.translate(str.maketrans(letters, letters[::-1]))
    several = [word, other, word + tail, other + tail, tail + word, tail + other, word * 2, word + other, word + "\x00"]
    for kind in (0, 1):
        assert len(set(hashed(several, kind).tolist())) == len(set(several))
        assert (hashed(several, kind) == np.concatenate([hashed([w], kind) for w in several])).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_regular_words(name):
    encoder = PieceEncoder(public_tokenizers.path(name))
    texts = [f"{a} {b} and {a}" for n in (40, 1024, 4096) for a, b in [(alternating(n), opposite(alternating(n)))]]
    for again in range(2):
        (run,) = runs(pa.array([*texts, *map(opposite, texts)]))
        ids, of = encoder.encode(run)
        for k, text in enumerate([*texts, *map(opposite, texts)]):
            assert ids[of[k] : of[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, (again, k)


def test_regular_words_in_spark(spark):
    words = [alternating(1024 * k + 1024) for k in range(32)]
    texts = [" ".join(words[:1]), " ".join(map(opposite, words[:1])), " ".join(words), " ".join(map(opposite, words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.kept and r.component_id == r.doc_id for r in near_duplicates(docs, 85).collect())
    assert repeated_spans(docs, percent=80).count() == 0
    items = spark.createDataFrame([("x", texts[0]), ("y", texts[2])], "item_id string, text string")
    assert [(r.doc_id, r.n_hit > 0) for r in contamination(docs, items, size=10).orderBy("doc_id").collect()] == [(0, True), (1, False), (2, True), (3, False)]
