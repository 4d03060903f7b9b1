"""Every operator on odd rows, and on a table without rows."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forgeframe.llm import chat, decontam, langid, neardup, packing, quality, sharding, substring, tokenfile, vptree
from forgeframe.llm.storage import new_path, staged

N = 12


def test_chat(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "user", "b<|end|>"), (1, 3, "assistant", "c\\"), (2, None, None, None), (2, 0, "assistant", "<|turn|>"), (2, 0, "assistant", "<|turn|>"), (None, 5, "we<|says|>ird", "<\\|"), (3, 1, "assistant", "x")]
    turns = spark.createDataFrame(rows + [(4, i, "user" if i % 2 else "assistant", f"t{i}<") for i in range(200)], "conv_id long, turn long, role string, text string")
    marked = {r.conv_id: r.learned for r in chat.learned_texts(chat.format_chats(turns)).collect()}
    out = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(turns.withColumn("formatted", F.lit("mine")))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "a"), ("user", "b<|end|>"), ("assistant", "c\\")]
    assert [tuple(t) for t in out[2].turns] == [("", ""), ("assistant", "<|turn|>"), ("assistant", "<|turn|>")]
    assert [tuple(t) for t in out[None].turns] == [("we<|says|>ird", "<\\|")]
    assert [t.text for t in out[4].turns] == [f"t{i}<" for i in range(200)]
    assert out[1].formatted.count(chat.BEGIN) == 2
    for r in out.values():
        at, learned = 0, []
        for run in r.loss:
            if run.learned:
                learned.append(r.formatted[at : at + run.chars])
            at += run.chars
        assert at == len(r.formatted)
        undone = [t.replace("<\\|", "<|").replace("\\\\", "\\") for t in learned]
        assert undone == [t.text for t in r.turns if t.role == "assistant"]
        assert marked[r.conv_id] == undone
    assert chat.format_chats(turns.where("conv_id = 77")).count() == 0


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (4, 0, 1), (None, 1, 1), (8, None, None), (9, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.assess(odd, labels).collect()
    assert len(out) == N and all(0 <= r.p_quality <= 1 and r.keep is not None for r in out)
    assert quality.assess(none, labels).count() == 0
    without = quality.assess(odd, labels.where("doc_id = 77")).collect()
    assert len(without) == N and all(r.keep for r in without)


def test_substring(spark, odd, none):
    assert substring.repeated_spans(none).count() == 0
    assert substring.remove_repeats(odd).count() == N
    passage = " ".join(f"w{i} x{i} y{i} z{i} stop{i}." for i in range(12))
    rows = [(1, f"Own start. {passage} own end here."), (2, f"line one\nother words. {passage} and more"), (3, "nothing of that kind at all"), (4, passage), (5, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring.repeated_spans(docs).collect()
    assert {r.doc_id for r in spans} == {2, 4, 5} and {r.kept_doc_id for r in spans if r.doc_id == 2} == {1}
    left = {r.doc_id: r.text for r in substring.remove_repeats(docs).collect()}
    assert left[1] == rows[0][1] and left[3] == rows[2][1] and "w5 x5" not in left[2] and left[4] == left[5] == ""


def test_language(spark, odd, none):
    model = langid.fit(odd)
    assert model.languages == ["de", "en"]
    out = {(r.doc_id, r.lang_pred, r.score) for r in langid.detect(odd, model).select("doc_id", "lang_pred", "score").collect()}
    assert {d for d, p, s in out if p == "und"} == {1, 2, 3, 4} and all(s == 0 for _, p, s in out if p == "und")
    assert langid.detect(odd, model).count() == N and langid.detect(none, model).count() == 0
    assert {r.lang_pred for r in langid.detect(odd, langid.fit(none)).collect()} == {"und"}


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    folder = new_path(spark, "test")
    tokenfile.write_tokens(odd, path, folder)
    out = tokenfile.read_tokens(spark, folder, with_ids=True).orderBy("start").collect()
    assert len(out) == N and [r.doc_id for r in out] == sorted((r.doc_id for r in out), key=lambda d: (d is not None, d))
    texts = {r.doc_id: r.text for r in odd.collect()}
    at = 0
    for r in out:
        ids = plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert list(memoryview(bytes(r.ids)).cast("I")) == ids and r.start == at and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += len(ids)
    for d in (5, 9, 10, 77):
        one = tokenfile.read_document(spark, folder, d).orderBy("start").collect()
        assert [(r.start, r.n_tokens, r.ids) for r in one] == [(r.start, r.n_tokens, r.ids) for r in out if r.doc_id == d]
    folder = new_path(spark, "test")
    tokenfile.write_tokens(none, path, folder)
    assert tokenfile.read_tokens(spark, folder).count() == 0 and tokenfile.read_document(spark, folder, 5).count() == 0


def test_document_of_a_block(spark, monkeypatch):
    """Documents of many blocks and parts, one by one, against plain encoding."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "BLOCK_DOCS", 7)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [f"document {i} of some " + "words " * (i % 13) for i in range(120)]
    folder = new_path(spark, "test")
    tokenfile.write_tokens(spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string"), path, folder)
    ids = [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    for i in (0, 6, 7, 50, 119):
        (r,) = tokenfile.read_document(spark, folder, 3 * i).collect()
        assert list(memoryview(bytes(r.ids)).cast("I")) == ids[i] and r.start == sum(map(len, ids[:i]))
    assert tokenfile.read_document(spark, folder, 1).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_marker_in_text(name):
    """A text that holds a special token has the ids of the plain tokenizer."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from forgeframe.llm.textops import runs
    from forgeframe.llm.tokenize import PieceEncoder

    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    special = [t.content for t in plain.get_added_tokens_decoder().values()]
    texts = [f.format(t) for t in special for f in ("a {} b", "{}", "x{}y {} {}".replace("{}", "{0}"), "a  {}  b\n{}\n c".replace("{}", "{0}"), "é {} é")]
    (run,) = runs(pa.array(texts))
    ids, of = PieceEncoder(path).encode(run)
    assert special and [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_shards(spark, odd, none):
    out = sharding.balanced_shards(odd, 4).collect()
    assert len(out) == N and sharding.balanced_shards(none).count() == 0
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    even = sharding.balanced_shards(spark.range(1600).selectExpr("id % 3 AS doc_id", "'abcd' AS text"), 16).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(even) == 16 and max(r.s for r in even) - min(r.s for r in even) <= 10


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "one TWO three"), (2, "word " * 30), (3, None), (None, "x"), (4, "..."), (5, "one two three"), (5, "two")], "item_id long, text string")
    out = {r.doc_id: r for r in decontam.contamination(odd, items).collect()}
    assert out[5].items == ["1", "5"] and out[5].n_hit == 3 and out[9].n_hit == 20_000 and out[9].items == ["2"]
    assert out[1].n_words == 0 and out[1].items == [] and out[7].n_hit == 0 and out[5].score == "mine"
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(odd, items.where("item_id = 77")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.remove_contamination(odd, items).columns == odd.columns
    assert {r.doc_id: r.text for r in decontam.remove_contamination(odd, items).collect()}[5] == "" and decontam.remove_contamination(odd, items, keep_emptied=False).count() == N - 4
    assert decontam.cut("keep this, drop that. End", [{"start": 11, "end": 20}]) == "keep this, . End"


def test_blocks_of_phrases(spark, sf_dir, monkeypatch):
    """A benchmark of many blocks, and items of many pieces, give what one block gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("items found", F.lit("mine"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = items.unionByName(docs.where("doc_id % 50 = 0").selectExpr("-doc_id AS item_id", "text"))
    once = sorted(map(tuple, decontam.contamination(docs, items).collect()))
    cut_once = sorted(map(tuple, decontam.remove_contamination(docs, items, keep_emptied=False).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(decontam, "PIECE_WORDS", 25)
    assert decontam.phrase_blocks(items, 10).count() > 3
    assert sorted(map(tuple, decontam.contamination(docs, items).collect())) == once
    assert sorted(map(tuple, decontam.remove_contamination(docs, items, keep_emptied=False).collect())) == cut_once


def test_packing(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = {c: F.lit("mine") for c in ("rank", "salt", "base", "n", "first", "end", "sequence", "tile", "width", "piece")}
    cut = staged(packing.pieces(odd, path, 64).select("doc_id", "start", "length", "doc_tokens").withColumns(own), "test")
    out = packing.packed(cut, 64).collect()
    assert all(r[c] == "mine" for r in out for c in own)
    assert sum(r.length for r in out) == cut.agg(F.sum("length")).first()[0] and len(out) == cut.count()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(staged(packing.pieces(none, path).drop("ids"), "test")).count() == 0


def test_near_duplicates(spark, odd, none):
    out = neardup.near_duplicates(odd).collect()
    assert len(out) == N and neardup.near_duplicates(none).count() == 0
    component = {r.doc_id: r.component_id for r in out}
    assert component[6] == component[5] == 5 and component[1] == 1 and component[2] == 2 and component[None] is None
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    assert {r.doc_id: r.n_shingles for r in out} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 2, 8: 1, 9: 1, None: 1, 10: 1}


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(100, None), (101, []), (102, [0.0, 0.0]), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [None, 1.0]), (106, [1.0]), (None, [1.0, 1.0]), (120, [5.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("mine"))
    out = vptree.nearest(v, "vec_id % 20 = 0", 5).collect()
    assert {r.query_id for r in out} == {0, 20, 40, 120} and [r.vec_id for r in out if r.query_id == 120] == [106]
    assert [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == 20] == [6, 13, 27, 34, 41]
    assert vptree.nearest(v.where("vec_id = 77"), "true").count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, none, stage, tmp_path):
    """All columns of odd rows, whatever their names, come back as they were."""
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = odd.withColumns({c: F.lit("mine") for c in ("lang_pred", "langs", "shares", "n_hit", "items", "row", "rank", "salt", "base", "first", "end", "sequence", "repeated spans", "own 1")})
    out = run(spark, docs, str(tmp_path))
    assert run(spark, docs.where("doc_id = 77"), str(tmp_path)).count() == 0
    if stage == "packing":
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd.collect()}
        return
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == "mine" for r in rows for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars"))
    assert {r.text for r in rows} >= {None, ""} or stage == "language_id"


TWO = " ".join(f"w{i}" for i in range(60))


def test_rows_of_one_id(spark, tmp_path):
    """Rows that share a doc_id keep their own texts: spans of one never cut another, and letters stay whole."""
    rows = [(1, TWO), (2, "xyz. " + TWO), (2, "é" * 400), (2, "other prose " * 3), (None, "ä " + TWO), (None, "ö ü")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(r.text for r in substring.remove_repeats(docs).collect())
    assert left == sorted([TWO, "", "é" * 400, "other prose " * 3, "", "ö ü"])
    mid = " ".join(f"m{i}" for i in range(45))
    rows = [(1, f"{mid} {TWO} one"), (2, "é" * 301 + f" tail {TWO} more words of its own"), (2, "ü" * 350 + " of other prose, as long as the first")]
    left = sorted(r.text for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == sorted([rows[0][1], "é" * 301 + " tail more words of its own", rows[2][1]])
    kept = sorted((str(r.doc_id), r.text) for r in neardup.keep_first(docs.union(docs), 80).collect())
    assert kept == sorted([("1", TWO), ("2", "é" * 400), ("2", "other prose " * 3), ("None", "ö ü")])


def test_storage_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from forgeframe.llm.storage import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://one:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
