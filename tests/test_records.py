"""Record files: checksums, frames, examples, a round trip in Spark."""

import glob
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forgeframe.sources import records


def slow_crc(data):
    x = 0xFFFFFFFF
    for b in data:
        x ^= b
        for _ in range(8):
            x = (x >> 1) ^ 0x82F63B78 if x & 1 else x >> 1
    return x ^ 0xFFFFFFFF


def test_known_checksums():
    assert records.crc32c([b"123456789", b"", b"\0" * 32, b"\xff" * 32, bytes(range(32))]).tolist() == [0xE3069283, 0, 0x8A9136AA, 0x62A8AB43, 0x46DD794E]
    assert int(records.masked(records.crc32c([b"123456789"]))[0]) == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) % (1 << 32)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=1200), max_size=5))
def test_checksums(data):
    assert records.crc32c(data).tolist() == [slow_crc(d) for d in data]


FEATURES = st.dictionaries(st.text(min_size=1, max_size=5), st.one_of(st.lists(st.binary(max_size=300), min_size=1, max_size=3), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=4), st.lists(st.floats(width=32, allow_nan=False), min_size=1, max_size=4)), max_size=4)


@settings(max_examples=100, deadline=None)
@given(st.lists(FEATURES, max_size=4))
def test_examples(examples):
    data = records.framed([records.encoded(e) for e in examples])
    assert [records.decoded(r) for part in records.read_frames(io.BytesIO(data), "f") for r in part] == examples


def test_bytes_of_an_example():
    assert records.decoded(b"\n\x0c\n\n\n\x01a\x12\x05\n\x03\n\x01x") == {"a": [b"x"]}
    unpacked = b"\n\x0f\n\r\n\x01n\x12\x08\x1a\x06\x08\x01\x08\x02\x08\x03"
    assert records.decoded(unpacked) == {"n": [1, 2, 3]}


@pytest.mark.parametrize("at", [0, 9, 20, -1, -30])
def test_damage_is_named(at):
    data = bytearray(records.framed([records.encoded({"a": [bytes([k]) * 40]}) for k in range(3)]))
    data[at] ^= 1
    with pytest.raises(records.Damaged, match=f"record {0 if at >= 0 else 2} of f"):
        list(records.read_frames(io.BytesIO(bytes(data)), "f"))
    with pytest.raises(records.Damaged, match="record 2 of f.*ends"):
        list(records.read_frames(io.BytesIO(bytes(records.framed([b"abc"] * 3)[:-2])), "f"))


def test_round_trip(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "cast(n_chars AS int) AS n_chars", "lang", "cast(doc_id / 4 AS double) AS part", "array(doc_id, -doc_id) AS both", "cast(text AS binary) AS raw", "array(lang, source) AS names", "cast(doc_id % 12 AS int) AS shard", "if(doc_id % 3 = 0, null, 'x') AS some")
    schema = "doc_id long, text string, n_chars long, lang string, part double, both array<long>, raw binary, names array<string>, some string, gone string"
    records.write_records(docs, str(tmp_path / "sharded"), "shard")
    files = sorted(glob.glob(f"{tmp_path}/sharded/*"))
    assert [f[-19:] for f in files] == [f"train-{k:05}.records" [-19:] for k in range(12)]
    back = records.read_records(spark, str(tmp_path / "sharded"), schema)
    want = docs.drop("shard").selectExpr("*", "cast(null AS string) AS gone")
    key = lambda r: r.doc_id
    plain = lambda r: {k: bytes(v) if isinstance(v, (bytes, bytearray)) else v for k, v in r.asDict().items()}
    assert [plain(r) for r in sorted(back.collect(), key=key)] == [plain(r) for r in sorted(want.collect(), key=key)]
    assert back.rdd.getNumPartitions() == 12 and [r.doc_id % 12 for r in back.select("doc_id").collect()] == sorted(r.doc_id % 12 for r in want.select("doc_id").collect())
    records.write_records(docs.select("doc_id").limit(5), str(tmp_path / "plain"))
    assert records.read_records(spark, str(tmp_path / "plain"), "doc_id long").count() == 5
    data = bytearray(open(files[3], "rb").read())
    data[-40] ^= 64
    open(files[3], "wb").write(data)
    with pytest.raises(Exception, match="of train-00003.records is damaged"):
        back.collect()


def test_natural_order():
    assert sorted(["b/train-10.x", "b/train-9.x", "b/other.x", "b/train-09.x"], key=records.natural_key) == ["b/train-09.x", "b/train-9.x", "b/train-10.x", "b/other.x"]
