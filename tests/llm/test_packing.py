import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import packing, queries

TEXTS = [None, "", " ", "<|endoftext|>", "word " * 3000, "a  b \n\n c\td  ", "x" * 30_000, "né, Ünï.\nNext line.\n\nlast ", "tail \u3000 wide\u2003 spaces\x1c \x85 end"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def ids_of(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids


def test_same_ids(whole):
    rng = random.Random(2)
    signs = [*"abc ,.\n\t é  1'0<|>\x1c Ñ\u3000\xa0", "<|endoftext|>", " the", "'s", " \n", "  "]
    for text in [*TEXTS, *("".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000))]:
        assert packing.token_bytes(text) == array("I", ids_of(whole, text)).tobytes(), repr(text)


def test_whole_table(spark, whole, tmp_path):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(50, "twice here", 1), (50, "twice here", 1), (None, "no id", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, length long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_pack(spark, str(tmp_path)).collect()
    window = {}
    for r in got:
        window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in window.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end and n > 0
            end += n
        assert end <= packing.WINDOW
    for k, text in enumerate(TEXTS):
        ids, at = [*ids_of(whole, text), 0], 0
        for r in sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(array("I", part).tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sum(r["doc_id"] == 50 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1


def test_sequences(spark):
    docs = spark.createDataFrame([(k, "some words here " * (k * 40)) for k in range(30)], "doc_id long, text string")
    packed = packing.pack_documents(docs)
    seqs = packing.sequences(packed).collect()
    assert all(len(s["ids"]) == packing.WINDOW or len(s["ids"]) & (len(s["ids"]) - 1) == 0 for s in seqs)
    assert sum(sum(s["mask"]) for s in seqs) == sum(r["length"] for r in packed.collect())
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_shards_are_bounded(spark):
    """Long documents and very many equal rows: no shard has more than its bound, and padding stays small."""
    long = spark.range(100).selectExpr("id as doc_id", "repeat('word ', 100000) as text")
    same = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'the same few words in every row' as text")
    seen = []
    pieces = packing.tokenize(long.union(same).repartition(5)).drop("ids")
    rows = packing.assign_windows(pieces, shard_pieces=500).collect()
    sizes = {}
    for r in rows:
        if r["length"] < packing.WINDOW:
            sizes[r["sequence_id"] >> 33] = sizes.get(r["sequence_id"] >> 33, 0) + 1
        else:
            assert r["sequence_id"] % 2 == 1 and r["offset"] == 0
            seen.append(r["sequence_id"])
    assert len(sizes) == 7 and max(sizes.values()) <= 500 + 5 and len(seen) == len(set(seen)) >= 9700
    windows = len({r["sequence_id"] for r in rows})
    assert sum(r["length"] for r in rows) / 1024 / windows > 0.98
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == max(r["doc_tokens"] for r in rows)


def test_broken_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('C3286162') as string) as text")
    assert packing.pack_documents(docs).first()["doc_tokens"] == len(packing.token_bytes("\ufffd(ab")) // 4 + 1


def test_best_fit():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 1024) for _ in range(3000)), reverse=True)
    names, offsets = packing.place(lengths)
    room = {}
    for n, name, offset in zip(lengths, names, offsets, strict=True):
        fits = [c for c in room.values() if c >= n and n < 1024]
        if offset:
            assert room[name] == min(fits) == 1024 - offset
        else:
            assert not fits
        room[name] = 1024 - offset - n
    assert sum(lengths) / 1024 / len(room) > 0.98
    assert packing.place([]) == ([], []) and packing.place([4, 4], 4) == ([0, 1], [0, 0])
