import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import langid, queries


def test_gradients():
    """Backpropagation agrees with differences of the loss."""
    rng = np.random.default_rng(0)
    net = langid._start(["a", "b", "c"], 1)
    for p in ("bytes_in", "state_in", "out", "bias"):
        setattr(net, p, getattr(net, p).astype(np.float64))
    codes, labels = rng.integers(0, 256, (7, 4)), np.array([0, 1, 2, 1])
    _, grads = langid.gradients(net, codes, labels)
    for p, g in zip(net.parameters(), grads, strict=True):
        flat, tops = p.reshape(-1), np.argsort(-np.abs(g).reshape(-1))[:4]
        for k in tops:
            old = flat[k]
            flat[k] = old + 1e-2
            up = langid.gradients(net, codes, labels)[0]
            flat[k] = old - 1e-2
            down = langid.gradients(net, codes, labels)[0]
            flat[k] = old
            assert abs((up - down) / 2e-2 - g.reshape(-1)[k]) < 2e-3 + 0.05 * abs(g.reshape(-1)[k])


def test_positions_of_whole_texts(monkeypatch):
    """The fast pass over segments gives the states of the plain one, whatever stands beside a text."""
    net = langid._start(["a", "b"], 3)
    monkeypatch.setattr(langid, "SEGMENT", 50)
    raws = [b"", b"x", "Überlänge ".encode() * 30, b"the quick brown fox jumps over it"]
    got = langid.probabilities(net, raws)
    for raw, p in zip(raws, got, strict=True):
        want = np.zeros(2)
        for at in range(0, len(raw), 50):
            codes = np.frombuffer(raw[at : at + 50], np.uint8).astype(np.intp)[:, None]
            hs, _ = langid._states(net, langid._both(codes))
            want += np.exp(langid._log_soft(net, hs)).sum(axis=(0, 1))
        assert np.allclose(p, want / max(1, len(raw)), atol=1e-5)


@pytest.fixture(scope="module")
def found(spark):
    return {r["doc_id"]: r for r in queries.op8_language(spark, "/root/testdata/sf0.01").collect()}


def test_held_out_accuracy(spark, found):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(found) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1]
    assert all(found[d["doc_id"]]["held_out"] == (d in held) for d in docs[:50])
    right = sum(found[d["doc_id"]]["lang_pred"] == d["lang"] for d in held)
    assert right / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_learns_only_from_allowed_rows(spark):
    rows = [(k, f"text {k}", "l0") for k in range(300)] + [(None, "no id", "l0"), (5, None, "l0"), (6, "nameless", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parts = {r["part"] for r in langid.training_rows(df).collect()}
    assert parts == {f"text {k}" for k in range(300) if zlib.crc32(str(k).encode()) % 3 != 1}


def test_edges(spark):
    rows = [(1, "hello there friend", "en", 1), (2, None, "en", 1), (3, "123 !?", "en", 1), (4, "", None, 1), (None, "hello there", None, 1), (6, "hallo und guten tag", "de", 1), (6, "hallo und guten tag", "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    got = langid.predict(df).collect()
    assert len(got) == 7 and {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {2, 3, 4} and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    nothing = langid.predict(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.predict(df.limit(0)).count() == 0
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and not {2, 3, 4} & {r["doc_id"] for r in kept.collect()}


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_OF_ALL", 500)
    rows = [(k, f"w{k % 80} text {k}", f"l{k % 80}") for k in range(6000)] + [(k, "rare", "rare") for k in range(6000, 6003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = {r["lang"]: r["count"] for r in langid.training_rows(df).groupBy("lang").count().collect()}
    assert set(n) == {r[2] for r in rows} and {v for k, v in n.items() if k != "rare"} == {langid.LEAST_ROWS}
    monkeypatch.setattr(langid, "BROADCAST_LANGS", 3)
    assert {r["lang"]: r["count"] for r in langid.training_rows(df).groupBy("lang").count().collect()} == n


def test_broken_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('C328616263') as string) as text, 'en' as lang union all select 2L, 'hello', 'en'")
    assert {r["lang_pred"] for r in langid.predict(docs).collect()} <= {"en", "und"} and langid.keep_identified(docs).count() <= 2
