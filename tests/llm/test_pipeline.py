import hashlib
import zlib
from array import array

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import decontaminate, packing, queries
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import components, slow_fingerprint
from tests.test_oracle import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}


def expected_kept(rows):
    """One row of each group of fingerprints within two bits: least id, null last, of rows that share it the least digest."""
    rows = list(dict.fromkeys(rows))
    best = {}
    for (doc, text), root in zip(rows, components([slow_fingerprint(t) for _, t in rows]), strict=True):
        key = hashlib.sha256(f"{'null' if doc is None else doc}{':null' if text is None else ':'}{text or ''}".encode()).hexdigest()
        best[root] = min(best.get(root, (True, 0, "~", None)), (doc is None, doc or 0, key, (doc, text)))
    return {x[3] for x in best.values()}


def test_stages(spark, tmp_path):
    """Every stage against an expectation of its own, on rows with null and shared ids and clashing names."""
    leak = "one two three four five six seven eight nine ten eleven twelve"
    english = "the house and the garden of the old man were quiet in the morning when we came there "
    rows = [
        (1, english * 3), (2, english * 3), (3, "12 34 !!"), (4, None), (5, f"here you find {leak} and some other words of the text that follow it"),
        (6, "my token = abcdefghij was lost in the house of the king and nobody found it again"), (7, "all the children went home after the long summer and they slept"),
        (None, "a row without a number tells of the sea and of the ships on it"), (None, "another row without a number tells of hills, woods and old roads"), (None, english * 3),
        (8, "two rows share this number and this is the first of them by its words"), (8, "the second row with that number has nothing in common but the number"), (7, "all the children went home after the long summer and they slept"),
        (9, "seven eight nine ten eleven twelve stood first, and far from it stood one two three four five six"),
    ]
    rows += [(100 + k, f"{english} number {k} is of the same kind as words that {k * 7} people say") for k in range(40)]
    docs = [(k, t, "en", "s", len(t or ""), "kept", "kept") for k, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, blob string, _kept_id string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = now.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = now.collect()
        assert now.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    assert list(seen) == ["language_id", "simhash_dedup", "decontaminate", "secret_scan", "packing"]
    pairs = lambda name: sorted(((r["doc_id"], r["text"]) for r in seen[name]), key=str)
    want = [x for x in rows if x[0] not in (3, 4)]
    assert pairs("language_id") == sorted(want, key=str)
    want = expected_kept(want)
    assert pairs("simhash_dedup") == sorted(want, key=str) and (2, english * 3) not in want and (None, english * 3) not in want and sum(d is None for d, _ in want) == 2 and sum(d == 8 for d, _ in want) == 2
    own = sorted(want, key=str)
    leaked = {k for k, _ in brute([t for _, t in own], [decontaminate.make_item(1, leak)])}
    want = [x for k, x in enumerate(own) if k not in leaked]
    assert pairs("decontaminate") == want and 5 not in {d for d, _ in want}
    want = sorted(((d, t.replace("token = abcdefghij", "token = [assign]")) for d, t in want), key=str)
    assert pairs("secret_scan") == want and all(r["n_chars"] == len(r["text"]) and r["_kept_id"] == r["blob"] == "kept" for r in seen["secret_scan"])
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    digest = lambda t: zlib.crc32(array("I", [*whole.encode(t, add_special_tokens=False).ids, 0]).tobytes())
    packed = sorted(((r["doc_id"], r["ids_crc32"]) for r in seen["packing"]), key=str)
    assert packed == sorted(((d, digest(t)) for d, t in want), key=str)
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == packed


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
