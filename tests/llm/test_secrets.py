import hashlib
import re

import pytest

from larkspur.llm import queries, secrets
from larkspur.llm.common import table

PATTERNS = [("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|(?i:passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]


def brute(text):
    out = []
    for k, (kind, p, ok) in enumerate(PATTERNS):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text or "") if ok(m)]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans).encode()).hexdigest()


HEX = "0123456789abcdef" * 3
TEXTS = [
    None, "", "nothing", f"é token = '{HEX}' and AKIA{'A1' * 9}", "secret: token = abcdefgh", "token=token=abcdefgh", "API_KEY:abcdef apikey='abc' Passwd=12345", "AKIAAKIAAKIA", "AKIA" * 9,
    f"{HEX} {HEX}g{HEX}", "token=abcdef " * 50, "password\n=abcdef", "secret\":\"abcdef1", "ſecret=abcdefg", "𝔘 token=abcdefg", "x" * 200_000 + " token=abcdefg", "a" * 100_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "zz", k) for k, t in enumerate(TEXTS)] + [(99, TEXTS[3], "zz", 1), (99, TEXTS[3], "zz", 1), (None, TEXTS[4], None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, blob string, assign int")


def test_brute_force(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_secret_scan(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    texts = dict(enumerate(TEXTS)) | {99: TEXTS[3], None: TEXTS[4]}
    for r in got:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(want), texts[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in want) for k in range(3)]


def test_added_rules(spark):
    d = spark.createDataFrame([(1, "-----BEGIN RSA PRIVATE KEY-----\nxx"), (2, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij")], "doc_id long, text string")
    got = {r["doc_id"]: [(f["key"].split("@")[0], f["start"], f["end"]) for f in r["findings"]] for r in secrets.scan_secrets(d).collect()}
    assert got == {1: [("private_key", 0, 31)], 2: [("web_token", 0, 36)]}


def test_ledger_is_incremental(spark, docs, tmp_path):
    path, blobs = str(tmp_path / "ledger"), len({t or "" for t in TEXTS})
    first = secrets.scan_incremental(spark, docs, path)
    assert first.count() == blobs and all(len(r["keys"]) == len(secrets.RULES) for r in first.collect())
    # All pairs are known: nothing is scanned again, and the findings are the same.
    assert secrets.unseen(docs, first).count() == 0
    assert secrets.scan_incremental(spark, docs, path).count() == blobs
    again = secrets.scan_secrets(docs, ledger_path=path)
    assert sorted(map(str, again.collect())) == sorted(map(str, secrets.scan_secrets(docs).collect())) and spark.read.parquet(path).count() == blobs
    # An edited pattern is a new version: only that rule is due on known blobs, all rules on a new one.
    newer = (*secrets.RULES[:-1], secrets.Rule("web_token", "eyJ", base=False))
    more = spark.createDataFrame([(5, "eyJ token=abcdefg")], "doc_id long, text string").union(docs.select("doc_id", "text"))
    due = {r["blob"]: r["due"] for r in secrets.unseen(more, spark.read.parquet(path), rules=newer).collect()}
    assert sorted(len(x) for x in due.values()) == [1] * blobs + [len(newer)] and all(newer[-1].key in x for x in due.values())
    found = secrets.scan_secrets(more, rules=newer, ledger_path=path).where("doc_id = 5 and size(findings) = 2").collect()
    assert [(f["key"].split("@")[0], f["start"]) for f in found[0]["findings"]] == [("assign", 4), ("web_token", 0)]
    # A pair that two runs appended counts once.
    spark.read.parquet(path).write.mode("append").parquet(str(tmp_path / "twice"))
    spark.read.parquet(path).write.mode("append").parquet(str(tmp_path / "twice"))
    twice = secrets.join_findings(docs, spark.read.parquet(str(tmp_path / "twice")))
    assert sorted(map(str, twice.collect())) == sorted(map(str, secrets.scan_secrets(docs).collect()))


def test_paths_and_versions(spark):
    rows = [("a.py", 1, "token=abcdefg"), ("a.py", 2, "clean"), ("b.py", 1, "token=abcdefg")]
    found = secrets.scan_secrets(spark.createDataFrame(rows, "path string, version int, text string"), ("path", "version")).collect()
    assert {(r["path"], r["version"]) for r in found if r["findings"]} == {("a.py", 1), ("b.py", 1)} and len(found) == 3


def test_very_many_matches(spark, tmp_path):
    n = 200_000
    texts = ["token=abcdef " * n, "nothing"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op1_secret_scan(spark, str(tmp_path)).collect()}
    assert got[0]["n_assign"] == n and got[0]["base_sha256"] == digest(brute(texts[0])) and got[1]["n_assign"] == 0
    out = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(d).collect()}
    assert out[0] == "token=[assign] " * n and out[1] == "nothing"


def test_redaction(spark, docs):
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] is None and got[2] == "nothing" and got[3] == "é token = '[assign]' and [access]" and got[9] == "[hex] [hex]g[hex]"
    assert secrets.redact_secrets(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([("token=AKIA" + "B1" * 9, "x", "y")], "text string, _blob string, _findings string")
    assert secrets.redact_secrets(odd).collect() == [("token=[access]", "x", "y")]


def test_empty(spark, docs):
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_own_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in queries.op1_secret_scan(spark, sf).collect():
        assert r["base_sha256"] == digest(brute(texts[r["doc_id"]]))
