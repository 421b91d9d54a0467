import hashlib
import re

import pytest
from pyspark.sql import functions as F

from larkspur.llm import pii, queries


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    t, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    checks = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    for k, (p, ok) in enumerate(checks):
        out += [(k, m.start(), m.end()) for m in re.finditer(p, t, re.A) if ok(m)]
    return out


TEXTS = [
    None, "", "é a.b@c.de, x@y @z a@b.c_d@e.f", "a@b.c.d.e@f.g", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0255 1.2.3", "4111 1111-1111 1111 and 4111111111111112", "4111111111111111 4111111111111111",
    "+1 (017) 555-7713 or +1 12 +49 (0) 30 1234-5678 9", "+123456789012345678", "1--2 3-4  5", "a" * 50_000 + "@" + "b." * 20_000 + "c", "1" * 60_000, "1." * 30_000, "+1" + " " * 50_000 + "2", "12.3.4x5.6.7.8", "𝔘x@y.z",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(77, TEXTS[2], "x"), (77, TEXTS[2], "x"), (None, TEXTS[5], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, email string")


def check(got, texts):
    for r in got:
        want = brute(texts[r["doc_id"]])
        shown = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), (texts[r["doc_id"]] or "")[:80]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == n for x in want) for n in range(4)]
        assert set(filter(None, shown.split(","))) <= set(r["spans"].split(","))


def test_brute_force(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_pii(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    check(got, dict(enumerate(TEXTS)) | {77: TEXTS[2], None: TEXTS[5]})


def test_trees(spark):
    rows = []
    for k in range(300):
        number = "4" + str(10**14 + k * 7919)[:14]
        good = next(number + c for c in "0123456789" if luhn(number + c))
        bad = number + str((int(good[-1]) + 3) % 10)
        rows.append((k, f"card {good} not {bad}, call +1 (555) 010-{k:04d} in 1234 {k:04d} rooms, n{k}@mail.example.org, from 10.0.{k % 250}.7 or 999.0.{k}.7"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, thresholds = pii.fit(docs)
    assert model is not None and set(thresholds) == set(pii.KINDS)
    # No check is a feature: the trees tell the number after "card" from the one after "not" by what stands around.
    new = spark.createDataFrame([(1, "card 4000056655665, x not 4000056655665 y"), (2, "nothing")], "doc_id long, text string")
    scores = [r["c"] for r in new.select(F.explode(pii.candidates(F.col("text"), "card")).alias("c")).select(pii.model_score(model, F.col("c.features")).alias("c")).collect()]
    assert len(scores) == 2 and scores[0] > 0.5 > scores[1]
    added = {r["doc_id"]: r["added"] for r in pii.find_pii(new, fitted=(model, {k: 0.0 for k in thresholds})).collect()}
    assert [(a["kind"], a["start"], a["end"]) for a in added[1]] == [("card", 5, 18)] and added[2] == []
    out = {r["doc_id"]: r["text"] for r in pii.redact_pii(new, fitted=(model, {k: 0.0 for k in thresholds})).collect()}
    assert out == {1: "card [card], x not 4000056655665 y", 2: "nothing"}
    # The written-out trees score as the library's model does.
    from pyspark.ml.functions import array_to_vector, vector_to_array

    s = pii.labelled_sample(docs).withColumn("vector", array_to_vector("features"))
    both = model.transform(s).select(vector_to_array("probability")[1].alias("a"), pii.model_score(model, F.col("features")).alias("b")).collect()
    assert all(abs(r["a"] - r["b"]) < 1e-9 for r in both)


def test_sample_has_copies_once_and_every_kind_and_label(spark):
    hot = [(k, "write to a@b.cd or 10.0.0.7") for k in range(500)]
    rare = [(1000 + k, f"n{k}@mail.example.org") for k in range(400)] + [(2000, "+1 (555) 010-7713"), (2001, "999,0,0,7")]
    docs = spark.createDataFrame(hot + rare, "doc_id long, text string").repartition(7)
    got = pii.labelled_sample(docs, sample=40).collect()
    groups = {(r["kind"], r["label"]) for r in got}
    assert len(got) == 40 and {("email", 1.0), ("ip", 1.0), ("ip", 0.0), ("phone", 1.0)} <= groups
    assert sum(r["kind"] == "ip" and r["label"] == 1 for r in got) == 1
    assert {r["total"] for r in got if (r["kind"], r["label"]) == ("email", 1.0)} == {401}


def test_redaction(spark):
    rows = [(1, "a@b.cd, 10.0.0.7 é +1 555 010 7713", None), (1, "a@b.cd, 10.0.0.7 é +1 555 010 7713", None), (None, None, "x"), (2, "", "x"), (3, "none here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _pii_email string")
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns
    assert sorted((r["text"] or "") for r in out.collect()) == sorted(["[email], [ip] é [phone]"] * 2 + ["", "", "none here"])
    assert pii.redact_pii(docs.limit(0)).count() == 0


def test_very_many_matches(spark, tmp_path):
    texts = ["12 x " * 200_000, "a@b.cd 10.0.0.7 +1 555 010 7713 " * 5_000]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check(queries.op5_pii(spark, str(tmp_path)).collect(), dict(enumerate(texts)))


def test_planted(spark):
    """Of planted personal data in documents of many shapes all is found, and clean documents have no span."""
    kinds = ["mail ann{k}@post.example.org now", "host 10.{k}.0.7 is down", "card 4111 1111 1111 1111 end", "call +1 (555) 010-{k:04d} soon"]
    rows = [(k, "some words here " * (k % 9) + kinds[k % 4].format(k=k % 250) + " and more words" * (k % 7)) for k in range(400)]
    rows += [(1000 + k, f"in {1900 + k % 99} some {k} words stood on page {k}, nothing else") for k in range(400)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[k][pii.KINDS[k % 4]]) == 1 for k in range(400))
    assert not any(got[k][n] for k in range(1000, 1400) for n in (*pii.KINDS, "added"))


def test_nothing_to_learn(spark, docs):
    plain = spark.createDataFrame([(1, "no data here"), (2, None)], "doc_id long, text string")
    assert pii.fit(plain) == (None, {}) and [r["added"] for r in pii.find_pii(plain).collect()] == [[], []]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_own_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(queries.op5_pii(spark, sf).collect(), texts)


def test_every_candidate_counts(spark):
    """The trees learn from all candidates that are not held out, twice as many as the sample has room for."""
    good = spark.range(12_000).select("id", F.format_string("see n%d@mail.example.org", "id").alias("text"))
    bad = spark.range(12_000, 12_400).select("id", F.format_string("see n%d@mail.x9", "id").alias("text"))
    docs = good.union(bad).withColumnRenamed("id", "doc_id")
    seen, own = [], pii.GBTClassifier

    class Watched(own):
        def fit(self, dataset, params=None):
            seen.append({(r["kind"], r["label"]): r["n"] for r in dataset.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()})
            return super().fit(dataset, params)

    pii.GBTClassifier = Watched
    try:
        pii.fit(docs)
    finally:
        pii.GBTClassifier = own
    tenths = {r["label"]: r["n"] for r in pii.labelled_candidates(docs).where("pmod(order, 10) >= 2").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert seen == [{("email", k): n for k, n in tenths.items()}] and tenths[1.0] > 9_000 and tenths[0.0] > 250
