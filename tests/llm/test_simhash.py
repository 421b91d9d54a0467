import random
import re

import pytest
import xxhash

from larkspur.llm import queries, simhash
from larkspur.llm.components import connected_components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b C", "Ünï Çode\x0bWords\x1chere and there Straße", "x " * 5000, "long" * 50_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_slices(monkeypatch):
    text = " ".join(str(k * k % 97) for k in range(1000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text.encode()) == whole == slow_fingerprint(text)


def test_groups(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(60)]
    for _ in range(120):
        own = rng.choice(texts).split()
        own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    texts += [None, "", texts[0], texts[0], "tiny", "TINY"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp string, component long")
    got = {r["doc_id"]: r for r in simhash.simhash_components(df).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    roots = components(fps)
    low = {}
    for i, r in zip(ids, roots, strict=True):
        low[r] = min(low.get(r, i), i)
    assert len(got) == len(texts)
    for i, f, r in zip(ids, fps, roots, strict=True):
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == low[r]
    kept = simhash.keep_one_per_component(df.union(df))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(low.values())


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [slow_fingerprint(d["text"]) for d in docs]
    low, roots = {}, components(fps)
    for d, r in zip(docs, roots, strict=True):
        low[r] = min(low.get(r, d["doc_id"]), d["doc_id"])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, sf).collect()}
    assert got == {d["doc_id"]: (f"{f:016x}", low[r]) for d, f, r in zip(docs, fps, roots, strict=True)}


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "q r s t u")], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.simhash_components(df).collect()} == {None, 4}
    assert simhash.keep_one_per_component(df).count() == 2
    assert simhash.simhash_components(df.limit(0)).count() == 0 and simhash.keep_one_per_component(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_links(df, 3)


def test_null_and_shared_ids_keep_a_row_of_each_group(spark):
    near = " ".join(f"w{k}" for k in range(200))
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "e f g h i"), (None, None), (None, near), (9, near), (4, "q r s t u"), (4, "v w x y z"), (4, "v w x y z"), (5, "Q r s t u")]
    df = spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id long, text string, row_key map<string,int>").repartition(5)
    kept = simhash.keep_one_per_component(df)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = [(None, "a b c d"), (None, "e f g h i"), (None, None), (9, near), (4, "q r s t u"), (4, "v w x y z")]
    assert kept.columns == df.columns and got == sorted(want, key=str)


def test_all_pairs_within_two_bits_meet(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [b ^ (1 << 63) for b in base[:5]] + [b ^ 7 for b in base[:5]]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in set(signed)], "fp long"))
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    roots = components(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (got.get(signed[i], signed[i]) == got.get(signed[j], signed[j])) == (roots[i] == roots[j])


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(100, 400)]
    hub = [(0, k) for k in range(1000, 1500)]
    df = spark.createDataFrame([*chain, *hub, (7, 7), (None, 3)], "a long, b long").repartition(8)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert len(got) == 301 + 501 and {got[k] for k in range(100, 401)} == {100} and {got[k] for k in range(1000, 1500)} == {0}
    assert connected_components(df.limit(0)).count() == 0
