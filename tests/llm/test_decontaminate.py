import random

from larkspur.llm import decontaminate as dc
from larkspur.llm import queries


def brute(texts, items):
    out = set()
    for k, text in enumerate(texts):
        words = dc.words_of(text)
        grams = dc.shingles_of(words)
        for item in items:
            own = item.shingles if len(item.words) >= 5 else None
            there = {b" ".join(words[i : i + len(item.words)]) for i in range(len(words))} if own is None else grams
            share = len(item.shingles & there) / len(item.shingles) if item.shingles else 0
            parts = all(not p or len(p & set(words)) >= 0.5 * len(p) for p in (item.question, item.answer))
            if share >= 0.8 and parts:
                out.add((k, item.item_id))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["the", "of", "and"] * 30
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [f"{say(rng.randint(4, 40))}. {say(rng.randint(1, 8))}." for _ in range(40)] + [say(200), "two words", say(5)]
    texts = [say(rng.randint(0, 400)) for _ in range(120)]
    for k in range(100):
        item = rng.choice(items).split()
        if k % 3 == 0:
            item[rng.randrange(len(item))] = "changed"
        if k % 7 == 0:
            item = item[: len(item) // 2]
        texts.append(f"{say(rng.randint(0, 300))} {' '.join(item).upper()} {say(rng.randint(0, 300))}")
    return [*texts, None, "", "x" * 100_000], items


def test_brute_force(monkeypatch):
    for seed in range(4):
        texts, raw = corpus(seed)
        items = [dc.make_item(k, t) for k, t in enumerate(raw)]
        index = dc.Index(items)
        monkeypatch.setattr(dc, "TOGETHER", 3000 if seed % 2 else 200_000)
        got = {(k, i) for k, i, _, _ in index.search(texts)}
        want = brute(texts, items)
        assert got == want and len(want) > 50


def test_bounds_skip_nothing():
    """Block-max retrieval equals scoring every passage against every unit."""
    texts, raw = corpus(9)
    index = dc.Index([dc.make_item(k, t) for k, t in enumerate(raw)])
    start, column, value = index.rows
    for text in texts[:60]:
        words = dc.words_of(text)
        codes = index.codes(words)
        want = {}
        for at in range(0, len(words), dc.STRIDE):
            score = {}
            for t in set(codes[at : at + dc.PASSAGE].tolist()) - {0}:
                for e in range(start[t], start[t + 1]):
                    score[column[e]] = score.get(column[e], 0) + value[e]
            for u, s in score.items():
                if s >= dc.RETRIEVE:
                    want[index.item_of[u]] = max(want.get(index.item_of[u], 0), s)
        import numpy as np

        got = {i: s for (_, i), s in index.retrieve(codes, np.zeros(len(codes), int)).items()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_scattered_items():
    """Items in pieces, as far apart as may be, are found as brute force finds them."""
    for seed in range(3):
        rng = random.Random(seed)
        vocab = [f"w{k}" for k in range(2000)] + ["the", "of", "and"] * 200
        say = lambda n: " ".join(rng.choices(vocab, k=n))
        raw = [f"{say(rng.randint(15, 120))}. {say(rng.randint(1, 8))}." for _ in range(60)]
        items, texts = [dc.make_item(k, t) for k, t in enumerate(raw)], []
        for k in range(150):
            words = rng.choice(raw).split()
            cuts = sorted(rng.sample(range(1, len(words)), 1 + k % 3))
            parts = [" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True)]
            rng.shuffle(parts)
            texts.append(f" {say(rng.choice([1, 150, 400]))} ".join(["", *parts, ""]))
        texts.append(say(30_000))
        got = {(k, i) for k, i, _, _ in dc.Index(items).search(texts)}
        assert got == brute(texts, items) and len(got) > 70
    item = " ".join(f"x{k}" for k in range(60))
    between = " ".join(f"y{k}" for k in range(150))
    far = [f" {between} ".join(" ".join(item.split()[a : a + 20]) for a in (0, 20, 40))]
    found = dc.Index([dc.make_item(1, item)]).search(far)
    assert [(k, i) for k, i, _, _ in found] == [(0, 1)] and found[0][3] > 0.85


def test_only_retrieved_pairs_are_verified(monkeypatch):
    """Texts with all words of an item in another order are told by retrieval, and what it leaves is all that is verified."""
    rng = random.Random(5)
    raw = [" ".join(f"x{k % 7}y{j}" for j in range(40)) for k in range(20)] + ["two words", "alone"]
    items, texts = [dc.make_item(k, t) for k, t in enumerate(raw)], ["words two", "some two words here", "not alone", ""]
    for k in range(20):
        words = raw[k].split()
        texts += [" ".join(rng.sample(words, 40)), " ".join(words[::-1]), f"say {raw[k]} now", " ".join(words[20:] + words[:20])]
    index, verified, overlap = dc.Index(items), [], dc.Index.overlap

    def spy(self, codes, document, d, i):
        verified.extend(zip(d.tolist(), i.tolist(), strict=True))
        return overlap(self, codes, document, d, i)

    monkeypatch.setattr(dc.Index, "overlap", spy)
    want = brute(texts, items)
    assert {(k, i) for k, i, _, _ in index.search(texts)} == want and len(want) > 40
    assert set(verified) == want


def test_clean_rows_need_no_passages(spark, monkeypatch):
    """Whether a row stays follows from its verified pairs; its passages are scored for ``find_leaks`` alone."""
    texts, raw = corpus(2)
    items = spark.createDataFrame(list(enumerate(raw)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = next(dc.build_indexes(items))

    def unwanted(*_):
        raise AssertionError("a passage was scored")

    index.retrieve = unwanted
    monkeypatch.setattr(dc, "build_indexes", lambda _: iter([index]))
    leaked = {k for k, _ in brute(texts, [dc.make_item(k, t) for k, t in enumerate(raw)])}
    assert {r["doc_id"] for r in dc.keep_clean(docs, items).collect()} == set(range(len(texts))) - leaked


def test_rounds_use_the_counts_of_all_items(spark, monkeypatch):
    _, raw = corpus(3)
    items = spark.createDataFrame(list(enumerate(raw)), "item_id long, text string")
    whole = next(dc.build_indexes(items))
    monkeypatch.setattr(dc, "INDEX_WORDS", 1000)
    need = {x.items[k].item_id: round(float(x.need[k]), 9) for x in dc.build_indexes(items) for k in range(len(x.items))}
    assert need == {whole.items[k].item_id: round(float(whole.need[k]), 9) for k in range(len(whole.items))}


def test_broken_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('FF6F6E652074776F20746872656520666F75722066697665') as string) as text")
    items = spark.createDataFrame([(7, "two three four five")], "item_id long, text string")
    assert dc.find_leaks(docs, items).count() == 1 and dc.keep_clean(docs, items).count() == 0


def test_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "say one two three four five six now", 0), (None, "ONE, two three: four five six", 0), (2, None, 0), (2, "other", 0), (2, "other", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, "one two three four five six"), (8, None), (None, "other"), (9, "!!"), (7, "one two three four five six")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, items).collect()} == {(1, 7), (None, 7)}
    clean = dc.keep_clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == 3
    assert dc.find_leaks(docs.limit(0), items).count() == 0 and dc.find_leaks(docs, items.limit(0)).count() == 0
    assert dc.keep_clean(docs, items.limit(0)).count() == 5
    monkeypatch.setattr(dc, "INDEX_WORDS", 5)  # several rounds find the same
    assert len(list(dc.build_indexes(items))) > 1
    assert {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, items).collect()} == {(1, 7), (None, 7)} and dc.keep_clean(docs, items).count() == 3


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [dc.make_item(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(docs[k]["doc_id"], i) for k, i in brute([d["text"] for d in docs], items)}
    assert {(r["doc_id"], r["item_id"]) for r in queries.op7_decontaminate(spark, sf).collect()} == want
