import random

import pytest
from tokenizers import Tokenizer, models

from larkspur.llm import queries, token_counts


@pytest.fixture(scope="module")
def exact():
    """The unigram model of the tokenizers library over the same pieces; unknown signs count as bytes."""
    voc = token_counts.vocabulary()
    t = Tokenizer(models.Unigram([("<unk>", min(voc.values())), *voc.items()], 0, False))

    def count(text):
        if not text:
            return 0
        s = "▁" + text.replace(" ", "▁")
        e = t.encode(s)
        return sum(1 if i else len(s[a:b].encode()) for i, (a, b) in zip(e.ids, e.offsets, strict=True))

    return count


def test_exact(exact):
    rng = random.Random(4)
    signs = [*"abcthe ,.\n\té  10<|>▁Ñß漢𝔘", " the", "ing ", "   "]
    parts = token_counts.Parts(token_counts.vocabulary())
    texts = ["", " ", "   ", "▁", "the", "the the", "x" * 20_000, "a▁▁b", "\u0301"] + ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        assert parts.count(t) == exact(t), repr(t)
        assert parts.count(t) == (parts.viterbi("▁" + t.replace(" ", "▁")) if t else 0), repr(t)


def test_longest_of_equals_wins():
    parts = token_counts.Parts({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0})
    assert parts.count("ab") == 2  # ▁a|b, ▁|ab and ▁|a|b score the same; the piece that ends last starts first
    assert parts.count("c") == 2 and parts.count("é") == 3


def test_whole_table(spark, sf, exact):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_token_counts(spark, sf).collect()
    assert len(got) == len(texts) and all(r["n_tokens"] == exact(texts[r["doc_id"]]) for r in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 9), (None, "a b", 9), (2, "", 9), (2, "", 9)], "doc_id long, text string, n_tokens int")
    assert sorted(tuple(r) for r in token_counts.count_tokens(df).na.fill(-1).collect()) == [(-1, 2), (1, 0), (2, 0), (2, 0)]
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_broken_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('C3286162') as string) as text union all select 2L, '\ufffd(ab'")
    assert len({r["n_tokens"] for r in token_counts.count_tokens(docs).collect()}) == 1
