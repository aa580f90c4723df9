"""Encoding against the vocabulary's own libraries."""

import os
import random

import pytest

from kilnspan.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZERS), reason="no vocabularies")
TEXTS = [
    "", " ", "\n\n  \n", "Hello world", "don't we'll I'M  it's", "a" * 5000, "ab" * 3000, "naïve Ünïcödé ½ ⅓ ²³ x̄", "日本語のテキストです。" * 50, "مرحبا", "🙂🙃👩‍👩‍👧",
    "<|endoftext|> is text", "x = {'a': 1}\n\tif x:\r\n        return\u00a0\u200b", "1234567890 " * 20, "\x00\x01\x7f", "word" + " " * 300 + "end  ", "\ufeffBOM",
]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_same_as_library(library):
    e = bpe.encoder()
    rng = random.Random(1)
    alphabet = "abcdeE theing \n\t'sd12.,;-_(){}éßñ中文かな한🙂\u00a0"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(500)]
    for t in texts:
        assert e.encode(t) == library(t), t[:60]


def test_one_long_pre_token(library):
    rng = random.Random(2)
    words = ["the", "ing", "tion", "qu", "zx", "er", "anti", "é"]
    text = "".join(rng.choice(words) for _ in range(20_000))
    assert bpe.encoder().encode(text) == library(text)


def test_queue_pops_in_rank_order():
    q = bpe.RankQueue(50_000)
    rng = random.Random(3)
    ranks = [rng.randrange(50_000) for _ in range(3000)]
    for n, r in enumerate(ranks):
        q.push(r, n)
    out = []
    while (r := q.first()) >= 0:
        out += [(r, n) for n in q.take(r)]
    assert [r for r, _ in out] == sorted(ranks) and len(out) == len(ranks) and q.top == 0


def test_memo_may_overflow(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_SIZE", 3)
    e = bpe.Encoder(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    text = "one two three four five six one two"
    assert e.encode(text) == library(text) and len(e.memo) <= 3
    assert e.encode(chr(0xD800)) == library(chr(0xFFFD))


def test_columns(spark, library):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (1, "Hello world")], "doc_id bigint, text string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect())
    assert got == [(1, library("Hello world"))] * 2 + [(2, []), (3, [])]
    assert sorted(r.n for r in df.select(bpe.size_column("text").alias("n")).collect()) == [0, 0, 2, 2]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
