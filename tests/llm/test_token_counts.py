import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import loamwork.llm.token_counts as token_counts_module
from loamwork.llm.common import table
from loamwork.llm.token_counts import Counter, pieces, read_vocabulary, token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(PATH)


def count(counter, text):
    return int(counter.counts([text])[0])


def of(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_proven_strings_are_one_token(library, vocabulary):
    assert len(vocabulary.whole) > 45_000
    for text in random.Random(1).sample(vocabulary.whole, 3000):
        # a string may split before it is merged; merged whole it is one
        assert len(library.model.tokenize("".join(c for c, _ in library.pre_tokenizer.pre_tokenize_str(text)))) == 1


def test_strings_that_are_no_token_alone_are_merged(library, vocabulary):
    counter = Counter(vocabulary, PATH)
    for text in (" zzyzxq", "unbelievablement", "ünïcödé", "\t\t  \n x"):
        assert text not in vocabulary.whole and count(counter, text) == of(library, text)


def test_made_texts(library, vocabulary):
    counter, draw = Counter(vocabulary, PATH), random.Random(7)
    bits = ["the", " of", "'s", "'ll", " 'S", "  ", "\n", "\t", "\xa0", "　", "\x85", " ", "é", "é", "日本", "🙂", "👩‍👩‍👧", "࢏", "\U00033000", "\U000187f9", "١٢", "Ⅷ", "½", "<|endoftext|>", "<|endoftext", "a" * 40, "ab" * 30, "_", "--", "​", "﻿", "1234567", "\x00", "퟿"]
    for _ in range(3000):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(12)))
        assert count(counter, text) == of(library, text), text


def test_long_texts(library, vocabulary):
    counter = Counter(vocabulary, PATH)
    for text in ("a" * 20_000, "abcab" * 9_001, " " * 5_000 + "x", "word " * 30_000, "<|endoftext|>" * 500, "née࢏ " * 900):
        assert count(counter, text) == of(library, text)
    text = "one two  three\n four five " * 50
    assert "".join(pieces(text, 40)) == text and sum(count(counter, p) for p in pieces(text, 40)) == of(library, text)


def test_many_texts_at_once_and_a_small_memory(library, vocabulary, monkeypatch):
    monkeypatch.setattr(token_counts_module, "REMEMBERED", 20)
    monkeypatch.setattr(token_counts_module, "PIECE", 200)
    draw = random.Random(3)
    texts = [None, "", *("".join(chr(draw.choice((32, 97, 98, 120, 121, 233, 0x4E00, 0x10FFFF))) for _ in range(draw.randrange(400))) for _ in range(300))]
    counter = Counter(vocabulary, PATH)
    assert counter.counts(texts).tolist() == [of(library, t) for t in texts]
    assert len(counter.costs) < len(vocabulary.whole) + 500


def test_heap_and_matrix_agree(vocabulary):
    draw, merges = random.Random(9), vocabulary.merges
    words = ["".join(draw.choice("aeinrst h") for _ in range(draw.randrange(1, 64))).encode() for _ in range(2000)]
    assert merges.lengths(words).tolist() == [len(merges._by_heap(merges.first[list(w)].tolist())) for w in words]


def test_whole_table_as_the_library(spark, library):
    docs = table(spark, FOLDER, "documents")
    got = token_counts(docs, PATH).collect()
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(want)
    for r in got:
        n = of(library, want[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(want[r.doc_id].encode()), n, n > 512)


def test_odd_tables(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 1), (2, "a b", None), (2, "a b", 3), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").withColumn("over_limit", F.lit("x")).withColumn("id", F.lit(9))
    out = token_counts(docs, PATH, limit=1).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == [(0, 0, 0, False), (0, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False), (2, 3, 2, True), (2, 3, 2, True)]
    assert token_counts(spark.createDataFrame([], "doc_id string, text string"), PATH).collect() == []


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        read_vocabulary(str(public_tokenizers.path("word_bpe_49k.json")))
