import random

import public_tokenizers
import pytest
import sentencepiece

from loamwork.llm.decontaminate import contained_items, decontaminate, may_lack
from loamwork.llm.piece_bpe import codec, piece_round_trip

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(2)
    pool = ["the", "tionally", "Élève", " ", "  ", "\n", "▁", "<s>", "0x1234", "12345", "日本語", "\x00", "<0x0A>", "é", "\t", "\U0001f600", "zzzz", "-----", "====", "."]
    out = ["", " ", "  ", "▁", "\n", "a", "a" * 3000, " " * 200, "ab" * 900 + " c", "  lead", "trail  ", "é" * 77]
    return out + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(400)]


def test_same_ids_and_text_as_the_library():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), codec(MODEL)
    for text in odd_texts():
        ids = lib.encode(text)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == lib.decode(ids), text
        assert own.digest(text) == (",".join(map(str, ids)), lib.decode(ids)), text


def test_column_form(spark):
    texts = [None, "", "a b", "a b", "ü" * 40_000]
    docs = spark.createDataFrame([(k, t, 3, [1]) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids array<int>")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in piece_round_trip(docs, MODEL, keep_ids=True).collect():
        want = lib.encode(texts[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want) and r.decoded_text == lib.decode(want)
    assert piece_round_trip(docs.where("false"), MODEL).collect() == []


@pytest.mark.parametrize("q", range(1, 200))
def test_most_that_may_be_absent(q):
    m = may_lack(q, 0.8)
    assert (q - m) / q >= 0.8 and (m == q or (q - m - 1) / q < 0.8)


def plain_leaks(docs, items):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    cut = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    out = []
    for d, t in docs:
        for i, x in items:
            w = low(x)
            if w:
                n = min(5, len(w))
                own = cut(w, n)
                m = len(own & cut(low(t), n))
                if m / len(own) >= 0.8:
                    out.append((d, i, len(own), m))
    return sorted(out, key=str)


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 60)))) for k in range(40)] + [(90, None), (91, ""), (92, "Two Words"), (92, "Two Words")]
    docs = [(50, None), (51, ""), (52, "with two WORDS here"), (None, items[3][1])]
    for k in range(120):
        w = [word() for _ in range(rng.randrange(5, 300))]
        copied = rng.choice(items[:40])[1].split()
        for _ in range(rng.randrange(3)):
            copied[rng.randrange(len(copied))] = "other"
        at = rng.randrange(len(w))
        docs.append((100 + k, " ".join(w[:at] + copied + w[at:])))
    docs.append((900, " ".join(word() for _ in range(20_000)) + "\n" + items[5][1].upper()))
    docs.append((900, docs[-1][1]))
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    want = plain_leaks(docs, items)
    for chars in (8_000_000, 500):
        got = contained_items(d, b, block_chars=chars).collect()
        assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got), key=str) == want
    bad = {x[0] for x in want}
    kept = decontaminate(d, b).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, _ in docs if i not in bad)
    assert contained_items(d.where("false"), b).collect() == [] and contained_items(d, b.where("false")).collect() == []
    assert decontaminate(d, b.where("false")).count() == len(docs)
