import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from loamwork.llm.word_crf import BLOCK, UNKNOWN, Model, Tagger, fit_and_identify, forward_backward, labelled_sample, letter_words, train

EN = "the people of the town were walking with their dogs and the weather was nice that morning".split()
FR = "les gens de la ville marchaient avec leurs chiens et il faisait très beau dans la journée".split()


def samples():
    rng = np.random.default_rng(0)
    return [(" ".join(rng.choice(w, 40)), lang) for w, lang in ((EN, "en"), (FR, "fr")) for _ in range(30)]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(1, 5, 3)), rng.normal(size=(3, 3))
    total = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        weight = np.exp(sum(scores[0, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for t, y in enumerate(path):
            total[t, y] += weight
    got, pairs, log_z = forward_backward(scores, moves)
    assert np.allclose(got[0], total / total[0].sum()) and np.isclose(log_z[0], np.log(total[0].sum())) and np.isclose(pairs.sum(), 4)


def test_blocks_are_exact():
    rng = np.random.default_rng(2)
    tagger = Tagger(Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), frozenset()))
    sizes = np.array([1, BLOCK, BLOCK + 1, 3, 5 * BLOCK, 7 * BLOCK - 1, 2])
    scores = rng.normal(size=(int(sizes.sum()), 3)) * 3
    got, at = tagger.marginals(scores, sizes), 0
    for n in sizes:
        want, _, _ = forward_backward(scores[None, at : at + n], tagger.model.moves)
        assert np.allclose(got[at : at + n], want[0])
        at += n


def test_learns_words_and_switches():
    model = train(samples(), words_a_label=3000)
    tagger = Tagger(model)
    mixed = EN + FR + EN
    got = [lang for _, lang, _ in tagger.label_words(" ".join(mixed))]
    want = ["en"] * len(EN) + ["fr"] * len(FR) + ["en"] * len(EN)
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) > 0.95
    assert model.moves.diagonal().min() > model.moves[~np.eye(2, dtype=bool)].max()
    assert tagger.predict([" ".join(FR), "", None, "123 --", "²", " ".join(EN * 3000)])[0][0] == "fr"
    assert [p[0] for p in tagger.predict([None, "", "1 2 _", "²"])] == [UNKNOWN] * 4


def test_letters():
    assert letter_words("Ab1c É_d") == ["ab", "c", "é", "d"] and letter_words("½ ²") == [] and letter_words(None) == []


def test_column_form(spark):
    rows = [(k, t, lang, "x") for k, (t, lang) in enumerate(samples())] + [(900, None, "en", "x"), (901, "7", None, "x"), (None, " ".join(FR), None, "x"), (902, " ".join(EN), "xx", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    out = fit_and_identify(docs, words_a_label=3000).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id in (900, 901):
            assert (r.lang_pred, r.score) == (UNKNOWN, 0)
    right = [r.lang_pred == r.lang for r in out if r.held_out and r.doc_id < 900]
    assert np.mean(right) == 1
    assert fit_and_identify(docs.where("false")).collect() == []
    assert {r.lang_pred for r in fit_and_identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {UNKNOWN}


def test_copies_do_not_crowd_out_a_label(spark):
    rows = [("one text copied", "en")] * 20_000 + [(f"other text {k}", "en") for k in range(100)] + [(f"texte {k}", "fr") for k in range(5)]
    sample = labelled_sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 10)
    assert len(set(sample)) == len(sample) == 15 and sum(lang == "en" for _, lang in sample) == 10
