"""Compression-distance scores against plain calls of the compressor, and with a vocabulary no list can know."""

import math
import random

import numpy as np
import pytest
import zstandard

from starling.llm import toxicity


def corpus(seed, bad, n=900):
    rng = random.Random(seed)
    plain = [a + b for a in ("ther", "ing", "ion", "wha", "sto", "mel") for b in ("an", "el", "ou", "it", "esh", "or")]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(2, 4) if i % 4 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def fitted(rows):
    known = [r for r in rows if not toxicity.fold(r[0])]
    return toxicity.train([t for _, t, y in known if y], [t for _, t, y in known if not y])


@pytest.mark.parametrize("bad", [["stupid", "moron", "clown", "zurkolf", "zurkant", "zurkich"], ["blorvax", "quimpet", "drazzel", "fenwick"], ["ärgutz", "жабокрек", "ñuflado"]])
def test_unseen_vocabularies_are_learnt(bad):
    rows = corpus(7, bad)
    scorer = fitted(rows).scorer()
    held = [(scorer.score(t), y) for i, t, y in rows if toxicity.fold(i)]
    caught = np.mean([s >= 0.7 for s, y in held if y])
    alone = np.mean([s < 0.7 for s, y in held if not y])
    assert caught >= 0.9 and alone >= 0.95


def plain_score(model, text):
    """The score by one compressor call for each window and the definition of the traits."""
    own = (text or "").encode().lower().split()
    parameters = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, window_log=18, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
    sides = [zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(raw)) for raw in (model.ordinary, model.toxic)]
    gains = []
    for i in range(0, len(own), model.words):
        text = b" " + b" ".join(own[i : i + model.words]) + b" " + toxicity.CARRIER
        gains.append(len(sides[0].compress(text)) - len(sides[1].compress(text)))
    reach = lambda t: sum(g >= model.gain + t for g in gains)
    x = [1, math.log(1 + len(gains)), *(math.log(1 + reach(t)) for t in (-2, -1, 0, 1, 2)), 10 * reach(0) / max(20, len(gains)), max(-3, min(6, max(gains) - model.gain)) if gains else -3]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, model.weights, strict=True))))))


def test_scores_equal_plain_compression(spark):
    rows = corpus(5, ["blorvax", "quimpet", "drazzel"], 400)
    model = fitted(rows)
    texts = [t for _, t, _ in rows[:60]] + [None, "", " \n", "one", "BLORVAX blorvax", "x" * 50_000, "word " * 70_000 + "blorvax quimpet " * 40]
    df = spark.createDataFrame([(i, t, 0.5, True) for i, t in enumerate(texts)], "doc_id long, text string, score double, held_out boolean")
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert got == pytest.approx({i: plain_score(model, t) for i, t in enumerate(texts)})
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, s in sorted(got.items()) if s < 0.7]


def test_few_labels_still_give_a_model():
    model = toxicity.train(["you blorvax you"], ["a fine day"])
    assert 0 <= model.scorer().score("anything at all") <= 1
    assert toxicity.train([], ["x"]).scorer().score("x") == 0
