import random
import zlib

import numpy as np
import pytest

from starling.llm import lengths, packing
from starling.llm.queries import word_tokenizer
from starling.llm.tokens import WordEncoder

D = "doc_id long, text string, length string, part string"


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(word_tokenizer())


def by_library(encoder, text):
    return encoder.library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(encoder):
    rng = random.Random(7)
    texts = ["it's we'll 'S ''ll", "x²y ½ ªº İstanbul ſ á <|endoftext|> b", None, "", " \t\n", "日本語 text", "a\x1cb\x85c", "ΑΣ ΑΣΑ"]
    texts += ["".join(rng.choice("'stremvld abcÀéß0²½\t\n .,!_-\xa0·×œŸĳŉſªº") for _ in range(30)) for _ in range(1500)]
    for t, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == by_library(encoder, t)


def test_pieces_and_places(spark, encoder):
    texts = ["a b c", None, "word " * 5000, "x", "x", ""]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(1, None, None, None)], D)
    got = packing.pack(df, word_tokenizer(), 2048).collect()
    ids = {i: [*by_library(encoder, t), 0] for i, t in enumerate(texts)}
    for r in got:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.start == r.piece * 2048 and len(own) == 4 * r.length and zlib.crc32(own) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, ids.values())) + 1
    check_places([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert len({r.sequence_id for r in got}) == 3
    assert packing.pack(df.limit(0), word_tokenizer()).count() == 0


def check_places(places, capacity):
    at = {}
    for s, o, n in sorted(places):
        assert at.get(s, 0) == o
        at[s] = o + n
    assert max(at.values(), default=0) <= capacity


def expand(plan, hist):
    left = dict(hist)
    runs = sorted(plan.runs)
    out = []
    for i, (length, rank, seq, each, offset) in enumerate(runs):
        after = runs[i + 1] if i + 1 < len(runs) and runs[i + 1][0] == length else None
        n = (after[1] if after else left[length]) - rank
        out += [(seq + t // each, offset + t % each * length, length) for t in range(n)]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole_and_close_to_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 50, 200])
    hist = {n: rng.randint(1, 30) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity // 2))}
    plan = packing.plan(hist, capacity)
    places = expand(plan, hist)
    assert sorted(n for *_, n in places) == sorted(n for n, k in hist.items() for _ in range(k))
    check_places(places, capacity)
    total = sum(n * k for n, k in hist.items())
    assert plan.sequences == len({s for s, *_ in places}) and plan.sequences <= 1.23 * -(-total // capacity) + sum(k for n, k in hist.items() if 2 * n > capacity)


def test_small_plans_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        capacity = 12
        items = sorted((rng.randint(1, capacity) for _ in range(7)), reverse=True)
        plan = packing.plan({n: items.count(n) for n in items}, capacity)
        assert plan.sequences <= optimum(items, capacity) + 1


def optimum(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_reduction_fixes_exact_fits_first():
    plan = packing.plan({7: 3, 3: 3, 5: 2}, 10)
    assert plan.sequences == 4 and plan.fixed == 4


def test_histogram_answers(spark, encoder):
    texts = ["a b c", None, "a", "a b", "a b", "x " * 700]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], D)
    hist = lengths.histogram(df, word_tokenizer())
    n = sorted(len(by_library(encoder, t)) for t in texts)
    assert sorted(map(tuple, hist.collect())) == sorted((x, n.count(x)) for x in set(n))
    answers = lengths.limits(hist, block=2)
    for r in answers.collect():
        x = r.context_limit
        assert r.docs_within == sum(v <= x for v in n) and r.docs_above == sum(v > x for v in n)
        assert r.truncated_tokens == sum(min(v, x) for v in n) and r.total_tokens == sum(n)
        assert r.tokens_above == sum(v for v in n if v > x)
    assert lengths.quantile(answers, 0.5) == n[2]
    assert lengths.truncated_total(hist, 100) == sum(min(v, 100) for v in n)
    assert lengths.limits(lengths.histogram(df.limit(0), word_tokenizer())).count() == 0
