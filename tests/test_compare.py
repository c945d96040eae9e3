import math

import pytest

from starling.operators import funnel, partition, stats

P = "resolution double, name string, type string, community long"


def part(spark, labels, kind="u"):
    return spark.createDataFrame([(0.1, f"n{i}", kind, c) for i, c in enumerate(labels)], P)


def test_similarity_of_a_small_table(spark):
    r = partition.similarity(part(spark, [0, 0, 0, 1, 1]), part(spark, [0, 0, 1, 1, 1])).first()
    assert r.nmi == pytest.approx(0.4325381, abs=1e-6)
    assert r.ari == pytest.approx(0.1666667, abs=1e-6)
    assert r.vi_nats == pytest.approx(0.7638170, abs=1e-6)
    assert r.vi_bits == pytest.approx(0.7638170 / math.log(2), abs=1e-5)
    assert r.vi_mixed == pytest.approx(1.3596949, abs=1e-6)


def test_equal_partitions(spark):
    a = part(spark, [0, 0, 1, 2, 2])
    r = partition.similarity(a, a).first()
    assert (r.nmi, r.ari, r.vi_nats) == (pytest.approx(1), pytest.approx(1), pytest.approx(0, abs=1e-12))
    one = part(spark, [3, 3, 3])
    r = partition.similarity(one, one).first()
    assert (r.nmi, r.ari) == (1.0, 1.0)


def test_noise_can_be_left_out(spark):
    a, b = part(spark, [-1, -1, 0, 1]), part(spark, [0, 1, 0, 1])
    assert partition.similarity(a, b, exclude_noise=True).first().n_common == 2


def test_best_jaccard(spark):
    a = spark.createDataFrame([(0.1, n, "u", 0) for n in "123"], P)
    b = spark.createDataFrame([(0.1, n, "u", 1) for n in "234"] + [(0.1, "9", "u", 2)], P)
    (r,) = partition.best_matches(a, b).collect()
    assert (r.b_comm, r.jaccard) == (1, 0.5)
    assert partition.best_matches(b, a, 3).count() == 1


@pytest.mark.parametrize(("values", "expected"), [([1, 1, 1, 1], 0.0), ([0, 0, 0, 4], 0.75), ([0, 0], 0.0)])
def test_gini(spark, values, expected):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert stats.gini(df, "x").first().gini == pytest.approx(expected)


@pytest.mark.parametrize(("counts", "entropy", "share"), [([4], 0, 1), ([1, 1], 1, 0.5), ([3, 1], 0.8112781, 0.75)])
def test_entropy(spark, counts, entropy, share):
    df = spark.createDataFrame([(0, "u", f"t{i}", w) for i, w in enumerate(counts)], "community long, name string, tag string, weight long")
    r = stats.tag_entropy(df).first()
    assert (r.entropy, r.dominant_share) == (pytest.approx(entropy, abs=1e-6), share)


def test_ei_index_and_coverage(spark):
    e = spark.createDataFrame([("a", "b", 2), ("a", "c", 1)], "src string, dst string, weight long")
    labels = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2)], "name string, community long")
    got = {r.community: (r.internal_weight, r.external_weight, r.ei_index) for r in stats.ei_index(e, labels).collect()}
    assert got == {0: (4, 1, -0.6), 1: (0, 1, 1.0), 2: (0, 0, 0.0)}
    assert stats.coverage(e, labels).first().coverage == pytest.approx(2 / 3)


def test_size_cdf_keeps_ranks_of_ties(spark):
    df = spark.createDataFrame([(1,), (1,), (5,)], "size long")
    assert [round(r[2], 6) for r in stats.size_cdf(df, "size").orderBy("rank").collect()] == [0.333333, 0.666667, 1.0]


def test_funnel_thresholds_are_strict(spark):
    m = spark.createDataFrame([(0, 5, 0, 5, 0.4, 0.1), (1, 5, 1, 5, 0.9, 0.1)], "source_comm_id long, source_comm_size long, best_target_comm_id long, best_target_comm_size long, best_jaccard_score double, resolution double")
    e = spark.createDataFrame([(0.1, 0, 0.1), (0.1, 1, 0.2), (0.1, 2, 0.9), (0.1, 3, 0.95)], "resolution double, community long, entropy double")
    assert [r.source_comm_id for r in funnel.echo_chambers(m, e, e, 0.4, 0.5).collect()] == [1]


def test_wide_and_long(spark):
    m = spark.createDataFrame([(0.1, "a", "u", 4), (0.2, "a", "u", 5), (0.1, "b", "h", 6)], P)
    w = partition.wide(m, [0.1, 0.2])
    assert sorted(map(tuple, w.collect())) == [("a", "u", "4", "5"), ("b", "h", "6", "null")]
    assert sorted(map(tuple, partition.long(w).collect())) == sorted((r[0], r[1], r[2], r[3]) for r in m.collect())
