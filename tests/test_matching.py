"""Scoring, templates, sampling and error curves on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeline.functions.columns import prepared, rounded, rounded_many, similarity
from probeline.operators import (
    blocks, comparisons, fusion, identification, moments, refined, scoring, splits, templates, verification,
)
from probeline.operators.comparisons import RankSpace
from probeline.operators.refined import RefinedComparison, decisions_at


@pytest.fixture(scope="module")
def vectors(spark):
    source = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}", [source.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    return spark.createDataFrame(rows, "id long, label string, vec array<double>").cache()


def brute(vectors):
    return {r["id"]: (r["label"], np.array(r["vec"])) for r in vectors.collect()}


@pytest.mark.parametrize("method", ["cosine", "euclidean", "manhattan", "pearson"])
def test_grid_equals_expression(vectors, method, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 20)
    grid = {(r["a_id"], r["b_id"]): r["score"] for r in scoring.grid_scores(vectors, None, method).collect()}
    assert set(grid) == set(itertools.combinations(range(90), 2))
    ready = vectors.select("id", prepared(F.col("vec"), method).alias("v"))
    pairs = ready.alias("a").join(ready.alias("b"), F.col("a.id") < F.col("b.id"))
    for r in pairs.select("a.id", F.col("b.id").alias("o"), similarity(F.col("a.v"), F.col("b.v"), method).alias("s")).collect():
        assert grid[(r["id"], r["o"])] == r["s"]  # bit for bit


def test_histogram_counts(vectors, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 20)
    total = scoring.score_histogram(vectors, None).agg(F.sum("n_genuine"), F.sum("n_impostor")).first()
    labels = [label for label, _ in brute(vectors).values()]
    genuine = sum(a == b for a, b in itertools.combinations(labels, 2))
    assert tuple(total) == (genuine, 90 * 89 // 2 - genuine)


def test_genuine_pairs_of_a_hot_label(vectors, monkeypatch):
    monkeypatch.setattr(comparisons, "PAIR_BLOCK_ROWS", 4)
    got = comparisons.genuine_pairs(vectors).select("a_id", "b_id").collect()
    known = brute(vectors)
    want = {(a, b) for a, b in itertools.combinations(range(90), 2) if known[a][0] == known[b][0]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_zero_and_constant_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    cosine = similarity(prepared(F.col("a"), "cosine"), prepared(F.col("b"), "cosine"), "cosine")
    pearson = similarity(prepared(F.col("a"), "pearson"), prepared(F.col("b"), "pearson"), "pearson")
    row = df.select(cosine.alias("c"), F.isnan(pearson).alias("p")).first()
    assert row["c"] == 0.0 and row["p"]
    with pytest.raises(ValueError):
        prepared(F.col("a"), "other")


def test_ties_rank_last(spark):
    rows = [(1, "a", "a", 0.9), (1, "b", "a", 0.9), (1, "c", "a", 0.7), (2, "a", "c", 0.1), (2, "b", "c", 0.2), (2, "c", "c", 0.3)]
    scores = spark.createDataFrame(rows, "probe_id long, identity string, true_identity string, score double")
    assert {r["probe_id"]: r["rank"] for r in identification.ranks_from_scores(scores).collect()} == {1: 2, 2: 1}


def test_duplicate_templates_tie(spark):
    gallery = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "c", [0.0, 1.0])], "id long, label string, vec array<double>")
    probes = spark.createDataFrame([(10, "a", [2.0, 1.0]), (11, "c", [0.1, 3.0])], "id long, label string, vec array<double>")
    ranks = identification.identification_ranks(probes, gallery).collect()
    assert {r["id"]: r["rank"] for r in ranks} == {10: 2, 11: 1}


def test_unknown_probe_is_an_error(spark):
    gallery = spark.createDataFrame([(1, "a", [1.0])], "id long, label string, vec array<double>")
    probes = spark.createDataFrame([(10, "z", [2.0])], "id long, label string, vec array<double>")
    with pytest.raises(Exception, match="not enrolled"):
        identification.identification_ranks(probes, gallery).collect()


def test_rank_5_needs_six_identities(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 5)], "id long, rank long")
    for size, wanted in ((5, None), (6, 1.0)):
        sizes = spark.createDataFrame([(size,)], "n_identities long")
        assert identification.headline_rates(ranks, sizes).first()["rank_5"] == wanted


@pytest.mark.parametrize("method", sorted(templates.FUSIONS))
def test_fusion_methods(vectors, method):
    known = brute(vectors)
    got = {r["label"]: np.array(r["vec"]) for r in templates.create_templates(vectors, method).collect()}
    for label, vec in got.items():
        rows = np.array([v for own, v in known.values() if own == label])
        if method == "mean":
            want = rows.mean(axis=0)
        elif method == "median":
            want = np.median(rows, axis=0)
        elif method == "trimmed_mean":
            cut = int(0.1 * len(rows))
            want = np.sort(rows, axis=0)[cut: len(rows) - cut].mean(axis=0)
        elif method == "geometric_median":
            # at the minimum no direction is left
            gaps = rows - vec
            pull = (gaps / np.linalg.norm(gaps, axis=1, keepdims=True)).mean(axis=0)
            assert np.linalg.norm(pull) < 1e-2
            continue
        else:
            unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            centrality = (unit @ unit.T).sum(axis=1) - 1
            if method == "representative":
                want = rows[np.argsort(-centrality)[: max(1, len(rows) // 2)]].mean(axis=0)
            else:
                w = np.exp((centrality - centrality.max()) / 0.1)
                want = w @ rows / w.sum()
        assert vec == pytest.approx(want)


def test_multi_templates_need_enough_rows(vectors):
    with pytest.raises(Exception, match="fewer rows"):
        templates.select_multi_templates(vectors, 200).collect()
    chosen = templates.select_multi_templates(vectors, 3)
    assert {r["count"] for r in chosen.groupBy("label").count().collect()} == {3}


def test_probe_groups(spark):
    rows = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(9)], "id long, block string")
    got = fusion.probe_groups(rows, ["block"], "id", 3).collect()
    assert {(r["id"], r["group_no"]) for r in got} == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1)}


def test_source_order_without_all_dates(spark):
    columns = (
        "subject string, obs_id long, acquisition_time date, acquisition_order long, record_id string, source_segment_order double, "
        "source_segment_id string, beat_ordinal long, rpeak_index long"
    )
    rows = spark.sql(
        "SELECT * FROM VALUES ('d', 1L, DATE '2020-02-01', 0L, 'r', 0D, 's', 0L, 5L), ('d', 2L, DATE '2020-01-01', 1L, 'r', 0D, 's', 0L, 5L), "
        "('u', 3L, DATE '2020-02-01', 0L, 'r', 0D, 's', 1L, -1L), ('u', 4L, CAST(NULL AS DATE), 1L, 'r', 0D, 's', 0L, 9L), "
        f"('u', 5L, DATE '2020-01-01', 0L, 'r', 0D, 's', 0L, 9L) t({', '.join(c.split()[0] for c in columns.split(', '))})"
    )
    got = {r["obs_id"]: r["source_no"] for r in fusion.source_order(rows, ["subject"]).collect()}
    assert got == {2: 1, 1: 2, 5: 1, 3: 2, 4: 3}


# --- sampling --------------------------------------------------------------------------------------


def test_one_set_sampling(vectors):
    known = brute(vectors)
    space = RankSpace(vectors)
    every = {p for p in itertools.combinations(range(90), 2)}
    genuine = {(a, b) for a, b in every if known[a][0] == known[b][0]}
    assert (space.universe, space.genuine, space.impostor) == (len(every), len(genuine), len(every) - len(genuine))
    pick = lambda df: [(r["a_id"], r["b_id"]) for r in df.collect()]
    assert set(pick(space.all_genuine())) == genuine
    assert set(pick(space.sample_impostors(10**6, 1))) == every - genuine  # below the cap: all
    some = pick(space.sample_impostors(100, 1))
    assert len(some) == len(set(some)) == 100 and set(some) <= every - genuine
    assert some and sorted(some) == sorted(pick(space.sample_impostors(100, 1)))
    assert sorted(some) != sorted(pick(space.sample_impostors(100, 2)))
    balanced = space.sample_balanced(200, 3).groupBy("is_genuine").count().collect()
    assert {r["is_genuine"]: r["count"] for r in balanced} == {0: 100, 1: 100}
    assert len(set(pick(space.sample_random(500, 3)))) == 500


def drawn(spark, universe, wanted, seed=1):
    return [r["rank"] for r in comparisons.draw_ranks(spark, universe, wanted, seed).orderBy(F.monotonically_increasing_id()).collect()]


@pytest.mark.parametrize("universe", [2, 3, 7, 64, 100, 1000, 4097])
def test_draws_are_a_permutation(spark, universe):
    nearly_all = comparisons.draw_ranks(spark, universe, universe - 1, 5).collect()
    ranks = {r["rank"] for r in nearly_all}
    assert len(ranks) == universe - 1 and ranks < set(range(universe))


def test_larger_draws_contain_smaller_ones(spark):
    for universe in (401, 10**12):
        small, large = (set(drawn(spark, universe, k)) for k in (100, 101))
        assert small < large and len(large) == 101
    assert set(drawn(spark, 400, 100)) != set(drawn(spark, 400, 100, seed=2))


def test_draws_are_even(spark):
    """Chi-square over 100 bins, and over the differences of consecutive draws."""
    ranks = drawn(spark, 10**6, 20_000)
    for values in (ranks, [(b - a) % 10**6 for a, b in zip(ranks, ranks[1:])]):
        counts = [0] * 100
        for r in values:
            counts[r // 10**4] += 1
        expected = len(values) / 100
        assert sum((c - expected) ** 2 / expected for c in counts) < 150  # 0.1 % of even draws lie beyond


def test_odd_balanced_budget_raises(vectors):
    with pytest.raises(ValueError, match="even"):
        RankSpace(vectors).sample_balanced(3, 1)


def test_two_set_sampling(spark, vectors):
    probes = vectors.where("id < 30").select("id", "label")
    gallery = spark.createDataFrame([(f"g{i}", lab) for i, lab in enumerate(["hot", "s1", "s2", "none"])], "id string, label string")
    space = RankSpace(probes, gallery)
    known = brute(vectors)
    labels = dict(zip([f"g{i}" for i in range(4)], ["hot", "s1", "s2", "none"]))
    genuine = {(p, g) for p in range(30) for g in labels if known[p][0] == labels[g]}
    got = {(r["a_id"], r["b_id"]) for r in space.all_genuine().collect()}
    assert got == genuine
    impostors = {(r["a_id"], r["b_id"]) for r in space.sample_impostors(10**6, 1).collect()}
    assert impostors == {(p, g) for p in range(30) for g in labels} - genuine


def test_replacement_only_if_too_small(vectors):
    space = RankSpace(vectors.where("id in (0, 3, 1, 2, 4, 7)").select("id", "label"))
    rows = space.sample_balanced(40, 5).groupBy("is_genuine").count().collect()
    assert {r["is_genuine"]: r["count"] for r in rows} == {0: 20, 1: 20}


@pytest.mark.parametrize("n", [2, 3, 50, 1 << 20])
def test_triangle_mapping(spark, n):
    size = n * (n - 1) // 2
    ranks = spark.range(0, size, max(1, size // 1000)).withColumnRenamed("id", "rank")
    i, j = comparisons.triangle_pair(F.col("rank"), F.lit(n).cast("bigint"))
    for r in ranks.select("rank", i.alias("i"), j.alias("j")).collect():
        assert 0 <= r["i"] < r["j"] < n
        assert r["i"] * (2 * n - r["i"] - 1) // 2 + r["j"] - r["i"] - 1 == r["rank"]


def test_triangle_mapping_of_a_plain_number(spark):
    """More rows than the square root of the largest integer, given as an integer."""
    n = 102_000
    row, size = F.col("i"), F.lit(n)
    ranked = spark.range(0, n - 1, 997).withColumnRenamed("id", "i").withColumn("rank", comparisons.triangle_rank(row, row + 1, size))
    i, j = comparisons.triangle_pair(F.col("rank"), size)
    assert ranked.where((i != row) | (j != row + 1)).count() == 0


def test_genuine_pairs_in_parts(spark, vectors, monkeypatch):
    """Pairs and scores within labels are spread over tasks, need no rank lookup and equal the expression."""
    monkeypatch.setattr(comparisons, "PAIR_BLOCK_ROWS", 4)
    monkeypatch.setattr(scoring, "SCORE_BLOCK_ROWS", 7)
    monkeypatch.setattr(comparisons, "interval_lookup", None)
    ready = vectors.select("id", "label", prepared(F.col("vec"), "cosine").alias("v"))
    pairs = ready.alias("a").join(ready.alias("b"), F.expr("a.id < b.id AND a.label = b.label"))
    score = similarity(F.col("a.v"), F.col("b.v"), "cosine")
    want = {(r[0], r[1]): r[2] for r in pairs.select("a.id", F.col("b.id").alias("o"), score).collect()}
    got = comparisons.score_genuine_pairs(vectors).collect()
    assert len(got) == len(want) and {(r["a_id"], r["b_id"]): r["score"] for r in got} == want
    alike = RankSpace(vectors.select("id", "label")).all_genuine()
    assert alike.rdd.getNumPartitions() > 60
    assert sorted((r["a_id"], r["b_id"]) for r in alike.where("is_genuine = 1").collect()) == sorted(want)


@pytest.mark.parametrize("method", ["cosine", "pearson"])
def test_readings_without_pairs(spark, vectors, monkeypatch, method):
    """Counts, problems and the separation equal those of all scores, though no pair is scored."""
    monkeypatch.setattr(moments, "GROUP_ROWS", 7)
    hist = scoring.score_histogram(vectors, None, method)
    want = verification.d_prime(hist).first()
    problems = verification.comparison_problems(scoring.grid_scores(vectors, None, method, "problems")).first()
    counts = hist.agg(F.sum("n_genuine"), F.sum("n_impostor")).first()
    other = vectors.where("id < 40")
    both = scoring.score_histogram(vectors, other, method).agg(F.sum("n_genuine"), F.sum("n_impostor")).first()
    monkeypatch.setattr(refined, "grid_scores", None)
    whole = RefinedComparison(vectors, method=method)
    assert tuple(whole.d_prime().first()) == pytest.approx(tuple(want), abs=1e-12)
    assert tuple(whole.pair_counts().first()) == tuple(counts)
    assert tuple(RefinedComparison(vectors, other, method).pair_counts().first()) == tuple(both)
    ready = vectors.select("id", "label", prepared(F.col("vec"), method).alias("vec"))
    assert verification.comparison_problems(moments.problem_counts(ready)).first() == problems
    broken = ready.withColumn("vec", F.when(F.col("id") < 3, F.array(F.lit(float("nan")))).otherwise(F.col("vec")))
    assert moments.problem_counts(broken).first()["n_not_finite"] == 90 * 89 // 2 - 87 * 86 // 2


def test_separation_of_equal_vectors(spark):
    """Without spread sums have no digits left; bins are used."""
    rows = [(i, i % 2, [1.0, 2.0] if i % 2 else [2.0, -1.0]) for i in range(20)]
    equal = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    assert moments.class_moments(equal.select("id", "label", prepared(F.col("vec"), "cosine").alias("vec"))) is None
    want = verification.d_prime(scoring.score_histogram(equal, None)).first()
    assert tuple(RefinedComparison(equal).d_prime().first()) == pytest.approx(tuple(want))


# --- curves ----------------------------------------------------------------------------------------


def decisions(spark, genuine, impostor):
    rows = [(s, 1) for s in genuine] + [(s, 0) for s in impostor]
    return verification.histogram(spark.createDataFrame(rows, "score double, is_genuine int"))


def test_separated_scores(spark):
    curve = verification.error_curve(decisions(spark, [0.9, 0.8], [0.1, 0.2]))
    summary = verification.curve_summary(curve).first()
    assert summary["eer"] == 0.0 and summary["auc"] == 1.0
    assert verification.calibration_threshold(curve).first()["threshold"] == 0.8


def test_interpolated_error_rate(spark):
    genuine, impostor = [0.9, 0.7, 0.4], [0.8, 0.5, 0.3, 0.2]
    curve = verification.error_curve(decisions(spark, genuine, impostor))
    # between thresholds 0.7 (FAR 1/4, FRR 1/3) and 0.5 (FAR 1/2, FRR 1/3)
    assert verification.curve_summary(curve).first()["eer"] == pytest.approx(1 / 3)
    wins = sum(g > i for g in genuine for i in impostor)
    assert verification.curve_summary(curve).first()["auc"] == pytest.approx(wins / 12)


def test_unresolvable_target_is_null(spark):
    curve = verification.error_curve(decisions(spark, [0.9, 0.7], [0.8, 0.1, 0.1]))
    points = {r["target_far"]: r for r in verification.operating_points(curve, [0.5]).collect()}
    assert set(points) == {0.5, 0.001}
    assert points[0.001]["tar_reported"] is None and points[0.001]["tar"] == 0.5
    assert points[0.5]["tar"] == 1.0 and points[0.5]["observed_far"] == pytest.approx(1 / 3)


def test_curves_per_run(spark):
    rows = [(1, 0.9, 1), (1, 0.1, 0), (2, 0.1, 1), (2, 0.9, 0)]
    hist = spark.createDataFrame(rows, "seed int, score double, g int").groupBy("seed", "score").agg(
        F.sum("g").alias("n_genuine"), F.sum(1 - F.col("g")).alias("n_impostor")
    )
    curve = verification.error_curve(hist, ["seed"])
    got = {r["seed"]: r["auc"] for r in verification.curve_summary(curve, ["seed"]).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_missing_class_gives_null(spark):
    curve = verification.error_curve(decisions(spark, [0.9], []))
    assert verification.curve_summary(curve).first()["eer"] is None


def test_frozen_threshold(spark):
    out = verification.apply_threshold(
        decisions(spark, [0.9, 0.3], [0.5, 0.1]), spark.createDataFrame([(0.5,)], "threshold double")
    ).first()
    assert (out["accuracy"], out["far"], out["frr"]) == (0.5, 0.5, 0.5)


def test_split_keeps_every_label_on_both_sides(vectors):
    out = splits.stratified_split(vectors, "label", "id", 0.3, 7)
    sides = out.groupBy("label").agg(F.count_distinct("role").alias("n")).collect()
    assert {r["n"] for r in sides} == {2}
    assert out.where("role = 'holdout'").count() == 27


def readings(curve, targets):
    points = sorted(map(tuple, verification.operating_points(curve, targets).collect()))
    return verification.curve_summary(curve).first()["eer"], points, verification.calibration_threshold(curve).first()["threshold"]


@pytest.mark.parametrize("method", ["euclidean", "cosine"])
def test_large_bins_are_binned_again(spark, monkeypatch, method):
    """Unbounded scores are measured; a far outlier leaves nearly all scores in one bin, many of them equal."""
    rng = random.Random(3)
    rows = [(k, "ab"[k % 2], [1.0 + k % 2 + rng.choice([0.0, 0.01 * rng.random()]), 1.0, 0.5]) for k in range(40)]
    rows += [(40, "a", [4000.0, -3.0, 1.0]), (41, "b", [-1.0, -900.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    passes = []
    original = scoring.grid_scores

    def watched(left, right, name, output, **options):
        passes.append(output)
        if output == "exact":
            passes.append(len(options["wanted"]))
        return original(left, right, name, output, **options)

    monkeypatch.setattr("probeline.operators.refined.grid_scores", watched)
    targets = [0.3, 0.05, 0.02]
    full = verification.error_curve(scoring.score_histogram(df, None, method))
    fast = RefinedComparison(df, method=method, bins=8, limit=12)
    assert readings(fast.curve(targets), targets) == readings(full, targets)
    assert passes.count("bins") > 2 and ("range" in passes) == (method == "euclidean")
    assert fast.area().first()["auc"] == pytest.approx(verification.curve_summary(full).first()["auc"], abs=1e-12)


def test_area_in_rounds(vectors, monkeypatch):
    """No round looks at more pairs than its share, and none is left out."""
    monkeypatch.setattr(refined, "ROUND", 1500)
    rounds, original = [], scoring.grid_scores

    def watched(left, right, name, output, **options):
        rounds.append(output)
        return original(left, right, name, output, **options)

    monkeypatch.setattr("probeline.operators.refined.grid_scores", watched)
    want = verification.curve_summary(verification.error_curve(scoring.score_histogram(vectors, None))).first()["auc"]
    assert RefinedComparison(vectors, bins=64, limit=1000).area().first()["auc"] == pytest.approx(want, abs=1e-12)
    assert rounds.count("exact") > 2


def test_area_of_one_class_and_of_none(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.5, 1.0])]
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    assert RefinedComparison(df).area().first()["auc"] is None
    assert RefinedComparison(df.limit(0), method="euclidean").area().first()["auc"] is None


def test_separation_of_close_scores(spark):
    """Spread far below the size of the scores: sums of squares would lose it."""
    rows = [(k, "ab"[k % 2], [1e6 * (k % 2) + 1e-3 * k]) for k in range(20)]
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    full = verification.d_prime(scoring.score_histogram(df, None, "manhattan")).first()
    fast = RefinedComparison(df, method="manhattan").d_prime().first()
    assert tuple(fast) == pytest.approx(tuple(full), rel=1e-6)


@pytest.mark.parametrize("whole", [1024, 6, 2])
def test_fused_scores(spark, vectors, monkeypatch, whole):
    """Means over groups and best templates, also where groups and identities are larger than a cell may hold."""
    monkeypatch.setattr(scoring, "WHOLE_ROWS", whole)
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 20)
    members = vectors.where("id < 60").select("id", F.concat(F.lit("g"), F.col("id") % 7).alias("group"), "vec")
    templates_ = vectors.where("id >= 60").select("id", F.col("label").alias("identity"), "vec")
    known = brute(vectors)
    unit = {k: [x / sum(y * y for y in v) ** 0.5 for x in v] for k, (_, v) in known.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(unit[a], unit[b]))
    wanted = {}
    for group in range(7):
        own = [k for k in range(60) if k % 7 == group]
        for t in range(60, 90):
            mean = sum(dot(k, t) for k in own) / len(own)
            key = (f"g{group}", known[t][0])
            wanted[key] = max(mean, wanted.get(key, -9))
    got = {(r["group"], r["identity"]): r["score"] for r in fusion.fused_scores(members, templates_).collect()}
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k]) for k in wanted)


@pytest.mark.parametrize("whole", [1024, 5])
def test_ranks_with_several_templates(vectors, monkeypatch, whole):
    monkeypatch.setattr(scoring, "WHOLE_ROWS", whole)
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 20)
    probes, gallery = vectors.where("id % 3 = 0"), vectors.where("id % 3 <> 0")
    known = brute(vectors)
    unit = {k: [x / sum(y * y for y in v) ** 0.5 for x in v] for k, (_, v) in known.items()}
    enrolled = {known[k][0] for k in known if k % 3}
    found = identification.identification_ranks(probes.where(F.col("label").isin(*enrolled)), gallery, one_template=False)
    for r in found.collect():
        best = {}
        for k in known:
            if k % 3:
                score = sum(x * y for x, y in zip(unit[r["id"]], unit[k]))
                best[known[k][0]] = max(score, best.get(known[k][0], -9))
        assert r["rank"] == sum(s >= best[r["label"]] - 1e-12 for s in best.values())


def test_problems_are_counted_in_cells(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [5.0, 5.0]), (3, "b", [1.0, 3.0])]  # a constant has no correlation
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    cells = scoring.grid_scores(df, None, "pearson", "problems")
    assert tuple(verification.comparison_problems(cells).first()) == (2, 0, 1, 2)


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_refined_readings_equal_the_full_curve(vectors, bins, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 20)
    targets = [0.3, 0.05, 0.02]
    full = verification.error_curve(scoring.score_histogram(vectors, None))
    fast = RefinedComparison(vectors, bins=bins).curve(targets)
    assert verification.curve_summary(fast).first()["eer"] == verification.curve_summary(full).first()["eer"]
    points = lambda c: sorted(map(tuple, verification.operating_points(c, targets).collect()))
    assert points(fast) == points(full)
    cut = verification.calibration_threshold(full).first()["threshold"]
    assert verification.calibration_threshold(fast).first()["threshold"] == cut
    one = vectors.sparkSession.createDataFrame([(cut,)], "threshold double")
    hist = scoring.score_histogram(vectors, None)
    assert verification.apply_threshold(decisions_at(vectors, None, cut), one).first() == verification.apply_threshold(hist, one).first()


@pytest.mark.parametrize("bins", [5, 64, 4096])
@pytest.mark.parametrize("labels", ["abc", None])
def test_quick_readings_score_few_pairs(spark, monkeypatch, bins, labels):
    """Copies, equal ids, unlabelled rows and scores on bin borders: the readings equal those of the full curve, though all
    passes are quick."""
    rng = random.Random(8)
    made = [[rng.choice([-1.0, 0.0, 1.0, rng.gauss(0, 1)]) for _ in range(4)] + [0.5] for _ in range(60)]
    known = lambda k: labels[k % len(labels)] if k % 7 else None
    name = lambda k: known(k) if labels else f"l{k}"
    rows = [(k - k % 2 if k < 6 else k, name(k), made[k % 50]) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    targets = [0.3, 0.05, 0.02]
    hist = scoring.score_histogram(df, None)
    full = verification.error_curve(hist)
    calls, original = [], scoring.grid_scores

    def watched(*args, **options):
        calls.append(options.get("quick", False))
        return original(*args, **options)

    monkeypatch.setattr("probeline.operators.refined.grid_scores", watched)
    monkeypatch.setattr(scoring, "QUICK_BLOCK_ROWS", 30)
    assert readings(RefinedComparison(df, bins=bins, limit=200).curve(targets), targets) == readings(full, targets)
    cut = verification.calibration_threshold(full).first()["threshold"]
    one = spark.createDataFrame([(cut,)], "threshold double")
    assert verification.apply_threshold(decisions_at(df, None, cut), one).first() == verification.apply_threshold(hist, one).first()
    assert calls and all(calls)


@pytest.mark.parametrize("output", ["pairs", "histogram", "count", "hits", "best", "bins"])
def test_sent_side_equals_the_grid(spark, vectors, output, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 15)
    left = vectors.where("id < 50").select((F.col("id") % 2).alias("seed"), "id", "label", "vec", F.lit(0.2).alias("bar"))
    right = vectors.where("id >= 40").select((F.col("id") % 2).alias("seed"), "id", "label", "vec")
    options = {"edges": (-1.0, 1.0, 9)} if output == "bins" else {}
    found = []
    for rows in (10**6, 0):
        monkeypatch.setattr(scoring, "SENT_ROWS", rows)
        out = scoring.grid_scores(left, right, output=output, by=["seed"], **options)
        if output == "best":
            out = out.groupBy("seed", "id").agg(F.min(F.struct(-F.col("score"), "label")).alias("b"))
        elif output == "hits":
            out = out.distinct()
        elif output == "count":
            out = out.groupBy("seed", "id").agg(F.sum("n_at_least"))
        elif output == "histogram":
            out = out.groupBy("seed", "score").agg(F.sum("n_genuine"), F.sum("n_impostor"))
        elif output == "bins":
            out = out.groupBy("seed", "bin").agg(F.sum("n_genuine"), F.sum("n_impostor"), F.min("lowest"))
        found.append(sorted(map(str, out.collect())))
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("one_template", [True, False])
def test_scores_that_are_not_finite_are_refused(spark, one_template):
    vectors = spark.createDataFrame([(1, 1, [1.0, 1.0, 1.0]), (2, 2, [1.0, 2.0, 0.0])], "id int, label int, vec array<double>")
    with pytest.raises(Exception, match="finite"):
        identification.identification_ranks(vectors, vectors, "pearson", one_template).collect()
    table = spark.createDataFrame([(1, 1, 1, float("nan")), (1, 2, 1, 0.5)], "probe_id int, identity int, true_identity int, score double")
    with pytest.raises(Exception, match="finite"):
        identification.ranks_from_scores(table).collect()


def test_rounding_of_many_rows(spark):
    source = random.Random(3)
    values = [source.uniform(-1, 1) for _ in range(2000)] + [(k + 0.5) / 1e6 - 1e-9 for k in range(-500, 500)]
    values += [k / 1e6 for k in range(-20, 20)] + [0.0, -0.0, 1e-9, -1e-9, 12345.6789012, -4e8, 1e300, math.nan, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", rounded("v").alias("a"), rounded_many("v").alias("b")).collect():
        assert str(r["a"]) == str(r["b"]), r["v"]


def test_all_pairs_are_made_without_copies_of_rows(vectors, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 20)
    for scored in (scoring.grid_scores(vectors, None), comparisons.score_genuine_pairs(vectors)):
        assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scoring.grid_scores(vectors, None).count() == 90 * 89 // 2


@pytest.mark.parametrize("most", [4, 16, 4096])
def test_label_scores_of_large_and_small_labels(spark, monkeypatch, most):
    source = random.Random(8)
    labels = ["hot"] * 60 + [f"s{i // 3}" for i in range(60)] + ["alone", None, None]
    rows = [(i, label, [source.gauss(0, 1) for _ in range(6)]) for i, label in enumerate(labels)]
    rows.append((0, "hot", rows[0][2]))  # equal ids are no pair
    rows.append((200, "zero", [0.0] * 6))
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    monkeypatch.setattr(blocks, "BLOCK_ROWS", most)
    monkeypatch.setattr(blocks, "SMALL_BLOCK_ROWS", 4)
    got = sorted((r["a_id"], r["b_id"], r["label"], r["score"]) for r in comparisons.score_genuine_pairs(df).collect())
    ready = df.where("label IS NOT NULL").select("id", "label", prepared(F.col("vec"), "cosine").alias("v"))
    joined = ready.alias("a").join(ready.alias("b"), (F.col("a.id") < F.col("b.id")) & (F.col("a.label") == F.col("b.label")))
    score = similarity(F.col("a.v"), F.col("b.v"), "cosine")
    assert got == sorted(tuple(r) for r in joined.select("a.id", "b.id", "a.label", score).collect())


def test_scores_of_no_rows(spark):
    none = spark.createDataFrame([], "id long, label string, vec array<double>")
    assert scoring.grid_scores(none, None).count() == comparisons.score_genuine_pairs(none).count() == 0


def _curve_rows(curve):
    return sorted(tuple(r) for r in curve.select("threshold", "far", "tar", "frr", "far_before", "n_genuine", "n_impostor", "genuine").collect())


@pytest.mark.parametrize("held, labels", [(1 << 20, 4), (64, 4), (4, 4), (300, 40), (64, 1)])
def test_full_curve_in_ranges(spark, monkeypatch, held, labels):
    source = random.Random(12)
    rows = [(i, f"s{source.randrange(labels)}", [source.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(200, "s0", [0.0] * 6), (201, "s1", [0.0] * 6), (202, None, rows[3][2])]
    rows += [(5, *rows[5][1:])]  # equal ids are no pair
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    want = _curve_rows(verification.error_curve(scoring.score_histogram(df, None)))
    for module, name, value in ((blocks, "BLOCK_ROWS", 30), (blocks, "SMALL_BLOCK_ROWS", 8), (blocks, "TILE", (16, 8)), (blocks, "SENT_PAIRS", 25)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(blocks, "HELD_SCORES", held)
    monkeypatch.setattr(refined, "RANGE", 900)
    monkeypatch.setattr(refined, "LEAST_RANGE", 400)
    assert _curve_rows(RefinedComparison(df).full_curve()) == want


def test_full_curve_of_few_rows_and_of_distances(spark, vectors):
    for rows in ([], [(1, "a", [1.0, 0.0])]):
        df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
        assert RefinedComparison(df).full_curve().count() == 0
    want = _curve_rows(verification.error_curve(scoring.score_histogram(vectors, None, "euclidean")))
    assert _curve_rows(RefinedComparison(vectors, method="euclidean").full_curve()) == want


def test_curve_queries_neither_shuffle_nor_store_scores(spark):
    from probeline.plans import verification as plans

    plan = plans.curve(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ExistingRDD" not in plan


@pytest.mark.parametrize("digits, bins, sums", [(3, 1 << 24, 0), (6, 64, 1)])
def test_area_to_some_digits(spark, monkeypatch, digits, bins, sums):
    """Equal to the area of the full curve, from counts of fine bins alone where these decide the last digit."""
    source = random.Random(21)
    rows = [(i, f"s{i % 4}", [source.gauss(i % 4, 1.5) for _ in range(6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    want = verification.curve_summary(verification.error_curve(scoring.score_histogram(df, None))).first()["auc"]
    for module, name, value in ((blocks, "BLOCK_ROWS", 30), (blocks, "SMALL_BLOCK_ROWS", 8), (blocks, "TILE", (16, 8)), (blocks, "COUNTED_PAIRS", 1000), (blocks, "CHUNK_BINS", 512)):
        monkeypatch.setattr(module, name, value)
    for name, value in (("FINE_BINS", bins), ("FINE_BINS_OF_ALL_TASKS", 1), ("RANGE", 900), ("LEAST_RANGE", 400)):
        monkeypatch.setattr(refined, name, value)
    summed, original = [], blocks.points
    monkeypatch.setattr(blocks, "points", lambda *args: summed.append(1) or original(*args))
    comparison = RefinedComparison(df)
    assert comparison.area_to(digits).select(rounded("auc", digits)).first()[0] == rounded_auc(want, digits)
    won, left = blocks.fine_area(comparison._stored, spark, refined.BOUNDED, comparison._fine_steps(), 6)
    g, i = comparison._class_sizes
    assert won <= want * g * i + 1e-6 and want * g * i <= won + left + 1e-6
    assert len(summed) == sums


def rounded_auc(value, digits=6):
    return math.floor((value + 10.0 ** -(digits + 3)) * 10**digits + 0.5) / 10**digits


def test_area_to_some_digits_of_equal_scores(spark):
    """Equal scores of both classes count half, repeated rows and unlabelled ones included."""
    source = random.Random(22)
    rows = [(i, f"s{i % 3}", [source.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, f"s{i % 2}", rows[i][2]) for i in range(30)] + [(200, "s0", [0.0] * 6), (201, None, rows[3][2]), (5, *rows[5][1:])]
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    want = verification.curve_summary(verification.error_curve(scoring.score_histogram(df, None))).first()["auc"]
    assert RefinedComparison(df).area_to(6).select(rounded("auc")).first()[0] == rounded_auc(want)
    one = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.5, 1.0])], "id long, label string, vec array<double>")
    assert RefinedComparison(one).area_to(6).first()["auc"] is None
    assert RefinedComparison(one.limit(0)).area_to(6).first()["auc"] is None
