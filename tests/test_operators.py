"""Operators on small hand-made tables."""

import hashlib
import json
import math
import tarfile
import tracemalloc
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from siftwell.functions.numeric import minmax, safe_float, unit
from siftwell.operators import audits, clusters, episodes, greedy, labels, learning, metrics, neighbors, ranking, reports, representations, scores, timeseries, tokens
from siftwell.operators.timeseries import CHANNELS
from siftwell.plans import benchmark, select
from siftwell.sources import readers


def wave(spark, clips, n=400, bias=0.0):
    rows = []
    for c in range(clips):
        t = np.arange(n) / 30
        x = np.stack([np.sin(t * (c + 1)), np.cos(t), np.sin(2 * t) + 9.81, 0.3 * np.cos(t * 3), 0.2 * np.sin(t), 0.1 * np.cos(t * (c + 2))], 1)
        x[:, 0] += bias
        rows += [(c, i, float(t[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "clip long, idx int, ts double, " + ", ".join(f"{c} double" for c in CHANNELS))


def vectors(spark, rows):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in rows], "id long, v array<double>")


def test_numbers_that_are_not(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, float("nan")), (4, float("inf")), (5, None), (6, float("-inf"))], "id int, x double")
    got = {r.id: r.m for r in df.select("id", minmax(F.col("x")).alias("m")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}
    text = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "s string").select(safe_float(F.col("s"), 7).alias("v")).collect()
    assert [r.v for r in text] == [1.5, 7, 7, 7]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.m for r in flat.select(minmax(F.col("x"), None, "clip").alias("m")).collect()] == [1, 1]
    assert spark.range(1).select(unit(F.array(F.lit(0.0), F.lit(0.0))).alias("u")).first().u == [0, 0]


def test_exact_neighbours_with_ties(spark):
    support, query = vectors(spark, [(0, [1, 0]), (1, [0, 1]), (2, [-1, 0])]), vectors(spark, [(0, [0.9, 0.1]), (1, [0, -2])])
    got = neighbors.knn_join(query, support, 2, block=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.ref_id) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 2)]
    slow = neighbors.cosine_pairs(query, support, F.lit(True)).collect()
    fast = {(r.query_id, r.ref_id): r.distance for r in neighbors.knn_join(query, support, 3).collect()}
    assert all(abs(fast[r.query_id, r.ref_id] - r.distance) < 1e-12 for r in slow)
    assert neighbors.nearest_distance(query, support.limit(0)).first().distance == float("inf")


def test_components_and_medoids(spark):
    rows = vectors(spark, [(5, [1, 0]), (1, [1, 0.01]), (3, [0, 1]), (2, [0.01, 1]), (9, [-1, -1])])
    got = {r.id: (r.cluster, r.cluster_size) for r in clusters.components(rows, 0.99).collect()}
    assert got == {1: (0, 2), 5: (0, 2), 2: (1, 2), 3: (1, 2), 9: (2, 1)}
    m = clusters.medoids(rows.filter("id in (1, 5)").unionByName(vectors(spark, [(7, [1, 0.2])])).withColumn("cluster", F.lit(0)))
    assert {r.medoid_id for r in m.collect()} == {1}


def test_caps_and_orders(spark):
    rows = spark.createDataFrame([(i, i % 2, 1 - i / 10, True) for i in range(6)], "id long, g int, quality double, ok boolean")
    order = ranking.quality_order(rows)
    got = [r.id for r in ranking.capped_order(order, "g", 1, F.col("ok")).orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4, 5]
    capped = ranking.capped_order(ranking.quality_order(rows.withColumn("g", F.lit(1))), "g", 2, F.col("id") != 0).orderBy("rank")
    assert [r.id for r in capped.collect()] == [1, 2, 0, 3, 4, 5]
    assert [r.n for r in rows.select(ranking.failing({"q": F.col("quality") > 0.7, "g": F.col("g") == 0}).alias("n")).collect()] == ["", "g", "", "q,g", "q", "q,g"]
    falling = ranking.monotone_scores(order.withColumn("s", F.lit(0.5)), "s", 0.01).orderBy("rank").collect()
    assert all(a.submitted > b.submitted for a, b in zip(falling, falling[1:]))


def batch(spark, rows):
    return spark.createDataFrame([(0, i, list(map(float, v)), q, s, c, d, e) for i, v, q, s, c, d, e in rows], "batch long, id long, v array<double>, quality double, score double, cluster int, support_distance double, eligible boolean")


def test_greedy_selections(spark):
    rows = batch(spark, [(1, [1, 0], 0.9, 0.9, 1, 0.5, True), (2, [1, 0.05], 0.8, 0.88, 1, 0.5, True), (3, [0, 1], 0.7, 0.7, 2, 0.9, True), (4, [-1, 0], 0.6, 0.2, 3, 0.9, False)])
    ids = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert ids(greedy.mmr(rows, 0.5)) == [1, 3, 2, 4]
    assert ids(greedy.k_center(rows)) == [3, 1, 2, 4]
    assert ids(greedy.cluster_capped(rows, [(3, 1)], 0.0, 0.0)) == [1, 3, 4, 2]
    assert sorted(ids(greedy.cover_gap(rows, 0.3))) == [1, 2, 3, 4]
    two = greedy.blended_k_center(rows.withColumn("w", F.col("v")).withColumn("support_distance_w", F.col("support_distance")))
    assert ids(two)[:2] == [3, 1]
    targets = spark.createDataFrame([(0, 10, [0.0, 1.0], 1.0), (0, 11, [1.0, 0.0], 0.4)], "batch long, id long, v array<double>, before double")
    assert ids(greedy.oracle_greedy(rows, targets, 2)) == [3, 1] and sorted(ids(greedy.oracle_exact(rows, targets, 2))) == [1, 3]
    with pytest.raises(ValueError):
        greedy.cluster_capped(rows, [(5, 1), (5, 2)])


def test_quality_of_clean_and_broken_series(spark):
    clean = wave(spark, 2)
    q = {r.clip: r for r in timeseries.quality_features(clean).collect()}
    bad = timeseries.quality_features(timeseries.corrupted(clean, "spike")).collect()
    flat = timeseries.quality_features(timeseries.corrupted(clean, "flatline")).collect()
    assert q[0].quality_score > 0.95 and all(b.quality_score < q[0].quality_score for b in [*bad, *flat])
    holes = clean.withColumn("acc_x", F.when(F.col("idx") % 4 == 0, float("nan")).otherwise(F.col("acc_x")))
    assert timeseries.quality_features(holes).first().nan_fraction == pytest.approx(0.25 / 6)


def test_windows_match_the_grouped_kernel(spark):
    s = wave(spark, 2, 700)
    got = {(r.clip, r.window_idx): r.f for r in timeseries.window_features(s).collect()}
    assert len(got) == 2 * 4 and all(len(f) == 75 for f in got.values())
    stats = timeseries.distribution_stats(timeseries.windows(timeseries.invariants(s).select("clip", "idx", "acc_norm")), ["clip", "window_idx"], "acc_norm").collect()
    for r in stats:
        assert np.allclose(got[r.clip, r.window_idx][:10], [r["mean"], r["std"], r["rms"], r["min"], r["max"], r["p5"], r["p25"], r["p50"], r["p75"], r["p95"]], atol=1e-4)
    # the spectral part against a plain Fourier sum
    x = np.sin(np.arange(30) * 0.7) + 0.1 * np.arange(30)
    k = np.arange(1, 16)[:, None] * np.arange(30)[None, :]
    power = np.abs((np.exp(-2j * np.pi * k / 30) * (x - x.mean())).sum(1)) ** 2
    assert timeseries.spectrum(x, 30.0)[0] == pytest.approx(power.sum() / 30)


def test_phrases(spark):
    rows = [(s, p, t) for s, x in enumerate([[17, 17, 42, 91, 8, 8, 8, 8], [17, 17, 42, 91, 8, 8, 8, 8], [17, 17, 42, 91, 31, 12]]) for p, t in enumerate(x)]
    df = spark.createDataFrame(rows, "seq long, pos int, token int")
    mined = tokens.mine_phrases(df, 10, 4)
    assert mined.orderBy("rank").first().phrase == [17, 17, 42, 91]
    encoded = tokens.encode_phrases(df, mined).orderBy("seq", "pos").collect()
    assert encoded[0].phrase == [17, 17, 42, 91] and sum(len(r.phrase) for r in encoded) == len(rows)
    short = spark.createDataFrame([(0, i, "a") for i in range(3)], "clip long, window_idx int, x string").withColumn("f", F.array(F.col("window_idx").cast("double")))
    assert [r.v for r in tokens.patches(short, 2).orderBy("patch_idx").collect()] == [[0, 1], [1, 2]]


def test_learning(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 5
    df = spark.createDataFrame([(*map(float, a), float(b), int(b > 5)) for a, b in zip(x, y)], "a double, b double, y double, label int")
    model = learning.fit_ridge(df, ["a", "b"], "y", 1e-9)
    assert df.select(F.max(F.abs(model.score() - F.col("y")))).first()[0] < 1e-6
    ranker = learning.fit_centroid_ranker(df.withColumnRenamed("label", "good"), ["a", "b"], "good")
    assert df.select(F.avg(((ranker.score() > 0) == (F.col("label") == 1)).cast("int"))).first()[0] > 0.9
    with pytest.raises(ValueError):
        learning.check_features(df, ["label"])
    v = df.select(F.array("a", "b").alias("v"))
    assert learning.pca_error(v, v, 2) < 1e-9 and 1.5 < learning.effective_rank(v) <= 2.0001


def test_episodes_and_audits(spark):
    g = spark.createDataFrame([(f"g{i}", f"f{i % 3}") for i in range(9)], "group string, family string")
    e = episodes.source_blocked(g, 3, 2, 3)
    assert episodes.check_episodes(e).count() == 0
    assert episodes.check_episodes(e.filter("role <> 'target'")).count() == 3
    assert {r.fault for r in episodes.check_episodes(e.unionByName(e.filter("role = 'target'").withColumn("role", F.lit("support")))).collect()} != set()
    ranked = spark.createDataFrame([(1, 1, 0.5), (2, 2, 0.6), (2, 4, 0.1)], "id long, rank int, score double")
    f = audits.ranking_faults(ranked).first()
    assert (f.contiguous, f.non_increasing, f.duplicate_ids) == (False, False, 1)
    with pytest.raises(ValueError):
        audits.disjoint(spark.createDataFrame([(1, "a"), (1, "b")], "id long, split string"))


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, 1, 2, 1, False), (1, 2, 0, 1, True), (1, 3, 1, 2, False)], "run int, rank int, label int, cluster int, corrupted boolean")
    m = metrics.ranking_metrics(rows, 2, ["run"]).first()
    assert m.precision == 0.5 and m.average_precision == 0.5 and m.corruption_rate == 0.5 and m.cluster_diversity == 1
    assert m.ndcg == pytest.approx(3 / (3 + 1 / np.log2(3)))


def test_sources(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# head\nhttps://h/worker7/a.jsonl \n\nhttps://h/x/b.tar.gz?k=1\n")
    m = readers.line_manifest(spark, str(tmp_path / "urls.txt")).orderBy("pos").collect()
    assert [r.worker for r in m] == ["worker7", "h:b.tar"] and [r.pos for r in m] == [0, 1]
    records = [{"t_us": 1_000_000 * i, "acc": [i, 1, 2], "gyro": [3, 4, 5]} for i in range(3)] + [{"timestamp": 9.0, "a\u0000cc": [7, 8, 9], "gyro": [0, 0, 1]}, {**{c: 1.5 for c in CHANNELS}}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, records)) + "\n\nnot json\n")
    s = readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("idx").collect()
    assert [r.acc_x for r in s] == [0, 1, 2, 7, 1.5] and [r.ts for r in s][:4] == [0, 1, 2, 9]
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), max_samples=2).count() == 2
    (tmp_path / "w.csv").write_text("Time,ACC_X,acc_y,acc_z,gyro_x,gyro_y,GYRO_Z\n0.1,1,2,3,4,5,6\n")
    assert readers.read_worker_csv(spark, str(tmp_path / "w.csv")).first().gyro_z == 6
    (tmp_path / "m.csv").write_text("sample_id,path\n,/d/one.jsonl\ntwo,/d/x.jsonl\n")
    assert sorted(r.id for r in readers.csv_manifest(spark, str(tmp_path / "m.csv")).collect()) == ["one", "two"]
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        t.add(tmp_path / "m.csv", "inner/m.csv")
    assert readers.tar_members(spark, str(tmp_path / "t.tar")).first().member == "inner/m.csv"
    e = vectors(spark, [(1, [1, 2]), (2, [3, 4])]).withColumn("view", F.lit("window"))
    readers.write_embeddings(e, str(tmp_path / "e"))
    assert readers.read_embeddings(spark, str(tmp_path / "e"), "window", e.limit(1)).count() == 1
    t = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], "seq string, pos int, token string")
    readers.write_tokens(t, str(tmp_path / "tok"))
    assert readers.read_tokens(spark, str(tmp_path / "tok")).orderBy("pos").collect() == t.orderBy("pos").collect()
    rows = spark.createDataFrame([(1, "k1", "zz"), (2, "no", "k2"), (3, "no", "no")], "id long, a string, b string")
    feats = spark.createDataFrame([("k1", 0.5), ("k2", 0.7)], "id string, nll double")
    assert {r.id: (r.has_grammar, r.nll) for r in readers.join_by_keys(rows, ["a", "b"], feats).collect()} == {1: (True, 0.5), 2: (True, 0.7), 3: (False, None)}


def test_selection_end_to_end(spark):
    support, own = wave(spark, 4), wave(spark, 3).withColumn("clip", F.col("clip") + 2).unionByName(wave(spark, 1, bias=80).withColumn("clip", F.lit(50).cast("long")))
    got = select.select(support, own).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4] and got[-1].clip == "50" and not got[-1].passed


def test_benchmark_facts(spark):
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, i % 6, r.normal(size=4).tolist(), float(r.random()), 0.5, i % 3) for i in range(60)], "id long, group long, v array<double>, quality double, score double, cluster int")
    members = episodes.source_blocked(rows.select("group").distinct(), 2, 1, 2)
    facts = benchmark.run(rows, members, ["quality_only", "kcenter_quality_gated", "random_valid_replay_3"], [3, 500], F.lit(True)).collect()
    assert len(facts) == 12 and all(f.mean_after <= f.mean_before + 1e-12 for f in facts) and {f.underfilled for f in facts if f.budget == 500} == {True}
    with pytest.raises(ValueError):
        benchmark.policy("nonsense")


def test_scores_fall_for_lone_still_clips(spark):
    rows = spark.createDataFrame([(1, 0.9, 1.0, 0.0, 0.95), (2, 0.9, 0.2, 1.0, 0.1)], "id long, quality double, novelty double, density double, stationary double")
    got = {r.id: r for r in scores.stationary_guard(scores.scored(rows)).collect()}
    assert got[1].guarded and got[1].final_score < got[1].unguarded_score and not got[2].guarded


def test_split_clusters_are_rebalanced_and_numbered(spark):
    """Parts of at most eight where there is room, numbered by their best member; nothing is lost."""
    r = np.random.default_rng(6)
    rows = [(i, i % 2, (r.normal(size=3) + (5 if i % 9 == 0 else 0)).tolist(), float(r.random())) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, cluster long, v array<double>, s double")
    got = {x.id: (x.cluster, x.child) for x in clusters.split_large(df, 20, 8, child_most=8, score="s").collect()}
    assert set(got) == set(range(90)) and all(got[i][0] == i % 2 for i in got)
    for c in (0, 1):
        parts = {k: [i for i in got if got[i] == (c, k)] for k in {got[i][1] for i in got if got[i][0] == c}}
        assert sorted(parts) == list(range(len(parts))) and max(map(len, parts.values())) <= 8
        best = [max(rows[i][3] for i in parts[k]) for k in sorted(parts)]
        assert best == sorted(best, reverse=True)


def test_ridge_keeps_its_digits_far_from_zero(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=400)
    df = spark.createDataFrame([(float(1e8 + a), float(3 * a + 7)) for a in x], "x double, y double")
    model = learning.fit_ridge(df, ["x"], "y", 1e-6)
    assert abs(model.weights[0] / model.scale[0] - 3) < 1e-4 and abs(model.bias - (3 * x.mean() + 7)) < 1e-4


def test_late_events_are_left_out(spark, tmp_path):
    """A day that the watermark has passed takes no more events."""
    from siftwell.streaming.gate import gate_counts

    source = tmp_path / "in"
    schema = "ts timestamp, event_type string, value double"

    def put(name, rows):
        spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) as ts", "event_type", "value").coalesce(1).write.mode("append").parquet(str(source))

    put("a", [("2024-01-01 10:00:00", "x", 1.0), ("2024-01-10 10:00:00", "x", 99.0)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = gate_counts(stream).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        put("b", [("2024-01-01 11:00:00", "x", 1.0), ("2024-01-20 10:00:00", "x", 1.0)])
        query.processAllAvailable()
        put("c", [("2024-01-30 10:00:00", "x", 1.0)])
        query.processAllAvailable()
        got = {str(r.day)[:10]: (r.n, r.passed) for r in spark.table("late").collect()}
    finally:
        query.stop()
    assert got["2024-01-01"] == (1, 1) and got["2024-01-10"] == (1, 0)


def test_encoded_means_are_exact(spark):
    """Each mean of a clip and its quarters is the rational mean of the same doubles, rounded once; infinities stay what nan_to_num makes of them."""
    r = np.random.default_rng(3)
    rows = [(c, i, i / 30, *(float(k) / 100 * 7 for k in r.integers(-500, 500, 6))) for c in range(4) for i in range(160)]
    rows += [(9, i, i / 30, float("inf") if i == 3 else 1.0, *(float(k) for k in r.integers(0, 9, 5))) for i in range(40)]
    df = spark.createDataFrame(rows, "clip long, idx int, ts double, " + ", ".join(f"{c} double" for c in CHANNELS))
    names = CHANNELS + timeseries.DERIVED
    got = {x.clip: x.v for x in representations.handcrafted(df).collect()}
    same = timeseries.preprocess(df).toPandas().sort_values(["clip", "idx"])
    for clip in range(4):
        x = same[same["clip"] == clip][names].to_numpy(float)
        for part, p in enumerate([x, *np.array_split(x, 4)]):
            for c in range(12):
                exact = sum(map(Fraction, p[:, c].tolist())) / len(p)
                assert got[clip][part * 72 + c] == float(exact)
    assert len(got[9]) == 512 and all(map(math.isfinite, got[9])) and got[9][0] == np.finfo(float).max


def below(df, node):
    """The lines under each such node of a plan that has run."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if node in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i + 1 : end])


def test_draws_of_a_bootstrap_are_not_broadcast(spark):
    rows = [(p, u, u % 7 / 7 + (p == "a")) for p in "abc" for u in range(60 + 10 * (p == "b"))]
    facts = spark.createDataFrame(rows, "policy string, unit long, value double")
    out = metrics.bootstrap_interval(facts, ["policy"], "unit", "value", 30)
    assert not any("Generate explode" in x for x in below(out, "BroadcastExchange"))
    got = {r.policy: r for r in out.collect()}
    for p in "abc":
        x = [v for q, _, v in rows if q == p]
        draw = lambda r, at: min(int(int(hashlib.sha256(f"{r}:{at}".encode()).hexdigest()[:12], 16) / 0xFFFFFFFFFFFF * len(x)), len(x) - 1)
        means = [np.mean([x[draw(r, at)] for at in range(1, len(x) + 1)]) for r in range(1, 31)]
        assert got[p].n == len(x) and abs(got[p].mean - np.mean(x)) < 1e-12
        assert np.allclose([got[p].low, got[p].high], np.quantile(means, [0.025, 0.975]), atol=1e-12)


def test_neighbours_meet_in_chunks_of_a_strip_at_a_time(spark, monkeypatch):
    """Many blocks to a chunk, ties across blocks, repeated ids left out: as by plain sorting; an equal result from small and from large chunks."""
    r = np.random.default_rng(11)
    x = r.integers(-2, 3, (90, 3)).astype(float)
    rows = vectors(spark, [(int(i * 7 % 90), v) for i, v in enumerate(x)])
    by_id = {int(i * 7 % 90): v for i, v in enumerate(x)}
    for chunk, pairs in ((1, 256), (8, 1)):
        monkeypatch.setattr(neighbors, "_CHUNK", chunk), monkeypatch.setattr(neighbors, "_PAIRS", pairs), monkeypatch.setattr(neighbors, "_STRIP", 100)
        got = neighbors.knn_join(rows, rows, 4, "euclidean", True, block=9).orderBy("query_id", "rank").collect()
        for i in by_id:
            want = sorted((round(float(np.sqrt(((by_id[i] - by_id[j]) ** 2).sum())), 9), j) for j in by_id if j != i)[:4]
            assert [(round(g.distance, 9), g.ref_id) for g in got if g.query_id == i] == want
        split = clusters.components(rows.filter("exists(v, x -> x <> 0)"), 0.95).collect()
        if chunk == 1:
            first = {(c.id, c.cluster, c.cluster_size) for c in split}
        assert {(c.id, c.cluster, c.cluster_size) for c in split} == first
    one = rows.select(F.lit(0).cast("long").alias("batch"), "id", "v")
    seen = neighbors.chunk_pairs(one, one, lambda b, left, right, same: pa.table({"n": [len(left) * len(right)], "m": [sum(len(p[0]) for p in left)]}), "n long, m long", 9).collect()
    assert all(s.n <= 64 for s in seen) and sum(s.m for s in seen) >= 90


def test_places_of_the_smallest(spark):
    r = np.random.default_rng(12)
    for d in (r.integers(0, 4, (150, 40)).astype(float), np.zeros((70, 9)), np.where(r.random((50, 30)) < 0.5, np.inf, r.random((50, 30)))):
        assert (neighbors._smallest(d, 5) == np.argsort(d, axis=1, kind="stable")[:, :5]).all()


def test_greedy_order_measures_few_rows_anew(spark):
    """The order of a plain search of all rows at every step, from rows' distances taken sixteen at a time at most, and far fewer of them; gains alone from chunks."""
    r = np.random.default_rng(13)
    x, y = r.normal(size=(2, 120, 5))
    y[:20] = x[:20]
    x[100:] = x[:20]  # equal rows: the better quality, then the smaller id
    quality, before = np.round(r.random(120), 1), r.random(120) * 0.3
    u, v = neighbors.unit_rows(x), neighbors.unit_rows(y)
    after, now, left, want = 1 - u @ v.T, before, list(range(120)), []
    alone = np.maximum(before - after, 0).mean(1)
    while left:
        fall = np.round(np.maximum(now - after, 0).mean(1), 12)
        i = min(left, key=lambda j: (-fall[j], -quality[j], j))
        want.append(i), left.remove(i)
        now = np.minimum(now, after[i])
    asked = []
    steps = greedy.lazy_greedy(pd.DataFrame({"quality": quality, "gain": alone}), before, lambda at: asked.append(len(at)) or after[list(at)], 120, 12)
    assert [i for i, _, _ in steps] == want
    assert max(asked) <= 16 and sum(asked) < 120 * 12
    rows = spark.createDataFrame([(0, i, x[i].tolist(), float(quality[i])) for i in range(120)] + [(1, 500, [1.0] * 5, 0.5)], "batch long, id long, v array<double>, quality double")
    targets = spark.createDataFrame([(0, i, y[i].tolist(), float(before[i])) for i in range(120)], "batch long, id long, v array<double>, before double")
    got = {g.id: g for g in greedy.alone_gains(rows, targets, block=16).collect()}
    assert np.allclose([got[i].gain for i in range(120)], alone, atol=1e-12) and got[500].gain == got[500].relative_gain == 0
    assert abs(got[3].relative_gain - alone[3] / before.mean()) < 1e-12
    assert [g.id for g in labels.gain_labels(rows.filter("batch = 0"), targets).orderBy("greedy_rank").collect()] == want
    first = greedy.oracle_greedy(rows.filter("batch = 0"), targets, 3).orderBy("rank").collect()
    assert [f.id for f in first] == want[:3] and abs(first[-1].value - (before - np.minimum(before, after[want[:3]].min(0))).mean() / before.mean()) < 1e-12


def test_copies_are_searched_once(spark, monkeypatch):
    """Many rows with one vector: the same neighbours as one search for each row, and only distinct vectors go into it."""
    r = np.random.default_rng(14)
    kinds = r.integers(1, 5, (12, 3)).astype(float)
    kinds = np.unique(kinds / kinds.sum(1, keepdims=True), axis=0)
    rows = vectors(spark, [(i, kinds[int(k)]) for i, k in enumerate(np.minimum(r.integers(0, 2 * len(kinds), 70), len(kinds) - 1))])
    plain, real = {}, neighbors.knn_join
    for g in real(rows, rows, 6, leave_self_out=True).collect():
        plain.setdefault(g.query_id, {})[g.rank] = g.distance
    asked = []
    monkeypatch.setattr(neighbors, "knn_join", lambda q, *a, **k: asked.append(q.count()) or real(q, *a, **k))
    got = neighbors.knn_of_copies(rows, 6).collect()
    assert asked[0] <= len(kinds) and len(got) == 70 * 6 and all(g.query_id != g.ref_id for g in got)
    assert all(abs(plain[g.query_id][g.rank] - g.distance) < 1e-12 for g in got)
    own = {}
    for row in rows.collect():
        own.setdefault(tuple(row.v), []).append(row.id)
    for ids in own.values():  # equal rows: the smallest ids
        want = {i: [j for j in ids if j != i][:6] for i in ids}
        for i in ids:
            assert [g.ref_id for g in sorted(got, key=lambda g: g.rank) if g.query_id == i][: len(want[i])] == want[i]


def test_groups_left_out_meet_once(spark, monkeypatch):
    """Novelty without each group in turn, as by a search for each; a run of no support row has all of it."""
    r = np.random.default_rng(15)
    own = vectors(spark, [(i, r.normal(size=3)) for i in range(9)])
    support = spark.createDataFrame([(100 + i, r.normal(size=3).tolist(), i % 3) for i in range(20)], "id long, v array<double>, g int")
    runs = spark.createDataFrame([(0,), (1,), (2,), (7,)], "run long")
    plain = reports.novelty_by_run(runs, own, support.join(runs, F.col("g") != F.col("run")).select("run", "id", "v"), 4).collect()
    met, real = [], neighbors.knn_by_batch
    monkeypatch.setattr(neighbors, "knn_by_batch", lambda q, ref, *a, **k: met.append(ref.count()) or real(q, ref, *a, **k))
    got = {(x.run, x.id): x for x in reports.novelty_without_group(runs, own, support, "g", 4).collect()}
    assert met == [20] and len(got) == len(plain) == 36
    assert all(abs(got[p.run, p.id].novelty - p.novelty) < 1e-12 and got[p.run, p.id]["rank"] == p["rank"] for p in plain)


def test_k_means_holds_strips_of_distances(spark):
    """Labels as by a table of all rows, centres and dimensions, ties and empty parts included, in a fraction of its memory."""

    def plain(x, k, steps):
        centres, labels = clusters._farthest_centres(x, k), np.full(len(x), -1)
        for _ in range(steps):
            d = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2)
            new = d.argmin(1)
            for c in range(k):
                if not (new == c).any():
                    new[int(d[np.arange(len(x)), new].argmax())] = c
            if (new == labels).all():
                break
            labels = new
            centres = np.stack([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
        return labels

    r = np.random.default_rng(16)
    for x, k in ((r.normal(size=(400, 6)), 30), (r.integers(0, 3, (200, 3)).astype(float), 40), (np.ones((12, 4)), 5)):
        assert (clusters._lloyd(x, k, 16) == plain(x, k, 16)).all()
    x = r.normal(size=(3000, 64))
    tracemalloc.start()
    clusters._lloyd(x, 150, 2)
    assert tracemalloc.get_traced_memory()[1] < 3000 * 150 * 64 * 8 / 4
    tracemalloc.stop()
