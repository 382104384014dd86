"""The catalog against DuckDB, and hand-made cases of operators that SQL does not express."""

import importlib
import itertools
import random
import sys
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cachesight.functions import scalars
from cachesight.operators import dominance, models, panels, policies, release, selection, trace, validate, views
from cachesight.plans import catalog
from cachesight.schema import CANONICAL, DECISION_KEY
from cachesight.sources import shared, tables
from cachesight.sources.fixtures import candidates, traces
from cachesight.streaming import shards

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return ""
    return v if isinstance(v, str) else repr(float(v) + 0.0)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, duck, name):
    own, sql = catalog.queries()[name](spark, sf).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(own.columns)
    assert columns == sorted(sql.columns)
    rows = lambda df: sorted(tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert rows(own) == rows(sql)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry_needs_no_session():
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "decision_view" in entry.queries()


def test_replay_and_labels_equal_simulation(spark):
    rng = random.Random(3)
    items = [str(rng.randrange(9)) for _ in range(120)]
    df = spark.createDataFrame([("a", t, x) for t, x in enumerate(items)], "trace string, t long, item string")
    for c in (2, 3, 5):
        replay = trace.lru_replay(df, [c])
        got = {(r.t, r.page, r.horizon): r.y_loss for r in trace.rollout_labels(df, trace.reuse_distance(df), replay, [4, 8]).collect()}
        want, cache = {}, []
        for t, x in enumerate(items):
            if x in cache:
                cache.remove(x)
            elif len(cache) == c:
                for e, h in itertools.product(cache, (4, 8)):
                    own, misses = [k for k in cache if k != e] + [x], 0
                    for y in items[t + 1 : t + 1 + h]:
                        if y in own:
                            own.remove(y)
                        else:
                            misses += 1
                            if len(own) == c:
                                own.pop(0)
                        own.append(y)
                    want[t, e, h] = misses
                cache.pop(0)
            cache.append(x)
        assert got == want
        run = policies.continuation_losses(df, [c], "lru", 8).collect()
        assert {(r.t, r.page, 8): r.y_loss for r in run} == {k: v for k, v in want.items() if k[2] == 8}


@pytest.mark.parametrize("name", ["lru", "mru", "random"])
def test_continuations_equal_simulation(spark, name):
    rng = random.Random(11)
    items, c, h, seeds = [str(rng.randrange(9)) for _ in range(260)], 4, 8, 3
    df = spark.createDataFrame([("a", t, x) for t, x in enumerate(items)], "trace string, t long, item string")
    got = {(r.t, r.page): r.y_loss for r in policies.continuation_losses(df, [c], name, h, seeds).collect()}
    want, cache = {}, []
    for t, x in enumerate(items):
        if x in cache:
            cache.remove(x)
        elif len(cache) == c:
            for e in cache:
                losses = []
                for s in range(seeds if name == "random" else 1):
                    own, misses, draw = [k for k in cache if k != e] + [x], 0, random.Random(s)
                    for y in items[t + 1 : t + 1 + h]:
                        if y not in own:
                            misses += 1
                            if name == "random":
                                own[draw.randrange(c)] = y
                            else:
                                own.pop(0 if name == "lru" else -1)
                                own.append(y)
                        elif name != "random":
                            own.remove(y)
                            own.append(y)
                    losses.append(misses)
                want[t, e] = sum(losses) / len(losses)
            cache.pop(0)
        cache.append(x)
    assert got == want and max(t for t, _ in got) > 200


def test_catalog_covers_whole_traces(spark, sf):
    decisions = catalog.queries()["lru_decisions"](spark, sf).where("decision").select("trace", "capacity", "t")
    rows = catalog.queries()["continuation_mru"](spark, sf).groupBy("trace", "capacity", "t").count()
    assert decisions.where("t >= 200").count() and decisions.exceptAll(rows.select("trace", "capacity", "t")).count() == 0
    assert rows.where("count <> capacity").count() == 0
    runs = catalog.queries()["policy_runs"](spark, sf).where("policy = 'random'").groupBy("trace", "capacity").count()
    assert {r["count"] for r in runs.collect()} == {20}
    assert catalog.queries()["bootstrap"](spark, sf).first().replicates == 2000


def requests(name, capacity, text):
    p = policies.policy(name, capacity)
    return "".join("h" if p.request(x)[0] else "m" for x in text)


def test_policies_by_hand():
    assert requests("lru", 2, "abacab") == "mmhmhm"
    assert requests("mru", 2, "abcab") == "mmmhm"
    assert requests("fifo", 2, "abacab") == "mmhmmm"
    assert requests("lfu", 2, "aabcab") == "mhmmhm"
    assert requests("sieve", 2, "abacab") == "mmhmhm"


@pytest.mark.parametrize("name", [*policies.DETERMINISTIC, "random"])
def test_policies_keep_their_size(name):
    rng = random.Random(5)
    p, held = policies.policy(name, 7, 1), 0
    for _ in range(3000):
        hit, evicted = p.request(str(int(rng.paretovariate(0.7)) % 60))
        held += (not hit) - evicted
        assert 0 <= held <= 7


def test_failed_run_is_a_row(spark):
    t = spark.createDataFrame([("a", 0, "x")], "trace string, t long, item string")
    plan = spark.createDataFrame([("a", 2, "unknown", 0)], "trace string, capacity long, policy string, seed int")
    (row,) = policies.simulate(t, plan).collect()
    assert row.status == "failed" and "KeyError" in row.error


def test_pair_sample_prunes_without_loss(spark, sf):
    c = candidates(spark, sf)
    sample = views.pairwise_sample(c, 400, 3)
    kept = {(r.decision_id, *sorted((r.candidate_a_page_id, r.candidate_b_page_id))) for r in sample.collect()}
    want = set()
    pages = {}
    for r in c.select("decision_id", "candidate_page_id").collect():
        pages.setdefault(r.decision_id, []).append(r.candidate_page_id)
    for d in {k[0] for k in kept}:
        want |= {(d, *p) for p in list(itertools.combinations(sorted(pages[d]), 2))[:3]}
    assert kept == want and len(kept) <= 400


def test_augment_refuses_repeated_pages(spark, sf):
    c = candidates(spark, sf)
    pairs = views.pairwise_sample(c, 10, 2)
    with pytest.raises(Exception, match="pages matched: 2"):
        views.augment_pairs(pairs, c.unionByName(c), ["y_loss"]).collect()


def test_best_candidate_without_finite_scores(spark, sf):
    c = candidates(spark, sf).where("decision_t < 50")
    got = selection.best_candidate(c, F.lit(float("nan"))).collect()
    least = {r.decision_id: r.p for r in c.groupBy("decision_id").agg(F.min("candidate_page_id").alias("p")).collect()}
    assert {r.decision_id: r.candidate_page_id for r in got} == least


def test_linear_fit_with_constant_feature(spark):
    df = spark.createDataFrame([(float(x), 3.0, 2.0 * x + 1) for x in range(20)], "a double, b double, y double")
    m = models.fit_linear(df, ["a", "b"], "y")
    assert abs(m["coefficients"]["a"] - 2) < 1e-6
    (row,) = models.regression_metrics(df.withColumn("g", F.lit(1)), models.predict_linear(m), "y", ["g"]).collect()
    assert row.mae < 1e-6 and row.r2 > 0.999999


def test_split_names(spark):
    df = spark.createDataFrame([(" Validation",), ("train",)], "s string")
    assert [r[0] for r in df.select(scalars.split_name(F.col("s"))).collect()] == ["val", "train"]
    odd = spark.createDataFrame([("dev",)], "s string")
    assert odd.select(scalars.split_name(F.col("s"), "bucket")).first()[0] == "other"
    with pytest.raises(Exception, match="unknown split"):
        odd.select(scalars.split_name(F.col("s"))).collect()


def test_validator_finds_faults(spark, sf):
    c = candidates(spark, sf).where("decision_t < 200")
    bad = c.withColumn("y_loss", F.when(F.col("decision_t") == 1, -1.5).when(F.col("decision_t") == 2, float("nan")).otherwise(F.col("y_loss")))
    got = {r.check: r.faults for r in validate.validate_candidates(bad.unionByName(c.where("decision_t = 3"))).collect()}
    assert got["loss_negative"] and got["loss_fractional"] and got["loss_not_finite"] and got["sign_mismatch"] and got["duplicate_candidates"]
    assert validate.validate_candidates(c.drop("y_value")).first().check == "missing_column:y_value"


def test_release_build_validate_resume_migrate(spark, sf, tmp_path):
    c, root = candidates(spark, sf), str(tmp_path / "r")
    assert release.build(spark, c, root, ("5-LOW",), 200, 4) == list(release.STAGES)
    assert release.build(spark, c, root, ("5-LOW",), 200, 4) == []
    with pytest.raises(FileExistsError):
        release.build(spark, c, root, resume=False)
    assert all(r.faults == 0 for r in release.validate_release(spark, root, ("5-LOW",)).collect())
    parts = release.partition_inventory(spark, f"{root}/candidate_rows").collect()
    assert sum(r.row_count for r in parts) == c.where("trace_family <> '5-LOW'").count() and all(r.files for r in parts)
    assert release.migration_plan(spark, root)["regenerate_view"] is False
    assert release.migrate(spark, root, str(tmp_path / "n")) == list(release.STAGES)
    (tmp_path / "r" / "split_summary" / "part-extra.parquet").write_bytes(b"x")
    assert [r.fault for r in release.verify_checksums(spark, root).collect()] == ["not listed"]


def test_preview_hides_pages(spark, sf):
    c = candidates(spark, sf)
    p = release.preview(c, 15, "salt")
    assert p.count() == 45 and all(r.faults == 0 for r in release.preview_faults(p, c).collect())
    hidden = release.hide_pages(views.decision_view(c), "salt", ["2-HIGH"]).where("trace_family = '2-HIGH'").first()
    assert hidden.optimal_candidate_page_ids.startswith("obj_")


def test_shards_of_drifting_headers(spark, sf, tmp_path):
    c = candidates(spark, sf).where("decision_t < 40")
    c.coalesce(1).write.option("header", True).csv(str(tmp_path / "a.csv"))
    c.drop("request_bucket").withColumn("more", F.lit("x")).coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    got = tables.read_candidates(spark, str(tmp_path))
    assert got.count() == 2 * c.count() and set(CANONICAL) | {"more"} == set(got.columns)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest.json").write_text('{"shards": [{"path": "b.parquet"}]}')
    assert tables.read_candidates(spark, str(tmp_path / "m" / "manifest.json")).count() == c.count()


def test_trace_and_run_files(spark, sf, tmp_path):
    t = traces(spark, sf).where("trace = 'click'")
    tables.write_trace(t, str(tmp_path / "t"))
    back = tables.read_trace(spark, str(tmp_path / "t"), "click")
    assert back.exceptAll(t).count() == 0 and back.count() == t.count()
    (tmp_path / "runs.jsonl").write_text('{"run_key": "a", "status": "failed", "at": 1}\nnot json\n{"run_key": "a", "status": "complete", "at": 2}\n{"run_key": "b", "status": "odd", "at": 3}\n')
    rows = tables.read_runs(spark, str(tmp_path / "runs.jsonl"), "run_key string, status string, at long").collect()
    assert [(r.run_key, r.status) for r in rows] == [("a", "complete")]


def test_streamed_sums_equal_batch(spark, sf, tmp_path):
    c = candidates(spark, sf)
    c.repartition(6).write.parquet(str(tmp_path / "in"))
    q = shards.ingest(spark, str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "sums"), "y_loss", ["split"], 2)
    q.awaitTermination(120)
    got = shards.merge_sums(spark.read.parquet(str(tmp_path / "sums")), ["split"])
    assert sorted(got.collect()) == sorted(shards.merge_sums(shards.partial_sums(c, "y_loss", ["split"]), ["split"]).collect())


def test_unit_completeness(spark):
    plan = spark.createDataFrame([("a", 32), ("a", 64), ("b", 32)], "family string, capacity long")
    files = spark.createDataFrame([("x/a__cap32.part0001.csv",), ("x/a__cap32.done.json",), ("x/b__cap32.part0001.csv",)], "path string")
    got = {(r.family, r.capacity): r.state for r in release.unit_completeness(plan, files).collect()}
    assert got == {("a", 32): "complete", ("a", 64): "missing", ("b", 32): "partial"}


def test_decision_view_golden(spark):
    rows = [(*["t", "f", "s", 3, 4, "d1", 1, 0, "train"], p, y, -y) for p, y in (("A", 1.0), ("B", 3.0), ("C", 1.0))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in ('capacity', 'horizon', 'decision_t', 'decision_chunk_id') else 'string'}" for c in DECISION_KEY) + ", candidate_page_id string, y_loss double, y_value double")
    (r,) = views.decision_view(df).collect()
    assert (r.optimal_candidate_page_ids, r.min_y_loss, r.regret_sum, r.tie_count, r.candidate_count) == ("A|C", 1.0, 2.0, 2, 3)


def test_continuation_classes(spark):
    rows = [(c, d, float(x), float(y)) for c, d, xs, ys in [(1, 1, (0, 1, 2), (0, 1, 2)), (2, 1, (0, 1, 2), (5, 5, 0)), (3, 1, (1, 1), (0, 4)), (4, 1, (7,), (3,))] for x, y in zip(xs, ys)]
    df = spark.createDataFrame(rows, "capacity int, d int, x double, y double")
    got = {r.capacity: r["class"] for r in models.continuation_class(df, ["capacity", "d"], ["capacity"]).collect()}
    assert got == {1: "ROBUST", 2: "SENSITIVE", 3: "INCONCLUSIVE", 4: "INCONCLUSIVE"}
    sets = models.continuation_summary(df, ["capacity", "d"]).collect()
    assert {r.subset: r.decisions for r in sets} == {"A_all": 4, "B_not_both_tied": 3, "C_telling_first": 2, "D_telling_either": 3}
    assert models.continuation_class(df.limit(0), ["capacity", "d"], ["capacity"]).count() == 0


def test_horizon_monotonicity_and_decomposition(spark):
    regret = {1: (0.0, 1.0, 2.0), 2: (2.0, 1.0, 1.0), 3: (0.0, 1.0, 0.0), 4: (1.0, 1.0, 1.0), 5: (9.0,)}
    rows = [(t, h, v == 0, v, 0.5) for t, vs in regret.items() for h, v in zip((4, 8, 16), vs)]
    df = spark.createDataFrame(rows, "t int, horizon int, all_tied boolean, random_regret double, optimal_fraction double")
    assert tuple(panels.horizon_monotonicity(df, ["t"], [4, 8, 16]).first()) == (4, 1, 1, 2, 2, 1, 1)
    got = {r.metric: (r.population_effect, r.horizon_effect) for r in panels.horizon_decomposition(df, ["t"], 4, 16).collect()}
    assert got == {"random_regret": (pytest.approx(-1.65), 0.25), "all_tied": (pytest.approx(0.1), -0.25), "random_optimal": (0.0, 0.0)}


@pytest.mark.parametrize("size", [5, 64])
def test_replay_by_blocks(spark, size):
    """Traces of many blocks, one of them with nine tenths of all requests; a hot item; blocks without a repeat."""
    rng = random.Random(size)
    own = {"a": [str(min(rng.randrange(40), rng.randrange(40), 9 + rng.randrange(40))) for _ in range(700)], "b": ["x"] * 20, "c": [str(k) for k in range(30)], "d": ["q"]}
    df = spark.createDataFrame([(n, t, x) for n, items in own.items() for t, x in enumerate(items)], "trace string, t long, item string").repartition(5)
    want, after = {}, {}
    for n, items in own.items():
        for t, x in enumerate(items):
            prev = max((k for k in range(t) if items[k] == x), default=None)
            want[n, t] = (prev, None if prev is None else len(set(items[prev + 1 : t])))
            if prev is not None:
                after[n, prev] = t
    got = {(r.trace, r.t): (r.prev, r.next) for r in trace.positions(df, size).collect()}
    assert got == {k: (p, after.get(k)) for k, (p, _) in want.items()}
    got = {(r.trace, r.t): r.distance for r in trace.reuse_distance(df, size).collect()}
    assert got == {k: d for k, (_, d) in want.items()}
    gone = {}
    for n, items in own.items():
        cache: dict[str, int] = {}
        for t, x in enumerate(items):
            if x in cache:
                gone[n, cache.pop(x)] = t
            elif len(cache) == 6:
                gone[n, cache.pop(next(iter(cache)))] = t
            cache[x] = t
    replay = trace.lru_replay(df, [6], size)
    assert {(r.trace, r.t): r.gone for r in replay.collect()} == {k: gone.get(k) for k in want}
    assert {(r.trace, r.t) for r in replay.where("hit").collect()} == {k for k, (_, d) in want.items() if d is not None and d < 6}


def test_dominance_counts():
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 257):
        x, y = [rng.randrange(20) for _ in range(n)], rng.sample(range(n), n)
        assert dominance.count_dominated(np.array(x), np.array(y)).tolist() == [sum(a < x[i] and b <= y[i] for a, b in zip(x, y)) for i in range(n)]


def test_numbers_follow_the_order(spark):
    rows = [(k % 3, (k * 37) % 101, k) for k in range(101)]
    got = trace.numbered(spark.createDataFrame(rows, "g int, x int, k int"), ["g"], F.floor(F.col("x") / 10), ["x"]).collect()
    for g in range(3):
        assert [r.t for r in sorted((r for r in got if r.g == g), key=lambda r: r.x)] == list(range(sum(r[0] == g for r in rows)))


def kendall_by_hand(rows):
    c = d = x = y = both = 0
    for (a, b), (e, f) in itertools.combinations(rows, 2):
        s = (e > a) - (e < a), (f > b) - (f < b)
        c, d, x, y, both = c + (s[0] * s[1] > 0), d + (s[0] * s[1] < 0), x + (s[0] == 0), y + (s[1] == 0), both + (s == (0, 0))
    n = len(rows) * (len(rows) - 1) // 2
    below = (n - x) * (n - y)
    return len(rows), c, d, x, y, both, round((c - d) / below**0.5, 9) if below else None


@pytest.mark.parametrize("size", [7, None])
def test_kendall_counts_pairs(spark, size):
    rng = random.Random(4)
    groups = {"few": [(rng.randrange(4), rng.randrange(3)) for _ in range(150)], "many": [(k := rng.random(), k + rng.random()) for _ in range(170)], "same": [(1.0, 2.0)] * 60 + [(2.0, 2.0)], "one": [(1.0, 1.0)]}
    df = spark.createDataFrame([(g, float(a), float(b)) for g, rows in groups.items() for a, b in rows] + [("few", None, 1.0), ("none", 1.0, None)], "g string, a double, b double")
    got = {r.g: tuple(r)[1:] for r in models.kendall(df, "a", "b", ["g"], size).collect()}
    assert got == {g: kendall_by_hand(rows) for g, rows in groups.items()}
    assert tuple(models.kendall(df.where("g = 'many'"), "a", "b", size=size).first()) == kendall_by_hand(groups["many"])


@pytest.mark.parametrize("bins", [4, 512])
def test_bootstrap_medians_are_exact(spark, bins):
    import statistics

    rng = random.Random(2)
    rows = [(k, rng.choice([rng.random(), 0.5, 1.0])) for k in range(90)] + [(200, None), (201, 0.25), (201, 0.75)]
    df = spark.createDataFrame(rows, "id long, v double").withColumn("w", F.col("v") * 2)
    hashed = [(np.int64(r.h), r.v) for r in df.where("v IS NOT NULL").select(F.xxhash64("id").alias("h"), "v").collect()]
    weights = models.poisson_weights(np.array([h for h, _ in hashed]), 40, 3)
    want = {k: statistics.median([v for (_, v), n in zip(hashed, weights[:, k]) for _ in range(n)]) for k in range(40)}
    assert {r.k: r.m for r in models.bootstrap_medians(df, "v", ["id"], 40, 3, bins).collect()} == want
    means = {k: sum(v * n for (_, v), n in zip(hashed, weights[:, k])) / weights[:, k].sum() * 2 for k in range(40)}
    row = models.cluster_bootstrap(df, ["id"], "v", "w", 40, 3).first()
    rank = lambda own, p: round(sorted(own.values())[round(p * 39)], 9)
    assert (row.median_jaccard_low, row.median_jaccard_high) == (rank(want, 0.025), rank(want, 0.975))
    assert (row.mean_ccr_low, row.mean_ccr_high) == pytest.approx((rank(means, 0.025), rank(means, 0.975)), abs=2e-9) and row.decisions == 93
    assert 0.95 < weights.mean() < 1.05 and weights.max() > 4


def test_windowed_locality_of_short_and_overlapping_windows(spark):
    df = spark.createDataFrame([("a", t, str(t % 7 if t < 60 else t)) for t in range(100)] + [("b", 0, "x"), ("b", 1, "x")], "trace string, t long, item string")
    rows = {(r.trace, r.window): r for r in trace.windowed_locality(df, trace.reuse_distance(df), 40, 10).collect()}
    assert sorted(rows) == [("a", k) for k in range(7)] + [("b", 0)]
    first, last, short = rows["a", 0], rows["a", 6], rows["b", 0]
    assert (first.requests, first.objects, first.longest_novel_streak, first.reuse_p50, first.compulsory_fraction) == (40, 7, 7, 6, 0.175)
    assert (last.objects, last.longest_novel_streak, last.entropy, last.normalised_entropy, last.reuse_events, last.reuse_mean, last.within_32) == (40, 40, round(np.log2(40), 9), 1.0, 0, None, None)
    assert (short.requests, short.objects, short.entropy, short.normalised_entropy, short.working_set_32, short.top_1_share) == (2, 1, 0.0, 0.0, 1.0, 1.0)


def test_linear_score_needs_its_features(spark, sf):
    pairs = views.pairwise_view(candidates(spark, sf), include_ties=True)
    model = models.fit_linear(candidates(spark, sf).where("split = 'train'"), ["candidate_lru_score", "candidate_recency_rank"], "y_loss")
    by_split = {r.split: r for r in models.calibrated_linear_score(pairs, model, ["split"]).collect()}
    assert set(by_split) == {"train", "val", "test"} and all(0.4 < r.accuracy <= 1 for r in by_split.values())
    with pytest.raises(ValueError, match="candidate_lru_score"):
        models.calibrated_linear_score(pairs.drop("candidate_lru_score_b"), model, ["split"])
    with pytest.raises(ValueError, match="no coefficients"):
        models.calibrated_linear_score(pairs, model | {"coefficients": {}}, ["split"])


def test_census_deltas(spark):
    rows = [(f, c, 4, k, float(x), float(y)) for f, c, k, xs, ys in [("f", 1, 1, (0, 1), (0, 1)), ("f", 1, 2, (0, 1), (1, 0)), ("g", 2, 3, (0, 0), (0, 0))] for x, y in zip(xs, ys)]
    df = spark.createDataFrame(rows, "trace_family string, capacity int, horizon int, d int, x double, y double")
    key = ["trace_family", "capacity", "horizon", "d"]
    whole, part = models.continuation_census(df, key), models.continuation_census(df.where("d <> 2"), key)
    assert len(whole.collect()) == 8 + 5 and {r.decisions for r in whole.where("level = 'all'").collect()} == {3, 2}
    got = {(r.level, r.subset, r.trace_family): (r.sampled, r.whole, r.delta) for r in models.census_deltas(part, whole, ["mean_jaccard"]).collect()}
    assert got["all", "all", None] == (1.0, round(2 / 3, 9), round(1 - round(2 / 3, 9), 9)) and got["trace_family", "telling", "f"] == (1.0, 0.5, 0.5)


def test_random_continuation_replays_all_seeds_together():
    rng, seeds = random.Random(5), 6
    for c, later in ((1, 3), (4, 8), (5, 0)):
        pages = [rng.sample(range(12), c) for _ in range(40)]
        requests = [[20, *(rng.randrange(12) for _ in range(later))] for _ in pages]
        got = policies._random_losses(np.array(pages), np.array(requests), seeds, most=64)
        for own, asked, losses in zip(pages, requests, got, strict=True):
            for e, loss in zip(own, losses, strict=True):
                n = 0
                for s in range(seeds):
                    run = policies.policy("random", c, s)
                    for r in [*(k for k in own if k != e), asked[0]]:
                        run.request(r)
                    n += sum(not run.request(r)[0] for r in asked[1:])
                assert loss == n / seeds


def test_continuation_of_requests_that_never_return_needs_no_replay(spark):
    df = spark.createDataFrame([("a", t, str(t)) for t in range(300)], "trace string, t long, item string")
    began = time.monotonic()
    got = policies.continuation_losses(df, [4], "random", 8, seeds=50_000).collect()  # 59 million replays, were each done
    assert time.monotonic() - began < 90
    assert len(got) == 296 * 4 and all(r.y_loss == min(8, 299 - r.t) for r in got)


def test_counted_rows_weigh_as_many(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.randrange(4) / 2, rng.random() < 0.6, rng.randrange(1, 5)) for _ in range(60)]
    counted = spark.createDataFrame([(s, x, int(y), 0, n) for s, x, y, n in data], "split string, x double, label_a_better int, is_tie int, rows long")
    each = spark.createDataFrame([(s, x, int(y), 0) for s, x, y, n in data for _ in range(n)], "split string, x double, label_a_better int, is_tie int")
    (a, b), p = ((models.standardise(df, ["x"])[1]["x"], models.fit_logistic(df, ["x"], "label_a_better")) for df in (counted, each)), F.col("x") / 3 + 0.1
    assert np.allclose(a[0], b[0], atol=1e-12) and np.allclose(a[1], b[1], atol=1e-9)
    assert sorted(models.pair_metrics(counted, p, ["split"]).collect()) == sorted(models.pair_metrics(each, p, ["split"]).collect())
    score = lambda df: df.withColumn("score", F.col("x")).withColumnRenamed("label_a_better", "label")
    assert sorted(selection.midrank_auroc(score(counted), ["split"]).collect()) == sorted(selection.midrank_auroc(score(each), ["split"]).collect())
    again = models.counted_pairs(each, ["x"], ["split"])
    assert again.agg(F.sum("rows")).first()[0] == each.count() and again.count() < each.count()


def test_decisions_of_the_tables_need_no_shuffle(spark, sf):
    plan = panels.strict_density(candidates(spark, sf), DECISION_KEY).groupBy(*DECISION_KEY).count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_tasks_follow_the_rows(spark, monkeypatch):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        shared.deal_finely(spark, 30 * shared.TASK_ROWS)
        shared.deal_finely(spark, 20 * shared.TASK_ROWS)
        assert spark.conf.get(name) == "30" and shared.tasks(spark.range(100), 10) == 10
    finally:
        spark.conf.unset(name)


def test_summaries_of_rollouts_equal_those_of_labels_without_a_shuffle(spark, tmp_path):
    rng, hs = random.Random(6), [4, 8]
    df = spark.createDataFrame([("a", t, str(rng.randrange(9))) for t in range(150)], "trace string, t long, item string")
    trace.rollouts(df, trace.reuse_distance(df), trace.lru_replay(df, [3]), hs).write.parquet(f"{tmp_path}/r")
    rollouts = spark.read.parquet(f"{tmp_path}/r")
    labels, key = trace.labels_of(rollouts, hs), ["trace", "capacity", "t"]
    summary = trace.rollout_summary(rollouts, hs)
    assert sorted(summary.collect()) == sorted(trace.decision_summary(labels).select(*summary.columns).collect())
    density = trace.rollout_density(rollouts, hs)
    assert sorted(density.collect()) == sorted(panels.decision_density(labels, [*key, "horizon"]).select(*density.columns).collect())
    wide = trace.rollout_regrets(rollouts, hs)
    assert panels.monotonicity(wide, hs).collect() == panels.horizon_monotonicity(trace.decision_summary(labels), key, hs).collect()
    assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in (summary, density, wide))


def test_runs_read_blocks_in_order_and_once(spark, tmp_path):
    rng = random.Random(8)
    items = [str(rng.randrange(12)) for _ in range(700)]
    df = spark.createDataFrame([("a", t, x, t >= 100) for t, x in enumerate(items)], "trace string, t long, item string, scored boolean")
    plan = policies.execution_plan(df, [3], ["lru", "arc", "none", "random"], 2)
    runs = policies.simulate(df, plan)
    got = {(r.policy, r.seed): (r.status, r.requests, r.hits, r.evictions) for r in runs.collect()}
    assert got.pop(("none", 0))[0] == "failed" and len(got) == 4
    for (name, seed), found in got.items():
        own = policies.policy(name, 3, seed)
        seen = [own.request(x) for x in items][100:]
        assert found == ("complete", 600, sum(h for h, _ in seen), sum(e for _, e in seen))
    assert "MapInPandas" not in runs._jdf.queryExecution().executedPlan().toString()  # a table: gates do not run it again
