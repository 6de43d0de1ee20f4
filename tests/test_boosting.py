import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazeline.operators import attribution, binned, boosting, models
from hazeline.operators.boosting import Settings
from hazeline.plans import evaluation
from hazeline.sources.bundle import ModelBundle, load_bundle, save_bundle

from test_models import brute_force, features, rows  # noqa: F401

NAMES = ("a", "b", "c", "d", "flat")


def table(seed, n):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n), rng.gamma(2, 1, n), rng.normal(size=n).round(1), np.ones(n)])
    x[rng.random(n) < 0.15, 2] = np.nan
    y = 3 * (x[:, 0] > 0.3) * x[:, 1] - np.nan_to_num(x[:, 2], nan=5) + rng.normal(0, 0.3, n)
    return x, y


def plain_boosting(x, y, s):
    """Row by row: every threshold of every drawn input is tried on the rows of a node."""
    edges = [boosting.bin_edges(x[:, j]) for j in range(x.shape[1])]
    base, fitted = y.mean(), np.full(len(y), y.mean())
    for round_ in range(s.rounds):
        rng = np.random.default_rng([s.seed, round_])
        drawn = np.flatnonzero(rng.random(len(y)) < s.row_share) if s.row_share < 1 else np.arange(len(y))
        columns = sorted(rng.permutation(x.shape[1])[: max(1, int(s.column_share * x.shape[1]))])
        gradient = fitted - y

        def node(mine, everyone, level):
            total, size = sum(gradient[i] for i in mine), len(mine)
            best, split = 0.0, None
            if level < s.depth:
                for j in columns:
                    for edge in edges[j]:
                        left = [i for i in mine if x[i, j] <= edge]
                        g, n = sum(gradient[i] for i in left), len(left)
                        if n < s.least_rows or size - n < s.least_rows:
                            continue
                        gain = g * g / (n + s.penalty) + (total - g) ** 2 / (size - n + s.penalty) - total * total / (size + s.penalty)
                        if gain > best + 1e-9 * max(1, abs(best)):
                            best, split = gain, (j, edge)
            if split is None:
                for i in everyone:
                    fitted[i] -= s.rate * total / (size + s.penalty)
                return
            j, edge = split
            for side in (True, False):
                node([i for i in mine if (x[i, j] <= edge) == side], [i for i in everyone if (x[i, j] <= edge) == side], level + 1)

        node(list(drawn), range(len(y)), 0)
    return base, fitted


@pytest.mark.parametrize("settings", [Settings(rounds=6, depth=3, rate=0.3), Settings(rounds=4, depth=5, rate=0.5, row_share=1.0, column_share=1.0, least_rows=4, penalty=2.5), Settings(rounds=0)])
def test_equals_a_loop_over_rows(settings):
    x, y = table(1, 160)
    model = boosting.grow(x, y, NAMES, settings)
    base, want = plain_boosting(x, y, settings)
    assert model.base == base and np.allclose(model.score(x), want, atol=1e-9)


def test_edges_are_exact_quantiles():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=5_000), np.repeat(0.25, 900), [np.nan] * 50])
    edges, known = boosting.bin_edges(v, 16), np.sort(v[~np.isnan(v)])
    assert set(edges) == {known[len(known) * k // 16 - 1] for k in range(1, 16)} - {known[-1]}
    assert boosting.bin_edges(np.array([3.0, 1.0, 3.0, np.nan])).tolist() == [1.0]
    assert not len(boosting.bin_edges(np.array([np.nan]))) and not len(boosting.bin_edges(np.array([2.0, 2.0])))


def frame(spark, x, y, group):
    data = [(int(g), *(None if np.isnan(v) else float(v) for v in row), float(t), i) for i, (g, row, t) in enumerate(zip(group, x, y, strict=True))]
    return spark.createDataFrame(data, "fold int, a double, b double, c double, d double, flat double, y_aqi double, id int")


def test_groups_are_fitted_apart_and_rows_scored_by_theirs(spark):
    x, y = table(3, 600)
    group = np.arange(600) % 4
    df = frame(spark, x, y, group).repartition(7)
    s = Settings(rounds=8, depth=4)
    fitted = boosting.fit_groups(df.where("fold > 0"), "fold", 3, NAMES, settings=s)
    got = boosting.predict_groups(df, "fold", fitted).orderBy("id").toPandas()
    assert set(fitted) == {1, 2, 3} and got[got.fold == 0].prediction.isna().all()
    for g in (1, 2, 3):
        own = group == g
        order = np.lexsort([*np.nan_to_num(x[own], nan=-1e300).T, y[own]])
        want = boosting.grow(x[own][order], y[own][order], NAMES, s).score(x[own])
        assert np.allclose(got[got.fold == g].prediction, want, atol=1e-12)


def test_attribution_equals_brute_force(spark):
    x, y = table(4, 300)
    df = frame(spark, x, y, np.zeros(300)).drop("fold")
    model = boosting.HistogramBoosting(NAMES, rounds=7, depth=5, rate=0.3).fit(df)
    some = model.transform(df.where("id < 40"))
    got = attribution.tree_attribution(some, model, NAMES).orderBy("id").toPandas()
    leaves, base = attribution.tree_leaves(model)
    for i, row in got.iterrows():
        # in the plain definition a missing value lies right of everything
        want = brute_force(leaves, np.nan_to_num(x[i], nan=1e300), len(NAMES))
        np.testing.assert_allclose(row["phi"], want, atol=1e-9)
        assert base + sum(row["phi"]) == pytest.approx(row["prediction"], abs=1e-9)


def test_saved_model_scores_alike(spark, tmp_path):
    x, y = table(5, 200)
    df = frame(spark, x, y, np.zeros(200))
    model = boosting.HistogramBoosting(NAMES, rounds=5, depth=3).fit(df)
    bundle = ModelBundle("GradientBoosting", model, spark.createDataFrame([(1, -1.0, 1.0)], "horizon int, low double, high double"), "t", feature_columns=NAMES)
    save_bundle(spark, bundle, str(tmp_path / "m"))
    again = load_bundle(spark, str(tmp_path / "m")).model
    assert np.array_equal(again.score(x), model.score(x)) and again.features == NAMES
    assert model.transform(df).columns == [*df.columns, "prediction"]


def test_backtest_side_by_side_equals_one_fold_at_a_time(spark, rows):  # noqa: F811
    s = Settings(rounds=6, depth=3)
    names = ("aqi_anchor", "horizon", "temperature_2m")
    together = evaluation.walk_forward_boosted(rows, 3, None, names, s).orderBy("fold").toPandas()
    apart = evaluation.walk_forward(rows, 3, lambda _: boosting.HistogramBoosting(names, rounds=6, depth=3), None).orderBy("fold").toPandas()
    assert together[["fold", "train_rows", "test_rows", "test_from"]].equals(apart[["fold", "train_rows", "test_rows", "test_from"]])
    assert np.allclose(together[["rmse", "mae", "r2"]], apart[["rmse", "mae", "r2"]])


def test_beats_persistence_on_a_seasonal_series(rows):  # noqa: F811
    from hazeline.operators.supervised import time_split

    train, valid = time_split(rows)
    fitted = models.fit_candidates(train, {"b": boosting.HistogramBoosting(rounds=60, depth=5, rate=0.1)})
    result = {r["model"]: r["rmse"] for r in models.compare(valid.where(F.col("horizon") == 6), fitted).collect()}
    assert result["b"] < result[models.BASELINE]


@pytest.mark.parametrize("depth", [1, 2, 6, 8])
def test_table_attribution_equals_leaf_by_leaf(spark, monkeypatch, depth):
    x, y = table(6, 600)
    df = frame(spark, x, y, np.zeros(600)).drop("fold")
    model = boosting.HistogramBoosting(NAMES, rounds=4, depth=depth, rate=0.3).fit(df)
    asked = model.transform(df)
    by_leaf = attribution.tree_attribution(asked, model, NAMES).orderBy("id").toPandas()
    monkeypatch.setattr(attribution, "TABLE_ROWS", 1)
    got = attribution.tree_attribution(asked, model, NAMES).orderBy("id").toPandas()
    np.testing.assert_allclose(np.stack(got.phi), np.stack(by_leaf.phi), atol=1e-10)
    np.testing.assert_allclose(got.base + np.stack(got.phi).sum(axis=1), got.prediction, atol=1e-9)


def test_tree_attribution_query_explains_every_row(spark, monkeypatch, tmp_path):
    from checks import queries

    step = F.col("id").cast("long")
    events = spark.range(500).select(
        step.alias("event_id"), F.timestamp_seconds(step * 600 + 1_704_067_200).alias("ts"), (step % 37).alias("user_id"),
        F.element_at(F.array(*[F.lit(s) for s in ("view", "click")]), (step % 2 + 1).cast("int")).alias("event_type"),
        (step * 17 % 90 + 0.5).alias("value"), F.concat(F.lit('{"k": '), (step * 7 % 100).cast("string"), F.lit("}")).alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = queries.supervised_table(spark, str(tmp_path))
    model = boosting.HistogramBoosting(rounds=3, depth=3).fit(rows)
    monkeypatch.setattr(queries, "_boosted_once", lambda *_: model)
    got = queries.QUERIES["tree_attribution"](spark, str(tmp_path))
    assert got.where("exact").count() == got.count() == rows.count() > 1000


@pytest.mark.parametrize("settings", [Settings(rounds=5, depth=4, rate=0.3), Settings(rounds=2, depth=2, row_share=1.0, column_share=1.0)])
def test_fit_over_blocks_grows_the_trees_of_one_task(spark, monkeypatch, settings):
    x, y = table(7, 1500)
    group = np.arange(1500) % 5 % 3
    df = frame(spark, x, y, group).unionByName(frame(spark, x[:200], y[:200], group[:200])).repartition(5)
    one = boosting.fit_groups(df, "fold", 3, NAMES, settings=settings)
    monkeypatch.setattr(boosting, "PLAIN_ROWS", 100)
    monkeypatch.setattr(binned, "BLOCK_ROWS", 64)
    for g, model in boosting.fit_groups(df, "fold", 3, NAMES, settings=settings).items():
        assert all(np.array_equal(getattr(model, c), getattr(one[g], c)) for c in ("base", "feature", "threshold", "value", "rows"))
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    monkeypatch.setattr(boosting, "DIRECT_PARTS", 3)
    blocks = boosting.fit_groups(df, "fold", 3, NAMES, settings=settings)
    assert set(blocks) == set(one) == {0, 1, 2}
    for g, model in one.items():
        assert np.array_equal(blocks[g].feature, model.feature) and np.array_equal(blocks[g].threshold, model.threshold) and np.array_equal(blocks[g].rows, model.rows)
        np.testing.assert_allclose(blocks[g].value, model.value, rtol=1e-9)


def test_edges_over_tasks_are_exact(spark):
    x, y = table(8, 3000)
    group = np.arange(3000) % 2
    x[group == 1, 3] = np.nan
    df = frame(spark, x, y, group).repartition(6)
    got = binned.exact_edges(binned.fit_columns(df, "fold", NAMES, "y_aqi"), len(NAMES), 32)
    for g in (0, 1):
        for j in range(len(NAMES)):
            assert np.array_equal(got[g][j], boosting.bin_edges(x[group == g, j], 32))


def test_lost_predictions_are_made_again(tmp_path, monkeypatch):
    monkeypatch.setattr(boosting.tempfile, "gettempdir", lambda: str(tmp_path))
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 129, (2, 50)).astype(np.uint8)
    trees = [(np.array([0, 1, 1], np.int16), np.array([60, 30, 255], np.uint8), rng.normal(size=4)) for _ in range(3)]
    want = 5.0 + sum(boosting._leaves(codes, *t) for t in trees)

    def work(round_, history):
        return boosting._Work("w", round_, {}, {0: trees[round_ - 1]}, history, {0: 5.0}, {0: 50}, Settings())

    assert work(3, None).fitted(0, 0, codes) is None
    np.testing.assert_allclose(work(3, {0: trees}).fitted(0, 0, codes), want)
    assert np.array_equal(work(3, None).fitted(0, 0, codes), work(3, {0: trees}).fitted(0, 0, codes))
    for round_ in range(4):
        kept = work(round_, None).fitted(0, 1, codes)
    np.testing.assert_allclose(kept, want)


def test_backtest_is_fitted_on_all_rows(spark, monkeypatch):
    n = 250_000
    step = F.col("id")
    rows = spark.range(n).select(
        F.lit("a").alias("city"), F.timestamp_seconds(step * 60 + 1_704_067_200).alias("datetime"), F.lit(1).alias("horizon"),
        (step % 100).cast("double").alias("aqi_anchor"), (step % 90).cast("double").alias("y_aqi"),
    )
    seen, fit = {}, boosting.fit_groups

    def record(samples, group, *args, **kwargs):
        seen.update({r[0]: r[1] for r in samples.groupBy(group).count().collect()})
        return fit(samples.where(F.col("horizon") == 1).limit(1000), group, *args, **kwargs)

    monkeypatch.setattr(boosting, "fit_groups", record)
    evaluation.walk_forward_boosted(rows, 5, features=("aqi_anchor",), settings=Settings(rounds=1, depth=1))
    part = n // 6
    assert seen == {i: n - (6 - i) * part for i in range(1, 6)} and seen[5] > 200_000


def test_table_attribution_looks_up_few_narrow_tables(monkeypatch):
    x, y = table(10, 900)
    model = boosting.grow(x, y, NAMES, Settings(rounds=3, depth=8, rate=0.3))
    feature, cut, edges, kind, last = model.codes
    monkeypatch.setattr(attribution, "TABLE_ROWS", 1)
    shared = type("Shared", (), {"value": ((feature, model.threshold, model.value, model.rows, cut), edges, kind, last)})
    taken, take = [], np.take

    def counted(values, *args, **kwargs):
        taken.append(values.shape[1] * len(args[0]) if values.ndim == 2 else 0)
        return take(values, *args, **kwargs)

    names = [*NAMES, *(f"unused{i}" for i in range(20))]
    wide = attribution._table_explainer(type("Shared", (), {"value": (shared.value[0], [*edges, *[np.zeros(0)] * 20], kind, last)}), None, 0.0, names)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in [*x.T, *np.zeros((20, len(x)))]], names)
    monkeypatch.setattr(np, "take", counted)
    (out,) = wide([batch])
    # 32 tables a tree of at most the inputs it uses, and its answers; one of 64 tables of all inputs before
    assert sum(taken) <= 3 * len(x) * (32 * len(NAMES) + len(NAMES) * 8)
    phi = np.array(out.column("phi").to_pylist())
    np.testing.assert_allclose(model.base + attribution._expected(attribution.tree_leaves(model)[0]) + phi.sum(axis=1), model.score(x), atol=1e-9)
    assert not phi[:, len(NAMES):].any()
