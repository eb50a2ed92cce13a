import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import boosting, models, perceptron, training
from ledgerline.operators.splits import FoldRules, distinct_dates, walk_forward
from ledgerline.sources.scratch import shared_dir


def curved(spark, n=1500, seed=1, parts=4, classes=3):
    """A target that bends with a and jumps with b, and its class; c is noise, some values are missing."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.uniform(-2, 2), r.uniform(-2, 2), r.gauss(0, 1)
        y = a * a + (1.0 if b > 0.3 else -1.0) + r.gauss(0, 0.1)
        rows.append((date(2020, 1, 1) + timedelta(days=i // 10), f"T{i % 10}", a, b if i % 50 else None, c, y, float(min(classes - 1, max(0, int(y + 0.8))))))
    return spark.createDataFrame(rows, "date date, ticker string, a double, b double, c double, y double, label double").repartition(parts)


def log_loss(rows, label="label"):
    return rows.agg(F.avg(-F.log(F.greatest(F.element_at("probabilities", F.col(label).cast("int") + 1), F.lit(1e-12))))).first()[0]


def plain_stumps(x, y, classes, edges, rounds, rate=0.1, penalty=1.0, least=5):
    """Brute force: every cut of every feature, by the rows themselves."""
    n, f = x.shape
    size = np.bincount(y, minlength=classes)
    w = np.array([n / (classes * s) for s in size])[y]
    scores = np.tile(np.log(np.full(classes, 1 / classes)), (n, 1))
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        new = scores.copy()
        for k in range(classes):
            g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
            best = (1e-9, None)
            for j in range(f):
                for e in edges[j]:
                    left = x[:, j] <= e
                    if left.sum() < least or (~left).sum() < least:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + penalty) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + penalty)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, left)
            for s in () if best[1] is None else (best[1], ~best[1]):
                new[s, k] -= rate * g[s].sum() / (h[s].sum() + penalty)
        scores = new
    return np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)


def test_boosted_stumps_equal_brute_force(spark):
    rows = curved(spark, 300)
    columns = ["a", "b", "c"]
    model = boosting.fit_softmax_trees(rows, columns, "label", 3, rounds=4, depth=1, bins=8)
    got = model.transform(rows).orderBy("date", "ticker").collect()
    x = np.array([[r[c] or 0.0 for c in columns] for r in got])
    want = plain_stumps(x, np.array([int(r.label) for r in got]), 3, model.edges, 4)
    assert model.rounds == 4 and np.allclose([r.probabilities for r in got], want)


def test_boosting_of_three_classes_beats_the_forest_and_stops(spark, tmp_path):
    rows = curved(spark, 2000)
    train, val, test = (rows.filter(F.col("date").between(*d)) for d in (("2020-01-01", "2020-04-30"), ("2020-05-01", "2020-05-31"), ("2020-06-01", "2021-01-01")))
    columns = ["a", "b", "c"]
    boosted = boosting.fit_softmax_trees(train, columns, "label", 3, val=val, rounds=40, rate=0.3, balanced=False)
    forest = models.fit_classifier("forest", train, columns, "label", 3)
    assert log_loss(boosted.transform(test)) < log_loss(forest.transform(test))
    assert 3 < boosted.rounds < 40 and boosted.losses[boosted.rounds] == min(boosted.losses) and len(boosted.losses) == boosted.rounds + 6
    assert boosted.losses[boosted.rounds] == pytest.approx(log_loss(boosted.transform(val)))
    boosted.save(str(tmp_path / "m"))
    again = boosting.SoftmaxTrees.load(str(tmp_path / "m"))
    assert again == boosted
    with pytest.raises(ValueError, match="absent"):
        boosted.transform(test.drop("a"))


def test_boosting_does_not_depend_on_partitions_or_on_when_scores_are_written(spark, monkeypatch):
    found = []
    for parts, written in ((1, 16), (8, 2)):
        monkeypatch.setattr(boosting, "WRITTEN", written)
        found.append(boosting.fit_softmax_trees(curved(spark, 400, parts=parts), ["a", "b"], "label", 3, rounds=5))
    for a, b in zip(*(m.trees for m in found), strict=True):
        for s, t in zip(a, b, strict=True):
            assert (s.feature, s.cut) == (t.feature, t.cut) and np.allclose(s.value, t.value)


def test_boosting_of_few_classes_and_rows(spark):
    rows = curved(spark, 100)
    one = boosting.fit_softmax_trees(rows.filter("label = 1"), ["a"], "label", 3)
    assert one.rounds == 0 and np.allclose(one.transform(rows).first().probabilities, [0, 1, 0], atol=1e-9)
    none = boosting.fit_softmax_trees(rows.limit(0), ["a"], "label", 3)
    assert np.allclose(none.transform(rows).first().probabilities, [1 / 3] * 3)
    flat = boosting.fit_softmax_trees(rows.withColumn("a", F.lit(1.0)), ["a"], "label", 3)
    assert flat.rounds == 0
    with pytest.raises(ValueError, match="not all below 2"):
        boosting.fit_softmax_trees(rows, ["a"], "label", 2)


def test_perceptron_learns_a_curve_the_same_on_any_partitions(spark, tmp_path):
    rows = curved(spark, 800)
    line = models.fit_regressor("ridge", rows, ["a", "b"], "y")
    error = lambda m: m.transform(rows).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    one, eight = (perceptron.fit_perceptron(rows.repartition(n), ["a", "b"], "y", hidden=(12,), rounds=40) for n in (1, 8))
    assert error(one) < 0.35 * error(line)
    got, same = (np.array([r[0] for r in m.transform(rows).orderBy("date", "ticker").select("prediction").collect()]) for m in (one, eight))
    assert np.abs(got - same).max() < 0.05 and abs(error(one) - error(eight)) < 0.02 * error(line)
    one.save(str(tmp_path / "p"))
    assert perceptron.Perceptron.load(str(tmp_path / "p")) == one
    nothing = perceptron.fit_perceptron(rows.limit(0), ["a"], "y", hidden=(2,), rounds=2)
    assert nothing.transform(rows).first().prediction == pytest.approx(0, abs=1)


def test_gradients_equal_differences():
    r = np.random.default_rng(3)
    sizes = (3, 4, 2, 1)
    weights = r.normal(size=sum((a + 1) * b for a, b in zip(sizes[:-1], sizes[1:], strict=True)))
    x, y = r.normal(size=(20, 3)), r.normal(size=20)
    _, gradient = perceptron._gradient(perceptron._layers(weights, sizes), x, y)
    for i in range(len(weights)):
        step = np.zeros(len(weights))
        step[i] = 1e-6
        up, down = (perceptron._gradient(perceptron._layers(w, sizes), x, y)[0] for w in (weights + step, weights - step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_perceptron_keeps_the_best_of_validation(spark):
    rows = curved(spark, 200, seed=4)
    noise = rows.withColumn("y", F.col("c"))  # nothing to learn from a and b
    model = perceptron.fit_perceptron(noise.filter("date < '2020-01-10'"), ["a", "b"], "y", val=noise.filter("date >= '2020-01-10'"), hidden=(16,), rounds=60, patience=4)
    assert model.rounds < 60 and len(model.losses) == model.rounds + 5 and model.losses[model.rounds] == min(model.losses)


@pytest.mark.parametrize("kind", ["boosted_trees", "ridge"])
def test_final_fit_takes_the_rounds_of_the_early_one(spark, kind):
    rows = curved(spark, 600, seed=5)
    recipe = training.regression_recipe(kind)
    if kind == "boosted_trees":
        early = models.fit_regressor(kind, rows.filter("date < '2020-02-01'"), ["c"], "y", val=rows.filter("date >= '2020-02-01'"))
        assert early.rounds < 50
    model = training.fit_final(rows, recipe, ["c"] if kind == "boosted_trees" else ["a"], "y", FoldRules(20, 10, 5, 2))
    assert model.rounds is None if kind == "ridge" else 0 < model.rounds < 50
    assert model.transform(rows).count() == 600


def run(spark, rows, folder, recipes, **more):
    spans = walk_forward(distinct_dates(rows), FoldRules(60, 20, 20, 5))
    return training.train_walk_forward(rows, spans, recipes, {"both": ["a", "b"], "one": ["b"]}, "y", folder, {"rows": "curved"}, **more), spans


def test_a_broken_run_goes_on_where_it_stopped(spark):
    rows, folder = curved(spark, 1200), shared_dir(spark)
    ridge, calls = training.regression_recipe("ridge"), []

    def failing(train, val, columns, target, rounds):
        calls.append(train.agg(F.max("date")).first()[0])
        if len(calls) == 2:
            raise RuntimeError("lost")
        return ridge.fit(train, val, columns, target, rounds)

    flaky = training.Recipe("flaky", "regression", failing)
    with pytest.raises(RuntimeError, match="lost"):
        run(spark, rows, folder, [flaky, ridge], side_by_side=1)
    done = len(calls)
    got, spans = run(spark, rows, folder, [flaky, ridge], side_by_side=3)
    folds = max(s.fold for s in spans) + 1
    assert done == 2 * folds and len(calls) == done + 1  # only the lost cell ran again
    cells = got.collect()
    assert len(cells) == folds * 2 * 2 * 2 and {r.split for r in cells} == {"val", "oos"}
    by = {(r.fold_id, r.model_name, r.feature_set, r.split): r for r in cells}
    for (fold, model, name, split), r in by.items():
        assert r.rmse == pytest.approx(by[(fold, "ridge", name, split)].rmse) and r.row_count == 200, model
    again, _ = run(spark, rows, folder, [flaky, ridge])
    assert len(calls) == done + 1 and again.count() == len(cells)


def test_cells_learn_from_training_rows_alone(spark):
    rows = curved(spark, 1200)
    spans = walk_forward(distinct_dates(rows), FoldRules(60, 20, 20, 5))
    first = {s.split: s for s in spans if s.fold == 0}
    got, _ = run(spark, rows, shared_dir(spark), [training.regression_recipe("mean")])
    mean = rows.filter(F.col("date") <= first["train"].last).agg(F.avg("y")).first()[0]
    own = rows.filter(F.col("date").between(first["oos"].first, first["oos"].last)).agg(F.sqrt(F.avg((F.col("y") - mean) ** 2))).first()[0]
    assert got.filter("fold_id = 0 AND split = 'oos' AND feature_set = 'one'").first().rmse == pytest.approx(own)


def test_classifiers_in_a_run(spark):
    rows, folder = curved(spark, 1200), shared_dir(spark)
    spans = [s for s in walk_forward(distinct_dates(rows), FoldRules(60, 20, 20, 5)) if s.fold == 0]
    recipes = [training.classification_recipe("softmax_trees", 3, rounds=8, rate=0.5, patience=3), training.classification_recipe("logistic", 3)]
    got = training.train_walk_forward(rows, spans, recipes, {"both": ["a", "b"]}, "label", folder, {}, realized="y").collect()
    losses = {(r.model_name, r.split): r.multiclass_log_loss for r in got}
    assert len(losses) == 4 and losses[("softmax_trees", "oos")] < losses[("logistic", "oos")]
