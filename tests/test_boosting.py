import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from nodalis.operators import boosting, models

FEATURES = ["a", "b", "c"]


def table(n=900, seed=1):
    """A planted rule with holes: y follows a where it is known, and its absence where not; b is coarse."""
    draw = np.random.default_rng(seed)
    a, b, c = draw.normal(size=n), draw.integers(0, 6, n).astype(float), draw.random(n)
    a[draw.random(n) < 0.2] = np.nan
    b[draw.random(n) < 0.1] = np.nan
    odds = np.where(np.isnan(a), 1.5, np.where(a > 0.3, 2.0, -2.0)) + np.where(b == 3, 1.5, 0.0)
    y = (draw.random(n) < 1 / (1 + np.exp(-odds))).astype(float)
    return np.stack([a, b, c]), y


def frame(spark, x, y):
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in x[:, i]) + (float(y[i]), i) for i in range(len(y))]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, id long")


def plain_fit(x, y, edges, s):
    """The same model by one loop over all splits of all leaves, with values in place of bins."""
    start = np.log(y.mean() / (1 - y.mean())) if s.loss == "log" else y.mean()
    score, predictors = np.full(len(y), start), []

    def sides(f, cut, hole_left, z):
        return np.where(np.isnan(z[f]), hole_left, z[f] <= cut)

    def best(rows, g, h):
        found = None
        for f in range(len(x)):
            holes = np.isnan(x[f, rows]).any()
            for hole_left in (False, True) if holes else (None,):
                for cut in [*edges[f], np.inf]:
                    low = sides(f, cut, bool(hole_left), x[:, rows])
                    left, right = rows[low], rows[~low]
                    if min(len(left), len(right)) < s.min_leaf or min(h[left].sum(), h[right].sum()) < 1e-3:
                        continue
                    part = lambda r: g[r].sum() ** 2 / (h[r].sum() + s.l2)
                    gain = part(left) + part(right) - part(rows)
                    if gain > 0 and (found is None or gain > found[0] + 1e-9):
                        found = gain, f, cut, len(left) > len(right) if hole_left is None else hole_left, left, right
        return found

    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y, p * (1 - p)) if s.loss == "log" else (score - y, np.ones(len(y)))
        leaves, splits = [np.arange(len(y))], []
        while len(leaves) < s.leaves:
            options = [(b[0], i, b) for i, r in enumerate(leaves) if (b := best(r, g, h))]
            if not options:
                break
            _, i, b = max(options, key=lambda o: (o[0], -o[1]))
            splits.append((i, *b[1:4]))
            leaves[i] = b[4]
            leaves.append(b[5])
        values = [-s.rate * g[r].sum() / (h[r].sum() + s.l2) for r in leaves]
        for r, v in zip(leaves, values, strict=True):
            score[r] += v
        predictors.append((splits, values))

    def predict(z):
        out = np.full(z.shape[1], start)
        for splits, values in predictors:
            at = np.zeros(z.shape[1], int)
            for n, (i, f, cut, hole_left) in enumerate(splits, 1):
                at[(at == i) & ~sides(f, cut, hole_left, z)] = n
            out += np.array(values)[at]
        return out

    return predict


@pytest.mark.parametrize(("loss", "parts"), [("log", 1), ("log", 3), ("squares", 3)])
def test_equals_a_plain_booster(spark, loss, parts, monkeypatch):
    if parts > 1:
        monkeypatch.setattr(boosting, "PARTITION_ROWS", 1)
    x, y = table()
    y = y if loss == "log" else y * 3 + np.nan_to_num(x[0])
    s = boosting.Settings(loss, rounds=4, rate=0.3, leaves=6, min_leaf=40)
    rows = frame(spark, x, y).repartition(parts)
    model = boosting.fit(rows, FEATURES, "y", s)
    assert len(model.trees) == 4
    want = plain_fit(x, y, model.edges, s)
    z, _ = table(200, 2)
    got = {r.id: r.p for r in model.predict(frame(spark, z, np.zeros(200)), "p").collect()}
    raw = want(z)
    assert np.allclose([got[i] for i in range(200)], 1 / (1 + np.exp(-raw)) if loss == "log" else raw, atol=1e-9)


def test_edges_are_quantiles_or_all_values(spark):
    x, y = table(4000)
    a, b, c = boosting.edges_of(frame(spark, x, y), FEATURES)
    assert b.tolist() == [0, 1, 2, 3, 4]
    assert 200 < len(c) <= 254 and abs(np.searchsorted(c, 0.5) / len(c) - 0.5) < 0.03


def test_leaves_of_one_pass_per_level():
    """Best-first growth asks for all leaves of a level at once, and never for more than can be used."""
    draw, calls, gain = np.random.default_rng(4), [], {0: 1.0}

    def best_of(tree, leaves):
        calls.append(len(leaves))
        for n in range(len(tree.feature)):
            if tree.feature[n] >= 0:
                for child in (tree.left[n], tree.right[n]):
                    gain.setdefault(child, gain[n] * draw.uniform(0.2, 0.8))
        return {n: boosting.Split(0, 1, False, gain[n], gain[n], -gain[n]) for n in leaves}

    tree = boosting.grow(best_of, boosting.Settings(leaves=31))
    assert sum(f < 0 for f in tree.feature) == 31
    assert len(calls) <= 10 and max(calls) <= 60


def test_best_first_equals_one_split_at_a_time():
    """What a pass looks at in advance does not change which splits are taken."""
    gains = {(): 9.0, (0,): 3.0, (1,): 8.0, (1, 0): 1.0, (1, 1): 7.0, (0, 0): 2.5, (0, 1): 0.1, (1, 1, 0): 6.0, (1, 1, 1): 0.2}

    def best_of(tree, leaves):
        paths, out = {0: ()}, {}
        for n, f in enumerate(tree.feature):
            if f >= 0:
                paths |= {tree.left[n]: (*paths[n], 0), tree.right[n]: (*paths[n], 1)}
        for n in leaves:
            if paths[n] in gains:
                out[n] = boosting.Split(len(paths[n]), 0, False, gains[paths[n]], 0.0, 0.0)
        return out

    tree = boosting.grow(best_of, boosting.Settings(leaves=6))
    taken, paths = [], {0: ()}
    for n, f in enumerate(tree.feature):
        if f >= 0:
            taken.append(gains[paths[n]])
            paths |= {tree.left[n]: (*paths[n], 0), tree.right[n]: (*paths[n], 1)}
    assert sorted(taken, reverse=True) == [9.0, 8.0, 7.0, 6.0, 3.0]


def test_planted_rule_with_holes_and_scores(spark):
    x, y = table(2500, 7)
    rows = frame(spark, x, y).withColumn("y_bind", F.col("y").cast("int")).withColumn("y_mu", F.when(F.col("y") > 0, F.exp(3 + F.coalesce(F.nanvl("a", F.lit(None)), F.lit(2.0)))))
    scored = models.mu_head(rows, models.bind_head(rows, rows, FEATURES, rounds=12, rate=0.25), FEATURES, rounds=12, rate=0.3)
    means = {r.rule: r for r in scored.groupBy(F.when(F.col("a").isNull() | F.isnan("a"), "hole").when(F.col("a") > 0.3, "high").otherwise("low").alias("rule")).agg(F.avg("p_bind").alias("p"), F.avg("y").alias("y"), F.expr("percentile(mu_gbm, 0.5)").alias("mu")).collect()}
    for r in means.values():
        assert abs(r.p - r.y) < 0.05
    assert means["hole"].mu > means["high"].mu > means["low"].mu
    assert {"id", "y_mu", "p_bind", "mu_gbm"} <= set(scored.columns)


def test_inputs_are_computed_once(spark):
    """Mean, edges and blocks each computed the rows anew, and with them the panel below."""
    x, y = table(500)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = frame(spark, x, y)
    boosting.fit(rows.mapInArrow(counted, rows.schema), FEATURES, "y", boosting.Settings(rounds=1, leaves=3))
    assert seen.value == 500


def test_empty_and_constant(spark):
    x, y = table(60)
    rows = frame(spark, x, y)
    assert boosting.fit(rows.limit(0), FEATURES, "y", boosting.Settings()).trees == []
    model = boosting.fit(rows.withColumn("y", F.lit(0.0)), FEATURES, "y", boosting.Settings(min_leaf=5, rounds=3))
    assert max(r.p for r in model.predict(rows, "p").collect()) < 1e-6


def test_registered_heads_run_the_rounds_of_the_reference(spark, monkeypatch):
    """They ran 20 of its 200 rounds."""
    seen, fit = [], boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda rows, features, label, settings: seen.append(settings) or fit(rows, features, label, settings))
    for name in ("bind_head", "mu_head"):
        assert __spark_entry__.queries()[name](spark, __spark_entry__.SMOKE_DIR).count()
    assert [(s.rounds, s.rate, s.leaves, s.min_leaf, s.l2) for s in seen] == [(200, 0.06, 31, 100, 1.0), (200, 0.06, 31, 50, 1.0)]


def test_rows_of_equal_bins_are_one(spark):
    """Copies of the rows make the same trees, and no more rows to pass over; the sums of labels are exact."""
    x, y = table(700)
    y = y * 3.1 + np.nan_to_num(x[0])
    x[0], x[2] = np.round(x[0], 1), np.round(x[2], 1)
    rows = frame(spark, x, y)
    edges = boosting.edges_of(rows, FEATURES)
    one, many = (boosting.merged(r, FEATURES, "y", edges, float(np.abs(y).max()), 700 * k) for r, k in ((rows, 1), (rows.withColumn("copy", F.explode(F.lit([0] * 8))).repartition(3), 8)))
    one, many = ({bytes(r.bins): (r.n, r.y) for r in m.collect()} for m in (one, many))
    assert one.keys() == many.keys() and len(one) < 700
    assert all((8 * n, 8 * t) == pytest.approx(many[k], abs=1e-12) for k, (n, t) in one.items())
    assert sum(t for _, t in one.values()) == pytest.approx(y.sum(), abs=1e-10)
    s = boosting.Settings("squares", rounds=3, leaves=6, min_leaf=1)
    again = [boosting.fit(rows.repartition(k), FEATURES, "y", s).trees for k in (1, 3)]
    assert all(np.allclose(p, q, atol=1e-12) for t, u in zip(*again, strict=True) for p, q in zip(t, u, strict=True))
