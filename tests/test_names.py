import random

import pytest

from nodalis.operators import names


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_ratio():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ("".join(draw.choice("ABC ") for _ in range(draw.randint(0, 80))) for _ in "ab")
        assert names.common_length(a, b) == lcs(a, b)
    assert names.set_ratio(["CALPINE"], ["CALPINE", "HIDALGO"]) == 100
    assert names.set_ratio(["ODESA"], ["ODESSA"]) == pytest.approx(200 * 5 / 11)
    assert names.set_ratio([], ["A"]) == 0


WORDS = ["BUFFALO", "GAP", "WIND", "FARM", "SOLAR", "ENERGY", "POWER", "CENTER", "ODESSA", "ECTOR", "HIDALGO", "MAGIC", "VALLEY", "LLC", "A", "OF", "SWEETWATER", "CREEK"]


def made(n, seed):
    """Names of some frequent words, many of them misspelt."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        name = [w if draw.random() < 0.7 else w[: (i := draw.randrange(len(w)))] + draw.choice(["", "X", w[i]]) + w[i + draw.randint(0, 1) :] for w in draw.choices(WORDS, k=draw.randint(1, 4))]
        out.append(sorted({w for w in name if w}))
    return [x for x in out if x]


@pytest.mark.parametrize("cutoff", [67.0, 75.0, 90.0])
def test_no_pair_is_lost(spark, cutoff):
    left, right = made(120, 2), made(160, 3)
    frames = [spark.createDataFrame([(x,) for x in side], "words array<string>") for side in (left, right)]
    got = {(tuple(r.lw), tuple(r.rw)): r.score for r in names.similar(*frames, cutoff).collect()}
    want = {(tuple(a), tuple(b)): s for a in left for b in right if (s := names.set_ratio(a, b)) >= cutoff}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_low_cutoffs_are_refused(spark):
    frame = spark.createDataFrame([(["A"],)], "words array<string>")
    with pytest.raises(ValueError):
        names.similar(frame, frame, 60.0)
    assert names.similar(frame.limit(0), frame, 70.0).count() == 0


def test_sources_and_capacities(spark):
    pool = spark.createDataFrame(
        [(1, "Buffalo Gap", "Buffalo Gap", "wind", 120.0), (2, "Buffalo Gap 2", "Buffalo Gap 2", "wind", 230.0), (3, "Calpine Hidalgo", "Hidalgo", "gas", 500.0), (4, "Calpine Magic", "Magic Valley", "gas", 700.0), (5, "Odessa Ector", "Odessa", None, None), (6, "Buffalo Gap", "Buffalo Gap", "solar", 119.0)],
        "p long, pool_name string, site string, source string, mw double",
    )
    queries = spark.createDataFrame(
        [(1, "BUFFALO GAP", "wind", 225.0), (2, "BUFFALO GAP", "wind", 0.0), (3, "CALPINE", "gas", 600.0), (4, "ODESA ECTOR", "gas", 0.0), (5, "ODESSA", None, 0.0), (6, "BUFALO GAP", "solar", 0.0), (7, "", "gas", 1.0), (8, None, None, None), (9, "NOTHING LIKE IT", None, 1.0), (10, "BUFFALO GAP", None, 119.4)],
        "q long, name string, source string, mw double",
    )
    got = {r.q: (r.p, r.tied) for r in names.best_compatible(queries, pool).collect()}
    # tied without a capacity (2), or with sites that share no word (3), is no match
    assert got == {1: (2, 2), 4: (5, 1), 5: (5, 1), 6: (6, 1), 10: (6, 3)}


def test_copies_are_told_apart_without_their_pairs(spark):
    pool = spark.range(400).selectExpr("id AS p", "'Buffalo Gap' AS pool_name", "'Buffalo Gap' AS site", "'wind' AS source", "CAST(100 + id % 7 * 10 AS DOUBLE) AS mw")
    queries = spark.range(300).selectExpr("id AS q", "'BUFFALO GAP' AS name", "'wind' AS source", "CAST(95 + id % 9 * 10 AS DOUBLE) AS mw")
    got = names.best_compatible(queries, pool)
    found = {r.q: (r.p, r.tied) for r in got.collect()}
    want = {q: min((abs(100 + p % 7 * 10 - (95 + q % 9 * 10)), p) for p in range(400))[1] for q in range(300)}
    assert found == {q: (p, 400) for q, p in want.items()}
    assert "Window" in got._jdf.queryExecution().executedPlan().toString()  # one sort of capacities
