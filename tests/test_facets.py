import random

import pytest

from nodalis.operators import facets

ITEMS = "key string, label string, a string, b string, c string"


def test_counts_leave_out_their_own_choice(spark):
    draw = random.Random(6)
    rows = [(f"k{i}", draw.choice(["Alpha", "beta"]), draw.choice(["x", "y", None]), draw.choice(["p", "q", "r"]), draw.choice(["1", "2"])) for i in range(200)]
    frame = spark.createDataFrame(rows, ITEMS)
    for chosen in ({}, {"a": ["x"]}, {"a": ["x", "y"], "b": ["q"]}, {"a": ["x"], "b": ["q"], "c": ["2"]}, {"a": ["none such"]}):
        got = {(r.facet, r.value): (r.n, r.chosen) for r in facets.counts(frame, ["a", "b", "c"], chosen, " ALPHA ", ["key", "label"]).collect()}
        want = {}
        for f, at in (("a", 2), ("b", 3), ("c", 4)):
            for row in rows:
                values = dict(zip("abc", row[2:], strict=True))
                if row[1] == "Alpha" and row[at] is not None and all(values[o] in v for o, v in chosen.items() if o != f):
                    n, _ = want.get((f, row[at]), (0, False))
                    want[f, row[at]] = n + 1, row[at] in chosen.get(f, ())
        assert got == want
        kept = facets.vocabulary(frame, chosen, "alpha", ["key", "label"], pins=["k1"])
        assert kept.count() == sum(r[1] == "Alpha" and all(dict(zip("abc", r[2:], strict=True))[o] in v for o, v in chosen.items()) for r in rows)
    with pytest.raises(ValueError):
        facets.counts(frame, ["a"], {"b": ["q"]}, None, ["key"])
    assert facets.counts(frame.limit(0), ["a", "b"], {}, None, ["key"]).count() == 0


def test_lists_of_a_request():
    assert facets.listed(["a", " b", "a"], "nodes") == ["a", "b"]
    for bad in ([], ["a", " "], [str(i) for i in range(201)]):
        with pytest.raises(ValueError):
            facets.listed(bad, "nodes")
