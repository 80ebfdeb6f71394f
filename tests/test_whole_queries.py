from pyspark.sql import functions as F

import __spark_entry__
from nodalis.operators import projection
from nodalis.sources import market

AT = __spark_entry__.SMOKE_DIR


def values(rows, *names):
    return {tuple(r) for r in rows.select(*names).distinct().collect()}


def test_queries_without_sql_cover_their_relations(spark):
    found = {n: __spark_entry__.queries()[n](spark, AT) for n in ("mst_edges", "monte_carlo", "ridge_sf", "source_scores")}
    mu, sf = market.shadow_prices(spark, AT), market.shift_factors(spark, AT)
    near = projection.reach(sf, 0.5, 0.05, 20).groupBy("key").agg(F.count_distinct("sp").alias("n")).where("n > 1")
    assert values(found["mst_edges"], "key") == values(near, "key")
    nodes, known = values(sf, "sp"), mu.join(sf.select("key").distinct(), "key", "left_semi")
    assert values(found["ridge_sf"], "sp") == values(found["monte_carlo"], "sp") == nodes
    assert len(values(found["monte_carlo"], "ts")) > 0.9 * known.select("ts").distinct().count() > 48
    assert max(r.n_hours for r in found["source_scores"].collect()) > 48
