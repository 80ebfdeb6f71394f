"""Spatial and fuzzy matching as equi-joins on cells and tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodalis.functions.fields import haversine_km
from nodalis.operators.graphs import cut


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring (array of structs x, y; closed by itself), by counting crossings.
    Points on an edge lie on neither side."""

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    def touches(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        along = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return along & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    edges = F.sequence(F.lit(0), F.size(ring) - 1)
    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, touches)


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def ring_distance2(x: Column, y: Column, ring: Column) -> Column:
    """Squared distance of a point from a ring's nearest edge."""

    def edge(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        along = F.coalesce(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return (x - a["x"] - t * dx) ** 2 + (y - a["y"] - t * dy) ** 2

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), edge))


def _laid(zones: DataFrame, reach: float, cell: float) -> DataFrame:
    """Zones in the cells of their bounding boxes, widened by ``reach``."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = zones.select("zone", "ring", F.explode(_cells(F.array_min(xs) - reach, F.array_max(xs) + reach, cell)).alias("cx"), F.array_min(ys).alias("lo"), F.array_max(ys).alias("hi"))
    return boxed.select("zone", "ring", "cx", F.explode(_cells(F.col("lo") - reach, F.col("hi") + reach, cell)).alias("cy"))


def assign_zone(points: DataFrame, zones: DataFrame, key: str, cell: float = 1.0) -> DataFrame:
    """Each point (key, x, y) with the first zone (zone, ring) that holds it, else the one with the nearest
    edge, ties to the first; points without coordinates have no zone.

    Zones are laid out into the cells of their bounding boxes; only zones of a point's own cell are
    tested. For points that no zone holds the boxes are widened step by step, doubling: a zone within
    the step's reach is found in the point's cell, so what is found nearer than that is the nearest."""

    def near(rest: DataFrame, reach: float, size: float) -> DataFrame:
        return rest.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size)).join(_laid(zones, reach, size), ["cx", "cy"])

    held = near(points, 0.0, cell).where(in_ring(F.col("x"), F.col("y"), F.col("ring")))
    inside = held.groupBy(key).agg(F.min("zone").alias("zone"))
    found = [inside.withColumn("method", F.lit("within"))]
    rest = cut(points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").join(inside, key, "left_anti"))
    reach = cell
    zones = zones.where(F.size("ring") > 0)
    while not zones.isEmpty() and not rest.isEmpty() and reach < 1e12:
        away = near(rest, reach, reach).withColumn("d", ring_distance2(F.col("x"), F.col("y"), F.col("ring"))).where(F.col("d") <= reach**2)
        nearest = cut(away.groupBy(key).agg(F.min(F.struct("d", "zone"))["zone"].alias("zone")))
        found.append(nearest.withColumn("method", F.lit("nearest")))
        rest, reach = cut(rest.join(nearest, key, "left_anti")), 2 * reach
    return reduce(DataFrame.unionByName, found)


def radius_match(left: DataFrame, right: DataFrame, key: str, km: float, condition: Column | None = None, degrees: float | None = None) -> DataFrame:
    """Each left row (key, lat, lon) with its nearest right row (id, lat_r, lon_r) within ``km``, if any.

    Both sides are cut into bands of latitude wider than the radius, and each band into cells that are
    as wide on the ground at its end nearer to a pole; cells close around the globe. A right row is sent
    to its own band and the two beside it, and there to its own cell and the two beside that. Rows that
    differ in nothing but ``key`` or ``id`` are one row each while pairs are formed: what meets are places."""
    size = degrees or 2 * km / 111.0
    asked = [c for c in left.columns if c != key]
    rows, left = left, left.select(*asked).where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    right = right.groupBy(*(c for c in right.columns if c != "id")).agg(F.min("id").alias("id"))

    def cells(band: Column) -> Column:
        """How many cells a band has: they hold for rows of the bands beside it too."""
        edge = F.least(F.lit(89.9), F.greatest(F.abs((band - 1) * size), F.abs((band + 2) * size)))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / size)).cast("long")

    def cell(lon: Column, band: Column) -> Column:
        return F.pmod(F.floor(F.pmod(lon, F.lit(360.0)) / 360 * cells(band)), cells(band))

    band, band_r = F.floor(F.col("lat") / size), F.floor(F.col("lat_r") / size)
    near = F.array_distinct(F.array(*(F.struct((band_r + i).alias("i"), F.pmod(cell(F.col("lon_r"), band_r + i) + j, cells(band_r + i)).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    sent = right.withColumn("cell", F.explode(near))
    meet = (F.col("_i") == F.col("cell.i")) & (F.col("_j") == F.col("cell.j"))
    pairs = left.withColumn("_i", band).withColumn("_j", cell(F.col("lon"), band)).join(sent, meet if condition is None else meet & condition)
    away = haversine_km(F.col("lat"), F.col("lon"), F.col("lat_r"), F.col("lon_r"))
    nearest = pairs.withColumn("km", away).where(F.col("km") <= km).groupBy(*asked).agg(F.min(F.struct("km", "id")).alias("m"))
    found = nearest.select(*(F.col(c).alias(f"_{c}") for c in asked), "m")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in asked))
    return rows.join(found, same).groupBy(key).agg(F.min("m").alias("m")).select(key, F.col("m.id").alias("id"), F.col("m.km").alias("km"))


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Sorted distinct upper-case words of a name, without digits and stop words."""
    words = F.split(F.upper(F.regexp_replace(text, "[^A-Za-z]+", " ")), " +")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*(stop or ("",))))))


def ratio(a: Column, b: Column) -> Column:
    """100 times one minus the edit distance over the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 100 * (1 - F.levenshtein(a, b) / longer)).otherwise(100.0)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio among the shared words, and the shared words with either side's rest."""
    join = lambda x: F.array_join(x, " ")
    shared = F.array_sort(F.array_intersect(a, b))
    one = F.trim(F.concat_ws(" ", join(shared), join(F.array_sort(F.array_except(a, b)))))
    two = F.trim(F.concat_ws(" ", join(shared), join(F.array_sort(F.array_except(b, a)))))
    some = F.size(shared) > 0
    return F.greatest(F.when(some, ratio(join(shared), one)).otherwise(0.0), F.when(some, ratio(join(shared), two)).otherwise(0.0), ratio(one, two))


def fuzzy_match(queries: DataFrame, pool: DataFrame, cutoff: float, stop: tuple[str, ...] = ()) -> DataFrame:
    """(q, p, score): each query (q, name) with its best pool entry (p, pool_name) that shares a word and
    reaches the cutoff; ties to the smaller p.

    Names with the same words are one on either side, so what is compared grows with distinct names."""
    named = queries.select("q", tokens(F.col("name"), stop).alias("qt"))
    entries = pool.select("p", tokens(F.col("pool_name"), stop).alias("pt")).groupBy("pt").agg(F.min("p").alias("p"))
    index = entries.select("p", "pt", F.explode("pt").alias("word"))
    asked = named.select("qt").distinct()
    pairs = asked.select("qt", F.explode("qt").alias("word")).join(index, "word").select("p", "qt", "pt").distinct()
    scored = pairs.select("qt", "p", token_set_ratio(F.col("qt"), F.col("pt")).alias("score")).where(F.col("score") >= cutoff)
    best = scored.groupBy("qt").agg(F.min(F.struct((-F.col("score")).alias("s"), "p")).alias("m"))
    return named.join(best, "qt").select("q", F.col("m.p").alias("p"), (-F.col("m.s")).alias("score"))


def prefix_match(stations: DataFrame, points: DataFrame, least: int = 3) -> DataFrame:
    """Each station (station) with the longest of its prefixes that exactly one point (sp) starts with."""
    laid = stations.select("station", F.explode(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length("station")))).alias("n")).where(F.col("n") <= F.length("station"))
    starts = points.select("sp", F.explode(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length("sp")))).alias("n")).where(F.col("n") <= F.length("sp"))
    single = starts.select(F.substr("sp", F.lit(1), F.col("n")).alias("prefix"), "sp").groupBy("prefix").agg(F.count_distinct("sp").alias("c"), F.min("sp").alias("sp")).where("c = 1").drop("c")
    met = laid.select("station", F.substr("station", F.lit(1), F.col("n")).alias("prefix"), "n").join(single, "prefix")
    return met.groupBy("station").agg(F.max_by("sp", "n").alias("sp"), F.max("n").alias("length"))


def override(rows: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """Coordinates replaced by hand; (0, 0) takes them away."""
    gone = (F.col("m_lat") == 0) & (F.col("m_lon") == 0)
    joined = rows.join(manual, key, "left")
    return joined.withColumn("lat", F.when(gone, None).otherwise(F.coalesce("m_lat", "lat"))).withColumn("lon", F.when(gone, None).otherwise(F.coalesce("m_lon", "lon"))).drop("m_lat", "m_lon")


def keep_first(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def features(points: DataFrame) -> DataFrame:
    """One GeoJSON feature a row; rows without coordinates are left out."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return points.where("lat IS NOT NULL AND lon IS NOT NULL").select("sp", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("sp").alias("properties"))).alias("feature"))
