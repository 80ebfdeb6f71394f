"""The vocabulary beside a matrix: items that pass a choice, and what each facet still offers.

A facet's counts leave out its own choice, so that another value of it can be picked; all facets are
counted in one pass by grouping sets, over the items that fail at most one choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LISTED = 200


def listed(names: Sequence[str], what: str, most: int = MOST_LISTED) -> list[str]:
    """Distinct names of a request in order. Raises for none, for too many and for blank ones."""
    found = list(dict.fromkeys(n.strip() for n in names))
    if not found or not all(found):
        raise ValueError(f"no {what} given, or a blank one")
    if len(found) > most:
        raise ValueError(f"{len(found)} {what} given, at most {most} are served")
    return found


def holds(columns: Sequence[str], query: str | None) -> Column:
    """Whether the columns, joined by spaces, hold the text of a search, whatever its case."""
    wanted = (query or "").strip().lower()
    return F.lower(F.concat_ws(" ", *columns)).contains(wanted) if wanted else F.lit(True)


def _passes(facet: str, chosen: dict[str, Sequence[str]]) -> Column:
    values = list(chosen.get(facet) or ())
    return F.coalesce(F.col(facet).isin(*values), F.lit(False)) if values else F.lit(True)


def vocabulary(items: DataFrame, chosen: dict[str, Sequence[str]], query: str | None, searched: Sequence[str], pins: Sequence[str] = (), key: str = "key") -> DataFrame:
    """The items that pass every facet's choice and the search, with whether they are pinned."""
    kept = items.where(holds(searched, query))
    for facet in chosen:
        kept = kept.where(_passes(facet, chosen))
    return kept.withColumn("pinned", F.col(key).isin(*pins) if pins else F.lit(False))


def counts(items: DataFrame, facets: Sequence[str], chosen: dict[str, Sequence[str]], query: str | None, searched: Sequence[str]) -> DataFrame:
    """(facet, value, n, chosen): how many items each value of a facet would leave, given the other facets' choices
    and the search. Items without a value count for the other facets only."""
    if unknown := set(chosen) - set(facets):
        raise ValueError(f"no facet {sorted(unknown)}")
    failed = sum(((~_passes(f, chosen)).cast("int") for f in facets), F.lit(0))
    flagged = items.where(holds(searched, query)).select(*facets, failed.alias("_failed"), *((~_passes(f, chosen)).alias(f"_not_{f}") for f in facets)).where("_failed <= 1")
    sets = flagged.groupingSets([[F.col(f)] for f in facets], *facets)
    fits = {f: F.count_if((F.col("_failed") == 0) | F.col(f"_not_{f}")) for f in facets}
    grouped = sets.agg(*(F.grouping(f).alias(f"_g_{f}") for f in facets), *(fits[f].alias(f"_n_{f}") for f in facets))
    pick = lambda make: F.coalesce(*(F.when(F.col(f"_g_{f}") == 0, make(f)) for f in facets))
    taken = pick(lambda f: F.col(f).isin(*chosen[f]) if chosen.get(f) else F.lit(False))
    found = grouped.select(pick(F.lit).alias("facet"), pick(lambda f: F.col(f).cast("string")).alias("value"), pick(lambda f: F.col(f"_n_{f}")).alias("n"), taken.alias("chosen"))
    return found.where("value IS NOT NULL AND n > 0")
