"""Study and final postings of a delivery day, as a stream.

A day's documents are posted on the day before, the study before an hour of local time and the final
from then on; of each side the newest posting counts, so a correction supersedes what it corrects, and
of equally new ones the larger document. A day is open until the watermark passes its local midnight;
then its sides are emitted once and its state is dropped. State is one row a day, whatever is posted.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nodalis.functions.clock import ZONE

BEFORE_HOUR = 10  # local hour from which a posting is a final
_STATE = "study_posted long, study_doc long, study_n long, final_posted long, final_doc long, final_n long"
_ROWS = "day date, side string, posted timestamp, doc long, postings long"


def _local(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, ZONE)


def side_of(posted: Column, before: int = BEFORE_HOUR) -> Column:
    return F.when(F.hour(_local(posted)) < before, "study").otherwise("final")


def of_posting_day(postings: DataFrame) -> DataFrame:
    """The postings (day, posted, doc) of each delivery day's own posting day."""
    return postings.where(F.to_date(_local(F.col("posted"))) == F.date_sub("day", 1))


def sides(postings: DataFrame, before: int = BEFORE_HOUR) -> DataFrame:
    """(day, side, posted, doc, postings): the newest posting of each side, from a table."""
    newest = F.max(F.struct("posted", "doc")).alias("m")
    grouped = of_posting_day(postings).groupBy("day", side_of(F.col("posted"), before).alias("side")).agg(newest, F.count(F.lit(1)).alias("postings"))
    return grouped.select("day", "side", "m.posted", "m.doc", "postings")


def _micros(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(ZONE)).timestamp() * 1_000_000)


def _keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    day = key[0]
    if state.hasTimedOut:
        held = list(state.get)
        state.remove()
        found = [(day, side, pd.Timestamp(at, unit="us"), doc, n) for side, (at, doc, n) in (("study", held[:3]), ("final", held[3:])) if n]
        yield pd.DataFrame(found, columns=["day", "side", "posted", "doc", "postings"])
        return
    held = list(state.get) if state.exists else [-1, -1, 0] * 2
    for frame in frames:
        for side, posted, doc in zip(frame["side"], frame["micros"], frame["doc"], strict=True):
            at = 0 if side == "study" else 3
            held[at : at + 3] = *max(tuple(held[at : at + 2]), (int(posted), int(doc))), held[at + 2] + 1
    state.update(tuple(held))
    state.setTimeoutTimestamp(max(_micros(day) // 1000, state.getCurrentWatermarkMs() + 1))


def closed_sides(postings: DataFrame, before: int = BEFORE_HOUR, late: str = "2 hours") -> DataFrame:
    """(day, side, posted, doc, postings) of a stream of postings (day, posted, doc), once a day is closed:
    when postings later than ``late`` after the day's local midnight have been seen. ``postings`` counts
    what came for the side before that; a posting that comes after it is dropped."""
    rows = of_posting_day(postings).withWatermark("posted", late).select("day", "posted", side_of(F.col("posted"), before).alias("side"), F.unix_micros("posted").alias("micros"), F.col("doc").cast("long").alias("doc"))
    return rows.groupBy("day").applyInPandasWithState(_keep, _ROWS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
