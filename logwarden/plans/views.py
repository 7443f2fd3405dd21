"""Read queries on the store: the log list, the threat list and the threat map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import paging
from ..operators.filters import filter_map, is_anomaly, log_condition
from ..operators.geo import add_place

PLACE_COLUMNS = ("country", "city", "latitude", "longitude", "isp")

LOG_COLUMNS = [
    "ingest_seq", "timestamp", "ip", "method", "url", "status", "size", "severity", "prediction",
    "anomaly_score", "country", "city", "latitude", "longitude",
]
MAP_COLUMNS = [
    "ingest_seq", "timestamp", "ip", "country", "city", "isp", "latitude", "longitude",
    "display_severity", "threat_type", "method", "url", "status", "size", "prediction",
    "anomaly_score",
]


#: Pages so near the newest row that a few rows of each task are enough to find them.
NEAR_PAGES = 20


@dataclass
class LogPage:
    rows: DataFrame
    counts: DataFrame


def log_page(
    store: DataFrame, number: int = 1, size: int = 50, index: DataFrame | None = None, **conditions
) -> LogPage:
    """One page of the filtered log, newest first, with total, filtered and page counts.

    ``conditions`` are the arguments of ``filters.log_condition``. Pages beyond the first ``NEAR_PAGES`` are found
    by ``index`` (``paging.page_index`` of the filtered rows), which is counted here if it is not given.
    """
    condition = log_condition(**conditions)
    chosen = store.filter(condition)
    if number <= NEAR_PAGES:
        rows = paging.page(paging.newest_part(chosen, number * size), number, size)
    else:
        counts = paging.page_index(chosen) if index is None else index
        rows = paging.page_by_index(chosen, counts, number, size)
    return LogPage(
        rows.select(*LOG_COLUMNS),
        paging.page_counts(store, condition, size),
    )


def threats(store: DataFrame, n: int = 100) -> DataFrame:
    near = paging.newest_part(store.filter(is_anomaly()), n)
    return paging.latest_threats(near, n).select(*LOG_COLUMNS)


def threat_map(store: DataFrame, **conditions) -> DataFrame:
    """Store rows with full places and display severity.

    ``conditions`` are the arguments of ``filters.filter_map``.
    """
    placed = add_place(store.drop(*PLACE_COLUMNS))
    return filter_map(placed, **conditions).select(*MAP_COLUMNS)
