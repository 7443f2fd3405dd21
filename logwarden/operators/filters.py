"""Row predicates. Apply them after the rules: trailing counts need every row."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import contains_ignore_case


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equals_ignore_case(column: Column, text: str) -> Column:
    return F.lower(column) == F.lower(F.lit(text))


def matches_search(term: str) -> Column:
    """One term in the address, the url or the threat type."""
    return (
        contains_ignore_case(F.col("ip"), term)
        | contains_ignore_case(F.col("url"), term)
        | contains_ignore_case(F.col("threat_type"), term)
    )


def is_anomaly() -> Column:
    return F.col("prediction") == "Anomaly"


def is_failed_request() -> Column:
    return F.col("status") >= 400


def is_high_alert() -> Column:
    return F.col("severity").isin("High", "Critical")


def is_threat_country() -> Column:
    return ~F.col("country").isin(V.NOT_A_THREAT_COUNTRY)


def oldest_kept(seconds: int, as_of: Column | dt.datetime) -> Column:
    return F.lit(as_of) - F.expr(f"INTERVAL '{seconds}' SECOND")


def within(seconds: int, as_of: Column | dt.datetime) -> Column:
    """Rows of the last ``seconds`` before ``as_of``; rows without a time pass."""
    time = F.col("event_time")
    return time.isNull() | (time >= oldest_kept(seconds, as_of))


def within_dates(rows: DataFrame, seconds: int, as_of: Column | dt.datetime) -> list[Column]:
    """``within``, and the same on the store's date folders so that old ones are not read."""
    conditions = [within(seconds, as_of)]
    if "event_date" in rows.columns:
        date = F.col("event_date")
        conditions.append(date.isNull() | (date >= F.to_date(oldest_kept(seconds, as_of))))
    return conditions


def batch_seconds(name: str) -> int | None:
    """1h, 6h or 24h; any other name is no filter."""
    return V.BATCH_TIME_RANGES.get(name)


def map_seconds(name: str) -> int:
    """1h, 24h or 7d; any other name is one year."""
    return V.MAP_TIME_RANGES.get(name, V.MAP_TIME_RANGE_OTHER)


def latest_event_time(rows: DataFrame) -> dt.datetime | None:
    """The default ``as_of``: a single value, read from the data."""
    return rows.agg(F.max("event_time")).first()[0]


def filter_batch(
    rows: DataFrame,
    search_ip: str = "",
    search_url: str = "",
    status_code: int | None = None,
    severity: str = "",
    threat_type: str = "",
    time_range: str = "all",
    as_of: Column | dt.datetime | None = None,
) -> DataFrame:
    """Filters of a batch analysis; severity is a display name. Empty values filter nothing."""
    conditions = []
    if search_ip:
        conditions.append(contains_ignore_case(F.col("ip"), search_ip))
    if search_url:
        conditions.append(contains_ignore_case(F.col("url"), search_url))
    if status_code is not None:
        conditions.append(F.col("status") == status_code)
    if severity:
        conditions.append(equals_ignore_case(F.col("display_severity"), severity))
    if threat_type:
        conditions.append(contains_ignore_case(F.col("threat_type"), threat_type))
    seconds = batch_seconds(time_range)
    if seconds is not None:
        end = latest_event_time(rows) if as_of is None else as_of
        conditions += within_dates(rows, seconds, end)
    return rows.filter(_all(conditions))


def log_condition(
    search: str | None = None,
    ip: str | None = None,
    status_code: int | None = None,
    severity: str | None = None,
    prediction: str | None = None,
) -> Column:
    """Filters of the log list; severity is a store name. None, '' and 0 filter nothing."""
    conditions = []
    if search:
        conditions.append(matches_search(search))
    if ip:
        conditions.append(F.col("ip") == ip)
    if status_code:
        conditions.append(F.col("status") == status_code)
    if severity:
        conditions.append(equals_ignore_case(F.col("severity"), severity))
    if prediction:
        conditions.append(equals_ignore_case(F.col("prediction"), prediction))
    return _all(conditions)


def filter_logs(rows: DataFrame, **conditions) -> DataFrame:
    return rows.filter(log_condition(**conditions))


def filter_map(
    rows: DataFrame,
    ip: str | None = None,
    url: str | None = None,
    severity: str | None = None,
    country: str | None = None,
    time_range: str | None = None,
    as_of: Column | dt.datetime | None = None,
) -> DataFrame:
    """Filters of the threat map; severity is a display name."""
    conditions = []
    if ip:
        conditions.append(contains_ignore_case(F.col("ip"), ip))
    if url:
        conditions.append(contains_ignore_case(F.col("url"), url))
    if severity:
        conditions.append(equals_ignore_case(F.col("display_severity"), severity))
    if country:
        conditions.append(equals_ignore_case(F.col("country"), country))
    if time_range:
        end = latest_event_time(rows) if as_of is None else as_of
        conditions += within_dates(rows, map_seconds(time_range), end)
    return rows.filter(_all(conditions))
