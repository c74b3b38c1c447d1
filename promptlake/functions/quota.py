"""Monthly token quota, in UTC months."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from promptlake.functions.text import _col


def _utc_date(ts) -> Column:
    """The UTC date of a timestamp, whatever the session's zone."""
    days = F.floor(F.unix_micros(_col(ts).cast("timestamp")) / F.lit(86_400_000_000)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def quota_month(ts="ts") -> Column:
    """YYYYMM of the UTC month."""
    return F.date_format(_utc_date(ts), "yyyyMM")


def month_end(ts="ts") -> Column:
    """Last second of the UTC month."""
    return F.timestamp_seconds(F.unix_date(F.last_day(_utc_date(ts))).cast("bigint") * 86_400 + 86_399)


def quota_status(usage="usage", quota: int = 100_000) -> Column:
    """EXCEEDED from 100 %, WARNING from 80 %, else OK; no usage counts as none used."""
    ratio = F.coalesce(_col(usage), F.lit(0)) / F.lit(float(quota))
    return (
        F.when(ratio >= 1.0, F.lit("EXCEEDED")).when(ratio >= 0.8, F.lit("WARNING"))
        .otherwise(F.lit("OK")))


def quota_remaining(usage="usage", quota: int = 100_000) -> Column:
    """Tokens left, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), F.lit(quota) - F.coalesce(_col(usage), F.lit(0)))
