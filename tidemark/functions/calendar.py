"""Date and quarter-label column functions.  All arguments and results are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(d) -> Column:
    return F.trunc(_col(d), "MM")


def quarter_third_month(d) -> Column:
    """First day of the last month of the quarter holding ``d``."""
    return F.add_months(F.trunc(_col(d), "QUARTER"), 2)


def quarter_label(d) -> Column:
    """``yyyy_qN`` label of a date."""
    d = _col(d)
    return F.concat(F.year(d).cast("string"), F.lit("_q"), F.quarter(d).cast("string"))


def label_year(quarter) -> Column:
    return F.substring(_col(quarter), 1, 4).cast("int")


def label_quarter(quarter) -> Column:
    """``q1``..``q4`` part of a quarter label."""
    return F.lower(F.right(_col(quarter), F.lit(2)))


def quarter_start(quarter) -> Column:
    """First day of the quarter named by a ``yyyy_qN`` label."""
    q = _col(quarter)
    return F.make_date(label_year(q), F.right(q, F.lit(1)).cast("int") * 3 - 2, F.lit(1))


def previous_quarter(quarter) -> Column:
    return quarter_label(F.add_months(quarter_start(quarter), -3))


def next_quarter(quarter) -> Column:
    return quarter_label(F.add_months(quarter_start(quarter), 3))


def target_month(period) -> Column:
    """Grid month of a target period such as ``2017q1``, ``2017_q1`` or ``2017m5``."""
    text = F.lower(F.regexp_replace(_col(period), "_", ""))
    year = F.substring(text, 1, 4).cast("int")
    n = F.substring(text, 6, 2).cast("int")
    freq = F.substring(text, 5, 1)
    return (
        F.when(freq == "m", F.make_date(year, n, F.lit(1)))
        .when(freq == "q", F.make_date(year, n * 3, F.lit(1)))
        .otherwise(F.raise_error(F.concat(F.lit("no monthly or quarterly period: "), text)).cast("date"))
    )


def checked_target_month(period, last_observed) -> Column:
    """Target month, failing when it lies more than a year past the data."""
    month = target_month(period)
    limit = F.add_months(month_start(last_observed), 12)
    return F.when(month <= limit, month).otherwise(
        F.raise_error(F.lit("period is beyond the one-year horizon")).cast("date")
    )


def friday_on_or_after(d) -> Column:
    return F.next_day(F.date_sub(_col(d), 1), "FRI")


def fridays_between(start, end) -> Column:
    """Array of the Fridays in [start, end]; empty when there is none."""
    first = friday_on_or_after(start)
    end = _col(end)
    days = F.sequence(first, F.greatest(first, end), F.expr("interval 7 days"))
    return F.when(first <= end, days).otherwise(F.array().cast("array<date>"))


def last_friday(year, month) -> Column:
    last = F.last_day(F.make_date(_col(year), _col(month), F.lit(1)))
    return F.next_day(F.date_sub(last, 7), "FRI")


def publication_month_end(quarter) -> Column:
    """End of the month in which the first official figure of a quarter appears."""
    return F.last_day(F.add_months(quarter_start(quarter), 3))


def chart_window_start(quarter) -> Column:
    """Last Friday of the month two months before the quarter's first month."""
    d = F.add_months(quarter_start(quarter), -2)
    return last_friday(F.year(d), F.month(d))


def chart_window_end(quarter) -> Column:
    """Last Friday of the publication month."""
    d = publication_month_end(quarter)
    return last_friday(F.year(d), F.month(d))


def month_index(d) -> Column:
    """Months since year 0, so that consecutive months differ by one."""
    d = _col(d)
    return F.year(d) * 12 + F.month(d)
