"""Small builders shared by the tests."""

import datetime as dt

from tidemark.schema import FACTS_DDL, OBS_DDL


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def month(start: str, k: int) -> dt.date:
    d = day(start)
    n = d.year * 12 + d.month - 1 + k
    return dt.date(n // 12, n % 12 + 1, 1)


def obs_frame(spark, series: dict, start="2000-01-01", vintage="2010-01-01", model="m"):
    """Rows of monthly series; None in a list is a missing row, not a NULL value."""
    rows = [
        (model, day(vintage), name, month(start, k), float(v))
        for name, values in series.items()
        for k, v in enumerate(values)
        if v is not None
    ]
    return spark.createDataFrame(rows, OBS_DDL)


def spec_frame(spark, entries, model="m"):
    from tidemark.schema import SPEC_DDL

    rows = [
        (model, sid, sid, freq, "USD", code, "cat", blocks, k + 1)
        for k, (sid, freq, code, blocks) in enumerate(entries)
    ]
    return spark.createDataFrame(rows, SPEC_DDL)


def facts_frame(spark, rows):
    return spark.createDataFrame(
        [("m", s, day(p), day(r), float(v)) for s, p, r, v in rows], FACTS_DDL
    )


def series_of(df, value="value"):
    """{series: {period: value}} of a collected panel."""
    out = {}
    for r in df.collect():
        out.setdefault(r["series_id"], {})[r["period"]] = r[value]
    return out
