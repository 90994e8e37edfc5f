"""DataFrames shared by the branches of one query run.

A query often needs the same aggregate of the big tables in several branches.
The builders of the large ones store their result, so that all branches read one
table; the others hand every branch the same plan.  Nothing is kept from one run
to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_frames: dict[tuple[str, str], DataFrame] = {}


def start() -> None:
    _frames.clear()


def shared(name: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (name, sf_dir)
    if key not in _frames:
        _frames[key] = build()
    return _frames[key]
