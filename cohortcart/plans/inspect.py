"""Plan text through the public ``DataFrame.explain`` API, for checks and tests."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "simple") -> str:
    """What ``df.explain(mode=mode)`` prints (the physical plan in ``simple`` mode)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()
