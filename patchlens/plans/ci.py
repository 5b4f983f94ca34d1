"""One diff, as continuous integration reviews it: JSON to the output, a report file, an exit status."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame

from ..config import Config
from ..operators import render
from .scan import scan


class Tee:
    """Writes to several streams at once."""

    def __init__(self, *streams: TextIO):
        self.streams = streams

    def write(self, text: str) -> int:
        for s in self.streams:
            s.write(text)
        return len(text)


def _put(path: str, text: str, mode: str) -> None:
    with open(path, mode, encoding="utf-8") as f:
        f.write(text)


def review_one(diff: DataFrame, scorer: Callable[[DataFrame], DataFrame], cfg: Config = Config(), report: str | None = None, summary: str | None = None, result: str | None = None, out: TextIO | None = None) -> int:
    """Reviews a table of one diff on the driver; 1 for a block, else 0, whatever becomes of the output.

    The JSON goes to out (the standard output by default) and, if named, to the file result. The report replaces the file report and is
    appended to the file summary (by default what GITHUB_STEP_SUMMARY names). Nothing to review: five fields and no report.
    """
    out = out or sys.stdout
    summary = os.environ.get("GITHUB_STEP_SUMMARY") if summary is None else summary
    row = scan(diff, scorer, cfg).select("exit_code", render.is_empty().alias("empty"), render.json_of().alias("json"), render.report(cfg).alias("report")).first()
    if result:
        with open(result, "w", encoding="utf-8") as f:
            Tee(out, f).write(row["json"] + "\n")
    else:
        out.write(row["json"] + "\n")
    if not row["empty"]:
        if report:
            _put(report, row["report"], "w")
        if summary:
            _put(summary, row["report"], "a")
    return row["exit_code"]
