"""One comment for each pull request over an endless stream of reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What comes in: reports, and what the forge answered to a post (kind `posted`, with the comment's id).
EVENTS = "repo string, pr bigint, kind string, comment_id bigint, body string, at timestamp"
ACTIONS = "repo string, pr bigint, action string, comment_id bigint, body string, at timestamp"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Upsert(StatefulProcessor):
    """The state of a pull request: its comment's id as soon as it is known, and the time and digest of the report that it shows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.comment = handle.getValueState("comment", "comment_id bigint, at_us bigint, digest string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        comment_id, shown, digest = self.comment.get() if self.comment.exists() else (None, None, None)
        newest = None
        for frame in rows:
            ids = frame.loc[(frame["kind"] == "posted") & frame["comment_id"].notna(), "comment_id"]
            if comment_id is None and len(ids):
                comment_id = int(ids.min())
            told = frame[(frame["kind"] == "report") & frame["body"].notna() & frame["at"].notna()]
            for body, at in zip(told["body"], told["at"]):
                if newest is None or (at, body) > newest:
                    newest = at, body
        if newest is not None:
            at_us, own = newest[0].value // 1000, hashlib.sha256(newest[1].encode()).hexdigest()
            if shown is None or (at_us > shown and own != digest):
                action = "post" if shown is None and comment_id is None else "patch"
                yield pd.DataFrame({"repo": [key[0]], "pr": [key[1]], "action": [action], "comment_id": pd.array([comment_id], dtype="Int64"), "body": [newest[1]], "at": [newest[0]]})
                shown, digest = at_us, own
            elif at_us > shown:
                shown = at_us
        self.comment.update((comment_id, shown, digest))

    def close(self) -> None:
        pass


def upserts(events: DataFrame) -> DataFrame:
    """events: a stream of EVENTS. A stream of ACTIONS: post for the first report of a pull request (or patch, if its comment is known), then
    patch for each newer one that says something else. Of the reports of a batch the newest counts; a report that is older
    than what is shown, or repeats it, changes nothing. comment_id is null until the forge's answer has come in.

    State is kept by pull request in RocksDB, on which the session is set.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    keyed = events.where(F.col("repo").isNotNull() & F.col("pr").isNotNull()).select("repo", "pr", "kind", F.col("comment_id").cast("bigint").alias("comment_id"), "body", "at")
    return keyed.groupBy("repo", "pr").transformWithStateInPandas(_Upsert(), ACTIONS, "Append", "None")
