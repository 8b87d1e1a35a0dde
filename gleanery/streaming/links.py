"""The link queue as a stream: the state machine of :mod:`gleanery.operators.store`, whatever order events arrive in.

State is kept by link and so spread over the cluster; there are no windows, so no watermark. Events carry an ordinal, and a link's result is that
of replaying its events in order of it, also when an early event comes micro-batches late: the events that may still matter are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "url string, status string, filter_label string, _seq bigint"


def advance(status: str | None, label: str | None, op: str, new_label: str | None) -> tuple[str | None, str | None]:
    """One step: sample < discovered < processed, the last of which is final."""
    if status is None:
        return (None, None) if op == "processed" else (op, new_label)
    if status == "processed" or op == "sample":
        return status, label
    return ("processed", label) if op == "processed" else (op, new_label)


def idle(events: list[tuple]) -> list[tuple]:
    """Those of a link's events (ordinal, op, label), in order, that no event still to come can make matter.

    The first insert can only move forward, and so can the first end behind it: what lies behind that end is over. A sample
    counts as the first insert only.
    """
    first = next((e[0] for e in events if e[1] != "processed"), None)
    if first is None:
        return []
    end = next((e[0] for e in events if e[1] == "processed" and e[0] > first), None)
    return [e for e in events if (end is not None and e[0] > end) or (e[1] == "sample" and e[0] > first)]


class LinkFold(StatefulProcessor):
    """Kept: a link's events that may matter; settled: what is folded up for good, and how many events were seen."""

    def __init__(self, lateness: int | None):
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "seq bigint, op string, label string")
        self.settled = handle.getValueState("settled", "seen bigint, top bigint, upto bigint, status string, label string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, top, upto, status, label = self.settled.get() if self.settled.exists() else (0, None, None, None, None)
        stored = list(map(tuple, self.kept.get())) if seen else []
        events = {e[:2]: e[2] for e in stored}
        for frame in rows:
            seen += len(frame)
            for seq, op, new in zip(frame["seq"].tolist(), frame["op"], frame["filter_label"], strict=True):
                top = seq if top is None else max(top, seq)
                if upto is None or seq > upto:
                    events[seq, op] = None if pd.isna(new) else new
        ordered = [(*k, events[k]) for k in sorted(events)]
        if self.lateness is not None:
            upto = top - self.lateness
            over = [e for e in ordered if e[0] <= upto]
            for _, op, name in over:
                status, label = advance(status, label, op, name)
            ordered = ordered[len(over) :]
        else:
            gone = set(idle(ordered))
            ordered = [e for e in ordered if e not in gone]
        # One call a link and batch: what is new is appended, and only where something goes the list is written anew.
        have, want = set(stored), set(ordered)
        if not have <= want:
            self.kept.put(ordered) if ordered else self.kept.clear()
        elif fresh := [e for e in ordered if e not in have]:
            self.kept.appendList(fresh)
        self.settled.update((seen, top, upto, status, label))
        for _, op, name in ordered:
            status, label = advance(status, label, op, name)
        if status is not None:
            yield pd.DataFrame({"url": [key[0]], "status": [status], "filter_label": [label], "_seq": [seen]})

    def close(self) -> None:
        pass


def fold_link_stream(events: DataFrame, lateness: int | None = None) -> DataFrame:
    """A stream of (url, op, filter_label, _seq) as a stream of each touched link's state, in update mode; its _seq counts a link's events.

    Without ``lateness`` every order of arrival gives what :func:`fold_links` gives, and a link keeps its discoveries until it is
    processed. With it, events more than so many ordinals behind a link's latest are folded up, and what comes later than that is ignored.
    The session must keep its state in RocksDB, as those of :mod:`gleanery.session` do: no other store has lists.
    """
    # The frames that a processor gets lose names that begin with an underscore.
    rows = events.where("_seq is not null").select("url", "op", "filter_label", F.col("_seq").alias("seq"))
    return rows.groupBy("url").transformWithStateInPandas(LinkFold(lateness), OUTPUT, "Update", "None")
