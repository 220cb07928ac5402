"""Owners of shared messages as a stream: state by claim, moves of ownership as output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a claim's session says: it holds the claim, or no longer does, with the session's stamps, as of its version `seq`.
EVENT = "claim_key string, session_id string, last_timestamp string, first_timestamp string, held boolean, seq long"
MOVE = "claim_key string, was string, owner string"


def rank(last: str | None, first: str | None, session_id: str) -> tuple[str, str, str]:
    """Least first: sessions without stamps come last."""
    return ("~" if pd.isna(last) else last), ("~" if pd.isna(first) else first), session_id


class Owners(StatefulProcessor):
    """Holds every session of a claim with its stamps and version, and the owner, who has the least rank. Only when the
    owner gives the claim up or falls back are the others looked through; else a newcomer meets the owner alone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "session_id string", "last string, first string, held boolean, seq long")
        self.owner = handle.getValueState("owner", "last string, first string, session_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        was = self.owner.get() if self.owner.exists() else None
        best, search = (tuple(was) if was else None), False
        for part in rows:
            # Of what a session says several times in a part, its newest version alone meets the state; of one version, the first row.
            newest = part.sort_values("seq", ascending=False, kind="stable").drop_duplicates("session_id")
            for r in newest.itertuples(index=False):
                if self.sessions.containsKey((r.session_id,)) and self.sessions.getValue((r.session_id,))[3] >= r.seq:
                    continue  # an older version that comes late, or one that comes twice
                last, first, _ = now = rank(r.last_timestamp, r.first_timestamp, r.session_id)
                self.sessions.updateValue((r.session_id,), (last, first, bool(r.held), int(r.seq)))
                if best and best[2] == r.session_id and (not r.held or now > best):
                    best, search = None, True
                elif r.held and not search and (best is None or now < best):
                    best = now
        if search:
            best = min(((s[0], s[1], k[0]) for k, s in self.sessions.iterator() if s[2]), default=None)
        if best is None:
            self.owner.clear()
        elif best != (tuple(was) if was else None):
            self.owner.update(best)
        before, after = was[2] if was else None, best[2] if best else None
        if before != after:
            yield pd.DataFrame({"claim_key": [key[0]], "was": [before], "owner": [after]})

    def close(self) -> None:
        pass


def owner_moves(events: DataFrame) -> DataFrame:
    """claim_key, was, owner whenever a claim changes hands, of a stream of events; null for nobody. The last move of a claim names
    the owner that `catalog.claim_owners` finds, in whatever order and batches the events come. Needs the RocksDB state store."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("claim_key", "was", "owner")])
    return events.groupBy("claim_key").transformWithStateInPandas(statefulProcessor=Owners(), outputStructType=schema, outputMode="Append", timeMode="None")
