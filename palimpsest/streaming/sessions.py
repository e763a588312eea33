"""Streams: stateless scans, and placeholders that last as long as their session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "originals array<string>, replacements array<string>, types array<string>, counters array<int>"
OUT = "session_id string, seq long, entity_type string, original string, replacement string"


def number_stream(values: DataFrame) -> DataFrame:
    """Placeholders for a stream of (session_id, seq, entity_type, original): a value keeps its own in all batches.

    State is the session's map; a value's number is the next of its type
    when it first comes. Works on batch frames alike through ``number_batch``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        originals, replacements, types, counters = map(list, state.get) if state.exists else ([], [], [], [])
        out = number_batch(key[0], pd.concat(list(frames)), originals, replacements, types, counters)
        state.update((originals, replacements, types, counters))
        yield out

    return values.groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def number_batch(session: str, rows: pd.DataFrame, originals: list, replacements: list, types: list, counters: list) -> pd.DataFrame:
    """Number one session's values in order of ``seq``; the four lists are its state and change in place."""
    known = dict(zip(originals, replacements, strict=True))
    out = []
    for row in rows.sort_values("seq", kind="stable").itertuples(index=False):
        if row.original not in known:
            if row.entity_type not in types:
                types.append(row.entity_type)
                counters.append(0)
            at = types.index(row.entity_type)
            counters[at] += 1
            known[row.original] = f"[{row.entity_type}_{counters[at]}]"
            originals.append(row.original)
            replacements.append(known[row.original])
        out.append((session, row.seq, row.entity_type, row.original, known[row.original]))
    return pd.DataFrame(out, columns=["session_id", "seq", "entity_type", "original", "replacement"])
