"""WIN-1 over traces that are still arriving: trigrams of kinds in the order of the records.

Records of a trace wait in its state until the watermark has passed them, so late ones (within
the watermark's delay) take their places.  Then a trigram is given out when a fourth record
follows it: the last trigram of a trace is left out, as in the batch form, when its time is up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "trace string, code string"
#: The last codes that are kept (three), and the records that wait: times in microseconds, numbers and kinds.
STATE = "codes array<string>, times array<bigint>, seqs array<bigint>, kinds array<string>"


def _steps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, gap_ms: int) -> Iterator[pd.DataFrame]:
    codes, waiting = [], []
    if state.exists:
        kept, times, seqs, kinds = state.get
        codes, waiting = list(kept), list(zip(times, seqs, kinds))
    for pdf in frames:
        waiting += zip(pdf["us"].tolist(), pdf["seq"].tolist(), pdf["kind"].tolist())
    over = state.hasTimedOut
    mark = state.getCurrentWatermarkMs() * 1000
    waiting.sort()
    n = len(waiting) if over else sum(us < mark for us, _, _ in waiting)
    out = []
    for _, _, kind in waiting[:n]:
        if len(codes) == 3:
            out.append(">".join(codes))
            codes = codes[1:]
        codes.append(kind)
    rest = waiting[n:]
    if over:
        state.remove()
    else:
        state.update((codes, [w[0] for w in rest], [w[1] for w in rest], [w[2] for w in rest]))
        last = max((w[0] for w in rest), default=mark) // 1000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + gap_ms)
    if out:
        yield pd.DataFrame({"trace": str(key[0]), "code": out})


def trigrams(records: DataFrame, late: str = "10 minutes", gap_ms: int = 3_600_000) -> DataFrame:
    """(trace, code) for each trigram of records (trace, ts, seq, kind); a trace is over ``gap_ms`` after the last of it has passed."""
    rows = records.select("trace", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("bigint").alias("seq"), "kind").withWatermark("ts", late)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _steps(key, frames, state, gap_ms)

    return rows.groupBy("trace").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
