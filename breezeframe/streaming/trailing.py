"""The trailing index of a stream of hourly readings, with refusal of late rows.

The state of a series is the hour of its last accepted reading and the readings that its
windows still need (those of the averaging hours of each pollutant, less one). Readings are
taken in the order of `arrival`, the sender's number. One whose hour isn't after all hours
accepted before is refused: it changes no state and goes to the log of refused rows, never
into the windows, and nothing is reordered.

Means are over rows, as in the batch operator, and are summed from the oldest reading on,
so that they are equal to its means in every bit. The state is kept in the stream's checkpoint;
a restarted stream goes on where it ended.

Nulls and ties: a null or negative reading takes a place in the window and counts for no mean; a row with a null hour is
refused; of rows with the same hour the first to arrive is accepted. Rows of one series in one
batch come to one task, in batches of bounded size if the source limits its files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import index as ix
from ..operators import series as se

GASES = se.GAS_COLUMNS
FRAME = {k: ix.AVERAGING_HOURS[k] for k in GASES}
KEPT = max(FRAME.values()) - 1
STATE = "last timestamp_ntz, ring binary"
READINGS = "series int, arrival long, t timestamp_ntz, " + ", ".join(f"{k} double" for k in GASES)
ROWS = READINGS + ", refused boolean, " + ", ".join(f"m_{k} double, n_{k} long" for k in GASES)


def means(values: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, number) of the last `width` of before + values at each of values; NaN and negative ones count for nothing."""
    every = np.concatenate([before, values])
    good = every >= 0
    total, count = np.zeros(len(values)), np.zeros(len(values), np.int64)
    for back in range(width - 1, -1, -1):
        at = np.arange(len(before), len(every)) - back
        ok = (at >= 0) & good[np.maximum(at, 0)]
        total[ok] += every[at[ok]]
        count[ok] += 1
    with np.errstate(invalid="ignore"):
        return np.where(count > 0, total / np.maximum(count, 1), np.nan), count


def advance(rows: pd.DataFrame, last: pd.Timestamp | None, ring: np.ndarray) -> tuple[pd.DataFrame, pd.Timestamp | None, np.ndarray]:
    """Take a series' new rows: (rows with their means or their refusal, last hour, ring of readings)."""
    rows = rows.sort_values("arrival", kind="stable").reset_index(drop=True)
    floor = pd.Timestamp.min if last is None else last
    # Refused hours are never later than accepted ones, so the latest hour of all rows before is that of the accepted.
    latest = rows["t"].fillna(pd.Timestamp.min).cummax().shift(fill_value=pd.Timestamp.min).clip(lower=floor)
    taken = (rows["t"].notna() & (rows["t"] > latest)).to_numpy()
    rows["refused"] = ~taken
    news = rows.loc[taken, list(GASES)].to_numpy(float)
    for k, gas in enumerate(GASES):
        rows[f"m_{gas}"], rows[f"n_{gas}"] = np.nan, 0
        rows.loc[taken, f"m_{gas}"], rows.loc[taken, f"n_{gas}"] = means(news[:, k], ring[:, k], FRAME[gas])
    if taken.any():
        last = rows.loc[taken, "t"].max()
    return rows, last, np.concatenate([ring, news])[-KEPT:]


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, ring = None, np.empty((0, len(GASES)))
    if state.exists:
        last, raw = state.get
        ring = np.frombuffer(raw, float).reshape(-1, len(GASES))
    rows, last, ring = advance(pd.concat(list(frames)), None if last is None or pd.isna(last) else pd.Timestamp(last), ring)
    state.update((None if last is None else last.to_pydatetime(), ring.tobytes()))
    yield rows[[x.split()[0] for x in ROWS.split(", ")]]


def trailing_rows(readings: DataFrame) -> DataFrame:
    """A stream of READINGS -> ROWS: each row with the means of its windows, or refused."""
    columns = [x.split()[0] for x in READINGS.split(", ")]
    return readings.select(*columns).groupBy("series").applyInPandasWithState(_step, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)


def trailing_index(accepted: DataFrame) -> DataFrame:
    """Accepted ROWS, as they are in their log -> the columns of the batch operator."""
    good = accepted.withColumns({f"m_{k}": F.when(F.col(f"n_{k}") > 0, F.col(f"m_{k}")) for k in GASES})
    return se.trailing_of_means(se.with_index(good))
