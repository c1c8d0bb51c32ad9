"""Per-station state: recent readings, standing alerts, silence timers; panes of sliding windows.

The Python side only remembers rows; every judgement stays a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle



class RecentReadings(StatefulProcessor):
    """Emit each reading with up to ``depth`` readings before it, and whether it came too late.

    Rows of a batch are taken in time order. A reading older than the station's newest by more
    than ``delay`` is late: it is passed on marked, not judged and not remembered. State keeps
    what a reading in time can still need: everything within the delay and ``depth`` before it.
    """

    def __init__(self, columns: list[str], depth: int, delay_micros: int):
        self.columns, self.depth, self.delay = columns, depth, delay_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{c} double" for c in self.columns)
        self.recent = handle.getListState("recent", f"at bigint, {fields}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable", ignore_index=True)
        known = list(self.recent.get()) if self.recent.exists() else []
        newest = max((r[0] for r in known), default=None)
        out, kept = [], sorted(known)
        for row in new.itertuples(index=False):
            at = int(row.at)
            late = newest is not None and at < newest - self.delay
            past = [r for r in kept if r[0] < at][-self.depth :] if not late else []
            values = tuple(_double(getattr(row, c)) for c in self.columns)
            entry = {"reading_id": row.reading_id, "station_id": key[0], "at": at, "late": late}
            for i, c in enumerate(self.columns):
                entry[c] = values[i]
                entry[f"{c}_past"] = [r[i + 1] for r in past]
            out.append(entry)
            if not late:
                kept.append((at, *values))
                kept.sort(key=lambda r: r[0])
                newest = at if newest is None else max(newest, at)
                kept = self._needed(kept, newest)
        self.recent.put(kept)
        yield pd.DataFrame(out)

    def _needed(self, kept: list[tuple], newest: int) -> list[tuple]:
        edge = int(np.searchsorted([r[0] for r in kept], newest - self.delay, side="left"))
        return kept[max(0, edge - self.depth) :]

    def close(self) -> None:
        pass


def _double(value):
    return None if value is None or pd.isna(value) else float(value)


class StandingAlert(StatefulProcessor):
    """Give each candidate the alert it raises or folds into; forget an alert after its cooldown.

    Candidates wait until the watermark has passed them and are then folded in order of event time, so batches
    may bring them in any order within the delay.
    """

    def __init__(self, cooldown_micros: int):
        self.cooldown = cooldown_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, qc_id bigint, severity string")
        self.standing = handle.getValueState("standing", "alert_id bigint, alert_at bigint, severity string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            self.waiting.appendList(list(zip(frame["at"].tolist(), frame["qc_id"].tolist(), frame["severity"].tolist())))
            earliest = min(int(frame["at"].min()), earliest) if earliest is not None else int(frame["at"].min())
        self.handle.registerTimer(earliest // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] <= passed]
        current = self.standing.get() if self.standing.exists() else None
        out = []
        for at, qc_id, severity in due:
            opened = current is None or at > current[1] + self.cooldown
            if opened:
                current = (qc_id, at, severity)
            elif severity in ("high", "critical") and current[2] not in ("high", "critical"):
                current = (current[0], current[1], severity)
            out.append((key[0], key[1], current[0], current[1], qc_id, at, current[2], opened))
        if due:
            self.waiting.put(waiting[len(due) :]) if len(due) < len(waiting) else self.waiting.clear()
        if current is not None and current[1] + self.cooldown < passed and len(due) == len(waiting):
            self.standing.clear()
        elif due:
            self.standing.update(current)
        if len(due) < len(waiting):
            self.handle.registerTimer(waiting[len(due)][0] // 1000 + 1)
        elif current is not None and current[1] + self.cooldown >= passed:
            self.handle.registerTimer((current[1] + self.cooldown) // 1000 + 2)
        if out:
            yield pd.DataFrame(
                out, columns=["station_id", "variable", "alert_id", "alert_at", "qc_id", "at", "severity", "opened"]
            )

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """Report a station once event time has passed its last reading by more than ``limit``."""

    def __init__(self, limit_micros: int):
        self.limit = limit_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(frame["at"].max()) for frame in rows)
        if self.last.exists():
            newest = max(newest, int(self.last.get()[0]))
        self.last.update((newest,))
        self.handle.registerTimer((newest + self.limit) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = int(self.last.get()[0])
        if (at + self.limit) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame({"station_id": [key[0]], "last_at": [at]})

    def close(self) -> None:
        pass


_PANES = pa.schema(
    [("station", pa.string()), ("variable", pa.string()), ("pane", pa.int64()), ("n", pa.int64()),
     ("low", pa.float64()), ("high", pa.float64()), ("total", pa.float64())]
)
_TEXT = ("station", "variable")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where one of the sorted columns changes."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _reduced(frame: pd.DataFrame, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of the rows from each start to the next. As in Spark NaN counts as the largest number."""
    with np.errstate(invalid="ignore"):
        return {
            "n": np.add.reduceat(frame["n"].to_numpy(), starts),
            "low": np.fmin.reduceat(frame["low"].to_numpy(), starts),
            "high": np.maximum.reduceat(frame["high"].to_numpy(), starts),
            "total": np.add.reduceat(frame["total"].to_numpy(), starts),
        }


def _series(frame: pd.DataFrame) -> np.ndarray:
    """A number for each station and variable; NULL is one of them."""
    station, _ = pd.factorize(frame["station"], use_na_sentinel=False)
    variable, names = pd.factorize(frame["variable"], use_na_sentinel=False)
    return station * len(names) + variable


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per slice, series and pane, in that order."""
    series = _series(frame)
    order = np.lexsort((frame["pane"], series, frame["slice"]))
    frame, series = frame.take(order), series[order]
    starts = _starts(frame["slice"].to_numpy(), series, frame["pane"].to_numpy())
    return frame.take(starts).assign(**_reduced(frame, starts))


def _packed(frame: pd.DataFrame) -> bytes:
    columns = [pa.array(frame[f.name].to_numpy(), f.type, from_pandas=f.name in _TEXT) for f in _PANES]
    return pa.RecordBatch.from_arrays(columns, schema=_PANES).serialize().to_pybytes()


def _unpacked(panes: bytes, of: int) -> pd.DataFrame:
    batch = pa.ipc.read_record_batch(pa.py_buffer(bytes(panes)), _PANES)
    return pd.DataFrame({f.name: batch.column(f.name).to_numpy(zero_copy_only=False) for f in _PANES}).assign(slice=of)


class SlidingWindows(StatefulProcessor):
    """Statistics of sliding windows, kept once per pane instead of once per window.

    A pane is the span of time in which no window begins or ends; windows are numbered by their start in slides, and
    ``per_slice`` windows in a row make a slice. A key is a bucket of series in slices, and its state one packed table of
    panes for each slice. A window comes out when the watermark passes its end, and a pane goes with its last window. As
    in Spark's own windows, a row counts in all of its windows that have not come out: those that end after the
    watermark of the batch before, ``until``. Every bucket exists from the first batch and wakes whenever the watermark
    moves, so it knows that watermark whether or not it holds rows.

    Windows next to each other with the same statistics come out as one row: the first one and how many there are.
    """

    def __init__(self, length_micros: int, slide_micros: int, pane_micros: int, per_slice: int):
        self.length, self.slide, self.pane, self.per_slice = length_micros, slide_micros, pane_micros, per_slice

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "micros bigint")
        self.slices = handle.getMapState("slices", "slice bigint", "panes binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._sleep(0)

    def _sleep(self, until_ms: int) -> None:
        """Until the watermark has passed this time."""
        self.until.update((until_ms * 1000,))
        self.handle.registerTimer(until_ms + 1)

    def _windows(self, frame: pd.DataFrame, after: int, to: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each pane in its slice that end after one time and, if given, not after another."""
        at, first_of_slice = frame["pane"].to_numpy() * self.pane, frame["slice"].to_numpy() * self.per_slice
        first = np.maximum(-((self.length - self.pane - at) // self.slide), first_of_slice)
        first = np.maximum(first, (after - self.length) // self.slide + 1)
        last = np.minimum(at // self.slide, first_of_slice + self.per_slice - 1)
        return first, last if to is None else np.minimum(last, (to - self.length) // self.slide)

    def _open(self, frame: pd.DataFrame, after: int) -> pd.DataFrame:
        first, last = self._windows(frame, after)
        return frame[first <= last]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, parts, held, most = self.until.get()[0], [], 0, 100_000
        for frame in rows:
            there = frame["n"].to_numpy() > 0
            value = frame["value"].to_numpy(dtype="float64")
            frame = frame[["station", "variable", "slice", "pane", "n"]].assign(
                low=np.where(there, value, np.nan), high=np.where(there, value, -np.inf), total=np.where(there, value, 0.0)
            )
            frame = self._open(frame, until)
            parts.append(frame)
            held += len(frame)
            if held > most:
                parts = [_merged(pd.concat(parts, ignore_index=True))]
                held, most = len(parts[0]), max(most, 2 * len(parts[0]))
        if held:
            new = _merged(pd.concat(parts, ignore_index=True))
            for of, panes in new.groupby("slice", sort=False):
                known = self.slices.getValue((int(of),)) if self.slices.containsKey((int(of),)) else None
                if known is not None:
                    panes = _merged(pd.concat([_unpacked(known[0], of), panes], ignore_index=True))
                self.slices.updateValue((int(of),), (_packed(panes),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, passed = self.until.get()[0], timerValues.getCurrentWatermarkInMs() * 1000
        parts, held = [], 0
        for of in sorted(k[0] for k in self.slices.keys()):
            first_window = of * self.per_slice
            if first_window * self.slide + self.length > passed:
                continue
            panes = _unpacked(self.slices.getValue((of,))[0], of)
            parts.append(panes)
            held += len(panes)
            if (first_window + self.per_slice - 1) * self.slide + self.length <= passed:
                self.slices.removeKey((of,))
            else:
                still = self._open(panes, passed)
                if not len(still):
                    self.slices.removeKey((of,))
                elif len(still) < len(panes):
                    self.slices.updateValue((of,), (_packed(still),))
            if held > 20_000:
                yield from self._closed(pd.concat(parts, ignore_index=True), until, passed)
                parts, held = [], 0
        if parts:
            yield from self._closed(pd.concat(parts, ignore_index=True), until, passed)
        self._sleep(passed // 1000)

    def _closed(self, panes: pd.DataFrame, after: int, to: int) -> Iterator[pd.DataFrame]:
        """Windows that end in between, those that are next to each other and alike as one row; no frame without rows."""
        first, last = self._windows(panes, after, to)
        times = np.maximum(last - first + 1, 0)
        seen = np.repeat(np.arange(len(panes)), times)
        if not len(seen):
            return
        window = np.arange(len(seen)) - np.repeat(np.cumsum(times) - times, times) + first[seen]
        series = _series(panes)[seen]
        order = np.lexsort((window, series))
        seen, window, series = seen[order], window[order], series[order]
        starts = _starts(series, window)
        found = pd.DataFrame(_reduced(panes.take(seen), starts))
        seen, window, series = seen[starts], window[starts], series[starts]
        bits = [found[c].to_numpy().view(np.int64) for c in ("n", "low", "high", "total")]
        runs = _starts(series, window - np.arange(len(window)), *bits)
        yield pd.DataFrame(
            {
                "station": panes["station"].to_numpy()[seen[runs]],
                "variable": panes["variable"].to_numpy()[seen[runs]],
                "first": window[runs],
                "times": np.diff(np.append(runs, len(window))),
                **{c: found[c].to_numpy()[runs] for c in ("n", "low", "high", "total")},
            }
        )

    def close(self) -> None:
        pass
