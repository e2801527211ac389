"""Stateful processors of the live operators.  Workers import this module: it needs no session.

Spark hands rows to a Python processor one by one, each as Python objects.  So rows are packed before: a symbol's rows of a
part of the input are one row with an Arrow batch, which processors read, sort and keep as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a pack, and of what a processor is handed at once, at most.
PACK_ROWS, HANDED_ROWS = 65_536, 262_144


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(symbol, ...)`` as ``(symbol, pack)``: of each ``PACK_ROWS`` rows a symbol's rows are one Arrow batch."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= PACK_ROWS:
            yield _packs(held)
            held, count = [], 0
    if count:
        yield _packs(held)


def _packs(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    symbols = pc.dictionary_encode(table["symbol"].combine_chunks(), null_encoding="encode")
    codes = symbols.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    rows = table.drop_columns("symbol").take(order)
    ends = [*starts[1:], len(codes)]
    packs = [_bytes(rows.slice(a, b - a)) for a, b in zip(starts, ends)]
    return pa.RecordBatch.from_arrays([symbols.dictionary.take(pa.array(codes[order][starts])), pa.array(packs, pa.binary())], names=["symbol", "pack"])


def _bytes(rows: pa.Table) -> bytes:
    return rows.combine_chunks().to_batches()[0].serialize().to_pybytes()


class Packed(StatefulProcessor):
    """Takes packs of rows with the given schema and hands their rows, in order of time, to another processor's ``handed``.

    Rows carry ``at_us``, their time in microseconds, whatever the session's time zone; ``ties`` order rows of one time.
    """

    def __init__(self, inner: Any, schema: pa.Schema, ties: tuple[str, ...] = ()) -> None:
        self.inner, self.schema, self.ties = inner, schema, ties

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.inner.init(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from self._handed(key, self._in_order(p for frame in rows for p in frame["pack"]))

    def _in_order(self, packs: Iterable[bytes]) -> pa.Table:
        """The rows of one micro-batch, which the source bounds (``plans/live.py: ordered_stream``)."""
        rows = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(p), self.schema) for p in packs], self.schema)
        if self.ties:
            return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("at_us", *self.ties)]))
        return rows.take(np.argsort(rows["at_us"].to_numpy(), kind="stable"))

    def _handed(self, key: Any, rows: pa.Table) -> Iterator[pd.DataFrame]:
        for start in range(0, rows.num_rows, HANDED_ROWS):
            part = rows.slice(start, HANDED_ROWS)
            yield from self.inner.handed(key, {c: part[c].to_numpy() for c in self.schema.names if c not in self.ties})

    def close(self) -> None:
        pass


class Rolling:
    """Keeps as many of a symbol's last values as a window looks back on."""

    def __init__(self, n: int, kind: str) -> None:
        self.n, self.kind = n, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "value double")

    def handed(self, key: Any, rows: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        kept = [r[0] for r in self.last.get()]
        x = rows["x"].astype("float64")
        series = pd.Series(np.concatenate([np.array(kept, dtype="float64"), x]))
        window = series.rolling(self.n, min_periods=self.n)
        if self.kind == "mean":
            out = window.mean()
        elif self.kind == "std":
            out = window.std().fillna(0.0) if self.n > 1 else series * 0.0
        else:
            both = (series > 0) & (series.shift() > 0)
            returns = np.log((series / series.shift()).where(both))
            out = returns if self.kind == "log_return" else returns.rolling(self.n, min_periods=self.n).std() * np.sqrt(252)
        back = self.n - 1 if self.kind in ("mean", "std") else 1 if self.kind == "log_return" else self.n
        self.last.put([(v,) for v in series.iloc[-back:].tolist()] if back else [])
        yield pd.DataFrame({"symbol": [key[0]] * len(x), "at_us": rows["at_us"], "x": x, "value": out.to_numpy()[len(kept) :]})

    def forget(self) -> None:
        self.last.clear()


class OpenTrade:
    """Row number, next free row and the open position of a symbol.

    A position closes no later than the next row that is free for an entry, so entries are picked first; all picks then
    look for their close in the rows they may hold, side by side.
    """

    def __init__(self, stop: float, hold: int) -> None:
        self.stop, self.hold = stop, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "row long, free long, entry long, entry_us long, stop double")

    def handed(self, key: Any, rows: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        row, free, entry, entry_us, stop = self.state.get() if self.state.exists() else (0, 0, None, None, None)
        at, n, hold = rows["at_us"], len(rows["at_us"]), self.hold
        picks, free = self._picks(np.flatnonzero(rows["entry"]), free - row, max(hold, 1))
        if not hold:
            closes, limits = picks, np.zeros(len(picks), dtype=bool)
            since, stops = at[picks], None
        else:
            since, stops = at[picks], rows["e0"][picks] * (1 - self.stop)
            if entry is not None:
                picks, since, stops = np.append(entry - row, picks), np.append(entry_us, since), np.append(np.nan if stop is None else stop, stops)
            closes, limits = self._closes(picks, stops, rows["exit"], rows["x0"])
        done = closes >= 0
        ends = at[closes[done]]
        is_open = bool(len(picks)) and not done[-1]
        self.state.update((row + n, row + free, *((row + int(picks[-1]), int(since[-1]), float(stops[-1])) if is_open else (None, None, None))))
        if done.any():
            limit = limits[done]
            exit_us, limit_us = pd.arrays.IntegerArray(ends, limit), pd.arrays.IntegerArray(ends.copy(), ~limit)
            yield pd.DataFrame({"symbol": [key[0]] * len(ends), "entry_us": since[done], "exit_us": exit_us, "limit_us": limit_us})

    @staticmethod
    def _picks(entries: np.ndarray, free: int, step: int) -> tuple[np.ndarray, int]:
        """The rows that are entered, each the first that is free, and the next free row."""
        picks, i = [], int(np.searchsorted(entries, free))
        after = np.searchsorted(entries, entries + step).tolist()
        while i < len(entries):
            picks.append(i)
            i = after[i]
        chosen = entries[picks] if picks else np.zeros(0, dtype="int64")
        return chosen, int(chosen[-1]) + step if picks else free

    def _closes(self, picks: np.ndarray, stops: np.ndarray, exits: np.ndarray, x0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row in which each pick closes, -1 where that is still to come, and whether it closes by its limit.

        Picks are ``hold`` rows apart, so all together look at each row about once.
        """
        n = len(x0)
        closes, limits = np.full(len(picks), -1, dtype="int64"), np.zeros(len(picks), dtype=bool)
        if not len(picks):
            return closes, limits
        first = np.maximum(picks + 1, 0)
        at = first[:, None] + np.arange(min(self.hold, n))
        held = (at < n) & (at <= (picks + self.hold)[:, None])
        at = np.minimum(at, n - 1)
        by_exit = exits[at] & held
        by_either = by_exit | ((x0[at] < stops[:, None]) & held)
        place, found = by_either.argmax(axis=1), by_either.any(axis=1)
        each = np.arange(len(picks))
        end = picks + self.hold
        closes = np.where(found, first + place, np.where(end < n, end, -1))
        return closes, found & ~by_exit[each, place]

    def forget(self) -> None:
        self.state.clear()


class InTime(Packed):
    """Holds rows back until the watermark has passed them, then hands them on in order of time.

    Rows that come in any order inside the watermark give what ordered rows give.  A row is left out if its symbol was handed
    on up to a later time.  A symbol without rows for ``idle`` milliseconds of event time is forgotten, and starts anew if it
    comes back, whichever batch its rows are in; of a symbol that has no state, rows behind the watermark are left out then.

    Waiting rows are kept as packs in order of time, with the first time of each pack, so a pack is read when the watermark
    reaches it, and only the packs that it cuts are written again.
    """

    def __init__(self, inner: Any, schema: pa.Schema, ties: tuple[str, ...], idle: int | None) -> None:
        super().__init__(inner, schema, ties)
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "number long", "pack binary")
        self.firsts = handle.getValueState("firsts", "next long, firsts binary")
        self.handed_on = handle.getValueState("handed_on", "newest long, passed long")

    def _index(self) -> tuple[int, np.ndarray]:
        """The next number of a pack, and the number and first time of each that waits."""
        number, firsts = self.firsts.get() if self.firsts.exists() else (0, b"")
        return number, np.frombuffer(firsts, dtype="int64").reshape(-1, 2)

    def _keep(self, number: int, index: np.ndarray, rows: pa.Table) -> np.ndarray:
        times, new = rows["at_us"].to_numpy(), []
        for start in range(0, len(times), PACK_ROWS):
            self.waiting.updateValue((number,), (_bytes(rows.slice(start, PACK_ROWS)),))
            new.append((number, times[start]))
            number += 1
        index = np.concatenate([index, np.array(new, dtype="int64").reshape(-1, 2)])
        if len(index):
            self.firsts.update((number, index.tobytes()))
        else:
            self.firsts.clear()
        return index

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = self._in_order(p for frame in rows for p in frame["pack"])
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        passed = self.handed_on.get()[1] if self.handed_on.exists() else None
        if passed is None and self.idle is not None and watermark > 0 and not self.firsts.exists():
            passed = watermark  # the symbol may have been handed on and forgotten
        if passed is not None:
            new = new.slice(int(np.searchsorted(new["at_us"].to_numpy(), passed, "right")))
        if new.num_rows:
            self._keep(*self._index(), new)
            self.handle.registerTimer(new["at_us"][0].as_py() // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        number, index = self._index()
        reached = index[:, 1] <= passed
        if reached.any():
            numbers = index[reached, 0].tolist()
            rows = self._in_order([self.waiting.getValue((i,))[0] for i in numbers])
            for i in numbers:
                self.waiting.removeKey((i,))
            cut = int(np.searchsorted(rows["at_us"].to_numpy(), passed, "right"))
            index = self._keep(number, index[~reached], rows.slice(cut))
            yield from self._runs(key, rows.slice(0, cut), passed)
        if self.idle is not None and self.handed_on.exists():
            newest = self.handed_on.get()[0]
            if passed - newest >= self.idle * 1000:
                self.inner.forget()
                if not len(index):
                    self.handed_on.clear()
            elif not len(index):
                self.handle.registerTimer(newest // 1000 + self.idle + 1)
        if len(index):
            self.handle.registerTimer(int(index[:, 1].min()) // 1000 + 1)

    def _runs(self, key: Any, rows: pa.Table, passed: int) -> Iterator[pd.DataFrame]:
        """Hands rows on; before those that come after a gap of ``idle`` the symbol is forgotten."""
        times = rows["at_us"].to_numpy()
        before = self.handed_on.get()[0] if self.handed_on.exists() else times[0]
        anew = [] if self.idle is None else np.flatnonzero(np.diff(times, prepend=before) >= self.idle * 1000).tolist()
        for start, end in zip([0, *anew], [*anew, len(times)]):
            if start in anew:
                self.inner.forget()
            yield from self._handed(key, rows.slice(start, end - start))
        self.handed_on.update((int(times[-1]), passed))
