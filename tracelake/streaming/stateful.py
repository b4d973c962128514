"""Per-key state machines over raw events, for events that arrive in chunks.

The batch operators give the same rows, with the same columns carried along. Rows of a
micro-batch are scanned by array operations, not walked. Of calls and threads, of which there are
many with few rows each, PARTS groups hold many keys and are scanned at once; a device is a group of
its own. State is kept per key; with ``expire_after`` a key that has been silent for that long (in
event time) is forgotten. What was open then is a row without an end (spans that overwrite) or length
(scheduler). Calls that keep the first entry and queue depths, whose rows are finished ones by
nature, give rows for it with ``report_unfinished``, which marks all rows by ``finished``;
otherwise they lose it. A micro-batch holds a bounded number of files, and one key's rows of it
are one task's; chunks of a key must arrive in time order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.functions import fixed
from tracelake.functions.columns import advice_label
from tracelake.plans.states import last_place, place_before
from tracelake.specs import COLLECTION, UPTIME

# (key, state or None, rows sorted by time) -> (output rows, new state or None)
Step = Callable[[tuple, tuple | None, pd.DataFrame], tuple[pd.DataFrame, tuple | None]]


def _run(
    stream: DataFrame,
    keys: list[str],
    order: list[str],
    event_time: Column,
    output: str,
    state_schema: str,
    step: Step,
    expire_after: str | None,
    delay: str,
    unfinished: Callable[[tuple, tuple], pd.DataFrame] | None = None,
) -> DataFrame:
    timeout = GroupStateTimeout.NoTimeout
    expire_ms = 0
    if expire_after is not None:
        timeout = GroupStateTimeout.EventTimeTimeout
        expire_ms = int(pd.Timedelta(expire_after).total_seconds() * 1000)
        stream = stream.withColumn("__time", event_time).withWatermark("__time", delay)

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            if unfinished is not None:
                yield unfinished(key, state.get)
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        held = state.get if state.exists else None
        out, new = step(key, held, rows)
        if new is None:
            if state.exists:
                state.remove()
        else:
            state.update(new)
            if expire_ms:
                last = int(rows["__time"].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + expire_ms)
        if len(out):
            yield out

    return stream.groupBy(*keys).applyInPandasWithState(
        advance, output, state_schema, "append", timeout
    )


#: Groups that the keys of a stream are dealt to, each with the state of all its keys.
PARTS = 256


@dataclass
class Ordered:
    """Rows of many keys in order, key by key."""

    rows: pd.DataFrame
    #: The place of a row's key among the keys, and that of the first row of the key.
    code: np.ndarray
    begin: np.ndarray
    #: Which keys have a state, and what it holds (longs that may be null), by key.
    known: np.ndarray
    held: pd.DataFrame

    @property
    def first(self) -> np.ndarray:
        return self.begin == np.arange(len(self.begin))

    @property
    def ends(self) -> np.ndarray:
        """The last row of each key."""
        return np.flatnonzero(np.append(self.first[1:], True))

    def own(self, places: np.ndarray) -> np.ndarray:
        """The places of rows, -1 where they are before the row's key begins."""
        return np.where(places >= self.begin, places, -1)

    def picked(self, column: str, field: str, places: np.ndarray, which: np.ndarray) -> pd.Series:
        """Of the rows in ``which``, the column at their places; the state's field where a place is -1."""
        at, code = places[which], self.code[which]
        return _values(self.rows[column], at).where(at >= 0, _values(self.held[field], code))


# Ordered rows -> (output rows without keys, the row of each, new state by key, keys that have one)
PartStep = Callable[[Ordered], tuple[dict, np.ndarray, dict, np.ndarray]]


def _values(column: pd.Series, places: np.ndarray) -> pd.Series:
    """Longs that may be null at the places; any where a place is -1."""
    if not len(column):
        return pd.Series([pd.NA] * len(places), dtype="Int64")
    return pd.Series(column.to_numpy()[places], dtype="Int64")


def _run_parts(
    stream: DataFrame,
    keys: list[str],
    order: list[str],
    event_time: Column,
    output: str,
    fields: list[str],
    step: PartStep,
    expire_after: str | None,
    delay: str,
    unfinished: Callable[[pd.DataFrame], dict] | None = None,
) -> DataFrame:
    """As ``_run``, for PARTS groups of keys. ``output`` has no key columns; they are put in front.

    ``unfinished`` gives output rows for states of keys given up, with their places among these in
    ``of``.
    """
    timeout = GroupStateTimeout.NoTimeout
    expire_ms = 0
    if expire_after is not None:
        timeout = GroupStateTimeout.EventTimeTimeout
        expire_ms = int(pd.Timedelta(expire_after).total_seconds() * 1000)
        stream = stream.withColumn("__time", event_time).withWatermark("__time", delay)
    names = T.StructType([T.StructField(c, stream.schema[c].dataType) for c in keys])
    stream = stream.withColumn("__key", F.to_json(F.struct(*keys)))
    stream = stream.withColumn("__part", F.pmod(F.xxhash64("__key"), F.lit(PARTS)))
    columns = ["__until", *fields]

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        old_keys, *old = state.get if state.exists else ([], *([] for _ in columns))
        table = pd.DataFrame({c: pd.array(x, "Int64") for c, x in zip(columns, old)}, index=old_keys)
        now = state.getCurrentWatermarkMs() if expire_ms else 0
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True)
            code, some = pd.factorize(rows["__key"])
            rows = rows.assign(__code=code).sort_values(["__code", *order], kind="stable", ignore_index=True)
            code = rows["__code"].to_numpy()
            first = np.concatenate([[True], code[1:] != code[:-1]])
            given = Ordered(
                rows, code, last_place(first), pd.Index(some).isin(table.index), table[fields].reindex(some)
            )
            columns_out, at, new, stay = step(given)
            if len(at):
                yield _typed({"__key": rows["__key"].to_numpy()[at], **columns_out}, f"__key string, {output}")
            until = pd.Series([0] * len(some), dtype="Int64")
            if expire_ms:
                last = rows["__time"].groupby(code).max().to_numpy().astype("datetime64[ms]").astype(np.int64)
                until = pd.Series(np.maximum(last, now) + expire_ms, dtype="Int64")
            new = pd.DataFrame({"__until": until.array, **{f: new[f].array for f in fields}}, index=some)
            table = pd.concat([table[~table.index.isin(some)], new[stay]])
        if expire_ms and len(table):
            gone = (table["__until"] < now).to_numpy()
            if unfinished is not None and gone.any():
                left = table[gone]
                found = unfinished(left.reset_index(drop=True))
                yield _typed(
                    {"__key": left.index.to_numpy()[found.pop("of")], **found}, f"__key string, {output}"
                )
            table = table[~gone]
        if not len(table):
            if state.exists:
                state.remove()
            return
        held = ([None if x is pd.NA else int(x) for x in table[c]] for c in columns)
        state.update((table.index.tolist(), *held))
        if expire_ms:
            state.setTimeoutTimestamp(max(int(table["__until"].min()), now))

    kinds = "keys array<string>, " + ", ".join(f"{c} array<long>" for c in columns)
    found = stream.groupBy("__part").applyInPandasWithState(
        advance, f"__key string, {output}", kinds, "append", timeout
    )
    found = found.withColumn("__key", F.from_json("__key", names))
    return found.select("__key.*", *[c for c in found.columns if c != "__key"])


def _known(raw: DataFrame, *names: str) -> list[str]:
    return [c for c in names if c in raw.columns]


def _typed(columns: dict, output: str) -> pd.DataFrame:
    """A frame with the columns and types of an output schema; longs may be null."""
    kinds = [c.split() for c in output.split(", ")]
    kind_of = {"long": "Int64", "boolean": "boolean", "string": "object"}
    return pd.DataFrame({n: pd.Series(columns[n], dtype=kind_of[k]) for n, k in kinds})


def stream_spans_overwrite(
    raw: DataFrame,
    *,
    is_error: Column | None = None,
    expire_after: str | None = None,
    delay: str = "10 seconds",
) -> DataFrame:
    """Call spans where a new entry replaces an open one.

    Returns marked ``is_error`` neither end nor clear a call. tgid is carried where the rows
    have it. A call that ``expire_after`` gives up is a row without ``end_ts``.
    """
    known = _known(raw, "tgid")
    output = "start_ts long, end_ts long" + "".join(f", {c} long" for c in known)

    def unfinished(held):
        nothing = [None] * len(held)
        out = {"of": np.arange(len(held)), "start_ts": held["opened"], "end_ts": nothing}
        return out | {c: nothing for c in known}

    def step(given):
        rows = given.rows
        entry = (rows["kind"] == "entry").to_numpy()
        before = given.own(np.arange(len(rows)) - 1)
        open_before = np.where(before >= 0, entry[before], given.known[given.code])
        done = np.flatnonzero(~entry & open_before)
        out = {"start_ts": given.picked("ts_ns", "opened", before, done)}
        out |= {"end_ts": _values(rows["ts_ns"], done)} | {c: _values(rows[c], done) for c in known}
        ends = given.ends
        return out, done, {"opened": _values(rows["ts_ns"], ends)}, entry[ends]

    rows = raw.withColumn("__ret", (F.col("kind") != "entry").cast("int"))
    if is_error is not None:
        rows = rows.where((F.col("__ret") == 0) | ~F.coalesce(is_error, F.lit(False)))
    found = _run_parts(
        rows,
        [COLLECTION, "tid", "name"],
        ["ts_ns", "__ret"],
        F.timestamp_micros((F.col("ts_ns") / 1000).cast("long")),
        output,
        ["opened"],
        step,
        expire_after,
        delay,
        unfinished,
    )
    return found.select(COLLECTION, F.col("tid").alias("pid"), "start_ts", "end_ts", "name", *known)


def stream_spans_keep_first(
    raw: DataFrame,
    *,
    expire_after: str | None = None,
    delay: str = "10 seconds",
    report_unfinished: bool = False,
) -> DataFrame:
    """Successful calls where an open entry is kept until its return.

    tgid is that of the entry, or the thread where the rows have none.
    """
    fields = ["tgid", "ts_ns", "address", "length", "advice"]
    column = {c: "__tgid" if c == "tgid" else c for c in fields}
    output = ", ".join(f"__{c} long" for c in fields)
    if report_unfinished:
        output += ", finished boolean"

    def table(columns, n, finished):
        extra = {"finished": [finished] * n} if report_unfinished else {}
        return {f"__{c}": x for c, x in columns.items()} | extra

    def unfinished(held):
        return {"of": np.arange(len(held)), **table({c: held[c] for c in fields}, len(held), False)}

    def step(given):
        rows = given.rows
        returned = (rows["kind"] != "entry").to_numpy()
        # An entry opens, a return closes.
        before = given.own(np.arange(len(rows)) - 1)
        open_before = np.where(before >= 0, ~returned[before], given.known[given.code])
        opens = given.own(last_place(~returned & ~open_before))
        done = np.flatnonzero(returned & open_before & (rows["ret"] == 0).to_numpy())
        out = {c: given.picked(column[c], c, opens, done) for c in fields}
        ends = given.ends
        new = {c: given.picked(column[c], c, opens, ends) for c in fields}
        return table(out, len(done), True), done, new, ~returned[ends]

    rows = raw.withColumn("__ret", (F.col("kind") != "entry").cast("int"))
    rows = rows.withColumn("__tgid", F.col("tgid" if "tgid" in raw.columns else "tid"))
    calls = _run_parts(
        rows,
        [COLLECTION, "tid", "name"],
        ["ts_ns", "__ret", "address", "length"],
        F.timestamp_micros((F.col("ts_ns") / 1000).cast("long")),
        output,
        fields,
        step,
        expire_after,
        delay,
        unfinished if report_unfinished else None,
    )
    extra = ["finished"] if report_unfinished else []
    calls = calls.select(COLLECTION, *[F.col(f"__{c}").alias(c) for c in fields], *extra)
    return calls.withColumn("advice", advice_label(F.col("advice")))


_WAKE, _ON, _OFF = 0, 1, 2


def stream_sched(
    raw: DataFrame, *, expire_after: str | None = None, delay: str = "10 seconds"
) -> DataFrame:
    """Run and queue times of every thread: ``what`` is ``run`` or ``queue``.

    cpu and tgid are those of the mark that ends a run or wait, where the rows have cpu,
    prev_tgid and next_tgid; with them the runs are the ``quanta_runtime`` table, the waits
    ``quanta_queued_time``. A run or wait that ``expire_after`` gives up is a row at its start
    without a length.
    """
    grouped = "prev_tgid" in raw.columns
    known = _known(raw, "cpu") + (["tgid"] if grouped else [])
    output = f"{UPTIME} long, what string, length_us long" + "".join(f", {c} long" for c in known)

    def table(parts):
        whole = {UPTIME: [], "length_us": [], **{c: [] for c in known}}
        what = []
        for name, columns in parts:
            what += [name] * len(columns[UPTIME])
            for c, x in columns.items():
                whole[c].append(pd.Series(x, dtype="Int64"))
        return {"what": what, **{c: pd.concat(x, ignore_index=True) for c, x in whole.items()}}

    def unfinished(held):
        parts, of = [], []
        for field, what in (("run_start", "run"), ("queue_start", "queue")):
            at = np.flatnonzero(held[field].notna())
            nothing = [pd.NA] * len(at)
            parts.append((what, {UPTIME: _values(held[field], at), "length_us": nothing, **{c: nothing for c in known}}))
            of.append(at)
        return {"of": np.concatenate(of), **table(parts)}

    def step(given):
        rows = given.rows
        ts, mark = rows["ts_us"], rows["step"].to_numpy()
        # A thread is off or on its CPU; a wakeup changes nothing.
        on = mark == _ON
        running = given.held["run_start"].notna().to_numpy()
        last_change = given.own(place_before(mark != _WAKE))
        off = (mark == _OFF) & np.where(last_change >= 0, on[last_change], running[given.code])
        waits = (mark == _WAKE) | off
        last_on, last_wait = given.own(place_before(on)), given.own(place_before(waits))
        # A wait is open before a row if it began after the last on mark.
        waiting = given.held["queue_start"].notna().to_numpy()
        open_ = np.where(last_on < 0, (last_wait >= 0) | waiting[given.code], last_wait > last_on)
        parts, at = [], []
        for done, what, begin, old in ((off, "run", last_on, "run_start"), (on & open_, "queue", last_wait, "queue_start")):
            done = np.flatnonzero(done)
            length = _values(ts, done) - given.picked("ts_us", old, begin, done)
            parts.append((what, {UPTIME: _values(ts, done), "length_us": length, **{c: _values(rows[c], done) for c in known}}))
            at.append(done)
        ends = given.ends
        change, on_at = given.own(last_place(mark != _WAKE)), given.own(last_place(on))
        wait_at = given.own(last_place(waits))
        runs = np.where(change[ends] >= 0, on[change[ends]], running)
        run = given.picked("ts_us", "run_start", on_at, ends).where(runs, pd.NA)
        queued = given.picked("ts_us", "queue_start", wait_at, ends)
        queued = queued.where((on_at[ends] < 0) | (wait_at[ends] > on_at[ends]), pd.NA)
        new = {"run_start": run, "queue_start": queued}
        return table(parts), np.concatenate(at), new, (run.notna() | queued.notna()).to_numpy()

    def mark_of(side: str, what: int) -> Column:
        tgid = [F.col(f"{side}_tgid").alias("tgid")] if grouped else []
        return F.struct(F.col(f"{side}_pid").alias("pid"), F.lit(what).alias("step"), *tgid)

    # As in batch, a row of any other kind marks nothing.
    mark = F.when(F.col("kind") == "switch", F.array(mark_of("next", _ON), mark_of("prev", _OFF)))
    mark = mark.when(F.col("kind").isin("wakeup", "wakeup_new"), F.array(mark_of("prev", _WAKE)))
    marks = (
        raw.select(COLLECTION, "ts_us", *_known(raw, "cpu"), F.explode(mark).alias("m"))
        .select(COLLECTION, "ts_us", *_known(raw, "cpu"), "m.*")
        .where(F.col("pid") != 0)
    )
    found = _run_parts(
        marks,
        [COLLECTION, "pid"],
        ["ts_us", "step"],
        F.timestamp_micros("ts_us"),
        output,
        ["run_start", "queue_start"],
        step,
        expire_after,
        delay,
        unfinished,
    )
    return found.select(COLLECTION, "pid", UPTIME, "what", "length_us", *known)


def stream_queue_depth(
    raw: DataFrame,
    *,
    expire_after: str | None = None,
    delay: str = "10 seconds",
    report_unfinished: bool = False,
) -> DataFrame:
    """Outstanding segments and 4 KiB blocks of a device right after each issue.

    cpu and block_io_flags are carried where the rows have them; with them this is the
    ``block_io_queue_length`` table. The state of a device lists its sectors with an open
    issue, which is as long as the device's queue; with ``report_unfinished`` a device that
    ``expire_after`` gives up leaves a row for each of them, with the queue as it was.
    """
    known = _known(raw, "cpu", "block_io_flags")
    depths = ["queue_length_segment_ios", "queue_length_4k_ios"]
    longs = ["device", "sector", "segments", "block_io_bytes", UPTIME, *depths, *known]
    output = "collection_id string, " + ", ".join(f"{c} long" for c in longs)
    if report_unfinished:
        output += ", finished boolean"

    def unfinished(key, held):
        segments, blocks, sectors = held
        n = len(sectors)
        out = {c: [None] * n for c in longs} | {COLLECTION: [key[0]] * n, "device": [key[1]] * n}
        out |= {"sector": sectors, depths[0]: [segments] * n, depths[1]: [blocks] * n}
        return _typed(out | {"finished": [False] * n}, output)

    def step(key, held, rows):
        segments, blocks, waiting = held or (0, 0, [])
        done = (rows["__done"] != 0).to_numpy()
        sector, n = rows["sector"].to_numpy(), rows["segments"].to_numpy()
        size = (rows["bytes"].to_numpy() + 4095) // (1 << fixed.PAGE_SHIFT)
        # A sector waits if its row before this one, or what the state says, is an issue.
        by_sector = np.argsort(sector, kind="stable")
        first = np.concatenate([[True], np.diff(sector[by_sector]) != 0])
        last = np.concatenate([first[1:], [True]])
        before = np.concatenate([[False], ~done[by_sector][:-1]])
        waits = np.empty(len(rows), bool)
        waits[by_sector] = np.where(first, np.isin(sector[by_sector], waiting), before)
        sign = np.where(~done, 1, np.where(waits, -1, 0))
        depth, depth_4k = segments + np.cumsum(sign * n), blocks + np.cumsum(sign * size)
        issue = ~done
        out = {COLLECTION: [key[0]] * int(issue.sum()), "device": [key[1]] * int(issue.sum())}
        out |= {"sector": sector[issue], "segments": n[issue], "block_io_bytes": rows["bytes"].to_numpy()[issue]}
        out |= {UPTIME: rows["ts_us"].to_numpy()[issue], depths[0]: depth[issue], depths[1]: depth_4k[issue]}
        out |= {c: rows[c].to_numpy()[issue] for c in known}
        out |= {"finished": [True] * int(issue.sum())} if report_unfinished else {}
        ends = by_sector[last]
        open_ = np.union1d(np.setdiff1d(np.array(waiting, np.int64), sector), sector[ends][~done[ends]])
        return _typed(out, output), (int(depth[-1]), int(depth_4k[-1]), [int(x) for x in open_])

    rows = raw.withColumn("__done", (F.col("kind") != "issue").cast("int"))
    return _run(
        rows,
        [COLLECTION, "device"],
        ["ts_us", "__done", "sector", "segments", "bytes"],
        F.timestamp_micros("ts_us"),
        output,
        "segments long, blocks long, sectors array<long>",
        step,
        expire_after,
        delay,
        unfinished if report_unfinished else None,
    )
