"""Streams: enrichment with entity statistics, stateful features over time, drift by window and by micro-batch."""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.drift import is_drifted, place, psi_of_counts, reference_bins
from tidemark.operators.scoring import serving_features


def enrich(stream: DataFrame, features: DataFrame, keys, entity_cols=None) -> DataFrame:
    """Stream-static left joins with the entity table; its ``last_updated`` may be old, which is accepted."""
    return serving_features(stream, features, keys, entity_cols)


#: What the stateful step gives: rows of an entity side by side, so that Spark gets some long arrays instead of many small rows.
VELOCITY = "entity string, ids array<bigint>, us array<bigint>, velocity array<bigint>, since_last array<double>, addr_changed array<boolean>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PACK = "entity string, t timestamp, packed binary"
#: Rows of a task that are packed together, and rows of an entity that are given at once.
PACKED, TOGETHER = 1 << 19, 4096


def stream_features(stream: DataFrame, id_col: str, entity_col: str, time_col: str, window_seconds: float, addr_cols: tuple[str, ...] = (), delay: str = "1 hour", forget_after: float = 30 * 86400, chunk: int = 64) -> DataFrame:
    """(id, entity, t, velocity, since_last, addr_changed) of each row of a stream; ``time_col`` is a timestamp.

    State of an entity: its times within the window, its last time and the addresses of its last row. The watermark is ``delay`` behind the latest time;
    once it is ``forget_after`` seconds (at least the window) past an entity's last time, a timer drops the entity's state, and it starts anew. Rows of a
    micro-batch are taken by time, then id; they come to the state packed, so that a value costs no call of its own. A row older than the state's last time is late: it counts what the state still has, is since nothing
    and no change, and does not become the last row; at or behind the micro-batch's watermark it is left out. Rows without entity or time are left out. Up to ``chunk`` times stand beside the last row, in one value that
    is read and written once for an entity and micro-batch. More are kept in chunks of about that size, each a value of
    its own, with an index of ends and counts: a row rewrites the chunk it falls into, so what is written for a row does not grow with the window, and a count
    reads the index and the chunks at the window's ends. Such state needs the RocksDB store; it is set for the session if another one is."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    t = F.col(time_col).cast("timestamp")
    addresses = [F.col(c).cast("string").alias(f"a{i}") for i, c in enumerate(addr_cols)]
    rows = stream.select(F.col(entity_col).cast("string").alias("entity"), F.unix_micros(t).alias("us"), F.col(id_col).cast("bigint").alias("id"), *addresses)
    packs = rows.where("entity is not null and us is not null").repartition("entity").mapInArrow(_packs, PACK).withWatermark("t", delay)
    state = EntityState(window_seconds, max(forget_after, window_seconds), chunk)
    found = packs.groupBy("entity").transformWithState(state, VELOCITY, "Append", "EventTime").select("entity", F.inline(F.arrays_zip("ids", "us", "velocity", "since_last", "addr_changed")))
    return found.select(F.col("ids").alias("id"), "entity", F.timestamp_micros("us").alias("t"), "velocity", "since_last", "addr_changed")


class Chunks:
    """Sorted times in chunks that follow each other; ``index`` has (first, last, count) by number, times are read when they are asked for."""

    def __init__(self, index: dict[int, tuple[float, float, int]], read: Callable[[int], list[float]], size: int):
        self.index, self.read, self.size = dict(sorted(index.items())), read, size
        self.times: dict[int, np.ndarray] = {}
        self.changed: set[int] = set()
        self._ends: tuple[list[int], list[float], list[int]] | None = None

    def chunk(self, number: int) -> np.ndarray:
        if number not in self.times:
            self.times[number] = np.array(self.read(number), dtype=np.float64)
        return self.times[number]

    def before(self, x: float, side: str) -> int:
        """How many times are below x (side left), or up to it (right): all of the chunks that end there, and some of the next one."""
        if self._ends is None:
            values = list(self.index.values())
            self._ends = list(self.index), [v[1] for v in values], [0, *accumulate(v[2] for v in values)]
        numbers, lasts, counts = self._ends
        k = (bisect_left if side == "left" else bisect_right)(lasts, x)
        total = counts[k]
        if k < len(numbers) and self.index[numbers[k]][0] <= x:
            total += int(np.searchsorted(self.chunk(numbers[k]), x, side))
        return total

    def _put(self, number: int, times: np.ndarray) -> None:
        self.times[number], self.index[number] = times, (float(times[0]), float(times[-1]), len(times))
        self.changed.add(number)
        self._ends = None

    def add(self, x: float) -> None:
        """Into the last chunk that begins up to x, or a new one behind it if that is full and last."""
        numbers = list(self.index)
        number = next((k for k in reversed(numbers) if self.index[k][0] <= x), numbers[0] if numbers else 0)
        if numbers and number == numbers[-1] and self.index[number][2] >= self.size and x >= self.index[number][1]:
            number += 1
        old = self.chunk(number) if number in self.index else np.zeros(0)
        self._put(number, np.insert(old, np.searchsorted(old, x, "right"), x))

    def extend(self, xs: list[float]) -> None:
        """The same for each of ``xs``, which are sorted; what follows all times is added by the chunk."""
        number = max(self.index, default=0)
        late = bisect_left(xs, self.index[number][1]) if self.index else 0
        for x in xs[:late]:
            self.add(x)
        rest = np.array(xs[late:], dtype=np.float64)
        while len(rest):
            old = self.chunk(number) if number in self.index else np.zeros(0)
            free = max(self.size - len(old), 0)
            if free:
                self._put(number, np.concatenate([old, rest[:free]]))
            number, rest = number + 1, rest[free:]

    def drop_before(self, x: float) -> list[int]:
        """Numbers of the chunks that are older than x as a whole; they are forgotten."""
        gone = [k for k, (_, last, _) in self.index.items() if last < x]
        for k in gone:
            del self.index[k]
            self.changed.discard(k)
        self._ends = None
        return gone


class EntityState(StatefulProcessor):
    """The state of one entity and what a micro-batch of its rows makes of it. Each call of the state is a message to the JVM and back, so an entity with few times in its window
    makes two or three: its ``head`` is read and written, and a timer is set if none is pending."""

    def __init__(self, window_seconds: float, forget_after: float, chunk: int):
        self.window, self.keep_ms, self.size = window_seconds, int(forget_after * 1000), chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getMapState("index", "number bigint", "first double, last double, n int")
        self.chunks = handle.getMapState("chunks", "number bigint", "times array<double>")
        # times: all that are kept, null if they are in chunks; timer: when the pending one fires
        self.head = handle.getValueState("head", "t double, addresses array<string>, timer bigint, times array<double>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        ids, us, own = _by_time([pickle.loads(row.packed) for row in rows])
        # Spark tells packs behind the watermark by their latest time, so some rows of the others are behind it
        behind = bisect_right(us, timerValues.getCurrentWatermarkInMs() * 1000) if timerValues.getCurrentWatermarkInMs() > 0 else 0
        if behind:
            ids, us, own = ids[behind:], us[behind:], [column[behind:] for column in own]
        if not us:
            return
        last, address, timer, held = self.head.get() or (-math.inf, [], None, [])
        last, known = float(last), {}
        if held is None:
            known = {int(k[0]): (v[0], v[1], v[2]) for k, v in self.index.iterator()}
            times = Chunks(known, lambda number: self.chunks.getValue((number,))[0], self.size)
        else:
            times = Chunks({0: (held[0], held[-1], len(held))} if held else {}, lambda _: held, self.size)
        newest = max((v[1] for v in times.index.values()), default=-math.inf)
        now = np.array(us) / 1e6
        since = now - self.window
        velocity = np.arange(len(now)) - np.searchsorted(now, since, "left")
        for i in range(np.searchsorted(since, newest, "right")):
            velocity[i] += times.before(now[i], "right") - times.before(since[i], "left")
        before = np.maximum(np.concatenate([[last], now[:-1]]), last)
        timely = np.isfinite(before) & (now >= before)
        gap = [g if ok else None for g, ok in zip((now - before).tolist(), timely.tolist(), strict=True)]
        late = int(np.searchsorted(now, last, "left"))
        turned = np.zeros(len(now), bool)
        for old, column in zip(address or [None] * len(own), own, strict=False):
            turned[late:] |= [x is not None and y is not None and x != y for x, y in zip([old, *column[late:-1]], column[late:], strict=False)]
        if late < len(now):
            address, ended = [column[-1] for column in own], float(now[-1])
        else:
            ended = last
        velocity, changed, now = velocity.tolist(), turned.tolist(), now.tolist()
        times.extend(now)
        gone = times.drop_before(ended - self.window)
        one = next(iter(times.index)) if len(times.index) == 1 else None
        if one is not None and times.index[one][2] <= self.size:
            held = times.chunk(one).tolist()
            gone, written = known, []
        else:
            held, written = None, sorted(times.changed if known else times.index)
        for number in gone:
            if number in known:
                self.index.removeKey((number,))
                self.chunks.removeKey((number,))
        for number in written:
            self.index.updateValue((number,), times.index[number])
            self.chunks.updateValue((number,), (times.chunk(number).tolist(),))
        if timer is None:
            timer = max(int(ended * 1000) + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
        self.head.update((ended, list(address), timer, held))
        for k in range(0, len(us), TOGETHER):
            part = slice(k, k + TOGETHER)
            yield Row(entity=key[0], ids=ids[part], us=us[part], velocity=velocity[part], since_last=gap[part], addr_changed=changed[part])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """Rows that came after the timer was set put the end off."""
        last, address, _, held = self.head.get()
        expires = int(last * 1000) + self.keep_ms
        if expires > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(expires)
            self.head.update((last, list(address), expires, held))
        else:
            for state in (self.index, self.chunks) if held is None else ():
                state.clear()
            self.head.clear()
        yield from ()

    def close(self) -> None:
        pass


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entity, us, id, addresses) of a task as one row for each entity of up to ``PACKED`` and some more rows: the latest time, and pickled lists of ids, times and each address, by time, then id."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= PACKED:
            yield _packed(held)
            held, n = [], 0
    if n:
        yield _packed(held)


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("entity", "us", "id")]))
    entity, us = rows["entity"].to_pandas().to_numpy(), rows["us"].to_numpy()
    missing, ids = rows["id"].is_null().to_numpy(), rows["id"].fill_null(0).to_numpy()
    if missing.any():
        ids = np.where(missing, None, ids)
    addresses = [rows[c].to_pandas().to_numpy() for c in rows.column_names[3:]]
    starts = np.concatenate([[0], np.flatnonzero(entity[1:] != entity[:-1]) + 1, [len(us)]]).tolist()
    packed = [pickle.dumps((ids[a:b].tolist(), us[a:b].tolist(), [x[a:b].tolist() for x in addresses])) for a, b in zip(starts, starts[1:], strict=False)]
    latest = us[np.array(starts[1:]) - 1]
    return pa.RecordBatch.from_arrays([pa.array(entity[starts[:-1]], pa.string()), pa.array(latest, pa.timestamp("us", "UTC")), pa.array(packed, pa.binary())], ["entity", "t", "packed"])


def _by_time(packs: list[tuple[list, list, list[list]]]) -> tuple[list, list, list[list]]:
    """The packs of an entity as one."""
    if len(packs) == 1:
        return packs[0]
    ids, us = [i for p in packs for i in p[0]], [t for p in packs for t in p[1]]
    order = sorted(range(len(us)), key=lambda k: (us[k], ids[k] is None, ids[k] or 0))
    addresses = [[x for column in columns for x in column] for columns in zip(*[p[2] for p in packs], strict=True)]
    return [ids[k] for k in order], [us[k] for k in order], [[column[k] for k in order] for column in addresses]


def windowed_drift(stream: DataFrame, time_col: str, col: str, bins: DataFrame, window: str = "1 day", delay: str = "1 hour", threshold: float = 0.2) -> DataFrame:
    """(start, end, n, psi, drifted) of each tumbling window of a stream's event time, against the one row of ``reference_bins``.

    The bins are read once, when the stream is planned. A window's state is a count for each bin, so partial counts are combined before the shuffle, and
    state is as large as the number of open windows. In append mode a window is given once the watermark, ``delay`` behind the latest
    time, has passed its end; rows that come later are not counted. Missing values are left out, as in the batch statistic; a window without any value has null."""
    known = bins.first()
    edges, counts = list(known["edges"]), list(known["counts"])
    x = F.col(col).cast("double")
    rows = stream.where(F.col(time_col).isNotNull()).withWatermark(time_col, delay).select(F.col(time_col), F.when(~F.isnan(x), x).alias("x"))
    each = [F.count_if(F.col("x").isNotNull() & (place(edges, F.col("x")) == i)).alias(f"b{i}") for i in range(len(edges) + 1)]
    counted = rows.groupBy(F.window(time_col, window).alias("w")).agg(*each)
    of_window = F.array(*[F.col(f"b{i}") for i in range(len(edges) + 1)])
    psi = psi_of_counts(F.array(*[F.lit(c).cast("bigint") for c in counts]), of_window)
    n = F.aggregate(of_window, F.lit(0).cast("bigint"), lambda a, c: a + c)
    return counted.select("w.start", "w.end", n.alias("n"), psi.alias("psi")).withColumn("drifted", is_drifted(F.col("psi"), threshold))


def drift_batches(reference: DataFrame, col: str, report: Callable[[int, float], None], bins: int = 10) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives each micro-batch's PSI against the reference to ``report``. The reference is read here, once."""
    known = reference_bins(reference, col, bins).first()
    edges, counts = list(known["edges"]), list(known["counts"])

    def each(batch: DataFrame, number: int) -> None:
        x = F.col(col).cast("double")
        values = batch.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x))
        own = values.agg(F.array(*[F.count_if(place(edges, F.col("x")) == i) for i in range(len(edges) + 1)]).alias("c"))
        psi = own.select(psi_of_counts(F.array(*[F.lit(c).cast("bigint") for c in counts]), F.col("c")).alias("psi")).first()["psi"]
        if psi is not None:
            report(number, psi)

    return each
