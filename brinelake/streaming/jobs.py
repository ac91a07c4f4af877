"""Streaming forms of the stateful jobs.

Times of streams must be timestamps with zone, as watermarks ask; ``zoned`` makes them so.  State machines run
in transformWithStateInPandas with the RocksDB provider, one value of state per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rollup import PERIOD
from .versions import VersionedTable

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def zoned(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp"))


def period_counts(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Five-minute counts per origin; a period is final ``lateness`` after its end."""
    return (
        stream.withWatermark("time", lateness)
        .groupBy(F.window("time", PERIOD).alias("w"), "origin")
        .agg(F.count("*").alias("count"))
        .select(F.col("w.start").alias("start"), "origin", "count")
    )


def without_redelivery(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The first arrival of each row key within the lateness."""
    return stream.withWatermark("time", lateness).dropDuplicatesWithinWatermark(["time", "origin", "context", "connector", "path"])


def _columns(rows, names: list[str], arrival: tuple[str, ...] = ("seq",)):
    """The frames of a key in one trigger, and the columns ``names`` of all of them as arrays in the order of ``arrival``, with the order.

    A trigger's rows are bounded by the stream's ``maxBytesPerTrigger``; frames are neither joined nor sorted.
    """
    import numpy as np

    frames = [f for f in rows if len(f)]
    if not frames:
        return [], [np.empty(0)] * len(names), np.empty(0, np.int64)
    order = np.lexsort([np.concatenate([f[c].to_numpy() for f in frames]) for c in reversed(arrival)])
    return frames, [np.concatenate([f[c].to_numpy() for f in frames])[order] for c in names], order


class _Scan(StatefulProcessor):
    """Base of state machines with one value of state for each key, rows of a trigger in order of arrival.

    ``READS`` are the columns that decide whether a row is kept, ``ARRIVAL`` those that order rows.
    """

    STATE, READS, ARRIVAL = "a timestamp, b string", ("time", "value"), ("seq",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.STATE)

    def close(self) -> None:
        pass

    def keep(self, state: tuple | None, *values) -> tuple[bool, tuple | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        frames, columns, order = _columns(rows, self.READS, self.ARRIVAL)
        state = tuple(self.state.get()) if self.state.exists() else None
        kept = np.zeros(len(order), bool)
        columns = [pd.Series(c) if c.dtype.kind == "M" else c.tolist() for c in columns]
        for place, values in zip(order.tolist(), zip(*columns)):
            kept[place], state = self.keep(state, *values)
        if state is not None:
            self.state.update(state)
        at = 0
        for f in frames:
            yield f[kept[at : at + len(f)]]
            at += len(f)


class RateLimit(_Scan):
    """Rows later than the last one let through by more than the interval (seconds)."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    READS = ("time",)

    def keep(self, state, time):
        from datetime import timedelta

        if state is None or time > state[0] + timedelta(seconds=self.seconds):
            return True, (time, None)
        return False, state


class Changes(_Scan):
    """Rows that aren't older than, and differ from, the last row kept."""

    def __init__(self, arrival: tuple[str, ...] = ("seq",)):
        self.ARRIVAL = arrival

    def keep(self, state, time, value):
        if state is not None and (time < state[0] or str(value) == state[1]):
            return False, state
        return True, (time, str(value))


class Silence(StatefulProcessor):
    """A row for each time that a key sent nothing for longer than the timeout (seconds of event time)."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "t timestamp")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        times = np.sort(np.concatenate([np.empty(0, "M8[ns]"), *[part["time"].dropna().to_numpy("M8[ns]") for part in rows]]))
        before = [np.datetime64(pd.Timestamp(self.last.get()[0]), "ns")] if self.last.exists() else list(times[:1])
        newest = np.maximum.accumulate(np.concatenate([np.array(before, "M8[ns]"), times]))
        if len(newest):
            self.last.update((pd.Timestamp(newest[-1]).to_pydatetime(),))
        gaps = np.flatnonzero(times - newest[: len(times)] > np.timedelta64(round(self.seconds * 1e9), "ns"))
        yield pd.DataFrame({"connector": pd.Series([key[0]] * len(gaps), dtype=object), "last_seen": newest[gaps], "next_seen": times[gaps]})


class Absence(Silence):
    """As Silence, and a row without a next time as soon as the watermark says that a key has been silent for longer than the timeout.

    Each key has one event-time timer, that of its newest row; a key that returns later gives a row with that time too.
    """

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        for out in super().handleInputRows(key, rows, timerValues):
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            last = pd.Timestamp(self.last.get()[0])
            self.handle.registerTimer(int(last.timestamp() * 1000 + self.seconds * 1000))
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        found = pd.DataFrame([(key[0], self.last.get()[0])], columns=["connector", "last_seen"])
        found["next_seen"] = pd.Series([pd.NaT], dtype="datetime64[ns]")
        yield found


class NewValues(_Scan):
    """Rows whose value isn't the stored one of the key, or whose stored one is older than its life (seconds of event time).

    The state can be seeded from stored rows (time and value), and a timer removes what has outlived its life.
    """

    STATE = "time timestamp, value string"

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def keep(self, state, time, value):
        from datetime import timedelta

        if state is not None and str(value) == state[1] and time <= state[0] + timedelta(seconds=self.seconds):
            return False, state
        return True, (time, str(value))

    def _renew(self) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if self.state.exists():
            self.handle.registerTimer(int((self.state.get()[0].timestamp() + self.seconds) * 1000) + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.sort_values("time").iloc[-1]
        self.state.update((row["time"].to_pydatetime(), str(row["value"])))
        self._renew()

    def handleInputRows(self, key, rows, timerValues):
        yield from super().handleInputRows(key, rows, timerValues)
        self._renew()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        self.state.clear()
        yield pd.DataFrame()


class SampleBlocks(StatefulProcessor):
    """Blocks of ``size`` samples of a (context, path): place, value, and seconds from the block's first sample to the next block's.

    Samples are in order of time; of equal times the last to arrive counts.  A block is given once the next one is full, so
    fewer than twice ``size`` samples are kept, and one that comes out of order finds its place among them.  New samples are appended to a
    list; only when a block may be full is the list read, and what is left of it written.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "done bigint, held bigint")
        self.held = handle.getListState("held", "time timestamp, value double, seq bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        n = self.size
        _, (times, values, seqs), _ = _columns(rows, ["time", "value", "seq"])
        done, held = self.counts.get() if self.counts.exists() else (0, 0)
        new = list(zip(pd.Series(times).dt.to_pydatetime().tolist() if len(times) else [], map(float, values), map(int, seqs)))
        if held + len(new) < 2 * n:
            self.held.appendList(new)
            self.counts.update((done, held + len(new)))
            return
        samples = pd.DataFrame([*(self.held.get() if held else ()), *new], columns=["time", "value", "seq"])
        samples = samples.sort_values(["time", "seq"], kind="stable").drop_duplicates("time", keep="last")
        out = []
        while len(samples) >= 2 * n:
            own, after = samples.iloc[:n], samples.iloc[n]
            duration = (after["time"] - own["time"].iloc[0]).total_seconds()
            out += [(*key, done, k, v, duration) for k, v in enumerate(own["value"])]
            samples, done = samples.iloc[n:], done + 1
        self.held.put([(r.time.to_pydatetime(), r.value, r.seq) for r in samples.itertuples(index=False)])
        self.counts.update((done, len(samples)))
        yield pd.DataFrame(out, columns=["context", "path", "block", "place", "value", "duration"])


class MovingAverage(StatefulProcessor):
    """seq and the average over the ``seconds`` before each row, its own time included, once the watermark has passed the row's bucket.

    Values are kept in buckets of ``bucket`` seconds, a map entry each with the sum and number of its values, which aren't null, and its
    rows.  A row that comes late, but within the watermark, goes to its bucket and counts in all averages that it belongs to.  When the
    watermark passes a bucket's end a timer gives the bucket's averages, from sums of whole buckets and the rows of the
    first, and removes the bucket that no window reaches any more.  Rows behind the watermark are dropped.
    """

    def __init__(self, seconds: int, bucket: int):
        if seconds % bucket:
            raise ValueError("the retention is a number of whole buckets")
        self.step, self.reach = bucket * 1_000_000, seconds // bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket bigint", "total double, n bigint, times array<bigint>, seqs array<bigint>, vals array<double>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np

        _, (times, values, seqs), _ = _columns(rows, ["time", "value", "seq"])
        micros = times.astype("datetime64[us]").astype(np.int64)
        values = np.asarray(values, float)  # null is NaN
        behind = timerValues.getCurrentWatermarkInMs() * 1000
        for b in np.unique(micros // self.step).tolist():
            end = (b + 1) * self.step
            own = np.flatnonzero((micros // self.step == b) & (end > behind))
            if not len(own):
                continue
            total, n, held_times, held_seqs, held = self.buckets.getValue((b,)) if self.buckets.containsKey((b,)) else (0.0, 0, [], [], [])
            there = values[own][~np.isnan(values[own])]
            entry = float(total + there.sum()), int(n + len(there)), [*held_times, *micros[own].tolist()], [*held_seqs, *map(int, seqs[own])]
            self.buckets.updateValue((b,), (*entry, [*held, *(None if np.isnan(v) else float(v) for v in values[own])]))
            if not held_times:
                self.handle.registerTimer(end // 1000)
        return iter(())

    def _rows(self, b: int):
        import numpy as np

        if not self.buckets.containsKey((b,)):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        _, _, times, seqs, values = self.buckets.getValue((b,))
        return np.asarray(times, np.int64), np.asarray(seqs, np.int64), np.asarray([np.nan if v is None else v for v in values], float)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import numpy as np
        import pandas as pd

        b = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.step - 1
        times, seqs, values = self._rows(b)
        oldest, _, old_values = self._rows(b - self.reach)
        whole = [self.buckets.getValue((k,))[:2] for k in range(b - self.reach + 1, b) if self.buckets.containsKey((k,))]
        total, n = sum(w[0] for w in whole), sum(w[1] for w in whole)

        def running(at, x):
            order = np.argsort(at, kind="stable")
            there = ~np.isnan(x[order])
            sums = np.concatenate([[0.0], np.cumsum(np.where(there, x[order], 0.0))])
            return at[order], sums, np.concatenate([[0], np.cumsum(there)])

        own_times, own_sums, own_counts = running(times, values)
        old_times, old_sums, old_counts = running(oldest, old_values)
        here = np.searchsorted(own_times, times, side="right")
        there = np.searchsorted(old_times, times - self.reach * self.step, side="left")
        sums = total + own_sums[here] + old_sums[-1] - old_sums[there]
        counts = n + own_counts[here] + old_counts[-1] - old_counts[there]
        # the next bucket reaches back to the one after this
        if self.buckets.containsKey((b - self.reach,)):
            self.buckets.removeKey((b - self.reach,))
        average = np.divide(sums, counts, out=np.full(len(seqs), np.nan), where=counts > 0)
        yield pd.DataFrame({"seq": seqs, "average": average})


class Combine(_Scan):
    """Derived rows (context, time, value, seq) of an expression over the last values of several paths."""

    def __init__(self, sources: list[str], combine: Callable[..., float]):
        self.sources, self.combine = sources, combine

    STATE = "a timestamp, b string"

    def handleInputRows(self, key, rows, timerValues):
        import json

        import pandas as pd

        known, newest, out = {}, None, []
        if self.state.exists():
            newest, text = self.state.get()
            known = json.loads(text)
        _, (paths, times, values, seqs), _ = _columns(rows, ["path", "time", "value", "seq"])
        for path, time, value, seq in zip(paths, pd.Series(times), values, seqs):
            if path not in self.sources:
                continue
            known[path] = float(value)
            newest = time if newest is None else max(pd.Timestamp(newest), time)
            if len(known) == len(self.sources):
                out.append((key[0], newest, self.combine(*[known[p] for p in self.sources]), seq))
        if newest is not None:
            self.state.update((newest, json.dumps(known)))
        yield pd.DataFrame(out, columns=["context", "time", "value", "seq"])


class RegisterDeltas(StatefulProcessor):
    """delta and time_delta (milliseconds) of register rows of a (connector, slave), by the rules of the batch form.

    A map from register to its last word and time; the first message of a slave is told apart by a flag.  A trigger reads and writes
    the entries of its own registers alone.  Rows: time, seq, register, word.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "seq bigint")
        self.last = handle.getMapState("last", "register int", "word int, time timestamp")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        from ..operators.registers import LIMIT, WRAP

        _, (registers, words, times, seqs), _ = _columns(rows, ["register", "word", "time", "seq"])
        if not len(seqs):
            return
        times = times.astype("datetime64[us]")
        by = np.lexsort((seqs, times))  # a message is a time and a seq
        first = (int(seqs[by[0]]),) if not self.known.exists() else None
        if first:
            self.known.update(first)
        by = np.lexsort((seqs, times, registers))
        registers, words, times, seqs = registers[by], words[by].astype(np.int64), times[by], seqs[by]
        new = np.ones(len(seqs), bool)
        new[1:] = registers[1:] != registers[:-1]
        before, then = np.zeros(len(seqs), np.int64), np.full(len(seqs), np.datetime64("NaT", "us"))
        before[1:], then[1:] = words[:-1], times[:-1]
        then[new] = np.datetime64("NaT", "us")
        before[new] = 0
        met = ~new
        for k in np.flatnonzero(new).tolist():
            register = (int(registers[k]),)
            if self.last.containsKey(register):
                word, time = self.last.getValue(register)
                before[k], then[k], met[k] = word, np.datetime64(time, "us"), True
        for k in np.flatnonzero(np.append(new[1:], True)).tolist():
            self.last.updateValue((int(registers[k]),), (int(words[k]), pd.Timestamp(times[k]).to_pydatetime()))
        step = words - before
        delta = np.where(step < -LIMIT, step + WRAP, np.where(step > LIMIT, step - WRAP, step))
        if first:
            delta = np.where(~met & (seqs == first[0]), words, delta)
        millis = pd.Series((times - then) / np.timedelta64(1000, "us")).apply(np.trunc).astype("Int64")
        yield pd.DataFrame({"seq": seqs, "register": registers, "delta": delta, "time_delta": millis})


class Flush(StatefulProcessor):
    """Batches of texts of a key in order of arrival: of ``size`` + 1 as soon as there are so many, and what is left after ``seconds``.

    What is left is a list in state, carried from trigger to trigger; a timer, set when the first text of a batch comes, flushes it.  It
    goes by the clock, or with ``event_time`` by the watermark and the text's own time, so that how fast triggers follow each other
    decides nothing.  Rows: seq, text, and time for ``event_time``.  Out: the key, the batch's number, how many texts it has, and a JSON array of them.
    """

    def __init__(self, size: int, seconds: float, columns: list[str], event_time: bool = False):
        self.size, self.seconds, self.columns, self.event_time = size, seconds, columns, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.given, self.held = handle.getValueState("given", "batches bigint, held bigint"), handle.getListState("held", "text string")

    def close(self) -> None:
        pass

    def _batches(self, key, number, batches):
        import pandas as pd

        rows = [(*key, number + k, len(texts), "[" + ",".join(texts) + "]") for k, texts in enumerate(batches)]
        return pd.DataFrame(rows, columns=[*self.columns, "batch", "n", "payload"])

    def _timers(self) -> list:
        return list(self.handle.listTimers())

    def handleInputRows(self, key, rows, timerValues):
        _, (texts, *times), _ = _columns(rows, ["text", "time"] if self.event_time else ["text"])
        new = texts.tolist()
        if not new:
            return
        number, held = self.given.get() if self.given.exists() else (0, 0)
        first = 0  # of the new texts the first of the batch that is left
        if held + len(new) <= self.size:  # only what is new is written
            self.held.appendList([(t,) for t in new])
            held += len(new)
        else:
            have = [t[0] for t in self.held.get()] + new if held else new
            at = len(have) // (self.size + 1) * (self.size + 1)
            yield self._batches(key, number, [have[k : k + self.size + 1] for k in range(0, at, self.size + 1)])
            number, first, held = number + at // (self.size + 1), at - held, len(have) - at
            self.held.put([(t,) for t in have[at:]]) if held else self.held.clear()
            for timer in self._timers():
                self.handle.deleteTimer(timer)
        self.given.update((number, held))
        if held and not self._timers():
            now = int(times[0][first].astype("datetime64[ms]").astype(int)) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + int(self.seconds * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        number, held = self.given.get()
        if held:
            yield self._batches(key, number, [[t[0] for t in self.held.get()]])
            self.held.clear()
            self.given.update((number + 1, 0))


def run_machine(stream: DataFrame, keys: list[str], machine: StatefulProcessor, schema=None, time_mode: str = "None", seed: DataFrame | None = None) -> DataFrame:
    """The rows a state machine gives; the same rows as the input's unless ``schema`` says otherwise.

    ``time_mode`` is EventTime for machines with timers, whose stream needs a watermark.  ``seed`` has stored rows to begin with.
    """
    first = None if seed is None else seed.groupBy(*keys)
    return stream.groupBy(*keys).transformWithStateInPandas(machine, schema or stream.schema, "Append", time_mode, first)


def upsert_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into the versioned table at ``path``, only in the dates that it has.

    Delivering a batch again changes nothing: the key decides, and metadata stays as it came first.
    """
    from ..operators.upsert import upsert

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("date", F.to_date("time")).withColumn("own_context", F.col("context") == F.col("origin"))
        VersionedTable(path, "date").commit(new, number, upsert)

    return merge


def registry_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch's vessel data into the registry at ``path``, column by column."""
    from ..operators.upsert import merge_registry, registry_updates

    def merge(batch: DataFrame, number: int) -> None:
        VersionedTable(path).commit(registry_updates(batch), number, merge_registry)

    return merge


def count_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that replaces the counts of the periods and origins that a batch has: of several the newest by seq.

    Rows: start, origin, count, seq.  Only the days of the batch are written.
    """

    def merge(batch: DataFrame, number: int) -> None:
        newest = lambda rows: rows.groupBy("date", "start", "origin").agg(F.max_by("count", "seq").alias("count"), F.max("seq").alias("seq"))
        new = newest(batch.withColumn("date", F.to_date("start")))
        VersionedTable(path, "date").commit(new, number, lambda old, given: newest(old.unionByName(given)))

    return merge


def rollup_batches(base: str, rollup: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts each batch into the table at ``base`` and refreshes the five-minute counts at ``rollup``.

    A batch, late or repeated as its rows may be, makes only the buckets stale in which it has rows; these are counted again from the
    stored rows of their days, and take the place of the old counts.  All other buckets and days stay as they are.
    """
    from ..operators.rollup import period_counts as counted
    from ..operators.rollup import period_start

    store = upsert_batches(base)

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store(batch, number)
        stale = batch.select(period_start("time").alias("start"), "origin").distinct()
        dates = [r[0] for r in batch.select(F.date_format("time", "yyyy-MM-dd")).distinct().collect()]
        schema = batch.withColumns({"date": F.to_date("time"), "own_context": F.lit(True)}).schema
        rows = VersionedTable(base, "date").read(spark, schema, dates, number)
        fresh = rows.withColumn("start", period_start("time")).join(stale, ["start", "origin"], "left_semi")
        counts = counted(fresh.drop("start")).withColumn("date", F.to_date("start"))
        replace = lambda old, new: old.join(stale, ["start", "origin"], "left_anti").select(*new.columns).unionByName(new)
        VersionedTable(rollup, "date").commit(counts, number, replace)

    return merge


def batch_writer(path: str, delta, size: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a trigger's deltas in batches of ``size`` + 1 and what is left over: a flush by count or by the trigger's interval.

    Each trigger has a folder of its own, so that delivering it again changes nothing.  ``Flush`` carries what is left to the next trigger instead.
    """
    from ..operators.export import batches

    def write(batch: DataFrame, number: int) -> None:
        batches(batch, delta, size).write.mode("overwrite").parquet(f"{path}/trigger={number}")

    return write


def latest(stream: DataFrame) -> DataFrame:
    """The newest value of each (context, path), kept up to date."""
    return stream.groupBy("context", "path").agg(F.max_by(F.struct("time", "value", "seq"), F.struct("time", "seq")).alias("r")).select("context", "path", "r.*")
