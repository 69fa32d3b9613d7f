"""Structured Streaming over traces and store logs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.metrics import rate_sums, rates_of_sums


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_batch).load(path)


def stage_stream(batches: DataFrame, out: str, checkpoint: str) -> None:
    """After each micro-batch the rates of everything so far are written as the newest step. Runs until the input is used up.

    A step keeps sums per world, to which the next batch adds its own, so a batch reads its rows and one small table only.
    """
    columns = rate_sums()

    def evaluate(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        sums = df.groupBy("world").agg(*columns)
        if batch_id:
            sums = sums.unionByName(spark.read.schema(sums.schema).parquet(f"{out}/sums/step={batch_id - 1}"))
        sums.groupBy("world").agg(*[F.sum(c).alias(c) for c in sums.columns if c != "world"]).write.mode("overwrite").parquet(f"{out}/sums/step={batch_id}")
        spark.read.schema(sums.schema).parquet(f"{out}/sums/step={batch_id}").select("world", "n", *rates_of_sums()).write.mode("overwrite").parquet(f"{out}/rates/step={batch_id}")

    batches.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def dedup_trace(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The trace without events of keys seen already within the watermark; state ends with it."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def dedup_batch(rows: DataFrame, keys: list[str], order: list[str], done: DataFrame | None = None) -> DataFrame:
    """Batch twin: the first event per key, without the keys that are done."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("f")).select(*keys, "f.*")
    return first if done is None else first.join(done, keys, "left_anti")


def fold_batch(log: DataFrame, run: str, mem: str, seq: str, value: str) -> DataFrame:
    """Live store after a log of actions: the last action that counts per entry. An update of an unknown entry adds it, a
    delete of an unknown one and a NONE change nothing."""
    last = log.where("action <> 'NONE'").groupBy(run, mem).agg(F.max_by("action", seq).alias("action"), F.max_by(value, seq).alias("value"), F.max(seq).alias("last_seq"))
    return last.where("action <> 'DELETE'").select(run, mem, "value", "last_seq")


def last_actions(rows: Iterator[pd.DataFrame], mem: str, seq: str) -> pd.DataFrame:
    """Of one run's rows, which come in chunks, each entry's last action that counts: one frame with a row per entry."""
    last = pd.DataFrame()
    for chunk in rows:
        both = pd.concat([last, chunk[chunk["action"] != "NONE"]])
        last = both.sort_values(seq).drop_duplicates(mem, keep="last")
    return last


class Fold:
    """State per run: a map from entry to its last action that counts, by seq, so micro-batches may come in any order; a deleted
    entry stays as a mark for older actions that come late. With `late`, marks that many numbers behind the newest of a run go,
    so that state follows the living entries. Of every batch only the entries that it changed come out, with whether they live.
    Used by transformWithStateInPandas."""

    def __init__(self, run: str, mem: str, seq: str, value: str, late: int | None = None):
        self.run, self.mem, self.seq, self.value, self.late = run, mem, seq, value, late

    def init(self, handle) -> None:
        self.live = handle.getMapState("live", f"{self.mem} int", "value double, last_seq long")
        self.gone = handle.getMapState("gone", f"{self.mem} int", "last_seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        for r in last_actions(rows, self.mem, self.seq).itertuples(index=False):
            entry, seq, value = (int(getattr(r, self.mem)),), int(getattr(r, self.seq)), float(getattr(r, self.value))
            held = self.live.getValue(entry)[1] if self.live.containsKey(entry) else self.gone.getValue(entry)[0] if self.gone.containsKey(entry) else -1
            if held >= seq:
                continue
            if r.action == "DELETE":
                self.gone.updateValue(entry, (seq,))
                self.live.removeKey(entry)
            else:
                self.live.updateValue(entry, (value, seq))
                self.gone.removeKey(entry)
            out.append((key[0], entry[0], value, seq, r.action != "DELETE"))
        if self.late is not None and out:
            newest = max(x[3] for x in out)
            for entry in [k for k, v in self.gone.iterator() if v[0] < newest - self.late]:
                self.gone.removeKey(entry)
        yield pd.DataFrame(out, columns=[self.run, self.mem, "value", "last_seq", "live"])

    def close(self) -> None:
        pass


class Renaming:
    """Takes one run's actions in order of seq and says what becomes of the store.

    An addition keeps its number unless a living entry has it; an update of a number that is not known becomes an addition; both
    then get the number behind the greatest living one, 0 in an empty store. The log's number stands for the entry that it last
    named, so later actions on it reach the renamed entry. Deletions and NONE of unknown numbers change nothing.
    """

    def __init__(self, alias: dict[int, int], live: dict[int, tuple[float, int]]):
        self.alias, self.live = alias, live
        self.numbers = [-entry for entry in live]  # a heap of all that live, and of some that do no more
        heapq.heapify(self.numbers)

    def fresh(self) -> int:
        """The number behind the greatest living one."""
        while self.numbers and -self.numbers[0] not in self.live:
            heapq.heappop(self.numbers)
        return 1 - self.numbers[0] if self.numbers else 0

    def take(self, action: str, number: int, value: float, seq: int) -> int | None:
        """The entry that the action has changed; None if there is none."""
        entry = self.alias.get(number, number)
        known = entry in self.live
        if action == "DELETE" and known:
            del self.live[entry]
            self.alias.pop(number, None)
        elif action == "UPDATE" and known:
            self.live[entry] = (value, seq)
        elif action in ("ADD", "UPDATE"):
            entry = number if action == "ADD" and number not in self.live else self.fresh()
            self.live[entry] = (value, seq)
            heapq.heappush(self.numbers, -entry)
            self.alias[number] = entry
        else:
            return None
        return entry


class RenamingFold:
    """State per run for Renaming: the living entries, which number of the log stands for which, and the last seq taken. A run's
    log is read in its own order: rows up to that seq have been taken before and are passed over, so a batch that is sent again
    changes nothing. Of every batch the changed entries come out, with whether they live. Used by transformWithStateInPandas."""

    def __init__(self, run: str, mem: str, seq: str, value: str):
        self.run, self.mem, self.seq, self.value = run, mem, seq, value

    def init(self, handle) -> None:
        # A run's state is one value, as every access to the store is a call to another process.
        self.store = handle.getValueState("store", "last_seq long, entries array<int>, values array<double>, seqs array<long>, numbers array<int>, named array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, *lists = self.store.get() or (-1, *[[]] * 5)
        new = pd.concat([c[c[self.seq] > last] for c in rows]).sort_values(self.seq).drop_duplicates(self.seq)
        if new.empty:
            return
        entries, values, seqs, numbers, named = lists
        live, alias = dict(zip(entries, zip(values, seqs, strict=True), strict=True)), dict(zip(numbers, named, strict=True))
        store, changed = Renaming(alias, live), {}
        for action, number, value, seq in zip(new["action"], new[self.mem], new[self.value], new[self.seq], strict=True):
            if (entry := store.take(action, int(number), float(value), int(seq))) is not None:
                changed[entry] = (float(value), int(seq))
        self.store.update((int(new[self.seq].iloc[-1]), list(live), [v for v, _ in live.values()], [n for _, n in live.values()], list(alias), list(alias.values())))
        yield pd.DataFrame([(key[0], e, *v, e in live) for e, v in changed.items()], columns=[self.run, "entry", "value", "last_seq", "live"])

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, run: str, processor: object, schema: str) -> DataFrame:
    from pyspark.sql.streaming import StatefulProcessor

    kind = type(f"{type(processor).__name__}Processor", (type(processor), StatefulProcessor), {})
    own = kind.__new__(kind)
    own.__dict__.update(processor.__dict__)
    return stream.groupBy(run).transformWithStateInPandas(own, schema, "Update", "None")


def fold_stream(stream: DataFrame, run: str, mem: str, seq: str, value: str, kind: str = "long", late: int | None = None) -> DataFrame:
    """The entries of each run's store that a micro-batch has changed: run, entry, value, last_seq, live. State is kept by the state
    store; late is how many numbers behind the newest an action of a run may come."""
    return _stateful(stream, run, Fold(run, mem, seq, value, late), f"{run} {kind}, {mem} int, value double, last_seq long, live boolean")


def rename_stream(stream: DataFrame, run: str, mem: str, seq: str, value: str, kind: str = "long") -> DataFrame:
    """As fold_stream, for a log whose unknown updates get fresh numbers (Renaming): run, entry, value, last_seq, live. A run's rows
    must come in order of seq, batch by batch."""
    return _stateful(stream, run, RenamingFold(run, mem, seq, value), f"{run} {kind}, entry int, value double, last_seq long, live boolean")


def rename_batch(log: DataFrame, run: str, mem: str, seq: str, value: str, kind: str = "long") -> DataFrame:
    """Batch twin of rename_stream: the living entries after the whole log. Runs are sorted by Spark and read row by row, with the
    store of one run in memory at a time."""

    def each(batches):
        import pyarrow as pa

        def told(who, store):
            rows = [(who, e, *v) for e, v in store.live.items()] if store else []
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[run, "entry", "value", "last_seq"])

        who, store, last, types = None, None, None, None
        for b in batches:
            types = types or [b.schema.field(run).type, pa.int32(), pa.float64(), pa.int64()]
            for r, at, action, number, x in zip(*[b.column(c).to_pylist() for c in (run, seq, "action", mem, value)], strict=True):
                if store is None or r != who:
                    if store:
                        yield told(who, store)
                    who, store, last = r, Renaming({}, {}), None
                if at != last:
                    store.take(action, number, x, at)
                last = at
        if store:
            yield told(who, store)

    ordered = log.select(run, seq, "action", mem, value).repartition(run).sortWithinPartitions(run, seq)
    return ordered.mapInArrow(each, f"{run} {kind}, entry int, value double, last_seq long")


def windowed_rates(events: DataFrame, time: str, hit: Column, size: str, slide: str | None = None, late: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Events and the share of hits per window of event time, tumbling or sliding; with a watermark on a stream."""
    src = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return src.groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("rate")).select(F.col("w.start").alias("start"), *(by or []), "n", "rate")


def session_rates(events: DataFrame, time: str, who: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each user: a gap without events ends one."""
    src = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events
    return src.groupBy(who, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select(who, F.col("s.start").alias("start"), "n")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an append stream over what is there into Parquet files and reads them back: those that the stream's own log names, so
    that a stopped and restarted run counts each batch once."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_some(stream: DataFrame, path: str, checkpoint: str, batches: int = 1, wait_s: float = 0.05) -> int:
    """Runs an append stream into Parquet files until some micro-batches are through, then stops it; gives the number of the last one.
    What was on its way is done again by the next run from the same checkpoint, and the files' own log leaves its first try out."""
    import time

    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        while q.isActive and (q.lastProgress is None or q.lastProgress["batchId"] < batches - 1):
            time.sleep(wait_s)
        if q.exception():
            raise q.exception()
        return q.lastProgress["batchId"]
    finally:
        q.stop()


def run_steps(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there; every micro-batch's rows go to Parquet under its number, and all are read back with step.
    A batch that is run again writes the same folder, so a lost driver or executor doubles nothing."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/step={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("step", T.IntegerType())])).parquet(path)


def latest_step(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Of every key the rows of its last step: what an update stream says of it at the end."""
    last = steps.groupBy(*keys).agg(F.max("step").alias("step"))
    return steps.hint("merge").join(last.hint("merge"), [*keys, "step"]).drop("step").select(*[c for c in steps.columns if c != "step"])
