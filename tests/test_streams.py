"""Streams that are cut, restarted and dealt into batches in different ways."""

import random
import time

import pandas as pd
import pytest

import loomwright.plans.q_io  # noqa: F401
from loomwright.plans.catalog import QUERIES
from loomwright.plans.views import Tables
from loomwright.streaming import streams

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


def plain_store(log):
    """Run, entry, value, last_seq by a loop over one store at a time."""
    stores, alias = {}, {}
    for seq, run, number, action, value in sorted(log):
        live, known = stores.setdefault(run, {}), alias.setdefault(run, {})
        entry = known.get(number, number)
        fresh = max(live) + 1 if live else 0
        if action == "ADD":
            entry = fresh if number in live else number
        elif action == "UPDATE" and entry not in live:
            entry = fresh
        elif action == "NONE" or entry not in live:
            continue
        if action == "DELETE":
            del live[entry]
            known.pop(number, None)
        else:
            live[entry] = (value, seq)
            if action == "ADD" or entry == fresh:
                known[number] = entry
    return sorted((run, e, *v) for run, live in stores.items() for e, v in live.items())


def random_log(n, seed):
    rng = random.Random(seed)
    return [(i, rng.randrange(4), rng.randrange(9), rng.choice(["ADD", "UPDATE", "UPDATE", "DELETE", "NONE"]), float(rng.randrange(100))) for i in range(n)]


SCHEMA = "seq long, user_id long, mem_id int, action string, value double"


def test_fresh_numbers():
    said = [(0, 1, 5, "UPDATE", 1.0), (1, 1, 0, "ADD", 2.0), (2, 1, 5, "UPDATE", 3.0), (3, 1, 9, "DELETE", 0.0), (4, 1, 7, "ADD", 4.0), (5, 1, 2, "UPDATE", 5.0), (6, 1, 2, "DELETE", 0.0), (7, 1, 8, "NONE", 0.0)]
    # 5 is unknown and becomes 0; 0 is taken, so the addition becomes 1; 5 then means 0; 2 is unknown, becomes 8 and goes.
    assert plain_store(said) == [(1, 0, 3.0, 2), (1, 1, 2.0, 1), (1, 7, 4.0, 4)]


@pytest.mark.parametrize("cuts", [[], [60, 61, 200], [150]])
def test_renaming_stream_equals_batch_however_it_is_cut(spark, tmp_path, rocks, cuts):
    log = random_log(300, len(cuts))
    src, edges = str(tmp_path / "log"), [0, *cuts, len(log)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        part = log[a:b] + (log[a - 20 : a] if a else [])  # each batch sends some rows again
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{src}/part={k}")
        out = streams.rename_stream(streams.read_files(spark, f"{src}/*", spark.createDataFrame([], SCHEMA).schema), "user_id", "mem_id", "seq", "value")
        steps = streams.run_steps(out, str(tmp_path / "steps"), "update", str(tmp_path / "cp"))  # the same checkpoint every time
    got = streams.latest_step(steps, ["user_id", "entry"]).where("live").select("user_id", "entry", "value", "last_seq").collect()
    batch = streams.rename_batch(spark.createDataFrame(log, SCHEMA).repartition(5), "user_id", "mem_id", "seq", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) == plain_store(log)
    assert any(r.entry > 8 for r in batch)


def test_registered_twins_agree(spark, small):
    log = [tuple(r) for r in Tables(spark, small).store_log.select("seq", "user_id", "mem_id", "action", "value").collect()]
    one, two = (sorted((r.user_id, r.entry, r.value, r.last_seq) for r in QUERIES[q](spark, small).collect()) for q in ("str_03c_fresh_ids", "str_03d_fresh_ids_batch"))
    assert one == two == plain_store(log) and one


class Maps:
    """The state handle as far as Fold uses it, held in dictionaries."""

    def __init__(self):
        self.maps = {}

    def getMapState(self, name, *_):  # noqa: N802
        held = self.maps.setdefault(name, {})
        return type("M", (), {"getValue": held.get, "containsKey": held.__contains__, "updateValue": held.__setitem__, "removeKey": lambda k: held.pop(k, None), "iterator": lambda: iter(list(held.items()))})


def test_marks_of_deleted_entries_end():
    cols = ["seq", "user_id", "mem_id", "action", "value"]
    for late, marks in ((None, {1, 3}), (10, {3})):
        fold, handle = streams.Fold("user_id", "mem_id", "seq", "value", late), Maps()
        fold.init(handle)
        said = []
        for log in ([(0, 1, 1, "ADD", 1.0), (1, 1, 2, "ADD", 2.0)], [(4, 1, 1, "DELETE", 0.0)], [(3, 1, 1, "UPDATE", 9.0)], [(20, 1, 3, "DELETE", 0.0), (21, 1, 2, "UPDATE", 5.0)]):
            for frame in fold.handleInputRows((1,), iter([pd.DataFrame(log, columns=cols)]), None):
                said.append([(r.mem_id, r.last_seq, bool(r.live)) for r in frame.itertuples()])
        assert said == [[(1, 0, True), (2, 1, True)], [(1, 4, False)], [], [(3, 20, False), (2, 21, True)]]
        assert {k[0] for k in handle.maps["gone"]} == marks and set(handle.maps["live"]) == {(2,)}


def test_restart_from_a_checkpoint_is_exactly_once(spark, small, tmp_path):
    """A stream stopped between batches, and one whose batch fails, go on from their checkpoints to what an uncut run gives."""
    events = Tables(spark, small).events.select("event_id", "ts", "user_id", "event_type")
    src = str(tmp_path / "src")
    events.repartitionByRange(4, "event_id").write.parquet(src)
    stream = lambda: streams.dedup_trace(streams.read_files(spark, src, events.schema), ["event_id"], "ts", "365 days").select("event_id")
    uncut = streams.run_to_files(stream(), str(tmp_path / "a"), str(tmp_path / "acp")).collect()
    assert streams.run_some(stream(), str(tmp_path / "b"), str(tmp_path / "bcp")) < 3
    part = spark.read.schema(stream().schema).parquet(str(tmp_path / "b")).count()
    whole = streams.run_to_files(stream(), str(tmp_path / "b"), str(tmp_path / "bcp")).collect()
    assert sorted(whole) == sorted(uncut) and 0 < part < len(whole) == len(set(whole))

    tried = []

    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{tmp_path}/c/step={batch_id}")
        tried.append(batch_id)
        if tried.count(2) == 1 and batch_id == 2:
            raise RuntimeError("lost after writing")

    def run():
        stream().writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ccp")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost after writing"):
        run()
    run()
    again = spark.read.schema(stream().schema).parquet(f"{tmp_path}/c").select("event_id").collect()
    assert tried.count(2) == 2 and sorted(again) == sorted(uncut)


def test_fresh_numbers_take_no_search_through_the_store():
    """The greatest living number is not sought anew for each action; after deletions it falls as before."""
    rng, live, alias, plain, names = random.Random(2), {}, {}, {}, {}
    store = streams.Renaming(alias, live)
    for seq in range(3000):
        action, number = rng.choice(["ADD", "UPDATE", "DELETE", "ADD"]), rng.randrange(9)
        entry = names.get(number, number)
        if action == "DELETE" and entry in plain:
            del plain[entry]
            names.pop(number, None)
        elif action == "UPDATE" and entry in plain:
            plain[entry] = seq
        elif action != "DELETE":
            entry = number if action == "ADD" and number not in plain else max(plain, default=-1) + 1
            plain[entry], names[number] = seq, entry
        store.take(action, number, 0.0, seq)
        assert {e: s for e, (_, s) in live.items()} == plain and alias == names
    began, store = time.process_time(), streams.Renaming({}, {})
    for seq in range(60_000):
        store.take("ADD", 0, 0.0, seq)
    assert len(store.live) == 60_000 and time.process_time() - began < 5
