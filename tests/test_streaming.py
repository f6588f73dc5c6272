import shutil

import numpy as np
import pytest

from bandwright.operators import cachesim
from bandwright.session import load
from bandwright.streaming import cache, deliveries, events, gaps


def run(writer, checkpoint):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_deliveries_once(spark, tmp_path):
    src, out, state, cp = (str(tmp_path / x) for x in ("src", "out", "state", "cp"))
    schema = "id string, ts int, batch_id string"
    parts = [["a_v1", "a_v2", "odd", None], ["a_v2", "a_v3", "odd", " a_v1 "], ["a_v4", "a_v3"]]
    for n, ids in enumerate(parts):
        spark.createDataFrame([(x, i, f"b{n}") for i, x in enumerate(ids)], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        run(stream.writeStream.foreachBatch(deliveries.keep_once(state, out)), cp)
    got = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(x for x in got if x) == ["a_v1", "a_v2", "a_v3", "a_v4", "odd"] and got.count(None) == 1


def test_a_lost_state_is_an_error(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    once = deliveries.keep_once(state, out)
    batch = lambda *ids: spark.createDataFrame([(x, 1, "b") for x in ids], "id string, ts int, batch_id string")
    for n, ids in enumerate((("a_v1", "x"), ("a_v2",), ("a_v2", "a_v3", "x"))):
        once(batch(*ids), n)
    assert {r.id for r in spark.read.parquet(out).collect()} == {"a_v1", "a_v2", "a_v3", "x"}
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["1", "2"]
    once(batch("a_v2", "a_v3", "x"), 2)  # run again
    assert {r.id for r in spark.read.parquet(f"{out}/batch=2").collect()} == {"a_v3"}
    shutil.rmtree(tmp_path / "state" / "2" / "ids")
    with pytest.raises(deliveries.MissingState):
        once(batch("a_v1"), 3)


def test_gap_only(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([("a",), ("b",), (" b ",), (None,)], "id string").write.parquet(src)
    done = spark.createDataFrame([("a",)], "id string")
    run(spark.readStream.schema("id string").parquet(src).writeStream.foreachBatch(gaps.answer_gap(lambda: done, out)), cp)
    assert [r.id for r in spark.read.parquet(out).collect()] == ["b"]


def test_windows_equal_batch(spark, data, tmp_path):
    schema = load(spark, data, "events").schema
    src = str(tmp_path / "src")
    load(spark, data, "events").write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    for name, f in (("tumbling", events.tumbling), ("sessions", events.sessions), ("sliding", events.sliding)):
        q = f(stream).writeStream.outputMode("complete" if name == "tumbling" else "append").format("memory").queryName(f"got_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        got, want = spark.table(f"got_{name}"), f(load(spark, data, "events"))
        if name == "tumbling":
            assert {(r.start, r.event_type, r.n) for r in got.collect()} == {(r.start, r.event_type, r.n) for r in want.collect()}
        elif name == "sliding":  # windows come out once the watermark has passed them
            found = {tuple(r) for r in got.collect()}
            assert found and found <= {tuple(r) for r in want.collect()}
        else:  # sessions come out once the watermark has passed them
            assert {(r.user_id, r.start, r.n) for r in got.collect()} <= {(r.user_id, r.start, r.n) for r in want.collect()}


@pytest.mark.parametrize(("policy", "capacity"), [("none", 0), ("fifo", 7), ("lru", 7)])
def test_online_cache_equals_walk(spark, tmp_path, policy, capacity):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = cachesim.zipf(0, 60, 0.8, 90) if capacity else cachesim.permutation(0, 60)
    want = [(t, i, s if s >= 0 else None) for t, i, s, _ in cachesim.walk(x, order, 0.6, policy=policy, capacity=capacity)]
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    for part in range(2):
        rows = [("c", t, i, x[i].tolist()) for t, i in enumerate(order) if (t < 30) == (part == 0)]
        spark.createDataFrame(rows, "cache string, pos int, item int, vec array<double>").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("cache string, pos int, item int, vec array<double>").parquet(src)
        run(cache.online(stream, 0.6, policy, capacity).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), cp)
    got = sorted((r.pos, r.item, r.stored) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want
