"""Growing XML as a stream, restarts that give each row once, trips that end by a stop or a timer."""

from __future__ import annotations

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.streaming import trips, xml_stream

COLUMNS = "timestep_time string, vehicle_id string, vehicle_speed string"


def step(t: int, *vehicles: str) -> str:
    inner = "".join(f'<vehicle id="{v}" speed="{t}.5"/>' for v in vehicles)
    return f'<timestep time="{t}">{inner}</timestep>\n' if vehicles else f'<timestep time="{t}"/>\n'


def rows_of(spark, path) -> list[tuple]:
    return sorted((int(r.timestep_time), r.vehicle_id or "", r.vehicle_speed) for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("split", [1, 7, 40, 1000])
def test_splits_give_each_element_once(monkeypatch, split):
    monkeypatch.setattr(xml_stream, "BLOCK", 16)
    tags = ['<timestep time="0"/>', '<timestep time="1" note="a>b"><vehicle/></timestep>', "<timesteps/>", "<timestep>\n</timestep >", "<timestep/>"]
    text = ("<fcd>" + " ".join(tags) + "</fcd>").encode()
    found = []
    for begin in range(0, len(text), split):
        found += list(xml_stream.elements(io.BytesIO(text), begin, min(begin + split, len(text)), len(text), "timestep"))
    assert [f.decode() for f in found] == [t for t in tags if not t.startswith("<timesteps")]


def test_growing_files_and_a_killed_query(spark, tmp_path):
    """A query that dies after it has written a batch runs that batch again; every row is there once."""
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    file = source / "fcd.xml"
    file.write_text("<fcd-export>\n" + "".join(step(t, "a", "b") for t in range(20)) + '<timestep time="20"><vehicle id="a"')
    stream = xml_stream.read_xml_stream(spark, str(source), COLUMNS, split_bytes=100)
    xml_stream.write_once(stream, out, checkpoint).awaitTermination()
    assert rows_of(spark, out) == [(t, v, f"{t}.5") for t in range(20) for v in "ab"]  # the last element isn't complete yet
    with file.open("a") as f:
        f.write(' speed="20.5"/></timestep>' + step(21) + step(22, "c"))
    (source / "other.xml").write_text("<fcd-export>" + step(50, "z") + "</fcd-export>")

    def die(batch, number):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        xml_stream.write_once(stream, out, checkpoint, after=die).awaitTermination()
    written = rows_of(spark, out)
    with file.open("a") as f:  # comes while the query is down: it belongs to the next batch
        f.write(step(23, "d") + "</fcd-export>")
    xml_stream.write_once(stream, out, checkpoint).awaitTermination()
    expected = [(t, v, f"{t}.5") for t in range(20) for v in "ab"] + [(20, "a", "20.5"), (21, "", None), (22, "c", "22.5"), (50, "z", "50.5")]
    assert written == sorted(expected)
    xml_stream.write_once(stream, out, checkpoint).awaitTermination()
    assert rows_of(spark, out) == sorted([*expected, (23, "d", "23.5")])
    xml_stream.write_once(stream, out, checkpoint).awaitTermination()
    assert len(rows_of(spark, out)) == len(expected) + 1


def plain_trips(t, v, idle):
    """Row by row."""
    out, now = [], None
    for k in range(len(t)):
        if now is not None and t[k] - now[1] > idle:
            out.append((*now[:2], *now[3:], "idle"))
            now = None
        if now is None:
            now = [t[k], t[k], v[k], 0.0, 1, v[k]] if v[k] > 0 else None
            continue
        now = [now[0], t[k], v[k], now[3] + (v[k] + now[2]) / 2 * (t[k] - now[1]), now[4] + 1, max(now[5], v[k])]
        if v[k] == 0:
            out.append((*now[:2], *now[3:], "stop"))
            now = None
    return out, now


@pytest.mark.parametrize("seed", range(6))
def test_trips_of_a_batch_and_over_batches(seed):
    r = np.random.default_rng(seed)
    n = 60
    t = np.cumsum(r.choice([1.0, 1.0, 2.0, 30.0], n))
    v = np.where(r.random(n) < 0.3, 0.0, r.uniform(1, 9, n))
    expected, rest = plain_trips(t.tolist(), v.tolist(), 10.0)
    for cuts in ([], [20, 40], list(range(1, n))):
        held, got = None, []
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            closed, held = trips.closed_trips(t[a:b], v[a:b], held, 10.0)
            got += closed
        assert len(got) == len(expected)
        for x, y in zip(got, expected, strict=True):
            assert x[:2] == pytest.approx(y[:2]) and x[2] == pytest.approx(y[2]) and x[3] == y[3] and x[-1] == y[-1]
        assert (held is None) == (rest is None) and (held is None or held[:4] == pytest.approx(rest[:4]))


def test_online_trips_with_timers_and_restart(spark, tmp_path):
    """Each batch is a query of its own, so every state comes back from the checkpoint; idle vehicles leave the state."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    trips.use_rocksdb(spark)
    try:
        schema, source = "vehicle_id string, timestep_time double, vehicle_speed double", str(tmp_path / "in")
        states = []

        def arrive(*rows):
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").json(source)
            stream = spark.readStream.schema(schema).json(source)
            query = (
                trips.online_trips(stream, idle=10.0, late=1.0).writeStream.format("parquet").outputMode("append")
                .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
            states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

        arrive(("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 2.0, 0.0), ("b", 0.0, 5.0), ("b", 1.0, 5.0), (None, 1.0, 2.0))
        arrive(("b", 2.0, 5.0), ("b", 1.0, 99.0), ("c", 3.0, 2.0))  # one of b's rows is late
        arrive(("c", 4.0, 2.0), ("d", 40.0, 1.0))  # b and c aren't heard of any more
        arrive(("d", 41.0, 1.0))
        got = {(r.vehicle_id, r.time_start, r.time_end, r.distance_m, r.n_rows, r.closed_by) for r in spark.read.schema(trips.OUT).parquet(str(tmp_path / "out")).collect()}
        assert got == {("a", 0.0, 2.0, 3.5, 3, "stop"), ("b", 0.0, 2.0, 10.0, 3, "idle"), ("c", 3.0, 4.0, 2.0, 2, "idle")}
        last = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "trip").load()
        assert [r.key[0] for r in last.select("key").collect()] == ["d"]
    finally:
        spark.conf.set(provider, before)


def test_online_trips_by_the_clock(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    trips.use_rocksdb(spark)
    try:
        schema = "vehicle_id string, timestep_time double, vehicle_speed double"
        spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0)], schema).coalesce(1).write.json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        query = (
            trips.online_trips(stream, idle=2.0, by_clock=True).writeStream.format("memory").queryName("by_clock").outputMode("append")
            .trigger(processingTime="1 second").start()
        )
        try:
            for _ in range(40):
                if spark.table("by_clock").count():
                    break
                query.awaitTermination(1)
            assert [(r.vehicle_id, r.distance_m, r.closed_by) for r in spark.table("by_clock").collect()] == [("a", 2.0, "idle")]
        finally:
            query.stop()
    finally:
        spark.conf.set(provider, before)
