from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trajspark.plans import pipeline
from trajspark.plans.fixtures import fx
from trajspark.plans.pipeline import Pipeline, Settings
from trajspark.sources import readers, resources
from trajspark.streaming.online import online_kinematics, windowed_counts

SF = "/root/testdata/sf0.001"

FCD = """<fcd-export>
  <timestep time="0.00"><vehicle id="v1" x="1.0" y="2.0" type="sedan" speed="3.5" pos="5.1" lane="e1_0" acceleration="0.1" odometer="0.0"/></timestep>
  <timestep time="1.00"/>
  <timestep time="2.00"><vehicle id="v1" x="2.0" y="2.0" type="sedan" speed="3.6" pos="6.1" lane=":j_0" acceleration="0.1" odometer="3.5"/></timestep>
</fcd-export>
"""
NET = """<net><edge id="e1"><lane id="e1_0" length="10.5"/></edge><edge id="e2"><lane id="e2_0" length="x"/></edge>
<connection from="e1" to="e2" fromLane="0" toLane="0" via=":j_0"/></net>
"""


def test_xml(spark, tmp_path):
    (tmp_path / "fcd.xml").write_text(FCD)
    rows = readers.read_fcd_xml(spark, str(tmp_path / "fcd.xml")).orderBy("timestep_time").collect()
    assert len(rows) == 3 and rows[1].vehicle_id is None and rows[2].vehicle_lane == ":j_0"
    (tmp_path / "net.xml").write_text(NET)
    lanes = readers.read_lanes(spark, str(tmp_path / "net.xml")).orderBy("lane_id").collect()
    assert [(r.lane_id, r.length) for r in lanes] == [("e1_0", 10.5), ("e2_0", None)]
    assert readers.read_connections(spark, str(tmp_path / "net.xml")).first().via == ":j_0"


def test_csv_with_mark_and_enumeration(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("﻿id;kind\n1;b\n2;z\n", encoding="utf-8")
    rows = readers.read_csv(spark, str(tmp_path / "a" / "x.csv"), sep=";")
    assert rows.columns == ["id", "kind"]
    got = rows.select("id", readers.enum_index("kind", ["a", "b"]).alias("k")).orderBy("id").collect()
    assert [r.k for r in got] == [1, None]
    assert readers.read_csv(spark, str(tmp_path), sep=";", recursive=True).count() == 2


def test_pipeline_runs_and_resumes(spark, tmp_path):
    users = ["1", "2", "3", "4", "5"]
    traj = fx(spark, SF, "fx_traj").where(F.col("vehicle_id").isin(users)).withColumn("vehicle_speed", F.col("vehicle_speed") * 0.2)
    inputs = {
        "fcd": traj.drop("event_id"), "links": fx(spark, SF, "fx_links"), "lanes": fx(spark, SF, "fx_lanes"),
        "jerk_envelope": fx(spark, SF, "fx_jerk_env"), "factors": fx(spark, SF, "fx_ef"),
        "ground_truth": fx(spark, SF, "fx_gt").withColumnRenamed("speed_kmh", "speed"),
    }
    plan = Pipeline(spark, str(tmp_path / "out"), Settings(gt_speed_unit="km/h"))
    have = plan.run(inputs, manifest=str(tmp_path / "manifest.json"))
    kinds = {r.data_type for r in have["intensity"].collect()}
    assert kinds == {"sumo", "trim", "sg", "ground_truth"}
    assert have["errors"].count() > 0
    log = json.loads((tmp_path / "manifest.json").read_text())
    assert all(x["status"] == "done" for x in log)
    n = have["spatial"].count()
    again = plan.run(inputs, resume_from="spatial")
    assert again["spatial"].count() == n
    skipped = Pipeline(spark, str(tmp_path / "few")).run({"fcd": inputs["fcd"]}, only=["standard", "neighbours"])
    assert "standard" in skipped and "neighbours" not in skipped
    assert Settings(roi="1,2", bin_size=0).validate()
    assert have["variants"].columns[:9] == [*pipeline.VARIANT, "data_type"] and {"vehicle_lane", "reason"} <= set(have["variants"].columns)
    trips = have["trips"].where("copy = 0").groupBy("vehicle_id", "trip_id").agg(F.max_by("vehicle_odometer", "timestep_time").alias("end"))
    ends = have["stage_one"].where("solved").groupBy("vehicle_id", "trip_id").agg(F.max_by("vehicle_odometer", "timestep_time").alias("refined"))
    apart = trips.join(ends, ["vehicle_id", "trip_id"]).agg(F.count("*"), F.max(F.abs(F.col("end") - F.col("refined")))).first()
    assert apart[0] > 10 and apart[1] < 1e-3  # refined trips end where they did


def test_streams(spark, tmp_path):
    rows = [("a", 0.0, 0.0), ("a", 1.0, 2.0), ("a", 2.0, 0.0), ("a", 3.0, 4.0), ("b", 5.0, 1.0)]
    schema = "vehicle_id string, timestep_time double, vehicle_speed double"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = online_kinematics(stream).writeStream.format("memory").queryName("online").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [tuple(r) for r in spark.table("online").orderBy("vehicle_id", "timestep_time").collect()]
    assert got == [
        ("a", 0.0, 0.0, 0.0, 0.0, 0), ("a", 1.0, 2.0, 2.0, 1.0, 1), ("a", 2.0, 0.0, -2.0, 2.0, 1),
        ("a", 3.0, 4.0, 4.0, 4.0, 2), ("b", 5.0, 1.0, 0.0, 0.0, 1),
    ]
    timed = stream.withColumn("ts", F.timestamp_seconds("timestep_time"))
    query = windowed_counts(timed, "ts", "2 seconds", "0 seconds").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n_rows")).first()[0] == 5


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tables_by_name(spark, tmp_path):
    """Headers in another order, columns that only one file has, a tag where the files have none."""
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text("\ufeffbin, NOx_g\n1,10\n2,20\n")
    (tmp_path / "deep" / "b.csv").write_text("NOx_g,bin,data_type\n30,3,sumo\n")
    (tmp_path / "deep" / "~c.csv").write_text("bin\n9\n")
    rows = readers.read_tables(spark, str(tmp_path), tag="ground_truth").select("bin", "NOx_g", "data_type").collect()
    assert sorted(map(tuple, rows)) == [("1", "10", "ground_truth"), ("2", "20", "ground_truth"), ("3", "30", "sumo")]
    (tmp_path / "none").mkdir()
    assert readers.read_tables(spark, str(tmp_path / "none")).columns == []


def test_xml_of_any_form(spark, tmp_path):
    """Attributes of enclosing elements go down, an element without children keeps a row, tags have rows of their own."""
    text = """<root>
      <step time="0"><car id="a" v="1"><wheel n="1"/><wheel n="2"/></car><car id="b" v="2"/></step>
      <step time="1"/>
      <step time="2"><bus id="c"/><car id="d" v="3"/></step></root>"""
    (tmp_path / "any.xml").write_text(text)
    rows = readers.read_flat_xml(spark, str(tmp_path / "any.xml"), "step")
    assert rows.columns == ["bus_id", "car_id", "car_v", "step_time", "wheel_n"]
    got = {tuple(r) for r in rows.collect()}
    assert got == {
        (None, "a", "1", "0", "1"), (None, "a", "1", "0", "2"), (None, "b", "2", "0", None),
        (None, None, None, "1", None), ("c", None, None, "2", None), (None, "d", "3", "2", None),
    }


def test_xml_is_validated(spark, tmp_path):
    xsd = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="lane"><xs:complexType>
      <xs:attribute name="id" type="xs:string" use="required"/><xs:attribute name="length" type="xs:float"/>
    </xs:complexType></xs:element></xs:schema>"""
    (tmp_path / "lane.xsd").write_text(xsd)
    (tmp_path / "good.xml").write_text('<net><lane id="a" length="1.5"/><lane id="b"/></net>')
    (tmp_path / "bad.xml").write_text('<net><lane id="a" length="1.5"/><lane length="long"/></net>')
    read = lambda name: readers.read_flat_xml(spark, str(tmp_path / name), "lane", str(tmp_path / "lane.xsd")).collect()
    assert {tuple(r) for r in read("good.xml")} == {("a", "1.5"), ("b", None)}
    with pytest.raises(Exception, match="(?i)malformed"):
        read("bad.xml")


def test_times_and_pollutants_of_the_settings(spark):
    assert Settings(sim_time=(5.0, 1.0)).validate() and not Settings(sim_time=(1.0, None), gt_time=(None, 2.0)).validate()
    rows = [("sumo", float(t)) for t in range(4)] + [("ground_truth", float(t)) for t in range(4)]
    df = spark.createDataFrame(rows, "data_type string, timestep_time double").selectExpr("*", "0D vehicle_x", "0D vehicle_y", "1D as NOx_gs", "1D as HC_gs")
    left = pipeline._in_roi({"matched": df}, Settings(sim_time=(2.0, None), gt_time=(None, 0.0)))
    assert sorted((r.data_type, r.timestep_time) for r in left.collect()) == [("ground_truth", 0.0), ("sumo", 2.0), ("sumo", 3.0)]
    assert pipeline._rates({"matched": df}, Settings(pollutants=())) == ["NOx_gs", "HC_gs"]


def _small_inputs(spark):
    traj = fx(spark, SF, "fx_traj").where(F.col("vehicle_id").isin("1", "2")).withColumn("vehicle_speed", F.col("vehicle_speed") * 0.2)
    return {"fcd": traj, "links": fx(spark, SF, "fx_links"), "lanes": fx(spark, SF, "fx_lanes"), "factors": fx(spark, SF, "fx_ef")}


def test_clean_up_leaves_results(spark, tmp_path):
    """Folders go when their last reader is done; a resume that needs one says so, and from where it can begin."""
    out = tmp_path / "out"
    plan = Pipeline(spark, str(out))
    inputs = _small_inputs(spark)
    have = plan.run(inputs, manifest=str(tmp_path / "log.json"), keep_intermediate=False)
    assert {p.name for p in out.iterdir()} == pipeline.RESULTS
    assert have["intensity"].count() > 0 and "trips" not in have
    n = have["summary"].count()
    log = json.loads((tmp_path / "log.json").read_text())
    assert {x["step"]: x["after"] for x in log if x["status"] == "removed"} == {
        "standard": "variants", "neighbours": "trips", "trips": "stage_one", "smooth": "variants", "stage_one": "variants", "variants": "matched",
    }
    again = plan.run(inputs, resume_from="intensity", keep_intermediate=False)
    assert again["summary"].count() == n and {p.name for p in out.iterdir()} == pipeline.RESULTS
    with pytest.raises(ValueError, match="can't resume from variants: the folders of standard aren't there.*resume from standard"):
        plan.run(inputs, resume_from="variants")


def test_resources(spark, tmp_path, monkeypatch):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "envelope.csv").write_text("a\n")
    (tmp_path / "other.csv").write_text("a\n")
    find = lambda *a, **k: resources.find_resource(spark, *a, **k)
    assert find("envelope.csv", folders=[str(tmp_path)]) == f"{tmp_path}/data/envelope.csv"
    assert find("envelope.csv", given=str(tmp_path / "other.csv"), folders=[str(tmp_path)]) == str(tmp_path / "other.csv")
    assert find("envelope.csv", given=str(tmp_path / "gone.csv"), folders=[str(tmp_path)]) == f"{tmp_path}/data/envelope.csv"
    monkeypatch.chdir(tmp_path)
    assert find("envelope.csv") == f"{tmp_path}/data/envelope.csv"
    with pytest.raises(FileNotFoundError, match="none.csv isn't at any of: .*gone.csv, .*resources/none.csv"):
        find("none.csv", given="/gone.csv")
