"""Columns, types and enumerations out of schema files."""

from __future__ import annotations

import pytest

from trajspark.sources import readers
from trajspark.sources.xsd import Schema

BASE = """<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema">
  <xsd:include schemaLocation="types.xsd"/>
  <xsd:element name="export"><xsd:complexType><xsd:sequence>
    <xsd:element ref="step" maxOccurs="unbounded"/><xsd:element name="note" type="noteType" minOccurs="0"/>
  </xsd:sequence></xsd:complexType></xsd:element>
  <xsd:element name="step"><xsd:complexType>
    <xsd:choice maxOccurs="unbounded"><xsd:element name="car" type="carType"/><xsd:group ref="others"/></xsd:choice>
    <xsd:attribute name="time" type="xsd:float" use="required"/>
  </xsd:complexType></xsd:element>
  <xsd:group name="others"><xsd:sequence><xsd:element name="walker" type="moving"/></xsd:sequence></xsd:group>
</xsd:schema>"""
TYPES = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:include schemaLocation="base.xsd"/>
  <xs:complexType name="moving"><xs:attribute name="id" type="xs:string"/><xs:attribute name="speed" type="metres"/></xs:complexType>
  <xs:complexType name="carType"><xs:complexContent><xs:extension base="moving">
    <xs:sequence><xs:element name="part" type="partType" minOccurs="0" maxOccurs="9"/></xs:sequence>
    <xs:attribute name="signal" type="signalType"/><xs:attribute name="lane" type="xs:int"/><xs:attributeGroup ref="flags"/>
  </xs:extension></xs:complexContent></xs:complexType>
  <xs:complexType name="partType">
    <xs:sequence><xs:element name="part" type="partType" minOccurs="0"/></xs:sequence><xs:attribute name="n" type="small"/>
  </xs:complexType>
  <xs:complexType name="noteType"><xs:simpleContent><xs:extension base="xs:string"><xs:attribute name="by" type="xs:string"/></xs:extension></xs:simpleContent></xs:complexType>
  <xs:attributeGroup name="flags"><xs:attribute name="parked" type="xs:boolean"/></xs:attributeGroup>
  <xs:simpleType name="metres"><xs:restriction base="xs:decimal"/></xs:simpleType>
  <xs:simpleType name="small"><xs:restriction base="xs:nonNegativeInteger"><xs:maxInclusive value="99"/></xs:restriction></xs:simpleType>
  <xs:simpleType name="signalType"><xs:restriction base="xs:string"><xs:enumeration value="green"/><xs:enumeration value="red"/></xs:restriction></xs:simpleType>
</xs:schema>"""
TEXT = """<export>
  <step time="0.5"><car id="a" speed="1.25" signal="red" lane="2" parked="true"><part n="1"/><part n="2"/></car><walker id="w" speed="x"/></step>
  <step time="1"><car id="b" speed="3" signal="blue" lane="1.5" extra="1"/></step><note by="me">text</note><step time="2"/>
</export>"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "base.xsd").write_text(BASE)
    (tmp_path / "types.xsd").write_text(TYPES)
    (tmp_path / "data.xml").write_text(TEXT)
    return tmp_path


def test_schema_with_include_extension_and_references(spark, files):
    root = Schema(spark, str(files / "base.xsd")).element()
    assert root.name == "export" and [(c.name, many) for c, many in root.children] == [("step", True), ("note", False)]
    step = root.find("step")
    assert [(c.name, many) for c, many in step.children] == [("car", True), ("walker", True)]
    car = root.find("car")
    assert [(a.name, a.kind, a.values) for a in car.attributes] == [
        ("id", "string", None), ("speed", "double", None), ("signal", "bigint", ["green", "red"]), ("lane", "bigint", None), ("parked", "boolean", None),
    ]
    part = root.find("part")
    assert part.children == [] and part.attributes[0].kind == "bigint"  # a part inside a part is left out
    assert step.spark_type().simpleString() == (
        "struct<_time:string,car:array<struct<_id:string,_speed:string,_signal:string,_lane:string,_parked:string,"
        "part:array<struct<_n:string>>>>,walker:array<struct<_id:string,_speed:string>>>"
    )
    with pytest.raises(ValueError, match="no element"):
        Schema(spark, str(files / "base.xsd")).element("bus")


def test_typed_columns(spark, files):
    rows = readers.read_flat_xml(spark, str(files / "data.xml"), "step", str(files / "base.xsd"), typed=True, validate=False)
    assert dict(rows.dtypes) == {
        "car_id": "string", "car_lane": "bigint", "car_parked": "boolean", "car_signal": "bigint", "car_speed": "double",
        "part_n": "bigint", "step_time": "double", "walker_id": "string", "walker_speed": "double",
    }
    got = {(r.step_time, r.car_id, r.car_speed, r.car_signal, r.car_lane, r.car_parked, r.part_n, r.walker_id, r.walker_speed) for r in rows.collect()}
    assert got == {
        (0.5, "a", 1.25, 1, 2, True, 1, None, None), (0.5, "a", 1.25, 1, 2, True, 2, None, None), (0.5, None, None, None, None, None, None, "w", None),
        (1.0, "b", 3.0, None, None, None, None, None, None), (2.0, None, None, None, None, None, None, None, None),
    }


def test_tables_by_first_level(spark, files):
    tables = readers.read_split_xml(spark, str(files / "data.xml"), str(files / "base.xsd"))
    assert sorted(tables) == ["note", "step"]
    assert [r.note_by for r in tables["note"].collect()] == ["me"] and tables["step"].count() == 5
