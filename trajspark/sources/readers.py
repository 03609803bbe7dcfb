"""Reading trajectories, lane graphs and tables; everything comes back as DataFrames with plain columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .xsd import Attribute, Element, Schema

FCD_ATTRIBUTES = ["id", "x", "y", "type", "speed", "pos", "lane", "acceleration", "odometer"]


def read_fcd_xml(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory XML, a row for each vehicle of each timestep (a timestep without vehicles gives a row of nulls).

    Attributes become columns timestep_<name> and vehicle_<name>, all strings. Gzip is told by the extension.
    """
    vehicle = ",".join(f"_{a}: string" for a in FCD_ATTRIBUTES)
    schema = f"_time string, vehicle array<struct<{vehicle}>>"
    steps = spark.read.format("xml").option("rowTag", "timestep").schema(schema).load(path)
    rows = steps.select(F.col("_time").alias("timestep_time"), F.explode_outer("vehicle").alias("v"))
    return rows.select("timestep_time", *[F.col(f"v._{a}").alias(f"vehicle_{a}") for a in sorted(FCD_ATTRIBUTES)])


def read_elements(spark: SparkSession, path: str, tag: str, attributes: list[str]) -> DataFrame:
    """All elements of a tag, wherever they stand, with the given attributes as string columns."""
    schema = ", ".join(f"`_{a}` string" for a in attributes)
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows.select(*[F.col(f"`_{a}`").alias(a) for a in attributes])


def read_flat_xml(
    spark: SparkSession, path: str, row_tag: str, xsd: str | None = None, typed: bool = False, validate: bool = True
) -> DataFrame:
    """XML of any form under row_tag, a row for each innermost element; columns <tag>_<attribute>, sorted.

    Attributes of enclosing elements are repeated in each row, and an element without children still has a row. Children
    of different tags give rows of their own, with nulls in the others' columns. Text between tags isn't kept.

    Without `typed` all columns are strings, and attributes are found by a pass over the files. With it, columns come from
    the schema file without that pass: numbers and truth values have their types (null where a value isn't one),
    enumerations are the values' positions from 0, and what the schema doesn't name isn't read. xsd: schema file; elements
    of row_tag that it doesn't allow raise an error, if `validate` (then the executors read the file, too).
    """
    reader = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).option("valueTag", "#text")
    if xsd and validate:
        reader = reader.option("rowValidationXSDPath", xsd).option("mode", "FAILFAST")
    element = Schema(spark, xsd).element(row_tag) if xsd and typed else None
    if element is not None:
        reader = reader.schema(element.spark_type())
    rows = reader.load(path)
    out = _flat(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")), "row", row_tag) if rows.columns else rows
    if element is not None:
        kinds = {f"{e.name}_{a.name}": a for e in _elements(element) for a in e.attributes}
        out = out.select(*[_typed(c, kinds[c]).alias(c) for c in out.columns])
    return out.select(*[F.col(f"`{c}`") for c in sorted(out.columns)])


def read_split_xml(spark: SparkSession, path: str, xsd: str) -> dict[str, DataFrame]:
    """A typed table for each child tag of the schema's first element."""
    root = Schema(spark, xsd).element()
    return {child.name: read_flat_xml(spark, path, child.name, xsd, typed=True, validate=False) for child, _ in root.children}


def _elements(element: Element) -> list[Element]:
    return [element, *[e for child, _ in element.children for e in _elements(child)]]


def _typed(column: str, attribute: Attribute) -> Column:
    if attribute.values is not None:
        return enum_index(f"`{column}`", attribute.values)
    return F.trim(F.col(f"`{column}`")).try_cast(attribute.kind) if attribute.kind != "string" else F.col(f"`{column}`")


def _flat(rows: DataFrame, element: str, tag: str) -> DataFrame:
    """rows with the struct column `element` replaced by columns of its attributes and of its children's."""
    fields = rows.schema[element].dataType.fields
    others = [F.col(f"`{c}`") for c in rows.columns if c != element]
    own = [F.col(f"`{element}`.`{f.name}`").alias(f"{tag}_{f.name[1:]}") for f in fields if f.name.startswith("_")]
    kinds = {f.name: f.dataType for f in fields if not f.name.startswith(("_", "#"))}
    kinds = {n: k for n, k in kinds.items() if getattr(k, "elementType", k).typeName() == "struct"}
    if not kinds:
        return rows.select(*others, *own)
    parts, child = [], {n: F.col(f"`{element}`.`{n}`") for n in kinds}
    for n, kind in kinds.items():
        each = F.explode(child[n] if kind.typeName() == "array" else F.array(child[n]))
        parts.append(_flat(rows.where(child[n].isNotNull()).select(*others, *own, each.alias("#child")), "#child", n))
    none = rows.where(reduce(lambda a, b: a & b, [c.isNull() for c in child.values()])).select(*others, *own)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, none])


def read_lanes(spark: SparkSession, path: str) -> DataFrame:
    """(lane_id, length)."""
    lanes = read_elements(spark, path, "lane", ["id", "length"])
    return lanes.select(F.col("id").alias("lane_id"), F.col("length").try_cast("double").alias("length"))


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    return read_elements(spark, path, "connection", ["from", "to", "fromLane", "toLane", "via"])


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    flows = read_elements(spark, path, "flow", ["id", "from", "to", "vehsPerHour"])
    return flows.select(
        F.col("id").alias("flow_id"),
        F.col("from").alias("from_edge"),
        F.col("to").alias("to_edge"),
        F.col("vehsPerHour").try_cast("double").alias("vehs_per_hour"),
    )


def read_csv(spark: SparkSession, path: str, sep: str = ",", recursive: bool = False, schema: str | None = None) -> DataFrame:
    """CSV with a header, all strings without a schema; a byte-order mark before the first name goes."""
    reader = spark.read.option("header", True).option("sep", sep)
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "[!.~]*.csv")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})


def read_tables(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """All CSV files under path as one table, columns put together by name; missing ones are null.

    Files may have different headers, or the same names in another order. Names are stripped. With a tag, files without a
    data_type column get it as their data_type. Without files the table has no columns.
    """
    found = {"recursiveFileLookup": True, "pathGlobFilter": "[!.~]*.csv"}
    lines = spark.read.options(**found).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        "value",
    )
    firsts = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    parts = []
    for row in firsts.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect():
        part = spark.read.option("header", True).csv(row.files)
        part = part.withColumnsRenamed({c: c.lstrip("\ufeff").strip() for c in part.columns})
        if tag is not None and "data_type" not in part.columns:
            part = part.withColumn("data_type", F.lit(tag))
        parts.append(part)
    out = parts[0] if parts else spark.createDataFrame([], "")
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def enum_index(column: str, values: list[str]) -> Column:
    """Position of an enumerated value from 0, as long; null if it isn't one."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return F.when(at > 0, at - 1)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)
