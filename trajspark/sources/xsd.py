"""Reading columns, types and enumerations out of an XML schema file.

A schema file and the files it includes are read on the driver (they are small, and come through Spark, so they may be in
any store that Spark reads). Elements by name or reference, named and nested complex types, extensions and restrictions,
sequences, choices, groups and attribute groups are resolved to a tree of elements, which becomes a Spark type.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_XS = "{http://www.w3.org/2001/XMLSchema}"
#: fixed values: built-in types by the kind of column that holds them; all others are strings
WHOLE = {
    "byte", "short", "int", "integer", "long", "negativeInteger", "nonNegativeInteger", "nonPositiveInteger", "positiveInteger",
    "unsignedByte", "unsignedShort", "unsignedInt", "unsignedLong",
}
FRACTION = {"float", "double", "decimal"}


@dataclass
class Attribute:
    name: str
    kind: str  # bigint, double, boolean or string
    values: list[str] | None = None  # of an enumeration


@dataclass
class Element:
    name: str
    attributes: list[Attribute] = field(default_factory=list)
    children: list[tuple[Element, bool]] = field(default_factory=list)  # with whether it may occur more than once

    def find(self, name: str) -> Element | None:
        """The first element of this name here or below."""
        if self.name == name:
            return self
        return next((found for child, _ in self.children if (found := child.find(name))), None)

    def spark_type(self) -> StructType:
        """For Spark's XML reader, all values as strings: what isn't of its type can then become null alone."""
        own = [StructField(f"_{a.name}", StringType()) for a in self.attributes]
        inner = [(c.name, c.spark_type(), many) for c, many in self.children]
        return StructType([*own, *[StructField(n, ArrayType(t) if many else t) for n, t, many in inner]])


def _local(name: str | None) -> str:
    return (name or "").rpartition(":")[2]


class Schema:
    """Named parts of a schema file and of all that it includes."""

    def __init__(self, spark: SparkSession, path: str):
        self.parts: dict[str, dict[str, ElementTree.Element]] = {
            k: {} for k in ("element", "complexType", "simpleType", "group", "attributeGroup", "attribute")
        }
        seen: set[str] = set()
        own = self._read(spark, path, seen)
        self.first = own[0] if own else next(iter(self.parts["element"]), None)

    def _read(self, spark: SparkSession, path: str, seen: set[str]) -> list[str]:
        """Takes in a file and what it includes; names of the elements of the file itself."""
        if path in seen:
            return []
        seen.add(path)
        root = ElementTree.fromstring(spark.read.text(path, wholetext=True).first()[0])
        own = []
        for part in root:
            kind = part.tag.removeprefix(_XS)
            if kind in ("include", "import", "redefine") and part.get("schemaLocation"):
                self._read(spark, posixpath.join(posixpath.dirname(path), part.get("schemaLocation")), seen)
            elif kind in self.parts:
                self.parts[kind].setdefault(part.get("name"), part)
                if kind == "element":
                    own.append(part.get("name"))
        return own

    def element(self, name: str | None = None) -> Element:
        """The tree below an element of the schema, its first one without a name.

        An element inside an element of the same name is left out, as a table has no endless columns.
        """
        name = name or self.first
        if name in self.parts["element"]:
            return self._element(self.parts["element"][name], ())
        for top in self.parts["element"].values():
            if found := self._element(top, ()).find(name):
                return found
        raise ValueError(f"the schema has no element {name}")

    def _element(self, node: ElementTree.Element, above: tuple[str, ...]) -> Element:
        if node.get("ref"):
            node = self.parts["element"][_local(node.get("ref"))]
        out = Element(node.get("name"))
        nested = node.find(f"{_XS}complexType")
        body = nested if nested is not None else self.parts["complexType"].get(_local(node.get("type")))
        if body is not None:
            self._fill(out, body, (*above, out.name), False)
        return out

    def _fill(self, out: Element, node: ElementTree.Element, above: tuple[str, ...], many: bool) -> None:
        """Adds what a complex type or a part of one holds; what a type extends comes first."""
        for part in node:
            kind = part.tag.removeprefix(_XS)
            again = many or part.get("maxOccurs", "1") not in ("0", "1")
            if kind in ("extension", "restriction"):
                base = self.parts["complexType"].get(_local(part.get("base")))
                if base is not None and kind == "extension":
                    self._fill(out, base, above, many)
                self._fill(out, part, above, many)
            elif kind in ("complexContent", "simpleContent"):
                self._fill(out, part, above, many)
            elif kind in ("sequence", "choice", "all"):
                self._fill(out, part, above, again)
            elif kind == "group" and part.get("ref"):
                self._fill(out, self.parts["group"][_local(part.get("ref"))], above, again)
            elif kind == "attributeGroup" and part.get("ref"):
                self._fill(out, self.parts["attributeGroup"][_local(part.get("ref"))], above, many)
            elif kind == "attribute":
                self._add_attribute(out, part)
            elif kind == "element" and part.get("maxOccurs") != "0":
                self._add_child(out, part, above, again)

    def _add_attribute(self, out: Element, node: ElementTree.Element) -> None:
        if node.get("ref"):
            node = self.parts["attribute"].get(_local(node.get("ref")), node)
        name = node.get("name")
        out.attributes = [a for a in out.attributes if a.name != name]
        if name and node.get("use") != "prohibited":
            out.attributes.append(Attribute(name, *self._value(node.find(f"{_XS}simpleType"), node.get("type"))))

    def _add_child(self, out: Element, node: ElementTree.Element, above: tuple[str, ...], many: bool) -> None:
        name = _local(node.get("ref")) or node.get("name")
        known = [c for c, _ in out.children if c.name == name]
        if known:  # named twice, as in a sequence that has it at two places: more than one may come
            out.children = [(c, True if c.name == name else m) for c, m in out.children]
        elif name not in above:
            out.children.append((self._element(node, above), many))

    def _value(self, node: ElementTree.Element | None, name: str | None) -> tuple[str, list[str] | None]:
        """(kind of column, values of an enumeration) of a simple type."""
        node = self.parts["simpleType"].get(_local(name)) if node is None else node
        if node is not None:
            rule = node.find(f"{_XS}restriction")
            if rule is None:  # a list or a union
                return "string", None
            values = [v.get("value") for v in rule.findall(f"{_XS}enumeration")]
            return ("bigint", values) if values else self._value(rule.find(f"{_XS}simpleType"), rule.get("base"))
        local = _local(name)
        return "bigint" if local in WHOLE else "double" if local in FRACTION else "boolean" if local == "boolean" else "string", None
