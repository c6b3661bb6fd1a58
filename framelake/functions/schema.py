"""Schema declarations: JSON text to flat, fixed-width fields.

A declaration is an object of ``name: "Type"`` or ``name: {nested object}``.  Nested names are
joined by dots; every level is visited in the order of its keys' UTF-8 bytes.  A trailing ``?``
on the type's name makes a field nullable, sizes follow the name: ``"String? 50"``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the record format.
CONTENT_BYTES = {"Int": 8, "Float": 8, "Bool": 1}
SIZED_TYPES = ("String", "Blob")
FLAG_BYTES = 1
LENGTH_BYTES = 4
NAME_BYTES = 64
U32_MAX = 2**32 - 1

SPARK_TYPES = {"Int": T.LongType(), "Float": T.DoubleType(), "Bool": T.BooleanType(), "String": T.StringType(), "Blob": T.BinaryType()}
LAYOUT_SCHEMA = "schema string, ord int, name string, type string, size bigint, nullable boolean, width bigint, offset bigint"


class SchemaError(ValueError):
    """A declaration that cannot be used; the subclasses say why."""


class NotAnObject(SchemaError):
    pass


class UnknownType(SchemaError):
    pass


class MissingSize(SchemaError):
    pass


class InvalidSize(SchemaError):
    pass


class UnexpectedSize(SchemaError):
    pass


class NameTooLong(SchemaError):
    pass


class DuplicateName(SchemaError):
    """Two fields flatten to one name; stricter than the format asks for."""


@dataclass(frozen=True)
class DataType:
    name: str
    size: int
    nullable: bool = False

    @classmethod
    def parse(cls, text: str) -> DataType:
        head, *sizes = text.split() or [""]
        nullable = head.endswith("?")
        wanted = head[: len(head) - nullable].lower()
        name = next((n for n in SPARK_TYPES if n.lower() == wanted), None)
        if name is None:
            raise UnknownType(text)
        if name in CONTENT_BYTES:
            if sizes:
                raise UnexpectedSize(text)
            return cls(name, CONTENT_BYTES[name], nullable)
        if not sizes:
            raise MissingSize(text)
        digits = sizes[0].removeprefix("+")
        if len(sizes) > 1 or not (digits.isascii() and digits.isdigit()) or not 1 <= int(digits) <= U32_MAX:
            raise InvalidSize(text)
        return cls(name, int(digits), nullable)

    @property
    def width(self) -> int:
        """Bytes on disk: variable types always have a flag and a length, others a flag if nullable."""
        prefix = FLAG_BYTES + LENGTH_BYTES if self.name in SIZED_TYPES else FLAG_BYTES * self.nullable
        return prefix + self.size


@dataclass(frozen=True)
class Field:
    name: str
    type: DataType
    offset: int

    @property
    def width(self) -> int:
        return self.type.width


def check_name(name: str) -> str:
    if len(name.encode()) > NAME_BYTES:
        raise NameTooLong(name)
    return name


def encode_name(name: str) -> bytes:
    """A name as stored: UTF-8, filled up with zero bytes."""
    return check_name(name).encode().ljust(NAME_BYTES, b"\0")


def _leaves(node: object, path: tuple[str, ...] = ()) -> Iterator[tuple[str, str]]:
    if isinstance(node, Mapping):
        for key in sorted(node, key=lambda k: k.encode()):
            yield from _leaves(node[key], (*path, key))
    elif path and isinstance(node, str):
        yield ".".join(path), node
    else:
        raise NotAnObject(".".join(path) or repr(node))


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...] = field(default=())
    version: int = 0

    @classmethod
    def from_json(cls, name: str, declaration: str | Mapping) -> Schema:
        """Flatten a declaration; one running offset over the whole list, so that fields never overlap."""
        tree = json.loads(declaration) if isinstance(declaration, str) else declaration
        if not isinstance(tree, Mapping):
            raise NotAnObject(repr(tree))
        check_name(name)
        fields: list[Field] = []
        for path, text in _leaves(tree):
            end = fields[-1].offset + fields[-1].width if fields else 0
            fields.append(Field(check_name(path), DataType.parse(text), end))
        if fields and fields[-1].offset + fields[-1].width > U32_MAX:
            raise InvalidSize(f"{name}: a record would be over {U32_MAX} bytes")
        seen: set[str] = set()
        for f in fields:
            if f.name in seen:
                raise DuplicateName(f.name)
            seen.add(f.name)
        return cls(name, tuple(fields))

    @property
    def width(self) -> int:
        return sum(f.width for f in self.fields)

    def struct(self) -> T.StructType:
        """The schema for Spark: flat columns (back-quote the dotted names), layout as metadata."""
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type.name], f.type.nullable, {"offset": f.offset, "size": f.type.size, "width": f.width}) for f in self.fields])

    def violations(self) -> Column:
        """Names of the columns of a row that are null or too long for their field."""
        bad = []
        for f in self.fields:
            c = F.col(f"`{f.name}`")
            if not f.type.nullable:
                bad.append(F.when(c.isNull(), F.lit(f.name)))
            if f.type.name in SIZED_TYPES:
                bad.append(F.when(F.octet_length(c) > f.type.size, F.lit(f.name)))
        return F.array_distinct(F.array_compact(F.array(*bad))) if bad else F.array().cast("array<string>")

    def nested(self, df: DataFrame) -> DataFrame:
        """Flat columns put back into the structs they were declared in."""
        tree: dict = {}
        for f in self.fields:
            *above, last = f.name.split(".")
            node = tree
            for part in above:
                node = node.setdefault(part, {})
            node[last] = F.col(f"`{f.name}`")

        def build(node: dict | Column) -> Column:
            return F.struct(*[build(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else node

        return df.select(*[build(v).alias(k) for k, v in tree.items()])


def layout_table(spark: SparkSession, schemas: list[Schema]) -> DataFrame:
    """The catalog's fields as rows."""
    rows = [(s.name, i, f.name, f.type.name, f.type.size, f.type.nullable, f.width, f.offset) for s in schemas for i, f in enumerate(s.fields)]
    return spark.createDataFrame(rows, LAYOUT_SCHEMA)


def width_expr(type_: Column, size: Column, nullable: Column) -> Column:
    """The same width rule over columns of a catalog table."""
    return F.when(type_.isin(*SIZED_TYPES), size + FLAG_BYTES + LENGTH_BYTES).otherwise(size + nullable.cast("long"))
