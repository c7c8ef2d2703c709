"""Declared types, and whether a Spark type fulfils them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from probitas.keys import ProbitasError


class ContractValidationError(ProbitasError):
    """The contract itself is wrong."""


class SchemaValidationError(ProbitasError):
    """The data's schema isn't the contract's."""


class ContractWarning(UserWarning):
    """A part of a contract that is left out."""


SIMPLE: dict[str, tuple[type, ...]] = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "number": (T.FloatType, T.DoubleType, T.DecimalType),
    "decimal": (T.DecimalType,),
    "bool": (T.BooleanType,),
    "string": (T.StringType, T.CharType, T.VarcharType),
    "bytes": (T.BinaryType,),
    "date": (T.DateType,),
    "timestamp": (T.TimestampType, T.TimestampNTZType),
    "time": (T.StringType,),
}
CONTRACT_TYPES = tuple(name for name in SIMPLE if name != "number")


@dataclass(frozen=True)
class Simple:
    name: str

    def mismatch(self, actual: T.DataType, path: str) -> Iterator[str]:
        if not isinstance(actual, SIMPLE[self.name]):
            yield f"{path}: declared {self.name}, found {actual.simpleString()}"


@dataclass(frozen=True)
class Timestamp:
    """With a time zone it needs timestamps with one, with None those without."""

    tz: str | None

    def mismatch(self, actual: T.DataType, path: str) -> Iterator[str]:
        wanted = T.TimestampNTZType if self.tz is None else T.TimestampType
        if not isinstance(actual, wanted):
            yield f"{path}: declared timestamp {'without time zone' if self.tz is None else f'in {self.tz}'}, found {actual.simpleString()}"


@dataclass(frozen=True)
class ListOf:
    value: Any

    def mismatch(self, actual: T.DataType, path: str) -> Iterator[str]:
        if isinstance(actual, T.ArrayType):
            yield from self.value.mismatch(actual.elementType, f"{path}[]")
        else:
            yield f"{path}: declared list, found {actual.simpleString()}"


@dataclass(frozen=True)
class Field:
    name: str
    type: Any
    description: str = ""


@dataclass(frozen=True)
class StructOf:
    fields: tuple[Field, ...]

    def mismatch(self, actual: T.DataType, path: str) -> Iterator[str]:
        if not isinstance(actual, T.StructType):
            yield f"{path}: declared struct, found {actual.simpleString()}"
            return
        there = {f.name: f.dataType for f in actual.fields}
        for f in self.fields:
            if f.name not in there:
                yield f"{path}.{f.name}: missing"
            else:
                yield from f.type.mismatch(there[f.name], f"{path}.{f.name}")


@dataclass(frozen=True)
class MapOf:
    key: Any
    value: Any

    def mismatch(self, actual: T.DataType, path: str) -> Iterator[str]:
        if isinstance(actual, T.MapType):
            yield from self.key.mismatch(actual.keyType, f"{path}.key")
            yield from self.value.mismatch(actual.valueType, f"{path}.value")
        else:
            yield f"{path}: declared map, found {actual.simpleString()}"


def parse_type(data: Any, where: str) -> Any:
    """A type from YAML: a name, or a mapping with a kind."""
    if isinstance(data, str):
        if data not in CONTRACT_TYPES:
            raise ContractValidationError(f"{where}: unknown type {data!r}")
        return Simple(data)
    if not isinstance(data, dict) or "kind" not in data:
        raise ContractValidationError(f"{where}: a type is a name or a mapping with a kind")

    def part(key: str) -> Any:
        if key not in data:
            raise ContractValidationError(f"{where}: {data['kind']} needs {key}")
        return data[key]

    kind = data["kind"]
    if kind == "timestamp":
        return Timestamp(data.get("tz"))
    if kind == "list":
        return ListOf(parse_type(part("value_type"), f"{where}[]"))
    if kind == "map":
        return MapOf(parse_type(part("key_type"), f"{where}.key"), parse_type(part("value_type"), f"{where}.value"))
    if kind == "struct":
        fields = part("fields")
        if not isinstance(fields, list) or not fields:
            raise ContractValidationError(f"{where}: a struct needs fields")
        made = []
        for f in fields:
            if not isinstance(f, dict) or "name" not in f or "type" not in f:
                raise ContractValidationError(f"{where}: a field has a name and a type")
            made.append(Field(f["name"], parse_type(f["type"], f"{where}.{f['name']}"), f.get("description", "")))
        if len({f.name for f in made}) < len(made):
            raise ContractValidationError(f"{where}: two fields have one name")
        return StructOf(tuple(made))
    if kind in CONTRACT_TYPES:
        return Simple(kind)
    raise ContractValidationError(f"{where}: unknown kind of type {kind!r}")


def length_kind(type_: Any) -> str:
    """The kind of length that values of a declared type have."""
    if isinstance(type_, ListOf):
        return "list"
    if isinstance(type_, MapOf):
        return "map"
    return "string"


def check_schema(schema: T.StructType, columns: dict[str, tuple[Any, bool]]) -> None:
    """Raise SchemaValidationError with all that is missing or of another type. columns: name to (type, nullable)."""
    there = {f.name: f.dataType for f in schema.fields}
    wrong: list[str] = []
    for name, (type_, _) in columns.items():
        wrong += [f"{name}: missing"] if name not in there else type_.mismatch(there[name], name)
    if wrong:
        raise SchemaValidationError("Schema differs from the contract: " + "; ".join(wrong))
