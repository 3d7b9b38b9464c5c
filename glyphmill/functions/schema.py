"""Declared schemas: JSON-Schema, Spark types and validation as Columns over a variant."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kind(Enum):
    STRING = "string"
    INTEGER = "integer"
    FLOAT = "float"
    BOOLEAN = "boolean"
    ARRAY = "array"
    OBJECT = "object"
    ARRAY_OF_OBJECTS = "array_of_objects"


#: What schema_of_variant says of each kind's values; booleans pass for numbers.
_TYPES = {
    Kind.STRING: "^STRING$",
    Kind.INTEGER: "^(BIGINT|BOOLEAN)$",
    Kind.FLOAT: "^(BIGINT|BOOLEAN|DOUBLE|DECIMAL.*)$",
    Kind.BOOLEAN: "^BOOLEAN$",
    Kind.ARRAY: "^ARRAY<",
    Kind.ARRAY_OF_OBJECTS: "^ARRAY<",
    Kind.OBJECT: "^OBJECT<",
}
_SAYS = {Kind.STRING: "string", Kind.INTEGER: "integer", Kind.FLOAT: "numeric", Kind.BOOLEAN: "boolean", Kind.ARRAY: "array", Kind.ARRAY_OF_OBJECTS: "array", Kind.OBJECT: "object"}
_SPARK = {Kind.STRING: T.StringType(), Kind.INTEGER: T.LongType(), Kind.FLOAT: T.DoubleType(), Kind.BOOLEAN: T.BooleanType(), Kind.OBJECT: T.VariantType()}


def _typed(value: Column, kind: Kind, item_kind: Kind | None, item_schema: TaskSchema | None) -> Column:
    if kind in (Kind.ARRAY, Kind.ARRAY_OF_OBJECTS):
        items = F.try_variant_get(value, "$", "array<variant>")
        if item_schema:
            made = F.transform(items, lambda i: F.when(F.schema_of_variant(i).rlike(_TYPES[Kind.OBJECT]), item_schema.typed(i)))
        elif kind is Kind.ARRAY and item_kind in _SPARK:
            made = F.transform(items, lambda i: _typed(i, item_kind, None, None))
        else:
            made = items
        return F.when(F.schema_of_variant(value).rlike(_TYPES[kind]), made)
    plain = value if kind is Kind.OBJECT else F.try_variant_get(value, "$", _SPARK[kind].simpleString())
    if kind in (Kind.INTEGER, Kind.FLOAT):  # booleans pass for numbers
        truth = F.when(F.try_variant_get(value, "$", "string") == "true", F.lit(1)).otherwise(F.lit(0)).cast(_SPARK[kind])
        plain = F.when(F.schema_of_variant(value) == "BOOLEAN", truth).otherwise(plain)
    return F.when(F.schema_of_variant(value).rlike(_TYPES[kind]), plain)


def _fits(value: Column, kind: Kind, item_kind: Kind | None, item_schema: TaskSchema | None) -> Column:
    fits = F.schema_of_variant(value).rlike(_TYPES[kind])
    if kind in (Kind.ARRAY, Kind.ARRAY_OF_OBJECTS):
        items = F.try_variant_get(value, "$", "array<variant>")
        if item_schema:
            fits &= F.forall(items, lambda i: F.schema_of_variant(i).rlike(_TYPES[Kind.OBJECT]) & (F.size(item_schema.misfits(i)) == 0))
        elif kind is Kind.ARRAY and item_kind in _SPARK:
            fits &= F.forall(items, lambda i: _fits(i, item_kind, None, None))
    return fits


@dataclass
class FieldSpec:
    name: str
    kind: Kind
    description: str = ""
    required: bool = True
    enum: list[Any] | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    pattern: str | None = None
    item_kind: Kind | None = None
    item_schema: TaskSchema | None = None
    default: Any = None
    examples: list[Any] | None = None

    def json_schema(self) -> dict:
        out: dict[str, Any] = {"type": "array" if self.kind is Kind.ARRAY_OF_OBJECTS and self.item_schema else self.kind.value, "description": self.description}
        if self.kind in (Kind.STRING, Kind.INTEGER, Kind.FLOAT):
            out |= {"enum": self.enum} if self.enum else {}
        if self.kind is Kind.STRING:
            out |= {k: v for k, v in (("minLength", self.min_length), ("maxLength", self.max_length), ("pattern", self.pattern)) if v is not None}
        if self.kind in (Kind.INTEGER, Kind.FLOAT):
            out |= {k: v for k, v in (("minimum", self.min_value), ("maximum", self.max_value)) if v is not None}
        if self.kind is Kind.ARRAY:
            out |= {k: v for k, v in (("minItems", self.min_length), ("maxItems", self.max_length)) if v is not None}
            items = {"type": self.item_kind.value} if self.item_kind else self.item_schema.json_schema() if self.item_schema else None
            out |= {"items": items} if items else {}
        if self.kind is Kind.ARRAY_OF_OBJECTS and self.item_schema:
            out["items"] = self.item_schema.json_schema()
        return out | ({"examples": self.examples} if self.examples else {})

    def spark_type(self) -> T.DataType:
        if self.kind is Kind.ARRAY:
            return T.ArrayType(_SPARK.get(self.item_kind, T.VariantType()))
        if self.kind is Kind.ARRAY_OF_OBJECTS:
            return T.ArrayType(self.item_schema.struct_type() if self.item_schema else T.VariantType())
        return _SPARK[self.kind]

    def typed(self, obj: Column) -> Column:
        """The field's value in its declared type, null where it is absent or of another kind; so are items of an array."""
        return _typed(F.try_variant_get(obj, f"$['{self.name}']", "variant"), self.kind, self.item_kind, self.item_schema)

    def misfit(self, obj: Column) -> Column:
        """Whether there is a value that the declared type can't hold as it is."""
        value = F.try_variant_get(obj, f"$['{self.name}']", "variant")
        return F.coalesce(value.isNotNull() & ~F.is_variant_null(value) & ~_fits(value, self.kind, self.item_kind, self.item_schema), F.lit(False))

    def error(self, obj: Column, name: str | None = None) -> Column:
        """The field's first error as text, null if it is valid. Limits of 0 on lengths aren't enforced."""
        name = name or self.name
        value = F.try_variant_get(obj, f"$['{self.name}']", "variant")
        kind = F.schema_of_variant(value)
        text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
        number = F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(number)
        said = lambda x: F.lit(f"Field '{name}' {x}")
        checks: list[tuple[Column, Column]] = [(~kind.rlike(_TYPES[self.kind]), said(f"should be {_SAYS[self.kind]} type"))]
        if self.kind is Kind.STRING:
            if self.min_length:
                checks.append((F.length(text) < self.min_length, said(f"length must not be less than {self.min_length}")))
            if self.max_length:
                checks.append((F.length(text) > self.max_length, said(f"length must not exceed {self.max_length}")))
            if self.enum:
                checks.append((~text.isin(self.enum), said(f"value must be one of {self.enum}")))
        if self.kind in (Kind.INTEGER, Kind.FLOAT):
            if self.min_value is not None:
                checks.append((number < self.min_value, said(f"must not be less than {self.min_value}")))
            if self.max_value is not None:
                checks.append((number > self.max_value, said(f"must not be greater than {self.max_value}")))
        if self.kind is Kind.ARRAY:
            items = F.try_variant_get(value, "$", "array<variant>")
            if self.min_length:
                checks.append((F.size(items) < self.min_length, said(f"array length must not be less than {self.min_length}")))
            if self.max_length:
                checks.append((F.size(items) > self.max_length, said(f"array length must not exceed {self.max_length}")))
            if self.item_kind in (Kind.STRING, Kind.INTEGER, Kind.FLOAT):
                wrong = F.array_position(F.transform(items, lambda i: ~F.schema_of_variant(i).rlike(_TYPES[self.item_kind])), True)
                checks.append((wrong > 0, F.concat(F.lit(f"Field '{name}["), (wrong - 1).cast("string"), F.lit(f"]' should be {_SAYS[self.item_kind]} type"))))
        if self.kind is Kind.ARRAY_OF_OBJECTS and self.item_schema:
            items = F.try_variant_get(value, "$", "array<variant>")

            def item_error(i: Column) -> Column:
                found = self.item_schema.errors(i)
                # a Python list's form: texts with a quote stand in double quotes
                listed = F.concat(F.lit("["), F.array_join(F.transform(found, lambda e: F.concat(F.lit('"'), e, F.lit('"'))), ", "), F.lit("]"))
                return F.when(~F.schema_of_variant(i).rlike("^OBJECT<"), F.lit("' should be object type")).when(F.size(found) > 0, F.concat(F.lit("': "), listed))

            found = F.transform(items, lambda i, k: F.concat(F.lit(f"Field '{name}["), k.cast("string"), F.lit("]"), item_error(i)))
            first = F.get(F.filter(found, lambda e: e.isNotNull()), F.lit(0))
            checks.append((first.isNotNull(), first))
        out = F.when(value.isNull() | F.is_variant_null(value), said("is required") if self.required else F.lit(None))
        for bad, says in checks:
            out = out.when(bad, says)
        return out


@dataclass
class TaskSchema:
    name: str
    fields: list[FieldSpec] = field(default_factory=list)
    root_key: str | None = None

    def json_schema(self) -> dict:
        inner = {"type": "object", "properties": {f.name: f.json_schema() for f in self.fields}, "required": self.required()}
        if not self.root_key:
            return inner
        return {"type": "object", "properties": {self.root_key: inner}, "required": [self.root_key]}

    def text(self) -> str:
        return json.dumps(self.json_schema(), ensure_ascii=False, indent=2)

    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields])

    def errors(self, obj: Column) -> Column:
        """All fields' errors, in order of declaration. Keys that aren't declared are ignored."""
        return F.filter(F.array(*(f.error(obj) for f in self.fields)).cast("array<string>"), lambda e: e.isNotNull())

    def typed(self, obj: Column) -> Column:
        """A variant object as the declared struct: its fields are typed columns, which later steps can prune."""
        return F.struct(*(f.typed(obj).alias(f.name) for f in self.fields))

    def misfits(self, obj: Column) -> Column:
        """Names of the fields whose value the struct doesn't hold as it is: the way by which such rows are routed."""
        return F.filter(F.array(*(F.when(f.misfit(obj), F.lit(f.name)) for f in self.fields)).cast("array<string>"), lambda n: n.isNotNull())

    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    def optional(self) -> list[str]:
        return [f.name for f in self.fields if not f.required]

    def get_field(self, name: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.name == name), None)

    def add_field(self, spec: FieldSpec) -> None:
        self.fields.append(spec)


@dataclass
class ExtractionTask:
    name: str
    schema: TaskSchema
    description: str = ""
    rules: list[str] = field(default_factory=list)
    examples: list[dict] = field(default_factory=list)

    def info(self) -> dict:
        return {"name": self.name, "description": self.description, "schema": self.schema.json_schema(), "rules": len(self.rules), "examples": len(self.examples)}


class SchemaRegistry:
    """Named schemas of this process."""

    _known: dict[str, TaskSchema] = {}

    @classmethod
    def register(cls, name: str, schema: TaskSchema) -> None:
        cls._known[name] = schema

    @classmethod
    def get(cls, name: str) -> TaskSchema | None:
        return cls._known.get(name)

    @classmethod
    def names(cls) -> list[str]:
        return list(cls._known)

    @classmethod
    def unregister(cls, name: str) -> bool:
        return cls._known.pop(name, None) is not None


KEYWORD_SCHEMA = TaskSchema("keywords", [FieldSpec("keywords", Kind.ARRAY_OF_OBJECTS, "keyword triples"), FieldSpec("category", Kind.STRING, required=False)])
SENTIMENT_SCHEMA = TaskSchema("sentiment", [FieldSpec("sentiment", Kind.STRING, enum=["positive", "negative", "neutral"]), FieldSpec("confidence", Kind.FLOAT, min_value=0, max_value=1)])
