"""Field checks from a JSON Schema, evaluated as column expressions.

The schema text is read on the driver (it is a setting of a queue); payloads
are parsed once per row in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the types of the schema language show in a parsed value's shape.
SHAPES = {
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"),
}
FRACTIONS = ("DOUBLE", "FLOAT", "DECIMAL")
NULL_SHAPE = "VOID"
SEMVER = (
    r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)"
    r"(?:-(?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*))*)?"
    r"(?:\+[0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*)?$"
)

MISSING, WRONG_TYPE, NULL_VALUE, NOT_JSON = "missing", "wrong type", "null not allowed", "not json"


@dataclass(frozen=True)
class FieldCheck:
    """What one field has to be; ``parent`` is the path of the object holding it."""

    path: str
    parent: str
    types: tuple[str, ...]
    nullable: bool
    required: bool


def resolve(schema: dict, definitions: dict | None = None) -> dict:
    """Follow a reference into the schema's or the companion's definitions."""
    while "$ref" in schema:
        steps = schema["$ref"].split("#", 1)[-1].strip("/").split("/")
        found = schema if schema["$ref"].startswith("#") else (definitions or {})
        for step in steps:
            found = found[step]
        schema = found
    return schema


def field_checks(schema: dict, definitions: dict | None = None, parent: str = "$") -> list[FieldCheck]:
    """Checks of an object schema and the objects inside it."""
    schema = resolve(schema, definitions)
    required = set(schema.get("required", []))
    checks = []
    for name, field in schema.get("properties", {}).items():
        field = resolve(field, definitions)
        kinds = field.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        path = f"{parent}['{name}']"
        checks.append(FieldCheck(
            path, parent, tuple(k for k in kinds if k != "null"),
            bool(field.get("nullable")) or "null" in kinds, name in required,
        ))
        if "properties" in field:
            checks += field_checks(field, definitions, path)
    declared = set(schema.get("properties", {}))
    checks += [FieldCheck(f"{parent}['{n}']", parent, (), True, True) for n in sorted(required - declared)]
    return checks


def shape_of(document: Column, path: str) -> Column:
    """Shape of the value at a path; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(document, path, "variant"))


def _starts(shape: Column, prefixes: tuple[str, ...]) -> Column:
    found = shape.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        found = found | shape.startswith(prefix)
    return found


def _is(kind: str, document: Column, path: str, shape: Column) -> Column:
    fits = _starts(shape, SHAPES[kind])
    if kind == "integer":
        # A whole number may be written with a fraction of zero.
        number = F.try_variant_get(document, path, "double")
        fits = F.when(fits, True).when(_starts(shape, FRACTIONS), number == F.floor(number)).otherwise(False)
    return fits


def violation(document: Column, check: FieldCheck, shape: Column, parent: Column) -> Column:
    """Struct (path, problem) when a document fails a check, else null.

    ``shape`` and ``parent`` are the shapes of the field and of the object that
    should hold it; a field is missing only where that object exists.
    """
    problem = F.when(shape == NULL_SHAPE, F.lit(None if check.nullable else NULL_VALUE))
    if check.types:
        fits = F.lit(False)
        for kind in check.types:
            fits = fits | _is(kind, document, check.path, shape)
        problem = problem.when(shape.isNotNull() & ~fits, WRONG_TYPE)
    if check.required:
        problem = problem.when(shape.isNull() & parent.startswith(SHAPES["object"][0]), MISSING)
    return F.when(problem.isNotNull(), F.struct(F.lit(check.path).alias("path"), problem.alias("problem")))
