"""Schema registry checks and payload validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonschema import NOT_JSON, SEMVER, WRONG_TYPE, field_checks, shape_of, violation
from ..functions.once import with_computed


class SchemaError(ValueError):
    """A registration that cannot be accepted."""


def registry_problems(registry: DataFrame) -> DataFrame:
    """Registrations without a schema or with a version that is not semantic."""
    problem = F.when(F.col("schema").isNull(), "no schema").when(
        ~F.coalesce(F.col("version").rlike(SEMVER), F.lit(False)), "version is not semver"
    )
    return registry.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def require_valid(registry: DataFrame) -> DataFrame:
    bad = registry_problems(registry).select("queue", "version", "problem").first()
    if bad:
        raise SchemaError(f"queue {bad['queue']}, version {bad['version']}: {bad['problem']}")
    return registry


def with_violations(events: DataFrame, schema: dict, definitions: dict | None = None) -> DataFrame:
    """Add ``violations``, an array of (path, problem); empty for a good payload.

    Three steps, each once per row: parse, take the shape of every named field,
    compare the shapes.
    """
    checks = field_checks(schema, definitions)
    shapes = {c.path: f"_shape{i}" for i, c in enumerate(checks)}
    document = F.col("_document")
    rows = with_computed(events, _document=F.try_parse_json("payload"))
    rows = with_computed(
        rows, _shape=F.schema_of_variant(document), **{n: shape_of(document, p) for p, n in shapes.items()}
    )
    whole = F.when(F.col("_shape").isNull(), NOT_JSON).when(~F.col("_shape").startswith("OBJECT"), WRONG_TYPE)
    found = [
        F.when(whole.isNotNull(), F.struct(F.lit("$").alias("path"), whole.alias("problem"))),
        *[
            violation(document, c, F.col(shapes[c.path]), F.col(shapes.get(c.parent, "_shape"))) for c in checks
        ],
    ]
    rows = with_computed(rows, violations=F.array_compact(F.array(*found)))
    return rows.select(*events.columns, "violations")


def good_events(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("violations") == 0).drop("violations")


def violations(validated: DataFrame, *columns: str) -> DataFrame:
    """One row per failed check."""
    return validated.select(*columns, F.explode("violations").alias("_v")).select(
        *columns, F.col("_v.path").alias("path"), F.col("_v.problem").alias("problem")
    )
