"""Typed-attribute JSON (``{"S": ..}``, ``{"M": ..}``) and values typed by their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Attribute tags.
TEXT, NUMBER, BOOLEAN, NULL, MAP, LIST, BINARY = "S", "N", "BOOL", "NULL", "M", "L", "B"

# Texts that stand for other types.
NUMBER_TEXT = r"^\d+(?:\.\d*)?$"
BOOLEAN_TEXT = r"(?i)^(?:false|true)$"
NULL_TEXT = "null"
ABSENT_TEXT = "undefined"


def tagged_type(target: T.DataType) -> T.DataType:
    """Parsing type of the tagged form of ``target``."""
    if isinstance(target, T.StructType):
        inner = T.StructType([T.StructField(f.name, tagged_type(f.dataType)) for f in target])
        return T.StructType([T.StructField(MAP, inner)])
    if isinstance(target, T.MapType):
        return T.StructType([T.StructField(MAP, T.MapType(T.StringType(), tagged_type(target.valueType)))])
    if isinstance(target, T.ArrayType):
        return T.StructType([T.StructField(LIST, T.ArrayType(tagged_type(target.elementType)))])
    if isinstance(target, T.BooleanType):
        return T.StructType([T.StructField(BOOLEAN, T.BooleanType())])
    if isinstance(target, T.BinaryType):
        return T.StructType([T.StructField(BINARY, T.StringType())])
    if isinstance(target, T.StringType):
        return T.StructType([T.StructField(TEXT, T.StringType())])
    return T.StructType([T.StructField(NUMBER, T.StringType())])


def untag(c: Column, target: T.DataType) -> Column:
    """Plain value of a parsed tagged value; a NULL tag or a missing one gives null."""
    if isinstance(target, T.StructType):
        fields = [untag(c[MAP][f.name], f.dataType).alias(f.name) for f in target]
        return F.when(c[MAP].isNotNull(), F.struct(*fields))
    if isinstance(target, T.MapType):
        return F.transform_values(c[MAP], lambda _, v: untag(v, target.valueType))
    if isinstance(target, T.ArrayType):
        return F.transform(c[LIST], lambda v: untag(v, target.elementType))
    if isinstance(target, T.BooleanType):
        return c[BOOLEAN]
    if isinstance(target, T.BinaryType):
        return F.unbase64(c[BINARY])
    if isinstance(target, T.StringType):
        return c[TEXT]
    return c[NUMBER].try_cast(target)


def tag(c: Column, target: T.DataType) -> Column:
    """Tagged form of a plain value, the inverse of :func:`untag`."""
    if isinstance(target, T.StructType):
        value = F.struct(*[tag(c[f.name], f.dataType).alias(f.name) for f in target])
        return F.when(c.isNotNull(), F.struct(value.alias(MAP)))
    if isinstance(target, T.MapType):
        value = F.transform_values(c, lambda _, v: tag(v, target.valueType))
        return F.when(c.isNotNull(), F.struct(value.alias(MAP)))
    if isinstance(target, T.ArrayType):
        value = F.transform(c, lambda v: tag(v, target.elementType))
        return F.when(c.isNotNull(), F.struct(value.alias(LIST)))
    if isinstance(target, T.BooleanType):
        return F.when(c.isNotNull(), F.struct(c.alias(BOOLEAN)))
    if isinstance(target, T.BinaryType):
        return F.when(c.isNotNull(), F.struct(F.base64(c).alias(BINARY)))
    name = TEXT if isinstance(target, T.StringType) else NUMBER
    return F.when(c.isNotNull(), F.struct(c.cast("string").alias(name)))


def parsed_image(text: Column, target: T.StructType) -> Column:
    """Tagged attributes of a record image: an object without an outer tag."""
    return F.from_json(text, T.StructType([T.StructField(f.name, tagged_type(f.dataType)) for f in target]))


def plain_image(parsed: Column, target: T.StructType) -> Column:
    """Plain document of :func:`parsed_image`. Parse in a step of its own, so each text is parsed once."""
    fields = [untag(parsed[f.name], f.dataType).alias(f.name) for f in target]
    return F.when(parsed.isNotNull(), F.struct(*fields))


def image_json(c: Column, target: T.StructType) -> Column:
    """JSON text of a record image."""
    return F.to_json(F.struct(*[tag(c[f.name], f.dataType).alias(f.name) for f in target]))


def typed_value(text: Column) -> Column:
    """(kind, number, flag, text) of a text; kind ``absent`` marks values to leave out.

    Signs and exponents are not part of the number form, so such texts stay texts.
    """
    kind = (
        F.when(text.isNull() | (text == NULL_TEXT), "null")
        .when(text.rlike(NUMBER_TEXT), "number")
        .when(text.rlike(BOOLEAN_TEXT), "boolean")
        .when(text == ABSENT_TEXT, "absent")
        .otherwise("text")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "number", text.try_cast("double")).alias("number"),
        F.when(kind == "boolean", F.lower(text) == "true").alias("flag"),
        F.when(kind == "text", text).alias("text"),
    )


def typed_list(texts: Column) -> Column:
    """Typed values of a list; its length does not change."""
    return F.transform(texts, typed_value)


def typed_map(texts: Column) -> Column:
    """Typed values of a map; absent ones leave the map."""
    return F.map_filter(F.transform_values(texts, lambda _, v: typed_value(v)), lambda _, v: v["kind"] != "absent")


# A value of compact JSON: what stands between these is a whole text of an array, an object or alone. Quotes
# within texts follow a backslash, so none of them can begin or end such a match; a key ends before a colon.
_BEFORE, _BEHIND = r"(?<=[\[,:]|^)", r"(?=[,\]}]|$)"
_KEY = r'"[^"\\]*(?:\\.[^"\\]*)*"'


def typed_json(text: Column) -> Column:
    """JSON with all texts, at any depth, typed as :func:`typed_value` types them.

    Absent values leave their object; in an array, or alone, they are null. The result is
    compact, with sorted keys; null for a text that is no JSON.
    """
    compact = F.to_json(F.try_parse_json(text))
    for pattern, value in (
        # All but an object's first absent entry, then the first.
        (rf',{_KEY}:"{ABSENT_TEXT}"(?=[,}}])', ""),
        (rf'\{{{_KEY}:"{ABSENT_TEXT}"(?:,|(?=\}}))', "{"),
        (rf'{_BEFORE}"{ABSENT_TEXT}"{_BEHIND}', "null"),
        (rf'{_BEFORE}"{NULL_TEXT}"{_BEHIND}', "null"),
        (rf'{_BEFORE}"(?i:true)"{_BEHIND}', "true"),
        (rf'{_BEFORE}"(?i:false)"{_BEHIND}', "false"),
        # JSON knows neither leading zeros nor a point without digits behind it.
        (rf'{_BEFORE}"0*(\d+(?:\.\d+)?)\.?"{_BEHIND}', "$1"),
    ):
        compact = F.regexp_replace(compact, F.lit(pattern), F.lit(value))
    return compact
