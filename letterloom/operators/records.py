"""Checking JSON records against a fixed schema, without leaving the JVM."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.functions.text import let, literal_texts

# JSON type names by the first word of a variant's declared type; all others are numbers
JSON_TYPES = {
    "VOID": "null",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "OBJECT": "object",
    "ARRAY": "array",
}


def _problem(path: Column, problem: str, expected: str, found: Column) -> Column:
    return F.struct(
        path.alias("path"),
        F.lit(problem).alias("problem"),
        F.lit(expected).alias("expected"),
        found.alias("found"),
    )


def _expected(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    return "number"


def _is(declared: Column, expected: str) -> Column:
    if expected == "number":
        return ~declared.isin(list(JSON_TYPES))
    return declared == next(word for word, name in JSON_TYPES.items() if name == expected)


def _check(value: Column, kind: T.DataType, path: Column, optional: bool) -> Column:
    """Array of the problems of one value; NULL entries stand for checks that hold."""
    expected = _expected(kind)
    absent = F.lit(None) if optional else _problem(path, "missing", expected, F.lit("undefined"))

    def judged(declared: Column) -> Column:
        wrong = F.when(~_is(declared, expected), _problem(path, "wrong type", expected, declared))
        own = F.array(F.when(declared.isNull(), absent).otherwise(wrong))
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.when(_is(declared, expected), _inner(value, kind, path)).otherwise(own)
        return own

    word = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return let(F.when(value.isNotNull(), word), judged)


def _inner(value: Column, kind: T.DataType, path: Column) -> Column:
    if isinstance(kind, T.StructType):
        return F.concat(*[_field(value, field, path) for field in kind.fields])
    if isinstance(kind, T.MapType):
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        return F.flatten(
            F.transform(
                entries,
                lambda e: _check(
                    e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"]), False
                ),
            )
        )
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.flatten(
        F.transform(
            items,
            lambda item, i: _check(
                item, kind.elementType, F.format_string("%s[%d]", path, i), False
            ),
        )
    )


def _field(parent: Column, field: T.StructField, path: Column) -> Column:
    place = F.concat(path, F.lit(f".{field.name}"))
    return let(
        F.try_variant_get(parent, f"$.{field.name}", "variant"),
        lambda value: _check(value, field.dataType, place, field.nullable),
    )


def violations(json: Column, schema: T.StructType) -> Column:
    """Array of every way in which a JSON text breaks the schema; unknown keys are no violation."""
    not_json = F.array(_problem(F.lit("$"), "not JSON", "object", F.lit("text")))
    checked = let(
        F.try_parse_json(json),
        lambda record: F.when(record.isNull(), not_json).otherwise(
            _check(record, schema, F.lit("$"), False)
        ),
    )
    words = literal_texts([*JSON_TYPES, "undefined", "text"])
    names = literal_texts([*JSON_TYPES.values(), "undefined", "text"])
    json_type = F.map_from_arrays(words, names)
    return F.transform(
        F.filter(checked, lambda p: p.isNotNull()),
        lambda p: p.withField(
            "found", F.coalesce(F.try_element_at(json_type, p["found"]), F.lit("number"))
        ),
    )


def validate_records(df: DataFrame, json: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """One row per violation."""
    return df.select(*keys, F.inline(violations(F.col(json), schema)))


def keep_declared(df: DataFrame, json: str, schema: T.StructType, record: str) -> DataFrame:
    """Add the record with its declared fields only, nested ones too."""
    return df.withColumn(record, F.from_json(F.col(json), schema))


def split_valid(
    df: DataFrame, json: str, schema: T.StructType, record: str = "record"
) -> tuple[DataFrame, DataFrame]:
    """(valid rows with their typed record, invalid rows with their violations)."""
    checked = df.withColumn("violations", violations(F.col(json), schema))
    valid = checked.filter(F.size("violations") == 0).drop("violations")
    invalid = checked.filter(F.size("violations") > 0)
    return keep_declared(valid, json, schema, record).drop(json), invalid
