"""A closed schema as one expression: what in a JSON text breaks it, with the paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import bound

# What is said of a value that breaks a schema, and the sentence before a list of such.
MISSING, SPARE, NO_JSON = "Field required", "Extra inputs are not permitted", "Invalid JSON"
WANTED = {"string": "Input should be a valid string", "number": "Input should be a valid number", "boolean": "Input should be a valid boolean", "list": "Input should be a valid list", "object": "Input should be a valid dictionary"}
HEADING = "The tool input did not match the required schema:"
#: Errors that are told; a record may have more.
TOLD = 6

_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _none() -> Column:
    return F.array().cast("array<struct<path: string, message: string>>")


def _error(path: Column, message: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(message).alias("message")))


def _below(path: Column, name: Column) -> Column:
    return F.concat(path, F.when(path == "", "").otherwise("."), name)


def _errors(value: Column, kind: T.DataType, path: Column) -> Column:
    has = F.coalesce(F.schema_of_variant(value), F.lit(""))
    if isinstance(kind, T.StructType):

        def fields(entries: Column) -> Column:
            found = []
            for f in kind.fields:
                own, child = _below(path, F.lit(f.name)), F.try_element_at(entries, F.lit(f.name))
                missing = _none() if f.nullable else _error(own, MISSING)
                there = _errors(child, f.dataType, own)
                if f.nullable:
                    there = F.when(F.is_variant_null(child), _none()).otherwise(there)
                found.append(F.when(~F.map_contains_key(entries, f.name), missing).otherwise(there))
            spare = F.array_sort(F.array_except(F.map_keys(entries), F.array(*(F.lit(f.name) for f in kind.fields))))
            found.append(F.transform(spare, lambda k: F.struct(_below(path, k).alias("path"), F.lit(SPARE).alias("message"))))
            return F.concat(*found)

        return F.when(has.startswith("OBJECT"), bound(value.cast("map<string,variant>"), fields)).otherwise(_error(path, WANTED["object"]))
    if isinstance(kind, T.ArrayType):
        each = F.flatten(F.transform(value.cast("array<variant>"), lambda x, i: _errors(x, kind.elementType, _below(path, i.cast("string")))))
        return F.when(has.startswith("ARRAY"), F.coalesce(each, _none())).otherwise(_error(path, WANTED["list"]))
    if isinstance(kind, T.StringType):
        fits, wanted = has == "STRING", "string"
    elif isinstance(kind, T.BooleanType):
        fits, wanted = has == "BOOLEAN", "boolean"
    else:
        fits, wanted = F.regexp_extract(has, "^[A-Z]+", 0).isin(*_NUMBERS), "number"
    return F.when(fits, _none()).otherwise(_error(path, WANTED[wanted]))


def schema_errors(json: Column, schema: T.StructType) -> Column:
    """What breaks a closed schema in a JSON text: an array of (path, message) in the schema's order, spare fields of an object behind its own.

    A field that isn't nullable must be there and not be null. The schema is compiled to one expression over the parsed text, which is read once. Null and what is no JSON break it as a whole, with an empty path.
    """
    return bound(F.try_parse_json(json), lambda v: F.when(v.isNull(), _error(F.lit(""), NO_JSON)).otherwise(_errors(v, schema, F.lit(""))))


def errors_text(errors: Column, most: int = TOLD) -> Column:
    """The first errors as text that a writer of the record can act on; null if there are none."""
    lines = F.transform(F.slice(errors, 1, most), lambda e: F.concat(F.lit("- `"), F.when(e["path"] == "", "(root)").otherwise(e["path"]), F.lit("`: "), e["message"]))
    return F.when(F.size(errors) > 0, F.concat(F.lit(HEADING + "\n"), F.array_join(lines, "\n")))
