"""JSON in one form: keys in order of code points, ", " and ": " between, signs beyond ASCII as they are. An expression, by the type of the column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, NullType, StringType, StructType

#: What has a short escape in JSON; other control characters have their number.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_OTHERS = [chr(c) for c in range(0x20) if chr(c) not in SHORT]


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    out = text
    for sign, escape in SHORT.items():
        out = F.replace(out, F.lit(sign), F.lit(escape))
    rare = out
    for sign in _OTHERS:
        rare = F.replace(rare, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x07\\x0B\\x0E-\\x1F]"), rare).otherwise(out), F.lit('"'))


def canonical_json(value: Column, kind: DataType) -> Column:
    """The JSON text of a column of this type: structs, maps keyed by strings, arrays, strings, whole numbers and booleans."""
    if isinstance(kind, StringType):
        out = quoted(value)
    elif isinstance(kind, (IntegralType, BooleanType)):
        out = value.cast("string")
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entries = F.array_sort(F.map_entries(value), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
        pair = lambda e: F.concat(quoted(e["key"]), F.lit(": "), canonical_json(e["value"], kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, pair), ", "), F.lit("}"))
    elif isinstance(kind, StructType):
        parts = [F.concat(F.lit(f"{', ' if i else '{'}"), quoted(F.lit(f.name)), F.lit(": "), canonical_json(value[f.name], f.dataType)) for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name))]
        out = F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
    elif isinstance(kind, NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def canonical_digest(value: Column, kind: DataType) -> Column:
    """SHA-256 of the canonical form's UTF-8."""
    return F.sha2(canonical_json(value, kind), 256)
