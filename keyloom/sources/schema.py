"""JSON Schema to Spark types and back."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values: (type, format) of JSON Schema and the Spark type; the first of a type is its default.
_SCALARS = [
    ("string", "", T.StringType()),
    ("string", "date-time", T.TimestampNTZType()),
    ("string", "datetime", T.TimestampNTZType()),
    ("string", "byte", T.BinaryType()),
    ("string", "binary", T.BinaryType()),
    ("string", "bytes", T.BinaryType()),
    ("integer", "", T.LongType()),
    ("integer", "int64", T.LongType()),
    ("integer", "int32", T.IntegerType()),
    ("number", "", T.DoubleType()),
    ("number", "double", T.DoubleType()),
    ("number", "float", T.FloatType()),
    ("number", "single", T.FloatType()),
    ("number", "decimal", T.DecimalType(38, 18)),
    ("boolean", "", T.BooleanType()),
]


def from_json_schema(schema: dict) -> T.DataType:
    """Objects take the fields of `required` first, then the others as they come."""
    kind, form = str(schema.get("type", "")).lower(), str(schema.get("format", "")).lower()
    if kind == "object":
        properties = schema.get("properties")
        if not isinstance(properties, dict) or not properties:
            raise ValueError("an object needs properties")
        names = list(dict.fromkeys([*schema.get("required", []), *properties]))
        if missing := [n for n in names if n not in properties]:
            raise ValueError(f"required but not in properties: {missing}")
        return T.StructType([T.StructField(n, from_json_schema(properties[n])) for n in names])
    if kind == "array":
        if "items" not in schema:
            raise ValueError("an array needs items")
        return T.ArrayType(from_json_schema(schema["items"]))
    found = [t for k, f, t in _SCALARS if k == kind]
    if not found:
        raise ValueError(f"unsupported type {schema.get('type')!r}")
    return next((t for k, f, t in _SCALARS if k == kind and f == form), found[0])


def to_json_schema(kind: T.DataType) -> dict:
    if isinstance(kind, T.StructType):
        return {"type": "object", "required": kind.names, "properties": {f.name: to_json_schema(f.dataType) for f in kind.fields}}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": to_json_schema(kind.elementType)}
    if isinstance(kind, T.DecimalType):
        return {"type": "number", "format": "decimal"}
    if isinstance(kind, (T.ByteType, T.ShortType)):
        kind = T.IntegerType()
    if isinstance(kind, T.TimestampType):
        kind = T.TimestampNTZType()
    matches = [(k, f) for k, f, t in _SCALARS if t == kind]
    if not matches:
        raise ValueError(f"{kind.simpleString()} has no JSON Schema form")
    name, form = next((m for m in matches if m[1] in ("int64", "int32", "date-time", "byte", "double", "float")), matches[0])
    return {"type": name} | ({"format": form} if form and form not in ("int64", "double") else {})
