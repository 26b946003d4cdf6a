"""JSON answers against a record's schema, as column expressions over variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

#: What a value of a kind is as a variant.
_KINDS = ((StringType, r"^STRING$"), (BooleanType, r"^BOOLEAN$"), ((IntegerType, LongType), r"^BIGINT$"), (DoubleType, r"^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$"))

#: Least and most of a path: characters of a text, entries of a list, or the number itself; or the values that it may have.
Bounds = dict[str, tuple]


def _beyond(value: Column, kind: DataType, path: str, bounds: Bounds) -> Column:
    limits = bounds.get(path)
    if limits is None:
        return F.lit(False)
    if isinstance(kind, StringType):
        own = F.try_variant_get(value, "$", "string")
        if isinstance(limits[0], str):
            return ~own.isin(*limits)
        own = F.char_length(own)
    elif isinstance(kind, ArrayType):
        own = F.size(F.try_variant_get(value, "$", "array<variant>"))
    else:
        own = F.try_variant_get(value, "$", "double")
    return ~own.between(*limits)


def _offence(value: Column, kind: DataType, needed: bool, at: Column, path: str, bounds: Bounds) -> Column:
    """The first place within a value that isn't as its kind and bounds ask, or null.  at: its place as told; path: the same without places in lists."""
    is_null = value.isNull() | F.is_variant_null(value)
    if isinstance(kind, StructType):
        fields = [_offence(F.try_variant_get(value, f"$['{f.name}']", "variant"), f.dataType, not f.nullable, F.concat(at, F.lit(f".{f.name}")), f"{path}.{f.name}", bounds) for f in kind.fields]
        whole = F.schema_of_variant(value).startswith("OBJECT<")
        within = F.when(~whole, at).otherwise(F.coalesce(*fields))
    elif isinstance(kind, ArrayType):
        entries = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(entries, lambda x, i: _offence(x, kind.elementType, not kind.containsNull, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), f"{path}[]", bounds))
        first = F.element_at(F.filter(each, lambda x: x.isNotNull()), 1)
        whole = F.schema_of_variant(value).startswith("ARRAY<")
        within = F.when(~whole | _beyond(value, kind, path, bounds), at).otherwise(F.when(F.exists(each, lambda x: x.isNotNull()), first))
    else:
        pattern = next(p for t, p in _KINDS if isinstance(kind, t))
        within = F.when(~F.schema_of_variant(value).rlike(pattern) | _beyond(value, kind, path, bounds), at)
    return F.when(is_null, at if needed else F.lit(None).cast("string")).otherwise(within)


def offence(value: Column, kind: StructType, bounds: Bounds | None = None) -> Column:
    """The first offending path of an answer, a variant, or null if it is a record of the kind.

    Fields that may be null may be left out, and fields that are not asked for are ignored.  A path is as in `$.facts[1].name`; a list that is
    too long offends as a whole.  Null, which try_parse_json makes of what is no JSON, offends as `$`."""
    return _offence(value, kind, True, F.lit("$"), "$", bounds or {})


def record(value: Column, kind: StructType) -> Column:
    """The record in an answer without offence."""
    return F.try_variant_get(value, "$", kind.simpleString())
