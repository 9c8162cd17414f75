"""Records of JSON lines against a schema: good ones as rows, the others with what is wrong with them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

#: Fixed value: the largest record in bytes.
MOST_BYTES = 24 * 1024 * 1024
#: What VARIANT calls the values that a type takes.
_TAKES: dict[type, str] = {StringType: "= 'STRING'", BooleanType: "= 'BOOLEAN'", LongType: "= 'BIGINT'", IntegerType: "= 'BIGINT'", DoubleType: "RLIKE '^(DOUBLE|BIGINT|DECIMAL)'"}


def _finding(pointer: str, reason: str) -> str:
    return f"array(named_struct('pointer', {pointer}, 'reason', '{reason}'))"


_NONE = "CAST(array() AS array<struct<pointer: string, reason: string>>)"


def _checks(value: str, pointer: str, kind: DataType, depth: int) -> str:
    """SQL of the findings (array of pointer and reason) of a VARIANT against a type."""
    wrong = _finding(pointer, "wrong_type")
    if isinstance(kind, StructType):
        m = f"m{depth}"
        known = ", ".join(f"'{f.name}'" for f in kind.fields)
        unknown = f"transform(filter(map_keys({m}), k -> NOT k IN ({known})), k -> named_struct('pointer', concat({pointer}, '/', k), 'reason', 'unknown_member'))"
        parts = [unknown]
        for f in kind.fields:
            own, at = f"try_element_at({m}, '{f.name}')", f"concat({pointer}, '/{f.name}')"
            missing = _NONE if f.nullable else _finding(at, "missing_member")
            parts.append(f"IF({own} IS NULL OR is_variant_null({own}), {missing}, {_checks(own, at, f.dataType, depth + 1)})")
        return f"transform(array(try_variant_get({value}, '$', 'map<string,variant>')), {m} -> IF({m} IS NULL, {wrong}, concat({', '.join(parts)})))[0]"
    if isinstance(kind, ArrayType):
        a, x, i = f"a{depth}", f"x{depth}", f"i{depth}"
        each = _checks(x, f"concat({pointer}, '/', {i})", kind.elementType, depth + 1)
        null = _NONE if kind.containsNull else _finding(f"concat({pointer}, '/', {i})", "missing_member")
        return f"transform(array(try_variant_get({value}, '$', 'array<variant>')), {a} -> IF({a} IS NULL, {wrong}, flatten(transform({a}, ({x}, {i}) -> IF({x} IS NULL OR is_variant_null({x}), {null}, {each})))))[0]"
    test = _TAKES[type(kind)]
    fits = f"schema_of_variant({value}) {test}"
    if isinstance(kind, IntegerType):
        fits += f" AND try_variant_get({value}, '$', 'int') IS NOT NULL"
    return f"IF({fits}, {_NONE}, {wrong})"


def guard_records(lines: DataFrame, schema: StructType | str, invariants: Mapping[str, str] | None = None, *, text: str = "text", version: str | None = None, newest: int | None = None, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The good records of ``lines`` and the quarantine: what every other line breaks.

    Good: the columns of ``lines`` but its text, and ``record``, a struct of the schema.
    Quarantine: those columns, ``pointer`` and ``reason``: ``too_large``,
    ``not_json``, ``newer_version`` (of the member ``version``, above ``newest``; such a
    record isn't looked into), ``wrong_type``, ``unknown_member``, ``missing_member`` (of a field that
    isn't nullable) at any depth, or, where the schema holds, the name of each
    broken invariant (SQL over the schema's members; null is broken). Members may be strings, whole
    numbers, doubles, booleans, structs and arrays. A record is parsed once and its checks
    are one expression, so both results are a scan without a shuffle.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rest = [c for c in lines.columns if c != text]
    body, found, parsed = "__text", "__found", "__record"
    tests = "array_compact(array(" + ", ".join(f"IF(coalesce(({rule}), false), NULL, named_struct('pointer', '', 'reason', '{name}'))" for name, rule in (invariants or {}).items()) + "))" if invariants else _NONE
    newer = f"coalesce(try_variant_get(__json, '$.{version}', 'bigint') > {newest}, false)" if version else "false"
    rows = lines.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__own"), F.col(f"`{text}`").alias(body))
    rows = rows.withColumn("__json", F.expr(f"IF(octet_length({body}) <= {most_bytes}, try_parse_json({body}), NULL)"))
    problems = F.expr(f"CASE WHEN octet_length({body}) > {most_bytes} THEN {_finding(repr(''), 'too_large')} WHEN __json IS NULL THEN {_finding(repr(''), 'not_json')} WHEN {newer} THEN {_finding(repr(''), 'newer_version')} ELSE {_checks('__json', repr(''), schema, 0)} END")
    rows = rows.withColumn(found, problems).withColumn(parsed, F.when(F.size(found) == 0, F.from_json(body, schema)))
    # invariants are written over the members' own names
    members = [F.col(f"{parsed}.{f.name}").alias(f.name) for f in schema.fields]
    checked = rows.select("__own", found, parsed, *members).withColumn(found, F.expr(f"IF(size({found}) = 0, {tests}, {found})"))
    own = [F.col(f"__own.`{c}`").alias(c) for c in rest]
    good = checked.where(F.size(found) == 0).select(*own, F.col(parsed).alias("record"))
    bad = checked.select("__own", F.explode(found).alias("__f")).select(*own, "__f.pointer", "__f.reason")
    return good, bad
