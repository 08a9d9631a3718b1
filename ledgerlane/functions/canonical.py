"""Canonical JSON (RFC 8785) of arbitrary documents."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.functions.keys import canonical_struct


def number(x: float) -> str:
    """A double as ECMAScript writes it."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, n = "".join(map(str, digits)), len(digits) + exponent
    if 0 < n <= 21:
        body = text + "0" * (n - len(text)) if n >= len(text) else f"{text[:n]}.{text[n:]}"
    elif -6 < n <= 0:
        body = "0." + "0" * -n + text
    else:
        body = f"{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{'+' if n > 0 else '-'}{abs(n - 1)}"
    return ("-" if sign else "") + body


def canonical(value: object, floats: bool = True) -> str:
    """Canonical text of a parsed document; without floats, one raises."""
    if isinstance(value, float):
        if not floats:
            raise ValueError("floats are not allowed here")
        return number(value)
    if isinstance(value, dict):
        items = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v, floats)}" for k, v in items) + "}"
    if isinstance(value, list):
        return "[" + ",".join(canonical(v, floats) for v in value) + "]"
    return json.dumps(value, ensure_ascii=False)


def canonical_json(text: Column, floats: bool = True) -> Column:
    """UDF-1: canonical text of JSON text; null stays null, malformed text raises."""

    @F.pandas_udf(T.StringType())
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else canonical(json.loads(x), floats))

    return run(text)


#: Types that Spark's own JSON writes canonically.
_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def canonical_row(rows: DataFrame, names: list[str] | None = None) -> Column:
    """Canonical JSON of a row's columns. Strings, booleans and whole numbers are written without Python;
    a row with other types is parsed and written again."""
    names = rows.columns if names is None else names
    if all(isinstance(rows.schema[n].dataType, _PLAIN) for n in names):
        return canonical_struct(**{n: F.col(f"`{n}`") for n in names})
    return canonical_json(F.to_json(F.struct(*[F.col(f"`{n}`") for n in sorted(names)]), {"ignoreNullFields": "false"}))
