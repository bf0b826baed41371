"""Redaction of whole records: structs, arrays, maps, variants and JSON texts of any nesting.

The expression is built from the schema: a field whose name tells of a secret or of mail content becomes a mark, whatever was in it; all
other texts go through ``text.redacted``; what holds other values is walked.  Names are compared without case and signs.  A map's
keys are judged row by row: a value of another type than text can't be a mark, and is null instead.  What has no schema, variants and JSON
texts, is walked for each value.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CharType, DataType, MapType, StringType, StructType, VarcharType, VariantType

from trailmark.functions.text import REDACTIONS, redacted

# Names of fields, without signs, that hold secrets or mail content.
SECRET_NAMES = ("accesstoken", "apikey", "authorization", "clientsecret", "credential", "credentials", "idtoken", "password", "refreshtoken", "secret", "token")
SECRET_ENDINGS = ("token", "secret", "apikey", "password")
SECRET_PART = "credential"
CONTENT_NAMES = ("bodyhtml", "bodytext", "emailbody", "emailbodyhtml", "emailbodytext", "htmlbody", "messagebody", "plainbody", "rawbody", "rawemailbody", "snippet")
SECRET, CONTENT = "[REDACTED]", "[REDACTED_EMAIL_CONTENT]"

_PATTERNS = [(re.compile(re.sub(r"\\k<(\w+)>", r"(?P=\1)", p.replace("(?<field>", "(?P<field>").replace("(?<quote>", "(?P<quote>").replace("(?<mark>", "(?P<mark>"))), re.sub(r"\$\{(\w+)\}", r"\\g<\1>", to)) for p, to in REDACTIONS]


def mark_of(name: str) -> str | None:
    """What a field of this name becomes, None if its value is looked at."""
    plain = re.sub("[^a-z0-9]", "", name.lower())
    if plain in SECRET_NAMES or plain.endswith(SECRET_ENDINGS) or SECRET_PART in plain:
        return SECRET
    return CONTENT if plain in CONTENT_NAMES else None


def _key_mark(key: Column) -> Column:
    plain = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    secret = plain.isin(*SECRET_NAMES) | plain.contains(SECRET_PART)
    for ending in SECRET_ENDINGS:
        secret = secret | plain.endswith(ending)
    return F.when(secret, SECRET).when(plain.isin(*CONTENT_NAMES), CONTENT)


def redacted_text(text: str) -> str:
    """``text.redacted`` of one text outside of Spark's expressions."""
    for pattern, to in _PATTERNS:
        text = pattern.sub(to, text)
    return text


def _walked(value):
    if isinstance(value, dict):
        return {k: mark_of(k) or _walked(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_walked(v) for v in value]
    return redacted_text(value) if isinstance(value, str) else value


def redacted_json(text: Column) -> Column:
    """A JSON text, redacted at any depth; one that can't be read is redacted as plain text."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return json.dumps(_walked(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                return redacted_text(t)

        return s.map(one)

    return run(text)


def _is_text(kind: DataType) -> bool:
    return isinstance(kind, (StringType, CharType, VarcharType))


def _value(c: Column, kind: DataType) -> Column:
    if _is_text(kind):
        return redacted(c)
    if isinstance(kind, VariantType):
        return F.try_parse_json(redacted_json(F.to_json(c)))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _value(x, kind.elementType)) if _holds_text(kind.elementType) else c
    if isinstance(kind, StructType):
        if not _holds_text(kind):
            return c
        fields = F.struct(*[_field(f.name, c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), fields)
    if isinstance(kind, MapType):
        if not _is_text(kind.keyType):
            return F.transform_values(c, lambda _, v: _value(v, kind.valueType)) if _holds_text(kind.valueType) else c
        if _is_text(kind.valueType):
            return F.transform_values(c, lambda k, v: F.coalesce(_key_mark(k), _value(v, kind.valueType)))
        return F.transform_values(c, lambda k, v: F.when(_key_mark(k).isNull(), _value(v, kind.valueType)))
    return c


def _field(name: str, c: Column, kind: DataType) -> Column:
    mark = mark_of(name)
    return F.lit(mark) if mark else _value(c, kind)


def _holds_text(kind: DataType) -> bool:
    """Is there anything in a value of this type to look at?"""
    if isinstance(kind, StructType):
        return any(mark_of(f.name) or _holds_text(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _holds_text(kind.elementType)
    return _is_text(kind) or isinstance(kind, (MapType, VariantType))


def redacted_records(df: DataFrame) -> DataFrame:
    """All columns of a table, redacted by their names and types; columns without texts stay as they are."""
    return df.select(*[_field(f.name, F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
