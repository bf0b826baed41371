"""Mail payloads: header values, bodies of nested parts, base64url text."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailmark.functions.text import html_to_text, page_text

BODY = StructType().add("body_text", "string").add("source", "string").add("truncated", "boolean").add("problem", "string")


def decode_body(data: str, most: int | None) -> tuple[str, bool]:
    """Text of base64url data, cut to ``most`` bytes at a character's end, and whether it was cut.  ValueError if it isn't UTF-8."""
    try:
        raw = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))
    except (binascii.Error, UnicodeEncodeError) as e:
        raise ValueError("the body isn't base64url") from e
    text = raw.decode("utf-8")
    if most is None or len(raw) <= most:
        return text, False
    return raw[:most].decode("utf-8", "ignore"), True


def _parts(payload: dict) -> Iterator[dict]:
    todo = [payload]
    while todo:
        part = todo.pop()
        yield part
        todo += reversed(part.get("parts") or [])


def body_of(payload: dict | None, most: int | None = None) -> tuple[str | None, str | None, bool | None, str | None]:
    """(text, source, truncated, problem): plain parts joined by blank lines, or converted HTML where those are empty."""
    if payload is None:
        return None, None, None, "empty"
    found: dict[str, list[tuple[str, bool]]] = {"text/plain": [], "text/html": []}
    seen = False
    for part in _parts(payload):
        kind = (part.get("mimeType") or "").split(";")[0].strip().lower()
        body = part.get("body") or {}
        if part.get("filename") or body.get("attachmentId") is not None or kind not in found:
            continue
        seen = True
        if body.get("data") is not None:
            found[kind].append(decode_body(body["data"], most))
    empty = None
    for kind, source in (("text/plain", "plain"), ("text/html", "html_converted")):
        if found[kind]:
            texts = [html_to_text(t) if kind == "text/html" else t for t, _ in found[kind]]
            text = "\n\n".join(t.strip() for t in texts if t.strip())
            one = (text, source, any(c for _, c in found[kind]), None)
            if text:
                return one
            empty = empty or one
    return empty or (None, None, None, "empty" if seen else "unsupported_content")


def retained_body(payload_json: Column, most: int | None = None) -> Column:
    """struct(body_text, source, truncated, problem) of a payload's JSON; a bad row is a problem, never a failed task."""

    @F.pandas_udf(BODY)
    def run(s: pd.Series) -> pd.DataFrame:
        def one(text):
            try:
                return body_of(json.loads(text) if text is not None else None, most)
            except (ValueError, AttributeError, TypeError):
                return None, None, None, "invalid_body_data"

        return pd.DataFrame([one(t) for t in s], columns=BODY.names).astype({"truncated": "boolean"})

    return run(payload_json)


def bodies_and_failures(payloads: DataFrame, payload: str = "payload", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What could be read, and what could not with its reason (S08-S09): fetched payloads are decoded row by row in parallel, and a
    bad one goes to the side table instead of failing its batch."""
    keys = [c for c in payloads.columns if c != payload]
    read = payloads.select(*keys, retained_body(F.col(payload), most).alias("b")).select(*keys, "b.*")
    good = F.col("problem").isNull()
    return read.where(good).drop("problem"), read.where(~good).select(*keys, F.col("problem").alias("reason"))


def is_html(body: Column) -> Column:
    """Whether a body labelled plain is HTML after all (X25): it has a tag that ends, and no other text before it."""
    return body.rlike(r"(?is)^\s*(?:<!doctype html|<(?:html|head|body|div|p|table|span|br|a)\b[^>]*>)")


def plain_bodies(bodies: DataFrame) -> DataFrame:
    """Bodies with HTML turned into text; source says which."""
    html = F.coalesce(is_html(F.col("body_text")), F.lit(False))
    marked = bodies.withColumn("html", F.when(html, F.col("body_text")))
    return marked.withColumns({"body_text": F.when(html, page_text("html")).otherwise(F.col("body_text")), "source": F.when(html, "html_converted").otherwise("plain")}).drop("html")


def addresses(header: Column) -> Column:
    """The distinct addresses of a To or From header, in order."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: list(dict.fromkeys(a.strip().lower() for _, a in getaddresses([h or ""]) if "@" in a)))

    return run(header)


def sent_at(header: Column) -> Column:
    """The UTC time of a Date header; null where it can't be read."""

    def utc(h):
        try:
            at = pd.Timestamp(parsedate_to_datetime(h))
        except (TypeError, ValueError, IndexError):
            return None
        return at.tz_convert("UTC").tz_localize(None) if at.tzinfo else at

    @F.pandas_udf("timestamp_ntz")
    def run(s: pd.Series) -> pd.Series:
        return pd.to_datetime(s.map(utc))

    return run(header)


def decoded(data: Column, most: int | None = None) -> Column:
    """base64url text in built-in expressions, cut to ``most`` bytes if given; a character cut in half at the end is dropped."""
    raw = F.unbase64(F.translate(data, "-_", "+/"))
    if most is None:
        return F.decode(raw, "UTF-8")
    inside = lambda n: F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")  # noqa: E731  the byte after the first n goes on with a character
    keep = F.coalesce(*[F.when(~inside(n), n) for n in range(most, max(-1, most - 4), -1)], F.lit(0))
    return F.decode(F.when(F.length(raw) > most, F.substring(raw, F.lit(1), keep)).otherwise(raw), "UTF-8")
