"""Records of any nesting against a plain walk."""

import json
import random

from pyspark.sql import functions as F

from trailmark.functions import redaction

RECORD = "id long, note string, `API-Key` struct<a: int>, snippet array<string>, tags array<string>, deep struct<User: struct<name: string, `my.token`: long, more: array<struct<text: string, Access_Token: string>>>, headers: map<string, string>>, by_number map<int, string>, nested map<string, struct<said: string, password: string>>, plain array<array<int>>, at timestamp_ntz, raw binary"


def walked(value, name=None):
    if name is not None and redaction.mark_of(name):
        return redaction.mark_of(name)
    if isinstance(value, dict):
        return {k: walked(v, k if isinstance(k, str) else None) for k, v in value.items()}
    if isinstance(value, list):
        return [walked(v) for v in value]
    return redaction.redacted_text(value) if isinstance(value, str) else value


def test_records_of_any_nesting(spark):
    r = random.Random(1)
    say = lambda: r.choice(["plain", "password=hunter2&x=1", "Authorization: Bearer abc", 'api_key: "k"', "snippet: all of it", "", None])
    rows = []
    for i in range(60):
        more = [{"text": say(), "Access_Token": say()} for _ in range(r.randint(0, 3))]
        user = r.choice([None, {"name": say(), "my.token": r.choice([None, 7]), "more": r.choice([None, more])}])
        rows.append({
            "id": i, "note": say(), "API-Key": r.choice([None, {"a": 1}]), "snippet": ["x"], "tags": [say(), say()], "deep": r.choice([None, {"User": user, "headers": r.choice([None, {"Authorization": "x", "Accept": say() or "", "X-Api-Key": None}])}]),
            "by_number": {1: say(), 2: "token=abc"}, "nested": {"a": {"said": say(), "password": "p"}, "client.secret": {"said": "x", "password": "y"}}, "plain": [[1], []], "at": None, "raw": None,
        })
    df = spark.createDataFrame(rows, RECORD)
    for row, got in zip(rows, redaction.redacted_records(df).orderBy("id").collect(), strict=True):
        want = walked(row)
        want["nested"]["client.secret"] = None  # no text can stand where a struct is
        assert got.asDict(recursive=True) == want


def test_variants_and_json_texts(spark):
    value = {"a": [1, {"id_token": {"x": 1}, "note": "secret=s3", "list": [["bearer abc"]]}], "Body-Text": "long", "n": None, "é": "ü"}
    df = spark.createDataFrame([(1, json.dumps(value)), (2, None), (3, "password: x and no json"), (4, "[" * 2000 + "]" * 2000), (5, '"token=abc"')], "id long, said string")
    got = {r["id"]: r["said"] for r in df.select("id", redaction.redacted_json(F.col("said")).alias("said")).collect()}
    assert json.loads(got[1]) == walked(value) and got[2] is None and got[3] == "password: [REDACTED] and no json" and got[5] == '"token=[REDACTED]"'
    variants = redaction.redacted_records(df.where("id IN (1, 2)").select("id", F.try_parse_json("said").alias("v"))).select("id", F.to_json("v").alias("v")).collect()
    assert json.loads({r["id"]: r["v"] for r in variants}[1]) == walked(value)


def test_texts_are_redacted_alike_in_both_ways(spark):
    said = ["password=hunter2&x=1", "'token' : 'a b' c", "API_KEY = \"q\" z", "Bearer a,b", "body_text: 'x' y", "html_body = rest of it", "secret: x}, y", "authorization : bearer q;r", "nothing", "my-secret=1 token:2"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "id long, note string")
    got = [r["note"] for r in redaction.redacted_records(df).orderBy("id").collect()]
    assert got == [redaction.redacted_text(s) for s in said]
