"""Text functions: parameter tables, properties, and the expressions against plain Python."""

import base64
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from trailmark.functions import text
from trailmark.sources import mail

COMPANIES = {
    "  OpenAI, Inc.  ": "openai", "ACME Corporation": "acme", "The Example Group LLC": "example group", "Johnson & Johnson": "johnson and johnson", "Johnson and Johnson": "johnson and johnson",
    "jobs.example.com": "example", "www.data.ai": "data", "Acme---Labs": "acme labs", "Example L.L.C.": "example", "Example S.A.R.L.": "example", "Example P.T.E.": "example",
    "Example.com, Inc.": "example", "jobs.example.com LLC": "example", "jobs&#46;example&#46;com": "example", " \t\n ": "", "Co": "co", "Müller & Co. KG": "muller and co kg",
}
ROLES = {
    "  Senior SWE II - Backend (Remote)  ": "back end software engineer", "Software Engineer, Backend": "back end software engineer", "Sr. Software Developer - back-end": "back end software engineer",
    "Data Scientist III": "data scientist", "Staff Product Manager - Growth": "growth product manager", "Machine-Learning Engineer": "machine learning engineer", "ML Engineer": "machine learning engineer",
    "Machine Learning Software Engineer": "machine learning engineer", "Software Engineer - NYC": "software engineer", "Software Engineer - New York, NY": "software engineer",
    "Software Engineer - WFH": "software engineer", "Software Engineer - Work From Home": "software engineer", "Software Engineer - Remote Eligible": "software engineer",
    "Software Engineer - In Office": "software engineer", "Software Engineer - United Kingdom": "software engineer", "Backend Engineer": "back end software engineer",
    "Frontend Engineer": "front end software engineer", "C++ Software Engineer": "c plus plus software engineer", "C# Software Engineer": "c sharp software engineer",
    "C Software Engineer": "c software engineer", "Software Engineer IC4": "software engineer", "Software Engineer E5": "software engineer", "Software Engineer M2": "software engineer",
    "Software Engineer L10": "software engineer", "Software Engineer Level 10": "software engineer", "": None, "   ": None, "---": None, None: None,
}


@pytest.mark.parametrize("name", COMPANIES)
def test_company_keys(name):
    assert text.company_key(name) == COMPANIES[name]


def test_role_keys(spark):
    more = {"data_engineer": "data engineer", "C C++ Developer": "c plus plus developer", "Développeur Full-Stack Engineer": "developpeur full stack software engineer", "Engineer Engineer": "engineer", "VP of Sales & Ops": "vp of sales and ops"}
    want = ROLES | more
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.normalized_role("t")).collect()} == want


def test_keys_as_columns(spark):
    got = spark.createDataFrame([("Acme Inc.", "SRE"), (None, None)], "c string, r string").select(text.normalized_company("c"), text.normalized_role("r")).collect()
    assert [tuple(r) for r in got] == [("acme", "site reliability engineer"), (None, None)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>One</p><p>Two <b>three</b>.</p>", "One\nTwo three."),
        ("<head><title>no</title></head><div>a&nbsp;b<br>c</div>", "a b\nc"),
        ("<script>x</script><style>y</style>kept", "kept"),
        ("<ul><li>a</li><li>b</li></ul>", "a\nb"),
        ("<i>left</i><i>right</i>", "left right"),
        ("", ""),
        (None, None),
    ],
)
def test_pages(page, want):
    assert text.html_to_text(page) == want


def plain_chunks(body, most, overlap):
    """The same packing, said with lists."""
    paragraphs = [p.strip() for p in body.replace("\r\n", "\n").replace("\r", "\n").split("\n\n")]
    out, queue = [], [p for p in paragraphs if p]
    held = None
    while queue or held is not None:
        p = queue.pop(0) if queue else None
        if p is not None and held is not None and len(p) <= most and len(held) + 2 + len(p) > most:
            out.append(held)
            p, held = (held[len(held) - min(len(held), overlap) :] + "\n\n" if overlap else "") + p, None
        if p is None or len(p) > most:
            out += [held] if held is not None else []
            held = None
            n = 0
            while p is not None and (n == 0 or n + overlap < len(p)):
                out += [w] if (w := p[n : n + most].strip()) else []
                n += most - overlap
        else:
            held = p if held is None else f"{held}\n\n{p}"
    return out


def test_chunks(spark):
    rng = random.Random(3)
    bodies = ["".join(rng.choice("ab  \n\n\n") for _ in range(rng.randrange(300))) for _ in range(120)] + ["", "x" * 500, "a\r\n\r\nb\r\rc", "\u2003 é \n\n" * 9]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    for most, overlap in ((5, 0), (20, 4), (60, 19)):
        got = {r["i"]: r["c"] for r in df.select("i", text.chunks(F.col("b"), most, overlap).alias("c")).collect()}
        for i, body in enumerate(bodies):
            assert got[i] == plain_chunks(body, most, overlap), (body, most, overlap)
            assert all(0 < len(c) <= most for c in got[i]) and set("".join(body.split())) == set("".join("".join(got[i]).split()))
    a, b, c = "A" * 35, "B" * 35, "C" * 35
    one = spark.createDataFrame([(f"{a}\n\n{b}\n\n{c}",), (None,)], "b string").select(text.chunks(F.col("b"), 80, 8)).collect()
    assert [r[0] for r in one] == [[f"{a}\n\n{b}", f"{'B' * 8}\n\n{c}"], []]


def test_long_pages_take_linear_time():
    page = "<p>word</p>" * 60_000
    assert text.html_to_text(page).count("word") == 60_000


def test_excerpts(spark):
    long = "First filler sentence here. " * 10 + "The salary is negotiable for this position! " + "Last filler sentence. " * 5
    wide = "word " * 70 + "the salary " + "word " * 100
    cases = [
        (long, "What salary was mentioned?", "The salary is negotiable for this position!"),
        ("short   text", "anything", "short text"),
        (long, "zebra", " ".join(long.split())[:280]),
        (long, "", " ".join(long.split())[:280]),
        ("Salary. " * 50 + "Salary negotiable? ok", "salary, negotiable", "Salary negotiable?"),
        (None, "salary", None),
    ]
    for body, question, want in cases:
        assert spark.createDataFrame([(body,)], "b string").select(text.relevant_excerpt(F.col("b"), question)).first()[0] == want
    got = spark.createDataFrame([(wide,)], "b string").select(text.relevant_excerpt(F.col("b"), "salary")).first()[0]
    at = wide.index("salary") - 140
    assert got == f"... {wide[at : at + 280].strip()} ..."


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Authorization: Bearer abc.def", "Authorization: Bearer [REDACTED]"),
        ("api_key=abc123&x=1", "api_key=[REDACTED]&x=1"),
        ('{"password": "hunter2"}', '{"password": "[REDACTED]"}'),
        ("my-token = 'x'", "my-token = '[REDACTED]'"),
        ('{"body_text": "secret mail"}', '{"body_text": "[REDACTED_EMAIL_CONTENT]"}'),
        ("snippet: all of the rest", "snippet: [REDACTED_EMAIL_CONTENT]"),
        ("nothing to hide", "nothing to hide"),
    ],
)
def test_redaction(spark, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(text.redacted(F.col("t"))).first()[0] == want


def test_uuid5(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    names = [json.dumps({"a": i, "b": "é"}) for i in range(50)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(text.uuid5_hex(ns, F.col("n"))).collect()
    assert [r[0] for r in got] == [uuid.uuid5(uuid.UUID(ns), n).hex for n in names]


def test_ordinal_buckets(spark):
    import datetime as dt

    days = [dt.date(1, 1, 1), dt.date(1, 1, 30), dt.date(2024, 2, 29), dt.date(1998, 12, 31)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select(text.ordinal_bucket(F.col("d"))).collect()
    assert [r[0] for r in got] == [dt.date.fromordinal(max(1, d.toordinal() // 30 * 30)) for d in days]


def b64(t: str) -> str:
    return base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")


def test_mail_bodies(spark):
    part = lambda kind, t, **more: {"mimeType": kind, "body": {"data": b64(t)}, **more}
    payloads = [
        {"mimeType": "multipart/mixed", "parts": [part("text/html", "<p>html</p>"), part("text/plain", "one"), part("text/plain", "two"), part("text/plain", "file", filename="a.txt")]},
        {"mimeType": "multipart/mixed", "parts": [part("text/plain", " "), part("text/html; charset=utf-8", "<p>html</p>")]},
        {"mimeType": "image/png"},
        {"mimeType": "text/plain", "body": {"data": "/"}},
        {"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(b"\xff\xfe").decode()}},
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(5, None), (6, "not json")], "i int, p string")
    got = {r["i"]: tuple(r["b"]) for r in df.select("i", mail.retained_body(F.col("p"), 100).alias("b")).collect()}
    assert got[0] == ("one\n\ntwo", "plain", False, None) and got[1] == ("html", "html_converted", False, None)
    assert got[2][3] == "unsupported_content" and got[5][3] == "empty" and {got[i][3] for i in (3, 4, 6)} == {"invalid_body_data"}


def test_cut_bodies(spark):
    data = [("aé" * 5, n) for n in range(1, 16)]
    df = spark.createDataFrame([(b64(t), n) for t, n in data], "d string, n int")
    for t, n in data:
        assert mail.decode_body(b64(t), n)[0] == t.encode()[:n].decode("utf-8", "ignore")
    got = df.where("n = 5").select(mail.decoded(F.col("d"), 5)).first()[0]
    assert got == ("aé" * 5).encode()[:5].decode("utf-8", "ignore")


def test_headers(spark):
    df = spark.createDataFrame([('"A" <a@x.example>, b@x.example, A <A@x.example>', "Mon, 02 Jan 2023 10:00:00 +0100"), (None, "nonsense")], "t string, d string")
    got = df.select(mail.addresses(F.col("t")), mail.sent_at(F.col("d"))).collect()
    assert got[0][0] == ["a@x.example", "b@x.example"] and str(got[0][1]) == "2023-01-02 09:00:00" and got[1][0] == [] and got[1][1] is None
