"""Kept indexes and the automaton of names against scans and regular expressions."""

import random
import re

from pyspark.sql import functions as F

from trailmark.operators import names, retrieval, text_index
from trailmark.operators.text_index import TextIndex
from trailmark.operators.vector_index import VectorIndex

CHUNK = "email_id string, chunk_index int, content string"


def test_text_index_equals_a_scan(spark, tmp_path):
    r = random.Random(3)
    alphabet = "abcA é日🙂.İß"
    say = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    chunks = [(f"m{i // 2}", i % 2, say(r.choice([0, 1, 2, 3, 40]))) for i in range(120)]
    df = spark.createDataFrame(chunks, CHUNK)
    index = TextIndex(spark, str(tmp_path / "index"), buckets=3)
    index.update(df, df.select("email_id").distinct().withColumn("action", F.lit("embed")))
    changed = {f"m{i}": r.choice(["delete", "embed", "keep"]) for i in range(60)}
    chunks = [(m, i, say(20) if changed[m] == "embed" else c) for m, i, c in chunks if changed[m] != "delete"]
    df = spark.createDataFrame(chunks, CHUNK)
    index.update(df, spark.createDataFrame(list(changed.items()), "email_id string, action string"))
    terms = sorted({say(n) for n in (1, 1, 2, 2, 3, 3, 4, 5) for _ in range(12)} | {c[3:9] for _, _, c in chunks if len(c) > 9} | {"zzz", "A", "İ"})
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "term_id long, term string")
    scan = df.join(asked, F.lower("content").contains(F.lower("term"))).select("term_id", "email_id", "chunk_index")
    for searched in (index, index.compacted(str(tmp_path / "compact"), df)):
        got = {(x["term_id"], x["email_id"], x["chunk_index"]) for x in searched.search(df, asked).collect()}
        assert got == {tuple(x) for x in scan.collect()} and len(got) > 100
    few = index.candidates(asked.where(F.char_length("term") >= 3))
    assert few.count() <= 3 * max(1, scan.join(asked.where(F.char_length("term") >= 3), "term_id").count())
    one = index.candidates(asked.where("term_id = 0"))._jdf.queryExecution().toString()
    assert "In(gram" in one or "EqualTo(gram" in one  # reaches the scan


def test_vector_index_equals_a_scan(spark, tmp_path):
    r = random.Random(5)
    point = lambda spread, at: [float(round(at + r.gauss(0, spread), 2)) for _ in range(8)]
    rows = [(f"m{i // 3}", i % 3, point(0.3, r.choice([0, 5, 9, 30]))) for i in range(600)]
    rows += [(f"t{i}", 0, rows[0][2]) for i in range(6)]  # ties
    shape = "email_id string, chunk_index int, embedding array<float>"
    df = spark.createDataFrame(rows, shape)
    index = VectorIndex.created(df, str(tmp_path / "index"), cells=12)
    actions = {f"m{i}": r.choice(["delete", "embed", "keep"]) for i in range(200)}
    rows = [(m, i, point(0.3, 5) if actions.get(m) == "embed" else v) for m, i, v in rows if actions.get(m) != "delete"]
    df = spark.createDataFrame(rows, shape)
    index.update(df, spark.createDataFrame(list(actions.items()), "email_id string, action string"))
    queries = [(i, point(0.5, r.choice([0, 5, 9, 30, 100]))) for i in range(25)] + [(99, rows[-1][2])]
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    for k in (1, 4, 1000):
        got = {}
        for x in index.nearest(asked, k).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], x["email_id"], x["chunk_index"]))
        for q, v in queries[:: 1 if k < 100 else 9]:
            want = retrieval.nearest(df, v, k).select("email_id", "chunk_index").collect()
            assert sorted(got[q]) == [(n + 1, *w) for n, w in enumerate(want)]
    cut = index.nearest(asked, 4, max_distance=1.0)
    assert cut.where("distance > 1.0").count() == 0 and 0 < cut.count() < 4 * len(queries)
    assert index.nearest(asked.limit(0), 3).collect() == []
    plan = index.rows_of([0, 1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan  # only the files of these cells


def test_names_are_those_of_the_regular_expression(spark):
    r = random.Random(2)
    parts = ["the", "The", "acme", "Inc.", "co", "c++", "é", "Äpfel", "x", "&", "a-b", "#1", "日本"]
    known = sorted({" ".join(r.sample(parts, r.randint(1, 3))) for _ in range(60)} | {"the", ".", "THE ACME"})
    texts = [" ".join(r.choice([*parts, "acmes", "_x", "xx", ",", "THE", "ÄPFEL"]) for _ in range(12)) for _ in range(80)] + ["", None, "the", "theacme"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, said string")
    companies = spark.createDataFrame([(n,) for n in [*known, "  ", None, known[0]]], "company string")
    want = {(i, n) for i, t in enumerate(texts) if t for n in known if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", t, re.IGNORECASE)}
    for most_chars in (names.MOST_CHARS, 120):
        assert {tuple(x) for x in names.mentioned_names(df, companies, "id", "said", most_chars=most_chars).collect()} == want
    assert names.mentioned_names(df, companies.limit(0), "id", "said").collect() == []


def test_many_names_that_begin_alike(spark):
    companies = spark.range(100_000).select(F.concat(F.lit("the company "), F.col("id").cast("string")).alias("company"))
    texts = spark.range(2_000).select("id", F.concat(F.lit("the the THE Company "), F.col("id").cast("string"), F.lit(" and the company 7, the company 77777777")).alias("said"))
    got = names.mentioned_names(texts, companies, "id", "said")
    assert got.count() == 2_000 * 2 - 1


def test_many_vectors_without_cells_of_their_own_meet_in_groups(spark, tmp_path, monkeypatch):
    from trailmark.operators import vector_index

    monkeypatch.setattr(vector_index, "GROUP_QUERIES", 40)
    monkeypatch.setattr(vector_index, "PART_ROWS", 100)
    r = random.Random(8)
    rows = [(f"m{i:03}", 0, [float(r.randint(-3, 3)) for _ in range(6)]) for i in range(300)]  # small whole numbers: many ties
    df = spark.createDataFrame(rows, "email_id string, chunk_index int, embedding array<float>")
    index = VectorIndex.created(df, str(tmp_path / "index"), cells=9)
    asked = spark.createDataFrame([(i, v) for i, (_, _, v) in enumerate(rows[::2])], "query_id long, vector array<double>")
    got = {}
    for x in index.nearest(asked, 5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["email_id"]))
    assert len(got) == 150
    for i, (_, _, q) in enumerate(rows[::2]):
        want = sorted((sum((a - b) ** 2 for a, b in zip(q, v, strict=True)), m) for m, _, v in rows)[:5]
        assert sorted(got[i]) == [(n + 1, m) for n, (_, m) in enumerate(want)]


def test_first_places_carry_no_texts(spark, tmp_path):
    rows = [("a", 0, "One token here"), ("a", 1, "TOKEN and token"), ("b", 0, "nothing"), ("b", 1, "a to-do"), ("c", 0, None)]
    df = spark.createDataFrame(rows, CHUNK)
    index = TextIndex(spark, str(tmp_path / "index"), buckets=2)
    index.update(df, df.select("email_id").distinct().withColumn("action", F.lit("embed")))
    asked = spark.createDataFrame([(1, "token"), (2, "to"), (3, "T"), (4, "absent")], "term_id long, term string")
    places = index.first_places(df, asked)
    assert {tuple(x) for x in places.collect()} == {(1, "a", 0), (2, "a", 0), (2, "b", 1), (3, "a", 0), (3, "b", 0)}
    assert {(x["term_id"], x["email_id"], x["content"]) for x in index.first_mentions(df, asked).collect()} >= {(1, "a", "One token here"), (2, "b", "a to-do")}


def _moved(node) -> int:
    """Rows that the shuffles of an executed plan wrote."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
        return _moved(node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan())
    own = node.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
    return own + sum(_moved(node.children().apply(i)) for i in range(node.children().size()))


def test_first_places_of_many_terms(spark, tmp_path, monkeypatch):
    r = random.Random(11)
    words = [f"{a}{b}{c}{d}" for a in "pq" for b in "aeiou" for c in "xyzé" for d in "stu"]
    rows = [(f"m{i // 2}", i % 2, " ".join(r.sample(words, 90)).upper()) for i in range(160)]
    df = spark.createDataFrame(rows, CHUNK)
    index = TextIndex(spark, str(tmp_path / "index"), buckets=2)
    index.update(df, df.select("email_id").distinct().withColumn("action", F.lit("embed")))
    terms = [w[i : i + n] for w in words for i, n in ((0, 4), (0, 3), (1, 3), (0, 2), (3, 1))] + [f"{a} {b}" for a in words[:40] for b in words[-40:]]
    terms = [(i, t) for i, t in enumerate(dict.fromkeys(terms))] + [(0, "qu"), (1, "absent")]  # one id may have two terms
    asked = spark.createDataFrame(terms, "term_id long, term string")
    want = {}
    for m, c, said in rows:
        for i, t in terms:
            if t in said.lower():
                want[i, m] = min(c, want.get((i, m), c))
    for most in (1 << 17, 300):  # terms in one part and in several
        monkeypatch.setattr(text_index, "MOST_TERMS", most)
        assert {((x["term_id"], x["email_id"]), x["chunk_index"]) for x in index.first_places(df, asked).collect()} == set(want.items())


def test_pairs_of_terms_and_chunks_are_not_shuffled(spark, tmp_path):
    r = random.Random(12)
    passage = "".join(r.choice("abcdefgh ") for _ in range(150))
    df = spark.createDataFrame([(f"m{i}", 0, f"{i} {passage}") for i in range(80)], CHUNK)
    index = TextIndex(spark, str(tmp_path / "index"), buckets=2)
    index.update(df, df.select("email_id").distinct().withColumn("action", F.lit("embed")))
    asked = [(i, t) for i, t in enumerate(sorted({passage[i : i + n] for n in range(4, 16) for i in range(150 - n)}))]
    places = index.first_places(df, spark.createDataFrame(asked, "term_id long, term string"))
    pairs = len(places.collect())
    assert pairs == 80 * len(asked) > 100_000
    assert _moved(places._jdf.queryExecution().executedPlan()) < pairs // 3


def test_pieces_of_a_text(monkeypatch):
    monkeypatch.setattr(text_index, "FEW", 3)
    monkeypatch.setattr(text_index, "WINDOW", 4)
    r = random.Random(2)
    for size in (0, 1, 2, 3, 9, 40):
        said = bytes(r.choice(b"abc") for _ in range(size))
        for n in (1, 2, 3, 5):
            asked = [bytes(r.choice(b"abc") for _ in range(n)) for _ in range(r.choice([2, 30]))]
            assert text_index._pieces(said, n, asked) == {t for t in asked if t in said}
        asked = [bytes(r.choice(b"abc\x00\xff") for _ in range(n)) for n in (1, 2, 3, 7, 8, 9) for _ in range(30)] + [said[i : i + n] for n in (2, 6, 7, 8, 10) for i in range(size - n)]
        asked += asked[:5]
        terms = text_index._Terms(asked, ["g" if t[:1] == b"a" else None for t in asked])
        rows = lambda grams: sorted(terms.rows_of(terms.held(said, grams)).tolist())
        assert rows({None, "g", "h"}) == [i for i, t in enumerate(asked) if t in said]
        assert rows({"g"}) == [i for i, t in enumerate(asked) if t in said and t[:1] == b"a"]
