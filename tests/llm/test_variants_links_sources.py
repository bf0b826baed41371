"""Spelling variants, linked embeddings and source divergence against brute force and on awkward rows."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.llm import divergence, embed_dedup, spelling
from trailmark.llm.hnsw import Graph
from trailmark.llm.queries import ORACLE_SQL, QUERIES

lower = lambda t: t.encode().lower().decode()


def by_sql(small, name, **tables):
    """The query's SQL in DuckDB, over the folder's tables or the given frames instead."""
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        if t in tables:
            con.register(t, tables[t])
        else:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con.execute(ORACLE_SQL[name]).fetchall(), [c[0] for c in con.description]


@pytest.mark.parametrize("name", ["op11_spelling", "op12_embedding_duplicates", "op13_divergence"])
def test_queries_equal_their_sql(spark, small, name):
    got = QUERIES[name](spark, small)
    rows, columns = by_sql(small, name)
    assert got.columns == columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))


# -- spelling ------------------------------------------------------------------------------------------------------------------


def words_of(docs, every=97):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def is_near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def grouped(words):
    near = {w: [x for x in words if x != w and is_near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    root = {}
    for w in words:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def spelt_texts(seed, n, letters):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list(letters), rng.integers(5, 12))) for _ in range(25)]
    texts = []
    for i in range(n):
        words = []
        for _ in range(40):
            w = base[int(len(base) * rng.random() ** 3)]
            if rng.random() < 0.3:
                at = int(rng.integers(0, len(w) + 1))
                w = w[:at] + str(rng.choice(list(letters))) * int(rng.integers(0, 2)) + w[at + int(rng.integers(0, 2)) :]
            words.append(w.title() if rng.random() < 0.2 else w)
        texts.append((i if i % 7 else None, " ".join(words)))
    return texts


@pytest.mark.parametrize("crowd", [256, 2])
@pytest.mark.parametrize("letters", ["ab", "aébÉç÷"])
def test_spelling_groups(spark, letters, crowd):
    docs = spelt_texts(len(letters), 60, letters)
    got = spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"), crowd=crowd, every=5)
    assert {tuple(r) for r in got.collect()} == grouped(words_of(docs, every=5))
    assert got.count() == len(words_of(docs, every=5))


def test_words_of_one_segment_make_no_products(spark):
    """4000 words that share a first half, two of which differ in the last character."""
    rng = np.random.default_rng(0)
    words = {"same" * 3 + "".join(rng.choice(list("abcdefghijklmnop"), 12)) for _ in range(4000)} | {"same" * 3 + "zzzzzzzzzzz" + c for c in "xyz"}
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = {(r["word"][-1], r["near"][-1]) for r in spelling.near_words(table, crowd=16).collect() if "zzzz" in r["word"]}
    assert got == {(a, b) for a in "xyz" for b in "xyz" if a != b}
    cut = spelling._halves(table.select("word", "n", F.lit(False).alias("longer"), F.lit(0).alias("at"), F.char_length("word").alias("size")))
    assert cut.groupBy("key").count().agg(F.max("count")).first()[0] >= 4000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé", min_size=1, max_size=9), st.integers(0, 9), st.sampled_from("abé"), st.sampled_from(["in", "out", "swap"]))
def test_near_words_agree_in_a_segment(word, at, letter, kind):
    at = at % len(word)
    other = {"in": word[:at] + letter + word[at:], "out": word[:at] + word[at + 1 :], "swap": word[:at] + letter + word[at + 1 :]}[kind]
    if not other or other == word:
        return
    a, b = sorted((word, other), key=len)
    half, more = len(a) // 2, len(b) - len(a)
    assert a[:half] == b[:half] or a[half:] == b[half + more :]


# -- embeddings ----------------------------------------------------------------------------------------------------------------


def linked(rows, least=0.9):
    """vec_id, n_links, component_id, kept by comparing all pairs."""
    sound = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dims = max((len(rows[i][1]) for i in sound), default=1)
    u = np.array([list(rows[i][1]) + [0.0] * (dims - len(rows[i][1])) for i in sound], float).reshape(len(sound), dims)
    u /= np.abs(u).max(axis=1, keepdims=True, initial=0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    label = np.array([rows[i][0] for i in sound])
    component = label.copy()
    while True:
        new = np.array([min([component[i], *component[near[i]]]) for i in range(len(sound))], dtype=component.dtype)
        if (new == component).all():
            break
        component = new
    out = [(k, 0, k, True) for k, _ in rows]
    for j, i in enumerate(sound):
        out[i] = (rows[i][0], int(near[j].sum()), int(component[j]), bool(rows[i][0] == component[j]))
    return sorted(out, key=repr)


def crowd(rng, n, dims, noise):
    x = rng.standard_normal(dims)
    return x / np.linalg.norm(x) + noise * rng.standard_normal((n, dims)) / dims**0.5


def planted(seed=3, dims=24):
    """Crowds of near copies, chains of links, crowds about as wide as the threshold, and vectors of their own."""
    rng = np.random.default_rng(seed)
    parts = [crowd(rng, 300, dims, 0.1), crowd(rng, 200, dims, 0.33), crowd(rng, 60, dims, 0.5), rng.standard_normal((500, dims)), np.repeat(rng.standard_normal((3, dims)), 20, axis=0)]
    a, b = np.linalg.qr(rng.standard_normal((dims, 2)))[0].T
    parts.append(np.array([np.cos(t) * a + np.sin(t) * b for t in np.arange(12) * 0.4]))
    v = np.concatenate(parts)
    ids = rng.permutation(len(v)) * 7 + 1
    return [(int(i), [float(x) for x in row]) for i, row in zip(ids, v, strict=True)]


@pytest.mark.parametrize(("shard_rows", "query_rows"), [(1 << 15, 1 << 13), (150, 400)])
def test_linked_components(spark, shard_rows, query_rows):
    rows = planted()
    got = embed_dedup.linked_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=shard_rows, query_rows=query_rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == linked(rows)


def test_graphs_are_sent_in_pieces_to_a_bounded_number_of_parts(spark):
    rows = planted()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    numbered, _ = embed_dedup._sharded(table, 150)
    built = embed_dedup._graphs(numbered.where("sound"), 0.9, 0.99, 4096)
    assert built.where("piece IS NOT NULL").agg(F.max(F.length("graph"))).first()[0] == 4096
    got = embed_dedup.linked_components(table, shard_rows=150, query_rows=50, most_parts=3, piece_bytes=4096)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == linked(rows)


def test_wide_beams_are_searched_for_fewer_rows_at_a_time():
    graph, met = Graph.__new__(Graph), []
    graph.ef, graph.angle, graph.radius, graph.node = 1 << 15, 0.45, np.zeros(1 << 15), np.arange(1 << 15)
    graph.unit = np.zeros((1 << 15, 2))
    graph._descend = lambda q, ef: met.append(len(q) * ef) or {0: (np.full((len(q), 1), -1), np.full((len(q), 1), -np.inf, np.float32))}
    graph.within(np.ones((600, 2)))
    assert max(met) <= 1 << 21


def test_awkward_embeddings(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(7, [1.0, 1.0]), (8, [2.0, 2.0, 0.0]), (8, [2.0, 2.0, 0.0]), (9, [-1.0, -1.0]), (10, [1e300, 1e300]), (11, [1e-300, 1e-300]), (12, [0.0, 0.0, 5.0])]
    clash = {c: F.lit("x") for c in ("row", "shard", "v", "graph", "leader", "part", "root", "node", "links")}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(clash)
    for shard_rows in (1 << 15, 2):
        assert sorted((tuple(r) for r in embed_dedup.linked_components(table, shard_rows=shard_rows).collect()), key=repr) == linked(rows)
    assert embed_dedup.linked_components(table.limit(0)).collect() == []


def test_graphs_find_what_comparing_finds():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.standard_normal((4000, 32)), crowd(rng, 1500, 32, 0.2), *[crowd(rng, 12, 32, 0.35) for _ in range(60)]])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    u = u[rng.permutation(len(u))]
    graph = Graph(np.arange(len(u)), u, 0.9)
    graph.audit(0.99)
    counts, _, _ = Graph.loaded(graph.dumped()).linked(np.arange(len(u)), u)
    truth = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert (counts <= truth).all() and counts.sum() >= 0.99 * truth.sum()
    assert graph.recall >= 0.99 and len(graph.node) < len(u) - 1000  # the crowd is a few nodes


def test_beams_are_widened_until_the_audit_passes():
    rng = np.random.default_rng(6)
    u = rng.standard_normal((3000, 128))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    graph = Graph(np.arange(len(u)), u, 0.5, degree=4, beam=4)
    graph.ef = 1
    graph.audit(0.95)
    assert graph.ef > 1 and graph.recall >= 0.95


# -- sources -------------------------------------------------------------------------------------------------------------------


def diverging(docs, least=30, most=50):
    docs = [(x or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))) for x, s, t in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        held = Counter(t for x, _, ts in docs if x == lang for t in set(ts))
        kept = sorted((t for t, n in held.items() if n >= least), key=str.encode)
        sources = {s: Counter(t for x, y, ts in docs if x == lang and y == s for t in ts if t in kept) for s in {d[1] for d in docs if d[0] == lang}}
        all_of = sum(sources.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        shares, q = {s: p(c) for s, c in sources.items()}, p(all_of)
        for s in sources:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(shares[s][t] - q[t], t) for t in kept if sources[s][t] and shares[s][t] > q[t]]
            for part, values, rows in (("pair", pairs, None), ("term", terms, most)):
                for i, (v, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))[:rows]):
                    out.add((lang, s, part, item, v, i + 1))
    return out


def test_divergence(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"{a}{b}" for a in ("Wort", "mot", "é", "x") for b in "abcdefgh"]
    docs = [(str(rng.choice(["en", "de", ""])), str(rng.choice(["a", "b", "c", ""])), " ".join(vocabulary[int(len(vocabulary) * rng.random() ** 2)] for _ in range(30))) for _ in range(300)]
    docs += [("en", "only", "12 345 !"), ("fr", "a", "un"), ("fr", "b", None), (None, None, None), ("en", "é", ""), ("xx", "alone", "one")]
    table = spark.createDataFrame(docs, "lang string, source string, text string")
    table = table.withColumns({c: F.lit("x") for c in ("term", "n", "docs", "p", "a", "b", "value", "rank")})
    got = divergence.divergence(table, most_terms=10)
    assert {tuple(r) for r in got.collect()} == diverging(docs, most=10)
    assert divergence.divergence(table.limit(0)).collect() == []


def test_long_and_many_terms_are_handed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "LONG", 20)
    batch = pa.record_batch([pa.array(["en"] * 3), pa.array(["a", "b", "a"]), pa.array(["one two three", "one one four five six seven", "TWO"])], names=["lang", "source", "text"])
    total: Counter = Counter()
    for out in divergence._counted(iter([batch, batch])):
        for r in out.to_pylist():
            total[r["source"], r["term"], "n"] += r["n"]
            total[r["source"], r["term"], "docs"] += r["docs"]
    assert (total["a", "two", "n"], total["a", "two", "docs"], total["b", "one", "n"], total["b", "one", "docs"], total["b", None, "n"]) == (4, 4, 4, 2, 0)


def test_spelling_of_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!! 12345"), (None, "Éléph Éléph Éléph"), (4, "a" * 40_000), (5, " ".join(["a" * 40_000] * 3)), (6, " ".join(["a" * 39_999] * 9)), (7, "hello Hello HELLO"), (7, "hello Hello HELLO")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "key", "size", "at", "near", "root")})
    got = {tuple(r) for r in spelling.spelling_groups(table).collect()}
    assert got == grouped(words_of(docs))
    assert spelling.spelling_groups(table.limit(0)).collect() == []


# -- faults found in earlier operators ---------------------------------------------------------------------------------------------


def test_items_of_one_id_are_items_of_their_own(spark):
    from trailmark.llm import tiling

    first, second = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(10))
    halves = " ".join(first.split()[:5] + second.split()[5:])
    docs = spark.createDataFrame([(1, halves), (2, "x " + first), (None, second)], "doc_id long, text string")
    for ids in ((10, 11), (10, 10), (None, None)):
        items = spark.createDataFrame([(ids[0], first), (ids[1], second), (ids[1], second)], "item_id long, text string")
        got = sorted(((r["doc_id"], r["item_id"]) for r in tiling.find_leaks(docs, items).collect()), key=repr)
        assert got == sorted([(2, ids[0]), (None, ids[1])], key=repr)


def test_passages_in_documents_of_any_id(spark):
    from trailmark.llm import suffix_dedup

    text = " ".join(f"w{i * i}" for i in range(70))
    low, high = -(2**63), 2**63 - 1
    ids = [low, low + 1, low + 2, -(2**62) + 5, -(2**61) - 7, -(2**61), -1, 0, 3, high]
    for some in (ids, [low + 1, 3], [low + 1, None], [-(2**62) + 5, None]):
        docs = spark.createDataFrame([(i, " ".join([f"p{n}x{j}" for j in range(n)] + [text])) for n, i in enumerate(some)], "doc_id long, text string")
        got = {r["doc_id"]: r["spans"] for r in suffix_dedup.repeated_passages(docs).collect()}
        assert got == {i: f"{n}-{n + 70}" for n, i in enumerate(some) if i is not None}


def test_samples_of_very_large_tables_are_not_empty(spark, monkeypatch):
    """A table that claims 10**13 rows: the part of a hash's values that is sampled is small, not none."""
    from trailmark.llm import common, language_id

    docs = spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(docs), "count", lambda self: 10**13)
    plan = language_id.training_rows(docs, 6000)._jdf.queryExecution().analyzed().toString()
    bound = int(6000 / 10**13 * common.GRAIN)
    assert bound > 10**9 and str(bound) in plan


def test_pipeline_stage_drops_just_the_leaks(spark, small, tmp_path):
    """The decontaminate stage against seeds compared in plain Python, for texts that hold a whole item or less than its share."""
    import corpus_pipeline

    docs, items = (duckdb.sql(f"SELECT * FROM '{small}/{t}.parquet'").df() for t in ("documents", "benchmark"))
    docs["words"] = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for t in docs["text"]]
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in docs["words"]]
    whole, clear = set(), set(docs["doc_id"])
    for text in items["text"]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        for d, has in zip(docs["doc_id"], runs, strict=True):
            covered = {i + k for i in range(len(w) - 4) if tuple(w[i : i + 5]) in has for k in range(5)}
            if len(covered) == len(w):
                whole.add(d)
            if len(covered) >= 0.7 * len(w):
                clear.discard(d)
    kept = {r["doc_id"] for r in corpus_pipeline.decontaminated(spark, spark.read.parquet(f"{small}/documents.parquet"), small).collect()}
    assert whole and not whole & kept and clear <= kept


def test_rows_are_numbered_alike_whenever_they_are_read(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.union(docs).repartition(7).write.parquet(str(tmp_path / "many"))
    table = spark.read.parquet(str(tmp_path / "many"))
    rows = corpus_pipeline.numbered(table)
    assert corpus_pipeline.is_scan(table) and rows.select("doc_row").distinct().count() == 2 * docs.count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        again = corpus_pipeline.numbered(table)
        assert rows.select("doc_row", "doc_id", "text").exceptAll(again.select("doc_row", "doc_id", "text")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for other in (docs.union(docs), docs.where("doc_id > 3"), docs.join(docs.select("doc_id"), "doc_id")):
        assert not corpus_pipeline.is_scan(other)
        assert corpus_pipeline.numbered(other).select("doc_row").distinct().count() == other.count()


@pytest.mark.parametrize("as_table", [False, True])
def test_licenses_in_parts(spark, as_table):
    """Notices with words put in, and with halves swapped, keep their label; scattered pieces get none."""
    from trailmark.llm import license_scan

    notice = re.findall("[a-z0-9]+", lower(license_scan.TEMPLATES[0][0]))
    n, rng = len(notice), np.random.default_rng(4)
    say = lambda k: [f"w{x}" for x in rng.integers(0, 10**6, k)]
    texts = {
        "four": say(9) + notice[:20] + say(4) + notice[20:], "ten": notice[: n // 2] + say(10) + notice[n // 2 :] + say(3), "swapped": say(2) + notice[n // 2 :] + notice[: n // 2], "whole and a piece": notice + say(9) + notice[:6],
        "twice": notice + say(40) + notice, "half": notice[: n // 2] + say(60), "half twice": notice[: n // 2] + say(5) + notice[: n // 2], "far apart": notice[: n // 2] + say(n) + notice[n // 2 :], "scattered": sum((notice[i : i + 6] + say(12) for i in range(0, n, 6)), []),
    }
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts.values())], "doc_id long, text string")
    templates = spark.createDataFrame([(t, label) for t, label in license_scan.TEMPLATES], "text string, label string") if as_table else None
    got = {list(texts)[r["doc_id"]]: r for r in license_scan.scan_licenses(docs, templates=templates).collect()}
    for name in ("four", "ten", "swapped", "whole and a piece", "twice"):
        assert got[name]["labels"] == "mit" and got[name]["score"] >= 0.8, name
    for name in ("half", "half twice", "far apart", "scattered"):
        assert got[name]["labels"] == "" and got[name]["score"] < 0.8, name
    assert got["swapped"]["spans"] == f"mit:2:{2 + n}" and got["four"]["spans"] == f"mit:9:{9 + n + 4}" and got["whole and a piece"]["spans"] == f"mit:0:{n}"
    assert got["twice"]["spans"] == f"mit:0:{n},mit:{n + 40}:{2 * n + 40}"


def test_licenses_of_an_empty_table(spark):
    from trailmark.llm import license_scan

    docs = spark.createDataFrame([(1, license_scan.TEMPLATES[0][0]), (2, None)], "doc_id long, text string")
    templates = spark.createDataFrame([], "text string, label string")
    assert {(r["doc_id"], r["labels"], r["score"]) for r in license_scan.scan_licenses(docs, templates=templates).collect()} == {(1, "", 0.0), (2, "", 0.0)}
