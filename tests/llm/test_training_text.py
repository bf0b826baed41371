"""The training-text operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.llm import bpe, components, knn_join, language_id, license_scan, order_minhash, packing, pii, suffix_dedup, tiling, token_counts, toxicity
from trailmark.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file
from trailmark.llm.wordhash import hash_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
words_of = lambda t: WORD.findall(_fold(t))


@pytest.fixture(scope="module")
def documents(small):
    return duckdb.sql(f"SELECT * FROM '{small}/documents.parquet'").df()


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9é -\n", max_size=40)), max_size=8), st.integers(1, 30))
def test_word_hashes_stand_for_words(texts, step):
    import pyarrow as pa

    w = hash_words(pa.array(texts, pa.string()), step)
    assert w.counts().tolist() == [len(words_of(t)) for t in texts]
    all_words = [x for t in texts for x in words_of(t)]
    same = {x: set() for x in all_words}
    for x, h in zip(all_words, w.hashes.tolist(), strict=True):
        same[x].add(h)
    assert all(len(s) == 1 for s in same.values()) and len({h for s in same.values() for h in s}) == len(same)


def test_repeated_passages(spark):
    rng = np.random.default_rng(1)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared, near, own = say(70), say(60), say(60)
    docs = [say(30) + shared + say(40), say(5) + shared, say(80), near[:49] + say(30), say(20) + near[:49], own + say(10) + own, say(200), [], None]
    docs += [docs[6]] + [say(int(rng.integers(0, 30))) + shared[i : i + 52] + say(20) for i in range(0, 18, 3)]
    got = suffix_dedup.repeated_passages(frame(spark, [None if d is None else " ".join(d) for d in docs])).collect()
    where: dict[tuple, set[int]] = {}
    for i, d in enumerate(docs):
        for a in range(len(d or []) - 49):
            where.setdefault(tuple(d[a : a + 50]), set()).add(i)
    truth = {i: {x for a in range(len(d or []) - 49) if len(where[tuple(d[a : a + 50])]) > 1 for x in range(a, a + 50)} for i, d in enumerate(docs)}
    covered = {r["doc_id"]: {x for s in r["spans"].split(",") for x in range(*map(int, s.split("-")))} for r in got}
    assert covered == {i: t for i, t in truth.items() if t}


def spans_of(docs: dict) -> dict:
    """The words of each document (by id; ids that are negative stand for rows without one) in runs of 50 words that another has too."""
    where: dict[tuple, set[int]] = {}
    for i, d in docs.items():
        for a in range(len(d) - 49):
            where.setdefault(tuple(d[a : a + 50]), set()).add(i)
    truth = {i: {x for a in range(len(d) - 49) if len(where[tuple(d[a : a + 50])]) > 1 for x in range(a, a + 50)} for i, d in docs.items()}
    return {i: t for i, t in truth.items() if t and i >= 0}


def test_repeated_passages_query(spark, small, documents):
    got = QUERIES["op1_repeated_passages"](spark, small).collect()
    covered = {r["doc_id"]: {x for s in r["spans"].split(",") for x in range(*map(int, s.split("-")))} for r in got}
    assert covered == spans_of({r.doc_id: words_of(r.text) for r in documents.itertuples()})
    assert all(r["n_words"] == len(covered[r["doc_id"]]) for r in got)


def test_passages_repeat_in_rows_without_an_id(spark):
    rng = np.random.default_rng(21)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared = say(60)
    docs = {1: say(20) + shared, -1: shared + say(9), 2: say(80), -2: say(30)}
    df = spark.createDataFrame([(i if i > 0 else None, " ".join(d)) for i, d in docs.items()], "doc_id long, text string")
    got = suffix_dedup.repeated_passages(df).collect()
    assert {r["doc_id"]: r["spans"] for r in got} == {1: "20-80"} and set(spans_of(docs)) == {1}


def test_neighbours_over_task_borders(spark):
    rows = [(k, i, p) for k in range(40) for i, p in ((1, k), (2, k))] + [(1000 + k, 1, k) for k in range(40)] + [(2000, 7, p) for p in range(30)]
    df = spark.createDataFrame(rows, "key long, id long, place int").repartition(3)
    for n in (1, 7, 60):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = suffix_dedup.shared_rows(df, "t").collect()
        assert sorted(map(tuple, got)) == sorted((i, k) for k in range(40) for i in (1, 2))
    spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("n", [1, 7, 60])
@pytest.mark.parametrize("many", [5, 6])
def test_long_runs_over_task_borders(spark, n, many):
    """One id with many places of a key, cut by borders, beside a second id with one place."""
    rows = [(1, many, p) for p in range(1000)] + [(1, 11 - many, 0)] + [(2, 5, p) for p in range(1000)]
    conf = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = suffix_dedup.shared_rows(spark.createDataFrame(rows, "key long, id long, place int"), "t").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == sorted((i, p) for k, i, p in rows if k == 1)


def brute_classes(texts, least=0.8):
    """Classes by alignment of labelled five-word runs, all pairs."""
    seqs = []
    for t in texts:
        w, seen, seq = words_of(t), {}, []
        for g in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []):
            seen[g] = seen.get(g, 0) + 1
            seq.append((g, seen[g]))
        seqs.append(seq)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(seqs):
        at = {g: n for n, g in enumerate(a)}
        for j in range(i):
            b = seqs[j]
            tails: list[int] = []
            for g in b:
                if g in at:
                    k = int(np.searchsorted(tails, at[g]))
                    tails[k : k + 1] = [at[g]]
            alike = len(tails) / (len(a) + len(b) - len(tails)) >= least if a and b else not a and not b and texts[i] is not None and texts[i] == texts[j]
            if alike:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[int(rng.integers(len(out)))] = f"e{rng.integers(10**6)}"
    return out


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, n)] for n in (60, 200, 200, 400)]
    docs = [edited(rng, base[k % 4], int(rng.integers(0, 7))) for k in range(80)] + [list(reversed(base[1])), base[2][100:] + base[2][:100], base[3][:340], ["two", "words"], ["two", "words"], ["x"], [], []]
    texts = [" ".join(d) for d in docs] + [None]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(frame(spark, texts), block=8).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_duplicates_query(spark, small, documents):
    docs = documents.sort_values("doc_id", ignore_index=True)
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op2_near_duplicates"](spark, small).collect()}
    assert got == {d: docs["doc_id"][c] for d, c in zip(docs["doc_id"], brute_classes(docs["text"].tolist()), strict=True)}


def test_families_whose_hub_hides_links(spark):
    """Texts that share a long passage, and so entries, with a hub that none of them is like."""
    rng = np.random.default_rng(12)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = say(120)
    docs = [passage + say(40)]
    for n in (35, 45, 60, 60, 80):
        own = say(n)
        docs += [edited(rng, passage + own, 1) for _ in range(3)] + [passage + own[: n // 2] + say(n // 2), edited(rng, passage + own, 4)]
    docs += [passage + say(int(n)) for n in rng.integers(31, 60, 20)]
    texts = [" ".join(d) for d in docs]
    want = brute_classes(texts)
    # few functions over many k-mers each: every text shares entries with the first
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(frame(spark, texts), functions=64, per_function=2, block=4).collect()}
    assert [got[i] for i in range(len(texts))] == want and 5 < len(set(want)) < 40


def test_near_duplicate_recall_at_the_edge(spark):
    """Pairs of a similarity from 0.8 up to 0.83: all links found."""
    rng = np.random.default_rng(13)
    texts = []
    for k in range(150):
        a = [f"w{k}x{x}" for x in range(int(rng.integers(150, 400)))]
        runs = len(a) - 4
        cut = int(np.floor((1 - 0.8) * runs)) - int(rng.integers(0, 5))  # a tail left out: the rest of the runs stay
        texts += [" ".join(a), " ".join(a[: len(a) - cut])]
    want = brute_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(frame(spark, texts)).collect()}
    assert len(set(want)) == 150 and [got[i] for i in range(300)] == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.5, 0.8, 0.9]))
def test_linked_texts_share_a_key_of_their_family(seed, least):
    rng = np.random.default_rng(seed)
    pool = rng.choice(np.iinfo(np.int64).max, 90, replace=False).astype(np.uint64)
    hub = pool[:50]
    for _ in range(40):
        a = rng.permutation(pool)[: int(rng.integers(1, 80))]
        b = a[rng.random(len(a)) < (1 + least) / 2]
        if len(b) and order_minhash.aligned_similarity(a, b, least) >= least:
            assert set(order_minhash.family_prefix(a, hub, least).tolist()) & set(order_minhash.family_prefix(b, hub, least).tolist())


def test_near_duplicates_of_short_texts(spark):
    rng = np.random.default_rng(5)
    docs = []
    for k in range(150):
        base = [f"w{k}x{x}" for x in range(int(rng.integers(5, 41)))]
        docs += [base, [*base, f"e{k}"], [f"b{k}", *base[: len(base) - int(rng.integers(0, 3))]], edited(rng, base, 1), base[1:] + base[:1]]
    docs += [("one two three four five six seven eight nine" + tail).split() for tail in ("", " ten", " ten eleven")]
    texts = [" ".join(d) for d in docs]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(frame(spark, texts), block=8).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9])
def test_linked_short_texts_share_an_entry(least):
    rng = np.random.default_rng(6)
    linked = 0
    for _ in range(3000):
        a = rng.choice(np.iinfo(np.int64).max, int(rng.integers(1, 31)), replace=False).astype(np.uint64)
        b = rng.permutation(a) if rng.random() < 0.05 else a[rng.random(len(a)) < (1 + least) / 2]
        at = np.sort(rng.integers(0, len(b) + 1, int(rng.integers(0, 5))))
        b = np.insert(b, at, rng.integers(0, np.iinfo(np.int64).max, len(at)).astype(np.uint64))
        if len(b) and order_minhash.aligned_similarity(a, b, least) >= least:
            linked += 1
            assert set(order_minhash.entries_of(a, 32, 6, least).tolist()) & set(order_minhash.entries_of(b, 32, 6, least).tolist())
    assert linked > 300


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            break
    assert got == {x: r for x, r in root.items() if any(a != b for a, b in edges if x in (a, b))}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "card":
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
            return 12 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
        return kind == "email" or (9 <= len(d) <= 15 if kind == "phone" else all(int(p) <= 255 for p in m.split(".")))

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if good(kind, m[0]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.-+ ()%é:", max_size=60) | st.text(alphabet="0123456789 -.+", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_texts_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "@a" * 150_000, "+1 " * 100_000):
        pii.uses(t, pii.base_spans(t))


def test_pii_query(spark, small, documents):
    got = QUERIES["op3_pii"](spark, small).toPandas().set_index("doc_id")
    for r in documents.itertuples():
        spans = plain_spans(r.text)
        text = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in spans)
        g = got.loc[r.doc_id]
        assert g["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [g[f"n_{k}"] for k in BASE] == [sum(s[1] == i for s in spans) for i in range(4)]


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"write to me at home: contact handle a{i}@mail.example please" for i in range(12)] + [f"so contact handle user{i}99x please" for i in range(4)] + ["see part number 4711AB today"]
    got = pii.digest(pii.find_spans(frame(spark, texts))).toPandas().set_index("doc_id")
    assert got["n_context"].tolist() == [0] * 12 + [1] * 4 + [0]
    assert got.loc[12, "spans"] == "context:18:26"
    clean = pii.redacted(frame(spark, texts).withColumn("n_chars", F.length("text").cast("long"))).toPandas()
    assert clean.loc[12, "text"] == "so contact handle [CONTEXT] please" and clean.loc[0, "text"].endswith("contact handle [EMAIL] please")
    assert (clean["n_chars"] == clean["text"].str.len()).all()


def test_contexts_of_any_length(spark):
    """Blanks, words and identifiers have no upper length; the pattern is the same over any number of blanks."""
    long, blanks = "x" * 40 + "word", " " * 90
    texts = [f"{long} handle a{i}@mail.example" for i in range(12)] + [f"so {long}{blanks}handle{blanks}{'q7' * 150}!", f"{long} handle\n\n user_name_{'z' * 300}", f"{'y' * 500} handle user77"]
    got = pii.digest(pii.find_spans(frame(spark, texts))).toPandas().set_index("doc_id").sort_index()
    at = texts[12].index("q7")
    assert got["spans"][12] == f"context:{at}:{at + 300}" and got["n_context"].tolist() == [0] * 12 + [1, 1, 0]


def test_confidence_takes_two_hops_but_never_its_own_word(spark):
    """A pattern without seeds is learned over identifiers that a confident pattern introduces; one with a quarter of seeds isn't."""
    seeded = [f"you may reach handle a{i}@mail.example" for i in range(40)]
    shared = [f"please reach handle name{i}x" for i in range(6)]
    second = [f"the account called name{i}x" for i in range(6)] + ["the account called unseen99"]
    weak = [f"see serial number b{i}@mail.example" for i in range(6)] + [f"see serial number part{i}" for i in range(18)]
    texts = seeded + shared + second + weak
    got = pii.digest(pii.find_spans(frame(spark, texts))).toPandas().set_index("doc_id").sort_index()
    assert got["n_context"].tolist() == [0] * 40 + [1] * 13 + [0] * 24
    one = pii.digest(pii.find_spans(frame(spark, texts), rounds=1)).toPandas()
    assert one["n_context"].sum() == 6
    docs = frame(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    assert sorted(map(tuple, pii.redacted(docs).collect())) == sorted(map(tuple, pii.redacted(docs, most_sent=0).collect()))


def test_tiles_are_the_greedy_ones():
    item = list(range(20))
    text = [99] + item[10:20] + [98] + item[0:10] + item[5:9]
    seeds = [(i, j) for i in range(len(text) - 2) for j in range(18) if text[i : i + 3] == item[j : j + 3]]
    p, q = (np.array(x) for x in zip(*seeds, strict=True))
    assert sorted(tiling.tile(p, q, 20, 3)) == [(1, 10, 10), (12, 0, 10)]


def test_leaks(spark):
    rng = np.random.default_rng(5)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    items = [say(40), say(24), say(60)]
    docs = [say(30) + items[0] + say(10), items[0][20:] + say(9) + items[0][:20], say(100), items[1][:12] + say(20), items[2][:50] + say(5), (items[1] + say(3)) * 50, []]
    got = tiling.find_leaks(frame(spark, [" ".join(d).upper() for d in docs]), frame(spark, [" ".join(x) for x in items]).withColumnRenamed("doc_id", "item_id")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["tiles"]) for r in got) == [(0, 0, 1), (1, 0, 2), (4, 2, 1), (5, 1, 1)]


def test_short_items_match_whole_and_repeats_make_no_products(spark):
    docs = ["so ALPHA beta, gamma it is", "alpha beta and gamma", "delta", "same " * 3000, "one two three four five six", None, "", "alpha"]
    items = ["alpha beta gamma", "Delta!", "same " * 40, "four five", "", None, "one two three four six five"]
    got = tiling.find_leaks(frame(spark, docs), frame(spark, items).withColumnRenamed("doc_id", "item_id")).collect()
    assert sorted((r["doc_id"], r["item_id"], round(r["coverage"], 2)) for r in got) == [(0, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0)]


def test_leaks_query(spark, small):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_decontaminate"](spark, small).collect()}
    con = duckdb.connect()
    docs, items = (con.sql(f"SELECT * FROM '{small}/{t}.parquet'").df() for t in ("documents", "benchmark"))
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words_of, docs["text"])]
    for _, item in items.iterrows():
        w = words_of(item["text"])
        for d, has in zip(docs["doc_id"], runs, strict=True):
            covered = {i + k for i in range(len(w) - 4) if tuple(w[i : i + 5]) in has for k in range(5)}
            if len(covered) == len(w):
                assert (d, item["item_id"]) in got
            if len(covered) < 0.7 * len(w):
                assert (d, item["item_id"]) not in got


def check_base(got, texts):
    """Base fields of the license scan against plain comparison of words; got: by doc_id."""
    for i, t in texts:
        w = words_of(t)
        at = sorted((k, label) for phrase, label in license_scan.BASE for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p)
        g = got.loc[i]
        assert (g["n_words"], g["n_base"], g["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (pd.isna(g["first_word"]) and pd.isna(g["last_word"])) if not at else (g["first_word"], g["last_word"]) == (at[0][0], at[-1][0])
        assert 0 <= g["score"] <= 1 and set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(","))


def test_license_scan(spark):
    mit, apache, gpl = (next(t for t, x in license_scan.TEMPLATES if x == y) for y in ("mit", "apache", "gpl"))
    w = words_of(mit)
    cases = {
        "CC BY; cc-by, Cc. By": "cc-by",
        "General Public License general public license all rights": "gpl",
        "cc": "",
        "Released under  the MIT  license": "mit",
        "released under the new mit license": "mit",
        "licensed under cc by cc by": "cc-by",
        "licensed under cc by-sa 4.0": "cc-by,cc-by-sa",
        "of the of the of the of the terms of the mozilla": "",
        "so: " + mit.upper() + " end": "mit",
        " ".join(w[:20] + ["fine"] + w[20:40] + w[42:]): "mit",
        " ".join(w[30:] + w[:30]): "mit",
        " ".join(w[:30]): "",
        apache + " ... " + gpl: "apache,gpl",
        " ".join(w[:10] * 6): "",
    }
    texts = list(cases) + [None, "all rights reserved " * 3000]
    got = license_scan.scan_licenses(frame(spark, texts)).toPandas().set_index("doc_id")
    check_base(got, enumerate(texts))
    assert got["labels"].sort_index().tolist() == [*cases.values(), "", "reserved"]
    at = texts.index("so: " + mit.upper() + " end")
    assert got["spans"][at] == f"mit:1:{len(w) + 1}" and got["score"][at] == 1


def test_license_query(spark, small, documents):
    got = QUERIES["op5_license_scan"](spark, small).toPandas().set_index("doc_id")
    assert len(got) == len(documents)
    check_base(got, zip(documents["doc_id"], documents["text"], strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=60))
def test_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 100)
    room: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [100] * (b == len(room))
        assert (bins[i], offsets[i]) == (b, 100 - room[b])
        room[b] -= lengths[i]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_ids_and_counts_are_the_library_s(documents):
    lib, own = library(), bpe.bpe(tokenizer_file())
    odd = ["", " ", "a  b\n\n c\t", "it's I'LL we've", "日本語テキスト", "x<|endoftext|>y", "🙂🙂 ok", "ﬁ ² Ⅷ ½", "a\x1cb\x85c d　e", " " * 3000 + "x", "ab" * 2000, "\x00\x01", "naïve café ÀÉÎ ß ǅ", "mixed русский Ελληνικά 123abc", "é combining"]
    texts = documents["text"].tolist() + odd
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.count(texts) == list(map(len, want))
    assert [np.frombuffer(b, "<u4").tolist() for b in own.ids(texts)] == want
    vocabulary = [t for t in lib.decode_batch([[i] for i in range(50_256)]) if t]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.ids(vocabulary)] == [e.ids for e in lib.encode_batch(vocabulary, add_special_tokens=False)]
    assert len(own.whole) > 45_000 and all(len(lib.encode(t, add_special_tokens=False).ids) == 1 for t in list(own.whole)[::97])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=50), max_size=4))
def test_any_text_has_the_library_s_counts(texts):
    lib, own = library(), bpe.bpe(tokenizer_file())
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.count(texts) == list(map(len, want)) and [np.frombuffer(b, "<u4").tolist() for b in own.ids(texts)] == want


def test_packing_query(spark, small, documents):
    lib, got = library(), QUERIES["op6_packing"](spark, small).toPandas()
    ids = {r.doc_id: np.array(lib.encode(r.text, add_special_tokens=False).ids + [0], "<u4") for r in documents.itertuples()}
    for r in got.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert got.groupby("doc_id")["length"].sum().to_dict() == {d: len(x) for d, x in ids.items()}
    filled = []
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 1024
        filled.append(int(g["length"].sum()))
    assert packing.padding_share(filled) < 0.02


def test_token_query(spark, small, documents):
    lib = library()
    odd = pd.DataFrame({"doc_id": range(10**6, 10**6 + 5), "text": ["مرحبا بالعالم", "한국어 텍스트 🙂", "x<|endoftext|>y", None, "é" * 3000]})
    both = pd.concat([documents[["doc_id", "text"]], odd])
    got = {r["doc_id"]: r for r in [*QUERIES["op7_token_counts"](spark, small).collect(), *token_counts.count_tokens(spark.createDataFrame(odd), tokenizer_file()).collect()]}
    for r in both.itertuples():
        n = len(lib.encode(r.text, add_special_tokens=False).ids) if r.text else 0
        assert tuple(got[r.doc_id]) == (r.doc_id, len((r.text or "").encode()), n, n > 1024)


def test_language_scores_are_the_plain_ones(spark):
    """Posteriors against sums over the n-grams, one at a time."""
    texts = ["der Hund und die Katze sind hier", "the dog and the cat are here", "der Mann", "the man"]
    docs = spark.createDataFrame([(i, t, "de" if i % 2 == 0 else "en") for i, t in enumerate(texts * 40)], "doc_id long, text string, lang string")
    langs, table = language_id.train(docs)
    got = language_id.predict(frame(spark, texts), langs, table).orderBy("doc_id").collect()
    for r in got:
        grams, first = language_id.ngram_buckets([r["text"]])
        total = [sum(float(table[i][b]) for g in grams for b in g[: first[1] - 2]) for i in range(2)]
        assert r["lang_pred"] == langs[int(np.argmax(total))] and r["score"] == pytest.approx(1 / sum(np.exp(t - max(total)) for t in total))


def test_language_query(spark, small, documents):
    got = QUERIES["op8_language_id"](spark, small).toPandas().merge(documents[["doc_id", "lang"]], on="doc_id")
    assert (got["held_out"] == got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_top_k_query(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = sorted(con.sql(ORACLE_SQL["op9_top_k"]).fetchall())
    got = QUERIES["op9_top_k"](spark, small).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want


def test_top_k_with_small_blocks_and_ties(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(-3, 4, (400, 6)).astype(float)
    v[50:180] = v[50]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = knn_join.top_k(df, F.col("vec_id") % 20 == 0, k=7, pivots=5, block=40, query_group=6).collect()
    s = (v * 1024) @ (v * 1024).T
    want = [(q, r + 1, i, int(s[q, i])) for q in range(0, 400, 20) for r, i in enumerate(sorted((i for i in range(400) if i != q), key=lambda i: (-s[q, i], i))[:7])]
    assert sorted(map(tuple, got)) == want


def test_toxicity_chain(spark):
    rng = np.random.default_rng(8)
    bad = ["vile", "rotten", "foul"]
    say = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    y = rng.random(600) < 0.15
    texts = [" ".join(say(40) + ([bad[int(rng.integers(3))]] if t else [])) for t in y]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(rng.random() < 0.8), int(t)) for i, t in enumerate(y) if i % 3], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}, sample_rows=10_000)
    assert len(chain.models[1].earlier) == 1
    got = toxicity.score(docs, chain).toPandas().sort_values("doc_id")
    held = np.arange(600) % 3 == 0
    hit = got["is_toxic"].to_numpy()
    assert (hit[held] == y[held]).mean() > 0.97, got[held & (hit != y)]
    assert got["p_toxic"].between(0, 1).all()


def test_toxicity_query(spark, small, documents):
    labels = duckdb.sql(f"SELECT * FROM '{small}/labels.parquet'").df()
    got = QUERIES["op10_toxicity"](spark, small).toPandas()
    assert sorted(got["doc_id"]) == sorted(documents["doc_id"]) and got[["p_toxic", "p_low_quality"]].stack().between(0, 1).all()
    both = got.merge(labels.groupby("doc_id", as_index=False)["toxic"].max(), on="doc_id")
    clean, toxic = both[both["toxic"] != 1], both[both["toxic"] == 1]
    assert not clean["is_toxic"].any() or clean["is_toxic"].mean() < 0.05
    assert len(toxic) < 50 or toxic["is_toxic"].mean() > 0.9  # the smallest tables have too few to learn from


def test_toxicity_sample_is_bounded_by_documents(spark):
    docs = spark.createDataFrame([(1, "vile words")] * 400 + [(i, "kind words") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, i % 2) for i in range(300)] + [(i, 1, 0) for i in range(2, 40)], "doc_id long, quality int, toxic int")
    seen = []
    keep = toxicity.fit_chain
    toxicity.fit_chain = lambda x, y, names: (seen.append(y), keep(x, y, names))[1]
    try:
        toxicity.train(docs, labels, {"toxic": F.col("toxic")}, sample_rows=20)
        toxicity.train(docs, labels, {"toxic": F.col("toxic")}, sample_rows=1000)
    finally:
        toxicity.fit_chain = keep
    assert len(seen[0]) <= 20 and len(seen[1]) == 39 and seen[1].sum() == 1


def test_pipeline(spark, small, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, small).persist()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            kept[name] = (before.toPandas(), docs.toPandas())
    a, b = kept["language_id"]
    assert set(a["doc_id"]) - set(b["doc_id"]) <= set(a[~a["text"].str.contains(r"[^\W\d_]", regex=True)]["doc_id"])
    a, b = kept["near_dedup"]
    a = a.sort_values("doc_id", ignore_index=True)
    classes = brute_classes(a["text"].tolist())
    assert sorted(b["doc_id"]) == sorted({a["doc_id"][c] for c in classes})
    a, b = kept["decontaminate"]
    leaks = {r["doc_id"] for r in tiling.find_leaks(spark.createDataFrame(a), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert set(a["doc_id"]) - set(b["doc_id"]) == leaks
    a, b = (x.set_index("doc_id") for x in kept["pii"])
    assert set(a.index) == set(b.index)
    for d in a.index:
        assert b.loc[d, "text"] == pii.redact(a.loc[d, "text"], plain_spans(a.loc[d, "text"])) and b.loc[d, "n_chars"] == len(b.loc[d, "text"])
    lib = library()
    assert docs.agg(F.sum("length")).first()[0] == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in b["text"])
    assert set(QUERIES["pipeline"](spark, small).columns) == set(docs.columns)


def test_top_k_of_components_of_any_size(spark):
    rows = [(100, [1.0, 0.0, 3.0]), (1, [2e9, 0.0]), (2, [3e9, 0.0]), (3, [5e9, 0.0]), (4, [5e9 + 1 / 1024, 0.0]), (5, []), (6, [-1e300, 0.0, 1.0]), (7, [3e9, 1e305, 1 / 1024])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn_join.top_k(df, F.col("vec_id") % 100 == 0, k=6).orderBy("rank").collect()
    m = 1024 * 1024
    want = [(4, 5 * 10**9 * m + 1024), (3, 5 * 10**9 * m), (7, 3 * 10**9 * m + 3 * 1024), (2, 3 * 10**9 * m), (1, 2 * 10**9 * m), (5, 0)]
    assert [tuple(r) for r in got] == [(100, i + 1, *w) for i, w in enumerate(want)]
    with pytest.raises(Exception, match="does not fit in a long"):
        knn_join.top_k(df, F.col("vec_id") % 100 == 0, k=7).collect()


def test_queries_meet_few_blocks_of_clustered_vectors():
    rng = np.random.default_rng(17)
    centre = rng.normal(0, 1, (64, 16))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    v = centre[np.arange(6400) % 64] + rng.normal(0, 0.01, (6400, 16))
    stats, points = {}, v[:64]
    cell = ((v[:, None] - points[None]) ** 2).sum(2).argmin(1)
    for c in range(64):
        mine = np.floor(v[cell == c] * 1024)
        stats[c] = {"n": len(mine), "radius": np.linalg.norm(mine - np.floor(points[c] * 1024), axis=1).max(), "longest": np.linalg.norm(mine, axis=1).max()}
    shape = knn_join.Cells(points, stats, 50)
    q = v[640:704]
    s = np.sort(np.floor(q * 1024) @ np.floor(v * 1024).T, axis=1)[:, -11]
    assert np.mean([len(x) for x in shape.further_blocks(q, 10, s)]) < 0.1 * sum(shape.blocks)
