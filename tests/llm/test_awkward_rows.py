"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import knn_join, language_id, license_scan, order_minhash, packing, pii, suffix_dedup, tiling, token_counts, toxicity
from trailmark.llm.queries import tokenizer_file

CLASHING = ("row", "id", "place", "key", "words", "lang_pred", "score", "node", "hub", "kind", "start", "more", "template", "pack_row", "n_bytes", "held_out", "entry", "cell")


def awkward(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    long = " ".join(f"w{x}" for x in rng.integers(0, 5000, 40_000))
    return [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \t\n ... !!!", "en", "a", 9),
        (4, long, "en", "a", len(long)),
        (5, "the same words again and again", "en", "b", 1),
        (5, "the same words again and again", "en", "b", 1),
        (None, "no id but a mail a@b.example here", "fr", "b", 1),
        (None, None, None, None, None),
        (6, "12345 " * 300, "en", "b", 1),
        (7, "a" * 50_000, "en", "b", 1),
        (8, "Éléphant 日本語 🙂 <|endoftext|> x\x00y", "fr", "b", 1),
        (9, "one", "en", "b", 1),
    ]


LABELS = [(1, 1, 0), (2, None, 1), (None, 1, 1), (4, 0, 0), (5, 1, 1), (9, 1, None)]
ITEMS = [(1, "some item text with words enough to be found"), (2, None), (3, ""), (None, "short one"), (1, "some item text with words enough to be found")]


def operators(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("y", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("seed", F.lit(1))
    chain = toxicity.train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return {
        "suffix": suffix_dedup.repeated_passages(docs),
        "near": order_minhash.near_duplicates(docs),
        "pii": pii.digest(pii.find_spans(docs)),
        "tiling": tiling.find_leaks(docs, items),
        "license": license_scan.scan_licenses(docs),
        "packing": packing.pack(docs, tokenizer_file()),
        "tokens": token_counts.count_tokens(docs, tokenizer_file()),
        "language": language_id.identify(docs),
        "toxicity": toxicity.score(docs, chain),
    }


def test_awkward_rows(spark, rows):
    got = {k: df.toPandas() for k, df in operators(spark, awkward(spark, rows)).items()}
    n = len(rows)
    for name in ("near", "pii", "license", "tokens", "language", "toxicity"):
        assert len(got[name]) == n, name
    assert got["suffix"].empty and got["tiling"].empty  # repeats within one document, or of under 50 words, don't count
    near = got["near"].set_index("doc_id")["class_id"]
    assert near[5].tolist() == [5, 5] and near[4] == 4
    lang = got["language"].set_index("doc_id")
    assert lang.loc[[1, 2, 3, 6], "lang_pred"].tolist() == ["und"] * 4 and (got["language"]["score"].between(0, 1)).all()
    tokens = got["tokens"].set_index("doc_id")["n_tokens"]
    assert tokens[1] == tokens[2] == 0
    pieces = got["packing"]
    assert (pieces["length"] <= 1024).all() and pieces["length"].sum() == (got["tokens"]["n_tokens"] + 1).sum()
    mails = got["pii"][got["pii"]["doc_id"].isna()]
    assert sorted(mails["n_email"]) == [0, 1]
    assert got["license"].set_index("doc_id").loc[[1, 2, 3], "n_words"].tolist() == [0, 0, 0]


def test_empty_tables(spark):
    docs = awkward(spark, [])
    for name, df in operators(spark, docs).items():
        assert df.count() == 0, name
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert knn_join.top_k(none, F.col("vec_id") % 100 == 0).count() == 0


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [0.5]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 2.0]), (8, [-3.0, 1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("cell", "v", "block", "far", "long")})
    got = knn_join.top_k(df, F.col("vec_id") % 100 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 6, 5 * 1024**2), (0, 2, 7, 5 * 1024**2), (100, 1, 0, 512 * 1024), (100, 2, 6, 512 * 1024)]


def test_pipeline_decides_on_rows(spark, tmp_path):
    import corpus_pipeline

    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    near = " extra"
    docs = awkward(spark, [(i, t, "en", "a", len(t)) for i, t in [(None, a), (None, a + near), (None, b), (1, c), (9, c + near), (9, d), (None, c)]])
    got = corpus_pipeline.deduplicated(spark, docs, "").select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["text"].removesuffix(near)) for r in got) == [(0, a), (0, b), (1, c), (9, d)]
    spark.createDataFrame([(1, e)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = awkward(spark, [(i, t, "en", "a", len(t)) for i, t in [(None, e), (None, a), (5, e), (5, b), (6, c)]])
    got = corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, a), (5, b), (6, c)]


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_stages_on_awkward_rows(spark, rows, empty, tmp_path):
    """Each stage alone: nulls, empty and long texts, repeated rows, clashing columns; and no rows at all."""
    import corpus_pipeline

    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = awkward(spark, [] if empty else [*rows, (None, "...", "fr", "b", 3), (None, "...", "fr", "b", 3)])
    want = {"language_id": 6, "near_dedup": 12, "decontaminate": 14, "pii": 14}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert (got.count() == 0) == empty
            continue
        assert got.columns == list(corpus_pipeline.COLUMNS)
        kept = got.collect()
        if empty:
            assert kept == []
        elif name != "language_id":
            assert len(kept) == want[name], name
            assert name == "pii" or {(r["doc_id"], r["text"]) for r in kept} == {(r[0], r[1]) for r in rows} | {(None, "...")}
        else:
            assert {r["doc_id"] for r in kept} <= {4, 5, 7, 8, 9, None} and all(r["text"] for r in kept)


def test_components_of_awkward_edges(spark):
    from trailmark.llm.components import components

    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 4), (5, None), (2, 9)], "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == [(1, 1), (2, 1), (9, 1)]
    assert components(edges.limit(0)).count() == 0
