"""The registered queries of the training-text operators, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find_spans

    return digest(find_spans(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiling import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn_join import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its flags and the chain's probabilities."""
    from .toxicity import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return score(docs, chain).select("doc_id", "is_toxic", "is_low_quality", "p_toxic", "p_low_quality")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"))


def op12_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import linked_components

    return linked_components(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_passages": op1_repeated_passages,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_pii": op3_pii,
    "op4_decontaminate": op4_decontaminate,
    "op5_license_scan": op5_license_scan,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_top_k": op9_top_k,
    "op10_toxicity": op10_toxicity,
    "op11_spelling": op11_spelling,
    "op12_embedding_duplicates": op12_embedding_duplicates,
    "op13_divergence": op13_divergence,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op9_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
    """,
    "op11_spelling": r"""
        WITH RECURSIVE bit(crc, byte, step) AS (
            SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
            UNION ALL
            SELECT CASE WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, byte, step + 1 FROM bit WHERE step < 8
        ), bytes AS (SELECT list(crc ORDER BY byte) AS t FROM bit WHERE step = 8),
        runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
            WHERE length(r) >= 5 GROUP BY ALL
        ), summed AS (
            SELECT run, n, xor(4294967295, list_reduce(
                list_prepend(4294967295, [CAST(ord(c) AS BIGINT) FOR c IN string_split(d || ':' || run, '')]), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]))) AS h
            FROM (SELECT d, run, n FROM runs WHERE NOT regexp_matches(run, '[^a-z]')), bytes
            UNION ALL
            SELECT run, n, xor(4294967295, list_reduce(
                list_prepend(4294967295, [CAST(('0x' || b) AS BIGINT) FOR b IN regexp_extract_all(hex(encode(d || ':' || run)), '..')]), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])))
            FROM (SELECT d, run, n FROM runs WHERE regexp_matches(run, '[^a-z]')), bytes
        ), spelt AS (
            SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM summed
        ), words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS l FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ), less AS (
            SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, l + 1)) u(i)
        ), pairs AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION
            SELECT less.word, w.word, w.n FROM less JOIN words w ON w.word = less.rest
            UNION
            SELECT w.word, less.word, less.n FROM less JOIN words w ON w.word = less.rest
        ), best AS (
            SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
        ), formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
            FROM words w LEFT JOIN best USING (word)
        ), steps(word, root, step) AS (
            SELECT word, word, 0 FROM formed
            UNION ALL
            SELECT s.word, f.form, s.step + 1 FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL
        ), last AS (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word)
        SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN last USING (word)
    """,
    "op12_embedding_duplicates": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ), reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ), least AS (SELECT vec_id, min(other) AS component FROM reach GROUP BY vec_id),
        counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(component, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
    """,
    "op13_divergence": r"""
        WITH docs AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), hits AS (SELECT lang, source, doc, unnest(terms) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM hits GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
        counts AS (SELECT lang, source, term, count(*) AS n FROM hits JOIN kept USING (lang, term) GROUP BY ALL),
        langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_size FROM kept GROUP BY lang),
        groups AS (
            SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(lang_size, 0) AS lang_size, coalesce(s.size, 0) AS size
            FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)
            LEFT JOIN (SELECT lang, source, sum(n) AS size FROM counts GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source
        ), shares AS (
            SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
                   1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5) // CAST(size + 5 * v AS HUGEINT) AS p,
                   1 + CAST(1000000000 AS HUGEINT) * (lang_n + 5) // CAST(lang_size + 5 * v AS HUGEINT) AS q
            FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), apart AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q
        ), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
