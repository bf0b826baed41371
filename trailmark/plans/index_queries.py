"""Registered queries that go through kept indexes and a kept dashboard, built from the tables and changed before they are asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators.dashboard import Dashboard
from trailmark.operators.text_index import TextIndex
from trailmark.operators.vector_index import VectorIndex
from trailmark.plans.catalog import RAW_SQL, query
from trailmark.plans.metric_queries import CLOCK
from trailmark.sources.shared import fresh_folder
from trailmark.sources.testdata import JobSearch

#: After the index is built some mails go and some are embedded anew; terms are pieces of texts, of one to six characters.
_VIEWS = {
    "index_actions": "SELECT email_id, CASE WHEN CAST(email_id AS BIGINT) % 7 = 0 THEN 'delete' WHEN CAST(email_id AS BIGINT) % 7 = 1 THEN 'embed' ELSE 'keep' END AS action FROM (SELECT DISTINCT email_id FROM <email_chunks>) e",
    "indexed_chunks": "SELECT c.* FROM <email_chunks> c JOIN <index_actions> a ON a.email_id = c.email_id WHERE a.action <> 'delete'",
    "search_terms": "SELECT DISTINCT lower(substring(text, 1 + CAST(doc_id % 7 AS INT), 1 + CAST(doc_id % 6 AS INT))) AS term FROM <documents> WHERE length(text) > 20",
}


def _changed(j: JobSearch, index) -> None:
    index.update(j.chunks, j.view("index_actions", _VIEWS))


def _nearest(j: JobSearch):
    index = VectorIndex.created(j.chunks, fresh_folder(j.spark, "vectors"))
    _changed(j, index)
    asked = j.view("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return index.nearest(asked, 3).select("query_id", "rank", "email_id", "chunk_index", F.round("distance", 6).alias("distance"))


def _mentions(j: JobSearch):
    index = TextIndex(j.spark, fresh_folder(j.spark, "grams"))
    index.update(j.chunks, j.chunks.select("email_id").distinct().withColumn("action", F.lit("embed")))
    _changed(j, index)
    terms = j.view("search_terms", _VIEWS).where("term <> ''").withColumn("term_id", F.col("term"))
    return index.first_places(j.chunks, terms).select(F.col("term_id").alias("term"), "email_id", "chunk_index")


query(
    "v01_v08_indexed_nearest",
    """SELECT query_id, CAST(rank AS INTEGER) AS rank, email_id, chunk_index, round(d, 6) AS distance FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, email_id, chunk_index) AS rank FROM (
               SELECT e.vec_id AS query_id, c.email_id, c.chunk_index, sqrt(list_sum([pow(CAST(c.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE), 2) FOR i IN range(1, len(e.embedding) + 1)])) AS d
               FROM <indexed_chunks> c, <embeddings> e) s) r WHERE rank <= 3""",
    _VIEWS,
)(_nearest)
query(
    "v03_v08_indexed_mentions",
    "SELECT t.term, c.email_id, min(c.chunk_index) AS chunk_index FROM <search_terms> t JOIN <indexed_chunks> c ON instr(lower(c.content), t.term) > 0 WHERE t.term <> '' GROUP BY 1, 2",
    _VIEWS,
)(_mentions)


def _kept(j: JobSearch) -> Dashboard:
    """A dashboard that took the applications up in two batches, and some of them once more, with other statuses in between."""
    board = Dashboard(j.spark, fresh_folder(j.spark, "dashboard"), buckets=8)
    part = lambda n, r: j.apps.where(F.col("id").cast("long") % n == r).select("id")
    odd = j.apps.withColumn("current_status", F.lit("withdrawn")).withColumn("company", F.lit("Another"))
    board.update(part(2, 0), j.apps, j.events, j.emails, j.classes, 0)
    board.update(part(2, 1), odd, j.events.where("event_type <> 'offer'"), j.emails, j.classes, 1)
    board.update(part(2, 1).union(part(3, 0)), j.apps, j.events, j.emails, j.classes, 2)
    return board


query("a36_k21_kept_summary", *RAW_SQL["a36_summary"])(lambda j: _kept(j).summary(CLOCK))
query("a16_k21_kept_rates", *RAW_SQL["a16_rates"])(lambda j: _kept(j).rates(CLOCK))
query("a17_k21_kept_funnel", *RAW_SQL["a17_funnel"])(lambda j: _kept(j).funnel(CLOCK))
