"""The processing run: classify what is pending, link it, infer and retract ghosts, tell what to index anew.

The classifier is external: a function from candidate mails to raw answers (see ``extraction``), to be run by Spark, for example with
``mapInPandas``.  A run is one pass over all that is pending, or batches of a size; every step writes its tables before the next.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.functions import text
from trailmark.operators import extraction, linkage, lists, relinkage, retrieval, snapshots
from trailmark.operators.features import features
from trailmark.operators.filters import not_submitted
from trailmark.sources.shared import cut

Classifier = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Tables:
    emails: DataFrame
    classes: DataFrame
    apps: DataFrame
    events: DataFrame
    corrections: DataFrame


def classified(tables: Tables, answers: extraction.Answers) -> DataFrame:
    """K04 with what was accepted."""
    new = answers.accepted.select(*[c for c in tables.classes.columns])
    return snapshots.replaced(tables.classes, new, ["email_id"])


def batch(tables: Tables, classify: Classifier, model: str, prompt_version: str, size: int | None, tried: DataFrame | None = None) -> tuple[Tables, DataFrame, int]:
    """The tables after one batch, its malformed answers, and how many mails it had."""
    mails = cut(lists.candidates_to_classify(tables.emails, tables.classes, model, prompt_version, size, tried), "candidates")
    n = mails.count()
    if not n:
        return tables, mails.select(F.col("id").alias("email_id")).limit(0), 0
    answers = extraction.split(cut(classify(mails), "answers"))
    told = answers.accepted.where("is_job_related").join(mails.select(F.col("id").alias("email_id"), "thread_id", "sent_at"), "email_id")
    x = told.withColumn("seq", F.xxhash64("email_id"))
    classes = cut(classified(tables, answers), "classes")
    got = relinkage.relink(x, answers.accepted.select("email_id"), tables.apps, tables.events, tables.emails, classes, tables.corrections)
    done = dataclasses.replace(tables, classes=classes, apps=cut(got.applications, "applications"), events=got.events)
    return done, answers.malformed, n


def with_ghosts(tables: Tables, now: str) -> Tables:
    """Late responses take ghosts away or move them (L13); silent applications get theirs."""
    facts = lambda t: features(t.apps, t.events, t.emails, t.classes)
    ghosts = tables.events.where("event_type = 'ghost_inferred'")
    judged = linkage.retract_ghosts(facts(tables), ghosts).where("action <> 'keep'")
    left = cut(tables.events.join(judged.select("id"), "id", "left_anti").select(*tables.events.columns), "events")
    kept = dataclasses.replace(tables, events=left)
    new = linkage.infer_ghosts(facts(kept), kept.events, not_submitted(kept.events, kept.classes), now)
    named = new.withColumns({"event": F.col("event_type"), "at": F.col("event_at"), "email_id": F.lit(None).cast("string")})
    named = named.withColumn("id", linkage.event_id())
    filled = named.select(*[F.col(c) if c in named.columns else F.lit(None).cast(k).alias(c) for c, k in left.dtypes])
    return dataclasses.replace(kept, events=cut(snapshots.first_wins(left, filled, ["id"]), "events"))


@dataclass(frozen=True)
class Run:
    """What a run made: the tables, its malformed answers, the mails that are still pending (email_id), and what an index lacks."""

    tables: Tables
    malformed: DataFrame
    pending: DataFrame
    reindex: DataFrame | None = None


def pending(tables: Tables, model: str, prompt_version: str, tried: DataFrame) -> DataFrame:
    """email_id of candidates that have no classification by this model and prompt, and weren't tried."""
    left = lists.candidates_to_classify(tables.emails, tables.classes, model, prompt_version, None, tried.select(F.col("email_id").alias("id")))
    return left.select(F.col("id").alias("email_id"))


def reindexed(tables: Tables, state: DataFrame, provider: str, model: str, most: int = schema.CHUNK_CHARS, overlap: int = schema.CHUNK_OVERLAP) -> DataFrame:
    """What an index lacks or has too much after a run (email_id, action): all eligible mails' chunks against its state."""
    chunks = text.chunked(retrieval.eligible(tables.emails, tables.classes), most, overlap)
    return retrieval.reconcile(retrieval.content_hash(chunks), state, provider, model)


def run(tables: Tables, classify: Classifier, model: str, prompt_version: str, now: str, size: int | None = None, most: int | None = None, index_state: DataFrame | None = None, index_provider: str = "", index_model: str = "") -> Run:
    """Classifies what is pending, links it, infers and retracts ghosts, and tells what an index has to take up.

    All that is pending is one pass, a table however large: mails are linked in the order of their events anyway.  With ``size``, batches of
    so many mails, for a classifier that has to be stopped between them, and ``most`` of these; what is left then is reported as pending.
    Malformed answers come back, and aren't tried again in this run."""
    spark = tables.emails.sparkSession
    quarantined = spark.createDataFrame([], "email_id string, model string, prompt_version string, reason string")
    done = 0
    while most is None or done < most:
        tables, malformed, n = batch(tables, classify, model, prompt_version, size, quarantined.select(F.col("email_id").alias("id")))
        if not n:
            break
        quarantined, done = cut(quarantined.unionByName(malformed), "quarantined"), done + 1
        if size is None:
            break
    tables = with_ghosts(tables, now)
    reindex = None if index_state is None else reindexed(tables, index_state, index_provider, index_model)
    return Run(tables, quarantined, pending(tables, model, prompt_version, quarantined), reindex)
