"""The pipeline itself: stages, what to do next, candidates, estimates, reprocessing, reconciliation, costs, evaluation
(A31-A35, A38-A39, F26, F28-F29, X05-X07, X30, X36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.metrics import count_if

# What marks a mail as worth reading.
SENDER_DOMAINS = (
    "greenhouse.io greenhouse-mail.io lever.co ashbyhq.com myworkday.com myworkdayjobs.com workday.com icims.com workable.com workablemail.com smartrecruiters.com smartrecruitersmail.com "
    "jobvite.com bamboohr.com recruitee.com teamtailor.com eightfold.ai taleo.net successfactors.com linkedinmail.com indeedemail.com ziprecruiter.com ziprecruiteremail.com dice.com wellfound.com"
).split()
KEYWORDS = (
    "application", "applied", "thank you for applying", "we received your application", "candidate", "recruiter", "interview", "next steps", "assessment", "take-home", "unfortunately",
    "regret to inform", "moving forward with other candidates", "offer", "congratulations", "job opportunity", "position", "role", "sponsorship", "phone screen", "onsite", "challenge",
    "work sample", "job search", "hiring event",
)
EXCLUDED_LABELS = ("spam", "trash", "chats")
SIGNAL_SCORE, THRESHOLD = 2, 2


def _first(terms, test) -> Column:
    """The first term that fits, or null."""
    return F.coalesce(*[F.when(test(t), F.lit(t)) for t in terms])


def filter_decisions(emails: DataFrame, domains=tuple(SENDER_DOMAINS), keywords=KEYWORDS, excluded=EXCLUDED_LABELS) -> DataFrame:
    """id, outcome, reason, score (P14): an excluded label rejects; sender domain, subject keyword and a candidate's thread score.

    Threads of mails that pass by themselves are found first; then all mails are judged with them.
    """
    # the address ends the field, so its domain is what follows the last @
    domain = F.lower(F.regexp_replace(F.when(F.col("from_addr").contains("@"), F.trim(F.substring_index("from_addr", "@", -1))), ">+$", ""))
    labels, subject = F.transform("labels", lambda x: F.lower(F.trim(x))), F.lower(F.coalesce("subject", F.lit("")))
    own = emails.withColumns(
        {
            "label": _first(excluded, lambda t: F.array_contains(labels, t)),
            "domain": _first(domains, lambda t: (domain == t) | domain.endswith(f".{t}")),
            "keyword": _first(keywords, lambda t: subject.contains(t)),
        }
    )
    passing = F.col("label").isNull() & (F.col("domain").isNotNull() | F.col("keyword").isNotNull())
    threads = own.where(passing & F.col("thread_id").isNotNull()).select("thread_id", F.lit(True).alias("in_thread")).distinct()
    score = sum((F.when(F.col(c).isNotNull(), SIGNAL_SCORE).otherwise(0) for c in ("domain", "keyword", "in_thread")), F.lit(0))
    signal = F.coalesce(F.concat(F.lit("sender_domain:"), "domain"), F.concat(F.lit("subject_keyword:"), "keyword"), F.when(F.col("in_thread"), "candidate_thread"))
    judged = own.join(threads, "thread_id", "left").withColumn("score", F.when(F.col("label").isNotNull(), 0).otherwise(score))
    passed = F.col("score") >= THRESHOLD
    reason = F.when(F.col("label").isNotNull(), F.concat(F.lit("excluded_label:"), "label")).when(passed, signal).otherwise("no_filter_signal")
    return judged.select("id", F.when(passed, "candidate").otherwise("rejected").alias("outcome"), reason.alias("reason"), F.col("score").cast("int").alias("score"))


def candidate_stats(emails: DataFrame, classes: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Mails still to classify and their characters."""
    from trailmark.operators.lists import candidates_to_classify

    return candidates_to_classify(emails, classes, model, prompt_version).agg(F.count("*").alias("candidates"), F.coalesce(F.sum(F.length("body_text")), F.lit(0)).alias("characters"))


def reprocessing(emails: DataFrame, classes: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Retained mails by the state of their classification."""
    kept = emails.where("body_retention_state = 'retained' AND body_text IS NOT NULL").select("id").join(classes.select(F.col("email_id").alias("id"), "model", "prompt_version"), "id", "left")
    none, same = F.col("model").isNull(), F.col("model") == model
    one = kept.agg(
        F.count("*").alias("retained"),
        count_if(same & (F.col("prompt_version") == prompt_version)).alias("up_to_date"),
        count_if(none).alias("unclassified"),
        count_if(F.col("model") != model).alias("stale_model"),
        count_if(same & (F.col("prompt_version") != prompt_version)).alias("stale_prompt"),
    )
    return one.withColumn("reprocess", F.col("unclassified") + F.col("stale_model") + F.col("stale_prompt"))


def stage_counts(emails: DataFrame, decisions: DataFrame, classes: DataFrame, apps: DataFrame, events: DataFrame) -> DataFrame:
    """How many rows each stage of the pipeline has (A33), one row each."""
    state, outcome = F.col("body_retention_state"), F.col("outcome")
    parts = [
        emails.agg(F.count("*").alias("raw_emails"), count_if(state == "metadata_only").alias("metadata_only"), count_if(state.isin("retained", "debugging")).alias("retained_bodies")),
        decisions.agg(F.count("*").alias("decisions"), count_if(outcome == "candidate").alias("candidates"), count_if(outcome == "rejected").alias("rejected")),
        classes.agg(F.count("*").alias("classified"), count_if(F.col("is_job_related")).alias("job_related")),
        apps.agg(F.count("*").alias("applications")),
        events.agg(F.count("*").alias("events")),
    ]
    out = None
    for p in parts:
        named = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("rows")) for c in p.columns])).alias("r")).select("r.*")
        out = named if out is None else out.unionByName(named)
    return out


def reconciliation(provider_ids: DataFrame, local: DataFrame) -> DataFrame:
    """Provider's message ids against local mails."""
    by = provider_ids.groupBy("id").agg(F.count("*").alias("n"))
    both = by.join(local.select("id", F.lit(True).alias("here")), "id", "full")
    there, here = F.col("n").isNotNull(), F.col("here").isNotNull()
    one = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("provider_messages"), count_if(there).alias("provider_unique"), count_if(here).alias("local"), count_if(there & ~here).alias("missing"), count_if(here & ~there).alias("extra"))
    return one.withColumn("duplicates", F.col("provider_messages") - F.col("provider_unique")).withColumn("reconciled", (F.col("missing") == 0) & (F.col("extra") == 0))


def token_costs(runs: DataFrame) -> DataFrame:
    """Tokens and costs by model (A38): a run's total is never less than its parts; costs have six decimals."""
    total = F.greatest("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return runs.groupBy("model").agg(F.count("*").alias("runs"), F.sum(total).alias("tokens"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("decimal(18,6)").alias("cost_usd"))


def confusion(judged: DataFrame) -> DataFrame:
    """judged: expected, predicted (boolean).  Counts, precision, recall and whether both reach the gates."""
    e, p = F.col("expected"), F.col("predicted")
    one = judged.agg(count_if(e & p).alias("tp"), count_if(~e & p).alias("fp"), count_if(e & ~p).alias("fn"), count_if(~e & ~p).alias("tn"))
    rated = one.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return rated.withColumn("passed", F.coalesce((F.col("precision") >= 0.9) & (F.col("recall") >= 0.85), F.lit(False)))


def pending_bodies(emails: DataFrame, decisions: DataFrame, provider: str) -> DataFrame:
    """Candidates whose body wasn't fetched yet, by id."""
    wanted = decisions.where("outcome = 'candidate'").select("id")
    return emails.where((F.col("provider") == provider) & (F.col("body_retention_state") == "metadata_only")).join(wanted, "id", "left_semi").select("id", "thread_id").orderBy("id")


def newest_state(states: DataFrame) -> DataFrame:
    """The state row of each provider that was updated last."""
    best = F.max_by(F.struct(*states.columns), F.struct("updated_at", "id")).alias("s")
    return states.groupBy(F.col("provider").alias("_p")).agg(best).select("s.*")


def next_action(state: DataFrame) -> DataFrame:
    """Adds next_action and next_reason, decided in this order.

    state: connected, reauth_required, sync_running, sync_failed, backfill_state, raw_emails, retained_bodies, unclassified, applications, last_error.
    """
    rules = [
        (F.col("reauth_required"), "connect_mail", F.lit("authorization must be renewed")),
        (~F.col("connected"), "connect_mail", F.lit("no account is connected")),
        (F.col("sync_running"), "wait_for_sync", F.lit("a sync is running")),
        (F.col("sync_failed") | F.col("backfill_state").eqNullSafe("failed"), "inspect_error", F.concat(F.lit("the last sync failed"), F.coalesce(F.concat(F.lit(": "), "last_error"), F.lit("")))),
        (F.col("raw_emails") == 0, "run_sync", F.lit("no mail is stored")),
        (~F.col("backfill_state").eqNullSafe("completed"), "continue_backfill", F.lit("the backfill has not finished")),
        (F.col("unclassified") > 0, "run_classification", F.concat(F.col("unclassified").cast("string"), F.lit(" candidates wait to be classified"))),
        ((F.col("applications") == 0) & (F.col("retained_bodies") == 0), "review_dashboard", F.lit("the filter kept no candidates")),
        (F.col("applications") == 0, "review_dashboard", F.lit("no candidate is an application")),
    ]
    action, reason = F.lit("review_dashboard"), F.lit("up to date")
    for when, a, r in reversed(rules):
        on = F.coalesce(when, F.lit(False))
        action, reason = F.when(on, F.lit(a)).otherwise(action), F.when(on, r).otherwise(reason)
    return state.withColumns({"next_action": action, "next_reason": reason})


def prompt_estimate(stats: DataFrame, chars_per_unit: int = 4, overhead: int = 300, completion: int = 500, input_rate: float | None = None, output_rate: float | None = None) -> DataFrame:
    """Tokens and cost before a run (F29), from candidate_stats; without rates the cost is null."""
    prompt = F.ceil(F.col("characters") / chars_per_unit) + F.col("candidates") * overhead
    done = F.col("candidates") * completion
    cost = F.lit(None).cast("decimal(18,6)") if input_rate is None or output_rate is None else ((prompt * input_rate + done * output_rate) / 1000).cast("decimal(18,6)")
    return stats.select("candidates", prompt.cast("long").alias("prompt_tokens"), done.cast("long").alias("completion_tokens"), (prompt + done).cast("long").alias("total_tokens"), cost.alias("cost_usd"))


def sync_progress(runs: DataFrame) -> DataFrame:
    """Adds progress (0 to 1) and remaining (null without a limit, 1 at least) to runs with processed, target, finished, max_messages."""
    progress = F.when(F.col("target").isNull(), F.col("finished").cast("double")).when(F.col("target") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("processed") / F.col("target")))
    return runs.withColumns({"progress": progress, "remaining": F.when(F.col("max_messages").isNotNull(), F.greatest(F.lit(1), F.col("max_messages") - F.col("processed")))})


def readable(emails: DataFrame) -> DataFrame:
    """Mails as a reader sees them: the body only where it is retained, else what must be fetched."""
    kept = F.col("body_retention_state").isin("retained", "debugging") & F.col("body_text").isNotNull()
    return emails.select("id", "subject", "from_addr", "sent_at", F.when(kept, F.col("body_text")).alias("body_text"), (~F.coalesce(kept, F.lit(False))).alias("must_fetch"))


def shown(apps: DataFrame) -> DataFrame:
    """Names that stand in for blank ones (P20)."""
    or_else = lambda c, text: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", text).otherwise(F.col(c))
    return apps.withColumns({"company": or_else("company", "Unknown company"), "role_title": or_else("role_title", "Role not available")})


def table_or_none(spark, name: str, columns: str) -> DataFrame:
    """A catalogue table, or none of its rows where it isn't there."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], columns)


def normalized_terms(terms: DataFrame) -> DataFrame:
    """term of filter terms, trimmed, lower-cased, without blanks and leading signs, once each."""
    plain = F.lower(F.trim(F.regexp_replace(F.trim("term"), r"^[@.]+|[.]+$", "")))
    return terms.select(plain.alias("term")).where("term <> ''").distinct()


def sync_stats(emails: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: mails, retained ones, candidates, the oldest and newest."""
    candidates = decisions.where("outcome = 'candidate'").select("id", F.lit(True).alias("candidate"))
    wide = emails.join(candidates, "id", "left")
    return wide.agg(F.count("*").alias("mails"), count_if(F.col("body_retention_state").isin("retained", "debugging")).alias("retained"), count_if(F.col("candidate")).alias("candidates"), F.min("sent_at").alias("oldest"), F.max("sent_at").alias("newest"))


def pipeline_status(stages: DataFrame, unclassified: DataFrame, state: DataFrame) -> DataFrame:
    """The state of a pipeline with its counts and what to do next (X36).  stages: of stage_counts; unclassified: of candidate_stats; state: one row."""
    counts = stages.groupBy().pivot("stage", ["raw_emails", "retained_bodies", "applications"]).agg(F.first("rows"))
    wide = state.join(F.broadcast(counts)).join(F.broadcast(unclassified.select(F.col("candidates").alias("unclassified"))))  # one row each
    return next_action(wide)
