"""What questions ask for, as columns: windows, limits, salaries, companies, the conversation that they stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators import names, router

# Phrases of newest mail, and words and beginnings that lean on an earlier question.
RECENCY = ("last email", "latest email", "most recent email")
POINTING = ("it", "its", "they", "them", "their", "theirs", "that", "those", "there", "this")
FOLLOWING = ("and ", "how about ", "what about ")


def facets(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds window_kind, window_days, window_year, list_limit, salary_min, salary_max to each question."""
    q = F.lower(F.coalesce(F.col(text), F.lit("")))
    read = questions.withColumns({"_q": q, "_spoken": router.tokens(q), "_money": router.amounts(q)})
    kind, days, year = router.period(F.col("_q"), F.col("_spoken"))
    low, high = router.salary_range(F.col("_money"))
    facts = {"window_kind": kind, "window_days": days, "window_year": year, "list_limit": router.requested_limit(F.col("_spoken")), "salary_min": low, "salary_max": high}
    return read.withColumns(facts).drop("_q", "_spoken", "_money")


def words(text: Column) -> Column:
    """The words of a text, lower-cased."""
    return F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")


def mentioned_companies(texts: DataFrame, companies: DataFrame, key: str, text: str) -> DataFrame:
    """key, company: companies whose name stands in a text as whole words, whatever its case."""
    return names.mentioned_names(texts, companies, key, text)


def lean(text: Column) -> Column:
    """Does a question need the ones before it: it points back, or begins as one that follows."""
    begins = F.ltrim(F.lower(text))
    out = F.arrays_overlap(words(text), F.array(*[F.lit(w) for w in POINTING]))
    for prefix in FOLLOWING:
        out = out | begins.startswith(prefix)
    return out


def with_context(chat: DataFrame, most: int = 20, needs=lean) -> DataFrame:
    """conversation_id, turn, question: each user turn with the questions that it leans on.

    Going back from a turn that leans, questions are taken up to the first that doesn't, among the last ``most`` messages; one running
    count of such questions gives every turn its stretch, so this is a window over each conversation."""
    w = Window.partitionBy("conversation_id").orderBy("turn")
    numbered = chat.withColumn("place", F.row_number().over(w)).where("role = 'user'")
    leaning = F.coalesce(needs(F.col("content")), F.lit(False))
    stretch = numbered.withColumn("leans", leaning).withColumn("part", F.sum((~F.col("leans")).cast("int")).over(w))
    before = Window.partitionBy("conversation_id", "part").orderBy("turn").rowsBetween(-most, -1)
    held = stretch.withColumn("before", F.collect_list(F.struct("place", "content")).over(before))
    near = F.reverse(F.filter("before", lambda b: b["place"] >= F.col("place") - most))
    context = F.array_join(F.transform(near, lambda b: F.concat(F.lit("Previous user question: "), b["content"])), "\n")
    asked = F.when(F.col("leans") & (F.size(near) > 0), F.concat(context, F.lit("\nCurrent user question: "), "content")).otherwise(F.col("content"))
    return held.select("conversation_id", "turn", asked.alias("question"))


def ungrounded(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """answer_id, claim, citation_id of citations that weren't retrieved for the answer (Q09).  answers: answer_id, claim, citation_ids."""
    named = answers.select("answer_id", "claim", F.explode("citation_ids").alias("citation_id"))
    return named.join(retrieved.select("answer_id", "citation_id").distinct(), ["answer_id", "citation_id"], "left_anti").select("answer_id", "claim", "citation_id")


def retrieval_modes(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds mode (exhaustive_companies, exhaustive_mentions, latest_company_email, semantic), term and category.

    A question for every mail that mentioned something is exhaustive; the term is what follows 'mentioned', without quotes and closing signs."""
    q = F.trim(F.col(text))
    low, said = F.lower(q), words(F.col(text))
    says = lambda *w: F.arrays_overlap(said, F.array(*[F.lit(x) for x in w]))
    at = F.instr(low, "mentioned ")
    rest = F.trim(F.rtrim(F.trim(F.substring(q, at + F.lit(len("mentioned ")), F.length(q))), F.lit("?.! ")))
    found = F.trim(F.btrim(rest, F.lit("\"'")))
    term = F.when(says("every") & (at > 0), F.nullif(found, F.lit("")))
    newest = F.lit(False)
    for phrase in RECENCY:
        newest = newest | low.contains(phrase)
    exhaustive = F.when(says("company", "companies"), "exhaustive_companies").otherwise("exhaustive_mentions")
    mode = F.when(term.isNotNull(), exhaustive).when(newest, "latest_company_email").otherwise("semantic")
    category = F.when(term.isNotNull() & says("rejection", "rejections"), "rejection")
    return questions.withColumns({"mode": mode, "term": term, "category": category})
