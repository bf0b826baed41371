"""Questions without words, with clashing columns, and as the rules' own data: the examples themselves are registered queries."""

from pyspark.sql import functions as F

from trailmark.operators import questions, router


def test_questions_without_words(spark):
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "  ?! "), (4, "salary"), (5, "last"), (6, "in 20255"), (7, "x" * 20_000)], "id long, question string")
    got = {r["id"]: r for r in router.routed(asked).collect()}
    assert all(r["route"] == "content" and r["template"] == "summary_counts" and r["list_limit"] is None and r["salary_min"] is None for r in got.values())
    assert got[6]["window_year"] is None
    assert {r["list_limit"] for r in questions.facets(asked).collect()} == {20}


def test_limits_amounts_and_periods(spark):
    cases = {
        "list 0 applications": (1, None, None, None), "show top 7 and 9": (7, None, None, None), "2024 things": (20, None, None, None), "give me 1,500": (1, None, None, None),
        "salary is 10 - 20": (10, 10, 20, None), "salary of $1.5k to 2 k": (1, 1500, 2000, None), "salary over 10 or under 5": (10, 10, None, None), "salary below £ 90,000.50": (90, None, 90000, None),
        "the salary at most 5k in 1999": (20, None, 5000, "calendar_year"), "salary of from 7": (7, 7, None, None), "past 9999 days": (20, None, None, "rolling_days"), "last 5 day this month": (5, None, None, "this_month"),
        "salary 20k to 10k, salary over 5k": (20, None, None, None), "during 1899": (20, None, None, None),
    }
    asked = spark.createDataFrame(list(enumerate(cases)), "id long, question string")
    got = {r["question"]: (r["list_limit"], r["salary_min"], r["salary_max"], r["window_kind"]) for r in questions.facets(asked).collect()}
    assert got == cases


def test_rules_are_tried_in_order(spark):
    """A question that several rules know goes to the first; each template of the rules can be reached."""
    reached = {r.template for r in router.RULES} | {router.OTHERWISE}
    asked = [(i, rule.template, " / ".join(p for name in (rule.says or rule.together[0]) for p in router.PHRASES.get(name, ("latest application", "by role", "linkedin indeed"))[:1])) for i, rule in enumerate(router.RULES)]
    alone = {r["id"]: r["template"] for r in router.routed(spark.createDataFrame(asked, "id long, expected string, question string")).collect()}
    all_of = " / ".join(q for _, _, q in reversed(asked))
    assert set(alone.values()) <= reached and alone[0] == "busiest_application_month"
    (both,) = router.routed(spark.createDataFrame([(all_of,)], "question string")).collect()
    assert both["template"] == router.RULES[0].template


def test_clashing_columns_stay_out(spark):
    asked = spark.createDataFrame([("How many remote applications?",)], "question string").withColumns({c: F.lit("x") for c in ("id", "kind", "said", "tokens")})
    (r,) = router.routed(asked).collect()
    assert (r["work_mode"], r["kind"], r["said"]) == ("remote", "x", "x")
