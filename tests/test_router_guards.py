"""What a question lacks a word for is not looked for among its tokens."""

from pyspark.sql import functions as F

from trailmark.operators import router


def test_tokens_are_read_only_where_a_rule_may_hold(spark):
    asked = spark.createDataFrame([(1, "how many in 2024, 10k to 20k?"), (2, "a salary of at most 5k")], "id long, question string")
    assert [r["money"] is None for r in asked.select(router.amounts(F.col("question")).alias("money"), "id").orderBy("id").collect()] == [True, False]
    plan = router.routed(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" not in plan and "array_except" not in plan


def test_rules_by_bits_are_rules_by_names(spark):
    names = list(router.NAMES)
    said = [names[:k] for k in range(len(names) + 1)] + [[n] for n in names] + [list(t) for r in router.RULES for t in r.together]
    rows = spark.createDataFrame([(i, sum(1 << names.index(n) for n in s)) for i, s in enumerate(said)], "id long, said long")
    got = rows.select("id", *[r.holds(F.col("said")).alias(r.template) for r in router.RULES]).collect()
    assert len(got) == len(said)
    for g in got:
        held = set(said[g["id"]])
        for rule in router.RULES:
            assert g[rule.template] == bool(held & set(rule.says) or any(set(t) <= held for t in rule.together))
