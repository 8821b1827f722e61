from pyspark.sql import functions as F

from ledgerlens.functions.rules import first_match, match_with_rule_table, rule_groups, rule_table
from ledgerlens.functions.money import mean_half_up, ratio_half_even


def test_rule_groups_collapse_neighbours():
    assert rule_groups([("a", "X"), ("b", "X"), ("c", "Y"), ("d", "X")]) == [
        (["a", "b"], "X"), (["c"], "Y"), (["d"], "X")]


def test_order_matters(spark):
    df = spark.createDataFrame([("grab food order",)], "t string")
    a = df.select(first_match(F.col("t"), [("grab food", "Food"), ("grab", "Transport")]).alias("c")).first().c
    b = df.select(first_match(F.col("t"), [("grab", "Transport"), ("grab food", "Food")]).alias("c")).first().c
    assert (a, b) == ("Food", "Transport")


def test_case_form_equals_rule_table_form(spark):
    rules = [("pub ", "Utilities"), ("nus", "Education"), ("grab", "Transport"), ("bonus", "Income")]
    df = spark.createDataFrame([("nus bonus",), ("public",), ("pub bill",), ("grabfood",), ("none",)], "t string")
    case = {r.t: r.c for r in df.select("t", first_match(F.col("t"), rules).alias("c")).collect()}
    table = {r.t: r.c for r in match_with_rule_table(df, "t", rule_table(spark, rules), "c").collect()}
    assert case == table == {"nus bonus": "Education", "public": None, "pub bill": "Utilities",
                             "grabfood": "Transport", "none": None}


def test_exact_rounding(spark):
    df = spark.createDataFrame([(1225, 10000, 201, 2), (0, 5, -201, 2), (1, 3, 300, 3)], "n long, d long, s long, k long")
    out = df.select(ratio_half_even(F.col("n"), F.col("d"), 100, 1).alias("r"),
                    mean_half_up(F.col("s"), F.col("k")).alias("m")).collect()
    assert [r.r for r in out] == [12.2, 0.0, 33.3]  # 12.25 -> 12.2 (half-even)
    assert [r.m for r in out] == [1.01, -1.01, 1.0]  # 1.005 -> 1.01, -1.005 -> -1.01


def test_array_form_equals_case_form(spark):
    from ledgerlens.defaults import MERCHANT_KEYWORDS
    from ledgerlens.functions.rules import first_match_array

    df = spark.createDataFrame([("grab food x",), ("public",), ("nus bonus",), ("zzz",), ("fp*food panda",)], "t string")
    out = df.select(first_match(F.col("t"), MERCHANT_KEYWORDS).alias("a"),
                    first_match_array(F.col("t"), MERCHANT_KEYWORDS).alias("b")).collect()
    assert all(r.a == r.b for r in out) and out[0].a == "Food & Drink" and out[3].a is None


def test_group_array_form_equals_case_form(spark):
    from ledgerlens.defaults import CODE_RULES
    from ledgerlens.functions.rules import first_group_match, first_group_match_array

    texts = [("instant direct credit",), ("insurance premium",), ("fixed deposit interest",), ("adjustment",),
             ("cash withdrawal service charge",)]
    df = spark.createDataFrame(texts, "t string")
    out = df.select(first_group_match(F.col("t"), CODE_RULES).alias("a"),
                    first_group_match_array(F.col("t"), CODE_RULES).alias("b")).collect()
    assert [r.a for r in out] == [r.b for r in out] == ["Income", "Government & CPF", "Income", None, "Transfers"]


def test_rule_table_of_any_size_and_pattern_length(spark):
    import random

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 12))) for _ in range(200)] + ["", None, None]
    rules = [("".join(rnd.choice("abcd ") for _ in range(rnd.choice([1, 2, 3, 4, 5]))), f"v{i}") for i in range(150)]
    rules = [("zzzz", "never"), *rules[20:], ("", "empty"), *rules[:20]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for some in (rules, rules[:-21], [("", "all")]):
        out = match_with_rule_table(df, "t", rule_table(spark, some), "c").collect()
        want = {t: next((v for p, v in some if t is not None and p in t), None) for t in texts}
        assert len(out) == len(texts) and all(r.c == want[r.t] for r in out)
    plan = match_with_rule_table(df, "t", rule_table(spark, rules), "c")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
