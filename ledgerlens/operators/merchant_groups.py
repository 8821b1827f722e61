"""Groups of near-identical merchant names.

A name's skeleton is its upper-case letters (store numbers, blanks and punctuation say nothing
about who was paid); names with one skeleton are one class. Two skeletons are alike if their
edit distance is at most 1 (shorter one of 5 letters or more) or 2 (16 letters or more); a group is a
component of alike classes.

Candidates come from deletion neighbourhoods: two skeletons within k edits share a text that
both reach by deleting at most k letters, so no alike pair is missed (recall 1). A shared text
is held by no more skeletons than letters can be put into it, which bounds every
block by the alphabet and the name length, not by the number of merchants: a family of a third
of all names makes many small blocks instead of one large one. Candidates are verified by their
edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import drop_staged, staging_path

#: Letters of the shorter skeleton from which one, and from which two edits are allowed.
ONE_EDIT, TWO_EDITS = 5, 16


def skeleton(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), r"[^\p{L}]", "")


def allowed_edits(letters: Column) -> Column:
    return F.when(letters >= TWO_EDITS, 2).when(letters >= ONE_EDIT, 1).otherwise(0)


def _without(text: Column, at: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text)))


def variants(text: Column) -> Column:
    """64-bit keys of the text and of everything reached by as many deletions as it is allowed."""
    n = F.length(text)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: _without(text, i))
    two = F.flatten(F.transform(F.sequence(F.lit(2), n), lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda i: _without(_without(text, j), i))))
    found = F.when(n >= TWO_EDITS, F.concat(F.array(text), one, two)).otherwise(F.concat(F.array(text), one))
    return F.array_distinct(F.transform(found, lambda v: F.xxhash64(v)))


def alike_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of alike skeletons of a table of distinct ones (column ``class``)."""
    long = classes.where(F.length("class") >= ONE_EDIT)
    keys = long.select("class", F.explode(variants(F.col("class"))).alias("key"))
    other = keys.select(F.col("class").alias("b"), "key")
    pairs = keys.withColumnRenamed("class", "a").join(other, "key").where("a < b").select("a", "b").distinct()
    edits = allowed_edits(F.least(F.length("a"), F.length("b")))
    return pairs.where(F.levenshtein("a", "b") <= edits)


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for edges (a, b) of whole
    numbers. Every round takes the smallest label around each node and then the label's own
    label, so the rounds grow with the logarithm of a component's diameter. Rounds are written to
    the checkpoint folder; only counts reach the driver."""
    spark = edges.sparkSession
    staged: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = staging_path(spark, name)
        df.write.mode("overwrite").parquet(path)
        staged.append(path)
        return spark.read.schema(df.schema).parquet(path)

    one_way = keep(edges.select("a", "b").where("a <> b").distinct(), "group-edges")
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "group-labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = near.select(F.col("node").alias("via"), F.col("label").alias("to"))
        new = near.join(jump, near["label"] == jump["via"]).select("node", "old", F.least("label", "to").alias("label"))
        new = keep(new, "group-labels")
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        for path in staged[1:-1]:
            drop_staged(spark, path)
        del staged[1:-1]
        if not changed:
            return labels


def merchant_groups(merchants: DataFrame, name_col: str = "merchant") -> DataFrame:
    """(merchant, merchant_group, group_size) of every distinct name: the group is called after
    its smallest name, its size counts names. A name without letters is a group of its own; null
    names are left out."""
    names = merchants.where(F.col(name_col).isNotNull()).select(F.col(name_col).alias("merchant")).distinct()
    letters = skeleton(F.col("merchant"))
    names = names.withColumn("class", F.when(letters == "", F.col("merchant")).otherwise(letters))
    classes = names.where(skeleton(F.col("merchant")) != "").select("class").distinct()
    pairs = alike_pairs(classes)
    labels = component_labels(pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    names = names.withColumn("node", F.xxhash64("class")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = names.groupBy("label").agg(F.min("merchant").alias("merchant_group"), F.count("*").alias("group_size"))
    return names.join(groups, "label").select("merchant", "merchant_group", "group_size")


def spend_by_group(expenses: DataFrame, groups: DataFrame) -> DataFrame:
    """Spend and rows per merchant group."""
    per_name = expenses.groupBy("merchant").agg(F.sum("amount").alias("_sum"), F.count("*").alias("_n"))
    joined = per_name.join(groups, "merchant")
    return joined.groupBy("merchant_group").agg(F.abs(F.sum("_sum")).alias("spent"), F.sum("_n").alias("txns"), F.count("*").alias("names"))
