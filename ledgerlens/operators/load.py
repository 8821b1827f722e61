"""Batch load into the star schema: idempotent, repeat-safe, first writer wins.

Order inside one load: clean -> in-batch dedup (first row) -> code join -> row category ->
stage the batch -> new merchants (first row per merchant, existing ones untouched) -> append ->
new transactions (anti-join on the fingerprint) -> append. Every step is set-based; a failed
load can simply be run again, because both appends skip what is already there.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens import defaults as D
from ledgerlens import schemas as S
from ledgerlens.operators.categorise import CODE_CATEGORY, classify_codes, lookup_codes, stored_code
from ledgerlens.operators.clean import clean_first, with_fingerprint
from ledgerlens.operators.dimension import first_writer_categories
from ledgerlens.operators.joins import broadcast_if_small, with_known_rows
from ledgerlens.operators.rollups import default_budgets
from ledgerlens.session import drop_staged, staging_path
from ledgerlens.sources.codelist import read_code_list
from ledgerlens.sources.literal import literal_table

log = logging.getLogger(__name__)

FACT_COLUMNS = [
    "transaction_hash", "transaction_date", "year_month", "amount",
    "description", "merchant", "transaction_code",
]


def prepare_batch(raw: DataFrame, codes: DataFrame, observation: Observation | None = None,
                  strip_thousands: bool = False) -> DataFrame:
    """Cleaned, de-duplicated (first row per fingerprint) batch rows with the code-table
    category of each row's code (a broadcast lookup). The keyword cascade runs later, on one
    row per new merchant."""
    return lookup_codes(clean_first(raw, strip_thousands=strip_thousands, observation=observation), codes)


def batch_facts(batch: DataFrame) -> DataFrame:
    """Fact rows of a prepared batch; the code is kept only when it is in the code table."""
    code = stored_code() if CODE_CATEGORY in batch.columns else F.col("transaction_code")
    return batch.select(
        "transaction_hash", "transaction_date", "year_month", "amount", "description",
        F.col("merchant_name").alias("merchant"), code.alias("transaction_code"),
    )


def new_transactions(batch: DataFrame, existing: DataFrame | None, prune_months: bool = True) -> DataFrame:
    """Batch facts whose fingerprint is not stored yet.

    The fingerprint covers the date, so equal fingerprints have equal months. With
    ``prune_months`` the stored table is first restricted to the batch's months (one row per
    calendar month reaches the driver), which a table partitioned by ``year_month`` answers by
    listing only those partition folders: a daily batch reads a month or two of a many-year
    fact table, and one stray old date adds one month. Call it on a stored (staged) batch; the
    months are computed with one small job.

    Only fingerprints are shuffled to count the stored rows: a first load (none of its rows stored)
    and a repeat (all of them) need no more. A mixed batch takes a left anti join on month and
    fingerprint."""
    facts = batch_facts(batch)
    if existing is None:
        return facts
    stored = existing.select("year_month", "transaction_hash")
    if prune_months:
        months = sorted(r["year_month"] for r in facts.select("year_month").distinct().collect())
        if not months:
            return facts.limit(0)
        stored = stored.filter(F.col("year_month").isin(months))
    if stored.isEmpty():
        return facts
    key = ["year_month", "transaction_hash"]
    known = facts.select("transaction_hash").join(stored.select("transaction_hash"), "transaction_hash", "left_semi").count()
    if known == 0:
        return facts
    if known == facts.count():
        return facts.limit(0)
    return facts.join(stored, key, "left_anti").select(*FACT_COLUMNS)


def new_merchants(batch: DataFrame, existing: DataFrame | None, keywords=None) -> DataFrame:
    return first_writer_categories(batch, existing=existing, keywords=keywords)


def seeded_categories(spark: SparkSession) -> DataFrame:
    """The seeded category dimension; ids are a hash of the name (no global counter)."""
    names = literal_table(spark, [(n,) for n in D.SEEDED_CATEGORIES], "name string")
    return with_known_rows(names.select(F.xxhash64("name").alias("category_id"), "name"), len(D.SEEDED_CATEGORIES))


@dataclass
class LoadReport:
    raw_rows: int
    bad_dates: int
    zero_amounts: int
    rejected_amounts: int
    batch_rows: int
    in_batch_duplicates: int
    inserted: int
    skipped: int
    new_merchants: int


class Warehouse:
    """Parquet star schema under one root folder: categories, codes, merchants, transactions
    (partitioned by month), budgets, overrides. One writer per warehouse at a time.

    Overrides: a category that a user sets for a merchant wins over the rules and over the first
    writer, for stored and later rows, and survives a reset. The override table is the truth: it
    only grows, one append makes a change visible as a whole, and every view lays it over the
    category stored on the fact rows. :meth:`fold_overrides` then writes it into the months it
    touches, which changes no view; it may stop at any point and be run again."""

    TABLES = ("categories", "codes", "merchants", "transactions", "budgets", "overrides")

    def __init__(self, spark: SparkSession, root: str, keywords=None):
        """``keywords``: ordered (keyword, category) merchant rules; the defaults when None."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.keywords = keywords

    # -- paths and reads ------------------------------------------------------------------
    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(table))
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(jvm.org.apache.hadoop.fs.Path(self.path(table) + "/_SUCCESS")) or (
            fs.exists(p) and len(fs.listStatus(p)) > 0
        )

    def read(self, table: str) -> DataFrame:
        schema = {
            "categories": S.CATEGORIES, "codes": S.CODES, "merchants": S.MERCHANTS,
            "transactions": S.TRANSACTIONS, "budgets": S.BUDGETS, "overrides": S.OVERRIDES,
        }[table]
        if not self.exists(table):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(self.path(table))
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    # -- writes ---------------------------------------------------------------------------
    def initialise(self) -> None:
        """Create the tables if absent and seed the categories (insert-or-ignore)."""
        cats = seeded_categories(self.spark)
        existing = self.read("categories")
        missing = cats.join(existing.select("name"), "name", "left_anti").select("category_id", "name")
        if not self.exists("categories"):
            cats.write.mode("overwrite").parquet(self.path("categories"))
        elif missing.limit(1).count():
            self._append_staged(missing, "categories")
        for table in ("codes", "merchants", "transactions"):
            if not self.exists(table):
                empty = self.spark.createDataFrame([], getattr(S, table.upper()))
                writer = empty.write.mode("overwrite")
                if table == "transactions":
                    writer = writer.partitionBy("year_month")
                writer.parquet(self.path(table))

    def seed_codes(self, codes: DataFrame, rules=D.CODE_RULES) -> int:
        """Classify (code, description) pairs and insert the codes not stored yet
        (insert-or-ignore). A rule category that is not a known category becomes
        Uncategorised; a code given twice keeps one description (the smallest)."""
        classified = classify_codes(codes, rules)
        known = self.read("categories").select(F.col("name").alias("_known"))
        classified = classified.join(broadcast_if_small(known), F.col("category") == F.col("_known"), "left").select(
            "code", "description",
            F.when(F.col("_known").isNotNull(), F.col("category")).otherwise(F.lit(D.UNCATEGORISED)).alias("category"),
        )
        one = classified.groupBy("code").agg(
            F.min_by(F.struct("description", "category"), "description").alias("_r")).select("code", "_r.*")
        new = one.join(self.read("codes").select("code"), "code", "left_anti")
        return self._append_staged(new, "codes")

    def seed_codes_from_file(self, path: str) -> int:
        """Seed from a code-list text file; a missing file is skipped with a warning."""
        if not self._path_exists(path):
            log.warning("code list %s not found; code-based categories are limited", path)
            return 0
        return self.seed_codes(read_code_list(self.spark, path))

    def budgets_or_default(self, view: DataFrame) -> DataFrame:
        """Stored budgets, or every category of ``view`` (minus the excluded ones) with a zero
        limit when none are stored."""
        stored = self.read("budgets")
        return stored if stored.limit(1).count() else default_budgets(view)

    def _path_exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def load_statements(self, raw: DataFrame, strip_thousands: bool = False) -> LoadReport:
        """Idempotent append of one raw statement batch."""
        self._finish_fold()
        obs = Observation("clean")
        batch = prepare_batch(raw, self.read("codes"), observation=obs, strip_thousands=strip_thousands)
        stage = staging_path(self.spark, "batch")
        batch.drop("transaction_hash", "account_id").write.mode("overwrite").option("compression", "zstd").parquet(stage)  # cuts lineage; `seq` is fixed from here on
        metrics = obs.get
        staged = with_fingerprint(self.spark.read.parquet(stage))
        merchants = new_merchants(staged, self.read("merchants"), self.keywords)
        n_merchants = self._append_staged(merchants, "merchants")
        # Get-or-create for categories: a category named by the rules but not stored yet is added.
        named = self.read("merchants").select(F.col("category").alias("name")).distinct()
        missing = named.join(self.read("categories").select("name"), "name", "left_anti")
        self._append_staged(missing.select(F.xxhash64("name").alias("category_id"), "name"), "categories")
        facts = new_transactions(staged, self.read("transactions"))
        # Every merchant of the batch is stored now; attach its (immutable) category.
        merchant_cats = self.read("merchants").select("merchant", "category")
        inserted = self._append_facts(facts.join(merchant_cats, "merchant"))
        batch_rows = staged.count()
        drop_staged(self.spark, stage)  # every row of the batch is stored now
        kept = metrics.get("raw_rows", 0) - metrics.get("bad_dates", 0) - metrics.get("zero_amounts", 0)
        return LoadReport(
            raw_rows=metrics.get("raw_rows", 0), bad_dates=metrics.get("bad_dates", 0),
            zero_amounts=metrics.get("zero_amounts", 0), rejected_amounts=metrics.get("rejected_amounts", 0),
            batch_rows=batch_rows,
            in_batch_duplicates=kept - batch_rows, inserted=inserted,
            skipped=batch_rows - inserted, new_merchants=n_merchants,
        )

    def view(self) -> DataFrame:
        """The denormalised transaction view over the stored tables. The category is read from
        the fact rows (written at load time), so no join of the fact table with the merchant
        table is needed at query time; only the small code and category dimensions are joined."""
        from ledgerlens.operators.views import stored_transactions_view

        return stored_transactions_view(self._overlaid(), self.read("categories"), self.read("codes"))

    # -- overrides --------------------------------------------------------------------------
    def overrides(self) -> DataFrame:
        """(merchant, category): the override that holds for each merchant that has one."""
        table = self.read("overrides")
        return table.groupBy("merchant").agg(F.max_by("category", "version").alias("category"))

    def merchant_categories(self) -> DataFrame:
        """The merchant dimension with the overrides laid over it."""
        o = self.overrides().select("merchant", F.col("category").alias("_set"))
        joined = self.read("merchants").join(o, "merchant", "left")
        return joined.select("merchant", F.coalesce("_set", "category").alias("category"), F.col("_set").isNotNull().alias("overridden"))

    def set_overrides(self, chosen: DataFrame) -> int:
        """Set the category of merchants (columns merchant, category; the smallest category of a
        merchant given twice; rows with a null are left out); returns how many. A category not
        stored yet is added first, so a stop in between leaves a category without rows."""
        one = chosen.where("merchant is not null and category is not null").groupBy("merchant").agg(F.min("category").alias("category"))
        names = one.select(F.col("category").alias("name")).distinct()
        missing = names.join(self.read("categories").select("name"), "name", "left_anti")
        self._append_staged(missing.select(F.xxhash64("name").alias("category_id"), "name"), "categories")
        last = self.read("overrides").agg(F.max("version").alias("v")).first()["v"] or 0
        return self._append_staged(one.withColumn("version", F.lit(last + 1).cast("long")), "overrides")

    def clear_overrides(self, merchants: DataFrame) -> int:
        """Give merchants (column merchant) the category of the merchant table again."""
        held = self.overrides().select("merchant").join(merchants.select("merchant").distinct(), "merchant", "left_semi")
        return self.set_overrides(self.read("merchants").join(held, "merchant", "left_semi"))

    def _overlaid(self) -> DataFrame:
        """Fact rows with the overrides laid over their category."""
        facts = self.read("transactions")
        if not self.exists("overrides"):
            return facts
        o = self.overrides().select(F.col("merchant").alias("_om"), F.col("category").alias("_set"))
        joined = facts.join(broadcast_if_small(o), F.col("merchant") == F.col("_om"), "left")
        return joined.withColumn("category", F.coalesce("_set", "category")).select(*facts.columns)

    def fold_overrides(self) -> list[str]:
        """Write the overrides into the fact rows of the months that hold a row they change;
        returns these months. The new months are first written beside the table; once that copy is
        complete it replaces them, and a stop in between is finished by the next load or fold."""
        self._finish_fold()
        o = self.overrides().select(F.col("merchant").alias("_om"), F.col("category").alias("_set"))
        stale = self.read("transactions").join(broadcast_if_small(o), F.col("merchant") == F.col("_om"))
        stale = stale.where(~F.col("category").eqNullSafe(F.col("_set"))).select("year_month").distinct()
        months = sorted(r["year_month"] for r in stale.collect())  # one row per calendar month
        if months:
            rows = self._overlaid().where(F.col("year_month").isin(months))
            rows.hint("rebalance", "year_month").write.mode("overwrite").partitionBy("year_month").parquet(self.path(self.FOLD))
            self._finish_fold()
        return months

    FOLD = "fold-staging"

    def _finish_fold(self) -> None:
        """Let a complete copy of rewritten months replace them; drop an incomplete one. The files of the
        copy become the table's, month by month, without being written again: a month that the
        copy no longer holds is in place already, so a stop at any point is finished by the next call."""
        if not self._path_exists(self.path(self.FOLD)):
            return
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        copy = Path(self.path(self.FOLD))
        fs = copy.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if self._path_exists(self.path(self.FOLD) + "/_SUCCESS"):
            for month in [f.getPath() for f in fs.listStatus(copy) if f.isDirectory()]:  # one folder per calendar month
                place = Path(self.path("transactions"), month.getName())
                fs.delete(place, True)
                if not fs.rename(month, place):
                    raise OSError(f"{month} could not be moved to {place}")
            self.spark.catalog.refreshByPath(self.path("transactions"))
        fs.delete(copy, True)

    def save_budgets(self, budgets: DataFrame) -> None:
        """Replace the budget table."""
        stage = staging_path(self.spark, "budgets")
        budgets.select(F.col("category").cast("string"), F.col("monthly_limit").cast("double")) \
            .write.mode("overwrite").parquet(stage)
        self.spark.read.parquet(stage).write.mode("overwrite").parquet(self.path("budgets"))
        drop_staged(self.spark, stage)

    def reset(self) -> None:
        """Full reload: empty the fact and dimension tables (budgets and overrides are kept)."""
        self._finish_fold()
        for table in ("codes", "merchants", "transactions"):
            empty = self.spark.createDataFrame([], getattr(S, table.upper()))
            writer = empty.write.mode("overwrite")
            if table == "transactions":
                writer = writer.partitionBy("year_month")
            writer.parquet(self.path(table))

    def _append_facts(self, facts: DataFrame) -> int:
        """Append fact rows in one pass; the count is observed while they are written. An append
        only adds files, and the plan reads the files listed before it. The rows are rebalanced
        by month, so a month gets few files and a large month several tasks; their fingerprint, the
        column that compresses least, is taken again behind that shuffle."""
        seen = Observation("facts")
        rows = facts.drop("transaction_hash").hint("rebalance", "year_month").observe(seen, F.count(F.lit(1)).alias("n"))
        rows = with_fingerprint(rows).withColumn("created_at", F.current_timestamp())
        rows.select(*[f.name for f in S.TRANSACTIONS.fields]).write.mode("append").option("compression", "zstd").partitionBy("year_month").parquet(self.path("transactions"))
        return seen.get.get("n", 0)

    def _append_staged(self, df: DataFrame, table: str) -> int:
        """Write ``df`` to a staging folder first (it may read ``table`` itself), then append."""
        stage = staging_path(self.spark, table)
        df.write.mode("overwrite").parquet(stage)
        staged = self.spark.read.schema(df.schema).parquet(stage)
        n = staged.count()
        if n:
            staged.write.mode("append").parquet(self.path(table))
        drop_staged(self.spark, stage)
        return n
