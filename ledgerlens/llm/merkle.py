"""Document fingerprints: a Merkle tree over the pieces, paragraphs and sections of a text.

Method: a paragraph is a line; it is cut into pieces at sentence marks and after PIECE characters,
so that long unbroken lines have inner branches too. A section is a run of paragraphs that ends at
a blank line or after a paragraph whose last piece has a digest below SECTION_DIGITS (cut by
content, so an edit moves no section boundary but its own). A leaf is the digest of a piece, a
paragraph's digest is over its leaves, a section's over its paragraphs, the root's over the
sections. The fingerprint is the whole tree as text:

    <root, 64 hex>:<section, 16 hex>=<leaves>;<section>=<leaves>...

with 16 characters a leaf: 13 hex digits of its piece's digest, the piece's length (two digits, 99
at most) and ``.`` (within a paragraph), ``,`` (a paragraph ends) or ``;`` (a section ends).
Equal roots mean equal texts; unequal trees are compared from the root down, only sections that
differ are opened (``differing``), and the ``likeness`` of two trees is twice the length of the
pieces that both have over the length of the pieces of each (repeated pieces count once; 0 to 1, and
1 for equal trees, empty ones included).

All of it is built-in SQL functions: the tree is made inside a row from one array of leaves; no
text is shuffled for it. ``with_next`` finds the next row by id in one shuffle of the rows: rows are
dealt to id ranges of some 2,000 rows, and the first row of every range is also sent to the range
above, whose last row it follows. Range bounds are quantiles of a bounded sample of ids: they
decide balance only, the order is exact.

Edge cases: a null text is empty; an empty text has a root and no sections; a row with a null id
comes last; rows with equal ids follow each other by text digest, equal rows in any order; the only
row of a table follows itself; an empty table gives an empty result; extra columns are kept by
``fingerprints`` and ignored by ``edit_audit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import pinned

#: Characters of a piece without its closing marks.
PIECE = 64
#: A paragraph ends a section if its last leaf starts with one of these digits (one in eight does).
SECTION_DIGITS = "01"
#: Rows of an id range, unless that makes more than MOST_RANGES of them.
RANGE_ROWS = 2_000
MOST_RANGES = 1 << 18

_PIECES = rf"[^.!?\n]{{1,{PIECE}}}[.!?]*\n*|[.!?]+\n*|\n+"


def _leaf(piece: Column) -> Column:
    digest = F.substring(F.md5(piece), 1, 13)
    size = F.lpad(F.least(F.length(piece), F.lit(99)).cast("string"), 2, "0")
    ends = piece.endswith("\n\n") | F.substring(digest, 1, 1).isin(*SECTION_DIGITS)
    kind = F.when(~piece.endswith("\n"), ".").when(ends, ";").otherwise(",")
    return F.concat(digest, size, kind)


def leaves(text: Column) -> Column:
    """The leaves of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), _leaf)


def _section(leaf_text: Column) -> Column:
    paragraphs = F.transform(F.array_remove(F.split(leaf_text, ","), ""), lambda p: F.sha2(p, 256))
    return F.substring(F.sha2(F.array_join(paragraphs, ","), 256), 1, 16)


def tree(leaf_array: Column) -> Column:
    """The fingerprint of an array of leaves without its root (see ``with_root``)."""
    sections = F.array_remove(F.split(F.array_join(leaf_array, ""), ";"), "")
    return F.array_join(F.transform(sections, lambda s: F.concat(_section(s), F.lit("="), s)), ";")


def with_root(branches: Column) -> Column:
    """root:branches, the root over the digests of the sections."""
    return F.concat(F.sha2(F.regexp_replace(branches, "=[^;]*", ""), 256), F.lit(":"), branches)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two arrays of leaves (0 to 1)."""

    def size(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + F.substring(v, 14, 2).cast("long"))

    both, total = size(F.array_intersect(a, b)), size(F.array_distinct(a)) + size(F.array_distinct(b))
    return F.when(a == b, 1.0).when(total == 0, 0.0).otherwise(2 * both.cast("double") / total)


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 64)


def _sections(fingerprint: Column) -> Column:
    return F.array_remove(F.split(F.substring_index(fingerprint, ":", -1), ";"), "")


def differing(a: Column, b: Column) -> Column:
    """The paragraphs of fingerprint ``a`` that ``b`` does not have, as an array of
    (section, paragraph) numbers from 0; sections whose digest ``b`` has are not opened, and
    equal roots open nothing."""
    digests = F.transform(_sections(b), lambda s: F.substring_index(s, "=", 1))
    paragraphs = F.flatten(F.transform(_sections(b), lambda s: F.split(F.substring_index(s, "=", -1), ",")))

    def opened(s: Column, i: Column) -> Column:
        mine = F.array_remove(F.split(F.substring_index(s, "=", -1), ","), "")
        marked = F.transform(mine, lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), F.array_contains(paragraphs, p).alias("same")))
        found = F.transform(F.filter(marked, lambda m: ~m["same"]), lambda m: F.struct(m["section"].alias("section"), m["paragraph"].alias("paragraph")))
        return F.when(~F.array_contains(digests, F.substring_index(s, "=", 1)), found).otherwise(F.slice(found, 1, 0))

    everything = F.flatten(F.transform(_sections(a), opened))
    return F.when(root(a) == root(b), F.slice(everything, 1, 0)).otherwise(everything)


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text."""
    df = pinned(docs, "_leaves", leaves(F.coalesce(F.col(text_col), F.lit(""))))
    df = pinned(df, "_branches", tree(F.col("_leaves")))
    return df.withColumn(out, with_root(F.col("_branches"))).drop("_leaves", "_branches")


def _ranges(ids: DataFrame, range_rows: int) -> tuple[str, list]:
    """Upper bounds of the id ranges (ascending, joined by commas; 8 bytes for each range of
    ``range_rows`` rows pass the driver) and (range, its largest id) of every range with rows."""
    n = ids.count()
    wanted = min(MOST_RANGES, -(-n // range_rows))
    bounds = ""
    if wanted > 1:
        one_in = max(1, n // (64 * wanted))
        sample = ids.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0)
        shares = [k / wanted for k in range(1, wanted)]
        got = sample.agg(F.percentile_approx("id", shares, 64 * wanted).alias("q")).first()["q"]
        bounds = ",".join(str(x) for x in sorted(set(got or [])))
    heads = ids.groupBy(_range_of(F.col("id"), bounds).alias("r")).agg(F.max("id").alias("id")).orderBy("r").collect()
    return bounds, [(h["r"], h["id"]) for h in heads]


def _longs(text: str) -> Column:
    return F.from_json(F.lit(f"[{text}]"), "array<bigint>")


def _range_of(value: Column, bounds: str) -> Column:
    """Number of bounds below ``value`` (null: 0), by binary search."""
    n = bounds.count(",") + 1 if bounds else 0
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    if not steps:
        return F.lit(0)
    array = _longs(bounds)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= n) & (F.get(array, at + s - 1) < value), at + s).otherwise(at),
    )


def with_next(docs: DataFrame, columns: list[str], id_col: str = "id", key_col: str = "key", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows of ``docs`` with ``next_<c>`` for each column: its value in the next row by
    descending ``id_col`` (a whole number; nulls last), after the last in the first. Rows with
    equal ids are ordered by ``key_col``."""
    bounds, heads = _ranges(docs.select(F.col(id_col).alias("id")), range_rows)
    if not heads:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    above = {r: heads[(i + 1) % len(heads)][0] for i, (r, _) in enumerate(heads)}
    size = heads[-1][0] + 1
    largest = _longs(",".join(str(x) for x in _filled(dict(heads), size)))
    target = _longs(",".join(str(x) for x in _filled(above, size)))
    df = docs.withColumn("_range", _range_of(F.col(id_col), bounds))
    is_head = F.col(id_col).eqNullSafe(F.get(largest, F.col("_range")))
    here = F.array(F.col("_range"))
    copies = F.when(is_head, F.concat(here, F.array(F.get(target, F.col("_range")).cast("int")))).otherwise(here)
    df = df.select(*docs.columns, F.posexplode(copies).alias("_copy", "_to"))
    order = W.partitionBy("_to").orderBy("_copy", F.col(id_col).desc_nulls_last(), key_col)
    df = df.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return df.where("_copy = 0").drop("_copy", "_to")


def _filled(values: dict, size: int) -> list:
    return ["null" if values.get(i) is None else values[i] for i in range(size)]


def edit_audit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every text beside a copy whose second half the start of the next text replaces: sizes,
    fingerprints of both, the likeness of the text to its edited copy and to the next text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    df = pinned(df, "leaves", leaves(F.col("t"))).withColumn("key", F.xxhash64("t"))
    df = with_next(df, ["t", "leaves"], range_rows=range_rows)
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), F.length("t") - half), F.substring(F.col("next_t"), F.lit(1), half))
    df = df.withColumn("n_chars", F.length("t").cast("long"))
    df = pinned(df, "edited", edited)
    df = pinned(df, "edited_leaves", leaves(F.col("edited")))
    df = pinned(df, "branches", tree(F.col("leaves")))
    df = pinned(df, "edited_branches", tree(F.col("edited_leaves")))
    return df.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        with_root(F.col("branches")).alias("fingerprint"),
        with_root(F.col("edited_branches")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )
