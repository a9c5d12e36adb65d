"""Exact deduplication by a content sort, in DataFrame functions only.

Normalised texts are range-partitioned by sampled splitters and sorted externally inside each partition, so that equal
texts are neighbours.  Each row is compared in full with the one before it: where they differ, a new run begins.  Texts
are ordered by content, then by length of the original (longest first) and identifier, so a run's first row is the one that stays.

The splitters are sampled on a key of bounded size (first bytes, 64-bit hash, salt), so that the sample on the driver
stays small whatever the texts' length.  The salt (a hash of the identifier) spreads copies of one text over up to
``SALTS`` runs in as many partitions, hence a text that a third of all rows share doesn't meet in one task.  A second content sort,
of the heads of runs that share first bytes and hash (at most ``SALTS`` for each text), compares these neighbours in full, too,
and joins the runs.  Equality is decided on whole texts only; SHA-256 is output.

Defined results: null text counts as empty; an empty table gives an empty table;
repeated rows (same identifier) are each returned; ties in length go to the smallest
identifier; a null identifier sorts last; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternlens.llm.common import discard, one_each, own, releasing, row_keys, rows_among, staged, with_row

SALTS = 64
KEY_CHARS = 8
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _runs(rows: DataFrame, place: list[str], out: str) -> DataFrame:
    """``rows`` with ``new`` (the text differs from the neighbour's before it) and ``out``, the number of the run of equal texts.

    Sorted by content inside each ``place``, whose columns are the keys of the range partitioning: that one is used as it is.
    """
    order = Window.partitionBy(*place).orderBy("norm", F.col("n").desc(), F.col("id").asc_nulls_last())
    to_here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("new", F.coalesce(F.lag("norm").over(order) != F.col("norm"), F.lit(True)))
            .withColumn(out, F.sum(F.col("new").cast("int")).over(to_here)))


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n (code points), its sorted run (head, h, salt, run), sha (of the normalised text), and at
    the run's first row ``new`` and the text itself (norm)."""
    rows = own(docs, id_col, text_col).select(
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
        normalised(F.col(text_col)).alias("norm"))
    keyed = rows.select(
        "id", "n", "norm",
        F.substring("norm", 1, KEY_CHARS).alias("head"),
        F.xxhash64("norm").alias("h"),
        F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    place = ["head", "h", "salt"]
    return (_runs(keyed.repartitionByRange(*place), place, "run")
            .select("id", "n", *place, "run", "new", F.unhex(F.sha2("norm", 256)).alias("sha"),
                    F.when(F.col("new"), F.col("norm")).alias("norm")))


def joined_runs(rows: DataFrame) -> DataFrame:
    """head, h, salt, run, keep (the identifier that stays) and group_size of every run of ``content_sort``."""
    run, text = ["head", "h", "salt", "run"], ["head", "h"]
    sizes = rows.groupBy(*run).agg(F.count("*").alias("size"))
    shared = rows.filter("new").groupBy(*text).agg(F.count("*").alias("k")).filter("k > 1").select(*text)
    heads = rows.filter("new").select("id", "n", "norm", *run).join(shared, text)
    again = _runs(heads.repartitionByRange(*text), text, "group").select("id", "n", *run, "group")
    group = Window.partitionBy(*text, "group")
    best = group.orderBy(F.col("n").desc(), F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    several = (again.join(sizes, run)
               .select(*run, F.first("id").over(best).alias("keep"), F.sum("size").over(group).alias("group_size")))
    alone = (rows.filter("new").select("id", *run).join(shared, text, "left_anti").join(sizes, run)
             .select(*run, F.col("id").alias("keep"), F.col("size").alias("group_size")))
    return several.union(alone)


@releasing
def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    rows = staged(content_sort(docs, id_col, text_col), "sorted")
    runs = staged(joined_runs(rows), "runs", slim=True)
    each = staged(rows.select("id", "head", "h", "salt", "run", "sha"), "rows")
    discard(rows)
    return each.join(runs, ["head", "h", "salt", "run"]).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), "group_size",
        F.coalesce(F.col("id") == F.col("keep"), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies, by identifier: repeated rows all stay, rows without an identifier go."""
    kept = exact_copies(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("__kept"))
    return docs.join(kept, docs[id_col] == F.col("__kept"), "left_semi")


@releasing
def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each class of equal texts, also of repeated rows and of rows without an identifier: the pipeline's form."""
    keys = row_keys(docs, id_col, text_col)
    kept = exact_copies(with_row(docs, keys, id_col, text_col), "row", "text").filter("kept").select("row")
    return one_each(rows_among(docs, keys.join(kept, "row", "left_semi"), id_col, text_col), id_col, text_col)
