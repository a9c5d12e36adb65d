"""Labelled rows for the learned operators, without moving texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternlens.llm.common import crc_mod

#: At most about so many labelled rows train a classifier; beyond it a hash sample of them does.
MAX_LABELLED = 200_000


def training_labels(labels: DataFrame, label_col: str, folds: int, held_out: int, id_col: str = "doc_id",
                    bound: int = MAX_LABELLED) -> DataFrame:
    """(__lid, __y) of non-null labels outside the held-out fold; of a repeated identifier the largest label.

    Bounded, so the result may be broadcast: beyond ``bound`` rows a sample by the
    identifier's hash is taken (a tenth below the bound, so chance doesn't pass it).
    """
    rows = (labels.select(labels[id_col].alias("__lid"), labels[label_col].cast("int").alias("y"))
            .filter(F.col("__lid").isNotNull() & F.col("y").isin(0, 1))
            .filter(crc_mod("__lid", folds) != held_out)
            .groupBy("__lid").agg(F.max("y").alias("__y")))
    n = rows.count()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64("__lid"), F.lit(1 << 30)) < int(0.9 * bound / n * (1 << 30)))
    return F.broadcast(rows)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.join(labels, docs[id_col] == F.col("__lid"))
