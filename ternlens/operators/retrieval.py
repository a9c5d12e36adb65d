"""Keyword retrieval — the first knowledge-base entry whose key occurs in the query.

Keys are indexed by their first characters, as many as the largest power of two that a key is long.  A text gives,
for each such width among the keys, one candidate per position: the characters that a key of this width can have
there.  Candidates meet the keys in an equi-join on the first characters and are compared in full, so the
work is positions times widths (the logarithm of the longest key), for any number of keys and lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _width(key: Column) -> Column:
    """Largest power of two up to the key's length; 0 for the empty key."""
    n = F.length(key)
    return F.when(n == 0, F.lit(0)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n)) - 1).cast("int"))


def key_occurrences(texts: DataFrame, ident: str, text: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """(``ident``, and the columns of ``keys``) for every key that occurs in a text; a row may repeat, once for each
    different continuation of the key in the text, since callers aggregate the rows anyway.
    A null text or key matches nothing; the empty key occurs in every text.
    """
    indexed = (keys.where(F.col(key).isNotNull()).withColumn("_width", _width(F.col(key)))
               .withColumn("_head", F.substring(F.col(key), F.lit(1), F.col("_width"))))
    # One row: the widths that occur, at most 32.
    widths = indexed.agg(F.array_sort(F.collect_set("_width")).alias("_widths"))

    def candidates(w: Column) -> Column:
        # A lookahead captures what stands at each position, and one character is consumed: linear in the text.
        at = F.concat(F.lit("(?s)(?=(.{"), w.cast("string"), F.lit(","), (2 * w - 1).cast("string"), F.lit("}))."))
        found = F.when(w == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(F.col("_text"), at, F.lit(1)))
        return F.transform(F.array_distinct(found), lambda x: F.struct(w.alias("w"), x.alias("x")))

    cand = (texts.select(F.col(ident), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
            .join(F.broadcast(widths))
            .select(ident, F.explode(F.flatten(F.transform("_widths", candidates))).alias("_c"))
            .select(ident, F.col("_c.x").alias("_x"), F.col("_c.w").alias("_width"),
                    F.substring(F.col("_c.x"), F.lit(1), F.col("_c.w")).alias("_head")))
    return (cand.join(indexed, ["_width", "_head"]).where(F.startswith(F.col("_x"), F.col(key)))
            .select(ident, *keys.columns))


def keyword_retrieve(events: DataFrame, kb: DataFrame, default: str | None = None,
                     query: str = "query") -> DataFrame:
    """Adds ``retrieved`` (document of the lowest ``key_pos`` matching key, else
    ``default``) and ``key_pos`` (null on a miss). ``kb``: key, key_pos, document."""
    q = events.select("id", F.lower(F.col(query)).alias("_q"))
    hits = key_occurrences(q, "id", "_q", kb.select("key", "key_pos"))
    best = hits.groupBy("id").agg(F.min(F.struct("key_pos", "key")).alias("_b")).select("id", "_b.key_pos", "_b.key")
    docs = kb.groupBy("key_pos", "key").agg(F.first("document").alias("_doc"))
    found = best.join(docs, ["key_pos", "key"]).select("id", "key_pos", "_doc")
    out = events.join(found, "id", "left")
    return out.withColumn("retrieved", F.coalesce(F.col("_doc"), F.lit(default))).drop("_doc")
