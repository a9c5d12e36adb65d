"""Chat logs → call events.

A user turn directly followed by an assistant turn is one call: query = the user
text, response = the assistant text (null → ""), context = the conversation's
first system text. App, model and tags come from explicit arguments, else the
defaults. "Next turn" is a blocked ``lead`` and the system text a partial/final
aggregate, so even one enormous conversation is never sorted by a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternlens.operators.sequence import first_per_key, next_in_order
from ternlens import constants as K
from ternlens.sources.tables import table


def conversation_events(spark: SparkSession, sf_dir: str, app: str | None = None, model: str | None = None,
                        tags: list[str] | None = None, conversations: DataFrame | None = None,
                        start_epoch: int = 1704067200) -> DataFrame:
    conv = conversations if conversations is not None else table(spark, sf_dir, "conversations")
    conv = conv.select("conv_id", "turn", "role", "text")
    pairs = (next_in_order(conv, "conv_id", "turn", ["role", "text"])
             .where((F.col("role") == "user") & (F.col("next_role") == "assistant")))
    ctx = first_per_key(conv, "conv_id", "turn", "text", where=F.col("role") == "system", name="ctx")
    df = pairs.join(ctx, "conv_id", "left")
    minutes = F.col("conv_id") * 100 + F.col("turn")
    return df.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.lit(app or K.DEFAULT_APP).alias("app_name"),
        F.timestamp_seconds(F.lit(start_epoch) + minutes * 60).alias("timestamp"),
        F.col("text").alias("query"),
        F.col("ctx").alias("context"),
        F.coalesce(F.col("next_text"), F.lit("")).alias("response"),
        F.lit(model or K.DEFAULT_MODEL).alias("model_name"),
        F.lit(0).alias("latency_ms"),
        F.array(*[F.lit(t) for t in (tags or [])]).cast("array<string>").alias("tags"),
    )
