"""Plug-in points: extra scorers (U1), systems under test (U2, see regression),
embedders (U3) and judges (U4).

A plug-in is code the user brings; it runs inside the executors over Arrow
batches (``mapInPandas``), one client per task, never per row on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ternlens.functions import text as TX


class Scorer(Protocol):
    """A third-party module adds score columns to the record frame."""
    name: str

    def apply(self, records: DataFrame) -> DataFrame: ...


@dataclass
class PandasScorer:
    """U1 helper: ``fn(pdf) -> pdf of new columns`` applied batch-wise inside a ``pandas_udf``.

    ``inputs`` are the columns ``fn`` reads; ``columns`` is the schema of what it adds.
    Only the inputs travel through Python; the new columns are unpacked from its struct in the same task.

    P6: if ``fn`` fails on a batch (it raises, or returns other rows or columns), the batch is tried again row by
    row; the rows on which it still fails get ``defaults`` (by column; null if not named) and a 1 in ``plugin_errors``, so one
    bad row or a broken plug-in doesn't end the job.
    """
    name: str
    fn: Callable[[pd.DataFrame], pd.DataFrame]
    inputs: list[str]
    columns: T.StructType
    defaults: dict | None = None

    def apply(self, records: DataFrame) -> DataFrame:
        fn, inputs, new = self.fn, self.inputs, [f.name for f in self.columns.fields]
        missing = {c: (self.defaults or {}).get(c) for c in new}
        schema = T.StructType([*self.columns.fields, T.StructField("plugin_errors", T.IntegerType())])

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            got = fn(pdf)[new]
            if len(got) != len(pdf):
                raise ValueError("a scorer returns one row for each row")
            return got.reset_index(drop=True).assign(plugin_errors=0)

        @F.pandas_udf(schema)
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                try:
                    yield whole(pdf)
                except Exception:  # noqa: BLE001 - the plug-in's own
                    rows = []
                    for k in range(len(pdf)):
                        try:
                            rows.append(whole(pdf.iloc[k:k + 1].reset_index(drop=True)).iloc[0].to_dict())
                        except Exception:  # noqa: BLE001
                            rows.append({**missing, "plugin_errors": 1})
                    yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in [*new, "plugin_errors"]})

        added = records.withColumn("_added", run(F.struct(*inputs)))
        return added.select(*records.columns, *[F.col("_added")[c].alias(c) for c in [*new, "plugin_errors"]])


def judge_scores(events: DataFrame, judge: Callable[[str, str | None, str], object],
                 out: str = "judge_score") -> DataFrame:
    """U4 + T10 + T11: call a judge per event inside the executors and parse its answer.

    ``judge(query, context, response)`` returns the raw answer text; the prompt (T10) is
    also attached for judges that want it verbatim. Parsing (trim → number → clamp,
    bad → null) is the Spark expression of T11.
    """
    with_prompt = events.withColumn("judge_prompt", TX.judge_prompt("query", "context", "response"))

    @F.pandas_udf("string")
    def answer(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, contexts, responses in batches:
            out_ = []
            for q, c, r in zip(queries, contexts, responses):
                try:
                    a = judge(q, c, r)
                    out_.append(None if a is None else str(a))
                except Exception:  # noqa: BLE001 - a failed judge call is a missing score
                    out_.append(None)
            yield pd.Series(out_, dtype=object)

    return (with_prompt.withColumn("_answer", answer("query", "context", "response"))
            .withColumn(out, TX.parse_judge_answer("_answer")).drop("_answer"))
