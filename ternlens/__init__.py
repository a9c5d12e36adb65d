"""ternlens — quality analytics for language-model call logs, expressed as Spark jobs.

Scored-call records, health scores, drift, RAG grounding, threshold alerts with
event-time cooldown and golden-set regression suites, all as DataFrame and
Structured Streaming transformations.
"""

from ternlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
