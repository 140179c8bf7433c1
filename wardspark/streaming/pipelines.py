"""Streaming forms of prompt scoring, artifact scanning and the audit trail.

Scoring and scanning decide everything inside a row, so they keep no state and run in append mode.
"""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from wardspark.operators.prompts import score_prompts
from wardspark.operators.scan import dedup_hits, resolve_findings, scan_artifacts


def stream_score_prompts(prompts: DataFrame, text_col: str = "text") -> DataFrame:
    """Scored prompts of a stream or a table."""
    return score_prompts(prompts, text_col)


def stream_scan_artifacts(artifacts: DataFrame, custom_rules: list[dict] | None = None, detectors: list[str] | None = None, advisories: DataFrame | None = None, **more) -> DataFrame:
    """Findings of a stream of artifacts, de-duplicated within each artifact: the same as of a table. ``more`` are further arguments of ``scan_artifacts``:
    signature and secret rules, detectors of the caller's own.

    Rules and advisories are static tables, so the joins with them keep no state.
    """
    scanned = scan_artifacts(artifacts, custom_rules, detectors, **more)
    return resolve_findings(scanned.withColumn("hits", dedup_hits(F.col("hits"))), advisories)


def stream_audit_append(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that gives each batch of each stream a directory of its own, with a directory per day in it.

    A batch that runs again replaces what it wrote before. The stream's id is the one its checkpoint keeps: streams with other
    checkpoints, also new ones at the same place, add to the trail and replace nothing. ``read_audit`` reads it together with what
    ``append_audit`` writes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        meta = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata")
        stream = meta.select(F.get_json_object("value", "$.id").alias("id")).first().id
        dated = batch.withColumn("day", F.substring("timestamp", 1, 10))
        dated.write.mode("overwrite").partitionBy("day").json(f"{path.rstrip('/')}/stream={stream}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
