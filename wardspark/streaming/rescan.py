"""Re-scanning what changed, batch by batch.

The state of a re-scan is a log of tables in a folder: for every batch the content hash of each artifact that changed, and the findings it then
had. A batch reads the log before it, drops artifacts whose hash is the one already there, scans the rest, and
writes what it found: findings that are new, fixed or persisting. Nothing that a batch reads depends on what it writes, so a batch that runs
again, or was cut off half way, ends with the same tables.

Fingerprints do not name a folder, so two artifacts of a target may share one. State is cut into slots by target and file name: all rows of a fingerprint,
and all versions of an artifact, lie in one slot, and a batch reads the slots of its own artifacts. Every so many batches the whole state is written
once more, and the log before it is not read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from wardspark.functions.text import basename
from wardspark.operators.diff import diff_findings, persisting_only, with_fingerprint
from wardspark.operators.scan import dedup_hits, resolve_findings, scan_artifacts
from wardspark.plans.storage import written
from wardspark.schemas import FINDINGS

_PLACE = "full int, batch bigint, slot int"
_ARTIFACTS = f"target string, path string, content_sha string, removed boolean, {_PLACE}"
_FINDINGS = f"{FINDINGS}, fingerprint string, {_PLACE}"
_CHANGES = f"status string, fingerprint string, {FINDINGS}, batch bigint, slot int"
_KEYS = ["target", "path"]
_VERSION = ["slot", *_KEYS, "content_sha"]

# Bits of the map of versions that changed. Its size is fixed, whatever their number: more of them let more unchanged ones through to the scan, nothing is lost.
_MAP_BITS = 26


@dataclass
class Rescan:
    """State of a re-scan in ``folder``, which all executors share.

    ``rules_version`` names the rules in use: an artifact that comes again under another version counts as changed. ``slots`` must stay the same for a
    folder. ``scan`` holds arguments of ``scan_artifacts`` (such as ``custom_rules``) and ``advisories``.
    """

    folder: str
    rules_version: str = ""
    slots: int = 32
    compact_every: int = 20
    scan: dict | None = None

    def _at(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def _log(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """A table of the log; empty before the first batch."""
        location = self._at(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(location)
        if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(location)

    def _known(self, spark: SparkSession, name: str, schema: str, before: int, whole_before: int) -> DataFrame:
        """The rows of a log that count before a batch: the last whole state, and the batches after it."""
        log = self._log(spark, name, schema).where(F.col("batch") < before)
        last = self._log(spark, "artifacts", _ARTIFACTS).where((F.col("full") == 1) & (F.col("batch") < whole_before)).agg(F.max("batch")).first()[0]
        if last is None:
            return log.where("full = 0")
        return log.where(((F.col("full") == 1) & (F.col("batch") == last)) | ((F.col("full") == 0) & (F.col("batch") > last)))

    def artifacts(self, spark: SparkSession, before: int, slots: list[int] | None = None, whole_before: int | None = None) -> DataFrame:
        """The artifacts there are before a batch: ``target, path, content_sha, batch, slot`` of the last version of each. Whole states are
        looked for before ``whole_before`` if that is given."""
        rows = _in_slots(self._known(spark, "artifacts", _ARTIFACTS, before, before if whole_before is None else whole_before), slots)
        last = rows.groupBy("slot", *_KEYS).agg(F.max_by(F.struct("content_sha", "removed"), "batch").alias("last"), F.max("batch").alias("batch"))
        return last.where("NOT last.removed").select(*_KEYS, "last.content_sha", "batch", "slot")

    def findings(self, spark: SparkSession, before: int, slots: list[int] | None = None, whole_before: int | None = None) -> DataFrame:
        """The findings of the artifacts there are before a batch, with ``fingerprint`` and ``slot``."""
        whole_before = before if whole_before is None else whole_before
        current = self.artifacts(spark, before, slots, whole_before).select("slot", "batch", "target", F.col("path").alias("file_path"))
        rows = _in_slots(self._known(spark, "findings", _FINDINGS, before, whole_before), slots)
        return rows.join(current, ["slot", "batch", "target", "file_path"], "left_semi").drop("full", "batch")

    def apply(self, batch: DataFrame, batch_id: int, version_col: str | None = None, removed_col: str | None = None) -> None:
        """Takes in a batch of ``path, target, content``.

        Of several versions of an artifact in one batch the one with the greatest ``version_col`` counts (null is least; the greatest hash among equals, or
        where no column is named). Artifacts with a true ``removed_col`` go, and their findings are fixed. Rows without target or path are not taken in.
        """
        spark = batch.sparkSession
        rows = _keyed(batch, self.rules_version, self.slots, version_col, removed_col)
        latest = rows.groupBy("slot", *_KEYS).agg(F.max(F.struct("version", "content_sha", "removed")).alias("last"))
        latest = written(latest.select("slot", *_KEYS, "last.content_sha", "last.removed"), "incoming")
        slots = sorted(r.slot for r in latest.select("slot").distinct().collect())
        known = self.artifacts(spark, batch_id, slots).select("slot", *_KEYS, F.col("content_sha").alias("before"))
        differs = F.when(F.col("removed"), F.col("before").isNotNull()).otherwise(F.col("before").isNull() | (F.col("before") != F.col("content_sha")))
        changed = written(latest.join(known, ["slot", *_KEYS], "left").where(differs).select("slot", *_KEYS, "content_sha", "removed"), "changed")
        self._write(changed, "artifacts", 0, batch_id)
        wanted = changed.where("NOT removed").select(*_VERSION)
        self._write(self._scanned(rows.where("NOT removed"), wanted).select("*", _slot(F.col("target"), F.col("file_path"), self.slots).alias("slot")), "findings", 0, batch_id)
        found = self._log(spark, "findings", _FINDINGS).where((F.col("full") == 0) & (F.col("batch") == batch_id)).drop("full", "batch")
        gone = changed.select("slot", "target", F.col("path").alias("file_path"))
        before = self.findings(spark, batch_id, slots)
        touched = before.join(gone, ["slot", "target", "file_path"], "left_semi").select("slot", "target", "fingerprint").unionByName(found.select("slot", "target", "fingerprint")).distinct()
        old = before.join(touched, ["slot", "target", "fingerprint"], "left_semi")
        new = old.join(gone, ["slot", "target", "file_path"], "left_anti").unionByName(found)
        changes = diff_findings(old.drop("fingerprint"), new.drop("fingerprint"), by=("slot", "target"))
        changes.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self._at('changes')}/batch={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:  # the artifacts come last: they tell that the whole state is there
            self._write(self.findings(spark, batch_id + 1, whole_before=batch_id), "findings", 1, batch_id)
            whole = self.artifacts(spark, batch_id + 1, whole_before=batch_id).select("slot", *_KEYS, "content_sha", F.lit(False).alias("removed"))
            self._write(whole, "artifacts", 1, batch_id)

    def _scanned(self, rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Findings of the wanted versions. Texts are not shuffled: a map tells which to scan, and what was found is joined with the versions."""
        options = dict(self.scan or {})
        advisories = options.pop("advisories", None)
        scanned = scan_artifacts(_in_map(rows, wanted), **options, keep=("slot", "content_sha"))
        scanned = scanned.join(wanted, _VERSION, "left_semi").dropDuplicates(_VERSION)  # the same version may have come twice
        return with_fingerprint(resolve_findings(scanned.withColumn("hits", dedup_hits(F.col("hits"))), advisories))

    def _write(self, rows: DataFrame, name: str, full: int, batch_id: int) -> None:
        rows.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self._at(name)}/full={full}/batch={batch_id}")

    def changes(self, spark: SparkSession) -> DataFrame:
        """Per batch, the fingerprints of artifacts that changed, with ``status`` new, fixed or persisting and the finding as it is now, or was."""
        return self._log(spark, "changes", _CHANGES).drop("slot")

    def diff(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What ``diff_findings`` gives for the artifacts before and after a batch, without a scan: its changes, and whatever else there was persists."""
        changed = self._log(spark, "changes", _CHANGES).where(F.col("batch") == batch_id).drop("batch")
        before = self.findings(spark, batch_id)
        rest = before.join(changed.select("slot", "target", "fingerprint"), ["slot", "target", "fingerprint"], "left_anti").drop("fingerprint")
        return changed.unionByName(persisting_only(rest, by=("slot", "target"))).drop("slot")


def _in_slots(rows: DataFrame, slots: list[int] | None) -> DataFrame:
    return rows if slots is None else rows.where(F.col("slot").isin(slots))


def _map_place(bits: int) -> tuple:
    """Where a version stands in the map: the word, and the bit in it."""
    place = F.xxhash64(*_VERSION).bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftright(place, 6).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")


def _in_map(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose version is wanted, and few others: by a map that is sent to all tasks."""
    word, bit = _map_place(_MAP_BITS)
    words = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_set"))
    placed = rows.withColumns({"_word": word, "_bit": bit})
    return placed.join(F.broadcast(words), "_word").where(F.getbit("_set", F.col("_bit")) == 1).select(*rows.columns)


def _slot(target, path, slots: int):
    return F.pmod(F.xxhash64(target, basename(path)), F.lit(slots)).cast("int")


def _keyed(batch: DataFrame, rules_version: str, slots: int, version_col: str | None, removed_col: str | None) -> DataFrame:
    missing = F.col("content").isNull().cast("string")
    return batch.where("target IS NOT NULL AND path IS NOT NULL").select(
        *_KEYS, "content", F.sha2(F.concat_ws("\u0000", F.lit(rules_version), missing, F.coalesce("content", F.lit(""))), 256).alias("content_sha"),
        (F.col(version_col) if version_col else F.lit(0)).alias("version"), (F.coalesce(F.col(removed_col), F.lit(False)) if removed_col else F.lit(False)).alias("removed"),
        _slot(F.col("target"), F.col("path"), slots).alias("slot"))


def stream_rescan(artifacts: DataFrame, state: Rescan, checkpoint: str, version_col: str | None = None, removed_col: str | None = None) -> DataStreamWriter:
    """A writer that takes every batch of a stream of artifacts into the state."""
    return artifacts.writeStream.foreachBatch(lambda batch, batch_id: state.apply(batch, batch_id, version_col, removed_col)).option("checkpointLocation", checkpoint)
