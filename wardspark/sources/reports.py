"""Saved reports and audit trails read back."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardspark.catalog.severity import SEVERITY_NAMES
from wardspark.functions.identifiers import rule_base, rule_family
from wardspark.schemas import AUDIT, FINDING_COLUMNS, REPORT_FINDING


def load_baseline(spark: SparkSession, path: str, wholetext: bool | None = None) -> DataFrame:
    """Findings of saved JSON reports: one report per line, or per file with ``wholetext``.

    Without a word on the form, the first line decides: a whole report there means one per line. A line or file that is not
    blank and no report is an error, since a baseline that loses findings makes them look new.
    """
    if wholetext is None:
        first = spark.read.text(path).limit(1)
        wholetext = first.where(_envelope("value").isNotNull()).isEmpty()
    reports = spark.read.text(path, wholetext=wholetext)
    broken = F.raise_error(F.concat(F.lit("no report: "), F.substring("value", 1, 60))).cast("string")
    return baseline_findings(reports.select(F.when(_envelope("value").isNotNull(), F.col("value")).when(~F.col("value").rlike(r"\A\s*\z"), broken).alias("value")), "value")


def _envelope(column: str) -> Column:
    """The findings of a report, as text; null if it is none."""
    return F.get_json_object(column, "$.findings")


def baseline_findings(reports: DataFrame, column: str = "value") -> DataFrame:
    """Findings in report documents. One without id, title or a known severity, or with a number that cannot be
    read, is skipped; other gaps get defaults."""
    shape = f"target_path string, findings array<{REPORT_FINDING}>"
    parsed = reports.select(F.from_json(column, shape).alias("r")).select(F.col("r.target_path").alias("target"), F.explode("r.findings").alias("f"))
    numbers = {"line_number": ("int", 0), "column_number": ("int", 1), "confidence": ("double", 0.95)}
    kept = parsed.where(F.col("f.id").isNotNull() & F.col("f.title").isNotNull() & F.col("f.severity").isin(SEVERITY_NAMES))
    for name, (kind, _) in numbers.items():
        kept = kept.where(F.col(f"f.{name}").isNull() | F.col(f"f.{name}").try_cast(kind).isNotNull())
    number = lambda name: F.coalesce(F.col(f"f.{name}").try_cast(numbers[name][0]), F.lit(numbers[name][1]))
    text = lambda name: F.coalesce(F.col(f"f.{name}"), F.lit(""))
    metadata = F.coalesce("f.metadata", F.create_map().cast("map<string,string>"))
    return kept.select(
        F.col("f.id").alias("finding_id"), F.coalesce(F.try_element_at(metadata, F.lit("rule_id")), rule_base(F.col("f.id"))).alias("rule_id"),
        rule_family(F.col("f.id")).alias("family"), F.try_element_at(metadata, F.lit("detector")).alias("detector"),
        F.lit(0).alias("detector_ord"), F.array(F.lit(0)).alias("seq"), F.col("f.title").alias("title"), text("category").alias("category"),
        F.col("f.severity").alias("severity"), text("description").alias("description"), text("file_path").alias("file_path"), "target",
        number("line_number").alias("line_number"), number("column_number").alias("column_number"), text("code_snippet").alias("code_snippet"),
        text("remediation").alias("remediation"), text("cwe_id").alias("cwe_id"), text("owasp_id").alias("owasp_id"),
        number("confidence").alias("confidence"), metadata.alias("metadata"),
    ).select(FINDING_COLUMNS)


def parse_audit(lines: DataFrame, column: str = "value") -> DataFrame:
    """Audit entries from JSON lines; lines that are not entries are dropped."""
    return lines.select(F.from_json(column, AUDIT).alias("e")).where(F.col("e.event").isNotNull()).select("e.*")


def last_entries(entries: DataFrame, limit: int = 50) -> DataFrame:
    """The newest entries, oldest of them first."""
    return entries.orderBy(F.desc("timestamp"), F.desc("target")).limit(limit).orderBy("timestamp", "target")


def read_audit(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The last entries of a trail. Its folders are one for each day, so days are read from the newest backwards, twice as many each time, until
    there are enough entries. Files that lie outside such folders are always read."""
    days, loose = _audit_folders(spark, path)
    if not days:
        return last_entries(parse_audit(spark.read.option("recursiveFileLookup", "true").text(path)), limit)
    names, taken = sorted(days, key=lambda d: (d[0].isdigit(), d), reverse=True), 1
    while True:
        entries = parse_audit(spark.read.text([folder for name in names[:taken] for folder in days[name]] + loose))
        if taken >= len(names) or entries.limit(limit).count() >= limit:
            return last_entries(entries, limit)
        taken *= 2


def _audit_folders(spark: SparkSession, path: str) -> tuple[dict[str, list[str]], list[str]]:
    """The folders of each day, of appended and of streamed entries, and files beside them."""
    top = path.rstrip("/")
    root = spark._jvm.org.apache.hadoop.fs.Path(top)
    system = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    listed = lambda pattern: list(system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{pattern}")) or [])
    days: dict[str, list[str]] = {}
    for status in listed("day=*") + listed("stream=*/batch_id=*/day=*"):
        days.setdefault(status.getPath().getName().removeprefix("day="), []).append(status.getPath().toString())
    names = [s.getPath().getName() for s in listed("*") if s.isFile()]
    return days, [f"{top}/{name}" for name in names if name[0] not in "._"]
