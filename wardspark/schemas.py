"""Schemas of the tables this package reads and writes."""

ARTIFACTS = "path string, target string, content string"

# One finding; the columns before ``confidence`` and ``metadata`` follow the report format.
FINDINGS = (
    "finding_id string, rule_id string, family string, detector string, detector_ord int, seq array<int>, "
    "title string, category string, severity string, description string, file_path string, target string, "
    "line_number int, column_number int, code_snippet string, remediation string, cwe_id string, owasp_id string, "
    "confidence double, metadata map<string,string>"
)
FINDING_COLUMNS = [c.split(" ")[0] for c in FINDINGS.split(", ")]

CUSTOM_RULES = (
    "id string, name string, severity string, category string, pattern string, message string, remediation string, "
    "cwe string, owasp string, file_extensions array<string>"
)

# A saved report: the envelope and its findings, as written by ``sinks.reports``.
REPORT_FINDING = (
    "struct<id:string,title:string,category:string,severity:string,description:string,file_path:string,"
    "line_number:string,column_number:string,code_snippet:string,remediation:string,cwe_id:string,owasp_id:string,"
    "confidence:string,metadata:map<string,string>>"
)

# The audit trail: scan events and prompt events in one table.
AUDIT = (
    "event string, timestamp string, command string, target string, scanner_version string, files_scanned bigint, "
    "lines_scanned bigint, scan_duration_seconds double, security_score double, "
    "findings struct<total:bigint,critical:bigint,high:bigint,medium:bigint,low:bigint,info:bigint>, "
    "threat_score double, threat_level string, attack_vectors array<string>"
)

VERSION = "1.0.0"
TOOL = "wardspark"
