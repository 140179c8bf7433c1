"""Registered queries against their SQL twins. ``check.py`` runs all of them; here one of each kind runs on small tables."""

import pytest

import __spark_entry__ as contract
import check

SAMPLE = [
    "explode_lines", "line_totals", "decode_invalid_utf8", "signature_hit_counts", "advisory_exposure", "custom_rule_findings", "baseline_round_trip", "dependencies",
    "path_filters", "policy_gate", "rule_sec_dos_001", "rule_ast_deser_002", "rule_rag_inj_001", "secret_details", "model_artifacts", "supply_chain_findings", "resolved_calls",
    "prompt_scores", "hidden_payloads", "match_places", "version_order", "identifier_functions", "dedup_findings", "line_snippets", "scan_summary", "diff_findings",
    "controls_soc2", "domain_status_soc2", "sarif_rules", "sbom_documents", "audit_last_entries", "stream_prompt_scores", "stream_artifact_findings", "stream_audit_entries",
    "stream_page_findings", "stream_audit_two_streams", "custom_rule_status", "many_signatures", "signature_rule_findings", "advisory_file_findings", "extra_detector_findings",
    "policy_gate_fine", "domain_status_fine", "first_match_place",
]


@pytest.fixture(scope="module")
def database(sf_dir):
    return check.open_tables(sf_dir)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, database, sf_dir, name):
    difference, rows, _, _ = check.compare(spark, database, name, sf_dir)
    assert difference is None
    assert rows > 0 or name in ("match_places", "first_match_place", "stream_page_findings")  # their pattern first occurs at the next scale


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark, sf_dir):
    assert contract.entry(spark).count() == 3
