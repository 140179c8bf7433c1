"""Writers: JSON, CSV, SARIF, bill of materials and audit trail."""
