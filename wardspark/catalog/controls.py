"""Compliance control domains and the identifiers that map findings to them."""

# Framework -> domain -> identifier substrings.
CONTROLS = {
    "soc2": {
        "CC6 — Logical & Physical Access Controls": ["LLM06", "CWE-798", "CWE-200", "SEC-KEY", "SEC-PROMPT"],
        "CC7 — System Operations": ["LLM02", "CWE-94", "CWE-78", "AST-EXEC", "AST-LLMOUT"],
        "CC8 — Change Management / Supply Chain": ["LLM05", "CWE-502", "AST-DESER", "SC-CVE"],
        "CC9 — Risk Mitigation": ["LLM01", "LLM03", "LLM04", "LLM08", "SEC-POISON", "SEC-RAG"],
        "A1 — Availability": ["LLM04", "CWE-400"],
    },
    "iso27001": {
        "A.8 — Application Security": ["LLM01", "LLM02", "CWE-94", "CWE-78", "AST-EXEC"],
        "A.8.24 — Cryptography & Secrets": ["CWE-798", "CWE-200", "SEC-KEY", "SEC-PROMPT"],
        "A.8.8 — Vulnerability Management": ["LLM05", "CWE-502", "AST-DESER", "SC-CVE"],
        "A.8.28 — Secure Coding": ["LLM02", "LLM03", "CWE-20", "CWE-89"],
        "A.5.23 — Third-Party / Supply Chain": ["LLM05", "SC-CVE"],
    },
}
