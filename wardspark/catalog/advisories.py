"""Bundled advisories for AI packages. Package, bound, id, severity, CWE and OWASP id are fixed values."""

# Package, vulnerable below, advisory id, severity, CWE, OWASP id; the last field is our summary.
_ROWS = [
    ("langchain", "0.1.17", "CVE-2024-21511", "CRITICAL", "CWE-94", "LLM05:2025-Supply-Chain", "code execution through crafted chain input"),
    ("langchain-core", "0.1.37", "CVE-2024-27444", "HIGH", "CWE-918", "LLM05:2025-Supply-Chain", "request forgery through a document loader"),
    ("transformers", "4.36.0", "CVE-2023-6730", "CRITICAL", "CWE-502", "LLM05:2025-Supply-Chain", "pickle code execution while loading checkpoints"),
    ("llama-cpp-python", "0.1.79", "CVE-2024-34359", "CRITICAL", "CWE-74", "LLM01:2025-Prompt-Injection", "template injection in chat formatting"),
    ("ollama", "0.1.29", "CVE-2024-37032", "CRITICAL", "CWE-22", "LLM05:2025-Supply-Chain", "path traversal while pulling models"),
    ("openai", "1.0.0", "CVE-2023-36258", "HIGH", "CWE-78", "LLM02:2025-Insecure-Output-Handling", "command execution through the interpreter tool"),
    ("mlflow", "2.9.2", "CVE-2024-27132", "HIGH", "CWE-22", "LLM05:2025-Supply-Chain", "path traversal in artifact downloads"),
    ("gradio", "4.19.2", "CVE-2024-1561", "CRITICAL", "CWE-22", "LLM06:2025-Sensitive-Info-Disclosure", "arbitrary file read"),
    ("dspy-ai", "2.4.0", "CVE-2024-35195", "HIGH", "CWE-918", "LLM05:2025-Supply-Chain", "request forgery in retrieval"),
    ("ray", "2.9.3", "CVE-2023-48022", "CRITICAL", "CWE-918", "LLM08:2025-Excessive-Agency", "job submission without authentication"),
    ("huggingface-hub", "0.23.0", "CVE-2024-3568", "HIGH", "CWE-502", "LLM05:2025-Supply-Chain", "pickle code execution from cached files"),
    ("chromadb", "0.4.24", "CVE-2024-29902", "HIGH", "CWE-287", "LLM06:2025-Sensitive-Info-Disclosure", "collections readable without authentication"),
    ("qdrant-client", "1.7.0", "CVE-2024-3024", "MEDIUM", "CWE-287", "LLM06:2025-Sensitive-Info-Disclosure", "embedded mode skips authentication"),
    ("torch", "2.2.0", "CVE-2024-5480", "CRITICAL", "CWE-502", "LLM05:2025-Supply-Chain", "code execution from pickled checkpoints"),
    ("litellm", "1.28.0", "CVE-2024-35796", "HIGH", "CWE-78", "LLM02:2025-Insecure-Output-Handling", "command injection in the proxy health check"),
    ("tensorflow", "2.15.0", "CVE-2023-33976", "HIGH", "CWE-125", "LLM05:2025-Supply-Chain", "out-of-bounds read in the compiler"),
]

ADVISORIES = [
    {"adv_ord": i, "package": pkg, "vulnerable_below": below, "cve": cve, "severity": sev, "cwe": cwe, "owasp": owasp,
     "description": f"{pkg} before {below}: {summary}.", "remediation": f"Upgrade to {pkg}>={below}."}
    for i, (pkg, below, cve, sev, cwe, owasp, summary) in enumerate(_ROWS)
]
