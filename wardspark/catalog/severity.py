"""Severity and category vocabularies."""

# Severity name, weight, score penalty, SARIF level, SARIF security-severity.
SEVERITIES = [
    ("CRITICAL", 50, 25.0, "error", "9.5"),
    ("HIGH", 30, 15.0, "error", "7.5"),
    ("MEDIUM", 15, 5.0, "warning", "5.0"),
    ("LOW", 5, 1.5, "note", "2.5"),
    ("INFO", 1, 0.2, "none", "0.5"),
]

SEVERITY_NAMES = [s[0] for s in SEVERITIES]
WEIGHTS = {s[0]: s[1] for s in SEVERITIES}
PENALTIES = {s[0]: s[2] for s in SEVERITIES}
SARIF_LEVELS = {s[0]: s[3] for s in SEVERITIES}
SARIF_SCORES = {s[0]: s[4] for s in SEVERITIES}

# Finding categories.
CATEGORIES = {
    "LLM01": "LLM01: Prompt Injection & Jailbreak",
    "LLM02": "LLM02: Insecure Output Handling",
    "LLM03": "LLM03: Training/Fine-Tuning Data Poisoning",
    "LLM04": "LLM04: Model Denial of Service & Resource Exhaustion",
    "LLM05": "LLM05: Supply Chain & Insecure Checkpoints",
    "LLM06": "LLM06: Sensitive Information Disclosure",
    "LLM07": "LLM07: Insecure Plugin / Excessive Agency",
    "LLM08": "LLM08: Excessive Agency & Unsafe Autonomy",
    "LLM09": "LLM09: Overreliance & Lack of Guardrails",
    "LLM10": "LLM10: Model Theft & System Prompt Extraction",
    "DESERIALIZATION": "AI Deserialization & Unsafe Model Loading",
    "API_KEY_LEAK": "Hardcoded AI Secrets & Credentials",
    "UNVALIDATED_RAG": "Unvalidated RAG & Vector Injection",
    "CODE_INJECTION": "Dynamic Code Execution (eval/exec/subprocess)",
    "INSECURE_COMMUNICATION": "Insecure Model Endpoint & Network Protocol",
    "DATA_EXFILTRATION": "AI Data Exfiltration Risk",
}

# Category words accepted in custom rules.
CUSTOM_CATEGORIES = {
    "prompt_injection": CATEGORIES["LLM01"],
    "insecure_output": CATEGORIES["LLM02"],
    "supply_chain": CATEGORIES["LLM05"],
    "secret_leak": CATEGORIES["API_KEY_LEAK"],
    "deserialization": CATEGORIES["DESERIALIZATION"],
    "code_injection": CATEGORIES["CODE_INJECTION"],
    "excessive_agency": CATEGORIES["LLM08"],
}
