"""The rule catalogue: what a rule id means, how severe it is and which standards it maps to.

Ids, categories, severities, CWE/OWASP ids and tags are fixed values; the prose is ours.
"""

from wardspark.catalog.severity import CATEGORIES as C

OWASP_LLM01 = "LLM01:2025-Prompt-Injection"
OWASP_LLM02 = "LLM02:2025-Insecure-Output-Handling"
OWASP_LLM03 = "LLM03:2025-Data-Poisoning"
OWASP_LLM04 = "LLM04:2025-Denial-of-Service"
OWASP_LLM05 = "LLM05:2025-Supply-Chain"
OWASP_LLM06 = "LLM06:2025-Sensitive-Info-Disclosure"
OWASP_LLM07 = "LLM07:2025-System-Prompt-Leakage"
OWASP_LLM08 = "LLM08:2025-Excessive-Agency"


def _rule(rule_id, category, severity, cwe, owasp, tags, title, description, remediation, good="", bad=""):
    return {
        "rule_id": rule_id, "title": title, "category": C[category], "severity": severity,
        "cwe_id": cwe, "owasp_id": owasp, "description": description, "remediation": remediation,
        "good_example": good, "bad_example": bad, "tags": tags,
    }


# Rule id, category, severity, CWE, OWASP id, tags.
RULES = [
    _rule("AST-DESER-001", "DESERIALIZATION", "CRITICAL", "CWE-502", OWASP_LLM05,
          ["pickle", "rce", "deserialization", "supply-chain", "ast"],
          "Pickle data is deserialised",
          "A pickle stream is loaded here. Whoever wrote the stream decides which code runs while it loads.",
          "Keep weights in safetensors, ONNX or JSON and load pickles only from sources you control.",
          "weights = load_file('model.safetensors')", "model = pickle.load(handle)"),
    _rule("AST-DESER-002", "DESERIALIZATION", "CRITICAL", "CWE-502", OWASP_LLM05,
          ["pytorch", "torch.load", "weights_only", "rce", "ast"],
          "torch.load without weights_only",
          "A checkpoint is loaded through the pickle path because weights_only=True is not given.",
          "Pass weights_only=True or store the checkpoint as safetensors.",
          "torch.load(path, weights_only=True)", "torch.load(path)"),
    _rule("AST-DESER-003", "DESERIALIZATION", "HIGH", "CWE-502", OWASP_LLM05,
          ["numpy", "joblib", "pickle", "ast"],
          "NumPy or joblib file loaded through pickle",
          "numpy.load with allow_pickle=True and joblib.load both run code held in the file.",
          "Leave allow_pickle off and use a plain array format.",
          "np.load(path, allow_pickle=False)", "np.load(path, allow_pickle=True)"),
    _rule("AST-DESER-004", "DESERIALIZATION", "CRITICAL", "CWE-502", OWASP_LLM05,
          ["yaml", "safe_load", "rce", "ast"],
          "YAML loaded with an unsafe loader",
          "An unsafe YAML loader can build any Python object named in the document.",
          "Call yaml.safe_load or give Loader=yaml.SafeLoader.",
          "yaml.safe_load(handle)", "yaml.load(handle, Loader=yaml.Loader)"),
    _rule("AST-EXEC-001", "CODE_INJECTION", "CRITICAL", "CWE-95", OWASP_LLM02,
          ["eval", "exec", "code-injection", "ast"],
          "Dynamic evaluation with eval or exec",
          "Text is evaluated as code; anyone who can influence the text can run code.",
          "Parse literals with ast.literal_eval, or evaluate in an isolated sandbox.",
          "ast.literal_eval(text)", "eval(text)"),
    _rule("AST-EXEC-002", "CODE_INJECTION", "HIGH", "CWE-78", OWASP_LLM02,
          ["subprocess", "command-injection", "os.system", "ast"],
          "Command run through a shell",
          "A command string reaches the system shell, so its arguments can add commands of their own.",
          "Pass an argument list with shell=False and validate every argument.",
          "subprocess.run(['git', 'status'])", "os.system(command)"),
    _rule("AST-LLMOUT-001", "LLM02", "CRITICAL", "CWE-94", OWASP_LLM02,
          ["llm-output", "eval-response", "rce", "ast"],
          "Model output is executed",
          "A model response reaches eval or exec. Text injected into the model's input becomes code on this host.",
          "Validate responses against a schema and run generated code only in a throwaway sandbox.",
          "Schema.model_validate_json(response)", "exec(response)"),
    _rule("AST-LLMOUT-002", "LLM02", "HIGH", "CWE-89", OWASP_LLM02,
          ["sql-injection", "llm-output", "ast"],
          "Model output interpolated into a query",
          "A query is assembled with an f-string that holds model output.",
          "Bind values as query parameters.",
          "cursor.execute(sql, (value,))", "cursor.execute(f'... {llm_text}')"),
    _rule("AST-AGENT-001", "LLM08", "HIGH", "CWE-862", OWASP_LLM08,
          ["excessive-agency", "agent-tools", "hitl", "ast"],
          "Agent tool registered without confirmation",
          "A tool is handed to an agent with its approval step switched off.",
          "Ask a person before state changes and grant the narrowest scope.",
          "agent.register_tool(tool, auto_approve=False)", "agent.register_tool(tool, auto_approve=True)"),
    _rule("AST-RAND-001", "CODE_INJECTION", "LOW", "CWE-338", "CWE-338",
          ["random", "secrets", "cryptography", "ast"],
          "Predictable randomness for a secret",
          "The random module is predictable; it must not produce tokens, salts or session ids.",
          "Use the secrets module.",
          "token = secrets.token_hex()", "token = str(random.random())"),
    _rule("AST-DEBUG-001", "LLM06", "MEDIUM", "CWE-489", OWASP_LLM06,
          ["debug-mode", "flask", "fastapi", "misconfiguration", "ast"],
          "Service started in debug mode",
          "A debug server exposes an interactive console and its environment.",
          "Switch debug off outside development.",
          "app.run(debug=False)", "app.run(debug=True)"),
    _rule("SEC-KEY-001", "API_KEY_LEAK", "CRITICAL", "CWE-798", OWASP_LLM06,
          ["openai", "api-key", "secret-leak", "regex"],
          "OpenAI key in the source", "An OpenAI secret key is written into the text.",
          "Revoke the key and read its successor from the environment or a vault.",
          "OpenAI(api_key=os.environ['OPENAI_API_KEY'])", "OpenAI(api_key='sk-...')"),
    _rule("SEC-KEY-002", "API_KEY_LEAK", "CRITICAL", "CWE-798", OWASP_LLM06,
          ["anthropic", "api-key", "secret-leak", "regex"],
          "Anthropic key in the source", "An Anthropic API key is written into the text.",
          "Revoke the key and read its successor from the environment or a vault."),
    _rule("SEC-KEY-003", "API_KEY_LEAK", "HIGH", "CWE-798", OWASP_LLM06,
          ["huggingface", "hf_token", "secret-leak", "regex"],
          "Hugging Face token in the source", "A Hugging Face access token is written into the text.",
          "Revoke the token and read its successor from the environment."),
    _rule("SEC-KEY-004", "API_KEY_LEAK", "HIGH", "CWE-798", OWASP_LLM06,
          ["vector-db", "pinecone", "qdrant", "secret-leak", "regex"],
          "Vector database key in the source", "A Pinecone or Qdrant key is written into the text.",
          "Load the key from the environment at start-up."),
    _rule("SEC-KEY-005", "API_KEY_LEAK", "MEDIUM", "CWE-798", OWASP_LLM06,
          ["secret-leak", "password", "token", "regex"],
          "Generic secret in the source", "A private key, password or bearer token is written into the text.",
          "Move the secret into a secret manager."),
    _rule("SEC-PROMPT-001", "LLM01", "HIGH", "CWE-20", OWASP_LLM01,
          ["prompt-injection", "template-interpolation", "f-string", "regex"],
          "User input interpolated into a prompt",
          "User input is pasted into an instruction string, where it can act as an instruction.",
          "Keep instructions in the system role and user text in delimited user messages.",
          "messages = [system, user]", "prompt = f'Do this: {user_input}'"),
    _rule("SEC-PROMPT-002", "LLM06", "HIGH", "CWE-200", OWASP_LLM06,
          ["prompt-leak", "sensitive-prompt", "regex"],
          "Credentials inside a system prompt",
          "A system prompt holds a credential; prompts can be drawn out of a model.",
          "Take credentials out of prompts."),
    _rule("SEC-NET-001", "INSECURE_COMMUNICATION", "HIGH", "CWE-319", OWASP_LLM05,
          ["http", "tls", "mitm", "supply-chain", "regex"],
          "Model weights fetched over plain HTTP",
          "Weights travel unencrypted and can be swapped on the way.",
          "Fetch weights over HTTPS and verify a checksum."),
    _rule("SEC-DOS-001", "LLM04", "MEDIUM", "CWE-400", OWASP_LLM04,
          ["dos", "token-bomb", "resource-exhaustion", "regex"],
          "Completion call without a token limit",
          "The call sets no max_tokens, so one request can consume an unbounded budget.",
          "Set max_tokens and a timeout on every call."),
    _rule("SEC-POISON-001", "LLM03", "MEDIUM", "CWE-20", OWASP_LLM03,
          ["data-poisoning", "rag", "fine-tuning", "regex"],
          "Scraped text indexed without checks",
          "Crawled text goes straight into an index that a model reads from.",
          "Validate sources and contents before indexing."),
    _rule("SEC-RAG-001", "UNVALIDATED_RAG", "MEDIUM", "CWE-89", OWASP_LLM08,
          ["vector-db", "rag", "metadata-filter", "regex"],
          "Raw input in a vector filter",
          "A vector search filter is built from unchecked input.",
          "Check filters against a schema."),
    _rule("OWASP-LLM07-001", "LLM10", "MEDIUM", "CWE-200", OWASP_LLM07,
          ["system-prompt", "leakage", "owasp-llm07"],
          "System prompt without a disclosure rule",
          "The system prompt does not tell the model to keep its instructions to itself.",
          "State in the prompt that its contents must not be disclosed."),
    _rule("OWASP-LLM08-002", "LLM08", "CRITICAL", "CWE-862", OWASP_LLM08,
          ["agent", "python-repl", "bash", "owasp-llm08"],
          "Agent holds an unsandboxed interpreter",
          "An interpreter or shell tool is given to an agent without isolation.",
          "Run agent code in a short-lived sandbox with no network."),
    _rule("OWASP-LLM05-002", "LLM05", "LOW", "CWE-829", OWASP_LLM05,
          ["huggingface", "from_pretrained", "revision", "supply-chain", "owasp-llm05"],
          "Pretrained model without a pinned revision",
          "from_pretrained follows whatever the upstream repository holds today.",
          "Pin revision to a commit hash."),
    _rule("OWASP-LLM02-003", "LLM02", "HIGH", "CWE-79", OWASP_LLM02,
          ["xss", "unsafe_allow_html", "llm-output", "owasp-llm02"],
          "Model output rendered as raw HTML",
          "Model text is rendered without escaping, so it can carry scripts.",
          "Escape or sanitise the text first."),
]

# Rules that live in their detectors rather than in the catalogue
# (id, category, severity, CWE, OWASP id).
DETECTOR_RULES = [
    _rule("RAG-INJ-001", "UNVALIDATED_RAG", "HIGH", "CWE-20", OWASP_LLM01, [],
          "Retrieved context placed in the system role", "",
          "Put retrieved text in user messages inside data tags."),
    _rule("RAG-VEC-001", "UNVALIDATED_RAG", "HIGH", "CWE-89", OWASP_LLM08, [],
          "Vector filter built by string formatting", "",
          "Pass filter values as parameters."),
    _rule("RAG-LOADER-001", "UNVALIDATED_RAG", "MEDIUM", "CWE-918", OWASP_LLM05, [],
          "Document loader fed from a URL", "",
          "Check document addresses and headers before parsing."),
    _rule("RAG-SSL-001", "INSECURE_COMMUNICATION", "HIGH", "CWE-295", "LLM03:2025-Training-Poisoning", [],
          "Document loader ignores TLS certificates",
          "Pages are loaded into the index without certificate checks, so a relay can alter them.",
          "Verify certificates on every crawl."),
    _rule("AGENT-TOOL-SHELL", "LLM08", "CRITICAL", "CWE-862", OWASP_LLM08, [],
          "Agent tool reaches a shell",
          "A registered tool runs commands without a sandbox or an approval step.",
          "Run such tools in a restricted container and ask before each use."),
    _rule("AGENT-AUTO-APPROVE", "LLM08", "HIGH", "CWE-862", OWASP_LLM08, [],
          "Agent approval step switched off",
          "The configuration lets the agent act without a person confirming.",
          "Ask for confirmation before state changes and external calls."),
    _rule("AGENT-FS-WRITE", "LLM08", "HIGH", "CWE-73", OWASP_LLM08, [],
          "Agent tool writes to any path",
          "A write or delete tool takes a path that nothing confines.",
          "Confine the tool to a scratch directory and resolve paths first."),
    _rule("MODEL-CUSTOM-CODE-001", "LLM05", "CRITICAL", "CWE-94", OWASP_LLM05, [],
          "Model configuration names remote code",
          "config.json refers to code that is fetched and run when remote code is trusted.",
          "Read that code first and leave trust_remote_code off."),
]

# Weight-file suffixes that can carry code.
UNSAFE_WEIGHT_FORMATS = {
    "bin": "a pickled PyTorch or Hugging Face weight file",
    "pt": "a PyTorch archive that needs weights_only=True",
    "pth": "a PyTorch checkpoint with a pickled state",
    "pkl": "a raw pickle",
    "joblib": "a joblib dump, which is a pickle",
    "h5": "an HDF5 model that may hold Lambda layers",
}
