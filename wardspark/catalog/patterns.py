"""Line and whole-text patterns of the scanning detectors.

``anchors``: every match contains at least one of them (lower-case where the pattern ignores case).
"""

# Line patterns (rule id, pattern, ignore case).
LINE_PATTERNS = [
    {"rule_id": "SEC-KEY-001", "ignore_case": False, "anchors": ["sk-"],
     "pattern": r"(?:sk-[a-zA-Z0-9_-]\{20,T3BlbkFJ[a-zA-Z0-9_-]{20,}|sk-proj-[a-zA-Z0-9_-]{48,}|sk-[a-zA-Z0-9]{32,})"},
    {"rule_id": "SEC-KEY-002", "ignore_case": False, "anchors": ["sk-ant-"],
     "pattern": r"sk-ant-[a-zA-Z0-9_-]{32,}"},
    {"rule_id": "SEC-KEY-003", "ignore_case": False, "anchors": ["hf_"],
     "pattern": r"hf_[a-zA-Z0-9]{34,}"},
    {"rule_id": "SEC-KEY-004", "ignore_case": False, "anchors": ["pcsk_", "qdrant_api_key"],
     "pattern": r"""(?:pcsk_[a-zA-Z0-9_-]{32,}|qdrant_api_key\s*=\s*['"][a-zA-Z0-9_-]{20,}['"])"""},
    {"rule_id": "SEC-NET-001", "ignore_case": False, "anchors": ["http://"],
     "pattern": r"""http://(?:huggingface\.co|models\.|download\.|s3\.|storage\.)[^\s'"]+\.(?:safetensors|pt|pth|bin|onnx|pkl|h5|ckpt)"""},
    {"rule_id": "SEC-PROMPT-001", "ignore_case": True,
     "anchors": ["{user_input}", "{query}", "{input}", "{request}", "{prompt}"],
     "pattern": r"""(?:prompt|system_message|instruction)\s*=\s*f['"].*?(?:\{user_input\}|\{query\}|\{input\}|\{request\}|\{prompt\}).*?['"]"""},
    {"rule_id": "SEC-PROMPT-002", "ignore_case": True, "anchors": ["system_prompt", "system_message"],
     "pattern": r"""(?:system_prompt|system_message)\s*=\s*['"].*?(?:password\s*is|api_key\s*is|secret_token\s*=|root_pass).*?['"]"""},
    {"rule_id": "SEC-DOS-001", "ignore_case": False, "anchors": [".create", ".generate", ".complete"],
     "pattern": r"\.(?:create|generate|complete)\s*\((?![^)]*max_tokens)[^)]*model\s*="},
    {"rule_id": "SEC-POISON-001", "ignore_case": True, "anchors": [".add_documents", ".add_texts"],
     "pattern": r"(?:vector_db|vectorstore|collection)\.add_(?:documents|texts)\s*\([^)]*(?:scraped|crawl|unfiltered|raw_web)"},
]

# Entropy filter of the key rules.
KEY_RULE_PREFIX = "SEC-KEY-"
KEY_MIN_LENGTH, KEY_MIN_ENTROPY, KEY_EXEMPT = 10, 2.2, ["sk-", "hf_"]

# Substring checks (rule id, any of these, none of these), in evaluation order.
SUBSTRING_CHECKS = [
    {"rule_id": "OWASP-LLM05-002", "any": ["from_pretrained"], "none": ["revision="]},
    {"rule_id": "OWASP-LLM08-002",
     "any": ["PythonREPLTool", "BashProcess", "ShellTool", "TerminalTool", "PythonAstREPLTool"], "none": []},
    {"rule_id": "OWASP-LLM02-003",
     "any": ["unsafe_allow_html=True", "dangerouslySetInnerHTML", "render_template_string"], "none": []},
]

# Whole-text patterns (rule id, pattern, dot matches newline); all ignore case.
RAG_PATTERNS = [
    {"rule_id": "RAG-INJ-001", "dotall": True, "anchors": ["messages"],
     "pattern": r"(?:messages\s*=\s*\[.*?'role'\s*:\s*'system'.*?\b(?:context|retrieved_docs|doc_chunks|chunks)\b)"},
    {"rule_id": "RAG-VEC-001", "dotall": True, "anchors": [".query(", ".search("],
     "pattern": r"""(?:\.query\([^)]*filter\s*=\s*f["']|\.search\([^)]*filter\s*=\s*f["'])"""},
    {"rule_id": "RAG-LOADER-001", "dotall": True, "anchors": ["download_url", "load_from_url"],
     "pattern": r"(?:PyPDFLoader|UnstructuredFileLoader|PDFMinerLoader)\(.*?download_url|load_from_url"},
]
AGENT_PATTERNS = [
    {"rule_id": "AGENT-TOOL-SHELL", "dotall": True, "anchors": ["@mcp.tool", "@tool", "structuredtool.from_function"],
     "pattern": r"(?:@mcp\.tool|@tool|StructuredTool\.from_function).*?(?:subprocess|os\.system|shutil|exec|eval|pty\.spawn)"},
    {"rule_id": "AGENT-AUTO-APPROVE", "dotall": False,
     "anchors": ["human_in_the_loop", "require_confirmation", "auto_approve", "dangerously_allow_all_tools"],
     "pattern": r"(?:human_in_the_loop\s*=\s*False|require_confirmation\s*=\s*False|auto_approve\s*=\s*True|dangerously_allow_all_tools\s*=\s*True)"},
    {"rule_id": "AGENT-FS-WRITE", "dotall": False, "anchors": ["write_file", "delete_file", "remove_file", "shutil.rmtree"],
     "pattern": r"(?:write_file|delete_file|remove_file|shutil\.rmtree).*?(?:path|filepath|filename)\s*:\s*str"},
]

# Co-occurrence rule for loaders without certificate checks.
SSL_RULE_ID = "RAG-SSL-001"
SSL_LIBRARIES = ["langchain", "llama_index", "chromadb", "pinecone"]
SSL_LOADERS = ["RecursiveUrlLoader", "UnstructuredURLLoader"]
SSL_FLAGS = ["verify_ssl=False", "ssl_verify=False"]

# File selection.
SCAN_EXTENSIONS = [
    ".py", ".pyw", ".json", ".yaml", ".yml", ".env", ".prompt", ".txt", ".js", ".ts", ".jsx", ".tsx", ".sh", ".toml",
    ".bin", ".pt", ".pth", ".pkl", ".joblib", ".h5", ".onnx", ".safetensors",
]
BINARY_EXTENSIONS = [".bin", ".pt", ".pth", ".pkl", ".joblib", ".h5", ".onnx", ".safetensors"]
IGNORED_DIRECTORIES = [
    ".git", ".svn", "__pycache__", "node_modules", "venv", ".venv", "env", ".env", "dist", "build",
    ".pytest_cache", ".idea", ".vscode",
]
REQUIREMENTS_FILES = ["requirements.txt", "requirements-dev.txt", "requirements-prod.txt", "dev-requirements.txt", "pipfile"]
MANIFEST_FILES = REQUIREMENTS_FILES + ["pyproject.toml", "setup.py"]

# Confidence per detector.
CONFIDENCE = {"ast": 0.98, "secrets": 0.92, "owasp": 0.95, "supply": 0.97, "rag": 0.92, "agent": 0.94, "model": 0.98, "custom": 0.85}
CONFIDENCE_BY_RULE = {"RAG-SSL-001": 0.95, "MODEL-CUSTOM-CODE-001": 0.95}

# Detector order and the detector names findings carry.
DETECTORS = ["ast", "secrets", "owasp", "supply", "rag", "agent", "model", "custom"]
DETECTOR_NAMES = {
    "ast": "ast_detector", "secrets": "regex_detector", "owasp": "llm_owasp_detector",
    "supply": "supply_chain_detector", "rag": "rag_detector", "agent": "mcp_agent_detector",
    "model": "model_artifact_detector", "custom": "yaml_rule_detector",
}
