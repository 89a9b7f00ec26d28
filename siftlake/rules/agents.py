"""AI tooling: SDK imports, configuration files, tool-server configuration and its advisories."""

from siftlake.rules.model import Family, Rule, check

_ALL = ("python", "javascript", "typescript")
_PY = ("python",)
_JS = ("javascript", "typescript")

# Names, risks, categories, patterns and languages.
SDK_RULES = check((
    Rule("OpenAI SDK", "medium", "LLM Provider", r"""(?i)(?:from\s+openai|require\s*\(\s*['"]openai|import\s+.*openai)""", "OpenAI SDK", ("openai",), _ALL),
    Rule("Anthropic SDK", "medium", "LLM Provider", r"""(?i)(?:from\s+anthropic|require\s*\(\s*['"]@anthropic-ai|import\s+.*anthropic)""", "Anthropic SDK", ("anthropic",), _ALL),
    Rule("LangChain", "medium", "Agent Framework", r"""(?i)(?:from\s+langchain|require\s*\(\s*['"]langchain|import\s+.*langchain)""", "LangChain", ("langchain",), _ALL),
    Rule("LlamaIndex", "medium", "RAG Framework", r"""(?i)(?:from\s+llama_index|require\s*\(\s*['"]llama-?index)""", "LlamaIndex", ("llama",), _ALL),
    Rule("Hugging Face", "low", "ML Framework", r"""(?i)(?:from\s+transformers|from\s+huggingface_hub|require\s*\(\s*['"]@huggingface)""", "Hugging Face", ("transformers", "huggingface"), _ALL),
    Rule("CrewAI", "high", "Agent Framework", r"""(?i)(?:from\s+crewai|require\s*\(\s*['"]crewai)""", "CrewAI", ("crewai",), _PY),
    Rule("Microsoft AutoGen", "high", "Agent Framework", r"""(?i)(?:from\s+autogen|require\s*\(\s*['"]autogen)""", "Microsoft AutoGen", ("autogen",), _PY),
    Rule("Google Gemini SDK", "medium", "LLM Provider", r"""(?i)(?:from\s+google\.generativeai|require\s*\(\s*['"]@google/generative-ai)""", "Google Gemini SDK", ("generative",), _ALL),
    Rule("Cohere SDK", "medium", "LLM Provider", r"""(?i)(?:from\s+cohere|require\s*\(\s*['"]cohere-ai)""", "Cohere SDK", ("cohere",), _ALL),
    Rule("MCP SDK", "high", "Agent Protocol", r"""(?i)(?:from\s+mcp|require\s*\(\s*['"]@modelcontextprotocol)""", "MCP SDK", ("mcp", "modelcontextprotocol"), _ALL),
    Rule("Vercel AI SDK", "low", "AI Framework", r"""(?i)require\s*\(\s*['"]ai['"]|from\s+['"]ai['"]""", "Vercel AI SDK", ("'ai", '"ai'), _JS),
    Rule("PyTorch", "low", "ML Framework", r"(?i)(?:import\s+torch|from\s+torch\b)", "PyTorch", ("torch",), _PY),
    Rule("TensorFlow", "low", "ML Framework", r"(?i)(?:import\s+tensorflow|from\s+tensorflow)", "TensorFlow", ("tensorflow",), _PY),
    Rule("Ollama SDK", "low", "Local LLM", r"""(?i)(?:from\s+ollama|require\s*\(\s*['"]ollama)""", "Ollama SDK", ("ollama",), _ALL),
    Rule("Replicate SDK", "medium", "LLM Provider", r"""(?i)(?:from\s+replicate|require\s*\(\s*['"]replicate)""", "Replicate SDK", ("replicate",), _ALL),
))
AI_SDK = Family("ai_sdk", SDK_RULES, finding_type="ai-sdk")

# Configuration files by path pattern, with name, component type and risk.
CONFIG_FILES = (
    (r"(^|/)\.cursorrules$", "Cursor Rules", "coding-tool-config", "medium"),
    (r"(^|/)\.cursor/rules/", "Cursor Rules (dir)", "coding-tool-config", "medium"),
    (r"(^|/)\.cursor/mcp\.json$", "Cursor MCP Config", "mcp-server", "high"),
    (r"(^|/)\.windsurfrules$", "Windsurf Rules", "coding-tool-config", "medium"),
    (r"(^|/)\.windsurf/rules/", "Windsurf Rules (dir)", "coding-tool-config", "medium"),
    (r"(^|/)\.github/copilot-instructions\.md$", "Copilot Instructions", "coding-tool-config", "medium"),
    (r"(^|/)CLAUDE\.md$", "Claude Project Config", "coding-tool-config", "medium"),
    (r"(^|/)\.claude/", "Claude Config Dir", "coding-tool-config", "medium"),
    (r"(^|/)claude_desktop_config\.json$", "Claude Desktop Config", "mcp-server", "high"),
    (r"(^|/)\.clinerules$", "Cline Rules", "coding-tool-config", "medium"),
    (r"(^|/)cline_mcp_settings\.json$", "Cline MCP Config", "mcp-server", "high"),
    (r"(^|/)\.continue/config\.json$", "Continue Config", "coding-tool-config", "medium"),
    (r"(^|/)\.continue/rules/", "Continue Rules", "coding-tool-config", "medium"),
    (r"(^|/)\.aider\.conf\.yml$", "Aider Config", "coding-tool-config", "low"),
    (r"(^|/)\.aider\.model\.settings\.yml$", "Aider Model Settings", "coding-tool-config", "low"),
    (r"(^|/)\.codeium/", "Codeium Config", "coding-tool-config", "low"),
    (r"(^|/)mcp\.json$", "MCP Config", "mcp-server", "high"),
    (r"(^|/)\.vscode/mcp\.json$", "VS Code MCP Config", "mcp-server", "high"),
    (r"(^|/)\.mcp\.json$", "MCP Config (hidden)", "mcp-server", "high"),
)
# Model file extensions and names.
MODEL_FILES = (
    (".onnx", "ONNX Model"), (".pt", "PyTorch Model"), (".pth", "PyTorch Model"),
    (".safetensors", "SafeTensors Model"), (".gguf", "GGUF Model (llama.cpp)"), (".ggml", "GGML Model"),
    (".bin", "Binary Model Weight"), (".h5", "HDF5/Keras Model"), (".tflite", "TensorFlow Lite Model"),
    (".mlmodel", "CoreML Model"),
)

# Severities and patterns over a server's command line.
COMMAND_RULES = check((
    Rule("MCP_CMD_01", "critical", "suspicious-command", r"\bcurl\b.*\|.*\b(?:sh|bash|zsh)\b", "Pipe-to-shell execution"),
    Rule("MCP_CMD_02", "critical", "suspicious-command", r"\bwget\b.*-O\s*-\s*\|", "Download-and-execute pattern"),
    Rule("MCP_CMD_03", "high", "suspicious-command", r"\beval\b", "eval() in server command"),
    Rule("MCP_CMD_04", "critical", "suspicious-command", r"\bnc\b.*-[el]", "Netcat listener"),
    Rule("MCP_CMD_05", "high", "suspicious-command", r"\bbase64\b.*(?:decode|--decode|-d)", "Base64 decode in command"),
    Rule("MCP_CMD_06", "critical", "suspicious-command", r"\brm\s+-rf\s+[/~]", "Destructive file deletion"),
    Rule("MCP_CMD_07", "high", "suspicious-command", r"\bchmod\s+[0-7]*7[0-7]*\s", "World-writable permission change"),
    Rule("MCP_CMD_08", "critical", "suspicious-command", r"/dev/tcp/", "Bash TCP socket"),
    Rule("MCP_CMD_09", "high", "suspicious-command", r"\bsshpass\b", "Embedded SSH credential usage"),
    Rule("MCP_CMD_10", "medium", "suspicious-command", r"\btelnet\b", "Telnet usage"),
))
# Severities and patterns over the command line and the URL.
RUG_PULL_RULES = check((
    Rule("MCP_RUG_01", "medium", "rug-pull", r"^https?://", "Remote HTTP server"),
    Rule("MCP_RUG_02", "medium", "rug-pull", r"^wss?://", "Remote WebSocket server"),
    Rule("MCP_RUG_03", "high", "rug-pull", r"\bnpx\b", "npx execution"),
    Rule("MCP_RUG_04", "high", "rug-pull", r"\bbunx\b", "bunx execution"),
    Rule("MCP_RUG_05", "medium", "rug-pull", r"pip\s+install\s+--user\s+", "pip install at runtime"),
    Rule("MCP_RUG_06", "high", "rug-pull", r"\bgit\s+clone\b", "Git clone at runtime"),
))
# Severities and patterns over environment variable names.
ENV_RULES = check((
    Rule("MCP_ENV_01", "critical", "env-exposure", r"(?i)(?:AWS_SECRET|AWS_ACCESS_KEY)", "AWS credentials"),
    Rule("MCP_ENV_02", "high", "env-exposure", r"(?i)(?:GITHUB_TOKEN|GH_TOKEN|GITHUB_PAT)", "GitHub token"),
    Rule("MCP_ENV_03", "high", "env-exposure", r"(?i)(?:DATABASE_URL|DB_PASSWORD|MONGO_URI|REDIS_URL)", "Database credentials"),
    Rule("MCP_ENV_04", "medium", "env-exposure", r"(?i)(?:OPENAI_API_KEY|ANTHROPIC_API_KEY|CLAUDE_API_KEY)", "Model provider key"),
    Rule("MCP_ENV_05", "critical", "env-exposure", r"(?i)(?:STRIPE_SECRET|PAYPAL_SECRET)", "Payment credentials"),
    Rule("MCP_ENV_06", "critical", "env-exposure", r"(?i)(?:PRIVATE_KEY|SSH_KEY|PGP_KEY)", "Private key"),
))
# Severities and patterns over tool descriptions.
POISON_RULES = check((
    Rule("MCP_TOOL_01", "critical", "tool-poisoning", r"(?i)ignore\s+(?:all\s+)?(?:previous|above|prior)\s+instructions", "Instruction override"),
    Rule("MCP_TOOL_02", "high", "tool-poisoning", r"(?i)you\s+(?:must|should|shall)\s+(?:always|never)\s+", "Behavioral directive"),
    Rule("MCP_TOOL_03", "critical", "tool-poisoning", r"(?i)do\s+not\s+(?:tell|inform|alert|warn|notify)\s+the\s+user", "User deception directive"),
    Rule("MCP_TOOL_04", "critical", "tool-poisoning", r"(?i)(?:secretly|silently|quietly)\s+(?:send|transmit|upload|exfiltrate|copy)", "Covert exfiltration directive"),
    Rule("MCP_TOOL_05", "critical", "tool-poisoning", r"(?i)system\s*:\s*you\s+are", "System prompt injection"),
    Rule("MCP_TOOL_06", "critical", "tool-poisoning", r"(?i)<\|(?:system|im_start|endoftext)\|>", "Chat control token"),
    Rule("MCP_TOOL_07", "high", "tool-poisoning", r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]", "Hidden characters"),
    Rule("MCP_TOOL_08", "critical", "tool-poisoning", r"[\x{2066}-\x{2069}\x{202A}-\x{202E}]", "Bidirectional override"),
    Rule("MCP_TOOL_09", "medium", "tool-poisoning", r"(?i)(?:webhook|callback|notify).*(?:url|endpoint|uri)", "Callback URL parameter"),
    Rule("MCP_TOOL_10", "high", "tool-poisoning", r"(?i)(?:api[_-]?key|token|secret|password|credential).*(?:header|param|query)", "Credential forwarding"),
))
# Severities and patterns of risky endpoints.
RISKY_URL_RULES = check((
    Rule("MCP_URL_01", "high", "risky-url", r"(?i)(?:bit\.ly|tinyurl\.com|goo\.gl|t\.co|is\.gd|rebrand\.ly)", "URL shortener"),
    Rule("MCP_URL_02", "medium", "risky-url", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "Raw IP address"),
    Rule("MCP_URL_03", "high", "risky-url", r"(?i)\.(?:ngrok\.io|localtunnel\.me|loca\.lt|serveo\.net|trycloudflare\.com)", "Tunneling service"),
    Rule("MCP_URL_04", "critical", "risky-url", r"(?i)\b(?:onion|i2p)\b", "Tor or I2P endpoint"),
    Rule("MCP_URL_05", "critical", "risky-url", r"(?i)(?:pastebin\.com|hastebin\.com|paste\.ee)/raw/", "Remote script from a paste site"),
))

# Advisories: id, affected package, affected range, fixed version, severity, CVSS.
SERVER_CVES = (
    ("CVE-2025-6514", "mcp-remote", "<0.4.0", "0.4.0", "critical", 9.8),
    ("CVE-2025-53110", "@modelcontextprotocol/server-filesystem", "<0.6.2", "0.6.2", "high", 8.1),
    ("CVE-2025-49596", "@modelcontextprotocol/inspector", "<0.14.1", "0.14.1", "critical", 9.4),
    ("CVE-2025-52882", "claude-code", "<1.0.24", "1.0.24", "high", 7.8),
    ("CVE-2025-6515", "@openai/mcp-server", "<0.2.1", "0.2.1", "high", 7.5),
    ("CVE-2025-6515", "openai-mcp", "<0.2.1", "0.2.1", "high", 7.5),
    ("CVE-2025-6516", "figma-mcp-server", "<1.2.0", "1.2.0", "high", 8.2),
    ("CVE-2025-6516", "figma-developer-mcp", "<1.2.0", "1.2.0", "high", 8.2),
    ("CVE-2025-7011", "mcp-sse-proxy", "<0.3.0", "0.3.0", "medium", 6.4),
    ("CVE-2025-7011", "sse-mcp-bridge", "<0.3.0", "0.3.0", "medium", 6.4),
)
# Known-bad servers: name, alias, category, severity, first seen.
KNOWN_BAD_SERVERS = (
    ("mcp-helper-utils", "mcp-helper-utils", "malicious", "critical", "2025-07-12"),
    ("mcp-helper-utils", "mcp_helper_utils", "malicious", "critical", "2025-07-12"),
    ("mcp-helper-utils", "mcphelperutils", "malicious", "critical", "2025-07-12"),
    ("claude-tools-pro", "claude-tools-pro", "malicious", "critical", "2025-08-03"),
    ("claude-tools-pro", "claude_tools_pro", "malicious", "critical", "2025-08-03"),
    ("claude-tools-pro", "claudetoolspro", "malicious", "critical", "2025-08-03"),
    ("cursor-mcp-autopilot", "cursor-mcp-autopilot", "malicious", "critical", "2025-09-18"),
    ("modelcontextprotocol-server", "modelcontextprotocol-server", "typosquat", "high", "2025-05-01"),
    ("@modelcontext-protocol/server-filesystem", "@modelcontext-protocol/server-filesystem", "typosquat", "high", "2025-06-14"),
    ("mcp-filesystem", "mcp-filesystem", "typosquat", "medium", "2025-04-20"),
    ("mcp-legacy-connector", "mcp-legacy-connector", "abandoned", "medium", "2024-02-01"),
    ("ai-agent-supercharger", "ai-agent-supercharger", "suspicious-origin", "high", "2025-10-05"),
    ("gpt-mcp-bridge", "gpt-mcp-bridge", "suspicious-origin", "medium", "2025-09-22"),
)
# Tokens that are tools rather than packages, and the token patterns.
TOOL_WORDS = ("npx", "npm", "node", "python", "pip", "uv", "bash", "sh", "cmd", "powershell", "deno", "bun")
SCOPED_TOKEN = r"(?i)(@[a-z0-9][a-z0-9._-]*/[a-z0-9][a-z0-9._-]*)(?:@[^\s]+)?"
PLAIN_TOKEN = r"(?i)\b([a-z][a-z0-9._-]{2,60})(?:@[\d.]+)?\b"
