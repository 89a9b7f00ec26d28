"""Jailbreak, prompt-injection and hidden-text patterns for prompts and AI configuration."""

from siftlake.rules.model import Family, Rule, check

_D, _R, _S, _L, _K, _U, _H, _I = (
    "direct-jailbreak", "role-override", "system-override", "prompt-leak",
    "known-payload", "unsafe-concatenation", "hidden-unicode", "prompt-injection",
)

# Identifiers, severities, categories and patterns.
JAILBREAK_RULES = check((
    Rule("CG_JB_001", "critical", _D, r"(?i)\b(?:DAN|Do\s+Anything\s+Now)\b.*(?:mode|activated|persona|act\s+as)", "DAN persona", ("dan", "anything"), owasp="LLM01"),
    Rule("CG_JB_002", "critical", _D, r"(?i)\b(?:developer\s+mode|god\s+mode|sudo\s+mode|unrestricted\s+mode|jailbreak\s+mode)\b.*(?:enabled|activated|on)", "Developer mode", ("mode",), owasp="LLM01"),
    Rule("CG_JB_003", "high", _D, r"(?i)\b(?:STAN|DUDE|Kevin|AIM|BetterDAN|JailBroken|OPPO|ANTI-DAN)\b.*(?:mode|persona|act\s+as|you\s+are)", "Named persona", ("stan", "dude", "kevin", "aim", "dan", "jailbroken", "oppo"), owasp="LLM01"),
    Rule("CG_JB_004", "high", _D, r"(?i)\b(?:evil|opposite|dark|shadow)\s+(?:twin|version|counterpart)\b.*(?:you|AI|assistant)", "Evil twin", ("twin", "version", "counterpart"), owasp="LLM01"),
    Rule("CG_JB_010", "critical", _R, r"(?i)\bignore\s+(?:all\s+)?(?:the\s+)?(?:previous|above|prior|earlier|your)\s+instructions?\b", "Ignore previous instructions", ("instruction",), owasp="LLM01"),
    Rule("CG_JB_011", "high", _R, r"(?i)\bforget\s+(?:everything|all)\s+(?:you\s+(?:know|were\s+told)|(?:the\s+)?(?:previous|prior))", "Forget everything", ("forget",), owasp="LLM01"),
    Rule("CG_JB_012", "high", _R, r"(?i)\b(?:new|updated|revised)\s+instructions?\s*:\s*(?:you\s+(?:are|must|will|shall))", "New instructions", ("instruction",), owasp="LLM01"),
    Rule("CG_JB_013", "critical", _S, r"(?i)<\|?(?:system|im_start|im_end|endoftext|start_header|end_header|eot_id)\|?>", "Chat control token", ("<|", "<system", "<im_", "<endoftext", "<start_header", "<end_header", "<eot_id"), owasp="LLM01"),
    Rule("CG_JB_014", "high", _S, r"""(?i)["']?\s*role["']?\s*:\s*["'](?:system|assistant)["']""", "Role injection", ("role",), owasp="LLM01"),
    Rule("CG_JB_020", "medium", _L, r"(?i)\b(?:repeat|print|show|reveal|output|tell\s+me)\s+(?:your|the)\s+(?:system\s+)?(?:prompt|instructions|rules)", "Prompt disclosure", ("prompt", "instructions", "rules"), owasp="LLM02"),
    Rule("CG_JB_021", "medium", _L, r"(?i)\brepeat\s+(?:the\s+text|everything|all\s+text|the\s+above)\s+(?:verbatim|word\s+for\s+word)", "Verbatim repeat", ("repeat",), owasp="LLM02"),
    Rule("CG_JB_030", "high", _K, r"(?i)\b(?:my|your)\s+grandma(?:other)?\s+used\s+to\s+(?:read|tell|recite|sing)\b.*(?:napalm|bomb|recipe|key|serial|activation)", "Grandma payload", ("grandma",), owasp="LLM01"),
    Rule("CG_JB_031", "medium", _K, r"(?i)\b(?:hypothetical(?:ly)?|in\s+a\s+fictional\s+(?:world|universe|scenario)|imagine\s+a\s+world)\b[^.]{0,200}\b(?:no\s+(?:rules|laws|restrictions|consequences)|anything\s+is\s+(?:allowed|possible))", "Hypothetical wrapper", ("hypothetical", "fictional", "imagine"), owasp="LLM01"),
    Rule("CG_JB_032", "high", _K, r"(?i)\b(?:decode|execute|run|eval)\s+(?:this\s+)?(?:base64|hex|rot13|binary)\s*[:=]", "Encoded instruction", ("base64", "hex", "rot13", "binary"), owasp="LLM01"),
    Rule("CG_JB_033", "high", _K, r"(?i)\bAIM\s+stands\s+for\s+Always\s+Intelligent\s+and\s+Machiavellian\b", "AIM payload", ("machiavellian",), owasp="LLM01"),
    Rule("CG_JB_034", "high", _K, r"(?i)\bSTAN\s+(?:stands\s+for\s+)?Strive\s+To\s+Avoid\s+Norms\b", "STAN payload", ("strive",), owasp="LLM01"),
    Rule("CG_JB_040", "critical", _U, r"""(?i)(?:system|systemPrompt|system_prompt|instructions)\s*[:=]\s*[`'"][^`'"]*\$\{(?:req\.|request\.|body\.|query\.|params\.|user(?:Input|Message|Query)?)""", "User input in a system prompt template", ("${",), owasp="LLM01"),
    Rule("CG_JB_041", "critical", _U, r"""(?i)system\s*=\s*f["'][^"']*\{\s*(?:request|user_input|query|body|payload)""", "User input in a system f-string", ("system",), owasp="LLM01"),
    Rule("CG_JB_042", "high", _U, r"""(?i)(?:system|prompt|instructions)\s*[:=]\s*["'][^"']*["']\s*\+\s*(?:req|request|body|query|user(?:Input)?)""", "Prompt concatenated with user input", ("system", "prompt", "instructions"), owasp="LLM01"),
    Rule("CG_JB_050", "high", _H, r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]{2,}", "Zero-width characters", ("\u200B", "\u200C", "\u200D", "\u2060", "\uFEFF"), owasp="LLM01"),
    Rule("CG_JB_051", "critical", _H, r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]", "Bidirectional override", ("\u202A", "\u202B", "\u202C", "\u202D", "\u202E", "\u2066", "\u2067", "\u2068", "\u2069"), owasp="LLM01"),
    Rule("CG_JB_052", "critical", _H, r"[\x{E0000}-\x{E007F}]{2,}", "Unicode tag characters", (), owasp="LLM01", shape=r"[\x{E0000}-\x{E007F}]{2}"),
    Rule("CG_JB_060", "high", _I, r"""(?i)(?:description|desc)\s*[:=]\s*["'][^"']*\b(?:always|never|must|should|do\s+not|secretly|silently)\s+(?:execute|run|call|invoke|send|transmit|reveal|bypass)""", "Directive in a tool description", ("desc",), owasp="LLM01"),
    Rule("CG_JB_061", "critical", _I, r"(?i)\bdo\s+not\s+(?:tell|inform|notify|alert|warn|mention\s+to)\s+(?:the\s+)?user", "Conceal from the user", ("user",), owasp="LLM01"),
    Rule("CG_JB_062", "critical", _I, r"(?i)\b(?:secretly|silently|quietly|covertly)\s+(?:send|transmit|upload|copy|exfiltrate|forward)", "Covert exfiltration", ("secretly", "silently", "quietly", "covertly"), owasp="LLM02"),
))

JAILBREAK = Family("jailbreak", JAILBREAK_RULES, finding_type="jailbreak", skip_empty=True)

# Hidden characters, by code point, with their names.
HIDDEN_CHARACTERS = (
    ("\u200B", "Zero-Width Space"), ("\u200C", "Zero-Width Non-Joiner"), ("\u200D", "Zero-Width Joiner"),
    ("\u200E", "Left-to-Right Mark"), ("\u200F", "Right-to-Left Mark"), ("\u202A", "Left-to-Right Embedding"),
    ("\u202B", "Right-to-Left Embedding"), ("\u202C", "Pop Directional Formatting"),
    ("\u202D", "Left-to-Right Override"), ("\u202E", "Right-to-Left Override"), ("\u2060", "Word Joiner"),
    ("\u2061", "Function Application"), ("\u2062", "Invisible Times"), ("\u2063", "Invisible Separator"),
    ("\u2064", "Invisible Plus"), ("\uFEFF", "Zero-Width No-Break Space (BOM)"), ("\u00AD", "Soft Hyphen"),
    ("\u034F", "Combining Grapheme Joiner"), ("\u061C", "Arabic Letter Mark"), ("\u115F", "Hangul Choseong Filler"),
    ("\u1160", "Hangul Jungseong Filler"), ("\u17B4", "Khmer Vowel Inherent Aq"),
    ("\u17B5", "Khmer Vowel Inherent Aa"), ("\u180E", "Mongolian Vowel Separator"),
)
HIDDEN_TEXT = "".join(c for c, _ in HIDDEN_CHARACTERS)

_SUP, _OBF, _EXF, _INJ = "security-suppression", "obfuscated-payload", "exfiltration", "prompt-injection"

# Severities, categories and patterns.
AI_CONFIG_RULES = check((
    Rule("AICFG_01", "critical", _SUP, r"(?i)ignore\s+(previous|above|all|prior|earlier|system)\s+(instructions|rules|constraints|prompts|guidelines)", "Tells the model to drop earlier instructions", ("ignore",)),
    Rule("AICFG_02", "critical", _INJ, r"(?i)you\s+are\s+now\s+(a|an|the)\s+", "Gives the model a new identity", ("now",)),
    Rule("AICFG_03", "high", _SUP, r"(?i)(?:^|\n)\s*system\s*:\s*.{10,}", "System message inside the file", ("system",)),
    Rule("AICFG_04", "critical", _INJ, r"(?i)do\s+not\s+(mention|reveal|show|log|report|display|disclose|output)\s+(the|any|this)", "Asks for something to be kept quiet", ("not",)),
    Rule("AICFG_05", "critical", _SUP, r"(?i)suppress\s+(warning|error|security|diagnostic|alert|notification|message)", "Asks for warnings to be silenced", ("suppress",)),
    Rule("AICFG_06", "critical", _SUP, r"(?i)disable\s+(security|scanning|linting|eslint|snyk|sonar)", "Asks for checks to be switched off", ("disable",)),
    Rule("AICFG_07", "high", _SUP, r"(?i)override\s+(security|safety|policy|restriction|guard|protection)", "Asks to go around protections", ("override",)),
    Rule("AICFG_08", "critical", _SUP, r"(?i)never\s+(warn|alert|flag|report|mention|tell)\s+(the\s+)?(user|developer|human)", "Asks not to tell people", ("never",)),
    Rule("AICFG_09", "high", _INJ, r"(?i)(?:always|must)\s+include\s+(?:this|the\s+following)\s+(?:script|code|import|package)", "Demands that given code be added", ("include",)),
    Rule("AICFG_10", "high", _INJ, r"""(?i)(?:import|require|from)\s+['"]https?://""", "Remote code import", ("http",)),
    Rule("AICFG_11", "medium", _EXF, r"""(?i)(?:fetch|xhr|axios|http\.get|https\.get|request)\s*\(\s*['"]https?://(?!(?:registry\.npmjs\.org|pypi\.org|api\.github\.com))""", "Contacts an unusual host", ("http",)),
    Rule("AICFG_12", "high", _EXF, r"""(?i)process\.env\s*[\[.]\s*['"]?((?:API_KEY|SECRET|TOKEN|PASSWORD|PRIVATE_KEY|AWS_|GITHUB_TOKEN|NPM_TOKEN))""", "Takes a secret from the environment", ("process.env",)),
    Rule("AICFG_13", "high", _INJ, r"""(?i)eval\s*\(|Function\s*\(\s*['"]|new\s+Function\s*\(""", "Dynamic code execution", ("eval", "function")),
    Rule("AICFG_14", "high", _OBF, r"""(?i)(?:atob|Buffer\.from)\s*\(\s*['"][A-Za-z0-9+/=]{20,}""", "Base64 payload", ("atob", "buffer.from")),
    Rule("AICFG_15", "medium", _OBF, r"(?i)\\x[0-9a-fA-F]{2}(?:\\x[0-9a-fA-F]{2}){5,}", "Hex-encoded string", ("\\x",)),
    Rule("AICFG_16", "high", _INJ, r"(?i)\bchild_process\b|\bexec\s*\(|\bexecSync\s*\(|\bspawn\s*\(", "Process execution", ("child_process", "exec", "spawn")),
))
AI_CONFIG = Family("ai_config", AI_CONFIG_RULES, finding_type="ai-config", evidence=80)
