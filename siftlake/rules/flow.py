"""Sources, sinks and syntax of the data-flow analysis."""

from siftlake.rules.model import SLASH_HASH_STAR_ONLY, Family, Rule, check

# Categories and patterns.
SOURCE_RULES = check((
    Rule("SRC_01", "info", "user-input", r"(?:req|request|ctx)\.(?:body|params|query|headers|cookies|files)\b", "Part of a web request", ("req.", "request.", "ctx.")),
    Rule("SRC_02", "info", "user-input", r"(?:req|request|ctx)\.(?:param|get|header)\s*\(", "Request accessor", ("req.", "request.", "ctx.")),
    Rule("SRC_03", "info", "user-input", r"event\.(?:body|queryStringParameters|pathParameters|headers)\b", "Cloud function event", ("event.",)),
    Rule("SRC_04", "info", "user-input", r"(?:FormData|URLSearchParams)\s*\(", "Submitted form or query string", ("formdata", "urlsearchparams")),
    Rule("SRC_05", "info", "user-input", r"document\.getElementById\s*\([^)]*\)\.value", "Page field", ("getelementbyid",)),
    Rule("SRC_06", "info", "environment", r"process\.env\.\w+", "Process variable", ("process.env",)),
    Rule("SRC_07", "info", "environment", r"os\.environ\b", "Process variable (Python)", ("os.environ",)),
    Rule("SRC_08", "info", "file-read", r"(?:readFile|readFileSync|createReadStream)\s*\(", "Content of a file", ("readfile", "createreadstream")),
    Rule("SRC_09", "info", "file-read", r"""open\s*\([^)]*,\s*['"]r""", "Content of a file (Python)", ("open",)),
    Rule("SRC_10", "info", "network", r"(?:await\s+)?(?:fetch|axios\.(?:get|post|put))\s*\(", "Answer of a remote service", ("fetch", "axios.")),
    Rule("SRC_11", "info", "database", r"\.(?:findOne|findMany|find|query|execute)\s*\(", "Rows of a database", (".find", ".query", ".execute")),
    Rule("SRC_12", "info", "user-input", r"request\.(?:form|args|json|data|values|files)\b", "Part of a Python web request", ("request.",)),
))
_PY = ("python",)
# Categories, severities, patterns and languages.
SINK_RULES = check((
    Rule("SNK_01", "critical", "sql", r"""(?i)(?:query|execute|exec|raw)\s*\(\s*[`'"]?\s*(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)""", "Statement sent to a database", ("query", "exec", "raw")),
    Rule("SNK_02", "critical", "sql", r"\.raw\s*\(", "Unescaped statement", (".raw",)),
    Rule("SNK_03", "critical", "command", r"(?:child_process\.)?(?:exec|execSync|spawn|spawnSync)\s*\(", "Program start", ("exec", "spawn")),
    Rule("SNK_04", "critical", "command", r"subprocess\.(?:call|run|Popen|check_output)\s*\(", "Program start (Python)", ("subprocess.",), _PY),
    Rule("SNK_05", "critical", "command", r"os\.system\s*\(", "Shell call (Python)", ("os.system",), _PY),
    Rule("SNK_06", "high", "xss", r"\.innerHTML\s*=", "Markup written to a node", (".innerhtml",)),
    Rule("SNK_07", "high", "xss", r"document\.write\s*\(", "Markup written to the page", ("document.write",)),
    Rule("SNK_08", "high", "xss", r"dangerouslySetInnerHTML", "Markup handed to a component", ("dangerouslysetinnerhtml",)),
    Rule("SNK_09", "high", "path-traversal", r"(?:readFile|writeFile|readFileSync|writeFileSync|unlink|rmdir|mkdir)\s*\(", "Path of a file operation", ("readfile", "writefile", "unlink", "rmdir", "mkdir")),
    Rule("SNK_10", "high", "ssrf", r"(?:fetch|axios|request|http\.get|https\.get)\s*\(", "Address of a request", ("fetch", "axios", "request", "http")),
    Rule("SNK_11", "critical", "deserialization", r"pickle\.loads?\s*\(", "Unpickling", ("pickle.load",), _PY),
    Rule("SNK_12", "low", "deserialization", r"JSON\.parse\s*\(", "Parsed text", ("json.parse",)),
    Rule("SNK_13", "medium", "redirect", r"res\.redirect\s*\(", "Target of a redirect", ("res.redirect",)),
    Rule("SNK_14", "critical", "eval", r"\beval\s*\(", "Evaluated text", ("eval",)),
    Rule("SNK_15", "critical", "eval", r"new\s+Function\s*\(", "Function built from text", ("function",)),
))
SOURCES = Family("taint_source", SOURCE_RULES, finding_type="source", comment=SLASH_HASH_STAR_ONLY)
SINKS = Family("taint_sink", SINK_RULES, finding_type="sink", comment=SLASH_HASH_STAR_ONLY)

# Syntax patterns, applied to the trimmed line.
ASSIGNMENT = r"(?:const|let|var|)\s+(\w+)\s*=\s*(.+)"
DESTRUCTURE = r"(?:const|let|var|)\s+\{([^}]+)\}\s*=\s*(.+)"
FUNCTION_PARAMS = r"(?:function|async function)\s+(\w+)\s*\(([^)]*)\)"
ARROW_PARAMS = r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>"
EXPORTED = r"export\s+(?:default\s+)?(?:function|class|const|let|var)\s+(\w+)"
ES_IMPORT = r"""import\s+(?:\{([^}]*)\}|(\w+))\s+from\s+['"]([^'"]+)['"]"""
REQUIRE_IMPORT = r"""(?:const|let|var)\s+(?:\{([^}]*)\}|(\w+))\s*=\s*require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
PYTHON_IMPORT = r"from\s+\.(\w+)\s+import\s+(.+)"
