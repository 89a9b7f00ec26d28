"""Static-analysis patterns for source code: three catalogues of different age."""

from siftlake.rules.model import SLASH_HASH_STAR, SLASH_HASH_STAR_ONLY, Family, Rule, check

JS = ("javascript", "typescript")
JSX = ("javascript", "typescript", "javascriptreact", "typescriptreact")
REACT = ("javascriptreact", "typescriptreact")
PY = ("python",)

# Patterns shared by several catalogues.
SQL_INTERPOLATION = r"""(?i)(?:query|execute|exec)\s*\(\s*[`'"]\s*(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b[^`'"]*\$\{"""
SQL_CONCAT = r"""(?i)(?:query|execute|exec)\s*\(\s*['"`][^'"`]*['"`]\s*\+"""
SQL_PYTHON = r"""(?i)(?:execute|executemany)\s*\(\s*(?:f['"]|['"][^'"]*%\s*\()"""
INNER_HTML = r"""\.innerHTML\s*=\s*(?!['"`]<(?:div|span|p|h[1-6]|br\s*/)>['"`])"""
DOCUMENT_WRITE = r"document\.write\s*\("
DANGEROUS_HTML = r"dangerouslySetInnerHTML\s*=\s*\{\s*\{[^}]*__html\s*:"
EVAL_CALL = r"\beval\s*\("
NEW_FUNCTION = r"new\s+Function\s*\("
STRING_TIMER = r"""(?:setTimeout|setInterval)\s*\(\s*['"`]"""
EXEC_INTERPOLATION = r"""(?:child_process\.)?exec\s*\(\s*[`'"][^`'"]*\$\{"""
SHELL_TRUE = r"subprocess\.(?:call|run|Popen|check_output)\s*\([^)]*shell\s*=\s*True"
USER_PATH = r"(?:readFile|writeFile|readFileSync|writeFileSync|createReadStream|createWriteStream)\s*\([^)]*(?:req\.|request\.|params\.|query\.|body\.)"
WEAK_MD5 = r"""(?i)(?:createHash|hashlib\.new|md5)\s*\(\s*['"]md5['"]"""
WEAK_SHA1 = r"""(?i)(?:createHash|hashlib\.new)\s*\(\s*['"]sha1['"]"""
MATH_RANDOM = r"Math\.random\s*\(\s*\)"
PLAIN_HTTP = r"""(?:fetch|axios\.get|axios\.post|http\.get|request\.get)\s*\(\s*['"]http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)"""
TLS_OFF = r"rejectUnauthorized\s*:\s*false"
PROTO_POLLUTION = r"""\[['"]__proto__['"]\]|Object\.prototype\["""
PICKLE_LOAD = r"pickle\.loads?\s*\("
USER_URL = r"(?:fetch|axios|request|http\.get|https\.get)\s*\(\s*(?:req\.|request\.|params\.|query\.|body\.)[a-zA-Z_]+"
USER_REDIRECT = r"res\.redirect\s*\(\s*(?:req\.|request\.|params\.|query\.|body\.)[a-zA-Z_]+"

_USER = ("req.", "request.", "params.", "query.", "body.")

# Identifiers, severities, patterns, languages and CWE numbers.
HYBRID_RULES = check((
    Rule("CG_SQLI_001", "critical", "injection", SQL_INTERPOLATION, "SQL built by interpolation", ("${",), JSX, cwe="CWE-89"),
    Rule("CG_SQLI_002", "high", "injection", SQL_CONCAT, "SQL built by concatenation", ("query", "exec"), JSX, cwe="CWE-89"),
    Rule("CG_SQLI_003", "critical", "injection", SQL_PYTHON, "SQL built by Python formatting", ("execute",), PY, cwe="CWE-89"),
    Rule("CG_SQLI_004", "critical", "injection", r"""\.raw\s*\(\s*[`'"][^`'"]*\$\{""", "Raw query with interpolation", (".raw",), JS, cwe="CWE-89"),
    Rule("CG_XSS_001", "high", "xss", INNER_HTML, "innerHTML assignment", (".innerhtml",), JSX, cwe="CWE-79"),
    Rule("CG_XSS_002", "high", "xss", DOCUMENT_WRITE, "document.write call", ("document.write",), JSX, cwe="CWE-79"),
    Rule("CG_XSS_003", "medium", "xss", DANGEROUS_HTML, "dangerouslySetInnerHTML", ("dangerouslysetinnerhtml",), REACT, cwe="CWE-79"),
    Rule("CG_XSS_004", "high", "xss", r"`<[^`]*\$\{[^}]*\}[^`]*>`", "HTML template literal with interpolation", ("`<",), cwe="CWE-79"),
    Rule("CG_EVAL_001", "critical", "code-injection", EVAL_CALL, "eval call", ("eval",), cwe="CWE-95"),
    Rule("CG_EVAL_002", "critical", "code-injection", NEW_FUNCTION, "Function constructor", ("function",), cwe="CWE-95"),
    Rule("CG_EVAL_003", "high", "code-injection", STRING_TIMER, "Timer given a string", ("settimeout", "setinterval"), cwe="CWE-95"),
    Rule("CG_CMD_001", "critical", "command-injection", EXEC_INTERPOLATION, "Shell command built by interpolation", ("exec",), JS, cwe="CWE-78"),
    Rule("CG_CMD_002", "critical", "command-injection", SHELL_TRUE, "subprocess with shell=True", ("subprocess.",), PY, cwe="CWE-78"),
    Rule("CG_CMD_003", "critical", "command-injection", r"os\.system\s*\(", "os.system call", ("os.system",), PY, cwe="CWE-78"),
    Rule("CG_PATH_001", "high", "path-traversal", USER_PATH, "File path from a request", ("readfile", "writefile", "createreadstream", "createwritestream"), JS, cwe="CWE-22"),
    Rule("CG_PATH_002", "high", "path-traversal", r"""open\s*\(\s*(?:request\.|f['"].*\{)""", "open() on a request value", ("open",), PY, cwe="CWE-22"),
    Rule("CG_CRYPTO_001", "high", "crypto", WEAK_MD5, "MD5 hash", ("md5",), cwe="CWE-328"),
    Rule("CG_CRYPTO_002", "high", "crypto", WEAK_SHA1, "SHA-1 hash", ("sha1",), cwe="CWE-328"),
    Rule("CG_CRYPTO_003", "medium", "crypto", MATH_RANDOM, "Math.random for randomness", ("math.random",), JSX, cwe="CWE-338"),
    Rule("CG_CRYPTO_004", "critical", "crypto", r"""(?:createCipheriv|createDecipheriv)\s*\([^)]*['"][0-9a-fA-F]{16,}['"]""", "Literal cipher key or IV", ("cipheriv",), JS, cwe="CWE-321"),
    Rule("CG_HTTP_001", "medium", "network", PLAIN_HTTP, "Request over plain HTTP", ("http://",), cwe="CWE-319"),
    Rule("CG_HTTP_002", "critical", "network", TLS_OFF, "TLS verification off", ("rejectunauthorized",), cwe="CWE-295"),
    Rule("CG_SSRF_001", "high", "network", USER_URL, "Request URL from user input", _USER, JS, cwe="CWE-918"),
    Rule("CG_CORS_001", "medium", "network", r"""Access-Control-Allow-Origin['"]\s*[:,]\s*['"]?\*""", "CORS wildcard", ("access-control-allow-origin",), cwe="CWE-942"),
    Rule("CG_AUTH_001", "critical", "auth", r"""(?i)algorithm\s*[:=]\s*['"]none['"]""", "JWT algorithm none", ("algorithm",), cwe="CWE-347"),
    Rule("CG_AUTH_002", "high", "auth", r"""(?:sign|verify)\s*\([^)]*['"][a-zA-Z0-9]{8,}['"]""", "Literal signing secret", ("sign", "verify"), cwe="CWE-798"),
    Rule("CG_SESSION_001", "medium", "auth", r"(?i)(?:cookie|setCookie|set-cookie)[^;]*(?!secure).*httpOnly\s*[:=]\s*false", "Cookie readable by scripts", ("httponly",), cwe="CWE-614"),
    Rule("CG_DESER_001", "critical", "deserialization", PICKLE_LOAD, "pickle load", ("pickle.load",), PY, cwe="CWE-502"),
    Rule("CG_DESER_002", "high", "deserialization", r"yaml\.load\s*\([^)]*(?!SafeLoader|safe_load)", "yaml.load call", ("yaml.load",), PY, cwe="CWE-502"),
    Rule("CG_PROTO_001", "high", "prototype-pollution", PROTO_POLLUTION, "Write to an object prototype", ("__proto__", "object.prototype["), JSX, cwe="CWE-1321"),
    Rule("CG_REDIRECT_001", "medium", "redirect", USER_REDIRECT, "Redirect to user input", ("res.redirect",), JS, cwe="CWE-601"),
    Rule("CG_LOG_001", "medium", "logging", r"(?i)(?:console\.log|logger\.\w+|print)\s*\([^)]*(?:password|secret|token|apiKey|api_key|private_key|credential)", "Sensitive value logged", ("console.log", "logger.", "print"), cwe="CWE-532"),
    Rule("CG_ERR_001", "medium", "error-handling", r"res\.(?:send|json|write)\s*\([^)]*(?:err\.stack|error\.stack|\.stackTrace)", "Stack trace sent to the client", ("res.",), JS, cwe="CWE-209"),
))

# Identifiers, severities, patterns and languages.
CLASSIC_RULES = check((
    Rule("SQLI_001", "critical", "injection", SQL_INTERPOLATION, "SQL built by interpolation", ("${",), JSX),
    Rule("SQLI_002", "high", "injection", SQL_CONCAT, "SQL built by concatenation", ("query", "exec"), JSX),
    Rule("SQLI_003", "critical", "injection", SQL_PYTHON, "SQL built by Python formatting", ("execute",), PY),
    Rule("XSS_001", "high", "xss", INNER_HTML, "innerHTML assignment", (".innerhtml",), JSX),
    Rule("XSS_002", "high", "xss", r"\.outerHTML\s*=", "outerHTML assignment", (".outerhtml",), JSX),
    Rule("XSS_003", "high", "xss", DOCUMENT_WRITE, "document.write call", ("document.write",), JSX),
    Rule("XSS_004", "medium", "xss", DANGEROUS_HTML, "dangerouslySetInnerHTML", ("dangerouslysetinnerhtml",), REACT),
    Rule("EVAL_001", "critical", "code-injection", EVAL_CALL, "eval call", ("eval",)),
    Rule("EVAL_002", "critical", "code-injection", NEW_FUNCTION, "Function constructor", ("function",)),
    Rule("EVAL_003", "high", "code-injection", STRING_TIMER, "Timer given a string", ("settimeout", "setinterval")),
    Rule("CMD_001", "critical", "command-injection", EXEC_INTERPOLATION, "Shell command built by interpolation", ("exec",), JS),
    Rule("CMD_002", "critical", "command-injection", r"""execSync\s*\(\s*[`'"][^`'"]*\$\{""", "execSync built by interpolation", ("execsync",), JS),
    Rule("CMD_003", "critical", "command-injection", SHELL_TRUE, "subprocess with shell=True", ("subprocess.",), PY),
    Rule("PATH_001", "high", "path-traversal", USER_PATH, "File path from a request", ("readfile", "writefile", "createreadstream", "createwritestream"), JS),
    Rule("CRYPTO_001", "high", "crypto", WEAK_MD5, "MD5 hash", ("md5",)),
    Rule("CRYPTO_002", "high", "crypto", WEAK_SHA1, "SHA-1 hash", ("sha1",)),
    Rule("CRYPTO_003", "medium", "crypto", MATH_RANDOM, "Math.random for randomness", ("math.random",), JSX),
    Rule("HTTP_001", "medium", "network", PLAIN_HTTP, "Request over plain HTTP", ("http://",)),
    Rule("HTTP_002", "critical", "network", TLS_OFF, "TLS verification off", ("rejectunauthorized",)),
    Rule("PROTO_001", "high", "prototype-pollution", PROTO_POLLUTION, "Write to an object prototype", ("__proto__", "object.prototype["), JSX),
    Rule("DESER_001", "critical", "deserialization", PICKLE_LOAD, "pickle load", ("pickle.load",), PY),
    Rule("DESER_002", "high", "deserialization", r"yaml\.load\s*\([^)]*(?!\bSafeLoader\b|\bsafe_load\b)", "yaml.load call", ("yaml.load",), PY),
    Rule("SSRF_001", "high", "network", USER_URL, "Request URL from user input", _USER, JS),
    Rule("REDIRECT_001", "medium", "redirect", USER_REDIRECT, "Redirect to user input", ("res.redirect",), JS),
))

_EXT_PY = ("py",)

# Identifiers, severities, patterns and file extensions.
COMMAND_LINE_RULES = check((
    Rule("SAST_SQLI_001", "critical", "injection", r"""(?i)(?:query|execute|exec)\s*\(\s*[`'"]\s*(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b[^`'"]*\$\{""", "SQL built by interpolation", ("${",)),
    Rule("SAST_SQLI_002", "high", "injection", SQL_CONCAT, "SQL built by concatenation", ("query", "exec")),
    Rule("SAST_SQLI_003", "critical", "injection", SQL_PYTHON, "SQL built by Python formatting", ("execute",), _EXT_PY),
    Rule("SAST_XSS_001", "high", "xss", r"\.innerHTML\s*=", "innerHTML assignment", (".innerhtml",), ("js", "ts", "jsx", "tsx")),
    Rule("SAST_XSS_002", "high", "xss", DOCUMENT_WRITE, "document.write call", ("document.write",), ("js", "ts")),
    Rule("SAST_EVAL_001", "high", "code-injection", EVAL_CALL, "eval call", ("eval",)),
    Rule("SAST_EXEC_001", "critical", "command-injection", r"(?i)(?:child_process|exec|spawn|execSync|spawnSync)\s*\(.*\$\{", "Interpolated process call", ("${",)),
    Rule("SAST_PATH_001", "high", "path-traversal", r"(?i)(?:readFile|writeFile|createReadStream|unlink|rmdir)\s*\([^)]*(?:req\.|params\.|query\.|body\.)", "File path from a request", ("readfile", "writefile", "createreadstream", "unlink", "rmdir")),
    Rule("SAST_CRYPTO_001", "medium", "crypto", r"""createHash\s*\(\s*['"](?:md5|sha1)['"]\s*\)""", "Weak hash", ("createhash",)),
    Rule("SAST_CRYPTO_002", "high", "crypto", r"""(?:createCipheriv|createDecipheriv)\s*\([^)]*['"][0-9a-f]{16,}['"]""", "Literal cipher key or IV", ("cipheriv",)),
    Rule("SAST_DESERIALIZE", "critical", "deserialization", r"(?:pickle\.loads?|yaml\.load\s*\([^)]*(?!Loader))", "Unsafe deserialization", ("pickle.load", "yaml.load"), _EXT_PY),
    Rule("SAST_CORS", "medium", "network", r"""(?:Access-Control-Allow-Origin|cors)\s*[:(]\s*['"]?\*['"]?""", "CORS wildcard", ("access-control-allow-origin", "cors")),
))

HYBRID = Family("sast", HYBRID_RULES, finding_type="sast", comment=SLASH_HASH_STAR)
CLASSIC = Family("code_vuln", CLASSIC_RULES, finding_type="sast", comment=SLASH_HASH_STAR_ONLY)
COMMAND_LINE = Family("cli_sast", COMMAND_LINE_RULES, finding_type="sast")
