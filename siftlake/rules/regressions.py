"""Patterns whose removal or addition in a change is a security regression."""

from siftlake.rules.model import Family, Rule, check

_V, _A, _C, _E, _S = "removed-validation", "removed-auth", "weakened-crypto", "removed-error-handling", "removed-sanitization"

# Identifiers, severities, categories and patterns of removed lines.
REMOVED = Family("regression_removed", check((
    Rule("REG_VAL_001", "high", _V, r"(?:validate|sanitize|escape|encode|purify|DOMPurify|xss|validator)\s*\(", "Validation removed", ("validat", "sanitize", "escape", "encode", "purify", "xss")),
    Rule("REG_VAL_002", "medium", _V, r"""(?:typeof|instanceof)\s+\w+\s*[!=]==?\s*['"]""", "Type check removed", ("typeof", "instanceof")),
    Rule("REG_VAL_003", "medium", _V, r"(?:\.length|\.size)\s*(?:>|<|>=|<=|===|!==)\s*\d+", "Bounds check removed", (".length", ".size")),
    Rule("REG_AUTH_001", "critical", _A, r"(?:isAuthenticated|requireAuth|checkAuth|verifyToken|isAuthorized|requireRole|checkPermission)\s*\(", "Authorization check removed", ("isauthenticated", "requireauth", "checkauth", "verifytoken", "isauthorized", "requirerole", "checkpermission")),
    Rule("REG_AUTH_002", "high", _A, r"(?:authenticate|authorize|requireLogin|ensureAuth|passport\.authenticate)\s*\(", "Authentication middleware removed", ("authenticate", "authorize", "requirelogin", "ensureauth")),
    Rule("REG_AUTH_003", "high", _A, r"(?:csrf|csrfProtection|csurf|csrfToken)\b", "CSRF protection removed", ("csrf", "csurf")),
    Rule("REG_CRYPTO_001", "critical", _C, r"rejectUnauthorized\s*:\s*true", "TLS verification removed", ("rejectunauthorized",)),
    Rule("REG_CRYPTO_002", "high", _C, r"(?:sha256|sha384|sha512|sha-256|sha-384|sha-512|SHA256|SHA512)\b", "Strong hash removed", ("sha",)),
    Rule("REG_CRYPTO_003", "high", _C, r"(?:https|secure\s*:\s*true|forceSSL|requireHTTPS)\b", "HTTPS removed", ("https", "secure", "forcessl")),
    Rule("REG_ERR_001", "medium", _E, r"\btry\s*\{", "Error handling removed", ("try",)),
    Rule("REG_ERR_002", "medium", _E, r"\.catch\s*\(", "Error handler removed", (".catch",)),
    Rule("REG_SAN_001", "critical", _S, r"(?:parameterized|prepared|placeholder|\?\s*,|\$\d+)", "SQL parameters removed", ("parameterized", "prepared", "placeholder", "?", "$")),
    Rule("REG_SAN_002", "high", _S, r"(?:escapeHtml|htmlEncode|encodeURIComponent|encodeURI)\s*\(", "Encoding removed", ("escapehtml", "htmlencode", "encodeuri")),
    Rule("REG_SAN_003", "high", _S, r"path\.(?:resolve|normalize|join)\s*\(", "Path normalization removed", ("path.",)),
    Rule("REG_FLAG_001", "high", "disabled-security", r"(?:httpOnly|secure|sameSite|strictTransportSecurity|contentSecurityPolicy)\s*[:=]\s*true", "Security flag removed", ("httponly", "secure", "samesite", "stricttransportsecurity", "contentsecuritypolicy")),
)), finding_type="regression")

# Identifiers, severities and patterns of added lines.
ADDED = Family("regression_added", check((
    Rule("REG_NEW_001", "critical", "new-unsafe-pattern", r"\beval\s*\(", "eval added", ("eval",)),
    Rule("REG_NEW_002", "critical", "new-unsafe-pattern", r"""(?:child_process\.)?exec\s*\(\s*[`'"]""", "Shell command added", ("exec",)),
    Rule("REG_NEW_003", "critical", "new-unsafe-pattern", r"rejectUnauthorized\s*:\s*false", "TLS verification disabled", ("rejectunauthorized",)),
    Rule("REG_NEW_004", "high", "new-unsafe-pattern", r"""(?:password|secret|apiKey|api_key|token)\s*[:=]\s*['"][^'"]{8,}['"]""", "Literal secret added", ("password", "secret", "apikey", "api_key", "token")),
    Rule("REG_NEW_005", "medium", "new-unsafe-pattern", r"""Access-Control-Allow-Origin['"]\s*[:,]\s*['"]?\*""", "CORS wildcard added", ("access-control-allow-origin",)),
)), finding_type="regression")

# A dependency line of a manifest, and a hunk header.
DEPENDENCY_LINE = r"""["']([^"']+)["']\s*:\s*["']([^"']+)["']"""
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
