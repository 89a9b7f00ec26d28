"""API-security rules: tokens, GraphQL, deserialization and endpoint design."""

from siftlake.rules.model import SLASH_HASH_STAR, Family, Rule, check

JS = ("javascript", "typescript")
JSX = ("javascript", "typescript", "javascriptreact", "typescriptreact")
PY = ("python",)

# Identifiers, severities, categories, patterns, languages, CWE and OWASP references.
RULES = check((
    Rule("CG_API_JWT_001", "critical", "jwt", r"""(?i)\balgorithm[s]?\s*[:=]\s*\[?\s*['"]none['"]""", "JWT algorithm none", ("algorithm",), cwe="CWE-347", owasp="API2:2023 Broken Authentication"),
    Rule("CG_API_JWT_002", "critical", "jwt", r"""(?i)\balgorithms?\s*[:=]\s*\[\s*['"](?:HS256|RS256|ES256|HS384|HS512)['"][^\]]*['"]none['"]""", "JWT algorithm list with none", ("algorithm",), cwe="CWE-347"),
    Rule("CG_API_JWT_003", "critical", "jwt", r"""(?i)\bjwt\.verify\s*\([^,)]+,\s*['"][^'"]{1,7}['"]""", "Short JWT secret", ("jwt.verify",), JSX, cwe="CWE-326"),
    Rule("CG_API_JWT_004", "critical", "jwt", r"""(?i)\bjwt\.verify\s*\([^,)]+,\s*['"](?:secret|changeme|password|key|test|1234\d*|jwt_secret)['"]""", "Placeholder JWT secret", ("jwt.verify",), cwe="CWE-259"),
    Rule("CG_API_JWT_005", "medium", "jwt", r"\bjwt\.sign\s*\(\s*\{[^}]*\}\s*,\s*[^,)]+,\s*\{[^}]*\}\s*\)", "JWT expiry to verify", ("jwt.sign",), JS, cwe="CWE-613"),
    Rule("CG_API_JWT_006", "high", "jwt", r"\bjwt\.decode\s*\(", "JWT decoded without verification", ("jwt.decode",), JS, cwe="CWE-347"),
    Rule("CG_API_JWT_007", "critical", "jwt", r"(?i)\bverify_signature\s*[:=]\s*False\b", "Signature verification off", ("verify_signature",), PY, cwe="CWE-347"),
    Rule("CG_API_JWT_008", "critical", "jwt", r"(?i)\bverify\s*[:=]\s*False\b.*\bjwt\.decode", "JWT decode with verify off", ("jwt.decode",), PY, cwe="CWE-347"),
    Rule("CG_API_GQL_001", "medium", "graphql", r"(?i)\bintrospection\s*[:=]\s*true\b", "Introspection on", ("introspection",), cwe="CWE-200"),
    Rule("CG_API_GQL_002", "medium", "graphql", r"(?i)\bplayground\s*[:=]\s*true\b", "Playground on", ("playground",)),
    Rule("CG_API_GQL_003", "info", "graphql", r"\bApolloServer\s*\(\s*\{[^}]*\}\s*\)", "Query limits to verify", ("apolloserver",), JS, cwe="CWE-770"),
    Rule("CG_API_GQL_004", "low", "graphql", r"(?i)\bbatching\s*[:=]\s*true\b|\ballowBatchedHttpRequests\s*[:=]\s*true\b", "Query batching on", ("batching", "allowbatchedhttprequests")),
    Rule("CG_API_DES_001", "critical", "deserialization", r"\bpickle\.loads?\s*\(", "pickle load", ("pickle.load",), PY, cwe="CWE-502"),
    # The original look-behind can never reject a match, so it is left out.
    Rule("CG_API_DES_002", "high", "deserialization", r"\byaml\.load\s*\([^)]*\)", "yaml.load call", ("yaml.load",), PY, cwe="CWE-502"),
    Rule("CG_API_DES_003", "critical", "deserialization", r"\bObjectInputStream\b.*\breadObject\s*\(\s*\)", "Java object stream", ("objectinputstream",), ("java",), cwe="CWE-502"),
    Rule("CG_API_DES_004", "critical", "deserialization", r"\bunserialize\s*\(", "PHP unserialize", ("unserialize",), ("php",), cwe="CWE-502"),
    Rule("CG_API_DES_005", "critical", "deserialization", r"\bMarshal\.load\s*\(", "Ruby Marshal.load", ("marshal.load",), ("ruby",), cwe="CWE-502"),
    Rule("CG_API_DES_006", "critical", "deserialization", r"\bBinaryFormatter\b|\bNetDataContractSerializer\b|\bSoapFormatter\b", ".NET binary formatter", ("binaryformatter", "netdatacontractserializer", "soapformatter"), ("csharp",), cwe="CWE-502"),
    Rule("CG_API_DES_007", "critical", "deserialization", r"\bnode-serialize\b.*\bunserialize\s*\(|\bfuncster\.deepDeserialize\b", "node-serialize", ("node-serialize", "funcster"), JS, cwe="CWE-502"),
    Rule("CG_API_CORS_001", "high", "cors", r"""\bAccess-Control-Allow-Origin['"\s,:]+\*\b""", "CORS wildcard", ("access-control-allow-origin",), cwe="CWE-942", owasp="API7:2023"),
    Rule("CG_API_CORS_002", "high", "cors", r"""(?i)\bcors\s*\(\s*\{\s*origin\s*:\s*(?:true|['"]\*['"])""", "CORS reflects any origin", ("cors",), JS),
    Rule("CG_API_CSRF_001", "medium", "csrf", r"(?i)\bapp\.use\s*\(\s*csrf\s*\(\s*\{\s*cookie\s*:\s*\{\s*secure\s*:\s*false", "Insecure CSRF cookie", ("csrf",), JS, cwe="CWE-614"),
    Rule("CG_API_OR_001", "high", "open-redirect", r"\bres\.redirect\s*\(\s*req\.(?:query|params|body)\b", "Open redirect", ("res.redirect",), JS, cwe="CWE-601", owasp="API7:2023"),
    Rule("CG_API_BOLA_001", "high", "auth-bypass", r"(?i)\bfindOne\s*\(\s*\{\s*(?:_?id|userId)\s*:\s*req\.(?:params|query|body)\.[a-z]+\s*\}\s*\)", "Object read without ownership check", ("findone",), JS, cwe="CWE-639", owasp="API1:2023"),
    Rule("CG_API_BOLA_002", "info", "auth-bypass", r"""@app\.route\s*\(\s*['"][^'"]*<\w+>['"][^)]*\)\s*\n\s*def\s+\w+\s*\([^)]*\)\s*:""", "Route parameter to verify", ("@app.route",), PY, owasp="API1:2023"),
    Rule("CG_API_MA_001", "high", "api-design", r"\b(?:Object\.assign|spread)\s*\(\s*\w+\s*,\s*req\.body\s*\)", "Mass assignment", ("req.body",), JS, cwe="CWE-915", owasp="API6:2023"),
    Rule("CG_API_MA_002", "high", "api-design", r"\bnew\s+\w+\s*\(\s*req\.body\s*\)", "Model built from a request body", ("req.body",), JS, cwe="CWE-915"),
    Rule("CG_API_RL_001", "low", "rate-limit", r"\bapp\.use\s*\(\s*rateLimit\s*\(\s*\{\s*max\s*:\s*(?:[5-9]\d{2,}|\d{4,})", "Permissive rate limit", ("ratelimit",), JS, cwe="CWE-770", owasp="API4:2023"),
    Rule("CG_API_AUTH_001", "info", "api-design", r"\bapp\.use\s*\(\s*(?:cors|helmet)\s*\(\s*\)\s*\)", "Middleware with defaults", ("app.use",)),
))

API = Family("api", RULES, finding_type="api", skip_empty=True,
             comment=SLASH_HASH_STAR, unknown_language="match")
