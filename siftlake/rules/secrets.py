"""Credential patterns."""

from siftlake.rules.model import Family, Rule, check

# Identifiers, severities and patterns.
RULES = check((
    Rule("SEC_AWS_KEY", "critical", "secret", r"AKIA[0-9A-Z]{16}", "AWS access key", ("akia",)),
    Rule("SEC_AWS_SECRET", "critical", "secret",
         r"""(?:aws_secret_access_key|AWS_SECRET_ACCESS_KEY)\s*[=:]\s*['"]?[A-Za-z0-9/+=]{40}""",
         "AWS secret key", ("aws_secret_access_key",)),
    Rule("SEC_GITHUB", "critical", "secret", r"gh[pousr]_[A-Za-z0-9_]{36,}", "GitHub token",
         ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("SEC_STRIPE_SK", "critical", "secret", r"sk_live_[A-Za-z0-9]{24,}", "Stripe secret key", ("sk_live_",)),
    Rule("SEC_STRIPE_PK", "medium", "secret", r"pk_live_[A-Za-z0-9]{24,}", "Stripe publishable key", ("pk_live_",)),
    Rule("SEC_SLACK_TOKEN", "high", "secret", r"xox[bpors]-[A-Za-z0-9-]{10,}", "Slack token", ("xox",)),
    Rule("SEC_PRIVATE_KEY", "critical", "secret", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
         "Private key block", ("private key-----",)),
    Rule("SEC_JWT", "high", "secret",
         r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "JSON web token", ("eyj",)),
    Rule("SEC_GENERIC_SECRET", "high", "secret",
         r"""(?i)(?:secret|password|token|api_key|apikey)\s*[=:]\s*['"][A-Za-z0-9+/=]{16,}['"]""",
         "Secret assigned to a literal", ("secret", "password", "token", "api_key", "apikey")),
    Rule("SEC_DB_URL", "critical", "secret",
         r"""(?:postgres|mysql|mongodb(?:\+srv)?)://[^\s'"]+:[^\s'"]+@[^\s'"]+""",
         "Database URL with credentials", ("postgres://", "mysql://", "mongodb://", "mongodb+srv://")),
))

SECRETS = Family("secret", RULES, finding_type="secret", mask_evidence=True)
