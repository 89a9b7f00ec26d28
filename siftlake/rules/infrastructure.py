"""Infrastructure-as-code rules: Dockerfile, Kubernetes and Terraform."""

from siftlake.rules.model import HASH_SLASH, Family, Rule, check

_D, _K, _T = ("dockerfile",), ("kubernetes",), ("terraform",)

# Identifiers, severities, patterns and benchmark references.
DOCKER_RULES = check((
    Rule("CG_IAC_DOCKER_001", "medium", "dockerfile", r"(?im)^\s*FROM\s+[^\s#]+:latest\s*$", "Image tag latest", (":latest",), frameworks=_D, cis="CIS-Docker 4.9"),
    Rule("CG_IAC_DOCKER_002", "low", "dockerfile", r"(?im)^\s*FROM\s+[^@\s#]+$", "Image not pinned by digest", ("from",), frameworks=_D),
    Rule("CG_IAC_DOCKER_003", "high", "dockerfile", r"(?im)^\s*(?:USER|user)\s+(?:0|root)\s*$", "Runs as root", ("user",), frameworks=_D, cis="CIS-Docker 4.1"),
    Rule("CG_IAC_DOCKER_004", "high", "dockerfile", r"(?i)\bcurl\s+(?:-[a-zA-Z]+\s+)*[^|\n]*\s*\|\s*(?:sh|bash|zsh|ash)\b", "curl piped to a shell", ("curl",), frameworks=_D, cis="CIS-Docker 4.9"),
    Rule("CG_IAC_DOCKER_005", "high", "dockerfile", r"(?i)\bwget\s+(?:-[a-zA-Z]+\s+)*[^|\n]*\s*\|\s*(?:sh|bash|zsh)\b", "wget piped to a shell", ("wget",), frameworks=_D),
    Rule("CG_IAC_DOCKER_006", "medium", "dockerfile", r"(?im)^\s*ADD\s+https?://", "ADD from a URL", ("add",), frameworks=_D),
    Rule("CG_IAC_DOCKER_007", "medium", "dockerfile", r"\bchmod\s+(?:-R\s+)?(?:0?777|\+rwx)\b", "World-writable files", ("chmod",), frameworks=_D),
    Rule("CG_IAC_DOCKER_008", "high", "dockerfile", r"\b(?:--no-check-certificate|--insecure|-k\b)", "TLS verification off", ("--no-check-certificate", "--insecure", "-k"), frameworks=_D),
    Rule("CG_IAC_DOCKER_009", "critical", "dockerfile", r"(?im)^\s*ENV\s+(?:[A-Z_]+_(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|PWD))\s*=?\s*\S+", "Secret in ENV", ("env",), frameworks=_D, cis="CIS-Docker 4.10"),
    Rule("CG_IAC_DOCKER_010", "low", "dockerfile", r"(?im)^\s*RUN\s+.*\bsudo\s+", "sudo in a build step", ("sudo",), frameworks=_D),
    Rule("CG_IAC_DOCKER_011", "medium", "dockerfile", r"(?im)^\s*EXPOSE\s+(?:22|3389)\s*$", "Remote-access port exposed", ("expose",), frameworks=_D),
))

# Identifiers, severities, patterns and benchmark references.
KUBERNETES_RULES = check((
    Rule("CG_IAC_K8S_001", "critical", "kubernetes", r"(?im)^\s*privileged\s*:\s*true\b", "Privileged container", ("privileged",), frameworks=_K, cis="CIS-Kubernetes 5.2.1"),
    Rule("CG_IAC_K8S_002", "high", "kubernetes", r"(?im)^\s*allowPrivilegeEscalation\s*:\s*true\b", "Privilege escalation allowed", ("allowprivilegeescalation",), frameworks=_K, cis="CIS-Kubernetes 5.2.5"),
    Rule("CG_IAC_K8S_003", "critical", "kubernetes", r"(?im)^\s*hostNetwork\s*:\s*true\b", "Host network", ("hostnetwork",), frameworks=_K, cis="CIS-Kubernetes 5.2.2"),
    Rule("CG_IAC_K8S_004", "critical", "kubernetes", r"(?im)^\s*hostPID\s*:\s*true\b", "Host PID namespace", ("hostpid",), frameworks=_K, cis="CIS-Kubernetes 5.2.3"),
    Rule("CG_IAC_K8S_005", "high", "kubernetes", r"(?im)^\s*hostIPC\s*:\s*true\b", "Host IPC namespace", ("hostipc",), frameworks=_K),
    Rule("CG_IAC_K8S_006", "high", "kubernetes", r"(?im)^\s*runAsUser\s*:\s*0\b", "Runs as user 0", ("runasuser",), frameworks=_K, cis="CIS-Kubernetes 5.2.6"),
    Rule("CG_IAC_K8S_007", "medium", "kubernetes", r"(?im)^\s*readOnlyRootFilesystem\s*:\s*false\b", "Writable root file system", ("readonlyrootfilesystem",), frameworks=_K, cis="CIS-Kubernetes 5.2.8"),
    Rule("CG_IAC_K8S_008", "high", "kubernetes", r"(?im)^\s*-\s*(?:NET_ADMIN|SYS_ADMIN|SYS_PTRACE|SYS_MODULE|ALL)\b", "Dangerous capability", ("net_admin", "sys_admin", "sys_ptrace", "sys_module", "all"), frameworks=_K, cis="CIS-Kubernetes 5.2.7"),
    Rule("CG_IAC_K8S_009", "medium", "kubernetes", r"(?im)^\s*image\s*:\s*[^\s#]+:latest\s*$", "Image tag latest", (":latest",), frameworks=_K),
    Rule("CG_IAC_K8S_010", "critical", "kubernetes", r"(?im)^\s*path\s*:\s*/(?:etc|proc|sys|var/run/docker\.sock|root)\b", "Sensitive host path", ("path",), frameworks=_K),
    Rule("CG_IAC_K8S_011", "medium", "kubernetes", r"(?im)^\s*automountServiceAccountToken\s*:\s*true\b", "Service account token mounted", ("automountserviceaccounttoken",), frameworks=_K),
    Rule("CG_IAC_K8S_012", "critical", "kubernetes", r"""(?im)^\s*-\s*name\s*:\s*(?:KUBERNETES_SERVICE_HOST|AWS_SECRET_ACCESS_KEY|DB_PASSWORD)\s*\n\s*value\s*:\s*['"]?[^$]""", "Secret as plain value", ("name",), frameworks=_K),
))

# Identifiers, severities, patterns and benchmark references.
TERRAFORM_RULES = check((
    Rule("CG_IAC_TF_001", "critical", "terraform", r'(?i)\bacl\s*=\s*"public-read(?:-write)?"', "Public bucket ACL", ("public-read",), frameworks=_T, cis="CIS-AWS 1.20"),
    Rule("CG_IAC_TF_002", "high", "terraform", r'(?i)\bcidr_blocks?\s*=\s*\[[^\]]*"0\.0\.0\.0/0"', "Open to the internet", ("cidr_block",), frameworks=_T, cis="CIS-AWS 4.1"),
    Rule("CG_IAC_TF_003", "critical", "terraform", r"(?i)\bpubliclly_accessible\s*=\s*true\b|\bpublicly_accessible\s*=\s*true\b", "Public database", ("_accessible",), frameworks=_T, cis="CIS-AWS 2.3.3"),
    Rule("CG_IAC_TF_004", "high", "terraform", r"(?i)\bserver_side_encryption_configuration\s*=\s*\[?\s*\]", "Empty encryption configuration", ("server_side_encryption_configuration",), frameworks=_T),
    Rule("CG_IAC_TF_005", "medium", "terraform", r"(?i)\bskip_final_snapshot\s*=\s*true\b", "Final snapshot skipped", ("skip_final_snapshot",), frameworks=_T),
    Rule("CG_IAC_TF_006", "high", "terraform", r"(?i)\bstorage_encrypted\s*=\s*false\b", "Storage not encrypted", ("storage_encrypted",), frameworks=_T, cis="CIS-AWS 2.3.1"),
    Rule("CG_IAC_TF_007", "high", "terraform", r'(?i)"(?:Action|Resource)"\s*:\s*"\*"', "Wildcard IAM policy", ('"action"', '"resource"'), frameworks=_T, cis="CIS-AWS 1.16"),
    Rule("CG_IAC_TF_008", "critical", "terraform", r'(?i)\b(?:access_key|secret_key|aws_access_key_id|aws_secret_access_key|password)\s*=\s*"[^"$]{8,}"', "Credential in Terraform", ("access_key", "secret_key", "password"), frameworks=_T),
    Rule("CG_IAC_TF_009", "medium", "terraform", r"(?i)\benable_deletion_protection\s*=\s*false\b", "Deletion protection off", ("enable_deletion_protection",), frameworks=_T),
    Rule("CG_IAC_TF_010", "medium", "terraform", r"(?i)\bversioning\s*\{\s*enabled\s*=\s*false\s*\}", "Versioning off", ("versioning",), frameworks=_T, cis="CIS-AWS 2.1.3"),
    Rule("CG_IAC_TF_011", "critical", "terraform", r"(?i)\ballow_public_access\s*=\s*true\b|\ballow_blob_public_access\s*=\s*true\b", "Public storage", ("public_access",), frameworks=_T),
    Rule("CG_IAC_TF_012", "critical", "terraform", r'(?i)\brole\s*=\s*"roles/(?:viewer|editor|owner)"\s*\n?\s*members?\s*=\s*\[[^\]]*"allUsers"', "Role bound to all users", ("allusers",), frameworks=_T),
))

IAC = Family("iac", DOCKER_RULES + KUBERNETES_RULES + TERRAFORM_RULES, finding_type="iac",
             skip_empty=True, comment=HASH_SLASH)

# The file-level rule and the directive whose absence triggers it.
NO_USER_RULE = Rule("CG_IAC_DOCKER_000", "high", "dockerfile", r"(?im)^\s*USER\s+\S+", "No USER directive", frameworks=_D, cis="CIS-Docker 4.1")
