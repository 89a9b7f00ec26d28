"""Routing of files: scan family, language and framework from the path and the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.rules import models
from siftlake.vocab import literal_map

# Source extensions, directories that are not scanned, and languages by extension.
SOURCE_EXTENSIONS = ("js", "ts", "jsx", "tsx", "py", "mjs", "cjs")
IGNORED_DIRECTORIES = ("node_modules", ".git", "dist", "out", "build", "__pycache__", ".venv", "venv")
LANGUAGES = {
    "js": "javascript", "jsx": "javascriptreact", "ts": "typescript", "tsx": "typescriptreact",
    "mjs": "javascript", "cjs": "javascript", "py": "python", "pyw": "python", "java": "java",
    "rb": "ruby", "go": "go", "php": "php", "cs": "csharp",
}
# Files that may hold prompts.
PROMPT_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".env",
                     ".cursorrules", ".windsurfrules", ".clinerules")
PROMPT_NAMES = ("claude.md", "gemini.md", "copilot-instructions.md", "system-prompt.txt", "prompt.txt",
                "prompts.yaml", "rules.md", ".cursorrules", ".windsurfrules")
# Lock files, which carry no findings of their own.
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "go.sum")


def base_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty when there is none; a leading dot does not start one."""
    return F.regexp_extract(F.lower(base_name(path)), r"^.+(\.[^.]*)$", 1)


def guess_language(path: Column) -> Column:
    last = F.substring_index(F.lower(path), ".", -1)
    return F.try_element_at(literal_map(LANGUAGES), last)


def infrastructure_framework(path: Column, text: Column) -> Column:
    base, ext = F.lower(base_name(path)), extension(path)
    # What makes a YAML file a Kubernetes manifest or a compose file.
    kubernetes = text.rlike(r"(?i)\bapiVersion\s*:\s*") & text.rlike(r"(?i)\bkind\s*:\s*")
    compose = text.rlike(r"""(?m)^\s*version\s*:\s*['"]?[0-9]+(?:\.[0-9]+)?['"]?\s*$""") & text.rlike(r"(?m)\bservices\s*:")
    yaml = ext.isin(".yaml", ".yml")
    return (
        F.when((base == "dockerfile") | base.startswith("dockerfile.") | (ext == ".dockerfile"), "dockerfile")
        .when(ext.isin(".tf", ".tfvars", ".hcl"), "terraform")
        .when(yaml & kubernetes, "kubernetes")
        .when(yaml & compose, "compose")
    )


def model_format(path: Column) -> Column:
    ext, base = extension(path), F.lower(base_name(path))
    return (
        F.when(ext.isin(*models.PICKLE_EXTENSIONS), "pickle")
        .when(ext.isin(*models.KERAS_EXTENSIONS), "keras")
        .when(ext.isin(*models.ONNX_EXTENSIONS), "onnx")
        .when(ext.isin(*models.SAFETENSORS_EXTENSIONS), "safetensors")
        .when(base.isin(*models.CONFIG_NAMES), "hf-config")
        .otherwise("unknown")
    )


def may_hold_prompts(path: Column) -> Column:
    low = F.lower(F.translate(path, "\\", "/"))
    by_extension = F.lit(False)
    for ext in PROMPT_EXTENSIONS:
        by_extension = by_extension | low.endswith(ext)
    return F.substring_index(low, "/", -1).isin(*PROMPT_NAMES) | by_extension


def classify(corpus: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Adds language, IaC framework, model format, prompt, source and lock-file flags to every file."""
    p = F.col(path)
    return corpus.select(
        "*",
        guess_language(p).alias("lang"),
        infrastructure_framework(p, F.col(text)).alias("framework"),
        model_format(p).alias("model_format"),
        may_hold_prompts(p).alias("may_hold_prompts"),
        F.ltrim(extension(p), F.lit(".")).isin(*SOURCE_EXTENSIONS).alias("is_source"),
        F.lower(base_name(p)).isin(*LOCK_FILES).alias("is_lock_file"),
    )


def outside_ignored_directories(path: Column) -> Column:
    directories = "|".join(d.replace(".", r"\.") for d in IGNORED_DIRECTORIES)
    return ~F.translate(path, "\\", "/").rlike(rf"(^|/)({directories})/")
