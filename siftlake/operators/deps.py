"""Package references: imports in source code, manifests, lock files, and their resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.versions import cleaned, without_operators
from siftlake.operators.scan import quote, strip, to_lines

# Modules of the Python standard library that are not packages.
PYTHON_STDLIB = (
    "abc", "argparse", "ast", "asyncio", "base64", "bisect", "builtins", "calendar", "cgi", "cmd",
    "codecs", "collections", "colorsys", "compileall", "concurrent", "configparser", "contextlib",
    "contextvars", "copy", "copyreg", "cProfile", "csv", "ctypes", "curses", "dataclasses",
    "datetime", "dbm", "decimal", "difflib", "dis", "doctest", "email", "encodings", "enum",
    "errno", "faulthandler", "filecmp", "fileinput", "fnmatch", "fractions", "ftplib", "functools",
    "gc", "getopt", "getpass", "gettext", "glob", "gzip", "hashlib", "heapq", "hmac", "html", "http",
    "idlelib", "imaplib", "importlib", "inspect", "io", "ipaddress", "itertools", "json", "keyword",
    "linecache", "locale", "logging", "lzma", "mailbox", "math", "mimetypes", "mmap",
    "multiprocessing", "netrc", "numbers", "operator", "os", "pathlib", "pdb", "pickle",
    "pickletools", "platform", "plistlib", "poplib", "posixpath", "pprint", "profile", "pstats",
    "py_compile", "pydoc", "queue", "quopri", "random", "re", "readline", "reprlib", "resource",
    "rlcompleter", "runpy", "sched", "secrets", "select", "selectors", "shelve", "shlex", "shutil",
    "signal", "site", "smtplib", "socket", "socketserver", "sqlite3", "ssl", "stat", "statistics",
    "string", "stringprep", "struct", "subprocess", "sys", "sysconfig", "syslog", "tabnanny",
    "tarfile", "tempfile", "test", "textwrap", "threading", "time", "timeit", "tkinter", "token",
    "tokenize", "tomllib", "trace", "traceback", "tracemalloc", "turtle", "turtledemo", "types",
    "typing", "unicodedata", "unittest", "urllib", "uuid", "venv", "warnings", "wave", "weakref",
    "webbrowser", "wsgiref", "xml", "xmlrpc", "zipapp", "zipfile", "zipimport", "zlib",
    "__future__", "_thread", "_io",
)

# Import statement patterns, one capture group for the package.
JS_IMPORTS = (
    r"""^\s*import\s+(?:(?:[\w*{}\s,]+)\s+from\s+)?['"]([^'"./][^'"]*)['"]""",
    r"""(?<!\w)require\s*\(\s*['"]([^'"./][^'"]*)['"]\s*\)""",
    r"""(?<!\w)import\s*\(\s*['"]([^'"./][^'"]*)['"]\s*\)""",
)
PYTHON_IMPORTS = (r"^\s*import\s+(\w+)", r"^\s*from\s+(\w+)(?:\.\w+)*\s+import")
# Requirement lines and the test for a requirements file.
REQUIREMENT = r"^\s*([a-zA-Z0-9_][\w.-]*)\s*(?:([=!<>~]=?)\s*([\d.]+[\w.]*))?"
PINNED = r"^[a-zA-Z0-9_][\w.-]*\s*([=!<>~]=)"
# Cargo and Go manifest shapes.
CARGO_SECTION = r"(?is)\[dependencies\](.*?)(?:\[|\z)"
CARGO_SIMPLE = r'^([a-zA-Z0-9_-]+)\s*=\s*"([^"]+)"'
CARGO_TABLE = r'^([a-zA-Z0-9_-]+)\s*=\s*\{.*version\s*=\s*"([^"]+)"'
GO_BLOCK = r"(?ms)^[ \t]*require \([^\n]*$(.*?)(?:^[ \t]*\)[ \t\r]*$|\z)"
GO_MODULE = r"^(?:require\s+)?([^\s]+)\s+(v[\d.]+(?:-[^\s]+)?)"
# Manifest sections of a JavaScript package.
MANIFEST_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def package_of(specifier: str) -> str:
    """Package an import specifier names: the sub-path goes, the scope stays."""
    return f"regexp_extract({specifier}, '^(@[^/]+/[^/]+|[^/]+)', 1)"


def pypi_name(name: str) -> str:
    return f"translate(lower({name}), '_', '-')"


def _identifying(corpus: DataFrame, text: str) -> list[str]:
    return [c for c in corpus.columns if c != text]


def _first_line_per_package(refs: DataFrame, keys: Sequence[str], ecosystem: str) -> DataFrame:
    return refs.groupBy(*keys, "name").agg(F.min("line_no").alias("line_no")).withColumn(
        "ecosystem", F.lit(ecosystem)
    )


def js_imports(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Packages a JavaScript or TypeScript file imports, with the first line that does."""
    keys = _identifying(corpus, text)
    lines = to_lines(corpus.filter(f"`{text}` RLIKE 'import|require'"), text=text)
    found = "array_union(array_union({}, {}), {})".format(
        *[f"regexp_extract_all(line, {quote(p)}, 1)" for p in JS_IMPORTS]
    )
    named = lines.filter("line RLIKE 'import|require'").selectExpr(
        *keys, "line_no", f"explode(transform({found}, s -> {package_of('s')})) AS name"
    )
    return _first_line_per_package(named.filter("name <> ''"), keys, "npm")


def python_imports(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Packages a Python file imports, standard library left out, with the first line that does."""
    keys = _identifying(corpus, text)
    lines = to_lines(corpus.filter(f"contains(`{text}`, 'import')"), text=text)
    found = "array_union({}, {})".format(*[f"regexp_extract_all(line, {quote(p)}, 1)" for p in PYTHON_IMPORTS])
    named = lines.filter("contains(line, 'import') AND NOT ltrim(line) LIKE '#%'").selectExpr(
        *keys, "line_no", f"explode({found}) AS module"
    )
    outside = named.filter(~F.col("module").isin(*PYTHON_STDLIB)).filter("NOT startswith(module, '_')")
    return _first_line_per_package(
        outside.selectExpr(*keys, "line_no", f"{pypi_name('module')} AS name"), keys, "pypi"
    )


def read_package_json(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Dependencies of JavaScript manifests, by section; files that are not JSON give none."""
    keys = _identifying(corpus, text)
    schema = ", ".join(f"{s} MAP<STRING, STRING>" for s in MANIFEST_SECTIONS)
    entries = ", ".join(
        f"transform(coalesce(map_entries(m.{s}), array()), e -> named_struct('section', '{s}', 'name', e.key, 'spec', e.value))"
        for s in MANIFEST_SECTIONS
    )
    parsed = corpus.selectExpr(*keys, f"`{text}` AS _text", f"from_json(`{text}`, '{schema}') AS m")
    flat = parsed.selectExpr(*keys, "_text", f"inline(flatten(array({entries})))")
    before = "substring_index(_text, concat('\"', name, '\"'), 1)"
    return flat.selectExpr(
        *keys, f"length({before}) - length(replace({before}, '\\n', '')) + 1 AS line_no", "section", "name",
        f"{cleaned('spec')} AS version", f"{without_operators('spec')} AS bom_version", "'npm' AS ecosystem",
        "section = 'devDependencies' AS dev", "concat('\"', name, '\": \"', spec, '\"') AS raw",
    )


def read_package_lock(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Installed packages of JavaScript lock files, of both layouts, with their license."""
    keys = _identifying(corpus, text)
    schema = ("packages MAP<STRING, STRUCT<version: STRING, resolved: STRING, license: STRING>>, "
              "dependencies MAP<STRING, STRUCT<version: STRING>>")
    parsed = corpus.selectExpr(*keys, f"from_json(`{text}`, '{schema}') AS m")
    by_path = ("transform(filter(coalesce(map_entries(m.packages), array()), e -> contains(e.key, 'node_modules/')), "
               "e -> named_struct('name', regexp_replace(e.key, '.*node_modules/', ''), "
               "'version', coalesce(e.value.version, 'unknown'), 'license', e.value.license))")
    by_name = ("transform(filter(coalesce(map_entries(m.dependencies), array()), e -> m.packages IS NULL), "
               "e -> named_struct('name', e.key, 'version', coalesce(e.value.version, 'unknown'), "
               "'license', CAST(NULL AS STRING)))")
    return parsed.selectExpr(*keys, f"inline(array_distinct(concat({by_path}, {by_name})))").withColumn(
        "ecosystem", F.lit("npm")
    )


def looks_like_requirements(text: str) -> str:
    """SQL condition: more than half of the lines that say something pin a version."""
    lines = f"filter(split({text}, '\\n'), l -> {strip('l')} <> '' AND NOT {strip('l')} LIKE '#%')"
    pinned = f"size(filter({lines}, l -> {strip('l')} RLIKE {quote(PINNED)}))"
    return f"size({lines}) > 0 AND {pinned} / size({lines}) > 0.5"


def read_requirements(corpus: DataFrame, text: str = "text", only_pinned_files: bool = False) -> DataFrame:
    """Requirements of Python projects, one row per line."""
    keys = _identifying(corpus, text)
    source = corpus.filter(looks_like_requirements(f"`{text}`")) if only_pinned_files else corpus
    lines = to_lines(source, text=text).withColumn("line", F.expr(strip("line")))
    kept = lines.filter(f"line <> '' AND NOT line LIKE '#%' AND NOT line LIKE '-%' AND line RLIKE {quote(REQUIREMENT)}")
    version = f"regexp_extract(line, {quote(REQUIREMENT)}, 3)"
    return kept.selectExpr(
        *keys, "line_no", f"{pypi_name(f'regexp_extract(line, {quote(REQUIREMENT)}, 1)')} AS name",
        f"nullif({version}, '') AS version", "'pypi' AS ecosystem", "line AS raw",
    )


def read_cargo_toml(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Dependencies of Rust manifests."""
    keys = _identifying(corpus, text)
    section = f"regexp_extract(`{text}`, {quote(CARGO_SECTION)}, 1)"
    lines = corpus.filter(f"contains(lower(`{text}`), '[dependencies]')").selectExpr(
        *keys, f"explode(split({section}, '\\n')) AS line"
    ).withColumn("line", F.expr(strip("line")))
    simple, table = quote(CARGO_SIMPLE), quote(CARGO_TABLE)
    shape = f"CASE WHEN line RLIKE {simple} THEN {simple} ELSE {table} END"
    return lines.filter(f"line RLIKE {simple} OR line RLIKE {table}").selectExpr(
        *keys, f"regexp_extract(line, {shape}, 1) AS name", f"regexp_extract(line, {shape}, 2) AS version",
        "'cargo' AS ecosystem",
    )


def read_go_mod(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Required modules of Go manifests, in blocks and on single lines."""
    keys = _identifying(corpus, text)
    blocks = f"flatten(transform(regexp_extract_all(`{text}`, {quote(GO_BLOCK)}, 1), b -> split(b, '\\n')))"
    singles = (f"filter(split(regexp_replace(`{text}`, {quote(GO_BLOCK)}, ''), '\\n'), "
               f"l -> startswith({strip('l')}, 'require '))")
    lines = corpus.filter(f"contains(`{text}`, 'require')").selectExpr(
        *keys, f"explode(concat({blocks}, {singles})) AS line"
    ).withColumn("line", F.expr(strip("line")))
    shape = quote(GO_MODULE)
    return lines.filter(f"line RLIKE {shape}").selectExpr(
        *keys, f"regexp_extract(line, {shape}, 1) AS name", f"regexp_extract(line, {shape}, 2) AS version",
        "'go' AS ecosystem",
    )


_DEV = ("-D", "--save-dev")
_GLOBAL = ("-g", "--global")
# Install commands: pattern, tool, ecosystem, development flags, global flags.
INSTALL_COMMANDS = (
    (r"(?i)^(?:npm|npx)\s+(?:install|i|add)\s+(.+)", "npm", "npm", _DEV, _GLOBAL),
    (r"(?i)^yarn\s+add\s+(.+)", "yarn", "npm", ("-D", "--dev"), ()),
    (r"(?i)^pnpm\s+(?:add|install)\s+(.+)", "pnpm", "npm", _DEV, _GLOBAL),
    (r"(?i)^(?:pip3?|python3?\s+-m\s+pip|uv\s+pip)\s+install\s+(.+)", "pip", "pypi", (), ()),
    (r"(?i)^poetry\s+add\s+(.+)", "poetry", "pypi", ("-D", "--dev", "--group=dev"), ()),
    (r"(?i)^uv\s+add\s+(.+)", "uv", "pypi", ("-D", "--dev"), ()),
    (r"(?i)^cargo\s+(?:add|install)\s+(.+)", "cargo", "cargo", ("--dev",), ()),
    (r"(?i)^go\s+get\s+(.+)", "go", "go", (), ()),
)


def parse_install_commands(commands: DataFrame, column: str = "command") -> DataFrame:
    """One row per package named on an install command line."""
    keys = [c for c in commands.columns if c != column]
    trimmed = strip(f"`{column}`")

    def strings(values: Sequence[str]) -> str:
        return "array(" + ", ".join(quote(v) for v in values) + ")" if values else "CAST(array() AS ARRAY<STRING>)"

    matched = " ".join(
        f"WHEN {trimmed} RLIKE {quote(p)} THEN named_struct('manager', '{m}', 'ecosystem', '{e}', "
        f"'args', split(trim(regexp_extract({trimmed}, {quote(p)}, 1)), {quote(chr(92) + 's+')}), "
        f"'dev', {strings(d)}, 'everywhere', {strings(g)})"
        for p, m, e, d, g in INSTALL_COMMANDS
    )
    parsed = commands.selectExpr(*keys, f"{trimmed} AS command", f"CASE {matched} END AS m").filter("m IS NOT NULL")
    words = parsed.selectExpr(
        *keys, "command", "m.manager", "m.ecosystem",
        "arrays_overlap(m.args, m.dev) AS is_dev", "arrays_overlap(m.args, m.everywhere) AS is_global",
        "explode(filter(m.args, w -> w <> '' AND NOT startswith(w, '-') "
        "AND NOT (m.manager = 'pip' AND endswith(w, '.txt')))) AS word",
    )
    bare = "trim(regexp_replace(regexp_replace(word, {}, ''), {}, ''))".format(
        quote(r"@[\d^~>=<.*]+.*$"), quote(r"[><=!~]+[\d.]+.*$"))
    return words.selectExpr(*keys, "command", "manager", "ecosystem", "is_dev", "is_global", f"{bare} AS name").filter(
        "name <> ''"
    )


def ignore_packages(refs: DataFrame, names: Sequence[str] = (), scopes: Sequence[str] = ()) -> DataFrame:
    """Leave out packages by name, in any case, and by prefix of a private scope."""
    kept = refs
    if names:
        kept = kept.filter(~F.lower("name").isin(*[n.lower() for n in names]))
    for scope in scopes:
        kept = kept.filter(~F.col("name").startswith(scope))
    return kept


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key by an explicit order.

    An aggregate rather than a window, so that a key with very many rows is reduced before
    the shuffle and never gathered in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def resolve_versions(refs: DataFrame, manifest: DataFrame, lockfile: DataFrame, registry: DataFrame) -> DataFrame:
    """Version of each reference: from the manifest, else the lock file, else the registry's latest.

    ``manifest`` and ``lockfile`` have (project, ecosystem, name, version), one row per key;
    ``registry`` has (ecosystem, name, latest, deprecated).
    """
    keys = ["project", "ecosystem", "name"]
    m = manifest.select(*keys, F.col("version").alias("_manifest"))
    k = lockfile.select(*keys, F.col("version").alias("_lock"))
    r = registry.select("ecosystem", "name", F.col("latest").alias("_latest"), F.col("deprecated").alias("_deprecated"))
    joined = refs.join(m, keys, "left").join(k, keys, "left").join(r, ["ecosystem", "name"], "left")
    from_registry = F.expr("_manifest IS NULL AND _lock IS NULL")
    return joined.select(
        *refs.columns,
        F.coalesce("_manifest", "_lock", "_latest").alias("version"),
        F.expr("CASE WHEN _manifest IS NOT NULL THEN 'manifest' WHEN _lock IS NOT NULL THEN 'lockfile' "
               "WHEN _latest IS NOT NULL THEN 'registry-latest' ELSE 'none' END").alias("version_source"),
        (from_registry & F.coalesce("_deprecated", F.lit(False))).alias("is_deprecated"),
    )


def purl(ecosystem: str, name: str, version: str) -> str:
    kind = f"CASE {ecosystem} WHEN 'go' THEN 'golang' ELSE {ecosystem} END"
    return f"concat('pkg:', {kind}, '/', {name}, '@', {version})"


def build_sbom(components: DataFrame) -> DataFrame:
    """Components of each project, one per reference; of duplicates the first source wins.

    Input: (project, source_order, ecosystem, name, version, license, dev).
    """
    named = components.selectExpr("*", f"{purl('ecosystem', 'name', 'version')} AS bom_ref")
    chosen = first_per_key(named, ["project", "bom_ref"], ["source_order", "name"])
    return chosen.withColumn("purl", F.col("bom_ref")).drop("source_order")


def attach_vulnerabilities(components: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """The advisories of each component, one row per pair; components without any are left out."""
    found = vulnerabilities.select(
        "ecosystem", F.lower("package_name").alias("_name"), "vuln_id", F.col("severity").alias("vuln_severity")
    ).distinct()
    return components.withColumn("_name", F.lower("name")).join(found, ["ecosystem", "_name"]).drop("_name")
