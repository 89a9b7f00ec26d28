"""Look-alike package names, found through equal blocking keys instead of all pairs.

Two names can only be similar in one of the ways the score knows if they share at least
one key: a string left after deleting up to two characters, the name without separators,
a phonetic key, a fold of look-alike characters, a name with a common suffix or prefix
removed, and so on.  The keys turn the similarity join into an equality join, which Spark
broadcasts when the list of targets is small by its own measure and shuffles otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from siftlake.operators.scan import quote
from siftlake.vocab import local_table

# Popular npm packages, in order.
POPULAR_NPM = tuple("""
react react-dom lodash chalk express axios moment typescript webpack eslint prettier next vue angular rxjs jquery
@babel/core babel-core babel-loader @types/node @types/react underscore ramda debug commander yargs mocha jest chai
sinon nyc ts-node nodemon cors body-parser dotenv uuid jsonwebtoken bcrypt bcryptjs passport helmet morgan winston
bunyan pino fs-extra glob minimist inquirer ora cli-progress puppeteer playwright cheerio jsdom ws socket.io
node-fetch got request form-data multer sharp pdfkit archiver zod yup joi ajv semver dayjs date-fns luxon numeral
mongodb mongoose mysql mysql2 pg redis ioredis sqlite3 sequelize prisma typeorm knex graphql apollo-server
apollo-client @apollo/client swr react-query @tanstack/react-query redux @reduxjs/toolkit react-redux zustand recoil
mobx tailwindcss styled-components @emotion/react @emotion/styled bootstrap material-ui @mui/material
@chakra-ui/react antd framer-motion react-router react-router-dom vite rollup parcel esbuild swc @swc/core gulp grunt
browserify core-js regenerator-runtime polyfill is-promise is-array is-buffer is-stream safe-buffer readable-stream
stream minimatch rimraf mkdirp ncp cross-spawn execa shelljs npm yarn pnpm electron nw firebase @firebase/app aws-sdk
@aws-sdk/client-s3 stripe @sentry/node @sentry/react openai @anthropic-ai/sdk langchain @langchain/core tiktoken
cohere-ai replicate huggingface @huggingface/inference
""".split())

# Popular PyPI packages, in order.
POPULAR_PYPI = tuple("""
numpy pandas scipy matplotlib scikit-learn tensorflow torch keras requests urllib3 flask django fastapi starlette
pydantic sqlalchemy alembic psycopg2 pymongo redis celery pytest unittest mock coverage tox black flake8 pylint mypy
isort autopep8 pre-commit click typer argparse rich pygments loguru structlog python-dotenv pyyaml toml jsonschema
marshmallow attrs dataclasses-json pytz arrow pendulum python-dateutil cryptography pycryptodome pyjwt bcrypt passlib
paramiko fabric ansible docker kubernetes boto3 botocore aws-cdk google-cloud google-api-python-client azure-core
azure-storage-blob openai anthropic langchain langchain-core langchain-community llama-index transformers datasets
accelerate huggingface-hub sentence-transformers tiktoken tokenizers safetensors peft bitsandbytes diffusers
opencv-python pillow imageio scikit-image albumentations beautifulsoup4 lxml html5lib selenium playwright scrapy
aiohttp httpx websockets asyncio trio anyio uvloop uvicorn gunicorn hypercorn waitress flask-login flask-sqlalchemy
djangorestframework graphene strawberry-graphql ariadne gql jinja2 mako chameleon werkzeug itsdangerous blinker
setuptools wheel pip virtualenv poetry pipenv hatch cython pybind11 numba cffi pycparser nltk spacy gensim textblob
polyglot networkx igraph graph-tool sympy statsmodels seaborn plotly bokeh altair dash streamlit gradio jupyter
ipython notebook jupyterlab papermill nbformat ipykernel ipywidgets
""".split())

# Neighbouring keys of each key.
KEYBOARD = {
    "a": "qwsz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "w34rds", "f": "drtgvc", "g": "ftyhbv",
    "h": "gyujnb", "i": "u89okj", "j": "huikmn", "k": "jiolm", "l": "kop", "m": "njk", "n": "bhjm",
    "o": "i90plk", "p": "o0l", "q": "12wa", "r": "e45tfd", "s": "awedxz", "t": "r56ygf", "u": "y78ijh",
    "v": "cfgb", "w": "q23esa", "x": "zsdc", "y": "t67uhg", "z": "asx", "0": "9op", "1": "q2", "2": "1qw3",
    "3": "2we4", "4": "3er5", "5": "4rt6", "6": "5ty7", "7": "6yu8", "8": "7ui9", "9": "8io0",
}
# Characters that look like each letter.
HOMOGLYPHS = {
    "a": "аα@4äàá", "b": "Ьβ68", "c": "сϲ¢",
    "d": "ԁđ", "e": "еε3èé", "g": "ɡ9", "h": "һ", "i": "іι1l|",
    "j": "ј", "k": "κк", "l": "1I|ł", "m": "м", "n": "ηп",
    "o": "оο0ö", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ$5",
    "t": "т7", "u": "υμ", "v": "ν", "w": "шw", "x": "хχ",
    "y": "уγ", "z": "z2",
}
# Suffixes and prefixes that imitate a variant of a package.
SUFFIXES = (
    "-cli", "-js", "-ts", "-pro", "-plus", "-official", "-core", "-utils", "-helper", "-helpers", "-tools",
    "-bundle", "-toolkit", "-lib", "-library", "-sdk", "-api", "-v2", "-v3", "-next", "-fork", "-community",
    "-enterprise", "2", "3", "-free", "-premium", "-nightly",
)
PREFIXES = ("official-", "real-", "true-", "genuine-", "fast-", "better-", "improved-", "secure-")
# Weight of each signal, in the order they are added.
WEIGHTS = (
    ("levenshtein-1", 0.7), ("levenshtein-2", 0.3), ("keyboard-adjacent", 0.3), ("homoglyph", 0.85),
    ("phonetic", 0.35), ("transposition", 0.25), ("separator", 0.4), ("insertion", 0.2), ("deletion", 0.2),
    ("suffix-trick", 0.45), ("prefix-trick", 0.5), ("plural-flip", 0.35), ("scope-drop", 0.55), ("case-variant", 0.9),
)
# A transposition on a long name scores this much without any other signal, so it has no key of its own.
LOWEST_THRESHOLD = 0.35


def popular_packages(spark: SparkSession) -> DataFrame:
    """The built-in targets: (ecosystem, target, ord)."""
    rows = [("npm", n, i) for i, n in enumerate(POPULAR_NPM)]
    rows += [("pypi", n, len(POPULAR_NPM) + i) for i, n in enumerate(POPULAR_PYPI)]
    return local_table(spark, rows, "ecosystem string, target string, ord int")


def phonetic_key(name: str) -> str:
    """SQL text of a rough sound key of a lower-case name."""
    key = f"concat(substring({name}, 1, 1), regexp_replace(substring({name}, 2), '[aeiou]', ''))"
    # The substitutions, in order.
    for pattern, replacement in (("ph", "f"), ("ck", "k"), ("ght", "t"), ("[cq]", "k"), ("z", "s"), ("y", "i")):
        key = f"regexp_replace({key}, '{pattern}', '{replacement}')"
    return f"regexp_replace({key}, '(.)\\\\1+', '$1')"


def stripped(name: str) -> str:
    return f"regexp_replace({name}, '[-_.]', '')"


def _look_alike_classes() -> tuple[str, str]:
    """Every look-alike character and the representative of its class.

    The relation is not transitive; its classes are, so equal folds are implied by it.
    """
    group: dict[str, str] = {}

    def find(c: str) -> str:
        while group.setdefault(c, c) != c:
            c = group[c]
        return c

    for letter, others in HOMOGLYPHS.items():
        for other in others:
            a, b = find(letter), find(other)
            if a != b:
                group[max(a, b)] = min(a, b)
    members = sorted(c for c in group if find(c) != c)
    return "".join(members), "".join(find(c) for c in members)


def _deletions(name: str, twice: str) -> str:
    """SQL text: the name and what is left of it after one deletion, and after two where ``twice`` holds."""
    once = ("transform(sequence(1, greatest(length({0}), 1)), "
            "i -> concat(substring({0}, 1, i - 1), substring({0}, i + 1)))")
    first = once.format(name)
    second = f"flatten(transform({first}, s -> {once.format('s')}))"
    return f"array_distinct(concat(array({name}), {first}, IF({twice}, {second}, CAST(array() AS ARRAY<STRING>))))"


def _tag(kind: str, values: str) -> str:
    return f"transform({values}, v -> concat('{kind}:', v))"


def edit_candidates(names: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that may be within two edits: equal ``by`` columns and a common deletion."""
    left = names.select("*", F.explode(F.expr(_deletions("_low", "true"))).alias("_key"))
    right = targets.select("*", F.explode(F.expr(_deletions("_target_low", "true"))).alias("_key"))
    return left.join(right, [*by, "_key"]).drop("_key").distinct()


def nearest_popular(names: DataFrame, targets: DataFrame) -> DataFrame:
    """The closest popular name at distance one or two; popular names have none, ties go to list order.

    ``names`` has (ecosystem, name), ``targets`` (ecosystem, target, ord).
    """
    low = names.select("ecosystem", "name").distinct().withColumn("_low", F.lower("name"))
    known = targets.withColumn("_target_low", F.lower("target"))
    listed = known.select("ecosystem", F.col("_target_low").alias("_low")).distinct()
    fresh = low.join(listed, ["ecosystem", "_low"], "left_anti")
    # A name longer than the longest target by more than two has none within two edits.
    longest = known.groupBy("ecosystem").agg(F.max(F.length("_target_low")).alias("_longest"))
    short = fresh.join(longest, "ecosystem").filter("length(_low) <= _longest + 2").drop("_longest")
    pairs = edit_candidates(short, known, ["ecosystem"]).withColumn(
        "distance", F.expr("levenshtein(_low, _target_low, 2)")
    )
    best = pairs.filter("distance > 0").groupBy("ecosystem", "name").agg(
        F.min_by(F.struct("target", "distance"), F.struct("distance", "ord")).alias("b")
    )
    return best.select("ecosystem", "name", F.col("b.target").alias("suggestion"), F.col("b.distance").alias("distance"))


@F.pandas_udf(T.IntegerType())
def osa_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edit distance in which swapping two neighbours counts once; each substring is edited at most once."""

    def distance(a: str, b: str) -> int:
        before, above = [0] * (len(b) + 1), list(range(len(b) + 1))
        for i, x in enumerate(a, start=1):
            row = [i]
            for j, y in enumerate(b, start=1):
                best = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, before[j - 2] + 1)
                row.append(best)
            before, above = above, row
        return above[-1]

    return pd.Series([distance(a, b) for a, b in zip(left, right)], dtype="int32")


def _name_keys() -> str:
    """SQL text of the blocking keys of a candidate name."""
    folded_from, folded_to = _look_alike_classes()
    exact = [
        "array(_low, concat(_low, 's'), concat(_low, 'es'))",
        "IF(endswith(_low, 's'), array(left(_low, length(_low) - 1)), CAST(array() AS ARRAY<STRING>))",
        "IF(endswith(_low, 'es'), array(left(_low, length(_low) - 2)), CAST(array() AS ARRAY<STRING>))",
    ]
    exact += [f"IF(endswith(_low, '{s}'), array(left(_low, length(_low) - {len(s)})), CAST(array() AS ARRAY<STRING>))" for s in SUFFIXES]
    exact += [f"IF(startswith(_low, '{p}'), array(substring(_low, {len(p) + 1})), CAST(array() AS ARRAY<STRING>))" for p in PREFIXES]
    keys = [
        _tag("d", _deletions("_low", "length(_low) >= 4")),
        _tag("s", f"array({stripped('_low')})"),
        _tag("p", f"array({phonetic_key('_low')})"),
        _tag("h", f"array(translate(_low, {quote(folded_from)}, {quote(folded_to)}))"),
        _tag("x", f"array_distinct(concat({', '.join(exact)}))"),
    ]
    return f"concat({', '.join(keys)})"


def _target_keys() -> str:
    """SQL text of the blocking keys of a target."""
    folded_from, folded_to = _look_alike_classes()
    scope = ("IF(startswith(target, '@'), array(replace(substring(target, 2), '/', '-'), "
             "replace(substring(target, 2), '/', '_'), replace(substring(target, 2), '/', '')), "
             "CAST(array() AS ARRAY<STRING>))")
    keys = [
        _tag("d", _deletions("_target_low", "length(_target_low) >= 6")),
        _tag("s", f"array({stripped('_target_low')})"),
        _tag("p", f"array({phonetic_key('_target_low')})"),
        _tag("h", f"array(translate(_target_low, {quote(folded_from)}, {quote(folded_to)}))"),
        _tag("x", f"array_distinct(concat(array(_target_low), {scope}))"),
    ]
    return f"concat({', '.join(keys)})"


def _sql_map(values: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in values.items()) + ")"


def similarity_signals(pairs: DataFrame) -> DataFrame:
    """Adds the list of signals of every (name, target) pair, with both edit distances."""
    # Up to one edit both distances agree, so only the other pairs are measured in Python.
    lev = pairs.withColumn("_lev", F.levenshtein("_low", "_target_low"))
    measured = lev.filter("_lev <= 1").withColumn("_osa", F.col("_lev")).unionByName(
        lev.filter("_lev > 1").withColumn("_osa", osa_distance("_low", "_target_low")))
    chars = "zip_with(split(_low, ''), split(_target_low, ''), (a, b) -> named_struct('a', a, 'b', b))"
    differing = f"filter({chars}, c -> c.a <> c.b)"
    near = f"coalesce(try_element_at({_sql_map(KEYBOARD)}, c.a), '')"
    alike = f"coalesce(try_element_at({_sql_map(HOMOGLYPHS)}, c.b), '')"
    same_length = "length(_low) = length(_target_low)"
    suffix = " OR ".join(f"_low = concat(_target_low, '{s}')" for s in SUFFIXES)
    prefix = " OR ".join(f"_low = concat('{p}', _target_low)" for p in PREFIXES)
    conditions = {
        "levenshtein-1": "_osa = 1",
        "levenshtein-2": "_osa = 2 AND length(_target_low) >= 6",
        "keyboard-adjacent": f"{same_length} AND size({differing}) BETWEEN 1 AND 2 "
                             f"AND forall({differing}, c -> contains({near}, c.b))",
        "homoglyph": f"{same_length} AND size({differing}) > 0 AND forall({differing}, c -> contains({alike}, c.a))",
        "phonetic": f"{phonetic_key('_low')} = {phonetic_key('_target_low')} AND _low <> _target_low AND _osa <= 3",
        "transposition": "_osa < _lev",
        "separator": f"{stripped('_low')} = {stripped('_target_low')} AND _low <> _target_low",
        "insertion": "_osa = 1 AND length(_low) > length(_target_low)",
        "deletion": "_osa = 1 AND length(_low) < length(_target_low)",
        "suffix-trick": suffix,
        "prefix-trick": prefix,
        "plural-flip": "_low = concat(_target_low, 's') OR _target_low = concat(_low, 's') "
                       "OR _low = concat(_target_low, 'es') OR _target_low = concat(_low, 'es')",
        "scope-drop": "startswith(target, '@') AND _low IN (replace(substring(target, 2), '/', '-'), "
                      "replace(substring(target, 2), '/', '_'), replace(substring(target, 2), '/', ''))",
        "case-variant": "name <> target AND _low = _target_low",
    }
    listed = ", ".join(f"CASE WHEN {conditions[s]} THEN '{s}' END" for s, _ in WEIGHTS)
    return measured.withColumn("signals", F.expr(f"array_compact(array({listed}))"))


def typosquat_matches(names: DataFrame, targets: DataFrame, threshold: float = 0.55, length_guard: bool = False,
                      best: int = 5) -> DataFrame:
    """Popular names a package name may be confused with, scored, the ``best`` of each name.

    ``names`` has (name) and, to compare within it only, (ecosystem); ``targets`` has
    (ecosystem, target, ord).  With ``length_guard``, which is off, names more than four characters
    apart are not compared, which hides long suffixes and all prefixes.
    """
    if threshold <= LOWEST_THRESHOLD:
        raise ValueError(f"the threshold must be above {LOWEST_THRESHOLD}")
    by = [c for c in ("ecosystem",) if c in names.columns]
    low = names.select(*by, "name").distinct().withColumn("_low", F.lower("name"))
    known = targets.select(*by, "target", "ord").withColumn("_target_low", F.lower("target"))
    if not by:
        known = known.groupBy("target", "_target_low").agg(F.min("ord").alias("ord"))
    left = low.select("*", F.explode(F.expr(_name_keys())).alias("_key"))
    right = known.select("*", F.explode(F.expr(_target_keys())).alias("_key"))
    close = "target <> name AND target <> _low"
    if length_guard:
        close += " AND abs(length(_low) - length(_target_low)) <= 4"
    pairs = left.join(right, [*by, "_key"]).filter(close).drop("_key").distinct()
    scored = similarity_signals(pairs).filter("size(signals) > 0")
    total = " + ".join(f"IF(array_contains(signals, '{s}'), {w}D, 0D)" for s, w in WEIGHTS)
    scored = scored.withColumn("score", F.expr(
        f"least(round({total} + IF(length(_target_low) >= 8, 0.05D, 0D) + IF(length(_target_low) >= 12, 0.05D, 0D), 10), 1D)"
    )).filter(F.col("score") >= threshold)
    distances = (
        "array_min(array_compact(array(IF(array_contains(signals, 'levenshtein-1'), 1, NULL), "
        "IF(array_contains(signals, 'levenshtein-2'), 2, NULL), IF(array_contains(signals, 'keyboard-adjacent'), 1, NULL), "
        "IF(array_contains(signals, 'homoglyph'), 1, NULL), IF(array_contains(signals, 'phonetic'), 2, NULL), "
        "IF(array_contains(signals, 'separator'), 1, NULL), IF(array_contains(signals, 'plural-flip'), 1, NULL), "
        "IF(array_contains(signals, 'scope-drop'), 1, NULL), IF(array_contains(signals, 'case-variant'), 0, NULL))))"
    )
    ranked = scored.select(
        *by, "name", "target", "ord", "score", "signals",
        F.expr(f"coalesce({distances}, _osa)").alias("distance"),
        F.expr("CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.75 THEN 'high' "
               "WHEN score >= 0.6 THEN 'medium' ELSE 'low' END").alias("severity"),
    )
    # Bounded by the number of targets per name, and cut to the best before the shuffle.
    window = W.partitionBy(*by, "name").orderBy(F.col("score").desc(), "ord")
    return ranked.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= best).drop("ord")
