"""Input tables of the named queries, and the domain tables derived from them.

Each derived table exists twice: as a DataFrame, and as the SQL text of the same rows for
the checking database.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.files import LANGUAGES
from siftlake.operators.scan import quote
from siftlake.plans.examples import EXAMPLES, PATHS
from siftlake.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def spark_list(values: Sequence[str]) -> str:
    return "array(" + ", ".join(quote(v) for v in values) + ")"


def pick(values: Sequence[str], by: str) -> Column:
    """The value a row's identifier selects."""
    return F.expr(f"element_at({spark_list(values)}, CAST(pmod({by}, {len(values)}) + 1 AS INT))")


def sql_pick(values: Sequence[str], by: str) -> str:
    return f"({sql_list(values)})[({by}) % {len(values)} + 1]"


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.lower().rsplit(".", 1)[-1])


def planted(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Documents as source files: path by identifier, and one example line after the text."""
    paths = PATHS.get(family, PATHS["default"])
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("file_id"), "source", pick(paths, "doc_id").alias("path"),
        F.concat("text", F.lit("\n"), pick(EXAMPLES[family], "doc_id")).alias("text"),
    )


def planted_sql(family: str) -> str:
    """The body of a CTE with the rows of :func:`planted` and their language."""
    paths = PATHS.get(family, PATHS["default"])
    langs = ", ".join("NULL" if (x := language_of(p)) is None else sql_text(x) for p in paths)
    return (
        f"SELECT doc_id AS file_id, source, {sql_pick(paths, 'doc_id')} AS path, "
        f"([{langs}])[doc_id % {len(paths)} + 1] AS lang, "
        f"text || chr(10) || {sql_pick(EXAMPLES[family], 'doc_id')} AS text FROM documents"
    )


def planted_pages(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Web pages with one example line each."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return pages.select(
        F.col("page_id").alias("file_id"), F.concat("html", F.lit("\n"), pick(EXAMPLES[family], "page_id")).alias("text")
    )


def planted_pages_sql(family: str) -> str:
    return f"SELECT page_id AS file_id, html || chr(10) || {sql_pick(EXAMPLES[family], 'page_id')} AS text FROM pages"


def planted_turns(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Conversation turns with one example line each."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return turns.select(
        "conv_id", "turn", "role",
        F.concat("text", F.lit("\n"), pick(EXAMPLES[family], "conv_id * 7 + turn")).alias("text"),
    )


def planted_turns_sql(family: str) -> str:
    return ("SELECT conv_id, turn, role, text || chr(10) || "
            f"{sql_pick(EXAMPLES[family], 'conv_id * 7 + turn')} AS text FROM conversations")


def fill(template: str, values: dict[str, str]) -> str:
    """SQL text that puts expressions into a quoted template; reads the same in both dialects."""
    for mark, expression in values.items():
        template = f"replace({template}, '{mark}', {expression})"
    return template
