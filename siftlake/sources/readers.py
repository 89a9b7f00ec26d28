"""Sources.  Every reader declares its schema, so that no data is read to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.advisories import OSV_SCHEMA
from siftlake.operators.files import SOURCE_EXTENSIONS, classify, extension, outside_ignored_directories
from siftlake.session import read_small_files

REGISTRY_SCHEMA = (
    "name STRING, `dist-tags` STRUCT<latest: STRING>, time MAP<STRING, STRING>, "
    "versions MAP<STRING, STRUCT<version: STRING, _npmUser: STRUCT<name: STRING>, scripts: MAP<STRING, STRING>, deprecated: STRING>>, "
    "maintainers ARRAY<STRUCT<name: STRING, email: STRING>>, repository STRUCT<url: STRING>, readme STRING, license STRING"
)
SBOM_SCHEMA = (
    "bomFormat STRING, metadata STRUCT<timestamp: STRING, component: STRUCT<name: STRING, version: STRING>>, "
    "components ARRAY<STRUCT<type: STRING, `bom-ref`: STRING, name: STRING, version: STRING, purl: STRING, "
    "licenses: ARRAY<STRUCT<license: STRUCT<id: STRING>>>>>"
)
EVENT_SCHEMA = (
    "event_id LONG, event_type STRING, ide STRING, ai_agent STRING, ai_model STRING, interaction STRING, package_name STRING, "
    "ecosystem STRING, package_version STRING, action_taken STRING, severity STRING, os_platform STRING, client_id STRING, created_at TIMESTAMP"
)


#: Endings of files that the text reader unpacks.
_PACKED = ("bz2", "deflate", "gz", "lz4", "snappy", "zst")


def whole_texts(spark: SparkSession, path: str, *columns: str, packed: bool = False, **options: str) -> DataFrame:
    """(path, bytes, text) of files, one in a row, after ``columns`` that their folders name.

    The text reader copies Hadoop's settings for every file, one task of an executor at a time, so only files that may be
    ``packed`` are read with it; others are read as bytes.
    """
    if packed:
        files, text = read_small_files(spark, lambda reader: reader.options(**options).text(path, wholetext=True)), F.col("value")
    else:
        files, text = read_small_files(spark, lambda reader: reader.options(**options).format("binaryFile").load(path)), F.col("content").cast("string")
    return files.select(*columns, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), text.alias("text"))


def read_corpus(spark: SparkSession, path: str, extensions: tuple[str, ...] = SOURCE_EXTENSIONS, max_bytes: int | None = None) -> DataFrame:
    """Files of a source tree: (file_id, path, text), classified by path and text.

    Ignored directories are left out.  There is no limit of size unless ``max_bytes`` is given; larger files then come
    as rows with a null text and ``skipped`` true.
    """
    files = whole_texts(spark, path, packed=not extensions or any(e in _PACKED for e in extensions), recursiveFileLookup="true")
    kept = files.filter(outside_ignored_directories(F.col("path")))
    if extensions:
        kept = kept.filter(F.ltrim(extension(F.col("path")), F.lit(".")).isin(*extensions))
    if max_bytes is not None:
        large = F.col("bytes") > max_bytes
        kept = kept.withColumn("skipped", large).withColumn("text", F.when(~large, F.col("text")))
    return classify(kept.withColumn("file_id", F.xxhash64("path")))


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """OSV advisories, one JSON document per line."""
    return spark.read.schema(OSV_SCHEMA).json(path)


def read_registry_snapshot(spark: SparkSession, path: str, ecosystem: str = "npm") -> DataFrame:
    """Package documents of a registry dump."""
    return spark.read.schema(REGISTRY_SCHEMA).json(path).withColumn("ecosystem", F.lit(ecosystem))


def registry_packages(documents: DataFrame) -> DataFrame:
    """One row per package: age, latest version, repository, scripts of the latest version."""
    latest = "try_element_at(versions, `dist-tags`.latest)"
    return documents.selectExpr(
        "ecosystem", "name", "`dist-tags`.latest AS latest", "CAST(try_element_at(time, 'created') AS TIMESTAMP) AS created_at",
        "size(map_keys(versions)) AS version_count", f"{latest}.scripts AS latest_scripts", f"{latest}.deprecated IS NOT NULL AS deprecated",
        "repository.url AS repository_url", "length(coalesce(readme, '')) AS readme_length", "license", "maintainers")


def registry_versions(documents: DataFrame) -> DataFrame:
    """Publication history of every package."""
    flat = documents.selectExpr("ecosystem", "name AS package", "time", "posexplode(map_entries(versions)) AS (_pos, _v)")
    return flat.selectExpr(
        "ecosystem", "package", "_v.key AS version", "CAST(try_element_at(time, _v.key) AS TIMESTAMP) AS published_at",
        "_v.value._npmUser.name AS publisher", "CAST(_pos AS BIGINT) AS ordinal")


def read_sbom(spark: SparkSession, path: str) -> DataFrame:
    """Components of CycloneDX documents, one document per file."""
    documents = spark.read.schema(SBOM_SCHEMA).json(path, multiLine=True)
    flat = documents.selectExpr("coalesce(metadata.component.name, _metadata.file_name) AS project", "explode(components) AS c")
    return flat.selectExpr(
        "project", "c.`bom-ref` AS bom_ref", "coalesce(nullif(regexp_extract(c.purl, '^pkg:([^/]+)/', 1), ''), 'unknown') AS ecosystem",
        "c.name", "c.version", "c.purl", "try_element_at(c.licenses, 1).license.id AS license")


def read_model_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Model files as bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reference table the user supplies, as CSV with a header or as parquet."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.schema(schema).csv(path, header=True)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def read_events_stream(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet",
                       files_per_trigger: int | None = None) -> DataFrame:
    """Telemetry events as they arrive.  A time without a zone is taken as UTC, since a watermark needs one."""
    reader = spark.readStream.schema(schema or EVENT_SCHEMA).format(fmt)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return with_zones(reader.load(path))


def with_zones(events: DataFrame) -> DataFrame:
    """Times without a zone as UTC instants."""
    for field in events.schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            events = events.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return events
