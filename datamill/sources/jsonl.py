"""Example files: one JSON object per line, read with a given schema; merging of sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Row shapes per task type. Every table has an id; sources and providers are plain columns.
COMMON = [T.StructField("id", T.LongType()), T.StructField("_source", T.StringType()), T.StructField("_provider", T.StringType())]
SCHEMAS = {
    "classification": T.StructType([*COMMON, T.StructField("text", T.StringType()), T.StructField("label", T.StringType())]),
    "extraction": T.StructType([*COMMON, T.StructField("text", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]),
    "scoring": T.StructType([*COMMON, T.StructField("text", T.StringType()), T.StructField("value", T.DoubleType())]),
    "sequence-labeling": T.StructType([
        *COMMON, T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())),
    ]),
}
SCHEMAS["regression"] = SCHEMAS["scoring"]
BAD_LINE = "_bad_line"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, keep_bad: bool = False) -> DataFrame:
    """Rows of a JSON-lines file or folder. Blank lines are skipped; a bad line fails the read.

    With ``keep_bad`` a bad line becomes a row of nulls with its text in ``_bad_line``.
    """
    if keep_bad:
        wide = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
        return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE).json(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Like :func:`read_jsonl`; a missing file is an empty table."""
    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            return spark.createDataFrame([], schema)
        raise


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def normalise_real(df: DataFrame, input_field: str = "text", label_field: str = "label", id: str | None = None) -> DataFrame:
    """Rows of an outside file as (text, label, _source='real'); all other columns are dropped."""
    key = [] if id is None else [F.col(id).alias("id")]
    return df.select(*key, F.col(input_field).alias("text"), F.col(label_field).alias("label"), F.lit("real").alias("_source"))


def merge_sources(synthetic: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """Union of both; a synthetic row without a source is marked 'synthetic'."""
    known = F.col("_source") if "_source" in synthetic.columns else F.lit(None).cast("string")
    out = synthetic.withColumn("_source", F.coalesce(known, F.lit("synthetic")))
    return out if real is None else out.unionByName(real, allowMissingColumns=True)


def load_and_merge(spark: SparkSession, synthetic_path: str, schema: T.StructType, real_path: str | None = None,
                   real_schema: T.StructType | None = None, input_field: str = "text", label_field: str = "label") -> DataFrame:
    """Synthetic rows and, where given, rows of a real file; missing files count as empty."""
    synthetic = read_or_empty(spark, synthetic_path, schema)
    if real_path is None:
        return merge_sources(synthetic)
    fallback = T.StructType([T.StructField(input_field, T.StringType()), T.StructField(label_field, T.StringType())])
    real = read_or_empty(spark, real_path, real_schema or fallback)
    return merge_sources(synthetic, normalise_real(real, input_field, label_field))


def tag_source(df: DataFrame, provider: str, stage: str | None = None) -> DataFrame:
    """Adds where rows came from."""
    out = df.withColumn("_provider", F.lit(provider))
    return out if stage is None else out.withColumn("_distill_stage", F.lit(stage))


def merge_stages(large: DataFrame, local: DataFrame | None, large_provider: str = "large", local_provider: str = "local") -> DataFrame:
    """Rows of a large and of a local generator with their stage; the local part may be missing."""
    out = tag_source(large, large_provider, "large")
    if local is None:
        return out
    return out.unionByName(tag_source(local, local_provider, "local"), allowMissingColumns=True)
