"""Task definitions: one JSON file each; checks and defaults are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from datamill.functions import fixed_values as V

KEYS = ["name", "type", "description", "labels", "fields", "synthetic", "scoreRange", "realData", "training"]
TASK = """struct<name:string,type:string,description:string,labels:array<string>,fields:array<string>,
synthetic:struct<count:int,prompt:string,model:string,batchSize:int>,scoreRange:struct<min:double,max:double>,
realData:struct<path:string,inputField:string,labelField:string>,
training:struct<script:string,splitRatio:double,args:map<string,string>>>"""


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """``(raw)``: the whole text of every definition file in a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"))


def parse_tasks(raw: DataFrame) -> DataFrame:
    """Definitions as typed columns."""
    return raw.select(F.from_json("raw", TASK).alias("t")).select("t.*")


def load_task(tasks: DataFrame, name: str) -> DataFrame:
    return tasks.where(F.col("name") == name)


def save_tasks(raw: DataFrame, path: str) -> None:
    """Writes definitions that pass all checks; any violation is an error."""
    bad = violations(raw)
    if not bad.isEmpty():
        raise ValueError(f"invalid task: {[tuple(r) for r in bad.limit(20).collect()]}")
    raw.select("raw").write.mode("append").text(path)


def violations(raw: DataFrame, id: str | None = None) -> DataFrame:
    """``(name, path, message)``: every broken rule of every definition."""
    doc = raw.withColumn("v", F.try_parse_json("raw"))
    part = lambda key: F.try_variant_get(F.col("v"), f"$.{key}", "variant")
    kind = lambda key: F.schema_of_variant(part(key))
    text = lambda key: F.try_variant_get(F.col("v"), f"$.{key}", "string")

    def rule(path: str, broken: Column, message: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))

    present = {k: part(k).isNotNull() for k in KEYS}
    rules = [rule(k, ~present[k], "required field missing") for k in ("name", "type", "description")]
    rules += [rule(k, present[k] & (kind(k) != "STRING"), "expected string") for k in ("name", "type", "description")]
    rules.append(rule("type", present["type"] & ~text("type").isin(V.TASK_TYPES), f"must be one of: {', '.join(V.TASK_TYPES)}"))
    rules.append(rule("name", (kind("name") == "STRING") & ~text("name").rlike(V.TASK_NAME_PATTERN), f"must match pattern {V.TASK_NAME_PATTERN}"))
    is_list = lambda key: F.startswith(kind(key), F.lit("ARRAY"))
    rules += [rule(k, present[k] & ~is_list(k), "expected array") for k in ("labels", "fields")]
    items = F.size(F.try_variant_get(F.col("v"), "$.labels", "array<variant>"))
    rules.append(rule("labels", is_list("labels") & (items < 2), "needs at least 2 items"))
    for task_type, key in (("classification", "labels"), ("extraction", "fields"), ("sequence-labeling", "labels")):
        rules.append(rule(key, (text("type") == task_type) & ~present[key], f'required when type is "{task_type}"'))
    not_object = ~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    whole = rule("", F.coalesce(not_object, F.lit(True)), "expected object")
    found = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(F.array(*rules)))
    return doc.select(*([id] if id else []), text("name").alias("name"), F.inline(found))


def fill_defaults(tasks: DataFrame) -> DataFrame:
    """Defaults of nested settings, only where the setting itself is given."""
    def default(parent: str, **values) -> Column:
        filled = F.col(parent)
        for name, value in values.items():
            filled = filled.withField(name, F.coalesce(F.col(f"{parent}.{name}"), F.lit(value)))
        return F.when(F.col(parent).isNotNull(), filled)

    return tasks.withColumns({
        "synthetic": default("synthetic", count=V.DEFAULT_COUNT, model=V.DEFAULT_MODEL, batchSize=V.DEFAULT_BATCH),
        "scoreRange": default("scoreRange", min=V.SCORE_MIN, max=V.SCORE_MAX),
        "realData": default("realData", inputField=V.DEFAULT_INPUT_FIELD, labelField=V.DEFAULT_LABEL_FIELD),
        "training": default("training", script=V.DEFAULT_SCRIPT, splitRatio=V.DEFAULT_SPLIT_RATIO),
    })
