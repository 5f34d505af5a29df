"""JSON sources with fixed schemas: truth, manifest, gate, run records. Unknown keys and missing files are findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "struct<id:int,label:string,start:int,end:int,boxes:array<array<int>>>"
TRUTH = f"uid string, revision string, locale string, entities array<{ENTITY}>, characters array<struct<box:array<int>,sensitive:boolean>>"
MANIFEST = "offset int, uid string, annotation_repairs array<string>, input_sha256 string"
GATE = "version int, scope string, revision string, holdout_offsets array<int>, minimum_records int, overall_entity_full_coverage_min double, correct_label_full_coverage_min double, comparison string"
DETECTION = "struct<label:string,line:int,start:int,end:int,boxes:array<array<int>>>"
RUN = f"status string, stage string, pipeline string, config_sha256 string, input_sha256 string, output_sha256 string, error_type string, error_code string, approved boolean, parent_run string, parent_audit_sha256 string, windows int, ocr_units int, ocr_characters int, ner_spans array<struct<start:int,end:int,label:string,score:double>>, detections array<{DETECTION}>, elapsed_seconds double"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON with the file's path. A file that is no JSON of this shape fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, TRUTH)


def read_manifest(spark: SparkSession, path: str, count: int) -> DataFrame:
    """pos and the fields of the first `count` entries in file order; 1 to 10 of them."""
    if type(count) is not int or not 1 <= count <= 10:
        raise ValueError("a sample has 1 to 10 records")
    entry = f"array<struct<{', '.join(f'{n}:{t}' for n, t in (c.strip().split(' ', 1) for c in MANIFEST.split(',')))}>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", entry, {"mode": "FAILFAST"})).alias("pos", "e"))
    return rows.where(F.col("pos") < count).select("pos", "e.*")


def read_gate(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, GATE)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RUN).withColumn("run", F.element_at(F.split("path", "/"), -2))


def unknown_keys(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, keys: JSON objects with keys outside the schema (a closed schema must not drop them in silence)."""
    known = [f.name for f in spark.createDataFrame([], schema).schema]
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    keys = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, known)))
    return rows.select("path", keys.alias("keys")).where(F.size("keys") > 0)
