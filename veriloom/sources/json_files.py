"""JSON sources and sinks: record arrays, dicts of arrays, folders of single records, and stage tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTION = "array<struct<label:string,text:string>>"


def read_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of JSON array files. Such a file is read by one task; turn it into Parquet first thing."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_named(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of a file that holds an array, or an object of arrays by name, with column source: the name, or `normal`.

    record is the records' schema as DDL. A source that a record brings itself is overwritten.
    """
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("raw"))
    rows = raw.filter(F.startswith("raw", F.lit("["))).select(F.lit("normal").alias("source"), F.from_json("raw", f"array<struct<{record}>>").alias("rows"))
    named = raw.filter(F.startswith("raw", F.lit("{"))).select(F.explode(F.from_json("raw", f"map<string,array<struct<{record}>>>")).alias("source", "rows"))
    out = rows.unionByName(named).select("source", F.posexplode("rows").alias("pos", "r"))
    fields = [f for f in out.schema["r"].dataType.names if f != "source"]
    return out.select("source", "pos", *[F.col(f"r.`{f}`") for f in fields])


def option_entries(options: Column) -> Column:
    """Options read as map<string,string> to an array of (label, text) in file order; of a repeated label the last value holds."""
    entries = F.map_entries(options)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.transform(last, lambda e: F.struct(e["key"].alias("label"), e["value"].alias("text")))


def read_records(spark: SparkSession, folder: str, schema: str | T.StructType, any_of: list[str] | None = None, all_of: list[str] | None = None) -> DataFrame:
    """Records of a folder with one JSON file each (not below it), kept if any of, and all of, the named columns are there. Broken files are skipped."""
    df = spark.read.schema(schema).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    keep = F.lit(True)
    if any_of:
        keep = F.coalesce(*[F.col(c).cast("string") for c in any_of]).isNotNull()
    for c in all_of or []:
        keep = keep & F.col(c).isNotNull()
    return df.filter(keep)


def append_stage(df: DataFrame, folder: str) -> None:
    """Append finished records to a stage table; each write has its run id and time."""
    df.withColumn("run_id", F.lit(uuid.uuid4().hex)).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(folder)


def read_stage(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """A stage table's records, of each key the one written last."""
    df = spark.read.parquet(folder)
    latest = Window.partitionBy(key).orderBy(F.desc("written_at"), F.desc("run_id"))
    return df.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def write_lines(df: DataFrame, folder: str, order: list[str] | None = None) -> None:
    """JSON lines, range-partitioned by the order where one is given; null fields are left out."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode("overwrite").json(folder)


def export_array(df: DataFrame, path: str, most: int = 1_000_000) -> int:
    """One JSON array file (indent 2, text as it is) of at most `most` records, streamed through the driver; the count. Raises beyond."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in df.toJSON().toLocalIterator():
            n += 1
            if n > most:
                raise ValueError(f"more than {most} records; write_lines has no such limit")
            f.write((",\n" if n > 1 else "\n") + json.dumps(json.loads(row), ensure_ascii=False, indent=2))
        f.write("\n]\n" if n else "]\n")
    return n


def named_file(task: str, kind: str, n: int) -> str:
    """Name of a merged export: task, kind and record count."""
    return f"{task}_{kind}_{n}.json"


def run_folder(base: str, run: str) -> str:
    """Folder of a run: the base, with the run's name behind it unless it is part of it already."""
    return base if run in base else f"{base.rstrip('/')}/{run}"


def checkpoint_name(epoch: int, step: int) -> str:
    """Name of a checkpoint, by epoch and step."""
    return f"checkpoint-{epoch}-{step}"


# Names of files that hold weights and are not copied along.
def copied(name: Column) -> Column:
    """Whether a file of a model's folder is copied along with a checkpoint: all but weights and their indexes."""
    weights = F.startswith(name, F.lit("pytorch_model")) & F.endswith(name, F.lit(".bin"))
    return ~(weights | F.endswith(name, F.lit(".index.json")) | F.endswith(name, F.lit(".safetensors")))


def task_name(path: str) -> str:
    """File name without folder and extension."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".json", 1)[0]


def score_dict(scores: DataFrame) -> dict[str, list]:
    """Score rows (one a source) as name -> [score, head hits, total, tail hits]."""
    return {r["source"]: [r["score"], r["head_hits"], r["total"], r["tail_hits"]] for r in scores.collect()}
