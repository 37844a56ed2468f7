"""Files that the jobs exchange: sheets, result files, JSON lines, logs and facts."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.dates import jst_date

RESULT = "custom_id string, status int, body string"


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="leadloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: what follows neither plans nor computes it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_sheet(spark: SparkSession, path: str, required: list[str], schema: T.StructType | None = None) -> DataFrame:
    """A CSV sheet by header name; raises if a column is missing."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def client_config(clients: DataFrame, targetings: DataFrame) -> DataFrame:
    """One row a targeting with client and targeting structs; booleans from sheet words."""
    truthy = F.lower(F.trim(F.col("active"))).isin("true", "1", "yes", "y")
    t = targetings.select(F.col("client_id"), truthy.alias("active"), F.struct(*[c for c in targetings.columns if c not in ("client_id", "active")]).alias("targeting"))
    c = clients.select(F.col("id").alias("client_id"), F.struct(*clients.columns).alias("client"))
    return t.join(c, "client_id")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON result file, however it is broken into lines; bad records are null rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def newest_file(spark: SparkSession, glob: str) -> str | None:
    """The path that was modified last."""
    files = spark.read.text(glob, wholetext=True).select("_metadata.file_path", "_metadata.file_modification_time")  # the texts are not read
    row = files.agg(F.max_by("file_path", F.struct("file_modification_time", "file_path"))).first()
    return row[0] if row else None


def read_lines(spark: SparkSession, path: str, schema: str = RESULT) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, bad lines) of a JSON-lines file."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("r", F.from_json("value", schema))
    first = T._parse_datatype_string(schema).fieldNames()[0]
    bad = F.col("r").isNull() | F.col(f"r.{first}").isNull()
    return lines.where(~bad).select("r.*"), lines.where(bad).select("value")


def result_status(rows: DataFrame) -> DataFrame:
    """company_id, kind of the answers that came: success, empty_form_elements, invalid_json or no_choices."""
    b = F.col("body")
    kind = F.when(b.isNull(), "no_choices").when(b.isin("{}", "[]"), "empty_form_elements").when(F.get_json_object(b, "$").isNull(), "invalid_json").otherwise("success")
    return rows.where("status = 200").select(F.regexp_extract("custom_id", r"^company_(\d+)$", 1).cast("long").alias("company_id"), kind.alias("kind"))


def write_requests(prompts: DataFrame, path: str, model: str) -> DataFrame:
    """One request line for each complete prompt (company_id, system, user); returns the ids that were left out."""
    whole = F.col("system").isNotNull() & F.col("user").isNotNull() & (F.trim("user") != "")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", "system"), message("user", "user")).alias("messages"))
    line = F.to_json(F.struct(F.concat(F.lit("company_"), F.col("company_id")).alias("custom_id"), F.lit("POST").alias("method"), body.alias("body")))
    prompts.where(whole).select(line.alias("value")).write.mode("errorifexists").text(path)
    return prompts.where(~F.coalesce(whole, F.lit(False))).select("company_id")


def append_facts(submissions: DataFrame, path: str) -> None:
    """Facts go to a folder of their Japan day."""
    submissions.withColumn("jst_date", jst_date(F.col("submitted_at"))).write.mode("append").partitionBy("jst_date").parquet(path)
