"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRANSCRIPT = "record_id string, body string, word_count bigint, outlet string, show string, date string, year int, month string, type string"
ANNOTATION = "record_id string, breaks array<bigint>, word_count bigint, category string, outlet string, show string, date string, agent_notes string"
PREDICTION = "record_id string, word_count bigint, pred_breaks array<bigint>, tau double, n_unlocatable_anchors bigint, n_ambiguous_anchors bigint, adapter string, adapter_revision string, outlet string, show string, date string"
SEGMENT = "segment_id string, record_id string, index bigint, word_start bigint, word_end bigint, char_start bigint, char_end bigint, n_words bigint, n_cuts bigint, text string, flags array<string>, outlet string, show string, date string"
SCHEMAS = {"transcript": TRANSCRIPT, "annotation": ANNOTATION, "prediction": PREDICTION, "segment": SEGMENT}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one kind by its schema; blank lines are skipped, anything else that isn't JSON ends the job."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)


def read_present(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """As `read`, without the optional columns that no line has; one pass over the keys."""
    df = read(spark, path, kind)
    raw = spark.read.text(path).where("trim(value) <> ''")
    keys = {r[0] for r in raw.select(F.explode(F.json_object_keys("value"))).distinct().collect()}
    return df.select(*[c for c in df.columns if c in keys or c == "record_id"])


def problems(spark: SparkSession, path: str) -> DataFrame:
    """file, line: the lines that aren't JSON.  Lines have no numbers in a distributed read, so the line itself is given."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return raw.where("trim(line) <> '' and try_parse_json(line) is null")


_KINDS = {"string": "STRING", "bigint": "BIGINT", "array<bigint>": "ARRAY<BIGINT>"}


def read_strict(spark: SparkSession, path: str, fields: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """record_id, fields with exactly the types asked for, optional ones (null where they have another type or aren't there), ordinal (the order of lines) and error where a field has another type.

    A plain schema would turn the number 12345 into a string; here each line is
    read as a VARIANT and a field whose own type differs makes the record an
    error.  Empty arrays fit every array type.
    """
    raw = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("v"), F.monotonically_increasing_id().alias("ordinal"))
    out, errors = [F.try_variant_get("v", "$.record_id", "string").alias("record_id")], [F.when(F.col("v").isNull(), F.lit("invalid JSON"))]
    for name, kind in fields.items():
        found = F.try_variant_get("v", f"$.{name}", "variant")
        own = F.schema_of_variant(found)
        fits = own.isin(_KINDS[kind], "ARRAY<VOID>") if kind.startswith("array") else own == _KINDS[kind]
        listed = F.try_variant_get("v", f"$.{name}", "array<variant>")
        if kind.startswith("array"):
            fits = fits & F.forall(listed, lambda x: F.schema_of_variant(x) == "BIGINT")
        fits = F.coalesce(fits, F.lit(False))
        out.append(F.when(fits, F.try_variant_get("v", f"$.{name}", kind)).alias(name))
        errors.append(F.when(~fits, F.concat(F.lit(f"{name} is not {kind} but "), F.coalesce(own, F.lit("missing")))))
    for name, kind in (optional or {}).items():
        found = F.try_variant_get("v", f"$.{name}", "variant")
        out.append(F.when(F.schema_of_variant(found) == _KINDS[kind], F.try_variant_get("v", f"$.{name}", kind)).alias(name))
    return raw.select(*out, "ordinal", F.coalesce(*errors).alias("error"))


def union_annotations(sources: list[tuple[DataFrame, bool]], heldout_ids: DataFrame | None = None) -> DataFrame:
    """Annotations of several files; the first to have a record wins.  heldout: the file's flag, or membership in a list of ids."""
    parts = [df.withColumns({"_source": F.lit(i), "_flag": F.lit(flag)}) for i, (df, flag) in enumerate(sources)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    first = W.partitionBy("record_id").orderBy("_source", *(["ordinal"] if "ordinal" in every.columns else []))
    out = every.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    if heldout_ids is not None:
        out = out.join(heldout_ids.select("record_id").distinct().withColumn("_held", F.lit(True)), "record_id", "left")
        return out.withColumn("heldout", F.col("_flag") | F.coalesce("_held", F.lit(False))).drop("_source", "_flag", "_r", "_held")
    return out.withColumn("heldout", F.col("_flag")).drop("_source", "_flag", "_r")


def write(df: DataFrame, path: str, nulls: bool = False, by: str | None = None) -> None:
    """JSON lines; null fields are left out unless `nulls`.  One folder for each value of `by`."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", not nulls)
    (writer.partitionBy(by) if by else writer).json(path)


def _few(df: DataFrame, most: int) -> DataFrame:
    """df, or an error if it has more rows than its reader on the driver is meant for."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; write them as JSON lines")
    return df


def to_array(df: DataFrame, most: int = 10_000) -> str:
    """A JSON array of a few rows (a sweep, a score table)."""
    return "[" + ",\n ".join(r[0] for r in _few(df, most).select(F.to_json(F.struct("*"))).collect()) + "]"


def write_dataset(rows: DataFrame, rejects: DataFrame, splits: DataFrame, folder: str) -> None:
    """A training set: rows by split, rejected windows, and which record is in which split."""
    write(rows.join(splits, "record_id"), f"{folder}/dataset", by="split")
    write(rejects, f"{folder}/rejected_windows")
    write(splits, f"{folder}/splits")
