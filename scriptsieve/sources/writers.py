"""Writers of results; commits, temporary files and merging are Spark's."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).json(path)


def quoted_csv(categorised: DataFrame, path: str) -> None:
    out = categorised.select("script", F.array_join("categories", ";").alias("categories"))
    out.write.mode("overwrite").option("quoteAll", True).option("header", True).option("escape", '"').csv(path)


def wide(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row a script, one column a feature, lists as JSON; names fix the columns, which are else those that occur."""
    cells = features.withColumn("cell", F.to_json("values"))
    return cells.groupBy("script").pivot("name", names).agg(F.first("cell"))


def wide_csv(features: DataFrame, path: str, names: list[str] | None = None) -> None:
    wide(features, names).write.mode("overwrite").option("header", True).csv(path)


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").option("header", True).csv(path)


def batches(pairs: DataFrame, path: str, size: int = 50) -> None:
    """Files of at most `size` rows by kind."""
    pairs.write.mode("overwrite").option("maxRecordsPerFile", size).partitionBy("kind").json(path)


def by_kind_and_base(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").partitionBy("kind", "base").json(path)


def nested(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def named_files(df: DataFrame, root: str) -> None:
    """A file for each row (name: path under root, content), written under a temporary name and moved when complete; a repeated attempt writes the same."""
    schema = pa.schema([("name", pa.string())])

    def run(batches):
        system, top = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root))
        for batch in batches:
            names, contents = (c.to_pylist() for c in batch.columns)
            for name, content in zip(names, contents):
                folder, _, last = f"{top}/{name}".rpartition("/")
                draft = f"{folder}/_{uuid.uuid4().hex}"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(draft) as out:
                    out.write((content or "").encode("utf-8", "surrogatepass"))
                system.move(draft, f"{folder}/{last}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], schema=schema)

    df.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def one_file_a_row(df: DataFrame, root: str, suffix: str = ".txt") -> None:
    """A file for each key with its text, named by the key."""
    named_files(df.select(F.concat(F.col("key").cast("string"), F.lit(suffix)).alias("name"), "content"), root)


def samples(df: DataFrame, root: str, prefix: str, stamp: str) -> None:
    """Samples (rep and other columns) as one JSON array file a repetition, `<prefix>_<rep>_<stamp>.json`."""
    rows = df.groupBy("rep").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "rep"])))).alias("content"))
    named_files(rows.select(F.concat(F.lit(f"{prefix}_"), F.col("rep").cast("string"), F.lit(f"_{stamp}.json")).alias("name"), "content"), root)


def model(pipeline_model, path: str) -> None:
    pipeline_model.write().overwrite().save(path)
