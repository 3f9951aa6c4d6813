"""Per-user sensor CSV directories and fold-list text files.

Files of one directory may have different headers (column order and column set), so the files are read once as text
lines. Each file's header is its first line; only the distinct headers reach the driver. A line is cut into its cells
once and every column of the result takes its cell by the position that the line's own header gives it. A quoted cell may hold line
breaks: a line with an odd number of quotes begins or ends such a record, so in the files that have such lines (and only in those) the
lines between are joined again. Those files aren't split, one task joins the lines of a file; all others are read line by line.
``uuid`` is the file name up to its first dot. Downstream steps should run on the Parquet dataset written once from this reader.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxspark.session import shared_dir

# Fold-list file names (fold, split, phone source) and the single-split file names.
FOLD_FILE_PATTERN = r"fold_(\d+)_(train|test)_([A-Za-z0-9]+)_uuids\.txt$"
FOLD_FILE_GLOB = "fold_*_*_*_uuids.txt"
SINGLE_SPLIT_FILES = ("train.txt", "test.txt")


# Words that stand for a missing value, and columns that aren't numbers.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
           "NULL", "NaN", "None", "n/a", "nan", "null")
KINDS = {"timestamp": "long", "label_source": "string"}


def _header_fields(header: str) -> list[str]:
    return [h.strip() for h in next(csv.reader([header]))]


def _uuid_column(uuid_from: str):
    if uuid_from == "file_name":
        return F.substring_index(F.substring_index("path", "/", -1), ".", 1)
    if uuid_from == "partition":
        return F.regexp_extract("path", r"/uuid=([^/]+)/[^/]*$", 1)
    raise ValueError(f"uuid_from must be 'file_name' or 'partition', not {uuid_from!r}")


def whole_records(lines: DataFrame) -> DataFrame:
    """(path, b, i, value) with the lines of a quoted cell's record joined by line feeds; ``b`` and ``i`` order the lines of a file."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    parted = lines.where(quotes % 2 == 1).select("path").distinct()
    # inside a file the quotes before a line tell whether it goes on with a record
    order = Window.partitionBy("path").orderBy("b", "i").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(order), F.lit(0)) % 2 == 1
    upto = Window.partitionBy("path").orderBy("b", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (lines.join(parted, "path", "left_semi").withColumn("quotes", quotes).withColumn("inside", inside)
                .withColumn("record", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(upto)))
    parts = F.array_sort(F.collect_list(F.struct("b", "i", "value")))
    joined = (numbered.groupBy("path", "record").agg(parts.alias("parts"))
              .select("path", F.get("parts", F.lit(0))["b"].alias("b"), F.get("parts", F.lit(0))["i"].alias("i"),
                      F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")))
    return lines.join(parted, "path", "left_anti").select("path", "b", "i", "value").unionByName(joined)


def read_user_csvs(spark: SparkSession, paths: str | Sequence[str], uuid_from: str = "file_name",
                   bad_cells: bool = False) -> DataFrame:
    """All users' rows in one DataFrame: ``uuid`` + every column of every file (missing -> null).

    Only ``*.csv`` files are read. ``timestamp`` is long, ``label_source`` text, every other column double; a cell that is
    neither a missing-value word nor of its column's type is null and, with ``bad_cells``, counted in that column.
    ``uuid_from="file_name"``: the file name up to its first dot (one file per user); ``"partition"``: the
    ``uuid=<id>`` directory of a user-partitioned layout, as Spark writes it.
    """
    # recursive listing, no partition inference: uuid comes from the path, not from discovered columns
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
             .text(paths if isinstance(paths, str) else list(paths))
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("b"), "value",
                     F.monotonically_increasing_id().alias("i")))
    # stored once: the headers and the rows are read from the records, not from the files and their joined lines again
    path = shared_dir(spark, "csv-records")
    whole_records(lines).write.parquet(path)
    lines = spark.read.parquet(path)
    first = (lines.where(F.col("b") == 0).groupBy("path")
             .agg(F.min_by("value", "i").alias("header"), F.min("i").alias("at")))       # one row a file
    headers = [r[0] for r in first.select("header").distinct().collect()]
    if not headers:
        raise FileNotFoundError(f"no CSV files under {paths}")
    fields = {h: _header_fields(h) for h in headers}
    columns = list(dict.fromkeys(c for h in sorted(headers) for c in fields[h]))
    width = max(map(len, fields.values()))
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"escape": '"'})
    rows = (lines.where(F.trim("value") != "").join(first, "path").where(F.col("value") != F.col("header"))
            .withColumn("cells", cells).withColumn("cells", F.array(*[F.trim(F.col(f"cells.c{i}")) for i in range(width)])))
    place = F.create_map(*[x for h in headers for x in (
        F.lit(h), F.array(*[F.lit(fields[h].index(c) if c in fields[h] else -1) for c in columns]))])
    rows = rows.select(_uuid_column(uuid_from).alias("uuid"), "cells", F.element_at(place, F.col("header")).alias("at"))
    out, bad = [], F.lit(0)
    for i, c in enumerate(columns):
        at = F.get("at", F.lit(i))
        text = F.when(at >= 0, F.get("cells", at))
        text = F.when(~text.isin(*MISSING), text)
        value = text.try_cast(KINDS.get(c, "double"))
        if c == "timestamp":
            value = F.coalesce(value, text.try_cast("double").cast("long"))
        out.append(value.alias(c))
        bad = bad + (text.isNotNull() & value.isNull()).cast("int")
    return rows.select("uuid", *out, *([bad.alias("bad_cells")] if bad_cells else []))


def write_user_csvs(df: DataFrame, directory: str, name: str = "{uuid}.features_labels.csv") -> int:
    """One CSV file per user, named after it; returns the number of files. A task writes its users one after the other.

    ``directory`` must be a folder that all executors share (file, hdfs, s3, gs or abfs). A file gets its name when it is complete, so a
    task that is lost or repeated leaves no torn file under it.
    """
    columns = [c for c in df.columns if c != "uuid"]

    def run(batches):
        import pyarrow.fs as pafs

        uri = "file://" + directory[5:] if directory.startswith("file:/") and not directory.startswith("file://") else directory
        fs, folder = pafs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)
        now, out, files, hidden = None, None, 0, f"{folder}/.{uuid4().hex}"

        def close():
            if out is not None:
                out.close()
                fs.move(hidden, f"{folder}/{name.format(uuid=now)}")

        for frame in batches:
            for uuid, part in frame.groupby("uuid", sort=False):
                if uuid != now:
                    close()
                    now, files = uuid, files + 1
                    out = fs.open_output_stream(hidden)
                    out.write((",".join(columns) + "\n").encode())
                out.write(part[columns].to_csv(index=False, header=False).encode())
        close()
        import pandas as pd

        yield pd.DataFrame({"files": [files]})

    written = (df.repartition("uuid").sortWithinPartitions("uuid", "timestamp").mapInPandas(run, "files long"))
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


PARTITIONED_PATTERN = r"/fold=(\d+)/split=([^/]+)/source=([^/]+)/[^/]*$"


def read_fold_lists(spark: SparkSession, directory: str, single_split: bool = False,
                    layout: str = "files") -> DataFrame:
    """Fold membership (fold, split, source, uuid) from uuid-per-line text files; blank lines are dropped.

    ``single_split`` reads ``train.txt`` / ``test.txt`` as fold 0 (source = null). ``layout="partitioned"`` reads
    the same lists from ``fold=<k>/split=<s>/source=<src>/`` directories, as Spark writes them.
    """
    base = directory.rstrip("/")
    if layout == "partitioned":
        df = spark.read.option("recursiveFileLookup", True).text(base)
        path = F.col("_metadata.file_path")
        out = df.select(F.regexp_extract(path, PARTITIONED_PATTERN, 1).cast("int").alias("fold"),
                        F.regexp_extract(path, PARTITIONED_PATTERN, 2).alias("split"),
                        F.regexp_extract(path, PARTITIONED_PATTERN, 3).alias("source"),
                        F.trim("value").alias("uuid"))
        return out.filter(F.col("uuid") != "")
    if layout != "files":
        raise ValueError(f"layout must be 'files' or 'partitioned', not {layout!r}")
    if single_split:
        df = spark.read.text([f"{base}/{n}" for n in SINGLE_SPLIT_FILES])
        fname = F.col("_metadata.file_name")
        out = df.select(F.lit(0).alias("fold"), F.regexp_extract(fname, r"^(train|test)\.txt$", 1).alias("split"),
                        F.lit(None).cast("string").alias("source"), F.trim("value").alias("uuid"))
    else:
        df = spark.read.text(f"{base}/{FOLD_FILE_GLOB}")
        fname = F.col("_metadata.file_name")
        out = df.select(F.regexp_extract(fname, FOLD_FILE_PATTERN, 1).cast("int").alias("fold"),
                        F.regexp_extract(fname, FOLD_FILE_PATTERN, 2).alias("split"),
                        F.regexp_extract(fname, FOLD_FILE_PATTERN, 3).alias("source"),
                        F.trim("value").alias("uuid"))
    return out.filter(F.col("uuid") != "")
