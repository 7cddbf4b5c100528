"""Text files whose header must be found per file.

Lines of all files are scanned in parallel; the header line of each file is found by
a small aggregate and joined back by file, and cells are then picked by name. Files
may order, add or lack columns, and nothing about them is listed on the driver. What is
data is told by content alone: positions of one scan are never compared with those of another,
because how files are packed into tasks may change between them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.checks import assert_none
from ..session import settle

ROW_ORDER = ["source_file", "source_block", "source_row"]
BOM = "\ufeff"


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(line, source_file, source_block, source_row); an empty glob fails in the reader.

    (source_block, source_row) orders the lines of one file: block offset in bytes,
    then a counter that rises within the task that reads the block.
    """
    raw = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    return raw.select(
        F.regexp_replace("value", BOM, "").alias("line"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
    )


def header_of_files(lines: DataFrame, is_header: Column, clean: Callable[[Column], Column] = F.trim) -> DataFrame:
    """(source_file, header, header_line): the first line per file that satisfies ``is_header``, cleaned and as it stands.

    One small row per file, written to the shared folder because the column checks and
    the join below would each scan the files again for it.
    """
    heads = (
        lines.where(is_header)
        .groupBy("source_file")
        .agg(F.min(F.struct("source_block", "source_row", "line")).alias("_h"))
        .select("source_file", clean(F.col("_h.line")).alias("header"), F.col("_h.line").alias("header_line"))
    )
    return settle(heads, "headers")


def pick_columns(
    lines: DataFrame, headers: DataFrame, wanted: dict[str, str], sep: str, required: Sequence[str] = (), keep: Sequence[str] = ROW_ORDER,
) -> DataFrame:
    """Data lines as text columns: ``wanted`` maps header name -> output name.

    ``lines`` holds the data lines and may hold the header line, which is left out wherever it
    occurs. A file without a header or without a ``required`` column raises; other missing
    columns are NULL for that file.
    """
    width = headers.agg(F.max(F.size(F.split("header", f"[{sep}]")))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    cells = lambda text: F.array(*[F.from_csv(text, schema, {"sep": sep, "quote": '"'})[f"c{i}"] for i in range(width)])
    names = F.transform(cells(F.col("header")), lambda n: F.trim(F.translate(n, "\u00a0", " ")))
    heads = headers.select("source_file", "header_line", names.alias("_names"))
    for name in required:
        assert_none(heads.where(~F.array_contains("_names", name)).select("source_file"), f"column {name!r} not found")
    places = heads.select("source_file", "header_line", *[F.array_position("_names", n).alias(f"_p{i}") for i, n in enumerate(wanted)])
    no_header = F.raise_error(F.concat(F.lit("no header found in "), F.col("source_file"))).cast("boolean")
    data = lines.join(places, "source_file", "left").where(F.when(F.col("header_line").isNull(), no_header).otherwise(F.col("line") != F.col("header_line")))
    data = data.withColumn("_cells", cells(F.col("line")))
    text = [
        F.when(F.col(f"_p{i}") > 0, F.get("_cells", (F.col(f"_p{i}") - 1).cast("int"))).alias(out) for i, out in enumerate(wanted.values())
    ]
    return data.select(*text, *keep)
