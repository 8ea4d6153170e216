"""Reading flow CSV files: headers, encodings, malformed lines, many files.

All cells are read as text; typing is the cleaning job's work. Any number of files is
read in three scans. The first makes a table of files, one row each: the place of its
first line, and whether it is valid UTF-8. The second fetches the lines at those places.
The third joins lines to the table, decodes and parses them, and takes each cell by the
place its column has in the file's header. No scan sorts lines. The driver sees distinct
headers, never files or lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.naming import canonical_header, canonical_name
from tidewatch.session import materialize, path_exists
from tidewatch.spec import FlowSpec

LATIN1 = "ISO-8859-1"
CORRUPT = "_corrupt"


def _base_name(path: F.Column) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def header_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, file, line``: the first line of each file.

    Only splits at offset 0 take part, one per file. The opening line is the one of the
    least place: an aggregate of texts may sort and spill, and then has no first row.
    """
    opening = _lines(spark, paths).filter(F.col("at") == 0)
    heads = materialize(opening.groupBy("path").agg(F.min("i").alias("head")), "flow-heads")  # numbers only: nothing is sorted
    return (_opening_lines(opening, heads).select("path", "line").withColumn("file", _base_name(F.col("path"))))


def _opening_lines(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """``heads``, a stored table, with ``line``: the text at each file's place ``head``. Its known size lets
    it be broadcast, so other lines end in the scan's task."""
    return lines.filter(F.col("at") == 0).join(heads, ["path"]).filter(F.col("i") == F.col("head")).select(
        *heads.columns, F.col("value").alias("line"))


def scan_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, pos, raw, canonical``: the header cells of many files in one job."""
    return explode_headers(header_lines(spark, paths))


def explode_headers(lines: DataFrame) -> DataFrame:
    return (lines.select("file", F.posexplode(F.split(F.rtrim("line", F.lit("\r\n")), ",")).alias("pos", "raw"))
            .withColumn("canonical", canonical_header(F.col("raw"))))


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, at, i, value``: lines with the offset of their split and their place in the scan."""
    return spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("i"), "value")


def file_table(lines: DataFrame) -> DataFrame:
    """``path, line, head, latin``: each file's first line, its place, and whether any line is no valid UTF-8.

    Only splits at offset 0 give a first line, one per file. Places and flags are numbers,
    added up in a hash map without sorting; the first lines are fetched by their places.
    """
    opening = F.col("at") == 0
    found = lines.groupBy("path").agg(
        F.min(F.when(opening, F.col("i"))).alias("head"), (~F.bool_and(F.is_valid_utf8("value"))).alias("latin"))
    return _opening_lines(lines, materialize(found, "flow-heads")).select("path", "line", "head", "latin")


def existing(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split configured paths into present and missing; none present is an error."""
    found = [p for p in paths if path_exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"no readable input among {list(paths)}")
    return found, [p for p in paths if p not in set(found)]


def cell_count(line: Column) -> Column:
    """Cells of a CSV line; commas inside quotes part nothing."""
    return F.size(F.split(F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', ""), ","))


def read_flows(spark: SparkSession, paths: Sequence[str], spec: FlowSpec, *, keep_file: bool = False,
               keep_corrupt: bool = False) -> DataFrame:
    """The given files as one table by column name, pruned to what the spec retains.

    Short rows are padded with nulls, as flow tools expect; rows with more cells than
    their file's header are left out, or kept whole under ``CORRUPT``. The first copy of
    a repeated column counts. A file that is no valid UTF-8 is read as Latin-1 throughout.
    A line in a file that repeats its header is a row like any other.
    """
    found, _ = existing(spark, paths)
    text = _lines(spark, found)  # one listing of the files, so both scans place lines alike
    files = materialize(file_table(text), "flow-files")
    headers = [r["line"] for r in files.select("line").distinct().collect()]  # the layouts, not the files
    layouts = {line: line.rstrip("\r\n").split(",") for line in sorted(headers)}
    places: dict[str, dict[str, int]] = {}
    for line, cells in layouts.items():
        for at, raw in enumerate(cells):
            name = canonical_name(raw)
            if name in set(spec.retained):
                places.setdefault(name, {}).setdefault(line, at)
    width = max(map(len, layouts.values()), default=1)

    # The table of files is joined by broadcast where it is small enough for the planner, else by its key.
    moved = F.raise_error(F.lit("the input files changed while they were read"))
    body = F.when(F.col("i") != F.col("head"), F.lit(True)).when(F.col("value") == F.col("line"), F.lit(False)).otherwise(moved.cast("boolean"))
    lines = text.join(files, "path").filter(body).filter(F.trim("value") != "")
    lines = lines.withColumn("value", F.when(F.col("latin"), F.decode(F.col("value").cast("binary"), LATIN1)).otherwise(F.col("value")))
    size = F.lit(0)
    for line, cells in layouts.items():
        size = F.when(F.col("line") == line, F.lit(len(cells))).otherwise(size)
    # Commas at large are counted first: few lines have more of them than they may.
    surplus = (F.size(F.split("value", ",")) > size) & (cell_count(F.col("value")) > size)
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
    parsed = lines.withColumns({"surplus": surplus, "row": cells})
    if not keep_corrupt:
        parsed = parsed.filter(~F.col("surplus"))
    columns = []
    for name, at in places.items():
        value = F.lit(None).cast("string")
        for line, i in at.items():
            value = F.when(F.col("line") == line, F.col(f"row.c{i}")).otherwise(value)
        columns.append(value.alias(name))
    if keep_corrupt:
        columns.append(F.when(F.col("surplus"), F.col("value")).alias(CORRUPT))
    if keep_file:
        columns.append(_base_name(F.col("path")).alias("file"))
    return parsed.select(*columns)


def malformed_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows per file with more cells than its header: what the readers skip."""
    heads = header_lines(spark, paths).select("path", cell_count(F.col("line")).alias("cells"))
    text = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), "value")
    wide = (text.filter(F.trim("value") != "").groupBy("path", cell_count(F.col("value")).alias("k"))
            .agg(F.count("*").alias("n")))  # one row per file and cell count
    return (wide.join(heads, "path").groupBy(_base_name(F.col("path")).alias("file"))
            .agg(F.coalesce(F.sum(F.when(F.col("k") > F.col("cells"), F.col("n"))), F.lit(0)).alias("malformed"),
                 F.sum("n").alias("lines")))
