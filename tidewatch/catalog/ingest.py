"""CSV sources and table sinks, over files written from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.standin import CARRY, COMPLETE_SQL, FLOWS_SQL, LINE_SPEC, RAW_SQL, flows, raw
from tidewatch.operators import inspect
from tidewatch.operators.evidence import class_medians
from tidewatch.plans import clean as cleaning
from tidewatch.session import per_table, scratch_path
from tidewatch.sources import flows as source
from tidewatch.spec import FlowSpec

TEXT_COLUMNS = ("src", "seen_at", "quantity", "price", "discount", "tax", "label")
# Two header styles of one layout: padded names, and a name that repeats.
HEADERS = {"a": {"src": "src", "seen_at": " seen_at", "quantity": " quantity", "price": "price  ", "discount": "discount",
                 "tax": " tax", "label": " label"},
           "b": {"src": "src", "quantity": "quantity", "discount": " discount", "label": "label"}}


def _write(df, path, encoding="UTF-8", quote=True):
    writer = (df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("emptyValue", "")
              .option("ignoreTrailingWhiteSpace", False).option("encoding", encoding))
    (writer if quote else writer.option("quote", "")).csv(path)
    return path


def _styled(df, style):
    return df.select(*[F.col(c).alias(h) for c, h in HEADERS[style].items()])


@per_table("lineitem")
def csv_folders(spark, sf_dir):
    """Full layout (style a, with the price twice) and a narrow one (style b)."""
    table = raw(spark, sf_dir)
    a = _styled(table, "a").withColumn(" price", F.lit("-1"))
    return (_write(a, scratch_path(spark, "flows-a")), _write(_styled(table, "b"), scratch_path(spark, "flows-b")))


# In CSV an empty cell and a missing one are the same text.
_CELL = {c: f"CASE WHEN {c} <> '' THEN {c} END" for c in TEXT_COLUMNS}


@query("scan_flows_csv", f"WITH {RAW_SQL} SELECT {', '.join(f'{e} AS {c}' for c, e in _CELL.items())} FROM raw")
def _(spark, sf_dir):
    return source.read_flows(spark, [csv_folders(spark, sf_dir)[0]], LINE_SPEC)


@query("proj_drop_duplicate_header", f"""WITH {RAW_SQL} SELECT {_CELL['price']} AS price, count(*) AS n FROM raw
  GROUP BY 1""")
def _(spark, sf_dir):
    table = source.read_flows(spark, [csv_folders(spark, sf_dir)[0]], LINE_SPEC)
    return table.groupBy("price").agg(F.count("*").alias("n"))


@query("scan_many_files", f"""WITH {RAW_SQL}, u AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _CELL.items())} FROM raw
    UNION ALL SELECT {_CELL['src']}, NULL, {_CELL['quantity']}, NULL, {_CELL['discount']}, NULL, {_CELL['label']} FROM raw)
  SELECT * FROM u""")
def _(spark, sf_dir):
    return source.read_flows(spark, [*csv_folders(spark, sf_dir), "/nowhere/missing.csv"], LINE_SPEC)


_DASH = FlowSpec(name="dash", profiles={"P": ("quantity",)}, default_profile="P", label_column="label", label_map={},
                 classes=(), identity=("src",))


@query("scan_encoding_fallback", f"""WITH {RAW_SQL}, t AS (SELECT src, quantity, 'Web Attack ' || chr(150) || ' ' || coalesce(trim(label), 'none')
    AS label FROM raw), u AS (SELECT * FROM t UNION ALL SELECT src, quantity, 'Web Attack ' || chr(8211) || ' ' || coalesce(trim(label), 'none')
    FROM raw) SELECT label, count(*) AS n FROM u GROUP BY 1""")
def _(spark, sf_dir):
    table = raw(spark, sf_dir).withColumn("l", F.coalesce(F.trim("label"), F.lit("none")))

    def dashed(dash):
        return table.select("src", "quantity", F.concat(F.lit(f"Web Attack {dash} "), "l").alias("label"))

    latin = _write(dashed("\x96"), scratch_path(spark, "latin"), "ISO-8859-1")
    utf = _write(dashed("–"), scratch_path(spark, "utf"))
    return source.read_flows(spark, [latin, utf], _DASH).groupBy("label").agg(F.count("*").alias("n"))


def _with_surplus(spark, sf_dir):
    """Some labels hold an unquoted comma, which makes a cell too many."""
    table = raw(spark, sf_dir).select("src", "quantity", F.when(
        F.col("label").contains("Heart"), F.concat("label", F.lit(",surplus"))).otherwise(F.coalesce("label", F.lit("-"))).alias("label"))
    return _write(table, scratch_path(spark, "surplus"), quote=False)


@query("scan_bad_lines", f"""WITH {RAW_SQL} SELECT CASE WHEN src <> '' THEN src END AS src,
    CASE WHEN quantity <> '' THEN quantity END AS quantity, coalesce(label, '-') AS label FROM raw
  WHERE label IS NULL OR label NOT LIKE '%Heart%'""")
def _(spark, sf_dir):
    return source.read_flows(spark, [_with_surplus(spark, sf_dir)], _DASH)


@query("scan_bad_line_counts", f"""WITH {RAW_SQL} SELECT CAST(count(*) FILTER (label LIKE '%Heart%') AS BIGINT) AS malformed,
    count(*) AS rows FROM raw""")
def _(spark, sf_dir):
    found = source.malformed_lines(spark, [_with_surplus(spark, sf_dir)])  # a header line in each file
    return found.agg(F.sum("malformed").alias("malformed"), (F.sum("lines") - F.count("*")).alias("rows"))


def _nation_header(spark, sf_dir):
    """A file whose header cells are the nations, padded by region."""
    cells = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        "n_nationkey", F.concat(F.repeat(F.lit(" "), F.col("n_regionkey").cast("int")), "n_name").alias("cell"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "cell"))), lambda x: x["cell"]), ",")
    path = scratch_path(spark, "nation-header")
    cells.agg(line.alias("value")).write.text(path)
    return path


def _headers(spark, sf_dir):
    """Header cells of the folders, named by style instead of by part file."""
    a, b = csv_folders(spark, sf_dir)
    tables = [source.scan_headers(spark, [p]).withColumn("file", F.lit(n)).distinct()
              for n, p in (("a", a), ("b", b), ("c", _nation_header(spark, sf_dir)))]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


_HEADER_ROWS = ", ".join(
    [f"('a', {i}, '{h}', '{c}')" for i, (c, h) in enumerate(HEADERS["a"].items())] + ["('a', 7, ' price', 'price')"]
    + [f"('b', {i}, '{h}', '{c}')" for i, (c, h) in enumerate(HEADERS["b"].items())])
_H = f"""WITH h(file, pos, raw, canonical) AS (SELECT * FROM (VALUES {_HEADER_ROWS})
  UNION ALL SELECT 'c', CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER), repeat(' ', CAST(n_regionkey AS INTEGER)) || n_name,
    n_name FROM nation)"""


@query("scan_headers", f"{_H} SELECT * FROM h")
def _(spark, sf_dir):
    return _headers(spark, sf_dir)


def _identity_sql(found: str) -> str:
    return f"concat_ws(',', {', '.join(f"CASE WHEN {found} bool_or(canonical = '{c}') THEN '{c}' END" for c in LINE_SPEC.identity)})"


@query("agg_column_profile", f"""{_H}, p AS (SELECT file, canonical, string_agg(pos, ',' ORDER BY pos) AS positions FROM h
    GROUP BY 1, 2 HAVING count(*) > 1),
  d AS (SELECT file, string_agg(canonical || ' at ' || positions, '; ' ORDER BY canonical) AS duplicates FROM p GROUP BY 1)
  SELECT file, count(*) AS columns, count(*) FILTER (raw <> trim(raw)) AS padded, count(*) FILTER (raw = trim(raw)) AS unpadded,
    count(*) - count(DISTINCT canonical) AS repeated, coalesce(any_value(duplicates), '') AS duplicates,
    count(DISTINCT CASE WHEN canonical IN ('src', 'seen_at') THEN canonical END) AS identity_present,
    2 - count(DISTINCT CASE WHEN canonical IN ('src', 'seen_at') THEN canonical END) AS identity_missing,
    {_identity_sql('')} AS present, {_identity_sql('NOT')} AS missing,
    'unrecognised' AS layout FROM h LEFT JOIN d USING (file) GROUP BY 1""")
def _(spark, sf_dir):
    out = inspect.column_profile(_headers(spark, sf_dir), LINE_SPEC)
    named = F.transform("duplicates", lambda d: F.concat(d["canonical"], F.lit(" at "), F.array_join(d["positions"].cast("array<string>"), ",")))
    return out.withColumns({"duplicates": F.array_join(named, "; "), "present": F.array_join("present", ","),
                            "missing": F.array_join("missing", ",")})


@query("agg_repeated_headers", f"""{_H} SELECT file, canonical, count(*) AS copies,
    string_agg(pos, ',' ORDER BY pos) AS positions FROM h GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf_dir):
    out = inspect.repeated_headers(_headers(spark, sf_dir))
    return out.withColumn("positions", F.concat_ws(",", F.col("positions").cast("array<string>")))


@query("agg_file_profile", f"""{_H}, c(profile, name) AS (VALUES ('WIDE', 'quantity'), ('WIDE', 'price'),
    ('WIDE', 'discount'), ('WIDE', 'tax'), ('NARROW', 'quantity'), ('NARROW', 'discount')),
  g AS (SELECT f.file, profile, count(*) FILTER (name NOT IN (SELECT canonical FROM h WHERE h.file = f.file)) AS missing
    FROM (SELECT DISTINCT file FROM h) f, c GROUP BY 1, 2)
  SELECT file, profile, missing, missing = 0 AS satisfied,
    CASE WHEN min(missing) OVER (PARTITION BY file) = 0 THEN
      first_value(profile) OVER (PARTITION BY file ORDER BY missing > 0, profile DESC) END AS chosen FROM g""")
def _(spark, sf_dir):
    return inspect.file_profiles(_headers(spark, sf_dir), LINE_SPEC)


# --- sinks -------------------------------------------------------------------------------

@query("sink_flows", f"WITH {COMPLETE_SQL} SELECT src, capture_timestamp, discount, price, quantity, tax, threat_class FROM complete")
def _(spark, sf_dir):
    path = scratch_path(spark, "processed")
    rows = cleaning.usable(cleaning.deduplicated(cleaning.prepared(raw(spark, sf_dir), LINE_SPEC, CARRY), LINE_SPEC, CARRY), LINE_SPEC)
    cleaning.write_flows(cleaning.quality.stable_order(rows.drop(*CARRY), LINE_SPEC), path)
    return spark.read.parquet(path)


@query("sink_reference_medians", f"""WITH {FLOWS_SQL} {' UNION ALL '.join(
    f"SELECT truth AS class, '{c}' AS feature, count({c}) AS n, round(quantile_cont({c}, 0.5), 6) AS median FROM flows "
    f"WHERE truth IN ('BENIGN', 'DDoS', 'PortScan', 'Botnet') GROUP BY 1" for c in LINE_SPEC.features())}""")
def _(spark, sf_dir):
    path = scratch_path(spark, "medians")
    class_medians(flows(spark, sf_dir), LINE_SPEC.features(), "truth", LINE_SPEC.classes).write.parquet(path)
    return spark.read.parquet(path).withColumn("median", F.round("median", 6))
