"""Flow files of any layout and encoding in two scans."""

import pytest

from tidewatch.catalog.standin import LINE_SPEC
from tidewatch.operators import inspect
from tidewatch.sources import flows as source
from tidewatch.spec import FlowSpec

SPEC = FlowSpec(name="t", profiles={"P": ("quantity",)}, default_profile="P", label_column="label", label_map={}, classes=(), identity=("src",))


@pytest.fixture()
def folder(tmp_path):
    files = {
        "a.csv": "src, quantity,label\r\n1,2,x\r\n\r\n3,4\r\n5,6,y,surplus\r\n7,\"8,5\",z\r\nsrc, quantity,label\r\n".encode(),
        "b.csv": "label,src,other, quantity, quantity\n–,10,q,11,12\n".encode(),
        "c.csv": "src,label\n20,caf\xe9 \x96\n".encode("latin-1"),
        "d.csv": b"src,label\n", "e.csv": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_layouts_encodings_and_lines(spark, folder):
    rows = source.read_flows(spark, [folder, folder + "/missing.csv"][:1], SPEC, keep_file=True).collect()
    got = sorted((r.file, r.src, r.quantity, r.label) for r in rows)
    assert got == sorted([
        ("a.csv", "1", "2", "x"), ("a.csv", "3", "4", None), ("a.csv", "7", "8,5", "z"), ("a.csv", "src", " quantity", "label"),
        ("b.csv", "10", "11", "–"), ("c.csv", "20", None, "caf\xe9 \x96")])
    kept = source.read_flows(spark, [folder], SPEC, keep_corrupt=True).collect()
    assert len(kept) == 7 and [r[source.CORRUPT] for r in kept if r[source.CORRUPT]] == ["5,6,y,surplus"]


def test_many_small_splits(spark, tmp_path):
    n = 3000
    (tmp_path / "big.csv").write_text("src,quantity,label\n" + "".join(f"{i},{i},l\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = source.read_flows(spark, [str(tmp_path)], SPEC)
        assert sorted(int(r.src) for r in rows.collect()) == list(range(n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_text_is_read_once_for_the_files_and_once_for_the_rows(spark, folder):
    plan = source.read_flows(spark, [folder], SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("FileScan text") == 1 and "FileScan csv" not in plan


def test_first_lines_are_found_without_sorting_texts(spark, folder):
    """A sort by path alone spills on larger files, and the first row after it is any line of the file."""
    for table in (source.file_table(source._lines(spark, [folder])), source.header_lines(spark, [folder])):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "first(" not in plan
        lines = {r.path.rsplit("/", 1)[1]: r.line.strip() for r in table.collect()}
        assert lines["a.csv"] == "src, quantity,label" and lines["d.csv"] == "src,label" and len(lines) == 4


def test_column_profile_names_what_it_counts(spark):
    """Before, repeated names came without positions and identity columns without names."""
    cells = [("x", 0, " src", "src"), ("x", 1, "price", "price"), ("x", 2, "tax", "tax"), ("x", 3, " price ", "price"), ("x", 12, "price", "price"),
             ("y", 0, "tax", "tax")]
    rows = {r["file"]: r for r in inspect.column_profile(spark.createDataFrame(cells, "file string, pos int, raw string, canonical string"),
                                                         LINE_SPEC).collect()}
    x, y = rows["x"], rows["y"]
    assert [(d["canonical"], d["positions"]) for d in x["duplicates"]] == [("price", [1, 3, 12])] and y["duplicates"] == []
    assert (x["present"], x["missing"], y["missing"]) == (["src"], ["seen_at"], ["src", "seen_at"])
    assert (x["columns"], x["padded"], x["unpadded"], x["repeated"], x["identity_present"], y["identity_missing"]) == (5, 2, 3, 2, 1, 2)
