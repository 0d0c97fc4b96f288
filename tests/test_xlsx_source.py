"""Workbooks as a data source: round trips, limits, files that can't be read, overwriting, failed jobs."""

import pytest
from pyspark.sql import functions as F

from veilspark.operators.tables import scrub_table
from veilspark.sources import files
from veilspark.sources.xlsx_source import register

ROWS = [("陳小明", "手機0912345678"), ("", "a\r\nb\rc\nd"), (None, " <&>'\" "), ("x", "=1+1"), ("00123", "1.50")]
SCHEMA = "`姓名` string, `備註` string"


@pytest.fixture
def xlsx(spark):
    register(spark)
    return spark


def _sorted(rows):
    return sorted(tuple(r) for r in rows)


def test_round_trip(xlsx, tmp_path):
    df = xlsx.createDataFrame(ROWS, SCHEMA).repartition(2)
    out = str(tmp_path / "out")
    df.write.format("xlsx").option("title", "名單").mode("append").save(out)
    want = _sorted((a or "", b) for a, b in ROWS)
    assert _sorted(xlsx.read.format("xlsx").schema(SCHEMA).load(out).collect()) == want
    assert _sorted(xlsx.read.format("xlsx").schema("`備註` string").load(out).collect()) == sorted((b,) for _, b in want)
    raw = xlsx.read.format("xlsx").load(out).collect()
    assert {r.title for r in raw} == {"名單"} and {r.error for r in raw} == {None}
    assert all(list(r.cells) == ["姓名", "備註"] for r in raw if r.row == 1) and _sorted(r.cells for r in raw if r.row > 1) == want
    df.limit(1).write.format("xlsx").mode("append").save(out)
    assert xlsx.read.format("xlsx").schema(SCHEMA).load(out).count() == 6
    df.limit(2).write.format("xlsx").mode("overwrite").save(out)
    assert xlsx.read.format("xlsx").schema(SCHEMA).load(out).count() == 2
    assert all(p.suffix == ".xlsx" and not p.name.startswith(".") for p in (tmp_path / "out").iterdir())


def test_scrubbed_workbooks(xlsx, tmp_path):
    xlsx.createDataFrame(ROWS[:1], SCHEMA).write.format("xlsx").mode("append").save(str(tmp_path / "in"))
    table = xlsx.read.format("xlsx").schema(SCHEMA).load(str(tmp_path / "in")).withColumn("row", F.lit(2))
    done = scrub_table(table, {"姓名": "mask_all", "備註": "ner"}, "row")[0].drop("row")
    done.write.format("xlsx").mode("append").save(f"file://{tmp_path}/out")
    assert [tuple(r) for r in xlsx.read.format("xlsx").schema(SCHEMA).load(str(tmp_path / "out")).collect()] == [("陳○○", "手機091****678")]


def test_empty_tables_and_sheets(xlsx, tmp_path):
    xlsx.createDataFrame([], SCHEMA).write.format("xlsx").mode("append").save(str(tmp_path / "out"))
    assert xlsx.read.format("xlsx").schema(SCHEMA).load(str(tmp_path / "out")).count() == 0
    (tmp_path / "out/e.xlsx").write_bytes(files.write_xlsx("t", []))
    (tmp_path / "out/notes.txt").write_text("not a workbook")
    for schema in (SCHEMA, None):
        read = xlsx.read.format("xlsx")
        assert (read.schema(schema) if schema else read).load(str(tmp_path / "out")).count() == 0


def test_files_that_cannot_be_read(xlsx, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"no zip")
    (tmp_path / "b.XLSX").write_bytes(files.write_xlsx("t", [["k"], ["1", "2"]]))
    (tmp_path / "c.xlsx").write_bytes(files.write_xlsx("t", [["k", "m"], ["1"]]))
    (tmp_path / "d.xlsx").write_bytes(b"0" * (files.MAX_BYTES + 1))
    got = {}
    for r in xlsx.read.format("xlsx").load(str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.cells, r.error))
    assert got == {"a.xlsx": [(None, "XLSX")], "b.XLSX": [(None, "ROW_TOO_LONG 2")], "c.xlsx": [(["k", "m"], None), (["1"], None)], "d.xlsx": [(None, "FILE_TOO_LARGE")]}
    one = xlsx.read.format("xlsx").schema("m string, k string").load(str(tmp_path / "c.xlsx")).collect()
    assert [tuple(r) for r in one] == [(None, "1")]
    for path, schema, error in ((tmp_path / "a.xlsx", "k string", "XLSX .*a.xlsx"), (tmp_path / "b.XLSX", "k string", "ROW_TOO_LONG 2"), (tmp_path / "d.xlsx", "k string", "FILE_TOO_LARGE"), (tmp_path / "c.xlsx", "other string", "NO_COLUMN other"), (tmp_path / "none", "k string", "PATH_NOT_FOUND"), (tmp_path / "c.xlsx", "k int", "columns of workbooks")):
        with pytest.raises(Exception, match=error):
            xlsx.read.format("xlsx").schema(schema).load(str(path)).collect()


def test_workbooks_hold_a_bounded_number_of_rows(xlsx, tmp_path):
    n = files.MAX_ROWS + 5
    xlsx.range(n).selectExpr("cast(id as string) as k").coalesce(1).write.format("xlsx").mode("append").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 2
    back = xlsx.read.format("xlsx").schema("k string").load(str(tmp_path / "out"))
    assert back.count() == back.distinct().count() == n


def test_failed_jobs_leave_nothing(xlsx, tmp_path):
    out = tmp_path / "out"
    xlsx.createDataFrame([("kept",)], "k string").write.format("xlsx").mode("append").save(str(out))
    before = {p.name for p in out.iterdir()}
    bad = xlsx.range(0, 4, 1, 4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("STOP"))).otherwise(F.col("id").cast("string")).alias("k"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="STOP"):
            bad.write.format("xlsx").mode(mode).save(str(out))
    assert {p.name for p in out.iterdir() if not p.name.startswith(".")} == before
    for broken in ("a\x0bb", "￾"):
        with pytest.raises(Exception, match="CELL"):
            xlsx.createDataFrame([(broken,)], "k string").write.format("xlsx").mode("append").save(str(out))
