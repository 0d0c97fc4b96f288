"""The engine on small tables: placeholders, tables, files, names, streams."""

import base64
import io
import json
import time
import zipfile
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from veilspark.operators.names import distinct_names, output_name
from veilspark.operators.file_scrub import saved_names, scrub_files
from veilspark.operators.scrub import detect_findings, entity_counts, mapping, restore, scrub, scrubbed, scrubbed_with_mapping
from veilspark.operators.tables import preview, report, scrub_table
from veilspark.plans.control import DeadlineExceeded, run_within
from veilspark.plans.entities import rule
from veilspark.sources import files
from veilspark.streaming.scrub_stream import entity_counts_by_window, scrub_stream

TEXTS = ["身分證K182504372,手機0912345678", "K18250\n4372再次出現", "另一位F270000018", "無", "", None]


def _df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_invariants(spark):
    for r in scrub(_df(spark)).collect():
        if r.text is None:
            assert r.scrubbed is None
            continue
        assert sum(r.stats.values()) == len(r.findings)
        back = r.scrubbed
        for f in reversed(r.findings):
            assert r.scrubbed[f.scrubbed_start : f.scrubbed_end] == f.replacement and r.text[f.start : f.end] == f.value
            back = back[: f.scrubbed_start] + f.value + back[f.scrubbed_end :]
        assert back == r.text


def test_placeholders(spark):
    out = scrub(_df(spark), mode="placeholder", order="id")
    rows = {r.id: r for r in out.collect()}
    assert rows[0].scrubbed == "身分證<TW_ID_1>,手機<MOBILE_1>" and rows[1].scrubbed == "<TW_ID_1>再次出現" and rows[2].scrubbed == "另一位<TW_ID_2>"
    assert rows[3].scrubbed == "無" and rows[4].scrubbed == "" and rows[5].scrubbed is None
    f = rows[0].findings[1]
    assert rows[0].scrubbed[f.scrubbed_start : f.scrubbed_end] == "<MOBILE_1>"
    ids = mapping(out, "id")
    assert {(r.placeholder, r.value) for r in ids.collect()} == {("<TW_ID_1>", "K182504372"), ("<TW_ID_2>", "F270000018"), ("<MOBILE_1>", "0912345678")}
    back = {r.id: r.restored for r in restore(out.where("scrubbed is not null").select("id", "scrubbed"), "scrubbed", ids).collect()}
    assert back[0] == TEXTS[0] and back[1] == "K182504372再次出現" and back[4] == ""


def test_errors(spark):
    df = spark.createDataFrame([(1, "x" * 50_001)], "id int, text string")
    for bad in ({"mode": "delete"}, {"entities": []}, {"on_long": "?"}, {"mode": "placeholder"}):
        with pytest.raises(ValueError):
            scrub(df, **bad)
    with pytest.raises(Exception, match="TEXT_TOO_LONG"):
        scrub(df).collect()
    r = scrub(df, on_long="quarantine").first()
    assert r.scrubbed is None and r.error == "TEXT_TOO_LONG"


def test_table(spark):
    df = spark.createDataFrame([(2, "陳小明", "手機0912345678", "a"), (3, "", "K182504372", "b"), (4, "陳小明", None, "c")], "row int, `姓名` string, `備註` string, `編號` string")
    plan = {"姓名": "mask_all", "備註": "ner", "編號": "skip"}
    out, found, ids = scrub_table(df, plan, "row")
    assert [tuple(r) for r in out.orderBy("row").collect()] == [(2, "陳○○", "手機091****678", "a"), (3, "", "K1******72", "b"), (4, "陳○○", None, "c")] and ids is None
    text = report(found, "row", "t.csv", "csv", "mask", plan).first().report
    assert "陳小明" not in text and "K182504372" not in text and '"COLUMN_MASK":2' in text
    out, _, ids = scrub_table(df, plan, "row", "placeholder")
    assert [r.姓名 for r in out.orderBy("row").collect()] == ["<姓名_1>", "", "<姓名_1>"] and ids.count() == 3
    for bad in ({"姓名": "ner"}, {**plan, "編號": "drop"}):
        with pytest.raises(ValueError):
            scrub_table(df, bad, "row")
    assert [(r.name, list(r.samples), r.row_count) for r in preview(df, "row").orderBy("col").collect()][0] == ("姓名", ["陳小明", "陳小明"], 3)


def test_table_rows_keep_to_themselves(spark):
    rows = [(3, "李一", "手機0912345678"), (3, "趙二", "手機0987654321"), (None, "王小明", "K182504372"), (None, "錢四", None), (4, None, "")]
    df = spark.createDataFrame(rows, "row int, `a.b` string, note string").repartition(3)
    plan = {"a.b": "mask_all", "note": "ner"}
    out, found, _ = scrub_table(df, plan, "row")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted([(3, "李○", "手機091****678"), (3, "趙○", "手機098****321"), (None, "王○○", "K1******72"), (None, "錢○", None), (4, None, "")], key=key)
    assert out.columns == df.columns and found.count() == 7 and "李一" not in str(found.collect())
    out, found, ids = scrub_table(df, plan, "row", "placeholder")
    values = {(r.tag, r.value): r.placeholder for r in ids.collect()}
    assert len(values) == len(set(values.values())) == 7
    tag = {"0912345678": "MOBILE", "0987654321": "MOBILE"}
    want = []
    for n, name, note in rows:
        new = values[("a.b", name)] if name else name
        for v in ("0912345678", "0987654321", "K182504372"):
            note = note.replace(v, values[(tag.get(v, "TW_ID"), v)]) if note else note
        want.append((n, new, note))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert [r.replacement for r in found.where("row = 4 OR row IS NULL").collect()] == [r.replacement for r in found.where("row = 4 OR row IS NULL").orderBy("row", "col", "finding").collect()]
    none, _, _ = scrub_table(df.limit(0), plan, "row", "placeholder")
    assert none.count() == 0


def test_column_numbers_skip_those_of_findings(spark):
    df = spark.createDataFrame([(2, "手機0912345678和0987654321", "甲"), (3, "0912345678", "乙"), (4, "", "甲")], "row int, note string, `MOBILE` string")
    out, _, ids = scrub_table(df, {"note": "ner", "MOBILE": "mask_all"}, "row", "placeholder")
    assert [tuple(r) for r in out.orderBy("row").collect()] == [(2, "手機<MOBILE_1>和<MOBILE_2>", "<MOBILE_3>"), (3, "<MOBILE_1>", "<MOBILE_4>"), (4, "", "<MOBILE_3>")]
    assert ids.count() == ids.select("placeholder").distinct().count() == 4


def test_limits_of_workbooks_and_archives(monkeypatch):
    book = files.write_xlsx("t", [["a", "b"], ["1", "2"], ["3", "4"]])
    assert files.parse_xlsx(book)[1][2] == ["3", "4"]
    for name, most, error in (("MAX_ROWS", 2, "TOO_MANY_ROWS"), ("MAX_COLUMNS", 1, "TOO_MANY_COLUMNS"), ("MAX_MEMBERS", 3, "TOO_LARGE"), ("MAX_UNPACKED", 100, "TOO_LARGE")):
        with monkeypatch.context() as m:
            m.setattr(files, name, most)
            with pytest.raises(files.FileError, match=error):
                files.parse_xlsx(book)
    one = base64.b64encode(b"x" * 90).decode()
    for name, most in (("MAX_ENTRIES", 1), ("MAX_BUNDLE", 100)):
        with monkeypatch.context() as m:
            m.setattr(files, name, most)
            with pytest.raises(files.FileError, match="BUNDLE"):
                files.bundle([("a", one), ("b", one)])
    assert files.bundle([("a", one), ("b", one)])[0].endswith(".zip")


def test_previews_keep_few_rows_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("cast(id as int) as row", "cast(id as string) as a").repartition(3)
    assert "WindowGroupLimit" in preview(df, "row")._jdf.queryExecution().executedPlan().toString()


def test_more_rules_in_a_query(spark):
    ticket = rule("TICKET", "Ticket", r"T-[a-z]{4}", 0.9)
    df = spark.createDataFrame([(1, "票T-abcd"), (2, None)], "id int, text string")
    assert [r.scrubbed for r in scrub(df, extra=[ticket]).orderBy("id").collect()] == ["票******", None]
    assert scrub(df, mode="placeholder", order="id", extra=[ticket]).where("id = 1").first().scrubbed == "票<TICKET_1>"


def test_counts_by_window_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", "手機0912345678"), ("2024-01-01 00:02:00", "0987654321"), ("2024-01-01 01:00:00", "x")], "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    stream = entity_counts_by_window(spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in")), "ts")
    q = stream.writeStream.format("memory").outputMode("complete").queryName("windows").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.entity_type, r.n) for r in spark.table("windows").collect()] == [("TW_MOBILE", 2)]


def test_numbers_run_on_over_ranges(spark):
    rows = [(k, f"手機09{(k * 7919) % 500:08d},電話02-2720{k % 30:04d}", k % 3) for k in range(1500)]
    df = spark.createDataFrame(rows, "id int, text string, branch int").repartition(5)
    seen = spark.sparkContext.accumulator(0)

    def names(text, wanted):
        seen.add(1)
        return []

    out = scrub(df, mode="placeholder", order="id", scope=["branch"], ner=names)
    number = {}
    want = []
    for k, text, branch in rows:
        for tag, v in (("MOBILE", text[2:12]), ("PHONE", text[15:])):
            own = number.setdefault((branch, tag), {})
            text = text.replace(v, f"<{tag}_{own.setdefault(v, len(own) + 1)}>")
        want.append(text)
    assert [r.scrubbed for r in out.orderBy("id").collect()] == want
    ids = {(r.branch, r.tag, r.value): r.placeholder for r in mapping(out, "id", ["branch"]).collect()}
    assert ids == {(b, t, v): f"<{t}_{n}>" for (b, t), own in number.items() for v, n in own.items()}
    assert seen.value == len(rows)  # texts go through detection once


def test_length_limit_on_every_entry(spark, tmp_path):
    df = spark.createDataFrame([("x1" * 30_000,)], "text string")
    for found in (detect_findings(df, []), entity_counts(df), df.select(scrubbed(F.col("text")))):
        with pytest.raises(Exception, match="TEXT_TOO_LONG"):
            found.collect()
    assert detect_findings(df, [], on_long="quarantine").count() == 0 and df.select(scrubbed(F.col("text"), on_long="quarantine")["scrubbed"]).first()[0] is None
    assert detect_findings(df, [], max_chars=None).count() == 0


def test_deadline(spark, tmp_path):
    slow = F.pandas_udf(lambda s: (time.sleep(30), s)[1], "long")
    with pytest.raises(DeadlineExceeded):
        run_within(spark, lambda: spark.range(4).select(slow("id")).write.parquet(str(tmp_path / "out")), 2)
    assert not (tmp_path / "out" / "_SUCCESS").exists()
    assert run_within(spark, lambda: spark.range(4).count(), 60) == 4
    with pytest.raises(ValueError):
        run_within(spark, lambda: (_ for _ in ()).throw(ValueError()), 60)


def test_files_from_end_to_end(spark, tmp_path):
    table = [["姓名", "備註", "部門"], ["陳小明", "手機0912345678", "a"], ["", "K18250\n4372", "b"], ["林大華", "0912345678和K182504372"]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/客戶0912345678.csv").write_bytes(files.write_csv(table))
    (tmp_path / "in/b.XLSX").write_bytes(files.write_xlsx("名單", table))
    (tmp_path / "in/c.txt").write_bytes("身分證K182504372\r\n手機0987654321".encode("big5"))
    (tmp_path / "in/d.csv").write_text("別的\nx\n")
    (tmp_path / "in/e.csv").write_bytes(b"\xef\xbb\xbf")
    (tmp_path / "in/f.pdf").write_text("x")
    (tmp_path / "in/g.txt").write_bytes(b"1" * (files.MAX_BYTES + 1))
    (tmp_path / "in/h.txt").write_text("2" * 60_000)
    plan = {"姓名": "mask_all", "備註": "ner", "部門": "skip"}
    out, found, ids = scrub_files(spark, str(tmp_path / "in"), plan)
    got = {unquote(r.path).rsplit("/", 1)[1]: r for r in out.collect()}
    assert ids is None and {k: r.error for k, r in got.items() if r.error} == {"d.csv": "NO_STRATEGY 別的", "f.pdf": "UNSUPPORTED_TYPE", "g.txt": "FILE_TOO_LARGE", "h.txt": "TEXT_TOO_LONG"}
    assert all((r.content is None) == (r.report is None) == (r.name is None) == (r.error is not None) for r in got.values())
    want = [table[0], ["陳○○", "手機091****678", "a"], ["", "K1****\n**72", "b"], ["林○○", "091****678和K1******72"]]
    one = got["客戶0912345678.csv"]
    assert bytes(one.content) == b"\xef\xbb\xbf" + files.write_csv(want)[3:] and one.name == "客戶091xxxx678.scrubbed.csv"
    assert files.parse_xlsx(bytes(got["b.XLSX"].content)) == ("名單", want) and got["b.XLSX"].name == "b.scrubbed.xlsx"
    assert bytes(got["c.txt"].content).decode() == "身分證K1******72\r\n手機098****321" and bytes(got["e.csv"].content) == b"\xef\xbb\xbf"
    report = json.loads(one.report)
    assert report["source_filename"] == "客戶091xxxx678.csv" and report["stats"] == {"COLUMN_MASK": 2, "TW_MOBILE": 2, "TW_NATIONAL_ID": 2} and report["column_strategies"] == plan
    assert [f["location"] for f in report["findings"]] == [{"row": r, "column": c} for r, c in [(2, "姓名"), (2, "備註"), (3, "備註"), (4, "姓名"), (4, "備註"), (4, "備註")]]
    assert [f["location"] for f in json.loads(got["c.txt"].report)["findings"]] == [{"start": 3, "end": 13}, {"start": 17, "end": 27}]
    assert not any(v in r.report for r in got.values() if r.report for v in ("陳小明", "K182504372", "0912345678"))
    written = files.save_files(saved_names(out), f"file://{tmp_path}/out").collect()
    assert {r.name for r in written} == {p.name for p in (tmp_path / "out").iterdir()} == {"客戶091xxxx678.scrubbed.csv", "b.scrubbed.xlsx", "c.scrubbed.txt", "e.scrubbed.csv"}
    assert (tmp_path / "out/c.scrubbed.txt").read_bytes() == bytes(got["c.txt"].content)

    out, found, ids = scrub_files(spark, str(tmp_path / "in"), {unquote(n): plan for n in got} | {"d.csv": {"別的": "skip"}}, "placeholder")
    got = {unquote(r.path).rsplit("/", 1)[1]: r for r in out.collect()}
    assert files.parse_csv(bytes(got["客戶0912345678.csv"].content).decode("utf-8-sig")) == [table[0], ["<姓名_1>", "手機<MOBILE_1>", "a"], ["", "<TW_ID_1>", "b"], ["<姓名_2>", "<MOBILE_1>和<TW_ID_1>"]]
    assert bytes(got["c.txt"].content).decode() == "身分證<TW_ID_1>\r\n手機<MOBILE_1>" and got["d.csv"].error is None
    assert {(r.placeholder, r.value) for r in ids.where("path LIKE '%c.txt'").collect()} == {("<TW_ID_1>", "K182504372"), ("<MOBILE_1>", "0987654321")}
    assert found.count() == 14
    for bad in ({"姓名": "drop"}, {"姓名": 1}):
        with pytest.raises(ValueError):
            scrub_files(spark, str(tmp_path / "in"), bad)


def test_preview_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("x,y\n1,\n,2\n3,4\n5,6\n7,8\n".encode("utf-8-sig"))
    texts = ["\ufeff", "one", "one\n", "a\r\nb\rc\n\nd", "\n", "a\u2028b\x85"]
    for k, t in enumerate(texts):
        (tmp_path / f"t{k}.txt").write_bytes(t.encode())
    got = files.preview_files(files.read_files(spark, str(tmp_path))).collect()
    assert [(r.name, list(r.samples), r.row_count, r.encoding) for r in sorted(got, key=lambda r: (r.path, r.col)) if r.filetype == "csv"] == [("x", ["1", "3", "5"], 5, "utf-8-sig"), ("y", ["2", "4", "6"], 5, "utf-8-sig")]
    assert [r.row_count for r in sorted(got, key=lambda r: r.path) if r.filetype == "txt"] == [len(t.lstrip("\ufeff").splitlines()) for t in texts]


def test_files(spark, tmp_path):
    rows = [["姓名", "編號"], ["王", "00,1\n2"], ["李", "x"]]
    (tmp_path / "a.csv").write_bytes(files.write_csv(rows))
    (tmp_path / "b.csv").write_bytes("姓名,編號\r\n王,1\r\n".encode("big5"))
    (tmp_path / "c.xlsx").write_bytes(files.write_xlsx("表", rows))
    (tmp_path / "d.txt").write_bytes(b"\xff\xff")
    (tmp_path / "e.pdf").write_bytes(b"x")
    (tmp_path / "f.csv").write_text("a\n1,2\n")
    (tmp_path / "g.xlsx").write_bytes(b"no zip")
    got = {}
    for r in files.read_files(spark, str(tmp_path)).orderBy("path", "row").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert [list(r.cells) for r in got["a.csv"]] == rows and got["b.csv"][0].encoding == "big5"
    assert [list(r.cells) for r in got["c.xlsx"]] == rows and got["c.xlsx"][0].title == "表" and got["g.xlsx"][0].error == "XLSX"
    assert got["d.txt"][0].error == "DECODE" and got["e.pdf"][0].error == "UNSUPPORTED_TYPE" and got["f.csv"][0].error == "ROW_TOO_LONG 2"
    name, body = files.bundle([("a.txt", base64.b64encode(b"hi").decode())])
    assert zipfile.ZipFile(io.BytesIO(body)).read("a.txt") == b"hi"
    with pytest.raises(files.FileError):
        files.bundle([("a.txt", "***")])
    (tmp_path / "allow").write_text("# no\n\n term \n")
    assert files.read_allow_list(spark, str(tmp_path / "allow")) == ["term"] and files.read_allow_list(spark, str(tmp_path / "none")) == []


def test_names(spark):
    df = spark.createDataFrame([(0, "../../evil.txt"), (1, "report.csv"), (2, "x\\report.csv"), (3, "report.csv"), (4, "report (2).csv"), (5, "..")], "i int, name string")
    assert [r.entry for r in distinct_names(df, "name", "i").orderBy("i").collect()] == ["evil.txt", "report.csv", "report (3).csv", "report (4).csv", "report (2).csv", "file"]
    assert spark.range(1).select(output_name(F.lit("手機0912345678.TXT")).alias("n")).first().n == "手機091xxxx678.scrubbed.txt"


def test_stream(spark, tmp_path):
    _df(spark).write.parquet(str(tmp_path / "in"))
    q = scrub_stream(spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("masked").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.id: r.scrubbed for r in spark.table("masked").collect()}[2] == "另一位F2******18"


def test_texts_of_findings_go_through_detection_once(spark, tmp_path):
    spark.createDataFrame([(k, f"手機09{k:08d}" if k % 2 else "無1") for k in range(9)], "id long, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).repartition(3)
    calls = lambda x: x._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")
    out = detect_findings(df, ["id"])
    assert calls(out) == calls(entity_counts(df)) == calls(scrub_table(df, {"text": "ner"}, "id")[1]) == 1
    assert sorted((r.id, r.finding) for r in out.collect()) == [(k, 0) for k in range(1, 9, 2)]
    from veilspark.operators.scrub import _values

    assert calls(_values(scrub(df), "id", [])) == 1 and mapping(scrub(df), "id").count() == 4


def test_integer_orders_are_numbered_without_sorting_all_findings(spark):
    from veilspark.operators.scrub import _values

    keys = [0, None, 2**63 - 1, -1, -(2**63), 7, 7]
    rows = [(o, f"手機09{k:08d}與09{10 + k // 2:08d}") for k, o in enumerate(keys)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    seen = scrub(df)
    assert "SortAggregate" not in _values(seen, "id", []).groupBy("tag", "value").agg(F.min("_first"))._jdf.queryExecution().executedPlan().toString()
    want: dict = {}
    # of the two rows of equal order, the values at the same place are numbered by value
    both = ["0900000005", "0900000006", "0900000012", "0900000013"]
    for values in ([f"09{k:08d}", f"09{10 + k // 2:08d}"] if k < 5 else both for k in (1, 4, 3, 0, 5, 2)):
        for v in values:
            want.setdefault(v, f"<MOBILE_{len(want) + 1}>")
    by_number = {r.value: r.placeholder for r in mapping(seen, "id").collect()}
    assert by_number == want == {r.value: r.placeholder for r in mapping(scrub(df.withColumn("id", F.col("id").cast("decimal(20,0)"))), "id").collect()}

def test_restore_shuffles_no_columns_with_its_parts(spark):
    out, ids = scrubbed_with_mapping(_df(spark), mode="placeholder", order="id")
    assert sorted(map(tuple, ids.collect())) == sorted(map(tuple, mapping(out, "id").collect()))
    kept = out.where("scrubbed is not null").select("id", "scrubbed", F.create_map(F.lit("k"), F.col("id")).alias("more"))
    back = restore(kept, "scrubbed", ids)
    assert back.columns == ["id", "scrubbed", "more", "restored"]
    assert {r.id: (r.more, r.restored) for r in back.collect()} == {k: ({"k": k}, t.replace("\n", "")) for k, t in enumerate(TEXTS) if t is not None}


def test_placeholders_are_put_in_without_masks(spark):
    df = spark.createDataFrame([(0, "手機0912\n345678與K182504372"), (1, None), (2, "無"), (3, "電話02-27200001,K18250\n4372"), (4, "x" * 60)], "id int, text string")
    out = scrub(df, mode="placeholder", order="id", max_chars=50, on_long="quarantine")
    # shuffles carry places only: no values, masks or names of rules
    assert "findings" not in out.select("id", "scrubbed")._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    rows, masked = ({r.id: r for r in x.collect()} for x in (out, scrub(df, max_chars=50, on_long="quarantine")))
    assert [rows[k].scrubbed for k in range(5)] == ["手機<MOBILE_1>與<TW_ID_1>", None, "無", "電話<PHONE_1>,<TW_ID_1>", None]
    for k in range(5):
        same = lambda r: [(f.entity_type, f.start, f.end, f.score, f.recognizer, f.value, f.original_masked) for f in r.findings]
        assert same(rows[k]) == same(masked[k]) and rows[k].error == masked[k].error and rows[k].stats == masked[k].stats
        assert all(rows[k].scrubbed[f.scrubbed_start : f.scrubbed_end] == f.replacement for f in rows[k].findings)


def test_mapping_of_texts_makes_no_masked_texts(spark):
    from veilspark.operators.scrub import text_mapping

    df = spark.createDataFrame([(2, "手機0912\n345678與K182504372"), (1, None), (0, "無"), (3, "電話02-27200001,0912345678")], "id int, text string")
    got = text_mapping(df, "text", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mapping(scrub(df), "id").collect())) == [("MOBILE", "0912345678", "<MOBILE_1>"), ("PHONE", "02-27200001", "<PHONE_1>"), ("TW_ID", "K182504372", "<TW_ID_1>")]
    assert "scrubbed" not in got._jdf.queryExecution().optimizedPlan().toString() and mapping(scrub(df), "id").columns == got.columns
