"""Readers, writers, settings and the command stream."""

from __future__ import annotations

import pytest

from tallyloom.operators.consolidate import canonical, merged
from tallyloom.sources import read, write
from tallyloom.sources.xlsx import column_number, write_xlsx
from tallyloom.streaming.commands import file_messages, kept_running, run_on_commands


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1251"])
@pytest.mark.parametrize("sep", [";", ","])
def test_csv(spark, tmp_path, encoding, sep):
    (tmp_path / "a.csv").write_text(f"Магазин{sep}Кол-во\nТТ 1{sep}5\nТТ 2{sep}7\n", encoding=encoding)
    df = read.read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Магазин", "Кол-во"] and [tuple(r) for r in df.orderBy("Кол-во").collect()] == [("ТТ 1", 5), ("ТТ 2", 7)]


@pytest.mark.parametrize("suffix", ["csv", "tsv"])
@pytest.mark.parametrize("encoding", ["utf-8", "cp1251"])
def test_encoding_told_behind_the_head(spark, tmp_path, encoding, suffix):
    sep = "\t" if suffix == "tsv" else ","
    rows = [f"soap {k}{sep}{k}" for k in range(600)] + [f"Мыло жидкое{sep}600", f"Мыло детское{sep}601"]
    (tmp_path / f"a.{suffix}").write_text("\n".join([f"name{sep}n", *rows]) + "\n", encoding=encoding)
    assert next(k for k, c in enumerate((tmp_path / f"a.{suffix}").read_bytes()) if c > 127) > read.HEAD
    for df in (read.read_table(spark, str(tmp_path / f"a.{suffix}")), read.read_folder(spark, str(tmp_path))[0][0][1]):
        assert [r.name for r in df.filter("n >= 600").orderBy("n").collect()] == ["Мыло жидкое", "Мыло детское"] and df.count() == 602


def test_bytes_without_meaning_behind_the_head(spark, tmp_path):
    body = b"name,n\n" + b"".join(b"soap %d,%d\n" % (k, k) for k in range(600))
    for end, want in ((b"caf\xe9 \x98,600\n", "café \x98"), (b"\xd1\x8b\xd1,600\n", "С‹С")):  # not in the code page; not UTF-8
        (tmp_path / "a.csv").write_bytes(body + end)
        assert read.read_table(spark, str(tmp_path / "a.csv")).filter("n = 600").first().name == want
    (tmp_path / "a.csv").write_bytes(b"name,n\nx,1\ny,\xd1")  # a character cut off at the end is not UTF-8
    assert read.encoding_of(spark, str(tmp_path / "a.csv")) == "windows-1251"


def test_tsv_parquet_unknown(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("a\tb\n1\tx\n")
    assert read.read_table(spark, str(tmp_path / "a.tsv")).count() == 1
    path = write.save(spark.range(3).toDF("a"), str(tmp_path), "out")
    assert read.read_table(spark, path).count() == 3
    with pytest.raises(Exception, match="already exists"):
        write.save(spark.range(3).toDF("a"), str(tmp_path), "out")
    with pytest.raises(ValueError):
        read.read_table(spark, "x.doc")


def test_xlsx_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    write_xlsx(path, {"Лист": (["Название", "n"], [("a & <b>", 1), (None, 2.5), ("", None)])})
    df = read.read_table(spark, path)
    assert df.columns == ["Название", "n"] and [tuple(r) for r in df.collect()] == [("a & <b>", "1"), (None, "2.5"), ("", None)]
    assert [column_number(c) for c in ("A1", "Z9", "AA3")] == [0, 25, 26]
    assert read.read_bytes(spark, "a.xlsx", (tmp_path / "a.xlsx").read_bytes()).count() == 3
    assert read.read_bytes(spark, "a.csv", b"a;b\n1;\xff\n").count() == 1


def test_broken_files_do_not_end_a_run(spark, tmp_path):
    (tmp_path / "b.xlsx").write_text("no workbook")
    (tmp_path / "a.csv").write_text("Магазин;Кол-во\nx;1\n")
    (tmp_path / "c.txt").write_text("no source")
    tables, failed = read.read_folder(spark, str(tmp_path))
    assert [n for n, _ in tables] == ["a.csv"] and list(failed) == [str(tmp_path / "b.xlsx")]
    moved = read.archive([str(tmp_path / "a.csv")], str(tmp_path / "done"))
    (tmp_path / "a.csv").write_text("x")
    assert moved[str(tmp_path / "a.csv")].endswith("a.csv") and read.archive([str(tmp_path / "a.csv")], str(tmp_path / "done"))[str(tmp_path / "a.csv")].endswith("a_1.csv")


def test_merge(spark):
    a = canonical(spark.createDataFrame([("x", "5", 1.0, "n")], "`Магазин` string, `Кол-во` string, `Выручка` double, `Примечание` string"))
    b = canonical(spark.createDataFrame([("x", 3, 2.0), (None, 1, 1.0)], "`Название точки` string, qty_sold int, sales_rub double"))
    assert merged([a, b]).columns == ["store_name", "qty_sold", "sales_rub"]
    got = {r.store_name: (r.qty_sold, r.sales_rub) for r in merged([a, b], aggregate=True).collect()}
    assert got == {"x": (8.0, 3.0), None: (1.0, 1.0)}
    with pytest.raises(ValueError):
        merged([])


def test_workbook_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("ж", 1)], "a string, b int")
    write.save_workbook(str(tmp_path / "r.xlsx"), {"Сводка": df, "Ещё": df})
    write.save_csv(df, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes() == "﻿a,b\r\nж,1\r\n".encode()


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert read.Settings.load(path) == read.Settings()
    read.Settings(anonymize=True).save(path)
    assert read.Settings.load(path).anonymize and read.read_json(str(tmp_path / "none"), 5) == 5
    assert read.migrated_mappings({"manufacturers": {"a": "1"}, "suppliers": {"b": "2"}})["companies"] == {"a": "1", "b": "2"}


def test_command_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("/merge\nhello\n /merge \n")
    runs, told = [], []

    def publish(text):
        told.append(text)
        raise OSError("broker away")

    for _ in range(2):  # the second run finds nothing new
        q = run_on_commands(file_messages(spark, str(tmp_path / "in")), lambda s: runs.append(1) or "out", publish, str(tmp_path / "cp"), once=True)
        q.awaitTermination(60)
    assert len(runs) == 2 and told == ["✅ Готово: out"] * 2


def test_repeated_batch_skips_finished_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("/merge\n/merge\n/merge\n")
    tried, told = [], []

    def run(_):
        tried.append(1)
        if len(tried) == 2:
            raise OSError("disk full")
        return f"out {len(tried)}"

    def once():
        q = run_on_commands(file_messages(spark, str(tmp_path / "in")), run, told.append, str(tmp_path / "cp"), once=True)
        q.awaitTermination(60)

    with pytest.raises(Exception, match="disk full"):
        once()
    once()  # the first command is done, the second and third are not
    assert len(tried) == 4 and told == [f"✅ Готово: out {k}" for k in (1, 3, 4)]
    (tmp_path / "in" / "2.txt").write_text("/merge\n")
    once()  # the next batch counts anew
    assert len(tried) == 5 and [p.name for p in (tmp_path / "cp" / "finished").glob("[0-9]*")] == ["1-0"]


def test_streams_are_started_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("/merge\n")
    tried = []

    def run(_):
        tried.append(1)
        if len(tried) < 3:
            raise OSError("broker away")
        return "out"

    start = lambda: run_on_commands(file_messages(spark, str(tmp_path / "in")), run, lambda _: None, str(tmp_path / "cp"), once=True)
    assert kept_running(start, wait=0.01) == 2 and len(tried) == 3

    def never():
        raise OSError("no broker")

    with pytest.raises(OSError):
        kept_running(never, wait=0.01, attempts=2)
