"""Review by hand, binary workbooks, sinks."""

from __future__ import annotations

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import match as m
from tallyloom.operators import review as r
from tallyloom.sources import read, write
from tallyloom.sources.xlsb import rk_number


def test_presets(spark, tmp_path):
    p = r.Presets(str(tmp_path / "p.json"))
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "y")], "region string, brand string")
    p.save("one", {"region": ["a"], "brand": [], "gone": ["z"]})
    p.save("two", {"brand": ["y"]})
    assert p.names() == ["one", "two"] and p.apply(df, "one").count() == 1 and p.apply(df, "two").count() == 2 and p.apply(df, "none").count() == 3
    p.delete("one")
    assert p.names() == ["two"]


def test_small_operators(spark):
    df = spark.createDataFrame([(1, "x"), (2, " "), (3, None), (4, "nan")], "id int, target_category string")
    assert {x.id for x in r.uncategorised(df).collect()} == {2, 3, 4}
    assert [x.id for x in r.preview(df, 2, ["id"]).collect()] == [1, 2] and r.preview(df.limit(0)).count() == 0
    t = spark.createDataFrame([("a", "old", 0.5), ("b", "keep", 0.5), (None, "n", 0.1)], "key string, target_category string, category_confidence double")
    new = spark.createDataFrame([("a", "new", 1.0), ("c", "more", 1.0)], t.schema)
    assert {tuple(x) for x in r.upserted(t, new).collect()} == {("a", "new", 1.0), ("b", "keep", 0.5), (None, "n", 0.1), ("c", "more", 1.0)}
    assert r.merged_patch({"a": [1, 2], "d": {"x": 1, "l": [1]}, "k": 1}, {"a": [2, 3, 3], "d": {"y": 2, "l": [2]}, "k": 5, "n": []}) == {"a": [1, 2, 3], "d": {"x": 1, "l": [1, 2], "y": 2}, "k": 5, "n": []}


def test_review_queue(spark):
    s = spark.createDataFrame([("a", "b", 0.9, "review"), ("b", "a", 0.9, "review"), ("c", "d", 0.95, "review"), ("e", "f", 0.99, "match"), ("g", "h", 0.97, "review")], "a string, b string, score double, prediction string")
    done = spark.createDataFrame([("d", "c", "match")], "a string, b string, verdict string")
    q = r.review_queue(s, done).collect()
    assert [x.score for x in q] == [0.97, 0.9]
    log = spark.createDataFrame([("Match", "match"), ("match", "non-match"), ("match", "match "), ("review", None)], "suggested string, verdict string")
    assert {(x.suggested, x.verdict, x.n) for x in r.override_rates(log).collect()} == {("match", "match", 2), ("match", "non-match", 1)}


def test_names_of_several_tables(spark):
    one = spark.createDataFrame([(1, "Гель", "A"), (2, "Мыло", "B")], "id int, item_name string, brand string")
    two = spark.createDataFrame([(1, "Гель "), (2, "Чай"), (3, None)], "id int, item_name string")
    got = {x.name: (x.freq, x.brand) for x in m.names_of_all([one, two, one.drop("item_name")], "id").collect()}
    assert got == {"Гель": (2, "A"), "Мыло": (1, "B"), "Чай": (1, "")}
    with pytest.raises(ValueError):
        m.names_of_all([one.drop("item_name")], "id")


def record(kind: int, body: bytes) -> bytes:
    def digits(n):
        out = bytearray()
        while True:
            n, d = n >> 7, n & 0x7F
            out.append(d | (0x80 if n else 0))
            if not n:
                return bytes(out)

    return digits(kind) + digits(len(body)) + body


def text(s: str) -> bytes:
    return struct.pack("<I", len(s)) + s.encode("utf-16-le")


def binary_workbook(path, shared, rows):
    cell = lambda at: struct.pack("<II", at, 0)
    sheet = b""
    for k, row in enumerate(rows):
        sheet += record(0, struct.pack("<I", k) + bytes(13))
        for at, v in enumerate(row):
            if v is None:
                continue
            if isinstance(v, str):
                sheet += record(7, cell(at) + struct.pack("<I", shared.index(v))) if v in shared else record(6, cell(at) + text(v))
            elif isinstance(v, int):
                sheet += record(2, cell(at) + struct.pack("<i", v << 2 | 2))
            else:
                sheet += record(5, cell(at) + struct.pack("<d", v))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.bin", b"")
        z.writestr("xl/sharedStrings.bin", b"".join(record(19, b"\0" + text(s)) for s in shared))
        z.writestr("xl/worksheets/sheet1.bin", record(129, b"") + record(147, b"x" * 300) + sheet + record(130, b""))


def test_binary_workbook(spark, tmp_path):
    path = str(tmp_path / "a.xlsb")
    binary_workbook(path, ["Магазин", "Заря"], [["Магазин", "Кол-во", "Выручка"], ["Заря", 5, 10.25], [None, -3, "нет"], ["Маяк", None, 2.0]])
    df = read.read_table(spark, path)
    assert df.columns == ["Магазин", "Кол-во", "Выручка"]
    assert [tuple(x) for x in df.collect()] == [("Заря", "5", "10.25"), (None, "-3", "нет"), ("Маяк", None, "2")]
    assert rk_number(struct.unpack("<I", struct.pack("<i", 1234 << 2 | 3))[0]) == 12.34 and rk_number(0x3FF00000) == 1.0


def test_codes_keep_their_zeros(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Код,Штриховой код,Кол-во\n007,0460,5\n010,,6\n", encoding="utf-8")
    assert [tuple(x) for x in read.read_table(spark, str(tmp_path / "a.csv")).orderBy("Кол-во").collect()] == [("007", "0460", 5), ("010", None, 6)]


def test_csv_from_several_parts(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") % 2 == 0, 'a "q", b').alias("t"))
    write.save_csv(df, str(tmp_path / "r.csv"))
    import csv

    rows = list(csv.reader((tmp_path / "r.csv").read_text(encoding="utf-8-sig").splitlines()))
    assert rows[0] == ["id", "t"] and [int(x[0]) for x in rows[1:]] == list(range(1000)) and rows[1][1] == 'a "q", b' and rows[2][1] == ""
    assert [p.name for p in tmp_path.iterdir() if "crc" not in p.name] == ["r.csv"]


def test_newest_first(tmp_path):
    for n in ("merged_202101010000.parquet", "merged_202201010000.csv", "other.csv"):
        (tmp_path / n).write_text("")
    assert [p.rsplit("/", 1)[1] for p in read.newest_first(str(tmp_path))] == ["merged_202201010000.csv", "merged_202101010000.parquet"]
