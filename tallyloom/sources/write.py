"""Results -> files. Tables of any size go to Parquet; workbooks and single CSV files are for reports of bounded size."""

from __future__ import annotations

import csv
import io
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.xlsx import write_xlsx

#: Rows that one sheet of a workbook can hold, its header aside.
SHEET_ROWS = 1_048_575


def save(df: DataFrame, folder: str, name: str = "", now: datetime | None = None) -> str:
    """Writes a Parquet table merged_<time> (or ``name``) into the folder and gives its path; an existing one is an error."""
    name = name or f"merged_{(now or datetime.now()):%Y%m%d%H%M}"
    path = f"{folder.rstrip('/')}/{name.removesuffix('.parquet')}.parquet"
    df.write.mode("errorifexists").parquet(path)
    return path


def save_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header and a byte-order mark, in the order of the table.

    Executors write the parts; only their bytes are then put behind each other, through Spark's file systems, so no row passes through the
    driver's memory.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = f"{path}.parts"
    texts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
    texts.write.mode("overwrite").option("lineSep", "\r\n").option("quoteAll", False).option("escape", '"').option("emptyValue", "").csv(parts)
    folder, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (parts, path))
    fs = target.getFileSystem(conf)
    header = io.StringIO()
    csv.writer(header).writerow(df.columns)
    out = fs.create(target, True)
    try:
        out.write(bytearray(header.getvalue().encode("utf-8-sig")))
        for status in sorted((s.getPath().getName(), s.getPath()) for s in fs.listStatus(folder)):
            if status[0].startswith("part-"):
                source = fs.open(status[1])
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                source.close()
    finally:
        out.close()
    fs.delete(folder, True)


def save_workbook(path: str, sheets: dict[str, DataFrame]) -> None:
    """One sheet per named table. A table of more rows than a sheet can hold is an error, never cut."""
    out = {}
    for name, df in sheets.items():
        rows = df.limit(SHEET_ROWS + 1).collect()
        if len(rows) > SHEET_ROWS:
            raise ValueError(f"{name} has more rows than a sheet can hold; save it as Parquet")
        out[name] = (df.columns, [tuple(r) for r in rows])
    write_xlsx(path, out)


def report(df: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report: overview, categories, brands (100), regions, periods, items (200)."""
    from tallyloom.operators import analytics as a

    return {
        "Сводка": a.kpi(df),
        "Категории": a.summary(df, "category_1"),
        "Бренды": a.top(df, "brand", 100),
        "Регионы": a.summary(df, "region"),
        "Динамика": a.as_double(a.sums(df, ["period"], "revenue"), "revenue").orderBy("period"),
        "Топ товаров": a.top(df, "item_name", 200),
    }
