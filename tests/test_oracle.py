"""Every query with a SQL twin, compared over the whole small tables."""

from __future__ import annotations

import json
import os

import oracle
import pytest

from tallyloom.plans import problems, reference
from tallyloom.sources.colmap import look, map_headers

FOLDER = f"{oracle.DATA}/sf0.001"
SQL = problems.ORACLE | reference.ORACLE
QUERIES = problems.QUERIES | reference.QUERIES
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    oracle.compare(spark, name, QUERIES[name], SQL[name], FOLDER)


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(SQL) == {"p4_found", "p4_unified", "p4_promotions", "p5_found"}


def raw_files(spark):
    """feed -> files in order, each as file_id and header -> filled values."""
    feeds, rows = {}, spark.read.parquet(f"{FOLDER}/raw_extracts.parquet").orderBy("received_at", "file_id").collect()
    for r in rows:
        files = feeds.setdefault(r.feed, {}).setdefault(r.file_id, {})
        try:
            payload = json.loads(r.payload or "")
        except ValueError:
            continue
        for k, v in payload.items() if isinstance(payload, dict) else ():
            files.setdefault(k, []).extend([v] if v is not None and str(v).strip() else [])
    return feeds, rows


def test_schema_changes_by_plain_python(spark):
    feeds, _ = raw_files(spark)
    want = set()

    def kind(values):
        numbers, texts = (sum(isinstance(v, t) for v in values) for t in ((int, float), str))
        return None if numbers == texts else numbers > texts

    for files in feeds.values():
        before = None
        for file_id, headers in files.items():
            now = {f: (look(h), kind(headers[h])) for h, f in map_headers(sorted(headers)).items()}
            if before is not None:
                want |= {(file_id, f, "added") for f in now.keys() - before.keys()} | {(file_id, f, "removed") for f in before.keys() - now.keys()}
                for f in now.keys() & before.keys():
                    want |= {(file_id, f, "renamed")} if now[f][0] != before[f][0] else set()
                    want |= {(file_id, f, "retyped")} if None not in (now[f][1], before[f][1]) and now[f][1] != before[f][1] else set()
            before = now
    assert {tuple(r) for r in QUERIES["p4_found"](spark, FOLDER).collect()} == want and len(want) > 5


def test_unified_lines_by_plain_python(spark):
    feeds, rows = raw_files(spark)
    headers = {i: {f: h for h, f in map_headers(sorted(hs)).items()} for files in feeds.values() for i, hs in files.items()}
    got = {r.raw_id: r for r in QUERIES["p4_unified"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for r in rows:
        try:
            payload = json.loads(r.payload or "")
        except ValueError:
            payload = {}
        for f in ("store_name", "region", "category_0", "item_name"):
            v = payload.get(headers[r.file_id].get(f)) if isinstance(payload, dict) else None
            assert got[r.raw_id][f] == (v if v is None else str(v))  # a number in a field of texts is kept as its text


def test_promotions_end_at_the_types_of_the_feeds(spark):
    rows = QUERIES["p4_promotions"](spark, FOLDER).collect()
    height = {t: k for k, t in enumerate(("void", "boolean", "bigint", "double", "date", "timestamp", "string"))}
    assert all(height[r.before] < height[r.after] for r in rows)


def test_contents_of_all_listings(spark):
    rows = QUERIES["p5_found"](spark, FOLDER).collect()
    n = spark.read.parquet(f"{FOLDER}/listings.parquet").select("listing_id").distinct().count()
    assert len({r.listing_id for r in rows}) == len(rows) and 0.9 * n <= len(rows) <= n
    assert {r.base_unit for r in rows} == {"ml", "g", "pcs"} and all(0 < r.amount < 100_000 for r in rows)
