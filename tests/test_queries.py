"""Every query against its SQL in an independent engine, row by row."""

import math

import duckdb
import pytest

from lodestone.functions.batches import spread
from lodestone.operators import catalogue, symbols
from lodestone.plans import queries  # noqa: F401  registers its queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _value(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(_value(r[c]) for c in columns) for r in df.collect())
    if name in catalogue.ORACLE_SQL:
        out = sql.sql(catalogue.ORACLE_SQL[name])
        assert sorted(out.columns) == columns
        at = [out.columns.index(c) for c in columns]
        assert got == sorted(tuple(_value(r[i]) for i in at) for r in out.fetchall())
    else:
        assert got


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["filter_repo_language"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "EqualTo(source,src3)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_top_k_is_no_full_sort(spark):
    plan = catalogue.QUERIES["dense_topk_filtered"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(label,3)" in plan


def test_source_files_are_parsed_once_and_by_all_cores(spark, sql, monkeypatch):
    given, parsed, extract, extracted = [], spark.sparkContext.accumulator(0), symbols.extract, symbols.extracted

    def counted(*args):
        parsed.add(1)
        return extract(*args)

    monkeypatch.setattr(symbols, "extract", counted)
    monkeypatch.setattr(symbols, "extracted", lambda files: given.append(files) or extracted(files))
    out = catalogue.QUERIES["symbol_purge"](spark, DATA)
    files, again = sql.sql("SELECT count(*), count(*) FILTER (p_partkey % 12 = 0) FROM part").fetchall()[0]
    assert parsed.value == files + again  # files that have new symbols take a second time
    assert out.count() == sql.sql(f"SELECT count(*) FROM ({catalogue.ORACLE_SQL['symbol_purge']})").fetchall()[0][0]
    catalogue.QUERIES["symbol_extract"](spark, DATA)
    assert [f.rdd.getNumPartitions() for f in given] == [spark.sparkContext.defaultParallelism] * 3


def test_small_rows_are_dealt_by_their_number(spark):
    rows = spark.range(0, 1000, 1, 1)
    dealt = spread(rows, "id", most=100)
    assert dealt.rdd.getNumPartitions() == 10 and sorted(r[0] for r in dealt.collect()) == list(range(1000))
    assert spread(rows.where("id < 0"), "id").count() == 0
