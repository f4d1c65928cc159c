"""Every query against its SQL on DuckDB, and the rows of those without."""

import math
import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackroom.queries import catalog, files, pages, search, sources, text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CASES = [(m, n) for m in (search, text, sources, pages, files, catalog) for n in m.QUERIES]
#: Without rows at the smallest size.
EMPTY = {"repeated_hash_filter"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        x = x.item() if hasattr(x, "item") else x
        return (None if math.isnan(x) else round(x, 6)) if isinstance(x, float) else x

    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query(spark, duck, module, name):
    df = module.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got or name in module.ORACLE
    if name in module.ORACLE:
        result = duck.execute(module.ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns) and rows(got, df.columns) == rows(result.fetchall(), names)


def test_entry_lists_all(spark):
    import __spark_entry__ as e

    assert len(e.queries()) >= len(CASES) and e.oracle_sql().keys() <= e.queries().keys() and e.entry(spark).count() > 0


def test_nothing_else_needs_the_removable_parts():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "stackroom")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, n)) as f:
                    assert "stackroom.llm" not in f.read()


def test_filters_reach_the_scan(spark):
    plan = catalog.inner_equi_join(spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan and "o_totalprice" not in plan.split("Physical Plan")[1]


def test_batches_for_python_are_bounded_by_bytes(spark):
    from stackroom.session import BATCH_BYTES

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("long "), 2000).alias("text")).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == 3000
    assert len(rows) > 3
    assert max(r.size for r in rows) < 2 * BATCH_BYTES
