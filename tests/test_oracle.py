"""Every catalogue query against its DuckDB oracle (the driver's correctness gate, on sf0.001)."""
import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))

from sward.plans import catalog
import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, SF_SMALL, name, E.queries()[name], E.oracle_sql()[name], con, verbose=True)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["id", "plot", "block"]
    assert df.count() > 0


def test_wide_keys_stay_apart(spark, tmp_path):
    """Plots whose keys have more than five digits are not merged (oracle: numeric keys, printf padding)."""
    from pyspark.sql import functions as F
    d = str(tmp_path)
    wide = {1: 10000, 2: 100000, 3: 100009, 4: 1}
    for t in ("region", "nation", "part", "orders", "customer"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    remap = F.create_map(*[F.lit(x) for kv in wide.items() for x in kv])
    s = spark.read.parquet(f"{SF_SMALL}/supplier.parquet").where(F.col("s_suppkey").isin(list(wide)))
    s.withColumn("s_suppkey", remap[F.col("s_suppkey").cast("int")].cast("long")).write.parquet(f"{d}/supplier.parquet")
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").where(F.col("l_suppkey").isin(list(wide)))
    li.withColumn("l_suppkey", remap[F.col("l_suppkey").cast("int")].cast("long")).write.parquet(f"{d}/lineitem.parquet")
    q = catalog.queries()
    assert {r["plot"] for r in q["change_type"](spark, d).collect()} == {"10000", "100000", "100009", "00001"}
    assert sorted(r["plot"] for r in q["first_visit"](spark, d).collect()) == ["00001", "10000", "100000", "100009"]
    st = q["site_table"](spark, d)
    assert st.select("id").distinct().count() == st.count()
    assert {r["plot"] for r in q["visit_key_codec"](spark, d).select("plot").distinct().collect()} == \
        {"10000", "100000", "100009", "00001"}
