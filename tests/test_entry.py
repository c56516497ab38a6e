"""The driver's entry points, and plans that hold at scale."""

import contextlib
import io

import __spark_entry__
from tidemark import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["series_id", "h", "mse", "mae", "r2", "r2bar", "smape", "m"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_scans_read_only_what_they_need(spark):
    text = plan(queries.QUERIES["lag_matrix"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text and "PushedFilters: [IsNotNull(ts)]" in text


def test_a_design_matrix_is_one_shuffle_and_one_sort_of_the_series(spark):
    text = plan(queries.QUERIES["symb_design"](spark, SF))
    tree = text.split("\n\n")[0]
    # one shuffle for the buckets, one for the series; the first window's sort by ts, the second's by t
    assert tree.count("Exchange (") == 2 and tree.count("Sort (") == 2
    assert "Python" not in tree and "Pandas" not in tree and "Arrow" not in tree


def test_a_model_is_one_pass_over_its_series(spark):
    for name in ("arx_recursive", "roll_sliding", "symb_recursive_metrics"):
        tree = plan(queries.QUERIES[name](spark, SF)).split("\n\n")[0]
        # the fit is the only Python there is, and the series are scanned, shuffled and sorted for it once
        assert tree.count("InArrow") == 1 and tree.count("Scan parquet") == 1 and "Join" not in tree
