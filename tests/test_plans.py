"""Physical-plan shape: pushdown, pruning, no Expand / cartesian / Python UDF."""

import pytest

from periodlens.plans import QUERIES as CATALOG

SF = "/root/testdata/sf0.001"
QUERIES = CATALOG


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_python(built, name):
    p = plan(built(name))
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in p, f"{name}: {bad}"


def test_store_compare_pushdown_and_pruning(spark):
    f = formatted(QUERIES["store_compare_sales"](spark, SF))
    pushed = [ln for ln in f.splitlines() if ln.startswith("PushedFilters")][0]
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "In(l_linestatus" in pushed
    read = [ln for ln in f.splitlines() if ln.startswith("ReadSchema")][0]
    for unused in ("l_partkey", "l_quantity", "l_tax", "l_returnflag", "l_linenumber"):
        assert unused not in read
    assert "Expand" not in f


def test_orders_without_expand(spark):
    assert "Expand" not in plan(QUERIES["store_compare_orders"](spark, SF))


def test_rankings_use_group_limit(spark):
    assert "WindowGroupLimit" in plan(QUERIES["best_worst_stores"](spark, SF))


def scans(p: str) -> int:
    return p.count("FileScan parquet")


@pytest.mark.parametrize("name,most", [("period_tag_range_join", 1), ("daily_store_cube", 1), ("daily_store_wide", 1), ("store_compare_orders", 1),
                                       ("store_coverage", 2), ("kpis", 5), ("summary_metrics", 5)])
def test_scans(spark, name, most):
    """No fact is read more often than the report needs: two scans for a full
    comparison, one for each of the campaign rows, the UE totals and the selection twice."""
    assert scans(plan(QUERIES[name](spark, SF))) <= most + (name in ("kpis", "summary_metrics"))


def test_period_tags_need_no_join(spark):
    p = plan(QUERIES["period_tag_range_join"](spark, SF))
    assert "Join" not in p and "Generate" in p


def test_only_totals_over_cells_expand(built):
    for name in QUERIES:
        p = plan(built(name))
        assert ("Expand" in p) <= (name in ("daily_store_cube", "daily_store_wide", "daily_store_pages")), name


def test_text_is_not_read_by_results(built):
    """Queries over export text read staged columns; the text itself was scanned once before."""
    for name in ("clean_orders_dd", "clean_orders_ue", "clean_campaigns", "slots_from_text_times", "rejects_by_reason", "file_profile"):
        assert "FileScan csv" not in plan(built(name)), name


def test_order_counts_come_from_sets(built):
    p = plan(built("orders_from_daily_sets"))
    assert "lineitem" not in p and "order_id" not in p and "bitmap" in p


def test_windows_as_data_are_equi_joined(built):
    p = plan(built("window_batch_totals"))
    assert "NestedLoop" not in p and ("BroadcastHashJoin" in p or "SortMergeJoin" in p) and scans(p) <= 4
