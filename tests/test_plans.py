"""Plans that have to hold at scale: pruned scans, limits before shuffles, no cross joins."""

import re

import pytest

import __spark_entry__ as entry
from bandwright.operators import messages, windows
from bandwright.session import load


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_messages_read_one_column_and_combine_before_the_shuffle(spark, data):
    p = plan(messages.repeated(load(spark, data, "t03_variations")))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", p)) == {"id:string"}
    assert "partial_sum" in p and "Python" not in p


def test_first_row_is_limited_before_the_shuffle(spark, data):
    p = plan(messages.accept(load(spark, data, "t03_variations").select("id", "ts", "batch_id"))[0])
    assert p.count("WindowGroupLimit") == 4 and "Partial" in p  # numbered and malformed identifiers
    q = plan(windows.last_wins(load(spark, data, "t04a_judgments_b1"), ["id"], "ts").select("id", "conf"))
    assert "WindowGroupLimit" in q and "issue" not in q


def test_rows_are_accepted_by_the_ranges(spark, data):
    rows = load(spark, data, "t03_variations").select("id", "ts", "batch_id")
    p = plan(messages.accept(rows)[0])
    assert "last(__hi" in p and "lead(pos" in p  # the running end of the ranges, which the sums over moves give
    assert messages.copies(messages.accept(rows, messages.copies(rows))[0]).isEmpty()


def test_filters_reach_the_scan(spark, data):
    p = plan(load(spark, data, "t05_final").filter("axis = 'P1'").select("id"))
    assert "PushedFilters: [IsNotNull(axis), EqualTo(axis,P1)]" in p and "ReadSchema: struct<id:string,axis:string>" in p


def windows_of(p: str) -> list[str]:
    """What the windows of a plan are partitioned by."""
    return re.findall(r"windowspecdefinition\(([^,\]]*)", p)


SCORED = ["io_overall", "io_per_axis", "io_per_domain", "similarity_ecdf", "ks_slope_cliff", "axis_similarity_stats", "quantile_grid", "danger_zone", "surface_step", "encoder_io"]


@pytest.mark.parametrize("name", SCORED)
def test_no_window_over_a_key_and_no_buffered_percentile(spark, data, name):
    """Running sums are within ranges, so a window's groups are as many as the tasks of a sort, also where all rows have one key."""
    p = plan(entry.queries()[name](spark, data))
    assert "percentile(" not in p and "CartesianProduct" not in p
    over = [w for w in windows_of(p) if "__range" not in w and "_w" not in w]
    assert not over or name == "danger_zone", over  # without a key the offsets of the ranges, one row each, are in one window


def test_the_bootstrap_sums_before_it_shuffles(spark, data):
    from bandwright.operators import bootstrap

    p = plan(bootstrap.replicates(spark.createDataFrame([("s", 1)], "k string, n int"), "k", ["n"], 50))
    between = p[p.index("partial_sum") : p.index("Generate inline")]  # a plan is read from below: the sums stand on the draws
    assert "Exchange" not in between and "Join" not in p and "Window" not in p


def test_similar_sets_leave_no_pairs(spark, data):
    """What leaves the comparing tasks is one row per row, summed and shuffled by id."""
    from bandwright.operators import dedupe

    reps = spark.createDataFrame([("a", "some text of a row", 1), ("b", "some text of a rox", 2)], "id string, text string, w bigint")
    posted, shared = dedupe.postings(reps, 0.5)
    p = plan(dedupe._open(posted, shared, 0.5))
    assert "MapInArrow" in p and "partial_min" in p and "Join" not in p


RELATIONAL = [n for m in entry._modules() if m.__name__.endswith(("relational", "agreement", "messages")) for n in m.QUERIES]


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_nested_loops(spark, data, name):
    """Cross products are only with tables of one or nine rows: the taxonomy and scalars."""
    p = plan(entry.queries()[name](spark, data))
    assert "CartesianProduct" not in p and ("BroadcastNestedLoopJoin" not in p or name == "contract_deviation")


def test_no_row_at_a_time_python(spark, data):
    for name in RELATIONAL:
        assert "BatchEvalPython" not in plan(entry.queries()[name](spark, data)), name
