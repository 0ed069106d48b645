"""Plans that must not lose their shape."""

import re

import pytest

from framewise.plans import catalog


def nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {n: len(re.findall(rf"\b{n}\b", plan)) for n in ("Exchange", "Sort", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")}, plan


@pytest.mark.parametrize("name", ["w1_previous_result", "w2_committed_state", "w3_suspicious", "st1_replayed", "st7_switches", "sk9_switch_commands"])
def test_live_state_is_shuffled_and_sorted_once(spark, sf, name):
    found, _ = nodes(catalog.QUERIES[name](spark, sf))
    assert (found["Exchange"], found["Sort"]) == (1, 1)


@pytest.mark.parametrize("name", ["a1_mean_by_group", "a2_pivot_classified", "p8_time_range", "j8_rectangle_matches", "p22_p25_reply_verdict", "o1_sort_keys"])
def test_no_python_and_no_nested_loops_over_data(spark, sf, name):
    found, _ = nodes(catalog.QUERIES[name](spark, sf))
    assert not found["CartesianProduct"] and not found["BatchEvalPython"] and not found["ArrowEvalPython"]


def test_only_needed_columns_are_read(spark, sf):
    _, plan = nodes(catalog.QUERIES["a4_summary"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "text" not in plan


def test_near_pairs_are_an_equi_join(spark, sf):
    from framewise.operators import dedupe
    from framewise.plans import analogues

    found, plan = nodes(dedupe.hash_pairs(analogues.hashes(spark, sf), 10))
    assert "NestedLoop" not in plan and not found["CartesianProduct"]


def test_no_window_over_all_rows(spark, sf):
    """Distinct times are put in order only within a range; what one task sees is the list of ranges."""
    from framewise.operators import evaluate
    from framewise.plans import analogues

    rows = evaluate.judged(analogues.verdicts(spark, sf), analogues.labels(spark, sf))
    for df in (rows, rows.crossJoin(spark.range(10)).drop("id")):
        _, plan = nodes(evaluate.timing(df))
        windows = [line for line in plan.splitlines() if "Window [" in line]
        ordered = [line for line in windows if re.search(r"\[elapsed#\d+ ASC", line.rsplit("AS ", 1)[-1])]
        assert windows and ordered and all(re.search(r"\], \[range#\d+\], \[elapsed", line) for line in ordered)


def test_last_page_is_a_top_k_of_one_page(spark, sf):
    from framewise.operators import catalogue
    from framewise.plans import analogues

    for order in ("asc", "desc"):
        _, plan = nodes(catalogue.paged(analogues.annotated(spark, sf), page=10**6, per_page=50, order=order))
        limits = [int(n) for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)]
        assert limits and max(limits) <= 50 and plan.count("regexp_extract") <= plan.count("HashAggregate") * 8 + 16
