"""Plans that must stay what they are: no Python, no products of tables, pruned scans, top-n without full sorts."""

import re

import pytest

from rangeloom.plans import queries as catalog

SF = "/root/testdata/sf0.001"
#: Joins with a table of one row: the largest cell, the head of a queue.
ONE_ROW = {"traffic_intensity", "window_evict_time", "window_evict_size"}
SOME = ["cluster_detect", "cluster_multi_set", "cluster_merge", "cidr_range_report", "clustered_heatmap", "ip_in_ranges", "cidr_subtract", "cidr_cover", "remove_whitelisted", "multi_trie_detect", "parse_combined_log", "ua_list_classify", "inter_arrival", *sorted(ONE_ROW)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SOME)
def test_shape(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    spark.catalog.clearCache()
    assert "CartesianProduct" not in text and "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert name in ONE_ROW or "BroadcastNestedLoopJoin" not in text


def final_plan(df):
    """The plan that ran."""
    qe = df._jdf.queryExecution()
    qe.executedPlan().execute().count()
    return qe.executedPlan().toString().split("== Initial Plan ==")[0]


def operators(text):
    """(depth, operator) of each line of a plan's tree."""
    return [(len(m[1]), m[2]) for line in text.splitlines() if (m := re.match(r"([\s:+\-*()0-9]*)(\w+)", line))]


@pytest.mark.parametrize("name", ["multi_trie_detect", "multi_trie_stats", "cluster_detect", "cluster_multi_set"])
def test_one_scan_for_all_analyses(spark, name):
    """None in the main plan where it reuses the exchange that the totals' subquery made."""
    assert final_plan(catalog.QUERIES[name](spark, SF)).count("FileScan parquet") <= 1


def test_subtraction_reads_each_table_once(spark):
    assert final_plan(catalog.QUERIES["cidr_subtract"](spark, SF)).count("FileScan parquet") == 2


@pytest.mark.parametrize("name", ["remove_contained", "merge_ranges", "merge_canonical", "interval_coalesce", "cidr_subtract", "cluster_merge", "arrival_gaps"])
def test_no_window_over_everything(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    tree = operators(df._jdf.queryExecution().executedPlan().toString())
    under: list[tuple[int, str]] = []
    for line, (depth, op) in zip(df._jdf.queryExecution().executedPlan().toString().splitlines(), tree, strict=False):
        while under and under[-1][0] >= depth:
            under.pop()
        if op == "Exchange" and "SinglePartition" in line:
            above = [o for _, o in under if o not in ("Sort", "InputAdapter", "WholeStageCodegen", "Project", "Filter")]
            assert not above or above[-1] != "Window", line
        under.append((depth, op))


def test_scans_are_pruned(spark):
    text = plan(catalog.QUERIES["heatmap16"](spark, SF))
    read = text[text.index("ReadSchema") :].split("\n")[0]
    assert "event_id" in read and "props" not in read and "value" not in read


def test_top_n_is_no_sort(spark):
    text = plan(catalog.QUERIES["top_talkers"](spark, SF))
    assert "TakeOrderedAndProject" in text and "RangePartitioning" not in text


def test_address_only_parse_stops_early(spark):
    from rangeloom.sources import logformat

    fields = logformat.compile_format(logformat.DEFAULT)
    short = logformat.compile_format("%h %t %r")
    assert len(logformat.line_pattern(short[:1])) < len(logformat.line_pattern(short)) < len(logformat.line_pattern(fields))
    text = plan(logformat.parse_lines(spark.createDataFrame([("x",)], "value string"), '%h %^ %^ [%t] "%r" %s', ["ip"]))
    assert "make_dt_interval" not in text
