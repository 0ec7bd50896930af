"""What the plans must and must not hold."""

import os
import re

import pytest
from pyspark.sql import functions as F

from flawsieve import Rule, scan_log, scan_path, scan_table
from flawsieve.operators.match import PREFILTER_PATTERNS
from flawsieve.plans import reports
from flawsieve.rules import RULE_SETS
from querysuite.catalog import QUERIES
from querysuite.corpus import code_corpus

# HotSpot leaves methods of more bytecode than this to the interpreter.
JIT_LIMIT = 8000


@pytest.fixture(scope="module")
def stored(spark, sf_small, tmp_path_factory):
    """The corpus as a stored table with a column the scan has no use for."""
    path = str(tmp_path_factory.mktemp("corpus") / "files")
    code_corpus(spark, sf_small).withColumn("other", F.lit("x")).write.parquet(path)
    return spark.read.parquet(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def full_table_of_rules():
    per_set = PREFILTER_PATTERNS // len(RULE_SETS)
    return [Rule(s, i, f"some_call_{s}_{i}(", "Low", f"d{i}", 0.5) for s in RULE_SETS for i in range(1, per_set + 1)]


def test_scan_has_no_shuffle_and_one_reading(stored):
    plan = plan_of(scan_log(stored))
    assert len(re.findall(r"FileScan", plan)) == 1
    assert len(re.findall(r"Generate posexplode", plan)) == 1
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert plan.count("BroadcastExchange") == 1
    assert re.search(r"BroadcastExchange.*\n.*LocalTableScan", plan)


def test_scan_reads_two_columns(stored):
    plan = plan_of(scan_table(stored))
    assert re.search(r"ReadSchema: struct<path:string,content:string>", plan)


def test_scan_splits_a_file_once(stored):
    # Spark would add a filter on the size of the split text, splitting it again.
    assert len(re.findall(r"\bsplit\(", plan_of(scan_log(stored)))) == 1


def test_rules_prune_with_the_heuristic_asked_for(stored):
    one = scan_table(stored).filter(F.col("rule_ord") == 1001)
    local = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in local.split("LocalRelation")[-1]


def scan_of_table(spark, stored, rules):
    return scan_log(stored, rules=rules, keep=["file_id", "event_time"])


def scan_of_tree(spark, stored, rules):
    # Every file counts as too large to be read whole.
    return scan_path(spark, os.path.join(os.path.dirname(__file__), "fixtures"), rules=rules, whole_file_bytes=0)


@pytest.mark.parametrize("scan", [scan_of_table, scan_of_tree])
@pytest.mark.parametrize("rules", [None, full_table_of_rules()], ids=["builtin", "largest"])
def test_generated_code_can_be_compiled(spark, stored, scan, rules):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = scan(spark, stored, rules)
        stages = df._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and 0 < max(sizes) < JIT_LIMIT


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_in_any_plan(spark, sf_small, name):
    plan = plan_of(QUERIES[name](spark, sf_small))
    assert not re.search(r"Python|Arrow|CartesianProduct|BroadcastNestedLoopJoin.*Cross", plan)


def test_counts_combine_before_the_shuffle(stored):
    for df in (reports.severity_by_file(scan_log(stored)), reports.scan_status(scan_log(stored))):
        plan = plan_of(df)
        assert plan.count("Exchange hashpartitioning") == 1
        assert "partial_count" in plan


def test_reports_group_by_part_not_by_file(stored):
    plan = plan_of(reports.report_text(scan_log(stored)))
    keys = re.findall(r"listagg.*", plan)
    assert keys
    # The only windows over a whole file are those over its counts per chunk.
    windows = re.findall(r"Window \[(.*)", plan)
    assert all("chunk#" in w or "rule_ord" not in w for w in windows)


def test_filter_looks_for_what_is_asked_only(spark, sf_small):
    plan = plan_of(QUERIES["heur_sql"](spark, sf_small))
    assert "execute(" in plan
    assert not any(text in plan for text in ("AIza", "gho_", "credential", "private_key"))


def test_reports_that_number_findings_scan_once(spark, sf_small):
    for name in ("ordered_findings", "report_json", "report_by_file", "workspace_report"):
        plan = plan_of(QUERIES[name](spark, sf_small))
        assert "Generate" not in plan and "contains(" not in plan and "event_id" not in plan, name
