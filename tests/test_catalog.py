"""Every catalog query against its DuckDB twin, and the corpus' known counts."""

import pytest
from pyspark.sql import functions as F

import oracle
from flawsieve import scan_table
from flawsieve.functions.paths import in_scope
from flawsieve.sources.files import DEFAULT_EXCLUDES
from querysuite.catalog import QUERIES
from querysuite.corpus import code_corpus
from querysuite.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_medium):
    return oracle.connect(sf_medium)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_twin(spark, con, sf_medium, name):
    ours = oracle.rows_of_spark(QUERIES[name](spark, sf_medium))
    theirs = oracle.rows_of(con, ORACLES[name])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
    assert ours[1]


def test_corpus_counts(spark, sf_medium):
    found = scan_table(code_corpus(spark, sf_medium))
    one = found.agg(
        F.count("*"),
        *(F.count_if(F.col("severity") == s) for s in ("High", "Medium", "Low")),
        *(F.count_if(F.col("rule_ord") == n) for n in (1001, 1002, 1003, 1004)),
        F.count_distinct("path"),
    ).first()
    assert tuple(one) == (3685, 2772, 889, 24, 278, 272, 140, 1150, 473)
    assert found.filter(in_scope("path", ())).count() == 2976
    assert found.filter(in_scope("path", DEFAULT_EXCLUDES)).count() == 2589


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 50
    # All of the catalog has SQL; of the operators on documents and pages, what SQL can express.
    assert QUERIES.keys() <= contract.oracle_sql().keys() <= contract.queries().keys()
