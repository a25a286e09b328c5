"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from convolens.functions import rouge as R
from convolens.operators import facts
from convolens.plans import views as V
from convolens.session import release
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir) == []
    release()


def test_every_query_has_sql():
    from convolens.plans import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry_gives_a_prompt_per_query(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.prompt.endswith("\n\nSummary:") for r in rows)


def test_stemmed_scores_match_plain_python(spark, sf_dir):
    got = {r.query_id: r for r in entry.queries()["rouge_stemmed"](spark, sf_dir).collect()}
    pairs = V.scored_pairs(spark, sf_dir, "b").collect()
    assert len(got) == len(pairs)
    for p in pairs:
        want = R.score_pair(p.prediction, p.reference, R.METRICS)
        assert all(abs(got[p.query_id][m] - want[m][2]) < 1e-6 for m in R.METRICS)


def test_claim_packets_hold_every_claim_once(spark, sf_dir):
    rows = entry.queries()["claim_packets"](spark, sf_dir).collect()
    assert len({r.claim_id for r in rows}) == len(rows)
    marked = facts.unsupported_claims(V.marking_replies(spark, sf_dir)).count()
    gold = sum(len(r.facts) for r in V.fact_lists(spark, sf_dir).collect())
    assert len(rows) == marked + gold
