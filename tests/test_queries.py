"""A cross-section of the registered queries against their SQL at the smallest scale; the whole
list runs with ``python tests/oracle_check.py 0.01``."""

import pytest
from oracle_check import compare, connect

from tidewatch.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
PICKED = """ranked_incidents clean_text ngrams strip_accents read_posts_legacy dedupe_report label_audit
stratified_split_exact build_vocabulary tfidf noise_gate top_terms cluster_window attach_borders components
summarise_clusters incident_feed incident_sources resolve_sticky digest geocode extract_places lookup_fuzzy
gazetteer_report auc average_precision threshold_sweep score_histogram metrics_table label_window_counts""".split()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", PICKED)
def test_agrees_with_sql(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], SQL[name], FOLDER)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 100
