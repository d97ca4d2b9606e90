"""Catalogue queries against their SQL on the smallest sample tables."""

import os

import pytest
from compare import difference, duck

from pagesieve.plans import catalog

FOLDER = "/root/testdata/sf0.001"
# Covered by cheaper neighbours; `python tests/compare.py <folder>` runs everything.
SLOW = {"f2_secrets_full", "a4_secrets_by_rule", "k4_findings_table", "s8_rule_exclusion", "t1_scan_stream", "a3_section_counts",
        "a5_page_totals", "f1_secrets_conversations", "f5_endpoint_fetch", "f6_endpoint_axios", "f7_endpoint_client",
        "f8_endpoint_xhr", "j3_validate_maps", "j2_guess_maps"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query_matches_sql(spark, con, name):
    diff, _ = difference(catalog.QUERIES[name](spark, FOLDER), con, catalog.ORACLE[name])
    assert diff is None
