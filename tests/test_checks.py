"""A cross-section of the registered queries against their SQL, on the smallest tables.

``python -m checks.compare <folder>`` runs all of them.
"""

import ast
import glob
import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

NAMES = ["nrm1_resolve_sampling", "nrm7_exporter_restarts", "cls1_lpm_join", "cls1_lpm_large_registry", "cls4_validate_prefixes", "agg11_all_host",
         "agg13_active_entities", "rat1_rate_windows", "qry1_traffic_summary", "qry2_top_interface", "det3_snapshots", "pol1_validate", "pol5_select",
         "evl1_evaluate", "evt1_events", "inc2_gate", "inc4_created", "inc9_long_reopen_window", "inc12_numbers", "iq1_list", "iq6_notes", "mit1_guard",
         "mit2_allowlist", "mit8_reconcile", "pol7_diff", "stm8_policy_timeline", "inc17_verbs", "inc21_manual_incidents", "src4_document_errors", "ntf1_route", "ntf2_dedup", "ntf3_rate_limit", "src1_read_flows_json", "src3_prefix_lists", "snk4_export", "mit12_command_outcomes", "mit12_outbox"]


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, sf, duck, name):
    ok, text = compare(spark, duck, sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


@pytest.mark.parametrize("path", sorted(glob.glob(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "checks", "*.py"))))
def test_no_name_is_defined_twice(path):
    """A second function of one name would silently stand for the first in every query; so would a second entry of one key."""
    tree = ast.parse(open(path).read())
    names = [node.name for node in tree.body if isinstance(node, ast.FunctionDef)]
    assert sorted(names) == sorted(set(names))
    for node in ast.walk(tree):
        if isinstance(node, ast.Dict):
            keys = [key.value for key in node.keys if isinstance(key, ast.Constant)]
            assert sorted(map(str, keys)) == sorted(map(str, set(keys)))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() == 10
