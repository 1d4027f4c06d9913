"""A spread of registered queries against their SQL; ``check_oracle.py`` runs all of them."""

import os

import pytest

from check_oracle import compare, duck

SF = "/root/testdata/sf0.01"
FAST = (
    "persistence_week_ahead_by_zone suppression_scenario_totals scenario_statistics duplicate_report_keys zone_indicator_rollup "
    "excluded_windows mobility_graph diffused_features rook_contiguity public_car_parks demand_weights message_zones raw_text_round_trip output_manifest forecast_intervals retrospective_table zone_risk_table"
).split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    import __spark_entry__ as entry

    n, ok, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_every_query_has_sql_or_a_reason():
    from zonewise.plans.registry import ORACLES, QUERIES

    import __spark_entry__  # noqa: F401 - registers the queries

    assert set(QUERIES) - set(ORACLES) == set()
