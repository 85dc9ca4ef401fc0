"""Registered queries against their reference SQL. The default run takes the quicker ones;
TIDEMARK_ALL=1 takes all."""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.001")
QUICK = """P1_P2_tolerant_casts P3_P4_P5_P28_period_numbers P6_P7_domain_keys P8_name_keys P9_sector_buckets P10_stage_buckets
P12_P13_P14_P15_P16_P26_P27_amount_guards P17_partner_scores P20_noise_placebo P23_percent_text P25_listing_urls hashed_draws
J3_A3_crosswalk_first A5_W8_deals_by_period J7_A6_patents_by_period W3_W4_W5_homepage_runs A1_first_round A2_first_exit A4_rounds_by_period
A13_route_support F3_L4_risk_intervals W2_asof_full_history W2_asof_panel_only W11_equal_count_bins A16_quantiles T2_W12_top_k
E11_metric_rows J11_F6_P24_P29_cutoff_rows S1_S7_csv_round_trip M8_one_class_score""".split()

SQL = entry.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("TIDEMARK_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_reference_sql(spark, con, name):
    assert oracle.compare(spark, SF, entry.queries()[name], SQL[name], con) == []


def test_every_reference_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "company_exit_route", "rows", "companies"] and df.count() > 0
