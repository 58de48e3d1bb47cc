"""Queries against their SQL in DuckDB. All of them with PROBELINE_ALL=1, else one or two per family."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("PROBELINE_SF", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SOME = """
a05_time_warp c06_signed_rank_test c08_holm_adjustment d02_subject_covariates e05_trimmed_mean_templates
e08_geometric_median_templates e10_multi_templates e16_genuine_pairs e18_all_genuine_mode e23_fused_balanced
e24_multi_template_random g04_fir_bandpass g10_beats g14_merged_average g18_partition_statistics g23_mel_spectrogram
k02_stratified_split k03_drop_report m01_multi_template_ranks m04_roc_curve m08_operating_points m12_frozen_threshold
p01_lead_selection p07_usable_records p09_first_visit_content q4_subject_disjoint_verification r03_leave_last_out_short_term
r06_custom_record_split r14_causality_audit r22_range_audit r24_source_order s02_named_recordings s06_minute_ranges
s09_appended_records s12_fingerprint st1_sliding_windows st2_sittings u04_bootstrap_interval x01_result_table x02_coverage
""".split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("PROBELINE_ALL") else SOME


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return f"{type(value).__name__}:{value!r}"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"rank", "rate"}


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    cursor = db.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    wanted = sorted(tuple(plain(row[i]) for i in places) for row in cursor.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in got.collect()) == wanted
