"""A cross-section of the registered queries against their SQL; ``tests/oracle_check.py``
runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from radiolake.plans.catalog import ORACLE, QUERIES
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "calls_per_channel", "prj1_conform_pdus", "prj10_line_tetra", "prj14_nxdn_layer3", "ded1_all_protocols", "ded13_detection_merge",
    "ses2_p25_calls", "ses5_tetra_sessions", "ses7_superframes", "ses12_infer_timing", "act7_channel_events", "act15_window_power",
    "act18_rebatch", "spc9_suppress_neighbours", "spc11_refine_carriers", "spc18_training_hits", "trk3_tracking_summary",
    "evd1_probe_evidence", "evd9_sweep_summary", "evd11_health_events", "bst6_route_blocks", "rpt8_interval_trends",
    "cmp3_sample_verdicts", "src2_iq_chunks", "src7_replay_timeline", "snk2_window_csv", "udf2_window_decoder",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


# rules without an SQL form; each has a brute-force or hand-derived test
NO_SQL = {
    "ded9_unseen_ledger", "ded12_chain_merge", "ses4_dpmr_calls", "act2_spectral_noise", "act3_floor_sources",
    "act5_adaptive_detector", "spc1_welch_psd", "spc2_waterfall", "spc13_fine_candidates", "spc15_modulation_gate",
    "spc17_tune_narrowband", "trk1_tracks", "trk2_track_events",
}


def test_registry():
    assert set(QUERIES) - set(ORACLE) == NO_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "closed_by" in df.columns


def _agrees(spark, folder, rows, name):
    """Write events of (event_id, value) as a data folder and compare a query over them with its SQL."""
    from datetime import datetime

    full = [(i, datetime(2024, 1, 1), 1, "view", x, '{"k": 1}') for i, x in rows]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(full, schema).coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    ok, message = compare(spark, con, str(folder), name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def _rows(spark, folder, name, *cols):
    return sorted(tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*cols).collect())


# levels of a channel: quiet but for the stated buckets
def _channel(loud, n=40, base=0):
    return [(base + b - 1, 100.0 if b in loud else 1.0) for b in range(1, n + 1)]


def test_active_runs_take_one_level_per_bucket(spark, tmp_path):
    # bucket 5 comes three times, 9 twice; 20 to 23 hold no reading
    rows = _channel({5, 6, 8, 30}) + [(4, 90.0), (4, 95.0), (8, 1.2)]
    rows = [(i, {19: -1.0, 20: float("nan"), 21: None, 22: float("inf")}.get(i, x)) for i, x in rows]
    _agrees(spark, tmp_path, rows, "act11_active_runs")
    assert _rows(spark, tmp_path, "act11_active_runs", "run_start", "run_end", "length") == [(5, 6, 2), (8, 8, 1), (30, 30, 1)]


def test_merged_runs_of_shared_buckets(spark, tmp_path):
    # every chunk twice: runs that start alike left their order, and so the merging, to chance
    rows = _channel({5, 6, 9, 10, 14, 15, 30}, 60) * 2
    _agrees(spark, tmp_path, rows, "act12_merged_runs")
    got = _rows(spark, tmp_path, "act12_merged_runs", "merged_start", "merged_end", "run_count")
    assert got == [(5, 10, 2), (14, 15, 1), (30, 30, 1)]


def test_scan_windows_reach_late_buckets(spark, tmp_path):
    # the second channel starts late and misses buckets, the third has no reading at all
    rows = _channel({5, 6, 20}) + [r for r in _channel({205, 206, 240}, 250, 4096) if r[0] >= 4096 + 200 and r[0] != 4096 + 220]
    _agrees(spark, tmp_path, rows + [(8192 + i, None) for i in range(5)], "act13_scan_windows")
    got = _rows(spark, tmp_path, "act13_scan_windows", "channel_id", "run_start", "run_end", "start_sample", "end_sample", "mode")
    assert got == [
        (0, 5, 6, 97, 432, "active_run"), (0, 20, 20, 817, 1104, "active_run"),
        (1, 205, 206, 9697, 10032, "active_run"), (1, 240, 240, 11377, 11664, "active_run"),
        (2, 1, 1, 1, 260, "short"),
    ]


def test_windows_without_a_level_are_kept(spark, tmp_path):
    # a quiet capture with nothing between its first ten buckets and its last ten
    rows = [r for r in _channel({5}, 100) if not 10 <= r[0] < 90]
    _agrees(spark, tmp_path, rows, "act15_window_power")
    got = _rows(spark, tmp_path, "act15_window_power", "start_sample", "end_sample", "mean_power_db", "peak_power_db")
    assert got == [(1, 1440, 2.0, 20.0), (1153, 2592, None, None), (2305, 3744, None, None), (3457, 4820, 0.0, 0.0)]
