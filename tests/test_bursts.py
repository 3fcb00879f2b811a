import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from radiolake.operators import bursts as U
from radiolake.plans.adapters import Views
from radiolake.plans.q_bursts import _hits

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_hits_bring_their_text_without_a_join(spark):
    plan = _plan(_hits(Views(spark, SF)))
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_limited_slots_are_found_once(spark):
    slots = U.slot_candidates(_hits(Views(spark, SF))).withColumn("capture", F.floor(F.col("seq") / 16))
    assert "MapInPandas" in _plan(slots)
    assert "MapInPandas" not in _plan(U.limit_slots(slots, ["capture"], 40, 12))


def test_burst_events_classify_once(spark, monkeypatch):
    from radiolake.plans import load_all
    from radiolake.plans.catalog import QUERIES

    load_all()
    calls, real = [], U.classify_slots
    monkeypatch.setattr(U, "classify_slots", lambda *a: calls.append(1) or real(*a))
    QUERIES["bst7_burst_events"](spark, SF)
    assert len(calls) == 1


def test_dpmr_lists_do_not_scan_again(spark):
    from radiolake.plans import load_all
    from radiolake.plans.catalog import QUERIES

    load_all()
    assert "Window" not in _plan(QUERIES["ses4_dpmr_calls"](spark, SF))
