"""Event wiring over all rows, against plain counting."""

from __future__ import annotations

from ripplegraph.plans import catalog


def test_wiring_of_all_events(spark):
    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/events.parquet").collect():
        if r.event_type != "error":
            want.setdefault(f"bucket::{r.user_id % 97}", set()).add(r.event_type in ("purchase", "signup"))
    got = {r.event: {x for x, on in ((True, r.produced), (False, r.consumed)) if on} for r in catalog.QUERIES["event_wiring"](spark, d).collect()}
    assert {k: v for k, v in got.items() if v} == want
