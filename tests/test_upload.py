"""Uploads through to the yard: all or nothing, replays, new dimensions."""

from datetime import datetime

import pytest

from quaystack.operators import store
from quaystack.plans import upload
from quaystack.schema import RAW_COLUMNS, RAW_SCHEMA, YardSpec
from quaystack.session import scratch_path
from quaystack.sources import bronze

AT = datetime(2026, 3, 4, 10)
SMALL = YardSpec(n_blocks=4, n_bays=2, n_rows=2, max_height=3)
COLUMNS = ["id", "size", "weight", "departure_time", "type", "slot", "yard_id"]
FIRST = [
    ("a", "20", "20", "2026-04-09", "import", "A-001-A-01", 0),
    ("b", "20", "10", "2026-04-05", "import", "A-001-A-02", 0),
    ("c", "20", "9", "2026-04-08", "export", "A-001-A-03", 0),   # leaves after b
    ("d", "40", "9", "2026-04-08", "export", "A-002-A-01", 0),   # wrong zone
    ("a", "20", "20", "2026-04-09", "import", "A-001-A-01", 0),  # twice
    ("e", "20", "9", "2026-04-08", "export", "A-001-A-01", 1),   # another yard
]
SECOND = [
    ("a", "20", "20", "2026-04-09", "import", "A-002-A-01", 0),  # stands already
    ("f", "20", "8", "2026-04-01", "import", "A-001-A-03", 0),   # on what stands
    ("g", "20", "8", "2026-04-01", "import", "A-001-A-01", 0),   # taken
]
ARRIVING = [
    ("g", "20", "8", "2026-04-01", "import", None, 0),           # the snapshot names it
    ("b", "20", "8", "2026-04-01", "import", None, 0),           # stands already
    ("h", "40", "30", "2026-05-01", "export", None, 0),
    (None, "40", "30", "2026-05-01", "export", None, 0),
]


def lay(spark, landing, number, **sides):
    schema = ", ".join(f"{c} string" for c in COLUMNS[:-1]) + ", yard_id long"
    for kind, rows in sides.items():
        bronze.write_upload(spark.createDataFrame(rows, schema), landing, number, kind)


def yard_of(spark, root):
    return {(r["id"], r["yard_id"], r["block_id"], r["bay"], r["row"], r["tier"])
            for r in upload.standing(spark, root).collect()}


def state(spark, root):
    return yard_of(spark, root), sorted(map(tuple, upload.stored(spark, root).drop("bucket").collect()))


def ends(spark, root, number):
    rows = upload.outcomes(spark, root).filter(f"upload = {number}").collect()
    return {(r["kind"], r["id"]): (r["audit"], r["outcome"]) for r in rows}


def test_landed_schema_leaves_the_raw_one_alone():
    assert RAW_SCHEMA.names == [f.name for f in RAW_SCHEMA.fields] == RAW_COLUMNS
    assert upload.LANDED.names == RAW_COLUMNS + ["upload", "kind", "yard_id"]


def test_uploads_all_or_nothing(spark, monkeypatch):
    landing, root = scratch_path(spark, "landing"), scratch_path(spark, "terminal")
    with pytest.raises(ValueError):
        upload.standing(spark, root)
    upload.set_up(spark, root, SMALL)
    assert yard_of(spark, root) == set()
    lay(spark, landing, 0, snapshot=FIRST)
    assert upload.run(spark, landing, root, AT) == [0]
    was = state(spark, root)
    assert ends(spark, root, 0) == {
        ("snapshot", "a"): ("PLACED", "PLACED"), ("snapshot", "b"): ("PLACED", "PLACED"),
        ("snapshot", "c"): ("WOULD_REHANDLE", "PLACED_PRIMARY"),
        ("snapshot", "d"): ("WRONG_ZONE", "PLACED_PRIMARY"), ("snapshot", "e"): ("PLACED", "PLACED")}
    assert {i for i, *_ in was[0]} == set("abcde")
    assert ("b", 0, "A", 1, 1, 2) in was[0] and ("e", 1, "A", 1, 1, 1) in was[0]

    # A replay changes nothing.
    assert upload.run(spark, landing, root, AT) == []
    assert state(spark, root) == was

    # One that fails before its manifest row leaves the yard and store as they were.
    lay(spark, landing, 1, snapshot=SECOND, arrivals=ARRIVING)

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(upload, "_commit", fail)
    with pytest.raises(RuntimeError):
        upload.run(spark, landing, root, AT)
    monkeypatch.undo()
    assert state(spark, root) == was
    with pytest.raises(ValueError):
        upload.document(spark, root, 1)

    assert upload.run(spark, landing, root, AT) == [1]
    assert ends(spark, root, 1) == {
        ("snapshot", "a"): (None, "DUPLICATE"), ("snapshot", "f"): ("PLACED", "PLACED"),
        ("snapshot", "g"): ("SLOT_TAKEN", "PLACED_PRIMARY"), ("arrivals", "g"): (None, "DUPLICATE"),
        ("arrivals", "b"): (None, "DUPLICATE"), ("arrivals", "h"): (None, "PLACED_PRIMARY")}
    now = yard_of(spark, root)
    assert was[0] < now and ("f", 0, "A", 1, 1, 3) in now and {i for i, *_ in now} == set("abcdefgh")
    assert len({slot for _, *slot in map(lambda r: (r[0], r[1:]), now) for slot in slot}) == len(now)
    doc = upload.document(spark, root, 1).first()
    assert (doc["total_containers"], doc["pipeline_quality"]["total_raw_ingested"]) == (3, 7)
    counts = {r["upload"]: r.asDict() for r in upload.report(spark, root).collect()}
    assert counts[1] == {"upload": 1, "snapshot_received": 3, "placed_fixed": 1, "rescued": 1,
                         "snapshot_known": 1, "arrivals_received": 3, "placed_by_search": 2,
                         "arrivals_known": 2, "unplaced": 0, "total_placed": 3}

    # Started over with other dimensions: an empty yard of these, older rows unread.
    upload.set_up(spark, root, YardSpec(n_blocks=2, n_bays=1, n_rows=1, max_height=2), "2026-03-04 11:00:00")
    assert state(spark, root) == (set(), [])
    lay(spark, landing, 2, snapshot=FIRST)
    assert upload.run(spark, landing, root, datetime(2026, 3, 4, 12)) == [2]
    spec = upload.current(spark, root).spec
    assert (spec.block_ids, spec.max_height) == (["A", "B", "S1", "S2"], 2)
    # No pile has a third tier, so c is put elsewhere; d's size has a backup block alone.
    again = yard_of(spark, root)
    assert {("a", 0, "A", 1, 1, 1), ("b", 0, "A", 1, 1, 2), ("d", 0, "S2", 1, 1, 1)} <= again
    assert {r["id"] for r in upload.stored(spark, root).collect()} == set("abcde")
    assert store.read_live(spark, f"{root}/store", upload.current(spark, root).live).count() == 8


def test_records_of_several_landings_are_derived_once(spark, monkeypatch):
    from quaystack.plans import catalog
    from tests.conftest import SF_SMALL
    calls = []
    raw = catalog.ctx.raw
    monkeypatch.setattr(catalog.ctx, "raw", lambda *a: calls.append(a) or raw(*a))
    rows = catalog._records(spark, SF_SMALL)
    for batch in ("snapshot", "arrivals"):
        plan = rows.filter(f"batch = '{batch}'")._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and "Join" not in plan
    assert len(calls) == 1 and rows.count() == raw(spark, SF_SMALL).count()
