from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchtrail.sources import incident_store as S

START = datetime(2026, 8, 10)
ROWS = "incident_id string, timestamp timestamp, note string"


def batch(spark, ids, minutes=0, note="n"):
    return spark.createDataFrame([(i, START + timedelta(minutes=minutes), note) for i in ids], ROWS)


def stored_ids(spark, root):
    return sorted(r.incident_id for r in S.read_store(spark, root).collect())


def test_insert_if_absent_replays_and_compacts(spark, tmp_path):
    root = str(tmp_path / "store")
    assert S.read_store(spark, root).count() == 0
    assert S.insert(batch(spark, ["a", "b", "b"]), root, 0, keep=2).count() == 2
    again = batch(spark, ["b", "c"], minutes=5, note="late")
    assert sorted(r.incident_id for r in S.insert(again, root, 1, keep=2).collect()) == ["c"]
    assert sorted(r.incident_id for r in S.insert(again, root, 1, keep=2).collect()) == ["c"]
    for n in range(2, 6):
        S.insert(batch(spark, [f"x{n}", "a"]), root, n, keep=2)
    current = S.state(spark, root)
    assert len([p for p in current["parts"] if p.startswith("b")]) <= 3
    assert any(p.startswith("g") for p in current["parts"])
    assert stored_ids(spark, root) == ["a", "b", "c", "x2", "x3", "x4", "x5"]
    first = S.read_store(spark, root).filter("incident_id = 'b'").first()
    assert first.note == "n"
    assert S.insert(batch(spark, []), root, 6, keep=2).count() == 0
    assert stored_ids(spark, root) == ["a", "b", "c", "x2", "x3", "x4", "x5"]


def test_files_consulted_do_not_grow_with_age(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 8)
    root = str(tmp_path / "store")
    probe = batch(spark, [f"new{i}" for i in range(40)])
    consulted = []
    for n in range(10):
        S.insert(batch(spark, [f"id{n}-{i}" for i in range(40)]), root, n, keep=2)
        parts = S.state(spark, root)["parts"]
        consulted.append(len(S.maybe_holding(probe, root, parts)))
        assert len(parts) <= 4
    # Bloom filters answer for absent ids about 1 % of the time, whatever the store's age.
    assert max(consulted) <= 3
    parts = S.state(spark, root)["parts"]
    known = S.maybe_holding(batch(spark, ["id0-7"]), root, parts)
    assert (parts[0], S.BUCKETS and spark.range(1).select(S.bucket_of(F.lit("id0-7"))).first()[0]) in known
    assert len(stored_ids(spark, root)) == 400


def test_reader_of_an_older_state_sees_whole_parts(spark, tmp_path):
    root = str(tmp_path / "store")
    for n in range(4):
        S.insert(batch(spark, [f"k{n}"]), root, n, keep=10)
    before = S.state(spark, root)
    S.compact(spark, root, keep=1)
    after = S.state(spark, root)
    assert after["version"] == before["version"] + 1 and len(after["parts"]) == 1
    old = S._live(spark, root, "data", before["parts"], before["schema"])
    assert sorted(r.incident_id for r in old.collect()) == ["k0", "k1", "k2", "k3"]
    assert sorted(S.vacuum(spark, root)) == sorted(before["parts"])
    assert stored_ids(spark, root) == ["k0", "k1", "k2", "k3"]
