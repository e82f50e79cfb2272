"""The store's commit files: torn, raced for, listed, and what they say of their parts."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from threadlake.operators.overview import session_statistics
from threadlake.streaming import ingest
from threadlake.streaming import store as st


def events(spark, n, generation="g", first=0):
    names = [c.split(" ")[0] for c in st.EVENTS.split(", ")]
    rows = []
    for k in range(first, first + n):
        row = dict.fromkeys(names) | {"event_id": f"{generation}{k}", "native_session_id": "s", "sequence": k, "kind": "user_message", "tool_family": "codex", "source_path": f"/{generation}", "source_generation": generation, "source_offset": k, "payload_json": "{}"}
        rows.append(tuple(row[c] for c in names))
    return spark.createDataFrame(rows, st.EVENTS)


@pytest.mark.parametrize("torn", ["", '{"number": 1, "stream": "x", "ba', "[]", '{"number": 1}'])
def test_a_torn_commit_is_passed_over(spark, tmp_path, torn):
    store = st.Store(spark, str(tmp_path / "s"))
    assert store.commit(0, events(spark, 3)) == 3
    (tmp_path / "s/commits" / st.name_of(1)).write_text(torn)
    (tmp_path / "s/commits" / ".000000000002.json.abc").write_text('{"half')  # a writer that died before it renamed
    for one in (store, st.Store(spark, str(tmp_path / "s"))):
        assert [c.number for c in one.commits()] == [0]
    assert store.commit(1, events(spark, 2, "h")) == 2
    assert [c.number for c in st.Store(spark, str(tmp_path / "s")).commits()] == [0, 2] and store.events().count() == 5


def test_ids_have_no_gaps(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "s"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store.commit(0, events(spark, 40))
        store.commit(1, events(spark, 25, "h"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(store.commits()[0].starts) > 1
    rows = store.events().orderBy("ingestion_id").collect()
    assert [r["ingestion_id"] for r in rows] == list(range(1, 66)) and store.watermark() == 65
    assert [r["source_offset"] for r in rows] == [*range(40), *range(25)]


def test_a_number_goes_to_one_writer(spark, tmp_path):
    folder = str(tmp_path / "s/commits")
    won = []

    def race(k):
        files = st.Files(spark, folder)
        won.append(files.write("n", str(k)))

    threads = [threading.Thread(target=race, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True] and st.Files(spark, folder).read("n") in map(str, range(8))
    files = st.Files(spark, folder)
    files.local = False  # the way of stores that aren't a local disk
    assert files.write("m", "a") and not files.write("m", "b") and files.read("m") == "a"
    assert files.write("m", "c", replace=True) and files.read("m") == "c" and files.there("m") and files.read("none") is None


def test_the_list_of_many_commits_costs_little(spark, tmp_path, monkeypatch):
    store, reads = st.Store(spark, str(tmp_path / "s")), []
    for k in range(1000):
        store.commits()
        assert store._put(st.Commit(store._next, "x", k, 0, 0, 0, {"events": f"part=p{k}"}, {"events": 1}, {"events": {f"g{k}": [0, 9]}}))
    read = st.Files.read
    monkeypatch.setattr(st.Files, "read", lambda self, name: reads.append(name) or read(self, name))
    fresh = st.Store(spark, str(tmp_path / "s"))
    assert len(fresh.commits()) == 1000 and len(reads) <= 3 + st.CHECKPOINT
    reads.clear()
    assert len(fresh.commits()) == 1000 and len(reads) == 1
    # A batch is compared with the parts that may hold the same: one of a thousand.
    assert [c.number for c in fresh.commits() if c.touches("events", {"g7": [5, 6]})] == [7]
    assert not any(c.touches("events", {"g7": [10, 12], "new": [0, 5]}) for c in fresh.commits())
    # A list that is torn is left aside.
    last = (tmp_path / "s/commits/last").read_text()
    (tmp_path / f"s/commits/upto-{last}.jsonl").write_text('{"number"')
    assert len(st.Store(spark, str(tmp_path / "s")).commits()) == 1000


def test_batches_meet_what_they_may_repeat(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "s"))
    assert store.commit(0, events(spark, 5)) == 5 and store.commit(1, events(spark, 5, first=5)) == 5
    assert store.commits()[1].spans["events"] == {"g": [5, 9]}
    assert store.commit(2, events(spark, 6, first=3)) == 0 and store.commit(3, events(spark, 4, first=8)) == 2
    assert store.remove_events(store.events().where("event_id = 'g4'").select("event_id")) == 1
    assert store.commit(4, events(spark, 12)) == 0 and store.events().count() == 11
    assert json.loads((tmp_path / "s/commits" / st.name_of(0)).read_text())["counts"]["events"] == 5
    states = spark.createDataFrame([("/a", "g", 3, "x")], st.STATES)
    store.commit(5, events(spark, 1, "k"), states=states)
    store.commit(6, events(spark, 1, "l"), states=states.withColumns({"next_sequence": F.lit(9).cast("long"), "state": F.lit("y")}))
    paths = spark.createDataFrame([("/a",)], "path string")
    assert [tuple(r) for r in store.states(paths).collect()] == [("/a", "g", 9, "y")] == [tuple(r) for r in store.states().collect()]


def test_statistics_follow_from_what_commits_change(spark, tmp_path):
    store, rng = st.Store(spark, str(tmp_path / "s")), random.Random(9)
    for k in range(4):
        rows = events(spark, 30, f"g{k}").withColumns({"native_session_id": F.concat(F.lit("s"), (F.col("source_offset") % 7).cast("string")), "canonical_bytes": F.col("source_offset") * 3, "kind": F.when(F.col("source_offset") % 5 == 0, "error").otherwise("user_message"), "payload_json": F.concat(F.lit('{"text":"t'), F.lit(rng.randrange(9)), F.lit('-'), F.col("source_offset"), F.lit('"}'))})
        store.commit(k, rows)
        if k % 2:
            gone = sorted(r[0] for r in store.events().select("event_id").collect())
            store.remove_events(spark.createDataFrame([(i,) for i in rng.sample(gone, 11)], "event_id string"))
    sizes = lambda frame: {r["native_session_id"]: (r["event_count"], r["content_bytes"]) for r in frame.collect()}
    assert sizes(store.statistics()) == sizes(session_statistics(store.events()))
    every = store._read("events", store.commits())  # titles of removed events stay
    assert {r["native_session_id"]: r["title"] for r in store.statistics().collect()} == {r["native_session_id"]: r["title"] for r in session_statistics(every).collect()}
    store.rebuild_statistics()
    assert {tuple(r) for r in store.statistics().collect()} == {tuple(r) for r in session_statistics(store.events()).collect()}
    store.remove_events(store.events().where("native_session_id = 's3'").select("event_id"))
    assert "s3" not in sizes(store.statistics())


def test_followers_read_each_commit_once(spark, tmp_path, monkeypatch):
    store, parts = st.Store(spark, str(tmp_path / "s")), []
    for k in range(3):
        store.commit(k, events(spark, 700, f"g{k}"))
    read = st.Store._read
    monkeypatch.setattr(st.Store, "_read", lambda self, name, commits, *rest: parts.extend(c.number for c in commits if name == "events") or read(self, name, commits, *rest))
    pages = list(ingest.follow(store, limit=10))
    assert [len(p) for p in pages] == [10] * 210 and [r["ingestion_id"] for p in pages for r in p] == list(range(1, 2101)) and parts == [0, 1, 2]
    parts.clear()
    last = pages[-3][-1]["event_id"]
    assert [r["ingestion_id"] for p in ingest.follow(store, last, 256) for r in p] == list(range(2081, 2101)) and parts[-1:] == [2]
    with pytest.raises(ValueError):
        next(ingest.follow(store, "nobody"))
    given = []
    for n in (2100, 2105):
        ingest.event_stream(store, f"{tmp_path}/cp", lambda rows, _: given.append(rows.count()), once=True).awaitTermination()
        assert sum(given) == n
        store.commit(10 + n, events(spark, 5, f"h{n}"))
