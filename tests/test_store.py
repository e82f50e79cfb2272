import json

import pytest
from pyspark.sql import functions as F

from threadlake.operators import retention
from threadlake.sources import records as rec
from threadlake.sources import tail, wire
from threadlake.streaming import ingest
from threadlake.streaming import store as st


def record(kind, at, **payload):
    return json.dumps({"type": kind, "timestamp": at, "payload": payload}) + "\n"


def message(text, at):
    return record("response_item", at, type="message", role="user", content=[{"text": text}])


def run(spark, folder, store):
    ingest.ingest(spark, f"{folder}/*.jsonl", "codex", store, f"{folder}/cp").awaitTermination()


def test_stream_appends_late_replaced_and_repeated(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "store"))
    path = tmp_path / "rollout-a.jsonl"
    path.write_text(record("session_meta", "2026-07-20T10:00:00Z", id="S", cwd="/w") + message("one", "2026-07-20T10:00:01Z") + record("response_item", "2026-07-20T10:00:02Z", type="function_call", call_id="c") + "{broken}\n" + '{"half')
    run(spark, tmp_path, store)
    assert {r["kind"] for r in store.events().collect()} == {"session_start", "user_message"}
    raws = store.table("raws")
    assert raws.count() == 3  # the call's raw goes, the broken line's stays
    assert st.verified_blobs(raws).count() == 3
    mark = store.watermark()
    with path.open("a") as f:
        f.write('"}\n' + message("late", "2026-07-20T09:00:00Z"))
    run(spark, tmp_path, store)
    run(spark, tmp_path, store)
    events = {r["text"]: r for r in store.events().where("kind = 'user_message'").collect()}
    assert set(events) == {"one", "late"} and events["late"]["ingestion_id"] > mark
    ordered, upto = ingest.replay(store)
    assert [r["text"] for r in ordered.collect() if r["text"]] == ["late", "one"] and upto == store.watermark()
    assert [r["text"] for r in ingest.live_events(store, mark)[0].collect()] == ["late"]
    assert sum(ingest.replay_all(store, 1), []) == sum(ingest.replay_all(store, 100), [])
    # One session over three batches; bad lines and dropped calls use up numbers.
    assert {r["native_session_id"] for r in store.events().collect()} == {"S"} and {r["cwd"] for r in store.events().collect()} == {"/w"}
    assert {r["text"]: r["sequence"] for r in store.events().collect() if r["text"]} == {"one": 1, "late": 5}


def test_batches_are_idempotent_and_immutable(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "s"), conversation_only=False)
    tail.register(spark)
    (tmp_path / "rollout-b.jsonl").write_text(message("x", "2026-07-20T10:00:01Z") * 2)
    lines = spark.read.format("jsonl_tail").option("path", f"{tmp_path}/*.jsonl").load()
    parsed = ingest.parse_lines(lines, "codex").persist()
    events, raws = ingest.event_rows(parsed), ingest.raw_rows(parsed)
    assert store.commit(0, events, raws) == 2
    assert store.commit(0, events, raws) == 2 and store.events().count() == 2
    assert store.commit(1, events, raws) == 0 and store.events().count() == 2
    with pytest.raises(st.ImmutableConflict):  # within one batch, too
        st.Store(spark, str(tmp_path / "other")).commit(0, events, raws.unionByName(raws.withColumn("blob_hash", F.lit("other"))))
    with pytest.raises(st.ImmutableConflict):
        store.commit(2, events, raws.withColumn("blob_hash", F.lit("other")))


def test_maintenance(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "s"), conversation_only=False)
    tail.register(spark)
    (tmp_path / "rollout-c.jsonl").write_text(message("x", "2026-07-20T10:00:01Z") + record("response_item", "2026-07-20T10:00:02Z", type="function_call", call_id="c"))
    parsed = ingest.parse_lines(spark.read.format("jsonl_tail").option("path", f"{tmp_path}/*.jsonl").load(), "codex").persist()
    store.commit(0, ingest.event_rows(parsed), ingest.raw_rows(parsed))
    handoffs = spark.createDataFrame([("g", f"h{i}", f"s{i}", str(i), "{}") for i in range(5)], st.HANDOFFS)
    assert store.store_handoffs(handoffs) == 5 and store.store_handoffs(handoffs) == 0
    mark = store.watermark()
    after, report = store.maintain(str(tmp_path / "t"))
    assert [r["handoff_id"] for r in after.table("handoffs").collect()] == ["h4"] and after.table("snapshots").count() == 1
    assert (report.events, report.handoffs, report.snapshots, report.raws) == (1, 4, 4, 1)
    assert after.events().count() == 1 and after.watermark() == mark
    # Known batches stay known, ids go on, and what was removed doesn't come back.
    assert after.commit(0, ingest.event_rows(parsed), ingest.raw_rows(parsed)) == 0
    assert after.remove_events(after.events().select("event_id")) == 1 and after.events().count() == 0
    assert after.commit(1, ingest.event_rows(parsed)) == 0 and after.revision() == store.revision() + 1
    more = ingest.event_rows(parsed).withColumns({"event_id": F.concat("event_id", F.lit("x"))})
    assert after.commit(2, more) == 2 and after.events().agg(F.min("ingestion_id")).first()[0] > mark


def test_streams_share_a_store(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "s"))
    (tmp_path / "rollout-a.jsonl").write_text(message("a", "2026-07-20T10:00:01Z") + message("b", "2026-07-20T10:00:02Z"))
    (tmp_path / "x.log").write_text(json.dumps({"type": "user", "sessionId": "c", "timestamp": "2026-07-20T10:00:03Z", "message": {"content": "c"}}) + "\n")
    run(spark, tmp_path, store)
    ingest.ingest(spark, f"{tmp_path}/*.log", "claude-code", store, f"{tmp_path}/cp2").awaitTermination()
    assert {r["text"] for r in store.events().collect()} == {"a", "b", "c"}
    assert len({r["ingestion_id"] for r in store.events().collect()}) == 3


def test_a_slower_writer_starts_anew(spark, tmp_path):
    store, other = (st.Store(spark, str(tmp_path / "s")) for _ in range(2))
    (tmp_path / "rollout-a.jsonl").write_text(message("a", "2026-07-20T10:00:01Z"))
    tail.register(spark)
    events = ingest.event_rows(ingest.parse_lines(spark.read.format("jsonl_tail").option("path", f"{tmp_path}/*.jsonl").load(), "codex"))
    put, tries = store._put, []

    def slow(commit):
        if not tries:
            tries.append(other.commit(0, events, stream="other"))
        return put(commit)

    store._put = slow
    assert store.commit(0, events, stream="one") == 0 and tries == [1] and store.events().count() == 1
    assert [c.number for c in store.commits()] == [0, 1]


def test_unreadable_and_rewritten_files(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "s"))
    good = json.dumps({"timestamp": 1, "params": {"sessionId": "g", "update": {"sessionUpdate": "user_message_chunk", "content": {"type": "text", "text": "hi"}}}}) + "\n"
    (tmp_path / "updates.jsonl").write_text(good + "not json\n" + good)
    ingest.ingest(spark, f"{tmp_path}/*.jsonl", "grok", store, f"{tmp_path}/cp").awaitTermination()
    assert store.events().count() == 1
    assert tail.resume({"generation": "g", "offset": 5, "partial": "a"}, "g", 9, "b") == (0, "partial_mismatch")
    path = tmp_path / "lines"
    path.write_bytes(b"one\n" + b"x" * 100 + b"\ntwo\n\nhalf")
    at = tail.position(str(path))
    for chunk in (1, 3, 50, 1000):
        got = [(r[2], r[3]) for s in tail.spans(str(path), "g", 0, at["offset"], chunk) for r in tail.read_span(s)]
        assert got == [(0, b"one\n"), (4, b"x" * 100 + b"\n"), (105, b"two\n"), (109, b"\n")]


def test_collectors_send_batches(spark, tmp_path):
    store, collectors, bucket = st.Store(spark, str(tmp_path / "s")), wire.Collectors(), wire.TokenBucket(2)
    _, token = collectors.issue("laptop", "t0")
    source = rec.Source("/h/rollout-a.jsonl", "codex", "gen")
    found = rec.parse_rollout(message("a", "2026-07-20T10:00:01Z").encode(), source)
    raws = [{"id": rec.raw_object_id(source, r), "generation": "gen", "offset": r.offset, "bytes": r.raw} for r in found]
    body = wire.encode("home", raws, [r.event for r in found], {"source_generation": "gen", "byte_offset": 10, "next_sequence": 1})
    assert ingest.ingest_batch(store, collectors, bucket, token, body, "t1", 0.0) == 1
    assert ingest.ingest_batch(store, collectors, bucket, token, body, "t2", 0.0) == 0
    assert ingest.ingest_cursor(store, collectors, token, "home")["byte_offset"] == 10
    for bad in ((token, body), ("no token", body), (token, "{")):
        with pytest.raises(wire.BatchError):
            ingest.ingest_batch(store, collectors, bucket, *bad, "t3", 0.0)
    assert sorted(r["outcome"] for r in store.table("audits").collect())[:2] == ["accepted", "accepted"] and store.table("audits").count() == 5
    assert {r["origin_collector_id"] for r in store.events().collect()} == {collectors.authenticate(token)}
    blob = b"bytes"
    assert store.put_blobs(spark.createDataFrame([(bytearray(blob),)], "bytes binary"), 0) == 1
    name = store.table("blobs").first()["blob_hash"]
    assert store.get_blob(name) == blob and store.collect_blobs(spark.createDataFrame([], "blob_hash string"), 10**6) == 1 and store.get_blob(name) is None


def test_blob_collection(spark):
    blobs = spark.createDataFrame([("used", 0), ("old", 0), ("young", 99_000), ("queued", 99_000)], "blob_hash string, stored_at long")
    raws = spark.createDataFrame([("used",)], "blob_hash string")
    queue = spark.createDataFrame([("queued",), ("used",)], "blob_hash string")
    assert {r[0] for r in retention.collectable_blobs(blobs, raws, queue, 100_000).select("blob_hash").collect()} == {"old", "queued"}


def test_records_and_globals(spark):
    records = spark.createDataFrame([], st.RECORDS)
    one = spark.createDataFrame([("r1", "g", "task", "do", "p", "t")], st.RECORDS)
    records = st.add_record(records, one)
    assert st.add_record(records, one).count() == 1
    with pytest.raises(st.RecordConflict):
        st.add_record(records, one.withColumn("content", F.lit("other")))
    made = st.create_global(spark.createDataFrame([], "global_id string, objective string"), spark.createDataFrame([("g", "o")], "global_id string, objective string"))
    assert st.create_global(made, made).count() == 1
    with pytest.raises(st.RecordConflict):
        st.create_global(made, made.withColumn("objective", F.lit("x")))
    cursors = st.cursors(spark.createDataFrame([("s", 1, 5), ("s", 2, 9)], "source_id string, batch long, offset long"))
    assert cursors.first()["offset"] == 9


def test_quiet_paths_and_rates(spark, tmp_path):
    notices = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 5.0)], "path string, at double")
    assert [r[0] for r in ingest.quiet_paths(notices, 6.0, 3.0).collect()] == ["a", "b"]
