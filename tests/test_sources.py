import base64
import json
import sqlite3
from pathlib import Path

import pytest

from threadlake.functions.identity import raw_id
from threadlake.sources import discovery, opencode, tail, wire
from threadlake.sources import records as r


def rollout(*rows) -> bytes:
    return b"".join((x if isinstance(x, bytes) else json.dumps(x).encode()) + b"\n" for x in rows)


def line(kind, at="2026-07-20T10:00:00Z", **payload):
    return {"type": kind, "timestamp": at, "payload": payload}


SOURCE = r.Source("/home/sessions/2026/07/20/rollout-a.jsonl", "codex", "g")


def test_rollout_kinds_and_issues():
    data = rollout(
        line("session_meta", id="S", cwd="/w", git={"branch": "main"}),
        line("response_item", type="message", role="user", content=[{"type": "text", "text": "a"}, {"text": "b"}]),
        line("event_msg", type="agent_message", message="hi"),
        line("response_item", type="function_call", call_id="c1", name="f"),
        line("response_item", type="function_call_output", call_id="c1"),
        line("response_item", type="function_call_output", call_id="c2"),
        b"{broken",
        b"[1]",
        {"timestamp": "2026-07-20T10:00:00Z"},
        {"type": "x", "timestamp": "2026-07-20"},
        {"type": "x"},
        line("turn_context", cwd="/other"),
        line("compacted", api_key="x", nested=[{"Auth_Token": 1}]),
    )
    found = r.parse_rollout(data, SOURCE)
    assert [x.event["kind"] if x.event else x.issue for x in found] == ["session_start", "user_message", "assistant_message", "tool_call", "tool_result", "tool_result", "record_malformed", "record_not_object", "type_missing", "timestamp_invalid", "timestamp_missing", "git_state", "compaction"]
    events = [x.event for x in found if x.event]
    # A bad line uses up its number.
    assert [e["sequence"] for e in events] == [0, 1, 2, 3, 4, 5, 11, 12]
    assert {e["native_session_id"] for e in events} == {"S"}
    assert events[1]["payload"]["text"] == "ab" and events[2]["payload"]["text"] == "hi"
    assert [e["payload"]["matched_call"] for e in events[4:6]] == [True, False]
    assert events[5]["workspace"]["cwd"] == "/w" and events[6]["workspace"] == {"cwd": "/other", "repository_id": None, "branch": "main", "head": None}
    assert found[-1].sensitive == ["/payload/api_key", "/payload/nested/0/Auth_Token"]
    assert found[1].offset == len(rollout(line("session_meta", id="S", cwd="/w", git={"branch": "main"})))


def test_half_line_waits():
    data = rollout(line("compacted")) + b'{"type'
    assert len(r.parse_rollout(data, SOURCE)) == 1
    assert r.complete_size(data) == len(rollout(line("compacted")))


def test_claude():
    source = r.Source("/p/sess.jsonl", "claude-code", "g")
    data = rollout(
        {"type": "user", "sessionId": "A", "timestamp": "2026-07-20T10:00:00Z", "cwd": "/w", "gitBranch": "b", "message": {"content": "hello"}},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}},
        {"type": "assistant", "message": {"content": [{"type": "tool_use"}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result"}, {"type": "tool_use"}]}},
        {"type": "summary"},
        b"nonsense",
    )
    events = [x.event for x in r.parse_claude(data, source)]
    assert [e["kind"] for e in events] == ["user_message", "assistant_message", "tool_call", "tool_result"]
    assert events[0]["native_session_id"] == "claude:A" and events[1]["native_session_id"] == "claude:sess"
    assert events[0]["workspace"]["branch"] == "b" and events[1]["workspace"] is None
    assert events[1]["payload"]["text"] == "x\ny"


def test_continue_agy_grok_opencode():
    source = r.Source("/p/c.json", "continue", "g", fallback_timestamp="2026-01-01T00:00:00+00:00")
    doc = json.dumps({"sessionId": "C", "workspaceDirectory": "/w", "history": [{"message": {"role": "user", "content": "q"}}, {"x": 1}, {"message": {"role": "assistant", "content": [{"text": "a"}]}}]}).encode()
    assert [(x.offset, x.event["kind"]) for x in r.parse_continue(doc, source)] == [(0, "user_message"), (2, "assistant_message")]
    agy = rollout({"conversationId": "a", "display": "p", "timestamp": 1767225600123}, {"conversationId": "a", "display": ""}, {"display": "x"}, {"conversationId": "a", "display": "z", "timestamp": "2026-01-01T00:00:00Z", "workspace": ""})
    events = [x.event for x in r.parse_agy(agy, source)]
    assert [e["timestamp"] for e in events] == ["2026-01-01T00:00:00.123+00:00", "2026-01-01T00:00:00Z"] and events[1]["workspace"] is None
    update = lambda kind, text="t", **x: {"timestamp": 1767225600, "params": {"sessionId": "s", "update": {"sessionUpdate": kind, "content": {"type": "text", "text": text}}}} | x
    grok = r.Source("/h/sessions/%2Fwork%2Fa+b/id/updates.jsonl", "grok", "g")
    events = [x.event for x in r.parse_grok(rollout(update("user_message_chunk"), update("tool_call"), update("agent_thought_chunk", timestamp_us=1767225600000001), update("agent_message_chunk")), grok)]
    assert [e["kind"] for e in events] == ["user_message", "unknown", "assistant_message"]
    assert events[0]["workspace"]["cwd"] == "/work/a+b" and events[1]["timestamp"] == "2026-01-01T00:00:00.000001+00:00"
    with pytest.raises(ValueError):
        r.parse_grok(b"broken\n", grok)


def test_ndjson():
    good = [{"type": "negotiated", "version": "1.0"}, {"type": "event", "event": {"event_id": "1"}}, {"type": "complete"}]
    assert r.decode_ndjson(rollout(*good)) == (good, None)
    assert r.decode_ndjson(rollout(*good) + b"{")[1] == "unterminated"
    assert r.decode_ndjson(rollout(good[1]))[1] == "negotiation_missing"
    assert r.decode_ndjson(rollout({"type": "negotiated", "version": "9"}))[1] == "version_unsupported"
    assert r.decode_ndjson(rollout(*good[:2], good[1])) == (good[:2], "duplicate_event")
    assert r.decode_ndjson(rollout(good[0], b"x"))[1] == "malformed"


def test_resume_and_chunks(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"one\ntwo\nthr")
    g = tail.generation(str(path))
    assert tail.resume(None, g, 11) == (0, "initial")
    assert tail.resume({"generation": g, "offset": 4}, g, 11) == (4, "resumed")
    assert tail.resume({"generation": "x", "offset": 4}, g, 11) == (0, "replaced")
    assert tail.resume({"generation": g, "offset": 40}, g, 11) == (0, "truncated")
    assert tail.read_chunk(str(path), 0, 5) == b"one\n"
    assert tail.read_chunk(str(path), 4, 2) == b"two\n"
    assert tail.read_chunk(str(path), 8) == b""


def test_batch_tail(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_bytes(b"x\ny\nhalf")
    tail.register(spark)
    rows = spark.read.format("jsonl_tail").option("path", f"{tmp_path}/*.jsonl").load().collect()
    assert sorted((Path(x["path"]).name, x["source_offset"], bytes(x["value"])) for x in rows) == [(f"{n}.jsonl", o, v) for n in "ab" for o, v in ((0, b"x\n"), (2, b"y\n"))]


def test_discovery(tmp_path, spark):
    day = tmp_path / "home/sessions/2026/07/20"
    day.mkdir(parents=True)
    (day / "rollout-1.jsonl").write_text("{}\n")
    (day / "other.jsonl").write_text("{}\n")
    bad = tmp_path / "home/sessions/2026/07/xx"
    bad.mkdir()
    (bad / "rollout-2.jsonl").write_text("{}\n")
    (tmp_path / "home/session_index.jsonl").write_text('{"a":1}\n[1]\nbroken\n{}\n')
    home = str(tmp_path / "home")
    report = discovery.discover_rollouts([home, home, str(tmp_path / "none")])
    assert [(Path(s.path).name, s.kind) for s in report.sources] == [("rollout-1.jsonl", "rollout"), ("session_index.jsonl", "index")]
    assert len(report.diagnostics) == 1
    assert tuple(discovery.index_health(spark, f"{home}/session_index.jsonl").first()) == (2, 2)
    assert discovery.rollout_homes(["x"], {}, "/h") == ["x"] and discovery.rollout_homes([], {"CODEX_HOME": "e"}, "/h") == ["e"] and discovery.rollout_homes([], {}, "/h") == ["/h/.codex"]
    assert discovery.expand("~/a/$X/${Y}", "/h", {"X": "1", "Y": "2"}) == "/h/a/1/2"
    with pytest.raises(ValueError):
        discovery.expand("$NO", "/h", {})
    stamps = {}
    path = str(day / "rollout-1.jsonl")
    assert not discovery.unchanged(stamps, path)
    stamps[path] = (Path(path).stat().st_size, Path(path).stat().st_mtime_ns)
    assert discovery.unchanged(stamps, path)


def test_external_discovery(tmp_path):
    for p in (".claude/projects/x/a.jsonl", ".continue/sessions/s.json", ".continue/sessions/sessions.json", ".grok/sessions/%2Fw/id/updates.jsonl"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("{}")
    assert [(f.family, Path(f.path).name) for f in discovery.discover_external(str(tmp_path))] == [("claude-code", "a.jsonl"), ("continue", "s.json"), ("grok", "updates.jsonl")]


def test_database_pages(spark, tmp_path):
    path = str(tmp_path / "o.db")
    with sqlite3.connect(path) as db:
        db.executescript("create table session(id,directory,title); create table message(id,session_id,data); create table part(id,message_id,session_id,time_created,time_updated,data)")
        db.execute("insert into session values('s','/w','t'),('old','/w','t')")
        db.execute("""insert into message values('m','s','{"role":"user"}'),('n','old','{"role":"user"}')""")
        db.executemany("insert into part values(?,?,?,?,?,?)", [(f"p{i:03}", "m", "s", i, i, json.dumps({"type": "text", "text": str(i)})) for i in range(300)])
        db.execute("""insert into part values('q','n','old',1,1,'{"type":"text","text":"z"}'),('tool','m','s',5,5,'{"type":"tool"}')""")
    opencode.register(spark)
    rows = opencode.parts(spark, path, since=200)
    assert rows.count() == 300 and opencode.high_water(rows).first()[0] == 299
    sizes, after = [], None
    while True:
        page = opencode.page(rows, after).orderBy("rank").collect()
        if not page:
            break
        sizes.append(len(page))
        after = (page[-1]["time_created"], page[-1]["id"], page[-1]["rank"])
    assert sizes == [128, 128, 44]
    out = r.parse_opencode([x.asDict() | {"message_data": json.dumps({"role": x["role"]})} for x in page or rows.limit(2).collect()], r.Source(path, "opencode", "g"))
    assert all(x.event["native_session_id"] == "opencode:s" for x in out)


def test_wire():
    record = r.parse_rollout(rollout(line("session_meta", id="S")), SOURCE)[0]
    raws = [{"id": raw_id("g", 0, record.raw), "generation": "g", "offset": 0, "bytes": record.raw}]
    body = wire.encode("src", raws, [record.event], {"offset": 5})
    assert wire.decode(body)["events"] == [record.event]
    external = [raws[0] | {"id": raw_id("g", 0, record.raw, external=True)}]
    assert wire.decode(wire.encode("src", external, [], {}))["raw_objects"][0]["bytes"] == record.raw
    for bad in (wire.encode("s", [raws[0] | {"id": "no"}], [], {}), wire.encode("s", [], [record.event | {"sequence": 9}], {}), wire.encode("s", [], [record.event | {"extra": 1}], {}), "{", json.dumps({"raw_objects": [{"bytes": "?"}], "events": []})):
        with pytest.raises(wire.BatchError):
            wire.decode(bad)
    with pytest.raises(wire.BatchError):
        wire.decode(wire.encode("s", [], [record.event] * 5001, {}))
    assert base64.b64encode(b"x")


def test_collectors_and_rates():
    c = wire.Collectors()
    name, token = c.issue("box", "2026")
    assert c.authenticate(token) == name and c.authenticate("other") is None
    assert c.revoke(name, "2027") and not c.revoke(name, "2028") and c.authenticate(token) is None
    assert wire.scoped("a", "b") == "collector:a:b"
    bucket = wire.TokenBucket(60)
    assert sum(bucket.allow("a", 0.0) for _ in range(70)) == 60
    assert bucket.allow("a", 1.0) and not bucket.allow("a", 1.0) and bucket.allow("b", 0.0)
    assert [wire.retry_delay(n, 503) for n in range(6)] == [200, 400, 800, 1600, 3200, None] and wire.retry_delay(0, 404) is None
    answers = iter([(500, None), (429, None), (200, "ok")])
    assert wire.with_retry(lambda: next(answers), lambda s: None) == "ok"
