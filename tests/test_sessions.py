import json

import pytest
from pyspark.sql import functions as F

from threadlake.operators import correlation as co
from threadlake.operators import handoff as ho
from threadlake.operators import timeline as tl
from threadlake.service import Service

SUMMARY = "native_session_id string, family string, cwd string, objective string, terms array<string>, started_at long, ended_at long, origin string"
LOG = "event_id string, native_session_id string, sequence long, kind string, tool_family string, cwd string, ts_seconds long, ts_nanos int, payload_json string, ingestion_id long, source_generation string, source_offset long, ingestion_sequence long, canonical_bytes long, origin_collector_id string, text string"


def log_of(spark, rows):
    full = [(f"{s}#{i}", s, i, kind, fam, "/w/", at, ns, json.dumps({"text": text}), i + 1, "g", i, i, len(text), None, text) for i, (s, kind, fam, at, ns, text) in enumerate(rows)]
    return spark.createDataFrame(full, LOG)


def summary(name, family, cwd, terms, origin=None, start=0):
    return (name, family, cwd, None, terms, start, start + 300, origin)


def score(spark, a, b):
    s = spark.createDataFrame([a, b], SUMMARY)
    pairs = spark.createDataFrame([(a[0], b[0])], "a string, b string")
    return co.pair_scores(s, pairs).first()


def test_scores(spark):
    terms = ["parser", "session", "sqlite"]
    row = score(spark, summary("a", "x", "/w", terms), summary("b", "y", "/w", terms[:2]))
    assert row["score"] == pytest.approx(0.65 + 0.15 + 0.2 * 2 / 3) and list(row["shared_terms"]) == ["parser", "session"]
    assert score(spark, summary("a", "x", "/w", terms), summary("b", "y", "/v", terms))["score"] == pytest.approx(1.0)
    assert score(spark, summary("a", "x", "/w", ["p"]), summary("b", "y", "/v", ["q"]))["score"] <= 0.15
    other = score(spark, summary("a", "x", "/w", terms, "c1"), summary("b", "y", "/w", terms[:2]))
    assert other["score"] < 0.8 and not other["same_workspace"]
    assert not score(spark, summary("a", "x", "/w", []), summary("b", "y", "/w", [], None, 8 * 86_400))["near_in_time"]


def test_chains_of_links(spark):
    rows = [summary(f"s{i}", "xy"[i % 2], "/w", ["one", "two"], None, i * 1000) for i in range(6)] + [summary("lone", "x", "/v", ["else"], None, 9)]
    s = spark.createDataFrame(rows, SUMMARY)
    out = {r["native_session_id"]: r["root"] for r in co.assignments(s, co.pair_scores(s)).collect()}
    assert out["lone"] == "lone" and len({out[f"s{i}"] for i in range(6)}) == 1
    assert co.time_pairs(s).count() == 12


def test_memberships(spark):
    audit = spark.createDataFrame([], co.AUDIT)
    audit = co.decide(spark, audit, "link", "gs_a", "n", "auto", "1", 0.9, co.ALGORITHM_SEED)
    audit = co.decide(spark, audit, "reject", "gs_b", "n", "me", "2")
    with pytest.raises(co.RejectedMembership):
        co.decide(spark, audit, "link", "gs_b", "n", "me", "3")
    audit = co.decide(spark, audit, "reverse", "gs_b", "n", "me", "4")
    audit = co.review(spark, audit, {"left_id": "n", "score": 0.7}, "gs_b", True, "me", "5")
    assert [(r["global_id"], r["confidence"]) for r in co.memberships(audit).collect()] == [("gs_b", 0.7)]
    audit = co.review(spark, audit, {"left_id": "n", "score": 0.7}, "gs_c", False, "me", "6")
    assert {r["global_id"] for r in co.rejections(audit).collect()} == {"gs_c"}


def test_rejected_candidates_stay_rejected(spark):
    schema = "candidate_id string, left_id string, right_id string, score double, status string, evidence array<string>"
    known = spark.createDataFrame([("c1", "a", "b", 0.1, "rejected", ["old"]), ("c2", "a", "c", 0.2, "pending", ["old"])], schema)
    fresh = spark.createDataFrame([("c1", "a", "b", 0.9, "accepted", ["new"]), ("c3", "a", "d", 0.5, "pending", ["new"])], schema)
    out = {r["candidate_id"]: (r["status"], r["score"], r["evidence"]) for r in co.upsert_candidates(known, fresh).collect()}
    assert out == {"c1": ("rejected", 0.9, ["new"]), "c2": ("pending", 0.2, ["old"]), "c3": ("pending", 0.5, ["new"])}
    assert co.filter_candidates(fresh, "C3", pending_only=True).count() == 1


def test_chronology_and_pages(spark):
    rows = [("s", "user_message", "f", -11676096000, 0, "a"), ("s", "user_message", "f", 5, 2, "b"), ("s", "user_message", "f", 5, 1, "c"), ("s", "user_message", "f", 16725225600, 0, "d")]
    log = log_of(spark, rows)
    assert [r["sequence"] for r in tl.events_page(log).collect()] == [0, 2, 1, 3]
    service = Service(log)
    page, more = service.events_page(limit=3)
    assert [r["sequence"] for r in page] == [0, 2, 1] and more == "v1:events:s#1"
    page, more = service.events_page(after=more, limit=3)
    assert [r["sequence"] for r in page] == [3] and more is None
    with pytest.raises(ValueError):
        tl.events_page(log, after="nowhere")
    with pytest.raises(ValueError):
        service.events_page(limit=201)
    assert [r["text"] for r in service.conversation("s", 2).collect()] == ["b", "d"]
    assert service.native_sessions(limit=1)[0][0]["title"] == "a"
    assert service.search("a").count() == 1 and service.search_query("a OR b").count() == 2
    assert service.recent_sessions().count() == 1


def test_context_keeps_its_newest_event(spark):
    log = log_of(spark, [("s", "user_message", "f", i, 0, "x" * 100) for i in range(5)])
    assert tl.bounded_context(log, most_bytes=10).count() == 1
    assert tl.bounded_context(log, most_bytes=250).count() == 2


def test_carry_forward_and_calls(spark):
    rows = [("f", 0, "session_start", "/w", None, None, None), ("f", 1, "tool_call", None, "b", None, "c"), ("f", 2, "tool_result", None, None, None, "c"), ("f", 3, "tool_result", "/v", None, None, "d")]
    frame = spark.createDataFrame(rows, "source_path string, source_offset long, kind string, cwd string, branch string, head string, call_id string")
    out = tl.matched_calls(tl.carry_workspace(frame)).orderBy("source_offset").collect()
    assert [(r["cwd"], r["branch"], r["matched_call"]) for r in out] == [("/w", None, None), ("/w", "b", None), ("/w", "b", True), ("/v", "b", False)]


def event(i, kind, **payload):
    return {"event_id": f"e{i}", "kind": kind, "payload": payload}


def test_handoff_facts():
    events = [event(1, "decision", text="Use B"), event(2, "decision", text="Use A"), event(3, "task", title="T1"), event(4, "plan", text="P", status="Completed"), event(5, "file_read", path="/f"), event(6, "command_result", passed=3, failed=1, failing=["x password=1"]), event(7, "user_message", text="please"), event(8, "assistant_message", text="done"), event(9, "decision", text="Use A"), event(10, "user_message", text="  "), event(11, "task", text=" ", title="hidden")]
    d = ho.generate("gs_1", "Go on", events, [{"kind": "task", "content": "R", "provenance_id": "r1"}])
    assert d["decisions"] == ["Use A", "Use B"] and d["completed"] == ["P"] and d["open_tasks"] == ["T1", "R"]
    assert d["tests"] == {"passed": 3, "failed": 1, "failing": ["x [REDACTED]"]} and d["relevant_files"] == ["/f"]
    assert d["status"] == {"phase": "implementation", "completion": 33} and d["next_action"] == "T1"
    assert d["latest_user_request"] == "please" and d["latest_assistant_reply"] == "done"
    assert [p["event_id"] for p in d["provenance"] if p["field"] == "decisions"] == ["e1", "e2"]


def test_messages_alone_imply_nothing():
    d = ho.generate("gs_1", "Go on", [event(1, "user_message", text="hi")])
    assert (d["status"]["phase"], d["next_action"], d["open_tasks"]) == ("unknown", "Review the latest user request", [])


def test_handoff_errors_and_budget():
    say = [event(1, "user_message", text="hi")]
    for bad in (("x", "o", say), ("gs_1", " ", say), ("gs_1", "o", [])):
        with pytest.raises(ho.HandoffError):
            ho.generate(*bad)
    with pytest.raises(ho.HandoffError):
        ho.generate("gs_1", "o", say, budget=63)
    many = [event(i, "file_write", path=f"/file/{i:04}") for i in range(400)] + say
    d = ho.generate("gs_1", "o", many, budget=600)
    assert ho.approximate_tokens(d) <= 600 and d["latest_user_request"] == "hi" and 0 < len(d["relevant_files"]) < 400
    assert len([p for p in d["provenance"] if p["field"] == "relevant_files"]) == len(d["relevant_files"])


def plain_fit(document, budget):
    """Drops item by item and measures the whole document each time."""
    while ho.approximate_tokens(document) > budget:
        field = next((f for f in ("relevant_files", "completed", "decisions") if document[f]), None)
        if field is None and len(document["open_tasks"]) > 1:
            field = "open_tasks"
        if field is not None:
            document[field].pop()
        elif len(document["provenance"]) > 1:
            field = next((f for f in reversed(ho.LATEST) if f in document), None)
            if field is not None:
                del document[field]
        if field is None:
            raise ho.HandoffError("the budget is too small")
        at = [i for i, r in enumerate(document["provenance"]) if r["field"] == field]
        if at:
            del document["provenance"][at[-1]]


def test_trimming_by_sizes_equals_trimming_by_measuring():
    import copy
    import random
    import time

    rng = random.Random(6)
    for _ in range(60):
        events = [event(i, rng.choice(("decision", "task", "plan", "file_read")), text="é" * rng.randint(1, 9) + str(rng.randrange(30)), path=f"/{rng.randrange(40)}", status=rng.choice(("completed", "open"))) for i in range(rng.randint(0, 40))]
        whole = ho.generate("gs_1", "o", [*events, event(90, "user_message", text="hi"), event(91, "assistant_message", text="ho")], budget=1 << 30)
        for budget in (64, 90, 120, 200, 400, 900):
            ours, theirs, refused = copy.deepcopy(whole), copy.deepcopy(whole), False
            try:
                plain_fit(theirs, budget)
            except ho.HandoffError:
                refused = True
            if refused:
                with pytest.raises(ho.HandoffError):
                    ho.fit_budget(ours, budget)
            else:
                ho.fit_budget(ours, budget)
                assert ours == theirs
    document = ho.generate("gs_1", "o", [*(event(i, "file_write", path=f"/file/{i:05}") for i in range(5000)), event(9999, "user_message", text="hi")], budget=1 << 30)
    began = time.perf_counter()
    ho.fit_budget(document, 600)
    assert time.perf_counter() - began < 0.5 and ho.approximate_tokens(document) <= 600


def test_suggestions_fill_only_gaps():
    say = [event(1, "user_message", text="hi")]
    d = ho.generate("gs_1", "o", say, suggest=lambda x: json.dumps({"open_tasks": ["do secret"], "next_action": "n"}))
    assert d["open_tasks"] == ["do [REDACTED]"] and d["next_action"] == "n"
    assert ho.generate("gs_1", "o", say, suggest=lambda x: "broken")["open_tasks"] == []


def test_handoffs_in_spark(spark):
    log = log_of(spark, [("s", "user_message", "f", 1, 0, "hello"), ("s", "assistant_message", "f", 2, 0, "yes"), ("t", "tool_call", "f", 3, 0, "")])
    members = spark.createDataFrame([("gs_1", "s"), ("gs_2", "t")], "global_id string, native_session_id string")
    globals_ = spark.createDataFrame([("gs_1", "o", "2"), ("gs_2", "o", "2")], "global_id string, objective string, updated_at string")
    rows = ho.handoffs(log, members, globals_).collect()
    assert [r["global_id"] for r in rows] == ["gs_1"] and json.loads(rows[0]["document"])["latest_user_request"] == "hello"
    made = ho.handoffs(log, members, globals_).withColumn("created_at", F.lit("1"))
    assert ho.stale(ho.latest_handoff(made), globals_).first()["stale"]
    facts = ho.fact_sets(spark.createDataFrame([("s", "decision", '{"text":"b"}'), ("s", "task", '{"title":"t","status":"completed"}'), ("s", "patch", '{"path":"/p"}')], "native_session_id string, kind string, payload_json string")).first()
    assert (facts["decisions"], facts["completed"], facts["open_tasks"], facts["relevant_files"]) == (["b"], ["t"], [], ["/p"])


def test_reconcile_keeps_what_holds(spark):
    terms = [f"term{i}" for i in range(20)]
    rows = [summary("a", "x", "/w", terms, None, 0), summary("b", "y", "/w", terms[:18], None, 1000), summary("c", "x", "/w", terms[:17], None, 2000), summary("d", "y", "/v", terms, None, 3000), summary("e", "y", "/z", ["other"], None, 10), summary("old", "x", "/q", ["more"], None, 5)]
    s = spark.createDataFrame(rows, SUMMARY)
    changed = s.where("native_session_id <> 'old'").select("native_session_id")
    members = spark.createDataFrame([("gs_manual", "a"), ("gs_old", "old")], "global_id string, native_session_id string")
    rejected = spark.createDataFrame([("gs_manual", "d")], "global_id string, native_session_id string")
    got = {r["native_session_id"]: r for r in co.reconcile(s, members, changed, rejected).collect()}
    # a holds; b and c join it, c through b; d may not; e has nobody; old did not change.
    assert {k: r["global_id"] for k, r in got.items()} == {"b": "gs_manual", "c": "gs_manual", "d": co.global_id("d"), "e": co.global_id("e")}
    assert got["b"]["algorithm_version"] == co.ALGORITHM_LINK and got["d"]["confidence"] == 1.0
    assert co.newest_summaries(s, 2).count() == 2


def test_linkable_pairs_miss_none(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [summary(f"s{i}", "xyz"[i % 3], rng.choice(("/a", "/b", None)), rng.sample(words[: rng.choice((6, 12, 30))], rng.randint(0, 6)), None, rng.randrange(40) * 86_400) for i in range(120)]
    s = spark.createDataFrame(rows, SUMMARY)
    ids = [r[0] for r in rows]
    every = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "a string, b string")
    family = dict((r[0], r[1]) for r in rows)
    want = {(r["left_id"], r["right_id"]) for r in co.pair_scores(s, every).where("score >= 0.8").collect() if family[r["left_id"]] != family[r["right_id"]]}
    got = {(r["left_id"], r["right_id"]) for r in co.pair_scores(s, co.linkable_pairs(s)).where("score >= 0.8").collect()}
    assert got == want and want


def test_pending_evidence_is_scored_anew(spark):
    s = spark.createDataFrame([summary("a", "x", "/w", ["t"]), summary("b", "y", "/w", ["t"]), summary("c", "y", "/w", ["t"])], SUMMARY)
    known = co.candidates(co.pair_scores(s)).withColumn("score", F.lit(0.1)).withColumn("status", F.when(F.col("right_id") == "c", "rejected").otherwise("pending"))
    out = {r["right_id"]: (r["status"], r["score"]) for r in co.refreshed_candidates(s, known, s.select("native_session_id")).collect()}
    assert out["b"] == ("pending", pytest.approx(1.0)) and out["c"] == ("rejected", 0.1)


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    from threadlake.operators import search as se

    rows = [("s", "user_message", "x", i, 0, text) for i, text in enumerate(["the quick brown fox", "the fox-hound", "hound fox", "", "Café fox hound the", None])]
    log = log_of(spark, [r if r[5] is not None else (*r[:5], "") for r in rows])
    se.write_index(log.where("sequence < 3"), str(tmp_path / "index"))
    se.write_index(log.where("sequence >= 3"), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for query in ("fox", "fox-hound", "the fox", "cafe", "absent", "--"):
        assert se.indexed_search(log, index, query).collect() == se.search(log, query).collect()
    near = lambda q: sorted(r["sequence"] for r in se.search_query(log, q).collect())
    assert near("NEAR(the quick brown fox, 0)") == [0] and near("NEAR(fox hound, 0)") == [1, 2, 4] and near("NEAR(fox the cafe hound quick brown, 9)") == []
