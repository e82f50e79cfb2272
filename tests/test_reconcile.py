"""Decisions on sessions against a plain loop, and the stream that makes them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import correlation as co
from threadlake.service import Service
from threadlake.streaming import ingest
from threadlake.streaming import reconcile as rc
from threadlake.streaming import store as st

SUMMARY = "native_session_id string, family string, cwd string, objective string, terms array<string>, started_at long, ended_at long, origin string"
PAIRS = "global_id string, native_session_id string"


def plain_score(x, y):
    same = x[2] is not None and x[2] == y[2]
    near = max(0, x[5] - y[6], y[5] - x[6]) <= 7 * 86_400
    a, b = set(x[4]), set(y[4])
    similarity = len(a & b) / len(a | b) if a | b else 0.0
    return min(1.0, 0.65 * same + 0.15 * near + similarity * (0.20 if same else 0.85))


def plain_decisions(rows, members, rejected):
    """Sessions one by one in order of their start; each joins its best match whose global session isn't ruled out."""
    at = {g: s for s, g in members.items()}
    where, out = dict(members), {}
    for x in sorted(rows, key=lambda r: (r[5], r[0])):
        if x[0] in members:
            continue
        found = [(round(plain_score(x, y), 9), y[0]) for y in rows if y[0] in where and y[1] != x[1]]
        found = [(score, other) for score, other in found if score >= 0.8 and (where[other], x[0]) not in rejected]
        if found:
            out[x[0]] = (where[max(found)[1]], max(found)[1])
        else:
            out[x[0]] = (co.global_id(x[0]), None)
        where[x[0]] = out[x[0]][0]
    assert len(at) <= len(members)
    return out


def random_log(rng, n):
    """Summaries of one small log, all alike enough to link in long chains, with members and rejections on them."""
    words = [f"l{n}w{k}" for k in range(12)]
    rows = []
    for k in range(rng.randint(3, 9)):
        terms = words[: rng.randint(9, 12)] if rng.random() < 0.8 else words[:2]
        rows.append((f"l{n}s{rng.randrange(100)}k{k}", rng.choice("xyz"), f"/l{n}" if rng.random() < 0.7 else None, None, terms, k * 1000 + rng.randrange(500), k * 1000 + 600, None))
    members = {r[0]: f"gs_l{n}g{rng.randrange(2)}" for r in rows if rng.random() < 0.25}
    globals_ = [*members.values(), *(co.global_id(r[0]) for r in rows)]
    # Nobody rules out the session that a native one seeds itself.
    rejected = {(g, r[0]) for r in rows for g in globals_ if rng.random() < 0.25 and g != co.global_id(r[0])}
    return rows, members, rejected


def test_200_logs_with_rejections_equal_a_plain_loop(spark):
    rng = random.Random(3)
    logs = [random_log(rng, n) for n in range(200)]
    want = {}
    for log in logs:
        want |= plain_decisions(*log)
    s = spark.createDataFrame([r for rows, _, _ in logs for r in rows], SUMMARY)
    members = spark.createDataFrame([(g, i) for _, m, _ in logs for i, g in m.items()], PAIRS)
    rejected = spark.createDataFrame([pair for _, _, ruled in logs for pair in ruled], PAIRS)
    got = {r["native_session_id"]: (r["global_id"], r["other_id"]) for r in co.reconcile(s, members, s, rejected).collect()}
    assert got == want
    chains = sum(other is not None and want.get(other, (None, None))[1] is not None for _, other in want.values())
    assert chains > 100


def test_a_rejection_on_a_chain_moves_what_follows(spark):
    rows = [(name, family, "/w", None, ["one", "two"], at, at + 10, None) for name, family, at in (("a", "x", 0), ("k_b", "y", 10), ("z_d", "x", 20))]
    s = spark.createDataFrame(rows, SUMMARY)
    members = spark.createDataFrame([("gs_G", "a")], PAIRS)
    rejected = spark.createDataFrame([("gs_G", "k_b")], PAIRS)
    got = {r["native_session_id"]: r["global_id"] for r in co.reconcile(s, members, s, rejected).collect()}
    assert got == {"k_b": co.global_id("k_b"), "z_d": co.global_id("k_b")}


def line(kind, at, **payload):
    return json.dumps({"type": kind, "timestamp": at, "payload": payload}) + "\n"


def rollout(path, session, cwd, day, texts):
    body = line("session_meta", f"2026-07-{day}T10:00:00Z", id=session, cwd=cwd)
    for k, text in enumerate(texts):
        body += line("response_item", f"2026-07-{day}T10:00:{k + 1:02}Z", type="message", role="user", content=[{"text": text}])
    path.write_text(body)


def claude(path, session, cwd, day, texts):
    path.write_text("".join(json.dumps({"type": "user", "sessionId": session, "cwd": cwd, "timestamp": f"2026-07-{day}T11:00:{k:02}Z", "message": {"content": text}}) + "\n" for k, text in enumerate(texts)))


def test_stream_decides_on_what_changed(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "store"))
    words = ["parser", "tokens", "grammar", "lexer", "syntax"]

    def read():
        ingest.ingest(spark, f"{tmp_path}/rollout-*.jsonl", "codex", store, f"{tmp_path}/cp1").awaitTermination()
        ingest.ingest(spark, f"{tmp_path}/claude-*.log", "claude-code", store, f"{tmp_path}/cp2").awaitTermination()

    rollout(tmp_path / "rollout-a.jsonl", "A", "/w", 20, [" ".join(words)])
    claude(tmp_path / "claude-b.log", "B", "/w", 20, [" ".join(words)])
    rollout(tmp_path / "rollout-lone.jsonl", "lone", "/v", 20, ["unrelated matters"])
    read()
    rc.reconcile_now(store, f"{tmp_path}/cp3")
    members = {r["native_session_id"]: r["global_id"] for r in co.memberships(store.table("decisions")).collect()}
    assert members == {"A": co.global_id("A"), "claude:B": co.global_id("A"), "lone": co.global_id("lone")}
    assert {(r["left_id"], r["right_id"], r["status"]) for r in store.candidates().collect()} == {("A", "claude:B", "accepted")}
    assert {r["global_id"] for r in store.table("handoffs").collect()} == {co.global_id("A"), co.global_id("lone")}
    done = [c.number for c in store.commits() if c.stream == rc.STREAM]
    assert len(done) == 1
    # Nothing new: nothing done.
    rc.reconcile_now(store, f"{tmp_path}/cp3")
    assert [c.number for c in store.commits() if c.stream == rc.STREAM] == done
    # A user rules a session out; a second batch touches its own sessions only.
    store.decide("reject", co.global_id("A"), "claude:C", "me", "2026-07-21")
    claude(tmp_path / "claude-c.log", "C", "/w", 21, [" ".join(words)])
    with (tmp_path / "rollout-lone.jsonl").open("a") as f:
        f.write(line("response_item", "2026-07-21T10:00:01Z", type="message", role="user", content=[{"text": "more of it"}]))
    read()
    put = store._put
    failed = []

    def once_broken(commit):
        if commit.stream == rc.STREAM and not failed:
            failed.append(commit.number)
            raise OSError("no space")
        return put(commit)

    store._put = once_broken
    rc.reconcile_now(store, f"{tmp_path}/cp3")
    assert failed
    second = next(c for c in store.commits() if c.stream == rc.STREAM and c.number not in done)
    assert second.counts["decisions"] == 1 and second.counts["summaries"] == 2 and second.counts["handoffs"] == 2
    fresh = store._read("decisions", [second]).first()
    assert (fresh["native_session_id"], fresh["global_id"], fresh["algorithm_version"]) == ("claude:C", co.global_id("claude:C"), co.ALGORITHM_SEED)
    assert {r["global_id"] for r in store._read("handoffs", [second]).collect()} == {co.global_id("claude:C"), co.global_id("lone")}
    # A user's link that is ruled out is refused; the pending candidate stays for a review.
    with pytest.raises(co.RejectedMembership):
        store.decide("link", co.global_id("A"), "claude:C", "me", "2026-07-22")
    assert store.candidates().where("status = 'pending'").count() == 1
    # A raised revision has every session summed up anew, without new memberships.
    store.bump_revision()
    rc.reconcile_now(store, f"{tmp_path}/cp3")
    third = store.commits()[-1]
    assert third.stream == rc.STREAM and third.counts["summaries"] == 4 and third.counts["decisions"] == 0
    service = Service.of(store)
    assert service.members(co.global_id("A")).count() == 2
    assert not service.current_handoff().where("global_id is null").count()
    assert {r["global_id"] for r in service.current_context().where(F.size("members") > 1).collect()} == {co.global_id("A")}
    # Compaction keeps what was decided.
    after, _ = store.maintain(str(tmp_path / "after"))
    assert co.memberships(after.table("decisions")).count() == 4 and after.summaries().count() == 4 and after.candidates().count() == 2
