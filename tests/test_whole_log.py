"""Queries that read the whole event log, against plain versions."""

import hashlib
import random

from conftest import DATA

from threadlake import registry
from threadlake.operators import correlation as co
from threadlake.plans.fixtures import event_log


def test_merge_covers_the_whole_log(spark):
    log = event_log(spark, f"{DATA}/sf0.001")
    want = {(r["event_id"], r["kind"]) for r in log.select("event_id", "kind").collect()}
    found = [tuple(r) for r in registry.queries()["merged_events"](spark, f"{DATA}/sf0.001").collect()]
    assert len(found) == len(want) and set(found) == want
    assert {i.split(":")[0] for i, _ in found} == {"conv", "user"}


DAY = 86_400


def plain_score(x, y):
    same = x[2] is not None and x[2] == y[2]
    near = max(0, x[4] - y[5], y[4] - x[5]) <= 7 * DAY
    a, b = set(x[3]), set(y[3])
    similarity = len(a & b) / len(a | b) if a | b else 0.0
    return min(1.0, 0.65 * same + 0.15 * near + similarity * (0.20 if same else 0.85)), bool(a & b) or same or near


def test_candidates_of_any_score_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        start = rng.randrange(400) * DAY + rng.randrange(DAY)
        words = rng.sample(["alpha", "beta", "gamma", "delta", "epsilon"], rng.choice((0, 0, 0, 1, 2)))
        rows.append((f"s{i:02}", rng.choice(("codex", "grok", "opencode")), rng.choice((None, None, None, "/w")), words, start, start + rng.randrange(5 * DAY)))
    s = spark.createDataFrame(rows, "native_session_id string, family string, cwd string, terms array<string>, started_at long, ended_at long").selectExpr("*", "cast(null as string) as origin")
    best, kept = {}, set()
    for x in rows:
        for y in rows:
            if x[1] == y[1]:
                continue
            score, met = plain_score(x, y)
            if met:
                kept.add((min(x[0], y[0]), max(x[0], y[0])))
            if (y[4], y[0]) < (x[4], x[0]):
                best[x[0]] = max(best.get(x[0], (-1.0, "")), (round(score, 9), y[0]))
    kept |= {(min(k, v[1]), max(k, v[1])) for k, v in best.items()}
    assert any(v[0] == 0.0 for v in best.values()) and any(v[0] == 0.15 for v in best.values())
    scores = co.pair_scores(s, co.all_pairs(s))
    assert {(r["left_id"], r["right_id"]) for r in scores.collect()} == kept
    assert {r["native_session_id"]: (round(r["score"], 9), r["parent"]) for r in co.best_candidates(s, scores).collect()} == best
    few = co.deciding_pairs(s)
    assert {r["native_session_id"]: (round(r["score"], 9), r["parent"]) for r in co.best_candidates(s, co.pair_scores(s, few)).collect()} == best
    near = {}
    for x in rows:
        for y in rows:
            if x[1] != y[1] and (y[4], y[0]) < (x[4], x[0]) and x[4] - y[5] <= 7 * DAY:
                near[x[0]] = max(near.get(x[0], ""), y[0])
    found = {(r["a"], r["b"]) for r in co.latest_near(s).collect()}
    assert found == {(min(p), max(p)) for p in near.items()} and near


def test_every_session_has_terms_and_an_assignment(spark):
    ids = {r[0] for r in event_log(spark, f"{DATA}/sf0.001").select("native_session_id").distinct().collect()}
    assert any(i.startswith("user:") for i in ids)
    for name in ("session_terms", "session_assignments"):
        found = [r["native_session_id"] for r in registry.queries()[name](spark, f"{DATA}/sf0.001").collect()]
        assert len(found) == len(ids) and set(found) == ids


def test_excerpts_of_long_texts(spark, tmp_path):
    texts = ["a" * 2048, "a" * 2047 + "é", "日本" * 60_000, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("conversations", "events"):
        spark.read.parquet(f"{DATA}/sf0.001/{name}.parquet").limit(1).write.parquet(f"{tmp_path}/{name}.parquet")
    found = {r["doc_id"]: (r["bytes"], r["excerpt_md5"], r["truncated"]) for r in registry.queries()["excerpts"](spark, str(tmp_path)).collect()}
    plain = lambda t: t if len(t.encode()) <= 2048 else t.encode()[:2045].decode(errors="ignore") + "…"
    assert found == {i: (len(t.encode()), hashlib.md5(plain(t).encode()).hexdigest(), len(t.encode()) > 2048) for i, t in enumerate(texts)}


def test_latest_near_at_the_edges(spark):
    """Whole days only, so that spans often touch, tie and lie exactly a window apart."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        start = rng.randrange(60) * DAY
        rows.append((f"s{i:03}", rng.choice(("codex", "grok", "opencode")), start, start + rng.choice((0, 0, 1, 7, 20)) * DAY))
    s = spark.createDataFrame(rows, "native_session_id string, family string, started_at long, ended_at long")
    near = {}
    for x in rows:
        for y in rows:
            if x[1] != y[1] and (y[2], y[0]) < (x[2], x[0]) and x[2] - y[3] <= 7 * DAY:
                near[x[0]] = max(near.get(x[0], ""), y[0])
    assert {(r["a"], r["b"]) for r in co.latest_near(s).collect()} == {(min(p), max(p)) for p in near.items()}
    assert any(x[2] - y[3] == 7 * DAY for x in rows for y in rows if near.get(x[0]) == y[0])
    assert co.latest_near(s.limit(0)).count() == 0
