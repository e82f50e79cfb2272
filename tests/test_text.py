import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlake.functions import chronology as ch
from threadlake.functions import text as t
from threadlake.operators import search as se
from threadlake.operators.handoff import redact

TEXTS = ["", "a b\nc", "my API_KEY=1 is Bearer abc", "sk-123 task-sk-1", "x" * 100, "Crème brûlée, naïve!", "tab\tpassword:x", None, "  lead and trail  "]


def test_redaction_column_equals_plain(spark):
    frame = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    got = [r[0] for r in frame.select(t.redact(F.col("x"))).collect()]
    assert got == [None if x is None else redact(x) for x in TEXTS]
    assert redact("my API_KEY=1 is Bearer abc") == "my [REDACTED] is [REDACTED] abc"


def test_titles(spark):
    rows = [("user_message", '{"text":"hello"}'), ("user_message", '{"text":"hello","title":" "}'), ("assistant_message", '{"name":"N"}'), ("tool_call", '{"title":"T"}'), ("user_message", '{"text":5}'), ("user_message", "no json")]
    frame = spark.createDataFrame(rows, "k string, p string")
    title, priority = t.title_candidate(F.col("k"), F.col("p"), ("tool_call",))
    assert [tuple(r) for r in frame.select(title, priority).collect()] == [("hello", 1), (None, 2), ("N", 0), (None, 2), (None, 2), (None, 2)]


@given(st.text(max_size=60), st.integers(min_value=3, max_value=80))
def test_cut_bytes(text, limit):
    out, cut = t.cut_bytes(text, limit)
    assert len(out.encode()) <= max(limit, 3)
    assert (out == text) != cut or not cut
    if cut:
        assert out.endswith("…") and text.startswith(out[:-1])


def test_times(spark):
    stamps = ["2026-07-20T14:31:22.192Z", "2026-07-20T14:31:22.000000001+01:00", "2026-07-20T14:31:22Z", "2026-07-20", "tomorrow", "1600-01-01T00:00:00Z", "2500-12-31T23:59:59.5Z", None]
    frame = spark.createDataFrame([(s,) for s in stamps], "s string")
    got = [tuple(r) for r in frame.select(ch.seconds(F.col("s")), ch.nanos(F.col("s"))).collect()]
    assert got[0] == (1784557882, 192_000_000)
    assert got[1] == (1784557882 - 3600, 1)
    assert got[2] == (1784557882, 0)
    assert got[3] == got[4] == got[7] == (None, None)
    assert got[5][0] < 0 and got[6] == (got[6][0], 500_000_000)
    precisions = [r[0] for r in frame.limit(3).select(ch.precision(F.col("s"))).collect()]
    assert precisions == ["millisecond", "nanosecond", "second"]


@pytest.mark.parametrize(("remote", "want"), [("git@GitHub.com:Owner/Repo.git", "github.com/Owner/Repo"), ("https://user@Example.com/a/b.git", "example.com/a/b"), ("ssh://git@host/x", "host/x"), ("/local/path", "/local/path")])
def test_remotes(spark, remote, want):
    assert spark.createDataFrame([(remote,)], "r string").select(t.normalized_remote(F.col("r"))).first()[0] == want


LOG = [("e1", '{"text":"The quick brown fox"}'), ("e2", '{"output":"quick-brown café"}'), ("e3", '{"text":"brown quick"}'), ("e4", '{"other":"quick"}')]


@pytest.fixture(scope="module")
def searchable(spark):
    return se.with_tokens(spark.createDataFrame(LOG, "event_id string, payload_json string")).persist()


@pytest.mark.parametrize(
    ("query", "want"),
    [("quick", "123"), ('"quick brown"', "12"), ("quick AND fox", "1"), ("fox OR cafe", "12"), ("quick NOT fox", "23"), ("bro*", "123"), ("^brown", "3"), ("NEAR(brown quick, 0)", "123"), ("NEAR(the fox, 1)", ""), ("NEAR(the fox, 2)", "1"), ("(fox OR cafe) AND quick", "12"), ("quick + brown", "12"), ("searchable_text : fox", "1"), ("CAFÉ", "2")],
)
def test_query_language(searchable, query, want):
    got = searchable.where(se.query_filter(query, F.col("searchable"))).select("event_id").collect()
    assert "".join(sorted(r[0][1] for r in got)) == want


@pytest.mark.parametrize("query", ["", "(a", "a AND", '"open', "nosuch : a", "NEAR(a"])
def test_bad_queries(query):
    with pytest.raises(se.QueryError):
        se.query_filter(query, F.lit(""))


def test_plain_queries(searchable):
    assert {r[0] for r in searchable.where(se.keyword_filter("quick-brown fox", F.col("searchable"))).select("event_id").collect()} == {"e1"}
    for bad in ("", "  ", "x" * 257):
        with pytest.raises(se.QueryError):
            se.keyword_terms(bad)
    assert se.decode_cursor("a", se.encode_cursor("a", "x:y")) == "x:y"
    with pytest.raises(ValueError):
        se.decode_cursor("b", se.encode_cursor("a", "x"))


def test_sensitive_fields_are_those_of_the_plain_reader(spark):
    import json
    import random

    from threadlake.functions.pointers import sensitive_fields
    from threadlake.sources.records import sensitive_pointers

    rng = random.Random(3)
    names = ["a", "token", "X-Api_Key", "b/c~d", "password~/1", "SECRETS", "", "é"]

    def value(depth):
        pick = rng.random()
        if depth and pick < 0.45:
            return {rng.choice(names): value(depth - 1) for _ in range(rng.randint(0, 4))}
        if depth and pick < 0.75:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, 1, 2.5, "token", True])

    docs = [value(5) for _ in range(60)]
    rows = [(k, json.dumps(d)) for k, d in enumerate(docs)] + [(100, None), (101, "{broken"), (102, "")]
    got = sorted(map(tuple, sensitive_fields(spark.createDataFrame(rows, "id long, doc string"), "id", "doc").collect()))
    assert got == sorted((k, p) for k, d in enumerate(docs) for p in sensitive_pointers(d)) and len({p.count("/") for _, p in got}) > 3
    assert sensitive_fields(spark.createDataFrame([], "id long, doc string"), "id", "doc").count() == 0


def test_excerpts_without_python(spark):
    texts = ["", None, "a" * 20, "a" * 21, *("a" * k + c * 9 for k in range(21) for c in "aé日𝄞")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", "text", t.excerpt(F.col("text"), 20).alias("cut"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    for r in rows.collect():
        assert tuple(r["cut"]) == ((None, False) if r["text"] is None else t.cut_bytes(r["text"], 20))


def test_tokens_slice_by_slice(spark):
    texts = ["", None, "Straße, ÉTÉ 日本", "x" * 300_000 + " Y", None, *(f"a{i} b" * 9000 for i in range(40)), ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1).select("text", t.tokens(F.col("text")).alias("tokens"))
    for r in rows.collect():
        assert r["tokens"] == ([] if r["text"] is None else t.folded_tokens(r["text"]))


def test_tokens_of_a_large_batch_are_not_all_in_python():
    texts = pa.array([" ".join(f"word{i % 97}x{k}" for k in range(100)) for i in range(6000)])
    assert t.token_lists(pa.array([], pa.string())).to_pylist() == []
    tracemalloc.start()
    found = t.token_lists(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All 600,000 tokens as Python strings take over 30 MB.
    assert len(found) == 6000 and most < 8 << 20
