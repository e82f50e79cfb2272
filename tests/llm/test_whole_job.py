"""Operators over cases that a bounded look would miss."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlake.llm import html_extraction, packing, toxicity


def plain_optimum(marks, penalty, window):
    """The least cost by trying every predecessor, however far."""
    spots, best = [0, *marks], [0.0]
    for j in range(1, len(spots)):
        options = []
        for i in range(j):
            gap = spots[j] - spots[i]
            m = -(-gap // window)
            options.append(best[i] + m * window - gap + (m - 1) * packing.BREAK_PENALTY)
            if gap in (window // 2, window // 4):
                options.append(best[i] + 2.0)
        best.append(min(options) + penalty[j - 1])
    return best[-1]


def plan_cost(marks, penalty, window):
    at = dict(zip(marks, penalty, strict=True))
    ends = packing.plan(np.array(marks), np.array(penalty), marks[-1], window)
    assert ends == sorted(set(ends)) and ends[-1] == marks[-1]
    cost, start = 0.0, 0
    for end in ends:
        size = end - start
        assert size <= window
        cost += min(2.0, window - size) if size in (window // 2, window // 4) and end in at else window - size
        cost += at.get(end, packing.BREAK_PENALTY)
        start = end
    return cost


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=40), st.randoms())
def test_plan_is_optimal_over_any_number_of_windows(gaps, rng):
    marks = np.cumsum(gaps).tolist()
    penalty = [rng.choice((0.0, 1.0)) for _ in marks]
    assert plan_cost(marks, penalty, 64) <= plain_optimum(marks, penalty, 64) + 1e-6


def test_plan_looks_past_many_windows():
    # Three documents of 210, 170 and 4 tokens fill six windows of 64; the first two alone leave padding.
    assert plan_cost([210, 380, 384], [0.0] * 3, 64) == pytest.approx(5 * packing.BREAK_PENALTY)


@pytest.mark.parametrize(
    ("text", "ends"),
    [("One.\nTwo.\tThree! Four", ["One.", "Two.", "Three!"]), ("\u65e5\u672c\u3002\u4e2d\u6587\uff01x", ["\u65e5\u672c\u3002", "\u4e2d\u6587\uff01"]), ("A. <|endoftext|> b. c", ["A.", "b."]), ("3.14 a.b", []), ("x  y. z", ["y."])],
)
def test_sentence_ends(text, ends):
    tool = packing.encoder("byte_bpe_50k.json")
    ids, marks = tool.parts(text)
    tokens = np.frombuffer(b"".join(ids), "<u4")
    shown = tool.vocabulary.bytes | {i: s.encode() for s, i in tool.vocabulary.special.items()}
    heads = [b"".join(shown[i] for i in tokens[:k]).decode() for k in marks.tolist()]
    assert len(heads) == len(ends) and all(h.rstrip("\n\t").endswith(e) for h, e in zip(heads, ends, strict=True))


@pytest.mark.parametrize("page", ["<head><title>x</title><body><p>Some words.</p>", "<html><head><meta charset=u><p>Some words.", "<head><template><div>no</div></template><title>x</title><main>Some words.</main>", "<head><title>x</title></head><body><p>Some words.</p></body>"])
def test_head_that_is_not_closed(page):
    assert [text for text, _, _ in html_extraction.blocks(page)] == ["Some words."]


def test_toxicity_fits_whole_texts(spark):
    rng = random.Random(4)
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3200)) + ". "
    rows = [(i, filler() + ("zzgrub here, zzgrub there." if i % 4 == 0 else "nice words here."), int(i % 4 == 0)) for i in range(80)]
    assert all("zzgrub" not in t[:20_000] for _, t, _ in rows)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_model(docs, labels)
    assert "zzgrub" in model.words
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_texts(docs, model).collect()}
    assert found == {i: y for i, _, y in rows}
