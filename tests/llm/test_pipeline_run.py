"""The whole pipeline over a small folder: every stage's rows against a plain version of it."""

import collections
import itertools
import random
from pathlib import Path

import corpus_pipeline as cp
from threadlake.llm import toxicity
from threadlake.llm.steps import checkpoint_folder

WEIGHTS = (5, 2, 1)


def folder_of(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept string"
    full = [(i, t, "en", s, None if t is None else len(t), 1, "x") for i, t, s in rows]
    spark.createDataFrame(full, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def texts():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijkmnopé") for _ in range(rng.randint(3, 8)))
    clean = [" ".join(word() for _ in range(rng.randint(30, 160))) + "." for _ in range(36)]
    passage = " ".join(word() for _ in range(40))
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(clean)]
    rows += [(100, clean[0], "s0"), (101, clean[1] + " more", "s1"), (102, clean[1][: len(clean[1]) - 9] + "end", "s2"), (103, clean[2].upper(), "s3")]
    rows += [(110, "You are a stupid idiot. Such a loser!", "s0"), (111, "I will kill you.", "s1"), (112, "A clown performed.", "s1"), (113, "He is not an idiot.", "s2")]
    rows += [(120 + k, f"{clean[k + 5][:40]} {passage} {clean[k + 6][:30 * k]}", "s2") for k in range(4)]
    return [*rows, (130, None, "s1"), (131, "", None), (132, "lone words without a source " * 9, None)]


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(rows):
    """Of each group of rows that links of 0.8 or more join, the one of least key; rows without words stay."""
    sets = {i: shingles(t) for i, t, _ in rows}
    head = {i: i for i in sets}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            head[y] = x
    return [r for r in rows if root(r[0]) == r[0]]


def plain_cut(rows):
    """Texts without the bytes that a 100-byte string covers which starts earlier; a character goes whole."""
    seen, out = set(), []
    for i, t, s in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            window = data[k : k + 100]
            if window in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(window)
        at, kept = 0, []
        for c in t or "":
            n = len(c.encode())
            if not any(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((i, "".join(kept), s))
    return out


def plain_targets(sizes):
    """Words that each source is to give: by weight, at most twice its own, what is above dealt out anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    rest, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
        open_ -= set(over)
        rest -= sum(target[s] for s in over)
    return target


def test_every_stage_of_a_run_equals_a_plain_one(spark, tmp_path):
    where = folder_of(spark, tmp_path, texts())
    before = set(Path(checkpoint_folder(spark).removeprefix("file:")).glob("pipeline-*"))
    packed = cp.run(spark, where).collect()
    (folder,) = set(Path(checkpoint_folder(spark).removeprefix("file:")).glob("pipeline-*")) - before
    stages = [[(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{folder}/{k}").collect()] for k in range(4)]
    key = lambda r: (r[0], r[1] or "", r[2] or "")
    model = toxicity.Model().ready()
    calm = [r for r in texts() if model.score(r[1] or "") < 0.5]
    assert sorted(stages[0], key=key) == sorted(calm, key=key) and {r[0] for r in texts()} - {r[0] for r in calm} == {110, 111}
    single = plain_near(stages[0])
    assert sorted(stages[1], key=key) == sorted(single, key=key) and len(single) < len(calm) - 2
    cut = plain_cut(stages[1])
    assert sorted(stages[2], key=key) == sorted(cut, key=key) and sum(len(t or "") for _, t, _ in stages[1]) > sum(len(t) for _, t, _ in cut) + 300
    # Mixing: whole copies, each source near its target, no document beyond twice its size.
    sizes, taken = collections.Counter(), collections.Counter()
    own = {i: len(t.split()) for i, t, _ in stages[2]}
    for i, _, s in stages[2]:
        sizes[s] += own[i]
    for i, _, s in stages[3]:
        taken[s] += own[i]
    assert max(collections.Counter(i for i, _, _ in stages[3]).values()) <= 3 and {r[:2] for r in stages[3]} <= {r[:2] for r in stages[2]}
    for s, target in plain_targets({s: n for s, n in sizes.items() if n}).items():
        assert abs(taken[s] - target) <= max(own[i] for i, _, x in stages[2] if x == s)
    # Packing: every token of every copy once, in gapless sequences of at most 1024.
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokens = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in stages[3])
    assert sum(r["length"] for r in packed) == tokens
    rows = collections.defaultdict(list)
    for r in packed:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in rows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    again = cp.run(spark, where).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
