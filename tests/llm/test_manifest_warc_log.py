"""Merkle manifests, WARC archives and transaction logs against plain versions."""

import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadlake.llm import merkle, prefix, txlog, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, key string, at long, _block long"


def documents(spark, rows):
    """Rows (doc_id, text, source), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 7, "k", 1, 2) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("bits", [3, 10])
def test_running_folds(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.randrange(-40, 5000), rng.choice("ab"), k, rng.randrange(9)) for k in range(200)]
    out = prefix.before(spark.createDataFrame(rows, "at long, tree string, k long, v long"), "at", {"s": ("v", "sum"), "m": ("k", "max")}, by=("tree",), ties=("k",), bits=bits).collect()
    assert len(out) == 200
    for r in out:
        earlier = [x for x in rows if x[1] == r["tree"] and (x[0], x[2]) < (r["at"], r["k"])]
        assert r["s"] == sum(x[3] for x in earlier) and r["m"] == max((x[2] for x in earlier), default=None)


def test_numbering(spark):
    names = [None, "", "b", "é", "a", "Z", "=", "-"]
    out = prefix.numbered(spark.createDataFrame([(n,) for n in names], "n string"), ["n"]).collect()
    assert [r["n"] for r in sorted(out, key=lambda r: r["pos"])] == sorted(names, key=lambda n: (n is not None, (n or "").encode()))
    assert prefix.numbered(spark.createDataFrame([], "n string"), ["n"]).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(i, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def plain_path(levels, at):
    """(left, right) at each level."""
    out = []
    for nodes in levels[:-1]:
        lo = at // 16 * 16
        out.append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + 16])))
        at //= 16
    return out


def plain_audit(rows):
    """Per (doc_id, leaf) what the query says, straight from the definition."""
    leaves = defaultdict(list)
    for i, t, s in rows:
        n = None if t is None else len(t)
        low = t if t is None or i is None or zlib.crc32(str(i).encode()) % 5 else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        leaves[s].append((i, plain_leaf(i, s, "en", n, t), plain_leaf(i, s, "en", n, low)))
    sources = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        leaves[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(plain_levels([x[1] for x in leaves[s]]))
    crown = plain_levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for at, (i, leaf, claimed) in enumerate(leaves[s]):
            path = plain_path(trees[k], at) + plain_path(crown, k)
            node = claimed
            for left, right in path:
                node = sha(left + node + right)
            out.append((i, leaf, trees[k][-1][0], crown[-1][0], sha("".join(a + b for a, b in path)), node, node == crown[-1][0]))
    return out


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def audited(spark, rows):
    return sorted((tuple(r[c] for c in NAMES) for r in merkle.audited(documents(spark, rows)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "a": 16, "": 17, "é": 257, "Z": 15}, {f"s{k}": 1 + k % 3 for k in range(40)}, {"big": 4096, "two": 4097, None: 4099}])
def test_manifest_equals_plain_trees(spark, sizes):
    rng, rows = random.Random(1), []
    for s, n in sizes.items():
        rows += [(rng.randrange(-(1 << 40), 1 << 40), rng.choice(["Äb", "Text ONE", "two", None, ""]), s) for _ in range(n)]
    assert audited(spark, rows) == sorted(plain_audit(rows), key=repr)


def test_manifest_of_odd_rows(spark):
    rows = [(None, "A", "s"), (None, None, "s"), (3, "B", "s"), (3, "B", "s"), (3, "c", "s"), (-5, "x" * 200_000, None)]
    assert audited(spark, rows) == sorted(plain_audit(rows), key=repr)
    assert audited(spark, []) == []


def test_paths_prove_membership(spark):
    rows = spark.createDataFrame([("t", k, merkle.digest(str(k))) for k in range(300)], "tree string, at long, digest string")
    manifest = merkle.build(rows)
    for r in merkle.paths(manifest).collect():
        path = list(zip(r["ks"], r["others"], strict=True))
        assert merkle.folded(merkle.digest(str(r["pos"])), path) == manifest.root != merkle.folded(merkle.digest("x"), path)
        assert r["subroot"] == manifest.root


# WARC archives.


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, b"") for r in rows], "page_id long, url string, html string, key string, chunk_no int, payload binary")


def plain_archived(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        like = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        head = max(like, default=None) if len(data) >= warc.LEAST else None
        again = head is not None and (i is None or i < head)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=repr)


def test_archives_equal_plain_records(spark):
    big, odd = "é" * 500, "z" * 999
    rows = [(1, "http://a/x y", big), (2, None, big), (7, "http://b/\r\nX: 1", big), (None, "u", big), (7, "again", big), (3, "", None), (4, "u", ""), (5, "u", odd), (6, "u", odd), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 5000), (9, "u", "q" * (3 * warc.CHUNK)), (10, "u", "q" * (3 * warc.CHUNK + 1)), (None, "u", "w" * 2000), (None, "u", "w" * 2000)]
    frame = warc.archived(pages(spark, rows))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in frame.collect()), key=repr) == plain_archived(rows)
    assert warc.archived(pages(spark, [])).count() == 0


def test_copies_beyond_the_hot_bound_meet_in_a_join(spark):
    rows = [(k, "u", f"{k % 700:04}" * 300) for k in range(1400)] + [(2000 + k, "u", "h" * 1000) for k in range(1500)]
    frame = warc.archived(pages(spark, rows)).collect()
    head = {html: max(i for i, _, h in rows if h == html) for html in {h for _, _, h in rows}}
    wanted = {i: None if head[h] == i else head[h] for i, _, h in rows}
    assert {r["page_id"]: r["refers_to"] for r in frame} == wanted


def test_chunk_table_has_every_byte_and_running_digests(spark, tmp_path):
    payloads = [bytes(random.Random(n).randrange(256) for _ in range(n)) for n in (0, 1, 9, 10, 11, 95)]
    rows = spark.createDataFrame([(k, "u", p, hashlib.sha1(p).hexdigest(), len(p), None) for k, p in enumerate(payloads)], "key long, url string, payload binary, sha1 string, bytes long, refers_to long")
    chunks = warc.chunked(rows, 10)
    assert chunks.groupBy().agg(F.max(F.length("chunk"))).first()[0] == 10
    files = warc.write_archives(chunks, str(tmp_path), roll=1)
    assert files.agg(F.sum("records")).first()[0] == 6 and files.count() >= 6 - 4
    read = sorted(warc.read_archives(files, str(tmp_path), size=4).collect(), key=lambda r: (r["record_id"], r["chunk_no"]))
    for k, p in enumerate(payloads):
        own = [r for r in read if r["record_id"] == str(k)]
        assert b"".join(r["bytes"] for r in own) == p and [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
        for r in own:
            assert r["sha1_so_far"] == hashlib.sha1(p[: r["size_so_far"]]).hexdigest() and len(r["bytes"]) <= 4
    # Other readers see ordinary gzip members.
    whole = b"".join(gzip.decompress((tmp_path / r["file"]).read_bytes()) for r in files.collect())
    assert whole.count(b"WARC/1.1\r\n") == 6 and payloads[-1] in whole


def test_broken_archives_are_told(tmp_path):
    archive = warc._Archive(str(tmp_path))
    archive.put(warc.header("1", "u", hashlib.sha1(b"abc").hexdigest(), 3, None, "d") + b"abc")
    archive.end_record()
    name, _, size = archive.close()
    data = (tmp_path / name).read_bytes()
    assert size == len(data) and [r[5] for r in warc.stream_archive(io.BytesIO(data))] == [b"abc"]
    for bad in (data[:-5], data[: len(data) // 2]):
        with pytest.raises(warc.BadArchive):
            list(warc.stream_archive(io.BytesIO(bad)))
    with pytest.raises(warc.BadArchive):
        list(warc.stream_archive(io.BytesIO(gzip.compress(gzip.decompress(data).replace(b"abc", b"abd")))))
    with pytest.raises(warc.BadArchive):
        list(warc.stream_archive(io.BytesIO(gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"))))


# Transaction logs.


def plain_log(records, every):
    """(states, undone) by walking the log record by record."""
    records = sorted(records, key=lambda r: (r[0], r[1], (r[4] is not None, r[4] or 0)))
    live, marks, gone, commits = defaultdict(list), defaultdict(list), [], []
    for i, tree, op, key, code in records:
        if op == "change":
            live[tree].append((i, key, code))
        elif op == "savepoint":
            marks[tree].append(len(live[tree]))
        elif op == "rollback":
            keep = marks[tree].pop() if marks[tree] else 0
            gone += [("rollback", d, i, k) for d, k, _ in live[tree][keep:]]
            del live[tree][keep:]
        else:
            if op == "commit":
                commits.append(live[tree])
            else:
                gone += [("abort", d, i, k) for d, k, _ in live[tree]]
            live[tree], marks[tree] = [], []
    gone += [("abort", d, None, k) for rest in live.values() for d, k, _ in rest]
    store, states = {}, []
    for n, changes in enumerate(commits, 1):
        for _, key, code in changes:
            store[key] = code
        if n % every == 0 or n == len(commits):
            held = [c for c in store.values() if c is not None]
            states.append((len(states) + 1, len(held), sum(held)))
    return states, gone, {k for k, c in store.items() if c is not None}


@pytest.mark.parametrize("seed", range(4))
def test_log_equals_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    records = []
    for i in range(600):
        op = rng.choices(("change", "savepoint", "rollback", "commit", "abort"), (12, 4, 3, 1 + 2 * (seed % 2), 0.5))[0]
        key = rng.randrange(12) if op == "change" else None
        tree = "hot" if rng.random() < 0.5 else rng.choice("abc")
        records.append((i * 3000 - 5000 if seed < 3 else i // 2, tree, op, key, None if op != "change" or rng.random() < 0.2 else rng.randrange(1 << 32)))
    if seed == 3:  # rows of one doc_id: of different sources, or equal kinds in different order
        records = [r for k, r in enumerate(records) if k % 2 == 0 or r[1] != records[k - 1][1]]
    frame = spark.createDataFrame(records, "doc_id long, tree string, op string, key long, code long")
    done = txlog.reassembled(frame, every=3)
    states, gone, keys = plain_log(records, 3)
    assert sorted((r["epoch"], r["n"], r["value"]) for r in txlog.states(done).collect()) == states
    assert sorted(((r["kind"], r["doc_id"], r["by"], r["key"]) for r in txlog.undone(done).collect()), key=repr) == sorted(gone, key=repr)
    assert {r["key"] for r in txlog.store_after(done).collect()} == keys


def test_log_of_documents(spark):
    rows = [(i, None if i % 7 == 0 else f"text {i}", None if i % 3 else "s") for i in range(400)] + [(None, "no record", "s")]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 400, 2)] + [(4, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    records = []
    for i, t, s in rows[:-1]:
        h = zlib.crc32(str(i).encode())
        kind, key = h % 17, h // 100 % 30_000
        op = "commit" if kind <= 1 else "abort" if kind == 2 else "savepoint" if kind <= 4 else "rollback" if kind <= 6 else "change"
        bad = t is None or i % 10 == 0 or i == 4
        records.append((i, "-" if s is None else "=" + s, op, key if op == "change" else None, None if bad or op != "change" else zlib.crc32(f"{key}:{t}".encode())))
    states, gone, _ = plain_log(records, 64)
    out = txlog.replay(documents(spark, rows), labels).collect()
    assert sorted(tuple(r)[1:] for r in out if r["kind"] == "state") == states
    assert sorted((tuple(r) for r in out if r["kind"] != "state"), key=repr) == sorted(gone, key=repr)
    assert txlog.replay(documents(spark, []), labels).count() == 0
