"""Pages, urls, near copies, repeats and the pipeline against plain versions."""

import collections
import random
import re
import sys
import time
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.llm import components, html_extraction, ngram_join, repeats, url_templates

sys.path.insert(0, str(Path(__file__).resolve().parent))
import more_pages  # noqa: E402
from hand_made_pages import PAGES  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_components(docs, n, p, q):
    sets = {}
    for k, t in docs:
        words = WORD.findall((t or "").translate(LOWER))
        sets[k] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and q * len(x & y) >= p * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {k: (len(sets[k]), find(k)) for k in keys}


def near_copies(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    out = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(rng.choice((" ", "\n", "  ")).join(words).title() if rng.random() < 0.3 else " ".join(words))
    return out + ["", None, " \t ", "one", "ONE", "two words", "É é", "é É", "one\x0btwo"]


@pytest.mark.parametrize(("seed", "n", "share", "short", "block"), [(1, 3, (90, 100), 64, 1024), (2, 5, (80, 100), 3, 4), (3, 3, (90, 100), 2, 3)])
def test_join_equals_plain(spark, seed, n, share, short, block):
    texts = near_copies(seed)
    docs = spark.createDataFrame([(i, t, "clash", "x") for i, t in enumerate(texts)], "doc_id long, text string, node string, key string")
    out = ngram_join.jaccard_components(docs.repartition(3), n=n, share=share, short=short, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == plain_components(list(enumerate(texts)), n, *share)


def test_join_of_nothing_and_repeated_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (5, None)], "doc_id long, text string")
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    out = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect())
    assert out == [("3", 2, 3), ("3", 2, 3), ("5", 0, 5), ("None", 2, 3)]


def test_fragments_follow_the_order():
    rng = np.random.default_rng(1)
    order = ngram_join.Order(rng.integers(0, 50, ngram_join.CELLS))
    grams = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    ranked, level = order.sorted(grams)
    parts = order.fragment(ranked, level)
    assert (np.diff(parts) >= 0).all() and set(parts) == set(range(ngram_join.FRAGMENTS))


@pytest.mark.parametrize("small", [0, 1000])
def test_long_chain_of_links(spark, small):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    out = {r["node"]: r["component"] for r in components.components(edges, small).collect()}
    assert {out[i] for i in range(201)} == {0} and out[501] == 500


def plain_repeats(docs, length=100):
    seen, out = set(), {}
    for k, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(data), sum(gone), runs, kept)
    return out


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    common = [text(n) for n in (60, 99, 100, 101, 180, 400)]
    docs = []
    for _ in range(60):
        docs.append("".join(rng.choice(common) if rng.random() < 0.4 else text(rng.randint(0, 150)) for _ in range(rng.randint(0, 6))))
    return [*docs, docs[3], docs[3], "", None, "ab" * 300, "a" * 350, "x" * 99, common[4] * 3, "日本語テキスト" * 40]


@pytest.mark.parametrize(("seed", "length", "start"), [(1, 100, 32), (2, 100, 32), (3, 100, 5), (4, 40, 40), (5, 230, 16)])
def test_repeats_equal_plain(spark, seed, length, start):
    texts = list(enumerate(passages(seed)))
    docs = spark.createDataFrame([(i, t, i * 2) for i, t in texts], "doc_id long, text string, lo int").repartition(4)
    out = repeats.remove_repeats(docs, carry=("lo",), length=length, start=start).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out} == plain_repeats(texts, length)
    assert all(r["lo"] == r["doc_id"] * 2 for r in out)


def test_repeats_of_any_keys_and_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(700_000))
    texts = [("b", long[1000:1400] + "x" * 20 + long[500_000:500_300]), ("a", long), ("c", long[262_100:262_300]), ("aa", long[-150:] + "é" + long[:150])]
    docs = spark.createDataFrame(texts, "doc_id string, text string").repartition(3)
    out = repeats.remove_repeats(docs).collect()
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in out}
    assert got == {"a": (0, 0), "aa": (300, 2), "b": (700, 2), "c": (200, 1)}
    days = docs.selectExpr("date_add(date'2024-01-01', ascii(doc_id) + length(doc_id)) doc_id", "text")
    assert sorted(r["n_removed"] for r in repeats.remove_repeats(days).collect()) == [0, 200, 300, 700]


def test_rounds_double_what_windows_share():
    assert [b.tolist()[:3] for b in repeats.cells(100, 32)] == [[0, 69], [0, 35, 69], [0, 6, 12], [0, 1, 2]]
    for length, start in ((100, 1), (1000, 30)):
        rounds = repeats.cells(length, start)
        assert all(b[0] == 0 and b[-1] == length - start + 1 and set(a) <= set(b) for a, b in zip(rounds, rounds[1:], strict=False))


def test_repeats_of_nothing_and_equal_keys(spark):
    docs = spark.createDataFrame([(1, "q" * 150), (1, "q" * 150), (None, "z" * 40), (1, "other")], "doc_id long, text string")
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    out = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(docs).collect())
    assert out == [("1", 5, 0), ("1", 150, 149), ("1", 150, 149), ("None", 40, 0)]
    text = repeats.remove_repeats(spark.createDataFrame([(1, "é" * 60 + "x"), (2, "a" + "é" * 60)], "doc_id long, text string"), as_text=True).collect()
    assert all("�" not in r["kept"] for r in text)


def test_slices_find_what_one_scan_finds():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 900).astype(np.uint8)
    offsets = np.array([0, 300, 300, 420, 900])
    prefix, stretch, text, lo, n, place = repeats.positions(data, offsets)
    covered = sorted((t, w) for t, a, m in zip(text, lo, n, strict=True) for w in range(a, a + m))
    assert covered == [(t, w) for t in range(4) for w in range(offsets[t + 1] - offsets[t] - 99)]
    for p, t, a, k in zip(prefix, text, lo, place, strict=True):
        alone = repeats.positions(data[offsets[t] + a : offsets[t] + a + 100], np.array([0, 100]))
        assert alone[0][0] == p and alone[5][0] == k


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><p>Site name</p></header><nav class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve your experience</p></div><div class="ad">Buy now</div>
<article><h1>A fine &amp; long title</h1><p>First   paragraph with <b>bold</b> words, and more of them.<p>Second paragraph is here&nbsp;too, with a comma and a full stop.</p><!-- hidden --></article>
<section id="comments"><h3>Comments</h3><div class="comment"><span class="author">Ann</span><p>Nice read, thanks a lot!</p></div></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other</a></li></ul></aside><form class="subscribe"><label>Email</label><input name=q><button>Go</button></form>
<footer>&copy; 2026 all rights reserved</footer></body></html>"""
WANT = "A fine & long title\n\nFirst paragraph with bold words, and more of them.\n\nSecond paragraph is here too, with a comma and a full stop."


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "plain text only", "x"), (5, "u", "<article><p>cut <b", "x"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_extraction.extract(pages).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    texts = collections.defaultdict(set)
    for r in out:
        texts[r["page_id"]].add(r["text"])
    assert texts[1] == {WANT} and texts[2] == texts[3] == {""}
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_labeller_on_unseen_layouts():
    model = html_extraction.Labeller()
    model.w = html_extraction.trained()
    test = [html_extraction.labelled(seed) for seed in range(50_000, 50_150)]
    found = model.label([x for x, _ in test])
    right = np.concatenate([f == (y > 0) for f, (_, y) in zip(found, test, strict=True)])
    assert right.mean() > 0.98


@pytest.mark.parametrize("pages", [PAGES, [p[1:] for p in more_pages.PAGES[::2]], [p[1:] for p in more_pages.PAGES[1::2]]], ids=["earlier", "looked at", "unseen"])
def test_labeller_on_pages_made_by_hand(pages):
    """Layouts, words and marks that training doesn't make up."""
    model = html_extraction.Labeller()
    model.w = html_extraction.trained()
    right = given = wanted = 0
    for page, want in pages:
        got = collections.Counter(t for t in html_extraction.main_texts([page], model)[0].split("\n\n") if t)
        right += (got & collections.Counter(want)).total()
        given, wanted = given + got.total(), wanted + len(want)
    assert right >= 0.95 * given and right >= 0.93 * wanted


def test_words_of_scripts_without_spaces():
    assert html_extraction.words_of("Ein Wort") == ["ein", "wort"] and html_extraction.words_of("Donaudampfschifffahrtsgesellschaft") == ["donaudampfschifffahrtsgesellschaft"]
    assert html_extraction.words_of("京都の春は桜の花とともに ok") == ["京都の", "春は桜", "の花と", "ともに", "ok"]


class PlainBlocks(HTMLParser):
    """Leaf blocks by the library's reader, for pages whose end tags are all there."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.found, self.parts, self.hidden = [], [], 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.found.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in html_extraction.INLINE:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self.hidden += tag in html_extraction.DARK

    def handle_endtag(self, tag):
        if tag not in html_extraction.INLINE:
            self.flush()
        self.hidden -= tag in html_extraction.DARK

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_blocks_equal_the_library_reader():
    for seed in range(200):
        page, _ = html_extraction.sample_page(seed)
        assert [b[0] for b in html_extraction.blocks(page)] == PlainBlocks(page).found


@pytest.mark.parametrize("page", ["<div>w " * 20_000, "<b>a " * 20_000, "<b>" * 20_000 + "<hr>x" * 20_000, "<div>" * 20_000 + "</p></td>" * 20_000, "<head>" + "<template><div>" * 10_000, "<a \"x " * 20_000, "<" * 50_000])
def test_blocks_of_unclosed_tags_take_linear_time(page):
    began = time.process_time()
    html_extraction.blocks(page)
    assert time.process_time() - began < 3


def test_gradients():
    model = html_extraction.Labeller(1)
    rng = np.random.default_rng(0)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, sizes = rng.standard_normal((4, 3, html_extraction.WIDTH)), np.array([4, 2, 3])
    y = rng.integers(0, 2, (4, 3)).astype(float)
    _, grads = model.gradients(x, y, sizes)
    for name in ("xf", "hb", "bf", "o", "c"):
        at = tuple(0 for _ in model.w[name].shape)
        kept, eps = model.w[name][at], 1e-2
        model.w[name][at] = kept + eps
        up = model.gradients(x, y, sizes)[0]
        model.w[name][at] = kept - eps
        down = model.gradients(x, y, sizes)[0]
        model.w[name][at] = kept
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 1e-3


def test_urls(spark):
    urls = [
        ("https://Www.Example.COM/en/7/x?q#f", "www.example.com", "/en/7/x", "example.com/en/7", "allow"),
        ("http://other.com/en/8", "other.com", "/en/8", "com/en/", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("x://example.net/de/81?a/b", "example.net", "/de/81", "example.net/de/8", "block"),
        ("x://a.net/de/8", "a.net", "/de/8", "net/de/", "allow"),
        ("x://org/es/", "org", "/es/", "org/es/", "block"),
        ("x://org", "org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://h?com/en/", "h", "", None, "allow"),
        ("x://ÄB.com/fr/é", "Äb.com", "/fr/é", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(urls)] + [(None, urls[0][0], "clash")], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_templates.filter_urls(pages).collect()}
    assert len(out) == len(urls) + 1
    for i, (_, *want) in enumerate(urls):
        assert [out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]] == want
    assert url_templates.filter_urls(pages.limit(0)).count() == 0


def test_templates_learn_from_rules(spark):
    rows = [(i, f"x://shop.com/en/item{i}") for i in range(40)] + [(100 + i, f"x://shop.com/fr/item{i}") for i in range(40)] + [(200, "x://shop.com/en")]
    out = {r["page_id"]: r for r in url_templates.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert out[200]["rule"] is None and out[200]["verdict"] == "block"
    assert {out[100 + i]["verdict"] for i in range(40)} == {"allow"} and out[0]["template"] == "/en/*"


def plain_templates(urls, rules, s):
    """(rule, verdict, template) by url, with the tree as nested lists of urls."""
    rows = []
    for url in urls:
        rest = (url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = min(fits, key=lambda r: (-len(r.name), r.name), default=None)
        segments = ["*" if len(x) >= s.long or re.search("[0-9]", x) else x for x in path.split("/") if x]
        rows.append((host, segments, rule, path))
    best = {}

    def grow(members, depth, template):
        family = [i for i in members if len(rows[i][1]) > depth]
        branches = collections.defaultdict(list)
        for i in family:
            branches[rows[i][1][depth]].append(i)
        count = lambda ids: (sum(rows[i][2] is not None for i in ids), sum(rows[i][2] is not None and rows[i][2].action == "block" for i in ids))
        pm, pb = count(family)
        nodes = collections.defaultdict(list)
        for name, ids in branches.items():
            m, b = count(ids)
            if name == "*" or len(branches) >= s.spread and len(branches) >= s.share * len(family):
                name = "*"
            elif m < s.support:
                name = "+"
            elif pm - m >= s.support:
                p0 = pb / pm
                if abs(b / m - (pb - b) / (pm - m)) <= s.z * (p0 * (1 - p0) * (1 / m + 1 / (pm - m))) ** 0.5:
                    name = "+"
            nodes[name] += ids
        for name, ids in nodes.items():
            m, b = count(ids)
            if m >= s.support:
                for i in ids:
                    best[i] = (f"{template}/{name}", (b + s.strength / 2) / (m + s.strength))
                grow(ids, depth + 1, f"{template}/{name}")

    for host in {r[0] for r in rows}:
        members = [i for i, r in enumerate(rows) if r[0] == host]
        m, b = sum(rows[i][2] is not None for i in members), sum(rows[i][2] is not None and rows[i][2].action == "block" for i in members)
        if m >= s.support:
            best |= dict.fromkeys(members, ("/", (b + s.strength / 2) / (m + s.strength)))
            grow(members, 0, "")
    out = {}
    for i, (_, _, rule, _) in enumerate(rows):
        template, purity = best.get(i, (None, 0.0))
        out[i] = (rule.name if rule else None, rule.action if rule else "block" if purity >= s.purity else "allow", template)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_equal_plain(spark, seed):
    import duckdb

    rng = random.Random(seed)
    word = lambda n: rng.choice("abcdefgh"[:n]) * rng.choice((1, 1, 2))
    urls = [f"http://{rng.choice(('x.com', 'y.x.com', 'z.net'))}/{word(3)}//{word(2)}/{word(8)}/{word(2)}/{rng.choice((word(2), str(rng.randint(1, 99)), 'w' * 30))}{rng.choice(('', '/', '/end?q=/a'))}" for _ in range(1200)]
    urls += [f"http://many.com/{rng.choice('ab')}/u{''.join(rng.choice('klmnop') for _ in range(6))}/{rng.choice('st')}" for _ in range(300)] + [None, "none", "q://"]
    rules = (url_templates.Rule("block", "x.com", "/a//b/c/a"), url_templates.Rule("allow", "x.com", "/a//b/c/b"), url_templates.Rule("block", "com", "/a/"), url_templates.Rule("allow", "com", "/b/"), url_templates.Rule("block", "z.net", "/b//a/"), url_templates.Rule("allow", "z.net", "/b//a/dd"))
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for settings in (url_templates.Settings(), url_templates.Settings(support=3, z=0.6, purity=0.6, spread=6, share=0.02)):
        out = url_templates.filter_urls(frame, rules, settings)
        assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
        got = out.collect()
        want = plain_templates(urls, rules, settings)
        assert {r["page_id"]: (r["rule"], r["verdict"], r["template"]) for r in got} == want
        assert max(t.count("/") for _, _, t in want.values() if t) >= 5
        db = duckdb.connect()
        db.execute("create table pages(page_id bigint, url varchar)")
        db.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, db.execute(url_templates.oracle("pages", rules, settings)).fetchall()))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    clean = [" ".join(word() for _ in range(80)) + "." for _ in range(30)]
    common = " ".join(word() for _ in range(60))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(40, clean[0], "en", "s0", 1), (41, clean[1][:-6] + "edited", "en", "s1", 1), (42, "You are a stupid idiot. Such a pathetic loser!", "en", "s0", 1), (43, common + " " + clean[2][:50], "en", "s1", 1), (44, clean[3][:60] + common, "en", "s2", 1), (45, None, None, None, None), (46, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    where = str(tmp_path)
    labels.write.parquet(f"{where}/labels.parquet")
    calm = cp.drop_toxic(spark, docs, where)
    assert {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in calm.select("doc_id").collect()} == {42}
    single = cp.drop_near_copies(spark, calm, where)
    assert {r[0] for r in calm.select("doc_id").collect()} - {r[0] for r in single.select("doc_id").collect()} == {40, 41}
    cut = cp.cut_repeats(spark, single, where)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert set(texts) == {r[0] for r in single.select("doc_id").collect()} and common[5:-5] in texts[43] and common[5:-5] not in texts[44]
    mixed = cp.mix_sources(spark, cut, where)
    assert mixed.columns == list(cp.COLUMNS)
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert copies and max(copies.values()) <= 3
    packed = cp.pack_sequences(spark, mixed, where)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, where).count() == 0
    doubled = cp.drop_near_copies(spark, docs.union(docs), where)
    assert doubled.groupBy("doc_id").count().where("count > 1").count() == 0
