"""Merkle dataset manifest: a tree of digests over each source's rows, and one over the sources.

A row's leaf is the digest of its columns. Leaves stand by key within their source
and are cut into aligned blocks of WIDTH^LEVELS; a task walks a block in postorder, returns its
root, and on the way back appends the siblings to the leaves below. Block roots are the
leaves of the next distributed traversal, until a source has one node left; the
sources' roots, in order, are the leaves of the last tree. Paths come down the
same way: a block gets the path above its root and puts its own before it.

A leaf's place comes from running counts by blocks of keys, a source's from a
sort by ranges, so neither a source with most rows nor very many sources meet in one
task. Texts are read once and hashed there; what moves is two digests a row.

Defined cases: a null column is written ``-``, which no value is; a null key comes first;
rows with one key stand by their leaf; wholly equal rows are leaves of their own;
a lone leaf is its own root and has no siblings; an empty table has no root and no
rows; columns that aren't hashed are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.prefix import before, numbered, tree_key
from threadlake.llm.steps import stored
from threadlake.llm.url_templates import LOWER, UPPER

WIDTH, LEVELS = 16, 3
BLOCK = WIDTH**LEVELS
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FIRST = -(1 << 63)

Path = list[tuple[int, str]]
Finish = Callable[[pd.DataFrame, list[Path], Path, str | None], pd.DataFrame]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels until n nodes are one."""
    h = 0
    while WIDTH**h < n:
        h += 1
    return h


def traverse(leaves: Sequence[str], levels: int, paths: list[Path] | None = None) -> str:
    """The root of one subtree; paths get each leaf's (place in its run, its siblings) level by level."""

    def visit(lo: int, h: int) -> str:
        if h == 0:
            return leaves[lo]
        step = WIDTH ** (h - 1)
        starts = range(lo, min(lo + WIDTH * step, len(leaves)), step)
        nodes = [visit(at, h - 1) for at in starts]
        if paths is not None:
            for k, at in enumerate(starts):
                others = "".join(nodes[:k] + nodes[k + 1 :])
                for leaf in range(at, min(at + step, len(leaves))):
                    paths[leaf].append((k, others))
        return digest(*nodes)

    return visit(0, levels)


def folded(leaf: str, path: Path) -> str:
    """The root that a leaf and its siblings give."""
    for k, others in path:
        leaf = digest(others[: HEX * k], leaf, others[HEX * k :])
    return leaf


def _levels(block: int, n: int) -> int:
    """A block that is not the whole tree has all its levels; a first block that isn't full is the whole tree."""
    return height(n) if block == 0 and n < BLOCK else LEVELS


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The digest of column values, each with its length in bytes."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(value, columns)), 256)


@dataclass
class Manifest:
    """tables: nodes (tree, pos, digest) round by round, the rows' leaves first, at last one node a tree.
    crown: the same of the tree over the trees, whose leaves also have their name. root: null without rows."""

    tables: list[DataFrame]
    crown: list[DataFrame]
    root: str | None

    def subroots(self) -> DataFrame:
        return self.crown[0].select("name", F.col("digest").alias("subroot"))


def _climbed(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of traversals of aligned blocks, at least one, until every tree has one node."""

    def up(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        leaves = block.sort_values("pos")["digest"].tolist()
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "digest": [traverse(leaves, _levels(key[1], len(leaves)))]})

    out = [nodes]
    while True:
        dealt = out[-1].select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "digest")
        out.append(stored(dealt.groupBy("tree", "block").applyInPandas(up, "tree string, pos bigint, digest string")))
        if not out[-1].where("pos > 0").limit(1).count():
            return out


def build(rows: DataFrame, ties: Sequence[str] = ("digest",)) -> Manifest:
    """The manifest of rows(tree, at, digest, ...): tree and at without nulls; they keep their other columns as leaves."""
    placed = before(rows.withColumn("_one", F.lit(1).cast("long")), "at", {"pos": ("_one", "sum")}, by=("tree",), ties=ties).drop("_one")
    tables = _climbed(stored(placed))
    tops = numbered(tables[-1].select(F.col("tree").alias("name"), "digest"), ["name"])
    crown = _climbed(stored(tops.withColumn("tree", F.lit(""))))
    top = crown[-1].first()
    return Manifest(tables, crown, None if top is None else top["digest"])


ABOVE = "tree string, pos bigint, ks array<int>, others array<string>, subroot string"


def _descended(nodes: DataFrame, above: DataFrame, finish: Finish, schema: str = ABOVE) -> DataFrame:
    """What ``finish`` makes of each block: its rows, their paths within it, the path above it, and its tree's root.

    above(tree, pos, ks, others, subroot) has a row for each block of the nodes.
    """

    def down(block: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        leaves = block["digest"].tolist()
        own: list[Path] = [[] for _ in leaves]
        traverse(leaves, _levels(int(block["block"].iloc[0]), len(leaves)), own)
        at = upper.iloc[0]
        return finish(block, own, [(int(k), o) for k, o in zip(at["ks"], at["others"], strict=True)], at["subroot"])

    dealt = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).groupBy("tree", "block")
    return dealt.cogroup(above.groupBy("tree", "pos")).applyInPandas(down, schema)


def _whole(block: pd.DataFrame, own: list[Path], higher: Path, subroot: str | None) -> pd.DataFrame:
    """Each node's path to the root of all."""
    whole = [p + higher for p in own]
    return pd.DataFrame({"tree": block["tree"], "pos": block["pos"], "ks": [[k for k, _ in p] for p in whole], "others": [[o for _, o in p] for p in whole], "subroot": subroot})


def _of_trees(block: pd.DataFrame, own: list[Path], higher: Path, subroot: str | None) -> pd.DataFrame:
    """The crown's leaves as the last nodes of their own trees."""
    return _whole(block, own, higher, None).assign(tree=block["name"], pos=0, subroot=block["digest"])


def _above_leaves(manifest: Manifest) -> DataFrame:
    """(tree, pos, ks, others, subroot) of the blocks of leaves."""
    spark = manifest.tables[0].sparkSession
    above = spark.createDataFrame([("", 0, [], [], None)] if manifest.root else [], ABOVE)
    for nodes in reversed(manifest.crown[1:-1]):
        above = stored(_descended(nodes, above, _whole))
    above = stored(_descended(manifest.crown[0], above, _of_trees))
    for nodes in reversed(manifest.tables[1:-1]):
        above = stored(_descended(nodes, above, _whole))
    return above


def paths(manifest: Manifest) -> DataFrame:
    """(tree, pos, ks, others, subroot): for each leaf its place in its run and its siblings, from its own level to the root."""
    return _descended(manifest.tables[0], _above_leaves(manifest), _whole)


def proofs(manifest: Manifest, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """key, leaf, subroot, proof_sha256 (digest of all siblings) and folded_root of each leaf.

    folded_root comes from what the leaf's column ``claimed`` says and the siblings of the manifest.
    """

    def finish(block: pd.DataFrame, own: list[Path], higher: Path, subroot: str | None) -> pd.DataFrame:
        tail = "".join(o for _, o in higher)
        roots: dict[str, str] = {}
        proof, root = [], []
        for claimed, path in zip(block["claimed"], own, strict=True):
            proof.append(digest(*(o for _, o in path), tail))
            node = folded(claimed, path)
            if node not in roots:
                roots[node] = folded(node, higher)
            root.append(roots[node])
        return pd.DataFrame({key: block[key], "leaf": block["digest"], "subroot": subroot, "proof_sha256": proof, "folded_root": root})

    return _descended(manifest.tables[0], _above_leaves(manifest), finish, f"{key} {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")


def audited(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document.

    What is audited is the document itself, but for one of five whose text's A-Z is lower-cased.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    own = [F.col(c) for c in COLUMNS]
    other = leaf_digest([*own[:-1], F.translate("text", UPPER, LOWER)])
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("at"), tree_key("source").alias("tree"), leaf_digest(own).alias("digest"), F.when(tampered, other).alias("claimed"))
    rows = rows.withColumn("claimed", F.coalesce("claimed", "digest"))
    manifest = build(rows, ties=("digest", "claimed"))
    out = proofs(manifest).withColumn("root", F.lit(manifest.root).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(table: str, levels: int = 7) -> str:
    """DuckDB SQL for the same rows: level by level with plain grouping, up to 16^levels rows of a source."""
    from threadlake.llm.txlog import CRC_TABLE, crc_sql

    value = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(value, [*COLUMNS[:-1], text]))})"

    def tree(p: str) -> str:
        """Levels p0.. of nodes (tree, pos, digest, size) with what stands left and right of each in its run."""
        out = []
        for i in range(levels):
            out.append(f"""{p}s{i} as (select a.tree, a.pos, any_value(a.size) as size, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from {p}{i} a join {p}{i} b on a.tree = b.tree and a.pos // {WIDTH} = b.pos // {WIDTH} group by a.tree, a.pos)""")
            out.append(f"{p}{i + 1} as (select tree, pos // {WIDTH} as pos, case when size > 1 then sha256(string_agg(digest, '' order by pos)) else max(digest) end as digest, count(*) over (partition by tree) as size from {p}{i} group by tree, pos // {WIDTH}, size)")
        return ", ".join(out)

    def fold(p: str, i: int, at: str) -> str:
        return f"case when {p}s{i}.size > 1 then sha256({p}s{i}.l || node || {p}s{i}.r) else node end as node, case when {p}s{i}.size > 1 then proof || {p}s{i}.l || {p}s{i}.r else proof end as proof"

    steps = [f"f{i + 1} as (select f{i}.* exclude (node, proof), {fold('n', i, 'pos')} from f{i} join ns{i} on ns{i}.tree = f{i}.tree and ns{i}.pos = f{i}.pos // {WIDTH**i})" for i in range(levels)]
    steps += [f"f{levels + i + 1} as (select f{levels + i}.* exclude (node, proof), {fold('c', i, 'spot')} from f{levels + i} join cs{i} on cs{i}.pos = f{levels + i}.spot // {WIDTH**i})" for i in range(levels)]
    return f"""with crc_table as (select {CRC_TABLE} as t),
leaves as (select doc_id, coalesce('=' || source, '-') as tree, {leaf('text')} as leaf, case when {crc_sql("coalesce(doc_id::varchar, '')", "crc_table.t")} % 5 = 0 and doc_id is not null then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as other from {table}, crc_table),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from leaves),
n0 as (select tree, pos, leaf as digest, count(*) over (partition by tree) as size from placed), {tree("n")},
tops as (select tree as name, digest as subroot, row_number() over (order by encode(tree)) - 1 as spot from n{levels}),
c0 as (select '' as tree, spot as pos, subroot as digest, count(*) over () as size from tops), {tree("c")},
f0 as (select doc_id, tree, pos, spot, leaf, subroot, coalesce(other, leaf) as node, '' as proof from placed join tops on tree = name),
{", ".join(steps)}
select doc_id, leaf, subroot, c{levels}.digest as root, sha256(proof) as proof_sha256, node as folded_root, node = c{levels}.digest as verified from f{2 * levels}, c{levels}"""
