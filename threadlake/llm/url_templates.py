"""URL filters: rules first, then a path-template tree judged by smoothed labelled purity.

Everything here is DataFrame operations: no Python touches a row. Urls that a rule
decides are the labelled ones. Per host, path segments become the branches of a
tree, one level at a time, as deep as labelled urls reach. A segment turns into
the wildcard ``*`` if it looks like an identifier (it holds a digit, or is long)
or if its position takes too many distinct values; branches whose blocked shares
a two-proportion test cannot tell apart from their siblings' become ``+``, and so do
branches with too few labelled urls for a test. The deepest template with
enough labelled urls decides, up to the host's root, ``/``: it is rejected if its smoothed share of blocked urls
reaches the threshold. Urls of hosts without enough labelled ones are allowed.

A template below one that lacks support can't have it, so only branches with
enough labelled urls are followed: the tree ends by itself, and no depth is cut.

The tree is built from one row per (host, segments) with counts, so a host with
a third of all urls costs no more than its distinct paths; sums per branch and
family are combined before they are shuffled. The join that brings the verdicts
back is salted, so that a hot path spreads out.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is allowed unless a rule fits; empty segments don't count; a url is no child
of the template it ends at; one without segments is judged by the root; no url is dropped; an empty table gives an empty result;
repeated rows each get their verdict; a null page_id is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.steps import stored


@dataclass(frozen=True)
class Rule:
    """An action for a host, its subdomains and the paths below a prefix."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """support: labelled urls that a template needs. purity: share at which it is rejected.
    strength: weight of the even prior. z: of the test that merges branches.
    spread, share: distinct values, and their share of the urls, that make a position variable.
    long: characters of a segment that count as an identifier."""

    support: int = 4
    purity: float = 0.8
    strength: float = 2.0
    z: float = 1.96
    spread: int = 30
    share: float = 0.5
    long: int = 24


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every row of pages(page_id, url)."""
    rest = pages.select("page_id", F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end").alias("rest"))
    raw = rest.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    return raw.select("page_id", F.translate("raw", UPPER, LOWER).alias("host"), F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), "^[^?#]*", 0).alias("path"))


def _by_rule(rules: tuple[Rule, ...], what: str) -> Column:
    """The longest rule wins; of equal length, the first by name."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        host = F.lit(True) if not r.host else (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        out = F.when(host & F.col("path").startswith(r.path), F.lit(getattr(r, what))).otherwise(out)
    return out


def judged(shapes: DataFrame, s: Settings) -> DataFrame:
    """host, segments, template and purity where a template judges them: shapes(host, segments, n, m, b).

    n urls of a shape, of which m are labelled and b blocked. A level takes the
    shapes below supported templates, names their next branch, and keeps those
    whose longer template still has support.
    """
    shapes = stored(shapes)
    blocked = lambda b, m: (F.col(b) + s.strength / 2) / (F.col(m) + s.strength)
    roots = shapes.groupBy("host").agg(F.sum("m").alias("tm"), F.sum("b").alias("tb")).where(F.col("tm") >= s.support)
    at = stored(shapes.join(roots.select("host", blocked("tb", "tm").alias("purity")), "host").withColumn("template", F.lit("")))
    found, d = [at.select("host", "segments", F.lit("/").alias("template"), "purity", F.lit(-1).alias("depth"))], 0
    while at.where(F.size("segments") > d).limit(1).count():
        inner = at.where(F.size("segments") > d).withColumn("s", F.col("segments")[d]).drop("purity")
        branch = inner.groupBy("host", "template", "s").agg(*(F.sum(c).alias(c) for c in "nmb"))
        family = branch.groupBy("host", "template").agg(*(F.sum(c).alias(f"p{c}") for c in "nmb"), F.count(F.lit(1)).alias("kinds"))
        rest, own = F.col("pm") - F.col("m"), F.col("m")
        part = F.try_divide
        even, one = part("pb", "pm"), F.lit(1.0)
        alike = F.abs(part("b", own) - part(F.col("pb") - F.col("b"), rest)) <= s.z * F.sqrt(even * (1 - even) * (part(one, own) + part(one, rest)))
        variable = (F.col("kinds") >= s.spread) & (F.col("kinds") >= s.share * F.col("pn"))
        name = F.when((F.col("s") == "*") | variable, "*").when(own < s.support, "+").when(rest < s.support, F.col("s")).when(alike, "+").otherwise(F.col("s"))
        named = branch.join(family, ["host", "template"]).select("host", "template", "s", "m", "b", name.alias("t"))
        node = named.groupBy("host", "template", "t").agg(F.sum("m").alias("tm"), F.sum("b").alias("tb")).where(F.col("tm") >= s.support)
        longer = named.select("host", "template", "s", "t").join(node, ["host", "template", "t"]).select("host", "template", "s", F.concat("template", F.lit("/"), "t").alias("longer"), blocked("tb", "tm").alias("purity"))
        at = stored(inner.join(longer, ["host", "template", "s"]).select("host", "segments", "n", "m", "b", F.col("longer").alias("template"), "purity"))
        found.append(at.select("host", "segments", "template", "purity", F.lit(d).alias("depth")))
        d += 1
    every = found[0]
    for level in found[1:]:
        every = every.unionByName(level)
    best = every.groupBy("host", "segments").agg(F.max_by(F.struct("template", "purity"), "depth").alias("best"))
    return best.select("host", "segments", "best.template", "best.purity")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, settings: Settings = Settings(), salts: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict and template of each row of pages(page_id, url, ...).

    template: the one that judges the url's path, null if none has support.
    """
    s = settings
    segment = f"transform(filter(split(path, '/', -1), x -> x <> ''), x -> if(length(x) >= {s.long} or x rlike '[0-9]', '*', x))"
    rows = parsed(pages).select("page_id", "host", "path", _by_rule(rules, "name").alias("rule"), _by_rule(rules, "action").alias("action"), F.expr(segment).alias("segments"))
    shapes = rows.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count("action").alias("m"), F.sum(F.when(F.col("action") == "block", 1).otherwise(0)).alias("b"))
    templates = judged(shapes, s).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    verdict = F.coalesce("action", F.when(F.col("purity") >= s.purity, "block").otherwise("allow"))
    return salted.join(templates, ["host", "segments", "salt"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def oracle(table: str, rules: tuple[Rule, ...] = RULES, settings: Settings = Settings()) -> str:
    """DuckDB SQL for the same rows: rules as a table, and the tree by recursion, with windows over all shapes of a level."""
    s = settings
    listed = ", ".join(f"('{r.action}', '{r.host}', '{r.path}', '{r.name}')" for r in rules)
    return f"""with recursive rules(action, rhost, rpath, name) as (values {listed}),
rests as (select page_id, row_number() over () as nth, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from {table}),
urls as (select page_id, nth, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests),
fits as (select nth, arg_min(struct_pack(name := name, action := action), row(-len(name), name)) as best from urls join rules on (host = rhost or ends_with(host, '.' || rhost) or rhost = '') and starts_with(path, rpath) group by nth),
ruled as (select u.page_id, u.host, u.path, f.best.name as rule, f.best.action as action, list_transform(list_filter(string_split(u.path, '/'), lambda x: x <> ''), lambda x: case when len(x) >= {s.long} or regexp_matches(x, '[0-9]') then '*' else x end) as segments from urls u left join fits f using (nth)),
shapes as (select host, segments, count(*) as n, count(action) as m, count(*) filter (action = 'block') as b from ruled group by all),
tree as (
  select host, segments, n, m, b, 0 as depth, '' as template, (sum(b) over (partition by host) + {s.strength / 2}) / (sum(m) over (partition by host) + {s.strength}) as purity from shapes where host in (select host from shapes group by host having sum(m) >= {s.support})
  union all
  select host, segments, n, m, b, depth + 1, template || '/' || t, (tb + {s.strength / 2}) / (tm + {s.strength}) from (
    select *, sum(m) over (partition by host, template, t) as tm, sum(b) over (partition by host, template, t) as tb from (
      select *, case when s = '*' or kinds >= {s.spread} and kinds >= {s.share} * pn then '*'
        when bm < {s.support} then '+' when pm - bm < {s.support} then s
        when abs(bb / bm - (pb - bb) / (pm - bm)) <= {s.z} * sqrt(pb / pm * (1 - pb / pm) * (1 / bm + 1 / (pm - bm))) then '+' else s end as t
      from (
        select *, sum(m) over f as pm, sum(b) over f as pb, sum(n) over f as pn, count(distinct s) over f as kinds, sum(m) over c as bm, sum(b) over c as bb
        from (select *, segments[depth + 1] as s from tree where len(segments) > depth)
        window f as (partition by host, template), c as (partition by host, template, s)))) where tm >= {s.support}),
best as (select host, segments, arg_max(case when depth = 0 then '/' else template end, depth) as template, arg_max(purity, depth) as purity from tree group by host, segments)
select r.page_id, r.host, r.path, r.rule, coalesce(r.action, case when b.purity >= {s.purity} then 'block' else 'allow' end) as verdict, b.template
from ruled r left join best b on r.host = b.host and r.segments = b.segments"""
