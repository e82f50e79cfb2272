"""Which sessions of different tools belong together, and why.

Pairs are met through what they share: a term, or a workspace. A pair that shares
neither scores at most for its time, which never links; ``latest_near`` finds the one
that decides where the best candidate of any score is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.functions import text as t
from threadlake.functions.chronology import ascending, gap_seconds
from threadlake.functions.identity import candidate_id, global_id
from threadlake.operators.cells import CONTENT_OTHER, CONTENT_SAME, SCORED, SHOWN_TERMS, TEMPORAL, WINDOW_SECONDS, WORKSPACE, best_earlier, best_nearby, place, scored_pairs
from threadlake.operators.overview import session_spans, session_statistics
from threadlake.operators.timeline import bounded_context
from threadlake.plans.lineage import settled

# Threshold of a link, terms of a session.
THRESHOLD = 0.8
MOST_TERMS = 512
#: Words of 64 bits that a set of terms is marked in.
SIGNATURE = 8
BITS = [f"bits{k}" for k in range(SIGNATURE)]
#: Sessions with one rare term, or of one workspace and week, up to which they meet there.
CROWD = 4096
#: Changed sessions up to which they are sought by their ids.
MOST_CHANGED = 1000
ALGORITHM_LINK, ALGORITHM_SEED = "explainable-content-v1", "automatic-seed-v1"
# Weights of the repository score.
REPOSITORY, WORKTREE, BRANCH, HEAD, TIME = 0.45, 0.15, 0.15, 0.15, 0.10


def summaries(log: DataFrame) -> DataFrame:
    """Per session, from its bounded context: family, workspace, objective, terms, times and origin."""
    context = bounded_context(log)
    w = Window.partitionBy("native_session_id").orderBy(*ascending())
    terms = F.when(F.col("text").isNotNull(), t.content_terms(F.col("text"))).otherwise(F.array().cast("array<string>"))
    ordered = context.withColumn("at", F.row_number().over(w)).withColumn("terms", terms)
    key = F.col("at")
    grouped = ordered.groupBy("native_session_id").agg(
        F.min_by("tool_family", key).alias("family"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), key)).alias("first_cwd"),
        F.max("origin_collector_id").alias("origin"),
        F.array_distinct(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "terms"))), lambda x: x["terms"])), 1, MOST_TERMS)).alias("terms"),
        F.max_by("ts_seconds", key).alias("ended_at"),
    )
    spans = session_spans(log).select("native_session_id", F.col("start_seconds").alias("started_at"), "first_user_text")
    titles = session_statistics(log).select("native_session_id", "title")
    joined = grouped.join(spans, "native_session_id").join(titles, "native_session_id")
    return joined.select("native_session_id", "family", F.rtrim(F.col("first_cwd"), F.lit("/")).alias("cwd"), t.objective(F.coalesce("title", "first_user_text")).alias("objective"), "terms", "started_at", "ended_at", "origin")


def _sides(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    return s.select(*(F.col(c).alias(f"l_{c}") for c in s.columns)), s.select(*(F.col(c).alias(f"r_{c}") for c in s.columns))


def evidence(pairs: DataFrame) -> DataFrame:
    """Signals and score of pairs of summaries (columns l_* and r_*)."""
    same = F.coalesce((F.col("l_cwd") == F.col("r_cwd")) & F.col("l_origin").eqNullSafe(F.col("r_origin")), F.lit(False))
    near = gap_seconds(F.col("l_started_at"), F.col("l_ended_at"), F.col("r_started_at"), F.col("r_ended_at")) <= WINDOW_SECONDS
    shared = F.array_sort(F.array_intersect("l_terms", "r_terms"))
    union = F.size(F.array_union("l_terms", "r_terms"))
    scored = pairs.withColumns({"same_workspace": same, "near_in_time": near, "shared": shared, "union_size": union})
    scored = scored.withColumn("similarity", F.when(F.col("union_size") > 0, F.size("shared") / F.col("union_size")).otherwise(F.lit(0.0)))
    content = F.col("similarity") * F.when(F.col("same_workspace"), CONTENT_SAME).otherwise(CONTENT_OTHER)
    score = F.least(F.lit(1.0), F.when(F.col("same_workspace"), WORKSPACE).otherwise(0.0) + F.when(F.col("near_in_time"), TEMPORAL).otherwise(0.0) + content)
    return scored.withColumn("score", score).withColumn("shared_terms", F.slice("shared", 1, SHOWN_TERMS)).drop("shared")


def time_pairs(s: DataFrame) -> DataFrame:
    """Pairs of different families whose spans lie within the window, met by week."""
    week = WINDOW_SECONDS
    dealt = s.select("native_session_id", "family", "started_at", "ended_at", F.explode(F.sequence(F.floor(F.col("started_at") / week), F.floor((F.col("ended_at") + week) / week))).alias("week"))
    a, b = _sides(dealt)
    near = gap_seconds(F.col("l_started_at"), F.col("l_ended_at"), F.col("r_started_at"), F.col("r_ended_at")) <= week
    return a.join(b, F.col("l_week") == F.col("r_week")).where((F.col("l_native_session_id") < F.col("r_native_session_id")) & (F.col("l_family") != F.col("r_family")) & near).select(F.col("l_native_session_id").alias("a"), F.col("r_native_session_id").alias("b")).distinct()


def linkable_pairs(s: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of different families that can reach a threshold of 0.8 or more, and few others; left < right.

    Without a workspace in common, or apart in time, a link needs a similarity of
    (threshold - what the other signals give) / their weight. Two term sets so alike
    share one of the rarest terms of each, its prefix in order of frequency, so only
    prefixes meet; and of two that first meet at places i and j no more can be shared than what
    stands behind, so a pair stays only if that would do. Each bit that the terms of one set and none of
    the other's fall on stands for a term that isn't shared; pairs with too many of them are dropped
    where they meet. Pairs of one workspace that are near in time meet by week.
    """
    least = _least_alike(threshold)
    content = _alike(_prefixes(s, least), least)
    week = WINDOW_SECONDS
    placed = s.where("cwd is not null").select("native_session_id", "family", "cwd", F.coalesce("origin", F.lit("")).alias("origin"), "started_at", "ended_at", F.explode(F.sequence(F.floor(F.col("started_at") / week), F.floor((F.col("ended_at") + week) / week))).alias("week"))
    a, b = _sides(placed)
    near = gap_seconds(F.col("l_started_at"), F.col("l_ended_at"), F.col("r_started_at"), F.col("r_ended_at")) <= week
    same = a.join(b, (F.col("l_cwd") == F.col("r_cwd")) & (F.col("l_origin") == F.col("r_origin")) & (F.col("l_week") == F.col("r_week"))).where((F.col("l_native_session_id") < F.col("r_native_session_id")) & (F.col("l_family") != F.col("r_family")) & near)
    return content.unionByName(same.select(F.col("l_native_session_id").alias("a"), F.col("r_native_session_id").alias("b"))).distinct()


def _least_alike(threshold: float) -> float:
    """What a pair's sets of terms must have in common to reach a threshold, unless it has a workspace in common and is near in time."""
    least = min((threshold - TEMPORAL) / CONTENT_OTHER, (threshold - WORKSPACE) / CONTENT_SAME)
    if least <= 0:
        raise ValueError("below that threshold pairs link by their workspace alone")
    return least


def _prefixes(s: DataFrame, least: float) -> DataFrame:
    """Of each session, its rarest terms, as many as must hold one that a set as alike has among its own, and the bits of all."""
    sets = s.select("native_session_id", "family", F.array_distinct("terms").alias("terms"))
    each = sets.select("native_session_id", "family", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    rare = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    bit = F.pmod(F.xxhash64(F.lit("bit"), "term"), F.lit(64 * SIGNATURE)).cast("int")
    fallen = [F.coalesce(F.bit_or(F.expr(f"case when bit div 64 = {k} then shiftleft(1L, bit % 64) end")), F.lit(0).cast("long")).alias(f"bits{k}") for k in range(SIGNATURE)]
    ranked = each.join(rare, "term").withColumn("bit", bit).groupBy("native_session_id", "family", "n").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("order"), *fallen)
    prefix = (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int")
    return ranked.select("native_session_id", "family", "n", *BITS, F.transform(F.slice("order", 1, F.greatest(F.lit(0), prefix)), lambda x: F.struct(x["df"].alias("df"), F.xxhash64(x["term"]).alias("term"))).alias("prefix"))


def _alike(prefixes: DataFrame, least: float, crowd: int | None = None) -> DataFrame:
    """Pairs that may be so alike, met by a term of their prefixes that no more sessions than a crowd have."""
    keys = prefixes.select("native_session_id", "family", "n", *BITS, F.posexplode("prefix").alias("at", "x"))
    if crowd is not None:
        keys = keys.where(F.col("x.df") <= crowd)
    a, b = _sides(keys.select("native_session_id", "family", "n", *BITS, "at", F.col("x.term").alias("term")))
    alike = F.least("l_n", "r_n") >= F.greatest("l_n", "r_n") * F.lit(least) - 1e-9
    most = F.least(F.col("l_n") - F.col("l_at"), F.col("r_n") - F.col("r_at"))
    least_shared = (F.col("l_n") + F.col("r_n")) * F.lit(least / (1 + least)) - 1e-6
    only = lambda x, y: F.expr(" + ".join(f"bit_count({x}_{b} & ~{y}_{b})" for b in BITS))
    alike = alike & (most >= least_shared) & (F.col("l_n") - only("l", "r") >= least_shared) & (F.col("r_n") - only("r", "l") >= least_shared)
    met = a.join(b, F.col("l_term") == F.col("r_term")).where((F.col("l_native_session_id") < F.col("r_native_session_id")) & (F.col("l_family") != F.col("r_family")) & alike)
    return met.select(F.col("l_native_session_id").alias("a"), F.col("r_native_session_id").alias("b"))


def best_matches(s: DataFrame) -> DataFrame:
    """``best_earlier``, for which only some sessions must meet all others.

    What reaches the threshold shares a rare term, or a workspace and week. A session that finds such a match
    among those has its best one there; one that finds none, or stands in a crowd where that would
    list too many pairs, meets all others in cells.
    """
    least = _least_alike(THRESHOLD)
    prefixes = settled(_prefixes(s, least))
    alike = best_candidates(s, pair_scores(s, _alike(prefixes, least, CROWD).distinct()).where(F.col("score") >= THRESHOLD))
    nearby, crowded = best_nearby(s, CROWD)
    crowded = crowded.unionByName(prefixes.where(F.exists("prefix", lambda x: x["df"] > CROWD)).select("native_session_id"))
    found = alike.withColumnRenamed("parent", "other").unionByName(nearby.where(F.col("score") >= THRESHOLD)).join(crowded.distinct(), "native_session_id", "left_anti")
    best = settled(found.groupBy("native_session_id").agg(F.max(F.struct("score", "other")).alias("best")).select("native_session_id", "best.other", "best.score"))
    return best.unionByName(best_earlier(s, settled(s.join(best, "native_session_id", "left_anti").select("native_session_id"))))


def reconcile(s: DataFrame, members: DataFrame, changed: DataFrame, rejected: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Decisions on changed sessions that have no membership yet.

    (native_session_id, global_id, confidence, algorithm_version, other_id, score):
    a session joins the global one of its best match of another family, among
    sessions that have a membership and new ones that began before it, if the
    score reaches the threshold and no user ruled that out; else it seeds one.
    Memberships that hold are never changed. As if sessions were decided one by one in
    order of their start: where a chain of links ends at a global session that is
    ruled out for one on it, that one's link is cut and its next best match is taken, round by
    round from the chain's end on; what links to it follows.
    """
    known = members.select("native_session_id", "global_id").groupBy("native_session_id").agg(F.min("global_id").alias("global_id"))
    fresh = settled(s.join(changed.select("native_session_id").distinct(), "native_session_id", "left_semi").join(known, "native_session_id", "left_anti"))
    there = settled(fresh.unionByName(s.join(known, "native_session_id", "left_semi")))
    scores = pair_scores(there, linkable_pairs(there, threshold))
    side = lambda x, y: scores.select(F.col(x).alias("native_session_id"), F.col(y).alias("other_id"), "score")
    both = side("left_id", "right_id").unionByName(side("right_id", "left_id"))
    at = fresh.select("native_session_id", F.struct("started_at", "native_session_id").alias("at"))
    placed = both.join(at, "native_session_id").join(at.select(F.col("native_session_id").alias("other_id"), F.col("at").alias("other_at")), "other_id", "left").join(known.select(F.col("native_session_id").alias("other_id"), F.col("global_id").alias("other_global")), "other_id", "left")
    open_pairs = placed.where("other_global is not null or other_at < at").where(F.col("score") >= threshold)
    if rejected is not None:
        open_pairs = open_pairs.join(rejected.select("native_session_id", F.col("global_id").alias("other_global")), ["native_session_id", "other_global"], "left_anti")
    open_pairs = settled(open_pairs.select("native_session_id", "other_id", "other_global", "score"))
    ruled = None if rejected is None else settled(rejected.join(fresh, "native_session_id", "left_semi").select("native_session_id", F.col("global_id").alias("ends")).distinct())
    cut = None
    while True:
        left = open_pairs if cut is None else open_pairs.join(cut, ["native_session_id", "other_id"], "left_anti")
        best = left.groupBy("native_session_id").agg(F.max(F.struct("score", "other_id", "other_global")).alias("best"))
        linked = settled(fresh.select("native_session_id").join(best, "native_session_id", "left").select("native_session_id", "best.score", "best.other_id", "best.other_global"))
        # A chain of new sessions ends at one that seeds a global session or joins a known one.
        ends = F.when(F.col("other_id").isNull(), global_id(F.col("native_session_id"))).otherwise(F.col("other_global"))
        steps = linked.select("native_session_id", F.col("other_id").alias("up"), ends.alias("ends"))
        found = _chain_ends(steps)
        if ruled is None:
            break
        wrong = settled(found.join(linked.where("other_id is not null"), "native_session_id").join(ruled, ["native_session_id", "ends"], "left_semi").select("native_session_id", "other_id"))
        if not wrong.limit(1).count():
            break
        # What stands below another wrong link waits: its end may change. The others' ends are final, so their link is cut for good.
        stops = steps.join(wrong.select("native_session_id", F.lit(True).alias("stop")), "native_session_id", "left")
        below = _chain_ends(stops.select("native_session_id", "up", F.when(F.col("stop"), F.lit(STOP)).otherwise(F.col("ends")).alias("ends")))
        waits = below.where(F.col("ends") == STOP).select(F.col("native_session_id").alias("other_id"))
        first = wrong.join(waits, "other_id", "left_anti").select("native_session_id", "other_id")
        cut = settled(first if cut is None else cut.unionByName(first))
    out = found.join(linked, "native_session_id")
    version = F.when(F.col("other_id").isNull(), ALGORITHM_SEED).otherwise(ALGORITHM_LINK)
    return out.select("native_session_id", F.col("ends").alias("global_id"), F.when(F.col("other_id").isNull(), F.lit(1.0)).otherwise(F.col("score")).alias("confidence"), version.alias("algorithm_version"), "other_id", F.when(F.col("other_id").isNotNull(), F.col("score")).alias("score"))


#: What a chain ends at that runs into a link under question; no global session is called so.
STOP = "?"


def _chain_ends(steps: DataFrame) -> DataFrame:
    """(native_session_id, ends) of steps(native_session_id, up, ends): up leads on where ends is null. Found by doubling."""
    up = settled(steps.select("native_session_id", F.when(F.col("ends").isNull(), F.col("up")).otherwise(F.col("native_session_id")).alias("root"), "ends"))
    while up.where("ends is null").limit(1).count():
        further = up.select(F.col("native_session_id").alias("via"), F.col("root").alias("next"), F.col("ends").alias("found"))
        up = settled(up.join(further, F.col("root") == F.col("via")).select("native_session_id", F.when(F.col("ends").isNull(), F.col("next")).otherwise(F.col("root")).alias("root"), F.coalesce("ends", "found").alias("ends")))
    return up.select("native_session_id", "ends")


def refreshed_candidates(s: DataFrame, known: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Pending candidates scored anew where both sessions are there (and one has changed); what users decided stays."""
    pending = known.where("status = 'pending'")
    if changed is not None:
        ids = [r[0] for r in changed.select("native_session_id").distinct().limit(MOST_CHANGED + 1).collect()]
        if len(ids) <= MOST_CHANGED:
            pending = pending.where(F.col("left_id").isin(ids) | F.col("right_id").isin(ids))
    pairs = pending.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"))
    fresh = candidates(pair_scores(s, pairs), 2.0)
    return upsert_candidates(known, fresh)


def newest_summaries(s: DataFrame, most: int = 2048) -> DataFrame:
    """The summaries that ended last, as many as a cache holds."""
    return s.orderBy(F.col("ended_at").desc(), F.col("native_session_id").desc()).limit(most)


def last_resorts(s: DataFrame, alone: DataFrame) -> DataFrame:
    """For each of the sessions that met no earlier one of another family, the last of those by id, if there is any.

    Sessions that start in the same week are met by time, so only earlier weeks count.
    """
    at = s.select("native_session_id", "family", F.floor(F.col("started_at") / WINDOW_SECONDS).alias("week"))
    last = at.groupBy(F.col("week").alias("w"), F.col("family").alias("f")).agg(F.max("native_session_id").alias("other"))
    alone = at.join(alone.select("native_session_id"), "native_session_id", "left_semi")
    best = alone.join(F.broadcast(last), (F.col("w") < F.col("week")) & (F.col("f") != F.col("family"))).groupBy("native_session_id").agg(F.max("other").alias("other"))
    return best.select(F.least("native_session_id", "other").alias("a"), F.greatest("native_session_id", "other").alias("b"))


def unmet(s: DataFrame) -> DataFrame:
    """Sessions that no earlier one of another family is near, or shares a term or a workspace with.

    An earlier one shares a term if the first that has it does, so of each term the first of each family will do.
    """
    alone = settled(s.join(_near(s).select(F.col("id").alias("native_session_id")), "native_session_id", "left_anti"))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<string>")), lambda x: F.concat(F.lit("t"), x))
    keys = F.array_distinct(F.array_compact(F.array_append(terms, F.concat(F.lit("w"), place()))))
    dealt = lambda rows: rows.select("native_session_id", "family", F.struct("started_at", "native_session_id").alias("at"), F.explode(keys).alias("key"))
    of_alone = dealt(alone)
    first = dealt(s).join(of_alone.select("key").distinct(), "key", "left_semi").groupBy("key", F.col("family").alias("f")).agg(F.min("at").alias("first"))
    served = of_alone.join(first, "key").where((F.col("f") != F.col("family")) & (F.col("first") < F.col("at"))).select("native_session_id").distinct()
    return alone.join(served, "native_session_id", "left_anti")


def latest_near(s: DataFrame) -> DataFrame:
    """Of each session, the greatest id among earlier ones of other families within the window, as a pair."""
    return _near(s).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def _near(s: DataFrame) -> DataFrame:
    """(id, other): of each session, the greatest id among earlier ones of other families within the window.

    Pairs that share nothing and are near in time all score the same, so this one
    decides for all of them, and they need not be listed. An earlier session is
    near one that starts in week w if it starts in w too, lasts into w, or ends in
    the week before at most a window earlier: two running maxima and a sum by week.
    """
    week = WINDOW_SECONDS
    at = s.select(F.col("native_session_id").alias("id"), "family", "started_at", "ended_at", F.floor(F.col("started_at") / week).alias("sw"), F.floor(F.col("ended_at") / week).alias("ew"))
    families = s.select(F.col("family").alias("f")).distinct()
    gives = at.join(F.broadcast(families), F.col("f") != F.col("family"))
    no, none = F.lit(0), F.lit(None).cast("string")
    point = lambda rows, f, piece, w, value, late, given: rows.select("id", f.alias("f"), F.lit(piece).alias("piece"), w.alias("w"), value.alias("value"), late.alias("late"), given.alias("given"))
    points = point(gives, F.col("f"), 1, F.col("sw"), F.col("started_at"), no, F.col("id"))
    points = points.unionByName(point(at, F.col("family"), 1, F.col("sw"), F.col("started_at"), no, none))
    points = points.unionByName(point(gives, F.col("f"), 2, F.col("ew") + 1, -F.col("ended_at"), no, F.col("id")))
    points = points.unionByName(point(at, F.col("family"), 2, F.col("sw"), week - F.col("started_at"), F.lit(1), none))
    w = Window.partitionBy("f", "piece", "w").orderBy("value", "late", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partly = points.withColumn("other", F.max("given").over(w)).where("given is null").select("id", "other")
    lasting = gives.where("ew > sw").select("f", "id", F.explode(F.sequence(F.col("sw") + 1, F.col("ew"))).alias("w")).groupBy("f", "w").agg(F.max("id").alias("other"))
    whole = at.join(lasting, (F.col("family") == F.col("f")) & (F.col("sw") == F.col("w"))).select("id", "other")
    return partly.unionByName(whole).groupBy("id").agg(F.max("other").alias("other")).where("other is not null")


def deciding_pairs(s: DataFrame) -> DataFrame:
    """Pairs among which each session's best earlier one is, whatever its score: at most two a session."""
    met = settled(best_matches(s).select("native_session_id", "other").unionByName(_near(s).withColumnRenamed("id", "native_session_id")))
    pairs = met.select(F.least("native_session_id", "other").alias("a"), F.greatest("native_session_id", "other").alias("b"))
    return pairs.unionByName(last_resorts(s, s.join(met, "native_session_id", "left_anti"))).distinct()


def all_scores(s: DataFrame, columns: tuple[str, ...] = SCORED, text: str = "") -> DataFrame:
    """What is asked for of ``all_pairs``; each pair is made once, and none is moved.

    With a text, only those that ``filter_candidates`` may find by it are sure to be there.
    """
    few = pair_scores(s, last_resorts(s, unmet(s))).withColumn("content", _content_text())
    # A text that no id of a candidate can hold is sought in those of sessions, before they meet.
    of = None if set(text.lower()) <= set("candidate_0123456789abcdef") else F.contains(F.lower("native_session_id"), F.lit(text.lower()))
    return scored_pairs(s, also_near=True, columns=columns, of=of).unionByName(few.select(*columns))


def all_pairs(s: DataFrame) -> DataFrame:
    """Pairs that share something or are near in time, and of each session the best earlier one whatever its score."""
    return all_scores(s, ("left_id", "right_id")).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


def pair_scores(s: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """left, right, signals and score of the pairs (by default those that share something)."""
    if pairs is None:
        return scored_pairs(s)
    left, right = _sides(s)
    met = pairs.join(left, F.col("a") == F.col("l_native_session_id")).join(right, F.col("b") == F.col("r_native_session_id"))
    return evidence(met).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), "same_workspace", "near_in_time", "similarity", "score", "shared_terms")


def best_candidates(s: DataFrame, scores: DataFrame) -> DataFrame:
    """Of each session, the best earlier session of another family; the last by id wins ties."""
    order = s.select("native_session_id", F.struct("started_at", "native_session_id").alias("at"))
    both = scores.select("left_id", "right_id", "score").unionByName(scores.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "score"))
    placed = both.join(order.withColumnsRenamed({"native_session_id": "i", "at": "at_left"}), F.col("left_id") == F.col("i")).join(order.withColumnsRenamed({"native_session_id": "k", "at": "at_right"}), F.col("right_id") == F.col("k"))
    earlier = placed.where("at_right < at_left")
    return earlier.groupBy(F.col("left_id").alias("native_session_id")).agg(F.max(F.struct("score", F.col("right_id").alias("parent"))).alias("best")).select("native_session_id", F.col("best.parent").alias("parent"), F.col("best.score").alias("score"))


def assignments(s: DataFrame, scores: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The global session of each native one: that of its best earlier match, or one that it seeds.

    Without scores, the best match is sought among all that can reach the threshold, which must be above
    what a pair has for its time alone. Chains of parents are followed by doubling, so their length costs its logarithm.
    """
    if scores is not None:
        parents = best_candidates(s, scores).where(F.col("score") >= threshold).select("native_session_id", "parent")
    elif threshold > TEMPORAL:
        parents = best_matches(s).where(F.col("score") >= threshold).select("native_session_id", F.col("other").alias("parent"))
    else:
        raise ValueError("below that threshold pairs link by their time alone")
    up = settled(s.select("native_session_id").join(parents, "native_session_id", "left").select("native_session_id", F.coalesce("parent", "native_session_id").alias("root")))
    while True:
        further = up.select(F.col("native_session_id").alias("via"), F.col("root").alias("next"))
        step = up.join(further, F.col("root") == F.col("via")).select("native_session_id", "root", "next")
        step = settled(step)
        moved = step.where("root <> next").limit(1).count()
        up = step.select("native_session_id", F.col("next").alias("root"))
        if not moved:
            break
    return up.select("native_session_id", "root", global_id(F.col("root")).alias("global_id"))


def candidate_rows(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scored pairs as candidates with ids and status, and their evidence where the terms are there, in any order."""
    status = F.when(F.col("score") >= threshold, "accepted").otherwise("pending")
    content = F.col("content") if "content" in scores.columns else None
    shown = {"evidence": evidence_texts(content)} if content is not None or "shared_terms" in scores.columns else {}
    return scores.select(candidate_id(F.col("left_id"), F.col("right_id")).alias("candidate_id"), "left_id", "right_id", "score", status.alias("status"), *(x.alias(c) for c, x in shown.items()))


def candidates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``candidate_rows``, best first. Sorting makes the scores twice."""
    return candidate_rows(scores, threshold).orderBy(F.col("score").desc(), "candidate_id")


def _content_text() -> Column:
    return F.to_json(F.struct(F.lit("content").alias("signal"), F.format_number("similarity", 3).alias("similarity"), F.col("shared_terms")))


def evidence_texts(content: Column | None = None) -> Column:
    """The three signals as JSON; that of content may be there already."""
    known = lambda signal, matched: f'{{"signal":"{signal}","matched":{matched}}}'
    flag = lambda signal, c: F.when(F.col(c), known(signal, "true")).when(~F.col(c), known(signal, "false")).otherwise(f'{{"signal":"{signal}"}}')
    return F.array(flag("workspace", "same_workspace"), flag("temporal", "near_in_time"), _content_text() if content is None else content)


def upsert_candidates(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh candidates replace known ones, but what was rejected stays rejected."""
    old = known.select("candidate_id", F.col("status").alias("old_status"), *(F.col(c).alias(f"old_{c}") for c in ("left_id", "right_id", "score", "evidence")))
    joined = fresh.join(old, "candidate_id", "full")
    return joined.select("candidate_id", *(F.coalesce(c, f"old_{c}").alias(c) for c in ("left_id", "right_id", "score")), upserted_status().alias("status"), F.coalesce("evidence", "old_evidence").alias("evidence"))


def upserted_status() -> Column:
    """Of a candidate's fresh status and the old one, which holds."""
    return F.when(F.col("old_status") == "rejected", "rejected").otherwise(F.coalesce("status", "old_status"))


def filter_candidates(rows: DataFrame, query: str, pending_only: bool = False) -> DataFrame:
    """Candidates whose ids, or titles and families where they are there, hold a text, whatever its case."""
    low, matched = F.lit(query.lower()), F.lit(False)
    for c in ("left_id", "right_id", *(c for c in DESCRIBED if c in rows.columns), "candidate_id"):
        matched = matched | F.coalesce(F.contains(F.lower(c), low), F.lit(False))
    found = rows.where(matched)
    return found.where("status = 'pending'") if pending_only else found


DESCRIBED = ("left_title", "left_family", "right_title", "right_family")


def described(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Candidates with title and family of both their sessions, null where a session isn't listed."""
    for side in ("left", "right"):
        shown = sessions.select(F.col("native_session_id").alias(f"{side}_id"), F.col("title").alias(f"{side}_title"), F.col("tool_family").alias(f"{side}_family"))
        rows = rows.join(shown, f"{side}_id", "left")
    return rows


def with_target(rows: DataFrame, memberships: DataFrame) -> DataFrame:
    """Candidates with the first global session of their right side, which is sent to them: there are as many pairs as sessions squared."""
    first = memberships.groupBy(F.col("native_session_id").alias("m")).agg(F.min("global_id").alias("target_id"))
    return rows.join(F.broadcast(first), F.col("right_id") == F.col("m"), "left").drop("m")


def repository_score(rows: DataFrame) -> DataFrame:
    """Score of boolean signals same_repository, same_worktree, same_branch, same_head and near_in_time."""
    weighed = [F.when(F.col(c), w).otherwise(0.0) for c, w in (("same_repository", REPOSITORY), ("same_worktree", WORKTREE), ("same_branch", BRANCH), ("same_head", HEAD), ("near_in_time", TIME))]
    total = weighed[0]
    for w in weighed[1:]:
        total = total + w
    return rows.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


# Memberships: an append-only audit of decisions, folded to what holds now.

AUDIT = "seq bigint, action string, global_id string, native_session_id string, confidence double, algorithm_version string, actor string, reason string, created_at string"


class RejectedMembership(ValueError):
    """A link that a user has ruled out."""


def memberships(audit: DataFrame) -> DataFrame:
    """The memberships that hold: of each pair, the last link not followed by unlink or reject."""
    last = audit.where(F.col("action").isin("link", "unlink", "reject")).groupBy("global_id", "native_session_id").agg(F.max_by(F.struct("action", "confidence", "algorithm_version", "actor", "created_at"), "seq").alias("last"))
    return last.where("last.action = 'link'").select("global_id", "native_session_id", "last.confidence", "last.algorithm_version", "last.actor", "last.created_at")


def rejections(audit: DataFrame) -> DataFrame:
    """Pairs that are ruled out: rejected, and not reversed since."""
    last = audit.where(F.col("action").isin("reject", "reverse")).groupBy("global_id", "native_session_id").agg(F.max_by("action", "seq").alias("action"))
    return last.where("action = 'reject'").select("global_id", "native_session_id")


def refuse_ruled_out(audit: DataFrame, action: str, global_id: str, native_session_id: str) -> None:
    """RejectedMembership for a link that is ruled out."""
    if action == "link" and rejections(audit).where((F.col("global_id") == global_id) & (F.col("native_session_id") == native_session_id)).limit(1).count():
        raise RejectedMembership(f"{native_session_id} is ruled out of {global_id}")


def decide(spark: SparkSession, audit: DataFrame, action: str, global_id: str, native_session_id: str, actor: str, created_at: str, confidence: float = 1.0, version: str = "manual-v1", reason: str = "") -> DataFrame:
    """The audit with one decision more; RejectedMembership for a link that is ruled out."""
    refuse_ruled_out(audit, action, global_id, native_session_id)
    seq = (audit.agg(F.max("seq")).first()[0] or 0) + 1
    return audit.unionByName(spark.createDataFrame([(seq, action, global_id, native_session_id, confidence, version, actor, reason, created_at)], AUDIT))


def review(spark: SparkSession, audit: DataFrame, candidate: dict, target: str, accept: bool, actor: str, created_at: str) -> DataFrame:
    """Accepting moves the left session from what it seeded to the target; rejecting rules the target out."""
    left = candidate["left_id"]
    if not accept:
        return decide(spark, audit, "reject", target, left, actor, created_at, version="manual-candidate-v1")
    for row in memberships(audit).where((F.col("native_session_id") == left) & (F.col("algorithm_version") == ALGORITHM_SEED)).collect():
        if row["global_id"] != target:
            audit = decide(spark, audit, "unlink", row["global_id"], left, actor, created_at, version="manual-candidate-v1")
    return decide(spark, audit, "link", target, left, actor, created_at, confidence=candidate["score"], version="manual-candidate-v1")


def global_for_workspace(log: DataFrame, members: DataFrame, cwd: str) -> DataFrame:
    """The global session of the latest membership of sessions in a workspace."""
    here = log.where(F.rtrim(F.col("cwd"), F.lit("/")) == cwd.rstrip("/")).select("native_session_id").distinct()
    return members.join(here, "native_session_id", "left_semi").agg(F.max_by("global_id", F.struct("created_at", "global_id")).alias("global_id")).where("global_id is not null")


def touched(globals_: DataFrame, touches: DataFrame) -> DataFrame:
    """updated_at moves forward only, compared as text."""
    latest = touches.groupBy("global_id").agg(F.max("at").alias("at"))
    return globals_.join(latest, "global_id", "left").withColumn("updated_at", F.greatest("updated_at", F.coalesce("at", "updated_at"))).drop("at")
