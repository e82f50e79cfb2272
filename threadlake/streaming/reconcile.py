"""Reconciling the store's sessions as a stream over its own commits.

New commit files are the stream's input; its checkpoint is the watermark. A batch
takes the sessions that gained events in those commits, sums them up anew (others keep their
stored summaries), decides on memberships, and adds summaries, decisions,
candidates, global sessions and handoffs in one commit of the store, which is known by the
batch's number. A batch that fails before that leaves nothing behind and is
tried again; one that failed after it changes nothing. Where the store's revision has gone up since,
every session counts as changed.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlake.operators import correlation as co
from threadlake.operators.handoff import handoffs
from threadlake.plans.lineage import settled
from threadlake.streaming.store import Commit, Files, Store

STREAM, ACTOR = "reconcile", "automatic-correlator"
#: Commits of the store that one batch takes at most.
MOST_COMMITS = 256
COMMITS = "number long, base long, top long, counts map<string,long>"


def utc(seconds: Column) -> Column:
    """Seconds since 1970 as text in UTC, whatever the session's time zone is."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def changed_sessions(store: Store, ranges: list[tuple[int, int]] | None) -> DataFrame:
    """Sessions with events whose ingestion ids lie behind a range's start and up to its end; all without ranges."""
    log = store.events()
    if ranges is not None:
        within = F.lit(False)
        for base, top in ranges:
            within = within | ((F.col("ingestion_id") > base) & (F.col("ingestion_id") <= top))
        log = log.where(within)
    return log.select("native_session_id").distinct()


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that follow each other as one."""
    out: list[tuple[int, int]] = []
    for base, top in sorted(ranges):
        if out and base <= out[-1][1]:
            out[-1] = (out[-1][0], max(top, out[-1][1]))
        else:
            out.append((base, top))
    return out


def reconcile_batch(store: Store, batch: int, ranges: list[tuple[int, int]], threshold: float = co.THRESHOLD, stream: str = STREAM) -> Commit | None:
    """Decides on the sessions that changed; the commit, or None if there was nothing to do."""
    commits = store.commits()
    before = [c for c in commits if c.stream == stream]
    rebuild = bool(commits) and (not before or before[-1].revision < commits[-1].revision)
    if not ranges and not rebuild:
        return None
    if rebuild and before:
        store.rebuild_statistics()

    def make(commits: list[Commit]) -> dict[str, DataFrame]:
        log = store.events()
        changed = settled(changed_sessions(store, None if rebuild else ranges))
        fresh = settled(co.summaries(log.join(changed, "native_session_id", "left_semi")))
        every = settled(store.summaries().join(changed, "native_session_id", "left_anti").unionByName(fresh))
        audit = store.table("decisions")
        members = co.memberships(audit).select("native_session_id", "global_id")
        decided = settled(co.reconcile(every, members, changed, co.rejections(audit), threshold))
        at = fresh.select("native_session_id", "objective", utc(F.col("started_at")).alias("began"), utc(F.col("ended_at")).alias("ended"))
        told = settled(decided.join(at, "native_session_id"))
        seed = F.col("algorithm_version") == co.ALGORITHM_SEED
        reason = F.when(seed, "no accepted match of another tool").otherwise(F.concat(F.lit("linked through "), "other_id"))
        links = told.select(F.lit(store.next_number()).cast("long").alias("seq"), F.lit("link").alias("action"), "global_id", "native_session_id", "confidence", "algorithm_version", F.lit(ACTOR).alias("actor"), reason.alias("reason"), F.col("ended").alias("created_at"))
        links = settled(links)
        born = told.where(seed).select("global_id", "objective", F.col("began").alias("created_at"), F.col("began").alias("updated_at"))
        none = F.lit(None).cast("string")
        touches = told.groupBy("global_id").agg(F.max("ended").alias("updated_at")).select("global_id", none.alias("objective"), none.alias("created_at"), "updated_at")
        globals_ = settled(born.unionByName(touches))
        # Handoffs of the global sessions that gained events or members.
        after = settled(members.unionByName(links.select("native_session_id", "global_id")).distinct())
        touched = after.join(changed, "native_session_id", "left_semi").select("global_id").distinct()
        theirs = settled(after.join(touched, "global_id", "left_semi"))
        named = store.globals(globals_).join(touched, "global_id", "left_semi")
        made = settled(handoffs(log.join(theirs.select("native_session_id").distinct(), "native_session_id", "left_semi"), theirs, named))
        out = {"summaries": fresh, "decisions": links, "globals": globals_, "candidates": _candidates(store, every, changed, decided, threshold)}
        return out | store.fresh_handoffs(made, commits)

    return store.transact(stream, batch, make)


def _candidates(store: Store, every: DataFrame, changed: DataFrame, decided: DataFrame, threshold: float) -> DataFrame:
    """Candidates that come new or are scored anew: the links, each changed session's best pair, and pending ones of changed sessions.

    Pairs below the threshold are those that meet by a rare term or by workspace and week.
    """
    known = store.candidates()
    links = decided.where("other_id is not null").select(F.least("native_session_id", "other_id").alias("a"), F.greatest("native_session_id", "other_id").alias("b"))
    mine = changed.select(F.col("native_session_id").alias("mine"))
    pairs = settled(co.linkable_pairs(every, threshold))
    near = pairs.join(mine, F.col("a") == F.col("mine"), "left_semi").unionByName(pairs.join(mine, F.col("b") == F.col("mine"), "left_semi")).distinct()
    scores = co.pair_scores(every, near)
    side = lambda x, y: scores.select(F.col(x).alias("id"), F.col(y).alias("other"), "score")
    best = side("left_id", "right_id").unionByName(side("right_id", "left_id")).join(mine, F.col("id") == F.col("mine"), "left_semi").groupBy("id").agg(F.max(F.struct("score", "other")).alias("x"))
    best = best.select(F.least("id", "x.other").alias("a"), F.greatest("id", "x.other").alias("b"))
    pending = known.where("status = 'pending'").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    pending = pending.join(mine, F.col("a") == F.col("mine"), "left_semi").unionByName(pending.join(mine, F.col("b") == F.col("mine"), "left_semi"))
    fresh = co.candidates(co.pair_scores(every, links.unionByName(best).unionByName(pending).distinct()), threshold)
    # An accepted candidate is a link that was made; what only reaches the threshold waits for a review.
    made = links.select(co.candidate_id(F.col("a"), F.col("b")).alias("made")).distinct()
    fresh = fresh.join(made, F.col("candidate_id") == F.col("made"), "left").withColumn("status", F.when(F.col("made").isNotNull(), "accepted").otherwise("pending")).drop("made")
    fresh = settled(fresh)
    old = known.join(fresh.select("candidate_id"), "candidate_id", "left_semi")
    kept = old.where("status = 'accepted'").select("candidate_id", F.lit(True).alias("kept"))
    merged = co.upsert_candidates(old, fresh).join(kept, "candidate_id", "left")
    return merged.withColumn("status", F.when(F.col("kept"), "accepted").otherwise(F.col("status"))).drop("kept")


def commit_rows(store: Store, most: int = MOST_COMMITS) -> DataFrame:
    """The store's commits as a stream."""
    Files(store.spark, f"{store.path}/commits").make()
    return store.spark.readStream.schema(COMMITS).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", most).json(f"{store.path}/commits")


def new_ranges(batch: DataFrame) -> list[tuple[int, int]]:
    """Where the ingestion ids of a few commits' events lie: behind the first number, up to the second."""
    found = batch.where("number is not null and counts['events'] > 0").select("base", "top").collect()
    return _joined([(r["base"], r["top"]) for r in found])


def reconcile_stream(store: Store, checkpoint: str, threshold: float = co.THRESHOLD, once: bool = True, most_commits: int = MOST_COMMITS, seconds: int = 30) -> StreamingQuery:
    """Follows the store's commits; with ``once``, those that are there."""
    def run(batch: DataFrame, batch_id: int) -> None:
        reconcile_batch(store, batch_id, new_ranges(batch), threshold)

    writer = commit_rows(store, most_commits).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def reconcile_now(store: Store, checkpoint: str, tries: int = 3, **options) -> None:
    """Runs the stream until it has caught up; a failed batch is tried again."""
    for left in reversed(range(tries)):
        try:
            reconcile_stream(store, checkpoint, once=True, **options).awaitTermination()
            return
        except StreamingQueryException:
            if not left:
                raise
