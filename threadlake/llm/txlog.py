"""Transaction log reassembly: interleaved transactions with savepoints, folded into one store.

Each source's records form successive transactions. A running count of their ends
names the transaction that a record belongs to. A transaction's records are sorted
into one array, and a higher-order aggregate walks it with its live changes, its
stack of savepoints and what was undone. Live changes of committed transactions are
exploded; per key, each epoch's last change is held against the one before it, which gives the
change of the store's size and sum; running sums over epochs give its states.

Order, counts and keys are folded by blocks (``prefix``), so that neither a source
with most records nor a key with most changes meets in one task, and the number
of epochs is not bounded. Texts stay where they are read: only their checksum moves.

Defined cases: a null source is one of its own; a row without doc_id is no record;
rows with one doc_id follow each other by source and checksum; a null text, or a key
labelled toxic in any of its labels, deletes; deleting what isn't stored changes
nothing; an empty log has no rows. One transaction's records (numbers, no texts) are
held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.prefix import before, tree_key
from threadlake.llm.steps import stored

KINDS, KEYS, EPOCH = 17, 30_000, 64
LIVE = "array<struct<doc_id:bigint,key:bigint,code:bigint>>"
UNDONE = "array<struct<kind:string,doc_id:bigint,by:bigint,key:bigint>>"

# s: live changes, marks (how many were live at each open savepoint), undone ones. r: a record.
_KEEP = "coalesce(try_element_at(s.marks, -1), 0)"
_LOST = "transform({changes}, c -> named_struct('kind', '{kind}', 'doc_id', c.doc_id, 'by', {by}, 'key', c.key))"
FOLD = f"""aggregate(log,
  cast(named_struct('live', array(), 'marks', array(), 'undone', array()) as struct<live:{LIVE},marks:array<int>,undone:{UNDONE}>),
  (s, r) -> case r.op
    when 'change' then named_struct('live', array_append(s.live, named_struct('doc_id', r.doc_id, 'key', r.key, 'code', r.code)), 'marks', s.marks, 'undone', s.undone)
    when 'savepoint' then named_struct('live', s.live, 'marks', array_append(s.marks, size(s.live)), 'undone', s.undone)
    when 'rollback' then named_struct('live', slice(s.live, 1, {_KEEP}), 'marks', slice(s.marks, 1, greatest(0, size(s.marks) - 1)),
      'undone', concat(s.undone, {_LOST.format(changes=f"slice(s.live, {_KEEP} + 1, size(s.live))", kind="rollback", by="r.doc_id")}))
    else s end,
  s -> case try_element_at(log, -1).op when 'commit' then s
    else named_struct('live', slice(s.live, 1, 0), 'marks', s.marks,
      'undone', concat(s.undone, {_LOST.format(changes="s.live", kind="abort", by="if(try_element_at(log, -1).op = 'abort', try_element_at(log, -1).doc_id, null)")})) end)"""


def log_records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Records (doc_id, tree, op, key, code) of the documents; code: checksum of key and text, null for a deletion."""
    toxic = labels.where("toxic = 1 and doc_id is not null").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    kind, key = h % KINDS, F.floor(h / 100) % KEYS
    op = F.when(kind <= 1, "commit").when(kind == 2, "abort").when(kind <= 4, "savepoint").when(kind <= 6, "rollback").otherwise("change")
    code = F.when(op == "change", F.crc32(F.concat(key.cast("string"), F.lit(":"), "text").cast("binary")))
    rows = docs.where("doc_id is not null").select("doc_id", tree_key("source").alias("tree"), op.alias("op"), F.when(op == "change", key).alias("key"), code.alias("code"))
    return rows.join(toxic, "doc_id", "left").select("doc_id", "tree", "op", "key", F.when(F.col("toxic").isNull(), F.col("code")).alias("code"))


def reassembled(records: DataFrame, every: int = EPOCH) -> DataFrame:
    """One row for each transaction: tree, txn, commit (its place among all commits, null if it has none), epoch, live, undone.

    records(doc_id, tree, op, key, code): op is commit, abort, savepoint, rollback or change.
    """
    flags = {"_commit": (F.col("op") == "commit").cast("long"), "_end": F.col("op").isin("commit", "abort").cast("long")}
    rows = stored(records).withColumns(flags)
    ties = ("tree", "code")
    rows = before(rows, "doc_id", {"ordinal": ("_commit", "sum")}, ties=ties)
    rows = before(rows, "doc_id", {"txn": ("_end", "sum")}, by=("tree",), ties=ties)
    log = rows.groupBy("tree", "txn").agg(F.sort_array(F.collect_list(F.struct("doc_id", "code", "op", "key"))).alias("log"), F.max(F.when(F.col("op") == "commit", F.col("ordinal"))).alias("commit"))
    folded = log.withColumn("s", F.expr(FOLD))
    return stored(folded.select("tree", "txn", "commit", F.expr(f"commit div {every} + 1").alias("epoch"), "s.live", "s.undone"))


def applied(transactions: DataFrame) -> DataFrame:
    """The last applied change (doc_id, code) of each key in each epoch that has one."""
    changes = transactions.where("commit is not null").select("epoch", "commit", F.posexplode("live").alias("nth", "c"))
    last = changes.groupBy("c.key", "epoch").agg(F.max(F.struct("commit", "nth", "c.doc_id", "c.code")).alias("last"))
    return last.select("key", "epoch", "last.doc_id", "last.code")


def store_after(transactions: DataFrame, epoch: int | None = None) -> DataFrame:
    """The keys that are stored after an epoch (the last one by default), with the doc_id of their text."""
    last = applied(transactions if epoch is None else transactions.where(F.col("epoch") <= epoch))
    return last.groupBy("key").agg(F.max(F.struct("epoch", "doc_id", "code")).alias("last")).where("last.code is not null").select("key", "last.doc_id")


def states(transactions: DataFrame) -> DataFrame:
    """epoch, n (stored keys) and value (sum of their checksums) after each epoch."""
    held = applied(transactions).withColumn("mark", F.struct("epoch", "code"))
    steps = before(held, "epoch", {"prior": ("mark", "max")}, by=("key",))
    there = lambda c: F.col(c).isNotNull().cast("long")
    moved = steps.select("epoch", (there("code") - there("prior.code")).alias("dn"), (F.coalesce("code", F.lit(0)) - F.coalesce("prior.code", F.lit(0))).alias("dv"))
    spine = transactions.where("commit is not null").select("epoch", F.lit(0).cast("long").alias("dn"), F.lit(0).cast("long").alias("dv"))
    sums = moved.unionByName(spine).groupBy("epoch").agg(F.sum("dn").alias("dn"), F.sum("dv").alias("dv"))
    running = before(stored(sums), "epoch", {"n": ("dn", "sum"), "value": ("dv", "sum")})
    return running.select("epoch", (F.col("n") + F.col("dn")).alias("n"), (F.col("value") + F.col("dv")).alias("value"))


def undone(transactions: DataFrame) -> DataFrame:
    """kind, doc_id, by and key of every change that an abort or a rollback took back."""
    return transactions.select(F.explode("undone").alias("u")).select("u.*")


def replay(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """kind, id, n and value: the store after each epoch, and what was undone."""
    done = reassembled(log_records(docs, labels))
    after = states(done).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", "value")
    return after.unionByName(undone(done).select("kind", F.col("doc_id").alias("id"), F.col("by").alias("n"), F.col("key").alias("value")))


#: DuckDB: crc32 of a blob's hexadecimal digits, eight bits at a time.
CRC = "xor(list_reduce(list_transform(regexp_extract_all({hex}, '..'), lambda x: ('0x' || x)::ubigint), lambda c, b: xor(c >> 8, {table}[(xor(c, b) % 256)::int + 1]), 4294967295::ubigint), 4294967295::ubigint)::bigint"
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, (c % 2) * 3988292384::ubigint), i::ubigint))"


def crc_sql(value: str, table: str = "(select t from crc_table)") -> str:
    """DuckDB SQL for the crc32 of a text; crc_table(t) is to be there."""
    return CRC.format(hex=f"hex(encode({value}))", table=table)


def oracle(docs: str, labels: str, every: int = EPOCH) -> str:
    """DuckDB SQL for the same rows: each source's log is walked by recursion, epochs are looked up by as-of joins."""
    return f"""with recursive crc_table as (select {CRC_TABLE} as t),
hashed as (select doc_id, coalesce('=' || source, '-') as tree, text, {crc_sql('doc_id::varchar', 'crc_table.t')} as h from {docs}, crc_table where doc_id is not null),
ops as (select *, case when h % {KINDS} <= 1 then 'commit' when h % {KINDS} = 2 then 'abort' when h % {KINDS} <= 4 then 'savepoint' when h % {KINDS} <= 6 then 'rollback' else 'change' end as op, h // 100 % {KEYS} as key from hashed),
recs as (select doc_id, tree, op, key, case when op = 'change' and doc_id not in (select doc_id from {labels} where toxic = 1 and doc_id is not null) then {crc_sql("key || ':' || text", 'crc_table.t')} end as code from ops, crc_table),
log as (select *, row_number() over (partition by tree order by doc_id, code nulls first) as pos, count(*) over (partition by tree) as pos_end, count(*) filter (op = 'commit') over (order by doc_id, tree, code nulls first) as ordinal from recs),
walk as (
  select tree, 0::bigint as pos, []::struct(doc_id bigint, key bigint, code bigint)[] as live, []::bigint[] as marks, []::struct(doc_id bigint, key bigint, code bigint)[] as lost, null::varchar as why, null::bigint as undoer, []::struct(doc_id bigint, key bigint, code bigint)[] as done, null::bigint as ordinal from (select distinct tree from log)
  union all
  select w.tree, l.pos,
    case l.op when 'change' then list_append(w.live, struct_pack(doc_id := l.doc_id, key := l.key, code := l.code)) when 'rollback' then w.live[:coalesce(w.marks[-1], 0)] when 'savepoint' then w.live else [] end,
    case l.op when 'savepoint' then list_append(w.marks, len(w.live)::bigint) when 'rollback' then w.marks[:greatest(0, len(w.marks) - 1)] when 'change' then w.marks else [] end,
    case l.op when 'rollback' then w.live[coalesce(w.marks[-1], 0) + 1:] when 'abort' then w.live else [] end,
    l.op, l.doc_id, case l.op when 'commit' then w.live else [] end, l.ordinal
  from walk w join log l on l.tree = w.tree and l.pos = w.pos + 1),
gone as (
  select why as kind, unnest(lost) as c, undoer from walk where why in ('rollback', 'abort')
  union all select 'abort', unnest(live), null from walk w where pos = (select max(pos) from log l where l.tree = w.tree)),
commits as (select ordinal, (ordinal - 1) // {every} + 1 as epoch, done from walk where why = 'commit'),
changes as (select epoch, ordinal, unnest(list_transform(range(len(done)), lambda i: struct_pack(nth := i, key := done[i + 1].key, code := done[i + 1].code))) as c from commits),
last as (select c.key as key, epoch, arg_max(struct_pack(code := c.code), row(ordinal, c.nth)) as v from changes group by all),
epochs as (select distinct epoch from commits),
keys as (select distinct key from last),
held as (select e.epoch, l.v.code as code from (select epoch, key from epochs, keys) e asof join last l on e.key = l.key and e.epoch >= l.epoch),
sums as (select epoch, count(code) as n, coalesce(sum(code), 0)::bigint as value from held group by epoch)
select 'state' as kind, epoch as id, coalesce(n, 0)::bigint as n, coalesce(value, 0)::bigint as value from epochs left join sums using (epoch)
union all select kind, c.doc_id, undoer, c.key from gone"""
