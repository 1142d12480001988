"""Mixing sources to target weights by weighted fair queueing.

Sources weigh 1, 2, 3, repeating, in order of their names.  They share the
total size of the corpus by weight, but none gets more than three times its
own size; what is above is shared again.  Each source's documents are shuffled
by a hash and may be taken up to three times, one round after the other.  The
virtual finish time of a document in a round is the source's words up to and
with it, divided by the source's target; the document a source's target falls
into is served as far as the target goes, which is at time 1.  All of them
together are range-sorted by finish time and truncated at the total budget.

Scale: DataFrame operations only.  After one narrow pass over the texts all
work is on a row of numbers per document and round.  Running sums never put a
source or the whole queue into one task: documents fall into hash buckets
(about ``BUCKET`` rows each, so a source with a third of all rows is spread
out), the totals of the buckets are summed, and only then the rows within each
bucket.  The global queue is summed the same way, in buckets of finish time.

Defined cases: a null or blank text has size 0 and is never taken; the null
source comes last; rows equal in doc_id, source and text stand one behind the
other in the queue and are served in turn; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plume.llm import common as C

ROUNDS = 3
#: Rows per bucket of a running sum.
BUCKET = 20_000


def _sized(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(C.SPACE_WORD))
    return docs.select("doc_id", "source", _key(docs).alias("key"), words.cast("long").alias("size"))


def _key(docs: DataFrame) -> Column:
    """The place in the shuffled order: a hash of id and text."""
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs["text"], F.lit(""))))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): a row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    sources = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
               .withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1))
    everything = Window.partitionBy(F.lit(1))
    # the sources that fill up first come first; before each, what is left for the others
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * ROUNDS
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sources = sources.withColumn("left", left).withColumn("weights", weights)
    # source_size * 3 / weight <= left / weights: the source stops at its cap
    full = cap * F.col("weights") <= F.col("left") * F.col("weight")
    open_ = F.min(F.when(~full, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "left", "weights"))).over(everything)
    share = open_["left"].cast("double") * F.col("weight") / open_["weights"]
    return sources.select("source", "source_size", F.when(full | open_.isNull(), cap.cast("double")).otherwise(share).alias("target"))


def _running(rows: DataFrame, by: list[str], bucket: str, order: list, amount) -> DataFrame:
    """Adds ``sum``: the running sum of ``amount`` within ``by``, in order of
    ``bucket`` and then ``order``, ties together."""
    totals = rows.groupBy(*by, bucket).agg(F.sum(amount).alias("in_bucket"))
    # a row per bucket: a few for every BUCKET rows
    earlier = Window.partitionBy(*by, F.lit(1)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(c).alias(f"t_{c}") for c in [*by, bucket]),
                           F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy(*by, bucket).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    match = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in [*by, bucket]]
    summed = rows.withColumn("within", F.sum(amount).over(within))
    return (summed.join(totals, match).withColumn("sum", F.col("earlier") + F.col("within"))
            .drop("earlier", "within", *(f"t_{c}" for c in [*by, bucket])))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, rows, size, source_size, target, served, place):
    one row per distinct (doc_id, source, text), with how many rows it stands
    for; ``served`` are the words that its rows get together in each round,
    ``place`` the words before it in the queue (of its first round; null if
    nothing is taken)."""
    groups = C.checkpoint(_sized(docs).groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("rows")))
    buckets = groups.count() // BUCKET + 1
    amount = F.col("size") * F.col("rows")
    goals = C.checkpoint(targets(groups.select("source", amount.alias("size"))))
    budget = goals.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    at = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("long")
    queue = _running(groups.withColumn("bucket", at), ["source"], "bucket", ["key", "doc_id", "size"], amount)
    goals = goals.withColumnRenamed("source", "goal_source")
    queue = C.checkpoint(queue.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source", "bucket"))
    # every round of a document that its source's target reaches, and how far it does
    rounds = F.transform(F.array(*map(F.lit, range(ROUNDS))), lambda i: F.struct(
        i.alias("round"), (F.col("sum") - amount + F.col("source_size") * i).alias("start")))
    items = queue.withColumn("r", F.explode(rounds)).select("doc_id", "source", "key", "size", "rows", "target", "r.round", "r.start")
    served = F.least(F.floor(F.col("target") - F.col("start")), amount)
    items = items.withColumn("served", served).filter("served > 0") \
                 .withColumn("finish", (F.col("start") + F.col("served")) / F.col("target"))
    items = items.withColumn("bucket", (F.col("finish") * buckets * ROUNDS).cast("long"))
    ordered = _running(items, [], "bucket", ["finish", "key", "doc_id", "source", "round"], F.col("served"))
    before = F.col("sum") - F.col("served")
    cut = F.least(F.col("served"), F.greatest(F.lit(budget) - before, F.lit(0)))  # truncated at the budget
    per_round = F.array(*(F.coalesce(F.sum(F.when(F.col("round") == i, cut)), F.lit(0)) for i in range(ROUNDS)))
    taken = (ordered.groupBy("doc_id", "source", "key", "size")
             .agg(per_round.alias("served"), F.min(before).alias("place")))
    names = ["doc_id", "source", "key", "size"]
    right = taken.select(*(F.col(c).alias(f"t_{c}") for c in names), "served", "place")
    match = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in names]
    return queue.join(right, match, "left").select(
        *names[:3], "rows", "size", "source_size", "target", "served", "place")


def _taken(copy: Column) -> Column:
    """The words that the rows numbered ``copy`` (from 0) of a group take: in
    each round what is left when the rows before them are served."""
    left = F.transform("served", lambda s: F.least(F.greatest(s - copy * F.col("size"), F.lit(0)), F.col("size")))
    return F.coalesce(F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")), F.lit(0))


def digest(docs: DataFrame) -> DataFrame:
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "served", "rows")
    # the rows of a large group are made in many tasks
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(BUCKET).cast("long"))).alias("first")
    large = mixed.filter(F.col("rows") > BUCKET).select("*", blocks).repartition("doc_id", "size", "first")
    last = F.least(F.col("first") + BUCKET, F.col("rows")) - 1
    copies = [large.select("*", F.explode(F.sequence(F.col("first"), last)).alias("copy")).drop("first"),
              mixed.filter(F.col("rows") <= BUCKET).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))]
    return copies[0].unionByName(copies[1]).select("doc_id", "size", "source_size", "target", _taken(F.col("copy")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with ``size``, ``source_size``,
    ``target``, ``taken`` and ``place`` (under free names if the documents have
    columns of these names).  ``taken`` counts words: whole rounds, and of the
    document at the edge of its source's target the first words.  The mix is
    read in order of ``place``."""
    mixed = mix(docs).filter(F.exists("served", lambda s: s > 0))
    key, names = C.fresh(docs, "key"), {}
    keyed = docs.withColumn(key, _key(docs))
    added = ("size", "source_size", "target", "served", "rows", "place")
    right = mixed.select(F.col("key").alias("mix_key"), F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"),
                         *(F.col(c).alias(f"mix_{c}") for c in added))
    match = (F.col(key) == right["mix_key"]) & keyed["doc_id"].eqNullSafe(right["mix_id"]) & keyed["source"].eqNullSafe(right["mix_source"])
    held = keyed.join(right, match).select(
        F.struct(*(keyed[c] for c in docs.columns)).alias("row"), "mix_key", "mix_id", "mix_source",
        *(F.col(f"mix_{c}").alias(c) for c in added))
    # rows that are served alike in every round need no number among their group
    even = F.forall("served", lambda s: (s == 0) | (s == F.col("size") * F.col("rows")))
    uneven = held.filter(~even).withColumn("at", F.monotonically_increasing_id())
    uneven = C.checkpoint(uneven).withColumn("bucket", F.shiftright("at", 33))
    group = ["mix_key", "mix_id", "mix_source"]
    numbered = _running(uneven, group, "bucket", ["at"], F.lit(1)).withColumn("taken", _taken(F.col("sum") - 1))
    both = held.filter(even).withColumn("taken", _taken(F.lit(0).cast("long"))) \
               .unionByName(numbered.drop("at", "bucket", "sum").select(*held.columns, "taken"))
    for c in ("size", "source_size", "target", "taken", "place"):
        names[c] = C.fresh(docs, c)
    return both.filter("taken > 0").select("row.*", *(F.col(c).alias(n) for c, n in names.items()))
