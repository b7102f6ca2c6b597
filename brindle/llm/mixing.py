"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue. Its documents are shuffled by a seeded hash, and may be sent up to `max_repeats` times, one pass
after another. A copy's virtual finish time is its source's cumulative words divided by the source's target; the mix sends
copies in global order of finish time until the total budget is used up.

All steps are DataFrame operations over (id, source, size); texts are never shuffled. Cumulative sums are made without a
window over a whole source: the shuffle hash cuts each source into buckets, a small table holds the buckets' sums, and only
the order within a bucket needs a sort. So a source with a third of all rows is spread like any other. The cut at the
budget works alike: finish times are binned, bins are summed, and only the bin in which the budget ends is sorted.

Defined cases: a null text has size 0; sources go by code point with null last, as a source of its own; repeated ids are
separate rows; a document of size 0 takes 0 words; if the budget is 0 (empty table, no words) nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import materialize, own_prefix, words_of

SEED = 20240607
#: Hex digits of the shuffle ticket that name a bucket of a source's queue: 16**3 buckets a source.
SLOT_DIGITS = 3
#: Bins per unit of virtual time in the search for the cut.
TIME_BINS = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: int = 3, budget: int | None = None) -> DataFrame:
    """(source, source_size, target) of a table (source, size); one row per source.

    Targets share the budget (by default all sizes) by weight; where a target would exceed max_repeats times its source it
    stops there and the excess goes to the others by weight. Water-filling: in order of size over weight, a source is capped
    if at the level of those before it would be; so the level is found by one running sum over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (k + 1).cast("int")))
    total = F.sum("source_size").over(Window.partitionBy()) if budget is None else F.lit(int(budget))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(max_repeats)).withColumn("_total", total)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(rest))
    # the first source that the level does not cap sets the level of all that follow
    free = F.when(F.col("_cap") >= F.col("_w") * F.col("_level"), F.col("_level"))
    per = per.withColumn("_set", F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.col("_w") * F.coalesce("_set", F.lit(float("inf")))
    return per.select("source", "source_size", F.least(F.col("_cap").cast("double"), share).alias("target"))


def finish_times(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: int = 3, budget: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """docs(id, source, size) -> (a row per document with its place in its source's queue, targets)."""
    targets = materialize(source_targets(docs, weights, max_repeats, budget), "targets")
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    queue = docs.withColumn("_ticket", ticket).withColumn("_slot", F.substring("_ticket", 1, SLOT_DIGITS))
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # null-safe join key
    queue = queue.withColumn("_source", source)
    sums = queue.groupBy("_source", "_slot").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy("_source", "_slot").orderBy("_ticket", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = queue.withColumn("_within", F.sum("size").over(inner))
    queue = queue.join(sums.select("_source", "_slot", "_before"), ["_source", "_slot"])
    named = targets.select(source.alias("_source"), "source_size", "target")
    queue = queue.join(named, "_source").withColumn("_done", F.col("_within") + F.coalesce("_before", F.lit(0)))
    return queue.select("id", "source", "size", "source_size", "target", "_ticket", "_done"), targets


def copies(queue: DataFrame, max_repeats: int = 3) -> DataFrame:
    """A row per copy that a document may be sent, with its virtual finish time. Documents without words have none."""
    out = queue.where("size > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    return out.withColumn("finish", (F.col("_done") + F.col("pass_no") * F.col("source_size")) / F.col("target"))


def sent_copies(queue: DataFrame, targets: DataFrame, max_repeats: int = 3) -> DataFrame:
    """The copies that the mix sends: in order of (finish, source, ticket, id, pass), as long as their words fit the budget."""
    spark = queue.sparkSession
    line = copies(queue, max_repeats).withColumn("_bin", F.floor(F.col("finish") * TIME_BINS))
    bins = line.groupBy("_bin").agg(F.sum("size").alias("_sum"))
    ran = F.sum("_sum").over(Window.orderBy("_bin"))
    budget = int(targets.agg(F.coalesce(F.round(F.sum("target")), F.lit(0)).cast("long")).first()[0])
    # bins are bounded (TIME_BINS a unit of time, times max_repeats and the ratio of the largest source to its target)
    cut = bins.withColumn("_ran", ran).where(F.col("_ran") > budget).orderBy("_bin").limit(1).select("_bin", (F.col("_ran") - F.col("_sum")).alias("_start")).first()
    if cut is None:
        return line.drop("_bin")
    edge, start = int(cut[0]), int(cut[1])
    order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "_ticket", "id", "pass_no", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = line.where(F.col("_bin") == edge).withColumn("_ran", F.sum("size").over(order) + F.lit(start)).where(F.col("_ran") <= budget).drop("_ran")
    return line.where(F.col("_bin") < edge).unionByName(last).drop("_bin")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: int = 3, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """(id, source, size, source_size, target, taken, copies): a row per row of docs, with what the mix takes of it."""
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), words_of(F.col(text)).alias("size")), "sizes")
    queue, targets = finish_times(sizes, weights, max_repeats, budget, seed=seed)
    queue = materialize(queue.withColumn("_row", F.monotonically_increasing_id()), "queue")
    sent = sent_copies(queue, targets, max_repeats).groupBy("_row").agg(F.sum("size").alias("taken"), F.count(F.lit(1)).alias("copies"))
    out = queue.join(sent, "_row", "left")
    return out.select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: int = 3, budget: int | None = None, ordered: bool = False) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; ordered: range-sorted by finish time, as a trainer reads it.

    Rows are told apart by id, source and size. Rows that are alike in all three are numbered (in order of text), and the n-th
    one takes the copies of the n-th place that they hold in the queue, so each row takes what mix_sources() says of it.
    """
    own = own_prefix(docs)
    keys = ("id", "source", "size")
    named = docs.withColumn(own + "id", F.col(id_col)).withColumn(own + "source", F.col(source)).withColumn(own + "size", words_of(F.col(text)))
    sizes = materialize(named.select(*(F.col(own + c).alias(c) for c in keys)), "sizes")
    queue, targets = finish_times(sizes, weights, max_repeats, budget)
    queue = materialize(queue.withColumn("_row", F.monotonically_increasing_id()), "queue")
    per = sent_copies(queue, targets, max_repeats).groupBy(*keys, "_row").agg(F.sort_array(F.collect_list("finish")).alias("finish"))
    # keys of several rows: few; all others are numbered 1 without a window over the texts
    again = materialize(sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*(F.col(c).alias(own + "a" + c) for c in keys)), "again")
    alike = F.lit(True)
    for c in keys:
        alike = alike & F.col(own + c).eqNullSafe(F.col(own + "a" + c))
    number = F.row_number().over(Window.partitionBy(*(own + c for c in keys)).orderBy(text, *(c for c in docs.columns if c != text and not isinstance(docs.schema[c].dataType, MapType))))
    several = named.join(again, alike, "left_semi").withColumn(own + "no", number)
    rows = named.join(again, alike, "left_anti").withColumn(own + "no", F.lit(1)).unionByName(several)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_row"))
    queued = queue.join(again, alike_of(queue, own, keys), "left_semi").select(*keys, "_row").withColumn("no", place)
    per = per.join(queued.select("_row", "no"), "_row", "left").select(*(F.col(c).alias(own + "q" + c) for c in keys), F.coalesce("no", F.lit(1)).alias(own + "qno"), F.col("finish").alias(own + "finish"))
    met = F.col(own + "no") == F.col(own + "qno")
    for c in keys:
        met = met & F.col(own + c).eqNullSafe(F.col(own + "q" + c))
    rows = rows.join(per, met).withColumn(own + "finish", F.explode(own + "finish"))
    if ordered:
        rows = rows.repartitionByRange(own + "finish").sortWithinPartitions(own + "finish")
    return rows.select(*docs.columns)


def alike_of(queue: DataFrame, own: str, keys: tuple[str, ...]) -> "F.Column":
    alike = F.lit(True)
    for c in keys:
        alike = alike & queue[c].eqNullSafe(F.col(own + "a" + c))
    return alike
