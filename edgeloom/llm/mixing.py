"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is its weighted share of the mix, at most ``cap`` times its size; what
is cut off goes to the others by weight, until none is above.  With rate = target / size
each document of the source gets ``floor(rate)`` whole copies.  The rest, an inclusion
probability p = rate - floor(rate), is sampled without replacement and with a fixed
size: documents are ranked by the odds of a random number u over the odds of p, and the
first ones are taken whose sizes fill the source's remaining words.

u is a hash of the document id, so reruns agree.  The ranks are never sorted in one
place: sizes are summed by (source, bin of u), a window over at most ``BINS`` rows a source finds the
bin where the remainder ends, and only that bin's rows (about 1 in ``BINS``) are ordered.

Null and empty texts have size 0 and are taken with 0 words.  A null source is a source
of its own, last in order.  Rows with equal ids (null ones too) have equal ranks and are ordered by size; rows that
are equal in that as well are counted, not ordered, and if only some of them fit, those that
stand first in the input are taken, so reruns over the same files agree.  An empty table gives an empty result.
Columns of ``docs`` may have any names: ``mixed`` renames those that its own ones clash with to ``_own_<name>``.
A rate, and so the inclusion odds, is one for a source; the division by them matters between sources, where
the cuts are, and leaves the order inside a source to chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.shared import materialize

BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1) made of the first 48 bits of the md5 of ``key``."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source (null last); a table with a row per source.

    Sources with the smallest cap for their weight reach it first, so the capped ones are a
    prefix of the order by cap / weight and the level of the others follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = own.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    own = own.withColumn("_cap", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").cast("binary").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    own = own.withColumn("_rest", F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    own = own.withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    own = own.withColumn("_capped", F.col("_cap") * F.col("_open") <= F.col("_rest") * F.col("_w"))
    # of the open sources the first has the largest rest and the largest weight left: the level's
    level_rest = F.max(F.when(~F.col("_capped"), F.col("_rest"))).over(everything)
    level_open = F.max(F.when(~F.col("_capped"), F.col("_open"))).over(everything)
    own = own.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(level_rest * F.col("_w") / level_open))
    return own.select("source", "source_size", "target")


def ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's columns of ``plan``, their rank and its bin; no shuffle of ``rows`` while the plan is small."""
    plan = plan.withColumnRenamed("source", "_source")
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["_source"]), "left").drop("_source")
    u = uniform(F.col("doc_id"))
    rows = rows.withColumn("_rank", F.when(F.col("_p") > 0, u / (1 - u) / (F.col("_p") / (1 - F.col("_p")))))
    # q / (1 + q) puts the ranks, in their order, on [0, 1); a bin is an interval of it
    return rows.withColumn("_bin", F.least(F.floor(BINS * F.col("_rank") / (1 + F.col("_rank"))), F.lit(BINS - 1)).cast("int"))


def mixing_plan(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row per source: its target, whole copies, and the bin and rank up to which documents get one more copy."""
    targets = source_targets(sizes, weights, share, cap)
    targets = targets.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    targets = targets.withColumn("_whole", F.floor("_rate")).withColumn("_p", F.col("_rate") - F.col("_whole"))
    targets = materialize(targets.withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size")).drop("_rate"), "targets")
    rows = ranked(sizes, targets).filter("_p > 0")
    bins = rows.groupBy("source", "_bin").agg(F.sum("size").alias("_size"), F.first("_need").alias("_need"))
    up_to = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_size").over(up_to), F.lit(0))).filter("_before <= _need and _before + _size > _need")
    edges = materialize(bins.groupBy("source").agg(F.min(F.struct("_bin", "_before")).alias("_e")).select(F.col("source").alias("_s"), "_e._bin", "_e._before").withColumnRenamed("_bin", "_edge"), "edges")
    last = rows.join(edges, rows["source"].eqNullSafe(edges["_s"]) & (rows["_bin"] == edges["_edge"])).drop("_s")
    # equal rows are one tie, of which as many are taken as fit
    ties = last.groupBy("source", "_before", "_need", "_rank", "doc_id", "size").agg(F.count("*").alias("_m"))
    inside = Window.partitionBy("source").orderBy("_rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_need") - F.col("_before") - F.coalesce(F.sum(F.col("_m") * F.col("size")).over(inside), F.lit(0))
    fit = F.when(F.col("size") > 0, F.floor((F.col("_room") - F.col("size") / 2.0) / F.col("size")) + 1).otherwise(F.when(F.col("_room") >= 0, F.col("_m")).otherwise(0))
    ties = ties.withColumn("_room", room).withColumn("_t", F.least(F.col("_m"), fit).cast("long")).filter("_t > 0")
    cuts = ties.groupBy("source").agg(F.max(F.struct("_rank", "doc_id", "size", "_t", "_m")).alias("_c")).select(F.col("source").alias("_cs"), F.struct("_c._rank", "_c.doc_id", "_c.size").alias("_cut"), "_c._t", F.col("_c._m").alias("_m"))
    plan = targets.join(edges.drop("_before"), targets["source"].eqNullSafe(edges["_s"]), "left").drop("_s")
    plan = materialize(plan.join(cuts, plan["source"].eqNullSafe(cuts["_cs"]), "left").drop("_cs"), "mix")
    if not plan.filter("_t < _m").head(1):
        return plan.withColumn("_until", F.lit(None).cast("long"))
    return materialize(_part_of_ties(sizes, plan), "mix")


def _part_of_ties(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``_until``, the place ``_at`` of the last row that is taken of a source's tie, where not all of it is.

    Places rise by input partition; the partition in which the tie's rows run out is found from
    their counts, and only its rows are ordered.
    """
    tied = ranked(sizes, plan.filter("_t < _m")).filter((F.col("_bin") == F.col("_edge")) & (F.struct("_rank", "doc_id", "size") == F.col("_cut")))
    tied = tied.select("source", "_t", "_at", F.shiftright("_at", 33).alias("_part"))
    parts = tied.groupBy("source", "_part").agg(F.count("*").alias("_n"), F.first("_t").alias("_t"))
    up_to = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_less", F.coalesce(F.sum("_n").over(up_to), F.lit(0))).filter("_less < _t and _less + _n >= _t")
    parts = parts.select(F.col("source").alias("_ps"), F.col("_part").alias("_pp"), "_less")
    inside = tied.join(parts, tied["source"].eqNullSafe(parts["_ps"]) & (tied["_part"] == parts["_pp"]))
    order = Window.partitionBy("source").orderBy("_at")
    until = inside.withColumn("_number", F.col("_less") + F.row_number().over(order)).filter("_number = _t").select(F.col("source").alias("_us"), F.col("_at").alias("_until"))
    return plan.join(until, plan["source"].eqNullSafe(until["_us"]), "left").drop("_us")


def apply_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``doc_id``, ``source``, ``size`` and their place ``_at``) and their ``source_size, target, copies, taken``."""
    columns = [c for c in rows.columns if c != "_at"]
    out = ranked(rows, plan)
    own = F.struct("_rank", "doc_id", "size")
    in_edge = (own < F.col("_cut")) | ((own == F.col("_cut")) & (F.col("_until").isNull() | (F.col("_at") <= F.col("_until"))))
    more = (F.col("_p") > 0) & ((F.col("_bin") < F.col("_edge")) | ((F.col("_bin") == F.col("_edge")) & in_edge))
    out = out.withColumn("copies", (F.col("_whole") + F.when(more, 1).otherwise(0)).cast("long"))
    return out.select(*columns, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _sizes(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"), F.monotonically_increasing_id().alias("_at"), *more)


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of each row of ``docs``; texts are read once."""
    sizes = materialize(_sizes(docs), "sizes")
    return apply_plan(sizes, mixing_plan(sizes, **options))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``size, source_size, target, copies, taken``."""
    plan = mixing_plan(materialize(_sizes(docs), "sizes"), **options)
    made = ("size", "source_size", "target", "copies", "taken")
    rows = apply_plan(_sizes(docs, F.struct("*").alias("_doc")), plan).filter("copies > 0")
    kept = [F.col("_doc")[c].alias(f"_own_{c}" if c in made else c) for c in docs.columns]
    return rows.select(*kept, *made)
