"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source the documents are ordered by size, so that the copies' words stay within about one largest document of
the target, whatever the random offset. The rank in that order is a prefix sum in three levels (sizes of a source,
BUCKETS of a size, documents of a bucket), so no task holds a source: the first two run over counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.llm.common import WORD_RE

#: Weight of each source in turn, the share of all sizes that is taken, and the most that a target may be of its source's size.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BUCKETS = 64
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from ``sizes(source, source_size)``, a row for each source.

    Weights repeat over the sources in code-point order, NULL last. Sources are filled at a level that rises with
    their weights and stop at ``most`` times their size: the same as sharing out the excess by weight again and again.
    """
    n = len(weights)
    place = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(n))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("most", F.lit(most) * F.col("source_size"))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)).withColumn("k", F.row_number().over(order))
    w = w.withColumn("first_open", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("k"))).over(everything))
    w = w.withColumn("final", F.max(F.when(F.col("k") == F.col("first_open"), F.col("level"))).over(everything))
    target = F.when(F.col("first_open").isNull() | (F.col("k") < F.col("first_open")), F.col("most").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 for each source, the same in every run; 20 bits, so that sums with ranks are exact."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\u0001null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def _sampled(docs: DataFrame, seed: str, weights: tuple, share: float, most: int) -> DataFrame:
    """``docs`` with its columns by their places, mix_0 and so on, so that no name clashes; behind them size, source_size, target, copies and taken."""
    places = [f"mix_{k}" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, places, strict=True))
    ident, text = F.col(at["doc_id"]), F.col(at["text"])
    size = F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(ident.cast("string"), text, F.lit("")).cast("binary"))
    bucket = (F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % BUCKETS).alias("bucket")
    sized = docs.toDF(*places).select("*", F.col(at["source"]).alias("source"), size.alias("size"), bucket)
    groups = sized.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_size = groups.groupBy("source", "size").agg(F.sum("n").alias("n"))
    aims = targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most)
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("source", "size", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("below"))
    base = groups.select("source", "size", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("left"))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    base = base.alias("a").join(by_size.alias("b"), same & (F.col("a.size") == F.col("b.size"))).select("a.source", "a.size", "bucket", (F.col("left") + F.col("below")).alias("base"))
    base = base.alias("a").join(aims.alias("b"), same).select(F.col("a.source").alias("of_source"), F.col("a.size").alias("of_size"), F.col("bucket").alias("of_bucket"), "base", "source_size", "target")
    ranked = sized.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(ident)))
    on = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size")) & (F.col("bucket") == F.col("of_bucket"))
    rank = (F.col("base") + F.col("nth")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    found = ranked.join(base, on).withColumn("copies", (F.floor(rank * rate + u) - F.floor((rank - 1.0) * rate + u)).cast("long"))
    return found.select(*places, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


FIGURES = ("size", "source_size", "target", "copies", "taken")


def copies(docs: DataFrame, seed: str = SEED, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, copies and taken.

    size is the number of words (NULL: 0). Each document expects target / source_size copies; it is emitted once for
    each integer that the prefix sum of expected copies, moved by the source's offset, crosses. Documents of one size
    follow in order of a digest of the doc_id (of the text, where there is none) and of doc_id; of rows that repeat a
    doc_id, which one gets a copy is open. A source without words has target 0; an empty table gives no row. Extra
    columns may have any name; those named like a figure are left out.
    """
    found = _sampled(docs, seed, weights, share, most)
    return found.select(*[F.col(f"mix_{k}").alias(c) for k, c in enumerate(docs.columns) if c not in FIGURES], *FIGURES)


def mix(docs: DataFrame, seed: str = SEED, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: the columns of ``docs``, whatever their names, each row as often as it is taken."""
    found = _sampled(docs, seed, weights, share, most).where("copies > 0")
    places = [f"mix_{k}" for k in range(len(docs.columns))]
    return found.select(*places, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth")).select(*places).toDF(*docs.columns)
