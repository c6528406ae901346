"""Mixing sources to target weights.

Tokens are summed per source, each source's target follows from its weight, and its repetition rate is
target / tokens. A document is emitted floor(rate) times, plus once more when a number drawn from a hash of
the seed, its id and its text falls below the fraction of the rate: reruns agree, whatever the partitioning.

A source's target is at most `max_repeats` times its tokens. The excess goes to the other sources by weight
until none is above; that fixed point has a closed form. With sources in the order of cap / weight, the first k are
full, and the others get weight * level, with level = (total - caps of the k) / (weights of the others).

The table of sources has one row per source. It is broadcast only below `BROADCAST_SOURCES` rows; beyond, the join
shuffles on the source, and adaptive execution splits a hot one.

Nulls: a null source is a source of its own, last in the order; a null text has size 0; a null id hashes as the empty
text. Repeated rows (same id and text) share their draw. Sources whose texts hold no word have target 0. An empty table
gives an empty result. A very long text is counted whole. Other columns, whatever their names, pass through `mix` untouched; `with_copies` refuses columns named like
those that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Sources in the order of their names' code points take these weights in turn.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
BROADCAST_SOURCES = 10_000

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes: source, size. One row per source: source, source_size, target. Its windows run over sources, not documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # Spark orders strings by their bytes: the order of code points
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        # full while its own cap is below what the level would give; from the first that is not, all share that level
        .withColumn("level", F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(everything))
    )
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed, the id and the text: 52 bits of an MD5."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(common.text_or_empty(text).cast("binary")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """docs with _size, _source_size, _target and _copies (0 to max_repeats)."""
    common.no_clash(docs, "_size", "_source_size", "_target", "_copies", "_draw", "_source")
    sized = docs.withColumn("_size", size_of(F.col("text"))).withColumn("_draw", draw(F.col("doc_id"), F.col("text"), seed))
    targets = source_targets(docs.select("source", size_of(F.col("text")).alias("size")), weights, max_repeats)
    targets = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    targets = common.stored(targets)
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("long")
    return sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).withColumn("_copies", copies.cast("int")).drop("_source", "_draw")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = with_copies(docs.select("doc_id", "source", "text", row), **how).where("_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_copies(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).cast("long").alias("taken"),
    )


OP3_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as text,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
w as (select source, sum(size)::bigint as source_size,
        ([5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
      from d group by source),
c as (select *, source_size * 3.0::double as cap from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
        / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as own_level from c),
t as (select source, source_size, least(cap, coalesce(weight * max(case when cap > weight * own_level then own_level end) over (), cap)) as target from l),
r as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
        ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::varchar, '') || ':' || md5(d.text)), 1, 13))::bigint / 4503599627370496.0::double as draw
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken from r
"""
