"""Seeded sampling, reshuffling, buckets and batches. Order comes from md5 of seed and key, so any engine can repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def drawn(column: str) -> Column:
    """The stretch of a draw: its first three digits, so there are 4,096 of about equal size."""
    return F.substring(column, 1, 3)


def stretch(key: str) -> Column:
    """The stretch of a whole number: 65,536 values in a row."""
    return F.floor(F.col(key) / 65536)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, part: Column | None = None) -> DataFrame:
    """df with the place (a long, from 1) of each row among those of its group, ordered by columns.

    part: a stretch of the order, as a column that rises with it. Rows are sorted within a stretch and moved by the
    number of rows before it, so a group of any size is many tasks' work.
    """
    cut = df.withColumn("__part", stretch(order[0]) if part is None else part)
    keys = [*by, "__part"]
    sizes = cut.groupBy(*keys).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.coalesce(before, F.lit(0)).alias("__before"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    here = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = cut.withColumn("__here", here).join(starts, same).withColumn(name, F.col("__here") + F.col("__before"))
    return out.drop("__part", "__here", "__before", *[f"__{i}" for i in range(len(keys))])


def ratio_sample(df: DataFrame, by: str, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Of each group, the half-even rounded share of its rows with the least draws; the seed starts anew in each group."""
    size = df.groupBy(by).agg(F.bround(F.count("*") * F.lit(ratio)).cast("long").alias("__keep"))
    ranked = numbered(df.withColumn("__draw", draw(seed, key)), [by], ["__draw", key], "__rank", drawn("__draw"))
    return ranked.join(size, by).filter("__rank <= __keep").drop("__rank", "__keep", "__draw")


def epoch_shuffle(df: DataFrame, by: str, key: str, seed: int, epoch: int) -> DataFrame:
    """Rows of each group with their place in an epoch's order."""
    return numbered(df.withColumn("__draw", draw(seed + epoch, key)), [by], ["__draw", key], "place", drawn("__draw")).drop("__draw")


def next_valid(df: DataFrame, by: str, order: str, valid: Column, value: str) -> DataFrame:
    """An invalid row takes the value of the next valid one of its group, after the last the first."""
    ahead = Window.partitionBy(by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mine = F.when(valid, F.col(value))
    return df.withColumn("used", F.coalesce(mine, F.first(mine, True).over(ahead), F.first(mine, True).over(whole)))


def bucket_batches(df: DataFrame, buckets: list[str], key: str, size: int, seed: int = 0, drop_short: bool = False) -> DataFrame:
    """Rows with the batch of their bucket; a short last batch can be left out."""
    placed = numbered(df.withColumn("__draw", draw(seed, key)), buckets, ["__draw", key], "__p", drawn("__draw"))
    out = placed.withColumn("batch", F.floor((F.col("__p") - 1) / size).cast("long")).drop("__draw", "__p")
    if drop_short:
        out = out.withColumn("__n", F.count("*").over(Window.partitionBy(*buckets, "batch"))).filter(F.col("__n") == size).drop("__n")
    return out


def scale_batches(df: DataFrame, group: str, key: str, wide: str, high: str, scales: list[tuple[int, int]], base: int, divisor: int = 8, cap: float = 10.0) -> DataFrame:
    """Each row dealt to a scale in turn, and within it to batches whose size keeps the pixels of base; batch ratio: mean of width over height, capped."""
    snapped = [(max(divisor, round(w / divisor) * divisor), max(divisor, round(h / divisor) * divisor)) for w, h in scales]
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(max(1, base // (w * h))).alias("n")) for w, h in snapped])
    dealt = numbered(df, [group], [key], "__p").withColumn("__p", F.col("__p") - 1).withColumn("scale", F.pmod(F.col("__p"), F.lit(len(scales))).cast("int"))
    dealt = dealt.withColumn("__s", F.element_at(table, F.col("scale") + 1)).withColumn("__k", F.floor(F.col("__p") / len(scales)))
    batched = dealt.withColumn("batch", F.floor(F.col("__k") / F.col("__s.n")).cast("long"))
    return batched.groupBy(group, "scale", "batch").agg(
        F.count("*").alias("n"), F.first("__s.w").alias("width"), F.first("__s.h").alias("height"),
        F.least(F.avg(F.col(wide) / F.col(high)), F.lit(cap)).alias("ratio"),
    )


def shard(df: DataFrame, key: str, number: int, total: int) -> DataFrame:
    return df.filter(F.pmod(F.col(key), F.lit(total)) == number)
