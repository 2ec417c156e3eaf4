"""Windows, partitioning into tasks, and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.session import held


def hash_order(*keys: str | Column, seed: int = 42) -> Column:
    """A reproducible random order: md5 of the key and the seed."""
    return F.md5(F.concat(*[k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys], F.lit(f"-{seed}")))


def first_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group. Spark limits each group before the shuffle."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def row_index(rows: DataFrame, order: str, name: str = "row_index") -> DataFrame:
    """0, 1, ... in order over all rows, by counting range partitions first: no single task sorts everything. The partitions are
    held, as both uses of them must see the same ones."""
    parted = held(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    parted = parted.withColumn("_part", F.shiftright("_id", 33))
    first = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = first.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one small row a partition
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return parted.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, place).drop("_part", "_id", "_p", "_before")


def split_first_larger(index: Column, total: int, tasks: int) -> Column:
    """Contiguous tasks, the remainder to the first ones; index from 0."""
    size, more = divmod(total, tasks)
    edge = more * (size + 1)
    return F.when(index < edge, F.floor(index / (size + 1))).otherwise(F.lit(more) + F.floor((index - edge) / max(1, size))).cast("long")


def split_last_larger(index: Column, total: int, tasks: int) -> Column:
    """Contiguous tasks, the remainder to the last; fewer rows than tasks all go to the last."""
    size = total // tasks
    return F.lit(tasks - 1).cast("long") if size == 0 else F.least(F.floor(index / size), F.lit(tasks - 1)).cast("long")


def split_strided(index: Column, tasks: int) -> Column:
    """Every tasks-th row."""
    return F.pmod(index, F.lit(tasks)).cast("long")


def chunk(index: Column, size: int) -> Column:
    """Chunks of fixed size."""
    return F.floor(index / size).cast("long")


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows in hash order."""
    return rows.orderBy(hash_order(key, seed=seed), key).limit(n)


def ranked(rows: DataFrame, groups: list[str], order: Column, key: str, name: str, first: Column | None = None) -> DataFrame:
    """rows with their rank (from 1) in their group, by first (a small whole number), then order (hex text, evenly spread), then key.

    Ranks come from counts by the head of the order: only rows that share a head of four digits are sorted together, so a group is
    never one task's, however large.
    """
    lead = F.coalesce(first, F.lit(0)) if first is not None else F.lit(0)
    keyed = rows.withColumn("_h", order).withColumn("_bucket", lead.cast("long") * 65536 + F.conv(F.left(F.col("_h"), F.lit(4)), 16, 10).cast("long"))
    sizes = keyed.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_b")).agg(F.count("*").alias("_c"))
    own = [f"_g{i}" for i in range(len(groups))]
    before = sizes.withColumn("_before", F.sum("_c").over(Window.partitionBy(*own).orderBy("_b")) - F.col("_c")).drop("_c")
    on = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inner = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_h", key))
    return keyed.join(before, on).withColumn(name, F.col("_before") + inner).drop("_h", "_bucket", "_b", "_before", *own)


def stratified_sample(rows: DataFrame, group: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """Of each group the share of its rows, one at least, in hash order."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    size = rows.groupBy(F.col(group).alias("_g")).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(share))).alias("_take"))
    placed = ranked(rows, [group], hash_order(key, seed=seed), key, "_rn")
    return placed.join(size, F.col(group).eqNullSafe(F.col("_g"))).filter("_rn <= _take").drop("_rn", "_g", "_take")


def balanced_sample(rows: DataFrame, group: str, key: str, label: str, complete: str, positive: str = "accept", seed: int = 42) -> DataFrame:
    """All positives of each group and as many others, complete ones first. A group with fewer others than positives is an error."""
    n = rows.groupBy(F.col(group).alias("_g")).agg(F.count_if(F.col(label) == positive).alias("_pos"), F.count_if(F.col(label) != positive).alias("_neg"))
    enough = F.when(F.col("_neg") < F.col("_pos"), F.raise_error(F.concat(F.lit("fewer negatives than positives in "), F.col("_g").cast("string")))).otherwise(F.col("_pos"))
    every = rows.filter(F.col(label) == positive).join(n, F.col(group) == F.col("_g")).filter(enough > 0)
    others = ranked(rows.filter(F.col(label) != positive), [group], hash_order(key, seed=seed), key, "_rn", F.when(F.col(complete), 0).otherwise(1))
    few = others.join(n, F.col(group) == F.col("_g")).filter(F.col("_rn") <= enough)
    return every.select(*rows.columns).unionByName(few.select(*rows.columns))


def contamination_split(rows: DataFrame, group: str, key: str, pinned: str, pinned_groups: tuple = (2024, 2025), train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Column split. In pinned groups rows pinned to test or train stay there and others fill the test target in hash order; elsewhere hash order alone decides."""
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.count_if(F.col(pinned) == "test").alias("_t"))
    free = F.when(F.col(group).isin(*pinned_groups) & F.col(pinned).isin("test", "train"), 1).otherwise(0)
    placed = ranked(rows.withColumn("_free", free), [group, "_free"], hash_order(key, seed=seed), key, "_rn").join(sizes, F.col(group) == F.col("_g"))
    target = F.floor((F.lit(1.0) - F.lit(train_share)) * F.col("_n"))
    fill = F.greatest(F.lit(0), target - F.col("_t"))
    inside = F.when(F.col("_free") == 1, F.col(pinned)).when(F.col("_rn") <= fill, "test").otherwise("train")
    outside = F.when(F.col("_rn") <= F.floor(F.lit(train_share) * F.col("_n")), "train").otherwise("test")
    return placed.withColumn("split", F.when(F.col(group).isin(*pinned_groups), inside).otherwise(outside)).drop("_free", "_rn", "_g", "_n", "_t")
