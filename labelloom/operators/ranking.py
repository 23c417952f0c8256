"""Exact ranks inside groups without putting a whole group into one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.session import materialize

# Broadcast hints are only given to tables proven to have at most this many rows.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """Hint a broadcast only when the (already known) row count is bounded.

    Otherwise the join stays a shuffle join, which AQE splits on skew.
    """
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 64) -> DataFrame:
    """The first *n* rows of each group.

    Two rounds: first inside (group, salt), then inside the group, where at most
    n * salts rows are left. A group with a third of all rows is spread over
    *salts* tasks, and Spark prunes to n rows per map task before each shuffle.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(salts))
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(salted))
        .filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final))
        .filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )


def _hashable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in {
        "string", "long", "integer", "double", "float", "boolean", "timestamp", "timestamp_ntz", "date",
    }


def hash_order(seed: int, key: Column) -> Column:
    """Seeded, engine-independent pseudo-random order key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def assign_by_quota(
    df: DataFrame,
    cuts: Mapping[str, Sequence[int]],
    *,
    key: str = "sample_id",
    stratum: str = "stratum",
    output: str = "part",
    seed: int = 42,
    digits: int | None = None,
) -> DataFrame:
    """Give each row a part number by its hash rank inside its stratum.

    *cuts* maps each stratum to the ascending ranks at which the next part
    begins (part 0 starts at rank 0); like a label vocabulary it is small.

    Rows are never sorted per stratum. Hash prefixes form 16**digits even
    buckets, by default so many that a bucket of the largest stratum has some
    thousand rows; counting rows per (stratum, bucket) tells in which bucket each cut
    falls. Rows of all other buckets are decided by comparing bucket numbers,
    and only the rows of the buckets hit by a cut are ranked.
    """
    spark = df.sparkSession
    if digits is None:
        largest = max((int(c) for ranks in cuts.values() for c in ranks), default=0)
        digits = min(7, max(3, math.ceil(math.log(max(largest, 1) / 4096, 16)))) if largest > 4096 else 3
    hashed = df.withColumn("_h", hash_order(seed, F.col(key))).withColumn(
        "_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int")
    )
    running = Window.partitionBy(stratum).orderBy("_b")
    buckets = hashed.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wanted = spark.createDataFrame(
        [(name, int(c)) for name, ranks in cuts.items() for c in ranks], f"{stratum} string, _cut bigint"
    )
    # A cut lies in the bucket whose rows span its rank; one row per cut comes back.
    found = (
        buckets.select(stratum, "_b", "_n", F.sum("_n").over(running).alias("_end"))
        .join(small(wanted, sum(map(len, cuts.values()))), stratum)
        .filter("_cut >= _end - _n and _cut < _end")
        .select(stratum, "_b", F.expr("_cut - (_end - _n)").alias("_r"))
        .collect()
    )
    located: dict[str, list[tuple[int, int]]] = {name: [] for name in cuts}
    for name, bucket, rest in found:
        located[name].append((bucket, rest))
    places = spark.createDataFrame(list(located.items()), f"{stratum} string, _c array<struct<b:int,r:bigint>>")
    tagged = hashed.join(small(places, len(located)), stratum)
    on_cut = F.expr("exists(_c, c -> c.b = _b)")
    in_bucket = Window.partitionBy(stratum, "_b").orderBy("_h", key)
    clear = tagged.filter(~on_cut).select("*", F.lit(0).cast("bigint").alias("_r"))
    ranked = tagged.filter(on_cut).select("*", (F.row_number().over(in_bucket) - 1).cast("bigint").alias("_r"))
    passed = F.expr("size(filter(_c, c -> c.b < _b or (c.b = _b and c.r <= _r)))")
    return clear.unionByName(ranked).select(*df.columns, passed.alias(output))


# Distinct values of one group that one task ranks; larger groups are narrowed first.
VALUES_IN_TASK = 100_000
_BUCKETS = 1024


def _kind(x: Column) -> Column:
    """Class of a double, ascending: -inf, negative, zero, positive, inf, nan."""
    infinite = F.abs(x) == float("inf")
    return F.when(F.isnan(x), 3).otherwise(F.signum(x).cast("int") * F.when(infinite, 2).otherwise(1))


def _bucket(x: Column, lo: Column, hi: Column) -> Column:
    """Bucket of a value of the range from lo to hi (lo < hi), never falling as values rise.

    Ranges that mix classes part by class, wide ones by the exponent, narrow ones evenly,
    so a few dozen bits of sign, exponent and mantissa settle any range. The ends of a
    range are never in one bucket.
    """
    wide = F.when(lo > 0, hi / lo).otherwise(lo / hi) > 4.0
    even = (x - lo) / (hi - lo)
    ln = lambda v: F.signum(v) * F.log(F.abs(v))
    by_exponent = (ln(x) - ln(lo)) / (ln(hi) - ln(lo))
    scaled = F.floor(F.when(wide, by_exponent).otherwise(even) * _BUCKETS).cast("int")
    return F.when(_kind(lo) != _kind(hi), _kind(x)).otherwise(scaled)


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, output: str = "quantile", in_task: int = VALUES_IN_TASK
) -> DataFrame:
    """Linearly interpolated quantile per group (values as doubles), exact and skew-proof.

    Equal values are counted first. The range that holds the wanted rank of a group is
    then narrowed by radix selection: its values are counted in up to 1,025 buckets
    (combined before the shuffle), and the bucket with the rank is the next range, until
    at most *in_task* distinct values are left, which are ranked one by one. Only counts
    and ends of ranges are kept per group. Groups without a value have no row.
    """
    x = F.col("_x")
    counted = materialize(
        df.filter(F.col(value).isNotNull())
        .select(*keys, (F.col(value).cast("double") + 0.0).alias("_x"))
        .groupBy(*keys, "_x")
        .agg(F.count(F.lit(1)).alias("_n")),
        "quantile-counts",
    )
    rank = (F.col("_total") - 1) * F.lit(float(q))
    columns = ["_total", "_at", "_w", "_before", "_lo", "_hi", "_above", "_values"]
    states = (
        counted.groupBy(*keys)
        .agg(F.sum("_n").alias("_total"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_values"))
        .withColumns({
            "_at": F.floor(rank).cast("bigint"), "_w": rank - F.floor(rank),
            "_before": F.lit(0).cast("bigint"), "_above": F.lit(None).cast("double"),
        })
        .select(*keys, *columns)
    )
    in_range = x.between(F.col("_lo"), F.col("_hi"))
    large = F.col("_values") > in_task
    while not states.filter(large).isEmpty():
        bucket = _bucket(x, F.col("_lo"), F.col("_hi"))
        counts = (
            counted.join(states.filter(large), list(keys)).filter(in_range)
            .groupBy(*keys, "_total", "_at", "_w", "_before", "_above", bucket.alias("_b"))
            .agg(F.sum("_n").alias("_in"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_values"))
        )
        in_order = Window.partitionBy(*keys).orderBy("_b")
        narrowed = (
            counts.withColumn("_end", F.col("_before") + F.sum("_in").over(in_order))
            .withColumn("_above", F.coalesce(F.lead("_lo").over(in_order), F.col("_above")))
            .withColumn("_before", F.col("_end") - F.col("_in"))
            .filter((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_end")))
        )
        states = materialize(states.filter(~large).unionByName(narrowed.select(*keys, *columns)), "quantile-ranges")
    running = Window.partitionBy(*keys).orderBy("_x")
    ranked = (
        counted.join(states, list(keys)).filter(in_range)
        .withColumn("_end", F.col("_before") + F.sum("_n").over(running))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    at = lambda r: F.max(F.when((r >= F.col("_start")) & (r < F.col("_end")), x))
    low, weight = at(F.col("_at")), F.max("_w")
    # The next rank may lie just above the range.
    high = F.coalesce(at(F.col("_at") + 1), F.max("_above"), low)
    return ranked.groupBy(*keys).agg(F.when(weight == 0, low).otherwise(low * (1 - weight) + high * weight).alias(output))
