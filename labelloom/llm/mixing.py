"""Mixing sources to target weights by entropy balancing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import SPACE, whole_text
from labelloom.session import materialize

#: A document is taken at most this often.
MOST_COPIES = 3
#: Rates are rounded to multiples of 2^-20, so that their sums are exact and reruns agree.
UNIT = 1 << 20
#: Documents of one source and size are ranked in this many hashed parts.
PARTS = 256
TOLERANCE = 1e-9
MOST_STEPS = 60
REPAIR_STEPS = 6


def word_count(text_col: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.regexp_count(whole_text(text_col), F.lit(f"[^{SPACE}]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Target of each source from rows (source, source_size).

    Sources in code point order, null last, get the weights in turn and share the total
    by weight; no target exceeds MOST_COPIES times the size of its source, and what is
    cut is shared again by weight until none exceeds it. That fixed point is
    min(cap, level * weight) for one level, found by running sums over the sources in
    the order in which they reach their caps. There is one row per source here.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighted = sizes.select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight"),
        (F.col("source_size") * float(MOST_COPIES)).alias("cap"),
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    levels = weighted.select(
        "*",
        ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)).alias("level"),
    )
    # the first source that stays below its cap fixes the level of all after it
    fixed = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)
    return levels.select(
        "source", F.col("source_size"), "weight",
        F.least("cap", F.coalesce(fixed["level"] * F.col("weight"), F.col("cap"))).alias("target"),
    )


def rate(tilt: Column, size: Column) -> Column:
    """Expected copies of a document: 1 at tilt 0, rising or falling with its size, below MOST_COPIES."""
    return F.lit(float(MOST_COPIES)) / (1 + (MOST_COPIES - 1) * F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), tilt * size))))


def balance(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """Tilt of each source so that the expected words of the mix meet its target.

    The rates of least relative entropy to "every document once" among those between 0
    and MOST_COPIES that fulfil sum(size * rate) = target are exponential tilts of the
    size. The dual is convex with one variable per source, so a Newton step needs two
    sums per source over the histogram (source, size, n); steps that leave the known
    bracket are replaced by halving it. Sizes are measured in units of the source's
    mean size weighted by size, which bounds the steps.
    """
    scaled = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    state = materialize(
        targets.alias("t").join(scaled.alias("s"), same("t", "s")).select(
            "t.source", "target", "source_size", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.lit(0.0).alias("tilt"),
            F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), (F.col("target") >= MOST_COPIES * F.col("source_size")).alias("full"),
            F.lit(False).alias("done"),
        ),
        "mix-tilts",
    )
    for _ in range(MOST_STEPS):
        each = rate(F.col("tilt"), F.col("size") / F.col("scale"))
        sums = (
            histogram.alias("h").join(state.where(~F.col("full") & ~F.col("done")).alias("t"), same("h", "t"))
            .select("t.source", "n", "size", each.alias("each"), "scale")
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("size") * F.col("each")).alias("got"),
                F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("scale") * F.col("each") * (1 - F.col("each") / MOST_COPIES)).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("slope")
        # far from the answer the bracket is grown or halved
        middle = F.when(high > 1e5, F.greatest(F.abs("tilt") * 2, F.lit(1.0))).when(low < -1e5, -F.greatest(F.abs("tilt") * 2, F.lit(1.0))).otherwise((low + high) / 2)
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high) & (F.abs(newton - F.col("tilt")) < 8)
        near = (F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))) | (high - low < 1e-12)
        stay = F.col("got").isNull() | F.col("full") | F.col("done") | near
        state = materialize(
            state.alias("t").join(sums.alias("s"), same("t", "s"), "left").select(
                "t.source", "target", "source_size", "scale",
                F.when(stay, F.col("tilt")).otherwise(F.when(inside, newton).otherwise(middle)).alias("tilt"),
                F.when(stay, F.col("low")).otherwise(low).alias("low"), F.when(stay, F.col("high")).otherwise(high).alias("high"),
                "full", stay.alias("done"),
            ),
            "mix-tilts",
        )
        if state.where("not done").isEmpty():
            break
    return state.select("source", "target", "source_size", "full", "scale", F.round("tilt", 8).alias("tilt"))


def group_copies(histogram: DataFrame, tilts: DataFrame) -> DataFrame:
    """Copies that all documents of one source and size get together.

    Rates become whole copies by systematic rounding along descending sizes: running
    sums of the rates are rounded, which leaves an error below one largest document
    per source. A few repair steps then add or take one copy of the document size
    nearest to what is missing.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    units = F.when(F.col("full"), F.lit(MOST_COPIES * UNIT)).otherwise(
        F.floor(rate(F.col("tilt"), F.col("size") / F.col("scale")) * UNIT)
    ).cast("long")
    along = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = (
        histogram.alias("h").join(tilts.alias("t"), same("h", "t"))
        .select("h.source", "size", "n", "target", "source_size", units.alias("units"))
        .withColumn("sum", F.sum(F.col("n") * F.col("units")).over(along))
    )
    rounded = lambda x: F.floor((x + UNIT // 2) / UNIT).cast("long")
    copies = materialize(
        running.select(
            "source", "size", "n", "target", "source_size",
            (rounded(F.col("sum")) - rounded(F.col("sum") - F.col("n") * F.col("units"))).alias("copies"),
        ),
        "mix-copies",
    )
    for _ in range(REPAIR_STEPS):
        missing = copies.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("missing"))
        with_gap = copies.alias("c").join(missing.alias("m"), same("c", "m"))
        usable = F.when(F.col("missing") > 0, F.col("copies") < MOST_COPIES * F.col("n")).otherwise(F.col("copies") > 0)
        pick = (
            with_gap.where(usable & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("missing")))
            .groupBy("c.source")
            .agg(F.min(F.struct(F.abs(F.col("size") - F.abs("missing")).alias("off"), F.col("size").alias("size"), F.signum("missing").cast("long").alias("step"))).alias("p"))
            .select("source", F.col("p.size").alias("size"), F.col("p.step").alias("step"))
        )
        if pick.isEmpty():
            break
        copies = materialize(
            copies.alias("c").join(pick.alias("p"), same("c", "p") & (F.col("c.size") == F.col("p.size")), "left").select(
                "c.source", "c.size", "n", "target", "source_size", (F.col("copies") + F.coalesce("step", F.lit(0))).cast("long").alias("copies")
            ),
            "mix-copies",
        )
    return copies


ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    size_col: str | None = None, weights: tuple[int, ...] = (1, 2, 3),
) -> DataFrame:
    """Documents, each as a struct `row`, with the number of copies that brings every source to its target.

    Beside the row, whose columns may have any names, there are size, source_size,
    target, rate, copies and taken (copies * size). Size is the number
    of words, or *size_col* if given. See `source_targets` for the targets, `balance`
    for the rates and `group_copies` for the rounding. Documents of one source and
    size share a rate; who of them gets a copy more is decided by rank in a hashed
    order of the ids, so reruns agree. Ranks are taken in PARTS parts per group, so a
    group may hold any share of the rows.

    Null texts and empty texts have size 0 and stay once. A null source is a source of
    its own, last in order. An empty table gives an empty result.
    """
    size = F.col(size_col).cast("long") if size_col else word_count(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).alias("size"), F.col(id_col).alias("id"))
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    parts = materialize(
        rows.select("source", "size", part.alias("part")).groupBy("source", "size", "part").agg(F.count("*").alias("n")), "mix-sizes"
    )
    histogram = materialize(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    tilts = balance(histogram, source_targets(sources, weights))
    copies = group_copies(histogram, tilts)
    same = F.col("c.source").eqNullSafe(F.col("o.source")) & (F.col("c.size") == F.col("o.size"))
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    plan = copies.alias("c").join(offsets.alias("o"), same).join(
        tilts.select(F.col("source").alias("ts"), "tilt", "scale", "full").alias("t"), F.col("c.source").eqNullSafe(F.col("ts"))
    ).select(
        F.col("c.source").alias("ps"), F.col("c.size").alias("pz"), F.col("part").alias("pp"), "before", "n", "copies", "target", "source_size",
        F.when(F.col("full"), F.lit(float(MOST_COPIES))).otherwise(rate(F.col("tilt"), F.col("c.size") / F.col("scale"))).alias("rate"),
    )
    ranked = rows.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64(F.lit("mix"), "id"), "id"))
    )
    placed = ranked.join(plan, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")) & (F.col("part") == F.col("pp")))
    place = F.col("before") + F.col("rank")
    share = lambda k: F.floor(k * F.col("copies") / F.col("n")).cast("long")
    own = share(place) - share(place - 1)
    return placed.select(
        "row", F.col("size"), F.col("source_size").cast("long").alias("source_size"), "target", "rate",
        own.alias("copies"), (own * F.col("size")).alias("taken"),
    )


def mix_sources(docs: DataFrame, *args, **options) -> DataFrame:
    """The columns of the documents and those that `mixed_rows` adds, which replace columns of their names."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return mixed_rows(docs, *args, **options).select(*kept, *ADDED)


def mixed_documents(docs: DataFrame, *args, **options) -> DataFrame:
    """The documents of a mix, each as often as its copies say, with their own columns as they were."""
    rows = mixed_rows(docs, *args, **options).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
