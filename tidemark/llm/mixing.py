"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all document rates that give each source its target number of tokens, entropy balancing takes those nearest to one
copy of everything (least relative entropy) under a ceiling of ``most`` copies.  Their form is known: a document of size
z in source s has the rate min(most, exp(lambda_s * z / mean_s)), mean_s being the mean size in the source.  What is
left is the convex dual, one number a source, and its gradient is the source's tokens at these rates less its target.
Newton steps find it: each is one aggregation by source over the counts of each size, kept inside a bracket that shrinks
with every step, so flat stretches (all documents at the ceiling) can't throw it out.  Several steps are one job.

Rates are then rounded into copies by a seeded hash of the row: floor(rate + 1 - u + shift_s), u uniform in (0, 1).
At shift 0 this is randomised rounding.  A row takes its next copy at a known shift, so one histogram of these shifts
tells for each source the shift at which the copies' tokens come nearest to the target from below.  Last, the document whose size comes nearest to
what is still missing or over gets one copy more or less, a few times: each is one aggregation.

The parameters are a table with one row a source.  It is joined, never collected; what runs over all sources in their order
runs in ranges of them, so that sources may be many.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged, word_count

#: Newton steps at most, each of which at least halves the bracket or converges quadratically, and steps of one job.
STEPS, TOGETHER = 32, 4
#: Cells of the histogram of shifts, and documents that get a copy more or less at the end.
CELLS, FIXES = 1 << 16, 3
#: Newton steps end when every source is this near to its target; rounding settles the rest.
TOLERANCE = 1e-4


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over the rows before, and with <name>_all, over all rows.

    Rows are dealt into ranges of ``order``; a window runs within each range, and another over the ranges, of which there is one
    a partition.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("mix_range", F.spark_partition_id()), "mixing-ranges")
    # files of ranges are read in any order, so the number of the range says which it is
    whole = ranged.groupBy("mix_range").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    ranges, everything = Window.orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = whole.select("mix_range", *(F.coalesce(F.sum(n).over(ranges), F.lit(0.0)).alias(f"mix_{n}") for n in sums), *(F.sum(n).over(everything).alias(f"{n}_all") for n in sums))
    inside = Window.partitionBy("mix_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumns({f"mix_in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for n, c in sums.items()})
    both = within.join(offsets, "mix_range")
    return both.select(*df.columns, *((F.col(f"mix_in_{n}") + F.col(f"mix_{n}")).alias(n) for n in sums), *(f"{n}_all" for n in sums))


def source_targets(sizes: DataFrame, most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """(source, source_size, n_docs, mean_size, target) from (source, size), or (source, size, n).

    Sources in the order of their code points, null last, get the weights in turn.  They share all tokens by weight; no
    target exceeds ``most`` times its source, what is above is shared again by weight.  That is a water level: the target
    is min(most * size, weight * level), and the level follows from running sums over sources sorted by the level at
    which each is full.
    """
    n = F.col("n") if "n" in sizes.columns else F.lit(1)
    totals = sizes.groupBy("source").agg(F.sum(n * F.col("size")).alias("source_size"), F.sum(n).alias("n_docs"))
    placed = _running(totals, [F.col("source").asc_nulls_last()], {"place": F.lit(1.0)})
    turn = F.pmod(F.col("place").cast("long"), F.lit(len(weights)))
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    sums = {"full": most * F.col("source_size"), "weights": F.col("weight"), "tokens": F.col("source_size").cast("double")}
    levels = staged(_running(weighed.select("source", "source_size", "n_docs", "weight", "full_at"), [F.col("full_at"), F.col("source").asc_nulls_last()], sums), "mixing-levels")
    level = (F.col("tokens_all") - F.col("full")) / (F.col("weights_all") - F.col("weights"))
    # the level at the first source, in that order, that stays below its ceiling; each source before it is full
    first = levels.filter(F.col("full_at") >= level * (1 - 1e-12)).agg(F.min(F.struct("full_at", level.alias("level"))).alias("own")).select("own.level")
    target = F.least(most * F.col("source_size"), F.coalesce(F.col("weight") * F.col("level"), most * F.col("source_size")))
    # one row
    both = levels.crossJoin(F.broadcast(first))
    return both.select("source", "source_size", "n_docs", (F.col("source_size") / F.col("n_docs")).alias("mean_size"), target.alias("target"))


def _log_rate(param: Column) -> Column:
    """Before the ceiling.  Rates grow or shrink with the size; an empty document keeps rate 1."""
    return param * F.col("size") / F.greatest("mean_size", F.lit(1e-9))


def _rate(most: float, param: Column) -> Column:
    return F.exp(F.least(F.log(F.lit(most)), _log_rate(param)))


def _to_params(docs: DataFrame, params: DataFrame) -> DataFrame:
    """Null is a source like any other.  The small side is broadcast by Spark only below its size limit; above it, skewed partitions are split."""
    return docs.join(params.withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")


def _carried(names: list[str]) -> list[Column]:
    """Columns that are the same in all rows of a source, through a groupBy: so a step needs no join after its aggregation."""
    return [F.first(n).alias(n) for n in names]


def _newton(sizes: DataFrame, params: DataFrame, known: list[str], most: float) -> DataFrame:
    """One step: (source, known, param, low, high, off), ``off`` being how far the old parameter was from its target."""
    rate, tokens = _rate(most, F.col("param")), F.col("n") * F.col("size")
    slope = F.when(_log_rate(F.col("param")) < F.log(F.lit(most)), rate * tokens * F.col("size") / F.greatest("mean_size", F.lit(1e-9))).otherwise(0.0)
    sums = _to_params(sizes, params.drop("off")).groupBy("source").agg(F.sum(rate * tokens).alias("got"), F.sum(slope).alias("slope"), *_carried([*known, "param", "low", "high"]))
    over = F.col("got") - F.col("target")
    both = sums.withColumn("low", F.when(over < 0, F.col("param")).otherwise(F.col("low"))).withColumn("high", F.when(over > 0, F.col("param")).otherwise(F.col("high")))
    newton = F.col("param") - over / F.when(F.col("slope") > 0, F.col("slope"))
    inside = (newton >= F.col("low")) & (newton <= F.col("high")) & (F.abs(over) > 0)
    step = F.when(F.abs(over) <= 1e-9 * F.col("target"), F.col("param")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
    # a source whose target is its ceiling has no finite solution
    off = F.when(F.col("target") < most * F.col("source_size") * (1 - 1e-12), F.abs(over) / F.col("target"))
    return both.select("source", *known, F.coalesce(step, F.col("param")).alias("param"), "low", "high", off.alias("off"))


def solve(sizes: DataFrame, targets: DataFrame, most: float = 3.0) -> DataFrame:
    """``targets`` with ``param``: the dual's solution for each source.

    ``sizes`` is (source, size, n): a rate depends on source and size only, so documents of one size are one row.
    """
    # the solution's sign is known; ln(most) * mean takes a document of one token to the ceiling, and exp(-100 z / mean) is nothing
    more = F.col("target") > F.col("source_size")
    ends = [F.when(more, 0.0).otherwise(-100.0).alias("low"), F.when(more, F.log(F.lit(most)) * F.greatest("mean_size", F.lit(1.0)) * 1.001).otherwise(0.0).alias("high")]
    known = [c for c in targets.columns if c != "source"]
    params = targets.select("source", *known, F.lit(0.0).alias("param"), *ends)
    for _ in range(STEPS // TOGETHER):
        for _ in range(TOGETHER):
            params = _newton(sizes, params, known, most)
        params = staged(params, "mixing-params")
        if (params.agg(F.max("off")).first()[0] or 0.0) < TOLERANCE:
            break
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    return params.select(*targets.columns, F.when(full & (F.col("source_size") > 0), F.col("mean_size") * 8).otherwise(F.col("param")).alias("param"))


def _key(seed: int, row: Column) -> Column:
    """What tells a row from others; rows of one id are told apart by ``row``."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), row)


def _ticket() -> Column:
    """A number in (0, 1) for each row."""
    return (F.pmod(F.col("mix_key"), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _copies(rate: Column, shift: Column, fixes: Column | None, most: int) -> Column:
    whole = F.least(F.lit(most), F.greatest(F.lit(0), F.floor(rate + 1 - _ticket() + shift))).cast("long")
    if fixes is None:
        return whole
    by = F.aggregate(F.filter(fixes, lambda f: f["key"] == F.col("mix_key")), F.lit(0), lambda a, f: a + f["by"])
    return F.least(F.lit(most), F.greatest(F.lit(0), whole + by)).cast("long")


def _shifts(sizes: DataFrame, params: DataFrame, carry: list[str], most: int) -> DataFrame:
    """``params`` with ``shift`` in [-1, 1), the last of CELLS at which the copies' tokens don't exceed the target, and ``gap``, what is missing then."""
    rate = _rate(float(most), F.col("param"))
    joined = _to_params(sizes, params)
    # a row has its copies at shift -1, and one more at each shift at which rate + 1 - u + shift becomes whole, up to `most`
    at = rate + 1 - _ticket()
    base = F.least(F.lit(most), F.greatest(F.lit(0), F.floor(at - 1))).cast("long")
    steps = F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.struct((F.floor(at - 1) + 1 + k).alias("copies"), (F.floor(at - 1) + 1 + k - at).alias("x")))
    steps = F.filter(steps, lambda s: (s["copies"] > 0) & (s["copies"] <= most) & (s["x"] < 1))
    # cell i holds what is taken at shift -1 + 2 i / CELLS and not before
    cell = lambda s: F.struct(F.ceil((s["x"] + 1) * (CELLS / 2)).cast("long").alias("cell"), F.lit(1).cast("long").alias("copies"))
    taken = F.concat(F.array(F.struct(F.lit(-1).cast("long").alias("cell"), base.alias("copies"))), F.transform(steps, cell))
    cells = joined.select("source", "size", "target", F.explode(taken).alias("t")).groupBy("source", "t.cell").agg(F.sum(F.col("t.copies") * F.col("size")).alias("tokens"), F.first("target").alias("target"))
    # at most CELLS + 2 rows a source
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.withColumn("got", F.sum("tokens").over(upto))
    kept = sums.groupBy("source").agg(F.max(F.when((F.col("got") <= F.col("target")) | (F.col("cell") < 0), F.struct("cell", "got"))).alias("best"))
    known = kept.select("source", F.col("best.cell").alias("cell"), F.col("best.got").alias("got"))
    shift = F.greatest(F.col("cell"), F.lit(0)) * (2.0 / CELLS) - 1
    return _to_params(params, known).select("source", *carry, shift.alias("shift"), (F.col("target") - F.col("got")).alias("gap"))


def mixture(sizes: DataFrame, most: int = 3, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """What the mix is made by: (source, source_size, target, mean_size, param, shift, fixes) from (mix_key, source, size), one row a source."""
    counted = staged(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-counted")
    targets = staged(source_targets(counted, float(most), weights), "mixing-targets")
    params = solve(counted, targets, float(most))
    carry = ["source_size", "target", "mean_size", "param"]
    none = F.array().cast("array<struct<key:bigint,by:int>>")
    now = staged(_shifts(sizes, params.select("source", *carry), carry, most).withColumn("fixes", none), "mixing-shifts")
    rate = _rate(float(most), F.col("param"))
    for _ in range(FIXES):
        copies, gap = _copies(rate, F.col("shift"), F.col("fixes"), most), F.col("gap")
        may = F.when(gap > 0, copies < most).otherwise(copies > 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.abs(gap))
        one = F.struct(F.abs(F.abs(gap) - F.col("size")).alias("off"), F.col("mix_key").alias("key"), F.signum(gap).cast("int").alias("by"), "size")
        picks = _to_params(sizes, now).groupBy("source").agg(F.min(F.when(may, one)).alias("best"), *_carried([*carry, "shift", "gap", "fixes"]))
        best = F.col("best").isNotNull()
        fixes = F.when(best, F.concat("fixes", F.array(F.struct(F.col("best.key"), F.col("best.by"))))).otherwise(F.col("fixes"))
        left = F.when(best, gap - F.col("best.by") * F.col("best.size")).otherwise(gap)
        now = picks.select("source", *carry, "shift", left.alias("gap"), fixes.alias("fixes"))
    return staged(now.drop("gap"), "mixing-fixes")


def place_of(docs: DataFrame) -> Column | None:
    """A hash of a row's file and its place in it, which stay what they are in every run; None if ``docs`` is not read from files."""
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    try:
        docs.select(place)
    except AnalysisException:
        return None
    return place


def mix(docs: DataFrame, seed: int = 11, most: int = 3, weights: tuple[float, ...] = (1.0, 2.0, 3.0), size: Column | None = None, row: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, rate and ``copies`` (0 to ``most``) of each row.

    ``size`` is a column expression over ``docs``, by default the number of words.  ``row`` is one that tells rows of one doc_id (or of
    none) apart, so that each is rounded by itself: by default a row's place in its file, or, where ``docs`` is not read from files, its place in
    ``docs``, which is written first.  Null texts have size 0; documents without size keep rate 1.  Source null is a source.  An empty table
    gives an empty table.  Texts are not shuffled: rows find the row of their source in the mixture.  Columns named like those added are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies", "mean_size", "param", "shift", "fixes", "p_source", "mix_key")
    if row is None:
        row = place_of(docs)
    if row is None:
        docs = staged(docs.withColumn("mix_place", F.monotonically_increasing_id()), "mixing-placed")
        row = F.col("mix_place")
    sized = docs.withColumns({"mix_key": _key(seed, row), "size": word_count(F.col("text")) if size is None else size})
    sizes = staged(sized.select("mix_key", F.col("source").cast("string"), "size"), "mixing-sizes")
    made = mixture(sizes, most, weights)
    joined = _to_params(sized, made).withColumn("rate", _rate(float(most), F.col("param")))
    return joined.withColumn("copies", _copies(F.col("rate"), F.col("shift"), F.col("fixes"), most)).drop("mean_size", "param", "shift", "fixes", "mix_key", "mix_place")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as its copies say; size, source_size, target, rate and copies go."""
    out = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.drop("copy", "size", "source_size", "target", "rate", "copies")
