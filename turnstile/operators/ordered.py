"""Order-dependent operators that scale: row numbers, running sums, fill-down,
ntile, exact quantiles and average-tie ranks.

``Window.orderBy(...)`` without a partition key, or partitioned by a key that
may hold a third of the rows, moves that whole group into one task.  The
operators here avoid it:

1. number the rows, range-partition on (group keys, order keys, row) -- a hot
   group, and rows that tie on all order keys, are split across many
   partitions because the row number separates them -- and write the rows with
   the number of their range, so that every later step sees the same ranges
   and the same order of ties whatever the optimizer reuses or an executor loses;
2. built-in windows within (range, group) give local row numbers, running
   sums and last-non-null values; all values stay in their own types;
3. aggregate one summary row per (range, group) and, with a window over
   that summary (at most one row per range for any group), compute what
   every range must add from the ranges before it.  Only the first group of
   a range can continue from an earlier one, so the offset table has at most
   ``num_partitions`` rows -- a proven bound -- and is broadcast.

Ordering ties: rows equal on all order keys get an arbitrary relative order
(as SQL ``row_number`` does), fixed once the rows are written; pass a unique
tie-break key for an order that does not follow the input's partitions.

Working columns have a prefix that no column of the input has.  The written
copy is removed by ``joins.release_staged`` (or at the end of a ``joins.staging``
block), once the result has been consumed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import materialize_lookup, stage_table
from .quantiles import radix_quantiles

OrderSpec = Sequence[Column | str]


def _sort_exprs(order_by: OrderSpec) -> list[Column]:
    return [F.col(o).asc() if isinstance(o, str) else o for o in order_by]


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _zero(dt: T.DataType) -> Column:
    """Zero in the type that a sum of ``dt`` has."""
    if isinstance(dt, T.DecimalType):
        return F.lit(0).cast(T.DecimalType(min(38, dt.precision + 10), dt.scale))
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.lit(0).cast("long")
    return F.lit(0.0)


def ordered_scan(df: DataFrame, order_by: OrderSpec, partition_by: Sequence[str] = (),
                 row_number: str | None = None, sums: dict[str, str] | None = None,
                 fills: dict[str, str] | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """Add row numbers / inclusive running sums / fill-down values.

    ``row_number``: output name for the 1-based position within the group.
    ``sums``: ``{out: source}`` inclusive running sum (NULL counts as 0),
    exact for integers and decimals.
    ``fills``: ``{out: source}`` last non-NULL value so far (tidyr ``fill``).
    """
    sums, fills = dict(sums or {}), dict(fills or {})
    partition_by = list(partition_by)
    schema = df.schema
    n = _num_partitions(df, num_partitions)
    order = _sort_exprs(order_by)
    keys = [F.col(p).asc_nulls_first() for p in partition_by]
    p = "__os"
    while any(c.startswith(p) for c in (*schema.names, *sums, *fills, row_number or "")):
        p += "_"
    pid, row = f"{p}pid", f"{p}row"
    numbered = df.withColumn(row, F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(n, *keys, *order, F.col(row)).withColumn(pid, F.spark_partition_id())
    ranged = stage_table(ranged, "ordered")
    order = [*order, F.col(row)]

    at = Window.partitionBy(pid, *partition_by).orderBy(*order)
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({
        f"{p}lrn": F.row_number().over(at).cast("long"),
        **{f"{p}run_{o}": F.sum(F.coalesce(F.col(src), _zero(schema[src].dataType))).over(upto) for o, src in sums.items()},
        **{f"{p}fill_{o}": F.last(F.col(src), ignorenulls=True).over(upto) for o, src in fills.items()}})

    # One summary row per (range, group); offsets for groups seen earlier.
    aggs = [F.max(f"{p}lrn").alias(f"{p}cnt")]
    aggs += [F.max_by(F.col(f"{p}run_{o}"), f"{p}lrn").alias(f"{p}tot_{o}") for o in sums]
    aggs += [F.max_by(F.col(f"{p}fill_{o}"), f"{p}lrn").alias(f"{p}last_{o}") for o in fills]
    summary = local.groupBy(pid, *partition_by).agg(*aggs)
    w = Window.partitionBy(*partition_by).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    off_cols = [F.sum(f"{p}cnt").over(w).alias(f"{p}off_cnt")]
    off_cols += [F.sum(f"{p}tot_{o}").over(w).alias(f"{p}off_{o}") for o in sums]
    off_cols += [F.last(f"{p}last_{o}", ignorenulls=True).over(w).alias(f"{p}carry_{o}") for o in fills]
    offsets = (summary.select(F.col(pid).alias(f"{p}opid"),
                              *[F.col(c).alias(f"{p}k_{i}") for i, c in enumerate(partition_by)],
                              *off_cols)
               .where(F.col(f"{p}off_cnt").isNotNull()))
    # At most one row per range: bounded by n, so broadcasting is safe.
    cond = F.col(pid) == F.col(f"{p}opid")
    for i, c in enumerate(partition_by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"{p}k_{i}"))
    joined = local.join(F.broadcast(offsets), cond, "left")
    outs = {}
    if row_number:
        outs[row_number] = F.col(f"{p}lrn") + F.coalesce(F.col(f"{p}off_cnt"), F.lit(0).cast("long"))
    for o, src in sums.items():
        zero = _zero(schema[src].dataType)
        kind = f"decimal({zero_type.precision},{zero_type.scale})" if isinstance(
            zero_type := _sum_type(schema[src].dataType), T.DecimalType) else zero_type.simpleString()
        outs[o] = (F.col(f"{p}run_{o}") + F.coalesce(F.col(f"{p}off_{o}"), zero)).cast(kind)
    for o in fills:
        outs[o] = F.coalesce(F.col(f"{p}fill_{o}"), F.col(f"{p}carry_{o}"))
    kept = [c for c in schema.names if c not in outs]
    order_out = [*schema.names, *(c for c in outs if c not in schema.names)]
    return joined.select(*kept, *[v.alias(k) for k, v in outs.items()]).select(*order_out)


def _sum_type(dt: T.DataType) -> T.DataType:
    """The type of a sum: long for integers, a wider decimal for decimals, else double."""
    if isinstance(dt, T.DecimalType):
        return T.DecimalType(min(38, dt.precision + 10), dt.scale)
    return T.LongType() if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else T.DoubleType()


def row_number(df: DataFrame, order_by: OrderSpec, partition_by: Sequence[str] = (),
               out: str = "row_number", num_partitions: int | None = None) -> DataFrame:
    """1-based row number over a (preferably total) order."""
    return ordered_scan(df, order_by, partition_by, row_number=out, num_partitions=num_partitions)


def running_sum(df: DataFrame, order_by: OrderSpec, sums: dict[str, str],
                partition_by: Sequence[str] = ()) -> DataFrame:
    """``cumsum`` over an explicit order."""
    return ordered_scan(df, order_by, partition_by, sums=sums)


def fill_down(df: DataFrame, order_by: OrderSpec, fills: dict[str, str],
              partition_by: Sequence[str] = ()) -> DataFrame:
    """Tidyr ``fill(.direction = "down")`` -- last non-NULL value so far."""
    return ordered_scan(df, order_by, partition_by, fills=fills)


def _free(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    while name in df.columns:
        name += "_"
    return name


def group_sizes(df: DataFrame, partition_by: Sequence[str], out: str = "_n") -> DataFrame | int:
    """Row count per group (a DataFrame) or of the whole table (an int)."""
    if not partition_by:
        return df.count()
    return df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias(out))


def ntile(df: DataFrame, k: int, order_by: OrderSpec, partition_by: Sequence[str] = (),
          out: str = "ntile") -> DataFrame:
    """``ntile(x, k)``: the first ``n mod k`` tiles get one extra row
    (dplyr and SQL agree on this), computed from exact row numbers."""
    rn_col, n_col = _free(df, "__rn"), _free(df, "__size")
    ranked = row_number(df, order_by, partition_by, out=rn_col)
    sizes = group_sizes(df, partition_by, n_col)
    if isinstance(sizes, int):
        ranked = ranked.withColumn(n_col, F.lit(sizes).cast("long"))
    else:
        keys = [_free(df, f"__key{i}") for i in range(len(partition_by))]
        sizes = sizes.withColumnsRenamed(dict(zip(partition_by, keys)))
        cond = F.lit(True)
        for c, key in zip(partition_by, keys):
            cond = cond & F.col(c).eqNullSafe(F.col(key))
        ranked = ranked.join(sizes, cond, "left").drop(*keys)
    n, rn = F.col(n_col), F.col(rn_col)
    small = F.floor(n / F.lit(k)).cast("long")
    extra = n - small * k
    large = small + 1
    cut = extra * large
    tile = (F.when(rn <= cut, F.floor((rn - 1) / large) + 1)
            .otherwise(F.floor((rn - cut - 1) / F.greatest(small, F.lit(1))) + extra + 1))
    return ranked.withColumn(out, tile.cast("int")).drop(rn_col, n_col)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    partition_by: Sequence[str] = (), prob_col: str = "prob",
                    out: str = "quantile", groups_bounded: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles (R type 7 = SQL ``quantile_cont``).

    Found digit by digit from counts (see ``quantiles``): no values are shuffled
    or sorted, and no group is gathered into one task or one aggregation buffer.
    """
    return radix_quantiles(df, value, probs, partition_by, None, prob_col, out, groups_bounded)


def quantiles_from_counts(counts: DataFrame, probs: Sequence[float], partition_by: Sequence[str] = (),
                          prob_col: str = "prob", out: str = "quantile",
                          groups_bounded: bool = False) -> DataFrame:
    """Quantiles from ``(groups..., _v, _c)`` = value counts (non-NULL values)."""
    return radix_quantiles(counts, "_v", probs, partition_by, "_c", prob_col, out, groups_bounded)


def average_rank(df: DataFrame, value: str, partition_by: Sequence[str] = (),
                 out: str = "rank", descending: bool = False) -> DataFrame:
    """R ``rank()`` (ties get the mean of their positions).

    Rows are first counted per distinct (group, value) -- a map-side partial
    aggregate -- then running counts over the distinct values give
    ``rank = rows before + (ties + 1) / 2``; the result joins back on
    (group, value), where AQE splits a hot key.
    """
    partition_by = list(partition_by)
    ties, cum_col = _free(df, "__ties"), _free(df, "__cum")
    counts = df.groupBy(*partition_by, value).agg(F.count(F.lit(1)).alias(ties))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    cum = running_sum(counts, [order], {cum_col: ties}, partition_by)
    keys = partition_by + [value]
    named = [_free(df, f"__rk{i}") for i in range(len(keys))]
    ranks = cum.select(*[F.col(k).alias(n) for k, n in zip(keys, named)],
                       ((F.col(cum_col) - F.col(ties)) + (F.col(ties) + 1) / F.lit(2.0)).alias(out))
    cond = F.lit(True)
    for k, n in zip(keys, named):
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    joined = df.drop(out).join(ranks, cond, "left")
    return joined.select(*[c for c in df.columns if c != out], out)


def lookup_row_number(df: DataFrame, order_by: OrderSpec, partition_by: Sequence[str] = (),
                      out: str = "row_number") -> DataFrame:
    """Row numbers for a lookup-sized table (levels, definitions, feature
    lists).  When the size check passes the table is materialised and ranked
    with a plain window (bounded by the check); otherwise the distributed
    ``row_number`` is used."""
    small = materialize_lookup(df)
    if small is None:
        return row_number(df, order_by, partition_by, out=out)
    w = Window.partitionBy(*partition_by).orderBy(*_sort_exprs(order_by)) if partition_by \
        else Window.orderBy(*_sort_exprs(order_by))
    return small.withColumn(out, F.row_number().over(w).cast("long"))
