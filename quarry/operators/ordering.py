"""Order statistics without a single-task bottleneck.

* :func:`with_global_index` — dense 0-based row number in a total order,
  like ``row_number() over (order by ...)`` but without moving every row
  into one partition: range-partition, sort within partitions, count each
  partition once, add the partition's offset.
* :func:`select_ranks` — the r-th smallest row (per group) by iterative
  histogram refinement: each round keeps only the rows inside the bucket
  that holds the wanted rank, so no task ever holds a whole group.
* :func:`exact_quantiles` — linear-interpolated quantiles (the definition
  of ``percentile``/``quantile_cont``) built on :func:`select_ranks`.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.small import collect_small, local_frame
from quarry.functions.vec import lit_ints
from quarry.session import cut_lineage

_BUCKETS = 1024          # histogram width per refinement round
_FINAL_ROWS = 4096       # candidates of an interval that are few enough to sort
_AT_ONCE = 64            # intervals refined in one job


def with_global_index(df: DataFrame, order_cols: Sequence[str], name: str = "idx",
                      num_partitions: int | None = None, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Add a dense 0-based index following ``order_cols``.

    ``order_cols`` should end with a unique key so that hot values of the
    leading column are split across range partitions and the order is total.
    The per-partition counts (one row per partition) are the only thing
    collected.
    """
    spark = df.sparkSession
    p = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    asc = [ascending] * len(order_cols) if isinstance(ascending, bool) else list(ascending)
    keys = [F.col(c).asc_nulls_first() if a else F.col(c).desc_nulls_last() for c, a in zip(order_cols, asc)]
    # The partition id and in-partition position must be identical for the
    # counting pass and the indexing pass, so the sorted frame is written once
    # to the shared checkpoint folder (also a lineage cut that survives
    # executor loss); both passes read that copy.
    ranged = cut_lineage(df.repartitionByRange(p, *keys).sortWithinPartitions(*keys)
                         .withColumn("_qp", F.spark_partition_id())
                         .withColumn("_qm", F.monotonically_increasing_id()))
    counts = collect_small(ranged.groupBy("_qp").count(), "partition counts")
    sizes = {r["_qp"]: r["count"] for r in counts}
    n_parts = max(sizes) + 1 if sizes else 1
    offsets, run = [], 0
    for i in range(n_parts):
        offsets.append(run)
        run += sizes.get(i, 0)
    off = lit_ints(offsets or [0])
    local = F.col("_qm") - F.shiftleft(F.col("_qp").cast("long"), 33)
    return ranged.withColumn(name, F.element_at(off, F.col("_qp") + 1) + local).drop("_qp", "_qm")


def select_ranks(df: DataFrame, value: str, targets: list[tuple], group_cols: Sequence[str] = (),
                 tiebreak: Sequence[str] = (), bounds: dict | None = None) -> DataFrame:
    """Rows at given 0-based ranks of ``value`` (then ``tiebreak``) per group.

    ``targets`` is a list of ``(group values..., rank)`` tuples. Returns a
    DataFrame ``(group cols..., _rank, value, tiebreak...)``. The targets lie
    in intervals of values; each round counts the rows of an interval by
    bucket and narrows it, until few rows are left, which are sorted, or one
    value, which is the answer (with a tiebreak: then that is searched among
    the rows of that value). So no task ever holds many tied rows.
    """
    spark = df.sparkSession
    gcols = list(group_cols)
    base = df.select(*gcols, value, *tiebreak).filter(F.col(value).isNotNull())
    vtype = base.schema[value].dataType
    if bounds is None:
        bounds = {tuple(r[c] for c in gcols): r for r in collect_small(
            base.groupBy(*gcols).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")), "group bounds")}
    # interval: (group, lo, hi, rows below it, rows in it) -> ranks wanted
    open_: dict[tuple, list[int]] = {}
    for t in targets:
        b = bounds.get(tuple(t[:-1]))
        if b is not None and 0 <= int(t[-1]) < b["n"]:
            open_.setdefault((tuple(t[:-1]), b["lo"], b["hi"], 0, b["n"]), []).append(int(t[-1]))

    def rows_in(intervals):
        fields = [base.schema[c] for c in gcols] + [T.StructField("_iid", T.IntegerType()), T.StructField("_lo", vtype),
                                                    T.StructField("_hi", vtype)]
        if not gcols:  # one literal array instead of a join
            each = F.array(*[F.struct(F.lit(i).alias("_iid"), F.lit(v[1]).cast(vtype).alias("_lo"), F.lit(v[2]).cast(vtype).alias("_hi"))
                             for i, v in enumerate(intervals)])
            inside = F.filter(each, lambda v: (F.col(value) >= v["_lo"]) & (F.col(value) <= v["_hi"]))
            return base.withColumn("_t", F.explode(inside)).select("*", "_t.*").drop("_t")
        table = local_frame(spark, [v[0] + (i, v[1], v[2]) for i, v in enumerate(intervals)], T.StructType(fields))
        return base.join(table, gcols).filter((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi")))

    small, single = {}, {}
    while open_:
        nxt: dict[tuple, list[int]] = {}
        large = []
        for v, ranks in open_.items():
            if v[1] == v[2]:
                single.setdefault(v, []).extend(ranks)
            elif v[4] <= _FINAL_ROWS:
                small.setdefault(v, []).extend(ranks)
            else:
                large.append((v, ranks))
        for at in range(0, len(large), _AT_ONCE):
            some = large[at:at + _AT_ONCE]
            width = F.col("_hi").cast("double") - F.col("_lo").cast("double")
            place = (F.col(value).cast("double") - F.col("_lo").cast("double")) / width * _BUCKETS
            bucket = F.when(width <= 0, 0).otherwise(F.least(F.lit(_BUCKETS - 1), F.floor(place).cast("int")))
            hist = collect_small(rows_in([v for v, _ in some]).groupBy("_iid", bucket.alias("_b")).agg(
                F.count("*").alias("c"), F.min(value).alias("mn"), F.max(value).alias("mx")), "histogram")
            for i, (v, ranks) in enumerate(some):
                cells = sorted((h for h in hist if h["_iid"] == i), key=lambda h: h["_b"])
                for rank in ranks:
                    below = v[3]
                    for h in cells:
                        if below + h["c"] > rank:
                            new = (v[0], h["mn"], h["mx"], below, h["c"])
                            # values that doubles can't tell apart are sorted as they are
                            (small if new == v else nxt).setdefault(new, []).append(rank)
                            break
                        below += h["c"]
        open_ = nxt

    parts = []
    if single and not tiebreak:
        fields = [base.schema[c] for c in gcols] + [T.StructField("_rank", T.LongType()), base.schema[value]]
        parts.append(local_frame(spark, [v[0] + (r, v[1]) for v, ranks in single.items() for r in ranks], T.StructType(fields)))
    for v, ranks in single.items() if tiebreak else ():
        same = base.filter(F.col(value) == F.lit(v[1]).cast(vtype))
        for c, x in zip(gcols, v[0]):
            same = same.filter(F.col(c).eqNullSafe(F.lit(x)))
        found = select_ranks(same.select(*tiebreak), tiebreak[0], [(r - v[3],) for r in ranks], (), list(tiebreak[1:]))
        parts.append(found.select(*[F.lit(x).cast(base.schema[c].dataType).alias(c) for c, x in zip(gcols, v[0])],
                                  (F.col("_rank") + v[3]).alias("_rank"), F.lit(v[1]).cast(vtype).alias(value), *tiebreak))
    if small:
        items = list(small.items())
        wanted = [F.struct(F.lit(i).alias("i"), F.lit(v[3]).cast("long").alias("below"), F.lit(ranks).cast("array<long>").alias("ranks"))
                  for i, (v, ranks) in enumerate(items)]
        w = Window.partitionBy("_iid").orderBy(F.col(value), *[F.col(c) for c in tiebreak])
        ranked = (rows_in([v for v, _ in items]).withColumn("_rn", F.row_number().over(w) - 1)
                  .withColumn("_w", F.get(F.array(*wanted), F.col("_iid"))).withColumn("_rank", F.col("_rn") + F.col("_w.below")))
        parts.append(ranked.filter(F.array_contains(F.col("_w.ranks"), F.col("_rank"))).select(*gcols, "_rank", value, *tiebreak))
    if not parts:
        return _empty_result(spark, base, gcols, value, tiebreak)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _empty_result(spark, base, gcols, value, tiebreak):
    fields = [base.schema[c] for c in gcols] + [T.StructField("_rank", T.LongType())] + \
             [base.schema[value]] + [base.schema[c] for c in tiebreak]
    return local_frame(spark, [], T.StructType(fields))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                    bounds: dict | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group: columns
    ``(group..., prob, quantile)``; equal to ``percentile`` / ``quantile_cont``."""
    gcols = list(group_cols)
    base = df.select(*gcols, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if bounds is None:  # {group tuple: {"lo", "hi", "n"}} may come from the caller's own aggregate
        stats = collect_small(base.groupBy(*gcols).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"),
                                                       F.count("*").alias("n")), "group bounds")
        bounds = {tuple(r[c] for c in gcols): r for r in stats}
    groups = [(g, r["n"]) for g, r in bounds.items()]
    targets, plan = set(), []
    for g, n in groups:
        if n == 0:
            continue
        for p in probs:
            pos = p * (n - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            targets.add(g + (lo,))
            targets.add(g + (hi,))
            plan.append(g + (float(p), lo, hi, pos - lo))
    spark = df.sparkSession
    if not plan:
        schema = T.StructType([base.schema[c] for c in gcols] + [T.StructField("prob", T.DoubleType()),
                                                                  T.StructField("quantile", T.DoubleType())])
        return local_frame(spark, [], schema)
    picked = select_ranks(base, "_v", sorted(targets), gcols, bounds=bounds)
    pschema = T.StructType([base.schema[c] for c in gcols] + [
        T.StructField("prob", T.DoubleType()), T.StructField("_lo", T.LongType()),
        T.StructField("_hi", T.LongType()), T.StructField("_frac", T.DoubleType())])
    pf = local_frame(spark, plan, pschema)
    # each (group, prob) needs the values at ranks lo and hi: one join of the
    # picked rows, then min_by / max_by over the two ranks
    want = pf.select(*gcols, "prob", "_frac", "_lo", "_hi", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_rank"))
    j = want.join(picked, on=gcols + ["_rank"])
    agg = j.groupBy(*gcols, "prob").agg(F.first("_frac").alias("_frac"), F.min_by("_v", "_rank").alias("_vlo"),
                                        F.max_by("_v", "_rank").alias("_vhi"))
    return agg.select(*gcols, "prob", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("quantile"))
