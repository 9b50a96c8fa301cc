"""Box search: periods, durations and epochs of periodic box-shaped dips.

For a period P, points fall into phase bins of width min(duration) / oversample counted from the first time; sums over
round(duration / width) neighbouring bins (around the end of the phase, too) give the mean inside and outside a box. The depth is
the outside minus the inside mean, the power half the number of points inside times the squared depth. Per period the box of the
largest power counts; of equal ones that of the shortest duration, then the first bin.

Fluxes minus their median are added up as whole numbers of 1 / SCALE, so sums don't depend on the order of points, tasks or blocks.

`box_search` is the definition in DataFrame operations; `box_search_series` gives the same by numpy kernels over arrays of bins, for
grids of thousands of periods. There a series is many tasks: parts of the periods, and for a long series also blocks of its points,
whose sums by period and bin are added before boxes are looked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from dimstar.functions.isolation import apply_isolated, failures
from dimstar.functions.rules import tidy
from dimstar.functions.runtime import materialize, ship_code
from dimstar.operators.order_stats import exact_percentiles

#: Sums are exact in units of this part of a flux: a power of two, so scaling itself rounds nothing but the last place.
SCALE = 2.0**20

#: Points of a series that one task takes, and tasks that the periods of one series are dealt to.
BLOCK, CHUNKS = 50_000, 8

BOX = ("period", "t0", "duration", "depth", "power")
def log_grid(low: float, high: float, n: int) -> list[float]:
    """n values from low to high with equal ratios."""
    if n < 2:
        return [low]
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)]


def split_periods(total: int, spans: list[tuple[float, float]], floors: list[int]) -> list[int]:
    """Shares of `total` periods by the logarithmic length of each span, but no fewer than its floor.

    The last span gets what the others leave. What the floors add is taken back from the largest share, down to its own floor.
    """
    logs = [math.log(b / a) if b > a > 0 else 0.0 for a, b in spans]
    whole = sum(logs) or 1.0
    shares = [round(total * part / whole) for part in logs[:-1]]
    shares = [max(floor, n) for n, floor in zip([*shares, total - sum(shares)], floors)]
    largest = max(range(len(shares)), key=lambda i: (shares[i], i))
    shares[largest] = max(floors[largest], shares[largest] - max(0, sum(shares) - total))
    return shares


def legal_durations(low: float, high: float, n: int, shortest_period: float, share: float = 0.98) -> list[float]:
    """At least three durations with equal ratios, all below a share of the shortest period."""
    top = min(high, share * shortest_period * (1 - 1e-9))
    low = min(low, top / 1.5)
    return log_grid(low, top, max(3, n))


def two_pass_plan(span: float = 27.4, periods: int = 3000) -> list[dict]:
    """The short and the normal pass for a time span: period and duration grids."""
    short, normal = (0.05, 0.60), (0.60, 0.5 * span)
    counts = split_periods(periods, [short, normal], [400, 600])
    return [
        {"name": "short", "periods": log_grid(*short, counts[0]), "durations": legal_durations(0.005, 0.0417, 12, short[0])},
        {"name": "normal", "periods": log_grid(*normal, counts[1]), "durations": legal_durations(0.0208, 0.50, 25, normal[0])},
    ]


def levels(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(target, n, start, stop, level): points, first and last time and median flux of each series.

    The median of a series of more than 20 * block points is found over ranges of its values.
    """
    sizes = materialize(df.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start"), F.max("t").alias("stop")), "series-sizes")
    long = sizes.filter(F.col("n") > 20 * block).select("target")
    if not long.limit(1).count():
        return sizes.join(df.groupBy("target").agg(F.median("f").alias("level")), "target")
    short = df.join(long, "target", "left_anti").groupBy("target").agg(F.median("f").alias("level"))
    longer = exact_percentiles(df.join(long, "target", "left_semi"), "f", [0.5], "target").select("target", F.col("p0").alias("level"))
    return sizes.join(short.unionByName(longer), "target")


def _centred(df: DataFrame, known: DataFrame) -> DataFrame:
    """(target, n, start, span, dt, y): times from the first one, and scaled whole fluxes around the median."""
    y = F.rint((F.col("f") - F.col("level")) * SCALE).cast("long")
    return df.join(known, "target").select("target", "n", "start", (F.col("stop") - F.col("start")).alias("span"), (F.col("t") - F.col("start")).alias("dt"), y.alias("y"))


def _widths(durations: list[float], oversample: int) -> tuple[float, list[int]]:
    width = min(durations) / oversample
    return width, [max(1, round(d / width)) for d in durations]


def box_search(df: DataFrame, periods: list[float], durations: list[float], oversample: int = 5) -> DataFrame:
    """(target, period, t0, duration, depth, power): the best box of each period, where one has a depth above 0.

    Two shuffles: sums by (target, period, bin), then bins by (target, period). There the sums of all boxes of all durations come from
    one running sum over the bins, of which those at the beginning are repeated behind the end. Rows with a null target are left out.
    """
    width, wide = _widths(durations, oversample)
    sizes = sorted(zip(durations, wide))
    most = max(wide)
    known = materialize(levels(df), "series-levels")
    rows = _centred(df, known)
    # periods by their place in the grid: a key of doubles would be normalised and shuffled again for each operator
    grid = F.array(*(F.lit(float(p)) for p in periods))
    of_place = lambda c: F.element_at(grid, F.col(c) + 1).alias("period")
    dealt = rows.select("target", "y", "dt", F.posexplode(grid).alias("place", "period"))
    turn = F.col("dt") - F.col("period") * F.floor(F.col("dt") / F.col("period"))
    bins = F.ceil(F.col("period") / width).cast("int")
    # a phase that rounds up to the period is in the bin past the last, which is the first
    dealt = dealt.withColumn("bin", F.pmod(F.floor(turn / width).cast("int"), bins))
    key = ["target", "place"]
    sums = dealt.groupBy(*key, "bin").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("m")).select("*", of_place("place"))
    again = F.when(F.col("bin") < most - 1, F.array(F.col("bin"), F.col("bin") + bins)).otherwise(F.array("bin"))
    filled = sums.select(*key, "period", F.explode(again).alias("slot"), "y", "m").filter(F.col("slot") < bins + most - 1)
    zero = F.lit(0).cast("long")
    empty = known.select("target", F.posexplode(grid).alias("place", "period"))
    empty = empty.select(*key, "period", F.explode(F.sequence(F.lit(0), bins + most - 2)).alias("slot"), zero.alias("y"), zero.alias("m"))
    slots = filled.unionByName(empty).repartition(*key).groupBy(*key, "slot").agg(F.sum("y").alias("y"), F.sum("m").alias("m"))
    slots = slots.select("*", of_place("place")).join(known.select("target", "start", "n"), "target")
    order = Window.partitionBy(*key).orderBy("slot")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumns({"to_y": F.sum("y").over(running), "to_m": F.sum("m").over(running)})
    whole = F.sum(F.when(F.col("slot") < bins, F.col("y"))).over(Window.partitionBy(*key))
    ends = {f"{c}{i}": F.lead(f"to_{c}", k - 1).over(order) for i, (_, k) in enumerate(sizes) for c in "ym"}
    slots = slots.withColumns(ends | {"all_y": whole}).filter(F.col("slot") < bins)

    def depth(i: int):
        y, m = (F.col(f"{c}{i}") - F.col(f"to_{c}") + F.col(c) for c in "ym")
        return F.when(F.lit(sizes[i][1]) < bins, (F.try_divide((F.col("all_y") - y).cast("double"), F.col("n") - m) - F.try_divide(y.cast("double"), m)) / SCALE)

    deep = slots.withColumns({f"d{i}": depth(i) for i in range(len(sizes))})
    power = lambda i: F.when(F.col(f"d{i}") > 0, 0.5 * (F.col(f"m{i}") - F.col("to_m") + F.col("m")) * F.col(f"d{i}") * F.col(f"d{i}"))
    rated = deep.select(*key, "period", "start", "slot", *(f"d{i}" for i in range(len(sizes))), *(power(i).alias(f"p{i}") for i in range(len(sizes))))
    most_power = F.greatest(*(F.col(f"p{i}") for i in range(len(sizes)))) if len(sizes) > 1 else F.col("p0")
    rated = rated.withColumn("power", most_power)
    # the shortest of equal ones
    nth = F.coalesce(*(F.when(F.col(f"p{i}") == F.col("power"), i) for i in range(len(sizes))))
    of = lambda *values: F.element_at(F.array(*values), F.col("nth") + 1)
    picked = rated.withColumn("nth", nth).select(
        *key, "period", "start", "slot", "power", of(*(F.lit(d) for d, _ in sizes)).alias("duration"), of(*(F.lit(k) for _, k in sizes)).alias("k"),
        of(*(F.col(f"d{i}") for i in range(len(sizes)))).alias("depth"),
    )
    t0 = F.col("start") + (F.col("slot") + F.col("k") / 2.0) * width
    best = F.when(F.col("power").isNotNull(), F.struct("power", (-F.col("duration")).alias("minus"), (-F.col("slot")).alias("first"), t0.alias("t0"), "depth"))
    found = picked.groupBy(*key).agg(F.max("period").alias("period"), F.max(best).alias("b"))
    return found.filter("b is not null").select("target", "period", "b.t0", (-F.col("b.minus")).alias("duration"), "b.depth", "b.power")


def bin_sums(dt: np.ndarray, y: np.ndarray, period: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the whole numbers y and counts of points by phase bin; exact up to sums of 2**53."""
    bins = math.ceil(period / width)
    at = ((dt - period * np.floor(dt / period)) / width).astype(np.int64) % bins
    return np.bincount(at, y, bins).astype(np.int64), np.bincount(at, minlength=bins)


def best_box(ys: np.ndarray, ns: np.ndarray, period: float, start: float, durations: list[float], width: float) -> tuple[float, ...] | None:
    """(period, t0, duration, depth, power) of the best box over sums by bin; None without a dip."""
    bins, total, count = len(ys), int(ys.sum()), int(ns.sum())
    sizes = [(d, k) for d, k in sorted((d, max(1, round(d / width))) for d in durations) if k < bins]
    if not sizes:
        return None
    k = np.array([k for _, k in sizes])
    around = int(k.max()) - 1
    cy, cn = (np.concatenate([[0], np.cumsum(np.concatenate([x, x[:around]]))]) for x in (ys, ns))
    ends = k[:, None] + np.arange(bins)
    y, n = cy[ends] - cy[:bins], cn[ends] - cn[:bins]
    good = (n > 0) & (n < count)
    with np.errstate(divide="ignore", invalid="ignore"):
        depth = ((total - y) / (count - n) - y / n) / SCALE
    power = np.where(good & (depth > 0), 0.5 * n * depth * depth, -1.0)
    i, b = np.unravel_index(int(power.argmax()), power.shape)  # the shortest, then the first of equal ones
    if power[i, b] <= 0:
        return None
    return period, start + (float(b) + k[i] / 2.0) * width, sizes[i][0], float(depth[i, b]), float(power[i, b])


def best_boxes(t: np.ndarray, f: np.ndarray, periods, durations, oversample: int = 5) -> np.ndarray:
    """Rows (period, t0, duration, depth, power) of one series; the same as box_search."""
    width, _ = _widths(durations, oversample)
    dt, y = t - t.min(), np.rint((f - np.median(f)) * SCALE)
    found = (best_box(*bin_sums(dt, y, p, width), p, t.min(), durations, width) for p in periods)
    return np.array([x for x in found if x], float).reshape(-1, 5)


def _strongest(rows: list[tuple[float, ...]], n: int) -> list[tuple[float, ...]]:
    return sorted(rows, key=lambda r: (-r[4], r[0]))[:n]


def _fields(*names: str) -> list[StructField]:
    return [StructField(n, DoubleType()) for n in names]


def box_search_series(
    df: DataFrame, passes: list[dict], top: int = 24, least: int = 200, oversample: int = 5, block: int = BLOCK, chunks: int = CHUNKS, isolate: bool = False
) -> DataFrame:
    """(target, k, period, t0, duration, depth, power): the `top` boxes of all passes, k counting from 1 by falling power.

    Each pass brings its 10 * top strongest; periods within 0.002 of a stronger one are left out. Series of fewer than `least`
    points, or shorter than twice a pass's shortest period, have none. The periods of a series are dealt to `chunks` tasks; one of more
    than `block` points is dealt to blocks as well. With `isolate`, the result has the column error, and a target whose search raises
    is one row with the error's text and nulls. Rows with a null target, time or flux are left out.
    """
    ship_code(df.sparkSession)
    kind = df.schema["target"].dataType
    points = df.select("target", tidy(F.col("t")).alias("t"), tidy(F.col("f")).alias("f")).filter("target is not null and t is not null and f is not null")
    known = materialize(levels(points, block).filter((F.col("n") >= least) & (F.col("stop") > F.col("start"))), "series-levels")
    rows = _centred(points, known)
    grids = [(i, j, p, pass_["durations"], _widths(pass_["durations"], oversample)[0]) for i, pass_ in enumerate(passes) for j, p in enumerate(pass_["periods"])]
    schema = StructType([StructField("target", kind), StructField("pass", IntegerType()), *_fields(*BOX)])

    def table(target, found: list[tuple[int, tuple[float, ...]]], group: pa.Table) -> pa.Table:
        columns = [pa.array([i for i, _ in found], pa.int32()), *(pa.array([r[c] for _, r in found], pa.float64()) for c in range(5))]
        return pa.table([pa.array([target] * len(found), group.schema.field("target").type), *columns], ["target", "pass", *BOX])

    def search(group: pa.Table) -> pa.Table:
        dt, y = group.column("dt").to_numpy(), group.column("y").to_numpy().astype(float)
        start, span, chunk = (group.column(c)[0].as_py() for c in ("start", "span", "chunk"))
        found: dict[int, list] = {}
        for i, j, period, durations, width in grids:
            if (i + j) % chunks == chunk and period <= span / 2:
                box = best_box(*bin_sums(dt, y, period, width), period, start, durations, width)
                if box:
                    found.setdefault(i, []).append(box)
        return table(group.column("target")[0].as_py(), [(i, r) for i, boxes in found.items() for r in _strongest(boxes, 10 * top)], group)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = rows.filter(F.col("n") <= block).withColumn("chunk", F.explode(F.array(*map(F.lit, range(chunks)))))
    # a given number of partitions, as small series would otherwise be searched one after the other in one task
    dealt = short.repartition(tasks, "target", "chunk")
    found = apply_isolated(dealt.groupBy("target", "chunk"), ["target"], search, schema, isolate)
    if known.filter(F.col("n") > block).limit(1).count():
        found = found.unionByName(_search_blocks(rows.filter(F.col("n") > block), grids, schema, table, block, isolate))
    if not isolate:
        return merged_rows(found, top)
    found = materialize(found, "series-boxes")
    failed = materialize(failures(found), "series-failures")
    fine = merged_rows(found.filter("error is null").drop("error").join(failed.select("target"), "target", "left_anti"), top)
    rest = failed.select("target", F.lit(None).cast("int").alias("k"), *(F.lit(None).cast("double").alias(c) for c in BOX), "error")
    return fine.withColumn("error", F.lit(None).cast("string")).unionByName(rest)


def _search_blocks(rows: DataFrame, grids: list[tuple], schema: StructType, table, block: int, isolate: bool) -> DataFrame:
    """Boxes of long series: sums by period and bin of each block of points, added for each period, then the boxes over the sums."""
    at = F.pmod(F.xxhash64("dt", "y"), F.ceil(F.col("n") / block)).cast("int")
    sums = StructType(
        [schema["target"], StructField("pass", IntegerType()), StructField("place", IntegerType()), *_fields("start"), StructField("ys", ArrayType(LongType())), StructField("ns", ArrayType(LongType()))]
    )

    def partial(group: pa.Table) -> pa.Table:
        dt, y = group.column("dt").to_numpy(), group.column("y").to_numpy().astype(float)
        start, span = (group.column(c)[0].as_py() for c in ("start", "span"))
        places = [(i, j, bin_sums(dt, y, period, width)) for i, j, period, _, width in grids if period <= span / 2]
        long = pa.list_(pa.int64())
        columns = [pa.array([group.column("target")[0].as_py()] * len(places), group.schema.field("target").type)]
        columns += [pa.array([x[c] for x in places], pa.int32()) for c in (0, 1)] + [pa.array([start] * len(places), pa.float64())]
        columns += [pa.array([x[2][c] for x in places], long) for c in (0, 1)]
        return pa.table(columns, ["target", "pass", "place", "start", "ys", "ns"])

    by_place = {(i, j): (period, durations, width) for i, j, period, durations, width in grids}

    def whole(group: pa.Table) -> pa.Table:
        i, j, start = (group.column(c)[0].as_py() for c in ("pass", "place", "start"))
        period, durations, width = by_place[i, j]
        ys, ns = (sum(x.values.to_numpy() for x in group.column(c)) for c in ("ys", "ns"))
        box = best_box(ys, ns, period, start, durations, width)
        return table(group.column("target")[0].as_py(), [(i, box)] if box else [], group)

    parts = apply_isolated(rows.withColumn("block", at).groupBy("target", "block"), ["target"], partial, sums, isolate)
    if not isolate:
        return apply_isolated(parts.groupBy("target", "pass", "place"), ["target"], whole, schema, False)
    parts = materialize(parts, "series-sums")
    found = apply_isolated(parts.filter("error is null").groupBy("target", "pass", "place"), ["target"], whole, schema)
    bad = parts.filter("error is not null")
    return found.unionByName(bad.select("target", "pass", *(F.lit(None).cast("double").alias(c) for c in BOX), "error"))


def top_per_target(found: DataFrame, top: int, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """The `top` boxes per target by power (ties: the shorter period, then the other columns), numbered k = 1, 2, ..."""
    w = Window.partitionBy(*by).orderBy(F.desc("power"), "period", "t0", "duration", "depth")
    return found.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top)


def merged_passes(found: list[DataFrame], top: int = 24, apart: float = 0.002) -> DataFrame:
    """One candidate list per target from several passes: by falling power, without periods near a stronger one's, numbered anew."""
    rows = None
    for i, one in enumerate(found):
        part = one.withColumn("pass", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return merged_rows(rows, top, apart)


def merged_rows(found: DataFrame, top: int = 24, apart: float = 0.002) -> DataFrame:
    """The same for rows with their `pass`.

    The scan depends on its order, so it folds over each target's sorted array; that array holds at most 10 * top entries of each
    pass.
    """
    rows = top_per_target(found, 10 * top, ("target", "pass"))
    entry = F.struct((-F.col("power")).alias("minus"), "period", "t0", "duration", "depth", "power")
    listed = rows.groupBy("target").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    empty = F.slice(F.col("all"), 1, 0)
    near = lambda kept, x: F.exists(kept, lambda k: F.abs(x["period"] - k["period"]) / F.greatest(k["period"], F.lit(1e-12)) <= apart)
    scan = F.aggregate("all", empty, lambda kept, x: F.when((F.size(kept) >= top) | near(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    spread = listed.select("target", F.posexplode(scan).alias("at", "c"))
    return spread.select("target", (F.col("at") + 1).alias("k"), "c.period", "c.t0", "c.duration", "c.depth", "c.power")
