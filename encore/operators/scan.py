"""Ordered row operators that never put a whole key into one task.

A play log is skewed: one listener may own a third of all rows, so
``Window.partitionBy(user).orderBy(ts)`` would sort that third in one task.
Every helper here cuts a key's rows into *cells* (a monotone function of the
order column, a fixed time slice by default), runs the window inside
``(key, cell)``, keeps one summary row per cell, scans the few summary rows in
order and joins what has to be carried into each cell back on ``(key, cell)``.
The largest sort is one cell; the carried table has one row per key and cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.session import checkpointed

DAY = 86400
CELL = "__cell"
FIRST, HERE = Window.unboundedPreceding, Window.currentRow


class HotCells:
    """Slices for busy keys only, of about ``rows_per_cell / spread`` rows each.

    A key with no more than ``rows_per_cell`` rows is one slice. A busier key is
    cut at equi-depth splitters over the whole order columns of the operator
    (numbers, times or texts, with their tie-breakers), so neither outliers nor
    bursts nor a common start of texts fill one slice. The splitters come from a
    hash sample of the key's rows; their number follows its row count, and their
    quality only decides how even the slices are. At most rows / ``rows_per_cell``
    keys are busy, which bounds the joined table of splitters.
    """

    SAMPLED = 8  # sampled rows per slice

    def __init__(self, rows_per_cell: int = 1_000_000, spread: int = 4):
        self.rows_per_cell, self.spread = rows_per_cell, spread

    def apply(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: str | None = None) -> DataFrame:
        """Rows with their slice, and whether their key is cut in the column ``hot``."""
        at = F.struct(*order)
        size = F.count(F.lit(1)).alias("__hc_n")
        narrow = df.select(*dict.fromkeys([*keys, *order]))
        cells = F.ceil(F.col("__hc_n") * self.spread / self.rows_per_cell).cast("int")
        busy = F.col("__hc_n") > self.rows_per_cell
        if keys:
            counted = narrow.join(narrow.groupBy(*keys).agg(size).filter(busy), list(keys))
        else:
            counted = narrow.withColumn("__hc_n", narrow.select(size).scalar()).filter(busy)
        drawn = counted.filter(F.pmod(F.xxhash64(*keys, *order), F.col("__hc_n")) < cells * self.SAMPLED)
        sample = drawn.groupBy(*keys).agg(F.max(cells).alias("__hc_c"), F.sort_array(F.collect_set(at)).alias("__hc_s"))
        pick = lambda i: F.element_at("__hc_s", F.floor(i * F.size("__hc_s") / F.col("__hc_c")).cast("int") + 1)
        fine = F.when(F.col("__hc_c") > 1, F.transform(F.sequence(F.lit(1), F.col("__hc_c") - 1), pick))
        step = F.ceil(F.sqrt("__hc_c")).cast("int").alias("__hc_w")
        every = F.filter("__hc_fine", lambda s, i: (i + 1) % F.col("__hc_w") == 0).alias("__hc_coarse")
        splits = sample.select(*keys, step, fine.alias("__hc_fine")).select(*keys, "__hc_w", "__hc_fine", every)
        if keys:
            out = df.join(splits, list(keys), "left")
        else:
            out = df.withColumn("__hc_b", splits.select(F.struct("__hc_w", "__hc_fine", "__hc_coarse")).scalar()).select("*", "__hc_b.*").drop("__hc_b")
        # two steps: among every w-th splitter, then among the w - 1 that follow
        first = F.size(F.filter("__hc_coarse", lambda s: s <= at))
        rest = F.slice("__hc_fine", F.col("__hc_first") * F.col("__hc_w") + 1, F.col("__hc_w") - 1)
        cell = F.col("__hc_first") * F.col("__hc_w") + F.size(F.filter(rest, lambda s: s <= at))
        out = out.withColumn("__hc_first", F.when(F.col("__hc_w").isNotNull(), first))
        out = out.withColumn(CELL, F.coalesce(cell, F.lit(0)).cast("long"))
        out = out.withColumn(hot, F.col("__hc_w").isNotNull()) if hot else out
        return out.drop("__hc_w", "__hc_fine", "__hc_coarse", "__hc_first")


def hot_cells(rows_per_cell: int = 1_000_000) -> HotCells:
    """Slices of the operator's order columns for busy keys."""
    return HotCells(rows_per_cell)


def time_cell(ts: str | Column, seconds: int = DAY) -> Column:
    """Fixed slice number of a timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_timestamp(ts) / F.lit(seconds))


def number_cell(col: str | Column, width: int) -> Column:
    """Fixed slice number of a number."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col / F.lit(width))


Cells = Column | HotCells


def with_cells(df: DataFrame, keys: Sequence[str], cell: Cells, order: Sequence[str]) -> DataFrame:
    return cell.apply(df, keys, order) if isinstance(cell, HotCells) else df.withColumn(CELL, cell)


def segment_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    starts: Callable[[Column, Column], Column],
    cell: Cells,
) -> DataFrame:
    """Number gap-and-island segments per key.

    ``starts(prev, cur)`` says whether ``cur`` opens a segment, both being
    structs of the ``carry`` columns. Adds ``prev`` (struct, null on the first
    row), ``is_start``, ``segment_no``, ``row_no`` and ``position`` (1-based).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, CELL).orderBy(*order)
    upto = w.rowsBetween(FIRST, HERE)
    local = (
        with_cells(df, keys, cell, order)
        .withColumn("__cur", F.struct(*carry))
        .withColumn("__prev", F.lag("__cur").over(w))
        .withColumn("__rn", F.row_number().over(w))
        .withColumn(
            "__new",
            F.when(F.col("__rn") > 1, F.coalesce(starts(F.col("__prev"), F.col("__cur")), F.lit(False)).cast("long")),
        )
        .withColumn("__seg", F.coalesce(F.sum("__new").over(upto), F.lit(0)))
        .withColumn("__start", F.max(F.when(F.col("__new") == 1, F.col("__rn"))).over(upto))
    )
    added = ["prev", "is_start", "segment_no", "row_no", "position"]
    at = F.struct(*order)
    wk = Window.partitionBy(*keys).orderBy(CELL)
    past = wk.rowsBetween(FIRST, -1)
    cells = (
        local.groupBy(*keys, CELL)
        .agg(
            F.min_by("__cur", at).alias("__first"),
            F.max_by("__cur", at).alias("__last"),
            F.count(F.lit(1)).alias("__n"),
            F.coalesce(F.sum("__new"), F.lit(0)).alias("__news"),
            F.max("__start").alias("__tail"),
        )
        .withColumn("__plast", F.lag("__last").over(wk))
        .withColumn(
            "__enew",
            F.when(F.col("__plast").isNull(), F.lit(1)).otherwise(
                F.coalesce(starts(F.col("__plast"), F.col("__first")), F.lit(False)).cast("int")
            ),
        )
        .withColumn("__rn0", F.coalesce(F.sum("__n").over(past), F.lit(0)))
        .withColumn("__seg0", F.coalesce(F.sum(F.col("__news") + F.col("__enew")).over(past), F.lit(0)) + F.col("__enew"))
        .withColumn(
            "__open",
            F.coalesce(F.col("__rn0") + F.col("__tail"), F.when(F.col("__enew") == 1, F.col("__rn0") + 1)),
        )
        .withColumn(
            "__start0",
            F.when(F.col("__enew") == 1, F.col("__rn0") + 1).otherwise(F.last("__open", ignorenulls=True).over(past)),
        )
        .select(*keys, CELL, "__plast", "__enew", "__rn0", "__seg0", "__start0")
    )
    out = local.join(cells, [*keys, CELL])
    return (
        out.withColumn("prev", F.coalesce("__prev", "__plast"))
        .withColumn("is_start", F.coalesce(F.col("__new"), F.col("__enew").cast("long")) == 1)
        .withColumn("segment_no", F.col("__seg0") + F.col("__seg"))
        .withColumn("row_no", F.col("__rn0") + F.col("__rn"))
        .withColumn("position", F.col("row_no") - F.coalesce(F.col("__start") + F.col("__rn0"), F.col("__start0")) + 1)
        .select(*df.columns, *added)
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    cell: Cells,
    forward: bool = False,
) -> DataFrame:
    """Previous (and with ``forward`` next) row of the same key as struct columns ``prev`` / ``next``."""
    keys = list(keys)
    w = Window.partitionBy(*keys, CELL).orderBy(*order)
    wk = Window.partitionBy(*keys).orderBy(CELL)
    cur, at = F.struct(*cols), F.struct(*order)
    base = with_cells(df, keys, cell, order)
    aggs = [F.max_by(cur, at).alias("__last")] + ([F.min_by(cur, at).alias("__first")] if forward else [])
    edges = base.groupBy(*keys, CELL).agg(*aggs).withColumn("__in", F.lag("__last").over(wk))
    out = base.withColumn("prev", F.lag(cur).over(w))
    if forward:
        edges = edges.withColumn("__out", F.lead("__first").over(wk)).drop("__first")
        out = out.withColumn("next", F.lead(cur).over(w))
    out = out.join(edges.drop("__last"), [*keys, CELL]).withColumn("prev", F.coalesce("prev", "__in"))
    if forward:
        out = out.withColumn("next", F.coalesce("next", "__out"))
    return out.select(*df.columns, "prev", *(["next"] if forward else []))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Cells) -> DataFrame:
    """1-based ``row_no`` in key order and ``row_count`` of the key."""
    keys = list(keys)
    wk = Window.partitionBy(*keys).orderBy(CELL)
    whole = Window.partitionBy(*keys)
    base = with_cells(df, keys, cell, order)
    counts = (
        base.groupBy(*keys, CELL)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__rn0", F.coalesce(F.sum("__n").over(wk.rowsBetween(FIRST, -1)), F.lit(0)))
        .withColumn("row_count", F.sum("__n").over(whole))
        .drop("__n")
    )
    w = Window.partitionBy(*keys, CELL).orderBy(*order)
    return (
        base.withColumn("__rn", F.row_number().over(w))
        .join(counts, [*keys, CELL])
        .withColumn("row_no", F.col("__rn0") + F.col("__rn"))
        .select(*df.columns, "row_no", "row_count")
    )


def haloed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    cell: Cells,
    before: int = 0,
    after: int = 0,
) -> tuple[DataFrame, Window]:
    """Rows plus the ``before`` / ``after`` nearest rows of the neighbouring cells.

    Returns the frame (ghost rows flagged ``__ghost``) and the window spec over
    which any row frame of that reach is exact. Only ``before`` rows per cell
    are copied, and Spark limits them per map task before the shuffle.
    """
    keys, order = list(keys), list(order)
    need = list(dict.fromkeys([*order, *cols]))
    # a key of one slice has no neighbouring slices, so its rows are not ranked for edges
    base = cell.apply(df, keys, order, "__hot") if isinstance(cell, HotCells) else with_cells(df, keys, cell, order).withColumn("__hot", F.lit(True))
    wk = Window.partitionBy(*keys).orderBy(CELL)
    out = base.drop("__hot").withColumn("__ghost", F.lit(False))

    def edge(size: int, last: bool) -> DataFrame:
        side = [F.col(c).desc() if last else F.col(c).asc() for c in order]
        w = Window.partitionBy(*keys, CELL).orderBy(*side)
        row = F.struct(*need)
        picked = (
            base.filter("__hot")
            .select(*keys, CELL, *[c for c in need if c not in keys])
            .withColumn("__rn", F.row_number().over(w))
            .filter(F.col("__rn") <= size)
            .groupBy(*keys, CELL)
            .agg(F.sort_array(F.collect_list(row)).alias("__rows"))
        )
        frame = wk.rowsBetween(-size, -1) if last else wk.rowsBetween(1, size)
        near = F.flatten(F.collect_list("__rows").over(frame))
        near = F.when(F.size(near) > size, F.slice(near, -size if last else 1, size)).otherwise(near)
        return (
            picked.withColumn("__near", near)
            .select(*keys, CELL, F.explode("__near").alias("__r"))
            .select(*keys, CELL, *[F.col(f"__r.{c}").alias(c) for c in need if c not in keys])
            .withColumn("__ghost", F.lit(True))
        )

    if before:
        out = out.unionByName(edge(before, True), allowMissingColumns=True)
    if after:
        out = out.unionByName(edge(after, False), allowMissingColumns=True)
    return out, Window.partitionBy(*keys, CELL).orderBy(*order)


def drop_ghosts(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("__ghost")).drop("__ghost", CELL)


def value_counts_below(
    df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None, probs: Sequence[float] = (), rows_per_cell: int = 1_000_000
) -> DataFrame:
    """Distinct values with ``n`` (rows, or summed weight), ``below`` (rows with a smaller value) and ``total``.

    This is what ranks with ties and exact quantiles need, without a global sort:
    more than ``rows_per_cell`` distinct values of a key are cut at equi-depth splitters.
    With ``probs`` only the cells that hold those quantiles are sorted and returned.
    """
    keys = list(keys)
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(size.alias("n"))
    counts = checkpointed(counts)  # read three times below; the source is scanned once
    counts = HotCells(rows_per_cell).apply(counts, keys, [value])
    wk = Window.partitionBy(*keys).orderBy(CELL)
    per_cell = (
        counts.groupBy(*keys, CELL)
        .agg(F.sum("n").alias("__n"))
        .withColumn("__below", F.coalesce(F.sum("__n").over(wk.rowsBetween(FIRST, -1)), F.lit(0)))
        .withColumn("total", F.sum("__n").over(Window.partitionBy(*keys)))
    )
    if probs:
        wanted = F.lit(False)
        for p in probs:
            at = F.lit(float(p)) * (F.col("total") - 1)
            for rank in (F.floor(at), F.ceil(at)):
                wanted = wanted | ((F.col("__below") <= rank) & (rank < F.col("__below") + F.col("__n")))
        per_cell = per_cell.filter(wanted)
    per_cell = per_cell.drop("__n")
    w = Window.partitionBy(*keys, CELL).orderBy(value).rowsBetween(FIRST, -1)
    return (
        counts.join(per_cell, [*keys, CELL])
        .withColumn("__in", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .select(*keys, value, "n", (F.col("__below") + F.col("__in")).alias("below"), "total")
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles, one column ``q_<i>`` per probability.

    ``percentile`` keeps every distinct value of a group in one task; this keeps
    per-cell counts and picks the two neighbouring order statistics.
    """
    keys = list(keys)
    ranked = value_counts_below(df, value, keys, weight=weight, probs=probs)
    aggs = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("total") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        has = lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("n"))
        v = F.col(value).cast("double")
        low = F.max(F.when(has(lo), v))
        high = F.max(F.when(has(hi), v))
        frac = F.max(at - lo)
        aggs.append((low + (high - low) * frac).alias(f"q_{i}"))
    return ranked.groupBy(*keys).agg(*aggs)
