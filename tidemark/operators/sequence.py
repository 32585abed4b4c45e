"""Ordered rows: lags, frames, fills and positions without one task per series.

A window partitioned by the series key alone puts a whole series into one task. That is
fine while the largest series is known to be small (``KeyedSequence``). Beyond that,
``BandedSequence`` range-partitions the rows on (keys, order), writes them once to the
shared folder with the position inside their partition, and calls each such partition a
band. Bands are slices of one total order, so neither a hot key nor a burst of rows nor
many equal timestamps makes a band large. Whatever has to cross a band border is one row
per band: row offsets, the last value before the band, or the few rows a frame looks back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import col, require
from tidemark.operators.keys import attach
from tidemark.session import materialize

Feature = Callable[[WindowSpec], Column]

_BAND_SHIFT = 33  # monotonically_increasing_id: partition number above, row number below


def _row_hash(df: DataFrame) -> Column:
    """Comes last in every order, so that both ways break ties alike."""
    return F.xxhash64(*[col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


class KeyedSequence:
    """Plain windows per key, for series proven to fit one task."""

    def __init__(self, df: DataFrame, order_by: Sequence[str], keys: Sequence[str] = ()):
        require(df, *order_by, *keys)
        self.keys, self.order_by = list(keys), list(order_by)
        self.df = self.table = df
        self.tiebreak = _row_hash(df)

    def _window(self, backwards: bool = False) -> WindowSpec:
        order = [col(c).desc_nulls_last() if backwards else col(c).asc_nulls_first() for c in self.order_by]
        last = self.tiebreak.desc() if backwards else self.tiebreak.asc()
        parts = [col(k) for k in self.keys] or [F.lit(1)]
        return Window.partitionBy(*parts).orderBy(*order, last)

    def over(self, features: Mapping[str, Feature], lookback: int = 0, lookahead: int = 0) -> DataFrame:
        w = self._window()
        return self.df.withColumns({name: make(w) for name, make in features.items()})

    def with_index(self, index: str, total: str | None = None) -> DataFrame:
        w = self._window()
        out = self.df.withColumn(index, (F.row_number().over(w) - 1).cast("long"))
        if total:
            everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            out = out.withColumn(total, F.count(F.lit(1)).over(everything))
        return out

    def running_total(self, weight: str, output: str) -> DataFrame:
        """Sum of ``weight`` over the rows of the key up to and with the current one."""
        so_far = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self.df.withColumn(output, F.sum(col(weight)).over(so_far))

    def neighbours(self, columns: Sequence[str]) -> DataFrame:
        """Add ``__prev_i`` and ``__next_i``: nearest non-null (value, position) each way."""
        df = self.df.withColumn("__pos", F.row_number().over(self._window()).cast("long"))
        return df.withColumns(_in_group_neighbours(columns, self._window(), self._window(backwards=True)))


class BandedSequence:
    """The same operations over bands of one frozen total order.

    ``order_by`` should be unique within a key (add a tiebreak column); a hash of the row
    comes last in the order, so rows that are merely equal in it still spread over bands.
    ``bands`` defaults to the session's ``spark.sql.shuffle.partitions``.
    """

    def __init__(
        self,
        df: DataFrame,
        order_by: Sequence[str],
        keys: Sequence[str] = (),
        bands: int | None = None,
    ):
        require(df, *order_by, *keys)
        self.keys, self.order_by = list(keys), list(order_by)
        self.columns = df.columns
        spark = df.sparkSession
        self.bands = count = bands or int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = [col(c).asc_nulls_first() for c in [*self.keys, *self.order_by]] + [F.col("__hash")]
        placed = (
            df.withColumn("__hash", _row_hash(df))
            .repartitionByRange(count, *order)
            .sortWithinPartitions(*order)
            .drop("__hash")
            .withColumn("__id", F.monotonically_increasing_id())
        )
        # Range bounds come from a sample and differ between jobs, so the positions
        # are only usable once written.
        frozen = materialize(placed, "bands")
        key = F.struct(*[col(k) for k in self.keys]) if self.keys else F.struct(F.lit(1))
        self.rows = frozen.select(
            *[col(c) for c in self.columns],
            F.shiftright("__id", _BAND_SHIFT).cast("int").alias("__band"),
            F.col("__id").bitwiseAND(F.lit((1 << _BAND_SHIFT) - 1)).alias("__row"),
            key.alias("__key"),
        )
        self.table = frozen.select(*[col(c) for c in self.columns])

    # -- one row per band -------------------------------------------------------

    @cached_property
    def _edges(self) -> DataFrame:
        """Per band: first row's and last row's key, row count, offset in the total order.

        Every operation needs this small table, some of them several times, so it is
        computed once. Counting and picking two rows per band needs no sort of the rows.
        """
        counts = self.rows.groupBy("__band").agg(F.count(F.lit(1)).alias("__n"))
        if self.keys:
            sizes = counts.select(F.col("__band").alias("__b"), F.col("__n").alias("__size"))
            ends = self.rows.join(F.broadcast(sizes), F.col("__band") == F.col("__b")).where(
                (F.col("__row") == 0) | (F.col("__row") == F.col("__size") - 1)
            )
            counts = ends.groupBy("__band").agg(
                F.min_by("__key", "__row").alias("__first_key"),
                F.max_by("__key", "__row").alias("__last_key"),
                F.max("__size").alias("__n"),
            )
        else:
            only = F.struct(F.lit(1))
            counts = counts.withColumns({"__first_key": only, "__last_key": only})
        # One row per band, so this unpartitioned window is as small as the band count.
        before = Window.orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        return materialize(placed.coalesce(1), "edges")

    def _with_position(self) -> DataFrame:
        """Rows with ``__g``, their 0-based position in the total order over all keys."""
        starts = self._edges.select("__band", "__start")
        return self.rows.join(F.broadcast(starts), "__band").withColumn(
            "__g", F.col("__start") + F.col("__row")
        )

    def _one_band_per_task(self, rows: DataFrame, band: str) -> DataFrame:
        """Shuffle by the band number itself: hashing would put several bands in one task."""
        return rows.repartitionById(self.bands, F.col(band))

    # -- operations ----------------------------------------------------------------

    def over(self, features: Mapping[str, Feature], lookback: int = 0, lookahead: int = 0) -> DataFrame:
        """Evaluate frames that reach at most ``lookback`` rows back and ``lookahead`` on.

        Rows near a border are copied into the bands whose frames reach them, so each
        band can be evaluated alone.
        """
        edges = self._edges.select(
            "__band", "__start", (F.col("__start") + F.col("__n")).alias("__end")
        )
        around = Window.orderBy("__band")
        borders = edges
        if lookback:
            # Bands are non-empty, so at most ``lookback`` following ones can be in reach.
            following = F.collect_list(F.struct("__band", "__start")).over(around.rowsBetween(1, lookback))
            borders = borders.withColumn(
                "__later", F.filter(following, lambda b: b["__start"] - F.col("__end") < lookback)
            )
        if lookahead:
            preceding = F.collect_list(F.struct("__band", "__end")).over(around.rowsBetween(-lookahead, -1))
            borders = borders.withColumn(
                "__earlier", F.filter(preceding, lambda b: F.col("__start") - b["__end"] < lookahead)
            )
        targets = [F.array("__band")]
        placed = self.rows.join(F.broadcast(borders), "__band").withColumn(
            "__g", F.col("__start") + F.col("__row")
        )
        if lookback:
            reached = F.filter("__later", lambda b: b["__start"] - F.col("__g") <= lookback)
            targets.append(F.transform(reached, lambda b: b["__band"]))
        if lookahead:
            reached = F.filter("__earlier", lambda b: F.col("__g") - b["__end"] < lookahead)
            targets.append(F.transform(reached, lambda b: b["__band"]))
        copied = placed.select(
            *[col(c) for c in self.columns],
            "__band",
            "__g",
            F.explode(F.concat(*targets)).alias("__target"),
        )
        w = Window.partitionBy("__target", *[col(k) for k in self.keys]).orderBy("__g")
        made = self._one_band_per_task(copied, "__target").withColumns(
            {name: make(w) for name, make in features.items()}
        )
        own = made.where(F.col("__band") == F.col("__target"))
        return own.drop("__band", "__target", "__g")

    def with_index(self, index: str, total: str | None = None) -> DataFrame:
        """Add the 0-based position within the key and, if asked, the key's row count."""
        placed = self._with_position()
        if not self.keys:
            out = placed.withColumn(index, F.col("__g"))
            if total:
                n = self.rows.agg(F.count(F.lit(1)).alias("n")).scalar()
                out = out.withColumn(total, n)
            return out.drop("__band", "__row", "__key", "__start", "__g")
        # Keys that cross a border are first or last in some band: at most two per band.
        edges = self._edges
        edge_keys = edges.select("__band", F.col("__first_key").alias("__edge")).union(
            edges.select("__band", F.col("__last_key").alias("__edge"))
        ).distinct()
        touching = placed.join(
            F.broadcast(edge_keys.withColumnRenamed("__band", "__edge_band")),
            (F.col("__band") == F.col("__edge_band")) & (F.col("__key") == F.col("__edge")),
            "left_semi",
        )
        spanning = (
            touching.groupBy("__band", "__key")
            .agg(F.min("__g").alias("g"), F.count(F.lit(1)).alias("n"))
            .groupBy("__key")
            .agg(
                F.min("g").alias("__span_first"),
                F.sum("n").alias("__span_total"),
                F.count(F.lit(1)).alias("bands"),
            )
            .where(F.col("bands") > 1)
            .select(F.col("__key").alias("__span_key"), "__span_first", "__span_total")
        )
        group = Window.partitionBy("__band", *[col(k) for k in self.keys])
        joined = self._one_band_per_task(
            placed.join(F.broadcast(spanning), F.col("__key") == F.col("__span_key"), "left"), "__band"
        )
        out = joined.withColumn(
            index, F.col("__g") - F.coalesce("__span_first", F.min("__g").over(group))
        )
        if total:
            out = out.withColumn(
                total, F.coalesce("__span_total", F.count(F.lit(1)).over(group))
            )
        return out.select(*[col(c) for c in self.columns], index, *([total] if total else []))

    def running_total(self, weight: str, output: str) -> DataFrame:
        """Sum of ``weight`` over the rows of the key up to and with the current one."""
        ends = self._edges.select("__band", "__last_key")
        tagged = self.rows.join(F.broadcast(ends), "__band")
        of_last = F.when(F.col("__key") == F.col("__last_key"), col(weight))
        tails = tagged.groupBy("__band").agg(F.sum(of_last).alias("__tail"))
        # Both windows see one row per band.
        same_key = Window.partitionBy("__last_key").orderBy("__band").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        in_order = Window.orderBy("__band")
        runs = ends.join(F.broadcast(tails), "__band").withColumn("__run", F.sum("__tail").over(same_key))
        borders = runs.select(
            "__band",
            F.lag("__last_key").over(in_order).alias("__before_key"),
            F.lag("__run").over(in_order).alias("__carry"),
        )
        w = Window.partitionBy("__band", *[col(k) for k in self.keys]).orderBy("__row")
        local = F.sum(col(weight)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        carried = F.when(F.col("__key") == F.col("__before_key"), F.col("__carry")).otherwise(F.lit(0))
        shuffled = self._one_band_per_task(self.rows.join(F.broadcast(borders), "__band"), "__band")
        out = shuffled.withColumn(output, local + carried)
        return out.select(*[col(c) for c in self.columns], output)

    def neighbours(self, columns: Sequence[str]) -> DataFrame:
        """Add ``__prev_i`` and ``__next_i``: nearest non-null (value, position) each way.

        In the band by a window; across borders by one carried struct per band.
        """
        placed = self._with_position()
        edges = self._edges
        keys = F.broadcast(edges.select("__band", "__first_key", "__last_key"))
        tagged = placed.join(keys, "__band")
        # First the rows that hold the outermost values of a band, then the values there.
        where_found, at_tail, at_head = [], [], []
        for i, name in enumerate(columns):
            in_last = col(name).isNotNull() & (F.col("__key") == F.col("__last_key"))
            in_first = col(name).isNotNull() & (F.col("__key") == F.col("__first_key"))
            where_found.append(F.max(F.when(in_last, F.col("__row"))).alias(f"__tail_row_{i}"))
            where_found.append(F.min(F.when(in_first, F.col("__row"))).alias(f"__head_row_{i}"))
            at_tail.append(F.col("__row") == F.col(f"__tail_row_{i}"))
            at_head.append(F.col("__row") == F.col(f"__head_row_{i}"))
        spots = tagged.groupBy("__band").agg(*where_found)
        outermost = placed.join(F.broadcast(spots), "__band").where(
            reduce(lambda a, b: a | b, [*at_tail, *at_head])
        )
        found = []
        for i, name in enumerate(columns):
            seen = F.struct(col(name).alias("v"), F.col("__g").alias("g"))
            found.append(F.max_by(seen, F.when(at_tail[i], F.col("__row"))).alias(f"__tail_{i}"))
            found.append(F.max_by(seen, F.when(at_head[i], F.col("__row"))).alias(f"__head_{i}"))
        carried = keys.join(outermost.groupBy("__band").agg(*found), "__band", "left")
        # Both windows below see one row per band.
        down = Window.partitionBy("__last_key").orderBy("__band").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        up = Window.partitionBy("__first_key").orderBy(F.col("__band").desc()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        in_order = Window.orderBy("__band")
        runs = carried.withColumns(
            {
                **{f"__run_tail_{i}": F.last(f"__tail_{i}", True).over(down) for i in range(len(columns))},
                **{f"__run_head_{i}": F.last(f"__head_{i}", True).over(up) for i in range(len(columns))},
                "__before_key": F.lag("__last_key").over(in_order),
                "__after_key": F.lead("__first_key").over(in_order),
            }
        )
        borders = runs.select(
            "__band",
            "__before_key",
            "__after_key",
            *[F.lag(f"__run_tail_{i}").over(in_order).alias(f"__in_{i}") for i in range(len(columns))],
            *[F.lead(f"__run_head_{i}").over(in_order).alias(f"__out_{i}") for i in range(len(columns))],
        )
        group = Window.partitionBy("__band", *[col(k) for k in self.keys])
        onwards, backwards = group.orderBy("__row"), group.orderBy(F.col("__row").desc())
        joined = placed.join(F.broadcast(borders), "__band", "left").withColumn("__pos", F.col("__g"))
        local = self._one_band_per_task(joined, "__band").withColumns(
            _in_group_neighbours(columns, onwards, backwards)
        )
        filled = local.withColumns(
            {
                **{
                    f"__prev_{i}": F.coalesce(
                        f"__prev_{i}",
                        F.when(F.col("__key") == F.col("__before_key"), F.col(f"__in_{i}")),
                    )
                    for i in range(len(columns))
                },
                **{
                    f"__next_{i}": F.coalesce(
                        f"__next_{i}",
                        F.when(F.col("__key") == F.col("__after_key"), F.col(f"__out_{i}")),
                    )
                    for i in range(len(columns))
                },
            }
        )
        found = [f"__{side}_{i}" for side in ("prev", "next") for i in range(len(columns))]
        return filled.select(*[col(c) for c in self.columns], "__pos", *found)


def _in_group_neighbours(
    columns: Sequence[str], onwards: WindowSpec, backwards: WindowSpec
) -> dict[str, Column]:
    """Running last non-null value in both orders.

    The later neighbour is the last one seen going backwards: a frame that runs to the
    end of its group would be evaluated anew for every row.
    """
    out: dict[str, Column] = {}
    for side, w in (("prev", onwards), ("next", backwards)):
        running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for i, name in enumerate(columns):
            seen = F.when(
                col(name).isNotNull(), F.struct(col(name).alias("v"), F.col("__pos").alias("g"))
            )
            out[f"__{side}_{i}"] = F.last(seen, True).over(running)
    return out


def sequence(
    df: DataFrame,
    order_by: str | Sequence[str],
    keys: Sequence[str] = (),
    strategy: str = "banded",
    bands: int | None = None,
) -> KeyedSequence | BandedSequence:
    """Pick the way to process ordered rows; both give the same rows, also for ties.

    ``banded`` works at any size. ``keyed`` is for callers that know a bound of the rows
    per key, such as a panel with one row per key and calendar period.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if strategy == "keyed":
        return KeyedSequence(df, order, keys)
    if strategy == "banded":
        return BandedSequence(df, order, keys, bands)
    raise ValueError(f"unknown strategy {strategy!r}")


def row_at(
    df: DataFrame,
    value: str,
    weight: str,
    positions: Mapping[str, Callable[[Column], Column]],
    keys: Sequence[str] = (),
    strategy: str = "banded",
) -> DataFrame:
    """One row per key with ``n`` and the values at given 0-based ranks of sorted ``value``.

    ``df`` has one row per key and distinct value with its number of occurrences, so a
    value that fills half a table is still one row. ``positions`` maps an output name
    to a function of the key's total count.
    """
    rows = sequence(df.select(*[col(k) for k in keys], col(value), col(weight)), value, keys, strategy)
    summed = rows.running_total(weight, "__cum")
    totals = rows.table.groupBy(*[col(k) for k in keys]).agg(F.sum(col(weight)).alias("n"))
    placed = attach(summed, totals, keys, ["n"])
    wanted = []
    for name, make in positions.items():
        rank = make(F.col("n"))
        covers = (F.col("__cum") - col(weight) <= rank) & (rank < F.col("__cum"))
        wanted.append(F.max(F.when(covers, col(value))).alias(name))
    return placed.groupBy(*[col(k) for k in keys]).agg(F.max("n").alias("n"), *wanted)
