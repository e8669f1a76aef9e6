"""Running values and order statistics over groups of any size, in pieces of bounded rows.

Rows are dealt out by range of their group and order, and each range is cut into pieces of so many rows, once,
in a stored table. Values run within each piece; the totals or last rows of the pieces, a few a group, run over
the pieces and are joined back. No window, join or row holds a group or its cuts, only a piece or a group's pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.sources import store

PIECE_ROWS = 200_000
PIECE, KEY = "__piece", "__key"
#: Bits of a row's number below its partition's in ``monotonically_increasing_id``.
BITS = 33


def _group(groups: list[str]) -> Column:
    """One key of a group that nulls are part of."""
    return F.struct(*(F.col(f"`{g}`").alias(f"g{k}") for k, g in enumerate(groups)), F.lit(0).alias("g"))


def in_pieces(rows: DataFrame, groups: list[str], order: list[str], piece_rows: int | None = None) -> DataFrame:
    """``rows`` with their group's key and the number of their piece, stored; a group's pieces follow each other in ``order``.

    A piece has at most ``piece_rows`` rows. Of rows of equal order some may be in the next piece.
    """
    spark, most = rows.sparkSession, piece_rows or PIECE_ROWS
    by = [F.col(f"`{c}`") for c in (*groups, *order)]
    number = F.monotonically_increasing_id()
    within = F.floor(number.bitwiseAND(F.lit((1 << BITS) - 1)) / most)
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    cut = ranged.select("*", _group(groups).alias(KEY), F.shiftleft(F.shiftrightunsigned(number, BITS), BITS).bitwiseOR(within).alias(PIECE))
    folder = store.shared_folder(spark, "pieces")
    cut.write.parquet(folder)  # a range is drawn anew in each run, so that rows keep their pieces only where they are stored
    return spark.read.schema(cut.schema).parquet(folder)


def along(rows: DataFrame, groups: list[str], order: list[str], sums: dict[str, Column | str], before: dict[str, str], piece_rows: int | None = None) -> DataFrame:
    """``rows`` with running sums, each up to and with its row, and values of the row before, null in a group's first.

    ``sums``: name of a new column and what it adds up; ``before``: name of a new column and that whose value it takes.
    ``order`` must tell a group's rows apart.
    """
    names, kept = [F.col(f"`{c}`") for c in rows.columns], [F.struct(F.lit(0).alias("o"), *(F.col(f"`{c}`").alias(f"v{k}") for k, c in enumerate(before.values()))).alias("__row")]
    cut = in_pieces(rows, groups, order, piece_rows).select(*names, KEY, PIECE, *kept, *((F.expr(v) if isinstance(v, str) else v).alias(f"__v{k}") for k, v in enumerate(sums.values())))
    place = F.struct(*(F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(order)))
    ends = cut.groupBy(KEY, PIECE).agg(F.max_by("__row", place).alias("__last"), *(F.sum(f"__v{k}").alias(f"__t{k}") for k in range(len(sums))))
    over = Window.partitionBy(KEY).orderBy(PIECE)
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(KEY, PIECE, F.lag("__last").over(over).alias("__carried"), *(F.coalesce(F.sum(f"__t{k}").over(earlier), F.lit(0)).alias(f"__b{k}") for k in range(len(sums))))
    inside = Window.partitionBy(KEY, PIECE).orderBy(*(F.col(f"`{c}`") for c in order))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    found = cut.select(*names, KEY, PIECE, F.lag("__row").over(inside).alias("__own"), *(F.sum(f"__v{k}").over(upto).alias(f"__i{k}") for k in range(len(sums))))
    joined, last = found.join(carried, [KEY, PIECE]), F.coalesce("__own", "__carried")
    return joined.select(*names, *((F.coalesce(f"__i{k}", F.lit(0)) + F.col(f"__b{k}")).alias(n) for k, n in enumerate(sums)), *(last[f"v{k}"].alias(n) for k, n in enumerate(before)))


def running(rows: DataFrame, groups: list[str], order: list[str], sums: dict[str, Column | str], piece_rows: int | None = None) -> DataFrame:
    """``rows`` with running sums, as ``along``."""
    return along(rows, groups, order, sums, {}, piece_rows)


def previous(rows: DataFrame, groups: list[str], order: list[str], column: str, name: str, piece_rows: int | None = None) -> DataFrame:
    """``rows`` with ``name``: what ``column`` is in the row before, as ``along``."""
    return along(rows, groups, order, {}, {name: column}, piece_rows)


def at_places(rows: DataFrame, groups: list[str], value: str, places: dict[str, Column], piece_rows: int | None = None) -> DataFrame:
    """A row per group: ``groups``, n, low, high and the values at ``places`` (from 0, in ascending order, over column n); null values don't count.

    Equal values are counted first, so one value of any number of rows is one row, and outliers change
    nothing: the counts of the pieces say in which piece a place lies, and only such pieces are read again.
    """
    own = rows.where(F.col(f"`{value}`").isNotNull()).select(*(F.col(f"`{g}`") for g in groups), F.col(f"`{value}`").alias("__value"))
    counts = own.groupBy(*(F.col(f"`{g}`") for g in groups), "__value").agg(F.count("*").alias("__here"))
    cut = in_pieces(counts, groups, ["__value"], piece_rows).select(KEY, PIECE, "__value", "__here")
    sizes = cut.groupBy(KEY, PIECE).agg(F.sum("__here").alias("__sum"), F.min("__value").alias("low"), F.max("__value").alias("high"))
    group = Window.partitionBy(KEY)
    earlier = group.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    known = sizes.select(KEY, PIECE, "__sum", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"), F.sum("__sum").over(group).alias("n"))
    inside = lambda p, first, rows: (p >= first) & (p < first + rows)
    wanted = known.where(F.exists(F.array(*(inside(p, F.col("__before"), F.col("__sum")) for p in places.values())), lambda x: x)) if places else known.where("false")
    upto = F.sum("__here").over(Window.partitionBy(KEY, PIECE).orderBy("__value").rowsBetween(Window.unboundedPreceding, 0))
    first = F.col("__before") + F.col("__upto") - F.col("__here")
    at = cut.join(wanted.select(KEY, PIECE, "__before", "n"), [KEY, PIECE]).withColumn("__upto", upto)
    found = at.groupBy(KEY).agg(F.lit(0).alias("__found"), *(F.max(F.when(inside(p, first, F.col("__here")), F.col("__value"))).alias(name) for name, p in places.items()))
    ends = sizes.groupBy(KEY).agg(F.sum("__sum").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return ends.join(found, KEY, "left").select(*(F.col(KEY)[f"g{k}"].alias(g) for k, g in enumerate(groups)), "n", "low", "high", *places)
