"""Pairs of profiles: the thresholded correlation join, decoys, prior pairs, ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from elutra.functions import names
from elutra.functions import profiles as p
from elutra.operators.blocks import BLOCK, Places, dealt, matrix, over_blocks
from elutra.plans.stages import Rounds, keep

#: Rows of a tile, whose products fit a core's cache.
TILE = 256
#: Draws that one row is exploded to.
CHUNK = 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` centred and scaled to length 1, so that products of them are correlations."""
    flat = np.ptp(x, axis=1) == 0
    x = x - x.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    norm[flat] = np.nan  # a constant profile correlates with nothing
    with np.errstate(invalid="ignore"):
        return x / norm


def correlated_pairs(profiles: DataFrame, threshold: float | None = 0.4, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """(a, b, r) with a < b for pairs of ``profiles`` (key, vals) whose Pearson correlation is over ``threshold``.

    None gives all pairs with a correlation. The matrix of all pairs is cut into blocks of keys by
    keys; a task holds two blocks of profiles and emits hits only, tile by tile. Memory doesn't grow with the table.
    With ``by``, pairs are made within each of its values, in one job for all of them, and have it as a column.
    """
    return _pairs_where(profiles, np.isfinite if threshold is None else lambda r: r > threshold, block, by)


def sizes_by(df: DataFrame, by: str, out: str = "n") -> DataFrame:
    """(by, n): a row for each value of ``by``."""
    return df.groupBy(by).agg(F.count("*").alias(out))


def _pairs_where(profiles: DataFrame, holds: Callable[[np.ndarray], np.ndarray], block: int = BLOCK, by: str | None = None) -> DataFrame:
    types = dict(profiles.dtypes)
    kind, group = types["key"], [by] if by else []
    own = profiles.select(*group, "key", F.transform("vals", lambda x: x.cast("double")).alias("vals"))

    def within(of: object, held: pa.Table, _: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = held["part"].to_numpy()
        sides = [np.flatnonzero(part == k) for k in np.unique(part)]
        same = held["low"][0].as_py() == held["high"][0].as_py()
        if not same and len(sides) < 2:
            return
        x, keys, rank = unit(matrix(held["vals"])), held["key"].combine_chunks(), held["key"].to_numpy()
        left, right = sides[0], sides[-1]
        for i in range(0, len(left), TILE):
            for j in range(i if same else 0, len(right), TILE):
                a, b = left[i : i + TILE], right[j : j + TILE]
                with np.errstate(invalid="ignore"):
                    r = x[a] @ x[b].T
                    hit = holds(r)
                if same and i == j:
                    hit = np.triu(hit, 1)
                at = np.flatnonzero(hit)
                a, b, r = a[at // len(b)], b[at % len(b)], r.ravel()[at]
                swap = rank[a] > rank[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                if same and (equal := rank[a] == rank[b]).any():
                    a, b, r = a[~equal], b[~equal], r[~equal]
                columns = {"a": keys.take(pa.array(a)), "b": keys.take(pa.array(b)), "r": pa.array(r)}
                yield pa.RecordBatch.from_pydict({c: pa.array([of] * len(r), held.schema.field(c).type) for c in group} | columns)

    schema = ", ".join([*(f"{c} {types[c]}" for c in group), f"a {kind}, b {kind}, r double"])
    return over_blocks(dealt(own, block=block, by=by), within, schema, by)


def prior_pairs(prior: DataFrame, profiles: DataFrame, by: str | None = None) -> DataFrame:
    """The pairs (a, b) whose both ends have a profile. With ``by``, for each of its values that has both."""
    if by:
        a, b = (profiles.select(by, F.col("key").alias(c)).distinct() for c in "ab")
        return prior.join(a, "a").join(b, [by, "b"]).select(by, "a", "b")
    keys = profiles.select("key")
    return prior.join(keys, prior["a"] == keys["key"], "left_semi").join(keys.withColumnRenamed("key", "key_b"), F.col("b") == F.col("key_b"), "left_semi")


def attach_profiles(pairs: DataFrame, profiles: DataFrame, values: str = "vals") -> DataFrame:
    """The pairs with ``fa`` and ``fb``. Spark broadcasts the profiles if they are small enough for it."""
    x = profiles.select(F.col("key").alias("a"), F.col(values).alias("fa"))
    y = profiles.select(F.col("key").alias("b"), F.col(values).alias("fb"))
    return pairs.join(x, "a").join(y, "b")


def decoy_pairs(profiles: DataFrame, k: int, threshold: float = 0.4, seed: int = 0, tries: int = 4) -> DataFrame:
    """``k`` pairs (draw, a, b) of profiles that don't correlate over ``threshold``, drawn with replacement. See ``decoys_by``."""
    spark = profiles.sparkSession
    wanted = spark.createDataFrame([(0, k)], "_all int, k long")
    return decoys_by(profiles.withColumn("_all", F.lit(0)), wanted, "_all", threshold, seed, tries).drop("_all")


def decoys_by(profiles: DataFrame, wanted: DataFrame, by: str, threshold: float = 0.4, seed: int = 0, tries: int = 4) -> DataFrame:
    """(by, draw, a, b): for each row (by, k) of ``wanted``, k pairs of that group's profiles that don't correlate over ``threshold``.

    Draw i takes the first of its hashed pairs that is no self-pair and doesn't correlate, so draws
    need neither the matrix of all pairs nor an order of execution, and a group's don't depend on other groups. Draws that
    fail are drawn again in rounds, all groups together. Once a round fills under a hundredth of them, pairs that don't correlate
    are so few that all of the groups that still lack some are listed, and the rest is drawn from the lists. Groups without such pairs have no decoys.
    """
    keyed = numbered_by(profiles.select(by, "key", "vals"), by, "key").select(by, F.col("row").alias("at"), "key", "vals")
    keyed = keep(keyed)
    x, y = (keyed.select(by, F.col("at").alias(i), F.col("key").alias(c), F.col("vals").alias(f"f{c}")) for i, c in (("i", "a"), ("j", "b")))
    sizes = keep(wanted.join(sizes_by(keyed, by), by).where("n > 1 and k > 0"))
    n_all, found = sizes.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0], None
    ends = lambda attempt: [F.pmod(hashed(F.lit(seed), F.lit(end), F.col("draw"), attempt), F.col("n")).alias(end) for end in ("i", "j")]
    if n_all:
        written = Rounds(profiles.sparkSession)
        last = F.least(F.col("k"), (F.col("chunk") + 1) * CHUNK) - 1
        chunks = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / CHUNK)))).repartition(by, "chunk")
        asked = chunks.select(by, "n", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("draw"))
        once = written.keep(_first_tries(keyed, asked.select(by, "draw", "n", *ends(F.lit(0))), by, threshold))
        found = once.where("a is not null").select(by, "draw", "a", "b")
        left = once.where("a is null").select(by, "n", "draw")
        n_left, first, more = left.count(), 1, max(1, tries - 1)
        n_got = n_all - n_left
        while n_left:
            asked = left.withColumn("try", F.explode(F.sequence(F.lit(first), F.lit(first + more - 1))))
            asked = asked.select(by, "draw", "try", *ends(F.col("try"))).where("i <> j")
            ok = asked.join(x, [by, "i"]).join(y, [by, "j"]).where(p.pearson(F.col("fa"), F.col("fb")) <= threshold)
            got = keep(ok.groupBy(by, "draw").agg(F.min_by(F.struct("a", "b"), "try").alias("x")).select(by, "draw", "x.a", "x.b"))
            found = found.union(got)
            n_more = got.count()
            left, first, more, n_left, n_got = keep(left.join(got, [by, "draw"], "left_anti").select(by, "n", "draw")), first + more, tries, n_left - n_more, n_got + n_more
            if n_left and n_got * 100 < n_got + n_left:
                poor = keyed.join(left.select(by).distinct(), by, "left_semi")
                allowed = numbered_by(_pairs_where(poor, lambda r: r <= threshold, by=by).select(by, "a", "b"), by, "a", "b")
                chosen = left.select(by, "draw").join(sizes_by(allowed, by), by).withColumn("row", F.pmod(hashed(F.lit(seed), F.lit("list"), F.col("draw")), F.col("n")))
                return found.union(chosen.join(allowed, [by, "row"]).select(by, "draw", "a", "b"))
            n_got = 0
    types = dict(profiles.dtypes)
    return profiles.sparkSession.createDataFrame([], f"{by} {types[by]}, draw long, a {types['key']}, b {types['key']}") if found is None else found


def _first_tries(keyed: DataFrame, asked: DataFrame, by: str, threshold: float) -> DataFrame:
    """(by, n, draw, a, b) of the draws ``asked`` (by, n, draw, i, j), in one pass; a and b are NULL where the pair is a self-pair or isn't allowed.

    Draws go to the tasks that hold the blocks of both profiles, so that no profile is sent for each of them.
    """
    types = dict(keyed.dtypes)

    def within(of: object, held: pa.Table, given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, names, places = unit(matrix(held["vals"])), held["name"].combine_chunks(), Places(held["key"])
        for batch in given:
            i, j = places.of(batch.column("a")), places.of(batch.column("b"))
            with np.errstate(invalid="ignore"):
                wrong = ~((np.einsum("ij,ij->i", x[i], x[j]) <= threshold) & (i != j))
            a, b = (names.take(pa.array(k, mask=wrong)) for k in (i, j))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in (by, "n", "draw")} | {"a": a, "b": b})

    own = keyed.select(by, F.col("at").alias("key"), F.transform("vals", lambda v: v.cast("double")).alias("vals"), F.col("key").alias("name"))
    rows = dealt(own, asked.select(by, "n", "draw", F.col("i").alias("a"), F.col("j").alias("b")), by=by)
    return over_blocks(rows, within, f"{by} {types[by]}, n long, draw long, a {types['key']}, b {types['key']}", by)


def hashed(*columns: Column) -> Column:
    """A number of 60 bits from the text of the columns, the same in every engine."""
    text = F.concat_ws(":", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def number(df: DataFrame, *order: str, out: str = "row", put: Callable[[DataFrame], DataFrame] = keep) -> DataFrame:
    """Rows numbered from 0 in order, without one task for all: places within ranges, and sizes of the ranges before.

    The ranges are written down once (by ``put``), as a second exchange could draw other borders between them.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = put(ranged.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = at.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    joined = at.join(F.broadcast(sizes), "_part")
    return joined.withColumn(out, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_id", "_part", "_before")


def numbered_by(df: DataFrame, by: str, *order: str, out: str = "row") -> DataFrame:
    """Rows numbered from 0 within each value of ``by``: places in all rows, less the group's first place.

    They are written as Parquet, which takes about a fifth of a checkpoint's space for rows of numbers.
    """
    told = number(df, by, *order, out=out, put=Rounds(df.sparkSession).keep)
    first = told.groupBy(by).agg(F.min(out).alias("_first"))  # a row for each group
    return told.join(F.broadcast(first), by).withColumn(out, F.col(out) - F.col("_first")).drop("_first").select(*df.columns, out)


def pair_table(positives: DataFrame, decoys: DataFrame, prior: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """(id, a, b, mb, is_decoy): positives numbered ppi_1.. in order, then prior pairs, then decoys DECOY_ppi_.. on from there.

    Numbers are given before self-pairs are dropped. Pairs that are both correlated and prior stay twice.
    With ``by``, each of its values has numbers of its own.
    """
    key = by or "_all"
    positives, decoys, prior = (x if x is None or by else x.withColumn(key, F.lit(0)) for x in (positives, decoys, prior))
    both = positives.select(key, "a", "b", F.lit(0).alias("kind"))
    both = both if prior is None else both.unionByName(prior.select(key, "a", "b", F.lit(1).alias("kind")))
    told = numbered_by(both, key, "kind", "a", "b").select(key, "a", "b", F.concat(F.lit("ppi_"), (F.col("row") + 1).cast("string")).alias("id"), F.lit(False).alias("is_decoy"))
    n = F.broadcast(sizes_by(both.where("a <> b"), key))
    wrong = numbered_by(decoys.select(key, "a", "b"), key, "a", "b").join(n, key, "left")
    wrong = wrong.select(key, "a", "b", F.concat(F.lit("DECOY_ppi_"), (F.col("row") + F.coalesce("n", F.lit(0)) + 1).cast("string")).alias("id"), F.lit(True).alias("is_decoy"))
    x, y = F.col("a").cast("string"), F.col("b").cast("string")
    mb = F.when(F.col("is_decoy"), names.pair_key(x, y, decoy=True)).otherwise(names.pair_key(x, y))
    return told.unionByName(wrong).where("a <> b").select(*([by] if by else []), "id", "a", "b", mb.alias("mb"), "is_decoy")
