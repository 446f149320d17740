"""Exact nearest neighbours over a tree of cells.

Donors are cut into cells at medians of a bounded sample, along the coordinate that is spread widest; donors without that
coordinate form a branch of their own. A query first meets the donors of its own cell, which proves how far its ``k``-th
neighbour is at most. It then goes to the other cells whose bounding box lies no farther than that, and to no more: a
box bounds the distance of all its donors from below, also where coordinates are missing. Nothing is left out.

Inside a cell, blocks of queries and blocks of donors of bounded size meet in tasks that keep the ``k`` best, so that a
cell of a million equal points is many tasks. No pair list is written and no side is broadcast; what the driver sees is
the sample, the tree and one box per cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import values as V
from plumbline.session import col, cut_lineage

QUERY_BLOCK = 2_000
DONOR_BLOCK = 20_000
BATCH = 200
# Donors per cell that are aimed at, the largest number of cells, and sampled donors per cell.
CELL_ROWS, MAX_CELLS, SAMPLED = 128, 2_048, 16


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance over the coordinates both rows have, scaled to all coordinates."""
    has_a, has_b = ~np.isnan(a), ~np.isnan(b)
    shared = has_a.astype(float) @ has_b.astype(float).T
    total = np.zeros(shared.shape)
    for j in range(a.shape[1]):
        gap = a[:, j][:, None] - b[:, j][None, :]
        total += np.where(np.isnan(gap), 0.0, gap * gap)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(total * a.shape[1] / shared), np.nan)


def _block_best(features: list[str], k: int):
    def best(queries: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(donors):
            donors = donors.sort_values("donor_key")
            there = donors[features].to_numpy(float)
            for start in range(0, len(queries), BATCH):
                part = queries.iloc[start:start + BATCH]
                gaps = _distances(part[features].to_numpy(float), there)
                order = np.argsort(gaps, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(part)), order.shape[1])
                picked = order.ravel()
                out.append(pd.DataFrame({
                    "query_key": part["query_key"].to_numpy()[rows],
                    "distance": gaps[rows, picked],
                    "donor_key": donors["donor_key"].to_numpy()[picked],
                    "payload": donors["payload"].to_numpy()[picked],
                }))
        columns = ["query_key", "distance", "donor_key", "payload"]
        found = pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})
        return found[found["distance"].notna()][columns]

    return best


class Cells:
    """A tree over the sampled rows; ``dims`` are the coordinates that it may cut, in a list of rows ``features`` wide."""

    def __init__(self, sample: np.ndarray, dims: list[int], leaves: int):
        self.nodes: list[list] = []  # dimension or -1, cut, nodes below, above and without; a leaf has its number second
        self.leaves = 0
        self._grow(sample, dims, leaves)

    def _grow(self, rows: np.ndarray, dims: list[int], leaves: int) -> int:
        here = len(self.nodes)
        self.nodes.append([-1, 0.0, 0, 0, 0])
        spread = {}
        for j in dims:
            known = rows[~np.isnan(rows[:, j]), j]
            if len(known) > 1 and known.min() < known.max():
                spread[j] = float(known.std()) * len(known)
        if leaves < 2 or not spread:
            self.nodes[here][1] = self.leaves
            self.leaves += 1
            return here
        j = max(spread, key=spread.get)
        values = rows[:, j]
        none = np.isnan(values)
        cut = float(np.median(values[~none]))
        if cut <= values[~none].min():
            cut = float(values[values > cut].min())
        without = min(leaves - 1, math.ceil(leaves * none.mean())) if none.any() else 0
        half = max(1, (leaves - without) // 2)
        below, above = rows[values < cut], rows[values >= cut]
        self.nodes[here][:2] = [j, cut]
        self.nodes[here][2] = self._grow(below, dims, half)
        self.nodes[here][3] = self._grow(above, dims, max(1, leaves - without - half))
        self.nodes[here][4] = self._grow(rows[none], [d for d in dims if d != j], without)
        return here

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        table = np.array(self.nodes)
        kind, next_node = table[:, 0].astype(int), table[:, 2:].astype(int)
        at, open_rows = np.zeros(len(rows), int), np.arange(len(rows))
        while len(open_rows):
            open_rows = open_rows[kind[at[open_rows]] >= 0]
            node = at[open_rows]
            values = rows[open_rows, kind[node]]
            side = np.where(np.isnan(values), 2, values >= table[node, 1])
            at[open_rows] = next_node[node, side.astype(int)]
        return table[at, 1].astype(np.int32)


def lower_bounds(rows: np.ndarray, low: np.ndarray, high: np.ndarray, always: np.ndarray, ever: np.ndarray) -> np.ndarray:
    """Smallest possible distance of each row to a donor in each box; infinite where they cannot share a coordinate.

    The distance is the mean squared gap over shared coordinates. Coordinates that every donor of the box has count
    in full; of those that some have, the ones that make the mean smallest.
    """
    gap = np.maximum(np.maximum(low[None] - rows[:, None, :], rows[:, None, :] - high[None]), 0.0) ** 2
    there = ~np.isnan(rows)[:, None, :]
    sure, maybe = there & always[None], there & (ever & ~always)[None]
    total, count = np.where(sure, gap, 0.0).sum(axis=2), sure.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        best = np.where(count > 0, total / count, np.inf)
        rest = np.sort(np.where(maybe, gap, np.inf), axis=2)
        for n in range(rest.shape[2]):
            total, count = total + rest[:, :, n], count + 1
            best = np.fmin(best, total / count)
    return np.sqrt(best * rows.shape[1])


def _matrix(columns) -> np.ndarray:
    return np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns]) if len(columns) else np.empty((0, 0))


class CellIndex:
    """Donors by cell, and which cells a query has to visit."""

    def __init__(self, queries: DataFrame, donors: DataFrame, features: list[str]):
        self.features = features
        shares = queries.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in features]).first()
        total = donors.count()
        wanted = min(MAX_CELLS, -(-total // CELL_ROWS))
        used = [j for j, c in enumerate(features) if shares[c]]
        if wanted > 1:
            sampled = donors.orderBy(F.xxhash64("donor_key")).limit(wanted * SAMPLED).select(features)
            rows = _matrix([x for _, x in sampled.toPandas().items()])
        else:
            rows = np.empty((0, len(features)))
        tree = Cells(rows, used, wanted)
        self.home = F.pandas_udf(lambda *c: pd.Series(tree.of(_matrix(c))), "int")(*features)
        self.donors = cut_lineage(donors.withColumn("cell", self.home))
        facts = [F.count(F.lit(1)).alias("n")]
        for c in features:
            facts += [F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"), F.count(c).alias(f"n_{c}")]
        boxes = self.donors.groupBy("cell").agg(*facts).orderBy("cell").collect()  # one row per cell
        self.sizes = {r["cell"]: r["n"] for r in boxes}
        of = lambda name: np.array([[np.nan if r[f"{name}_{c}"] is None else r[f"{name}_{c}"] for c in features] for r in boxes], float).reshape(-1, len(features))
        known, n = of("n"), np.array([r["n"] for r in boxes])
        self.boxes = (np.array([r["cell"] for r in boxes], np.int32), np.nan_to_num(of("low")), np.nan_to_num(of("high")), known == n[:, None], known > 0)

    def others(self, radius: Column, home: Column) -> Column:
        """Cells beside ``home`` that may hold a donor within ``radius`` (null: anywhere)."""
        names, low, high, always, ever = self.boxes

        def visit(limit: pd.Series, own: pd.Series, *columns: pd.Series) -> pd.Series:
            rows, reach, out = _matrix(columns), limit.fillna(np.inf).to_numpy(float), []
            for at in range(0, len(rows), BATCH):
                bounds = lower_bounds(rows[at : at + BATCH], low, high, always, ever)
                # rounding may put a bound a little above the distance that it bounds
                near = (bounds * (1 - 1e-9) <= reach[at : at + BATCH, None]) & np.isfinite(bounds)
                near &= names[None] != own.to_numpy()[at : at + BATCH, None]
                out += [names[x] for x in near]
            return pd.Series(out, dtype=object)

        return F.pandas_udf(visit, "array<int>")(radius, home, *self.features)

    def meet(self, queries: DataFrame, k: int, schema: str, counted: dict | None) -> DataFrame:
        """The ``k`` best donors that each query finds in its ``cell``, per block of donors."""
        asked = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect() if r["cell"] in self.sizes}
        if counted is not None:
            counted["pairs"] = counted.get("pairs", 0) + sum(n * self.sizes[c] for c, n in asked.items())
        blocks = [(c, -(-n // QUERY_BLOCK), -(-self.sizes[c] // DONOR_BLOCK)) for c, n in asked.items()]
        blocks = F.broadcast(queries.sparkSession.createDataFrame(blocks, "cell int, q_blocks int, d_blocks int"))  # at most MAX_CELLS rows
        own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = queries.join(blocks, "cell").withColumn("qb", own("query_key", "q_blocks")).withColumn("db", every("d_blocks"))
        d = self.donors.join(blocks, "cell").withColumn("db", own("donor_key", "d_blocks")).withColumn("qb", every("q_blocks"))
        keys = ["cell", "qb", "db"]
        q, d = q.select(*keys, "query_key", *self.features), d.select(*keys, "donor_key", "payload", *self.features)
        return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(_block_best(self.features, k), schema)


def nearest(queries: DataFrame, donors: DataFrame, features: list[str], k: int,
            payload_type: str = "double", counted: dict | None = None) -> DataFrame:
    """``(query_key, rank, distance, donor_key, payload)`` for the ``k`` nearest donors.

    ``queries`` holds ``query_key`` and the features, ``donors`` holds ``donor_key``, the features and ``payload``. A query and
    a donor are as far apart as the coordinates that both have; without any they do not meet. Ties go to the smaller
    key. ``counted`` receives the number of ``pairs`` that were compared.
    """
    number = lambda c: F.nanvl(col(c).cast("double"), F.lit(None)).alias(c)
    queries = queries.select("query_key", *[number(c) for c in features])
    index = CellIndex(queries, donors.select("donor_key", *[number(c) for c in features], "payload"), features)
    key_type = queries.schema["query_key"].dataType.simpleString()
    donor_type = donors.schema["donor_key"].dataType.simpleString()
    schema = f"query_key {key_type}, distance double, donor_key {donor_type}, payload {payload_type}"
    at_home = queries.withColumn("cell", index.home)
    found = index.meet(at_home, k, schema, counted)
    if len(index.sizes) > 1:
        order = Window.partitionBy("query_key").orderBy("distance", "donor_key")
        found = cut_lineage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        proven = found.groupBy("query_key").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_radius"))
        asked = at_home.join(proven, "query_key", "left")
        visits = asked.select("query_key", *features, F.explode(index.others(F.col("_radius"), F.col("cell"))).alias("cell"))
        found = found.unionByName(index.meet(cut_lineage(visits), k, schema, counted))
    order = Window.partitionBy("query_key").orderBy("distance", "donor_key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_features(df: DataFrame, column: str, key: str) -> list[str]:
    """Numeric columns with more than half of their cells present, and the target."""
    numbers = [c for c in df.columns if V.is_numeric(df, c) and c != key]
    shares = df.agg(*[F.avg((~V.is_missing(df, c)).cast("int")).alias(c) for c in numbers]).first()
    return [c for c in numbers if c == column or (shares[c] or 0) > 0.5]


def knn_impute(df: DataFrame, column: str, key: str) -> tuple[DataFrame, int]:
    """Fill gaps with the mean of the ``min(5, max(2, n // 20))`` nearest rows that have a value."""
    features = knn_features(df, column, key)
    k = min(5, max(2, df.count() // 20))
    numbers = [V.as_number(df, c).alias(c) for c in features]
    gap = V.is_missing(df, column)
    queries = df.filter(gap).select(col(key).alias("query_key"), *numbers)
    donors = df.filter(~gap).select(col(key).alias("donor_key"), *numbers, V.as_number(df, column).alias("payload"))
    filled = nearest(queries, donors, features, k).groupBy(F.col("query_key").alias(key)).agg(
        F.avg("payload").alias("_filled")
    )
    mean = df.agg(F.avg(V.as_number(df, column)).alias("m")).scalar()
    value = F.coalesce(V.as_number(df, column), F.col("_filled"), mean)
    joined = df.join(filled, key, "left")
    return joined.select([value.alias(c) if c == column else col(c) for c in df.columns]), k
