"""Exact top-k by inner product: a Voronoi join of queries and candidates.

Vectors are integers, so scores are exact.  Candidates go to the cell of their
nearest pivot.  Cells are summarised (size, radius, spread of norms).  A query first
solves its most promising cells; their k-th score is a floor.  Then it is sent to
just those cells whose bound q.p + |q| r (Cauchy-Schwarz around the pivot) reaches
the floor, and what the cells return is merged.  A cell is cut into blocks of
bounded size, so a vector that a third of all rows repeat fills many blocks and no
single task; the queries of a cell are cut too, and only cells with more than
QUERY_ROWS queries have their candidates sent more than once.  Pivots grow with the
square root of the rows, up to what may be broadcast.

Edge cases: vectors that are null, empty, or hold null or non-finite components take
no part, neither as query nor as candidate; a query never meets its own id; ties go
to the smaller id; fewer candidates than k give what there is; vectors of another
length than most are matched only with their like; an empty table gives no rows;
scores that could pass 63 bits raise an error.
"""
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import durable

#: Rows of a block at most, but for the rounding of salts.
BLOCK_ROWS = 4000
#: Queries of a block at most, likewise.
QUERY_ROWS = 16_000
#: Pivots: at least, at most, and at most in bytes of a broadcast.
MIN_PIVOTS, MAX_PIVOTS, PIVOT_BYTES = 64, 16_384, 64 << 20
#: Entries of a matrix of distances or bounds that a task holds at once.
MATRIX = 4_000_000
RESULT = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>, dim) with v = floor(scale * component); rows that cannot be are left out."""
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(sound & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"), F.size(x).alias("dim"))


def pivot_count(n: int, dim: int) -> int:
    """About the square root of the rows, within the bounds of a broadcast."""
    return max(1, min(max(MIN_PIVOTS, int(n**0.5)), MAX_PIVOTS, PIVOT_BYTES // (8 * max(dim, 1))))


def top_k_by_inner_product(vectors: DataFrame, is_query, k: int = 10, max_pivots: int | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which ``is_query``, its k best other rows of ``quantized`` vectors."""
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n = size["n"]
    max_pivots = max_pivots or pivot_count(n, size["dim"] or 1)
    share = max_pivots / max(n, 1)
    picked = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share * (1 << 30)).select("dim", "v").limit(4 * max_pivots).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in picked}:
        pivots[dim] = np.unique(np.array([r["v"] for r in picked if r["dim"] == dim], np.float64), axis=0)
    shared = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, gap double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vs in batches:
            cell, gap = np.zeros(len(vs), np.int32), np.zeros(len(vs))
            dims = np.array([len(v) for v in vs])
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                p = shared.value.get(dim, np.zeros((1, dim)))
                step = max(1, MATRIX // len(p))
                for some in (at[i:i + step] for i in range(0, len(at), step)):
                    x = np.stack(vs.iloc[some].to_numpy()).astype(np.float64)
                    away = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)
                    cell[some] = away.argmin(1)
                    gap[some] = np.sqrt(np.maximum(away.min(1), 0))
            yield pd.DataFrame({"cell": cell, "gap": gap})

    dealt = durable(vectors.withColumn("_n", nearest("v")).select("vec_id", "dim", "v", "_n.cell", "_n.gap"))
    # Bounded by the pivots: one row for each (dim, cell).
    cells = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()
    summary = spark.sparkContext.broadcast({(r["dim"], r["cell"]): (r["n"], r["radius"] * (1 + 1e-9) + 1e-3, max(1, -(-r["n"] // block_rows))) for r in cells})

    def sent(part: pd.DataFrame, first: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        """(queries, places of queries, their cells): at first the cells with the best bound that hold more than k rows, then all others that reach the floor."""
        for dim, rows in part.groupby("dim"):
            own = np.array(sorted(c for d, c in summary.value if d == dim))
            p = shared.value.get(dim, np.zeros((1, int(dim))))[own]
            sizes, radius = (np.array([summary.value[dim, c][i] for c in own]) for i in (0, 1))
            step = max(1, MATRIX // len(own))
            for some in (rows.iloc[i:i + step] for i in range(0, len(rows), step)):
                q = np.stack(some["v"].to_numpy()).astype(np.float64)
                upper = q @ p.T + np.sqrt((q**2).sum(1))[:, None] * radius
                order = np.argsort(-upper, axis=1)
                enough = np.cumsum(sizes[order], axis=1)
                start = np.zeros(upper.shape, bool)
                np.put_along_axis(start, order, (enough - sizes[order]) <= k, axis=1)
                who, where = np.nonzero(start if first else ~start & (upper >= some["floor"].to_numpy(dtype=np.float64)[:, None]))
                yield some, who, own[where]

    def counter(first: bool):
        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for some, _, cells_of in sent(batch, first):
                    found, times = np.unique(cells_of, return_counts=True)
                    yield pd.DataFrame({"dim": np.int32(some["dim"].iloc[0]), "cell": found.astype(np.int32), "n": times.astype(np.int64)})

        return counted

    def router(first: bool, parts):
        def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A row for each block that a query goes to."""
            for batch in batches:
                for some, who, cells_of in sent(batch, first):
                    dim = some["dim"].iloc[0]
                    n_blocks = np.array([summary.value[dim, c][2] for c in cells_of], dtype=np.int64)
                    rows = np.repeat(np.arange(len(who)), n_blocks)
                    salt = np.arange(len(rows)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
                    # Every block of a cell meets the same share of its queries.
                    share_of = np.array([parts.value.get((dim, c), 1) for c in cells_of], dtype=np.int64)
                    draw = (some["vec_id"].to_numpy(dtype=np.int64)[who] % 2_147_483_647 * 2_654_435_761 >> 16) % share_of
                    out = some.iloc[who[rows]]
                    yield pd.DataFrame({"dim": dim, "cell": cells_of[rows].astype(np.int32), "salt": salt.astype(np.int32), "part": draw[rows].astype(np.int32), "query_id": out["vec_id"].to_numpy(), "q": out["v"].to_numpy()})

        return routed

    blocks = spark.sparkContext.broadcast({key: v[2] for key, v in summary.value.items()})

    @F.pandas_udf("int")
    def salt_of(dim: pd.Series, cell: pd.Series, draw: pd.Series) -> pd.Series:
        return pd.Series([x % blocks.value[d, c] for d, c, x in zip(dim, cell, draw, strict=True)], dtype="int32")

    candidates = dealt.select("dim", "cell", salt_of("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31))).alias("salt"), "vec_id", "v")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Top k of each query in one block; blocks of queries keep the score matrix small."""
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        right = right.sort_values("vec_id")
        ids, whole, out = right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()).astype(np.int64), []
        x = whole.astype(np.float64)
        for at in range(0, len(left), 256):
            part = left.iloc[at:at + 256]
            q = np.stack(part["q"].to_numpy()).astype(np.int64)
            most = np.abs(q.astype(np.float64)).max() * np.abs(x).max() * x.shape[1]
            if most >= 2**62:
                raise ValueError("inner products could pass 63 bits")
            # Integers this size are exact in float64 products; beyond, integer arithmetic takes over.
            scores = q.astype(np.float64) @ x.T if most < 2**52 else q @ whole.T
            for who, row in zip(part["query_id"], scores, strict=True):
                row = np.where(ids == who, -np.inf, row) if row.dtype == np.float64 else np.where(ids == who, np.iinfo(np.int64).min, row)
                take = min(k, len(row))
                least = np.partition(row, len(row) - take)[len(row) - take]
                best = np.flatnonzero(row >= least)
                best = best[np.lexsort((ids[best], -row[best]))][:take]
                best = best[ids[best] != who]
                out.append(pd.DataFrame({"query_id": who, "vec_id": ids[best], "score": row[best].astype(np.int64)}))
        return pd.concat(out)

    keys = ["dim", "cell", "salt", "part"]
    routed_schema = "dim int, cell int, salt int, part int, query_id long, q array<long>"

    def solved(asked: DataFrame, first: bool) -> DataFrame:
        # Bounded by the pivots: one number for each cell that queries go to.
        counts = asked.mapInPandas(counter(first), "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > query_rows).collect()
        parts = spark.sparkContext.broadcast({(r["dim"], r["cell"]): -(-r["n"] // query_rows) for r in counts})
        held = candidates.withColumn("part", F.lit(0))
        if counts:
            busy = F.broadcast(spark.createDataFrame([(d, c, n) for (d, c), n in parts.value.items()], "dim int, cell int, _parts int"))
            held = candidates.join(busy, ["dim", "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        sent_rows = asked.mapInPandas(router(first, parts), routed_schema)
        return sent_rows.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda l, r: solve(l, r), RESULT)

    queries = dealt.where(is_query).select("vec_id", "dim", "v")
    early = durable(solved(queries, True))
    ranked = early.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    floors = ranked.where(F.col("_r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    waiting = queries.join(floors, "vec_id", "left").fillna(-(1 << 62), ["floor"])
    late = solved(waiting, False)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return early.unionByName(late).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
