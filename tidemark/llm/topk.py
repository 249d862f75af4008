"""Exact top-k search by inner product, pruned by segment statistics from coarse to fine.

A vector is cut into segments, and each segment is kept as its mean m and standard deviation s. For a segment of n
components Cauchy-Schwarz bounds the inner product of q and x by n * (m_q * m_x + s_q * s_x), which is the lower bound
of the distance |q|^2 + |x|^2 - 2 q.x turned round. The sum over segments is a dot product of short feature vectors: a
block of queries is compared with a block of rows by one small matrix product over a few long segments; only the pairs
that this leaves meet the bound over more, shorter segments; and only the pairs that both leave are scored exactly.

Scores are integers of any size: where doubles can't hold them, they rank the rows up to their error, and Python's
integers decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Segments of each resolution; a vector with fewer components has segments of one component.
RESOLUTIONS = (4, 16)
#: Vectors in a block: bounds memory to a few matrices of so many rows and queries.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
SCALE = 256.0
#: Bytes of row blocks that are broadcast for floors; salts that the pairs of blocks of one length are dealt by.
SEED_BYTES, SALTS = 32 << 20, 64
#: The highest score that a long holds; the lowest is less by as much.
MOST = (1 << 63) - 1
_TURNED = str.maketrans("0123456789abcdef", "fedcba9876543210")


def quantised(flat: np.ndarray) -> np.ndarray:
    """floor(256 x) / 256 of components given as doubles: exact, and finite for all of these."""
    with np.errstate(over="ignore"):
        scaled = SCALE * flat
    return np.where(np.isfinite(scaled), np.floor(scaled) / SCALE, flat)


def whole(x: float) -> int:
    """256 x of a quantised component."""
    return int(x * SCALE) if abs(x) < 1e300 else int(x) * int(SCALE)


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * mean and sqrt(n) * deviation of each segment: their dot product bounds the inner product from above."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    n = np.diff(edges).astype(float)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    return np.hstack([total / np.sqrt(n), np.sqrt(np.maximum(square - total * total / n, 0))])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _power(x: np.ndarray) -> int:
    """The least power of two above all components."""
    return int(np.frexp(np.abs(x).max(initial=0))[1])


#: What a bound in doubles may be wrong by, for vectors of length 1.
SLACK = 1e-9


def search_block(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, row_keys: np.ndarray, query_keys: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(query, places of its best rows, scores) of a block of quantised vectors. floors: a score that k other rows are
    known to reach.

    Keys tell rows apart: a query is no candidate of its own, even where other rows share its id.
    """
    q_power, x_power = _power(queries), _power(rows)
    q, x = np.ldexp(queries, -q_power), np.ldexp(rows, -x_power)  # so that no product overflows
    floor = np.ldexp(np.ldexp(floors, -q_power - 8), -x_power - 8)
    q_size, x_size = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    exact = q_power + x_power + 16 + rows.shape[1].bit_length() < 52  # then all sums are whole numbers in doubles
    usable = [n for n in RESOLUTIONS if n < rows.shape[1]]
    if usable:
        alive = features(q, usable[0]) @ features(x, usable[0]).T >= floor[:, None] - SLACK * (q_size[:, None] * x_size + np.abs(floor)[:, None])
    fine = [(features(q, n), features(x, n)) for n in usable[1:]]
    for i in range(len(q)):
        at = np.flatnonzero(alive[i]) if usable else np.arange(len(x))
        at = at[row_keys[at] != query_keys[i]]
        for of_queries, of_rows in fine:
            at = at[of_rows[at] @ of_queries[i] >= floor[i] - SLACK * (q_size[i] * x_size[at] + abs(floor[i]))]
        if not len(at):
            continue
        if exact:
            scores = np.rint(rows[at] @ queries[i] * SCALE * SCALE).astype(np.int64)
            ok = scores >= floors[i]
            at, scores = at[ok], scores[ok]
            top = best(scores, row_ids[at], k)
            yield i, at[top], scores[top].tolist()
        else:
            near, wrong = x[at] @ q[i], SLACK * q_size[i] * x_size[at]
            if len(at) > k:  # rows that can't be among the k highest, whatever the doubles are wrong by
                reached = np.partition(near - wrong, len(at) - k)[len(at) - k]
                at = at[near + wrong >= reached]
            own = [whole(c) for c in queries[i].tolist()]
            found = sorted((-sum(a * whole(b) for a, b in zip(own, rows[r].tolist(), strict=True)), int(row_ids[r]), r) for r in at.tolist())[:k]
            yield i, np.array([r for *_, r in found]), [-s for s, *_ in found]


def _beyond(score: int) -> str | None:
    """Beyond 64 bits: a text that sorts as the score does."""
    if abs(score) < MOST:
        return None
    digits = f"{abs(score):x}"
    text = f"{len(digits):06d}{digits}"
    return "1" + text if score > 0 else "0" + text.translate(_TURNED)


_BLOCK = "dim int, block long, ids binary, keys binary, rows binary"


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors of equal length packed into blocks: a row for up to `size` of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal n
            ids, keys, flat = zip(*held.pop(dim), strict=True)
            n += 1
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": pa.array([(part << 32) + n], pa.int64()), "ids": [np.array(ids, "<i8").tobytes()], "keys": [np.array(keys, "<i8").tobytes()], "rows": [np.stack(flat).astype("<f8").tobytes()]})

        for batch in batches:
            for i, key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = quantised(np.asarray(v.values, np.float64))
                held.setdefault(len(x), []).append((i, key, x))
                if len(held[len(x)]) >= size:
                    yield out(len(x))
        for dim in list(held):
            yield out(dim)

    return vectors.mapInArrow(pack, _BLOCK)


def _unpack(dim: int, ids: bytes, keys: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(keys, "<i8"), np.frombuffer(rows, "<f8").reshape(-1, dim)


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k rows with the highest integer inner product for each query.

    Queries are the rows whose id is divisible by `every`; candidates are all other rows with as many components.
    Vectors that are null, empty or hold a null or non-finite component, and rows with a null id, take no part. Rows
    that share an id are separate rows, and a query's results are told apart by id alone: of rows with one id each
    counts. Scores are exact whole numbers, and rank as such; one beyond 64 bits is shown as the highest or lowest
    long (2**63 - 1, or less that many). Fewer than k candidates: all of them. An empty table gives an empty result.

    Rows and queries are packed into blocks; each row block meets each query block. Floors to prune with come from an
    exact search of every query in one block of rows, so a pair is only scored where its bounds leave it a chance; each
    pair of blocks gives k rows for each query at most, which Spark merges.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # In double arithmetic x - x is 0 for finite x only.
    v = v.where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) <= 1.7976931348623157E308D)")
    v = v.select("id", F.monotonically_increasing_id().alias("key"), "v")
    # Blocks are written, so that the keys stay the same for queries and rows.
    kept = written(v, "vectors")
    rows = written(_blocks(kept, BLOCK_ROWS), "vector-blocks")
    queries = _blocks(kept.where(F.col("id") % every == 0), BLOCK_QUERIES).withColumnsRenamed({"block": "q_block", "ids": "q_ids", "keys": "q_keys", "rows": "q_rows"})
    result = "query_key long, query_id long, vec_id long, row_key long, score long, beyond string"
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    # One row block of each length gives every query a floor: the k-th score there. Such blocks go to every worker where
    # they are few, else to salted copies of their length.
    seeds = rows.groupBy("dim").agg(F.min_by(F.struct("ids", "keys", "rows"), "block").alias("s")).select("dim", "s.*")
    if (rows.groupBy("dim").agg(F.max(F.length("rows")).alias("n")).agg(F.sum("n")).first()[0] or 0) <= SEED_BYTES:
        seeded = queries.join(F.broadcast(seeds), "dim")
    else:
        seeds = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        seeded = queries.withColumn("salt", F.pmod(F.xxhash64("q_block"), F.lit(SALTS)).cast("int")).join(seeds, ["dim", "salt"])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q_keys, q = _unpack(r["dim"], r["q_ids"], r["q_keys"], r["q_rows"])
                ids, keys, x = _unpack(r["dim"], r["ids"], r["keys"], r["rows"])
                floors = np.full(len(q), -np.inf)
                for i, _, scores in search_block(q, q_ids, floors.copy(), x, ids, keys, q_keys, k):
                    if len(scores) == k and abs(scores[-1]) < 1 << 1000:
                        floors[i] = scores[-1] if abs(scores[-1]) < 1 << 53 else np.nextafter(float(scores[-1]), -np.inf)
                yield pa.RecordBatch.from_pydict({"dim": pa.array([r["dim"]], pa.int32()), "q_block": [r["q_block"]], "q_ids": [r["q_ids"]], "q_keys": [r["q_keys"]], "q_rows": [r["q_rows"]], "floors": [floors.astype("<f8").tobytes()]})

    floored = seeded.select("dim", "q_block", "q_ids", "q_keys", "q_rows", "ids", "keys", "rows").mapInArrow(seed, "dim int, q_block long, q_ids binary, q_keys binary, q_rows binary, floors binary")
    floored = written(floored, "query-blocks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q_keys, q = _unpack(r["dim"], r["q_ids"], r["q_keys"], r["q_rows"])
                ids, keys, x = _unpack(r["dim"], r["ids"], r["keys"], r["rows"])
                out: list[list] = [[], [], [], [], [], []]
                for i, at, scores in search_block(q, q_ids, np.frombuffer(r["floors"], "<f8"), x, ids, keys, q_keys, k):
                    shown = [max(-MOST, min(MOST, s)) for s in scores]
                    for c, a in zip(out, ([int(q_keys[i])] * len(at), [int(q_ids[i])] * len(at), ids[at].tolist(), keys[at].tolist(), shown, map(_beyond, scores)), strict=True):
                        c.extend(a)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(out[5], pa.string())], ["query_key", "query_id", "vec_id", "row_key", "score", "beyond"])

    # Each block pair is a row of its own, so that the pairs are dealt over all cores. All query blocks of a length
    # meet all of its row blocks: a stated set of queries against all rows. Row blocks are salted, since all vectors may
    # have one length.
    salted = rows.select("dim", "block", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    every_salt = floored.select("dim", "q_block", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = salted.join(every_salt, ["dim", "salt"]).drop("salt").repartition(spread, "block", "q_block")
    pairs = pairs.join(rows, ["dim", "block"]).join(floored, ["dim", "q_block"])
    pairs = pairs.select("dim", "q_ids", "q_keys", "q_rows", "floors", "ids", "keys", "rows")
    found = pairs.mapInArrow(search, result)
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), F.desc("beyond"), "vec_id", "row_key")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")
