"""From hash buckets to bounded verification jobs.

Members that share a bucket are candidates. Writing every candidate pair of a
crowded bucket would grow with its square, so members are first given one *home
block* of bounded size: a hash part of the most crowded bucket they are in. Blocks
that meet in some bucket are verified against each other in *jobs* of one block
and a batch of its guests, all pairs at once. Each pair of members belongs to
exactly one job, so counts from different jobs add up, and what a job returns
grows with its members and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospan.operators.blocks import co_members
from annospan.session import materialise

BLOCK_ROWS = 1024

Verify = Callable[[pa.Table, pa.Table | None], np.ndarray]


def shared_buckets(members: DataFrame) -> DataFrame:
    """(id, weight, bucket, n, w) of the members whose bucket holds another one.

    ``members`` has distinct (id, bucket) rows and the ``weight`` of the id.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).filter("n > 1")
    return members.join(sizes, "bucket")


def home_blocks(shared: DataFrame, block_rows: int, block_weight: int) -> DataFrame:
    """(id, weight, block): a part of the most crowded bucket of each member, of bounded size and weight."""
    best = shared.groupBy("id", "weight").agg(F.max(F.struct("n", "bucket", "w")).alias("b"))
    parts = F.greatest(F.ceil(F.col("b.n") / block_rows), F.ceil(F.col("b.w") / block_weight), F.lit(1))
    return best.select("id", "weight", F.xxhash64("b.bucket", F.pmod(F.xxhash64("id"), parts)).alias("block"))


def block_jobs(shared: DataFrame, homes: DataFrame, block_rows: int, block_weight: int) -> DataFrame:
    """(job, block, side): jobs for all blocks that meet in a bucket, and for each block of two or more.

    The smaller of two blocks that meet is a guest of the larger one. A block takes
    its guests in batches of bounded size, so a crowded block is sent once per
    batch and not once per guest.
    """
    sizes = materialise(homes.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")), "blocks")
    met = shared.select("id", "bucket").join(homes.select("id", "block"), "id").select("bucket", "block").distinct()
    pairs = co_members(met, "bucket", "block").select(F.col("a.block").alias("x"), F.col("b.block").alias("y")).distinct()
    side = lambda c: sizes.select(F.col("block").alias(c), F.struct("n", "block", "w").alias(f"s{c}"))
    sized = pairs.join(side("x"), "x").join(side("y"), "y").select(F.greatest("sx", "sy").alias("host"), F.least("sx", "sy").alias("guest"))
    hosted = materialise(sized.select(F.col("host.block").alias("host"), F.col("guest.block").alias("guest"), "guest.n", "guest.w"), "guests")
    room = hosted.groupBy("host").agg(
        F.greatest(F.ceil(F.sum("n") / block_rows), F.ceil(F.sum("w") / block_weight), F.lit(1)).alias("batches")
    )
    guests = hosted.join(room, "host").select(
        F.xxhash64("host", F.pmod(F.xxhash64("guest"), F.col("batches"))).alias("job"), F.col("guest").alias("block"), "host"
    )
    hosts = guests.select("job", F.col("host").alias("block")).distinct().withColumn("side", F.lit(0))
    inside = sizes.filter("n > 1").select(F.xxhash64("block", F.lit("own")).alias("job"), "block", F.lit(0).alias("side"))
    return hosts.unionByName(guests.select("job", "block", F.lit(1).alias("side"))).unionByName(inside)


def local_roots(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Smallest id reachable over the symmetric matrix ``linked``."""
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == root).all():
            return root
        root = low


def summarise(ids: np.ndarray, copies: np.ndarray, left: int, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, roots) of the members with a link; ``matrix`` is square inside a block, left x right across two."""
    n = len(ids)
    if left == n:
        linked = matrix.copy()
        np.fill_diagonal(linked, False)
    else:
        linked = np.zeros((n, n), dtype=bool)
        linked[:left, left:] = matrix
        linked[left:, :left] = matrix.T
    links = linked @ copies
    roots = local_roots(ids, linked)
    hit = links > 0
    return ids[hit], links[hit], roots[hit]


def run_jobs(payload: DataFrame, jobs: DataFrame, homes: DataFrame, verify: Verify) -> DataFrame:
    """(id, links, root) per job and member: copies of linked members, and the smallest member reached in the job.

    ``payload`` has one row per id (a repeated id counts once) with ``copies`` and
    whatever ``verify(left, right)`` needs; it returns the boolean matrix of links
    (``right`` is None inside a block). Rows arrive sorted by job and are held one
    job at a time.
    """
    rows = payload.join(homes.select("id", "block"), "id").join(jobs, "block").drop("block")
    sorted_rows = rows.repartition("job").sortWithinPartitions("job", "side", "id")

    def judged(table: pa.Table) -> tuple[np.ndarray, ...] | None:
        ids = table.column("id").to_numpy()
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        if not first.all():
            table, ids = table.filter(pa.array(first)), ids[first]
        left = int((table.column("side").to_numpy() == 0).sum())
        if len(ids) < 2:
            return None
        matrix = verify(table.slice(0, left), None if left == len(ids) else table.slice(left))
        if not matrix.any():
            return None
        return summarise(ids, table.column("copies").to_numpy().astype(np.int64), left, matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 3
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["id", "links", "root"])

        def close() -> None:
            if held and (result := judged(pa.Table.from_batches(held))):
                found.append(result)
            held.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            job = batch.column("job").to_numpy()
            cuts = [0, *(np.flatnonzero(job[1:] != job[:-1]) + 1).tolist(), len(job)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[-1].column("job")[0].as_py() != job[a]:
                    close()
                held.append(batch.slice(a, b - a))
            if len(found) > 2000:
                yield flush()
        close()
        yield flush()

    return sorted_rows.mapInArrow(run, "id long, links long, root long")


def linked_members(members: DataFrame, payload_of: Callable[[DataFrame], DataFrame], verify: Verify, block_weight: int, block_rows: int | None = None) -> DataFrame:
    """``run_jobs`` over all candidates of ``members``; ``payload_of(homes)`` builds their payload."""
    block_rows = block_rows or BLOCK_ROWS
    shared = materialise(shared_buckets(members), "buckets")
    homes = materialise(home_blocks(shared, block_rows, block_weight), "homes")
    jobs = materialise(block_jobs(shared, homes, block_rows, block_weight), "jobs")
    return materialise(run_jobs(payload_of(homes), jobs, homes, verify), "links")
