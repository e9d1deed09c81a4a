"""Minimum-cost-flow resharding.

Old shards are sources of bytes, new shards are sinks with capacities. Leaving a byte where it
is costs nothing, moving one costs 1 (or a given price), and the cheapest flow is the set of
transfers that moves the fewest bytes. Documents of an old shard are hashed into a fixed number
of blocks, which are dealt to the flow's transfers, large ones first. The driver sees only
shard and block sizes, both bounded by the two parameters, never documents.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table

OLD_SHARDS, NEW_SHARDS = 32, 40
#: Blocks of an old shard. The block table has OLD_SHARDS * BLOCKS rows at most, whatever the input.
BLOCKS = 2048
#: Bytes that a row is charged besides its text.
ROW_BYTES = 16
ROWS_PER_FILE = 20_000


def min_cost_flow(supply: list[int], capacity: list[int], price=None) -> dict[tuple[int, int], int]:
    """Cheapest transfers {(i, j): bytes} that place all supply within capacity.

    price(i, j) is the cost of a byte sent from old shard i to new shard j; by default 0 where
    i == j and 1 elsewhere. Successive shortest paths on the residual graph, shards x shards.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than the sizes")
    price = price or (lambda i, j: int(i != j))
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, left, cost; the reverse of e is e ^ 1
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, most: int, cost: int) -> None:
        out[a].append(len(edges))
        edges.append([b, most, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, price(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    while True:
        dist: list[float] = [float("inf")] * len(out)
        came, queue, waiting = [-1] * len(out), deque([source]), [False] * len(out)
        dist[source] = 0
        while queue:
            a = queue.popleft()
            waiting[a] = False
            for e in out[a]:
                b, left, cost = edges[e]
                if left > 0 and dist[a] + cost < dist[b]:
                    dist[b], came[b] = dist[a] + cost, e
                    if not waiting[b]:
                        waiting[b] = True
                        queue.append(b)
        if came[sink] < 0:
            break
        path, at = [], sink
        while at != source:
            path.append(came[at])
            at = edges[came[at] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    return {(i, edges[e][0] - n): edges[e ^ 1][1] for i in range(n) for e in out[i] if e % 2 == 0 and edges[e ^ 1][1] > 0}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def place_blocks(blocks: list[tuple[int, int, int, int]], flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, block, bytes, rows) and the flow -> (old, block, shard, base): base is the block's first slot in its shard.

    Large blocks are placed first, each where most of its old shard's flow is still open, so that
    the small ones even out what the large ones leave.
    """
    open_flow: dict[int, dict[int, int]] = {}
    need: dict[int, int] = {}
    for (i, j), amount in flow.items():
        open_flow.setdefault(i, {})[j] = amount
        need[j] = need.get(j, 0) + amount
    where = {}
    for i, b, size, _ in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        ways = open_flow[i]
        j = max(ways, key=lambda j: (min(ways[j], need[j]), j == i, -j))
        ways[j] -= size
        need[j] -= size
        where[i, b] = j
    placed, slots = [], {}
    for i, b, _, rows in sorted(blocks):
        shard = where[i, b]
        placed.append((i, b, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + rows
    return placed


def with_blocks(docs: DataFrame, *, id_col: str, text_col: str, old=None, old_shards: int = OLD_SHARDS) -> DataFrame:
    """docs with __size, __old and __block. old: the column expression of the present shard; by default a hash of the id."""
    key = F.xxhash64(F.col(id_col))
    return (
        docs.withColumn("__size", F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + ROW_BYTES)
        .withColumn("__old", (F.pmod(key, F.lit(old_shards)) if old is None else old).cast("int"))
        .withColumn("__block", F.pmod(F.xxhash64(F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")))), F.lit(BLOCKS)).cast("int"))
    )


def reshard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = NEW_SHARDS, capacities: list[int] | None = None, old=None, old_shards: int = OLD_SHARDS) -> tuple[DataFrame, set[int], dict[tuple[int, int], int]]:
    """(docs with `shard` and `slot`, the shards whose files change, the flow of bytes).

    Null id or text is a value like any other (size ROW_BYTES for a null text). Equal rows are
    interchangeable. An empty table gives no rows and no flow. Columns of docs named shard or
    slot are replaced.
    """
    spark = docs.sparkSession
    blocked = with_blocks(docs.drop("shard", "slot"), id_col=id_col, text_col=text_col, old=old, old_shards=old_shards)
    # At most old_shards * BLOCKS rows, by construction.
    blocks = [tuple(r) for r in blocked.groupBy("__old", "__block").agg(F.sum("__size"), F.count("*")).collect()]
    supply = [0] * old_shards
    for i, _, size, _ in blocks:
        supply[i] += size
    flow = min_cost_flow(supply, capacities or even_capacities(sum(supply), shards))
    placed = spark.createDataFrame(place_blocks(blocks, flow), "__old int, __block int, shard int, __base long")
    affected = {j for i, j in flow if i != j} | {i for i, j in flow if i != j}
    in_block = Window.partitionBy("shard", "__part", "__old", "__block").orderBy(id_col, "__size", F.crc32(F.coalesce(F.col(text_col), F.lit(""))))
    out = (
        blocked.join(F.broadcast(placed), ["__old", "__block"])
        .withColumn("__part", F.floor(F.col("__base") / ROWS_PER_FILE))
        # One shuffle serves the slots and the files: blocks of a shard lie together in parts of bounded length.
        .repartition("shard", "__part")
        .withColumn("slot", F.col("__base") + F.row_number().over(in_block) - 1)
    )
    return out.drop("__old", "__block", "__base", "__part", "__size"), {s for s in affected if s < shards}, flow


def rewrite(resharded: DataFrame, affected: set[int], path: str) -> None:
    """Writes the files of the affected shards under path/shard=N; the files of other shards stay as they are."""
    resharded.where(F.col("shard").isin(sorted(affected))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def rewritten(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `shard` and `slot` after resharding, read back from the rewritten shard files."""
    spark = docs.sparkSession
    out, affected, flow = reshard(docs, id_col=id_col, text_col=text_col)
    path = scratch(spark, "shards")
    rewrite(out, affected | {j for _, j in flow}, path)
    return spark.read.schema(out.schema).parquet(path) if flow else out


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents moved from 32 hash shards to 40 of near equal bytes; rows are read back from the shard files."""
    return rewritten(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
