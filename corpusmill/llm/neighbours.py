"""The most similar vectors of every vector.

A block matrix join.  Vectors are written once as blocks, quantised to int8 with the exact
quantisation error of each; every pair of blocks is one product tile of the codes, whose entries
with the error bounds say which pairs can still be among the k best.  Only these are recomputed
from the stored floats in double precision, and the candidates of the tiles are merged.  The
result is exact.  The tiles grow with the square of the collection, what is shuffled with the
collection times the number of strips of tiles.

Workers read the blocks from the shared folder by themselves where they can open it (local and
mounted folders, and object stores whose scheme they know); elsewhere Spark brings the two blocks
of every tile together, which shuffles each block once for every other one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.session import scratch_path

#: Most vectors of a block; a tile is worked off in bands of so many rows, to bound memory.
BLOCK = 16_384
BAND = 1_024
#: Least vectors of a block, where a smaller collection is spread over more tasks.
LEAST_BLOCK = 4_096
#: Blocks on the right of a strip at most, which one task compares with the block on the left.
STRIP = 8
#: Schemes of shared folders under the names the workers' file systems have for them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gcs": "gs"}
#: Cosines that differ by less count as equal.
TIE = 1e-6
#: Slack for sums in single precision.
SINGLE = 4e-6

_BLOCK_SCHEMA = "row long, n int, ids array<string>, vector binary, code binary, scale float, error float, kth float"


def _usable(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the usable rows, and their vectors: ``dim`` finite values, not all zero."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1]
    values = column.values
    holes = np.asarray(values.is_null()) if values.null_count else None
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False) if holes is not None else values.to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dim)
    if not len(right):
        return right, np.zeros((0, dim), np.float32)
    picked = flat[starts[right][:, None] + np.arange(dim)].astype(np.float32, copy=False)
    good = np.isfinite(picked).all(1) & picked.any(1)
    return right[good], picked[good]


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square over- or underflows."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _kth(similar: np.ndarray, weights: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of the k-th best of each row; ``own`` further copies count with cosine 1."""
    width = similar.shape[1]
    out = np.full(len(similar), -2.0, np.float32)
    if width:
        best = min(k, width)
        top = np.argpartition(similar, width - best, axis=1)[:, width - best :]
        values = np.take_along_axis(similar, top, 1)
        order = np.argsort(-values, axis=1)
        values, counts = np.take_along_axis(values, order, 1), weights[np.take_along_axis(top, order, 1)]
        reached = own[:, None] + np.cumsum(counts, axis=1) >= k
        some = reached.any(1)
        out[some] = values[np.flatnonzero(some), reached.argmax(1)[some]]
    out[own >= k] = 1.0
    return out


def local_uri(path: str) -> str:
    """The path of a shared folder as the workers' file systems know it; mounts become folders."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return path
    if scheme == "dbfs":
        return "file:///dbfs/" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


_COLUMNS = ["row", "n", "vector", "code", "scale", "error", "kth"]


def _read_block(path: str) -> pa.Table:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(local_uri(path))
    return pq.read_table(inner, filesystem=system, columns=_COLUMNS)


class _Block:
    """A block in a worker."""

    def __init__(self, stored: pa.Table, dim: int) -> None:
        stored = stored.combine_chunks()
        bytes_of = lambda name, kind: np.frombuffer(b"".join(stored[name].to_pylist()), kind)
        self.row, self.n = stored["row"].to_numpy(), stored["n"].to_numpy().astype(np.int64)
        size = len(self.row)
        self.unit = _unit(bytes_of("vector", np.float32).reshape(size, dim)) if size else np.zeros((0, dim))
        self.code = bytes_of("code", np.int8).reshape(size, dim).astype(np.float32)
        self.scale, self.error = stored["scale"].to_numpy(), stored["error"].to_numpy()
        self.kth = stored["kth"].to_numpy().copy()


def write_blocks(chunks: DataFrame, id: str, vector: str, dim: int, k: int) -> str:
    """The usable vectors as block files in the shared folder; the path.

    Equal vectors of a block become one row with all their ids, so that a group of copies cannot
    blow up the tiles.  ``kth`` is what the block alone offers as k-th best: the bound that a
    pair with another block has to beat.  Nothing is shuffled: small input partitions are read
    together, so that blocks are full however the input is cut, but for a small collection,
    which is spread over the cores.
    """
    spark = chunks.sparkSession
    path = scratch_path(spark, "vector-blocks")
    picked = chunks.where(F.col(id).isNotNull() & (F.size(vector) == dim)).select(F.col(id).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    rows = chunks.count()
    picked = picked.coalesce(max(1, -(-rows // BLOCK), min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_BLOCK))))

    def block(first: int, ids: list[list[str]], vectors: np.ndarray) -> pa.RecordBatch:
        n = np.array([len(i) for i in ids], np.int32)
        unit = _unit(vectors)
        scale = np.abs(unit).max(1) / 127
        code = np.rint(unit / scale[:, None]).astype(np.int8)
        error = np.linalg.norm(unit - code * scale[:, None], axis=1)
        single = unit.astype(np.float32)
        kth = np.empty(len(ids), np.float32)
        for start in range(0, len(ids), BAND):
            band = single[start : start + BAND] @ single.T
            here = np.arange(len(band))
            band[here, start + here] = -2
            kth[start : start + BAND] = _kth(band, n, n[start : start + BAND] - 1, k)
        return pa.RecordBatch.from_pydict(
            {
                "row": pa.array(first + np.arange(len(ids)), pa.int64()), "n": pa.array(n, pa.int32()), "ids": pa.array(ids, pa.list_(pa.string())),
                "vector": pa.array([v.tobytes() for v in vectors], pa.binary()), "code": pa.array([c.tobytes() for c in code], pa.binary()),
                "scale": pa.array(scale, pa.float32()), "error": pa.array(error * 1.0001, pa.float32()), "kth": pa.array(kth - SINGLE, pa.float32()),
            }
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {}
        ids: list[list[str]] = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            where, usable = _usable(batch.column(1), dim)
            names = batch.column(0).take(pa.array(where)).to_pylist()
            for name, v in zip(names, usable, strict=True):
                raw = v.tobytes()
                at = known.get(raw)
                if at is None:
                    if len(ids) == BLOCK:
                        yield block((task << 40) + (number << 20), ids, np.stack(vectors))
                        number, known, ids, vectors = number + 1, {}, [], []
                    known[raw] = len(ids)
                    ids.append([name])
                    vectors.append(v)
                else:
                    ids[at].append(name)
        if ids:
            yield block((task << 40) + (number << 20), ids, np.stack(vectors))

    picked.mapInArrow(blocks, _BLOCK_SCHEMA).write.option("maxRecordsPerFile", BLOCK).option("compression", "uncompressed").parquet(path)
    return path


def _exact(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs in double precision."""
    out = np.empty(len(i))
    for s in range(0, len(i), 4096):
        out[s : s + 4096] = np.einsum("ij,ij->i", left[i[s : s + 4096]], right[j[s : s + 4096]])
    return out


def _best(rows: np.ndarray, others: np.ndarray, s: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Indices of the entries within the k best of their row (by copies), near ties included."""
    if not len(rows):
        return np.zeros(0, np.int64)
    order = np.lexsort((others, -s, rows))
    rows, s, n = rows[order], s[order], n[order]
    first = np.r_[True, rows[1:] != rows[:-1]]
    start = np.flatnonzero(first)
    total = np.cumsum(n)
    before = total - n - np.repeat((total - n)[start], np.diff(np.r_[start, len(rows)]))
    bound = np.minimum.reduceat(np.where(before < k, s, 9.0), start)
    return order[s >= np.repeat(bound, np.diff(np.r_[start, len(rows)])) - TIE]


def _strip(left: _Block, rights: Iterator[_Block], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Candidates ``(a, b, cosine, copies of b)`` of one strip, both ways; ``left`` itself may be among ``rights``."""
    if not len(left.row):
        return
    bound = left.kth.copy()
    kept: list[tuple[np.ndarray, ...]] = []
    for right in rights:
        same = right is left
        if not len(right.row):
            continue
        slack_right = right.error + SINGLE
        towards_right: list[tuple[np.ndarray, ...]] = []
        for start in range(0, len(left.row), BAND):
            rows = slice(start, start + BAND)
            tile = left.code[rows] @ right.code.T
            tile *= left.scale[rows, None]
            tile *= right.scale
            tile += slack_right
            # error of both sides: ea * |b| + |a coded| * eb, with |a coded| <= 1 + ea and codes of unit vectors
            tile += (left.error[rows] * (1 + slack_right.max()))[:, None]
            if same:
                here = np.arange(len(tile))
                tile[here, start + here] = -9
            least = bound[rows, None] if same else np.minimum(bound[rows, None], right.kth)
            i, j = np.divmod(np.flatnonzero(tile >= least - TIE), tile.shape[1])
            exact = _exact(left.unit, right.unit, i + start, j)
            kept.append((i + start, right.row[j], exact, right.n[j]))
            if not same:
                back = exact >= right.kth[j] - TIE
                towards_right.append((j[back], left.row[i[back] + start], exact[back], left.n[i[back] + start]))
        a, b, s, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        if same and (left.n > 1).any():
            copies = np.flatnonzero(left.n > 1)
            a, b, s, n = np.r_[a, copies], np.r_[b, left.row[copies]], np.r_[s, np.ones(len(copies))], np.r_[n, left.n[copies] - 1]
        best = _best(a, b, s, n, k)
        kept = [(a[best], b[best], s[best], n[best])]
        # What the row has by now, counted with copies, is the bound for the blocks to come.
        order = np.lexsort((-s[best], a[best]))
        at, copies_, cosine = a[best][order], n[best][order], s[best][order]
        if len(at):
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sizes = np.diff(np.r_[begin, len(at)])
            upto = np.cumsum(copies_)
            reached = upto - np.repeat((upto - copies_)[begin], sizes) >= k
            value = np.maximum.reduceat(np.where(reached, cosine, -2.0), begin)
            bound[at[begin]] = np.maximum(bound[at[begin]], value.astype(np.float32) - SINGLE)
        if towards_right:
            a, b, s, n = (np.concatenate(x) for x in zip(*towards_right, strict=True))
            best = _best(a, b, s, n, k)
            yield right.row[a[best]], b[best], s[best], n[best]
    if not kept:
        return
    a, b, s, n = kept[0]
    yield left.row[a], b, s, n


_PAIRS = "a long, b long, cosine double, n int"


def _as_batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    a, b, s, n = found
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(s, pa.float64()), "n": pa.array(n, pa.int32())})


def readable_by_workers(blocks: DataFrame) -> bool:
    """Whether a worker can open a block of the shared folder by itself; one task tries."""
    paths = blocks.inputFiles()[:1]

    def attempt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            try:
                _read_block(paths[0])
                opened = True
            except Exception:  # noqa: BLE001 - whatever a file system that is not there raises
                opened = False
            yield pa.RecordBatch.from_pydict({"opened": [opened]})

    return not paths or blocks.sparkSession.range(0, 1, 1, 1).mapInArrow(attempt, "opened boolean").first()[0]


def candidate_pairs(blocks: DataFrame, dim: int, k: int, by_workers: bool | None = None) -> DataFrame:
    """``(a, b, cosine, n)`` for the best partners of every row of the blocks, in each strip.

    ``by_workers`` says who reads the blocks; by default it is tried out.
    """
    if readable_by_workers(blocks) if by_workers is None else by_workers:
        return _pairs_of_strips(blocks, dim, k)
    return _pairs_of_tiles(blocks, dim, k)


def _pairs_of_strips(blocks: DataFrame, dim: int, k: int) -> DataFrame:
    """The strips are numbers made by the executors; the names of the block files go to the workers once."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(sorted(blocks.inputFiles()))
    count, cores = len(sent.value), spark.sparkContext.defaultParallelism
    # As long as a strip may be while there are several for every core; the rows of a strip share one left block.
    length = max(1, min(STRIP, count * (count + 1) // (8 * cores)))
    strips = spark.range(0, count, 1, max(1, min(count, 2 * cores))).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(count - 1).cast("long"), F.lit(length).cast("long"))).alias("j"))
    todo = strips.repartition(max(1, min(count * (count // length + 1), 20_000)), "i", "j")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, held = sent.value, (None, None)
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left = held[1] if held[0] == i else _Block(_read_block(paths[i]), dim)
                held = (i, left)
                rights = (left if r == i else _Block(_read_block(paths[r]), dim) for r in range(j, min(j + length, len(paths))))
                for found in _strip(left, rights, k):
                    yield _as_batch(found)

    return todo.mapInArrow(join, _PAIRS)


def _pairs_of_tiles(blocks: DataFrame, dim: int, k: int) -> DataFrame:
    """The same where only Spark can read the blocks: each is sent to the tiles it is part of, two blocks to a task."""
    spark = blocks.sparkSession
    # A block is what one task wrote before it began the next: the upper bits of the row numbers.
    numbers = blocks.select(F.shiftright("row", 20).alias("block")).distinct().orderBy("block")
    names = [r["block"] for r in numbers.collect()]
    order = spark.createDataFrame(list(enumerate(names)), "no int, block long")
    last = len(names) - 1
    placed = blocks.withColumn("block", F.shiftright("row", 20)).join(F.broadcast(order), "block")
    number = F.col("no")
    # Tile (i, j) with i <= j has blocks i and j.
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(last, 0))))).select(F.least(number, "other").alias("i"), F.greatest(number, "other").alias("j"), "no", *_COLUMNS)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key)
        parts = [table.filter(pa.compute.equal(table["no"], x)).sort_by("row") for x in dict.fromkeys((i, j))]
        left = _Block(parts[0], dim)
        found = list(_strip(left, iter([left] if i == j else [_Block(parts[1], dim)]), k))
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64()), ("n", pa.int32())])
        return pa.Table.from_batches([_as_batch(f) for f in found], schema)

    return tiles.groupBy("i", "j").applyInArrow(join, _PAIRS)


def nearest(chunks: DataFrame, id: str = "id", vector: str = "embedding", dim: int = 384, k: int = 5, by_workers: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``.

    ``links`` has ``(a, b, cosine)``: class ``b`` is among the k most similar of the vectors of
    class ``a``; near ties of the k-th count.  A class is a group of equal vectors, ``a = b`` says
    that copies are each other's neighbours.  ``members`` has ``(row, id)`` for every usable vector.
    Null, short, non-finite and zero vectors, and rows without id, are in neither.  The table of blocks
    stays in the shared folder as long as the application, which may read the result at any time.
    """
    blocks = chunks.sparkSession.read.schema(_BLOCK_SCHEMA).parquet(write_blocks(chunks, id, vector, dim, k))
    best = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    ranked = candidate_pairs(blocks, dim, k, by_workers).withColumn("before", F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bounded = ranked.withColumn("kth", F.min(F.when(F.col("before") < k, F.col("cosine"))).over(Window.partitionBy("a")))
    links = bounded.where(F.col("cosine") >= F.col("kth") - TIE).select("a", "b", "cosine")
    return links, blocks.select("row", F.explode("ids").alias("id"))


def neighbour_pairs(chunks: DataFrame, id: str = "id", vector: str = "embedding", dim: int = 384, k: int = 5) -> DataFrame:
    """``(chunk_a, chunk_b)``, smaller id first: pairs of which one is among the k best of the other."""
    links, members = nearest(chunks, id, vector, dim, k)
    classes = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = members.toDF("a", "id_a"), members.toDF("b", "id_b")
    # Merge joins by name: the planner takes the distinct classes for far smaller than they are.
    named = classes.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(F.col("id_a") != F.col("id_b"))
    return named.select(F.least("id_a", "id_b").alias("chunk_a"), F.greatest("id_a", "id_b").alias("chunk_b")).distinct()
