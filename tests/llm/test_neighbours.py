from __future__ import annotations

import numpy as np
import pytest

from corpusmill.llm import neighbours


def brute(vectors, k=5):
    """Every pair of usable vectors by the rule, in double precision."""
    usable = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids, unit = [i for i, _ in usable], np.array([v / np.linalg.norm(v) for _, v in usable])
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -9)
    pairs = set()
    for r in range(len(ids)):
        kth = np.sort(cosine[r])[-k] if len(ids) > k else -8
        pairs |= {(min(ids[r], ids[c]), max(ids[r], ids[c])) for c in np.flatnonzero(cosine[r] >= kth - 1e-6) if c != r}
    return pairs


def found(spark, vectors, parts=3):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash") for i, v in vectors], "id string, embedding array<float>, row string").repartition(parts)
    return {(r.chunk_a, r.chunk_b) for r in neighbours.neighbour_pairs(df, dim=8).collect()}


def float32(rng, n):
    centres = rng.normal(size=(5, 8))
    return (centres[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, 8))).astype(np.float32).tolist()


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, parts):
    rng = np.random.default_rng(3)
    vectors = [(f"v{i:03}", v) for i, v in enumerate(float32(rng, 120))]
    vectors += [("null", None), ("short", [1.0] * 7), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("inf", [float("inf")] + [1.0] * 7), ("hole", [None] + [1.0] * 7), (None, vectors[0][1])]
    vectors += [("long", [x * 1000 for x in vectors[1][1]]), ("copy1", vectors[2][1]), ("copy2", vectors[2][1]), ("tiny", [1e-38] * 8), ("huge", [1e38] * 8)]
    assert found(spark, vectors, parts) == brute(vectors)


def test_many_copies(spark):
    rng = np.random.default_rng(4)
    base = float32(rng, 12)
    vectors = [(f"v{i:03}", v) for i, v in enumerate(base)] + [(f"c{i:03}", base[0]) for i in range(9)]
    assert found(spark, vectors) == brute(vectors)


def test_few_and_none(spark):
    assert found(spark, [("a", [1.0] * 8)]) == set()
    assert found(spark, []) == set()
    assert found(spark, [("a", [1.0] * 8), ("b", [1.0] * 7 + [0.5]), ("c", [-1.0] * 8)]) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_a_block_per_few_vectors(spark):
    """Strips over several blocks give what one block gives."""
    rng = np.random.default_rng(5)
    vectors = [(f"v{i:03}", v) for i, v in enumerate(float32(rng, 200))]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "id string, embedding array<float>").repartition(12)
    assert {(r.chunk_a, r.chunk_b) for r in neighbours.neighbour_pairs(df, dim=8).collect()} == brute(vectors)


@pytest.mark.parametrize("by_workers", [True, False])
def test_both_ways_to_read_the_blocks(spark, by_workers, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_BLOCK", 60)
    rng = np.random.default_rng(6)
    vectors = [(f"v{i:03}", v) for i, v in enumerate(float32(rng, 240))]
    vectors += [(f"c{i}", vectors[0][1]) for i in range(4)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "id string, embedding array<float>").repartition(9)
    links, members = neighbours.nearest(df, dim=8, by_workers=by_workers)
    names = {}
    for r in members.collect():
        names.setdefault(r.row, []).append(r.id)
    pairs = {(min(x, y), max(x, y)) for r in links.collect() for x in names[r.a] for y in names[r.b] if x != y}
    assert pairs == brute(vectors)


def test_small_partitions_make_full_blocks(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(f"v{i}", [float(x) for x in v]) for i, v in enumerate(float32(rng, 90))], "id string, embedding array<float>").repartition(30)
    path = neighbours.write_blocks(df, "id", "embedding", 8, 5)
    assert len(spark.read.parquet(path).inputFiles()) == 1


def test_names_of_shared_folders():
    assert neighbours.local_uri("s3a://bucket/x/y") == "s3://bucket/x/y"
    assert neighbours.local_uri("dbfs:/x/y") == "file:///dbfs/x/y"
    assert neighbours.local_uri("file:///x/y") == "file:///x/y" and neighbours.local_uri("/x:1/y") == "/x:1/y"
    assert neighbours.local_uri("hdfs://host:8020/x") == "hdfs://host:8020/x"


def test_folders_no_worker_can_open(spark, monkeypatch):
    df = spark.createDataFrame([(f"v{i}", [float(i), 1.0]) for i in range(9)], "id string, embedding array<float>")
    blocks = spark.read.schema(neighbours._BLOCK_SCHEMA).parquet(neighbours.write_blocks(df, "id", "embedding", 2, 5))
    assert neighbours.readable_by_workers(blocks)

    class Elsewhere:
        sparkSession = spark

        @staticmethod
        def inputFiles():
            return ["nosuchscheme://bucket/part-0.parquet"]

    assert not neighbours.readable_by_workers(Elsewhere())
