"""Blocked pair counts against counting every pair."""

import collections
import itertools
import random

import pytest

from sparkloom.operators import cooccurrence


@pytest.mark.parametrize("made,held,bits", [(1 << 21, 1 << 22, 8), (7, 40, 2), (1000, 200, 3)])
def test_gram(spark, made, held, bits):
    rng = random.Random(bits)
    ids = [rng.randrange(-50, 50) for _ in range(20)] + [10**12, -(10**12), 10**12 + 1]
    lists = [sorted(set(rng.choices(ids, k=rng.choice([0, 1, 2, 3, 9, 15])))) for _ in range(300)] + [sorted(set(ids))]
    want = collections.Counter(p for f in lists for p in itertools.combinations(f, 2))
    got = cooccurrence.gram(spark.createDataFrame([(f,) for f in lists], "f array<long>").repartition(3), bits, made, held)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == dict(want)
    assert cooccurrence.gram(spark.createDataFrame([], "f array<long>")).count() == 0


def test_sparse_pairs_in_little_memory():
    """Two million pairs of as many blocks are packed without an object each, and handed on in small batches."""
    import tracemalloc

    import numpy as np

    n = 2_000_000
    i = np.arange(n, dtype=np.int64) * 256
    tracemalloc.start()
    seen = top = 0
    for batch in cooccurrence._packed(i, i + 7, np.full(n, 3), 0, 8):
        assert batch.num_rows <= cooccurrence._ROWS
        places, counts = batch.column(3), batch.column(4)
        assert np.frombuffer(places[-1].as_py(), np.int32).tolist() == [7] and np.frombuffer(counts[0].as_py(), np.int64).tolist() == [3]
        assert batch.column(0)[0].as_py() == seen and batch.column(1)[-1].as_py() == seen + batch.num_rows - 1
        seen += batch.num_rows
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and top < 200e6, top
