"""What a task holds of its patterns."""

import tracemalloc

import pyarrow as pa
from tallyspark.operators import patterns as P


def test_little_beside_the_automaton():
    """100,000 patterns leave less than 100 bytes each, and repeated ones keep all their ids."""
    n = 100_000
    table = pa.table({"id": pa.array(range(n), pa.int64()), "pattern": pa.array([str(10_000 + i // 2 if i < 10 else 10_000 + i) for i in range(n)])})
    tracemalloc.start()
    machine = P.Automaton(P._pairs(table), True)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 100 * n
    assert machine.search("a 10000, 10001x 10777") == {0, 1, 777} and machine.search("") == set()
