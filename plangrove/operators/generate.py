"""A seeded statistical generator: samples the edges of a plan from pair probabilities, then joins what is left apart."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_plans(programs: DataFrame, probabilities: dict[tuple[str, str], float], seed: int = 0) -> DataFrame:
    """Edges (``g, a, b, joined``) for plans given as (g, roles array). One task works on a partition of plans, one plan at a time."""
    table = {tuple(sorted(k)): p for k, p in probabilities.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for g, roles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r, label = random.Random(f"{seed}:{g}"), list(range(len(roles)))

                def find(v, label=label):
                    while label[v] != v:
                        v = label[v]
                    return v

                for i in range(len(roles)):
                    for j in range(i + 1, len(roles)):
                        if r.random() < table.get(tuple(sorted((roles[i], roles[j]))), 0.0):
                            rows.append((g, i, j, False))
                            label[find(j)] = find(i)
                for j in range(1, len(roles)):
                    if find(j) != find(0):
                        rows.append((g, 0, j, True))
                        label[find(j)] = find(0)
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["g", "a", "b", "joined"])

    return programs.select(F.col("g").cast("long").alias("g"), "roles").mapInArrow(run, "g long, a int, b int, joined boolean")


class Registry:
    """Generators by name; a decorator registers a factory."""

    def __init__(self):
        self._made = {}

    def register(self, name: str):
        def add(factory):
            self._made[name] = factory
            return factory

        return add

    def make(self, name: str, *args, **kwargs):
        if name not in self._made:
            raise KeyError(f"no generator {name!r}; there are {sorted(self._made)}")
        return self._made[name](*args, **kwargs)

    def names(self) -> list[str]:
        return sorted(self._made)


GENERATORS = Registry()
GENERATORS.register("statistical")(lambda probabilities, seed=0: lambda programs: sample_plans(programs, probabilities, seed))
