"""A saved merge closure that grows with its edges (G1, K6).

``ClosureStore.update`` compares the edges it is given with the saved ones.
Added edges extend the closure (``extend_closure``) and only the new pairs are
written, as ``gen=G/delta=K``; edges that are gone start the next generation
with a closure of its own, since pairs they led to may no longer hold. After
``compact_every`` deltas everything is written as one delta of the next
generation. A delta counts once its pairs are committed, which happens last: an
update that was interrupted is done over by the next one. One writer at a
time; older generations stay until the caller deletes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokscope.operators.mergegraph import distinct_edges, extend_closure, merge_closure
from tokscope.session import cut_columns
from tokscope.sinks.writers import committed

COMPACT_EVERY = 20


class ClosureStore:
    """Edges and closure pairs ``(ancestor, descendant)`` under ``path``, in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every

    def _folder(self, generation: int, delta: int, what: str) -> str:
        return f"{self.path}/gen={generation}/delta={delta}/{what}"

    def _done(self, generation: int, delta: int) -> bool:
        return committed(self.spark, self._folder(generation, delta, "pairs"))

    def state(self) -> tuple[int, int]:
        """Newest generation and its number of committed deltas; ``(-1, 0)`` before the first update."""
        generation = -1
        while self._done(generation + 1, 0):
            generation += 1
        deltas = 0
        while generation >= 0 and self._done(generation, deltas):
            deltas += 1
        return generation, deltas

    def _read(self, generation: int, deltas: int, what: str) -> DataFrame:
        return self.spark.read.parquet(*[self._folder(generation, k, what) for k in range(deltas)])

    def _write(self, generation: int, delta: int, edges: DataFrame, pairs: DataFrame) -> None:
        edges.write.mode("overwrite").parquet(self._folder(generation, delta, "edges"))
        pairs.write.mode("overwrite").parquet(self._folder(generation, delta, "pairs"))

    def pairs(self) -> DataFrame:
        """The saved closure."""
        generation, deltas = self.state()
        if generation < 0:
            raise ValueError(f"no closure saved under {self.path}")
        return self._read(generation, deltas, "pairs")

    def update(self, edges: DataFrame) -> DataFrame:
        """Bring the closure in line with ``edges`` and return it.

        Unchanged edges write nothing. Null ends are ignored, repeated edges
        count once; an empty table gives an empty closure.
        """
        key = ["ancestor", "descendant"]
        edges = cut_columns(distinct_edges(edges.dropna(subset=key)))
        generation, deltas = self.state()
        if generation < 0:
            self._write(0, 0, edges, merge_closure(edges))
            return self.pairs()
        saved = self._read(generation, deltas, "edges")
        if not saved.join(edges, key, "left_anti").isEmpty():
            self._write(generation + 1, 0, edges, merge_closure(edges))
            return self.pairs()
        added = edges.join(saved, key, "left_anti")
        if added.isEmpty():
            return self.pairs()
        known = self._read(generation, deltas, "pairs")
        more = extend_closure(known, added)
        if deltas < self.compact_every:
            self._write(generation, deltas, added, more)
        else:
            self._write(generation + 1, 0, edges, known.unionByName(more))
        return self.pairs()
