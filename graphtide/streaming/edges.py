"""Edge streams: loop-closure flags and new nodes with state kept for each graph, and incremental solving by micro-batch.

Order within a graph is the edge's place in the stream, not time, so there is no watermark. Edges that arrive before
their predecessors wait in the state; a place that was already taken is late and is given out with `late` set.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from graphtide.operators.growth import LoopDetector

OUT = "graph_id long, edge_pos long, it long, loop_closure boolean, new_nodes array<long>, late boolean"
STATE = "next long, waiting binary, detector binary, seen binary"


def flags(edges: DataFrame, gap: int = 5, batch: int = 1) -> DataFrame:
    """One row for each edge of a stream (graph_id, edge_pos from 1, type, from_id, to_id) once all before it have come.

    `batch` groups places as batches of the stored order do; the flag of a batch stands at each of its edges once the
    batch is full. Works on streaming tables only.
    """

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            at, waiting, detector, seen = state.get
            waiting, detector, seen = pickle.loads(waiting), pickle.loads(detector), pickle.loads(seen)
        else:
            at, waiting, detector, seen = 1, {}, LoopDetector(gap), set()
        rows = []
        for pdf in pdfs:
            for pos, kind, a, b in zip(pdf.edge_pos, pdf.type, pdf.from_id, pdf.to_id, strict=True):
                edge = (kind, int(a), None if pd.isna(b) else int(b))
                if pos < at or pos in waiting:
                    rows.append((key[0], int(pos), None, None, [], True))
                else:
                    waiting[int(pos)] = edge
        while all(at + i in waiting for i in range(batch)):
            group = [waiting.pop(at + i) for i in range(batch)]
            hit = detector.batch(group)
            for i, (_, a, b) in enumerate(group):
                new = sorted({n for n in (a, b) if n is not None} - seen)
                seen.update(new)
                rows.append((key[0], at + i, (at - 1) // batch + 1, hit, new, False))
            at += batch
        state.update((at, pickle.dumps(waiting), pickle.dumps(detector), pickle.dumps(seen)))
        yield pd.DataFrame(rows, columns=["graph_id", "edge_pos", "it", "loop_closure", "new_nodes", "late"]).astype({"it": "Int64", "loop_closure": "boolean"})

    picked = edges.select("graph_id", "edge_pos", "type", "from_id", "to_id")
    return picked.groupBy("graph_id").applyInPandasWithState(fold, OUT, STATE, "append", "NoTimeout")


def solve_each_batch(stream: DataFrame, solve: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch to `solve` (a table and the batch's number), which must be safe to repeat."""
    return stream.writeStream.foreachBatch(solve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
