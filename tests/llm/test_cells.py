"""Rounds of pivots over cells that overlap."""

from __future__ import annotations

from skyledger.llm.cells import members_of, pivot_rounds

NODES, CELLS = 60, 24


def test_pairs_of_a_round_grow_with_nodes_not_with_cells(spark):
    """Every node in many cells that no pivot can join: it still meets four pivots a round at most, and no cell is lost."""
    cells = spark.createDataFrame([(k, n) for n in range(NODES) for k in range(CELLS) if (n * 7 + k * 5) % 3], "key bigint, node bigint").localCheckpoint()
    asked = []

    def meet(pairs):
        asked.append([tuple(r) for r in pairs.collect()])
        return pairs.where("false")

    links, left = pivot_rounds(cells, meet)
    assert links.isEmpty()
    assert len(asked) == 3 and all(len(a) <= m * NODES for a, m in zip(asked, (1, 4, 4), strict=True))
    assert {tuple(r) for r in left.collect()} == {tuple(r) for r in cells.collect()}


def test_linked_cells_leave(spark):
    """One star of links joins all nodes, so nothing is left over; an apart cell whose nodes never link stays whole."""
    rows = [(k, n) for k in range(3) for n in range(20)] + [(9, 100), (9, 101)]
    cells = spark.createDataFrame(rows, "key bigint, node bigint")
    links, left = pivot_rounds(cells, lambda pairs: pairs.where("a < 100 and b < 100"))
    assert {tuple(r) for r in left.collect()} == {(9, 100), (9, 101)}
    assert {r["comp"] for r in members_of(links).collect()} == {0}
