import random

from homolith.llm import jaccard


def test_cells_are_shuffled_in_slices(spark, monkeypatch):
    draw, most, tables = random.Random(3), 50, {"cells": [], "met": []}
    nodes = {n: [draw.getrandbits(63) - 2**62 for _ in range(20)] for n in range(most)}
    for n in range(1, most, 2):  # every other node has half of its cells from the one before, one cell is offered by all
        nodes[n][:10] = nodes[n - 1][:10]
    nodes = {n: [*c, -77] for n, c in nodes.items()}
    # A node's cells come from several tasks, and rows without cells take no part.
    found = spark.createDataFrame([*nodes.items(), (0, nodes[0]), (most, None), (None, [])], "node long, cells array<long>")
    real = jaccard.written

    def spy(s, df, label):
        out = real(s, df, label)
        tables[label].append({r[0] for r in out[0].collect()})
        return out

    monkeypatch.setattr(jaccard, "written", spy)
    met, paths = jaccard.meetings(found)
    want = {c: {n for n in nodes if c in nodes[n]} for cells in nodes.values() for c in cells}
    want = {(c, n) for c, held in want.items() if len(held) > 1 for n in held}
    assert {(r["cell"], r["node"]) for r in met.collect()} == want
    for held in tables.values():
        assert sum(len(h) for h in held) == len(set().union(*held)) == len({c for c, _ in want})
        assert max(len(h) for h in held) < len({c for c, _ in want}) / 2
    assert len(paths) == len(tables["met"])
