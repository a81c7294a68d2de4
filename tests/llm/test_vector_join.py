"""The vector join over several cells against all pairs of rows, with repeated ids and none."""

import numpy as np
import pytest

from fluxgrid.llm import vector_join

SCHEMA = "vec_id long, embedding array<double>, n_links string, component_id int"


def restated(rows):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            ok[k] = x / np.sqrt(x @ x)
    links, up = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, x in ok.items():
        for j, y in ok.items():
            if i < j and len(x) == len(y) and x @ y >= 0.95:
                links[i], links[j] = links[i] + 1, links[j] + 1
                up[find(j)] = find(i)
    names = {}
    for k, (i, _) in enumerate(rows):
        names.setdefault(find(k), []).append(i)
    least = {k: min((i for i in ids if i is not None), default=None) for k, ids in names.items()}
    return sorted(((i, links[k], least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("cell", [15, 40, 8_192])
def test_all_rows_over_several_cells(spark, cell):
    draw = np.random.default_rng(cell)
    base = draw.normal(size=(40, 6))
    rows = [(k, (base[k % 40] + draw.normal(size=6) * draw.choice([0, 0.1, 0.2, 0.4])).tolist()) for k in range(240)]
    rows += [(7, base[3].tolist()), (7, (base[30] * 2).tolist()), (7, [9.0] * 6), (None, base[5].tolist()), (None, base[5].tolist()), (None, [1.0, -1.0] * 3), (None, [-5.0, 5.0] * 3), (None, [1.0, -1.0] * 3), (None, None), (7, None)]
    rows += [(900, [0.0] * 6), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("inf")] + [1.0] * 5), (903, []), (904, [1.0, 0.0]), (905, [1.0, 0.1]), (3, base[3].tolist()), (3, base[3].tolist())]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = vector_join.near_vectors(table, cell=cell, tile=16, strip=32).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == restated(rows)
    assert sum(r.n_links > 0 for r in got) > 50
    assert vector_join.near_vectors(table.where("false")).collect() == []
