"""Graph retrieval against a dense solution."""

import numpy as np

from chronoloom import catalog
from chronoloom.plans import consolidation

from .conftest import DATA

DIR = f"{DATA}/sf0.001"


def test_graph_retrieval_is_settled(spark):
    e = consolidation._graph(spark, DIR).toPandas()
    nodes = {n: i for i, n in enumerate(sorted({*e.src, *e.dst}))}
    m = np.zeros((len(nodes), len(nodes)))
    np.add.at(m, ([nodes[x] for x in e.dst], [nodes[x] for x in e.src]), e.weight)
    m /= m.sum(0)
    reset = np.zeros(len(nodes))
    seeds, passages = consolidation._seeds(spark, DIR)
    for name, weight in [*map(tuple, seeds.select("entity", "weight").collect()), *((p, 0.05 * s) for p, s in passages.select("passage", "score").collect())]:
        if weight > 0 and name in nodes:
            reset[nodes[name]] += weight
    want = np.linalg.solve(np.eye(len(nodes)) - 0.5 * m, 0.5 * reset / reset.sum())
    got = {r["passage"]: r["rank"] for r in catalog.queries()["graph_retrieval"](spark, DIR).collect()}
    assert len(got) == passages.count() and all(abs(v - want[nodes[p]]) < 1e-6 for p, v in got.items())
