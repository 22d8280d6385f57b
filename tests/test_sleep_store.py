"""The store's query consolidates the engine's own triples."""

from pyspark.sql import functions as F

from chronoloom import catalog
from chronoloom.operators import consolidate, facts
from chronoloom.plans.base import triples

from .conftest import DATA

DIR = f"{DATA}/sf0.001"


def test_sleep_cycle_store_takes_all_triples(spark, monkeypatch):
    seen, real = [], consolidate.sleep_cycles

    def spy(t, embed, *args, **kw):
        seen.append((t, args, kw))
        return real(t, embed, *args, **kw)

    monkeypatch.setattr(consolidate, "sleep_cycles", spy)
    got = catalog.queries()["sleep_cycle_store"](spark, DIR)
    (t, args, kw), want = seen[0], triples(spark, DIR)
    assert not args and not kw and (consolidate.TAU, consolidate.EVERY, consolidate.CAP) == (0.86, 144, 6000)
    assert t.exceptAll(want).isEmpty() and want.exceptAll(t).isEmpty()
    assert got.agg(F.sum("support")).first()[0] == facts.fold_facts(want).agg(F.sum("support")).first()[0]
