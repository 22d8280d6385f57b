"""Cycles over triples that are folded and embedded once."""

from chronoloom.operators import consolidate, facts, models


def test_a_cycle_embeds_nothing_again(spark):
    """Every node is at the cap; folded and embedded once, merged node by node."""
    calls, rows = [], [(f"s{i}", "p", f"o{i % 3}", f"{n}") for n in range(4) for i in range(n, n + 5)]
    df = spark.createDataFrame(rows, "s string, p string, o string, node string")

    def embed(x):
        calls.append(x)
        return models.embed_distinct(x, "text", models.hashed_words)

    store, cycles = consolidate.sleep_cycles(df, embed, 1.01, 100, 2)
    key = lambda t: sorted(map(repr, t.select("ks", "kp", "ko", "first_seen", "last_seen", "support", "variants").collect()))
    assert cycles == 5 and len(calls) == 1 and key(store) == key(facts.fold_facts(df))


def test_cycles_and_texts_that_read_alike(spark):
    rows = [("The Cup", "is", "red", "1"), ("cup", "is", "red", "2"), ("is", "cup", "red", "2"), (None, "x", "y", "2"), ("a", None, "b", "3"), ("", "p", "o", "4"), ("red", "cup", "is", "5")]
    store, _ = consolidate.sleep_cycles(spark.createDataFrame(rows, "s string, p string, o string, node string"), lambda x: models.embed_distinct(x, "text", models.hashed_words), 0.9, 2, 100)
    got = {(r["ks"], r["support"], r["first_seen"], r["last_seen"], len(r["variants"])) for r in store.collect()}
    assert got == {("cup", 4, "1", "5", 4), ("a", 1, "3", "3", 1)}
    empty, n = consolidate.sleep_cycles(spark.createDataFrame([], "s string, p string, o string, node string"), lambda x: models.embed_distinct(x, "text", models.hashed_words))
    assert (empty.count(), n) == (0, 0)
