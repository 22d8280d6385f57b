"""Trained parts against enumeration, held-out samples and true class rates."""

import itertools
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import crf, langid, quality, secrets, toxicity
from chronoloom.llm.common import class_weights


@pytest.mark.parametrize("k", [2, 3])
def test_messages_against_enumeration(k):
    """Marginals of chains of every length from 1 to 6, in one block, equal the sums over all label sequences."""
    rng = np.random.default_rng(k)
    sizes = [1, 2, 3, 4, 5, 6, 1, 6]
    starts = np.cumsum([0, *sizes[:-1]])
    logits, trans, init = rng.normal(0, 2, (sum(sizes), k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)
    g = crf.messages(logits, trans, init, starts)[3]
    for at, n in zip(starts, sizes, strict=True):
        want = np.zeros((n, k))
        for y in itertools.product(range(k), repeat=n):
            s = init[y[0]] + sum(logits[at + i, y[i]] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n))
            for i in range(n):
                want[i, y[i]] += np.exp(s)
        assert np.allclose(g[at : at + n], want / want.sum(1, keepdims=True), atol=1e-9)


def test_messages_of_long_chains():
    """Thousands of tokens in pieces equal plain forward-backward, token by token."""
    rng = np.random.default_rng(9)
    t, k = 3000, 3
    logits, trans, init = rng.normal(0, 2, (t, k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)
    starts = np.array([0, 1, 700, 2500])
    g = crf.messages(logits, trans, init, starts)[3]
    e, a = np.exp(logits), np.exp(trans)
    for s, stop in zip(starts, [*starts[1:], t], strict=True):
        fore, back = np.zeros((stop - s, k)), np.ones((stop - s, k))
        for i in range(stop - s):
            fore[i] = e[s + i] * (np.exp(init) if i == 0 else fore[i - 1] @ a)
            fore[i] /= fore[i].sum()
        for i in range(stop - s - 2, -1, -1):
            back[i] = a @ (e[s + i + 1] * back[i + 1])
            back[i] /= back[i].sum()
        want = fore * back
        assert np.allclose(g[s:stop], want / want.sum(1, keepdims=True), atol=1e-9)


def test_every_language_can_be_learned(spark):
    """A table of 70 languages, one of them with most rows: each keeps texts in the sample and is told from the others."""
    rng = np.random.default_rng(0)
    words = {f"l{i:02d}": ["".join(rng.choice(list(string.ascii_lowercase), 6)) for _ in range(12)] for i in range(70)}
    rows = [(n, " ".join(rng.choice(words[x], 30)), x) for n, x in enumerate([*words] * 8 + ["l00"] * 400)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = langid.fit(df, F.col("doc_id") % 8 != 3)
    assert model["names"] == sorted(words)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    assert np.mean([got[n] == x for n, _, x in rows]) > 0.97
    assert langid.fit(df.limit(0), F.lit(True)) is None


def test_markov_on_held_out_strings(docs):
    """Fitted on one half of the documents: random strings of unseen lengths and seeds pass, words of the other half do not."""
    texts = [r["text"] or "" for r in docs.collect()]
    model = secrets.train(texts[::2])
    rng = np.random.default_rng(77)
    sets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567")
    keys = ["".join(rng.choice(list(sets[i % 3]), int(rng.integers(32, 50)))) for i in range(300)]
    caught = [any(k == 3 for _, k, _ in secrets.find(f"a text with {x} inside", model)) for x in keys]
    assert np.mean(caught) > 0.9
    plain = [w for t in texts[1::2] for w in secrets.CANDIDATE.findall(t) if not secrets.base_spans(t)]
    assert np.mean([any(k == 3 for _, k, _ in secrets.find(w, model)) for w in plain]) < 0.05 if plain else True


def _noisy(rng, n, rate):
    """Texts whose class shows in half of the cases only; labels at a rate."""
    y = (rng.random(n) < rate).astype(np.int64)
    word = lambda c: rng.choice([f"{'good' if c else 'bad'}{i}" for i in range(30)])
    return [" ".join(f"{word(y[i] if rng.random() < 0.6 else 1 - y[i])} x{rng.integers(0, 400)}" for _ in range(8)) for i in range(n)], y


def test_quality_is_calibrated_to_the_true_rate():
    """A sample of equal classes from a table with 90 % good rows: scores of fresh rows average to their rate, in both halves of the scale."""
    rng = np.random.default_rng(5)
    texts, y = _noisy(rng, 6000, 0.9)
    good, bad = np.flatnonzero(y == 1)[:500], np.flatnonzero(y == 0)[:500]
    on = rng.permutation(np.r_[good, bad])
    model = quality.train([texts[i] for i in on], y[on], np.array([(y == 0).sum(), (y == 1).sum()]))
    new, z = _noisy(rng, 4000, 0.9)
    p = quality.sigmoid(quality._logits(quality.Block.of([t.encode() for t in new]), model))
    assert abs(p.mean() - z.mean()) < 0.03
    half = p >= np.median(p)
    assert abs(p[half].mean() - z[half].mean()) < 0.05 and abs(p[~half].mean() - z[~half].mean()) < 0.05


def test_weights_give_true_shares():
    y = np.array([0] * 30 + [1] * 10)
    w = class_weights(y, y, np.array([900.0, 100.0]))
    assert np.isclose(w[y == 1].sum() / w.sum(), 0.1) and np.isclose(w.sum(), 40)


def test_held_out_quality_and_toxicity(spark):
    """Learned on some labelled rows of sf0.1, both tell the classes of the others."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi").cache()
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    q = quality.assess(docs, labels.where(~out)).join(labels.where(out), "doc_id").where("not base_failed").toPandas()
    t = toxicity.tag(docs, toxicity.fit(docs, labels.where(~out))).join(labels.where(out), "doc_id").toPandas()
    docs.unpersist()
    auc = lambda s, y: (s.rank()[y == 1].mean() - ((y == 1).sum() + 1) / 2) / (y == 0).sum()
    print("quality", len(q), q.quality.mean(), auc(q.score, q.quality), (q.kept == (q.quality == 1)).mean(), q.score.mean())
    print("toxic", len(t), t.toxic.mean(), auc(t.score, t.toxic), ((t.predicted == 1) == (t.toxic == 1)).mean(), t.score.mean())
    assert auc(t.score, t.toxic) > 0.95 and ((t.predicted == 1) == (t.toxic == 1)).mean() > 0.95
    assert auc(q.score, q.quality) > 0.8 and abs(q.score.mean() - q.quality.mean()) < 0.06
