"""LM scoring against a plain sum of conditional log-probabilities, and its independence of file layout."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chronoloom.llm import lm

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BASE = lm.WORDS  # the first bucket's symbol, in the workers too


def plain_scores(rows, counts, w):
    """Sums of log-probabilities, token by token: softmax over classes, softmax over members, word inside its bucket."""
    known = {int(h): int(i) for h, i in zip(counts.words, counts.ids, strict=True)}
    docs = [TOKEN.findall((t or "").encode()) for _, t in rows]
    vocab = {}
    for x in {x for d in docs for x in d}:
        tok = lm.Tokens([x])
        h = int(tok.hashes[0])
        vocab[x] = (known.get(h), BASE + int(tok.endings(np.array([0]))[0]))
    total = Counter(x for d in docs for x in d)
    strange = [x for x in vocab if vocab[x][0] is None]
    tokens, kinds = Counter(), Counter()
    for x in strange:
        tokens[vocab[x][1]] += total[x]
        kinds[vocab[x][1]] += 1
    letters = Counter(b for x in total for b in x * total[x])
    n = sum(letters.values()) + sum(total.values()) + 0.5 * 257
    letter = {b: math.log((letters[b] + 0.5) / n) for b in range(256)}
    stop = math.log((sum(total.values()) + 0.5) / n)

    def places(d):
        near = [None, *d, None]
        return [((vocab[x][1], near[i], near[i + 2]), x) for i, x in enumerate(d) if vocab[x][0] is None]

    pairs = Counter(p for d in docs for p in places(d))
    around = Counter(c for d in docs for c, _ in places(d))

    def soft(z, i):
        z = np.asarray(z, dtype=np.float64)
        return z[i] - np.log(np.exp(z - z.max()).sum()) - z.max()

    out = []
    for d in docs:
        mine, s = Counter(d), 0.0
        sym = [vocab[x][0] if vocab[x][0] is not None else vocab[x][1] for x in d]
        for i, x in enumerate(d):
            near = [*range(i - lm.SIDE, i), *range(i + 1, i + lm.SIDE + 1)]
            h = np.tanh(sum(w["u"][j][sym[k] if 0 <= k < len(d) else lm.VOCAB].astype(np.float64) for j, k in enumerate(near)))
            c, m = sym[i] % lm.CLASSES, sym[i] // lm.CLASSES
            s += soft(w["c"] @ h + w["cb"], c) + soft(w["m"][c] @ h + w["mb"][c], m)
            if vocab[x][0] is None:
                e = vocab[x][1]
                spelled = kinds[e] * math.exp(sum(letter[b] for b in x[:-3]) + stop)
                p = (total[x] - mine[x] + spelled) / (tokens[e] + kinds[e])
                c = (e, d[i - 1] if i else None, d[i + 1] if i + 1 < len(d) else None)
                own = places(d)
                s += math.log((pairs[c, x] - own.count((c, x)) + p) / (around[c] - [y for y, _ in own].count(c) + 1))
        out.append(s)
    return out


def test_scores_are_sums_of_conditionals(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 40)  # most words share buckets
    rng = np.random.default_rng(2)
    words = ["w%dx" % i for i in range(60)] + ["ending", "bending", "sending", "é", "日本語"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 30))))) for i in range(60)] + [(60, None), (61, ""), (None, "a b"), (3, "a b"), (70, "twice told unusual"), (71, "twice told unusual"), (72, "once told uncommon")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm.Counts(df)
    assert len(counts.words) == 40
    w = lm.train(df, counts.words, counts.ids)
    want = sorted(zip([len(TOKEN.findall((t or "").encode())) for _, t in rows], plain_scores(rows, counts, w), strict=True))
    got = sorted((r["n_tokens"], r["pll"]) for r in lm.score(df).collect())
    assert [n for n, _ in got] == [n for n, _ in want]
    assert np.allclose([p for _, p in got], [p for _, p in want], rtol=1e-4, atol=1e-3)
    by = {r["doc_id"]: r["mean_pll"] for r in lm.score(df).collect()}
    assert by[70] == by[71] > by[72]


def test_layout_does_not_matter(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    runs = [sorted((r["doc_id"], r["pll"]) for r in lm.score(x, shard=200_000).collect()) for x in (d.coalesce(1), d.repartition(7))]
    assert runs[0] == runs[1]


def test_tree_of_means(spark):
    """Many shards through several levels give the plain weighted mean, round by round."""
    rows = [(i, " ".join("abcdefgh"[(i + j) % 8] for j in range(20 + i % 5))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    c = lm.Counts(df)
    got, w = lm.train(df, c.words, c.ids, shard=100), lm.start()
    dealt = lm._dealt(df, 100).orderBy("q", "h").collect()
    assert dealt and max(r["q"] for r in dealt) > lm.FAN
    for r in range(lm.ROUNDS):
        total, n = {k: 0.0 for k in w}, 0
        for q in sorted({x["q"] for x in dealt}):
            toks = [lm.Tokens([x["text"].encode()]) for x in dealt if x["q"] == q]
            mine = {k: x.copy() for k, x in w.items()}
            k = lm.train_shard(mine, np.concatenate([t.symbols(c.words, c.ids) for t in toks]), np.array([len(t.hashes) for t in toks]), r)
            n += k
            total = {x: total[x] + mine[x].astype(np.float64) * k for x in w}
        w = {x: (total[x] / n).astype(np.float32) for x in w}
    assert all(np.allclose(got[x], w[x], atol=1e-5) for x in got)


def test_held_out_beats_unigram(spark):
    """The trained window says more about a token than the symbols' frequencies do."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    c = lm.Counts(d.where(~fold))
    w = lm.train(d.where(~fold), c.words, c.ids, shard=1 << 20)
    texts = [(r["text"] or "").encode() for r in d.where(~fold).collect()]
    t = lm.Tokens(texts)
    share = np.log((np.bincount(t.symbols(c.words, c.ids), minlength=lm.VOCAB) + 1) / (len(t.hashes) + lm.VOCAB))
    held = lm.Tokens([(r["text"] or "").encode() for r in d.where(fold).collect()])
    sym = held.symbols(c.words, c.ids)
    assert lm.log_probs(w, sym, lm.contexts(sym, held.spans.doc)).mean() > share[sym].mean() + 0.2


def test_scores_take_one_exponential_a_logit(monkeypatch):
    """Log-probabilities hold against plain float64 ones, and no rows of padding are worked on."""
    rng = np.random.default_rng(3)
    n = 5000
    sym, doc = (rng.zipf(1.3, n) % lm.VOCAB).astype(np.int64), np.repeat(np.arange(10), n // 10)
    ctx, w = lm.contexts(sym, doc), {k: x * 3 for k, x in lm.start().items()}
    sizes, plain = [], lm._exp
    monkeypatch.setattr(lm, "_exp", lambda z, at: sizes.append(z.size) or plain(z, at))
    got = lm.log_probs(w, sym, ctx)
    h = np.tanh(sum(w["u"][j].astype(np.float64)[ctx[j]] for j in range(2 * lm.SIDE)))
    c, m = h @ w["c"].T + w["cb"], np.einsum("nd,nmd->nm", h, w["m"][sym % lm.CLASSES]) + w["mb"][sym % lm.CLASSES]
    want = sum(z[np.arange(n), at] - np.log(np.exp(z).sum(1)) for z, at in ((c, sym % lm.CLASSES), (m, sym // lm.CLASSES)))
    assert np.abs(got - want).max() < 1e-4
    assert sum(sizes) == n * (lm.CLASSES + lm.MEMBERS)
