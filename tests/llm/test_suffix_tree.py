import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipcast.llm import common, suffix_tree

from . import helpers

END = None


def _tokens(text):
    return (text or "").encode().lower().split() + [END]


class _BruteTree:
    """The same tree from plain dictionaries."""

    def __init__(self, texts, least, depth):
        docs = [_tokens(t) for t in texts]
        self.counts = collections.Counter(t for d in docs for t in d)
        self.n, self.v = sum(self.counts.values()), len(self.counts)
        self.least = least
        grams = collections.Counter(tuple(d[i:i + k]) for d in docs for k in range(2, depth + 2)
                                    for i in range(len(d) - k + 1))
        frequent = {(t,) for t, c in self.counts.items() if c >= self.least} | {(END,)}
        self.grams = {g: c for g, c in grams.items() if c >= self.least and all((t,) in frequent for t in g)}
        self.grams = {g: c for g, c in self.grams.items()
                      if len(g) == 2 or (g[:-1] in self.grams and g[1:] in self.grams)}
        self.states, self.depth = {}, depth
        for k in range(1, depth + 1):
            contexts = collections.defaultdict(dict)
            for g, c in self.grams.items():
                if len(g) == k + 1:
                    contexts[g[:-1]][g[-1]] = c
            new = {}
            for s, entries in contexts.items():
                total = self.counts[s[0]] if k == 1 else self.grams[s]
                kept = {t: max(c - suffix_tree.DISCOUNT, 0) for t, c in entries.items()}
                escape = 1 - sum(kept.values()) / total
                parent = {t: self.probability(s[1:], t) for t in entries}
                p = {t: kept[t] / total + escape * parent[t] for t in entries}
                gain = sum(total * p[t] * math.log(p[t] / parent[t]) for t in entries)
                gain += total * max(escape * (1 - sum(parent.values())), 0) * math.log(max(escape, 1e-12))
                if gain >= 2 * (len(entries) + 1):
                    new[s] = (p, escape)
            self.states.update(new)

    def probability(self, context, token):
        for k in range(len(context), 0, -1):
            s = tuple(context[len(context) - k:])
            if s in self.states:
                p, escape = self.states[s]
                return p[token] if token in p else escape * self.probability(s[1:], token)
        return (self.counts[token] + 1) / (self.n + self.v + 1)

    def score(self, text):
        tokens = _tokens(text)
        return sum(math.log10(self.probability(tokens[max(0, i - self.depth):i], t)) for i, t in enumerate(tokens))


def _held(doc_id, modulus=7, remainder=2):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def _chained(spark, n=150):
    """Texts whose next word depends on the two words before it."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(12)]
    follow = rng.dirichlet(np.full(12, 0.15), size=(12, 12))
    rows = []
    for i in range(n):
        a, b, text = 0, 1, []
        for _ in range(rng.integers(0, 70)):
            a, b = b, rng.choice(12, p=follow[a, b])
            text.append(words[b])
        rows.append((i, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)


@pytest.mark.parametrize("least,depth", [(2, 4), (20, 2), (2, 1)])
def test_scores_equal_a_dictionary_tree(spark, least, depth):
    docs, texts = _chained(spark)
    held = common.crc32_held(F.col("doc_id"), 7, 2)
    rows = suffix_tree.suffix_tree_scores(docs, held, least, depth).collect()
    brute = _BruteTree([t for i, t in texts.items() if not _held(i)], least, depth)
    assert len(rows) == len(texts) and len(brute.states) > 5
    for r in rows:
        tokens = _tokens(texts[r.doc_id])
        assert r.held_out == _held(r.doc_id)
        assert (r.n_tokens, r.train_tokens) == (len(tokens), brute.n)
        assert r.n_known == sum(brute.counts[t] > 0 for t in tokens)
        base = sum(math.log10((brute.counts[t] + 1) / (brute.n + brute.v + 1)) for t in tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(brute.score(texts[r.doc_id]), rel=1e-9)


def test_states_are_distributions(spark):
    tree = _BruteTree(_chained(spark)[1].values(), 2, 3)
    assert tree.states
    for s in tree.states:
        total = sum(tree.probability(list(s), t) for t in tree.counts)
        unseen = tree.states[s][1]
        k = s
        while len(k) > 1:  # one unseen word takes the escapes times the root's share for it
            k = k[1:]
            unseen *= tree.states[k][1] if k in tree.states else 1
        assert total + unseen / (tree.n + tree.v + 1) == pytest.approx(1)


def test_held_out_text_scores_above_the_base(spark):
    rows = suffix_tree.query(spark, "/root/testdata/sf0.01").where("held_out").agg(
        F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_awkward_rows_and_empty_tables(spark):
    held = common.crc32_held(F.col("doc_id"), 7, 2)
    rows = suffix_tree.suffix_tree_scores(helpers.awkward(spark), held).collect()
    brute = _BruteTree([r[1] for r in helpers.AWKWARD if not _held(r[0])], suffix_tree.MIN_COUNT, suffix_tree.MAX_DEPTH)
    want = sorted((str(r[0]), round(brute.score(r[1]), 5)) for r in helpers.AWKWARD)
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in rows) == want
    assert suffix_tree.suffix_tree_scores(helpers.empty(spark), held).count() == 0
    untaught = suffix_tree.suffix_tree_scores(helpers.awkward(spark), F.lit(True)).collect()
    assert all(r.score == r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in untaught)


def test_small_counts_teach_in_a_large_corpus(spark):
    """A pair seen three times counts the same beside 600,000 other tokens."""
    filler = " ".join(f"w{i}" for i in np.random.default_rng(2).integers(0, 40, 200_000))
    texts = dict(enumerate([filler] * 3 + ["glass harbour lantern violet"] * 3 + ["glass harbour lantern", "harbour lantern violet"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = suffix_tree.suffix_tree_scores(docs, F.col("doc_id") >= 6, max_depth=2).where("doc_id >= 3").collect()
    brute = _BruteTree([t for i, t in texts.items() if i < 6], 2, 2)
    assert len(rows) == 5 and brute.least == 2
    for r in rows:
        assert r.score == pytest.approx(brute.score(texts[r.doc_id]), rel=1e-9)


def test_query_equals_a_dictionary_tree_on_a_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in common.documents(spark, sf_dir).collect()}
    brute = _BruteTree([t for i, t in texts.items() if not _held(i)], suffix_tree.MIN_COUNT, suffix_tree.MAX_DEPTH)
    rows = suffix_tree.query(spark, sf_dir).collect()
    assert len(rows) == len(texts) and brute.states
    for r in rows:
        assert (r.train_tokens, r.n_tokens) == (brute.n, len(_tokens(texts[r.doc_id])))
        assert r.score == pytest.approx(brute.score(texts[r.doc_id]), rel=1e-9)


def test_a_home_is_bounded_however_large_the_partition(spark, monkeypatch):
    """A task of a pass holds a home at a time: all rows of one partition are many homes, with the same scores."""
    docs, texts = _chained(spark)
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 300)
    monkeypatch.setattr(suffix_tree, "HOME_BYTES", 2_000)
    one = docs.coalesce(1)
    blocks = suffix_tree._cut(one, F.col("doc_id") < 0, 2).select("home", "block", "doc_ids").collect()
    homes = collections.defaultdict(list)
    for r in blocks:
        homes[r.home] += suffix_tree._unpack(r.doc_ids, np.int64).tolist()
    assert sorted(i for ids in homes.values() for i in ids) == sorted(texts)
    assert len({r.block for r in blocks}) == len(blocks) > len(homes) > 3
    for ids in homes.values():
        assert sum(len(texts[i]) + 8 for i in ids) <= 2_000
    brute = _BruteTree([t for i, t in texts.items() if not _held(i)], 2, 4)
    rows = suffix_tree.suffix_tree_scores(one, common.crc32_held(F.col("doc_id"), 7, 2)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(brute.score(texts[r.doc_id]), rel=1e-9)
