"""Ranked search against scores of all documents, and the best-position search against whole sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical_search
from tidemark.llm.lexical_search import Lists, Search

SCHEMA = "doc_id long, text string, term string, block int, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def corpus():
    g = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éa", "ß", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    make = lambda n: " ".join(g.choices(words, weights, k=n))
    texts = [make(g.randrange(1, 60)) for _ in range(120)]
    texts += [texts[3]] * 30 + [texts[5].upper()] * 3 + [None, "", "!!! --", "W1,w1;w1-W1", make(20_000), "w59 " * 400]
    rows = [(7 * i + (2**60 if i % 9 == 0 else 0), t, "t", 1, "s") for i, t in enumerate(texts)]
    rows += [(None, texts[3], "t", 1, "s"), (None, texts[7], None, None, None), rows[4], rows[4], (rows[4][0], texts[11], "t", 1, "s")]
    items = [(i, make(g.randrange(1, 25))) for i in range(12)] + [(50, texts[3]), (51, "nothing of these"), (52, None), (53, "w1 w1 w1 w2"), (54, "w59"), (None, "w2 w3")]
    return rows, items + [items[0], (1, "w9 w8")]


def brute(rows, items, k):
    docs = [(i, Counter(ts), len(ts)) for i, t, *_ in rows if (ts := terms(t))]
    n, length = len(docs), sum(x for *_, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text in sorted(set(items), key=str):
        found = []
        for doc_id, counts, size in docs:
            m = 75 + (25 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in terms(text) if t in counts)
            if s > 0:
                found.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("search", [Search(), Search(block_docs=7, pairs=11, cells=40, depth=1), Search(block_postings=50, vocabulary=3, depth=3)])
def test_search_matches_scores_of_all(spark, search):
    rows, items = corpus()
    docs, benchmark = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.ranked(docs, benchmark, search)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items, search.k)


def test_empty_tables(spark):
    rows, items = corpus()
    docs, benchmark = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.ranked(docs.limit(0), benchmark).count() == 0
    assert lexical_search.ranked(docs, benchmark.limit(0)).count() == 0
    assert lexical_search.ranked(docs.where("text is null"), benchmark).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_positions_find_the_best(seed):
    g = np.random.default_rng(seed)
    n_terms, n_docs, k = 6, 300, 5
    dense = g.integers(0, 8 if seed % 2 else 10_000, (n_terms, n_docs)) * (g.random((n_terms, n_docs)) < g.random((n_terms, 1)))
    term, doc = np.nonzero(dense)
    lists = Lists(term, doc, dense[term, doc], n_terms, n_docs)
    terms_, times = np.array([0, 2, 3, 5]), np.array([1, 2, 1, 3])
    docs, scores, _ = lists.best(terms_, times, k, 1)
    whole = (dense[terms_] * times[:, None]).sum(axis=0)
    assert (whole[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
    kth = np.sort(whole)[-k]
    assert set(np.flatnonzero(whole >= max(kth, 1)).tolist()) <= set(docs.tolist())  # ties at the kth are all met


def test_best_positions_stop_early():
    """Where the lists agree, a few positions settle the best, and the bound by last-read positions would read further."""
    n = 5000
    doc = np.tile(np.arange(n), 3)
    impact = np.concatenate([(n - np.arange(n)) ** 2 + j for j in range(3)])
    lists = Lists(np.repeat(np.arange(3), n), doc, impact, 3, n)
    docs, scores, met = lists.best(np.arange(3), np.ones(3, dtype=np.int64), 20, 8)
    assert met < 100 and set(range(20)) <= set(docs.tolist())


def test_looking_up_advances_positions():
    """A document looked up in a list counts as a seen position there: the bound falls below what reading alone gives."""
    lists = Lists(np.array([0, 0, 0, 1, 1, 1]), np.array([0, 1, 2, 1, 0, 2]), np.array([9, 8, 1, 9, 8, 1]), 2, 3)
    docs, scores, met = lists.best(np.arange(2), np.ones(2, dtype=np.int64), 2, 1)
    assert met == 2 and sorted(scores.tolist()) == [17, 17]  # after one read of each list, positions 1 and 2 are seen in both
