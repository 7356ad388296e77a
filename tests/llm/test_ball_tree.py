"""Ball tree search against scoring all documents, its bounds, and that it prunes."""

import math
import random
import re
from collections import Counter

import numpy as np

from kerf.llm import ball_tree

DOCS = "doc_id long, text string, item long, score string, rank int, n int, terms int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, top=10):
    """Rows item_id, rank, doc_id, score by the definition."""
    low = lambda t: TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(i, Counter(w), len(w)) for i, w in ((i, low(t)) for i, t in docs) if w]
    n_docs, n_words, df = len(counted), sum(n for *_, n in counted), Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(low(t))
    out = []
    for i, terms in asked.items():
        rows = []
        for d, c, n in counted:
            m = 10 + 90 * n * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            rows += [(-s, d is None, d or 0, d)] if s > 0 else []
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=repr)


def corpus(n, seed=9):
    r = random.Random(seed)
    names = [f"{a}{b}" for a in ("Ka", "lo", "Ér", "9x", "mu") for b in ("n", "tel", "ß", "vi", "漢", "ri", "so", "2")]
    word = lambda: names[int(len(names) * r.random() ** 2)]
    docs = [(i, ", ".join(word() for _ in range(r.randint(1, 60)))) for i in range(n)]
    items = [(k, " ".join(word() for _ in range(r.randint(1, 12)))) for k in range(25)]
    docs += [(n + k, f"{docs[k][1]} {t} {t}") for k, (_, t) in enumerate(items)]
    same = items[4][1] + " more"
    docs += [(10000 - i, same) for i in range(400)]
    docs += [(7, None), (8, ""), (9, " -- \x7f"), (None, same), (11, docs[11][1]), (20000, " ".join(word() for _ in range(20000)))]
    items += [(None, "ka"), (None, "LO kan"), (30, None), (31, "absent"), (32, ""), (4, "kan kan")]
    return docs, items


def test_against_all_scores(spark):
    docs, items = corpus(600)
    df = spark.createDataFrame([(i, t, 1, "s", 2, 3, 4) for i, t in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(i, t, 1, "w") for i, t in items], "item_id long, text string, doc_id long, rank string")
    want = plain(docs, items)
    for options in ({}, {"block": 50, "leaf": 4}, {"most_postings": 40}):
        got = ball_tree.search(df, bench, **options)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_bounds_hold_and_prune():
    r = np.random.default_rng(4)
    n, v = 3000, 400
    rows = []
    for i in range(n):
        family = i % 20
        terms = np.unique(r.choice(20, 12) + family * 20)
        rows.append((terms, r.integers(1, 10**6, len(terms))))
    indptr = np.append(0, np.cumsum([len(t) for t, _ in rows]))
    terms, impacts = (np.concatenate([x[k] for x in rows]) for k in (0, 1))
    items = ball_tree.Items(list(range(20)), [np.arange(k * 20, k * 20 + 20) for k in range(20)], {})
    space, spaces = ball_tree.subspaces(items, np.bincount(terms, minlength=v))
    tree = ball_tree.Block(indptr, terms, impacts, space, spaces)
    leaves = sum(c is None for c in tree.children)
    for k in range(20):
        q, w = items.terms[k], r.integers(1, 9000, 20)
        full = np.zeros(v, np.int64)
        full[q] = w
        scores = np.array([int((i * full[t]).sum()) for t, i in rows])
        bounds = tree.bounds(q, w.astype(float))
        assert all(bounds[node] >= scores[members].max() for node, members in enumerate(tree.rows))
        best = []
        scored = tree.search(q, w, best, list(range(n)), 10)
        assert sorted((-h.score, h.doc) for h in best) == sorted(zip((-scores).tolist(), range(n)))[:10]
        assert scored < leaves / 4


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, q in ((docs, items), (docs, asked), (some, items)):
        assert ball_tree.search(d, q).count() == 0
    # A term that every document has weighs nothing among so few.
    assert [tuple(r) for r in ball_tree.search(some, asked).collect()] == plain([(1, "a b")], [(1, "a")])
