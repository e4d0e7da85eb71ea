"""Ranked lexical search, the k-means tree and periodic runs, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from concord.llm import kmeans_tree, lexical, periodic, queries
from concord.llm.common import words
from llm_cases import SMALL, make_docs, odd, small_docs  # noqa: F401

# --- ranked lexical search

TERM = re.compile(lexical.TERM)
ITEMS = "item_id long, text string, item long, tile long, term string"


def plain_terms(text):
    return TERM.findall((text or "").translate(str.maketrans(lexical.UPPER, lexical.LOWER)))


def plain_search(docs, items, k=50):
    """Rows (item_id, rank, doc_id, score) by the definition."""
    own = [(i, plain_terms(t)) for i, t in docs]
    own = [(i, t, Counter(t)) for i, t in own if t]
    n_docs, n_terms = len(own), sum(len(t) for _, t, _ in own)
    holds = Counter(t for _, _, c in own for t in c)
    rows = []
    for item_id, text in items:
        found = []
        for doc_id, t, c in own:
            m = 50 + 50 * len(t) * n_docs // n_terms
            score = 0
            for term in set(plain_terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holds[term] + 1)))
                score += w * (10**9 * c[term] // (1000 * c[term] + 20 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(found)[:k], 1):
            rows.append((item_id, rank, None if none else doc_id, -score))
    return sorted(rows, key=repr)


def searched(spark, make_docs, docs, items, k=50):
    given = spark.createDataFrame([(*r, 5, 6, "x") for r in items], ITEMS).repartition(2)
    return sorted(map(tuple, lexical.search(make_docs(docs), given, k).collect()), key=repr)


def test_lexical_on_the_tables(spark, make_docs, small_docs):
    items = duckdb.sql(f"select item_id, text from read_parquet('{SMALL}/benchmark.parquet')").fetchall()
    got = sorted(map(tuple, queries.op11_lexical(spark, SMALL).collect()), key=repr)
    assert got == plain_search(small_docs, items)


def test_lexical_odd_texts_ties_and_repeats(spark, make_docs, odd):
    docs = list(enumerate([*odd, *["Rare WORD here"] * 70, "ÀB İstanbul a1b2", "rare-word rare"]))
    docs += [(None, "rare word"), (None, "rare word"), (7, "rare word"), (7, "rare word")]
    items = [(1, "rare WORD word"), (1, "rare WORD word"), (2, None), (3, ""), (4, "?!"), (5, "unseen"), (None, "İstanbul a1b2")]
    assert searched(spark, make_docs, docs, items) == plain_search(docs, items)
    assert searched(spark, make_docs, docs, items, 3) == plain_search(docs, items, 3)


def test_lexical_many_tiles(spark, make_docs, monkeypatch):
    r = random.Random(5)
    some = [f"w{min(int(r.expovariate(0.02)), 400)}" for _ in range(4000)]
    docs = [(i, " ".join(r.choices(some, k=r.randrange(40)))) for i in range(300)]
    items = [(i, " ".join(r.choices(some, k=r.randrange(60)))) for i in range(80)]
    want = plain_search(docs, items, 7)
    monkeypatch.setattr(lexical, "DOC_TILE", 16)
    monkeypatch.setattr(lexical, "ITEM_TILE", 9)
    monkeypatch.setattr(lexical, "TILE_TERMS", 50)
    monkeypatch.setattr(lexical, "CHUNK", 13)
    monkeypatch.setattr(lexical, "COUNTED", 20)
    for held in (0, 4000, 64 << 20):  # no tile stays in memory, some do, all do
        monkeypatch.setattr(lexical, "HELD_BYTES", held)
        assert searched(spark, make_docs, docs, items, 7) == want


def test_lexical_partial_sums_stay_exact():
    assert lexical.CHUNK * 2**22 * lexical.IMPACT / 1000 < 2**53


def test_lexical_empty_tables(spark, make_docs):
    assert searched(spark, make_docs, [], [(1, "a")]) == []
    assert searched(spark, make_docs, [(1, "a"), (2, "b")], []) == []
    assert searched(spark, make_docs, [(1, None)], [(1, "a")]) == []


# --- k-means tree


def table_of(spark, rows):
    given = [(i, v, 1, 2.0, [3]) for i, v in rows]
    return spark.createDataFrame(given, "vec_id long, embedding array<float>, row long, v double, leaves array<int>").repartition(3)


def found_by(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(rows)] for q, rows in got.items()}


def exact(rows, k, every):
    """Neighbours of each query by brute force; queries by place, as ids can repeat."""
    rows = [(i, np.array(v, dtype="float32").astype(float)) for i, v in rows]
    out = []
    for at, (i, v) in enumerate(rows):
        if i is not None and i % every == 0:
            near = [(-float(v @ w), j is None, j or 0) for n, (j, w) in enumerate(rows) if n != at]
            out.append((i, sorted(near)[:k]))
    return out


@pytest.mark.parametrize("shape", ["random", "clusters", "norms"])
def test_tree_recall(spark, shape):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 16))
    if shape == "clusters":
        x = r.normal(size=(40, 16))[r.integers(40, size=3000)] + 0.1 * x
    if shape == "norms":
        x = x * r.lognormal(sigma=0.7, size=(3000, 1))
    rows = list(zip(range(3000), x.tolist(), strict=True))
    got = found_by(kmeans_tree.search(table_of(spark, rows)))
    hits = total = 0
    for i, near in exact(rows, 20, 20):
        assert len(got[i]) == 20 and got[i] == sorted(got[i], key=lambda p: (-p[1], p[0]))
        true = {j: -s for s, _, j in near}
        assert i not in dict(got[i])
        for j, s in got[i]:
            assert j not in true or abs(true[j] - s) < 1e-9
        hits, total = hits + len(true.keys() & dict(got[i]).keys()), total + 20
    assert hits / total >= 0.9


def test_tree_recall_on_the_table(spark):
    rows = duckdb.sql(f"select vec_id, embedding from read_parquet('{SMALL}/embeddings.parquet')").fetchall()
    got = found_by(queries.op12_kmeans_tree(spark, SMALL))
    want = exact(rows, 20, 20)
    assert got.keys() == {i for i, _ in want}
    hits = sum(len({j for _, _, j in near} & dict(got[i]).keys()) for i, near in want)
    assert hits >= 0.9 * 20 * len(want)


def test_tree_visits_fewer_rows_where_vectors_cluster(spark):
    r = np.random.default_rng(4)
    x = 5 * r.normal(size=(60, 8))[r.integers(60, size=4000)] + 0.05 * r.normal(size=(4000, 8))
    index = kmeans_tree.Index(table_of(spark, list(zip(range(4000), x.tolist(), strict=True))))
    visits, share = index.calibrate(index.table.filter("place = 1 and vec_id % 20 = 0"))
    assert share >= 0.95 and visits < index.tree.n_leaves / 5


def test_tree_one_vector_fills_a_third(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LANE_ROWS", 64)
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 4)).round(1)
    x[::3] = [0.5, -0.5, 0.5, 0.5]
    ids = [*range(600)]
    ids[5], ids[6], ids[7], ids[9] = 0, None, None, 40
    rows = list(zip(ids, x.tolist(), strict=True))
    index = kmeans_tree.Index(table_of(spark, rows), k=25)
    assert index.table.count() < 450  # 26 rows of the copies stay
    got = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in index.search(every=20, target=1.0).collect())
    want = Counter(
        (i, n, None if none else j, round(-s, 9)) for i, near in exact(rows, 25, 20) for n, (s, none, j) in enumerate(near, 1)
    )
    same = sum((got & want).values())
    assert got.total() == want.total() and same >= 0.97 * want.total()
    copies = [r for r in got if r[0] == 60]
    assert sorted(copies) == sorted(r for r in want if r[0] == 60)


def test_tree_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0]), (1, [0.5, 2.0]), (2, None), (40, [0.0, 0.0]), (60, []), (80, [nan, 1.0])]
    rows += [(100, [None, 1.0]), (120, [inf, 1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (3, [-1.0, 0.0])]
    got = kmeans_tree.search(table_of(spark, rows)).collect()
    usable = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 2.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (3, [-1.0, 0.0])]
    want = [(i, n, None if none else j, -s) for i, near in exact(usable, 20, 20) for n, (s, none, j) in enumerate(near, 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_tree_empty_and_single(spark):
    assert kmeans_tree.search(table_of(spark, [])).collect() == []
    assert kmeans_tree.search(table_of(spark, [(0, None), (20, [0.0])])).collect() == []
    assert kmeans_tree.search(table_of(spark, [(0, [1.0])])).collect() == []
    assert kmeans_tree.search(table_of(spark, [(1, [1.0]), (2, [2.0])])).collect() == []


# --- periodic runs


def plain_runs(text):
    """Lag by lag; of lags that give one stretch the smallest is its period."""
    n, found = len(text), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            start = i
            while i < n and text[i] == text[i - q]:
                i += 1
            if i - start + q >= max(24, 3 * q) and i > start:
                found.setdefault((start - q, i - start + q), q)
            i += i == start
    return sorted([(s, n, q) for (s, n), q in found.items()], key=lambda r: (r[0], r[2]))


def periodic_texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        some = [b"%d" % i for i in range(r.choice([1, 2, 2, 3, 5, 50]))]
        text = r.choices(some, k=r.randrange(120))
        for _ in range(r.randrange(4)):
            if text:
                a, p = r.randrange(len(text)), r.randrange(1, 60)
                text = text[:a] + text[a : a + p] * r.randrange(1, 8) + text[r.choice([a, a + p]) :]
        yield text[:900]


def test_runs_match_brute_force():
    texts = list(periodic_texts(1, 1500))
    want = [plain_runs(t) for t in texts]
    assert sum(map(len, want)) > 1000
    assert periodic.find_runs(texts) == want
    assert [periodic.find_runs([t])[0] for t in texts[:100]] == want[:100]


def test_runs_inside_runs():
    x, y = [b"a"], [b"a", b"b"]
    while len(y) < 1500:  # a word with as many runs as there can be
        x, y = y, y + x
    found = periodic.find_runs([y, y + y[:700] + [b"c"] + y])
    assert found[0] == plain_runs(y) and len(found[0]) > 100
    assert found[1] == plain_runs(y + y[:700] + [b"c"] + y)


def test_runs_survive_equal_hashes(monkeypatch):
    monkeypatch.setattr(periodic, "mixed", lambda a, b: (a + b) % np.uint64(3))
    texts = list(periodic_texts(2, 150))
    assert periodic.find_runs(texts) == [plain_runs(t) for t in texts]


def test_runs_of_a_long_text_of_one_word():
    assert periodic.find_runs([[b"a"] * 300_000, [], [b"a"] * 23, [b"a"] * 24]) == [[(0, 300_000, 1)], [], [], [(0, 24, 1)]]


def plain_digest(doc_id, text):
    own = words(text)
    if doc_id is not None and own and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(own)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(own)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = (None,) * 4
    if runs:
        s, n, q = min(runs, key=lambda r: (-r[1] * math.lcm(*[x[2] for x in runs]) // r[2], r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    left = hashlib.sha256(b" ".join(w for i, w in enumerate(own) if i not in gone)).hexdigest()
    return doc_id, len(runs), *best, listed, left


def test_periodic_digest(spark, make_docs, small_docs, odd):
    texts = odd + [b" ".join(t).decode() for t in periodic_texts(3, 60)]
    short = [(i, t) for i, t in small_docs if len(t or "") < 6000]
    docs = [*short, *((10_000 + i, t) for i, t in enumerate(texts)), (None, "a " * 40), (None, None), (10_003, "x y")]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in short)
    got = sorted(map(tuple, periodic.digest(make_docs(docs)).collect()), key=repr)
    assert got == sorted((plain_digest(*d) for d in docs), key=repr)
    assert periodic.digest(make_docs([])).collect() == []


def test_periodic_query_on_the_table(spark, small_docs):
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic(spark, SMALL).collect()}
    assert len(got) == len(small_docs)
    for i, text in small_docs:
        if len(text or "") < 20_000:
            assert got[i] == plain_digest(i, text)


def test_runs_and_collapsed_texts(make_docs, monkeypatch):
    monkeypatch.setattr(periodic, "GROUP_WORDS", 10)
    docs = make_docs([(1, "go  " + "a b c " * 9 + "end"), (2, "plain  text"), (3, None), (None, "x " * 24), (5, "")])
    assert sorted(map(tuple, periodic.runs(docs).collect()), key=repr) == [(1, 1, 27, 3), (None, 0, 24, 1)]
    done = periodic.collapse(docs)
    assert done.columns == docs.columns
    assert {(r.doc_id, r.text, r.label) for r in done.collect()} == {
        (1, "go a b c end", "x"), (2, "plain  text", "x"), (3, None, "x"), (None, "x", "x"), (5, "", "x"),
    }
