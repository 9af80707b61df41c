"""Operators on embeddings and spellings against brute-force versions, with nulls, ties, repeats, clashing columns and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.oracle import compare
from tickloom.llm import centroids, embedding_dedup, queries, spelling

SCHEMA = "vec_id long, embedding array<float>, label int, cid long, n long, key string"


def usable(r):
    return r[1] is not None and len(r[1]) and all(c is not None and math.isfinite(c) for c in r[1])


def brute_links(rows, threshold=0.98):
    ok = [r[0] is not None and r[2] is not None and usable(r) and any(r[1]) for r in rows]
    x = [np.array(r[1], np.float32).astype(float) if k else None for r, k in zip(rows, ok)]
    top, n = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations([i for i in range(len(rows)) if ok[i]], 2):
        if rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= threshold:
            n[i], n[j], top[max(root(i), root(j))] = n[i] + 1, n[j] + 1, min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0]) if r[0] is not None else r[0]
    return Counter((r[0], n[i], least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(rows))


def planted(seed=1, groups=12, copies=25):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for g in range(groups):
        base = rng.standard_normal(16)
        for c in range(copies if g else 8 * copies):
            v = base + rng.standard_normal(16) * rng.choice([0.02, 0.12, 0.16, 0.3])
            rows.append((k, [float(np.float32(a)) for a in v], g % 3, c, 1, "x"))
            k += 1
    odd = [(k, None, 1), (k + 1, [], 1), (k + 2, [0.0] * 16, 1), (k + 3, [None] * 16, 1), (k + 4, [float("nan")] * 16, 1), (k + 5, rows[5][1], None), (None, rows[5][1], 0), (k + 6, rows[5][1], 1), (k + 7, [1.0, 2.0], 0), (k + 8, [2.0, 4.0], 0), (k + 9, [3e38] * 16, 2), (k + 10, [-3e38] * 16, 2), (k + 11, [1e-40] * 16, 2)]
    odd += [(k + 20 + i, rows[7][1], 0) for i in range(30)] + [(rows[3][0], rows[3][1], 0), (4, rows[9][1], 0)]
    return rows + [(*r, 0, 0, None) for r in odd]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates(spark, block):
    rows = planted()
    random.Random(2).shuffle(rows)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == brute_links(rows)


def test_near_duplicates_of_nothing(spark):
    for rows in ([], [(1, None, None, 0, 0, "")]):
        got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert [tuple(r) for r in got] == [(1, 0, 1, True)] * len(rows)


def test_tables_find_pairs_at_the_threshold():
    for n in (2, 1000, 10**6, 10**10):
        bits, tables = embedding_dedup.plan(n)
        assert (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables <= 1e-6 and n <= 2**bits
    rng = np.random.default_rng(4)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((2000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1)[:, None]
    bits, tables = embedding_dedup.plan(2000)
    same = embedding_dedup.signatures(a, bits, tables) == embedding_dedup.signatures(b, bits, tables)
    assert same.any(axis=1).all() and abs(same.mean() - (1 - math.acos(0.98) / math.pi) ** bits) < 0.01


def brute_lloyd(rows, k=8, rounds=10, dim=64):
    kept = [(r[0], [math.floor(1024 * float(np.float32(c))) for c in r[1]]) for r in rows if usable(r) and len(r[1]) == dim and max(map(abs, r[1])) < 2**17]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    c = [x for _, x in sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), i) for i, y in enumerate(c))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for i in range(len(c)):
            own = [x for (_, x), j in zip(kept, at) if i == j]
            c[i] = [sum(col) // len(own) for col in zip(*own)] if own else c[i]
    got = [(v, *near(x)) for v, x in kept]
    total = Counter()
    for _, d, i in got:
        total[i] += d
    return Counter((v, i, d, total[i], sum(total.values()), sha(",".join(map(str, c[i])))) for v, d, i in got)


def test_centroids(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(64) + 2 * (i % 5)], 0, 0, 0, "") for i in range(150)]
    odd = [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("inf")] * 64), (904, [3e38] * 64), (None, rows[4][1]), (905, [-0.5] * 64), (2**62 + 1, rows[4][1]), (3, rows[3][1])]
    rows += [(*r, 0, 0, 0, "") for r in odd]
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert [f"{c} {t}" for c, t in got.dtypes] == centroids.RESULT.replace("long", "bigint").split(", ")
    assert Counter(map(tuple, got.collect())) == brute_lloyd(rows)


def test_centroids_of_few(spark):
    rows = [(i, [float(i % 2)] * 64, 0, 0, 0, "") for i in range(5)]
    assert Counter(map(tuple, centroids.cluster(spark.createDataFrame(rows, SCHEMA)).collect())) == brute_lloyd(rows)
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_words(rows, least=3):
    n = Counter()
    for name, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_groups(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def spelt():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeé×ÀZ") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "abababa", "Straße", "strasse"]
    rows = []
    for i in range(400):
        text = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.06)), len(base) - 1)]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + "a" + w[k:], w[:k] + w[k + 1 :], w[:k] + "b" + w[k + 1 :]])
            text.append(w)
        rows.append((i, rng.choice([" ", "1", "漢", "\n"]).join(text), 1, "x"))
    return [*rows, (None, "Straße STRASSE", 0, ""), (5, None, 0, ""), (6, "", 0, ""), (7, "12 !", 0, ""), rows[3], (8, "chain chaim chaim " + "chains chains chains chains " * 3, 0, "")]


@pytest.mark.parametrize("lot", [1 << 20, 500])
def test_spelling(spark, lot, monkeypatch):
    rows = spelt()
    want = brute_groups(rows)
    assert sum(f is not None for _, f, *_ in want) > 50 and any(f != r for _, f, r, *_ in want if f is not None)
    monkeypatch.setattr(spelling, "LOT", lot)
    got = spelling.group(spark.createDataFrame(rows, "doc_id long, text string, n long, word string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_spelling_neighbours_are_all_and_distinct():
    alphabet = np.array([97, 98, 233], np.uint32)
    letters = [chr(c) for c in alphabet]
    full = np.full(1 << (spelling.BITS - 3), 255, np.uint8)
    for w in ("aabba", "ababé", "aaaaaa"):
        got = list(spelling.neighbours([w, w[::-1]], alphabet, full))
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in letters if i + k <= len(w)}
        assert len(got) == len(set(got)) or w == w[::-1]
        assert {c for v, c in got if v == w} == want - {w}


def test_spelling_of_nothing(spark):
    assert spelling.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spelling_of_a_long_text(spark):
    long = "verylongtextwithoutspaces" * 80_000
    rows = [(1, long + " " + "words " * 300_000), (2, long + " wordz wordz wordz"), (3, long)]
    got = {r.word: r for r in spelling.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["wordz"].form == "words" and len(got) == len(brute_words(rows))


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_centroids"])
def test_sql(spark, name):
    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01") is None
