"""Periodic runs against a brute-force search of every lag."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from polysafe.llm import periods


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(r for r in found if not any(p < r[2] and s <= r[0] and s + m >= r[0] + r[1] for s, m, p in found))


def brute_row(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *best, None if best[0] is None else best[1] * 1000 // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts():
    rng = random.Random(5)
    unit = lambda q, a="abcdefghij": [rng.choice(a) * rng.randint(1, 3) for _ in range(q)]
    noise = lambda n: [f"n{rng.randrange(10 ** 6)}" for _ in range(n)]
    out = [None, "", " \t ", "one", "a " * 23, "a " * 24, "a\x0b" * 25, "  " * 30, "ä ö " * 40]
    for q in (1, 2, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40, 64, 65, 130):
        for extra in (-1, 0, 1, q // 2, 3 * q):
            u = unit(q)
            n = max(24, 3 * q) + extra
            out.append(" ".join(noise(rng.randint(0, 9)) + [u[i % q] for i in range(n)] + noise(rng.randint(0, 9))))
    for _ in range(60):  # few letters: many runs of several periods that overlap
        out.append(" ".join(rng.choice("ab") for _ in range(rng.randint(20, 300))))
        u = unit(rng.randint(1, 12), "ab")
        v = u * rng.randint(2, 9) + unit(rng.randint(1, 6), "ab")
        out.append(" ".join(noise(3) + v * rng.randint(2, 6) + u * 9 + noise(2)))
    out += [" ".join(["x"] * 5000), " ".join(["x", "y"] * 900 + ["x"] * 900 + ["x", "y"] * 900)]
    return out


def test_rows_against_brute_force(spark):
    rows = [(k, t, "clash") for k, t in enumerate(texts())] + [(None, "b " * 30, "c"), (None, None, None), (3, "b " * 30, "c"), (3, "b " * 30, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = periods.digests(periods.periodic_runs(docs)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute_row(t)) for i, t, _ in rows), key=repr)


def test_runs_and_text_themselves(spark):
    docs = spark.createDataFrame([(1, "p  q r\n" + "u v w " * 9 + "u z")], "doc_id long, text string")
    (r,) = periods.periodic_runs(docs).collect()
    assert [tuple(x) for x in r.runs] == [(3, 28, 3)] and r.collapsed == "p q r u v w z" and r.n_words == 32


def test_seeds_stay_linear_on_one_repeated_word():
    n = 200_000
    found = list(periods.seeds(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, n)))
    assert sum(len(p) for p, _ in found) < n
    assert periods.runs_of(np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, n)) == [(0, 0, n, 1)]


def test_long_period_in_a_long_text():
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 50, 30_000)
    ids = np.concatenate([rng.integers(100, 200, 500), np.tile(unit, 4)[:100_000], rng.integers(100, 200, 500)])
    zero = np.zeros(len(ids), np.int64)
    assert periods.runs_of(ids, zero, zero, np.full(len(ids), len(ids))) == [(0, 500, 100_000, 30_000)]


def test_empty_table(spark):
    assert periods.digests(periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


@pytest.mark.parametrize("cut", [0, 1, 5])
def test_neighbouring_documents_do_not_meet(spark, cut):
    docs = spark.createDataFrame([(k, "a b " * (6 - (k == cut))) for k in range(6)], "doc_id long, text string").coalesce(1)
    assert all(not r.runs for r in periods.periodic_runs(docs).collect())
