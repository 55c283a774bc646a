"""Both substring operators against brute force on texts full of repeats."""

import hashlib
import random
import re

import pytest

from polysafe.llm import substring, suffix

SCHEMA = "doc_id long, text string, lo int, spans string, id long, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA)


def words_brute(rows, n):
    order = [(-1 if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for k, _, ws in order:
        for p in range(len(ws) - n + 1):
            w = tuple(ws[p:p + n])
            first[w] = min(first.get(w, k), k)
    out = []
    for k, i, ws in order:
        gone = set()
        for p in range(len(ws) - n + 1):
            if first[tuple(ws[p:p + n])] < k:
                gone.update(range(p, p + n))
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(ws) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def bytes_brute(rows, n):
    order = sorted(((-1 if i is None else i), i, (t or "").encode()) for i, t in rows)
    first = {}
    for k, _, b in order:
        for p in range(len(b) - n + 1):
            first[b[p:p + n]] = min(first.get(b[p:p + n], (k, p)), (k, p))
    out = []
    for k, i, b in order:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p:p + n]] < (k, p):
                gone[p:p + n] = b"\1" * n
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, alphabet, sep):
    """Random pieces, shared passages inside others, whole copies, runs of one symbol, ties and edges."""
    rng = random.Random(seed)
    passages = [[rng.choice(alphabet) for _ in range(rng.randrange(10, 60))] for _ in range(6)]
    rows = []
    for k in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [rng.choice(alphabet) for _ in range(rng.randrange(0, 30))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                a = rng.randrange(0, 8)
                parts += p[a:len(p) - rng.randrange(0, 8)]
        rows.append((1000 - k * 3, sep.join(parts)))
    rows += [(2000 + k, rows[k][1]) for k in range(4)] + [(2000, rows[0][1])]
    rows += [(3000, sep.join(["a"] * 200)), (3001, sep.join(["a"] * 50)), (3002, sep.join(["a"] * 12 + ["b"] + ["a"] * 14)), (3003, sep.join(["a", "b"] * 40))]
    return rows + [(None, rows[5][1]), (4000, None), (4001, ""), (4002, " \t\n ")]


@pytest.mark.parametrize("window", [13, 4, 29])
def test_word_windows(spark, window):
    rows = corpus(window, [*"abcdefgh", "é", "the", "of"], " ")
    rows[7] = (rows[7][0], rows[7][1].replace(" ", "\n \x0b", 9))
    got = substring.remove_repeats(frame(spark, rows), window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == words_brute(rows, window)
    for r in got:
        assert r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize(("window", "q"), [(100, 32), (20, 7), (12, 12)])
def test_byte_windows(spark, window, q):
    rows = corpus(window, [*"abc", "é", "the ", "of "], "" if window < 50 else "-")
    got = suffix.remove_repeats(frame(spark, rows), window=window, q=q).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == bytes_brute(rows, window)
    for r in got:
        assert sum(x.length for x in r.removed or []) == r.n_removed and len(r.removed or []) == r.n_spans


def test_long_text_across_slices(spark):
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    rows = [(1, body), (2, "x" * 150 + body[1000:200_000] + "y"), (3, "z" * 3_000)]
    got = {r.doc_id: r for r in suffix.remove_repeats(frame(spark, rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_removed) == (0, 199_000 + 149, 1, 2_999)


def test_symbols_are_the_same_in_any_surroundings():
    import numpy as np

    rng = np.random.default_rng(5)
    inner = rng.integers(0, 2**63, 40, dtype=np.uint64)
    seen = []
    for _ in range(20):
        left, right = rng.integers(0, 2**63, (2, 30), dtype=np.uint64)
        name, start = substring.compress(np.concatenate([left, inner, right]), np.zeros(100, np.int64), 2)
        past = np.append(start[1:], 100)
        inside = (start >= 33) & (past <= 67)
        seen.append([(int(n), int(s)) for n, s in zip(name[inside], start[inside])])
    assert all(set(a) & {x for x in b} == set(a) | set(b) for a in seen[:1] for b in seen if {s for _, s in a} == {s for _, s in b}) and len({tuple(x) for x in seen}) == 1


def test_empty_tables(spark):
    assert substring.remove_repeats(frame(spark, [])).collect() == [] and suffix.remove_repeats(frame(spark, [])).collect() == []


def _numbered(rows):
    """(number, id, text): distinct rows by id (null first), then digest of the text."""
    told = sorted({(i is not None, i or 0, hashlib.sha256((t or "").encode()).digest(), t or "") for i, t in rows})
    return [(k, i if known else None, t) for k, (known, i, _, t) in enumerate(told)]


SHARED = ["p q r s t u v w x y z a b c d " * 3, "p q r s t u v w x y z a b c d e f g h " * 3, "zz " * 60, "short"]
TWICE = [(1, SHARED[0]), (1, "short"), (1, "lead " + SHARED[0]), (0, SHARED[1]), (None, SHARED[0] + "a"), (None, SHARED[2]), (None, SHARED[2] + SHARED[1]),
         (5, SHARED[1]), (5, SHARED[1]), (5, None), (5, ""), (9, "x " * 40 + SHARED[0])]


def test_rows_that_share_an_id(spark):
    got = [tuple(r)[:-1] for r in substring.remove_repeats(frame(spark, TWICE)).collect()]
    assert sorted(got, key=repr) == words_brute(TWICE, 13)
    told = _numbered(TWICE)
    by_number = {r[0]: r[1:] for r in bytes_brute([(k, t) for k, _, t in told], 100)}
    want = [(i, *by_number[k]) for i0, t0 in TWICE for k, i, t in told if i == i0 and t == (t0 or "")]
    got = [tuple(r)[:-1] for r in suffix.remove_repeats(frame(spark, TWICE)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
