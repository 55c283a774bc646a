"""The byte model against Kneser-Ney written out from dictionaries, each text judged by the half it is not in."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from polysafe.llm import charlm, quality

N = charlm.ORDER


def by_hand(texts):
    """Probability of a byte after five, from dictionaries; zeros stand before a text."""
    seqs = [bytes(N - 1) + t.encode() for t in texts]
    counts = {N: Counter(s[k - N:k] for s in seqs for k in range(N, len(s) + 1))}
    for n in range(N - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts = {n: charlm.discounts(*(sum(v == j for v in c.values()) for j in (1, 2, 3, 4))) for n, c in counts.items()}
    after = defaultdict(list)
    for n, c in counts.items():
        for g, v in c.items():
            after[n, g[:-1]].append(v)

    def prob(g):
        n = len(g)
        if not n:
            return 1 / 256
        seen = after.get((n, g[:-1]))
        if not seen:
            return prob(g[1:])
        v = counts[n].get(g, 0)
        held = sum(cuts[n][min(x, 3) - 1] for x in seen)
        return ((v - cuts[n][min(v, 3) - 1]) if v else 0) / sum(seen) + held / sum(seen) * prob(g[1:])

    return prob


def texts(n, words, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def half(t):
    buf = np.frombuffer(t.encode(), np.uint8)
    return int(charlm.halves(buf, np.array([0, len(buf)]))[0])


def test_perplexity_of_bytes(spark):
    known = [f"w{k}" for k in range(25)] + ["été", "中文"]
    learn, more = texts(60, known, 1), [*texts(40, [*known, "Neu", "unseen!"], 2), "w1 w1 w1 w1 w1", " \n ", "x", "a\x00b", "w" * 5000]
    quality.prepare(spark)
    model = charlm.train(spark.createDataFrame([(t,) for t in learn], "text string"))
    every = learn + more
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(every)] + [(900, "en", ""), (901, None, None)], "id long, lang string, text string")
    got = {r.id: r.perplexity for r in charlm.score(docs, model).collect()}
    assert len(got) == len(every) + 2 and got[900] is None and got[901] is None
    hand = [by_hand([t for t in learn if half(t) == h]) for h in (0, 1)]
    for k, t in enumerate(every):
        s, prob = bytes(N - 1) + t.encode(), hand[1 - half(t)]
        logs = [np.log(prob(s[j - N:j])) for j in range(N, len(s) + 1)]
        assert np.log(got[k]) == pytest.approx(-np.mean(logs), rel=1e-4, abs=1e-4), t


def test_the_probabilities_after_a_context_sum_to_one():
    prob = by_hand(["the cat sat on the mat.", "The dog, the cat"])
    for context in (b"the c", b"zzzzz", b" the ", bytes(5)):
        assert sum(prob(context + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_n_grams_stay_inside_a_text():
    buf, offs = np.frombuffer(b"ababcdefgx", np.uint8), np.array([0, 2, 2, 9, 10])
    want = [int.from_bytes(t[max(0, k - N):k], "big") for t in (b"ab", b"abcdefg", b"x") for k in range(1, len(t) + 1)]
    assert charlm.codes(buf, offs).tolist() == want
    assert charlm.codes(np.zeros(0, np.uint8), np.zeros(1, np.int64)).tolist() == []


def test_the_model_grows_with_the_text_and_copies_stay_in_one_half(spark):
    quality.prepare(spark)
    sizes = []
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(3000)]
    for n in (50, 500):
        model = charlm.train(spark.createDataFrame([(t,) for t in texts(n, words, n)], "text string"))
        sizes.append(sum(len(r.key) // 8 for r in model.collect()))
    assert sizes[1] > 4 * sizes[0]  # of a fixed vocabulary, so less than the text, which is ten times as long
    assert len({half(t) for t in ("ein Text da", "ein  Text\nda", " ein Text da ")}) == 1
    assert {half(t) for t in texts(50, words, 3)} == {0, 1}


def test_answers_of_a_shard():
    tag = charlm._tag(3, 1)
    key = np.array([0x616263, 0x616266, 0x626161], np.uint64) | tag
    index = charlm.Index([(key[1:], np.array([0.2, 0.3], "<f4"), np.array([0.5, 0.6], "<f4")), (key[:1], np.array([0.1], "<f4"), np.array([0.5], "<f4"))])
    asked = np.array([0x616261, 0x616263, 0x616264, 0x6162FF, 0x626161, 0x626200, 0x646464], np.uint64) | tag
    share, weight = index.find(asked)
    assert np.allclose(share, [0, 0.1, 0, 0, 0.3, 0, 0]) and np.allclose(weight, [0.5, 0.5, 0.5, 0.5, 0.6, 1, 1])
    assert [x.tolist() for x in charlm.Index([]).find(asked[:1])] == [[0], [1]]


def test_other_scripts_and_capitals_are_told_apart(spark):
    rows = [(k, t) for k, t in enumerate(texts(80, ["да", "нет", "мир", "дом"], 3) + ["мир дом да нет", "ΑΒΓ ΔΕΖ ΗΘ ΙΚΛ"])]
    docs = spark.createDataFrame([(k, t, "xx") for k, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.perplexity for r in quality.judge(docs, labels).collect()}
    # Per byte; a word costs as many times this as it has bytes.
    assert got[81] > 10 * got[80]
