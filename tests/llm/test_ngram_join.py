"""The similarity join against all pairs of small corpora."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from polysafe.llm import ngram_join
from polysafe.llm.ngram_join import Bands

SCHEMA = "doc_id long, text string, n string, rep int, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def shingle_set(text, n):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(ws) < n:
        return frozenset([tuple(ws)] if ws else [])
    return frozenset(tuple(ws[k:k + n]) for k in range(len(ws) - n + 1))


def brute(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, sizes, edits):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["the", "of"] * 60
    rows = []
    for size in sizes:
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, edits + 1)):
                at = rng.randrange(len(copy) + 1)
                copy[at:at + rng.randrange(0, 2)] = [rng.choice(words)] * rng.randrange(0, 2)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    return rows


EDGE = [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE "), (5005, "one two"), (5006, "One\ttwo"), (5007, "one two three"),
        (5008, "É É"), (5009, "é é"), (5010, "a " * 9_000), (5011, "a " * 8_000), (5012, "one two three")]


@pytest.mark.parametrize(("percent", "n", "edits"), [(90, 3, 2), (80, 5, 3)])
def test_components_of_all_pairs(spark, percent, n, edits):
    rows = corpus(percent, [3, 5, 8, 12, 14, 20, 25, 33, 60, 120, 300], edits) + EDGE
    got = ngram_join.similar_components(frame(spark, rows), percent=percent, shingle=n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, percent)
    assert len(got) == len(rows)


def test_links_of_a_chain_and_a_group_of_copies(spark):
    rng = random.Random(9)
    base = [f"v{k}" for k in range(200)]
    chain = []
    for k in range(12):  # each differs a little from the one before, the ends a lot
        base[k * 15:k * 15 + 2] = [f"z{k}", f"y{k}"]
        chain.append((100 - k, " ".join(base)))
    hot = [(1000 + k, "same text as ever " * 20) for k in range(500)]
    near = [(3000 + k, " ".join(["hub"] + [f"h{j}" if rng.random() > 0.004 else f"q{k}_{j}" for j in range(150)])) for k in range(80)]
    rows = chain + hot + near
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(frame(spark, rows)).collect()}
    assert got == brute(rows, 3, 90)


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, "x y z")]
    got = ngram_join.similar_components(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == [(3, None), (3, None), (4, 4), (None, None)]
    assert ngram_join.similar_components(frame(spark, [])).collect() == []


def test_partners_share_a_band_or_neighbour():
    for percent in (50, 80, 90, 95):
        bands = Bands(percent, 3000)
        for size in range(1, 1200):
            largest = size * 100 // percent
            assert bands.of(np.array([largest]))[0] - bands.of(np.array([size]))[0] <= 1
            scheme = bands.of(np.array([size]))[0]
            assert bands.segments[scheme] > size * (100 - percent) // percent


def test_pigeonhole_with_any_allocation(spark):
    """Sets within the allowed difference meet in a bucket, also where segments are skipped and raised."""
    rng = random.Random(4)
    rows = corpus(21, [30, 41, 60, 90, 120, 150, 200, 260, 300], 2)
    bands = Bands(90, 500)
    thresholds = {}
    for scheme in range(len(bands.segments)):
        own = list(range(bands.base[scheme], bands.base[scheme + 1]))
        rng.shuffle(own)
        for k in range(len(own) // 2):
            thresholds[own[2 * k]], thresholds[own[2 * k + 1]] = -1, 1
    docs = frame(spark, rows).select("doc_id", "text").withColumnRenamed("doc_id", "id")
    met = {}
    for r in ngram_join.signatures(docs, bands, thresholds, 3).collect():
        met.setdefault(r.sig, set()).add(r.d1)
    digests = {r.id: r.d1 for r in ngram_join.describe(docs, 90, 3).collect()}
    sets = {i: shingle_set(t, 3) for i, t in rows}
    pairs = 0
    for a in sets:
        for b in sets:
            if a < b and digests[a] != digests[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                pairs += 1
                assert any({digests[a], digests[b]} <= x for x in met.values())
    assert pairs > 20


def test_poor_segments_are_skipped(spark):
    rows = [(k, " ".join(f"{k}_{j}" for j in range(14))) for k in range(600)]
    docs = frame(spark, rows).select("doc_id", "text").withColumnRenamed("doc_id", "id")
    got = ngram_join.allocate(docs, Bands(50, 12), 3)  # many segments, so many empty subsets
    assert got and sorted(got.values()) == [-1] * (len(got) // 2) + [1] * (len(got) // 2)
    assert ngram_join.allocate(docs, Bands(90, 12), 3) == {}


def test_shingles_are_distinct_and_sorted():
    grams, offs = ngram_join.shingles(pa.array(["a b c a b c a", None, "x", "X", "x y", ""]), 3)
    assert np.diff(offs).tolist() == [3, 0, 1, 1, 1, 0] and grams[offs[2]] == grams[offs[3]]


def test_rows_that_share_an_id_link_by_their_own_texts(spark):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join(base) + " z", "other " * 3 + "words only", " ".join(f"v{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60)) + " y", None]
    rows = [(5, texts[0]), (7, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[4]), (9, texts[2]), (9, texts[2]), (9, texts[5])]
    told = sorted({(i is not None, i or 0, hashlib.sha256((t or "").encode()).digest(), t or "") for i, t in rows})
    number = {k: ((i if known else None), t) for k, (known, i, _, t) in enumerate(told)}
    found = brute([(k, t) for k, (_, t) in number.items()], 3, 90)
    want = [(i, n, number[root][0]) for i, t in rows for k, (n, root) in found.items() if number[k] == (i, t or "")]
    got = ngram_join.similar_components(frame(spark, rows), percent=90, shingle=3).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert {(r.doc_id, r.component_id) for r in got} >= {(5, 5), (7, 5), (None, None), (7, None)}


@pytest.mark.parametrize("thresholds", [{}, {0: -1, 3: 1, 5: 1, 6: -1}])
def test_similar_sets_have_an_entry_whose_chains_are_in_room(thresholds):
    """Every pair within the allowed difference passes all chains from one shared entry at least; of others few pass."""
    rng = random.Random(4)
    base = [f"x{k}" for k in range(300)]
    texts = [" ".join(base)]
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(300), rng.randrange(1, 12)):
            copy[at] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    bands = Bands(90, 1000)
    first = int(bands.base[bands.of(np.array([298]))[0]])
    levels = {first + k: v for k, v in thresholds.items()}
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})

    class Rows:
        def mapInArrow(self, rows, schema):
            return list(rows(iter([batch])))

    entries = {}
    for part in ngram_join.chains(Rows(), bands, levels, 3):
        for r in part.to_pylist():
            entries.setdefault(r["sig"], {})[r["rep"]] = r
    passed = set()
    for members in entries.values():
        for a, x in members.items():
            for b, y in members.items():
                if a < b and all(sum(((x[f"{w}{n}"] ^ y[f"{w}{n}"]) & (2**64 - 1)).bit_count() for w in ("low", "high")) <= x[f"room{n}"] for n in ngram_join.CHAINS):
                    passed.add((a, b))
    sets = [shingle_set(t, 3) for t in texts]
    pairs = {(a, b): 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) for b in range(len(sets)) for a in range(b)}
    assert any(pairs.values())
    assert {p for p, similar in pairs.items() if similar} <= passed
    far = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])]
    assert len(far) > 100 and sum(p in passed for p in far) < len(far) / 4


def test_chains_of_the_entries_asked_for(spark):
    """Only listed entries leave the tasks: a document has hundreds of them, few of which meet another component."""
    rows = corpus(8, [40, 90, 200], 2)
    docs = frame(spark, rows).select("doc_id", "text").withColumnRenamed("doc_id", "id")
    bands = Bands(80, 300)
    all_of = {(r.sig, r.rep): r for r in ngram_join.chains(docs, bands, {}, 3).collect()}
    some = random.Random(3).sample(sorted(all_of), 30)
    asked = spark.createDataFrame([(rep, [s for s, r in some if r == rep] + [7]) for rep in {r for _, r in some}], "id long, sigs array<long>")
    got = ngram_join.chains(docs.join(asked, "id"), bands, {}, 3).collect()
    assert {(r.sig, r.rep): r for r in got} == {k: all_of[k] for k in some}
    none = docs.selectExpr("id", "text", "array_except(array(1L), array(1L)) AS sigs")
    assert ngram_join.chains(none, bands, {}, 3).collect() == []


def test_pairs_of_a_group_of_near_copies_grow_with_its_texts(spark, monkeypatch):
    """Variants that link through a few central ones are not compared pair by pair."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(240):  # two texts link when they differ in three words from the base together
        copy = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 2, 3, 3, 3))):
            copy[at] = f"e{k}_{at}"
        rows.append((k, " ".join(copy)))
    counts = []
    real = ngram_join.stored

    def stored(df, name, free=True):
        out = real(df, name, free)
        if name == "close":
            counts.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", stored)
    got = ngram_join.similar_components(frame(spark, rows), percent=80, shingle=5).collect()
    want = brute(rows, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    sets = [shingle_set(t, 5) for _, t in rows]
    links = sum(100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert links > 10 * len(rows)
    assert max(counts) < 3 * len(rows), counts


def test_unrelated_texts_do_not_meet(spark):
    """Texts without a common shingle share no entry, however many there are; they met wherever both had nothing in a segment."""
    rows = [(k, " ".join(f"{k}_{j}" for j in range(40 + k % 30))) for k in range(400)]
    docs = frame(spark, rows).select("doc_id", "text").withColumnRenamed("doc_id", "id")
    bands = Bands(80, 100)
    assert ngram_join.allocate(docs, bands, 5) == {}
    met = ngram_join.signatures(docs, bands, {}, 5)
    assert met.select("sig", "d1").distinct().count() == met.select("sig").distinct().count() > 400 * 10


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_similar_sets_share_an_entry_also_where_their_segments_are_empty(percent):
    rng = random.Random(percent)
    bands = Bands(percent, 400)
    similar = 0
    for k in range(300):
        v = np.zeros(bands.base[-1], np.int8)
        for scheme in range(len(bands.segments) * (k % 2)):
            own = list(range(bands.base[scheme], bands.base[scheme + 1]))
            rng.shuffle(own)
            for j in range(len(own) // 2):
                v[own[2 * j]], v[own[2 * j + 1]] = -1, 1
        a = {rng.getrandbits(64) for _ in range(rng.choice((3, 9, 30, 90, 250)))}
        b = set(rng.sample(sorted(a), rng.randrange(len(a) * percent // 100, len(a)) or 1))
        b |= {rng.getrandbits(64) for _ in range(rng.randrange(1 + (100 * len(b) // percent - len(a))))} if 100 * len(b) > percent * len(a) else set()
        if 100 * len(a & b) < percent * len(a | b):
            continue
        similar += 1
        scheme = bands.of(np.array([min(len(a), len(b))]))
        sigs = [ngram_join.entries(np.array(sorted(s), np.uint64), np.array([0, len(s)]), np.array([0]), scheme, bands, v)[0].tolist() for s in (a, b)]
        assert set(sigs[0]) & set(sigs[1])
        assert all(len(set(s)) == len(s) for s in sigs)
    assert similar > 100
