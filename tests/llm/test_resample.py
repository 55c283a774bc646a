"""Importance resampling against plain Python, and its table against dictionaries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from polysafe.llm import resample as rs

rng = random.Random(3)


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def brute(docs, target, percent=5, least=20):
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d for _, d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for i, x in docs:
        n, fs = features(x)
        w = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0], r[1:4]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def text(n, vocabulary="abcdefghijklmnopqrstuvwxyz"):
    return rng.choice([" ", ", ", "-"]).join("".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(n))


DOCS = [(k, text(rng.choice([0, 1, 2, 19, 20, 40, 90]))) for k in range(300)] + [
    (301, None), (302, ""), (303, "Ä ö É x1 42 — « » 東京 w" * 9), (304, "A" * 70 + " " + "b" * 200 + " c" * 20), (305, "x" * 40_000),
    (None, text(30)), (None, None), (7, text(30)), (7, "a b " * 30), (7, "a b " * 30), (306, "\x00a\x7fb{c}d@e[f`g/h:i" * 4)]
TARGET = [text(30, "abcde") for _ in range(20)] + [None, ""]


def test_rows_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in DOCS], "doc_id long, text string, score int, rank string").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    for percent, least in ((5, 20), (37, 2), (100, 0)):
        got = rs.resample(docs, target, percent, least).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, got), key=repr) == brute(DOCS, TARGET, percent, least)


def test_hash_and_checksum_against_the_libraries():
    data = bytes(rng.randrange(256) for _ in range(4000))
    start = np.array([rng.randrange(3000) for _ in range(2000)])
    size = np.array([rng.choice([*range(1, 70), 300]) for _ in start])
    buf = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    spans = [data[a:a + n] for a, n in zip(start, size)]
    assert rs.xxh64(buf, start, size).tolist() == [xxhash.xxh64_intdigest(x) for x in spans]
    assert rs.crc32(buf, start, size).tolist() == [zlib.crc32(x) for x in spans]


@pytest.mark.parametrize("keys", ["all", "few", "one"])
def test_bytes_decide_where_keys_clash(keys):
    words = rs.words_of(pa.array([text(400, "abc"), text(200, "ab") + " " + "long" * 20]))
    size = words.end - words.start
    hashed = {"all": None, "few": (size % 3).astype(np.uint64), "one": np.full(len(size), 7, np.uint64)}[keys]
    slot, owner = rs.intern(words.buf, words.start, size, hashed)
    said = [words.buf[a:b].tobytes() for a, b in zip(words.start, words.end)]
    assert len(owner) == len(set(said)) and all(said[owner[s]] == w for s, w in zip(slot, said))


def test_table_slots_hold_counts():
    texts = ["a b a b a", None, "b a b"]
    got = Counter()
    for t in rs.tables(rs.words_of(pa.array(texts))):
        assert t.count.sum() == len(t.slot) and (np.bincount(t.slot) == t.count).all()
        for b, n in zip(t.bucket.tolist(), t.count.tolist()):
            got[b] += n
    assert got == Counter(bucket(f) for x in texts for f in features(x)[1])


def test_the_draw_follows_the_target(spark):
    docs = spark.createDataFrame([(k, text(30, "abcde" if k % 10 == 0 else "vwxyz")) for k in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(text(30, "abcde"),) for _ in range(50)], "text string")
    drawn = rs.resample(docs, target).where("rank is not null").collect()
    assert len(drawn) == 20 and all(r.doc_id % 10 == 0 for r in drawn)


def test_cut_is_exact(spark):
    scores = [rng.choice([-5, 0, 7, 9000, rng.randrange(-10**7, 10**7)]) for _ in range(500)]
    df = spark.createDataFrame([(s,) for s in scores], "score long")
    down = sorted(scores, reverse=True)
    assert [rs.highest(df, "score", n) for n in (1, 2, 100, 300, 500)] == [down[n - 1] for n in (1, 2, 100, 300, 500)]
    assert rs.highest(df, "score", 0) is None and rs.highest(df, "score", 501) is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 30)], "doc_id long, text string")
    assert rs.resample(none, some).collect() == []
    assert [r.rank for r in rs.resample(some, none, percent=100).collect()] == [1]
    assert rs.resample(some.withColumn("text", F.lit(None).cast("string")), some).first().weight == 0
