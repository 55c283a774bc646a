"""Packing: every id once, in full windows, with the tokenizer's own ids."""

import random
import zlib

import numpy as np
import pytest

from polysafe.llm import packing
from polysafe.llm.tokens import WordTokenizer

SCHEMA = "doc_id long, text string, ids string, sketch int, start string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


ODD = ["", None, " \n\t", "don't 'sure' we'll x's ?'s", "<|endoftext|> in the<|startoftext|>middle <|ENDOFTEXT|>", "ΑΣ ΑΣ. ΣΑ x.Σ", "İstanbul É É é", "a.b,c!!d##e 12a3.4",
       "ha.%%%***", "中文 テスト 𝒳", " x y　z", "it's.'t", "x" * 30_000, "The THE the, tHe.", "a\x00b \x1c c"]


def texts(seed, n):
    rng = random.Random(seed)
    syllables = ["the", "on", "er", "Qui", "é", "ing", "st", ".", "'", "1", "!!", "tion"]
    return ["".join(rng.choice([*syllables, " ", " ", "\n"]) for _ in range(rng.randrange(0, 900))) for _ in range(n)]


def test_word_by_word_equals_whole_text(tokenizer):
    import pyarrow as pa

    rows = ODD + texts(1, 200)
    ids, offs = WordTokenizer(packing.default_tokenizer()).encode(pa.array(rows), 2)
    for k, t in enumerate(rows):
        assert ids[offs[k]:offs[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [2], t


@pytest.mark.parametrize(("window", "shard"), [(64, 2_000), (4096, 1 << 20)])
def test_pieces_cover_every_id_once(spark, tokenizer, window, shard):
    rows = list(enumerate(ODD + texts(2, 150))) + [(9_000, "long text " * 9_000), (9_001, "same"), (9_002, "same")]
    got = packing.pack(frame(spark, rows), window=window, shard_tokens=shard).collect()
    want = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[i]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(want[i][at:at + r.length].tobytes())
            at += r.length
        assert at == len(want[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_length <= window and (at == window or at & (at - 1) == 0)
    assert sum(p[0].sequence_length < window for p in by_sequence.values()) <= 13 * 8


def test_neighbours_are_ranked_by_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint32) for _ in range(25)]
    df = np.zeros(40)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log1p((25 - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = np.mean([len(d) for d in docs])
    shard = packing.Shard(docs, idf, mean)
    for seed in range(25):
        score = [sum(idf[t] * (d == t).sum() * (packing.K1 + 1) / ((d == t).sum() + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in np.unique(docs[seed])) for d in docs]
        got = shard.neighbours(seed)
        assert set(got) == {k for k, s in enumerate(score) if s > 0}
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:]))


def test_windows_prefer_related_documents(spark):
    rng = random.Random(8)
    topics = [[f"{c}{k}x" for k in range(30)] for c in "abcdefgh"]
    rows = [(k, " ".join(rng.choice(topics[k % 8]) for _ in range(40))) for k in range(160)]
    got = packing.pack(frame(spark, rows).coalesce(1), window=512, shard_tokens=1 << 20).collect()
    together = {}
    for r in got:
        together.setdefault(r.sequence_id, set()).add(r.doc_id)
    same = [len({d % 8 for d in x}) for x in together.values() if len(x) > 1]
    assert sum(same) / len(same) < 2.5


def test_empty_table_null_and_repeated_ids(spark):
    assert packing.pack(frame(spark, [])).collect() == []
    got = packing.pack(frame(spark, [(None, "x"), (1, "x"), (1, "x")])).collect()
    assert sum(r.length for r in got) == 6 and {r.doc_id for r in got} == {None, 1}
