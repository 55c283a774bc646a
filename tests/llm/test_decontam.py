"""Decontamination against edit distances of every place."""

import random

import numpy as np
import pyarrow as pa
import pytest

from polysafe.llm import decontam

DOCS = "doc_id long, text string, item string, edits int"
ITEMS = "item_id long, text string, doc_id int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], ITEMS)


def plain(text):
    return " ".join("".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in (text or "").lower()).split())


def distance(item, text):
    """Least edits of item in any part of text."""
    a, t = item.encode(), np.frombuffer(text.encode(), np.uint8)
    cost, step = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for c in a:
        new = np.minimum(np.append(cost[0] + 1, np.minimum(cost[1:] + 1, cost[:-1] + (t != c))), 10**6)
        cost = np.minimum.accumulate(new - step) + step
    return int(cost.min())


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "on", "of", "re", "thand", "eresh", "ount", "in", "ly", "été", "stion", "and"]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(n))

    items = [(k, prose(rng.randrange(15, 60)).capitalize()) for k in range(15)] + [(100, None), (101, ""), (102, "of the"), (103, prose(12))]
    docs = []
    for k in range(60):
        body = prose(rng.randrange(5, 120))
        if k % 2:
            text = list(rng.choice(items[:15])[1].upper() if k % 3 else rng.choice(items[:15])[1])
            for _ in range(rng.randrange(0, max(2, len(text) // 10))):
                at = rng.randrange(len(text))
                text[at:at + rng.randrange(0, 2)] = [rng.choice("abcxyz")] * rng.randrange(0, 2)
            body = f"{body}; {''.join(text)}!  {prose(20)}"
        docs.append((k, body))
    return docs + [(500, None), (501, ""), (502, items[0][1]), (503, "x"), (504, prose(4_000) + " " + items[1][1])], items


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_finds_all_within_the_budget_and_nothing_else(spark, block):
    docs, items = corpus(3)
    got = decontam.find_passages(docs_frame(spark, docs), items_frame(spark, items), block_bytes=block).collect()
    want = {}
    for d, text in docs:
        for i, item in items:
            a = plain(item)
            if len(a.encode()) >= decontam.Q:
                n = len(a.encode())
                most = max(0, min(int(n * decontam.EDIT_RATE), (n - decontam.Q) // decontam.Q))
                if (x := distance(a, plain(text))) <= most:
                    want[d, i] = x
    best = {}
    for r in got:
        best[r.doc_id, r.item_id] = min(r.edits, best.get((r.doc_id, r.item_id), 99))
    assert best == want and len({v for v in want.values()}) > 1
    bodies = {d: plain(t).encode() for d, t in docs}
    for r in got:
        piece = bodies[r.doc_id][r.start:r.end]
        assert abs(len(piece) - len(plain(dict(items)[r.item_id]).encode())) <= r.edits


def test_compared_form():
    buf, offs = decontam.normalised(pa.array(["  A.b  C!", None, "", "éÉ", "...", "x"]))
    assert [buf[offs[k]:offs[k + 1]].tobytes().decode() for k in range(6)] == ["a b c ", "", "", "éé ", "", "x "]


def test_many_finds_in_one_text_and_repeated_rows(spark):
    item = "the quick brown foxes jump over some lazy dogs"
    rows = [(1, f"{item}. {item}, and {item}"), (2, item), (2, item), (None, item)]
    got = decontam.find_passages(docs_frame(spark, rows), items_frame(spark, [(7, item), (7, item)])).collect()
    assert sorted(((r.doc_id, r.edits) for r in got), key=repr) == sorted([(1, 0)] * 6 + [(2, 0)] * 4 + [(None, 0)] * 2, key=repr)
    kept = decontam.without_passages(docs_frame(spark, [*rows, (3, "clean")]), items_frame(spark, [(7, item)]))
    assert [r.doc_id for r in kept.collect()] == [3] and kept.columns == ["doc_id", "text", "item", "edits"]


def test_empty_tables(spark):
    some = [(1, "the quick brown foxes jump over some lazy dogs")]
    assert decontam.find_passages(docs_frame(spark, []), items_frame(spark, some)).collect() == []
    assert decontam.find_passages(docs_frame(spark, some), items_frame(spark, [])).collect() == []
    assert decontam.without_passages(docs_frame(spark, some), items_frame(spark, [])).count() == 1


def test_short_items_as_words_or_whole_texts(spark):
    items = [(1, "Forty-two"), (2, "é"), (3, "東京"), (4, "..."), (5, "no"), (6, None), (7, "abcdefghij klmnopqrst")]
    docs = [(1, "forty two"), (2, "It is forty, two; not fortytwo"), (3, "forty twos"), (4, "私は東京に東京"), (5, "no, no nono"), (6, "No!"), (7, None), (8, ""),
            (9, "see abcdefghij kXmnopqrst here"), (10, "fortyé")]

    def found(**by):
        got = decontam.find_passages(docs_frame(spark, docs), items_frame(spark, items), **by).collect()
        return sorted((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in got)

    near = (9, 7, 1, 4, 25)
    words = [(1, 1, 0, 0, 9), (2, 1, 0, 6, 15), (4, 3, 0, 6, 12), (4, 3, 0, 15, 21), (5, 5, 0, 0, 2), (5, 5, 0, 3, 5), (6, 5, 0, 0, 2), (10, 2, 0, 5, 7)]
    assert found() == []
    assert found(short="words") == sorted([*words, near])
    assert found(short="words", block_bytes=20) == sorted([*words, near])
    assert found(short="whole") == sorted([(1, 1, 0, 0, 9), (6, 5, 0, 0, 2), near])
    kept = decontam.without_passages(docs_frame(spark, docs), items_frame(spark, items)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 4, 5, 7, 8, 10]


def test_short_items_against_plain_words(spark):
    docs, items = corpus(5)
    items = [*items, *((200 + k, w) for k, w in enumerate(["the", "re on", "x", "of.the", "count"]))]
    got = decontam.find_passages(docs_frame(spark, docs), items_frame(spark, items), short="words").where("item_id >= 200 or item_id = 102").collect()
    want = []
    for d, text in docs:
        for i, item in items:
            a = plain(item)
            if (i >= 200 or i == 102) and a:
                padded, at = f" {plain(text)} ", -1
                while (at := padded.find(f" {a} ", at + 1)) >= 0:
                    start = len(padded[1:at + 1].encode())
                    want.append((d, i, 0, start, start + len(a.encode())))
    assert sorted(tuple(r) for r in got) == sorted(want) and len({w[1] for w in want}) >= 4
