"""Similarity join of word-shingle sets by partitioning the universe (pigeonhole).

Two sets of Jaccard similarity t or more, the smaller of size s, differ in at
most H = s (1 - t) / t elements.  Sizes are cut into bands so that partners
are in the same band or the next; a band's scheme hashes the universe into
segments and gives segment i a threshold v_i of -1 (skipped), 0 or 1 with
sum(v_i + 1) = H + 1: some segment then differs in at most v_i elements.
Segments of threshold 0 are indexed by their subset, those of threshold 1 by
the subset and all its one-deletion neighbours.  Nothing is indexed by an
empty subset, in which all sets that have nothing in a segment would meet,
in numbers that grow with the corpus: where nothing is left of a segment, the
ones after it are added until something is (``entries``), with the deletions
that the cycle lemma (``chains``) allows so many segments.  The thresholds
start at 0; where corpus counts say that a segment's entries, with those added
for its empty subsets, are more than the deletions of another segment, the
first is skipped and the other raised.

Sets that meet are filtered by size and by the parity of hashed elements (a
lower bound of the difference), then verified exactly.  Components need no
more than one path, so each set is first compared with one leader of its
buckets and then only with what is still in different components.  Those
pairs must also pass the chains of segments that start where they meet
(``chains``): groups of texts just below the similarity share most of their
buckets, and would otherwise meet in each of them.  With that filter, again
first with the most central sets of the buckets (``probes``), whose links join
most of a group; in what is left then, the main component of a bucket meets
the others, but not itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from polysafe.llm.common import U64, mix, parts_for, prepare, shuffle_parts, signed, slices, span_hash, stored, text_buffer, windows_hash, word_spans
from polysafe.llm.components import components
from polysafe.llm.repeats import NULL_ID
from polysafe.llm.rows import each_row

SHINGLE = 3
#: Similarity as a fraction of hundred.
PERCENT = 90
#: Members that lead a bucket; a set is first compared with the one that leads most of its buckets.
LEADERS = 2
#: Rounds in which the sets of what is left are compared with leaders of their buckets only, before they are with each other.
PROBES = 1
#: Bits of the parity sketch, and of its folded form that travels with bucket members.
SKETCH, FOLDED = 1024, 256
WORDS = SKETCH // 64
#: Segments of the chains, each twice the one before, that a pair must pass from the entry where it meets.
CHAINS = (2, 4, 8, 16, 32)
#: Close pairs that a task verifies at least, where there are so many.
PAIRS = 512


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct word n-grams, A-Z lower-cased; a shorter text is one shingle."""
    buf, offs = text_buffer(texts)
    begin, end, row = word_spans(buf, offs)
    words = span_hash(buf, begin, end, lower=True)
    count = np.bincount(row, minlength=len(texts))
    grams = windows_hash(words, n)
    at = np.arange(len(grams))
    inside = row[at] == row[at + n - 1] if len(at) else np.zeros(0, bool)
    grams, doc = grams[inside], row[at[inside]]
    first = np.concatenate(([0], np.cumsum(count)))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([int(windows_hash(words[first[k]:first[k + 1]], int(count[k]))[0]) for k in short], U64)
        grams = np.concatenate([grams, mix(whole ^ U64(0xA5A5A5A5))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def whole_parity(grams: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Parity of each set's elements in ``SKETCH`` places, one row a set."""
    rows = len(offs) - 1
    place = (mix(grams ^ U64(0x1234567)) % U64(SKETCH)).astype(np.int64)
    bits = np.bincount(np.repeat(np.arange(rows), np.diff(offs)) * SKETCH + place, minlength=rows * SKETCH)
    return (bits.reshape(rows, SKETCH) & 1).astype(np.uint8)


class Bands:
    """Size bands and their schemes for a similarity of ``percent`` / 100."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        lows = [1]
        while lows[-1] <= largest:
            lows.append(lows[-1] * 100 // percent + 1)
        self.lows = np.array(lows, np.int64)
        top = self.lows[1:] - 1
        #: Segments of each scheme before allocation: the greatest difference plus one.
        self.segments = top * (100 - percent) // percent + 1
        self.base = np.concatenate(([0], np.cumsum(self.segments)))

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, size, side="right") - 1


def in_segments(grams: np.ndarray, offs: np.ndarray, rows: np.ndarray, scheme: np.ndarray, bands: Bands):
    """Elements of the given rows under each row's scheme: (element, slot of its segment, slots' scheme segment, slots' row)."""
    m = bands.segments[scheme]
    start = np.concatenate(([0], np.cumsum(m)))
    size = offs[rows + 1] - offs[rows]
    upto = np.concatenate(([0], np.cumsum(size)))
    element = grams[np.repeat(offs[rows] - upto[:-1], size) + np.arange(upto[-1])]
    of = np.repeat(np.arange(len(rows)), size)
    salt = mix(scheme.astype(U64) + U64(1))
    slot = start[of] + (mix(element ^ salt[of]) % m[of].astype(U64)).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), m)
    segment = bands.base[scheme[owner]] + np.arange(start[-1]) - start[owner]
    return element, slot, segment, rows[owner]


def describe(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """``id, n, d1, d2, p0..p3, parity``: set size, digest, folded and whole parity sketch of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            grams, offs = shingles(b.column("text"), shingle)
            n = np.diff(offs)
            full = n > 0
            d1, d2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
            if len(grams):
                at = offs[:-1][full]
                d1[full], d2[full] = mix(np.add.reduceat(mix(grams ^ U64(0x1234567)), at)), np.add.reduceat(mix(grams ^ U64(0x7654321)), at)
            odd = whole_parity(grams, offs)
            folded = np.bitwise_xor.reduce(odd.reshape(len(n), SKETCH // FOLDED, FOLDED), axis=1)
            sketch = np.packbits(folded, axis=1).view(">i8").astype(np.int64)
            whole = np.packbits(odd, axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n.astype(np.int64)), pa.array(signed(d1)), pa.array(signed(d2)), *(pa.array(sketch[:, k]) for k in range(4)),
                 pa.array([x.tobytes() for x in whole], pa.binary())],
                names=["id", "n", "d1", "d2", "p0", "p1", "p2", "p3", "parity"])

    return docs.mapInArrow(rows, "id long, n long, d1 long, d2 long, p0 long, p1 long, p2 long, p3 long, parity binary")


def allocate(docs: DataFrame, bands: Bands, shingle: int) -> dict[int, int]:
    """Thresholds other than 0, by segment number: -1 and 1 in equal numbers within each scheme.

    Counted over all documents; one number per segment, whose count depends on
    the longest set only.  A set has one entry of a segment, or where its subset
    is empty about those of the next one with its one-deletion neighbours;
    skipping segment i for raising j pays when these are more than the
    deletions that j adds to the index.
    """
    spread = bands.base[-1]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, poor, total = (np.zeros(spread, np.int64) for _ in range(3))
        for b in slices(batches, "text"):
            grams, offs = shingles(b.column("text"), shingle)
            rows = np.flatnonzero(np.diff(offs))
            if len(rows):
                _, slot, segment, _ = in_segments(grams, offs, rows, bands.of(np.diff(offs)[rows]), bands)
                held = np.bincount(slot, minlength=len(segment))
                sets += np.bincount(segment, minlength=spread)
                poor += np.bincount(segment[held == 0], minlength=spread)
                total += np.bincount(segment, held, minlength=spread).astype(np.int64)
        at = np.flatnonzero(sets)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in (sets, poor, total))], names=["segment", *names])

    names = ["sets", "poor", "total"]
    seen = docs.mapInArrow(counts, "segment long, sets long, poor long, total long").groupBy("segment").agg(*(F.sum(c).alias(c) for c in names))
    out: dict[int, int] = {}
    sets, poor, total = (np.zeros(spread, np.int64) for _ in range(3))
    for r in seen.collect():
        sets[r.segment], poor[r.segment], total[r.segment] = r.sets, r.poor, r.total
    for scheme in range(len(bands.segments)):
        own = np.arange(bands.base[scheme], bands.base[scheme + 1])
        order = own[np.argsort(poor[own], kind="stable")]
        for skip, up in zip(order[::-1], order[:len(own) // 2]):
            if int(sets[skip]) ** 2 + int(poor[skip]) * int(total[skip]) <= int(sets[skip]) * int(total[up]):
                break
            out[int(skip)], out[int(up)] = -1, 1
    return out


def entries(grams: np.ndarray, offs: np.ndarray, rows: np.ndarray, scheme: np.ndarray, bands: Bands, v: np.ndarray):
    """Index entries of the given rows under each row's scheme: (hash, slot of the first segment) of each, and what ``in_segments`` gives.

    From the segment where a chain of two similar sets starts, the first l
    segments differ in at most ``room`` elements, the sum of their v_i + 1 less
    one, for each l.  So where the first l - 1 have nothing in common, either
    set can be rid of all it has there and of what the l-th has for itself with
    ``room`` deletions.  What is left of the l-th, if anything, is the entry.
    """
    element, slot, segment, owner = in_segments(grams, offs, rows, scheme, bands)
    part = mix(element ^ U64(0xBEEF))
    total = np.zeros(len(segment), U64)
    np.add.at(total, slot, part)
    held = np.bincount(slot, minlength=len(segment))
    begin = np.concatenate(([0], np.cumsum(held)))
    part = part[np.argsort(slot, kind="stable")]
    m = bands.segments[scheme]
    first, m = np.repeat(np.concatenate(([0], np.cumsum(m)[:-1])), m), np.repeat(m, m)
    start = np.flatnonzero(v[segment] >= 0)
    here, spent, room = start, np.zeros(len(start), np.int64), v[segment[start]].astype(np.int64)
    sigs, at, length = [], [], 1
    while len(start):
        salt = mix((segment[start].astype(U64) ^ U64(0xF00D)) + (U64(length - 1) << U64(40)))
        left = np.flatnonzero(held[here])
        rest, after, deleted = total[here[left]], begin[here[left]], 0
        while len(left):
            sigs.append(mix(rest ^ salt[left]))
            at.append(start[left])
            deleted += 1
            more = deleted <= np.minimum(room - spent, held[here] - 1)[left]
            left, rest, after = left[more], rest[more], after[more]
            choices = begin[here[left] + 1] - after
            one = np.repeat(after - (np.cumsum(choices) - choices), choices) + np.arange(choices.sum())
            left, rest, after = np.repeat(left, choices), np.repeat(rest, choices) - part[one], one + 1
        spent = spent + held[here]
        on = (spent <= room) & (length < m[start])
        start, spent, room = start[on], spent[on], room[on]
        here = first[start] + (start - first[start] + length) % m[start]
        room = room + v[segment[here]] + 1
        length += 1
    return np.concatenate([np.zeros(0, U64), *sigs]), np.concatenate([np.zeros(0, np.int64), *at]), element, slot, segment, owner


def _schemes(grams: np.ndarray, offs: np.ndarray, bands: Bands) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(guest, rows, scheme of each): every set under its own band's scheme and, as a guest, under the one before."""
    full = np.flatnonzero(np.diff(offs))
    own = bands.of(np.diff(offs)[full])
    older = own > 0
    for guest, rows, scheme in ((0, full, own), (1, full[older], own[older] - 1)):
        if len(rows):
            yield guest, rows, scheme


def _levels(bands: Bands, thresholds: dict[int, int]) -> np.ndarray:
    v = np.zeros(bands.base[-1], np.int8)
    v[list(thresholds)] = list(thresholds.values())
    return v


def signatures(docs: DataFrame, bands: Bands, thresholds: dict[int, int], shingle: int) -> DataFrame:
    """``sig, guest, d1``: each set under its own band's scheme and, as a guest, under the one before."""
    v = _levels(bands, thresholds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            grams, offs = shingles(b.column("text"), shingle)
            full = np.flatnonzero(np.diff(offs))
            digest = np.zeros(b.num_rows, U64)
            if len(full):
                digest[full] = mix(np.add.reduceat(mix(grams ^ U64(0x1234567)), offs[:-1][full]))
            for guest, held, scheme in _schemes(grams, offs, bands):
                sig, at, _, _, _, owner = entries(grams, offs, held, scheme, bands, v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(sig)), pa.array(np.full(len(sig), guest, np.int8)), pa.array(signed(digest[owner[at]]))], names=["sig", "guest", "d1"])

    return docs.mapInArrow(rows, "sig long, guest byte, d1 long")


def _asked(sig: np.ndarray, owner: np.ndarray, sigs: pa.ListArray) -> np.ndarray:
    """Places in ``sig`` (of rows ``owner``) of the hashes that each row lists in ``sigs``."""
    listed = sigs.flatten().to_numpy(zero_copy_only=False).view(U64)
    lister = np.repeat(np.arange(len(sigs)), pc.fill_null(pc.list_value_length(sigs), 0).to_numpy(zero_copy_only=False))
    values, own = np.unique(np.concatenate([sig, listed]), return_inverse=True)
    pair = np.concatenate([owner, lister]) * len(values) + own
    return np.flatnonzero(np.isin(pair[:len(sig)], pair[len(sig):]))


def chains(docs: DataFrame, bands: Bands, thresholds: dict[int, int], shingle: int) -> DataFrame:
    """``sig, rep, low<l>, high<l>, room<l>``: parity of the elements in the ``l`` segments from an entry's own on.

    Of every document (``id, text, sigs``) the entries listed in ``sigs`` only;
    without that column, all.

    Of integers around a ring whose sum is positive, some one has only positive
    sums from it on (cycle lemma).  With v_i + 1 less the difference in segment
    i, similar sets so have an entry from which, for each l, the l segments
    differ in fewer than the sum of their v_i + 1: in ``room`` at most.
    """
    v = _levels(bands, thresholds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            grams, offs = shingles(b.column("text"), shingle)
            for _, held, scheme in _schemes(grams, offs, bands):
                sig, at, element, slot, segment, owner = entries(grams, offs, held, scheme, bands, v)
                if "sigs" in b.schema.names:
                    used = _asked(sig, owner[at], b.column("sigs"))
                    sig, at = sig[used], at[used]
                bit = mix(element ^ U64(0xC4A1)) >> U64(57)
                parity = np.zeros((2, len(segment)), U64)
                np.bitwise_xor.at(parity, ((bit >> U64(6)).astype(np.int64), slot), U64(1) << (bit & U64(63)))
                m = bands.segments[scheme]
                first = np.repeat(np.concatenate(([0], np.cumsum(m)[:-1])), m)
                m = np.repeat(m, m)
                within = np.arange(len(segment)) - first
                room = v[segment].astype(np.int64) + 1
                cols, size = [], 1
                for length in CHAINS:
                    after = first + (within + size) % m
                    parity, room, size = parity ^ parity[:, after], room + room[after], length
                    cols += [signed(parity[0][at]), signed(parity[1][at]), np.where(m >= length, room - 1, 2 * SKETCH)[at].astype(np.int16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(sig)), b.column("id").take(pa.array(owner[at])), *map(pa.array, cols)], names=["sig", "rep", *names])

    names = [f"{kind}{length}" for length in CHAINS for kind in ("low", "high", "room")]
    kinds = ", ".join(f"{c} {'short' if c.startswith('room') else 'long'}" for c in names)
    return docs.mapInArrow(rows, f"sig long, rep long, {kinds}")


def _apart(a: str, b: str, words: list[str]) -> Column:
    """Bits that differ in the given words of both sides."""
    return sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in words), F.lit(0))


def whole_words(sketches: DataFrame) -> DataFrame:
    """``rep, w``: the whole parity of each set (``id, parity``) as numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.frombuffer(b"".join(b.column("parity").to_pylist()), ">i8").astype(np.int64)
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * WORDS)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(at, pa.array(words))], names=["rep", "w"])

    return sketches.select("id", "parity").mapInArrow(rows, "rep long, w array<long>")


def _in_step(a: str, b: str, percent: int) -> Column:
    """The whole parities allow the similarity, and no chain from this entry on differs by more than its room."""
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    ok = F.lit(True)
    for n in CHAINS:
        ok = ok & F.coalesce(_apart(a, b, [f"low{n}", f"high{n}"]) <= F.col(f"{a}.room{n}"), F.lit(True))
    bits = F.zip_with(f"{a}.w", f"{b}.w", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return ok & ((100 + percent) * F.aggregate(bits, F.lit(0), lambda all_bits, x: all_bits + x) <= (100 - percent) * both)


def shared(rows: DataFrame) -> DataFrame:
    """The distinct rows of buckets where a set of the bucket's band meets another set."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_row = None, None  # last row; the first of its bucket while alone
        for b in batches:
            if not b.num_rows:
                continue
            sig, guest, d1 = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            goes_on = last is not None and sig[0] == last[0]
            new_sig, new = np.ones(len(sig), bool), np.ones(len(sig), bool)
            new_sig[1:] = sig[1:] != sig[:-1]
            new[1:] = new_sig[1:] | (d1[1:] != d1[:-1])
            new_sig[0] = not goes_on
            new[0] = not goes_on or d1[0] != last[2]
            bucket = np.cumsum(new_sig) - int(not goes_on)
            sizes = np.bincount(bucket, new)
            heads = np.zeros(len(sizes), np.int64)
            heads[bucket[::-1]] = guest[::-1]  # the first row's: a bucket's own sets come first
            if goes_on:
                sizes[0] += 1 if open_row is not None else 2
                heads[0] = last[3]
            good = (sizes >= 2) & (heads == 0)
            out = new & good[bucket]
            cols = [sig[out], guest[out], d1[out]]
            if goes_on and open_row is not None and good[0]:
                cols = [np.append(c, x) for c, x in zip(cols, open_row)]
            if not (goes_on and bucket[-1] == 0):
                open_row = None
            if sizes[-1] >= 2:
                open_row = None
            elif open_row is None:
                at = np.flatnonzero(new & (bucket == bucket[-1]))[0]
                open_row = (sig[at], guest[at], d1[at])
            last = (sig[-1], guest[-1], d1[-1], heads[-1])
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["sig", "guest", "d1"])

    placed = rows.repartition(shuffle_parts(rows.sparkSession), "sig").sortWithinPartitions("sig", "guest", "d1")
    return placed.mapInArrow(stream, "sig long, guest byte, d1 long")


def _plausible(a: str, b: str, percent: int) -> Column:
    """Sizes and parity bits allow the similarity: the difference is at most (100 - percent) / (100 + percent) of both sizes."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = _apart(a, b, [f"p{k}" for k in range(4)])
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * apart <= (100 - percent) * (na + nb))


def near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole parity sketches allow the similarity (``sketches``: ``id, n, parity``)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("parity_a", "parity_b"))
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                both = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
                yield b.select(["a", "b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * both))

    with_a = pairs.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("parity_a")), "a")
    with_b = with_a.join(sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b")), "b")
    return with_b.mapInArrow(rows, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough, compared element by element."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "text_a"), "text_b"):
            (x, ox), (y, oy) = shingles(b.column("text_a"), shingle), shingles(b.column("text_b"), shingle)
            keep = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                u, w = x[ox[k]:ox[k + 1]], y[oy[k]:oy[k + 1]]
                both = len(np.intersect1d(u, w, assume_unique=True))
                keep[k] = 100 * both >= percent * (len(u) + len(w) - both)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(rows, "a long, b long")


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE,
) -> DataFrame:
    """``<id>, n_shingles, class_id, component_id`` for every row.

    ``class_id`` is the least id of the same set, ``component_id`` the least id
    that links lead to (two documents link when 100 * shared >= percent * all
    of their shingles).  Texts without words have no set and no links; null
    text is one of these.  Rows that share an id are documents of their own
    (each is linked by its own text, and named by the shared id); a null id takes
    part as the least of all and is null again in the result; an empty table
    gives no rows; other columns are ignored; texts are read whole.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = each_row(source, lambda rows, _: _similar(rows, percent, shingle), ["id", "class_id", "component_id"])
    known = {c: F.when(F.col(c) != NULL_ID, F.col(c)) for c in ("id", "class_id", "component_id")}
    return out.select(known["id"].alias(id_col), "n_shingles", known["class_id"].alias("class_id"), known["component_id"].alias("component_id"))


def _similar(source: DataFrame, percent: int, shingle: int) -> DataFrame:
    spark = source.sparkSession
    sets = stored(describe(source, percent, shingle), "sets")
    sketch = ["p0", "p1", "p2", "p3"]
    classes = stored(sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), *(F.first(p).alias(p) for p in [*sketch, "parity"])), "classes")
    largest = classes.agg(F.max("n")).first()[0] or 0
    bands = Bands(percent, largest)
    if largest:
        thresholds = allocate(source, bands, shingle)
        met = shared(signatures(source, bands, thresholds, shingle))
        held = stored(met.join(classes, "d1").select("sig", "guest", "rep", "n", *sketch), "held")
        texts = stored(source.join(held.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]), "texts")
        component = _components(held, bands, thresholds, classes.select(F.col("rep").alias("id"), "n", "parity").dropDuplicates(["id"]), texts, percent, shingle)
    else:
        component = spark.createDataFrame([], "node long, component long")
    member = sets.join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"], "left")
    out = member.join(component, F.col("rep") == F.col("node"), "left")
    ids = [F.coalesce(*c) for c in (("rep", "id"), ("component", "rep", "id"))]
    return out.select("id", F.col("n").alias("n_shingles"), ids[0].alias("class_id"), ids[1].alias("component_id"))


def central(rest: DataFrame) -> DataFrame:
    """``rep, degree``: members of all buckets of a set together; the sets in the middle of a group of near copies meet most."""
    crowd = rest.groupBy("sig").agg(F.count(F.lit(1)).alias("members"))
    return rest.select("sig", "rep").join(crowd, "sig").groupBy("rep").agg(F.sum("members").alias("degree"))


def probes(now: DataFrame, r: int) -> DataFrame:
    """The rows of ``now`` that lead their buckets in round ``r``: the most central one and ``LEADERS`` others, the band's own sets first."""
    keys = [F.struct("guest", -F.col("degree"), "rep"), *(F.struct("guest", F.xxhash64(F.lit(r), F.lit(k), "sig", "rep"), F.col("rep")) for k in range(LEADERS))]
    lead = now.groupBy("sig").agg(F.array(*(F.min_by("rep", k) for k in keys)).alias("reps"))
    return now.join(lead.select("sig", F.explode(F.array_distinct("reps")).alias("rep")), ["sig", "rep"], "left_semi")


def _components(held: DataFrame, bands: Bands, thresholds: dict[int, int], sketches: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    sketch = ["p0", "p1", "p2", "p3"]
    links, found = None, None

    def labelled() -> DataFrame:
        if found is None:
            return held.withColumn("c", F.col("rep"))
        return held.join(found, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")

    def add(pairs: DataFrame) -> None:
        nonlocal links, found
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        close = stored(near(pairs, sketches, percent), "close")  # what led to the pairs is let go before texts move
        new = stored(verified(close, texts, percent, shingle).coalesce(parts_for(close.count(), PAIRS)), "links")
        links = new if links is None else links.unionByName(new)
        found = stored(components(links), "components")

    def leader(r: int) -> Column:
        order = Window.partitionBy("sig").orderBy("guest", F.xxhash64(F.lit(r), "rep"))
        return F.first(F.struct("rep", "n", "c", *sketch)).over(order)

    led = labelled().withColumns({f"y{r}": leader(r) for r in range(LEADERS)})
    star = led.select(F.struct("rep", "n", "c", *sketch).alias("x"), F.explode(F.array(*[f"y{r}" for r in range(LEADERS)])).alias("y"))
    led = star.where((F.col("x.c") != F.col("y.c")) & _plausible("x", "y", percent)).groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).count()
    add(led.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b")))
    now = labelled()
    mixed = now.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig")
    rest = stored(now.join(mixed, "sig", "left_semi").drop("c"), "rest")
    asked = rest.groupBy(F.col("rep").alias("id")).agg(F.collect_set("sig").alias("sigs"))  # no more than a text has entries
    steps = chains(texts.join(asked, "id"), bands, thresholds, shingle)
    rest = stored(rest.join(central(rest), "rep").join(whole_words(sketches), "rep").join(steps, ["sig", "rep"], "left"), "steps")

    def split() -> DataFrame:
        now = rest.join(found, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")
        parts = now.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("members"))
        mixed = parts.groupBy("sig").agg(F.count(F.lit(1)).alias("parts"), F.max_by("c", F.struct("members", "c")).alias("most")).where("parts > 1")
        return now.join(mixed.select("sig", "most"), "sig")

    alike = (F.col("x.c") != F.col("y.c")) & (F.col("x.guest") + F.col("y.guest") < 2) & _plausible("x", "y", percent) & _in_step("x", "y", percent)
    for r in range(PROBES):
        now = split()
        led = now.alias("x").join(probes(now, r).alias("y"), (F.col("x.sig") == F.col("y.sig")) & alike)
        led = led.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).count()
        add(led.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b")))
    now = split()
    few = now.where("c <> most").alias("x")  # a bucket's main component is met by the others, not by itself
    once = (F.col("y.c") == F.col("y.most")) | (F.col("x.rep") < F.col("y.rep"))
    pairs = few.join(now.alias("y"), (F.col("x.sig") == F.col("y.sig")) & once & alike)
    add(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")))
    return found
