"""Evaluation texts leaking into training text (problem 7).

Words are numbered by the items' vocabulary.  A CGK random walk reads a window of
words, stays or moves on by a random bit of the word it stands on, and writes that
word at each step: windows within a small edit distance give strings within a small
Hamming distance.  Sampling places of these strings (bit-sampling LSH) gives a
signature; pages and items meet where signatures agree, and an exact comparison
decides.  For windows that must agree word for word the strings are equal, so one
repetition finds all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoframe.llm.visual import canonical

_BROKEN = re.compile("(?<=[^\\W_])[-‐¬=] *\n *(?=[^\\W_])")
_WORD = re.compile(r"[^\W_]+")
#: Places of the walk that a signature is made of (half as many where edits are allowed), and repetitions at most.
SAMPLED, MOST_WALKS = 8, 400
#: Blocks of items that are held against a page in one pass over the pages.
BLOCKS = 4


def words_of(text: str | None) -> list[str]:
    """Words of the consistent form in lower case; a word broken at a line's end is one word."""
    return [] if not text else _WORD.findall(_BROKEN.sub("", canonical(text).lower()))


class Walk:
    """One repetition: the random walk over windows of ``n`` words and the sampled places of what it writes."""

    def __init__(self, n: int, seed: int, sampled: int = SAMPLED):
        rng = np.random.default_rng(seed)
        self.n, self.steps = n, 3 * n
        self.places = set(rng.choice(self.steps, min(sampled, self.steps), replace=False).tolist())
        self.seed = int(rng.integers(1, 1 << 62))

    def signatures(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Signature of the window at each start; ``hashes`` has a random 64-bit value for each word in order."""
        at = np.zeros(len(starts), np.int64)
        sig = np.full(len(starts), self.seed, np.uint64)
        for j in range(self.steps):
            word = np.where(at < self.n, hashes[np.minimum(starts + at, len(hashes) - 1)], np.uint64(0))
            if j in self.places:
                sig = (sig ^ word) * np.uint64(0x9E3779B97F4A7C15)
                sig ^= sig >> np.uint64(29)
            at += (word >> np.uint64((j * 7 + self.seed) % 61) & np.uint64(1)).astype(np.int64)
        return sig


class Part:
    """The words ``a`` up to before ``b`` of a window, looked for ``shift`` words further on in a page."""

    def __init__(self, n: int, a: int, b: int, shift: int = 0):
        self.n, self.a, self.b, self.shift = n, a, b, shift

    def signatures(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sig = np.full(len(starts), self.b, np.uint64)
        for j in range(self.a, self.b):
            sig = (sig ^ hashes[np.clip(starts + j + self.shift, 0, len(hashes) - 1)]) * np.uint64(0x9E3779B97F4A7C15)
            sig ^= sig >> np.uint64(29)
        return sig


def parts_of(n: int, edits: int) -> list[list[Part]]:
    """A window cut into ``edits + 1`` parts, one of which every passage within the edits still has, up to ``edits`` words away."""
    cuts = [n * i // (edits + 1) for i in range(edits + 2)]
    return [[Part(n, a, b, d) for d in (0, *(x * s for x in range(1, edits + 1) for s in (-1, 1)))] for a, b in zip(cuts, cuts[1:])]


def _word_hashes(size: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, (1 << 63) - 1, size + 1, np.int64).astype(np.uint64)


#: Kinds of word edits: another word, a further word, a word less, and all of them mixed.
CHANGED, PUT_IN, LEFT_OUT, MIXED = range(4)


def _edited(wins: np.ndarray, edits: int, kind: int, seed: int) -> np.ndarray:
    """Windows after so many random word edits of a kind, and what follows them in a page: ``edits`` longer than before.

    Half of the words that come in or follow are unknown (0), half are words of the windows.
    """
    rng = np.random.default_rng(seed)
    long = wins.shape[1] + edits
    out = np.zeros((len(wins), long), wins.dtype)
    other = lambda n: rng.choice(wins.ravel(), n) * rng.integers(0, 2, n)
    for i, w in enumerate(wins.tolist()):
        for _ in range(edits):
            what = kind if kind != MIXED else int(rng.integers(3))
            at = int(rng.integers(max(1, len(w))))
            w[at : at + (what != PUT_IN)] = other(1).tolist() if what != LEFT_OUT else []
        w += other(max(0, long - len(w))).tolist()
        out[i] = w[:long]
    return out


def walks_for(wins: np.ndarray, hashes: np.ndarray, edits: int, recall: float) -> list[list[Walk | Part]]:
    """As many walks as find edited windows at the wanted rate; where ``MOST_WALKS`` don't, parts, which miss nothing.

    Measured after verification, on up to 500 of the windows for each kind of edit; the
    kind that is found least decides.
    """
    n = wins.shape[1]
    if not edits:
        return [[Walk(n, 1000 * n)]]
    some = np.resize(wins[:: max(1, len(wins) // 500)][:500], (500, n))
    begin = np.arange(len(some)) * n
    other = np.concatenate([_edited(some, edits, kind, 10 * n + kind) for kind in range(4)])
    many = np.tile(some, (4, 1))
    holds = passage_distances(many, other, edits) <= edits
    met, walks = np.zeros(len(many), bool), []
    while (met & holds).reshape(4, -1).mean(1).min() < (1 + recall) / 2 and len(walks) < MOST_WALKS:
        walks.append(Walk(n, 1000 * n + len(walks), SAMPLED // 2))
        met |= np.tile(walks[-1].signatures(hashes[some.ravel()], begin), 4) == walks[-1].signatures(hashes[other.ravel()], np.arange(len(many)) * other.shape[1])
    return [[w] for w in walks] if (met & holds).reshape(4, -1).mean(1).min() >= recall else parts_of(n, edits)


def passage_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word edits from each row of a to the nearest beginning of the same row of b, of whatever length; above ``most`` only as that."""
    row = np.repeat(np.arange(b.shape[1] + 1, dtype=np.int16)[:, None], len(a), 1)
    for i in range(a.shape[1]):
        new = np.full_like(row, most + 1)
        if i < most:
            new[0] = i + 1
        for j in range(max(0, i - most), min(b.shape[1], i + most + 1)):  # cells off the diagonal cost more than ``most``
            cost = row[j] + (a[:, i] != b[:, j])
            new[j + 1] = np.minimum(np.minimum(row[j + 1], new[j]) + 1, cost)
        row = new
    return row.min(0)


class ItemBlock:
    """Windows of a block of items, ready to be looked up: sent to all tasks, bounded by the block's size."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int, max_edits: int, recall: float):
        self.max_edits, self.vocabulary = max_edits, {}
        self.item_ids = [i for i, _ in items]
        rows: dict[int, tuple[list[np.ndarray], list[int]]] = {}
        for k, (_, words) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            n = min(window, len(ids))
            for a in range(len(ids) - n + 1 if n else 0):
                own = rows.setdefault(n, ([], []))
                own[0].append(ids[a : a + n])
                own[1].append(k)
        hashes = _word_hashes(len(self.vocabulary))
        self.tables = []
        for n, (wins, owner) in sorted(rows.items()):
            wins, owner = np.stack(wins).astype(np.int32), np.array(owner)
            known = np.zeros(len(self.vocabulary) + 1, bool)
            known[np.unique(wins)] = True
            edits = n * max_edits // window  # an item shorter than a window may differ in its share of the edits
            for probes in walks_for(wins, hashes, edits, recall):
                sig = probes[0].signatures(hashes[wins.ravel()], np.arange(len(wins)) * n)
                order = np.argsort(sig, kind="stable")
                self.tables += [(probe, edits, sig[order], wins[order], owner[order], known) for probe in probes]
        self.hashes = hashes

    def found(self, ids: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Rows (page, item) for the words ``ids`` of several pages; a 0 ends each page, ``max_edits`` of them if more."""
        out, starts, starts_of, hashes = [], None, -1, self.hashes[ids]
        for probe, edits, sig, wins, owner, known in self.tables:
            n = probe.n
            if len(ids) < n:
                continue
            if starts_of != n:  # tables of one length follow one another
                # each edit brings at most one word into the window that no item window has
                gap = np.concatenate(([0], np.cumsum(~known[ids])))
                fit = gap[n:] - gap[:-n] <= edits
                if edits:
                    fit &= page[n - 1 :] == page[: len(page) - n + 1]
                starts, starts_of = np.flatnonzero(fit), n
            if not len(starts):
                continue
            own = probe.signatures(hashes, starts)
            lo = np.searchsorted(sig, own, "left")
            hits = np.flatnonzero((lo < len(sig)) & (sig[np.minimum(lo, len(sig) - 1)] == own))
            if not len(hits):
                continue
            lo, hi = lo[hits], np.searchsorted(sig, own[hits], "right")
            which = np.repeat(np.arange(len(hits)), hi - lo)
            win = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            start = starts[hits][which]
            if edits:  # the page's passage may be shorter or longer than the item's
                at = start[:, None] + np.arange(n + edits)
                inside = (at < len(ids)) & (page[np.minimum(at, len(ids) - 1)] == page[start][:, None])
                good = passage_distances(wins[win], np.where(inside, ids[np.minimum(at, len(ids) - 1)], -1), edits) <= edits
            else:
                good = (ids[start[:, None] + np.arange(n)] == wins[win]).all(1)
            out.append(np.stack((page[start[good]], owner[win[good]]), 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _blocks(items: DataFrame, key: str, text: str, words: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Items in blocks of about so many words, one block at a time in the driver."""
    block, size = [], 0
    rows = items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("k is not null and t is not null")
    for r in rows.toLocalIterator():
        w = words_of(r["t"])
        block.append((r["k"], w))
        size += len(w)
        if size >= words:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(
    pages: DataFrame, page_key: str, page_text: str, items: DataFrame, item_key: str, item_text: str,
    window: int = 12, max_edits: int = 0, recall: float = 0.9, block_words: int = 200_000,
) -> DataFrame:
    """Pages that hold a passage of an item: ``page_key, item_key``, each pair once.

    A passage is ``window`` consecutive words of the item, or all words of a shorter
    item, with at most ``max_edits`` words changed, put in or left out (of a shorter
    item its share, rounded down; 0: exact,
    nothing is missed; more: as many repetitions as ``recall`` needs for each kind of edit).  The stated items are taken in blocks of
    ``block_words`` words, ``BLOCKS`` of them sent to all tasks at once and held against
    all pages, so what is broadcast has a fixed bound, each page is read and cut into
    words once for so many blocks, and no page is shuffled; only found pairs are.

    * null or wordless texts hold nothing and are in nothing; a null key is left out;
    * whole texts are read, whatever their length; repeated rows give a pair once;
    * items that share wording are all reported; an empty table on either side gives no pairs.
    """
    kinds = dict(pages.dtypes)[page_key], dict(items.dtypes)[item_key]
    source = pages.where(F.col(f"`{page_key}`").isNotNull()).select(F.col(f"`{page_key}`").alias("page"), F.col(f"`{page_text}`").alias("text")).where("text is not null")
    spark, result = pages.sparkSession, None
    blocks = _blocks(items, item_key, item_text, block_words)
    while some := list(islice(blocks, BLOCKS)):
        sent = [spark.sparkContext.broadcast(ItemBlock(b, window, max_edits, recall)) for b in some]

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = [x.value for x in sent]
            for b in batches:
                keys, texts = b.column(0), b.column(1).to_pylist()
                for a in range(0, len(texts), 500):
                    words = [words_of(t) for t in texts[a : a + 500]]
                    for block in own:
                        number, end = block.vocabulary.get, [0] * max(1, block.max_edits)
                        ids: list[int] = []
                        ends = []
                        for w in words:
                            ids += [number(x, 0) for x in w]
                            ids += end
                            ends.append(len(ids))
                        page = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
                        pairs = block.found(np.array(ids, np.int64), page)
                        if len(pairs):
                            yield pa.RecordBatch.from_arrays([keys.take(pa.array(pairs[:, 0] + a)), pa.array(block.item_ids).take(pa.array(pairs[:, 1]))], ["page", "item"])

        part = source.mapInArrow(search, f"page {kinds[0]}, item {kinds[1]}")
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], f"`{page_key}` {kinds[0]}, `{item_key}` {kinds[1]}")
    return result.distinct().select(F.col("page").alias(page_key), F.col("item").alias(item_key))
