"""K-mers and repeats within a record.

Everything here stays inside one record, so records are worked on where they lie
and nothing is shuffled: words are packed into integers and sorted, a batch of
records at a time.  Words are upper case; those with other letters than A, C, G, T
have no repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoframe.functions.seq import simple_reverse_complement

CODES = np.full(256, 4, np.uint8)
for _i, _pair in enumerate(("aA", "cC", "gG", "tT")):
    CODES[[ord(x) for x in _pair]] = _i
ROWS = 1 << 18
#: Bytes of results that are held before they are handed on; one record may have more.
BYTES = 1 << 24


def per_record(df: DataFrame, key: str, seq: str, work: Callable[[str], dict[str, object] | Iterator[dict[str, object]]], fields: str) -> DataFrame:
    """``key`` and the rows that ``work`` returns for each text, as columns of equal length, or in pieces; null texts give none."""
    kind = dict(df.dtypes)[key]
    names = [f.split()[0] for f in fields.split(", ")]
    schema = df.sparkSession.createDataFrame([], fields).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, parts, size, held = [], [[] for _ in names], 0, 0

            def flush() -> pa.RecordBatch:
                cols = [pa.concat_arrays(x) if x else pa.array([], t) for x, t in zip(parts, types)]
                own = pa.array(np.repeat([o for o, _ in owner], [n for _, n in owner]).astype(np.int64) if owner else np.array([], np.int64))
                return pa.RecordBatch.from_arrays([b.column(0).take(own), *cols], ["key", *names])

            for i, t in enumerate(b.column(1).to_pylist()):
                if t is None:
                    continue
                done = work(t)
                for out in (done,) if isinstance(done, dict) else done:
                    n = len(out[names[0]])
                    if not n:
                        continue
                    owner.append((i, n))
                    for p, name, kind_ in zip(parts, names, types):
                        p.append(pa.array(out[name], kind_))
                    size, held = size + n, held + sum(p[-1].nbytes for p in parts)
                    if size >= ROWS or held >= BYTES:
                        yield flush()
                        owner, parts, size, held = [], [[] for _ in names], 0, 0
            yield flush()

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{seq}`").alias("seq"))
    return rows.mapInArrow(run, f"key {kind}, {fields}").withColumnRenamed("key", key)


class Index:
    """Next and previous place of the same word, -1 where there is none."""

    def __init__(self, text: str, k: int):
        self.text, self.k = text.upper(), k
        codes = CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        n = self.n = max(0, len(codes) - k + 1)
        word = np.zeros(n, np.uint64)
        for i in range(k):
            word = (word << np.uint64(2)) | (codes[i : i + n] & 3).astype(np.uint64)
        foreign = np.concatenate(([0], np.cumsum(codes > 3)))
        good = np.flatnonzero(foreign[k:] == foreign[:-k]) if n else np.array([], np.int64)
        order = good[np.argsort(word[good], kind="stable")]
        same = np.flatnonzero(word[order[1:]] == word[order[:-1]])
        self.next, self.prev = np.full(n, -1), np.full(n, -1)
        self.next[order[same]] = order[same + 1]
        self.prev[order[same + 1]] = order[same]

    @property
    def repeated(self) -> np.ndarray:
        return (self.next >= 0) | (self.prev >= 0)

    def words(self, at: np.ndarray) -> list[str]:
        return [self.text[i : i + self.k] for i in at.tolist()]


def _valid(k: int, most: int = 31) -> None:
    if not 1 <= k <= most:
        raise ValueError(f"the word size must be between 1 and {most}")


def word_list(seq: Column, k: int, include_rc: bool = False, drop_last: bool = False) -> Column:
    """All words of a sequence in order, then those of its reverse complement."""

    def words(s: Column) -> Column:
        every = F.regexp_extract_all(F.upper(s), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
        return F.slice(every, F.lit(1), F.greatest(F.size(every) - 1, F.lit(0))) if drop_last else every

    return F.concat(words(seq), words(simple_reverse_complement(seq))) if include_rc else words(seq)


def _counts(text: str, k: int, include_rc: bool) -> tuple[list[str], np.ndarray]:
    """The distinct words of a text and how often each occurs."""
    text = text.upper()
    both = (text, text.translate(str.maketrans("ACGT", "TGCA"))[::-1])[: 1 + include_rc]
    if len(text) < k:
        return [], np.array([], np.int64)
    every = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(s.encode("utf-32-le"), np.uint32), k) for s in both])
    small = every.max() < 128  # letters of one byte, the usual case
    words, n = np.unique(np.ascontiguousarray(every.astype(np.uint8) if small else every).view(f"S{k}" if small else f"U{k}").ravel(), return_counts=True)
    return words.astype(f"U{k}").tolist(), n


def word_counts(df: DataFrame, key: str, seq: str, k: int, include_rc: bool = False) -> DataFrame:
    """``key, word, n``: how often each word occurs in each record."""

    def work(t: str) -> dict[str, object]:
        words, n = _counts(t, k, include_rc)
        return {"word": words, "n": n}

    return per_record(df, key, seq, work, "word string, n bigint")


def duplicate_words(df: DataFrame, key: str, seq: str, k: int, include_rc: bool = False) -> DataFrame:
    """``key, duplicates``: how many words of each record occur more than once."""

    def work(t: str) -> dict[str, object]:
        return {"duplicates": [int((_counts(t, k, include_rc)[1] > 1).sum())]}

    return per_record(df, key, seq, work, "duplicates bigint")


def repeat_index(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """``key, pos, word, nxt, prev, code`` of all repeated words; ``code`` is the next place, or -1 at the last."""
    _valid(k)

    def work(t: str) -> dict[str, object]:
        x = Index(t, k)
        at = np.flatnonzero(x.repeated)
        nxt, prev = x.next[at], x.prev[at]
        return {"pos": at, "word": x.words(at), "nxt": pa.array(nxt, pa.int64(), mask=nxt < 0), "prev": pa.array(prev, pa.int64(), mask=prev < 0), "code": nxt}

    return per_record(df, key, seq, work, "pos bigint, word string, nxt bigint, prev bigint, code bigint")


def places_of(df: DataFrame, key: str, seq: str, query: str) -> DataFrame:
    """``key, pos``: all places of a sequence, overlapping ones too."""
    wanted = query.upper()

    def work(t: str) -> dict[str, object]:
        t, out = t.upper(), []
        i = t.find(wanted)
        while i >= 0:
            out.append(i)
            i = t.find(wanted, i + 1)
        return {"pos": out}

    return per_record(df, key, seq, work, "pos bigint")


def screen_ends(df: DataFrame, key: str, seq: str, k: int, n: int) -> DataFrame:
    """``key, five, three``: whether a word among the first (last) ``n`` is repeated (is the last of its repeats)."""
    _valid(k)

    def work(t: str) -> dict[str, object]:
        x = Index(t, k)
        last = (x.next < 0) & (x.prev >= 0)
        return {"five": [bool(x.repeated[:n].any())], "three": [bool(last[-n:].any())]}

    return per_record(df, key, seq, work, "five boolean, three boolean")


def _diagonals(at: np.ndarray, nxt: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((at, nxt - at))
    a, b = at[order], nxt[order]
    new = np.ones(len(a), bool)
    new[1:] = (b[1:] - a[1:] != b[:-1] - a[:-1]) | (a[1:] != a[:-1] + 1)
    first = np.flatnonzero(new)
    return a[first], b[first], np.diff(np.concatenate((first, [len(a)]))) + k - 1


def close_repeats(df: DataFrame, key: str, seq: str, k: int, gap: int) -> DataFrame:
    """``key, first, second, length``: repeats less than ``gap`` apart, neighbours of one distance merged."""
    _valid(k)

    def work(t: str) -> dict[str, object]:
        x = Index(t, k)
        at = np.flatnonzero((x.next >= 0) & (x.next - np.arange(x.n) < gap))
        a, b, n = _diagonals(at, x.next[at], k)
        return {"first": a, "second": b, "length": n}

    return per_record(df, key, seq, work, "first bigint, second bigint, length bigint")


class Repeats:
    """Maximal repeats of ``k`` letters or more: intervals of the sorted suffixes, from all occurrences and without forming pairs.

    Other letters than A, C, G, T and the text's end agree with nothing, not even with themselves.
    """

    def __init__(self, text: str, k: int):
        self.text, self.k = text.upper(), k
        code = CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)].astype(np.int64)
        n = self.n = len(code)
        self.code = np.append(np.where(code < 4, code, 4 + np.arange(n)), 4 + n)
        if n > k:
            self._sort()

    def _sort(self) -> None:
        """Suffixes in order by doubling the compared length; groups that are single stay as they are."""
        n, h = self.n + 1, 16
        small = np.concatenate((np.minimum(self.code, 4), np.full(h, 4)))
        word, foreign = np.zeros(n, np.int64), np.zeros(n, bool)
        for i in range(h):
            word = word * 5 + small[i : i + n]
            foreign |= small[i : i + n] > 3
        order = np.lexsort((np.where(foreign, 1 + np.arange(n), 0), word))
        new = np.ones(n, bool)
        new[1:] = (word[order[1:]] != word[order[:-1]]) | foreign[order[1:]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        levels = [(h, rank)]
        while not new.all():
            many = np.flatnonzero(~(new & np.append(new[1:], True)))
            sub = order[many]
            second = rank[sub + h]
            o = np.lexsort((second, rank[sub]))
            sub, second = sub[o], second[o]
            order[many] = sub
            own = np.ones(len(sub), bool)
            own[1:] = (rank[sub[1:]] != rank[sub[:-1]]) | (second[1:] != second[:-1])
            new[many] = own
            rank = rank.copy()
            rank[sub] = many[np.maximum.accumulate(np.where(own, np.arange(len(sub)), 0))]
            h *= 2
            levels.append((h, rank))
        a, b, self.order = order[:-1], order[1:], order
        lcp = np.zeros(n - 1, np.int64)
        for h, rank in reversed(levels):
            at = np.flatnonzero(rank[np.minimum(a + lcp, n - 1)] == rank[np.minimum(b + lcp, n - 1)])
            lcp[at] += h
        at = np.arange(n - 1)
        for _ in range(15):
            at = at[self.code[a[at] + lcp[at]] == self.code[b[at] + lcp[at]]]
            lcp[at] += 1
        self.lcp = lcp

    def __iter__(self) -> Iterator[tuple[str, list[int]]]:
        """Each repeat with all its places in order."""
        if self.n <= self.k:
            return
        before = np.where(self.order > 0, self.code[self.order - 1], -1)
        turns = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))  # letters before agree from lo to hi where this does
        at = np.flatnonzero(self.lcp >= self.k)
        open_: list[tuple[int, int]] = []
        ends = np.append(np.diff(at) != 1, True) if len(at) else []
        for i, m, end in zip(at.tolist(), self.lcp[at].tolist(), ends):
            lo = i
            while open_ and open_[-1][0] > m:
                length, lo = open_.pop()
                yield from self._repeat(length, lo, i, turns)
            if not open_ or open_[-1][0] < m:
                open_.append((m, lo))
            while end and open_:
                length, lo = open_.pop()
                yield from self._repeat(length, lo, i + 1, turns)

    def _repeat(self, length: int, lo: int, hi: int, turns: np.ndarray) -> Iterator[tuple[str, list[int]]]:
        if turns[lo] != turns[hi]:
            places = np.sort(self.order[lo : hi + 1]).tolist()
            yield self.text[places[0] : places[0] + length], places


def all_repeats(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """``key, repeat, places``: the distinct longest repeats over all pairs of occurrences, each with all its places in order.

    A repeat whose occurrences can all be lengthened alike, to the left or to the
    right, is left out for the longer one.
    """
    _valid(k)

    def work(t: str) -> Iterator[dict[str, object]]:
        out: dict[str, list] = {"repeat": [], "places": []}
        size = 0
        for repeat, places in Repeats(t, k):
            out["repeat"].append(repeat)
            out["places"].append(places)
            size += len(repeat) + 8 * len(places)
            if size > BYTES:
                yield out
                out, size = {"repeat": [], "places": []}, 0
        yield out

    return per_record(df, key, seq, work, "repeat string, places array<bigint>")


def window_counts(df: DataFrame, key: str, seq: str, k: int, window: int, most: int = 0) -> DataFrame:
    """``key, start, n``: windows with more than ``most`` words whose next occurrence starts in the window too."""
    _valid(k)

    def work(t: str) -> dict[str, object]:
        x = Index(t, k)
        starts = len(t) - window + 1
        if starts < 1:
            return {"start": [], "n": []}
        at = np.flatnonzero((x.next >= 0) & (x.next - np.arange(x.n) <= window - k))
        nxt = x.next[at]
        change = np.zeros(starts + 1, np.int64)
        lo, hi = np.maximum(nxt - (window - k), 0), np.minimum(at, starts - 1) + 1
        ok = lo < hi
        np.add.at(change, lo[ok], 1)
        np.add.at(change, hi[ok], -1)
        n = np.cumsum(change)[:starts]
        bad = np.flatnonzero(n > most)
        return {"start": bad, "n": n[bad]}

    return per_record(df, key, seq, work, "start bigint, n bigint")


def window_words(df: DataFrame, key: str, seq: str, k: int, start: int, window: int) -> DataFrame:
    """``key, word, places``: the repeated words of one window; records that end before it give none."""
    _valid(k)

    def work(t: str) -> dict[str, object]:
        x = Index(t[start : start + window], k) if len(t) >= start + window else Index("", k)
        found: dict[str, list[int]] = {}
        at = np.flatnonzero(x.repeated)
        for w, p in zip(x.words(at), at.tolist()):
            found.setdefault(w, []).append(p + start)
        return {"word": list(found), "places": list(found.values())}

    return per_record(df, key, seq, work, "word string, places array<bigint>")


def repeated_fraction(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """``key, fraction`` of the bases that a repeated word covers; null for an empty record."""
    _valid(k)

    def work(t: str) -> dict[str, object]:
        x = Index(t, k)
        change = np.zeros(len(t) + 1, np.int64)
        at = np.flatnonzero(x.repeated)
        np.add.at(change, at, 1)
        np.add.at(change, at + k, -1)
        return {"fraction": [float((np.cumsum(change)[: len(t)] > 0).sum() / len(t)) if t else None]}

    return per_record(df, key, seq, work, "fraction double")


def window_fractions(df: DataFrame, key: str, seq: str, k: int, window: int, cutoff: float) -> DataFrame:
    """``key, start, covered``: windows in which repeated words that lie whole inside cover more than ``int(window * cutoff)`` bases."""
    _valid(k)

    def work(t: str) -> dict[str, object]:
        x = Index(t, k)
        starts = len(t) - window + 1
        if starts < 1:
            return {"start": [], "covered": []}
        # what a word adds to the coverage by the words before it, and what is lost of that when they leave the window
        at = np.flatnonzero(x.repeated)
        cover = np.zeros(starts, np.int64)
        if len(at):
            gain = np.concatenate(([k], np.minimum(np.diff(at), k)))
            total = np.concatenate(([0], np.cumsum(gain)))
            lo = np.searchsorted(at, np.arange(starts))
            hi = np.searchsorted(at, np.arange(starts) + window - k, "right")
            some = hi > lo
            cover[some] = total[hi[some]] - total[lo[some] + 1] + k
        bad = np.flatnonzero(cover > int(window * cutoff))
        return {"start": bad, "covered": cover[bad]}

    return per_record(df, key, seq, work, "start bigint, covered bigint")
