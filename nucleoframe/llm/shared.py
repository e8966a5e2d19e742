"""Long exact spans shared between records (problem 5): compact windows.

The tokens of a text are its k-mers, each with a hash.  A node of the Cartesian tree
over the hashes is the leftmost minimum of all windows between its smaller
neighbours; the nodes whose range holds a window of ``min_len`` letters are its
compact windows, and they split all those windows among themselves.  Texts that
share a passage share the minimum, so the token, of every window in it.

Of windows as long as the required span, equal letter for letter, one hash function
finds every case, so there are no repetitions.  Where near-duplicate search would
join the ranges of all pairs of windows of a token, windows of equal letters are
counted here, and only those of unequal letters are opened into their spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.common import cut_lineage, latest_rows

TOKEN = 24
#: Letters that are worked on at once.
CHUNK = 1 << 20
_CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate(("aA", "cC", "gG", "tTuU")):
    _CODE[[ord(x) for x in _pair]] = _i
_SKIP = 5
_CODE[[ord(x) for x in "0123456789 \t\n\r\v\f"]] = _SKIP
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: The four letters of a byte.
_FOUR = np.stack([np.arange(256) >> s & 3 for s in (0, 2, 4, 6)], 1).astype(np.uint8)


def _packed(codes: np.ndarray, k: int) -> np.ndarray:
    """The k-mer at each position, two bits a letter, by doubling (k up to 31)."""
    n = len(codes)
    if n < k:
        return np.array([], np.uint64)
    power, done, size, step = codes.astype(np.uint64), None, 0, 1
    while True:
        if k & step:
            done = power if done is None else (done[: n - size - step + 1] << np.uint64(2 * step)) | power[size:]
            size += step
        if size == k:
            return done
        power = (power[:-step] << np.uint64(2 * step)) | power[step:]
        step *= 2


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def compact_windows(codes: np.ndarray, min_len: int, token: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token value, first and last window start of each compact window of the letters ``codes`` (4: no letter).

    A node of the tree whose range holds a window is the minimum of a run of
    neighbouring windows, so a sliding minimum lists the nodes without the others.
    """
    w = min_len - token + 1
    none = np.array([], np.int64)
    if len(codes) < min_len:
        return none, none, none
    kmer = _packed(codes & 3, token)
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    whole = bad[min_len:] == bad[:-min_len]  # windows without a foreign letter
    if not whole.any():
        return none, none, none
    at = (_sliding_min(token_hashes(kmer), w) & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(whole)
    at = at[starts]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(starts) > 1))))
    last = np.concatenate((new[1:] - 1, [len(at) - 1]))
    return kmer[at[new]].astype(np.int64), starts[new], starts[last]


def token_hashes(kmer: np.ndarray) -> np.ndarray:
    """The hash that orders the tokens, its last 24 bits the place, so that of equal tokens the leftmost is the smallest."""
    mixed = kmer * _GOLDEN
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(kmer), dtype=np.uint64)


def _packed_bytes(codes: np.ndarray, phases: int = 4) -> list[bytes]:
    """Four letters a byte, for each of the phases."""
    out = []
    padded = np.concatenate((codes & 3, np.zeros(8, np.uint8)))
    for phase in range(phases):
        x = padded[phase : phase + (len(padded) - phase) // 4 * 4].reshape(-1, 4)
        out.append((x[:, 0] | x[:, 1] << 2 | x[:, 2] << 4 | x[:, 3] << 6).astype(np.uint8).tobytes())
    return out


def pack_letters(text: str, min_len: int) -> tuple[int, bytes, bytes] | None:
    """Number of letters, the letters at two bits each, and first and length of each run of foreign ones; null if shorter than ``min_len``."""
    c = _CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    c = c[c != _SKIP]
    if len(c) < min_len:
        return None
    foreign = (c > 3).astype(np.int8)
    step = np.diff(foreign, prepend=0, append=0)
    first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    c[c > 3] = 0
    return len(c), _packed_bytes(c, 1)[0][: (len(c) + 3) // 4], np.stack((first, end - first), 1).astype(np.int32).tobytes()


def unpack_letters(n: int, letters: bytes, gaps: bytes) -> np.ndarray:
    """The codes of the letters, 4 for foreign ones."""
    codes = _FOUR[np.frombuffer(letters, np.uint8)].ravel()[:n]
    for first, size in np.frombuffer(gaps, np.int32).reshape(-1, 2).tolist():
        codes[first : first + size] = 4
    return codes


def packed_texts(df: DataFrame, key: str, text: str, min_len: int, version: str | None = None) -> DataFrame:
    """``key[, version], n, letters, gaps``: texts at two bits a letter, a quarter of their size; null for null and short ones.

    Letters are read in either case, u as t; blanks, line ends and digits don't count.
    """
    names = ["key", *(["version"] if version else [])]
    kinds = dict(df.dtypes)
    rows = df.select(F.col(f"`{key}`").alias("key"), *([F.col(f"`{version}`").alias("version")] if version else []), F.col(f"`{text}`").alias("text")).where("key is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if t is None or len(t) < min_len else pack_letters(t, min_len) for t in b.column(len(names)).to_pylist()]
            cols = [pa.array([None if g is None else g[i] for g in got], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *cols], [*names, "n", "letters", "gaps"])

    fields = ", ".join(f"{a} {kinds[c]}" for a, c in zip(names, (key, version)))
    return rows.mapInArrow(run, f"{fields}, n int, letters binary, gaps binary")


def _joined(texts: Iterator[tuple[int, bytes, bytes]], min_len: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Packed texts behind one another, a separator between them: codes, and by text its place, begin and offset."""
    parts, owner, begin, offset, size = [], [], [], [], 0
    for i, t in enumerate(texts):
        c = unpack_letters(*t)
        for a in range(0, max(1, len(c) - min_len + 1), CHUNK - min_len + 1):
            piece = c[a : a + CHUNK]
            if size and size + len(piece) + 1 > 2 * CHUNK:
                yield np.concatenate(parts), np.array(owner), np.array(begin), np.array(offset)
                parts, owner, begin, offset, size = [], [], [], [], 0
            owner.append(i)
            begin.append(size)
            offset.append(a)
            parts += [piece, np.array([4], np.uint8)]
            size += len(piece) + 1
    if parts:
        yield np.concatenate(parts), np.array(owner), np.array(begin), np.array(offset)


def _shared(rows: DataFrame, min_len: int, token: int) -> tuple[DataFrame, DataFrame]:
    """Members (``key, tid``) of each distinct text and the runs (``tid, first, spans``) of shared span starts in it.

    ``rows``: ``key, n, letters, gaps``.  Equal texts are one text with a smallest and a
    greatest key; if these differ, all of it is shared.  Its windows still meet others.
    """
    if not 1 <= token <= min(31, min_len):
        raise ValueError("token must be between 1 and 31 and not longer than min_len")
    kind = dict(rows.dtypes)["key"]
    words = -(-min_len // 31)
    of_text = ["n", "letters", "gaps"]
    own = cut_lineage(rows.where("n is not null").select("key", F.xxhash64(*of_text).alias("ha"), F.xxhash64(F.lit("second"), *of_text).alias("hb"), *of_text))
    texts = cut_lineage(own.groupBy("ha", "hb", *of_text).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).withColumn("tid", F.monotonically_increasing_id()))
    members = own.select("key", "ha", "hb").join(texts.select("ha", "hb", "tid"), ["ha", "hb"]).select("key", "tid")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for codes, owner, begin, offset in _joined(zip(*(b.column(i).to_pylist() for i in (1, 2, 3))), min_len):
                tok, first, last = compact_windows(codes, min_len, token)
                if not len(tok):
                    continue
                at = np.searchsorted(begin, first, "right") - 1
                cols = [pa.array(tok), b.column(0).take(pa.array(owner[at])), pa.array((first - begin[at] + offset[at]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["token", "tid", "pos", "spans"])

    found = texts.select("tid", *of_text).mapInArrow(windows, "token bigint, tid bigint, pos int, spans int")
    # partial aggregation leaves one row of a hot token in each task; the join splits it
    tokens = found.groupBy("token").agg(F.min("tid").alias("a"), F.max("tid").alias("b")).where("a <> b").select("token")
    likely = found.join(tokens, "token", "left_semi").groupBy("tid").agg(F.collect_list(F.struct("token", "pos", "spans")).alias("w"))

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows with their letters; those of one text are as many as its length allows."""
        for b in batches:
            lists = b.column(6)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            tok, pos, spans = (flat.field(i) for i in range(3))
            p, s = pos.to_numpy(), spans.to_numpy()
            out, k = [], 0
            for n, letters, gaps, m in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), sizes.tolist()):
                phases = _packed_bytes(unpack_letters(n, letters, gaps))
                for a, size in zip(p[k : k + m].tolist(), (s[k : k + m] + (min_len - 1)).tolist()):
                    x = phases[a & 3][a >> 2 : (a >> 2) + (size + 3) // 4]
                    out.append(x[:-1] + bytes((x[-1] & (1 << 2 * (size & 3)) - 1,)) if size & 3 else x)
                k += m
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([tok, spans, pa.array(out, pa.binary()), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pos], ["token", "spans", "letters", "tid", "lo", "hi", "pos"])

    wins = cut_lineage(
        texts.join(likely, "tid").select("tid", "lo", "hi", *of_text, "w").mapInArrow(lettered, f"token bigint, spans int, letters binary, tid bigint, lo {kind}, hi {kind}, pos int")
    )
    content = ["token", "spans", "letters"]
    contents = cut_lineage(wins.groupBy(*content).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("cid", F.monotonically_increasing_id()))
    # a token with one content has no span to share beyond it
    mixed = contents.groupBy("token").agg(F.count("*").alias("m"), F.min("lo").alias("a"), F.max("hi").alias("b"), F.max(F.col("lo") == F.col("hi")).alias("alone")).where("m > 1 and a <> b and alone")
    to_open = contents.join(mixed.select("token"), "token", "left_semi").select("cid", "lo", "hi", "spans", "letters")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, letters = b.column(3).to_numpy(), b.column(4).to_pylist()
            if not len(spans):
                continue
            codes = _FOUR[np.frombuffer(b"".join(letters), np.uint8)].ravel()
            size = np.array([len(x) * 4 for x in letters])
            at_row = np.repeat(np.arange(len(spans)), spans)
            off = np.arange(len(at_row)) - np.repeat(np.cumsum(spans) - spans, spans)
            at = np.repeat(np.cumsum(size) - size, spans) + off
            longer = np.concatenate((codes, np.zeros(min_len, np.uint8)))
            cols = [pa.array(_packed(longer, min(31, min_len - 31 * i))[at + 31 * i].astype(np.int64)) for i in range(words)]
            take = pa.array(at_row)
            yield pa.RecordBatch.from_arrays([*cols, *(b.column(i).take(take) for i in range(3)), pa.array(off.astype(np.int32))], [*(f"w{i}" for i in range(words)), "cid", "lo", "hi", "off"])

    parts = [f"w{i}" for i in range(words)]
    spans = to_open.mapInArrow(opened, f"{', '.join(f'{p} bigint' for p in parts)}, cid bigint, lo {kind}, hi {kind}, off int")
    both = spans.groupBy(*parts).agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a <> b").select(*parts)
    hits = spans.where("lo = hi").join(both, parts, "left_semi").select("cid", "off", F.lit(1).alias("m"))
    every = contents.where("lo <> hi").select("cid", F.lit(0).alias("off"), F.col("spans").alias("m")).unionByName(hits)
    shared = every.join(contents.select("cid", *content), "cid")
    copied = texts.where("lo <> hi").select("tid", *of_text)
    some = wins.where("lo = hi").join(shared, content).select("tid", (F.col("pos") + F.col("off")).cast("bigint").alias("first"), F.col("m").alias("spans"))

    def free_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of span starts without a foreign letter."""
        for b in batches:
            own, first, spans = [], [], []
            for i, (n, gaps) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist())):
                g = np.frombuffer(gaps, np.int32).reshape(-1, 2).astype(np.int64)
                begin, end = np.concatenate(([0], g.sum(1))), np.concatenate((g[:, 0], [n]))
                long = end - begin >= min_len
                first.append(begin[long])
                spans.append((end - begin)[long] - min_len + 1)
                own += [i] * int(long.sum())
            if own:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(np.concatenate(first)), pa.array(np.concatenate(spans).astype(np.int32))], ["tid", "first", "spans"])

    return members, some.unionByName(copied.mapInArrow(free_runs, "tid bigint, first bigint, spans int"))


def shared_runs(df: DataFrame, key: str, text: str, min_len: int = 80, token: int = TOKEN) -> DataFrame:
    """``key, first, spans``: runs of start positions (from 0) of all spans of ``min_len`` letters a, c, g, t that another key has too.

    Letters are read in either case, u as t; blanks, line ends and digits don't count,
    any other letter ends a span.  Several rows of a key are several texts of it; null
    keys, null and short texts share nothing; an empty table gives nothing; other
    columns don't matter.

    Texts travel at two bits a letter and equal ones are put together first, so copies
    cost no more than one text and their list of keys.  Every text gives about
    ``2 / (min_len - token + 2)`` compact windows a letter.  Tokens of one text only are
    dropped by an aggregate; the windows of the others get their letters, windows of
    equal letters are counted, and only windows of a token with unequal letters are
    opened into their spans, packed without loss.  No step forms pairs or sends a
    table to all tasks, whatever the size.
    """
    members, runs = _shared(packed_texts(df, key, text, min_len), min_len, token)
    return members.join(runs, "tid").select(F.col("key").alias(key), "first", "spans")


def covered(runs: DataFrame, key: str, min_len: int) -> DataFrame:
    """How many positions the spans ``[p, p + min_len)`` of each key cover, ``p`` from ``first`` on ``spans`` times: ``key, shared_bp``.

    Runs may overlap or repeat.  A key has at most as many runs as its text has letters.
    """
    rows = runs.select(F.col(f"`{key}`").alias("key"), "first", (F.col("first") + F.col("spans") + (min_len - 1)).alias("end"))
    upto = F.max("end").over(Window.partitionBy("key").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("first"), F.coalesce(upto, F.col("first"))), F.lit(0))
    return rows.withColumn("new", new).groupBy("key").agg(F.sum("new").cast("int").alias("shared_bp")).withColumnRenamed("key", key)


def shared_bases(genbank: DataFrame, min_len: int = 80) -> DataFrame:
    """For every record with a shared stretch, how many of its bases lie in such stretches: ``rec_id, shared_bp``.

    Input: ``rec_id, seq, loaded_at``; the current row of a record counts, of several at
    the latest time that with the most letters (then the greatest as packed).  Null, empty and short sequences
    share nothing; a stretch that only repeats within its own record isn't shared;
    letters other than a, c, g, t (u) end a stretch.
    """
    packed = packed_texts(genbank, "rec_id", "seq", min_len, "loaded_at")
    members, runs = _shared(latest_rows(packed, ["key"], "version", ["n", "letters", "gaps"]), min_len, TOKEN)
    return members.join(covered(runs, "tid", min_len), "tid").select(F.col("key").alias("rec_id"), "shared_bp")
