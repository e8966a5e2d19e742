"""Filling fixed-capacity containers with items (problem 6): sum-of-squares packing."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoframe.common import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, read once a worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, n_tokens``: the number of tokens of each whole text; a null text has none."""
    kind = dict(df.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["key", "n_tokens"])

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(count, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, placed one after another.

    With N(g) open bins of residual gap g, an item goes where the sum of N(g)²
    becomes smallest: into a bin of a gap it fits in, or into a new one; of equal
    choices into the tightest.  Sizes are between 1 and ``capacity``.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    never = np.iinfo(np.int64).max
    bins = np.empty(len(sizes), np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        # change of the sum: gap s closes its bin; gap g > s turns into g - s; a new bin opens gap capacity - s
        best, gap = 2 * int(count[capacity - s]) + 1 if s < capacity else 0, capacity
        if s < capacity:
            into = count[s + 1 : capacity]
            if len(into):
                change = np.where(into > 0, 2 * (count[1 : capacity - s] - into + 1), never)
                k = int(change.argmin())
                if change[k] <= best:
                    best, gap = int(change[k]), s + 1 + k
            if count[s] and 1 - 2 * int(count[s]) <= best:
                gap = s
        if gap == capacity:
            b = made
            made += 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i] = b
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins


def pack(df: DataFrame, key: str, size: str, capacity: int = 2048, per_task: int = 50_000, full: float = 0.98) -> DataFrame:
    """Containers for items: ``key, piece_no, first_unit, units, container_id``.

    Items are spread by hash over tasks of about ``per_task`` items, so a task's
    memory doesn't grow with the data, and packed there from large to small.  Items
    of containers filled below ``full`` are then packed once more together, in as
    few tasks, which leaves about as many poor containers as one task would.

    * an item above the capacity is cut into full containers and a rest, which is packed like an item (``piece_no`` from 1);
    * items of size 0 or null get a row with 0 units and a null container;
    * ties are broken by the key and the place in the table, so a result is the same on every run over the same files;
    * repeated and null keys are items of their own, spread over the tasks like others; an empty table gives none.
    """
    kind = dict(df.dtypes)[key]
    # numbered before the cut: repeated keys have numbers of their own, and a task that is run again finds the same ones
    items = cut_lineage(df.select(F.monotonically_increasing_id().alias("no"), F.col(f"`{key}`").alias("key"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("size")))
    total = items.count()
    pieces = items.select("no", "key", "size", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)))).alias("piece_no")).select(
        "no", "key", F.col("piece_no").cast("int").alias("piece_no"), ((F.col("piece_no") - 1) * capacity).alias("first_unit"),
        F.least(F.lit(capacity), F.col("size") - (F.col("piece_no") - 1) * capacity).cast("int").alias("units"),
    )
    cols = f"no bigint, key {kind}, piece_no int, first_unit bigint, units int, container_id string, fill double"

    def packer(tag: str):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            g = group.sort_values(["units", "key", "no", "piece_no"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
            bins = sum_of_squares(g["units"].to_numpy(), capacity)
            fill = np.bincount(bins, weights=g["units"].to_numpy())[bins] / capacity
            name = f"{tag}-{int(group['task'].iloc[0])}-"
            return g[["no", "key", "piece_no", "first_unit", "units"]].assign(container_id=[name + str(b) for b in bins.tolist()], fill=fill)

        return run

    def packed(rows: DataFrame, tasks: int, tag: str) -> DataFrame:
        return rows.select("no", "key", "piece_no", "first_unit", "units", F.pmod(F.xxhash64("no", "piece_no"), F.lit(tasks)).alias("task")).groupBy("task").applyInPandas(packer(tag), cols)

    tasks = max(1, -(-total // per_task))
    first = cut_lineage(packed(pieces.where("units > 0"), tasks, "a"))
    poor = first.where(F.col("fill") < full)
    again = packed(poor, max(1, -(-poor.count() // per_task)), "b")
    out = [first.where(F.col("fill") >= full), again, pieces.where("units = 0").select("*", F.lit(None).cast("string").alias("container_id"))]
    names = ["key", "piece_no", "first_unit", "units", "container_id"]
    return out[0].select(*names).unionByName(out[1].select(*names)).unionByName(out[2].select(*names)).withColumnRenamed("key", key)


def pack_documents(documents: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every page in a container of ``capacity`` tokens: ``doc_id, piece_no, first_unit, units, container_id``."""
    return pack(count_tokens(documents, "doc_id", "text", vocabulary), "doc_id", "n_tokens", capacity)


def packing_audit(packed: DataFrame, items: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """One row: ``items`` packed, containers above the capacity, units lost, items cut though they fit, and whether there are at most 2 percent more containers than units need."""
    size_of = items.groupBy(F.col(key).alias("key")).agg(F.sum(F.col(size).cast("bigint")).alias("size"), F.count("*").alias("rows"))
    by_item = packed.groupBy(F.col(key).alias("key")).agg(F.sum("units").alias("units"), F.count("*").alias("pieces"))
    whole = by_item.join(size_of, "key", "full").agg(
        F.count("units").alias("items"), F.coalesce(F.sum(F.abs(F.coalesce("size", F.lit(0)) - F.coalesce("units", F.lit(0)))), F.lit(0)).alias("lost"),
        F.count_if((F.col("rows") == 1) & (F.col("size") <= capacity) & (F.col("pieces") > 1)).alias("split"), F.coalesce(F.sum("size"), F.lit(0)).alias("_all"),
    )
    bins = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("units").alias("fill")).agg(F.count_if(F.col("fill") > capacity).alias("overfull"), F.count("*").alias("_bins"))
    tight = F.col("_bins") <= F.ceil(F.col("_all") / capacity * 1.02) + 1
    return whole.withColumn("_one", F.lit(1)).join(bins.withColumn("_one", F.lit(1)), "_one").select("items", "overfull", "lost", "split", tight.alias("tight"))  # two rows of one line each
