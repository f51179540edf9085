"""Best-fit packing of token sequences under several capacities.

A text is tokenized whole; ids of more than `capacity` tokens are cut into pieces of `capacity`, the first taking the
remainder. Pieces are dealt into groups by a hash of their content (the number of groups follows the sum of tokens, so a
group stays small and files do not matter) and each group is packed by vector best-fit: pieces by falling length, each
into the open bin that can take it under all capacities - tokens, documents, attention cost (the sum of squared
lengths) - and scores best, either by the weighted dot product of demand and residual or by the weighted norm of what
would remain. A full piece is a bin of its own. Each group gives its emptiest bins up: their pieces are packed again,
FANIN groups together, and so on until one group is left. So what stays unfilled does not grow with the groups.

Edge cases: null and empty texts are the end token alone; texts of any length are encoded whole and cut; pieces that tie
in length are placed by doc_id, piece and checksum, bins that tie in score by age; repeated rows are packed as rows of
their own; null doc_ids are kept; an empty table gives an empty result; other columns are ignored by `pack` and kept by
none.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txweave.llm.common import cut, slices

CAPACITY = 2048
END = 0
#: Of a sequence: tokens, documents, attention cost. One token a document is the least, so the last two bind only
#: where they are set lower.
CAPACITIES = (CAPACITY, CAPACITY, CAPACITY * CAPACITY)
WEIGHTS = (1.0, 0.05, 0.05)
GROUP_TOKENS = 1 << 20
#: Groups that are packed together in the next round, and bins that each gives up to it.
FANIN = 16
GIVEN = 64
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary() -> str:
    """The public byte-level vocabulary of 50 thousand tokens, as ranks. It encodes as byte_bpe_50k.json does, faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece of every row."""
    path = path or vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in slices(batches, most=1 << 20):
            at, out, ids = [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                all_ids = np.array(encode(text or "", allowed_special="all") + [END], "<u4")
                n = len(all_ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    data = all_ids[i:j].tobytes()
                    at.append(row)
                    out.append((k, i, j - i, zlib.crc32(data)))
                    if with_ids:
                        ids.append(all_ids[i:j].astype(np.int64))
            cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            arrays = [b.column(0).take(pa.array(at)), *cols] + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    more = ", ids array<bigint>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}")


def best_fit(lengths: np.ndarray, capacities: tuple[float, ...] = CAPACITIES, weights: tuple[float, ...] = WEIGHTS, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """For lengths in falling order: each one's bin and its token offset there."""
    n = len(lengths)
    cap, weight = np.array(capacities, float), np.array(weights, float)
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1)
    share = demand / cap
    left = np.empty((n, 3))  # of open bins, as shares; closed bins leave the front of `open_`
    names = np.empty(n, np.int64)
    used = bins = 0
    which, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    filled: list[int] = []
    least = share[-1] if n else None
    for i in range(n):
        room = left[:used]
        fits = np.flatnonzero((room + 1e-12 >= share[i]).all(axis=1))
        if len(fits):
            rest = room[fits]
            value = -(rest @ (weight * share[i])) if score == "dot" else ((rest - share[i]) ** 2) @ weight
            k = int(fits[np.argmin(value)])
        else:
            k, used, bins = used, used + 1, bins + 1
            left[k], names[k] = 1.0, bins - 1
            filled.append(0)
        which[i], offset[i] = names[k], filled[names[k]]
        filled[names[k]] += int(lengths[i])
        left[k] -= share[i]
        if (left[k] + 1e-12 < least).any():  # nothing fits any more
            used -= 1
            left[k], names[k] = left[used], names[used]
    return which, offset


def _given(lengths: np.ndarray, which: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """For each piece: is its bin one of the `most` emptiest, and not full?"""
    filled = np.bincount(which, lengths)
    up = np.zeros(len(filled), bool)
    up[np.argsort(filled, kind="stable")[:most]] = True
    return (up & (filled < capacity))[which]


def pack(rows: DataFrame, capacities: tuple[float, ...] = CAPACITIES, weights: tuple[float, ...] = WEIGHTS, score: str = "norm", groups: int | None = None) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset; sequence ids are unique over all groups and rounds."""
    if groups is None:
        rows = cut(rows)
        groups = max(1, -(-int(rows.agg(F.sum("length")).first()[0] or 0) // GROUP_TOKENS))
    columns = rows.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def packed(open_rows: DataFrame, step: int, last: bool) -> DataFrame:
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            lengths = group.column("length").to_numpy()
            which, offset = best_fit(lengths, capacities, weights, score)
            ids = (group.column("grp").to_numpy().astype(np.int64) << 28) + which + (np.int64(step) << 58)
            up = np.zeros(len(which), bool) if last else _given(lengths, which, int(capacities[0]), GIVEN)
            return group.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("up", pa.array(up))

        return open_rows.groupBy("grp").applyInArrow(run, f"{kinds}, grp int, sequence_id long, offset long, up boolean")

    keyed = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32"), F.lit(groups)).cast("int"))
    done, step = [], 0
    while True:
        out = packed(keyed, step, groups == 1)
        if groups == 1:
            done.append(out)
            break
        out = cut(out)
        done.append(out.where("not up"))
        groups, step = -(-groups // FANIN), step + 1
        keyed = out.where("up").select(*columns, F.floor(F.col("grp") / FANIN).cast("int").alias("grp"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select(*columns, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, path: str | None = None, with_ids: bool = False, groups: int | None = None, capacities: tuple[float, ...] = CAPACITIES) -> DataFrame:
    return pack(pieces(docs, path, int(capacities[0]), with_ids), capacities, groups=groups)


__all__ = ["best_fit", "best_fit_packing", "encoder", "pack", "pieces"]
