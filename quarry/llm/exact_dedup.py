"""Exact duplicates through a minimal perfect hash over the digests already seen.

The history's distinct digests are dealt by hash into shards of a bounded number
of keys.  Each shard becomes one row: a minimal perfect hash (levels of bit
vectors in which each key owns a bit, ranked by prefix counts) and its slots,
which hold the full 32-byte digest, the id of the row that stays (the winner) and
the number of rows.  A lookup takes a digest to its only possible slot and
compares all 32 bytes; equal bytes make the row a repeat of the winner.  Digests
that no slot holds group among themselves.

Rows are counted by digest before anything is looked up, so a text that fills a
third of the table costs one lookup; the verdicts then return to the rows by a
plain equi-join, which adaptive execution splits where a digest is hot.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, materialize, text_of

INDEX_SCHEMA = "shard int, sizes binary, bits binary, digests binary, winners binary, counts binary"
_GROUPS = "digest binary, keep_id long, group_size long"


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit that each digest asks for in a level of so many bits."""
    with np.errstate(over="ignore"):
        x = words[:, 0] ^ (words[:, 1] * np.uint64(2 * level + 1)) ^ (words[:, 2] >> np.uint64(level % 31))
        x = (x + words[:, 3] * np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def build_mph(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes, all levels' bits, and each digest's slot in 0..n-1; digests are distinct."""
    words, left = _words(digests), np.arange(len(digests))
    sizes, bits, owner = [], [], []
    while len(left):
        size = max(8, 2 * len(left))
        at = _place(words[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        who = np.full(size, -1)
        who[at] = left
        sizes.append(size)
        bits.append(alone)
        owner.append(who[alone])
        left = left[~alone[at]]
        if len(sizes) > 200:
            raise ValueError("digests are not distinct")
    slots = np.empty(len(digests), dtype=np.int64)
    slots[np.concatenate(owner) if owner else []] = np.arange(len(digests))
    return np.array(sizes, dtype="<i8"), np.concatenate(bits) if bits else np.zeros(0, bool), slots


def look_up(digests: list[bytes], sizes: np.ndarray, bits: np.ndarray, slots: bytes) -> np.ndarray:
    """The slot of each digest, or -1 where the slot's 32 bytes differ or no bit answers."""
    words = _words(digests)
    rank = np.concatenate(([0], np.cumsum(bits)))
    found, left, base = np.full(len(digests), -1), np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = _place(words[left], level, int(size)) + base
        hit = bits[at]
        found[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + int(size)
    held = np.frombuffer(slots, dtype="<u8").reshape(-1, 4)
    member = found >= 0
    member[member] = (held[found[member]] == words[member]).all(axis=1)
    return np.where(member, found, -1)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = pdf["digest"].tolist()
    sizes, bits, slot = build_mph(digests)
    order = np.argsort(slot)
    return pd.DataFrame([{
        "shard": int(pdf["shard"].iloc[0]),
        "sizes": sizes.tobytes(),
        "bits": np.packbits(bits).tobytes(),
        "digests": b"".join(digests[i] for i in order),
        "winners": pdf["keep_id"].to_numpy("<i8")[order].tobytes(),
        "counts": pdf["group_size"].to_numpy("<i8")[order].tobytes(),
    }])


def _probe(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """One row for each digest of the shard: the history's, with the repeats counted in, then the others."""
    digests = new["digest"].tolist()
    if index.empty:
        return new[["digest", "keep_id", "group_size"]]
    row = index.iloc[0]
    sizes = np.frombuffer(row["sizes"], "<i8")
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
    counts = np.frombuffer(row["counts"], "<i8").copy()
    at = look_up(digests, sizes, bits, row["digests"]) if digests else np.zeros(0, np.int64)
    member = at >= 0
    np.add.at(counts, at[member], new["group_size"].to_numpy(np.int64)[member])
    held = [row["digests"][i : i + 32] for i in range(0, len(row["digests"]), 32)]
    old = pd.DataFrame({"digest": held, "keep_id": np.frombuffer(row["winners"], "<i8"), "group_size": counts})
    rest = new.loc[~member, ["digest", "keep_id", "group_size"]]
    return pd.concat([old, rest], ignore_index=True) if len(rest) else old


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of the distinct digests (digest, keep_id, group_size; keep_id is not null)."""
    return _sharded(history, shards).groupBy("shard").applyInPandas(_build, INDEX_SCHEMA)


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    normal = F.regexp_replace(text_of(text_col), SPACES, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


def exact_dedup(docs: DataFrame, history_share: float = 0.5, shard_keys: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when identical after each run of spaces becomes one space;
    null is the empty text.  The ids up to the quantile history_share are the
    history, the later ones (and null ids) look its digests up, so a winner is
    always the smallest id.  Rows that repeat the winner's id are all kept.  Null
    ids lose to any other; a group of null ids alone has a null keep_id and is
    kept.  An empty table gives an empty result; other columns are not read.
    """
    rows = materialize(digests_of(docs, id_col, text_col), "digests")
    n, split = rows.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", history_share, 1000)).first()
    shards = max(1, math.ceil(n / shard_keys))
    old = F.coalesce(F.col("doc_id") <= F.lit(split if split is not None else 0), F.lit(False))
    index = materialize(build_index(_counted(rows.filter(old)), shards), "index")
    new = _sharded(_counted(rows.filter(~old)), shards)
    groups = new.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe, _GROUPS)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
