"""Removing bytes that repeat an earlier document.

Every window of ``length`` bytes has an anchor: its run of ``k`` bytes of least
hash.  Equal windows have equal anchors, so windows can be dealt by anchor.  First
only the anchors' hashes are shuffled, to find those in two documents; only they
go on, with the bytes of their windows (a context), which are dealt in ``turns``, one
after the other, so that the disk holds a share of them dealt out.  Each task sorts the windows of
its contexts, the suffixes cut at ``length``, by a hash of their bytes, compares the
bytes of neighbours, and gives every window the least document that has it; equal
contexts count once there.  Should two neighbours differ in spite of one hash, the
task sorts whole suffixes by the difference-cover algorithm (suffix_array.py).
Windows of anchors in more than ``hot`` documents, as the edges of very common
passages have, are dealt by their own bytes instead.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import drop_scratch, materialize, release, table
from quarry.llm.suffix_array import prefix_classes, suffix_array

_PIECE = 1 << 18
#: Bytes of text that a task answers at once.
_TOGETHER = 1 << 18
_LAST = (1 << 63) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[n] = np.cumprod(up), np.cumprod(down)
    return _POWERS[n]


def anchors(data: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): the anchors of a text's windows, each with the starts of the windows that it anchors."""
    out = []
    up, down = _powers(_PIECE + length)
    for base in range(0, max(0, len(data) - length + 1), _PIECE):
        x = np.frombuffer(data[base : base + _PIECE + length - 1], np.uint8).astype(np.uint64)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x + np.uint64(1)) * up[: len(x)])))
            h = (sums[k:] - sums[:-k]) * down[: len(x) - k + 1]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        low = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equals
        have, need = 1, length - k + 1
        while have * 2 <= need:
            low, have = np.minimum(low[:-have], low[have:]), have * 2
        if have < need:
            low = np.minimum(low[: len(low) - (need - have)], low[need - have :])
        at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.nonzero(np.concatenate(([True], at[1:] != at[:-1])))[0]
        last = np.concatenate((first[1:], [len(at)])) - 1
        out.append((h[at[first]].view(np.int64), first + base, last + base))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches in parts of some rows whose texts (column 2) take about _TOGETHER bytes: a longer text is a part."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _TOGETHER, side="right")))
            yield b.slice(at, end - at)
            at = end


def window_classes(data: np.ndarray, where: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of length (8 at least) bytes of data that starts in where: equal for equal bytes only."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(data), np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(data)]
    offsets = [*range(0, length - 8, 8), length - 8]
    key = np.zeros(len(where), np.uint64)
    with np.errstate(over="ignore"):
        for o in offsets:
            key = (key ^ words[where + o]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    order = np.argsort(key)
    key, at = key[order], where[order]
    same = key[1:] == key[:-1]
    left, right = at[:-1][same], at[1:][same]
    if not all((words[left + o] == words[right + o]).all() for o in offsets):
        text = data.astype(np.int64) + 1
        return prefix_classes(text, suffix_array(text), length)[where]
    out = np.empty(len(where), np.int64)
    out[order] = np.concatenate([np.zeros(min(1, len(where)), np.int64), np.cumsum(~same)])
    return out


def covered(contexts: pa.Array, d: np.ndarray, row: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """d, row, start and end of what windows of a smaller d cover, of contexts that start in at of their rows."""
    coded = contexts.dictionary_encode()
    which, distinct = coded.indices.to_numpy(), coded.dictionary
    ends = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
    data = np.frombuffer(distinct.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    begin, size = ends[:-1] - ends[0], np.diff(ends)
    least = np.full(len(distinct), _LAST)
    np.minimum.at(least, which, d)
    n = size - length + 1
    first = np.cumsum(n) - n
    where = np.repeat(begin - first, n) + np.arange(n.sum())
    classes = window_classes(data, where, length)
    low = np.full(int(classes.max()) + 1, _LAST)
    np.minimum.at(low, classes, np.repeat(least, n))
    found = low[classes]
    lowest, highest = np.minimum.reduceat(found, first)[which], np.maximum.reduceat(found, first)[which]
    whole = highest < d
    out = [(d[whole], row[whole], at[whole], at[whole] + size[which[whole]])]
    for i in np.nonzero(~whole & (lowest < d))[0].tolist():
        j = which[i]
        edge = np.diff(np.concatenate(([0], (found[first[j] : first[j] + n[j]] < d[i]).astype(np.int8), [0])))
        a, z = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        out.append((np.full(len(a), d[i]), np.full(len(a), row[i]), at[i] + a, at[i] + z - 1 + length))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def repeated_ranges(docs: DataFrame, length: int, k: int, hot: int, task_contexts: int, turns: int) -> DataFrame:
    """d, row and ranges (sorted starts and ends, from 0) of bytes that windows of a smaller d cover; docs: d, row, text."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [np.unique(anchors(_bytes(t.as_py()), length, k)[0]) for t in part.column(2)]
            which = np.repeat(np.arange(len(found)), [len(h) for h in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), part.column(0).take(pa.array(which)), part.column(1).take(pa.array(which))], ["h", "d", "row"])

    of = Window.partitionBy("h")
    seen = docs.mapInArrow(hashes, "h long, d long, row long").select("h", "d", "row", F.min("d").over(of).alias("lo"), F.max("d").over(of).alias("hi"), F.count(F.lit(1)).over(of).alias("n"))
    several = seen.filter("lo < hi").groupBy("d", "row").agg(F.collect_set(F.when(F.col("n") <= hot, F.col("h"))).alias("cold"), F.collect_set(F.when(F.col("n") > hot, F.col("h"))).alias("crowd"))
    several = materialize(several.withColumnsRenamed({"d": "_d", "row": "_row"}), "anchors")
    colds, crowds = several.agg(F.coalesce(F.sum(F.size("cold")), F.lit(0)), F.coalesce(F.sum(F.size("crowd")), F.lit(0))).first()
    release(docs.sparkSession)
    mine = (F.col("d") == F.col("_d")) & (F.col("row") == F.col("_row"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            hs, hots, texts, firsts = [], [], [], []
            for t, colds_, crowd_ in zip(*(part.column(j) for j in (2, 3, 4)), strict=True):
                data = _bytes(t.as_py())
                h, first, last = anchors(data, length, k)
                cold, crowd = (np.isin(h, c.values.to_numpy()) for c in (colds_, crowd_))
                keep = cold | crowd
                texts += [data[a : z + length] for a, z in zip(first[keep].tolist(), last[keep].tolist(), strict=True)]
                hs.append(h[keep])
                hots.append(crowd[keep])
                firsts.append(first[keep])
            which = pa.array(np.repeat(np.arange(len(hs)), [len(h) for h in hs]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(hots)), pa.array(texts, pa.binary()), part.column(0).take(which), part.column(1).take(which), pa.array(np.concatenate(firsts))], ["h", "hot", "context", "d", "row", "at"])

    # each text is read once; in a file, where they stand by document, contexts take less room than dealt out
    shown = docs.join(several.hint("shuffle_hash"), mine).select("d", "row", "text", "cold", "crowd").mapInArrow(contexts, "h long, hot boolean, context binary, d long, row long, at long")
    shown = materialize(shown, "contexts")
    drop_scratch(several)
    release(docs.sparkSession)

    def ranges(t: pa.Table) -> pa.Table:
        d, row, at = (t[c].to_numpy() for c in ("d", "row", "at"))
        return pa.table(dict(zip(("d", "row", "start", "end"), covered(t["context"].combine_chunks(), d, row, at, length), strict=True)))

    task = F.pmod(F.xxhash64("h"), F.lit(max(1, math.ceil(colds / task_contexts)))).cast("int")
    cold, parts = shown.filter("NOT hot").select(task.alias("task"), "context", "d", "row", "at"), []
    for turn in range(turns):
        dealt = cold.filter(F.pmod("task", F.lit(turns)) == turn)
        parts.append(materialize(dealt.groupBy("task").applyInArrow(ranges, "d long, row long, start long, end long"), "spans"))
        release(docs.sparkSession)
    if crowds:
        places = shown.filter("hot").select("d", "row", "at", "context", F.posexplode(F.sequence(F.lit(1), F.length("context") - (length - 1))).alias("pos", "s"))
        windows = materialize(places.select("d", "row", (F.col("at") + F.col("pos")).alias("start"), F.substring("context", F.col("s"), F.lit(length)).alias("window")), "windows")
        release(docs.sparkSession)
        least = windows.groupBy("window").agg(F.min("d").alias("least"))
        parts.append(materialize(windows.join(least, "window").filter("least < d").select("d", "row", "start", (F.col("start") + length).alias("end")), "spans"))
        drop_scratch(windows)
    drop_scratch(shown)
    release(docs.sparkSession)
    spans = reduce(DataFrame.unionByName, parts)
    out = materialize(spans.groupBy("d", "row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges")), "ranges")
    drop_scratch(*parts)
    release(docs.sparkSession)
    return out


def remove_repeats(docs: DataFrame, length: int = 50, k: int = 26, hot: int = 20_000, task_contexts: int = 40_000, turns: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain) of every row.

    A byte goes if a string of ``length`` bytes over it also starts in a document of
    smaller id.  Null texts are empty; null ids come after all others and don't
    precede each other; rows with one id don't precede each other either.  An empty
    table gives an empty result; other columns are not read.
    """
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("d")
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(d, F.xxhash64(text).alias("row"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    gone = repeated_ranges(given.select("d", "row", "text"), length, k, hot, task_contexts, turns)
    gone = gone.select(F.col("d").alias("_d"), F.col("row").alias("_row"), "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                data = _bytes(b.column(1)[i].as_py())
                parts, end, spans = [], 0, 0
                runs = b.column(2)[i].as_py() or []
                for j, r in enumerate(runs):
                    if j == 0 or r["start"] > end:
                        parts.append(data[end : r["start"]])
                        spans += 1
                    end = max(end, r["end"])
                kept = b"".join([*parts, data[end:]])
                out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    mine = (F.col("d") == F.col("_d")) & (F.col("row") == F.col("_row"))
    both = given.join(gone.hint("shuffle_hash"), mine, "left").select("doc_id", "text", "ranges")
    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
