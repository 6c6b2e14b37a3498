"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit for each position that more than half of a text's shingle
hashes set.  To find all pairs within ``radius`` bits, fingerprints are cut into
segments; the pigeonhole gives each segment a small radius such that every pair
is that near in some segment.  Each fingerprint enumerates the Hamming ball of
that radius around its segment's value, fetches the table's fingerprints of those
values by an equi-join, and pairs whose complete distance is small enough are links.

Copies collapse to one fingerprint before anything is looked up.  A crowded bucket,
as large families of near copies make, is indexed again by its remaining bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_scratch, materialize, table
from quarry.llm.components import components

SEED = 42
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of words, lower case and joined by a space; of the whole text if it has fewer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - words + 1)
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(r, SEED) for r in runs), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[i : i + _CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and v, the fingerprint as a signed long; zero for texts without words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)]  # one text at a time: memory is that of the longest
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["doc_id", "v"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(made, "doc_id long, v long")


def segments(radius: int, count: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment; two fingerprints within radius are that near in one of them."""
    q, rest = divmod(radius, count)
    out, at = [], 0
    for s in range(count):
        width = bits // count + (s < bits % count)
        if (r := q if s <= rest else q - 1) >= 0:
            out.append((at, width, r))
        at += width
    return out


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _cut(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _halves(rows: DataFrame, width: int, radius: int, probe: bool) -> DataFrame:
    """rows (fp, path, rest: the width bits that path doesn't fix) by either half of rest: path goes on with its value, or with each of its ball."""
    half, out = width // 2, None
    for s, (low, _, r) in enumerate(segments(radius, 2, width)):
        value, rest = _cut(F.col("rest"), low, half), _cut(F.col("rest"), half - low, half)
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(half, r if probe else 0)])
        mine = rows.select("fp", "path", rest.alias("rest"), value.alias("own"), F.explode(masks).alias("mask"))
        mine = mine.select("fp", F.xxhash64("path", F.lit(s), F.col("own").bitwiseXOR(F.col("mask"))).alias("path"), "rest")
        out = mine if out is None else out.unionByName(mine)
    return out


def near_links(fps: DataFrame, radius: int = 3, heavy: int = 64) -> DataFrame:
    """All pairs a < b of distinct fingerprints (fps: fp long) that differ in at most radius bits; some come more than once.

    Two segments of 32 bits are indexed.  A bucket of more than ``heavy`` fingerprints is
    indexed again by the two halves of its remaining bits, and so on until these are
    eight, when a bucket has at most 256: rows grow with the fingerprints, never with
    the square of a bucket.  Without fingerprints there are no pairs.
    """
    own = probes = fps.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("rest"))
    links, width = None, 64
    while True:
        own, probes = _halves(own, width, radius, False), _halves(probes, width, radius, True)
        width //= 2
        big = None
        if width > 8:
            big = materialize(own.groupBy("path").count().filter(F.col("count") > heavy).select("path"), "heavy")
            if not big.limit(1).count():
                drop_scratch(big)
                big = None
        light = probes if big is None else probes.join(big, "path", "left_anti")
        held = own.select("path", F.col("fp").alias("other"))
        near = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
        mine = light.join(held, "path").filter(near).select(F.col("fp").alias("a"), F.col("other").alias("b"))
        links = mine if links is None else links.unionByName(mine)
        if big is None:
            return links
        own = materialize(own.join(big, "path", "left_semi"), "own")
        probes = materialize(probes.join(big, "path", "left_semi"), "probes")


def linked_classes(rows: DataFrame, radius: int) -> DataFrame:
    """(v, comp) for each fingerprint v of rows (v long): comp is one of those that links of at most radius bits reach."""
    classes = materialize(rows.select("v").distinct(), "classes")
    found = components(near_links(classes.select(F.col("v").alias("fp")), radius))
    return classes.join(found.withColumnRenamed("node", "v"), "v", "left").select("v", F.coalesce("label", "v").alias("comp"))


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id that links of at most radius bits reach,
    the row's own included.  Null and wordless texts have fingerprint zero and link
    as any other.  Null ids are the component's only if it has no other; repeated
    rows get equal results; an empty table gives an empty result; no other columns
    are read.
    """
    rows = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    comp = materialize(linked_classes(rows, radius), "components")
    least = rows.groupBy("v").agg(F.min("doc_id").alias("least")).join(comp, "v")
    smallest = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = comp.join(smallest, "comp").select("v", "component_id")
    text = F.lpad(F.lower(F.hex("v")), 16, "0")
    return rows.select("doc_id", "v").join(by_class, "v").select("doc_id", text.alias("fingerprint"), "component_id")


def op6_simhash_multi_index(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
