"""Token ids of documents in files of directly addressable codes.

A shard is a run of documents in ascending id order; its rows are segments of
whole documents.  A segment cuts each token id into chunks of eight bits.  Level 0
holds the low chunk of every id, level 1 the next chunk of the ids that go on, and
so on; a bitmap beside each level says which ids go on, and a rank directory
counts its ones before every block of 512 bits.  So token i is read in at most as
many steps as it has chunks, with no other token decoded: its place in the next
level is the number of continuation bits before it.

Texts are encoded where they lie; only the ids, two bytes each, are shuffled, by
the shard that bounds over doc_id assign.  Encoding remembers a bounded number of
short words.  The files aren't compressed and their segments are small, so that
token() fetches one segment's columns and touches a few of their bytes.
"""

from __future__ import annotations

import bisect
import functools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import scratch_path, table

END = 0
_BLOCK = 512
SEGMENTS = "shard int, seg int, first_doc long, last_doc long, docs binary, lengths binary, n_tokens long, chunks array<binary>, more array<binary>, ranks array<binary>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The vocabulary's pattern for ASCII and for Latin-1 text without _ODD, of which the two libraries of patterns think differently.
_ASCII = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
_LATIN = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_ODD = "\x1c\x1d\x1e\x1f\x85\xa0\xb2\xb3\xb9\xbc\xbd\xbe"


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian 16- or 32-bit integers, equal to the library's for the whole text.

    Texts are cut into the words of the vocabulary's pattern, which its merges never
    cross, and the library's model is asked for words that aren't remembered.  At most
    ``remember`` words of at most ``longest`` characters are.
    """

    def __init__(self, path: str, remember: int = 500_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.kind = id_kind(self.library.get_vocab_size())
        size = int(self.kind[2])
        self.blobs = [i.to_bytes(size, "little") for i in range(self.library.get_vocab_size())]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.ascii_words, self.latin_words = re.compile(_ASCII).findall, re.compile(_LATIN).findall
        self.characters = _byte_characters()
        self.half, self.longest = remember // 2, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            letters = word.encode().decode("latin-1").translate(self.characters)
            tokens, blobs = self.model.tokenize(letters), self.blobs
            ids = blobs[tokens[0].id] if len(tokens) == 1 else b"".join([blobs[t.id] for t in tokens])
        if len(word) <= self.longest:
            if len(self.known) >= self.half:
                self.known, self.older = {}, self.known
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if (ascii_only := text.isascii()) or _is_latin(text):
            split = self.words if any(c in text for c in _ODD) else self.ascii_words if ascii_only else self.latin_words
        else:
            split = self.words
        words = split(text)
        out = list(map(self.known.get, words))
        if None in out:
            at = -1
            try:
                while True:
                    at = out.index(None, at + 1)
                    w = words[at]
                    out[at] = self.known.get(w) or self._word(w)
            except ValueError:  # no other is missing
                pass
        return b"".join(out)


def id_kind(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


@functools.lru_cache(4)
def _kind_of(vocabulary: str) -> str:
    from tokenizers import Tokenizer

    return id_kind(Tokenizer.from_file(vocabulary).get_vocab_size())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def to_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of each level."""
    chunks, more, ranks = [], [], []
    left = ids.astype(np.uint32)
    while True:
        on = left > 255
        chunks.append((left & 255).astype(np.uint8).tobytes())
        more.append(np.packbits(on, bitorder="little").tobytes())
        blocks = np.add.reduceat(on, np.arange(0, len(on), _BLOCK), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        ranks.append(np.concatenate(([0], np.cumsum(blocks)[:-1])).astype("<u4").tobytes() if len(on) else b"")
        left = left[on] >> 8
        if not len(left):
            return chunks, more, ranks


def all_tokens(chunks: list[bytes], more: list[bytes]) -> np.ndarray:
    """The ids of a whole segment."""
    ids: np.ndarray | None = None
    for chunk, bits in zip(reversed(chunks), reversed(more), strict=True):
        here = np.frombuffer(chunk, np.uint8).astype(np.uint32)
        on = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(here), bitorder="little").astype(bool)
        if ids is not None:
            here[on] |= ids << np.uint32(8)
        ids = here
    return ids if ids is not None else np.zeros(0, np.uint32)


def token_at(chunks: list[bytes], more: list[bytes], ranks: list[bytes], i: int) -> int:
    """Token i of a segment, from one chunk and one block of bits of each level."""
    value, shift = 0, 0
    for chunk, bits, rank in zip(chunks, more, ranks, strict=True):
        value |= chunk[i] << shift
        if not bits[i >> 3] >> (i & 7) & 1:
            return value
        block = i // _BLOCK
        word = int.from_bytes(bits[block * _BLOCK // 8 : (i >> 3) + 1], "little") & ((1 << (i - block * _BLOCK)) - 1)
        i = int.from_bytes(rank[4 * block : 4 * block + 4], "little") + word.bit_count()
        shift += 8
    return value


def _segment(shard: int, seg: int, docs: list, blobs: list[bytes], kind: str) -> dict:
    ids = np.frombuffer(b"".join(blobs), kind)
    chunks, more, ranks = to_levels(ids)
    size = np.dtype(kind).itemsize
    known = np.array([d is not None for d in docs])
    where = np.array([0 if d is None else d for d in docs], "<i8")
    return {
        "shard": shard, "seg": seg, "first_doc": next((d for d in docs if d is not None), None), "last_doc": docs[-1], "docs": known.tobytes() + where.tobytes(), "lengths": np.array([len(b) // size for b in blobs], "<i8").tobytes(),
        "n_tokens": len(ids), "chunks": chunks, "more": more, "ranks": ranks,
    }


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, shard_docs: int = 8192, max_shards: int = 20_000, segment_tokens: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every row's text and an end id, in ascending doc_id order, null ids first.

    Part k of the files holds shard k; there are at most max_shards, as their bounds are in the plan.  Null texts are empty.  Rows with one doc_id
    follow each other, ordered by their ids' bytes, so repeated rows are written as
    often as they come.  A segment ends after the document that takes it past
    segment_tokens.  An empty table writes no segment.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = _kind_of(vocabulary)
    number = F.col(id_col).cast("long")
    rows = docs.count()
    shards = max(1, min(max_shards, math.ceil(rows / shard_docs)))
    steps = [i / shards for i in range(1, shards)]
    bounds = sorted(set(docs.select(F.percentile_approx(number, steps, 10 * shards)).first()[0] or [])) if steps else []

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([END], kind).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out = [enc.encode(t.as_py() or "") + end for t in part.column(1)]
                shard = [0 if d is None else bisect.bisect_left(bounds, d) for d in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shard, pa.int32()), pa.array(out, pa.binary())], ["doc_id", "shard", "ids"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seg, names, blobs, held = None, 0, [], [], 0
        schema = pa.schema([("shard", pa.int32()), ("seg", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("n_tokens", pa.int64()), *((n, pa.list_(pa.binary())) for n in ("chunks", "more", "ranks"))])
        for b in batches:
            for d, s, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if names and (s != shard or held >= segment_tokens):
                    yield pa.RecordBatch.from_pylist([_segment(shard, seg, names, blobs, kind)], schema)
                    seg, names, blobs, held = (seg + 1 if s == shard else 0), [], [], 0
                shard = s
                names.append(d)
                blobs.append(ids.as_py())
                held += len(blobs[-1]) // np.dtype(kind).itemsize
        if names:
            yield pa.RecordBatch.from_pylist([_segment(shard, seg, names, blobs, kind)], schema)

    given = docs.select(number.alias("doc_id"), F.col(text_col).alias("text"))
    dealt = given.mapInArrow(encoded, "doc_id long, shard int, ids binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    dealt.mapInArrow(coded, SEGMENTS).write.option("compression", "none").parquet(path)


def read_segments(spark, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def token(spark, path: str, doc_id: int, i: int) -> int:
    """Token i (from 0; the last is the end id) of a document in files that write_tokens() made; IndexError if there is none.

    Of documents that repeat the id, the first in the files counts.  The ids' bounds
    lead to the segments that may hold it, and one chunk, one bitmap block and one
    directory entry of each level give the token: none other is decoded.
    """
    some = read_segments(spark, path).filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("shard", "seg")
    for r in some.select("docs", "lengths", "chunks", "more", "ranks").toLocalIterator():
        n = np.frombuffer(r["lengths"], "<i8")
        known, docs = np.frombuffer(r["docs"][: len(n)], bool), np.frombuffer(r["docs"][len(n) :], "<i8")
        at = np.nonzero(known & (docs == doc_id))[0]
        if len(at):
            if not 0 <= i < n[at[0]]:
                break
            return token_at(r["chunks"], r["more"], r["ranks"], int(n[: at[0]].sum()) + i)
    raise IndexError(f"document {doc_id} has no token {i}")


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in files that write_tokens() made."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                n = np.frombuffer(r.lengths, "<i8")
                known, docs = np.frombuffer(r.docs[: len(n)], bool), np.frombuffer(r.docs[len(n) :], "<i8")
                ids, ends = all_tokens(list(r.chunks), list(r.more)).astype("<u4"), np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, n, strict=True)]
                yield pd.DataFrame({"shard": r.shard, "seg": r.seg, "doc_id": pd.array(docs, "Int64").copy(), "at": ends - n, "n_tokens": n, "ids_crc32": crc}).assign(
                    doc_id=lambda x, known=known: x["doc_id"].where(known))

    files = read_segments(spark, path)
    digests = files.mapInPandas(decoded, "shard int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # starts: a running sum within groups of 4096 shards, and the groups' totals; only those meet on the driver
    sizes = files.groupBy("shard", "seg").agg(F.sum("n_tokens").alias("n")).withColumn("grp", F.floor(F.col("shard") / 4096))
    totals = sorted(sizes.groupBy("grp").agg(F.sum("n")).collect())
    base, before = [], 0
    for g, n in totals:
        base.append((g, before))
        before += n
    order = Window.partitionBy("grp").orderBy("shard", "seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("run", F.coalesce(F.sum("n").over(order), F.lit(0))).join(spark.createDataFrame(base, "grp long, base long"), "grp")
    starts = starts.select("shard", "seg", (F.col("base") + F.col("run")).alias("base"))
    return digests.join(starts, ["shard", "seg"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op4_addressable_tokens(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
