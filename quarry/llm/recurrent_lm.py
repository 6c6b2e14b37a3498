"""Scoring documents with a gated recurrent language model.

Documents are read once into blocks: each block has the words that it holds,
their training counts in it, and its documents as numbers into these words.  The
counts of all blocks meet by word in one shuffle and go back to their blocks, so
no table of the vocabulary is sent to every task.  The network (gru.py) is trained
by truncated backpropagation on all training documents: in each round tasks go on
from the same weights over their blocks, and the weights that they reach are
averaged by tokens.  Blocks are then scored:
documents run side by side, their state carried across windows to the end.

Tokens are words (A-Z in lower case) and one end.  The ``frequent`` commonest, or as
many as the root of the number of distinct words, have classes of their own by
frequency; the numbers of classes grow with the root of theirs.  Any other word belongs to the rare class of
its last two characters, within which it has the add-one share of its count; words
that training never saw share one such place in each rare class.  So the
probabilities of all continuations sum to one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, release, table
from quarry.llm.gru import Gru, document_scores

#: The end of a text, as a word.
END = ""
#: Texts that are split at once.
_ROWS = 1024
_BLOCKS = "block long, docs binary, sizes binary, tokens binary, words array<string>, counts array<long>"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def _tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts one after another, as tokens_of() gives them, and how many each has."""
    own = texts.take(pa.array(np.arange(len(texts))))  # ascii_lower misreads slices
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(own.cast(pa.large_string()), "")))
    words, parent = cut.flatten(), pc.list_parent_indices(cut).to_numpy()
    given = pc.binary_length(words).to_numpy() > 0
    lengths = np.bincount(parent[given], minlength=len(texts)) + 1
    ends = np.cumsum(lengths)
    take = np.full(ends[-1] if len(ends) else 0, len(words))
    inner = np.ones(len(take), bool)
    inner[ends - 1] = False
    take[inner] = np.nonzero(given)[0]
    return pa.concat_arrays([words, pa.array([END], words.type)]).take(pa.array(take)), lengths


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from; null ids aren't among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def rare_class(word: str, rare: int) -> int:
    return zlib.crc32(word[-2:].encode()) % rare


def _rare_column(word: str, rare: int) -> Column:
    return (F.crc32(F.right(F.col(word), F.lit(2)).cast("binary")) % rare).cast("int")


def blocks_of(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of about block_tokens tokens (a longer document is a block); docs: doc_id, text, held."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, held, sizes, tokens, total = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            coded = pa.chunked_array(tokens).combine_chunks().dictionary_encode()
            flat, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
            learn = np.repeat(~np.array(held), sizes)
            counts = np.bincount(flat[learn], minlength=len(words))
            known = np.array([d is not None for d in ids])
            docs_ = known.tobytes() + np.array(held).tobytes() + np.array([d or 0 for d in ids], "<i8").tobytes()
            planes = (flat & 0xFFFF).astype("<u2").tobytes() + (flat >> 16).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([
                pa.array([(task << 32) | number]), pa.array([docs_], pa.binary()), pa.array([np.array(sizes, "<i8").tobytes()], pa.binary()), pa.array([planes], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts, pa.int64())),
            ], ["block", "docs", "sizes", "tokens", "words", "counts"])

        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                own, lengths = _tokenised(part.column(1))
                ends, start = np.cumsum(lengths), 0
                for i, (d, h) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    ids.append(d)
                    held.append(h)
                    total += int(lengths[i])
                    if total >= block_tokens or i + 1 == part.num_rows:
                        sizes.extend(lengths[len(sizes) - len(ids) + i + 1 : i + 1].tolist())
                        tokens.append(own.slice(start, ends[i] - start))
                        start = int(ends[i])
                    if total >= block_tokens:
                        yield block()
                        number += 1
                        ids, held, sizes, tokens, total = [], [], [], [], 0
        if ids:
            yield block()

    return docs.mapInArrow(made, _BLOCKS)


class Lexicon:
    """The frequent words with their classes, and the rare classes' sums."""

    def __init__(self, frequent: list[tuple[str, int]], rare: int, classes: int):
        self.rare, self.words = rare, {w: i for i, (w, _) in enumerate(frequent)}
        share = np.cumsum(np.sqrt(np.array([c + 1.0 for _, c in frequent])))
        which = np.minimum((share / share[-1] * classes).astype(int), classes - 1)
        which = np.unique(which, return_inverse=True)[1]
        self.class_of = which
        self.bounds = [int(i) for i in np.searchsorted(which, np.arange(which[-1] + 2))]
        self.frequent_classes = int(which[-1]) + 1
        self.mass = np.ones(rare)

    def entries(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input, class and frequent word (-1: rare) of each word."""
        at = np.array([self.words.get(w, -1) for w in words], np.int64)
        rare = np.array([0 if i >= 0 else rare_class(w, self.rare) for w, i in zip(words, at, strict=True)], np.int64)
        return np.where(at >= 0, at, len(self.words) + rare), np.where(at >= 0, self.class_of[at], self.frequent_classes + rare), at


def _cut(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(sizes)[:-1])


def _grids(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which documents of a block are held out, their sizes, and its tokens as numbers into its words."""
    sizes = np.frombuffer(row["sizes"], "<i8")
    n, m = len(sizes), int(sizes.sum())
    flat = np.frombuffer(row["tokens"][: 2 * m], "<u2").astype(np.int64) | (np.frombuffer(row["tokens"][2 * m :], "<u2").astype(np.int64) << 16)
    return np.frombuffer(row["docs"][n : 2 * n], bool), sizes, flat


def train(blocks: DataFrame, lexicon: Lexicon, tokens: int, rounds: int = 4, few: int = 2_000_000, tasks: int = 64, together: int = 2_000_000) -> tuple[Gru, int]:
    """A network trained on every training document of blocks, and the tokens that its gradients followed.

    Each round takes its share of the blocks, so that all are read once; of ``few`` tokens
    or less one task reads all ``rounds`` times (score_documents asks for none of that, so
    that no size of its table changes the way).  Tasks train on blocks of about ``together``
    tokens at once, in lanes that grow with these, so few tokens make as many steps as many.  At most ``tasks`` sets of weights come to the driver.  Without blocks,
    or without training tokens in them, the network stays as it was drawn.
    """
    model, seen = Gru(len(lexicon.words) + lexicon.rare, lexicon.bounds, lexicon.rare), 0
    first, small = lexicon.words[END], tokens <= few
    for r in range(1 if small else rounds):
        passes, rate = (rounds, 6e-3) if small else (1, 6e-3 / (1 + r))

        def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held_back, waiting, done = [], 0, 0

            def follow() -> None:
                x, c, w, begin = (np.concatenate(v) for v in zip(*held_back, strict=True))
                given = np.where(begin, first, np.roll(x, 1)).astype(np.int32)
                model.train_flat(given, c, w, begin, lanes=int(np.clip(len(x) // 4800, 1, 512)), passes=passes, rate=rate)
                held_back.clear()

            for pdf in batches:
                for _, row in pdf.iterrows():
                    held, sizes, flat = _grids(row)
                    learn = np.repeat(~held, sizes)
                    begin = np.zeros(len(flat), bool)
                    begin[np.cumsum(sizes) - sizes] = True
                    if learn.any():
                        held_back.append((*(v.astype(np.int32)[flat[learn]] for v in lexicon.entries(list(row["words"]))), begin[learn]))
                        waiting, done = waiting + int(learn.sum()), done + passes * int(learn.sum())
                    if waiting >= together:
                        follow()
                        waiting = 0
            if held_back:
                follow()
            if done:
                yield pd.DataFrame({"n": [done], "p": [b"".join(v.astype("<f4").tobytes() for v in model.p.values())]})

        mine = blocks if small else blocks.filter(F.pmod(F.xxhash64("block"), F.lit(rounds)) == r)
        got = mine.select("docs", "sizes", "tokens", "words").coalesce(1 if small else tasks).mapInPandas(learned, "n long, p binary").collect()
        last = sum(g["n"] for g in got)
        seen += last
        if last:
            mean = sum(np.frombuffer(g["p"], "<f4").astype(float) * (g["n"] / last) for g in got).astype(np.float32)
            at = 0
            for name, v in model.p.items():
                model.p[name] = mean[at : at + v.size].reshape(v.shape).copy()
                at += v.size
    return model, seen


def score_documents(docs: DataFrame, frequent: int = 1000, classes: int = 20, rare: int = 24, block_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null text is empty: its only token is the end.  Rows with a null id are
    learned from.  Repeated rows count as often as they come and score alike.  With
    nothing to learn from, base_score is 0 for every text and score that of an
    untrained network.  An empty table gives an empty result; no other columns are
    read.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))
    blocks = materialize(blocks_of(given, block_tokens), "blocks")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts"))).select(
        "block", F.col("pos").alias("i"), F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    totals = materialize(pairs.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "totals")
    known = totals
    # words that training never saw count 0 and need no row
    counted = materialize(pairs.join(totals, "word").select("block", "i", "c"), "counts")
    release(docs.sparkSession)
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    if (most := math.isqrt(distinct)) > frequent:
        frequent, classes, rare = most, math.ceil(classes * math.sqrt(most / frequent)), math.ceil(rare * math.sqrt(most / frequent))
    top = known.select("word", "c").orderBy(F.col("word") != END, F.desc("c"), "word").limit(frequent).collect()
    top = sorted(((r["word"], r["c"]) for r in top), key=lambda x: (-x[1], x[0]))
    lexicon = Lexicon(top if any(w == END for w, _ in top) else [*top, (END, 0)], rare, classes)
    sums = known.groupBy(_rare_column("word", rare).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # rare rows
    mass = np.ones(rare)
    for k, n, v in sums:
        mass[k] += n + v
    for w, c in top:
        mass[rare_class(w, rare)] -= c + 1
    lexicon.mass = mass
    model, _ = train(blocks, lexicon, int(total), few=0)
    release(docs.sparkSession)

    def scored(block: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        held, sizes, flat = _grids(row)
        n = len(sizes)
        known_id = np.frombuffer(row["docs"][:n], bool)
        ids = pd.Series(np.frombuffer(row["docs"][2 * n :], "<i8")).astype("Int64").where(known_id)
        c = np.zeros(len(row["words"]), np.int64)
        c[counts["i"].to_numpy()] = counts["c"].to_numpy()
        x, k, w = lexicon.entries(list(row["words"]))
        inner = np.where(w >= 0, 0.0, np.log(c + 1.0) - np.log(lexicon.mass[np.maximum(k - lexicon.frequent_classes, 0)]))
        starts = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10(c + 1.0)[flat], starts) - sizes * np.log10(total + distinct + 1.0)
        x, k, w = x.astype(np.int32), k.astype(np.int32), w.astype(np.int32)
        network = document_scores(model, list(zip(_cut(x[flat], sizes), _cut(k[flat], sizes), _cut(w[flat], sizes), strict=True)), lexicon.words[END])
        return pd.DataFrame({
            "doc_id": ids, "held_out": held, "n_tokens": sizes, "n_known": np.add.reduceat((c > 0).astype(np.int64)[flat], starts),
            "base_score": base, "score": (network + np.add.reduceat(inner[flat], starts)) / np.log(10),
        })

    texts = blocks.select("block", "docs", "sizes", "tokens", "words").groupBy("block")
    out = texts.cogroup(counted.select("block", "i", "c").groupBy("block")).applyInPandas(scored, _OUT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op1_recurrent_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
