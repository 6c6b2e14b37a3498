"""Near-duplicates by whole shingle sets: SimHash links first, an exact prefix join for the rest.

Documents of equal shingle sets are one class.  SimHash by multi-index hashing
(simhash.py) proposes pairs of classes that are nearly the same.  A 64-bit
fingerprint can't reach a similarity of 0.8 (such pairs differ in about ten bits),
so an exact way follows: two sets that are ``similarity`` alike share an element of
their prefixes, the first ``n - ceil(similarity * n) + 1`` elements in any order
that all sets follow.  Only ids travel between rounds; the sets of a pair meet
once, when it is verified by its Jaccard similarity, and links that hold join
classes into components, of which one document stays.

The order puts shingles that crowd the prefixes last.  It is found by counting
prefixes only: shingles in more than ``crowd`` of them move to the end, the
documents concerned take other shingles instead, and so on until none is new.
What still is crowded belongs to documents made of common shingles throughout, as
large groups of near copies are.  There, before all pairs are looked at, rounds
compare the members with one of them, and pairs within a component need no more
looking at: the rounds follow how alike a group is, not how large.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_scratch, materialize, release
from quarry.llm.components import components
from quarry.llm.simhash import fingerprint, near_links, shingle_hashes

#: Rows that a task answers at once.
_ROWS = 256
#: Ids that are sent to every task.
_FEW = 200_000
_LONGS = pa.list_(pa.int64())


def prefix_size(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _prefix(shingles: np.ndarray, late: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set; those in late come last."""
    last = np.isin(shingles, late)
    return np.concatenate([shingles[~last], shingles[last]])[: prefix_size(len(shingles), similarity)]


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.view(np.int64) for a in arrays], _LONGS)


def _name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits for a set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes()), "<i8").tolist())


def _signatures(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, lo and hi (which name the set), n, fp and marks (the prefix by hash alone)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part, names, sizes, fps, marks = b.slice(at, _ROWS), [], [], [], []
                for t in part.column(1):  # one text at a time
                    h = shingle_hashes(t.as_py(), words)
                    fps.append(fingerprint(h))
                    h = np.unique(h)
                    names.append(_name(h))
                    sizes.append(len(h))
                    marks.append(h[: prefix_size(len(h), similarity)])
                both = np.array(names, np.int64).reshape(-1, 2)
                cols = [part.column(0), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), _longs(marks)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lo", "hi", "n", "fp", "marks"])

    return docs.mapInArrow(made, "doc_id long, lo long, hi long, n int, fp long, marks array<long>")


def _named_sets(part: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Place and set of the rows (text, lo, hi first) whose text has the set that lo and hi name: repeated ids may have other texts."""
    for i, (t, lo, hi) in enumerate(zip(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
        h = np.unique(shingle_hashes(t.as_py(), words))
        if (lo, hi) == _name(h):
            yield i, h


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """c and its whole set; docs: text, lo, hi, c."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                found = list(_named_sets(part, words))
                rows = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(3).take(rows), _longs([h for _, h in found])], ["c", "shingles"])

    return docs.mapInArrow(made, "c long, shingles array<long>")


def _reordered(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """c, lo, hi, n, marks and late of documents whose late shingles are known; docs: text, lo, hi, c, late."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                found = [(i, len(h), _prefix(h, part.column(4)[i].values.to_numpy().view(np.uint64), similarity)) for i, h in _named_sets(part, words)]
                rows = pa.array([i for i, _, _ in found], pa.int64())
                c, lo, hi, late = (part.column(k).take(rows) for k in (3, 1, 2, 4))
                yield pa.RecordBatch.from_arrays([c, lo, hi, pa.array([n for _, n, _ in found], pa.int32()), _longs([m for _, _, m in found]), late], ["c", "lo", "hi", "n", "marks", "late"])

    return docs.mapInArrow(made, "c long, lo long, hi long, n int, marks array<long>, late array<long>")


def _texts_of(texts: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """texts joined with rows by c, which are among ids; where these are few, other texts aren't shuffled."""
    if ids.limit(_FEW + 1).count() <= _FEW:
        texts = texts.join(F.broadcast(ids.select("c")), "c", "left_semi")
    return texts.join(rows, "c")


def _in_order(texts: DataFrame, first: DataFrame, words: int, similarity: float, crowd: int, counts: int = 3) -> DataFrame:
    """c, n and marks of first (c, lo, hi, n and marks: prefixes by hash), in the order that puts the shingles which crowd prefixes last.

    Prefixes are counted ``counts`` times, as new ones may be crowded again; more counts
    would only save work.  A document knows the late shingles that its prefix has held,
    which are all that matter, and the last round lets it know all.
    """
    spark, step, again, heavy = first.sparkSession, 0, None, None
    now = materialize(first.withColumn("late", F.expr("array()").cast("array<long>")), "prefixes")
    while True:
        if step < counts:
            crowded = now.select(F.explode("marks").alias("h")).groupBy("h").count().filter(F.col("count") > crowd).select("h")
            old, heavy = heavy, materialize(crowded if heavy is None else crowded.unionByName(heavy).distinct(), "crowded")
            drop_scratch(*([old] if old is not None else []))
        asked = now if step < counts else again  # the others were asked when heavy was last counted
        unknown = asked.select("c", "late", F.explode("marks").alias("h")).filter(~F.array_contains("late", F.col("h"))).select("c", "h")
        more = materialize(unknown.join(heavy, "h", "left_semi").groupBy("c").agg(F.collect_set("h").alias("more")), "late")
        release(spark)
        if not more.limit(1).count():
            drop_scratch(*([heavy, more] if again is None else [heavy, more, again]))
            return now.select("c", "n", "marks")
        known = asked.join(more, "c").select("c", "lo", "hi", F.concat("late", "more").alias("late"))
        if last := step > counts:  # documents made of late shingles learn all of theirs at once
            each = _sets(_texts_of(texts, known, more).select("text", "lo", "hi", "c"), words).select("c", F.explode("shingles").alias("h"))
            whole = materialize(each.join(heavy, "h", "left_semi").groupBy("c").agg(F.collect_set("h").alias("late")), "whole")
            known = known.drop("late").join(whole, "c")
        new = materialize(_reordered(_texts_of(texts, known, more).select("text", "lo", "hi", "c", "late"), words, similarity), "changed")
        old, now = now, materialize(now.join(more.select("c"), "c", "left_anti").unionByName(new), "prefixes")
        drop_scratch(*([old, more] if again is None else [old, more, again]))
        again, step = new, step + 1
        release(spark)
        if last:
            drop_scratch(heavy, whole, again)
            return now.select("c", "n", "marks")


def _alike(texts: DataFrame, names: DataFrame, pairs: DataFrame, words: int, similarity: float, turns: int = 1) -> DataFrame:
    """Those of pairs (a, b) whose whole sets are alike, as a table; two empty sets are.  Sets are on disk for one of the turns at a time."""
    pairs, out = materialize(pairs.select("a", "b").distinct(), "pairs"), []
    for turn in range(turns):
        mine = pairs.filter(F.pmod(F.xxhash64(F.lit("turn"), "a"), F.lit(turns)) == turn)
        asked = mine.select(F.col("a").alias("c")).unionByName(mine.select(F.col("b").alias("c"))).distinct()
        sets = materialize(_sets(_texts_of(texts, names.join(asked, "c", "left_semi"), asked).select("text", "lo", "hi", "c"), words), "sets")
        one, two = (sets.select(F.col("c").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        both = mine.join(one, "a").join(two, "b")
        shared, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
        out.append(materialize(both.filter((total == 0) | (shared >= similarity * (total - shared) - 1e-9)).select("a", "b"), "links"))
        drop_scratch(sets)
        release(pairs.sparkSession)
    drop_scratch(pairs)
    return reduce(DataFrame.unionByName, out)


def _sharing(ordered: DataFrame, pairs: DataFrame, turns: int = 4) -> DataFrame:
    """Those of pairs (a, b, marks) that share that many marks, as a table; marks are compared by 32 of their bits, which finds no fewer."""
    short, out = ordered.select("c", F.transform("marks", lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("s")), []
    one, two = (short.select(F.col("c").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    for turn in range(turns):
        mine = pairs.filter(F.pmod(F.xxhash64(F.lit("turn"), "a"), F.lit(turns)) == turn)
        both = mine.join(one, "a").join(two, "b").filter(F.size(F.array_intersect("sa", "sb")) + F.size("sa") - F.size(F.array_distinct("sa")) >= F.col("marks"))
        out.append(materialize(both.select("a", "b"), "sharing"))
        release(pairs.sparkSession)
    drop_scratch(pairs)
    return reduce(DataFrame.unionByName, out)


def _sizes_fit(m: Column, n: Column, similarity: float) -> Column:
    return F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9


def near_components(texts: DataFrame, first: DataFrame, words: int, similarity: float, crowd: int, patience: int) -> DataFrame:
    """(node, label) of the classes that links join; texts: c, text; first: c, lo, hi, n, fp, marks."""
    names = first.select("c", "lo", "hi")
    hubs = first.groupBy("fp").agg(F.min("c").alias("hub"))
    links = near_links(hubs.select("fp"), radius=3)
    simhash = links.join(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("ha")), "a").join(hubs.select(F.col("fp").alias("b"), F.col("hub").alias("hb")), "b")
    simhash = simhash.select(F.col("ha").alias("a"), F.col("hb").alias("b")).unionByName(first.join(hubs, "fp").filter("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b")))

    ordered = _in_order(texts, first.select("c", "lo", "hi", "n", "marks"), words, similarity, crowd)
    entries = ordered.select("c", "n", F.size("marks").alias("p"), F.posexplode("marks").alias("i", "h"))
    several = entries.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = materialize(entries.join(several, "h"), "met")  # h, c, n, p, i (place of h among the p marks), k
    release(first.sparkSession)
    # members of crowded shingles by their first few: large groups have these in common, and the rounds need no more
    some = met.filter(F.col("k") > crowd).groupBy("c", "n").agg(F.slice(F.sort_array(F.collect_set("h")), 1, 4).alias("hs"))
    some = materialize(some.select("c", "n", F.explode("hs").alias("h")), "some")

    known, before = _alike(texts, names, simhash, words, similarity), None
    for r in range(1 << 30):
        found = materialize(components(known), "components")
        now = materialize(_labelled(some, found), "labelled")
        sums = now.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.sum("m").alias("m"), F.max("m").alias("most"))
        work, rows = sums.agg(F.sum(F.col("m") * (F.col("m") - F.col("most"))), F.sum("m")).first()
        if not work or work <= patience * rows or (before is not None and work > 0.9 * before):
            drop_scratch(now, some)
            break
        before = work
        # the members of each crowded shingle against those that come first in four orders of this round
        turns = [F.min(F.struct(F.xxhash64(F.lit(4 * r + i), F.col("c")).alias("o"), "c", "comp", "n")) for i in range(4)]
        lead = now.groupBy("h").agg(F.array(*turns).alias("ls")).select("h", F.explode("ls").alias("l"))
        pairs = now.join(lead, "h").filter((F.col("comp") != F.col("l.comp")) & _sizes_fit(F.col("n"), F.col("l.n"), similarity))
        new = _alike(texts, names, pairs.select(F.least("c", "l.c").alias("a"), F.greatest("c", "l.c").alias("b")), words, similarity)
        old, known = known, materialize(known.unionByName(new).distinct(), "links")
        drop_scratch(old, found, new, now)
    # the rest: of each shingle, members outside its largest component against all that aren't in theirs
    now = materialize(_labelled(met, found), "labelled")
    drop_scratch(met, found)
    most = now.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.max(F.struct("m", "comp")).alias("x"), F.count(F.lit(1)).alias("comps"))
    outside = now.join(most.filter("comps > 1").select("h", F.col("x.comp").alias("major")), "h").filter("comp <> major")
    left = outside.select("h", F.col("c").alias("a"), F.col("n").alias("m"), F.col("p").alias("pa"), F.col("i").alias("ia"), F.col("comp").alias("ca"), "major")
    right = now.select("h", F.col("c").alias("b"), "n", F.col("p").alias("pb"), F.col("i").alias("ib"), F.col("comp").alias("cb"))
    once = (F.col("cb") == F.col("major")) | (F.col("a") < F.col("b"))
    # all but the rest of one set must be shared marks, so the first of these has as many behind it in both prefixes
    marks = F.greatest(F.lit(1), F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("m") + F.col("n")) - F.greatest(F.col("m") - F.col("pa"), F.col("n") - F.col("pb")) - 1e-6))
    early = (F.col("ia") <= F.col("pa") - marks) & (F.col("ib") <= F.col("pb") - marks)
    met_by = left.join(right, "h").filter((F.col("ca") != F.col("cb")) & once & _sizes_fit(F.col("m"), F.col("n"), similarity) & early)
    pairs = met_by.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(marks).alias("marks"))
    pairs = _sharing(ordered, materialize(pairs, "pairs"))
    last = _alike(texts, names, pairs, words, similarity, turns=4)
    out = materialize(components(known.unionByName(last)), "components")
    drop_scratch(known, now, ordered)
    return out


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """members (c) with comp, their component so far."""
    return members.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("label", "c")).drop("label")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, crowd: int = 32, patience: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and keep_id of each document that goes: keep_id is the smallest id of its group.

    Documents are linked when their sets of ``words``-word shingles are at least
    ``similarity`` alike (Jaccard; a text of fewer words is one shingle, and those
    without words are alike), and a group is all that links join.  No link is lost:
    see the module.  ``crowd`` and ``patience`` only set what work is saved.  Rows with
    a null id stay and nothing goes for them; rows that share an id stay or go
    together, by the one whose set has the smallest name; an empty table gives an
    empty result; no other columns are read.
    """
    given = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_signatures(given, words, similarity), "signatures")
    named = rows.groupBy("doc_id").agg(F.min(F.struct("lo", "hi")).alias("s"))
    named = materialize(named.select("doc_id", "s.lo", "s.hi"), "named")
    least = materialize(named.groupBy("lo", "hi").agg(F.min("doc_id").alias("c")), "classes")
    members = materialize(named.join(least, ["lo", "hi"]).select("doc_id", "c", "lo", "hi"), "members")
    drop_scratch(named, least)
    spoken = members.filter("doc_id = c").select("c", "lo", "hi")
    first = materialize(rows.withColumnRenamed("doc_id", "c").join(spoken, ["c", "lo", "hi"]), "classes")
    drop_scratch(rows)
    texts = given.withColumnRenamed("doc_id", "c")
    found = near_components(texts, first, words, similarity, crowd, patience)
    keep = members.join(found.withColumnRenamed("node", "c"), "c", "left").select("doc_id", F.coalesce("label", "c").alias("keep_id"))
    return keep.filter("doc_id <> keep_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, without the documents that near_duplicates() names; null ids stay, an empty table stays empty."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
