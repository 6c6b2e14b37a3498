"""Mixing sources to target weights by entropy balancing.

Each document i of source s gets a rate r_i, the number of copies that the mix
takes of it on average.  Of all rates in [0, cap] that give each source its
target of tokens, sum_i r_i * size_i = target_s, the mix takes those nearest to
one copy of every document in relative entropy.  Their form is exponential,
r_i = min(cap, exp(lambda_s * size_i / mean_s)); lambda maximises a concave dual
whose gradient is target minus taken tokens.  Newton steps, guarded by a bracket,
solve it: a step is one distributed sum over (source, size) cells, and only two
numbers of each source come back to the driver.  Rates are then rounded into
whole copies by error diffusion from long to short documents in bounded blocks
of a source, so a block misses its tokens by less than one short document.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, materialize, table

_OUT = "doc_id long, size long, source_size long, target double, taken long, copies int, rate double, source string, text_hash long"


def water_fill(sizes: list[int], weights: tuple[float, ...], share: float, cap: float) -> list[float]:
    """Targets in the order of sizes: share times all tokens by repeating weights, none above cap times its size."""
    left, open_ = share * sum(sizes), dict(enumerate(sizes))
    targets = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        part = {i: left * weights[i % len(weights)] / total for i in open_}
        full = [i for i, s in open_.items() if part[i] > cap * s]
        if not full:
            for i, x in part.items():
                targets[i] = x
            break
        for i in full:
            targets[i] = cap * open_.pop(i)
            left -= targets[i]
    return targets


def solve_dual(cells: DataFrame, targets: dict[int, tuple[float, int]], cap: float, tolerance: float = 1e-9, steps: int = 80) -> dict[int, float]:
    """lambda by source number; cells: sid, size, c (size over the source's mean), n; targets: sid -> (target, size)."""
    spark = cells.sparkSession
    found = {s: math.inf for s, (t, size) in targets.items() if t >= cap * size * (1 - 1e-12)}
    found |= {s: -math.inf for s, (t, size) in targets.items() if t <= 0 and s not in found}
    state = {s: [0.0, -math.inf, math.inf] for s in targets if s not in found}
    for _ in range(steps):
        if not state:
            break
        at = spark.createDataFrame([(s, x[0]) for s, x in state.items()], "sid int, lam double")
        tilt = F.exp(F.least(F.col("lam") * F.col("c"), F.lit(700.0)))
        mass = F.col("n") * F.col("size")
        sums = cells.join(at, "sid").groupBy("sid").agg(
            F.sum(mass * F.least(F.lit(cap), tilt)).alias("taken"),
            F.sum(F.when(tilt < cap, mass * F.col("c") * tilt).otherwise(0.0)).alias("slope"),
        )
        for s, taken, slope in sums.collect():  # a row for each source
            lam, low, high = state[s]
            target = targets[s][0]
            if abs(taken - target) <= tolerance * max(1.0, target):
                found[s] = lam
                del state[s]
                continue
            low, high = (lam, high) if taken < target else (low, lam)
            step = lam + (target - taken) / slope if slope > 0 else math.nan
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low + high) else (lam * 2 + 0.25 if taken < target else lam * 2 - 0.25)
            state[s] = [step, low, high]
    # the last bits follow the order in which tasks ended
    return {s: float(f"{x:.11g}") for s, x in (found | {s: x[0] for s, x in state.items()}).items()}


def round_copies(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for a block of one source: the running error of taken tokens stays as small as it can."""
    tie = [xxhash.xxh64_intdigest(f"{x} {h}", 7) for x, h in zip(pdf["doc_id"], pdf["text_hash"], strict=True)]
    order = np.lexsort((np.array(tie, dtype=np.uint64), -pdf["size"].to_numpy()))
    copies, carry = np.zeros(len(pdf), np.int32), 0.0
    for i, size, rate in zip(order, pdf["size"].to_numpy()[order].tolist(), pdf["rate"].to_numpy()[order].tolist(), strict=True):
        if size == 0:
            copies[i] = 1
            continue
        want = rate * size + carry
        low = math.floor(rate)
        k = min(math.ceil(rate), max(low, math.floor(want / size + 0.5)))
        copies[i], carry = k, want - k * size
    return pdf.assign(copies=copies, taken=pdf["size"].to_numpy() * copies)[[x.split()[0] for x in _OUT.split(", ")]]


def entropy_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_rows: int = 1024, max_sources: int = 200_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate, source, text_hash of every row; reruns agree.

    size counts words (null text: 0; such documents are kept once and take no
    words).  Sources weigh by code point, null last and a source of its own.  Rows
    that repeat an id are separate documents, told apart by their place among
    equal sizes only.  An empty table gives an empty result.  Only a mix of at most max_sources
    sources, each a line of the mix's plan on the driver, is accepted; more raise.
    """
    spark = docs.sparkSession
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"),
    ), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("docs")).limit(max_sources + 1).collect()
    if len(sources) > max_sources:
        raise ValueError(f"a mix has at most {max_sources} sources")
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = water_fill([r["tokens"] for r in sources], weights, share, cap)
    named = spark.createDataFrame(
        [(i, r["source"], r["tokens"], max(1.0, r["tokens"] / r["docs"]), aims[i], math.ceil(r["docs"] / block_rows)) for i, r in enumerate(sources)],
        "sid int, source string, source_size long, mean double, target double, blocks int",
    )
    named = F.broadcast(named)  # at most max_sources rows, as is tilts: some 20 MB
    known = rows.join(named.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cells = materialize(
        known.filter("size > 0").groupBy("sid", "size", "mean").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.col("size") / F.col("mean")), "cells")
    lam = solve_dual(cells, {i: (aims[i], r["tokens"]) for i, r in enumerate(sources) if r["tokens"]}, cap)
    tilts = spark.createDataFrame([(i, lam.get(i, 0.0)) for i in range(len(sources))], "sid int, lam double")
    rate = F.when(F.col("lam") == math.inf, cap).when(F.col("lam") == -math.inf, 0.0).otherwise(
        F.least(F.lit(cap), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0)))))
    block = F.pmod(F.xxhash64(F.lit("block"), "doc_id", "size", "text_hash"), F.col("blocks")).cast("int")
    dealt = known.join(F.broadcast(tilts), "sid").select("doc_id", "size", "source_size", "target", rate.alias("rate"), "source", "text_hash", "sid", block.alias("block"))
    return dealt.groupBy("sid", "block").applyInPandas(round_copies, _OUT)


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it.

    Rows of one id, text and source (null ids and texts included) share their copies as
    equally as whole ones can be; none is lost.  An empty table stays empty.
    """
    mix = entropy_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    d, t, s, every, rows, copies = (next(n for k in range(1 << 30) if (n := f"{name}{k or ''}") not in docs.columns) for name in ("_mix_id", "_mix_text", "_mix_source", "_mix_all", "_mix_rows", "_mix_copies"))
    mix = mix.groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias(every), F.count(F.lit(1)).alias(rows)).filter(F.col(every) > 0)
    mix = materialize(mix.select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), F.col("source").alias(s), every, rows), "mix")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col(text_col)) == F.col(t)) & F.col(source_col).cast("string").eqNullSafe(F.col(s))
    taken = docs.join(mix, same)
    once = taken.filter(F.col(rows) == 1).withColumn(copies, F.col(every))
    place = Window.partitionBy(d, t, s).orderBy(F.lit(0))  # only rows that are the same in all three
    again = taken.filter(F.col(rows) > 1).withColumn(copies, F.floor(F.col(every) / F.col(rows)) + (F.row_number().over(place) <= F.col(every) % F.col(rows)).cast("long"))
    out = once.unionByName(again).filter(F.col(copies) > 0)
    return out.withColumn(d, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_entropy_mix(spark, sf_dir: str) -> DataFrame:
    return entropy_mix(table(spark, sf_dir, "documents")).drop("text_hash")
