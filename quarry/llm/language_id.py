"""Language identification by the nearest of several TF-IDF centroids per language.

A text becomes a vector of its letter 1- to 3-grams, hashed into ``dims`` features,
weighed (1 + ln tf) * idf and normalised.  idf counts every training document.
Spherical k-means clusters a bounded sample of each language (about
``sample_per_lang`` documents, picked by a hash of doc_id) into ``clusters``
centroids.  A document takes the language of the centroid with the greatest
cosine, and is rejected where its distance 1 - cosine exceeds what the language's
own training sample shows (``slack`` times the sample's far quantile).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from quarry.llm.common import table

_TABLE: list[np.ndarray] = []
#: Characters handled at once; parts overlap so that no n-gram is lost.
_PART = 1 << 18


def _letters() -> np.ndarray:
    """Which code points are letters, made once in each worker."""
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def ngram_counts(text: str | None, dims: int) -> np.ndarray | None:
    """Counts of hashed n-grams of the whole text; None if it has no letter."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[cp]
    if not is_letter.any():
        return None
    x = np.where(is_letter, cp, 32).astype(np.uint64)
    x = np.concatenate(([np.uint64(32)], x, [np.uint64(32)]))
    x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    out, shift = np.zeros(dims, np.int64), np.uint64(64 - (dims - 1).bit_length())
    with np.errstate(over="ignore"):
        for at in range(0, len(x), _PART):
            for n in (1, 2, 3):
                end = min(len(x), at + _PART + n - 1)
                code = x[at : end - n + 1].copy()
                for k in range(1, n):
                    code = (code << np.uint64(21)) | x[at + k : end - n + 1 + k]
                if n == 1:
                    code = code[code != 32]
                code = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(31)
                out += np.bincount((code * np.uint64(0xD6E8FEB86659FD93)) >> shift, minlength=dims)[:dims]
    return out


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def cluster(x: np.ndarray, k: int, steps: int = 12, least: float = 0.02) -> np.ndarray:
    """At most k unit centroids of the unit rows of x, each with a share of at least ``least``, so that no outlier has one."""
    k = min(k, len(x))
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(seeds) < k:
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    c = x[seeds]
    for step in range(2 * steps):
        mine = (x @ c.T).argmax(axis=1)
        counts = np.bincount(mine, minlength=len(c))
        if step >= steps // 2:  # the largest always has its share
            kept = counts >= min(counts.max(), max(2, least * len(x)))
            if not kept.all():
                c = c[kept]
                continue
        sums = np.stack([x[mine == i].sum(axis=0) if counts[i] else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _each(batches: Iterator[pa.RecordBatch], column: int, dims: int):
    for b in batches:
        for i in range(b.num_rows):
            yield b, i, ngram_counts(b.column(column)[i].as_py(), dims)


def document_frequencies(docs: DataFrame, dims: int, text_col: str) -> tuple[int, np.ndarray]:
    """Documents with letters, and how many of them have each feature."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        for _, _, c in _each(batches, 0, dims):
            if c is not None:
                df += c > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.concatenate(([n], df)))], ["feature", "df"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "feature long, df long").groupBy("feature").agg(F.sum("df")).collect()  # dims + 1 rows
    out = np.zeros(dims + 1, np.int64)
    for f, n in rows:
        out[f + 1] = n
    return int(out[0]), out[1:]


def fit(train: DataFrame, dims: int = 4096, clusters: int = 4, sample_per_lang: int = 400, far: float = 0.01, max_languages: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: idf, languages, centroids (a row each, with its language's number) and each language's far cosine."""
    train = train.filter(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    n, df = document_frequencies(train, dims, "text")
    idf = np.log((1 + n) / (1 + df)) + 1
    order = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40))
    spark = train.sparkSession
    share = F.broadcast(spark.createDataFrame([(k, min(1.0, sample_per_lang / v)) for k, v in sizes.items()], "lang string, share double"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, c in _each(batches, 1, dims):
            if c is not None:
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1], b.column(2)[i : i + 1], pa.array([_vector(c, idf).tobytes()], pa.binary())], ["lang", "at", "v"])

    def clustered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "v"])
        x = np.stack([np.frombuffer(v, np.float32) for v in pdf["v"]])
        c = cluster(x, clusters)
        low = float(np.quantile((x @ c.T).max(axis=1), far))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "low": [low] * len(c), "v": [row.tobytes() for row in c]})

    picked = train.join(share, "lang").filter(order < F.col("share") * (1 << 40)).select("lang", "text", order.alias("at"))
    vecs = picked.mapInArrow(vectors, "lang string, at long, v binary")
    rows = sorted(vecs.groupBy("lang").applyInPandas(clustered, "lang string, low double, v binary").collect()) if sizes else []  # clusters rows a language
    langs = sorted({r["lang"] for r in rows})
    return {
        "dims": dims, "idf": idf, "langs": langs, "of": np.array([langs.index(r["lang"]) for r in rows], np.int64),
        "centroids": np.stack([np.frombuffer(r["v"], np.float32) for r in rows]) if rows else np.zeros((0, dims), np.float32),
        "low": np.array([r["low"] for r in rows]),
    }


def annotate(docs: DataFrame, model: dict, slack: float = 1.25, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs, all columns and no shuffle, with lang_pred, score (cosine, 0 to 1) and rejected, named behind prefix."""
    dims, idf, langs, of, centroids = (model[k] for k in ("dims", "idf", "langs", "of", "centroids"))
    limit = 1 - slack * (1 - model["low"])
    names, at = docs.columns, docs.columns.index(text_col)
    added = [f"{prefix}{x}" for x in ("lang_pred", "score", "rejected")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, c in _each([b], at, dims):
                if c is None or not langs:
                    out.append(("und", 0.0, True))
                    continue
                cos = centroids @ _vector(c, idf)
                best = int(cos.argmax())
                out.append((langs[of[best]], float(min(1.0, max(0.0, cos[best]))), bool(cos[best] < limit[best])))
            lang, score, gone = zip(*out, strict=True) if out else ((), (), ())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*names, *added])

    kinds = [StructField(n, t) for n, t in zip(added, (StringType(), DoubleType(), BooleanType()), strict=True)]
    return docs.mapInArrow(made, StructType([*docs.schema.fields, *kinds]))


def predict(docs: DataFrame, model: dict, slack: float = 1.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), rejected of every row.

    A null text, one without a letter, and any text where nothing was learned are
    ``und``, with score 0 and rejected.  Ties go to the first language by name.
    Repeated rows get equal results; an empty table gives an empty result; other
    columns are not read.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return annotate(given, model, slack).drop("text")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns; a null language becomes the predicted one.

    Null texts and those without a letter are rejected; where no row has a language all
    are; repeated rows stay or go alike; an empty table stays empty.
    """
    out = annotate(docs, fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **how), text_col=text_col, prefix="_lid_")
    return out.filter("NOT _lid_rejected").withColumn(lang_col, F.coalesce(lang_col, "_lid_lang_pred")).select(*docs.columns)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """predict() on all of docs, learning from its rows with a language that aren't held out; null ids aren't."""
    model = fit(docs.filter(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col, **how)
    return predict(docs, model, id_col=id_col, text_col=text_col)


def op10_nearest_centroid_lang(spark, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
