"""Vector similarity: exact k nearest, and visual words over sets of local descriptors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(1.0)


def with_score(df: DataFrame) -> DataFrame:
    return df.withColumn("_similarity_score", 1 / (1 + F.col("_similarity_distance")))


def nearest(df: DataFrame, key: str, vector: str, query: list[float], k: int = 5) -> DataFrame:
    """The k rows nearest to query by cosine, with _similarity_distance and _similarity_score; ties by key."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    out = df.withColumn("_similarity_distance", cosine_distance(doubles(F.col(vector)), asked))
    return with_score(out.orderBy("_similarity_distance", key).limit(k))


def train_vocabulary(descriptors: DataFrame, vector: str, k: int = 500, seed: int = 42) -> np.ndarray:
    """At most k centroids by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = descriptors.select(array_to_vector(doubles(F.col(vector))).alias("features"))
    n = descriptors.select(vector).distinct().limit(k).count()
    if n < 2:
        return np.array([r["features"].toArray() for r in data.limit(n).collect()])
    # the row solver, as the other fails where fewer centres than k can be found
    return np.array(KMeans(k=min(k, n), seed=seed, solver="row").fit(data).clusterCenters())


def assign(centroids: np.ndarray, vector: Column) -> Column:
    """The number of the nearest centroid, least on ties; batches are one matrix product."""
    c = np.asarray(centroids, float)
    own = (c * c).sum(axis=1)

    @F.pandas_udf(IntegerType())
    def nearest_of(batch: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float) for v in batch]) if len(batch) else np.zeros((0, c.shape[1]))
        return pd.Series((own - 2 * x @ c.T).argmin(axis=1).astype(np.int32))

    return nearest_of(vector)


def histogram(descriptors: DataFrame, doc: str, cluster: str = "cluster") -> DataFrame:
    return descriptors.groupBy(doc, cluster).agg(F.count(F.lit(1)).alias("tf"))


def tf_idf(hist: DataFrame, doc: str, cluster: str = "cluster") -> DataFrame:
    """doc, cluster, tf, df, tf_idf = tf * ln(N / df), N being all documents with a descriptor."""
    n = hist.select(doc).distinct().count()
    df = hist.groupBy(cluster).agg(F.count(F.lit(1)).alias("df"))
    return hist.join(df, cluster).select(doc, cluster, "tf", "df", (F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("tf_idf"))


def _angle(weighed: DataFrame, doc: str, query: dict[int, float], k: int, cluster: str) -> DataFrame:
    length = sum(v * v for v in query.values()) ** 0.5
    pairs = F.array(*[F.lit(float(query.get(c, 0.0))) for c in range(max(query, default=0) + 1)])
    q = F.coalesce(F.try_element_at(pairs, F.col(cluster) + 1), F.lit(0.0))
    sums = weighed.groupBy(doc).agg(F.sum(F.col("tf_idf") * q).alias("dot"), F.sqrt(F.sum(F.col("tf_idf") * F.col("tf_idf"))).alias("norm"), F.max(q).alias("most"))
    far = F.when((F.col("norm") > 0) & F.lit(length > 0), 1 - F.col("dot") / (F.col("norm") * F.lit(length or 1.0))).otherwise(1.0)
    return sums.select(doc, far.alias("_similarity_distance"), "most")


def nearest_words(weighed: DataFrame, doc: str, query: dict[int, float], k: int = 5, cluster: str = "cluster") -> DataFrame:
    """doc, _similarity_distance, _similarity_score of the k documents nearest to the query's tf-idf by cosine."""
    return with_score(_angle(weighed, doc, query, k, cluster).drop("most").orderBy("_similarity_distance", doc).limit(k))


def nearest_words_pruned(weighed: DataFrame, doc: str, query: dict[int, float], k: int = 5, clusters: int = 10, cluster: str = "cluster") -> DataFrame:
    """nearest_words() among documents that share one of the query's heaviest clusters, more of them where these have fewer than k.

    One pass: each document's sums carry the query's heaviest weight that it shares, and
    documents below the weight that ``clusters`` reach come only after the others.
    """
    heavy = sorted((v for v in query.values() if v > 0), reverse=True)
    floor = heavy[min(clusters, len(heavy)) - 1] if heavy else 0.0
    found = _angle(weighed, doc, query, k, cluster).withColumn("_late", F.col("most") < F.lit(floor))
    return with_score(found.orderBy("_late", "_similarity_distance", doc).limit(k).drop("most", "_late"))


def remove(df: DataFrame, key: str, values: list) -> DataFrame:
    return df.filter(~F.col(key).isin(*values))


def get(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def ordered_clusters(weighed: DataFrame, doc: str, value, cluster: str = "cluster") -> DataFrame:
    """The clusters of one document from the heaviest; ties by number."""
    return weighed.filter(F.col(doc) == value).select(cluster, "tf_idf").orderBy(F.desc("tf_idf"), cluster)


def distance(df: DataFrame, key: str, vector: str, a, b) -> DataFrame:
    """_similarity_distance between the vectors of two keys; no row if either isn't there."""
    one, two = (df.filter(F.col(key) == k).select(doubles(F.col(vector)).alias(n)) for k, n in ((a, "_a"), (b, "_b")))
    both = one.withColumn("_one", F.lit(1)).join(two.withColumn("_one", F.lit(1)), "_one")
    return both.select(cosine_distance(F.col("_a"), F.col("_b")).alias("_similarity_distance"))


def mean_similarity(hits: DataFrame) -> DataFrame:
    return hits.agg(F.avg("_similarity_score").alias("mean_similarity"))


def confidence(hits: DataFrame) -> DataFrame:
    """hits with percent = score * 100 to one place, and its band: high from 70, medium from 50, else low."""
    percent = F.round(F.col("_similarity_score") * 100, 1)
    band = F.when(percent >= 70, "high").when(percent >= 50, "medium").otherwise("low")
    return hits.withColumns({"percent": percent, "confidence": band})
