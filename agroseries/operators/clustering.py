"""Dimensionality reduction, K-Means and distance scores.

Fits use ``pyspark.ml`` on the site-vector table (one row per site).  The
only driver-side objects are model parameters bounded by k and the feature
count: explained-variance vector, k centroids, the k×k alignment table.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIANCE_TARGET = 0.85
MIN_COMPONENTS = 5
KMEANS_K = 4
KMEANS_RESTARTS = 20
KMEANS_MAX_ITER = 500
KMEANS_PARTITIONS = 16  # fewer rows than ``KMEANS_ROWS`` a partition are dealt over no more than these
KMEANS_ROWS = 10_000
SEED = 42
EPS = 1e-9


def n_components(explained, target: float = VARIANCE_TARGET, minimum: int = MIN_COMPONENTS) -> int:
    """A component counts while those before it explain less than ``target``; at
    least ``minimum`` do."""
    before, n = 0.0, 0
    for share in explained:
        if before >= target:
            break
        before, n = before + float(share), n + 1
    return max(n, minimum)


def pca_reduce(vectors: DataFrame, target: float = VARIANCE_TARGET, minimum: int = MIN_COMPONENTS,
               col: str = "features", out: str = "pca"):
    """M9: PCA keeping ≥ ``target`` variance (≥ ``minimum`` components).

    One fit with k = min(sites, features); the leading components of that fit
    are the fit with fewer components, so the projection is sliced.
    Returns (projected DataFrame, explained variance list, n_comp).
    """
    n_feat = len(vectors.select(col).first()[col])
    n_rows = vectors.count()
    k_max = max(1, min(n_feat, n_rows))
    model = PCA(k=k_max, inputCol=col, outputCol="_pc").fit(vectors)
    explained = list(model.explainedVariance.toArray())
    k = min(n_components(explained, target, minimum), k_max)
    proj = (model.transform(vectors)
                 .withColumn(out, array_to_vector(F.slice(vector_to_array("_pc"), 1, k))).drop("_pc"))
    return proj, explained, k


def variance_table(spark, explained) -> DataFrame:
    """(component, explained, cumulative) from the fitted model."""
    cum = np.cumsum(explained)
    rows = [(i + 1, float(e), float(c)) for i, (e, c) in enumerate(zip(explained, cum))]
    return spark.createDataFrame(rows, "component int, explained double, cumulative double")


def dealt_by_rows(data: DataFrame) -> DataFrame:
    """The cached ``data`` (one row per site) in partitions by its number of rows, cached.

    A fit runs some twenty jobs with a task per partition.  The sites' rows come in as
    many partitions as shuffles have, a number that is set by the size of the raw tables;
    beyond ``KMEANS_PARTITIONS`` they are dealt anew by site, each partition in order, so
    that where K-Means starts no longer hangs on that number.
    """
    n = data.rdd.getNumPartitions()
    if n <= KMEANS_PARTITIONS:
        return data
    need = max(KMEANS_PARTITIONS, -(-data.count() // KMEANS_ROWS))
    return data if n <= need else data.repartition(need, "site_id").sortWithinPartitions("site_id").cache()


def kmeans_best(df: DataFrame, k: int = KMEANS_K, restarts: int = KMEANS_RESTARTS,
                max_iter: int = KMEANS_MAX_ITER, seed: int = SEED, col: str = "pca"):
    """``restarts`` fits with consecutive seeds; the lowest training cost wins
    (ties: the lowest seed).

    The input is cached once, in as many partitions as its rows need; fits are
    submitted from a few driver threads, so their Spark jobs run concurrently on
    the cluster.
    """
    from concurrent.futures import ThreadPoolExecutor
    data = df.select("site_id", col).cache()
    dealt = dealt_by_rows(data)

    def fit(r):
        m = KMeans(k=k, maxIter=max_iter, seed=seed + r, featuresCol=col, predictionCol="raw").fit(dealt)
        return r, m, m.summary.trainingCost

    with ThreadPoolExecutor(max_workers=min(4, restarts)) as ex:
        fits = list(ex.map(fit, range(restarts)))
    dealt.unpersist()
    data.unpersist()
    _, model, cost = min(fits, key=lambda f: (f[2], f[0]))
    return model, cost


def centroid_distances(df: DataFrame, centers, col: str = "pca", out: str = "dist") -> DataFrame:
    """Euclidean distance to each of the k centroids as an array column."""
    x = vector_to_array(col)
    cs = [F.array(*[F.lit(float(v)) for v in c]) for c in centers]
    dists = [F.sqrt(F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v))
             for c in cs]
    return df.withColumn(out, F.array(*dists))


def inverse_distance_scores(df: DataFrame, mapping: dict[int, int], k: int,
                            dist: str = "dist", out: str = "scores") -> DataFrame:
    """Column j of the output is the score of aligned class j.

    Scores are 1/(d + 1e-9) normalised to sum 1 (an inverse-distance weighting); a
    class that no cluster is aligned with counts as at distance 0.
    """
    from_class = {aligned: raw for raw, aligned in mapping.items()}
    near = F.array(*[F.get(dist, F.lit(from_class[j])) if j in from_class else F.lit(0.0) for j in range(k)])
    inverse = F.transform(near, lambda d: 1.0 / (d + EPS))
    total = F.aggregate(inverse, F.lit(0.0), lambda a, b: a + b)
    return df.withColumn(out, F.transform(inverse, lambda v: v / total))


# --- vectors as arrays: distances to few centroids, in the row ---
MAX_CENTROID_VALUES = 1_000_000


def label_centroids(points: DataFrame, vec: str, label: str = "label") -> list[tuple[int, list[float]]]:
    """Mean vector of each label, on the driver after a check of the number of
    labels times the longest vector."""
    size = points.agg(F.count_distinct(label).alias("k"), F.max(F.size(vec)).alias("d")).first()
    if (size["k"] or 0) * (size["d"] or 0) > MAX_CENTROID_VALUES:
        raise ValueError(f"more than {MAX_CENTROID_VALUES} values of centroids")
    long = points.where(F.col(label).isNotNull()).select(label, F.posexplode(vec).alias("pos", "v"))
    means = long.groupBy(label, "pos").agg(F.avg("v").alias("c"))
    rows = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("c")).orderBy(label).collect()
    return [(r[label], [x["c"] for x in r["c"]]) for r in rows]


def inverse_distance_rows(points: DataFrame, vec: str, centroids: list[tuple[int, list[float]]], keep: list[str]) -> DataFrame:
    """``keep``, cls, dist, score per point and centroid: distances and the
    normalisation are computed inside the point's row, nothing is shuffled."""
    def distance(center):
        return F.sqrt(F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(v)) for v in center]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))

    near = F.array(*[F.struct(F.lit(label).alias("cls"), distance(center).alias("dist")) for label, center in centroids])
    inverse = lambda x: 1.0 / (x["dist"] + EPS)
    total = F.aggregate("_near", F.lit(0.0), lambda s, x: s + inverse(x))
    d = points.withColumn("_near", near).withColumn("_total", total)
    d = d.select(*keep, "_total", F.explode("_near").alias("_x"))
    return d.select(*keep, "_x.cls", "_x.dist", (1.0 / (F.col("_x.dist") + EPS) / F.col("_total")).alias("score"))
