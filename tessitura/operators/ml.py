"""Features, nearest-neighbour and Bayes classifiers, and cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def label_index(rows: DataFrame, label: str) -> DataFrame:
    """label and its index from 0, in order of the labels."""
    return rows.select(label).where(F.col(label).isNotNull()).distinct().withColumn("index", F.dense_rank().over(W.orderBy(label)) - 1)


def folds(key: Column, n: int, seed: int = 0) -> Column:
    """Fold of a row from a hash of its key."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") % n).cast("int")


def stratified_folds(rows: DataFrame, key: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """``fold`` in turn within each label, in the order of a hash."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("fold", ((F.row_number().over(W.partitionBy(label).orderBy(order, key)) - 1) % n).cast("int"))


def balanced(rows: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """As many rows of each label as the rarest has."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    least = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy(label).orderBy(order, key)))
    return ranked.join(F.broadcast(least)).where(F.col("place") <= F.col("least")).select(*rows.columns)


def z_norm(train: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features less their mean over their standard deviation (population), both of the training rows."""
    stats = train.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = rows.join(F.broadcast(stats))
    return joined.select(*[c for c in rows.columns if c not in set(features)], *[F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(c) for c in features])


def gaussian_bayes(train: DataFrame, rows: DataFrame, key: str, label: str, features: str) -> DataFrame:
    """key and guess by Gaussian naive Bayes on an array of features; closed forms, no model object."""
    long = train.select(F.col(label).alias("label"), F.posexplode(features).alias("i", "x"))
    per = long.groupBy("label", "i").agg(F.avg("x").alias("m"), (F.var_pop("x") + F.lit(1e-9)).alias("v"))
    model = per.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m", "v"))).alias("model"))
    prior = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    known = model.join(prior, "label")
    # One row a label: its size is the number of labels times features, whatever the number of rows.
    joined = rows.select(key, F.col(features).alias("x")).join(F.broadcast(known))
    terms = F.zip_with("x", "model", lambda x, m: -0.5 * F.log(2 * 3.141592653589793 * m["v"]) - (x - m["m"]) * (x - m["m"]) / (2 * m["v"]))
    score = F.log("n") + F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return joined.select(key, "label", score.alias("score")).groupBy(key).agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("guess"))


def multinomial_bayes(train: DataFrame, counts: DataFrame, key: str, label: str, alpha: float = 1.0) -> DataFrame:
    """key and guess by multinomial naive Bayes on (key, term, tf); ``train`` has (key, label).

    Words that no training document has tell nothing. A document's score of a label sums over its words that the label
    has, plus what it would have of none, so the join is as long as the words' labels, not words times labels.
    """
    known = counts.join(train.select(key, F.col(label).alias("label")), key)
    per = known.groupBy("label", "term").agg(F.sum("tf").alias("n"))
    size = per.groupBy("label").agg(F.sum("n").alias("total"))
    vocabulary = per.select("term").distinct()
    v = vocabulary.agg(F.count(F.lit(1)).alias("v"))
    docs = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("docs"))
    base = size.join(docs, "label").join(F.broadcast(v)).select("label", F.log(F.lit(alpha) / (F.col("total") + alpha * F.col("v"))).alias("none"), F.log("docs").alias("prior"))
    length = counts.join(vocabulary, "term", "left_semi").groupBy(key).agg(F.sum("tf").alias("length"))
    gain = counts.join(per, "term").groupBy(key, "label").agg(F.sum(F.col("tf") * F.log((F.col("n") + alpha) / F.lit(alpha))).alias("gain"))
    every = length.join(F.broadcast(base)).join(gain, [key, "label"], "left")
    score = F.col("prior") + F.col("length") * F.col("none") + F.coalesce("gain", F.lit(0.0))
    return every.select(key, "label", score.alias("score")).groupBy(key).agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("guess"))


def knn_vote(neighbours: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """The most frequent label among the ``k`` nearest (rank, label) of each key; of equals the smallest."""
    votes = neighbours.where(F.col("rank") <= k).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(key).agg(F.max_by(label, F.struct("n", -F.col(label))).alias("guess"))


CLASSIFIERS: dict[str, Callable] = {
    "nb-multi": lambda: C.NaiveBayes(modelType="multinomial"),
    "nb-gauss": lambda: C.NaiveBayes(modelType="gaussian"),
    "nb-bern": lambda: C.NaiveBayes(modelType="bernoulli"),
    "tree": lambda: C.DecisionTreeClassifier(seed=7),
    "forest": lambda: C.RandomForestClassifier(seed=7),
    "logistic": lambda: C.LogisticRegression(),
    "svm-linear": lambda: C.OneVsRest(classifier=C.LinearSVC()),
}


def cross_validate(rows: DataFrame, key: str, label: str, features: str, classifier: str, n: int = 5, seed: int = 0) -> DataFrame:
    """key, fold, truth and guess of every row, each fold judged by a model of the others. Labels are 0, 1, ..."""
    if classifier not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {classifier}")
    prepared = stratified_folds(rows.select(key, label, features), key, label, n, seed)
    prepared = prepared.select(key, "fold", F.col(label).cast("double").alias("label"), array_to_vector(features).alias("features"))
    out = None
    for k in range(n):
        model = CLASSIFIERS[classifier]().fit(prepared.where(F.col("fold") != k))
        part = model.transform(prepared.where(F.col("fold") == k)).select(key, "fold", F.col("label").alias("truth"), F.col("prediction").alias("guess"))
        out = part if out is None else out.unionByName(part)
    return out
