"""Classification (M1-M8): hold-out split, TF-IDF, forest training and scoring, zero-shot
word-overlap labelling, evaluation.

Training uses ``pyspark.ml`` so fitting is distributed (one job per tree level); the model is
a ``PipelineModel`` saved and loaded by dimension name (K6).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (ElementwiseProduct, HashingTF, IDF, IndexToString, Normalizer, RegexTokenizer,
                                StringIndexer)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litsieve.constants import DEFAULT_TEST_PCT, DEFAULT_TREES, RANDOM_SEED, TEST_PCT_RANGE, TREES_RANGE, UNKNOWN
from litsieve.functions.columns import once
from litsieve.functions.text import has_text, search_text
from litsieve.session import cut_lineage, ensure_checkpoint_dir, landed, scratch_folder

# Words of at least two word characters, lower-cased: maximal runs of letters/digits/underscore.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def holdout_flag(id_col, test_pct: int = DEFAULT_TEST_PCT, seed: int = RANDOM_SEED):
    """M1: deterministic hash split; True = test row. Independent of partitioning."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 8), 16, 10)
    return F.pmod(h.cast("bigint"), F.lit(100)) < F.lit(test_pct)


def holdout_split(df: DataFrame, id_col: str, test_pct: int = DEFAULT_TEST_PCT, seed: int = RANDOM_SEED) -> tuple[DataFrame, DataFrame]:
    if not TEST_PCT_RANGE[0] <= test_pct <= TEST_PCT_RANGE[1]:
        raise ValueError("test share must be 10-40 %")
    flag = holdout_flag(id_col, test_pct, seed)
    return df.filter(~flag), df.filter(flag)


def tokens(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


CHARS_A_TASK = 1 << 24  # of texts whose terms one task counts


def tfidf_long(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """M2: (id, term, weight) with raw tf, smoothed idf ln((1+n)/(1+df))+1, L2-normalised rows.

    Texts are brought together by id, in tasks of about CHARS_A_TASK characters; a task counts and normalises its
    ids' terms itself, so no row a (id, term) is shuffled. Only the document frequencies are: combined map-side and
    kept in a table of the vocabulary, which Spark joins by broadcast where it is small and by the term where not.
    """
    n_docs, chars = df.select(id_col).distinct().count(), df.agg(F.sum(F.length(text_col))).first()[0] or 0
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.repartition(max(width, -(-chars // CHARS_A_TASK)), "id")
    tf = (texts.select("id", F.explode(tokens("text")).alias("term"))
          .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))
    folder = scratch_folder(df.sparkSession, "tfidf")
    dfreq = landed(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{folder}/df")
    w = (tf.filter(F.col("id").isNotNull()).join(dfreq, "term")
         .select("id", "term", (F.col("tf") * (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0))
                 .alias("w")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.select(F.col("id").alias(id_col), "term", (F.col("w") / norm).alias("weight"))


def smooth_idf(counted: DataFrame, tf_col: str, out_col: str) -> ElementwiseProduct:
    """Stage that multiplies term counts by ln((1+n)/(1+df)) + 1; terms in no row of ``counted`` weigh 0."""
    model = IDF(inputCol=tf_col, outputCol=out_col).fit(counted)
    weights = np.where(np.array(model.docFreq) > 0, model.idf.toArray() + 1.0, 0.0)
    return ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=tf_col, outputCol=out_col)


TRAIN_CELLS = 1 << 25  # numbers of training rows that one task holds (2,048 rows of 16,384)


def by_rows(data: DataFrame, num_features: int) -> DataFrame:
    """Training rows in tasks of at most about TRAIN_CELLS numbers: in Spark's trees each row is ``num_features`` of them,
    however short its text. Few rows stay as they are."""
    tasks = -(-data.count() // max(1, TRAIN_CELLS // num_features))
    return data.repartition(tasks) if tasks > 1 else data


def fit_forest(train: DataFrame, text_cols, label_col: str, drop_empty: bool = False, num_trees: int = DEFAULT_TREES,
               seed: int = RANDOM_SEED, num_features: int = 1 << 14, max_depth: int = 30) -> PipelineModel:
    """M3: tokenizer -> hashed counts -> smoothed idf -> L2 -> random forest -> label strings.

    Fits on the search text of ``text_cols``; ``drop_empty`` removes rows without text (P10), rows without a label
    take no part. Every term counts: terms are hashed into ``num_features`` columns, no vocabulary is gathered
    (Spark's trees keep a dense row of bins, so the number of columns bounds a training row's size).
    ``max_depth`` 30 is the deepest tree that Spark grows. A row's node in each tree is kept between passes (cut off at
    the checkpoint folder), so a pass does not walk the trees again. The model carries its index -> label mapping.
    """
    if not TREES_RANGE[0] <= num_trees <= TREES_RANGE[1]:
        raise ValueError("number of trees must be 50-500")
    data = train.select(search_text(text_cols).alias("ml_text"), F.col(label_col).cast("string").alias("label"))
    data = data.filter(F.col("label").isNotNull())
    if drop_empty:
        data = data.filter(has_text("ml_text"))
    indexer = StringIndexer(inputCol="label", outputCol="__label").fit(data)
    tok = RegexTokenizer(inputCol="ml_text", outputCol="__tokens", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=num_features)
    idf = smooth_idf(tf.transform(tok.transform(data)), "__tf", "__idf")
    norm = Normalizer(inputCol="__idf", outputCol="features", p=2.0)
    data = by_rows(indexer.transform(data), num_features)
    ensure_checkpoint_dir(train.sparkSession)
    rf = RandomForestClassifier(featuresCol="features", labelCol="__label", numTrees=num_trees, seed=seed, maxDepth=max_depth,
                                cacheNodeIds=True, predictionCol="__pred", rawPredictionCol="__raw", probabilityCol="__prob")
    back = IndexToString(inputCol="__pred", outputCol="prediction", labels=list(indexer.labelsArray[0]))
    return Pipeline(stages=[tok, tf, idf, norm, rf, back]).fit(data)


def predict(model: PipelineModel, df: DataFrame, text_cols, out_col: str = "prediction") -> DataFrame:
    """M4/M5: label string for every row (original columns kept)."""
    scored = model.transform(df.withColumn("ml_text", search_text(text_cols)))
    return scored.select(*df.columns, F.col("prediction").alias(out_col))


def save_model(model: PipelineModel, root: str, dimension: str) -> str:
    from litsieve.sinks.files import model_path
    path = model_path(root, dimension)
    model.write().overwrite().save(path)
    return path


def load_model(root: str, dimension: str) -> PipelineModel:
    """K6/M5: load by dimension; a missing model raises a clear error."""
    from litsieve.sinks.files import model_path
    path = model_path(root, dimension)
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # resolved on the file system that Spark itself uses
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(f"no trained model for dimension {dimension!r} under {root}")
    return PipelineModel.load(path)


def zero_shot_overlap(df: DataFrame, text_cols, candidates: dict[str, str], out_col: str = "prediction") -> DataFrame:
    """M6 (fallback scorer): best candidate label by word overlap with its description.

    score = share of the description's distinct words found among the text's words; highest
    score wins, earlier candidate on ties; empty text or no overlap -> 'Unknown'.
    """
    described = {label: sorted(set(t.lower() for t in re.findall(r"\w{2,}", desc))) for label, desc in candidates.items()}
    # of a text's words only those of some description matter; they are looked up once
    asked = F.array(*[F.lit(x) for x in sorted(set().union(*described.values()))])
    tmp = once(df, "__w", F.array_intersect(asked, tokens(search_text(text_cols))))
    cands = []
    for pos, (label, dw) in enumerate(described.items()):
        if not dw:
            continue
        hits = F.size(F.array_intersect(F.col("__w"), F.array(*[F.lit(x) for x in dw])))
        cands.append(F.struct((hits / F.lit(float(len(dw)))).alias("score"), F.lit(-pos).alias("neg_pos"),
                              F.lit(label).alias("label")))
    best = F.array_max(F.array(*cands))  # struct order: score, then earlier position
    return tmp.select(*df.columns, F.when(best["score"] > 0, best["label"]).otherwise(F.lit(UNKNOWN)).alias(out_col))


def evaluate(pred: DataFrame, label_col: str, pred_col: str) -> tuple[DataFrame, DataFrame]:
    """M7: (per-class precision / recall / F1 / support, overall accuracy) from a confusion table, which is counted once
    (a row a pair of classes) so that no figure makes the predictions again."""
    conf = pred.groupBy(F.col(label_col).cast("string").alias("label"), F.col(pred_col).cast("string").alias("pred")) \
        .agg(F.count(F.lit(1)).alias("n"))
    conf = cut_lineage(conf)
    support = conf.groupBy("label").agg(F.sum("n").alias("support"))
    predicted = conf.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    tp = conf.filter(F.col("label") == F.col("pred")).select("label", F.col("n").alias("tp"))
    per = (support.join(predicted, "label", "full").join(tp, "label", "left")
           .fillna(0, ["support", "n_pred", "tp"]))
    p = F.col("tp") / F.nullif(F.col("n_pred"), F.lit(0))
    r = F.col("tp") / F.nullif(F.col("support"), F.lit(0))
    per = per.select("label", F.col("support").cast("long").alias("support"),
                     F.round(F.coalesce(p, F.lit(0.0)), 6).alias("precision"),
                     F.round(F.coalesce(r, F.lit(0.0)), 6).alias("recall"),
                     F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 6).alias("f1"))
    acc = conf.agg(F.round(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n"), 6)
                   .alias("accuracy"), F.sum("n").cast("long").alias("n"))
    return per, acc
