"""Category model: merchant TF-IDF and numeric features into a multinomial logistic regression."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    ElementwiseProduct,
    IndexToString,
    Normalizer,
    OneHotEncoder,
    RegexTokenizer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.sampling import class_weights
from ledgerline.session import stage

# Settings of the category model.
TOKEN_PATTERN = r"(?U)\b\w\w+\b"
MAX_TERMS = 10_000
MIN_DOCUMENTS = 3
NUMERIC = ["log_amount", "amount_bin", "day_of_week", "hour"]
INVERSE_REGULARISATION = 0.7
MAX_ITERATIONS = 900
TOLERANCE = 1e-4


def term_statistics(df: DataFrame, text: str, min_documents: int = MIN_DOCUMENTS, max_terms: int = MAX_TERMS) -> DataFrame:
    """``term``, ``df`` (rows with the term) and smooth ``idf``, for the most frequent terms."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # Each token counts once for tf, each distinct token of a row once for df; one pass, one shuffle.
    entries = F.concat(
        F.transform("tokens", lambda t: F.struct(t.alias("term"), one.alias("tf"), none.alias("df"))),
        F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), none.alias("tf"), one.alias("df"))),
    )
    terms = df.select(tokens.alias("tokens")).select(F.inline(entries))
    counted = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    total = df.agg(F.count("*").alias("n")).scalar()
    idf = F.log((1 + total) / (1 + F.col("df"))) + 1
    return (
        counted.where(F.col("df") >= min_documents)
        .orderBy(F.desc("tf"), "term")
        .limit(max_terms)
        .select("term", "df", idf.alias("idf"))
    )


def fit_text(df: DataFrame, text: str, output: str = "tfidf") -> list[Model]:
    """Fitted stages that turn ``text`` into L2-normal TF-IDF vectors with smooth IDF."""
    return fit_tokens(df.select(text), text, output)[0]


def fit_tokens(df: DataFrame, text: str, output: str = "tfidf") -> tuple[list[Model], DataFrame]:
    """The stages of :func:`fit_text`, and ``df`` with ``_tokens``, which is what the first of them adds.

    The tokens are staged: the fit reads them several times, and cutting them out of the text costs most of a pass.
    """
    source = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    tokenizer = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False)
    tokens = stage(tokenizer.transform(source), "tokens")
    counter = CountVectorizer(inputCol="_tokens", outputCol="_counts", vocabSize=MAX_TERMS, minDF=MIN_DOCUMENTS).fit(tokens)
    idf = IDF(inputCol="_counts", outputCol="_idf").fit(counter.transform(tokens)).idf
    # Smooth IDF is MLlib's value plus one, so the weights are applied by a product stage.
    weights = Vectors.dense([value + 1.0 for value in idf])
    stages = [
        tokenizer,
        counter,
        ElementwiseProduct(inputCol="_counts", outputCol="_weighted", scalingVec=weights),
        Normalizer(inputCol="_weighted", outputCol=output, p=2.0),
    ]
    return stages, tokens


def fit_categorizer(
    df: DataFrame,
    text: str = "merchant",
    label: str = "category",
    numeric: list[str] | None = None,
    state: str | None = None,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
) -> PipelineModel:
    """Fit on rows with a label. The result maps ``text`` and ``numeric`` columns to ``pred_category``."""
    numeric = NUMERIC if numeric is None else numeric
    rows = df.where(F.col(label).isNotNull()).na.fill(0, numeric).na.fill("", [text])
    stages, rows = fit_tokens(rows.select(*dict.fromkeys([text, label, *numeric, *([state] if state else [])])), text)
    weights = class_weights(rows, label)
    # One row per class; the model itself keeps a coefficient vector for each class on the driver.
    weighted = rows.join(F.broadcast(weights.select(label, "weight")), label)
    inputs = ["tfidf", *numeric]
    if state:
        states = StringIndexer(inputCol=state, outputCol="_state", handleInvalid="keep").fit(rows)
        encoder = OneHotEncoder(inputCols=["_state"], outputCols=["_state_vector"], handleInvalid="keep", dropLast=False)
        stages += [states, encoder.fit(states.transform(rows))]
        inputs.append("_state_vector")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    labels = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    prepared = labels.transform(PipelineModel(stages[1:]).transform(weighted)).select("features", "_label", "weight").persist()
    total = prepared.count()
    classifier = LogisticRegression(
        featuresCol="features",
        labelCol="_label",
        weightCol="weight",
        predictionCol="_prediction",
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        family="multinomial",
        standardization=False,
        maxIter=max_iterations,
        tol=tolerance,
        regParam=1.0 / (INVERSE_REGULARISATION * max(total, 1)),
    ).fit(prepared)
    prepared.unpersist()
    names = IndexToString(inputCol="_prediction", outputCol="pred_category", labels=labels.labels)
    return PipelineModel([*stages, classifier, names])


def categorize(df: DataFrame, model: PipelineModel, numeric: list[str] | None = None, text: str = "merchant") -> DataFrame:
    """``df`` with ``pred_category``; the prediction is a column of its own row."""
    numeric = NUMERIC if numeric is None else numeric
    predicted = model.transform(df.na.fill(0, numeric).na.fill("", [text]))
    return predicted.select(*df.columns, "pred_category")


def feature_entries(df: DataFrame, model: PipelineModel, key: str, text: str, numeric: list[str]) -> DataFrame:
    """(``key``, feature, value) of the features that are not 0: normal TF-IDF of the vocabulary's terms, then ``numeric``."""
    counter, product = model.stages[1], model.stages[2]
    terms = [(t, k, float(w)) for k, (t, w) in enumerate(zip(counter.vocabulary, product.getScalingVec().toArray()))]
    vocabulary = F.broadcast(df.sparkSession.createDataFrame(terms, "term string, feature int, idf double"))  # at most MAX_TERMS rows
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
    counted = df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    weighted = counted.join(vocabulary, "term").select(key, "feature", (F.col("n") * F.col("idf")).alias("value"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    words = weighted.join(norms, key).select(key, "feature", (F.col("value") / F.col("norm")).alias("value"))
    figures = [F.struct(F.lit(len(terms) + k).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for k, c in enumerate(numeric)]
    if not figures:
        return words
    return words.unionByName(df.select(key, F.inline(F.array(*figures))).where("value <> 0"))


def optimality(
    df: DataFrame, model: PipelineModel, key: str = "txn_id", text: str = "merchant", label: str = "category", numeric: list[str] | None = None
) -> DataFrame:
    """(``label``, n, gradient) for the rows ``df`` that ``model`` was fitted on: how far its weights are from the optimum.

    The loss is convex, so a gradient of 0 proves the fit whatever the optimiser did. It is found without the optimiser's
    code: scores of a row are a sum over its features, and the gradient of a weight a sum over the feature's rows. gradient is
    the greatest absolute partial derivative of the class's weights and intercept. ``key`` is unique and not NULL.
    """
    numeric = NUMERIC if numeric is None else numeric
    classifier, labels = model.stages[-2], model.stages[-1].getLabels()
    rows = df.where(F.col(label).isNotNull())
    entries = stage(feature_entries(rows, model, key, text, numeric), "feature-entries")
    matrix = classifier.coefficientMatrix.toArray().T.tolist()
    weights = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(matrix)), "feature int, weights array<double>"))
    classes = range(len(labels))
    sums = entries.join(weights, "feature").groupBy(key).agg(*(F.sum(F.col("value") * F.col("weights")[k]).alias(f"z{k}") for k in classes))
    weighted = rows.join(F.broadcast(class_weights(rows, label).select(label, "weight")), label).select(key, label, "weight")
    scores = weighted.join(sums, key, "left").select(
        key, label, "weight", F.array(*(F.exp(F.coalesce(f"z{k}", F.lit(0.0)) + float(classifier.interceptVector[k])) for k in classes)).alias("e")
    )
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    errors = [F.col("weight") * (F.col("e")[k] / total - (F.col(label) == name).cast("double")) for k, name in enumerate(labels)]
    scores = stage(scores.select(key, label, "weight", F.array(*errors).alias("error")), "class-errors")
    n = scores.agg(F.sum("weight")).scalar()
    by_class = [F.sum(F.col("value") * F.col("error")[k]) for k in classes]
    sloped = entries.join(scores.select(key, "error"), key).groupBy("feature").agg(F.array(*by_class).alias("slope"))
    penalty = classifier.getRegParam()
    sloped = weights.join(sloped, "feature", "left").select(
        F.array(*(F.coalesce(F.col("slope")[k], F.lit(0.0)) / n + penalty * F.col("weights")[k] for k in classes)).alias("slope")
    )
    sloped = sloped.unionByName(scores.agg(F.array(*(F.sum(F.col("error")[k]) / n for k in classes)).alias("slope")))
    greatest = sloped.agg(F.array(*(F.max(F.abs(F.col("slope")[k])) for k in classes)).alias("g"))
    named = greatest.select(F.inline(F.arrays_zip(F.array(*map(F.lit, labels)).alias(label), F.col("g").alias("gradient"))))
    return scores.groupBy(label).agg(F.count("*").alias("n")).join(F.broadcast(named), label).select(label, "n", "gradient")
