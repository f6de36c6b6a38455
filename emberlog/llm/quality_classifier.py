"""Quality classifier (10): co-training of a text-content view and a page-metadata view."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import BLANKS, own_columns, words
from emberlog.session import cut

#: Labelled rows that fitting may use: those with the smallest id hashes. The unlabelled pool is all other documents.
SAMPLE = 20_000
ROUNDS, CONFIDENT = 3, 0.97
#: Steps of a fit, and the relative change of the loss under which it ends; each step is a job over all rows fitted on.
STEPS, TOLERANCE = 20, 1e-3
#: Rows that a task of a fit holds; a step's cost is its tasks' start as much as their sums.
TASK_ROWS = 50_000
HASHED = 1 << 12
TEXT = ("symbols", "upper", "letters", "bangs", "bars", "word_length", "repeats", "long_words")
META = ("log_chars", "log_lines", "line_length", "duplicate_lines")


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, carry: bool = False) -> DataFrame:
    """(doc_id, text_view, meta_view): vectors of the two views; each row's text is read once. carry adds `row`, the whole input row.

    Text: shares of symbols, capitals and letters, word lengths, repeated words, and hashed word endings. Metadata:
    language and source (hashed), size, and the page's layout in lines.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    row = [F.struct(*own_columns(docs)).alias("row")] if carry else []
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), label(lang_col).alias("lang"), label(source_col).alias("source"), *row)
    d = d.withColumn("w", words(F.col("t"))).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]")))
    n, n_words, n_lines = (F.greatest(x, F.lit(1)) for x in (F.char_length("t"), F.size("w"), F.size("lines")))
    gone = lambda chars: n - F.greatest(F.char_length(F.translate("t", chars, "")), F.lit(0))
    d = d.withColumns({
        "symbols": F.least(gone("#*$%&<>") / n_words, F.lit(3.0)), "bangs": F.least(gone("!") / n_words, F.lit(3.0)), "bars": F.least(gone("|") / n_words, F.lit(3.0)),
        "upper": F.length(F.regexp_replace("t", r"\P{Lu}+", "")) / n, "letters": F.length(F.regexp_replace("t", r"\P{L}+", "")) / n,
        "word_length": F.least(n / n_words, F.lit(40.0)) / 10, "repeats": 1 - F.size(F.array_distinct("w")) / n_words, "long_words": F.size(F.filter("w", lambda x: F.length(x) > 20)) / n_words,
        "log_chars": F.log1p(n) / 5, "log_lines": F.log1p(n_lines) / 3, "line_length": F.log1p(n / n_lines) / 5, "duplicate_lines": 1 - F.size(F.array_distinct("lines")) / n_lines,
    })
    # a word's last two characters: enough for decorations and languages, and few enough to learn from a sample
    d = d.withColumn("endings", F.array_distinct(F.transform("w", lambda x: F.substring(x, -2, 2)))).withColumn("names", F.array(F.concat(F.lit("l:"), "lang"), F.concat(F.lit("s:"), "source")))
    d = d.drop("t", "w", "lines")
    d = HashingTF(inputCol="endings", outputCol="hashed", numFeatures=HASHED, binary=True).transform(d)
    d = HashingTF(inputCol="names", outputCol="named", numFeatures=256, binary=True).transform(d)
    d = VectorAssembler(inputCols=[*TEXT, "hashed"], outputCol="text_view").transform(d)
    return VectorAssembler(inputCols=[*META, "named"], outputCol="meta_view").transform(d).select("doc_id", "text_view", "meta_view", *(["row"] if carry else []))


def _logit(model: LogisticRegressionModel, df: DataFrame, view: str, out: str) -> DataFrame:
    scored = model.setFeaturesCol(view).setRawPredictionCol("_raw").setProbabilityCol("_p").setPredictionCol("_y").transform(df)
    return scored.withColumn(out, vector_to_array("_raw")[1]).drop("_raw", "_p", "_y")


def _fit(df: DataFrame, view: str, parts: int, reg: float = 1e-3) -> LogisticRegressionModel:
    df = df.coalesce(parts)
    return LogisticRegression(featuresCol=view, labelCol="label", regParam=reg, maxIter=STEPS, tol=TOLERANCE, standardization=False).fit(df)


@dataclass
class CoTrained:
    """Both views' models and the calibration (intercept, weight) of each, with the rounds' exchange counts."""

    text: LogisticRegressionModel
    meta: LogisticRegressionModel
    calibration: dict[str, tuple[float, float]]
    shares: dict[str, float]
    exchanged: list[tuple[int, int]]


def co_train(rows: DataFrame, parts: int = 8, rounds: int = ROUNDS, confident: float = CONFIDENT) -> CoTrained:
    """rows: (doc_id, text_view, meta_view, label or null). Null labels are the unlabelled pool; parts: tasks of a fit.

    Every round fits each view on the true labels and on the other view's confident pseudo-labels for pool rows. A fifth
    of the labelled rows, by id hash, is held out to calibrate each view (Platt) and weigh the two by their log loss.
    With too few labels for both parts to hold both classes, all are fitted on and the views stay as they are, at equal weight.
    """
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5))
    labelled, pool = rows.where("label is not null"), rows.where("label is null").drop("label")
    classes = lambda x: F.count_distinct(F.when(x, F.col("label")))
    enough = min(labelled.agg(classes(fold > 0).alias("a"), classes(fold == 0).alias("b")).first()) == 2
    known, held = (labelled.where(fold > 0), labelled.where(fold == 0)) if enough else (labelled, None)
    cols = ["text_view", "meta_view", "label"]
    extra = {"text": known.select(*cols).limit(0), "meta": known.select(*cols).limit(0)}
    bound = math.log(confident / (1 - confident))
    exchanged = []
    models = {}
    for k in range(rounds):
        models = {v: _fit(known.select(*cols).unionByName(extra[v]), f"{v}_view", parts) for v in ("text", "meta")}
        if k == rounds - 1:
            break
        scored = pool
        for v in models:
            scored = _logit(models[v], scored, f"{v}_view", f"{v}_logit")
        # the whole pool is scored again by whoever reads it, which is cheaper than to write its vectors anew
        for v, other in (("text", "meta"), ("meta", "text")):  # `other` learns from what v is sure of
            sure = scored.where(F.abs(f"{v}_logit") >= bound)
            extra[other] = sure.select("text_view", "meta_view", (F.col(f"{v}_logit") > 0).cast("double").alias("label"))
        sure = [F.count_if(F.abs(f"{v}_logit") >= bound) for v in ("text", "meta")]
        exchanged.append(tuple(scored.agg(*sure).first()))
    if not enough:
        return CoTrained(models["text"], models["meta"], {v: (0.0, 1.0) for v in models}, {v: 0.5 for v in models}, exchanged)
    calibration, loss = {}, {}
    scored = held
    for v in models:
        scored = _logit(models[v], scored, f"{v}_view", f"{v}_logit")
    scored = cut(scored.select("label", "text_logit", "meta_logit"), "held")
    for v in models:
        x = VectorAssembler(inputCols=[f"{v}_logit"], outputCol="x").transform(scored)
        m = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-4).fit(x)
        calibration[v] = (float(m.intercept), float(m.coefficients[0]))
        z = F.lit(calibration[v][0]) + F.lit(calibration[v][1]) * F.col(f"{v}_logit")
        loss[v] = scored.agg(F.avg(F.log1p(F.exp(F.when(F.col("label") > 0.5, -z).otherwise(z))))).first()[0] or 1.0
    inverse = {v: 1 / max(loss[v], 1e-3) for v in loss}
    return CoTrained(models["text"], models["meta"], calibration, {v: inverse[v] / sum(inverse.values()) for v in loss}, exchanged)


def train(f: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> CoTrained | None:
    """Fit on features() that are written as a table: at most `sample` labelled rows, and all other documents as the pool
    in which the views exchange pseudo-labels. None if the labels hold fewer than two classes. An id's label is its
    largest one; rows without an id belong to the pool.
    """
    lab = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("label"))
    known = f.select("doc_id").distinct().join(lab, "doc_id")
    some = cut(known.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample), "sample")
    if some.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    # rows that share an id and the labels beyond the sample have no pseudo-labels either
    first = f.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).repartition(8, "doc_id").sortWithinPartitions("doc_id")
    rows = cut(first.select("doc_id", "text_view", "meta_view", "label"), "labelled")
    pool = f.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti").select("doc_id", "text_view", "meta_view", F.lit(None).cast("double").alias("label"))
    return co_train(rows.unionByName(pool), max(4, f.count() // TASK_ROWS + 1))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", threshold: float = 0.5, model: CoTrained | None = None, **options) -> DataFrame:
    """Score every document by the calibrated views together.

    The features of all rows are written once; training and scoring read them. Null and empty texts are scored from
    empty views like any other; null language and source count as empty. Repeated rows are scored each by itself.
    Without labels of both classes every score is 1 (nothing is rejected). Returns (doc_id, text_score, meta_score,
    score, kept), a row for each input row; other columns are not read.
    """
    f = cut(features(docs, id_col, text_col, lang_col, source_col), "features")
    model = model or train(f, labels, **options)
    if model is None:
        one = F.lit(1.0)
        return f.select("doc_id", one.alias("text_score"), one.alias("meta_score"), one.alias("score"), F.lit(True).alias("kept"))
    return _scored(f, model, threshold)


def _scored(f: DataFrame, model: CoTrained, threshold: float, *more: str) -> DataFrame:
    z: dict[str, Column] = {}
    for v, m in (("text", model.text), ("meta", model.meta)):
        f = _logit(m, f, f"{v}_view", f"{v}_logit")
        z[v] = F.lit(model.calibration[v][0]) + F.lit(model.calibration[v][1]) * F.col(f"{v}_logit")
    p = lambda x: F.round(1 / (1 + F.exp(-x)), 6)
    both = F.lit(model.shares["text"]) * z["text"] + F.lit(model.shares["meta"]) * z["meta"]
    return f.select("doc_id", p(z["text"]).alias("text_score"), p(z["meta"]).alias("meta_score"), p(both).alias("score"), (p(both) >= threshold).alias("kept"), *more)


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns; each row is judged by itself.

    The features are written with the rows, which costs less than to make them again for the scores.
    """
    f = cut(features(docs, id_col, text_col, lang_col, source_col, carry=True), "features")
    model = train(f, labels, **options)
    if model is None:
        return docs
    return _scored(f, model, threshold, "row").where("kept").select("row.*")
