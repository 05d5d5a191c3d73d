"""Mixing to target weights: soft domain membership, rates by projected gradient. No Python on executors."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pick, table

#: Domains of the labelled table, as SQL over its columns, and the share of tokens each should have.
DOMAINS = {"clean": "quality = 1 and toxic = 0", "low": "quality = 0", "toxic": "quality = 1 and toxic = 1"}
TARGETS = {"clean": 0.94, "low": 0.04, "toxic": 0.02}
#: Labelled documents learned from at most, hashed features, parts of one that posteriors are rounded to.
MOST_LABELLED, FEATURES, GRID = 20_000, 1 << 15, 200
#: Weight of the squared coefficients in the fit, and its iterations at most.
PENALTY, ITERATIONS = 3e-4, 60
#: Tasks of a step of the fit.
FIT_TASKS = 8
#: Pull of rates to one, relative error at which the gradient ends, most steps.
PULL, CLOSE, MOST_STEPS = 1e-3, 1e-5, 40


def word_list(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")


def featured(docs: DataFrame) -> DataFrame:
    """``docs`` without text but with n_tokens and a sparse vector of the features that it has; a null text is an empty one.

    Features are its words, the shapes of what stands between blanks (letters as a, digits as 9,
    runs of signs as ##), the share of shapes with such runs, how varied words and shapes are and
    how many there are, each hashed and counted once.
    """
    held = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", word_list("text"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\p{L}+", "a"), r"\p{N}+", "9"), r"[^\p{L}\p{N}\s]{2,}", "##")
    held = held.withColumn("shapes", F.split(shape, r"\s+"))
    n, m, own, kinds = F.size("words"), F.size("shapes"), F.array_distinct("words"), F.array_distinct("shapes")
    told = lambda mark, value: F.array(F.concat(F.lit(mark), F.floor(value).cast("int").cast("string")))
    some = lambda part, whole, parts: part / F.greatest(whole, F.lit(1)) * parts
    marked = F.size(F.filter("shapes", lambda s: s.contains("##")))
    named = F.concat(own, F.transform(kinds, lambda s: F.concat(F.lit("\x01"), s)), told("\x02", some(F.size(own), n, 20)), told("\x03", F.log2(n + F.lit(1))), told("\x04", some(F.size(kinds), m, 50)), told("\x05", some(marked, m, 20)))
    kept = [c for c in docs.columns if c != "text"]
    hashed = HashingTF(inputCol="named", outputCol="features", numFeatures=FEATURES, binary=True)
    return hashed.transform(held.select(*kept, n.cast("long").alias("n_tokens"), named.alias("named"))).drop("named")


def classifier(known: DataFrame) -> LogisticRegressionModel | list[float]:
    """Multinomial logistic regression of (label, features); of fewer than two labels only their shares."""
    counts = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return [1.0 if k in counts else 0.0 for k in range(len(DOMAINS))] if counts else [1 / len(DOMAINS)] * len(DOMAINS)
    return LogisticRegression(family="multinomial", standardization=False, regParam=PENALTY, maxIter=ITERATIONS).fit(known)


def membership(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>): posteriors of each domain, in parts of 1 / ``GRID``.

    The classifier learns from at most ``MOST_LABELLED`` labelled documents, those of smallest hash
    of the id; all documents are scored in the JVM. Without labelled documents all domains are
    equally likely.
    """
    rules = F.coalesce(*[F.when(F.expr(rule), F.lit(float(k))) for k, rule in enumerate(DOMAINS.values())])
    chosen = labels.select("doc_id", rules.alias("label")).where("label is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    known = materialise(featured(docs.join(F.broadcast(chosen), "doc_id").select("label", "text")), "labelled-features")
    # A bounded sample: every step of the fit is then a few tasks, each of which sends a gradient.
    model = classifier(known.coalesce(FIT_TASKS))
    features, names = featured(docs.select("doc_id", "text")), [f"p_{d}" for d in DOMAINS]
    if isinstance(model, list):
        held = features.select("doc_id", "n_tokens", *[F.lit(p).alias(n) for p, n in zip(model, names)])
    else:
        found = model.transform(features).select("doc_id", "n_tokens", vector_to_array("probability").alias("p"))
        held = found.select("doc_id", "n_tokens", *[F.coalesce(F.get("p", F.lit(k)), F.lit(0.0)).alias(n) for k, n in enumerate(names)])
    # The likeliest domain takes what rounding leaves, so that posteriors add up to one and none is negative.
    rounded = held.select("doc_id", "n_tokens", *[F.round(F.col(n) * GRID).alias(n) for n in names])
    left = F.lit(GRID) - reduce(lambda a, b: a + b, map(F.col, names))
    top = F.array_position(F.array(*names), F.greatest(*names))
    return rounded.select("doc_id", "n_tokens", *[((F.col(n) + F.when(top == k + 1, left).otherwise(0)) / GRID).alias(n) for k, n in enumerate(names)])


def rate_after(history: list[list[float]]) -> Column:
    """The rate of a document after the steps in ``history``, from its posteriors alone."""
    rate = F.lit(1.0)
    if not history:
        return rate
    steps = F.array(*[F.array(*map(F.lit, g)) for g in history])
    pulled = lambda r, g: sum((F.col(f"p_{d}") * g[k] for k, d in enumerate(DOMAINS)), F.lit(PULL) * (r - 1))
    return F.aggregate(steps, rate, lambda r, g: F.greatest(F.lit(0.0), r - pulled(r, g) / (1 + PULL)))


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gauss-Jordan elimination of a small positive definite system."""
    rows = [[*row, r] for row, r in zip(matrix, right)]
    for i, row in enumerate(rows):
        rows[i] = row = [v / row[i] for v in row]
        rows = [row if j == i else [v - other[i] * w for v, w in zip(other, row)] for j, other in enumerate(rows)]
    return [row[-1] for row in rows]


def fit_rates(cells: DataFrame, targets: dict[str, float]) -> list[list[float]]:
    """Gradients of all steps of projected-gradient least squares.

    ``cells`` has the posteriors p_<domain> and the tokens n of each. A step sums the expected
    tokens of each domain at the current rates over all cells; only those sums reach the
    driver. Errors are weighed by the inverse of the domains' joint token mass, so that the
    squared error has curvature of at most one: steps of one over that (and the pull) converge,
    and a single one ends it where no rate meets zero.
    """
    names = list(DOMAINS)
    p = {d: F.col(f"p_{d}") for d in names}
    joint = cells.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * p[a] * p[b]).alias(f"{a}_{b}") for a in names for b in names]).first()
    if not joint["n"]:
        return []
    total = joint["n"]
    mass = [[joint[f"{a}_{b}"] + (1e-6 * total if a == b else 0) for b in names] for a in names]
    wanted = [targets[d] / sum(targets.values()) * total for d in names]
    history: list[list[float]] = []
    before = None
    for _ in range(MOST_STEPS):
        had = cells.select("n", *p.values(), rate_after(history).alias("rate"))
        sums = had.agg(*[F.sum(F.col("n") * F.col("rate") * p[d]).alias(d) for d in names]).first()
        error = [sums[d] - w for d, w in zip(names, wanted)]
        change = max(map(abs, error if before is None else [a - b for a, b in zip(error, before)]))
        if max(map(abs, error)) <= CLOSE * total or change <= CLOSE * total:
            break
        history.append(solved(mass, error))
        before = error
    else:
        warnings.warn(f"rates still miss a target by {max(map(abs, error)) / total:.2g} of all tokens after {MOST_STEPS} steps", stacklevel=2)
    return history


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS) -> DataFrame:
    """Rate of every document such that expected domain token totals match the targets.

    Result: doc_id, n_tokens (words), p_<domain>, rate (not negative) and copies, the rate
    rounded up or down by a hash of the id so that its mean is the rate. Rates follow from
    a document's own posteriors; as those are in parts of 1 / ``GRID``, steps run over the token totals
    of at most some 20,000 combinations of them, which cover all documents. If ``MOST_STEPS`` don't
    bring the totals to the targets, a warning says what is missing.

    A null or empty text has no tokens and a rate by what few features it has. Null ids get a rate
    like others, rows that repeat an id each their own; of labels that repeat an id the lowest
    quality and highest toxicity count, null ones don't. A target no document can serve stays
    unmet. Texts of any length count whole; further columns, whatever their names, are ignored.
    No rows: no result.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    labels = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null")
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality is not null and toxic is not null")
    known = materialise(membership(docs, labels), "mixing-posteriors")
    names = [f"p_{d}" for d in DOMAINS]
    cells = materialise(known.groupBy(*names).agg(F.sum("n_tokens").alias("n")), "mixing-cells")
    found = known.select("doc_id", "n_tokens", *names, F.round(rate_after(fit_rates(cells, targets)), 9).alias("rate"))
    uniform = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return found.withColumn("copies", F.floor(F.col("rate") + uniform).cast("int"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
