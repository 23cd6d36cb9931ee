"""A sparse rule ensemble that scores documents by quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keeps_names, let, once, with_columns, words_of

FEATURES = ("n_words", "word_length", "symbols", "loud", "capitals", "separators", "distinct_words", "distinct_lines", "line_words", "digits")


def text_features(text: Column) -> Column:
    """Statistics of one text as a struct of doubles, FEATURES by name: counts, and rates a word or a character."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))

    def of(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1)).cast("double")
        chars = F.greatest(F.length(text), F.lit(1)).cast("double")
        lines = F.split(text, "\n")
        values = {
            "n_words": F.size(words),
            "word_length": F.length(F.array_join(words, "")) / n,
            "symbols": count(r"[#*$%&<>{}^=_~]") / n,
            "loud": count(r"[!?]") / n,
            "capitals": count(r"[A-Z]") / chars,
            "separators": count(r"[|»•]") / n,
            "distinct_words": F.size(F.array_distinct(words)) / n,
            "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
            "line_words": n / F.size(lines),
            "digits": count(r"[0-9]") / chars,
        }
        return F.struct(*[values[k].cast("double").alias(k) for k in FEATURES])

    return let(words_of(text), of)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold) with its weight."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, above, cut in self.tests:
            out = out & ((stats[name] > cut) if above else (stats[name] <= cut))
        return out.cast("double")


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    bias: float

    def score(self, stats: Column) -> Column:
        """The probability of label 1 as a column expression over a struct of text_features."""
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column(stats) * rule.weight
        return 1 / (1 + F.exp(-total))


def paths(node, before=()) -> list[tuple]:
    """The conjunctions along a fitted tree, inner nodes included; a later test on a feature replaces a weaker one."""
    out = [before] if before else []
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, at = FEATURES[split.featureIndex()], round(float(split.threshold()), 6)
        for above, child in ((False, node.leftChild()), (True, node.rightChild())):
            kept = tuple(t for t in before if t[:2] != (name, above))
            out += paths(child, (*kept, (name, above, at)))
    return out


def fit_rules(labelled: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Fits trees on (stats, label), takes their paths as rules and weighs them by a lasso logistic regression.

    Without rows or with one label only, the ensemble is that constant (0.5 without rows).
    """
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or ones in (0, n):
        return RuleEnsemble((), 0.0 if n == 0 else (5.0 if ones else -5.0))
    flat = labelled.select("label", *[F.col("stats")[k].alias(k) for k in FEATURES])
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(flat)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(data)
    tests = sorted({p for tree in forest.trees for p in paths(tree._java_obj.rootNode())})
    if not tests:
        return RuleEnsemble((), 0.0)
    rules = [Rule(t) for t in tests]
    hits = flat.select("label", F.struct(*FEATURES).alias("stats")).select("label", *[r.column(F.col("stats")).alias(f"r{k}") for k, r in enumerate(rules)])
    hits = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(hits).select("label", "features")
    model = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(hits)
    weights = [float(w) for w in model.coefficients]
    return RuleEnsemble(tuple(Rule(r.tests, w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9), float(model.intercept))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(label, stats) of at most max_rows labelled documents, those of the least hashes of their ids.

    labels: id_col, label (0 or 1; null rows are left out; of several, the mean rounded up from a half). The sample of ids is bounded by max_rows, so it is broadcast.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col("label").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    found = docs.select(id_col, text_col).join(F.broadcast(ids), docs[id_col] == F.col("__id"))
    return found.select("__id", "label", text_features(F.col(text_col)).alias("stats")).orderBy(F.xxhash64("__id"), "__id").select("label", "stats")


@keeps_names
def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every document by a rule ensemble that is fitted on a bounded sample of labelled rows.

    Adds score (0 to 1) and predicted (1 if score >= 0.5), over input columns of these names. Only text statistics enter a
    score. Null and empty texts get the score of an empty text. Repeated rows and ties score alike. All rows stay; an
    empty table gives an empty table, and without labels every score is 0.5. max_rows bounds the fitting sample; scoring
    is one pass of column expressions over all rows.
    """
    model = fit_rules(cut(training_rows(docs, labels, max_rows, id_col, text_col)))
    scored = once(once(docs, "__stats", text_features(F.col(text_col))), "__score", model.score(F.col("__stats")))
    return with_columns(scored, ["__stats", "__score"], score=F.col("__score"), predicted=(F.col("__score") >= 0.5).cast("int"))
