"""Secret scan: a random forest removes false positives from candidate findings.

A candidate is a run of at least ``MIN_LENGTH`` key characters.  Its features
are native columns: length, character-class transitions, share of characters
covered by corpus dictionary words, path shape, and the words before it.  The
forest (JVM-side, trees over a bounded sample of labelled findings) gives every
candidate a probability.

Labelled findings come from the corpus: a candidate with digits right after a
credential word and an assignment sign is a secret, a candidate of letters only
or with a path shape and no credential word is not, nor is one that holds a
placeholder word whole or is assigned to a name that does; other candidates are left
unlabelled and only scored.  Of each class the first ``CLASS_ROWS`` distinct
(candidate, before) findings in hash order fit the forest, so copies weigh
nothing and a rare class is not crowded out.  The dictionary is the ``DICTIONARY`` most frequent
words over all documents.

Defined results: null or empty text has no candidate; a candidate repeated in
a document gives a row each; with labels of one class only among all labelled
findings, every score is that class; with none every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, landed, let, split_words

MIN_LENGTH = 16
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
CREDENTIAL = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|credential|auth|bearer|private)"
# A placeholder word between non-letters, or one hump of a camelCase name, or the documented AWS endings.
PLACEHOLDER = (r"(?<![A-Za-z])(?i:example|sample|dummy|test|placeholder|your|x{4,})(?![A-Za-z])"
               r"|(?<![A-Z])(?:Example|Sample|Dummy|Test|Placeholder|Your)(?![a-z])"
               r"|(?<![A-Za-z])(?:example|sample|dummy|test|placeholder|your)(?=[A-Z])|EXAMPLE(?:KEY)?$")
ASSIGNED_NAME = r"([A-Za-z0-9_.-]+)[\"'\]]*\s*[:=]+>?\s*[\"']?$"
DICTIONARY = 300
CLASS_ROWS = 20_000
TREES, DEPTH, SEED = 20, 6, 11
FEATURES = ["f_length", "f_transitions", "f_dictionary", "f_path", "f_credential", "f_placeholder", "f_assigned",
            "f_digits"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, position, candidate, before) of every candidate; position counts tokens from 0."""
    found = let(split_words(F.col("text"), SPACE), lambda t: F.transform(
        F.filter(F.transform(t, lambda x, i: F.struct(i.alias("position"), x.alias("token"))),
                 lambda s: (F.length(s["token"]) >= MIN_LENGTH) & s["token"].rlike(CANDIDATE)),
        lambda s: F.struct(s["position"].alias("position"), s["token"].alias("token"), F.concat_ws(
            " ", F.slice(t, F.greatest(s["position"] - 2, F.lit(1)),
                         F.least(s["position"], F.lit(3)))).alias("before"))))
    rows = docs.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")
    piece = F.explode(F.regexp_extract_all("token", F.lit(CANDIDATE), F.lit(0)))
    return rows.withColumn("candidate", piece).withColumn(
        "before", F.concat_ws(" ", "before", F.expr("substring_index(token, candidate, 1)"))).drop("token")


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The ``size`` most frequent letter-only words of three letters or more (ties by word)."""
    words = docs.select(F.explode(split_words(ascii_lower(F.col("text")), r"[^a-z]+")).alias("word"))
    top = (words.where(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), "word").limit(size))
    return [r["word"] for r in top.collect()]


def featured(found: DataFrame, words: list[str]) -> DataFrame:
    """Candidates with the feature columns."""
    c = F.col("candidate")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        c, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    runs = F.regexp_replace(shape, r"(.)\1+", "$1")
    n = F.length(c).cast("double")
    longest_first = sorted(words, key=lambda w: (-len(w), w))
    covered = (n - F.length(F.regexp_replace(F.lower(c), "|".join(longest_first), ""))) if words else F.lit(0.0)
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return (found.withColumn("f_length", n).withColumn("f_transitions", (F.length(runs) - 1) / n)
            .withColumn("f_dictionary", covered / n)
            .withColumn("f_path", (n - F.length(F.regexp_replace(c, "/", ""))) / n)
            .withColumn("f_credential", flag(F.col("before").rlike(CREDENTIAL)))
            .withColumn("f_placeholder", flag(
                F.regexp_extract("before", ASSIGNED_NAME, 1).rlike(PLACEHOLDER) | c.rlike(PLACEHOLDER)))
            .withColumn("f_assigned", flag(F.col("before").rlike(r"[=:]\s*[\"']?$")))
            .withColumn("f_digits", (n - F.length(F.regexp_replace(c, "[0-9]", ""))) / n))


def label() -> Column:
    """1.0 secret, 0.0 false positive, null unlabelled."""
    named = (F.col("f_credential") == 1) & (F.col("f_assigned") == 1) & (F.col("f_digits") > 0)
    plain = (F.col("f_credential") == 0) & ((F.col("f_digits") == 0) | (F.col("f_path") > 0.05))
    return F.when(named & (F.col("f_placeholder") == 0), 1.0).when(plain | (F.col("f_placeholder") == 1), 0.0)


def training_sample(found: DataFrame, class_rows: int = CLASS_ROWS) -> DataFrame:
    """Label and features of the first ``class_rows`` distinct labelled findings of each class in hash order."""
    # Label and features follow from (candidate, before), so copies agree in all columns.
    distinct = (found.withColumn("label", label()).where("label is not null")
                .select("candidate", "before", "label", *FEATURES).dropDuplicates(["candidate", "before"]))
    distinct = landed(distinct, "findings")
    sizes = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    h = F.xxhash64("candidate", "before")

    def first(of: float) -> DataFrame:
        rows = distinct.where(F.col("label") == of)
        if sizes.get(of, 0) > 2 * class_rows + 1000:
            # The lowest hashes, about twice the rows wanted: the sorted task reads no more than those.
            rows = rows.where(h < -(1 << 63) + (1 << 64) * (2 * class_rows + 1000) // sizes[of])
        return rows.orderBy(h, "candidate", "before").limit(class_rows).select("label", *FEATURES)
    return first(0.0).unionByName(first(1.0))


def scan(docs: DataFrame, class_rows: int = CLASS_ROWS) -> DataFrame:
    """(doc_id, position, candidate, score, is_secret) of every candidate of every document."""
    found = landed(featured(candidates(docs), dictionary(docs)), "candidates")
    sample = landed(training_sample(found, class_rows), "labelled")
    # At least one finding of every class that occurs is in the sample.
    classes = sorted(r["label"] for r in sample.select("label").distinct().collect())
    out = ["doc_id", "position", "candidate"]
    if len(classes) < 2:
        scored = found.withColumn("score", F.lit(classes[0] if classes else 0.0))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="__v")
        forest = RandomForestClassifier(featuresCol="__v", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        # Without its training summary, which holds the session (see operators/ml.py).
        model = forest.fit(vectors.transform(sample)).copy()
        scored = model.transform(vectors.transform(found)).withColumn(
            "score", vector_to_array("probability")[1])
    return scored.select(*out, "score", (F.col("score") >= 0.5).alias("is_secret"))
