"""Secret scan: candidate strings, and a random forest that removes false findings."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.llm.common import broadcast_if_small, kept, word_array

# A word with a run of at least so many of these characters, a digit among them, is a candidate; so is a key
# identifier of a known form, which may have none.
RUN = r"[A-Za-z0-9+/_\-]{12,}"
IDENTIFIER = r"AKIA[0-9A-Z]{16}"
#: The dictionary: words that are at least this share of all repeated words of the table, which bounds their
#: number by its inverse; and the length of the pieces compared.
DICTIONARY_SHARE = 1e-5
PIECE = 4
#: Labelled findings that the forest is trained on, by a hash of their document, at most so many of either label.
TRAIN_ROWS = 2000
TREES = 20
DEPTH = 6
HASH_BUCKETS = 16
KEEP_SCORE = 0.5
NAMES = r"(?i)(pass(word|wd)?|secret|token|api.?key|access.?key|credential|auth|private)"
# Findings labelled true: formats of issued keys, and what is assigned to a telling name, by "=" or ":", quoted or not,
# in JSON or behind a header's scheme.
ISSUED = r"^(AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,})$"
ASSIGNED = NAMES + r"""[A-Za-z_\-]*["']?\s*[:=]+>?\s*((bearer|basic|token)\s+)?["']?$"""
# Findings labelled false: plain numbers, parts of web addresses, and what is said to be a checksum or a revision.
NUMBER = r"^[0-9+/_\-]+$"
ADDRESS = r"(?i)(https?:|www[.])"
CHECKSUM = r"(?i)(commit|revision|checksum|digest|etag|uuid|md5|sha-?[0-9]*)[^A-Za-z0-9]*$"


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = "source") -> DataFrame:
    """(doc, at, offset, candidate, word, before, after, path): every candidate with the words around it.

    ``at`` counts the text's words from 0, ``offset`` the word's characters. Of a word with several candidates
    each has its own part in ``word``: from the end of the one before to its own end, the last to the word's end.
    """
    rows = docs.select(F.col(key).alias("doc"), (F.col(path) if path else F.lit("")).cast("string").alias("path"), word_array(F.col(text)).alias("w"))
    each = rows.select("doc", "path", "w", F.posexplode("w").alias("at", "word")).where(F.length("word") >= 12)
    runs = F.regexp_extract_all("word", F.lit(rf"((?=[A-Za-z+/_\-]*[0-9]){RUN}|{IDENTIFIER})"), F.lit(1))
    each = each.withColumn("runs", runs).where(F.size("runs") > 0)
    # A run's text cannot stand earlier behind the run before: it would have been found there. Positions count from 1.
    place = lambda done, run: F.call_function("locate", run, F.col("word"), done["end"])
    step = lambda done, run: F.struct((place(done, run) + F.length(run)).alias("end"), F.array_append(done["starts"], place(done, run)).alias("starts"))
    none = F.struct(F.lit(1).alias("end"), F.array().cast("array<int>").alias("starts"))
    each = each.withColumn("starts", F.aggregate("runs", none, step)["starts"])
    last = lambda i: i + 1 == F.size("runs")
    begin = lambda i: F.when(i == 0, 1).otherwise(F.get("starts", i - 1) + F.length(F.get("runs", i - 1)))
    end = lambda i, run: F.when(last(i), F.length("word") + 1).otherwise(F.get("starts", i) + F.length(run))
    part = lambda run, i: F.struct((F.get("starts", i) - 1).alias("offset"), run.alias("candidate"), F.substring("word", begin(i), end(i, run) - begin(i)).alias("part"))
    each = each.select("doc", "path", "w", "at", F.explode(F.transform("runs", part)).alias("r"))
    each = each.select("doc", "path", "w", "at", "r.offset", "r.candidate", F.col("r.part").alias("word"))
    near = lambda i: F.coalesce(F.try_element_at("w", i), F.lit(""))
    # try_element_at counts from 1, and from the end below 0.
    before = [F.when(F.col("at") >= n, near(F.greatest(F.col("at") + 1 - n, F.lit(1)))).otherwise("") for n in (2, 1)]
    return each.select("doc", "at", "offset", "candidate", "word", F.concat_ws(" ", *before).alias("before"), near(F.col("at") + 2).alias("after"), F.coalesce("path", F.lit("")).alias("path"))


def dictionary_pieces(docs: DataFrame, text: str = "text", share: float = DICTIONARY_SHARE) -> DataFrame:
    """Pieces of the common words of letters of all texts; at most ``1 / share`` words give them."""
    each = docs.select(F.explode(word_array(F.lower(F.col(text)))).alias("w")).where(F.col("w").rlike(r"^\p{L}{4,12}$"))
    repeated = kept(each.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"))
    least = (repeated.agg(F.sum("n").alias("n")).first()["n"] or 0) * share
    return repeated.where(F.col("n") >= least).select(F.explode(pieces(F.col("w"))).alias("piece")).distinct()


def pieces(word: Column) -> Column:
    """All runs of a few characters within a word."""
    last = F.length(word) - PIECE + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(word, i, F.lit(PIECE)))).otherwise(F.array().cast("array<string>"))


def features(found: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, list[str]]:
    """The candidates with their numeric features, and the features' names."""
    c = F.col("candidate")
    chars = F.split(c, "")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / F.length(c)
    bucket = lambda x: F.pmod(F.xxhash64(F.lower(x)), F.lit(HASH_BUCKETS)).cast("double")
    named = {
        "length": F.length(c).cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share(r"[+/_\-]"),
        "to_digit": share("(?<=[A-Za-z])(?=[0-9])"),
        "to_letter": share("(?<=[0-9])(?=[A-Za-z])"),
        "case_changes": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "distinct": F.size(F.array_distinct(chars)) / F.size(chars),
        "hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "whole_word": (F.length("word") == F.length(c)).cast("double"),
        "quoted": F.col("word").rlike("""["']""").cast("double"),
        "in_path": F.col("word").rlike("(https?:|/.*/|[.][a-z]{2,4}$)").cast("double"),
        "path_kind": F.col("path").rlike("(?i)(test|example|doc|fixture|sample)").cast("double"),
        "path_bucket": bucket(F.regexp_extract("path", r"([^./]*)$", 1)),
        # Words that stand before: in the candidate's own word, next to it, and one further off.
        "own_bucket": bucket(F.regexp_extract(own_lead(), r"([A-Za-z_]+)[^A-Za-z_]*$", 1)),
        "mark_bucket": bucket(F.regexp_extract(lead(), r"([^A-Za-z0-9]*)$", 1)),
        "before_bucket": bucket(F.regexp_extract("before", r"([^A-Za-z]*|[A-Za-z]*[^A-Za-z]*)$", 1)),
        "far_bucket": bucket(F.regexp_extract("before", r"([A-Za-z_]+)[^A-Za-z_]*$", 1)),
        "after_bucket": bucket(F.col("after")),
    }
    rows = found.withColumns(named)
    # Dictionary coverage: the share of the candidate's pieces that the dictionary's words have.
    own = found.select("candidate").distinct()
    each = own.select("candidate", F.explode(pieces(F.lower("candidate"))).alias("piece"))
    known = each.join(broadcast_if_small(dictionary.withColumn("known", F.lit(1)), 40), "piece", "left")
    covered = known.groupBy("candidate").agg((F.count("known") / F.count("*")).alias("covered"))
    return rows.join(covered, "candidate", "left").fillna({"covered": 0.0}), [*named, "covered"]


def own_lead() -> Column:
    """What stands before the candidate in its own word."""
    return F.call_function("substring_index", F.col("word"), F.col("candidate"), F.lit(1))


def lead() -> Column:
    """What stands before the candidate: two words, and the begin of its own."""
    return F.concat_ws(" ", "before", own_lead())


def rule_labels(found: DataFrame) -> DataFrame:
    """The findings that a rule decides, with a ``label``; others are left out.

    Stands in for a reviewers' table of labelled findings where there is none. The names, assignments and formats
    that the rules look at are no features: the forest knows findings by their characters, pieces and neighbours.
    """
    true = F.col("candidate").rlike(ISSUED) | lead().rlike(ASSIGNED)
    false = F.col("candidate").rlike(NUMBER) | F.col("word").rlike(ADDRESS) | lead().rlike(CHECKSUM)
    return found.withColumn("label", F.when(true, 1.0).when(false, 0.0)).where("label is not null")


def fit(labelled: DataFrame, names: list[str], rows: int = TRAIN_ROWS) -> RandomForestClassificationModel | None:
    """A forest for findings with a ``label``; none if there are no two kinds of them."""
    parts = [labelled.where(F.col("label") == x).orderBy(F.xxhash64("doc", "at", "offset", "candidate"), "doc", "at", "offset").limit(rows) for x in (0.0, 1.0)]
    some = kept(parts[0].union(parts[1]).select("label", *names).coalesce(1))
    if some.select("label").distinct().count() < 2:
        return None
    some = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(some)
    return RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(some)


def scan(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    text: str = "text",
    key: str = "doc_id",
    path: str | None = "source",
    keep_score: float = KEEP_SCORE,
) -> DataFrame:
    """(key, word_at, offset, candidate, score, secret): every candidate of every whole text and the forest's verdict.

    The forest is trained on ``labelled`` findings (columns of ``candidates`` and ``label``); without these, on
    the findings in ``docs`` that a rule decides, at most ``TRAIN_ROWS`` of either label. Features are length,
    kinds of characters and their changes, the share of pieces of common words, the path, and the words
    around. Without two kinds of labels every candidate is kept with score 1.

    A candidate has a digit, or the form of a known key identifier: passwords of letters alone are never findings.
    Null and empty texts have no candidates; a text is read whole, however long. Rows without a key are scanned too.
    Repeated rows give repeated findings; other columns are not read; no rows give no rows.
    """
    found = kept(candidates(docs, text, key, path))
    dictionary = kept(dictionary_pieces(docs, text))
    rows, names = features(found, dictionary)
    rows = kept(rows)
    trained = rule_labels(rows) if labelled is None else features(labelled, dictionary)[0]
    model = fit(trained, names)
    if model is None:
        scored = rows.withColumn("score", F.lit(1.0))
    else:
        scored = model.transform(VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(rows))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.select(F.col("doc").alias(key), F.col("at").cast("bigint").alias("word_at"), F.col("offset").cast("bigint").alias("offset"), "candidate", "score", (F.col("score") >= keep_score).alias("secret"))
