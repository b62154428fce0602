"""Methods seen in plans and tables: sorted runs, bounded draws, labels by rule, the first tier of token lengths."""

import random

import pytest
from pyspark.sql import functions as F

from teleloom.llm import exact_dedup, mixing, secret_scan, token_counts
from teleloom.llm.queries import tokenizer_path


def test_runs_are_merged_in_order(spark):
    rows = [(i, f"text {i % 7}") for i in range(100)] + [(None, "text 1"), (None, "alone"), (5, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    digests = exact_dedup.digests(docs)
    level = exact_dedup.merge_runs(exact_dedup.leaf_runs(digests, "doc_id"), 16)
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan and "Python" not in plan
    once = exact_dedup.merge_runs(level, 16)
    assert once.select("digest").distinct().count() == once.count() == 9
    for fan_in in (2, 3, 256):
        got = exact_dedup.exact_duplicates(docs, fan_in=fan_in)
        keeps = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()}
        assert (None, 1, 16, False) in keeps and (None, None, 1, True) in keeps and (5, 4, 2, False) in keeps and got.count() == len(rows)


def test_a_tiny_source_in_a_large_mix(spark):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("big").alias("source"), F.lit(1).alias("_n"), F.lit(2).alias("_cdf"), F.lit(3).alias("_draws"))
    docs = docs.unionByName(spark.createDataFrame([(-1, "tiny", 1, 2, 3), (-2, None, 1, 2, 3)], "doc_id long, source string, _n int, _cdf int, _draws int"))
    law = mixing.poisson_table(mixing.repetition_rates(docs, None, None, "source")).collect()
    assert max(len(r["_cdf"]) for r in law) < mixing.DRAW_COPIES and {r["_draws"] for r in law} == {1, 131}
    mixed = mixing.mix_sources(docs)
    assert sorted(mixed.columns) == sorted([*docs.columns, "copy", "shuffle_key"])
    counts = {r.source: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    third = 200_002 / 3
    assert all(abs(counts[s] - third) < 5 * third**0.5 for s in ("big", "tiny", None))
    assert mixed.select("doc_id", "copy").distinct().count() == mixed.count()
    assert mixed.agg(F.min("copy")).first()[0] == 1
    again = mixing.mix_sources(docs.repartition(3))
    assert mixed.select("doc_id", "copy").exceptAll(again.select("doc_id", "copy")).isEmpty()


def planted(r, i):
    """A finding in one of the forms, and whether it is a secret; the last three forms are labelled by no rule."""
    hexa = "".join(r.choice("0123456789abcdef") for _ in range(40))
    mixed = "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(30)) + "7"
    number = "".join(r.choice("0123456789") for _ in range(16))
    return [
        (["password:", mixed], True),
        (['{"token":"' + mixed + '"}'], True),
        (["Authorization:", "Bearer", mixed], True),
        (["secret", "=", f'"{hexa}"'], True),
        (["card", number], False),
        (["see", f"https://example.com/{r.randrange(1990, 2030)}/report-{r.randrange(10**6)}"], False),
        (["commit", hexa], False),
        (["sid", "cookie", mixed], True),
        (["phone", number[:13]], False),
        (["volume", f"chapter-{r.randrange(10, 99)}-of-the-book"], False),
    ][i % 10]


def test_forest_on_planted_findings(spark):
    r = random.Random(11)
    words = ["the", "report", "chapter", "volume", "book", "river", "stone", "garden", "window", "letter"]
    rows, wanted = [], []
    for i in range(600):
        form, secret = planted(r, i)
        rows.append((i, " ".join([*r.choices(words, k=8), *form, *r.choices(words, k=5)])))
        wanted.append(secret)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("web")).repartition(4)
    labels = {x.doc: x.label for x in secret_scan.rule_labels(secret_scan.candidates(docs)).collect()}
    assert all(labels.get(i) == (float(wanted[i]) if i % 10 < 7 or i % 10 == 8 else None) for i in range(600))
    found = {}
    for x in secret_scan.scan(docs).collect():
        found[x.doc_id] = found.get(x.doc_id, False) or x.secret
    hit = sum(found[i] and wanted[i] for i in range(600))
    precision, recall = hit / sum(found.values()), hit / sum(wanted)
    print(f"precision {precision:.3f}, recall {recall:.3f}", {k: sum(found[i] for i in range(k, 600, 10)) for k in range(10)})
    assert precision >= 0.95 and recall >= 0.95


def test_first_tier_holds_the_commonest_words_of_all_texts(spark):
    rows = [(i, "early words here") for i in range(600)] + [(600 + i, f"late late late word{i}") for i in range(600)] + [(2000, None), (2001, ""), (2002, "a\0b a\0b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    top = token_counts.frequent_words(docs, "text", 0.05)
    assert top == [" early", " here", " late", " words"]
    assert token_counts.frequent_words(docs.limit(0), "text") == []
    tier = token_counts.FirstTier(top, [1, 2, 3, 4])
    assert tier.opened() == dict(zip(top, [1, 2, 3, 4], strict=True)) and token_counts.FirstTier([], []).opened() == {}
    library = token_counts.load_encoder(tokenizer_path())
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark, docs, tokenizer_path()).collect()}
    assert got == {i: len(library.encode(t or "")) for i, t in rows}


@pytest.mark.parametrize("text", ["x" * 70_000, "late " * 30_000, "▁ ▁▁a  b "])
def test_token_counts_of_odd_texts(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    library = token_counts.load_encoder(tokenizer_path())
    assert token_counts.token_counts(spark, docs, tokenizer_path()).first()["n_tokens"] == len(library.encode(text))
