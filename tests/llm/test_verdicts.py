"""The removing operators on rows without keys, repeated rows and keys that stand for several texts."""

from collections import Counter

import pytest

from teleloom.llm import decontamination, exact_dedup, simhash_dedup

A = " ".join(f"a{i}" for i in range(40))
UNIQUE = " ".join(f"u{i}" for i in range(40))
B = " ".join(f"b{i}" for i in range(40))
ROWS = [(1, A), (2, A), (2, UNIQUE), (None, A), (9, B), (9, B)]
CLASHING = "_n long, _u string, _cdf string, _source string, _gone long, _k long, _c string, _good int, identity string, _identity string, id long, node long, component long"


def frame(spark, rows):
    extra = (5, "u", "c", "s", 6, 7, "c", 1, "i", "j", 8, 9, 10)
    return spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, " + CLASHING).repartition(3)


def left(result):
    return Counter((x.doc_id, x.text) for x in result.collect())


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash_dedup.drop_near_duplicates])
def test_one_row_of_each_group_stays(spark, drop):
    docs = frame(spark, ROWS)
    got = drop(docs)
    assert got.columns == docs.columns
    assert left(got) == Counter([(1, A), (2, UNIQUE), (9, B)])
    assert {x._gone for x in got.collect()} == {6} and {x.identity for x in got.collect()} == {"i"}


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash_dedup.drop_near_duplicates])
def test_rows_without_any_key(spark, drop):
    rows = [(None, A), (None, A), (None, UNIQUE), (None, None), (None, ""), (4, UNIQUE)]
    got = left(drop(frame(spark, rows)))
    assert got[(None, A)] == 1 and got[(4, UNIQUE)] == 1 and got[(None, UNIQUE)] == 0
    assert got[(None, None)] + got[(None, "")] == 1 and sum(got.values()) == 3


def test_a_fingerprint_of_rows_without_keys_ties_others(spark):
    """The middle one of a chain of three fingerprints has no key."""
    distinct = spark.createDataFrame([(0b0, 0b0), (0b1111, 0b1111), (0b11111111, 0b11111111)], "fp long, node long")
    from teleloom.llm.common import components

    tied = {x.node: x.component for x in components(simhash_dedup.links(distinct, 4)).collect()}
    assert tied == {0b1111: 0, 0b11111111: 0}


def test_leaks_are_judged_text_by_text(spark):
    items = spark.createDataFrame([(1, A)], "item_id long, text string")
    rows = [(2, "so " + A), (2, UNIQUE), (None, A + " end"), (None, B), (3, A), (3, A), (5, None)]
    docs = frame(spark, rows)
    got = decontamination.drop_contaminated(docs, items)
    assert got.columns == docs.columns
    assert left(got) == Counter([(2, UNIQUE), (None, B), (5, None)])
    assert {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, items).collect()} == {(2, 1), (None, 1), (3, 1)}


def test_pairs_that_differ_in_many_bits_are_found(spark):
    """Windows of similarity just above 0.8 are verified, whatever their fingerprints' distance."""
    import random

    import plain

    r = random.Random(1)
    items = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(60))) for i in range(150)]
    rows = []
    for i, t in items:
        ws = t.split()
        for j in (r.randrange(5, 25), r.randrange(35, 55)):
            if r.random() < 0.5:
                ws[j] = "other"
        rows.append((i, " ".join(ws)))
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    wanted = plain.leaks(rows, items)
    assert {(x.doc_id, x.item_id): x.similarity for x in got.collect()} == {k: v[0] for k, v in wanted.items()} and len(wanted) > 100
