"""Documents that share an id, rows that repeat, and columns named like those that operators make."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import minhash, substring

WORDS = "the of and stone river light morning quiet paper garden window letter copper silver walking under between seven".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "ly", "er", "s"]) for _ in range(n))


def test_any_text_of_a_document_links_it(spark):
    a, b, c = prose(1, 100), prose(2, 100), prose(3, 100)
    rows = [(1, a), (1, b), (2, b + " more"), (3, c), (3, ""), (4, prose(4, 100)), (4, ""), (5, None), (5, c + " end"), (6, "word")]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (5, 3), (4, 4), (6, 6)}
    again = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame([(d, t) for d, t in reversed(rows)], "doc_id long, text string")).collect()}
    assert again == got


def test_rows_that_repeat_id_and_text_stay_once(spark):
    a = prose(1, 60)
    rows = [(1, a), (1, a), (1, "another text of the first"), (2, a), (3, "alone"), (None, "no id"), (None, "no id"), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("count", F.lit(1))
    got = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()))
    assert got == sorted([(1, a), (1, "another text of the first"), (3, "alone"), (0, "no id"), (0, "no id"), (7, "")])


def test_columns_may_have_any_name(spark):
    a = prose(5, 40)
    rows = [(1, a, 10, "m", 1.5, 7, "x"), (2, f"{a} tail", 20, "n", None, 8, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _MARK string, _places double, _id_ int, n_chars string").drop("n_chars")
    got = substring.remove_repeats(docs, 20)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, a, 10, "m", 1.5, 7), (2, "tail", 20, "n", None, 8)]
