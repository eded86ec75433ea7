"""The bounded training sample of the quality classifier: long texts, labels without text, copies of a labelled document."""

import random

import pytest
from pyspark.sql import functions as F

from tapestudy.llm import mil


@pytest.fixture
def fitted(monkeypatch):
    seen = []
    monkeypatch.setattr(mil.GatedAttention, "fit", lambda self, bags, labels: seen.append((bags, labels)) or self)
    return seen


def test_sample_goes_past_long_texts(spark, fitted):
    r = random.Random(2)
    ids = [x.id for x in spark.range(200).orderBy(F.xxhash64("id"), "id").collect()]
    texts = {i: " ".join(str(r.randrange(50)) for _ in range(60)) for i in ids}
    texts[ids[1]] = "long " * (64 * 300)  # second in order, alone beyond the bound
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(10_000 + i, 1) for i in range(300)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    mil.train(docs, labels, max_documents=200, max_passages=250)
    bags, marks = fitted[-1]
    assert len(bags) == 199 and len(marks) == 199
    mil.train(docs, labels, max_documents=200, max_passages=20)
    assert len(fitted[-1][0]) == 20


def test_copies_of_a_labelled_document_count_once(spark, fitted):
    docs = spark.createDataFrame([(1, "a b c")] * 50 + [(1, "other"), (2, None), (3, "x " * 10)], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    mil.train(docs, labels)
    assert len(fitted[-1][0]) == 3
    assert mil.train(docs, labels.limit(0)) is None and mil.train(docs.limit(0), labels) is None


def test_long_texts_are_counted_in_pieces():
    words = [str(i % 977) for i in range(1024 * 64 + 130)]
    whole = mil.bag(" ".join(words))
    assert whole.shape == (1027, mil.WIDTH) and int(whole.sum()) == 2 * len(words)
    assert (whole[1024] == mil.bag(" ".join(words[1024 * 64:]))[0]).all() and mil.bag("").shape == (1, mil.WIDTH)
