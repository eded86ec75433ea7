"""What tasks hold at once: few rows as Python objects, no tables of the operator before."""

import random

import pyarrow as pa
import pytest

from tapestudy.llm import common, mil, neardup, substring


class Caught:
    """In place of a DataFrame: gives the function that Spark would run in the tasks."""

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("job", [substring._compact, lambda d: substring._level_one(d, substring._Sizes(50)), neardup._sketches])
def test_texts_in_slices(job):
    r = random.Random(3)
    texts = [" ".join(str(r.randrange(900)) for _ in range(60)) for _ in range(2000)]
    batch = pa.record_batch({"doc_id": list(range(2000)), "text": texts})
    mil.bag("words that the classifier keeps")
    assert mil._known
    out = list(job(Caught())([batch]))
    assert max(b.num_rows for b in out) <= 512 and [x for b in out for x in b.column("doc_id").to_pylist()] == list(range(2000))
    assert not mil._known


def test_slices_keep_rows():
    batches = [pa.record_batch({"x": list(range(n))}) for n in (0, 1, 512, 513)]
    got = list(common.slices(batches))
    assert [b.num_rows for b in got] == [1, 512, 512, 1]


def test_cut_reads_texts_once(spark):
    """One join takes the texts to what goes from them; rows that lose nothing come through as they were."""
    r = random.Random(4)
    passage, own = (" ".join(str(r.randrange(10**6)) for _ in range(n)) for n in (70, 20))
    rows = [(1, passage, None), (2, passage, "x"), (3, f"{own}  {passage}\n{own} ", "y"), (4, None, None), (5, "", "z"), (5, " \t", "z"), (None, passage, "w"), (6, " a\nb ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra string")
    out = substring.remove_repeated(df)
    same = [x for x in rows if x[0] not in (2, 3)]
    got = sorted((tuple(x) for x in out.collect()), key=str)
    assert got == sorted([*same, (3, f"{own}  {own}", "y")], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and out.columns == df.columns
