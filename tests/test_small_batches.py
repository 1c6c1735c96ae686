"""Functions of texts hold few rows at once; runs of words that are no names are not shuffled."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from datalode.functions import names as N
from datalode.functions import text as X
from datalode.operators import parse as P
from datalode.operators import retrieval as R


class Rows:
    """A table of 3,000 rows whose mapInArrow runs here, on one batch."""

    def __init__(self, df):
        self.schema, self.columns = df.schema, df.columns

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        kinds = {"long": pa.int64(), "string": pa.string()}
        columns = [pa.array([f"<p>w{i} @a</p>" if f.dataType.typeName() == "string" else i for i in range(3000)], kinds[f.dataType.typeName()]) for f in self.schema]
        return list(run(iter([pa.RecordBatch.from_arrays(columns, names=self.columns)])))


@pytest.mark.parametrize("step", [lambda r: R.embedded(r, 64), lambda r: X.entities(r, detect=lambda texts: [[("X", 0, 1)] for _ in texts]), lambda r: P.html_elements(r, "id", "text")])
def test_texts_are_taken_in_small_batches(spark, step):
    out = step(Rows(spark.createDataFrame([], "id long, text string")))
    assert max(b.num_rows for b in out) <= 500 and sum(b.num_rows for b in out) == 3000
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(3000))


def test_runs_that_are_no_names_are_left_out_first(spark, monkeypatch):
    known = spark.createDataFrame([(f"name {i}",) for i in range(50)], "gram string")
    runs = spark.createDataFrame([(i, f"name {i}") for i in range(2000)], "i int, gram string")
    left = {r["i"] for r in N.may_be_names(runs, known).collect()}
    assert set(range(50)) <= left and len(left) < 60
    monkeypatch.setattr(N, "SLOTS", 8)  # others in the slots of names are told apart by the join
    texts = spark.createDataFrame([(1, "a name 7, name 70 and name 8"), (2, "none")], "doc_id int, text string")
    got = N.without_names(texts, known.where("gram in ('name 7', 'name 8')").select(F.col("gram").alias("name"))).orderBy("doc_id").collect()
    assert [(r["redacted"], r["n_names"]) for r in got] == [("a <PERSON>, name 70 and <PERSON>", 2), ("none", 0)]
