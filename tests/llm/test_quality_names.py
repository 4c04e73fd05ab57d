"""The pipeline's quality stage on documents with a column of its own struct's name."""

import pytest
from pyspark.sql import functions as F

from foliant.llm import common, quality

from .test_operators import documents


@pytest.mark.parametrize("name", ["quality", "Quality"])
def test_keep_good_filters_beside_a_column_quality(spark, name):
    good = " ".join(f"word{i}" for i in range(40))
    docs = documents(spark, [good, "bad", good + " x", None]).withColumn(name, F.lit("mine"))
    out = common.kept_table(quality.keep_good(docs), "kept")
    assert out.columns == docs.columns
    assert {(r.doc_id, r[name]) for r in out.collect()} == {(0, "mine"), (2, "mine")}
