import numpy as np
import pytest
from pyspark.sql import functions as F

from daymosaic.llm import lm


@pytest.mark.parametrize("turn", [0, 1])
def test_every_position_is_learnt(spark, docs_of, turn):
    """Texts of one round whose odd and even places hold different words (the end makes their number even)."""
    ids = spark.range(200).where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("round")), F.lit(2)) == turn)
    docs = docs_of([(r["id"], "left right " * 200 + "left") for r in ids.collect()])
    v = lm.Vocabulary(lm.count_words(docs, "text"), docs.count())
    model = lm.train(docs, "doc_id", "text", v)
    left, right = v.units_of([b"left", b"right"])[0].tolist()
    context = np.array([[right, left, right], [left, right, left]], np.int32)
    after = 10 ** lm.Model(v.units, model.flat).log10_probability(context, np.array([left, right]))
    assert after.min() > 0.5, after
