"""What workers hold: an executor's JVM keeps its heap, so they have little room in a long pipeline."""

import numpy as np
import pyarrow as pa
import pytest

from daymosaic.llm import tokenout, toxicity


class Alone:
    """Stands for a table: runs a map over one batch in this process, as a worker would."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    def groupBy(self, *_):
        return self

    def agg(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.out = pa.Table.from_batches(run([self.batch]))
        return self

    def toArrow(self):
        return self.out


def test_toxicity_drops_the_chunks_that_tokens_left(spark):
    class Sent:
        value = toxicity.Numbered({"word": 0, "other": 1})

    path = tokenout.default_tokenizer()
    first = tokenout.cache_for(path)
    ids = first.encode(pa.array(["word and word"]))[0].tolist()
    assert tokenout.cache_for(path) is first  # tasks of one operator share it
    df, total = toxicity.document_frequencies(Alone(pa.record_batch({"text": ["word and word", None, "Other word"]})), Sent, "text")
    assert (df.tolist(), total) == ([2, 1], 3)
    assert not tokenout._caches
    again = tokenout.cache_for(path)
    assert again is not first and again.encode(pa.array(["word and word"]))[0].tolist() == ids


def test_the_token_table_needs_no_python_workers(spark, docs_of, tmp_path, monkeypatch):
    def parallelize(*_):
        raise AssertionError("rows go through Python workers of their own")

    docs = docs_of([(i, "some words " * i) for i in range(5)])
    docs.count()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    assert tokenout.token_output(docs, tokenout.default_tokenizer(), tmp_path.as_uri()).count() == 5


@pytest.mark.parametrize("n", [5, 127, 128, 129, 3000])
def test_lists_of_the_index_are_narrow(n):
    """At most 26 bytes an entry up to 32,767 examples, and places at a type's end are kept."""
    rng = np.random.default_rng(n)
    examples = [(np.sort(rng.choice(20 * n, 40, replace=False)), np.full(40, 40**-0.5)) for _ in range(n)]
    index = toxicity.BlockMaxIndex(examples, 20 * n)
    lists = (index.who, index.weight, index.first, index.many, index.block, index.ceiling)
    assert sum(x.nbytes for x in lists) <= 26 * 40 * n
    for i in {0, n // 2, n - 1}:
        who, cosine, _ = index.nearest(*examples[i])
        assert who[0] == i and cosine[0] == pytest.approx(1)


def test_narrow_types_hold_their_greatest_number():
    for most in (0, 1, 127, 128, 32_767, 32_768, 2**31 - 1, 2**31):
        assert toxicity.signed(np.array([0, most]), most).tolist() == [0, most]
