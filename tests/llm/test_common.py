import gc
import os
import weakref

import numpy as np
import pyarrow as pa
import pytest
from kindred.llm import common as C


def resident() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_a_task_gives_back_the_small_arrays_that_it_has_freed():
    before = resident()
    held = [np.ones(300) for _ in range(60_000)]
    pins = [np.ones(300) for _ in range(10)]  # what stands behind them keeps the heap up
    full = resident()
    del held
    C.give_back()
    assert full - before > 100 and resident() - before < 0.3 * (full - before) and len(pins) == 10


def test_tasks_of_other_operators_let_go_of_the_tokenizer(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from kindred.llm import minhash_dedup, packing, substring_dedup, toxicity

    docs = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"]})
    model = toxicity.fit([])
    for task in (
        lambda: list(substring_dedup._deal(12, 50)(iter([docs]))),
        lambda: substring_dedup._lean(lambda table: table)(pa.table({})),
        lambda: list(task_of(toxicity.keep_clean, model)(iter([docs]))),
        lambda: list(task_of(minhash_dedup.signatures)(iter([docs]))),
    ):
        path = public_tokenizers.path("word_bpe_49k.json")
        kept = weakref.ref(packing.tokenizer_at(path))
        assert kept() is packing.tokenizer_at(path)
        task()
        gc.collect()
        assert kept() is None


def task_of(operator, *args):
    """The function that the operator gives to mapInArrow."""

    class Docs:
        columns, schema = ["doc_id", "text"], None

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    return operator(Docs(), *args)
