"""An executor keeps as many Python workers as ever ran at a time: one for each core is enough."""

import random

import numpy as np
import pytest

from sentilake.llm import jaccard_join, packing, suffix_dedup


def without_exchange(plan, above=False):
    """Whether a Python step reads another one's rows in the same task."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return without_exchange(plan.executedPlan(), above)
    if plan.nodeName().endswith("QueryStage"):
        return without_exchange(plan.plan())
    python = plan.nodeName() == "MapInArrow"
    if python and above:
        return True
    above = (above or python) and "Exchange" not in plan.nodeName()
    return any(without_exchange(plan.children().apply(i), above) for i in range(plan.children().size()))


@pytest.mark.parametrize("module,run", [(suffix_dedup, lambda d: suffix_dedup.kept_texts(d, words=51)), (jaccard_join, jaccard_join.link_sets), (packing, packing.pack)])
def test_one_worker_for_each_core(spark, rows, monkeypatch, module, run):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdef") * rnd.randint(1, 9) for _ in range(150)) for _ in range(12)]
    long = " ".join(str(rnd.randint(0, 10**6)) for _ in range(6000))
    docs = rows([(i, t) for i, t in enumerate([*texts, *(t + " more" for t in texts), long, long])], "doc_id long, text string")
    staged, stage = [], module.stage

    def recorded(df, name):
        df.collect()  # the plan is the one that ran in the end
        staged.append(df)
        return stage(df, name)

    monkeypatch.setattr(module, "stage", recorded)
    for df in [run(docs), *staged]:
        plan = df._jdf.queryExecution().executedPlan()
        assert not without_exchange(plan)
        small = [x for x in plan.toString().splitlines() if "Scan ExistingRDD" in x and "doc_id" not in x]
        assert not [x for x in small if "least" in x or "sequence" in x]


def test_columns_take_little_more_than_they_hold():
    import tracemalloc

    m, span = 20_000, 240
    rnd = np.random.default_rng(1)
    size = rnd.integers(0, span + 1, m)
    offsets = np.cumsum(size) - size
    data = rnd.integers(0, 255, size.sum()).astype(np.uint8)
    tracemalloc.start()
    right = suffix_dedup._columns(data, offsets, 0, size, span, 1)
    assert tracemalloc.get_traced_memory()[1] < 2 * m * span
    tracemalloc.stop()
    left = suffix_dedup._columns(data, offsets, size - 1, size, span, -1)
    for i in range(0, m, 997):
        part = data[offsets[i] : offsets[i] + size[i]]
        assert right[: size[i], i].tolist() == part.tolist() and left[: size[i], i].tolist() == part[::-1].tolist()
        assert (right[size[i] :, i] == suffix_dedup.END).all() and (left[size[i] :, i] == suffix_dedup.END).all()
