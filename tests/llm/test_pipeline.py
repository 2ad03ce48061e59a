"""The pipeline's stages against plain Python, each on its own input, and the whole of run()."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SMALL
from tests.llm.test_duplicates import WORD, groups, struck
from tests.llm.test_native import leaks, measured, mixed

SF = SMALL


def rows(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """The tables between the stages."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in P.STAGES:
        out.append(P.written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stage_columns_and_names(stages):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "decontamination", "mixing"]
    assert all(t.columns == stages[0].columns and t.schema["doc_id"].dataType == stages[0].schema["doc_id"].dataType for t in stages[1:-1])


def test_quality_keeps_the_ledgers_verdict(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) <= {i for i, r in before.items() if not measured(r.text)[5]}
    clean = {i for i, r in before.items() if not measured(r.text)[5] and measured(r.text)[2] == 0 and sum(c.isupper() for c in r.text) < 0.2 * len(r.text) and measured(r.text)[3] == 0 and measured(r.text)[4] == 0}
    words = {i: WORD.findall(before[i].text) for i in clean}
    assert {i for i in clean if sum(a == b for a, b in zip(words[i], words[i][1:])) < 0.3 * len(words[i])} <= set(after)
    assert all(after[i] == before[i] for i in after)


def test_one_document_of_each_group(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert set(after) == {c for _, c in groups([(i, r.text) for i, r in before.items()])} and all(after[i] == before[i] for i in after)


def test_passages_go(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = {i: (n, gone) for i, n, gone, _ in struck([(i, r.text) for i, r in before.items()])}
    assert set(after) == {i for i, (n, gone) in want.items() if gone < n or not gone}
    for i, r in after.items():
        n, gone = want[i]
        assert r.text == before[i].text if not gone else len(WORD.findall(r.text)) == n - gone and r.n_chars == len(r.text)


def test_leaks_go(spark, stages):
    before, after = rows(stages[3]), rows(stages[4])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == set(before) - {d for d, _ in leaks([(i, r.text) for i, r in before.items()], items)}


def test_mix_meets_its_targets(stages):
    before, mix = rows(stages[4]), stages[5].collect()
    sizes, taken, used = defaultdict(int), defaultdict(int), Counter()
    for r in before.values():
        sizes[r.source] += len(WORD.findall(r.text))
    for r in mix:
        taken[r.source] += r.n_words
        used[r.doc_id] += r.n_words
        assert r.text.split(" ") == WORD.findall(before[r.doc_id].text)[r.start : r.start + r.n_words]
    assert all(abs(taken[s] - t) <= 1 for s, t in mixed(sizes).items()) and all(n <= 2 * len(WORD.findall(before[i].text)) for i, n in used.items())


def test_run_gives_the_last_stage(spark, stages):
    assert Counter(map(tuple, P.run(spark, SF).collect())) == Counter(map(tuple, stages[-1].collect()))


def test_stages_on_odd_tables(spark, docs):
    """Empty tables, and null texts, sources and ids, through all stages."""
    good = " ".join(f"w{i}" for i in range(60))
    odd = docs((1, None, None), (2, "", "s"), (None, good, None), (3, good, None), (3, good, None), (4, good + " more words here", "t"), (5, "x " * 30000, "s"), (6, " ".join(f"v{i}" for i in range(40)), None))
    for table in (odd.limit(0), odd.withColumn("key", F.lit(1)).withColumn("row", F.lit("r"))):
        at = table
        for _, stage in P.STAGES[:-1]:
            at = P.written(stage(spark, at, SF), "test-odd")
            assert at.columns == table.columns
        P.STAGES[-1][1](spark, at, SF).collect()
