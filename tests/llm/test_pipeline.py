"""The whole pipeline against plain versions of its stages over the smallest tables."""

from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import decontam, oracles
from quarry.llm.queries import tokenizer_path
from tests.compare import duck
from tests.conftest import SF
from tests.llm.test_near_dup import brute as near
from tests.llm.test_packing import check


def without_shared_lines(docs):
    white, holders = " \t\n\x0b\x0c\r", defaultdict(set)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(white).translate(lower)
    for d, t in docs:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    keep = lambda d, line: len(holders[key(line)]) < 5 or d == max(holders[key(line)])
    return [(d, "\n".join(line for line in t.split("\n") if keep(d, line))) for d, t in docs]


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    good = {d for d, kept in duck(SF).execute(f"SELECT doc_id, kept FROM ({oracles.OP8})").fetchall() if kept}
    plain = [(d, t) for d, t in plain if d in good]
    plain = without_shared_lines(plain)
    groups = near(plain)
    plain = [(d, t) for d, t in plain if groups[d][0] == d]
    items = [decontam.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def clean(text):
        text = decontam.normalise(text)
        return not any(decontam.myers(i, text)[0] <= decontam.budget_of(len(i), 0.1, 40) for i in items if i)

    plain = [(d, t) for d, t in plain if clean(t)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == corpus_pipeline.COLUMNS
    got = docs.orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == plain and all(r.n_chars == len(r.text) for r in got)
    rows = corpus_pipeline.run(spark, SF).collect()
    check(rows, plain, Tokenizer.from_file(tokenizer_path()))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "word " * 200, "en", "s", 1000)]])
def test_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() <= max(1, len(rows))
