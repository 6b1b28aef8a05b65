"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import pytest
from oracle import compare, connect
from workload.base import Query

import corpus_pipeline
from panelloom import llm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_matches_sql(spark, con, name):
    problems, _ = compare(spark, con, Query(llm.QUERIES[name], llm.ORACLES.get(name), "llm"), SF)
    assert not [p for p in problems if p != "no rows"], problems


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {r.doc_id for r in out}
    assert out
    assert ids <= set(texts) and all(texts[r.doc_id] == r.text for r in out)

    def shingles(text):
        import re

        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {i: shingles(texts[i]) for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a]:
                assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        item = shingles(r.text)
        assert not any(100 * len(item & s) >= 80 * len(item) for s in sets.values())
    assert out[0].__fields__[: len(docs.columns)] == docs.columns
