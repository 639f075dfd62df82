"""The operators with SQL against it, on the supplied tables and on harder ones."""

import os
import random

import pytest

pytest.importorskip("public_tokenizers")

from cairn.llm import queries, quality  # noqa: E402
from tests.oracle import DATA, expected, rows  # noqa: E402

from .test_jaccard import corpus  # noqa: E402


def compare(spark, name, folder):
    got, want = queries.queries()[name](spark, folder).toPandas(), expected(queries.oracle_sql()[name], folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_supplied_tables(spark, name):
    compare(spark, name, DATA)


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string").toPandas().to_parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").toPandas().to_parquet(f"{folder}/labels.parquet")


def test_jaccard_groups_and_passages(spark, tmp_path):
    write(spark, tmp_path, [(k, t, "en") for k, t in corpus(6)], [])
    compare(spark, "op6_ngram_jaccard_join", str(tmp_path))


def test_certified_rules(spark, tmp_path):
    pick = random.Random(7)
    docs, labels = [], []
    for k in range(1, 5300):  # enough good labels a stratum to certify cutoffs
        words = [f"w{pick.randrange(10**6)}" for _ in range(pick.choice([40, 60, 70]))]
        if k % 13 == 0:
            words = [w + "$$$" for w in words]
        if k % 17 == 0:
            words = [w.upper() for w in words]
        if k % 19 == 0:
            words[10:30] = words[30:50] = ["la"] * 20
        line = " ".join(words[:12])
        text = "\n".join([line, line, " ", " ".join(words)] if k % 23 == 0 else [" ".join(words)])
        docs.append((k, text if k != 5 else None, ["en", None][k % 2] if k < 5200 else "xx"))
        labels.append((k, int(all(k % p for p in (13, 17, 19, 23)) or k == 26), 0))
    write(spark, tmp_path, docs, labels)
    got = compare(spark, "op4_risk_controlled_rules", str(tmp_path))
    assert (~got.base_failed & ~got.kept).sum() > 100 and quality.DELTA == 0.05
