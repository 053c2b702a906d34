"""The pipeline, stage by stage, against brute force on the smallest tables,
and the registered queries' contracts."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from runlens.llm import crf_toxicity, queries, secret_scan

from ..conftest import SF_SMALL
from .test_exact import brute_components, brute_decontaminate


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the written result of every stage."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_all_but_the_last_stage_return_the_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns and s.schema == stages[0].schema for s in stages[1:-1])


def test_toxicity_stage_drops_what_the_field_rejects(spark, stages):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").selectExpr("doc_id", "toxic AS label")
    field = crf_toxicity.fit(stages[0], labels)
    want = {d for d, t in rows(stages[0]) if crf_toxicity.tag(t, field)[0] < 0.5}
    assert {d for d, _ in rows(stages[1])} == want and len(want) > 0.8 * stages[0].count()


def test_jaccard_stage_keeps_one_of_each_group(stages):
    want = sorted(d for d, _, c in brute_components(rows(stages[1])) if d == c)
    assert sorted(d for d, _ in rows(stages[2])) == want


def test_decontamination_stage_drops_hit_documents(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    want = sorted(r[0] for r in brute_decontaminate(rows(stages[2]), items) if not r[5])
    assert sorted(d for d, _ in rows(stages[3])) == want


def test_secret_stage_redacts_and_keeps_all(stages):
    before, after = dict(rows(stages[3])), dict(rows(stages[4]))
    assert before.keys() == after.keys()
    for d, text in before.items():
        assert after[d] == secret_scan.redact(text) and not secret_scan.scan(after[d])[0]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_last_stage_round_trips(stages):
    assert stages[5].count() == stages[4].count() and stages[5].filter("NOT round_trip OR n_tokens <> size(ids)").count() == 0


def test_run_equals_the_stages(spark, stages):
    got = {(r["doc_id"], tuple(r["ids"])) for r in P.run(spark, SF_SMALL).collect()}
    assert got == {(r["doc_id"], tuple(r["ids"])) for r in stages[5].collect()}


CONTRACTS = {
    1: "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
    2: "doc_id:bigint n_shingles:bigint component_id:bigint",
    3: "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
    4: "doc_id:bigint ids:array<int> n_tokens:bigint",
    5: "doc_id:bigint held_out:boolean score:double predicted:int",
    6: "page_id:bigint url:string text:string n_chars:bigint",
    7: "doc_id:bigint held_out:boolean lang_pred:string score:double",
    8: "doc_id:bigint held_out:boolean score:double predicted:int",
    9: "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    10: "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
}


@pytest.mark.parametrize("number", sorted(CONTRACTS))
def test_query_contract(spark, number):
    (name,) = [k for k in entry.queries() if re.match(rf"op{number}_", k)]
    assert queries.QUERIES[name] is entry.queries()[name]
    df = entry.queries()[name](spark, SF_SMALL)
    have = {f"{c}:{t}" for c, t in df.dtypes}
    assert set(CONTRACTS[number].split()) <= have
    table = "pages" if number == 6 else "documents"
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()
