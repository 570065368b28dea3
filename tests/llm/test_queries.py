"""The registered queries against SQL, and the pipeline stage by stage."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from chronolith.llm import queries
from chronolith.llm.runtime import staged, table

from ..oracle import compare, connect
from .test_corpus_operators import linked

SF_DIR = "/root/testdata/sf0.001"


def test_queries_equal_sql(spark):
    con = connect(SF_DIR)
    for name, sql in queries.oracle_sql().items():
        assert compare(spark, con, SF_DIR, queries.queries()[name], sql) > 0


def test_pipeline(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(staged(stage(spark, seen[-1], SF_DIR), "test"))
        assert name == corpus_pipeline.STAGES[-1][0] or seen[-1].columns == columns
    rows = [{r.doc_id: r for r in df.collect()} for df in seen]
    good = {r.doc_id for r in table(spark, SF_DIR, "labels").where("quality = 1").collect()}
    assert rows[1].keys() < rows[0].keys() and len(good - rows[1].keys()) <= 1
    groups = linked([(r.doc_id, r.text, "") for r in rows[1].values()], 5, 80)
    assert rows[2].keys() == {k for k, (_, c) in groups.items() if k == c}
    assert rows[3].keys() == rows[2].keys() and any("[" in rows[3][k].text and rows[3][k].text != rows[2][k].text for k in rows[3])
    assert rows[4].keys() <= rows[3].keys() and all(rows[4][k].text == rows[3][k].text for k in rows[4])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert rows[5].keys() == rows[4].keys() and seen[5].count() == seen[4].count()
    for k, r in rows[5].items():
        assert r.n_tokens == len(tokenizer.encode(rows[4][k].text or "", add_special_tokens=False).ids) == len(r.ids) // 4
