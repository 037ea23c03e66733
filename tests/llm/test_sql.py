"""The SQL texts of the registered queries, and very long texts and empty tables for the text operators."""
import duckdb
import pytest

from taskgrid.llm import common, decontam, queries, quality_rules, sentencepieces, simhash, substring, token_counts
from tests.conftest import SF001
from tools.check_oracle import TABLES, digest


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = queries.QUERIES[key](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    rel = con.execute(queries.ORACLE[key])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, rows) == digest(columns, rel.fetchall())


def test_texts_of_megabytes(spark):
    import sentencepiece
    common.ship(spark)
    one = " ".join(f"w{k % 977} of the long text," for k in range(60_000))
    df = spark.createDataFrame([(1, one), (2, one), (3, "short")], "doc_id bigint, text string")
    n = len(one.split())
    assert len(one) > 1_200_000
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    got = {r.doc_id: r.tokens.n_tokens for r in token_counts.count_tokens(df).collect()}
    assert got == {1: len(sp.encode(one)), 2: len(sp.encode(one)), 3: len(sp.encode("short"))}
    assert {r.doc_id: r.stats.n_words for r in quality_rules.judge(df, []).collect()} == {1: n, 2: n, 3: 1}
    comp = {r.doc_id: r.component_id for r in simhash.digest(df).collect()}
    assert comp == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: (r.n_words, r.n_removed == n) for r in substring.digest(df).collect()} == {
        1: (n, False), 2: (n, True), 3: (1, False)}
    assert all(r.pieces.round_trip for r in sentencepieces.encode(df, check=True).collect())


def test_empty_tables_and_clashing_columns(spark):
    import corpus_pipeline as p
    common.ship(spark)
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    bench = spark.createDataFrame([(1, "an item of some words. its answer is here")], "item_id bigint, text string")
    assert sentencepieces.encode(docs).collect() == [] and decontam.with_matches(docs, bench).collect() == []
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF001).collect() == []
    clash = spark.createDataFrame([(1, "a b c", "x", "y", "z")], "doc_id bigint, text string, stats string, base_failed string, kept string")
    r = quality_rules.judge(clash, []).first()
    assert (r.doc_id, r.stats.n_words, r.base_failed, r.kept) == (1, 3, True, False)
