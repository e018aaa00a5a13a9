"""Spark queries against their DuckDB twins on the smallest scale factor."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from versify.plans.catalog import QUERIES
from versify.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["clean_text", "rhyme_suffix", "rhyme_tags", "evaluate_documents", "word_budget", "char_vocab",
        "split_tokens", "char_streams", "draw", "top_p", "top_p_hook", "page_verses", "page_links", "chat_template", "best_step", "pretokenize", "bpe_pairs",
        "pretrain_files", "text_files", "text_table", "jsonl_records", "finetune_titles", "syllable_count",
        "hash_split", "split_overlap", "pretrain_quarantine", "page_quarantine", "container_links", "url_normalize", "context_perplexity", "unigram_seed"]


def _norm(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() >= 1 and set(df.columns) == {"lang", "poems", "lines", "rhymed_lines", "rhymed_rate"}


def test_every_query_has_a_twin_or_is_declared_rows_only():
    rows_only = {"unigram_train", "unigram_encode", "unigram_sample", "bpe_encode", "bpe_ids", "token_stats"}
    missing = set(QUERIES) - set(oracle_sql()) - rows_only
    assert not missing


@pytest.mark.parametrize("name", FAST)
def test_query_matches_twin(spark, con, name):
    sdf = queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    s = [tuple(r[c] for c in cols) for r in sdf.collect()]
    rel = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    d = [tuple(r[dcols.index(c)] for c in cols) for r in rel.fetchall()]
    assert _norm(s) == _norm(d)
