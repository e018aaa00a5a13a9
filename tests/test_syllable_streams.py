import itertools

from versify.plans.catalog import QUERIES


def test_streams_hold_more_syllables_than_16_bits_number(spark, tmp_path):
    """An id from 65,536 on once failed the job."""
    words = ["".join(x) for x in itertools.islice(itertools.product("bcdfghjklmnpqrstvwz", repeat=4), 66_000)]
    docs = [(i, "it", "s", " ".join(words[k : k + 6_600])) for i, k in enumerate(range(0, len(words), 6_600))]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["syllable_streams"](spark, str(tmp_path)).collect()
    assert sum(r.n_tokens for r in rows) > 66_000 and len(rows) == sum(-(-len(t.split()) // 84) for *_, t in docs)
    for split in ("train", "val"):
        ends = sorted((r.start, r.start + r.n_tokens) for r in rows if r.split == split)
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(ends))
