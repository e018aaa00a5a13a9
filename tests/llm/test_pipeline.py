import corpus_pipeline as cp
from versify.llm import jaccard_join, mixing, packing, quality, registry, secret_scan
from versify.llm.common import keep, table

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    model = quality.fit(docs, table(spark, SF, "labels"))
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    frames = [docs]
    for name, stage in cp.STAGES:
        frames.append(keep(stage(spark, frames[-1], SF), name.replace(" ", "-")))
    _, good, single, clean, mix, packed = frames
    assert all(f.columns == columns for f in frames[:-1])
    assert {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= quality.CUT}
    first = {r["component_id"] for r in jaccard_join.jaccard_components(good).collect()}
    assert {r["doc_id"] for r in single.collect()} == first
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert r["text"] == secret_scan.redacted(texts[r["doc_id"]], "[secret]") and r["n_chars"] == len(r["text"])
    assert clean.count() == single.count()
    assert sorted(r["doc_id"] for r in mix.collect()) == sorted(r["doc_id"] for r in mixing.poisson_mix(clean).collect())
    assert packed.groupBy().sum("n_tokens").first()[0] == packing.token_lengths(mix).groupBy().sum("n").first()[0]


def test_empty_table_passes(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_one_query_for_each_operator():
    names = sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)
