"""Blocks cut and digested in Arrow batches, against plain forms and the twin."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from versify.operators import pack as P
from versify.operators import vocab as V
from versify.plans.catalog import QUERIES


def _texts():
    rng = random.Random(5)
    sizes = [0, 1, 3, 4, 5, 9, 40, 63, 64, 65, 66, 128, 129, 700] * 3
    return [*("".join(rng.choice("ab cé\n漢😀") for _ in range(n)) for n in sizes), None]


def test_pack_blocks_equals_its_twin_on_odd_texts(spark, tmp_path):
    rows = [(i * 11, "en", t) for i, t in enumerate(_texts())]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["pack_blocks"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    twin = con.execute(oracle_sql()["pack_blocks"])
    names = [d[0] for d in twin.description]
    want = sorted(twin.fetchall())
    assert len(want) > 40 and sorted(tuple(r[c] for c in names) for r in df.collect()) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 2 * plan.count("collect_list(") and plan.count("MapInArrow") == 1  # digests of gathered cells alone


def test_cells_cut_from_texts_and_from_ids(spark):
    block, batch = 4, 3
    codec = V.CharCodec(sorted(set("ab cé\n漢😀")))
    rows, at, stream = [], 0, ""
    for t in _texts():
        rows.append((at, t))
        at, stream = at + len(t or ""), stream + (t or "")
    texts = spark.createDataFrame(rows, "start long, t string").repartition(3)
    docs = codec.encode_rows(texts, "t").select("start", "ids")
    ln, w = F.size("ids").cast("long"), block + 1
    edges = docs.select("start", ln.alias("ln"), F.slice("ids", 1, w).alias("head"), F.slice("ids", F.greatest(F.size("ids") - block, F.lit(1)), w).alias("tail"))
    ids = [codec.ids[c] for c in stream]
    many = (len(ids) - 1) // (batch * block) * batch
    want = {divmod(c, batch): (ids[c * block : (c + 1) * block], ids[c * block + 1 : (c + 1) * block + 1]) for c in range(many)}
    for found in (P.pack_from_docs(docs, at, batch, block), P.pack_from_docs(texts, at, batch, block, "t", edges.where("ln > 0"), codec)):
        got = found.collect()
        assert len(got) == many and {(r["batch_no"], r["row_no"]): (r["x"], r["y"]) for r in got} == want
    cut = P.pack_from_docs(texts, at, batch, block, "t", edges.where("ln > 0"), codec, digest=True)
    assert sorted(cut.collect()) == sorted(P.block_digest(P.pack_from_docs(docs, at, batch, block)).collect())
    assert P.pack_from_docs(docs, batch * block, batch, block).count() == 0


def test_digests_of_odd_lists(spark):
    lists = [[1, 2, 3], [], None, [0], [None, 7, None], [None], [-5, 12], [1_114_111, 0], list(range(2000))]
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>").orderBy("i").select(F.md5(F.array_join("v", ","))).collect()]
    whole = pa.array(lists, pa.list_(pa.int32()))
    assert P.joined_md5(whole).to_pylist() == want
    for few in ([0, 1], [3, 6], [5, 1], [0, 3]):
        assert P.joined_md5(whole.slice(*few)).to_pylist() == want[few[0] : sum(few)]
    plain = pa.array(lists[:2], pa.list_(pa.int32()))
    assert P.joined_md5(plain).to_pylist() == want[:2]


def test_set_of_characters_has_a_row_a_task(spark):
    texts = ["abca", "", None, "é漢😀\x00", "aa\n"] * 20
    made = V.char_set(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4))
    assert sorted(r["token"] for r in made.collect()) == sorted(set("abcé漢😀\x00\n"))
    assert "array_distinct" not in made._jdf.queryExecution().optimizedPlan().toString()
    nothing = spark.createDataFrame([], "text string")
    assert [r["token"] for r in V.char_set(nothing).collect()] == ["\n"]
