"""Mixing sources to target weights by Poisson replication.

The target weight of a source, its share of the text that the mix shall have, gives a mean
repetition rate: weight x total characters / characters of the source.  A number in
[0, 1) hashed from seed, id and text picks the count of a document by inverting the Poisson
distribution with that mean; the document is repeated so often, and all copies are put
in a seeded global order.  Nothing is drawn at random, so a lost task gives the same rows
again.

Weights are given as a mapping from source to a positive number (sources left out have weight 0,
null is a source like others), or follow from the characters: characters ** ``power``.

Edge cases: null and empty texts have no characters but are mixed at their source's rate; a source
without characters has rate 1; repeated rows with one id and one text get one count and each is
repeated; an empty table gives an empty mix; columns named like the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.llm.common import keep, table, uniform, unused

POWER = 0.5
SEED = "mix"
#: Fixed value: beyond this share of the distribution a 52-bit number can't reach.
TAIL = 2.0**-54


def poisson_cdf(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until it is 1 to 54 bits."""
    if rate <= 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    while True:
        p = math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        total += p
        out.append(total)
        if k > rate and p < TAIL:
            return out
        k += 1


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(src, chars, rate) for each source: a table as long as there are sources."""
    sums = docs.groupBy(F.col(source_col).alias("src")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("double").alias("chars"))
    if weights is None:
        weighted = sums.withColumn("w", F.when(F.col("chars") > 0, F.pow("chars", F.lit(power))).otherwise(0.0))
    else:
        kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("w", T.DoubleType())])
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], kind)
        weighted = sums.join(given, F.col("src").cast("string").eqNullSafe(F.col("name")), "left").select("src", "chars", F.coalesce("w", F.lit(0.0)).alias("w"))
    totals = weighted.agg(F.sum("w").alias("w"), F.sum("chars").alias("chars")).first()
    all_w, all_chars = totals["w"] or 0.0, totals["chars"] or 0.0
    rate = F.when(F.col("chars") <= 0, 1.0).otherwise(F.col("w") / F.lit(all_w or 1.0) * F.lit(all_chars) / F.greatest("chars", F.lit(1.0)))
    # rounded, as a sum of doubles depends on the order in which tasks end
    return weighted.select("src", "chars", F.round(rate, 9).alias("rate"))


def poisson_mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    power: float = POWER,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs``, each row repeated by its count, with mix_rate, mix_copy (from 1)
    and mix_key, in ascending order of mix_key."""
    cdf = F.udf(poisson_cdf, "array<double>")  # once for each source
    rates = keep(source_rates(docs, weights, power, source_col, text_col), "rates").withColumn("cdf", cdf("rate"))
    src, rate, tail, draw, times = unused(docs, "_src", "_rate", "_cdf", "_u", "_n")
    rates = rates.select(F.col("src").alias(src), F.col("rate").alias(rate), F.col("cdf").alias(tail))
    own = [c for c in docs.columns if c not in ("mix_rate", "mix_copy", "mix_key")]
    body = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    u = uniform(F.lit(seed), F.col(id_col), body)
    count = F.size(F.filter(tail, lambda c: c <= F.col(draw)))
    mixed = (
        docs.withColumn(draw, u)
        .join(rates, F.col(source_col).eqNullSafe(F.col(src)))
        .withColumn(times, count)
        .where(F.col(times) > 0)
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col(times))))
    )
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("mix_copy").cast("string"), body))
    return mixed.withColumn("mix_key", key).select(*own, F.col(rate).alias("mix_rate"), F.col("mix_copy").cast("long"), "mix_key").orderBy("mix_key")


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


ORACLE = {
    "op3_poisson_mix": f"""
WITH sums AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS chars FROM documents GROUP BY source),
weighted AS (SELECT *, CASE WHEN chars > 0 THEN pow(chars, {POWER}) ELSE 0 END AS w FROM sums),
rates AS (SELECT source, round(CASE WHEN chars <= 0 THEN 1.0 ELSE w / (SELECT sum(w) FROM weighted) * (SELECT sum(chars) FROM weighted) / greatest(chars, 1.0) END, 9) AS rate FROM weighted),
terms AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, 400) AS r(k)),
cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms WHERE k <= rate OR p >= {TAIL!r}),
keyed AS (SELECT *, md5(coalesce(text, '')) AS body FROM documents),
drawn AS (SELECT *, CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || body), 1, 13)) AS BIGINT)::DOUBLE / {16**13} AS u FROM keyed),
counted AS (SELECT d.*, r.rate, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS n
            FROM drawn d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, text, lang, source, n_chars, rate AS mix_rate, CAST(i AS BIGINT) AS mix_copy,
       md5('{SEED}:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i || ':' || body) AS mix_key
FROM counted, unnest(generate_series(1, n)) AS u(i) WHERE n > 0""",
}
QUERIES = {"op3_poisson_mix": op3_poisson_mix}
