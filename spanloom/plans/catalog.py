"""All registered queries in one place."""
from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.spans import find_spans
from spanloom.functions.text import norm
from spanloom.operators.sampling import top_k
from spanloom.plans import being_queries, pattern_queries, span_queries, text_queries  # noqa: F401
from spanloom.plans.data import ORACLES, QUERIES, TEXTS, query, span_rows, texts

_RX = r"\b[Tt]he[ \t]+(?P<name>[a-z]+s)\b"


@query("flagship_writer_strings", f"""WITH {TEXTS}, s AS (SELECT DISTINCT x.model, r.text_id, r.surface AS norm FROM ({span_rows('p', chr(92) + 'b[Tt]he[ ' + chr(92) + 't]+', '[a-z]+s', chr(92) + 'b')}) r JOIN texts x USING (text_id)),
    c AS (SELECT model, norm, count(*) AS n_texts FROM s GROUP BY 1, 2), n AS (SELECT model, count(*) AS texts FROM texts GROUP BY 1)
    SELECT model, norm, n_texts, texts, round(100.0 * n_texts / texts, 1) AS pct, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n_texts DESC, norm) AS rank FROM c) JOIN n USING (model) WHERE rank <= 10""")
def flagship(spark, d):
    """texts -> spans -> norm -> writer x string -> share of the writer's texts, ten per writer."""
    x = texts(spark, d)
    found = F.array_distinct(F.transform(find_spans("text", _RX, "name"), lambda s: norm(s["surface"])))
    per = x.select("model", F.explode(found).alias("norm")).groupBy("model", "norm").agg(F.count(F.lit(1)).alias("n_texts"))
    counted = x.groupBy("model").agg(F.count(F.lit(1)).alias("texts"))
    top = top_k(per, "model", 10, [F.desc("n_texts"), F.asc("norm")])
    return top.join(counted, "model").withColumn("pct", F.round(100.0 * F.col("n_texts") / F.col("texts"), 1))
