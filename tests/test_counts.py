"""Facts of a text by regex counts, and that slow steps run once."""
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import FUNCTION_WORDS, SPECIES_WORDS, n_lexicon_words, text_flag


def test_flag_and_lexicon_equal_a_look_at_every_token(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(FUNCTION_WORDS + SPECIES_WORDS + ["The", "reed", "it's", "x'", "catfish", "stone", "É", "IS"]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    texts += ["", " ' " * 30, "stone " * 40 + "the"]

    def flag(t):
        tok = re.findall("[A-Za-z']+", t)
        if len(t.strip()) < 50 or not tok:
            return "empty"
        return "not prose (word check)" if sum(w.lower() in FUNCTION_WORDS for w in tok) / len(tok) < 0.15 else ""

    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").select("text", text_flag("text", F.lit(None).cast("string")).alias("f"), n_lexicon_words("text").alias("n")).collect()
    for row in rows:
        if row.text is None:
            assert row.f == ""
        else:
            assert (row.f, row.n) == (flag(row.text), len(set(re.findall("[a-z]+", row.text.lower())) & set(SPECIES_WORDS)))


@pytest.mark.parametrize("name", ["e8_recall_scores", "e18_f45_verdict_recall", "e19_f47_pilot_recall", "i7_quote_records"])
def test_texts_are_walked_once_for_rows_read_twice(spark, tmp_path, name):
    """Rows that come from a walk over all texts and are read more than once are held."""
    import __spark_entry__ as entry
    spark.catalog.clearCache()
    spark.createDataFrame([(1, "We saw the herons. Reeds stood. The herons saw a reeds. Thing", "en", "src1", 60), (2, None, None, None, 0)],
                          "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    plan = entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan
    spark.catalog.clearCache()


def test_bitmaps_only_for_crowded_ranges(spark):
    """Values of 700 and of 3 texts; a range gets a bitmap only after it was counted as crowded."""
    from spanloom.operators.beings import distinct_texts
    rows = [("many", i) for i in range(700)] + [("more", i) for i in range(100, 900)] + [("few", i) for i in (5, 899, 5000)] + [("few", None)]
    texts = spark.createDataFrame(rows, "norm string, text_id long")
    members = spark.createDataFrame([("a", "many"), ("a", "few"), ("b", "few"), ("c", "many"), ("c", "more"), ("d", "none")], "noun string, norm string")
    out = distinct_texts(members, texts, "noun", "norm")
    held = {v: {t for n, t in rows if n == v and t is not None} for v, _ in rows}
    want = {}
    for noun, v in members.collect():
        want.setdefault(noun, set()).update(held.get(v, ()))
    assert {r.noun: r.texts for r in out.collect()} == {n: len(t) for n, t in want.items() if t}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
