"""Table schemas (Spark DDL). ``start``/``end`` count Unicode code points, end exclusive."""

TEXTS = ("text_id BIGINT, place_id BIGINT, model STRING, text STRING, created_at STRING, "
         "regen_count INT, seq INT, corpus_state STRING")
PLACES = "place_id BIGINT, seed_id BIGINT, model STRING, text STRING, created_at STRING"
STATUS = "text_id BIGINT, tagger STRING, status STRING, tagged_at STRING, seq BIGINT"
RELEASE = "key STRING, value STRING"
MENTIONS = "text_id BIGINT, pattern_id STRING, start INT, end INT, surface STRING, norm STRING"
VERDICTS = ("pattern STRING, text BIGINT, start INT, end INT, surface STRING, verdict STRING, "
            "round INT, seed STRING")
AGREEMENT = ("reader STRING, seed STRING, text BIGINT, pattern STRING, start INT, end INT, "
             "surface STRING, first STRING, second STRING")
RECALL = ("check INT, date STRING, pool STRING, text BIGINT, read_chars INT, "
          "names MAP<STRING,STRING>, forms_missed ARRAY<STRING>, note STRING")
ROUNDS = "round INT, date STRING, note STRING, stats MAP<STRING,STRING>"
ROLE_LABELS = "text_id BIGINT, start INT, end INT, label STRING, norm STRING, source STRING"
QUOTE = "STRUCT<kind STRING, start INT, end INT, quote STRING, match STRING, given STRING>"
DROPPED = "STRUCT<kind STRING, given STRING, why STRING>"
QUOTE_ANSWERS = (f"text BIGINT, model STRING, length INT, quotes ARRAY<{QUOTE}>, "
                 f"dropped ARRAY<{DROPPED}>, tokens_in INT, tokens_out INT, error STRING")
BEINGS = ("id BIGINT, text_id BIGINT, model STRING, called STRING, names ARRAY<STRING>, "
          "words ARRAY<STRING>, n_role INT, n_relation INT, n_cost INT, n_origin INT, n_fate INT")
SENTENCES = "being_id BIGINT, text_id BIGINT, question STRING, no INT, start INT, end INT"
CARE_TEXTS = ("text_id BIGINT, model STRING, n_sentences INT, n_beings INT, "
              "labels ARRAY<STRING>")
GOLD = ("text BIGINT, relation STRING, relation_quote STRING, main_kind STRING, number STRING, "
        "tending STRING, predation STRING, visitor STRING, unsure ARRAY<STRING>, note STRING")
RELEASE_DATES = "model STRING, date STRING, source STRING"
