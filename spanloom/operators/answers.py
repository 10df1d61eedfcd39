"""Requests to a model and what comes back. The model is a function given by the caller."""
from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window as W, functions as F

from spanloom.functions.spans import cut, let, sentences
from spanloom.functions.text import (STEMS, digits, extract_json, find_label, fold_compare, is_bare, label_norm,
                                     level, stems_in, valid_numbers)
from spanloom.operators.grounding import KINDS, locate_all
from spanloom.operators.sampling import before, first_wins
from spanloom.operators.tables import count_if
from spanloom.session import bounded_batches

QUESTIONS = ("role", "relation", "cost", "origin", "fate")


# ---- requests -------------------------------------------------------------------------
def requests_text(texts: DataFrame, prompt: str) -> DataFrame:
    """One request per text: instruction and whole text."""
    return texts.select(F.concat(F.lit("t"), F.col("text_id").cast("string")).alias("custom_id"),
                        F.concat(F.lit(prompt + "\n\nTHE TEXT\n\n"), "text").alias("content"))


def _joined(no, line, pattern):
    """Lines of one request in their order. A request is bounded by what a model can read."""
    rows = F.array_sort(F.collect_list(F.struct(no, line)))
    return F.array_join(F.transform(rows, lambda r: F.format_string(pattern, r[no], r[line])), "\n")


def requests_lines(lines: DataFrame, prompt, group="text_id", no="no", line="line", form="%d. %s") -> DataFrame:
    """One request per group over numbered lines. ``prompt`` is a string or a column of ``lines``."""
    head = F.lit(prompt) if isinstance(prompt, str) else F.first(prompt)
    return lines.groupBy(group).agg(F.concat(head, F.lit("\n\n"), _joined(no, line, form)).alias("content"))


def prompt_with_labels(prompt: str, labels):
    """The instruction with the text's labels put in for {labels}."""
    return F.replace(F.lit(prompt), F.lit("{labels}"), F.array_join(labels, "; "))


def requests_chunks(lines: DataFrame, prompt: str) -> DataFrame:
    """One request per chunk of lines of several texts (columns share, chunk, no, line)."""
    flat = lines.withColumn("line", F.regexp_replace("line", r"\s*\n\s*", " "))
    return flat.groupBy("share", "chunk").agg(F.concat(F.lit(prompt + "\n\n"), _joined("no", "line", "%d. %s")).alias("content"))


def requests_groups(lines: DataFrame, prompt: str, head=None) -> DataFrame:
    """One request per chunk of groups, each with its lines (share, chunk, no, group, pos, line)."""
    first = [head] if head else []
    per = lines.groupBy("share", "chunk", "no", *first).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias("body"))
    top = F.concat(F.col("no").cast("string"), F.lit("."), F.concat(F.lit(" "), F.col(head)) if head else F.lit(""), F.lit("\n"))
    block = per.withColumn("block", F.concat(top, "body"))
    rows = F.array_sort(F.collect_list(F.struct("no", "block")))
    return block.groupBy("share", "chunk").agg(F.concat(F.lit(prompt + "\n\n"), F.array_join(
        F.transform(rows, lambda r: r["block"]), "\n\n")).alias("content"))


def requests_template(df: DataFrame, template: str, fields) -> DataFrame:
    """Fill {field} of a template from columns."""
    content = F.lit(template)
    for f in fields:
        content = F.replace(content, F.lit("{%s}" % f), F.col(f).cast("string"))
    return df.withColumn("content", content)


def infer(requests: DataFrame, fn, key="custom_id", tries: int = 3, parallel: int | None = None, pause: float = 0.5) -> DataFrame:
    """Run ``fn(list of contents) -> list of raw answers`` over Arrow batches.

    A batch that fails, or that comes back with another number of answers, is asked row by
    row, each up to ``tries`` times with a growing pause between; a row that keeps failing
    has an error and the others keep their answers.
    """
    kind = requests.schema[key].dataType.simpleString()

    def ask(contents):
        raw = list(fn(contents))
        if len(raw) != len(contents):
            raise ValueError("%d answers to %d requests" % (len(raw), len(contents)))
        return raw

    def ask_one(content):
        for n in range(tries):
            try:
                return ask([content])[0], None
            except Exception as e:                                          # the row says what went wrong
                error = repr(e)[:200]
                if n + 1 < tries:
                    time.sleep(pause * 2 ** n)
        return None, error

    def run(batches):
        for batch in batches:
            contents = list(batch["content"])
            try:
                rows = [(raw, None) for raw in ask(contents)]
            except Exception:                                               # which row it was shows below
                rows = [ask_one(c) for c in contents]
            yield batch[[key]].assign(raw=[r for r, _ in rows], error=[e for _, e in rows])

    source = requests.select(key, "content")
    if parallel:
        source = source.repartition(parallel)
    return source.mapInPandas(run, f"{key} {kind}, raw string, error string")


#: Requests of one share of the log, which a task reads again when it is retried.
SHARE_ROWS = 10_000


def infer_logged(requests: DataFrame, fn, log: str, key="custom_id", per: int = 20, at_once: int = 4, shares: int | None = None, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """``infer`` with answers that survive a lost task, executor or job: a request that was answered is not asked again.

    Requests are dealt by a hash of their id to shares. A task asks ``per`` requests at a time, up to ``at_once`` of
    these lots together, and writes each lot's answers to the folder ``log`` before it goes on; a lot is a file that is moved
    into place whole. It first reads what its share has there, so a retry, or a later run with the same log, returns
    logged answers and asks the rest. What can be asked twice is the lots under way when a task dies. Requests that failed
    are not logged as answered. ``log`` is a folder that executors share, as a URI. A repeated id is asked once.
    Speculative copies of a task would ask side by side: leave speculation off.
    """
    kind = requests.schema[key].dataType.simpleString()
    bounded_batches(requests.sparkSession)
    if shares is None:
        shares = max(1, -(-requests.count() // SHARE_ROWS))

    def ask(contents):
        try:
            raw = list(fn(contents))
            if len(raw) == len(contents):
                return [(r, None) for r in raw]
        except Exception:                                                   # which row it was shows below
            pass
        return [ask_one(c) for c in contents]

    def ask_one(content):
        for n in range(tries):
            try:
                raw = list(fn([content]))
                if len(raw) != 1:
                    raise ValueError("%d answers to 1 request" % len(raw))
                return raw[0], None
            except Exception as e:                                          # the row says what went wrong
                error = repr(e)[:200]
                if n + 1 < tries:
                    time.sleep(pause * 2 ** n)
        return None, error

    def read(fs, folder):
        held = {}
        for info in fs.get_file_info(pa_fs.FileSelector(folder, allow_not_found=True)):
            if info.is_file and info.base_name.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    lot = pq.read_table(f).to_pydict()
                held.update(zip(lot["key"], lot["raw"]))
        return held

    def write(fs, folder, rows):
        good = [(k, raw) for k, raw, error in rows if error is None]
        if good:
            fs.create_dir(folder, recursive=True)
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{folder}/.{name}") as f:
                pq.write_table(pa.table({"key": [k for k, _ in good], "raw": pa.array([r for _, r in good], pa.string())}), f)
            fs.move(f"{folder}/.{name}", f"{folder}/{name}.parquet")

    def run(batches):
        fs, root = pa_fs.FileSystem.from_uri(log)
        share, held = None, {}
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for s, rows in batch.groupby("share", sort=False):
                    if s != share:
                        share, held = s, read(fs, f"{root}/share={s}")
                    todo = rows[~rows[key].isin(held)].drop_duplicates(key)
                    lots = [todo.iloc[i:i + per] for i in range(0, len(todo), per)]
                    failed = {}

                    def one(lot, folder=f"{root}/share={s}"):
                        answered = [(k, *a) for k, a in zip(lot[key], ask(list(lot["content"])))]
                        write(fs, folder, answered)
                        return answered

                    for answered in pool.map(one, lots):
                        held.update((k, raw) for k, raw, error in answered if error is None)
                        failed.update((k, error) for k, _, error in answered if error is not None)
                    yield rows[[key]].assign(raw=[held.get(k) for k in rows[key]], error=[failed.get(k) for k in rows[key]])

    dealt = requests.select(key, "content", F.pmod(F.xxhash64(key), F.lit(shares)).cast("int").alias("share"))
    return dealt.repartition(shares, "share").sortWithinPartitions("share").mapInPandas(run, f"{key} {kind}, raw string, error string")


# ---- answers --------------------------------------------------------------------------
def union_passes(passes: dict) -> DataFrame:
    """Answer tables of several passes as one, tagged with their source and order."""
    out = None
    for n, (source, df) in enumerate(passes.items()):
        tagged = df.withColumn("source", F.lit(source)).withColumn("pass_no", F.lit(n))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def parse_quotes(answers: DataFrame) -> DataFrame:
    """text_id, quote_no, kind, given, malformed, unreadable: one row per returned quote. An
    answer is an object with ``quotes`` or a bare list, of strings or of {kind, quote}; any
    other item is malformed. An answer that is neither gives one unreadable row without a
    number, with the raw text as ``given``. An empty list gives no row."""
    body = F.try_parse_json(extract_json("raw", "any"))
    is_list = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    inner = F.try_variant_get(body, "$.quotes", "variant")
    listed = F.when(is_list(inner), inner).when(is_list(body), body)
    items = F.transform(listed.cast("array<variant>"), lambda v: F.struct(F.schema_of_variant(v).alias("is"), v.alias("v")))
    read = answers.select("text_id", "raw", items.alias("items"))
    rows = read.select("text_id", F.posexplode("items").alias("quote_no", "item"))
    is_object, is_text = F.col("item.is").startswith("OBJECT"), F.col("item.is") == "STRING"
    part = lambda name: F.when(F.schema_of_variant(F.try_variant_get("item.v", "$." + name, "variant")) == "STRING", F.try_variant_get("item.v", "$." + name, "string"))
    kind = F.when(is_object, part("kind")).when(is_text, F.lit(""))
    quote = F.when(is_object, part("quote")).when(is_text, F.col("item.v").cast("string"))
    bad = F.coalesce(~kind.isin(*KINDS, ""), F.lit(True)) | quote.isNull()
    shown = F.coalesce(quote, F.to_json("item.v"))
    good = rows.select("text_id", "quote_no", F.coalesce(kind, F.lit("")).alias("kind"), shown.alias("given"), bad.alias("malformed"), F.lit(False).alias("unreadable"))
    lost = read.filter("items is null").select("text_id", F.lit(None).cast("int").alias("quote_no"), F.lit("").alias("kind"), F.col("raw").alias("given"), F.lit(True).alias("malformed"), F.lit(True).alias("unreadable"))
    return good.unionByName(lost)


def ingest_quotes(parsed: DataFrame, texts: DataFrame, hold: bool = False):
    """(kept, dropped): quotes placed in their text; the rest kept with a reason. ``hold`` caches the slim rows that are read
    more than once, the parsed quotes and the judged ones, for a caller that uses both tables; a stream leaves it off."""
    parsed = parsed.persist() if hold else parsed
    # a text meets its quotes once, as one row
    per = parsed.groupBy("text_id").agg(F.collect_list(F.struct("quote_no", "kind", "given", "malformed")).alias("all"))
    rows = per.join(texts.select("text_id", "text"), "text_id")
    good = F.transform(F.filter("all", lambda q: ~q["malformed"]), lambda q: F.struct(q["quote_no"].alias("quote_no"), q["given"].alias("quote")))
    at = locate_all(rows.withColumn("quotes", good), ["text_id"])
    judged = parsed.join(at, ["text_id", "quote_no"], "left").withColumn("why", F.when(F.col("unreadable"), "unreadable").when(
        F.col("malformed"), "malformed").when(F.col("match").isNull(), "not in the text"))
    judged = judged.persist() if hold else judged
    placed = judged.filter(F.col("why").isNull()).groupBy("text_id").agg(F.collect_list(F.struct("kind", "start", "end", "match", "given")).alias("q"))
    own = placed.join(texts.select("text_id", "text"), "text_id").select("text_id", F.inline(F.transform("q", lambda q: F.struct(
        q["kind"].alias("kind"), q["start"].alias("start"), q["end"].alias("end"), cut("text", q["start"], q["end"]).alias("quote"),
        q["match"].alias("match"), F.when(q["match"] == "fuzzy", q["given"]).alias("given")))))
    return own, judged.filter(F.col("why").isNotNull()).select("text_id", "kind", "given", "why")


def quote_records(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """Kept and dropped quotes as one nested record per text, sorted by start."""
    k = kept.groupBy("text_id").agg(F.array_sort(F.collect_list(
        F.struct("start", "end", "kind", "quote", "match", "given"))).alias("quotes"))
    d = dropped.groupBy("text_id").agg(F.collect_list(F.struct("kind", "given", "why")).alias("dropped"))
    return k.join(d, "text_id", "full")


def ingest_labels(answers: DataFrame, lines: DataFrame, keys=("text_id",)):
    """(kept, dropped): labels grounded in the line they were given for.

    ``answers``: keys, raw (an object line number -> labels); ``lines``: keys, no, line,
    start, text_id. Kept rows are the line's own characters with offsets in the text. An
    unreadable answer is a dropped row without a line number, with the raw text as label.
    """
    keys = list(keys)
    parsed = answers.select(*keys, "raw", F.from_json(extract_json("raw"), "map<string,string>").alias("m"))
    unread = parsed.filter("m is null").select(*keys, F.lit(None).cast("string").alias("no"), F.col("raw").alias("label"))
    per_line = parsed.select(*keys, F.explode("m").alias("k", "v")).withColumn("no", digits("k"))
    lists = per_line.withColumn("labels", F.from_json("v", "array<string>"))
    bad_key = F.col("no").isNull() | ~F.col("v").startswith("[") | F.col("labels").isNull()
    wrong = lists.filter(bad_key).select(*keys, F.col("k").alias("no"), F.col("v").alias("label"))
    asked = lists.filter(~bad_key).select(*keys, "no", F.explode("labels").alias("label"))
    joined = asked.join(lines.select(*{*keys, "text_id"}, "no", "line", "start"), [*keys, "no"], "left")
    at = joined.withColumn("_p", find_label("label", "line"))
    begin = F.col("start") + F.col("_p")
    kept = at.filter(F.col("_p").isNotNull()).select(
        "text_id", begin.cast("int").alias("start"), (begin + F.length("label")).cast("int").alias("end"),
        F.substring("line", F.col("_p") + 1, F.length("label")).alias("label"))
    lost = at.filter(F.col("_p").isNull()).select(*keys, F.col("no").cast("string").alias("no"), "label")
    return kept, wrong.unionByName(lost).unionByName(unread)


def role_labels(passes: dict) -> DataFrame:
    """Labels of both passes, first pass first per span, with their norm; empty norms left out."""
    both = union_passes(passes)
    one = first_wins(both.select("text_id", "start", "end", "label", "source", "pass_no"), ["text_id", "start", "end"], ["pass_no", "label"])
    return one.select("text_id", "start", "end", "label", label_norm("label").alias("norm"), "source").filter(F.col("norm") != "")


def ingest_beings(answers: DataFrame, texts: DataFrame, stems=STEMS):
    """(beings, sentences, care_texts) from inhabitants answers (text_id, raw).

    ``n_beings`` is NULL for an unreadable answer and 0 for an empty one. Ids number the
    beings by text and place in the answer: a count per text, summed before each text by
    ranges of text ids, wherever these lie, so no task sorts the whole table.
    """
    shape = "array<struct<called:string,names:array<string>," + ",".join(f"{q}:array<string>" for q in QUESTIONS) + ">>"
    raw_list = F.get_json_object(extract_json("raw"), "$.inhabitants")
    parsed = answers.select("text_id", F.when(raw_list.startswith("["), F.from_json(raw_list, shape)).alias("inh"))
    joined = parsed.join(texts.select("text_id", "model", "text"), "text_id")
    sized = joined.select("text_id", "model", sentences("text").alias("ss"), "inh")
    care_texts = sized.select("text_id", "model", F.size("ss").alias("n_sentences"),
                              F.when(F.col("inh").isNotNull(), F.size("inh")).alias("n_beings"))
    numbered = F.struct(*[valid_numbers(F.col("b." + q), F.size("ss")).alias(q) for q in QUESTIONS])
    rows = sized.select("text_id", "model", "ss", F.posexplode("inh").alias("place", "b")).select(
        "text_id", "model", "place", "b.called", F.coalesce("b.names", F.array().cast("array<string>")).alias("names"),
        numbered.alias("n"), "ss")
    rows = rows.withColumn("words", stems_in(F.array_join(F.concat("names", F.array(F.coalesce("called", F.lit("")))), " \n "), stems))
    offsets = first_ids(care_texts)
    rows = rows.join(offsets, "text_id").withColumn("id", F.col("_before") + F.col("place") + 1)
    beings = rows.select("id", "text_id", "model", "called", "names", "words", *[F.size("n." + q).alias("n_" + q) for q in QUESTIONS])

    def numbers(q):
        return F.transform("n." + q, lambda i: F.struct(F.lit(q).alias("question"), i.alias("no")))

    listed = F.flatten(F.array(*[numbers(q) for q in QUESTIONS]))
    sents = rows.select(F.col("id").alias("being_id"), "text_id", "ss", F.explode(listed).alias("s")).select(
        "being_id", "text_id", "s.question", "s.no", F.get("ss", F.col("s.no") - 1)["start"].alias("start"),
        F.get("ss", F.col("s.no") - 1)["end"].alias("end"))
    return beings, sents, care_texts


def first_ids(care_texts: DataFrame) -> DataFrame:
    """text_id -> number of beings in texts with a smaller id."""
    counts = care_texts.select("text_id", F.coalesce("n_beings", F.lit(0)).cast("long").alias("_n"))
    return before(counts, "text_id", "_n", "_before").select("text_id", "_before")


def accept_nouns(returned, hay, stems=STEMS, refuse_bare=True):
    """Nouns that stand in ``hay`` (lower case), bare lexicon words refused, no repeats."""
    lowered = F.transform(F.coalesce(returned, F.array().cast("array<string>")), lambda x: F.btrim(F.lower(x)))
    fits = F.filter(lowered, lambda x: (x != "") & F.contains(hay, x) & (~is_bare(x, stems) if refuse_bare else F.lit(True)))
    return F.array_sort(F.array_distinct(fits))


def ingest_nouns(answers: DataFrame, names: DataFrame, keys=("chunk",), stems=STEMS) -> DataFrame:
    """name -> nouns kept in it. ``answers``: keys, raw; ``names``: keys, no, name. A name the
    model said nothing of has an empty list; a name of an unreadable answer is left out."""
    keys = list(keys)
    parsed = answers.select(*keys, F.from_json(extract_json("raw"), "map<string,string>").alias("m")).filter(F.col("m").isNotNull())
    said = parsed.join(names, keys).withColumn("v", F.from_json(F.element_at("m", F.col("no").cast("string")), "array<string>"))
    return said.select("name", accept_nouns(F.col("v"), F.lower("name"), stems).alias("nouns"))


def ingest_sides(answers: DataFrame, groups: DataFrame, keys=("chunk",)) -> DataFrame:
    """being_id -> nouns for and against that stand in its sentences (``groups``: keys, no, being_id, hay)."""
    keys = list(keys)
    parsed = answers.select(*keys, F.from_json(extract_json("raw"), "map<string,string>").alias("m")).filter(F.col("m").isNotNull())
    said = parsed.join(groups, keys).withColumn("v", F.from_json(
        F.element_at("m", F.col("no").cast("string")), "`for` array<string>, against array<string>"))
    hay = F.lower("hay")
    return said.select("being_id", accept_nouns(F.col("v.for"), hay, refuse_bare=False).alias("for"),
                       accept_nouns(F.col("v.against"), hay, refuse_bare=False).alias("against"))


def ingest_levels(answers: DataFrame) -> DataFrame:
    """text_id, part, alive, is, level from evidence numbers (``answers``: text_id, raw, n)."""
    body = F.from_json(extract_json("raw"), "part array<string>, alive array<string>, `is` array<string>")
    got = answers.select("text_id", "n", body.alias("b")).filter(F.col("b").isNotNull())
    cols = {c: valid_numbers(F.col("b." + c), F.col("n")) for c in ("part", "alive", "is")}
    out = got.select("text_id", *[v.alias(c) for c, v in cols.items()])
    return out.withColumn("level", level("part", "alive", "is"))


def ingest_voice(answers: DataFrame, groups: DataFrame, keys=("chunk",)) -> DataFrame:
    """being_id -> who says I, who is you (``groups``: keys, no, being_id)."""
    keys = list(keys)
    parsed = answers.select(*keys, F.from_json(extract_json("raw"), "map<string,string>").alias("m"))
    said = parsed.select(*keys, F.explode("m").alias("k", "v")).withColumn("no", digits("k"))
    joined = said.join(groups, [*keys, "no"])
    return joined.select("being_id", F.get_json_object("v", "$.i").alias("i"), F.get_json_object("v", "$.you").alias("you")).filter(
        F.col("i").isNotNull() | F.col("you").isNotNull())


def person_candidates(counts: DataFrame) -> DataFrame:
    """Beings worth asking: a first-person word, or "you" in max(2, half) of the sentences.
    ``counts``: being_id, n_sentences, n_first, n_you."""
    return counts.filter((F.col("n_first") > 0) | (F.col("n_you") >= F.greatest(F.lit(2.0), F.col("n_sentences") / 2)))


def batch_register(register: DataFrame, news: DataFrame) -> DataFrame:
    """The register with new states laid over; a finished batch stays as it was."""
    merged = register.withColumn("_n", F.lit(0)).unionByName(news.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    done = F.col("status") == "completed"
    rest = [c for c in merged.columns if c not in ("id", "_n")]
    rank = F.when((F.col("_n") == 0) & done, 2).otherwise(F.col("_n"))
    return merged.groupBy("id").agg(F.max_by(F.struct(*rest), rank).alias("r")).select("id", "r.*")


def answer_accounting(answers: DataFrame) -> DataFrame:
    """Per batch: answers, unreadable, dropped, tokens, cost; with a total row (batch NULL)."""
    return answers.rollup("batch").agg(
        F.count(F.lit(1)).alias("answers"), count_if(F.col("error").isNotNull()).alias("unreadable"),
        F.sum("n_dropped").alias("dropped"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.round(F.sum("cost"), 3).alias("cost"))


def missing_quotes(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claimed passages (being_id, question, quote) that do not stand in the being's
    sentences; parts are split at " / " and both sides folded."""
    parts = claims.select("being_id", "question", "quote", F.explode(F.split("quote", " / ")).alias("part"))
    parts = parts.withColumn("_p", fold_compare(F.btrim(F.col("part"), F.lit(" .…")), "evidence"))
    hay = evidence.groupBy("being_id", "question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("no", "sentence"))), lambda r: r["sentence"]), " ").alias("_h"))
    hay = hay.withColumn("_h", fold_compare("_h", "evidence"))
    joined = parts.join(hay, ["being_id", "question"], "left")
    return joined.filter(~F.coalesce(F.col("_h").contains(F.col("_p")), F.lit(False))).select("being_id", "question", "quote", "part")


def assert_quotes(claims: DataFrame, evidence: DataFrame) -> None:
    """Stop the build if a quoted passage does not stand in its evidence."""
    bad = missing_quotes(claims, evidence).limit(5).collect()
    if bad:
        raise ValueError("quotes not in their evidence: %s" % [r.asDict() for r in bad])


def missing_figures(claims: DataFrame, accounts: DataFrame) -> DataFrame:
    """Claims (question, key, numbers) with no account line that holds the key and every number.

    A claim meets only the lines of its question that hold its first number: lines are
    looked up by their runs of digits, so the claims and lines of a question are not paired.
    """
    claimed = claims.withColumn("_lead", F.coalesce(F.regexp_extract(F.get("numbers", F.lit(0)).cast("string"), r"\d+", 0), F.lit("")))
    runs = F.array_distinct(F.concat(F.regexp_extract_all("line", F.lit(r"\d+"), F.lit(0)), F.array(F.lit(""))))
    lines = accounts.withColumn("_lead", F.explode(runs))
    cond = ((F.col("c.question") == F.col("a.question")) & (F.col("c._lead") == F.col("a._lead")) & F.contains(F.lower("a.line"), F.lower("c.key"))
            & F.forall("c.numbers", lambda n: F.rlike(F.col("a.line"), F.concat(F.lit(r"(?<!\d)\Q"), n.cast("string"), F.lit(r"\E(?!\d)")))))
    return claimed.alias("c").join(lines.alias("a"), cond, "left_anti").drop("_lead")


def assert_figures(claims: DataFrame, accounts: DataFrame) -> None:
    bad = missing_figures(claims, accounts).limit(5).collect()
    if bad:
        raise ValueError("figures not in the accounts: %s" % [r.asDict() for r in bad])


def resolve_refs(notes: DataFrame, samples: DataFrame) -> DataFrame:
    """References "A 123" in notes, kept if the id belongs to the sample named (samples: part, id)."""
    refs = notes.select("note_id", F.explode(F.regexp_extract_all("note", F.lit(r"\b([AB] \d+)\b"), F.lit(1))).alias("ref"))
    keyed = refs.select("note_id", "ref", F.substring("ref", 1, 1).alias("part"), F.expr("try_cast(substring(ref, 3) as bigint)").alias("id"))
    return keyed.join(samples.select("part", "id"), ["part", "id"], "left_semi")


# Openings of the five questions where an answer repeats them in bold.
QUESTION_OPENINGS = ("What do you", "What does the word", "What has it cost", "Was there a moment", "Do you want")
NUMBERED = r"\**\s*(?:\*\*)?\s*([1-5])[.:)]"


def split_answers(raw):
    """An answer cut at its headings, as array<struct<no,body>>. A heading is a line that
    opens with a number 1 to 5, or repeats a question in bold and so begins the next part;
    text before the first heading is part 0."""
    from spanloom.functions.spans import _c
    asks = r"\*\*(?:%s)" % "|".join(QUESTION_OPENINGS)
    at_heads = F.regexp_replace(F.concat(F.lit("\n"), _c(raw)), r"\n(?=%s|%s)" % (NUMBERED, asks), "\u0001")
    parts = F.filter(F.transform(F.split(at_heads, "\u0001"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    empty = F.array().cast("array<struct<no:int,body:string>>")

    def place(acc, p):
        now = F.coalesce(F.try_element_at(F.transform(acc, lambda r: r["no"]), F.lit(-1)), F.lit(0))
        given = F.nullif(F.regexp_extract(p, "^" + NUMBERED, 1), F.lit("")).cast("int")
        no = F.coalesce(given, F.when(p.rlike("^" + asks), F.least(now + 1, F.lit(5))), now)
        return F.concat(acc, F.array(F.struct(no.alias("no"), p.alias("body"))))

    numbered = F.aggregate(parts, empty, place)
    def parts_of(rows):
        kept = F.array_sort(F.array_distinct(F.transform(rows, lambda r: r["no"])))
        return F.transform(kept, lambda n: F.struct(n.alias("no"), F.array_join(F.transform(
            F.filter(rows, lambda r: r["no"] == n), lambda r: r["body"]), "\n").alias("body")))

    return let(numbered, parts_of)


def side_by_side(answers: DataFrame, sentences_: DataFrame, qmap: dict) -> DataFrame:
    """Elicited answer parts (being_id, no, body) beside the text's own sentences of the
    questions mapped to that part."""
    pairs = F.create_map(*[x for n, qs in qmap.items() for x in (F.lit(n), F.array(*map(F.lit, qs)))])
    asked = answers.withColumn("question", F.explode(F.element_at(pairs, F.col("no"))))
    joined = asked.join(sentences_.select("being_id", "question", F.col("no").alias("s_no"), "sentence"), ["being_id", "question"], "left")
    rows = F.array_sort(F.collect_list(F.when(F.col("s_no").isNotNull(), F.struct("s_no", "sentence"))))
    return joined.groupBy("being_id", "no", "body").agg(
        F.array_join(F.transform(rows, lambda r: r["sentence"]), "\n").alias("said"))


def uncovered_lines(texts: DataFrame, heads: DataFrame, hits: DataFrame, sents: DataFrame, quotes: DataFrame, cap: int = 700) -> DataFrame:
    """Lines for the second pass: headings, and sentences that hold a hit, outside every
    quote and not longer than ``cap``. All inputs carry text_id, start, end."""
    from spanloom.operators.intervals import locate_in, not_covered
    free = not_covered(hits.select("text_id", "start", "end"), quotes, ["text_id"])
    held = locate_in(free.select("text_id", F.col("start").alias("pos")).distinct(), sents.select("text_id", "start", "end"), ["text_id"])
    rows = held.select("text_id", F.col("r_start").alias("start"), F.col("r_end").alias("end")).distinct().withColumn("why", F.lit("sentence"))
    rows = heads.select("text_id", "start", "end").distinct().withColumn("why", F.lit("heading")).unionByName(rows)
    rows = not_covered(rows, quotes, ["text_id"]).groupBy("text_id", "start", "end").agg(F.min("why").alias("why"))
    short = rows.filter(F.col("end") - F.col("start") <= cap).join(texts.select("text_id", "text"), "text_id")
    line = short.select("text_id", "start", "end", cut("text", F.col("start"), F.col("end")).alias("line"), "why")
    return line.filter(F.btrim(F.col("line"), F.lit(" \t\r\n")) != "")
