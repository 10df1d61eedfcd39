"""Secrets in texts: pattern spans, told apart by how many owners hold the same value anywhere in the corpus."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import let
from spanloom.llm.shared import written

#: The base patterns. Character classes and alternatives only, so the regex engine never recurses.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs are taken whole, so a run of 32 or more is the same as a run that is 32 or longer
_HEAD, _FOOT = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----END [A-Z ]{0,40}PRIVATE KEY-----"
#: A whole PEM key: up to its END line with no other dashes between, or, where that is missing, its runs of base64. All
#: loops are possessive. Blanks, line ends as such or written out, and marks of quoting or comments may stand between runs.
_GAP = r"""(?:[\s"'>#*|,+]|\\[nrt]?)"""
PRIVATE = (_HEAD + rf"(?:(?:[^-]|-(?!----))*+{_FOOT}|(?:{_GAP}*+(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]++)*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++"
           r"(?:(?:\r?\n|\\n)[ \t]*+[A-Za-z0-9+/]{1,15}+={0,2}(?=[\s\\\x22\x27]|\z))?|)")
#: What is no part of a key's own characters.
_WRAPPING = rf"{_HEAD}|{_FOOT}|\\[nrt]|[^A-Za-z0-9+/=]"
#: The added patterns of well-known credential shapes.
ADDED = {
    "forge": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "bearer": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private": PRIVATE,
}
KINDS = ["assign", "access", "hex", *ADDED]
#: A value with so many owners is a widely copied example.
WIDE_OWNERS = 3
#: Bits per character below which a value does not look live, and its least length.
ENTROPY, LEAST = 2.5, 12
#: A short value needs no more bits than this part of the most that its length can hold; from 12 characters on, ``ENTROPY`` is less.
VARIED = 0.7
#: Characters from which the body of a private key is a key and no placeholder.
KEY = 64
#: A hot value's rows are dealt to so many parts where they meet the corpus-wide counts.
PARTS = 32


def running(values: Column, block: int = 256) -> Column:
    """Running totals of an array of longs: totals of blocks first, then within the blocks, so long arrays stay cheap.

    Whatever a lambda reads is bound first, else it would be worked out again for every element.
    """
    zero = F.lit(0).cast("long")
    total = lambda part: F.aggregate(part, zero, lambda acc, x: acc + x)
    place = lambda i: F.floor(i / block).cast("int")

    def before(bound):
        starts = F.when(F.size(bound) > 0, F.sequence(F.lit(0), F.size(bound) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(starts, lambda at: total(F.slice(bound, at + 1, block)))
        return F.aggregate(blocks, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    return let(values, lambda bound: let(before(bound), lambda heads: F.transform(
        bound, lambda _, i: F.element_at(heads, place(i) + 1) + total(F.slice(bound, place(i) * block + 1, i % block + 1)))))


def key_body(match: Column) -> Column:
    """The characters of a PEM key, however it is wrapped; of a header without a key, the header."""
    return let(F.regexp_replace(match, _WRAPPING, ""), lambda body: F.when(F.length(body) > 0, body).otherwise(match))


def _spans(text: Column, kind: int, pattern: str, value_from: str | None, least: int) -> Column:
    """Matches with at least ``least`` characters of value: structs (start, rank, kind, end, value), offsets in code points.

    Text between matches (split) and the matches themselves alternate, so running lengths give the offsets.
    """
    def placed(b):
        before = lambda i: F.when(i > 0, F.length(F.get(b["found"], i - 1))).otherwise(0)
        starts = running(F.transform(b["found"], lambda m, i: (F.length(F.get(b["between"], i)) + before(i)).cast("long")))
        return F.transform(F.arrays_zip(b["found"].alias("m"), starts.alias("at")), lambda x: F.struct(
            x["at"].alias("start"), F.lit(kind).alias("rank"), F.lit(KINDS[kind]).alias("kind"), (x["at"] + F.length(x["m"])).alias("end"),
            (key_body(x["m"]) if pattern == PRIVATE else F.regexp_extract(x["m"], value_from, 2) if value_from else x["m"]).alias("value")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.filter(let(both, placed), lambda s: F.length(s["value"]) >= least)


SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with spans: every candidate of a whole text (null: empty), by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tests = {
        "assign": (ASSIGN, ASSIGN, 8), "access": (ACCESS, None, 16), "hex": (HEX, None, 32), **{k: (p, None, 1) for k, p in ADDED.items()}}
    none = F.array().cast(SPANS)
    parts = [F.when(text.rlike(p), _spans(text, KINDS.index(k), p, v, n)).otherwise(none) for k, (p, v, n) in tests.items()]
    # one cheap test for most texts: each pattern needs one of these
    may = text.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA|[0-9a-f]{32}|gh[pousr]_|eyJ|PRIVATE KEY")
    return docs.withColumn("spans", F.when(may, F.array_sort(F.flatten(F.array(*parts)))).otherwise(none))


def entropy(value: Column) -> Column:
    """Bits per character of a string."""
    def bits(letters):
        n = F.size(letters)
        counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
        return -F.aggregate(counts, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))

    return let(F.split(value, ""), bits)


def looks_live(value: Column, kind: Column, least: int = LEAST) -> Column:
    """Long and varied enough, and no placeholder; a long key may spell a placeholder's word by chance."""
    placeholder = F.lower(value).rlike("example|sample|changeme|placeholder|your_|xxxx|dummy") & ~((kind == "private") & (F.length(value) >= KEY))
    bits = F.least(F.lit(ENTROPY), VARIED * F.log2(F.length(value).cast("double")))
    return (F.length(value) >= least) & (entropy(value) >= bits) & ~placeholder


def scan(docs: DataFrame, repository: str = "source", owner: str | None = None, wide: int = WIDE_OWNERS, keep_text: bool = True, least: int = LEAST) -> DataFrame:
    """``docs`` (doc_id, text, ...) with spans: an array of (start, rank, kind, end, value, owners, repositories, verdict) for each row.

    Candidates come from every whole text: the base kinds assign, access and hex (leftmost, not overlapping within a
    kind), and the added kinds of ``ADDED``. A private key's span is the whole key and its value the key's own characters. A value's hash is counted over the whole corpus by distinct repositories and
    distinct owners. The owner of a repository is the part of its name before the first slash, or the column ``owner``.

    verdict: ``example`` where ``wide`` or more owners hold the value, for such values were copied; ``weak`` where the
    value does not look like a live credential, for which it has at least ``least`` characters; ``live`` otherwise.

    Duplicate owners of a value go before the first shuffle, and only values held by two owners or more are joined back,
    dealt to ``PARTS`` parts, so neither a value nor a source that holds a third of all rows meets in one task. Null text is
    empty; null source is a repository of its own; rows that repeat stay rows; an empty table gives an empty table.
    Columns named spans, or beginning with an underscore as used here, are replaced. The texts are read once: rows and
    spans are written to the shared folder, so row numbers stay as they are; ``keep_text`` says whether texts go along.
    """
    repo = F.coalesce(F.col(repository).cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c != "spans" and (keep_text or c != "text")]
    base = candidates(docs.drop("spans")).withColumn("_row", F.monotonically_increasing_id()).withColumn("_repo", repo)
    base = base.withColumn("_owner", F.coalesce(F.col(owner).cast("string"), F.lit("")) if owner else F.substring_index("_repo", "/", 1))
    base = written(base.select(*keep, "_row", "_repo", "_owner", "spans"))
    hit = base.filter(F.size("spans") > 0)
    each = hit.select("_row", "_repo", "_owner", F.explode("spans").alias("s")).withColumn("_hash", F.sha2("s.value", 256))
    held = each.select("_hash", "_repo", "_owner").distinct().groupBy("_hash", "_owner").agg(F.count(F.lit(1)).alias("repos"))
    held = held.groupBy("_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories")).filter("repositories > 1")
    held = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    known = each.withColumn("_part", F.pmod("_row", F.lit(PARTS)).cast("int")).join(held, ["_hash", "_part"], "left")
    owners, repos = F.coalesce("owners", F.lit(1).cast("long")), F.coalesce("repositories", F.lit(1).cast("long"))
    verdict = F.when(owners >= wide, "example").when(looks_live(F.col("s.value"), F.col("s.kind"), least), "live").otherwise("weak")
    judged = known.select("_row", F.struct("s.start", "s.rank", "s.kind", "s.end", "s.value", owners.alias("owners"), repos.alias("repositories"), verdict.alias("verdict")).alias("s"))
    gathered = judged.groupBy("_row").agg(F.array_sort(F.collect_list("s")).cast(RESULT).alias("spans"))
    single = base.filter(F.size("spans") == 0).select(*keep, F.array().cast(RESULT).alias("spans"))
    return single.unionByName(hit.drop("spans").join(gathered, "_row").select(*keep, "spans"))


RESULT = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string,owners:bigint,repositories:bigint,verdict:string>>"


def listed(spans: Column) -> Column:
    """kind:start:end of spans in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, verdict: str = "live") -> Column:
    """The text with each span of this verdict replaced by its kind in brackets; spans that overlap become one.

    The pieces are gathered in an array and joined once. The text is cut at code points; each cut walks from its beginning.
    """
    def rebuilt(chosen):
        none = F.array().cast("array<string>")
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

        def step(acc, s):
            before = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0).cast("long")).cast("int"))
            mark = F.when(s["start"] >= acc["at"], F.array(before, F.concat(F.lit("["), s["kind"], F.lit("]")))).otherwise(none)
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

        done = F.aggregate(chosen, start, step)
        whole = let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, (d["at"] + 1).cast("int"), F.length(text))))
        return F.when(F.size(chosen) > 0, whole).otherwise(text)

    return let(F.filter(spans, lambda s: s["verdict"] == verdict), rebuilt)


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, their digest, all spans as text, and how many are live or examples."""
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda name, value: F.size(F.filter("spans", lambda s: s[name] == value)).cast("long")
    return found.select(
        "doc_id", *[count("kind", k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        *[count("verdict", v).alias(f"n_{v}") for v in ("live", "example")])
