"""Scalar text functions as Column expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from spanloom.functions.spans import WHITESPACE, _c, count_matches, let

# Fixed values, as the results depend on them.
EDGE = " \t\r\n*_\"'`“”‘’:;,.—–-()[]"
FUNCTION_WORDS = ("the of and a to in is it that are as with for its not they their but "
                  "by from this or on at be an which have has was").split()
SPECIES_WORDS = """
fish birds bird insects insect beetles beetle moths moth bats bat frogs frog worms worm crabs
crab spiders spider salamanders salamander lizards lizard snakes snake goats goat deer rats rat
mice mouse voles shrews shrimp snails snail slugs slug ants ant bees bee wasps wasp flies fly
midges gnats mites lichen lichens moss mosses fungi fungus mushrooms algae ferns fern grasses
grass trees tree shrubs reeds kelp coral corals jellyfish eels eel octopus squid plankton
bacteria microbes crickets cicadas termites butterflies dragonflies hawks eagles ravens crows
owls gulls herons otters seals whales dolphins foxes wolves bears cats dogs horses cattle sheep
pigs chickens humans people
""".split()
PARAM_ECHO = r"\b\d(?:\.\d)?\s*(?:/\s*3|out\s+of\s+3)\b"
CORPUS_WORD = r"[a-z][a-z'’-]*"
LABEL_WORD = r"[^\W_]+(?:'[^\W_]+)*+"
PROSE_WORD = r"[^\W_]+(?:['’][^\W_]+)*+"
STEMS = ("keeper tender steward gardener caretaker custodian warden guardian shepherd curator "
         "maintainer cultivator").split()
STATUSES = ("ok", "broken", "refusal", "off-topic")


# White space as Python sees it, spelled out: Java's Unicode class is several times slower.
SPACES = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def straighten(col) -> Column:
    """Curly apostrophes as straight ones."""
    return F.translate(_c(col), "’‘", "''")


def clean(col) -> Column:
    """A capture without markup, edge punctuation, leading article and final 's."""
    s = F.regexp_replace(straighten(col), SPACES + "+", " ")
    s = F.btrim(F.regexp_replace(F.btrim(s, F.lit(EDGE)), r"(?i)^(?:the|a|an)\s+", ""), F.lit(EDGE))
    return F.regexp_replace(s, r"'s\z", "")


def norm(col) -> Column:
    """Lower-cased ``clean``. Full case folding differs for a few letters such as ß."""
    return F.lower(clean(col))


def label_norm(col) -> Column:
    """Norm of a model's label: markup removed anywhere, one leading article dropped."""
    s = F.regexp_replace(straighten(col), r"[*_`\"“”#]", "")
    s = F.lower(F.btrim(F.regexp_replace(s, SPACES + "+", " "), F.lit(WHITESPACE)))
    return F.regexp_replace(s, r"^(the|a|an)\s+", "")


def quoted(col) -> Column:
    """A literal for use inside a Java pattern held in a column."""
    return F.concat(F.lit("\\Q"), F.replace(_c(col), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _whole(phrase, letters):
    """``phrase`` with no letter on either side. The literal comes first, so the engine can
    search for it before it looks around."""
    q = quoted(phrase)
    return F.concat(q, F.lit("(?![%s])(?<![%s]" % (letters, letters)), q, F.lit(")"))


def occurrences(lowered, phrase) -> Column:
    """Times ``phrase`` stands in the lower-cased text as a whole word or phrase."""
    return F.regexp_count(_c(lowered), _whole(phrase, "a-z"))


def occurrences_cased(text, phrase) -> Column:
    return F.regexp_count(_c(text), _whole(phrase, "A-Za-z"))


def holds_word(col, word) -> Column:
    """True where ``word`` stands in ``col`` with no letter on either side."""
    return F.rlike(_c(col), _whole(word, "a-z"))


def any_word(words, letters: str) -> str:
    """A regex of the words with no character of ``letters`` on either side, tried by first letter."""
    by_first = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    return "(?<![%s])(?:%s)(?![%s])" % (letters, "|".join("%s(?:%s)" % (c, "|".join(rest)) for c, rest in by_first.items()), letters)


def text_flag(text, status) -> Column:
    """Why a text is left out of the counts; '' where it is counted."""
    text, status = _c(text), _c(status)
    n_tokens = F.regexp_count(text, F.lit("[A-Za-z']+"))
    hits = F.regexp_count(text, F.lit("(?i)" + any_word(FUNCTION_WORDS, "A-Za-z'")))
    short = F.length(F.btrim(text, F.lit(WHITESPACE))) < 50
    return F.when(status.isNotNull() & ~status.isin("ok", ""), status).otherwise(
        let(n_tokens, lambda n: F.when(short | (n == 0), F.lit("empty"))
            .when(hits / n < 0.15, F.lit("not prose (word check)")).otherwise("")))


def n_lexicon_words(text, words=SPECIES_WORDS) -> Column:
    """Distinct words of the text that are in the list."""
    plain = [w for w in words if re.fullmatch("[a-z]+", w)]
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit(any_word(plain, "a-z")), F.lit(0))))


def param_echo(text) -> Column:
    """Numbers of the request's 0 to 3 scale that the text repeats."""
    return count_matches(text, PARAM_ECHO)


def words(col, pattern=LABEL_WORD) -> Column:
    return F.regexp_extract_all(_c(col), F.lit("(?U)" + pattern), F.lit(0))


def corpus_words(text) -> Column:
    """Distinct lower-case words of a text, as the document frequency counts them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit(CORPUS_WORD), F.lit(0)))


# What the loose comparison of quotes treats as equal.
FOLD_FROM, FOLD_TO = "‘’“”—–‑ ", "''\"\"--- "


def fold(text) -> Column:
    """Text for loose matching: quote marks, dashes and ellipsis plain, emphasis marks
    gone, runs of white space one space, lower case."""
    s = F.replace(F.translate(_c(text), FOLD_FROM, FOLD_TO), F.lit("…"), F.lit("..."))
    s = F.regexp_replace(F.translate(s, "*_`", ""), SPACES + "+", " ")
    return F.lower(s)


def fold_compare(col, kind: str) -> Column:
    """Smaller folds used only to compare: 'verdict', 'hand', 'evidence', 'label'."""
    col = _c(col)
    if kind == "verdict":
        bare = F.translate(F.lower(col), "*_\"“”‘’'#:.,", "")
        return F.regexp_replace(F.btrim(bare, F.lit(WHITESPACE)), "^(the|a|an) ", "")
    if kind == "hand":
        bare = F.btrim(straighten(F.lower(col)), F.lit(WHITESPACE))
        return F.regexp_replace(bare, "^(the|a|an|its|their) ", "")
    if kind == "evidence":
        bare = F.translate(straighten(col), "“”*", "\"\"")
        return F.lower(F.btrim(F.regexp_replace(bare, SPACES + "+", " "), F.lit(WHITESPACE)))
    if kind == "label":
        return F.translate(F.lower(col), "’‘“”—–", "''\"\"--")
    raise ValueError(kind)


def find_label(label, line) -> Column:
    """Zero-based place of a label in its line, exact or with case and quotes folded; else NULL."""
    exact = F.instr(_c(line), _c(label))
    loose = F.instr(fold_compare(line, "label"), fold_compare(label, "label"))
    return F.when(exact > 0, exact - 1).when(loose > 0, loose - 1)


def extract_json(raw, opening: str = "{") -> Column:
    """The first JSON value in free model output: from the first opener to the last closer."""
    pattern = {"{": r"(?s)\{.*\}", "[": r"(?s)\[.*\]", "any": r"(?s)[\[{].*[\]}]"}[opening]
    return F.nullif(F.regexp_extract(_c(raw), pattern, 0), F.lit(""))


def digits(col) -> Column:
    """A string of digits as INT, else NULL."""
    trimmed = F.btrim(_c(col), F.lit(WHITESPACE))
    return F.when(trimmed.rlike("^[0-9]{1,9}$"), trimmed.cast("int"))


def valid_numbers(values, n) -> Column:
    """Sentence numbers of an answer: digits within 1..n, distinct, sorted."""
    numbers = F.transform(F.coalesce(_c(values), F.array().cast("array<string>")), digits)
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.between(1, _c(n)))))


def level(part, alive, is_) -> Column:
    """Level of a text from its three evidence lists."""
    return (F.when(F.size(_c(is_)) > 0, "is").when(F.size(_c(alive)) > 0, "alive")
            .when(F.size(_c(part)) > 0, "part").otherwise("in"))


def level_rank(col) -> Column:
    order = F.create_map(*[x for k, v in (("in", 0), ("part", 1), ("alive", 2), ("is", 3))
                           for x in (F.lit(k), F.lit(v))])
    return F.element_at(order, _c(col))


def lab(model) -> Column:
    return F.split_part(_c(model), F.lit("/"), F.lit(1))


# The four periods. Dates before 2020 are errors and give no period.
ERAS = ("2024 and before", "first half of 2025", "second half of 2025", "2026")


def era(date) -> Column:
    d = _c(date).cast("date")
    return (F.when(d < F.lit("2020-01-01").cast("date"), None)
            .when(d < F.lit("2025-01-01").cast("date"), ERAS[0])
            .when(d < F.lit("2025-07-01").cast("date"), ERAS[1])
            .when(d < F.lit("2026-01-01").cast("date"), ERAS[2])
            .when(d.isNotNull(), ERAS[3]))


def half_year(date) -> Column:
    d = _c(date).cast("date")
    return F.concat(F.year(d).cast("string"), F.when(F.month(d) <= 6, " first half").otherwise(" second half"))


def band(score) -> Column:
    x = _c(score)
    return F.when(x >= 0.8, "hi").when(x >= 0.5, "mid").when(x > 0, "lo").otherwise("none")


def pct(a, b, places: int = 1) -> Column:
    """Percent, NULL where nothing was counted."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, F.round(a * 100.0 / b, places))


def stem_pattern(stems=STEMS) -> str:
    return "(?<![a-z])(%s)s?(?![a-z])" % "|".join(stems)


def stems_in(col, stems=STEMS) -> Column:
    """Lexicon words of a string, distinct and sorted."""
    found = F.regexp_extract_all(F.lower(_c(col)), F.lit(stem_pattern(stems)), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def is_bare(col, stems=STEMS) -> Column:
    """The string is a lexicon word and nothing more."""
    return _c(col).rlike("^(%s)s?$" % "|".join(stems))


def kept_phrases(label_norm_col, stems=STEMS) -> Column:
    """array<struct<word,form,x>>: the part before a hyphen and the phrase after "of"."""
    from spanloom.functions.spans import find_groups
    pattern = (r"(?:(?P<pre>[a-z'’]+)-)?(?<![a-z])(?P<word>%s)s?(?![a-z])"
               r"(?: of (?:the |this |that |its |their |an? )?(?P<of>[a-z'’-]+(?: [a-z'’-]+)?))?" % "|".join(stems))
    found = find_groups(label_norm_col, pattern, ("pre", "word", "of"))

    def forms(m):
        word = F.get(m["groups"], F.lit(1))
        return F.array(*[F.struct(word.alias("word"), F.lit(form).alias("form"),
                                  F.get(m["groups"], F.lit(k)).alias("x")) for form, k in (("pre", 0), ("of", 2))])

    return F.filter(F.flatten(F.transform(found, forms)), lambda f: f["x"] != "")


def kept_phrase_kinds(label_norm_col, stem: str) -> Column:
    """What a label says of one stem, as struct<word,holds,x,of,possessive,bare>."""
    col = _c(label_norm_col)
    pattern = (r"(?:([a-z'’]+)[- ])?(?<![a-z])%ss?(?![a-z])"
               r"(?: of (?:the |this |that |its |their |an? )?([a-z'’-]+(?: [a-z'’-]+)?))?" % stem)
    before = F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))
    hyphened = col.contains("-" + stem)
    return F.struct(
        F.lit(stem).alias("word"), (col.contains(stem) & col.rlike(pattern)).alias("holds"),
        F.when(hyphened, before).alias("x"), F.nullif(F.regexp_extract(col, pattern, 2), F.lit("")).alias("of"),
        (~hyphened & F.coalesce(before, F.lit("")).isin("its", "place's", "world's", "city's")).alias("possessive"),
        col.isin(stem, stem + "s").alias("bare"))
