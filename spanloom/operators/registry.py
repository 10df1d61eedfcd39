"""The pattern registry: every pattern is a row of data that one operator runs."""
from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from spanloom.functions.regex import first_characters

# ---------------------------------------------------------------------------------------
# Building blocks, masks, title lines, stoplists and patterns. Results depend
# on them letter by letter. «X» in a pattern stands for block X.
BLOCKS = {
    "CAPW": r"[A-Z][A-Za-zÀ-ɏ'’]*(?:-[A-Za-z][A-Za-zÀ-ɏ'’]*)*",
    "LINK": r"(?:of|in|at|on|for|with|under|beneath|between|beyond|within|"
            r"without|who|that|which|de|la|du|von)",
    "NAME": r"«CAPW»(?:[ \t]+(?:«LINK»[ \t]+(?:the[ \t]+|a[ \t]+)?)?«CAPW»)*",
    "MARK": r"(?:(?:\d{1,2}[.)]|[IVXLC]{1,5}[.)]|[-*•])[ \t]+)",
    "NUM": r"(?:\d{1,2}[.)]|[IVXLC]{1,5}[.)])[ \t]+",
    "BULLET": r"[-*•][ \t]+",
    "DASH": "—–",
    "OQ": "\"“",
    "CQ": "\"”",
    "CALL": r"\b(?:call(?:ed|s|ing)?|name[ds]?|naming|known(?:[ \t]+\w+){0,3}?[ \t]+as|"
            r"refer(?:s|red|ring)?[ \t]+to(?:[ \t]+\w+){0,2}?[ \t]+as|dubbed|termed)"
            r"(?:[ \t]+(?:it|them|her|him|this|these|those|themselves|itself|us|me|you))?",
    "AGENT": r"(?:[a-z]+(?:ers|ors)|folk|kin|born|people|ones|things|men|women|wives|hands|"
             r"children|creatures|beings|beasts|birds|fish|worms|flies|moths|crabs|mites|lice|"
             r"wrens|eels|hounds|walkers)",
    "LAND": "place|land|city|basin|valley|plateau|canyon|mountain|chamber|room|hollow|cave|cavern|"
            "forest|grove|garden|town|quarter|works|mesa|ridge|cistern|vault|hall|plain|shelf|bowl|"
            "crater|gorge|lagoon|marsh|swamp|tower|engine|factory|machine|mill|reef|ocean|sea|lake|"
            "pool|river|island|spire|cleft|rift|substation|station|building|structure|architecture|"
            "landscape|terrain|ground|stone|rock|water|mist|fog|dark|darkness|silence|sound|hum|roar",
}
MASKS = {"title_lines": r"^#{1,6}[ \t].*$|^[ \t]*«MARK»?\*\*[^*\n]+\*\*[ \t]*:?[ \t]*$"}
TITLES = {
    "heading": r"^#{1,6}[ \t]+«MARK»?\**(?P<name>[^\n#*(:«DASH»]+?)\**[ \t]*(?:[(:«DASH»].*)?$",
    "bold_line": r"^[ \t]*«MARK»?\*\*«MARK»?(?P<name>[^*\n(:«DASH»]+?)(?:[ \t]*[(:«DASH»][^*\n]*)?\*\*"
                 r"[ \t]*(?:\([^)\n]*\))?[ \t]*:?[ \t]*$",
    "list_head": r"^[ \t]*«MARK»(?P<name>[A-Z][^\n.:!?*(,]{1,60}?)[ \t]*(?:\([^)\n]*\))?[ \t]*$"
                 r"|^[ \t]*«NUM»(?P<name2>[A-Z][^\n.:!?*()«DASH»]{1,60}?)[ \t]*(?:\([^)\n]*\))?"
                 r"[ \t]*(?::|[«DASH»]| - )[ \t]*\S",
}
REJECT_CAPS = r"[A-Z]{2,}|^[A-Za-z]$"
STOPLISTS = {
    "common_caps": """
        i i'm i've i'd i'll
        monday tuesday wednesday thursday friday saturday sunday
        january february march april may june july august september october
        november december
        english french german latin greek roman spanish italian chinese japanese
        russian arabic victorian gothic euclidean darwinian newtonian cartesian
        earth god celsius fahrenheit kelvin morse
        """.split(),
    "section_words": """
        form forms behavior behaviour role roles appearance diet habitat
        reproduction communication physiology anatomy senses movement locomotion
        size color colour sound sounds culture society purpose function origin
        origins lifecycle note notes summary overview conclusion introduction
        description ecology biology morphology sensory metabolism feeding defense
        defence lifespan temperament intelligence language relationship
        relationships interaction interactions adaptation adaptations
        """.split() + [
        "what lives here", "what lives there", "who lives here", "who lives there",
        "who or what lives here", "inhabitants", "first inhabitants", "residents",
        "first residents", "fauna", "flora", "vegetation", "plants", "insects", "birds",
        "people", "others", "visitors", "what they do", "what they are", "how they live",
        "what they believe", "how they speak", "what it wants", "what they know",
        "what they want", "what it does", "first answer", "and you", "you", "names",
        "work", "speech", "atmosphere", "their bodies", "interaction with the environment",
    ],
    "not_agents": """
        corners louvers boulders corridors flowers floors shelters antlers towers chambers
        rivers waters layers fingers feathers shoulders clusters timbers embers numbers
        letters members borders others colors colours doors ladders gutters girders
        rafters shutters cylinders boilers rotors motors sensors reactors generators
        elevators conveyors mirrors anchors vapors vapours odors odours tremors errors
        interiors exteriors centers centres meters metres quarters papers fibers fibres
        characters matters manners orders powers showers summers winters hours
        containers filters transformers condensers radiators propellers rollers hammers
        cinders spiders otters beavers lobsters oysters vipers plovers tigers badgers
        roosters tiers
        """.split(),
}


@dataclass(frozen=True)
class Pattern:
    """One registry row. ``regex`` is a Python pattern whose group ``name`` (or ``name2``)
    is the capture; ``yields`` is name, statement or namer."""

    id: str
    version: int
    round: int
    family: str
    regex: str
    what: str = ""
    yields: str = "name"
    flags: str = ""
    stop: str | None = None
    reject: str | None = None
    mask: str | None = None
    max_words: int | None = None
    min_occ: int | None = None
    max_df: float | None = None
    title: str | None = None
    body: str | None = None
    position: str | None = None
    labels_from: tuple = field(default_factory=tuple)
    added: str = "2026-10-02"
    note: str = ""
    remark: str = ""
    origin_text: int | None = None
    origin_excerpt: str | None = None

    @property
    def title_like(self):
        return bool(self.title) or self.position == "title"


def fill(pattern: str) -> str:
    """Put the building blocks in."""
    while "«" in pattern:
        for name, block in BLOCKS.items():
            pattern = pattern.replace("«%s»" % name, block)
    return pattern


CAPS = dict(stop="common_caps", reject=REJECT_CAPS, max_words=10)
SECTION = dict(stop="section_words", flags="m", max_words=10)

# id, version, round, family, regex, what it catches, conditions
ROWS = [
    ("heading_second", 1, 2, "heading",
     r"^#{1,6}[ \t]+[^\n(:«DASH»]*?(?::[ \t]+|[ \t][«DASH»][ \t]*|\()[*«OQ»]*(?P<name>[^\n#*():«DASH»«CQ»]+?)[*«CQ»]*\)?[ \t]*\**[ \t]*$",
     "second part of a heading", dict(SECTION, position="title")),
    ("bold_second", 1, 2, "markup",
     r"^[ \t]*«MARK»?\*\*[^*\n(:«DASH»]+?(?::[ \t]+|[ \t][«DASH»][ \t]*)(?P<name>[^*\n():«DASH»]+?)[ \t]*\*\*[ \t]*:?[ \t]*$",
     "second part of a bold title line", dict(SECTION, position="title")),
    ("bold_paren_alias", 2, 2, "markup",
     r"\*\*[^*\n(]+?[ \t]*\([*«OQ»]*(?P<name>[^)\n]+?)[*«CQ»]*\)[ \t]*:?[ \t]*\*\*"
     r"|\*\*[^*\n(]+?\*\*:?[ \t]*\([*«OQ»]*(?P<name2>[^)\n]{2,60}?)[*«CQ»]*\)",
     "alias in parentheses in or after a bold span", dict(max_words=10)),
    ("bold_subject", 2, 3, "markup",
     r"^[ \t]*«MARK»?\*\*(?:[Tt]he[ \t]+)?(?P<name>«NAME»)\*\*[ \t]+(?=[a-z])",
     "bold span that opens a paragraph as its subject", dict(SECTION, reject=REJECT_CAPS)),
    ("bold_lead", 2, 2, "markup",
     r"^[ \t]*«MARK»?\*\*(?P<name>[^*\n(:]+?)(?:[ \t]*\([^)\n]*\))?[ \t]*:?[ \t]*\*\*[ \t]*[:«DASH»-][ \t]*\S"
     r"|^[ \t]*«MARK»?\*\*(?P<name2>[^*\n(:]+?)(?:[ \t]*\([^)\n]*\))?[ \t]*:[ \t]*\*\*[ \t]*\S",
     "bold span at the head of a line before its description", dict(SECTION, position="title")),
    ("bold_inline_cap", 4, 3, "markup",
     r"(?:(?:(?<=[A-Za-z,;:)«CQ»])|(?<=[A-Za-z)«CQ»][.!?]))[ \t]+|(?<=[«DASH»(]))"
     r"\*\*(?:[Tt]he[ \t]+|[Aa]n?[ \t]+)?(?P<name>«NAME»)(?:['’]s)?\*\*",
     "capitalised name in bold inside a paragraph", CAPS),
    ("bold_inline_lower", 3, 6, "markup",
     r"(?:(?<=[A-Za-z,;:)])[ \t]+|(?<=[«DASH»]))\*\*(?P<name>[a-z]+(?:-[a-z]+)+)\*\*"
     r"|\b(?:[Tt]he|[Aa]n?|[Tt]hese|[Tt]hose)[ \t]+\*\*(?P<name2>[a-z][^*\n]{1,40}?)\*\*",
     "lower-case term in bold inside a sentence", dict(max_words=3)),
    ("italic_cap", 3, 3, "markup",
     r"(?<![*\w])\*(?:[Tt]he[ \t]+)?(?P<name>«NAME»)\*(?![*\w])",
     "capitalised name in italics", CAPS),
    ("italic_lower", 2, 2, "markup",
     r"(?<![*\w])\*(?P<name>[a-z]+(?:-[a-z]+)+)\*(?![*\w])"
     r"|\b(?:[Tt]he|[Aa]n?|[Tt]hese|[Tt]hose)[ \t]+\*(?P<name2>[a-z][^*\n]{1,40}?)\*(?![*\w])",
     "lower-case term in italics", dict(max_words=3)),
    ("list_bullet_lead", 1, 2, "list",
     r"^[ \t]*«BULLET»(?P<name>[A-Z][^\n.:!?*()«DASH»]{1,60}?)[ \t]*(?:\([^)\n]*\))?[ \t]*(?::|[«DASH»]| - )[ \t]*\S",
     "bulleted item that opens with a short phrase", dict(SECTION, max_words=6, position="title")),
    ("paren_quoted_alias", 1, 2, "frame",
     r"\([^()\n]{0,60}?[«OQ»](?P<name>[^«CQ»\n]{2,40}?)[,.]?[«CQ»][^()\n]{0,30}\)",
     "quoted name inside parentheses", dict(max_words=6)),
    ("the_cap", 3, 3, "capitalisation", r"\b[Tt]he[ \t]+(?P<name>«NAME»)",
     "'the' and a capitalised run", dict(CAPS, mask="title_lines")),
    ("a_cap", 3, 3, "capitalisation", r"\b[Aa]n?[ \t]+(?P<name>«NAME»)",
     "'a' or 'an' and a capitalised run", dict(CAPS, mask="title_lines")),
    ("cap_mid", 3, 3, "capitalisation",
     r"(?<![A-Za-z'’-])(?!(?:the|a|an)[ ])[a-z][a-z'’-]*[,;]?[ ](?P<name>«NAME»)",
     "capitalised run inside a sentence without an article", dict(CAPS, mask="title_lines")),
    ("or_alias", 2, 3, "capitalisation",
     r",?[ \t]+or(?:,?[ \t]+(?:simply|just|perhaps|sometimes|more[ \t]+often|occasionally|else))?,?"
     r"[ \t]+(?:the[ \t]+)?(?:\*{1,2}|[«OQ»])?(?:[Tt]he[ \t]+)?(?P<name>«NAME»)",
     "one more name after 'or'", dict(CAPS, mask="title_lines")),
    ("binomial", 2, 2, "frame",
     r"(?:(?<!\*)\*|\()(?P<name>[A-Z][a-z]{3,}[ \t]+[a-z]{2,}"
     r"(?:us|is|um|a|ae|i|ans|ens|ox|or|es|as|on|yx|ix|ex))(?=\*(?!\*)|\)|,)",
     "two-word Latin-style species name", dict(max_words=2)),
    ("frame_call_marked", 3, 3, "frame",
     r"«CALL»(?:,[^,\n]{1,60},)?(?:[ \t]+(?:simply|only|just|merely))?"
     r"[ \t]+(?:the[ \t]+|a[ \t]+|an[ \t]+)?(?:\*{1,2}|[«OQ»'‘])?(?:[Tt]he[ \t]+)?(?:\*{1,2})?(?P<name>«NAME»)",
     "verb of naming and a capitalised name", CAPS),
    ("frame_call_quoted", 1, 1, "frame",
     r"«CALL»(?:[ \t]+(?:simply|only|just|merely))?[ \t]+(?:the[ \t]+|a[ \t]+|an[ \t]+)?"
     r"(?:\*{1,2}|[«OQ»‘])(?P<name>[a-z][^*«CQ»’\n]{1,50}?)(?:\*{1,2}|[«CQ»’])",
     "verb of naming and a marked lower-case term", dict(max_words=6)),
    ("frame_means", 1, 2, "frame",
     r"\b(?:means?|meaning|meant|translates?|translated|translation)(?:[ \t]+[a-z]+){0,5}?"
     r"[ \t,:—]*(?:\*{1,2}|[«OQ»‘])(?P<name>[^*«CQ»’\n]{3,80}?)[,.]?(?:\*{1,2}|[«CQ»’])",
     "name given by its meaning", dict(max_words=14)),
    ("there_are_the", 1, 1, "frame",
     r"\bThere[ \t]+(?:are|is)[ \t]+(?:also[ \t]+)?the[ \t]+(?P<name>[a-z][a-z-]*(?:[ \t]+[a-z][a-z-]*){0,3}?)"
     r"(?=[.,;:«DASH»]|[ \t]+(?:who|that|which|and)\b|[ \t]+\()",
     "'There are the' and a lower-case kind", dict(max_words=4)),
    ("the_hyphen_agent", 1, 2, "frame",
     r"\b[Tt]he[ \t]+(?P<name>[a-z]+(?:-[a-z]+)*-«AGENT»)\b(?![ \t]*-)",
     "'the' and a hyphenated agent compound", dict(max_words=3)),
    ("the_hyphen_compound", 2, 2, "frame",
     r"\b[Tt]he[ \t]+(?!(?:[a-z]+-)+«AGENT»\b)(?:(?P<name>[a-z]+(?:-[a-z]+)*-[a-z]+s)\b(?![ \t]*-)"
     r"|(?P<name2>[a-z]+(?:-[a-z]+)+)"
     r"(?=[ \t]*(?:[.,;:«DASH»]|$)|[ \t]+(?:are|is|were|was|have|has|do|does|who|that|which|"
     r"live|lives|move|moves|come|comes|will|can|may|must|never|always|also|still|only)\b))",
     "'the' and another hyphenated compound", dict(flags="m", max_words=4)),
    ("dash_appositive", 1, 2, "frame",
     r"—[ \t]*the[ \t]+(?P<name>[a-z][a-z-]+(?:[ \t]+[a-z][a-z-]+)?)[ \t]*—",
     "short noun phrase between dashes", dict(max_words=2)),
    ("pronoun_is_the", 1, 1, "frame",
     r"\b(?:They|These|Those)[ \t]+are[ \t]+the[ \t]+(?P<name>[a-z][a-z-]*(?:[ \t]+[a-z][a-z-]*){0,2}?)(?=[.,;:«DASH»])"
     r"|\b(?:She|He|It|This)[ \t]+is[ \t]+the[ \t]+(?P<name2>[a-z][a-z-]*(?:[ \t]+[a-z][a-z-]*){0,2}?)(?=[.,;:«DASH»])",
     "'They are the X.'", dict(max_words=3)),
    ("those_who_lower", 1, 1, "descriptive",
     r"\b(?P<name>(?:[Tt]hose|[Tt]he[ \t]+ones?)[ \t]+(?:who|that|which)[ \t]+[^.,;:\n«DASH»()]{3,70})",
     "'those who ...' in place of a name", dict(max_words=14)),
    ("anti_name", 2, 3, "statement",
     r"\b(?:no[ \t]+names?|nameless|unnamed|un-?nam(?:e)?able|"
     r"without[ \t]+(?:a[ \t]+)?names?|never[ \t]+(?:been[ \t]+)?named|"
     r"rather[ \t]+than[ \t]+names?|not[ \t]+(?:a|its|their|her|his)[ \t]+(?:real[ \t]+|true[ \t]+)?name|"
     r"no[ \t]+word[ \t]+for[ \t]+(?:itself|themselves|what[ \t]+(?:it|they))|"
     r"not[ \t]+(?:easily[ \t]+|readily[ \t]+)?named|(?:cannot|can't|could[ \t]+not)[ \t]+be[ \t]+named|"
     r"(?:hard|difficult|impossible)[ \t]+to[ \t]+name|resists?[ \t]+(?:naming|names?)|"
     r"answers?[ \t]+to[ \t]+no[ \t]+name|no[ \t]+need[ \t]+(?:for|of)[ \t]+(?:a[ \t]+)?names?)\b",
     "sentence that says there is no name", dict(yields="statement", flags="i")),
    ("quoted_cap", 1, 3, "frame",
     r"\b(?:[Tt]he|[Tt]hese|[Tt]hose|[Aa]n?|[Tt]heir|[Ii]ts)[ \t]+[«OQ»](?:[Tt]he[ \t]+)?(?P<name>«NAME»)[,.]?[«CQ»]",
     "quoted capitalised name after a determiner", CAPS),
    ("quoted_cap_bare", 1, 3, "frame",
     r"(?<![A-Za-z])[«OQ»](?:[Tt]he[ \t]+)?(?P<name>«NAME»)[,.]?[«CQ»]",
     "capitalised run that fills quotation marks", CAPS),
    ("live_the", 1, 3, "frame",
     r"\b(?:live|lives|dwell|dwells|move|moves|drift|drifts|roam|roams|crawl|crawls|swim|swims|nest|nests|"
     r"lurk|lurks|wait|waits|come|comes|work|works)[ \t]+the[ \t]+"
     r"(?P<name>[a-z][a-z-]+(?:[ \t]+[a-z][a-z-]+)?)(?=[,.:;«DASH»]|[ \t]+(?:who|that|which|and)\b)",
     "kind named after a verb of living", dict(max_words=2)),
    ("the_agent_recurring", 2, 3, "frame", r"\b[Tt]he[ \t]+(?P<name>[a-z]+(?:ers|ors))\b(?![ \t]*-)",
     "recurring '-ers' noun after 'the'", dict(stop="not_agents", max_words=1, min_occ=3, max_df=0.15)),
    ("the_mod_being", 1, 3, "descriptive",
     r"(?:^|(?<=[.!?][ ])|(?<=\n))The[ \t]+(?!(?:other|same|only|first|second|third|last|next|few|many|rest|"
     r"remaining|[a-z]+er|[a-z]+est)[ \t])(?P<name>[a-z][a-z-]+[ \t]+(?:beings|ones|folk|people|creatures|"
     r"things|animals|birds|fish|kind))[ \t]+(?=[a-z])",
     "'The <word> beings' at a sentence start", dict(flags="m", max_words=2)),
    ("hyphen_agent_bare", 1, 3, "frame",
     r"(?<![A-Za-z-])(?<![Tt]he[ ])(?P<name>[a-z]+(?:-[a-z]+)*-«AGENT»)\b(?![ \t]*-)",
     "agent compound without 'the'", dict(max_words=1, min_occ=2)),
    ("as_known", 1, 3, "frame",
     r"\b[Tt]he[ \t]+(?P<name>[a-z][a-z-]+(?:[ \t]+[a-z][a-z-]+)?)[ \t]*[«DASH»,(][ \t]*as[ \t]+(?:they|it|she|he)[ \t]+"
     r"(?:are|is|were|was)[ \t]+(?:known|called|named)",
     "'the X, as they are known'", dict(max_words=2)),
    ("name_talk", 1, 3, "statement", r"\b(?:names?|named|naming|nameless|unnamed|namers?)\b",
     "sentence that uses the word name", dict(yields="statement", flags="i")),
    *[("%s_%s" % (kind, cell), 1, 5, family, TITLES[kind], "%s, in the body: %s" % (kind.replace("_", " "), what),
       dict(SECTION, max_words=words, title=kind, body=body, labels_from=sources, added="2026-10-03",
            **({} if body == "only" else dict(max_df=0.15))))
      for kind, family, words, sources in (
          ("heading", "heading", 10, ("md_heading", "heading_recurring")),
          ("bold_line", "markup", 10, ("bold_line", "bold_line_recurring")),
          ("list_head", "list", 6, ("list_head_line", "list_num_lead", "list_head_recurring")))
      for cell, body, what in (("only", "only", "nowhere"), ("again_lower", "lower", "lower case"),
                               ("again_cased", "cased", "same capitals"))],
    ("there_are_bare", 2, 6, "frame",
     r"\bThere[ \t]+(?:are|is)[ \t]+(?:also[ \t]+)?(?!(?:no|the|a|an|other|only|also|some|many|few|several|"
     r"larger|smaller|other|two|three|four|five|six|tall|old|new|more)\b)"
     r"(?P<name>[a-z]+(?:-[a-z]+)+|[a-z]+[ \t]+[a-z]+s)(?=[ \t]+(?:that|which|who)\b|[,:;])",
     "'There are X that'", dict(max_words=2, added="2026-10-03")),
    ("paren_cap_alias", 1, 6, "frame",
     r"(?<=[A-Za-z)*])[ \t]*\((?:[Tt]he[ \t]+)?(?P<name>«NAME»)\)",
     "capitalised run alone in parentheses", dict(CAPS, max_words=6, added="2026-10-03")),
    ("frame_call_plain", 2, 6, "frame",
     r"\b(?:(?:is|are|was|were)[ \t]+called|call(?:s|ed)?[ \t]+(?:it|them|her|him))[ \t]+the[ \t]+"
     r"(?P<name>[a-z][a-z-]*(?:[ \t]+[a-z][a-z-]*)?)(?=[,.;:]|[ \t]+(?:since|because|for|though|although|as|if|and)\b)",
     "unmarked designation after a verb of naming", dict(max_words=2, added="2026-10-03")),
    ("the_pair_second", 1, 6, "frame",
     r"\b[Tt]he[ \t]+[a-z]+(?:-[a-z]+)*-«AGENT»[ \t]+and[ \t]+(?P<name>[a-z]+(?:-[a-z]+)*-«AGENT»)\b",
     "second of two agent compounds under one 'the'", dict(max_words=1, added="2026-10-03")),
    ("bold_lead_titlecase", 1, 6, "markup",
     r"^[ \t]*«MARK»?\*\*(?P<name>«CAPW»[ \t]+«CAPW»(?:[ \t]+«CAPW»)?)\*\*[ \t]*:[ \t]*\S",
     "bold lead of two or three capitalised words",
     dict(SECTION, reject=REJECT_CAPS, max_words=3, labels_from=("bold_lead",), added="2026-10-03")),
    ("who_names", 1, 6, "frame",
     r"\b(?P<name>(?:(?:[Tt]he|[Ii]ts|[Tt]heir|[Oo]ur|[Hh]is|[Hh]er)[ \t]+)?[A-Za-z][a-z]+(?:[ \t]+[a-z]+)?[ \t]+"
     r"(?:might[ \t]+|would[ \t]+|sometimes[ \t]+|simply[ \t]+|still[ \t]+|once[ \t]+)?"
     r"(?:call|calls|called|name|named|names|dubbed|dub|refer[ \t]+to)[ \t]+(?:it|them|her|him|themselves|itself|ourselves|this|these|those|me|us|you))\b"
     r"|(?:called|named|known|dubbed)[ \t]+[^.\n,]{0,40}?[ \t]+by[ \t]+(?P<name2>(?:the[ \t]+)?[a-z]+(?:[ \t]+[a-z]+)?)\b",
     "who gives the name", dict(yields="namer", max_words=6, added="2026-10-03")),
    ("place_is_inhabitant", 1, 7, "statement",
     r"\b(?:what[ \t]+lives[ \t]+(?:here|there|in[ \t]+(?:it|this[ \t]+place))[ \t]+is[ \t]+(?:mostly[ \t]+|simply[ \t]+|largely[ \t]+|only[ \t]+|not[ \t]+a[ \t]+\w+[ \t]+but[ \t]+)?(?:the[ \t]+)?(?:«LAND»)(?:[ \t]+itself)?\b"
     r"|(?:the[ \t]+)?(?:«LAND»)[ \t]+(?:itself[ \t]+)?is[ \t]+(?:alive|a[ \t]+being|a[ \t]+creature|an[ \t]+organism|a[ \t]+single[ \t]+organism|the[ \t]+(?:only[ \t]+|true[ \t]+|real[ \t]+|sole[ \t]+)?(?:inhabitant|resident|creature|being|occupant|tenant|organism)|what[ \t]+lives[ \t]+(?:here|there))\b"
     r"|(?:inhabitant|resident|creature|being|occupant|tenant|organism)[ \t]+(?:here[ \t]+|there[ \t]+)?is[ \t]+the[ \t]+(?:«LAND»)(?:[ \t]+itself)?\b"
     r"|(?:is|are)[ \t]+the[ \t]+(?:«LAND»)[ \t]+itself\b"
     r"|the[ \t]+(?:«LAND»)[ \t]+is[ \t]+(?:it|them)\b)",
     "sentence that says the place is the inhabitant", dict(yields="statement", flags="i", added="2026-10-03")),
    ("being_is_process", 1, 7, "statement",
     r"\b(?:is|are)[ \t]+not[ \t]+(?:a[ \t]+|an[ \t]+|one[ \t]+)?(?:creature|creatures|animal|animals|being|beings|species|organism|organisms|people|person|thing|things|body|bodies|inhabitant|inhabitants)[ \t]+"
     r"(?:but|so[ \t]+much[ \t]+as|at[ \t]+all[ \t]+but)[ \t]+(?:a[ \t]+|an[ \t]+|the[ \t]+)?(?:process|processes|condition|tendency|habit|pattern|patterns|state|weather|function|relationship|argument|disposition|appetite|temperament|verb|rhythm|property|phenomenon|event|events|arrangement|economy|metabolism|conversation|decision|preference)\b",
     "sentence that says the being is a process", dict(yields="statement", flags="i", added="2026-10-03")),
    ("call_them_bare", 2, 8, "frame",
     r"(?:^|(?<=[.!?][ ])|(?<=\n))Call[ \t]+(?:them|it|her|him)[ \t]+(?!(?:home|that|this|it|anything|something|nothing|what|whatever|alive|dead|people|animals|plants)\b)"
     r"(?P<name>[a-z][a-z-]+)(?=[,.;:]|[ \t]+(?:for|since|because|if|though|although)\b)",
     "'Call them X,'", dict(max_words=1, added="2026-10-03")),
    ("rare_plural", 1, 8, "capitalisation", r"\b[Tt]he[ \t]+(?P<name>[a-z]{5,}s)\b",
     "plural that almost no other text uses", dict(max_words=1, max_df=0.0003, min_occ=2, added="2026-10-03")),
    ("the_ones_recurring", 1, 8, "descriptive",
     r"\b[Tt]he[ \t]+(?P<name>[a-z]+(?:-[a-z]+)?[ \t]+(?:ones|things))\b",
     "'the X ones' used again", dict(max_words=2, min_occ=2, added="2026-10-03")),
    ("they_are_bare", 1, 8, "frame",
     r"\b(?:They|These|Those)[ \t]+are[ \t]+(?P<name>[a-z]+(?:ers|ors|ards|ists|folk|kin|men|women))\b(?![ \t]+(?:of|in|at|who|that|which))",
     "'They are X' with a role word", dict(max_words=1, added="2026-10-03")),
    ("the_hyphen_agent_singular", 2, 8, "frame",
     r"\b[Tt]he[ \t]+(?P<name>[a-z]+(?:-[a-z]+)*-(?!(?:water|color|colour|cover|matter|cluster|fiber|fibre|floor|filter|"
     r"feeder|layer|order|border|corner|center|centre|chamber|tower|river|quarter|shelter|number|letter|power|"
     r"ember|cinder|timber|weather|paper|copper|silver|other|ever|over|under|after|inner|outer|upper|lower)\b)"
     r"(?:[a-z]+(?:er|or)|man|woman|keeper|maker|tender|born|kin))\b(?![ \t]*-)",
     "singular agent compound used again", dict(max_words=1, min_occ=2, added="2026-10-03")),
]
# End of fixed values.
# ---------------------------------------------------------------------------------------

REGISTRY = [Pattern(i, v, r, fam, fill(rx), what, **cond) for i, v, r, fam, rx, what, cond in ROWS]
MASK_REGEX = {k: fill(v) for k, v in MASKS.items()}
TITLE_REGEX = {k: fill(v) for k, v in TITLES.items()}


OWN_REGEX = {p.id: p.regex for p in REGISTRY}

# What a text must hold for a pattern to match at all: any one of these strings. A plain
# substring test is far cheaper than a regex that fails at every position. None holds a
# blank, for the patterns take any run of blanks and tabs.
NAMING = ("call", "name", "naming", "known", "refer", "dubbed", "termed")
NEEDS = {
    "heading_second": "#", "bold_second": "**", "bold_paren_alias": "**", "bold_subject": "**", "bold_lead": "**",
    "bold_inline_cap": "**", "bold_inline_lower": "**", "italic_cap": "*", "italic_lower": "*",
    "list_bullet_lead": ("-", "*", "•"), "paren_quoted_alias": "(", "binomial": ("*", "("), "or_alias": "or",
    "frame_call_marked": NAMING, "frame_call_quoted": NAMING, "frame_means": ("mean", "transl"),
    "there_are_the": "There", "the_hyphen_agent": "-", "the_hyphen_compound": "-", "dash_appositive": "—",
    "pronoun_is_the": "the", "those_who_lower": ("who", "that", "which"),
    "quoted_cap": ("\"", "“"), "quoted_cap_bare": ("\"", "“"), "the_mod_being": "The", "hyphen_agent_bare": "-",
    "as_known": ("known", "called", "named"),
    "heading_only": "#", "heading_again_lower": "#", "heading_again_cased": "#",
    "bold_line_only": "**", "bold_line_again_lower": "**", "bold_line_again_cased": "**",
    "list_head_only": (".", ")", "-", "*", "•"), "list_head_again_lower": (".", ")", "-", "*", "•"),
    "list_head_again_cased": (".", ")", "-", "*", "•"),
    "there_are_bare": "There", "paren_cap_alias": "(", "frame_call_plain": "call", "the_pair_second": "-",
    "bold_lead_titlecase": "**", "who_names": ("call", "name", "dub", "refer", "known"),
    "call_them_bare": "Call", "the_ones_recurring": ("ones", "things"), "they_are_bare": ("They", "These", "Those"),
    "the_hyphen_agent_singular": "-",
    "the_cap": ("the", "The"), "the_agent_recurring": ("the", "The"), "rare_plural": ("the", "The"), "a_cap": ("a", "A"),
}
# The same for patterns that ignore case; compared with the lower-cased text.
NEEDS_LOWER = {"anti_name": ("nam", "word"), "name_talk": ("name", "naming"), "being_is_process": "not", "place_is_inhabitant": ("is", "itself")}

# Words, runs of a-z in the lower-cased text, of which a match holds one from each group: they stand whole in the pattern,
# with a boundary or a blank on either side. All words of a text are met with all of these at once.
CALLING = "call called calls calling name named names naming known refer refers referred referring dubbed termed".split()
WORDS = {
    "frame_call_marked": (CALLING,), "frame_call_quoted": (CALLING,), "frame_call_plain": (("call", "calls", "called"), ("the",)),
    "frame_means": ("mean means meaning meant translate translates translated translation".split(),),
    "place_is_inhabitant": (BLOCKS["LAND"].split("|"), ("is", "are")),
    "being_is_process": (
        "creature creatures animal animals being beings species organism organisms people person thing things body bodies inhabitant inhabitants".split(),
        ("is", "are"), ("not",), ("but", "so", "at"),
        "process processes condition tendency habit pattern patterns state weather function relationship argument disposition appetite temperament verb "
        "rhythm property phenomenon event events arrangement economy metabolism conversation decision preference".split()),
    "anti_name": ("name names named nameless unnamed unnamable unnameable namable nameable naming word".split(),),
    "name_talk": ("name names named naming nameless unnamed namer namers".split(),),
    "live_the": ("live lives dwell dwells move moves drift drifts roam roams crawl crawls swim swims nest nests lurk lurks wait waits come comes work works".split(), ("the",)),
    "pronoun_is_the": (("are", "is"), ("they", "these", "those", "she", "he", "it", "this"), ("the",)),
    "the_mod_being": ("beings ones folk people creatures things animals birds fish kind".split(), ("the",)),
    "those_who_lower": (("those", "one", "ones"), ("who", "that", "which")),
    "the_ones_recurring": (("ones", "things"), ("the",)),
    "they_are_bare": (("they", "these", "those"), ("are",)),
    "there_are_the": (("there",), ("the",)),
    "or_alias": (("or",),),
    "call_them_bare": (("call",), ("them", "it", "her", "him")),
}
#: Characters that Java and Python take for an ASCII letter where a pattern ignores case.
LIKE_ASCII = ("ſKıİ", "skii")


def needs(pattern: Pattern):
    """(strings, lower) of which one must stand in the text; () where nothing is known."""
    for table, lower in ((NEEDS, False), (NEEDS_LOWER, True)):
        wanted = table.get(pattern.id)
        if wanted and OWN_REGEX.get(pattern.id) == pattern.regex:
            return ((wanted,) if isinstance(wanted, str) else wanted), lower
    return (), False


def needed_words(pattern: Pattern):
    """Groups of words of which a text must hold one each; () where nothing is known."""
    return WORDS.get(pattern.id, ()) if OWN_REGEX.get(pattern.id) == pattern.regex else ()


def tuned(regex: str) -> str:
    """The same pattern in a form Java runs faster.

    Loops over groups become possessive, for Java recurses at each repetition of any other
    one. The run of capitalised words and its hyphenated parts are followed by nothing that
    could stand inside them. A chain that must end in an agent word is read as stretches of
    parts that are none, each closed by one that is; the last such stretch is where the
    plain pattern ends as well. A word boundary in front of a letter moves behind it, and one in front
    of several words waits until the character is one that they begin with, so most positions fail at a
    plain character test. Runs of letters before a blank give nothing back.
    """
    run, word, agent = fill("«NAME»"), fill("«CAPW»"), fill("«AGENT»")
    held = word[:-1] + "*+"
    regex = regex.replace(run, run.replace(word, held)[:-1] + "*+").replace(word + "[", held + "[").replace(word + ")", held + ")").replace(word + "(", held + "(")
    part = r"[a-z]+(?:(?:-(?!%s\b)[a-z]+)*+-%s\b)" % (agent, agent)
    regex = regex.replace(r"[a-z]+(?:-[a-z]+)*-" + agent, part + "++")
    regex = regex.replace(r"(?!(?:[a-z]+-)+%s\b)" % agent, "(?!" + part + ")")
    regex = regex.replace(r"[a-z]+(?:-[a-z]+)*-[a-z]+s)\b", r"[a-z]+(?:-[a-z]+)++(?<=[a-z]s))\b")
    regex = regex.replace(r"[a-z]+(?:-[a-z]+)*-(?!(?:water", r"[a-z]+(?:-[a-z]+(?=-))*+-(?!(?:water")
    regex = regex.replace(r"[a-z]+(?:-[a-z]+)+)", r"[a-z]+(?:-[a-z]+)++)").replace(r"[a-z]+(?:-[a-z]+)+|", r"[a-z]+(?:-[a-z]+)++|")
    regex = regex.replace(r"[A-Za-z][a-z]+(?:[ \t]+[a-z]+)?[ \t]+(?:might", r"[A-Za-z][a-z]++(?:[ \t]++[a-z]++)?[ \t]++(?:might")
    regex = regex.replace(r"[a-z][a-z'’-]*[,;]?[ ]", r"[a-z][a-z'’-]*+[,;]?+[ ]")
    regex = regex.replace(r"(?<![A-Za-z'’-])(?!(?:the|a|an)[ ])[a-z]", r"(?=[a-z])(?<![A-Za-z'’-])(?!(?:the|a|an)[ ])[a-z]")
    if "|" in regex and not regex.startswith((r"\b[Tt]he", r"\b[Aa]n?")):
        first = first_characters(regex[2:]) if regex.startswith(r"\b") else None
        return "(?=[%s])%s" % ("".join(sorted(first)), regex) if first else regex
    return re.sub(r"^\\b(\[[A-Za-z]+\]|[A-Za-z])", r"\1(?<!\\w\1)", regex)


JAVA_READY = {p.regex: tuned(p.regex) for p in REGISTRY}

PATTERN_DDL = ("id STRING, version INT, round INT, family STRING, regex STRING, what STRING, yields STRING, "
               "flags STRING, stop STRING, reject STRING, mask STRING, max_words INT, min_occ INT, max_df DOUBLE, "
               "title STRING, body STRING, position STRING, labels_from ARRAY<STRING>, added STRING, note STRING, "
               "remark STRING, origin_text BIGINT, origin_excerpt STRING, status STRING, retired_reason STRING")


def registry_table(spark, patterns=None, status="active", reasons=None):
    """Registry rows as a DataFrame; ``reasons`` maps (id, version) to why it was retired."""
    rows = []
    for p in REGISTRY if patterns is None else patterns:
        row = asdict(p)
        row["labels_from"] = list(p.labels_from)
        row["status"], row["retired_reason"] = status, (reasons or {}).get((p.id, p.version))
        rows.append(tuple(row[c.split()[0]] for c in PATTERN_DDL.split(", ")))
    return spark.createDataFrame(rows, PATTERN_DDL)


def registry_history(active, retired):
    """Active and retired versions in one table."""
    return active.unionByName(retired, allowMissingColumns=True)


def stoplist_table(spark, stoplists=None):
    rows = [(name, w) for name, ws in (stoplists or STOPLISTS).items() for w in ws]
    return spark.createDataFrame(rows, "name STRING, word STRING")
