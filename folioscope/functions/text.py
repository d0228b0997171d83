"""Text functions as column expressions.

Lengths are in code points. White space is the set that browsers use (with NBSP and the Unicode
spaces), and word boundaries are those of ASCII words, so results don't depend on Java's classes.
Every function gives null for a null input unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, and patterns whose matches decide results.
SPACE = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: White space that is not just one plain space: a run, or another character of the set. Most characters are ruled out by the two ranges in front.
UNEVEN = r"(?![!-~\x{A1}-\x{167F}])(?:" + SPACE.replace(r"\x20", "") + SPACE + "*+| " + SPACE + "++)"
#: The same set for Python.
PY_SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
ADVICE = r"(?i)\b(should\s+(?:buy|sell|hold|invest)|buy\s+(?:now|the\s+(?:dip|stock|ipo|offering))|time\s+to\s+(?:buy|sell)|we\s+recommend|our\s+recommendation|recommend(?:ation)?\s+to\s+(?:buy|sell|hold)|strong\s+(?:buy|sell)|must[-\s]buy|attractive\s+valuation|under-?valued|over-?valued|guaranteed(?:\s+returns?)?|safe\s+investment|(?:price|profit|return)\s+targets?)\b"
PARSER_WORDS = r"(?i)candidate|parser found|section presence|extracted count"
PROHIBITED = r"(?i)\b(buy|sell|hold)\b|recommendation|investment advice|score"
RISK_SIGNAL = r"(?i)(could|may|might|adversely|materially|harm|fail|unable|risk|uncertain|subject to|loss|decline|negativ|delay|disrupt|litigation|breach|violat|depend|prevent|impair)"
SUBORDINATOR = r"^(If|Although|Because|While|When|As|Should|Unless|Given|To|Even|Despite|Since|Where|Whereas|Until|Before|After|Provided)\b"
#: A title that one of these matches is a fragment; the last group only counts without a subordinator.
FRAGMENTS = (
    r"^[A-Z]{2,},",
    r"(?i)^(Additionally|Moreover|Furthermore|However|Also|In addition|As a result|Accordingly|Therefore|Consequently|Separately|Similarly|Finally|Conversely|Thus|Hence)\b,?\s",
    r"(?i)^(Any such|Such|These|Those|This)\b",
    r"(?i)^[A-Z][a-zA-Z.&/'-]*\s+\((?:or|the|i\.e|e\.g|including|a|an)\b",
    r"^[^(]*\)",
    r"(?i)^.{1,40},\s*(which|that)\b",
    r"(?i),\s+and\s+such\s+(persons|entities)\b",
    r"(?i)\bsuch allegations\b",
    r"(?i)\bthe foregoing\b",
    r"(?i)^additional risks|if any of the following risks",
)
LOOSE_CLAUSES = (
    r"^[A-Z][A-Za-z0-9_&/-]*(?:\s+[A-Za-z0-9_&/.,'-]+){0,10}?,\s+(?:have|has|had|are|is|was|were|will|would|may|might|could|should|can|do|does)\b",
    r"(?i),\s+(?:he|she|it|they|we|you)\s+(?:could|may|might|will|would|can|should)\b",
)
ABBREVIATIONS = r"(?:Mr|Mrs|Ms|Dr|Jr|Sr|St|Inc|Co|Corp|Ltd|No|vs|e\.g|i\.e|[A-Z])"

#: Characters with a capital of one character, though Java's upper case gives them more.
_ONE_CAPITAL = ("ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ")

_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java(pattern: str) -> str:
    """A pattern with `\\b` and `\\s` of ASCII words and SPACE, for Java."""
    return pattern.replace(r"\b", _EDGE).replace(r"\s", SPACE)


def has(c: Column, pattern: str) -> Column:
    return c.rlike(java(pattern))


def norm_ws(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, UNEVEN, " "))


def is_not_blank(c: Column) -> Column:
    """Whether there is anything but white space."""
    return c.rlike(SPACE.replace("[", "[^", 1))


def key_of_clean(c: Column) -> Column:
    """norm_title of a text whose white space is normalised."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]", "")
    return F.trim(F.regexp_replace(kept, " {2,}", " "))


def norm_title(c: Column) -> Column:
    """Lower case; all but letters, digits and white space deleted."""
    return key_of_clean(norm_ws(c))


def slugify(c: Column) -> Column:
    """The title key with hyphens, 80 characters at most; `untitled` if nothing is left."""
    slug = F.substring(F.replace(norm_title(c), F.lit(" "), F.lit("-")), 1, 80)
    return F.when(slug == "", "untitled").otherwise(slug)


def stable_id(*parts) -> Column:
    """Slugs of the non-empty parts, joined by hyphens; each part is slugified (again)."""
    cols = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    return F.concat_ws("-", *[F.when(F.length(c) > 0, slugify(c)) for c in cols])


def tokens_of_clean(c: Column) -> Column:
    """estimate_tokens of a text whose white space is normalised."""
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("int")


def estimate_tokens(c: Column) -> Column:
    return tokens_of_clean(norm_ws(c))


def excerpt_of_clean(c: Column, n: int = 500) -> Column:
    """excerpt of a text whose white space is normalised."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.trim(F.substring(c, 1, n - 1)), F.lit("...")))


def excerpt(c: Column, n: int = 500) -> Column:
    """At most n characters, or n - 1 trimmed and three dots."""
    return excerpt_of_clean(norm_ws(c), n)


def alnum_signature(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def is_source_excerpt(source: Column, quote: Column) -> Column:
    """Whether the quote's letters and digits run through the source's; true for a quote without any."""
    return alnum_signature(source).contains(alnum_signature(quote))


def strip_page_furniture(c: Column) -> Column:
    c = F.regexp_replace(c, java(r"(?i)\b\d{1,4}\s*Table of Contents\b"), " ")
    return norm_ws(F.regexp_replace(c, java(r"(?i)\bTable of Contents\b"), " "))


def prettify_quote(c: Column) -> Column:
    """Dotted leaders dropped and spaces put into glued table cells."""
    c = F.regexp_replace(c, java(r"\s*[.…]{2,}\s*"), " ")
    for pattern, to in ((r"([0-9)A-Za-z])\$", r"$1 \$"), (r"(\))([0-9])", "$1 $2"), (r"([0-9]{3,})([A-Z])", "$1 $2"), (r"(%)([A-Za-z(])", "$1 $2")):
        c = F.regexp_replace(c, pattern, to)
    c = F.regexp_replace(c, SPACE + "{2,}", " ")
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def split_sentences(c: Column) -> Column:
    """Sentences; the dot of an abbreviation or initial ends none."""
    parts = F.split(norm_ws(c), java(rf"(?<=[.!?])(?<!\b{ABBREVIATIONS}\.) +(?=[A-Z(])"))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")  # not F.trim itself: its second argument would be the index


def clamp_sentence(c: Column, n: int) -> Column:
    """At most n characters, cut at the last space (or one character earlier if there is none), with an ellipsis."""
    clean = norm_ws(c)
    cut = F.substring(clean, 1, n)
    back = F.greatest(F.lit(1), F.locate(" ", F.reverse(cut)))
    return F.when(F.length(clean) <= n, clean).otherwise(F.concat(F.trim(cut.substr(F.lit(1), F.lit(n) - back)), F.lit("…")))


def is_clean_title(c: Column) -> Column:
    """Whether a risk title reads as one complete statement with risk language."""
    t = F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
    ok = F.length(t).between(45, 220) & t.rlike("^[A-Z]") & has(t, RISK_SIGNAL)
    for p in FRAGMENTS:
        ok = ok & ~has(t, p)
    for p in LOOSE_CLAUSES:
        ok = ok & (has(t, SUBORDINATOR) | ~has(t, p))
    return ok


def has_advice(c: Column) -> Column:
    return has(c, ADVICE)


def has_parser_language(c: Column) -> Column:
    return has(c, PARSER_WORDS)


def has_prohibited_language(c: Column) -> Column:
    return has(c, PROHIBITED)


def scrub_terms(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered case-insensitive replacements, then a capital first letter."""
    for pattern, to in rules:
        c = F.regexp_replace(c, java("(?i)" + pattern), to)
    return capitalized(c)


def capitalized(c: Column) -> Column:
    """The text with its first character in upper case, which is one character too: `ß` becomes `ẞ`, ligatures stay."""
    first = F.substring(c, 1, 1)
    capital = F.when(F.length(F.upper(first)) > 1, F.translate(first, *_ONE_CAPITAL)).otherwise(F.upper(first))
    return F.concat(capital, c.substr(F.lit(2), F.length(c)))


def client_ip(forwarded: Column, *fallbacks: Column) -> Column:
    """The first forwarded address, else the first fallback that isn't empty, else `unknown`."""
    first = F.nullif(norm_ws(F.split(forwarded, ",").getItem(0)), F.lit(""))
    return F.coalesce(first, *[F.nullif(f, F.lit("")) for f in fallbacks], F.lit("unknown"))
