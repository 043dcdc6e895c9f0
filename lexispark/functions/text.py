"""Text functions: terms, tokens, previews, search names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query, in alphabetical order.
STOP_WORDS = [
    "a", "an", "and", "are", "can", "for", "from", "how", "in", "is", "it", "of", "on", "the", "to", "use", "using",
    "what", "when", "with"
]
#: White space by name, as Java's and RE2's \s differ.
SPACES = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
CONTROLS = r"[\x{0}-\x{1F}\x{7F}]+"
TERM = r"[\p{L}\p{N}_.$#:@/-]+"
TOKEN = r"[\p{L}\p{N}]+"
#: Marks of an identifier in a term.
IDENTIFIER = r"[._:$#/-]"


def terms(text: Column) -> Column:
    """Distinct query terms in order: lower case, without outer slashes and hashes, longer than 1, no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    bare = F.transform(found, lambda t: F.regexp_replace(t, "^[/#]+|[/#]+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS)))


def facets(topic: Column) -> Column:
    """The facets of a topic as texts, distinct, in order: any of its first 18 terms (``a OR b``), all of its first 8
    (``a AND b``), up to 6 identifiers, up to 3 quoted phrases; none for a topic without terms.

    Identifiers are terms with a mark of one, then raw tokens with an inner capital, in lower case.
    """
    none = F.array().cast("array<string>")

    def made(own: Column) -> Column:
        known = F.slice(own, 1, 18)
        raw = F.regexp_extract_all(topic, F.lit(TERM), F.lit(0))
        camel = F.transform(F.filter(raw, lambda t: t.rlike("[a-z][A-Z]")), F.lower)
        names = F.array_distinct(F.concat(F.filter(known, lambda t: t.rlike(IDENTIFIER)), camel))
        quoted = F.transform(
            F.regexp_extract_all(topic, F.lit("[\"'`](.{2,80}?)[\"'`]"), F.lit(1)), lambda q: F.array_join(terms(q), " ")
        )
        return F.when(
            F.size(own) > 0,
            F.array_distinct(
                F.concat(
                    F.array(F.array_join(known, " OR "), F.array_join(F.slice(own, 1, 8), " AND ")),
                    F.slice(names, 1, 6), F.slice(F.filter(quoted, lambda q: q != ""), 1, 3)
                )
            )
        ).otherwise(none)

    return F.get(F.transform(F.array(terms(topic)), made), F.lit(0))


def token_budget(topic: Column) -> Column:
    """How many tokens an answer to a topic may have."""
    return F.least(F.lit(5000), 1600 + 180 * F.size(terms(topic))).cast("int")


def token_string(text: Column) -> Column:
    """The text's tokens with two spaces before, between and after them, so that a phrase is a substring."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[^\p{L}\p{N}]+", "  ")


def phrase_count(tokens: Column, phrase: list[str]) -> Column:
    """How often a phrase of tokens occurs in a token string, without overlaps."""
    needle = " " + "  ".join(phrase) + " "
    return ((F.length(tokens) - F.length(F.replace(tokens, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("bigint")


def token_count(tokens: Column) -> Column:
    """How many tokens a token string has."""
    return ((F.length(tokens) - F.length(F.replace(tokens, F.lit(" "), F.lit("")))) / 2 - 1).cast("bigint")


def collapse(text: Column) -> Column:
    """White space runs as one space."""
    return F.regexp_replace(text, SPACES, " ")


def safe_label(text: Column, most: int = 300) -> Column:
    """A label for display: control characters and white space as one space, trimmed, cut."""
    return F.substring(F.trim(collapse(F.regexp_replace(text, CONTROLS, " "))), 1, most)


def preview(text: Column, most: int = 360) -> Column:
    """The start of a text on one line, with an ellipsis if it goes on."""
    line = F.trim(collapse(text))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def fingerprint(text: Column, most: int = 180) -> Column:
    """What two near-equal results have in common: lower case, on one line, the first characters."""
    return F.substring(collapse(F.lower(text)), 1, most)


def search_name(name: Column) -> Column:
    """A name for comparing: lower case letters and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


# Words at the end of a name that say it is documentation.
QUALIFIERS = ["docs", "documentation", "manual", "reference", "references"]


def discovery_names(name: Column) -> Column:
    """The name itself and the name without qualifiers at its end, distinct and not empty."""
    plain = F.trim(name)
    bare = F.trim(F.regexp_replace(plain, rf"(?i)([ _-]+({'|'.join(QUALIFIERS)}))+$", ""))
    return F.filter(F.array_distinct(F.array(plain, bare)), lambda n: n != "")


def official_docs_repository(name: Column) -> Column:
    """The repository in which an owner of this name would keep its documentation."""
    first = F.regexp_replace(F.lower(F.split_part(F.trim(name), F.lit(" "), F.lit(1))), "[^a-z0-9_.-]", "")
    return F.when(first != "", F.concat(F.lit("/"), first, F.lit("/docs")))


def wrap(text: Column, width: int = 84, most: int = 400) -> Column:
    """The text on one line, cut and broken between words into lines of at most ``width`` characters."""
    words = F.split(F.substring(F.trim(collapse(text)), 1, most), " ")
    step = lambda s, w: F.when(s == "", w).when(
        F.length(F.substring_index(s, "\n", -1)) + 1 + F.length(w) <= width, F.concat(s, F.lit(" "), w)
    ).otherwise(F.concat(s, F.lit("\n"), w))
    return F.aggregate(words, F.lit(""), step)


def without_source_lines(text: Column) -> Column:
    """A snippet without its ``Source: url`` marks."""
    return F.regexp_replace(text, r"(?i)Source:\s*https?://\S+", "")


def visible_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments and tags; the usual entities decoded; one line."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")
    ):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(collapse(bare))


def html_element(html: Column, tag: str) -> Column:
    """The text of the first element of a kind; empty without one."""
    return visible_text(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
