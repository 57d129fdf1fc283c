"""Text column functions (Column -> Column), all native Spark expressions.

`\\w`, `\\s` and `\\b` follow Python's Unicode meaning through the `(?U)` flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspark import lexicon as lx

URL_PATTERN = r"(?U)https?://\S+|www\.\S+"
MENTION_PATTERN = r"(?U)@\w+"
SPACE_RUN = r"(?U)\s+"
NON_SPACE_RUN = r"(?U)\S+"
WORD_PATTERN = r"[a-zA-Z']+"
CONTENT_WORD_PATTERN = r"[a-zA-Z']{3,}"
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+"
SHOUT_PATTERN = r"(?U)\b[A-Z]{3,}\b"
TOKEN_RUN_PATTERN = r"(?U)(\w+|\W+)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def str_array(values) -> Column:
    """Literal array<string>; Catalyst folds it into one constant."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# Python's whitespace (str.isspace), i.e. what str.strip() removes; derived by
# rule rather than listed.
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def ws_trim(c) -> Column:
    """Strip leading/trailing whitespace of any kind (Python str.strip()):
    a native trim over the whitespace set, no regex."""
    return F.trim(col(c), F.lit(PY_WHITESPACE))


def clean_text(c, guard: bool = True) -> Column:
    """URL -> 'http', @mention -> '@user', whitespace runs -> one space, strip.

    With `guard`, each regex runs only on texts holding its literal: a URL
    match needs 'http' or 'www.', a mention needs '@' (replacing URLs adds
    none), so the result is the same and most texts skip two of the three
    regex scans.  Use guard=False inside a higher-order-function lambda:
    Spark shares no subexpressions there, and the guarded form reads the URL
    stage more than once."""
    t = col(c)
    if not guard:
        t = F.regexp_replace(t, URL_PATTERN, "http")
        t = F.regexp_replace(t, MENTION_PATTERN, "@user")
        return F.trim(F.regexp_replace(t, SPACE_RUN, " "))
    has_at = t.contains("@")
    u = F.when(t.contains("http") | t.contains("www."),
               F.regexp_replace(t, URL_PATTERN, "http")).otherwise(t)
    m = F.when(has_at, F.regexp_replace(u, MENTION_PATTERN, "@user")).otherwise(u)
    return F.trim(F.regexp_replace(m, SPACE_RUN, " "))


def word_tokens(c) -> Column:
    """All [a-zA-Z']+ runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD_PATTERN), 0)


def content_words(c, stopwords=lx.STOPWORDS) -> Column:
    """[a-zA-Z']{3,} runs of the lower-cased text, stop words removed."""
    # `isin` over literals becomes a hash-set test (InSet), not a list scan
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(CONTENT_WORD_PATTERN), 0)
    return F.filter(words, lambda w: ~w.isin(*stopwords))


def bigrams(words) -> Column:
    """Adjacent pairs of a word array, joined by one space."""
    w = col(words)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n),
                      lambda a, b: F.concat_ws(" ", a, b))


def split_sentences(c, min_chars: int = 4) -> Column:
    """Split after . ! ? followed by whitespace; keep pieces of >= min_chars."""
    parts = F.split(ws_trim(c), SENTENCE_BREAK, -1)
    return F.filter(F.transform(parts, ws_trim), lambda p: F.length(p) >= min_chars)


def word_count(c) -> Column:
    """len(text.split()): runs of non-whitespace, counted in one regex pass
    (no array of words is built)."""
    return F.regexp_count(col(c), F.lit(NON_SPACE_RUN))


def char_count(c) -> Column:
    return F.length(col(c))


def sentence_count(c) -> Column:
    return F.greatest(F.size(split_sentences(c)), F.lit(1))


def char_occurrences(c, ch: str) -> Column:
    t = col(c)
    diff = F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))
    return diff if len(ch) == 1 else F.floor(diff / F.lit(len(ch))).cast("int")


def exclamation_count(c) -> Column:
    return char_occurrences(c, "!")


def shout_count(c) -> Column:
    """Words of three or more capitals in the raw text."""
    return F.regexp_count(col(c), F.lit(SHOUT_PATTERN))


def intensifier_count(tokens, intensifiers=lx.INTENSIFIERS) -> Column:
    """Occurrences (not distinct) of intensifier words in a token array."""
    return F.size(F.filter(col(tokens), lambda w: w.isin(*intensifiers)))


def truncate_text(c, n: int = 1200) -> Column:
    return F.substring(col(c), 1, n)


def snippet(c, n: int = 80, suffix: str = "...") -> Column:
    t = col(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(suffix))).otherwise(t)


def title_case(c) -> Column:
    """Python str.title(): upper-case a cased character that follows an uncased one."""
    chars = F.split(col(c), "")
    before = F.concat(F.array(F.lit(" ")), F.slice(chars, F.lit(1), F.size(chars) - 1))

    def fix(ch, prev):
        return F.when(F.upper(prev) != F.lower(prev), F.lower(ch)).otherwise(F.upper(ch))

    return F.array_join(F.zip_with(chars, before, fix), "")


def display_name(email) -> Column:
    """E-mail local part, dots to spaces, title case."""
    return title_case(F.replace(F.substring_index(col(email), "@", 1), F.lit("."), F.lit(" ")))


def initials(name) -> Column:
    """First letters of the first and last word, upper-cased; '?' when empty."""
    t = ws_trim(name)
    parts = F.filter(F.split(t, SPACE_RUN), lambda p: F.length(p) > 0)
    first = F.substring(F.get(parts, 0), 1, 1)
    last = F.substring(F.element_at(parts, -1), 1, 1)
    return (F.when(F.size(parts) == 0, F.lit("?"))
            .when(F.size(parts) == 1, F.upper(first))
            .otherwise(F.upper(F.concat(first, last))))


def tag_tokens(c, positive=lx.POSITIVE_SIGNAL_WORDS, negative=lx.NEGATIVE_SIGNAL_WORDS,
               intensifiers=lx.INTENSIFIERS) -> Column:
    """Array of struct(token, tag): word and non-word runs, tagged
    positive / negative / intensifier / plain (in that precedence)."""
    runs = F.regexp_extract_all(col(c), F.lit(TOKEN_RUN_PATTERN), 1)

    def tag(tok):
        low = F.lower(tok)
        return F.struct(tok.alias("token"),
                        F.when(low.isin(*positive), "positive")
                        .when(low.isin(*negative), "negative")
                        .when(low.isin(*intensifiers), "intensifier")
                        .otherwise("plain").alias("tag"))

    return F.transform(runs, tag)
