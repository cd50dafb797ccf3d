"""Text normalisation, token and matching expressions (all Catalyst, no UDF)."""

import re
from pyspark.sql import Column, functions as F

from . import terms

# Python-style whitespace: Unicode spaces plus the four information separators.
_SPACE = r"[\s\x1c-\x1f]"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_empty(c) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def strip(c) -> Column:
    return F.regexp_replace(as_col(c), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(as_col(c), f"(?U){_SPACE}+", " "))


def squash(c) -> Column:
    """Lowercase, whitespace collapsed; null reads as empty."""
    return collapse(F.lower(or_empty(c)))


def plain(c) -> Column:
    """Lowercase, ASCII punctuation deleted, whitespace collapsed."""
    return collapse(F.translate(F.lower(or_empty(c)), _PUNCTUATION, ""))


def aliased(c) -> Column:
    """Lowercase, story aliases applied in order, everything but a-z 0-9 spaced out."""
    out = F.lower(or_empty(c))
    for src, dst in terms.STORY_ALIASES:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def words(c) -> Column:
    """Split single-spaced text; empty text gives an empty array."""
    return F.filter(F.split(as_col(c), " "), lambda w: w != "")


def token_set(c) -> Column:
    return F.array_distinct(words(plain(c)))


def story_tokens(c) -> Column:
    """Content tokens of the aliased text, duplicates and order kept."""
    drop = terms.STOPWORDS + terms.MONTH_WORDS
    return F.filter(
        words(aliased(c)),
        lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~w.isin(drop),
    )


def story_token_set(c) -> Column:
    return F.array_distinct(story_tokens(c))


def jaccard(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def containment(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / small)


# ---- matching ------------------------------------------------------------------

def _alternation(words_: list[str]) -> str:
    return "|".join(re.escape(w) for w in words_)


def let(c, use) -> Column:
    """`use(x)` with x bound to the value of `c`.

    The value is computed once, however often `use` mentions it and wherever the optimizer moves the
    expression; it also keeps long term lists out of the generated code.
    """
    return F.transform(F.array(as_col(c)), use)[0]


def term_array(words_: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words_])


def contains_any(c, words_: list[str]) -> Column:
    """Any listed text is a substring (byte search; no regular expression)."""
    return let(c, lambda x: F.exists(term_array(words_), lambda w: F.contains(x, w)))


def count_contains(c, words_: list[str]) -> Column:
    """How many of the listed texts are substrings (each counted once)."""
    return let(c, lambda x: F.size(F.filter(term_array(words_), lambda w: F.contains(x, w))))


def has_word(c, words_: list[str]) -> Column:
    """Any listed term between word boundaries; the pattern runs only where a term occurs at all."""
    return contains_any(c, words_) & as_col(c).rlike(rf"\b(?:{_alternation(words_)})\b")


def all_words(c, words_: list[str]) -> Column:
    """Every listed term found between word boundaries, in listed order."""
    pairs = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(rf"\b{re.escape(w)}\b").alias("p")) for w in words_])
    found = let(c, lambda x: F.filter(pairs, lambda t: F.contains(x, t["w"]) & F.rlike(x, t["p"])))
    return F.transform(found, lambda t: t["w"])


def first_word(c, words_: list[str]) -> Column:
    """The first term in listed order found between word boundaries, else null."""
    return F.try_element_at(all_words(c, words_), F.lit(1))


def matches_any(c, patterns: list[str]) -> Column:
    """Any pattern found; `.` excludes only the newline."""
    c = as_col(c)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | c.rlike("(?d)" + p)
    return hit


def has_blocked_term(c) -> Column:
    """A blocked term at a word start."""
    return F.lower(as_col(c)).rlike(rf"\b(?:{_alternation(terms.BLOCKED_TERMS)})")


def is_garbled(c) -> Column:
    """Empty, over 30 % non-ASCII, or holding control characters."""
    c = or_empty(c)
    n = F.length(c)
    foreign = n - F.length(F.regexp_replace(c, r"[^\x00-\x7f]", ""))
    return (n == 0) | (foreign > F.lit(0.3) * n) | c.rlike(terms.CONTROL_CHARS)


def has_pii(c) -> Column:
    c = or_empty(c)
    return (F.contains(c, F.lit("@")) & c.rlike(terms.EMAIL_PATTERN)) | c.rlike(terms.PHONE_PATTERN) | c.rlike(terms.SSN_PATTERN)


def content_hash(c) -> Column:
    """SHA-256 hex of the stripped, lowercased text."""
    return F.sha2(F.lower(strip(c)), 256)


def json_list(c, keep_bad: bool = False) -> Column:
    """JSON text to array<string>; bad JSON gives [] (or the raw text as one item)."""
    c = as_col(c)
    bad = F.array(c) if keep_bad else F.array().cast("array<string>")
    return F.coalesce(
        F.from_json(c, "array<string>"),
        F.when(c.isNotNull() & (F.length(c) > 0), bad).otherwise(F.array().cast("array<string>")),
    )
