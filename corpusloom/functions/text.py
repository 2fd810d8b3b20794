"""Text functions as Columns.  All but the Porter stemmer stay in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The function words that carry no topic, dropped at index time and from queries.
STOP_WORDS = (
    "a an and are as at be been being by can could did do does for from had has have how i in is it its me my of on or our "
    "shall should that the their them then there these they this those to was we were what when where which who whom whose "
    "why will with would you your"
).split()

#: A raw token: letters and digits, with dots and hyphens between them.
TOKEN = r"[\p{L}\p{N}]+(?:[.-]+[\p{L}\p{N}]+)*"


@cache
def _accents() -> tuple[str, str]:
    """Every precomposed character with marks that has a one-letter base, and that base, from Unicode's decompositions."""
    pairs = []
    for point in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        full = unicodedata.normalize("NFD", chr(point))
        base = "".join(c for c in full if not unicodedata.category(c).startswith("M"))
        if len(full) > 1 and len(base) == 1:
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents and other combining marks."""
    accented, plain = _accents()
    bare = F.regexp_replace(F.translate(F.lower(text), accented, plain), r"\p{M}+", "")
    # As many bytes as characters: nothing but ASCII, which has no marks.
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(bare)


def raw_tokens(text: Column) -> Column:
    """Tokens of letters, digits, inner dots and hyphens, of the folded text; null has none."""
    folded = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "\u2011", "-")
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def compound_parts(token: Column) -> Column:
    return F.filter(F.split(token, "-"), lambda p: p != "")


def joined_compound(token: Column) -> Column:
    """A hyphenated token of at most three parts as one word, unless that is all digits; else empty."""
    parts = compound_parts(token)
    joined = F.array_join(parts, "")
    return F.when((F.size(parts) > 3) | joined.rlike(r"^\d*$"), F.lit("")).otherwise(joined)


def compound_pieces(token: Column) -> Column:
    """The parts of a hyphenated token and then its joined form; a token with a dot stays whole."""
    split = F.concat(compound_parts(token), F.filter(F.array(joined_compound(token)), lambda p: p != ""))
    return F.when(F.instr(token, ".") > 0, F.array(token)).when(F.instr(token, "-") > 0, split).otherwise(F.array(token))


def is_stop_word(word: Column) -> Column:
    return word.isin(STOP_WORDS)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value made once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def index_terms(text: Column) -> Column:
    """Index-side terms in order: compound pieces of the raw tokens, stop words dropped, unstemmed."""
    # Most texts have no compound: theirs are not taken apart.
    pieces = lambda raw: F.when(F.exists(raw, lambda t: F.instr(t, "-") > 0), F.flatten(F.transform(raw, compound_pieces))).otherwise(raw)
    return let(raw_tokens(text), lambda raw: F.filter(pieces(raw), lambda t: ~is_stop_word(t)))


def query_terms(text: str, trailing_prefix: bool = False) -> list[str]:
    """The terms of a query on the driver: compounds joined, completed stop words dropped."""
    folded = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")).lower()
    tokens = [t.strip(".-") for t in re.split(r"[^\w.-]+|_+", folded.replace("‑", "-"))]
    out = []
    for t in filter(None, tokens):
        parts = [p for p in t.split("-") if p]
        joined = "".join(parts)
        out.append(t if "." in t or "-" not in t else joined if len(parts) <= 3 and not joined.isdigit() else t)
    last = len(out) - 1 if trailing_prefix and text and not text[-1].isspace() else -1
    return [t for i, t in enumerate(out) if i == last or t not in STOP_WORDS]


def normalized(text: Column) -> Column:
    """Lower case, white space of any kind collapsed and trimmed."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "), F.lit(" "))


def words(text: Column) -> Column:
    return F.filter(F.split(normalized(text), " "), lambda w: w != "")


def shingles(word_array: Column, n: int = 3) -> Column:
    """Distinct word n-grams in order of first occurrence; fewer words than n are one shingle, none are none."""
    count = F.size(word_array)
    whole = F.greatest(count - (n - 1), F.lit(0))
    # The words are argument of a few slices, not of a lambda, which would make them anew for each shingle.
    zipped = F.arrays_zip(*[F.slice(word_array, j + 1, whole).alias(f"w{j}") for j in range(n)])
    grams = F.transform(zipped, lambda x: F.concat_ws(" ", *[x.getField(f"w{j}") for j in range(n)]))
    short = F.when(count == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(word_array, " ")))
    return F.when(count < n, short).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of sets as arrays; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def first_line(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")[0]


def strip_links(text: Column) -> Column:
    """Markdown links become their text."""
    return F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")


def first_sentence(text: Column, cap: int = 220) -> Column:
    found = F.regexp_extract(F.btrim(text), r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    return F.left(F.when(found == "", F.btrim(text)).otherwise(found), F.lit(cap))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def is_identifier(token: Column) -> Column:
    """0x-prefixed hex, or bare hex of eight digits and more with a letter and a digit."""
    return token.rlike(r"(?i)^0x[0-9a-f]+$") | (token.rlike(r"(?i)^[0-9a-f]{8,}$") & token.rlike(r"(?i)[a-f]") & token.rlike(r"\d"))


def valid_uuid(text: Column) -> Column:
    return text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def hyphenated_uuid(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), "-", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def snippet(text: Column, terms: list[str], width: int = 150) -> Column:
    """``width`` code points around the first place where a term occurs in the folded text, else the start.

    Folding keeps places where every character folds to one, as precomposed letters do.
    """
    folded = fold(text)
    at = F.array_min(F.filter(F.array(*[F.instr(folded, t) for t in terms]), lambda p: p > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - width // 3, F.lit(1))
    return F.substring(text, start, F.lit(width))


def word_boundary(phrase: str, case: bool = False) -> str:
    """A pattern for a phrase between non-letters and non-digits."""
    flags = "(?u)" if case else "(?iu)"
    return rf"{flags}(?<![\p{{L}}\p{{N}}_]){re.escape(phrase)}(?![\p{{L}}\p{{N}}_])"


VOWELS = set("aeiou")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)


def _closes_short(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


# The suffix rules of Porter's published algorithm (1980), steps 2 to 4.
STEP2 = [x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()]
STEP3 = [x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
# The longest suffix that fits counts.
STEP2, STEP3, STEP4 = (sorted(s, key=lambda r: -len(r[0])) for s in (STEP2, STEP3, [[s] for s in STEP4]))


def _replaced(w: str, rules, least: int) -> str:
    for suffix, to in rules:
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + to if _measure(stem) > least else w
    return w


@lru_cache(maxsize=100_000)
def porter_stem(word: str) -> str:
    """Porter's stemmer; words with a dot, under three letters or beyond a-z stay as they are."""
    w = word
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and any(not _consonant(w[:-2], i) for i in range(len(w) - 2)):
        cut = w[:-2]
    elif w.endswith("ing") and any(not _consonant(w[:-3], i) for i in range(len(w) - 3)):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _consonant(cut, len(cut) - 1) and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _closes_short(cut) else cut
    if w.endswith("y") and any(not _consonant(w[:-1], i) for i in range(len(w) - 1)):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP2, 0), STEP3, 0)
    for (suffix,) in STEP4:
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _closes_short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem(word: pd.Series) -> pd.Series:
    """Stems of a column of words; apply it to distinct words and join back."""
    return word.map(lambda w: None if w is None else porter_stem(w))
