"""Search strings to filters: type:, in:, title:, "phrase", 'exact', -word and id look-ups.  A driver-side parser of one string."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.keyword import phrase_filter

# What a complete operator looks like.  Anything incomplete is ordinary text.
_KEYED = re.compile(r'(?<!\S)(?P<key>type|in|title):(?:"(?P<quoted>[^"]+)"|(?P<plain>[^\s"]+))', re.IGNORECASE)
_PHRASE = re.compile(r'"(?P<value>[^"]+)"')
_EXACT = re.compile(r"(?<!\S)'(?P<value>[^']+)'(?=$|\s|[.,;:!?)\]])")
_WITHOUT = re.compile(r"""(?<!\S)-(?P<value>[^\s"'-][^\s"']*)""")


@dataclass
class Parsed:
    terms: str = ""
    types: list[str] = field(default_factory=list)
    scopes: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    exact: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    jump: str | None = None

    @property
    def title_only(self) -> bool:
        return bool(self.titles)


def _taken(pattern: re.Pattern, text: str, take) -> str:
    """``text`` without the matches that ``take`` accepts."""
    return pattern.sub(lambda m: " " if take(m) else m[0], text)


def parse(raw: str) -> Parsed:
    """Reads the operators out of a search string; a lone id of eight hex digits and more is a jump."""
    text = raw.strip()
    digits = text.replace("-", "").lower()
    if re.fullmatch(r"[0-9a-fA-F][0-9a-fA-F-]*", text) and 8 <= len(digits) <= 32 and re.search("[a-f]", digits):
        return Parsed(jump=digits)
    out = Parsed()

    def keyed(m) -> bool:
        value = (m["quoted"] or m["plain"]).strip()
        if value:
            {"type": out.types, "in": out.scopes, "title": out.titles}[m["key"].lower()].append(value.replace("_", " ") if m["key"].lower() == "type" else value)
        return bool(value)

    def into(values: list[str]):
        def take(m) -> bool:
            if value := m["value"].strip():
                values.append(value)
            return bool(value)

        return take

    text = _taken(_KEYED, text, keyed)
    text = _taken(_PHRASE, text, into(out.phrases))
    text = _taken(_EXACT, text, into(out.exact))
    text = _taken(_WITHOUT, text, into(out.excluded))
    out.terms = " ".join(" ".join([text, *out.titles, *out.phrases, *out.exact]).split())
    return out


def predicate(parsed: Parsed, kind: Column, scope: Column, content: Column) -> Column:
    """The filters as one condition, to be applied before ranking."""
    tests = phrase_filter(content, parsed.phrases, parsed.exact, parsed.excluded)
    if parsed.types:
        tests = tests & F.lower(kind).isin([t.lower() for t in parsed.types])
    if parsed.scopes:
        tests = tests & scope.isin(parsed.scopes)
    return tests


def search_terms(parsed: Parsed) -> list[str]:
    return list(dict.fromkeys(tx.query_terms(parsed.terms)))


def is_identifier_query(text: str) -> bool:
    """Every word is 0x and hex digits, or eight hex digits and more with a letter and a digit."""
    words = text.split()
    return bool(words) and all(re.fullmatch(r"(?i)0x[0-9a-f]+|(?=.*[a-f])(?=.*\d)[0-9a-f]{8,}", w) for w in words)


def rewritten(query: str, rules: dict[str, tuple[str, int | None]]) -> tuple[str, int | None]:
    """The query with the first known phrase replaced by the corpus's own word for it, and the document that promotes."""
    for phrase, (words, target) in rules.items():
        pattern = re.compile(rf"(?<!\w){re.escape(phrase)}(?!\w)", re.IGNORECASE)
        if pattern.search(query):
            return pattern.sub(words, query), target
    return query, None


def question(text: str) -> tuple[str, str] | None:
    """("definition" or "count", subject) of the template questions; None for others."""
    plain = text.strip().rstrip("?").strip()
    if m := re.match(r"(?i)(?:what|who)(?:\s+is|\s+are|'s)\s+(?:an?\s+|the\s+)?(.+)$", plain):
        return "definition", m[1]
    if m := re.match(r"(?i)how many\s+(.+?)(?:\s+(?:are|does|do|is)\b.*)?$", plain):
        return "count", m[1]
    return None
