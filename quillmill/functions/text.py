"""Text columns: folding, tokens, previews, credential and privacy patterns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that a query plan leaves out.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can could did do does
    for from had has have how i in is it its me my of on or our please show tell
    than that the their them then there these they this to us was we were what
    when where which who why will with would you your find search
    remember about""".split()
)
# Patterns of credentials and of the privacy switches.
SECRET = (
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|\bsk-[A-Za-z0-9_-]{20,}|\b(?:ghp_|github_pat_|xox[baprs]-)[A-Za-z0-9_-]{16,}"
    r"|\bAKIA[A-Z0-9]{16}\b|\bBearer\s+[A-Za-z0-9._~-]{20,}"
    r"|(?i:\b(?:password|passwd|api[_ -]?key|access[_ -]?token|client[_ -]?secret)\s*[:=]\s*[\"']?)[^\s\"']{8,}"
)
PRIVACY_OFF = r"(?is)^\s*(?:/memory\s+off\b|(?:please\s+)?(?:do not|don't)\s+(?:save|record|remember|archive)\s+(?:this|anything|the following)\b|off the record\b)"
PRIVACY_ON = r"(?is)^\s*/memory\s+on\s*$"
MAX_QUERY, MAX_TERMS, MAX_PHRASES = 2048, 32, 4


def _accents() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition is one letter and marks, and those letters."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x530)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c == c.lower() and len(base) == 1 and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"\p{Mn}", "")


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text; an underscore separates."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def fold_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold_text(text))


def query_plan(query: str) -> tuple[list[str], list[list[str]]]:
    """Terms without stop words in first order, and phrases: each quoted span, then all terms together."""
    query = query.strip()[:MAX_QUERY]
    terms = list(dict.fromkeys(w for w in words_of(query) if w not in STOP_WORDS))[:MAX_TERMS]
    phrases = [w[:MAX_TERMS] for span in re.findall(r'"([^"]+)"', query) if (w := words_of(span))]
    if len(terms) > 1:
        phrases.append(terms)
    unique = list(dict.fromkeys(map(tuple, phrases)))[:MAX_PHRASES]
    return terms, [list(p) for p in unique]


def query_terms(text: Column) -> Column:
    """The terms of a query column."""
    stop = F.array(*map(F.lit, sorted(STOP_WORDS)))
    return F.slice(F.array_except(F.array_distinct(tokens(F.substring(F.trim(text), 1, MAX_QUERY))), stop), 1, MAX_TERMS)


def bounded(text: Column, size: int) -> Column:
    """Cut to `size` code points, the last an ellipsis if anything was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("…"))).otherwise(text)


def token_bound(value: Column) -> Column:
    """What no tokenizer of bytes goes over: the UTF-8 bytes of a struct's or array's JSON, the longer of its two layouts."""
    return F.greatest(F.octet_length(F.to_json(value)), F.octet_length(F.to_json(value, {"pretty": "true"})))


def short_text(text: Column, tokens: int = 12, characters: int = 64) -> Column:
    """The longest beginning, of at most so many characters, whose JSON has no more bytes than tokens; one character at least."""
    size = lambda i: F.octet_length(F.to_json(F.array(F.substring(text, F.lit(1), i)))) - 2
    fit = F.filter(F.sequence(F.lit(1), F.lit(characters)), lambda i: (i <= F.length(text)) & (size(i) <= tokens))
    return F.coalesce(F.substring(text, F.lit(1), F.coalesce(F.array_max(fit), F.lit(1))), F.lit(""))


def excerpt(text: Column, pattern: str, size: int = 600, before: int = 200) -> Column:
    """About `size` code points from `before` ahead of the first match, ellipses where text is left out."""
    at = F.greatest(F.lit(1), F.coalesce(F.nullif(F.regexp_instr(text, F.lit(pattern)), F.lit(0)), F.lit(1)) - before)
    head = F.when(at > 1, F.lit("…")).otherwise("")
    tail = F.when(F.length(text) >= at + size, F.lit("…")).otherwise("")
    return F.concat(head, F.substring(text, at, F.lit(size)), tail)


def revision(text: Column) -> Column:
    return F.sha2(text, 256)


def scrub(text: Column) -> Column:
    """Credentials replaced by a fixed mark."""
    return F.regexp_replace(text, SECRET, "[redacted]")


def slug(name: Column, size: int = 60, default: str = "general") -> Column:
    cut = F.regexp_replace(F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), 1, size), "^-+|-+$", "")
    return F.when(F.length(cut) > 0, cut).otherwise(default)
