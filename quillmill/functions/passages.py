"""Spans, windows and stems inside one text: small per-row helpers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame

from .text import query_plan, words_of

WINDOW = 240


def folded(text: str) -> tuple[str, list[int]]:
    """The text folded character by character, and for each folded character the place it comes from."""
    out, places = [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFD", c.casefold()):
            if unicodedata.category(x) != "Mn":
                out.append(x)
                places.append(i)
    return "".join(out), places


def spans(text: str, query: str, most: int = 100) -> list[tuple[int, int]]:
    """(start, end) of whole-word matches of the query's terms in the text as it stands, marks that follow included."""
    terms = list(dict.fromkeys(folded(t)[0] for t in query_plan(query)[0]))
    low, places = folded(text)
    found: list[tuple[int, int]] = []
    if not terms:
        return found
    for m in re.finditer(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, sorted(terms, key=len, reverse=True)))})(?![^\W_])", low):
        end = places[m.end() - 1] + 1
        while end < len(text) and unicodedata.category(text[end]) == "Mn":
            end += 1
        found.append((places[m.start()], end))
        if len(found) == most:
            break
    return found


def windows(text: str, size: int = WINDOW) -> list[tuple[int, int]]:
    """Neighbouring lines of a paragraph joined in windows of at most `size` characters; a longer line is one itself."""
    out: list[tuple[int, int]] = []
    at, held = 0, None
    for line in text.splitlines(keepends=True):
        a, b = at, at + len(line.rstrip("\r\n"))
        at += len(line)
        if not text[a:b].strip():
            held = None
        elif held is not None and b - out[held][0] <= size:
            out[held] = (out[held][0], b)
        else:
            out.append((a, b))
            held = len(out) - 1
    return out


def best_passage(text: str, question: str) -> tuple[int, int] | None:
    """The window that holds most of the question's words by their stems, the shorter and earlier one on a tie."""
    wanted = {stem(w) for w in query_plan(question)[0]}
    scored = [(-len(wanted & {stem(w) for w in words_of(text[a:b])}), b - a, a, b) for a, b in windows(text)]
    best = min(scored, default=None)
    return (best[2], best[3]) if best and best[0] else None


# The suffixes of the Porter stemmer's second to fourth steps.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for each run of vowels and c for each run of consonants."""
    kinds = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and kinds[i - 1] == "c"
        kinds += "v" if vowel else "c"
    return kinds


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _cvc(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    """The Porter stem of a lower-case word."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")) or _measure(word) == 1 and _cvc(word):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "lsz" and _shape(word)[-1] == "c":
                    word = word[:-1]
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if word.endswith(end):
                word = word[: -len(end)] + table[end] if _measure(word[: -len(end)]) else word
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            head = word[: -len(end)]
            if _measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
                word = head
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def snippet_window(hits: list[tuple[int, str]], n: int, size: int) -> tuple[int, int, int]:
    """(first token, distinct terms, hits) of the window of `size` of n tokens that holds most terms, then most hits, then begins first.

    `hits` are (token, term) in order. One pass: a window begins at a hit, the counts of its terms move along, and a window over
    the end of the text is moved back.
    """
    best, held, end = (0, 0, 0), {}, 0
    for k, (at, term) in enumerate(hits):
        while end < len(hits) and hits[end][0] < at + size:
            held[hits[end][1]] = held.get(hits[end][1], 0) + 1
            end += 1
        if (len(held), end - k) > best[1:]:
            best = at, len(held), end - k
        held[term] -= 1
        if not held[term]:
            del held[term]
    return max(0, min(best[0], n - size)), *best[1:]


def snippets(hits: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", size: int = 64) -> DataFrame:
    """(id, token, n_terms, n_hits, snippet): the `size` words of each text that hold most of the query's terms, as they stand, with ellipses where text is left out."""
    terms = {folded(t)[0] for t in query_plan(query)[0]}

    def each(parts):
        for pdf in parts:
            rows = []
            for i, text in zip(pdf[id_col], pdf[text_col].fillna(""), strict=True):
                low, places = folded(text)
                words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+", low)]
                token, n_terms, n_hits = snippet_window([(k, w) for k, (_, _, w) in enumerate(words) if w in terms], len(words), size)
                if not n_hits:
                    continue
                cut = words[token : token + size]
                a, b = places[cut[0][0]], places[cut[-1][1] - 1] + 1
                left, right = token > 0, token + size < len(words)
                rows.append((i, token, n_terms, n_hits, ("… " if left else "") + text[a if left else 0 : b if right else len(text)].strip() + (" …" if right else "")))
            yield pd.DataFrame(rows, columns=[id_col, "token", "n_terms", "n_hits", "snippet"])

    return hits.select(id_col, text_col).mapInPandas(each, f"{id_col} {hits.schema[id_col].dataType.simpleString()}, token long, n_terms long, n_hits long, snippet string")


def best_windows(hits: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, passage) for each hit: its first span, and its best window; null without one.

    For the few hits of a search: each text is read by small Python helpers.
    """

    def each(parts):
        for pdf in parts:
            rows = []
            for i, text in zip(pdf[id_col], pdf[text_col].fillna(""), strict=True):
                first = next(iter(spans(text, query, 1)), (None, None))
                best = best_passage(text, query)
                rows.append({id_col: i, "start": first[0], "end": first[1], "passage": text[best[0] : best[1]] if best else None})
            yield pd.DataFrame(rows, columns=[id_col, "start", "end", "passage"]).astype({"start": "Int64", "end": "Int64"})

    kind = hits.schema[id_col].dataType.simpleString()
    return hits.select(id_col, text_col).mapInPandas(each, f"{id_col} {kind}, start long, end long, passage string")
