"""Where an answer is best read: the sentences of a search's hits as rows, what speaks for each as columns, the best by one aggregation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import passages
from ..functions import text as X

PREVIEW = 240
#: Code points below a heading in which its subject is sought, and those of a full sentence.
BELOW, FULL = 1600, 40
#: A sentence ends before white space that follows a stop, or after a line end.
_ENDS = r"(?<=[.!?])(?=\s)|(?<=\n)"
# What a line that states something begins with, what only gives particulars, and the words of outcomes.
STATEMENT = r"(?i)^(?:status|summary|purpose|problem|outcome|result)\s*:\s*\S"
PARTICULARS = r"(?i)^(?:requested pickup|prepared (?:for|by)|evidence collected|date\s*:|title\s*:)"
ASKS_OUTCOME = r"(?i)\b(?:outcome|result|worked|fixed|resolved|confirmed|verified|tested|succeed(?:ed)?|fail(?:ed)?|what happened|root cause|end up|test\b.*\brun|run\b.*\btest)\b"
TELLS_OUTCOME = r"(?i)\b(?:observed|confirmed|verified|passed|failed|worked|restored|persisted|resolved|unresolved|unknown|untested|unconfirmed|inconclusive|(?:not|never) (?:yet )?(?:established|confirmed|tested|run|fixed|resolved)|(?:status|outcome|result)s?\s*:)"
QUESTION = r"(?i)\s*(?:how|why|what|when|which|did|does|is|was)\b"
LITERAL = r"[`\"]([^`\"\n]{1,160})[`\"]|\b(\w+(?:[_.:/\\-]\w+)+)\b"
NO_TOPIC = frozenset("happen happened actually ever".split())
SHARED, TOLD, ASKED, HEADED = 3.0, 2.0, 2.0, 3.0  # weights of a sentence's features


def sentences(hits: DataFrame, id_col: str, text_col: str = "text", *more: str) -> DataFrame:
    """(id, start, end, said, ...) of each sentence or line that is not blank, in code points; `said` is trimmed."""
    pieces = hits.select(id_col, *more, F.posexplode(F.split(F.col(text_col), _ENDS, -1)).alias("n", "piece"))
    before = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.length("piece") - F.length(F.regexp_replace("piece", r"^\s+", ""))
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + lead
    said = F.regexp_replace("piece", r"^\s+|\s+$", "")
    placed = pieces.select(id_col, *more, start.cast("long").alias("start"), said.alias("said")).where("said <> ''")
    return placed.withColumn("end", F.col("start") + F.length("said"))


def around(said: Column, at: Column, size: int = PREVIEW) -> Column:
    """A sentence as it stands, or whole words of it around a place (from 0) with ellipses where it is longer."""
    begin = F.greatest(F.least(at - size // 3, F.length(said) - (size - 2)), F.lit(0))
    cut = F.substring(said, (begin + 1).cast("int"), F.lit(size - 2))
    more = F.length(said) > begin + size - 2
    cut = F.when(begin > 0, F.regexp_replace(cut, r"^\S{0,40}\s+", "")).otherwise(cut)
    cut = F.when(more, F.regexp_replace(cut, r"\s+\S{0,40}$", "")).otherwise(cut)
    framed = F.concat(F.when(begin > 0, "…").otherwise(""), cut, F.when(more, "…").otherwise(""))
    return F.when(F.length(said) <= size, said).otherwise(framed)


def select_sentences(hits: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", low: str | None = None, high: str | None = None) -> DataFrame:
    """(id, start, end, preview): the sentence of each hit in which its answer is best read; one row for each text that has any.

    It is the first with a word of the query; where that is a heading, the first statement below it (`Status: ...`) or else
    the first full sentence. A statement that names a literal of the query goes to the first sentence that has both. Where
    the columns `low` and `high` give the chunk that the meaning points to, the sentences with a word of the query and those
    of the chunk compete, if the first was no heading or the query asks: for the topic's words, for telling an outcome where
    one is asked, and against headings and questions.
    """
    terms = X.query_plan(query)[0]
    asks, outcome = "?" in query or bool(re.match(QUESTION, query)), bool(re.search(ASKS_OUTCOME, query))
    literals = [] if asks else [a or b for a, b in re.findall(LITERAL, query)]
    topic = [w for w in terms if w not in NO_TOPIC and not (outcome and re.fullmatch(ASKS_OUTCOME, w))]
    words = lambda of: F.array(*map(F.lit, of)).cast("array<string>")
    more = [c for c in (low, high) if c]
    said, start, end, own = F.col("said"), F.col("start"), F.col("end"), Window.partitionBy(id_col)
    rows = sentences(hits, id_col, text_col, *more).withColumn("words", X.tokens(said))
    head = said.rlike(r"^#{1,6}\s") | (F.upper(said) == said) & (F.lower(said) != said)
    full = (F.length(said) >= FULL) & ~head & ~said.startswith("#") & ~said.rlike(PARTICULARS)
    named = said.rlike("(?i)(?<!\\w)(?:" + "|".join(re.escape(x) for x in literals) + ")(?!\\w)") if literals else F.lit(False)
    featured = rows.withColumns({"found": F.arrays_overlap("words", words(terms)) if terms else F.lit(False), "head": head, "full": full, "states": said.rlike(STATEMENT), "named": named})
    given = F.col(low).cast("long") if low else F.lit(None).cast("long")
    first = F.coalesce(F.min(F.when(F.col("found"), start)).over(own), F.max(F.when((start <= given) & (given < end), start)).over(own), F.min(start).over(own))
    placed = featured.withColumn("first", first)
    placed = placed.withColumn("below", F.max(F.when((start == F.col("first")) & F.col("head"), end)).over(own))
    under = (start >= F.col("below")) & (start < F.col("below") + BELOW)
    moved = F.coalesce(F.min(F.when(under & F.col("states"), start)).over(own), F.min(F.when(under & F.col("full"), start)).over(own))
    placed = placed.withColumn("default", F.coalesce(moved, F.col("first"))).withColumn("is_default", start == F.col("default"))
    exact = F.col("named") & (F.col("found") | F.col("is_default"))
    worth, rival = F.lit(0.0), F.col("is_default") | exact
    if low and high:
        shared = F.size(F.array_intersect("words", words(topic))) if topic else F.lit(0)
        inside = (start >= F.col(low)) & (start < F.col(high))
        open_question = F.coalesce(F.max(F.when(F.col("is_default"), said.endswith("?"))).over(own), F.lit(False))
        told = said.rlike(TELLS_OUTCOME) & ~said.endswith("?") & ((shared > 0) | F.lit(not topic) | open_question | F.col("is_default")) if outcome else F.lit(False)
        worth = SHARED * shared / max(1, len(topic)) + inside.cast("double") + F.when(told, TOLD).otherwise(0.0)
        if asks:
            worth -= F.when(said.endswith("?"), ASKED).otherwise(0.0) + F.when(said.startswith("#") | F.col("head") & ~F.contains(said, F.lit(":")), HEADED).otherwise(0.0)
        compete = F.col(low).isNotNull() & F.col(high).isNotNull() & (F.lit(asks or outcome) | (F.col("default") == F.col("first")))
        rival, worth = rival | compete & (F.col("found") | inside), F.when(compete, worth).otherwise(0.0)
    ranked = placed.select(id_col, "start", "end", "said", "first", rival.alias("rival"), F.struct(exact.alias("exact"), worth.alias("worth"), "is_default", (-start).alias("early")).alias("rank")).where("rival")
    best = ranked.groupBy(id_col).agg(F.max_by(F.struct("start", "end", "said", "first"), "rank").alias("b"))
    place = F.when(F.col("b.first").between(F.col("b.start"), F.col("b.end")), F.col("b.first") - F.col("b.start")).otherwise(0)
    word = F.regexp_instr(X.fold(F.col("b.said")), F.lit(r"(?<![\p{L}\p{N}])(?:" + "|".join(terms) + r")(?![\p{L}\p{N}])")) - 1 if terms else place
    return best.select(id_col, F.col("b.start").alias("start"), F.col("b.end").alias("end"), around(F.col("b.said"), F.greatest(word, F.lit(0))).alias("preview"))


def with_passages(hits: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, preview, passage) for each hit: its first span, the sentence to read, its best window; null without one."""
    read = select_sentences(hits, query, id_col, text_col).select(id_col, "preview")
    spans = passages.best_windows(hits, query, id_col, text_col)
    return spans.join(read, id_col, "left").select(id_col, "start", "end", F.when(F.col("start").isNotNull(), F.col("preview")).alias("preview"), "passage")
