"""Language identification by a linear-chain conditional random field over words.

A word's emission scores are sums over its affixes, its character n-grams and the word itself (the lexicon), hashed into a
table of fixed size. Transitions are learned, so that labels may switch inside a text; forward and backward passes run over
all sentences of a batch at once. A document's language is the label with the largest share of its words' marginals.

Training fits on a bounded sample of labelled rows (`rows_per_language` of each language, chosen by a hash of the id). Since
labels are given for documents, not words, a first fit without transitions labels the sentences of the sample, and the field
is then fitted on these labels, which switch where texts do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_steps, map_rows
from .tokens import Words, letter_table, mix

FEATURE_BITS = 18
ROWS_PER_LANGUAGE = 250
UNDETERMINED = "und"
_ENDS = np.array([ord(c) for c in "\n.!?"], np.uint32)
_SALTS = mix(np.arange(1, 10, dtype=np.uint64))


def features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table indices of the features of the words `which`, word after word, and where each word's begin."""
    start, end = words.start[which], words.end[which]
    size = end - start
    parts, owner = [words.hash[which] + _SALTS[0]], [np.arange(len(which))]
    for n in (1, 2, 3):
        have = np.flatnonzero(size >= n)
        parts += [words.span_hash(start[have], start[have] + n) + _SALTS[n], words.span_hash(end[have] - n, end[have]) + _SALTS[n + 3]]
        owner += [have, have]
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    of = np.repeat(np.arange(len(which)), size)
    for n in (2, 3):
        have = np.flatnonzero(at + n <= end[of])
        parts.append(words.span_hash(at[have], at[have] + n) + _SALTS[n + 5])
        owner.append(of[have])
    index = (mix(np.concatenate(parts)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return index[order], np.searchsorted(owner[order], np.arange(len(which)))


@dataclass
class Texts:
    """The words of some texts, their distinct words' features, and where their sentences begin."""

    words: Words
    inverse: np.ndarray
    index: np.ndarray
    offsets: np.ndarray
    lettered: np.ndarray
    begin: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Texts:
        words = Words(texts)
        _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        index, offsets = features(words, first)
        letters = np.concatenate([[0], np.cumsum(letter_table()[words.points])])
        lettered = letters[words.end] > letters[words.start]
        stops = np.concatenate([[0], np.cumsum(np.isin(words.points, _ENDS))])
        sentence = stops[words.start]
        begin = np.flatnonzero(np.diff(sentence, prepend=-1) != 0)
        return cls(words, inverse, index, offsets, lettered, begin, np.diff(np.append(begin, len(sentence))))

    def emissions(self, table: np.ndarray) -> np.ndarray:
        if not len(self.offsets):
            return np.zeros((0, table.shape[1]), table.dtype)
        return np.add.reduceat(table[self.index], self.offsets, axis=0)[self.inverse] * self.lettered[:, None]

    def gradient(self, by_word: np.ndarray, size: int) -> np.ndarray:
        counts = np.diff(np.append(self.offsets, len(self.index)))
        out = np.empty((size, by_word.shape[1]))
        for k in range(by_word.shape[1]):
            own = np.bincount(self.inverse, by_word[:, k] * self.lettered, len(self.offsets))
            out[:, k] = np.bincount(self.index, np.repeat(own, counts), size)
        return out


def forward_backward(emission: np.ndarray, begin: np.ndarray, length: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """Marginals of every word's labels and, if asked for, the expected number of each pair of neighbouring labels."""
    n, k = emission.shape
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    e = np.exp(emission - emission.max(axis=1, keepdims=True)) if n else emission
    move = np.exp(transition - transition.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # sentences longer than t
    last = None
    for t in range(steps):
        at = begin[: active[t]] + t
        a = e[at] if t == 0 else (last[: active[t]] @ move) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = last = a
    expected = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        after = begin[: active[t + 1]] + t + 1
        ahead = e[after] * beta[after]
        if pairs:
            left = alpha[after - 1]
            joint = left[:, :, None] * move[None] * ahead[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = ahead @ move.T
        b /= b.sum(axis=1, keepdims=True)
        beta[after - 1] = b
    marginal = alpha * beta
    if n:
        marginal /= marginal.sum(axis=1, keepdims=True)
    return (marginal, expected) if pairs else marginal


@dataclass
class Field:
    languages: list[str]
    table: np.ndarray
    transition: np.ndarray

    def marginals(self, texts: Texts) -> np.ndarray:
        return forward_backward(texts.emissions(self.table), texts.begin, texts.length, self.transition)


class _Adam:
    def __init__(self, x: np.ndarray, rate: float):
        self.x, self.rate, self.m, self.v, self.t = x, rate, np.zeros_like(x), np.zeros_like(x), 0

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def fit(texts: list[str], languages: list[str], passes: int = 4, batch_chars: int = 150_000, decay: float = 1e-5) -> Field:
    names = sorted(set(languages))
    k = len(names)
    label = np.array([names.index(x) for x in languages])
    batches = [(Texts.of(part), label[i : i + len(part)]) for i, part in in_steps(texts, batch_chars)]
    table, transition = np.zeros((1 << FEATURE_BITS, k)), np.zeros((k, k))
    if k < 2:
        return Field(names, table.astype(np.float32), transition)
    adam = _Adam(table, 0.05)
    for _ in range(passes):  # words alone, labelled as their documents are
        for part, y in batches:
            z = part.emissions(table)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), y[part.words.doc]] -= 1
            adam.step(part.gradient(p, len(table)) / max(1, len(p)) + decay * table)
    targets = []
    for part, _ in batches:  # each sentence by its words together
        z = part.emissions(table)
        best = np.add.reduceat(z, part.begin, axis=0).argmax(axis=1) if len(z) else np.zeros(0, int)
        targets.append(np.repeat(best, part.length))
    adam, moves = _Adam(table, 0.02), _Adam(transition, 0.1)
    for _ in range(passes):
        for (part, _), y in zip(batches, targets, strict=True):
            marginal, expected = forward_backward(part.emissions(table), part.begin, part.length, transition, pairs=True)
            marginal[np.arange(len(y)), y] -= 1
            inside = np.ones(len(y), bool)
            inside[part.begin] = False
            at = np.flatnonzero(inside)
            seen = np.bincount(y[at - 1] * k + y[at], minlength=k * k).reshape(k, k)
            n = max(1, len(y))
            adam.step(part.gradient(marginal, len(table)) / n + decay * table)
            moves.step((expected - seen) / n + 0.01 * transition)
    return Field(names, table.astype(np.float32), transition)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Field:
    """Fit on about `rows_per_language` rows of each language that are not held out, with text and language not null."""
    spark = docs.sparkSession
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}  # a row for each language
    draw = F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1 << 30))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, int(min(1.0, rows_per_language / n) * (1 << 30))).otherwise(share)
    chosen = usable.where(draw < share).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), draw.alias("draw"))
    rows = sorted(chosen.toPandas().itertuples(index=False), key=lambda r: (r.draw, r.lang, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """The language of every whole text: (id, held_out, lang_pred, score), and with `spans` the runs of equally labelled words.

    lang_pred is `und`, score 0, where the text is null or has no letter, or nothing was learned. Words without a letter have
    no say. A null id is never held out. score is the share of the words' marginals that the language has.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size

    def each(batch: pa.RecordBatch):
        field = sent.value
        k = len(field.languages)
        langs: list[str] = []
        scores: list[float] = []
        runs: list[list[dict]] = []
        for _, texts in in_steps(batch.column(2).to_pylist()):
            part = Texts.of(texts)
            if not k:
                langs += [UNDETERMINED] * len(texts)
                scores += [0.0] * len(texts)
                runs += [[]] * len(texts)
                continue
            marginal = field.marginals(part)
            weight = np.where(part.lettered, 1.0, 0.0)
            sums = np.stack([np.bincount(part.words.doc, marginal[:, j] * weight, len(texts)) for j in range(k)], 1)
            total = np.bincount(part.words.doc, weight, len(texts))
            best = sums.argmax(axis=1)
            some = total > 0
            share = np.clip(sums[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
            langs += [field.languages[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)]
            scores += np.where(some, share, 0.0).tolist()
            if spans:
                tag = marginal.argmax(axis=1)
                cut = np.flatnonzero((np.diff(tag, prepend=-1) != 0) | (np.diff(part.words.doc, prepend=-1) != 0))
                own: list[list[dict]] = [[] for _ in texts]
                for a, b in zip(cut, np.append(cut[1:], len(tag)), strict=True):
                    d = part.words.doc[a]
                    own[d].append({"lang": field.languages[tag[a]], "first_word": int(a - part.words.first[d]), "n_words": int(b - a)})
                runs += own
        columns = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        names = [id_col, "held_out", "lang_pred", "score"]
        if spans:
            columns.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))))
            names.append("spans")
        yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(id_col, held_out(id_col).alias("held_out"), text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return map_rows(rows, each, f"{id_col} {kind}, held_out boolean, lang_pred string, score double" + ", spans array<struct<lang string, first_word long, n_words long>>" * spans)
