"""Spelling variants against brute force over all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import docs_frame
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import spelling

LETTERS = "abcdeénoßÿÀzst"


def one_edit(a, b):
    """Whether b is a with one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows, length=5, least=3, edited=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % edited == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= least}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(spark, rows, **options):
    return sorted((tuple(r) for r in spelling.spelling_groups(docs_frame(spark, rows), **options).collect()), key=lambda r: r[0])


def edits(word, rng):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(LETTERS) + word[i:], word[:i] + rng.choice(LETTERS) + word[i + 1 :]])


def test_variants_of_words(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice(LETTERS) for _ in range(rng.choice([4, 5, 6, 8, 11, 17, 40]))) for _ in range(60)]
    for _ in range(3):  # variants of variants, so that forms are chained
        pool += [edits(rng.choice(pool), rng) for _ in range(150)]
    weights = [2 ** rng.randrange(7) for _ in pool]
    rows = [(i, rng.choice([" ", "\n", "1", "×", "日", "'"]).join(rng.choices(pool, weights, k=rng.choice([3, 60, 400])))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, "12 ×÷ 日本"), (None, "Naïve NAÏVE naÏve naïve abcde abcde abcde"), (903, pool[0]), (903, pool[0]), (904, "aaaaaa " * 5 + "aaaaa " * 5 + "aaaaaaa " * 20)]
    rows += [(905, " ".join(pool * 3)), (906, "x" * 5000 + " " + "x" * 4999)] * 2
    want = by_hand(rows)
    assert got(spark, rows) == want
    assert max(len(w[0]) for w in want) >= 40 and any(w[1] and w[1] != w[2] for w in want) and sum(w[4] > 1 for w in want) > 50
    assert got(spark, rows, edited=3, least_length=1, least_count=1) == [w for w in by_hand(rows, 1, 1, 3)]


def test_no_words(spark):
    assert got(spark, []) == [] and got(spark, [(1, "a b c"), (2, None)]) == []


@given(st.text(alphabet=LETTERS, min_size=1, max_size=24), st.integers(0, 2**31))
@settings(max_examples=400, deadline=None)
def test_neighbourhoods_meet(word, seed):
    """The neighbourhood of one of two words one edit apart holds the other's reduced word; all its keys differ."""
    other = edits(word, random.Random(seed))
    codes = [np.frombuffer(w.encode("latin-1").lower(), np.uint8).reshape(1, -1) for w in (word, other)]
    if not other or codes[0].tolist() == codes[1].tolist():
        return
    own = [int(spelling.own_keys(c)[0]) for c in codes]
    around = [spelling.neighbour_keys(c)[1].tolist() for c in codes]
    assert own[0] in around[1] or own[1] in around[0]
    assert all(len(set(k)) == len(k) for k in around)
