"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors of a label become one representative. Representatives are dealt into tiles along the first principal
component; pairs of tiles whose boxes on the leading components lie too far apart are not built. A pair of tiles is compared
in blocks, again skipped by their boxes: dot products accumulate over the leading principal dimensions first, the rest is
bounded by the product of the suffix norms (Cauchy and Schwarz), and a pair of vectors is left as soon as its cosine cannot
reach the threshold. For survivors the cosine is worked out anew from the vectors as they stand, in double precision, and
compared with the threshold without any slack.

A pair of tiles emits link counts and a spanning forest of its links, never the links themselves, so a group of near
copies costs a few rows a member.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, map_rows, stored
from .graph import connected_components, forest

THRESHOLD = 0.93
#: Components that a tile holds, so that tiles of long vectors have fewer rows; no tile has fewer than the least number of rows.
TILE_VALUES, LEAST_TILE = 1 << 17, 128
BLOCK_ROWS = 512
STEPS = (8, 16, 32)
#: Leading components on which boxes are kept.
BOX = 4
#: Principal axes are worked out for the most frequent vector lengths, as long as their matrices hold no more values than this in all (32 MB); others keep their own axes.
AXES_VALUES = 1 << 22
#: What rounding may take from a bound; survivors are decided exactly.
_SLACK = 1e-9
_BANDS = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square under- or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each of the chosen vector lengths, the eigenvectors of the second moments of all unit vectors, largest eigenvalue first."""
    chosen, left = [], AXES_VALUES
    for r in vectors.select(F.size("v").alias("d")).where(f"d * d <= {AXES_VALUES}").groupBy("d").count().orderBy(F.desc("count"), "d").limit(AXES_VALUES.bit_length()).collect():
        if r.d * r.d <= left:
            chosen.append(r.d)
            left -= r.d * r.d

    def each(batches):
        sums: dict[int, np.ndarray] = {}  # one matrix of each length for a whole partition
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy()
            for d in np.unique(lengths):
                m = unit(np.asarray(batch.column(0).take(pa.array(np.flatnonzero(lengths == d))).to_pylist(), float))
                sums[int(d)] = sums.get(int(d), 0.0) + m.T @ m
        for d, m in sums.items():
            for begin in range(0, d, max(1, (1 << 18) // d)):
                part = m[begin : begin + max(1, (1 << 18) // d)]
                i, j = np.divmod(np.arange(part.size), d)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.size, d)), pa.array(i + begin), pa.array(j), pa.array(part.ravel())], ["d", "i", "j", "s"])

    some = vectors.where(F.size("v").isin(chosen)).select("v") if chosen else vectors.select("v").limit(0)
    moments = some.mapInArrow(each, "d long, i long, j long, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    axes = {}
    for d, rows in moments.groupby("d"):
        m = np.zeros((d, d))
        m[rows.i, rows.j] = rows.s
        axes[int(d)] = np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1])
    return axes


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of rows of a and b, unit vectors on principal axes, whose dot product may reach the threshold; i < j if `same`."""
    d = a.shape[1]
    ends = [*(k for k in STEPS if k < d), d]
    tail = [[np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x[:, :k], x[:, :k]), 0)) for k in ends] for x in (a, b)]
    acc = a[:, : ends[0]] @ b[:, : ends[0]].T
    alive = acc + tail[0][0][:, None] * tail[1][0][None, :] >= threshold - _SLACK
    if same:
        alive &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    i, j = np.nonzero(alive)
    acc = acc[i, j]
    for k in range(1, len(ends)):
        if not len(i):
            break
        low, high = ends[k - 1], ends[k]
        if len(i) * 8 > len(a) * len(b):
            acc = acc + (a[:, low:high] @ b[:, low:high].T)[i, j]
        else:
            acc = acc + np.einsum("ij,ij->i", a[i, low:high], b[j, low:high])
        alive = acc + tail[0][k][i] * tail[1][k][j] >= threshold - _SLACK
        i, j, acc = i[alive], j[alive], acc[alive]
    return i, j


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of two arrays of vectors as they stand."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def tile_links(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of rows of two tiles with cosine >= threshold, block by block; i < j if they are the same tile."""
    reach = max(0.0, 2 - 2 * threshold) + _SLACK
    a, b = (unit(v) if axes is None else unit(v) @ axes for v in (x, y))
    starts = [range(0, len(v), BLOCK_ROWS) for v in (a, b)]
    boxes = [[(v[s : s + BLOCK_ROWS, :BOX].min(axis=0), v[s : s + BLOCK_ROWS, :BOX].max(axis=0)) for s in own] for v, own in zip((a, b), starts, strict=True)]
    found = []
    for s, (low_a, high_a) in zip(starts[0], boxes[0], strict=True):
        for t, (low_b, high_b) in zip(starts[1], boxes[1], strict=True):
            gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
            if same and t < s or gap @ gap > reach:
                continue
            i, j = linked_pairs(a[s : s + BLOCK_ROWS], b[t : t + BLOCK_ROWS], threshold, same and s == t)
            for k in range(0, len(i), 1 << 14):
                p, q = i[k : k + (1 << 14)] + s, j[k : k + (1 << 14)] + t
                sure = exact_cosine(x[p], y[q]) >= threshold
                found.append((p[sure], q[sure]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def tiled(flat: DataFrame, tile_rows: int | None = None) -> DataFrame:
    """(label, d, tile, p, rep, copies, v): rows in bands of the first component `p`, each parted by hash into tiles of the planned size."""
    cuts = [k / _BANDS for k in range(1, _BANDS)]
    spread = flat.groupBy("label", "d").agg(F.count("*").alias("n"), F.percentile_approx("p", cuts).alias("cuts"))
    tiles = F.ceil(F.col("n") / (F.lit(tile_rows) if tile_rows else F.greatest(F.floor(F.lit(TILE_VALUES) / F.col("d")), F.lit(LEAST_TILE))))
    parts = F.ceil(tiles / _BANDS)
    below, upto = (F.size(F.filter("cuts", is_under)) for is_under in (lambda c: c < F.col("p"), lambda c: c <= F.col("p")))
    tied = F.pmod(F.xxhash64("rep", F.lit(3)), upto - below + 1)  # rows on a cut, or on many, are dealt over the bands that meet there
    band = F.floor((below + tied) * F.least(tiles, F.lit(_BANDS)) / _BANDS)
    return flat.join(spread, ["label", "d"]).select("label", "d", (band * parts + F.pmod(F.xxhash64("rep"), parts)).cast("long").alias("tile"), "p", "rep", "copies", "v")


def embedding_classes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile_rows: int | None = None) -> DataFrame:
    """For each vector: n_links (others of its label with cosine >= threshold), component_id (smallest reachable id), kept.

    Vectors that are null, empty, zero, hold null or non-finite components, or have no label or id, link with nothing, nor
    do vectors of different lengths. Rows that repeat whole are copies of each other. An empty table gives no rows. The cost
    is that of comparing all vectors of a label in the leading dimensions, less what boxes and bounds leave out.
    """
    element = "double" if df.schema[vector_col].dataType.elementType == T.DoubleType() else "float"
    width = np.dtype(np.float64 if element == "double" else np.float32)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v"), F.col(label_col).alias("label"))
    sound = F.expr(f"id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < {element}('infinity')) and exists(v, x -> x != 0)")
    valid = rows.where(F.coalesce(sound, F.lit(False)))
    axes_of = principal_axes(valid)
    axes = df.sparkSession.sparkContext.broadcast(axes_of)  # AXES_VALUES numbers at most
    reps = cut_lineage(valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    first = F.lit(0.0)
    for d, v in axes_of.items():
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        dot = F.aggregate(F.zip_with("v", F.array(*map(F.lit, v[:, 0].tolist())), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
        first = F.when(F.size("v") == d, F.coalesce(F.try_divide(dot, norm), F.lit(0.0))).otherwise(first)  # only deals the rows out
    flat = reps.withColumns({"d": F.size("v"), "p": first})
    dealt = tiled(flat, tile_rows)
    id_type = df.schema[id_col].dataType.simpleString()
    label_type = df.schema[label_col].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.asarray(x, width) for x in pdf.v])
        own = axes.value.get(v.shape[1])
        lead = unit(v.astype(float)) if own is None else unit(v.astype(float)) @ own[:, :BOX]
        order = np.lexsort((lead[:, 0], np.digitize(lead[:, min(1, lead.shape[1] - 1)], np.linspace(-1, 1, 33))))
        lead = lead[order][:, :BOX]
        one = {"label": pdf.label.iloc[0], "d": v.shape[1], "tile": pdf.tile.iloc[0], "low": lead.min(axis=0), "high": lead.max(axis=0), "reps": pdf.rep.iloc[order].tolist(), "copies": pdf.copies.iloc[order].tolist(), "rows": v[order].tobytes()}
        return pd.DataFrame([one])

    packed = cut_lineage(dealt.groupBy("label", "d", "tile").applyInPandas(pack, f"label {label_type}, d int, tile long, low array<double>, high array<double>, reps array<{id_type}>, copies array<long>, rows binary"))
    thin = packed.select("label", "d", "tile", "low", "high")
    a, b = (thin.select("label", "d", *(F.col(c).alias(f"{c}_{k}") for c in ("tile", "low", "high"))) for k in "ab")
    gap = F.aggregate(F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda total, x: total + x * x)
    near = a.join(b, ["label", "d"]).where((F.col("tile_a") <= F.col("tile_b")) & (gap <= max(0.0, 2 - 2 * threshold) + _SLACK)).select("label", "d", "tile_a", "tile_b")
    left, right = (packed.select("label", "d", F.col("tile").alias(f"tile_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("reps", "copies", "rows"))) for k in "ab")
    pairs = near.join(left, ["label", "d", "tile_a"]).join(right, ["label", "d", "tile_b"]).select("d", (F.col("tile_a") == F.col("tile_b")).alias("same"), *(f"{c}_{k}" for k in "ab" for c in ("reps", "copies", "rows")))

    def compare(batch: pa.RecordBatch):
        for r in range(batch.num_rows):
            d, same = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
            sides, ids, copies = [], [], []
            for k in (2, 5):
                sides.append(np.frombuffer(batch.column(k + 2)[r].as_py(), width).reshape(-1, d).astype(float))
                ids.append(batch.column(k)[r].as_py())
                copies.append(np.asarray(batch.column(k + 1)[r].as_py(), np.int64))
            i, j = tile_links(*sides, axes.value.get(d), threshold, same)
            if not len(i):
                continue
            n = len(ids[0])
            links = np.zeros(n + len(ids[1]), np.int64)
            np.add.at(links, i, copies[1][j])
            offset = 0 if same else n
            np.add.at(links, j + offset, copies[0][i])
            all_ids = ids[0] if same else ids[0] + ids[1]
            root = forest(i, j + offset, len(all_ids))
            at = np.flatnonzero(links[: len(all_ids)])
            yield pa.RecordBatch.from_arrays([pa.array([all_ids[x] for x in at]), pa.array([all_ids[root[x]] for x in at]), pa.array(links[at])], ["node", "root", "links"])

    found = stored(map_rows(pairs, compare, f"node {id_type}, root {id_type}, links long"))
    classes = connected_components(found, "node", "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_rep = reps.join(counts, reps.rep == counts.node, "left").drop("node").join(classes, F.col("rep") == classes.node, "left").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of_rep, ["label", "v"], "left")
    own = F.coalesce("component_id", "id")
    ok = F.coalesce(sound, F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        F.when(ok, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(ok, own).otherwise(F.col("id")).alias("component_id"),
        F.coalesce(F.when(ok, own).otherwise(F.col("id")) == F.col("id"), F.lit(True)).alias("kept"),
    )
