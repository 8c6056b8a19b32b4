"""Hard negatives of embeddings by angular triangle filtering.

Every vector keeps its angles to a few reference directions (the means of the most frequent
labels).  Angles are a metric: two vectors at angles s and t to one direction are between
|s - t| and s + t apart, so their cosine lies between cos(s + t) and cos(s - t); times both
norms, with a margin for rounding, that bounds their score.  Of several directions the
narrowest bounds hold.  Rows whose bounds cannot reach an anchor's best positives, or the
window of its negatives, are passed over; the others are scored exactly as integers.

Rows lie in groups of bounded size, ordered by label and angle; the anchors, a stated share of
the rows, visit every group as a stream.  A group hands on no more than the first few of each
list, so a list is never gathered whole.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no
part; shorter vectors are read as ending in zeros; a zero vector scores 0 with everything; a
null vec_id is no anchor and comes last among ties; repeated rows are rows of their own, and
one with the anchor's id is another row; an empty table gives no rows; other columns play no
part.  Scores are exact whatever their size; one beyond 64 bits is written as the nearest
64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.llm.common import cut_lineage, shuffle_width

REFERENCES = 16
# Rows of a group, held by one task, and anchors compared with them at once.
GROUP = 32_768
AT_ONCE = 128
POSITIVES = 5
NEGATIVES = 10
# Bounds in percent of the positive's score.
LOW, HIGH = 30, 90
ANCHORS = 100
SCALE = 256.0
# Far above the error of an angle (1e-7 at most, where it is near 0 or half a turn).
MARGIN = 1e-6
EXACT = 2.0**53


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, labels of ids divisible by 7 moved on."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select("vec_id", moved.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


def _matrix(vectors, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * SCALE)


def reference_directions(rows: DataFrame, size: int, count: int = REFERENCES) -> np.ndarray:
    """Unit means of the ``count`` most frequent labels: ``count`` times ``size`` numbers."""
    labels = [r.label for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(count).collect()]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(labels), size))
        for batch in batches:
            units = _units(_matrix(batch["vector"].tolist(), size))[0]
            at = batch["label"].to_numpy()
            for i, label in enumerate(labels):
                total[i] += units[at == label].sum(axis=0)
        yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})

    found = rows.where(F.col("label").isin(labels)).mapInPandas(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(len(labels) * size)
    for r in found:
        total[r["at"]] = r["value"]
    return _units(total.reshape(len(labels), size))[0]


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(norms > 0, norms, 1.0)[:, None], norms


def prepared(rows: DataFrame, size: int, directions: np.ndarray) -> DataFrame:
    """Integer vectors with their norms and their angles to the directions, in groups of
    (label, angle) ranges; a crowd of equal vectors fills as many groups as it needs."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = _matrix(batch["vector"].tolist(), size)
            units, norms = _units(vectors)
            angles = np.arccos(np.clip(units @ directions.T, -1.0, 1.0))
            yield pd.DataFrame(
                {
                    "row": batch["row"], "vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"], "norm": norms, "near": angles.min(axis=1) if len(directions) else norms,
                    "vector": [v.tobytes() for v in vectors], "angles": [a.tobytes() for a in angles],
                }
            )

    schema = "row long, vec_id long, label long, norm double, near double, vector binary, angles binary"
    marked = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "rows").mapInPandas(measured, schema)
    marked = cut_lineage(marked, "angles")
    groups = max(shuffle_width(rows.sparkSession), -(-marked.count() // GROUP))
    dealt = marked.repartitionByRange(groups, "label", "near", "row").withColumn("group", F.spark_partition_id())
    return cut_lineage(dealt, "groups")


class _Rows:
    """Rows of one group or some anchors, as arrays."""

    def __init__(self, frame: pd.DataFrame, size: int):
        def stacked(column: str, width: int) -> np.ndarray:
            return np.frombuffer(b"".join(frame[column]), np.float64).reshape(len(frame), width)

        self.row = frame["row"].to_numpy()
        ids = frame["vec_id"]
        # a null id comes after all others
        self.no_id = ids.isna().to_numpy()
        self.id = ids.fillna(0).to_numpy("int64")
        self.label = frame["label"].to_numpy("int64")
        self.norm = frame["norm"].to_numpy()
        self.vector = stacked("vector", size)
        angles = np.frombuffer(b"".join(frame["angles"]), np.float64).reshape(len(frame), -1)
        self.cos, self.sin = np.cos(angles), np.sin(angles)


def bounds(anchors: _Rows, rows: _Rows, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor with each of the rows ``at``."""
    low = np.full((len(anchors.row), len(at)), -1.0)
    high = np.ones_like(low)
    for r in range(anchors.cos.shape[1]):
        even = anchors.cos[:, r, None] * rows.cos[None, at, r]
        odd = anchors.sin[:, r, None] * rows.sin[None, at, r]
        np.maximum(low, even - odd, out=low)
        np.minimum(high, even + odd, out=high)
    scale = anchors.norm[:, None] * rows.norm[None, at]
    return scale * (low - MARGIN) - 1, scale * (high + MARGIN) + 1


def scores(anchors: _Rows, rows: _Rows, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact integer scores: doubles while all are below 2^53, else Python's integers."""
    a, b = anchors.vector[which], rows.vector[at]
    if not len(at) or not len(which) or anchors.norm[which].max() * rows.norm[at].max() < EXACT:
        return a @ b.T
    exact = np.frompyfunc(int, 1, 1)
    return exact(a).dot(exact(b).T)


def _first(score: np.ndarray, rows: _Rows, at: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` by falling score, then rising id."""
    if len(at) > 4 * count and score.dtype != object:
        least = np.partition(score, len(score) - count)[len(score) - count]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(at))
    order = sorted(some.tolist(), key=lambda i: (-score[i], rows.no_id[at[i]], rows.id[at[i]])) if len(some) <= 64 or score.dtype == object else some[np.lexsort((rows.id[at[some]], rows.no_id[at[some]], -score[some]))].tolist()
    return np.array(order[:count], np.int64)


def _as_long(value) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(value)))


def _visits(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[_Rows, pd.DataFrame, _Rows]]:
    """Rows of a group with each block of the anchors that visit it; rows come first."""
    held: list[pd.DataFrame] = []
    group, ready = None, None
    for batch in batches:
        for number, part in batch.groupby("group", sort=False):
            if number != group:
                group, held, ready = number, [], None
            rows, visitors = part[~part["anchor"]], part[part["anchor"]]
            if len(rows):
                held.append(rows)
            if len(visitors) and held:
                if ready is None:
                    ready = _Rows(pd.concat(held, ignore_index=True), size)
                for lo in range(0, len(visitors), AT_ONCE):
                    block = visitors.iloc[lo : lo + AT_ONCE].reset_index(drop=True)
                    yield ready, block, _Rows(block, size)


def _dealt(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Rows and, after them, all anchors in every group."""
    extra = [c for c in anchors.columns if c not in rows.columns]
    kinds = dict(anchors.dtypes)
    visitors = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("anchor", F.lit(True))
    own = rows.select("*", F.lit(False).alias("anchor"), *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    return own.unionByName(visitors).repartition(max(groups, shuffle_width(rows.sparkSession)), "group").sortWithinPartitions("group", "anchor")


def best_positives(rows: DataFrame, anchors: DataFrame, groups: int, size: int, count: int = POSITIVES) -> DataFrame:
    """(anchor, place, positive_id, positive_score): the first rows of the anchor's label."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, block, anchors in _visits(batches, size):
            out = []
            for label in np.unique(anchors.label):
                which, at = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
                if not len(at):
                    continue
                of_label = _Rows(block.iloc[which], size)
                low, high = bounds(of_label, rows, at)
                if len(at) > count + 1:
                    # so many rows are sure to reach this score, the anchor itself not counted
                    sure = np.partition(low, len(at) - count - 1, axis=1)[:, len(at) - count - 1]
                    at = at[(high >= sure[:, None]).any(axis=0)]
                score = scores(of_label, rows, np.arange(len(which)), at)
                for i, w in enumerate(which):
                    other = np.flatnonzero(rows.row[at] != anchors.row[w])
                    for j in other[_first(score[i, other], rows, at[other], count)]:
                        x = at[j]
                        out.append((anchors.row[w], None if rows.no_id[x] else int(rows.id[x]), int(rows.row[x]), _as_long(score[i, j])))
            frame = pd.DataFrame(out, columns=["anchor", "positive_id", "positive_row", "positive_score"])
            frame["positive_id"] = pd.array(frame["positive_id"], "Int64")
            yield frame

    found = _dealt(rows, anchors, groups).mapInPandas(compare, "anchor long, positive_id long, positive_row long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).select("anchor", "place", "positive_id", "positive_score")


def best_negatives(rows: DataFrame, anchors: DataFrame, groups: int, size: int, count: int = NEGATIVES) -> DataFrame:
    """(anchor, place, rank, negative_id, negative_score) of anchors that carry the scores of
    their positives (``goals``, by place)."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, block, anchors in _visits(batches, size):
            # the least and the greatest score allowed, in whole numbers
            windows = [[(-(-LOW * int(g) // 100), HIGH * int(g) // 100) for g in goals] for goals in block["goals"]]
            least = np.array([min(w[0] for w in ws) for ws in windows], float)
            most = np.array([max(w[1] for w in ws) for ws in windows], float)
            everyone = np.arange(len(rows.row))
            low, high = bounds(anchors, rows, everyone)
            slack = 1e-9 * np.maximum(abs(least), abs(most))
            open_ = (high >= (least - slack)[:, None]) & (low <= (most + slack)[:, None]) & (anchors.label[:, None] != rows.label[None, :])
            at = np.flatnonzero(open_.any(axis=0))
            score = scores(anchors, rows, np.arange(len(windows)), at)
            out = []
            for i, ws in enumerate(windows):
                mine = np.flatnonzero(open_[i, at])
                for place, (lo, hi) in enumerate(ws, 1):
                    inside = mine[((score[i, mine] >= lo) & (score[i, mine] <= hi)).astype(bool)]
                    for j in inside[_first(score[i, inside], rows, at[inside], count)]:
                        x = at[j]
                        out.append((anchors.row[i], place, None if rows.no_id[x] else int(rows.id[x]), int(rows.row[x]), _as_long(score[i, j])))
            frame = pd.DataFrame(out, columns=["anchor", "place", "negative_id", "negative_row", "negative_score"])
            frame["negative_id"] = pd.array(frame["negative_id"], "Int64")
            yield frame

    found = _dealt(rows, anchors, groups).mapInPandas(compare, "anchor long, place int, negative_id long, negative_row long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).drop("negative_row")


def hard_negatives(embeddings: DataFrame, references: int = REFERENCES) -> DataFrame:
    """For each anchor and each of its positives, the first negatives inside the window."""
    rows = cut_lineage(usable(embeddings), "usable")
    size = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    directions = reference_directions(rows, size, references)
    dealt = prepared(rows, size, directions)
    groups = (dealt.agg(F.max("group")).first()[0] or 0) + 1
    anchors = dealt.where(F.col("vec_id") % ANCHORS == 0).drop("group")
    positives = cut_lineage(best_positives(dealt, anchors, groups, size), "positives")
    goals = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("goals"))
    asking = anchors.join(goals.withColumnRenamed("anchor", "row"), "row")
    negatives = best_negatives(dealt, asking, groups, size)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return negatives.join(positives, ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("long").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::bigint + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::double)) AS ints
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.ints, b.ints)::bigint AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT rid, anchor_id, other AS pos_rid, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.rid, p.pos_rid ORDER BY s.score DESC, s.other_id) AS rank,
         s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT * FROM n WHERE rank <= 10
"""
