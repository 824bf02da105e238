"""Hard negatives by anchor-clustered shared lists (operator 11).

A query (anchor) looks for the rows of largest inner product: first among rows of
its label, its positives, then among the others, in a window of scores below each
positive.  Vectors have integer components, so scores are exact.

**Grid.**  Rows are dealt by a hash to blocks of at most about ``BLOCK`` rows,
anchors by the signs of their first components to groups of at most about
``GROUP``, so that a group's anchors look the same way.  A task holds one group
and one block.  Positives need rows of the anchor's label alone: there labels,
however uneven, are dealt to blocks of their own.

**Shared lists.**  Within a task the anchors of a group are clustered by angle.
For a cluster of centre ``c`` and largest angle ``t`` no member's score with a row
``x`` exceeds ``|u| |x| cos(max(0, angle(x, c) - t))``.  The block is sorted once
for each cluster by that bound, and every member walks the list, a stretch at a
time, until the bound falls below the worst score it still looks for: nothing
further down can count.  The best of a block meet those of the other blocks in a
ranked window, whose size is bounded by the number of blocks.

Rows with equal label and vector have equal scores everywhere, so only those of
the least ids among them can be returned: a group of copies, however large, is
first cut to as many rows as one list can hold.

Defined results: rows with a null label, a null vector or a component that is
null or not finite take no part; a null id is the least of all and no anchor;
repeated rows are rows of their own, and anchors that are repeated give their
result each; a short vector ends in zeros; a score beyond a long is held at its
end; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, on_workers, partitions, saved

POSITIVES, NEGATIVES = 5, 5
#: Scores of negatives, in hundredths of the positive's.
LOW, HIGH = 80, 100
SCALE = 256
BLOCK, GROUP = 200_000, 32_768
#: Blocks of a small table (so that all cores have work) and their least size.
SPREAD, LEAST_BLOCK = 64, 2048
#: Members of a cluster, rounds of its fitting, first stretch of a walk.
MEMBERS, ROUNDS, STRETCH = 64, 5, 512
_SIGNS = 20
_LONG = 2 ** 63 - 1


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
              scale: int = SCALE) -> DataFrame:
    """``vec_id, label, vector, signs``: the rows that take part, with components
    ``floor(scale * x)`` as 16-bit integers where they fit, else 64-bit."""
    on_workers(rows.sparkSession)
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    plain = (rows.filter(F.col(label_col).isNotNull() & x.isNotNull() & fine)
             .select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("vec_id"),
                     F.col(label_col).cast("long").alias("label"),
                     F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(_SIGNS - 1, -1, -1)
        for b in batches:
            ends, values = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
            vectors = [np.trim_zeros(values[i:j], "b") for i, j in zip(ends, ends[1:])]
            signs = [int((v[:_SIGNS] > 0) @ weights[:len(v)]) for v in vectors]
            data = [_packed(v) for v in vectors]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary()), pa.array(signs, pa.int32())],
                                             ["vec_id", "label", "vector", "signs"])

    return plain.mapInArrow(run, "vec_id long, label long, vector binary, signs int")


def _packed(v: np.ndarray) -> bytes:
    """Little-endian integers and a byte that says how wide they are."""
    small = not len(v) or -32768 <= v.min() and v.max() <= 32767
    return v.astype("<i2").tobytes() + b"s" if small else v.astype("<i8").tobytes() + b"l"


def _matrix(data: list[bytes]) -> np.ndarray:
    if data and {d[-1:] for d in data} == {b"s"} and len({len(d) for d in data}) == 1:
        return np.frombuffer(b"".join(d[:-1] for d in data), "<i2").reshape(len(data), -1)
    vectors = [np.frombuffer(d[:-1], "<i2" if d[-1:] == b"s" else "<i8") for d in data]
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices, equally wide, in the fastest type that sums their products exactly."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    most = math.prod(math.sqrt((m.astype(float) ** 2).sum(1).max(initial=0)) for m in (a, b))
    kind = np.float32 if most < 2 ** 23 else np.float64 if most < 2 ** 52 else object
    return a.astype(kind), b.astype(kind)


def _clusters(unit: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the clusters of directions: k-means by angle from evenly
    spaced rows."""
    k = max(1, len(unit) // MEMBERS)
    centres = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(ROUNDS if k > 1 else 1):
        home = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return [c for c in (np.flatnonzero(home == j) for j in range(k)) if len(c)]


def walk(anchors: np.ndarray, rows: np.ndarray, ids: np.ndarray, wanted: int, windows: list[list[tuple[int, int]]],
         allowed) -> list[list[list[tuple[int, int]]]]:
    """For each anchor and each of its windows ``(low, high)`` of scores the first
    ``wanted`` ``(-score, id)`` of the rows in it.  ``allowed(i, js)`` marks those
    of the rows ``js`` that anchor ``i`` may take."""
    found: list[list[list[tuple[int, int]]]] = [[[] for _ in w] for w in windows]
    if not len(anchors) or not len(rows):
        return found
    a, x = _exact(anchors, rows)
    norms, lengths = (np.linalg.norm(m.astype(float), axis=1) for m in (anchors, rows))
    unit = anchors / np.where(norms > 0, norms, 1)[:, None]
    unit = np.pad(unit, ((0, 0), (0, a.shape[1] - unit.shape[1])))
    wide = np.where(lengths > 0, lengths, 1)
    for members in _clusters(unit):
        centre = unit[members].sum(0)
        length = np.linalg.norm(centre)
        if length > 1e-9:
            centre = centre / length
            spread = np.where(norms[members] > 0, np.arccos(np.clip(unit[members] @ centre, -1, 1)), 0).max()
        else:
            spread = np.pi
        angle = np.arccos(np.clip((x @ centre).astype(float) / wide, -1, 1))
        bound = lengths * np.cos(np.maximum(0, angle - spread - 1e-7))      # arccos is that exact
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        worst = {int(i): [low if low <= high else math.inf for low, high in windows[i]] for i in members if windows[i]}
        at, step = 0, STRETCH
        while worst and at < len(order):
            # the walk of a member is over where the bound is below all it still looks for
            reach = {i: bound[at] * norms[i] * (1 + 1e-9) + 1e-6 * (1 + norms[i]) for i in worst}
            worst = {i: w for i, w in worst.items() if reach[i] >= min(w)}
            if not worst:
                break
            js = order[at:at + step]
            active = list(worst)
            scores = a[active] @ x[js].T
            for i, line in zip(active, scores):
                least, most = min(worst[i]), max(high for _, high in windows[i])
                hit = np.flatnonzero((line >= least) & (line <= most))
                hit = hit[allowed(i, js[hit])] if len(hit) else hit
                for k, (low, high) in enumerate(windows[i]):
                    mine = hit[(line[hit] >= worst[i][k]) & (line[hit] <= high)]
                    if not len(mine):
                        continue
                    if len(mine) > 4 * wanted:      # no more than the ties of the last one wanted
                        mine = mine[line[mine] >= np.sort(line[mine])[-wanted]]
                    held = found[i][k] + [(-int(s), int(d)) for s, d in zip(line[mine], ids[js[mine]])]
                    held.sort()
                    found[i][k] = held[:wanted]
                    if len(held) >= wanted:
                        worst[i][k] = max(low, -held[wanted - 1][0])
            at, step = at + len(js), min(8192, 2 * step)
    return found


def _parts(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def _blocks(spark, n: int) -> int:
    return max(_parts(n, BLOCK), min(SPREAD, partitions(spark), _parts(n, LEAST_BLOCK)))


def _grouped(anchors: DataFrame, label: bool, n: int) -> DataFrame:
    """Anchors with ``grp``: those of like signs together, at most about ``GROUP``."""
    bits = min(_SIGNS, max(0, math.ceil(math.log2(max(1, n / GROUP)))))
    cell = F.shiftright("signs", _SIGNS - bits)
    keys = (["label"] if label else []) + ["cell"]
    sizes = anchors.withColumn("cell", cell).groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / GROUP).cast("long")
    return anchors.withColumn("cell", cell).join(sizes, keys).withColumn(
        "grp", F.concat_ws("/", F.col("cell").cast("string"), F.pmod(F.xxhash64("aid"), parts).cast("string"))).drop("cell", "size")


_FOUND = "aid long, rank int, score long, id long"


def _search(anchors: DataFrame, rows: DataFrame, keys: list[str], wanted: int, same_label: bool) -> DataFrame:
    """One search over the grid.  ``anchors``: ``aid, vec_id, label, vector,
    windows`` (pairs of longs, null for a row's whole list); ``rows``: ``vec_id,
    label, vector``; both with ``keys``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, vectors = left.to_pydict(), right.column("vector").to_pylist()
        r_ids, r_labels = (right.column(c).to_numpy() for c in ("vec_id", "label"))
        windows = [[(-_LONG - 1, _LONG)] if w is None else [(p["low"], p["high"]) for p in w] for w in q["windows"]]
        own = {}
        if same_label:      # one row of the anchor's id, label and vector is the anchor itself
            at = {}
            for j, key in enumerate(zip(r_ids.tolist(), r_labels.tolist(), vectors)):
                at.setdefault(key, j)
            own = {i: at.get(key) for i, key in enumerate(zip(q["vec_id"], q["label"], q["vector"]))}

        def allowed(i: int, js: np.ndarray) -> np.ndarray:
            if not same_label:
                return r_labels[js] != q["label"][i]
            return (r_labels[js] == q["label"][i]) & (js != (-1 if own[i] is None else own[i]))

        found = walk(_matrix(q["vector"]), _matrix(vectors), r_ids, wanted, windows, allowed)
        out = [(q["aid"][i], k, max(-_LONG - 1, min(_LONG, -s)), d)
               for i, lists in enumerate(found) for k, held in enumerate(lists) for s, d in held]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                        names=["aid", "rank", "score", "id"])

    rows = rows.toDF(*rows.columns)     # names of its own: both sides come from the anchors
    best = anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, _FOUND)
    order = Window.partitionBy("aid", "rank").orderBy(F.desc("score"), "id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= wanted)


def mine(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH) -> DataFrame:
    """``vectors``: a frame of :func:`quantised`; ``is_anchor``: a column over it.
    Returns ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each anchor and each of its first ``positives`` rows of
    its label the first ``negatives`` rows of other labels whose scores lie between
    ``low`` and ``high`` hundredths of the positive's."""
    spark = vectors.sparkSession
    vectors = saved(vectors, "vectors")
    first = Window.partitionBy("label", "vector").orderBy("vec_id")
    rows = saved(vectors.withColumn("copy", F.row_number().over(first))
                 .filter(F.col("copy") <= max(positives + 1, negatives)).drop("copy", "signs"), "rows")
    anchors = saved(vectors.filter(is_anchor & (F.col("vec_id") != NULL_ID)).groupBy("vec_id", "label", "vector", "signs")
                    .agg(F.count(F.lit(1)).alias("copies")).withColumn("aid", F.monotonically_increasing_id()), "anchors")
    n, n_anchors = rows.count(), anchors.count()

    # positives: every label has blocks of its own
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("label", F.greatest(F.ceil(F.col("size") / BLOCK), F.least(
        F.ceil(F.col("size") * _blocks(spark, n) / max(1, n)), F.ceil(F.col("size") / LEAST_BLOCK))).cast("int").alias("blocks"))
    all_of = "array<struct<low:long,high:long>>"
    wide = (_grouped(anchors, True, n_anchors).join(sizes, "label")
            .withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "windows": F.lit(None).cast(all_of)}))
    groups = wide.select("label", "grp", "block").distinct()
    dealt = (rows.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int"))
             .join(groups, ["label", "block"]))
    pos = _search(wide.withColumn("lab", F.col("label")), dealt.withColumn("lab", F.col("label")), ["lab", "grp", "block"], positives, True)
    pos = saved(pos.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("place") - 1).alias("k"), "id", "score"))).alias("positives")), "positives")

    # negatives: one window of scores for every positive; a score below 0 has an empty one
    known = saved(anchors.join(pos, "aid").withColumn("windows", F.transform("positives", lambda p: F.struct(
        (-F.floor(-p["score"].cast("decimal(38,0)") * low / 100)).cast("long").alias("low"),
        F.floor(p["score"].cast("decimal(38,0)") * high / 100).cast("long").alias("high")))), "windows")
    blocks = _blocks(spark, n)
    wide = _grouped(known, False, n_anchors).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    groups = wide.select("grp", "block").distinct()
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int")).join(groups, "block")
    neg = _search(wide, dealt, ["grp", "block"], negatives, False)
    real = lambda c: F.when(c != NULL_ID, c)
    p = F.col("positives")[F.col("rank")]
    return (neg.withColumnRenamed("id", "negative").join(known.select("aid", "vec_id", "copies", "positives"), "aid")
            .withColumn("each", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(F.col("vec_id").alias("anchor_id"), real(p["id"]).alias("positive_id"), F.col("place").cast("int").alias("rank"),
                    real(F.col("negative")).alias("negative_id"), p["score"].alias("positive_score"),
                    F.col("score").alias("negative_score")))
