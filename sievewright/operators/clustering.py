"""Identities from embeddings: exact complete linkage, centroid merging, numbering and the choice of a target.

A complete-linkage cluster needs every pair under the threshold, so no cluster crosses a component of the threshold graph.
Its links come from blocked matrix products, block against block, its components from rounds of joins. Small
components are agglomerated in a task each. Larger ones go up by levels: a pass of blocked products over all pairs lists the
cluster pairs up to a distance that gives a cluster a few dozen of them, and these are merged without vectors, as a merged
cluster's distance is the larger of its parts'. No task holds more than two blocks, and no component is refused.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..errors import ComponentTooLarge, NoTarget
from ..functions.vectors import cosine
from ..params import Clustering
from ..shipping import ship


def unit_rows(a: np.ndarray, epsilon: float = 1e-8) -> np.ndarray:
    return a / (np.sqrt((a * a).sum(axis=1, keepdims=True)) + epsilon)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, to twelve places, so that a pair's doesn't depend on the block it is computed in."""
    return np.round(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0), 12)


#: A member of each cluster at a time is compared, as long as so many clusters have that many; then the rest of a cluster.
LAYER_CLUSTERS = 64


def _pieces(rows: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """rows of clusters of these sizes, the largest first, as (from cluster, to cluster, rows): one row of each of them, or rows of one."""
    starts, out, k = np.cumsum(sizes) - sizes, [], 0
    while (n := int(np.count_nonzero(sizes > k))) and (not k or n >= LAYER_CLUSTERS):
        out.append((0, n, rows[starts[:n] + k]))
        k += 1
    for c in range(n):
        rest = rows[starts[c] + k : starts[c] + sizes[c]]
        out += [(c, c + 1, rest[lo : lo + 1024]) for lo in range(0, len(rest), 1024)]
    return out


def _sides(x: np.ndarray, of_x: np.ndarray, y: np.ndarray, of_y: np.ndarray) -> tuple[list, list]:
    """The pieces of rows x and y of clusters of sizes of_x and of_y, so that one product gives |a|^2 + |b|^2 - 2ab."""
    return _pieces(np.c_[-2 * x, (x * x).sum(1), np.ones(len(x))], of_x), _pieces(np.c_[y, np.ones(len(y)), (y * y).sum(1)], of_y)


def _farthest(xs: list, ys: list, lo: int, hi: int, many: int) -> np.ndarray:
    """The largest squared distance between the members of each of the clusters lo to hi of one side's pieces and each of the many
    of the other's, before it is brought to twelve places."""
    out = np.full((hi - lo, many), -np.inf)
    for a, b, u in xs:
        p, q = max(a, lo), min(b, hi)
        if p >= q:
            continue
        u = u[p - a : q - a] if len(u) == b - a else u
        for c, d, v in ys:
            far = u @ v.T
            far = far.max(axis=0, keepdims=True) if len(u) > q - p else far
            far = far.max(axis=1, keepdims=True) if len(v) > d - c else far
            part = out[p - lo : q - lo, c:d]
            np.maximum(part, far, out=part)
    return out


def _largest_first(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by the number of their cluster, from 0: their order with the largest clusters first, and those clusters and sizes."""
    sizes = np.bincount(number)
    order = np.argsort(-sizes, kind="stable")
    return np.argsort(-sizes[number], kind="stable"), order, sizes[order]


def farthest(x: np.ndarray, number: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """The largest squared distance between the members of each two clusters of x. number: the rows' sorted clusters, from 0.
    Worked on in strips of clusters, so that no matrix of all rows is made."""
    rows, order, sizes = _largest_first(number)
    sides, n = _sides(x[rows], sizes, x[rows], sizes), len(sizes)
    out, step = np.empty((n, n)), max(1, cells // n)
    for lo in range(0, n, step):
        far = _farthest(*sides, lo, min(n, lo + step), n)
        out[np.ix_(order[lo : lo + step], order)] = np.round(np.maximum(far, 0), 12)
    return out


def agglomerate(d: np.ndarray, limit: float) -> np.ndarray:
    """Labels of the agglomeration that merges the nearest two clusters while they are nearer than limit, d[i, j] being the largest
    distance between members of i and j; d is used up. Ties go to the lowest numbers.

    Each cluster knows its nearest one; a merge costs a row.
    """
    n = len(d)
    label = np.arange(n)
    if n < 2:
        return label
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    near = d.argmin(1)
    dist = d[np.arange(n), near]
    while True:
        i = int(dist.argmin())
        if not dist[i] < limit:
            return label
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        label[label == j] = i
        far = np.maximum(d[i], d[j])
        d[i], d[:, i], d[j], d[:, j] = far, far, np.inf, np.inf
        d[i, i] = np.inf
        alive[j], dist[j] = False, np.inf
        again = np.flatnonzero(alive & ((near == i) | (near == j)))
        for k in {*again.tolist(), i}:
            near[k] = d[k].argmin()
            dist[k] = d[k, near[k]]


def complete_linkage(vectors: np.ndarray, limit: float) -> np.ndarray:
    """Labels of the complete-linkage clusters of vectors whose farthest members are nearer than limit."""
    return agglomerate(squares(vectors, vectors), limit * limit) if len(vectors) else np.arange(0)


#: Rows of a block in pairwise products, which are made in strips of 8 or 32 MB.
BLOCK_ROWS = 4096
#: Clusters, and rows in them, of a component that one task agglomerates.
TASK_CLUSTERS, TASK_ROWS = 2048, 16384
#: Links of a cluster that a level lists at least, and links of a component that one task merges; more are merged by joins first.
LEVEL_LINKS, TASK_LINKS = 48, 3_000_000


def _plain(values) -> pd.Series:
    """Ids of any type as they are, where pandas would pack strings into chunks."""
    return pd.Series(list(values), dtype=object)


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return unit_rows(np.stack([np.asarray(v, np.float64) for v in pdf["embedding"]])) if len(pdf) else np.zeros((0, 1))


def _dealt(rows: DataFrame, by: str, keys: list[str], blocks: DataFrame | int) -> DataFrame:
    """rows with _b, their block by a hash of column `by`, and _n, how many blocks their key has."""
    rows = rows.withColumn("_n", F.lit(blocks)) if isinstance(blocks, int) else rows.join(blocks.withColumnRenamed("blocks", "_n"), keys)
    return rows.withColumn("_b", F.pmod(F.xxhash64(by), F.col("_n")).cast("int"))


def _block_pairs(dealt: DataFrame, own: bool = True) -> DataFrame:
    """dealt rows once for each pair of blocks that their own block is in, _p; own: its pair with itself too."""
    others = F.sequence(F.lit(0), F.col("_n").cast("int") - 1)
    others = others if own else F.array_remove(others, F.col("_b"))
    pairs = F.transform(others, lambda k: F.struct(F.least(F.col("_b"), k).alias("i"), F.greatest(F.col("_b"), k).alias("j")))
    return dealt.withColumn("_p", F.explode(pairs)).drop("_n")


def _apart(sent: DataFrame, by: list[str], groups: int) -> DataFrame:
    """sent dealt out by columns into a number of tasks that Spark won't put together for their few bytes: a group's work is in its products."""
    spark = sent.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    return sent.repartition(max(1, min(2 * groups, most)), *by)


def _blocks(rows: DataFrame, keys: tuple[str, ...]) -> tuple[int, int]:
    """How many blocks keep the largest key's near BLOCK_ROWS rows, and how many keys there are."""
    largest, many = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    return max(1, -(-(largest or 0) // BLOCK_ROWS)), many


def _near(x: np.ndarray, y: np.ndarray, limit: float) -> np.ndarray:
    """Which rows of x and y are nearer than limit, made in strips."""
    strip = max(1, (1 << 22) // len(y))
    return np.concatenate([squares(x[k : k + strip], y) < limit * limit for k in range(0, len(x), strip)])


def similar_pairs(rows: DataFrame, cosine_above: float, blocks: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, keys) of `id` pairs of one key whose embeddings are nearer than the threshold's distance, by blocked matrix products.

    Rows are dealt into blocks by a hash, as many as keep the largest key's blocks near BLOCK_ROWS; each block pair is one
    group that two blocks go to, so a row is sent as often as there are blocks and no task holds more than two of them.
    """
    ship(rows.sparkSession)
    limit = math.sqrt(max(0.0, 2 - 2 * cosine_above))
    usable = rows.where("embedding is not null").select("id", "embedding", *keys)
    most, many = _blocks(usable, keys)
    blocks = blocks or most
    sent = _apart(_block_pairs(_dealt(usable, "id", list(keys), blocks)), [*keys, "_p"], many * (blocks * (blocks + 1) // 2))
    kinds = {f.name: f.dataType.simpleString() for f in usable.schema.fields}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["_p"].iloc[0]["i"], pdf["_p"].iloc[0]["j"]
        pdf = pdf.sort_values("id")
        left, right = pdf[pdf["_b"] == i], pdf[pdf["_b"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("a", "b", *keys)})
        near = _near(_vectors(left), _vectors(right), limit)
        p, q = np.nonzero(np.triu(near, 1) if i == j else near)
        a, b = left["id"].to_numpy()[p], right["id"].to_numpy()[q]
        return pd.DataFrame({"a": _plain(np.minimum(a, b)), "b": _plain(np.maximum(a, b)), **{k: _plain([pdf[k].iloc[0]] * len(a)) for k in keys}})

    return sent.groupBy(*keys, "_p").applyInPandas(work, ", ".join([f"a {kinds['id']}", f"b {kinds['id']}", *(f"{k} {kinds[k]}" for k in keys)]))


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join the rows and columns of a matrix as all its pairs do, fewer than it has rows and columns."""
    rows, columns = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool)
    p, q = [], []
    for start in range(near.shape[0]):
        if not rows[start]:
            continue
        rows[start], todo = False, [start]
        while todo:
            r = todo.pop()
            met = np.flatnonzero(near[r] & columns)
            columns[met] = False
            p += [r] * len(met)
            q += met.tolist()
            for c in met.tolist():
                on = np.flatnonzero(near[:, c] & rows)
                rows[on] = False
                p += on.tolist()
                q += [c] * len(on)
                todo += on.tolist()
    return np.array(p, int), np.array(q, int)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id) with `component`, the least id reachable: labels spread over edges and are shortened until none changes."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = cut(both)
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        spread = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        new = labels.join(spread, labels["id"] == spread["a"], "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"), F.col("component").alias("old"))
        jump = new.select(F.col("id").alias("_root"), F.col("component").alias("_next"))
        short = cut(new.join(jump, new["component"] == jump["_root"], "left").select("id", F.least("component", F.coalesce("_next", "component")).alias("component"), "old"))
        labels = short.drop("old")
        if short.where("component <> old").isEmpty():
            return labels


def _by_cluster(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, numbers of their clusters, clusters in order) of rows sorted by cluster."""
    pdf = pdf.sort_values(["cluster", "id"])
    names, number = np.unique(pdf["cluster"].to_numpy(), return_inverse=True)
    return _vectors(pdf), number, names


def _packed(dealt: DataFrame, keys: list[str], groups: int, kind: str) -> DataFrame:
    """A row for each block of dealt rows (id, embedding, cluster and others), so that blocks are sent as few large values: their
    clusters, the largest first, with their sizes and the unit vectors of their rows as bytes."""
    of = [*keys, "_b", *(c for c in dealt.columns if c not in ("id", "embedding", "cluster", "_b", *keys))]
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x, number, names = _by_cluster(pdf)
        rows, order, sizes = _largest_first(number)
        bytes_ = {"sizes": [sizes.astype(np.int64).tobytes()], "vectors": [x[rows].tobytes()]}
        return pd.DataFrame({**{c: _plain(pdf[c].iloc[:1]) for c in of}, "names": _plain([names[order]]), **bytes_})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in of), f"names array<{kind}>", "sizes binary", "vectors binary"])
    return _apart(dealt, [*keys, "_b"], groups).groupBy(*of).applyInPandas(work, schema)


def _unpacked(pair: pd.DataFrame, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(vectors, sizes of clusters, clusters) of one of a pair's packed blocks; none if no row is in it."""
    for k in np.flatnonzero(pair["_b"] == block):
        sizes = np.frombuffer(pair["sizes"].iloc[k], np.int64)
        return np.frombuffer(pair["vectors"].iloc[k]).reshape(sizes.sum(), -1), sizes, np.asarray(pair["names"].iloc[k])


def _links_across(rows: DataFrame, limit: float, keys: tuple[str, ...], blocks: int, many: int, kind: str) -> DataFrame:
    """(a, b): pairs of clusters of rows (id, embedding, cluster, keys) in different blocks that have members nearer than limit, as many
    as join them as all such pairs do. Clusters that are known to be linked aren't compared again."""
    packed = _packed(_dealt(rows, "id", list(keys), blocks), list(keys), many * blocks, kind)
    sent = _apart(_block_pairs(packed, False), [*keys, "_p"], many * blocks * (blocks - 1) // 2)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _unpacked(pdf, pdf["_p"].iloc[0]["i"]), _unpacked(pdf, pdf["_p"].iloc[0]["j"])
        if left is None or right is None:
            return pd.DataFrame({"a": [], "b": []})
        (x, of_x, a), (y, of_y, b) = left, right
        of_x, of_y = np.repeat(np.arange(len(a)), of_x), np.repeat(np.arange(len(b)), of_y)
        linked, lo, strip = np.zeros((len(a), len(b)), bool), 0, 64
        while lo < len(x):
            own = of_x[lo : lo + strip]
            open_ = np.flatnonzero(~linked[np.unique(own)].all(axis=0)[of_y])
            if len(open_):
                r, c = np.nonzero(squares(x[lo : lo + strip], y[open_]) < limit * limit)
                linked[own[r], of_y[open_[c]]] = True
            lo, strip = lo + strip, max(1, (1 << 22) // len(y))
        p, q = _forest(linked)
        return pd.DataFrame({"a": pd.Series(a[p], dtype=a.dtype), "b": pd.Series(b[q], dtype=b.dtype)})

    return sent.groupBy(*keys, "_p").applyInPandas(work, f"a {kind}, b {kind}")


def reached(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that its links reach."""
    label, open_ = np.arange(len(near)), np.ones(len(near), bool)
    for start in range(len(near)):
        todo = [start] if open_[start] else []
        open_[start] = False
        while todo:
            met = np.flatnonzero(near[todo.pop()] & open_)
            open_[met], label[met] = False, start
            todo += met.tolist()
    return label


def _block_components(rows: DataFrame, limit: float, keys: tuple[str, ...], blocks: int, many: int, kind: str) -> DataFrame:
    """(id, component) over the links inside each block of rows (id, embedding, keys)."""
    sent = _apart(_dealt(rows, "id", list(keys), blocks), [*keys, "_b"], many * blocks)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, names = _vectors(pdf), pdf["id"].to_numpy()
        return pd.DataFrame({"id": pd.Series(names, dtype=names.dtype), "component": pd.Series(names[reached(_near(x, x, limit))], dtype=names.dtype)})

    return sent.groupBy(*keys, "_b").applyInPandas(work, f"id {kind}, component {kind}")


def near_components(rows: DataFrame, cosine_above: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows (id, embedding, keys; no null embedding) as (id, component): the least id that links of similar_pairs reach.

    First each block by itself, then the blocks' components over pairs of blocks, at most two blocks' rows in a task.
    """
    limit, kind = math.sqrt(max(0.0, 2 - 2 * cosine_above)), rows.schema["id"].dataType.simpleString()
    blocks, many = _blocks(rows, keys)
    own = cut(_block_components(rows, limit, keys, blocks, many, kind))
    if blocks == 1:
        return own
    found = rows.join(own, "id").withColumnRenamed("component", "cluster")
    across = cut(_links_across(found, limit, keys, blocks, many, kind))
    whole = components(own.select(F.col("component").alias("id")).distinct(), across)
    return own.withColumnRenamed("component", "_own").join(whole.select(F.col("id").alias("_own"), "component"), "_own").select("id", "component")


def _finished(rows: DataFrame, limit: float, kind: str) -> DataFrame:
    """(id, cluster) of rows (id, cluster, embedding, component): clusters merged until none can be, each component in a task."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x, number, names = _by_cluster(pdf)
        label = agglomerate(farthest(x, number), limit * limit)
        return pd.DataFrame({"id": _plain(pdf.sort_values(["cluster", "id"])["id"]), "cluster": _plain(names[label[number]])})

    return rows.groupBy("component").applyInPandas(work, f"id {kind}, cluster {kind}")


def _lowest(d: np.ndarray, most: int) -> float:
    """A bound that about that many of the distances don't exceed; infinite if there are no more."""
    return float(np.partition(d, most)[most]) if len(d) > most else math.inf


def _links(rows: DataFrame, sizes: DataFrame, limit: float, kind: str) -> DataFrame:
    """(component, a, b, d): pairs of clusters of rows (id, cluster, embedding, component) whose farthest members are nearer than limit,
    a < b. sizes: the components' _rows and _clusters. Of many, a block pair lists those up to a bound, so that a component has not many more than a task merges, or a cluster
    LEVEL_LINKS; it also gives its bound, in a row with a = b, infinite if it lists all. Whole clusters are dealt into blocks."""
    sizes = sizes.select("component", F.ceil(F.col("_rows") / BLOCK_ROWS).alias("blocks"), "_clusters")
    blocks, pairs = sizes.agg(F.sum("blocks"), F.sum(F.expr("blocks * (blocks + 1) div 2"))).first()
    packed = _packed(_dealt(rows, "cluster", ["component"], sizes), ["component"], blocks, kind)
    sent = _apart(_block_pairs(packed), ["component", "_p"], pairs)
    per, ties, cells = LEVEL_LINKS, TASK_LINKS, 1 << 20

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["_p"].iloc[0]["i"], pdf["_p"].iloc[0]["j"]
        component, clusters = pdf["component"].iloc[0], int(pdf["_clusters"].iloc[0])
        left, right = _unpacked(pdf, i), _unpacked(pdf, j)
        if left is None or right is None:
            return pd.DataFrame({"component": [], "a": [], "b": [], "d": []})
        (x, of_x, a), (y, of_y, b) = left, right
        aim = max(per, 1.6 * ties / clusters)
        most = math.ceil(aim * len(a) * len(b) / (clusters if i < j else 2 * clusters))
        p, q, d, bound = np.zeros(0, int), np.zeros(0, int), np.zeros(0), math.inf
        sides, step = _sides(x, of_x, y, of_y), max(1, cells // len(b))
        for lo in range(0, len(a), step):
            far = _farthest(*sides, lo, min(len(a), lo + step), len(b))
            r, c = np.divmod(np.flatnonzero(far < min(bound, limit * limit) + 1e-11), len(b))
            far = np.round(np.maximum(far[r, c], 0), 12)
            near = (far < limit * limit) & (far <= bound) & ((i < j) | (c > r + lo))
            p, q, d = np.r_[p, r[near] + lo], np.r_[q, c[near]], np.r_[d, far[near]]
            bound = min(bound, _lowest(d, most))
            keep = np.flatnonzero(d <= bound)
            if len(keep) > most + ties:  # of very many equal distances any may wait for the next level
                keep = keep[np.argsort(d[keep], kind="stable")[: most + ties]]
            p, q, d = p[keep], q[keep], d[keep]
        u, v = np.minimum(a[p], b[q]), np.maximum(a[p], b[q])
        end = a[:1]
        return pd.DataFrame({"component": _plain([component] * (len(d) + 1)), "a": pd.Series(np.r_[u, end], dtype=a.dtype), "b": pd.Series(np.r_[v, end], dtype=a.dtype), "d": np.r_[d, bound]})

    return sent.groupBy("component", "_p").applyInPandas(work, f"component {kind}, a {kind}, b {kind}, d double")


def merge_links(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Labels of n clusters after all merges over links (a < b at distance d), each pair of clusters once: clusters without a link
    are too far from each other, as are merged ones if any of their parts are.

    All pairs of clusters that are each other's nearest merge at once, round by round; ties go to the lowest numbers.
    """
    label = np.arange(n)
    while len(d):
        least = np.full(n, np.inf)
        np.minimum.at(least, a, d)
        np.minimum.at(least, b, d)
        near = np.flatnonzero((d == least[a]) | (d == least[b]))
        near = near[np.lexsort((b[near], a[near], d[near]))]
        u, v, place = a[near], b[near], np.arange(len(near))
        first = np.full(n, len(near))
        for end in (u, v):
            np.minimum.at(first, end, place)
        mutual = (first[u] == place) & (first[v] == place)
        into, parts = np.arange(n), np.ones(n, int)
        into[v[mutual]], parts[u[mutual]] = u[mutual], 2
        label = into[label]
        p, q = into[a], into[b]
        p, q = np.minimum(p, q), np.maximum(p, q)
        same, moved = p == q, (parts[p] > 1) | (parts[q] > 1)
        stay, moved = ~moved, np.flatnonzero(moved & ~same)
        moved = moved[np.argsort(p[moved] * n + q[moved], kind="stable")]
        starts = np.flatnonzero(np.r_[True, (np.diff(p[moved]) != 0) | (np.diff(q[moved]) != 0)]) if len(moved) else moved
        far = np.maximum.reduceat(d[moved], starts) if len(moved) else d[moved]
        head = moved[starts] if len(moved) else moved
        whole = np.diff(np.r_[starts, len(moved)]) == parts[p[head]] * parts[q[head]]
        a, b, d = np.r_[a[stay], p[head][whole]], np.r_[b[stay], q[head][whole]], np.r_[d[stay], far[whole]]
    return label


def _merged_in_task(links: DataFrame, kind: str) -> DataFrame:
    """(cluster, into) of the clusters that are merged into another one over links (component, a, b, d), each component in a task."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        names, number = np.unique(np.r_[pdf["a"].to_numpy(), pdf["b"].to_numpy()], return_inverse=True)
        label = merge_links(number[: len(pdf)], number[len(pdf) :], pdf["d"].to_numpy(), len(names))
        gone = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"cluster": _plain(names[gone].tolist()), "into": _plain(names[label[gone]].tolist())})

    return links.groupBy("component").applyInPandas(work, f"cluster {kind}, into {kind}")


def _round(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A round of merge_links by joins: (cluster, into) of the merged clusters, and the links that are left."""
    least = F.min(F.struct("d", "a", "b")).alias("m")
    ends = links.select(F.col("a").alias("c"), "d", "a", "b").union(links.select(F.col("b").alias("c"), "d", "a", "b"))
    mutual = cut(ends.groupBy("c").agg(least).groupBy("m.a", "m.b").agg(F.count("*").alias("n")).where("n = 2").select(F.col("b").alias("cluster"), F.col("a").alias("into")))
    part = mutual.select("cluster", "into").union(mutual.select(F.col("into").alias("cluster"), "into"))
    left, right = (part.select(F.col("cluster").alias(c), F.col("into").alias(f"_{c}")) for c in ("a", "b"))
    both = links.join(left, "a", "left").join(right, "b", "left")
    two = lambda c: F.when(F.col(f"_{c}").isNull(), 1).otherwise(2)
    moved = both.select("component", F.coalesce("_a", "a").alias("p"), F.coalesce("_b", "b").alias("q"), "d", (two("a") * two("b")).alias("parts")).where("p <> q")
    left = moved.groupBy("component", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("parts").alias("parts"))
    return mutual, cut(left.where("n = parts").select("component", "a", "b", "d"))


def _renamed(rows: DataFrame, into: DataFrame) -> DataFrame:
    return rows.join(into, "cluster", "left").withColumn("cluster", F.coalesce("into", "cluster")).drop("into")


def _level(rows: DataFrame, sizes: DataFrame, limit: float, kind: str) -> tuple[DataFrame, DataFrame]:
    """rows (id, cluster, embedding, component) after all merges up to each component's level, and the components whose level is limit."""
    found = cut(_links(rows, sizes, limit, kind))
    level = cut(found.where("a = b").groupBy("component").agg(F.min("d").alias("level")))
    links = found.where("a < b").join(level, "component").where("d <= level").drop("level")
    while True:
        held = cut(links.groupBy("component").agg(F.count("*").alias("_links")))
        many = held.where(f"_links > {TASK_LINKS}").select("component")
        rows = cut(_renamed(rows, _merged_in_task(links.join(many, "component", "left_anti"), kind)))
        if many.isEmpty():
            return rows, level.where("level = double('infinity')").select("component")
        into, links = _round(links.join(many, "component"))
        rows = _renamed(rows, into)


def linkage_clusters(rows: DataFrame, p: Clustering = Clustering(), keys: tuple[str, ...] = ()) -> DataFrame:
    """(id, cluster): the least id of each complete-linkage cluster. Rows without an embedding are left out.

    Rows of equal embeddings are one from the start, however many. Components of up to TASK_CLUSTERS rows end in a task;
    larger ones go up by levels until as few clusters are left, or nothing can merge. Only if
    max_component is set, a component of more distinct rows raises ComponentTooLarge.
    """
    ship(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    limit = math.sqrt(max(0.0, 2 - 2 * p.cosine))
    usable = rows.where("embedding is not null").select("id", "embedding", *keys)
    alike = cut(usable.groupBy(*keys, "embedding").agg(F.min("id").alias("_first"), F.count("*").alias("_n")))
    distinct = alike.select(F.col("_first").alias("id"), "embedding", *keys)
    comp = near_components(distinct, p.cosine, keys)
    if p.max_component is not None:
        largest = comp.groupBy("component").count().agg(F.max("count")).first()[0] or 0
        if largest > p.max_component:
            raise ComponentTooLarge(f"a component of the threshold graph has {largest} rows, more than {p.max_component}")
    active = cut(distinct.select("id", "embedding").join(comp, "id").withColumn("cluster", F.col("id")))
    done = []
    while True:
        size = cut(active.groupBy("component").agg(F.count("*").alias("_rows"), F.count_distinct("cluster").alias("_clusters")))
        small = f"_clusters <= {TASK_CLUSTERS} and _rows <= {TASK_ROWS}"
        ends, goes = (r or 0 for r in size.agg(F.count_if(F.expr(small)), F.count_if(F.expr(f"not ({small})"))).first())
        if ends:
            done.append(cut(_finished(active.join(size.where(small).select("component"), "component"), limit, kind)))
        if not goes:
            break
        size = size.where(f"not ({small})")
        active = cut(active.join(size.select("component"), "component")) if ends else active
        merged, over = _level(active, size, limit, kind)
        done.append(merged.join(over, "component").select("id", "cluster"))
        active = merged.join(over, "component", "left_anti")
    found = done[0] if done else active.select("id", "cluster")
    for part in done[1:]:
        found = found.unionByName(part)
    if alike.where("_n > 1").isEmpty():
        return found
    same = [usable[k].eqNullSafe(alike[k]) for k in keys]
    named = usable.join(alike, [*same, usable["embedding"] == alike["embedding"]]).select(usable["id"], F.col("_first"))
    return named.join(found.withColumnRenamed("id", "_first"), "_first").select("id", "cluster")


def centroids(rows: DataFrame, cluster: str = "cluster", embedding: str = "embedding", normalise: bool = True) -> DataFrame:
    """(cluster, centroid): the mean of raw vectors, then brought to unit length. Sums are by place, so partial aggregates are small."""
    parts = rows.where(F.col(embedding).isNotNull()).select(cluster, F.posexplode(embedding).alias("pos", "v"))
    means = parts.groupBy(cluster, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    packed = means.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s")).select(cluster, F.transform("s", lambda x: x["m"]).alias("centroid"))
    if not normalise:
        return packed
    length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)) + 1e-8
    return packed.withColumn("_n", length).select(cluster, F.transform(F.arrays_zip("centroid", F.array_repeat("_n", F.size("centroid")).alias("n")), lambda z: z["centroid"] / z["n"]).alias("centroid"))


def centroid_pairs(cents: DataFrame, least: float, cluster: str = "cluster", keys: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, similarity) of clusters of one key whose centroids' product reaches `least`; blocked as other vectors are."""
    rows = cents.select(F.col(cluster).alias("id"), F.col("centroid").alias("embedding"), *keys)
    near = similar_pairs(rows, max(-1.0, least - 1e-3), keys=keys).select("a", "b")
    left, right = rows.select(F.col("id").alias("a"), F.col("embedding").alias("ea")), rows.select(F.col("id").alias("b"), F.col("embedding").alias("eb"))
    product = F.aggregate(F.zip_with("ea", "eb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return near.join(left, "a").join(right, "b").select("a", "b", product.alias("similarity")).where(F.col("similarity") >= least)


def merge_clusters(labels: DataFrame, rows: DataFrame, least: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """labels (id, cluster) with clusters of one key joined whose centroids are alike, over chains too; centroids aren't computed again."""
    members = labels.join(rows.select("id", "embedding", *keys), "id")
    cents = centroids(members, "cluster")
    if keys:
        cents = cents.join(members.groupBy("cluster").agg(*(F.first(k).alias(k) for k in keys)), "cluster")
    cents = cut(cents)
    comp = components(cents.select(F.col("cluster").alias("id")), centroid_pairs(cents, least, keys=keys)).select(F.col("id").alias("cluster"), "component")
    return labels.join(comp, "cluster").select("id", F.col("component").alias("cluster"))


def number_clusters(labels: DataFrame, min_size: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """(id, identity_cluster): within each key 0 for the largest cluster, then by size, ties by the least id; null in clusters under min_size.

    A key (a video) is numbered by one task; without keys the table is one video, with a row for each of its clusters.
    """
    sizes = labels.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= min_size)
    numbered = sizes.withColumn("identity_cluster", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first")) - 1).cast("int"))
    return labels.join(numbered.select("cluster", "identity_cluster"), "cluster", "left").select("id", "identity_cluster")


def cluster_identities(rows: DataFrame, p: Clustering = Clustering(), keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with identity_cluster; with keys (a video id), clusters never reach over a key and are numbered within it. Ids are unique over all keys."""
    labels = merge_clusters(cut(linkage_clusters(rows, p, keys)), rows, p.merge_cosine, keys)
    if keys:
        labels = labels.join(rows.select("id", *keys), "id")
    return rows.join(number_clusters(labels, p.min_size, keys), "id", "left")


def summarize(rows: DataFrame) -> DataFrame:
    """(identity_cluster, n, representative): the frame of the detection with the most confidence, the first in ties; largest first."""
    best = F.min_by("frame_path", F.struct(-F.coalesce("detection_confidence", F.lit(float("-inf"))), F.col("ord")))
    return rows.where("identity_cluster is not null").groupBy("identity_cluster").agg(F.count("*").alias("n"), best.alias("representative")).orderBy(F.desc("n"), "identity_cluster")


def nearest_centroid(cents: DataFrame, reference: list[float], cluster: str = "identity_cluster") -> DataFrame:
    """One row (cluster, similarity) of the centroid most like the reference, the lowest number in ties. The reference is a literal."""
    ref = F.array(*(F.lit(float(x)) for x in reference))
    return cents.withColumn("similarity", cosine(F.col("centroid"), ref)).orderBy(F.desc("similarity"), cluster).limit(1).select(cluster, "similarity")


def choose_target(summary: DataFrame, rows: DataFrame | None = None, person: int | None = None, reference: list[float] | None = None, ask: Callable[[list], int] | None = None, p: Clustering = Clustering()) -> tuple[int, str]:
    """(cluster, why): by number, by likeness to a reference, by dominance, by asking, or simply the largest.

    The summary has a row for each identity of one video; it is small by nature.
    """
    infos = summary.orderBy(F.desc("n"), "identity_cluster").collect()
    if not infos:
        raise NoTarget("no cluster was found")
    if person is not None:
        if not 1 <= person <= len(infos):
            raise NoTarget(f"person {person} is out of range: {len(infos)} were found")
        return infos[person - 1]["identity_cluster"], "number"
    if reference is not None:
        got = nearest_centroid(centroids(rows.where("identity_cluster is not null"), "identity_cluster"), reference).first()
        if got is None:
            raise NoTarget("the reference matches no cluster")
        return got["identity_cluster"], "reference" if got["similarity"] >= p.cosine else "weak reference"
    total = sum(r["n"] for r in infos)
    if infos[0]["n"] / total >= p.dominance:
        return infos[0]["identity_cluster"], "dominant"
    if ask is not None:
        return ask(infos), "asked"
    return infos[0]["identity_cluster"], "largest"
