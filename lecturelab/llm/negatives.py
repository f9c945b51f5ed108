"""Hard negatives from a multiway hyperplane tree (GNAT) with exact leaves.

A node of the tree has a few split points; a vector goes to the nearest. For every split point i and every sibling
subtree j the node stores the least and greatest distance from point i to the vectors of subtree j, taken over all
vectors, not a sample. A search asks for vectors whose score lies in a window. A vector x is given one more component,
sqrt(R - |x|^2) with R the largest squared norm of all, and an anchor a zero; then |a - x|^2 = |a|^2 + R - 2 a.x, so a
window of scores is a ring (annulus) around the anchor and the triangle inequality holds. Subtree j is passed over if, for
some point i, the distances from the anchor that the stored range allows miss the ring. What is left is
compared leaf by leaf, each leaf cut in blocks of about `block` rows, with whole-number scores; nothing is estimated.

Where the rows go: split points come from a sample of `sample` rows (by a hash of the row's number); the tree, its ranges
and the sample are of that size whatever the table's. The sample also gives each search a first bound, since its best
rows are real rows. Every row is in a leaf. Leaves are as many blocks as their rows ask for, dealt by a hash of the row's
number, so equal vectors, hot labels and repeated rows are spread; anchors come in chunks of about `chunk` and meet
blocks one pair at a time.

Edge cases: rows with a null label, a null vector or any null or non-finite component take no part; an empty vector has
score 0 with all; shorter vectors are filled up with zeros; a null id names no anchor and comes last among equal scores;
rows that repeat an id are rows of their own, as anchors, positives and negatives, and a row is only never its own
positive; ties go to the smaller id; an empty table, no anchors, no positives or nothing in a window give no rows.
The largest squared norm, in whole numbers, must be below 2^53, else it is an error: scores would not be exact.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lecturelab.llm.common import materialise

SCALE = 256
ANCHORS = 100
POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80
HIGH_PERCENT = 100
_EXACT = 1 << 53


@dataclass(frozen=True)
class TreeParams:
    """`ways` split points a node; nodes with fewer than `leaf` rows of the sample are leaves."""

    ways: int = 8
    depth: int = 6
    sample: int = 4096
    leaf: int = 64
    block: int = 2048
    chunk: int = 512
    seed: int = 11


@dataclass
class Node:
    """Split points with their last component, what each leads to (a node, or the complement of a leaf), and the ranges."""

    points: np.ndarray
    lifted: np.ndarray
    to: list[int]
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int
    dims: int
    reach: float  # the largest squared norm
    rows: pd.DataFrame  # the sample: no, label
    vectors: np.ndarray  # and its vectors
    blocks: np.ndarray  # how many blocks each leaf has

    @property
    def slack(self) -> float:
        """More than rounding can add to a distance."""
        return 1e-6 * (1 + np.sqrt(self.reach))


def _lift(vectors: np.ndarray, reach: float) -> np.ndarray:
    return np.sqrt(np.maximum(reach - (vectors * vectors).sum(axis=1), 0))


def _apart(vectors: np.ndarray, lifted: np.ndarray, node: Node) -> np.ndarray:
    """Distances to the node's split points."""
    own = (vectors * vectors).sum(axis=1) + lifted * lifted
    theirs = (node.points * node.points).sum(axis=1) + node.lifted * node.lifted
    return np.sqrt(np.maximum(own[:, None] + theirs[None] - 2 * (vectors @ node.points.T + lifted[:, None] * node.lifted[None]), 0))


def _split_points(vectors: np.ndarray, lifted: np.ndarray, ways: int, rng: np.random.Generator) -> np.ndarray:
    """Places of up to `ways` different rows, far from each other: of a few drawn rows, the farthest next."""
    drawn = rng.permutation(len(vectors))[: 3 * ways]
    whole = np.column_stack([vectors[drawn], lifted[drawn]])
    chosen = [0]
    near = ((whole - whole[0]) ** 2).sum(axis=1)
    while len(chosen) < ways and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((whole - whole[chosen[-1]]) ** 2).sum(axis=1))
    return drawn[chosen]


def fit(rows: pd.DataFrame, vectors: np.ndarray, reach: float, params: TreeParams) -> Tree:
    """The split points, from a sample."""
    rng = np.random.default_rng(params.seed)
    tree = Tree([], 0, vectors.shape[1], reach, rows, vectors, np.zeros(0, np.int64))
    lifted = _lift(vectors, reach)

    def grow(own: np.ndarray, depth: int) -> int:
        points = _split_points(vectors[own], lifted[own], params.ways, rng) if depth < params.depth and len(own) >= params.leaf else []
        if len(points) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = Node(vectors[own[points]], lifted[own[points]], [])
        at = len(tree.nodes)
        tree.nodes.append(node)
        side = _apart(vectors[own], lifted[own], node).argmin(axis=1)
        node.to = [grow(own[side == k], depth + 1) for k in range(len(points))]
        return at

    grow(np.arange(len(vectors)), 0)
    return tree


def _walk(tree: Tree, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each node that rows go through: its number, the rows, their distances and their sides."""
    lifted = _lift(vectors, tree.reach)
    todo = [(0, np.arange(len(vectors)))] if tree.nodes else []
    while todo:
        at, own = todo.pop()
        node = tree.nodes[at]
        apart = _apart(vectors[own], lifted[own], node)
        side = apart.argmin(axis=1)
        yield at, own, apart, side
        todo += [(to, own[side == k]) for k, to in enumerate(node.to) if to >= 0 and (side == k).any()]


def leaf_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors), np.int64)
    for at, own, _, side in _walk(tree, vectors):
        ends = np.array([-to - 1 if to < 0 else -1 for to in tree.nodes[at].to])[side]
        out[own[ends >= 0]] = ends[ends >= 0]
    return out


def ranges_of(tree: Tree, vectors: np.ndarray) -> pd.DataFrame:
    """Least and greatest distance from each split point `i` of each `node` to these rows in subtree `j`."""
    found = []
    for at, _, apart, side in _walk(tree, vectors):
        for j in np.unique(side):
            mine = apart[side == j]
            found += [(at, i, int(j), low, high) for i, (low, high) in enumerate(zip(mine.min(axis=0), mine.max(axis=0), strict=True))]
    return pd.DataFrame(found, columns=["node", "i", "j", "low", "high"])


def viable(tree: Tree, vectors: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves, each with the searches that must look into it: vectors and the scores they ask for, both ends included."""
    norms = (vectors * vectors).sum(axis=1)
    near = np.sqrt(np.maximum(norms + tree.reach - 2.0 * most, 0)) - tree.slack
    far = np.sqrt(np.maximum(norms + tree.reach - 2.0 * least, 0)) + tree.slack
    none = np.zeros(len(vectors))
    start = np.flatnonzero(least <= most)
    if not tree.nodes:
        yield 0, start
        return
    todo = [(0, start)]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        node = tree.nodes[at]
        apart = _apart(vectors[own], none[own], node)[:, :, None]
        nearest = np.maximum(apart - node.high[None], node.low[None] - apart).max(axis=1)
        farthest = (apart + node.high[None]).min(axis=1)
        kept = (nearest <= far[own][:, None]) & (farthest >= near[own][:, None])
        for k, to in enumerate(node.to):
            if to >= 0:
                todo.append((to, own[kept[:, k]]))
            elif kept[:, k].any():
                yield -to - 1, own[kept[:, k]]


def _matrix(lists: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims))
    for k, own in enumerate(lists):
        out[k, : len(own)] = own
    return out


def _bytes(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _array(data: bytes, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(*shape)


@dataclass(frozen=True)
class Search:
    """A kind of search: `top` rows of a window, whose label is that of the anchor or another."""

    same_label: bool
    top: int

    def fits(self, anchors: pd.DataFrame, no: np.ndarray, label: np.ndarray) -> np.ndarray:
        alike = anchors["label"].to_numpy()[:, None] == label[None]
        return (alike if self.same_label else ~alike) & (anchors["no"].to_numpy()[:, None] != no[None])


def _raised(tree: Tree, search: Search, anchors: pd.DataFrame, scores: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The least score that can still be among the first `top`, by the rows of the sample."""
    fits = search.fits(anchors, tree.rows["no"].to_numpy(), tree.rows["label"].to_numpy())
    fits &= (scores >= least[:, None]) & (scores <= most[:, None])
    if scores.shape[1] < search.top:
        return least
    best = -np.partition(-np.where(fits, scores, -np.inf), search.top - 1, axis=1)[:, search.top - 1]
    return np.maximum(least, best)


def _visits(tree: Tree, search: Search, windows: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], chunk: int) -> Callable:
    """Anchors and their windows -> chunks of them for every leaf they must look into."""

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), chunk):
                anchors = frame.iloc[at: at + chunk].reset_index(drop=True)
                vectors = _matrix(anchors["q"], tree.dims)
                least, most = windows(anchors)
                least = np.maximum(least, -tree.reach)
                scores = vectors @ tree.vectors.T
                least = np.column_stack([_raised(tree, search, anchors, scores, least[:, w], most[:, w]) for w in range(least.shape[1])])
                wanted: dict[int, np.ndarray] = {}
                for w in range(least.shape[1]):
                    for leaf, found in viable(tree, vectors, least[:, w], most[:, w]):
                        wanted.setdefault(leaf, np.zeros(least.shape, bool))[found, w] = True
                rows = []
                for leaf, asked in sorted(wanted.items()):
                    mine = np.flatnonzero(asked.any(axis=1))
                    if tree.blocks[leaf] and len(mine):
                        rows.append((
                            leaf, int(tree.blocks[leaf]), len(mine), _bytes(anchors["no"].to_numpy()[mine], "<i8"), _bytes(anchors["label"].to_numpy()[mine], "<i8"),
                            _bytes(vectors[mine], "<i4"), _bytes(np.where(asked, least, np.inf)[mine], "<f8"), _bytes(most[mine], "<f8")))
                if rows:
                    yield pd.DataFrame(rows, columns=["leaf", "blocks", "a_n", "a_no", "a_label", "a_q", "a_least", "a_most"])

    return own


_VISIT = "leaf long, blocks int, a_n int, a_no binary, a_label binary, a_q binary, a_least binary, a_most binary"
_BLOCK = "leaf long, block int, n int, no binary, label binary, id binary, nameless binary, q binary"
_HIT = "no long, w int, score long, id long"


def _pack(dims: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def own(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"]
        return pd.DataFrame([(
            int(rows["leaf"].iloc[0]), int(rows["block"].iloc[0]), len(rows), _bytes(rows["no"].to_numpy(), "<i8"), _bytes(rows["label"].to_numpy(), "<i8"),
            _bytes(ids.astype("Int64").fillna(0).to_numpy(np.int64), "<i8"), _bytes(ids.isna().to_numpy(), "u1"), _bytes(_matrix(rows["q"], dims), "<i4"))],
            columns=["leaf", "block", "n", "no", "label", "id", "nameless", "q"])

    return own


def best_in_block(search: Search, anchors: pd.DataFrame, vectors: np.ndarray, least: np.ndarray, most: np.ndarray,
                  no: np.ndarray, label: np.ndarray, ids: np.ndarray, nameless: np.ndarray, others: np.ndarray) -> pd.DataFrame:
    """Each anchor's first `top` rows of a block in each of its windows."""
    scores = vectors @ others.T
    fits = search.fits(anchors, no, label)
    out = []
    for w in range(least.shape[1]):
        a, b = np.nonzero(fits & (scores >= least[:, w, None]) & (scores <= most[:, w, None]))
        order = np.lexsort((ids[b], nameless[b], -scores[a, b], a))
        a, b = a[order], b[order]
        starts = np.searchsorted(a, a, side="left")
        first = np.arange(len(a)) - starts < search.top
        a, b = a[first], b[first]
        out.append(pd.DataFrame({
            "no": anchors["no"].to_numpy()[a], "w": np.full(len(a), w, np.int32), "score": scores[a, b].astype(np.int64),
            "id": pd.array(ids[b], dtype="Int64")}).assign(id=lambda d, b=b: d["id"].mask(nameless[b] != 0)))
    return pd.concat(out, ignore_index=True)


def _meet(search: Search, dims: int) -> Callable:
    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                anchors = pd.DataFrame({"no": _array(r.a_no, "<i8", r.a_n), "label": _array(r.a_label, "<i8", r.a_n)})
                shape = (r.a_n, len(r.a_least) // 8 // r.a_n)
                yield best_in_block(
                    search, anchors, _array(r.a_q, "<i4", r.a_n, dims).astype(float), _array(r.a_least, "<f8", *shape), _array(r.a_most, "<f8", *shape),
                    _array(r.no, "<i8", r.n), _array(r.label, "<i8", r.n), _array(r.id, "<i8", r.n), _array(r.nameless, "u1", r.n), _array(r.q, "<i4", r.n, dims).astype(float))

    return own


@dataclass
class Index:
    """All rows (`no, id, label, q`), the tree over them and their blocks."""

    rows: DataFrame
    tree: Tree
    blocks: DataFrame
    params: TreeParams

    def search(self, anchors: DataFrame, kind: Search, windows: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], label: str) -> DataFrame:
        """`no, w, rank, score, id`: the first `kind.top` rows of each window; `anchors` has `no, label, q` and what `windows` reads."""
        spark = self.rows.sparkSession
        tree, dims, chunk = spark.sparkContext.broadcast(self.tree), self.tree.dims, self.params.chunk
        visits = anchors.mapInPandas(lambda frames: _visits(tree.value, kind, windows, chunk)(frames), _VISIT)
        asked = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        met = asked.hint("merge").join(self.blocks, ["leaf", "block"]).drop("leaf", "block")
        hits = materialise(met.mapInPandas(_meet(kind, dims), _HIT), label)
        order = Window.partitionBy("no", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kind.top)


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """`no, id, label, q` of the rows that take part; components are whole numbers of 1/`SCALE`, rounded down."""
    own = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    named = (F.col("label") if label is None else label).cast("long")
    rows = table.where(F.col(vector).isNotNull() & own).select(F.col(key).cast("long").alias("id"), named.alias("label"), whole.alias("q"))
    return rows.where(F.col("label").isNotNull()).withColumn("no", F.monotonically_increasing_id())


def build(rows: DataFrame, params: TreeParams = TreeParams()) -> Index | None:
    """The tree over all of `rows` (`no, id, label, q`, stored); None if there are none."""
    spark = rows.sparkSession
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, reach, dims = rows.agg(F.count("*"), F.max(square), F.max(F.size("q"))).first()
    if not n:
        return None
    if reach >= _EXACT:
        raise ValueError(f"the largest squared norm is {reach:.3g}; scores are exact below 2^53 only")
    drawn = rows.orderBy(F.xxhash64("no"), "no").limit(params.sample).select("no", "label", "q").toPandas()
    tree = fit(drawn[["no", "label"]], _matrix(drawn["q"], max(dims, 1)), reach, params)
    sent = spark.sparkContext.broadcast(tree)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(leaf=leaf_of(sent.value, _matrix(frame["q"], sent.value.dims)))

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield ranges_of(sent.value, _matrix(frame["q"], sent.value.dims))

    routed = materialise(rows.select("no", "id", "label", "q").mapInPandas(placed, "no long, id long, label long, q array<long>, leaf long"), "routed")
    for node in tree.nodes:
        node.low, node.high = np.full((len(node.to),) * 2, np.inf), np.full((len(node.to),) * 2, -np.inf)
    spans = routed.select("q").mapInPandas(measured, "node int, i int, j int, low double, high double")
    for r in spans.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # as many as the tree has pairs
        tree.nodes[r["node"]].low[r["i"], r["j"]], tree.nodes[r["node"]].high[r["i"], r["j"]] = r["low"], r["high"]
    sizes = routed.groupBy("leaf").count().collect()
    tree.blocks = np.zeros(tree.leaves, np.int64)
    for r in sizes:
        tree.blocks[r["leaf"]] = -(-r["count"] // params.block)
    # one row a leaf: never more than the sample has rows
    many = spark.createDataFrame([(k, int(n)) for k, n in enumerate(tree.blocks)], "leaf long, blocks int")
    dealt = routed.join(F.broadcast(many), "leaf").withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int")).drop("blocks")
    blocks = materialise(dealt.groupBy("leaf", "block").applyInPandas(_pack(tree.dims), _BLOCK), "blocks")
    return Index(routed, tree, blocks, params)


def mine(
    table: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, params: TreeParams = TreeParams(),
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT,
) -> DataFrame:
    """Hard negatives: `anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    `anchor` tells anchors by `id`. An anchor's positives are its first rows of the same label; a positive's negatives are
    the first rows of another label whose score is `low` to `high` percent of the positive's.
    """
    spark = table.sparkSession
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = build(materialise(usable(table, key, vector, label), "vectors"), params)
    if index is None:
        return spark.createDataFrame([], empty)
    chosen = index.rows.where(anchor).select("no", "id", "label", "q")
    count = chosen.count()
    if not count:
        return spark.createDataFrame([], empty)
    chosen = materialise(chosen.repartition(-(-count // params.chunk)), "anchors")
    reach = index.tree.reach

    def anything(anchors: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.full((len(anchors), 1), -reach), np.full((len(anchors), 1), reach)

    def beside(anchors: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        least, most = np.full((len(anchors), positives), np.inf), np.full((len(anchors), positives), -np.inf)
        for k, scores in enumerate(anchors["scores"]):
            own = np.asarray(scores, np.int64)
            least[k, : len(own)], most[k, : len(own)] = -((-low * own) // 100), (high * own) // 100
        return least, most

    near = materialise(index.search(chosen, Search(True, positives), anything, "near").drop("w"), "positives")
    listed = near.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))  # a few an anchor
    asking = chosen.hint("merge").join(listed, "no").repartition(-(-count // params.chunk), "no")
    hard = index.search(asking, Search(False, negatives), beside, "hard")
    named = near.select("no", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.hint("merge").join(named, ["no", "w"]).join(chosen.select("no", F.col("id").alias("anchor_id")), "no")
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled() -> Column:
    """Every seventh id takes the next of ten labels."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def oracle() -> str:
    """All pairs as SQL for DuckDB."""
    return f"""
with whole as (select row_number() over () as no, vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor({SCALE} * x::double)) as q from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.no, a.id as anchor_id, b.no as other, b.id, a.label = b.label as alike, list_inner_product(a.q, b.q)::bigint as score
    from whole a join whole b on a.no <> b.no where a.id % {ANCHORS} = 0),
near as (select no, anchor_id, id as positive_id, score as positive_score, row_number() over (partition by no order by score desc, id) as w
    from pairs where alike qualify w <= {POSITIVES})
select anchor_id, positive_id, row_number() over (partition by no, w order by score desc, id)::int as rank, id as negative_id,
    positive_score, score as negative_score
from near join pairs using (no, anchor_id)
where not alike and {LOW_PERCENT} * positive_score <= 100 * score and 100 * score <= {HIGH_PERCENT} * positive_score
qualify row_number() over (partition by no, w order by score desc, id) <= {NEGATIVES}"""
