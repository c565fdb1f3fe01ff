"""Exact top-k inner products by a dual cover tree over queries and data.

Vectors become integers (floor of ``scale`` times each component). A cover tree holds queries and
data together: a node is a ball around a centre; a node of more than LEAF_ROWS rows is split among
centres picked farthest-first from a bounded sample of it, each row goes to the nearest, and every child
keeps its own centre and covering radius, round by round until nodes are small. Leaves also keep the
ball of their queries. For a query ball (c, r) and a data ball (d, s) no inner product exceeds
``c·d + |c| s + |d| r + r s``. Queries first meet the data of their own leaf, which gives each a
kth score to beat; pairs of a query group and a node go down the tree, and one whose bound is below the
group's worst kth score is pruned with all that lies below it. All arithmetic on scores is exact.

Where vectors have no clusters, as in many dimensions at random, balls overlap and little can be pruned:
the work then is that of comparing all queries with all rows, and queries (a fiftieth of the rows), not
data, are what travels. Nodes, pairs and leaves are Spark tables; the driver sees counts, and the
centres of the first level. Many equal vectors fill several leaves of one node, dealt by a hash.

Cases: vectors that are null, hold a null or a non-finite component or have no id take no part;
shorter vectors count as ended by zeros; repeated rows of an id and vector are one row, and no
row of the query's id is its candidate; fewer candidates than k give all; ties go to the smaller
id; extra columns are ignored; an empty table gives no rows.
"""

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm import arrays
from logwarden.llm.common import few, stage
from logwarden.staging import sized

SCALE, EVERY, TOP = 256, 50, 5
CHILDREN, SAMPLE = 16, 512
LEAF_ROWS = 2_048
ROUNDS = 12
PART_GROUPS = 256
TRAVELLING = 20_000  # rows with a vector or a few that are broadcast; more are joined by shuffle
ROOT = 1
NONE = np.iinfo(np.int64).max
EXACT = 2.0 ** 52  # sums of products below this are exact in doubles
FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as 64-bit little-endian integers, one row for equal rows, all at the root."""
    def convert(batches):
        for batch in batches:
            ids, out = [], []
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if vec_id is None or not vector.is_valid:
                    continue
                values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
                if np.isfinite(values).all():
                    ids.append(vec_id)
                    out.append(np.floor(scale * values).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        arrays.tidy(convert), "vec_id long, v binary").dropDuplicates(["vec_id", "v"]).select(
            "vec_id", "v", F.lit(ROOT).cast("long").alias("node"), F.lit(None).cast("double").alias("far"))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a binary column as doubles of ``width`` components."""
    rows = column.to_pylist()
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), width).astype(np.float64)
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        out[k, :len(row) // 8] = np.frombuffer(row, "<i8")
    return out


def farthest_first(points: np.ndarray, many: int) -> np.ndarray:
    """Up to ``many`` distinct points, each next one the worst covered by those before."""
    chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < many and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def nearest(points: np.ndarray, balls: np.ndarray) -> np.ndarray:
    return ((balls ** 2).sum(axis=1)[None, :] - 2 * points @ balls.T).argmin(axis=1)


def _best(query_ids, queries, ids, data, k, held):
    """The k best (score, id) of each query among ``data`` and what it holds already."""
    scores = queries @ data.T
    most = scores.max(axis=1, initial=-np.inf)
    out = []
    for q, row in enumerate(scores):
        if len(held[q]) == k and most[q] < -held[q][-1][0]:
            out.append(held[q])  # nothing here is as good as its worst
            continue
        if len(row) > k:
            # everything level with the kth stays for the tie-break
            floor = np.partition(row, len(row) - k - 1)[len(row) - k - 1]  # own row may be among them
            at = np.flatnonzero(row >= floor)
        else:
            at = np.arange(len(row))
        new = [(-int(row[i]), int(ids[i])) for i in at if ids[i] != query_ids[q]]
        out.append(sorted({*held[q], *new})[:k])
    return out


def _kth(best, k) -> float:
    """Worst kth score of a query group; no bound while a query has fewer."""
    return min((-b[k - 1][0] if len(b) >= k else -np.inf) for b in best) if best else np.inf


def bounds(c, r, d, s) -> np.ndarray:
    """No inner product of a point of ball (c, r) with one of ball (d, s) is above this; by rows."""
    norm = np.linalg.norm
    exact = (c * d).sum(axis=1) + norm(c, axis=1) * s + norm(d, axis=1) * r + r * s
    return exact + 1e-9 * np.abs(exact) + 1e-6


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in text.split(", ")])


def _table(text: str, rows: list) -> pa.Table:
    schema = _schema(text)
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# --- the tree ----------------------------------------------------------------------------

NODE = "node long, parent long, centre binary, radius double, n long"


def _split(rows: DataFrame, big: DataFrame, width: int) -> DataFrame:
    """(node, balls): centres of the children of each node in ``big``, from a bounded sample of its rows."""
    some = rows.join(big, "node", "left_semi").withColumn(
        "place", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("vec_id"), "v"))).filter(F.col("place") <= SAMPLE)

    def centres(given):
        points = farthest_first(matrix(given.column("v"), width), CHILDREN)
        return _table("node long, balls binary", [(given.column("node")[0].as_py(), points.tobytes())])

    return some.select("node", "v").groupBy("node").applyInArrow(centres, "node long, balls binary")


def _placed(rows: DataFrame, balls: DataFrame, width: int) -> DataFrame:
    """Rows (vec_id, v, node, far) of split nodes go to the child with the nearest centre."""
    def assign(batches):
        for batch in batches:
            node, far = np.array(batch.column("node")), np.array(batch.column("far"))
            held = batch.column("balls")
            for parent in np.unique(node[held.is_valid().to_numpy(zero_copy_only=False)]) if batch.num_rows else ():
                at = np.flatnonzero(node == parent)
                centres = np.frombuffer(held[int(at[0])].as_py()).reshape(-1, width)
                points = matrix(batch.column("v").take(pa.array(at)), width)
                child = nearest(points, centres)
                node[at] = parent * CHILDREN + child
                far[at] = np.linalg.norm(points - centres[child], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(node), pa.array(far)], ["vec_id", "v", "node", "far"])

    return rows.join(sized(balls, TRAVELLING), "node", "left").select("vec_id", "v", "node", "far", "balls").mapInArrow(
        arrays.tidy(assign), "vec_id long, v binary, node long, far double")


def tree(vectors: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): every row with the lowest node that holds it, and all nodes with their balls.

    The root is node 1; the children of node x are x * CHILDREN and following. Nodes of more than
    LEAF_ROWS rows are split round by round; a node whose rows are all one point is not."""
    rows = vectors.select("vec_id", "v", "node", "far")
    nodes, sizes = [], vectors.sparkSession.createDataFrame([(ROOT, 1.0, LEAF_ROWS + 1)], "node long, radius double, n long")
    for _ in range(ROUNDS):
        big = sizes.filter((F.col("n") > LEAF_ROWS) & (F.col("radius") > 0)).select("node")
        balls = stage(_split(rows, sized(big, TRAVELLING), width), "balls")
        # one centre: the sample was one point, and the rest of the node is dealt among leaves
        balls = balls.filter((F.length("balls") > 8 * width) | (F.col("node") == ROOT))
        if balls.isEmpty():
            break
        rows = stage(_placed(rows, balls, width), "placed")
        fresh = balls.select(F.col("node").alias("parent"), F.posexplode(F.transform(
            F.sequence(F.lit(0), (F.length("balls") / (8 * width) - 1).cast("int")), lambda k: F.substring("balls", (k * 8 * width + 1).cast("int"), F.lit(8 * width)))).alias("k", "centre"))
        fresh = fresh.select((F.col("parent") * CHILDREN + F.col("k")).alias("node"), "parent", "centre")
        sizes = stage(rows.groupBy("node").agg(F.max("far").alias("radius"), F.count("*").alias("n")).join(fresh.select("node"), "node", "left_semi"), "sizes")
        nodes.append(stage(fresh.join(sizes, "node").select(*[part.split()[0] for part in NODE.split(", ")]), "nodes"))
    return rows, functools.reduce(DataFrame.unionByName, nodes)


LEAF = ("leaf string, parent long, centre binary, radius double, ids binary, data binary, query_ids binary, queries binary, "
        "query_radius double, best binary, best_ids binary, kth double")


def leaves(rows: DataFrame, nodes: DataFrame, every: int, k: int, width: int) -> DataFrame:
    """One row for each leaf: its data and queries, their balls, and the queries' best of the leaf and of a
    bounded sample of all rows, so that queries of a leaf with few rows have a score to beat too. A lowest
    node of more than LEAF_ROWS rows makes several leaves, dealt by a hash of the row."""
    some = few(rows.select("vec_id", "v"), SAMPLE, "vec_id", "v")
    some_ids = np.array([r["vec_id"] for r in some], np.int64)
    some_data = matrix(pa.array([bytes(r["v"]) for r in some], pa.binary()), width)
    known = nodes.select("node", "centre", F.ceil(F.col("n") / LEAF_ROWS).alias("parts"))
    leaf = F.concat_ws(".", "node", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
    dealt = rows.join(sized(known, TRAVELLING), "node").select(leaf.alias("leaf"), "node", "vec_id", "v", "centre")

    def build(given):
        ids, data = np.array(given.column("vec_id").to_pylist(), np.int64), matrix(given.column("v"), width)
        centre = np.frombuffer(given.column("centre")[0].as_py())
        far = np.linalg.norm(data - centre, axis=1)
        asks = ids % every == 0
        other = ~np.isin(some_ids, ids)  # no row twice
        best = _best(ids[asks], data[asks], np.concatenate([ids, some_ids[other]]), np.concatenate([data, some_data[other]]), k, [[]] * int(asks.sum()))
        flat = np.full((len(best), k, 2), NONE)
        for q, rows_of in enumerate(best):
            for n, pair in enumerate(rows_of):
                flat[q, n] = pair
        return _table(LEAF, [(
            given.column("leaf")[0].as_py(), given.column("node")[0].as_py(), centre.tobytes(), float(far.max()), ids.tobytes(), data.tobytes(),
            ids[asks].tobytes(), data[asks].tobytes(), float(far[asks].max(initial=0.0)), flat[:, :, 0].tobytes(), flat[:, :, 1].tobytes(),
            float(_kth(best, k)))])

    return dealt.groupBy("leaf").applyInArrow(build, LEAF)


# --- pairs of nodes ----------------------------------------------------------------------


def surviving(groups: DataFrame, below: DataFrame) -> DataFrame:
    """(query_leaf, leaf) of all pairs that may hold one of the k best of a query of the group.

    ``groups`` (query_leaf, query_centre, query_radius, query_kth); ``below`` (parent, node, leaf,
    centre, radius): nodes and leaves under their parents. Pairs go down the tree level by level; a
    pair whose bound is below the group's worst kth score goes no further."""
    groups, below = sized(groups, TRAVELLING), sized(below, TRAVELLING)
    kinds = "query_leaf string, node long, leaf string"

    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = [np.stack([np.frombuffer(v) for v in batch.column(c).to_pylist()]) for c in ("query_centre", "centre")]
            most = bounds(vectors[0], np.asarray(batch.column("query_radius")), vectors[1], np.asarray(batch.column("radius")))
            yield batch.select(["query_leaf", "node", "leaf"]).filter(pa.array(most >= np.asarray(batch.column("query_kth"))))

    pairs, found = stage(groups.select("query_leaf", F.lit(ROOT).cast("long").alias("node")), "pairs"), []
    while True:
        next_ = pairs.withColumnRenamed("node", "parent").join(below, "parent").join(groups, "query_leaf")
        pairs = stage(next_.mapInArrow(arrays.tidy(keep), kinds), "pairs")
        found.append(pairs.filter("leaf is not null").select("query_leaf", "leaf"))
        pairs = pairs.filter("node is not null").select("query_leaf", "node")
        if pairs.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def _meet(width: int, k: int) -> Callable:
    """Rows sorted by leaf: its data first, then the query groups that visit it, one by one."""
    def meet(batches):
        key, ids, data = None, None, None
        for batch in batches:
            def numbers(column, n, kind=np.float64):
                return np.frombuffer(batch.column(column)[n].as_buffer(), kind)

            found = []
            places = zip(batch.column("kind").to_pylist(), batch.column("leaf").to_pylist(), batch.column("part").to_pylist())
            for n, (kind, *place) in enumerate(places):
                if kind == 0:
                    key, ids, data = place, numbers("ids", n, np.int64).copy(), numbers("data", n).reshape(-1, width).copy()
                    continue
                assert key == place
                query_ids, queries = numbers("ids", n, np.int64), numbers("data", n).reshape(-1, width)
                flat = np.stack([numbers(c, n, np.int64).reshape(-1, k) for c in ("best", "best_ids")], 2)
                held = [[(int(s), int(i)) for s, i in rows_of if s != NONE] for rows_of in flat]
                for q, was, now in zip(query_ids, held, _best(query_ids, queries, ids, data, k, held)):
                    found += [(int(q), i, -s) for s, i in now if (s, i) not in was]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in range(3)], schema=_schema(FOUND))
    return meet


def top(vectors: DataFrame, every: int = EVERY, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row whose id ``every`` divides."""
    rows = stage(integers(vectors, scale), "vectors")
    size = rows.agg(F.max(F.length("v")).alias("bytes")).first()["bytes"]
    if not size:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = size // 8
    placed, nodes = tree(rows, width)
    lowest = nodes.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    held = stage(leaves(placed, lowest, every, k, width), "leaves")
    found = search(held, nodes, k, width)
    order: list[Column] = [F.desc("score"), F.col("vec_id")]
    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def visits_of(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_leaf, leaf): pairs of leaves that must be compared, own ones left out."""
    groups = held.filter(F.length("query_ids") > 0).select(
        F.col("leaf").alias("query_leaf"), F.col("centre").alias("query_centre"), "query_radius", F.col("kth").alias("query_kth"))
    below = nodes.select("parent", "node", F.lit(None).cast("string").alias("leaf"), "centre", "radius").unionByName(
        held.select("parent", F.lit(None).cast("long").alias("node"), "leaf", "centre", "radius"))
    return stage(surviving(groups, below).filter("query_leaf <> leaf"), "visits")


def search(held: DataFrame, nodes: DataFrame, k: int, width: int) -> DataFrame:
    """(query_id, vec_id, score): what each query found in its own leaf and in those it had to visit.

    Queries travel, data leaves stay whole: a leaf that many groups visit is repeated to parts of
    PART_GROUPS of them, and in each part the groups stream past the leaf."""
    longest = max(np.linalg.norm(np.frombuffer(r["centre"])) + r["radius"] for r in nodes.filter(F.col("parent") == ROOT).collect())  # at most CHILDREN rows
    if longest ** 2 > EXACT:
        raise ValueError("components are too large for exact inner products")
    visits = visits_of(held, nodes)
    parts = stage(visits.groupBy("leaf").agg(F.ceil(F.count("*") / PART_GROUPS).cast("long").alias("parts")), "parts")
    empty = F.lit(None).cast("binary")
    data = held.join(parts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"),
                                           "ids", "data", empty.alias("best"), empty.alias("best_ids"))
    asking = held.select(F.col("leaf").alias("query_leaf"), F.col("query_ids").alias("ids"), F.col("queries").alias("data"), "best", "best_ids")
    groups = visits.join(sized(parts, TRAVELLING), "leaf").withColumn("part", F.pmod(F.xxhash64("query_leaf"), F.col("parts"))).join(asking, "query_leaf").select(
        "leaf", "part", F.lit(1).alias("kind"), "ids", "data", "best", "best_ids")
    met = data.unionByName(groups).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind").mapInArrow(arrays.tidy(_meet(width, k)), FOUND)

    def own(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["query_ids"], np.int64)
                scores, best = (np.frombuffer(row[c], np.int64).reshape(-1, k) for c in ("best", "best_ids"))
                found += [(int(q), int(i), -int(s)) for q, a, b in zip(ids, scores, best) for s, i in zip(a, b) if s != NONE]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in range(3)], schema=_schema(FOUND))

    return met.unionByName(held.select("query_ids", "best", "best_ids").mapInArrow(own, FOUND))
