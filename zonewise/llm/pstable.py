"""Near duplicates among vectors: p-stable hashing of unit vectors in several tables, then exact cosines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, erf, exp, log, pi, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from zonewise.llm.components import components
from zonewise.session import pin

#: Vectors of a chunk: a task compares two chunks at a time, whatever the size of their bucket.
CHUNK = 256
SEED = 5


class Tables(NamedTuple):
    """Parameters of the hash tables: ``tables`` of ``places`` projections each, in steps of ``step``."""

    tables: int
    places: int
    step: float


def _collide(distance: float, step: float) -> float:
    """Chance that a random projection puts two points at ``distance`` into one step."""
    r = step / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def tables_for(n: int, cosine: float, recall: float = 0.9999, unrelated: float = 0.25) -> Tables:
    """The fewest tables that find a pair at exactly ``cosine`` with chance ``recall`` (closer pairs more surely).

    Places are as many as keep a vector's chance hits among ``n`` vectors of cosine ``unrelated``
    below one in a table. Vectors more alike than that cost comparisons, never links.
    """
    near, far = sqrt(2 - 2 * min(cosine, 1 - 1e-9)), sqrt(2 - 2 * unrelated)
    best = None
    for step in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0):
        places = max(1, ceil(log(max(n, 2)) / -log(_collide(far, step))))
        hit = _collide(near, step) ** places
        tables = 1 if hit >= recall else ceil(log(1 - recall) / log(1 - hit))
        if best is None or tables < best.tables:
            best = Tables(tables, places, step)
    return best


def _matrix(lists: pa.Array) -> np.ndarray:
    """The lists as rows, shorter ones padded with zeros, which change no cosine."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max()), flat.dtype)
    out[np.arange(sizes.max()) < sizes[:, None]] = flat
    return out


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by a power of two, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hasher(shape: Tables) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``row``, ``keys``: a 64-bit number for each table, equal where label and all quantised projections are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple] = {}
        n = shape.tables * shape.places
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, rows, salt = batch.column("vector"), batch.column("row").to_numpy(), batch.column("salt").to_numpy()
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dims in map(int, np.unique(sizes)):
                if dims not in drawn:
                    rng = np.random.default_rng([SEED, dims])
                    drawn[dims] = rng.standard_normal((dims, n)), rng.uniform(0, shape.step, n), rng.integers(1, 1 << 62, n, dtype=np.int64) * 2 + 1
                lines, shift, odd = drawn[dims]
                at = np.flatnonzero(sizes == dims)
                cells = np.floor((_units(_matrix(vectors.take(pa.array(at)))) @ lines + shift) / shape.step).astype(np.int64)
                mixed = (cells * odd).reshape(len(at), shape.tables, shape.places).sum(axis=2)  # wraps around
                mixed += salt[at, None] + np.arange(shape.tables) * np.int64(0x5851F42D4C957F2D)
                starts = pa.array(np.arange(0, mixed.size + 1, shape.tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.ListArray.from_arrays(starts, pa.array(mixed.ravel()))], names=["row", "keys"])

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each node the smallest node that its links reach."""
    n = len(linked)
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(linked, root, n).min(axis=1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


_SLIM = ("id", "copies", "key", "lo", "hi", "table", "side", "label")


def _compare(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of the pairs of two chunks that meet first in this table: counts by vector and a forest of links.

    Rows come sorted by pair of chunks; the rows of one pair of chunks and one batch are held at a time.
    """

    def pairs(g: dict[str, np.ndarray]) -> tuple | None:
        one = g["side"] == 0
        across = g["lo"][0] != g["hi"][0]  # two chunks are compared across, one chunk with itself
        two = ~one if across else one
        if not two.any() or not one.any():
            return None
        unit = _units(g["vector"])
        met = (unit[one] @ unit[two].T) >= cosine
        if not across:
            np.fill_diagonal(met, False)
        if len(set(g["label"])) > 1:  # labels whose hashes agree
            met &= g["label"][one][:, None] == g["label"][two][None, :]
        for t in range(int(g["table"][0])):  # counted where the two first share a key
            if not met.any():
                break
            met &= g["keys"][one, t][:, None] != g["keys"][two, t][None, :]
        if not met.any():
            return None
        n = len(one)
        linked = np.zeros((n, n), bool)
        linked[np.ix_(one, two)] = met
        linked |= linked.T
        links = linked @ g["copies"]
        root = _forest(linked)
        at = np.flatnonzero(links)
        return g["id"][at], links[at], g["id"][root[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        found: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["id", "links", "root"])

        def work(g: dict[str, np.ndarray]) -> None:
            if len(g["id"]) > 1 and (x := pairs(g)) is not None:
                found.append(x)

        def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if a.ndim == 2 and a.shape[1] != b.shape[1]:
                width = max(a.shape[1], b.shape[1])
                a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
            return np.concatenate([a, b])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in _SLIM} | {k: _matrix(batch.column(k)) for k in ("vector", "keys")}
            if kept is not None:
                g = {k: joined(kept[k], g[k]) for k in g}
            new = np.zeros(len(g["id"]), bool)
            for k in ("key", "lo", "hi"):
                new[1:] |= g[k][1:] != g[k][:-1]
            cuts = [0, *np.flatnonzero(new).tolist()]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo > 1:
                    work({k: v[lo:hi] for k, v in g.items()})
            kept = {k: v[cuts[-1] :] for k, v in g.items()}  # the last pair may go on in the next batch
            if sum(len(f[0]) for f in found) > 10_000:
                yield flush()
        if kept is not None:
            work(kept)
        if found:
            yield flush()

    return run


def comparable(vector: Column) -> Column:
    """Whether a vector has a direction: not null nor empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", shape: Tables | None = None) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row, linked at ``cosine`` or more inside a label.

    Unit vectors are projected on Gaussian lines, cut in steps and hashed by several lines at a time
    (``tables_for``); rows alone in all their buckets are done. The others are collapsed to classes
    of equal vectors, and the classes of a bucket are dealt into chunks of about ``CHUNK`` that are
    compared in pairs, exactly and in double precision, whatever the size of the bucket. A pair counts
    in the first table that it shares only, so no list of pairs is made: what leaves a comparison is a
    count of links and one edge of a forest for each vector. A bucket of n different near copies still
    takes n * n / 2 comparisons, as the number of links of each is asked for.

    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; so do vectors of different lengths. Equal rows are linked, and a repeated key counts as
    often as it stands there. ``component_id`` is the smallest key reachable, null only if all are.
    An empty table gives an empty result; other columns are ignored.
    """
    usable = comparable(F.col(vector)) & F.col(label).isNotNull()
    rows = pin(vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("own"), F.when(usable, F.col(label).cast("string")).alias("label"), F.when(usable, F.col(vector)).alias("vector")
    ))
    compared = rows.filter(F.col("label").isNotNull())
    if shape is None:
        most = compared.groupBy("label").count().agg(F.max("count")).first()[0]
        shape = tables_for(most or 1, cosine)
    salted = compared.select("row", "vector", F.xxhash64("label", F.size("vector")).alias("salt"))
    keys = pin(salted.mapInArrow(_hasher(shape), "row long, keys array<long>"))

    each = keys.select("row", F.explode("keys").alias("key"))
    shared = each.groupBy("key").count().filter("count > 1").select("key")
    near = pin(compared.join(each.join(shared, "key", "left_semi").select("row").distinct(), "row", "left_semi"))
    classes = pin(near.groupBy("label", "vector").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("own").alias("least")))
    members = pin(classes.join(keys, F.col("id") == F.col("row")).select("id", "copies", "label", "vector", "keys"))

    posts = members.select("id", F.posexplode("keys").alias("table", "key"))
    crowds = posts.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    mine = F.pmod(F.xxhash64("id", "key"), F.col("chunks")).cast("int")
    dealt = posts.join(crowds, "key").withColumn("chunk", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("id", "table", "key", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"), (F.col("chunk") > F.col("with")).cast("int").alias("side"))
    moved = dealt.join(members, "id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = pin(moved.select(*_SLIM, "vector", "keys").mapInArrow(_compare(cosine), "id long, links long, root long"))

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    joined = classes.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    joined = pin(joined.filter("links > 0 or copies > 1").select("id", "label", "vector", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    told = near.select("row", "label", "vector").join(joined, ["label", "vector"]).join(smallest, "root").select("row", "n_links", "component_id")
    out = rows.select("row", "own").join(told, "row", "left")
    component = F.coalesce("component_id", "own")
    return out.select(F.col("own").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("own").eqNullSafe(component).alias("kept"))
