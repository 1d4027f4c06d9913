"""Exact Jaccard join of word n-gram sets as a metric-space join.

Between unrelated texts the Jaccard distance is 1 whatever pivot one looks from, so triangle windows
over the whole space would hand every text to every region. The space is therefore first cut where
the metric allows it: the size window around the empty set gives size classes with a replicated
margin, and inside a class a pair within the bound must agree exactly on e of k + e parts of the
shingle universe, k being the largest symmetric difference. A text that does not agree with others on
e parts has no partner; those that do are connected by their agreements to the first regions. Regions
that are still large get pivots: texts go home to their nearest pivot (Voronoi) and are replicated as
guests to every pivot within the triangle window, again and again until regions are small or the
windows show that they cannot be cut, in which case they are joined in blocks.
A region may also be a chain of unrelated texts that chance agreements tie together, as texts with a
common passage have them. Two texts within the bound share a shingle among the first fifth or so of either in
any one order of the universe; with rare shingles first, this takes such chains apart before pivots are drawn,
and texts without enough shingles that stand in two texts of their region leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from zonewise.llm.components import components
from zonewise.llm.words import mix, released, shingle_sets
from zonewise.session import pin, release

REGION_ROWS = 512
REGION_SHINGLES = 400_000
PIVOTS = 16
FILTER_WORDS = 1 << 18  # numbers of 64 bits in a filter of ids
MOST_COPIES = 3.0  # a region is cut only if windows copy its rows fewer times than this
_U = np.uint64


class Scheme:
    """Size classes and numbers of parts for a similarity of ``percent`` / 100 or more."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        ratio, at, bounds = (100 / percent) ** 2, 1.0, [1]
        while bounds[-1] < largest:
            at *= ratio
            if int(np.ceil(at)) > bounds[-1]:
                bounds.append(int(np.ceil(at)))
        self.percent, self.bounds = percent, np.array(bounds, np.int64)
        most = self.bounds[1:] - 1
        self.differ = (100 - percent) * 2 * most // (100 + percent)
        self.spare = np.where(self.differ == 0, 1, 2 + self.differ // 8)
        self.parts = self.differ + self.spare

    def homes(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each size, and whether it can pair with the class above."""
        own = np.searchsorted(self.bounds, sizes, "right") - 1
        return own, sizes * 100 >= self.percent * self.bounds[own + 1]


def set_digest(keys: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        a = mix(keys ^ _U(0x1234567)).sum(dtype=_U)
        b = mix(keys ^ _U(0x89ABCDE)).sum(dtype=_U)
    pair = mix(np.array([a + _U(len(keys)), b - _U(len(keys))], _U)).view(np.int64)
    return int(pair[0]), int(pair[1])


def signatures(sets: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, class and need) rows; two sets within the bound share as many as needed.

    The third column holds the class and, in its last 16 bits, how many signatures of that class a set
    must share with others before it can have a partner.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    own, above = scheme.homes(sizes)
    member = np.concatenate((np.arange(len(sets)), np.flatnonzero(above)))
    level = np.concatenate((own, own[above] + 1))
    parts = scheme.parts[level]
    flat = np.concatenate([sets[i] for i in member])
    entry = np.repeat(np.arange(len(member)), sizes[member])
    spread = mix(flat ^ mix(level[entry].astype(_U) + _U(77)))
    base = np.concatenate(([0], np.cumsum(parts)))
    slot = base[entry] + ((spread >> _U(20)) % parts[entry].astype(_U)).astype(np.int64)
    total = np.zeros(base[-1], _U)
    np.add.at(total, slot, mix(flat))
    filled = np.bincount(slot, minlength=base[-1]) > 0
    of = np.repeat(np.arange(len(member)), parts)
    empties = parts - np.bincount(of[filled], minlength=len(member))
    # With as many empty parts as agreements are certain, an empty part may be the one agreed on.
    keep = filled | (empties >= scheme.spare[level])[of]
    part = (np.arange(base[-1]) - base[of]).astype(_U)
    sig = mix(total + mix(part * _U(0x10001) + (level[of].astype(_U) << _U(44)) + _U(9)))
    # The partner may have too few empty parts to send them: then the certain agreements but for its own
    # empty parts are on filled ones, one at least.
    need = np.maximum(1, scheme.spare[level] - empties)
    return member[of[keep]], sig[keep].view(np.int64), ((level << 16) + np.minimum(need, 65_535)).astype(np.int32)[of[keep]]


def _digests(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, keys in shingle_sets(batch.column(1), n):
                sizes[i] = len(keys)
                if len(keys):
                    first[i], second[i] = set_digest(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(first), pa.array(second)], ["doc_id", "n_shingles", "h1", "h2"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, n_shingles long, h1 long, h2 long")


def _postings(docs: DataFrame, n: int, percent: int) -> DataFrame:
    scheme = Scheme(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets of this task: copies are dropped before the shuffle

        def rows(names, sets):
            at, sig, need = signatures(sets, scheme)
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.array(names, np.int64)[at]), pa.array(need)], ["sig", "node", "need"])

        for batch in batches:
            names, sets, held = [], [], 0
            for _, keys in shingle_sets(batch.column(0), n):
                if len(keys) and (name := set_digest(keys)[0]) not in seen:
                    seen.add(name)
                    names.append(name)
                    sets.append(keys)
                    held += len(keys)
                    if held > 300_000:
                        yield rows(names, sets)
                        names, sets, held = [], [], 0
            if sets:
                yield rows(names, sets)

    return docs.select("text").mapInArrow(released(run), "sig long, node long, need int")


def _joined_heads(post: DataFrame) -> DataFrame:
    """Components of the nodes of ``post(sig, node)`` that share signatures."""
    edges = post.withColumn("head", F.min("node").over(W.partitionBy("sig"))).filter("node <> head")
    return components(edges.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())


def _agreeing(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``h1`` and ``region`` of the sets that share as many signatures with others as they need."""
    w = W.partitionBy("sig")
    post = _postings(docs, n, percent)
    shared = post.withColumn("low", F.min("node").over(w)).withColumn("high", F.max("node").over(w)).filter("low <> high")
    shared = pin(shared.select("sig", "node", "need"))
    enough = shared.groupBy("node", "need").agg(F.count_distinct("sig").alias("n")).filter("n >= need % 65536").select("node", "need")
    found = _joined_heads(shared.join(enough, ["node", "need"]).select("sig", "node"))
    release(shared)  # the components stand on tables of their own
    return found.select(F.col("node").alias("h1"), F.col("root").alias("region"))


def _narrowed(rows: DataFrame, percent: int) -> DataFrame:
    """Large regions cut by their rarest shingles, exactly; texts that can have no partner are left out.

    A linked pair shares at least ``percent`` / 100 of either set. All but fewer than that many shingles of a set,
    first in one order for all sets of the region, therefore hold the first shingle that the two share. The order is
    by the number of texts that hold a shingle, so a passage of many texts ties few together. A shingle of one text
    ties nothing: it only counts among the first ones of its set, and a text with too many of them has no partner.
    """
    least = F.expr(f"(size * {percent} + 99) div 100")
    posts = rows.select("doc_id", F.size("keys").alias("size"), "region", F.explode("keys").alias("key"))
    counted = posts.select("doc_id", "size", F.xxhash64("region", "key").alias("sig")).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("sig")))
    held = counted.filter("n > 1").groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("held"))
    able = held.filter(F.size("held") >= least).withColumn("first", F.slice("held", F.lit(1), (F.size("held") - least + 1).cast("int")))
    found = _joined_heads(able.select(F.explode("first.sig").alias("sig"), F.col("doc_id").alias("node")))
    parts = found.select(F.col("node").alias("doc_id"), F.xxhash64(F.lit(1), "root").alias("part"))
    return rows.join(parts, "doc_id").select(F.col("part").alias("region"), "doc_id", "keys", "home")


def joined_roots(sets: list[np.ndarray], home: np.ndarray, percent: int) -> np.ndarray:
    """Smallest index linked with each set of a region, exactly; two guests are left to their homes."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = (100 + percent) * both >= percent * int(sizes.sum()) and home.any()
        return np.array([0, 0 if linked else 1])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    common = np.bincount(column)[column] > 1
    column, row = column[common], row[common]
    # Shingles that stand in the same sets are one column with a weight.
    tags = mix(np.arange(1, n + 1).astype(_U))
    pattern = np.zeros(column.max() + 1 if len(column) else 0, _U)
    np.add.at(pattern, column, tags[row])
    used = np.unique(column)
    _, first, kind, weight = np.unique(pattern[used], return_index=True, return_inverse=True, return_counts=True)
    to = np.zeros(len(pattern), np.int64)
    to[used] = kind
    chosen = np.zeros(len(pattern), bool)
    chosen[used[first]] = True
    row, column = row[chosen[column]], to[column[chosen[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float64)
    for lo in range(0, len(weight), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        block = np.zeros((n, min(4096, len(weight) - lo)), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        shared += (block * weight[lo : lo + block.shape[1]].astype(np.float32)) @ block.T
    linked = (100 + percent) * shared >= percent * (sizes[:, None] + sizes[None, :])
    linked &= home[:, None] | home[None, :]
    np.fill_diagonal(linked, True)
    root = np.arange(n)
    while True:
        new = np.where(linked, root[None, :], n).min(1)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``_z_likely``: true for every doc_id in ``ids`` and for few others.

    A bit for each hashed id, sent to all tasks as at most ``FILTER_WORDS`` numbers whatever the table,
    so that texts of other documents need not be moved to learn that they are not wanted.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS * 64))
    bit = F.expr("shiftleft(1L, cast(_z_at % 64 as int))")
    slots = ids.select(at.alias("_z_at")).select(F.expr("_z_at div 64").alias("_z_word"), bit.alias("_z_bit"))
    words = slots.groupBy("_z_word").agg(F.bit_or("_z_bit").alias("_z_bits"))
    near = docs.withColumn("_z_at", at).withColumn("_z_word", F.expr("_z_at div 64")).join(F.broadcast(words), "_z_word", "left")
    likely = F.coalesce(F.col("_z_bits").bitwiseAND(bit) != 0, F.lit(False))
    return near.select(*docs.columns, likely.alias("_z_likely"))


def _sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The shingle sets of the members only."""
    likely = _marked(docs.select("doc_id", "text"), members).filter("_z_likely").drop("_z_likely")
    # A sort-merge join at every size: members grow with the documents, and their text is moved once.
    rows = likely.hint("merge").join(members, "doc_id").select("region", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            at = 0

            def out():
                flat = np.concatenate(held).view(np.int64) if held else np.zeros(0, np.int64)
                ends = np.concatenate(([0], np.cumsum([len(k) for k in held]))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                cut = [c.slice(at, len(held)) for c in batch.columns[:2]]
                return pa.RecordBatch.from_arrays([*cut, keys], ["region", "doc_id", "keys"])

            for _, keys in shingle_sets(batch.column(2), n):
                held.append(keys)
                if sum(map(len, held[-1:])) and len(held) >= 512:
                    yield out()
                    at, held = at + len(held), []
            if held:
                yield out()

    return rows.mapInArrow(released(run), "region long, doc_id long, keys array<long>")


def _unsigned(keys) -> np.ndarray:
    return np.asarray(keys, np.int64).view(_U)


def _distances(keys: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(pivots))
    for i, p in enumerate(pivots):
        both = len(np.intersect1d(keys, p, assume_unique=True))
        out[i] = 1 - both / (len(keys) + len(p) - both)
    return out


def _partnered(rows: DataFrame, percent: int) -> DataFrame:
    """The texts of large regions that can have a partner there, exactly.

    A linked pair shares ``percent`` / 100 of either set, and what it shares stands in two texts of
    the region. Texts that hold less of such shingles go, then those that were left without by
    that, as long as a pass takes a tenth of the rows. Counts are combined before the shuffle, and a frequent shingle's join can be split.
    ``rows`` are written and go as soon as fewer of them are.
    """
    left = rows.count()
    while left:
        posts = rows.select("region", "doc_id", F.explode("keys").alias("key"))
        shared = posts.groupBy("region", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("region", "key")
        held = posts.join(shared, ["region", "key"]).groupBy("region", "doc_id").agg(F.count(F.lit(1)).alias("held"))
        kept = rows.join(held, ["region", "doc_id"]).filter(F.col("held") * 100 >= F.size("keys") * percent)
        fewer = pin(kept.select(*rows.columns))
        release(rows)
        rows = fewer
        before, left = left, rows.count()
        if left > 0.9 * before:  # what a further pass would take is left to the comparison
            break
    return rows


def _cut(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Cut large regions by pivots: (rows of the new regions, rows of regions that cannot be cut).

    A pair with a home in cell p has its other text within 2 * bound of its own nearest pivot at p:
    d(b, p) <= bound + d(a, p) <= bound + d(a, q) <= 2 * bound + d(b, q). Pivots are drawn by hash;
    each block of a region meets all pivots of the region and no other row.
    """
    bound = 1 - percent / 100
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    sized = rows.join(sizes, "region").withColumn("blocks", F.ceil(F.col("n") / REGION_ROWS).cast("int"))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    share = F.pmod(F.xxhash64("region", "doc_id"), F.lit(1 << 20)) * F.col("homes") < F.lit(PIVOTS << 20)
    pivots = sized.filter(F.col("home") & share)
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p_block")
    spread = pivots.select(F.col("region").alias("p_region"), block, F.col("doc_id").alias("pivot"), F.col("keys").alias("p_keys"))

    def assign(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        order = right.sort_values("pivot")
        names, sets = order["pivot"].tolist(), [_unsigned(k) for k in order["p_keys"]]
        out = []
        for doc, keys, home in zip(left["doc_id"], left["keys"], left["home"]):
            if not names:
                continue
            d = _distances(_unsigned(keys), sets)
            near = int(d.argmin())
            for j in np.flatnonzero(d <= d[near] + 2 * bound + 1e-9):
                out.append((int(key[0]), names[j], doc, bool(home and j == near)))
        return pd.DataFrame(out, columns=["region", "pivot", "doc_id", "home"])

    put = sized.select("region", "block", "doc_id", "keys", "home").groupBy("region", "block").cogroup(spread.groupBy("p_region", "p_block"))
    placed = pin(put.applyInPandas(assign, "region long, pivot long, doc_id long, home boolean"))
    cells = placed.groupBy("region", "pivot").agg(F.count(F.lit(1)).alias("cell"))
    totals = cells.groupBy("region").agg(F.sum("cell").alias("copies"), F.max("cell").alias("most"))
    good = pin(
        totals.join(sizes, "region").filter((F.col("copies") <= MOST_COPIES * F.col("n")) & (F.col("most") <= 0.7 * F.col("n"))).select("region")
    )
    moved = placed.join(good, "region").select("region", "pivot", "doc_id", F.col("home").alias("at_home"))
    cut = rows.join(moved, ["region", "doc_id"]).select(F.xxhash64("region", "pivot").alias("region"), "doc_id", "keys", F.col("at_home").alias("home"))
    return cut, rows.join(good, "region", "left_anti")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Regions that cannot be cut: every pair of blocks is a region of its own."""
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("keys")).alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") * 2 / REGION_ROWS), F.ceil(F.col("s") * 2 / REGION_SHINGLES)).cast("int")
    sized = rows.join(sizes, "region").withColumn("blocks", blocks).withColumn("x", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int"))
    each = sized.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select(F.xxhash64("region", F.least("x", "y"), F.greatest("x", "y")).alias("region"), "doc_id", "keys", "home")


def _region_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) for every text linked with a smaller one of its region, b the smallest it reaches there."""

    def flush(docs, sets, home):
        order = np.argsort(np.array(docs), kind="stable")
        docs = np.array(docs, np.int64)[order]
        root = joined_roots([sets[i] for i in order], np.array(home)[order], percent)
        moved = root != np.arange(len(docs))
        return docs[moved], docs[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, docs, sets, home, a, b = None, [], [], [], [], []
        for batch in batches:
            regions, ids, homes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            lists = batch.column(2)
            flat, ends = lists.values.to_numpy().view(_U), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                if regions[i] != region:
                    if len(docs) > 1:
                        got = flush(docs, sets, home)
                        a.append(got[0])
                        b.append(got[1])
                    region, docs, sets, home = regions[i], [], [], []
                docs.append(int(ids[i]))
                sets.append(flat[ends[i] : ends[i + 1]].copy())
                home.append(homes[i])
        if len(docs) > 1:
            got = flush(docs, sets, home)
            a.append(got[0])
            b.append(got[1])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    together = rows.select("region", "doc_id", "keys", "home").repartition("region").sortWithinPartitions("region")
    return together.mapInArrow(released(run), "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs(doc_id, text)``.

    A text's set holds its distinct runs of ``n`` words (all words as one run if fewer); two texts
    link when 100 * shared >= percent * union. ``component_id`` is the smallest doc_id reachable.
    Equal sets are one vertex with their smallest doc_id as name, so copies are never paired.

    Texts without words and null texts have an empty set and stay alone, as does a null doc_id; rows
    that repeat a doc_id are vertices of the same name; an empty table gives no rows; further columns
    are ignored.
    """
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = pin(_digests(ready, n))
    known = digests.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    names = pin(known.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    regions = _agreeing(ready.filter("doc_id IS NOT NULL"), n, percent)
    members = pin(names.join(regions, "h1").select("region", F.col("rep").alias("doc_id")))
    release(regions)
    links = _links(ready, members, n, percent)
    release(members)
    roots = components(links)
    # A doc_id that stands for several texts ties them together.
    tied = pin(known.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("doc_id"))
    if tied.limit(1).count():
        alike = known.join(tied, "doc_id").join(names, ["h1", "h2", "n_shingles"])
        roots = components(links.unionByName(alike.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    found = digests.join(names, ["h1", "h2", "n_shingles"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("root", "rep", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))


def _links(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of the members. Shingle sets are the bulk of what is written, so a table of them goes once the next one stands."""
    rows = pin(_sets(docs, members, n).withColumn("home", F.lit(True)))
    parts = []
    for step in range(9):
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("keys")).alias("s"))
        large = pin(sizes.filter((F.col("n") > REGION_ROWS) | (F.col("n") > 1) & (F.col("s") > REGION_SHINGLES)).select("region"))
        parts.append(pin(_region_links(rows.join(large, "region", "left_anti"), percent)))
        if not large.limit(1).count():
            break
        big = pin(rows.join(large, "region", "left_semi"))
        release(rows)
        if not step:
            rows = pin(_narrowed(big, percent))
            release(big)
            continue
        big = _partnered(big, percent)
        cut, rest = _cut(big, percent)
        parts.append(pin(_region_links(_in_blocks(rest), percent)))
        rows = pin(cut)
        release(cut)
    else:
        parts.append(pin(_region_links(_in_blocks(rows), percent)))
    release(rows)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return pin(out.distinct())


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The row of the smallest doc_id of every component, once; rows without a doc_id stay.

    Where several rows share that doc_id, the one with the smallest text stays, the null text last;
    equal rows are one. Texts without words are alone and stay. Only rows of repeated ids are
    grouped; the others are filtered by their id. An empty table gives no rows, and further columns
    come back as they are.
    """
    found = jaccard_components(docs, n, percent).filter("doc_id is not null")
    apart = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_z_rows"), F.min("component_id").alias("_z_root")).filter("_z_rows > 1 or doc_id <> _z_root")
    apart = pin(apart.select("doc_id", (F.col("doc_id") == F.col("_z_root")).alias("_z_stays")))
    release(found)
    marked = _marked(docs, apart)
    held = marked.filter("_z_likely").join(apart, "doc_id", "left")
    single = marked.filter("not _z_likely").select(*docs.columns).unionByName(held.filter("_z_stays is null").select(*docs.columns))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    ranked = [c for c, kind in docs.dtypes if c in rest and "map<" not in kind and kind != "variant"]  # those that have a hash
    least = F.min_by(F.struct("text", *rest), F.struct(F.col("text").isNull(), "text", F.xxhash64(F.lit(0), *ranked)))
    many = held.filter("_z_stays").groupBy("doc_id").agg(least.alias("_z_row")).select("doc_id", "_z_row.*").select(*docs.columns)
    return single.unionByName(many)
