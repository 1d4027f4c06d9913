"""Document fingerprints from spot signatures, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from zonewise.session import pin

# Common words of four languages that anchor a signature.
ANCHORS = """
the of and to a in is that it for on was with be as this by are at from or an not have has but they which
de la le et les des en un que du une pour dans est qui par au sur pas avec ce il se ne
el y los del las por con no una su para es al lo como
der die und den von zu das mit sich auf für ist im nicht dem eine ein er als auch
""".split()
CHAIN = 2  # content words in a signature
APART = 1  # content words from one to the next
WORD = r"[\p{L}\p{N}]+"
_GLUE = "\u0001"


def _bind(value: Column, use) -> Column:
    """``use`` of ``value`` computed once per row, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signatures(text: Column, anchors=tuple(ANCHORS), chain: int = CHAIN, apart: int = APART) -> Column:
    """Sorted distinct 32-bit hashes of a text's spot signatures.

    A run of anchor words and the ``chain`` content words after it, ``apart`` steps from one to the
    next, make a signature; at the end of the text a chain is shorter. A text with words but without
    an anchor has one signature, of all its words; null, empty and wordless texts have none.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    marked = F.transform(found, lambda w: F.concat(w, F.when(w.isin(*anchors), _GLUE).otherwise(" ")))
    # A content word now carries the anchors before it; the last entry is empty or a run of anchors.
    entries = F.split(F.array_join(marked, ""), " ")

    def spots(e: Column) -> Column:
        bare = F.transform(e, lambda x: F.substring_index(x, _GLUE, -1))

        def of(b: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda j: F.contains(F.get(e, j), F.lit(_GLUE)))
            made = F.transform(at, lambda j: F.hash(F.get(e, j), *[F.get(b, j + i * apart) for i in range(1, chain)]))
            words = F.array_join(e, " ")
            whole = F.when(words == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(words)))
            return _bind(F.sort_array(F.array_distinct(made)), lambda s: F.when(F.size(s) > 0, s).otherwise(whole))

        return _bind(bare, of)

    return _bind(entries, spots)


def fingerprint(spots: Column) -> Column:
    """Eight hex digits for every signature, in order."""
    return F.array_join(F.transform(spots, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text``, its ``spots``, and ``next_text``, ``next_spots`` of the next row by ``key``.

    Keys are dealt to ranges by quantiles of all keys, so rows of a range meet in one exchange. The
    successor of a range's last row is the head of the next range; heads are as many as ranges. Null
    keys come first, equal keys are ordered by text, and the last row is followed by the smallest key.
    """
    ranges = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    edges = sorted(set(docs.agg(F.percentile_approx(key, shares, 10_000)).first()[0] or []))
    width = max(1, round(len(edges) ** 0.5))
    groups = [edges[i : i + width] for i in range(0, len(edges), width)]
    # Two short searches instead of one through all edges.
    firsts = F.array(*[F.lit(g[0]) for g in groups]).cast("array<long>")
    nested = F.array(*[F.array(*[F.lit(e) for e in g]) for g in groups]) if groups else F.array(F.array(F.lit(0)))
    k = F.col("_z_key")
    coarse = F.size(F.filter(firsts, lambda e: e <= k))
    fine = F.size(F.filter(F.get(nested, F.col("_z_coarse") - 1), lambda e: e <= k))
    bucket = F.when(F.col("_z_coarse") > 0, (F.col("_z_coarse") - 1) * width + fine).otherwise(0)
    keys = docs.select(F.col(key).alias("_z_key"), F.coalesce(F.col(text), F.lit("")).alias("_z_text"))
    dealt = keys.withColumn("_z_coarse", F.coalesce(F.when(k.isNotNull(), coarse), F.lit(0))).withColumn("_z_bucket", bucket).drop("_z_coarse")
    order = W.partitionBy().orderBy("_z_bucket")
    heads = dealt.filter("_z_key is not null").groupBy("_z_bucket").agg(F.min("_z_key").alias("_z_head"))
    first = heads.agg(F.min("_z_head")).first()[0]
    heads = pin(
        heads.select(
            F.col("_z_bucket").alias("_z_b"), F.coalesce(F.lead("_z_head").over(order), F.lit(first).cast("long")).alias("_z_follows")
        )
    )
    # Every bucket with rows needs a follower, also one that holds null keys only.
    if not heads.filter("_z_b = 0").limit(1).count():
        heads = heads.unionByName(docs.sparkSession.range(1).select(F.lit(0).alias("_z_b"), F.lit(first).cast("long").alias("_z_follows")))
    wanted = heads.select(F.col("_z_follows").alias("_z_key")).distinct()
    head_text = keys.join(wanted, "_z_key", "left_semi").groupBy("_z_key").agg(F.min("_z_text").alias("_z_text"))
    followers = heads.join(
        head_text.select(F.col("_z_key").alias("_z_follows"), F.struct("_z_text", signatures(F.col("_z_text")).alias("_z_spots")).alias("_z_after")), "_z_follows", "left"
    ).drop("_z_follows")
    within = W.partitionBy("_z_bucket").orderBy("_z_key", "_z_text")
    own = dealt.withColumn("_z_spots", signatures(F.col("_z_text"))).withColumn("_z_next", F.lead(F.struct("_z_text", "_z_spots")).over(within))
    met = own.join(pin(followers), F.col("_z_bucket") == F.col("_z_b"), "left").withColumn("_z_next", F.coalesce("_z_next", "_z_after"))
    itself = F.struct("_z_text", "_z_spots")  # only null keys: no row has a follower
    met = met.withColumn("_z_next", F.coalesce("_z_next", itself))
    return met.select(
        k.alias(key),
        F.col("_z_text").alias(text),
        F.col("_z_spots").alias("spots"),
        F.col("_z_next._z_text").alias("next_text"),
        F.col("_z_next._z_spots").alias("next_spots"),
    )


def half_edited(text: Column, following: Column) -> Column:
    """``text`` whose last half is replaced by as many code points, or all, of ``following``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def near_classes(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (``key``, ``rep``) and the pairs (``a``, ``b``, ``likeness``) between representatives.

    Equal signature sets are one class with its smallest key. Classes are partitioned by set length:
    a set meets its own length class and the next one. Inside, signatures are taken rarest first and
    only as many of them are indexed as a pair of the wanted likeness cannot avoid sharing. Pairs are
    then compared exactly. Empty sets and null keys form no pair.
    """
    sets = docs.select(F.col(key).alias("k"), signatures(F.col(text)).alias("s"))
    named = pin(sets.withColumn("f", F.xxhash64("s")))
    reps = named.filter("k is not null and size(s) > 0").groupBy("s", "f").agg(F.min("k").alias("rep"))
    reps = pin(reps)
    member = named.join(reps.select("s", "f", "rep"), ["f", "s"], "left").select(F.col("k").alias(key), F.coalesce("rep", "k").alias("rep"))
    each = reps.select("rep", F.size("s").alias("n"), F.explode("s").alias("x"))
    rare = each.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(rare, "x").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("o"))
    length = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    prefix = F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)) + 1).cast("int"))
    index = pin(ordered.select("rep", "n", length.alias("class"), F.explode(F.transform(prefix, lambda p: p["x"])).alias("x")))
    left = index.select(F.col("rep").alias("a"), F.col("n").alias("an"), "x", F.explode(F.array("class", F.col("class") + 1)).alias("at"), "class")
    right = index.select(F.col("rep").alias("b"), F.col("n").alias("bn"), "x", F.col("class").alias("at"))
    # One set may meet the other from its own class or from the class below.
    met = left.join(right, ["x", "at"]).filter((F.col("a") < F.col("b")) | (F.col("class") < F.col("at")))
    fits = F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent
    found = met.filter(fits & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sa, sb = reps.select(F.col("rep").alias("a"), F.col("s").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    exact = found.join(sa, "a").join(sb, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return member, exact.filter(F.col("likeness") >= percent / 100)
