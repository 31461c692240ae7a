"""N-gram Jaccard join by rare-first prefix filtering, and the components of its links.

Method
------
1. One pass gives every text its shingle set's size and 128-bit digest, and counts all shingles of all
   texts in a table of ``2 ** sketch_bits`` cells (fixed size, so it can be broadcast). Equal sets are one
   *class* from here on; its node is the smallest doc_id.
2. *Rare first*: a set is ordered by (count of the shingle's cell, hash), the same order everywhere.
   Two sets with Jaccard similarity >= t share a shingle among the first ``n - ceil(t n) + 1`` of
   both, so only this prefix is posted under its shingles. A second pass posts it, for classes only.
3. Postings meet by shingle; those alone under theirs go at once. Shingles whose cell
   counts more than ``hot_cell`` occurrences are salted, so that no shingle fills a task.
4. Pairs that meet pass the *length* filter (sizes within t) and the *positional* filter (what is left of
   both sets after the common shingle can still reach the overlap needed), and are verified once a pair.
   Verification streams whole texts, grouped by one side; the *suffix* filter first bounds the overlap
   by the sizes of the sets' parts in 16 hash ranges, and then the sets are intersected.
5. To find components, a group of m near copies need not try its m * m / 2 pairs. First, each posting is
   paired with one random pivot of its shingle, then with others while components differ in so many
   pairs that this pays (``pivot_rounds``). At last, all pairs left that lie in different components and pass the filters
   are verified; one of the two is then outside the largest component under the shingle, so it is these
   few that are joined with the rest. They also have to pass the *bitmap* filter: a set's bitmap has a bit for each of 512 hash
   cells, set where the cell holds an odd number of its shingles, so two sets differ in at least as many shingles as their
   bitmaps do in bits. No pair in different components that could link stays unverified. The result is exact: no cap, no sampling.
6. Who wants the links themselves gets them from ``jaccard_links``: it verifies all pairs that pass the filters.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm.common import bounded_batches, by_bytes, give_back, stage, table
from priorwise.llm.components import connected_components
from priorwise.llm.registry import register
from priorwise.llm.shingles import set_digest, shingle_sets

_PARTS = 16
_BITS = [f"g{i}" for i in range(8)]  # the 512 bits of a set's bitmap, 64 a column
NO_ID = 1 << 62  # nodes of texts without an id lie from here on


def _frames(frames: Iterator[pd.DataFrame], limit: int = 2_000_000) -> Iterator[pd.DataFrame]:
    for f in frames:
        ends, size = [0], 0
        for i, t in enumerate(f["text"]):
            n = len(t) if t else 0
            if i > ends[-1] and size + n > limit:
                ends.append(i)
                size = 0
            size += n
        for a, b in zip(ends, [*ends[1:], len(f)]):
            if b > a:
                yield f.iloc[a:b]
    give_back()


def _node_id(doc_id: int, known: bool, digest: tuple[int, int]) -> int:
    """``known``: the row has an id (nulls travel as 0 beside it: a column of numbers and nulls would become fractions)."""
    return int(doc_id) if known else NO_ID | (digest[0] & (NO_ID - 1))


def _bitmap(s: np.ndarray) -> list[int]:
    """512 bits, set where a hash cell holds an odd number of the set's shingles."""
    cells = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=64 * len(_BITS))
    return np.packbits(cells & 1).view(np.int64).tolist()


def _profile(k: int, bits: int):
    """Task: (id, n, s1, s2) and bitmap of each text; at its end the counts of the task's shingles, in 16 parts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << bits, np.int64)
        mask = np.uint64((1 << bits) - 1)
        for f in _frames(frames):
            sets = list(shingle_sets(list(f["text"]), k))
            counts += np.bincount((np.concatenate(sets) & mask).astype(np.int64), minlength=1 << bits) if sets else 0
            rows = []
            for doc_id, known, s in zip(f["id"], f["known"], sets):
                d = set_digest(s)
                rows.append((_node_id(doc_id, known, d), len(s), *d, *_bitmap(s), None, None))
            yield pd.DataFrame(rows, columns=["id", "n", "s1", "s2", *_BITS, "part", "counts"]).astype({"part": "Int32"})
        parts = np.split(counts, _PARTS)
        yield pd.DataFrame({"id": 0, "n": 0, "s1": 0, "s2": 0, **dict.fromkeys(_BITS, 0), "part": range(_PARTS),
                            "counts": [zlib.compress(p.tobytes(), 1) for p in parts]}).astype({"part": "Int32"})

    return run


def _add_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum the counts of each part; rows come sorted by part."""
    sums: dict[int, np.ndarray] = {}
    for f in frames:
        for part, packed in zip(f["part"], f["counts"]):
            add = np.frombuffer(zlib.decompress(packed), np.int64)
            sums[part] = sums[part] + add if part in sums else add
    if sums:
        yield pd.DataFrame({"part": list(sums), "counts": [zlib.compress(v.tobytes(), 1) for v in sums.values()]})


def _prefixes(k: int, percent: int, counts, hot_cell: int):
    """Task: (id, s1, n, tokens, salts) with the rare-first prefix of each set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = counts.value
        mask = np.uint64(len(cells) - 1)
        for f in _frames(frames):
            rows = []
            for doc_id, known, s in zip(f["id"], f["known"], shingle_sets(list(f["text"]), k)):
                n = len(s)
                if not n:
                    continue
                d = set_digest(s)
                count = cells[(s & mask).astype(np.int64)]
                first = np.argsort(count, kind="stable")[:n + (-percent * n // 100) + 1]  # ties: hash order
                node, count = _node_id(doc_id, known, d), count[first]
                salts = np.where(count > hot_cell, (d[1] & 0xFFFFFF) % (count // hot_cell + 1), -1)
                rows.append((node, d[0], n, s[first].view(np.int64), salts.astype(np.int32)))
            if rows:
                yield pd.DataFrame(rows, columns=["id", "s1", "n", "tokens", "salts"])

    return run


def _overlap(n1: Column, n2: Column, percent: int) -> Column:
    """Least intersection of two sets that link."""
    return F.ceil((n1 + n2) * percent / F.lit(100 + percent))


def _promising(a: str, b: str, percent: int) -> Column:
    """Length and positional filter of postings ``a`` and ``b`` (sizes n, places pos)."""
    n1, n2, p1, p2 = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    return ((F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent)
            & (F.least(n1 - p1, n2 - p2) * (100 + percent) >= (n1 + n2) * percent))


def _near(a: str, b: str, percent: int) -> Column:
    """Bitmap filter of ``a`` and ``b``: they may differ in no more shingles than two sets of their sizes that link."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = reduce(add, [F.bit_count(F.col(f"{a}.{g}").bitwiseXOR(F.col(f"{b}.{g}"))) for g in _BITS])
    return differ <= n1 + n2 - 2 * _overlap(n1, n2, percent)


def _verify(k: int, percent: int):
    """Task: rows sorted by (left, salt, kind); kind 0 is a text of left, kind 1 a text of right."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, sets = None, []
        for f in _frames(frames):
            links = []
            for here, kind, right, s in zip(f["left"], f["kind"], f["right"], shingle_sets(list(f["text"]), k)):
                parts = np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=16)
                if here != left:
                    left, sets = here, []
                if kind == 0:
                    sets.append((s, parts))
                    continue
                for t, other in sets:
                    total = len(s) + len(t)
                    need = -(-total * percent // (100 + percent))
                    if total - int(np.abs(parts - other).sum()) < 2 * need:  # suffix filter
                        continue
                    at = np.searchsorted(t, s)
                    at[at == len(t)] = 0
                    if int((t[at] == s).sum()) >= need:
                        links.append((left, right))
                        break
            yield pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


class _Verifier:
    """Verifies pairs (left, right) of nodes once each; texts are a table bucketed by node."""

    def __init__(self, texts: DataFrame, k: int, percent: int):
        self.spark, self.k, self.percent = texts.sparkSession, k, percent
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.texts = f"jaccard_texts_{uuid.uuid4().hex[:12]}"
        texts.repartition(self.buckets, "node").write.bucketBy(self.buckets, "node").sortBy("node").saveAsTable(self.texts)
        self.seen: DataFrame | None = None  # pairs verified so far

    def links(self, pairs: DataFrame, group: int = 256) -> DataFrame:
        """Those of the pairs that link, as (u, v). ``group``: about so many rights a group of texts."""
        pair = [F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")]
        once = pairs.groupBy(*pair).agg(F.min("left").alias("left"))
        if self.seen is not None:
            once = once.join(self.seen, ["a", "b"], "left_anti")
        new = stage(once, "jaccard-pairs")
        seen = new.select("a", "b")
        self.seen = seen if self.seen is None else self.seen.unionByName(seen)
        pairs = new.select("left", F.when(F.col("left") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("right"))
        many = pairs.groupBy("left").agg(F.ceil(F.count(F.lit(1)) / group).alias("salts"))
        salted = pairs.join(many, "left").withColumn("salt", F.pmod(F.xxhash64("right"), "salts"))
        texts = self.spark.table(self.texts)
        rights = salted.join(texts.withColumnRenamed("node", "right"), "right") \
            .select("left", "salt", F.lit(1).alias("kind"), "right", "text")
        lefts = many.select("left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")) \
            .join(texts.withColumnRenamed("node", "left"), "left") \
            .select("left", "salt", F.lit(0).alias("kind"), F.col("left").alias("right"), "text")
        grouped = lefts.unionByName(rights).repartition(self.buckets, "left", "salt") \
            .sortWithinPartitions("left", "salt", "kind")
        return stage(grouped.mapInPandas(_verify(self.k, self.percent), "u long, v long"), "jaccard-links")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.texts} PURGE")


def _pivots(postings: DataFrame, pivots: int, percent: int) -> DataFrame:
    """Each posting with one of ``pivots`` random pivots of its shingle, where their components differ."""
    seed = F.pmod("token", F.lit(pivots))
    whole = F.struct(F.xxhash64("node", seed).alias("at"), "node", "n", "pos", "comp")
    pivot = postings.groupBy("token").agg(F.min(whole).alias("p"))
    return postings.alias("x").join(pivot, "token") \
        .where((F.col("p.comp") != F.col("x.comp")) & _promising("p", "x", percent)) \
        .select(F.col("p.node").alias("left"), F.col("x.node").alias("right"))


def _straggling(postings: DataFrame) -> int:
    """Upper bound of the pairs that ``_stragglers`` meets."""
    sizes = postings.groupBy("token", "comp").count().groupBy("token") \
        .agg(F.sum("count").alias("all"), F.max("count").alias("top"))
    return sizes.agg(F.sum((F.col("all") - F.col("top")) * F.col("all"))).first()[0] or 0


def _stragglers(postings: DataFrame, bitmaps: DataFrame, percent: int, look_back: int = 32) -> DataFrame:
    """All promising pairs in different components with near bitmaps: at least one is outside its shingle's largest component.

    An id with several texts of one size has all their bitmaps on each of its postings."""
    sizes = postings.groupBy("token", "comp").count()
    top = sizes.groupBy("token").agg(F.max(F.struct("count", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")) \
        .where("comps > 1").select("token", F.col("top.comp").alias("top"))
    # each posting with the shingles just before it in its prefix: a pair that has one of them in common meets there as well, where the
    # filters let through what they let through here, so it is passed over here; at its first common shingle it never is
    earlier = F.expr(f"collect_list(token) OVER (PARTITION BY node, n ORDER BY pos ROWS BETWEEN {look_back} PRECEDING AND 1 PRECEDING)")
    live = stage(postings.join(top, "token").withColumn("earlier", earlier).join(bitmaps, ["node", "n"]), "jaccard-live")
    few = live.where("comp <> top").alias("s")
    return few.join(live.alias("x"), F.col("s.token") == F.col("x.token")) \
        .where((F.col("s.comp") != F.col("x.comp")) & _promising("s", "x", percent) & _near("s", "x", percent)
               & ((F.col("x.comp") == F.col("x.top")) | (F.col("s.node") < F.col("x.node")))
               & ~F.arrays_overlap("s.earlier", "x.earlier")) \
        .select(F.col("s.node").alias("left"), F.col("x.node").alias("right"))


def _posted(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, sketch_bits: int,
            hot_cell: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, _Verifier]:
    """Steps 1 to 3: profiles of the rows, classes, their bitmaps, postings of the classes' prefixes, and the verifier of pairs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = F.col(f"`{id_col}`").cast("long")
    base = docs.select(F.coalesce(ids, F.lit(0).cast("long")).alias("id"), ids.isNotNull().alias("known"), F.col(f"`{text_col}`").alias("text"))

    staged = stage(base.mapInPandas(_profile(k, sketch_bits),
                                    f"id long, n long, s1 long, s2 long, {', '.join(f'{g} long' for g in _BITS)}, part int, counts binary"),
                   "jaccard-profiles")
    packed = staged.where("part IS NOT NULL").select("part", "counts").repartition(_PARTS, "part") \
        .mapInPandas(_add_counts, "part int, counts binary").collect()  # 2 ** sketch_bits numbers
    cells = {r["part"]: np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in packed}
    counts = spark.sparkContext.broadcast(np.concatenate([cells[p] for p in range(_PARTS)]) if cells
                                          else np.zeros(1 << sketch_bits, np.int64))
    profiles = staged.where("part IS NULL").select("id", "n", "s1", "s2")
    mapped = stage(staged.where("part IS NULL AND n > 0").groupBy("s1", "s2")
                   .agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in ("n", *_BITS)]), "jaccard-classes")  # equal sets: equal n and bitmaps
    classes, bitmaps = mapped.select("s1", "s2", "node"), mapped.select("node", "n", *_BITS)

    prefixes = base.mapInPandas(_prefixes(k, percent, counts, hot_cell),
                                "id long, s1 long, n long, tokens array<long>, salts array<int>")
    posted = prefixes.join(classes.select(F.col("node").alias("id"), "s1"), ["id", "s1"], "left_semi") \
        .select(F.col("id").alias("node"), "n", F.posexplode(F.arrays_zip("tokens", "salts")).alias("pos", "t")) \
        .select("node", "n", "pos", F.col("t.tokens").alias("token"), F.col("t.salts").alias("salt"))
    met = F.expr("count(1) OVER (PARTITION BY token, salt)")
    postings = stage(posted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token", "salt")
                     .withColumn("met", met).where("met > 1 OR salt >= 0")
                     .select("token", "node", "n", F.col("pos").cast("long").alias("pos")), "jaccard-postings")

    nodes = postings.select("node").distinct()
    ids = base.where("known").select(F.col("id").alias("node"), "text")
    no_ids = base.where("NOT known").select("text").mapInPandas(_nodes_of(k), "node long, text string")
    verifier = _Verifier(ids.unionByName(no_ids).join(nodes, "node", "left_semi"), k, percent)
    return profiles, classes, bitmaps, postings, verifier


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85,
                       sketch_bits: int = 20, hot_cell: int = 50_000, pivot_rounds: tuple[int, ...] = (1, 8, 16, 32)) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id reachable by links; links: Jaccard >= percent / 100).

    Defined results: null and empty texts, and texts without words, have no shingles and are their own
    component; rows that repeat an id are one document, linked by any of its texts; a row without
    an id takes part, and its component_id is the least id among those it reaches, null if none;
    an empty table gives no rows. Ids are integers below 2**62.
    """
    profiles, classes, bitmaps, postings, verifier = _posted(docs, id_col, text_col, k, percent, sketch_bits, hot_cell)

    # an id with several texts ties their classes together
    several = profiles.where("n > 0").join(classes, ["s1", "s2"]).where("id <> node").select(F.col("id").alias("u"), F.col("node").alias("v")) \
        .join(classes.select(F.col("node").alias("u")), "u", "left_semi")
    comps = connected_components(several, "jaccard-components")
    total = postings.count()
    for step, pivots in enumerate([*pivot_rounds, 0]):
        labelled = stage(postings.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "jaccard-labelled")
        last = not pivots or step and _straggling(labelled) <= 4 * total
        links = verifier.links(_stragglers(labelled, bitmaps, percent) if last else _pivots(labelled, pivots, percent))
        if not links.isEmpty():
            known = comps.select(F.col("node").alias("u"), F.col("comp").alias("v"))
            comps = connected_components(known.unionByName(links), "jaccard-components")
        if last:
            break
    verifier.close()

    own = F.when(F.col("id") < NO_ID, F.col("id"))
    root = F.coalesce("comp", "node")
    linked = profiles.where("n > 0").join(classes, ["s1", "s2"]).join(comps, "node", "left") \
        .select(own.alias(id_col), F.col("n").alias("n_shingles"), F.when(root < NO_ID, root).alias("component_id"))
    alone = profiles.where("n = 0").select(own.alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
    return linked.unionByName(alone)


def _all_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """All promising pairs, whatever their components."""
    return postings.alias("s").join(postings.alias("x"), F.col("s.token") == F.col("x.token")) \
        .where((F.col("s.node") < F.col("x.node")) & _promising("s", "x", percent)) \
        .select(F.col("s.node").alias("left"), F.col("x.node").alias("right"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85,
                  sketch_bits: int = 20, hot_cell: int = 50_000) -> DataFrame:
    """Per row: id, n_shingles, class_id, n_links: how many other classes its class links with (Jaccard >= percent / 100).

    The whole join, without the shortcut by components: all candidate pairs of class representatives are verified, so its work
    grows with the links there are. Equal sets are one class, named by its least id (null if no row of it has one);
    an id with several texts ties their classes into one, linked by any of the texts. Rows without shingles are
    classes of their own without links; an empty table gives no rows.
    """
    profiles, classes, _, postings, verifier = _posted(docs, id_col, text_col, k, percent, sketch_bits, hot_cell)
    named = profiles.where("n > 0").join(classes, ["s1", "s2"])
    ties = connected_components(named.where(f"id < {NO_ID}").select(F.col("id").alias("u"), F.col("node").alias("v")), "jaccard-ties")
    found = verifier.links(_all_pairs(postings, percent))
    for side in ("u", "v"):
        found = found.join(ties.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_class")), side, "left")
    found = found.select(*[F.coalesce(f"{x}_class", x).alias(x) for x in "uv"]).where("u <> v") \
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    degree = stage(found.select(F.explode(F.array("u", "v")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links")),
                   "jaccard-degrees")
    verifier.close()
    own = F.when(F.col("id") < NO_ID, F.col("id"))
    linked = named.join(ties, "node", "left").withColumn("class", F.coalesce("comp", "node")).join(degree, "class", "left") \
        .select(own.alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("class") < NO_ID, F.col("class")).alias("class_id"),
                F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    alone = profiles.where("n = 0").select(own.alias(id_col), F.col("n").alias("n_shingles"), own.alias("class_id"),
                                           F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def _nodes_of(k: int):
    """Task: node and text of rows without an id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _frames(frames):
            nodes = [_node_id(0, False, set_digest(s)) for s in shingle_sets(list(f["text"]), k)]
            yield pd.DataFrame({"node": nodes, "text": list(f["text"])})

    return run


@register("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@register("jaccard_links")
def q_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, class and number of links of every document."""
    return jaccard_links(table(spark, sf_dir, "documents"))
