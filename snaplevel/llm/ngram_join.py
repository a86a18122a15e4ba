"""Near duplicates by the Jaccard similarity of word n-grams: a grouped prefix join.

Sets that reach a similarity of t share a member among their rarest ones: of n members, any n - ceil(t n) + 1
(the prefix) meet those of a partner. The steps:

1. Every text becomes the set of its n-grams, as 64-bit hashes in numpy, and a 128-bit signature of the set.
   Equal sets are one class from here on; only signatures are kept.
2. N-grams in more than one in HOT of all documents are found by lossy counts (there are at most HOT times the
   mean set of them, so they are broadcast); they count as the most frequent. All others go, packed and by
   range of hash, to tasks that count in how many classes each occurs. Those in one class only need not come back.
3. A class with as many of those as its prefix is long has no partner. Most classes end here. The others know
   their members that can be shared, their prefix, and the place of each prefix member in it.
4. Classes with the same prefix and size are one group. Groups that share a prefix member are paired, if their
   sizes and the places of the member allow t; pairs of groups are expanded to their classes and verified.
5. A prefix member in more than DENSE classes would pair all of them. Classes that such members hold together
   form a cluster; they are verified against a few hubs of it first. Whatever this connects needs no further
   comparison, for components are asked for; the rest is compared in tiles, each pair of tiles in one task.

A verified link counts the common members of both classes, 52 or more bits of each hash (4 of 16 ranges and 48 packed). Every link is in a
component; no pair is capped or sampled away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplevel.llm.common import saved, small_batches, text_key
from snaplevel.llm.components import components
from snaplevel.llm.hashing import U64, mix, ngrams, word_groups

WORDS = 5
#: The least similarity is NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 75, 100
#: N-grams in one of so many documents are hot; error of the lossy counts as a share of that.
HOT, ERROR = 1000, 0.25
#: N-grams that one counting task holds, about; fewest ranges; documents that lossy counts take at a time.
AT_ONCE, RANGES, COUNTED_DOCS = 2_000_000, 16, 10_000
#: Classes that share a prefix member and are paired one by one; hubs of a cluster; classes of a tile.
DENSE, HUBS, TILE = 64, 8, 256


def sets_of(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of texts: first row, number of n-grams of each, their distinct hashes, text by text in order."""
    for row, stop, hashes, _, counts in word_groups(texts, lower=True):
        ends = np.cumsum(counts)
        starts = ends - counts
        grams = ngrams(hashes, words)
        owner = np.repeat(np.arange(stop - row), counts)
        whole = owner[: len(grams)] == owner[words - 1 : words - 1 + len(grams)] if len(grams) else np.zeros(0, bool)
        found, of = grams[whole], owner[: len(grams)][whole]
        short = np.flatnonzero((counts > 0) & (counts < words))
        if len(short):
            with np.errstate(over="ignore"):
                one = [ngrams(hashes[starts[k] : ends[k]], int(counts[k]))[0] + U64(counts[k]) for k in short]
                found, of = np.concatenate([found, mix(np.array(one, U64))]), np.concatenate([of, short])
        order = np.lexsort((found, of))
        found, of = found[order], of[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
        found, of = found[new], of[new]
        yield row, np.bincount(of, minlength=stop - row), found


def _signatures(sizes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed hashes for each set."""
    starts = np.cumsum(sizes) - sizes
    full = sizes > 0
    out = []
    with np.errstate(over="ignore"):
        for salt in (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)):
            total = np.zeros(len(sizes), U64)
            if full.any():
                total[full] = np.add.reduceat(mix(grams ^ salt), starts[full])
            out.append(mix(total + sizes.astype(U64)).view(np.int64))
    return out[0], out[1]


class _Counts:
    """Lossy counts of the n-grams of a task's documents."""

    def __init__(self):
        self.grams, self.counts, self.docs = np.zeros(0, U64), np.zeros(0, np.int64), 0
        self.waiting: list[np.ndarray] = []
        self.since = 0

    def add(self, parts: list[np.ndarray], docs: int) -> None:
        self.waiting += parts
        self.since += docs
        # Counted in large lots, for what a lot has once is left out.
        if self.since >= COUNTED_DOCS or sum(map(len, self.waiting)) >= AT_ONCE:
            self.settle()

    def settle(self) -> None:
        grams, counts = np.unique(np.concatenate(self.waiting or [self.grams[:0]]), return_counts=True)
        several = counts > 1
        grams = np.concatenate([self.grams, grams[several]])
        counts = np.concatenate([self.counts, counts[several]])
        grams, back = np.unique(grams, return_inverse=True)
        counts = np.bincount(back, counts, len(grams)).astype(np.int64)
        self.docs += self.since
        self.waiting, self.since = [], 0
        kept = counts > ERROR * self.docs / HOT
        self.grams, self.counts = grams[kept], counts[kept]


def _sign(words: int):
    names = ["doc_id", "key", "n", "s1", "s2", "gram", "count"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Counts()
        for batch in batches:
            sizes, s1, s2, all_grams = [], [], [], []
            for _, n, grams in sets_of(batch["text"], words):
                one, two = _signatures(n, grams)
                sizes.append(n), s1.append(one), s2.append(two), all_grams.append(grams)
            seen.add(all_grams, batch.num_rows)
            none = pa.nulls(batch.num_rows, pa.int64())
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (sizes, s1, s2)] if sizes else [none[:0]] * 3
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], *columns, none, none], names)
        seen.settle()
        for k in range(0, len(seen.grams), 10_000):
            grams, counts = seen.grams[k : k + 10_000].view(np.int64), seen.counts[k : k + 10_000]
            none, no_key = pa.nulls(len(grams), pa.int64()), pa.nulls(len(grams), pa.string())
            yield pa.RecordBatch.from_arrays([none, no_key, none, none, none, pa.array(grams), pa.array(counts)], names)

    return sign


def _index(words: int, bits: int, hot):
    """Classes (part < 0: owner, size, hot members by frequency) and packed members (part: of owners, in runs)."""
    names = ["part", "owner", "n", "hot", "members", "owners", "runs"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, place = hot.value
        seen: set[int] = set()
        codes = (frequent >> U64(16 - bits)).astype(np.int64)
        for batch in batches:
            kept_grams, kept_owner, rows = [], [], []
            for _, sizes, grams in sets_of(batch["text"], words):
                s1, _ = _signatures(sizes, grams)
                ends = np.cumsum(sizes)
                at = np.searchsorted(frequent, grams)
                is_hot = frequent[np.minimum(at, len(frequent) - 1)] == grams if len(frequent) else np.zeros(len(grams), bool)
                use = np.zeros(len(grams), bool)
                for k in np.flatnonzero(sizes):
                    key = int(s1[k])
                    if key in seen:
                        continue
                    seen.add(key)
                    mine = slice(int(ends[k] - sizes[k]), int(ends[k]))
                    which = at[mine][is_hot[mine]]
                    rows.append((key, int(sizes[k]), codes[which[np.argsort(place[which])]]))
                    use[mine] = ~is_hot[mine]
                kept_grams.append(grams[use])
                kept_owner.append(np.repeat(s1, sizes)[use])
            if not rows:
                continue
            m, nothing = len(rows), pa.nulls
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - r[0] % (1 << bits) for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), nothing(m, pa.binary()), nothing(m, pa.binary()), nothing(m, pa.binary())], names)
            grams, owner = np.concatenate(kept_grams), np.concatenate(kept_owner)
            part = (grams >> U64(64 - bits)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            grams, owner, part = grams[order], owner[order], part[order]
            rest = ((grams << U64(bits)) >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            edges = np.searchsorted(part, np.arange((1 << bits) + 1))
            for p in np.flatnonzero(np.diff(edges)):
                mine = slice(int(edges[p]), int(edges[p + 1]))
                of = owner[mine]
                begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                runs = np.diff(np.append(begin, len(of))).astype("<u4")
                row = [int(p), None, None, None, np.ascontiguousarray(rest[mine]).tobytes(), of[begin].tobytes(), runs.tobytes()]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return index


_INDEX = "part int, owner long, n long, hot array<long>, members binary, owners binary, runs binary"
_SHARED = "owner long, n long, hot array<long>, members array<long>, counts array<int>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed members, all of a part together, to those in several classes, by owner; classes as they are."""
    names = ["owner", "n", "hot", "members", "counts"]
    held: list[tuple] = []

    def counted(part: int):
        members, owners = [], []
        for packed, of, runs in held:
            rest = np.zeros((len(packed) // 6, 8), np.uint8)
            rest[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
            members.append(rest.view("<u8").ravel().astype(np.int64))
            owners.append(np.repeat(np.frombuffer(of, np.int64), np.frombuffer(runs, "<u4")))
        held.clear()
        members, owners = np.concatenate(members), np.concatenate(owners)
        order = np.lexsort((owners, members))
        members, owners = members[order], owners[order]
        del order
        new = np.append(True, (members[1:] != members[:-1]) | (owners[1:] != owners[:-1]))
        members, owners = members[new], owners[new]
        begin = np.flatnonzero(np.append(True, members[1:] != members[:-1]))
        size = np.diff(np.append(begin, len(members)))
        counts = np.repeat(size, size)
        several = counts > 1
        members, owners, counts = members[several] | (part << 48), owners[several], counts[several]
        order = np.argsort(owners, kind="stable")
        members, owners, counts = members[order], owners[order], counts[order]
        begin = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(owners) else np.zeros(0, np.int64)
        ends = pa.array(np.append(begin, len(owners)).astype(np.int32))
        m = len(begin)
        for k in range(0, m, 10_000):
            stop = min(m, k + 10_000)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x))[k:stop] for x in (members, counts.astype(np.int32))]
            none = [pa.nulls(stop - k, pa.int64()), pa.nulls(stop - k, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(owners[begin[k:stop]]), *none, *lists], names)

    now = None
    for batch in batches:
        part = batch["part"].to_numpy()
        classes = batch.filter(pa.array(part < 0))
        if classes.num_rows:
            m = classes.num_rows
            none = [pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([classes["owner"], classes["n"], classes["hot"], *none], names)
        for k in np.flatnonzero(part >= 0):
            if now is not None and part[k] != now:
                yield from counted(now)
            now = int(part[k])
            held.append(tuple(batch[c][int(k)].as_py() for c in ("members", "owners", "runs")))
    if held:
        yield from counted(now)


def prefix_length(n: Column) -> Column:
    return n - F.ceil(n * NUMERATOR / DENOMINATOR).cast("long") + 1


def candidates(shared: DataFrame) -> DataFrame:
    """Classes that can have a partner: owner, n, alone (members in no other class), members, prefix.

    Members are in the order that decides prefixes: by number of classes, hot ones last. Those in one class
    come before all of them and are known by their number alone.
    """
    pairs = F.when(F.col("members").isNotNull(), F.arrays_zip("counts", "members"))
    classes = shared.groupBy("owner").agg(
        F.max("n").alias("n"),
        F.array_sort(F.flatten(F.collect_list(pairs))).alias("some"),
        F.first("hot", ignorenulls=True).alias("hot"),
    )
    alone = (F.col("n") - F.size("some") - F.size("hot")).cast("long")
    classes = classes.withColumn("alone", alone).filter(F.col("alone") < prefix_length(F.col("n")))
    members = F.concat(F.transform("some", lambda x: x["members"]), "hot")
    length = (prefix_length(F.col("n")) - F.col("alone")).cast("int")
    classes = classes.select("owner", "n", "alone", members.alias("members"), length.alias("length"))
    return classes.withColumn("prefix", F.expr("slice(members, 1, length)")).drop("length")


def _similar(common: Column, n: Column, m: Column) -> Column:
    return common * DENOMINATOR >= (n + m - common) * NUMERATOR


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes those that are similar."""
    one = classes.select(F.col("owner").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("of_a"))
    two = classes.select(F.col("owner").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("of_b"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(_similar(common, F.col("n_a"), F.col("n_b"))).select("a", "b")


def _sizes_allow(n: Column, m: Column) -> Column:
    return (F.least(n, m) * DENOMINATOR) >= (F.greatest(n, m) * NUMERATOR)


def paired(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes whose groups share a prefix member that isn't dense, by size and place of the member."""
    of_group = postings.select("member", "group", "n", "at").distinct()
    a = of_group.select("member", F.col("group").alias("g"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    b = of_group.select("member", F.col("group").alias("h"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    n, m = F.col("n_a"), F.col("n_b")
    # The shared member and whatever follows it in both is all that they can have in common.
    at_most = F.least(n - F.col("at_a"), m - F.col("at_b"))
    groups = a.join(b, "member").filter(
        (F.col("g") < F.col("h")) & _sizes_allow(n, m) & _similar(at_most, n, m)
    )
    groups = groups.select("g", "h").distinct()
    within = postings.select("group", "owner").distinct().groupBy("group").count().filter("count > 1")
    groups = groups.unionByName(within.select(F.col("group").alias("g"), F.col("group").alias("h")))
    of = classes.select("group", "owner")
    pairs = groups.join(of.select(F.col("group").alias("g"), F.col("owner").alias("a")), "g")
    pairs = pairs.join(of.select(F.col("group").alias("h"), F.col("owner").alias("b")), "h")
    return pairs.filter("g != h or a < b").select("a", "b")


def _rooted(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Nodes (owner, ...) with the root of their component, themselves where they have no link."""
    roots = components(links).withColumnRenamed("root", name)
    joined = nodes.join(roots, nodes["owner"] == roots["node"], "left").drop("node")
    return joined.withColumn(name, F.coalesce(name, "owner"))


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of two tiles of classes, as few as connect what they connect."""
    for batch in batches:
        for k in range(batch.num_rows):
            one, two = batch["one"][k].as_py(), batch["two"][k].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in _forest(one, two)], ["a", "b"]
            )


def _forest(one: list[dict], two: list[dict]) -> tuple[list[int], list[int]]:
    sides = []
    for tile in (one, two):
        row = np.repeat(np.arange(len(tile)), [len(c["members"]) for c in tile])
        sides.append((np.concatenate([np.array(c["members"], np.int64) for c in tile]), row))
    both = np.intersect1d(sides[0][0], sides[1][0])
    common = np.zeros((len(one), len(two)), np.float32)
    for k in range(0, len(both), 8192):
        part = both[k : k + 8192]
        dense = []
        for (members, row), tile in zip(sides, (one, two), strict=True):
            at = np.minimum(np.searchsorted(part, members), len(part) - 1)
            hit = part[at] == members
            matrix = np.zeros((len(tile), len(part)), np.float32)
            matrix[row[hit], at[hit]] = 1
            dense.append(matrix)
        common += dense[0] @ dense[1].T
    n = np.array([c["n"] for c in one])[:, None]
    m = np.array([c["n"] for c in two])[None, :]
    left, right = np.nonzero(common * DENOMINATOR >= (n + m - common) * NUMERATOR)
    names = [c["owner"] for c in one], [c["owner"] for c in two]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    a, b = [], []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(names[0][i]), find(names[1][j])
        if x != y:
            root[x] = y
            a.append(names[0][i])
            b.append(names[1][j])
    return a, b


def dense_links(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """Links that connect what the classes with dense prefix members connect."""
    hub = postings.groupBy("member").agg(F.min("owner").alias("b"))
    held = components(postings.join(hub, "member").select(F.col("owner").alias("a"), "b"))
    cluster = held.select(F.col("node").alias("owner"), F.col("root").alias("cluster"))
    roots = held.select("root").distinct()
    cluster = cluster.unionByName(roots.select(F.col("root").alias("owner"), F.col("root").alias("cluster")))
    cluster = saved(classes.join(cluster, "owner").select("owner", "cluster", "n", "alone"), "clusters")
    # Those with the fewest members of their own are in the middle of a cluster.
    by = F.row_number().over(Window.partitionBy("cluster").orderBy("alone", F.xxhash64("owner"), "owner"))
    hubs = cluster.withColumn("nth", by).filter(F.col("nth") <= HUBS).select("cluster", F.col("owner").alias("b"), F.col("n").alias("m"))
    star = cluster.join(hubs, "cluster").filter((F.col("owner") != F.col("b")) & _sizes_allow(F.col("n"), F.col("m")))
    star = saved(verified(star.select(F.col("owner").alias("a"), "b"), classes), "star-links")

    nodes = saved(_rooted(cluster, star, "part"), "cluster-parts")
    large = nodes.groupBy("cluster", "part").count().filter(F.col("count") >= TILE // 2).select("cluster", "part", F.lit(True).alias("large"))
    nodes = nodes.join(large, ["cluster", "part"], "left")
    nodes = nodes.withColumn("part", F.when(F.col("large"), F.col("part")).otherwise(F.lit(None)))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(DENOMINATOR / NUMERATOR) + 1e-9).cast("int")
    nodes = nodes.select("owner", "cluster", "part", band.alias("band"))
    nodes = nodes.withColumn("of", F.xxhash64("cluster", "part", "band"))
    tiles = nodes.groupBy("of").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    number = F.pmod(F.xxhash64("owner", F.lit(1)), F.col("tiles"))
    dealt = nodes.join(tiles, "of").withColumn("tile", F.xxhash64("of", "cluster", "part", "band", number))
    dealt = dealt.select("owner", "cluster", "part", "band", "tile")
    key = ["tile", "cluster", "part", "band"]
    packed = dealt.join(classes, "owner").groupBy(*key).agg(F.collect_list(F.struct("owner", "n", "members")).alias("classes"))
    packed = saved(packed, "tiles")
    a = packed.select("cluster", F.col("tile").alias("t"), F.col("part").alias("p"), F.col("band").alias("x"))
    b = packed.select("cluster", F.col("tile").alias("u"), F.col("part").alias("q"), F.col("band").alias("y"))
    apart = F.col("p").isNull() | F.col("q").isNull() | (F.col("p") != F.col("q"))
    pairs = a.join(b, "cluster").filter((F.col("t") <= F.col("u")) & (F.abs(F.col("x") - F.col("y")) <= 1) & apart)
    pairs = pairs.join(packed.select(F.col("tile").alias("t"), F.col("classes").alias("one")), "t")
    pairs = pairs.join(packed.select(F.col("tile").alias("u"), F.col("classes").alias("two")), "u")
    return star.unionByName(pairs.select("one", "two").mapInArrow(_tile_links, "a long, b long"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
) -> DataFrame:
    """One row per document: doc_id, key, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A to Z in lower case. A document's set are its distinct
    runs of `words` words; with fewer words, the whole text as one. Documents whose sets have a Jaccard
    similarity of 0.75 or more are linked, and component_id is the smallest id that links reach, null
    aside. Null, empty and blank texts have no shingles and link with nothing: their component is their id.

    `key` tells rows of another id or text apart. Rows of one id and other texts are documents of their own,
    repeated rows are documents with equal sets. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        text_key(docs[id_column], docs[text_column]).alias("key"),
        F.coalesce(docs[text_column], F.lit("")).alias("text"),
    )
    signed = "doc_id long, key string, n long, s1 long, s2 long, gram long, count long"
    sets = saved(rows.mapInArrow(_sign(words), signed), "ngram-sets")
    n_docs, members = sets.agg(F.count("n"), F.sum("n")).first()
    least = max(DENSE, n_docs / HOT) * (1 - ERROR)
    hot = sets.groupBy("gram").agg(F.sum("count").alias("count")).filter((F.col("gram").isNotNull()) & (F.col("count") >= least))
    hot = hot.collect()  # see HOT for the bound
    grams = np.array([r["gram"] for r in hot], np.int64).view(U64)
    counts = np.array([r["count"] for r in hot], np.int64)
    order = np.argsort(grams)
    place = np.empty(len(grams), np.int64)
    place[np.lexsort((grams, counts))] = np.arange(len(grams))
    shared_hot = spark.sparkContext.broadcast((grams[order], place[order]))
    bits = min(15, math.ceil(math.log2(max(RANGES, (members or 0) / AT_ONCE))))

    index = rows.select("text").mapInArrow(_index(words, bits, shared_hot), _INDEX)
    shared = index.repartition(2 << bits, "part").sortWithinPartitions("part").mapInArrow(_count, _SHARED)
    classes = candidates(shared).withColumn("group", F.xxhash64("prefix", "n"))
    classes = saved(classes, "ngram-classes")
    postings = classes.select("owner", "n", "alone", "group", F.posexplode("prefix").alias("nth", "member"))
    postings = postings.withColumn("at", F.col("nth") + F.col("alone")).drop("nth")
    in_classes = postings.groupBy("member").agg(F.count("*").alias("in_classes")).filter("in_classes > 1")
    postings = saved(postings.join(in_classes, "member"), "ngram-postings")
    links = saved(verified(paired(postings.filter(F.col("in_classes") <= DENSE), classes), classes), "sparse-links")
    dense = postings.filter(F.col("in_classes") > DENSE)
    if not dense.isEmpty():
        links = links.unionByName(saved(dense_links(dense.select("member", "owner"), classes), "dense-links"))

    found = components(links)
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    of_class = sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"))
    of_class = of_class.join(found, of_class["s1"] == found["node"], "left")
    # A class without links is told apart by both halves of its signature.
    of_class = of_class.select("s1", "s2", "least", F.coalesce("root", "s1").alias("root"), F.when(F.col("root").isNull(), F.col("s2")).otherwise(0).alias("alone"))
    smallest = of_class.groupBy("root", "alone").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(smallest, ["root", "alone"]).select("s1", "s2", "component_id", F.lit(True).alias("some"))
    out = sets.filter("n is not null").join(of_class, ["s1", "s2"], "left")
    component = F.when((F.col("n") > 0) & F.col("some"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, one of each component: that with the smallest id, then key.

    Null ids come last. Rows equal in id and text are one document. Documents without shingles all stay.
    """
    ident, text = options.get("id_column", "doc_id"), options.get("text_column", "text")
    found = near_duplicates(docs, **options)
    by = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = found.filter("n_shingles > 0").groupBy("component_id").agg(F.min(by).alias("first")).select("first.key")
    kept = first.unionByName(found.filter("n_shingles = 0").select("key")).distinct()
    row = F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row")
    whole = docs.groupBy(text_key(docs[ident], docs[text]).alias("key")).agg(row)
    return whole.join(kept, "key").select("row.*")
