"""Exact Jaccard self-join of word-shingle sets as a metric-space join.

The distance of two documents is one minus the Jaccard similarity of their sets of five-word
shingles, which is a metric; documents within the radius r = 1 - threshold link.

1. Copies.  Documents with one and the same set are one point; the join runs on points.  Of a set
   with more than ``COPIES`` rows only one row is read again; fewer are folded where they meet.
2. Points that can link.  Of a point within r of another at least the share ``threshold`` of the
   shingles occur in a second point too.  Shingles are counted in buckets of their hash
   (a task first folds what its own points share, so a common shingle is sent once
   by each task); points with fewer shared shingles are done.
3. First Voronoi level.  Pivots are single shingles, in order of rarity; a point's home is the
   pivot of its rarest shingle.  A point that misses more than r of its own set before it
   reaches a pivot is further than r from all points at home there, so its window of
   boundary regions ends there.  The distance to the empty set gives a second window: only
   sizes within the threshold share a region.  The regions in which one and the same
   point has the smallest number are joined together, as one cluster of that point.
4. Recursion.  In a cluster documents are the pivots.  Everything within r of a pivot is its core
   (linked through the pivot, so pairs in a core need no look), everything within 2r its
   boundary.  If x lies in the core of p and y links to x, then d(y, p) <= 2r, so each link
   meets in a region; a region is joined only for boundary points of another component,
   and only inside the window |d(x, p) - d(y, p)| <= r.  Clusters of up to ``LEAF`` points and
   ``LEAF_IDS`` shingles are solved by one task each; larger ones take the same steps as Spark jobs over chunks,
   round by round until every point is in a core.

Identity of a shingle is a 48-bit hash: two given documents disagree with the exact count with a
probability of about 1e-9.  Edge cases: null ids are ids like others (a component of only null ids
has a null id); null, empty and blank texts have an empty set and link with nothing; with fewer
words than five the whole sequence is one shingle; repeated rows give repeated result rows; an
empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.llm.common import doc_bytes, fold_ascii, keep, mix, span_hashes, table, unused, word_spans

WORDS = 5
PERCENT = 80
#: Points, and shingles of theirs, that one task may join on its own; points of a chunk and pivots of a round in a larger cluster.
LEAF = 4_096
LEAF_IDS = 4_000_000
CHUNK = 1_024
PIVOTS = 96
#: Shingles that a task gathers before it sends them, and that a counting task gets on average.
SEND = 1_000_000
COUNT = 2_500_000
#: Rows with one and the same set that are folded on the way; of more, one is chosen before.
COPIES = 64
ID_BITS = 48
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct ids of its shingles."""
    for _, _, data, offsets in doc_bytes(texts):
        data = fold_ascii(data)
        starts, ends, edge = word_spans(data, offsets)
        word = span_hashes(data, starts, ends)
        run = word.copy()
        for t in range(1, words):
            run[:-t] = run[:-t] * _STEP + word[t:] if t < len(word) else run[:-t]
        run = mix(run) >> np.uint64(64 - ID_BITS)
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if e - s >= words:
                yield np.unique(run[s : e - words + 1])
            elif e > s:
                digest = hashlib.blake2b(word[s:e].tobytes(), digest_size=8).digest()
                yield np.frombuffer(digest, np.uint64) >> np.uint64(64 - ID_BITS)
            else:
                yield np.zeros(0, np.uint64)


def digest(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.tobytes(), digest_size=16).digest()


def set_keys(docs: DataFrame, words: int) -> DataFrame:
    """(id, body, set, n): digest of the set and its size for each row."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("body", T.StringType()), T.StructField("set", T.BinaryType()), T.StructField("n", T.LongType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(digest(s), len(s)) for s in shingle_sets(batch.column(2), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d for d, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], schema.names)

    return docs.select("id", "body", "text").mapInArrow(keyed, schema)


def _packed(ids: np.ndarray) -> bytes:
    """48-bit ids in six bytes each."""
    return (ids & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (ids >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) | np.frombuffer(blob, np.uint16, n, n * 4).astype(np.uint64) << np.uint64(32)


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of every run of equal keys."""
    if not len(keys):
        return []
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def shared_shingles(docs: DataFrame, words: int, buckets: int, percent: int) -> DataFrame:
    """(set, ids): of each point the shingles that occur in another point too, if they are at least the share
    ``percent`` of its set.  Counting tasks get the shingles of a range of ids, and answer in one row
    for each of as many bins of points."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "owners", "counts", "ids"]
        sets: dict[bytes, np.ndarray] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            owners, lists = list(sets), list(sets.values())
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            ids = np.concatenate(lists)
            order = np.argsort(ids)
            ranked = ids[order]
            twice = np.zeros(len(ids), bool)
            same = ranked[1:] == ranked[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            several = np.zeros(len(ids), bool)
            several[order] = twice
            rows: list[tuple] = []
            for part, who in ((ids[~several], owner[~several]), (np.unique(ids[several]), None)):
                bucket = (part * np.uint64(buckets) >> np.uint64(ID_BITS)).astype(np.int64) if buckets < 1 << 16 else (part >> np.uint64(16)).astype(np.int64) * buckets >> 32
                by = np.argsort(bucket, kind="stable")
                for s, e in runs(bucket[by]):
                    at = by[s:e]
                    if who is None:
                        rows.append((int(bucket[at[0]]), b"", b"", _packed(part[at])))
                    else:
                        u, c = np.unique(who[at], return_counts=True)  # ids of a bucket lie in order of owner
                        rows.append((int(bucket[at[0]]), b"".join(owners[k] for k in u), c.astype(np.uint32).tobytes(), _packed(part[at])))
            mine = np.flatnonzero(several)
            edge = np.searchsorted(owner[mine], np.arange(len(owners) + 1))
            for k in range(len(owners)):  # known to be shared already: passed on as they are
                if edge[k] < edge[k + 1]:
                    told = ids[mine[edge[k] : edge[k + 1]]]
                    rows.append((-1 - bin_of(owners[k]), owners[k], np.uint32([len(told)]).tobytes(), _packed(told)))
            for k in range(len(owners)):  # and the size of its set
                rows.append((-1 - bin_of(owners[k]), owners[k], np.uint32([len(lists[k])]).tobytes(), b""))
            for s in range(0, len(rows), 2000):
                columns = zip(*rows[s : s + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

        for batch in batches:
            for ids in shingle_sets(batch.column(0), words):
                if len(ids) and (key := digest(ids)) not in sets:
                    sets[key] = ids
                    held += len(ids)
                    if held >= SEND:
                        yield from flush()
                        sets, held = {}, 0
        if sets:
            yield from flush()

    def answer(bins: list[int], owners: list[bytes], counts: list[bytes], ids: list[bytes]) -> pa.Table:
        return pa.table({"bin": pa.array(bins, pa.int64()), "owners": pa.array(owners, pa.binary()), "counts": pa.array(counts, pa.binary()), "ids": pa.array(ids, pa.binary())})

    def counted(group: pa.Table) -> pa.Table:
        rows = [group.column(c).to_pylist() for c in ("owners", "counts", "ids")]
        bucket = group.column("bucket")[0].as_py()
        if bucket < 0:  # what the points' own tasks knew passes through
            told = [i for i, blob in enumerate(rows[2]) if blob]
            size = [i for i, blob in enumerate(rows[2]) if not blob]
            joined = [[b"".join(row[i] for i in at) for row in rows] for at in (told, size)]
            ids = np.concatenate([_unpacked(rows[2][i]) for i in told]) if told else np.zeros(0, np.uint64)
            return answer([-1 - bucket] * 2, [j[0] for j in joined], [j[1] for j in joined], [ids.tobytes(), b""])
        ids = np.concatenate([_unpacked(x) for x in rows[2]])
        owners = b"".join(rows[0])
        entry: list[np.ndarray] = []
        at = 0
        for own, count, blob in zip(*rows, strict=True):
            n = len(own) // 16
            entry.append(np.repeat(np.arange(at, at + n), np.frombuffer(count, np.uint32)) if n else np.full(len(blob) // 6, -1))
            at += n
        who = np.concatenate(entry)
        short = np.frombuffer(owners, np.uint64)[::2] if owners else np.zeros(0, np.uint64)
        order = np.argsort(ids)
        ids, who = ids[order], who[order]
        cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        name = np.where(who >= 0, short[who], 0) if len(short) else np.zeros(len(who), np.uint64)
        shared = (np.minimum.reduceat(name, cut) != np.maximum.reduceat(name, cut)) | (np.minimum.reduceat(who, cut) < 0)
        chosen = np.repeat(shared, np.diff(np.r_[cut, len(ids)])) & (who >= 0)
        ids, who = ids[chosen], who[chosen]
        by = np.argsort(who, kind="stable")
        ids, who = ids[by], who[by]
        bins: dict[int, list[tuple[bytes, int, bytes]]] = {}
        for s, e in runs(who):
            own = owners[16 * who[s] : 16 * who[s] + 16]
            bins.setdefault(bin_of(own), []).append((own, e - s, ids[s:e].tobytes()))
        columns = [[b"".join(x[0] for x in b), np.uint32([x[1] for x in b]).tobytes(), b"".join(x[2] for x in b)] for b in bins.values()]
        return answer(list(bins), *([c[i] for c in columns] for i in range(3)))

    def merged(group: pa.Table) -> pa.Table:
        size: dict[bytes, int] = {}
        found: dict[bytes, list[np.ndarray]] = {}
        for owners, counts, blob in zip(*(group.column(c).to_pylist() for c in ("owners", "counts", "ids")), strict=True):
            ids, at = np.frombuffer(blob, np.uint64), 0
            for k, count in enumerate(np.frombuffer(counts, np.uint32).tolist()):
                own = owners[16 * k : 16 * k + 16]
                if blob:
                    found.setdefault(own, []).append(ids[at : at + count])
                    at += count
                else:
                    size[own] = count
        lists = {own: np.unique(np.concatenate(parts)) for own, parts in found.items()}
        able = [own for own, x in lists.items() if len(x) * 100 >= size[own] * percent]
        return pa.table({"set": pa.array(able, pa.binary()), "ids": pa.array([lists[own].tobytes() for own in able], pa.binary())})

    def bin_of(own: bytes) -> int:
        return int.from_bytes(own[:6]) % buckets

    kind = "owners binary, counts binary, ids binary"
    out = docs.select("text").mapInArrow(sent, f"bucket long, {kind}")
    answers = out.groupBy("bucket").applyInArrow(counted, f"bin long, {kind}")
    return answers.groupBy("bin").applyInArrow(merged, "set binary, ids binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): connected components of (a, b) by alternating large and small stars; the label is
    the smallest node.  No node's neighbours are ever gathered in one place."""
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = keep(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == before:
            break
        before = state
    return keep(now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), "labels")


class Points:
    """Sets of one chunk: overlaps of any of them, or of others, with all of them."""

    def __init__(self, blobs: list[bytes], sizes: np.ndarray):
        lists = [np.frombuffer(b, np.uint64) for b in blobs]
        self.n = np.asarray(sizes, np.int64)
        self.owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        ids = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        order = np.argsort(ids, kind="stable")
        self.ids, self.owner = ids[order], self.owner[order]
        self.lists = lists

    def overlap(self, ids: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        count = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        return np.bincount(self.owner[at], minlength=len(self.n))

    def compare(self, ids: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances to all points, and which of them link."""
        both = self.overlap(ids)
        union = self.n + n - both
        return 1 - both / union, 100 * both >= percent * union


def join_cluster(points: Points, percent: int) -> np.ndarray:
    """Component (its smallest index) of each point of a cluster."""
    r, size = 1 - percent / 100 + 1e-9, len(points.n)
    label = np.arange(size)

    def link(own: int, others: np.ndarray) -> None:
        labels = np.unique(np.r_[label[own], label[others]])
        if len(labels) > 1:
            label[np.isin(label, labels)] = labels[0]

    core, far = np.full(size, -1), {}
    for p in range(size):  # until every point is in the core of a pivot
        if core[p] < 0:
            far[p], near = points.compare(points.lists[p], points.n[p], percent)
            near[p] = True
            core[near & (core < 0)] = p
            link(p, np.flatnonzero(near))
    for x in range(size):
        if x in far:
            continue
        own = far[core[x]]
        window = (np.abs(own - own[x]) <= r) & (label != label[x])
        if window.any():
            link(x, np.flatnonzero(points.compare(points.lists[x], points.n[x], percent)[1]))
    return label


def small_clusters(members: DataFrame, total: int, percent: int) -> DataFrame:
    """(a, b): links that connect the components of clusters of (cluster, uid, n, ids)."""

    def solved(group: pa.Table) -> pa.Table:
        cluster, uid, n = (group.column(c).to_numpy() for c in ("cluster", "uid", "n"))
        blobs = group.column("ids").to_pylist()
        order = np.lexsort((uid, cluster))
        a, b = [], []
        for s, e in runs(cluster[order]):
            at = order[s:e]
            label = join_cluster(Points([blobs[k] for k in at], n[at]), percent)
            joined = np.flatnonzero(label != np.arange(len(at)))
            a += uid[at[joined]].tolist()
            b += uid[at[label[joined]]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    bin_ = F.pmod(F.xxhash64("cluster"), F.lit(max(1, total // LEAF)))
    return members.select(bin_.alias("bin"), "cluster", "uid", "n", "ids").groupBy("bin").applyInArrow(solved, "a long, b long")


def large_clusters(members: DataFrame, percent: int) -> DataFrame:
    """The same for clusters of any size: (cluster, size, uid, n, ids)."""
    r = 1 - percent / 100 + 1e-9
    chunks = F.ceil(F.col("size") / CHUNK)
    dealt = members.withColumn("chunk", F.pmod(F.xxhash64("uid"), chunks))

    def measured(own: pa.Table, pivots: pa.Table) -> pa.Table:
        cluster = (own if own.num_rows else pivots).column("cluster")[0].as_py()
        uid = own.column("uid").to_numpy()
        points = Points(own.column("ids").to_pylist(), own.column("n").to_numpy())
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for p, n, ids in zip(pivots.column("uid").to_pylist(), pivots.column("n").to_pylist(), pivots.column("ids").to_pylist(), strict=True):
            if not len(uid):
                break
            d, links = points.compare(np.frombuffer(ids, np.uint64), n, percent)
            d[uid == p], links[uid == p] = 0, True  # its lists hold shared shingles only, so it seems far from itself
            at = np.flatnonzero(d <= 2 * r)
            out.append((np.full(len(at), p), uid[at], d[at], links[at]))
        joined = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        columns = [pa.array(x, t) for x, t in zip(joined, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)]
        return pa.table([pa.array(np.full(len(joined[0]), cluster), pa.int64()), *columns], ["cluster", "pivot", "uid", "d", "links"])

    left, near, turn = dealt, None, 0
    while not left.isEmpty():
        turn += 1
        marked = left.withColumn("h", F.xxhash64("uid", F.lit(turn)))
        most = marked.groupBy("cluster").agg(F.min("h").alias("first"), F.count("*").alias("open"))
        chosen = (F.col("h") == F.col("first")) | (F.pmod(F.col("h"), F.col("open")) < PIVOTS)
        pivots = keep(marked.join(most, "cluster").where(chosen).select("cluster", "size", "uid", "n", "ids"), "pivots")
        copies = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), (chunks - 1).cast("long"))))
        own = keep(dealt.groupBy("cluster", "chunk").cogroup(copies.groupBy("cluster", "chunk")).applyInArrow(measured, "cluster long, pivot long, uid long, d double, links boolean"), "near")
        near = own if near is None else near.unionByName(own)
        left = keep(left.join(own.where("links").select("cluster", "uid").distinct(), ["cluster", "uid"], "left_anti"), "left")
    stars = near.where("links and uid <> pivot").select(F.col("uid").alias("a"), F.col("pivot").alias("b"))
    label = components(stars)
    home = near.where("links").groupBy("cluster", "uid").agg(F.min(F.struct("d", "pivot")).alias("home"))
    home = home.select("cluster", "uid", F.col("home.pivot").alias("pivot"), F.col("home.d").alias("d"))
    named = near.join(label.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    named = named.join(label.select(F.col("node").alias("pivot"), F.col("label").alias("own")), "pivot", "left").withColumn("own", F.coalesce("own", "pivot"))
    region = ["cluster", "pivot"]
    foreign = keep(named.where("label <> own").select(*region, "uid", "d"), "foreign")
    least = foreign.groupBy(*region).agg(F.min("d").alias("least"), F.count("*").alias("f"))
    cores = home.join(least, region).where(F.col("d") >= F.col("least") - r).select(*region, "uid", "d", "f")
    sizes = keep(cores.groupBy(*region).agg(F.count("*").alias("c"), F.max("f").alias("f")), "regions")
    i, j = F.ceil(F.col("c") / CHUNK).cast("long"), F.ceil(F.col("f") / CHUNK).cast("long")
    sets = members.select("cluster", "uid", "n", "ids")
    side = F.lit(0).cast("long")
    core = cores.drop("f").join(sizes, region).withColumn("i", F.pmod(F.xxhash64("uid"), i)).withColumn("j", F.explode(F.sequence(side, j - 1))).join(sets, ["cluster", "uid"])
    edge = foreign.join(sizes, region).withColumn("j", F.pmod(F.xxhash64("uid"), j)).withColumn("i", F.explode(F.sequence(side, i - 1))).join(sets, ["cluster", "uid"])

    def crossed(inner: pa.Table, outer: pa.Table) -> pa.Table:
        a, b = [], []
        if inner.num_rows and outer.num_rows:
            uid, d = inner.column("uid").to_numpy(), inner.column("d").to_numpy()
            points = Points(inner.column("ids").to_pylist(), inner.column("n").to_numpy())
            for y, dy, n, ids in zip(*(outer.column(c).to_pylist() for c in ("uid", "d", "n", "ids")), strict=True):
                if (np.abs(d - dy) <= r).any():
                    found = np.flatnonzero(points.compare(np.frombuffer(ids, np.uint64), n, percent)[1])
                    if len(found):  # the core is one component: one link joins y to all of it
                        a.append(y)
                        b.append(int(uid[found].min()))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = [*region, "i", "j"]
    own = [F.col(c).alias(c) for c in (*keys, "uid", "d", "n", "ids")]  # columns of their own: both sides come from ``members``
    links = core.select(*keys, "uid", "d", "n", "ids").groupBy(*keys).cogroup(edge.select(*own).groupBy(*keys)).applyInArrow(crossed, "a long, b long")
    return stars.unionByName(links)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("body"), text.alias("text"))
    rows = keep(set_keys(source, words), "sets")
    total, most = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    first = rows.where("n > 0").groupBy("set").agg(F.min(F.struct("id", "body")).alias("own"), F.min("id").alias("low"), F.max("n").alias("n"), F.count("*").alias("rows"))
    points = keep(keep(first, "points").withColumn("uid", F.monotonically_increasing_id()), "points")
    result = rows.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    if not most:
        return result
    # copies of a point say nothing new: only the row that stands for it is read again
    several = points.where(F.col("rows") > COPIES).select("set", "own")
    copies = rows.join(several, "set").where(~(F.col("id").eqNullSafe(F.col("own.id")) & (F.col("body") == F.col("own.body"))))
    copies = keep(copies.select(F.col("id").alias("cid"), F.col("body").alias("cbody")).distinct(), "copies")
    single = source.join(copies, F.col("id").eqNullSafe(F.col("cid")) & (F.col("body") == F.col("cbody")), "left_anti")
    shared = shared_shingles(single, words, int(total // COUNT) + 4, percent)
    able = keep(shared.join(points.select("set", "uid", "n"), "set").select("uid", "n", "ids"), "able")

    def unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(b.as_py(), np.int64) for b in batch.column(2)]
            count = [len(x) for x in lists]
            columns = [np.repeat(batch.column(0).to_numpy(), count), np.repeat(batch.column(1).to_numpy(), count), np.concatenate([*lists, np.zeros(0, np.int64)])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["uid", "n", "id"])

    each = able.mapInArrow(unfolded, "uid long, n long, id long")
    ranked = each.join(each.groupBy("id").agg(F.count("*").alias("df")).where("df > 1"), "id")
    order = Window.partitionBy("uid").orderBy(F.desc("df"), F.desc("id"))  # a document's shingles, the most common first
    least = F.ceil(F.col("n") * percent / 100)  # an overlap that links; fewer are left behind the window
    homes = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") >= least)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.8 / percent)))
    regions = homes.select("uid", "id", F.explode(F.array(band, band + 1)).alias("band"))
    regions = keep(regions, "regions")
    pivot = regions.groupBy("id", "band").agg(F.min("uid").alias("b"))
    pairs = keep(regions.join(pivot, ["id", "band"]).select(F.col("b").alias("cluster"), "uid").distinct(), "pairs")
    clusters = pairs.join(able, "uid").select("cluster", "uid", "n", "ids")
    sizes = pairs.join(able.select("uid", F.octet_length("ids").alias("bytes")), "uid").groupBy("cluster").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    members = keep(clusters.join(sizes.where("size > 1"), "cluster"), "members")
    alone = (F.col("size") <= LEAF) & (F.col("bytes") <= 8 * LEAF_IDS)
    links = small_clusters(members.where(alone), members.count(), percent)
    large = members.where(~alone).drop("bytes")
    if not large.isEmpty():
        links = links.unionByName(large_clusters(large, percent))
    label = components(links)
    named = points.join(label.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    smallest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    found = keep(named.join(smallest, "label").select("set", "component_id"), "components")
    linked = rows.where("n > 0").join(found, "set").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(result)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with all columns; rows without an id stay."""
    (name,) = unused(docs, "_gone")
    found = jaccard_components(docs, id_col, text_col, **params)
    gone = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays")
    # the ids that go are few where the ids that stay are many: a short list travels to the texts
    return docs.join(keep(gone.select(F.col("doc_id").alias(name)), "gone"), F.col(id_col) == F.col(name), "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
