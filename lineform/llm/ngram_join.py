"""N-gram Jaccard self-join by vertical partitioning, and the groups that its links form.

The distinct n-grams of all texts have one global order: rare before frequent, then by hash. The order is cut
into fragments; a text's set is cut into segments likewise. The overlap of a pair is counted segment by
segment, and the partial counts are summed by pair.

Candidates come from the order's head. A text's prefix is the part of its set in which it must share ``need``
n-grams with each partner; pairs that share fewer can't link. Texts of equal sets are one class from the
start. Large groups of near copies, most pairs of which may fall just short of a link, would give all their
pairs in a join of prefix entries. So texts that share enough of their prefixes with a leader form families.
Within a family the partial counts of all pairs are summed in a task, in chunks of bounded size, and only
links that join components are given out. Pairs of different families that share enough prefix n-grams are
enumerated without a cap, and their partial counts are joined and summed by pair. So components are exact.

Which n-grams are frequent is kept as a bitmap of fixed size; hash collisions in it change the order, and so
only speed. N-grams and equal sets are compared by 64-bit hashes.

Defined cases: null, empty or wordless texts have an empty set, linked with nothing; texts of fewer than n
words have one n-gram, the whole sequence; equal texts are linked; rows of a repeated id are handled one by
one; a null id is never a group's smallest; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineform.llm import common
from lineform.llm.components import components
from lineform.llm.shingles import shingle_sets

FRAGMENTS = 8
ENTRY = "h long, node long, row_id long, n long"
#: Prefix entries from which an n-gram counts as frequent and goes to the end of the order.
FREQUENT = 16
#: Bits of the bitmap of frequent n-grams, and of that of texts with candidates; both are broadcast.
BITS = 1 << 25
MOST_ROUNDS = 3
#: Texts, and n-grams of texts, of a family that meet in one task: two chunks at most.
CHUNK, CHUNK_GRAMS = 2048, 1 << 22
#: Pairs that are broadcast to the segments, at most; more are shuffled to them.
MOST_BROADCAST = 200_000

_PROFILE = pa.schema([("row_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("head", pa.list_(pa.int64()))])
_SEGMENT = pa.schema([("node", pa.int64()), ("fragment", pa.int32()), ("segment", pa.list_(pa.int64()))])


def need(n, percent: int):
    """N-grams that two linked texts share within their prefixes, at least: by the smaller set's size."""
    return 1 + n * (100 - percent) // 200


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + need(n, percent)


def node_of(s: np.ndarray) -> int:
    """The number of a class of equal sets."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bits_of(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(BITS - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap with the bits of a column h of hashes; at most BITS / 32 rows reach the driver."""
    words = hashes.selectExpr(f"shiftright(h & {BITS - 1}, 5) AS word", "shiftleft(1L, CAST(h & 31 AS INT)) AS bit")
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 32, np.uint32)
    out[rows["word"].to_numpy().astype(np.int64)] = rows["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _sets(batches, n):
    for batch in common.sliced(batches):
        yield batch.column(0), shingle_sets(common.bytes_of(batch.column(1)), n)


def _head_hashes(n: int, percent: int):
    """All hashes of a somewhat longer prefix, in the order of hashes alone."""

    def run(batches):
        for _, sets in _sets(batches, n):
            heads = [s[: prefix_length(len(s), percent) * 5 // 4 + 1] for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64))], names=["h"])

    return run


def _profiles(n: int, percent: int, shared):
    def run(batches):
        frequent = shared.value
        for ids, sets in _sets(batches, n):
            flags = _bits_of(frequent, np.concatenate(sets))
            heads, nodes, at = [], [], 0
            for s in sets:
                own, late = prefix_length(len(s), percent), flags[at : at + len(s)]
                at += len(s)
                head = s[~late][:own]
                heads.append(head if len(head) == own else np.concatenate([head, s[late][: own - len(head)]]))
                nodes.append(node_of(s))
            offsets = pa.array(np.cumsum([0, *(len(x) if len(s) else 0 for x, s in zip(heads, sets, strict=True))]), pa.int32())
            flat = np.concatenate([x for x, s in zip(heads, sets, strict=True) if len(s)] or [np.zeros(0, np.uint64)])
            columns = [ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, schema=_PROFILE)

    return run


def _entries(standing, again):
    """A row for each prefix n-gram of texts that stand for their class (and, by the bitmap's chance, of some copies); of n-grams that occur again alone, where they are known."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(_bits_of(standing.value, ids.view(np.uint64))))
            lists = batch.column(3)
            h = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            if again is not None:
                keep = _bits_of(again.value, h.view(np.uint64))
                h, row = h[keep], row[keep]
            nodes, n = (batch.column(k).to_numpy(zero_copy_only=False)[row] for k in (1, 2))
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)[row]
            for at in range(0, len(h), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 18)], pa.int64()) for x in (h, nodes, ids, n)], names=["h", "node", "row_id", "n"])

    return run


def _segments(n: int, shared, wanted):
    """The segments of texts that may have candidates; an n-gram's fragment is its place in the global order."""

    def run(batches):
        frequent, nodes = shared.value, wanted.value

        def chosen():
            for batch in batches:
                keep = _bits_of(nodes, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                yield batch.filter(pa.array(keep))

        for _, sets in _sets(chosen(), n):
            owners, fragments, parts = [], [], []
            for s in sets:
                late = _bits_of(frequent, s)
                early = s[~late]
                cuts = np.searchsorted(early, (np.arange(FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // (FRAGMENTS - 1)))[1 : FRAGMENTS - 1])
                node = node_of(s)
                for f, part in enumerate([*np.split(early, cuts), s[late]]):
                    if len(part):
                        owners.append(node)
                        fragments.append(f)
                        parts.append(part)
            offsets = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
            flat = np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(fragments, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat))], schema=_SEGMENT)

    return run


def verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link: partial overlaps by fragment, summed by pair."""
    if pairs.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        pairs = F.broadcast(pairs)
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("segment").alias("sa")).join(pairs, "a")
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("segment").alias("sb")).join(pairs.select("a", "b"), "b")
    both = left.join(right, ["a", "b", "fragment"])
    partial = both.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("sa", "sb")).cast("long").alias("partial"))
    once = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("partial").alias("partial"))  # a repeated row has its segments again
    summed = once.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap"))
    return summed.where(f"{100 + percent} * overlap >= {percent} * (na + nb)").select("a", "b", "overlap")


def _near_size(percent: int) -> str:
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _star_edges(buckets: DataFrame, percent: int, seed: int) -> DataFrame:
    """An edge from each text to the leader, of buckets that it is in, with which it shares most of its prefix, if that is enough to link; in later rounds, half of that or less, for texts that are met in many buckets are better counted together."""
    rank = F.xxhash64("node", F.lit(seed))
    leaders = buckets.groupBy("h").agg(F.min(F.struct(rank.alias("rank"), F.col("node").alias("leader"), F.col("n").alias("nl"), F.col("family").alias("fl"))).alias("l")).select("h", "l.*")
    shared = buckets.join(leaders, "h").where("family <> fl").selectExpr("node", "n AS na", "leader", "nl AS nb", "family", "fl").where(_near_size(percent))
    counted = shared.groupBy("node", "na", "leader", "nb", "family", "fl").agg(F.count("*").alias("k")).where(F.col("k") * (1 << seed) >= need_column(F.least("na", "nb"), percent))
    best = counted.groupBy("node", "family").agg(F.max(F.struct("k", "leader", "fl")).alias("m"))
    return best.select(F.col("family").alias("a"), F.col("m.fl").alias("b"))


def _able(entries: DataFrame, percent: int) -> DataFrame:
    """Texts with enough entries for a link: as many as a partner of the least size that can link must share with them."""
    counted = entries.groupBy("node", "n").agg(F.count("*").alias("k"))
    return counted.where(F.col("k") >= need_column(F.floor(F.col("n") * percent / 100), percent)).select("node")


def _mixed(buckets: DataFrame, percent: int) -> DataFrame:
    """The entries of buckets with several families, of texts that have enough of them to link outside of theirs."""
    for _ in range(2):
        several = buckets.groupBy("h").agg(F.min("family").alias("low"), F.max("family").alias("high")).where("low < high").select("h")
        buckets = common.stored(buckets.join(several, "h"))
        buckets = buckets.join(_able(buckets, percent), "node").select("h", "node", "n", "family")
    return common.stored(buckets)


def _families(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """node, n and family of texts that look alike, and the bucket entries that different families share.

    Stars are joined to components, in rounds, until the pairs left between families are few. Which texts are one family doesn't change the result."""
    members = entries.select("node", "n").distinct().withColumn("family", F.col("node"))
    buckets = entries.select("h", "node", "n", F.col("node").alias("family"))
    for seed in range(MOST_ROUNDS):
        by = buckets.groupBy("h", "family").agg(F.count("*").alias("m")).groupBy("h").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"))
        left = by.agg(F.sum(F.expr("(all * all - same) div 2")).alias("pairs"), F.sum("all").alias("rows")).first()
        if (left.pairs or 0) <= (left.rows or 0):
            break
        up = components(_star_edges(buckets, percent, seed)).select(F.col("node").alias("family"), "root")
        if up.isEmpty():
            break
        moved = lambda df: df.join(up, "family", "left").withColumn("family", F.coalesce("root", "family")).drop("root")  # noqa: B023, E731
        members = common.stored(moved(members))
        buckets = _mixed(moved(buckets).select("h", "node", "n", "family"), percent)
    return members.select("node", "n", "family"), buckets


def _family_links(families: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Links that join the texts of each family. Partial overlaps are counted fragment by fragment and summed by pair within a task; pairs that don't link are not given out.

    A family of more than CHUNK texts, or of more n-grams than CHUNK_GRAMS, is cut into chunks that meet two by two.
    """
    sizes = families.groupBy("family").agg(F.count("*").alias("g"), F.sum("n").alias("grams")).where("g > 1")
    chunks = F.greatest(F.ceil(F.col("g") / CHUNK), F.ceil(F.col("grams") / CHUNK_GRAMS)).cast("int")
    placed = families.join(sizes.select("family", chunks.alias("chunks")), "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tasks = met.select("node", "n", F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    parts = int(families.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = segments.join(tasks, "node").select("task", "fragment", "node", "n", "segment")
    return rows.repartition(parts, "task").sortWithinPartitions("task", "fragment").mapInArrow(_met(percent), "a long, b long")


def _joined(fragments: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]], percent: int) -> list[tuple[int, int]]:
    """Pairs (node, smallest node that it is joined to) of one task's texts: nodes, set sizes and segments by fragment."""
    nodes, first = np.unique(np.concatenate([f[0] for f in fragments]), return_index=True)
    n = np.concatenate([f[1] for f in fragments])[first]
    overlap = np.zeros((len(nodes), len(nodes)), np.float32)
    for own, _, parts in fragments:  # partial counts of a fragment, summed by pair
        rows = np.repeat(np.searchsorted(nodes, own), list(map(len, parts)))
        _, column, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        place = np.cumsum(seen > 1) - 1
        keep = seen[column] > 1
        rows, column = rows[keep], place[column[keep]]
        for at in range(0, int(place[-1]) + 1, 1024):
            here = (column >= at) & (column < at + 1024)
            if here.any():
                present, dense = np.unique(rows[here], return_inverse=True)
                has = np.zeros((len(present), 1024), np.float32)
                has[dense, column[here] - at] = 1
                overlap[np.ix_(present, present)] += has @ has.T
    linked = (100 + percent) * overlap >= percent * (n[:, None] + n[None, :])
    label = np.arange(len(nodes))
    while True:
        new = np.where(linked, label[None, :], len(nodes)).min(1)
        new = np.minimum(new, label)[np.minimum(new, label)]
        if (new == label).all():
            return [(int(nodes[i]), int(nodes[x])) for i, x in enumerate(label.tolist()) if x != i]
        label = new


def _met(percent: int):
    def run(batches):
        task, kind, fragments = None, None, []

        def done():
            links = _joined(fragments, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            tasks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((tasks[1:] != tasks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tasks)], strict=True):
                if lo == hi:
                    continue
                if task is not None and tasks[lo] != task:
                    yield done()
                    fragments, kind = [], None
                task = tasks[lo]
                lists = batch.column(4).slice(lo, hi - lo)
                flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
                offsets = offsets - offsets[0]
                parts = [flat[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                own, n = (batch.column(k).slice(lo, hi - lo).to_numpy() for k in (2, 3))
                if kinds[lo] == kind:  # the fragment goes on in a new batch
                    before = fragments.pop()
                    own, n, parts = np.concatenate([before[0], own]), np.concatenate([before[1], n]), before[2] + parts
                fragments.append((own, n, parts))
                kind = kinds[lo]
        if fragments:
            yield done()

    return run


def _rest_links(buckets: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """All links between different families."""
    a = buckets.selectExpr("h", "node AS a", "n AS na", "family AS fa")
    b = buckets.selectExpr("h", "node AS b", "n AS nb", "family AS fb")
    met = a.join(b, "h").where("a < b AND fa <> fb").where(_near_size(percent))
    counted = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    pairs = common.stored(counted.where(F.col("k") >= need_column(F.least("na", "nb"), percent)).drop("k"))
    return verified(pairs, segments, percent).select("a", "b")


def need_column(n, percent: int):
    return F.lit(1) + F.floor(n * (100 - percent) / 200)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles (of the largest set of its rows) and component_id of every row's id."""
    spark = docs.sparkSession
    own = common.id_and_text(docs, id_col, text_col)
    hashes = own.mapInArrow(_head_hashes(n, percent), "h long")
    frequent = spark.sparkContext.broadcast(_bitmap(hashes.groupBy("h").count().where(f"count > {FREQUENT}")))
    profile = common.stored(own.mapInArrow(_profiles(n, percent, frequent), "row_id long, n long, node long, head array<long>"))
    # of each class of equal sets, one text stands for all
    classes = profile.where("n > 0").groupBy("node").agg(F.min(F.coalesce("row_id", F.lit(0))).alias("h"))
    standing = spark.sparkContext.broadcast(_bitmap(classes.select("h")))
    heads = profile.select("row_id", "node", "n", "head")
    shared = common.stored(heads.mapInArrow(_entries(standing, None), ENTRY).select("h").groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"))
    again = spark.sparkContext.broadcast(_bitmap(shared))
    met = common.stored(heads.mapInArrow(_entries(standing, again), ENTRY).join(shared, "h"))
    entries = common.stored(met.join(_able(met, percent), "node").select("h", "node", "row_id", "n").distinct())
    wanted = spark.sparkContext.broadcast(_bitmap(entries.select(F.col("row_id").alias("h")).distinct()))
    segments = common.stored(own.mapInArrow(_segments(n, frequent, wanted), "node long, fragment int, segment array<long>"))

    families, buckets = _families(entries, percent)
    links = _family_links(families, segments, percent)
    rest = _rest_links(buckets, segments, percent)
    roots = components(links.unionByName(rest))
    rows = profile.select("row_id", "n", "node").join(roots, "node", "left").select("row_id", "n", F.coalesce("root", "node").alias("root"))
    rows = common.stored(rows)
    least = rows.where("n > 0").groupBy("root").agg(F.min("row_id").alias("least"))
    named = rows.join(least, (rows["root"] == least["root"]) & (rows["n"] > 0), "left")
    return named.select(F.col("row_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "row_id").alias("component_id"))


def _one_of_repeated(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """docs where linked rows of one id are one row; rows of one id whose texts aren't linked all stay."""
    key, at, row = F.col(f"`{id_col}`"), common.free_name(docs, "__id"), common.free_name(docs, "__row")
    again = docs.where(key.isNotNull()).groupBy(key.alias(at)).agg(F.count("*").alias("times")).where("times > 1").select(at)
    if again.isEmpty():
        return docs
    again = common.stored(again)
    rows = common.stored(docs.join(again, key == F.col(at), "left_semi").withColumn(row, F.monotonically_increasing_id()))
    found = groups(rows, row, text_col, n, percent).select(F.col("doc_id").alias(row), F.col("component_id").alias("component"))
    first = rows.select(row, key.alias("id")).join(found, row).groupBy("id", "component").agg(F.min(row).alias(row)).select(row)
    return docs.join(again, key == F.col(at), "left_anti").unionByName(rows.join(first, row, "left_semi").drop(row))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of linked ones, that of the smallest id; documents without words stay, and rows with a null id. Columns are kept."""
    found = groups(docs, id_col, text_col, n, percent)
    at = common.free_name(docs, "__kept")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(at)).distinct()
    single = _one_of_repeated(docs, id_col, text_col, n, percent)
    named = single.join(kept, F.col(f"`{id_col}`") == F.col(at), "left_semi")
    return named.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))
