"""Exact n-gram Jaccard join by adaptive multi-match prefixes, as components of linked documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsonde.llm import blocks, common
from colsonde.llm.components import components
from colsonde.llm.wordhash import SLAB, _spread, window_hashes, word_hashes

#: Prefixes are lengthened by at most so many tokens less one.
MOST_MATCHES = 4
#: Lists of up to so many documents are paired; members of longer ones are linked to one member.
SHORT_LIST = 16
#: Documents that are compared with each other in one go.
CHUNK = 128
#: Cells of the matrix of a comparison, and so its memory.
CELLS = 4 << 20

_PREFIX = "doc_id {kind}, n bigint, node binary, matches int, tokens array<bigint>, file bigint, at bigint"


def _slabs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of texts that are hashed in one go: a slab, or one longer text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB, "right")))
        yield at, to
        at = to


def _sets(texts: pa.Array, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of each text in turn, made by slabs of texts."""
    found = [np.zeros(0, np.uint64)]
    for at, to in _slabs(texts):
        found.append(_slab_sets(texts.slice(at, to - at), n, 1)[0])
    return np.concatenate(found)


def _slab_sets(texts: pa.Array, n: int, lanes: int) -> tuple[np.ndarray, ...]:
    """(sorted distinct shingle hashes of each text in turn, their other lanes, offsets of the texts)."""
    *hashes, offsets = word_hashes(texts, fold=True, lanes=lanes)
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    firsts = offsets[:-1][counts >= n]
    sizes = (counts - n + 1)[counts >= n]
    at = np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    short = np.flatnonzero((counts > 0) & (counts < n))
    owner = np.concatenate([owner, short])
    lanes_of = []
    for h in hashes:
        # Fewer words than a shingle has: the whole sequence, told apart from any shingle by its length.
        extra = [_spread(window_hashes(h[offsets[i] : offsets[i + 1]], int(counts[i])) + np.uint64(counts[i])) for i in short.tolist()]
        lanes_of.append(np.concatenate([window_hashes(h, n)[at], *extra]))
    order = np.lexsort((lanes_of[0], owner))
    owner, lanes_of = owner[order], [x[order] for x in lanes_of]
    new = np.ones(len(owner), bool)
    new[1:] = (lanes_of[0][1:] != lanes_of[0][:-1]) | (owner[1:] != owner[:-1])
    owner = owner[new]
    return *(x[new] for x in lanes_of), np.searchsorted(owner, np.arange(len(counts) + 1))


def _nodes(lanes: list[np.ndarray], offsets: np.ndarray) -> list[bytes]:
    """128 bits that name each set: sums over independent hashes of its shingles."""
    names = np.zeros((len(offsets) - 1, 2), np.uint64)
    for k, h in enumerate(lanes):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(h))])
        names[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    raw = names.byteswap().tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(names))]


def prefix(df: np.ndarray, least: int) -> tuple[int, int]:
    """(tokens of the prefix, matches asked for) of a set whose document frequencies ascend.

    ``least`` is the overlap that any partner must have. Asking for k matches takes k - 1 more
    tokens: their lists are scanned too, but at most scanned / k documents then reach k matches
    and are verified, each at a cost that grows with the set.
    """
    n = len(df)
    short = n - least + 1
    lists = np.cumsum(df - 1.0)
    best, chosen = None, 1
    for k in range(1, min(MOST_MATCHES, least) + 1):
        scanned = lists[short + k - 2]
        cost = scanned + scanned / k * (1 + n / 32)
        if best is None or cost < best:
            best, chosen = cost, k
    return short + chosen - 1, chosen


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, in bounded memory."""
    tokens_a, tokens_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(tokens_a, tokens_b)
    out = np.zeros((len(a), len(b)), np.float32)
    own_a, own_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    step = max(64, CELLS // max(len(a), len(b)))
    place_a, place_b = np.searchsorted(both, tokens_a), np.searchsorted(both, tokens_b)
    good_a, good_b = blocks.member(tokens_a, both), blocks.member(tokens_b, both)
    for lo in range(0, len(both), step):
        x, y = np.zeros((len(a), step), np.float32), np.zeros((len(b), step), np.float32)
        pick = good_a & (place_a >= lo) & (place_a < lo + step)
        x[own_a[pick], place_a[pick] - lo] = 1
        pick = good_b & (place_b >= lo) & (place_b < lo + step)
        y[own_b[pick], place_b[pick] - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among n documents."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in pairs.tolist():
        x, y = root(i), root(j)
        if x != y:
            parent[x] = y
            out.append((i, j))
    return out


def _candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold every pair that prefixes allow to be linked."""
    index = reps.select(F.explode("tokens").alias("token"), "node", "n", "matches")
    index = common.settle(index, "join-index")
    sizes = index.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.min("node").alias("hub")).where("docs > 1")
    sizes = common.settle(sizes, "join-lists")
    # Documents of a long list are all linked to its least member, before anything is verified.
    long = index.join(sizes.where(F.col("docs") > SHORT_LIST), "token").select(F.col("node").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct()
    lists = (
        index.join(sizes.where(F.col("docs") <= SHORT_LIST).select("token"), "token")
        .groupBy("token")
        .agg(F.sort_array(F.collect_list(F.struct("node", "n", "matches"))).alias("l"))
    )

    def pairs(batches):
        for batch in batches:
            a, b, least = [], [], []
            for group in batch.column(0).to_pylist():
                for j, y in enumerate(group):
                    for x in group[:j]:
                        a.append(x["node"])
                        b.append(y["node"])
                        least.append(min(x["matches"], y["matches"]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(least, pa.int32())], names=["a", "b", "least"])

    met = lists.select("l").mapInArrow(common.tidy(pairs), "a binary, b binary, least int")
    short = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.max("least").alias("least")).where("met >= least").select("a", "b")
    return long.unionByName(short)


def _cells(large: DataFrame) -> DataFrame:
    """(node, component, cell, side): where members (node, component, ring, class) of large clusters are compared.

    Members of equal ring and class are dealt into chunks by hash. Every two chunks that can
    hold linked documents are a cell; a document goes to all cells of its chunk.
    """
    counts = large.groupBy("component", "ring", "class").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("k"))
    chunk = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
    own = large.join(counts, ["component", "ring", "class"]).withColumn("x", chunk(F.col("k"))).drop("k")
    steps = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    towards = F.explode(F.array(*[F.struct((F.col("ring") + r).alias("r"), (F.col("class") + c).alias("c")) for r, c in steps]))
    # Members of ring 0 are all linked to the pivot, so they need no comparison among themselves.
    met = own.withColumn("to", towards).where((F.col("ring") > 0) | (F.col("to.r") > 0))
    others = counts.select("component", F.col("ring").alias("r"), F.col("class").alias("c"), "k")
    met = met.select("*", "to.*").join(others, ["component", "r", "c"])
    met = met.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    mine, theirs = F.struct("ring", "class", "x"), F.struct(F.col("r").alias("ring"), F.col("c").alias("class"), F.col("y").alias("x"))
    name = lambda s: [s[f].cast("string") for f in ("ring", "class", "x")]
    cell = F.concat_ws("/", *name(F.least(mine, theirs)), *name(F.greatest(mine, theirs)))
    return met.select("node", "component", cell.alias("cell"), (theirs < mine).cast("int").alias("side"))


def _rings(clusters: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """``clusters`` with each member's ring about its cluster's pivot, the least member, and whether it is that.

    1 - similarity is a metric. Rings are as wide as the distance of linked documents, ring 0
    with its border, so linked documents lie in the same or in neighbouring rings. The pivot's
    set is sent once to every CHUNK members or so.
    """
    sizes = clusters.groupBy("component").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("docs")).withColumn("k", F.ceil(F.col("docs") / CHUNK).cast("int"))
    members = clusters.join(sizes, "component").withColumn("is_pivot", F.col("node") == F.col("pivot"))
    salted = members.select("node", "component", F.pmod(F.xxhash64("node"), "k").cast("int").alias("salt"), F.lit(False).alias("pivot"))
    pivots = sizes.select(F.col("pivot").alias("node"), "component", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(True).alias("pivot"))

    def measure(group: pa.Table) -> pa.Table:
        held = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("tokens")]
        center = group.column("pivot").to_numpy()
        middle = held[int(np.flatnonzero(center)[0])]
        rest = np.flatnonzero(~center)
        both = np.array([blocks.member(held[i], middle).sum() for i in rest.tolist()], np.int64)
        union = np.array([len(held[i]) for i in rest.tolist()], np.int64) + len(middle) - both
        # The least r with distance <= (r + 1) * width, in whole numbers.
        ring = np.maximum(-(-100 * (union - both) // ((100 - per_cent) * union)) - 1, 0)
        return pa.table({"node": group.column("node").take(pa.array(rest)), "ring": pa.array(ring, pa.int32())})

    found = salted.unionByName(pivots).join(sets, "node").groupBy("component", "salt").applyInArrow(common.tidy_group(measure), "node binary, ring int")
    return members.select("node", "component", "n", "docs", "pivot", "is_pivot").join(found, "node")


def _compare(sets: DataFrame, clusters: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) that join up all truly linked documents of each cluster (node, component, n).

    All members are measured against their cluster's pivot and linked to it first. What is left
    to compare are pairs without the pivot and not both in ring 0 (:func:`_rings`). Clusters that
    have such pairs are compared whole up to CHUNK documents; in larger ones, documents of equal
    or neighbouring rings and size classes, so wide that only neighbours can be linked, are
    dealt into cells. A comparison gives out a spanning forest of the links it finds, never
    all pairs.
    """
    if per_cent == 100:
        return sets.sparkSession.createDataFrame([], "a binary, b binary")  # equal sets are one node already
    # Classes neighbour each other if n * 100 >= per_cent * m for sizes n <= m, whatever a logarithm's last bits.
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / per_cent)) * (1 - 1e-9)).cast("int")
    rows = common.settle(_rings(clusters, sets, per_cent).withColumn("class", size), "join-rings")
    starred = rows.where("ring = 0 AND NOT is_pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    left = rows.groupBy("component").agg(F.max("ring").alias("most")).where("most > 0").select("component")
    rest = rows.where("docs > 2 AND NOT is_pivot").join(left, "component")
    small = rest.where(F.col("docs") <= CHUNK).select("node", "component", F.lit("").alias("cell"), F.lit(0).alias("side"))
    small = small.unionByName(_cells(rest.where(F.col("docs") > CHUNK)))

    def verify(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        nodes = [x.as_py() for x in group.column("node")]
        held = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("tokens")]
        size = np.array([len(x) for x in held], np.int64)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        found = []
        # Groups hold two chunks at most, but chunks may be uneven: compare in pieces of CHUNK.
        for i in range(0, len(left), CHUNK) if len(left) else []:
            for j in range(0, len(right), CHUNK):
                p, q = left[i : i + CHUNK], right[j : j + CHUNK]
                both = shared([held[k] for k in p], [held[k] for k in q])
                union = size[p][:, None] + size[q][None, :] - both
                a, b = np.nonzero(100 * both >= per_cent * union)
                found.append(np.stack([p[a], q[b]], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        tree = forest(pairs[pairs[:, 0] != pairs[:, 1]], len(nodes))
        return pa.table({"a": pa.array([nodes[i] for i, _ in tree], pa.binary()), "b": pa.array([nodes[j] for _, j in tree], pa.binary())})

    return small.join(sets, "node").groupBy("component", "cell").applyInArrow(common.tidy_group(verify), "a binary, b binary").unionByName(starred)


def near_duplicates(docs: DataFrame, n: int = 5, per_cent: int = 80, key: str = "doc_id", column: str = "text", is_scan: bool = False, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(key, n_shingles, component_id, __class, __copy) of every row.

    Words are runs between ASCII white space with A-Z lower-cased; a text's set is its distinct
    ``n``-word shingles, or with fewer words the whole sequence. Texts are linked if
    100 * intersection >= per_cent * union; component_id is the smallest key that links reach,
    the row's own included. Equal sets are one node, so copies are never expanded into pairs.

    Tokens are ordered by document frequency, counted over all documents, then hash. A set's
    prefix is so long that any partner shares at least the asked number of tokens within both
    prefixes (the smaller of the two numbers); the number follows the estimated cost of
    candidates (:func:`prefix`). Nothing is lost: lists that are too long to pair link all their
    members as candidates, and candidates are compared set by set, by 64-bit hashes of
    shingles; sets are told apart by 128 bits, from two independent hashes.

    A null, empty or blank text has no set and is linked with nothing: its component_id is its
    own key. A null key never names a component unless all its members' keys are null. Repeated
    rows are equal texts. __class (binary, null without a set) names the row's component, for
    rows whose keys are not unique. ``is_scan``: docs is a plain scan of Parquet files already;
    ``sizes`` of :func:`blocks.measure`, if known.
    """
    if n < 1 or not 1 <= per_cent <= 100:
        raise ValueError("n must be at least 1, and per_cent 1 to 100")
    spark = docs.sparkSession
    common.ship(spark)
    source = docs if is_scan else blocks.stable(docs.select(F.col(key), F.col(column)))
    source = blocks.named(source.select(F.col(key).alias("doc_id"), common.text_of(column).alias("text")))
    bits, stretch = sizes or blocks.measure(source)
    kind = source.schema["doc_id"].dataType.simpleString()

    def tokens(_, rows, __):
        return _sets(blocks.one_column(rows, "text"), n), None

    counted = blocks.post(source.drop("doc_id"), tokens, bits, stretch, True, True, "join-counts")

    def prefixes(batches):
        for block, rows in blocks.runs(batches, stretch):
            keys, _, counts = blocks.receive(counted, block, bits, short=True)
            texts = blocks.one_column(rows, "text")
            # By slabs: only the answers are held for the whole block, not its sets.
            for lo, hi in _slabs(texts):
                grams, other, offsets = _slab_sets(texts.slice(lo, hi - lo), n, 2)
                names = _nodes([grams, other], offsets)
                short = blocks.short_key(grams, bits)
                df = np.ones(len(grams), np.int64)
                if len(keys):
                    at = np.searchsorted(keys, short)
                    at[at == len(keys)] = 0
                    hit = keys[at] == short
                    df[hit] = counts[at[hit]]
                out: dict[str, list] = {"n": [], "node": [], "matches": [], "tokens": []}
                for i in range(hi - lo):
                    s, d = grams[offsets[i] : offsets[i + 1]], df[offsets[i] : offsets[i + 1]]
                    out["n"].append(len(s))
                    if not len(s):
                        out["node"].append(None)
                        out["matches"].append(0)
                        out["tokens"].append([])
                        continue
                    out["node"].append(names[i])
                    order = np.lexsort((s, d))
                    length, matches = prefix(d[order], -(-per_cent * len(s) // 100))
                    picked = order[:length]
                    out["matches"].append(matches)
                    out["tokens"].append(s[picked[d[picked] > 1]].view(np.int64))
                yield from pa.table([
                    rows.column("doc_id").slice(lo, hi - lo), pa.array(out["n"], pa.int64()), pa.array(out["node"], pa.binary()), pa.array(out["matches"], pa.int32()),
                    pa.array(out["tokens"], pa.list_(pa.int64())), pa.array([block.file] * (hi - lo), pa.int64()), pa.array(range(block.low + lo, block.low + hi), pa.int64()),
                ], names=["doc_id", "n", "node", "matches", "tokens", "file", "at"]).to_batches()

    rows = common.settle(source.mapInArrow(common.tidy(prefixes), _PREFIX.format(kind=kind)), "join-prefixes")
    common.discard(counted)
    place = F.struct("file", "at")
    reps = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("matches").alias("matches"), F.first("tokens").alias("tokens"), F.min(place).alias("place")
    )
    reps = common.settle(reps, "join-nodes")
    clusters = components(_candidates(reps))
    wanted = common.settle(clusters.join(reps.select("node", "n", "place"), "node").select("node", "component", "n", "place.*"), "join-clusters")
    path = common.scratch(spark, "join-wanted")
    wanted.select(blocks.part_of("file", "at", stretch).alias("part"), "at", "node").repartition("part").write.partitionBy("part").parquet(path)

    def fetch(batches):
        for block, rows in blocks.runs(batches, stretch):
            found = _wanted(path, block)
            if not found:
                continue
            at = sorted(found)
            texts = blocks.one_column(rows.take(pa.array(at, pa.int64())), "text")
            for lo, hi in _slabs(texts):
                grams, offsets = _slab_sets(texts.slice(lo, hi - lo), n, 1)
                for first in range(lo, hi, 256):
                    some = range(first, min(first + 256, hi))
                    yield pa.RecordBatch.from_arrays([pa.array([found[at[i]] for i in some], pa.binary()), pa.array([grams[offsets[i - lo] : offsets[i - lo + 1]].tobytes() for i in some], pa.binary())], names=["node", "tokens"])

    sets = common.settle(source.drop("doc_id").mapInArrow(common.tidy(fetch), "node binary, tokens binary"), "join-sets")
    links = common.settle(_compare(sets, wanted.select("node", "component", "n"), per_cent), "join-links")
    joined = components(links)
    labelled = reps.select("node", "doc_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("least"))
    labels = common.settle(labelled.select("node", "component").join(least, "component"), "join-labels")
    out = rows.select("doc_id", "n", "node", "file", "at").join(labels, "node", "left")
    return out.select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        F.col("component").alias("__class"), F.struct("file", "at").alias("__copy"),
    )


def _wanted(path: str, block: blocks.Block) -> dict[int, bytes]:
    """Nodes of the wanted rows of a block, by place in it."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, root = common.open_fs(path)
    out: dict[int, bytes] = {}
    for x in files.get_file_info(fs.FileSelector(f"{root}/part={block.part}", allow_not_found=True)):
        if x.path.endswith(".parquet"):
            with files.open_input_file(x.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(65536, columns=["at", "node"]):
                    at, node = batch.column(0).to_numpy(), batch.column(1)
                    for i in np.flatnonzero((at >= block.low) & (at <= block.high)).tolist():
                        out[int(at[i]) - block.low] = node[i].as_py()
    return out


def keep_one(docs: DataFrame, n: int = 5, per_cent: int = 80, is_scan: bool = False) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component, its smallest doc_id's row.

    Of rows with that doc_id and component, one is kept (the least text, then any). Texts
    without a set are all kept.
    """
    source = docs if is_scan else blocks.stable(docs)
    sizes = blocks.measure(source)
    found = near_duplicates(source, n, per_cent, is_scan=True, sizes=sizes)
    linked = found.where("__class IS NOT NULL")
    best = linked.groupBy("__class").agg(F.min_by("__copy", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), "__copy")).alias("__copy"))
    kept = best.select("__copy.*").unionByName(found.where("__class IS NULL").select("__copy.*"))
    path = common.scratch(docs.sparkSession, "join-kept")
    kept.select(blocks.part_of("file", "at", sizes[1]).alias("part"), "at", F.lit(b"").alias("node")).repartition("part").write.partitionBy("part").parquet(path)

    def run(batches):
        for block, rows in blocks.runs(batches, sizes[1]):
            at = sorted(_wanted(path, block))
            if at:
                yield from rows.take(pa.array(at, pa.int64())).to_batches()

    return common.map_rows(blocks.named(source), run, source.schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: 3-word shingles, 90 per cent."""
    return near_duplicates(docs, 3, 90, is_scan=True).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS x, c.doc_id AS y, count(*) AS o FROM s a JOIN s c ON a.g = c.g AND a.doc_id < c.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON r.d = e.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r.c), w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN r ON w.doc_id = r.d GROUP BY w.doc_id
"""
