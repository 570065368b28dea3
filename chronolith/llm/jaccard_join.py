"""Exact n-gram Jaccard self-join with a token-group matrix.

Texts become sets of hashed word shingles; equal sets are one class from the start, known by 128 bits of their tokens. The join
then runs over classes:

1. Similar classes are partitioned into groups: classes that share a band of minimum hashes meet two of the band, the one with the fewest
   rare tokens, as the text that copies were made from has, and the last; links that hold are kept, and connected classes are one
   cluster, dealt into groups of about GROUP classes. A cluster of thousands of near copies thus takes a few pairs a copy.
2. Tokens get one order over the table: rare ones by hash, frequent ones after them by frequency, all counted over all classes. Sets
   of n and m tokens link when they share need(n, m) = ceil(t / (1 + t) * (n + m)) of them. The first token in that order that they
   share then stands so early that need(n, m) tokens are left in both from there on; so only the first n - ceil(t * n) + 1 tokens of a
   set matter, the fewer the closer the sizes are.
3. The matrix holds, for each such token, the groups whose union has it, with the least size and the most tokens left of their members
   there. That bounds the overlap of a class with every member of the group; groups that miss the bound are never opened.
4. In a qualifying group, the members that themselves meet the bound are compared with the class exactly, token by token.

No link between different sets is lost: a link lies inside a cluster, or its first shared token opens the group and names the member.
Tokens move as packed integers by ranges of token hashes, sorted in numpy; a list is met in pieces of PIECES pairs. Near copies of one
text that differ by more than t allows have mostly rare tokens of their own first, so they don't meet at all. Joins that a hub
could skew are Spark's skew-aware sort-merge joins. Frequent tokens are broadcast up to MOST_FREQUENT of them: beyond, the frequency
from which a token counts as frequent doubles until they fit, which keeps the order total and the result exact.

Nulls, empty texts and texts without words have no shingle and link with nothing; fewer words than the width make one
shingle; repeated rows are equal sets, so linked; an empty table gives no rows; rows of one id keep their rows. Input columns
with the names of the results are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .runtime import drop_path, give_back, map_text, release, small_batches, stage_path, staged, tidy

WIDTH, PERCENT = 4, 85
BANDS, ROWS = 6, 3
#: Classes of a group, about.
GROUP = 32
#: A token of this many classes is frequent; doubled until no more than MOST_FREQUENT are (16 bytes each, broadcast).
FREQUENT, MOST_FREQUENT = 8, 1_000_000
#: Tokens that a task packs before it hands them on, tokens of one range, and pairs looked at together.
PACK, RANGE, PIECES = 500_000, 1_000_000, 1_000_000
#: Ids broadcast at most (8 bytes each) to pick sets for comparison; more are joined by a shuffle.
MOST_IDS = 1_000_000
#: Files of narrow staged tables for each core, and of those that wide rows are worked into.
FILES, WORKED = 2, 4
#: Rows of an Arrow batch; a row holds the tokens of a text or two, or packed tokens of a range.
BATCH_ROWS, BLOBS = 200, 100


def ceil_part(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that linked sets of n and m tokens share at least."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers byte by byte: the leading bytes of small ones are zeros that compress."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()


def packed_set(tokens: np.ndarray) -> bytes:
    """The leading 48 bits of sorted 64-bit hashes, the first 32 of them as steps: two chances in a billion that some pair of unequal
    tokens of two texts of 500 words is taken for equal."""
    return planes(np.diff((tokens >> np.uint64(32)).astype(np.uint32), prepend=np.uint32(0))) + (tokens >> np.uint64(16)).astype("<u2").tobytes()


def unpacked_set(raw) -> np.ndarray:
    n = len(raw) // 6
    return (np.cumsum(from_planes(raw, n), dtype=np.uint64) << np.uint64(16)) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64)


def shingle_table(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n, key (of equal sets, null without shingles), bands and tokens (null where the task has had the set), and row (one for each)."""

    def make():
        odd = np.random.default_rng(11).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
        seen: set[bytes] = set()

        def kernel(data, offsets):
            flat, at = K.shingle_sets(data, offsets, width)
            n = np.diff(at)
            keys, tokens, fresh = [], [], np.zeros(len(n), bool)
            for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if a == b:
                    keys.append(None)
                    tokens.append(None)
                    continue
                key = blake2b(flat[a:b].tobytes(), digest_size=16).digest()
                keys.append(key)
                fresh[i] = key not in seen
                tokens.append(packed_set(flat[a:b]) if fresh[i] else None)
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
            bands = np.zeros((len(n), BANDS), np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                low = np.stack([np.minimum.reduceat(flat * k, at[some]) for k in odd], 1).reshape(len(some), BANDS, ROWS)
                key = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    key = K.mix(key ^ low[:, :, r])
                bands[some] = K.mix(key + np.arange(BANDS, dtype=np.uint64))
            rows = [list(x) if ok else None for x, ok in zip(bands.view(np.int64).tolist(), fresh, strict=True)]
            return [n, pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64())), pa.array(tokens, pa.binary())]

        return kernel

    named = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    fields = {"n": "bigint", "key": "binary", "bands": "array<bigint>", "tokens": "binary"}
    return map_text(named, "text", fields, make, ["id"], 1 << 20).withColumn("row", F.monotonically_increasing_id())


def classes(base: DataFrame, path: str) -> DataFrame:
    """row, id, n, cid and bands: cid is the first row of equal sets (null without shingles), and that row alone has bands."""
    first_path = stage_path(base.sparkSession, "first")
    first = staged(base.where("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("key", "first"), "first", first_path, FILES)
    cid = F.when(F.col("key").isNotNull(), F.coalesce("first", "row"))
    rows = base.select("row", "id", "n", "key", "bands").join(first, "key", "left").select("row", "id", "n", cid.alias("cid"), F.when(cid == F.col("row"), F.col("bands")).alias("bands"))
    rows = staged(rows, "rows", path, FILES)
    drop_path(base.sparkSession, first_path)
    return rows


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b of classes) that link. sets: cid and tokens."""
    spark = pairs.sparkSession
    pairs_path = stage_path(spark, "pairs")
    pairs = staged(pairs, "pairs", pairs_path, WORKED)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    ids_path = stage_path(spark, "ids")
    wanted = staged(wanted, "ids", ids_path, FILES)
    if wanted.count() <= MOST_IDS:
        wanted = F.broadcast(wanted)
    some_path = stage_path(spark, "sets")
    some = staged(sets.join(wanted, "cid", "left_semi"), "sets", some_path)

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpacked_set(x.as_buffer()), unpacked_set(y.as_buffer())
                both = np.concatenate([x, y])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    both = pairs.join(some.select(F.col("cid").alias("a"), F.col("tokens").alias("x")), "a").join(some.select(F.col("cid").alias("b"), F.col("tokens").alias("y")), "b")
    links = staged(both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a bigint, b bigint"), "links", tasks=WORKED)
    for path in (pairs_path, ids_path, some_path):
        drop_path(spark, path)
    return links


def components(links: DataFrame) -> DataFrame:
    """node and label: the smallest node reachable over links (a, b). Rounds of neighbours' least labels and label jumps."""
    spark = links.sparkSession
    edges_path, path = stage_path(spark, "edges"), stage_path(spark, "labels")
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", edges_path, FILES)
    labels = staged(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels", path, FILES)
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        better = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("to"))
        better = better.join(jump, better["label"] == jump["j"], "left").select("node", F.least("label", "to").alias("label"), "old")
        new_path = stage_path(spark, "labels")
        new = staged(better, "labels", new_path, FILES)
        changed = new.where("label < old").limit(1).count()
        drop_path(spark, path)
        labels, path = new.select("node", "label"), new_path
        if not changed:
            drop_path(spark, edges_path)
            return labels


def star_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes of equal bands and two of the band: the one with the fewest rare tokens, which near copies differ from least,
    and the last. rows: cid, bands and rare."""
    band = rows.where("bands IS NOT NULL").select("cid", "rare", F.explode("bands").alias("band")).distinct()
    ends = band.groupBy("band").agg(F.min_by("cid", F.struct("rare", "cid")).alias("a"), F.min("cid").alias("first"), F.max("cid").alias("z"))
    hubs = ends.where("first < z").select("band", F.explode(F.array_distinct(F.array("a", "z"))).alias("hub"))
    pairs = band.join(hubs, "band").where("cid <> hub").select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct()
    return verify(pairs, sets, percent)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def keyed(raw, ranges: int) -> np.ndarray:
    """Tokens of a packed set as (range << 32) | 32 bits of the rest, so that keys of one range rarely collide at any size."""
    tokens = unpacked_set(raw)
    where = ((tokens >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32)
    return (where << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))


def dealt(groups, ranges: int):
    """(range, blobs) rows of keyed tokens and the columns beside them; groups: tuples of arrays, keys first."""
    columns = [np.concatenate(c) for c in zip(*groups, strict=True)]
    order = np.argsort(columns[0])
    columns = [c[order] for c in columns]
    cuts = np.searchsorted(columns[0], np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32))
    columns[0] = columns[0].astype(np.uint32)  # the range is known from the row
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), [c[cuts[k] : cuts[k + 1]].tobytes() for c in columns]


def frequent_tokens(sets: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens (keyed), sorted, and their counts."""

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                held.append(keyed(x.as_buffer(), ranges))
                size += len(held[-1])
                if size > PACK:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    def rows(held):
        # a token goes once from a pack, with its count
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        made = list(dealt([(tokens, n.astype(np.uint32))], ranges))
        for k in range(0, len(made), BLOBS):
            part = made[k : k + BLOBS]
            steps = [planes(np.diff(np.frombuffer(c[0], np.uint32), prepend=np.uint32(0))) for _, c in part]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in part], pa.int32()), pa.array(steps, pa.binary()), pa.array([c[1] for _, c in part], pa.binary())], ["r", "blob", "n"])

    def count(t: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.cumsum(from_planes(x.as_buffer(), len(x.as_buffer()) // 4), dtype=np.uint32) for x in t.column("blob")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("n")])
        order = np.argsort(tokens)
        tokens = tokens[order]
        first = starts(tokens)
        n = np.add.reduceat(n[order].astype(np.int64), first)
        often = n >= FREQUENT
        give_back()
        keys = (np.int64(t.column("r")[0].as_py()) << np.int64(32)) | tokens[first][often].astype(np.int64)
        return pa.table({"token": keys, "n": n[often].astype(np.int64)})

    counts = staged(sets.where("tokens IS NOT NULL").select("tokens").mapInArrow(tidy(pack), "r int, blob binary, n binary").groupBy("r").applyInArrow(count, "token bigint, n bigint"), "frequent", tasks=WORKED)
    level = FREQUENT
    while counts.where(F.col("n") >= level).count() > MOST_FREQUENT:
        level *= 2
    got = counts.where(F.col("n") >= level).toArrow().sort_by("token")
    return got["token"].to_numpy().astype(np.uint64), got["n"].to_numpy().astype(np.int64)


def probes(base: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int, ranges: int) -> DataFrame:
    """cid, n, rare (how many of its tokens aren't frequent) and probe (keyed tokens in their order, as many as matter)."""
    shared = base.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        hot, count = shared.value
        for batch in batches:
            out, rare = [], []
            for x in batch.column(2):
                tokens = np.sort(keyed(x.as_buffer(), ranges))
                n = len(tokens)
                rare.append(n)
                most = n - int(ceil_part(n, percent)) + 1
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                    rank = np.where(hot[at] == tokens, count[at], 0)
                    cold = np.flatnonzero(rank == 0)
                    rare[-1] = len(cold)
                    pick = cold[:most] if len(cold) >= most else np.argsort(rank, kind="stable")[:most]
                    tokens = tokens[pick]
                out.append(tokens[:most].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rare, pa.int64()), pa.array(out, pa.binary())], ["cid", "n", "rare", "probe"])

    return base.where("tokens IS NOT NULL").select(F.col("row").alias("cid"), "n", "tokens").mapInArrow(tidy(run), "cid bigint, n bigint, rare bigint, probe binary")


def meetings(size: np.ndarray, first: np.ndarray):
    """Pieces (i, j) of all pairs of an element i with the size[i] places from first[i] on, about PIECES at a time."""
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECES, "right")))
        some = size[a:b]
        before = np.cumsum(some) - some
        yield np.repeat(np.arange(a, b), some), np.repeat(first[a:b] - before, some) + np.arange(some.sum())
        a = b


def opened(token: np.ndarray, cid: np.ndarray, cluster: np.ndarray, many: np.ndarray, n: np.ndarray, left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (class, member of a group that it opens), each once, of entries (token, class, its cluster and how many classes that
    has, its size, its tokens from this one on)."""
    group = K.mix(cid.astype(np.uint64)) % ((many + GROUP - 1) // GROUP).astype(np.uint64)
    order = np.lexsort((group, cluster, token))
    token, cid, cluster, many, n, left, group = (x[order] for x in (token, cid, cluster, many, n, left, group))
    # tokens of one cluster only can't link two
    first = starts(token)
    last = np.append(first[1:], len(token)) - 1
    mixed = np.repeat(np.maximum.reduceat(cluster, first) != np.minimum.reduceat(cluster, first), last - first + 1) if len(first) else np.empty(0, bool)
    token, cid, cluster, many, n, left, group = (x[mixed] for x in (token, cid, cluster, many, n, left, group))
    if not len(token):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row = starts(token, cluster, group)  # of the matrix: a token and a group
    members = np.diff(np.append(row, len(token)))
    least, most = np.minimum.reduceat(n, row), np.maximum.reduceat(left, row)
    by_token = starts(token)
    of_token = np.repeat(np.arange(len(by_token)), np.diff(np.append(by_token, len(token))))
    row_from = np.searchsorted(row, by_token)
    row_count = np.diff(np.append(row_from, len(row)))
    found, held = [], 0
    for i, g in meetings(row_count[of_token], row_from[of_token]):
        r = row[g]
        # of two clusters, the smaller one's classes ask for groups of the larger one
        asks = (many[i] < many[r]) | ((many[i] == many[r]) & (cluster[i] < cluster[r]))
        i, g = i[asks], g[asks]
        fits = np.minimum(left[i], most[g]) >= needed(n[i], least[g], percent)
        i, g = i[fits], g[fits]
        for k, j in meetings(members[g], row[g]):
            e = i[k]
            ok = np.minimum(left[e], left[j]) >= needed(n[e], n[j], percent)
            found.append(np.stack([cid[e[ok]], cid[j[ok]]], 1))
            held += len(found[-1])
            if held > PIECES:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = 0
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def matrix_candidates(rows: DataFrame, ranges: int, percent: int) -> DataFrame:
    """(a, b): classes of different clusters whose bound lets them link. rows: cid, n, cluster, many, probe."""

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            small = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
            for c, n, g, m, x in zip(*small, batch.column(4), strict=True):
                tokens = np.frombuffer(x.as_buffer(), np.uint64)
                k = len(tokens)
                # most classes are their own cluster: the difference of the two is zero then, and zeros compress
                held.append((tokens, np.full(k, c), np.full(k, c ^ g), np.full(k, m, np.int32), np.full(k, n, np.int32), (n - np.arange(k)).astype(np.int32)))
                size += k
                if size > PACK // 2:
                    yield from blobs(held)
                    held, size = [], 0
        if held:
            yield from blobs(held)

    kinds = {"token": np.uint32, "cid": np.int64, "cluster": np.int64, "many": np.int32, "n": np.int32, "left": np.int32}

    def blobs(held):
        made = list(dealt(held, ranges))
        for k in range(0, len(made), BLOBS):
            part = made[k : k + BLOBS]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in part], pa.int32()), *[pa.array([c[j] for _, c in part], pa.binary()) for j in range(len(kinds))]], ["r", *kinds])

    def lists(t: pa.Table) -> pa.Table:
        c = {k: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(k)]) for k, kind in kinds.items()}
        a, b = opened(c["token"], c["cid"], c["cid"] ^ c["cluster"], *(c[k].astype(np.int64) for k in ("many", "n", "left")), percent)
        give_back()
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    packed = rows.select("cid", "n", "cluster", "many", "probe").mapInArrow(tidy(pack), ", ".join(["r int", *(f"{k} binary" for k in kinds)]))
    return packed.groupBy("r").applyInArrow(lists, "a bigint, b bigint").distinct()


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles and component_id: the smallest id reachable over links of at least percent Jaccard, itself included."""
    with small_batches(df.sparkSession, BATCH_ROWS):
        return _components(df, id_col, text_col, width, percent)


def _components(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    spark = df.sparkSession
    paths = {name: stage_path(spark, name) for name in ("shingles", "rows", "probes")}
    base = staged(shingle_table(df, id_col, text_col, width), "shingles", paths["shingles"])
    rows = classes(base, paths["rows"])
    own = rows.where("cid = row").select("cid")
    sets = base.where("tokens IS NOT NULL").select(F.col("row").alias("cid"), "tokens")
    total = base.where("tokens IS NOT NULL").agg(F.sum("n")).first()[0] or 0
    ranges = max(16, int(total // RANGE))
    frequent = frequent_tokens(base, ranges)
    release(spark)
    probe = staged(probes(base, frequent, percent, ranges), "probes", paths["probes"])
    stars = star_links(rows.where("bands IS NOT NULL").join(probe.select("cid", "rare"), "cid"), sets, percent)
    cluster = components(stars).select(F.col("node").alias("cid"), F.col("label").alias("cluster"))
    sizes = staged(cluster.groupBy("cluster").agg(F.count("*").alias("many")), "sizes", tasks=FILES)
    cluster = cluster.join(sizes, "cluster")
    cluster = staged(own.join(cluster, "cid", "left").select("cid", F.coalesce("cluster", "cid").alias("cluster"), F.coalesce("many", F.lit(1)).alias("many")), "clusters", tasks=FILES)
    release(spark)
    probe = probe.join(cluster, "cid")
    links = stars.unionByName(verify(matrix_candidates(probe, ranges, percent), sets, percent))
    drop_path(spark, paths["probes"])
    drop_path(spark, paths["shingles"])
    release(spark)
    whole = components(links).select(F.col("node").alias("cid"), "label")
    marked = staged(rows.select("id", "n", "cid").join(whole, "cid", "left").select("id", "n", F.coalesce("label", "cid").alias("label")), "marked", tasks=FILES)
    drop_path(spark, paths["rows"])
    least = marked.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least"))
    out = marked.join(staged(least, "least", tasks=FILES), "label", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of df of each component, all columns as they were: that with the smallest id, null ids last; of rows that share it,
    any one. Rows are told apart by a key of their own, which is staged with them."""
    rows = staged(df.withColumn("__key", F.monotonically_increasing_id()), "rows")
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__key").alias("key"))
    marks = link_components(rows.select(first.alias("__first"), F.col(text_col).alias("text")), "__first", "text", width, percent)
    gone = staged(marks.where(F.col("__first.key") != F.col("component_id.key")).select(F.col("__first.key").alias("__key")), "gone", tasks=FILES)
    if gone.count() <= MOST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, "__key", "left_anti").select(*df.columns)


def oracle_sql(width: int = WIDTH, percent: int = PERCENT) -> str:
    """The same rows by brute force over shared shingles, for small tables."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {width - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {width - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS root FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.root),
m AS (SELECT doc_id, min(root) AS least FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id"""
