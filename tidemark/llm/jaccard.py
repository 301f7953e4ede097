"""N-gram Jaccard join by grouped prefixes: sets of word shingles, links above a similarity, components.

1. Every document's set of shingle hashes is summed up as size and a 128-bit signature; equal sets fold.
2. A global order puts shingles that many documents share last. Documents that link must share a shingle of
   their prefixes, the first n - ceil(t n) + 1 shingles in that order.
3. Sets with identical prefix and size form a group. Groups that share a prefix shingle are compared with the
   first group of the block, members with their group's first, verified exactly on the full sets; components follow.
4. In blocks of more than PIVOTS sets that still hold several components, each set meets up to PIVOTS sets of the block.
   So a large group of near copies, of which many link, falls into one component and a few others.
5. Blocks that still hold several components give the pairs across components, so no link between components is
   lost. Those of up to SMALL sets are joined and verified; larger ones are compared in tiles inside a worker, first on
   prefixes, then the sets that have a likely partner on their whole sets. Only a spanning forest of a tile's links
   comes out, never all its pairs.

The order is a heuristic that any choice leaves exact: shingles seen twice or more in a slice of documents
are counted over all documents, and the most common ones (at most MAX_COMMON, the size of a broadcast) go last.

Defined cases: a text with fewer words than a shingle is one shingle; without words (or null) it is empty and
links with nothing; null ids link with nothing; repeated rows share their component; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, rows_of, table
from .hashing import B1, B2, U, byte_slices, key_groups, mix, row_slices, signed, word_codes, word_windows

WORDS, PERCENT = 5, 80
COMMON, MAX_COMMON, SLICE = 16, 1_000_000, 8192
#: Sets of a block whose pairs are joined; rows of a tile of larger blocks, and the keys of its sets.
SMALL, TILE, TILE_KEYS = 64, 512, 1_000_000
#: Sets of a large block that all its others meet before pairs across components are made.
PIVOTS = 8


def shingles(texts: pa.BinaryArray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII letters lower-cased, words parted by ASCII white space."""
    codes, at = word_codes(texts, lower=True)
    whole, out = word_windows(codes, size), []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        s = np.sort(whole[i : j - size + 1] if j - i >= size else word_windows(codes[i:j], j - i) if j > i else whole[:0])
        out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return out


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0, U)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(signed(flat)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, n, s1, s2) for documents and (token, df) for shingles met twice in a slice."""

    def run(batches):
        kept, held, size_held = [], 0, 0

        def counts():
            tokens, df = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, U), np.zeros(0, np.int64))
            tokens, df = tokens[df > 1], df[df > 1]
            for at in range(0, len(tokens), 50_000):
                n = len(tokens[at : at + 50_000])
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(signed(tokens[at : at + n])), pa.array(df[at : at + n].astype(np.int64))], names=names)

        names = ["doc_id", "n", "s1", "s2", "token", "df"]
        for b in byte_slices(batches, 1):
            sets = shingles(b.column(1), size)
            n = np.array([len(s) for s in sets], np.int64)
            flat, ends = np.concatenate(sets), np.cumsum(n)
            s1, s2 = (np.diff(np.append(U(0), np.append(U(0), np.cumsum(mix(flat ^ salt)))[ends])) for salt in (B1, B2))
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2)), none, none], names=names)
            kept += sets
            held += len(sets)
            size_held += len(flat)
            if held >= SLICE or size_held > 8_000_000:
                yield from counts()
                kept, held, size_held = [], 0, 0
        yield from counts()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, token long, df long")


def prefixes(docs: DataFrame, size: int, percent: int, common, ranks) -> DataFrame:
    """(doc_id, n, prefix): the first shingles in the global order, as ascending unsigned keys.

    A shingle's key is its hash without the lowest bit, or 2^63 + rank for the common ones (common: sorted hashes).
    """

    def run(batches):
        table_, order = common.value, ranks.value
        for b in byte_slices(batches, 1):
            sets = shingles(b.column(1), size)
            n = [len(s) for s in sets]
            flat = np.concatenate(sets)
            keys = flat >> U(1)
            if len(table_):
                at = np.minimum(np.searchsorted(table_, flat), len(table_) - 1)
                hit = table_[at] == flat
                keys[hit] = U(1 << 63) + order[at[hit]].astype(U)
            rows, at = [], 0
            for k in n:
                rows.append(np.sort(keys[at : at + k])[: prefix_length(k, percent)] if k else keys[:0])
                at += k
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), _lists(rows)], names=["doc_id", "n", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, prefix array<long>")


def _may(p: np.ndarray, q: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether two prefixes, in the global order, of sets of n and m shingles allow the similarity."""
    last = min(p[-1], q[-1])
    i, j = np.searchsorted(p, last, "right"), np.searchsorted(q, last, "right")
    both = np.concatenate([p[:i], q[:j]])
    both.sort()
    most = int((both[1:] == both[:-1]).sum()) + min(n - i, m - j)
    return (100 + percent) * most >= percent * (n + m)


def _do(p: np.ndarray, q: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether two whole sets have the similarity."""
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (n + m - both)


def may_link(pairs: DataFrame, prefixed: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose prefixes allow the similarity.

    Up to the lesser of the last keys both prefixes are complete: what one has there and the other lacks is lost
    to the intersection.
    """
    left = prefixed.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    right = prefixed.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))

    def run(batches):
        for batch in row_slices(batches, 4096):
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            x, y = batch.column(4), batch.column(5)
            xo, yo, xv, yv = x.offsets.to_numpy(), y.offsets.to_numpy(), x.values.to_numpy().view(U), y.values.to_numpy().view(U)
            keep = [_may(xv[xo[k] : xo[k + 1]], yv[yo[k] : yo[k + 1]], na[k], nb[k], percent) for k in range(batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb")
    return joined.mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for b in byte_slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(shingles(b.column(1), size))], names=["doc", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc long, tokens array<long>")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose sets meet the similarity, exactly."""
    left = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("tb"))

    def run(batches):
        for batch in row_slices(batches, 1024):
            x, y = batch.column(2), batch.column(3)
            xo, yo, xv, yv = x.offsets.to_numpy(), y.offsets.to_numpy(), x.values.to_numpy(), y.values.to_numpy()
            keep = [_do(xv[xo[k] : xo[k + 1]], yv[yo[k] : yo[k + 1]], xo[k + 1] - xo[k], yo[k + 1] - yo[k], percent) for k in range(batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    # the first set of a block stands in many pairs: the other side is joined first, so each set moves once or twice
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long")


def overlaps(x: list[np.ndarray], y: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many keys each set of x has in common with each of y."""
    out, flat = np.zeros((len(x), len(y)), np.int64), [np.concatenate(sets) for sets in (x, y)]
    both, cells = np.intersect1d(*flat), []
    if not len(both):
        return out
    for sets, keys in zip((x, y), flat):
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.minimum(np.searchsorted(both, keys), len(both) - 1)
        hit = np.flatnonzero(both[at] == keys)
        hit = hit[np.argsort(at[hit], kind="stable")]
        cells.append((row[hit], at[hit]))
    for start in range(0, len(both), columns):
        width, parts = min(columns, len(both) - start), []
        for sets, (row, at) in zip((x, y), cells):
            i, j = np.searchsorted(at, (start, start + width))
            parts.append(np.zeros((len(sets), width), np.float32))
            parts[-1][row[i:j], at[i:j] - start] = 1
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what the symmetric matrix of links connects, fewer than it has rows."""
    new, out = np.ones(len(near), bool), []
    for k in range(len(near)):
        reached = [k] if new[k] else []
        new[k] = False
        while reached:
            a = reached.pop()
            more = np.flatnonzero(near[a] & new)
            new[more] = False
            reached += more.tolist()
            out += [(a, b) for b in more.tolist()]
    return out


def tile_pairs(rows: DataFrame, percent: int, whole, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """(a, b): links between ids of one block and different components c, enough to connect all that such links connect.

    rows(block, id, n, left, c, keys): left is what the set has from the block's shingle on, keys its prefix in the global
    order. whole(ids) gives the whole sets (doc, tokens). A block is cut into tiles, and each pair of tiles compared in
    a worker; the largest component of a block has tiles of its own, which are not compared with each other.
    """
    rows = scratch.put(rows, "large")
    kinds = rows.groupBy(F.col("block").alias("block_"), F.col("c").alias("c_")).agg(F.count("*").alias("m"), F.sum("n").alias("keys_"))
    tops = kinds.groupBy("block_").agg(F.max(F.struct("m", "keys_", "c_")).alias("top"), F.sum("m").alias("m"), F.sum("keys_").alias("keys_"))
    cut = lambda m, keys: F.ceil(F.greatest(m / tile, keys / TILE_KEYS)).cast("int")
    tops = tops.select("block_", F.col("top.c_").alias("top"), cut(F.col("top.m"), F.col("top.keys_")).alias("t"), cut(F.col("m") - F.col("top.m"), F.col("keys_") - F.col("top.keys_")).alias("u"))
    tops = scratch.put(tops, "tops")
    mine = F.col("c") == F.col("top")
    placed = rows.join(tops, F.col("block") == F.col("block_")).where("u > 0")
    placed = placed.withColumn("own", F.when(mine, F.pmod(F.xxhash64("id"), "t")).otherwise(F.col("t") + F.pmod(F.xxhash64("id"), "u")).cast("int"))
    placed = placed.withColumn("k", F.explode(F.sequence(F.when(mine, F.col("t")).otherwise(F.lit(0)), F.col("t") + F.col("u") - 1)))
    placed = placed.select("block", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "id", "n", "left", "c", "keys")

    def sides(g, keys):
        """The places of both tiles' rows in the group, and their keys."""
        own, (i, j) = g["own"].to_numpy(), (g[c][0].as_py() for c in "ij")
        offsets, values = g[keys].offsets.to_numpy(), g[keys].values.to_numpy().view(U)
        for k in (i, j):
            at = np.flatnonzero(own == k)
            yield at, [values[offsets[r] : offsets[r + 1]] for r in at.tolist()]

    def likely(batches):
        for g in key_groups(batches, ("block", "i", "j")):
            (x, kx), (y, ky) = sides(g, "keys")
            if not len(x) or not len(y):
                continue
            n, left, c = (g[k].to_numpy() for k in ("n", "left", "c"))
            both = n[x][:, None] + n[y][None, :]
            may = (c[x][:, None] != c[y][None, :]) & ((100 + percent) * np.minimum(left[x][:, None], left[y][None, :]) >= percent * both)
            if may.any():  # a pair is taken in the block of the first key that both have
                block = g["block"].to_numpy().view(U)[0]
                may &= overlaps([k[: np.searchsorted(k, block)] for k in kx], [k[: np.searchsorted(k, block)] for k in ky]) == 0
            if may.any():  # up to the lesser of the last keys both prefixes are complete
                lx, ly = np.array([k[-1] for k in kx], U), np.array([k[-1] for k in ky], U)
                i, j = (np.array([np.searchsorted(k, last, "right") for k in keys]) for keys, last in ((kx, ly), (ky, lx)))
                may &= (100 + percent) * (overlaps(kx, ky) + np.minimum(n[x][:, None] - i, n[y][None, :] - j.T)) >= percent * both
            hit = np.union1d(x[may.any(1)], y[may.any(0)])
            if len(hit):
                yield g.take(pa.array(hit)).select(["block", "i", "j", "own", "id", "c"])

    def linked(batches):
        for g in key_groups(batches, ("block", "i", "j")):
            (x, kx), (y, ky) = sides(g, "tokens")
            if not len(x) or not len(y):
                continue
            ids, c, both = g["id"].to_numpy(), g["c"].to_numpy(), overlaps(kx, ky)
            n, m = np.array([len(k) for k in kx])[:, None], np.array([len(k) for k in ky])[None, :]
            near = np.zeros((len(ids), len(ids)), bool)
            near[np.ix_(x, y)] = (c[x][:, None] != c[y][None, :]) & (100 * both >= percent * (n + m - both))
            if found := forest(near | near.T):
                a, b = zip(*((min(ids[p], ids[q]), max(ids[p], ids[q])) for p, q in found))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    grouped = lambda df: df.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    chosen = scratch.put(grouped(placed).mapInArrow(likely, "block long, i int, j int, own int, id long, c long"), "chosen")
    sets = whole(chosen.select(F.col("id").alias("a")).distinct())
    links = grouped(chosen.join(sets, F.col("id") == F.col("doc")).drop("doc")).mapInArrow(linked, "a long, b long")
    links = scratch.put(links.distinct(), "tiled")
    scratch.drop("large", "tops", "chosen")
    return links


def components(spark: SparkSession, docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text)."""
    scratch = Scratch(spark, "jaccard")
    both = scratch.put(signatures(docs, size), "signatures")
    sums = scratch.put(both.where("n IS NOT NULL").select("doc_id", "n", "s1", "s2"), "sums")
    counted = scratch.put(both.where("token IS NOT NULL").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= COMMON), "common")
    # as many powers of two of df, from the top, as MAX_COMMON rows hold: that many come to the driver and go out, 12 MB
    least, held = COMMON, 0
    for row in counted.groupBy(F.floor(F.log2("df")).alias("k")).count().orderBy(F.desc("k")).collect():
        held += row["count"]
        if held > MAX_COMMON:
            least = 1 << (row["k"] + 1)
            break
    top = counted.where(F.col("df") >= least).toArrow()
    tokens = top["token"].to_numpy().view(np.uint64)
    order = np.lexsort((tokens, top["df"].to_numpy()))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    by_hash = np.argsort(tokens)
    common, ranks = spark.sparkContext.broadcast(tokens[by_hash]), spark.sparkContext.broadcast(rank[by_hash])

    reps = sums.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    reps = scratch.put(reps, "reps")
    first = prefixes(docs, size, percent, common, ranks).where("n > 0 AND doc_id IS NOT NULL")
    first = first.join(reps.select(F.col("rep").alias("__rep")), F.col("doc_id") == F.col("__rep"), "left_semi").dropDuplicates(["doc_id"])
    # groups: same size and prefix; the key is 128 bits of the prefix
    first = scratch.put(first.withColumn("p1", F.xxhash64("prefix")).withColumn("p2", F.xxhash64(F.lit(1), F.reverse("prefix"))), "prefixes")
    groups = scratch.put(first.groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("gid"), F.count("*").alias("members")), "groups")
    members = first.select("doc_id", "n", "p1", "p2").join(groups, ["n", "p1", "p2"]).select(F.col("doc_id").alias("member"), "gid", "members")
    members = scratch.put(members, "members")
    # rows of blocks: a set's key at a place of its prefix. If the key is the first that two sets share, the
    # intersection is no larger than what either has from there on; a pair is taken where that is enough.
    rows = first.drop("n").join(groups.select("gid", "n", "members"), F.col("doc_id") == F.col("gid")).select("gid", "n", "members", F.posexplode("prefix").alias("at", "token"))
    rows = rows.select("token", "gid", F.col("n").cast("int").alias("n"), (F.col("n") - F.col("at")).cast("int").alias("left"), (F.col("members") > 1).alias("several"))
    lead = rows.groupBy("token").agg(F.min(F.struct("gid", "n", "left")).alias("lead"), F.max("gid").alias("last"), F.max("several").alias("several")).where("lead.gid <> last OR several")
    lead = scratch.put(lead.select("token", F.col("lead.gid").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.left").alias("lead_left")), "leads")
    blocks = scratch.put(rows.join(lead.withColumnRenamed("token", "__t"), F.col("token") == F.col("__t")).drop("__t", "several"), "blocks")
    scratch.drop("signatures", "leads")
    fits = lambda n, left, m, right: (100 + percent) * F.least(left, right) >= percent * (F.col(n) + F.col(m))

    # first candidates: each group with its block's first group, each member with its group's first
    with_lead = blocks.where((F.col("gid") != F.col("lead")) & fits("n", "left", "lead_n", "lead_left")).select(F.col("gid").alias("a"), F.col("lead").alias("b"))
    within = members.where("member <> gid").select(F.col("member").alias("a"), F.col("gid").alias("b"))
    pairs = scratch.put(with_lead.distinct().union(within), "pairs")

    def whole(ids: DataFrame, k) -> DataFrame:
        ids = scratch.put(ids, f"concerned{k}")
        return scratch.put(sets_of(rows_of(docs.select("doc_id", "text"), ids).dropDuplicates(["doc_id"]), size), f"sets{k}")

    def linked(candidates: DataFrame, k: int) -> DataFrame:
        likely = scratch.put(may_link(candidates, first, percent), f"likely{k}")
        sets = whole(likely.select("a").union(likely.select("b")).distinct(), k)
        links = scratch.put(verify(likely, sets, percent), f"links{k}")
        scratch.drop(f"sets{k}", f"likely{k}")
        return links

    def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
        edges = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)
        return connected_components(spark, edges, Scratch(spark, "jaccard-parts"))

    def several(parts: DataFrame, k: int) -> DataFrame:
        """(token, id, n, left, c, size): members of the blocks that hold several components."""
        label = members.join(parts, F.col("member") == F.col("node"), "left").select(F.col("member").alias("id"), F.col("gid").alias("g"), F.coalesce("component", "member").alias("c"))
        label = scratch.put(label, f"labels{k}")
        ends = scratch.put(label.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), f"spread{k}")
        still = blocks.join(ends, F.col("gid") == F.col("g")).groupBy(F.col("token").alias("t")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("t")
        still = scratch.put(still, f"still{k}")
        held = blocks.join(still, F.col("token") == F.col("t"), "left_semi").join(label, F.col("gid") == F.col("g")).select("token", "id", "n", "left", "c")
        held = scratch.put(held, f"held{k}")
        sizes = scratch.put(held.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("size")), f"sizes{k}")
        held = scratch.put(held.join(sizes, F.col("token") == F.col("t")).drop("t"), f"open{k}")
        scratch.drop(f"labels{k}", f"spread{k}", f"still{k}", f"held{k}", f"sizes{k}")
        return held

    parts = connected_components(spark, linked(pairs, 1), scratch)
    apart = (F.col("ca") != F.col("cb")) & fits("na", "lefta", "nb", "leftb")
    side = lambda df, k: df.select(F.col("token").alias(f"t{k}"), F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("left").alias(f"left{k}"), F.col("c").alias(f"c{k}"))
    new = lambda found, *told: reduce(lambda x, y: x.join(y, ["a", "b"], "left_anti"), told, found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # large blocks of several components: the sets meet some of their block, the same ones in blocks that are alike
    held = several(parts, 1)
    big = held.where(F.col("size") > PIVOTS)
    pivots = big.groupBy("token", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("slice")).agg(F.min(F.struct("id", "n", "left", "c")).alias("one")).select("token", "one.*")
    pivots = scratch.put(pivots, "pivots")
    tried = scratch.put(new(side(big, "a").join(side(pivots, "b"), (F.col("ta") == F.col("tb")) & apart), pairs), "tried")
    if tried.head(1):
        parts = joined(parts, linked(tried, 2))
        held = several(parts, 2)

    # rest: members of one block that are in different components
    small = held.where(F.col("size") <= SMALL)
    rest = side(small, "a").join(side(small, "b"), (F.col("ta") == F.col("tb")) & (F.col("a") < F.col("b")) & apart)
    more = linked(scratch.put(new(rest, pairs, tried), "rest"), 3)
    large = held.where(F.col("size") > SMALL).join(first.select("doc_id", F.col("prefix").alias("keys")), F.col("id") == F.col("doc_id"))
    large = large.select(F.col("token").alias("block"), "id", F.col("n").cast("long").alias("n"), F.col("left").cast("long").alias("left"), "c", "keys")
    more = more.union(tile_pairs(large, percent, lambda ids: whole(ids, 4), scratch))
    scratch.drop("blocks", "open1", "open2", "pivots", "tried", "rest")
    if more.head(1):
        parts = joined(parts, more)
    out = scratch.put(reps.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("__n"), F.col("s1").alias("__1"), F.col("s2").alias("__2"), F.coalesce("component", "rep").alias("__c")), "result")
    done = sums.join(out, (F.col("n") == F.col("__n")) & (F.col("s1") == F.col("__1")) & (F.col("s2") == F.col("__2")), "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("__c", "doc_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each group of linked documents, that of the smallest doc_id; columns as they are.

    Rows are compared by their texts: those that share an id fold only where the texts are equal or linked.
    Texts without words fold with equal ones of their id only; rows without an id are in no group and stay.
    """
    scratch = Scratch(spark, "keep")
    rows = docs.where("doc_id IS NOT NULL").select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))  # an id and a text
    ids = rows.select("key", "doc_id").distinct()
    groups = components(spark, rows.select(F.col("key").alias("doc_id"), "text"), size, percent)
    groups = groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("c")).distinct()
    first = groups.join(ids, "key").groupBy("c").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    first = scratch.put(first.select(F.col("first.key").alias("first_")), "first")
    left = rows.join(first, F.col("key") == F.col("first_"), "left_semi").select("key", "row").dropDuplicates(["key"])
    return left.select("row.*").union(docs.where("doc_id IS NULL"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, table(spark, sf_dir, "documents"), size=4, percent=85)
