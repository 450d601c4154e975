"""Jaccard join of documents on sets of word shingles, exact at any threshold.

Which documents meet: the shingles of a set are put in one order (those frequent in the corpus last), and two sets of
sufficient similarity share one among the first ``n - ceil(t n) + 1`` of each. How they are compared: in tiles of sets of
similar size, first by hashed bitmaps, whose bit counts bound the overlap from above, then by exact intersection of
the sorted arrays. Equal sets are one set throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellrank.llm.common import components, flat, mixed, relieved, shingle_sets, steps, trimmed, written

#: Sets of a group that is one tile; of a larger group's tile the sets that stay in their cut, and those that visit it.
TILE = 256
#: A shingle that is found in this share of all documents or more (counting portions where eight or more have it) comes last in the order.
#: At most average set size / share shingles are that frequent.
FREQUENT_SHARE = 1 / 1000
#: Times that each group is compared with some of its sets, before what is left is compared in tiles; one set, and so many for groups of over 64.
HUB_ROUNDS, HUBS = 1, 4
#: Candidate pairs for each set of a tile, up to which the pairs leave the tile; with more of them, their sets come to the tile.
DENSE = 2
#: Words of bitmaps that are compared at a time, and pairs that a tile holds or looks up at a time.
MAP_WORDS, HELD_PAIRS = 1 << 18, 1 << 16


def _sets(texts: pa.Array, width: int):
    trimmed()
    data, offsets = flat(texts)
    for a, b in steps(offsets):
        yield a, b, shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)


def _identity(s: np.ndarray) -> int:
    """64 bits for the set; sets are compared exactly wherever it matters, so a chance agreement needs equal sizes and sums too."""
    both = np.bitwise_xor.reduce(s, keepdims=True) * np.uint64(3) + s.sum(keepdims=True) + np.uint64(len(s))
    return int(mixed(both).view(np.int64)[0])


def _bitmap(s: np.ndarray) -> bytes:
    """A bitmap of four bits for each member, rounded up to a power of two of at least 256."""
    bits = max(256, 4 << max(0, len(s) - 1).bit_length())
    mask = np.zeros(bits, bool)
    mask[(s >> np.uint64(17)) & np.uint64(bits - 1)] = True
    return np.packbits(mask, bitorder="little").tobytes()


def _summaries(batches, width):
    """A row per document (identity, size, bitmap), and the shingles that at least eight texts of a portion share, with that count."""
    for batch in batches:
        seen: list[np.ndarray] = []
        ids = batch.column(0)
        for a, b, sets in _sets(batch.column(1), width):
            full = [s if len(s) else None for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a), pa.array([None if s is None else _identity(s) for s in full], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([None if s is None else _bitmap(s) for s in full], pa.binary()), none, none,
                ],
                SUMMARY,
            )
            seen += sets
            if sum(map(len, seen)) > 1 << 20:
                yield _shared(seen)
                seen = []
        yield _shared(seen)


SUMMARY = ["doc_id", "id", "n", "bitmap", "shingle", "count"]


def _shared(seen: list[np.ndarray]) -> pa.RecordBatch:
    h = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
    often = np.flatnonzero(h[7:] == h[:-7]) if len(h) > 7 else np.zeros(0, np.int64)
    keys = np.unique(h[often])
    count = np.searchsorted(h, keys, "right") - np.searchsorted(h, keys)
    none = pa.nulls(len(keys), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(count, pa.int64())], SUMMARY)


def _least_overlap(a, b, percent):
    """The smallest overlap with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _least_shared(n: int, rare: int, lead: int, percent: int) -> int:
    """How many of its leading shingles a set shares with other sets' leading ones if it has a link.

    At most (100 - percent) % of its members are missing in a linked set, even if all of them are rare ones, and the lead is a random sample of
    the rare ones (their order is that of their hashes), of which the other set's lead may end a little earlier. The number is the largest that a sample
    falls below with a probability under 1e-15 (Chernoff's bound); for small sets it is one, which is certain.
    """
    if lead > rare:
        return 1
    share = 0.8 * (1 - (100 - percent) / 100 * n / rare)
    if share <= 0.05:
        return 1
    x = np.arange(1, 100) / 100
    distance = x * np.log(x / share) + (1 - x) * np.log((1 - x) / (1 - share))
    ok = (x < share) & (distance * lead >= 34.6)
    return max(1, int(lead * x[ok][-1])) if ok.any() else 1


def _postings(batches, width, percent, frequent, shards):
    """The leading shingles of each set, packed by shard: arrays of (shingle, identity, shared ones it needs)."""
    for batch in batches:
        keys, owners, done = [], [], set()
        for _, _, sets in _sets(batch.column(0), width):
            for s in sets:
                n = rare = len(s)
                if not n or (who := _identity(s)) in done:
                    continue
                done.add(who)
                lead = n - -(-percent * n // 100) + 1
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    rare = n - int(late.sum())
                    s = np.concatenate([s[~late], s[late]])
                keys.append(s[:lead].copy())
                owners.append((who, lead, min(_least_shared(n, rare, lead, percent), 65535)))
            if sum(map(len, keys)) > 1 << 19:
                yield from _sharded(keys, owners, shards)
                keys, owners = [], []
        yield from _sharded(keys, owners, shards)


def _sharded(keys, owners, shards):
    if not keys:
        return
    key = np.concatenate(keys)
    times = [k for _, k, _ in owners]
    owner, need = np.repeat(np.array([w for w, _, _ in owners], np.int64), times), np.repeat(np.array([x for _, _, x in owners], np.uint16), times)
    shard = (mixed(key) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    key, owner, need, shard = key[order], owner[order], need[order], shard[order]
    head = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    ends = np.r_[head[1:], len(shard)]
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(head, ends)], pa.binary()) for x in (key, owner, need)]
    yield pa.RecordBatch.from_arrays([pa.array(shard[head]), *packed], ["shard", "keys", "owners", "needs"])


def _meetings(batches):
    """(shingle, set, need) for each shingle that several sets lead with. A partition holds whole shards; their arrays are taken together."""
    trimmed()
    rows = [[batch.column(c).to_pylist() for c in (1, 2, 3)] for batch in batches]
    if not any(r[0] for r in rows):
        return
    key, owner, need = (np.frombuffer(b"".join(x for r in rows for x in r[c]), t) for c, t in enumerate((np.uint64, np.int64, np.uint16)))
    del rows
    order = np.lexsort((owner, key))
    key, owner, need = key[order], owner[order], need[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
    key, owner, need = key[new], owner[new], need[new]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[head, len(key)])
    many = np.repeat(size, size) > 1
    key, owner, need = key[many].view(np.int64), owner[many], need[many].astype(np.int32)
    for at in range(0, len(key), 50_000):
        cut = slice(at, at + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(owner[cut]), pa.array(need[cut])], ["key", "id", "need"])


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    m = np.frombuffer(bitmap, np.uint64)
    return np.bitwise_or.reduce(m.reshape(-1, size), 0) if len(m) > size else m


def _may_reach(na: int, a: bytes, nb: int, b: bytes, percent: int) -> bool:
    """A bit of one bitmap that the other lacks is a member that the other set lacks, so bit counts bound the overlap from above."""
    least = _least_overlap(na, nb, percent)
    if least > min(na, nb):
        return False
    size = min(len(a), len(b)) // 8
    x, y = _folded(a, size), _folded(b, size)
    return na - int(np.bitwise_count(x & ~y).sum()) >= least and nb - int(np.bitwise_count(y & ~x).sum()) >= least


def _bounded(batches, percent):
    for batch in batches:
        c = batch.to_pydict()
        keep = [_may_reach(*x, percent) for x in zip(c["na"], c["map_a"], c["nb"], c["map_b"])]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _by_tile(batches):
    """Rows come sorted by tile; a tile that straddles batches is carried over. Gives tables of whole tiles."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        tile = held.column("tile").combine_chunks().to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and len(held):
        yield held


class _Tiles:
    """The sets of some tiles in order of tile and size."""

    def __init__(self, rows: pa.Table):
        tile, ids, comps, sizes = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("tile", "id", "component", "n"))
        self.order = np.lexsort((ids, sizes, tile))
        self.tile, self.ids, self.comps, self.sizes = tile[self.order], ids[self.order], comps[self.order], sizes[self.order]
        self.maps = rows.column("bitmap").combine_chunks().take(pa.array(self.order)).to_pylist()
        has_home = "home" in rows.column_names
        self.home = rows.column("home").combine_chunks().to_numpy(zero_copy_only=False)[self.order] if has_home else np.ones(len(ids), bool)

    def candidates(self, percent: int):
        """Arrays (i, j) of pairs of the same tile from different components that sizes and bit counts allow, in portions of bounded size. Two visitors of a tile are no pair."""
        sizes, maps = self.sizes, self.maps
        words = np.array([len(m) // 8 for m in maps])
        group = np.cumsum(np.r_[0, self.tile[1:] != self.tile[:-1]])
        # of rows sorted by tile and size, a row's partners follow it as far as the sizes allow
        key = (group.astype(np.int64) << 40) + sizes
        row = np.arange(len(sizes))
        partners = np.searchsorted(key, (group.astype(np.int64) << 40) + 100 * sizes // percent, "right") - row - 1
        for size in np.unique(words).tolist():
            mine = np.flatnonzero((words == size) & (partners > 0))
            with_same = np.flatnonzero((words == size) | (words == 2 * size))  # sets in reach have bitmaps of this length or twice it
            table = np.stack([_folded(maps[i], size) for i in with_same]) if len(mine) else None
            total, at = np.cumsum(partners[mine]), 0
            while at < len(mine):
                stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MAP_WORDS // size, "right")))
                i = np.repeat(mine[at:stop], partners[mine[at:stop]])
                head = np.cumsum(partners[mine[at:stop]]) - partners[mine[at:stop]]
                j = i + 1 + np.arange(len(i)) - np.repeat(head, partners[mine[at:stop]])
                other = (self.comps[i] != self.comps[j]) & (self.home[i] | self.home[j])
                i, j, at = i[other], j[other], stop
                least = -(-percent * (sizes[i] + sizes[j]) // (100 + percent))
                x, y = table[np.searchsorted(with_same, i)], table[np.searchsorted(with_same, j)]
                ok = sizes[i] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64) >= least
                ok &= sizes[j] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64) >= least
                yield i[ok], j[ok]

    def first_common(self, rows: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the tile's group is the first that both sets of a pair belong to."""
        used, back = np.unique(np.r_[i, j], return_inverse=True)
        at = pa.array(self.order[used])
        keys = [None if k is None else np.array(k, np.int64) for k in rows.column("keys").combine_chunks().take(at).to_pylist()]
        key = rows.column("key").combine_chunks().take(at).to_numpy(zero_copy_only=False)
        pairs = zip(back[: len(i)].tolist(), back[len(i) :].tolist())
        return np.array([keys[x] is None or np.intersect1d(keys[x], keys[y], assume_unique=True)[:1].tolist() == [key[x]] for x, y in pairs], bool)


def _open(batches, percent):
    """What bit counts leave of each tile: its candidate pairs (id, other) while they are at most DENSE times its sets, else its sets that have one.

    So a tile gives rows in proportion to its sets, however many pairs there are. A pair that several large groups share leaves the one of their smallest key only
    (``keys`` has all large open groups of a set, and is null in small groups), or stays in it with its sets if the tile there is dense.
    """
    for rows in _by_tile(batches):
        tiles = _Tiles(rows)
        last = np.searchsorted(tiles.tile, tiles.tile, "right")
        sets, pairs = last - np.searchsorted(tiles.tile, tiles.tile), np.zeros(len(last), np.int64)  # by the last place of a tile
        some, held = np.zeros(len(last), bool), []
        for i, j in tiles.candidates(percent):
            some[i] = some[j] = True
            pairs += np.bincount(last[i] - 1, minlength=len(last))
            held.append((i, j))
            if sum(len(x) for x, _ in held) > HELD_PAIRS:
                held = [(x[ok], y[ok]) for x, y in held for ok in [(pairs <= DENSE * sets)[last[x] - 1]]]
        dense = (pairs > DENSE * sets)[last - 1]
        some &= dense
        i, j = (np.concatenate(x) if held else np.zeros(0, np.int64) for x in (zip(*held) if held else ((), ())))
        i, j = i[~dense[i]], j[~dense[i]]
        if "keys" in rows.column_names:
            cuts = [slice(k, k + HELD_PAIRS) for k in range(0, len(i), HELD_PAIRS)]
            first = np.concatenate([np.zeros(0, bool), *(tiles.first_common(rows, i[c], j[c]) for c in cuts)])
            i, j = i[first], j[first]
        both = np.unique(np.stack([np.minimum(tiles.ids[i], tiles.ids[j]), np.maximum(tiles.ids[i], tiles.ids[j])], 1), axis=0)
        none = pa.nulls(len(both), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(both[:, 0]), none, pa.array(both[:, 1])], OPEN)
        yield pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in (tiles.tile, tiles.ids, tiles.comps)), pa.nulls(int(some.sum()), pa.int64())], OPEN)


OPEN = ["tile", "id", "component", "other"]


def _linked(batches, percent):
    """Links that span what is linked in each tile: candidates are intersected exactly, unless others have connected them by then."""
    for rows in _by_tile(batches):
        tiles = _Tiles(rows)
        members = rows.column("members").combine_chunks().take(pa.array(tiles.order))
        node = np.unique(np.stack([tiles.tile, tiles.comps]), axis=1, return_inverse=True)[1].ravel().tolist()  # a component within a tile is one node
        parent = list(range(len(node)))

        def root(x, parent=parent):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        for i, j in tiles.candidates(percent):
            for x, y in zip(i.tolist(), j.tolist()):
                one, two = root(node[x]), root(node[y])
                if one != two and _reach(members[x], members[y], percent):
                    parent[one] = two
                    a.append(int(tiles.ids[x]))
                    b.append(int(tiles.ids[y]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _reach(x: pa.Scalar, y: pa.Scalar, percent: int) -> bool:
    """Whether the sorted arrays overlap enough."""
    both = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)]))
    overlap = int((both[1:] == both[:-1]).sum())
    return 100 * overlap >= percent * (len(both) - overlap)


def _set_rows(batches, width):
    for batch in batches:
        out = [s.tobytes() for _, _, sets in _sets(batch.column(1), width) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "members"])


def _intersected(batches, percent):
    for batch in batches:
        keep = [_reach(x, y, percent) for x, y in zip(batch.column(2), batch.column(3))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _bloom(ids: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """A fixed megabyte of bits that tells most rows without need apart; it lets every needed row through."""
    slot = F.pmod(F.xxhash64(column), F.lit(bits))
    words = ids.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("v"))
    out = np.zeros(bits // 64, np.int64)
    for row in words.collect():
        out[row["w"]] = row["v"]
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that can be reached by links, itself included).

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, a set holds the distinct shingles of ``width`` words; the words of a shorter
    text are one shingle. Texts without words (also null) link with nothing. Two documents link if 100 * overlap >= percent * union.
    An empty table gives an empty result; further columns of ``docs`` are not read.

    No group of documents is expanded into pairs. Each member of a group that shares a shingle is compared with the one of its sets
    that meets most others (in large groups with four such); what the links connect needs no further comparison. The rest,
    sets of different components in one group, is compared in tiles of bounded size: sets of a large group's largest component stay in one, the others visit
    them. A tile gives out the pairs that bit counts leave (a pair of several large groups once), or, where they are many, the sets of these; with the arrays at hand, such a tile then gives fewer links than it has sets.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    summary = written(
        source.mapInArrow(lambda it: relieved(_summaries(it, width)), "doc_id long, id long, n long, bitmap binary, shingle long, count long"), "jaccard-summary"
    )
    rows = summary.where("shingle is null").select("doc_id", "id", "n", "bitmap")
    total = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("members")).first()
    often = summary.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("count")).where(F.col("count") >= max(64, FREQUENT_SHARE * total["docs"]))
    frequent = np.sort(np.array([r[0] for r in often.select("shingle").collect()], np.int64).view(np.uint64))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["members"] // 4_000_000)

    reps = rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    reps = written(reps, "jaccard-sets")
    packed = source.select("text").mapInArrow(lambda it: relieved(_postings(it, width, percent, frequent, shards)), "shard int, keys binary, owners binary, needs binary")
    met = written(packed.repartition(shards, "shard").mapInArrow(lambda it: relieved(_meetings(it)), "key long, id long, need int"), "jaccard-meetings")
    likely = met.groupBy("id").agg(F.count("*").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("id")
    met = met.join(likely.hint("rebalance"), "id").select("key", "id")
    # the shingles of one passage gather the same sets: one such group is enough
    groups = met.groupBy("key").agg(F.count("*").alias("g"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
    groups = groups.where("g > 1").groupBy("g", "who").agg(F.min("key").alias("key"), F.count("*").alias("times")).drop("who")
    met = written(met.join(groups.hint("rebalance"), "key"), "jaccard-groups")
    # the set that meets most others, such as the original of many altered copies, is the one to compare them with first
    weight = met.groupBy("id").agg(F.sum(F.col("g") * F.col("times")).alias("weight"))
    met = written(met.join(weight.hint("rebalance"), "id").drop("times"), "jaccard-weighed")

    sides = reps.select("id", "n", "bitmap")
    links, linked = None, None
    for _ in range(HUB_ROUNDS):
        members = _with_components(met, linked)
        salt = F.when(F.col("g") > 64, F.pmod(F.xxhash64("id"), F.lit(HUBS))).otherwise(0)
        hubs = members.groupBy("key", salt.alias("salt")).agg(F.max(F.struct("weight", "id", "component")).alias("hub")).drop("salt")
        stars = members.join(hubs.hint("rebalance"), "key").where(F.col("component") != F.col("hub.component"))
        stars = stars.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
        stars = stars.join(_renamed(sides, "a"), "a").join(_renamed(sides, "b"), "b")
        stars = stars.select("a", "b", "na", "map_a", "nb", "map_b").mapInArrow(lambda it: relieved(_bounded(it, percent)), "a long, b long")
        found = _verified(source, reps, written(stars, "jaccard-stars"), width, percent)
        links = found if links is None else links.union(found)
        linked = written(components(links, "jaccard-links"), "jaccard-linked")

    members = _with_components(met, linked)
    open_ = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    members = members.where("g > 2").join(open_.hint("rebalance"), "key").select("key", "g", "id", "component")
    members = written(members.join(sides.select("id", "n"), "id"), "jaccard-open")
    keys = members.where(F.col("g") > TILE).groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most as many as a set has leading shingles
    members = _tiled(members, percent).join(sides.select("id", "bitmap"), "id").join(keys.hint("rebalance"), "id", "left")
    members = members.withColumn("keys", F.when(F.col("g") > TILE, F.col("keys")))
    rest = members.repartition("tile").sortWithinPartitions("tile").select("tile", "home", "key", "id", "component", "n", "bitmap", "keys")
    rest = written(rest.mapInArrow(lambda it: relieved(_open(it, percent)), "tile long, id long, component long, other long"), "jaccard-rest")
    pairs = rest.where("tile is null").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    dense = rest.where("tile is not null").select("tile", "id", "component").distinct()
    names = rest.select("id").union(rest.where("tile is null").select(F.col("other").alias("id"))).distinct()
    sets = _sets_of(source, reps, names, width)
    dense = dense.join(sides, "id").join(sets, "id").select("tile", "id", "component", "n", "bitmap", "members")
    spanning = written(dense.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda it: relieved(_linked(it, percent)), "a long, b long"), "jaccard-spanning")
    more = spanning.union(_overlapping(sets, pairs, percent))

    whole = components(links.union(more), "jaccard-all")
    named = reps.select("id", "doc_id").join(whole, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest.hint("rebalance"), "component").select("id", "component_id")
    return rows.join(named, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_components(met: DataFrame, linked: DataFrame | None) -> DataFrame:
    if linked is None:
        return met.withColumn("component", F.col("id"))
    return met.join(linked.hint("rebalance"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _renamed(sides: DataFrame, x: str) -> DataFrame:
    return sides.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"map_{x}"))


def _tiled(members: DataFrame, percent: int) -> DataFrame:
    """Rows (key, g, id, component, n, ...) with the tiles they take part in, and whether they are at home there.

    A group of up to TILE sets is one tile. In a larger one only sets outside its largest component are still to be compared, with all sets of the group: every
    set has its home in one cut of its band by size (bands of the ratio of the threshold, so that only equal and neighbouring bands can link), and
    those outside the largest component visit, in as many portions as they need, all cuts of the three bands. Sets of the largest component do not move.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    small = members.where(F.col("g") <= TILE).withColumns({"tile": F.xxhash64("key"), "home": F.lit(True)})
    large = members.where(F.col("g") > TILE)
    parts = large.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "component"))["component"].alias("main"), (F.sum("c") - F.max("c")).alias("others"))
    large = large.join(main.hint("rebalance"), "key")
    cuts, portions = (F.ceil(F.col(c) / TILE).cast("int") for c in ("g", "others"))
    large = large.withColumns({"band": band, "cuts": cuts, "portions": F.greatest(portions, F.lit(1))})
    large = large.withColumns({"cut": F.pmod(F.xxhash64("id"), "cuts").cast("int"), "portion": F.pmod(F.xxhash64("id", F.lit(1)), "portions").cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = large.withColumn("portion", every("portions")).withColumn("home", F.lit(True))
    guests = large.where("component <> main").withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))))
    guests = guests.withColumn("cut", every("cuts")).withColumn("home", F.lit(False))
    both = homes.unionByName(guests).withColumn("tile", F.xxhash64("key", "band", "cut", "portion"))
    return small.unionByName(both.drop("main", "others", "cuts", "portions", "band", "cut", "portion"))


def _sets_of(source: DataFrame, reps: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """(id, members) of the sets in ``names``; only these are made again from their texts."""
    needed = written(reps.join(names, "id").select("id", "doc_id"), "jaccard-needed")
    bits = _bloom(needed, "doc_id")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(len(bits) * 64))
    picked = source.withColumn("slot", slot).mapInArrow(lambda it: relieved(_passed(it, bits)), "doc_id long, text string")
    texts = picked.join(needed, "doc_id").select("id", "text")
    return written(texts.mapInArrow(lambda it: relieved(_set_rows(it, width)), "id long, members binary"), "jaccard-members")


def _verified(source: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sorted arrays overlap enough."""
    names = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return _overlapping(_sets_of(source, reps, names, width), pairs, percent)


def _overlapping(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").select("a", "b", "x", "y")
    return written(both.mapInArrow(lambda it: relieved(_intersected(it, percent)), "a long, b long"), "jaccard-pairs")


def _passed(batches, bits):
    for batch in batches:
        slot = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = (bits[slot // 64] >> (slot % 64)) & 1
        yield batch.select([0, 1]).filter(pa.array(keep.astype(bool)))
