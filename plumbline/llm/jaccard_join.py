"""N-gram Jaccard join by signature trees.

Texts become sets of word shingles (64-bit hashes). Equal sets are one class, named by its smallest
doc_id. Candidates are exact in two steps. First, each set gives its least hashes, more of them than a linked set may lack:
linked sets share ``slack`` of these, so classes of which fewer are seen in another class have no link. What is left is joined by
its rarest shingles: of a set of n, the first n - ceil(n * percent / 100) + 1 in an order of rarity. Linked sets share one of
them, and shingles that no other set has, which come first, make no block. A block is a shingle and the sets that have it
among their rarest; blocks with the same least set, their lead, are one group.

In each group all sets are verified with the lead, and links give components. Groups whose sets are
still apart are joined by a signature tree: nodes hold the OR of their members' token bitmaps, their
range of sizes and of components, and a dual traversal goes down only node pairs whose greatest possible
overlap reaches the threshold and which aren't one component. Its leaf pairs are verified on the
sets themselves, as long as they are two components in their task. Groups beyond ``LEAF`` sets are cut into nodes by size band; pairs of nodes in equal or neighbouring bands are
traversed in tasks of their own. Links are exact; only those that join two components are
looked for, as components need no others.

Null and empty texts have no shingles and link with nothing; a text with fewer words than a shingle is
one shingle; repeated rows are members of one class; rows with a null doc_id have no component (null);
rows that share a doc_id are one node; an empty table gives none; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, bloom_size, cut, discard, flat, grouped, in_bloom, passing, release, slices, trim
from .graph import components
from .words import mix, shingle_sets

U = np.uint64
#: Sets of a group that one task joins by a tree; children of a node; sets verified with one other in a task.
LEAF, FAN, CHUNK = 256, 16, 256
#: Shingles of such sets, of eight bytes each.
WEIGHT = 1 << 20
#: Levels of rarity: least numbers of sets that have a shingle.
LEVELS = tuple(2 * 4**i for i in range(16))
#: Least and most bits of a bitmap, and bytes of bitmaps that a step of a traversal compares.
LEAST_BITS, MOST_BITS, STEP = 1 << 11, 1 << 17, 1 << 22


class Rule:
    """Jaccard of at least percent / 100, for shingles of k words. Percent is above 50."""

    def __init__(self, percent: int = 90, k: int = 3):
        if not 50 < percent <= 100:
            raise ValueError("percent must be above 50")
        self.percent, self.k = percent, k

    def shared(self, n: int) -> int:
        """Least number of its n shingles that a linked set has, too."""
        return (self.percent * n + 99) // 100

    def slack(self, n: int) -> int:
        """How many of their sampled shingles linked sets have in common; for two sizes the smaller number holds. More of them are larger samples that fewer other sets pass."""
        return (n + 9) // 10

    def sampled(self, n: int) -> int:
        """Least hashes that a set of n shingles gives: with overlap o, the n - o + s least of two sets have s in common."""
        return min(n, n - self.shared(n) + self.slack(n))

    def seen(self, n: np.ndarray) -> np.ndarray:
        """Least number of sampled shingles that a linked set of any size samples, too."""
        least = (self.percent * n + 99) // 100
        return (least + 9) // 10

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)


def set_key(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    if not len(x):
        return 0, 0
    return int(mix(x).sum().view(np.int64)), int(mix(x + U(0x2545F4914F6CDD1D)).sum().view(np.int64))


def sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sample): set size and name of each row, and its sampled shingles as bytes, once a task for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        given: set[tuple[int, int]] = set()
        for batch in batches:
            data, offsets = flat(batch.column(1))
            named = batch.column(0).is_valid().to_pylist()
            for i, j in slices(offsets):
                n, k1, k2, sample = [], [], [], []
                for r, x in zip(range(i, j), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule.k)):
                    key = set_key(x)
                    n.append(len(x))
                    k1.append(key[0])
                    k2.append(key[1])
                    new = named[r] and len(x) > 0 and key not in given
                    sample.append(x[: rule.sampled(len(x))].tobytes() if new else None)
                    if new and len(given) < 1 << 19:
                        given.add(key)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sample, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sample"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sample binary")


def _exploded(rows: DataFrame, content: str, *others: str) -> DataFrame:
    """(token, others) of each 64-bit value in a binary column."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for i, j in slices(offsets, 1 << 20):
                times = np.repeat(np.arange(i, j), np.diff(offsets[i : j + 1]) // 8)
                yield pa.RecordBatch.from_arrays([pa.array(data[offsets[i] : offsets[j]].view("<i8")), *(batch.column(c).take(pa.array(times)) for c in others)], ["token", *others])

    return rows.select(content, *others).mapInArrow(run, ", ".join(["token long", *(f"{c} {kinds[c]}" for c in others)]))


def survivors(rows: DataFrame, rule: Rule) -> DataFrame:
    """(k1, k2, n_shingles) of the classes that may be linked: enough of their sample is sampled by other classes, too.

    Shared shingles are passed to the tasks as a filter of fixed size; a fuller filter lets more classes through, and exact steps follow."""
    given = rows.where("sample is not null")
    shared = cut(_exploded(given, "sample", "k1").groupBy("token").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("token"), "shared")
    release(rows.sparkSession)  # the shuffle of all sampled shingles
    words = rows.sparkSession.sparkContext.broadcast(bloom(shared, "token", bloom_size(shared.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            n = batch.column(3).to_numpy()
            for i, j in slices(offsets, 1 << 20):
                on = np.concatenate(([0], np.cumsum(in_bloom(words.value, data[offsets[i] : offsets[j]].view("<u8")))))
                at = (offsets[i : j + 1] - offsets[i]) // 8
                ok = on[at[1:]] - on[at[:-1]] >= rule.seen(n[i:j])
                yield batch.slice(i, j - i).filter(pa.array(ok)).select(["k1", "k2", "n_shingles"])

    return given.select("sample", "k1", "k2", "n_shingles").mapInArrow(run, "k1 long, k2 long, n_shingles long").distinct()


def bitmap(x: np.ndarray) -> np.ndarray:
    """Bits at the hashes' low bits: a power of two of at least sixteen for each member, up to MOST_BITS, so that few different shingles share one."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * len(x) - 1).bit_length()))
    out = np.zeros(bits // 64, U)
    low = (x & U(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, low >> 6, U(1) << (low & 63).astype(U))
    return out


def _sets_of(texts: DataFrame, rule: Rule) -> DataFrame:
    """(id, n, tokens) of rows (k1, k2, text), where id is k1. A text whose set isn't (k1, k2) is of another row of its doc_id and left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            data, offsets = flat(batch.column(2))
            k1, k2 = (batch.column(c).to_pylist() for c in ("k1", "k2"))
            for i, j in slices(offsets):
                rows = []
                for r, x in zip(range(i, j), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule.k)):
                    if set_key(x) == (k1[r], k2[r]):
                        rows.append((k1[r], len(x), x.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["id", "n", "tokens"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "id long, n long, tokens binary")


def bitmaps(members: DataFrame) -> DataFrame:
    """(id, tokens, bits) of sets (id, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                bits = [bitmap(data[offsets[k] : offsets[k + 1]].view("<u8")).tobytes() for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in (batch.column(0), batch.column(1))), pa.array(bits, pa.binary())], ["id", "tokens", "bits"])

    return members.select("id", "tokens").mapInArrow(run, "id long, tokens binary, bits binary")


def prefixes(members: DataFrame, rule: Rule) -> DataFrame:
    """(token, id, n): those of each set's rarest shingles that other sets have. Linked sets share one, as all sets are ordered alike.

    The order is by levels of rarity, then by hash. A level is a filter of fixed size over the shingles that stand in at least LEVELS[i] sets: a
    fuller filter makes some shingles seem more frequent, but to all sets alike, so no link is lost. Sets with too few shared shingles give none."""
    counts = cut(_exploded(members, "tokens").groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    release(members.sparkSession)  # the shuffle of the candidates' shingles
    filters = []
    for least in LEVELS:
        often = counts.where(F.col("c") >= least).select("token")
        n = often.count()
        if not n:
            break
        filters.append(bloom(often, "token", bloom_size(n)))
    levels = members.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            ids, found = batch.column(0).to_numpy(), []
            for i in range(batch.num_rows):
                x = data[offsets[i] : offsets[i + 1]].view("<u8")
                rare: list[np.ndarray] = []
                rest = x
                for words in levels.value:
                    on = in_bloom(words, rest)
                    rare.append(rest[~on])
                    rest = rest[on]
                shared = np.concatenate([*rare[1:], rest]) if rare else rest[:0]  # without those that no other set has
                most = len(shared) - rule.shared(len(x)) + 1
                if most > 0:
                    found.append((ids[i], len(x), shared[:most]))
            if found:
                times = [len(t) for *_, t in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t for *_, t in found]).view(np.int64)), *(pa.array(np.repeat(np.array([f[k] for f in found], np.int64), times)) for k in (0, 1))], ["token", "id", "n"])

    return members.select("id", "n", "tokens").mapInArrow(run, "token long, id long, n long")


def groups_of(prefix: DataFrame) -> DataFrame:
    """(lead, lead_n, id, n): a block is a shingle and the sets that have it among their rarest, its lead the least of them; blocks of one lead are a group. Two sets of a block are in its lead's group, and so is the lead."""
    blocks = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "n")).alias("lead"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("m > 1")
    # of blocks with the same sets one will do
    blocks = blocks.groupBy("m", "x", "y").agg(F.min(F.struct("token", "lead")).alias("b")).select("b.token", F.col("b.lead.id").alias("lead"), F.col("b.lead.n").alias("lead_n"))
    return prefix.join(cut(blocks, "blocks"), "token").select("lead", "lead_n", "id", "n").distinct()


def verified(pairs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are linked. A task holds one set, and streams those that are compared with it; CHUNK of them for each copy of it."""
    pairs = cut(pairs, "pairs")
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    salted = pairs.join(cut(counts, "chunks"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b")
    salted = cut(salted, "salted")
    ones = salted.select("a", "chunk").distinct().join(members.select(F.col("id").alias("a"), "tokens"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "tokens")
    others = salted.join(members.select(F.col("id").alias("b"), "tokens"), "b").select("a", "chunk", "b", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        one = np.zeros(0, U)
        for batch in batches:
            data, offsets = flat(batch.column(3))
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found = []
            for i, j in enumerate(b):
                x = data[offsets[i] : offsets[i + 1]].view("<u8")
                if j is None:
                    one = x.copy()
                elif 100 * min(len(x), len(one)) >= rule.percent * max(len(x), len(one)) and rule.linked(len(np.intersect1d(one, x, assume_unique=True)), len(one), len(x)):
                    found.append((a[i], j))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    spread = ones.unionByName(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return spread.select("a", "chunk", "b", "tokens").mapInArrow(run, "a long, b long")


class Tree:
    """A signature tree over sets, given by bitmaps of one width, sizes and components: level 0 are members, each further level groups FAN
    nodes by OR of bitmaps, least number of bits, and ranges of sizes and components."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, seen: np.ndarray):
        self.levels = [(bits, np.bitwise_count(bits).sum(axis=1).astype(np.int64), size, size, seen, seen)]
        while len(self.levels[-1][0]) > 1:
            b, pop, *ranges = self.levels[-1]
            at = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), *(f.reduceat(x, at) for f, x in zip((np.minimum, np.minimum, np.maximum, np.minimum, np.maximum), (pop, *ranges)))))

    def level(self, k: int) -> tuple[np.ndarray, ...]:
        return self.levels[min(k, len(self.levels) - 1)]

    def below(self, k: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of each node's children in the level below k; a root above the tree is its own child."""
        if k >= len(self.levels):
            return nodes, nodes + 1
        return nodes * FAN, np.minimum((nodes + 1) * FAN, len(self.levels[k - 1][0]))


def dual_join(a: Tree, b: Tree | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in a, j in b, or both in a with i < j) of members that may be linked and aren't of one component, by dual traversal of two trees, or of one (b None)."""
    other = a if b is None else b
    top = max(len(a.levels), len(other.levels)) - 1
    step = max(16, min(2048, STEP // (8 * a.levels[0][0].shape[1])))
    todo = [(top, np.array([0]), np.array([0]))] if len(a.levels[0][0]) and len(other.levels[0][0]) else []
    while todo:
        k, ia, ib = todo.pop()
        if len(ia) > step:
            todo += [(k, ia[s : s + step], ib[s : s + step]) for s in range(0, len(ia), step)]
            continue
        (ba, apop, alo, ahi, afirst, alast), (bb, bpop, blo, bhi, bfirst, blast) = (tuple(x[i] for x in t.level(k)) for t, i in ((a, ia), (other, ib)))
        # shingles that one side has beyond the other's bits bound the overlap of any pair below
        common = np.bitwise_count(ba & bb).sum(axis=1).astype(np.int64)
        most = np.minimum(ahi - np.maximum(0, apop - common), bhi - np.maximum(0, bpop - common))
        ok = (100 * most >= percent * (np.maximum(alo, most) + np.maximum(blo, most) - most)) & (100 * np.minimum(ahi, bhi) >= percent * np.maximum(alo, blo))
        ok &= (afirst != alast) | (bfirst != blast) | (afirst != bfirst)
        if b is None:
            ok &= (ia < ib) if k == 0 else (ia <= ib)
        ia, ib = ia[ok], ib[ok]
        if not len(ia):
            continue
        if k == 0:
            yield ia, ib
            continue
        (a0, a1), (b0, b1) = a.below(k, ia), other.below(k, ib)
        wide, n = b1 - b0, (a1 - a0) * (b1 - b0)
        pair = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        todo.append((k - 1, a0[pair] + at // wide[pair], b0[pair] + at % wide[pair]))


def _folded(raw: list[bytes], words: int) -> np.ndarray:
    """Bitmaps as rows of so many words; wider ones are folded by OR."""
    out = np.zeros((len(raw), words), U)
    for i, x in enumerate(raw):
        out[i] = np.bitwise_or.reduce(np.frombuffer(x, "<u8").reshape(-1, words), axis=0)
    return out


def join_nodes(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) found in each task of rows (task, side, id, n, seen, bits, tokens): side 0 is joined with side 1, or with itself if there is no side 1.

    Sets of one bitmap width make a tree; sizes of linked sets differ by less than two, so trees of equal or neighbouring widths are traversed. Candidates are
    verified on the sets; what is one component by then, from before (seen) or by links of the task, is not looked at again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for group in grouped(batches, ["task"]):
            side, ids, n, seen = (group.column(c).to_numpy() for c in ("side", "id", "n", "seen"))
            raw, sets_ = group.column("bits").to_pylist(), group.column("tokens").to_pylist()
            width = np.array([len(x) // 8 for x in raw], np.int64)
            order = np.lexsort((ids, seen, n))
            whole = not side.any()
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while x in parent:
                    x = parent[x]
                return x

            def tree(s: int, w: int, words: int) -> tuple[Tree, np.ndarray]:
                at = order[(side[order] == s) & (width[order] == w)]
                return Tree(_folded([raw[i] for i in at], words), n[at], seen[at]), at

            widths, links = sorted(set(width.tolist())), []
            for w in widths:
                for a, b in ((w, w), (w, 2 * w)) if whole else ((w, w), (w, 2 * w), (2 * w, w)):
                    if a in widths and b in widths:
                        (ta, ia), (tb, ib) = tree(0, a, min(a, b)), (None, None) if whole and a == b else tree(0 if whole else 1, b, min(a, b))
                        for i, j in dual_join(ta, tb, rule.percent):
                            for x, y in zip(ia[i].tolist(), (ia if ib is None else ib)[j].tolist()):
                                u, v = find(int(seen[x])), find(int(seen[y]))
                                if u != v:
                                    one, other = (np.frombuffer(sets_[k], "<u8") for k in (x, y))
                                    if rule.linked(len(np.intersect1d(one, other, assume_unique=True)), len(one), len(other)):
                                        parent[max(u, v)] = min(u, v)
                                        links.append((ids[x], ids[y]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    spread = rows.repartition("task").sortWithinPartitions("task", "side", "id")
    return spread.select("task", "side", "id", "n", "seen", "bits", "tokens").mapInArrow(run, "a long, b long")


def tree_links(apart: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) of groups (lead, id, n, m, weight, seen) by signature trees; m is a group's number of sets, weight that of their shingles."""
    held = cut(bitmaps(members.join(apart.select("id").distinct(), "id", "left_semi")), "bitmaps")
    fits = F.expr(f"m <= {LEAF} and weight <= {WEIGHT}")
    small = apart.where(fits).select(F.col("lead").alias("task"), F.lit(0).alias("side"), "id", "n", "seen").join(held, "id")
    found = join_nodes(small, rule)
    large = apart.where(~fits)
    return found if large.isEmpty() else found.unionByName(join_nodes(_node_pairs(large, rule).join(held, "id"), rule))


def _node_pairs(large: DataFrame, rule: Rule) -> DataFrame:
    """(task, side, id, n, seen): groups cut into nodes of about LEAF sets and WEIGHT shingles by size band, the largest component of each group in nodes of its own; a task is a pair of nodes in equal or neighbouring bands, not both of that component."""
    counts = large.groupBy("lead", "seen").agg(F.count(F.lit(1)).alias("c")).groupBy("lead").agg(F.max(F.struct("c", "seen")).alias("g")).select("lead", F.col("g.seen").alias("giant"))
    # linked sets' sizes differ by a factor of at most 100 / percent, the width of a band
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / rule.percent) + 1e-9)).cast("long")
    placed = cut(large.join(counts, "lead").select("lead", "id", "n", "seen", band.alias("band"), (F.col("seen") != F.col("giant")).cast("int").alias("apart")), "bands")
    sizes = placed.groupBy("lead", "band", "apart").agg(F.greatest(F.ceil(F.count(F.lit(1)) / LEAF), F.ceil(F.sum("n") / WEIGHT)).alias("nodes"))
    placed = cut(placed.join(cut(sizes, "nodes"), ["lead", "band", "apart"]).withColumn("node", F.pmod(F.xxhash64("id"), F.col("nodes"))).drop("nodes"), "placed")
    node = placed.select("lead", "band", "apart", "node").distinct()
    left = node.select("lead", F.explode(F.expr("array(band, band + 1)")).alias("band"), F.col("band").alias("ba"), F.col("apart").alias("pa"), F.col("node").alias("na"))
    right = node.select("lead", "band", F.col("band").alias("bb"), F.col("apart").alias("pb"), F.col("node").alias("nb"))
    pairs = left.join(right, ["lead", "band"]).where("(pa = 1 or pb = 1) and (ba < bb or pa < pb or pa = pb and na <= nb)")
    pairs = cut(pairs.withColumn("task", F.xxhash64("lead", "ba", "pa", "na", "bb", "pb", "nb")).drop("band"), "node-pairs")

    def side(s: int, b: str, p: str, n: str, these: DataFrame) -> DataFrame:
        keyed = these.select("lead", F.col(b).alias("band"), F.col(p).alias("apart"), F.col(n).alias("node"), "task", F.lit(s).alias("side"))
        return placed.join(keyed, ["lead", "band", "apart", "node"]).select("task", "side", "id", "n", "seen")

    return side(0, "ba", "pa", "na", pairs).unionByName(side(1, "bb", "pb", "nb", pairs.where("ba <> bb or pa <> pb or na <> nb")))


def links_of(members: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between sets (id, n, tokens) that give their components."""
    groups = cut(groups_of(cut(prefixes(members, rule), "prefixes")), "groups")
    release(members.sparkSession)
    fits = F.expr(f"100 * least(n, lead_n) >= {rule.percent} * greatest(n, lead_n)")
    links = cut(verified(groups.where("id <> lead").where(fits).select(F.col("lead").alias("a"), F.col("id").alias("b")), members, rule), "links")
    release(members.sparkSession)  # the sets that were sent to their leads
    found = components(links)
    labelled = cut(groups.join(found.select("id", F.col("component").alias("seen")), "id", "left").select("lead", "id", "n", F.coalesce("seen", "id").alias("seen")), "labelled")
    open_groups = cut(labelled.groupBy("lead").agg(F.min("seen").alias("lo"), F.max("seen").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight")).where("lo < hi").select("lead", "m", "weight"), "open")
    apart = cut(labelled.join(open_groups, "lead"), "apart")
    release(members.sparkSession)
    return cut(links.unionByName(tree_links(apart, members, rule)), "links")


def link_components(docs: DataFrame, percent: int = 90, k: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    rule = Rule(percent, k)
    sampled = cut(sets(docs, rule), "sets")
    rows = cut(sampled.drop("sample"), "rows")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    named = cut(known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("id")), "classes")
    heads = cut(named.join(survivors(sampled, rule), ["k1", "k2", "n_shingles"], "left_semi").select("id", "k1", "k2"), "heads")
    discard(sampled)  # the samples are most of what is written until here
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    near, _ = passing(texts, heads, "id")  # texts of candidates alone are shuffled
    members = cut(_sets_of(heads.join(near, "id"), rule), "members")
    release(docs.sparkSession)  # the candidates' texts
    if not members.groupBy("id", "n").count().where("count > 1").isEmpty():  # rows that repeat a doc_id and its text
        members = cut(members.dropDuplicates(["id"]), "members")
    # links of sets, which k1 names until here, as links of their doc_ids: rows of one doc_id are one node
    links = links_of(members, rule)
    discard(members)
    links = cut(links.join(heads.select(F.col("k1").alias("a"), F.col("id").alias("x")), "a").join(heads.select(F.col("k1").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    # equal sets under different doc_ids, and links between sets
    same = known.join(named, ["k1", "k2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    # rows of a doc_id with several texts tie their classes
    several = same.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi")
    joined = components(links if several.isEmpty() else links.unionByName(same.where("a <> b")))
    own = rows.join(named, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("id"))
    return own.join(joined, "id", "left").select("doc_id", "n_shingles", F.least("id", F.coalesce("component", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 90, k: int = 3) -> DataFrame:
    """docs without those that are linked with a smaller doc_id: the smallest doc_id of each component stays.

    Rows of one doc_id that stays, and rows without doc_id, are judged by their texts: of linked texts under one doc_id, or under none, the row of the
    least hash stays, and different texts all do. Rows without shingles stay, but equal ones of a doc_id once."""
    found = link_components(docs, percent, k).where("doc_id is not null")
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    repeated = cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"), "repeated")
    nameless = docs.where("doc_id is null")
    # the texts of these alone are shuffled
    near, clear = passing(docs.where("doc_id is not null"), cut(gone.union(repeated), "suspects"), "doc_id")
    kept = near.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty() and nameless.isEmpty():
        return clear.unionByName(kept)
    several = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).unionByName(nameless)
    return clear.unionByName(kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)).unionByName(_of_texts(several, percent, k))


def _of_texts(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """One row of each component of the texts under one doc_id, or under none."""
    rows = cut(docs.withColumn("_node", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")).withColumn("_row", F.xxhash64(F.col("text").isNull(), *docs.columns)), "texts")
    groups = link_components(rows.select(F.col("_node").alias("doc_id"), "text").dropDuplicates(["doc_id"]), percent, k)
    joined = cut(rows.join(groups.select(F.col("doc_id").alias("_node"), F.col("component_id").alias("_group"), "n_shingles"), "_node"), "grouped")
    # every row without shingles and doc_id stays
    blank = joined.where("n_shingles = 0 and doc_id is null").select(*docs.columns)
    judged = joined.where("n_shingles > 0 or doc_id is not null")
    first = judged.groupBy("doc_id", "_group").agg(F.min(F.struct("_node", "_row")).alias("first")).select(F.col("_group").alias("_g"), F.col("doc_id").alias("_d"), "first._node", "first._row")
    stay = judged.join(first, ["_node", "_row"]).where(F.col("_group").eqNullSafe(F.col("_g")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    return stay.dropDuplicates(["_node", "_row"]).select(*docs.columns).unionByName(blank)
