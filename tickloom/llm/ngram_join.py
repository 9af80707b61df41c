"""Exact n-gram Jaccard self-join by prefix trees.

A document's set holds the distinct hashes of its five-word shingles (A-Z lower-cased). All sets
are ordered by one global order: occurrences in a counter sketch of the corpus, then the hash.

1. Two sets with Jaccard 0.8 or more share one of their rarest shingles: one of the first
   n - ceil(4n/5) + 1 of the larger set and of the first n - ceil(8n/9) + 1 of the smaller one.
   Sets that share such a shingle form a list.
2. Each list's members meet their list's least member (its hub) in chunks of bounded size. Members that
   an exact bound on overlaps, from 256 counts a set, parts from all others leave their chunk. A chunk's sets, commonest shingle first, are stored in a trie; each set walks it, sharing the overlap along common
   paths, and leaves a subtree once the shingles that remain cannot reach the overlap needed.
   A walk reports one link to each class that it touches, never all pairs of a class.
3. Lists whose members are in more than one class after that are joined whole: in one chunk, or,
   beyond a chunk's size, in chunks for each pair of blocks that may still hold an unknown link.

So hot lists (many near copies, common passages) never come together in one task, and no pair is
skipped. Exact copies have one hash and are carried once. Sets are known by a 64-bit hash of
their content; two different sets among N share one with probability N**2 / 2**65.

Null text, empty text, no word: empty set, linked with nothing, component is the own id. Under five words: the
whole sequence is the one shingle. Rows that repeat an id each get a result; a null id has no
component of its own but takes that of its copies. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bit_filter, cells, components, cut, gather_cells, in_filter
from .textkernel import Block, blocks, mix, windows

SHINGLE = 5
SKETCH_BITS = 24
CELL = 1 << 14
FILTER_BITS = 24
#: Sets in one chunk of a trie join.
CHUNK = 128
#: Places in a task's memory of the hashes it has seen, to emit copies once; a hash that another took the place of is emitted again,
#: and later steps drop it.
REMEMBER = 1 << 18


class Seen:
    """A table of fixed size of hashes met lately."""

    def __init__(self) -> None:
        self.at = np.arange(REMEMBER) ^ 1  # no hash that belongs in its place

    def again(self, h: int) -> bool:
        i = h & (REMEMBER - 1)
        if self.at[i] == h:
            return True
        self.at[i] = h
        return False


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, buf, off in blocks(column):
        block = Block(buf, off)
        h, at = block.hashes(lower=True), block.bounds
        for i in range(len(off) - 1):
            s = windows(h[at[i] : at[i + 1]], SHINGLE)
            if len(s) > 1:
                s = np.sort(s)
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield s


def set_hash(s: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sketch(docs: DataFrame) -> np.ndarray:
    """Number of documents by the low SKETCH_BITS bits of their shingles: one array of fixed size.

    It only orders shingles; counts that reach their type's end stay there, and any order gives the same links.
    """

    size, mask = 1 << SKETCH_BITS, np.uint64((1 << SKETCH_BITS) - 1)

    def count(batches):
        total = np.zeros(size, np.uint16)
        waiting, n = [], 0

        def settle():
            at, more = np.unique(np.concatenate(waiting), return_counts=True)
            total[at] = np.minimum(total[at] + more, 65535)

        for b in batches:
            for s in sets(b.column(0)):
                waiting.append((s & mask).astype(np.int64))
                n += len(s)
                if n > 1 << 20:
                    settle()
                    waiting, n = [], 0
        if waiting:
            settle()
        yield from cells(total, CELL)

    # a byte each, by logarithm: what is broadcast halves, and only near counts of common shingles tie
    return np.round(15 * np.log2(gather_cells(arrow_map(docs.select("text"), count, "cell int, counts binary"), size, CELL).astype(np.float32) + 1)).astype(np.uint8)


def _ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rarest first by the sketch; ties by hash."""
    return s[np.argsort(counts[s & np.uint64(len(counts) - 1)], kind="stable")]


def prefix_sizes(n: int) -> tuple[int, int]:
    """How many of a set's rarest shingles to look up, and how many of them to index."""
    return n - (4 * n + 4) // 5 + 1, n - (8 * n + 8) // 9 + 1


def linked(overlap: int, a: int, b: int) -> bool:
    """100 * intersection >= 80 * union."""
    return 9 * overlap >= 4 * (a + b)


class Trie:
    """A path-compressed prefix tree of ordered sets; a node has the sizes that occur below it and the classes."""

    __slots__ = ("part", "kids", "ends", "least", "most", "depth")

    def __init__(self, part: list, depth: int) -> None:
        self.part, self.depth = part, depth
        self.kids: dict[int, Trie] = {}
        self.ends: list[tuple[int, int]] = []  # (member, size)
        self.least, self.most = 1 << 60, 0

    def add(self, path: list, member: int) -> None:
        size, node, i = len(path), self, 0
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if i == size:
                node.ends.append((member, size))
                return
            kid = node.kids.get(path[i])
            if kid is None:
                leaf = Trie(path[i:], i)
                leaf.least = leaf.most = size
                leaf.ends.append((member, size))
                node.kids[path[i]] = leaf
                return
            part, n = kid.part, min(len(kid.part), size - i)
            k = 1
            while k < n and part[k] == path[i + k]:
                k += 1
            if k < len(part):  # split the edge
                top = Trie(part[:k], i)
                top.least, top.most = kid.least, kid.most
                kid.part, kid.depth = part[k:], i + k
                top.kids[part[k]] = kid
                node.kids[path[i]] = top
                kid = top
            node, i = kid, i + k

    def search(self, has: set, size: int, found) -> None:
        """Call ``found(member)`` for each stored set linked with the probe ``has``; ``found.closed(member)`` spares known ones."""
        walk = [(self, 0)]
        while walk:
            node, overlap = walk.pop()
            for member, n in node.ends:
                if linked(overlap, size, n):
                    found(member)
            for kid in node.kids.values():
                # sizes outside the band can't link; of the rest, the least needed overlap is that of the smallest
                small = max(kid.least, (4 * size + 4) // 5)
                if small > kid.most or 4 * kid.least > 5 * size:
                    continue
                need = (4 * (size + small) + 8) // 9
                if overlap + min(size - overlap, kid.most - kid.depth) < need:
                    continue
                got = overlap + sum(map(has.__contains__, kid.part))
                if got + min(size - got, kid.most - kid.depth - len(kid.part)) >= need:
                    walk.append((kid, got))


def chunk_links(members: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """A star for each class that links make among some (hash, set): its members with its least hash, so that paths through many chunks stay short."""
    tree, top = Trie([], 0), list(range(len(members)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in sorted(range(len(members)), key=lambda i: len(members[i][1])):
        path = members[i][1][::-1].tolist()  # commonest first: near copies share long paths

        def found(j: int, i: int = i) -> None:
            a, b = root(i), root(j)
            if a != b:
                top[a] = b

        tree.search(set(path), len(path), found)
        tree.add(path, i)
    least: dict[int, int] = {}
    for i, (h, _) in enumerate(members):
        least[root(i)] = min(h, least.get(root(i), h))
    return [(h, least[root(i)]) for i, (h, _) in enumerate(members) if h != least[root(i)]]


def _signatures(docs: DataFrame, counts) -> DataFrame:
    """(doc_id, h, n, prefix, parts): h null and no prefix for an empty set; the prefix holds the rarest shingles in order.

    ``parts`` counts a set's hashes by their highest byte. The sum of two sets' lesser counts bounds their overlap.
    """

    def run(batches):
        order = counts.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                ids, h, n, flat, off, parts = b.column(0).slice(i, 1024), [], [], [], [0], []
                for s in sets(b.column(1).slice(i, 1024)):
                    p = _ordered(s, order)[: prefix_sizes(len(s))[0]] if len(s) else s
                    h.append(set_hash(s) if len(s) else None)
                    n.append(len(s))
                    parts.append(np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256), 65535).astype("<u2").tobytes())
                    flat.append(p.view(np.int64))
                    off.append(off[-1] + len(p))
                prefix = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), prefix, pa.array(parts, pa.binary())], ["doc_id", "h", "n", "prefix", "parts"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, h long, n long, prefix array<long>, parts binary")


def _postings(signed: DataFrame, wanted=None) -> DataFrame:
    """(token, h, lead): one row for each prefix shingle of each set, once a task; lead: 1 if it is among those to index."""

    def run(batches):
        told = Seen()
        for b in batches:
            flat, off = np.asarray(b.column(2).values), np.asarray(b.column(2).offsets)
            hs, ns = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(hs), 512):
                tokens, owner, lead = [], [], []
                for k in range(at, min(at + 512, len(hs))):
                    h = hs[k]
                    if h is None or told.again(h):
                        continue
                    p = flat[off[k] : off[k + 1]]
                    first = np.arange(len(p)) < prefix_sizes(ns[k])[1]
                    if wanted is not None:
                        hit = in_filter(p, wanted.value)
                        p, first = p[hit], first[hit]
                    tokens.append(p)
                    owner.append(np.full(len(p), h, np.int64))
                    lead.append(first)
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(lead).astype(np.int64))], ["token", "h", "lead"])

    return arrow_map(signed.select("h", "n", "prefix"), run, "token long, h long, lead long")


def _sets_of(docs: DataFrame, wanted, counts) -> DataFrame:
    """(h, s): the ordered sets whose hash passes the filter, each once."""

    def run(batches):
        order, bits, told = counts.value, wanted.value, Seen()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                hs, out = [], []
                for s in sets(b.column(0).slice(i, 256)):
                    if len(s) and in_filter(np.array([h := set_hash(s)], np.int64), bits)[0] and not told.again(h):
                        hs.append(h)
                        out.append(_ordered(s, order).astype("<u8").tobytes())
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(out, pa.binary())], ["h", "s"])

    return arrow_map(docs.select("text"), run, "h long, s binary").groupBy("h").agg(F.first("s").alias("s"))


def may_link(parts: np.ndarray, n: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which of some sets have another, of another known class, among them that the bound on overlaps lets them link with."""
    some = np.zeros(len(n), bool)
    for i in range(1, len(n)):
        most = np.minimum(parts[:i], parts[i]).sum(axis=1, dtype=np.int64)
        hit = ((9 * most >= 4 * (n[:i] + n[i])) | (parts[i] == 65535).any()) & (classes[:i] != classes[i])
        some[:i] |= hit
        some[i] = hit.any()
    return some


def _possible(members: DataFrame, signed: DataFrame) -> DataFrame:
    """(chunk, h) of ``members(chunk, h, c)`` without those that can link with none of another class c of their chunk, seen from counts of a fixed size."""
    bounds = signed.where("h is not null").groupBy("h").agg(F.first("n").alias("n"), F.first("parts").alias("parts"))
    rows = members.join(bounds, "h").select("chunk", "h", "n", "parts", "c").repartition("chunk").sortWithinPartitions("chunk")

    def settle(chunk, group):
        if len(group) > 1:
            hs = list(group)
            keep = may_link(np.stack([group[h][1] for h in hs]), np.array([group[h][0] for h in hs]), np.array([group[h][2] for h in hs]))
            for h, k in zip(hs, keep):
                if k:
                    yield chunk, h

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["chunk", "h"])

    def run(batches):
        now, group, out = None, {}, []
        for b in batches:
            for c, h, n, p, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist()):
                if c != now:
                    out += settle(now, group)
                    now, group = c, {}
                group[h] = n, np.frombuffer(p.as_buffer(), "<u2"), k
            if len(out) > 10_000:
                yield batch(out)
                out = []
        yield batch([*out, *settle(now, group)])

    return arrow_map(rows, run, "chunk long, h long")


def _trie_join(members: DataFrame, signed: DataFrame, docs: DataFrame, counts) -> DataFrame:
    """Links (a, b) among the sets of each chunk; ``members(chunk long, h long, c long)``, c the known class, a chunk's size bounded by its maker."""
    members = cut(_possible(members, signed))
    bits = members.sparkSession.sparkContext.broadcast(bit_filter(members, "h", FILTER_BITS))
    rows = members.join(_sets_of(docs, bits, counts), "h").select("chunk", "h", "s")

    def run(batches):
        now, group = None, {}
        out: list[tuple[int, int]] = []
        for b in batches:
            for c, h, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if c != now:
                    out += chunk_links(list(group.items()))
                    now, group = c, {}
                group[h] = np.frombuffer(s.as_buffer(), "<u8")
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
                out = []
        out += chunk_links(list(group.items()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return arrow_map(rows.repartition("chunk").sortWithinPartitions("chunk"), run, "a long, b long")


def _spread(h: str, k: str):
    return F.pmod(F.xxhash64(h, F.lit(17)), F.col(k))


def _hub_chunks(lists: DataFrame) -> DataFrame:
    """(chunk, h, c): each hub with its members, the hub in every chunk; no class is known yet, so c is h."""
    pairs = lists.where("h <> hub").groupBy("hub", "h").agg(F.count("*").alias("c")).select("hub", "h")
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("k"))
    named = lambda i: F.xxhash64("hub", i)
    spread = pairs.join(sizes, "hub").select(named(_spread("h", "k")).alias("chunk"), "h")
    return spread.union(sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i")).select(named(F.col("i")).alias("chunk"), F.col("hub").alias("h"))).withColumn("c", F.col("h"))


def _rest_chunks(lists: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(chunk, h, c) for lists of three or more sets that are not all of one class; null if there are none.

    Such lists with the same hub are joined as one. Its largest class has no unknown link inside, so
    that class's blocks meet only the blocks of the others; those meet one another too.
    """
    rows = lists.join(classes.select(F.col("node").alias("h"), "component"), "h", "left").select("token", "hub", "h", F.coalesce("component", "h").alias("c"))
    mixed = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("n >= 3 and low <> high").select("token")
    rest = cut(rows.join(mixed, "token").select(F.col("hub").alias("list"), "h", "c").distinct())
    if rest.isEmpty():
        return None
    per = rest.groupBy("list", "c").agg(F.count("*").alias("n"))
    sizes = per.groupBy("list").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("top")).select("list", F.col("top.c").alias("main"), F.ceil(F.col("top.n") / CHUNK).cast("long").alias("ka"), F.ceil((F.col("n") - F.col("top.n")) / CHUNK).cast("long").alias("ko"))
    rows = rest.join(sizes, "list")
    a = rows.where("c = main").select("list", "h", "c", _spread("h", "ka").alias("p"), F.explode(F.sequence(F.col("ka"), F.col("ka") + F.col("ko") - 1)).alias("q"))
    o = rows.where("c <> main").select("list", "h", "c", (F.col("ka") + _spread("h", "ko")).alias("p"), "ka", "ko").select("list", "h", "c", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ka") + F.col("ko") - 1)).alias("q")).where("p <> q")
    return a.union(o).select(F.xxhash64("list", F.least("p", "q"), F.greatest("p", "q")).alias("chunk"), "h", "c")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``; component_id is the least doc_id reachable by links."""
    return _classes(docs).select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame) -> DataFrame:
    """The rows of ``jaccard_classes`` with ``h``, the hash of the row's set."""
    context = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    counts = context.broadcast(_sketch(docs))
    signed = cut(_signatures(docs, counts))
    # lists of at least two different sets, one of which indexes the shingle
    lists = cut(_postings(signed).groupBy("token").agg(F.min("h").alias("hub"), F.max("h").alias("last"), F.max("lead").alias("lead")).where("hub <> last and lead = 1").select("token", "hub"))
    bits = context.broadcast(bit_filter(lists, "token", FILTER_BITS))
    members = cut(_postings(signed, bits).groupBy("token", "h").agg(F.count("*").alias("c")).select("token", "h").join(lists, "token"))
    links = _trie_join(_hub_chunks(members), signed, docs, counts)
    links = cut(links)
    classes = components(links)
    rest = _rest_chunks(members, classes)
    if rest is not None:  # only what joins known classes is new
        names = classes.select("node", "component")
        more = cut(_trie_join(rest, signed, docs, counts))
        for end in ("a", "b"):
            more = more.join(names.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        merged = components(more.where("a <> b").select("a", "b"))
        over = merged.select(F.col("node").alias("component"), F.col("component").alias("top"))
        named = classes.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        classes = cut(named.union(merged.select("node", "component")).groupBy("node").agg(F.min("component").alias("component")))
    counts.destroy()  # all that used it is written
    ids = cut(signed.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("first")).join(classes.select(F.col("node").alias("h"), "component"), "h", "left").select("h", "first", F.coalesce("component", "h").alias("component")))
    least = cut(ids.groupBy("component").agg(F.min("first").alias("component_id")))  # written, so that the join may split a large class
    of_set = cut(ids.join(least, "component").select("h", "component_id"))
    whole = signed.select("doc_id", "h", "n").join(of_set, "h", "left")
    return whole.select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _in_bits(ids, bits):
    """Column: may this hashed id be one that set ``bits``; null ids are not."""

    @F.arrow_udf("boolean")
    def hit(h: pa.Array) -> pa.Array:
        return pa.array(in_filter(np.asarray(h.cast(pa.int64())), bits.value))

    return ids.isNotNull() & hit(F.xxhash64(ids.cast("long")))


def _with_set_hash(rows: DataFrame, text: str = "text", name: str = "__h") -> DataFrame:
    at = rows.columns.index(text)

    def run(batches):
        for b in batches:
            h = [set_hash(s) if len(s) else None for s in sets(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h, pa.int64())], [*b.schema.names, name])

    return arrow_map(rows, run, rows.withColumn(name, F.lit(None).cast("long")).schema)


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the least id, with its own columns; empty texts are each their own class.

    Rows without an id always stay, and so do all rows that repeat a kept id with a text of the same class. Where an id is repeated with texts of
    different classes, each row goes or stays with its own class.

    Whole rows are not shuffled where ids suffice: rows outside a filter of the dropped ids stay at once; of the others, an anti join of ids alone
    finds those to spare, and only rows that pass a filter of these meet them in a join. Both filters are 2^24 bits; beyond some ten million
    dropped ids they let more through, and the joins, which are exact, do more of the work.
    """
    context, ids = docs.sparkSession.sparkContext, F.col("doc_id")
    verdicts = cut(_classes(docs).where("doc_id is not null").select(ids.cast("long").alias("__drop"), "h", (F.col("component_id") < ids).alias("gone")))
    drop = cut(verdicts.groupBy("__drop").agg(F.min("gone").alias("all_gone"), F.max("gone").alias("some_gone")).where("some_gone"))
    mixed = cut(verdicts.where("not gone").join(drop.where("not all_gone").select("__drop"), "__drop", "left_semi").select(F.col("__drop").alias("__id"), F.col("h").alias("__kept")).distinct())
    drop = drop.select("__drop")
    gone = _in_bits(ids, context.broadcast(bit_filter(drop.select(F.xxhash64("__drop").alias("b")), "b", FILTER_BITS)))
    doubtful = docs.where(gone).select(ids.cast("long").alias("__spared")).distinct()
    spared = cut(doubtful.join(drop, doubtful["__spared"] == drop["__drop"], "left_anti"))
    back = _in_bits(ids, context.broadcast(bit_filter(spared.select(F.xxhash64("__spared").alias("b")), "b", FILTER_BITS)))
    rest = docs.where(gone & back)
    kept = docs.where(~gone).union(rest.join(spared, rest["doc_id"].cast("long") == spared["__spared"], "left_semi"))
    if not mixed.isEmpty():
        of_mixed = _with_set_hash(docs.join(mixed.select("__id").distinct(), ids.cast("long") == F.col("__id"), "left_semi"))
        kept = kept.union(of_mixed.join(mixed, (of_mixed["doc_id"].cast("long") == mixed["__id"]) & of_mixed["__h"].eqNullSafe(mixed["__kept"]), "left_semi").drop("__h"))
    return kept
