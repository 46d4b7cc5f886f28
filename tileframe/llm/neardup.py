"""N-gram Jaccard join: all links between documents whose word-shingle sets overlap enough.

A document's set is its distinct shingles of ``width`` words (A-Z lowered, words between ASCII white space); with fewer words, the
whole sequence as one; without words or text it is empty and linked with nothing. Sets are compared as 64-bit shingle hashes. Equal sets
are one node. Two nodes link when den * intersection >= num * union.

Which nodes can link at all comes from an exact filter, size class by size class: a pair belongs to the class of its larger set, where
sets that link differ in at most H shingles. If hashes are dealt into H + 1 + S parts, S + 1 at least agree, so two sets share a part that
has shingles unless both have more than S empty parts; those share a pair of empty parts. S is chosen so that few sets have as many. A set
with e empty parts shares S + 1 - e parts that have shingles with each set that it links with, so it can do without S - e of its keys: in one order for
all sets, those that come first. This order begins with keys that are common in a sample, so that sets with no more than a passage in common don't meet.
Nodes that share a key of a class form a block. While that leaves large blocks, hashes are dealt into other parts and blocks are formed within blocks:
sets that link meet each time, others by chance. Larger blocks are cut into chunks, and each pair of chunks is a group of its own. In a
group a signature tree, gone down against itself, tells which pairs can overlap enough; their overlaps are counted
exactly, so every link between different sets is found once.

Rows keep their place: one row out for each row in, repeated ids and rows included; an empty table gives no rows. Other columns are not
read, whatever their names (``keep_one`` takes __id, __hash, __text_hash and __row for itself). component_id is the least id of the rows
of linked nodes (NULL ids count only where there are no others); for an empty set it is the row's own id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileframe.llm.common import materialise, mix, release, slices
from tileframe.llm.components import components

#: Members of a chunk of a block at most, and shingles of all its members, about; a group has at most two chunks.
GROUP = 512
GROUP_SHINGLES = 1 << 20
#: Keys that a bucket gets, about, that are looked at together, and that a worker gathers before it deals them out.
BUCKET_KEYS = 500_000
FOLDED_KEYS = 1_500_000
HELD_KEYS = 1_000_000
#: Keys that are known to be common, at most, and texts, about, of which they are told.
COMMON_KEYS = 200_000
COMMON_TEXTS = 100_000
#: Hashes are dealt anew, at most so often, while large blocks get smaller by this share at least.
DEALS = 5
LESS = 0.25
#: Nodes in blocks, up to this number, are broadcast to pick their texts (24 bytes each); beyond it the join is dealt out.
BROADCAST_NODES = 1_000_000
#: Shingles, and pairs of nodes, handled at a time.
SLAB = 4096
#: 64-bit words of a token bitmap, and children of a node of the signature tree.
WORDS = 64
FANOUT = 4
#: Bytes of text handled at a time.
SLICE_BYTES = 1 << 20
#: Bytes of shingles in a group after which freed memory is given back.
RELEASE_BYTES = 1 << 22


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    coded = cut.flatten().dictionary_encode()
    # Lowered here, A-Z only: Arrow's own lowering misreads a slice of a larger array.
    words = [x.lower() for x in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    codes = coded.indices.to_numpy()
    real = np.array([bool(x) for x in words], bool)[codes]
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy())
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), "uint64", len(words))[codes[real]]
    sizes = np.bincount(owner[real], minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    runs = rolled(h, width)
    return [np.unique(runs[at : at + n - width + 1] if n >= width else rolled(h[at : at + n], n)) if n else np.empty(0, "uint64") for at, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each ``width`` neighbours."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, "uint64")
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


class Ranks:
    """Common keys, the most frequent one first."""

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.places = keys[order], order

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; keys that aren't common come after all."""
        if not len(self.keys):
            return np.zeros(len(keys), "int64")
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.places[at], len(self.keys))


class Classes:
    """Size classes with the number of parts of each, for a similarity of num / den."""

    def __init__(self, num: int, den: int, ratio: float = 1.2):
        self.num, self.den = num, den
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * ratio)))
        self.parts, self.spare, self.kept = [], [], []
        for low, up in zip(self.starts, self.starts[1:], strict=False):
            h = 2 * (up - 1) * (den - num) // (den + num)
            least, spare = -(-low * num // den), 1
            for _ in range(20):
                empty = (h + 1 + spare) * math.exp(-least / (h + 1 + spare))
                spare = min(h + 1, max(spare, math.ceil(empty + 3 * math.sqrt(empty))))
            self.parts.append(h + 1 + spare if h else 0)  # 0: only equal sets link
            self.spare.append(spare)
            self.kept.append(h + 1 if h else 0)

    def home(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def members(self) -> list[int]:
        """How many members of a block of each class make a chunk."""
        return [max(16, min(GROUP, GROUP_SHINGLES // x)) for x in self.starts]

    def of(self, size: int) -> list[int]:
        """The class of a set as the larger one of a pair, then those where it can be the smaller one."""
        return [c for c in range(self.home(size), self.home(size * self.den // self.num) + 1) if self.parts[c]]

    def keys(self, h: np.ndarray, deal: int = 0, places: list[dict] | None = None, common: Ranks | None = None) -> np.ndarray:
        """The last eight bits of a key are its class. deal: which way hashes are dealt into parts. places: the classes that are left and the blocks
        that keys are for; None: all classes. common: keys that a set can do without are left out, the most common ones first, then by their value;
        None: all keys."""
        out = []
        for c, block in [(x["class"], x["block"]) for x in places] if places is not None else [(c, 0) for c in self.of(len(h))]:
            n = self.parts[c]
            dealt = (mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5 ^ c ^ deal << 16)) % np.uint64(n)).astype("int64")
            order = np.argsort(dealt, kind="stable")
            full, at = np.unique(dealt[order], return_index=True)
            sums = np.add.reduceat(mix(h + np.uint64(c + 1))[order], at)
            found = [mix(sums + mix(np.uint64(c << 32) + full.astype("uint64")))]
            if n - len(full) > self.spare[c]:
                empty = np.setdiff1d(np.arange(n), full)
                i, j = np.triu_indices(len(empty), 1)
                found.append(mix(mix(np.uint64((c << 32) + 7) + empty[i].astype("uint64")) * np.uint64(3) + empty[j].astype("uint64")))
            own = np.concatenate(found)
            if block:
                own = mix(own ^ np.uint64(block & (1 << 64) - 1))
            own = own & ~np.uint64(255) | np.uint64(c)
            over = self.spare[c] - (n - len(full))
            out.append(own[np.lexsort([own, common.of(own)])[over:]] if over > 0 and common is not None else own)
        return np.concatenate(out) if out else np.empty(0, "uint64")


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """64 bits of each set; of no meaning for empty ones."""
    sums = np.array([np.add.reduce(mix(h ^ np.uint64(0x5DEECE66D))) for h in sets], "uint64")
    return mix(sums + np.array([len(h) for h in sets], "uint64")).view("int64")


def sets_of(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (NULL for an empty set) and n_keys (about), of columns doc_id and text."""
    classes = Classes(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES, 1000):
            found = shingle_sets(batch.column("text"), width)
            sizes = np.array([len(h) for h in found])
            keys = pa.array([sum(classes.kept[c] for c in classes.of(n)) if n else 0 for n in sizes.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes), pa.array(nodes_of(found), mask=sizes == 0), keys], ["doc_id", "text_hash", "n_shingles", "node", "n_keys"])

    with_hash = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_hash.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, node bigint, n_keys bigint")


def common_keys(texts: DataFrame, width: int, num: int, den: int, deal: int, rows: int) -> Ranks:
    """Keys that many sets have, of about COMMON_TEXTS of the rows, picked by a hash. They only set the order in which keys are done without, so any will do."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, held, n = Classes(num, den), {}, 0

        def often() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate([*held.values(), np.empty(0, "uint64")]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys[times > 1].view("int64")), pa.array(times[times > 1])], ["key", "n"])

        for batch in slices(batches, "text", SLICE_BYTES, 1000):
            found = shingle_sets(batch.column("text"), width)
            for node, h, places in zip(nodes_of(found).tolist(), found, batch.column("places").to_pylist(), strict=True):
                if len(h) and node not in held:
                    held[node] = classes.keys(h, deal, places)
                    n += len(held[node])
            if n >= HELD_KEYS:
                yield often()
                held, n = {}, 0
        yield often()

    some = texts.select("text", "places").where(F.pmod(F.xxhash64("text"), F.lit(max(1, rows // COMMON_TEXTS))) == 0)
    found = some.mapInArrow(counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(COMMON_KEYS).toArrow()
    return Ranks(found.column("key").to_numpy().view("uint64"))


def nodes_that_meet(texts: DataFrame, width: int, num: int, den: int, deal: int, buckets: int, common: Ranks) -> DataFrame:
    """node, low and class, distinct: nodes that share a key of the class (and block, if they have places) with the centre of that key. Pairs of two nodes of lesser classes don't count
    and are left out where a bucket can be looked at as a whole."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, held, homes, n = Classes(num, den), {}, {}, 0

        def packed() -> pa.RecordBatch:
            keys = np.concatenate([*held.values(), np.empty(0, "uint64")])
            nodes = np.repeat(np.fromiter(held, "int64", len(held)), [len(x) for x in held.values()])
            own = np.repeat(np.array([homes[x] for x in held], "int64"), [len(x) for x in held.values()]) == (keys & np.uint64(255)).astype("int64")
            bucket = ((keys >> np.uint64(8)) % np.uint64(buckets)).astype("int32")
            order = np.argsort(bucket, kind="stable")
            some, at = np.unique(bucket[order], return_index=True)
            at = np.append(at, len(order))
            cut = [order[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            # Keys of one node are neighbours, so that nodes take little room.
            zipped = lambda values: pa.array([pa.compress(values[x].tobytes(), codec="zstd", asbytes=True) for x in cut], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array([keys[x].tobytes() for x in cut], pa.binary()), zipped(nodes), zipped(own)], ["bucket", "keys", "nodes", "own"])

        for batch in slices(batches, "text", SLICE_BYTES, 1000):
            found = shingle_sets(batch.column("text"), width)
            for node, h, places in zip(nodes_of(found).tolist(), found, batch.column("places").to_pylist(), strict=True):
                if len(h) and node not in held:
                    held[node], homes[node] = classes.keys(h, deal, places, shared.value), classes.home(len(h))
                    n += len(held[node])
            if n >= HELD_KEYS:
                yield packed()
                held, homes, n = {}, {}, 0
        yield packed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, centre = np.empty(0, "uint64"), np.empty(0, "int64")
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def folded(whole: bool) -> pa.RecordBatch:
            """Adds what is held to the known keys; a key keeps the centre it has, and what comes later meets that. whole: nothing comes before
            or later, so keys without a node of their class can go."""
            nonlocal known, centre
            keys, nodes, own = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort([nodes, ~own, keys])
            keys, nodes, own = keys[order], nodes[order], own[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            n = np.diff(np.append(first, len(keys)))
            low = nodes[first].copy()
            if not whole:
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys[first]), len(known) - 1)
                    old = known[at] == keys[first]
                    low[old] = centre[at[old]]
                    new = first[~old]
                    place = np.searchsorted(known, keys[new])
                    known, centre = np.insert(known, place, keys[new]), np.insert(centre, place, nodes[new])
                else:
                    known, centre = keys[first], nodes[first]
            low = np.repeat(low, n)
            apart = low != nodes
            if whole:
                apart &= np.repeat(own[first], n)
            found = np.unique(np.stack([np.maximum(nodes, low)[apart], np.minimum(nodes, low)[apart], (keys[apart] & np.uint64(255)).astype("int64")], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(3)], ["node", "low", "class"])

        n, folds = 0, 0
        for batch in batches:
            for keys, nodes, own in zip(batch.column("keys"), batch.column("nodes"), batch.column("own"), strict=True):
                if n >= FOLDED_KEYS:
                    yield folded(False)
                    n, folds = 0, folds + 1
                x = np.frombuffer(keys.as_py(), "uint64")
                held.append((x, np.frombuffer(pa.decompress(nodes.as_py(), x.nbytes, codec="zstd", asbytes=True), "int64"), np.frombuffer(pa.decompress(own.as_py(), len(x), codec="zstd", asbytes=True), "bool")))
                n += len(x)
        if held:
            yield folded(not folds)
        release()

    shared = texts.sparkSession.sparkContext.broadcast(common)
    sent = texts.select("text", "places").mapInArrow(send, "bucket int, keys binary, nodes binary, own binary")
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, "node bigint, low bigint, class bigint").distinct()


class SignatureTree:
    """Sets under nodes of FANOUT children. A node has the OR of its members' token bitmaps, the range of their sizes, and
    ``spare``: by how much the size of a member exceeds the bits of its bitmap at most."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(x) for x in sets])
        # Near copies share their least hashes: sets in this order lie beside their like, and bitmaps of nodes stay thin.
        self.order = np.lexsort([np.array([x[min(k, len(x) - 1)] for x in sets]) for k in (2, 1, 0)])
        bits = np.zeros((len(sets), WORDS), "uint64")
        for row, x in zip(bits, sets, strict=True):
            place = (x >> np.uint64(40)) % np.uint64(64 * WORDS)
            np.bitwise_or.at(row, (place >> np.uint64(6)).astype("int64"), np.uint64(1) << (place & np.uint64(63)))
        spare = sizes - np.bitwise_count(bits).sum(1, dtype="int64")
        self.levels = [tuple(x[self.order] for x in (bits, sizes, sizes, spare))]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, spare = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))

    def survivors(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of sets that may link: both trees (here one with itself) are gone down together, level by level.

        Shared tokens of two members lie on bits that both nodes have, and no set has more tokens than bits by more than its spare, so
        the most that two members can share is the number of common bits and the lesser spare. A node pair whose
        bound is too low for its smallest sizes, or whose sizes lie too far apart, goes with all pairs below it.
        """
        a = b = np.zeros(1, "int64")
        for depth in range(len(self.levels) - 1, -1, -1):
            bits, low, high, spare = self.levels[depth]
            keep = [np.empty(0, bool)]
            for at in range(0, len(a), SLAB):
                x, y = a[at : at + SLAB], b[at : at + SLAB]
                most = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype="int64") + np.minimum(spare[x], spare[y])
                most = np.minimum(most, np.minimum(high[x], high[y]))
                keep.append(((num + den) * most >= num * (low[x] + low[y])) & (den * high[x] >= num * low[y]) & (den * high[y] >= num * low[x]))
            keep = np.concatenate(keep)
            a, b = a[keep], b[keep]
            if depth:
                n = len(self.levels[depth - 1][1])
                i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
                a, b = (a[:, None] * FANOUT + i).ravel(), (b[:, None] * FANOUT + j).ravel()
                real = (a < n) & (b < n) & (a <= b)
                a, b = a[real], b[real]
        a, b = a[a != b], b[a != b]
        return self.order[a], self.order[b]


def all_links(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Whether each two sets link, as a square of booleans; a set isn't linked with itself. What the tree leaves is counted exactly."""
    links = np.zeros((len(sets), len(sets)), bool)
    a, b = SignatureTree(sets).survivors(num, den)
    if len(a):
        some = np.unique(np.concatenate([a, b]))
        both = overlaps([sets[k] for k in some])[np.searchsorted(some, a), np.searchsorted(some, b)]
        sizes = np.array([len(x) for x in sets])
        found = den * both >= num * (sizes[a] + sizes[b] - both)
        links[a[found], b[found]] = links[b[found], a[found]] = True
    return links


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share. Shingles of one set only can't overlap."""
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token = token[order]
    new = np.append(True, token[1:] != token[:-1])[: len(token)]
    del token
    # A token is shared unless both it and the next one are new.
    shared = ~(new & np.append(new[1:], True))
    owner = np.repeat(np.arange(len(sets), dtype="int32"), [len(x) for x in sets])[order[shared]]
    del order
    column = np.cumsum(new[shared], dtype="int32") - 1
    both = np.zeros((len(sets), len(sets)), "int64")
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        low, high = np.searchsorted(column, [at, at + SLAB])
        has = np.zeros((len(sets), SLAB), "float32")
        has[owner[low:high], column[low:high] - at] = 1
        both += (has @ has.T).astype("int64")
    return both


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join what the links join, a star for each component."""
    apart, found = np.ones(len(links), bool), []
    for root in range(len(links)):
        if not apart[root]:
            continue
        apart[root], ring = False, np.array([root])
        while len(ring):
            ring = np.flatnonzero(links[ring].any(0) & apart)
            apart[ring] = False
            found += [(root, int(x)) for x in ring]
    return found


def link(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Of each group block, i, j (chunks): edges a, b that join what is linked, and for each node a the rows n of the nodes it links with (b NULL).

    A pair counts in the block of its larger set's class only; between two chunks, only pairs across them count.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes, copies, home, chunk = (group[x].to_numpy() for x in ("node", "n_copies", "home", "chunk"))
        links = all_links([np.frombuffer(x, "uint64") for x in group["shingles"]], num, den)
        links &= np.maximum(home[:, None], home[None, :]) == group["class"].iloc[0]
        if group["i"].iloc[0] != group["j"].iloc[0]:
            links &= chunk[:, None] != chunk[None, :]
        edges, n = spanning(links), links @ copies
        some = np.flatnonzero(n)
        a = np.concatenate([nodes[[x for x, _ in edges]], nodes[some]]) if len(some) else nodes[:0]
        b = [int(nodes[y]) for _, y in edges] + [None] * len(some)
        if sum(map(len, group["shingles"])) > RELEASE_BYTES:
            release()
        return pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "n": [0] * len(edges) + n[some].tolist()})

    return rows.select("block", "i", "j", "class", "chunk", "node", "n_copies", "home", "shingles").groupBy("block", "i", "j").applyInPandas(run, "a bigint, b bigint, n bigint")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (rows with an equal set), n_links (other rows it links with, equal sets included), text_hash and component (NULL for an empty set) of each row of docs."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialise(sets_of(plain, width, num, den), "sets")
    nodes = materialise(sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_copies"), F.min(F.struct("doc_id", "text_hash")).alias("first")), "nodes")

    # Blocks: nodes that share a key of a class. Sets that link do so however hashes are dealt, so blocks are taken apart by dealing anew.
    n_keys = sets.groupBy("node").agg(F.max("n_keys").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    classes = Classes(num, den)
    limits, kept = (F.array(*[F.lit(n) for n in x]) for x in (classes.members(), classes.kept))
    firsts = nodes.select("node", "n_copies", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    repeated = not sets.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    texts = plain.select("text", F.lit(None).cast("array<struct<block: bigint, class: bigint, chunks: bigint>>").alias("places"))
    rows, load = sets.count(), None
    for deal in range(DEALS):
        buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_keys // BUCKET_KEYS)
        common = common_keys(texts, width, num, den, deal, rows)
        met = materialise(nodes_that_meet(texts, width, num, den, deal, buckets, common), "met")
        edges = met.select(F.xxhash64("node", "class").alias("a"), F.xxhash64("low", "class").alias("b"))
        blocks = materialise(components(edges).withColumnRenamed("component", "block"), "blocks")
        large = materialise(blocks.groupBy("block").agg(F.count("*").alias("members")).where(F.col("members") > 16), "large")
        large = F.broadcast(large) if large.count() <= BROADCAST_NODES else large
        both = met.select("node", "class").unionByName(met.select(F.col("low").alias("node"), "class")).distinct()
        placed = both.withColumn("at", F.xxhash64("node", "class")).join(blocks.withColumnRenamed("node", "at"), "at").join(large, "block", "left")
        chunks = F.coalesce(F.ceil(F.col("members") / F.get(limits, F.col("class").cast("int"))), F.lit(1))
        places = placed.groupBy("node").agg(F.collect_list(F.struct("block", "class", chunks.alias("chunks"))).alias("places"))
        chosen = materialise(firsts.join(places, "node"), "chosen")
        rows = chosen.count()
        small_side = F.broadcast(chosen) if rows <= BROADCAST_NODES else chosen
        # Rows that share id and text are read once.
        texts = plain.withColumn("text_hash", F.xxhash64("text")).join(small_side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("node", "n_copies", "places", "text")
        if repeated:
            texts = texts.dropDuplicates(["node"])
        # What nodes in blocks of several chunks are copied.
        spent = load
        n_keys, load = chosen.select(F.inline("places")).agg(F.coalesce(F.sum(F.get(kept, F.col("class").cast("int"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("chunks") > 1, F.col("chunks"))), F.lit(0))).first()
        if 4 * load <= rows or spent is not None and load > (1 - LESS) * spent:
            break

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes = Classes(num, den)
        for batch in slices(batches, "text", SLICE_BYTES, 1000):
            found = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ("node", "n_copies", "places")), pa.array([homes.home(len(x)) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                ["node", "n_copies", "places", "home", "shingles"],
            )

    kind = chosen.schema["places"].dataType.simpleString()
    members = materialise(texts.mapInArrow(with_sets, f"node bigint, n_copies bigint, places {kind}, home bigint, shingles binary"), "members")
    members = members.select("node", "n_copies", "home", "shingles", F.inline("places")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    each = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    each = each.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    links = materialise(link(each, num, den), "links")
    n_links = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    found = components(links.where("b is not null").select("a", "b"))
    named = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").join(n_links, "node", "left").select(F.col("node").alias("_node"), "component_id", "n_copies", (F.col("n_copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    out = sets.select("doc_id", "n_shingles", "node", "text_hash").join(named, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_hash", "component")


def keep_one(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which the least id and text of each component and every empty set stay. Rows with one id and text
    become one: of those that differ in other columns, the one of least hash of all columns as JSON."""
    found = materialise(near_duplicates(docs, width, num, den, id_col, text_col).select("doc_id", "text_hash", "component"), "found")
    best = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select("x.doc_id", "x.text_hash")
    stay = best.unionByName(found.where(F.col("component").isNull()).select("doc_id", "text_hash").distinct()).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    stay = materialise(stay, "stay")
    stay = F.broadcast(stay) if stay.count() <= BROADCAST_NODES else stay
    hashed = docs.withColumn("__text_hash", F.xxhash64(text_col))
    kept = hashed.join(stay, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    if not found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        whole = F.struct(*[F.col(c) for c in docs.columns])
        kept = kept.groupBy(id_col, "__text_hash").agg(F.min_by(whole, F.struct(F.xxhash64(F.to_json(whole)), F.to_json(whole))).alias("__row")).select("__row.*")
    return kept.select(*docs.columns)
