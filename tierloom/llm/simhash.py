"""SimHash near-duplicates found with BK-trees.

Fingerprints: 64 bits; a bit is set if it is set in over half of the shingles' XXH64 values. Two fingerprints link at
`radius` or fewer differing bits, and a component is all that links reach.

Search: the bits are cut into blocks, more blocks than `radius`. Two linked fingerprints agree on all but `radius` blocks at
least, so each distinct fingerprint is routed to one shard per choice of the blocks that agree, and a shard holds a BK-tree:
children keyed by their Hamming distance to the parent, queries following only edges within the radius of their own
distance. Trees grow with the corpus, so they are placed beside their queries rather than broadcast. A shard that outgrows
`CELL` fingerprints is dealt in chunks to cells, one per pair of chunks, so that no link is lost and no task takes a hot
shard whole. A cell returns a spanning forest of its links, never all pairs.

similar_documents() takes the same trees to five-word shingles and a similarity that is verified: see there.

Null and empty texts have the fingerprint zero, which links like any other. Rows are kept as they are, repeated ones
included; a component whose ids are all null has a null component id. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, SPACE_BYTES, WHOLE, read, row_key, settle, sifted, sliced, whole_key, without
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: For documents by similarity: words of a shingle and the least similarity.
WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of a chunk of an oversized shard; mean shard load above which one more block is cut.
CELL, LOAD = 512, 32
#: Buckets of the shingle counts that order the prefixes, and pairs looked at at once.
BUCKETS, SLAB = 1 << 20, 1 << 16
#: Bits of a set's bitmap for each of its shingles (at least, and less than twice as many), and nodes of a rare shingle up to
#: which their pairs are named before any bitmap is fetched; more carry their bitmaps along.
DENSITY, FEW = 8, 32
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = (np.arange(8) * 256)[None, :]


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle as 8 big-endian bytes a row; no words, no rows."""
    w = (text or b"").translate(SPACE_BYTES).split()
    if not w:
        return np.empty((0, 8), np.uint8)
    digest = xxhash.xxh64_digest
    line = b" ".join(w)
    if len(w) <= words:
        out = digest(line, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        out = b"".join([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)])
    return np.frombuffer(out, np.uint8).reshape(-1, 8)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the rows of 8 bytes."""
    if not len(h):
        return 0
    counts = np.bincount((h + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((counts @ _BITS).ravel() * 2 > len(h)).tobytes(), "big")


def fingerprint(text: bytes | None, words: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """id, the row's key and fp (the fingerprint as a signed long), one row per row of docs."""
    own = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(3).cast(pa.binary())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found.view(np.int64))], names=["id", *KEY, "fp"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, _k1 long, _k2 int, fp long")


class BKTree:
    """Nodes are [value, children by distance]; values are ints."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while (d := (node[0] ^ value).bit_count()) and (child := node[1].get(d)):
            node = child
        if d:
            node[1][d] = [value, {}]

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                found.append(node[0])
            todo += [child for edge, child in node[1].items() if d - radius <= edge <= d + radius]
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning edges (indexes) of the links among values: each is looked up in the tree of those before it."""
    tree, at, up, out = BKTree(), defaultdict(list), list(range(len(values))), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, v in enumerate(values):
        for w in tree.within(v, radius):
            for j in at[w]:
                if (a := top(i)) != (b := top(j)):
                    up[max(a, b)] = min(a, b)
                    out.append((i, j))
        tree.add(v)
        at[v].append(i)
    return out


def _cuts(n: int, radius: int) -> list[int]:
    """For each choice of agreeing blocks the mask of their bits; one block more until the mean shard is small."""
    for blocks in range(radius + 1, radius + 5):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        keep = [sum(c) for c in combinations(masks, blocks - radius)]
        if n / 2 ** min(m.bit_count() for m in keep) <= LOAD:
            break
    return [m - (1 << 64) if m >> 63 else m for m in keep]


def _cells(routed: DataFrame) -> DataFrame:
    """routed: fp, cut, key -> one row per cell of two fingerprints or more: items (array of fp)."""
    large = routed.groupBy("cut", "key").count().where(F.col("count") > 2 * CELL).select("cut", "key", F.ceil(F.col("count") / CELL).cast("int").alias("chunks"))
    dealt = routed.join(large, ["cut", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = dealt.select("fp", "cut", "key", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    return dealt.groupBy("cut", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.collect_list("fp").alias("items")).where(F.size("items") > 1).select("items")


def _joined(cells: DataFrame, radius: int) -> DataFrame:
    """Edges a, b between the fingerprints of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, found = b.column(0), []
            offsets, item = column.offsets.to_pylist(), column.values.to_numpy()
            values = item.view(np.uint64).tolist()
            for a, z in zip(offsets, offsets[1:], strict=False):
                found += [(a + i, a + j) for i, j in forest(values[a:z], radius)]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(item[pairs[:, 0]]), pa.array(item[pairs[:, 1]])], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct fp -> a, b: edges that connect whatever links connect."""
    cuts = [F.struct(F.lit(i).alias("cut"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_cuts(distinct.count(), radius))]
    return _joined(_cells(distinct.select("fp", F.explode(F.array(*cuts)).alias("s")).select("fp", "s.*")), radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id, row key, fp, root, component: for each row its component's name and the smallest id that links reach from it."""
    prints = settle(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    known = settle(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    first = known.groupBy("root").agg(F.min("first").alias("component"))
    return prints.join(known.join(first, "root").select("fp", "root", "component"), "fp").select("id", *KEY, "fp", "root", "component")


_POWER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the distinct shingles of a text, in order. Fewer words than a shingle's: the whole sequence."""
    w = (text or b"").translate(SPACE_BYTES).split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    n = len(w) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = s * _POWER + h[i : i + n]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def bitmap(shingles: np.ndarray) -> bytes:
    """A set's bitmap: one bit a shingle, in a power of two of bits that follows the set's size."""
    wide = max(64, DENSITY << max(0, len(shingles).bit_length() - 1))
    bits = np.zeros(wide, np.uint8)
    bits[(shingles & np.uint64(wide - 1)).view(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _ratio(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction, so that whole numbers decide what is similar."""
    return Fraction(str(similarity)).as_integer_ratio()


def prefix(shingles: np.ndarray, counts: np.ndarray, up: int, down: int) -> np.ndarray:
    """The rarest shingles of a set, rarest first, so many that sets of the similarity up / down have one of theirs in common."""
    n = len(shingles)
    order = np.lexsort((shingles, counts[(shingles % np.uint64(BUCKETS)).view(np.int64)]))
    return shingles[order[: n - -(-up * n // down) + 1]] if n else shingles


class Bitmaps:
    """The bitmaps of an Arrow column; may() tells which pairs of rows may have the similarity up / down."""

    def __init__(self, column: pa.Array, sizes: np.ndarray, up: int, down: int) -> None:
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.at, self.wide, self.sizes, self.up, self.down = at[:-1], np.diff(at), sizes.astype(np.int64), up, down

    def _rows(self, i: np.ndarray, own: int, wide: int) -> np.ndarray:
        rows = self.data[self.at[i][:, None] + np.arange(own)].view(np.uint64)
        while rows.shape[1] * 8 > wide:  # the upper half of the bits is laid on the lower one
            half = rows.shape[1] // 2
            rows = rows[:, :half] | rows[:, half:]
        return rows

    def may(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """False only where the sets cannot have the similarity: by their sizes, or by the bits that one has and the other lacks."""
        out = np.zeros(len(i), bool)
        a, b = self.sizes[i], self.sizes[j]
        fit = np.flatnonzero(np.minimum(a, b) * self.down >= np.maximum(a, b) * self.up)
        for x, y in {*zip(self.wide[i[fit]].tolist(), self.wide[j[fit]].tolist(), strict=True)}:
            own = fit[(self.wide[i[fit]] == x) & (self.wide[j[fit]] == y)]
            step = max(1, (SLAB * 256) // max(x, y))
            for k in range(0, len(own), step):
                at = own[k : k + step]
                p, q = self._rows(i[at], x, min(x, y)), self._rows(j[at], y, min(x, y))
                both = np.bitwise_count(p & q).sum(1, dtype=np.int64)
                lost = np.maximum(np.bitwise_count(p).sum(1, dtype=np.int64) - both - a[at], np.bitwise_count(q).sum(1, dtype=np.int64) - both - b[at])
                out[at] = -lost * self.down >= (a[at] + b[at] + lost) * self.up
        return out


def shingled(docs: DataFrame, id_col: str, text_col: str, words: int, up: int, down: int) -> DataFrame:
    """id, WHOLE, node (a hash of the shingle set), fp (its SimHash), size, bits (its bitmap) and prefix of each row."""
    own = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), whole_key(docs), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in sliced(batches):
            found = [shingle_set(t.as_py(), words) for t in b.column(0).cast(pa.binary())]
            if found:
                n += np.bincount((np.concatenate(found) % np.uint64(BUCKETS)).view(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    # counts of all documents, by bucket: at most BUCKETS rows
    seen = own.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int32)
    counts[seen["bucket"].to_numpy()] = np.minimum(seen["n"].to_numpy(), 2**31 - 1)
    shared = own.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingle_set(t.as_py(), words) for t in b.column(4).cast(pa.binary())]
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            fp = np.array([majority(x.astype(">u8").view(np.uint8).reshape(-1, 8)) for x in sets], np.uint64).view(np.int64)
            size, bits = pa.array([len(x) for x in sets], pa.int32()), pa.array([bitmap(x) for x in sets], pa.binary())
            rarest = pa.array([prefix(x, shared.value, up, down).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(node), pa.array(fp), size, bits, rarest], names=["id", *WHOLE, "node", "fp", "size", "bits", "prefix"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, _k1 long, _k2 int, _k3 long, node long, fp long, size int, bits binary, prefix array<long>")


def _alike(a: str, b: str, up: int, down: int):
    """Sizes that sets of the similarity can have."""
    return F.least(a, b) * down >= F.greatest(a, b) * up


def plausible(rows: DataFrame, pairs: DataFrame, up: int, down: int) -> DataFrame:
    """The pairs a, b of nodes whose sizes and bitmaps allow the similarity."""
    ends = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    sizes = sifted(rows.select("node", "size"), ends, "node").join(ends, "node").groupBy("node").agg(F.min("size").alias("size"))
    sizes = settle(sizes, "sizes")
    pairs = pairs.join(sizes.toDF("a", "a_size"), "a").join(sizes.toDF("b", "b_size"), "b").where(_alike("a_size", "b_size", up, down))
    pairs = settle(pairs, "pairs")
    ends = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    known = settle(sifted(rows.select("node", "bits"), ends, "node").join(ends, "node").dropDuplicates(["node"]), "bitmaps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            n, one = len(t), lambda x, y: pa.concat_arrays([*t[x].chunks, *t[y].chunks])
            sizes = np.concatenate((t["a_size"].to_numpy(), t["b_size"].to_numpy()))
            keep = pa.array(Bitmaps(one("a_bits", "b_bits"), sizes, up, down).may(np.arange(n), np.arange(n, 2 * n)))
            yield from t.select(["a", "b"]).filter(keep).combine_chunks().to_batches()

    return pairs.join(known.toDF("a", "a_bits"), "a").join(known.toDF("b", "b_bits"), "b").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int, up: int, down: int) -> DataFrame:
    """The pairs a, b of nodes whose shingle sets have the similarity up / down, compared shingle by shingle."""
    ends = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    named = sifted(rows.select("node", *KEY), ends, "node").join(ends, "node").groupBy("node").agg(F.min(F.struct(*KEY)).alias("key"))
    named = settle(named.select("node", "key.*"), "named")
    own = sifted(docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")), named.select("_k1"), "_k1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [shingle_set(t.as_py(), words).view(np.int64) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = settle(own.join(named, KEY).select("node", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(common * down >= (F.size("x") + F.size("y") - common) * up).select("a", "b")


def _pairs(column: pa.ListArray, two: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes i, j of the items of each cell that may be of the similarity: of different labels, by size and by place in the prefix.

    two: whether a cell is made of two chunks, of which only pairs across are its own.
    """
    label, size, pos, chunk = (column.values.field(k).to_numpy() for k in range(1, 5))
    offsets = column.offsets.to_numpy()
    count = np.diff(offsets)
    for n in np.unique(count).tolist():
        x, y = np.triu_indices(n, 1)
        these, step = np.flatnonzero(count == n), max(1, 16 * SLAB // max(1, len(x)))
        for k in range(0, len(these), step):
            own = these[k : k + step]
            at = offsets[own][:, None] + np.arange(n)
            i, j = at[:, x].ravel(), at[:, y].ravel()
            keep = (label[i] != label[j]) & ((chunk[i] != chunk[j]) == np.repeat(two[own], len(x)))
            i, j = i[keep], j[keep]
            u, v = size[i].astype(np.int64), size[j].astype(np.int64)
            keep = np.minimum(u, v) * down >= np.maximum(u, v) * up
            keep &= np.minimum(u - pos[i], v - pos[j]) * (up + down) >= up * (u + v)  # holds at the first shingle in common
            yield i[keep], j[keep]


def _rest(rows: DataFrame, routed: DataFrame, labels: DataFrame, up: int, down: int) -> DataFrame:
    """Pairs a, b of nodes that share a token of their prefixes, are of different components so far and may have the similarity.

    routed: token, node, size, pos. A cell holds the nodes of one token, or two chunks of them.
    """
    units = routed.join(labels, "node", "left").select("token", "node", "size", "pos", F.coalesce("label", "node").alias("label"))
    units = settle(units, "units")
    mixed = units.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).where("a <> b").select("token", "n")
    units = settle(sifted(units, settle(mixed, "mixed"), "token").join(mixed, "token"), "units")
    item = ["node", "label", "size", "pos", "i"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column(0).values.field(0).to_numpy()
            for i, j in _pairs(b.column(0), np.zeros(b.num_rows, bool), up, down):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    cells = units.where(F.col("n") <= FEW).withColumn("i", F.lit(0)).groupBy("token").agg(F.collect_list(F.struct(*item)).alias("items"))
    few = plausible(rows, settle(cells.select("items").mapInArrow(name, "a long, b long").distinct(), "few"), up, down)
    many = units.where(F.col("n") > FEW).withColumn("chunks", F.when(F.col("n") > 2 * CELL, F.ceil(F.col("n") / CELL)).otherwise(1).cast("int"))
    ends = settle(many.select("node").distinct(), "ends")
    known = settle(sifted(rows.select("node", "bits"), ends, "node").join(ends, "node").dropDuplicates(["node"]), "bitmaps")
    dealt = many.join(known, "node").withColumn("i", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = dealt.groupBy("token", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high")).agg(F.collect_list(F.struct(*item, "bits")).alias("items"))
    cells = cells.where(F.size("items") > 1).select("items", (F.col("low") < F.col("high")).alias("two"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, two = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            node, size = column.values.field(0).to_numpy(), column.values.field(2).to_numpy()
            maps = Bitmaps(column.values.field(5), size, up, down)
            for i, j in _pairs(column, two, up, down):
                keep = maps.may(i, j)
                i, j = node[i[keep]], node[j[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    return few.unionByName(cells.mapInArrow(compare, "a long, b long")).distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """id, WHOLE and root: components of documents whose shingle sets have the similarity. A node is a set of shingles.

    Candidates come from two searches. SimHash fingerprints of the sets link in the BK-trees of links(), which joins close
    copies. Two sets of the similarity have a shingle in common among the rarest of each (the prefix), so each node is also
    paired with the least node of every such shingle. The pairs that bitmaps and then the whole sets confirm are links, and
    join most of each group at a cost in proportion to its size. What still shares a rare shingle across components is then
    compared pair by pair, by bitmaps, in cells of bounded size: no link is lost, and none is taken that is not verified.
    Rows of one set are never paired. The last step is quadratic in the unjoined nodes of one rare shingle, at 8 to 16 bits
    a shingle; beyond FEW nodes it emits only pairs that may be links.
    """
    up, down = _ratio(similarity)
    rows = settle(shingled(docs, id_col, text_col, words, up, down), "shingled")
    check = lambda pairs, name: settle(verified(docs, rows, pairs, id_col, text_col, words, up, down), name)
    # nodes by rare shingle; a shingle of one node alone, however many copies it has, is left out
    each = rows.select("node", "size", F.posexplode("prefix").alias("pos", "token"))
    shared = settle(each.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token", "low"), "shared")
    routed = settle(sifted(each, shared, "token").join(shared, "token"), "routed")
    prints = settle(rows.groupBy("fp").agg(F.min("node").alias("low"), F.max("node").alias("high")), "prints")
    first = prints.select("fp", "low")
    trees = settle(links(prints.select("fp")), "trees").join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = rows.select("fp", "node").distinct().join(prints.where("low <> high"), "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    close = routed.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    pairs = settle(trees.unionByName(same).unionByName(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    found = components(check(settle(plausible(rows, pairs, up, down), "plausible"), "links"))
    labels = found.select("node", F.col("root").alias("label"))
    rest = settle(_rest(rows, routed.drop("low").distinct(), labels, up, down), "rest")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(check(rest, "links")))
    return rows.select("id", *WHOLE, "node").join(roots, "node", "left").select("id", *WHOLE, F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component of similar_documents, with its own columns: of the smallest id (null last), then key."""
    found = settle(similar_documents(docs, id_col, text_col, **how), "near")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", *WHOLE)).alias("best")).select("best.*").select(*WHOLE)
    gone = found.select(*WHOLE).join(settle(best, "best"), WHOLE, "left_anti")
    twice = found.groupBy(*WHOLE).count().where("count > 1").select(*WHOLE)
    return without(docs, gone, [*row_key(id_col, text_col), whole_key(docs)], twice)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
