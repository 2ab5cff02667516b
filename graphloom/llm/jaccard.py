"""N-gram Jaccard join with signature trees.

Documents become sets of hashed word shingles.  Equal sets are one class; classes of a similarity of at least
percent / 100 must end up together:

1. families: classes that share a band of minimum hashes (a guess, which only decides what is compared where);
2. candidates across families, exactly: sets of that similarity share SHARED of their n - ceil(n * percent / 100) +
   SHARED first elements in any common order (small sets all that they need).  The order puts frequent shingles last,
   by a count sketch over all documents of fixed size, so that a passage in every third document is nobody's key.
   Postings travel as one row for each batch and hash range, and a family counts once in a batch; a pair of families
   whose shared keys are too few for any two of their documents is dropped (bound in _pair_bound).  Keys of more than
   HOT families give no pairs: they are added to the pairs of other keys as if all were shared, and join the families
   that have enough of them for a pair without any other key (_proposed);
3. blocks: families joined by those pairs.  In a block every pair is settled by a signature tree: nodes hold the OR of
   their documents' bitmaps and the range of their sizes, and a traversal of node pairs drops those whose largest
   possible overlap is too small and those that are linked already; what is left is compared exactly;
4. a block beyond block_rows documents is dealt over many tasks, by classes of set sizes and then by hash.  Eight
   pivots visit every part; then the documents outside the block's largest component visit the parts of their own and
   the neighbouring size classes.  Inside the largest component nothing is left to find, and sets further apart in
   size can't link, so no pair is lost and no part grows with the block.

join() needs only the components, so it leaves out pairs that are linked already.  links() and pairs() settle every
pair of classes instead: a block is dealt into tiles (two parts of the same or neighbouring size classes), the trees
drop leaves by sizes and overlap alone, and what is left of a tile is compared exactly at once by a matrix of overlaps.
Their work grows with the square of a group of different near copies, by definition.

Edge cases: null, empty and word-less texts have an empty set and link with nothing; texts shorter than the width are
one shingle; very long texts are compared whole; rows with the same doc_id are one node, so what any of them links with
is one component, and each gets its own n_shingles and class; rows without doc_id have no component (null) and link
nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, fanout, free, mix, need, pack, pack_sorted, scratch, shingles, slices, table, text_bytes, tidy, unpack, unpack_sorted, words
from .components import Forest, components

_BANDS, _ROWS = 4, 6
_ODD = np.random.default_rng(7).integers(1, 2**63, _BANDS * _ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CELLS, _BLOCKS = 1 << 22, 64
_FILTER_BITS = 1 << 24
LEAF, FAN = 8, 8


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By slice: rows lo..hi, all their sets behind each other (sorted within a row), and each row's offset."""
    buf, offs = text_bytes(column)
    for lo, hi in slices(offs):
        h, _, first = words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], SPACE)
        found, to = shingles(h, first, width)
        own = [np.unique(found[to[i] : to[i + 1]]) for i in range(hi - lo)]
        yield lo, hi, np.concatenate(own) if own else found, np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (_CELLS - 1)


def _sums(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[to[1:]] - total[to[:-1]]


def _marks(flat: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit marks of each set."""
    n = np.diff(to).astype(np.uint64)
    return mix(_sums(mix(flat), to) + n).view(np.int64), mix(_sums(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), to) ^ n).view(np.int64)


_PROFILE = "doc_id long,n long,mark1 long,mark2 long,bands binary,part int,counts binary"


def _profile(width: int):
    """A row for each document (size, marks, bands); at the end of a partition its share of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_CELLS, np.uint32)
        for batch in batches:
            for lo, hi, flat, to in _sets(batch.column(1), width):
                n = np.diff(to)
                some = np.flatnonzero(n)
                bands = np.zeros((hi - lo, _BANDS), np.uint64)
                if len(some):
                    np.add.at(counts, _cells(flat), np.uint32(1))
                    for k in range(_BANDS * _ROWS):
                        least = np.minimum.reduceat(flat * _ODD[k], to[:-1][some])
                        bands[some, k // _ROWS] = mix(bands[some, k // _ROWS] + least + np.uint64(k + 1))
                mark1, mark2 = _marks(flat, to)
                rows = hi - lo
                yield table(_PROFILE, doc_id=batch.column(0)[lo:hi], n=n, mark1=mark1, mark2=mark2, bands=[b.tobytes() for b in bands], part=pa.nulls(rows, pa.int32()), counts=pa.nulls(rows, pa.binary()))
        if counts.any():
            size = _CELLS // _BLOCKS
            blobs = [pack(np.minimum(counts[i * size : (i + 1) * size], 65535).astype(np.uint16)) for i in range(_BLOCKS)]
            none = pa.nulls(_BLOCKS, pa.int64())
            yield table(_PROFILE, doc_id=none, n=none, mark1=none, mark2=none, bands=pa.nulls(_BLOCKS, pa.binary()), part=range(_BLOCKS), counts=blobs)

    return run


def _add_counts(group: pa.Table) -> pa.Table:
    total = sum(unpack(b, np.uint16).astype(np.uint32) for b in group.column("counts").to_pylist())
    return pa.Table.from_batches([table("part int,counts binary", part=[group.column("part")[0].as_py()], counts=[pack(total)])])


# --------------------------------------------------------------------------- families


def _band_postings(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of each batch: a row for each bucket with keys and their smallest node, and links within the batch (bucket -1)."""
    for batch in batches:
        nodes = np.repeat(batch.column(0).to_numpy(), _BANDS)
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        head = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        least = nodes[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))] if len(keys) else nodes
        forest = Forest()
        for a, b in zip(nodes[~head].tolist(), least[~head].tolist()):
            forest.union(a, b)
        links = [(x, forest.find(x)) for x in forest.up]
        keys, nodes = keys[head], nodes[head]
        ends = np.searchsorted(_bucket(keys, parts), np.arange(parts + 1))
        used = np.flatnonzero(np.diff(ends))
        yield table("bucket int,keys binary,nodes binary", bucket=[*used, -1], keys=[*(keys[ends[i] : ends[i + 1]].tobytes() for i in used), np.array([a for a, _ in links], np.int64).tobytes()], nodes=[*(nodes[ends[i] : ends[i + 1]].tobytes() for i in used), np.array([b for _, b in links], np.int64).tobytes()])


def _bucket(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _band_links(group: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(b, np.uint64) for b in group.column("keys").to_pylist()])
    nodes = np.concatenate([np.frombuffer(b, np.int64) for b in group.column("nodes").to_pylist()])
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    head = np.concatenate(([True], keys[1:] != keys[:-1]))
    least = nodes[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))]
    pairs = np.unique(np.stack((nodes[~head], least[~head]), 1), axis=0)
    return pa.Table.from_batches([table("a long,b long", a=pairs[:, 0], b=pairs[:, 1])])


def _plain_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield table("a long,b long", a=np.frombuffer(a, np.int64), b=np.frombuffer(b, np.int64))


# --------------------------------------------------------------------------- candidates across families


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any set that it links with."""
    return (n * percent + 99) // 100


#: Keys that linked sets share at least; the smallest sets all that they need.
SHARED = 8


def _asked(n: np.ndarray, percent: int) -> np.ndarray:
    """Least number of keys that a set of n shares with any set that it links with and that is no smaller."""
    return np.minimum(_needed(n, percent), SHARED)


def _least(percent: int) -> int:
    """Size of the smallest set that can link with another set."""
    return 1 if percent <= 50 else 2


def _prefixes(counts, width: int, percent: int):
    """doc_id, mark1, n, keys: the first elements of each set, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(counts.value, np.uint8).astype(np.uint64) << np.uint64(58)
        for batch in batches:
            for lo, hi, flat, to in _sets(batch.column(1), width):
                n = np.diff(to)
                mark1, _ = _marks(flat, to)
                rank = order[_cells(flat)] | (flat >> np.uint64(6))
                size = n - _needed(n, percent) + _asked(n, percent)
                wide = np.flatnonzero(n >= _least(percent))
                keys = []
                for i in wide:
                    own = flat[to[i] : to[i + 1]]
                    keys.append(pack_prefix(np.sort(own[np.argpartition(rank[to[i] : to[i + 1]], size[i] - 1)[: size[i]]])))
                yield table("doc_id long,mark1 long,n long,keys binary", doc_id=batch.column(0)[lo:hi].take(pa.array(wide)), mark1=mark1[wide], n=n[wide], keys=keys)

    return run


def pack_prefix(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: equal keys only propose a pair, which is compared in full."""
    return (h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_prefix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


_POSTINGS = "bucket int,rows int,keys binary,at binary,family binary,least binary,most binary"


def _postings(parts: int):
    """Rows (family, n, keys) to a row for each batch and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [unpack_prefix(b) for b in batch.column(2).to_pylist()]
            sizes = [len(x) for x in lists]
            family, which = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            n = batch.column(1).to_numpy()
            least, most = np.full(len(family), np.iinfo(np.int64).max), np.zeros(len(family), np.int64)
            np.minimum.at(least, which, n)
            np.maximum.at(most, which, n)
            keys, owner = np.concatenate(lists), np.repeat(which, sizes)
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            keys, owner = keys[fresh], owner[fresh]
            ends = np.searchsorted(_bucket(keys, parts), np.arange(parts + 1))
            out: dict[str, list] = {x.split()[0]: [] for x in _POSTINGS.split(",")}
            for i in np.flatnonzero(np.diff(ends)):
                own, at = np.unique(owner[ends[i] : ends[i + 1]], return_inverse=True)
                out["bucket"].append(i)
                out["rows"].append(len(at))
                out["keys"].append(pack_sorted(keys[ends[i] : ends[i + 1]]))
                out["at"].append(pack(at.astype(np.uint16 if len(own) < 65536 else np.uint32)))
                out["family"].append(pack(np.diff(family[own], prepend=0)))
                out["least"].append(pack(least[own].astype(np.uint32)))
                out["most"].append(pack((most[own] - least[own]).astype(np.uint32)))
            yield table(_POSTINGS, **out)

    return run


_PAIRS = "a long,b long,shared long,least_a long,most_a long,least_b long,most_b long,run long"


#: Families that share a key up to which each pair is a candidate of its own.
HOT = 64
#: Pairs that a task holds before it hands them on; later sums put equal ones together.
HELD = 2_000_000


def hot_chain(least: np.ndarray, most: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that connect all families of these ranges of sizes which could hold sets that link.

    Families fit if their ranges [percent * least, 100 * most] overlap; in order of begin each that begins within the
    range so far is paired with the one before it.
    """
    low, high = percent * least, 100 * most
    order = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[order])
    on = np.flatnonzero(low[order][1:] <= reach[:-1]) + 1
    return order[on - 1], order[on]


def _pairs(percent: int, hot: int):
    """Pairs of families that share keys in a bucket, with the number of those keys.

    Of a key with many families not all pairs come, but a chain through those of fitting sizes, without a number and
    under the name of the run (null for others): the rows for a key are no more than its families.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, family, least, most = [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                own = np.cumsum(unpack(r["family"], np.int64))
                at = unpack(r["at"], np.uint16 if len(own) < 65536 else np.uint32).astype(np.int64)
                low = unpack(r["least"], np.uint32).astype(np.int64)
                keys.append(unpack_sorted(r["keys"], r["rows"]))
                family.append(own[at])
                least.append(low[at])
                most.append((low + unpack(r["most"], np.uint32))[at])
        keys, family, least, most = map(np.concatenate, (keys, family, least, most))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        twice = np.zeros(len(keys), bool)  # only keys with company
        same = keys[1:] == keys[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        order, keys = order[twice], keys[twice]
        family, least, most = family[order], least[order], most[order]
        order = np.lexsort((family, keys))
        keys, family, least, most = keys[order], family[order], least[order], most[order]
        head = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (family[1:] != family[:-1])))) if len(keys) else np.zeros(0, np.int64)
        if len(head):
            keys, family, least, most = keys[head], family[head], np.minimum.reduceat(least, head), np.maximum.reduceat(most, head)
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else head
        size = np.diff(np.append(begin, len(keys)))
        held: list[np.ndarray] = []
        room, limit = 0, HELD

        def settled() -> np.ndarray:
            rows = np.concatenate(held, 1) if held else np.zeros((7, 0), np.int64)
            if not rows.shape[1]:
                return rows
            rows = rows[:, np.lexsort((rows[1], rows[0]))]
            head = np.flatnonzero(np.concatenate(([True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))))
            return np.stack((rows[0, head], rows[1, head], np.add.reduceat(rows[2], head), *(f.reduceat(rows[k], head) for k, f in ((3, np.minimum), (4, np.maximum), (5, np.minimum), (6, np.maximum)))))

        def rows_of(rows: np.ndarray) -> pa.RecordBatch:
            """Rows of pairs, which have no run, or of chains."""
            return table(_PAIRS, **{"run": pa.nulls(rows.shape[1], pa.int64())} | {x.split()[0]: c for x, c in zip(_PAIRS.split(","), rows)})

        large = size > max(hot, 1)
        for b, s in zip(begin[large], size[large]):
            i, j = hot_chain(least[b : b + s], most[b : b + s], percent)
            run = np.cumsum(np.append(0, i[1:] != j[:-1])[: len(i)]).astype(np.uint64)  # goes on where the last pair ended
            i, j = np.minimum(i, j) + b, np.maximum(i, j) + b
            held.append(np.stack((family[i], family[j], np.zeros(len(i), np.int64), least[i], most[i], least[j], most[j], mix(mix(keys[b : b + 1]) + run).view(np.int64))))
            room += len(i)
            if room > limit:
                yield rows_of(np.concatenate(held, 1))
                held, room = [], 0
        if held:
            yield rows_of(np.concatenate(held, 1))
            held, room = [], 0

        def found() -> Iterator[np.ndarray]:
            """Columns of pairs: of keys with few families by size, all that fit."""
            for s in np.unique(size):
                at = begin[size == s]
                if s < 2 or s > hot:
                    continue
                x, y = np.triu_indices(int(s), 1)
                for lo in range(0, len(at), max(1, (1 << 18) // len(x))):
                    own = at[lo : lo + max(1, (1 << 18) // len(x))]
                    i, j = (own[:, None] + x).ravel(), (own[:, None] + y).ravel()
                    fits = (100 * most[i] >= percent * least[j]) & (100 * most[j] >= percent * least[i])
                    i, j = i[fits], j[fits]
                    yield np.stack((family[i], family[j], np.ones(len(i), np.int64), least[i], most[i], least[j], most[j]))

        for rows in found():
            held.append(rows)
            room += rows.shape[1]
            if room > limit:
                rows = settled()
                held, room = [rows], rows.shape[1]
                if room > limit // 2:  # summing up doesn't help: hand them on
                    yield rows_of(rows)
                    held, room = [], 0
        yield rows_of(settled())

    return run


def _pair_bound(percent: int):
    """Least number of shared keys of two linked sets with these ranges of sizes.

    With sizes x <= y and an order's last key t among the keys of one of them, all shared elements up to t are shared
    keys, and beyond t that set has needed(n) - asked(n) elements at most.  So shared >= overlap - needed(y) + asked(y)
    with overlap >= p / (100 + p) (x + y) and needed(y) <= p y / 100 + 1, which falls in y and grows in x, as asked does;
    and overlap >= needed(y), so it is asked(x) at least.
    """
    p = F.lit(percent / 100)
    x, y = F.least("least_a", "least_b"), F.least(F.greatest("most_a", "most_b"), F.floor(F.least("most_a", "most_b") / p) + 1)
    return F.greatest(F.lit(1), F.ceil(p / (1 + p) * (x + y) - p * y - F.lit(1e-6))) + _asked_of(x, percent) - 1


def _asked_of(n, percent: int):
    """_asked() of a column."""
    return F.least(F.lit(SHARED), F.ceil(n * percent / 100))


def _proposed(shared: DataFrame, percent: int) -> DataFrame:
    """a, b: what of the rows of _pairs puts families into one block.

    The keys of many families that two families share are no more than those that either has.  So a pair of other keys
    stays if it reaches its bound with these, and a pair that shares nothing else is of two families that have as many
    as any pair of theirs needs: those are linked with the name of each of their runs.
    """
    sums = (F.sum("shared").alias("shared"), *(f(c).alias(c) for c, f in (("least_a", F.min), ("most_a", F.max), ("least_b", F.min), ("most_b", F.max))))
    close = shared.where("run is null").groupBy("a", "b").agg(*sums)
    ends = F.explode(F.array(F.struct(F.col("a").alias("family"), F.col("least_a").alias("n")), F.struct(F.col("b").alias("family"), F.col("least_b").alias("n")))).alias("end")
    runs = cut(shared.where("run is not null").select("run", ends).groupBy("end.family", "run").agg(F.min("end.n").alias("n")))
    often = cut(runs.groupBy("family").agg(F.count(F.lit(1)).alias("hot"), F.min("n").alias("n")))
    for end in ("a", "b"):
        close = close.join(often.select(F.col("family").alias(end), F.col("hot").alias(f"hot_{end}")), end, "left")
    hot = F.least(*(F.coalesce(f"hot_{end}", F.lit(0)) for end in ("a", "b")))
    close = close.where(F.col("shared") + hot >= _pair_bound(percent)).select("a", "b")
    able = often.where(F.col("hot") >= _asked_of(F.ceil(F.col("n") * percent / 100), percent)).select("family")
    return close.unionByName(runs.join(able, "family", "left_semi").select(F.col("family").alias("a"), F.col("run").alias("b")))


# --------------------------------------------------------------------------- signature trees


class SignatureTree:
    """Leaves of up to LEAF sets, inner nodes of up to FAN children, all as ranges of one order of the sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.built: tuple | None = None
        self.bits = 1 << int(np.clip(int(4 * self.sizes.max()) - 1, 255, (1 << 16) - 1)).bit_length()

    def build(self, bits: int) -> list:
        """bits: the bitmaps' width, the same for both trees of a traversal.  Returns the root."""
        if self.built and self.built[0] == bits:
            return self.built[1]
        maps = np.zeros((len(self.sets), bits), bool)
        for i, s in enumerate(self.sets):
            maps[i, (s >> np.uint64(24)).astype(np.int64) & (bits - 1)] = True
        maps = np.packbits(maps, axis=1).view(np.uint64)
        excess = self.sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        #: begin, end, bitmap, least size, most size, most excess of elements over bits, children
        level = []
        for b in range(0, len(self.sets), LEAF):
            e = min(b + LEAF, len(self.sets))
            level.append((b, e, np.bitwise_or.reduce(maps[b:e]), int(self.sizes[b:e].min()), int(self.sizes[b:e].max()), int(excess[b:e].max()), ()))
        while len(level) > 1:
            level = [(c[0][0], c[-1][1], np.bitwise_or.reduce([x[2] for x in c]), min(x[3] for x in c), max(x[4] for x in c), max(x[5] for x in c), c) for c in (level[i : i + FAN] for i in range(0, len(level), FAN))]
        self.maps, self.excess = maps, excess
        self.built = (bits, level[0])
        return level[0]


def _may_link(least_x: int, most_x: int, least_y: int, most_y: int, overlap: int, percent: int) -> bool:
    """Whether sets of these ranges of sizes can link if they share overlap elements at most."""
    return 100 * most_x >= percent * least_y and 100 * most_y >= percent * least_x and (100 + percent) * overlap >= percent * (least_x + least_y)


def link_trees(x: SignatureTree, y: SignatureTree, label_x: np.ndarray, label_y: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (place in x's order, place in y's order) that link and whose labels differ; the caller merges labels.

    For x is y, each pair comes once at most.
    """
    bits = max(x.bits, y.bits)
    root_x = x.build(bits)
    root_y = root_x if y is x else y.build(bits)
    stack = [(root_x, root_y)]
    while stack:
        a, b = stack.pop()
        own, other = label_x[a[0] : a[1]], label_y[b[0] : b[1]]
        if (own == own[0]).all() and (other == own[0]).all():
            continue
        if a is not b or y is not x:
            most = int(np.bitwise_count(a[2] & b[2]).sum()) + min(a[5], b[5])
            if not _may_link(a[3], a[4], b[3], b[4], most, percent):
                continue
        if a[6] or b[6]:
            left, right = a[6] or (a,), b[6] or (b,)
            stack += [(c, d) for i, c in enumerate(left) for d in (right[i:] if a is b and y is x else right)]
            continue
        for i in range(a[0], a[1]):
            for j in range(max(b[0], i + 1) if y is x else b[0], b[1]):
                if label_x[i] == label_y[j]:
                    continue
                n, m = int(x.sizes[i]), int(y.sizes[j])
                most = int(np.bitwise_count(x.maps[i] & y.maps[j]).sum()) + min(int(x.excess[i]), int(y.excess[j]))
                if not _may_link(n, n, m, m, most, percent):
                    continue
                both = n + m - len(np.union1d(x.sets[i], y.sets[j]))
                if 100 * both >= percent * (n + m - both):
                    yield i, j


def _self_links(nodes: list[int], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join the components of one part."""
    tree = SignatureTree(sets)
    label = np.arange(len(sets))
    for i, j in link_trees(tree, tree, label, label, percent):
        label[label == label[j]] = label[i]
        yield nodes[tree.order[i]], nodes[tree.order[j]]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of consecutive rows with equal first columns."""
    last, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != last:
                if held:
                    yield last, held
                last, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield last, held


def _first_round(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in _groups(batches, 3):
            own = list(dict.fromkeys(rows))  # a pivot visits its own part too
            if len(own) > 1:
                for x, y in _self_links([x for x, _ in own], [np.frombuffer(s, np.uint64) for _, s in own], percent):
                    a.append(x)
                    b.append(y)
            if len(a) > 10_000:
                yield table("a long,b long", a=a, b=b)
                a, b = [], []
        yield table("a long,b long", a=a, b=b)

    return run


def _second_round(percent: int, guests_at_once: int = 256):
    """Rows (block, sort, part, visitor, node, set, label), a part's own documents first: visitors against those.

    Visitors stream by in small groups, so a part holds no more than its own documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, tree, label = None, [], None, None
        guests: list = []
        a: list[int] = []
        b: list[int] = []

        def meet() -> None:
            nonlocal tree, label
            if guests and own:
                if tree is None:
                    tree = SignatureTree([s for _, s, _ in own])
                    label = np.array([own[i][2] for i in tree.order], np.int64)
                x = SignatureTree([s for _, s, _ in guests])
                label_x = np.array([guests[i][2] for i in x.order], np.int64)
                for i, j in link_trees(x, tree, label_x, label, percent):
                    a.append(guests[x.order[i]][0])
                    b.append(own[tree.order[j]][0])
                    old, new = label_x[i], label[j]
                    label_x[label_x == old] = new
                    label[label == old] = new
            guests.clear()

        for batch in batches:
            for block, sort, place, visitor, node, elements, mark in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, sort, place) != part:
                    meet()
                    part, own, tree = (block, sort, place), [], None
                row = (node, np.frombuffer(elements, np.uint64), mark)
                if not visitor:
                    own.append(row)
                    continue
                guests.append(row)
                if len(guests) >= guests_at_once or sum(len(s) for _, s, _ in guests[-1:]) > 1 << 19:
                    meet()
            yield table("a long,b long", a=a, b=b)
            a.clear()
            b.clear()
        meet()
        yield table("a long,b long", a=a, b=b)

    return run


# --------------------------------------------------------------------------- all pairs


def near_leaves(x: SignatureTree, y: SignatureTree, percent: int) -> Iterator[tuple[slice, slice]]:
    """Leaves (ranges of x's and y's order) whose sizes and overlap let a pair link, whatever is linked already.

    For x is y, each pair of leaves comes once.
    """
    bits = max(x.bits, y.bits)
    root_x = x.build(bits)
    stack = [(root_x, root_x if y is x else y.build(bits))]
    while stack:
        a, b = stack.pop()
        if a is not b:
            most = int(np.bitwise_count(a[2] & b[2]).sum()) + min(a[5], b[5])
            if not _may_link(a[3], a[4], b[3], b[4], most, percent):
                continue
        if a[6] or b[6]:
            left, right = a[6] or (a,), b[6] or (b,)
            stack += [(c, d) for i, c in enumerate(left) for d in (right[i:] if a is b else right)]
            continue
        yield slice(a[0], a[1]), slice(b[0], b[1])


def overlaps(x: list[np.ndarray], y: list[np.ndarray], at_once: int = 1 << 21) -> np.ndarray:
    """Number of shared elements of each set of x with each of y.

    Elements of many sets are multiplied as columns of two matrices, those of few are counted pair by pair.
    """
    nx, ny = len(x), len(y)
    flat = np.concatenate([*x, *y])
    owner = np.concatenate((np.repeat(np.arange(nx), [len(s) for s in x]), np.repeat(np.arange(ny), [len(s) for s in y])))
    first = sum(len(s) for s in x)
    keys, at = np.unique(flat, return_inverse=True)
    in_x, in_y = np.bincount(at[:first], minlength=len(keys)), np.bincount(at[first:], minlength=len(keys))
    amount = in_x * in_y
    out = np.zeros((nx, ny), np.int64)

    dense = amount * 64 > nx * ny
    column = np.cumsum(dense) - 1
    sides = []
    for part in (slice(0, first), slice(first, None)):
        own = dense[at[part]]
        col, row = column[at[part][own]], owner[part][own]
        order = np.argsort(col, kind="stable")
        sides.append((col[order], row[order]))
    step = max(64, at_once // (nx + ny))
    for lo in range(0, int(dense.sum()), step):
        maps = []
        for n, (col, row) in zip((nx, ny), sides):
            b, e = np.searchsorted(col, (lo, lo + step))
            one = np.zeros((n, step), np.float32)
            one[row[b:e], col[b:e] - lo] = 1
            maps.append(one)
        out += (maps[0] @ maps[1].T).astype(np.int64)

    sparse = np.flatnonzero((amount > 0) & ~dense)
    if len(sparse):
        order_x, order_y = np.argsort(at[:first], kind="stable"), np.argsort(at[first:], kind="stable")
        owner_x, owner_y = owner[:first][order_x], owner[first:][order_y]
        begin_x, begin_y = np.cumsum(in_x) - in_x, np.cumsum(in_y) - in_y
        share = np.cumsum(amount[sparse]) // at_once
        for k in np.split(sparse, np.flatnonzero(np.diff(share)) + 1):
            n = amount[k]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(in_y[k], n)
            i = owner_x[np.repeat(begin_x[k], n) + place // wide]
            j = owner_y[np.repeat(begin_y[k], n) + place % wide]
            out += np.bincount(i * ny + j, minlength=nx * ny).reshape(nx, ny)
    return out


def tile_links(x: list[np.ndarray], y: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links of x's sets with y's (None: among themselves, each pair once): place in x, place in y, shared elements."""
    alone = y is None
    y = x if alone else y
    own, other = np.arange(len(x)), np.arange(len(y))
    if max(len(x), len(y)) > LEAF:
        tree_x = SignatureTree(x)
        tree_y = tree_x if alone else SignatureTree(y)
        keep_x, keep_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for a, b in near_leaves(tree_x, tree_y, percent):
            keep_x[tree_x.order[a]] = True
            keep_y[tree_y.order[b]] = True
        own, other = np.flatnonzero(keep_x), np.flatnonzero(keep_y)
        if alone:
            own = other = np.flatnonzero(keep_x | keep_y)
    if not len(own) or not len(other):
        return own[:0], other[:0], own[:0]
    both = overlaps([x[i] for i in own], [y[j] for j in other])
    n, m = np.array([len(x[i]) for i in own]), np.array([len(y[j]) for j in other])
    linked = 100 * both >= percent * (n[:, None] + m[None, :] - both)
    if alone:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    return own[i], other[j], both[i, j]


_SETTLED = "a long,b long,node long,mark long,links long"
_LINKED = "a long,b long,n_a long,n_b long,shared long"


def _tiles(percent: int, listed: bool):
    """Rows (block, sort, part, sort, part, visitor, node, mark, weight, set) of tiles: every pair is settled.

    Gives the pairs themselves if listed, else each class's number of linked documents and links that join components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 5):
            sides = [[], []]
            for row in dict.fromkeys(rows):
                sides[row[0]].append(row[1:])
            own, other = sides
            alone = not other
            if not own or (alone and len(own) < 2):
                continue
            sets = [[np.frombuffer(r[3], np.uint64) for r in side] for side in sides]
            i, j, shared = tile_links(sets[0], None if alone else sets[1], percent)
            if not len(i):
                continue
            other = own if alone else other
            nodes = [np.array([r[0] for r in side], np.int64) for side in (own, other)]
            if listed:
                size = [np.array([len(s) for s in side], np.int64) for side in (sets[0], sets[0] if alone else sets[1])]
                for b in range(0, len(i), 100_000):
                    p, q = i[b : b + 100_000], j[b : b + 100_000]
                    yield table(_LINKED, a=nodes[0][p], b=nodes[1][q], n_a=size[0][p], n_b=size[1][q], shared=shared[b : b + 100_000])
                continue
            weights = [np.array([r[2] for r in side], np.int64) for side in (own, other)]
            totals = [np.bincount(i, weights[1][j], len(own)), np.bincount(j, weights[0][i], len(other))]
            if alone:
                totals = [totals[0] + totals[1]]
            forest = Forest()
            for a, b in set(_spanning(i, j, len(own), 0 if alone else len(own))):
                every = (nodes[0], nodes[0] if alone else nodes[1])
                forest.union(int(every[0][a]) if a < len(own) else int(every[1][a - len(own)]), int(every[0][b]) if b < len(own) else int(every[1][b - len(own)]))
            ends = list(forest.up)
            yield table(_SETTLED, a=ends, b=[forest.find(x) for x in ends], node=pa.nulls(len(ends), pa.int64()), mark=pa.nulls(len(ends), pa.int64()), links=pa.nulls(len(ends), pa.int64()))
            for side, total in zip((own, other), totals):
                some = np.flatnonzero(total)
                none = pa.nulls(len(some), pa.int64())
                yield table(_SETTLED, a=none, b=none, node=[side[k][0] for k in some], mark=[side[k][1] for k in some], links=total[some].astype(np.int64))

    return run


def _spanning(i: np.ndarray, j: np.ndarray, n: int, shift: int) -> Iterator[tuple[int, int]]:
    """Few of the pairs (i, j + shift) that join the same components: each place with the least one of its component."""
    j = j + shift
    size = max(n, int(j.max()) + 1)
    label = np.arange(size)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    for k in np.flatnonzero(label != np.arange(size)).tolist():
        yield k, int(label[k])


# --------------------------------------------------------------------------- the join


def _wanted(nodes: DataFrame) -> bytes:
    """A filter of fixed size (2 MB) that passes all these nodes and, while they are few, little else."""
    size = 1 << 16

    def bits(group: pa.Table) -> pa.Table:
        own = np.zeros(size, bool)
        for blob in group.column("at").to_pylist():
            own |= np.unpackbits(np.frombuffer(blob, np.uint8)).astype(bool)
        return pa.Table.from_batches([table("part int,at binary", part=[group.column("part")[0].as_py()], at=[np.packbits(own).tobytes()])])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(_FILTER_BITS, bool)
        for batch in batches:
            own[batch.column(0).to_numpy()] = True
        parts = own.reshape(-1, size)
        used = np.flatnonzero(parts.any(1))
        yield table("part int,at binary", part=used, at=[np.packbits(parts[i]).tobytes() for i in used])

    at = nodes.select(F.pmod(F.xxhash64("node"), F.lit(_FILTER_BITS)).alias("at"))
    out = np.zeros((_FILTER_BITS // size, size // 8), np.uint8)
    for part, blob in at.coalesce(16).mapInArrow(local, "part int, at binary").groupBy("part").applyInArrow(bits, "part int, at binary").collect():
        out[part] = np.frombuffer(blob, np.uint8)
    return out.tobytes()


def join(docs: DataFrame, width: int = 5, percent: int = 80, block_rows: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with the same set; null for empty sets)."""
    with scratch(docs.sparkSession) as keep:
        return _join(docs, width, percent, block_rows, id_col, text_col, keep)


def links(docs: DataFrame, width: int = 5, percent: int = 80, block_rows: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of join() and n_links: the number of other rows with a doc_id whose set links with this row's, exact
    copies included (null without doc_id)."""
    with scratch(docs.sparkSession) as keep:
        return _join(docs, width, percent, block_rows, id_col, text_col, keep, "counts")


def pairs(docs: DataFrame, width: int = 5, percent: int = 80, block_rows: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, n_a, n_b, shared: every linked pair of different sets, each set by its class_id (a < b), with the sizes.

    A doc_id whose rows hold different sets may name several of them.
    """
    with scratch(docs.sparkSession) as keep:
        return _join(docs, width, percent, block_rows, id_col, text_col, keep, "pairs")


def _join(docs: DataFrame, width: int, percent: int, block_rows: int, id_col: str, text_col: str, keep, every: str = "") -> DataFrame:
    spark = docs.sparkSession
    texts = need(docs, **{id_col: "long", text_col: "string"}).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = fanout(texts)
    profile = keep(cut(texts.mapInArrow(tidy(_profile(width)), _PROFILE.replace(",", ", "))))
    rows = profile.where("part is null").select("doc_id", "n", "mark1", "mark2", "bands")
    sketch = profile.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(tidy(_add_counts), "part int, counts binary").collect()
    total = np.zeros((_BLOCKS, _CELLS // _BLOCKS), np.uint8)  # of fixed size: thirds of an octave
    for part, blob in sketch:
        total[part] = np.minimum(3 * np.log2(np.maximum(unpack(blob, np.uint32), 1)), 63)
    counts = spark.sparkContext.broadcast(total.tobytes())

    classes = cut(rows.where("n > 0 and doc_id is not null").groupBy("mark1", "mark2", "n").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("weight")))
    nodes = classes.where(F.col("n") >= _least(percent)).select("node", "mark1", "n", "bands", "weight")

    postings = cut(nodes.select("node", "bands").mapInArrow(tidy(lambda batches: _band_postings(batches, parts)), "bucket int, keys binary, nodes binary"))
    across = postings.where("bucket >= 0").groupBy("bucket").applyInArrow(tidy(_band_links), "a long, b long")
    links = cut(across.unionByName(postings.where("bucket < 0").select("keys", "nodes").mapInArrow(_plain_links, "a long, b long")))
    families = components(links)
    members = cut(nodes.drop("bands", "weight").join(families, "node", "left").select("node", "mark1", "n", F.coalesce("component", "node").alias("family")))

    prefixes = texts.where("doc_id is not null").mapInArrow(tidy(_prefixes(counts, width, percent)), "doc_id long, mark1 long, n long, keys binary")
    keyed = prefixes.drop("n").join(members, (prefixes["doc_id"] == members["node"]) & (prefixes["mark1"] == members["mark1"])).select("family", "n", "keys")
    shared = keyed.mapInArrow(tidy(_postings(parts)), _POSTINGS.replace(",", ", ")).groupBy("bucket").applyInArrow(tidy(_pairs(percent, HOT)), _PAIRS.replace(",", ", "))
    blocks = components(cut(links.unionByName(_proposed(cut(shared), percent))))  # a family's name is a node

    plan = cut(nodes.select("node", "mark1", "n", "weight").join(blocks, "node").select("node", "mark1", "n", "weight", F.col("component").alias("block")))
    room = F.greatest(F.lit(block_rows), F.least(F.lit(4096), F.ceil(F.col("rows") / (4 * parts))))
    if every:  # tiles: as many as tasks, and each fits into one
        room = F.greatest(F.lit(block_rows), F.least(F.lit(1024), F.ceil(F.col("rows") / F.lit((2 * parts) ** 0.5))))
    deal = F.greatest(F.ceil(F.col("rows") / room), F.ceil(F.col("elements") / ((2000 if every else 8000) * room))).cast("int")
    amount = (F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements"))
    sizes = cut(plan.groupBy("block").agg(*amount).select("block", (deal > 1).alias("large")))
    # a large block is dealt by size first: sets that link are in one class of sizes or in neighbouring ones
    step = np.log(max(100 / percent, 1.01) * (1 + 1e-6))
    plan = cut(plan.join(sizes, "block").withColumn("sort", F.when(F.col("large"), F.floor(F.log("n") / F.lit(float(step)))).otherwise(F.lit(0)).cast("int")))
    shares = cut(plan.groupBy("block", "large", "sort").agg(*amount).select("block", "large", "sort", F.when(F.col("large"), deal).otherwise(F.lit(1)).alias("deal")))
    places = shares.where("large").select(F.col("block").alias("in_block"), F.col("sort").alias("in_sort"), F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("in_part"))
    wanted = spark.sparkContext.broadcast(_wanted(plan))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((passes[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            for lo, hi, flat, to in _sets(batch.column(1), width):
                some = np.flatnonzero(np.diff(to) >= _least(percent))
                yield table("doc_id long,mark1 long,elements binary", doc_id=batch.column(0)[lo:hi].take(pa.array(some)), mark1=_marks(flat, to)[0][some], elements=[flat[to[i] : to[i + 1]].tobytes() for i in some])

    sets = texts.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER_BITS)).alias("at")).mapInArrow(tidy(extract), "doc_id long, mark1 long, elements binary")
    if every:
        found = _settled(plan, shares, sets, percent, parts, every == "pairs")
        if every == "pairs":
            swapped = F.col("a") > F.col("b")
            n_a, n_b = (F.when(swapped, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("n_b", "n_a"), ("n_a", "n_b")))
            return keep(cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), n_a, n_b, "shared")))
        found = cut(found)
        counted = found.where("node is not null").groupBy("node", "mark").agg(F.sum("links").alias("links"))
        classes = classes.join(counted.withColumnsRenamed({"node": "of", "mark": "by"}), (F.col("node") == F.col("of")) & (F.col("mark1") == F.col("by")), "left")
        classes = cut(classes.withColumn("n_links", F.col("weight") - 1 + F.coalesce("links", F.lit(0))).drop("of", "by", "links"))
        found = found.where("a is not null").select("a", "b")
    else:
        found = _linking(plan, shares, sizes, places, sets, percent, parts)
    owned = _repeated(rows, classes)
    if owned is not None:
        least = owned.groupBy("doc").agg(F.min("of").alias("b"))
        found = found.unionByName(owned.join(least, "doc").where("of <> b").select(F.col("of").alias("a"), "b"))
    linked = components(found)

    named = keep(cut(classes.drop("bands", "weight").join(linked, "node", "left").select("mark1", "mark2", F.col("n").alias("m"), F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component"), *(["n_links"] if every else []))))
    same = (rows["mark1"] == named["mark1"]) & (rows["mark2"] == named["mark2"]) & (rows["n"] == named["m"])
    more = [F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")] if every else []
    out, component = rows.join(named, same, "left"), F.coalesce("component", "doc_id")
    if owned is not None:  # rows with an empty set have the component of the others with their doc_id
        theirs = owned.join(linked, F.col("of") == F.col("node"), "left").groupBy("doc").agg(F.min(F.coalesce("component", "of")).alias("theirs"))
        theirs = keep(cut(theirs))
        out, component = out.join(theirs, out["doc_id"] == theirs["doc"], "left"), F.coalesce("theirs", component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), *more)


def _repeated(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """doc, of: the classes (by their nodes) of each doc_id that several rows have; None if no doc_id repeats."""
    again = cut(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("doc_id").alias("again")))
    if again.isEmpty():
        return None
    several = rows.where("n > 0").join(again, F.col("doc_id") == F.col("again"), "left_semi").select(F.col("doc_id").alias("doc"), "mark1", "mark2", "n").distinct()
    return cut(several.join(classes.select("mark1", "mark2", "n", F.col("node").alias("of")), ["mark1", "mark2", "n"]).select("doc", "of"))


def _linking(plan: DataFrame, shares: DataFrame, sizes: DataFrame, places: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links (a, b) that join the components of every block."""
    dealt = plan.join(shares, ["block", "large", "sort"]).select("node", F.col("mark1").alias("mark"), "block", "large", "sort", "deal")
    full = sets.join(dealt, (sets["doc_id"] == dealt["node"]) & (sets["mark1"] == dealt["mark"])).select("block", "large", "sort", F.pmod(F.xxhash64("node", F.lit(1)), F.col("deal")).cast("int").alias("part"), "node", "elements")
    full = cut(full)
    pivots = full.where("large").groupBy("block", F.pmod(F.xxhash64("node"), F.lit(8)).alias("slot")).agg(F.min(F.struct(F.xxhash64("node", F.lit(2)).alias("by"), "node")).alias("p"))
    pivots = cut(pivots.select(F.col("block").alias("of"), F.col("p.node").alias("pivot")))
    visiting = full.where("large").join(pivots, (F.col("block") == F.col("of")) & (F.col("node") == F.col("pivot")), "left_semi").select("block", "node", "elements")
    visiting = visiting.join(places, visiting["block"] == places["in_block"]).select("block", F.col("in_sort").alias("sort"), F.col("in_part").alias("part"), "node", "elements")
    first = full.select("block", "sort", "part", "node", "elements").unionByName(visiting).repartition(parts, "block", "sort", "part").sortWithinPartitions("block", "sort", "part")
    found = cut(first.mapInArrow(tidy(_first_round(percent)), "a long, b long"))

    if not sizes.where("large").isEmpty():
        label = components(found)
        large = full.where("large")
        held = cut(large.select("block", "node").join(label, "node", "left").select("block", "node", F.coalesce("component", "node").alias("label")))
        most = held.groupBy("block", "label").agg(F.count(F.lit(1)).alias("rows")).groupBy("block").agg(F.max(F.struct("rows", "label")).alias("top"))
        held = held.join(most.select("block", F.col("top.label").alias("top")), "block").select("node", "label", (F.col("label") != F.col("top")).alias("outside"))
        marked = cut(large.join(cut(held), "node").select("block", "sort", "part", "outside", "node", "elements", "label"))
        outside = marked.where("outside")
        near = (outside["block"] == places["in_block"]) & (F.abs(outside["sort"] - places["in_sort"]) <= 1) & ((outside["sort"] != places["in_sort"]) | (outside["part"] != places["in_part"]))
        guests = outside.join(places, near).select("block", F.col("in_sort").alias("sort"), F.col("in_part").alias("part"), F.lit(True).alias("visitor"), "node", "elements", "label")
        second = marked.select("block", "sort", "part", F.lit(False).alias("visitor"), "node", "elements", "label").unionByName(guests)
        second = second.repartition(parts, "block", "sort", "part").sortWithinPartitions("block", "sort", "part", "visitor")
        found = cut(found.unionByName(second.mapInArrow(tidy(_second_round(percent)), "a long, b long")))
    return found


def _settled(plan: DataFrame, shares: DataFrame, sets: DataFrame, percent: int, parts: int, listed: bool) -> DataFrame:
    """What _tiles() gives for all pairs of every block; a set goes to each tile of its part."""
    places = shares.select(F.col("block").alias("in_block"), F.col("sort").alias("in_sort"), F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("in_part"))
    near = shares.join(places, (F.col("block") == F.col("in_block")) & (F.abs(F.col("sort") - F.col("in_sort")) <= 1))
    near = near.groupBy("block", "sort", "deal").agg(F.collect_list(F.struct("in_sort", "in_part")).alias("near"))
    dealt = plan.join(near, ["block", "sort"]).select("node", F.col("mark1").alias("mark"), "weight", "block", "sort", F.pmod(F.xxhash64("node", F.lit(1)), F.col("deal")).cast("int").alias("part"), "near")
    full = sets.join(dealt, (sets["doc_id"] == dealt["node"]) & (sets["mark1"] == dealt["mark"])).select("block", "sort", "part", "node", "mark", "weight", "elements", F.explode("near").alias("to"))
    own, other = F.struct("sort", "part"), F.struct(F.col("to.in_sort").alias("sort"), F.col("to.in_part").alias("part"))
    tile = ["block", "sort1", "part1", "sort2", "part2"]
    rows = full.withColumns({"lo": F.least(own, other), "hi": F.greatest(own, other), "visitor": (own > other).cast("int")})
    rows = rows.select("block", F.col("lo.sort").alias("sort1"), F.col("lo.part").alias("part1"), F.col("hi.sort").alias("sort2"), F.col("hi.part").alias("part2"), "visitor", "node", "mark", "weight", "elements")
    rows = rows.repartition(parts, *tile).sortWithinPartitions(*tile)
    return rows.mapInArrow(tidy(_tiles(percent, listed)), (_LINKED if listed else _SETTLED).replace(",", ", "))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id names their component (one document of each group), all columns as they are.

    Of rows that repeat a doc_id the one whose text has the smallest hash stays; rows without doc_id all stay.  Null,
    empty and word-less texts link with nothing, so each such doc_id stays; long texts are compared whole; ties of hashes
    keep one row; columns may have any names; an empty table stays empty.
    """
    text, of, least = free(docs, "_text", "_of", "_least")
    rows = docs.where("doc_id is not null").withColumn(text, F.xxhash64("text"))
    first = rows.groupBy("doc_id").agg(F.min(text).alias(least))
    with scratch(docs.sparkSession) as keep:
        kept = join(docs, width, percent).where("doc_id = component_id").select("doc_id").distinct()
        kept = keep(cut(kept.join(first, "doc_id").select(F.col("doc_id").alias(of), least)))
    same = (rows["doc_id"] == kept[of]) & (rows[text] == kept[least])
    once = rows.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", text]).drop(text)
    return once.unionByName(docs.where("doc_id is null"))
