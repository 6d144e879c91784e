"""N-gram Jaccard join: documents whose shingle sets overlap by a share of their union, and the groups they form.

Method: a prefix-tree join. Shingles have one global order (their hash); every set is a sorted sequence. The sets of a
block go into a trie; each set walks it once, so that sets with a common beginning share the count of their overlap, and
a subtree is cut when the tokens that remain on either side can't bring the overlap to what the sizes ask for.

Blocks, so that no task needs all sets: two sets that link differ in at most d tokens (d from the larger size). The
hash space is cut into more than d ranges, so at least one range holds the same tokens in both. A set's key for
a range is a hash of its tokens there; sets with a common key are candidates, and connected candidates are a block. A key
needs a whole range to agree. Tokens that occur in many sets (by a sketch of counters over all documents) are left out of
keys, which adds no difference, so a passage that many documents share puts none of them together unless the rest agrees.
A range with a single token makes a key only together with another such range: one shingle that documents share by chance
would else connect them, and with more documents nearly all would be one block.
Very small sets use the hashes of the set less up to two tokens instead. Both ways are exact: no link is lost.

Equal sets are one class from the start. Keys are combined before the shuffle (of each map batch, a key goes on with one
set; the others link to it), so a key that a third of the sets have is one row a batch. Blocks above MAX_TOKENS are cut
into parts whose pairs are joined apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.graph import connected_components
from tessella.llm.textarrays import add_in_tree, bounded, give_back, mix, released, shingle_sets, small_batches
from tessella.plans.shared import materialize

#: Tokens of a block that one task joins at once.
MAX_TOKENS = 4_000_000
#: Keys that a task combines before it passes them on.
HELD_KEYS = 500_000
#: Different sets that a task remembers, so that of equal ones only the first posts its keys.
SEEN_SETS = 100_000
#: Postings (6 bytes and a share of an id each) of a bucket.
BUCKET_POSTINGS = 1_500_000
#: Rows up to which the members of blocks are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A sketch of counters counts in how many sets the tokens occur: one for each SKETCH_SHARE bytes of input, 2**18 to 2**24 (64 MB a task).
#: Its size sets what is cheap, never what is found.
SKETCH_SHARE, SKETCH_LEAST, SKETCH_MOST = 96, 18, 24
#: The sketch is added up in slices of 2**SLICE_BITS counters.
SLICE_BITS = 16
#: Up to this many differing tokens, sets less some tokens are the keys.
FEW = 2

#: From texts to the sorted sets of 64-bit tokens that are compared.
Sets = Callable[[pa.Array], Iterator[np.ndarray]]


# ---- keys ------------------------------------------------------------------------------------------------------------


def spread(a: int, b: int, pct: int) -> int:
    """The most tokens in one of two linked sets of these sizes but not in both: union - intersection."""
    return (100 - pct) * (a + b) // (100 + pct)


def size_ranges(n: int, pct: int) -> tuple[int, int, int]:
    """(range of the size n, its largest size, largest of the next): linked sizes lie in one range or in neighbours."""
    level, low = 0, 1
    while True:
        high = low * 100 // pct
        if n <= high:
            return level, high, (high + 1) * 100 // pct
        level, low = level + 1, high + 1


def range_keys(tokens: np.ndarray, mixed: np.ndarray, m: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the m ranges of the hash space, number of tokens in each)."""
    part = ((tokens >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(part, np.arange(m + 1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ mix(np.arange(1, m + 1, dtype=np.uint64) + salt)), np.diff(bounds)


def pair_keys(keys: np.ndarray, ranges: np.ndarray, groups: int) -> np.ndarray:
    """Keys of the pairs of these ranges whose numbers leave the same remainder by `groups`."""
    if len(ranges) < 2:
        return np.zeros(0, np.uint64)
    group = ranges % groups
    order = np.argsort(group, kind="stable")
    group, key = group[order], keys[ranges[order]]
    first: list[np.ndarray] = []
    second: list[np.ndarray] = []
    for k in range(1, len(key)):
        same = np.flatnonzero(group[k:] == group[:-k])
        if not len(same):
            break
        first.append(same)
        second.append(same + k)
    return mix(key[np.concatenate(first)] + mix(key)[np.concatenate(second)]) if first else np.zeros(0, np.uint64)


def keys_of(tokens: np.ndarray, pct: int, ranges: dict, hot: np.ndarray | None = None) -> np.ndarray:
    """Keys of a sorted set: two different linked sets have one in common at least.

    Tokens for which hot[top bits] is set don't count at first: leaving tokens out of both sets adds no difference. Of
    d + 1 + empty ranges, 1 + empty agree at least, and 1 + empty - gaps that aren't empty, if one of the sets has `gaps` empty ranges.
    One of these has several tokens and is a key, or all have a single one: then two of more than `groups` are in the same group,
    and their pair is a key. Where both sets have too many gaps for that, single tokens are keys too, and
    where both may agree in empty ranges only, so are the ranges of all their tokens.
    """
    n = len(tokens)
    if n not in ranges:
        ranges[n] = size_ranges(n, pct)
    level, high, higher = ranges[n]
    mixed = mix(tokens)
    cool = ~hot[(tokens >> np.uint64(65 - len(hot).bit_length())).astype(np.int64)] if hot is not None else np.ones(n, bool)
    out = []
    for at, most in ((level, high), (level + 1, higher)):
        d = spread(most, most, pct)
        salt = mix(np.array([at + 1], np.uint64))
        if d == 0:
            continue
        if d <= FEW:
            whole = np.add.reduce(mixed)
            less = [np.array([whole]), whole - mixed]
            if d == 2 and n > 1:
                i, j = np.triu_indices(n, 1)
                less.append(whole - mixed[i] - mixed[j])
            out.append(mix(np.concatenate(less) ^ salt))
            continue
        empty, groups = max(4, 2 + d // 6), max(1, d // 12)
        key, held = range_keys(tokens[cool], mixed[cool], d + 1 + empty, salt)
        gaps = int((held == 0).sum())
        out += [key[held > (gaps <= empty - groups)], pair_keys(key, np.flatnonzero(held == 1), groups)]
        if gaps > empty:
            key, held = range_keys(tokens, mixed, d + 1 + empty, mix(salt))
            out.append(key[held > 0] if (held == 0).sum() <= empty else key)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    h = blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def star(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, smallest id of each; the other ids of each key, that key's smallest)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    least = ids[first][np.cumsum(first) - 1] if len(keys) else ids
    other = least != ids
    return keys[first], ids[first], ids[other], least[other]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array, the distinct values and how often each occurs."""
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.concatenate((first, [len(values)]))).astype(np.int32)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct rows of (a, b)."""
    if not len(a):
        return np.zeros((0, 2), np.int64)
    order = np.lexsort((b, a))
    p = np.stack((a[order], b[order]), 1)
    return p[np.concatenate(([True], (p[1:] != p[:-1]).any(1)))]


# ---- tasks -----------------------------------------------------------------------------------------------------------


@released()
def describe(batches: Iterator[pa.RecordBatch], sets_of: Sets, bits: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, d1, d2, at, slice, counters), and at the end one row for each slice of the task's counters."""
    from pyspark import TaskContext

    counts = np.zeros(1 << bits, np.uint32)

    def rows(ids: pa.Array, sizes: list, d1: list, d2: list, at: list, slices: list, counters: list) -> pa.RecordBatch:
        whole = [pa.array(x, pa.int64()) for x in (sizes, d1, d2, at, slices)]
        return pa.RecordBatch.from_arrays([ids, *whole, pa.array(counters, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "at", "slice", "counters"])

    for batch in small_batches(batches, "text"):
        sets = list(sets_of(batch.column("text")))
        both = [digest(s) for s in sets]
        if some := [s for s in sets if len(s)]:
            np.add.at(counts, (np.concatenate(some) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        none = [None] * len(sets)
        yield rows(batch.column("doc_id"), [len(s) for s in sets], [x for x, _ in both], [y for _, y in both], none, none, none)
    if counts.any():
        pieces, none = counts.reshape(-1, 1 << min(bits, SLICE_BITS)), [None]
        for i, x in enumerate(pieces):
            yield rows(pa.nulls(1, pa.int64()), none, none, none, [TaskContext.get().partitionId()], [i], [packed_counters(x)])


def packed_counters(counts: np.ndarray) -> bytes:
    """Counters of 32 bits, compressed byte by byte: most are small, so the upper bytes are almost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T).tobytes())


def add_counters(parts: pa.ChunkedArray) -> np.ndarray:
    """The sum of the counters of one slice, as 64-bit numbers."""
    total, unpack = 0, zstandard.ZstdDecompressor()
    for x in parts:
        planes = np.frombuffer(unpack.decompress(x.as_buffer()), np.uint8).reshape(4, -1)
        total = total + np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.uint64)
    return total


def sketch_bits(docs: DataFrame) -> int:
    """Of the sketch for docs, by the optimizer's estimate of their size (unknown: as for 100 MB)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 100_000_000
    return min(SKETCH_MOST, max(SKETCH_LEAST, math.ceil(math.log2(max(1, size) / SKETCH_SHARE))))


def hot_tokens(parts: DataFrame, bits: int) -> bytes:
    """Which counters of parts(at, slice, counters) stand out, far above their slice's median, as packed bits; a bit a counter comes to the driver, whatever the input.

    Counters of 32 bits that would overflow stay at their most.
    """

    def add(t: pa.Table) -> pa.Table:
        total = np.minimum(add_counters(t.column("counters")), np.uint64((1 << 32) - 1)).astype(np.uint32)
        return pa.table({"counters": pa.array([packed_counters(total)], pa.binary())})

    def stand_out(key: tuple, t: pa.Table) -> pa.Table:
        total = add_counters(t.column("counters")).astype(float)
        middle = float(np.median(total))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "hot": pa.array([np.packbits(total > middle + 6 * middle**0.5 + 8).tobytes()], pa.binary())})

    sums = add_in_tree(parts, add, "counters binary", "slice")
    found = sums.groupBy("slice").applyInArrow(stand_out, "slice long, hot binary").collect()
    return b"".join(bytes(r["hot"]) for r in sorted(found, key=lambda r: r["slice"])) or bytes((1 << bits) // 8)


@released()
def post(batches: Iterator[pa.RecordBatch], sets_of: Sets, pct: int, buckets: int, hot: bytes) -> Iterator[pa.RecordBatch]:
    """(text) to (bucket, ids, number of keys of each, keys, links) of the different sets, with one id for each key of a batch."""
    ranges: dict = {}
    seen: set[int] = set()
    above = np.unpackbits(np.frombuffer(hot, np.uint8)).view(bool)

    def packed(keys: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        held = np.concatenate(keys)
        key, least, other, to = star(held, np.repeat(np.array(ids, np.int64), [len(x) for x in keys]))
        links = distinct_pairs(other, to)
        # The bucket is taken from mixed bits; in a bucket, 48 bits tell keys apart (a chance match is only one more candidate).
        where = (mix(key) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((least, where))
        key, least, where = key[order], least[order], where[order]
        spot = links[:, 0] % buckets
        order = np.argsort(spot, kind="stable")
        links, spot = links[order], spot[order]
        there = np.union1d(where, spot)
        rows = []
        for b in there.tolist():
            own, also = slice(*np.searchsorted(where, (b, b + 1))), links[slice(*np.searchsorted(spot, (b, b + 1)))]
            who, counts = runs(least[own])
            rows.append((b, who.tobytes(), counts.tobytes(), key[own].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), also.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))], ["bucket", "ids", "counts", "keys", "links"])

    keys: list[np.ndarray] = []
    ids: list[int] = []
    held = 0
    for batch in small_batches(batches, "text"):
        for s in sets_of(batch.column("text")):
            if not len(s):
                continue
            who = digest(s)[0]
            if who in seen:
                continue
            if len(seen) >= SEEN_SETS:
                seen.clear()
            seen.add(who)
            own = keys_of(s, pct, ranges, above)
            if len(own):
                keys.append(own)
                ids.append(who)
                held += len(own)
            if held >= HELD_KEYS:
                yield packed(keys, ids)
                keys, ids, held = [], [], 0
    if keys:
        yield packed(keys, ids)


def meet(table: pa.Table) -> pa.Table:
    """Of a bucket: the distinct links (a, b) between sets with a key in common."""
    joined = {c: b"".join(x for x in table.column(c).to_pylist() if x) for c in ("ids", "counts", "keys", "links")}
    ids = np.repeat(np.frombuffer(joined["ids"], np.int64), np.frombuffer(joined["counts"], np.int32))
    keys = np.zeros((len(ids), 8), np.uint8)
    keys[:, :6] = np.frombuffer(joined["keys"], np.uint8).reshape(-1, 6)
    old = np.frombuffer(joined["links"], np.int64).reshape(-1, 2)
    _, _, other, to = star(keys.view(np.int64).ravel(), ids)
    pairs = distinct_pairs(np.concatenate((other, old[:, 0])), np.concatenate((to, old[:, 1])))
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


@released()
def collect_sets(batches: Iterator[pa.RecordBatch], sets_of: Sets) -> Iterator[pa.RecordBatch]:
    """(bin, block, part, doc_id, text) with the text's set in its place."""
    for batch in small_batches(batches, "text"):
        sets = [s.astype(">u8").tobytes() for s in sets_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(sets, pa.binary())], ["bin", "block", "part", "doc_id", "tokens"])


class Trie:
    """Sorted sets as a compressed prefix tree: a node holds the tokens that all sets below it have next."""

    __slots__ = ("sets", "tokens", "start", "end", "children", "first", "last", "least", "most", "member", "same")

    def __init__(self, sets: list[np.ndarray]) -> None:
        """sets: distinct, in lexicographic order."""
        self.sets = sets
        self.start, self.end, self.children, self.first, self.last, self.least, self.most, self.member, self.same, self.tokens = ([] for _ in range(10))
        shared = [self._common(a, b) for a, b in zip(sets[:-1], sets[1:], strict=True)]
        self._grow(0, len(sets), 0, shared)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _node(self, lo: int, hi: int, start: int, end: int) -> int:
        sizes = [len(s) for s in self.sets[lo:hi]]
        self.tokens.append(self.sets[lo][start:end])
        self.start.append(start)
        self.end.append(end)
        self.children.append([])
        self.first.append(lo)
        self.last.append(hi)
        self.least.append(min(sizes))
        self.most.append(max(sizes))
        self.member.append(lo if hi == lo + 1 else -1)
        self.same.append(lo if hi == lo + 1 else -1)
        return len(self.start) - 1

    def _grow(self, lo: int, hi: int, depth: int, shared: list[int]) -> None:
        todo = [(lo, hi, depth, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            end = len(self.sets[lo]) if hi == lo + 1 else min(shared[lo : hi - 1])
            node = self._node(lo, hi, depth, end)
            if parent >= 0:
                self.children[parent].append(node)
            if hi == lo + 1:
                continue
            cut = lo
            for i in range(lo, hi):
                if i == hi - 1 or shared[i] == end:
                    todo.append((cut, i + 1, end, node))
                    cut = i + 1


class Forest:
    """Union-find."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def walk(trie: Trie, probe: np.ndarray, me: int, forest: Forest, pct: int, tops: set[int]) -> Iterator[int]:
    """Members of the trie, below the given children of the root, that the probe links with and that weren't yet connected with it."""
    n = len(probe)
    # What all sets share is read once; a trie of one set is its root.
    root = trie.tokens[0] if trie.children[0] else trie.tokens[0][:0]
    at = int(np.searchsorted(probe, root[-1], "right")) if len(root) else 0
    shared = int(np.isin(root, probe).sum()) if len(root) else 0
    todo = [(top, at, shared, False) for top in tops]
    while todo:
        node, at, overlap, back = todo.pop()
        if back:  # all below have been seen: note whether they are one component now
            roots = {forest.root(trie.same[c]) if trie.same[c] >= 0 else -1 for c in trie.children[node]}
            if len(roots) == 1 and -1 not in roots:
                trie.same[node] = roots.pop()
            continue
        if trie.same[node] >= 0 and forest.root(trie.same[node]) == forest.root(me):
            continue
        least, most = trie.least[node], trie.most[node]
        if 100 * most < pct * n or 100 * n < pct * least:
            continue
        tokens = trie.tokens[node]
        if len(tokens):
            spots = np.searchsorted(probe, tokens)
            spots_in = np.minimum(spots, n - 1)
            overlap += int((probe[spots_in] == tokens).sum())
            at = int(spots[-1]) + int(spots[-1] < n and probe[spots[-1]] == tokens[-1])
        member = trie.member[node]
        if member >= 0:
            if 100 * overlap >= pct * (n + most - overlap):
                yield member
            continue
        # Sizes below may differ; the smallest asks for the least overlap.
        if (100 + pct) * (overlap + min(n - at, most - trie.end[node])) < pct * (n + least):
            continue
        todo.append((node, 0, 0, True))
        todo.extend((c, at, overlap, False) for c in trie.children[node])


def rare_tokens(sets: list[np.ndarray], pct: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens as numbers, where each set's begin and the end): of each set its rarest n - ceil(pct * n / 100) + 1, without those that no other has.

    Two sets that link share pct hundredths of the larger at least, so they have one of these in common.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((place, counts[place], owner))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = (rank < (sizes + (-pct * sizes) // 100 + 1)[owner]) & (counts[place[order]] > 1)
    return place[order][kept], np.searchsorted(owner[kept], np.arange(len(sets) + 1))


def trie_links(left: dict[bytes, int], right: dict[bytes, int] | None, pct: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among left, or between left and right: a spanning forest. Values are ids.

    A probe enters only those branches at the trie's top below which a set has one of its rare tokens.
    """
    both = right if right is not None else left
    names = sorted(both)
    if not names:
        return []
    apart = right is not None
    probes = sorted(left) if apart else names
    sets = [np.frombuffer(b, ">u8").astype(np.uint64) for b in (names + probes if apart else names)]
    trie, out = Trie(sets[: len(names)]), []
    rare, cut = rare_tokens(sets, pct)
    branches: dict[int, set[int]] = {}
    for top in trie.children[0] or [0]:
        for token in set(rare[cut[trie.first[top]] : cut[trie.last[top]]].tolist()):
            branches.setdefault(token, set()).add(top)
    forest = Forest(len(sets))
    for me, name in enumerate(probes, len(names) if apart else 0):
        tops = set().union(*(branches.get(t, ()) for t in rare[cut[me] : cut[me + 1]].tolist()))
        for other in walk(trie, sets[me], me, forest, pct, tops):
            if forest.link(me, other):
                out.append((left[name], both[names[other]]))
    return out


#: From sets with ids, to be compared among themselves or with others, to links that connect what is linked.
Join = Callable[[dict[bytes, int], dict[bytes, int] | None, int], list[tuple[int, int]]]


def join_bin(table: pa.Table, pct: int, join: Join) -> pa.Table:
    """(block, part pair, side, doc_id, tokens) of a bin to links (a, b)."""
    blocks: dict[tuple, list[dict[bytes, int]]] = {}
    for batch in table.to_batches(max_chunksize=1000):
        for block, pair, side, doc, tokens in zip(*(batch.column(c).to_pylist() for c in ("block", "pair", "side", "doc_id", "tokens")), strict=True):
            held = blocks.setdefault((block, pair), [{}, {}])[side]
            held[tokens] = min(doc, held.get(tokens, doc))
    links: list[tuple[int, int]] = []
    while blocks:
        left, right = blocks.popitem()[1]
        links += join(left, right or None, pct)
    if table.nbytes > 1 << 20:
        give_back()
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


# ---- the operator ----------------------------------------------------------------------------------------------------


def ngram_components(docs: DataFrame, k: int = 5, pct: int = 80, max_tokens: int = MAX_TOKENS, bits: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text, ...).

    Two documents link when 100 * intersection >= pct * union of their sets of k-word shingles; component_id is the
    smallest doc_id that is reachable by links. Null or blank texts have an empty set and link with nothing. Rows with a
    null doc_id have a null component_id and link nothing. Rows that share a doc_id are one vertex, which links by each of its
    texts. doc_id is a whole number (what casts to long). Other columns are ignored; an empty table gives an empty result.
    """
    return set_components(docs, partial(shingle_sets, k=k), pct, max_tokens, bits=bits)


def set_components(docs: DataFrame, sets_of: Sets, pct: int, max_tokens: int = MAX_TOKENS, join: Join = trie_links, bits: int | None = None) -> DataFrame:
    """ngram_components() for the sets that sets_of makes of texts; their tokens are spread evenly over 64 bits."""
    bits = bits or sketch_bits(docs)
    docs = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    described = materialize(docs.mapInArrow(partial(describe, sets_of=sets_of, bits=bits), "doc_id long, n_shingles long, d1 long, d2 long, at long, slice long, counters binary"), "sizes")
    hot = hot_tokens(described.where("counters IS NOT NULL").select("at", "slice", "counters"), bits)
    sizes = described.where("counters IS NULL").select("doc_id", "n_shingles", "d1", "d2")
    vertices = sizes.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(vertices.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    # Ids with several texts: their sets' classes are linked. (Two numbers an id are compared; most tables have none.)
    twice = vertices.groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low <> high").select("doc_id")
    several = vertices.join(twice, "doc_id", "left_semi").join(classes, ["n_shingles", "d1", "d2"]).select("doc_id", F.col("rep").alias("v")).distinct()
    same_id = materialize(several.where("doc_id <> v").select(F.col("doc_id").alias("a"), F.col("v").alias("b")), "same")

    total = classes.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    buckets = max(8, int(total * 5 * (100 - pct) / (100 + pct)) // BUCKET_POSTINGS + 1)
    posted = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(partial(post, sets_of=sets_of, pct=pct, buckets=buckets, hot=hot), "bucket int, ids binary, counts binary, keys binary, links binary")
    near = connected_components(posted.groupBy("bucket").applyInArrow(lambda t: meet(t), "a long, b long"))

    members = near.join(classes, near.v == classes.d1).select("rep", F.col("component").alias("block"), "n_shingles")
    members = materialize(members, "members")
    weight = members.groupBy("block").agg(F.sum("n_shingles").alias("tokens"))
    # Blocks of moderate size share bins; a larger one is cut into parts by a hash of the document.
    bins = max(1, (members.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0) * 4 // max_tokens)
    parts = F.ceil(F.col("tokens") / F.lit(max_tokens // 2)).cast("int")
    members = members.join(weight, "block").select("rep", "block", F.when(F.col("tokens") <= max_tokens, 1).otherwise(parts).alias("parts"))
    members = members.select("rep", "block", "parts", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.pmod(F.xxhash64("block"), F.lit(bins)).alias("bin")).distinct()
    members = materialize(members, "members")
    held = members.count()
    side = F.broadcast(members) if held <= BROADCAST_ROWS else members
    # A part meets every part of its block once, in the task of that pair; on its own it is the left side.
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    texts = docs.join(side, docs.doc_id == side.rep).select("bin", "block", F.struct("parts", "part").alias("part"), "doc_id", "text")
    sets = texts.mapInArrow(partial(collect_sets, sets_of=sets_of), "bin long, block long, part struct<parts:int,part:int>, doc_id long, tokens binary")
    sets = sets.select("bin", "block", F.col("part.parts").alias("parts"), F.col("part.part").alias("part"), "doc_id", "tokens").withColumn("pair", F.explode(pairs))
    sets = sets.select("bin", "block", F.when(F.col("parts") > 1, F.concat_ws("-", "pair.i", "pair.j")).otherwise("").alias("pair"), F.when(F.col("part") == F.col("pair.i"), 0).otherwise(1).alias("side"), "doc_id", "tokens", "parts")
    slot = F.when(F.col("parts") > 1, F.concat_ws("/", "block", "pair")).otherwise(F.col("bin").cast("string"))
    links = sets.withColumn("slot", slot).drop("bin", "parts").groupBy("slot").applyInArrow(lambda t: join_bin(t, pct, join), "a long, b long")
    found = connected_components(links.union(same_id))

    named = classes.join(found, classes.rep == found.v, "left").select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    # A table of its own, so that the join deals both sides anew and can split a class with many copies.
    several = materialize(named.groupBy("n_shingles", "d1", "d2").agg(F.min("component_id").alias("component_id")), "classes")
    keys = ["n_shingles", "d1", "d2"]
    out = sizes.join(several, keys, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT DISTINCT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) c ON c.v = doc_id
"""
