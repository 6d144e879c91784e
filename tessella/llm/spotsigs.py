"""Document fingerprints: SpotSigs.

Method: wherever a common word stands (an anchor: articles, prepositions, conjunctions), the next content words form a chain; the
hashes of anchor and chain are the signatures, and the set of them is the fingerprint. Words are taken without the symbols at their
ends. Boilerplate beside texts with such words leaves few traces; stretches without any have chains of their own. Of a document, its edited text and the next document, likeness() gives the whole Jaccard likeness.

Across all documents, near_copies() links fingerprints of a likeness of NEAR_PCT or more, by the set join of ngram_join: sets are
partitioned by ranges of set length, own and next, as likeness can't be reached beyond; signatures that stand out in a sketch
are left out of keys, large blocks are cut into parts. Within a block, an index by length class and rare signatures gives
the fingerprints of the own and the next class to compare, and likeness() stops where NEAR_PCT is out of reach. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.ngram_join import Forest, rare_tokens, set_components
from tessella.llm.textarrays import bounded, chunks, mix, released, small_batches, words
from tessella.plans.shared import materialize

#: Anchors, in four languages; also left out of chains.
COMMON = "a an and are as at be by for from in is it of on or that the this to was with  au aux de des du elle en est et il la le les par pas pour que qui sur un une  auf das dem den der des die ein eine für im ist mit nicht sich und von zu  al con como del el en es las lo los para por que se su un una y".split()
#: Content words of a chain.
CHAIN = 2
#: Words without an anchor after which every word begins a chain.
LONELY = 8
#: Fingerprints whose Jaccard likeness is so many hundredths or more are near copies.
NEAR_PCT = 80
#: Signatures of a block that one task compares at once.
MAX_TOKENS = 1_000_000


def _hash_of(texts: list[str]) -> np.ndarray:
    _, data, offsets = next(chunks(pa.array(texts)))
    return words(data, offsets)[0]


_common: list[np.ndarray] = []


def anchors() -> np.ndarray:
    if not _common:
        _common.append(np.unique(_hash_of(sorted(set(COMMON)))))
    return _common[0]


def signatures(texts: pa.Array, chain: int = CHAIN) -> Iterator[np.ndarray]:
    """Of every text, the sorted distinct signatures. Words count without the symbols at their ends.

    A chain begins at every common word, and at every other word that has none among the LONELY words before it (the text's begin counts
    as one), so that stretches in other languages, lists and tables are covered and an edit changes chains nearby only.
    A signature that comes again counts again, with its number. A text without any chain has those of all its
    content words; with too few content words, one signature of all words. Signatures are cut to 32 bits: two different ones are
    taken for equal with odds of 2**-32.
    """
    for _, data, offsets in chunks(texts):
        hashes, _, first = words(data, offsets, trim=True)
        count = len(hashes)
        common = np.isin(hashes, anchors())
        content = np.flatnonzero(~common)
        owner = np.searchsorted(first, np.arange(count), "right") - 1
        before = np.maximum(np.maximum.accumulate(np.where(common, np.arange(count), -1)) if count else np.zeros(0, np.int64), first[owner] - 1)
        anchor = np.flatnonzero(common | (np.arange(count) - before > LONELY))
        at = np.searchsorted(content, anchor, "right")
        whole = at + chain <= len(content)
        anchor, at = anchor[whole], at[whole]
        if len(anchor):
            # The chain's last word must stand in the same text.
            inside = owner[content[at + chain - 1]] == owner[anchor]
            anchor, at = anchor[inside], at[inside]
        sig = hashes[anchor]
        for j in range(chain):
            sig = mix(sig * np.uint64(31) + hashes[content[at + j]]) if len(sig) else sig
        sig = numbered(sig, owner[anchor])
        cut = np.searchsorted(owner[anchor], np.arange(len(first)))
        for i in range(len(first) - 1):
            s = sig[cut[i] : cut[i + 1]]
            if not len(s) and first[i + 1] > first[i]:
                h = hashes[first[i] : first[i + 1]][~common[first[i] : first[i + 1]]]
                if len(h) >= chain:
                    s = np.zeros(len(h) - chain + 1, np.uint64)
                    for j in range(chain):
                        s = mix(s * np.uint64(31) + h[j : len(h) - chain + 1 + j])
                    s = numbered(s, np.zeros(len(s), np.int64))
                else:
                    s = mix(np.array([np.add.reduce(mix(hashes[first[i] : first[i + 1]] + np.arange(first[i + 1] - first[i], dtype=np.uint64)))]))
            yield np.unique((s >> np.uint64(32)).astype(np.uint32))


def numbered(sig: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Signatures, each mixed with how many equal ones of its row are before it; the first stays."""
    order = np.lexsort((sig, row))
    s, r = sig[order], row[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (r[1:] != r[:-1]))) if len(s) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0)) if len(s) else np.zeros(0, np.int64)
    place = np.zeros(len(s), np.uint64)
    place[order] = (np.arange(len(s)) - start).astype(np.uint64)
    return np.where(place > 0, mix(sig + place * np.uint64(0x9E3779B97F4A7C15)), sig)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 as soon as it can't reach `least`. Two empty sets are equal."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large or not small:
        return 0.0
    # The range that both span bounds the overlap.
    lo, hi = max(a[0], b[0]), min(a[-1], b[-1])
    a_in = a[np.searchsorted(a, lo) : np.searchsorted(a, hi, "right")]
    b_in = b[np.searchsorted(b, lo) : np.searchsorted(b, hi, "right")]
    bound = min(len(a_in), len(b_in))
    if not bound or bound < least / (1 + least) * (small + large):
        return 0.0
    spot = np.minimum(np.searchsorted(b_in, a_in), len(b_in) - 1)
    both = int((b_in[spot] == a_in).sum())
    return both / (small + large - both)


def length_class(n: int, least: float) -> int:
    """Class of a set length: fingerprints of a likeness of `least` or more lie in one class or in neighbouring ones."""
    return 0 if n < 1 else 1 + int(np.floor(np.log(n) / -np.log(least) + 1e-9))


def text_of(sig: np.ndarray) -> str:
    """The fingerprint as text: number of signatures, then all of them in order, eight hexadecimal digits each."""
    return f"{len(sig)}:{sig.astype('>u4').tobytes().hex()}"


def signatures_of(text: str) -> np.ndarray:
    """The set back from text_of()."""
    return np.frombuffer(bytes.fromhex(text.partition(":")[2]), ">u4").astype(np.uint32)


# ---- every document, its edited text and the next document -----------------------------------------------------------

#: Results as they are written: of the edited fingerprint, which signatures it keeps and those it adds.
OUT = "n_chars long, edited_sha256 string, fingerprint string, kept array<boolean>, added string, near_edited double, near_next double"
NAMES = ["doc_id", "pid", "role", "copies", "text", *(x.split()[0] for x in OUT.split(", "))]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.bool_()), pa.string(), pa.float64(), pa.float64()]


class Row:
    """A document that waits for the next one."""

    __slots__ = ("doc_id", "text", "sig", "copies")

    def __init__(self, doc_id, text: str, sig: np.ndarray, copies: int = 1) -> None:
        self.doc_id, self.text, self.sig, self.copies = doc_id, text, sig, copies


def results(rows: list[Row], after: list[Row], id_type: pa.DataType) -> pa.RecordBatch:
    """The result rows of documents whose next document is known."""
    edited = [r.text[: len(r.text) - len(r.text) // 4] + n.text[: len(r.text) // 4] for r, n in zip(rows, after, strict=True)]
    sigs = list(signatures(pa.array(edited, pa.large_string())))
    cells = [
        (r.doc_id, len(r.text), sha256(e.encode()).hexdigest(), text_of(r.sig), np.isin(r.sig, s), np.setdiff1d(s, r.sig, True).astype(">u4").tobytes().hex(), likeness(r.sig, s), likeness(r.sig, n.sig))
        for r, n, e, s in zip(rows, after, edited, sigs, strict=True)
        for _ in range(r.copies)
    ]
    ids, *cols = zip(*cells, strict=True) if cells else [()] * 8
    k = len(cells)
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.nulls(k, pa.int32()), pa.array(["done"] * k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), *(pa.array(c, t) for c, t in zip(cols, TYPES, strict=True))], NAMES)


def ends(first: Row, last: Row, pid: int, id_type: pa.DataType) -> pa.RecordBatch:
    """The first and the last document of a partition, which others need or which need others."""
    two = [first, last]
    none = [pa.nulls(2, t) for t in TYPES]
    return pa.RecordBatch.from_arrays([pa.array([r.doc_id for r in two], id_type), pa.array([pid, pid], pa.int32()), pa.array(["first", "last"], pa.string()), pa.array([r.copies for r in two], pa.int64()), pa.array([r.text for r in two], pa.string()), *none], NAMES)


@released()
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle."""
    press = zstandard.ZstdCompressor(level=3, write_checksum=False)
    for batch in small_batches(batches, "text"):
        packed = pa.array([press.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), packed], ["doc_id", "h", "packed"])


@released()
def _stream(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range to results; the range's first and last rows come out as they are."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    unpack = zstandard.ZstdDecompressor()
    first = held = None
    for batch in small_batches(batches, "packed", 2 << 20):
        texts = [unpack.decompress(x).decode() for x in batch.column("packed").to_pylist()]
        done, after = [], []
        for doc_id, text, sig in zip(batch.column("doc_id").to_pylist(), texts, signatures(pa.array(texts, pa.large_string())), strict=True):
            if held is not None and held.doc_id == doc_id and held.text == text:
                held.copies += 1
                continue
            row = Row(doc_id, text, sig)
            first = first or row
            if held is not None:
                done.append(held)
                after.append(row)
            held = row
        if done:
            yield results(done, after, id_type)
    if held is not None:
        yield ends(first, held, pid, id_type)


@released()
def _seam(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(doc_id, copies, text, next_text) of the rows at the ends of ranges to results."""
    for batch in small_batches(batches, "text", 2 << 20):
        own, after = batch.column("text").to_pylist(), batch.column("next_text").to_pylist()
        rows = [Row(i, t, s, c) for i, t, s, c in zip(batch.column("doc_id").to_pylist(), own, signatures(batch.column("text")), batch.column("copies").to_pylist(), strict=True)]
        yield results(rows, [Row(None, t, s) for t, s in zip(after, signatures(batch.column("next_text")), strict=True)], id_type)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs.

    The next document follows by ascending doc_id (null last; of equal ids by a hash of the text; repeated rows count as
    one document, whose result each gets), after the last the first. The edited text is the text with its last quarter
    (rounded down) replaced by the next document's beginning. Null text is empty. Other columns are ignored.

    One range shuffle of compressed texts brings neighbours together; a task reads its range as a stream. The seams between ranges (two rows
    a task) are joined afterwards.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow = pa.string() if id_type == "string" else pa.int64()
    rows = bounded(docs).select(F.col("doc_id") if id_type == "string" else F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    kind = "string" if id_type == "string" else "long"
    rows = rows.withColumn("h", F.xxhash64("text")).mapInArrow(_pack, f"doc_id {kind}, h long, packed binary")
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_stream, id_type=arrow), f"doc_id {kind}, pid int, role string, copies long, text string, {OUT}")
    found = materialize(found, "fingerprints")
    pids = sorted(r["pid"] for r in found.where("role = 'last'").select("pid").collect())  # one number a task
    following = spark.createDataFrame(list(zip(pids, pids[1:] + pids[:1], strict=True)), "pid int, next_pid int")
    last = found.where("role = 'last'").select("doc_id", "copies", "text", "pid").join(following, "pid")
    first = found.where("role = 'first'").select(F.col("pid").alias("next_pid"), F.col("text").alias("next_text"))
    seams = last.join(first, "next_pid").select("doc_id", "copies", "text", "next_text")
    seams = seams.mapInArrow(partial(_seam, id_type=arrow), f"doc_id {kind}, pid int, role string, copies long, text string, {OUT}")
    columns = ["doc_id", *(x.split()[0] for x in OUT.split(", "))]
    every = found.where("role = 'done'").select(*columns).unionByName(seams.select(*columns))
    pieces = lambda c: F.regexp_extract_all(c, F.lit("[0-9a-f]{8}"), F.lit(0))
    stay = F.filter(F.zip_with(pieces(F.substring_index("fingerprint", ":", -1)), F.col("kept"), lambda s, k: F.when(k, s)), lambda s: s.isNotNull())
    edited = F.transform(F.array(F.array_sort(F.concat(stay, pieces(F.col("added"))))), lambda s: F.concat(F.size(s), F.lit(":"), F.array_join(s, "")))[0]
    return every.select("doc_id", "n_chars", "edited_sha256", "fingerprint", edited.alias("edited_fingerprint"), "near_edited", "near_next")


# ---- fingerprints of all documents compared --------------------------------------------------------------------------


def spread_signatures(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of every text, its signatures spread over 64 bits (a bijection), sorted."""
    for s in signatures(texts):
        yield np.sort(mix(s.astype(np.uint64)))


class Posting:
    """Members of an index entry in groups that are connected, so that a probe passes over its own component in one step."""

    __slots__ = ("groups",)

    def __init__(self) -> None:
        self.groups: list[list[int]] = []

    def add(self, i: int) -> None:
        self.groups.append([i])

    def others(self, me: int, forest: Forest) -> Iterator[int]:
        """Members that aren't connected with me at their turn."""
        if len(self.groups) > 1:
            by: dict[int, list[int]] = {}
            for g in self.groups:
                held = by.setdefault(forest.root(g[0]), g)
                if held is not g:
                    held.extend(g)
            self.groups = list(by.values())
        for g in self.groups:
            for i in g:
                if forest.root(g[0]) == forest.root(me):
                    break
                yield i


def spot_links(left: dict[bytes, int], right: dict[bytes, int] | None, pct: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among left, or between left and right. Keys are sets as big-endian bytes, values ids.

    Two sets of a likeness of pct hundredths share one of their rarest n - ceil(pct * n / 100) + 1 signatures.
    """
    names = [*left, *(right or ())]
    if not names:
        return []
    ids = [*left.values(), *(right or {}).values()]
    sets = [np.frombuffer(b, ">u8").astype(np.uint64) for b in names]
    sizes = np.array([len(s) for s in sets], np.int64)
    least = pct / 100
    classes = [length_class(n, least) for n in sizes.tolist()]
    rare, cut = rare_tokens(sets, pct)
    forest, out = Forest(len(sets)), []
    index: dict[int, dict[int, Posting]] = {}

    def insert(i: int) -> None:
        held = index.setdefault(classes[i], {})
        for token in rare[cut[i] : cut[i + 1]].tolist():
            held.setdefault(token, Posting()).add(i)

    def probe(i: int) -> None:
        seen: set[int] = set()
        near = [index[c] for c in (classes[i] - 1, classes[i], classes[i] + 1) if c in index]
        for token in rare[cut[i] : cut[i + 1]].tolist():
            for held in near:
                if token not in held:
                    continue
                for other in held[token].others(i, forest):
                    if other not in seen:
                        seen.add(other)
                        # A little less, so that rounding prunes no pair that reaches it exactly.
                        if likeness(sets[i], sets[other], least - 1e-9) >= least and forest.link(i, other):
                            out.append((ids[i], ids[other]))

    if right is not None:
        for i in range(len(left), len(sets)):
            insert(i)
    for i in np.argsort(sizes[: len(left)], kind="stable").tolist():
        probe(i)
        if right is None:
            insert(i)
    return out


def near_copies(docs: DataFrame, pct: int = NEAR_PCT, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, n_signatures, component_id) of every row of docs(doc_id, text, ...): fingerprints of all documents compared.

    Documents link when 100 * intersection >= pct * union of their signatures, wherever they stand in the table; component_id is
    the smallest doc_id reachable by links. Null and blank texts link with nothing; rows with a null doc_id have a null component_id.
    """
    return set_components(docs, spread_signatures, pct, max_tokens, spot_links).withColumnRenamed("n_shingles", "n_signatures")
