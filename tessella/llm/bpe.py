"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer.

Method: the symbols of a word form a doubly linked list; a heap holds the rank of every pair of neighbours. The lowest
rank (then the leftmost pair) is merged, its neighbours' new pairs are pushed, and entries whose symbols have changed
since are skipped when popped. Decoding concatenates the vocabulary's strings of the ids and turns them back into bytes.
Words that recur are kept in a bounded table with their ids and the bytes these decode to.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.textarrays import KEPT, bounded, released, small_batches

#: Fixed value: the pattern by which byte-level tokenizers cut a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of one generation that a worker keeps; there are two.
KEPT_WORDS = 150_000
#: Bytes of a column that are turned into lists of ids, or back, at once.
ID_BATCH_BYTES = 1 << 20
#: Longer words are not kept.
KEPT_LENGTH = 64


def default_vocabulary() -> str:
    """Where the byte-level vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


class Kept(dict):
    """What a function gives for a word, kept in two generations: a full one becomes the old one, from which words that recur return."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if not isinstance(word, str) or len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class Tokenizer:
    """Byte-level BPE from a tokenizer file without normalizer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(self.vocabulary.values()) + 1
        #: (left, right, merged) by rank, and the rank of left * size + right.
        self.merges = [(self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]) for a, b in merges]
        self.rank_of = {a * self.size + b: rank for rank, (a, b, _) in enumerate(self.merges)}
        self.letters = byte_letters()
        self.first = [self.vocabulary[x] for x in self.letters]
        self.bytes_of = {x: b for b, x in enumerate(self.letters)}
        self.strings = {i: s for s, i in self.vocabulary.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.special_bytes = {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        #: Bytes that an id's vocabulary string stands for.
        self.piece = Kept(lambda i: self.special_bytes.get(i) or bytes([self.bytes_of[c] for c in self.strings[i]]))
        #: Of a word, its ids joined by commas, and the bytes that these ids stand for.
        self.kept = Kept(self.word)

    def word(self, word: str) -> tuple[str, bytes]:
        ids = self.merge(word.encode())
        return ",".join(map(str, ids)), self.decode_bytes(ids)

    def merge(self, data: bytes) -> list[int]:
        """Ids of a word. A heap entry is rank * length + place: the lowest rank first, then the leftmost."""
        ids, n = [self.first[b] for b in data], len(data)
        rank_of, size = self.rank_of.get, self.size
        heap = [rank * n + i for i in range(n - 1) if (rank := rank_of(ids[i] * size + ids[i + 1])) is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            left, right, merged = self.merges[rank]
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(merged * size + ids[k])) is not None:
                    heapq.heappush(heap, rank * n + i)
            if (h := before[i]) >= 0 and (rank := rank_of(ids[h] * size + merged)) is not None:
                heapq.heappush(heap, rank * n + h)
        return [x for x in ids if x >= 0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes that the ids' vocabulary strings, one after the other, stand for."""
        return b"".join(map(self.piece.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text that the ids stand for; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def parts(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """The words between special tokens, each time followed by the next special token's id."""
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                yield [], self.special[part]
            elif part:
                yield self.words.findall(part), None

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens in it are recognised."""
        out: list[int] = []
        for found, special in self.parts(text):
            if special is not None:
                out.append(special)
            else:
                out += map(int, ",".join([x for x, _ in map(self.kept.__getitem__, found)]).split(","))
        return out

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text)."""
        ids, back = [], []
        for found, special in self.parts(text):
            if special is not None:
                ids.append(str(special))
                back.append(self.special_bytes[special])
            else:
                got = list(map(self.kept.__getitem__, found))
                ids.append(",".join([x for x, _ in got]))
                back.append(b"".join([x for _, x in got]))
        joined, whole = ",".join(ids), b"".join(back)
        try:
            whole.decode()
        except UnicodeDecodeError:
            whole = whole.decode("utf-8", "replace").encode()
        return joined.count(",") + 1 if joined else 0, sha256(joined.encode()).hexdigest(), sha256(whole).hexdigest()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


KEPT["tokenizers"] = tokenizer.cache_clear


@released("tokenizers")
def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path)
    for batch in small_batches(batches, "text", 4 << 20):
        rows = [t.digests(x or "") for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


@released("tokenizers")
def _coded(batches: Iterator[pa.RecordBatch], path: str, column: str, ids: str | None, decoded: str | None) -> Iterator[pa.RecordBatch]:
    """Rows with a column of ids of the texts in `column`, one of decoded texts, or both; without `ids`, `column` holds ids."""
    t = tokenizer(path)
    for batch in small_batches(batches, column, ID_BATCH_BYTES):
        held = batch.column(column).to_pylist()
        if ids:
            held = [t.encode(x or "") for x in held]
            batch = batch.append_column(ids, pa.array(held, pa.list_(pa.int32())))
        if decoded:
            batch = batch.append_column(decoded, pa.array([t.decode(x or []) for x in held], pa.string()))
        yield batch


def _with(rows: DataFrame, vocabulary: str | None, column: str, ids: str | None, decoded: str | None) -> DataFrame:
    made = {name: kind for name, kind in ((ids, "array<int>"), (decoded, "string")) if name}
    rows = bounded(rows.drop(*made))
    schema = rows.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in made.items())).schema
    return rows.mapInArrow(partial(_coded, path=vocabulary or default_vocabulary(), column=column, ids=ids, decoded=decoded), schema)


def encode(docs: DataFrame, column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs with the token ids of a text column as `ids` (a column of that name is replaced). Null text: no ids."""
    return _with(docs, vocabulary, column, "ids", None)


def decode(ids: DataFrame, column: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """ids with the text of a column of token ids as `decoded` (a column of that name is replaced). Null: an empty text."""
    return _with(ids, vocabulary, column, None, "decoded")


def encode_and_decode(docs: DataFrame, column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """decode(encode(docs)), by one worker instead of two in a row."""
    return _with(docs, vocabulary, column, "ids", "decoded")


def token_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs(doc_id, text, ...).

    Null and empty texts have no tokens. Repeated rows give repeated results; other columns are ignored.
    """
    docs = bounded(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(partial(_digests, path=vocabulary or default_vocabulary()), schema)
