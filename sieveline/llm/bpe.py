"""Operator 5, byte-level BPE encoding and decoding: a tree reduction over a monoid.

The value of a stretch of a piece is its token list; joining two neighbours is associative. A piece (a match of the
split pattern) is encoded by halves, recursively. A token list is the encoding of its bytes if and only if each token is
the encoding of itself and each pair of neighbours is the encoding of its joint bytes. So when the last token of the left
half and the first of the right half are such a pair, the halves are simply put together; else a window around the seam
is encoded anew and grows, on the side whose outer pair is not stable, until both are: the tokens outside then provably
stay. Decoding maps ids to bytes and concatenates up the tree.

A text is cut in front of a blank that follows another character, where a match of the pattern always ends, so the
pieces of the stretches are those of the text, and long texts are taken in bounded stretches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, table

#: Characters that a stretch of a text has at least, before it is cut at the next certain boundary.
STRETCH = 1 << 16

#: Distinct pieces, leaves and pairs that a worker keeps; then it starts over.
KEPT_PIECES = 250_000


class Codec:
    """Ranks of byte strings (id = rank) and the pattern that splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        # blanks by the Unicode property, as the tiktoken library has them; this module's own class has four more
        blanks = lambda p: regex.compile(p.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ranks, self.pattern, self.cut = ranks, blanks(pattern), blanks(r"(?<=\S)(?=\s)")
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.text_of = {str(v): k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.joined: dict[str, str] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """The encoding by definition: again and again the pair of lowest rank is merged, the leftmost of equals.
        Used for leaves and windows."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a and b may be neighbours: their joint bytes encode to them."""
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > KEPT_PIECES:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j, grow = len(left) - 1, 1, 1
        while True:
            data = b"".join([self.bytes_of[t] for t in left[i:]] + [self.bytes_of[t] for t in right[:j]])
            window = self.merge(data) if len(data) <= 64 else self.reduce(data, whole=False)
            ok_left = i == 0 or self.stable(left[i - 1], window[0])
            ok_right = j == len(right) or self.stable(window[-1], right[j])
            if ok_left and ok_right:
                return left[:i] + window + right[j:]
            if not ok_left:
                i = max(0, i - grow)
            if not ok_right:
                j = min(len(right), j + grow)
            grow *= 2

    def reduce(self, data: bytes, whole: bool = True) -> list[int]:
        """Encodes a piece by halves. Leaves of up to 8 bytes are merged by definition."""
        if len(data) <= 8:
            if (leaf := self.leaves.get(data)) is None:
                if len(self.leaves) > KEPT_PIECES:
                    self.leaves.clear()
                leaf = self.leaves[data] = self.merge(data)
            return leaf
        if not whole and len(data) > 64:  # a window: fold its parts from the left, so that each join sees a final left side
            out: list[int] = []
            for k in range(0, len(data), 32):
                out = self._fold(out, data[k : k + 32])
            return out
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def _fold(self, left: list[int], data: bytes) -> list[int]:
        """Appends bytes to a token list: the tail that the new bytes disturb is encoded anew, in growing windows."""
        i = len(left)
        while True:
            tail = b"".join([self.bytes_of[t] for t in left[i:]]) + data
            window = self.merge(tail)
            if i == 0 or self.stable(left[i - 1], window[0]):
                return left[:i] + window
            i = max(0, i - max(1, (len(left) - i) * 2))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)  # a piece that is a token is that token
        return (whole,) if whole is not None else tuple(self.reduce(data))

    def stretches(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > STRETCH:
            m = self.cut.search(text, start + STRETCH)
            if not m:
                break
            yield text[start : m.start()]
            start = m.start()
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        return [t for s in self.stretches(text) for p in self.pattern.findall(s) for t in self.encode_piece(p)]

    def ids_text(self, text: str) -> list[str]:
        """The ids in decimal, comma-joined for each stretch."""
        out, joined = [], self.joined
        for s in self.stretches(text):
            pieces = self.pattern.findall(s)
            try:
                parts = [joined[p] for p in pieces]
            except KeyError:
                if len(joined) > KEPT_PIECES:
                    joined.clear()
                for p in pieces:
                    if p not in joined:
                        joined[p] = ",".join(map(str, self.encode_piece(p)))
                parts = [joined[p] for p in pieces]
            if parts:
                out.append(",".join(parts))
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Concatenates up the tree."""
        if len(ids) <= 4096:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def decode_text(self, ids: list[str]) -> list[bytes]:
        """The bytes of comma-joined stretches."""
        look = self.text_of.__getitem__
        return [b"".join(map(look, s.split(","))) for s in ids]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One a worker."""
    return Codec.load(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the ids, decoded).

    A null or empty text has no tokens: both digests are those of nothing. Repeated rows give equal rows, an empty table
    none; other columns are not read. Very long texts are taken in stretches. No shuffle.
    """
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = own.ids_text(text)
                sha, back = hashlib.sha256(), hashlib.sha256()
                for k, s in enumerate(ids):
                    sha.update(("," + s if k else s).encode())
                for data in own.decode_text(ids):
                    back.update(data)
                rows.append((sum(s.count(",") + 1 for s in ids), sha.hexdigest(), back.hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)


#: Documents whose ids are held at once as Python objects.
ROWS_AT_ONCE = 256


def encoded(docs: DataFrame, vocabulary: tuple[str, str] | None = None, ids: str = "token_ids", back: str = "decoded") -> DataFrame:
    """The documents with all their columns, the ids of their text (array of int) and the text decoded from them.

    The two new columns must not clash with the table's own; choose their names then. Null texts have no ids and decode
    to an empty text."""
    if {ids, back} & set(docs.columns):
        raise ValueError("name the columns of ids and of decoded texts otherwise: the table has such columns")
    path, pattern = vocabulary or default_vocabulary()
    at, names = docs.columns.index("text"), [*docs.columns, ids, back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                texts = [own.ids_text(t.as_py() or "") for t in batch.column(at)]
                made = pa.array([[int(x) for s in t for x in s.split(",")] for t in texts], pa.list_(pa.int32()))
                decoded = pa.array([b"".join(own.decode_text(t)) for t in texts], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, made, decoded], names=names)
                del texts, made, decoded
        give_back()

    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(back, T.StringType())])
    return docs.mapInArrow(run, schema)


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = None
