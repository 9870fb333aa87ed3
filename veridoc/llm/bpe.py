"""Byte-level BPE encoding and decoding in linear time.

A text is split by the tokenizer's pattern and each piece is encoded on its own. Instead of merging pair by pair, the
encoder searches for the one segmentation that merging would produce: an Aho-Corasick automaton over the vocabulary
(bytes mapped to Latin-1 characters) finds the longest token at every position, and a walk takes tokens from the left,
each compatible with the token before it, going on to the next shorter token or one step back where it must. Two
tokens are compatible if merging the bytes of both yields just those two; that is found by undoing the last merges
around the border, and is memoised. Positions from which the walk failed are remembered, so none is entered twice and
time stays linear in the piece, also for pieces of megabytes.

Texts are mapped in Arrow batches without any shuffle. Workers build the automaton once from the broadcast ranks (one
file of fixed size). Short pieces are cached, at most CACHE of them in each of two generations.

Defined cases: a null text is an empty one; an empty text has no ids; repeated rows are encoded each; other columns pass
through encode_documents() but for those named like its own (ids, n_tokens, ids_sha256, decoded_sha256), which it
replaces; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.llm.shared import map_arrow, table, unused

CACHE = 250_000  # pieces of each of two generations
CACHED_LENGTH = 48  # characters; longer pieces are rarely seen again
BATCH = 256  # texts decoded to Python strings at a time


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id: a line has a token in base64 and its rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"the ranks in {path} have gaps")
    return [found[i] for i in range(len(found))]


class Codec:
    """Encoder and decoder for one vocabulary; tokens[i] are the bytes of rank i."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.fits: dict[int, bool] = {}  # by left * number of tokens + right
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        self.sizes = list(map(len, tokens))
        self.names = list(map(str, range(len(tokens))))
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        #: The next shorter token that a token starts with, or -1.
        self.shorter = [next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t in tokens]
        #: The two tokens that merge into a token last, by id and by pair; one-byte tokens have none.
        self.halves: list[tuple[int, int] | None] = [None] * len(tokens)
        self.merged: dict[tuple[int, int], int] = {}
        for i, t in enumerate(tokens):
            left = self.shorter[i]
            while left >= 0:
                right = self.ids.get(t[len(tokens[left]) :], i)
                if left < i and right < i and self._stay_apart(left, right):
                    self.halves[i] = (left, right)
                    self.merged[left, right] = i
                    break
                left = self.shorter[left]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two.

        A merge across the border takes place if, at some stage of both sides, the tokens at the border form a pair
        that ranks before the next merge on either side. The stages are visited from last to first.
        """
        merged, halves = self.merged, self.halves
        bound = len(self.tokens) + 1  # merges across the border of a rank below it come first
        while True:
            if merged.get((left, right), bound) < bound:
                return False
            # undo the later one of the two merges that made the border's tokens; of equal ones the right is later
            if left > right:
                bound, parts = left, halves[left]
                if parts:
                    left = parts[1]
                    continue
                bound, parts = right + 1, halves[right]
                if not parts:
                    return True
                right = parts[0]
            else:
                bound, parts = right + 1, halves[right]
                if parts:
                    right = parts[0]
                    continue
                bound, parts = left, halves[left]
                if not parts:
                    return True
                left = parts[1]

    def compatible(self, left: int, right: int) -> bool:
        pair = left * len(self.tokens) + right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= 4 * CACHE:
                self.fits.clear()
            known = self.fits[pair] = self._stay_apart(left, right)
        return known

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ids.get(piece)
        if whole is not None:
            return (whole,)
        size, count = len(piece), len(self.tokens)
        if not size:
            return ()
        sizes, shorter, known = self.sizes, self.shorter, self.fits.get
        longest = [-1] * size  # id of the longest token at each position: matches come by their ends, so the last is the longest
        for end, (i, n) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - n + 1] = i
        dead: set[int] = set()  # positions from which the rest cannot be encoded after what may stand before them
        path: list[int] = []
        at, before, token = 0, -1, longest[0]
        while True:
            while token >= 0:
                end = at + sizes[token]
                if end not in dead:
                    if before < 0:
                        break
                    fits = known(before * count + token)
                    if self.compatible(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                if end == size:
                    return tuple(path)
                at, before, token = end, token, longest[end]
            else:
                dead.add(at)
                if not path:
                    raise ValueError("the vocabulary cannot spell these bytes")
                token = path.pop()
                at -= sizes[token]
                before = path[-1] if path else -1

    def _seek(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece that the cache has not; when the cache is full it becomes the older one, which frequent
        pieces come back from."""
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode_bytes(piece.encode())
        if len(piece) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE:
                self.older = dict(self.cache)
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, out = self.cache.get, []
        for piece in self.find(text):
            ids = known(piece)
            out += self._seek(piece) if ids is None else ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def spell(self, ids: Iterable[int]) -> str:
        """The ids in decimal, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec(tokens: list[bytes], pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    name = hashlib.sha256(b"\0".join([pattern.encode(), *tokens])).hexdigest()
    if name not in _codecs:
        _codecs[name] = Codec(tokens, pattern)
    return _codecs[name]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """docs (without the text, unless keep_text) with ids (array, unless keep_ids is false), n_tokens, ids_sha256 and
    decoded_sha256 of the ids decoded again."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # the ranks: a file of fixed size
    own = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    named = {f.name for f in own}
    kept = [f for f in docs.schema.fields if f.name.lower() not in named and (keep_text or f.name != text)]
    names, given = [f.name for f in kept], unused(docs, "_text")
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                c = c or codec(shared.value, pattern)
                batch = whole.slice(at, BATCH)
                ids_of, n, coded, decoded = [], [], [], []
                for t in batch.column(given):
                    ids = c.encode(t.as_py())
                    n.append(len(ids))
                    coded.append(hashlib.sha256(c.spell(ids).encode()).hexdigest())
                    decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
                    if keep_ids:
                        ids_of.append(pa.array(ids, pa.int32()))
                columns = [batch.column(x) for x in names]
                if keep_ids:
                    sizes = pa.array([0, *n], pa.int64())
                    offsets = pc.cumulative_sum(sizes).cast(pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(ids_of) if ids_of else pa.array([], pa.int32())))
                columns += [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names + [f.name for f in own])

    return map_arrow(source, run, T.StructType(kept + own))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the 50k ranks and decoded again."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False, keep_text=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
