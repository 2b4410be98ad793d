"""Byte-level BPE by dynamic programming over prefixes, and decoding.

The encoding of a word (a piece that the pre-tokenizer cuts) is found without replaying merges.  For every prefix
there is exactly one token that can end the encoding of that prefix.  Candidates are the vocabulary tokens that are
suffixes of the prefix; an automaton over the reversed vocabulary, read backwards from the prefix's end, lists them.
A candidate holds if it is compatible with the last token of the prefix that it leaves: the two, put side by side,
are not merged across their border.  Back-pointers from the whole word then give the ids.

Words repeat, so a worker encodes each once and keeps it, up to a fixed number of words.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import _common as C

VOCABULARY = "byte_bpe_50k.json"
#: Words kept in one worker before it starts anew: bounds its memory.
KEPT_WORDS = 600_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: visible Latin-1 stays, others follow from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.bytes_of = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, k in self.special.items():
            self.bytes_of[k] = content.encode()
        # Merging turns pair into token at rank; each token's halves are those of the merge that makes it first.
        self.rank, self.made, self.halves = {}, {}, {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, new = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = r
            self.made[pair] = new
            self.halves.setdefault(new, (*pair, r))
        # Automaton over reversed tokens: (state, byte) to state, and the token that ends in a state.
        self.step: dict[int, int] = {}
        self.ends: list[int] = [-1]
        reachable = set(self.halves) | {k for k in vocab.values() if len(self.bytes_of[k]) == 1}
        for k in sorted(reachable):
            s = 0
            for byte in reversed(self.bytes_of[k]):
                t = self.step.get(s << 8 | byte)
                if t is None:
                    t = self.step[s << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                s = t
            self.ends[s] = k
        self._fits: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens.

        Undo the merges inside both, latest first.  A merge across the border would have happened if, between the
        parts that touch there at that time, one exists of an earlier rank than the merge just undone.
        """
        known = self._fits.get((left, right))
        if known is not None:
            return known
        a, b, limit, tie_left, fits = left, right, len(self.rank), True, True
        while True:
            r = self.rank.get((a, b))
            if r is not None and (r < limit or r == limit and not tie_left):
                fits = False
                break
            ra = self.halves[a][2] if a in self.halves else -1
            rb = self.halves[b][2] if b in self.halves else -1
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # of equal merges the left one happens first, so the right one is undone first
                limit, tie_left, a = ra, True, self.halves[a][1]
            else:
                limit, tie_left, b = rb, False, self.halves[b][0]
        self._fits[(left, right)] = fits
        return fits

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-tokenizer piece: the last token of every prefix, then back-pointers."""
        n = len(word)
        last, step, ends, compatible, lengths = [-1] * (n + 1), self.step, self.ends, self.compatible, self.bytes_of
        for i in range(1, n + 1):
            s, j, matches = 0, i, []
            while j:
                s = step.get(s << 8 | word[j - 1])
                if s is None:
                    break
                j -= 1
                if ends[s] >= 0:
                    matches.append((j, ends[s]))
            for j, token in reversed(matches):
                if not j or (last[j] >= 0 and compatible(last[j], token)):
                    last[i] = token
                    break
        ids, i = [], n
        while i:
            ids.append(last[i])
            i -= len(lengths[last[i]])
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


# The pre-tokenizer's pattern: contractions; letters, numbers or others, each with one space before; white space,
# which leaves its last character to what follows.
_PATTERN = r" ?{letter}+|'(?:s|t|re|ve|m|ll|d)| ?{number}+| ?{other}+|\s+(?!\S)|\s+"


def _odd_characters() -> str:
    """A class of the characters that need the exact pattern: all beyond Latin, and those that the fast pattern's classes hold differently."""
    latin = "".join(map(chr, range(0x250)))
    odd = set()
    for fast, true in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")):
        odd |= {*re.findall(fast, latin)} ^ {*regex.findall(true, latin)}
    return "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(odd)) + "\\u0250-\\U0010ffff]"


class Encoder:
    """A Codec with the words that this worker has met."""

    def __init__(self, path: str):
        self.codec = Codec(path)
        self.fast = re.compile(_PATTERN.format(letter=r"[^\W\d_]", number=r"\d", other=r"(?:[^\s\w]|_)")).findall
        self.exact = regex.compile(_PATTERN.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]")).findall
        self.odd = re.compile(_odd_characters()).search
        self.special = re.compile("(" + "|".join(map(re.escape, self.codec.special)) + ")") if self.codec.special else None
        self.kept: dict[str, tuple[str, bytes]] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokenizer pieces and special tokens, in order; joined they are the text."""
        if self.special and any(x in text for x in self.codec.special):
            parts = self.special.split(text)
            return [w for k, x in enumerate(parts) for w in ([x] if k % 2 else self.pieces(x))]
        return self.exact(text) if self.odd(text) else self.fast(text)

    def learn(self, pieces: list[str]) -> None:
        """Encode the pieces not met so far; keep their ids as text, and the bytes that those ids decode to."""
        codec, kept = self.codec, self.kept
        if len(kept) >= KEPT_WORDS:
            kept.clear()
            codec._fits.clear()
        for w in [w for w in {*pieces} if w not in kept]:
            ids = [codec.special[w]] if w in codec.special else codec.encode_word(w.encode())
            kept[w] = ",".join(map(str, ids)), b"".join(map(codec.bytes_of.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        self.learn(pieces)
        return [int(x) for w in pieces for x in self.kept[w][0].split(",")]

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, and SHA-256 of what they decode to."""
        pieces = self.pieces(text)
        self.learn(pieces)
        got = [*map(self.kept.__getitem__, pieces)]
        ids = ",".join([x for x, _ in got])
        decoded = b"".join([x for _, x in got])
        try:
            decoded.decode()
        except UnicodeDecodeError:
            decoded = decoded.decode("utf-8", "replace").encode()
        return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file: made once, its words are shared by all of its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, text: str = "text", id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """Ids of every whole text (null or empty: none): id column, ids array<int>.  Repeated rows stay."""
    path = path or vocabulary_path()
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = [e.encode(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ids: str = "ids", id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """Texts of arrays of ids (null: empty text): id column, text."""
    path = path or vocabulary_path()
    C.small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path).codec
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[id_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, ids).mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trip(docs: DataFrame, text: str = "text", id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """Encode and decode every whole text in one pass; return the number of ids and digests of ids and decoded text.

    A null text is empty: no ids, digests of the empty text.  Repeated rows stay; other columns are not read.
    """
    path = path or vocabulary_path()
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            got = [e.digests(x.as_py() or "") for x in b.column(1)]
            n, ids, decoded = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op4_bpe": op4_bpe}
