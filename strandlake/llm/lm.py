"""Language-model scores by a weighted backoff automaton over the whole corpus.

The model is a smoothed trigram model as an automaton.  Its states are the root, the start of a text, every word and
every word pair that training texts hold.  Arcs read a word:

* a pair (u, v) has an arc for each w of a seen triple, to the pair (v, w);
* a word v, and the start, have an arc for each w of a seen pair, to that pair;
* the root has an arc for every word, to the word's state, or to itself if the word is unseen.

Where a state has no arc for a word, its failure arc is taken, which reads nothing: from a pair (u, v) to the word v,
from a word or the start to the root.  With c a training count, N all tokens and V distinct ones, arcs weigh log10 of

    p(w) = (c(w) + ADD) / (N + ADD (V + 1))                 from the root
    p(w | v) = (c(vw) + PAIR p(w)) / (c(v) + PAIR)          from a word or the start
    p(w | u v) = (c(uvw) + TRIPLE p(w | v)) / (c(uv) + TRIPLE)

and failure arcs log10 of PAIR / (c(v) + PAIR) and TRIPLE / (c(uv) + TRIPLE), so the probabilities after every state sum
to one.  One left-to-right traversal of a text carries the state and adds the weights of the arcs that it takes.

The automaton of a large corpus fits no machine.  Documents are scored in blocks, written once, and each block gets
the part of the automaton that its own words can reach:

1. each block sends its distinct keys (words, pairs and triples, as fingerprints) with their training counts, as
   sorted difference-coded arrays, to shards by key range;
2. each shard sums the counts of its keys and replies to every block in the order in which it asked;
3. each block meets its replies, builds states and arcs and traverses its texts.

A block or shard holds a bounded number of keys whatever the corpus's size; the frequent keys of natural text occur
once in a block, so no shard is hot.  A block sends to a shard only if it has keys there: there are never more messages
than keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Tokens of a block of documents, and characters of the corpus to a shard of keys.
BLOCK_TOKENS, SHARD_CHARS = 500_000, 4_000_000
#: Shards or blocks of one task.
PER_TASK = 3
#: Bits of a fingerprint beyond those that number the corpus's characters: one look-up in a million meets a wrong key.
SPARE_BITS = 20
#: Pseudo-counts of the backoff distribution in the states of words and of pairs; additive smoothing of single words.
PAIR, TRIPLE, ADD = 30.0, 10.0, 0.1
#: Runs of tokens that are traversed side by side.
LANES = 1024

_U = np.uint64
_END = _U(0xE5D0F7E5D0F7E5D1)
_START = _U(0x57A2757A2757A275)
_A, _B = _U(0xC2B2AE3D27D4EB4F), _U(0x9E3779B97F4A7C15)
#: The two lowest bits of a key tell its kind; one key of its own counts texts, the visits of the start.
_WORD, _PAIR, _TRIPLE, _START_KIND = (_U(k) for k in (1, 0, 2, 3))
_KIND = _U(3)


def key_bits(chars: int) -> int:
    """Bits of a fingerprint for a corpus of so many characters."""
    return min(63, max(40, chars.bit_length() + SPARE_BITS))


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, without planes that are all zero."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    width, out = data[0], np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, n).T
    return out.reshape(-1).view("<u8")


class Block:
    """Tokens of some documents, their distinct keys in order, and where each token's keys stand among them."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, held: np.ndarray, bits: int = 60):
        """tokens: word fingerprints, each document's end included; lengths: tokens of each document; bits of a key."""
        low = _U((1 << bits) - 1)
        n, begins = len(tokens), np.cumsum(lengths) - lengths
        self.first = np.zeros(n, bool)
        self.first[begins] = True
        later = np.flatnonzero(~self.first)
        previous = np.full(n, _START, _U)
        previous[later] = tokens[later - 1]
        kind = lambda x, k: (x & low & ~_KIND) | k
        pairs = C.mix(previous * _A + tokens * _B)
        triples = C.mix(pairs[later - 1] * _A + tokens[later] * _B)
        self.keys, back = np.unique(np.concatenate([kind(tokens, _WORD), kind(pairs, _PAIR), kind(triples, _TRIPLE), [kind(_START, _START_KIND)]]), return_inverse=True)
        # Places of each token's word, pair and, but for first tokens, triple; of the pair before, for triples.
        self.word, self.pair, self.triple, self.texts = back[:n], back[n : 2 * n], back[2 * n : -1], back[-1]
        self.later, self.lengths, self.held = later, lengths, held

    def training_counts(self) -> np.ndarray:
        learn = np.repeat(~self.held, self.lengths)
        count = lambda x: np.bincount(x, minlength=len(self.keys))
        counts = count(self.word[learn]) + count(self.pair[learn]) + count(self.triple[learn[self.later]])
        counts[self.texts] += int((~self.held).sum())
        return counts

    def scores(self, counts: np.ndarray, total: int, kinds: int) -> dict[str, np.ndarray]:
        """Per document, from the counts of all keys: known tokens, base score and the automaton's score."""
        machine = Automaton(self, counts, total, kinds)
        begins = np.cumsum(self.lengths) - self.lengths
        add = lambda x: np.add.reduceat(x, begins) if len(begins) else np.zeros(0)
        return {"n_known": add((counts[self.word] > 0).astype(np.int64)), "base_score": add(machine.root_weight[machine.label]), "score": add(machine.traverse(self.first))}


class Automaton:
    """States, arcs and failure arcs that the words of a block can reach.

    State 0 is the root, 1 the start, then come the block's words and its seen pairs.  An arc is found by its state and
    word in one sorted table; the root's arcs are indexed by word.
    """

    def __init__(self, b: Block, counts: np.ndarray, total: int, kinds: int):
        kind = b.keys & _KIND
        word_of = np.cumsum(kind == _WORD) - 1
        self.words = v = int((kind == _WORD).sum())
        self.label = word_of[b.word]
        seen = counts[kind == _WORD]
        p1 = (seen + ADD) / (total + ADD * (kinds + 1))
        self.root_weight = np.log10(p1)
        self.root_to = np.where(seen > 0, 2 + np.arange(v), 0)
        # Seen pairs: the state before, the word read, and the state that reading it leads to.
        pair_key = np.flatnonzero((kind == _PAIR) & (counts > 0))
        state_of_pair = np.zeros(len(b.keys), np.int64)
        state_of_pair[pair_key] = 2 + v + np.arange(len(pair_key))
        before, read = np.zeros(len(b.keys), np.int64), np.zeros(len(b.keys), np.int64)
        before[b.pair[b.first]] = 1
        before[b.pair[b.later]] = 2 + self.label[b.later - 1]
        read[b.pair] = self.label
        context = np.concatenate([[0, counts[b.texts]], seen])  # visits of the root, unused, the start and words
        p2 = np.zeros(len(b.keys))
        p2[b.pair] = (counts[b.pair] + PAIR * p1[self.label]) / (context[before[b.pair]] + PAIR)
        # Seen triples, once each: of any token that holds one.
        triple_key, at = np.unique(b.triple, return_index=True)
        at = b.later[at[counts[triple_key] > 0]]
        triple_key = triple_key[counts[triple_key] > 0]
        pair_before, pair_here = b.pair[at - 1], b.pair[at]
        p3 = (counts[triple_key] + TRIPLE * p2[pair_here]) / (counts[pair_before] + TRIPLE)
        arcs = np.concatenate([before[pair_key] * v + read[pair_key], state_of_pair[pair_before] * v + self.label[at]])
        order = np.argsort(arcs)
        self.arcs = arcs[order]
        self.weight = np.log10(np.concatenate([p2[pair_key], p3]))[order]
        self.to = np.concatenate([state_of_pair[pair_key], state_of_pair[pair_here]])[order]
        self.fail_to = np.concatenate([np.zeros(2 + v, np.int64), 2 + read[pair_key]])
        self.fail_weight = np.concatenate([np.log10(PAIR / (context + PAIR)), np.log10(TRIPLE / (counts[pair_key] + TRIPLE))])

    def traverse(self, first: np.ndarray) -> np.ndarray:
        """The weight that each token adds; first marks the first token of a text, before which the state is the start.

        Many runs of tokens are traversed side by side.  A run begins two tokens early at the root, which is enough to
        be in the right state at its own first token.
        """
        n = len(first)
        out, size = np.zeros(n), -(-n // LANES)
        begins = np.arange(0, n, max(1, size))
        ends = np.minimum(begins + size, n)
        state = np.zeros(len(begins), np.int64)
        for t in range(-2, size):
            at = begins + t
            on = (at >= 0) & (at < ends)
            lanes, at = np.flatnonzero(on), at[on]
            now = np.where(first[at], 1, state[lanes])
            weight, label = np.zeros(len(at)), self.label[at]
            todo = np.arange(len(at))
            while len(todo):
                root = now[todo] == 0
                done = todo[root]
                weight[done] += self.root_weight[label[done]]
                now[done] = self.root_to[label[done]]
                todo = todo[~root]
                key = now[todo] * self.words + label[todo]
                arc = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
                hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(todo), bool)
                weight[todo[hit]] += self.weight[arc[hit]]
                now[todo[hit]] = self.to[arc[hit]]
                todo = todo[~hit]
                weight[todo] += self.fail_weight[now[todo]]
                now[todo] = self.fail_to[now[todo]]
            state[lanes] = now
            if t >= 0:
                out[at] = weight
        return out


def _tokens(words: C.Words) -> tuple[np.ndarray, np.ndarray]:
    n = len(words.counts)
    tokens = np.full(len(words.hashes) + n, _END, _U)
    tokens[np.arange(len(words.hashes)) + words.doc] = words.hashes
    return tokens, words.counts + 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, ids, held, tokens, lengths) of this task's documents: columns doc_id, held_out, text."""
    from pyspark import TaskContext

    block, parts, size = TaskContext.get().partitionId() << 24, [], 0
    for b in batches:
        ids, held = b.column(0), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, to, data, offsets in C.chunks(b.column(2)):
            parts.append((ids.slice(a, to - a), held[a:to], *_tokens(C.Words(data, offsets, fold_case=True))))
            size += len(parts[-1][2])
            if size >= BLOCK_TOKENS:
                yield block, *_joined(parts)
                block, parts, size = block + 1, [], 0
    if parts:
        yield block, *_joined(parts)


def _joined(parts: list[tuple]) -> tuple:
    return pa.concat_arrays([p[0] for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))


def _shard_of(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    return ((keys >> _U(bits - 32)) * _U(shards) >> _U(32)).astype(np.int64)


BLOCK_SCHEMA = "block long, texts long, size long, words long, ids binary, nulls binary, held binary, lengths binary, vocabulary binary, tokens binary"


def blocks(rows: DataFrame) -> DataFrame:
    """BLOCK_SCHEMA: the documents (doc_id, held_out, text) of every block as packed arrays, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, own, tokens, lengths in _blocks(batches):
            vocabulary, back = np.unique(tokens, return_inverse=True)
            out = [[block], [len(ids)], [len(tokens)], [len(vocabulary)], [ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], [np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()], [np.packbits(own).tobytes()], [pack(lengths)], [pack(np.diff(vocabulary, prepend=_U(0)))], [pack(back)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 4 else pa.binary()) for k, x in enumerate(out)], names=["block", "texts", "size", "words", "ids", "nulls", "held", "lengths", "vocabulary", "tokens"])

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _block_of(r: dict | pd.Series, bits: int) -> Block:
    vocabulary = np.cumsum(unpack(r["vocabulary"], r["words"]), dtype=_U)
    own = np.unpackbits(np.frombuffer(r["held"], np.uint8), count=r["texts"]).astype(bool)
    return Block(vocabulary[unpack(r["tokens"], r["size"]).astype(np.int64)], unpack(r["lengths"], r["texts"]).astype(np.int64), own, bits)


def ask(written: DataFrame, shards: int, bits: int) -> DataFrame:
    """(block, shard, n, keys, counts): what every block asks of every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                b = _block_of(r, bits)
                counts = b.training_counts()
                cuts = np.searchsorted(_shard_of(b.keys, shards, bits), np.arange(shards + 1))
                out = [(s, int(z - a), pack(np.diff(b.keys[a:z], prepend=_U(0))), pack(counts[a:z])) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
                shard, n, keys, own = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(out), pa.int64()), pa.array(shard, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(own, pa.binary())], names=["block", "shard", "n", "keys", "counts"])

    needed = written.select("block", "texts", "size", "words", "held", "lengths", "vocabulary", "tokens")
    return needed.mapInArrow(run, "block long, shard long, n long, keys binary, counts binary")


def reply(asked: DataFrame) -> DataFrame:
    """(block, shard, n, counts, tokens, kinds): total counts in the order asked.

    tokens and kinds, on one row of each shard, are its sums of counts and numbers of words with a count.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        sizes = pdf["n"].to_numpy()
        keys = np.concatenate([np.cumsum(unpack(k, n), dtype=_U) for k, n in zip(pdf["keys"], sizes, strict=True)])
        counts = np.concatenate([unpack(c, n) for c, n in zip(pdf["counts"], sizes, strict=True)]).astype(np.int64)
        own, back = np.unique(keys, return_inverse=True)
        total = np.bincount(back, counts, len(own)).astype(np.int64)
        word = (own & _KIND) == _WORD
        stops = np.cumsum(sizes)
        out = pdf[["block", "shard", "n"]].copy()
        out["counts"] = [pack(total[back[a:z]]) for a, z in zip(stops - sizes, stops, strict=True)]
        out["tokens"] = [int(total[word].sum())] + [0] * (len(out) - 1)
        out["kinds"] = [int((total[word] > 0).sum())] + [0] * (len(out) - 1)
        return out

    return asked.groupBy("shard").applyInPandas(run, "block long, shard long, n long, counts binary, tokens long, kinds long")


def score(docs: DataFrame, text: str = "text", id_column: str = "doc_id", held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows where held_out is false; by default it is true where crc32 of the id is divisible by 10,
    and of null ids.  Words are folded to lower case in A-Z; every text, a null one too, has an end as last token.
    Without training rows every count is 0 and all words are equally likely.  Blocks are written before they are used
    twice, so docs may come from any plan.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    held = F.coalesce(C.remainder(id_column, 10) == 0, F.lit(True)) if held_out is None else held_out
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    written = C.materialize(blocks(rows), "lm-blocks", "zstd")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards, bits = max(1, math.ceil(chars / SHARD_CHARS)), key_bits(chars)
    # The questions are the largest of what is shuffled: they go before the replies are shuffled.
    with C.batch_rows(spark, 1), C.shuffles_dropped(spark):
        asked = ask(written, shards, bits).repartition(math.ceil(shards / PER_TASK), "shard")
        replies = C.materialize(reply(asked), "lm-counts", "zstd")
    total, kinds = (x or 0 for x in replies.agg(F.sum("tokens"), F.sum("kinds")).first())

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("shard")
        counts = np.concatenate([unpack(c, n) for c, n in zip(right["counts"], right["n"], strict=True)]).astype(np.int64)
        r = left.iloc[0]
        b = _block_of(r, bits)
        got = b.scores(counts, total, kinds)
        ids = pd.Series(np.frombuffer(r["ids"], np.int64)).astype("Int64")
        ids[np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=r["texts"]).astype(bool)] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": b.held, "n_tokens": b.lengths, **got})

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    # Tasks in proportion to the blocks, whatever the session's number of shuffle partitions.
    tasks = max(1, math.ceil(written.count() / PER_TASK))
    answers = replies.select("block", "shard", "n", "counts").repartition(tasks, "block")
    scored = written.repartition(tasks, "block").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(meet, kind)
    return scored.withColumn("train_tokens", F.lit(total).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op10_lm_score": op10_lm_score}
