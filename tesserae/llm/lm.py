"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model over words. Its states are the contexts seen in training; an arc from a
state over a word that followed it there has the smoothed log-probability and leads to the longest
context that is then a state; a failure arc leads to the context without its first word, at the cost
of the state's backoff weight. A text is read once from left to right: the state is carried from
word to word, failure arcs are followed until a state has an arc over the word, and the weights are
added up. At the root, absolute discounting (the discount estimated from how many words were seen
once and twice) leaves the mass of one unknown word; above it, a context seen c times gives its
lower order the weight mu / (c + mu), so that every state's probabilities sum to one.

The model is never in one place. A task cuts its rows into blocks of bounded size. A block asks for
the training counts of its distinct n-grams, by shards of hashed n-grams; each shard adds up what
all blocks counted and answers every block; the block then builds the states and arcs that its own
texts can reach, and reads them. A frequent n-gram costs one entry for each block, and no key
gathers rows of texts, however often a text is repeated. Shards hold hashes: 64 bits for words, 48
bits beside the shard for longer n-grams.

Blocks are cut twice, first to ask and then to score, and must hold the same rows in the same order,
as those of a table's files do (`stable=True`); other inputs are written down first. A block whose
n-grams are not those it asked for fails the job.

Nulls: a null text is empty: one end token. A null id counts as the empty text, so it is held out.
Repeated rows count as often as they stand there, and get a row each. Without training rows each
probability is that of the unknown word, one. Texts are scored whole.
"""

from __future__ import annotations

import math
import zlib
from array import array
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import hash_words, materialise, mix, small_batches, split_words

START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


@dataclass(frozen=True)
class Settings:
    order: int = 3
    #: Of contexts of one word, two words, ...: what fit_mu() takes of 10 to 400 by 0.5 to 40, for the held-out tenth of sf0.01.
    mu: tuple = (400.0, 0.5)
    block_bytes: int = 6 << 20  # of text in a block; more where a corpus has very many blocks
    blocks_a_shard: int = 2
    folds: int = 10
    base_add: float = 0.1


def sequences(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The block's tokens with a start before and an end after each text, and each text's offsets."""
    offsets, flat = split_words(table.column("text"), lower=True)
    words = hash_words(flat)
    n = table.num_rows
    ends = offsets[1:] + 2 * np.arange(1, n + 1)
    starts = np.concatenate([[0], ends])
    out = np.empty(len(words) + 2 * n, np.uint64)
    mask = np.ones(len(out), bool)
    mask[starts[:-1]] = mask[ends - 1] = False
    out[starts[:-1]], out[ends - 1] = START, END
    out[mask] = words
    return out, starts


def grams(tokens: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the last tokens of the k-grams inside texts (a start token is only ever context), and their hashes."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # inside a text, and not at its start: that many places after the text's beginning
    fine = np.ones(len(tokens), bool)
    for j in range(max(1, k - 1)):
        at = starts[:-1] + j
        fine[at[at < starts[1:]]] = False
    last = np.flatnonzero(fine)
    last = last[last >= k - 1]
    h = tokens[last - (k - 1)]
    for j in range(1, k):
        h = mix(h) + tokens[last - (k - 1) + j]
    return last, mix(h + np.uint64(k))


def training(ids: list, folds: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds != 0 for i in ids], bool)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def pack_keys(keys: np.ndarray, k: int) -> bytes:
    raw = keys.astype("<u8")
    return raw.tobytes() if k == 1 else raw.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_keys(blob: bytes, k: int) -> np.ndarray:
    if k == 1:
        return np.frombuffer(blob, "<u8")
    six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def pack_counts(values: np.ndarray) -> tuple[bytes, bytes]:
    high = values >= 255
    return np.where(high, 255, values).astype(np.uint8).tobytes(), values[high].astype("<u8").tobytes()


def unpack_counts(low: bytes, high: bytes) -> np.ndarray:
    out = np.frombuffer(low, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(high, "<u8").astype(np.int64)
    return out


def distinct(tokens, starts, k):
    """Positions, the block's distinct keys in shard order, and which of them stands at each position."""
    last, keys = grams(tokens, starts, k)
    known, which = np.unique(keys, return_inverse=True)
    return last, known, which


ASK = "block string, shard long, k int, keys binary, low binary, high binary"
ANSWER = "block string, shard long, k int, low binary, high binary, types long, tokens long, once long, twice long, docs long"


def ask(block: str, table: pa.Table | pa.RecordBatch, settings: Settings, shards: int) -> pa.Table:
    tokens, starts = sequences(table)
    train = training(table.column("doc_id").to_pylist(), settings.folds)
    inside = np.repeat(train, np.diff(starts))
    rows, check = [], 0
    for k in range(1, settings.order + 1):
        last, known, which = distinct(tokens, starts, k)
        check = (check + int(known.sum(dtype=np.uint64)) * (2 * k + 1)) % (1 << 64)
        counts = np.bincount(which[inside[last]], minlength=len(known))
        owner = shard_of(known, shards)
        cuts = np.searchsorted(owner, np.arange(shards + 1))
        rows += [(block, s, k, pack_keys(known[a:b], k), *pack_counts(counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
    rows.append((block, 0, 0, check.to_bytes(8, "little"), *pack_counts(np.array([train.sum()]))))  # k = 0: documents in training, and a digest of what was asked
    return as_table(rows, ["block", "shard", "k", "keys", "low", "high"], [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])


def as_table(rows: list, names: list, types: list) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def answer(table: pa.Table) -> pa.Table:
    """Add up a shard's counts over all blocks; for each block, the sums of the keys it asked for."""
    blocks, ks = table.column("block").to_pylist(), np.array(table.column("k").to_pylist())
    shard = table.column("shard")[0].as_py()
    rows = []
    for k in np.unique(ks).tolist():
        at = np.flatnonzero(ks == k)
        part = table.take(pa.array(at))
        counts = [unpack_counts(a, b) for a, b in zip(part.column("low").to_pylist(), part.column("high").to_pylist(), strict=True)]
        if k == 0:
            rows.append((None, shard, 0, b"", b"", 0, 0, 0, 0, int(sum(c.sum() for c in counts))))
            rows += [(blocks[i], shard, 0, check, b"", 0, 0, 0, 0, 0) for i, check in zip(at.tolist(), part.column("keys").to_pylist(), strict=True)]
            continue
        keys = [unpack_keys(x, k) for x in part.column("keys").to_pylist()]
        sizes = np.cumsum([len(x) for x in keys])[:-1]
        known, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(which, weights=np.concatenate(counts), minlength=len(known)).astype(np.int64)
        if k == 1:
            rows.append((None, shard, 1, b"", b"", int((sums > 0).sum()), int(sums.sum()), int((sums == 1).sum()), int((sums == 2).sum()), 0))
        for i, mine in zip(at.tolist(), np.split(which, sizes), strict=True):
            rows.append((blocks[i], shard, k, *pack_counts(sums[mine]), 0, 0, 0, 0, 0))
    return as_table(rows, ["block", "shard", "k", "low", "high", "types", "tokens", "once", "twice", "docs"], [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()] + [pa.int64()] * 5)


@dataclass(frozen=True)
class Totals:
    tokens: int
    types: int
    once: int
    twice: int
    docs: int

    @property
    def discount(self) -> float:
        """Ney's estimate of the absolute discount; a half where no word was seen once, or none twice."""
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5


class Automaton:
    """The states and arcs that one block's texts can reach, as arrays.

    State 0 is the root, state 1 the beginning of a text, and each n-gram shorter than the order that
    was seen in training is one more. `grams[k - 1]` are (last, which, counts) of the block's k-grams:
    where they end, which distinct one that is, and how often training has it.
    """

    def __init__(self, size: int, starts: np.ndarray, grams: list, totals: Totals, settings: Settings) -> None:
        n, t = settings.order, totals
        #: for each order: at each place, the weight of the arc over its word (NaN: no arc), and the state it leads to
        self.arc = np.full((n, size), np.nan)
        self.to = np.zeros((n, size), np.int32)
        fail, fail_weight, depth = [np.array([0, 0])], [np.array([0.0, self.backoff(t.docs, settings.mu[0]) if n > 1 else 0.0])], [np.array([0, 1])]
        self.unknown = math.log10(t.discount * t.types / t.tokens) if t.tokens else 0.0
        states = 2
        self.begin = 1 if t.docs and n > 1 else 0
        state_at = np.zeros(size, np.int64)  # of the (k - 1)-gram that ends at a place
        count_at = np.full(size, t.tokens)
        below = np.full(size, 10.0**self.unknown)  # probability of a place's word in the context of k - 2 words
        for k, (last, which, counts) in enumerate(grams, 1):
            seen = counts[which] > 0
            at, c = last[seen], counts[which][seen].astype(float)
            if k == 1:
                p = (c - t.discount) / t.tokens if t.tokens else np.ones(len(at))
            else:
                before, mu = count_at[at - 1].astype(float), settings.mu[k - 2]
                p = (c + mu * below[at]) / (before + mu)
            below[at] = p
            self.arc[k - 1, at] = np.log10(p)
            if k == n:
                self.to[k - 1, at] = state_at[at]
                continue
            # each distinct k-gram of training is a state; its failure arc goes to where its last k - 1 words are one
            first = np.full(len(counts), -1, np.int64)
            first[which[seen][::-1]] = at[::-1]
            is_state = counts > 0
            number = np.where(is_state, states - 1 + np.cumsum(is_state), 0)
            fail.append(state_at[first[is_state]])
            fail_weight.append(self.backoff(counts[is_state], settings.mu[k - 1]))
            depth.append(np.full(int(is_state.sum()), k))
            states += int(is_state.sum())
            own, own_count = np.zeros(size, np.int64), np.zeros(size, np.int64)
            own[at], own_count[at] = number[which][seen], counts[which][seen]
            if k == 1:
                own[starts[:-1]], own_count[starts[:-1]] = self.begin, t.docs
            self.to[k - 1, at] = own[at]
            state_at, count_at = own, own_count
        # as flat arrays that give plain numbers: lists of number objects take several times the memory
        self.fail, self.fail_weight = array("q", np.concatenate(fail).astype(np.int64).tobytes()), array("d", np.concatenate(fail_weight).astype(float).tobytes())
        self.depth = np.concatenate(depth).astype(np.uint8).tobytes()

    @staticmethod
    def backoff(count, mu: float):
        """Log weight that a context seen so often gives to its lower order."""
        return np.log10(mu / (np.asarray(count, float) + mu))

    def read(self, first: int, end: int) -> float:
        """The log10 weight of the text at places [first, end): one pass that carries the state."""
        fail, fail_weight, depth, unknown, n = self.fail, self.fail_weight, self.depth, self.unknown, len(self.arc)
        state, total = self.begin, 0.0
        # some thousands of places at a time as plain numbers, in one list: a list for each place takes longer than its arcs
        for at in range(first, end, 1 << 13):
            upto = min(end, at + (1 << 13))
            arcs, dests = self.arc[:, at:upto].T.ravel().tolist(), self.to[:, at:upto].T.ravel().tolist()
            for place in range(0, len(arcs), n):
                d = depth[state]
                w = arcs[place + d]
                while w != w:  # no arc here
                    if not d:
                        total += unknown
                        break
                    total += fail_weight[state]
                    state = fail[state]
                    d = depth[state]
                    w = arcs[place + d]
                else:
                    total += w
                    state = dests[place + d]
        return total


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score_block(docs: pa.Table, answers: pa.Table, totals: Totals, settings: Settings) -> pa.Table:
    types = [docs.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    if not docs.num_rows:
        return as_table([], NAMES, types)
    order = docs.column("place").to_numpy().argsort()
    docs = docs.take(pa.array(order))
    tokens, starts = sequences(docs)
    got = sorted(zip(answers.column("k").to_pylist(), answers.column("shard").to_pylist(), range(answers.num_rows), strict=True))
    low, high = answers.column("low").to_pylist(), answers.column("high").to_pylist()
    found, check = [], 0
    for k in range(1, settings.order + 1):
        last, known, which = distinct(tokens, starts, k)
        check = (check + int(known.sum(dtype=np.uint64)) * (2 * k + 1)) % (1 << 64)
        counts = np.concatenate([np.zeros(0, np.int64), *[unpack_counts(low[i], high[i]) for kk, _, i in got if kk == k]])
        if len(counts) != len(known):
            break
        found.append((last, which, counts))
    if len(found) < settings.order or [low[i] for k, _, i in got if k == 0] != [check.to_bytes(8, "little")]:
        raise RuntimeError("a block asked for other n-grams than its texts hold: write the rows down first (stable=False)")
    last, which, counts = found[0]
    n, doc, c = docs.num_rows, np.repeat(np.arange(docs.num_rows), np.diff(starts))[last], counts[which]
    a = Automaton(len(tokens), starts, found, totals, settings)
    del found, which, counts, low, high, got, tokens
    base = np.bincount(doc, weights=np.log10((c + settings.base_add) / (totals.tokens + settings.base_add * (totals.types + 1))), minlength=n)
    score = [a.read(i + 1, j) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    held = ~training(docs.column("doc_id").to_pylist(), settings.folds)
    return pa.table([docs.column("doc_id"), pa.array(held), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[c > 0], minlength=n)), pa.array(np.full(n, totals.tokens)), pa.array(base), pa.array(score, pa.float64())], names=NAMES)


def blocks(batches, most: int):
    """(name, rows) for each block of a task's rows: consecutive rows of `most` bytes of text, one longer text alone."""
    from pyspark import TaskContext

    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in small_batches(batches, "text", most):
        own = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + own > most:
            yield f"{part}.{number}", pa.Table.from_batches(held)
            number, held, size = number + 1, [], 0
        held.append(batch)
        size += own
    if held:
        yield f"{part}.{number}", pa.Table.from_batches(held)


def score(docs: DataFrame, settings: Settings | None = None, stable: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text).

    stable: docs gives the same rows in the same order in each of its partitions whenever it is read.
    """
    s = settings or Settings()
    docs = docs.select("doc_id", "text")
    if not stable:
        docs = materialise(docs, "lm_rows")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # at a terabyte of text and more, larger blocks: a row holds what one block asks of one shard
    most = min(8 * s.block_bytes, int(s.block_bytes * max(1.0, (size / (1 << 40)) ** 0.5)))
    shards = max(1, math.ceil(size / most / s.blocks_a_shard))

    def asking(batches):
        for name, rows in blocks(batches, most):
            yield from ask(name, rows, s, shards).to_batches()

    def dealing(batches):
        for name, rows in blocks(batches, most):
            named = rows.append_column("block", pa.array([name] * rows.num_rows, pa.string())).append_column("place", pa.array(np.arange(rows.num_rows)))
            yield from named.to_batches()

    answers = materialise(docs.mapInArrow(asking, ASK).groupBy("shard").applyInArrow(answer, ANSWER), "lm_answers")
    t = answers.where("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once", "twice", "docs")]).first()
    totals = Totals(**t.asDict())
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, k) for n, k in zip(NAMES[1:], (T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()), strict=True)]])
    told = answers.where("block is not null").select("block", "shard", "k", "low", "high")
    dealt = docs.mapInArrow(dealing, T.StructType([*docs.schema.fields, T.StructField("block", T.StringType()), T.StructField("place", T.LongType())]))
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: score_block(a, b, totals, s), schema)


def fit_mu(docs: DataFrame, candidates: list[tuple], settings: Settings | None = None) -> tuple:
    """Of the candidates for `mu`, the one under which the held-out texts are likeliest. Candidates are few: each is a run."""
    s = settings or Settings()
    total = lambda mu: score(docs, replace(s, mu=mu)).where("held_out").agg(F.sum("score")).first()[0] or 0.0
    return max(candidates, key=total)
