"""Packing documents into sequences by cutting-stock column generation.

Each document's ids are cut into whole sequences, a rest shorter than one whose length is a multiple
of the granule, and a tail shorter than the granule. The histogram of the rests' lengths (at most
length / granule classes, whatever the corpus) is the demand of a cutting stock problem: a linear
program over patterns, solved by the simplex method; knapsack dynamic programming prices new
columns. Patterns are rounded down, and rests, ranked within their length, take the patterns'
places. Tails, and the rests that rounding or a pattern with too much padding leaves over, are laid
end to end and cut at the sequence length; the last sequences have lengths that are powers of two.
With single ids as the granule the program has a thousand classes, and the simplex method was still a
quarter above the optimum after 4,000 columns; with 16 it ends there after some hundred. What is
packed are the ids themselves, in every piece.

Nulls: a null text is empty: its ids are the end id alone. Repeated rows are packed each. Very long
texts are encoded whole, piece by piece. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import buckets_for, materialise, running_total, small_batches

# --- ids -----------------------------------------------------------------------------------------

#: Plain characters, for which both libraries split texts into the same words.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]")
#: The published pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Ids:
    """Ids of the `tokenizers` file at `path`.

    Texts of plain characters go through the faster library over the same ranks, which gives equal
    ids; other texts, and texts with a special token's string, go through `tokenizers` itself.
    """

    def __init__(self, path: str, ranks_path: str | None) -> None:
        import json

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        if self.fast and not PLAIN.search(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def packed(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit, as they are carried from step to step."""
    return ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4").tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")


CUT = "doc_id {id}, doc_tokens long, whole int, full binary, rest int, tail int, ids binary"


def cut(docs: DataFrame, path: str, ranks_path: str | None, length: int, end_id: int, granule: int) -> DataFrame:
    """Each document's ids: `full` has those of `whole` sequences, `ids` those of the rest and the tail."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = Ids(path, ranks_path)
        for batch in small_batches(batches, "text", 2 << 20):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = np.append(encode.of(text or ""), np.uint32(end_id))
                whole, left = divmod(len(ids), length)
                tail = left % granule
                rows.append((len(ids), whole, packed(ids[: whole * length]), left - tail, tail, packed(ids[whole * length :])))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "doc_tokens", "whole", "full", "rest", "tail", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, CUT.format(id=kind))


# --- the linear program ----------------------------------------------------------------------------


def best_pattern(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack with repetition: the pattern of greatest value, as copies of each length."""
    worth = np.zeros(capacity + 1)
    worth[lengths] = np.maximum(values, 0)
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = worth[1 : c + 1] + best[c - 1 :: -1][:c]
        i = int(options.argmax())
        best[c], take[c] = options[i], i + 1
    index = np.full(capacity + 1, -1)
    index[lengths] = np.arange(len(lengths))
    copies, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if worth[take[c]] > 0:
            copies[index[take[c]]] += 1
        c -= take[c]
    return float(best[capacity]), copies


@dataclass
class Solution:
    lengths: np.ndarray
    patterns: np.ndarray  # a column for each pattern
    times: np.ndarray
    bound: float
    rounds: int = field(default=0)


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.0005, most_rounds: int = 4000) -> Solution:
    """Fewest (fractional) patterns that meet the demand exactly; stops within `gap` of the dual bound.

    Any basis on the way is a valid answer, so stopping early costs sequences, never documents.
    """
    m = len(lengths)
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    bound, rounds = 0.0, 0
    while rounds < most_rounds:
        duals = inverse.sum(axis=0)
        value, column = best_pattern(lengths, duals, capacity)
        bound = max(bound, float(x.sum()) / max(value, 1e-12))
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            break
        direction = inverse @ column
        up = direction > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / direction[up]
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        basis[:, out] = column
        rounds += 1
        if rounds % 500 == 0:  # rounding errors gather in the inverse
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
    return Solution(lengths, basis, x, bound, rounds)


@dataclass
class Places:
    """For each length, its places: from rank `start` on, in which sequence and where."""

    start: dict[int, np.ndarray]
    copies: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    total: dict[int, int]
    sequences: int

    def of(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence (-1: none is left) and offset of ranked rests of one length."""
        if length not in self.total:
            return np.full(len(rank), -1), np.zeros(len(rank), np.int64)
        p = np.clip(np.searchsorted(self.start[length], rank, "right") - 1, 0, None)
        j = rank - self.start[length][p]
        sequence = self.sequence[length][p] + j // self.copies[length][p]
        offset = self.offset[length][p] + j % self.copies[length][p] * length
        return np.where(rank < self.total[length], sequence, -1), offset


def places(solution: Solution, demand: np.ndarray, capacity: int, most_padding: int) -> Places:
    """Round patterns down and hand out their places; a pattern that pads more than most_padding is left to the stream."""
    out = Places({}, {}, {}, {}, {}, 0)
    found: dict[int, list] = {}
    given = dict.fromkeys(solution.lengths.tolist(), 0)
    left = dict(zip(solution.lengths.tolist(), demand.tolist(), strict=True))
    for p in range(solution.patterns.shape[1]):
        column = solution.patterns[:, p].round().astype(np.int64)
        used = np.flatnonzero(column)
        items = [(int(solution.lengths[i]), int(column[i])) for i in used]
        if not items or sum(a * b for a, b in items) < capacity - most_padding:
            continue
        times = min([int(solution.times[p] + 1e-6), *[(left[n] - given[n]) // k for n, k in items]])
        if times <= 0:
            continue
        at = 0
        for n, k in items:
            found.setdefault(n, []).append((given[n], k, out.sequences, at))
            given[n] += k * times
            at += n * k
        out.sequences += times
    for n, rows in found.items():
        out.start[n], out.copies[n], out.sequence[n], out.offset[n] = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        out.total[n] = given[n]
    return out


# --- the operator ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    length: int = 1024
    end_id: int = 0
    most_padding: int = 0
    gap: float = 0.0005
    granule: int = 16


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


PIECES = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, ranks_path: str | None = None, settings: Settings | None = None) -> DataFrame:
    """A row for each piece of docs(doc_id, text): doc_id, start (its document's ids before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (in the sequence)."""
    s = settings or Settings()
    if s.length & (s.length - 1) or s.length % s.granule:
        raise ValueError("the sequence length must be a power of two, and a multiple of the granule")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # rows are told apart, and dealt, by a number that being written fixes: equal rows stand apart
    done = materialise(cut(docs, path, ranks_path, s.length, s.end_id, s.granule).withColumn("_row", F.monotonically_increasing_id()), "pack_cut")
    histogram = {r[0]: r[1] for r in done.where("rest > 0").groupBy("rest").count().collect()}  # length / granule rows at most
    wholes, rows = done.agg(F.coalesce(F.sum("whole"), F.lit(0)), F.count(F.lit(1))).first()
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[n] for n in sorted(histogram)], np.int64)
    units = solve(lengths // s.granule, demand, s.length // s.granule, s.gap) if len(lengths) else None
    spots = places(units, demand, s.length // s.granule, s.most_padding // s.granule) if len(lengths) else Places({}, {}, {}, {}, {}, 0)

    out_schema = PIECES.format(id=kind)
    names = [x.split()[0] for x in out_schema.split(", ")]

    def batch_of(out: list, doc_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, doc_type if n == "doc_id" else pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)

    hashed = done.withColumn("_h", F.xxhash64("_row")).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets_for(rows))))

    full = hashed.where("whole > 0").select("doc_id", "doc_tokens", "whole", "full", "_row", "_b", F.lit(0).alias("_g"))
    full = running_total(full, ["_g"], "_b", ["_row"], F.col("whole").cast("long"), "_before")

    def lay_full(batches):
        for b in batches:
            for doc_id, tokens, whole, blob, at in zip(*[b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "whole", "full", "_before")], strict=True):
                ids = unpacked(blob, whole * s.length).reshape(whole, s.length)
                for i in range(0, whole, 256):  # a very long document is laid out in parts
                    yield batch_of([(doc_id, j * s.length, s.length, ids[j].tobytes(), tokens, at + j, 0) for j in range(i, min(whole, i + 256))], b.schema.field("doc_id").type)

    rests = hashed.where("rest + tail > 0").select("doc_id", "doc_tokens", "rest", "tail", "ids", "_row", "_b")
    ranked = running_total(rests, ["rest"], "_b", ["_row"], F.lit(1), "_rank")
    carried = ["doc_id", "doc_tokens", "rest", "ids", "_row", "_b"]

    def seat(batches):
        for b in batches:
            rest, rank = b.column("rest").to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.full(len(rest), -1), np.zeros(len(rest), np.int64)
            for n in np.unique(rest).tolist():
                at = np.flatnonzero(rest == n)
                sequence[at], offset[at] = spots.of(n // s.granule, rank[at])
            # what goes to the stream: the tail, or all that is left
            loose = np.where(sequence >= 0, 0, rest) + b.column("tail").to_numpy()
            left = rest + b.column("tail").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(c) for c in carried] + [pa.array(x.astype(np.int64)) for x in (left, loose, sequence, offset * s.granule)], names=[*carried, "left", "loose", "sequence", "offset"])

    seated = materialise(ranked.mapInArrow(seat, f"doc_id {kind}, doc_tokens long, rest int, ids binary, _row long, _b long, left long, loose long, sequence long, offset long"), "pack_seated")

    def lay_seated(batches):
        for b in batches:
            out = []
            for doc_id, tokens, rest, blob, left, sequence, offset in zip(*[b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "rest", "ids", "left", "sequence", "offset")], strict=True):
                out.append((doc_id, tokens - left, rest, unpacked(blob, left)[:rest].tobytes(), tokens, wholes + sequence, offset))
            yield batch_of(out, b.schema.field("doc_id").type)

    first = wholes + spots.sequences
    loose = seated.where("loose > 0").select("doc_id", "doc_tokens", "left", "loose", "ids", "_row", "_b", F.lit(0).alias("_g"))
    total = loose.agg(F.coalesce(F.sum("loose"), F.lit(0))).first()[0]
    loose = running_total(loose, ["_g"], "_b", ["_row"], F.col("loose"), "_before")
    tail = powers(total % s.length)
    cuts = np.cumsum([total // s.length * s.length, *tail])  # where the last, shorter sequences begin

    def lay_loose(batches):
        for b in batches:
            out = []
            for doc_id, tokens, left, n, blob, at in zip(*[b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "left", "loose", "ids", "_before")], strict=True):
                ids, done_ids = unpacked(blob, left)[left - n :], 0
                while done_ids < n:
                    place = at + done_ids
                    if place < cuts[0]:
                        sequence, offset, room = place // s.length, place % s.length, s.length - place % s.length
                    else:
                        k = int(np.searchsorted(cuts, place, "right")) - 1
                        sequence, offset, room = cuts[0] // s.length + k, place - cuts[k], cuts[k + 1] - place
                    take = min(int(room), n - done_ids)
                    out.append((doc_id, tokens - n + done_ids, take, ids[done_ids : done_ids + take].tobytes(), tokens, first + int(sequence), int(offset)))
                    done_ids += take
            yield batch_of(out, b.schema.field("doc_id").type)

    laid = full.mapInArrow(lay_full, out_schema).unionByName(seated.where("sequence >= 0").mapInArrow(lay_seated, out_schema))
    return laid.unionByName(loose.mapInArrow(lay_loose, out_schema))
