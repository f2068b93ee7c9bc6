"""SentencePiece encoding and decoding by a max-plus scan.

A text's best segmentation into pieces maximises the sum of their scores. Where no piece
can cross, the sum falls apart: before a run of spaces, around characters that are in no
piece, and between letters and other characters if no piece has both. Parts between such places are solved once and remembered.

Giant texts are cut into chunks of fixed length, wherever that is, and scanned in the
(max, +) algebra:

1. ``transfer``: a chunk's matrix has the best sum for each pair of states at its borders. A
   state is how many of the first characters after a border the last piece before it covers.
   Between the first and the last place in a chunk that no piece can cross all ways are one;
   its sum is left out, since only differences within a matrix matter.
2. ``combine``, the product of matrices, is associative: neighbouring chunks are multiplied in
   groups of ``GROUP``, the groups' products give the best sums up to each group, and these,
   within a group, those up to each chunk.
3. ``entries``: with the sums up to its border, a chunk tells for each state that it may leave
   in the one that it was entered in. These maps compose, from the end of a text to its start.
4. ``trace``: each chunk by itself gives the ids of its pieces.

Sums are exact, since scores are rounded to multiples of ``1 / EXACT``, and of several best
last pieces at a place the longest is taken, on both ways. So a text has the same ids whole or
in chunks, whatever their lengths; ``giant`` and ``chunk`` only bound what a task works on.

``Pieces`` reads a SentencePiece model file and takes its pieces' scores as those of a
unigram model. The ids are what the sentencepiece library gives for the same file with the
model type unigram and with the scores of ``NEVER`` raised likewise. The public file is of type BPE: its merge order isn't a sum of scores,
so these are not the ids of that type; see the README.

Characters in no piece are spelled as the byte pieces of their UTF-8. A literal U+2581,
which the format uses for the space, is spelled so too, so ``decode`` gives back every text
exactly. Defined cases: a null or empty text has no ids; repeated rows have equal ids; of
segmentations with equal sums the one with the longer last piece is taken, and so on before
it; an empty table gives no rows; columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, cut

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
GIANT, CHUNK, GROUP = 1 << 14, 1 << 12, 32
#: Chunks whose ways are broadcast, of about 200 bytes each; beyond, both sides are shuffled.
MAX_WAYS = 300_000
LOW = -np.inf
#: How many parts a Python worker remembers, of about 150 bytes each. More save time, fewer memory.
REMEMBERED = 900_000
#: Latin, Greek and Cyrillic letters.
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u052f]"
#: Scores up to this stand for "last of all" and count as one less than the lowest other score; as they are, sums in single precision would drown in them.
NEVER = -1e8
#: Scores are multiples of one by this; sums of up to 2 ** 53 of them are exact.
EXACT = 1 << 20


class Memo(dict):
    """What ``solve`` gives, remembered for the first parts of up to 64 characters that come; common ones come early."""

    def __init__(self, solve, most: int):
        self.solve, self.most = solve, most

    def __missing__(self, part: str):
        found = self.solve(part)
        if len(self) < self.most and len(part) <= 64:
            self[part] = found
        return found


class Pieces:
    """The pieces of a model, and encoding by them."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        floor = min(p.score for p in proto.pieces if p.type == 1 and p.score > NEVER) - 1
        self.pieces = {p.piece: (i, round(max(p.score, floor) * EXACT) / EXACT) for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.bytes = [0] * 256
        self.raw: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            self.raw.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type in (1, 4) else b"")
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.prefix = " " if proto.normalizer_spec.add_dummy_prefix else ""
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - 10
        self.bare = sorted({c for c in "\n\t\r" if not any(c in p for p in self.pieces)})
        apart = re.escape("".join(self.bare)) + SPACE
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        between = any(re.search(f"{LETTER}[^{SPACE}](?<!{LETTER})|[^{SPACE}](?<!{LETTER}){LETTER}", p) for p in self.pieces)
        rest = rf"(?:(?!{LETTER})[^ {apart}])+"
        kinds = [f"[^{apart}]+"] if crossing else [f" *[^ {apart}]+", " +"] if between else [f" *{LETTER}+", f" *{rest}", " +"]
        self.parts = re.compile("|".join([f"[{apart}]", *kinds]))
        # Each piece with its id and score, and each beginning of a piece that is none.
        self.heads: dict[str, tuple[int, float] | tuple[()]] = {p[:k]: () for p in self.pieces for k in range(1, len(p))} | self.pieces
        self.ids = Memo(lambda part: self.solve(part)[1], remembered)
        self.sums = Memo(lambda part: self.solve(part)[0], min(remembered, 100_000))

    def spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def reach(self, text: str, upto: int, starts: int, entry: list[float]) -> tuple[list[float], list[tuple[int, tuple[int, ...]]]]:
        """Best sums up to each place of ``text`` till ``upto``, given those of its first places, of pieces that start before ``starts``; and each one's last piece (its begin, its ids; begin -1: none)."""
        best, last, heads, longest = [LOW] * (upto + 1), [(-1, ())] * (upto + 1), self.heads, self.longest
        for i, x in enumerate(entry[: upto + 1]):
            best[i] = x
        spaced = text.replace(" ", SPACE)
        for i in range(min(starts, upto)):
            if (now := best[i]) == LOW:
                continue
            single, j, most = False, i + 1, min(upto, i + longest)
            while j <= most and text[j - 1] != SPACE and (hit := heads.get(spaced[i:j])) is not None:
                if hit:
                    single |= j == i + 1
                    if now + hit[1] > best[j]:
                        best[j], last[j] = now + hit[1], (i, (hit[0],))
                j += 1
            if not single and now + self.unknown > best[i + 1]:
                best[i + 1], last[i + 1] = now + self.unknown, (i, tuple(self.spell(text[i])))
        return best, last

    def traced(self, last: list, end: int) -> tuple[int, list[int]]:
        """Where the best way to ``end`` was entered, and its ids."""
        out = []
        while last[end][0] >= 0:
            end, ids = last[end]
            out.append(ids)
        return end, [i for ids in reversed(out) for i in ids]

    def solve(self, text: str) -> tuple[float, bytes]:
        """Sum and ids (32 bits each) of a part that no piece leaves."""
        if text == SPACE:
            return self.unknown, np.array(self.spell(text), np.int32).tobytes()
        spaced, heads, longest = text.replace(" ", SPACE), self.heads, self.longest
        n = len(text)
        best, begin, piece = [LOW] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            now, j, single = best[i], i + 1, False
            most = min(n, i + longest)
            while j <= most and (hit := heads.get(spaced[i:j])) is not None:
                if hit:
                    single |= j == i + 1
                    if (s := now + hit[1]) > best[j]:
                        best[j], begin[j], piece[j] = s, i, hit[0]
                j += 1
            if not single and (s := now + self.unknown) > best[i + 1]:
                best[i + 1], begin[i + 1], piece[i + 1] = s, i, -1
        out, end = [], n
        while end > 0:
            i = begin[end]
            out += [piece[end]] if piece[end] >= 0 else reversed(self.spell(text[i]))
            end = i
        return best[n], np.array(out[::-1], np.int32).tobytes()

    def part(self, text: str) -> float:
        return self.sums[text]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, which has the model's prefix already if it has one."""
        ids = self.ids
        return np.frombuffer(b"".join([ids[p] for p in self.parts.findall(text or "")]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(self.prefix)

    def first_cut(self, chunk: str, size: int) -> int:
        """The first place within a chunk that no piece can cross; -1 if there is none."""
        end = next((m.end() for m in self.parts.finditer(chunk)), 0)
        return end if 0 < end <= size and end < len(chunk) else -1

    def last_cut(self, chunk: str, size: int) -> int:
        """The last such place; parts are looked for from a place near the end, farther back while there is none."""
        back = 64
        while True:
            ends = [m.end() for m in self.parts.finditer(chunk, max(0, size - back))]
            if found := [e for e in ends if e <= size and e < len(chunk)]:
                return found[-1]
            if back >= size:
                return -1
            back *= 4

    def transfer(self, chunk: str, size: int) -> np.ndarray:
        """[entry, exit]: the best sum of a chunk of ``size`` characters, less what all ways have in common; ``chunk`` goes on with what may follow in the next one."""
        n = self.longest
        out = np.full((n, n), LOW)
        first = self.first_cut(chunk, size)

        def exits(begin: int) -> np.ndarray:
            best, _ = self.reach(chunk[begin:], min(len(chunk), size + n - 1) - begin, size - begin, [0.0])
            got = np.full(n, LOW)
            tail = best[size - begin :]
            got[: len(tail)] = tail
            return got

        if first < 0:
            for s in range(min(n, size + 1)):
                out[s] = exits(s)
            return out
        tail = exits(self.last_cut(chunk, size))
        for s in range(min(n, first + 1)):
            out[s] = sum(self.part(p) for p in self.parts.findall(chunk[s:first])) + tail
        return out

    def entries(self, chunk: str, size: int, first: int, sums: list[float]) -> list[int]:
        """For each state that the chunk may be left in, the one that it is entered in on the best way, given the best ``sums`` up to its first places; up to its ``first_cut``, if it has one, is enough of the chunk."""
        n = self.longest
        if first >= 0:
            return [self.traced(self.reach(chunk, first, first, sums)[1], first)[0]] * n
        upto = min(len(chunk), size + n - 1)
        best, last = self.reach(chunk, upto, size, sums)
        return [self.traced(last, size + e)[0] if size + e <= upto and best[size + e] > LOW else 0 for e in range(n)]

    def trace(self, chunk: str, size: int, sums: list[float], leaving: int) -> np.ndarray:
        """The ids of a chunk's own pieces on the best way that leaves it in state ``leaving``."""
        first = self.first_cut(chunk, size)
        if first < 0:
            return np.array(self.traced(self.reach(chunk, size + leaving, size, sums)[1], size + leaving)[1], np.int32)
        end = self.last_cut(chunk, size)
        _, head = self.traced(self.reach(chunk, first, first, sums)[1], first)
        _, tail = self.traced(self.reach(chunk[end:], size + leaving - end, size - end, [0.0])[1], size + leaving - end)
        return np.concatenate([np.array(head, np.int32), self.encode(chunk[first:end]), np.array(tail, np.int32)])


@lru_cache(maxsize=1)
def loaded(model: bytes, remembered: int = REMEMBERED) -> Pieces:
    return Pieces(model, remembered)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two transfer matrices in the (max, +) algebra; it is associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def forward(matrices: list[np.ndarray], sums: np.ndarray) -> list[np.ndarray]:
    """The best sums up to the states at each matrix's own first border, from those at the first one's; less their largest, which changes no way."""
    out = []
    for m in matrices:
        out.append(sums)
        sums = (sums[:, None] + m).max(axis=0)
        sums = sums - sums.max()
    return out


def by_groups(rows: DataFrame, by: list[str], order: Column, f: Callable[[dict[str, np.ndarray]], dict], schema: str) -> DataFrame:
    """What ``f`` makes of the columns of each group of ``by``, in ``order``: groups come as a stream of sorted rows, many in a frame, since a frame for each costs more than the work on a text."""

    def made(frame: pd.DataFrame, starts: list[int], end: int) -> pd.DataFrame:
        columns = {c: frame[c].to_numpy() for c in frame}
        out: dict[str, list] = {}
        for a, b in zip(starts, [*starts[1:], end], strict=True):
            for name, values in f({c: v[a:b] for c, v in columns.items()}).items():
                out.setdefault(name, []).extend(values)
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group: list[pd.DataFrame] = []  # the last group may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            if open_group and (batch[by].iloc[-1] == open_group[0][by].iloc[0]).all():
                open_group.append(batch)
                continue
            frame = pd.concat([*open_group, batch], ignore_index=True)
            starts = np.flatnonzero((frame[by] != frame[by].shift()).any(axis=1)).tolist()
            if len(starts) > 1:
                yield made(frame, starts[:-1], starts[-1])
            open_group = [frame.iloc[starts[-1] :].reset_index(drop=True)]
        if open_group:
            frame = pd.concat(open_group, ignore_index=True)
            yield made(frame, [0], len(frame))

    return rows.repartition(*by).sortWithinPartitions(*by, order).mapInPandas(run, schema)


def encode(docs: DataFrame, model_path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, ids of every whole text of ``docs`` (doc_id, text). ``remembered`` bounds a worker's memory and changes no result."""
    with open(model_path, "rb") as f:
        model = f.read()
    longest, prefix = loaded(model, remembered).longest, loaded(model, remembered).prefix
    chunk = max(chunk, 2 * longest)
    rows = bound_batches(docs).select("doc_id", F.when(F.col("text") != "", F.concat(F.lit(prefix), "text")).otherwise(F.lit("")).alias("text"))

    def lists(ids: list[np.ndarray]) -> pa.Array:
        offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model, remembered)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                ids = [own.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), lists(ids)], names=["doc_id", "ids"])

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk: its text goes on with what may follow in the next one."""
        for batch in batches:
            for i in range(len(batch)):
                text = batch.column(2)[i].as_py()
                for j in range(0, len(text), 1024 * chunk):
                    starts = range(j, min(len(text), j + 1024 * chunk), chunk)
                    taken = pa.array([i] * len(starts))
                    own = [pa.array([k // chunk for k in starts], pa.int32()), pa.array([min(chunk, len(text) - k) for k in starts], pa.int32()), pa.array([text[k : k + chunk + longest - 1] for k in starts])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *own], names=["uid", "doc_id", "k", "size", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    small = rows.filter(F.char_length("text") <= giant).mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    large = rows.filter(F.char_length("text") > giant).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    chunks = cut(large.mapInArrow(pieces_of, f"uid long, doc_id {kind}, k int, size int, text string"), "chunks")

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = loaded(model, remembered)
        for batch in batches:
            first = [own.first_cut(t, n) for t, n in zip(batch["text"], batch["size"], strict=True)]
            head = [t[:f] if f >= 0 else t for t, f in zip(batch["text"], first, strict=True)]
            yield batch[["uid", "k", "size"]].assign(g=batch["k"] // GROUP, first=first, head=head, m=[own.transfer(t, n).ravel() for t, n in zip(batch["text"], batch["size"], strict=True)])

    square = lambda column: [np.asarray(m, float).reshape(longest, longest) for m in column]

    def multiplied(one: dict) -> dict:
        product, *rest = square(one["m"])
        for m in rest:
            product = combine(product, m)
        return {"uid": one["uid"][:1], "g": one["g"][:1], "m": [product.ravel()]}

    def up_to_groups(one: dict) -> dict:
        return {"uid": one["uid"], "g": one["g"], "sums": forward(square(one["m"]), np.array([0.0] + [LOW] * (longest - 1)))}

    def up_to_chunks(one: dict) -> dict:
        own = loaded(model, remembered)
        sums = forward(square(one["m"]), np.asarray(one["sums"][0], float))
        entry = [own.entries(t, int(n), int(c), f.tolist()) for t, n, c, f in zip(one["head"], one["size"], one["first"], sums, strict=True)]
        return {"uid": one["uid"], "k": one["k"], "sums": sums, "entry": entry}

    def left(one: dict) -> dict:
        """From the last chunk on."""
        states = [0]
        for entry in one["entry"]:
            states.append(int(entry[states[-1]]))
        return {"uid": one["uid"], "k": one["k"], "sums": one["sums"], "leaving": states[:-1]}

    width = np.uint16 if max(loaded(model, remembered).bytes + [i for i, _ in loaded(model, remembered).pieces.values()]) < 1 << 16 else np.int32

    def traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = loaded(model, remembered)
        for batch in batches:
            ids = [own.trace(t, n, list(f), e).astype(width).tobytes() for t, n, f, e in zip(batch["text"], batch["size"], batch["sums"], batch["leaving"], strict=True)]
            yield batch[["uid", "k", "doc_id"]].assign(ids=ids)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = np.frombuffer(b"".join(batch.column(1)[i].as_py()), width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), lists([ids])], names=["doc_id", "ids"])

    made = "uid long, k int, size int, g int, first int, head string, m array<double>"
    matrices = cut(chunks.select("uid", "k", "size", "text").mapInPandas(transfers, made), "matrices")
    products = by_groups(matrices.select("uid", "g", "k", "m"), ["uid", "g"], F.col("k"), multiplied, "uid long, g int, m array<double>")
    starts = cut(by_groups(products, ["uid"], F.col("g"), up_to_groups, "uid long, g int, sums array<double>"), "starts")
    entered = by_groups(matrices.join(starts, ["uid", "g"]), ["uid", "g"], F.col("k"), up_to_chunks, "uid long, k int, sums array<double>, entry array<int>")
    # A text's sums and maps are some 200 bytes a chunk, much less than the text, which is one row.
    ways = cut(by_groups(entered, ["uid"], F.desc("k"), left, "uid long, k int, sums array<double>, leaving int"), "ways")
    few = ways.limit(MAX_WAYS + 1).count() <= MAX_WAYS
    traced = chunks.join(F.broadcast(ways) if few else ways, ["uid", "k"]).mapInPandas(traces, f"uid long, k int, doc_id {kind}, ids binary")
    joined = traced.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]).alias("ids"))
    return small.unionByName(joined.select("doc_id", "ids").mapInArrow(unpacked, f"doc_id {kind}, ids array<int>"))


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, ids, text of ``encoded`` (doc_id, ids)."""
    with open(model_path, "rb") as f:
        model = f.read()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model, REMEMBERED)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                lists = part.column(1)
                values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                text = pa.array([own.decode(values[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], names=["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return bound_batches(encoded).select("doc_id", "ids").mapInArrow(texts, f"doc_id {kind}, ids array<int>, text string")
