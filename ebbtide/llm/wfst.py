"""SentencePiece encoding and decoding by a weighted finite-state transducer.

`Transducer` compiles a model file into three parts. The normaliser puts a mark before the text
and writes every space as the mark. The pieces are arcs weighted by rank: a piece costs one plus
its rank divided by `RANKS`, so the best path has the fewest pieces and, among those, the lowest
ranks. A character outside the vocabulary is spelled in byte arcs, each dearer than any piece.
Composing with a text gives an acyclic lattice over its characters, whose shortest path in the
tropical semiring (min, +) is found in one sweep; costs are whole numbers, so that equal costs are
equal, and of equal paths the one with the longest last piece wins.

No piece has a mark behind another character, so every path of the lattice passes the borders
before marks, and the shortest path of a text is that of its segments one after another. Segments
are looked up in a cache of bounded size; those of a batch that are new are composed together, all
arcs of one length at a time. Decoding joins the pieces' bytes and undoes the normaliser.

Defined results: null and empty texts have no pieces and decode to the empty text; every text,
of any length and with any characters, decodes to itself; rows of one doc_id are encoded each by
itself; an empty table gives an empty result; other columns are kept by `encode`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_LINE = re.compile("(\n)")
RANKS = 1 << 20
CACHE, LONG = 300_000, 200
_UNIT, _BYTE, _FAR = RANKS, 64 * RANKS, 1 << 60
_OWN = "\udc81"  # stands for a mark that the text itself has; no valid text holds it


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _windows(points: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """A hash of the `n` characters from each place on."""
    out = np.zeros(len(where), np.uint64)
    for k in range(n):
        out = (out ^ points[where + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Transducer:
    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte: dict[int, int] = {}
        self.arcs: dict[str, tuple[int, int]] = {}
        self.bytes: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} spans a border")
                # The place in the vocabulary is the rank: earlier pieces are more frequent.
                self.arcs[piece] = (i, _UNIT + i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        if len(self.byte) < 256:
            raise ValueError("the model has no byte fallback")
        self.longest = max(map(len, self.arcs))
        self.lines = not any("\n" in p for p in self.arcs)
        self.newline = np.array([self.byte[10]], np.int32).tobytes()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tables = {}
        for n in range(1, self.longest + 1):
            of_length = [(p, *a) for p, a in self.arcs.items() if len(p) == n]
            if of_length:
                text = _points("".join(p for p, _, _ in of_length))
                keys = _windows(text, np.arange(len(of_length)) * n, n)
                order = np.argsort(keys)
                seen = np.zeros(1 << 20, bool)
                seen[keys >> np.uint64(44)] = True
                self.tables[n] = (seen, keys[order], np.array([i for _, i, _ in of_length])[order],
                                  np.array([c for _, _, c in of_length])[order])

    def _fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in (MARK if char == _OWN else char).encode()]

    def single(self, segment: str) -> list[int]:
        """Shortest path of one segment, arc by arc."""
        n = len(segment)
        best, back = [0] + [_FAR] * n, [(0, 0)] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                arc = self.arcs.get(segment[start:end])
                if arc is None and end - start == 1:
                    arc = (-1, _BYTE * len(self._fallback(segment[start])))
                if arc and best[start] + arc[1] < best[end]:
                    best[end], back[end] = best[start] + arc[1], (start, arc[0])
        out: list[list[int]] = []
        while n:
            start, piece = back[n]
            out.append([piece] if piece >= 0 else self._fallback(segment[start]))
            n = start
        return [i for ids in out[::-1] for i in ids]

    def many(self, segments: list[str]) -> list[bytes]:
        """Shortest paths of short segments together: a sweep over positions, not over texts."""
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        size = np.array([len(segments[i]) for i in order])
        text = _points("".join(segments[i] for i in order))
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        left = np.repeat(base + size, size) - np.arange(len(text))  # characters to the segment's end
        cost, piece = {}, {}
        for n, (seen, keys, ids, costs) in self.tables.items():
            where = np.flatnonzero(left >= n)
            if not len(where):
                continue
            found = _windows(text, where, n)
            some = np.flatnonzero(seen[found >> np.uint64(44)])
            at = np.minimum(np.searchsorted(keys, found[some]), len(keys) - 1)
            hit = keys[at] == found[some]
            cost[n] = np.full(len(text), _FAR, np.int64)
            piece[n] = np.full(len(text), -1, np.int32)
            cost[n][where[some[hit]]] = costs[at[hit]]
            piece[n][where[some[hit]]] = ids[at[hit]]
        spelled = piece[1] < 0
        length = 1 + (text > 0x7F).astype(np.int64) + (text > 0x7FF) + (text > 0xFFFF)
        cost[1][spelled] = _BYTE * length[spelled]
        most, many = int(size[0]), len(order)
        best = np.full((most + 1, many), _FAR, np.int64)
        step = np.zeros((most + 1, many), np.int8)
        best[0] = 0
        for end in range(1, most + 1):
            live = int(np.searchsorted(-size, -end, "right"))  # segments of `end` or more
            for n in sorted(cost, reverse=True):
                if n <= end:
                    way = best[end - n, :live] + cost[n][base[:live] + end - n]
                    better = way < best[end, :live]
                    best[end, :live][better] = way[better]
                    step[end, :live][better] = n
        # Back along the best arcs, all segments at once.
        rows, at = np.arange(many), size.copy()
        owners, ends, ids = [], [], []
        table = np.full((self.longest + 1, len(text)), -1, np.int32)
        for n, p in piece.items():
            table[n] = p
        while len(rows):
            n = step[at[rows], rows].astype(np.int64)
            owners.append(rows)
            ends.append(at[rows])
            at[rows] -= n
            ids.append(table[n, base[rows] + at[rows]])
            rows = rows[at[rows] > 0]
        owner, end, flat = map(np.concatenate, (owners, ends, ids))
        flat = flat[np.lexsort((end, owner))].astype(np.int32)
        to = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=many))])
        spelling = np.zeros(many, bool)
        spelling[owner[np.concatenate(ids) < 0]] = True
        out = [b""] * many
        for k, i in enumerate(order):
            out[i] = (np.array(self.single(segments[i]), np.int32) if spelling[k]
                      else flat[to[k]:to[k + 1]]).tobytes()
        return out

    def segments(self, text: str) -> list[str]:
        """The normalised text, cut before each run of marks that follows another character.

        Where no piece has a line break, it is spelled in bytes, so every path passes its borders.
        """
        if not text:
            return []
        if MARK in text:  # the text's own marks are spelled in bytes
            text = text.replace(MARK, _OWN)
        out, run = [], ""
        for p in text.split(" "):
            run += MARK
            if p:
                p, run = run + p, ""
                if self.lines and "\n" in p:
                    out += [x for x in _LINE.split(p) if x]
                else:
                    out.append(p)
        if run:
            out.append(run)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit integers."""
        cut = [self.segments(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        fresh = []
        for s in {s for segs in cut for s in segs if s not in cache}:
            if (ids := older.get(s)) is not None:
                cache[s] = ids
            elif s == "\n" and self.lines:
                cache[s] = self.newline
            elif len(s) > LONG:
                cache[s] = np.array(self.single(s), np.int32).tobytes()
            else:
                fresh.append(s)
        if fresh:
            cache.update(zip(fresh, self.many(fresh), strict=True))
        return [b"".join([cache[s] for s in segs]) for segs in cut]

    def decode(self, ids: list[int]) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]


_compiled: dict[str, Transducer] = {}


def transducer(path: str = MODEL) -> Transducer:
    """The compiled model, once per worker process."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def _groups(column: pa.Array, most: int = 1 << 19) -> Iterator[list[str]]:
    """Texts in runs of about `most` characters."""
    run: list[str] = []
    size = 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """`docs` with `pieces` (array of ids) and `decoded`, the text that the ids give back."""
    columns = [c for c in docs.columns if c not in ("pieces", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for batch in batches:
            place = 0
            for texts in _groups(batch.column("text")):
                part = batch.slice(place, len(texts))
                place += len(texts)
                ids = fst.encode(texts)
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
                flat = np.frombuffer(b"".join(ids), np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                every = flat.tolist()
                decoded = pa.array([fst.decode(every[a:b]) for a, b in
                                    zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)],
                                   pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pieces, decoded],
                                                 [*columns, "pieces", "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                      for f in docs.select(*columns).schema.fields)
    return docs.select(*columns).mapInArrow(run, f"{kinds}, pieces array<int>, decoded string")


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, pieces and whether decoding gives the text back."""
    return encode(docs.select("doc_id", "text"), path).select(
        "doc_id", F.size("pieces").alias("n_pieces"), "pieces",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
