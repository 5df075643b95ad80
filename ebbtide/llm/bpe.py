"""Byte-level BPE by speculation and verification.

A text is parted by the pattern of the vocabulary, and each distinct part of a batch is encoded once.
First every part gets the tokens that a greedy search for the longest match proposes. Then all
adjacent pairs of all proposals are tested together: a row of tokens is the result of the merges
exactly if every token is the result of its own bytes and no merge ever joins two neighbours. Whether
a merge joins two neighbours is read off the last pieces of the left one and the first pieces of the
right one, from the newest pieces back to bytes. Only parts with a clashing pair are merged in full.

The order of the merges is a clock: a piece exists from the rank of the merge that makes it to the rank
of the merge that uses it up, and of equal ranks the leftmost goes first. This holds where every merge
makes a token of its own from two older ones, which is checked when a vocabulary is read.

Defined results: a null text has no token and decodes to an empty text; parts of any length are
encoded whole; special tokens are found in texts unless `special` is false; rows are independent, so
repeated rows and ties need no rule; a column of `docs` that is called like a new one is replaced; an
empty table gives an empty table. `decode` skips no token; an unknown id is an error, and bytes that
are no text become replacement characters.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import U, buffers, mix
from .tokens import _power as powers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the pattern of byte-level vocabularies that splits a text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of text that are encoded at once; a longer text is taken alone.
GROUP = 2 << 20
#: Chunks that a worker remembers, in each of two generations.
MEMO = 300_000
#: Words of up to so many bytes take each step together; a longer one is taken alone, with a queue.
SHORT = 48

_LAST = 1 << 40  # a rank behind all
_NEVER = np.int64(_LAST)
#: First bytes of white space, of one byte or more.
BLANK = np.zeros(256, bool)
BLANK[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Memo:
    """A mapping of at most two generations; what is asked for again survives."""

    def __init__(self, most: int = MEMO):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: Iterable) -> list:
        """The distinct `keys` that are not known; the known ones are held for the next read."""
        young, old, new = self.young, self.old, {}
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    new[k] = None
        return list(new)

    def trim(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


class Hashes:
    """Hashes of any pieces of a buffer, from sums of `byte * base ** place` modulo 2 ** 64."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * up[:len(raw)], out=self.sums[1:])

    def of(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.down[at])


class ByteBpe:
    """A byte-level BPE vocabulary from the bytes of its JSON file.

    With `special` false, the strings of special tokens are plain text.
    """

    def __init__(self, spec: bytes, special: bool = True):
        raw = json.loads(spec)
        model, of = raw["model"], alphabet()
        byte_of = lambda token: bytes(of[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in raw["added_tokens"])])
        self.piece: list[bytes | None] = [None] * size
        for token, i in model["vocab"].items():
            self.piece[i] = byte_of(token)
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        for token, i in self.special.items():
            self.piece[i] = token.encode()
        self.byte = np.full(256, -1)
        for c, b in of.items():
            self.byte[b] = model["vocab"].get(c, -1)
        pairs = np.array([[model["vocab"][x] for x in m] for m in merges], np.int64).reshape(-1, 2)
        made = np.array([model["vocab"]["".join(m)] for m in merges], np.int64)
        self.left, self.right, self.born = (np.full(size, -1) for _ in range(3))
        self.left[made], self.right[made], self.born[made] = *pairs.T, np.arange(len(made))
        if len(set(made.tolist())) < len(made) or (self.byte < 0).any() or (
                self.born[pairs] >= np.arange(len(made))[:, None]).any():
            raise ValueError("a merge must make a new token of two older ones, from all 256 bytes")
        key = pairs[:, 0] * size + pairs[:, 1]
        self.size, self.order = size, np.argsort(key)
        self.keys, self.made = key[self.order], made
        self.lengths = np.array([len(p or b"") for p in self.piece])
        self.rank = dict(zip(key.tolist(), range(len(made)), strict=True))
        # A token stays in use if its halves do and no earlier merge joins them in part.
        clash = self.clash(*pairs.T, np.arange(len(made)))
        sound = np.zeros(size, bool)
        sound[self.byte] = True
        for t, a, b, bad in zip(made.tolist(), *pairs.T.tolist(), clash.tolist(), strict=True):
            sound[t] = sound[a] and sound[b] and not bad
        self.token = {self.piece[i]: i for i in np.flatnonzero(sound).tolist()}
        self.reach: dict[bytes, int] = {}
        for p in self.token:
            if len(p) >= 4:
                self.reach[p[:4]] = max(len(p), self.reach.get(p[:4], 0))
        self._plant()
        self.split = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(
            self.special, key=len, reverse=True))) if special and self.special else None
        self.parts = regex.compile(PATTERN)
        self.memo = Memo()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or _NEVER."""
        if not len(self.keys):
            return np.full(len(a), _NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NEVER)

    def clash(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge of a rank below `until` joins an end of `a` and a start of `b`."""
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        end_a = np.full(len(a), _NEVER) if until is None else until
        end_b = end_a
        while len(live):
            rank, age_a, age_b = self.ranks(a, b), self.born[a], self.born[b]
            hit = (rank < end_a) & (rank < end_b)
            out[live[hit]] = True
            go = ~hit & ((age_a >= 0) | (age_b >= 0))
            live, a, b, end_a, end_b, age_a, age_b = (
                x[go] for x in (live, a, b, end_a, end_b, age_a, age_b))
            # The newer piece is taken apart. A merge across the border comes before one of its rank
            # in `b`, which lies further right, and after one in `a`.
            newer = age_b >= age_a
            end_a, end_b = np.where(newer, end_a, age_a), np.where(newer, age_b + 1, end_b)
            a, b = np.where(newer, a, self.right[a]), np.where(newer, self.left[b], b)
        return out

    def _plant(self) -> None:
        """Every start of a token by its hash, with the longest token that it begins with."""
        best: dict[bytes, int] = {}
        for p in sorted({p[:k] for p in self.token for k in range(1, len(p) + 1)}, key=len):
            best[p] = self.token[p] if p in self.token else best[p[:-1]]
        size = np.array([len(p) for p in best])
        hashes = Hashes(np.frombuffer(b"".join(best), np.uint8))
        keys = hashes.of(np.cumsum(size) - size, size)
        order = np.argsort(keys)
        self.starts, self.longest = keys[order], np.array(list(best.values()))[order]
        self.most = int(size.max(initial=1))

    def propose(self, word: bytes) -> list[int]:
        """The longest token at the start of `word`, then at the start of the rest, and so on."""
        token, reach = self.token, self.reach
        out, at, n = [], 0, len(word)
        while at < n:
            end = at + reach.get(word[at:at + 4], 3)
            while (t := token.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at += len(self.piece[t])
        return out

    def proposals(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What `propose` gives for each of `words`, one after another, and the word of each token.

        All words take a token at a time; how far the start of a token goes is found by bisection.
        """
        raw = np.frombuffer(b"".join(words), np.uint8)
        hashes = Hashes(raw)
        end = np.cumsum([len(w) for w in words])
        at = end - [len(w) for w in words]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        ids, owners = [], []
        while len(live):
            length = np.ones(len(at), np.int64)
            step = 1 << (self.most.bit_length() - 1)
            while step:
                fits = np.flatnonzero(at + length + step <= end)
                key = hashes.of(at[fits], length[fits] + step)
                found = np.minimum(np.searchsorted(self.starts, key), len(self.starts) - 1)
                length[fits[self.starts[found] == key]] += step
                step >>= 1
            t = self.longest[np.searchsorted(self.starts, hashes.of(at, length))]
            ids.append(t)
            owners.append(live)
            at = at + self.lengths[t]
            more = at < end
            live, at, end = live[more], at[more], end[more]
        ids, owners = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids, owners))
        order = np.argsort(owners, kind="stable")
        return ids[order], owners[order]

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What `merge` gives for each of `words`, one after another, and the word of each token: one
        merge of every word at a time."""
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        due = np.full(len(ids), _NEVER)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        due[inner] = self.ranks(ids[inner], ids[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(first, append=len(ids))
            least = np.minimum.reduceat(due, first)
            over = least == _NEVER
            if over.any():
                out = np.repeat(over, size)
                done.append((ids[out], owner[out]))
                ids, owner, due, size, least = ids[~out], owner[~out], due[~out], size[~over], least[~over]
                if not len(ids):
                    break
            hit = np.flatnonzero(due == np.repeat(least, size))
            hit = hit[np.diff(owner[hit], prepend=-1) != 0]  # the leftmost of each word
            ids[hit] = self.made[least]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, owner, due = ids[keep], owner[keep], due[keep]
            hit = hit - np.arange(len(hit))
            for left in (hit[hit > 0] - 1, hit):
                due[left] = _NEVER
                left = left[left + 1 < len(ids)]
                left = left[owner[left] == owner[left + 1]]
                due[left] = self.ranks(ids[left], ids[left + 1])
        ids, owner = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (
            [d[0] for d in done], [d[1] for d in done]))
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def merge(self, word: bytes) -> list[int]:
        """All merges of `word` in the order of their ranks, the leftmost of equal ranks first."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n, size, rank = len(ids), self.size, self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
               if (r := rank.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(due)
        while due:
            r, i, x, y = heapq.heappop(due)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < n and (r := rank.get(ids[k] * size + ids[m])) is not None:
                    heapq.heappush(due, (r, k, ids[k], ids[m]))
        return [t for t in ids if t >= 0]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of every word and the word of each: proposed, tested pair by pair, and merged where
        a pair clashes."""
        ids, owner = self._each(words, np.arange(len(words)), self.proposals, self.propose)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, of = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        bad = np.unique(owner[inner[self.clash(pairs // self.size, pairs % self.size)[of]]])
        if len(bad):
            again, whose = self._each(words, bad, self.merged, self.merge)
            good = ~np.isin(owner, bad)
            ids, owner = np.concatenate([ids[good], again]), np.concatenate([owner[good], whose])
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        return ids, owner

    @staticmethod
    def _each(words: list[bytes], which: np.ndarray, together: Callable, alone: Callable
              ) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the given words by one way for short and one for long words, and their words."""
        chosen = which.tolist()
        short = [k for k in chosen if len(words[k]) <= SHORT]
        ids, owner = together([words[k] for k in short])
        ids, owner = [ids], [np.array(short, np.int64)[owner]]
        for k in chosen:
            if len(words[k]) > SHORT:
                ids.append(np.array(alone(words[k]), np.int64))
                owner.append(np.full(len(ids[-1]), k))
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not known; what is one part as it stands needs no pattern."""
        young, old = self.memo.young, self.memo.old
        whole, mixed = [], []
        for c in chunks:
            (whole if c.isalpha() or (c[0] == " " and c[1:].isalpha()) else mixed).append(c)
        parts = [self.parts.findall(c) for c in mixed]
        known = {p: young[p] if p in young else old.get(p) for x in parts for p in x}
        known |= dict.fromkeys(whole)
        new = [p for p, ids in known.items() if ids is None]
        tokens, owner = self.words([p.encode() for p in new])
        packed = tokens.astype("<u4").tobytes()
        ends = (4 * np.searchsorted(owner, np.arange(len(new) + 1))).tolist()
        known |= {p: packed[a:b] for p, a, b in zip(new, ends, ends[1:], strict=False)}
        young.update((c, known[c]) for c in whole)
        young.update((c, b"".join([known[p] for p in x])) for c, x in zip(mixed, parts, strict=True))

    def _cuts(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Where chunks begin, and the ids of the special tokens among them, by where they begin.

        The pattern begins a new part at every space before a visible character. Some visible
        characters count as blank here, so a chunk may hold several parts.
        """
        begins = np.zeros(len(raw), bool)
        begins[:-1] = (raw[:-1] == 32) & ~BLANK[raw[1:]]
        spans, special = offs, {}
        if self.split and self.split.search(data := raw.tobytes()):
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                for m in self.split.finditer(data, a, b):
                    special[m.start()] = self.special[m.group().decode()]
                    begins[m.start():m.end()] = False
                    spans = np.append(spans, m.span())
        begins[spans[spans > 0] - 1] = False  # what follows is not of this text
        begins[spans[spans < len(raw)]] = True
        return np.flatnonzero(begins), special

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a buffer one after another, and where those of each text begin."""
        begins, special = self._cuts(raw, offs)
        names, which = distinct(raw, np.append(begins, len(raw)))
        if special:
            which[np.searchsorted(begins, list(special))] = np.array(list(special.values())) + len(names)
        self._learn(self.memo.missing(names))
        packed = [self.memo.young[c] for c in names]
        self.memo.trim()
        if special:  # every id as a chunk of its own behind the others
            packed += [array("I", [t]).tobytes() for t in range(self.size)]
        ids, ends = take(*ragged(packed), which)
        return ids, ends[np.searchsorted(begins, offs)]

    def decode(self, ids: bytes) -> str:
        return b"".join([self.piece[t] for t in np.frombuffer(ids, "<u4").tolist()]).decode(
            errors="replace")


def distinct(raw: np.ndarray, cuts: np.ndarray, kind: pa.DataType = pa.large_string()  # noqa: B008
             ) -> tuple[list, np.ndarray]:
    """The distinct values between successive `cuts` of a buffer, and which of them each one is."""
    coded = pa.Array.from_buffers(kind, len(cuts) - 1, [
        None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)


def ragged(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of packed 32-bit integers one after another, and where each begins."""
    return (np.frombuffer(b"".join(packed), "<u4"),
            np.concatenate([[0], np.cumsum([len(x) >> 2 for x in packed])]).astype(np.int64))


def take(values: np.ndarray, begins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given rows of ragged values one after another, and where each begins."""
    size = np.diff(begins)[rows]
    to = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return values[np.arange(to[-1]) + np.repeat(begins[rows] - to[:-1], size)], to


@lru_cache(maxsize=2)
def vocabulary(spec: bytes, special: bool = True) -> ByteBpe:
    """The vocabulary of a file, read once in each worker process."""
    return ByteBpe(spec, special)


def shipped(docs: DataFrame, path: str) -> Broadcast:
    """The bytes of a vocabulary file, some MB that do not grow with the data."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def groups(lengths: list[int], most: int = GROUP) -> Iterator[slice]:
    """Successive runs of rows of about `most` bytes; a longer row is alone."""
    start = 0
    for end, total in enumerate(accumulate(lengths, initial=0)):
        if end > start and (end == len(lengths) or total - sum_to + lengths[end] > most):
            yield slice(start, end)
            start = end
        if end == start:
            sum_to = total


def by_group(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values in `column` have about GROUP bytes together."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for s in groups(sizes):
        yield batch.slice(s.start, s.stop - s.start)


def encode(docs: DataFrame, path: str = VOCABULARY, text: str = "text", special: bool = True
           ) -> DataFrame:
    """`docs` with the token ids of column `text`, in column `ids` as packed unsigned 32-bit integers
    (little-endian), the form in which training shards hold them."""
    spec = shipped(docs, path)
    kept = docs.drop("ids")
    columns = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(spec.value, special)
        for batch in batches:
            for part in by_group(batch, text):
                ids, to = bpe.encode(*buffers(part.column(text)))
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [
                    None, pa.py_buffer((4 * to).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), packed], [*columns, "ids"])

    schema = kept.withColumn("ids", F.lit(b"")).schema
    return kept.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """`docs` with the text of column `ids` in column `decoded`."""
    spec = shipped(docs, path)
    kept = docs.drop("decoded")
    columns = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(spec.value)
        for batch in batches:
            for part in by_group(batch, "ids"):
                texts = [bpe.decode(i or b"") for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(texts, pa.string())],
                    [*columns, "decoded"])

    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit("")).schema)


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """A row for every row of `docs`: how many tokens, and digests of the ids and the decoded text."""
    ids = encode(docs.select("doc_id", "text"), path).select("doc_id", "ids")
    return decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
