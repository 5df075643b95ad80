"""Alignment of two tokenizers over the same texts by white-space anchors.

Both tokenizers encode a whole text: A (byte-level BPE) the text behind a space, B (pieces, which puts
that space itself). Neither has a token across a space between two visible characters, so equal chunks
between such spaces are encoded once, and both have a token that begins with that space. Where the
tokens of both sides spell the chunk byte by byte, this place is a verified anchor, and the anchors part
a text into windows. A window is known by the ids of its tokens, so its alignment - the groups between
all common ends, and the link of the two tokens that close each group - is worked out once for each pair
of id tuples and remembered.

Two tokens that end at the same byte of a text are one a suffix of the other, so the pairs that can
ever be linked follow from the two vocabularies: fewer than half a million, whatever the corpus. Links
travel as numbers of this list, and the table of their counts has a proven bound: it is collected once
and sent to every task. Texts are encoded once; their distinct links with times are written, counted
per task as an array, summed, and read again for the scores. Nothing is joined by document.

Defined results: null and empty texts, and texts whose joined tokens of A or of B are not the bytes of
space and text (such as a text that holds the mark U+2581) have no tokens; strings of special tokens are
plain text; texts of any length are aligned whole; rows are independent, so repeated rows count again;
equal counts are all the highest; a column of `docs` that is called like a new one is replaced; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BLANK, VOCABULARY, ByteBpe, Memo, by_group, distinct, ragged, shipped, take
from .common import stored
from .tokens import buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Chunks and windows that a worker remembers, in each of two generations.
MEMO = 250_000
_MARK = np.frombuffer(MARK.encode(), np.uint8)


class Pieces:
    """A piece model with byte fallback that puts a space before a text."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.piece = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(
            MARK, " ").encode() for i, p in enumerate(names)]
        # No piece goes on behind a mark within it, so a text can be encoded border by border.
        self.parted = not any(re.search(f"[^{MARK}]{MARK}", p) for p in names)
        self.memo = Memo()
        self.space = np.array([self.model.piece_to_id(MARK)], "<u4").tobytes()

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a buffer, each behind a space, one after another, and where those of
        each text begin."""
        begins = np.zeros(len(raw), bool)
        if self.parted:
            begins[1:] = (raw[1:] == 32) & (raw[:-1] != 32)
            hit = np.flatnonzero(raw[:-2] == _MARK[0])
            hit = hit[(raw[hit + 1] == _MARK[1]) & (raw[hit + 2] == _MARK[2])]
            for k in np.unique(np.searchsorted(offs, hit, "right") - 1).tolist():
                begins[offs[k]:offs[k + 1]] = False  # a mark in a text is one with spaces beside it
        begins[offs[offs < len(raw)]] = True
        begins = np.flatnonzero(begins)
        names, which = distinct(raw, np.append(begins, len(raw)))
        if new := self.memo.missing(names):
            # The model puts a space before a text, but none before nothing.
            self.memo.young.update((c, array("I", x).tobytes() if c != " " else self.space) for c, x in
                                   zip(new, self.model.encode([c[1:] for c in new], num_threads=1),
                                       strict=True))
        ids, ends = take(*ragged([self.memo.young[c] for c in names]), which)
        self.memo.trim()
        return ids, ends[np.searchsorted(begins, offs)]


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All pairs of an id of `a` and one of `b` of which one's bytes end the other's, as a << 32 | b,
    ascending."""
    by_a: dict[bytes, list[int]] = {}
    by_b: dict[bytes, list[int]] = {}
    for pieces, by in ((a, by_a), (b, by_b)):
        for i, p in enumerate(pieces):
            by.setdefault(p, []).append(i)
    out = [x << 32 | i for i, p in enumerate(b) for k in range(len(p)) for x in by_a.get(p[k:], ())]
    out += [i << 32 | x for i, p in enumerate(a) for k in range(1, len(p)) for x in by_b.get(p[k:], ())]
    return np.unique(np.array(out, np.int64))


class Aligner:
    """Two tokenizers, the pairs of their ids that can be linked, and the windows seen so far."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteBpe(a, special=False), Pieces(b)
        self.pairs = linkable(self.a.piece, self.b.piece)
        self.bytes = [np.frombuffer(b"".join(t.piece), np.uint8) for t in (self.a, self.b)]
        self.length = [np.array([len(p) for p in t.piece], np.int64) for t in (self.a, self.b)]
        self.names = [str(i) for i in range(max(len(self.a.piece), len(self.b.piece)))]
        self.chunks, self.memo = Memo(MEMO), Memo(MEMO)
        self.a.memo, self.b.memo = Memo(MEMO // 4), Memo(MEMO // 4)

    def _align(self, keys: list[tuple[bytes, bytes]]) -> list[tuple[str, bytes]]:
        """Of every window its groups as text, and its links as packed places in `pairs`.

        Both sides of a window have the same bytes, so all windows are aligned in one go, one after
        another.
        """
        sides = [np.frombuffer(b"".join(x), "<u4") for x in zip(*keys, strict=True)]
        _, i, j = np.intersect1d(*[np.cumsum(n[x]) for n, x in zip(self.length, sides, strict=True)],
                                 assume_unique=True, return_indices=True)
        links = np.searchsorted(self.pairs, sides[0][i].astype(np.int64) << 32 | sides[1][j]).astype("<i4")
        last = np.cumsum([len(k[0]) // 4 for k in keys]) - 1  # each window ends in a link
        ends = (np.searchsorted(i, last) + 1).tolist()
        x, y = (list(map(self.names.__getitem__, side.tolist())) for side in sides)
        groups, s, t = [], 0, 0
        for u, v in zip((i + 1).tolist(), (j + 1).tolist(), strict=True):
            groups.append(f"{x[s] if u == s + 1 else ','.join(x[s:u])}|"
                          f"{y[t] if v == t + 1 else ','.join(y[t:v])}")
            s, t = u, v
        packed = links.tobytes()
        return [(";".join(groups[s:e]), packed[4 * s:4 * e])
                for s, e in zip([0, *ends], ends, strict=False)]

    def _encode(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of every chunk in A and in B; None where one of them does not spell the chunk."""
        raw = np.frombuffer("".join(chunks).encode(), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(c.encode()) for c in chunks])]).astype(np.int64)
        good, packed = np.ones(len(chunks), bool), []
        for side, pieces, length in zip((self.a, self.b), self.bytes, self.length, strict=True):
            ids, to = side.encode(raw, offs)
            good &= np.diff(np.concatenate([[0], np.cumsum(length[ids])])[to]) == np.diff(offs)
            same = np.flatnonzero(good)
            chunk, upto = take(raw, offs, same)
            spelled, _ = take(pieces, np.concatenate([[0], np.cumsum(length)]), take(ids, to, same)[0])
            wrong = np.flatnonzero(chunk != spelled)
            good[same[np.unique(np.searchsorted(upto, wrong, "right") - 1)]] = False
            whole, ends = ids.astype("<u4").tobytes(), (4 * to).tolist()
            packed.append([whole[x:y] for x, y in zip(ends, ends[1:], strict=False)])
        return [key if ok else None for key, ok in zip(zip(*packed, strict=True), good.tolist(), strict=True)]

    def align(self, raw: np.ndarray, offs: np.ndarray
              ) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of every text of a buffer: tokens of A and of B, and its groups; then where its distinct links
        begin in all links, these, and how often a text has them. Texts without tokens have no groups
        and no links."""
        rows = len(offs) - 1
        empty = np.diff(offs) == 0
        raw = np.insert(raw, offs[:-1], 32)
        offs = offs + np.arange(rows + 1)
        # Neither side has a token across these places, whatever stands before them.
        begins = np.zeros(len(raw), bool)
        if self.b.parted:
            begins[1:-1] = (raw[1:-1] == 32) & (raw[:-2] != 32) & ~BLANK[raw[2:]]
            begins[offs[1:] - 1] = False  # what follows is not of this text
        begins[offs[:-1]] = True
        begins = np.flatnonzero(begins)
        names, which = distinct(raw, np.append(begins, len(raw)))
        known, seen = self.chunks.young, self.memo.young
        if new := self.chunks.missing(names):
            known.update(zip(new, self._encode(new), strict=True))
        keys = [known[c] for c in names]
        self.chunks.trim()
        if new := self.memo.missing(k for k in keys if k):
            seen.update(zip(new, self._align(new), strict=True))
        windows = [seen[k] if k else ("", b"") for k in keys]
        self.memo.trim()

        spans = np.searchsorted(begins, offs)
        wrong = np.array([k is None for k in keys], bool)[which]
        good = ~empty & (np.diff(np.concatenate([[0], np.cumsum(wrong)])[spans]) == 0)
        n = [np.where(good, np.diff(np.concatenate([[0], np.cumsum(np.array(
            [len(k[s]) >> 2 if k else 0 for k in keys], np.int64)[which])])[spans]), 0) for s in (0, 1)]
        link, to = take(*ragged([x for _, x in windows]), which)
        owner = np.repeat(np.arange(rows), np.diff(to[spans]))
        kept = good[owner]
        held, times = np.unique(owner[kept] * len(self.pairs) + link[kept], return_counts=True)
        text = np.array([g for g, _ in windows], object)[which].tolist()
        spans = spans.tolist()
        groups = [";".join(text[w:v]) if ok else ""
                  for w, v, ok in zip(spans, spans[1:], good.tolist(), strict=False)]
        begin = np.searchsorted(held, np.arange(rows + 1) * len(self.pairs))
        return n, groups, begin, held % len(self.pairs), times


@lru_cache(maxsize=1)
def aligner(a: bytes, b: bytes) -> Aligner:
    """The aligner of two files, made once in each worker process."""
    return Aligner(a, b)


def aligned(docs: DataFrame, a: str = VOCABULARY, b: str = MODEL, text: str = "text") -> DataFrame:
    """`docs` with n_a and n_b (tokens), `groups` (`a1,a2|b1;a3|b2,b3`, ids in order), and the distinct
    `links` of the text, as places in `pairs_of(a, b)`, with how often it has each (`times`)."""
    specs = shipped(docs, a), shipped(docs, b)
    new = ("n_a", "n_b", "groups", "links", "times")
    kept = docs.drop(*new)
    columns = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*(s.value for s in specs))
        for batch in batches:
            for part in by_group(batch, text):
                (n_a, n_b), groups, to, links, times = both.align(*buffers(part.column(text)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(n_a), pa.array(n_b),
                     pa.array(groups, pa.string()), *(pa.ListArray.from_arrays(
                         pa.array(to.astype(np.int32)), pa.array(x.astype(np.int32)))
                         for x in (links, times))], [*columns, *new])

    empty = F.array().cast("array<int>")
    schema = kept.withColumns({"n_a": F.lit(0).cast("long"), "n_b": F.lit(0).cast("long"),
                               "groups": F.lit(""), "links": empty, "times": empty}).schema
    return kept.mapInArrow(run, schema)


def pairs_of(a: str = VOCABULARY, b: str = MODEL) -> np.ndarray:
    """The pairs of ids that can be linked, as a << 32 | b: what `links` are places in."""
    with open(a, "rb") as x, open(b, "rb") as y:
        return linkable(ByteBpe(x.read(), special=False).piece, Pieces(y.read()).piece)


def counted(rows: DataFrame, size: int) -> np.ndarray:
    """How many links of all `rows` have each of the `size` pairs that there can be."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("links").flatten().to_numpy(),
                      batch.column("times").flatten().to_numpy())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["link", "n"])

    sums = rows.select("links", "times").mapInArrow(tally, "link long, n long").groupBy("link").agg(
        F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    table = sums.toArrow()  # at most `size` rows
    out[table.column("link").to_numpy()] = table.column("n").to_numpy()
    return out


def scored(rows: DataFrame, counts: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """`rows` with n_links, n_best (links whose count is the highest of their id of B) and count_sum
    in place of `links` and `times`."""
    best = np.zeros(int((pairs & 0xFFFFFFFF).max(initial=0)) + 1, np.int64)
    np.maximum.at(best, pairs & 0xFFFFFFFF, counts)
    top = counts == best[pairs & 0xFFFFFFFF]
    sent = rows.sparkSession.sparkContext.broadcast((counts, top))
    kept = rows.drop("links", "times", "n_links", "n_best", "count_sum")
    columns = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, top = sent.value
        for batch in batches:
            links = batch.column("links")
            link, times = links.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (
                times, times * top[link], times * counts[link])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns),
                 *(pa.array((s[bounds[1:]] - s[bounds[:-1]]).astype(np.int64)) for s in sums)],
                [*columns, "n_links", "n_best", "count_sum"])

    zero = F.lit(0).cast("long")
    return rows.mapInArrow(run, kept.withColumns(
        {"n_links": zero, "n_best": zero, "count_sum": zero}).schema)


def report(docs: DataFrame, a: str = VOCABULARY, b: str = MODEL) -> DataFrame:
    """A row for every row of `docs`: tokens, groups and links of its text, against all links."""
    groups = F.col("groups")
    rows = stored(aligned(docs.select("doc_id", "text"), a, b).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b",
        F.when(groups == "", 0).otherwise(F.regexp_count(groups, F.lit(";")) + 1).cast("long").alias("n_groups"),
        F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256)).alias("groups_sha256"),
        "links", "times"), "aligned")
    pairs = pairs_of(a, b)
    return scored(rows, counted(rows, len(pairs)), pairs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
