"""Language-model scoring by a hierarchical Pitman-Yor model.

Every word is a context: a Pitman-Yor restaurant of the words that follow it (the start of a text
is one more context, its end one more word). All contexts send their tables to one restaurant
without context, whose tables are labelled by a spelling model: one restaurant per context of two
previous bytes, which send theirs to the restaurants of one previous byte, those to a restaurant
without context, and that to the uniform distribution. A token's probability in a restaurant is

    (c - d * t + (theta + d * T) * parent) / (theta + N)

for c customers at t tables. Words outside the training texts are one class, as in the base score;
its probability without context is (theta + d * T) / (theta + N) times what the spelling model
leaves to words outside the training texts. Gibbs sampling begins with one table for each pair of
a context and a word. Sweeps seat the customers of every word anew, given the spelling model and
the number of all tables, then those of the spelling contexts; after `BURN` of them the contexts
are seated given the words, and their tables are the customers of the sweeps that follow, whose
probabilities are averaged.

Counts, seats and sums are per word or pair and never gathered. What is broadcast is bounded: the
cells of the spelling model (at most 258 * 258 * 257, by bytes), and the words that hold at least
one in `RARE` of the tokens (at most `RARE` of them). Pairs meet in buckets, whose number follows
the tokens: by a context that is rare, else by a word that is rare, else by both, so no frequent
word is a key of a shuffle and a rare context is in one place. A document sends a pair once for
each time that it holds it, and texts travel as numbers of frequent words or hashes, compressed.
Random numbers depend on pair or word, sweep and step alone, so lost work is repeated alike.

Defined results: null and empty texts are one end token; rows of one doc_id are one document and
scored together; without training text every token has base score 0 and the spelling model is
uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, stored
from .tokens import CHUNK, U, Words, chunks, mix

FOLDS, HELD = 5, 1
SWEEPS, BURN = 4, 2
STRENGTH = 5.0
#: The strength of a context.
CONTEXT = 1.0
RARE = 1_000_000
#: Customers that are seated one by one; later ones are seated in blocks of two per cent.
SINGLE = 256
BUCKET_TOKENS = 1_000_000
_END, _START, _SYMBOLS = 256, 257, 257


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text modulo FOLDS is HELD."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    bits = mix(seed ^ U((step * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))
    return (bits >> U(11)).astype(np.float64) * 2.0 ** -53


def seat(counts: np.ndarray, weight: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """Tables of each dish after seating its customers one after another.

    A customer opens a table with odds `weight` against the customers before it less the
    discounts of their tables. Beyond SINGLE customers the new tables of a block are their expected
    number, rounded at random.
    """
    order = np.argsort(-counts, kind="stable")
    c, w, s = counts[order], weight[order], seed[order]
    tables = (c > 0).astype(np.float64)
    k = 1
    live = int(np.searchsorted(-c, -k, "left"))  # dishes with more than k customers
    while live:
        many = 1 if k < SINGLE else max(1, k // 50)
        t = tables[:live]
        # The last block of a dish may be shorter than the others.
        block = np.minimum(many, c[:live] - k)
        odds = w[:live] / (w[:live] + np.maximum(k + (block - 1) / 2 - discount * t, 1e-12))
        expected = block * odds
        whole = np.floor(expected)
        tables[:live] += whole + (_uniform(s[:live], k) < expected - whole)
        k += many
        live = int(np.searchsorted(-c, -k, "left"))
    out = np.zeros(len(counts))
    out[order] = tables
    return out


@dataclass
class Spelling:
    """The predictive probabilities of bytes, and of a word's end, after two previous bytes."""

    keys: np.ndarray   # seen (context, byte) cells, sorted
    values: np.ndarray  # their probability
    second: np.ndarray  # what is left to the shorter context, by context of two bytes
    first: np.ndarray  # probability after one byte

    def events(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return events(words)

    def probability(self, words: Words) -> np.ndarray:
        """Log-probability of each word, its end included; the empty word is an end alone."""
        cell, owner, n = events(words)
        out = np.zeros(n)
        if len(cell):
            context, symbol = cell // _SYMBOLS, cell % _SYMBOLS
            p = self.second[context] * self.first[context % 258, symbol]
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, cell), len(self.keys) - 1)
                hit = self.keys[at] == cell
                p[hit] = self.values[at[hit]]
            out = np.bincount(owner, np.log(p), n)
        return out


def events(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (context of two bytes, symbol) of texts of one word each, their text, and the texts."""
    n = len(words.at) - 1
    size = np.zeros(n, np.int64)
    begin = np.zeros(n, np.int64)
    some = np.diff(words.at) > 0
    size[some] = (words.end - words.start)[words.at[:-1][some]]
    begin[some] = words.start[words.at[:-1][some]]
    total = int((size + 1).sum())
    owner = np.repeat(np.arange(n), size + 1)
    first = np.cumsum(size + 1) - (size + 1)
    place = np.arange(total) - first[owner]
    byte = np.append(words.low, 0).astype(np.int64)

    def at(back: int) -> np.ndarray:
        p = np.minimum(begin[owner] + np.maximum(place - back, 0), len(byte) - 1)
        return np.where(place >= back, byte[p], _START)

    symbol = np.where(place == size[owner], _END, at(0))
    return (at(2) * 258 + at(1)) * _SYMBOLS + symbol, owner, n


def spelling(keys: np.ndarray, counts: np.ndarray, sweep: int, discount: float = 0.5,
             strength: float = 1.0, sweeps: int = 2) -> Spelling:
    """Seat the customers of the spelling restaurants and give their predictive probabilities."""
    uniform = 1.0 / _SYMBOLS
    context, symbol = keys // _SYMBOLS, keys % _SYMBOLS
    short = (context % 258) * _SYMBOLS + symbol
    base1 = np.full((258, _SYMBOLS), uniform)
    base0 = np.full(_SYMBOLS, uniform)
    second = np.ones(258 * 258)
    p2 = np.zeros(0)
    tables2 = np.bincount(context, minlength=258 * 258).astype(float)
    tables1 = np.ones(258)
    tables0 = 1.0
    for k in range(sweeps if len(keys) else 0):
        seed = mix(keys.astype(U) ^ U(97 * sweep + k + 1))
        t2 = seat(counts, (strength + discount * tables2[context]) * base1.reshape(-1)[short],
                  discount, seed)
        tables2 = np.bincount(context, t2, 258 * 258)
        c1 = np.bincount(short, t2, 258 * _SYMBOLS)
        cells1 = np.flatnonzero(c1)
        of1, sym1 = cells1 // _SYMBOLS, cells1 % _SYMBOLS
        t1 = seat(c1[cells1], (strength + discount * tables1[of1]) * base0[sym1], discount,
                  mix(cells1.astype(U) ^ U(89 * sweep + k + 7)))
        tables1 = np.bincount(of1, t1, 258)
        c0 = np.bincount(sym1, t1, _SYMBOLS)
        t0 = seat(c0, (strength + discount * tables0) * np.full(_SYMBOLS, uniform), discount,
                  mix(np.arange(_SYMBOLS, dtype=U) ^ U(83 * sweep + k + 3)))
        tables0 = float(t0.sum())
        base0 = (np.maximum(c0 - discount * t0, 0) + (strength + discount * tables0) * uniform) / (
            strength + c0.sum())
        size1 = np.bincount(of1, c1[cells1], 258)
        base1 = ((strength + discount * tables1) / (strength + size1))[:, None] * base0[None, :]
        base1[of1, sym1] += np.maximum(c1[cells1] - discount * t1, 0) / (strength + size1)[of1]
        size2 = np.bincount(context, counts, 258 * 258)
        second = (strength + discount * tables2) / (strength + size2)
        p2 = np.maximum(counts - discount * t2, 0) / (strength + size2)[context] \
            + second[context] * base1.reshape(-1)[short]
    return Spelling(keys, p2 if len(keys) else np.zeros(0), second, base1)


@dataclass
class State:
    """One sweep: the spelling model that it seats by, its own seed, and all tables so far."""

    model: Spelling
    tables: float
    number: int


def _tables(words: Words, counts: np.ndarray, state: State, discount: float) -> np.ndarray:
    hashes = np.zeros(len(counts), U)
    some = np.diff(words.at) > 0
    hashes[some] = words.hash[words.at[:-1][some]]
    weight = (STRENGTH + discount * state.tables) * np.exp(state.model.probability(words))
    return seat(counts, weight, discount, mix(hashes ^ U(state.number * 1_000_003)))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and its count in training texts; the empty word is the end of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offs in chunks(batch.column("text"), 4 * CHUNK):
                w = Words(raw, offs)
                _, first, count = np.unique(w.hash, return_index=True, return_counts=True)
                size = w.end[first] - w.start[first]
                to = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                pick = np.arange(to[-1]) - np.repeat(to[:-1], size) + np.repeat(w.start[first], size)
                text = pa.LargeStringArray.from_buffers(
                    len(first), pa.py_buffer(to), pa.py_buffer(w.low[pick].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [text.cast(pa.string()), pa.array(count.astype(np.int64))], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([""]), pa.array([batch.num_rows])], ["word", "n"])

    return docs.filter("train").select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


def _sweep(vocab: DataFrame, state: State, discount: float) -> tuple[Spelling, float]:
    """Seat all words; the spelling model of their tables, and how many there are."""
    shared = vocab.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("customers").to_numpy(zero_copy_only=False)
            for a, b, raw, offs in chunks(batch.column("word")):
                words = Words(raw, offs)
                tables = _tables(words, counts[a:b], shared.value, discount)
                cell, owner, _ = events(words)
                keys, inverse = np.unique(cell, return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(keys, -1)),
                    pa.array(np.append(np.bincount(inverse, tables[owner], len(keys)),
                                       tables.sum()))], ["cell", "tables"])

    cells = vocab.select("word", "customers").mapInArrow(
        run, "cell long, tables double").groupBy("cell").agg(F.sum("tables").alias("tables"))
    # As many rows as there are cells of bytes: a bound that does not grow with the corpus.
    got = cells.orderBy("cell").toArrow()
    keys = got.column("cell").to_numpy()
    values = got.column("tables").to_numpy()
    shared.unpersist()
    inner = (keys >= 0) & (values > 0)
    return (spelling(keys[inner], values[inner], state.number + 1),
            float(values[keys < 0].sum()))


def _word_scores(words: DataFrame, states: list[State], after: list[tuple[Spelling, float]],
                 discount: float, total: int, distinct: int, customers: float) -> DataFrame:
    """word, hash, n, log10 base probability, and the probabilities `before` and `model` of a word."""
    shared = words.sparkSession.sparkContext.broadcast((states, after))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, after = shared.value
        for batch in batches:
            counts = batch.column("n").to_numpy(zero_copy_only=False)
            seated = batch.column("customers").to_numpy(zero_copy_only=False)
            for a, b, raw, offs in chunks(batch.column("word")):
                texts, c = Words(raw, offs), seated[a:b]
                p = np.zeros(b - a)
                for state, (model, tables) in zip(states, after, strict=True):
                    own = np.maximum(c - discount * _tables(texts, c, state, discount), 0)
                    p += (own + (STRENGTH + discount * tables) * np.exp(model.probability(texts))
                          ) / (STRENGTH + customers)
                base = np.log10((counts[a:b] + 0.5) / (total + 0.5 * (distinct + 1)))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(x).slice(a, b - a) for x in ("word", "hash", "n")],
                    pa.array(base), batch.column("before").slice(a, b - a),
                    pa.array(np.maximum(p / len(states), 1e-300))],
                    ["word", "hash", "n", "base", "before", "model"])

    return words.select("word", "hash", "n", "customers", "before").mapInArrow(
        run, "word string, hash long, n long, base double, before double, model double")


def _known_mass(vocab: DataFrame, models: list[Spelling]) -> list[float]:
    """The share of each spelling model that goes to words of the vocabulary."""
    shared = vocab.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offs in chunks(batch.column("word")):
                words = Words(raw, offs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(range(len(models)))),
                    pa.array([float(np.exp(m.probability(words)).sum()) for m in shared.value])],
                    ["k", "mass"])

    sums = {r["k"]: r["mass"] for r in vocab.select("word").mapInArrow(
        run, "k long, mass double").groupBy("k").agg(F.sum("mass").alias("mass")).collect()}
    return [min(1.0, sums.get(k, 0.0)) for k in range(len(models))]


_SUMS = ["n_tokens", "n_known", "base_score", "score"]
_PARTIAL = "doc_id long, n_tokens long, n_known long, base_score double, score double"
#: The keys of a text's end and start; a word's key is its hash with the highest bit set.
_ENDS, _STARTS, _TOP = U(0), U(1), U(1 << 63)
_CODEC = pa.Codec("zstd", compression_level=1)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits, equally long, as one compressed value: byte by byte, as most bytes repeat."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return len(columns[0]).to_bytes(8, "little") + _CODEC.compress(b"".join(planes), asbytes=True)


def _unpack(packed: pa.ChunkedArray, columns: int) -> list[np.ndarray]:
    """The columns of all values of a column, one after another."""
    out: list[list[np.ndarray]] = [[np.zeros(0, U)] for _ in range(columns)]
    for value in packed.to_pylist():
        if value is None:
            continue
        n = int.from_bytes(value[:8], "little")
        raw = _CODEC.decompress(value[8:], 8 * columns * n)
        planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, n)
        for k, runs in enumerate(out):
            runs.append(np.ascontiguousarray(planes[k].T).view(U).reshape(n))
    return [np.concatenate(runs) for runs in out]


def _find(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return at, keys[at] == hashes


def _rare(codes: np.ndarray) -> np.ndarray:
    return codes >= _TOP


@dataclass
class Frequent:
    """Frequent words by number, then the start and the end of a text. Other words are their key."""

    sorted: np.ndarray  # their keys
    number: np.ndarray  # and numbers
    keys: np.ndarray  # keys by number, start and end included
    n: np.ndarray  # customers of each as a context
    buckets: int

    def pairs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context and word of every token, ends included, and its text."""
        key = words.hash | _TOP
        at, hit = _find(self.sorted, key)
        if len(self.sorted):
            key = np.where(hit, self.number[at].astype(U), key)
        size = np.diff(words.at) + 1
        last = np.cumsum(size) - 1
        word = np.empty(int(size.sum()), U)
        inner = np.ones(len(word), bool)
        inner[last] = False
        word[inner] = key
        word[last] = U(len(self.keys) - 1)
        context = np.roll(word, 1)
        context[last - size + 1] = U(len(self.keys) - 2)
        return context, word, np.repeat(np.arange(len(size)), size)

    def key(self, codes: np.ndarray) -> np.ndarray:
        return np.where(_rare(codes), codes, self.keys[np.where(_rare(codes), U(0), codes)])

    def home(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The bucket of a pair: by a rare context, else by a rare word, else by both."""
        both = mix((context << U(32)) ^ word)
        by = np.where(_rare(context), mix(context), np.where(_rare(word), mix(word), both))
        return (by % U(self.buckets)).astype(np.int32)

    def of(self, codes: np.ndarray, by_number: np.ndarray, keys: np.ndarray, values: np.ndarray,
           missing: float = 0.0) -> np.ndarray:
        """A value of each code: of frequent ones by number, of others by their key."""
        rare = _rare(codes)
        order = np.argsort(keys)
        at, hit = _find(keys[order], codes)
        other = np.where(hit, values[order][at], missing) if len(keys) else missing
        return np.where(rare, other, by_number[np.where(rare, U(0), codes)])


def _spread(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One packed row for each bucket that has rows."""
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by digits
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    columns = tuple(c[order] for c in columns)
    to = np.append(first, len(order))
    return pa.RecordBatch.from_arrays([
        pa.array(names.astype(np.int32)),
        pa.array([_pack(*[c[a:b] for c in columns]) for a, b in zip(to[:-1], to[1:], strict=True)],
                 pa.binary())], ["bucket", "packed"])


def _runs(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of pairs in which equal ones are together, and the first row of each equal run."""
    short = [np.where(_rare(c), (c >> U(32)), c) for c in (context, word)]
    key = (short[0] << U(32)) | short[1]
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    c, w, k = context[order], word[order], key[order]
    new[1:] = k[1:] != k[:-1]
    mixed = ~new[1:] & ((c[1:] != c[:-1]) | (w[1:] != w[:-1]))
    if mixed.any():  # rare words that share half of their key
        run = np.cumsum(new)
        among = np.isin(run, run[1:][mixed])
        part = order[among]
        order[among] = part[np.lexsort((word[part], context[part], key[part]))]
        c, w = context[order], word[order]
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
    return order, np.flatnonzero(new)


def _counted(rows: DataFrame, frequent: Frequent) -> DataFrame:
    """Packed by bucket: context, word, training count and, of rare contexts, how many words follow.

    Pairs without a training text are kept where both are rare: their words are asked for as well.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for a, _, raw, offs in chunks(batch.column("text"), 4 * CHUNK):
                context, word, owner = f.pairs(Words(raw, offs))
                learnt = train[a + owner]
                keep = learnt | (_rare(context) & _rare(word))
                context, word, learnt = context[keep], word[keep], learnt[keep]
                order, first = _runs(context, word)
                if len(order):
                    n = np.add.reduceat(learnt[order].astype(U), first)
                    context, word = context[order][first], word[order][first]
                    yield _spread(f.home(context, word), context, word, n)

    def count(table: pa.Table) -> pa.Table:
        context, word, n = _unpack(table.column("packed"), 3)
        order, first = _runs(context, word)
        context, word, n = context[order][first], word[order][first], np.add.reduceat(n[order], first)
        kinds = _by_context(context, n > 0)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "packed": pa.array(
            [_pack(context, word, n, kinds.astype(U))], pa.binary())})

    dealt = rows.select("text", "train").mapInArrow(deal, "bucket int, packed binary")
    return dealt.repartition(frequent.buckets, "bucket").groupBy("bucket").applyInArrow(
        count, "bucket int, packed binary")


def _by_context(context: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each pair of a rare context the sum of values over all pairs of that context; else 0."""
    rare = np.flatnonzero(_rare(context))
    owner = np.unique(context[rare], return_inverse=True)[1]
    out = np.zeros(len(context))
    if len(rare):
        out[rare] = np.bincount(owner, values[rare])[owner]
    return out


def _sent(f: Frequent, context: np.ndarray, word: np.ndarray, tables: np.ndarray) -> pa.RecordBatch:
    """Tables of the frequent contexts (kind 0, by number) and those sent to words (kind 1, by key)."""
    often = ~_rare(context)
    numbers, a = np.unique(context[often], return_inverse=True)
    words, b = np.unique(word, return_inverse=True)
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(np.array([0, 1], np.int32), [len(numbers), len(words)])),
        pa.array(np.concatenate([numbers, f.key(words)]).view(np.int64)),
        pa.array(np.concatenate([np.bincount(a, tables[often], len(numbers)),
                                 np.bincount(b, tables, len(words))]))], ["kind", "key", "tables"])


_SENT = "kind int, key long, tables double"


def _first_tables(pairs: DataFrame, frequent: Frequent) -> DataFrame:
    """One table for each pair; and how many pairs have one and two customers (kind 2)."""
    shared = pairs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                context, word, n, _ = _unpack(pa.chunked_array([batch.column("packed").slice(k, 1)]), 4)
                yield _sent(shared.value, context[n > 0], word[n > 0], np.ones(int((n > 0).sum())))
                yield pa.RecordBatch.from_arrays([
                    pa.array([2, 2], pa.int32()), pa.array([1, 2]),
                    pa.array([float((n == 1).sum()), float((n == 2).sum())])],
                    ["kind", "key", "tables"])

    return _total(pairs.select("packed").mapInArrow(run, _SENT))


def _total(sent: DataFrame) -> DataFrame:
    return sent.groupBy("kind", "key").agg(F.sum("tables").alias("tables"))


def _asked(pairs: DataFrame, scores: DataFrame, frequent: Frequent, *columns: str, least: int = 0
           ) -> DataFrame:
    """bucket, hash and `columns` of the rare words of every bucket.

    A word of a frequent context is at home in its own bucket; of a rare one it is asked for.
    """
    buckets = frequent.buckets

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("hash").to_numpy(zero_copy_only=False).view(U)
            home = (mix(key) % U(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(home), *batch.columns],
                                             ["bucket", *batch.schema.names])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(batch.column("bucket").to_pylist()):
                context, word, n, _ = _unpack(pa.chunked_array([batch.column("packed").slice(k, 1)]), 4)
                word = np.unique(word[_rare(context) & _rare(word) & (n >= U(least))])
                home = (mix(word) % U(buckets)).astype(np.int32)
                word = word[home != name]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(word), name, np.int32)), pa.array(word.view(np.int64))],
                    ["bucket", "hash"])

    # The highest bit is set in the keys of words, which makes them negative.
    rare = scores.filter("NOT often").select("hash", *columns)
    asked = pairs.mapInArrow(ask, "bucket int, hash long").join(rare, "hash")
    fields = ", ".join(f"{c} double" for c in columns)
    return rare.mapInArrow(own, f"bucket int, hash long, {fields}").union(
        asked.select("bucket", "hash", *columns))


def _seat_pairs(context: np.ndarray, word: np.ndarray, n: np.ndarray, kinds: np.ndarray,
                parent: np.ndarray, discount: float, f: Frequent) -> np.ndarray:
    """Tables of each pair, given how many words follow its context and the word's probability."""
    tables = (n > 0).astype(float)
    some = np.flatnonzero(n > 1)  # a single customer has one table
    seed = mix(f.key(context[some]) ^ mix(f.key(word[some]) ^ U(0x51ED270B27B4A3F5)))
    tables[some] = seat(n[some].astype(float), (CONTEXT + discount * kinds[some]) * parent[some],
                        discount, seed)
    return tables


def _further_tables(pairs: DataFrame, asked: DataFrame, frequent: Frequent, kinds: np.ndarray,
                    parent: np.ndarray, discount: float) -> DataFrame:
    """The tables beyond the first of each pair, once contexts are seated given the words."""
    shared = pairs.sparkSession.sparkContext.broadcast((frequent, kinds, parent))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                part = _unpack(pa.chunked_array([batch.column("packed").slice(k, 1)]), 4)
                out.append(_pack(*[c[part[2] > 1] for c in part]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket"), pa.array(out, pa.binary())], ["bucket", "packed"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        f, by_number, p = shared.value
        context, word, n, own = _unpack(left.column("packed"), 4)
        follow = np.where(_rare(context), own, by_number[np.where(_rare(context), U(0), context)])
        base = f.of(word, p, right.column("hash").to_numpy().view(U), right.column("model").to_numpy())
        tables = _seat_pairs(context, word, n, follow, base, discount, f)
        return pa.Table.from_batches([_sent(f, context, word, tables - 1)])

    some_pairs = pairs.select("bucket", "packed").mapInArrow(some, "bucket int, packed binary")
    return some_pairs.repartition(frequent.buckets, "bucket").groupBy("bucket").cogroup(
        asked.groupBy("bucket")).applyInArrow(meet, _SENT)


def _by_number(frequent: Frequent, table: pa.Table, value: str, missing: float) -> np.ndarray:
    """A value of words by the number of frequent ones, the start and the end of a text."""
    keys = table.column("hash").to_numpy().view(U)
    order = np.argsort(keys)
    at, hit = _find(keys[order], frequent.keys)
    out = np.full(len(frequent.keys), missing)
    out[hit] = table.column(value).to_numpy()[order][at[hit]]
    return out


@dataclass
class Scored:
    """What all tasks need to score a bucket: values by the number of a frequent word."""

    frequent: Frequent
    kinds: np.ndarray  # words that follow it
    tables: np.ndarray  # its tables as a context
    base: np.ndarray  # log10 base probability
    before: np.ndarray  # probability that its contexts were seated by
    model: np.ndarray  # probability without context
    known: np.ndarray
    discount: float
    unknown: tuple[float, float]  # base and model of words outside the training texts


def _scored(rows: DataFrame, asked: DataFrame, known: Scored) -> DataFrame:
    """The sums of each document: its tokens meet the counts and tables of their pairs."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    buckets = known.frequent.buckets

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value.frequent
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for a, _, raw, offs in chunks(batch.column("text"), 4 * CHUNK):
                context, word, owner = f.pairs(Words(raw, offs))
                yield _spread(f.home(context, word), context, word, ids[a + owner].view(U),
                              train[a + owner].astype(U))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        k = shared.value
        f = k.frequent
        context, word, doc, train = _unpack(left.column("packed"), 4)
        if not len(context):
            return _EMPTY.empty_table()
        order, first = _runs(context, word)
        pair = np.zeros(len(order), np.int64)
        pair[first[1:]] = 1
        pair[order] = np.cumsum(pair)
        context, word, n = (context[order][first], word[order][first],
                            np.add.reduceat(train[order], first))
        keys = right.column("hash").to_numpy().view(U)
        base, before, model = (f.of(word, v, keys, right.column(c).to_numpy(), m) for c, v, m in (
            ("base", k.base, k.unknown[0]), ("before", k.before, 0.0), ("model", k.model, k.unknown[1])))
        hit = f.of(word, k.known, keys, np.ones(len(keys)))
        rare = _rare(context)
        number = np.where(rare, U(0), context)
        follow = np.where(rare, _by_context(context, n > 0), k.kinds[number])
        t = _seat_pairs(context, word, n, follow, before, k.discount, f)
        size = np.where(rare, _by_context(context, n.astype(float)), f.n[number])
        tables = np.where(rare, _by_context(context, t), k.tables[number])
        p = (np.maximum(n - k.discount * t, 0) + (CONTEXT + k.discount * tables) * model) / (CONTEXT + size)
        ids, owner = np.unique(doc, return_inverse=True)
        sums = [np.bincount(owner, minlength=len(ids)).astype(np.int64),
                np.bincount(owner, hit[pair], len(ids)).astype(np.int64),
                *[np.bincount(owner, v[pair], len(ids)) for v in (base, np.log10(p))]]
        # The documents of a bucket go on in as many lists as there are buckets, not as rows.
        part = _spread((mix(ids) % U(buckets)).astype(np.int32), ids, *[x.view(U) for x in sums])
        return pa.Table.from_batches([part])

    def total(table: pa.Table) -> pa.Table:
        doc, *sums = _unpack(table.column("packed"), 5)
        ids, owner = np.unique(doc, return_inverse=True)
        tokens, hits = (np.bincount(owner, x.view(np.int64), len(ids)).astype(np.int64) for x in sums[:2])
        base, model = (np.bincount(owner, x.view(np.float64), len(ids)) for x in sums[2:])
        return pa.table({"doc_id": ids.view(np.int64), "n_tokens": tokens, "n_known": hits,
                         "base_score": base, "score": model}, schema=_SCHEMA)

    dealt = rows.select("doc_id", "text", "train").mapInArrow(deal, "bucket int, packed binary")
    met = dealt.repartition(buckets, "bucket").groupBy("bucket").cogroup(
        asked.groupBy("bucket")).applyInArrow(meet, "bucket int, packed binary")
    return met.groupBy("bucket").applyInArrow(total, _PARTIAL)


_EMPTY = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])


def _keyed(vocab: DataFrame) -> DataFrame:
    """word, its key and its count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("hash", pa.array(_keys(batch.column("word")).view(np.int64)))

    return vocab.select("word", "n").mapInArrow(run, "word string, n long, hash long")


def _keys(column: pa.Array) -> np.ndarray:
    """The keys of texts of one word each; the empty word is the end of a text."""
    out = []
    for a, b, raw, offs in chunks(column):
        words = Words(raw, offs)
        keys = np.full(b - a, _ENDS, U)
        keys[np.diff(words.at) > 0] = words.hash | _TOP
        out.append(keys)
    return np.concatenate([np.zeros(0, U), *out])


def _discount(one: float | None, two: float | None) -> float:
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5


def _sweeps(words: DataFrame, state: State, discount: float, sweeps: int, burn: int
            ) -> tuple[State, list[State], list[tuple[Spelling, float]]]:
    """The state after some sweeps; of those after `burn`, what they seat by and come to."""
    states, after = [], []
    for k in range(sweeps):
        model, tables = _sweep(words, state, discount)
        if k >= burn:
            states.append(state)
            after.append((model, tables))
        state = State(model, tables, state.number + 1)
    return state, states, after


def _customers(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words with the tables that contexts sent to them, their customers."""
    sent = tables.filter("kind = 1").select(F.col("key").alias("hash"), F.col("tables").alias("customers"))
    return words.join(sent, "hash", "left").withColumn(
        "customers", F.coalesce("customers", F.lit(0.0)))


def score(docs: DataFrame, sweeps: int = SWEEPS, burn: int = BURN) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score and score."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                       "text", (~held_out(F.col("doc_id"))).alias("train"))
    vocab = stored(_keyed(vocabulary(rows)), "vocabulary")
    total, distinct, ends = vocab.agg(
        F.sum("n"), F.count(F.lit(1)), F.max(F.when(F.col("hash") == 0, F.col("n")))).first()
    total = total or 0
    # At most RARE words hold one in RARE of the tokens.
    often = (F.col("n") * RARE >= total) & (F.col("hash") != 0)
    got = vocab.filter(often).select("hash", "n").toArrow()
    keys, n = got.column("hash").to_numpy().view(U), got.column("n").to_numpy().astype(float)
    order = np.lexsort((keys, -n))
    keys, n = keys[order], n[order]
    rank = np.argsort(keys)
    frequent = Frequent(keys[rank], rank, np.append(keys, [_STARTS, _ENDS]),
                        np.append(n, [ends or 0, 0]), parts(total, BUCKET_TOKENS))
    pairs = stored(_counted(rows, frequent), "pairs")
    first = stored(_first_tables(pairs, frequent), "first-tables")
    seen = {r["key"]: r["tables"] for r in first.filter("kind = 2").collect()}
    inner = _discount(seen.get(1), seen.get(2))

    def of_contexts(tables: DataFrame) -> np.ndarray:
        got = tables.filter("kind = 0").toArrow()
        out = np.zeros(len(frequent.keys))
        out[got.column("key").to_numpy()] = got.column("tables").to_numpy()
        return out

    def seated(words: DataFrame, state: State, sweeps: int, burn: int):
        many, one, two = words.agg(F.sum("customers"), *[
            F.count(F.when(F.col("customers") == k, 1)) for k in (1, 2)]).first()
        discount = _discount(one, two)
        state, states, after = _sweeps(words, state, discount, sweeps, burn)
        scores = stored(_word_scores(words, states, after, discount, total, distinct, many or 0.0
                                     ).withColumn("often", often | (F.col("hash") == 0)), "word-scores")
        return scores, state, after, discount, many or 0.0

    words = stored(_customers(vocab, first).withColumn("before", F.lit(0.0)), "customers")
    nothing = np.zeros(0, np.int64)
    state = State(spelling(nothing, np.zeros(0), 0), float(distinct), 0)
    given, state, *_ = seated(words, state, max(1, burn), max(1, burn) - 1)
    kinds = of_contexts(first)
    parent = _by_number(frequent, given.filter("often").select("hash", "model").toArrow(), "model", 0.0)
    further = _further_tables(pairs, _asked(pairs, given, frequent, "model", least=2), frequent, kinds,
                              parent, inner)
    second = stored(_total(first.filter("kind < 2").union(further)), "second-tables")
    words = stored(_customers(given.select("word", "hash", "n", F.col("model").alias("before")), second),
                   "customers")
    scores, _, after, discount, many = seated(words, state, max(1, sweeps - burn), 0)
    fresh = [(STRENGTH + discount * t) / (STRENGTH + many) * max(1 - m, 1e-9) for (_, t), m in
             zip(after, _known_mass(vocab, [m for m, _ in after]), strict=True)]
    unknown = (float(np.log10(0.5 / (total + 0.5 * (distinct + 1)))) if total else 0.0,
               float(np.mean(fresh)) if total else 1.0)
    top = scores.filter("often").select("hash", "base", "before", "model").withColumn(
        "one", F.lit(1.0)).toArrow()
    base, before, model, known = (_by_number(frequent, top, c, m) for c, m in (
        ("base", unknown[0]), ("before", 0.0), ("model", unknown[1]), ("one", 0.0)))
    sums = _scored(rows, _asked(pairs, scores, frequent, "base", "before", "model"), Scored(
        frequent, kinds, of_contexts(second), base, before, model, known, inner, unknown))
    doc = F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id"))
    return sums.select(
        doc.alias("doc_id"), held_out(doc).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
