"""Merkle manifest, byte-level BPE and the alignment of two tokenizers against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ebbtide.llm import align, bpe, merkle
from ebbtide.llm.tokens import buffers

MIXED = ["", " ", "  a  b\n\n c ", "<|endoftext|>a  <|endoftext|><|endoftext|>  b <|endof", "text|>", "x" * 5000,
         "a" * 999, "é" * 300, "日本語テキスト" * 30, "'s't're I'll don't", "\x1c a\x1c\x1d  \x85b᠎ c​",
         "a b  c", "😀" * 50, "\x00 \x00", "  ", "a  ", "b", "a ▁ b", " ▁", "▁", "<s> </s> <unk> <0x0A>"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    bits = ["a", "b", "the", " ", "  ", "\n", "é", "ß", "1", "23", "!", "'s", "ing", "tion", "Ġ", "　",
            "<|endoftext|>", "▁", "xx", "日", "gurban"]
    made = ["".join(rng.choice([*bits, chr(rng.randrange(32, 0x3000))]) for _ in range(rng.randrange(1, 40)))
            for _ in range(1500)]
    planes = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}." for c in range(p, p + 16))
              for p in range(0, 0x20000, 4096) if not 0xD800 <= p < 0xE000]
    return MIXED + made + planes


@pytest.fixture(scope="module")
def spec():
    with open(bpe.VOCABULARY, "rb") as f:
        return f.read()


def library(plain=False):
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = plain
    return t


@pytest.mark.parametrize("plain", [False, True])
def test_bpe_is_that_of_the_library(texts, spec, plain):
    own, lib = bpe.ByteBpe(spec, special=not plain), library(plain)
    for step in (1, 400):
        some = texts[:60] if step == 1 else texts
        for k in range(0, len(some), step):
            part = some[k:k + step]
            ids, to = own.encode(*buffers(pa.array(part)))
            want = lib.encode_batch(part, add_special_tokens=False)
            for j, w in enumerate(want):
                got = ids[to[j]:to[j + 1]]
                assert got.tolist() == w.ids, part[j]
                assert own.decode(got.astype("<u4").tobytes()) == lib.decode(w.ids, skip_special_tokens=False)


def test_a_pair_clashes_where_the_merges_of_both_are_not_the_two(spec):
    """Every verdict on neighbours against the merges of their bytes."""
    own, rng = bpe.ByteBpe(spec), random.Random(4)
    words = [w.encode() for w in ("unbelievable", "aaaaaaaa", " international", "tokenisation", "zzzzzz", "  \n\n ")]
    tokens = [own.token[w[i:j]] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)
              if w[i:j] in own.token] + [rng.randrange(50256) for _ in range(300)]
    a, b = (np.array([rng.choice(tokens) for _ in range(20_000)]) for _ in range(2))
    want = [own.merge(own.piece[x] + own.piece[y]) != [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert own.clash(a, b).tolist() == want and 200 < sum(want) < 19_800


def test_short_and_long_words_take_the_same_tokens(spec):
    own, rng = bpe.ByteBpe(spec), random.Random(5)
    words = ["".join(rng.choice("aeintrs") for _ in range(rng.randrange(1, 40))).encode() for _ in range(500)]
    for together, alone in ((own.proposals, own.propose), (own.merged, own.merge)):
        ids, owner = together(words)
        assert [ids[owner == k].tolist() for k in range(len(words))] == [alone(w) for w in words]


def test_a_small_memo_changes_nothing(texts, spec):
    own = bpe.ByteBpe(spec)
    raw = [buffers(pa.array(texts[k:k + 50])) for k in range(0, len(texts), 50)]
    want = [own.encode(*r)[0].tolist() for r in raw]
    own.memo = bpe.Memo(10)
    assert [own.encode(*r)[0].tolist() for r in raw] == want


def test_a_vocabulary_without_order_is_refused(spec):
    import json
    broken = json.loads(spec)
    broken["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        bpe.ByteBpe(json.dumps(broken).encode())


def test_digests_of_any_table(docs, none, rows):
    lib = library()

    def want(r):
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        text = lib.decode(ids, skip_special_tokens=False)
        return (r[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())

    got = bpe.digests(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(want, rows), key=str)
    assert bpe.digests(none).columns == bpe.digests(docs).columns and not bpe.digests(none).count()


def test_encode_and_decode_keep_other_columns(docs):
    """Columns called like the new ones are replaced, all others are kept."""
    given = docs.withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(given))
    assert set(out.columns) == set(given.columns)
    assert not out.filter(F.col("decoded") != F.coalesce("text", F.lit(""))).count()
    assert out.select("size", "rank").distinct().count() == docs.select("size", "rank").distinct().count()


def plain_alignment(text, lib, model, a_piece, b_piece):
    full = (" " + text).encode()
    a, b = lib.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    x, y = [a_piece[i] for i in a], [b_piece[i] for i in b]
    if not text or b"".join(x) != full or b"".join(y) != full:
        return 0, 0, "", Counter()
    ends = [np.cumsum([len(p) for p in z]).tolist() for z in (x, y)]
    groups, links, s, t = [], Counter(), 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        u, v = ends[0].index(e) + 1, ends[1].index(e) + 1
        groups.append(",".join(map(str, a[s:u])) + "|" + ",".join(map(str, b[t:v])))
        links[a[u - 1], b[v - 1]] += 1
        s, t = u, v
    return len(a), len(b), ";".join(groups), links


@pytest.fixture(scope="module")
def aligners(spec):
    with open(align.MODEL, "rb") as f:
        own = align.Aligner(spec, f.read())
    model = sentencepiece.SentencePieceProcessor(model_file=align.MODEL)
    lib = library(True)
    return own, lambda t: plain_alignment(t, lib, model, own.a.piece, own.b.piece)


@pytest.mark.parametrize("parted", [True, False])
def test_alignment_is_that_of_whole_texts(texts, aligners, parted, monkeypatch):
    """Also for a model whose texts cannot be parted at spaces."""
    own, plain = aligners
    monkeypatch.setattr(own.b, "parted", parted)
    some = [t for t in texts if len(t) < 2000][:len(texts) if parted else 300]
    n, groups, to, links, times = own.align(*buffers(pa.array(some)))
    for k, t in enumerate(some):
        mine = {(int(own.pairs[x]) >> 32, int(own.pairs[x]) & 0xFFFFFFFF): int(c) for x, c in zip(
            links[to[k]:to[k + 1]], times[to[k]:to[k + 1]], strict=True)}
        assert (n[0][k], n[1][k], groups[k], mine) == plain(t), t


def test_every_pair_that_can_be_linked_is_a_suffix():
    a, b = [b"a", b"ba", b" the", b"\xc3"], [b"a", b"e", b"cba", b" the", b"a"]
    want = sorted(i << 32 | j for i, x in enumerate(a) for j, y in enumerate(b) if x.endswith(y) or y.endswith(x))
    assert align.linkable(a, b).tolist() == want


def test_alignment_report_of_any_table(docs, none, rows, aligners):
    _, plain = aligners
    found = {t: plain(t or "") for t in {r[1] for r in rows}}
    count = Counter()
    for r in rows:
        count.update(found[r[1]][3])
    best = defaultdict(int)
    for (_, b), c in count.items():
        best[b] = max(best[b], c)
    want = []
    for r in rows:
        n_a, n_b, groups, links = found[r[1]]
        want.append((r[0], n_a, n_b, groups.count(";") + 1 if groups else 0, sum(links.values()),
                     sum(c for p, c in links.items() if count[p] == best[p[1]]),
                     sum(c * count[p] for p, c in links.items()),
                     hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    got = align.report(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert not align.report(none).count()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fanout):
    """(tree, place, leaf, subroot, root, siblings) of every row, level by level."""
    def tower(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            x = levels[-1]
            levels.append([h(*x[i:i + fanout]) for i in range(0, len(x), fanout)])
        return levels

    def siblings(levels, place):
        out = []
        for x in levels[:-1]:
            start = place // fanout * fanout
            out += [d for i, d in enumerate(x[start:start + fanout], start) if i != place]
            place //= fanout
        return out

    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf = h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])
        trees["" if lang is None else "=" + lang].append((doc_id is not None, doc_id or 0, leaf, doc_id))
    names = sorted(trees, key=lambda n: n.encode())
    towers = {n: tower([x[2] for x in sorted(trees[n])]) for n in names}
    top = tower([towers[n][-1][0] for n in names])
    return [(d, leaf, towers[n][-1][0], top[-1][0], "".join(siblings(towers[n], k) + siblings(top, i)))
            for i, n in enumerate(names) for k, (_, _, leaf, d) in enumerate(sorted(trees[n]))]


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 2), (2, 8), (3, 9), (5, 4)])
def test_manifest_is_that_of_plain_trees(spark, docs, rows, fanout, block):
    got = merkle.manifest(docs, fanout=fanout, block=block)
    mine = sorted((r.doc_id, r.digest, r.subroot, r.root, r.proof) for r in got.collect())
    assert mine == sorted(plain_manifest(rows, fanout))
    checked = merkle.verified(got, fanout=fanout).collect()
    assert all(r.verified and r.folded_root == r.root for r in checked)


def test_manifest_of_null_ids_many_trees_and_slices(spark, none, monkeypatch):
    monkeypatch.setattr(merkle, "SLICE", 7)
    rng = random.Random(2)
    made = [(None if i % 11 == 0 else i % 70, f"t{i % 40}", rng.choice([None, "", "a", "é", "z" * 3, "one", "hot", "hot"]),
             None, i % 5 or None, "x", i) for i in range(150)] + [(5, "only", "lone", "s", 1, "x", 0)]
    docs = spark.createDataFrame(made, none.schema).repartition(6)
    got = merkle.manifest(docs, block=4)
    mine = sorted(((r.doc_id is not None, r.doc_id or 0), r.digest, r.subroot, r.root, r.proof) for r in got.collect())
    want = sorted(((d is not None, d or 0), *rest) for d, *rest in plain_manifest(made, 2))
    assert mine == want
    out = merkle.audit(docs).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in out) and {r.verified for r in out} == {True, False}


@pytest.mark.parametrize("some", [[], [(1, "t", None, None, None, "x", 1)], [(1, "t", "a", "s", 2, "x", 1)] * 2])
def test_manifest_of_few_rows(spark, none, some):
    got = merkle.audit(spark.createDataFrame(some, none.schema)).collect()
    assert len(got) == len(some)
    want = plain_manifest(some, 2) if some else []
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == sorted(
        (d, leaf, s, r, h(p)) for d, leaf, s, r, p in want)


def test_only_tampered_rows_fail(docs, rows):
    import zlib
    hit = lambda r: zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
    counted = docs.withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.length("text")).cast("long"))
    bad = {r.doc_id for r in merkle.audit(counted).filter("not verified").collect()}
    want = {r[0] for r in rows if hit((*r[:4], len(r[1]) if r[0] % 2 == 0 and r[1] is not None else None))}
    assert bad == want and want
