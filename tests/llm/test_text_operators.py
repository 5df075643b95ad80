"""Operators on text against brute force, with the defined results of their corner cases."""

import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from ebbtide.llm import licenses, lm, near, passages, spotsigs, wfst
from ebbtide.llm.tokens import Words, shingles


def words(text):
    return (text or "").encode().lower().split()


def grams(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def runs_of(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]))
    return shingles(w.hash, w.at)[0]


def one_each(rows):
    return {r[0]: r[1] for r in rows}


@pytest.mark.parametrize("texts", [["", "a"], ["a b", "", " c\td "], ["É é", "A  B\n", "x"], []])
def test_words_of_many_texts_are_those_of_each(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(int)
    w = Words(raw, offs)
    got = [[w.text(i) for i in range(w.at[k], w.at[k + 1])] for k in range(len(texts))]
    assert got == [words(t) for t in texts]
    assert len(set(w.hash.tolist())) == len({x for t in texts for x in words(t)})


def test_near_duplicates_match_all_pairs(docs, none, rows):
    sets = {k: grams(t) for k, t in one_each(rows).items()}
    lead = {k: k for k in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            lead[y] = x
    got = near.classes(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))
        assert r.kept == (r.doc_id == r.component_id)
    kept = near.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(k) for k in sets})
    assert near.classes(none).count() == 0


def test_rows_without_doc_id_stay(spark):
    rows = [(None, "a b c d e f"), (None, "other words stand here alone"), (1, "a b c d e f"),
            (2, "a b c d e f")]
    got = near.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows[:3]))


def test_large_nodes_branch_without_losing_links(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows, k = [], 0
    for _ in range(60):  # similar to the base text, some less than 0.75 among each other
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(200)] = f"x{rng.randrange(10 ** 9)}"
        rows.append((k, " ".join(w)))
        k += 1
    rows += [(1000 + i, " ".join(base[:7] + [f"y{i}{j}" for j in range(150)])) for i in range(40)]
    sets = {i: grams(t) for i, t in rows}
    lead = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(lead[a], lead[b])
            if lead[a] != low or lead[b] != low:
                lead[a] = lead[b] = low
                changed = True
    # One block; many blocks; clusters that branch before they are compared.
    for block, above in ((700, 20_000), (6, 20_000), (6, 25)):
        monkeypatch.setattr(near, "SMALL", 3)
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "BRANCH_ABOVE", above)
        got = near.classes(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r.doc_id: r.component_id for r in got.collect()} == lead


def test_compact_windows_are_the_groups_of_equal_minimum():
    rng = np.random.default_rng(2)
    for n in (0, 4, 7, 40, 120):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        h[n // 2:n // 2 + 3] = h[:3] if n > 20 else h[n // 2:n // 2 + 3]
        best = {}
        for i in range(n):
            for j in range(i + 6, n):
                c = min(range(i, j + 1), key=lambda k: (int(h[k]), k))
                best.setdefault(c, []).append((i, j))
        want = sorted((min(i for i, _ in v), c, max(j for _, j in v)) for c, v in best.items())
        assert sorted(passages.compact_windows(h, 7)) == want


def test_shared_passages_are_found_and_removed(docs, none, rows):
    texts = one_each(rows)
    found = passages.repeats(docs)
    spans = {}
    for r in found.collect():
        assert r.other_id < r.doc_id and r.similarity >= 0.75 and r.end_word - r.start_word >= 50
        a = grams(b" ".join(words(texts[r.doc_id])[r.start_word:r.end_word]).decode("utf-8", "replace"))
        b = grams(b" ".join(words(texts[r.other_id])[r.other_start:r.other_end]).decode("utf-8", "replace"))
        assert len(a & b) / len(a | b) == pytest.approx(r.similarity)
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    first, repeated = {}, set()
    for k in sorted(texts):
        r = runs_of(texts[k])
        for i in range(len(r) - passages.LEAST_RUN + 1):
            key = r[i:i + passages.LEAST_RUN].tobytes()
            if first.setdefault(key, k) != k:
                repeated.add(k)
                assert any(a <= i and i + 50 <= b for a, b in spans[k])
    assert repeated <= set(spans)
    left = passages.remove(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        if r.doc_id not in spans:
            assert r.text == texts[r.doc_id]
        else:
            gone = {i for a, b in spans[r.doc_id] for i in range(a, b)}
            keep = [w for i, w in enumerate(words(texts[r.doc_id])) if i not in gone]
            assert words(r.text) == keep
        assert r.n_chars == len(r.text or "")
    assert passages.repeats(none).count() == 0 and passages.remove(none).count() == 0


def test_passages_of_frequent_lines_meet_a_holder_of_the_whole(spark):
    rng = random.Random(12)
    line = lambda n: " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(n))
    rows = []
    for k in range(12):
        lines = [line(10) for _ in range(5)]
        # Earlier texts hold every two or three lines in succession, none of them all five.
        parts = [lines[a:a + n] for n in (2, 3) for a in range(6 - n)]
        texts = [f"{line(30)} {' '.join(p)} {line(30)}" for p in parts]
        texts += [f"{line(40)} {' '.join(lines)} {line(40)}" for _ in range(3)]
        rows += [(100 * k + i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = {(r.doc_id, r.other_id): (r.start_word, r.end_word)
             for r in passages.repeats(frame).collect()}
    for k in range(12):
        for i in (8, 9):
            assert spans[100 * k + i, 100 * k + 7] == (40, 90)


@pytest.mark.parametrize("words_", [50, 57, 60, 75, 100])
def test_a_replaced_word_leaves_the_longest_run_from_every_anchor(words_):
    n, pad = words_ - 4, 10
    for edit in range(words_):
        a = np.arange(n + 2 * pad).astype(np.uint64)
        same = (a >= pad) & (a < pad + n)
        same[pad + max(0, edit - 4):pad + min(n, edit + 1)] = False
        b = np.where(same, a, a + np.uint64(1000))
        score = np.concatenate([[0], np.cumsum(np.where(same, 1, -6))])
        equal = np.flatnonzero(same)
        for i in equal[[0, len(equal) // 4, len(equal) // 2, -1]]:
            spans = [(e - s, s, e) for s in range(i + 1) for e in range(i + 1, len(score))
                     if score[e] >= score[s]]
            most = max(spans)[0]
            longest = {(int(equal[equal >= s][0]), int(equal[equal < e][-1]) + 1)
                       for size, s, e in spans if size == most}
            assert passages._follow(a, b, int(i), int(i)) in longest


def test_passages_with_a_replaced_word_are_found(spark):
    rng = random.Random(4)
    line = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    rows, k = [], 0
    for edit in range(5, 45):
        for _ in range(4):
            passage = line(50)
            changed = passage[:edit] + line(1) + passage[edit + 1:]
            rows += [(k, " ".join(line(40) + passage + line(40))),
                     (k + 1, " ".join(line(40) + changed + line(40)))]
            k += 2
    got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {r.doc_id for r in got if r.start_word <= 40 and r.end_word >= 90}
    assert len(whole) >= 0.95 * len(rows) / 2


def test_every_pair_of_spans_that_are_alike_is_in_a_passage():
    rng = random.Random(31)
    least, met = passages.LEAST_RUN, 0
    for case in range(60):
        fresh = iter(range(10 ** 6 * (case + 1), 10 ** 6 * (case + 2)))
        base = [next(fresh) for _ in range(rng.randint(50, 72))]
        a, b = list(base), list(base)
        for _ in range(rng.randint(0, 3)):  # words are put in, left out, replaced or moved
            side, at, n = rng.choice([a, b]), rng.randrange(50), rng.randint(1, 3)
            kind = rng.randrange(4)
            if kind == 0:
                side[at:at] = [next(fresh) for _ in range(n)]
            elif kind == 1:
                del side[at:at + n]
            elif kind == 2:
                side[at:at + 1] = [next(fresh)]
            else:
                side[:] = side[at:] + side[:at]
        a, b = ([next(fresh) for _ in range(6)] + x + [next(fresh) for _ in range(6)] for x in (a, b))
        x, y = (np.array([hash(tuple(w[k:k + 5])) for k in range(len(w) - 4)]).astype(np.uint64) for w in (a, b))
        bit = {h: 1 << k for k, h in enumerate(dict.fromkeys([*x.tolist(), *y.tolist()]))}
        both = set(x.tolist()) & set(y.tolist())
        theirs = [k for k, h in enumerate(y.tolist()) if h in both]
        ends = [k for k, h in enumerate(x.tolist()) if h in both]
        masks = []
        for t in theirs:
            mask = 0
            for u in range(t, len(y)):
                mask |= bit[int(y[u])]
                if u in theirs:
                    masks.append(mask)
        got = passages.aligned(x, y)
        for s, e, t, u, p in got:
            assert e - s >= least and p >= 0.75
            assert p == pytest.approx(len(set(x[s:e]) & set(y[t:u])) / len(set(x[s:e]) | set(y[t:u])))
        for s in ends:
            for e in (e + 1 for e in ends if e + 1 - s >= least):
                mine = sum(bit[h] for h in set(x[s:e].tolist()))
                if any(4 * (mine & m).bit_count() >= 3 * (mine | m).bit_count() for m in masks):
                    met += 1
                    assert any(q[0] <= s and e <= q[1] for q in got), (case, s, e, got)
    assert met > 1000


def test_passages_meet_a_later_holder_that_is_more_alike(spark):
    rng = random.Random(8)
    line = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(0, 4000, 100):
        passage = line(60)
        # Earlier texts hold two thirds of the passage or less, and so head most of its keys.
        parts = [passage[a:a + 38] for a in (0, 5, 10, 15, 20, 22)]
        rows += [(k + i, " ".join(line(20) + p + line(20))) for i, p in enumerate(parts)]
        for i, edit in ((6, 0), (7, 25), (8, 35)):
            changed = passage[:edit] + line(1) + passage[edit + 1:]
            rows.append((k + i, " ".join(line(30) + (changed if edit else passage) + line(30))))
        want |= {(k + 7, k + 6), (k + 8, k + 6)}
        rows.append((k + 9, rows[-1][1]))
        want.add((k + 9, k + 8))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.other_id) for r in passages.repeats(frame).collect()}
    assert len(want & got) >= 0.99 * len(want)
    assert not {p for p in got if p[1] % 100 < 6 and p[0] % 100 >= 6 and p not in want}


def test_many_holders_of_a_key_are_paired_block_by_block(spark, monkeypatch):
    rng = random.Random(9)
    line = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    passage, rows = line(70), []
    for k in range(40):  # each holder has a word of its own, so that no two share a whole run
        rows.append((k, " ".join(line(20) + passage[:35] + line(1) + passage[35:] + line(20))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(passages, "BLOCK", 6)
    monkeypatch.setattr(passages, "PAIRS", 50)
    kept = []
    monkeypatch.setattr(passages, "paired", lambda met, f=passages.paired: f(kept.append(met) or met))
    got = {(r.doc_id, r.other) for r in passages.candidates(frame).collect()}
    assert got == {(a, b) for a in range(40) for b in range(a)}
    # A row has as many texts as a block at most, and blocks of one set meet once.
    met = kept[0].collect()
    assert max(len(x or []) for r in met for x in (r.docs, r.others)) == 6
    assert len(met) == len({(tuple(r.docs), tuple(r.others or ())) for r in met})


def test_spans_of_a_long_chain_are_tried_in_parts():
    n = 2500  # five equal shingles between changes: no span is alike, and there are three million
    a = np.arange(6 * n, dtype=np.uint64)
    b = np.where(a % 6 == 0, a + 10 ** 6, a).astype(np.uint64)
    b[60:90] = a[60:90]
    tracemalloc.start()
    got = passages.aligned(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) and all(p >= 0.75 for *_, p in got)
    assert peak < 100e6


def test_fingerprints_follow_the_next_document(docs, none, rows):
    texts = sorted(((k, t or "") for k, t, *_ in rows), key=lambda x: (-x[0], x[1]))
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    for (k, t), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        third = len(t) // 3
        want = t[:len(t) - third] + after[:third]
        if [x for x, _ in texts].count(k) == 1:
            assert got[k].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[k].n_chars == len(t)
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[3].fingerprint == got[60].fingerprint != got[4].fingerprint
    assert spotsigs.fingerprints(none).count() == 0


def test_edited_texts_without_common_words_stay_alike(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        w = [f"слово{rng.randrange(10 ** 6)}" for _ in range(90)]
        if k % 2:  # common words, but none without punctuation
            w = [rng.choice(["the,", "«of»", "(is)", "that!!"]) if i % 4 == 0 else x
                 for i, x in enumerate(w)]
        rows.append((k, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = spotsigs.fingerprints(frame).collect()
    # Two thirds of a text are equal: half of all signatures, as both sides have others.
    assert all(r.near_edited > 0.1 for r in got)
    assert 0.35 < sum(r.near_edited for r in got) / len(got) < 0.65
    bare = [(k, t.translate(str.maketrans("", "", ",«»()!"))) for k, t in rows]
    again = spotsigs.sets(spark.createDataFrame(bare, "doc_id long, text string")).collect()
    signs = {r.doc_id: r.signs for r in spotsigs.sets(frame).collect()}
    assert {r.doc_id: r.signs for r in again} == signs


def test_fingerprint_ranges_do_not_change_the_result(docs, monkeypatch):
    want = sorted(map(tuple, spotsigs.fingerprints(docs).collect()))
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 7)
    assert sorted(map(tuple, spotsigs.fingerprints(docs).collect())) == want


def test_near_fingerprints_match_all_pairs(docs, rows):
    sign = {r.doc_id: frozenset(r.signs) for r in spotsigs.sets(docs).collect()}
    groups = {}
    for k, s in sign.items():
        if s:
            groups[s] = min(k, groups.get(s, k))
    links = Counter()
    for a, b in itertools.combinations(groups, 2):
        if len(a & b) >= 0.75 * len(a | b):
            links[a] += 1
            links[b] += 1
    got = {(r.doc_id, r.class_id, r.links) for r in spotsigs.near(docs).collect()}
    assert got == {(k, groups[s], links[s]) for k, s in sign.items() if s}


@pytest.mark.parametrize("size", [1, 2, 3, 10, 57, 400])
def test_similar_sizes_lie_in_adjacent_partitions(size):
    for other in range(size, math.floor(size / spotsigs.TAU) + 1):
        assert abs(spotsigs.partition(size) - spotsigs.partition(other)) <= 1


def test_transducer_takes_the_shortest_path():
    fst = wfst.transducer()
    for text in ("", " ", "  a  b ", "the cat\nsat", "▁a ▁", "é\x00😀 <s>", "ab" * 300, "漢字 x"):
        ids = np.frombuffer(fst.encode([text])[0], np.int32).tolist()
        assert fst.decode(ids) == text
        norm = ("▁" + text.replace("▁", wfst._OWN).replace(" ", "▁")) if text else ""
        best = [0] + [wfst._FAR] * len(norm)
        for j in range(1, len(norm) + 1):
            for i in range(max(0, j - fst.longest), j):
                arc = fst.arcs.get(norm[i:j], (0, wfst._FAR))[1]
                if arc == wfst._FAR and j == i + 1:
                    arc = wfst._BYTE * len(fst._fallback(norm[i]))
                best[j] = min(best[j], best[i] + arc)
        cost = {i: c for i, c in fst.arcs.values()}
        assert sum(cost.get(i, wfst._BYTE) for i in ids) == best[-1]


def test_every_text_comes_back(docs, none, rows):
    got = wfst.encoded(docs).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert all(r.n_pieces == len(r.pieces) for r in got)
    assert set(docs.columns) < set(wfst.encode(docs).columns)
    assert wfst.encoded(none).count() == 0


def test_licenses_match_exact_containment(docs, none, spark):
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert {k for k in got if k[1] == "MIT-short"} == {(95, "MIT-short"), (96, "MIT-short")} & got
    assert len([k for k in got if k[1] == "MIT-short"]) == 1
    assert licenses.scan(none).count() == 0
    rng = random.Random(1)
    rows = []
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        for j in range(12):
            pad = [" ".join(f"p{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(40)))
                   for _ in range(2)]
            rows.append((100 * k + j, name, f"{pad[0]} {text} {pad[1]}"))
    frame = spark.createDataFrame(rows, "doc_id long, name string, text string")
    found = {(r.doc_id, r.license) for r in licenses.scan(frame).filter("containment = 1").collect()}
    hit = sum((k, name) in found for k, name, _ in rows)
    assert hit >= 0.97 * len(rows)


def test_language_model(docs, none, rows):
    texts = [(k, words(t)) for k, t in one_each([r for r in rows]).items()]
    twice = {9: 3}  # rows of one id are one document
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in texts}
    count = Counter()
    for k, w in texts:
        if not held[k]:
            for _ in range(twice.get(k, 1)):
                count.update([*w, b""])
    total, distinct = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    assert len(got) == len(texts)
    mine = base = 0.0
    for k, w in texts:
        tokens = [*w, b""] * twice.get(k, 1)
        want = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        r = got[k]
        assert r.held_out == held[k] and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(count[t] > 0 for t in tokens))
        assert r.base_score == pytest.approx(want)
        assert r.score < 0
        if held[k]:
            mine, base = mine + r.score, base + r.base_score
    assert mine > base  # held-out perplexity
    assert lm.score(none).count() == 0


def test_words_are_scored_in_their_context(spark):
    rng = random.Random(3)
    follow = {a: rng.sample(range(60), 4) for a in range(60)}

    def chain(n):
        w = [rng.randrange(60)]
        while len(w) < n:
            w.append(rng.choice(follow[w[-1]]))
        return w
    texts = [chain(80) for _ in range(250)]
    ids = range(1000, 1250)
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 1]
    twins = [i for i in range(2000, 3000) if zlib.crc32(str(i).encode()) % 5 == 1][:len(held)]
    mixed = [rng.sample(texts[i - 1000], 80) for i in held]
    say = lambda w: " ".join(f"w{k}" for k in w)
    rows = [(i, say(w)) for i, w in zip([*ids, *twins], [*texts, *mixed], strict=True)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, twin in zip(held, twins, strict=True):
        assert got[i].base_score == pytest.approx(got[twin].base_score)
        assert got[i].score > got[twin].score + 20
    # Perplexity falls from about 60 words to about four.
    tokens = sum(got[i].n_tokens for i in held)
    assert 3.5 < 10 ** (-sum(got[i].score for i in held) / tokens) < 6
    assert 10 ** (-sum(got[i].base_score for i in held) / tokens) > 50


def test_bucketed_words_score_as_frequent_ones(docs, monkeypatch):
    want = sorted(map(tuple, lm.score(docs).collect()), key=lambda r: r[0])
    monkeypatch.setattr(lm, "RARE", 20)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 3000)
    got = sorted(map(tuple, lm.score(docs).collect()), key=lambda r: r[0])
    for a, b in zip(want, got, strict=True):
        assert a == pytest.approx(b)


def test_spelling_sums_to_one():
    raw = b"thethatthis"
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, 3, 7, 11]))
    cell, _, _ = lm.events(w)
    keys, n = np.unique(cell, return_counts=True)
    s = lm.spelling(keys, n.astype(float), 1)
    for context in (257 * 258 + 257, 257 * 258 + ord("t"), ord("q") * 258 + ord("h")):
        p = s.second[context] * s.first[context % 258]
        inside = s.keys // lm._SYMBOLS == context
        p[s.keys[inside] % lm._SYMBOLS] = s.values[inside]
        assert p.sum() == pytest.approx(1)
