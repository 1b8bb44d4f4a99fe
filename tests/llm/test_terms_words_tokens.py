"""Ranked search, repeated words and token alignment against plain versions."""

import collections
import hashlib
import math
import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from factgraph.llm import alignment, best_positions, debruijn

DOCS = "doc_id long, text string, source string, item_id string, score string, rank int, k1 long, start int, block int, n map<string,int>"


def words(rng, n, few=40):
    stock = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(few)]
    return " ".join(rng.choices(stock, k=n))


def texts():
    rng = random.Random(11)
    own = lambda n: words(rng, n, 10 ** 4)
    base = own(300).split()
    passage = own(60)
    near = [" ".join(base[:i] + ["changed"] + base[i + 1:]) for i in (3, 150, 290)]
    return [" ".join(base), " ".join(base), *near, own(40) + "\n" + passage, passage + " " + own(30), own(25) + " " + passage + "\t" + own(25),
            "", None, "one", "one two  three ", "the Cat's cat, the CAT", own(19), own(20), "x " * 200, "a b c " * 50, "é" * 150,
            words(rng, 6000), own(5000) + " " + passage, "x\0y <|endoftext|> <s>", " \n\t ", "naïve " + own(100), "one", "lone▁sign",
            "日本語 𝄞é \r\n ab;\r\nz", "a" * 3000, "b　c ́d", "one\ntwo three\nx", own(15) + " " + " ".join(base[100:125]),
            " ".join(base[250:]) + " " + " ".join(base[:50])]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i * 3 % 31, t, "s", "i", "x", 1, 2, 3, 4, {"a": 1}) for i, t in enumerate(texts())]
    rest = [None] * 8
    # rows without an id, rows of one id with different texts, and repeated rows
    rows += [(None, texts()[2], *rest), (None, "one", *rest), (5, words(rng, 200), *rest), (5, rows[3][1], *rest), rows[0], rows[0], rows[18]]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def term_list(text):
    small = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain_ranking(docs, items, k):
    held = [(d, collections.Counter(term_list(t)), len(term_list(t))) for d, t in docs if term_list(t)]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c, n in held:
            m = 25 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in term_list(text) if t in c)
            if score > 0:
                scored.append((score, d))
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item_id, r, d, s) for r, (s, d) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def test_search(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = [(i, t) for i, t in enumerate(texts())] + [(7, "one ONE cat"), (7, "one ONE cat"), (None, "x"), (40, "absent")]
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in asked], "item_id long, text string, doc_id int, score int")
    for k, size in ((10, best_positions.SET_BYTES), (2, 20_000)):       # also in several sets of queries
        found = best_positions.search(docs, items, k, size)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain_ranking(rows, asked, k)
    assert best_positions.search(none, items).count() == 0
    assert best_positions.search(docs, items.limit(0)).count() == 0


def test_search_of_many_documents_stops_early():
    rng = np.random.default_rng(2)
    n, n_terms = 20_000, 12
    # a term's impact falls quickly along its list; short and long documents
    times = np.minimum(rng.zipf(1.6, (n, n_terms)), 1000) * (rng.random((n, n_terms)) < 0.3)
    row, term = np.nonzero(times)
    lengths = rng.integers(20, 3000, n)
    ends = np.concatenate([[0], np.cumsum((times > 0).sum(1))])
    ids = rng.permutation(n).tolist()
    block = best_positions.Block(ids, lengths, ends, term, times[row, term], n, int(lengths.sum()), n_terms)
    weight_of = np.zeros(n_terms, np.int64)
    for asked in ({0: 5000}, {0: 700, 3: 2000}, {1: 10, 2: 10, 5: 9000}, dict.fromkeys(range(12), 100)):
        scores = np.zeros(n, np.int64)
        np.add.at(scores, row, np.array([asked.get(t, 0) for t in term.tolist()]) * block.impact)
        want = sorted(((int(s), d) for s, d in zip(scores, ids) if s > 0), key=lambda f: (-f[0], f[1]))[:10]
        top, read = best_positions.best_positions(block, asked, weight_of, [], 10)
        assert top == want and not weight_of.any()
        if len(asked) < 3:
            assert read < 0.2 * sum((term == t).sum() for t in asked)
        # what another block found before stops the reading no later
        assert best_positions.best_positions(block, asked, weight_of, want, 10)[1] <= read


def test_search_goes_on_at_equal_scores():
    """All documents score alike, so the least ids may stand anywhere in the lists."""
    n = 5000
    ids = np.random.default_rng(1).permutation(n).tolist()
    block = best_positions.Block(ids, np.full(n, 10), np.arange(n + 1), np.zeros(n, int), np.ones(n, int), n, 10 * n, 1)
    top, read = best_positions.best_positions(block, {0: 3}, np.zeros(1, np.int64), [], 10)
    assert [d for _, d in top] == list(range(10)) and read == n


def plain_cut(rows, window=20):
    """What is left of each row; rows come in corpus order."""
    seen, out = set(), []
    for doc_id, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            key = tuple(own[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        out.append((doc_id, len(own), sum(gone), kept))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *sha_keys(r[1])))


def sha_keys(text):
    sha = hashlib.sha256((text or "").encode()).hexdigest()
    return int(sha[:15], 16), int(sha[15:30], 16)


@pytest.mark.parametrize("window, gram", [(20, 8), (5, 2), (3, 3)])
def test_repeated_words(docs, none, window, gram):
    want = plain_cut(in_order([(r.doc_id, r.text) for r in docs.collect()]), window)
    found = debruijn.removals(docs, window, gram)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(
        ((d, n, m, hashlib.sha256(kept.encode()).hexdigest()) for d, n, m, kept in want), key=str)
    assert debruijn.removals(none, window, gram).count() == 0


def test_removed_texts_keep_columns(docs, none):
    want = plain_cut(in_order([(r.doc_id, r.text) for r in docs.collect()]))
    left = debruijn.remove(docs)
    assert left.schema == docs.schema
    assert sorted(((r.doc_id, " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in left.collect()), key=str) == sorted(
        ((d, kept) for d, _, _, kept in want), key=str)
    assert debruijn.remove(none).count() == 0


def test_passages_are_whole_paths(spark, none):
    rng = random.Random(8)
    shared = words(rng, 70, 10 ** 4)
    tail = " ".join(shared.split()[30:])
    rows = [(1, words(rng, 50, 10 ** 4) + " " + tail), (2, words(rng, 30, 10 ** 4) + " " + shared), (3, shared + " " + words(rng, 9, 10 ** 4)),
            (4, words(rng, 100, 10 ** 4)), (5, "r " * 60)]
    found = debruijn.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # the shared passage is one path: its end was first in text 1, its start in text 2; the repeated word is a ring of one edge
    assert sorted((r.doc_id, r.start, r.words, r.n_words) for r in found) == [(1, 50, 40, 70), (2, 30, 49, 70), (5, 0, 20, 20)]
    assert len({r.path for r in found}) == 2
    assert debruijn.passages(none).count() == 0


def test_long_texts_are_read_in_segments(monkeypatch, spark):
    rng = random.Random(6)
    passage = words(rng, 45, 10 ** 4)
    rows = [(i, words(rng, 30 + 7 * i, 10 ** 4) + " " + passage + " " + words(rng, 40, 10 ** 4)) for i in range(6)]
    known = debruijn.WordHashes()
    codes = debruijn.codes_of(rows[3][1].encode().split(), known)
    grams, place = debruijn.least_grams(codes, 20, 8)
    for s in range(len(codes) - 19):
        own = grams[s:s + 13]
        assert place[s] == s + int(own.argmin())
    monkeypatch.setattr(debruijn, "SEGMENT", 16)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([9]), pa.array([rows[3][1].encode()])], names=["rid", "body"])
    found = [r for b in debruijn._sampler(20, 8)(iter([batch])) for r in b.to_pylist()]
    assert [r["place"] for r in found if r["gram"] is None] == [len(codes) - 19]
    found = [r for r in found if r["gram"] is not None]
    starts = [(s, r["gram"]) for r in found for s in range(r["place"] >> 8, (r["place"] >> 8) + (r["place"] & 255))]
    assert starts == [(s, grams[place[s]].view(np.int64)) for s in range(len(codes) - 19)]


def plain_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    rest, links_of = [], []

    def ranges(tokens):
        at, out = 0, []
        for i, data in tokens:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    for doc_id, text in rows:
        e = a_model.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = [(i, bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode())
             for i in b_model.encode(text or "")]
        if not text or not b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
            rest.append((doc_id, 0, 0, 0, ""))
            links_of.append([])
            continue
        a, b = ranges(a), ranges(b)
        groups, lo = [], 0
        for cut in sorted({t[2] for t in a} & {t[2] for t in b}):
            inside = lambda tokens: [t for t in tokens if lo <= t[1] and t[2] <= cut]  # noqa: E731, B023
            groups.append((inside(a), inside(b)))
            lo = cut
        said = ";".join(",".join(str(t[0]) for t in x) + "|" + ",".join(str(t[0]) for t in y) for x, y in groups)
        rest.append((doc_id, len(a), len(b), len(groups), hashlib.sha256(said.encode()).hexdigest()))
        links_of.append([(s[0], t[0]) for x, y in groups for s in x for t in y if s[1] < t[2] and t[1] < s[2]])
    n = collections.Counter(link for own in links_of for link in own)
    top = collections.defaultdict(int)
    for (_, b), k in n.items():
        top[b] = max(top[b], k)
    return n, [(d, x, y, g, len(own), sum(n[p] == top[p[1]] for p in own), sum(n[p] for p in own), sha)
               for (d, x, y, g, sha), own in zip(rest, links_of)]


def test_alignment(monkeypatch, spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 10_000]
    small = docs.where("text is null or length(text) < 10000")
    counts, want = plain_alignment(rows)
    found = alignment.alignment(small)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    assert {(r.a_id, r.b_id): r.n for r in alignment.pair_counts(small).collect()} == dict(counts)
    assert alignment.alignment(none).count() == 0
    assert alignment.alignment(spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string")).count() == 2


def test_words_learned_together_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "LEARNED_AT_ONCE", 7)
    pair = alignment.Pair(alignment.tokenizer_paths())
    rng = random.Random(9)
    units = alignment.Units(pair)
    many = ["\n".join(words(rng, 20, 200) + ("  " if rng.random() < 0.1 else ".") for _ in range(3)) for _ in range(40)]
    many[7], many[8], many[9] = "a▁b c", None, ""
    for lo in range(0, 40, 8):
        if lo == 24:
            units.forget()
        some = many[lo:lo + 8]
        for text, own in zip(some, units.numbers(some)):
            if not text or "▁" in text:
                assert own == []
                continue
            whole = alignment.align(pair, *pair.encode(text), np.array([len(text.encode()) + 1]))
            assert whole[0] == [";".join(units.said[u] for u in own)]
            assert [n.tolist() for n in whole[1]] == [[sum(c[u] for u in own)] for c in units.sizes]


def test_words_that_lose_bytes_are_found_one_by_one(monkeypatch):
    pair = alignment.Pair(alignment.tokenizer_paths())
    i = pair.b.piece_to_id("▁lost")
    pair.b_bytes[i] = b" lose"
    units = alignment.Units(pair)
    assert [bool(own) for own in units.numbers(["one lost word", "another word", "lost", "word  lost", "one"])] == [False, True, False, False, True]
    assert units.lost == {"lost"}


def test_identity_map_has_the_same_bytes():
    pair = alignment.Pair(alignment.tokenizer_paths())
    for a, b in enumerate(pair.same.tolist()):
        if b >= 0:
            assert pair.a_bytes[a] == pair.b_bytes[b]
    assert (pair.same >= 0).sum() > 10_000
