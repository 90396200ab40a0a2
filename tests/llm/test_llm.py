"""The operators of this subpackage against brute force, round trips and held-out rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blocklens.llm import decontaminate, fingerprint, line_dedup, mixing, ngram_join, pii, quality, queries, token_counts, toxicity, wavelet, wordhash
from blocklens.llm.common import part_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, sig string, tok long"
LONG = "word " * 30_000
ODD = [None, "", " \t\n", "a", "a b", "A  B", "a b c", "a b c", "é É ñ 𝒳", "x" * 50_000, LONG, "it's <|endoftext|> <|EndOfText|> 12.5%", "1.2.3.4 a@b.co +1 (203) 555-0199, card 4111 1111 1111 1111"]


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    rows = [(i, t, "en" if i % 2 else None, "s%d" % (i % 3) if i % 4 else None, len(t) if t else None, 1, "x", 2) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6], (None, "a b c", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k, num, den):
    sets, up = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(spark, texts, docs, k, num, den):
    rng, made = random.Random(k), {}
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(60)]
        for c in range(8):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
            made[10_000 + 10 * g + c] = " ".join(words)
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(both, k=k, num=num, den=den).collect()}
    assert got == brute_components(texts | made, k, num, den)


def doubled(n):
    """The Thue-Morse word of 2**n letters and its complement: a polynomial hash mod 2**64 takes them for one."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_by_construction(spark):
    x, y = doubled(10)
    d = spark.createDataFrame([(1, f"{x} x y z"), (2, f"{y} x y z"), (3, f"{x} {y}"), (4, f"{y} {x}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(d).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    path = queries.vocabulary()
    ids, library = wavelet.WordIds(path, np.uint16), wavelet.tokenizer(path)
    texts = [f"{x} {y}", y, x]
    flat, first = ids.rows(*part_bytes(pa.array(texts)))
    assert [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    # The word and its complement are near by edits, but not one line.
    assert line_dedup.without_repeated_lines(d.filter("doc_id < 3"), similarity=100).agg(F.sum("n_removed")).first()[0] == 0


def test_hashes_of_words():
    rng = random.Random(2)
    words = [bytes(rng.choices(b"ab", k=rng.randrange(1, 30))) for _ in range(3000)] + [b"x" * n for n in (511, 512, 513, 5000)] + [b"x" * 600 + c for c in (b"a", b"b")]
    data = np.frombuffer(b" ".join(words), np.uint8)
    found = wordhash.scan(data, np.array([0, len(data)]), wordhash.word_class("space"), 3, 2)
    by_hash, by_head, by_tail = {}, {}, {}
    for w, h, head, tail in zip(words, found.hashes.tolist(), found.heads.tolist(), found.tails.tolist(), strict=True):
        assert by_hash.setdefault(h, w) == w and by_head.setdefault(head, w[:3]) == w[:3] and by_tail.setdefault(tail, w[-2:]) == w[-2:]
    assert len(by_hash) == len(set(words))
    sizes = found.ends - found.starts
    assert wordhash.same_spans(found.data, found.starts, sizes, found.starts, sizes)
    assert not wordhash.same_spans(found.data, found.starts[-2:], sizes[-2:], found.starts[-1:].repeat(2), sizes[-1:].repeat(2))


def test_colliding_words_are_encoded_apart(monkeypatch):
    path = queries.vocabulary()
    ids, library = wavelet.WordIds(path, np.uint16), wavelet.tokenizer(path)
    whole = wavelet.scan

    def worse(*a, **k):
        words = whole(*a, **k)
        # Long words keep a bit of their hashes, short ones all.
        long = words.ends - words.starts > 8
        words.hashes = np.where(long, words.hashes % np.uint64(2), words.hashes)
        return words

    monkeypatch.setattr(wavelet, "scan", worse)
    texts = ["something considerable here, and something considered!", "elephantine expressions that share two hashes everywhere"]
    flat, first = ids.rows(*part_bytes(pa.array(texts)))
    assert [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_ngram_join_odd(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(odd).collect()]
    assert len(got) == len(ODD) + 2 and (None, 1, None) in got
    assert [g for g in got if g[0] in (0, 1, 2)] == [(0, 0, 0), (1, 0, 1), (2, 0, 2)] or {g for g in got if g[0] in (0, 1, 2)} == {(0, 0, 0), (1, 0, 1), (2, 0, 2)}
    assert {g[2] for g in got if g[0] in (6, 7)} == {6} and {g[2] for g in got if g[0] in (4, 5)} == {4}
    assert ngram_join.ngram_components(empty).count() == 0


def test_join_beyond_what_is_sent(docs, monkeypatch):
    want = sorted(map(tuple, ngram_join.ngram_components(docs).collect()))
    monkeypatch.setattr(ngram_join, "SEND_CLASSES", 0)
    assert sorted(map(tuple, ngram_join.ngram_components(docs).collect())) == want


def test_toxicity(spark, data, docs, odd, empty):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=40)) + (" vileword" if i % 4 == 0 else ""), "en", int(i % 4 == 0)) for i in range(1200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    got = toxicity.toxicity(d.drop("toxic"), d.select("doc_id", "toxic"), F.col("id") % 3 != 1).collect()
    held = [r for r in got if r.id % 3 == 1]
    assert sum((r.score >= 0.7) == (r.id % 4 == 0) for r in held) >= 0.97 * len(held)
    labels = d.select("doc_id", "toxic")
    out = toxicity.toxicity(odd, labels).collect()
    assert len(out) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).filter("score < 0.5").count() == len(ODD) + 2


def test_few_positive_rows_are_found(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=40)) + (" vileword" if i % 12 == 0 else ""), "en", int(i % 12 == 0)) for i in range(720)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    got = toxicity.toxicity(d.drop("toxic"), d.select("doc_id", "toxic"), F.col("id") % 5 < 3).collect()
    held = [r for r in got if r.id % 5 >= 3]
    # 36 positive rows to fit: 0.7 is the best cut of so few as well.
    assert sum((r.score >= 0.7) == (r.id % 12 == 0) for r in held) >= 0.97 * len(held)
    assert sum(r.score >= 0.7 for r in held if r.id % 12 == 0) >= 20


def test_cut_is_moved_at_every_size():
    rng = random.Random(9)
    rows = [(" ".join(rng.choices("abcdefghij", k=20)) + (" vile" if i % 12 == 0 else ""), "en", int(i % 12 == 0)) for i in range(240)]
    net = toxicity.fit(pa.table(dict(zip(["text", "lang", "label"], map(list, zip(*rows, strict=True)), strict=True))))
    assert net.threshold == 0.7
    cut = net.score(pa.array([t for t, _, _ in rows])) >= 0.7
    assert cut.tolist() == [bool(y) for _, _, y in rows]


def test_last_words_count():
    net = toxicity.TextCnn.fresh()
    rng = random.Random(3)
    rows = [" ".join(rng.choices(["a1", "b2", "c3", "d4", "e5"], k=k)) for k in (1, 2, 3, 4, 9, 30)]
    for row in rows:
        alone = net.score(pa.array([row]))[0]
        assert alone == net.score(pa.array([row, rows[3]]))[0] == net.score(pa.array([rows[4], "", row]))[-1]
    ids, first = next(toxicity.word_ids(pa.array(["x y z decisive"])))
    net.embedding[:] = 0
    net.embedding[ids[:, 3]] = 1
    net.filters = [np.ones_like(f) for f in net.filters]
    best, place = net.pooled(ids, first, where=True)
    assert (best > 0).all() and best[0, 0] == 2 * toxicity.DIM and place[0].tolist() == [3] * 8 + [2] * 8 + [1] * 8


def test_pooled_is_a_plain_convolution():
    net, rng = toxicity.TextCnn.fresh(2), random.Random(3)
    net.bias[:] = np.linspace(-0.02, 0.02, len(net.bias))
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "Ee!"], k=k)) for k in (0, 1, 2, 3, 9, 40)]
    got = np.concatenate([net.pooled(*x) for x in toxicity.word_ids(pa.array(texts))])
    for text, best in zip(texts, got, strict=True):
        (ids, _), words = next(toxicity.word_ids(pa.array([text]))), len(text.split())
        vectors = [net.embedding[ids[0, i]] + net.embedding[ids[1, i]] for i in range(words)]
        for g, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                k = g * toxicity.FILTERS + f
                sums = [sum(float(vectors[i + j] @ net.filters[g][j][:, f]) for j in range(width)) for i in range(words - width + 1)]
                assert best[k] == pytest.approx(max(0.0, max(sums) + float(net.bias[k])) if sums else 0.0, abs=1e-5)


def test_wavelet_tokens(docs, texts, odd, empty):
    path = queries.vocabulary()
    library = wavelet.tokenizer(path)
    got, at = {r.doc_id: r for r in wavelet.encode_and_read_back(docs, path, shard_tokens=5000).collect()}, 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    out = {r.doc_id: r.n_tokens for r in wavelet.encode_and_read_back(odd, path).collect()}
    assert out == {**{i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(ODD)}, None: 4}
    assert wavelet.encode_and_read_back(empty, path).count() == 0


def test_wavelet_blocks_are_unpacked_when_touched():
    values = np.random.default_rng(3).integers(0, 9, 200_000).astype(np.uint16)
    image = wavelet.pack_shard(np.array([1]), np.array([False]), np.array([0, len(values)]), values, 4, block=512)
    _, _, m = wavelet.open_shard(image)
    assert all(not p.held for p in m.planes)
    assert m.access(150_000) == values[150_000] and m.rank(5, 120_001) == (values[:120_001] == 5).sum()
    assert max(len(p.held) for p in m.planes) <= 6
    where = np.flatnonzero(values == 7)
    assert [m.select(7, j) for j in (0, 999, len(where) - 1)] == [int(where[j]) for j in (0, 999, len(where) - 1)]


@pytest.mark.parametrize("n, top, width", [(0, 1, 3), (1, 7, 3), (700, 90, 7), (1500, 50_000, 16), (600, 70_000, 17)])
def test_wavelet_matrix(n, top, width):
    values = np.random.default_rng(n).integers(0, top, n).astype(np.uint16 if width <= 16 else np.uint32)
    image = wavelet.pack_shard(np.array([5, 0]), np.array([False, True]), np.array([0, n // 2, n]), values, width)
    ids, first, m = wavelet.open_shard(image)
    v = values.tolist()
    assert ids == [5, None] and first.tolist() == [0, n // 2, n] and m.values().tolist() == v
    assert all(m.access(i) == v[i] for i in range(0, n, 7))
    for c in set(v[:30]):
        assert m.count(c) == v.count(c) and m.occurrences(c) == [i for i, x in enumerate(v) if x == c]
        assert m.rank(c, n // 3) == v[: n // 3].count(c)
    assert m.count(1 << 30) == 0
    with pytest.raises(IndexError):
        m.select(1 << 30, 0)


def windows_by_hand(texts, items, size):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    known = {}
    for item, t in items:
        w = cut(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for d, t in texts.items():
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
                    found |= known[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_odd_tables_in_blocks(spark, odd):
    bench = spark.createDataFrame([(1, "a b c"), (2, "word word"), (3, "x y z")], "item_id long, text string")
    one, many = (sorted(map(repr, decontaminate.contamination(odd, bench, block=b).collect())) for b in (10, 1))
    assert one == many


@pytest.mark.parametrize("block", [10**6, 200])
def test_contamination(spark, data, docs, texts, block):
    bench = spark.read.parquet(f"{data}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "Only-Three Words"), (901, ""), (902, None), (10, "a b")], "item_id long, text string"))
    more = {70_000: "Say only three; WORDS here", 70_001: None, 70_002: "a b a b"}
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = {r[0]: tuple(r)[1:] for r in decontaminate.hit_counts(decontaminate.contamination(both, bench, block=block)).collect()}
    assert got == windows_by_hand(texts | more, [tuple(r) for r in bench.collect()], 10)


def test_contamination_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a b c"), (None, "word word"), (2, None)], "item_id long, text string")
    found = decontaminate.contamination(odd, bench, keep_text=True)
    assert found.filter(F.size("spans") > 0).count() == 4
    cut = {r.id: r.text for r in decontaminate.remove_spans(found).collect()}
    assert cut[6] == "" and cut[4] == "a b" and cut[0] is None
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).filter(F.size("spans") > 0).count() == 0


def test_token_counts(docs, texts, odd, empty):
    path = queries.vocabulary()
    library = wavelet.tokenizer(path)
    want = lambda t: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect()} == {i: want(t) for i, t in texts.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, path).collect()}
    assert got == {**{i: (*want(t), want(t)[1] > 2048) for i, t in enumerate(ODD)}, None: (5, 3, False)}
    assert token_counts.token_counts(empty, path).count() == 0


def test_tokens_of_random_text():
    path, rng = queries.vocabulary(), random.Random(5)
    ids, counts, library = wavelet.WordIds(path, np.uint16), token_counts.WordCounts(path), wavelet.tokenizer(path)
    pool = [chr(c) for c in [*range(9, 14), 0x1C, *range(32, 127), 0x85, *range(160, 400), 0x301, 0x307, 0x3A3, 0x130, 0x1E9E, 0x212B, 0x3000, 0x4E2D, 0x1F600]]
    for n in range(1500):
        text = "".join(rng.choices(pool, k=rng.randrange(14))) + ("<|endoftext|>we'LL" if n % 9 == 0 else "")
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.rows(*part_bytes(pa.array([text])))[0].tolist() == want and counts.text(text.encode()) == len(want)
    # Code points that Python's tables do not know.
    for c in (0xA7CB, 0xA7DC, 0x32808, 0x3285C, 0x3D988, 0x3F85C, 0x10FFFF, 0xE000):
        text = f"{chr(c)} a{chr(c)}b É{chr(c)}1 {chr(c) * 3}"
        assert counts.text(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), hex(c)


def test_lines(spark, odd, empty):
    line = "the quick brown fox jumps over the lazy dog near the old river bank on a sunny day in the month of may with all of its many friends and their dogs"
    near = line.replace("friends", "friendz")
    rows = [(1, f"{line}\nshort\n{line.upper()}"), (2, f"short\n{near}\nquite another sentence that nothing else is like at all"), (3, None), (4, line + "\n")]
    got = {r.id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (f"{line}\nshort", 3, 1) and got[3] == (None, 0, 0) and got[4] == ("", 2, 1)
    assert line_dedup.without_repeated_lines(odd).count() == len(ODD) + 2
    assert line_dedup.without_repeated_lines(empty).count() == 0


def test_short_lines(spark):
    rows = [(1, "Read more\nAB\n---\n日本語の文章がここにあります"), (2, "read, more!\nab\n\n---\n日本語の文章がここにありまず\nother"), (3, "7\n8\nx")]
    got = {r.id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 4, 0), 2: ("\n---\nother", 6, 3), 3: ("7\n8\nx", 3, 0)}


def changed(line, rng, percent):
    """``line`` with words replaced and letters changed, at least ``percent`` % alike to it."""
    out = line
    while True:
        words = out.split()
        i = rng.randrange(len(words))
        words[i] = rng.choice(["ered", "tion", "thou"]) if rng.random() < 0.5 else words[i][:-1] + rng.choice("aeiou")
        if not line_dedup.similar(line, " ".join(words), percent):
            return out
        out = " ".join(words)


def brute_lines(lines):
    """Numbers of the lines that do not come first among the lines that links of 80 % join to them."""
    grams, up = [{x[i : i + 3] for i in range(len(x))} for x in lines], list(range(len(lines)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in range(len(lines)):
        for a in range(b):
            # An edit touches three places at most; this only spares comparisons.
            lost = 3 * (max(len(lines[a]), len(lines[b])) // 5)
            near = 5 * min(len(lines[a]), len(lines[b])) >= 4 * max(len(lines[a]), len(lines[b]))
            if near and len(grams[a] & grams[b]) >= max(len(grams[a]), len(grams[b])) - lost - 3 and line_dedup.similar(lines[a], lines[b], 80):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i for i in range(len(lines)) if top(i) != i}


def test_lines_recall(spark, texts):
    rng = random.Random(7)
    known = sorted({" ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[0-9]", "0", low(x)))) for t in texts.values() for x in t.split("\n")})
    lines, kind = [], []
    for words in ((5, 9), (10, 19), (20, 29), (30, 60)):
        found = rng.sample([x for x in known if words[0] <= len(x.split()) <= words[1]], 40)
        for percent in (100, 88, 80):
            lines += found if percent == 100 else [changed(x, rng, percent) for x in found]
            kind += [(words, percent)] * len(found)
    want = brute_lines(lines)
    got = {r.id for r in line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got <= want
    share = {k: sum(kind[i] == k for i in got) / sum(kind[i] == k for i in want) for k in kind if k[1] != 100}
    print(share)
    # Lines at the very edge of 80 % share few n-grams; a part of them is missed.
    assert all(v >= (0.9 if percent == 88 else 0.65) for (_, percent), v in share.items()), share


def keys_of(lines):
    """The keys of each line, under which two lines can meet."""
    raw = [x.encode() for x in lines]
    sizes = np.array([len(x) for x in raw])
    at, keys, _, _ = line_dedup.line_keys(np.frombuffer(b" ".join(raw) + b" ", np.uint8), np.cumsum(sizes + 1) - sizes - 1, sizes)
    out = [set() for _ in lines]
    for i, key in zip(at.tolist(), keys.tolist(), strict=True):
        out[i].add(key)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_lines_of_the_data_meet(spark, data, sf):
    docs = spark.read.parquet(f"{data.rpartition('/')[0]}/{sf}/documents.parquet")
    lines = sorted({" ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(x))) for r in docs.collect() for x in r.text.split("\n")} - {""}, key=len)
    counts = np.zeros((len(lines), 256), np.int16)
    for i, x in enumerate(lines):
        raw = np.frombuffer(x.encode(), np.uint8).astype(np.int64)
        if len(raw) > 2:
            np.add.at(counts[i], (raw[:-2] * 8191 + raw[1:-1] * 131 + raw[2:]) % 251, 1)
    size, near = np.array([len(x) for x in lines]), []
    for i in range(len(lines)):
        j = np.arange(i + 1, np.searchsorted(size, size[i] / 0.8 + 1e-9, "right"))
        # An edit touches three triplets of bytes at most; characters here have up to four bytes.
        shared = np.minimum(counts[j], counts[i]).sum(axis=1)
        j = j[shared >= size[j] - 2 - 3 * (size[j] // 5)] if len(j) else j
        near += [(i, k) for k in j.tolist() if (len(lines[k]) < 120 or sf == "sf0.001") and line_dedup.similar(lines[i], lines[k], 80)]
    keys = keys_of(lines)
    met = sum(bool(keys[a] & keys[b]) for a, b in near)
    print(sf, met, len(near))
    assert len(near) >= 30 and met >= 0.97 * len(near)


def test_simhashes_within_three_bits_share_a_block():
    rng = np.random.default_rng(4)
    whole = rng.integers(0, 1 << 32, (300, line_dedup.SIM_BLOCKS), np.uint64)
    other = whole.copy()
    for i in range(300):
        for bit in rng.choice(128, i % 4, replace=False):
            other[i, bit // 32] ^= np.uint64(1 << (bit % 32))
    assert (whole == other).any(axis=1).all()
    features, cuts = rng.integers(0, 1 << 32, 90, np.uint64).astype(np.uint32), np.array([0, 40, 41, 90])
    sims = line_dedup.simhashes(features, cuts)
    assert sims.shape == (3, 2) and len(np.unique(line_dedup.block_keys(sims))) == 12
    assert [int(line_dedup.block_keys(sims[:1] ^ np.uint64(1 << b))[0, 0]) == int(line_dedup.block_keys(sims)[0, 0]) for b in (3, 40)] == [False, True]
    # Every bit is a majority of the features' bits.
    for half in range(2):
        own = [int(x) for x in line_dedup.mix(features[:40].astype(np.uint64) + np.uint64(half << 40))]
        assert int(sims[0, half]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > 40)


def test_bound_by_words():
    rng = random.Random(12)
    for _ in range(3000):
        x = [rng.choice("a bb ccc dddd e ff".split()) for _ in range(rng.randrange(1, 9))]
        y = [w if rng.random() < 0.8 else rng.choice("a bb ccc dddd zz".split()) for w in x if rng.random() < 0.9] or ["a"]
        a, b = " ".join(x), " ".join(y)
        assert line_dedup.word_distance(x, y, 1000) >= line_dedup.edit_distance(a, b)
        assert line_dedup.word_distance(x, x, 0) == 0


def test_lines_of_digits_need_the_edit_check(spark):
    rows = [(1, "total 10 20 30 40 50 60\n1234567 1"), (2, "total 91 82 73 64 55 46\n1234568 1"), (3, "total 10 20 30 40 50 61")]
    got = {r.id: r.n_removed for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_lines_of_rows_that_share_an_id(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(2, f"{line}\nonly here"), (2, f"written nowhere else\n{line}"), (None, f"{line}\nlast"), (5, "same\nsame"), (5, "same\nsame")]
    got = sorted((r.text, r.n_removed) for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # Which of the two rows of id 2 comes first is their hashes' order.
    kept = [(f"{line}\nonly here", 0), ("written nowhere else", 1)], [("only here", 1), (f"written nowhere else\n{line}", 0)]
    assert got in [sorted([*k, ("last", 1), ("same", 1), ("same", 1)]) for k in kept]


@pytest.mark.parametrize("setting", [("SEND_LINES", 0), ("FLUSH", 2000)])
def test_lines_beyond_what_is_sent(docs, monkeypatch, setting):
    want = {tuple(r) for r in line_dedup.repeated_lines(docs).collect()}
    monkeypatch.setattr(line_dedup, *setting)
    assert {tuple(r) for r in line_dedup.repeated_lines(docs).collect()} == want


def test_edit_distance():
    rng = random.Random(3)

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for _ in range(800):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(12))) for _ in "ab")
        assert line_dedup.edit_distance(a, b) == table(a, b)
        assert line_dedup.similar(a, b, 70) == (100 * table(a, b) <= 30 * max(len(a), len(b)))


def plain_digest(text):
    """The digest's rule, a character of code at a time."""
    raw, counts = text.encode(), [0] * 128
    tables = [[[int(x) for x in t] for t in shape] for shape in fingerprint.byte_tables()]
    for (second, third), (a, b, c) in zip(((1, 2), (1, 3), (2, 3)), tables, strict=True):
        for i in range(len(raw) - third):
            counts[a[raw[i]] ^ b[raw[i + second]] ^ c[raw[i + third]]] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (31, 63, 95))
    length = min(255, round(math.log(max(len(raw), 1)) / math.log(1.1)))
    marks = [(n > q1) + (n > q2) + (n > q3) for n in counts]
    body = "".join(f"{marks[i] << 6 | marks[i + 1] << 4 | marks[i + 2] << 2 | marks[i + 3]:02x}" for i in range(0, 128, 4))
    return f"1{length:02x}{q1 * 15 // max(q3, 1):x}{q2 * 15 // max(q3, 1):x}{body}"


def test_digests_by_hand(texts):
    chosen = [*list(texts.values())[:40], "", "a", "abc", "abcd", "é" * 9, "x" * 3000]
    codes = fingerprint.codes_of(*fingerprint.joined(chosen))
    assert [fingerprint.digest(c) for c in codes] == [plain_digest(t) for t in chosen]
    x, y = fingerprint.parse(plain_digest(chosen[0])), fingerprint.parse(plain_digest(chosen[1]))
    gap = [abs(int(a) - int(b)) for a, b in zip(x, y, strict=True)]
    score = (0 if gap[0] <= 1 else min(gap[0], 48)) + sum(min(g, 6) for g in gap[1:3]) + sum(6 if g == 3 else g for g in gap[3:])
    assert int(fingerprint.difference(x[None], y[None])[0]) == min(score, 256)


def test_long_texts_are_counted_in_pieces():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    whole = fingerprint.bucket_counts(data, np.array([0, 5000]))
    assert (fingerprint.bucket_counts(data, np.array([0, 5000]), piece=700) == whole).all() and whole.sum() == 2 * 4997 + 4998


def test_fingerprints_of_repeated_ids(spark):
    rows = [(1, "one text"), (1, "another text"), (1, None), (None, "x"), (None, ""), (2, "two")]
    got = fingerprint.neighbour_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in got].count(1) == 3 and len(got) == 6 and len({r.fingerprint for r in got if r.n_chars == 0}) == 1


def test_fingerprints(docs, texts, odd, empty):
    got, ids = {r.doc_id: r for r in fingerprint.neighbour_likeness(docs).collect()}, sorted(texts, reverse=True)
    for i, n in zip(ids, ids[1:] + ids[:1]):
        t, h = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - h] + texts[n][:h]
        own, other, after = (fingerprint.codes_of(*fingerprint.joined([x])) for x in (t, edited, texts[n]))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.digest(own[0]), fingerprint.digest(other[0]))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(own, other)[0], fingerprint.likeness(own, after)[0])
        assert (fingerprint.parse(r.fingerprint) == own[0]).all()
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.2
    assert fingerprint.neighbour_likeness(odd).count() == len(ODD) + 2
    assert fingerprint.neighbour_likeness(empty).count() == 0
    assert fingerprint.neighbour_likeness(docs.limit(1)).first().near_next == 1.0


def test_base_spans_as_the_patterns_say():
    rng = random.Random(2)
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(20_000):
        s = "".join(rng.choices("a1.@-+2 b%", k=rng.randrange(1, 18)))
        assert [x[1:] for x in pii.emails(s)] == [m.span() for m in pii.EMAIL.finditer(s)]
        assert [x[1:] for x in pii.ips(s)] == [m.span() for m in ip.finditer(s) if all(int(p) <= 255 for p in m.group().split("."))]
    assert pii.joined(pii.base_spans("4111 1111 1111 1111, +1 (203) 555-0199")) == "card:0:19,phone:21:38"


def small_tagger(seed=1):
    net = pii.Tagger.fresh(seed)
    net.p["move"] += np.random.default_rng(seed).normal(0, 0.5, net.p["move"].shape).astype(np.float32)
    return net


def test_decoding_against_all_paths():
    net, rng = small_tagger(), np.random.default_rng(5)
    e = rng.normal(0, 1, (4, 3, pii.TAGS)).astype(np.float32)
    paths = list(itertools.product(range(pii.TAGS), repeat=4))
    for row, tags in enumerate(net.decode(e).T):
        score = {p: sum(float(e[t, row, p[t]]) for t in range(4)) + sum(float(net.p["move"][p[t - 1], p[t]]) for t in range(1, 4)) for p in paths}
        assert tuple(tags.tolist()) == max(score, key=score.get)
        _, _, total = net.sums(e)
        assert float(total[row]) == pytest.approx(math.log(sum(math.exp(v) for v in score.values())), abs=1e-3)


def test_gain_of_the_best_span():
    net, rng = small_tagger(4), np.random.default_rng(2)
    e = rng.normal(0, 1, (5, 6, pii.TAGS)).astype(np.float32)
    for row, gain in enumerate(net.best_span(e)):
        score = lambda p: sum(float(e[t, row, p[t]]) for t in range(5)) + sum(float(net.p["move"][p[t - 1], p[t]]) for t in range(1, 5))  # noqa: B023, E731
        spans = []
        for kind in range(len(pii.KINDS)):
            for a in range(5):
                for b in range(a + 1, 6):
                    path = [0] * 5
                    path[a:b] = [1 + 2 * kind] + [2 + 2 * kind] * (b - a - 1)
                    # Moves into the first and out of the last step count as if the text went on.
                    spans.append(score(path) + float(net.p["move"][0, path[0]] - net.p["move"][0, 0]))
                    if b == 5:
                        spans.append(spans[-1] + float(net.p["move"][path[4], 0] - net.p["move"][0, 0]))
        assert gain == pytest.approx(max(spans) - score([0] * 5), abs=1e-4)


def test_gradients_of_the_tagger():
    net, rng = small_tagger(2), np.random.default_rng(6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, tags = rng.integers(0, 128, (7, 3)).astype(np.uint8), rng.integers(0, pii.TAGS, (7, 3))
    grad, _ = net.step(ids, tags)
    for name, values in net.p.items():
        places = [tuple(int(rng.integers(0, d)) for d in values.shape) for _ in range(4)]
        if name.endswith("_in"):
            places = [(int(ids[k, 0]), p[1]) for k, p in enumerate(places)]
        for place in places:
            old, losses = values[place], []
            for shift in (0.02, -0.02):
                values[place] = old + shift
                losses.append(net.step(ids, tags)[1])
            values[place] = old
            assert (losses[0] - losses[1]) / 0.04 == pytest.approx(grad[name][place], abs=4e-3), name


def test_reading_in_windows():
    net, rng = small_tagger(3), random.Random(8)
    text = "".join(rng.choices("ab 12@.+", k=900))
    near = list(net.near_windows([text, "", "x"], at_once=3))
    assert [w[:2] for w in near if w[0] == 0] == [(0, s) for s in range(0, 900 - 32, 224)][: len([w for w in near if w[0] == 0])]
    (i, a, e), *_ = net.runs([text])
    assert (i, a) == (0, 0) and e.shape[1] == pii.TAGS
    assert pii.Tagger.tag(net, [text]) == pii.Tagger.tag(net, ["", text])[1:]


def test_planted_spans_are_found(docs):
    rng = random.Random(21)
    pool = [r.text for r in docs.collect() if r.text]
    net = pii.fit([t for t in pool[::2]][:100])
    held = pool[1::2]
    want, added, right = dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0)
    cuts = []
    for n in range(400):
        text = rng.choice(held)
        at = rng.randrange(max(1, len(text) - 300))
        cut = text[at : at + 300]
        cuts.append(pii.planted(cut, rng, [], 10**6, (pii.KINDS[n % 4], "")))
    for (text, tags), tagged in zip(cuts, net.tag([c[0] for c in cuts]), strict=True):
        base = pii.base_spans(text)
        free = lambda s: all(s[2] <= a or b <= s[1] for _, a, b in base)  # noqa: B023, E731
        missed = [s for s in pii.spans_of(tags) if free(s)]
        for s in missed:
            want[s[0]] += 1
        for s in pii.all_spans(text, base, tagged)[len(base) :]:
            added[s[0]] += 1
            right[s[0]] += any(s[0] == m[0] and abs(s[1] - m[1]) <= 1 and abs(s[2] - m[2]) <= 1 for m in missed)
    print({k: (want[k], added[k], right[k]) for k in pii.KINDS})
    assert all(right[k] >= 0.9 * added[k] and right[k] >= 0.7 * want[k] > 0 for k in pii.KINDS)


def test_personal_data(spark, odd, empty):
    rng = random.Random(4)
    fill = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=12))
    rows = [(i, f"{fill()} +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {fill()} x{i}@mail.example.com {fill()} 10.{i % 250}.3.4 {fill()}") for i in range(200)]
    plain = [(500 + i, f"{fill()} ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {fill()}") for i in range(40)]
    d = spark.createDataFrame(rows + plain, "doc_id long, text string")
    got = pii.personal_data(d).collect()
    assert all((r.n_phone, r.n_email, r.n_ip) == (1, 1, 1) for r in got if r.id < 500)
    assert sum(r.n_added for r in got if r.id >= 500) >= 30
    text = {r.doc_id: r.text for r in d.collect()}
    assert all(len(pii.masked(text[r.id], r.spans)) < len(text[r.id]) for r in got if r.spans)
    out = pii.personal_data(odd).collect()
    assert len(out) == len(ODD) + 2 and {(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out if r.id == 12} == {(1, 1, 1, 1)}
    assert pii.personal_data(empty).count() == 0


def test_mixing(docs, odd, empty):
    got = mixing.copies_to_take(docs).collect()
    sums = {}
    for r in got:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        s = sums.setdefault(r.source, [0, r.target, r.source_size, 0])
        s[0] += r.taken
        s[3] = max(s[3], r.size)
    # A source of ten documents can't always be filled to the word.
    assert all(abs(t - want) <= longest and want <= 2 * size for t, want, size, longest in sums.values())
    assert abs(sum(t - want for t, want, *_ in sums.values())) <= 0.03 * sum(want for _, want, *_ in sums.values())
    assert abs(sum(want for _, want, *_ in sums.values()) - 1.5 * sum(size for _, _, size, _ in sums.values())) < 1
    assert sorted(map(tuple, mixing.copies_to_take(docs.repartition(5)).drop("row").collect())) == sorted(tuple(r)[:-1] for r in got)
    assert mixing.mixed_documents(docs).columns == docs.columns
    out = mixing.copies_to_take(odd).collect()
    assert len(out) == len(ODD) + 2 and all(r.taken == 0 for r in out if r.size == 0)
    assert mixing.copies_to_take(empty).count() == 0


def reshared(sizes, weights=(3, 1, 2), percent=150, most=2):
    """Targets, reshared step by step."""
    names = sorted((x for x in sizes if x is not None)) + [x for x in sizes if x is None]
    weight = {x: weights[i % 3] for i, x in enumerate(names)}
    target, open_, left = {}, set(names), percent / 100 * sum(sizes.values())
    while open_:
        shares = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        over = {x for x in open_ if shares[x] > most * sizes[x]}
        if not over:
            return target | shares
        for x in over:
            target[x] = most * sizes[x]
            left -= target[x]
        open_ -= over
    return target


def test_targets_are_reshared(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 30):
        sizes = {f"s{i}": rng.choice([1, 10, 100, 1000, 0]) + rng.randrange(50) for i in range(n)} | {None: 7}
        d = spark.createDataFrame([(k, v, 3) for k, v in sizes.items()], "source string, source_size long, n_docs long")
        got = {r.source: r.target for r in mixing.source_targets(d).collect()}
        want = reshared(sizes)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_inclusion_probabilities(spark):
    rng = random.Random(5)
    # A small source, whose sizes differ by a factor of twenty, against a large one.
    rows = [(i, "w " * rng.randrange(2, 40), "b") for i in range(30)] + [(100 + i, "w " * 30, "a") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).cache()
    hits, p, seeds = {}, {}, 14
    for seed in range(seeds):
        for r in mixing.copies_to_take(d, seed=f"s{seed}", percent=60).collect():
            rest = r.target / r.source_size - r.target // r.source_size
            hits[r.doc_id] = hits.get(r.doc_id, 0) + r.copies - r.target // r.source_size
            p[r.doc_id] = (r.inclusion, r.size, r.source, rest)
    for source in "ab":
        own = [v for v in p.values() if v[2] == source]
        assert sum(q * n for q, n, _, _ in own) == pytest.approx(own[0][3] * sum(n for _, n, _, _ in own))
    off = [(hits[i] / seeds - q) for i, (q, *_) in p.items()]
    assert max(map(abs, off)) < 0.6 and abs(sum(off) / len(off)) < 0.03
    # Larger documents are likelier, up to four times.
    some = sorted((n, q) for q, n, s, _ in p.values() if s == "b")
    assert some[0][1] < some[-1][1] <= 4.01 * some[0][1]


def test_mix_of_repeated_rows(spark):
    rows = [(1, "a b c", "s", 5), (1, "a b c", "s", 5), (1, "other words here", "s", 6), (None, "a b", "t", 7), (None, "a b", "t", 7), (2, "x y z", "t", 8), (3, None, "t", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, __copies long")
    d = d.withColumnRenamed("__copies", "extra")
    plan = mixing.copies_to_take(d).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).collect()
    got = mixing.mixed_documents(d)
    assert got.columns == d.columns
    counts = {}
    for r in got.collect():
        k = r.doc_id, len((r.text or "").split())
        counts[k] = counts.get(k, 0) + 1
    assert counts == {(r.doc_id, r.size): r.n for r in plan if r.n}


def test_quality_views():
    rows = [(1, "s", "en", 5), (2, None, None, None), (3, "", "", 0), (4, "s", "en", 5)]
    batch = pa.RecordBatch.from_pylist([{"text": "x" * r[0], "source": r[1], "lang": r[2], "n_chars": r[3]} for r in rows])
    page = quality.page_features(batch)
    assert (page[0] == page[3]).all() and (page[1] != page[2]).any() and page.shape == (4, quality.PAGE)
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.5).astype(float)
    a = np.where(y, 1.0, -1.0) + rng.normal(0, 0.8, 400)
    x, z, _ = quality.blended(a, -a + rng.normal(0, 1, 400), y)
    assert x > 0 and z >= 0


def test_quality(spark, odd, empty):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        body = [rng.choice(words) + ("!!" if bad else "") for _ in range(30)]
        rows.append((i, " ".join(body), "en", "spam" if bad else "s", 100, None if i % 5 == 0 else int(not bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")
    got = quality.quality(d.drop("quality"), d.select("doc_id", "quality"), F.col("id") % 4 != 1).collect()
    held = [r for r in got if r.id % 4 == 1]
    assert sum(r.keep == (r.id % 3 != 0) for r in held) >= 0.97 * len(held)
    labels = d.select("doc_id", "quality")
    assert quality.quality(odd, labels).count() == len(ODD) + 2
    assert quality.quality(empty, labels).count() == 0


def test_pipeline_decisions_hold(spark, data, texts):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    toxic = p.drop_toxic(spark, docs, data)
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{data}/labels.parquet"), queries.fold() != 1)
    assert toxic.columns == docs.columns and {r.doc_id for r in toxic.collect()} == {r.id for r in scored.collect() if not r.toxic}
    kept = p.drop_contaminated(spark, docs, data)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, w in windows_by_hand(texts, bench, 10).items() if not w[-1]}
    one = p.drop_near_copies(spark, docs, data)
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in brute_components(texts, 5, 4, 5).items() if c == i}
    mixed, plan = p.mix_sources(spark, docs, data), {r.doc_id: r.copies for r in mixing.copies_to_take(docs).collect()}
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in plan.items() if n}
    # The last stage against the library, over what the others left.
    last = p.run(spark, data)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    library, at = wavelet.tokenizer(queries.vocabulary()), 0
    for r in last.orderBy("start").collect():
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pipeline_stages_on_odd_tables(spark, data, odd, empty, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(0, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(12, 1, 1), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    extra = odd.withColumn("component_id", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("score", F.lit(0.5))
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
    every = ids(extra)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, extra, sf)
        assert out.columns == extra.columns, name
        assert stage(spark, empty, sf).count() == 0
        left = ids(out)
        if name == "decontamination":
            # Three rows of "a b c" and the one of a null id go.
            assert left == [r for r in every if r[2] != "a b c"]
        if name == "near_copies":
            # Equal rows, and equal texts, are one; texts without words are never alike.
            assert [r for r in left if r[2] == "a b c"] == [(False, 6, "a b c")] and sum(not r[2].strip() for r in left) == 3
    # Rows of one id are told apart by their texts.
    shared = spark.createDataFrame([(1, "a b c", "en", "s", 5), (1, "wholly other words", "en", "s", 5), (1, "wholly other words", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.text for r in p.drop_contaminated(spark, shared, sf).collect()] == ["wholly other words"] * 2
    assert sorted(r.text for r in p.drop_near_copies(spark, shared, sf).collect()) == ["a b c", "wholly other words"]
    last = p.write_tokens(spark, extra, sf)
    assert last.count() == extra.count() and p.write_tokens(spark, empty, sf).count() == 0


def test_near_pairs_are_told_many_at_a_time():
    rng = random.Random(7)
    lines, a, b = [], [], []
    for signs, size in itertools.product(("abcde ", "aé漢🙂 "), (1, 5, 63, 64, 65, 128, 129, 200)):
        for _ in range(2 * line_dedup.FEW_PAIRS):
            x = [rng.choice(signs) for _ in range(size)]
            y = list(x)
            for _ in range(rng.randint(0, size // 3 + 1)):
                i = rng.randrange(len(y))
                y[i : i + rng.randint(0, 1)] = rng.choice(("", *signs)) or y[i : i + 1] if len(y) > 1 else y
            a, b, lines = [*a, len(lines)], [*b, len(lines) + 1], [*lines, "".join(x), "".join(y)]
    lines += ["ab " * 1000, "ab " * 900 + "c" * 200]
    a, b = np.array([*a, len(lines) - 2, len(lines) - 1]), np.array([*b, len(lines) - 1, len(lines) - 2])
    want = [line_dedup.similar(lines[i], lines[j], 80) for i, j in zip(a, b, strict=True)]
    assert line_dedup.near_pairs(lines, a, b, 80).tolist() == want and 0.1 < np.mean(want) < 0.9


def test_pairs_of_a_long_list_never_become_rows(spark, monkeypatch):
    """Lines that share a passage but are strangers meet within their lists, here cut into parts of seven."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage = [word() for _ in range(14)]
    lines = [" ".join(passage + [word() for _ in range(7)]) for _ in range(60)]
    lines += [x + "s" for x in lines[:20]]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    given, linked = [], line_dedup.linked_components

    def watched(posts, possible, verify, *rest):
        return linked(posts, possible, lambda pairs: given.append(pairs.count()) or verify(pairs), *rest)

    monkeypatch.setattr(line_dedup, "linked_components", watched)
    monkeypatch.setattr(line_dedup, "LIST_PART", 7)
    assert sorted(r.id for r in line_dedup.repeated_lines(rows).collect()) == list(range(60, 80))
    # Only the lists' centres: at most two pairs a line.
    assert len(given) == 1 and given[0] <= 2 * len(lines)


@pytest.mark.parametrize("at_a_time", [1 << 17, 10])
def test_links_of_a_list_grow_with_its_rows(monkeypatch, at_a_time):
    """Thirty lines that are all near one another, and five strangers: 29 links, not all 435 pairs."""
    line = "one two three four five six seven eight nine ten eleven twelve"
    lines = [line + f" {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30)] + [chr(97 + i) * 70 for i in range(5)]
    n, given, near_pairs = len(lines), [], line_dedup.near_pairs

    def watched(texts, a, b, percent):
        given.append(len(a))
        return near_pairs(texts, a, b, percent)

    monkeypatch.setattr(line_dedup, "near_pairs", watched)
    monkeypatch.setattr(line_dedup, "COMPARED", at_a_time, raising=False)
    held = [{"tok": 9, "part": 0, "cid": i, "comp": i, "home": 0, "sim": 0, "sim2": 0, "gsim": 0, "size": 20, "kind": line_dedup.WORDY, "toks": [9], "words": x} for i, x in enumerate(lines)]
    table = pa.Table.from_pylist([x | {"away": False} for x in held] + [x | {"away": True} for x in held[1:]])
    links = line_dedup.list_links(table, 80, 3)
    pairs = list(zip(links.column("a").to_pylist(), links.column("b").to_pylist(), strict=True))
    assert len(pairs) == 29 and all(a < b < 30 for a, b in pairs)
    reached = {0}
    for _ in pairs:
        reached |= {x for p in pairs if reached & set(p) for x in p}
    assert reached == set(range(30))
    # What is joined up already is not compared.
    assert sum(given) < n * (n - 1) // 2 or at_a_time > n * n


def test_majorities_of_lines_of_any_size():
    """Votes are counted eight to a number up to 255 features, beyond that one by one; both are the features' majorities."""
    rng = np.random.default_rng(5)
    sizes = np.array([1, 2, 255, 256, 3, 300, 9000, 40])
    cuts = np.append(0, np.cumsum(sizes))
    features = rng.integers(0, 1 << 32, cuts[-1], np.uint64).astype(np.uint32)
    got = line_dedup.simhashes(features, cuts)
    for line, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        for half in range(2):
            own = line_dedup.mix(features[a:b].astype(np.uint64) + np.uint64(half << 40))
            assert int(got[line, half]) == sum(1 << k for k in range(64) if 2 * int((own >> np.uint64(k) & np.uint64(1)).sum()) > b - a)
    text = "aé漢🙂 b".encode() + b" xyz "
    assert line_dedup.length_codes(np.frombuffer(text, np.uint8), np.array([0, 13]), np.array([12, 3])).tolist() == [int(np.log(6) / np.log(1.2)), int(np.log(3) / np.log(1.2))]


def test_new_words_are_sent_in_short_texts(texts, monkeypatch):
    """New words go to the library in texts of a few words each, with the same identifiers as whole texts."""
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    library, most = wavelet.tokenizer(path), 0

    class Watched(wavelet.WordIds):
        def encode(self, texts):
            nonlocal most
            most = max(most, *(len(t.split()) for t in texts))
            return super().encode(texts)

    monkeypatch.setattr(wavelet, "TOGETHER", 3, raising=False)
    # Control characters and lone marks among words of letters, digits and signs; some give no identifier.
    rows = [*list(texts.values())[:40], "\x00 \x00a \x7f b\x01c ́ é 1 22 ... don't x-y", "​ ﻿ \x01", "", "new words, all of them. new words"]
    ids = Watched(path, np.uint16)
    for some in (rows, rows[::-1]):
        got, first = ids.rows(*part_bytes(pa.array(some)))
        assert [got[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    # Three words with the cuts between them.
    assert 0 < most <= 5
    where, inverse = wavelet.distinct(np.array([5, 3, 5, 9, 3], np.uint64))
    assert len(where) == 3 and where[inverse].tolist()[3] == 3 and [(5, 3, 5, 9, 3)[i] for i in where[inverse]] == [5, 3, 5, 9, 3]
