"""SimHash, substring and line dedup against brute force, on small tables with odd rows."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from prismtally.llm import linededup, simhash, substring
from prismtally.llm.components import components
from prismtally.llm.fmindex import FMIndex, WaveletMatrix, suffix_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", 0, "clash") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def plain_fingerprint(text):
    parts = [w for w in (text or "").encode().lower().split()]
    if not parts:
        return 0
    shingles = [b" ".join(parts[k : k + 3]) for k in range(max(1, len(parts) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance=2):
    ids = list(range(len(values)))
    label = ids[:]
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (values[a] ^ values[b]).bit_count() <= distance and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash_matches_brute_force(spark):
    rng = random.Random(1)
    base = [words(rng, rng.choice([1, 2, 3, 40, 400])) for _ in range(25)]
    texts = base + base[:6] + [t.upper() for t in base[6:9]] + [t + " end" for t in base[-5:]] + ["", None, " \n\t ", "é Ä", "É ä"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    want = [plain_fingerprint(t) for t in texts]
    assert [got[i]["fp"] % 2**64 for i in range(len(texts))] == want
    assert [got[i]["component_id"] for i in range(len(texts))] == plain_components(want)


@pytest.mark.parametrize("distance,segments,limit", [(2, 7, 2000), (2, 7, 1), (2, 3, 2), (3, 8, 1), (1, 4, 1)])
def test_links_lose_no_pair(spark, distance, segments, limit):
    """Also where every key is crowded and goes to the second ring."""
    rng = random.Random(distance * 100 + segments)
    values = set()
    for _ in range(25):
        seed = rng.getrandbits(64)
        values.add(seed)
        for _ in range(4):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                values.add(seed ^ (1 << bit))
            other = seed
            for bit in rng.sample(range(64), distance):
                other ^= 1 << bit
            values.add(other)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {tuple(r) for r in simhash.links(nodes, distance, segments, limit).collect()}
    want = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) % 2**64).bit_count() <= distance}
    assert got == want


def test_components_of_chains_and_stars(spark):
    chain = [(k + 1, k) for k in range(40)]
    star = [(100, k) for k in range(101, 130)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star + [(7, 7), (3, 2)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_tables(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0 and simhash.one_per_group(documents(spark, [])).count() == 0
    odd = documents(spark, ["same text here", "same text here", "other words stand there", "same text here", "same text here"], [None, 4, 9, 4, 2])
    assert [r["component_id"] for r in simhash.near_duplicates(odd).orderBy("component_id").collect()] == [2, 2, 2, 2, 9]
    kept = simhash.one_per_group(odd)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 9] and kept.columns == odd.columns
    nulls = documents(spark, [None, None], [None, None])
    assert [r["component_id"] for r in simhash.near_duplicates(nulls).collect()] == [None, None]
    assert simhash.one_per_group(nulls).count() == 1


def plain_substring(rows, window):
    seen = {}
    parts = [((2**63 if i is None else i), (t or "").encode().split()) for i, t in rows]
    for i, w in parts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = min(seen.get(key, i), i)
    out = []
    for (i, w), (doc, _) in zip(parts, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,gram,limit", [(50, 20, 10**9), (50, 20, 100), (10, 4, 10**9), (6, 6, 10**9)])
def test_substring_matches_brute_force(spark, window, gram, limit, monkeypatch):
    """With indexes and, under a small limit, with the grouping of whole windows."""
    monkeypatch.setattr(substring, "repeated_intervals", lambda *a, f=substring.repeated_intervals: f(*a, gram=gram, max_key_words=limit))
    rng = random.Random(window)
    passage, other = words(rng, 120), words(rng, 80, 3)
    texts = [words(rng, 30), passage, words(rng, 20) + "\n" + passage + " tail", "x " * 300, "x " * 170, other, other + " q " + other, "", None]
    texts += [" ".join(passage.split()[: 49 + k]) + f" z{k}" for k in range(6)] + [words(rng, 90, 2) for _ in range(4)]
    for _ in range(8):
        cut = texts[rng.randrange(1, 7)].split()
        at = rng.randrange(max(1, len(cut) - 40))
        texts.append(words(rng, 10) + " " + " ".join(cut[at : at + 70]) + " " + words(rng, 5))
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True)) + [(ids[1], texts[1]), (None, passage)]
    got = substring.without_repeats(documents(spark, [t for _, t in rows], [i for i, _ in rows]), window=window)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == plain_substring(rows, window)
    for row in got.collect():
        assert hashlib.sha256(row["kept_text"].encode()).hexdigest() == row["kept_sha256"]


def test_substring_of_an_empty_table(spark):
    assert substring.without_repeats(documents(spark, [])).count() == 0


def test_fm_index_parts():
    import numpy as np

    rng = np.random.default_rng(3)
    for size, alphabet in ((1, 2), (70, 2), (300, 9), (500, 300)):
        text = rng.integers(0, alphabet, size)
        matrix = WaveletMatrix(text, alphabet)
        at, symbol = rng.integers(0, size + 1, 50), rng.integers(0, alphabet, 50)
        assert matrix.rank(symbol, at).tolist() == [int((text[:a] == s).sum()) for a, s in zip(at, symbol, strict=True)]
        order, common = suffix_order(text, size)
        suffixes = [tuple(text[i:]) for i in order]
        assert suffixes == sorted(suffixes)
        for a, b, n in zip(suffixes, suffixes[1:], common[1:].tolist(), strict=False):
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
    index = FMIndex(np.array([1, 2, 1, 2, 3, 0, 2, 3, 0]), np.array([0, 0, 0, 0, 0, 0, 1, 1, 1]), 5)
    low, high = index.extended(np.array([0]), np.array([9]), np.array([3]))
    low, high = index.extended(low, high, np.array([2]))
    assert (high - low).tolist() == [2] and index.smallest_owner(low, high).tolist() == [0]


def plain_lines(rows):
    def chunks(text):
        lines = (text or "").split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        out, start = [], 0
        for k in range(len(lines)):
            if k == len(lines) - 1 or (hashes[k] + linededup.FACTOR * (hashes[k - 1] if k else 0)) % linededup.DIVISOR == 0:
                out.append(lines[start : k + 1])
                start = k + 1
        return out

    many = lambda c: sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in c) >= 2
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: 2**63 if r[0] is None else r[0]):
        kept, gone = [], 0
        for c in chunks(text):
            if many(c) and tuple(c) in seen:
                gone += len(c)
            else:
                kept += c
                if many(c):
                    seen.add(tuple(c))
        out.append((doc, "\n".join(kept) if gone else text, gone))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    lines = [words(rng, 6) for _ in range(60)] + ["", " ", "same"]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 9))) for _ in range(15)]
    block = "\n".join(lines[:30])
    texts += [block, "new\n" + block, block + "\nnew", "\n".join(lines[10:30]) + "\n\n\n", "", None, "\n", "one line"]
    rows = list(zip(rng.sample(range(99), len(texts)), texts, strict=True)) + [(None, block)]
    got = linededup.deduplicated(documents(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert sorted(((r["doc_id"], r["text"], r["n_removed_lines"]) for r in got.collect()), key=str) == plain_lines(rows)
    assert got.where("n_removed_lines > 5").count() >= 3 and "rid" in got.columns


def test_line_dedup_odd_tables(spark):
    assert linededup.deduplicated(documents(spark, [])).count() == 0
    twice = documents(spark, ["a b\nc d\ne f\ng h\ni j\nk l"] * 3, [5, 5, 6])
    got = linededup.deduplicated(twice.withColumn("n_lines", F.lit("old")))
    kept = {(r["doc_id"], r["n_removed_lines"]) for r in got.collect()}
    assert (5, 0) in kept and all(doc == 6 or gone == 0 for doc, gone in kept) and got.columns.count("n_lines") == 1
