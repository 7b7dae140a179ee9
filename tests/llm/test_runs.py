"""Periodic runs against a walk along every diagonal."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from prismtally.llm import queries, runs


def plain_runs(words, least=6, repeats=4):
    """Every lag on its own; of lags that give the same stretch the smallest is its period."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, repeats * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def got(words, wanted=runs.Runs()):
    found = runs.periodic_runs(runs.word_numbers([w.encode() for w in words]), wanted)
    return [tuple(r) for r in found.tolist()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0], r[2]))


def test_all_short_texts_of_two_words():
    for n in range(15):
        for code in range(1 << n):
            words = ["ab"[code >> k & 1] for k in range(n)]
            assert got(words) == ordered(plain_runs(words)), words


def test_random_and_built_texts():
    rng, seen = random.Random(2), 0
    for _ in range(1500):
        part = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        words = [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        words += (part * 9)[: rng.randint(1, 9 * len(part))] * rng.randint(1, 4) + [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        want = ordered(plain_runs(words))
        assert got(words) == want
        seen += len(want)
    assert seen > 1000
    assert got(fibonacci(400)) == ordered(plain_runs(fibonacci(400)))
    other = runs.Runs(least=3, repeats=3)
    assert got(fibonacci(300), other) == ordered(plain_runs(fibonacci(300), 3, 3)) != []
    with pytest.raises(ValueError):
        runs.Runs(repeats=2)


def test_long_texts_stay_linear():
    words = np.zeros(300_000, np.int64)
    assert runs.periodic_runs(words).tolist() == [[0, 300_000, 1]]
    words[::1000] = 1
    assert runs.periodic_runs(words)[0].tolist() == [0, 300_000, 1000] and len(runs.periodic_runs(words)) == 301


def collapsed(words, found):
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_odd_tables(spark):
    rows = [(1, None, 1), (2, "", 2), (2, " \t\n", 3), (None, "x " * 9, 4), (3, "a b a b a b a b c", 5), (3, "a b a b a b a b c", 5), (4, "y " * 50_000, 6), (5, " x  x" * 3, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    for row in runs.with_runs(docs).collect():
        words = [w.decode() for w in (row["text"] or "").encode().split()]
        want = ordered(plain_runs(words)) if len(words) < 100 else [(0, 50_000, 1)]
        assert (row["found"]["n_words"], [tuple(r) for r in row["found"]["runs"]]) == (len(words), want)
        assert row["found"]["collapsed"] == collapsed(words, want)
    assert runs.with_runs(docs.limit(0)).count() == 0 and runs.with_runs(docs).columns == [*docs.columns, "found"]


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = {i: "\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 9))) for i in range(600)}
    texts |= {600: None, 601: "", 602: "one", 603: " ".join("ab" * 40)}
    path = str(tmp_path)
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    some = 0
    for row in queries.op13_periodic_runs(spark, path).collect():
        words = planted(row["doc_id"], (texts[row["doc_id"]] or "").split())
        found = ordered(plain_runs(words))
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert row["n_runs"] == len(found) and (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
        some += bool(found)
    assert some > 10
