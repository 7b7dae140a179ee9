"""Repeated runs of lines against brute force over all pairs of places."""

import random

import corpus_pipeline
from prismtally.llm import linededup
from tests.llm.test_near_duplicates import documents, words


def plain_runs(rows):
    """Per row the text without lines in runs of two or more lines with words that an earlier place has, by growing each run."""
    worded = lambda x: bool(x.strip(" \t\n\r\x0b\x0c"))
    parts = [((2**63 if i is None else i), (t or "").split("\n")) for i, t in rows]
    gone = [set() for _ in rows]
    for x, (doc, lines) in enumerate(parts):
        for y, (other, earlier) in enumerate(parts):
            if other > doc or (other == doc and x != y):
                continue
            for a in range(len(lines)):
                for b in range(len(earlier)):
                    if x == y and b >= a:
                        break
                    n = 0
                    while a + n < len(lines) and b + n < len(earlier) and lines[a + n] == earlier[b + n] and (x != y or b + n < a):
                        n += 1
                    run = [k for k in range(a, a + n) if worded(lines[k])]
                    if len(run) >= 2:
                        gone[x].update(range(run[0], run[-1] + 1))
    return sorted(((i, "\n".join(s for k, s in enumerate((t or "").split("\n")) if k not in g) if g else t, len(g)) for (i, t), g in zip(rows, gone, strict=True)), key=str)


def test_every_repeated_run_goes(spark):
    rng = random.Random(4)
    lines = [words(rng, 6) for _ in range(400)] + ["", " "]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 12))) for _ in range(20)]
    for _ in range(25):
        own, other = rng.choice(texts).split("\n"), rng.sample(lines, 4)
        at = rng.randrange(len(own))
        texts.append("\n".join(other[:2] + own[at : at + rng.randint(2, 5)] + other[2:]))
    texts += [texts[0] + "\n\n" + texts[1], texts[2], "\n" + texts[3] + "\n", "", None, "\n", "one line", "one line"]
    rows = list(zip(rng.sample(range(999), len(texts)), texts, strict=True)) + [(None, texts[4])]
    got = linededup.without_repeats(documents(spark, [t for _, t in rows], [i for i, _ in rows]))
    found = sorted(((r["doc_id"], r["text"], r["n_removed_lines"]) for r in got.collect()), key=str)
    assert found == plain_runs(rows) and sum(n > 0 for _, _, n in found) >= 20


def test_a_run_that_overlaps_itself_keeps_its_first_place(spark):
    got = linededup.without_repeats(documents(spark, ["a\na\na\na\nb", "a\na"]))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {0: "a\na\nb", 1: ""}
    assert linededup.without_repeats(documents(spark, [])).count() == 0


def test_full_copies_leave_no_stump(spark):
    """With chunks, single-line chunks of a copy stayed as a document of their own."""
    rng = random.Random(6)
    texts = ["\n".join(words(rng, 8) for _ in range(n)) for n in (2, 3, 7, 12, 30)]
    docs = documents(spark, texts + [t + "\n" for t in texts] + ["", None])
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert kept == {**dict(enumerate(texts)), 10: "", 11: None}
