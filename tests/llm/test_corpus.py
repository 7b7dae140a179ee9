"""Quality rules, mixing, packing, nearest neighbours, URL filters, HTML extraction and WARC on small tables."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismtally.llm import ann, htmltext, mixing, packing, quality, queries, urls, warc
from prismtally.llm.textstats import text_counts

SCHEMA = "doc_id long, text string, source string, copies string, size string, length string"


def documents(spark, rows):
    """``rows``: (doc_id, text, source), with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


# --- Quality rules


def plain_repeats(words):
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(inside)


def test_text_counts_match_brute_force():
    rng = random.Random(2)
    texts = ["", " \n", "one", "a b c d e a b c d e", "é #*$ & ü\n\né #*$ & ü\n \n", "x " * 30, "日本 語\r\n日本 語\r"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(20)]
    for text in texts:
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), plain_repeats(words))
        assert text_counts(text.encode())[:5] == want
    assert text_counts(None) == text_counts(b"")


def quality_tables(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(20, 60))]
        text = " ".join(w + "$$" for w in words) if bad else " ".join(words)
        rows.append((k, text, "s"))
        labels.append((k, int(not bad), 0))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_hold_on_unseen_rows(spark):
    docs, labels = quality_tables(spark)
    rules = quality.fit_rules(docs, labels.where("doc_id < 200"))
    assert rules and all("symbols" in t or "mean_word" in t for t in quality.rule_texts(rules))
    verdicts = quality.judged(docs, labels.where("doc_id < 200")).where("doc_id >= 200").join(labels, "doc_id")
    assert verdicts.where("kept = (quality = 0)").count() <= 2
    again = quality.fit_rules(docs.repartition(5), labels.where("doc_id < 200").repartition(3))
    assert again == rules


def test_quality_odd_tables(spark):
    docs, labels = quality_tables(spark, 40)
    none = labels.limit(0)
    assert quality.fit_rules(docs, none) == [] and quality.fit_rules(docs.limit(0), labels) == []
    assert quality.judged(docs.limit(0), none).count() == 0
    odd = documents(spark, [(None, None, None), (1, "", "s"), (1, "a b c d e f g h i j k", "s"), (1, "a b c d e f g h i j k", "s")])
    assert sorted(r["kept"] for r in quality.judged(odd, none).collect()) == [False, False, True, True]
    kept = quality.keep_good(odd.withColumn("statistics", F.lit(1)).withColumn("n_words", F.lit(0)), none)
    assert kept.count() == 2 and kept.columns[-2:] == ["statistics", "n_words"]
    clash = labels.unionByName(labels.where("doc_id = 0").withColumn("quality", F.lit(1))).unionByName(labels.withColumn("quality", F.lit(None).cast("int")))
    assert quality.usable_labels(clash).count() == 39


# --- Mixing


def plain_targets(sizes, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, budget = {}, set(names), share * sum(sizes.values())
    while left:
        total = sum(weight[s] for s in left)
        above = [s for s in left if budget * weight[s] / total > most * sizes[s] + 1e-9]
        if not above:
            return {**target, **{s: budget * weight[s] / total for s in left}}
        for s in above:
            target[s] = most * sizes[s]
            budget -= target[s]
            left.discard(s)
    return target


def mix_rows(seed, n):
    rng = random.Random(seed)
    sources = [None, "", "a", "b", "Ä", "z", "hot", "hot", "hot"]
    return [(k, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(sources)) for k in range(n)]


@pytest.mark.parametrize("seed,n", [(1, 400), (2, 60), (3, 7)])
def test_mix_comes_near_its_targets(spark, seed, n):
    rows = mix_rows(seed, n)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = plain_targets(sizes)
    got = mixing.mixed(documents(spark, rows))
    table = got.groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("s"), F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    longest = {s: max(len(t.split()) for _, t, o in rows if o == s) for s in sizes}
    assert {r["source"]: r["s"] for r in table} == sizes
    for r in table:
        assert r["t"] == pytest.approx(want[r["source"]])
        assert abs(r["taken"] - r["t"]) <= longest[r["source"]]
    assert got.where("copies NOT IN (0, 1, 2)").count() == 0 and got.count() == n
    again = mixing.mixed(documents(spark, rows[::-1]).repartition(4))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_two_margins_are_balanced_at_once(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 50), ("b", "x", 10), ("b", "y", 300)], "s string, l string, tokens long")
    wanted = {"s": {"a": 200.0, "b": 220.0}, "l": {"x": 120.0, "y": 300.0}}
    frames = {c: spark.createDataFrame(list(v.items()), "level string, target double") for c, v in wanted.items()}
    rows = mixing.entropy_multipliers(cells, frames).collect()
    for column, targets in wanted.items():
        for level, target in targets.items():
            assert sum(r["tokens"] * np.exp(r["multiplier"]) for r in rows if r[column] == level) == pytest.approx(target, rel=1e-6)
    # Multipliers add up over the columns, which is what makes the rates the closest ones in entropy.
    m = {(r["s"], r["l"]): r["multiplier"] for r in rows}
    assert m["a", "x"] - m["a", "y"] == pytest.approx(m["b", "x"] - m["b", "y"], rel=1e-9)


def test_mix_odd_tables(spark):
    assert mixing.mixed(documents(spark, [])).count() == 0 and mixing.expanded(documents(spark, [])).count() == 0
    empty = mixing.mixed(documents(spark, [(1, None, None), (None, "", "s"), (2, " ", "s")]))
    assert empty.count() == 3 and empty.agg(F.sum(F.col("copies") * F.col("size"))).first()[0] == 0
    rows = mix_rows(5, 80)
    docs = documents(spark, rows)
    counts = {(r["doc_id"]): r["copies"] for r in mixing.mixed(docs).collect()}
    made = {r["doc_id"]: r["n"] for r in mixing.expanded(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert made == {k: v for k, v in counts.items() if v} and mixing.expanded(docs).columns == docs.columns


# --- Packing


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_equals_item_by_item_best_fit():
    rng = random.Random(6)
    for capacity in (1, 7, 16, 100):
        for _ in range(30):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            used, places = {}, 0
            for length, a, b, first, per, offset in packing.best_fit_plan(counts, capacity):
                for k in range(b - a):
                    used.setdefault(first + k // per, []).append((offset + k % per * length, length))
                    places += 1
            assert places == len(lengths)
            rooms = []
            for parts in used.values():
                end = 0
                for offset, length in sorted(parts):
                    assert offset == end
                    end += length
                rooms.append(capacity - end)
            assert sorted(rooms) == plain_best_fit(lengths, capacity)


def vocabulary():
    return public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN, queries.SPECIAL


def test_ids_equal_those_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.PackedEncoder(*vocabulary())
    rng = random.Random(7)
    pieces = ["a", "Ab", "it's", " ", "  ", "\n", "\t", "\r\n", "é", "日本", "42", "...", "\u00a0", "\u2003", "don't", "<|endoftext|>", "<|endof", "x\u0085", "'ll", "🙂"]
    texts = ["", " ", "  ", "a ", " a", "a  b", "a   b", "a\n b", "a \nb", "a\n \nb", "a\n", " \n ", "x <|endoftext|> y"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(3000)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        got = encode(text)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want.ids, repr(text)


def test_packing_places_every_piece(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 20, 300, 900]))), "s") for k in range(60)] + [(60, None, None), (60, None, None)]
    docs = documents(spark, rows)
    pieces = packing.token_pieces(docs, *vocabulary())
    placed = packing.placed(pieces).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t, _ in rows}
    by_bin, by_doc = {}, {}
    for r in placed:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and r["length"] <= 1024
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for parts in by_bin.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    for doc, parts in by_doc.items():
        if doc != 60:
            assert [p for p, _, _ in sorted(parts)] == list(range(len(parts))) and sum(n for *_, n in parts) == len(ids[doc])
            assert all(n == 1024 for p, _, n in parts if p) and (len(parts) == 1 or len(ids[doc]) > 1024)
    lengths = [n for parts in by_bin.values() for _, n in parts]
    assert len(by_bin) == len(plain_best_fit(lengths, 1024))
    assert packing.placed(packing.token_pieces(documents(spark, []), *vocabulary())).count() == 0


# --- Nearest neighbours


def plain_neighbours(ids, x, query, k):
    d = np.sqrt(((x - x[ids.index(query)]) ** 2).sum(axis=1))
    near = sorted((d[i], v) for i, v in enumerate(ids) if v != query)
    return [(v, float(s)) for s, v in near[:k]]


@pytest.mark.parametrize("list_rows,floor", [(10_000, 1.0), (60, 0.9)])
def test_neighbours_against_brute_force(spark, list_rows, floor):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    x[700:760] = x[699]  # one frequent vector
    ids = [int(v) for v in rng.permutation(5000)[:1500]]
    table = spark.createDataFrame([(v, row.tolist(), 1) for v, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, score int")
    got = ann.nearest_neighbours(table, F.col("vec_id") % 25 == 0, k=10, list_rows=list_rows).collect()
    hits = total = 0
    for query in [v for v in ids if v % 25 == 0]:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == query)
        want = plain_neighbours(ids, x, query, 10)
        assert [r for r, *_ in mine] == list(range(1, 11))
        assert [s for *_, s in mine] == sorted(s for *_, s in mine)
        exact = dict(plain_neighbours(ids, x, query, len(ids)))
        assert all(s == pytest.approx(exact[v], rel=1e-12) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for v, _ in want})
        total += 10
    assert hits / total >= floor


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest_neighbours(spark.createDataFrame([], schema), F.col("vec_id") % 2 == 0).count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (2, None), (4, [0.0, 0.0]), (6, [nan, 1.0]), (8, [inf, 1.0]), (10, [None, 1.0]), (12, [1.0]), (None, [1.0, 1.0]), (3, [0.0, 1.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (14, [])]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, schema), F.col("vec_id") % 2 == 0, k=10).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 3), (0, 2, 5)]
    assert got[0]["score"] == pytest.approx(2**0.5)
    assert ann.nearest_neighbours(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") == 0).count() == 0


# --- URL filters


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def test_urls_and_rules(spark):
    texts = [
        None, "", "no scheme", "http://", "HTTP://A.Example.ORG", "http://example.org/es/x?y#z", "http://sub.example.org/en/12", "http://notexample.org/es/", "x://É.com?p=://q/",
        "http://a.com/de/1", "http://com/fr/", "http://a.com/frx/", "http://b.net/#/x", "a://b://c/d", "http://example.org/en/2\n3", "http://org/x",
    ]
    table = spark.createDataFrame([(k, u, "z") for k, u in enumerate(texts)], "page_id long, url string, host string")
    got = urls.judged(table, queries.URL_RULES, None).orderBy("page_id").collect()
    assert [(r["host"], r["path"]) for r in got] == [plain_url(u) for u in texts]
    for r, u in zip(got, texts, strict=True):
        host, path = plain_url(u)
        fitting = [x for x in queries.URL_RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fitting, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r["rule"], r["verdict"]) == ((best[0] + best[1], best[2]) if best else (None, "allow"))
    assert urls.judged(table.limit(0), [], None).count() == 0


def test_url_model_on_unseen_hosts(spark):
    model = urls.fit_urls(queries.labelled_urls(spark))
    bad = ["http://www.best-casino.example.com/en/7", "http://cheap-pharmacy.example.net/fr/1", "http://poker-slots.example.com/x", "http://free-torrent.example.net/"]
    good = ["http://cityhistory.example.net/en/9", "http://blog.mountain-photo.example.com/es/4", "http://m.qwzrt.example.net/de/8", "http://ththon.example.com/en/1"]
    table = spark.createDataFrame([(k, u) for k, u in enumerate(bad + good + [None])], "page_id long, url string")
    verdicts = [r["verdict"] for r in urls.judged(table, [], model).orderBy("page_id").collect()]
    assert verdicts == ["block"] * 4 + ["allow"] * 5
    again = urls.fit_urls(queries.labelled_urls(spark).repartition(3))
    assert np.allclose(again.coefficients.toArray(), model.coefficients.toArray(), atol=1e-6)


# --- HTML extraction


ARTICLE = "<h1>Title &amp; more</h1><p><b>First  block<br>goes on.<p>Second\n block.</p><p>x</p><ul><li>one</li><li><a href=q>two</a></li></ul>"
WANTED = "Title & more\n\nFirst block goes on.\n\nSecond block.\n\nx\n\none\n\ntwo"
NOISE = (
    "<nav><ul><li><a href='/a'>menu</a></li></ul></nav><div class=\"ad\">Buy now, a long text about things to buy.</div>"
    "<script>var t='</p><article>no';</script><style>p{}</style><!-- <p>hidden</p> -->"
)
FOOT = "<section id='comments'><p>What a nice text, says a reader.</p></section><form><p>Your mail</p><input></form><aside><p>Side text.</p></aside><footer>&copy; host</footer>"


@pytest.mark.parametrize(
    "page",
    [
        f"<!DOCTYPE html><html><head><title>T</title></head><body><header>Site</header>{NOISE}<article>{ARTICLE}</article>{FOOT}</body></html>",
        f"<body>{NOISE}<main><div>{ARTICLE}</div></main>{FOOT}",
        f"<BODY>{NOISE}<ARTICLE CLASS=post><header>{ARTICLE}</header></ARTICLE>{FOOT}",
        f"<body><div class='top-menu'><a>m</a></div>{NOISE}<div id=content>{ARTICLE.replace('<a href=q>', '').replace('</a>', '')}</div>{FOOT}</body>",
        f"<article>{ARTICLE}",
    ],
)
def test_article_text(page):
    assert htmltext.main_text(page) == WANTED


def test_extraction_of_odd_pages(spark):
    assert htmltext.main_text("plain &lt;text&gt; a < b") == "plain <text> a < b"
    assert htmltext.main_text("<p>cut off <a href='x") == "cut off"
    assert htmltext.areas(np.array([0, 5, 0, 0, 0, 7, 8])) == [(1, 4), (5, 7)] and htmltext.areas(np.array([], np.int64)) == []
    long = "<p>word</p>" * 20_000
    rows = [(1, "u", f"<article>{ARTICLE}</article>", 1), (None, None, None, 2), (3, "v", "", 3), (3, "v", "", 3), (4, "w", long, 4)]
    got = htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    by_id = {r["page_id"]: r for r in got}
    assert by_id[1]["text"] == WANTED and by_id[1]["n_chars"] == len(WANTED) and len(got) == 5
    assert by_id[None]["text"] == by_id[3]["text"] == "" and by_id[4]["n_chars"] == 20_000 * 4 + 2 * 19_999
    assert htmltext.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- WARC


def test_warc_round_trip(spark, folder):
    rng = random.Random(3)
    pages = ["<p>a</p>", "", None, "\r\n\r\nWARC/1.1\r\n", "é\x00ü" * 50, "<p>a</p>", "".join(rng.choice("ab \n") for _ in range(200_000)), "<p>a</p>"]
    rows = [(10 * k, f"http://x/{k}\r\nA: b%0A" if k else None, h, "z") for k, h in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    uri = f"file://{folder}/w"
    warc.write_pages(table, uri)
    records = warc.read_records(spark, uri).where(F.col("record_type").isin("response", "revisit")).collect()
    got = {r["page_id"]: r for r in records}
    assert len(records) == len(rows)
    first = {}
    for page_id, url, page, _ in rows:
        payload = (page or "").encode()
        first.setdefault(payload, page_id)
        r = got[page_id]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode() and r["payload_bytes"] == len(payload)
        assert r["target_uri"] == url
        if first[payload] == page_id:
            assert r["record_type"] == "response" and bytes(r["payload"]) == payload and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["payload"] is None and r["refers_to"] == f"<urn:page:{first[payload]}>"


def test_warc_predicates_partitions_and_small_payloads(spark, folder):
    rows = [(k, "u", "same" if k % 2 else "longer text that repeats") for k in range(40)]
    uri = f"file://{folder}/w"
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), uri, least=10)
    records = warc.read_records(spark, uri)
    assert records.where("record_type = 'warcinfo'").count() == records.where("page_id IS NULL").count() > 0
    revisits = records.where("record_type = 'revisit'")
    assert revisits.count() == 19 and records.where("record_type = 'response'").count() == 21
    assert records.where("record_id = '<urn:page:3>' AND payload_bytes = 4").count() == 1
    assert warc.read_records(spark, uri, payload=False).where("payload IS NOT NULL").count() == 0
    warc.write_pages(spark.createDataFrame([(99, "u", "appended")], "page_id long, url string, html string"), uri)
    assert warc.read_records(spark, uri).where("record_type IN ('response', 'revisit')").count() == 41
    reader = warc.WarcReader({"path": uri, "partitionbytes": "1"})
    whole = warc.WarcReader({"path": uri})
    assert len(reader.partitions()) > 1 and len(whole.partitions()) == 1
    empty = f"file://{folder}/e"
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_records(spark, empty).count() == 0


def test_records_read_by_hand(folder):
    """Headers come first; what a predicate refuses is skipped to the next record, whatever its length."""
    path = f"{folder}/x.warc.gz"

    class Row:
        def __init__(self, page_id, payload, refers_to=None):
            self.page_id, self.payload, self.refers_to, self.target_uri = page_id, payload, refers_to, "u"

    with open(path, "wb") as out:
        for k in range(5):
            out.write(warc.page_record(Row(k, b"x" * (k * 70_000), 0 if k == 3 else None)))
    reader = warc.WarcReader({"path": f"file://{folder}"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 5)]))) == 1
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert [(r[7], r[5], len(r[8])) for r in rows] == [(k, k * 70_000, k * 70_000) for k in (0, 1, 2, 4)]
