"""Edge cases of the native operators: quality rules, URL filter, sharding, line dedup."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollframe.llm.line_dedup import line_dedup
from rollframe.llm.quality_rules import quality_rules
from rollframe.llm.sharding import Ranges, assign_shards
from rollframe.llm.url_filter import url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, ids=None, sources=None):
    ids = ids or range(len(texts))
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in zip(ids, texts, sources)], DOCS)


def repeat_words(words, n=5):
    wins = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
    often = Counter(wins)
    return len({j for i, w in enumerate(wins) if often[w] > 1 for j in range(i, i + n)})


def test_quality_rules_against_brute_force(spark):
    texts = [None, "", " \t\n", "one two", "a b c d e " * 40, "x y z " * 3 + "a b c d e f g x y z x y z",
             "Same line here.\nSame line here.\n\nOther # line | with & signs.\nSame line here.",
             "word\x0bword\x0cword\rword " * 5, "w" * 200_000, "é ü 日本 " * 30, "the end " * 3000]
    got = {r["doc_id"]: r for r in quality_rules(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        r = got[i]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeat_words(words)
        assert r["base_failed"] == (len(words) < 10 or 100 * repeat_words(words) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_lines(spark):
    prose = "It was a long and quiet evening by the sea, and nobody said a word."
    menu = "Home | News | Sport | Weather | About | Contact | Help"
    more = "Then the wind came up from the north."
    texts = [f"{prose}\n{more}\nAll rights reserved.", f"{prose}\n" + "\n".join([menu + str(i) for i in range(9)]),
             "THE!! BEST!! OFFER!! OF!! ALL!! TIMES!! AND!! NOW!! COME!! BUY!! THIS!!"]
    got = {r["doc_id"]: r for r in quality_rules(table(spark, texts)).collect()}
    assert got[0]["kept"] and got[0]["clean_text"] == f"{prose}\n{more}"
    assert not got[1]["kept"] and got[1]["n_kept_lines"] == 1
    assert not got[2]["kept"] and got[2]["n_kept_lines"] == 0


def test_quality_rules_empty_table_and_extra_columns(spark):
    d = table(spark, ["a b"]).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit("x")).withColumn("__t", F.lit(1))
    assert quality_rules(d).count() == 1
    assert quality_rules(d.limit(0)).count() == 0


def brute_capacity(sizes, n):
    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= n
    c = max([0, *sizes])
    while not fits(c):
        c += 1
    return c


def test_sharding_is_minimax_and_whole(spark):
    texts = ["hot"] * 60 + [f"text {i} " * (i % 7 + 1) for i in range(150)] + [None, "", "", None]
    docs = table(spark, texts).withColumn("shard", F.lit("mine"))
    rows = assign_shards(docs, 8).collect()
    assert len(rows) == len(texts)
    by_id = {r["doc_id"]: r for r in rows}
    import hashlib
    groups = Counter()
    for i, t in enumerate(texts):
        size = len((t or "").encode()) + 1
        assert by_id[i]["size"] == size and by_id[i]["text_crc32"] == zlib.crc32((t or "").encode())
        groups["0" * 32 if t is None else hashlib.md5(t.encode()).hexdigest()] += size
    order = [groups[k] for k in sorted(groups)]
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == brute_capacity(order, 8)
    assert set(load) <= set(range(8))
    for shard in load:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    for t in set(texts):
        assert len({by_id[i]["shard"] for i, x in enumerate(texts) if x == t}) == 1


def test_sharding_edges(spark):
    assert assign_shards(table(spark, ["a"]).limit(0)).count() == 0
    same = table(spark, ["same"] * 5, ids=[None, 1, 1, 1, 2])
    rows = assign_shards(same, 3).collect()
    assert {r["shard"] for r in rows} == {0} and sorted(r["slot"] for r in rows) == [0, 1, 2, 3, 4]


def test_ranges_narrow_to_the_group_level_cuts():
    import random
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 60))]
        whole = Ranges([(f"{i:032d}", s, True) for i, s in enumerate(sizes)])
        n = rng.randint(1, 9)
        assert whole.smallest(n, True) == brute_capacity(sizes, n)
        step = rng.randint(2, 7)
        coarse = Ranges([(f"{i:032d}", sum(sizes[i:i + step]), False) for i in range(0, len(sizes), step)])
        low, high = coarse.smallest(n, False), coarse.smallest(n, True)
        best = whole.smallest(n, True)
        assert low <= best <= high
        inside = set(coarse.open_ranges(low, high, n))
        ends = coarse.ends
        for cut in whole.fill(best, n, True):
            i = next(j for j, e in enumerate(ends) if e > cut)
            start = ends[i - 1] if i else 0
            assert cut == start or i in inside


def test_line_dedup(spark):
    text = ["menu\nown a\n menu \nother", "menu\nown b", "menu", "own c\nmenu\r", None, "", "own a"]
    docs = table(spark, text * 1, sources=["h"] * 5 + [None] * 2).withColumn("n_lines", F.lit("mine")).withColumn("host", F.lit(1))
    got = {r["doc_id"]: r for r in line_dedup(docs, "source", "text", 0.5, 3).collect()}
    assert got[0]["text"] == "own a\nother" and got[0]["n_dropped_lines"] == 2 and got[0]["n_lines"] == 4
    assert got[1]["text"] == "own b" and got[2]["text"] == "" and got[3]["text"] == "own c"
    assert got[4]["text"] is None and got[4]["n_lines"] == 0
    assert got[5]["text"] == "" and got[6]["text"] == "own a" and got[0]["host"] == 1
    assert line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    docs = table(spark, ["menu\nown a", "menu\nown b", "menu", None])
    names = ["__hs", "__hit", "__keep", "__host", "__drop", "host", "lines", "HS"]
    docs = docs.withColumns({c: F.lit(c) for c in names})
    rows = line_dedup(docs, "source", "text", 0.5, 3).collect()
    assert all([r[c] for c in names] == names for r in rows)
    assert {r["doc_id"]: r["text"] for r in rows} == {0: "own a", 1: "own b", 2: "", 3: None}


def test_line_dedup_of_pages_that_are_all_boilerplate(spark):
    import time

    page = "\n".join(f"line {i * 7919 % 80_000}" for i in range(80_000))
    docs = table(spark, [page, page + "\nown", page, page])
    t = time.time()
    got = {r["doc_id"]: (r["text"], r["n_dropped_lines"]) for r in line_dedup(docs, "source", "text", 0.5, 3).collect()}
    assert got == {0: ("", 80_000), 1: ("own", 80_000), 2: ("", 80_000), 3: ("", 80_000)}
    assert time.time() - t < 120


def test_line_dedup_looks_up_few_and_many_lines_alike(spark):
    import random

    rng = random.Random(2)
    pages = ["\n".join(rng.sample([f"l{i}" for i in range(200)], rng.choice([3, 31, 32, 33, 120]))) for _ in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup(table(spark, pages), "source", "text", 0.25, 3).collect()}
    seen = Counter(x for p in pages for x in set(p.split("\n")))
    assert got == {i: "\n".join(x for x in p.split("\n") if not (seen[x] >= 3 and seen[x] > 15)) for i, p in enumerate(pages)}


def test_line_dedup_counts_pages_not_lines(spark):
    docs = table(spark, ["again\nagain\nagain\nagain", "x", "y", "z"])
    assert {r["n_dropped_lines"] for r in line_dedup(docs, "source", "text", 0.5, 2).collect()} == {0}


@pytest.mark.parametrize("url,host,path,rule", [
    (None, "", "", None), ("", "", "", None), ("no scheme/x", "", "", None), ("http://A.COM", "a.com", "", None),
    ("http://A.Com/x?y#z", "a.com", "/x", "com/"), ("x://example.com/en/1", "example.com", "/en/1", "example.com/en/"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
    ("http://b.www.example.com/en/q", "b.www.example.com", "/en/q", "www.example.com/en/"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/"), ("http://x.net/es/1", "x.net", "/es/1", "net/es/"),
    ("http://x.net/es", "x.net", "/es", None), ("http://x.org?q=/a://b", "x.org", "", None), ("http://é.net/fr/ü", "é.net", "/fr/ü", "net/fr/")])
def test_url_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url, None)], "page_id bigint, url string, html string")
    r = url_filter(pages.withColumn("verdict", F.lit("mine"))).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
    assert r["verdict"] == ("block" if rule and rule.startswith(("example", "net")) else "allow")


def test_url_model_separates_what_rules_leave(spark):
    good = [f"http://calm{i % 9}reading.com/books/novel{i}" for i in range(120)]
    bad = [f"http://xx{i % 9}zzqq.net/es/qqzz{i}xx" for i in range(120)]
    rest = ["http://calm3reading.org/books/novel4", "http://xx5zzqq.org/qqzz7xx", "http://" + "a" * 50_000 + ".org/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(good + bad + rest + rest)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter(pages).collect()}
    assert got[240] == got[243] == "allow" and got[241] == got[244] == "block" and len(got) == 246
    assert url_filter(pages.limit(0)).count() == 0
