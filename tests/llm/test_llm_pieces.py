"""Piece encoding, token counts, classifier and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollframe.llm import catalog
from rollframe.llm.decontamination import decontaminate
from rollframe.llm.quality_classifier import ClassifierParams, quality_classifier
from rollframe.llm.sentencepiece import Encoder, PieceModel, model_bytes, piece_decode, piece_encode
from rollframe.llm.token_counts import LongestMatch, token_counts, vocabulary

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "   ", " a", "a ", "  a  b ", "日本語テキスト 한국어", "a▁b ▁▁", "x" * 5000, "\n\n a\tb", "😀 ok\0z",
       "naïve café", "a" * 70_000 + " b", "word " * 20_000]


@pytest.fixture(scope="module")
def model():
    return PieceModel(model_bytes())


def pieces_of(path="/opt/tokenizers/piece_bpe_32k.model"):
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    return m


def test_viterbi_is_the_best_sum_of_scores(model):
    m = pieces_of()
    score = {p.piece: p.score for p in m.pieces if p.type in (1, 4)}
    unk = min(score.values()) - 10
    rng = random.Random(1)
    words = ["".join(rng.choice("thesingaor.,éñ!*") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    got = Encoder(model).encode(pa.array(words))
    for w, ids in zip(words, got):
        s = "▁" + w
        best = [0.0] + [-np.inf] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - 16), e):
                x = score.get(s[b:e], unk if e - b == 1 else -np.inf)
                best[e] = max(best[e], best[b] + x)
        mine, pending = 0.0, b""
        for i in map(int, ids.values):
            p = m.pieces[i]
            if p.type == 6:
                pending += bytes([int(p.piece[3:5], 16)])
                if pending.decode("utf-8", "ignore"):
                    mine, pending = mine + unk, b""
            else:
                mine += p.score
        assert mine == best[-1], w


def test_pieces_agree_with_the_library_as_unigram(model):
    import sentencepiece as spm
    m = pieces_of()
    m.trainer_spec.model_type = 1
    lib = spm.SentencePieceProcessor(model_proto=m.SerializeToString())
    words = sorted(set(re.findall(r"[a-z]+", "the thing of a reading person nothing than hest station inner order atonement")))
    for w, ids in zip(words, Encoder(model).encode(pa.array(words))):
        assert list(map(int, ids.values)) == lib.nbest_encode_as_ids(w, 2)[0]


def test_round_trip_of_odd_texts(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "again"), (None, "again")], "doc_id bigint, text string")
    out = piece_decode(piece_encode(d.withColumn("ids", F.lit("mine"))), "ids", "back").collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        assert r["back"] == r["text"]
        assert (r["ids"] is None) == (r["text"] is None)
    assert piece_encode(d.limit(0)).count() == 0


def test_forgetting_changes_nothing(model, monkeypatch):
    from rollframe.llm import sentencepiece as sp
    texts = [f"word{i} other{i % 7} the{i % 3}" for i in range(300)]
    want = Encoder(model).encode(pa.array(texts)).to_pylist()
    monkeypatch.setattr(sp, "MAX_UNITS", 5)
    e = Encoder(model)
    assert [e.encode(pa.array([t])).to_pylist()[0] for t in texts] == want
    assert [e.encode(pa.array([t])).to_pylist()[0] for t in reversed(texts)] == want[::-1]


def test_whole_tables_round_trip(spark):
    rows = catalog.op2_sentencepiece(spark, SF).collect()
    assert len(rows) == 200 and all(r["round_trip"] for r in rows)


def greedy(word, vocab):
    b, i, n = ("▁" + word).encode(), 0, 0
    while i < len(b):
        j = min(len(b), i + 64)
        while b[i:j] not in vocab:
            j -= 1
        i, n = j, n + 1
    return n


def test_token_counts_against_greedy(spark):
    vocab = set(vocabulary()) | {bytes([i]) for i in range(256)}
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ODD)], "doc_id bigint, text string, n_words int, c string")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts(d).collect()}
    for i, t in enumerate(ODD):
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        assert got[i] == (len(words), sum(greedy(w, vocab) for w in words))
    assert token_counts(d.limit(0)).count() == 0
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in catalog.op6_token_counts(spark, SF).collect():
        assert r["n_tokens"] == sum(greedy(w, vocab) for w in texts[r["doc_id"]].split())


def test_longest_match_links_pop_several_tokens():
    m = LongestMatch(["▁".encode(), b"abcde", b"ab", b"cd", b"bcx"])
    assert m.counts(pa.array(["abcdx", "abcde", "abc", "bcd", ""])).tolist() == [4, 2, 3, 3, 1]


def test_classifier_on_held_out_rows(spark):
    rows = catalog.op5_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) >= 0.95


def test_classifier_edges(spark):
    texts = [None, "", "plain words that go on. " * 20, "!!! " * 50, "w" * 100_000, "Long text of words. " * 20_000]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] + [(None, "x y", "mine"), (2, texts[2], "mine")],
                                 "doc_id bigint, text string, predicted string")
    few = spark.createDataFrame([(2, 1), (3, 0), (3, 0), (4, 1), (4, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    p = ClassifierParams(epochs=20)
    for labels, rate in ((few, None), (few.limit(0), 0.5), (few.where("quality = 1"), None)):
        out = quality_classifier(docs, labels, params=p).collect()
        assert len(out) == 8 and all(r["predicted"] in (0, 1) and 0 <= r["score"] <= 1 for r in out)
        assert rate is None or {r["score"] for r in out} == {rate}
    assert quality_classifier(docs.limit(0), few, params=p).count() == 0


def test_words_of_one_shape_are_told_apart(spark):
    rng = random.Random(6)
    names = ["".join(rng.choices("abcdefghijklmnop", k=4)) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(names[:20] if i % 2 else names[20:], k=30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    held = quality_classifier(docs, labels, threshold=0.5).where("held_out").collect()
    assert len(held) > 40 and sum(r["predicted"] == r["doc_id"] % 2 for r in held) / len(held) > 0.9


def test_vectors_cover_all_documents(spark):
    from rollframe.llm.quality_classifier import fit

    long = "qqrs " * 4 + "filler words of a text above the old bound " * 800
    rows = [(i, "few labelled words here") for i in range(10)] + [(100 + i, "seldom labelled word zyxw") for i in range(30)]
    rows += [(200 + i, long) for i in range(6)] + [(None, None), (300, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(200 + i, 1) for i in range(6)], "doc_id bigint, quality int")
    p = ClassifierParams(epochs=5)
    vectors, network = fit(docs, labels, "doc_id", "text", "quality", p)
    assert {("w", "zyxw"), ("w", "qqrs"), ("w", "labelled")} <= set(vectors.row)
    again = fit(docs.repartition(5), labels, "doc_id", "text", "quality", p)[0]
    assert again.types == vectors.types and (again.vectors == vectors.vectors).all()
    longs = vectors.pooled(pa.array([long]))
    assert (abs((longs - network.mean) / network.scale) < 8).all()  # lengths like it were learned from


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(text, items, n=10):
    spots = [(m.start(), m.end(), m.group()) for m in WORD.finditer((text or "").translate(LOW))]
    words, hit, ids = [s[2] for s in spots], set(), set()
    for item, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            win = w[i:i + n]
            for j in range(len(words) - len(win) + 1):
                if words[j:j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    ids |= {str(item)} if item is not None else set()
    return len(words), sorted(hit), sorted(ids), spots


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (10, "Only three words"), (2, "ÉTÉ  chaud!"),
         (3, None), (4, "..."), (None, "nameless item"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]
TEXTS = [None, "", "...", "only THREE, words and only three words", "x alpha beta-gamma delta epsilon zeta eta theta iota kappa, lambda mu nu",
         "alpha beta gamma delta epsilon zeta eta theta iota", "l'ÉTÉ chaud", "nameless item", "only threewords", "only three words" * 3,
         "a b " * 30_000 + "only three words"]


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_decontamination_against_brute_force(spark, limit):
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(TEXTS)] * 2, "doc_id bigint, text string, items string")
    mine = ["__found", "__KEY", "__runs", "__items", "found_items", "block"]
    docs = docs.withColumns({c: F.lit(c) for c in mine})
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = decontaminate(docs, bench, max_benchmark_bytes=limit).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        n, hit, ids, spots = brute_hits(r["text"], ITEMS)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), ids)
        runs = [(a, b) for a, b in ((h, next(x for x in range(h, n + 1) if x not in hit)) for h in hit if h - 1 not in hit)]
        assert [(s["start"], s["end"]) for s in r["spans"]] == [(spots[a][0], spots[b - 1][1]) for a, b in runs]
        assert [r[c] for c in mine] == mine
    assert decontaminate(docs, bench.limit(0), max_benchmark_bytes=limit).where("n_hit > 0").count() == 0
    assert decontaminate(docs.limit(0), bench, max_benchmark_bytes=limit).count() == 0


@pytest.mark.parametrize("limit,part", [(40, 2048), (60, 3), (150, 1)])
def test_a_large_benchmark_gives_the_same_spans(spark, monkeypatch, limit, part):
    from rollframe.llm import decontamination as dc

    monkeypatch.setattr(dc, "PART_WORDS", part)
    more = [(20, "kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"), (21, "mu nu"), (22, "only three")]
    texts = [*TEXTS, "É x alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon! phi chi"]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] * 2, "doc_id bigint, text string, items string")
    bench = spark.createDataFrame(ITEMS + more, "item_id bigint, text string")
    one = sorted(map(str, decontaminate(docs, bench).collect()))
    assert sorted(map(str, decontaminate(docs, bench, max_benchmark_bytes=limit).collect())) == one
    assert decontaminate(docs, spark.createDataFrame([(1, "... " * 100)], bench.schema), max_benchmark_bytes=limit).where("n_hit > 0").count() == 0


def test_a_benchmark_of_many_blocks_takes_one_scan(spark, tmp_path, monkeypatch):
    from rollframe.llm import decontamination as dc

    words = [f"w{i}" for i in range(30_000)]
    items = [(i, " ".join(words[20 * i:20 * i + 24])) for i in range(1_000)]
    texts = [(i, " ".join(words[40 * i:40 * i + 11])) for i in range(300)] + [(999, "nothing of it " * 50)]
    bench, docs = (spark.createDataFrame(r, s) for r, s in ((items, "item_id bigint, text string"), (texts, "doc_id bigint, text string")))
    passes, hits = [], dc.block_hits
    monkeypatch.setattr(dc, "block_hits", lambda t, blocks, w: passes.append(len(blocks)) or hits(t, blocks, w))
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate(docs, bench, max_benchmark_bytes=20_000).collect()}
    assert len(passes) == 1 and passes[0] >= 6
    want = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate(docs, bench).collect()}
    assert got == want and sum(n > 0 for n, _ in got.values()) == 300
    decontaminate(docs, bench, max_benchmark_bytes=20_000, pass_bytes=60_000).count()
    assert len(passes) > 2 and max(passes[1:]) <= 3
