"""Operators that SQL can't express, against brute force, round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaiq.llm import decontaminate, htmltext, langid, linededup, queries, simhash, sketch, toxicity
from mosaiq.llm.bpe import ChunkEncoder, bpe_encode, cuts
from mosaiq.llm.common import Memo, held_out, shared_dir, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [(None, None, 1), (1, "", 2), (1, "", 2), (2, " \n\t", 3), (3, "word " * 30_000, 4), (4, "x", 5), (None, "x", 6)]
ODD_SCHEMA = "doc_id long, text string, score int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


# --- BPE -------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return ChunkEncoder(tokenizer_path("word_bpe_49k.json"), bits=3)


PIECES = st.sampled_from([*"aAbB éÉßçñ'sItT 09²½.,!?%&<|>\n\t\r\x0b\x85\xa0日本İıΣσςȩ́ﬁ한글🙂\x1c", "<|endoftext|>", " <|startoftext|>", "'ll", "the "])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=120).map("".join), min_size=1, max_size=4))
def test_bpe_equals_the_library(coder, texts):
    want = [x.ids for x in coder.lib.encode_batch(texts, add_special_tokens=False)]
    got = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [coder.decode(x) for x in got] == [coder.lib.decode(w, skip_special_tokens=False) for w in want]


def test_cuts_depend_on_what_is_before_them_only():
    random.seed(1)
    tail = "".join(random.choices("abcdefg ", k=4000))
    a, b = cuts(["x" * 50 + tail, "yz" * 333 + tail], 6)
    assert {p - 50 for p in a if p > 66} == {p - 666 for p in b if p > 682}


def test_bpe_query_digests(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op7_bpe_chunk_reuse(spark, SF).collect():
        ids = lib.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_chunks_are_reused_and_joins_repaired():
    """Passages of 300 characters in other surroundings are encoded once; a piece with wrong ids is
    found by its window and put right."""
    path = tokenizer_path("word_bpe_49k.json")
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(300)) for _ in range(6)]
    texts = [" ".join([*(word() for _ in range(20)), passages[i % 6], *(word() for _ in range(20))]) for i in range(60)]
    coder = ChunkEncoder(path)
    want = [np.array(x.ids, "<u4").tobytes() for x in coder.lib.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want
    assert 100 < coder.seen[1] / coder.seen[0] < 200
    assert coder.reused[1] / coder.seen[1] > 0.6
    # a window with other ids than its pieces is found, and a text with such places is put right
    coder.pieces["piece"] = b"\x01\x00\x00\x00"
    assert coder._unequal([(0, 9, "some", "piece", "here"), (1, 5, "no", "other", "")]) == {0: [9]}
    assert [coder._repaired(t, [700, 20, len(t)]) for t in texts] == want


def test_other_vocabularies_are_refused():
    import os

    names = [n for n in os.listdir(os.path.dirname(tokenizer_path("word_bpe_49k.json"))) if n.endswith(".json") and n != "word_bpe_49k.json"]
    refused = 0
    for n in names:
        try:
            ChunkEncoder(tokenizer_path(n))
        except ValueError as e:
            refused += "can't be joined" in str(e)
        except Exception:  # noqa: BLE001  not a file of this library
            pass
    assert refused > 0


def test_bpe_odd_rows(odd):
    got = bpe_encode(odd, ["doc_id", "score"]).orderBy("score").collect()
    assert [r["n_tokens"] for r in got] == [0, 0, 0, 0, 30_000, 1, 1]
    assert got[0]["ids"] == [] and got[0]["decoded"] == ""


# --- SimHash ---------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    n, label = len(fps), list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash_query_equals_brute_force(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {d: (f"{f:016x}", rows[c][0]) for (d, _), f, c in zip(rows, fps, plain_components(fps), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash_anchors(spark, SF).collect()}
    assert got == want


def test_simhash_dense_group_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 4)
    monkeypatch.setattr(simhash, "BLOCK", 32)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(90)} | {rng.getrandbits(64) for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    got = [root.get(f, f) for f in signed]
    want = plain_components(fps)
    pairs = lambda x: {(i, j) for i in range(len(x)) for j in range(i) if x[i] == x[j]}
    assert pairs(got) == pairs(want)


def test_anchors_cover():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, 50, dtype=np.uint64)
    key, of, home = simhash.anchors(fp)
    for i in range(50):
        own = key[(of == i) & home]
        for bits in ([0, 40, 63], [1, 2, 33], [31], [32, 5]):
            near = fp[i]
            for b in bits:
                near ^= np.uint64(1 << b)
            assert set(own) & set(simhash.anchors(np.array([near]))[0])


def test_simhash_links_broadcast_no_replicas(spark):
    plan = simhash.links(spark.range(50).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_components_of_a_long_chain(spark):
    """Many rounds leave neither a size estimate that grows with each nor the tables of the rounds before."""
    ids = F.xxhash64("id"), F.xxhash64(F.col("id") + 1)
    links = spark.range(3000).select(ids[0].alias("a"), ids[1].alias("b")).repartition(16, "a")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = {*folder.glob("mosaiq-*")}
    root = simhash.components(links)
    assert len({*folder.glob("mosaiq-*")} - before) == 1
    rows = root.collect()
    assert len(rows) == 3000 and len({r["root"] for r in rows}) == 1 and rows[0]["root"] < min(r["node"] for r in rows)
    assert float(str(root._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1e7


def test_simhash_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# --- line dedup --------------------------------------------------------------


def words(rng, n):
    return " ".join(f"{rng.choice('bcdfg')}{rng.randrange(4000)}" + ("\n" if rng.random() < 0.06 else "") for _ in range(n))


def test_passages_go_where_they_come_later(spark):
    rng = random.Random(3)
    passages = [words(rng, 80) for _ in range(12)]
    rows = [(i, f"{words(rng, rng.randint(5, 60))} {passages[i % 12]} {words(rng, rng.randint(5, 60))}") for i in range(36)]
    clean = [(100 + i, words(rng, 150)) for i in range(20)]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    for i, text in rows:
        n, k = got[i]["n_removed"], len(passages[i % 12].split())
        if i < 12:
            assert n == 0 and got[i]["text"] == text
        else:
            assert 30 <= n <= k
            left, all_words = got[i]["text"].split(), text.split()
            at = next((j for j, (a, b) in enumerate(zip(left, all_words)) if a != b), len(left))
            assert left == all_words[:at] + all_words[at + n :]
    assert all(got[i]["text"] == t and got[i]["n_removed"] == 0 for i, t in clean)


def test_line_dedup_within_a_document_and_of_copies(spark):
    rng = random.Random(4)
    a, b = words(rng, 90), words(rng, 70)
    df = spark.createDataFrame([(1, a, "x"), (2, a, "y"), (3, f"{b}\n{b}\n{b}", "z"), (None, a, "w"), (5, None, "v"), (6, "", None)], "doc_id long, text string, n_removed string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    assert got[1]["text"] == a and got[2]["text"] == "" and got[None]["text"] == ""
    assert 60 <= len(got[3]["text"].split()) <= 100 and got[3]["text"].startswith(b[:50])
    assert got[5]["text"] is None and got[6]["text"] == ""


def test_line_dedup_deletes_only_what_stands_before(spark, docs):
    """Every deleted run of ten words stands in a smaller document, or before in the same one."""
    text = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    first: dict = {}
    for d in sorted(text):
        for i in range(len(text[d]) - 4):
            first.setdefault(tuple(text[d][i : i + 5]), (d, i))
    removed = 0
    for r in queries.op3_line_winnowing(spark, SF).collect():
        if r["n_removed"]:
            left, own = r["text"].split(), text[r["doc_id"]]
            assert len(own) - len(left) == r["n_removed"]
            removed += 1
            at = next((j for j, (a, b) in enumerate(zip(left, own)) if a != b), len(left))
            for i in range(at, at + min(25, r["n_removed"]) - 4):
                assert first[tuple(own[i : i + 5])] < (r["doc_id"], i)
    assert removed > 0


def test_line_dedup_of_null_ids_and_no_rows(spark):
    rng = random.Random(14)
    a, b = words(rng, 90), words(rng, 80)
    rows = [(1, a), *[(None, f"x{i} {a}") for i in range(3)], *[(None, b)] * 40, (None, None), (7, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("taken"))
    got = linededup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    assert sorted(r["text"] for r in got if r["text"] and r["text"].startswith("x")) == ["x0", "x1", "x2"]
    assert sum(r["text"] == "" for r in got) == 40 and {r["text"] for r in got if r["doc_id"] == 7} == {b}
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def all_repeats(texts, least):
    """Words of each text in a run of `least` words or more that stands before, by all grams."""
    seen: set = set()
    out = []
    for w in texts:
        on, own = [False] * len(w), set()
        for i in range(len(w) - least + 1):
            g = tuple(w[i : i + least])
            if g in seen or g in own:
                on[i : i + least] = [True] * least
            own.add(g)
        seen |= own
        out.append(on)
    return out


def test_every_repeat_of_51_words_in_sf_goes(spark, docs):
    """All documents of sf0.001: what stands in a run of 51 equal words of an earlier document is deleted;
    what is deleted is in a run of 30."""
    rows = sorted((r["doc_id"], (r["text"] or "").split()) for r in docs.collect())
    long, short = all_repeats([w for _, w in rows], 51), all_repeats([w for _, w in rows], 30)
    got = {r["doc_id"]: r for r in queries.op3_line_winnowing(spark, SF).collect()}
    for (d, w), must, may in zip(rows, long, short, strict=True):
        left = (got[d]["text"] or "").split()
        assert len(w) - len(left) == got[d]["n_removed"]
        assert sum(must) <= got[d]["n_removed"] <= sum(may)


def test_every_run_of_over_fifty_words_is_deleted_to_the_word(spark):
    """Passages of 51 words, the shortest that count, amid other words and without line ends."""
    rng = random.Random(8)
    plain = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randrange(4000)}" for _ in range(n))
    passages = [plain(51 + i % 10) for i in range(100)]
    rows = [(i, f"{plain(rng.randint(0, 60))} {passages[i % 100]} {plain(rng.randint(0, 60))}") for i in range(200)]
    # one passage twice in a document
    rows.append((200, f"{(p := plain(51))} {plain(20)} {p} {plain(9)}"))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        n = 0 if i < 100 else 51 if i == 200 else len(passages[i - 100].split())
        assert got[i]["n_removed"] == n and len(got[i]["text"].split()) == len(text.split()) - n
        if 100 <= i < 200:
            assert got[i]["text"].split() == text.replace(passages[i - 100], "").split()


# --- language, toxicity ------------------------------------------------------


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language_spans(spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert len(got) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_spans_of_a_mixed_text_and_odd_rows(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d, ~held_out())
    one = {r["lang"]: " ".join(r["text"].split()[:40]) for r in d.where("n_chars > 400").dropDuplicates(["lang"]).collect()}
    mixed = f"{one['en']} {one['de']} {one['fr']}"
    spans = langid.Labeller(model)([mixed], True)[2][0]
    assert [s["lang"] for s in spans] == ["en", "de", "fr"]
    assert abs(spans[0]["end"] - len(one["en"])) < 40
    got = langid.identify(odd, model, ["doc_id", "score"]).collect()
    assert len(got) == len(ODD)
    assert [r["lang_pred"] for r in got[:4]] == ["und"] * 4 and got[0]["spans"] == []
    label = langid.Labeller(model)
    langs, scores, _ = label(["½ ² Ⅷ 42 !", "漢字 漢字", "漢字 " + one["de"], "x² " + one["fr"]], True)
    assert langs[0] == "und" and scores[0] == 0
    assert langs[1] in model.languages and scores[1] == 0
    assert langs[2] == "de" and scores[2] > 0.9 and langs[3] == "fr"
    # positions of one language's span equal those of all words
    for t in [one["en"], f"1. {one['en']}!?", "½ " + one["fr"]]:
        got = label([t], True)[2][0]
        at = [m for m in re.finditer(r"[^\W\d_]+", t) if any(map(str.isalpha, m[0]))]
        assert got[0]["start"] == at[0].start() and got[-1]["end"] == at[-1].end()
    empty = langid.fit(d.limit(0), ~held_out())
    assert langid.Labeller(empty)(["abc", None])[0] == ["und", "und"]


def plain_viterbi(s, penalty):
    """Step by step over the whole sequence."""
    came, v = [], s[0] - s[0].max()
    for x in s[1:]:
        m = v.max() - np.float32(penalty)
        came.append(np.where(v >= m, np.arange(len(v)), v.argmax()))
        v = np.maximum(v, m) + x
        v = v - v.max()
    path = [int(v.argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("scale", [0.0, 0.05, 1.0, 8.0])
def test_viterbi_in_pieces_equals_the_whole(monkeypatch, scale):
    monkeypatch.setattr(langid, "PIECE", 12)
    monkeypatch.setattr(langid, "WARM", 5)
    rng = np.random.default_rng(8)
    steps = [(scale * rng.normal(size=(n, 3))).round(2).astype(np.float32) for n in (0, 1, 11, 12, 13, 0, 25, 400, 36)]
    steps.append(np.zeros((60, 3), np.float32))
    steps[-1][0, 2] = 1  # nothing after it wipes this out
    got = langid.viterbi(steps, 4.0)
    assert [x.tolist() for x in got] == [plain_viterbi(s, 4.0) if len(s) else [] for s in steps]


def test_viterbi_of_a_long_text_is_not_step_by_step():
    rng = np.random.default_rng(9)
    s = np.minimum(rng.normal(-3, 1, (60_000, 4)), 0).astype(np.float32)
    s[:30_000, 1] = s[30_000:, 2] = 0
    times = []
    for f in (lambda: langid.viterbi([s], 14.0)[0].tolist(), lambda: plain_viterbi(s, 14.0)):
        began = time.process_time()
        times.append((f(), time.process_time() - began))
    assert times[0][0] == times[1][0] == [1] * 30_000 + [2] * 30_000
    assert times[0][1] < times[1][1] / 4


def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        s = rng.normal(0, 2, (n, 3)).astype(np.float32)
        got = langid.viterbi([s, s[:1]], 1.5)[0]
        cost = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        assert cost(got.tolist()) == pytest.approx(max(cost(p) for p in itertools.product(range(3), repeat=n)), abs=1e-4)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_factorization_machine(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r["toxic"] == 1], [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.9
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.01


def test_factors_decide_on_held_out_rows(spark):
    """Without its factors the machine misses more toxic texts and ranks worse; its score is that of a
    double loop over all pairs of terms."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels, ~held_out())
    rows = docs.join(labels, "doc_id").where(held_out()).where("toxic is not null").select("text", "toxic").collect()
    x = toxicity.Features(m.vocabulary)([r["text"] for r in rows])
    y = np.array([r["toxic"] == 1 for r in rows])
    s = np.array(m.score(x))
    plain = toxicity.FactorizationMachine(m.bias, m.vocabulary, m.weights, m.paired, np.zeros_like(m.factors))
    s0 = np.array(plain.score(x))

    def auc(s):
        return np.mean([(s[y][:, None] > s[~y][None, :]) + 0.5 * (s[y][:, None] == s[~y][None, :])])

    assert ((s >= 0.3) != (s0 >= 0.3)).sum() > 20
    assert ((s >= 0.3) & y).sum() > ((s0 >= 0.3) & y).sum() + 20
    assert auc(s) > auc(s0) + 0.01 and ((s >= 0.3) & y).sum() > 104 / 120 * y.sum()
    for i in range(0, len(x), 200):
        z = m.bias + sum(m.weights[a] for a in x[i])
        for j, a in enumerate(x[i]):
            for b in x[i][j + 1 :]:
                z += sum(p * q for p, q in zip(m.factors[a], m.factors[b], strict=True))
        assert 1 / (1 + np.exp(-min(30, max(-30, z)))) == pytest.approx(s[i], abs=1e-6)


def test_machine_learns_a_pair_that_weights_miss():
    rng = random.Random(1)
    docs, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append(" ".join(["insult"] * a + ["group"] * b + rng.choices(["red", "blue", "green", "tall"], k=3)))
        y.append(a and b)
    make = toxicity.Features()
    m = toxicity.train(make(docs), np.array(y), epochs=40)
    both, one, none = m.score(toxicity.Features(m.vocabulary)(["insult group red", "insult red", None]))
    assert both > 0.7 > 0.4 > one
    assert 0 <= none <= 1


def test_machine_learns_a_pair_of_terms_that_are_neutral_alone():
    """The pair's terms rank last among some 1,500 by what each tells by itself."""
    rng = random.Random(2)
    noise = [f"{a}{b}{c}" for a in "bcdfghklmnpr" for b in "aeiouyzvwxq" for c in "bcdfghklmnpr"][:1500]
    docs, y = [], []
    for i in range(4000):
        a, b = i % 2, i // 2 % 2
        docs.append(" ".join(["one"] * a + ["two"] * b + rng.sample(noise, 4)))
        y.append(a != b)
    m = toxicity.train(toxicity.Features()(docs), np.array(y), epochs=60)
    both, one, two = m.score(toxicity.Features(m.vocabulary)(["one two", "one", "two"]))
    assert len(m.vocabulary) > 1200
    assert both < 0.4 < 0.6 < min(one, two)


def test_toxicity_without_labels(spark, odd):
    m = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"), ~held_out())
    got = toxicity.score(odd, m, ["doc_id", "score"]).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)


def test_held_out_is_crc32(spark):
    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


# --- html --------------------------------------------------------------------


def article(page):
    import html as h

    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(h.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())


def test_main_text_of_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op5_template_slots(spark, SF).collect():
        want = article(pages[r["page_id"]])
        assert r["text"] == want and r["n_chars"] == len(want)


def test_the_template_decides_without_names(spark):
    """Pages of sf0.01 whose elements say nothing: the template alone finds the article. A page's text by
    an empty template is all that it shows."""
    neutral = [("<nav>", "<div class=q1>"), ("</nav>", "</div>"), ('class="ad"', "class=q2"), ("<article>", "<div class=q3>"), ("</article>", "</div>"), ("<footer>", "<div class=q4>"), ("</footer>", "</div>")]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    held = {r["page_id"]: (r["url"], r["html"]) for r in pages.collect()}
    rows = []
    for i, (url, page) in held.items():
        for old, new in neutral:
            page = page.replace(old, new)
        rows.append((i, url, page))
    df = spark.createDataFrame(rows, pages.select("page_id", "url", "html").schema)
    size = Counter(htmltext.host(u) for u, _ in held.values())
    right = total = 0
    for r in htmltext.extract(df, ["page_id", "url"]).collect():
        if size[htmltext.host(r["url"])] >= 3:
            total += 1
            right += r["text"] == article(held[r["page_id"]][1])
    assert total > 200 and right == total
    assert all(htmltext.main_text(p, htmltext.Template()) != article(p) for _, p in held.values())


def test_classes_equal_those_of_explicit_vectors(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    by: dict = {}
    for r in rows:
        by.setdefault(htmltext._key(htmltext.host(r["url"])), []).append(r["html"])
    found = {r["host"]: r for r in htmltext.templates(spark.createDataFrame(rows)).collect()}
    several = 0
    for h, pages in by.items():
        if len(pages) < 3:
            assert h not in found or found[h]["n"] < 3 or not htmltext.candidates(htmltext._rows(found[h]["rows"]), found[h]["n"]).at
            continue
        counts = [Counter(t.key for t in htmltext.tokens(p) if t.key and t.kind) for p in pages]
        vectors: dict = {}
        for k in set().union(*counts):
            v = tuple(c[k] for c in counts)
            if 2 * sum(x > 0 for x in v) >= len(pages) and sum(x > 0 for x in v) > 2:
                vectors.setdefault(v, set()).add(k)
        want = {frozenset(v) for v in vectors.values() if len(v) > 1}
        classes = htmltext.candidates(htmltext._rows(found[h]["rows"]), found[h]["n"])
        got: dict = {}
        for k, (name, _) in classes.at.items():
            got.setdefault(name, set()).add(k)
        assert {frozenset(v) for v in got.values()} == want
        several += len(want) > 1
    assert several > 10


def test_classes_are_validated_and_nested():
    """A tag out of turn leaves its class; what lies in different gaps is not nested."""
    page = "<body><div class=a><h1>{0}</h1></div><div class=b>{1}</div><div class=c>{2}</div></body>"
    swap = "<body><div class=a><h1>{0}</h1></div><div class=c>{2}</div><div class=b>{1}</div></body>"
    item = "<p>{} and more words of it</p>"
    pages = [(swap if i == 3 else page).format(f"t{i}", item.format(f"x{i}") * (i % 3 + 1), f"y{i}") for i in range(6)]
    agg: dict = {}
    import pyarrow as pa

    for r in next(htmltext._counted(iter([pa.RecordBatch.from_pydict({"url": ["h"] * 6, "html": pages})]))).to_pylist():
        agg[r["token"]] = r
    rows = [htmltext.Row(k, r["pages"], r["a"], r["b"], r["times"], r["place"] / r["pages"], r["chars"], r["linked"], r["owner"], r["state"]) for k, r in agg.items() if k and r["pages"] > 2]
    classes, checks = htmltext.candidates(rows, 6), {}
    for p in pages:
        for t, wrong, around in htmltext.check(htmltext.tokens(p), classes):
            got = checks.setdefault(t, [0, around, around])
            checks[t] = [got[0] + wrong, min(got[1], around), max(got[2], around)]
    template = htmltext.deduce(rows, 6, checks)
    names = {t.key: i for p in pages[:1] for i, t in enumerate(htmltext.tokens(p)) if t.kind}
    assert 0 < len(template.at) < len(classes.at)
    first = {n: min(names[t] for t, (m, _) in template.at.items() if m == n) for n in template.parent}
    outer = min(first, key=first.get)
    assert template.parent[outer] == 0 and all(template.parent[n] != 0 for n in first if n != outer)
    assert htmltext.main_text(pages[0], template) is not None


def test_slots_of_an_unnamed_page_set(spark):
    """No article, main or telling class: constant boxes, link lists, a form, comments and a heading."""
    page = (
        "<html><body><div class='x1'>Acme shop, best of the best</div><div class='x5'><a href=/{0}>next {0}</a> <a href=/p{0}>prior {0}</a></div>"
        "<div class='x2'><h1>Title {0} of note</h1><div class='x4'><p>{1}</p><p>{2} &amp; so on</p><p>Read more below</p>"
        "<section class='comments'><p>I disagree {0}</p></section><form><p>Your mail {0}</p></form></div></div>"
        "<div class='x6'>Visited {0} times today</div><div class='x3'>All rights are ours</div></body></html>"
    )
    rows = [(i, f"http://a.example/{i}", page.format(i, f"Story {i} begins with many words here", f"and ends {i * 7}")) for i in range(8)]
    rows += [(20, None, None), (21, "", ""), (22, "http://b.example", "<p>a &amp; b<br>c</p><!-- x"), (22, "http://b.example", "<p>a &amp; b<br>c</p><!-- x")]
    # copies of one page alone: what all have is the text
    rows += [(30 + i, "http://c.example/x", "<body><div><a href=/>home</a></div><div><p>The same words on all of these pages</p></div></body>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in htmltext.extract(df, ["page_id", "url"]).collect()]
    assert len(got) == len(rows)
    for i in range(8):
        assert (i, f"Title {i} of note Story {i} begins with many words here and ends {i * 7} & so on") in got
    assert (20, "") in got and (21, "") in got and got.count((22, "a & b c")) == 2
    assert all((30 + i, "The same words on all of these pages") in got for i in range(4))
    assert htmltext.extract(df.limit(0), ["page_id"]).count() == 0
    wide = htmltext.extract(df.withColumn("text", F.lit("no")).withColumn("n_chars", F.lit(1)).withColumn("host", F.lit(2)).withColumn("rows", F.lit(3)), ["page_id", "host", "rows", "text"])
    assert wide.columns == ["page_id", "host", "rows", "text", "n_chars"] and wide.where("host = 2 and rows = 3 and text <> 'no'").count() > 10


def test_deep_and_broken_markup():
    assert htmltext.lone_text("<div>" * 3000 + "deep" + "<script>x") == "deep"
    assert htmltext.lone_text("<p>a<p>b</div><li>c<!-- d") == "a b c"
    assert htmltext.text_of("<p>1 < 2</p>", None) == "1 < 2"


def test_templates_by_join_give_the_same(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(map(tuple, htmltext.extract(df, ["page_id"]).collect()))
    monkeypatch.setattr(htmltext, "BROADCAST_BYTES", -1)
    wide = df.withColumn("host", F.lit("h")).withColumn("rows", F.lit("r")).withColumn("n", F.lit("n"))
    got = htmltext.extract(wide, ["page_id", "host", "rows", "n"]).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == want and {(r["host"], r["rows"], r["n"]) for r in got} == {("h", "r", "n")}


# --- decontamination -----------------------------------------------------------


def test_items_are_found_despite_edits(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    rng = random.Random(4)
    other = " ".join(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()).split()
    index = decontaminate.Index(items)
    found = total = 0
    for name, text in items:
        for share in (0.0, 0.1, 0.18):
            w = text.split()
            for _ in range(int(share * len(w))):
                k = rng.randrange(3)
                p = rng.randrange(len(w))
                if k == 0:
                    w[p] = rng.choice(other)
                elif k == 1:
                    del w[p]
                else:
                    w.insert(p, rng.choice(other))
            got = index.find([" ".join(rng.choices(other, k=rng.randint(0, 50)) + w + rng.choices(other, k=30))])[0]
            total += 1
            found += any(x[0] == name for x in got)
    assert found / total > 0.97


def test_decontamination_query_equals_brute_force(spark, docs):
    sf = "/root/testdata/sf0.01"
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(d, i) for d, t in text.items() for i, x in items.items() if x in t}
    got = queries.op9_cgk_decontamination(spark, sf).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in got}
    for r in got:
        h = [decontaminate.word_hash(w) for w in items[r["item_id"]].split()]
        run = [decontaminate.word_hash(w) for w in text[r["doc_id"]].split()[r["first_word"] : r["end_word"]]]
        assert decontaminate.edit_match(np.array(h, np.uint64), np.array(run, np.uint64))[0] == r["distance"] <= len(h) // 5


def test_decontamination_equals_edit_distance_of_all_pairs(spark):
    """All documents of sf0.001 with all items, by the edit distance of each pair; some documents get
    edited items on top."""
    rng = random.Random(9)
    sf = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [(r["item_id"], r["text"]) for r in items.collect()] + [(900, "an answer"), (901, "forty-two")]
    for i, (_, t) in enumerate(held):
        w = t.split()
        for _ in range(len(w) // 8):
            w[rng.randrange(len(w))] = "edited"
        texts[10_000 + i] = " ".join(["some", "words", "before", *w, "and", "after"])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(df, spark.createDataFrame(held, "item_id long, text string"), ["doc_id"]).collect()}
    hashes = lambda t: np.array([decontaminate.word_hash(w) for w in t.split()], np.uint64)
    want, docs = {}, {d: hashes(t) for d, t in texts.items()}
    for i, t in held:
        h = hashes(t)
        for d, words in docs.items():
            distance = decontaminate.edit_match(h, words)[0]
            if distance <= int(0.2 * len(h)):
                want[d, i] = distance
    assert len(want) > len(held) and set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.97 * len(got)
    assert {k for k in want if k[1] >= 900} <= set(got)


def test_decontamination_odd_rows_and_blocks(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too few words"), (None, "a b c d e f"), (5, "word word word word word word"), (5, "word word word word word word"), (6, "u v w x y z q"), (None, "x")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEMS", 1)
    got = decontaminate.contaminated(odd, bench, ["doc_id", "score"]).collect()
    assert sorted((r["score"], r["item_id"]) for r in got if r["item_id"] is not None) == [(4, 5)]
    assert {r["score"] for r in got if r["item_id"] is None} == {5, 6}
    # documents with an item of one word stay, unless asked for
    assert decontaminate.clean(odd, bench).count() == len(ODD) - 1
    assert decontaminate.clean(odd, bench, least=1).count() == len(ODD) - 3
    assert decontaminate.contaminated(odd, bench.limit(0), ["doc_id"]).count() == 0
    assert decontaminate.contaminated(odd.limit(0), bench, ["doc_id"]).count() == 0
    named = bench.withColumn("item_id", F.concat(F.lit("q"), "item_id"))
    assert {r["item_id"] for r in decontaminate.contaminated(odd, named, ["doc_id"]).collect()} == {"q5", None}


# --- sketches ------------------------------------------------------------------


def test_sketch_query(spark, docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.op10_bottom_k_sketch(spark, SF).collect()}
    make = sketch.Sketcher()

    def shingled(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == sketch.pack(make(text)) and r["edited_fingerprint"] == sketch.pack(make(edited))
        a, b = shingled(text), shingled(edited)
        assert abs(r["near_edited"] - len(a & b) / max(1, len(a | b))) < 0.2
    assert len(got) == len(rows)


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(2)
    w = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    make = sketch.Sketcher()
    a, b, both = make(" ".join(w[:4000])), make(" ".join(w[2000:])), make(" ".join(w))
    assert np.isin(sketch.merge(a, b), both).mean() > 0.95
    assert abs(sketch.resemblance(a, b) - 1 / 3) < 0.15
    assert abs(sketch.containment(a, b) - 0.5) < 0.2
    assert abs(sketch.distinct(both) / 5996 - 1) < 0.3
    df = spark.createDataFrame([("x", " ".join(w[:4000])), ("x", " ".join(w[2000:])), ("y", "one two"), (None, None)], "g string, text string")
    out = {r["g"]: r["sketch"] for r in sketch.merged(sketch.bottom_k(df, ["g"]), "g").collect()}
    assert out["x"] == sketch.pack(sketch.merge(a, b)) and out[None] == ""


def test_ranges_of_any_number(spark):
    rng = random.Random(8)
    bounds = sorted({rng.randrange(10_000) for _ in range(700)}, reverse=True)
    got = spark.range(0, 10_000, 7).select("id", sketch._range(F.col("id"), bounds).alias("n")).collect()
    assert all(r["n"] == sum(b > r["id"] for b in bounds) for r in got)
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    dealt = sketch.with_next(df, 90).select("bucket", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r["p"] for r in dealt}) == len(dealt)


def plain_sketch(text):
    """Bottom-k from all shingle hashes, by words one at a time."""
    w = (text or "").lower().split()
    h = [xxhash.xxh64_intdigest(x.encode()) for x in w]
    out, n, full = set(), min(5, len(w)), (1 << 64) - 1
    for i in range(len(w) - n + 1 if w else 0):
        v = 0
        for x in h[i : i + n]:
            v = (v * 0x9E3779B97F4A7C15 + x) & full
            v ^= v >> 29
        v = (v + n) & full
        v = ((v ^ v >> 30) * 0xBF58476D1CE4E5B9) & full
        v = ((v ^ v >> 27) * 0x94D049BB133111EB) & full
        out.add(v ^ v >> 31)
    return sorted(out)[:128]


def test_sketches_equal_brute_force(docs):
    make = sketch.Sketcher()
    for r in docs.collect():
        assert make(r["text"]).tolist() == plain_sketch(r["text"])


def test_sketch_odd_rows(odd):
    got = sketch.edited_likeness(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["near_next"] <= 1 for r in got)
    assert sketch.edited_likeness(odd.limit(0)).count() == 0
    assert sketch.edited_likeness(odd.where("doc_id = 4")).first()["near_next"] == 1


def test_memo_forgets():
    m = Memo(len, 2)
    assert [m[x] for x in ("a", "bb", "ccc")] == [1, 2, 3]
    m.trim()
    assert not m


def test_spans_follow_the_labelled_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    by = {r["lang"]: r["text"] for r in docs.where("lang is not null and length(text) > 400").orderBy("doc_id").collect()}
    en, de = by["en"][:300], by["de"][:300]
    for odd in ("", "\u0130\u0130\u0130\u0130 " * 6, "\u0149a \u00df\u00df e\u0301e\u0301 " * 5):
        text = odd + en + " " + de
        found = langid.Labeller(model)([text], True)[2][0]
        assert all(x["start"] < x["end"] for x in found) and all(x["end"] <= y["start"] for x, y in zip(found, found[1:], strict=False))
        last = found[-1]
        assert last["lang"] == "de" and abs(last["start"] - len(odd) - 300) < 60 and last["end"] > len(text) - 20


def test_parts_of_articles_with_doubtful_names_stay(spark):
    """Headlines and sections whose class words name page parts elsewhere, on hosts with a template and on a lone page; what
    stands around the article goes."""
    names = ["legal", "post-header", "alert", "search", "side", "widget"]
    page = lambda i, around: (
        f'<html><body><div class="header"><a href="/">Home</a> Site name</div><div class="{around}"><p>Elsewhere {i} {i * 7}</p></div><article><div class="entry-header"><h1>Headline {i}</h1></div>'
        f"<p>First paragraph number {i} of the story, with words of its own such as {'x' * (i + 3)}.</p>"
        + "".join(f'<div class="{n}"><p>On {n} there is {i} and {i * i} to say.</p></div>' for n in names)
        + f'</article><div class="comments"><p>Reader {i} says no.</p></div><footer>Imprint</footer></body></html>'
    )
    rows = [(i, f"http://a.example/{i}", page(i, "sidebar")) for i in range(6)] + [(9, "http://lone.example/", page(9, "widget"))]
    found = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    for i, text in found.items():
        assert text.startswith(f"Headline {i} First paragraph number {i}")
        assert all(f"On {n} there is {i} and {i * i} to say." in text for n in names)
        assert not any(x in text for x in ("Elsewhere", "Reader", "Imprint", "Site name"))


def _plain_tokens(page):
    """The scanner's rules, character by character."""
    out, i, n = [], 0, len(page)
    while i < n:
        if page[i] == "<" and i + 1 < n and (page[i + 1].isalpha() or (page[i + 1] == "/" and i + 2 < n and page[i + 2].isalpha())):
            j = i + 1 + (page[i + 1] == "/")
            k = j
            while k < n and page[k] not in " /<>":
                k += 1
            end, quote = k, ""
            while end < n and (quote or page[end] != ">"):
                quote = ("" if page[end] == quote else quote) if quote else page[end] if page[end] in "\"'" else ""
                end += 1
            if end < n:
                out.append((page[i + 1 : j] + page[j:k].lower(), page[k:end], ""))
                i = end + 1
                continue
        if page[i] == "<":
            out.append(("", "", "<"))
            i += 1
            continue
        j = page.find("<", i)
        j = n if j < 0 else j
        out.append(("", "", page[i:j]))
        i = j
    return out


def test_tags_of_broken_pages_equal_a_plain_reading():
    rng = random.Random(4)
    for _ in range(3_000):
        page = "".join(rng.choice(["<", "<a", "</b", ">", '"', "'", " ", "x", " c=", "/"]) for _ in range(rng.randint(0, 24)))
        assert list(htmltext.pieces(page)) == _plain_tokens(page), page


@pytest.mark.parametrize("part", ['<a "', "<a", "<a b=\"x' ", "</b>", "<div>", "<script ", "<!", "<!-- "])
def test_a_broken_page_of_a_megabyte_is_read_in_seconds(part):
    import time

    at = time.process_time()
    for end in ("", ' ">', ">"):
        htmltext.text_of(part * (1_000_000 // len(part)) + end, None)
    assert time.process_time() - at < 60
