"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalquarry.llm import bagminhash, bitsliced, decontam, langid, line_dedup, pii, sharding, sp_bpe, suffix_dedup, warc
from evalquarry.llm.common import work_path

WORDS = [a + b for a in ("ba", "ko", "ti", "re", "lu", "sa", "no") for b in ("mi", "ta", "ro", "ne", "di", "su", "pe", "lo")]
RNG = random.Random(5)


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG = prose(6000)
ODD = [None, "", " ", "\n\n", "a", "é́日本\U0001f600\x00", LONG]


def docs(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# 1: benchmark decontamination


def test_templates():
    p, q = (decontam.parsed(t) for t in ("Alice Smith has 5 km and Bob has two cats. Carl too", "Alice Jones has 12,5 miles and Ed Ray has 9 cats! Carl too"))
    assert p.tokens.tolist() == q.tokens.tolist() and p.slot.tolist() == [False, True, False, True, True, False, True, False, True, False, False, False]
    assert p.words.tolist() == [1] * 12 and q.words.tolist() == [1] * 6 + [2] + [1] * 5 and p.value[1] != q.value[1] and p.value[2] == q.value[2]


def test_decontam_finds_copies_and_new_parameters(spark):
    item = "yesterday the farmer Alice sold 12 kg of apples to Bob and then Alice bought 7 ropes for the old red barn near town"
    changed = item.replace("Alice", "Carla").replace("12", "31").replace("Bob", "Dan").replace("7", "9")
    mixed = item.replace("farmer Alice", "farmer Carla").replace("then Alice", "then Dora").replace("Bob", "Ed").replace("12", "1").replace("7", "3")
    texts = [*ODD, f"{prose(50)} {item} {prose(50)}", f"{prose(10)} {changed}", prose(200), mixed]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {r.doc.doc_id: (r.item_id, r.kind) for r in decontam.leaks(docs(spark, texts, item_id=1, kind="x"), bench).collect()}
    n = len(ODD)
    assert got[n] == (7, "verbatim") and got[n + 1] == (7, "reparameterised") and set(got) <= {n, n + 1, n + 3}
    assert decontam.leaks(empty(spark), bench).count() == 0 and decontam.leaks(docs(spark, texts), bench.limit(0)).count() == 0
    twice = decontam.leaks(docs(spark, texts), bench.union(bench))
    assert sorted(r.doc.doc_id for r in twice.collect()) == sorted([*got] * 2)


def test_inconsistent_slots_are_no_leak():
    item = "so the baker Alice gave bread to Alice and later Alice took cake from Alice while it was raining a lot outside"
    names = iter(["Ann", "Bea", "Cid", "Dot"])
    other = re.sub("Alice", lambda m: next(names), item)
    assert decontam.Document(item).match(decontam.Item(item)) and not decontam.Document(other).match(decontam.Item(item))


# 2: suffix dedup


def figures(df):
    r = df.select("doc.doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h")).collect()
    return [tuple(x)[1:] for x in sorted(r, key=lambda x: x.doc_id)]


def passages_by_hand(texts, least=suffix_dedup.LEAST):
    data, seen = [(t or "").encode() for t in texts], Counter()
    for d in data:
        seen.update(d[p : p + least] for p in range(len(d) - least + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d), bool)
        for p in range(len(d) - least + 1):
            if seen[d[p : p + least]] > 1:
                hit[p : p + least] = True
        out.append([(s, e + 1) for s, e in suffix_dedup.runs(np.flatnonzero(hit)) if len(d[s : e + 1].split()) >= 50])
    return out


def passages(df):
    rows = sorted(df.select("doc.doc_id", "passages").collect(), key=lambda r: r.doc_id)
    return [[(x.start, x.end) for x in r.passages] for r in rows]


def test_suffix_dedup_against_brute_force(spark):
    passage, other, short = prose(120), prose(90), " ".join(w[:4] for w in prose(52).split())
    texts = [*ODD[:6], prose(300), f"{prose(40)} {passage} {prose(40)}", f"{prose(10)} {passage}", passage, prose(20) + passage[100:560] + prose(20), other + " " + other, "ab" * 500, "é" * 400, passage[:399], passage[:400], prose(300) + "x" * 900]
    texts += [texts[6], prose(30) + " " + passage[: len(passage) // 2 + 60], passage[len(passage) // 2 - 160 :] + " z", f"{prose(30)} {short} {prose(30)}", f"{short} {prose(9)}", passage[:256], passage[1:256]]
    for k in range(40):
        texts.append(passage[:430] + prose(k + 3))
    done = suffix_dedup.remove_repeats(docs(spark, texts, start=1, bytes="b")).cache()
    assert figures(done) == suffix_dedup.brute_force(texts) and passages(done) == passages_by_hand(texts)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_of_a_text_of_several_segments(spark):
    shared, long = prose(200), prose(9000)
    text = "".join([long, " ".join(RNG.choice(WORDS) + str(k) for k in range(30_000))])
    cut = suffix_dedup.SEGMENT - 500
    texts = [text[:cut] + shared + text[cut:], f"{prose(9)} {shared} {prose(9)}", long]
    assert len(texts[0]) > suffix_dedup.SEGMENT
    done = suffix_dedup.remove_repeats(docs(spark, texts)).cache()
    assert figures(done) == suffix_dedup.brute_force(texts) and passages(done) == passages_by_hand(texts)


def test_suffix_dedup_of_repeated_rows(spark):
    text, other = prose(150), prose(150)
    df = spark.createDataFrame([(1, text), (1, text), (None, other), (None, other), (2, prose(150)), (2, prose(90))], "doc_id long, text string")
    got = sorted((r.doc.doc_id or 0, r.n_removed, r.n_bytes) for r in suffix_dedup.remove_repeats(df).collect())
    assert [r[:2] for r in got] == [(0, len(other)), (0, len(other)), (1, len(text)), (1, len(text)), (2, 0), (2, 0)]


def test_suffix_dedup_splits_frequent_prints(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PRINT_CONTEXTS", 4)
    passage = prose(100)
    texts = [passage[:395] + RNG.choice("abc") + RNG.choice("de") + prose(60) for _ in range(30)]
    done = suffix_dedup.remove_repeats(docs(spark, texts)).cache()
    assert figures(done) == suffix_dedup.brute_force(texts) and passages(done) == passages_by_hand(texts)


def test_deep_shallow_order():
    data = (prose(60) + prose(10) * 3).encode()
    starts = np.arange(len(data) - 100)
    got = suffix_dedup.deep_shallow(data, starts, 100, 16)
    keys = [data[g[0] : g[0] + 100] for g in got]
    assert keys == sorted(set(data[s : s + 100] for s in starts)) and sum(map(len, got)) == len(starts)


# 3: WARC


def test_warc_round_trip(spark, monkeypatch):
    big, small = "<p>" + prose(300), "tiny"
    rows = [(1, "http://a/1", big), (2, "http://a b\n2", big), (3, None, big), (4, "u", small), (5, "u", small), (None, "u", big), (6, "u", None), (7, "u", "x" * 1000), (7, "u", "x" * 1000), (8, "ü", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("z"))
    folder = work_path(spark, "warc")
    index = warc.write_archives(pages, folder)
    got = warc.read_records(index, folder).collect()
    by = {(r.page_id, r.payload_digest): r for r in got}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert len(got) == len(rows) and {k for k in by} == {(i, sha(h)) for i, _, h in rows}
    assert (by[3, sha(big)].record_type, by[3, sha(big)].refers_to) == ("response", None)
    assert (by[1, sha(big)].record_type, by[1, sha(big)].refers_to, by[1, sha(big)].payload_bytes) == ("revisit", 3, len(big))
    assert by[None, sha(big)].record_type == "response" and by[4, sha(small)].record_type == "response"
    assert {r.record_type for r in got if r.page_id == 7} == {"response"}
    assert bytes(by[8, sha(LONG)].payload).decode() == LONG and by[6, sha(None)].payload_bytes == 0
    one = warc.read_records(index.where("page_id = 8"), folder).collect()
    assert len(one) == 1 and one[0].url == "ü"
    assert warc.read_records(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def test_ranges_are_joined():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 500, 10), ("b", 0, 10)]
    assert [len(r) for r in warc.coalesced(rows, gap=100)] == [2, 1, 1]
    assert [len(r) for r in warc.coalesced(rows[:2], most=15)] == [1, 1]


# 4: language identification


def languages(n):
    r = random.Random(1)
    kinds = {"xx": "the and ing tion".split(), "yy": "der und ung ß".split(), "zz": "que ção los é".split()}
    return [(i, " ".join("".join(r.choice(kinds[k]) for _ in range(2)) for _ in range(r.randint(5, 80))), k) for i, k in enumerate(r.choice(list(kinds)) for _ in range(n))]


def test_langid(spark):
    rows = languages(400) + [(1000, None, "xx"), (1001, "12 !?", "yy"), (1002, "", None), (None, "der und", None), (1003, LONG, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc.doc_id: r for r in langid.identify(df).collect()}
    held = {r.doc_id for r in df.where(langid.held_out(F.col("doc_id"))).collect()}
    test = [(i, k) for i, _, k in rows[:400] if i in held]
    assert 60 < len(test) < 140 and np.mean([got[i].lang_pred == k for i, k in test]) > 0.97
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty(spark)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_letters():
    assert not any(langid.lettered(t) for t in ("", "½ 12 ²", "12 _ !?", "\U0001f600")) and all(langid.lettered(t) for t in ("m²", "一", "½a", "é"))


def test_forward_pass_by_hand():
    net = langid.ByteNet.fresh(["a", "b", "c"])
    text = "Écrit d'une main légère " * 9
    w, size = langid.cut(text)
    raw = text.lower().encode()
    assert b"".join(x.tobytes() for x in w).rstrip(b"\0") == raw and size.tolist() == [min(langid.WINDOW, len(raw) - k) for k in range(0, len(raw), langid.WINDOW)]
    for x, p in zip(w, net.probabilities(w)):
        e = net.embed[np.append(x, [0] * 3)]
        f = []
        for k, width in enumerate(langid.WIDTHS):
            for j in range(k * langid.FILTERS, (k + 1) * langid.FILTERS):
                f.append(max(sum(float(e[i + d] @ net.filters[d * langid.EMBED : (d + 1) * langid.EMBED, j]) for d in range(width)) for i in range(len(x))))
        z = np.maximum(np.array(f) + net.bias, 0) @ net.out + net.out_bias
        assert np.allclose(np.exp(z) / np.exp(z).sum(), p, atol=1e-4)


def test_langid_gradients():
    net = langid.ByteNet.fresh(["a", "b"])
    net = langid.ByteNet(net.langs, *[w.astype(np.float64) for w in net.weights()])
    x, y = np.random.default_rng(0).integers(1, 256, (3, 20)).astype(np.uint8), np.array([0, 1, 1])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(3), y]).mean()
    for w, g in zip(net.weights(), net.step(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = w[at], 1e-5
        w[at] = old + e
        up = loss()
        w[at] = old - e
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 1e-4


# 5: line dedup


def line_reference(texts):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(" \t\n\v\f\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    held = {}
    for i, ls in enumerate(split):
        for k in {key(x) for x in ls}:
            held.setdefault(k, []).append(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i
    return [(len(ls), sum(gone(i, x) for x in ls), "\n".join(x for x in ls if not gone(i, x))) for i, ls in enumerate(split)]


@pytest.mark.parametrize("held", [64 << 20, -1])
def test_line_dedup_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(line_dedup, "HELD_BYTES", held)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    common, rare = "This line is on many pages", "é" * 20
    texts = [*ODD, f"{common}\nown text here\n {common.upper()}\t", common, f"a\n{common}\n", f"{common}", rare, f"{rare}\n{rare}", "\n".join([common, "short", prose(10), rare]), "\r\n" + common]
    got = line_dedup.dedup_lines(docs(spark, texts, n_lines=0, drop="d")).collect()
    assert [(r.n_lines, r.n_dropped, r.kept) for r in sorted(got, key=lambda r: r.doc.doc_id)] == line_reference(texts)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("held", [64 << 20, -1])
def test_line_dedup_repeated_and_null_ids(spark, monkeypatch, held):
    monkeypatch.setattr(line_dedup, "HELD_BYTES", held)
    line = "a line of more than twenty characters"
    df = spark.createDataFrame([(None, line), (2, line), (5, line), (5, line)], "doc_id long, text string")
    got = sorted((r.doc.doc_id or -1, r.n_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(-1, 1), (2, 1), (5, 0), (5, 0)]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64))
    h = line_dedup.PerfectHash.build(keys)
    assert sorted(h.index(keys)) == list(range(len(keys)))
    assert len(line_dedup.PerfectHash.build(np.empty(0, np.uint64)).index(keys[:5])) == 5


# 6: near duplicates


def bag(t):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def classes_by_hand(texts):
    p = list(range(len(texts)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            common = (bags[i] & bags[j]).total()
            near = common and common >= 0.8 * (bags[i] | bags[j]).total()
            if texts[i] is not None and (texts[i] == texts[j] or near):
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[RNG.randrange(len(w))] = RNG.choice(WORDS) + "x"
    return " ".join(w)


def test_near_duplicates_against_all_pairs(spark):
    base, loop = prose(200), prose(40)
    texts = [*ODD, LONG, "", None, base, edited(base, 2), edited(base, 3), edited(base, 8), base.upper() + "!", " ".join([loop] * 5), " ".join([loop] * 6), loop, "one two", "One, two"]
    texts += [edited(base, 4) for _ in range(30)] + [prose(150) for _ in range(10)]
    got = {r.doc.doc_id: r.class_id for r in bagminhash.classes(docs(spark, texts, node="n", root=0)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_hand(texts)
    assert bagminhash.classes(empty(spark)).count() == 0


def test_blocks_find_what_leaders_miss(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK_MEMBERS", 3)
    base = prose(120)
    texts = [edited(base, 5) for _ in range(60)]
    got = {r.doc.doc_id: r.class_id for r in bagminhash.classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_hand(texts)


def test_few_similar_pairs_fail_the_sketch():
    n, p = bagminhash.BANDS * bagminhash.ROWS, bagminhash.SIMILARITY
    need = n * (p - 6 * math.sqrt(p * (1 - p) / n))
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(math.ceil(need))) < 2e-8


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(3)
    s = r.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = r.integers(1, 9, 300), r.integers(1, 9, 300)
    sig = bagminhash.signatures(np.repeat([0, 1], 300), np.concatenate([s, s]), np.concatenate([a, b]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    assert np.isfinite(sig).all()


@pytest.mark.parametrize("similarity, least", [(0.95, 1.0), (0.85, 1.0), (0.8, 1.0), (0.7, 0.97), (0.6, 0.85)])
def test_bands_meet_by_similarity(similarity, least):
    r = np.random.default_rng(int(100 * similarity))
    pairs, n = 200, 300
    both = int(round(n * 2 * similarity / (1 + similarity)))
    doc, shingle = [], []
    for k in range(pairs):
        common = r.integers(1, 1 << 62, both)
        for side in range(2):
            doc.append(np.full(n, 2 * k + side))
            shingle.append(np.concatenate([common, r.integers(1, 1 << 62, n - both)]))
    doc, shingle = np.concatenate(doc), np.concatenate(shingle).astype(np.uint64)
    keys = bagminhash.band_keys(bagminhash.signatures(doc, shingle, np.ones(len(doc), np.int64), 2 * pairs))
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= least


# 7: SentencePiece


def test_sentencepiece_equals_the_library(spark):
    m = sp_bpe.model_at(sp_bpe.MODEL)
    texts = [*ODD, "▁▁ a▁", "x" * 500, "Ⅷ²³ m² ².", "<s> </s> <unk> <0x0A>", "Übergröße, l'été! don't 12.5km", "\t\r\n  a  \n", "日本語のテキスト"]
    got = {r.doc.doc_id: r for r in sp_bpe.encode_documents(docs(spark, texts, ids=1, decoded="d")).collect()}
    for i, t in enumerate(texts):
        ids = m.library.encode(t or "")
        assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(ids), ",".join(map(str, ids)), m.library.decode(ids))
        assert m.decode(ids) == m.library.decode(ids)
    assert sp_bpe.encode_documents(empty(spark)).count() == 0


def test_both_agendas_agree():
    m = sp_bpe.model_at(sp_bpe.MODEL)
    for c in [prose(3).replace(" ", ""), "aaaa" * 8, "▁" * 40, "hello"]:
        assert m.agenda_short(c) == m.agenda_long(c)


# 8: top-k


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(0)
    v = [(i, r.normal(0, 0.3, 12).tolist()) for i in range(300)]
    v += [(300, v[7][1]), (320, v[7][1]), (340, None), (360, [float("nan")] * 12), (380, [None] * 12), (400, [0.1] * 3), (None, [0.1] * 12), (420, [5.0] * 12), (40, v[3][1]), (440, [float("inf")] * 12)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("score", F.lit("s"))
    got = Counter((x.query_id, x["rank"], x.vec_id, x.score) for x in bitsliced.top_k(df).collect())
    ok = [(i, np.pad(np.floor(64 * np.array(x, float)).astype(int), (0, 12 - len(x)))) for i, x in v if i is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    want = Counter()
    for k, (q, x) in enumerate(ok):
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for j, (i, y) in enumerate(ok) if j != k)[:20]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert got == want
    assert bitsliced.top_k(df.limit(0)).count() == 0
    few = bitsliced.top_k(df.where("vec_id IN (0, 1, 2)"))
    assert few.count() == 2


def test_blocks_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 50)
    monkeypatch.setattr(bitsliced, "CHUNK_QUERIES", 2)
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-3, 4, 4).astype(float).tolist()) for i in range(180)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in bitsliced.top_k(df).collect()}
    for q in range(0, 180, 20):
        best = sorted((-int(64 * 64 * np.dot(rows[q][1], y)), i) for i, y in rows if i != q)[:20]
        assert [got[q, n + 1] for n in range(20)] == [(i, -s) for s, i in best]


# 9: sharding


@pytest.mark.parametrize("n, shards", [(0, 24), (5, 24), (1000, 24), (1000, 7)])
def test_shards(spark, monkeypatch, n, shards):
    monkeypatch.setattr(sharding, "BLOCK_BUCKETS", 3)
    df = docs(spark, ([*ODD, "same", "same"] * n)[:n], bucket=1, pos="p")
    out = sharding.assign_shards(sharding.shuffle_buckets(df, work_path(spark, "s"), size=F.lit(100_000)), shards)
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(r.rec.doc_id for r in rows) == list(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(0 <= s < shards for s in by)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    if n == 1000:
        order = [r.rec.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert abs(np.corrcoef(order, range(n))[0, 1]) < 0.15


def test_shuffle_is_seeded_and_native(spark, capsys):
    df = spark.range(500).withColumn("text", F.lit("t"))
    order = lambda seed: [r.rec.id for r in sharding.assign_shards(sharding.shuffle_buckets(df, work_path(spark, "s"), size=F.lit(1000), seed=seed, bucket_rows=100)).orderBy("shard", "slot").collect()]
    a = order(1)
    assert a == order(1) and a != order(2) and sorted(a) == list(range(500))


def spark_hash(*parts):
    """XXH64 of ints and longs one after the other, each seeded by the one before."""
    import xxhash

    h = 42
    for size, v in parts:
        h = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def test_buckets_replayed_and_orders_uniform(spark):
    df = spark.range(900, numPartitions=3).withColumn("text", F.lit("t"))
    rid = {x.id: x.r for x in df.withColumn("r", F.monotonically_increasing_id()).collect()}
    places = Counter()
    for seed in range(1, 9):
        rows = sharding.shuffle_buckets(df, work_path(spark, "s"), size=F.lit(1), seed=seed, bucket_rows=30).collect()
        by = {}
        for x in rows:
            assert x.bucket == spark_hash((4, seed), (8, rid[x.rec.id])) % 30
            by.setdefault(x.bucket, []).append((x.pos, rid[x.rec.id]))
        for members in by.values():
            assert sorted(p for p, _ in members) == list(range(len(members)))
            order = {r_: k for k, r_ in enumerate(sorted(r_ for _, r_ in members))}
            # In which third of its bucket a record of each third ends up.
            places.update((3 * order[r_] // len(members), 3 * p // len(members)) for p, r_ in members)
    total = sum(places.values())
    assert len(places) == 9 and all(abs(c / total - 1 / 9) < 0.02 for c in places.values())


# 10: personal data


@pytest.fixture(scope="module")
def tagger():
    return pii.train(pii.labelled_spans(400), epochs=2)


def base_by_hand(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    cards = [(m, re.sub(r"\D", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)]
    out += [(2, *m.span()) for m, d in cards if 13 <= len(d) <= 19 and pii.luhn(d)]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_base_spans_against_plain_patterns():
    r = random.Random(2)
    for _ in range(5000):
        t = "".join(r.choice("ab.@1 2-9+()%0") for _ in range(50))
        assert pii.base_spans(t) == base_by_hand(t), t
    long = "1" * 50_000 + "." * 3 + "a" * 50_000 + "@" + "b." * 20_000
    assert len(pii.base_spans(long)) == 1


def test_pii_query_values(spark, tagger):
    texts = [*ODD, "mail x.y@mail.example.com now", "ip 10.0.0.1 and 300.1.1.1", "card 4111 1111 1111 1111 ok", "call +1 (212) 555-0100", "\U0001f600 a@b.co"]
    got = {r.doc.doc_id: r for r in pii.detect(docs(spark, texts, base="b", spans=3), tagger=tagger).collect()}
    for i, t in enumerate(texts):
        want = base_by_hand(t or "")
        assert got[i].base == pii.joined(want)
        spans = got[i].spans.split(",") if got[i].spans else []
        assert set(pii.joined(want).split(",")) - {""} <= set(spans)
    assert pii.detect(empty(spark), tagger=tagger).count() == 0 and "secrets" in pii.detect(empty(spark), tagger=tagger).columns
    assert got[6].spans == ""


def test_tagger_gradients():
    net = pii.Tagger(hidden=3)
    r = np.random.default_rng(0)
    for w in net.weights():
        w[...] = r.normal(0, 0.5, w.shape)
    x, y = r.integers(1, pii.CLASSES, (6, 4)).astype(np.uint8), np.array([[0, 1, 2, 0]] * 3 + [[0, 1, 0, 4]] * 3)

    def loss():
        em, tr = net.emissions(x).transpose(0, 2, 1).astype(np.float64), net.masked_trans().astype(np.float64)
        a, gold = em[0], em[0][np.arange(4), y[0]].copy()
        for t in range(1, 6):
            a = em[t] + pii.lse(a[:, :, None] + tr, 1)
            gold += em[t][np.arange(4), y[t]] + tr[y[t - 1], y[t]]
        return float((pii.lse(a, 1) - gold).mean()) / 6

    for w, g in zip(net.weights(), net.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = w[at], 1e-2
        w[at] = old + e
        up = loss()
        w[at] = old - e
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 0.03 * abs(g[at]) + 1e-3


def test_decoding_against_all_sequences():
    r = np.random.default_rng(5)
    net = pii.Tagger(hidden=3)
    for w in net.weights():
        w[...] = r.normal(0, 0.8, w.shape)
    x = r.integers(1, pii.CLASSES, (5, 6)).astype(np.uint8)
    tags, em = net.decode(x)
    tr = net.masked_trans()
    every = np.array(list(itertools.product(range(pii.TAGS), repeat=5)))
    for j in range(x.shape[1]):
        score = sum(em[t, every[:, t], j] for t in range(5)) + sum(tr[every[:, t], every[:, t + 1]] for t in range(4))
        assert np.isclose(score[(every == tags[:, j]).all(axis=1)][0], score.max())


def test_tagger_learns(spark):
    net = pii.default_tagger(spark)
    test = pii.labelled_spans(300, 77)
    hit = found = gold = 0
    added = [0, 0, 0]
    for (t, spans), tagged in zip(test, pii.tag_texts(net, [t for t, _ in test])):
        hit, found, gold = hit + len(set(spans) & set(tagged)), found + len(tagged), gold + len(spans)
        base, every, secrets = pii.find_spans(t, tagged)
        more = set(every + secrets) - set(base)
        want = {x for x in spans if not any(x[1] < e and b < x[2] for _, b, e in base)}
        added = [a + b for a, b in zip(added, (len(more & want), len(more), len(want)))]
    assert hit / found > 0.85 and hit / gold > 0.85
    # What is added to the patterns' spans: of what is added, and of what the patterns miss.
    assert added[0] / added[1] > 0.95 and added[0] / added[2] > 0.75 and added[2] > 100
    pii._TRAINED.clear()
    again = pii.default_tagger(spark)
    assert all(np.array_equal(a, b) for a, b in zip(net.weights(), again.weights()))


def test_spans_across_windows(spark, monkeypatch):
    net = pii.default_tagger(spark)
    said, core = "write ann at mail dot com or (212) 555-0100 please", pii.WINDOW - 2 * pii.MARGIN
    assert [k for k, *_ in pii.find_spans(said, pii.tag_texts(net, [said])[0])[1]] == [0, 3]
    texts = [prose(400)[:at].ljust(at, ".") + " " + said + " " + prose(60) for at in range(core - 70, core + 40, 3)]
    spans = lambda: [pii.find_spans(t, x)[1] for t, x in zip(texts, pii.tag_texts(net, texts))]
    several = spans()
    monkeypatch.setattr(pii, "WINDOW", 4096)
    one = spans()
    assert sum(a == b for a, b in zip(several, one)) >= 0.9 * len(texts) and sum(map(len, several)) > len(texts)
    assert pii.tag_texts(net, ["", prose(3)])[0] == []


def test_windows_hold_little_but_text(monkeypatch):
    net, r, read = pii.Tagger(seed=3), random.Random(6), []
    net.e *= 40  # tags of all kinds
    texts = ["", *(prose(3000)[: r.randrange(1, 9000)] for _ in range(60)), *(prose(3000)[:n] for n in (1, 15, 16, 17, pii.WINDOW, pii.WINDOW + 1, 2 * pii.WINDOW))]
    decode = pii.Tagger.decode

    def counted(self, x, *more):
        read.append(int(more[0].sum()) if more else x.size)
        return decode(self, x, *more)

    monkeypatch.setattr(pii.Tagger, "decode", counted)
    together = pii.tag_texts(net, texts)
    assert sum(map(len, texts)) <= sum(read) < 1.15 * sum(map(len, texts))
    # A text's spans don't depend on the texts that it is read with.
    assert together == [pii.tag_texts(net, [t])[0] for t in texts] and sum(map(len, together)) > 100
    monkeypatch.setattr(pii, "GROUP", 7)
    assert pii.tag_texts(net, texts) == together


def test_states_of_windows_that_end_early():
    net, r = pii.Tagger(hidden=3, seed=4), np.random.default_rng(4)
    size = np.array([9, 9, 6, 5, 5, 1])
    x = r.integers(1, pii.CLASSES, (9, 6)).astype(np.uint8)
    live = (size > np.arange(9)[:, None]).sum(1)
    tags, em = net.decode(x, live)
    for j, n in enumerate(size):
        mine = x[:n, j : j + 1]
        states = np.concatenate([net.direction(mine, k)[0] for k in range(2)], 2)
        assert np.allclose(em[:n, :, j], (states @ net.e + net.eb)[:, 0], atol=1e-5)
        assert np.array_equal(tags[:n, j], net.decode(mine)[0][:, 0]) and not tags[n:, j].any()


def test_reconciled_against_all_choices():
    r = random.Random(4)
    for _ in range(300):
        spans = [(r.randrange(3), a := r.randrange(20), a + r.randrange(1, 8), float(r.randrange(1, 9))) for _ in range(r.randrange(7))]
        one = []
        for k, a, b, v in sorted(spans):
            if one and one[-1][0] == k and a < one[-1][2]:
                one[-1] = (k, one[-1][1], max(b, one[-1][2]), max(v, one[-1][3]))
            else:
                one.append((k, a, b, v))
        apart = lambda c: all(x[2] <= y[1] or y[2] <= x[1] for i, x in enumerate(c) for y in c[:i])
        best = max(sum(x[3] for x in c) for n in range(len(one) + 1) for c in itertools.combinations(one, n) if apart(c))
        got = pii.reconciled(spans)
        assert sum(next(x[3] for x in one if x[:3] == g) for g in got) == best and apart(got)
