"""The ten operators against brute force, on small and odd inputs."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, langid, lines, media, mixing, near, repeats, runs, shards, tokens, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long, row string, key string"


def documents(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], f"src{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


def odd(seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = prose(120)
    texts = [None, "", " \t\n", "a", "A b c", base, base, base.upper(), base + " " + prose(10), prose(30) + " " + base[:450], "z" * 1000, "z" * 399, "日本語 " * 200, prose(6000), base, prose(5), "a b c d e", "a b c d e f"]
    texts += [" ".join(w if rng.random() > 0.01 else "edit" for w in base.split()) for _ in range(12)]
    return texts


def test_decontaminate_brute_force(spark):
    rng = random.Random(1)
    item = " ".join(f"w{rng.randint(0, 30)}" for _ in range(25))
    texts = odd() + ["x " + item.upper().replace(" ", ", ") + " y", " ".join(item.split()[3:13]), " ".join(item.split()[3:12]), "Short one here", "short-one"]
    bench = spark.createDataFrame([(1, item), (10, item), (2, "short one"), (3, None), (4, "--"), (5, base_item := "q r s")], "item_id long, text string")
    docs = documents(spark, texts)
    for block, most in ((1 << 20, 4), (1, 1000), (1, 0)):  # one block, many, and the join
        got = {r.doc_id: r for r in decontaminate.report(decontaminate.scan(docs, bench, block_bytes=block, max_blocks=most, bits=1 << 16)).collect()}
        for i, t in enumerate(texts):
            words = decontaminate.words_of(t)
            hit, items = set(), set()
            for key, text in (("1", item), ("10", item), ("2", "short one"), ("5", base_item)):
                w = decontaminate.words_of(text)
                n = min(10, len(w))
                wins = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
                for j in range(len(words) - n + 1):
                    if tuple(words[j : j + n]) in wins:
                        hit.update(range(j, j + n))
                        items.add(key)
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(items), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    for most in (4, 0):
        kept = decontaminate.decontaminate(docs, bench, max_blocks=most, bits=1 << 16)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].contaminated}
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert spans[len(texts) - 2].split() == ["here"]
    assert spans[0] is None
    none = decontaminate.report(decontaminate.scan(docs, bench.limit(0)))
    assert none.where("contaminated").count() == 0
    assert decontaminate.report(decontaminate.scan(docs.limit(0), bench)).count() == 0


def test_spans_do_not_depend_on_blocks(spark):
    w = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(w[:12])), (2, " ".join(w[5:18])), (3, " ".join([*w[20:25], *w[25:30]]))]
    texts = ["a " + " ".join(w[:18]) + " b", " ".join([*w[20:25], *w[:12], *w[25:30]]), None, "", "clean"]
    for order in (items, items[::-1]):
        bench = spark.createDataFrame(order, "item_id long, text string").coalesce(1)
        for block, most in ((1 << 20, 4), (1, 1000), (1, 0)):
            got = decontaminate.decontaminate(documents(spark, texts), bench, remove="spans", block_bytes=block, max_blocks=most, bits=1 << 16)
            words = {r.doc_id: r.text and r.text.split() for r in got.collect()}
            assert words == {0: ["a", "b"], 1: w[20:30], 2: None, 3: "", 4: ["clean"]}


def test_shards(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("é"), F.col("id") % 50)).alias("text"))
    rows = shards.assign(docs.unionByName(docs.where("doc_id = 5"))).collect()
    assert len(rows) == 4001
    by = Counter(r.shard for r in rows)
    assert set(by) == set(range(16)) and max(by.values()) < 1.5 * min(by.values())
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    assert {r.grown_shard for r in rows if r.grown_shard != r.shard} == {16}
    assert 0.03 < sum(r.grown_shard == 16 for r in rows) / len(rows) < 0.1
    for r in rows[:50]:
        text = "" if r.doc_id % 7 == 0 else f"é{r.doc_id % 50}"
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    # a change of weight moves documents into or out of the changed subtrees only
    light, heavy = (shards.planned_tree(16, weights={6: w}) for w in (1.0, 3.0))
    key = F.col("doc_id").cast("string")
    moved = docs.select(shards.shard_of(key, light).alias("a"), shards.shard_of(key, heavy).alias("b")).where("a <> b").collect()
    assert moved and all(r.b // 4 == 1 for r in moved)
    assert shards.assign(docs.limit(0)).count() == 0
    placed = shards.place(docs.withColumn("slot", F.lit("old")))
    assert placed.columns == ["doc_id", "text", "shard", "slot"] and placed.count() == 4000


def test_shards_by_brute_force(spark):
    import math

    import xxhash

    def descend(key, node, path=""):
        if node.shard >= 0:
            return node.shard
        draws = []
        for kid in node.children:
            h = 42
            for part in (path, kid.name, key):
                h = xxhash.xxh64_intdigest(part.encode(), h)
            draws.append(-math.log(((h >> 12) + 0.5) / 2**52) / kid.weight)
        best = node.children[draws.index(min(draws))]
        return descend(key, best, f"{path}/{best.name}")

    trees = shards.planned_tree(16), shards.planned_tree(17)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("n").alias("n"), F.lit(1).alias("block"))
    docs = docs.unionByName(spark.createDataFrame([(None, None, "n", 1)] * 50 + [(None, "", "n", 1), (7, "text", "n", 1)], "doc_id long, text string, n string, block int"))
    rows = shards.assign(docs).collect()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (descend(key, trees[0]), descend(key, trees[1]))
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len(rows) == 352 and sum(r.doc_id is None and r.size == 1 for r in rows) == 51
    placed = shards.place(docs).collect()
    assert sorted((r.shard, r.slot) for r in placed) == sorted((r.shard, r.slot) for r in rows)


def test_place_keeps_columns(spark):
    names = ["key", "block", "start", "text_crc32", "size", "doc"]
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), *(F.concat(F.lit(c), F.col("id")).alias(c) for c in names), F.lit("old").alias("Shard"))
    placed = shards.place(docs)
    assert placed.columns == ["doc_id", "text", *names, "shard", "slot"]
    assert all(r[c] == f"{c}{r.doc_id}" for r in placed.collect() for c in names)
    plain = {(r.doc_id, r.shard, r.slot) for r in shards.assign(docs).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in placed.collect()} == plain


def test_lines(spark):
    pages = [(i, f"https://me@A.example.com:80/p{i}", f"<p>Menu</p><div>own {i} <b>line</b></div><script>x<p>y</script>Foot\nfoot &amp; <!-- c --> z<p>Menu") for i in range(10)]
    pages += [(10, None, None), (11, "no url", ""), (12, "http://b.com", "<p>Menu</p>"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    rows = lines.analyse(df, ratio=0.5).collect()
    assert len(rows) == 14
    a = [r for r in rows if r.host == "a.example.com"]
    assert len(a) == 11 and all(r.n_lines == 5 and r.n_dropped == 4 and r.text == f"own {r.page_id} line" for r in a)
    rest = {r.page_id: r for r in rows if r.host != "a.example.com"}
    assert rest[10].n_lines == 0 and rest[11].host == "" and rest[12].text == "Menu"
    assert lines.analyse(df.limit(0)).count() == 0
    parts = lines.analyse(df, ratio=0.5, list_bytes=0).collect()  # joined by host and part of it
    assert sorted(map(str, parts)) == sorted(map(str, rows))


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("lmnoprst") for _ in range(5)) for _ in range(200)]
    texts, labels = [], []
    for i in range(600):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 60))]
        y = i % 5 == 0
        if y:
            words[3] = rng.choice(["vrakus", "vrakon", "vrakeli"])
        texts.append(" ".join(words))
        labels.append((i, int(y), int(y != (rng.random() < 0.03)), 1))
    texts += [None, "", "vrak" * 3]
    docs = documents(spark, texts)
    given = spark.createDataFrame(labels + [(0, 1, 1, 1), (None, 1, 1, 1), (7000, 1, None, 1)], "doc_id long, quality int, toxic int, text int")
    held = toxicity.fold("doc_id", 5) == 0
    model = toxicity.learn(docs, given, ~held)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts)
    test = [(got[i], y) for i, y, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in test) / len(test) > 0.95
    assert got[600] == got[601] < 0.5
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {600, 601} <= {r.doc_id for r in kept.collect()}
    none = toxicity.learn(docs, given.limit(0), ~held)
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_media_round_trip(spark):
    texts = odd() + ["x" * 576, "y" * 2000, "é" * 100_000]
    df = media.digest(media.payload_images(documents(spark, texts)))
    for r in df.collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.image_of(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    rng = np.random.RandomState(0)
    for shape in ((5, 7), (5, 7, 3), (24, 24), (1, 1)):
        x = rng.randint(0, 256, shape).astype(np.uint8)
        for kind in ("bmp24", "ppm") if len(shape) == 3 else ("bmp8", "pgm"):
            assert (media.decode(media.encode(x, kind)) == x).all()
    assert (media.decode(b"P5 # c\n2 1 # d\n255\n\x01\x02") == [[1, 2]]).all()
    assert np.allclose(media.area_resize(np.arange(12.0).reshape(3, 4), 3, 2), [[0.5, 2.5], [4.5, 6.5], [8.5, 10.5]])
    whole = np.repeat(np.repeat(rng.rand(3, 5), 7, 0), 4, 1)
    assert np.allclose(media.area_resize(whole, 3, 5), whole[::7, ::4])
    images = spark.createDataFrame([(1, media.encode(rng.randint(0, 256, (40, 30)).astype(np.uint8), "pgm")), (2, b"nothing"), (3, None)], "id long, media binary")
    cut = media.tiles(images, rows=16, side=8).collect()
    assert [r.tile for r in cut if r.id == 1] == [0, 1, 2]
    assert all(np.load(io.BytesIO(bytes(r.npy))).shape == (8, 8) for r in cut if r.id == 1)
    assert [r.npy for r in cut if r.id != 1] == [None, None]
    assert media.digest(media.payload_images(documents(spark, ["a"]).limit(0))).count() == 0


def test_media_features_by_brute_force():
    rng = np.random.RandomState(1)
    for shape in ((24, 24), (37, 19), (3, 5), (1, 1)):
        grey = rng.randint(0, 256, shape).astype(np.uint8)
        h, w = shape

        def mean(top, bottom, left, right, grey=grey):
            """Mean over an area, each sample by its share of it."""
            total = area = 0.0
            for y in range(int(top), min(int(np.ceil(bottom)), grey.shape[0])):
                for x in range(int(left), min(int(np.ceil(right)), grey.shape[1])):
                    part = max(0.0, min(y + 1, bottom) - max(y, top)) * max(0.0, min(x + 1, right) - max(x, left))
                    total, area = total + part * float(grey[y, x]), area + part
            return total / area

        areas = [[round(mean(i * h / 8, (i + 1) * h / 8, j * w / 9, (j + 1) * w / 9) * 256) for j in range(9)] for i in range(8)]
        bits = "".join(str(int(areas[i][j] < areas[i][j + 1])) for i in range(8) for j in range(8))
        far = int(bits, 2) ^ media.difference_hash(grey)
        assert far.bit_count() <= (2 if h * w < 100 else 0)  # halves may round either way in tiny images
        tile = np.load(io.BytesIO(media.strips(media.encode(grey, "pgm"), side=4)[0][0]))
        assert np.allclose(tile, [[mean(i * h / 4, (i + 1) * h / 4, j * w / 4, (j + 1) * w / 4) for j in range(4)] for i in range(4)], atol=0.51)


def test_toxicity_scores_by_brute_force(spark):
    import math

    terms = [b"vrak*", b"foo"]
    voters = toxicity.Voters(terms)
    weights = np.linspace(-1, 1, voters.size + 1)
    texts = [None, "", "VRAKUS vrak vraken, foo!! idiot", "You all are scum. STOP THAT NOW!!", "f*** i-d-i-o-t x", "foo " * 50_000, "clean"]
    got = {r.doc_id: r.score for r in toxicity.score(documents(spark, texts), toxicity.Model(voters, weights)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        low = "".join(c.lower() if c.isascii() else c for c in t)
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", low)
        x = [sum(w.startswith("vrak") and len(w) > 4 for w in words), words.count("foo")]
        x += [len(set(lexicon.split()) & set(words)) for lexicon in toxicity.LEXICONS.values()]
        x += [int(bool(re.search(p, t))) for p in toxicity.PATTERNS.values()]
        n = (x[0] > 0) + (x[1] > 0)
        x += [int(n == 0), int(n > 1)]
        z = sum(w * math.log1p(v) for w, v in zip(weights, x, strict=False)) + weights[-1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_language_by_brute_force(spark, monkeypatch):
    import math

    rng = random.Random(6)
    langs = [f"l{i}" for i in range(6)]
    words = {x: ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(6)] for x in langs}
    texts = [" ".join(rng.choice(words[langs[i % 6]]) for _ in range(12)) for i in range(240)] + [None, "", "  ", "abc"]
    docs = documents(spark, texts, [langs[i % 6] for i in range(244)])
    model = langid.learn(langid.learnable(docs, F.lit(False)))
    centroids = [(r.lang, np.frombuffer(r.centre, "<f4"), r.least) for r in model.table.orderBy("lang", "centre").collect()]
    whole = sorted(map(tuple, langid.predict(docs, model, reject=False).collect()))
    monkeypatch.setattr(langid, "BLOCK", 4)  # several blocks
    assert sorted(r[:2] for r in map(tuple, langid.predict(docs, model, reject=False).collect())) == [r[:2] for r in whole]
    assert langid.sampled(docs, 10**9).count() == 244
    n = 243
    df = Counter()
    for t in texts:
        if t is not None:
            df.update(np.flatnonzero(langid.grams(t)).tolist())
    for i, t in enumerate(texts[:60]):
        v = {b: float(x) * (math.log((1 + n) / (1 + df[b])) + 0.1) for b, x in enumerate(langid.grams(t)) if x}
        norm = math.sqrt(sum(x * x for x in v.values()))
        near = [(sum(x * float(c[b]) for b, x in v.items()) / norm, lang) for lang, c, _ in centroids]
        best = max(near)
        assert whole[i][2] == pytest.approx(best[0], abs=1e-4) and (whole[i][1] == best[1] or sorted(near)[-2][0] > best[0] - 1e-4)


CLASH = ["row", "key", "hit", "items", "score", "topic", "p", "w", "near", "least", "media", "n_bytes", "marks", "shard", "slot", "node", "bands", "start", "end", "name", "body", "n", "block", "size", "counts", "doc", "y", "tokens", "__row", "rejected"]


def test_language_of_repeated_rows(spark):
    """Languages whose rows are all alike are learnt from, and none brings more than the sample."""
    rows = [(None if i % 2 else i, f"word{i} text{i}", f"l{i:02}") for i in range(20) for _ in range(500)]
    rows += [(1000 + j, f"plain {j}", "usual") for j in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r.lang for r in langid.sampled(docs, 600).collect())
    assert got == {f"l{i:02}": 1 for i in range(20)} | {"usual": 600}


def test_shards_of_many_alike_rows(spark):
    rows = spark.range(1_000_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = rows.unionByName(documents(spark, odd()).select("doc_id", "text"))
    got = shards.assign(rows).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()
    assert sum(r.n for r in got) == 1_000_000 + len(odd())
    assert all(r.n == r.d == r.high + 1 and r.low == 0 for r in got)


def test_odd_tables(spark):
    """Null ids, repeated rows, null and empty texts and clashing columns in all operators on documents."""
    text = "The quick brown fox jumps over the lazy dog and runs away from here again. " * 8
    rows = [(None, text, "en", "s"), (None, text, "en", "s"), (1, text, "en", "s"), (1, text, "en", "s"), (2, None, None, None), (None, None, None, None), (3, "", "", ""), (3, "other words", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *(F.lit("clash").alias(c) for c in CLASH))
    bench = spark.createDataFrame([(1, " ".join(text.split()[:12]), "x"), (None, "quick brown", "x")], "item_id long, text string, words string")
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 1, "x"), (None, 1, 1, "x"), (3, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    tables = {
        "op1": lambda d: decontaminate.report(decontaminate.scan(d, bench)), "op1 joined": lambda d: decontaminate.report(decontaminate.scan(d, bench, max_blocks=0, bits=1 << 12)),
        "op2": shards.assign, "op2 placed": shards.place, "op4": lambda d: toxicity.score(d, toxicity.learn(d, labels, F.lit(True))),
        "op5": lambda d: media.digest(media.payload_images(d)), "op6": repeats.report, "op6 cut": repeats.deduplicate, "op7": tokens.count_tokens,
        "op8": lambda d: langid.predict(d, langid.learn(langid.learnable(d, F.lit(False)))), "op9": mixing.mixed, "op10": near.classes,
    }
    of_rows = {"slot", "kept", "row", "sampled", "shard", "grown_shard", "text_crc32", "component_id", "held_out"}
    for name, run in tables.items():
        got = [r.asDict() for r in run(docs).collect()]
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows), name
        alike = Counter(str({k: v for k, v in r.items() if k not in of_rows | set(CLASH) | {"doc_id"}}) for r in got)
        if name not in ("op2", "op2 placed", "op9"):
            assert max(alike.values()) >= 4, name  # the four rows of one text have equal values
        assert run(docs.limit(0)).count() == 0, name
    assert near.one_of_each(docs).columns == docs.columns == toxicity.keep_clean(docs, toxicity.learn(docs, labels, F.lit(True))).columns == mixing.mix(docs).columns == decontaminate.decontaminate(docs, bench).columns
    assert {r.component_id for r in near.classes(docs).where("n_shingles > 0 and doc_id is null").collect()} == {1}


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(cover[1:] != cover[:-1])
        kept = bytes(b for b, c in zip(r, cover[1:], strict=False) if not c)
        out.append((len(r), int(cover.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out


def spans_of(marks):
    found = {}
    for r in marks.collect():
        found.setdefault(bytes(r.row), []).append({"start": r.start, "end": r.end})
    return {k: repeats.spans(v) for k, v in found.items()}


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats_brute_force(spark, hot):
    texts = odd()
    rng = random.Random(8)
    passage = "".join(rng.choice("abc ") for _ in range(700))
    texts += [f"{i} {passage[: 380 + 40 * i]} {i}" for i in range(6)] + [passage[100:510] + passage[90:520], "ab" * 500, "b" + "ab" * 230]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 13"))
    texts.append(texts[13])
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(docs, hot=hot).collect())
    if hot == 1000:  # hot by its bytes
        marks = lambda **limits: spans_of(repeats.marks(docs, **limits))
        assert marks(hot_bytes=1000) == marks()
    assert got == sorted(brute_repeats(texts, 400))
    assert repeats.report(docs.limit(0)).count() == 0
    cut = repeats.deduplicate(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 0").first().text is None


def test_repeats_in_periodic_texts(spark, monkeypatch):
    line = "one line over and over, 28 b\n"
    n = (1 << 24) + 700
    docs = documents(spark, [(line * (n // len(line) + 1))[:n], "head " * 3 + "é" * 100_000, "no repeat"])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.report(docs).collect()}
    assert got == {0: (n, n, 1), 1: (200_015, 200_000, 1), 2: (9, 0, 0)}
    kept = {r.doc_id: r.text for r in repeats.deduplicate(docs).collect()}
    assert kept == {0: "", 1: "head " * 3, 2: "no repeat"}
    # many pieces against brute force
    texts = [(line * 9999)[:n] for n in (400, 66_500, 70_001, 200_000)] + ["ab" * 45_000 + "x" + "ab" * 40_000, "z" * 70_000]
    for hot in (1000, 1):
        rows = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(documents(spark, texts), hot=hot).collect())
        assert rows == sorted(brute_repeats(texts, 400))
    monkeypatch.setattr(repeats, "SECTION", 500)
    for raw in [(line * 99)[:n] for n in (400, 430, 1500, 2800)] + ["ab" * 900 + "x" + "ab" * 700]:
        name, body, start, size, twice = repeats.sections(raw.encode())
        assert start[0] == 0 and (start[1:] == (start + size - 399)[:-1]).all() and start[-1] + size[-1] == len(raw) and size.max() <= 1300


def test_repeats_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1)  # a block a name
    base = "".join(random.Random(3).choice("abcd ") for _ in range(900))
    texts = [base, base[300:], base[:399], None, "", None, base]
    docs = spark.createDataFrame([(None if i < 2 else i, t, i, "s", "e", "m") for i, t in enumerate(texts)], "doc_id long, text string, row int, start string, end string, marks string")
    docs = docs.unionByName(docs.where("row = 2"))
    rows = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(docs).collect())
    assert rows == sorted(brute_repeats([*texts, texts[2]], 400))
    cut = repeats.deduplicate(docs)
    assert cut.columns == docs.columns and sorted(map(str, (r.text for r in cut.collect()))) == sorted(map(str, ["", "", base[:399], None, "", None, "", base[:399]]))


def test_repeats_of_texts_with_equal_polynomials(spark):
    """Texts that differ at every 256th byte, in the pattern of Thue and Morse, have no string of 400 bytes in common there."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    pool = letters(1 << 21)
    at = int(np.argmin(repeats.PrefixHash(pool.encode()).windows(64)))  # names all sections
    blocks = [pool[at : at + 64] + letters(191) for _ in range(64)]
    pair = ["".join(b + "ab"[(i.bit_count() + k) % 2] for i, b in enumerate(blocks)) for k in (0, 1)]
    head, tail = letters(500), letters(40_000)
    for texts in (pair, [head + t + tail for t in pair]):
        want = sorted(brute_repeats(texts, 400))
        assert all(r[1] == 0 for r in want) == (texts is pair)
        for hot in (1000, 1):
            got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(documents(spark, texts), hot=hot).collect())
            assert got == want


def test_run_length_index():
    rng = random.Random(2)
    for _ in range(30):
        base = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60)))
        texts = [base[rng.randint(0, 20) :][: rng.randint(1, 60)] or b"a" for _ in range(rng.randint(1, 6))]
        match = runs.RunLengthIndex(texts).matching_statistics()
        at = 0
        for i, t in enumerate(texts):
            for j in range(len(t)):
                best = 0
                for k, o in enumerate(texts):
                    for m in range(len(o)):
                        if (k, m) != (i, j):
                            n = 0
                            while j + n < len(t) and m + n < len(o) and t[j + n] == o[m + n]:
                                n += 1
                            best = max(best, n)
                assert match[at + j] == best
            at += len(t) + 1
        far = runs.RunLengthIndex(texts, 5).matching_statistics()
        assert (np.where(match >= 5, match, 0) == np.where(far >= 5, far, 0)).all()


def test_tokens_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(tokens.default_path())
    rng = random.Random(4)
    letters = "ab  \n\t'stdé日🙂0129.,!-　\xa0\x85\x1c²½"
    texts = odd() + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["a<|endoftext|> b<|endoftext", "don't  it's   ,", " " * 60]
    count = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    for r in tokens.count_tokens(documents(spark, texts)).collect():
        assert (r.n_bytes, r.n_tokens) == (len((texts[r.doc_id] or "").encode()), count(texts[r.doc_id]))
        assert r.over_limit == (r.n_tokens > 512)
    counter = tokens.counter(tokens.default_path())
    for t in texts[18:120] + texts[-3:]:
        stored = tokens.PrefixTable(counter, t)
        assert [stored.at(k) for k in range(len(t) + 1)] == [count(t[:k]) for k in range(len(t) + 1)]
        assert counter.prefixes(t).tolist() == [count(t[:k]) for k in range(len(t) + 1)]
    docs = documents(spark, [*texts[5:8], None, "", "x" * 3000]).withColumn("counts", F.lit("clash"))
    table = tokens.stored(docs.unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long"))))
    assert table.count() == 7 and tokens.stored(docs.limit(0)).count() == 0 == tokens.count_tokens(docs.limit(0)).count()
    for r in tokens.truncate(table.where("doc_id is not null"), [0, 10, 10**6]).collect():
        t = [*texts[5:8], "", "", "x" * 3000][r.doc_id]
        best = max(k for k in range(len(t) + 1) if k == 0 or count(t[:k]) <= 10) if len(t) < 1200 else None
        assert r.chars[0] == 0 and r.chars[2] == len(t) and (best is None or r.chars[1] == best)
    at = {r.doc_id: r.n_tokens for r in tokens.counts_at(table, F.lit(100)).collect()}
    assert at[0] == count(texts[5][:100]) and at[3] == 0
    twice = tokens.count_tokens(docs.unionByName(docs)).collect()
    assert len(twice) == 12 and len({(r.doc_id, r.n_tokens) for r in twice}) == 6


def test_tokens_ask_once_for_a_border():
    """Two tokens are judged once, however many words they meet in; counts stay those of the library."""
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(tokens.default_path())
    counter, asked, rng = tokens.PrefixCounter(tokens.default_path()), [], random.Random(8)
    apart = counter.apart
    counter.apart = lambda left, right: asked.append((left, right)) or apart(left, right)
    for _ in range(2000):
        t = "".join(rng.choice(["tion", "er", "the", "an", "é", "日", "x", "ble", " "]) for _ in range(rng.randint(1, 9)))
        assert counter.count(t) == len(lib.encode(t, add_special_tokens=False).ids)
    assert 0 < len(asked) == len(set(asked))


def test_language(spark):
    rng = random.Random(6)
    words = {"aa": ["loma", "kela", "suro"], "bb": ["thon", "wesk", "brid"], "cc": ["ççe", "ñoz", "iéu"]}
    texts, langs = [], []
    for i in range(300):
        lang = "aabbcc"[2 * (i % 3) :][:2]
        texts.append(" ".join(rng.choice(words[lang]) for _ in range(15)))
        langs.append(lang if i % 11 else None)
    texts += [None, "", "123 !?", "loma"]
    langs += ["aa"] * 4
    docs = documents(spark, texts, langs)
    model = langid.learn(langid.learnable(docs, langid.fold("doc_id", 3) == 1))
    got = {r.doc_id: r for r in langid.predict(docs, model, reject=False).collect()}
    assert all(got[i].lang_pred == "aabbcc"[2 * (i % 3) :][:2] for i in range(300))
    assert [got[300 + i].lang_pred for i in range(4)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    far = langid.predict(documents(spark, ["qqxx jjvv qqxx wwzz"]), model).first()
    assert far.rejected and far.lang_pred == "und"
    none = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_mixing_meets_its_targets(spark):
    texts = [("word " * (1 + i % 40)) + ("license" if i % 4 == 0 else "") for i in range(400)] + [None, ""]
    docs = documents(spark, texts, ["en" if i % 5 else "de" for i in range(402)]).withColumn("lang", F.when(F.col("doc_id") == 3, None).otherwise(F.col("lang")))
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 402
    for m in mixing.MARGINS:
        natural, got = Counter(), Counter()
        for r in rows:
            natural[r[m]] += r.n_tokens
            got[r[m]] += r.n_tokens * r.weight
        want = {k: v**mixing.ALPHA for k, v in natural.items()}
        for k in want:
            assert got[k] / sum(got.values()) == pytest.approx(want[k] / sum(want.values()), abs=2e-3)
    cells = mixing.described(docs).groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    small = {tuple(r)[:3]: r.w for r in mixing.weights(cells, rounds=3).collect()}
    large = {tuple(r)[:3]: r.w for r in mixing.weights(cells, rounds=3, most=0).collect()}
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k]) for k in small)
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.sampled for r in rows)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_keeps_its_share_beside_a_stray_source(spark):
    import corpus_pipeline

    rows = [(i, "word " * (20 + i % 60), "en" if i % 3 else "de", f"src{i % 7 % 3}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stray = spark.createDataFrame([(9001, "word " * 50, "xx", "stray"), (9002, None, "en", "silent")], docs.schema)
    for more in (docs, docs.unionByName(stray)):
        kept = corpus_pipeline.mixing_stage(spark, more, "").agg(F.count(F.lit(1)), F.sum(mixing.tokens_of(F.col("text")))).first()
        assert kept[0] / 6000 == pytest.approx(mixing.SHARE, abs=0.03)
        assert kept[1] / sum(20 + i % 60 for i in range(6000)) == pytest.approx(mixing.SHARE, abs=0.03)
    for share in (0.05, mixing.SHARE, 0.8, 1.0):
        rare = docs.where("doc_id < 30").withColumn("source", F.lit("rare"))
        cells = mixing.cells_of(mixing.described(docs.unionByName(rare)))
        small = {tuple(r)[:3]: (r.p, r.w) for r in mixing.weights(cells, share=share).collect()}
        tokens = {tuple(r)[:3]: r.tokens for r in cells.collect()}
        assert sum(small[k][0] * n for k, n in tokens.items()) == pytest.approx(share * sum(tokens.values()))
        assert all(0 < p <= 1 for p, _ in small.values())
        for m in range(3):  # targets are met as far as there are tokens
            natural, got = Counter(), Counter()
            for k, n in tokens.items():
                natural[k[m]] += n
                got[k[m]] += n * small[k][0]
            target = {v: n**mixing.ALPHA for v, n in natural.items() if n}
            scale = [got[v] / x for v, x in target.items() if got[v] < 0.999 * natural[v]]
            assert not scale or max(scale) <= 1.02 * min(scale)
    small, large = ({tuple(r)[:3]: (r.w, r.p) for r in mixing.weights(cells, rounds=2, most=most, share=0.5).collect()} for most in (mixing.CELLS, 0))
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k]) for k in small)
    assert mixing.mix(docs.limit(0), share=0.5).count() == 0


def test_mixing_of_odd_rows_and_given_targets(spark):
    rows = [(i, "word " * (20 + i % 60), "en" if i % 3 else "de", f"src{i % 7 % 3}", "x", 1.0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, p double")
    odd_one = spark.createDataFrame([(9001, "a b c d e", "xx", "stray", "y", 0.0), (None, None, None, None, None, None), (None, "", "en", "src0", None, None)], docs.schema)
    more = docs.unionByName(odd_one).unionByName(docs.where("doc_id = 5"))
    before = {r.doc_id: r.p for r in mixing.mixed(docs).collect()}
    after = mixing.mixed(more).collect()
    assert len(after) == 3004 and {r.topic for r in after} == {"short"}
    assert all(r.p == pytest.approx(before[r.doc_id], rel=0.01) for r in after if r.doc_id in before)
    assert len({r.sampled for r in after if r.doc_id == 5}) == 1 and [r.p for r in after if r.doc_id == 9001] == [1.0]
    assert mixing.mix(more).columns == docs.columns
    given = spark.createDataFrame([("src0", 2.0), ("src1", 1.0), ("absent", 5.0)], "value string, share double")
    for most in (mixing.CELLS, 0):
        cells = mixing.cells_of(mixing.described(docs))
        p = {r.source: r.p for r in mixing.weights(cells, rounds=6, most=most, targets={"source": given}).collect()}
        assert p["src2"] == 0 and set(p) == {"src0", "src1", "src2"}
    report = {(r.margin, r.value): r for r in mixing.achieved(docs, targets={"source": given}).collect()}
    assert report["source", "src0"].share == pytest.approx(2 / 3, abs=1e-3) and report["source", "src2"].share == 0
    assert all(abs(r.residual) < 2e-3 for r in report.values())
    named = mixing.mixed(docs, topic=F.col("topic")).select("topic").distinct().collect()
    assert [r.topic for r in named] == ["x"]
    with pytest.raises(ValueError):
        mixing.weights(cells, targets={"nothing": given})


def brute_near(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def test_near_brute_force(spark):
    texts = odd()
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(80)]
    for _ in range(60):  # a large group whose members differ from each other
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(80)] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    docs = documents(spark, texts)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.classes(docs).collect())
    assert got == brute_near(texts)
    again = docs.unionByName(docs.where("doc_id in (5, 40)"))
    kept = near.one_of_each(again)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k in got if k]
    assert near.classes(docs.limit(0)).count() == 0


def test_near_templates_below_the_threshold(spark):
    """Pages of one template that are not similar enough, of several sizes, with a few that are."""
    rng = random.Random(11)
    shared = [f"t{i}" for i in range(60)]
    texts = []
    for i in range(150):
        own = [f"p{i}x{j}" for j in range(rng.choice((9, 12, 14, 24)))]
        texts.append(" ".join([*shared[: rng.choice((50, 60))], *own]))
        if i % 10 == 0:
            texts.append(texts[-1] + " more")
    sets = [set(near.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert {r.doc_id: r.component_id for r in near.classes(documents(spark, texts)).collect()} == dict(enumerate(root))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_one_of_each_group_stays(spark, monkeypatch, most):
    monkeypatch.setattr(near, "BROADCAST_KEYS", most)
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (2, a), (3, a + " end"), (4, b), (4, b), (4, b + " end"), (5, None), (5, None), (6, ""), (7, "alone"), (None, b), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, None if i is None else f"s{i}") for i, t in rows], "doc_id long, text string, row string")
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    fours = {k: n for k, n in got.items() if k[0] == 4}
    assert sum(fours.values()) == 1 and set(fours) <= {(4, b), (4, b + " end")}
    assert got - Counter(fours) == Counter({(1, a): 1, (5, None): 2, (6, ""): 1, (7, "alone"): 1, (None, "no id"): 1})
    assert near.one_of_each(docs.limit(0)).count() == 0
