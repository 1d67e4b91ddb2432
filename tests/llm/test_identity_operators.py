"""Merkle manifest, exact duplicates and tokenizer alignment against brute force, on small and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import align, merkle, naming
from leafmill.llm.common import fold

DDL = "doc_id long, text string, lang string, source string, n_chars long, name string, rid string, g string, part int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", "y", "z", 1) for i, t, lang, source in rows], DDL)


def texts(seed=5):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(["and", "of", "stone", "Wasser", "l'été", "x1", "…", "日本"]) for _ in range(n))
    base = prose(80)
    return [None, "", " \t\n\x0b\x0c\r", "a", " a", "a\n", "A", base, base.replace(" ", "\n"), base + " ", base, base + "!", "é" * 700, "é" * 700 + " ", prose(4000), "ab" * 33, "ab" * 32, "ab" * 31 + "a", "a b", "ab"]


# -- block naming


def brute_groups(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    members = {}
    for i, t in rows:
        members.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    keep = {k: min(v)[3] for k, v in members.items()}
    return Counter((i, keep[norm(t)], len(members[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), len(members)


@pytest.mark.parametrize("block", [1, 4, 64, 1024])
def test_block_naming(spark, block):
    some = texts() if block > 1 else [t for t in texts() if len(t or "") < 600]
    rows = list(enumerate(some)) + [(None, some[7]), (None, None), (3, "a"), (3, "a"), (100, some[-1])]
    found = naming.report(documents(spark, [(i, t, "en", "s") for i, t in rows]), block).collect()
    want, n_groups = brute_groups(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == n_groups
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_names_do_not_depend_on_ranges(spark):
    """One frequent block over all ranges, so that runs of it cross their borders."""
    rng = random.Random(2)
    rows = [(i, "same text " * 30 if rng.random() < 0.6 else f"{'x' * 300}{rng.randint(0, 40)}") for i in range(2000)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows]).repartition(16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = naming.report(docs, 128).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute_groups(rows)[0]


def test_block_naming_keeps_columns_and_empty_tables(spark):
    docs = documents(spark, [(1, "a b", "en", "s"), (2, "ab", "de", "s"), (3, None, None, None), (4, "", "en", None)])
    kept = naming.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.rid, r.part) for r in kept.collect()} == {(1, "y", 1), (3, "y", 1)}
    assert naming.report(docs.limit(0)).collect() == []


def test_block_naming_moves_no_text_to_report(spark, capsys):
    """Rows meet their groups by number: what the report reads of the written rows has neither text nor key."""
    found = naming.report(documents(spark, [(1, "a b", "en", "s"), (2, "ab", "de", "s"), (3, None, None, None)]))
    found.explain()
    plan = capsys.readouterr().out
    assert "text_sha256" in plan and not re.search(r"[\[,<](key|text)[#:]", plan)
    assert [tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept").orderBy("doc_id").collect()] == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)]


# -- Merkle manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = list(range(i - i % 3, min(i - i % 3 + 3, len(level))))
        out.append((i % 3, [level[j] for j in run if j != i]))
        i //= 3
    return out


def brute_merkle(rows):
    def leaf(i, t, lang, source):
        values = [i, source, lang, None if t is None else len(t), t]
        return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)

    tampered = lambda i, t: t if t is None or zlib.crc32(str("" if i is None else i).encode()) % 2 else t.replace("\n", "")
    given = lambda r: h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in [r[0], r[3], r[2], None if r[1] is None else len(r[1]), tampered(r[0], r[1])])
    order = lambda v: (v is not None, v or 0)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = {}, {}
    for s in sources:
        members[s] = sorted((r for r in rows if r[3] == s), key=lambda r: (order(r[0]), leaf(*r)))
        trees[s] = brute_tree([leaf(*r) for r in members[s]])
    top = brute_tree([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], Counter()
    for at, s in enumerate(sources):
        for i, r in enumerate(members[s]):
            path = brute_path(trees[s], i) + brute_path(top, at)
            now = given(r)
            for place, siblings in path:
                now = h([*siblings[:place], now, *siblings[place:]])
            out[(r[0], leaf(*r), trees[s][-1][0], root, h(x for _, sib in path for x in sib), now, now == root)] += 1
    return out


def proofs(docs):
    return Counter(tuple(r) for r in merkle.prove(docs, fold("doc_id", 2) == 0).collect())


def test_merkle(spark):
    some = [(i, t, "en" if i % 4 else None, [None, "", "b", "é", "-"][i % 5]) for i, t in enumerate(texts())]
    rows = some + [(None, "n\nn", "en", "b"), (None, "n\nn", "en", "b"), (7, "again", "en", "b"), (7, "Again", "en", "b"), (1000, "alone\nhere", "en", "only")]
    assert proofs(documents(spark, rows)) == brute_merkle(rows)


@pytest.mark.parametrize(("n", "sources"), [(1, 1), (2, 1), (3, 3), (4, 1), (81, 1), (82, 1), (243, 1), (244, 1), (700, 2), (300, 300)])
def test_merkle_sizes(spark, n, sources):
    """One, two and three tiers of blocks, below and above."""
    rows = [(i, f"text\n{i}", "en", f"s{i % sources}") for i in range(n)]
    assert proofs(documents(spark, rows)) == brute_merkle(rows)


def test_merkle_repeated_rows_and_empty_table(spark):
    rows = [(5, "a\nb", "en", "s")] * 200 + [(6, "c", None, "s")]
    assert proofs(documents(spark, rows)) == brute_merkle(rows)
    assert merkle.prove(documents(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("levels", range(1, 8))
def test_van_emde_boas_addresses(levels):
    """Every node has a place of its own, and each subtree below the upper half lies in one piece."""
    at = merkle.addresses(levels)
    assert sorted(np.concatenate(at).tolist()) == list(range(merkle.subtree_size(levels)))
    if levels > 1:
        upper = levels // 2
        size = merkle.subtree_size(levels - upper)
        for i in range(3**upper):
            piece = sorted(x for d in range(upper, levels) for x in at[d][i * 3 ** (d - upper) : (i + 1) * 3 ** (d - upper)])
            assert piece == list(range(piece[0], piece[0] + size))
            assert at[upper][i] == piece[0]


# -- token alignment


def brute_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    a_raw = lambda i: bytes(letter[c] for c in a.id_to_token(i))
    b_raw = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rowsfound = []
    for i, t in rows:
        got = None
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            if b"".join(map(a_raw, x)) == b"".join(map(b_raw, y)) == (" " + t).encode():
                ends = [list(np.cumsum([len(raw(k)) for k in v])) for raw, v in ((a_raw, x), (b_raw, y))]
                both = sorted(set(ends[0]) & set(ends[1]))
                cut = [[0, *(e.index(p) + 1 for p in both)] for e in ends]
                pieces = [([x[j] for j in range(*cut[0][k : k + 2])], [y[j] for j in range(*cut[1][k : k + 2])]) for k in range(len(both))]
                got = len(x), len(y), pieces
        rowsfound.append((i, got))
    n = Counter((p[-1], q[-1]) for _, got in rowsfound if got for p, q in got[2])
    best = {}
    for (_, q), c in n.items():
        best[q] = max(best.get(q, 0), c)
    out = Counter()
    for i, got in rowsfound:
        if not got:
            out[(i, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        links = [(p[-1], q[-1]) for p, q in got[2]]
        said = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in got[2])
        out[(i, got[0], got[1], len(links), len(links), sum(n[k] == best[k[1]] for k in links), sum(n[k] for k in links), hashlib.sha256(said.encode()).hexdigest())] += 1
    return out, n


ODD = ["a▁b", "▁", "<0x41> <s> <|endoftext|> x", "  two  blanks ", "\tx\n\ny  z  q", "it's we'll  're", "🙂🙂 née ᠎ x", "\x00 \x1f\x85 y", " lead", "trail ", "中文 字", "ﬁ ½ K"]


@pytest.mark.parametrize("frequent", [1 << 19, 3, 0.5])
def test_alignment(spark, frequent):
    rows = list(enumerate(texts() + ODD)) + [(None, "stone of"), (None, None), (4, " a"), (4, " a")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)
    want, n = brute_alignment(rows)
    if frequent < 1:  # no irregular pair goes to the tasks
        frequent = 1 / sum(n.values())
    got = align.report(docs, frequent=frequent)
    assert Counter(tuple(r) for r in got.collect()) == want
    if frequent == 3:
        assert {(r.a, r.b): r.n for r in align.counts(docs).collect()} == dict(n)


def test_alignment_of_random_texts(spark):
    rng = random.Random(9)
    letters = "ab C'.-1é  \n\t 中▁🙂<>"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    assert Counter(tuple(r) for r in align.report(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()) == brute_alignment(rows)[0]


def test_alignment_of_nothing(spark):
    docs = documents(spark, [(1, None, "en", "s"), (2, "", "en", "s")])
    assert [tuple(r) for r in align.report(docs).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert align.report(docs.where(F.lit(False))).collect() == []


def test_alignment_encodes_a_word_once(spark):
    """Marks behind a word and lines before it make no new word, and the rows stay those of the library."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abdeéinortß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(w + m for w in words) for m in ("", ".", ",", ";", "?!")] + [".\n".join(words)] + [f"{w}'s. {w}\n\n{w} \n{w}:1.{w}\n" for w in words[:40]]
    seen = align.Aligner(*align.default_paths())
    sent = []

    class Counted:
        def __init__(self, lib):
            self.lib = lib

        def encode(self, text, **kw):
            sent.append(text)
            return self.lib.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return self.lib.encode_batch_fast(texts, **kw)

    seen.a = Counted(seen.a)
    seen.rows(texts[:4])
    assert sum(map(len, sent)) < 1.5 * len(texts[0])
    rows = list(enumerate(texts))
    assert Counter(tuple(r) for r in align.report(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()) == brute_alignment(rows)[0]
