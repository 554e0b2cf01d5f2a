"""Phrases, Merkle manifest and best-fit packing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftlake.llm import best_fit, merkle, phrases, queries
from siftlake.llm.common import Scratch, placed

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# Places within groups.


@pytest.mark.parametrize("tasks", [1, 5])
def test_places_within_groups(spark, tasks):
    rng = random.Random(4)
    rows = [(rng.choice(["", "+", "+a", "+hot", "+hot", "+hot"]), rng.choice([None, *range(40)]), i) for i in range(700)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got, spans = placed(spark.createDataFrame(rows, "g string, k int, i int"), "g", [F.desc("k"), "i"], Scratch(spark))
        want = {}
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
            want |= {r[2]: (n, len(own)) for n, r in enumerate(own)}
        assert {r.i: (r.place, r.total) for r in got.collect()} == want
        assert placed(spark.createDataFrame([], "g string, k int"), "g", ["k"], Scratch(spark))[0].count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# Merkle manifest.


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """The root and each leaf's siblings."""
    nodes, held, proofs = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        up, over = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for j, own in enumerate(held[i : i + 2]):
                for leaf in own:
                    proofs[leaf].append((j == 1, run[1 - j] if len(run) == 2 else None))
            up.append(sha("".join(run)))
            over.append(sum(held[i : i + 2], []))
        nodes, held = up, over
    return nodes[0], proofs


def plain_manifest(rows):
    by = {}
    for doc_id, text, lang in rows:
        by.setdefault(lang, []).append((doc_id, sha(field(doc_id) + field(lang) + field(text))))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(by[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in groups}
    trees = {g: tree([leaf for _, leaf in own[g]]) for g in groups}
    root, upper = tree([trees[g][0] for g in groups])
    return sorted((str(k), leaf, trees[g][0], root, [*p, *q]) for g, q in zip(groups, upper) for (k, leaf), p in zip(own[g], trees[g][1]))


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [3, 1, 33, 300], [1] * 40])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rows = [(i * 7 % 1009, f"text {i}", f"l{g}") for g, n in enumerate(sizes) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id", "lang", "text"]).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(1, None, None), (None, "", ""), (None, "x", "de"), (2, "long " * 60000, "de"), (2, "dup", "en"), (2, "dup", "en"), (2, "other", "en"), (3, "ü日本", "ü"), (4, "\x00", "Z")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, proof string, digest int")
    got = merkle.manifest(docs, ["doc_id", "lang", "text"], carry={"proof_of": F.col("proof")}).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got) == plain_manifest(rows)
    assert {r.proof_of for r in got} == {"clash"}
    assert merkle.manifest(docs.where("false"), ["doc_id"]).count() == 0


def test_a_changed_row_is_found_by_its_proof(spark, sf):
    got = queries.op12_merkle_manifest(spark, sf).collect()
    for r in got:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root)
    assert len({r.root for r in got}) == 1 and 0 < sum(not r.verified for r in got) < len(got)


# Best-fit packing.


def plain_best_fit(items, length, most):
    """Bins by a linear search."""
    open_bins, closed = [], []
    for item, size in items:
        fit = [b for b in open_bins if b[0] >= size]
        b = min(fit, key=lambda b: b[0]) if fit else [length, []]
        if fit:
            open_bins.remove(b)
        b[0] -= size
        b[1].append(item)
        if b[0] == 0:
            closed.append(b)
            continue
        if len(open_bins) == most:
            fullest = min(open_bins, key=lambda b: b[0])
            open_bins.remove(fullest)
            closed.append(fullest)
        open_bins.append(b)
    return sorted(length - b[0] for b in closed), sorted(length - b[0] for b in open_bins)


@pytest.mark.parametrize("most", [1, 3, 40])
def test_bins_equal_a_linear_search(most):
    rng = random.Random(most)
    items = [(i, rng.choice([rng.randint(1, 63), rng.randint(1, 12)])) for i in range(2000)]
    closed = []
    bins = best_fit.Bins(64, most, closed.append)
    for x in items:
        bins.add(*x)
    rest = [b for _, b in bins.rest()]
    total = lambda bs: sorted(sum(s for _, s in b) for b in bs)
    assert (total(closed), total(rest)) == plain_best_fit(items, 64, most)
    assert sorted(i for b in closed + rest for i, _ in b) == list(range(2000)) and max(total(closed + rest)) <= 64


def check_pieces(got, texts, length, end):
    """Pieces hold each document's ids once and lie in their sequences without gaps."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= length
    for key, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        own = sorted(by[key], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // length)))
        assert [r.start for r in own] == [i * length for i in range(len(own))]
        assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in own]).tolist() == ids
        assert [r.length for r in own] == [min(length, len(ids) - r.start) for r in own]
    return len(seqs)


@pytest.mark.parametrize("items, most", [(12, 8192), (1 << 14, 8192), (1 << 14, 20)])
def test_packing_is_whole_and_tight(spark, sf, monkeypatch, items, most):
    monkeypatch.setattr(best_fit, "ITEMS", items)
    monkeypatch.setattr(best_fit, "OPEN", most)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = best_fit.pack(docs, VOCABULARY, length=256).collect()
    n = check_pieces(got, {r.doc_id: r.text for r in docs.collect()}, 256, 0)
    sizes = sorted((r.length for r in got), reverse=True)
    bins = []
    for s in sizes:  # first fit decreasing
        at = next((i for i, b in enumerate(bins) if b + s <= 256), None)
        if at is None:
            bins.append(s)
        else:
            bins[at] += s
    assert n <= (len(bins) if (items, most) == (1 << 14, 8192) else 1.1 * len(bins) + 2)


def test_packing_of_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 30000, 4: "ü 日本 \x00", 5: "a"}
    docs = spark.createDataFrame([(*x, 7, "clash") for x in texts.items()], "doc_id long, text string, piece int, bin string")
    got = best_fit.pack(docs, VOCABULARY, length=64, end_id=5)
    check_pieces(got.collect(), texts, 64, 5)
    whole = best_fit.sequences(got, 64, 9).collect()
    assert all(len(r.ids) == 256 and np.frombuffer(bytes(r.ids), "<u4")[r.n_tokens :].tolist() == [9] * (64 - r.n_tokens) for r in whole)
    twice = best_fit.pack(spark.createDataFrame([(None, "a b c")] * 3, "doc_id long, text string"), VOCABULARY, length=8).collect()
    assert len(twice) == 3 and all(r.piece == 0 for r in twice)
    assert best_fit.pack(docs.where("false"), VOCABULARY).count() == 0
    assert best_fit.pack(docs.where("doc_id = 2"), VOCABULARY, end_id=None).count() == 0
    exact = best_fit.pack(docs.where("doc_id = 5"), VOCABULARY, length=2).collect()
    assert [(r.length, r.offset) for r in exact] == [(2, 0)]


# Phrases.


def plain_phrases(rows, least, top=2000, covered=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(ws)
            for i in range(len(ws)):
                for m in range(1, min(4, len(ws) - i) + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    over = Counter()
    for (lang, ws), a in cands.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                over[lang, ws[i : i + m]] = max(over[lang, ws[i : i + m]], a)
    out = {}
    for (lang, ws), a in cands.items():
        if 100 * over[lang, ws] >= covered * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top]))


def texts_of(seed, n, letters="abcdeF"):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 2))) for _ in range(12)] + ["ü", "日本", "\x01", "Ä"]
    mark = [" ", " ", " ", " ", " ", "\t", " ", ". ", ",", "\n", "\x0b", "!?"]
    return [("".join(rng.choice(words[: rng.randint(3, 16)]) + rng.choice(mark) for _ in range(rng.randint(0, 120))), rng.choice([None, "und", "de", "hot", "hot", ""])) for _ in range(n)]


@pytest.mark.parametrize("shard", [50, 2_000_000])
def test_phrases_equal_plain_counts(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "RANGE", 300)
    rows = texts_of(shard, 150) + [(None, None), ("", "de"), (" \t", "de"), ("A b A b A b. " * 40, "de")] + [("the same text again and again, it is said", "hot")] * 40
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, depth int, phrase string").repartition(5)
    got = phrases.phrases(docs, least=8, top=60)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 8, 60)
    assert phrases.phrases(docs.where("false")).count() == 0
    assert dict(got.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}


def test_phrases_of_a_very_long_text(spark):
    rows = [("one two three four five " * 40000, "en"), ("one two. three four " * 500, "en")]
    got = phrases.phrases(spark.createDataFrame(rows, "text string, lang string"), least=30)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 30)


def test_tries_survive_packing():
    read = phrases.Words()
    read.add([t for t, _ in texts_of(5, 30)], [lang for _, lang in texts_of(5, 30)])
    whole = phrases.Trie.of(read)
    bounds = sorted({(lang, w, v) for lang in (b"", b"de", b"hot", b"nn") for w, v in zip(whole.words[::3], whole.words[1::3])})
    parts = [t for _, _, t in whole.cut(bounds)]
    back = [phrases.Trie.unpacked(*t.packed(), 4 * (4 + sum(len(x[0]) * (3 if d < 3 else 2) for d, x in enumerate(t.levels)))) for t in parts]
    assert all(np.array_equal(p, q) for a, b in zip(parts, back) for x, y in zip(a.levels, b.levels) for p, q in zip(x, y))
    for d in range(1, phrases.DEPTH):
        assert sum(int(t.levels[d][2].sum()) for t in parts) == int(whole.levels[d][2].sum())


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_merkle_manifest"])
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents",):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = con.execute(queries.ORACLES[name]).fetchdf()[list(got.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))
