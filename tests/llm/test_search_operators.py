"""Near-duplicates, packing, top-k, token counts and sampling, against brute force."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftlake.llm import lattice, minhash, packing, sampling, token_counts, topk

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (None, "one"), (6, "a b c d e"), (6, "a b c d e"), (7, "ü 日本 \x00 x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "k") for r in ODD], "doc_id long, text string, id int, sig string")


def brute_components(texts, words, pct):
    def shingles(t):
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= pct * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in texts}


def families(seed, n=60, size=25, length=60):
    """Texts edited a little, much, or past the threshold."""
    rng = random.Random(seed)
    out = {}
    for f in range(n):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400)) for _ in range(length)]
        for _ in range(rng.randrange(1, size)):
            t = list(base)
            for _ in range(rng.randrange(0, 9)):
                t[rng.randrange(length)] = "e" + str(rng.randrange(99999))
            out[len(out) * 3 + 1] = " ".join(t)
    return out


@pytest.mark.parametrize("limit", [512, 16])
def test_near_duplicates_match_brute_force(spark, monkeypatch, limit):
    """With a limit of 16 the large nodes branch, and clusters are compared in several blocks."""
    monkeypatch.setattr(minhash, "LIMIT", limit)
    texts = families(1) if limit == 512 else families(2, n=6, size=90)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2, pct=80).collect()}
    want = brute_components(texts, 2, 80)
    assert sum(got[i] != want[i] for i in want) == 0


def test_near_duplicates_on_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd, words=2, pct=80).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[2].kept and by[3].component_id == 3
    assert by[5].component_id == 4 and not by[5].kept and by[None].component_id is None and by[None].kept and by[6].component_id == 6
    assert minhash.near_duplicates(odd.where("false"), words=2).count() == 0


def test_five_word_shingles_are_the_default(spark):
    texts = families(3, n=20)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(texts, 5, 80)


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 80)).astype(np.uint64)) for _ in range(20)]
    got = minhash.common_counts(sets[:9], sets[9:], columns=32)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets[:9]) for j, b in enumerate(sets[9:]))


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_word_cache_is_exact(monkeypatch, sf):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()
    texts += ["", "ΑΣ Σ. foo's don't İ <|endoftext|>x ÉtÉ été, ÀB. it's ab'd $$ x!! ß ªb µ ñ", "THE <|ENDOFTEXT|> x", "a!, b,. 3, x.5. 5.", "É,È. x'S. 'll", "a\x00b \x1cx\x1d y\u0085z", "rock'n'roll, co-op, 1,5."]
    want = plain_ids(texts)
    for limit in (600_000, 50):
        monkeypatch.setattr(packing, "CACHED_WORDS", limit)
        cache = packing.WordCache(WORD_BPE)
        got = [np.frombuffer(x, cache.dtype).tolist() + [1] for i in range(0, len(texts), 7) for x in cache.ids(texts[i : i + 7])]
        assert got == want


def test_packing_returns_every_id_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "x y"), (-3, "many words " * 4000)], "doc_id long, text string")
    docs = docs.union(extra)
    rows = packing.pack(docs, WORD_BPE).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    kind, whole = np.dtype("<u4"), {}
    for r in sorted(rows, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, kind).tolist()
        assert len(ids) == r.length and len(whole.setdefault(r.doc_id, [])) == r.start
        whole[r.doc_id] += ids
    assert whole == dict(zip(texts, plain_ids(texts.values())))
    seqs = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert seqs.get(r.sequence_id, 0) == r.offset
        seqs[r.sequence_id] = r.offset + r.length
    assert sorted(seqs) == list(range(len(seqs))) and all(n == 2048 for s, n in seqs.items() if s < len(seqs) - 1)
    one = packing.digest(packing.pack(docs.where("doc_id = -2"), WORD_BPE)).first()
    assert (one.start, one.length, one.doc_tokens, one.ids_crc32) == (0, 1, 1, zlib.crc32(b"\x01\0\0\0"))


def test_packing_on_odd_rows(odd):
    assert {(r.doc_id, r.doc_tokens) for r in packing.pack(odd, WORD_BPE).collect()} >= {(1, 1), (2, 1), (None, 2)}
    assert packing.pack(odd.where("false"), WORD_BPE).count() == 0


def test_curve_steps_by_one():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = packing.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert set(np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1).tolist()) == {1}


def brute_topk(rows, k, query):
    quant = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in quant:
        if query(q):
            best = sorted((-sum(a * b for a, b in zip(quant[q], v)), i) for i, v in quant.items() if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 16))]) for i in range(900)]
    rows += [(900 + i, rows[7][1]) for i in range(200)]  # ties
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")]), (2150, [float("inf")] * 16), (2200, []), (None, [1.0]), (2250, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, n_pivots=12).collect()}
    assert got == brute_topk(rows, 5, lambda i: i % 50 == 0)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = topk.top_k(df.where("vec_id IN (0, 1)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]


def test_topk_of_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 1.0]), (3, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 3, 2] and got[0].score == topk.LARGEST and got[2].score == -topk.LARGEST - 1


def test_topk_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 32)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "PART_BYTES", 1)  # a part is a block
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 8))]) for i in range(700)] + [(50, [9.0] * 8)] * 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, n_pivots=6, pivot_sample=40).collect())
    assert len(got) == 14 * 5 and [s for q, _, s in got if q == 0] == sorted([s for q, _, s in got if q == 0], reverse=True)
    first = {i: max(sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(rows[i][1], v)) for j, v in rows if j != i) for i in range(100, 700, 50)}
    assert all(s == first[q] for q, n, s in got if n == 1 and q in first)


def test_floors_spare_work_and_lose_nothing():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(0, 40, (2000, 8)))
    ids, piv = np.arange(len(x)), topk.choose_pivots(x[:200], 16)
    t = topk.distances(x, piv)
    part = topk.Part(5)
    for lo in range(0, 2000, 250):
        part.add(ids[lo : lo + 250], x[lo : lo + 250], t[lo : lo + 250])
    floor = topk.floors(ids[:40], x[:40], ids[500:700], x[500:700], 5)
    a, b = part.best(ids[:40], x[:40], t[:40], floor), part.best(ids[:40], x[:40], t[:40], np.full(40, -np.inf))
    whole = topk.best_of_block(ids[:40], x[:40], t[:40], ids, x, t, 5)
    order = lambda r: sorted(zip(*(v.tolist() for v in r[:3])))
    assert order(a) == order(b) == order(whole) and a[3] < b[3]


def test_pivots_spare_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 40, (20, 8))
    x = np.floor(np.concatenate([c + rng.normal(0, 1, (100, 8)) for c in centres]))
    piv = topk.choose_pivots(x, 16)
    t = topk.distances(x, piv)
    ids = np.arange(len(x))
    _, _, _, done = topk.best_of_block(ids[:50], x[:50], t[:50], ids, x, t, 5)
    assert done < 0.8 * 50 * len(x)


def unigram_processor(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(PIECES, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.score < -1e8:
            p.score = -1e5  # the library adds 32-bit floats; a score this low would drown the others
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path), sentencepiece.SentencePieceProcessor(model_file=str(path))


def test_counts_match_the_library(tmp_path, sf):
    import pyarrow.parquet as pq

    path, sp = unigram_processor(tmp_path)
    words = sorted({w for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() for w in t.split(" ")})[:5000]
    words += ["", " ", "a  b   c", "\n", "e\nf", "日本語 x", "ab.cd,ef. g", "zß\x00q", "a▁b", "x" * 300]
    got = token_counts.Counter(lattice.Vocabulary(path)).count(words)
    assert [int(g.real) for g in got] == [len(sp.encode(w)) for w in words]


def test_counts_on_odd_rows(odd):
    got = {r.doc_id: r for r in token_counts.token_counts(odd, PIECES).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].score == 0 and got[None].n_tokens > 0
    assert token_counts.token_counts(odd.where("false"), PIECES).count() == 0


def segmentations(v, s):
    known = {p: i for i, p in enumerate(v.pieces)}

    def walk(s):
        if not s:
            yield ()
        for j in range(1, len(s) + 1):
            if s[:j] in known:
                for rest in walk(s[j:]):
                    yield (known[s[:j]], *rest)

    return list(walk(s))


def test_samples_follow_the_distribution():
    v, alpha, n = lattice.vocabulary(PIECES), 2e-4, 3000
    every = segmentations(v, "▁the▁sea")
    w = np.array([math.exp(alpha * sum(v.score[i] for i in x)) for x in every])
    p, number = w / w.sum(), {x: i for i, x in enumerate(every)}
    s = sampling.Sampler(PIECES, ["the sea"] * n, list(range(n)), alpha, 1)
    got, threshold = s.top(3)
    first, second, weighed = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p))
    for x, t in zip(got, threshold):
        k = [number[tuple(s.ids(o, e).tolist())] for o, e, _, _ in x]
        assert len(set(k)) == 3 and x[0][3] >= x[1][3] >= x[2][3] >= t
        first[k[0]] += 1
        second[k[1]] += 1
        for i, (_, _, lp, _) in zip(k, x):
            assert abs(math.exp(lp) - p[i]) < 1e-9
            weighed[i] += 1 / -math.expm1(-math.exp(lp - t))
    big = np.argsort(-p)[:6]
    after = np.array([sum(p[i] * p[j] / (1 - p[i]) for i in range(len(p)) if i != j) for j in big])
    assert np.abs(first[big] / n - p[big]).max() < 0.03 and np.abs(second[big] / n - after).max() < 0.03
    assert abs((weighed[big] * p[big]).sum() / p[big].sum() / n - 1) < 0.05  # inclusion scores weigh without bias


def test_small_lattices_are_exhausted():
    """To the last one, also where a piece is scored out (probability e**-100000 and less) or the best one's probability rounds to 1."""
    v = lattice.vocabulary(PIECES)
    for text, alpha in (("sea", 1e-4), ("a", 1e-3), ("I", 1e-3), ("A.", 1e-3), ("the", 1.0)):
        every = segmentations(v, "▁" + text)
        assert len(every) > 1
        s = sampling.Sampler(PIECES, [text], [5], alpha, 1)
        got, threshold = s.top(50)
        assert {tuple(s.ids(o, e).tolist()) for o, e, _, _ in got[0]} == set(every) and len(got[0]) == len(every) and threshold == [-np.inf]
        assert [x[3] for x in got[0]] == sorted((x[3] for x in got[0]), reverse=True)
        logs = {x: alpha * sum(v.score[i] for i in x) for x in every}
        total = np.logaddexp.reduce(list(logs.values()))
        assert all(abs(lp - logs[tuple(s.ids(o, e).tolist())] + total) < 1e-6 * (1 + abs(lp)) for o, e, lp, _ in got[0])


def test_unlikely_second_segmentations_come_out():
    s = sampling.Sampler(PIECES, ["a", "I", "A.", "x" * 3000, "日本\nü\ufffe\ttab"], list(range(5)), 1e-3, 1)
    got, _ = s.top(2)
    decode = sampling.decoder(PIECES)
    assert [len(x) for x in got] == [2] * 5
    assert {decode(s.ids(o, e).astype("<u4").tobytes()) for o, e, _, _ in got[4]} == {"日本\nü\ufffe\ttab"}


def test_trie_lists_what_the_automaton_lists(sf):
    import pyarrow.parquet as pq

    v = lattice.vocabulary(PIECES)
    cuts = sorted({c for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:40] for c in v.chunks(t)} | {"\n", "日本", "x" * 500})
    a, (b, low) = lattice.build(v, cuts), lattice.build_by_start(v, cuts)
    spelt = lambda lat: sorted(zip(lat.start.tolist(), lat.end.tolist(), lat.score.tolist()))
    assert spelt(a) == spelt(b) and (np.diff(b.start * 1000 + b.end) > 0).all() and low[-1] == len(b.start)


def test_a_full_store_starts_anew(monkeypatch):
    texts = ["the sea and the sky", "ein Wort, noch eins", "the sky"]
    want = [[(s.ids(o, e).tolist(), lp) for x in got for o, e, lp, _ in x] for s in [sampling.Sampler(PIECES, texts, [1, 2, 3], 1e-3, 1)] for got, _ in [s.top(2)]]
    monkeypatch.setattr(sampling, "_stores", {(PIECES, 1e-3): sampling.Store(PIECES, 1e-3, edges=10)})
    for _ in range(3):
        s = sampling.Sampler(PIECES, texts, [1, 2, 3], 1e-3, 1)
        got, _ = s.top(2)
        assert [(s.ids(o, e).tolist(), lp) for x in got for o, e, lp, _ in x] == want[0]


def test_samples_do_not_depend_on_batches(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40)
    one = sampling.sample_segmentations(docs, PIECES, k=3).orderBy("doc_id", "sample").collect()
    two = sampling.sample_segmentations(docs.repartition(7), PIECES, k=3).orderBy("doc_id", "sample").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in two]
    assert all(r.round_trip for r in sampling.digest(sampling.sample_segmentations(docs.unionByName(odd.select("doc_id", "text")), PIECES, verify=True)).collect())
    back = {r.doc_id: r.text for r in sampling.decoded(sampling.sample_segmentations(docs, PIECES, k=1), PIECES, ["doc_id"]).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    got = sampling.sample_segmentations(odd, PIECES).collect()
    assert [(r.n_tokens, r.inclusion) for r in got if r.doc_id == 1] == [(0, 1.0)]
    assert sampling.sample_segmentations(odd.where("false"), PIECES).count() == 0
