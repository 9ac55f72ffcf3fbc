"""Subvector clustering, token alignment and M-tree search against brute force."""

import bisect
import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from twinline.llm import alignment, mtree, multiindex, subvectors

P = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
ALIGN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<double>, label string, vec string, cluster string, rep string, rank string, score string, shard string"


def byte_of():
    """The characters that stand for bytes in the vocabulary's texts."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute_alignment(texts):
    """The contract's columns by a merge of all ends, with the vocabulary's own library for A."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=ALIGN[2])
    a_side.encode_special_tokens = True
    table, name = byte_of(), {i: s for s, i in a_side.get_vocab().items()}
    links, rows = [], []
    for text in texts:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        raw_a = [bytes(table[c] for c in name[i]) for i in a]
        raw_b = [bytes([int(b_side.id_to_piece(i)[3:-1], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            a, b, raw_a, raw_b = [], [], [], []
        ends_a, ends_b = (list(itertools.accumulate(map(len, raw))) for raw in (raw_a, raw_b))
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = bisect.bisect(ends_a, cut), bisect.bisect(ends_b, cut)
            groups.append((a[x:to_a], b[y:to_b]))
            x, y = to_a, to_b
        held = Counter((p, q) for g, h in groups for p in g for q in h)
        links.append(held)
        told = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append([len(a), len(b), len(groups), sum(held.values()), hashlib.sha256(told.encode()).hexdigest() if groups else ""])
    docs, most = Counter(p for held in links for p in held), defaultdict(int)
    for (p, _), n in docs.items():
        most[p] = max(most[p], n)
    return [(*r[:4], sum(n for k, n in held.items() if docs[k] == most[k[0]]), sum(n * docs[k] for k, n in held.items()), r[4]) for r, held in zip(rows, links)]


ODD = [None, "", " ", "a", "▁ replaced by B", "  two spaces\n\ttab \r\n", "\0 zero", "<s> <|endoftext|> </s>", "é" * 30, "a" * 3000, " " * 2000, "日本語のテキスト" * 20, "x▁y",
       "the same words", "the same words", "🙂🙃 mixed ünïcode 1234567890" * 5, "ab" * 700, "=" * 999 + "-" * 1001]


@pytest.mark.parametrize("chars", [(40, 200), (alignment.SLICE, alignment.SEGMENT)])
def test_alignment(spark, chars):
    texts = ODD + [t for t in pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist() if len(t) < 4000][:60]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, segment string, pairs int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align_tokens(docs, *ALIGN, *chars).collect()}
    assert [got[k] for k in range(len(texts))] == brute_alignment(texts)
    assert got[4] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_rows(spark):
    """Null and repeated ids are rows of their own; an empty table gives nothing."""
    docs = spark.createDataFrame([(None, "some words"), (1, "some words"), (1, "some words"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, alignment.align_tokens(docs, *ALIGN).collect()))
    want = brute_alignment(["some words"] * 3 + [None])
    assert got == sorted(str(r) for r in spark.createDataFrame([(i, *w) for i, w in zip([None, 1, 1, None], want)], alignment._ROWS).collect())
    assert alignment.align_tokens(docs.limit(0), *ALIGN).count() == 0


def test_large_groups():
    """Groups beyond the listed size are counted by distinct ids, with the same result."""
    rng = np.random.default_rng(3)

    class Sizes:
        n_a, n_b = 7, 9
        len_a, len_b = np.array([3] * 7), np.array([5] * 9)
        signs = np.ones((2 * 7 + 2 * 9, 2), np.uint8)

    coded = [(rng.integers(0, 7, 5 * k), rng.integers(0, 9, 3 * k)) for k in (1, 4, 0, 9)]
    many, few = alignment.align(coded, Sizes), None
    alignment.LISTED, kept = 3, alignment.LISTED
    try:
        few = alignment.align(coded, Sizes)
    finally:
        alignment.LISTED = kept
    assert {k: list(v) for k, v in many.items()} == {k: list(v) for k, v in few.items()}
    assert many["n_groups"].tolist() == [1, 4, 0, 9] and many["n_links"].tolist() == [15, 60, 0, 135]


def test_cut_search():
    """Every shared end is found, whichever intervals it takes."""
    rng = np.random.default_rng(5)
    for share in (0.02, 0.3, 0.9):
        size = 400
        ends = [np.unique(np.r_[rng.integers(1, 4000, size), 4000]) for _ in range(2)]
        shared = rng.random(4001) < share
        ends[1] = np.unique(np.r_[ends[1][~np.isin(ends[1], ends[0]) | shared[ends[1]]], ends[0][shared[ends[0]]], 4000])
        cut_a, cut_b = alignment.shared_cuts(ends[0], ends[1], np.array([0, len(ends[0])]), np.array([0, len(ends[1])]))
        both = np.intersect1d(*ends)
        assert ends[0][cut_a].tolist() == both.tolist() == ends[1][cut_b].tolist()


@pytest.fixture(scope="module")
def vectors(spark):
    """Ties, repeated rows, nulls in any column, other lengths, non-finite and zero vectors, clashing names."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(400, 64)) * 0.12, 3)
    x[200:260] = x[7]  # a hot vector
    x[260:330] = x[:70] + np.round(rng.normal(size=(70, 64)) * 0.004, 3)
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)]
    rows += [rows[3], rows[3], rows[100], rows[100], (None, rows[9][1]), (None, rows[10][1]), (500, None), (600, [None] + [0.1] * 63), (700, [float("nan")] * 64), (800, [float("inf")] + [0.0] * 63),
             (900, [0.0] * 64), (901, [0.0] * 64), (1000, [1.0, 2.0]), (1001, [1.0, 2.0]), (1002, [-1.0, 0.5]), (1100, []), (1101, []), (1200, [0.25] * 3), (-300, [0.1] * 64)]
    return spark.createDataFrame([(i, v, *["z"] * 7) for i, v in rows], VECTORS).repartition(3)


def sound(rows):
    return [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]


def brute_top(rows, k, scale):
    kept, out = [(i, np.floor(scale * v).astype(int)) for i, v in sound(rows)], []
    for at, (i, q) in enumerate(kept):
        if i is not None and i % 100 == 0:
            near = sorted((-int(q @ v), j is None, j or 0) for n, (j, v) in enumerate(kept) if n != at and len(v) == len(q))
            out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(near[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("shard,pivots,block", [(8192, 64, 2048), (24, 6, 2), (64, 4, 100)])
def test_top_k(spark, vectors, shard, pivots, block):
    got = mtree.top_k(vectors, shard=shard, pivots=pivots, block=block).collect()
    assert sorted(str((r.query_id, r.rank, r.vec_id, r.score)) for r in got) == brute_top(vectors.collect(), 10, 1024)


def test_top_k_edges(spark, vectors):
    assert mtree.top_k(vectors.limit(0)).count() == 0
    assert mtree.top_k(vectors.where("vec_id = 1200")).count() == 0  # a query without candidates
    with pytest.raises(Exception, match="too large"):
        mtree.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")).count()


def test_tree_avoids_products():
    """On clustered vectors most products are never computed, and the result is that of all of them."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(40, 16)) * 900
    x = np.floor(np.repeat(middle, 50, 0) + rng.normal(size=(2000, 16)) * 20).astype(np.int64)
    tree, ids = mtree.Tree(mtree.build(x)), [[i] for i in range(len(x))]
    for q in x[::200]:
        want = sorted((-int(s), i) for i, s in enumerate(x @ q))[:5]
        assert tree.search(q, 5, ids) == [(-s, i) for s, i in want]
    assert tree.computed < 10 * len(x) / 3
    for page in tree.pages:  # stored distances and radii are true
        assert np.allclose(page["gaps"], np.linalg.norm(page["points"] - page["own"], axis=1)) and len(page["child"]) <= mtree.PAGE


def brute_clusters(rows):
    kept = [(i, np.floor(64 * v).astype(int)) for i, v in sound(rows) if len(v) == 64]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), tuple(r[1])))[:16]
    middle = [v.tolist() for _, v in first]

    def nearest(v):
        return min((int(((v - np.array(m)) ** 2).sum()), j) for j, m in enumerate(middle))

    for _ in range(3):
        own = [nearest(v)[1] for _, v in kept]
        for j in set(own):
            held = [v for (_, v), o in zip(kept, own) if o == j]
            middle[j] = [int(s) // len(held) for s in sum(held)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    return sorted(str((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest())) for i, d, j in last)


@pytest.mark.parametrize("width,segment", [(2, 1 << 14), (3, 50), (1, 7), (64, 33)])
def test_clusters(spark, vectors, width, segment):
    got = subvectors.cluster(vectors, width=width, segment=segment).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_clusters(vectors.collect())


def test_cluster_edges(spark, vectors):
    few = vectors.where("vec_id in (1, 2, 3)")
    assert sorted(str(tuple(r)) for r in subvectors.cluster(few).collect()) == brute_clusters(few.collect())  # fewer vectors than centroids
    assert subvectors.cluster(vectors.limit(0)).count() == 0 and subvectors.cluster(vectors.where("vec_id = 500")).count() == 0
    with pytest.raises(Exception, match="leave a long"):
        subvectors.cluster(spark.createDataFrame([(0, [1e300] * 64)], "vec_id long, embedding array<double>")).count()


def test_dictionaries():
    """Codes and dictionaries give the vectors back."""
    x = np.random.default_rng(4).integers(-9, 9, (500, 7))
    part = subvectors.Segment(subvectors.encode(list(range(500)), x, 2), 0, 2)
    assert (np.concatenate([t[c] for t, c in zip(part.tables, part.codes)], 1) == x).all()
    assert all(len(np.unique(t, axis=0)) == len(t) for t in part.tables)


def test_near_vectors_of_several_lengths(spark):
    """Vectors of every length link with those of their own, against brute force; one length is commonest, three are rare, one has 18 neighbours in number."""
    rng = np.random.default_rng(11)
    made = []
    for dim, n in [(4, 60), (3, 12), (1, 3), (9, 40), *[(20 + k, 3) for k in range(18)]]:
        base = rng.normal(size=(n, dim))
        made += [*base.tolist(), *(base[: n // 3] + rng.normal(size=(n // 3, dim)) * 0.03).tolist(), *(base[:1] * 2).tolist()]
    made += [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [0.0, 0.0, 0.0], None]
    order = rng.permutation(len(made))
    rows = [(int(i), made[i]) for i in order]
    unit = [None if v is None or not any(v) else np.array(v) / np.linalg.norm(v) for v in made]
    hit = np.array([[a is not None and b is not None and i != j and len(a) == len(b) and float(a @ b) >= 0.9 for j, b in enumerate(unit)] for i, a in enumerate(unit)])
    label = np.arange(len(made))
    for _ in range(len(made)):
        label = np.array([min([label[i], *label[hit[i]]]) for i in range(len(made))])
    got = {r.vec_id: r for r in multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), codewords=4, recall=1.0, block=16).collect()}
    assert [got[i].n_links for i in range(len(made))] == hit.sum(1).tolist() and [got[i].component_id for i in range(len(made))] == label.tolist()
