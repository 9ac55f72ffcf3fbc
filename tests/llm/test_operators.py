"""The training-data operators against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from twinline.llm import components, duckbpe, imatch, langid, linediff, multiindex, nearcopies, packing, quality, queries, simhash, suffixes, toolcalls

P = pytest.importorskip("public_tokenizers")
SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RANKS, PACKED = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, doc string, removed string, spans string, score string, key string, next string, bits string"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def texts(sf=SMALL):
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    long_word, many = "ab" * 700, " ".join(f"w{i % 977}x{i}" for i in range(9000))
    body = "\n".join(f"a line of shared words number {i} that is long enough to count as a block" for i in range(12))
    made = [(1, body), (2, body), (2, body), (None, body), (3, None), (4, ""), (4, ""), (5, " \n \t"), (6, long_word), (7, many), (7, "another text"), (None, None), (8, "!!! 123"),
            (9, many + " end"), (10, "x <|endoftext|> y")]
    return spark.createDataFrame([(i, t, "en" if k % 2 else "fr", None, None, *["z"] * 8) for k, (i, t) in enumerate(made)], DOCS).repartition(3)


RUNS = {
    "langid": lambda d: langid.identify(d), "imatch": lambda d: imatch.imatch(d), "bpe": lambda d: duckbpe.digests(d, RANKS, P.PATTERN),
    "simhash": lambda d: simhash.simhash_groups(d), "lines": lambda d: linediff.dedup_lines(d), "passages": lambda d: suffixes.dedup_passages(d),
    "quality": lambda d: quality.quality(d, d.select("doc_id", F.lit(1).alias("quality"))),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(odd, name):
    got = RUNS[name](odd).collect()
    assert len(got) == odd.count()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(odd, name):
    assert RUNS[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("number", range(4))
def test_stages_on_odd_rows(spark, odd, number):
    """A stage of the pipeline keeps rows and columns of odd tables, and takes an empty one."""
    import corpus_pipeline
    name, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, odd, SMALL)
    assert got.columns == odd.columns
    ids = [str(r.doc_id) for r in got.select("doc_id").collect()]
    assert set(ids) <= {str(r.doc_id) for r in odd.select("doc_id").collect()} and len(ids) <= odd.count()
    if name == "near_copies":
        assert ids.count("7") == 2 and ids.count("4") == 0  # both texts of one id stay; empty texts are copies of the null text of no id
    assert stage(spark, odd.limit(0), SMALL).count() == 0


def test_odd_values(odd):
    by = {(r.doc_id, r.lang_pred) for r in langid.identify(odd).collect() if r.doc_id in (3, 4, 5, 8)}
    assert by == {(3, "und"), (4, "und"), (5, "und"), (8, "und")}
    assert {r.fingerprint for r in simhash.simhash_groups(odd).where("doc_id in (3, 4, 5)").collect()} == {"0" * 16}
    cut = {(r.doc_id, r.text) for r in suffixes.dedup_passages(odd).where("doc_id in (1, 2)").collect()}
    assert cut == {(1, ""), (2, "")}  # the row with the null id comes first and keeps the passage
    assert suffixes.repeated_spans(odd.limit(0)).count() == 0 and suffixes.repeated_spans(odd).where("doc_id = 9").first().n_words == 9000
    left = {(r.doc_id, r.removed) for r in linediff.dedup_lines(odd.drop("removed")).where("doc_id in (1, 2, 4)").collect()}
    assert left == {(1, 12), (2, 12), (4, 0)}


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97
    assert {r.doc_id for r in langid.identify(docs).where("held_out").select("doc_id").collect()} == {i for i, _ in texts(MIDDLE) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_many_languages(spark):
    """Every label is learned, beyond 64 too, and all share the budget of windows."""
    made = [(i, f"lorem {i % 70} text", f"l{i % 70}") for i in range(1400)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = langid.labelled_windows(docs)
    assert {k for k, _ in got} == {f"l{i}" for i in range(70)} and len(got) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, *_ in made)
    few = langid.labelled_windows(docs, windows=140)
    assert len(few) == 140 and len({k for k, _ in few}) == 70


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs, labels)
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.score == 0.5 for r in quality.quality(docs.limit(5), labels.limit(0)).collect())


def test_tool_calls(spark):
    calls = spark.createDataFrame([(1, "a", 3, "t", '{"b": 1, "a": {"d":2,"c":[1, 2]}}', None), (1, "b", 1, "t", '{"b":"x"}', "a"), (1, "c", 5, "t", "no json", "b"), (1, "d", 6, "u", "{}", "d"),
                                   (1, "e", 7, "t", '{"a":{},"b":2,"z":1}', "f"), (1, "f", 8, "t", '{"a":{},"b":2}', "e"), (1, "a", 4, "t", '{"b":9}', None), (None, "a", 1, "t", None, None),
                                   (2, "a", 1, "t", '{"a":{},"b":2}', "gone")], "conv_id long, call_id string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([(1, "a", 4, 'say "hi"'), (2, "a", 0, "early"), (3, "q", 1, None), (1, "a", 9, "late")], "conv_id long, call_id string, turn long, content string")
    schemas = spark.createDataFrame([("t", True, [("a", "object", True), ("b", "integer", True)])], "name string, closed boolean, fields array<struct<name:string,type:string,required:boolean>>")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link_calls(calls, results, schemas).collect()}
    assert {k: (r.status, r.depth) for k, r in got.items()} == {
        (1, "a"): ("linked", 0), (1, "b"): ("invalid", 1), (1, "c"): ("invalid", 2), (1, "d"): ("unknown tool", -1), (1, "e"): ("invalid", -1), (1, "f"): ("cycle", -1),
        (None, "a"): ("invalid", None), (2, "a"): ("early", 0), (3, "q"): ("orphan", None)}
    assert got[1, "a"].json == '{"arguments":{"a":{"c":[1,2],"d":2},"b":1},"id":"a","name":"t","result":"say \\"hi\\""}' and got[1, "a"].repeats == 2
    assert got[1, "b"].faults == "missing:a,type:b" and got[1, "e"].faults == "unknown:z" and got[1, "c"].json.startswith('{"arguments":"no json"')
    assert toolcalls.link_calls(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0


def test_repeated_calls_and_results(spark):
    calls = spark.createDataFrame([(1, "a", 1, "t", "{}", None), (1, "a", 2, "t", '{"x":1}', None), (1, "a", 2, "t", '{"x":1}', None)],
                                  "conv_id long, call_id string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([(1, "a", 3, "one"), (1, "a", 4, "two"), (1, "q", 5, "three"), (1, "q", 6, "four")], "conv_id long, call_id string, turn long, content string")
    schemas = spark.createDataFrame([("t", False, [])], "name string, closed boolean, fields array<struct<name:string,type:string,required:boolean>>")
    got = sorted((r.call_id, r.turn, r.status, r.repeats, r.json) for r in toolcalls.link_log(calls, results, schemas).collect())
    assert got == [("a", 1, "linked", 1 + 2, '{"arguments":{},"id":"a","name":"t","result":"one"}'), ("a", 2, "repeated", 2, '{"arguments":{"x":1},"id":"a","name":"t","result":null}'),
                   ("a", 4, "repeated", 1, '{"arguments":null,"id":"a","name":null,"result":"two"}'), ("q", 5, "orphan", 0, '{"arguments":null,"id":"q","name":null,"result":"three"}'),
                   ("q", 6, "repeated", 1, '{"arguments":null,"id":"q","name":null,"result":"four"}')]


def test_tool_call_chain(spark):
    calls = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.concat(F.lit("c"), "id").alias("call_id"), F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") - 1)).alias("after"))
    assert {r.call_id: r.depth for r in toolcalls.depths(calls).collect()} == {f"c{i}": i for i in range(300)}


def test_imatch(spark):
    got = {r.doc_id: r for r in imatch.imatch(spark.read.parquet(f"{SMALL}/documents.parquet"), per_bucket=23).collect()}
    docs = sorted(texts())
    plain = imatch.BETWEEN.encode().decode("unicode_escape")
    import re
    term_lists = {i: list(dict.fromkeys(w for w in re.split(plain, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if w)) for i, t in docs}
    df = defaultdict(int)
    for ts in term_lists.values():
        for t in ts:
            df[t] += 1
    lexicon = {t for t, n in df.items() if max(1, imatch.LEAST_SHARE * len(docs)) <= n <= imatch.MOST_SHARE * len(docs)}

    def prints(terms):
        kept = [t for t in terms if t in lexicon]
        marks = [hashlib.md5(t.encode()).hexdigest() for t in sorted(kept if len(kept) >= imatch.FEW else terms, key=str.encode)]
        held = [",".join(m for m in marks if m[a - 1 : a - 1 + n] < f"{v:0{n}x}") for a, n, v in imatch.SUBLEXICONS]
        return "-".join(hashlib.md5(h.encode()).hexdigest()[:16] if h else "" for h in held)

    assert all(got[i].fingerprint == prints(term_lists[i]) for i, _ in docs)
    for (i, t), (_, x) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + x[:half]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = defaultdict(set)
    for i, t in docs:
        same[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_packing(spark, odd):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id in (6, 10)").selectExpr("doc_id + 100000 as doc_id", "text"))
    got = packing.pack(docs, PACKED, P.PATTERN, shard=16).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text in docs.collect():
        ids = np.array(coder.encode(text, add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and not at & (at - 1)
    assert sum(r.length for r in packing.pack(odd, PACKED, P.PATTERN).where("doc_id = 3").collect()) == 1
    assert packing.pack(odd.limit(0), PACKED, P.PATTERN).count() == 0


def test_retrieval_order():
    docs = [{"terms": np.array(t), "counts": np.ones(len(t)), "n": len(t), "tail": np.zeros(n), "used": 0} for t, n in (([1, 2], 3), ([5, 6], 2), ([1, 3], 3), ([1, 2, 9], 2))]
    windows, left = packing.fill(docs, 5, np.ones(10, np.float32), 2.0)
    assert [([x is d for x in docs].index(True), at, n) for d, at, n in windows[0]] == [(0, 0, 3), (3, 0, 2)]
    assert sum(len(d["tail"]) - d["used"] for d in left) == 0 and len(windows) == 2


def test_repeats(spark):
    docs = sorted(texts())
    words = {i: t.encode().split() for i, t in docs}
    first, want = {}, set()
    for i, _ in docs:
        for p in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][p : p + 20]), i)
    for i, _ in docs:
        cover = []
        for p in range(len(words[i]) - 19):
            if first[tuple(words[i][p : p + 20])] < i:
                if cover and p <= cover[-1][1]:
                    cover[-1][1] = p + 20
                else:
                    cover.append([p, p + 20])
        want |= {(i, a, b - a) for a, b in cover}
    got = suffixes.repeated_spans(spark.read.parquet(f"{SMALL}/documents.parquet"), 20, 7).collect()
    assert {(r.doc_id, r.first_word, r.n_words) for r in got} == want and want
    text = dict(docs)
    for r in got:
        assert text[r.doc_id].encode()[r.first_byte : r.end_byte].split() == words[r.doc_id][r.first_word : r.first_word + r.n_words]


def test_byte_bpe(spark, odd):
    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 100000 as doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(7, "a" * 900 + "ñ" * 300 + "  \n  end 🎉")], "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in duckbpe.encode_decode(docs, RANKS, P.PATTERN).collect())
    want = []
    for doc_id, text in docs.collect():
        ids = np.array(coder.encode_ordinary(text or ""), "<u4")
        want.append((str(doc_id), len(ids), ids.tobytes(), (text or "").encode()))
    assert got == sorted(want)


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 16))
    close = base[:40] + rng.normal(size=(40, 16)) * 0.08
    x = np.concatenate([base, close, base[:7], np.repeat(base[:1] * 2, 30, 0)])
    bad = [None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 3, []]
    made = [(i, v) for i, v in enumerate([*x.tolist(), *bad])]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    label = list(range(len(x)))
    for _ in range(len(x)):
        label = [min([label[i], *(label[j] for j in np.flatnonzero(hit[i]))]) for i in range(len(x))]
    frame = spark.createDataFrame([(i, v, "n") for i, v in made], "vec_id long, embedding array<double>, many string")
    for block in (1024, 8):
        got = {r.vec_id: r for r in multiindex.near_vectors(frame, codewords=4, recall=1.0, block=block).collect()}
        assert [got[i].n_links for i in range(len(x))] == hit.sum(1).tolist() and [got[i].component_id for i in range(len(x))] == label
        assert all(got[i].n_links == 0 and got[i].kept for i in range(len(x), len(made)))
    assert multiindex.near_vectors(frame.limit(0)).count() == 0


def test_near_vectors_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r.embedding for r in table.orderBy("vec_id").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    got = np.array([r.n_links for r in multiindex.near_vectors(table).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()


def groups_of(values, near):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if v in (a, b) else v for v in label]
    return label


def test_simhash(spark):
    docs = sorted(texts())
    got = {r.doc_id: r for r in simhash.simhash_groups(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}

    def plain(t):
        w = t.encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) > len(s))

    bits = [plain(t) for _, t in docs]
    assert [got[i].fingerprint for i, _ in docs] == [f"{b:016x}" for b in bits]
    label = groups_of(bits, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got[i].component_id for i, _ in docs] == [docs[k][0] for k in label]


def test_planted_near_copies(spark):
    """The pipeline's stage keeps what brute force over all pairs keeps; copies are planted on both sides of 0.8."""
    import corpus_pipeline
    rnd = random.Random(8)
    made = []
    for _ in range(40):
        base = [f"v{rnd.randrange(5000)}" for _ in range(rnd.choice([40, 150, 600]))]
        made.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), max(1, int(len(copy) * rnd.uniform(0.002, 0.03)))):
                copy[at] = f"u{rnd.randrange(10**6)}"
            made.append(" ".join(copy))
    rnd.shuffle(made)
    made += ["one two", "One two", "", None]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))} for w in ((t or "").lower().split() for t in made)]
    like = [len(a & b) / max(1, len(a | b)) if a or b else 1.0 for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= s < 0.95 for s in like) > 50 and sum(0.7 <= s < 0.8 for s in like) > 20
    label = groups_of(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()) == sorted(set(label))


def test_alike_texts_make_few_pairs(spark, monkeypatch):
    """A large group of texts that are alike, but below 0.8, makes few pairs; the links among them are all found."""
    rnd = random.Random(12)
    base = [f"v{rnd.randrange(5000)}" for _ in range(150)]
    made = []
    for _ in range(120):
        copy = list(base)
        for at in rnd.sample(range(150), 4):
            copy[at] = f"u{rnd.randrange(10**6)}"
        made += [" ".join(copy)] + [" ".join([*copy[:-1], "end"])] * (rnd.random() < 0.1)
    hashes = [np.unique(simhash.shingle_hashes(t.encode(), 5, 42)) for t in [*made, "", "one"]]
    rows = [(i, len(h), nearcopies.parities(h).tolist()) for i, h in enumerate(hashes)]
    marks = spark.createDataFrame(rows, "i long, size long, odd array<long>")
    c = F.col
    pairs = marks.crossJoin(marks.toDF("j", "b_size", "b_odd")).where("i < j")
    may = {(r.i, r.j) for r in pairs.where(nearcopies.may_reach(c("size"), c("odd"), c("b_size"), c("b_odd"), 0.8)).collect()}
    alike = {(i, j) for j in range(len(hashes)) for i in range(j) if nearcopies.jaccard(set(hashes[i].tolist()), set(hashes[j].tolist())) >= 0.8}
    assert len(alike) > 5 and alike <= may and len(may) < 5 * len(alike)
    seen, settled = [], nearcopies.settled

    def counted(df):
        out = settled(df)
        if out.columns == ["a", "b"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "settled", counted)
    got = nearcopies.drop_near_copies(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()
    label = groups_of(made, lambda a, b: (min(made.index(a), made.index(b)), max(made.index(a), made.index(b))) in alike or a == b)
    assert sorted(r.doc_id for r in got) == sorted(set(label))
    assert len(seen) == 5 and max(seen[1:]) < 5 * len(alike)  # stars, those that may reach 0.8, their links, pairs across components, their links


def test_near_copies_of_one_id(spark):
    """Texts under one id, or none, all stay unless they are copies; the choice does not depend on the order of rows."""
    clean = [(i, " ".join(f"w{k}x{n}" for n in range(60)), "a") for k, i in enumerate([None, None, None, 7, 7, 7, 8])]
    made = [*clean, (9, clean[0][1], "b"), (7, clean[3][1], "c"), (8, None, "d"), (None, None, "e")]
    kept = set()
    for n, order in ((1, made), (3, made[::-1])):
        got = nearcopies.drop_near_copies(spark.createDataFrame(order, "doc_id long, text string, row string").repartition(n)).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t, _ in [*clean, made[-1]])
        kept.add(tuple(sorted(map(str, got))))
    assert len(kept) == 1


@pytest.mark.parametrize("node_rows", [4096, 3])
def test_fingerprint_links(spark, node_rows):
    rnd = random.Random(4)
    seeds = [rnd.getrandbits(64) for _ in range(20)]
    bits = sorted({s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for s in seeds for _ in range(15)})
    frame = spark.createDataFrame([(b - (1 << 64) if b >> 63 else b,) for b in bits], "bits long")
    comp = {r.node % (1 << 64): r.component % (1 << 64) for r in components.components(simhash.fingerprint_links(frame, node_rows=node_rows)).collect()}
    label = groups_of(bits, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len({(comp.get(b, b), k) for b, k in zip(bits, label)}) == len({comp.get(b, b) for b in bits}) == len(set(label))


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e if None not in e}
    for _ in range(400):
        for a, b in edges:
            if None not in (a, b):
                label[a] = label[b] = min(label[a], label[b])
    assert got == {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges if None not in e)}


def test_patience():
    assert linediff.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert linediff.patience([1, 2, 3], [3, 1, 2]) == [(0, 1), (1, 2)]
    assert linediff.patience([], [1]) == []
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(9) for _ in range(rnd.randrange(12))] for _ in range(2))
        got = linediff.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_line_dedup(spark):
    docs = sorted(texts())
    got = {r.doc_id: (r.text, r.removed) for r in linediff.dedup_lines(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    lines = {i: t.split("\n") for i, t in docs}
    holders = defaultdict(list)
    for i, _ in docs:
        for x in dict.fromkeys(lines[i]):
            if x.strip(" "):
                holders[x].append(i)
    top = max(8, len(docs) // 2)
    for i, t in docs:
        sources = {holders[x][0] for x in lines[i] if x in holders and 1 < len(holders[x]) <= top and holders[x][0] < i}
        number = {x: k for k, x in enumerate(dict.fromkeys(x for s in [i, *sources] for x in lines[s]))}
        cut = {k for s in sources for k in linediff.common_blocks([number[x] for x in lines[s]], [number[x] for x in lines[i]], [len(x) for x in lines[i]], linediff.BLOCK_CHARS)}
        assert got[i] == ("\n".join(x for k, x in enumerate(lines[i]) if k not in cut), len(cut))


def test_line_blocks_of_scattered_lines(spark):
    """A block is found although each of its lines has an earlier holder of its own; against all earlier documents."""
    rnd = random.Random(6)
    one = ["".join(rnd.choice("abcdefgh ") for _ in range(59)) + "." for _ in range(5)]
    made = [(k + 1, x) for k, x in enumerate(one)] + [(6, "\n".join(one)), (7, "\n".join(one)), (8, "z\n" + "\n".join(one[1:4]) + "\n \ny")]
    pool = ["".join(rnd.choice("klmnop") for _ in range(rnd.choice([5, 30, 60]))) for _ in range(60)]
    for i in range(9, 60):
        at = rnd.randrange(50)
        made.append((i, "\n".join([f"own {i}", *pool[at : at + rnd.randrange(1, 6)], f"end {i}"])))
    got = {r.doc_id: (r.text, r.removed) for r in linediff.dedup_lines(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[7] == ("", 5)
    for k, (i, t) in enumerate(made):
        lines = t.split("\n")
        cut = set()
        for _, u in made[:k]:
            number = {x: n for n, x in enumerate(dict.fromkeys([*lines, *u.split("\n")]))}
            cut |= set(linediff.common_blocks([number[x] for x in u.split("\n")], [number[x] for x in lines], [len(x) for x in lines], linediff.BLOCK_CHARS))
        assert got[i] == ("\n".join(x for n, x in enumerate(lines) if n not in cut), len(cut))


def test_line_block_of_most_documents(spark):
    head = "\n".join(f"a header line of fifty characters that all share {k}" for k in range(2))
    docs = spark.createDataFrame([(i, f"{head}\nown {i}") for i in range(20)], "doc_id long, text string")
    assert {(r.doc_id, r.removed) for r in linediff.dedup_lines(docs).collect()} == {(i, 2 if i else 0) for i in range(20)}


def test_queries_and_pipeline(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "passages", "packing"]
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(f"op{n}" for n in range(1, 14))
    docs, columns = spark.read.parquet(f"{SMALL}/documents.parquet"), None
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == columns and docs.count() <= count
        count = docs.count()
    assert count > 100  # clean documents stay
    assert corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().count() == count
