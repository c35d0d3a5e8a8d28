"""The training-data operators against brute force, exact round trips and hand-made cases."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import blocks, encode, groups, leakage, near_dup, pairs, pii, splitting, vectors

SF = "/root/testdata/sf0.001"
TOKENS = re.compile("[a-z0-9]+")


def grams(text, n):
    t = TOKENS.findall(text.lower())
    return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}, len(t)


def edited(rng, words, share):
    return [rng.choice(["alpha", "beta", "gamma", str(rng.randint(0, 999))]) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def similar_texts():
    rng = random.Random(5)
    rows = []
    for family in range(40):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 160))]
        for copy in range(5):
            rows.append((f"{family}-{copy}", " ".join(edited(rng, base, 0.04 * copy))))
    return rows + [("dup", rows[0][1]), ("short", "a b c"), ("blank", ""), ("null", None), (None, rows[0][1])]


def jaccard_pairs(rows, n, threshold, least):
    sets = {k: grams(t, n) for k, t in rows if k is not None and t is not None}
    sets = {k: s for k, (s, count) in sets.items() if count >= least}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_similar_pairs_against_all_pairs(spark, similar_texts):
    rows = spark.createDataFrame(similar_texts, "k string, text string").withColumn("class", F.lit("extra"))
    got = {tuple(r) for r in near_dup.similar_pairs(rows.unionByName(rows.limit(9)), "k", "text", 3, 0.6, 20).collect()}
    want = jaccard_pairs(similar_texts, 3, 0.6, 20)
    assert got <= want and len(got) >= 0.98 * len(want)
    assert near_dup.similar_pairs(rows.limit(0), "k", "text", 3, 0.6, 20).count() == 0


def test_groups_against_union_find(spark, similar_texts):
    rows = spark.createDataFrame(similar_texts, "k string, text string")
    found = {tuple(r) for r in near_dup.similar_pairs(rows, "k", "text", 3, 0.6, 20).collect()}
    root = {k: k for k, t in similar_texts if k and t and grams(t, 3)[1] >= 20}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in sorted(found):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: (r.group_id, r.links) for r in groups.similar_groups(rows, "k", "text", 3, 0.6, 20).collect()}
    assert got == {k: (find(k), sum(k in p for p in found)) for k in root}
    assert groups.similar_groups(rows.limit(0), "k", "text", 3, 0.6, 20).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    with pytest.raises(RuntimeError):
        groups.components(chain, 2)
    assert {tuple(r) for r in groups.components(chain).collect()} == {(i, 0) for i in range(101)} | {(500, 500), (501, 500)}


def test_hot_buckets_are_split_and_whole(spark, similar_texts):
    rows = spark.createDataFrame(similar_texts, "k string, text string")
    wide = {tuple(r)[:2] for r in near_dup.similar_classes(rows, "text", 3, 0.6, 20).collect()}
    small = {tuple(r)[:2] for r in near_dup.similar_classes(rows, "text", 3, 0.6, 20, block=2).collect()}
    assert wide == small


def test_hot_keys_are_split_before_the_shuffle(spark):
    rows = spark.createDataFrame([(7, i) for i in range(3000)] + [(100 + i // 2, 5000 + i) for i in range(1000)] + [(None, 1)], "key long, id long").repartition(5)
    hot = {r.hot: r.n for r in blocks.hot_keys(rows, "key").collect()}
    assert hot == {7: 3000} and blocks.hot_keys(rows.limit(0), "key").count() == 0
    units = blocks.bucket_units(rows, "key", "id", 500).collect()
    sizes = {}
    for r in units:
        sizes[r.key, r.u, r.v] = sizes.get((r.key, r.u, r.v), 0) + 1
    assert len([k for k in sizes if k[0] == 7]) == 21 and max(sizes.values()) < 1300 and len(sizes) == 521
    pairs_ = near_dup.copies(rows.select(F.col("key").alias("class"), "id").filter("class IS NOT NULL"), 500)
    assert pairs_.count() == pairs_.distinct().count() == 3000 * 2999 // 2 + 500
    links = spark.createDataFrame([(7, 100), (100, 101)], "class_a long, class_b long")
    across = near_dup.linked_members(links, rows.select(F.col("key").alias("class"), "id").filter("class IS NOT NULL"), 500)
    assert across.count() == across.distinct().count() == 3000 * 2 + 4


def test_trie_join_against_all_pairs():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 65536, (60, 8)).astype(np.uint16)
    words[30:] = words[:30] ^ (rng.random((30, 8)) < 0.4).astype(np.uint16)
    words[5] = words[4]
    group = np.sort(rng.integers(0, 3, 60))
    order = np.lexsort((*words.T[::-1], group))
    g, w = group[order], words[order]
    i, j = near_dup.trie_self_join(g, w, 12)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if g[a] == g[b] and np.bitwise_count(w[a] ^ w[b]).sum() <= 12}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_trie_walk_in_bounded_steps():
    rng = np.random.default_rng(3)
    words = np.repeat(rng.integers(0, 65536, (1, 8)), 2000, 0).astype(np.uint16) ^ np.packbits(rng.random((2000, 128)) < 0.12, axis=1).view(np.uint16)
    group = np.repeat([0, 1], [900, 1100])
    words = words[np.lexsort((*words.T[::-1], group))]
    differ = np.bitwise_count(words[:, None] ^ words[None]).sum(2, dtype=np.int64)
    tracemalloc.start()
    parts = list(near_dup.trie_walk(group, words, 25, step=5000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = [p for i, j in parts for p in zip(i.tolist(), j.tolist())]
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(differ <= 25, 1))) if group[a] == group[b]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100_000
    assert max(len(i) for i, _ in parts) <= 5000 and peak < 20e6  # all pairs of children at once: 100 MB
    across = [(int(a), int(b)) for i, j in near_dup.trie_walk(group, words, 25, (np.array([0]), np.array([1])), 5000) for a, b in zip(i, j)]
    assert sorted(across) == [(a, b) for a, b in zip(*np.nonzero(differ[:900, 900:] <= 25)) for b in [b + 900]]
    assert sum(len(i) for i, _ in near_dup.trie_walk(group[:0], words[:0], 25)) == 0


def test_portions_and_class_pairs():
    assert list(near_dup.portions(np.array([3, 3, 9, 1, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 6)] and list(near_dup.portions(np.zeros(0, int), 6)) == []
    parts = [(np.array([0, 1]), np.array([2, 0])), (np.array([2, 1]), np.array([0, 2]))]
    got = [b.to_pylist() for b in near_dup.class_pairs(iter(parts), np.array([30, -10, 20]), 3)]
    assert got == [[{"class_a": -10, "class_b": 20}, {"class_a": -10, "class_b": 30}, {"class_a": 20, "class_b": 30}]]


def test_ragged_pairs():
    got = {(int(a), int(b)) for i, j in blocks.ragged_pairs(np.array([0, 3, 4]), np.array([3, 4, 7]), 2) for a, b in zip(i, j)}
    assert got == {(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (5, 6)}


def test_nearest_vectors_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64))
    near = [base[i] + rng.normal(size=64) * 0.25 for i in range(300) for _ in range(3)]
    matrix = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(matrix)]
    rows += [(5000, matrix[0].tolist()), (5001, (matrix[0] * 3).tolist()), (6000, None), (6001, [0.0] * 64), (6002, [float("nan")] * 64), (6003, [1.0] * 63), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("class", F.lit(1))
    got = {(r.id, r.other) for r in vectors.nearest_vectors(df.unionByName(df.limit(20)), k=5, min_similarity=0.85).collect()}
    unit = np.concatenate([matrix, matrix[:1], matrix[:1]]).astype(float)
    ids = np.array([*range(len(matrix)), 5000, 5001])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -1)
    want = set()
    for i in range(len(ids)):
        for j in np.lexsort((ids, -score[i].round(4)))[:5]:
            if score[i, j] >= 0.85:
                want.add((int(ids[i]), int(ids[j])))
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(want)
    assert {(0, 5000), (0, 5001), (5000, 0), (5001, 0), (5000, 5001)} <= got
    assert vectors.nearest_vectors(df.limit(0)).count() == 0
    assert vectors.nearest_vectors(df.filter("vec_id IN (0, 5000)")).count() == 2
    split = {(r.id, r.other) for r in vectors.nearest_vectors(df, k=5, min_similarity=0.85, block=3).collect()}
    assert len(split & want) >= 0.9 * len(want)


def test_nearest_vectors_in_a_dense_group(spark):
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=64) + rng.normal(size=(700, 64)) * 0.05  # closer together than 8 bits tell
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -1)
    want = {(i, int(j)) for i in range(700) for j in np.argsort(-score[i])[:10]}
    # four pivots, so that nearly all pairs share a file and only the choice inside the files counts
    got = {(r.id, r.other) for r in vectors.nearest_vectors(df, k=10, min_similarity=0.85, pivots=4).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.995 * len(want)


def test_neighbours_of_every_vector(spark):
    from quarrylight.llm.queries import p1_neighbours
    from quarrylight.plans.retrieval import dense_topk

    got = {}
    for r in p1_neighbours(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour_id))
    want = {}
    for r in dense_topk(spark, "/root/testdata/sf0.01").collect():
        want.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    usable = spark.read.parquet("/root/testdata/sf0.01/chunk_vectors.parquet").filter("vec_id IS NOT NULL AND size(embedding) = 64 AND NOT exists(embedding, x -> x IS NULL OR isnan(x)) AND exists(embedding, x -> x <> 0)")
    assert set(got) == {r.vec_id for r in usable.select("vec_id").distinct().collect()} and {len(x) for x in got.values()} == {10}
    assert len(want) > 5 and {q: sorted(x) for q, x in want.items()} == {q: sorted(got[q]) for q in want}
    rows = spark.read.parquet("/root/testdata/sf0.01/chunk_vectors.parquet")
    rounds = {(r.id, r["rank"], r.other) for r in vectors.nearest_vectors(rows, k=10, exhaustive=True, size=300).collect()}
    assert rounds == {(q, *p) for q, x in got.items() for p in x}


@pytest.fixture(scope="module")
def profile(spark):
    return pairs.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_profile(spark, profile):
    assert profile.languages == ("de", "en", "es", "fr") and {"the", "of", "der", "de"} <= profile.open_words and "million" not in profile.open_words
    rows = spark.createDataFrame([(1, None, "en"), (2, "x y", None), (None, "a b", "en")], "doc_id long, text string, lang string")
    assert pairs.learn(rows) == pairs.Profile() == pairs.learn(rows.limit(0))


def test_defects(profile):
    q = "What was the FY2019 net income of Acme, in USD millions?"
    cases = [
        (None, "5", "empty"), (" \n", "5", "empty"), ("```\n```", "5", "empty"), ("<think>hm</think>", "5", "empty"), ("Answer:", "5", "empty"), ("[1]", "5", "empty"),
        ("I'm sorry, but I cannot answer this.", "5", "refusal"), ("The filing does not disclose this figure.", "5", "refusal"),
        ("The filing does not disclose this figure.", "Not disclosed in the 2019 filing.", None), ("I cannot answer this question.", None, None),
        (q.upper(), "5", "copied_question"), (f"Question: {q} {q}", "5", "copied_question"), (f"You asked: {q} Net income was 5 million dollars at Acme.", "5", None),
        ("Die Umsatzerlöse der Sparte stiegen im Geschäftsjahr wegen höherer Preise auf 5 Mio. EUR.", "5", "other_language"),
        ("Net income fell because of the", "5", "truncated"), ("Net income rose to (", "5", "truncated"), ("Net income rose, see\n- ", "5", "truncated"), ("```python\nx = 1", "5", "truncated"),
        ("5.2%", "5", None), ("Yes", "5", None), ("(1,234)", "5", None), ("- Revenue: $5\n- Debt: $6 million", "5", None), ("It was 5. The counterparty is Acme Works", "5", None),
        ("Net income was 5. [1, 3]", "5", None),
        ("Thank you for asking. I have read the filing carefully. I'm sorry, but I cannot answer this question.", "5", "refusal"),
        (" ".join([q] * 5), "5", "copied_question"), (" ".join([q] * 300), "5", "copied_question"), ("Der Umsatz stieg stark an.", "5", "other_language"),
        ("The filing does not disclose this. " * 12, "5", "refusal"), ("Net income was 5. It rose by 2. The filing does not contain a table on it, but the notes do.", "5", None),
        ("1. Net income rose.\n2.", "5", "truncated"), ("2.0 percent", "5", None), ("Istenpath Partners", "5", None),
    ]
    assert [(a, pairs.defect_of(q, a, g, profile)) for a, g, _ in cases] == [(a, d) for a, _, d in cases]
    assert pairs.defect_of(None, "Fine answer.", None, profile) is None and pairs.defect_of("q w e r?", "株主 株主 株主", "5", pairs.Profile()) == "other_language"


def test_defective_pairs_frame(spark):
    rows = spark.createDataFrame([(1, " ANSWER\t", "q?", None, "5"), (1, " ANSWER\t", "q?", None, "5"), (2, "abstain", "q?", None, "5"), (3, None, "q?", None, "5"), (None, "answer", "q?", None, "5")], "sample_id long, status string, question string, predicted_answer string, gold_answer string")
    assert [tuple(r) for r in pairs.defective_pairs(rows, pairs.Profile()).collect()] == [(1, "empty")]
    assert pairs.defective_pairs(rows.limit(0), pairs.Profile()).count() == 0


def test_splitting_rules(spark):
    rng = random.Random(1)
    texts = ["x" * 5000, "word " * 900, "a" * 1250 + " b", "", None, "😀" * 1300, "Sentence one. " * 50 + "\n\n" + "Other, words; here. " * 90]
    texts += ["".join(rng.choice(["aa ", "bbbb", ". ", "\n", "\n\n", "é", ", ", "\t"]) for _ in range(rng.randint(10, 900))) for _ in range(60)]
    rows = spark.createDataFrame([(f"c{i}", f"d{i % 3}", t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, text string").withColumn("size", F.lit(3))
    log = spark.createDataFrame([("d0", "complete", 90, 20, 1.0), ("d0", "failed", 10, 2, 9.0), ("d1", "complete", 50, 50, 2.0), ("d1", "complete", 60, 0, 1.0), ("d1", "complete", None, 1, 3.0)], "doc_id string, status string, chunk_size int, chunk_overlap int, updated_at double")
    sizes = {"d0": (90, 20), "d1": (60, 0), "d2": (1200, 150)}
    got = {r.key: r for r in splitting.split_oversized(rows.unionByName(rows.limit(3)), log).collect()}
    expected = {f"c{i}" for i, t in enumerate(texts) if t is not None and len(t) > sizes[f"d{i % 3}"][0]}
    assert set(got) == expected
    for key, r in got.items():
        i = int(key[1:])
        text, (size, overlap), end = texts[i], sizes[f"d{i % 3}"], 0
        for p in r.pieces:
            assert text[p.start : p.start + len(p.piece)] == p.piece and len(p.piece) <= size and end - overlap <= p.start <= end
            end = p.start + len(p.piece)
        assert end == len(text)
        assert any(p.forced for p in r.pieces) == any(len(w) > size for w in re.split("[ \t\n\r]", text))
    assert splitting.split_oversized(rows.limit(0), log.limit(0)).count() == 0


def test_encoding_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{encode.FOLDER}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    texts = ["", None, " ", "<|endoftext|> isn't it?", "naïve 株主 👩‍🔬 \r\n\t\x00 end  ", "a" * 700, " \n \n" * 200 + "x", "word  two\n\n three's 123 " * 60]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kw in ({}, {"chunk": 64, "overlap": 16}, {"chunk": 100, "overlap": 90}):
        got = {r.id: r.ids for r in encode.encode(rows, **kw).collect()}
        assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = {r.id: bytes(r.bytes).decode() for r in encode.decode(encode.encode(rows), "id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode.encode(rows.limit(0)).count() == 0


def test_suffix_array_and_index():
    rng = np.random.default_rng(0)
    for n, v in ((1, 2), (60, 3), (300, 2), (500, 6)):
        text = np.append(rng.integers(1, v + 1, n), 0)
        assert leakage.suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        index = leakage.FMIndex.from_bytes(leakage.FMIndex.of(text, v + 1).to_bytes())
        phrases = rng.integers(1, v + 1, (40, 4))
        hit, low, high = index.search(phrases)
        which, at = index.locate(low, high)
        got = sorted((int(hit[w]), int(a)) for w, a in zip(which, at))
        assert got == sorted((p, i) for p in range(40) for i in range(n - 3) if text[i : i + 4].tolist() == phrases[p].tolist())


def test_suffix_array_of_many_symbols():
    rng = np.random.default_rng(1)
    for v in (70_000, 2**33):  # three symbols to the first key, and one
        text = np.append(rng.integers(1, v, 300), 0)
        text[100:200] = text[:100]
        assert leakage.suffix_array(text).tolist() == sorted(range(301), key=lambda i: text[i:].tolist())


def test_leaks_with_a_large_vocabulary(spark):
    """More distinct test tokens than 16 bits hold, phrases in several blocks over one index, one long document."""
    words = [f"x{i}" for i in range(80_000)]
    corpus = spark.createDataFrame([(1, " ".join(words[:40_000])), (2, " ".join(words[50_000:50_012])), (3, " ".join(words[50_000:50_011]))], "doc_id long, text string")
    tests = spark.createDataFrame([(f"f{i}", " ".join(words[i : i + 1000])) for i in range(0, 80_000, 1000)], "fid string, question string")
    spans = leakage.leaks(corpus, tests, "doc_id", "text", "fid", [F.array("question")], 12, shard=9_000, max_phrases=30_000).collect()
    assert {tuple(r) for r in spans} == {(1, f"f{i}", i, i + 999) for i in range(0, 40_000, 1000)} | {(2, "f50000", 0, 11)}


def test_leaks_against_a_scan(spark):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(50)]
    tests = [(f"f{i}", " ".join(rng.choices(words, k=20)), [" ".join(rng.choices(words, k=rng.randint(5, 40))), None]) for i in range(30)] + [("n", None, None)]
    corpus = []
    for i in range(80):
        t = rng.choices(words, k=rng.randint(0, 60))
        source = rng.choice(tests[:30])[2][0].split()
        corpus.append((i, " ".join(t + source[: rng.randint(0, 40)] + t).upper()))
    corpus += [(900, None), (901, ""), (None, tests[0][1])]
    c = spark.createDataFrame(corpus, "doc_id long, text string")
    t = spark.createDataFrame(tests, "fid string, question string, evidence array<string>")
    args = (c, t, "doc_id", "text", "fid", [F.array("question"), F.col("evidence")], 6)
    want = set()
    for i, text in corpus:
        have = {tuple(x) for x in [TOKENS.findall((text or "").lower())[k : k + 6] for k in range(2000)] if len(x) == 6}
        for fid, question, evidence in tests:
            for part in [question, *(evidence or [])]:
                p = TOKENS.findall((part or "").lower())
                if i is not None and any(tuple(p[k : k + 6]) in have for k in range(len(p) - 5)):
                    want.add((i, fid))
    spans = leakage.leaks(*args).collect()
    assert {(r.id, r.test) for r in spans} == want and all(r.last_token - r.first_token >= 5 for r in spans)
    again = leakage.leaks(*args, shard=40, max_phrases=100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, spans))
    assert leakage.leaks(c.limit(0), *args[1:]).count() == 0 and leakage.leaks(c, t.limit(0), *args[2:]).count() == 0


def test_identifiers():
    text = (
        "Write to jonas.w+x@mail.acme.example, JO at acme dot test or b (at) c (dot) example. Call +44 7700 900117, (599) 555-0133, 0044 7700 900184, 6515550121 or "
        "1 (243) 555-0108 ext. 24. SSN: 966443584, 901-43-5973, NI number QQ 58 49 54 D, passport no. X74359990, DNI 00826926B, Steuer-ID 00 293 246 103, driver's licence C202-7734-4867. "
        "Live at Flat 11, 131 Kelvik Road, 209 boulevard du Quorvane, Calle Kelmont 18, Yarwynstr. 91 or 771 W. Fenmont St. "
        "Invoice 2018-035-42820 of 2019-08-26, order 152873177, CUSIP 49000AB57, file 001-82693, company 12-8705586, P.O. Box 98385, Room 12, hours 9.00-17.30, $5,145.9 and @handle."
    )
    got = [(k, text[s:e]) for s, e, k in pii.identifiers(text)]
    assert [v for k, v in got if k == "email"] == ["jonas.w+x@mail.acme.example", "JO at acme dot test", "b (at) c (dot) example"]
    assert [v for k, v in got if k == "phone"] == ["+44 7700 900117", "(599) 555-0133", "0044 7700 900184", "6515550121", "1 (243) 555-0108 ext. 24"]
    assert [v for k, v in got if k == "id_number"] == ["966443584", "901-43-5973", "QQ 58 49 54 D", "X74359990", "00826926B", "00 293 246 103", "C202-7734-4867"]
    assert [v for k, v in got if k == "address"] == ["Flat 11, 131 Kelvik Road", "209 boulevard du Quorvane", "Calle Kelmont 18", "Yarwynstr. 91", "771 W. Fenmont St"]


def test_identifiers_of_any_length():
    local = "a" * 900 + ".b"
    text = f"Write to {local}@acme.test, 12 Martin Luther King Jr Boulevard, 5 Old Mill Creek Farm Road, Unter den Linden 5, 10117 Berlin or Am Alten Markt 7, 14467 Potsdam."
    found = [(k, text[s:e]) for s, e, k in pii.identifiers(text)]
    assert found == [("email", f"{local}@acme.test"), ("address", "12 Martin Luther King Jr Boulevard"), ("address", "5 Old Mill Creek Farm Road"), ("address", "Unter den Linden 5"), ("address", "Am Alten Markt 7")]
    assert [text[s:e] for text in [f"Mr. {'A' + 'a' * 60} {'B' + 'b' * 60} left."] for s, e, *_ in pii.mentions(text, [])] == ["A" + "a" * 60 + " B" + "b" * 60]
    for long_ in ("A" * 200_000, "Aa-" * 70_000, "Abc " * 50_000, "12 " + "Abc " * 50_000, "a" * 200_000 + "@", "1" * 200_000, "x@" * 60_000):
        pii.mentions(long_, pii.identifiers(long_))


def test_mail_addresses_in_words():
    texts = ["jo at acme.test", "jonas dot w at acme dot test", "JO AT acme Dot test", "jonas {dot} w (at) acme.test", " dot ".join("abcdefghijklmnopqr") + " at acme dot test"]
    for t in texts:
        text = f"({t}) and so on"
        assert [text[s:e] for s, e in pii.mail_addresses(text)] == [t]
    assert pii.mail_addresses("Filings dot the site, available at www.acme.test. We met at home. Then") == []


def test_names_and_redaction(spark):
    given, family = ["Anna", "Bert", "Carla"], ["Quimby", "Rostova", "Sanders"]
    rows, n = [], 0
    for g in given:
        for f in family:
            rows += [(n, f"Today Mr. {g} {f} spoke at Green Bay."), (n + 1, f"Then {f}, {g} wrote to {g.lower()}.{f.lower()}@x.example from Green Works."), (n + 2, f"{g[0]}. {f} and {g.upper()} {f.upper()} left Green Bay.")]
            n += 3
    rows += [(n, None), (n + 1, ""), (None, "Mr. Anna Quimby"), (n + 2, "Green Bay and Green Works grew. " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("x"))
    spans = pii.personal_spans(df).collect()
    texts = dict(rows)
    names = {(r.id, texts[r.id][r.start : r.end]) for r in spans if r.kind == "name"}
    want = set()
    for i, g in enumerate(given):
        for j, f in enumerate(family):
            b = 3 * (3 * i + j)
            want |= {(b, f"{g} {f}"), (b + 1, f"{f}, {g}"), (b + 2, f"{g[0]}. {f}"), (b + 2, f"{g.upper()} {f.upper()}")}
    assert names == want
    clean = {r.id: r.text for r in pii.redact(df.filter("doc_id IS NOT NULL")).collect()}
    assert clean[0] == "Today Mr. [NAME] spoke at Green Bay." and clean[1] == "Then [NAME] wrote to [EMAIL] from Green Works."
    assert clean[n] is None and clean[n + 1] == "" and clean[n + 2] == texts[n + 2]
    assert pii.personal_spans(df.limit(0)).count() == 0


def test_names_in_a_list(spark):
    given, family = ["Anna", "Bert", "Carla"], ["Quimby", "Rostova", "Sanders"]
    rows = [(i, f"Today Mr. {g} {f} spoke, then {f}, {g} left.") for i, (g, f) in enumerate((g, f) for g in given for f in family)]
    text = "Signed by Anna Quimby, Carla Sanders, Bert Rostova and others."
    rows += [(50, "Green Bay and Green Works grew. " * 50)]
    df = spark.createDataFrame([*rows, (100, text), (100, text)], "doc_id long, text string")
    spans = [r for r in pii.personal_spans(df).collect() if r.id == 100]
    assert {text[r.start : r.end] for r in spans} == {"Anna Quimby", "Carla Sanders", "Bert Rostova"}
    clean = {r.id: r.text for r in pii.redact(df.dropDuplicates()).collect()}
    assert clean[100] == "Signed by [NAME], [NAME], [NAME] and others."


def test_queries_run_on_the_smallest_tables(spark):
    from quarrylight.llm.queries import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, SF).count() > 0, name
