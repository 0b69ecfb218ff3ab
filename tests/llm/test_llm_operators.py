import hashlib
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
import helpers as H  # noqa: E402

from driftlens.llm import bpe, chat, decontam, fmindex, quality, queries, sharding, simhash, tokenfile, toxicity, urlrules  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def docs(spark):
    return spark.read.parquet(f"{H.SF}/documents.parquet")


# 1: SimHash.


def simhash_wanted(pairs):
    fps = [H.fingerprint(t) for _, t in pairs]
    roots = H.linked(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, (d, _) in zip(roots, pairs):
        known = least.get(r)
        least[r] = d if known is None else known if d is None else min(known, d)
    return sorted(((d, f"{f:016x}", least[r]) for r, f, (d, _) in zip(roots, fps, pairs)), key=str)


def test_simhash(spark):
    for df in (docs(spark), H.odd(spark, fp="z", FP=1, component_id=3)):
        assert H.rows(simhash.judged(df), "doc_id", "fingerprint", "component_id") == simhash_wanted(H.pairs(df))
    assert simhash.judged(H.empty(spark)).count() == 0


def test_hot_shards_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    r = np.random.default_rng(3)
    centre = int(r.integers(1 << 62))
    near = {centre ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 5)), replace=False)) for _ in range(150)}
    fps = sorted(simhash.signed(x) for x in near | {int(x) for x in r.integers(0, 1 << 62, 100)})
    links = simhash.linked(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = dict(map(tuple, simhash.components(links).collect()))
    roots = H.linked(fps, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    assert [got.get(x, x) for x in fps] == [fps[k] for k in roots]


def chained():
    """Links of three chains of 1,000 nodes in random order, and the smallest node of each node's chain."""
    nodes = np.random.default_rng(5).permutation(3000).reshape(3, 1000)
    return [(int(a), int(b)) for row in nodes for a, b in zip(row, row[1:], strict=False)], {int(x): int(row.min()) for row in nodes for x in row if x != row.min()}


def test_chains_take_few_tasks(spark):
    links, want = chained()
    df = spark.createDataFrame(links, "a long, b long").repartition(8)
    tracker = spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("chains", "components of chains")
    try:
        got = dict(map(tuple, simhash.components(df).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {k for j in tracker.getJobIdsForGroup("chains") for k in tracker.getJobInfo(j).stageIds}
    tasks = sum(x.numTasks for k in stages if (x := tracker.getStageInfo(k)))
    assert got == want and tasks < 60, tasks


def test_graphs_of_many_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 40)
    links, want = chained()
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links[k : k + 9], strict=True)], names=["a", "b"]) for k in range(0, len(links), 9)]
    stars = [(a, b) for x in simhash.contracted(iter(batches)) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
    assert all(a > b for a, b in stars) and len(stars) > len({a for a, _ in stars}) > 1000
    got = dict(map(tuple, simhash.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == want
    got = dict(map(tuple, simhash.components(spark.createDataFrame(stars, "a long, b long")).collect()))
    assert got == want


def test_hot_fingerprints_are_named(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 3)
    monkeypatch.setattr(simhash, "MOST_HOT", 2)
    df = H.odd(spark).unionByName(H.odd(spark)).unionByName(spark.createDataFrame([(k, "one text of many", "x") for k in range(50, 90)], H.SCHEMA))
    assert H.rows(simhash.judged(df), "doc_id", "fingerprint", "component_id") == simhash_wanted(H.pairs(df))


def test_bk_tree():
    r = np.random.default_rng(1)
    values = [int(x) for x in r.integers(0, 1 << 16, 300)]
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.near(q, 3)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def jaccard_groups(pairs, n=5):
    sets = []
    for _, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    return H.linked(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0)


@pytest.mark.parametrize("shard,block", [(1024, 512), (2, 3)])
def test_near_duplicates(spark, monkeypatch, shard, block):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "BLOCK", block)
    pairs = sorted(H.pairs(docs(spark)))
    kept = {r["doc_id"] for r in simhash.one_of_each(docs(spark)).collect()}
    assert kept == {pairs[k][0] for k in set(jaccard_groups(pairs))}


def test_near_duplicates_of_odd_rows(spark):
    got = simhash.one_of_each(H.odd(spark, row=1, TEXT="t"))
    assert got.columns == ["doc_id", "text", "source", "row", "TEXT"]
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "4", "5", "6", "8", "None"]
    assert simhash.one_of_each(H.empty(spark)).count() == 0


def test_near_copies_with_a_repeated_line(spark):
    made = []
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(204)]
        line = [f"l{k}x{i}" for i in range(10)]
        made += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + 10 * line))]
    assert len(set(jaccard_groups(made))) == 20
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == list(range(0, 40, 2))


def test_one_shared_value_is_enough_in_hot_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 4)
    monkeypatch.setattr(simhash, "SKETCH", 1)
    words = " ".join(f"w{i}" for i in range(300))
    made = [(k, f"{words} end{k}") for k in range(30)]
    smallest = {min(h for got in simhash.shingles(t.encode(), simhash.NEAR_WORDS) for h in got) for _, t in made}
    assert len(smallest) == 1 and len(set(jaccard_groups(made))) == 1
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.one_of_each(df).collect()] == [0]


@pytest.mark.parametrize("shard,block,shingles", [(8, 16, 1 << 20), (20, 300, 3000)])
def test_large_groups_are_exact(spark, monkeypatch, shard, block, shingles):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", shingles)
    r = np.random.default_rng(12)
    fresh = lambda n: [f"w{k}" for k in r.integers(0, 1 << 40, n)]
    common, families, made = fresh(40), [fresh(120) for _ in range(5)], []
    for k in range(220):
        words = list(families[k % 5])
        for _ in range(int(r.integers(0, 5))):
            at_ = int(r.integers(len(words)))
            words[at_ : at_ + int(r.integers(0, 4))] = fresh(int(r.integers(0, 6)))
        made.append((k, " ".join(words + common) if k % 3 else " ".join(fresh(int(r.integers(1, 60))) + common)))
    groups = jaccard_groups(made)
    assert 20 < len(set(groups)) < 200
    got = simhash.near_duplicates(spark.createDataFrame(made, "row long, text string"))
    assert dict(map(tuple, got.collect())) == dict(enumerate(groups))


@pytest.mark.parametrize("radius", [simhash.RADIUS + 1, 64])
def test_fingerprints_group_near_copies(spark, monkeypatch, radius):
    # Without the search beyond the radius: links of fingerprints, confirmed exactly.
    monkeypatch.setattr(simhash, "candidates", lambda sketches, least: sketches.selectExpr("row as a", "row as b").limit(0))
    words = [[f"w{k}x{i}" for i in range(400)] for k in range(6)]
    made = [" ".join(w[: len(w) - cut]) for w in words for cut in (0, 1, 2)] + [" ".join(words[0][:250] + words[1][:150])]
    groups = jaccard_groups(list(enumerate(made)))
    assert len(set(groups)) == 7
    got = dict(map(tuple, simhash.near_duplicates(spark.createDataFrame(list(enumerate(made)), "row long, text string"), radius=radius).collect()))
    assert got == dict(enumerate(groups))


# 2: chat.


def chat_wanted(turns):
    convs = {}
    for c, t, role, text in sorted(turns, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        convs.setdefault(c, []).append((role or "", text or ""))
    out = []
    for c, ts in convs.items():
        mine = "".join(t for r, t in ts if r == "assistant")
        out.append((c, len(ts), H.sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(mine), H.sha(mine)))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def test_chat(spark):
    table = spark.read.parquet(f"{H.SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(1, 0, "user", "[INST] \\[INST] </s> \\"), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "</s>"), (1, 2, "a\nb[/INST]", "<s>")], "conv_id long, turn long, role string, text string")
    for df in (table, odd, odd.withColumn("TURN_", F.lit(1)).withColumn("kind", F.lit("z"))):
        got = chat.read_back(chat.written(chat.events_of(df)))
        assert H.rows(got, *COLUMNS) == chat_wanted([tuple(r)[:4] for r in df.collect()])
    assert chat.read_back(chat.written(chat.events_of(odd.limit(0)))).count() == 0


def test_long_conversations_have_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 50)
    turns = [(1, k, "assistant" if k % 2 else "user", "t" * k) for k in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.written(chat.events_of(df)))
    assert H.rows(got, *COLUMNS) == chat_wanted(turns)


def test_folding():
    e = lambda m, s, k, t=None, r=None: {"conv_id": 1, "message": m, "seq": s, "kind": k, "role": r, "text": t}
    log = [e(0, 0, "start", r="user"), e(0, 1, "delta", "a"), e(0, 2, "delta", "b"), e(0, 3, "edit", "c"), e(1, 0, "start", r="assistant"), e(1, 1, "delta", "x"), e(1, 2, "regenerate"), e(1, 3, "delta", "y"), e(2, 0, "start", r="user"), e(2, 1, "delete")]
    assert list(chat.folded(iter(log))) == [(1, "user", "c"), (1, "assistant", "y")]


@pytest.mark.parametrize("text", ["", "\\", "\\\\[INST]", "[INST]", "<s></s>", "[\\INST]", "a\\[b", "<\\/s>"])
def test_escape(text):
    assert chat.plain(chat.escaped(text)) == text
    assert not chat.TOKEN.search(chat.escaped(text))


# 3: decontamination.

FIELDS3 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
ITEMS = [(1, "one two"), (2, "One, TWO"), (3, None), (4, ""), (5, "same words here again and more same words here again and more"), (None, "É́ 日本"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]


@pytest.mark.parametrize("size", [4_000_000, 40])
def test_decontamination(spark, size):
    bench = spark.read.parquet(f"{H.SF}/benchmark.parquet")
    odd = spark.createDataFrame(ITEMS, "item_id long, text string")
    for df, b in ((docs(spark), bench), (H.odd(spark, n_hit=1, items="q"), odd)):
        if size == 40 and b is bench:
            continue
        got = decontam.judged(df, b, block_bytes=size)
        assert H.rows(got, *FIELDS3) == sorted(H.contaminated(H.pairs(df), [tuple(r)[:2] for r in b.collect()]), key=str)
    assert decontam.judged(H.empty(spark), odd).count() == 0
    assert decontam.judged(H.odd(spark), odd.limit(0)).where("contaminated").count() == 0


def test_hits_are_places_of_the_original(spark):
    item = spark.createDataFrame([(1, "é b")], "item_id long, text string")
    row = decontam.judged(spark.createDataFrame([(1, "日x, É! é--B z")], "doc_id long, text string"), item).first()
    assert [tuple(h) for h in row["hits"]] == [(7, 11)]
    got = decontam.clean(H.odd(spark, hits=1, ITEMS=2), spark.createDataFrame([(1, "one two")], "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "source", "hits", "ITEMS"] and got.count() == len(H.ODD) - 1


# 4: quality.


def quality_wanted(pairs):
    out = []
    for d, t in pairs:
        t = t or ""
        w = H.words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        repeat = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if H.words(x)]
        out.append((d, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)))
    return sorted(out, key=str)


def test_quality(spark):
    for df in (docs(spark), H.odd(spark, n_words="z", TEXT="other", kept=1)):
        got = quality.judged(df)
        assert H.rows(got, "doc_id", *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], "base_failed") == quality_wanted(H.pairs(df))
    assert quality.judged(H.empty(spark)).count() == 0
    kept = quality.filtered(H.odd(spark, n_words="z", TEXT="other"))
    assert kept.columns == ["doc_id", "text", "source", "n_words", "TEXT"]


def test_quality_keeps_good_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    x = quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    good, bad = x.where("quality = 1"), x.where("quality = 0")
    assert good.where("kept").count() == good.count()
    assert bad.where("not kept").count() > 0.6 * bad.count()


# 5: token files.


@pytest.mark.parametrize("segment,block", [(500_000, 512), (100, 7)])
def test_token_files(spark, monkeypatch, segment, block):
    monkeypatch.setattr(tokenfile, "SEGMENT", segment)
    monkeypatch.setattr(tokenfile, "BLOCK", block)
    lib = Tokenizer.from_file(BYTE)
    for df in (docs(spark), H.odd(spark, ids="z", START=1)):
        pairs = sorted(H.pairs(df), key=lambda p: (p[0] is not None, p[0] or 0))
        start, want = 0, []
        for d, t in pairs:
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
            want.append((d, start, len(ids), H.crc(ids)))
            start += len(ids)
        got = tokenfile.round_trip(df, BYTE).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c"))
        assert H.rows(got, "doc_id", "start", "n_tokens", "c") == sorted(want, key=str)
    assert tokenfile.round_trip(H.empty(spark), BYTE).count() == 0


def test_huffman():
    r = np.random.default_rng(5)
    for counts in ([5], [0, 3, 0], [1, 1], [1 << k for k in range(30)], r.integers(0, 1000, 5000).tolist()):
        counts = np.array(counts, np.int64)
        bits = tokenfile.code_lengths(counts)
        used = bits[bits > 0]
        assert bits.max() <= 16 and (2.0**-used).sum() <= 1 and ((bits > 0) == (counts > 0)).all()
        ids = np.repeat(np.flatnonzero(counts), np.minimum(counts[counts > 0], 40))
        r.shuffle(ids)
        data, offsets = tokenfile.pack(ids, tokenfile.canonical(bits), bits)
        assert (tokenfile.Table(bits).unpack(data, offsets, len(ids)) == ids).all()


# 6: urls.


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?y"), (4, "http://net"), (5, "http://net/"), (6, "http://x.org/fr/1#a"), (7, "http://example.com/de/"), (8, "http://notexample.com/de/"), (9, "x://a?b://c.net/"), (None, "http://q.net/z"), (5, "http://net/")]
    x = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("z")).withColumn("HOST", F.lit(1))
    got = {(r["page_id"], r["host"], r["path"], r["rule"]) for r in urlrules.judged(x).collect()}
    assert got == {(1, "", "", None), (2, "", "", None), (3, "a.example.net", "/en/x", "example.net/en/"), (4, "net", "", None), (5, "net", "/", "net/"), (6, "x.org", "/fr/1", "org/fr/"), (7, "example.com", "/de/", "example.com/de/"), (8, "notexample.com", "/de/", None), (9, "a", "", None), (None, "q.net", "/z", "net/")}
    assert urlrules.judged(x.limit(0)).count() == 0


def test_mining_matches_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    urls = urlrules.given(pages.select("page_id", "url")).withColumn("tokens", urlrules.tokens())
    index = [(set(r["tokens"]), r["verdict"], r["confidence"], tuple(r["tokens"])) for r in urlrules.mined(urls.where("rule_verdict is not null").select("tokens", F.col("rule_verdict").alias("verdict"))).collect()]
    labelled = [(set(r["tokens"]), r["rule_verdict"]) for r in urls.where("rule_verdict is not null").collect()]
    for own, said, confidence, _ in index:
        fit = [v for t, v in labelled if own <= t]
        assert len(fit) >= 0.01 * len(labelled) and abs(fit.count(said) / len(fit) - confidence) < 1e-9 and confidence >= 0.9
    got = {r["page_id"]: r["verdict"] for r in urlrules.judged(pages).collect()}
    for r in urls.collect():
        met = [(c, len(t), k, v) for t, v, c, k in index if t <= set(r["tokens"])]
        assert got[r["page_id"]] == (r["rule_verdict"] or (max(met)[3] if met else "allow"))


# 7: substrings.

FIELDS7 = ("doc_id", "n_words", "n_removed", "kept_sha256")


def passages(spark):
    r = np.random.default_rng(11)
    vocabulary = [f"v{k}" for k in range(300)]
    some = lambda n: [vocabulary[k] for k in r.integers(0, 300, n)]
    shared = [some(60) for _ in range(3)]
    rows = []
    for d in range(60):
        a, b = int(r.integers(0, 20)), int(r.integers(34, 60))
        rows.append((d, " ".join(some(int(r.integers(0, 50))) + shared[d % 3][a:b] + some(int(r.integers(0, 50))))))
    rows += [(100, "z " * 80), (101, " ".join(shared[0] + shared[0])), (102, " ".join(some(34)))]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("shard", [5000, 3])
def test_substrings(spark, shard):
    for df in (docs(spark), H.odd(spark, k1="z", SPANS=1), passages(spark)):
        got = fmindex.judged(df, shard=shard)
        assert H.rows(got, *FIELDS7) == sorted(H.substring(H.pairs(df), 35), key=str)
    assert fmindex.judged(H.empty(spark)).count() == 0


def test_cut_texts(spark):
    x = spark.createDataFrame([(1, "a  b\nq r s t u\tz"), (2, "  q r s t u v"), (3, None)], "doc_id long, text string").withColumn("k1", F.lit("c"))
    got = fmindex.without_repeats(x, window=5, parts=(2, 5))
    assert got.columns == ["doc_id", "text", "k1"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "a  b\nz", 2: "  v", 3: None}


def test_index_counts():
    r = np.random.default_rng(2)
    seqs = [r.integers(1, 5, int(r.integers(1, 40))) for _ in range(30)]
    index = fmindex.FmIndex(np.concatenate(seqs), np.array([len(s) for s in seqs]), np.ones(30, np.int64), 64)
    for n in (1, 2, 3, 5):
        seen = Counter(tuple(s[k : k + n]) for s in seqs for k in range(len(s) - n + 1))
        for pattern, count in list(seen.items())[:60]:
            lo, hi = np.zeros(1, np.int64), np.array([index.n])
            for c in reversed(pattern):
                lo, hi = index.back(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == count


def test_a_passage_in_many_documents(spark):
    r = np.random.default_rng(3)
    passage, line = [f"p{k}" for k in range(60)], [f"l{k}" for k in range(20)]
    some = lambda n: [f"x{k}" for k in r.integers(0, 1 << 40, n)]
    # Shared as it is by half of the documents, at other cuts by some; the others share a line in contexts of their own.
    made = [(d, " ".join(some(9) + (passage if d % 4 == 0 else passage[d % 20 : 40 + d % 21] if d % 4 == 2 else line) + some(30))) for d in range(6000)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert H.rows(fmindex.judged(df, shard=200), *FIELDS7) == sorted(H.substring(made, 35), key=str)


def test_matching_statistics():
    r = np.random.default_rng(8)
    for _ in range(40):
        seqs = [r.integers(1, int(r.integers(2, 6)), int(r.integers(1, 40))) for _ in range(int(r.integers(1, 25)))]
        weights = r.integers(1, 3, len(seqs))
        flat, sizes = np.concatenate(seqs), np.array([len(s) for s in seqs])
        seen = Counter()
        for s, w in zip(seqs, weights.tolist()):
            for n in range(1, len(s) + 1):
                for k in range(len(s) - n + 1):
                    seen[tuple(s[k : k + n])] += w
        for window in (1, 2, 5):
            got = {}
            for k, lo, hi in zip(*(x.tolist() for x in fmindex.FmIndex(flat, sizes, weights, 41).repeated(flat, sizes, window))):
                assert seen[tuple(seqs[k][lo:hi])] > 1 and (not lo or seen[tuple(seqs[k][lo - 1 : hi])] == 1)
                got.setdefault(k, set()).update(range(lo, hi))
            for k, s in enumerate(seqs):
                want = {p for x in range(len(s) - window + 1) if seen[tuple(s[x : x + window])] > 1 for p in range(x, x + window)}
                assert got.get(k, set()) == want


# 8: BPE.


def test_bpe(spark):
    lib = Tokenizer.from_file(WORD)
    for df in (docs(spark), H.odd(spark, ids="z", DECODED=1)):
        want = []
        for d, t in H.pairs(df):
            ids = lib.encode(t or "", add_special_tokens=False).ids
            want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), H.sha(lib.decode(ids, skip_special_tokens=False))))
        got = bpe.encoded(df, WORD, keep=["doc_id"]).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("i"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("t"))
        assert H.rows(got, "doc_id", "n_tokens", "i", "t") == sorted(want, key=str)
    assert bpe.encoded(H.empty(spark), WORD).count() == 0


def test_bpe_on_random_strings():
    lib, own = Tokenizer.from_file(WORD), bpe.Bpe(Path(WORD).read_text())
    r = np.random.default_rng(9)
    letters = list("abcdefgh XYZ'!?.,#- 019\té ßñ日本ǅİ\u0301\x00\x1f~") + ["'ll", "<|endoftext|>", "the ", "ing"]
    texts = ["".join(letters[k] for k in r.integers(0, len(letters), int(r.integers(0, 30)))) for _ in range(1500)]
    for t, (ids, text) in zip(texts, own.encode(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and text == lib.decode(want, skip_special_tokens=False) == own.decode(want)


def test_encoders_forget(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 40)
    monkeypatch.setattr(bpe, "MOST_WORDS", 40)
    monkeypatch.setattr(tokenfile, "MOST_PIECES", 40)
    monkeypatch.setattr(tokenfile, "MOST_WORDS", 40)
    own, byte = bpe.Bpe(Path(WORD).read_text()), tokenfile.Ids(Path(BYTE).read_text())
    word_lib, byte_lib = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    r = np.random.default_rng(6)
    marks = ["", ".", "!!", "'s", "'", ",\n", "\n", "\n\n", " ", "  ", "\v", "\x85", "12", "ÄÉ", "İ", "J\u030c", "日"]
    for _ in range(30):
        words = ["".join(chr(97 + int(c)) for c in r.integers(0, 5, int(r.integers(0, 6)))) for _ in range(60)]
        texts = [" ".join(w + marks[int(r.integers(len(marks)))] for w in words[k : k + 6]) for k in range(0, 60, 6)] + ["", None, "<|endoftext|> a"]
        for t, (ids, text), raw in zip(texts, own.encode(texts), byte.encode(pa.array(texts)).to_pylist(), strict=True):
            want = word_lib.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and text == word_lib.decode(want, skip_special_tokens=False)
            assert np.frombuffer(raw, byte.type).tolist() == byte_lib.encode(t or "", add_special_tokens=False).ids
    assert all(len(x.keys) <= 40 for x in (own.pieces, own.letters, byte.pieces, byte.words))


# 9: shards.


@pytest.mark.parametrize("part_bytes", [1 << 29, 2000])
def test_shards(spark, part_bytes):
    for df in (docs(spark), H.odd(spark, size="z", SHARD=1, slot=2)):
        rows = sharding.sharded(df, 8, part_bytes).select("doc_id", "text", "shard", *(["size_in"] if "size" in df.columns else [])).collect()
        got = sharding.sharded(df, 8, part_bytes).collect()
        assert len(rows) == len(got) == df.count()
        sizes = Counter()
        slots = {}
        for r in got:
            own = r.asDict()
            assert own["size"] == len((own["text"] or "").encode()) + 16 and 0 <= own["shard"] < 8
            sizes[own["shard"]] += own["size"]
            slots.setdefault(own["shard"], []).append(own["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        largest = max(r.asDict()["size"] for r in got)
        assert all(abs(sizes[k] - sum(sizes.values()) / 8) <= 2 * largest for k in range(8))
    assert sharding.sharded(H.empty(spark), 8).count() == 0


@pytest.mark.parametrize("part_bytes,counters", [(1 << 29, 1 << 21), (900, 1 << 21), (900, 64)])
def test_shards_by_brute_force(spark, monkeypatch, part_bytes, counters):
    monkeypatch.setattr(sharding, "COUNTERS", counters)
    df = docs(spark).select("doc_id", "text").unionByName(H.odd(spark).select("doc_id", "text"))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = sharding.sharded(df, 6, part_bytes).select("shard", "slot", "size", key.alias("h"), F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("i")).collect()
    rows.sort(key=lambda r: (r["h"], r["i"], r["shard"], r["slot"]))
    total, below, near = sum(r["size"] for r in rows), 0, max(r["size"] for r in rows)
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    for k in range(6):
        own = [r for r in rows if r["shard"] == k]
        order = [(r["h"], r["i"]) for r in sorted(own, key=lambda r: r["slot"])]
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and order == sorted(order)
        below += sum(r["size"] for r in own)
        assert abs(below - total * (k + 1) / 6) <= near


def test_a_hot_group_is_cut(spark):
    x = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy " * 20).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    sizes = [r["s"] for r in sharding.sharded(x, 10).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 250


# 10: toxicity.


def test_toxicity(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    x = toxicity.judged(d, labels).join(labels, "doc_id").toPandas()
    held = x[x.held_out]
    right, wrong = held.score[held.toxic == 1].to_numpy(), held.score[held.toxic == 0].to_numpy()
    assert (right[:, None] > wrong[None]).mean() > 0.93
    assert held.predicted[held.toxic == 1].mean() > 0.75 and held.predicted[held.toxic == 0].mean() < 0.04
    assert (x.predicted == (x.score >= 0.3)).all() and x.score.between(0, 1).all()


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(k, k % 2, 1 if k > 4 else 0) for k in range(1, 9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.judged(H.odd(spark, score="z", LABEL=1), labels)
    assert got.count() == len(H.ODD) and got.where("score is null or predicted is null or held_out is null").isEmpty()
    assert toxicity.judged(H.odd(spark), labels.limit(0)).where("predicted = 1").isEmpty()
    assert toxicity.judged(H.empty(spark), labels).count() == 0


def test_pooling_in_pieces(monkeypatch):
    model = toxicity.Model.fresh()
    words = np.random.default_rng(4).integers(0, 1 << 32, 1000, dtype=np.uint32)
    whole = toxicity.pooled(words, model.tables())
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert np.allclose(whole, toxicity.pooled(words, model.tables()))


# All queries.


def test_all_queries_run(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
