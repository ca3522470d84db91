"""Hard negatives, periodic runs and exact dedup against plain versions of their rules."""
import collections
import hashlib
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fixtures as fx  # noqa: E402

from tagwarden.llm import bond_negatives, extendible_dedup, periodic_runs  # noqa: E402


# ------------------------------------------------------------------ op11
def plain_negatives(rows):
    """The contract's rule by full comparison; rows of equal score and id are interchangeable."""
    ok = []
    for i, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(np.float32(x)) for x in v):
            continue
        q = [min(max(math.floor(256 * float(np.float32(x))), -bond_negatives.LIMIT), bond_negatives.LIMIT) for x in v]
        ok.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, q))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for at, (i, label, q) in enumerate(ok):
        if i is None or i % 100:
            continue
        scored = [(j, sum(a * b for a, b in zip(q, w)), lb == label) for k, (j, lb, w) in enumerate(ok) if k != at]
        for pid, ps, _ in sorted((r for r in scored if r[2]), key=order)[:5]:
            inside = [r for r in scored if not r[2] and 30 * ps <= 100 * r[1] <= 90 * ps]
            for rank, (nid, ns, _) in enumerate(sorted(inside, key=order)[:10], 1):
                out.append((i, pid, rank, nid, ps, ns))
    return collections.Counter(out)


def test_hard_negatives_on_odd_vectors(spark, tmp_path, monkeypatch):
    rows = fx.odd_vectors()
    folder = fx.save(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int, anchor string")
                     .repartition(5), tmp_path, "embeddings")
    want = plain_negatives(rows)
    assert len(want) > 100 and any(k[1] is None or k[3] is None for k in want)
    for least in (1 << 11, 40):  # one block, and many
        monkeypatch.setattr(bond_negatives, "LEAST_ROWS", least)
        assert collections.Counter(map(tuple, bond_negatives.op11_bond_scan(spark, folder).collect())) == want


def test_scan_drops_candidates_early_and_keeps_the_first():
    rng = np.random.default_rng(5)
    m = rng.integers(-50, 50, (64, 3000))
    m[:4] *= 40  # few dimensions decide
    a = m[:, 7].copy()
    exact = a @ m
    rows, score = bond_negatives.bond_scan(m, m.min(1), m.max(1), a, np.arange(3000), [(-10**9, 10**9)], 10)
    assert (score == exact[rows]).all() and len(rows) < 300
    assert set(np.sort(exact)[-10:]) <= set(score)
    low, high = int(np.quantile(exact, 0.7)), int(np.quantile(exact, 0.72))
    rows, score = bond_negatives.bond_scan(m, m.min(1), m.max(1), a, np.arange(3000), [(low, high)], 10)
    inside = np.sort(exact[(exact >= low) & (exact <= high)])[-10:]
    assert set(inside) <= set(score)


# ------------------------------------------------------------------ op12
def plain_runs(w, least=24, times=3):
    """Maximal stretches of every period, the smallest period of each stretch."""
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    seen = 0
    for _ in range(1500):
        n, k = rng.randint(0, 160), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n:
                a, p = rng.randrange(n), rng.randint(1, 40)
                z = min(n, a + rng.randint(10, 120))
                w[a:z] = [w[a:a + p][i % len(w[a:a + p])] for i in range(z - a)]
        want = plain_runs(w)
        seen += len(want)
        assert list(map(tuple, periodic_runs.find_runs(np.array(w, np.int64)).tolist())) == want
    assert seen > 400


def test_range_successor():
    rng = np.random.default_rng(2)
    v = rng.permutation(300)
    tree = periodic_runs.WaveletTree(v, 9)
    lo, hi = np.sort(rng.integers(0, 301, (2, 500)), axis=0)
    x = rng.integers(0, 301, 500)
    assert tree.below(lo, hi, x).tolist() == [int((v[a:b] < y).sum()) for a, b, y in zip(lo, hi, x)]
    some = np.flatnonzero(hi > lo)
    k = np.zeros(len(some), np.int64)
    assert tree.kth(lo[some], hi[some], k).tolist() == [int(v[a:b].min()) for a, b in zip(lo[some], hi[some])]


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = None
    for s, length, q in runs:  # exact: length / period by cross multiplication
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_query_is_the_plain_rule(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    texts = fx.odd_texts() + ["x " * 90, "a b " * 30 + "c " + "a b " * 30, "  a b\x1f " * 40]
    texts += [fx.sentence(rng, rng.choice(["en", "de"]), rng.randint(0, 300)) for _ in range(250)]
    df = fx.documents(spark, texts, ids=[None, *range(1, len(texts))])
    folder = fx.save(df.repartition(3), tmp_path, "documents")
    want = collections.Counter(plain_row(r.doc_id, r.text) for r in df.collect())
    assert sum(k[1] > 0 for k in want) > 10
    for size in (1 << 18, 500):
        monkeypatch.setattr(periodic_runs, "GROUP_WORDS", size)
        assert collections.Counter(map(tuple, periodic_runs.op12_periodic_runs(spark, folder).collect())) == want


def test_long_repeating_text():
    w = np.zeros(200_000, np.int64)
    assert periodic_runs.find_runs(w).tolist() == [[0, 200_000, 1]]
    w = np.arange(200_000) % 5_000
    assert periodic_runs.find_runs(w).tolist() == [[0, 200_000, 5_000]]


# ------------------------------------------------------------------ op13
@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 500}, {"bucket_bytes": 500, "max_depth": 4},
                                     {"bucket_bytes": 300, "key_bits": 3, "max_depth": 6}, {"key_bits": 1}])
def test_exact_groups(spark, options):
    """Split buckets, buckets that no split can shrink, and keys that collide, with a hot group and repeated ids."""
    rng = random.Random(1)
    rows = [(None if rng.random() < .05 else rng.randrange(300), None if rng.random() < .05 else
             " ".join(rng.choice("abc") for _ in range(rng.randrange(5)))) for _ in range(900)] + [(7, "hot" * 50)] * 400
    rows += [(i, t) for i, t in enumerate(fx.odd_texts())]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    out = extendible_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), **options).collect()
    assert collections.Counter((r.id, r.sha) for r in out) == collections.Counter((i, h) for h, ids in groups.items() for i in ids)
    for r in out:
        assert r.keep_id == max((i for i in groups[r.sha] if i is not None), default=None)
        assert r.group_size == len(groups[r.sha])
        assert not r.kept or r.id == r.keep_id
    assert collections.Counter(r.sha for r in out if r.kept) == collections.Counter(dict.fromkeys(groups, 1))


def test_directory_doubles_and_covers_every_key():
    sizes = {k: 10 for k in range(64)} | {5: 500}  # 6-bit keys, one of them hot
    loads = lambda bits, full: {p: sum(v for k, v in sizes.items() if k >> (6 - bits) == p) for p in range(1 << bits)}
    d = extendible_dedup.Directory(sum(sizes.values()))
    d.split(loads, 100, 6)
    slots = d.slots()
    assert d.depth == 6 and len(slots) == 64 and sum(b.load for b in d.buckets) == sum(sizes.values())
    assert all(slots[k] == next(i for i, b in enumerate(d.buckets) if k >> (6 - b.bits) == b.prefix) for k in range(64))
    assert [b.load for b in d.buckets if b.load > 100] == [500]  # only the hot key's own bucket stays overfull
    assert min(b.bits for b in d.buckets) < 6  # the others have not split that far
    assert (np.diff(d.owners(200)) >= 0).all()  # owners have neighbouring buckets


# ------------------------------------------------------------------ samples, trials and archives
def test_sample_holds_the_smallest_hashes_whatever_the_sizes_seem(spark, monkeypatch):
    """Sizes misjudged by far (as beyond 4e9 rows a share of millionths would be 0) change nothing; a hot row counts once."""
    from pyspark.sql import functions as F
    from tagwarden.llm import common

    rows = [(i, f"t{i}", "abc"[i % 3]) for i in range(900)] + [(7, "hot", "a")] * 2000 + [(None, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pick = lambda: sorted(map(str, common.smallest_hashes(df, "lang", ["doc_id", "text"], 20, "s").collect()))
    h = F.xxhash64(F.lit("s"), "doc_id", "text")
    ranked = collections.defaultdict(set)
    for r in df.select("*", h.alias("h")).collect():
        ranked[r.lang].add((r.h % 2 ** 64 // 2, r.doc_id, r.text))
    want = sorted(str(row) for row in df.distinct().collect()
                  if (row.doc_id, row.text) in {x[1:] for x in sorted(ranked[row.lang])[:20]})
    assert pick() == want and len(want) == 61
    monkeypatch.setattr(common.F, "approx_count_distinct", lambda c, e: F.lit(6 * 10 ** 12).cast("long") + F.count(c) * 0)
    assert pick() == want


def test_languages_and_spans_are_learned_beyond_4e9_rows(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F
    from tagwarden.llm import common, language_id, pii_semicrf

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(common.F, "approx_count_distinct", lambda c, e: F.lit(6 * 10 ** 12).cast("long") + F.count(c) * 0)
    langs, _ = language_id.learn(docs.select("doc_id", "text", "lang"), 50)
    assert langs == sorted(r.lang for r in docs.where("lang is not null").select("lang").distinct().collect())
    assert pii_semicrf.learn(docs, sample_docs=100) is not None


def _rule_rows(n, copies):
    """n good and n // 2 bad texts whose symbol ratio tells them apart, each ``copies`` times."""
    good = [(0.0, 1)] * n + [(0.3, 0)] * (n // 2)
    return [(k * copies + c, k, v, q) for k, (v, q) in enumerate(good) for c in range(copies)]


@pytest.mark.parametrize("n", [300, 1500])
def test_copies_prove_nothing(spark, n):
    from tagwarden.llm import quality_rules as Q

    got = []
    for copies in (1, 8):
        rows = _rule_rows(n, copies)
        feats = spark.createDataFrame([(i, "en", False, v, 0.0, 0.0, 5.0, 0.0, k) for i, k, v, _ in rows],
                                      "doc_id long, s string, base_failed boolean, symbol_ratio double, dup_line_ratio double, "
                                      "repeat_ratio double, mean_word double, same_next_ratio double, _key long")
        labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in rows], "doc_id long, quality int, toxic int")
        got.append([tuple(r) for r in Q.calibrate(feats, labels, "s").collect()])
    assert got[0] == got[1]
    assert [(r[1], r[3]) for r in got[0]] == ([] if n == 300 else [("symbol_ratio", n)])


def test_quality_query_with_copies_is_its_twin(spark, tmp_path):
    """On a table whose labels certify cutoffs, every text several times and once labelled against the others."""
    import duckdb
    from tagwarden.llm import quality_rules as Q

    rng = random.Random(6)
    texts = [fx.sentence(rng, "en", 25) for _ in range(1700)] + [fx.sentence(rng, "en", 25) + " ## $$ %% ** |" for _ in range(300)]
    rows = [(2 * i + c, t, "en") for i, t in enumerate(texts) for c in (0, 1)] + [(10 ** 6, None, None), (10 ** 6 + 1, "", "en")]
    labels = [(2 * i + c, int(i < 1700), 0) for i in range(2000) for c in (0, 1)]
    labels[0] = (0, 0, 0)
    fx.save(spark.createDataFrame(rows, "doc_id long, text string, lang string"), tmp_path, "documents")
    folder = fx.save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = sorted(map(tuple, Q.op6_quality_rules(spark, folder).collect()))
    assert got == sorted(con.sql(Q.oracle()).fetchall())
    assert sum(not r[-1] and not r[-2] for r in got) == 600  # the method's own rejections


def test_bad_archives_give_error_rows(spark, tmp_path):
    import gzip
    from tagwarden.llm import warc_segments as W

    recs = [b"".join(r + b"\r\n\r\n" for r in W.records(i, "u", b"payload %d " % i * 300, 1, None, None, 1000)) for i in range(6)]
    whole = W.records(9, "u", b"short", 1, None, None)[0] + b"\r\n\r\n"
    (tmp_path / "a").mkdir()
    put = lambda name, data: (tmp_path / "a" / name).write_bytes(data)
    put("padded", gzip.compress(recs[0]) + b"\0" * 700 + gzip.compress(recs[1]) + b"\0" * 5)
    put("cut", gzip.compress(recs[2]) + gzip.compress(recs[3])[:-20])
    put("damaged", gzip.compress(whole)[:-8] + b"\1" * 8)
    put("garbage", gzip.compress(recs[4]) + b"no gzip")
    bad = [whole.replace(b"Content-Length: ", b"Content-Length: x"), recs[5].replace(b"Segment-Number: 2", b"Segment-Number: two"),
           whole.replace(b"Content-Length: ", b"Content-Length: -"), whole]
    put("numbers", b"".join(bad))
    put("short", whole[:-9])
    put("empty", b"")
    rows = W.read_archives(spark, f"{tmp_path}/a").collect()
    ok = collections.Counter(bytes(r.payload) for r in rows if r.error is None)
    full = lambda i: b"payload %d " % i * 300
    assert all(ok[full(i)] == 1 for i in (0, 1, 2, 4)) and ok[b"short"] >= 1 and ok[full(5)] == 0
    errors = collections.Counter(r.error.split(":")[0].split("'")[0].strip() for r in rows if r.error)
    assert errors["gzip member cut short"] == 1 and errors["gzip member damaged"] == 2
    assert errors["malformed number"] == 3 and errors["record cut short"] >= 1
    assert errors["segment missing or repeated"] >= 1


# ------------------------------------------------------------------ ranges, order, whole signatures
def test_ranges_cut_a_hot_key_by_its_hash(spark):
    from pyspark.sql import functions as F
    from tagwarden.llm import common

    n = 6000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(777)).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    h = F.xxhash64("t")
    got = common.ranges(df, "k", 24, "cell", h).withColumn("h", h.bitwiseXOR(F.lit(-(1 << 63))))
    assert got.columns == ["k", "t", "cell", "h"]
    rows = got.collect()
    sizes = collections.Counter(r.cell for r in rows)
    assert len(rows) == n and max(sizes.values()) < 4 * n / 24 and len({r.cell for r in rows if r.k == 777}) >= 4
    order = sorted(rows, key=lambda r: (r.k, r.h))
    assert [r.cell for r in order] == sorted(r.cell for r in rows)  # cells follow (key, hash)
    assert {r.cell for r in common.ranges(df.limit(0), "k", 24, "cell", h).collect()} == set()
    big = spark.createDataFrame([(2 ** 62 + i % 3,) for i in range(50)], "k long")  # keys that one double stands for
    assert len({r.cell for r in common.ranges(big, "k", 8, "cell", F.xxhash64("k")).collect()}) == 1


def test_fingerprints_with_a_hot_and_a_null_id(spark):
    """Every row is answered once, against the row after it in the order (id downward, hash of the text downward, text)."""
    from pyspark.sql import functions as F
    from tagwarden.llm import phrase_fingerprint as P

    rng = random.Random(8)
    rows = [(5 if i % 3 == 0 else None if i % 3 == 1 else i, fx.sentence(rng, "en", rng.randint(0, 40))) for i in range(600)]
    rows += [(5, "same text")] * 50 + [(None, None), (10 ** 6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    h = {r.text: r.h % 2 ** 64 for r in spark.createDataFrame([(t or "",) for t in {t for _, t in rows}], "text string")
         .select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -h[r[1]], r[1]))
    want = collections.Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        e = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        want[i, hashlib.sha256(e.encode()).hexdigest(), len(t)] += 1
    got = P.fingerprint_next(df).collect()
    assert collections.Counter((r.doc_id, r.edited_sha256, r.n_chars) for r in got) == want


def plain_signature(text):
    """Locally consistent parsing of one text, name by name, with plain integers."""
    K = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB]
    M = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * K[1] & M
        x = (x ^ (x >> 27)) * K[2] & M
        return x ^ (x >> 31)

    def toss(seq):  # lowest bit in which a label differs from the one before, and its value
        out = []
        for a, b in zip(seq, [0, *seq]):
            d = a ^ b
            bit = (d & -d).bit_length() - 1 if d else 0
            out.append(2 * bit + (a >> bit & 1))
        return out

    names, level, found = [ord(c) + 1 for c in text], 0, set()
    while names:
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [mix((x + n * K[0]) & M) if n > 1 else x for x, n in runs]
        lab = toss(toss(toss(names)))
        phrases = []
        for i, x in enumerate(names):
            peak = 0 < i < len(names) - 1 and lab[i] > lab[i - 1] and lab[i] > lab[i + 1]
            if i == 0 or peak:
                phrases.append([])
            phrases[-1].append(x)
        names = [mix((sum(mix((x + (k + 1) * K[0]) & M) for k, x in enumerate(p)) + len(p)) & M) for p in phrases]
        level += 1
        if level >= 2 or len(names) == 1:
            found |= {x >> 32 for x in names}
        if len(names) == 1:
            return found
    return found


def test_signatures_are_those_of_a_plain_parse():
    from tagwarden.llm import phrase_fingerprint as P

    rng = random.Random(9)
    texts = ["", "a", "aa", "ab", "abcabcabc", "z" * 70, "é日😀" * 5] + [
        "".join(rng.choice("ab c") for _ in range(rng.randint(1, 200))) for _ in range(150)] + [fx.sentence(rng, "en", 300)]
    got = P.sketches(texts)
    for t, s in zip(texts, got):
        assert set(s.tolist()) == plain_signature(t), t[:40]
    errors = []
    for _ in range(200):  # the sketch's estimate against the whole signatures
        a = fx.sentence(rng, "en", 200)
        b = a[:rng.randint(0, len(a))] + fx.sentence(rng, "de", 60)
        x, y = P.sketches([a, b])
        errors.append(P.likeness(x, y, P.SKETCH) - P.likeness(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_packing_places_do_not_depend_on_the_partitioning(spark):
    from tagwarden.llm import external_shuffle, length_buckets

    rng = random.Random(12)
    rows = [(None if i % 5 == 0 else 3 if i % 2 else i, rng.choice([0, 3, 9, 30, 70, 700])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, length long")
    got = [collections.Counter(map(tuple, length_buckets.pack(df.repartition(k, *by), max_tokens=64, buckets=4, budget=256).collect()))
           for k, by in ((2, []), (7, ["doc_id"]), (5, ["length"]))]
    assert got[0] == got[1] == got[2] and sum(got[0].values()) >= 900


def test_shuffle_places_do_not_depend_on_the_partitioning(spark, tmp_path):
    from tagwarden.llm import external_shuffle

    rows = [(i % 40, f"t{i % 20}", f"src{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = []
    for n, d in enumerate((df.repartition(2), df.repartition(9, "source"))):
        out = external_shuffle.shuffle_to_shards(d, f"{tmp_path}/s{n}", bucket_bytes=4000)
        got.append(sorted((r.row.source, r.shard, r.slot) for r in out.collect()))
    assert got[0] == got[1]


@pytest.mark.parametrize("batch", [3, 50, 10_000])
def test_links_when_trees_run_over_batches(spark, batch):
    from tagwarden.llm import simhash_bk as S

    rng = random.Random(batch)
    fps = set()
    for _ in range(40):
        c = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(c)
            for _ in range(rng.randint(0, 3)):
                c ^= 1 << rng.randrange(64)
    fps |= {(0xABCD << 48) | rng.getrandbits(20) for _ in range(60)}  # a shard of many
    fps = sorted(fps)
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
        links = [(r.a % 2 ** 64, r.b % 2 ** 64) for r in S.links(df, tree_nodes=8).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    at = {x: i for i, x in enumerate(fps)}
    got = list(range(len(fps)))

    def root(i):
        while got[i] != i:
            i = got[i]
        return i

    for a, b in links:
        assert find(at[a]) == find(at[b])  # no link that is none
        got[root(at[a])] = root(at[b])
    assert len({root(i) for i in got}) == len({find(i) for i in up})


# ------------------------------------------------------------------ op8
@pytest.fixture(scope="module")
def pii_weights(spark):
    from tagwarden.llm import pii_semicrf as P

    return P.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0"))


def _mixed(rng, n):
    parts = ["(212) 555-0199", "jo [at] mail [dot] com", "4111/1111/1111/1111", "10[.]0[.]0[.]1", "1.2", "a@b", "call", "2024-01-02", "x", "7", "555"]
    out = []
    while sum(map(len, out)) < n:
        out += [rng.choice(parts), rng.choice([" ", " ", ",", ", ", "\n"])]
    return "".join(out)


def test_windows_decode_like_the_whole_region(pii_weights):
    from tagwarden.llm import pii_semicrf as P

    rng = random.Random(21)
    for n in (50, 400, 4000):
        for _ in range(6):
            t = _mixed(rng, n)
            blocked = [(3, 9)] if n == 400 else []
            want = P.decode(P.Region(t, 0, len(t), blocked), pii_weights)
            for window in (1, 16, 100, 2048):
                assert P.decode_windows(t, 0, len(t), blocked, pii_weights, window) == want


def test_a_long_table_of_numbers_takes_little_memory(pii_weights):
    import tracemalloc
    from tagwarden.llm import pii_semicrf as P

    rng = random.Random(22)
    t = " ".join(str(rng.randint(0, 999)) for _ in range(27_000))  # one region of 100 KB
    assert len(P.regions(t, [])) == 1
    tracemalloc.start()
    P.find(t, pii_weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20


def test_added_spans_on_held_out_rewritten_forms(spark, pii_weights):
    """Base spans of documents that were not learned from, written in other forms, and plain numbers in their places."""
    from tagwarden.llm import pii_semicrf as P

    rng = random.Random(23)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 1 and text is not null").collect()
    right = wrong = missed = clean = alarms = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        for kind, a, b in P.base_spans(r.text) * 6:
            other = P._rewritten(kind, r.text[a:b], rng)
            if other is not None and not P.base_spans(other):
                near, after = r.text[max(0, a - 200):a], r.text[b:b + 200]
                got = [s for s in P.find(near + other + after, pii_weights)[1] if s[1] < len(near) + len(other) and s[2] > len(near)]
                hit = (kind, len(near), len(near) + len(other)) in got
                right, missed, wrong = right + hit, missed + (not hit), wrong + len(got) - hit
            plain = P._plain(rng)
            if not P.base_spans(plain):
                near, after = r.text[max(0, a - 200):a], r.text[b:b + 200]
                if not any(s[1] < len(near) + len(plain) and s[2] > len(near) for s in P.base_spans(near + plain + after)):
                    clean += 1
                    alarms += any(s[1] < len(near) + len(plain) and s[2] > len(near) for s in P.find(near + plain + after, pii_weights)[1])
    print(f"recall {right / (right + missed):.3f} ({right + missed} forms), precision {right / (right + wrong + alarms):.3f}, "
          f"alarms {alarms} of {clean} plain numbers")
    assert right + missed > 50 and right / (right + missed) >= 0.9 and right / (right + wrong + alarms) >= 0.9


# ------------------------------------------------------------------ op7
def test_every_record_is_a_gzip_member(spark, tmp_path):
    import zlib as z
    from tagwarden.llm import warc_segments as W

    html = ["<p>%d</p>" % i * (i % 7 * 200) for i in range(60)] + [None, "\r\n\r\nWARC/1.1\r\n" * 30]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    W.write_archives(pages.repartition(3), f"{tmp_path}/w", segment=1000)
    members = 0
    for name in os.listdir(tmp_path / "w"):
        data = (tmp_path / "w" / name).read_bytes()
        while name.startswith("part-") and data:
            d = z.decompressobj(31)
            record = d.decompress(data)
            assert d.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            assert len(list(W.parse(record))) == 1  # a whole record, read at its offset
            data, members = d.unused_data, members + 1
    back = W.read_archives(spark, f"{tmp_path}/w").collect()
    assert members > 100 and not [r for r in back if r.error]
    assert collections.Counter(bytes(r.payload).decode() for r in back if r.type == "response") == collections.Counter({h or "" for h in html})


def test_a_stream_of_any_steps_is_parsed_alike():
    from tagwarden.llm import warc_segments as W

    rng = random.Random(31)
    data = b"junk" + b"\r\n\r\n".join(r for i in range(9) for r in W.records(i, "u", b"x%d" % i * 200, 1, None, None, 300)) + b"\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\nabc"
    want = list(W.parse(data))
    assert want[-1]["error"] == "record cut short" and len(want) > 9
    for _ in range(30):
        cuts = sorted(rng.sample(range(len(data)), 40))
        assert list(W.parse_stream(iter([data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]))) == want


def test_a_hot_repeated_page(spark, tmp_path, monkeypatch):
    from tagwarden.llm import warc_segments as W

    monkeypatch.setattr(W, "RUN", 10)
    rows = [(3, "a", "<p>x</p>")] * 70 + [(3, "b", "<p>x</p>")] * 5 + [(3, None, "<p>x</p>"), (1, "c", "<p>x</p>"), (3, "a", "other"), (None, None, None), (None, None, None)]
    fx.save(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), tmp_path, "pages")
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in W.op7_warc_segments(spark, str(tmp_path)).collect())
    assert got == collections.Counter({(1, 8, "response", None): 1, (3, 8, "revisit", 1): 76, (3, 5, "response", None): 1,
                                       (None, 0, "response", None): 1, (None, 0, "revisit", None): 1})
