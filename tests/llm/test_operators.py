"""Every operator against a plain version of its rule, on whole small tables and on the odd cases."""
import collections
import hashlib
import random
import re
import sys
import os
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fixtures as fx  # noqa: E402

from tagwarden.llm import (bpe_matrix, external_shuffle, language_id, length_buckets, phrase_fingerprint, pii_semicrf,  # noqa: E402
                           quality_rules, simhash_bk, toxicity_chain, warc_segments)
from tagwarden.llm.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with odd tables, and one with empty ones."""
    full, empty = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("empty")
    texts = fx.odd_texts()
    docs = fx.documents(spark, texts + texts[:3], ids=[*range(len(texts)), None, None, 5])
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (7, 1, 0), (9, 0, None), (None, 1, 1), (13, None, 0)],
                                   "doc_id long, quality int, toxic int")
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 40_000, "\r\n\r\nWARC/1.1\r\n", "<p>a</p>"]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(
        ["http://x/é ", None, "", "u", "u", "u", "u"], html))] + [(None, "n", "<p>a</p>"), (6, "u", "<p>a</p>")],
        "page_id long, url string, html string")
    embeddings = spark.createDataFrame(fx.odd_vectors(), "vec_id long, embedding array<float>, label int, rank int, anchor string")
    for name, df in (("documents", docs), ("labels", labels), ("pages", pages), ("embeddings", embeddings)):
        fx.save(df, full, name)
        fx.save(df.limit(0), empty, name)
    return str(full), str(empty)


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_and_empty_tables(spark, odd, name):
    full, empty = odd
    rows = QUERIES[name](spark, full).collect()
    table = "pages" if name.startswith("op7") else "documents"
    n = spark.read.parquet(f"{full}/{table}.parquet").count()
    if name != "op11_bond_scan":  # mined pairs, not a row a document
        assert len(rows) >= n if name.startswith("op1_") else len(rows) == n
    assert QUERIES[name](spark, empty).collect() == []


def test_pipeline_on_odd_and_empty_tables(spark, odd):
    import corpus_pipeline

    full, empty = odd
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{full}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, full)
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.run(spark, full).count() >= 1
    assert corpus_pipeline.run(spark, empty).collect() == []


# ---------------------------------------------------------------- 1
def test_boundaries_are_optimal():
    import itertools

    rng = random.Random(1)
    for _ in range(30):
        x = sorted(rng.sample(range(1, 40), rng.randint(1, 8)))
        n = [rng.randint(1, 9) for _ in x]
        k = rng.randint(1, 4)
        cost = lambda ends: sum(c * (min(e for e in ends if e >= v) - v) for v, c in zip(x, n))
        got = length_buckets.boundaries(x, n, k)
        best = min(cost((*c, x[-1])) for r in range(min(k, len(x))) for c in itertools.combinations(x[:-1], r))
        assert len(got) <= k and got[-1] == x[-1] and cost(got) == best


def test_packing_holds_every_token_within_the_budget(spark):
    rng = random.Random(2)
    n = {i: rng.choice([0, 1, 5, 17, 60, 900]) for i in range(300)}
    df = spark.createDataFrame(list(n.items()), "doc_id long, length long")
    rows = length_buckets.pack(df, max_tokens=64, buckets=3, budget=256).collect()
    tokens = collections.Counter()
    batches = collections.defaultdict(list)
    for r in rows:
        tokens[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket_tokens and r.padding == r.bucket_tokens - r.n_tokens
        batches[r.bucket, r.bucket_tokens, r.batch].append(r.slot)
    assert tokens == collections.Counter(n) or all(tokens[i] == v for i, v in n.items())
    for (_, size, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * size <= max(256, size)


# ---------------------------------------------------------------- 2
def test_language_mixture(spark):
    rng = random.Random(4)
    texts = [fx.sentence(rng, lg, 60) for lg in ("en", "de") for _ in range(60)]
    df = fx.documents(spark, texts, langs=["en"] * 60 + ["de"] * 60)
    model = language_id.learn(df)
    mixed = fx.sentence(rng, "en", 70) + " " + fx.sentence(rng, "de", 30)
    new = spark.createDataFrame([(0, fx.sentence(rng, "de", 30)), (1, mixed), (2, "123 !"), (3, None), (4, "Z")],
                                "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(new, model).collect()}
    assert got[0].lang_pred == "de" and got[0].score > 0.99 and set(got[0].mixture) == {"de"}
    assert got[1].lang_pred == "en" and 0.55 < got[1].mixture["en"] < 0.85 and got[1].mixture["de"] > 0.15
    assert (got[2].lang_pred, got[2].score) == (got[3].lang_pred, got[3].score) == ("und", 0.0)
    assert got[4].lang_pred in ("de", "en") and 0 <= got[4].score <= 1


def test_language_stage_without_labels_keeps_what_has_letters(spark, sf_dir):
    docs = fx.documents(spark, ["good words here", "été", "", None, "12 34", "日本"], langs=[None] * 6)
    got = [r.text for r in language_id.keep_known(spark, docs, sf_dir).collect()]
    assert sorted(got) == sorted(["good words here", "été", "日本", "日本"])


def test_language_stage_keeps_clean_mixtures(spark, sf_dir, monkeypatch):
    words = dict(fx.WORDS, fr="le la les des est dans pour avec maison rivière lettre matin gens eau histoire".split())
    monkeypatch.setattr(fx, "WORDS", words)
    rng = random.Random(8)
    say = lambda lg, n: fx.sentence(rng, lg, n)
    noise = " ".join("".join(rng.choice("qxzjkvwy") for _ in range(6)) for _ in range(200))
    even = " ".join(say(lg, 100) for lg in words)
    halves = say("en", 90) + " " + say("de", 80) + " " + say("fr", 40)
    texts = [say(lg, 60) for lg in words for _ in range(60)] + [even, halves, "42"]
    langs = [lg for lg in words for _ in range(60)] + [None] * 3
    docs = fx.documents(spark, texts, langs=langs)
    got = {r.text for r in language_id.keep_known(spark, docs, sf_dir).collect()}
    scores = {r.doc_id: r.score for r in language_id.predict(docs.select("doc_id", "text"), language_id._trained(docs)).collect()}
    assert scores[180] < language_id.MIN_SCORE and scores[181] < language_id.MIN_SCORE  # no language has half of the text
    assert got == set(texts[:-1])
    _, p = language_id._trained(docs)
    share = {}
    for t in (even, noise):
        at, n = np.unique(language_id.grams([t])[0], return_counts=True)
        share[t] = language_id.explained(p[at].astype(float), n.astype(float), np.full(3, 1 / 3))
    assert share[even] > 0.9 and share[noise] < 0.3


def test_em_raises_the_likelihood_and_finds_the_shares():
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(200) * 0.1, 3).T + 1e-6
    p /= p.sum(0)
    n = rng.multinomial(5000, p @ [0.6, 0.4, 0.0]).astype(float)
    w, value = language_id.em(p, n, np.full(3, 1 / 3))
    assert abs(w[0] - 0.6) < 0.05 and value >= n @ np.log(p @ np.full(3, 1 / 3))
    w, _ = language_id.infer(p, n)
    assert w[2] == 0 and abs(w.sum() - 1) < 1e-9


def test_language_query_is_right_on_held_out_documents(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op2_language_mixture"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


# ---------------------------------------------------------------- 3
def test_chain_uses_earlier_categories_out_of_fold():
    rng = np.random.default_rng(6)
    n = 400
    a = rng.random(n) < 0.4
    b = a & (rng.random(n) < 0.8)  # only texts of category a can be of category b
    docs = [np.array([1 if x else 2, 10 + int(rng.integers(50))], np.int32) for x in a]
    y = np.stack([a, b], axis=1).astype(float)
    y[:5, 1] = np.nan
    folds = np.arange(n) % toxicity_chain.FOLDS
    chain, oof = toxicity_chain.train_chain(docs, y, folds)
    assert ((oof[:, 0] > 0.5) == a).all() and len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0
    # a document's out-of-fold probability must not depend on its own label
    z = y.copy()
    z[0, 0] = 1 - z[0, 0]
    assert abs(toxicity_chain.train_chain(docs, z, folds)[1][0, 0] - oof[0, 0]) < 1e-6


def test_a_repeated_id_is_collected_once(spark, monkeypatch):
    texts = [f"good text number {i}" for i in range(30)] + [f"bad text copy {i % 3}" for i in range(300)] + [None, "x"]
    docs = fx.documents(spark, texts, ids=[*range(30), *[30] * 300, 30, None])
    labels = spark.createDataFrame([(i, 1, int(i == 30)) for i in range(31)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity_chain, "train_chain", lambda d, y, f: seen.append((d, y)) or (None, None))
    for n in (31, 8):
        toxicity_chain.learn(docs, labels, [("toxic", toxicity_chain.F.col("toxic"))], train_docs=n)
        got, y = seen.pop()
        assert len(got) == len(y) == n
    toxicity_chain.learn(docs.repartition(7), labels, [("toxic", toxicity_chain.F.col("toxic"))])
    first = seen.pop()[0]
    toxicity_chain.learn(docs.repartition(3), labels, [("toxic", toxicity_chain.F.col("toxic"))])
    assert [sorted(d) for d in first] == [sorted(d) for d in seen.pop()[0]]  # the same text each time


def test_toxic_documents_are_found(spark, sf_dir):
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").collect()} - toxic
    found = {r.doc_id for r in QUERIES["op3_toxicity_chain"](spark, sf_dir).collect() if r.toxic}
    assert len(found & toxic) >= 0.6 * len(toxic) and len(found & clean) <= 0.05 * len(clean)


# ---------------------------------------------------------------- 4
def test_equal_substrings_share_interior_phrases():
    rng = random.Random(7)
    body = fx.sentence(rng, "en", 400)
    a, b = phrase_fingerprint.sketches(["zq " + body, fx.sentence(rng, "de", 9) + " " + body])
    assert phrase_fingerprint.likeness(a, b) > 0.8
    # the result must not depend on what else is in the batch
    for t in ("", "a", "aaaa", "ab" * 9, body):
        alone = phrase_fingerprint.sketches([t])[0]
        assert np.array_equal(alone, phrase_fingerprint.sketches([body, t, "zz", t])[1])


def test_fingerprint_query_against_the_plain_order(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(docs, reverse=True)
    nxt = dict(zip(order, order[1:] + order[:1]))
    rows = QUERIES["op4_phrase_fingerprint"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by_text = {}
    for r in rows:
        t, u = docs[r.doc_id], docs[nxt[r.doc_id]]
        e = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        a, b, c = phrase_fingerprint.sketches([t, e, u])
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == phrase_fingerprint.text_of(a) and r.edited_fingerprint == phrase_fingerprint.text_of(b)
        assert (r.near_edited, r.near_next) == (phrase_fingerprint.likeness(a, b), phrase_fingerprint.likeness(a, c))
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint


# ---------------------------------------------------------------- 5
def test_bpe_is_what_tiktoken_does():
    import base64
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = [t or "" for t in fx.odd_texts()] + ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(500)) for _ in range(20)]
    c = bpe_matrix.codec(path, P.PATTERN)
    ids, starts = c.encode(texts)
    for i, t in enumerate(texts):
        own = ids[starts[i]:starts[i + 1]]
        assert own.tolist() == ref.encode_ordinary(t) and c.decode(own) == t.encode()
        assert c.decimals(own).decode() == ",".join(map(str, own))


# ---------------------------------------------------------------- 6
def _plain_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cov = {j for i in range(len(w) - 7) if win[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov))


def test_base_rules_against_a_plain_version(spark):
    rng = random.Random(9)
    texts = fx.odd_texts() + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)] + \
        ["\n".join(rng.choice(["x y", "x  y", " ", "#|z"]) for _ in range(20)) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.features(df).collect():
        assert tuple(r[c] for c in quality_rules.BASE) == _plain_rules(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_binomial_tail_is_exact(spark):
    from math import comb
    from pyspark.sql import functions as F

    cases = [(0, 10, 0.3), (3, 40, 0.2), (10, 2000, 0.01), (0, 5000, 0.005), (95, 10_000, 0.01), (5, 5, 0.5), (0, 0, 0.1)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    got = df.select("k", "n", "p", quality_rules.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect()
    for r in got:
        from fractions import Fraction
        p = Fraction(r.p)
        want = float(sum(comb(r.n, j) * p**j * (1 - p)**(r.n - j) for j in range(r.k + 1))) if r.k < r.n * r.p else 1.0
        assert r.t == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_the_promise_and_need_evidence(spark):
    rng = random.Random(10)
    rows = [(i, "many" if i < 6000 else "few", False, 0.0 if i % 10 else 0.3, 0.0, 0.0, 5.0, 0.0, i) for i in range(6100)]
    feats = spark.createDataFrame(rows, "doc_id long, s string, base_failed boolean, symbol_ratio double, "
                                        "dup_line_ratio double, repeat_ratio double, mean_word double, same_next_ratio double, _key long")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(6100)], "doc_id long, quality int, toxic int")
    cut = quality_rules.calibrate(feats, labels, "s").collect()
    assert [(r.stratum, r.rule, r.cutoff) for r in cut] == [("many", "symbol_ratio", 0.25)]
    # when good texts are hit as often, nothing is certified
    noisy = spark.createDataFrame([(i, rng.randint(0, 1), 0) for i in range(6100)], "doc_id long, quality int, toxic int")
    assert quality_rules.calibrate(feats, noisy, "s").collect() == []


# ---------------------------------------------------------------- 7
def test_archives_come_back(spark, tmp_path):
    rng = random.Random(11)
    html = ["".join(rng.choice("ab\r\né日") for _ in range(rng.choice([0, 3, 900, 60_000]))) for _ in range(40)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html + html[:9])],
                                  "page_id long, url string, html string")
    warc_segments.write_archives(pages, f"{tmp_path}/w", segment=1000)
    rows = warc_segments.read_archives(spark, f"{tmp_path}/w").collect()
    assert all(r.error is None for r in rows) and len(rows) == 49
    got = {int(r.id.split(":")[2]): r for r in rows if r.type == "response"}
    first = {}
    for i, h in enumerate(html + html[:9]):
        first.setdefault(h, i)
    assert {i: got[i].payload.decode() for i in got} == {i: h for h, i in first.items()}


def test_broken_segments_are_reported():
    recs = list(warc_segments.parse(b"\r\n\r\n".join(warc_segments.records(1, "u", b"x" * 5000, 1, None, None, 1000))))
    ok = lambda parts: warc_segments.reassembled(parts)
    assert ok(recs) == (b"x" * 5000, None)
    assert ok(recs[:2] + recs[3:])[1] and ok(recs[:-1])[1] and ok([recs[0], *recs])[1]
    assert ok([*recs[:-1], dict(recs[-1], total=7)])[1] == "total length differs"
    for bad in (b"zz\r\n", b"5\r\nabc", b"3\r\nabcX\r\n0\r\n\r\n", b"-1\r\n\r\n"):
        with pytest.raises(ValueError):
            warc_segments.unchunked(bad)
    assert warc_segments.unchunked(b"3;ext=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"


# ---------------------------------------------------------------- 8
def test_base_spans_are_those_of_the_plain_patterns():
    pats = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    rng = random.Random(12)
    for _ in range(3000):
        t = "".join(rng.choice("0123456789" * 3 + "..--@@+ ()ab\n%é") for _ in range(rng.randint(0, 70)))
        want = []
        for kind, p in pats:
            for m in re.finditer(p, t):
                d = re.sub(r"[^0-9]", "", m.group())
                if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or \
                        (kind == "card" and 13 <= len(d) <= 19 and pii_semicrf.luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                    want.append((kind, m.start(), m.end()))
        assert pii_semicrf.base_spans(t) == want, t


def test_decoding_is_the_best_segmentation():
    rng = np.random.default_rng(13)
    for t in ("call 212-555-0199 or (44) 20.7946", "a.b at c dot d x 12 34 5678 90", "+1 2 3456789"):
        r = pii_semicrf.Region(t, 0, len(t), [])
        w = rng.normal(size=(4, pii_semicrf.WIDTH))
        score = np.where(pii_semicrf._allowed(r), r.features @ w.T, -1e9).max(1)

        def best(i):  # plain recursion over all segmentations
            return 0.0 if i == r.n else max([best(i + 1)] + [score[s] + best(b) for s, (a, b) in enumerate(r.segments) if a == i])

        ends = {(r.spans[a][0], r.spans[b - 1][1]): score[s] for s, (a, b) in enumerate(r.segments)}
        assert sum(ends[a, b] for _, a, b in pii_semicrf.decode(r, w)) == pytest.approx(best(0))
        total, p = pii_semicrf._log_partition(r, np.where(pii_semicrf._allowed(r), r.features @ w.T, -1e9))
        assert np.isfinite(total) and (p >= 0).all() and (p <= 1 + 1e-9).all()


def test_added_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    w = pii_semicrf.learn(docs)
    find = lambda t: [(k, t[a:b]) for k, a, b in pii_semicrf.find(t, w)[1]]
    assert find("write to jo.doe [at] mail [dot] example [dot] com now") == [("email", "jo.doe [at] mail [dot] example [dot] com")]
    assert find("mail a.b@c.org") == [("email", "a.b@c.org")]
    for clean in ("on 2024-01-05 12:30:11 we met", "version 4.0 of 1999", "meet me at noon", "costs 1500000 in all"):
        assert find(clean) == []
    rows = pii_semicrf.spans(docs, w, redact=True).collect()
    for r in rows:
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
        assert not any(k == "email" for k, _, _ in pii_semicrf.base_spans(r.redacted or ""))


def test_short_defanged_addresses_are_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    w = pii_semicrf.learn(docs)
    far = "no other number stands anywhere near this address in the whole text"
    for ip in ("8[.]8[.]8[.]8", "10[.]0[.]0[.]1", "1(.)2(.)3(.)4", "192[.]168[.]1[.]10"):
        text = f"{far} {ip} {far}"
        assert [(k, text[a:b]) for k, a, b in pii_semicrf.find(text, w)[1]] == [("ip", ip)]
    for clean in ("it was in 1999 that we met", "room 4021 is free", "take version 1.2.3 of it"):
        assert pii_semicrf.find(clean, w)[1] == []


def test_worded_mail_in_any_case(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    w = pii_semicrf.learn(docs)
    for mail in ("jo [AT] mail.com", "jo(AT)mail(DOT)com", "jo AT mail DOT com", "jo at Mail dot com", "jo [at] mail.com"):
        text = f"please ask {mail} about it"
        assert [(k, text[a:b]) for k, a, b in pii_semicrf.find(text, w)[1]] == [("email", mail)]
    for clean in ("we met at noon. Then in 2004 it rained", "look at example.com for more", "AT NOON THE DOT WAS SEEN"):
        assert pii_semicrf.find(clean, w)[1] == []


def test_a_region_is_dropped_only_without_a_candidate():
    rng = random.Random(12)
    parts = ["1", "42", "[.]", "(.)", ".", "-", "/", "(", " ", "  ", "word ", "@", "2024", "é"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        whole = pii_semicrf.Region(t, 0, len(t), [])
        want = {(whole.spans[i][0], whole.spans[j - 1][1]) for (i, j), num in zip(whole.segments, whole.numeric) if num}
        got = set()
        for lo, hi in pii_semicrf.regions(t, []):
            r = pii_semicrf.Region(t, lo, hi, [])
            got |= {(r.spans[i][0], r.spans[j - 1][1]) for (i, j), num in zip(r.segments, r.numeric) if num}
        assert want <= got, t


# ---------------------------------------------------------------- 9
def _plain_fp(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    for t in fx.odd_texts() + ["one", "One two", "A b C", "ÀB c d", "a b c d a b c d"]:
        assert simhash_bk.fingerprint(t) == _plain_fp(t)


def _components(values, radius):
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("tree_nodes", [4096, 8])
def test_components_against_all_pairs(spark, tree_nodes, monkeypatch):
    monkeypatch.setattr(simhash_bk, "TREE_NODES", tree_nodes)
    monkeypatch.setattr(simhash_bk, "BATCH_TREE", 5)
    rng = random.Random(14)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # chains and clusters of near values, among them the top bit
        v = rng.choice(values)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            v ^= 1 << b
        values.append(v)
    rows = [(i, v - (1 << 64) if v >= 1 << 63 else v) for i, v in enumerate(values)]
    fps = spark.createDataFrame(rows, "doc_id long, fp long")
    links = simhash_bk.links(fps.select("fp").distinct(), tree_nodes=tree_nodes)
    assert links.count() < 10 * len(values)
    monkeypatch.setattr(simhash_bk, "links", lambda d, r=3: links)
    got = {r.fp: r.component_id for r in simhash_bk.near_duplicates(fps, "doc_id").collect()}
    want = _components(values, 3)
    assert [got[f] for _, f in rows] == want


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.v: r.root for r in simhash_bk.components(e).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 500, 501: 500}


def test_one_row_of_every_component_stays(spark, sf_dir):
    rng = random.Random(18)
    a, b, c, d = (fx.sentence(rng, k, 50) for k in ("en", "de", "en", "de"))
    rows = [(None, a), (None, b), (5, a), (7, c), (7, d), (7, c), (9, c), (None, d + " x"), (None, None), (2, "")]
    values = [_plain_fp(t) for _, t in rows]
    want = collections.defaultdict(list)
    for (i, t), v, k in zip(rows, values, _components(values, 3)):
        want[k].append((i is None, i or 0, v - (1 << 64) if v >= 1 << 63 else v, t))
    least = [min(g, key=lambda x: x[:3]) for g in want.values()]
    for part in (rows, [r for r in rows if r[0] != 7][1:3] + [(7, c)]):
        docs = spark.createDataFrame([(i, t, "k") for i, t in part], "doc_id long, text string, root string")
        got = [(r.doc_id, r.text) for r in simhash_bk.keep_one(spark, docs, sf_dir).collect()]
        if part is rows:
            assert sorted(got, key=repr) == sorted([(None if n else i, t) for n, i, _, t in least], key=repr)
        else:
            assert sorted(got, key=repr) == sorted(part, key=repr)


def test_bk_tree_search_is_exact():
    rng = random.Random(15)
    values = [rng.getrandbits(16) for _ in range(300)]
    tree = simhash_bk.BKTree()
    for v in values:
        tree.add(v)
    for q in [rng.getrandbits(16) for _ in range(50)]:
        want = {v for v in values if (v ^ q).bit_count() <= 3}
        assert {tree.values[i] for i in tree.near(q, 3)} == want
        many = {tree.values[n] for n, hit in tree.near_many(np.array([q], np.uint64), 3) if hit.size}
        assert many == want


# ---------------------------------------------------------------- 10
def test_shuffle_is_a_permutation_and_repeats(spark, tmp_path):
    docs = fx.documents(spark, fx.odd_texts() * 4)
    a = external_shuffle.shuffle_to_shards(docs, f"{tmp_path}/a", shards=5, bucket_bytes=2000)
    assert a.columns == ["row", "shard", "slot"]
    rows = a.collect()
    assert sorted(map(repr, (r.row for r in rows))) == sorted(map(repr, docs.collect()))
    per = collections.defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    b = external_shuffle.shuffle_to_shards(docs.repartition(7), f"{tmp_path}/b", shards=5, bucket_bytes=2000)
    assert sorted((r.shard, r.slot, repr(r.row)) for r in rows) == sorted((r.shard, r.slot, repr(r.row)) for r in b.collect())


def test_repeated_rows_spread(spark, tmp_path):
    rows = [(1, "same text", "x")] * 3000 + [(1, "same text", "y")] * 1500 + [(None, None, None)] * 1500 + \
        [(i, f"text {i}", "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4)
    out = external_shuffle.shuffle_to_shards(docs, f"{tmp_path}/a", shards=3, bucket_bytes=2000).collect()
    assert collections.Counter(tuple(r.row) for r in out) == collections.Counter(rows)
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(3) for k in range(3000)]
    hot = collections.Counter(r.shard for r in out if r.row.text == "same text")
    assert min(hot.values()) > 1300  # of 4500 in three shards
    again = external_shuffle.shuffle_to_shards(docs.repartition(7), f"{tmp_path}/b", shards=3, bucket_bytes=2000).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(16)
    seen = collections.Counter(tuple(external_shuffle.fisher_yates(3, rng)) for _ in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
