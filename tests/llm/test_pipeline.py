"""The corpus pipeline, stage by stage, against plain versions over the whole smallest table."""
import os
import re
import sys

import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from tiktoken.load import load_tiktoken_bpe

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import _components, _plain_fp  # noqa: E402

import corpus_pipeline  # noqa: E402
from tagwarden.llm import language_id, length_buckets, pii_semicrf, quality_rules  # noqa: E402


def test_every_stage_against_a_plain_version(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    # 1: the verdicts of the SQL twin
    one_df = stage["quality_rules"](spark, docs, sf_dir).checkpoint()
    one, before = rows(one_df), rows(docs)
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.oracle()}) WHERE kept").fetchall()}
    assert set(one) == kept and all(one[i] == before[i] for i in one)

    # 2: each text alone, through the model learned from the stage's input
    two_df = stage["language_id"](spark, one_df, sf_dir).checkpoint()
    two = rows(two_df)
    langs, p = language_id._trained(one_df)
    known = set()
    for i, r in one.items():
        cells, _, has = language_id.grams([r.text])
        if has[0] and cells.size:
            at, n = np.unique(cells, return_counts=True)
            w, post = language_id.infer(p[at].astype(float), n.astype(float))
            k = int(w.argmax())
            if w[k] * (post[k] if w[k] >= 1 else 1.0) >= language_id.MIN_SCORE:
                known.add(i)
    assert set(two) == known and all(two[i] == one[i] for i in two)

    # 3: all pairs of fingerprints
    three_df = stage["simhash_near_dedup"](spark, two_df, sf_dir).checkpoint()
    three = rows(three_df)
    ids = sorted(two)
    comp = _components([_plain_fp(two[i].text) for i in ids], 3)
    assert set(three) == {ids[c] for c in comp} and all(three[i] == two[i] for i in three)

    # 4: every span replaced, everything else untouched
    four_df = stage["pii"](spark, three_df, sf_dir).checkpoint()
    four = rows(four_df)
    weights = pii_semicrf.learn(three_df)
    assert set(four) == set(three)
    for i, r in three.items():
        text, done = "", 0
        for kind, a, b in sorted(pii_semicrf.find(r.text, weights)[1], key=lambda s: s[1:]):
            if a >= done:
                text += r.text[done:a] + f"<{kind.upper()}>"
            done = max(done, b)
        text += r.text[done:]
        assert four[i].text == text and four[i].n_chars == len(text)
        assert (four[i].lang, four[i].source) == (r.lang, r.source)

    # 5: every token of the library's encoding in one piece, under the boundaries of the global histogram
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=load_tiktoken_bpe(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    ids = {i: enc.encode_ordinary(r.text) for i, r in four.items()}
    n = {i: len(x) for i, x in ids.items()}
    got = stage["packing"](spark, four_df, sf_dir).collect()
    size = length_buckets.MAX_TOKENS
    want = {(i, k): (min(size, v - k * size), k * size) for i, v in n.items() for k in range(max(1, -(-v // size)))}
    assert {(r.doc_id, r.piece): (r.n_tokens, r.first_token) for r in got} == want and len(got) == len(want)
    for r in got:
        assert r.ids == ids[r.doc_id][r.first_token:r.first_token + r.n_tokens] + [length_buckets.PAD] * r.padding
    lengths = [v for v, _ in want.values()]
    ends = length_buckets.boundaries(sorted(set(lengths)), [lengths.count(v) for v in sorted(set(lengths))])
    assert all(r.bucket_tokens == min(e for e in ends if e >= r.n_tokens) == ends[r.bucket] for r in got)
    full = {}
    for r in got:
        full.setdefault((r.bucket, r.batch), []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) and len(s) * ends[b] <= max(length_buckets.BUDGET, ends[b])
               for (b, _), s in full.items())


def test_a_run_leaves_its_last_table_only(spark, sf_dir):
    from tagwarden.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf_dir)
    left = [f for f in os.listdir(folder) if f not in before and not re.match("rdd-", f)]
    assert len(left) == 1 and left[0].startswith("pipeline-packing")
    assert out.count() > 0
