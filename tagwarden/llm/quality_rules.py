"""Quality rules with risk-controlled thresholds, in built-in column functions only.

Every text gets five rule values. For each stratum (language) and rule a fixed sequence of
cutoffs, from lenient to strict, is tested on the labelled holdout: a cutoff is certified
when the exact binomial test rejects "this rule falsely rejects more than ``alpha / rules``
of the stratum's good texts" at level ``delta / (rules * strata)`` - the Clopper-Pearson
upper bound lies under the limit. Within a sequence testing stops at the first failure
(fixed-sequence testing needs no further correction); over rules and strata the level is
divided (Bonferroni). So with probability ``1 - delta`` all certified cutoffs hold at once,
any of them may be chosen, and a stratum loses at most ``alpha`` of its good texts to all
rules together. A trial is one distinct text of a stratum: copies add nothing to what is proven (a text counts as
bad where any of its labels says so). Chosen is the certified cutoff with the best (bad caught - ``cost`` * good
lost); a stratum whose labels prove nothing gets no cutoff.

Nulls and odd inputs: a null text has no words (and so fails the base rule); a null stratum
is a stratum of its own; a null doc_id is never labelled; labels repeated for a doc_id count
once, as bad if any of them says so; repeated rows and copies are judged alike and tried once; very long texts are read
whole; empty tables give empty results; input columns that could clash ride in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagwarden.llm.common import nested, shared_folder, table, written
from tagwarden.plans.broadcast import DEFAULT_MAX_BROADCAST_BYTES

ALPHA, DELTA, COST = 0.025, 0.05, 2.0
WINDOW, MIN_WORDS, MAX_REPEAT_PCT = 8, 20, 30
SPACE = r"[\x20\x09-\x0D]+"
TRIM = " \t\n\x0b\f\r"

# rule -> cutoffs from lenient to strict; a text is rejected when its value is above the cutoff
CUTOFFS = {
    "symbol_ratio": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_ratio": (0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06),
    "mean_word": (15.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0),
    "same_next_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
}
RULES = tuple(CUTOFFS)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _nexts(a: str, f) -> Column:
    """``f(element, next element)`` for every element but the last."""
    return F.slice(F.zip_with(a, F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1))), f), F.lit(1),
                   F.greatest(F.size(a) - 1, F.lit(0)))


def _pairs_ahead(a: str, step: int) -> Column:
    """``xxhash64(a[i], a[i + step])`` for every i that has both."""
    return F.when(F.size(a) > step, F.slice(
        F.zip_with(a, F.slice(a, F.lit(step + 1), F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y)),
        F.lit(1), F.greatest(F.size(a) - step, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def _repeated_positions(sorted_pairs: str) -> Column:
    """Positions ``i`` of sorted ``(k, i)`` structs whose ``k`` also stands beside them."""
    z = F.arrays_zip(F.col(sorted_pairs).alias("c"),
                     F.slice(sorted_pairs, F.lit(2), F.greatest(F.size(sorted_pairs), F.lit(1))).alias("n"),
                     F.concat(F.slice(sorted_pairs, 1, 1),
                              F.slice(sorted_pairs, F.lit(1), F.greatest(F.size(sorted_pairs) - 1, F.lit(0)))).alias("p"))
    z = F.transform(z, lambda x, j: F.struct(x["c"].alias("c"), x["n"].alias("n"), x["p"].alias("p"), j.alias("j")))
    hit = F.filter(z, lambda x: x["c"].isNotNull() & (
        F.coalesce(x["c"]["k"] == x["n"]["k"], F.lit(False)) | ((x["j"] > 0) & (x["c"]["k"] == x["p"]["k"]))))
    return F.transform(hit, lambda x: x["c"]["i"])


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``df`` (which must not hold the names below) without ``text``, plus the base counts,
    ``n_lines``, ``n_same_next``, ``base_failed`` and the five rule values.

    One narrow pass without a shuffle. Repeated windows are found by 64-bit hashes of the
    window (three doublings of word hashes), then proven on the words themselves. Each step is
    its own projection and reads every array twice or more, so that the optimizer does not
    inline an array into a lambda.
    """
    keep = [F.col(c) for c in df.columns if c != text]
    names = [c for c in df.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.select(*keep, t.alias("_t"))
    d = d.select(*names, F.split(F.btrim("_t", F.lit(TRIM)), SPACE).alias("_w"),
                 F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(TRIM)) != "").alias("_l"),
                 F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    empty = F.col("_w")[0] == ""
    d = d.select(*names, "n_symbols", F.size("_l").cast("long").alias("n_lines"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                 F.when(empty, F.array().cast("array<string>")).otherwise(F.col("_w")).alias("_w"))
    small = [*names, "n_symbols", "n_lines", "n_dup_lines"]
    d = d.select(*small, "_w", F.size("_w").cast("long").alias("n_words"),
                 F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
                 F.aggregate(_nexts("_w", lambda a, b: (a == b).cast("long")), F.lit(0).cast("long"),
                             lambda a, x: a + x).alias("n_same_next"),
                 F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    small += ["n_words", "word_chars", "n_same_next"]
    for step in (1, 2, 4):
        d = d.select(*small, "_w", _pairs_ahead("_h", step).alias("_h"))
    d = d.select(*small, "_w", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("k"), i.alias("i"))))).alias("_s"))
    d = d.select(*small, "_w", F.when(F.col("_s").isNotNull(), _repeated_positions("_s")).alias("_c"))
    d = d.select(*small, F.when(F.size("_w") >= WINDOW, F.sort_array(F.transform("_c", lambda i: F.struct(
        F.array_join(F.slice("_w", i + 1, F.lit(WINDOW)), " ").alias("k"), i.alias("i"))))).alias("_s"))
    d = d.select(*small, F.when(F.col("_s").isNotNull(), F.sort_array(_repeated_positions("_s"))).alias("_p"))
    gap = F.zip_with("_p", F.slice("_p", F.lit(2), F.greatest(F.size("_p"), F.lit(1))),
                     lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))).cast("long"))
    d = d.select(*small, F.when(F.col("_p").isNotNull() & (F.size("_p") > 0), F.aggregate(
        gap, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return d.select(
        *names, *BASE, "n_lines", "n_same_next",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
        .alias("base_failed"),
        per("n_symbols", "word_chars").alias("symbol_ratio"), per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"), per("word_chars", "n_words").alias("mean_word"),
        per("n_same_next", "n_words").alias("same_next_ratio"))


def _ln_factorial(n: Column) -> Column:
    """ln(n!): exact to 20, Stirling's series beyond (error under 1e-13)."""
    x = n.cast("double")
    series = (x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3))
              + 1 / (1260 * F.pow(x, 5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(Binomial(n, p) <= k), summed from the k-th term down; 1 where k is not under the mean.

    Terms fall at least as fast as a normal density with the same spread, so those more than
    ten standard deviations below k (under 1e-21 of the sum) are left out.
    """
    q = 1 - p
    ln_pk = (_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(p) + (n - k) * F.log(q))
    last = F.least(k.cast("double"), F.ceil(10 * F.sqrt(n * p * q)) + 50).cast("int")
    # sum of t_0 = 1, t_j = t_(j-1) * (k - j + 1) / (n - k + j) * q / p
    state = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t"))

    def add(a, j):
        t = a["t"] * (k - j + 1) / (n - k + j) * q / p
        return F.struct((a["s"] + t).alias("s"), t.alias("t"))

    total = F.aggregate(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")),
                        state, add, lambda a: a["s"])
    return F.when(k < n * p, F.exp(ln_pk) * total).otherwise(F.lit(1.0))


def calibrate(feats: DataFrame, labels: DataFrame, stratum: str, id_col: str = "doc_id", alpha: float = ALPHA,
              delta: float = DELTA, cost: float = COST, key: str = "_key") -> DataFrame:
    """``(stratum, rule, cutoff, n_good, good_lost, bad_caught, p_value)``: the chosen cutoff of every
    stratum and rule that has one. All labelled texts of ``feats`` (id, stratum, ``key``, rule values) count, those of
    one ``key`` (a hash of the text) once a stratum.

    Shuffles the labelled ids and rule values once; from there on only one row per stratum,
    rule and cutoff step moves.
    """
    shared_folder(feats.sparkSession)
    lab = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy("doc_id").agg(F.min("quality").alias("_q")))
    held = feats.where(~F.col("base_failed")).join(lab, F.col(id_col) == F.col("doc_id") if id_col != "doc_id"
                                                   else "doc_id")
    held = held.groupBy(F.col(stratum).cast("string").alias("stratum"), key, *RULES).agg(F.min("_q").alias("_q"))
    # step = how many of the rule's cutoffs, counted from the strict end, the value is above
    steps = [F.struct(F.lit(r).alias("rule"), sum(
        (F.col(r) > c).cast("int") for c in CUTOFFS[r]).alias("step")) for r in RULES]
    hist = (held.select("stratum", "_q", F.explode(F.array(*steps)).alias("_r"))
            .groupBy("stratum", "_r.rule", "_r.step")
            .agg(F.count_if(F.col("_q") == 1).alias("good"), F.count_if(F.col("_q") == 0).alias("bad")).checkpoint())
    strata = hist.agg(F.count_distinct(F.struct("stratum"))).first()[0]
    level = delta / (len(RULES) * max(1, strata))
    limit = alpha / len(RULES)
    order = F.create_map(*[x for r in RULES for x in (F.lit(r), F.array(*[F.lit(c) for c in CUTOFFS[r]]))])
    # every cutoff k (1 = most lenient) of every stratum and rule that occurs
    cells = hist.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n_good"),
        F.collect_list(F.struct("step", "good", "bad")).alias("_s"))  # at most one element per cutoff
    cuts = cells.select("stratum", "rule", "n_good", "_s", F.posexplode(order[F.col("rule")]).alias("_k", "cutoff"))
    above = lambda what: F.aggregate(  # noqa: E731  rejected at cutoff k: those above it and all stricter ones
        F.filter("_s", lambda s: s["step"] >= F.size(order[F.col("rule")]) - F.col("_k")),
        F.lit(0).cast("long"), lambda a, s: a + s[what])
    cuts = cuts.select("stratum", "rule", "n_good", "_k", "cutoff", above("good").alias("good_lost"),
                       above("bad").alias("bad_caught"))
    cuts = cuts.withColumn("p_value", binomial_tail(F.col("good_lost"), F.col("n_good"), F.lit(limit)))
    w = W.partitionBy("stratum", "rule").orderBy("_k")
    tested = cuts.withColumn("_worst", F.max("p_value").over(w)).where(F.col("_worst") <= level)
    gain = F.col("bad_caught") - cost * F.col("good_lost")
    best = W.partitionBy("stratum", "rule").orderBy(gain.desc(), "_k")
    return (tested.where(gain > 0).withColumn("_n", F.row_number().over(best)).where("_n = 1")
            .select("stratum", "rule", "cutoff", "n_good", "good_lost", "bad_caught", "p_value"))


def verdict(feats: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``feats`` with the column ``kept``: passes the base rule and all cutoffs of its stratum.

    The cutoffs become one row a stratum. That table is broadcast where its size is within the bound (it has a stratum
    name and at most five numbers a row); beyond it the join is left to a shuffle, split where a stratum is hot.
    """
    cut = written(cutoffs.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff").cast("double"))).alias(f"_c_{r}") for r in RULES]), "cutoffs")
    size = cut.agg(F.sum(F.coalesce(F.octet_length("stratum"), F.lit(0)) + 64)).first()[0] or 0
    cut = cut.withColumnRenamed("stratum", "_cut_stratum")
    j = feats.join(F.broadcast(cut) if size <= DEFAULT_MAX_BROADCAST_BYTES else cut,
                   F.col(stratum).cast("string").eqNullSafe(F.col("_cut_stratum")), "left")
    ok = ~F.col("base_failed")
    for r in RULES:
        ok = ok & F.coalesce(F.col(r) <= F.col(f"_c_{r}"), F.lit(True))
    return j.select(*[feats[f"`{c}`"] for c in feats.columns], ok.alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text: str = "text",
          alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(row, base counts, base_failed, kept)``: every input row as a struct with its verdict.

    The rows are written once with their features, so neither the texts are shuffled nor the
    features computed twice.
    """
    d = nested(docs, text, _id=id_col, _stratum=stratum, _key=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    feats = written(features(d), "quality-features")
    cut = calibrate(feats.select(F.col("_id").alias("doc_id"), "_stratum", "_key", "base_failed", *RULES), labels, "_stratum",
                    alpha=alpha, delta=delta)
    return verdict(feats, cut, "_stratum").select("row", *BASE, "base_failed", "kept")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract columns of every document; the row struct is cut to its id, so no text is written."""
    docs = table(spark, sf_dir, "documents")
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    feats = written(features(docs.select("doc_id", "lang", "text", key.alias("_key"))), "quality-features")
    cut = calibrate(feats, table(spark, sf_dir, "labels"), "lang")
    return verdict(feats, cut, "lang").select("doc_id", *BASE, "base_failed", "kept")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents the rules keep, with their columns unchanged."""
    return judge(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def oracle() -> str:
    """The query in SQL; the binomial tail is summed in full."""
    space, symbols = r"[^\x20\x09-\x0D]", "[^#*$%&|<>]"
    cuts = ", ".join(f"('{r}', {k}, CAST({c} AS DOUBLE))" for r in RULES for k, c in enumerate(CUTOFFS[r], 1))
    ratio = "coalesce(CAST({} AS DOUBLE) / nullif({}, 0), 0.0)".format
    values = {"symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
              "repeat_ratio": ratio("n_repeat_words", "n_words"), "mean_word": ratio("word_chars", "n_words"),
              "same_next_ratio": ratio("n_same_next", "n_words")}
    unpivot = " UNION ALL ".join(f"SELECT stratum, q, '{r}' AS rule, {r} AS v FROM held" for r in RULES)
    checks = " AND ".join(
        f"f.{r} <= coalesce((SELECT cutoff FROM chosen c WHERE c.rule = '{r}' AND c.stratum IS NOT DISTINCT FROM f.lang), "
        "CAST('inf' AS DOUBLE))" for r in RULES)
    return rf"""
WITH w AS MATERIALIZED (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{space}+') AS w,
         CAST(length(regexp_replace(coalesce(text, ''), '{symbols}', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{space}')) AS l FROM documents)
, win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW}))
, starts AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1)
, covered AS (SELECT doc_id, CAST(sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS BIGINT) AS n_repeat_words
              FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM starts) GROUP BY doc_id)
, base AS (
  SELECT w.doc_id, lang, t, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_same_next
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id)
, feats AS MATERIALIZED (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
         {", ".join(f"{v} AS {r}" for r, v in values.items())} FROM base)
, lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id)
, held AS MATERIALIZED (SELECT lang AS stratum, t, {", ".join(f"any_value({r}) AS {r}" for r in RULES)}, min(q) AS q
  FROM feats f JOIN lab USING (doc_id) WHERE NOT base_failed GROUP BY lang, t)
, cuts(rule, k, cutoff) AS (VALUES {cuts})
, cell AS MATERIALIZED (
  SELECT stratum, u.rule, k, cutoff, count(*) FILTER (q = 1) AS n_good, count(*) FILTER (q = 1 AND v > cutoff) AS lost,
         count(*) FILTER (q = 0 AND v > cutoff) AS caught FROM ({unpivot}) u JOIN cuts USING (rule) GROUP BY ALL)
, tail AS (
  SELECT *, CASE WHEN lost < n_good * {ALPHA / len(RULES)!r} THEN list_sum(list_transform(range(0, lost + 1), lambda j: exp(
    lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({ALPHA / len(RULES)!r})
    + (n_good - j) * ln(1 - {ALPHA / len(RULES)!r})))) ELSE 1.0 END AS p FROM cell)
, tested AS (SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY k) AS worst FROM tail)
, chosen AS (
  SELECT stratum, rule, cutoff FROM tested
  WHERE worst <= {DELTA!r} / ({len(RULES)} * (SELECT count(DISTINCT coalesce('=' || stratum, 'null')) FROM held))
    AND caught - {COST!r} * lost > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - {COST!r} * lost DESC, k) = 1)
SELECT doc_id, {", ".join(BASE)}, base_failed, NOT base_failed AND {checks} AS kept FROM feats f"""
