import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import PROSE, TEXTS, awkward, empty, words
from zonewright.llm.quality_model import document_classifier, features, quality_posteriors, sampled_features
from zonewright.llm.quality_rules import bin_start, judged, keep_good, rule_table, sketch_bin, thresholds


def brute_counts(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_counts_and_base_rule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rule_table(docs).collect():
        n, chars, symbols, dup, repeats = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)


def test_good_documents_are_kept_and_junk_goes(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = rule_table(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(junk) / max(1, len(junk)) < 0.1


def test_sketch_bins_hold_their_numbers(spark):
    rows = spark.createDataFrame([(v,) for v in [*range(300), 1000, 4095, 4096, 10**6, 2**40 + 7]], "v long")
    for r in rows.withColumn("b", sketch_bin(F.col("v"))).withColumn("s", bin_start(F.col("b"))).collect():
        assert r.s <= r.v <= r.s + r.v // 256


def test_a_small_group_is_weighed_toward_its_language(spark):
    rows = [(i, PROSE + f" {i}", "en", "big") for i in range(3000)] + [(10_000 + i, ("%%%% " * 3 + PROSE) * (1 + i % 2), "en", "small") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    q3 = {r[0]: r[1] for r in judged(docs, ["source"]).select("source", "_zw_q3_symbols").distinct().collect()}
    own = 1000 * (12.375 / len("".join(words(PROSE)) + "%" * 12)) ** 0.5
    assert q3["big"] < q3["small"] < q3["big"] + 4 / 104 * own


def test_sources_with_other_statistics_get_other_thresholds(spark):
    """The same prose, in one source with currency signs throughout: no single cutoff gives these verdicts."""
    rows = [(i, PROSE + f" {'and so on ' * (i % 7)}{i}", "en", "plain") for i in range(800)]
    rows += [(1000 + i, ("$" * (18 + i % 9) + " ") + PROSE + f" {'and so on ' * (i % 7)}{i}", "en", "prices") for i in range(800)]
    rows += [(5000, "$" * 22 + " " + PROSE, "en", "plain"), (5001, "$" * 150 + " " + PROSE, "en", "prices")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in rule_table(docs).collect()}
    assert not got[5000].kept and not got[5001].kept
    usual = [r for i, r in got.items() if i < 5000]
    assert all(r.kept for r in usual) and max(r.n_symbols for r in usual) > got[5000].n_symbols
    high = {r[0]: r[1] for r in judged(docs, ["source"]).groupBy("source").agg(F.max(thresholds("symbols")[1])).collect()}
    assert high["prices"] > 1.2 * high["plain"]


def test_a_group_that_is_mostly_copies_keeps_the_others(spark):
    rows = [(i, PROSE, "en", "s") for i in range(300)] + [(1000 + i, f"Own {i} words " + PROSE.lower().replace("a", "a" * (1 + i % 2)), "en", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert keep_good(docs).count() == 360


def test_awkward_rows(spark):
    rows = rule_table(awkward(spark)).collect()
    assert Counter((r.doc_id, r.n_words) for r in rows) == Counter((i, len(words(t))) for i, t, _, _ in TEXTS)
    kept = keep_good(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert rule_table(empty(spark)).count() == 0 and keep_good(empty(spark)).count() == 0


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, judged on the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("doc_id % 2 = 0")
    rows = quality_posteriors(docs, known).join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("q"), "toxic"), "doc_id").collect()
    right = [r.kept == (r.q == 1 and r.toxic == 0) for r in rows]
    clean = [r.kept for r in rows if r.q == 1 and r.toxic == 0]
    assert sum(right) / len(right) > 0.95 and sum(clean) / len(clean) > 0.98


def test_sparse_sites_shrink_toward_the_global_prior(spark):
    junk, good = "!!! BUY $$$ " * 30, PROSE
    rows = [(i, junk if i % 4 == 0 else good + f" {i}", "en", "large") for i in range(400)]
    rows += [(1000 + i, junk, "en", "bad") for i in range(100)] + [(2000, junk, "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], int(r[1] != junk), 0) for r in rows if r[0] < 1050], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_posteriors(docs, labels).collect()}
    assert got[1000].host_posterior < got[2000].host_posterior < got[1].host_posterior
    assert got[1].kept and not got[2000].kept


def plain_posteriors(docs, known, weights, bias):
    """The hierarchy in plain Python: {doc_id: (host posterior, path posterior, quality)} for (doc_id, host, path, text)."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    logit = {i: round(float(np.clip(weights[features(t)].sum() + bias, -30, 30)), 6) for i, _, _, t in docs}
    soft = {i: float(known[i]) if i in known else round(1e6 * sigmoid(logit[i])) / 1e6 for i, *_ in docs}

    def strength(groups, priors):
        n = sum(len(g) for g in groups)
        between = sum(len(g) * (sum(g) / len(g) - p) ** 2 for g, p in zip(groups, priors))
        within = sum(len(g) * p * (1 - p) for g, p in zip(groups, priors))
        spread = (between - within * len(groups) / n) / n
        return min(1e6, max(1.0, within / n / spread - 1)) if spread > 0 else 1e6

    prior = (sum(soft.values()) + 1) / (len(docs) + 2)
    hosts, paths, host_of = defaultdict(list), defaultdict(list), {}
    for i, host, path, _ in docs:
        hosts[host].append(soft[i])
        paths[path].append(soft[i])
        host_of[path] = host
    k = strength(list(hosts.values()), [prior] * len(hosts))
    whole = {h: (sum(g) + k * prior) / (len(g) + k) for h, g in hosts.items()}
    kp = strength(list(paths.values()), [whole[host_of[p]] for p in paths])
    out = {}
    for i, host, path, _ in docs:
        h = (sum(hosts[host]) - soft[i] + k * prior) / (len(hosts[host]) - 1 + k)
        p = (sum(paths[path]) - soft[i] + kp * h) / (len(paths[path]) - 1 + kp)
        out[i] = (h, p, sigmoid(logit[i] - math.log(prior / (1 - prior)) + math.log(p / (1 - p))))
    return out


def test_a_long_tail_of_hosts_against_plain_python(spark):
    """Two hosts with many documents, and a hundred with one each, by url."""
    junk = "!!! BUY $$$ " * 30
    rows = [(i, junk if i % 5 == 0 else PROSE + f" {i}", f"http://{'a' if i % 2 else 'b'}.example/{'x' if i % 3 else 'y'}/{i}") for i in range(300)]
    rows += [(1000 + i, junk if i % 3 == 0 else PROSE + f" {i}", f"https://h{i}.example") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string").repartition(5)
    labels = spark.createDataFrame([(i, int(t is not junk), 0) for i, t, _ in rows if i % 4 == 0 and i < 300], "doc_id long, quality int, toxic int")
    known = {r.doc_id: r.quality for r in labels.collect()}
    weights, bias = document_classifier(docs, labels.select("doc_id", F.col("quality").alias("good")))
    sites = []
    for i, t, url in rows:
        host, _, rest = url.split("//")[1].partition("/")
        sites.append((i, host, f"{host}/{rest.split('/')[0]}", t.encode()))
    want = plain_posteriors(sites, known, weights, bias)
    got = {r.doc_id: r for r in quality_posteriors(docs, labels).collect()}
    assert got.keys() == want.keys()
    for i, (h, p, q) in want.items():
        assert np.allclose((got[i].host_posterior, got[i].path_posterior, got[i].quality), (h, p, q), atol=1e-6)
    alone = {round(got[1000 + i].path_posterior, 6) for i in range(100)}
    assert len(alone) == 1  # the only document of a site is judged by the prior of all, whatever it is itself


def test_posteriors_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (2, 0, None), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_posteriors(awkward(spark), labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in TEXTS)
    none = quality_posteriors(awkward(spark), labels.limit(0)).collect()
    assert len(none) == len(TEXTS) and all(r.kept and r.evidence == 0 for r in none)
    bad = quality_posteriors(awkward(spark), labels.filter("quality = 0")).collect()
    assert len(bad) == len(TEXTS) and not any(r.kept for r in bad)
    assert quality_posteriors(empty(spark), labels).count() == 0


def test_the_sample_is_bounded(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("good"))
    few, _ = document_classifier(docs, known, sample_rows=5)
    assert np.isfinite(few).all()
    repeated = docs.unionByName(docs).unionByName(docs.withColumn("text", F.lit("another")))
    assert sampled_features(repeated, known, 5).count() == 5
    assert features(None) and features(b"a b") != features(b"A!! b")
