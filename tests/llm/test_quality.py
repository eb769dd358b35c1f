import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shipcast.llm import common, quality_classifier, quality_rules, ragged

from . import helpers

SF = "/root/testdata/sf0.01"


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    for v in np.unique(score):
        at = np.flatnonzero(score[order] == v)
        ranks[order[at]] = at.mean() + 1
    p = label.sum()
    return (ranks[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def test_held_out_accuracy(spark):
    rows = quality_classifier.query(spark, SF).join(common.documents(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 50 and rows.score.between(0, 1).all()
    assert _auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.95
    assert rows[rows.quality == 1].predicted.mean() > 0.95 and (rows.predicted == (rows.score >= 0.3)).all()


def test_classifier_ignores_held_out_labels(spark):
    docs, labels = common.documents(spark, SF), common.documents(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(common.crc32_held(F.col("doc_id"), 5, 0), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    assert quality_classifier.fit(docs, labels) == quality_classifier.fit(docs, flipped)


def test_classifier_awkward_rows(spark):
    docs, labels = common.documents(spark, SF), common.documents(spark, SF, "labels")
    model = quality_classifier.fit(docs, labels)
    odd = helpers.awkward(spark)
    scores = quality_classifier.quality_scores(odd, model).collect()
    assert len(scores) == len(helpers.AWKWARD) and all(0 <= r.score <= 1 for r in scores)
    kept = quality_classifier.keep_good(odd, model, 0.0)
    assert kept.schema == odd.schema and kept.count() == len(helpers.AWKWARD)
    assert quality_classifier.quality_scores(helpers.empty(spark), model).count() == 0


@pytest.mark.parametrize("rows", [[], [(0, 1), (1, 1)], [(0, None), (999999, 0)]])
def test_classifier_without_a_class_gives_one_score(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    model = quality_classifier.fit(common.documents(spark, "/root/testdata/sf0.001"), labels)
    scores = {r.score for r in quality_classifier.quality_scores(helpers.awkward(spark), model).collect()}
    assert len(scores) == 1


def test_repeated_ids_do_not_push_a_class_out(spark):
    """7,000 copies of one text of class 0 leave the model as it is."""
    docs, labels = common.documents(spark, SF), common.documents(spark, SF, "labels")
    half = F.pmod(F.xxhash64(F.lit("quality-half"), F.col("doc_id").cast("long")), F.lit(2)) == 1
    one = (docs.join(labels.where("quality = 0"), "doc_id").where(half & ~common.crc32_held(F.col("doc_id"), 5, 0))
           .orderBy(F.length("text"), "doc_id").where("length(text) > 0").select(docs.columns).limit(1))
    copies = one.crossJoin(spark.range(7000).select()).select(docs.columns)
    assert copies.count() == 7000
    model = quality_classifier.fit(docs.union(copies), labels)
    assert model.slope > 0 and model == quality_classifier.fit(docs, labels)


def test_scores_equal_plain_zstandard(spark):
    """Every document's score again, from the model's dictionaries and curve alone."""
    import zstandard

    docs = common.documents(spark, SF)
    model = quality_classifier.fit(docs, common.documents(spark, SF, "labels"))

    def size(text, dictionary):
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary),
                                          write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(packer.compress(text[i:i + 512])) for i in range(0, len(text), 512))

    texts = {r.doc_id: (r.text or "").encode() for r in docs.orderBy("doc_id").collect()}
    scores = {r.doc_id: r.score for r in quality_classifier.query(spark, SF).collect()}
    assert set(scores) == set(texts)
    for i, text in texts.items():
        gap = (size(text, model.bad) - size(text, model.good)) / (len(text) + 256)
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-min(max(model.slope * gap + model.intercept, -30), 30))), rel=1e-12)


def test_clashing_and_repeated_labels(spark):
    """An id with both labels has none; a repeated label counts once."""
    docs, labels = common.documents(spark, SF), common.documents(spark, SF, "labels").select("doc_id", "quality")
    odd = labels.where("doc_id % 3 = 0")
    clash = labels.union(odd.withColumn("quality", 1 - F.col("quality")))
    assert quality_classifier.fit(docs, clash) == quality_classifier.fit(docs, labels.where("doc_id % 3 <> 0"))
    assert quality_classifier.fit(docs, labels.union(labels).union(labels)) == quality_classifier.fit(docs, labels)


# --- rules -----------------------------------------------------------------------

def _counts(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), lines)


PARTS = ["a", "b ", "cc ", "\n", " ", "\t", "#", "<|", "é ", " ", "日 ", "a b c d e ", "line\n", "\r", "\x1c"]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_counts_match_brute_force(texts):
    got = quality_rules.counts_of(ragged.text_of(pa.array(texts, type=pa.string())))
    assert [tuple(r) for r in got.tolist()] == [_counts(t) for t in texts]


def test_query_matches_brute_force(spark):
    """Counts, sketch quantiles, fences and verdicts, all from plain Python."""
    docs = common.documents(spark, SF).collect()
    measured = {r.doc_id: (_counts(r.text), r.lang, r.source) for r in docs}
    gamma = quality_rules.GAMMA

    def failed(c):
        return c[0] < 10 or 100 * c[4] > 20 * c[0]

    def ratios(c):
        return {"symbol_ratio": c[2] / c[1] if c[1] else None, "repeat_ratio": c[4] / c[0] if c[0] else None,
                "line_ratio": c[3] / c[5] if c[5] else None, "word_length": c[1] / c[0] if c[0] else None}

    groups = collections.defaultdict(list)
    for c, lang, source in measured.values():
        if not failed(c):
            for key in ((lang, source), (lang,), ()):
                groups[key].append(ratios(c))

    def quantile(values, q):
        buckets = sorted(-1e9 if v == 0 else math.ceil(math.log(v) / math.log(gamma)) for v in values)
        b = buckets[math.ceil(len(values) * q) - 1]
        return 0.0 if b == -1e9 else gamma ** b * 2 / (gamma + 1)

    def fences(key):
        out = {}
        for m, (start, other, least, up, down) in quality_rules.RULES.items():
            v = [r[m] for r in groups[key] if r[m] is not None]
            q = {name: quantile(v, at) for name, at in quality_rules.QUANTILES.items()}
            out[m] = (q["q50"] - down * max(q["q75"] - q["q50"], least) if down else -math.inf,
                      q[start] + up * max(q[start] - q[other], least))
        return out

    made = {}
    for r in quality_rules.query(spark, SF).collect():
        c, lang, source = measured[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c[:5]
        assert r.base_failed == failed(c)
        key = next(k for k in ((lang, source), (lang,), ()) if len(groups[k]) >= quality_rules.MIN_ROWS or not k)
        limits = made.setdefault(key, fences(key))
        ok = all(limits[m][0] - 1e-9 <= v <= limits[m][1] + 1e-9 for m, v in ratios(c).items() if v is not None)
        assert r.kept == (ok and not r.base_failed)


def test_every_rule_can_reject(spark):
    """Fences of repeats lie below the fixed rule in clean groups, and rise with the group's own repeats."""
    def doc(i, repeats, lang):
        own = [f"w{(i * 7 + j) % 97}{'abcdefgh'[j % 8]}{j}" for j in range(100)]
        again = own[:repeats] + own[:repeats] if repeats else []
        return (i, " ".join(again + own[repeats:]), lang, "s", 0)

    clean = [doc(i, 0, "en") for i in range(300)]
    noisy = [doc(1000 + i, 9 if i % 3 == 0 else 0, "de") for i in range(300)]
    docs = spark.createDataFrame([*clean, *noisy, doc(5000, 9, "en"), doc(5001, 9, "de"), doc(5002, 12, "en")], helpers.SCHEMA)
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert not any(rows[i].base_failed for i in (5000, 5001))
    assert rows[5001].kept and not rows[5000].kept  # usual in one group, not in the other
    measured = quality_rules.measured(docs, "counts").cache()
    fences = quality_rules.thresholds(measured, "counts")
    limits = {r.lang: r.fences.repeat_ratio_max for r in fences.collect()}
    assert limits["en"] < 0.2 and limits["en"] <= limits["de"]
    told = {r.rule: (r.rejected, r.alone) for r in quality_rules.rejections(measured, "counts", fences).collect()}
    passing = [r for r in rows.values() if not r.base_failed]
    assert told["group"][0] == len(passing)
    assert sum(not r.kept for r in passing) >= told["repeat_ratio"][1]
    lines = spark.createDataFrame(
        [(i, " ".join(f"u{i}x{j}" for j in range(40)), "en", "s", 0) for i in range(200)]
        + [(900, "\n".join([f"one two three four v{j}" for j in range(10)] + ["same line"] * 3), "en", "s", 0)], helpers.SCHEMA)
    found = {r.doc_id: r for r in quality_rules.quality_rules(lines).collect()}
    assert not found[900].base_failed and not found[900].kept and found[5].kept


def test_merged_sketches_equal_one_sketch(spark):
    docs, _ = helpers.documents(spark, 100)
    rows = quality_rules.measured(docs, "counts")
    apart = quality_rules.sketches(rows, "counts", ["lang", "source"])
    whole = quality_rules.sketches(rows.withColumn("all", F.lit(0)), "counts", ["all"])
    assert sorted(map(str, quality_rules.quantiles(apart.withColumn("all", F.lit(0)), ["all"]).collect())) == sorted(
        map(str, quality_rules.quantiles(whole, ["all"]).collect()))


def test_rules_keep_clean_text_and_remove_junk(spark):
    rows = quality_rules.query(spark, SF).join(common.documents(spark, SF, "labels"), "doc_id").where("not base_failed").toPandas()
    assert rows[rows.quality == 1].kept.mean() > 0.97 and rows[rows.quality == 0].kept.mean() < 0.2


def test_rules_awkward_rows(spark):
    docs = helpers.awkward(spark)
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == len(helpers.AWKWARD)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    kept = quality_rules.keep_passing(docs)
    assert kept.dtypes == docs.dtypes and kept.count() == sum(r.kept for r in rows)
    assert quality_rules.quality_rules(helpers.empty(spark)).count() == 0
    assert quality_rules.keep_passing(helpers.empty(spark)).count() == 0
