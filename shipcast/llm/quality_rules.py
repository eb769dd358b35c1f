"""Operator 10: quality rules with thresholds that adapt to language and source.

Every document gets counts (words, characters, symbols, repeated lines, words in
repeated 5-word windows).  Two base rules are fixed.  The others compare a ratio
with fences learnt per (lang, source): a relative-error quantile sketch (counts
of logarithmic buckets, so merging is adding) is built from all documents.  Where
documents usually have some of a measure, its fences lie several spreads from the
median, the spread being measured on the side that the rule does not test, which
junk on the other side cannot widen.  Where most documents have none of it (repeats),
the median says nothing: the fence lies beyond the 0.99 quantile by a multiple of
the step from the 0.95 quantile to it, so the cleaner a group, the lower its fence.
Sketches of small groups are merged into their language's, and those into the
whole corpus's, until ``MIN_ROWS`` documents stand behind a fence.  Documents are
joined with the fences of their group and filtered.
"""

from __future__ import annotations

from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, ragged

ACCURACY = 0.01  # relative error of a quantile
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
MIN_ROWS = 100
WINDOW = 5
# measure -> (quantile the upper fence starts from, quantile its spread is measured to, least
# spread, spreads to the upper fence, spreads to the lower fence or None)
RULES = {
    "symbol_ratio": ("q50", "q25", 0.01, 4.0, None),
    "repeat_ratio": ("q99", "q95", 0.01, 1.0, None),
    "line_ratio": ("q99", "q95", 0.02, 1.0, None),
    "word_length": ("q50", "q25", 0.2, 10.0, 10.0),
}
QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_FIELDS = [*COUNTS, "n_lines"]


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(set(zip(*(words[i:] for i in range(WINDOW))))) == n:
        return 0
    seen = Counter(zip(*(words[i:] for i in range(WINDOW))))
    again = np.fromiter((seen[w] > 1 for w in zip(*(words[i:] for i in range(WINDOW)))), dtype=bool, count=n)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def _repeat_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier one)."""
    lines = text.split(b"\n")
    lines = list(compress(lines, map(bytes.strip, lines)))
    return len(lines), len(lines) - len(set(lines))


def counts_of(text: ragged.Text) -> np.ndarray:
    """The counts of every row of a slice, one row per document."""
    blank = ragged.WHITESPACE[text.data]

    def per_row(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[text.offsets[1:]] - total[text.offsets[:-1]]

    out = np.zeros((len(text), len(_FIELDS)), dtype=np.int64)
    out[:, 1] = per_row(~blank & ((text.data & 0xC0) != 0x80))
    out[:, 2] = per_row(_SYMBOL[text.data])
    for i in range(len(text)):
        row = text.row(i)
        words = row.split()
        out[i, 0], out[i, 4] = len(words), _repeat_words(words)
        out[i, 5], out[i, 3] = _repeat_lines(row)
    return out


def measured(docs: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or some of its columns) with a struct column ``name`` of the counts."""
    kept = columns or docs.columns
    fields = ", ".join(f"{f}: bigint" for f in _FIELDS)
    schema = docs.select(*kept).withColumn(name, F.lit(None).cast(f"struct<{fields}>")).schema

    def run(batches):
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                counts = counts_of(ragged.text_of(part.column("text")))
                found = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(counts[:, i]))
                                                    for i in range(len(_FIELDS))], names=_FIELDS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found], names=[*kept, name])

    needed = [*kept, *(["text"] if "text" not in kept else [])]
    return docs.select(*needed).mapInArrow(run, schema)


def _measures(c) -> dict:
    """Ratios that the adaptive rules look at; null where there is nothing to divide by."""
    def over(a, b):
        return F.when(c[b] > 0, c[a] / c[b])

    return {"symbol_ratio": over("n_symbols", "word_chars"), "repeat_ratio": over("n_repeat_words", "n_words"),
            "line_ratio": over("n_dup_lines", "n_lines"), "word_length": over("word_chars", "n_words")}


def base_failed(c):
    """The fixed rules: under 10 words, or over a fifth of the words in repeated windows."""
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def sketches(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Quantile sketches: counts n per keys, measure and logarithmic bucket (null: zero).

    Documents that fail the base rules are left out.  Two sketches merge by adding
    their counts, which is all that the partial and final aggregates do.
    """
    ratios = _measures(F.col(name))
    buckets = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in ratios.items())))
    return (rows.where(~base_failed(F.col(name))).select(*keys, buckets.alias("at"))
            .where("at.value is not null")
            .withColumn("bucket", F.when(F.col("at.value") > 0,
                                         F.ceil(F.log(F.col("at.value")) / float(np.log(GAMMA))).cast("int")))
            .groupBy(*keys, "at.measure", "bucket").agg(F.count(F.lit(1)).alias("n")))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, rows and the ``QUANTILES`` of merged sketches."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(
        F.pow(F.lit(float(GAMMA)), F.col("bucket")) * (2.0 / (GAMMA + 1.0)))
    placed = (merged.withColumn("rows", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(upto))
              .withColumn("value", value))
    reach = [F.min(F.when(F.col("upto") >= F.ceil(F.col("rows") * q), F.col("value"))).alias(a)
             for a, q in QUANTILES.items()]
    return placed.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), *reach)


def _fences(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a struct of fences, one row per group."""
    columns = []
    for measure, (start, other, least, up, down) in RULES.items():
        mine = F.col("measure") == measure
        high = F.col(start) + up * F.greatest(F.col(start) - F.col(other), F.lit(least))
        columns.append(F.max(F.when(mine, high)).alias(f"{measure}_max"))
        if down is not None:
            low = F.col("q50") - down * F.greatest(F.col("q75") - F.col("q50"), F.lit(least))
            columns.append(F.max(F.when(mine, low)).alias(f"{measure}_min"))
    # every measure of a group has about as many rows; the scarcest decides whether it stands alone
    out = found.groupBy(*keys).agg(F.min("rows").alias("rows"), *columns)
    names = [c for c in out.columns if c not in (*keys, "rows")]
    return out.select(*keys, "rows", F.struct(*names).alias("fences"))


def thresholds(rows: DataFrame, name: str) -> DataFrame:
    """lang, source, fences: those of the group, or of its language, or of all."""
    sketch = common.stored(sketches(rows, name, ["lang", "source"]), "quality-sketches")
    own = _fences(quantiles(sketch, ["lang", "source"]), ["lang", "source"])
    wide = _fences(quantiles(sketch, ["lang"]), ["lang"]).select(
        F.col("lang").alias("w_lang"), F.col("rows").alias("w_rows"), F.col("fences").alias("w_fences"))
    whole = _fences(quantiles(sketch.withColumn("all", F.lit(0)), ["all"]), ["all"]).select(
        F.col("fences").alias("a_fences"))
    chosen = (F.when(F.col("rows") >= MIN_ROWS, F.col("fences")).when(F.col("w_rows") >= MIN_ROWS, F.col("w_fences"))
              .otherwise(F.col("a_fences")))
    found = (own.join(wide, F.col("lang").eqNullSafe(F.col("w_lang")), "left").crossJoin(F.broadcast(whole))  # one row
             .select("lang", "source", chosen.alias("fences"), (F.col("rows") >= MIN_ROWS).alias("own")))
    return common.stored(found, "quality-fences")  # the planner then joins the texts with it by its size


def _verdict(c, f):
    """Whether the counts ``c`` stay within the fences ``f``; without fences, they do."""
    ok = F.lit(True)
    for measure, value in _measures(c).items():
        ok = ok & F.coalesce(value <= f[f"{measure}_max"], F.lit(True))
        if RULES[measure][-1] is not None:
            ok = ok & F.coalesce(value >= f[f"{measure}_min"], F.lit(True))
    return ok


def judged(rows: DataFrame, name: str, fences: DataFrame, verdict: str) -> DataFrame:
    """``rows`` with a boolean column ``verdict``: kept by the base rules and the fences."""
    own = {c: common.free_name(rows, f"fence_{c}") for c in ("lang", "source", "limits")}
    limits = fences.select(F.col("lang").alias(own["lang"]), F.col("source").alias(own["source"]),
                           F.col("fences").alias(own["limits"]))
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col(own["lang"]))
                       & F.col("source").eqNullSafe(F.col(own["source"])), "left")
    keep = ~base_failed(F.col(name)) & _verdict(F.col(name), F.col(own["limits"]))
    return joined.withColumn(verdict, keep).drop(*own.values())


def rejections(rows: DataFrame, name: str, fences: DataFrame) -> DataFrame:
    """rule, rejected, alone: how many of the rows that pass the base rules each fence
    rejects, and how many no other fence does; and ``own`` of ``rule`` 'group': rows
    whose (lang, source) has fences of its own."""
    limits = fences.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), F.col("fences").alias("f"), "own")
    joined = rows.where(~base_failed(F.col(name))).join(
        limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    broken = []
    for measure, value in _measures(F.col(name)).items():
        over = value > F.col(f"f.{measure}_max")
        if RULES[measure][-1] is not None:
            over = over | (value < F.col(f"f.{measure}_min"))
        broken.append(F.coalesce(over, F.lit(False)).cast("int"))
    how_many = sum(broken[1:], broken[0])
    each = [F.struct(F.lit(m).alias("rule"), b.alias("hit"), (b * (how_many == 1).cast("int")).alias("only"))
            for m, b in zip(RULES, broken)]
    each.append(F.struct(F.lit("group").alias("rule"), F.col("own").cast("int").alias("hit"), F.lit(0).alias("only")))
    return (joined.select(F.explode(F.array(*each)).alias("x")).groupBy("x.rule")
            .agg(F.sum("x.hit").alias("rejected"), F.sum("x.only").alias("alone"), F.count(F.lit(1)).alias("n")))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of ``docs(doc_id, text, lang, source)``.

    Null text has no words and fails; null lang or source is a group of its own.
    """
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"),
                        F.col("source").cast("string").alias("source"))
    rows = common.stored(measured(light, "counts", ["doc_id", "lang", "source"]), "quality-counts")
    found = judged(rows, "counts", thresholds(rows, "counts"), "kept")
    return found.select("doc_id", *(F.col(f"counts.{c}").alias(c) for c in COUNTS),
                        base_failed(F.col("counts")).alias("base_failed"), "kept")


def keep_passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    name = common.free_name(docs, "counts")
    rows = common.stored(measured(docs, name), "quality-measured")
    kept = common.free_name(docs, "kept")
    return judged(rows, name, thresholds(rows, name), kept).where(F.col(kept)).drop(name, kept)


def query(spark, sf_dir) -> DataFrame:
    """op10: rules over all documents."""
    return quality_rules(common.documents(spark, sf_dir))


def _oracle() -> str:
    """DuckDB SQL for the query's rows, from the same rules."""
    word = "[^\\x20\\x09-\\x0D]"
    ratios = {"symbol_ratio": ("n_symbols", "word_chars"), "repeat_ratio": ("n_repeat_words", "n_words"),
              "line_ratio": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words")}
    values = ", ".join(f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END AS {m}" for m, (a, b) in ratios.items())
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS value FROM ratios "
                              f"WHERE NOT base_failed AND {m} IS NOT NULL" for m in ratios)
    scopes = {"own": "lang, source", "wide": "lang", "whole": "0"}
    parts = []
    for scope, keys in scopes.items():
        names = "" if scope == "whole" else f"{keys}, "
        sums = ", ".join(
            f"max(CASE WHEN measure = '{m}' THEN {start} + {up!r} * greatest({start} - {other}, {least!r}) END) AS {m}_max"
            + (f", max(CASE WHEN measure = '{m}' THEN q50 - {down!r} * greatest(q75 - q50, {least!r}) END) AS {m}_min"
               if down is not None else "") for m, (start, other, least, up, down) in RULES.items())
        reach = ", ".join(f"min(CASE WHEN upto >= ceil(n_rows * {q!r}) THEN v END) AS {a}"
                          for a, q in QUANTILES.items())
        parts.append(f"""
{scope}_c AS (SELECT {names}measure, bucket, count(*) AS n FROM bucketed GROUP BY {names}measure, bucket),
{scope}_u AS (SELECT *, sum(n) OVER (PARTITION BY {names}measure) AS n_rows,
  sum(n) OVER (PARTITION BY {names}measure ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto,
  CASE WHEN bucket IS NULL THEN 0.0 ELSE pow({GAMMA!r}, bucket) * {2.0 / (GAMMA + 1.0)!r} END AS v FROM {scope}_c),
{scope}_q AS (SELECT {names}measure, max(n_rows) AS n_rows, {reach} FROM {scope}_u GROUP BY {names}measure),
{scope}_f AS (SELECT {names}min(n_rows) AS n_rows, {sums} FROM {scope}_q {"GROUP BY " + keys if names else ""})""")
    fences = [f"{m}_max" for m in RULES] + [f"{m}_min" for m in RULES if RULES[m][-1] is not None]
    chosen = ", ".join(f"CASE WHEN o.n_rows >= {MIN_ROWS} THEN o.{f} WHEN w.n_rows >= {MIN_ROWS} THEN w.{f} ELSE a.{f} END AS {f}"
                       for f in fences)
    inside = " AND ".join([f"coalesce({m} <= {m}_max, true)" for m in RULES]
                          + [f"coalesce({m} >= {m}_min, true)" for m in RULES if RULES[m][-1] is not None])
    return f"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
parted AS (SELECT *, regexp_extract_all(text, '{word}+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM docs),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - {WINDOW - 2}),
  lambda i: struct_pack(i := i, w := array_to_string(words[i:i + {WINDOW - 1}], ' ')))) AS win FROM parted WHERE len(words) > {WINDOW}),
again AS (SELECT doc_id, win.i AS i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win.w) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range({WINDOW}) AS t(k) GROUP BY doc_id),
counts AS (SELECT p.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - list_unique(lines) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines FROM parted p LEFT JOIN cover c ON p.doc_id = c.doc_id),
ratios AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {values} FROM counts),
bucketed AS (SELECT lang, source, measure,
  CASE WHEN value > 0 THEN CAST(ceil(ln(value) / {float(np.log(GAMMA))!r}) AS INTEGER) END AS bucket FROM ({each})),
{",".join(parts)},
fences AS (SELECT o.lang, o.source, {chosen} FROM own_f o LEFT JOIN wide_f w ON o.lang IS NOT DISTINCT FROM w.lang, whole_f a)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND {inside} AS kept
FROM ratios r LEFT JOIN fences f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""


ORACLE_SQL = _oracle()
