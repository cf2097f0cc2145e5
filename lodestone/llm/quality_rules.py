"""Quality rules with adaptive thresholds (operator 8).

Base rules come first: fewer than 50 words, or more than half of the words in repeated 3-word windows. Every whole text is
measured once. Of the documents that pass, a quantile sketch is kept for each rule per (lang, source): counts of values in
logarithmic bins, each 2 % wide. Sketches merge by adding counts, so their result depends neither on partitions nor on
order, and a group needs about a thousand counts at most, however many rows it has. The sketches of a language's sources
merge into the language's, those into the corpus's. A group's fences come from its own sketches if it has at least
`min_rows` documents, else from its language's, else from the corpus's. They are joined to the measured rows, which are
then filtered.

No threshold is fixed. A fence is the group's median and `spread` times its scale, the largest of three: the median less
the 10th percentile, the 75th percentile less the median, and the group's resolution, which is what `grain` units of the
measure's numerator make in a document of the group's median size. The resolution keeps the scale above zero where most
documents have none of what is measured. Word length has a lower fence too.

Defined cases: a null text has no words and so fails the base rules; null languages and sources are groups like others;
equal values and repeated rows count once for each row; without any document that passes the base rules nothing is kept; an
empty table gives an empty result; columns of the input may have any names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, release, table

GAMMA, MIN_ROWS, MIN_WORDS = 1.02, 100, 50
ZERO_BIN = -1_000_000
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
MEASURES = "struct<" + ", ".join(f"{f}: bigint" for f in FIELDS) + ">"


@dataclass(frozen=True)
class Rule:
    """A document passes if its value is at most the median and spread times the scale of its group (and, with both, at least the median less that)."""

    name: str
    value: str
    spread: float
    grain: float
    both: bool = False

    @property
    def size(self) -> str:
        """The name of the denominator's sketch."""
        return "size " + self.value.split(" / ")[1]


RULES = (
    Rule("symbols", "n_symbols / word_chars", 8, 4),
    Rule("shouting", "n_upper / word_chars", 8, 4),
    Rule("repeats", "n_repeat_words / n_words", 16, 6),
    Rule("lines", "n_dup_lines / n_lines", 4, 1),
    Rule("long_words", "word_chars / n_words", 8, 1, both=True),
)
SIZES = tuple(dict.fromkeys(r.size for r in RULES))
#: Names of the fences: a rule's upper one, and its lower one behind "least".
FENCES = tuple(x for r in RULES for x in ((r.name, f"least {r.name}") if r.both else (r.name,)))
#: Parts in which the rows of one group meet its fences, where Spark joins them by a shuffle.
SALTS = 32


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur at least twice, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, until = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def measure_text(text: str | None) -> tuple[int, ...]:
    """The fields of FIELDS for one whole text."""
    if not text:
        return (0,) * len(FIELDS)
    raw = text.encode()
    words = raw.split()  # ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    chars = len(text) - sum(map(text.count, BLANKS))
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), upper)


def measures(text: Column) -> Column:
    @F.arrow_udf(MEASURES)
    def measure(batch: pa.Array) -> pa.Array:
        release()
        rows = [measure_text(t.as_py()) for t in batch]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FIELDS))], list(FIELDS))

    return measure(text.cast("string"))


def _value(rule: Rule, m: str) -> Column:
    top, bottom = (F.col(f"{m}.{x}") for x in rule.value.split(" / "))
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def base_failed(m: str) -> Column:
    words, repeats = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > 50 * words)


def sketch(measured: DataFrame, m: str = "m") -> DataFrame:
    """lang, source, rule, bin, n: sketches of every rule and every denominator for each group of the measured rows that pass the base rules."""
    entry = lambda name, x: F.struct(F.lit(name).alias("rule"), x.cast("double").alias("x"))
    values = F.array(*(entry(r.name, _value(r, m)) for r in RULES), *(entry(x, F.col(f"{m}.{x.split()[1]}")) for x in SIZES))
    bin_of = F.when(F.col("v.x") <= 0, ZERO_BIN).otherwise(F.ceil(F.log("v.x") / log(GAMMA))).cast("int")
    rows = measured.filter(~base_failed(m)).select("lang", "source", F.explode(values).alias("v"))
    return rows.groupBy("lang", "source", F.col("v.rule").alias("rule"), bin_of.alias("bin")).agg(F.count("*").alias("n"))


def _fences(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, and FENCES, from bin counts."""
    within = Window.partitionBy(*keys, "rule")
    value = F.when(F.col("bin") == ZERO_BIN, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin")) * (2 / (1 + GAMMA)))
    summed = counts.withColumns({"upto": F.sum("n").over(within.orderBy("bin")), "rows": F.sum("n").over(within), "x": value})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("x")))
    quantiles = summed.groupBy(*keys, "rule").agg(at(0.1).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"), F.max("rows").alias("rows"))
    of = lambda name, x: F.max(F.when(F.col("rule") == name, F.col(x)))

    def sides(r: Rule) -> list[Column]:
        mid = of(r.name, "mid")
        reach = F.lit(float(r.spread)) * F.greatest(mid - of(r.name, "low"), of(r.name, "high") - mid, F.lit(float(r.grain)) / of(r.size, "mid"))
        return [(mid + reach).alias(r.name)] + ([(mid - reach).alias(f"least {r.name}")] if r.both else [])

    return quantiles.groupBy(*keys).agg(F.max("rows").alias("rows"), *(c for r in RULES for c in sides(r)))


def fences(sketches: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """group (lang, source) and fence, a struct of the FENCES that hold for it; the sketches must be a written table."""
    by_lang = sketches.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n"))
    corpus = _fences(sketches.groupBy("rule", "bin").agg(F.sum("n").alias("n")), []).first()  # one row
    whole = {x: F.lit(corpus[x]).cast("double") for x in FENCES}
    lang = _fences(by_lang, ["lang"]).select(F.col("lang").alias("of_lang"), *(F.when(F.col("rows") >= min_rows, F.col(x)).otherwise(whole[x]).alias(f"lang {x}") for x in FENCES))
    group = _fences(sketches, ["lang", "source"])
    joined = group.join(lang, F.col("lang").eqNullSafe(F.col("of_lang")))
    return joined.select(F.struct("lang", "source").alias("group"), F.struct(*(F.when(F.col("rows") >= min_rows, F.col(x)).otherwise(F.col(f"lang {x}")).alias(x) for x in FENCES)).alias("fence"))


def limits_of(measured: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The fences of all groups of the measured rows (lang, source, m), as a written table."""
    return cut(fences(cut(sketch(measured), "sketches"), min_rows), "fences")


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The measured rows (lang, source, m and others) with base_failed and kept, in columns of the struct `verdict`."""
    # sources can be many, too many to broadcast, and one of them can be hot: its rows meet its fences in SALTS places
    limits = limits.select(F.col("group.lang").alias("__lang"), F.col("group.source").alias("__source"), F.col("fence").alias("__fence"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__part"))
    salted = measured.withColumn("__salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    joined = salted.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__part")), "left")
    passes = F.lit(True)
    for r in RULES:
        passes = passes & (_value(r, "m") <= F.col(f"__fence.`{r.name}`"))
        if r.both:
            passes = passes & (_value(r, "m") >= F.col(f"__fence.`least {r.name}`"))
    failed = base_failed("m")
    # a group without a document that passes the base rules has no fences
    return joined.withColumn("verdict", F.struct(failed.alias("base_failed"), (~failed & F.coalesce(passes, F.lit(False))).alias("kept"))).drop("__lang", "__source", "__fence", "__salt", "__part")


def quality_rules(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, m (measures), verdict (base_failed, kept) for every row."""
    measured = cut(docs.select("doc_id", "lang", "source", measures(F.col("text")).alias("m")), "measured")
    return judged(measured, limits_of(measured, min_rows)).select("doc_id", "m", "verdict")


def keep_good(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows of docs that pass, with docs' columns. Texts are measured twice, for the fences and for the verdict, and neither copied nor shuffled."""
    bound_batches(docs.sparkSession)
    names = docs.columns
    limits = limits_of(docs.select("lang", "source", measures(F.col("text")).alias("m")), min_rows)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "lang", "source", measures(F.col("text")).alias("m"))
    passed = judged(packed, limits).filter("verdict.kept")
    return passed.select(*(F.col(f"row.`{c}`") for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(f"m.{c}" for c in FIELDS[:5]), "verdict.base_failed", "verdict.kept")


def oracle() -> str:
    """The rows of query() as DuckDB SQL."""
    ratio = lambda r: (lambda top, low: f"CASE WHEN {low} > 0 THEN {top}::DOUBLE / {low} ELSE 0.0::DOUBLE END")(*r.value.split(" / "))
    named = {r.name: ratio(r) for r in RULES} | {x: f"{x.split()[1]}::DOUBLE" for x in SIZES}
    values = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS rule, {x} AS x FROM m WHERE NOT base_failed" for name, x in named.items())
    of = lambda name, x: f"max({x}) FILTER (rule = '{name}')"

    def sides(r: Rule) -> str:
        mid = of(r.name, "mid")
        reach = f"{float(r.spread)}::DOUBLE * greatest({mid} - {of(r.name, 'low')}, {of(r.name, 'high')} - {mid}, {float(r.grain)}::DOUBLE / {of(r.size, 'mid')})"
        return f'{mid} + {reach} AS "{r.name}"' + (f', {mid} - {reach} AS "least {r.name}"' if r.both else "")

    def level(keys: str) -> str:
        by = f"{keys}, " if keys else ""
        low, mid, high = (f"min(x) FILTER (rn >= {q}::DOUBLE * n)" for q in (0.1, 0.5, 0.75))
        ranked = f"SELECT *, row_number() OVER (PARTITION BY {by}rule ORDER BY bin) AS rn, count(*) OVER (PARTITION BY {by}rule) AS n FROM b"
        quantiles = f"SELECT {by}rule, max(n) AS n, {low} AS low, {mid} AS mid, {high} AS high FROM ({ranked}) GROUP BY {by}rule"
        return f"SELECT {by}max(n) AS n, {', '.join(map(sides, RULES))} FROM ({quantiles})" + (f" GROUP BY {keys}" if keys else "")

    fence = lambda x: f'CASE WHEN o.n >= {MIN_ROWS} THEN o."{x}" WHEN l.n >= {MIN_ROWS} THEN l."{x}" ELSE c."{x}" END'
    passes = " AND ".join([f"{ratio(r)} <= {fence(r.name)}" for r in RULES] + [f"{ratio(r)} >= {fence('least ' + r.name)}" for r in RULES if r.both])
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t)),
tri AS (SELECT doc_id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
sized AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM w GROUP BY doc_id),
m AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM
      (SELECT t.doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
       FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t) t LEFT JOIN sized USING (doc_id) LEFT JOIN repeated r USING (doc_id))),
v AS ({values}),
b AS (SELECT v.* REPLACE (CASE WHEN x <= 0 THEN 0.0::DOUBLE ELSE pow({GAMMA}::DOUBLE, bin) * {2 / (1 + GAMMA)!r}::DOUBLE END AS x), bin
      FROM (SELECT v.*, CASE WHEN x <= 0 THEN {ZERO_BIN} ELSE ceil(ln(x) / ln({GAMMA}::DOUBLE)) END AS bin FROM v) v),
own AS ({level("lang, source")}), by_lang AS ({level("lang")}), corpus AS ({level("")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({passes}, false) AS kept
FROM m LEFT JOIN own o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source LEFT JOIN by_lang l ON m.lang IS NOT DISTINCT FROM l.lang, corpus c
"""
