"""Quality rules: repetition and symbol counts, and the divergence of a document from its language.

A document's histograms of character classes and of common words are compared with those of all text in its language by
Jensen-Shannon distance; short documents are spared by minimum lengths. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import SPACES, discard, materialize, words_of
from ledgerlark.session import table

#: Character classes in the order in which they are taken out of a text.
CLASSES = (("lower", r"\p{Ll}+"), ("space", SPACES), ("upper", r"\p{Lu}+"), ("symbol", r"[#*$%&|<>]+"), ("digit", r"\p{Nd}+"), ("letter", r"\p{L}+"))
WINDOW_WORDS = 8


def with_classes(df: DataFrame, text: str) -> DataFrame:
    """Adds counts, the number of code points in each class, other ones last. Each step scans only what the steps
    before have left, and takes whole runs out."""
    df = df.withColumn("_left", F.col(text))
    found = []
    for name, pattern in CLASSES:
        df = df.withColumn("_next", F.regexp_replace("_left", pattern, "")).withColumn(f"_{name}", F.char_length("_left") - F.char_length("_next"))
        df = df.withColumn("_left", F.col("_next"))
        found.append(F.col(f"_{name}"))
    df = df.withColumn("counts", F.transform(F.array(*found, F.char_length("_left")), lambda x: x.cast("double")))
    return df.drop("_left", "_next", *(f"_{name}" for name, _ in CLASSES))


def _tail(a: str, k: int) -> Column:
    """The array from its element k+1 on, without what would stick out."""
    return F.expr(f"slice({a}, {k + 1}, greatest(size({a}) - {k}, 0))")


def _head(a: str, k: int) -> Column:
    return F.expr(f"slice({a}, 1, greatest(size({a}) - {k}, 0))")


def with_window_hashes(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the 64-bit hashes of all 8-word windows, by pairing hashes of words, pairs and fours."""
    df = df.withColumn("_w1", F.transform(words, lambda w: F.xxhash64(w)))
    for done in (1, 2, 4):
        df = df.withColumn(f"_w{2 * done}", F.zip_with(_head(f"_w{done}", done), _tail(f"_w{done}", done), lambda a, b: F.xxhash64(a, b)))
    return df.withColumn(out, F.col("_w8")).drop("_w1", "_w2", "_w4", "_w8")


def with_repeated_words(df: DataFrame, windows: str, out: str) -> DataFrame:
    """Adds the number of words in windows that are found twice or more. Only texts with such a window sort theirs."""
    df = df.withColumn("_dup", F.size(F.array_distinct(windows)) < F.size(windows))
    df = df.withColumn("_sorted", F.when(F.col("_dup"), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_before", F.when(F.col("_dup"), F.concat(F.expr("array(cast(null as struct<h:bigint,i:int>))"), _head("_sorted", 1))))
    df = df.withColumn("_after", F.when(F.col("_dup"), F.concat(_tail("_sorted", 1), F.expr("array(cast(null as struct<h:bigint,i:int>))"))))
    df = df.withColumn("_same", F.zip_with("_sorted", "_before", lambda s, b: F.struct(s["h"].alias("h"), s["i"].alias("i"), s["h"].eqNullSafe(b["h"]).alias("same"))))
    df = df.withColumn("_starts", F.sort_array(F.array_compact(F.zip_with("_same", "_after", lambda s, a: F.when(s["same"] | s["h"].eqNullSafe(a["h"]), s["i"])))))
    df = df.withColumn("_steps", F.zip_with("_starts", F.concat(_tail("_starts", 1), F.expr("array(cast(null as int))")), lambda a, b: F.least(F.lit(WINDOW_WORDS), F.coalesce(b - a, F.lit(WINDOW_WORDS)))))
    df = df.withColumn(out, F.coalesce(F.aggregate("_steps", F.lit(0).cast("bigint"), lambda t, x: t + x), F.lit(0).cast("bigint")))
    return df.drop("_dup", "_sorted", "_before", "_after", "_same", "_starts", "_steps")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, from 0 to 1, of two arrays of shares."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda t, x: t + x), F.lit(0.0)) / 2)


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


#: Different common words of all languages together up to which they are looked up as one set.
MOST_LISTED = 4096


def common_words(docs: DataFrame, common: int = 32) -> DataFrame:
    """(lang, text) -> lang, top (rank, word, n): the most common words of each language. Ties go to the smaller word."""
    docs = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").where("text is not null")
    counted = docs.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= common)
    return top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))


def _referred(top: DataFrame, classed: DataFrame) -> DataFrame:
    """Common words and classed texts (lang, counts, n_words) -> lang, chars, words, word_shares."""
    summed = classed.groupBy("lang").agg(F.sum("n_words").alias("n_words"), *(F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)))
    chars = F.array(*(F.col(f"c{i}") for i in range(len(CLASSES) + 1)))
    summed = summed.select("lang", "n_words", shares(chars, F.aggregate(chars, F.lit(0.0), lambda t, x: t + x)).alias("chars"))
    both = summed.join(top, "lang").withColumn("n", F.transform("top", lambda x: x["n"].cast("double")))
    rest = F.array(F.col("n_words") - F.aggregate("n", F.lit(0.0), lambda t, x: t + x))
    return both.select("lang", "chars", F.transform("top", lambda x: x["word"]).alias("words"), shares(F.concat("n", rest), F.col("n_words").cast("double")).alias("word_shares"))


def references(docs: DataFrame, common: int = 32) -> DataFrame:
    """(lang, text) -> lang, chars, words, word_shares: of all text of each language (a null one is '') the shares of
    character classes, the most common words and their shares, the rest last. Ties go to the smaller word."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").where("text is not null")
    return _referred(common_words(docs, common), with_classes(rows, "text").withColumn("n_words", F.size(words_of(F.col("text")))))


def _measured(docs: DataFrame, words: DataFrame) -> DataFrame:
    """All that a text tells, in one pass over it: words (lang, words) are the common words that are counted in it."""
    listed = words.select(F.explode("words").alias("w")).distinct().limit(MOST_LISTED + 1).collect()
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.col("text").isNotNull().alias("there"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(words, "lang", "left")  # a row per language: Spark broadcasts it as long as it is small
    rows = rows.withColumn("n_chars", F.char_length("text"))
    rows = with_classes(rows, "text")
    rows = rows.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")).drop("_lines")
    rows = rows.withColumn("_words", words_of(F.col("text")))
    rows = rows.withColumn("n_words", F.size("_words").cast("bigint"))
    rows = with_window_hashes(rows, "_words", "_windows").drop("_words")
    rows = with_repeated_words(rows, "_windows", "n_repeat_words").drop("_windows")
    # One set for all languages is looked up at once; past its bound each word is compared with its language's own.
    few = [r[0] for r in listed] if len(listed) <= MOST_LISTED else None
    in_list = (lambda w: F.array_contains("words", w)) if few is None else (lambda w: w.isin(few)) if few else (lambda _: F.lit(False))
    rows = rows.withColumn("_hits", F.filter(words_of(F.lower("text")), in_list)).drop("text")
    rows = rows.withColumn("found", F.transform("words", lambda c: (F.size("_hits") - F.size(F.array_remove("_hits", c))).cast("double")))
    return rows.select("doc_id", "lang", "there", "n_chars", "counts", "n_dup_lines", "n_words", "n_repeat_words", "found")


def judge(docs: DataFrame, reference: DataFrame | None = None, least_words: int = 80, most_chars: float = 0.28, most_words: float = 0.37) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    The reference is that of docs themselves unless given. A document of least_words words or more goes when its
    distance to its language is over most_chars for character classes or most_words for common words; shorter ones,
    and those whose language has no reference, only have the base rules. A null text has no words and fails the base
    rules; a null lang is a language of its own. Windows are compared by 64-bit hashes. Repeated rows are judged each by
    itself; an empty table gives an empty result.
    """
    if reference is None:
        top = materialize(common_words(docs), "common-words")
        rows = materialize(_measured(docs, top.select("lang", F.transform("top", lambda x: x["word"]).alias("words"))), "measured")
        refs = materialize(_referred(top, rows.where("there")), "references")
        discard(top)
    else:
        refs = materialize(reference, "references")
        rows = _measured(docs, refs.select("lang", "words"))
    rows = rows.join(refs.select("lang", "chars", "word_shares"), "lang", "left")
    rows = rows.withColumn("_rest", F.col("n_words") - F.aggregate("found", F.lit(0.0), lambda t, x: t + x))
    far_words = distance(shares(F.concat("found", F.array("_rest")), F.col("n_words").cast("double")), F.col("word_shares"))
    far_chars = distance(shares(F.col("counts"), F.col("n_chars").cast("double")), F.col("chars"))
    names = [name for name, _ in CLASSES]
    rows = rows.select(
        "doc_id", "n_words", (F.col("n_chars") - F.col("counts")[names.index("space")]).cast("bigint").alias("word_chars"),
        F.col("counts")[names.index("symbol")].cast("bigint").alias("n_symbols"), "n_dup_lines", "n_repeat_words", far_words.alias("far_words"), far_chars.alias("far_chars"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.col("n_words") >= least_words) & ((F.col("far_chars") > most_chars) | (F.col("far_words") > most_words))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(far, F.lit(False)))


def op2_language_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("far_words", "far_chars")


QUERIES = {"op2_language_divergence": op2_language_divergence}

_CLASS_SQL = [r"\p{Ll}", r"[\x20\x09-\x0D]", r"\p{Lu}", r"[#*$%&|<>]", r"\p{Nd}", r"[\p{Lt}\p{Lm}\p{Lo}]"]
_COUNTS_SQL = ", ".join(f"length(text) - length(regexp_replace(text, '{c}', '', 'g')) AS c{i}" for i, c in enumerate(_CLASS_SQL))
_REST_SQL = "length(text) - " + " - ".join(f"c{i}" for i in range(len(_CLASS_SQL)))


def _part_sql(p: str, q: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END"


ORACLE_SQL = {
    "op2_language_divergence": rf"""
        WITH d AS MATERIALIZED (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, text IS NOT NULL AS there, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), c0 AS MATERIALIZED (SELECT doc_id, lang, text, there, len(ws) AS n_words, {_COUNTS_SQL} FROM d
        ), c AS MATERIALIZED (SELECT *, {_REST_SQL} AS c6, length(text) AS n_chars FROM c0
        ), lines AS (
            SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
        ), win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
        ), rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
        ), cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(8) t(j) GROUP BY 1
        ), chars AS (SELECT lang, CAST(sum(n_chars) AS DOUBLE) AS total, sum(n_words) AS words, {", ".join(f"sum(c{i}) AS r{i}" for i in range(7))} FROM c WHERE there GROUP BY 1
        ), far_c AS (
            SELECT doc_id, sqrt(greatest(0, ({" + ".join("(" + _part_sql(f"(c{i} / greatest(n_chars, 1))", f"(r{i} / greatest(total, 1))") + ")" for i in range(7))}) / 2)) AS far_chars FROM c JOIN chars USING (lang)
        ), low AS MATERIALIZED (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS word FROM d
        ), top AS (SELECT lang, word, count(*) AS n FROM low GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) <= 32
        ), got AS (SELECT doc_id, word, count(*) AS k FROM low GROUP BY 1, 2
        ), pq AS (
            SELECT c.doc_id, coalesce(k, 0) / greatest(n_words, 1) AS p, top.n / words AS q FROM c JOIN chars USING (lang) JOIN top USING (lang) LEFT JOIN got ON got.doc_id = c.doc_id AND got.word = top.word
            UNION ALL
            SELECT c.doc_id, (any_value(n_words) - coalesce(sum(k), 0)) / greatest(any_value(n_words), 1), (any_value(words) - sum(top.n)) / any_value(words)
            FROM c JOIN chars USING (lang) JOIN top USING (lang) LEFT JOIN got ON got.doc_id = c.doc_id AND got.word = top.word GROUP BY c.doc_id
        ), far_w AS (SELECT doc_id, sqrt(greatest(0, sum({_part_sql("p", "q")}) / 2)) AS far_words FROM pq GROUP BY 1
        ), base AS (
            SELECT c.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_chars - c1 AS BIGINT) AS word_chars, CAST(c3 AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * coalesce(cov.n, 0) > 30 * n_words AS base_failed
            FROM c JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)
        )
        SELECT base.*, NOT base_failed AND NOT coalesce(n_words >= 80 AND (far_chars > 0.28 OR far_words > 0.37), false) AS kept FROM base LEFT JOIN far_c USING (doc_id) LEFT JOIN far_w USING (doc_id)
    """,
}
