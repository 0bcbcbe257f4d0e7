"""Benchmark decontamination through a distributed positional inverted index. DataFrame functions only.

1. Index: postings (term, row, position) of training tokens are stored in the shared folder. For exact phrases a token is posted
   if it stands beside a neighbour that it has in some benchmark item too (or is an item by itself): every word of an
   occurrence of a window does, and few others do, so the index stays small where training texts share the benchmark's
   vocabulary. For proximity matches every token that is a benchmark term is posted. A row is named by a digest of its id and text.
2. Anchors: in each window of an item (10 words, or the whole of a shorter item) the term with the fewest postings. An
   occurrence of a window holds its anchor, so postings of anchors, less their offset in the item, give all candidate alignments
   (item, row, shift).
3. Intersection: an alignment's expected postings (term j at shift + j) meet the index; j's that are there in runs of at
   least a window's length are exact phrase matches. With a smaller `least` share of a window's words the same lists
   give proximity matches.

The plan is the same however many documents there are; they are never broadcast. The benchmark's own tables (terms, neighbours,
anchors) are broadcast up to TERM_LIMIT counted rows; a larger benchmark is joined by shuffle.

A null text has no words. A null item id is no item. Repeated items of one id count once; repeated documents are rows of
their own, and identical ones have the same hits. Empty tables give no hits. Only the named id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, UPPER, materialize, row_key, table, text_sha256, texts

WINDOW = 10
#: What stands between words; lower-casing A-Z afterwards moves no boundary.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of the benchmark's side up to which it is broadcast; they are short: a term or two, two numbers.
TERM_LIMIT = 1_000_000


def words(text: str):
    """Words of a text column as they stand: digits, ASCII letters and all that is not ASCII."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN), "")


def lowered(word):
    """A-Z of one word in lower case; most words have none and are left as they are."""
    return F.when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= TERM_LIMIT else df


def benchmark_terms(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item (a number of each distinct text of an id), item_id, n, w (its windows' length), j, term."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.transform(words(text_col), lowered).alias("words")).where("item_id is not null and size(words) > 0").distinct()
    numbered = items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.size("words").alias("n"))
    return numbered.select("item", "item_id", "n", F.least("n", F.lit(window)).alias("w"), F.posexplode("words").alias("j", "term"))


def neighbours(items: DataFrame) -> DataFrame:
    """first, second: terms that stand side by side in an item; second is null for an item of one word."""
    after = items.select("item", (F.col("j") - 1).alias("j"), F.col("term").alias("second")).where("j >= 0").distinct()
    pairs = items.join(after, ["item", "j"]).select(F.col("term").alias("first"), "second")
    return pairs.unionAll(items.where("n = 1").select(F.col("term").alias("first"), F.lit(None).cast("string"))).distinct()


def index(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """docs: row, words. Postings of all tokens that are terms of the benchmark: term_id, row, pos."""
    tokens = docs.select("row", F.posexplode("words").alias("pos", "word")).select("row", "pos", lowered(F.col("word")).alias("term"))
    return tokens.join(_small(terms, n_terms), "term").select("term_id", "row", "pos")


def neighbour_index(docs: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """docs: row, words. Postings of tokens beside a neighbour of theirs: term_id, row, pos; a token with two of them may come twice."""
    two = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))
    tokens = docs.select("row", F.posexplode(two).alias("pos", "x")).select("row", "pos", lowered(F.col("x.a")).alias("first"), lowered(F.col("x.b")).alias("second"))
    beside = pairs.where("second is not null").select("first", "second", F.xxhash64("first").alias("one"), F.xxhash64("second").alias("two"))
    found = tokens.join(_small(beside, n_pairs), ["first", "second"])
    place = lambda term, at: F.struct(F.col(term).alias("term_id"), (F.col("pos") + at).alias("pos"))
    both = found.select("row", F.explode(F.array(place("one", 0), place("two", 1))).alias("x")).select("x.term_id", "row", "x.pos")
    alone = pairs.where("second is null").select("first", F.xxhash64("first").alias("term_id"))
    if alone.isEmpty():
        return both
    single = tokens.select("row", "pos", "first").join(_small(alone, n_pairs), "first").select("term_id", "row", "pos")
    return both.unionAll(single)


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least: float = 1.0) -> DataFrame:
    """docs with row; the hits: row, pos, item_id. least: share of a window's words that must stand in their places."""
    items = materialize(benchmark_terms(benchmark, item_id_col, item_text_col, window), "decon-items")
    rows = docs.select("row", words(text_col).alias("words"))
    if least >= 1.0 and window > 1:
        pairs = materialize(neighbours(items), "decon-pairs")
        postings = neighbour_index(rows, pairs, pairs.count())
    else:
        terms = materialize(items.select("term").distinct().select("term", F.xxhash64("term").alias("term_id")), "decon-terms")
        postings = index(rows, terms, terms.count())
    postings = materialize(postings, "decon-index")
    df = materialize(postings.groupBy("term_id").agg(F.count("*").alias("df")), "decon-df")
    known = items.select("item", "item_id", "n", "w", "j", F.xxhash64("term").alias("term_id"))
    counted = materialize(known.join(df, "term_id", "left").select("item", "item_id", "n", "w", "j", "term_id", F.coalesce("df", F.lit(0)).alias("df")), "decon-known")
    anchors = materialize(_anchors(counted, least), "decon-anchors")
    shifts = postings.join(_small(anchors, anchors.count()), "term_id").select("item", "row", (F.col("pos") - F.col("j")).alias("shift")).distinct()
    places = materialize(counted.select("item", "n", "w", "j", "term_id").distinct(), "decon-places")
    expected = shifts.join(_small(places, places.count()), "item").select("row", (F.col("shift") + F.col("j")).alias("pos"), "term_id", "item", "shift", "j", "w", "n").where("pos >= 0")
    matched = postings.join(expected, ["row", "pos", "term_id"]).select("item", "row", "shift", "j", "w", "n")
    return _runs(matched, least).join(counted.select("item", "item_id").distinct(), "item").select("row", "pos", "item_id").distinct()


def _anchors(counted: DataFrame, least: float) -> DataFrame:
    """(item, j, term_id) of each window's rarest terms: one, or as many more as a proximity match may lack."""
    spare = Window.partitionBy("item", "start").orderBy("df", "j")
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("j") - F.col("w") + 1), F.least(F.col("j"), F.col("n") - F.col("w"))))
    need = F.ceil(F.col("w") * F.lit(least) - 1e-9)
    ranked = counted.select("item", "w", "j", "term_id", "df", start.alias("start")).withColumn("rank", F.row_number().over(spare))
    return ranked.where(F.col("rank") <= F.col("w") - need + 1).select("item", "j", "term_id").distinct()


def _runs(matched: DataFrame, least: float) -> DataFrame:
    """item, row, pos of matched words that lie in an occurring window."""
    if least >= 1.0:
        same = Window.partitionBy("item", "row", "shift")
        # identical rows share a name and a token may be posted twice, so a j may come more than once
        runs = matched.withColumn("run", F.col("j") - F.dense_rank().over(same.orderBy("j")))
        run = Window.partitionBy("item", "row", "shift", "run")
        long = runs.withColumn("length", F.max("j").over(run) - F.min("j").over(run) + 1)
        return long.where("length >= w").select("item", "row", (F.col("shift") + F.col("j")).alias("pos"))
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("j") - F.col("w") + 1), F.least(F.col("j"), F.col("n") - F.col("w"))))
    full = matched.select("item", "row", "shift", "j", "w", start.alias("start")).groupBy("item", "row", "shift", "start").agg(F.collect_set("j").alias("js"), F.first("w").alias("w"))
    kept = full.where(F.size("js") >= F.ceil(F.col("w") * F.lit(least) - 1e-9))
    return kept.select("item", "row", F.explode("js").alias("j"), "shift").select("item", "row", (F.col("shift") + F.col("j")).alias("pos"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least: float = 1.0) -> DataFrame:
    """row (its name, as row_key gives it), doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per input row."""
    numbered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(F.col(id_col), text_sha256(text_col)).alias("row"))
    hits = find(numbered, benchmark, "text", item_id_col, item_text_col, window, least)
    ids = F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string")))
    by_row = hits.groupBy("row").agg(F.countDistinct("pos").alias("n_hit"), ids.alias("items"))
    sizes = numbered.select("row", "doc_id", F.size(words("text")).cast("long").alias("n_words"))
    joined = sizes.join(materialize(by_row, "decon-hits"), "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS w, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, w, s, array_to_string(ws[s:s + w - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS s FROM d, (SELECT DISTINCT w FROM iw))
), h AS (
  SELECT doc_id, item_id, s, dw.w FROM dw JOIN iw USING (w, gram)
), p AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + w)) AS pos FROM h) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
"""
