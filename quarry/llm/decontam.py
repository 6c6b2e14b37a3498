"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``span`` consecutive words of a benchmark item.  Both sides hash every
run of k words and keep, of each ``span - k + 1`` neighbouring runs, the least
hash (the leftmost of equals).  A document that holds a window therefore keeps
the very run that the window keeps, at the same place in it, so an equi-join of
kept hashes meets every shared span; comparing the whole window then extends a
hit and discards chance matches.  Items shorter than a window are windows of
their own length, for which every run of that length is kept.

The benchmark's windows go to the executors only while they are fewer than
``broadcast_bytes``; then no text is shuffled, and the words that the comparison
needs are at hand in the same generated code.  Beyond that, the documents' kept
hashes meet the windows in a shuffled join and only documents with a hit are
joined with their words again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lower_ascii, materialize, table, text_of

#: What parts two words once A-Z are lower case.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text_col: str) -> Column:
    """The lower-case words of a text; none for null."""
    return F.array_remove(F.split(lower_ascii(text_of(text_col)), BREAKS), "")


def _hashed(run: Column, at: Column) -> Column:
    """A run's hash above its place, so that the least value is the least hash, leftmost."""
    return F.shiftleft(F.xxhash64(run), 32).bitwiseOR(at.cast("long"))


def _runs(words: Column, length: int) -> Column:
    n = F.size(words) - (length - 1)
    made = F.transform(F.sequence(F.lit(1), n), lambda i: _hashed(F.slice(words, i, length), i))
    return F.when(n >= 1, made).otherwise(F.array().cast("array<long>"))


def _windows(benchmark: DataFrame, span: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each distinct window: wid, window (words), length, h and off (kept hash and its place, from 0), items (ids as text)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(text_col).alias("words")).filter(F.size("words") > 0)
    n = F.size("words")
    long = items.filter(n >= span).select("item", "words", F.explode(F.sequence(F.lit(1), n - (span - 1))).alias("s"))
    long = long.select("item", F.slice("words", F.col("s"), span).alias("run"))
    both = long.unionByName(items.filter(n < span).select("item", F.col("words").alias("run")))
    one = both.groupBy("run").agg(F.sort_array(F.collect_set("item")).alias("items"))
    w = F.col("run")
    kept = F.when(F.size(w) == span, F.array_min(_runs(w, k))).otherwise(_hashed(w, F.lit(1)))
    return one.select(
        F.monotonically_increasing_id().alias("wid"), F.array_join(w, " ").alias("window"), F.size(w).alias("length"), "items",
        F.shiftright(kept, 32).alias("h"), (kept.bitwiseAND(F.lit(0xFFFFFFFF)) - 1).cast("int").alias("off"))


def _kept_runs(docs: DataFrame, span: int, k: int, short: list[int]) -> DataFrame:
    """doc_id, row, words and kept: the array of kept values of each document with words."""
    n = F.size("runs") - (span - k)  # this second use of runs also keeps Catalyst from inlining it into the lambda, once for each element
    least = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_min(F.slice(F.col("runs"), i, span - k + 1)))
    long = F.when(n >= 1, F.array_distinct(least)).otherwise(F.array().cast("array<long>"))
    each = [_runs(F.col("words"), m) for m in short]
    return docs.withColumn("runs", _runs(F.col("words"), k)).select("doc_id", "row", "words", F.concat(long, *each).alias("kept"))


def find_hits(docs: DataFrame, windows: DataFrame, span: int, k: int, broadcast_bytes: int) -> DataFrame:
    """doc_id, row, start, length, wid of every occurrence of a window; docs: doc_id, row, words."""
    sizes = windows.groupBy("length").agg(F.sum(F.octet_length("window") + 64).alias("bytes")).collect()  # at most span rows
    known = {r["length"]: r["bytes"] for r in sizes}
    kept = _kept_runs(docs, span, k, sorted(m for m in known if m < span))
    start = F.col("pos") - F.col("off")
    here = F.when(start >= 1, F.array_join(F.slice("words", F.greatest(start, F.lit(1)), F.col("length")), " ") == F.col("window"))
    # the outer form, as the inner one adds a filter on the array that Catalyst pushes below, computing it again for each element
    runs = kept.select("doc_id", "row", "words", F.explode_outer("kept").alias("v"))
    place = F.col("v").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos")
    found = ["doc_id", "row", start.alias("start"), "length", "wid"]
    if sum(known.values()) <= broadcast_bytes:
        met = runs.select("doc_id", "row", "words", F.shiftright("v", 32).alias("h"), place)
        return met.join(F.broadcast(windows.drop("items")), "h").filter(here).select(*found)
    met = runs.select("doc_id", "row", F.shiftright("v", 32).alias("h"), place).join(windows.select("h", "off", "length", "wid"), "h")
    met = met.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "pos", "off", "length", "wid")
    mine = (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    # words are shuffled only of documents with a kept run of some window
    again = docs.join(met.select("_d", "_r").distinct(), mine, "left_semi").dropDuplicates(["doc_id", "row"]).join(met, mine)
    return again.join(windows.select("wid", "window"), "wid").filter(here).select(*found)


def _covered(spans: Column) -> Column:
    """How many words the spans (start, length), sorted by start, cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))

    def add(acc, s):
        end = F.greatest(acc["end"], s["start"] + s["length"])
        return F.struct(end.alias("end"), (acc["sum"] + end - F.greatest(acc["end"], s["start"])).alias("sum"))

    fresh = lambda acc, s: F.when(s["start"] + s["length"] > acc["end"], add(acc, s)).otherwise(acc)
    return F.aggregate(spans, start, fresh, lambda acc: acc["sum"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, broadcast_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as text), spans (start, length; from 1), contaminated of every row.

    Null and wordless texts have no words and no hits; items without words are no
    windows, and an item with a null id hits but isn't listed.  Repeated rows get
    equal results; an empty benchmark hits nothing; no other columns are read.
    A document's spans are gathered in one row, as its text is.
    """
    row = F.xxhash64(F.lit("row"), text_of(text_col)).alias("row")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), row, words_of(text_col).alias("words"))
    windows = materialize(_windows(benchmark, span, k, item_col, item_text_col), "windows")
    hits = find_hits(given, windows, span, k, broadcast_bytes)
    spans = hits.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"), F.collect_set("wid").alias("wids"))
    hit = materialize(spans, "hits")
    listed = hit.select("doc_id", "row", F.explode("wids").alias("wid")).join(windows.select("wid", "items"), "wid")
    listed = listed.select("doc_id", "row", F.explode("items").alias("item")).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    keys = [F.col("doc_id").alias("_d"), F.col("row").alias("_r")]
    same = (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    found = hit.select("doc_id", "row", "spans").join(listed.select(*keys, "items"), same, "left").select(*keys, "spans", "items")
    sized = given.select("doc_id", "row", F.size("words").cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return sized.join(found, same, "left").select(
        "doc_id", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        items.alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"), F.col("spans").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, broadcast_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of the benchmark.

    Null and wordless texts, and all rows where the benchmark is empty, stay; repeated rows
    stay or go alike; an empty table stays empty.
    """
    row = F.xxhash64(F.lit("row"), text_of(text_col))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), words_of(text_col).alias("words"))
    windows = materialize(_windows(benchmark, span, k, item_col, item_text_col), "windows")
    hits = find_hits(given, windows, span, k, broadcast_bytes).select(F.col("doc_id").alias("_hit_doc"), F.col("row").alias("_hit_row")).distinct()
    same = (row == F.col("_hit_row")) & F.col(id_col).cast("long").eqNullSafe(F.col("_hit_doc"))
    return docs.join(materialize(hits, "hits"), same, "left_anti")


def op8_winnow_decontam(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = rf"""
WITH i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
i2 AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
i3 AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i2),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM i3),
d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
d2 AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
d3 AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM d2),
h AS (SELECT DISTINCT doc_id, d3.n AS n, s, item_id FROM d3 JOIN win ON d3.n = win.n AND d3.t = win.t),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, n, s FROM h)) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""
