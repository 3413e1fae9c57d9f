"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

Every window of an item (13 consecutive words, or all of a shorter item) is a set of
word shingles of up to GRAM words.  A document can only contain a window if it
contains every shingle of it, so one necessary shingle, the window's rarest over the
whole corpus, is its prefix:

1. count how often each benchmark shingle occurs in all documents;
2. give each window its rarest shingle as prefix, with the shingle's place in it;
3. join the documents' places of prefix shingles with the windows; a match fixes where
   the window would start, and the document's length and the window's bounds must
   allow that;
4. compare the document's words there with the window's.

The texts are cut into words once for steps 1 and 3: a row for each place of a benchmark
shingle, and one for each document with its number of words.  Only the texts in which a
prefix was found are read again.  The benchmark's side of each join is broadcast only
while its own count is below BROADCAST_ROWS; beyond, it is an equality join that is
shuffled with the hot shingles' rows spread by a salt.  Windows carry ids; the items that
share a window are named once for each different set of windows that documents have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreforge.llm.common import fresh, table, text_or_empty, written

WINDOW, GRAM = 13, 4
#: Contaminated: at least one of so many words is hit.
ONE_IN = 20
BROADCAST_ROWS, SALTS = 200_000, 64
#: Runs of what is no letter of a word: ASCII but digits and letters.
_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z lower-cased, cut into words."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, _GAP), "")


def _grams(w: str, n: int) -> str:
    """SQL of the places and hashes of all runs of n words, in order."""
    parts = ", ".join(f"get({w}, i + {k})" for k in range(n))
    return f"transform(if(size({w}) < {n}, cast(array() as array<int>), sequence(0, size({w}) - {n})), i -> named_struct('g', {n}, 'p', i, 'h', xxhash64({parts})))"


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """wid, ws (words), n and item of every window of every item that has words."""
    src = items.select(F.col("item_id").cast("string").alias("item"), words(text_or_empty("text")).alias("w")).where("size(w) > 0")
    each = src.select("item", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")).alias("at"))
    each = each.select("item", F.expr(f"slice(w, at + 1, {window})").alias("ws")).distinct()
    return each.select(F.xxhash64("ws").alias("wid"), "ws", F.size("ws").alias("n"), "item")


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def occurrences(src: DataFrame, windows: DataFrame, *, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(k, kk, th, n_words of every row of ``src``; kk, th, from, to, wid of each place where a text has a window).

    ``src``: k, text, and kk, th, which name a key and text; ``windows``: wid, ws, n, once each.  Places are words from 0, ends exclusive.
    """
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(gram))).distinct().collect())  # at most ``gram`` of them
    parts = [windows.where(F.least("n", F.lit(gram)) == n).select("wid", F.explode(F.expr(_grams("ws", n))).alias("x")) for n in sizes]
    in_windows = windows.select("wid", F.expr("named_struct('g', 0, 'p', 0, 'h', 0L)").alias("x")).limit(0)
    for part in parts:
        in_windows = in_windows.unionAll(part)
    in_windows = written(in_windows.select("wid", "x.g", F.col("x.p").alias("off"), "x.h"), "shingles")

    def met(places: DataFrame, side: DataFrame) -> DataFrame:
        if _few(side):
            return places.join(F.broadcast(side), ["g", "h"])
        salted = side.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        return places.withColumn("salt", F.expr(f"cast(pmod(xxhash64(p, kk, th), {SALTS}) as int)")).join(salted, ["g", "h", "salt"]).drop("salt")

    # Each text's number of words stands as the place of a shingle of no words.
    whole = in_windows.select("g", "h").distinct().unionAll(src.sparkSession.range(1).select(F.lit(0).alias("g"), F.lit(0).cast("bigint").alias("h")))
    arrays = ["array(named_struct('g', 0, 'p', size(w), 'h', 0L))", *[_grams("w", n) for n in sizes]]
    each = src.select("k", "kk", "th", words(F.col("text")).alias("w")).select("k", "kk", "th", F.explode(F.expr(f"concat({', '.join(arrays)})")).alias("x"))
    hits = written(met(each.select("k", "kk", "th", "x.*"), written(whole, "wanted")), "hits")
    sized = hits.where("g = 0").select("k", "kk", "th", F.col("p").cast("bigint").alias("n_words"))
    hits = hits.where("g > 0").drop("k")

    counted = in_windows.join(hits.groupBy("g", "h").agg(F.count("*").alias("df")), ["g", "h"], "left")
    rarest = F.min_by(F.struct("g", "h", "off"), F.struct(F.coalesce("df", F.lit(0)), "h", "off"))
    prefix = counted.groupBy("wid").agg(rarest.alias("x"), F.min(F.coalesce("df", F.lit(0))).alias("df")).where("df > 0")
    prefix = written(prefix.select("wid", "x.*").join(windows.select("wid", "n"), "wid"), "prefixes")
    found = met(hits, prefix).where("p >= off").select("kk", "th", "wid", (F.col("p") - F.col("off")).alias("from"), "n")
    found = written(found.join(sized.select("kk", "th", "n_words").distinct(), ["kk", "th"]).where("`from` + n <= n_words").drop("n_words").distinct(), "found")

    some = written(found.select("kk", "th").distinct(), "some")
    texts = src.select("kk", "th", "text").join(F.broadcast(some) if _few(some) else some, ["kk", "th"], "left_semi")
    checked = found.join(texts.select("kk", "th", words(F.col("text")).alias("w")), ["kk", "th"])
    cut = checked.select("kk", "th", "wid", "from", "n", F.expr("slice(w, `from` + 1, n)").alias("has"))
    ws = windows.select("wid", "ws")
    if _few(ws):
        same = cut.join(F.broadcast(ws), "wid")
    else:
        salted = ws.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
        same = cut.withColumn("salt", F.expr(f"cast(pmod(xxhash64(kk, th, `from`), {SALTS}) as int)")).join(salted, ["wid", "salt"])
    return sized, same.where("has = ws").select("kk", "th", "from", (F.col("from") + F.col("n")).alias("to"), "wid")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, text, kk and th: rows that agree in kk and th have equal keys and texts."""
    src = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("text"))
    return src.withColumns({"kk": F.coalesce(F.col("k").cast("string"), F.lit("null")), "th": F.xxhash64("text")})


def _hits(src: DataFrame, items: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(n_words of all rows, see ``occurrences``; kk, th, n_hit, longest (words of the longest window that occurs) and wids of the texts in which a window occurs; wid and item of all windows)."""
    of_items = written(item_windows(items, window), "windows")
    windows = written(of_items.select("wid", "ws", "n").distinct(), "different")
    sized, found = occurrences(src, windows, gram=gram)
    found = written(found.groupBy("kk", "th", "from").agg(F.max("to").alias("to"), F.collect_set("wid").alias("wids")), "places")  # a window of each size at most
    before = Window.partitionBy("kk", "th").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("to") - F.greatest(F.col("from"), F.coalesce(F.max("to").over(before), F.lit(0))))
    hit = found.withColumn("new", new).groupBy("kk", "th").agg(F.sum("new").alias("n_hit"), F.max(F.col("to") - F.col("from")).alias("longest"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("wids")))).alias("wids"))
    return sized, hit, of_items.where("item is not null").select("wid", "item")


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", *, window: int = WINDOW, gram: int = GRAM, one_in: int = ONE_IN) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    A null text has no words; so has an item's, and an item without words is in no
    document.  Rows with equal keys and other texts are told apart by the text's
    hash; repeated rows get equal results.  Repeated items count once, items with
    a null id mark words but aren't counted.  No documents: no rows; no items: none
    is contaminated.
    """
    sized, hit, of_windows = _hits(_keyed(docs, key, text), items, window, gram)
    hit = written(hit.withColumn("cid", F.xxhash64("wids")), "hit")
    sets = hit.groupBy("cid").agg(F.first("wids").alias("wids")).select("cid", F.explode("wids").alias("wid"))
    named = sets.join(of_windows, "wid").groupBy("cid").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    named = named.select("cid", F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    out = sized.join(hit.select("kk", "th", "n_hit", "cid").join(named, "cid", "left"), ["kk", "th"], "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint")
    return out.select(
        F.col("k").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", *, window: int = WINDOW, gram: int = GRAM, one_in: int = ONE_IN) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of ``window`` words occurs and that aren't contaminated (see ``report``).

    A whole window is a leak however long the document is; shorter items (a word or
    two may stand anywhere) count by the share of words that they hit.
    """
    sized, hit, _ = _hits(_keyed(docs, key, text), items, window, gram)
    bad = hit.select("kk", "th", "n_hit", "longest").join(sized.select("kk", "th", "n_words").distinct(), ["kk", "th"])
    bad = written(bad.where((F.col("longest") >= window) | (F.col("n_hit") * one_in >= F.col("n_words"))).select("kk", "th"), "contaminated")
    kk, th = fresh(docs.columns, "kk", "th")
    marked = docs.withColumns({kk: F.coalesce(F.col(key).cast("string"), F.lit("null")), th: F.xxhash64(text_or_empty(text))})
    bad = bad.toDF(kk, th)
    return marked.join(F.broadcast(bad) if _few(bad) else bad, [kk, th], "left_anti").select(*docs.columns)


def without_contaminated(spark, docs, sf_dir):
    """The documents that hold no window of the benchmark of ``sf_dir`` (see ``clean``)."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def op9_prefix_decontamination(spark, sf_dir):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s + 1, s + {WINDOW}), ' ') AS win, least(len(w), {WINDOW}) AS n
       FROM i, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS win
       FROM d, sizes, unnest(range(0, greatest(len(w) - n + 1, 0))) AS t(s)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
n_hit AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM hit, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
