"""Removal of benchmark passages from training text.

The normalised word windows of all benchmark items make one hash set, which is
broadcast; every window of every document is looked up there, a hit is compared
word by word, and the words inside hits can be cut out, or documents with too
many of them dropped.  A benchmark of any size is broadcast in blocks of proven
size, one scan of the documents for each: that shuffles no document, which a
join by windows would do ten times over.

Everything is a DataFrame expression; no Python runs in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnloom.llm.shared import other_fields, written

WINDOW = 10
# Windows, and bytes of their words and items, that one broadcast holds at most.
BLOCK_WINDOWS = 1 << 20
BLOCK_BYTES = 1 << 27

# What separates words; all else, also any character beyond ASCII, is a word.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """The words of a text as they stand there; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _BETWEEN), "")


def _joined(words: str, at: Column, length: Column) -> Column:
    """``length`` words from ``at`` on with A-Z in lower case and all else as it is."""
    return F.translate(F.array_join(F.slice(words, at + 1, length), " "), CAPITALS, SMALL)


def _windows(hashes: str, length: int) -> Column:
    """The hash of every window of ``length`` words, from up to four of them.

    Windows that are equal have equal hashes, and what merely shares these four
    words is told apart when the words are compared.
    """
    picked = sorted({0, length // 3, 2 * length // 3, length - 1})
    last = F.size(hashes) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(length), *[F.get(hashes, i + j) for j in picked]))


def _hashed(df: DataFrame) -> DataFrame:
    """Add hashes of the words in lower case: equal for words that differ in A-Z only, and for a few others."""
    return df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(F.lower(w))))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of all items: hash, length, words (joined by blanks) and items.

    An item of fewer than WINDOW words is one window.  Items are ids as text; a
    window of items without an id has none.  Items without words, empty or null,
    have no window.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("_item"), words(text).alias("_words")).filter(F.size("_words") > 0)
    short = F.when(F.size("_words") < WINDOW, F.size("_words")).otherwise(F.lit(WINDOW))
    cut = _hashed(rows).withColumn("length", short)
    chosen = reduce(
        lambda rest, n: F.when(F.col("length") == n, _windows("_hashes", n)).otherwise(rest),
        range(1, WINDOW),
        _windows("_hashes", WINDOW),
    )
    listed = cut.select("_item", "_words", "length", F.posexplode(chosen).alias("at", "hash"))
    return (
        listed.select("_item", "length", "hash", _joined("_words", F.col("at"), F.col("length")).alias("words"))
        .groupBy("hash", "length", "words")
        .agg(F.collect_set("_item").alias("items"))
    )


def _scan(docs: DataFrame, block: DataFrame, lengths: list[int]) -> DataFrame:
    """(_key, _row, at, length, items) of every place where a window of ``block`` stands."""
    rows = _hashed(docs.select("_key", "_row", words("_text").alias("_words")))
    hashes = [_windows("_hashes", n) for n in lengths]
    listed = F.concat(*hashes) if len(hashes) > 1 else hashes[0]
    places = rows.select("_key", "_row", "_words", F.posexplode(listed).alias("_place", "hash"))
    hits = places.join(F.broadcast(block), "hash")
    # The windows of one length stand behind those of the lengths before.
    at, ahead = F.col("_place"), F.lit(0)
    for before, n in zip(lengths, lengths[1:], strict=False):
        ahead = ahead + F.greatest(F.size("_words") - before + 1, F.lit(0))
        at = F.when(F.col("length") == n, F.col("_place") - ahead).otherwise(at)
    hits = hits.select("_key", "_row", "_words", at.alias("at"), "length", "words", "items")
    same = (F.col("at") >= 0) & (F.col("at") + F.col("length") <= F.size("_words"))
    same = same & (_joined("_words", F.greatest("at", F.lit(0)), F.col("length")) == F.col("words"))
    return hits.filter(same).select("_key", "_row", "at", "length", "items")


def _runs(places: Column) -> Column:
    """Sorted (at, length) places joined to runs (start, end) of words."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def closed(state: Column) -> Column:
        run = F.array(F.struct(state["start"].alias("start"), state["end"].alias("end")))
        return F.when(state["end"] < 0, state["done"]).otherwise(F.concat(state["done"], run))

    def add(state: Column, place: Column) -> Column:
        end, apart = place["at"] + place["length"], place["at"] > state["end"]
        return F.struct(
            F.when(apart, closed(state)).otherwise(state["done"]).alias("done"),
            F.when(apart, place["at"]).otherwise(state["start"]).alias("start"),
            F.when(apart, end).otherwise(F.greatest(end, state["end"])).alias("end"),
        )

    return F.aggregate(places, zero, add, closed)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Every document (columns as they are) with what it shares with the benchmark.

    Adds n_words (long), hit_runs (array of start and end, in words, of the runs
    that windows of items cover) and hit_items (sorted ids as text of the items
    with a window there).  Columns of these names are replaced.  A null or empty
    text has 0 words; rows that repeat a key are judged by their own text; an
    empty benchmark hits nothing.  An item without id marks words but is not
    listed.
    """
    kept = [f.name for f in other_fields(docs, ["n_words", "hit_runs", "hit_items"])]
    grams = written(windows(benchmark, item, item_text), "windows")
    size = F.sum(F.octet_length("words") + F.octet_length(F.array_join("items", ",")) + 32)
    sizes = grams.groupBy("length").agg(F.count("*").alias("n"), size.alias("bytes")).collect()
    blocks = max(1, *(-(-sum(r[c] for r in sizes) // most) for c, most in (("n", BLOCK_WINDOWS), ("bytes", BLOCK_BYTES))))
    # A document is known by its key and the hash of its text, so that only rows of one key could ever be confused.
    others = [n for n in kept if n != text]
    named = docs.select(
        F.struct(*others).alias("_doc"),
        F.struct(F.col(key).alias("value")).alias("_key"),
        F.xxhash64(F.col(text)).alias("_row"),
        F.col(text).alias("_text"),
    )
    count = F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(_WORD)).cast("long").alias("n_words")
    counted = named.select("*", count)
    columns = [F.col("_text").alias(n) if n == text else F.col(f"_doc.`{n}`") for n in kept]
    none = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    if not sizes:
        return counted.select(*columns, "n_words", none[0].alias("hit_runs"), none[1].alias("hit_items"))
    lengths = sorted(r["length"] for r in sizes)
    parts = [grams.filter(F.pmod("hash", F.lit(blocks)) == b) if blocks > 1 else grams for b in range(blocks)]
    hits = reduce(DataFrame.unionAll, [_scan(named, part, lengths) for part in parts])
    found = hits.groupBy("_key", "_row").agg(
        F.sort_array(F.collect_set(F.struct("at", "length"))).alias("_places"), F.collect_set("items").alias("_items")
    )
    found = found.select(
        "_key", "_row", _runs(F.col("_places")).alias("_runs"), F.sort_array(F.array_distinct(F.flatten("_items"))).alias("_items")
    )
    joined = counted.join(found, ["_key", "_row"], "left")
    return joined.select(
        *columns,
        "n_words",
        F.coalesce("_runs", none[0]).alias("hit_runs"),
        F.coalesce("_items", none[1]).alias("hit_items"),
    )


def n_hit(runs: str = "hit_runs") -> Column:
    """Words inside hits."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def without_runs(text: str = "text", runs: str = "hit_runs") -> Column:
    """The text without the words of ``runs`` and what stands between them.

    What stood before the first removed word and behind the last one stays.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    between = F.split(whole, _WORD)
    tokens = words(text)
    pairs = F.transform(tokens, lambda w, i: F.concat(F.get(between, i), w))
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    kept = F.transform(
        F.arrays_zip(starts.alias("start"), F.col(runs).alias("run")),
        lambda z: F.concat(
            F.array_join(
                F.slice(pairs, z["start"] + 1, F.coalesce(z["run"]["start"], F.size(tokens)) - z["start"]), ""
            ),
            F.when(z["run"].isNull(), F.get(between, F.size(tokens))).otherwise(F.get(between, z["run"]["start"])),
        ),
    )
    return F.when(F.size(runs) == 0, F.col(text)).otherwise(F.array_join(kept, ""))


def remove_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents, their hits cut out of ``text``; columns as they are, see ``find``."""
    found = find(docs, benchmark, key, text)
    return found.withColumn(text, without_runs(text)).select(docs.columns)


def remove_documents(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Documents of whose words at most ``share`` are inside hits; columns as they are, see ``find``."""
    found = find(docs, benchmark, key, text)
    return found.filter(n_hit() <= F.lit(share) * F.col("n_words")).select(docs.columns)
