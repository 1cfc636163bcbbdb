"""Benchmark decontamination: a prefix-filtered join of documents with windows of benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.llm.columns import NOT_ALNUM, ascii_lower, id_and_text, row_key, words
from adjudica.session import materialize

WINDOW_WORDS, SHINGLE_WORDS = 10, 3
#: Distinct benchmark shingles up to which the filter of document places travels by broadcast.
BROADCAST_SHINGLES = 500_000


def item_windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(window, length, words, items): distinct windows of item words and the items that hold them.

    A window is ``size`` consecutive words; an item of fewer, but not none, is one window.
    """
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"),
        words(ascii_lower(F.col("text")), NOT_ALNUM).alias("w"),
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(size)))
    each = items.select("item", F.explode(cut).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).select(
        F.md5(F.array_join("words", " ")).alias("window"), F.size("words").alias("length"), "words", "items"
    )


def window_shingles(windows: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(window, length, offset, shingle) of every place of every window."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    cut = F.transform(
        starts, lambda i: F.array_join(F.slice(F.col("words"), i, F.lit(size)), " ")
    )
    return windows.select("window", "length", F.posexplode(cut).alias("offset", "shingle"))


def _place_of(word: Column, size: int):
    return lambda i: F.struct(
        i.alias("at"), F.concat_ws(" ", *[word[i + k] for k in range(size)]).alias("shingle")
    )


def document_places(docs: DataFrame, wanted: DataFrame, broadcast: bool, sizes: list[int]) -> DataFrame:
    """(key, doc_id, n_words, at, shingle): a heading row per document with an empty shingle, and a
    row for each place where a shingle of ``wanted`` starts."""
    split = docs.select(
        "doc_id",
        row_key(F.col("doc_id"), F.col("text")).alias("key"),
        words(ascii_lower(F.col("text")), NOT_ALNUM).alias("w"),
    )
    word = F.col("w")
    n = F.size(word)
    cuts = [F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("shingle")))]
    for size in sizes:
        starts = F.when(n >= size, F.sequence(F.lit(0), n - size))
        starts = starts.otherwise(F.array().cast("array<int>"))
        cuts.append(F.transform(starts, _place_of(word, size)))
    placed = split.select(
        "doc_id", "key", n.cast("long").alias("n_words"), F.explode(F.concat(*cuts)).alias("place")
    ).select("doc_id", "key", "n_words", "place.at", "place.shingle")
    heading = placed.sparkSession.createDataFrame([("",)], "shingle string")
    wanted = wanted.union(heading)
    return placed.join(F.broadcast(wanted) if broadcast else wanted, "shingle")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one per row of ``docs``.

    A containment of all shingles of a window needs its rarest one, so each window is looked up by
    that shingle alone (its prefix of length one at threshold one); rarity is counted over all
    documents. A place then bounds where the window starts, which must lie in the document (position)
    and leave room for the window (length). Candidates are verified by the places of all other
    shingles of the window: consecutive shingles that all stand at their places are the window itself.

    Null text has no words. Documents with null ids count by their text. Repeated rows get equal
    results, an empty benchmark hits nothing, an empty table gives no row; other columns are not read.
    Documents are scanned once. What moves between tasks are places of benchmark shingles, not texts.
    The shingles of the benchmark are broadcast up to ``BROADCAST_SHINGLES``; beyond, they are joined
    by shuffle.
    """
    windows = materialize(item_windows(benchmark), "benchmark-windows")
    shingles = materialize(window_shingles(windows), "benchmark-shingles")
    wanted = shingles.select("shingle").distinct()
    known = wanted.count()
    sizes = sorted(
        r["size"] for r in windows.select(F.least("length", F.lit(SHINGLE_WORDS)).alias("size")).distinct().collect()
    )
    placed = document_places(id_and_text(docs), wanted, known <= BROADCAST_SHINGLES, sizes)
    placed = materialize(placed, "document-places")

    places = placed.where("at >= 0").select("key", "n_words", "at", "shingle")
    rarity = places.groupBy("shingle").agg(F.count("*").alias("n"))
    order = Window.partitionBy("window").orderBy("n", "shingle", "offset")
    prefixes = (
        shingles.join(rarity, "shingle")
        .withColumn("rank", F.row_number().over(order))
        .where("rank = 1")
        .select("shingle", "window", "length", "offset")
    )
    candidates = (
        places.join(prefixes, "shingle")
        .select("key", "n_words", "window", "length", (F.col("at") - F.col("offset")).alias("start"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        .drop("n_words")
        .distinct()
    )
    needed = (
        candidates.join(shingles.drop("length"), "window")
        .select("key", "window", "length", "start", (F.col("start") + F.col("offset")).alias("at"), "shingle")
    )
    occurrences = (
        needed.join(places.select("key", "at", "shingle").distinct(), ["key", "at", "shingle"])
        .groupBy("key", "window", "length", "start")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == F.greatest(F.col("length") - SHINGLE_WORDS + 1, F.lit(1)))
    )
    occurrences = materialize(occurrences.select("key", "window", "length", "start"), "occurrences")
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["end"]).alias("end"),
            (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["end"]), F.lit(0))).alias("n"),
        ),
        lambda s: s["n"],
    )
    spans = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    hits = occurrences.groupBy("key").agg(F.collect_set(spans).alias("spans")).select(
        "key", covered.alias("n_hit")
    )
    items = (
        occurrences.select("key", "window").distinct()
        .join(windows.select("window", F.explode("items").alias("item")), "window")
        .groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(
            "key",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        )
    )
    found = hits.join(items, "key", "left")
    none = F.sha2(F.lit(""), 256)
    return (
        placed.where("at < 0").select("key", "doc_id", "n_words").join(found, "key", "left")
        .select(
            "key",
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items_sha256", none).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("key").alias("bad_key"))
    key = row_key(docs["doc_id"], docs["text"])
    return docs.join(bad.distinct(), key == F.col("bad_key"), "left_anti")
