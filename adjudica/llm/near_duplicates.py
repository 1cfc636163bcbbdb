"""Near duplicates by SuperMinHash signatures, banding, verification and union-find grouping."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.llm.columns import id_and_text, map_batches
from adjudica.session import materialize

SHINGLE_WORDS, LEAST_PERCENT = 5, 75
#: Signature length, and bands of so many rows. A pair at a similarity of 0.75 misses all 51 bands of
#: 5 rows with a chance of 1 in a million; one at 0.3 meets in a band with a chance of 12 %.
SIGNATURE, BANDS, BAND_ROWS = 256, 51, 5
#: Elements of a text that take their steps together; bounds memory, changes no value.
CHUNK = 4096
#: Bits of a set's bitmap; a power of two. Longer sets than this fill it and are ruled out less often.
BITMAP = 2048

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit values of the 5-word shingles of a whole text.

    A-Z in lower case, words cut at ASCII white space; fewer than five words are one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(hashed) < SHINGLE_WORDS:
        padded = np.full(SHINGLE_WORDS, len(hashed), dtype=np.uint64)
        padded[: len(hashed)] = hashed
        hashed = padded
    count = len(hashed) - SHINGLE_WORDS + 1
    mixed = np.zeros(count, dtype=np.uint64)
    for k in range(SHINGLE_WORDS):
        mixed = _mix(mixed + hashed[k : k + count] * _ODD[k])
    return np.unique(mixed)


def super_minhash(elements: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """SuperMinHash signature of distinct 64-bit elements, as 64-bit values.

    Step j gives every element the next place of its own random permutation (Fisher-Yates) and there
    the rank j plus a fraction. Ranks of one element at different places are thus correlated, which
    lowers the variance. Elements take a step together, ``CHUNK`` at a time; once every place holds a
    rank below j, step j and later ones can lower none, and the steps end.
    """
    best = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    for first in range(0, len(elements), CHUNK):
        state = elements[first : first + CHUNK]
        order = np.tile(np.arange(size, dtype=np.uint16), (len(state), 1))
        rows = np.arange(len(state))
        for j in range(size):
            if int(best.max()) >> 44 < j:
                break
            state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
            high = state >> np.uint64(44)
            pick = j + (high * np.uint64(size - j) >> np.uint64(20)).astype(np.int64)
            place = order[rows, pick]
            order[rows, pick] = order[:, j]
            value = np.uint64(j << 44) | state & np.uint64((1 << 44) - 1)
            np.minimum.at(best, place, value)
    return best


def band_values(signature: np.ndarray) -> list[int]:
    """One 64-bit value per band."""
    rows = signature[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    mixed = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        mixed = _mix(mixed + rows[:, k] * _ODD[k])
    return mixed.view(np.int64).tolist()


def bitmap(elements: np.ndarray) -> list[int]:
    """A bit for each element, at the place its highest bits name, as 64-bit values."""
    flags = np.zeros(BITMAP, dtype=bool)
    flags[(elements >> np.uint64(65 - BITMAP.bit_length())).astype(np.int64)] = True
    return np.packbits(flags).view(np.int64).tolist()


def is_near(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= LEAST_PERCENT * (len(a) + len(b) - common)


def _signed(texts: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, bands, bits): equal sets have equal classes, empty sets have none."""

    def work(batches):
        for batch in batches:
            sets = [shingle_set(text) for text in batch["text"]]
            yield {
                "doc_id": batch["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "class": [
                    hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets
                ],
                "bands": [band_values(super_minhash(s)) if len(s) else [] for s in sets],
                "bits": [bitmap(s) for s in sets],
            }

    return map_batches(
        texts,
        work,
        "doc_id long, n_shingles long, class binary, bands array<bigint>, bits array<bigint>",
    )


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are near."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def work(batches):
        last = (None, None)
        for batch in batches:
            near = []
            for text_a, text_b in zip(batch["text_a"], batch["text_b"]):
                if text_b != last[0]:
                    last = (text_b, shingle_set(text_b))
                near.append(is_near(shingle_set(text_a), last[1]))
            yield {
                "a": [a for a, n in zip(batch["a"], near) if n],
                "b": [b for b, n in zip(batch["b"], near) if n],
            }

    return map_batches(pairs.join(left, "a").join(right, "b"), work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b); component is the smallest id reachable.

    Union-find by rounds: every id points to the smallest id it knows. In a round the smaller parent
    of a link's ends becomes the parent of the other end's parent and of both ends (union), then each
    id takes its parent's parent (find). Rounds end when no link joins two parents. Rows are written
    after each round; nothing but the count of unfinished links reaches the driver.
    """
    links = links.select("a", "b").where("a <> b")
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    parents = materialize(ids.withColumn("parent", F.col("id")), "parents")
    while True:
        of_a = parents.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        of_b = parents.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        ends = materialize(
            links.join(of_a, "a").join(of_b, "b").where("pa <> pb").select(
                "a", "b", "pa", "pb", F.least("pa", "pb").alias("low")
            ),
            "open-links",
        )
        if ends.isEmpty():
            return parents.withColumnRenamed("parent", "component")
        lowered = ends.select(
            F.explode(F.array("a", "b", "pa", "pb")).alias("id"), F.col("low").alias("parent")
        )
        lowered = lowered.union(parents).groupBy("id").agg(F.min("parent").alias("parent"))
        lowered = materialize(lowered, "parents")
        grand = lowered.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        parents = materialize(
            lowered.join(grand, "parent").select("id", F.col("grand").alias("parent")), "parents"
        )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs`` (doc_id, text).

    1. Texts with one shingle set form a class; only the smallest id of a class goes on.
    2. Ids that share a band form a bucket. Each id is compared with the smallest of the first ids of
       its buckets. Only buckets that still hold different groups go on: there, each id outside the
       group of the bucket's first id is compared with that one.
    3. What is left are ids of one bucket in different groups. Each such pair is compared, once.
    All comparisons are on full sets; pairs that sizes or bitmaps alone rule out are not formed, which
    loses no link. Copies linked to one text, however many, cost one comparison each; pairs within a
    bucket are only formed between groups that no link has joined. Texts that share bands and are not
    near still meet there, bitmap against bitmap, inside the join: that part grows with the square of
    their number.

    Empty and null texts have no shingles and stay alone. Rows with a null id get a null component and
    are kept; repeated ids are one node. An empty table gives no row.
    """
    texts = id_and_text(docs)
    signed = materialize(_signed(texts), "signatures")
    named = signed.select("doc_id", "class").where("doc_id is not null and class is not null")
    heads = materialize(named.groupBy("class").agg(F.min("doc_id").alias("head")), "classes")
    of_head = signed.join(
        heads.withColumnRenamed("class", "of"),
        (F.col("class") == F.col("of")) & (F.col("doc_id") == F.col("head")),
        "left_semi",
    )
    banded = of_head.select(
        F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band")
    ).distinct()
    banded = materialize(banded, "bands")
    buckets = banded.groupBy("band").agg(
        F.min(F.struct("id", "n")).alias("pivot"), F.max("id").alias("last")
    ).where("pivot.id < last").select("band", "pivot")
    members = materialize(banded.join(buckets, "band"), "bucket-members")
    stars = members.where(F.col("id") != F.col("pivot.id")).where(_sizes_fit("n", "pivot.n"))
    stars = stars.groupBy(F.col("id").alias("a")).agg(F.min("pivot.id").alias("b"))
    members = members.drop("pivot")
    bits = of_head.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bits").distinct()
    met = members.select("id").distinct()
    own = texts.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    own = materialize(own.join(met, "id", "left_semi"), "candidate-texts")

    # An id repeated with different texts is one node: it links the classes of its texts.
    several = named.groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    several = several.where("low <> high").select("doc_id")
    same = named.join(heads, "class").where("doc_id <> head")
    bridges = same.join(several, "doc_id", "left_semi")
    links = bridges.select(F.col("doc_id").alias("a"), F.col("head").alias("b")).union(
        materialize(_confirmed(stars, own), "links")
    )
    groups = components(links)
    for form_pairs in (_with_pivots, _between_groups):
        pairs = form_pairs(_mixed_buckets(members, groups), bits)
        more = materialize(_confirmed(pairs, own), "links")
        if not more.isEmpty():
            links = links.union(more)
            groups = components(links)

    inside = groups.select("id", "component")
    copies = same.join(inside, same["head"] == inside["id"], "left").select(
        F.col("doc_id").alias("id"), F.coalesce("component", "head").alias("component")
    )
    placed = inside.union(copies).groupBy("id").agg(F.min("component").alias("component"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(placed, signed["doc_id"] == placed["id"], "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def _sizes_fit(n: str, m: str) -> Column:
    """Sets of these sizes can be near: the smaller one has at least the wanted share of the larger."""
    return 100 * F.least(n, m) >= LEAST_PERCENT * F.greatest(n, m)


def _bits_fit(n: str, m: str, bits_a: str, bits_b: str) -> Column:
    """Sets of these sizes and bitmaps can be near.

    A bit that only one of them has stands for an element or more that only this one has, so the
    differing bits are at most the differing elements; near sets differ in a fixed share of n + m.
    """
    differing = F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    count = F.aggregate(differing, F.lit(0), lambda total, k: total + k)
    return (100 + LEAST_PERCENT) * count <= (100 - LEAST_PERCENT) * (F.col(n) + F.col(m))


def _mixed_buckets(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, id, n, g, first, most): the rows of buckets that hold two groups or more.

    g is the row's group, first the bucket's row with the smallest id, most the group with most rows.
    """
    named = members.join(groups, "id", "left").select(
        "band", "id", "n", F.coalesce("component", "id").alias("g")
    )
    sizes = named.groupBy("band", "g").agg(
        F.count("*").alias("count"), F.min(F.struct("id", "n", "g")).alias("first")
    )
    mixed = sizes.groupBy("band").agg(
        F.max_by("g", F.struct("count", "g")).alias("most"),
        F.min("first").alias("first"),
        F.count("*").alias("n_groups"),
    )
    mixed = mixed.where("n_groups > 1").drop("n_groups")
    return materialize(named.join(mixed, "band"), "mixed-buckets")


def _with_pivots(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs of a row with the smallest id of its bucket, where that is in another group."""
    across = rows.where(F.col("g") != F.col("first.g")).where(_sizes_fit("n", "first.n"))
    return across.select(F.col("id").alias("a"), F.col("first.id").alias("b")).distinct()


def _between_groups(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs of one bucket and different groups that can be near, other than those with its first row.

    The group with most rows of a bucket forms no pairs of its own: pairs have an end outside it. Rows
    of a bucket meet by a join on the bucket, which may split.
    """
    rest = rows.where(F.col("id") != F.col("first.id")).join(bits, ["id", "n"])
    rest = materialize(rest.select("band", "id", "n", "g", "most", "bits"), "rows-to-meet")
    names_a = {"id": "a", "g": "ga", "n": "na", "bits": "bits_a"}
    names_b = {"id": "b", "g": "gb", "n": "nb", "bits": "bits_b"}
    left = rest.where("g <> most").drop("most").withColumnsRenamed(names_a)
    right = rest.withColumnsRenamed(names_b)
    met = (F.col("ga") != F.col("gb")) & ((F.col("gb") == F.col("most")) | (F.col("a") > F.col("b")))
    can_be_near = _sizes_fit("na", "nb") & _bits_fit("na", "nb", "bits_a", "bits_b")
    pairs = left.join(right, "band").where(met & can_be_near)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, one with the smallest id.

    Of the rows that repeat that id, the one whose text has the smallest checksum stays. Rows without
    an id are linked with nothing: of those with equal texts one stays, without words all.
    """
    found = near_duplicates(docs).where("kept and doc_id is not null")
    found = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n")), "kept-ids")
    once = found.where("n = 1").select(F.col("doc_id").alias("kept_id"))
    # A table of its own, so that its size is known where the join is planned.
    often = materialize(found.where("n > 1").select(F.col("doc_id").alias("kept_id")), "repeated-ids")
    unnamed = docs.where("doc_id is null")
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.md5("text")).alias("row")
    repeated = docs.join(often, docs["doc_id"] == often["kept_id"], "left_semi")
    return (
        docs.join(once, docs["doc_id"] == once["kept_id"], "left_semi")
        .union(repeated.groupBy("doc_id").agg(first).select("row.*"))
        .union(unnamed.where(wordless))
        .union(unnamed.where(~wordless).groupBy(F.md5("text")).agg(first).select("row.*"))
    )
