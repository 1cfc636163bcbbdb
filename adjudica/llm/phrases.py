"""Collocations by weighted automata: shards of counts, unions by prefix range, look-ups of parts.

1. Each task counts the phrases of its texts in bounded runs and turns a sorted run into transducers, one
   per language and range of prefixes (the first two words).
2. A range's transducers are united and their weights added. All counts of a phrase meet in one range, and
   so do all phrases that go on behind two words; a frequent phrase is one path per run.
3. The frequent phrases move on, spelled from their end, to ranges of endings, where a second automaton gives
   the counts of their endings and of the phrases that go on before them.

A range's limits come from a sample and only balance the work.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adjudica.llm.count_automata import LOW, SHIFT, Phrases, Transducer, summed, union
from adjudica.session import materialize

# What ends a piece, and what separates words besides.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
END = b"."
#: A-Z to lower case, every end of a piece to one sign, which no word holds, and white space to a space.
TABLE = bytes(
    END[0] if bytes([b]) in [PIECE_ENDS[i : i + 1] for i in range(len(PIECE_ENDS))]
    else 32 if b in WORD_ENDS else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)
#: Bytes of text that a task cuts into words at a time; a longer text is counted window by window.
WINDOW = 2_000_000
#: Words and phrases of a run; what is beyond starts a new one.
MOST_WORDS, MOST_PHRASES = 600_000, 4_000_000
#: Texts and limits that balance the ranges, phrases of a range, one of so many phrases that is a sample.
SAMPLE_TEXTS, SAMPLE_ROWS, RANGE_PHRASES, SAMPLE_STEP = 2_000, 50_000, 3_000_000, 16
#: Bits of a word's number in a run.
BITS = np.int64(21)
MASK = np.int64((1 << 21) - 1)
UNKNOWN_LANGUAGE = "und"
#: Parts that the best phrases of a language are first chosen in.
SALTS = 64

Limit = tuple[str, bytes, bytes]


class _Numbers(dict):
    """Words to numbers in the order of their coming; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _windows(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about ``WINDOW`` bytes that end between words."""
    at = 0
    while at < len(data):
        cut = at + WINDOW
        if cut < len(data):
            cut = max(data.rfind(END, at + 1, cut), data.rfind(b" ", at + 1, cut))
            if cut < 0:
                ends = [p for p in (data.find(END, at + WINDOW), data.find(b" ", at + WINDOW)) if p >= 0]
                cut = min(ends, default=len(data))
        yield data[at:cut]
        at = cut


class Run:
    """Counts of the phrases of up to three words of some texts, by language."""

    def __init__(self):
        self.numbers = _Numbers({END: 0})
        self.counted: dict[str, list] = {}
        self.size = 0

    def full(self) -> bool:
        return len(self.numbers) > MOST_WORDS or self.size > MOST_PHRASES

    def add(self, lang: str, window: bytes, carry: np.ndarray) -> np.ndarray:
        """Count one window behind the two numbers of ``carry``; returns its own last two.

        Numbers hold for one run, so a caller that starts another run passes the words again.
        """
        words = window.replace(END, b" . ").split()
        new = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        a, c = np.concatenate([carry, new]), len(carry)
        two, three = max(c - 1, 0), max(c - 2, 0)
        x, y = a[two:-1], a[two + 1 :]
        pairs = (x << 2 * BITS | y << BITS)[(x > 0) & (y > 0)]
        x, y, z = a[three:-2], a[three + 1 : -1], a[three + 2 :]
        triples = (x << 2 * BITS | y << BITS | z)[(x > 0) & (y > 0) & (z > 0)]
        keys = np.sort(np.concatenate([new[new > 0] << 2 * BITS, pairs, triples]))
        if len(keys):
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.diff(np.concatenate([first, [len(keys)]]))
            parts = self.counted.setdefault(lang, [])
            parts.append((keys[first], counts))
            self.size += len(first)
            if c == 2 and carry.all():
                # The pair was counted where it stood, perhaps in an earlier run; its triple needs it here.
                pair = carry[:1] << 2 * BITS | carry[1:] << BITS
                parts.append((pair, np.zeros(1, dtype=np.int64)))
        return a[-2:]

    def phrases(self) -> Iterator[tuple[str, Phrases]]:
        """(language, sorted phrases) of the run; the word list is shared."""
        words = pa.array(list(self.numbers)[1:], pa.binary())
        order = pc.array_sort_indices(words).to_numpy().astype(np.int64)
        rank = np.zeros(len(order) + 1, dtype=np.int64)
        rank[order + 1] = np.arange(1, len(order) + 1)
        words = words.take(pa.array(order))
        for lang, parts in self.counted.items():
            keys = np.concatenate([k for k, _ in parts])
            keys = rank[keys >> 2 * BITS] << 2 * BITS | rank[keys >> BITS & MASK] << BITS | rank[keys & MASK]
            keys, counts = summed(keys, np.concatenate([n for _, n in parts]))
            middle, last = keys >> BITS & MASK, keys & MASK
            is_one, is_three = middle == 0, last > 0
            is_two = ~is_one & ~is_three
            pairs, triples = keys[is_two], keys[is_three]
            yield lang, Phrases(
                words, (keys[is_one] >> 2 * BITS) - 1, counts[is_one],
                (pairs >> 2 * BITS) - 1 << SHIFT | middle[is_two] - 1, counts[is_two],
                np.searchsorted(pairs, triples & ~MASK) << SHIFT | last[is_three] - 1, counts[is_three],
            )


def count_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Phrases]]:
    """(language, phrases) of all runs of a task's texts (lang, text as bytes)."""
    run = Run()
    nothing = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for lang, data in _streams(batch):
            carry = nothing
            for window in _windows(data):
                if run.full():
                    by_number = list(run.numbers)
                    carried = [by_number[k] for k in carry]
                    yield from run.phrases()
                    run = Run()
                    carry = np.array([run.numbers[w] for w in carried], dtype=np.int64)
                carry = run.add(lang, window, carry)
    yield from run.phrases()


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Texts of one language after another, ends of a piece between them, about a window at a time."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
        data = text.as_py() or b""
        waiting.setdefault(lang, []).append(data)
        sizes[lang] = sizes.get(lang, 0) + len(data)
        if sizes[lang] >= WINDOW // 2:
            yield lang, END.join(waiting.pop(lang)).translate(TABLE)
            sizes[lang] = 0
    for lang, texts in waiting.items():
        yield lang, END.join(texts).translate(TABLE)


def _limits_of(lang: str, limits: list[Limit], words: pa.BinaryArray) -> tuple[int, list[tuple[int, int]]]:
    """(number of limits before the language, its limits as word numbers) for ``Phrases.part``."""
    first = bisect.bisect_left(limits, (lang, b"", b""))
    found = []
    text = lambda s: s.as_py()
    for name, one, two in limits[first:]:
        if name != lang:
            break
        at = bisect.bisect_left(words, one, key=text)
        same = at < len(words) and words[at].as_py() == one
        found.append((at, bisect.bisect_left(words, two, key=text)) if same and two else (at, -1))
    return first, found


def _quantiles(rows: list[Limit], parts: int) -> list[Limit]:
    rows = sorted(rows)
    cuts = {rows[len(rows) * k // parts] for k in range(1, parts)} if rows else set()
    return sorted(cuts)


def _sample_limits(texts: DataFrame) -> list[Limit]:
    """Limits of the ranges of prefixes, from the phrases of a sample of about ``SAMPLE_TEXTS`` texts.

    There is a range per shuffle partition, or more where the words of the sample let expect more phrases.
    """
    rows = texts.count()
    share = min(1.0, SAMPLE_TEXTS / max(rows, 1))

    def work(batches):
        for lang, found in count_runs(batches):
            first = np.concatenate([found.one, found.two >> SHIFT, (found.two >> SHIFT)[found.three >> SHIFT]])
            second = np.concatenate([np.full(len(found.one), -1), found.two & LOW, (found.two & LOW)[found.three >> SHIFT]])
            keep = np.lexsort((second, first))[:: SAMPLE_STEP]
            names = lambda ids: found.words.take(pa.array(ids, mask=ids < 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keep)), names(first[keep]), names(second[keep])], ["lang", "one", "two"]
            )

    sample = texts.sample(fraction=share, seed=1) if share < 1.0 else texts
    found = sample.mapInArrow(work, "lang string, one binary, two binary").collect()
    found = [(r["lang"], bytes(r["one"]), bytes(r["two"] or b"")) for r in found]
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    expected = len(found) * SAMPLE_STEP / share
    return _quantiles(found, max(partitions, int(expected // RANGE_PHRASES)))


def _shards(texts: DataFrame, limits: list[Limit]) -> DataFrame:
    """(range, lang, data): the transducers of all runs, cut at the limits."""

    def work(batches):
        for lang, found in count_runs(batches):
            base, cuts = _limits_of(lang, limits, found.words)
            ends = [(0, -1), *cuts, (len(found.words), -1)]
            rows = []
            for k, (low, high) in enumerate(zip(ends, ends[1:])):
                part = found.part(low, high)
                if len(part):
                    rows.append((base + k, Transducer.of(part).to_bytes()))
            yield pa.RecordBatch.from_pydict(
                {
                    "range": pa.array([k for k, _ in rows], pa.int32()),
                    "lang": pa.array([lang] * len(rows), pa.string()),
                    "data": pa.array([d for _, d in rows], pa.binary()),
                }
            )

    return texts.mapInArrow(work, "range int, lang string, data binary")


FREQUENT = "lang string, one binary, two binary, three binary, n long, begins1 long, begins2 long, goes_on long"


def _frequent_rows(lang: str, found: Phrases, least: int) -> Iterator[pa.RecordBatch]:
    """The language's words in this range, and its frequent phrases with what their beginnings weigh."""
    kept = found.at_least(least)
    automaton = Transducer.of(kept)
    none = pa.nulls(1, pa.binary())
    total = [pa.array([lang]), none, none, none, pa.array([int(found.one_n.sum())]), *[pa.nulls(1, pa.int64())] * 3]
    first, second = kept.two >> SHIFT, kept.two & LOW
    names = lambda ids: kept.words.take(pa.array(ids))
    known = lambda weights: pa.array(weights, mask=weights == 0)
    empty = lambda count, kind: pa.nulls(count, kind)
    ones, twos, threes = len(kept.one), len(kept.two), len(kept.three)
    of_three = kept.three >> SHIFT
    columns = [
        total,
        [pa.array([lang] * ones, pa.string()), names(kept.one), empty(ones, pa.binary()), empty(ones, pa.binary()),
         pa.array(kept.one_n), *[empty(ones, pa.int64())] * 3],
        [pa.array([lang] * twos, pa.string()), names(first), names(second), empty(twos, pa.binary()), pa.array(kept.two_n),
         known(automaton.weights(first)), empty(twos, pa.int64()), pa.array(automaton.heaviest(first, second))],
        [pa.array([lang] * threes, pa.string()), names(first[of_three]), names(second[of_three]), names(kept.three & LOW),
         pa.array(kept.three_n), known(automaton.weights(first[of_three])),
         pa.array(automaton.weights(first[of_three], second[of_three])), empty(threes, pa.int64())],
    ]
    fields = [piece.split()[0] for piece in FREQUENT.split(", ")]
    for column in columns:
        if len(column[0]):
            yield pa.RecordBatch.from_arrays(column, fields)


def _united(shards: DataFrame, ranges: int, least: int) -> DataFrame:
    """All frequent phrases, and a row without words that holds a range's number of words."""

    def work(batches):
        current, parts, size = None, [], 0

        def ended():
            if current is not None:
                yield from _frequent_rows(current[1], union(parts), least)

        for batch in batches:
            for place, lang, data in zip(batch["range"].to_pylist(), batch["lang"].to_pylist(), batch["data"]):
                if (place, lang) != current:
                    yield from ended()
                    current, parts, size = (place, lang), [], 0
                parts.append(Transducer.from_bytes(data.as_py()).phrases())
                size += len(parts[-1])
                if size > 2 * MOST_PHRASES and len(parts) > 1 and len(parts[0]) < size // 2:
                    parts = [union(parts)]
                    size = len(parts[0])
        yield from ended()

    ordered = shards.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "lang")
    return ordered.mapInArrow(work, FREQUENT)


def _counts_of(frequent: DataFrame, limits: list[Limit]) -> dict[tuple[str, bytes], int]:
    """Counts of the words at the limits, the only ones whose own count may lie in an earlier range."""
    wanted = {(lang, word) for lang, word, _ in limits}
    if not wanted:
        return {}
    rows = frequent.sparkSession.createDataFrame([(a, bytearray(b)) for a, b in wanted], "lang string, one binary")
    ones = frequent.where("one is not null and two is null").select("lang", "one", "n")
    return {(r["lang"], bytes(r["one"])): r["n"] for r in ones.join(F.broadcast(rows), ["lang", "one"]).collect()}


SCORED = "lang string, one binary, two binary, three binary, a long, l long, r long, score long"


def _scored(frequent: DataFrame, prefix_limits: list[Limit], share: int) -> DataFrame:
    """Phrases of two and three words that no longer one covers, with their lowest-scoring cut."""
    last = F.coalesce("three", "two", "one")
    before = F.when(F.col("three").isNotNull(), F.col("two")).when(F.col("two").isNotNull(), F.col("one"))
    first = F.when(F.col("three").isNotNull(), F.col("one"))
    rows = frequent.where("one is not null").select(
        "lang", last.alias("last"), before.alias("before"), first.alias("first"), "n", "begins1", "begins2", "goes_on"
    )
    spark = frequent.sparkSession
    sample = rows.select("lang", "last", F.coalesce("before", F.lit(b"")).alias("before"))
    fraction = min(1.0, SAMPLE_ROWS / max(rows.count(), 1))
    picked = (sample.sample(fraction=fraction, seed=1) if fraction < 1.0 else sample).collect()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = max(ranges, int(len(picked) / fraction // RANGE_PHRASES))
    limits = _quantiles([(r["lang"], bytes(r["last"]), bytes(r["before"])) for r in picked], ranges)
    begin_counts, end_counts = _counts_of(frequent, prefix_limits), _counts_of(frequent, limits)
    names = rows.columns

    def place(batches):
        for batch in batches:
            keys = zip(batch["lang"].to_pylist(), batch["last"].to_pylist(), batch["before"].to_pylist())
            spots = [bisect.bisect_right(limits, (lang, last, before or b"")) for lang, last, before in keys]
            yield pa.RecordBatch.from_arrays([pa.array(spots, pa.int32()), *batch.columns], ["range", *names])

    def work(batches):
        waiting, current = [], None
        for batch in batches:
            keys = list(zip(batch["range"].to_pylist(), batch["lang"].to_pylist()))
            at = 0
            while at < len(keys):
                end = bisect.bisect_right(keys, keys[at], at)
                if keys[at] != current and waiting:
                    yield from _judged(current[1], waiting, begin_counts, end_counts, share)
                    waiting = []
                current = keys[at]
                waiting.append(batch.slice(at, end - at))
                at = end
        if waiting:
            yield from _judged(current[1], waiting, begin_counts, end_counts, share)

    schema = "range int, lang string, last binary, before binary, first binary, n long, begins1 long, begins2 long, goes_on long"
    placed = rows.mapInArrow(place, schema).repartitionById(len(limits) + 1, F.col("range"))
    return placed.sortWithinPartitions("range", "lang").mapInArrow(work, SCORED)


def _judged(lang, batches, begin_counts, end_counts, share) -> Iterator[pa.RecordBatch]:
    """Scores of the phrases of one range of endings; the automaton spells them from the end."""
    table = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name: table[name].combine_chunks()
    last, before, first = column("last"), column("before"), column("first")
    every = pa.concat_arrays([last, before, first]).dictionary_encode()
    order = pc.array_sort_indices(every.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[every.indices.fill_null(0).to_numpy()]
    words = every.dictionary.take(pa.array(order))
    size = len(last)
    last, before, first = codes[:size], codes[size : 2 * size], codes[2 * size :]
    n = column("n").to_numpy()
    has = [column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("before", "first")]
    is_one, is_three = ~has[0], has[1]
    is_two = has[0] & ~has[1]
    one, one_n = summed(last[is_one], n[is_one])
    two, two_n = summed(last[is_two] << SHIFT | before[is_two], n[is_two])
    place = np.searchsorted(two, last[is_three] << SHIFT | before[is_three])
    three, three_n = summed(place << SHIFT | first[is_three], n[is_three])
    automaton = Transducer.of(Phrases(words, one, one_n, two, two_n, three, three_n))

    texts = words.to_pylist()
    at = np.flatnonzero(has[0])
    ends1 = automaton.weights(last[at]).tolist()
    ends2 = np.where(is_three[at], automaton.weights(last[at], before[at]), 0).tolist()
    preceded = automaton.heaviest(last[at], before[at]).tolist()
    columns = {c: column(c).take(pa.array(at)).to_pylist() for c in ("n", "begins1", "begins2", "goes_on")}
    out = []
    for k, row in enumerate(at.tolist()):
        a, begins, end = columns["n"][k], columns["begins1"][k], ends1[k] or end_counts[lang, texts[last[row]]]
        middle, third = texts[before[row]], texts[last[row]]
        if is_three[row]:
            head = texts[first[row]]
            begins = begins or begin_counts[lang, head]
            cuts = [(begins, ends2[k]), (columns["begins2"][k], end)]
            score, cut = min((1_000_000 * a * a // (l * r), c) for c, (l, r) in enumerate(cuts))
            out.append((lang, head, middle, third, a, *cuts[cut], score))
        elif 100 * max(columns["goes_on"][k], preceded[k]) < share * a:
            begins = begins or begin_counts[lang, middle]
            out.append((lang, middle, third, None, a, begins, end, 1_000_000 * a * a // (begins * end)))
    if out:
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
        names = [piece.split()[0] for piece in SCORED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)


def mine_phrases(
    docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words of each language.

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends, and those at spaces and
    tabs. ``a`` counts a phrase, ``l`` and ``r`` the parts of its lowest-scoring cut (the first one on a tie),
    ``n`` the language's words; score = ⌊10⁶ a² / (l r)⌋, exact. Phrases counted less than ``least`` times
    are left out, and those inside a longer counted one with at least ``share`` percent of their count.
    Order: score, a (falling), phrase in bytes. A null language is ``und``, a null or empty text has no words, repeated
    rows count each, an empty table gives no row.
    """
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), F.col(text).cast("binary").alias("text")
    )
    limits = _sample_limits(texts)
    united = _united(_shards(texts, limits), len(limits) + 1, least)
    frequent = materialize(united, "phrase-counts")
    totals = frequent.where("one is null").groupBy("lang").agg(F.sum("n").alias("n"))
    parts = [F.col(c).cast("string") for c in ("one", "two", "three")]
    scored = _scored(frequent, limits, share).select("lang", F.concat_ws(" ", *parts).alias("phrase"), "a", "l", "r", "score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best)))
    few = few.where(F.col("rank") <= top).drop("rank", "salt")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
