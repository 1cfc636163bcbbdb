"""Every operator against a brute-force version, and on nulls, empty and repeated rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from adjudica.llm import (
    decontaminate,
    html_text,
    license_scan,
    line_crf,
    near_duplicates,
    packing,
    quality_rules,
    surrogates,
    token_counts,
    token_files,
)
from adjudica.llm.queries import QUERIES, vocabulary_path
from adjudica.session import new_path

SCHEMA = "doc_id long, text string, key string, row string, kept boolean, n_words long"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None), (None, None), (7, ""), (7, ""), (5, None), (8, " \n\t "), (9, "one two  three\n\n x <|endoftext|> y")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def docs(spark, small):
    """The small documents, odd rows among them, and columns whose names operators use themselves."""
    own = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    odd = odd.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    clash = {"key": F.lit("k"), "row": F.lit("r"), "kept": F.lit(True), "n_words": F.lit(3)}
    path = new_path(spark, "documents")
    own.union(odd).withColumns(clash).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    return [library.encode(text, add_special_tokens=False).ids for _, text in rows]


def bag(frame, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


def test_an_empty_table_gives_no_row(spark):
    empty = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    folder = new_path(spark, "empty")
    token_files.write_token_files(empty, folder, vocabulary_path())
    results = [
        packing.pack_documents(empty, vocabulary_path()),
        decontaminate.contamination(empty, bench),
        license_scan.scan_licenses(empty),
        quality_rules.judge(empty),
        line_crf.score_documents(empty, labels),
        token_files.document_offsets(token_files.read_token_files(spark, folder)),
        token_counts.count_tokens(empty, vocabulary_path()),
        near_duplicates.near_duplicates(empty),
        html_text.extract_text(empty, "doc_id", "text"),
        surrogates.replace_personal_data(empty, "k"),
    ]
    assert [frame.count() for frame in results] == [0] * 10


def test_token_counts(docs, rows, ids):
    got = bag(token_counts.count_tokens(docs, vocabulary_path()), "doc_id", "n_bytes", "n_tokens")
    assert got == Counter((k, len(t.encode()), len(i)) for (k, t), i in zip(rows, ids))


def test_packing_cuts_each_document_once_and_fills_windows(docs, rows, ids):
    pieces = packing.pack_documents(docs.where("doc_id is not null"), vocabulary_path()).collect()
    whole, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        whole[p["doc_id"]].append((p["start"], bytes(p["ids"])))
        windows[p["sequence_id"]].append((p["offset"], len(p["ids"]) // 4))
    expected = defaultdict(list)
    for (k, _), i in zip(rows, ids):
        if k is not None:
            expected[k].append(struct.pack(f"<{len(i) + 1}I", *i, 0))
    for k, texts in expected.items():
        if len(texts) == 1:
            assert b"".join(part for _, part in sorted(whole[k])) == texts[0]
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0


def test_sum_of_squares_takes_the_least_sum():
    import random

    random.seed(4)
    packer, number, levels = packing.SumOfSquares(16), iter(range(10**6)), Counter()
    for _ in range(400):
        size = random.randint(1, 15)
        costs = {}
        for level in [0, *[h for h, n in levels.items() if n and h + size <= 16]]:
            after = levels.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 16
            costs[level] = sum(n * n for n in after.values())
        _, offset = packer.place(size, lambda: next(number))
        assert costs[offset] == min(costs.values())
        levels[offset] -= offset > 0
        levels[offset + size] += offset + size < 16


def test_token_files_round_trip(spark, docs, rows, ids):
    folder = new_path(spark, "files")
    token_files.write_token_files(docs, folder, vocabulary_path(), file_tokens=30_000)
    got = token_files.document_offsets(token_files.read_token_files(spark, folder)).collect()
    full = [(k, struct.pack(f"<{len(i) + 1}I", *i, 2)) for (k, _), i in zip(rows, ids)]
    full.sort(key=lambda d: (d[0] is not None, d[0] or 0, zlib.crc32(d[1])))
    start, expected = 0, Counter()
    for k, i in full:
        expected[k, start, len(i) // 4, zlib.crc32(i)] += 1
        start += len(i) // 4
    assert Counter(tuple(r) for r in got) == expected


def test_values_of_all_lengths_survive():
    import numpy as np

    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5], dtype=np.uint32)
    counts = np.array([4, 0, 5])
    packed = token_files.pack_values(values, counts)
    back = [token_files.unpack_values(c, d, n) for (c, d), n in zip(packed, counts)]
    assert np.concatenate(back).tolist() == values.tolist()


def test_quality_counts(docs, rows):
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_rules.judge(docs)
    got = bag(judged.select("row.doc_id", *[f"quality.{c}" for c in counts], "base_failed"),
              "doc_id", *counts, "base_failed")
    expected = Counter()
    for k, text in rows:
        w = SPACED.findall(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        expected[k, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
                 len(lines) - len(set(lines)), len(covered), failed] += 1
    assert got == expected
    assert judged.where("kept and base_failed").count() == 0


def test_quality_rules_follow_the_labels(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    judged = quality_rules.judge(docs).where("not base_failed").select("row.doc_id", "kept")
    joined = judged.join(labels, "doc_id")
    assert joined.where("kept <> (quality = 1)").count() == 0


def test_decontamination(spark, small, docs, rows):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    extra = [(None, "x y"), (901, None), (902, ""), (903, "one two"), (904, "Three x")]
    bench = bench.select("item_id", "text").union(spark.createDataFrame(extra, "item_id long, text string"))
    windows = defaultdict(set)
    for item, text in bench.collect():
        w = ALNUM.findall(lower(text or ""))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])] |= {str(item)} if item is not None else set()
    expected = Counter()
    for k, text in rows:
        w = ALNUM.findall(lower(text))
        hit, items = set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    hit.update(range(s, s + size))
                    items |= windows[tuple(w[s : s + size])]
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        expected[k, len(w), len(hit), len(items), digest, bool(hit)] += 1
    found = decontaminate.contamination(docs, bench)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert bag(found, *names) == expected
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for k, n in expected.items() if not k[-1])


def test_license_base_places_and_variants(spark, docs, rows):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"],
               "gpl": ["general", "public", "license"]}
    expected = Counter()
    for k, text in rows:
        w = ALNUM.findall(lower(text))
        at = {(s, label) for label, p in phrases.items() for s in range(len(w)) if w[s : s + len(p)] == p}
        places = [s for s, _ in at]
        expected[k, len(w), len(at), min(places, default=None), max(places, default=None),
                 ",".join(sorted({label for _, label in at}))] += 1
    found = license_scan.scan_licenses(docs)
    assert bag(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == expected
    assert found.where("score < 0 or score > 1").count() == 0
    text = "x " * 50 + "Redistribution, and use in source and binary forms with or without change are permitted "
    text += "provided that the following conditions are met: " + "y " * 50
    one = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert one["labels"] == "bsd" and 0.8 < one["score"] < 1


def _sets(rows):
    sets = {}
    for k, text in rows:
        w = SPACED.findall(lower(text))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return sets


def test_near_duplicates(docs, rows):
    known = [(k, t) for k, t in rows if k is not None and not (k >= 1_000_000 and t == "")]
    sets = _sets(known)
    parent = {k: k for k in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs).collect()}
    for k in sets:
        assert (got[k]["n_shingles"], got[k]["component_id"]) == (len(sets[k]), find(k))
    assert near_duplicates.near_duplicates(docs).count() == len(rows)
    assert near_duplicates.without_near_duplicates(docs).columns == docs.columns


def test_chains_of_near_copies_and_a_hot_group(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(0, " ".join(words))] * 2
    for k in range(1, 40):
        words = words[2:] + [f"n{k}a", f"n{k}b"]
        texts.append((k, " ".join(words)))
    texts += [(100 + k, "same words again and again here") for k in range(300)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(frame).collect()}
    assert {got[k] for k in range(40)} == {0} and {got[100 + k] for k in range(300)} == {100}


def test_super_minhash_estimates_the_similarity():
    import numpy as np

    draw = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        pool = draw.integers(0, 2**63, 300).astype(np.uint64)
        a, b = near_duplicates.super_minhash(pool[:240]), near_duplicates.super_minhash(pool[60:])
        errors.append((a == b).mean() - 180 / 300)
    assert abs(np.mean(errors)) < 0.02


def test_bitmaps_rule_out_no_near_pair(spark):
    from numpy.random import default_rng

    draw = default_rng(5)
    rows, near = [], []
    for k, size in enumerate([1, 2, 7, 40, 300, 3000] * 30):
        pool = draw.integers(0, 2**64, 2 * size, dtype="uint64")
        gone, new = draw.integers(0, 1 + size // 3, 2)
        a, b = pool[:size], pool[gone : size + new]
        near.append(near_duplicates.is_near(a, b))
        rows.append((k, len(a), len(b), near_duplicates.bitmap(a), near_duplicates.bitmap(b)))
    frame = spark.createDataFrame(rows, "k long, n long, m long, x array<bigint>, y array<bigint>")
    fits = frame.select("k", near_duplicates._bits_fit("n", "m", "x", "y").alias("fit")).collect()
    assert all(r["fit"] for r in fits if near[r["k"]]) and 20 < sum(near) < 170
    assert not all(r["fit"] for r in fits)


def test_surrogates(spark, small):
    text = [
        (1, "Mr. Smith, Anna Jones, +1 (425) 555-9684, a.b9@m1.example.com, A.B9@M1.EXAMPLE.COM"),
        (2, "Mrs. Smith 4111 1111 1111 1111 and 4111111111111111 at 97.51.17.173 token = \"" + "a1" * 20 + "\""),
        (3, None), (None, "x 123-45-6789 y"), (None, "x 123-45-6789 y"), (5, ""), (6, "plain words only"),
    ]
    frame = spark.createDataFrame(text, "doc_id long, text string")
    out = {r["doc_id"]: r for r in surrogates.replace_personal_data(frame, "k").select("row.doc_id", "text", "n_entities").collect()}
    assert out[3]["text"] is None and out[6]["text"] == "plain words only" and out[5]["n_entities"] == 0
    for real in ("Smith", "Jones", "555-9684", "a.b9@", "4111", "97.51.17.173", "a1" * 20, "123-45-6789"):
        assert not any(real in (r["text"] or "") for r in out.values())
    low, high = re.search(r"(\S+@\S+), (\S+@\S+)$", out[1]["text"]).groups()
    assert low.upper() == high and re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", out[1]["text"])
    spaced, joined = re.search(r"((?:\d{4} ){3}\d{4}) and (\d{16})", out[2]["text"]).groups()
    assert spaced.replace(" ", "") == joined
    digits = [int(c) for c in reversed(joined)]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates_stay_distinct(spark):
    numbers = [("phone", f"{k:04d}", "", "latin") for k in range(0, 600, 10)]
    entities = spark.createDataFrame(numbers, "kind string, core string, gender string, script string")
    made = surrogates.surrogate_table(entities, "k").collect()
    assert len(made) == 60 == len({r["surrogate"] for r in made})
    assert not {r["surrogate"] for r in made} & {core for _, core, _, _ in numbers}


@pytest.mark.parametrize("n", [60, 1000])
def test_surrogates_of_a_nearly_full_space(spark, n):
    """60 of the 100 numbers that start with 0 are real; of 1,000 numbers none is free, and they grow."""
    numbers = [("phone", f"{k:03d}", "", "latin") for k in range(n)]
    letters = [("email", f"{c}@a.example.com", "", "latin") for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    names = [("name", f"{a}{b} smith", "f", "latin") for a in "bcdfghjkl" for b in ("ana", "eva", "ina", "ola")]
    rest = [("secret", "--------", "", "latin"), *letters, *names] if n == 60 else []
    frame = spark.createDataFrame(numbers + rest, "kind string, core string, gender string, script string")
    made = surrogates.surrogate_table(frame, "k").collect()
    assert {(r["kind"], r["core"]) for r in made} == {(k, c) for k, c, _, _ in numbers + rest}
    assert len({(r["kind"], r["surrogate"]) for r in made}) == len(made) == len(numbers + rest)
    assert not {r["surrogate"] for r in made} & {core for _, core, _, _ in numbers + rest}
    lengths = Counter(len(r["surrogate"]) for r in made if r["kind"] == "phone")
    assert set(lengths) == {3} if n == 60 else min(lengths) > 3


REAL = [
    "+33 6 12 34 56 78", "+34 612 34 56 78", "+49 170 123 45 67", "030 1234567", "01 23 45 67 89", "(030) 123-4567",
    "+44 (0)20 7946 0958", "Dr. Weber", "Prof. Dr. Jürgen Klein", "Matthias Vogel", "Françoise Dupont", "Людмила Орлова",
    "Anna Maria Schmidt", "Eleanor O'Brien", "Anne-Marie Petit",
]
SECRETS = {"token=": "eyJhbGciOiJIUzI1NiJ9.eyJzdWIi.c2lnbg", "password: ": "P@ssw0rd!2024", 'api_key: "': "ab.cd/ef+gh=="}
PLAIN = ["on 01.02.2024 10:30", "0.12345678 of it", "Grace Under Fire", "2024-01-02 03:04:05", "00:00:00", "a secret: no"]


def test_personal_data_of_other_forms_is_found(spark):
    text = [f"see {real}, then" for real in REAL] + [f"x {a}{b}\" y" for a, b in SECRETS.items()] + PLAIN
    frame = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    replaced = surrogates.replace_personal_data(frame, "k").select("row.doc_id", "text", "n_entities")
    out = {r["doc_id"]: r for r in replaced.collect()}
    for k, real in enumerate([*REAL, *SECRETS.values()]):
        assert out[k]["n_entities"] == 1, (real, out[k])
        parts = [p for p in re.split(r"[ .]", real) if len(p) > 4 and p not in ("Prof",)]
        assert real not in out[k]["text"] and not [p for p in parts if p in out[k]["text"]], out[k]
        if k < len(REAL):
            assert re.fullmatch(r"see .*, then", out[k]["text"])
            assert re.sub(r"\d", "9", out[k]["text"])[4:-6] == re.sub(r"\d", "9", real) or not real[-1].isdigit()
    for k in range(len(REAL) + len(SECRETS), len(text)):
        assert out[k]["text"] == text[k]


def test_titled_surnames_stay_distinct_and_follow_full_names(spark):
    letters = "abcdefghij"
    made_up = [f"X{a}{b}{c}o" for a in letters for b in letters for c in letters]
    text = [(k, f"Mr. {name} met John {name}, Mr. Paul {name} and Mary {name}.") for k, name in enumerate(made_up)]
    frame = spark.createDataFrame(text, "doc_id long, text string")
    out = [r["text"] for r in surrogates.replace_personal_data(frame, "k").select("text").collect()]
    shape = re.compile(r"Mr\. (\w+) met (\w+) (\w+), Mr\. (\w+) (\w+) and (\w+) (\w+)\.")
    found = [shape.fullmatch(t).groups() for t in out]
    assert len({f[0] for f in found}) == len(made_up) and not {f[0] for f in found} & set(made_up)
    assert all(f[0] == f[2] == f[4] == f[6] and f[1] != f[3] for f in found)


def test_line_field_marginals_equal_enumeration():
    import itertools

    import numpy as np

    draw = np.random.default_rng(3)
    field = line_crf.LineField(draw.normal(size=3 * line_crf.OWN_FEATURES), draw.normal(size=(2, 2)))
    chains = [draw.normal(size=(n, 3 * line_crf.OWN_FEATURES)) / 5 for n in (4, 1, 3)]
    good, _ = field.marginals(chains)
    for chain, got in zip(chains, good):
        weight = {}
        for labels in itertools.product((0, 1), repeat=len(chain)):
            energy = sum(y * (x @ field.unary) for x, y in zip(chain, labels))
            weight[labels] = np.exp(energy + sum(field.pair[a, b] for a, b in zip(labels, labels[1:])))
        for t in range(len(chain)):
            want = sum(w for y, w in weight.items() if y[t]) / sum(weight.values())
            assert abs(got[t] - want) < 1e-9


def test_line_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = QUERIES["op5_line_quality"](spark, folder).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) >= 0.97 * len(scored) > 0


def test_visible_text():
    page = """<title>T</title><h1>Head &amp; more</h1><p>One<br>two <b>b</b>c<p>Para <i hidden>no</i>
    <ul><li>a<li>b<ol><li>x<li>y</ol></ul><table><tr><th>Name<th>N<tr><td>Long name<td>1</table>
    <pre>  p\n   q</pre><script>if (a<b)</script><span style="display: none">z</span>tail"""
    assert html_text.visible_text(page).split("\n") == [
        "Head & more", "", "One", "two bc", "", "Para", "", "- a", "- b", "  1. x", "  2. y", "",
        "Name       N", "Long name  1", "", "  p", "   q", "", "tail",
    ]
    assert html_text.visible_text(None) is None and html_text.visible_text("") == ""
    assert html_text.visible_text("<div>" * 5000 + "x") == "x"


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = new_path(spark, "stage")
        stage(spark, docs, small).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns and 0 < after.count() <= docs.count()
        docs = after
    assert docs.where("n_chars <> char_length(text)").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {
        r[0] for r in docs.select("doc_id").collect()
    }
