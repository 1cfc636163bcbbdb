"""Automata, runs and mined phrases against direct counts, and odd rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from adjudica.llm import phrases
from adjudica.llm.count_automata import LOW, SHIFT, Transducer, union
from adjudica.llm.queries import ORACLES, QUERIES
from tests.check_oracle import compare, connect

SCHEMA = "lang string, text string, rank int, phrase string, n string, one int"
TEXTS = ["A b a b. a B c\tc", "", None, "b b b b b b", "x, y; z: a b!c?d\ne", "ü Ü ü a\x01b \x00 . .", "a b c " * 30 + ". " + "a b " * 9]


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def counts(rows):
    found = Counter()
    for lang, text in rows:
        for words in pieces(text):
            for k in (1, 2, 3):
                found.update((lang or "und", " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return found


def mined(rows, least, top, share):
    """The contract by direct definition."""
    f = counts(rows)
    chosen = {p for p in f if f[p] >= least and len(p[1].split(" ")) > 1}
    out = []
    for lang, phrase in chosen:
        words, a = phrase.split(" "), f[lang, phrase]
        around = [q for q in chosen if q[0] == lang and q[1].count(" ") > phrase.count(" ") and f" {phrase} " in f" {q[1]} "]
        if any(100 * f[q] >= share * a for q in around):
            continue
        cuts = [(f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]) for k in range(1, len(words))]
        score, _, l, r = min((10**6 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        n = sum(v for (name, p), v in f.items() if name == lang and " " not in p)
        out.append((lang, -score, -a, phrase.encode(), l, r, n))
    ranked, place = [], Counter()
    for lang, score, a, phrase, l, r, n in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, l, r, n, -score))
    return ranked


def batch(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([None if r[1] is None else r[1].encode() for r in rows], pa.binary())], ["lang", "text"]
    )


def spelled(found):
    words = [w.decode() for w in found.words.to_pylist()]
    pair = lambda k: f"{words[k >> 32]} {words[k & 0xFFFFFFFF]}"
    out = {words[k]: n for k, n in zip(found.one.tolist(), found.one_n.tolist())}
    twos = [pair(k) for k in found.two.tolist()]
    out |= dict(zip(twos, found.two_n.tolist()))
    out |= {f"{twos[k >> 32]} {words[k & 0xFFFFFFFF]}": n for k, n in zip(found.three.tolist(), found.three_n.tolist())}
    return {phrase: n for phrase, n in out.items() if n}


@pytest.fixture(scope="module")
def rows(spark, small):
    own = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("lang", "text").collect()]
    return own + [("en", t) for t in TEXTS] + [(None, t) for t in TEXTS * 2]


def expected_by_language(rows):
    found = {}
    for (lang, phrase), n in counts(rows).items():
        found.setdefault(lang, {})[phrase] = n
    return found


@pytest.mark.parametrize("window, most", [(2_000_000, 4_000_000), (57, 200), (5, 1)])
def test_runs_and_automata(rows, window, most, monkeypatch):
    """Windows and runs of any size add up to the same counts, which automata keep."""
    monkeypatch.setattr(phrases, "WINDOW", window)
    monkeypatch.setattr(phrases, "MOST_PHRASES", most)
    few = [(lang or "und", text) for lang, text in (rows if window > 100 else rows[-14:])]
    by_lang = {}
    for lang, found in phrases.count_runs([batch(few[:5]), batch(few[5:])]):
        again = Transducer.from_bytes(Transducer.of(found).to_bytes()).phrases()
        assert spelled(again) == spelled(found)
        by_lang.setdefault(lang, []).append(again)
    whole = {lang: union(parts) for lang, parts in by_lang.items()}
    expected = expected_by_language(few)
    assert {lang: spelled(p) for lang, p in whole.items() if len(p)} == expected


def test_parts_lookups_and_shared_states(rows):
    found = dict(phrases.count_runs([batch([r for r in rows if r[0] == "en"])]))["en"]
    automaton = Transducer.of(found)
    assert len(automaton.arcs3[0]) < len(found.three)
    first, second = found.two >> SHIFT, found.two & LOW
    assert (automaton.weights(first, second) == found.two_n).all()
    one = dict(zip(found.one.tolist(), found.one_n.tolist()))
    assert automaton.weights(first).tolist() == [one[k] for k in first.tolist()]
    assert automaton.weights(np.array([len(found.words) + 5])).tolist() == [0]
    most = Counter()
    for key, n in zip((found.three >> SHIFT).tolist(), found.three_n.tolist()):
        most[key] = max(most[key], n)
    assert automaton.heaviest(first, second).tolist() == [most[k] for k in range(len(found.two))]
    cuts = [(0, -1), (3, -1), (10, 5), (10, 40), (len(found.words), -1)]
    parts = [found.part(a, b) for a, b in zip(cuts, cuts[1:])]
    assert sum(map(len, parts)) == len(found)
    assert spelled(union(parts)) == spelled(found)


def test_mined_phrases_of_all_texts(spark, rows):
    frame = spark.createDataFrame([(a, b, 1, "p", "n", 2) for a, b in rows], SCHEMA)
    for least, top, share in ((10, 2000, 50), (3, 7, 80)):
        out = phrases.mine_phrases(frame, least, top, share).orderBy("lang", "rank").collect()
        assert [tuple(r) for r in out] == sorted(mined(rows, least, top, share))


def test_empty_table(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
    blank = spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")
    assert phrases.mine_phrases(blank).count() == 0


def test_query_agrees_with_sql(spark, small):
    found = QUERIES["op11_phrases"](spark, small)
    assert compare(found, connect(small), ORACLES["op11_phrases"]) is None
