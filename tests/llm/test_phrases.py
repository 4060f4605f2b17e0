"""Phrases against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from staywise.llm import phrases
from staywise.llm.phrases import _fold, _tokens, collocations, phrase_counts
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, head string, n long, k int"


def pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", text)]


def brute(rows, longest=3, least=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for words in pieces(text):
            n["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        bad = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                bad |= {q for i in range(len(p) - k + 1) if 100 * a >= inside * counts[q := p[i : i + k]]}
        scored = []
        for p in found.keys() - bad:
            a = found[p]
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def odd(spark):
    rng = random.Random(5)
    vocabulary = ["a", "B", "b", "ü", "Ä", "x y", "x\u0085", "\x1c", "zz", "…", "\x00", "10", "\U0010ffff"]
    texts = [None, "", " \t ", "...", "a", "a b", ("Hot pair " * 3000).strip(), "one,two;three\vfour\ffive\rsix", "y" * 50_000]
    texts += ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "! "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i if i % 5 else None, t, rng.choice([None, "und", "en", "a\nb", "a", ""]), "h", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:20] + [(None,) * 6], SCHEMA).repartition(4)


def taken(df):
    return [(r["text"], r["lang"]) for r in df.select("text", "lang").collect()]


def test_given_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(map(tuple, collocations(df).collect())) == brute(taken(df))


@pytest.mark.parametrize("options", [{}, {"least": 2}, {"longest": 4, "least": 3, "inside": 30}, {"longest": 2, "least": 1}, {"least": 2, "top": 5}])
def test_odd_rows(spark, options, monkeypatch):
    df = odd(spark)
    assert sorted(map(tuple, collocations(df, **options).collect())) == brute(taken(df), **options)


def test_empty_table(spark):
    assert collocations(odd(spark).limit(0)).collect() == []
    assert collocations(spark.createDataFrame([(1, "...", "en", "", 1, 1)], SCHEMA)).collect() == []


def test_all_kept_counts(spark):
    df = odd(spark)
    want = defaultdict(Counter)
    for text, lang in taken(df):
        for words in pieces(text):
            for k in range(1, 4):
                want["und" if lang is None else lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    got = phrase_counts(df, least=4).filter("k > 0").collect()
    assert len(got) == len({(r.lang, r.phrase) for r in got})
    assert {(r.lang, r.phrase, r.f) for r in got} == {(g, p, n) for g, c in want.items() for p, n in c.items() if n >= 4}


def test_slices_cut_no_word(monkeypatch):
    text = " ".join(random.Random(3).choice(["ab", "c", "d" * 40, "é"]) for _ in range(400)).replace("c c", "c. c").encode()
    whole = [w for part in _tokens(text) for w in part]
    for size in (1, 2, 7, 30, 100):
        monkeypatch.setattr(phrases, "SLICE", size)
        assert [w for part in _tokens(text) for w in part] == whole


def test_folding_is_the_same_for_any_batches():
    rng = random.Random(9)
    codes = {"x": "\t!!", "b": "\t!#"}
    rows = sorted((f"en\\n\\s\n{rng.choice(['a', codes['b']])} {(w := rng.choice(['', codes['x'], 'y', 'z']))} {rng.choice('pqr') if w else ''}", rng.randrange(1, 4)) for _ in range(60))

    def run(size):
        lots = [rows[i : i + size] for i in range(0, len(rows), size)]
        got = Counter()
        for b in _fold(iter([pa.RecordBatch.from_pydict({"key": [r[0] for r in lot], "n": [r[1] for r in lot]}) for lot in lots]), 3, 12, codes):
            for r in b.to_pylist():
                got[r["lang"], r["w1"], r["w2"], r["w3"]] += r["n"]
        return got

    whole = run(60)
    assert sum(whole.values()) == sum(r[1] for r in rows) and {k[0] for k in whole} == {"en\n "}
    assert {k[1] for k in whole} == {"a", "b"} and {k[2] for k in whole} <= {"", "x", "y", "z"}
    full = Counter()
    for key, n in rows:
        full[tuple({v: k for k, v in codes.items()}.get(w, w) for w in key.partition("\n")[2].split(" "))] += n
    assert all(whole[("en\n ", *k)] == n for k, n in full.items() if k[2] and n >= 12)
    for size in (1, 2, 3, 7):
        assert run(size) == whole


def test_codes_are_different_and_languages_come_back():
    codes = [phrases._code(i) for i in range(phrases.CODES)]
    assert len(set(codes)) == len(codes) and not any(" " in c or "\n" in c for c in codes)
    for lang in ("", "a b", "a\\sb\n", "\\n", "\\\\s ", "é"):
        assert phrases._unescaped(phrases._escaped(lang)) == lang and not {" ", "\n"} & set(phrases._escaped(lang))
