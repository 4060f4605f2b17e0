"""Every text operator against brute force, on the given tables and on odd rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zlib
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from staywise.llm import suffix_sort
from staywise.llm.bpe import Encoder, decode, encode, load_ranks
from staywise.llm.components import components
from staywise.llm.decontaminate import contaminated, drop_contaminated
from staywise.llm.exact_dedup import drop_copies, exact_dedup
from staywise.llm.html_text import extract_text, main_text
from staywise.llm.line_dedup import drop_lines, within
from staywise.llm.quality import features, score, train
from staywise.llm.queries import ORACLES, QUERIES, TOKENIZER
from staywise.llm.sharding import interleave
from staywise.llm.simhash import GrayIndex, drop_near_copies, fingerprint, gray_rank, near_dedup
from staywise.llm.substring_dedup import _runs, drop_repeats, units
from staywise.llm.suffix_dedup import drop_repeated_bytes
from tests.conftest import SMALL
from tools.check import connect, normalise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, name string, k long, t string, row string"
LONG = " ".join(f"word{i % 977} in a long text of {i}." for i in range(6000))
PASSAGE = " ".join(f"passage{i} goes here" for i in range(20))
BODIES = [
    None, "", " \n\t ", "one", "one", "Two words", "two  words", "a\nb\na\nb", LONG, LONG, LONG + " end", PASSAGE,
    f"first own words {PASSAGE} and more", f"other {PASSAGE}\nline", "aaaa" * 200, "ab" * 300, "é汉🙂 ñandú\x00z", "x" * 99, "x" * 100, "x" * 101,
]


def odd(spark, empty=False):
    """NULLs in every column, repeated rows, a doc_id with two texts, and columns named like internal ones."""
    rows = [] if empty else [(i, b, "en", f"s{i % 2}", len(b or ""), "n", 1, "t", "r") for i, b in enumerate(BODIES)]
    if not empty:
        rows += [rows[8], rows[11], (3, "another text of doc three", None, None, None, None, None, None, None), (None,) * 9, (None, PASSAGE, *[None] * 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts_of(df):
    """(doc_id, text) of all rows, NULL as empty, in the order of the operators."""
    rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, xxh(r[1])))


def xxh(text):
    return int.from_bytes(xxhash.xxh64_digest(text, 42), "big", signed=True)


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(params=["given", "odd", "empty"])
def docs(request, spark, documents):
    return documents if request.param == "given" else odd(spark, request.param == "empty")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normalise(got) == normalise(want)


def test_all_are_registered(spark):
    names = [n for n in entry_point.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11))
    assert "pipeline" in entry_point.queries()


def tokenizer():
    path = public_tokenizers.path(TOKENIZER)
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def test_bpe(docs):
    path, own = tokenizer()
    coded = decode(encode(docs, path, public_tokenizers.PATTERN), path).select("text", "ids", "decoded").collect()
    assert len(coded) == docs.count()
    for row in coded:
        assert row["ids"] == own.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()


def test_bpe_of_long_words_and_long_texts():
    """Words above the bound of the shared index, and texts whose words are not listed, agree with tiktoken."""
    path, whole = tokenizer()
    draw = random.Random(5)
    pieces = ["a", "b", "ab", "the", " ", "  ", "\n", "1", "é", "中文", "ss", "aa", "!", ".."]
    texts = ["".join(draw.choice(pieces) for _ in range(n)) for n in (0, 1, 63, 64, 65, 66, 3000, 400_000)]
    texts += ["a" * n for n in (63, 64, 65, 66, 5000)] + ["ab" * 20_000, "中" * 2000, ""]
    ids, at = Encoder(path, public_tokenizers.PATTERN).encode(texts)
    for text, start, stop in zip(texts, at, at[1:]):
        assert ids[start:stop].tolist() == whole.encode_ordinary(text)


def test_bpe_round_trip_in_one_worker(spark):
    path, _ = tokenizer()
    rows = [(1, "Hello  world, 123", b"x"), (2, None, None), (3, "", b""), (3, "", b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded binary")
    both = encode(df, path, public_tokenizers.PATTERN, decoded="decoded")
    apart = decode(encode(df, path, public_tokenizers.PATTERN), path)
    assert both.columns == apart.columns
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
    assert both.filter("false").count() == 0


def test_bpe_on_random_words():
    path, own = tokenizer()
    draw, encoder = random.Random(5), Encoder(path, public_tokenizers.PATTERN)
    texts = ["".join(draw.choice("theinaons \n'sdé汉1") for _ in range(draw.randint(0, 80))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000, "aba" * 900]
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [own.encode_ordinary(t) for t in texts]


def brute_simhash(text, length):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + length]) for i in range(max(len(words) - length + 1, 1))]
    votes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def test_simhash(docs):
    rows = texts_of(docs)
    prints = [brute_simhash(t, 4) for _, t in rows]
    groups = list(range(len(rows)))

    def find(a):
        while groups[a] != a:
            a = groups[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                groups[max(a, b)] = min(a, b)
    want = sorted((str(k), f"{f:016x}", str(rows[find(i)][0])) for i, ((k, _), f) in enumerate(zip(rows, prints)))
    got = near_dedup(docs)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == want
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert texts_of(kept) == [rows[i] for i in sorted({find(i) for i in range(len(rows))})]


def test_fingerprint_of_a_long_text():
    assert fingerprint(LONG * 8, 4) % (1 << 64) == brute_simhash(LONG * 8, 4)


def test_gray_index_finds_every_pair():
    draw = np.random.default_rng(3)
    seeds = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([seeds] + [seeds ^ (np.uint64(1) << draw.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]))
    nodes = (values % np.uint64(3)).astype(np.int64)
    index = GrayIndex(nodes, values)
    got = {frozenset((int(index.values[a]), int(index.values[b]))) for q, r in index.links(4) for a, b in zip(q, r)}
    want = {
        frozenset((int(a), int(b))) for i, a in enumerate(values) for b in values[:i]
        if a % 3 == b % 3 and int(a ^ b).bit_count() <= 4
    }
    assert got == want and len(want) > 100
    assert sorted(range(16), key=lambda i: int(gray_rank(np.array([i ^ i >> 1], np.uint64))[0])) == list(range(16))


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(1, 1)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(200, 260)} == {7} and 1 not in got


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, line = line, [i]
        for j, y in enumerate(b, 1):
            line.append(min(before[j] + 1, line[-1] + 1, before[j - 1] + (x != y)))
    return line[-1]


def test_banded_edit_distance(spark):
    draw = random.Random(2)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("a", "abcd")]
    for _ in range(1500):
        a = [draw.choice("abé") for _ in range(draw.randint(0, 14))]
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(b))
            b[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "b", "é"])
        pairs.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2, 3):
        for row in frame.select("a", "b", within(F.col("a"), F.col("b"), most).alias("near")).collect():
            assert row["near"] == (edits(row["a"], row["b"]) <= most), row


def test_line_dedup(spark, docs):
    near = [(100, "a line of text that has a twin"), (101, "a line of text that had a twin"), (102, "a lin of text that had a twin!"), (103, "tiny"), (104, "tinz")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows, first = texts_of(docs), {}
    split = [[line.strip(" \t\r\x0b\x0c") for line in text.split("\n")] for _, text in rows]
    for (k, t), lines in zip(rows, split):
        for i, line in enumerate(lines):
            if line:
                first.setdefault(line, (k is None, k or 0, xxh(t), i))
    lengths = defaultdict(list)
    for line in first:
        if len(line) >= 10:
            lengths[len(line)].append(line)
    later = set()
    for n, lines in lengths.items():
        for a in lines:
            for m in range(n, n + 3):
                for b in lengths.get(m, ()):
                    half = n // 3
                    if a != b and n < 5000 and (a[:half] == b[:half] or a[-half:] == b[-half:] or n < 60) and edits(a, b) <= 2:
                        later.add(max(a, b, key=first.get))
    want = []
    for (k, text), lines in zip(rows, split):
        kept = [
            raw for i, (raw, line) in enumerate(zip(text.split("\n"), lines))
            if not line or (line not in later and first[line] == (k is None, k or 0, xxh(text), i))
        ]
        want.append((str(k), "\n".join(kept)))
    got = drop_lines(docs).select(F.col("row.doc_id").cast("string"), "t").collect()
    assert sorted((str(k), t) for k, t in got) == sorted(want)
    assert {"a line of text that had a twin", "tinz"} & later == {"a line of text that had a twin"}


def test_line_dedup_runs_no_python(documents):
    plan = drop_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def normal(text):
    for space in "\t\n\x0b\x0c\r":
        text = text.replace(space, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


@pytest.mark.parametrize("size", [4096, 3])
def test_exact_dedup(docs, size):
    if size == 3:
        docs = docs.filter("length(coalesce(text, '')) < 2000")
    rows, groups = texts_of(docs), defaultdict(list)
    for k, text in rows:
        groups[normal(text)].append(k)
    want = []
    for text, keys in groups.items():
        keep = min((k for k in keys if k is not None), default=None)
        for i, k in enumerate(keys):
            want.append((str(k), str(keep), len(keys), k == keep and keep not in keys[:i], sha(text)))
    got = [(str(r[0]), str(r[1]), *r[2:]) for r in exact_dedup(docs, block_bytes=size).collect()]
    assert sorted(got) == sorted(want)
    assert drop_copies(docs).count() == len(groups)


def test_quality(spark, documents):
    scored = QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").toPandas()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()
    held = [zlib.crc32(str(k).encode()) % 5 == 0 for k in scored.doc_id]
    assert (scored.held_out == held).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = scored.merge(labels, on="doc_id").query("held_out")
    good, bad = both[both.quality == 1].score, both[both.quality == 0].score
    assert np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad]) > 0.95
    assert (both.predicted == both.quality).mean() > 0.95


def test_quality_on_odd_rows(spark, documents):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    for docs in (odd(spark), odd(spark, True)):
        model = train(docs, labels, "doc_id", "text", "quality", F.lit(True))
        rows = score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(np.isfinite(features(b or "")).all() for b in BODIES)


def test_decontamination(spark, docs):
    items = [
        (1, "If a train leaves the station at 12 km per hour and Maria walks 30 minutes to catch it, how far does Maria walk?"),
        (2, "short question of only six words"), (3, None), (4, ""), (5, "7 8 9"), (1, None),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    planted = [
        (900, "before it " + items[0][1] + " after it"),
        (901, "If a train leaves the station at 55 km per hour and Paula walks 90 minutes to catch it, how far does Paula walk?"),
        (902, "If a train leaves the station at 55 km per hour and Paula walks 90 minutes to catch it, how far does Peter walk?"),
        (903, "If a train stands at the station and nobody walks 30 minutes to see it there is little to ask."),
        (904, "he put a short question of only six words to them"), (905, "7 8 9 and 7 8 9"),
    ]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {r["doc_id"]: r["items"] for r in contaminated(more, benchmark).collect()}
    assert got == {900: [1], 901: [1], 904: [2]}
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert drop_contaminated(more, benchmark).count() == more.count() - 3
    assert contaminated(docs, benchmark.limit(0)).count() == 0


ITEM = "If a train leaves the station at 12 km per hour and Maria walks 30 minutes to catch it, how far does Maria walk?"


def hits(spark, items, texts):
    """Items found per text; the texts' numbers are their keys."""
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["items"] for r in contaminated(frame, benchmark).collect()}


def test_decontamination_in_other_case_and_of_mostly_numbers(spark):
    items = [ITEM, "Add 3 4 5 km to 7", "7 8 9 10"]
    texts = ["so " + ITEM.upper() + " yes", ITEM.title(), "first Add 3 4 5 km to 7 then", "first Add 3 4 5 km to 8 then", "7 8 9 10"]
    assert hits(spark, items, texts) == {0: [0], 1: [0], 2: [1]}


def test_decontamination_of_other_numbers_and_names(spark):
    items = [
        "Maria picks 3 apples and 5 pears in the garden and eats 2 of them with 2 friends, how many are left over?",
        "Tom buys 3 boxes. Tom sells 2 boxes. Tom asks how many remain.", "What is the capital of France?",
    ]
    texts = [
        "Maria picks 4 apples and 4 pears in the garden and eats 3 of them with 4 friends, how many are left over?",
        "Mary Ann picks twenty five apples and 4 pears in the garden and eats 3 of them with 4 friends, how many are left over?",
        "Sam buys 4 boxes. Sam sells 3 boxes. Sam asks how many remain.",
        "Sam buys 4 boxes. Ann sells 3 boxes. Joe asks how many remain.\nand then Tom asks nothing", "they asked What is the capital of Spain and left",
        "Sam buys 4 boxes. Sam sells 3 boxes. Bob buys it.", "Paris is the capital of France.",
        "Maria picks 4 apples and 4 pears in the garden so very often and eats 3 of them with 4 friends, how many are left over?",
    ]
    got = hits(spark, items, texts)
    assert {k: got.get(k) for k in (0, 1, 2, 4, 7)} == {0: [0], 1: [0], 2: [1], 4: [2], 7: [0]} and 6 not in got


def test_decontamination_tells_texts_of_one_key_apart(spark):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    other = ITEM.replace("Maria", "Paula").replace("12", "55")
    rows = [(None, ITEM), (None, "clean text"), (None, None), (1, ITEM), (1, other), (1, "clean too")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(str, (r["text"] for r in drop_contaminated(frame, benchmark).collect())))
    assert kept == ["None", "clean text", "clean too"]


def test_verbatim_items_are_found(spark, documents):
    items = {r["item_id"]: " ".join(r["text"].split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = {}
    for k, text in texts_of(documents):
        if hits := [i for i, item in items.items() if item in " ".join(text.split())]:
            want[k] = sorted(hits)
    got = {r["doc_id"]: r["items"] for r in QUERIES["op6_decontaminate"](spark, SMALL).collect() if not r["kept"]}
    assert got == want and want


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>One</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies, and more cookies.</div><article><h1>Head &amp; more</h1><p>First <b>bold</b>,<br>second.<p>Third &lt;x&gt;.</article>"
    "<div id=comments><p>I liked this, very much, indeed.</p></div><form><label>Name</label></form><script>if (a<b) {}</script><footer>&copy; us</footer></body></html>"
)


def test_html_text(spark):
    want = "Head & more\n\nFirst bold, second.\n\nThird <x>."
    plain = "<div><div>" + "".join(f"<p>Paragraph {i}, which says a thing or two, and ends.</p>" for i in range(5)) + "</div><ul><li>a</li><li>b</li></ul></div>"
    assert main_text(PAGE) == want
    assert main_text(plain).count("\n\n") == 4 and "a" not in main_text(plain).split("\n\n")
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>open <b>text", "x"), (None, "u", PAGE, None), (1, "u", PAGE, "x"), (5, "u", "<p>" * 3000 + "deep", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract_text(frame).collect()]
    texts = [want, "", "", "open text", want, want, "deep"]
    assert got == [(r[0], t, len(t)) for r, t in zip(rows, texts)]
    assert extract_text(frame.limit(0)).count() == 0


def test_html_text_keeps_lists_tables_and_headings_of_an_unmarked_article():
    said = "This says a thing or two, then some more, and ends here. " * 7
    items = "".join(f"<li>item number {i} of a list without any marks</li>" for i in range(5))
    table = "<table><tr><th>Name<th>Size<tr><td>box<td>12</table>"
    menu = "".join(f"<li><a href=x>Menu {i}</a></li>" for i in range(5))
    body = f"<h1>The title</h1><p>{said}</p><p>{said} See <a href=x>here</a>.</p><ul>{items}</ul>{table}<h2>Part two</h2><ul>{menu}</ul><p>{said}</p>" + f"<p>{said}</p>" * 5
    for page in (f"<body><div class=top>Welcome</div><div id=x>{body}</div><ul>{menu}</ul></body>", f"<body>{body}</body>"):
        got = main_text(page)
        for kept in ("item number 0 of", "item number 4 of", "box", "12", "Part two", "here"):
            assert kept in got, kept
        assert "Menu" not in got and "Welcome" not in got
    assert "The title" in main_text(f"<div id=x>{body}</div>")


@pytest.mark.parametrize("name", ["elementor-widget elementor-widget-text-editor", "content sidebar-right", "post share-enabled", "legal-content", "widget"])
def test_html_text_of_wrapped_articles(name):
    said = "This says a thing or two, then some more, and ends here. " * 7
    inner = f"<h1>Head</h1><p>{said}</p><p>{said}</p>"
    noise = f"<div class='comments-area'><article><p>{said * 9}</p></article></div>"
    for marked in (f"<article>{inner}</article>", f"<div>{inner}</div>", f"<div class='{name}'>{inner}</div>"):
        for page in (f"<form action=x>{marked}<input></form>", f"<div class='{name}'>{marked}</div>", f"<form><div class='{name}'>{marked}</div></form>"):
            assert main_text(page) == "\n\n".join(["Head", said.strip(), said.strip()]), page[:60]
    assert main_text(f"<form><article>{inner}</article>{noise}</form>") == main_text(f"<article>{inner}</article>")


def test_html_text_of_the_given_pages(spark):
    for row in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = row["html"].split("<article>")[1].split("</article>")[0]
        got = main_text(row["html"])
        assert "©" not in got and got.split("\n\n")[0] == main_text(f"<article>{article}</article>").split("\n\n")[0]
        assert got == main_text(f"<article>{article}</article>")


def test_suffix_sorting():
    draw = np.random.default_rng(1)
    for _ in range(200):
        symbols = draw.integers(0, draw.integers(1, 6), draw.integers(1, 150)).astype(np.int64)
        words, plain = suffix_sort.pack(symbols), symbols.tolist()
        order = suffix_sort.suffix_array(symbols, words, 300)
        assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])


def test_suffix_dedup(docs):
    seen, want = {}, []
    for k, text in texts_of(docs):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            # a fully equal row is the same text
            if seen.setdefault(data[i : i + 100], (k, text, i)) != (k, text, i):
                gone[i : i + 100] = b"\1" * 100
        want.append((str(k), sum(gone), sha(bytes(b for b, g in zip(data, gone) if not g))))
    got = drop_repeated_bytes(docs).select("row.doc_id", "row.text", "t", "spans").collect()
    found = [(str(k), sum(b - a for a, b in s), sha(bytes(t))) for k, _, t, s in got]
    assert sorted(found) == sorted(want)


def test_substring_dedup(docs):
    seen, want = {}, []
    for k, text in texts_of(docs):
        hits = []
        for number, (a, b) in enumerate(units(text)):
            words = text[a:b].split()
            if seen.setdefault(" ".join(words).casefold(), (k, text, a)) != (k, text, a):
                hits.append({"unit": number, "start": a, "stop": b, "words": len(words)})
        spans = [(s["start"], s["stop"]) for s in _runs(hits, 20, 5)]
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
        want.append((str(k), kept + text[at:], spans))
    got = drop_repeats(docs).select("row.doc_id", "t", "spans").collect()
    assert sorted((str(k), t, [(s["start"], s["stop"]) for s in spans or ()]) for k, t, spans in got) == sorted(want)


def test_substring_dedup_removes_whole_lines(spark, docs):
    han = "我们今天去了公园看了很多美丽的花朵然后慢慢走回家吃饭休息" * 2
    more = [
        (1000, "short line\n\nOne here. Two there.\nkept one"), (1001, "Short  LINE\nkept two\none here. two there.\n \nshort line"),
        (1002, f"{han}。第一个。\nx。" + han + "。别的话在这里。"), (1003, "A short line.\n" + han + "！\n" + han + "！"),
    ]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = drop_repeats(docs, lines=True).select("row.doc_id", "row.text", "t", "spans").collect()
    left = {k: t for k, _, t, _ in got}
    assert left[1001] == "\nkept two\n" + "\n \n" and left[1000] == more[0][1]
    assert left[1003] == "A short line.\n" + han + "！\n" and left[1002] == f"{han}。第一个。\nx。别的话在这里。"
    got.sort(key=lambda r: (r[0] is None, r[0] or 0, xxh(r[1] or "")))
    first, later = {}, 0
    for k, text, _, spans in got:
        at = 0
        for line in (text or "").split("\n"):
            normal = " ".join(line.split()).casefold()
            if normal and first.setdefault(normal, (k, text, at)) != (k, text, at):
                begin, later = at + len(line) - len(line.lstrip()), later + 1
                assert any(s["start"] <= begin and begin + len(line.strip()) <= s["stop"] for s in spans or ()), line
            at += len(line) + 1
    assert later >= 4


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_sharding(docs, shards):
    rows = interleave(docs, shards, "doc_id", "text", "source", 42, bucket_rows=7).collect()
    texts = texts_of(docs)
    want = sorted((str(k), len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r)
    counts = [len(held[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(0 <= r["shard"] < shards for r in rows)
    for members in held.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    for source in {r["source"] for r in rows}:
        per = [sum(r["source"] == source for r in held[s]) for s in range(shards)]
        assert max(per) - min(per) <= 2


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.count() > 100
    ran = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, docs.collect()))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in docs.collect()} == {k: sha(t or "") for k, t in texts.items()}


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, empty):
    docs = odd(spark, empty)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() <= docs.count()
