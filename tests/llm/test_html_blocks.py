"""Inline elements follow their block; nothing of a marked article is lost."""

import random

from staywise.llm.html_text import extract_text, main_text

PARAGRAPH = "<p>" + "A long paragraph, with commas, and text; it goes on and on. " * 6 + "</p>"


def test_inline_elements_stay_in_their_block():
    for before, after in (("<article>", "</article>"), ("<body><div>", "</div></body>")):
        for inner, want in (
            ("<ul><li>see <a href=x>ALPHA</a> now</li><li>and <a>BETA</a> then</li></ul>", "see ALPHA now\n\nand BETA then"),
            ("<ol><li>A. Author <i>X</i> 1984</li></ol>", "A. Author X 1984"),
            ("<dl><dt>what</dt><dd>does <em>X</em></dd></dl>", "what\n\ndoes X"),
            ("<p>go to <a>ALPHA</a> first</p>", "go to ALPHA first"),
        ):
            text = main_text(before + PARAGRAPH * 4 + inner + PARAGRAPH + after)
            assert f"\n\n{want}\n\n" in text, (before, inner)


def test_no_word_of_a_marked_article_is_lost():
    """Blocks of any kind and length, without menus: every word comes out, once and in order."""
    draw = random.Random(11)
    inline = ["{}", "<b>{}</b>", "<i>{}</i>", "<code>{}</code>", "<span class=x>{}</span>"]
    block = ["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>"]
    for _ in range(200):
        number, body, want = 0, [], []
        for _ in range(draw.randint(1, 12)):
            words = []
            for _ in range(draw.choice([1, 2, 3, 40])):
                word = f"w{number}" + draw.choice(["", ",", "."])
                number += 1
                words.append(draw.choice(inline).format(word))
                want.append(word)
            # a link among other words, never most of its block
            body.append(draw.choice(block).format(" ".join([*words, f"<a href=/>l{number}</a>"] if len(words) > 2 else words)))
            if len(words) > 2:
                want.append(f"l{number}")
        page = f"<body><nav><a>home</a></nav><article>{''.join(body)}</article><footer>legal</footer></body>"
        assert main_text(page).split() == want


def test_articles_beside_the_longest_one_count():
    comments = "<div><h3>Say</h3><article><p>I was here, first.</p></article><article><p>Me too, really.</p></article></div>"
    text = main_text(f"<body><article>{PARAGRAPH * 3}</article>{comments}</body>")
    assert "here" not in text and text.count("A long paragraph") == 18
    parts = main_text(f"<main><article>{PARAGRAPH}</article><article><p>Part two.</p></article></main>")
    assert parts.endswith("Part two.")


def test_clashing_columns_empty_and_repeated_rows(spark):
    rows = [(1, "u1", f"<article>{PARAGRAPH}</article>", "x", 1, None, "t", 7)] * 2 + [(2, None, None, None, None, None, None, None), (3, "u3", "", "", 0, "", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, k string, u int, h string, text string, n_chars int")
    out = extract_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r.page_id, r.n_chars, len(r.text)) for r in out.collect())
    length = len(PARAGRAPH) - len("<p> </p>")
    assert found == [(1, length, length)] * 2 + [(2, 0, 0), (3, 0, 0)]
    assert extract_text(df.filter("false")).count() == 0
