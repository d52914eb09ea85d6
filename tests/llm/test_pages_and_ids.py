"""Pages that hide, wrap or never close things; special tokens; items with several texts; short lines; every threshold of a tree."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.llm import decontaminate, html_text, lines, packing, pii
from ionframe.llm.html_text import extract

TEXT = "word and more words here, " * 20
P, MAIN = f"<p>{TEXT}</p>", TEXT.strip()

# (page, its main text)
PAGES = {
    "a responsive class": (f'<body><div class="prose hidden md:block">{P}</div>', MAIN),
    "hidden in a title": (f'<body><article><p>a</p><section title="the hidden truth">{P}</section></article>', f"a\n\n{MAIN}"),
    "hidden in data": (f"<body><div data-x='a hidden b'>{P}</div>", MAIN),
    "hidden for real": (f"<body><article>{P}</article><div hidden>secret {P}</div><p hidden=until-found>x", MAIN),
    "a form round the page": (f"<body><form id=aspnetForm><nav><a href=x>menu</a></nav><div id=c>{P}{P}</div></form>", f"{MAIN}\n\n{MAIN}"),
    "a form round the article": (f"<body><form id=aspnetForm><div>{P[:60]}</div><article>{P}</article></form>", MAIN),
    "a form in the page": (f"<body><main>{P}<form><p>your address</p></form></main>", MAIN),
    "an open dialog": (f"<body><div id=root aria-hidden=true><header>h</header><main>{P}</main></div><div role=dialog>cookies {TEXT[:90]}</div>", MAIN),
    "a nav not closed before main": (f"<body><nav><ul><li><a href=x>one</a></ul><main>{P}</main>", MAIN),
    "a nav not closed": (f"<body><nav><ul><li><a href=x>one</a></ul>{P}{P}", f"{MAIN}\n\n{MAIN}"),
    "a nav that is closed": (f"<body><nav><p>one {TEXT[:30]}</p></nav><div>{P}</div>", MAIN),
    "a button not closed": (f"<body><button>Menu{P}", MAIN),
    "a select not closed": (f"<body><select><option>a<option>b{P}", MAIN),
    "posts as articles": (f"<body><article><h1>T</h1>{P}</article><div class=discussion>{f'<article>{P}{P}</article>' * 3}</div>", f"T\n\n{MAIN}"),
    "posts without a name": (f"<body><main><article><h1>T</h1>{P}</article><div>{f'<article class=post>{P}{P}</article>' * 3}</div></main>", f"T\n\n{MAIN}"),
    "an aside of teasers": (f"<body><div><p>{TEXT}</p></div><main>{P}</main><aside><article>{P[:200]}</article></aside>", MAIN),
    "nothing but a menu": ("<body><nav><p>one</p></nav><footer>two</footer>", ""),
    "hidden until a script runs": (f"<body style='display: none'><div>{P}</div><footer>end</footer>", MAIN),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert extract(page)[0] == want


@pytest.mark.parametrize("page", ["<div class=sidebar><article>" * 6000 + P, "<div>" * 6000 + P, "<nav>" * 6000 + P + "<p>x" * 6000, "<b>" * 6000 + P, "<form hidden>" * 6000 + P * 50])
def test_deep_pages_take_no_time(page):
    began = time.perf_counter()
    extract("<body>" + page)
    assert time.perf_counter() - began < 5


def slow_blocks(page: str) -> str:
    """Main text by definition for pages of p, div and nav alone, each closed: all p outside of nav."""
    import re

    page = re.sub(r"<nav>.*?</nav>", "", page)
    return "\n\n".join(" ".join(x.split()) for x in re.findall("<p>(.*?)</p>", page) if x.strip())


def test_simple_pages_by_brute_force():
    r = random.Random(4)
    for _ in range(300):
        inner = "".join(r.choice([f"<p>{' '.join(r.choices(['one', 'two  ', 'three.'], k=r.randint(3, 30)))}</p>", "<nav><p>menu here</p><div>x</div></nav>"]) for _ in range(r.randint(1, 9)))
        page = f"<body><nav><p>all</p></nav><main><div>{inner}</div></main></body>"
        assert extract(page)[0] == slow_blocks(page), page


def test_special_tokens_as_in_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b ", "<|endof", "plain  text\n\n1234 é"]
    for t in texts:
        assert packing.encoder()(t).tolist() == own.encode(t, add_special_tokens=False).ids, t
    own.encode_special_tokens = True
    for t in texts:
        assert packing.encoder(special=False)(t).tolist() == own.encode(t, add_special_tokens=False).ids, t
    rows = packing.pack(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).collect()
    assert sum(r.length for r in rows) == rows[0].doc_tokens == 5


@pytest.mark.parametrize("block_bytes", [1 << 22, 60, 10])
def test_an_item_with_several_texts_is_found_once(spark, block_bytes):
    items = spark.createDataFrame([(7, "what is the tallest mountain of this world? it is everest in nepal"), (7, "which peak is the highest on earth? that is mount everest of course"), (8, "how many moons has the planet mars? two small ones are known")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so what is the tallest mountain of this world? it is everest in nepal. and which peak is the highest on earth? that is mount everest of course"), (2, "how many moons has the planet mars? two small ones are known")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, block_bytes=block_bytes).collect()) == [(1, 7), (2, 8)]


def test_lines_of_five_to_nine_words_within_one(spark):
    r, rows = random.Random(6), []
    base = [[r.choice("abcdefgh") + str(r.randrange(4)) for _ in range(r.randint(4, 11))] for _ in range(40)]
    for i in range(120):
        out = []
        for _ in range(r.randint(1, 5)):
            w = list(r.choice(base))
            how = r.randrange(5)
            if how == 1:
                w[r.randrange(len(w))] = "new"
            elif how == 2:
                del w[r.randrange(len(w))]
            elif how == 3:
                w.insert(r.randrange(len(w) + 1), "more")
            out.append(" ".join(w))
        rows.append((i, "\n".join(out)))
    got = {(x.doc_id, x.line_no) for x in lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, want = [], set()
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            w = line.encode().split()
            if len(w) >= 5 and any(len(v) >= 5 and lines.one_edit(w, v) for v in seen):
                want.add((i, k))
            seen.append(w)
    assert got == want and any(5 <= len(rows[i][1].split("\n")[k].split()) <= 9 for i, k in want)


def test_a_tree_tries_every_threshold():
    x = [[float(i), 0.0] for i in range(400)]
    tree = pii.grow(x, [int(i >= 300) for i in range(400)], trees=1, depth=1)[0]
    assert tree[:2] == (0, 299.0) and tree[2] < 0 < tree[3]
    r = np.random.default_rng(1)
    x, y = r.integers(0, 90, (60, 3)).astype(float), r.integers(0, 2, 60)
    g, h = y - 0.5, np.full(60, 0.25)
    gain = {(f, t): g[x[:, f] <= t].sum() ** 2 / (h[x[:, f] <= t].sum() + 1) + g[x[:, f] > t].sum() ** 2 / (h[x[:, f] > t].sum() + 1) for f in range(3) for t in np.unique(x[:, f])[:-1]}
    tree = pii.grow(x.tolist(), y.tolist(), trees=1, depth=1)[0]
    assert gain[tree[:2]] == pytest.approx(max(gain.values()))


def test_stored_tables_can_be_cleared(spark):
    from ionframe import shared

    df = shared.stored(spark.range(3).withColumn("x", F.col("id")), "cleared")
    path = df.inputFiles()[0].rpartition("/")[0]
    from ionframe.sources.readers import exists

    assert exists(spark, path) and shared.clear(spark) >= 1 and not exists(spark, path)
