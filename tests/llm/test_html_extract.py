import random
from itertools import product

import numpy as np
import pytest

from lakemill.llm import html_extract as H


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<", "<"),  # a sign that begins no tag is text
        ("<html><body><article><h1>A &amp;amp; B</h1><p>one\n\t two<br>three</p><p></p><p>&eacute;&#x65E5;&nbsp;x</article>", "A &amp; B\none two three\né日 x"),
        ("<article><h1>T</h1><p><b>bold text here, and more.<br><p>Next one. &lt;p&gt;</article><footer>&copy; all of us</footer>", "T\nbold text here, and more.\nNext one. <p>"),
        ("<nav><a href=x>Home</a></nav><main><p>Some words, and <a href='y>z'>a link</a> in it.</p><script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --></main>", "Some words, and a link in it."),
        ("<article><p>Text that stays here.</p><form><input name=q><p>Search it</p></form></article><section id=comments><div class=comment><p>I say. So there!</p></div></section>", "Text that stays here."),
        ("<article><p>Unclosed <i>all<p>the way. <div>down here", "Unclosed all\nthe way.\ndown here"),
    ],
)
def test_pages(page, text):
    assert H.extract([page], H.model()) == [text]


def test_held_out_accuracy():
    made = [H.made_page(seed) for seed in range(20_000, 20_300)]
    got = H.extract([p for p, _ in made], H.model())
    assert sum(g == t for g, (_, t) in zip(got, made)) / len(made) > 0.95


def test_decoding_is_the_best_of_all_choices():
    rnd = random.Random(6)
    for _ in range(40):
        root = H.Block("", frozenset(), None)
        all_blocks = [root]
        for k in range(rnd.randint(1, 8)):
            p = rnd.choice(all_blocks)
            b = H.Block("div", frozenset(), p)
            p.parts.append(b)
            b.parts.append(f"t{k}")
            all_blocks.append(b)
        blocks = H.walk(root)
        z = np.array([rnd.gauss(0, 2) for _ in blocks[1:]])
        best, kept = None, None
        for s in product((0, 1), repeat=len(z)):
            on = dict(zip(map(id, blocks[1:]), s)) | {id(root): 1}
            if all(on[id(b.parent)] >= on[id(b)] for b in blocks[1:]):
                value = sum(x if o else -x for x, o in zip(z, s))
                if best is None or value > best:
                    best, kept = value, {b.parts[0] if isinstance(b.parts[0], str) else next(p for p in b.parts if isinstance(p, str)) for b in blocks[1:] if on[id(b)]}
        assert set(filter(None, H.decode(blocks, z).split("\n"))) == kept


def test_deep_and_long_pages():
    assert H.extract(["<div>" * 20_000 + "x" * 9], H.model())[0] in ("", "x" * 9)
    text = " ".join(f"word{k}," for k in range(60_000))
    assert H.extract([f"<article><p>{text}</p></article>"], H.model()) == [text]


def test_query(spark):
    from tests.conftest import SMALL

    from lakemill.llm.queries import op3_html_extract

    rows = op3_html_extract(spark, SMALL).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.n_chars == len(r.text)
        inside = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text == "\n".join(H._runs(H.parse(f"<article>{inside}</article>")))


def test_nulls_and_empty(spark):
    schema = "page_id long, url string, html string, text int"
    rows = H.main_text(spark.createDataFrame([(1, None, None, 5), (None, "u", "", 5)], schema)).collect()
    assert sorted(r.text for r in rows) == ["", ""]
    assert H.main_text(spark.createDataFrame([], schema)).collect() == []


def test_broken_tags_in_linear_time():
    import time

    for unit in ("<a '", "<!", "<a<a ", "</script ", "<a \"'"):
        took = []
        for n in (20_000, 40_000):
            began = time.perf_counter()
            H.parse(unit * n + "'")
            took.append(time.perf_counter() - began)
        assert took[1] < 4 * took[0] + 0.3, unit
