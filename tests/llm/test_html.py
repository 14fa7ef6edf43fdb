"""Site template removal against counts by hand over pages made of known blocks."""

from collections import defaultdict

import numpy as np

from tidemark.llm import html_text

PAGES = "page_id long, url string, html string"


def test_templates_against_brute_force(spark):
    """Blocks of several sorts on pages of three hosts; which of them go is counted here block by block."""
    rng = np.random.default_rng(11)
    boxes = {f"box{i}": f"<div class='c{i}'><b>read</b> more {i}</div>" for i in range(6)}
    prose = {f"prose{i}": f"<p>a quoted passage {i}</p>" for i in range(3)}
    rows, made, seen, count = [], [], defaultdict(set), defaultdict(int)
    n = 0
    for host, pages in (("a.example", 40), ("b.example", 12), ("c.example", 4)):
        for _ in range(pages):
            use = [k for i, k in enumerate([*boxes, *prose]) if rng.random() < (0.9, 0.5, 0.3, 0.12, 0.05, 0.25, 0.6, 0.3, 0.9)[i]]
            blocks = [(k, boxes.get(k) or prose[k]) for k in use] + [(None, f"<section id=related>own words {n}, and more of them than in any box</section>"), (None, f"<p class=notice>last {n}</p>")]
            order = rng.permutation(len(blocks))
            tag = "article" if n % 2 else "main"
            body = "".join(blocks[i][1] for i in order)
            rows.append((n, f"https://{host}/x?{n}", f"<title>t{n}</title><body><div class=wrap><nav>menu</nav><{tag}>{body}</{tag}></div></body>"))
            made.append((n, host, [blocks[i][0] or f"own{'' if 'section' in blocks[i][1] else 'last'}" for i in order]))
            count[host] += 1
            for k in use:
                if k in boxes:
                    seen[host, k].add(n)
            n += 1
    gone = {(h, k) for (h, k), s in seen.items() if len(s) >= html_text.MIN_PAGES and len(s) >= html_text.RECURS * count[h]}
    assert gone and len(gone) < len(seen)
    r = html_text.extract(spark.createDataFrame(rows, PAGES).repartition(5)).toPandas().set_index("page_id")
    removed = 0
    for i, host, names in made:
        say = {"own": f"own words {i}, and more of them than in any box", "ownlast": f"last {i}"}
        want = [say.get(k) or (f"read more {k[3:]}" if k in boxes else f"a quoted passage {k[5:]}") for k in names if (host, k) not in gone]
        assert r.text[i] == " ".join(want)
        assert r.n_chars[i] == len(r.text[i])
        assert r.n_removed[i] == sum((host, k) in gone for k in names)
        removed += r.n_removed[i]
    assert removed > 40


def test_copies_of_a_page_are_no_template(spark):
    """Thirty copies of one article, list and all, stay whole; a list that pages of different articles share goes."""
    same = "<title>One story</title><article><p>The long opening of the one story that all tell.</p><ul><li>x</li><li>y</li></ul></article>"
    rows = [(i, "http://h/", same) for i in range(30)]
    rows += [(100 + i, "http://g/", f"<title>Story {i}</title><article><p>Opening of the story {i}.</p><ul><li>x</li><li>y</li></ul></article>") for i in range(30)]
    r = html_text.extract(spark.createDataFrame(rows, PAGES)).toPandas()
    assert set(r[r.page_id < 100].text) == {"The long opening of the one story that all tell. x y"}
    assert set(r[r.page_id >= 100].text.str[-1]) == {"."} and r.n_removed.sum() == 30


def test_odd_pages(spark):
    """No rows; null, empty, repeated and very long pages; extra columns of clashing names; math, slugs and entities."""
    long = "<article>" + "<p>word &amp; " * 60_000 + "</article>"
    rows = [
        (1, None, None, "x", 1), (2, None, "", "x", 1), (3, "http://h/", "<article>a<br>b<math>c</math> <h2 id='related-work'>d</h2> &lt;e&gt;&nbsp;f</article>", "x", 1),
        (3, "http://h/", "<article>a<br>b<math>c</math> <h2 id='related-work'>d</h2> &lt;e&gt;&nbsp;f</article>", "x", 1), (4, "no host", long, "x", 1),
        (5, "http://h/", "<p>only a paragraph", "x", 1), (None, "http://h/", "<body><main>m<aside>no</aside><form>no</form><div class='x comments'>no</div></main></body>", "x", 1),
    ]
    pages = spark.createDataFrame(rows, PAGES + ", text string, host int")
    r = html_text.extract(pages).toPandas()
    by = r.groupby("page_id", dropna=False).text.apply(list)
    assert by[1] == [""] and by[2] == [""] and by[3] == ["a bc d <e> f"] * 2 and by[5] == ["only a paragraph"]
    assert r[r.page_id.isna()].text.tolist() == ["m"]
    assert by[4][0] == " ".join(["word &"] * 60_000) and (r.n_chars == r.text.str.len()).all()
    assert list(r.columns[:4]) == ["page_id", "url", "text", "n_chars"]
    assert html_text.extract(pages.limit(0)).count() == 0
