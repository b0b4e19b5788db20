from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cellwright.llm")
from cellwright.llm import boosting, html_extract  # noqa: E402
from cellwright.llm.html_tree import N_FEATURES, features, parse  # noqa: E402


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.createDataFrame([(1, "<html><body><nav><a>x</a></nav><article><p>Text, here.</p></article></body></html>")], "page_id long, html string")
    return html_extract.train(pages, made_up=250)


def runs(page):
    return [t for _, t in parse(page)[1]]


def test_blocks():
    assert runs("<p>a  b\n c<p>d<br>e</p><ul><li>x<li>y</ul>tail") == ["a b c", "d e", "x", "y", "tail"]
    assert runs("&lt;b&gt; &amp;&nbsp;&eacute;&#233;") == ["<b> & éé"]
    assert runs('<script>var t="</p>";</script><style>p{}</style><title>T</title><!-- <p>no</p> --><p>yes</p>') == ["yes"]
    assert runs("<p><b>bold<br><p>next</p></body>") == ["bold", "next"]
    assert runs("<div>a</span></div></div>b") == ["a", "b"] and runs("") == [] and runs("<") == ["<"] and runs("a < b") == ["a < b"]
    assert runs("<div " + "x" * 50000) and parse("<div>" * 3000)[0]


def test_decoding_keeps_no_block_below_a_dropped_one():
    blocks, _ = parse("<div><nav><p>aaaa aaaa</p></nav><div><p>bbbb</p><div class=ad>cc</div></div></div>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        odds = rng.normal(size=len(blocks))
        keep = html_extract.decode(blocks, odds)
        assert keep[0] and all(keep[b.up] for i, b in enumerate(blocks) if i and keep[i])
        value = sum(o * (1 + b.own) for o, b, k in zip(odds[1:], blocks[1:], keep[1:]) if k)
        best = max(sum(odds[i] * (1 + blocks[i].own) for i in range(1, len(blocks)) if m >> i & 1) for m in range(1, 1 << len(blocks), 2) if all(m >> blocks[i].up & 1 for i in range(1, len(blocks)) if m >> i & 1))
        assert value == pytest.approx(best)


def test_held_out_layouts(model):
    rng = np.random.default_rng(77)
    right = wrong = lost = 0
    for _ in range(150):
        blocks, texts = parse(html_extract.made_up_page(rng))
        keep = html_extract.decode(blocks, model.log_odds(np.array(features(blocks))))
        for b, t in texts:
            right += len(t) * (keep[b] and blocks[b].main)
            wrong += len(t) * (keep[b] and not blocks[b].main)
            lost += len(t) * (not keep[b] and blocks[b].main)
    assert right / (right + wrong) > 0.97 and right / (right + lost) > 0.97


def test_pages(spark, model):
    body = "<h1>Head line</h1><p>First &amp; foremost, this is   the text.</p><p>Second one, with more of it.</p>"
    page = f'<html><head><title>t</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article>{body}</article><div class="comments"><p>Nice read!</p></div><footer>&copy; me</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page)], "page_id long, url string, html string")
    df = df.withColumns({"text": F.lit("mine"), "n_chars": F.lit("x")})
    got = html_extract.extract(df, model).collect()
    want = "Head line\n\nFirst & foremost, this is the text.\n\nSecond one, with more of it."
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0)]
    assert html_extract.extract(df.limit(0), model).count() == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = boosting.fit(x[:1500], y[:1500], np.ones(1500), trees=30)
    assert ((m.log_odds(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


def test_quotes_and_hidden_elements():
    assert runs("<p title=don't>First text it's here</p><p>b</p>") == ["First text it's here", "b"]
    assert runs("<p title='a>b' class=x/y>c</p>") == ["c"] and runs('<p data-x="<p>no">yes</p>') == ["yes"]
    assert runs("<svg><p>x</svg> after") == ["x after"] and runs("<svg><text>q</text></svg> after") == ["after"]
    assert runs("<p>sum <math><mi>x</mi><annotation>\\x</annotation></math> and <button>go</button> on") == ["sum x and go on"]
    assert runs("<object><p>x</object>seen") == ["seen"] and runs("<p>a<select><option>1<option>2</select>b") == ["ab"]
    assert runs("<!-->a<!-- - -- > --><p>b<!-- open") == ["a", "b"] and runs("<p>a</p x='>'>b</ >c<?x?>d") == ["a", "bcd"]
    assert runs('<p class="x>one</p><p>two</p>') == ["one", "two"]  # a quote that never ends
    assert runs("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"] and runs("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert runs("<script>x</SCRIPT ><p>y</p><textarea></p>z") == ["y"]


@pytest.mark.parametrize("page", ["<a x" * 250_000, "<a x='" * 170_000, '<a y="a>b"' * 100_000, "<script>" + "</script " * 110_000, "<b><i>" * 90_000 + "</div>" * 80_000, "<b><div>" + "<i>" * 150_000 + "</b>" * 130_000, "<div>" + "<i>" * 150_000 + "<hr>" * 130_000, "<table><tr><td>x" * 60_000, "<" * 1_000_000, "&" * 1_000_000, "<!--" * 250_000])
def test_a_megabyte_of_anything_takes_seconds(page):
    import time

    began = time.time()
    features(parse(page)[0])
    assert time.time() - began < 15


def test_random_trees_come_back():
    """Well-formed pages written from random trees, whose runs of text are known without parsing."""
    import html
    import random

    rng = random.Random(17)

    def write(depth, own):
        """Markup of some children; ``own`` gathers the inline text of the block at hand, ``want`` the ended runs."""
        out = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.45 or depth > 5:
                text = rng.choice(["some words", " & ", "a<b", "  two\n", "é", "it's", '"q"'])
                own.append(text)
                out.append(html.escape(text))
            elif kind < 0.65:
                tag = rng.choice(["b", "em", "span", "code"])
                out.append(f"<{tag} title=\"<p>\" class='a b'>{write(9, own)}</{tag}>")
            elif kind < 0.7:
                own.append(" ")
                out.append(rng.choice(["<br>", "<br/>"]))
            elif kind < 0.78:
                out.append(rng.choice(["<script>if (a < b) '</p>'</script>", "<!-- <p>no</p> -->", "<svg><text>no</text></svg>", "<select><option>no</select>"]))
            else:
                tag = rng.choice(["div", "section", "blockquote", "article"])
                flush(own)
                inner = []
                text = write(depth + 1, inner)
                flush(inner)
                out.append(f"<{tag} id=x{rng.randint(0, 9)}>{text}</{tag}>")
        return "".join(out)

    def flush(own):
        if text := " ".join("".join(own).split()):
            want.append(text)
        own.clear()

    for _ in range(400):
        want: list[str] = []
        own: list[str] = []
        page = write(0, own)
        flush(own)
        assert runs(page) == want, page


# Pages written by hand in other manners than the made-up ones; {{ }} stands around the main text.
HAND = [
    "<body bgcolor=white><table width=100%><tr><td colspan=2><img src=logo.gif alt=Logo> <font size=1><a href=a>Home</a> | <a href=b>Archive</a> | <a href=c>Contact</a></font></td></tr><tr><td width=150><font size=1><a href=1>Politics</a><br><a href=2>Sports</a><br><a href=3>Weather</a></font></td><td><h2>{{Council votes to keep the old bridge}}</h2><p>{{The town council decided on Monday evening, after four hours of debate, that the iron bridge over the mill stream will not be torn down.}}<p>{{Engineers had warned for years that the eastern pier was sinking. A new survey, however, found that the movement had stopped.}}<p>{{\"We are relieved,\" said the mayor. Repairs are to begin in spring, and cost about two million.}}</td></tr><tr><td colspan=2><font size=1>Copyright 1999 The Mill Stream Courier. All rights reserved.</font></td></tr></table>",
    "<div id=root><div class=css-1a2b3c><a href=/>Start</a><a href=/x>Explore</a><a href=/y>Sign in</a></div><div class=css-99ff><div class=css-77><h1>{{How we cut our build times in half}}</h1><div class=css-12>{{Last year our builds took forty minutes, and nobody was happy about it. This post tells what we changed, in the order in which we changed it.}}</div><div class=css-12>{{First, we measured. It turned out that half of the time went into tests that had not found a fault in years.}}</div><div class=css-12>{{Second, we cached what could be cached: compilers, dependencies, and generated code.}}</div></div></div><div class=css-00><a href=/t>Terms</a><a href=/p>Privacy</a><span>2024 Example Inc.</span></div></div>",
    "<div role=navigation><ul><li><a href=#>Docs</a><li><a href=#>API</a><li><a href=#>Blog</a></ul></div><main><div class=toc><ul><li><a href=#a>Install</a><li><a href=#b>Use</a></ul></div><h1>{{Getting started}}</h1><p>{{Install the package with your favourite tool, then open a shell and check that the command is there.}}</p><pre>{{pkg install thing && thing --version}}</pre><h2>{{Use}}</h2><p>{{Call the command with a file, and it prints a summary of the file's contents to the screen.}}</p><ul><li>{{Large files are read in parts, so memory is not a concern.}}</li><li>{{Files that cannot be read are skipped with a warning.}}</li></ul></main><footer><p>Built with care. <a href=#>Edit this page</a></p></footer>",
    "<header class=site><h1>Grandma's Kitchen</h1><nav><a href=1>Soups</a> <a href=2>Cakes</a></nav></header><div class=post><h2>{{Apple cake with cinnamon}}</h2><p>{{This is the cake that my aunt baked every Sunday when the first apples were ripe, and the smell of it went through the whole house.}}</p><div class=ad-box>Buy the best baking tins at our partner's shop! Only today.</div><h3>{{Ingredients}}</h3><ul><li>{{Four sour apples, peeled and sliced}}</li><li>{{Two cups of flour and one of sugar}}</li><li>{{Three eggs and a pinch of salt}}</li></ul><p>{{Mix all of it, pour it into a buttered tin, and bake it for fifty minutes at medium heat.}}</p></div><aside><h4>About me</h4><p>I bake, I write, and I take photos.</p></aside><section id=comments><h3>2 comments</h3><div class=comment><p>Lovely, I made this yesterday!</p></div><div class=comment><p>Can I use pears instead?</p></div></section><footer>All recipes are mine.</footer>",
    "<div id=cookie-banner>We use cookies to improve your visit. <button>Accept</button></div><div id=content><h1>{{Common kingfisher}}</h1><p>{{The common kingfisher is a small bird with seven subspecies, found across a wide range of Europe and Asia. It is resident except where rivers freeze in winter.}}</p><table class=infobox><tr><th>{{Length}}</th><td>{{16 to 17 centimetres}}</td></tr><tr><th>{{Weight}}</th><td>{{34 to 46 grams}}</td></tr></table><h2>{{Behaviour}}</h2><p>{{It dives from a perch above clear, slow water, and takes fish of up to eight centimetres, head first.}}</p><p>{{Pairs dig a tunnel in a steep bank, and raise two or three broods a year.}}</p></div><div id=footer>Text is available under a free licence. <a href=#>Privacy</a> <a href=#>About</a></div>",
    "<section class=topbar><a href=/>Forum</a><form><input name=s><button>Search</button></form></section><article class=entry><header><h1>{{Notes from the northern line}}</h1></header><p>{{We left at six, before the sun was over the hills, and had the carriage to ourselves until the third stop.}}</p><p>{{There an old man got on with a dog, two crates of tomatoes and a radio, and told us about the winter of the great snow.}}</p><blockquote>{{You could walk out of the window on the second floor, he said, and nobody thought it strange.}}</blockquote><p>{{At the border the train stood for an hour. Nobody knew why.}}</p></article><div class=related-posts><h3>You may also like</h3><ul><li><a href=1>A week on the coast</a><li><a href=2>Tea in the old town</a></ul></div><div class=newsletter><p>Get our letter once a week. No spam.</p><form><input name=mail><button>Subscribe</button></form></div>",
]


def test_hand_labelled_pages(model):
    import re

    scores = []
    for page in HAND:
        want = Counter(" ".join(re.findall(r"\{\{(.*?)\}\}", page, re.S)).split())
        (text,) = html_extract._texts([page.replace("{{", "").replace("}}", "")], model)
        got = Counter(text.split())
        both = sum((want & got).values())
        scores.append(2 * both / max(1, sum(want.values()) + sum(got.values())))
    assert min(scores) > 0.75 and sum(scores) / len(scores) > 0.9, scores


def test_train_takes_odd_tables(spark):
    df = spark.createDataFrame([("1", "<article><p>a, b.</p></article>" * 300, "x"), (None, "<main>t</main>", "y"), ("2", None, "z")], "page_id string, html string, x string").withColumns({"y": F.lit(1), "w": F.lit(2)})
    assert html_extract.train(df, made_up=5, nodes=16).log_odds(np.zeros((1, N_FEATURES))).shape == (1,)
    long = spark.createDataFrame([(1, "u", "<article>" + "<p>Word after word, and on.</p>" * 40_000 + "</article>")], "page_id long, url string, html string")
    text = html_extract.extract(long, html_extract.train(df, made_up=60)).first()["text"]
    assert text == "\n\n".join(["Word after word, and on."] * 40_000)
