"""Operators on pages, conversations and vectors, and the queries against SQL."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, html_extract, queries, url_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = con.execute(queries.SQL[name])
    at = [[d[0] for d in found.description].index(n) for n in names]
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
    assert sorted(repr([plain(r[n]) for n in names]) for r in df.collect()) == sorted(repr([plain(r[k]) for k in at]) for r in found.fetchall())


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style><script>var x='</p>'</script></head><body><nav><a>Menu</a></nav><div class=\"cookie-notice\">We use</div><article><h1>Head &amp; line</h1><p>One <b>bo</b>ld\n\n two<br>three<p>four</article><aside>Side</aside><div id='comments'>Nice</div><form><p>Mail</p></form><footer>&copy; x</footer>"
    plain = "<body><p>Only</p><p>this</p><div class=ad>Buy</div></body>"
    rows = [(1, "http://a.com/1", page), (2, "http://a.com/2", page.replace("four", "five</p><p>six")), (3, None, plain), (4, "no url", None), (5, "http://a.com/3", ""), (1, "http://a.com/1", page), (6, "http://b.com", "<p>un<broken &lt; text"), (7, "http://b.com", "<article>" + "<p>w</p>" * 5000)]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], "page_id bigint, url string, html string, text string, host string")
    out = html_extract.extract(df)
    assert out.columns == [*df.columns, "text_"] and out.count() == 8
    got = {r.page_id: r.text_ for r in out.collect()}
    assert got[1] == "Head & line One bold two three four" and got[2] == "Head & line One bold two three five six"
    assert got[3] == "Only this" and got[4] == got[5] == "" and got[7] == " ".join(["w"] * 5000)
    assert html_extract.extract(df.limit(0)).count() == 0


def wrapper_of(*pages):
    wrapper = html_extract.Node("root")
    for page in pages:
        html_extract.add_page(wrapper, html_extract.read(page))
    return wrapper


def main_text(text, wrapper):
    page = html_extract.read(text)
    return html_extract.assemble(page, html_extract.decide(wrapper and html_extract.choose(wrapper), page))


def test_wrapper_alignment():
    a, b = "<ul><li>a</li><li>b</li></ul><i>x</i>", "<ul><li>c</li></ul>"
    for both in (wrapper_of(a, b), wrapper_of(b, a), html_extract.merge(wrapper_of(a), wrapper_of(b)), html_extract.merge(wrapper_of(b), wrapper_of(a))):
        assert both.pattern() == "<root><ul+>(<li#>#</li>)+</ul>(<i>#</i>)?</root>"
    # other orders make a repeated group of optional members, up to the last place
    both = wrapper_of("<h2>a</h2><p>b</p><hr><p>c</p><pre>d</pre><i>e</i>", "<p>a</p><h2>b</h2>")
    assert both.pattern() == "<root>((<h2#>#</h2>)?(<p>#</p>)?)+(<pre#>#</pre>)?(<i>#</i>)?</root>"


def test_wrappers_are_bounded():
    rng = random.Random(5)
    tags = ["p", "h2", "ul", "pre", "blockquote", "table", "section"]
    pages = []
    for i in range(400):
        body = "".join(f"<{t} class='c{rng.randrange(9)}x{i}'><b>word{rng.random()}</b></{t}>" for t in rng.choices(tags, k=30))
        pages.append(f"<body>{body}</body>")
    size = lambda w: 1 + sum(size(k) for k in w.kids.values())
    sizes = [size(wrapper_of(*pages[:n])) for n in (50, 400)]
    assert sizes[1] <= sizes[0] + 10 and sizes[1] < 300
    odd = [f"<x{i}><y{i}>a{i}</y{i}></x{i}>" for i in range(400)]
    assert size(wrapper_of(*odd)) < 400
    assert main_text(odd[390], wrapper_of(*odd)) == "a390"
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert main_text(deep, wrapper_of(deep)) == "text"


def test_pages_without_names_are_read_by_the_wrapper(spark):
    """The pages of the tables, and the same with neither article elements nor classes."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    bare = F.regexp_replace(F.regexp_replace("html", "</?article[^>]*>", ""), r'\sclass="[^"]*"', "")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {r.page_id: r.text for r in html_extract.extract(pages.withColumn("html", bare)).collect()}
    # brute force for pages of this form
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:h1|p|br)>", re.sub(r"</?b>", "", inner))
        import html

        assert got[r.page_id] == " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_without_the_wrapper_more_is_kept():
    body = "<body><div><span>Offer {0}</span></div><ul><li><a>One {0}</a></li><li><a>Two</a></li></ul><h1>Head {0}</h1><p>Text {0}</p><p>Last words {0}</p><div><p>All rights</p></div></body>"
    pages = [body.format(i) for i in range(6)]
    learned = wrapper_of(*pages)
    for i, text in enumerate(pages):
        assert main_text(text, learned) == f"Head {i} Text {i} Last words {i}"
        assert main_text(text, None) == f"Offer {i} One {i} Two Head {i} Text {i} Last words {i} All rights"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="page has-sidebar"><article><p>Main text</p></article><div class="sidebar">Side</div></div>', "Main text"),
        ('<div class="post search-result"><article><p>Main text</p></article></div>', "Main text"),
        ('<div class="layout-side"><main><p>Main <i>te</i>xt</p></main></div><div class="ad">Buy</div>', "Main text"),
        ("<form id=all><header>Top</header><h1>Head</h1><p>a</p><p>b <i>c</i> <b>d</b></p></form>", "Head a b c d"),
        ("<form>Name <input></form><p>Text", "Text"),
        ("<div><div class=menu>Menu</div><div><h1>H</h1><p>one<p>two</div></div><div id=comments><p>Nice</div>", "H one two"),
        ("<article><header><h1>H</h1></header><p>one</p><aside>no</aside></article><p>after</p>", "H one"),
    ],
)
def test_one_page(page, text):
    assert main_text(page, wrapper_of(page)) == text


def test_constant_slots_fall_out(spark):
    df = spark.createDataFrame([(i, "http://a.com", f"<body><div>Welcome to us</div><p>text {i}</p></body>") for i in range(8)], "page_id bigint, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {f"text {i}" for i in range(8)}


def test_copies_are_no_template(spark):
    same = "<body><p>First words</p><p>Second words</p></body>"
    moving = "<body><nav>session {}</nav><p>Only body</p></body>"
    rows = [(i, f"http://a.com/?s={i}", same) for i in range(8)] + [(20 + i, "http://b.com/", moving.format(i)) for i in range(8)]
    rows += [(40 + i, "http://c.com/", f"<body><div>Hello all</div>{f'<p>text {i}</p>' if i else ''}</body>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {got[i] for i in range(8)} == {"First words Second words"} and {got[20 + i] for i in range(8)} == {"Only body"}
    assert got[40] == "Hello all" and {got[40 + i] for i in range(1, 8)} == {f"text {i}" for i in range(1, 8)}


def test_url_rules(spark):
    rules = url_rules.rules_frame(spark, queries.RULES)
    urls = [
        "http://example.com/en/1", "https://WWW.Example.com/en/x?y", "http://a.b.example.com/en/", "http://example.com/EN/", "http://example.com", "http://xcom/", "http://b.net/es/1", "http://net/fr/", "ftp://x.net/de", None, "no", "://", "http://com:80/", "http://com/#/",
    ]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)] + [(0, urls[0], "own")], "page_id bigint, url string, host string")
    for r in url_rules.judge(df, rules).collect():
        rest = (r.url or "").partition("://")[2].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host, path = host.lower(), slash + path
        fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert tuple(r.judged) == (host, path, best[1], best[2])
    assert url_rules.judge(df, rules).count() == len(urls) + 1 and url_rules.judge(df, rules).columns == [*df.columns, "judged"]
    again = url_rules.judge(url_rules.judge(df, rules), rules)
    assert again.columns == [*df.columns, "judged", "judged_"] and again.where("judged_.rule is distinct from judged.rule").count() == 0
    assert url_rules.judge(df.limit(0), rules).count() == 0
    assert {r.judged.rule for r in url_rules.judge(df, rules.limit(0)).collect()} == {None}


def test_url_rules_random(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "MOST_RULES", 20)  # several blocks
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in [(host(), path()) for _ in range(60)]}.values())
    urls = [(i, f"http://{host()}{path()}{path()}") for i in range(200)]
    got = url_rules.judge(spark.createDataFrame(urls, "id int, url string"), url_rules.rules_frame(spark, rules)).collect()
    for r in got:
        h, _, p = r.url[7:].partition("/")
        fits = [(-len(a + b), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and ("/" + p).startswith(b)]
        best = min(fits, default=(0, None, "allow"))
        assert (r.judged.rule, r.judged.verdict) == best[1:]


def test_chat(spark):
    hard = "<|end|><|turn|>user<|says|>x <|!|> <|!<| |>"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", "ok <|end|>"), (1, 1, "assistant", "ok <|end|>"), (1, None, None, None), (None, 0, "assistant", "é𝄞"), (2, 0, "<|says|>", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_messages(df).withColumns({"turns": chat.read_back(F.col("formatted")), "spans": chat.loss_spans(chat.loss_mask(F.col("formatted")))})
    got = {r.conv: r for r in out.collect()}
    assert [tuple(t) for t in got[1].turns] == [("", ""), ("user", hard), ("assistant", "ok <|end|>"), ("assistant", "ok <|end|>")]
    assert [tuple(t) for t in got[2].turns] == [("<|says|>", "")]
    assert [got[None].formatted[s.start : s.stop] for s in got[None].spans] == ["é𝄞"]
    assert [got[1].formatted[s.start : s.stop] for s in got[1].spans] == ["ok <|!|>end|>"] * 2
    assert chat.format_messages(df.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [[("text", "see ", None, None), ("image", None, "i.png", None), ("audio", None, "a.wav", 2.5)], [("document", None, "d.pdf", 3.0), ("text", "<|image:0|>", None, None)]]
    df = spark.createDataFrame([(1, i, "user", p) for i, p in enumerate(parts)], f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    r = chat.format_messages(df).first()
    assert r.formatted == "<|turn|>user<|says|>see <|image:0|><|audio:1|><|end|><|turn|>user<|says|><|document:2|><|!|>image:0|><|end|>"
    assert [(a.number, a.message, a.place, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 0, 1, "image", "i.png", 576), (1, 0, 2, "audio", "a.wav", 63), (2, 1, 0, "document", "d.pdf", 1200)]
    assert r.expanded_tokens == 576 + 63 + 1200


CONTROL = ["a <", "|end|>", "|turn|>user", "<", "|", "", None, "<|!|", ">", "<|image:0|>", "<|!|>", "é𝄞", "<|says|>", "!|>"]


def test_chat_control_strings_split_over_parts(spark):
    rng = random.Random(2)
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 4)):
            kinds = [rng.choice(["text", "text", "text", "image", "audio", "odd", None]) for _ in range(rng.randrange(6))]
            rows.append((c, t, rng.choice(["user", "assistant", "<|end|>", None]), [(k, rng.choice(CONTROL), "ref", rng.choice([None, 2.0])) for k in kinds]))
    rows += [(200, 0, "user", None), (200, 1, "assistant", [None]), (201, None, None, [("text", "a <", None, None), ("text", "|end|><|turn|>x<|says|>y", None, None)])]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"conv_id int, turn int, role string, parts array<{chat.PART}>, m string")
    out = chat.format_messages(df)
    mask = chat.loss_mask(F.col("formatted"))
    out = out.withColumns({"parts": chat.read_parts(F.col("formatted")), "mask": mask, "spans": chat.loss_spans(mask), "loss": chat.loss_text(mask)})
    got = {r.conv: r for r in out.collect()}
    assert len(got) == 152
    for c, r in got.items():
        expected, n, loss = [], 0, ""
        for _, _, role, parts in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0)):
            own = []
            for p in parts or []:
                if p is None:
                    continue
                if p[0] in ("image", "audio", "document"):
                    own.append((p[0], None, n))
                    n += 1
                elif p[1] and own and own[-1][0] == "text":
                    own[-1] = ("text", own[-1][1] + p[1], None)
                elif p[1]:
                    own.append(("text", p[1], None))
            expected.append((role or "", own))
            if role == "assistant":
                loss += "".join(f"<|{k}:{m}|>" if t is None else t for k, t, m in own)
        assert [(t.role, [tuple(p) for p in t.parts]) for t in r.parts] == expected
        assert [a.number for a in r.attachments] == list(range(n))
        assert "".join(p.piece for p in r["mask"]) == r.formatted and r.loss == loss
        assert "".join(r.formatted[s.start : s.stop] for s in r.spans).replace("<|!|>", "<|") == loss
    assert spark.range(1).select(chat.read_back(F.lit("odd <|turn|>no end")).alias("t")).first().t[0].text == ""


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).round(3)
    x[100:160] = x[100]  # copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, []), (1004, [1.0]), (1005, [None] + [1.0] * 7), (None, [1.0] * 8), (5, [float(v) for v in x[5]])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by) == list(range(0, 400, 20))
    found = 0
    for q, answers in by.items():
        s = x @ x[q]
        order = [i for i in sorted(range(400), key=lambda i: (-round(s[i], 9), i)) if i != q][:20]
        assert len(answers) == 20 and q not in [a for a, _ in answers]
        assert all(abs(b - s[a]) < 1e-9 for a, b in answers)
        found += len({a for a, _ in answers} & set(order))
    assert found / 400 >= 0.9
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


@pytest.mark.parametrize("clusters", [60, 300])
def test_nearest_in_clusters_and_outliers(spark, clusters):
    import numpy as np

    rng = np.random.default_rng(7)
    n, centres = 12 * clusters, rng.normal(size=(clusters, 16))
    x = np.concatenate([np.repeat(centres, 12, axis=0) + rng.normal(size=(n, 16)) * 1e-4, 30 * rng.normal(size=(10, 16))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    asked = [*range(0, n, 12), *range(n, n + 10)]
    by = {}
    for r in ann.nearest(df, F.col("vec_id").isin(asked)).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert sorted(by) == asked and {len(v) for v in by.values()} == {20}
    found = sum(len(by[q] & set([int(i) for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20])) for q in asked)
    assert found / (20 * len(asked)) >= 0.9


@pytest.mark.parametrize(("n", "factor"), [(16, 1.0), (40, 1.0), (120, 1.0), (40, 1e200), (40, 1e-200)])
def test_nearest_gives_all_that_there_are(spark, n, factor):
    import numpy as np

    rng = np.random.default_rng(n)
    x = (np.where(np.arange(n)[:, None] < n // 2, 5.0, -5.0) + rng.normal(size=(n, 6))) * factor  # two groups far apart
    df = spark.createDataFrame([(f"v{i}", [float(v) for v in r]) for i, r in enumerate(x)], "name string, embedding array<double>")
    got = ann.nearest(df, F.lit(True), id_col="name").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.name)
    assert sorted(by) == sorted(f"v{i}" for i in range(n))
    assert {(len(v), len(set(v))) for v in by.values()} == {(min(20, n - 1), min(20, n - 1))}
    assert all(q not in v for q, v in by.items())
    if factor == 1.0:
        near = {f"v{i}": {f"v{j}" for j in sorted((j for j in range(n) if j != i), key=lambda j: -(x[i] @ x[j]))[:20]} for i in range(n)}
        assert sum(len(near[q] & set(v)) for q, v in by.items()) / sum(map(len, near.values())) >= 0.9


def test_nearest_with_ties_and_repeated_ids(spark):
    # vectors of few values: scores tie everywhere, and the smaller id comes first
    rows = [(i, [float(i % 2), float(i % 3), 1.0]) for i in range(90)] + [(3, [9.0, 9.0, 9.0]), (3, [9.0, 9.0, 9.0]), (4, [0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 5 == 0, k=30).orderBy("query_id", "rank").collect()
    assert got == ann.nearest(df.repartition(7, F.rand(3)), F.col("vec_id") % 5 == 0, k=30).orderBy("query_id", "rank").collect()
    three = {r.score for r in got if r.vec_id == 3 and r.query_id == 0}  # one of its two vectors, always the same
    assert len(three) == 1
    x = {i: v for i, v in rows[:90]} | ({3: [9.0, 9.0, 9.0]} if three == {9.0} else {})
    for q in range(0, 90, 5):
        order = sorted((j for j in range(90) if j != q), key=lambda j: (-sum(a * b for a, b in zip(x[q], x[j], strict=True)), j))[:30]
        assert [r.vec_id for r in got if r.query_id == q] == order
