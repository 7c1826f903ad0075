"""HTML extraction, chat formatting, secret scan, WARC."""

import gzip
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterlab.llm import secrets as SC, warc as W
from rasterlab.llm.chat import escape, format_chat, read_chat, turns_of, unescape
from rasterlab.llm import html_text as HT
from rasterlab.llm.html_text import extract_text, main_text

PROSE = "The cat is in the house and it was on the mat for all of the day, as it should be in a story of this kind, with more words that follow."


@pytest.mark.parametrize(("html", "text"), [
    ("", ""),
    ("plain &lt;b&gt; words", "plain <b> words"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p><b>{PROSE}<br><p>Of.</p><p>a &nbsp; b\n c</p></article><footer>&copy; x</footer>", f"T & U\n{PROSE}\nOf.\na b c"),
    (f"<body><header>Site</header><div class='sideBar'>x</div><h1>T</h1><p>{PROSE}</p><form>Find</form><div id=comments><p>{PROSE}</p></div><script>if (a < b) {{}}</script></body>", f"T\n{PROSE}"),
    (f"<article><header><h1>Head</h1></header><p>{PROSE}</p><ul><li>one<li>two</ul><table><tr><td>1<td>2</table><aside>x</aside><p hidden>y</p></article>", f"Head\n{PROSE}\none\ntwo\n1\n2"),
    ("<article><p>Les | mots | sans</p></article><p>Elsewhere</p>", "Les | mots | sans"),
    ("<!-- <p>no</p> --><p>yes<!--", "yes"),
    ("<p>a<script>never ends", "a"),
    ("<p title=\"a > b\">ok</p><p class=ad-slot>buy</p><p class=shadow>keep</p>", "ok\nkeep"),
    ("a<br>b<br><br>c", "a b\nc"),
    ("<style>p{}</style><title>t</title>&#x41;&#66;", "AB"),
    (f"<div><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div><article>Three words here</article>", f"T\n{PROSE}\n{PROSE}"),
    (f"<article><p>{PROSE}</p></article><p>{PROSE[:80]}</p>", PROSE),
    ("a < b <3 c > d <", "a < b <3 c > d <"),
    ("<p title='>'>x</p><p title='>y</p>", "x\ny"),
    ("<p>x <a href=u", "x <a href=u"),
    ("<SCRIPT>var x = '</scripty>'</SCRIPT >y</ScRiPt>z", "yz"),
])
def test_main_text(html, text):
    assert main_text(html) == text


JAPANESE = "この図書館は市の中心にあり、毎日多くの人が本を読みに来ます。古い新聞や地図も保存されています。"
RUSSIAN = "Библиотека стоит в центре города, и каждый день сюда приходят люди, чтобы читать старые газеты, карты и книги о прошлом."


@pytest.mark.parametrize("wrapper", [
    "<div class='has-sidebar'>", "<div class='content no-sidebar'>", "<div class=with-nav>", "<div class='layout-social'>", "<div class='modal-open'>", "<div class=entry-notice>",
    "<div class='comment-count-0 post'>", "<form id=aspnetForm action=x>", "<section id=widget-12>", "<div class=widget>", "<div role=dialog>", "<body class='login cookie-bar' style='visibility:hidden'>",
])
@pytest.mark.parametrize("article", ["article", "div"])
def test_wrappers_names_do_not_lose_the_article(wrapper, article):
    """The expected texts are written by hand: a wrapper with most of the prose is no sidebar, the marks in it are."""
    end = f"</{wrapper[1:].split()[0]}>"
    page = f"<header><h1>Site</h1></header>{wrapper}<div class=sidebar><p>{PROSE}</p></div><{article}><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></{article}><div class=comments><p>{PROSE}</p></div>{end}<footer>x</footer>"
    wanted = f"T\n{PROSE}\n{PROSE}"
    if article == "div":  # half of the prose is marked here
        page = page.replace(f"<div class=comments><p>{PROSE}</p></div>", "")
    assert main_text(page) == wanted
    assert main_text(f"<html>{wrapper}<h1>T</h1><p>{PROSE}</p>{end}") == f"T\n{PROSE}"


@pytest.mark.parametrize(("html", "text"), [
    (f"<nav>菜单</nav><div><h1>図書館</h1><p>{JAPANESE}</p><p>{JAPANESE}</p></div><footer>著作</footer>", f"図書館\n{JAPANESE}\n{JAPANESE}"),
    (f"<div class=has-sidebar><article><p>{JAPANESE}</p></article><div class=sidebar>{PROSE}</div></div>", JAPANESE),
    (f"<div><h1>Город</h1><p>{RUSSIAN}</p></div><div class=menu>{RUSSIAN}</div>", f"Город\n{RUSSIAN}"),
    (f"<article><svg viewBox=x><p>{PROSE}</p><video src=x><p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
    (f"<article><svg><title>no</title><path d=x></svg><p>{PROSE}</p><canvas><p>{PROSE}</p><object data=x>", f"{PROSE}\n{PROSE}"),
    (f"<div><p>{PROSE} {PROSE} The copyright sign is © in this text.</p><p>© 2020 The firm and all of the rights that it has are reserved for it by law.</p></div>", f"{PROSE} {PROSE} The copyright sign is © in this text."),
    # marks that take effect: comments longer than the article, a sidebar with more prose than an article without any
    (f"<article><p>{PROSE}</p></article><div class=comment-list><article class=comment><p>{PROSE[:90]}</p></article><article class=comment><p>{PROSE[:80]}</p></article></div>", PROSE),
    (f"<article><p>Short news.</p></article><div class=related-posts><p>{PROSE}</p></div>", "Short news."),
    (f"<h1>T</h1><p>{PROSE}</p><div class=comment-list><p>{PROSE}</p><p>{PROSE}</p></div>", f"T\n{PROSE}"),
    (f"<div class=notice hidden><p>{PROSE}</p></div><p>{PROSE}</p>", PROSE),
])
def test_pages_whose_text_was_written_by_hand(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html", [
    "<a ", "<a \"", "<svg>", "<svg><div class=ad>", "<div class=ad>", "<div class=ad><article>", "<object ", "<video></svg>", "<!x", "<div>", "<a '>\" ", '<x ">" ', "<script </script ", "<p a", "<p a=\"b' ", "<li>", "</b></i>", "<p><a>", "<!-- ", "<![CDATA[", "&", "&amp", "< ", "<<", "<ul><li>", "<p =",
])
def test_extraction_takes_linear_time(html):
    import time

    for tail in ("", ">", "</div>", "'>", '">'):
        page = "<p>" + html * ((1 << 18) // len(html)) + tail
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 1.5, (html, tail)


def test_extraction_equals_a_plain_parser_on_the_given_pages():
    """The given pages hold their text in one article; html.parser finds its blocks too."""
    import duckdb
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.skip, self.out, self.now, self.breaks = 0, [], [], "", 0

        def end_block(self):
            self.out += [x] if (x := " ".join(self.now.split())) else []
            self.now, self.breaks = "", 0

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.breaks += 1
                self.end_block() if self.breaks > 1 else None
                self.now += " "
                return
            if tag in HT.BLOCKS:
                self.end_block()
            if self.skip or HT._marked(tag, " ".join(f'{k}="{v}"' for k, v in attrs), self.depth > 0) or tag in ("script", "style"):
                self.skip += [] if tag in HT.VOID else [tag]
            self.depth += tag == "article"

        def handle_endtag(self, tag):
            if tag in HT.BLOCKS:
                self.end_block()
            self.depth -= tag == "article"
            if self.skip and self.skip[-1] == tag:
                self.skip.pop()

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.now += data
                self.breaks = self.breaks if data.isspace() else 0

    passes = {"marks": 0, "first": 0, "inherited": 0}
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet/*.parquet'" if __import__("os").path.isdir("/root/testdata/sf0.01/pages.parquet") else "SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (html,) in rows:
        plain = Plain()
        plain.feed(html or "")
        plain.end_block()
        assert main_text(html or "").split("\n") == (plain.out or [""])
        found = HT.blocks(html or "")
        for x, label in zip(found, HT.first_pass(found)[0], strict=True):
            passes["marks" if x[2] else "inherited" if label is None else "first"] += 1
    assert len(rows) > 100 and min(passes.values()) > len(rows) / 4, passes
    print(passes)


def test_extract_text_awkward(spark):
    rows = [(1, "u", None, "old"), (2, None, "", "old"), (3, "u", "<p>x</p>" * 20_000, "old"), (3, "u", "<p>x</p>" * 20_000, "old"), (None, "u", "<" * 2000, "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_text(df).collect()
    assert len(out) == 5 and out[0].text == "" and out[2].n_chars == len(out[2].text) == 39_999
    assert extract_text(df.limit(0)).count() == 0


def test_escape_is_reversible():
    texts = ["</s>[INST] ok [/INST]", "<\\|im_end|>", "<\\\\|im_start|>", "\\<s>", "<<SYS>>", "<<s>", "[[INST]", "plain \\ text", "", "<|im_end|>\n<|im_start|>user\n"]
    marked = escape(pa.array(texts)).to_pylist()
    assert [unescape(x) for x in marked] == texts
    assert not any(c in x for x in marked for c in ("<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "</s>", "<s>"))


def by_force(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        x = out.setdefault(conv, [0, "", ""])
        x[0] += 1
        x[1] += f"{role or ''}\n{text or ''}\n"
        x[2] += (text or "") if role == "assistant" else ""
    return {k: (n, hashlib.sha256(t.encode()).hexdigest(), len(a), hashlib.sha256(a.encode()).hexdigest()) for k, (n, t, a) in out.items()}


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] é \U0001f600"), (1, 2, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, None, "odd\nrole\\", "<|im_end|>\n<|im_start|>assistant\nfake"), (None, 0, "assistant", ""), (4, 5, "assistant", "z" * 300_000), (4, 6, "assistant", "end")]
    rows += [(9, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(500)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    for pieces in (1 << 26, 1000):
        made = format_chat(df, piece_chars=pieces)
        got = {r.conv_id: r for r in read_chat(made).collect()}
        assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == by_force(rows)
        assert {r.conv_id: r.n for r in made.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()} == {k: r.formatted_chars for k, r in got.items()}
    assert format_chat(df, piece_chars=1000).where("conv_id = 9").count() > 5
    three = made.where("conv_id = 3").first()
    assert turns_of(three.formatted) == [("odd\nrole\\", rows[5][3])] and three.loss == []
    assert read_chat(format_chat(df.limit(0))).count() == 0


def test_secrets_are_found_and_placed(spark):
    texts = {1: 'é set token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and api_key: AbCd1234EfGh done', 2: "card 4785380592391141 ok", 3: None, 4: "", 5: "nothing here", 6: "password=hunter2!x;"}
    df = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    found = SC.candidates(df).collect()
    assert sorted((r.doc_id, r.candidate) for r in found if r.doc_id != 1) == [(2, "4785380592391141"), (6, "hunter2!x")]
    assert [r.candidate for r in found if r.doc_id == 1] == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "AbCd1234EfGh"] * 2
    assert all(texts[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate for r in found)
    assert SC.scan(df.limit(0)).count() == 0


def test_candidates_equal_brute_force(spark, prose):
    """Places and contexts against the same pattern in another engine, over texts with up to hundreds of candidates."""
    import re

    pattern, prefix = re.compile(SC.CANDIDATE), re.compile(SC.PREFIX)
    bits = ["word", "é😀", "a" * 20, "b1" * 9, "token=abc12345", "Secret: 'x1y2z3w4'", "api_key==q-w-e-r-t", "\n", "4785380592391141,", "=", "password=\"short\"", "9" * 40 + "=="]
    texts = {i: " ".join(prose.random.choice(bits) for _ in range(n)) for i, n in enumerate((0, 1, 5, 40, 300, 1500))}
    wanted = []
    for i, t in texts.items():
        for m in pattern.finditer(t):
            lead = prefix.match(m[0])
            k = lead.end() if lead and re.fullmatch(r"[^\s\"',;<>]{6,}", m[0][lead.end() :]) else 0
            wanted.append((i, m.start() + k, m[0][k:], t[: m.start() + k], t[m.end() :]))
    got = SC.candidates(spark.createDataFrame([(*x, "clash", 1) for x in texts.items()], "doc_id long, text string, match string, start int")).collect()
    assert sorted((r.doc_id, r.start, r.candidate) for r in got) == sorted(x[:3] for x in wanted) and len(wanted) > 500
    by_place = {x[:2]: x for x in wanted}
    assert all(by_place[r.doc_id, r.start][3].endswith(r.before) and by_place[r.doc_id, r.start][4].startswith(r.after) for r in got)


def test_many_candidates_in_one_text(spark):
    import time

    text = " ".join(f"{i:016d}x{i % 7}" for i in range(50_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    row = SC.candidates(df).agg(F.count("*").alias("n"), F.max("start").alias("last"), F.sum(F.length("candidate")).alias("chars")).first()
    assert tuple(row) == (50_000, len(text) - 18, 50_000 * 18) and time.perf_counter() - began < 60


def test_forest_from_labelled_findings(spark):
    rows = []
    for i in range(300):
        key = hashlib.sha1(str(i).encode()).hexdigest()
        rows += [(key, 'api token = "', '"', "app.py", 1), (str(10**15 + i * 7919), "order no ", " shipped", "log", 0), (key[:32], "md5 checksum ", " of the file", "test/data", 0)]
    df = spark.createDataFrame([*rows, (None, "", "", "", 1), ("x", "", "", "", None)], "candidate string, before string, after string, path string, label int")
    words = ["the", "order", "file"]
    forest = SC.train(df.where("pmod(crc32(candidate), 3) <> 1 or candidate is null"), words)
    out = SC.score(df.where("pmod(crc32(candidate), 3) = 1"), forest, words).collect()
    assert len(out) > 100 and sum(r.is_secret == bool(r.label) for r in out) >= 0.98 * len(out)
    assert SC.train(df.where("label = 1"), words) is None
    assert SC.score(df, None, words).where("score = 0.5").count() == df.count()


def test_dictionary_holds_the_most_frequent_words(spark):
    texts = ["Common words here and there", "common WORDS and more", "common and rare", "and", None, "", "x" * 30 + " of"]
    df = spark.createDataFrame([(t, "clash") for t in texts], "text string, word string")
    assert SC.dictionary(df) == ["and", "common", "words"]
    assert SC.dictionary(df, words=2) == ["and", "common"] and SC.dictionary(df, words=0) == [] == SC.dictionary(df.limit(0))


def test_coverage_is_that_of_the_dictionary(spark):
    words = ["time", "order", "a", "zebra", "naïve"]
    df = spark.createDataFrame([("orderTime42",), ("ZEBRA-x",), ("qq",), ("",), ("time" * 3,)], "candidate string").selectExpr("candidate", "'' before", "'' after", "'' path")
    got = {r.candidate: r.f_words for r in SC.with_features(df, words).collect()}
    assert got == {"orderTime42": 9 / 11, "ZEBRA-x": 5 / 7, "qq": 0.0, "": 0.0, "timetimetime": 0.0}
    assert {r.f_words for r in SC.with_features(df, []).collect()} == {0.0}


def test_secrets_on_held_out_planted_findings(spark):
    """Learnt from two thirds of the findings planted into the given documents, judged on the rest and on others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = SC.dictionary(docs)
    planted = SC.planted_findings(docs, path_col="source").persist()
    held = F.pmod(F.crc32("candidate"), F.lit(3)) == 1
    forest = SC.train(planted.where(~held), words)
    out = SC.score(planted.where(held), forest, words).collect()
    hits = sum(r.is_secret and r.label for r in out)
    precision, recall = hits / max(1, sum(r.is_secret for r in out)), hits / max(1, sum(r.label for r in out))
    assert len(out) > 150 and precision >= 0.9 and recall >= 0.9, (len(out), precision, recall)
    others = [
        ("AKIA" + "Q3ZX7PLM2K9VB4TN", "aws_access_key = '", "'", "deploy/main.tf", 1), ("9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", 'token: "', '"', "app.yml", 1), ("hK39dkQ0zPq81LmN", "db_password=", "\n", ".env", 1),
        ("4929123456781234", "paid with ", " yesterday", "mail", 0), ("internationalization_of_2024", "the ", " of it", "notes", 0), ("e3b0c44298fc1c149afbf4c8996fb924", "md5 checksum: ", " file", "list", 0), ("your_password_here", "password = ", "", "readme", 0),
    ]
    df = spark.createDataFrame(others, "candidate string, before string, after string, path string, label int")
    judged = SC.score(df, forest, words).collect()
    assert sum(r.is_secret == bool(r.label) for r in judged) >= len(others) - 1, judged


def test_secrets_in_whole_texts_written_by_hand(spark):
    """Values after any sign of equality, schemes, dotted tokens and pass phrases: found in the texts, and judged."""
    jwt = "eyJ0eXAiOiJKV1QiLCJhbGci1.eyJzdWIiOiIxMjM0NTY3ODkwIn0x.dBjftJeZ4CVPmB92K27uhbUJU1p1r"
    cases = [
        ("export STRIPE_KEY=sk_live_51HxKqP2eZvKYlo2C9dQ", "sk_live_51HxKqP2eZvKYlo2C9dQ", 1), ("GITHUB=ghp_Zx81kQpL0vRt37NmYw52HsBc94Gd61Jf08Ae", "ghp_Zx81kQpL0vRt37NmYw52HsBc94Gd61Jf08Ae", 1),
        ("https://files.host/get?sig=b2XvQ9pL4mZk8RtY1wNc7HsD3fGj6aEe5uKo0iT", "b2XvQ9pL4mZk8RtY1wNc7HsD3fGj6aEe5uKo0iT", 1), (f"Authorization: Bearer {jwt} sent", jwt, 1), (f"curl -H Bearer {jwt} sent", jwt, 1),
        ("password: correcthorsebatterystaple", "correcthorsebatterystaple", 1), ("it has id=3f2a9c1e-7b64-4d1a-a8f0-5c2e9b7d1f34 in the log", "3f2a9c1e-7b64-4d1a-a8f0-5c2e9b7d1f34", 0),
        ("password: please ask the team for it", "please", 0), ("see /view?page=summer-holiday-offers-2023 for more", "/view?page=summer-holiday-offers-2023".split("=")[1], 0),
    ]
    texts = spark.createDataFrame([(i, f"We wrote this down in the notes of the day. {t}") for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    found = SC.candidates(texts).persist()
    got = {(r.doc_id, r.candidate): r.start for r in found.collect()}
    assert set(got) == {(i, value) for i, (_, value, _) in enumerate(cases)}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = SC.dictionary(docs)
    forest = SC.train(SC.planted_findings(docs, path_col="source"), words)
    judged = {r.doc_id: r for r in SC.score(found, forest, words).collect()}
    wrong = [(cases[i], r.score) for i, r in judged.items() if r.is_secret != bool(cases[i][2])]
    assert len(wrong) <= 1, wrong


def test_secret_scan_over_a_table(spark, tmp_path):
    from rasterlab.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 250")
    docs.selectExpr("*", "'x' AS candidate", "1 AS score").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_secret_scan(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        value = texts[r.doc_id][r.start : r.start + r.length]
        assert hashlib.sha256(value.encode()).hexdigest() == r.candidate_sha256
        assert r.is_secret == ('token = "' + value in texts[r.doc_id])
    assert sum(r.is_secret for r in got) >= 3 and sum(not r.is_secret for r in got) >= 5


def pages(spark):
    big = "<p>same payload</p>" * 30
    rows = [(5, "http://a", big), (3, "http://b\r\nX: y", big), (9, None, big), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "é" * 99 + "WARC/1.1\r\n"), (8, "u", "x" * 300_000), (3, "http://b", big), (None, "u", "only one of its kind " * 20)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, records int").repartition(3)


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    folder, names = W.archive_pages(df)
    got = W.read_archives(spark, folder, names).where("kind = 'record'").collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h for i, _, h in rows if i == r.page_id), None) or ""
        data = html.encode()
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
        revisit = r.page_id in (5, 9)
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert r.payload == (None if revisit else data)
    assert W.read_archives(spark, folder, names).where("kind = 'gap'").count() == 0
    folder, names = W.archive_pages(df.limit(0))
    assert W.read_archives(spark, folder, names).count() == 0


def records(n=6):
    return [W.record("response", f"http://x/{i}", i, f"payload {i} ".encode() * 30, hashlib.sha256(f"payload {i} ".encode() * 30).hexdigest(), None) for i in range(n)]


def ids(data):
    return [int(x[3]["x-page-id"]) for x in W.salvage(data) if x[0] == "record"], [x[1:] for x in W.salvage(data) if x[0] == "gap"]


def test_salvage_of_gzip_archives():
    members = [gzip.compress(r, mtime=0) for r in records()]
    assert ids(b"".join(members)) == ([0, 1, 2, 3, 4, 5], [])
    hurt = bytearray(members[2])
    hurt[len(hurt) // 2] ^= 0xFF
    data = b"".join([*members[:2], bytes(hurt), *members[3:]])
    found, gaps = ids(data)
    start = len(members[0]) + len(members[1])
    assert found == [0, 1, 3, 4, 5] and [(a, b) for a, b, _ in gaps] == [(start, start + len(hurt))]
    found, gaps = ids(b"junk" + data[: len(data) - 10])
    assert found == [0, 1, 3, 4] and gaps[0][:2] == (0, 4) and gaps[-1][1] == len(data) - 6
    assert ids(b"") == ([], []) and ids(b"nothing at all")[0] == []


def test_salvage_of_plain_archives():
    parts = records()
    data = bytearray(b"".join(parts))
    data[len(parts[0]) + len(parts[1]) - 60] ^= 1  # inside the payload of record 1
    found, gaps = ids(bytes(data))
    assert found == [0, 2, 3, 4, 5] and gaps[0][:2] == (len(parts[0]), len(parts[0]) + len(parts[1]))


def test_damaged_archives_in_spark(spark, tmp_path):
    members = [gzip.compress(r, mtime=0) for r in records()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members)[:-20])
    (tmp_path / "b.warc").write_bytes(b"".join(records(2)))
    out = W.read_archives(spark, f"file://{tmp_path}")
    assert out.where("kind = 'record'").count() == 7 and out.where("kind = 'gap'").first().reason


def test_warc_keeps_a_page_with_a_long_url(spark):
    url = "data:text/html," + "x" * 100_000
    df = spark.createDataFrame([(1, url, "<p>a</p>"), (2, "u", "<p>b</p>")], "page_id long, url string, html string")
    folder, names = W.archive_pages(df)
    got = {r.page_id: r for r in W.read_archives(spark, folder, names).collect()}
    assert got.keys() == {1, 2} and got[1].kind == "record" and got[1].url == url


def test_salvage_inside_gzip_members():
    parts = records(200)
    bad = bytearray(b"".join(parts[:6]))
    bad[len(parts[0]) + len(parts[1]) - 60] ^= 1  # a record inside a member that reads well
    found, gaps = ids(gzip.compress(bytes(bad), mtime=0) + gzip.compress(parts[7], mtime=0))
    assert found == [0, 2, 3, 4, 5, 7] and [g[2] for g in gaps] == ["wrong block digest"]
    one = gzip.compress(b"".join(parts), mtime=0)
    found, gaps = ids(one[: len(one) * 3 // 4])  # one stream, cut off
    assert found == list(range(len(found))) and 100 < len(found) < 200 and gaps[0][2] == "the member is cut off"
    found, gaps = ids(one[:-8] + bytes(4) + one[-4:])  # its checksum is wrong
    assert found == list(range(200)) and len(gaps) == 1
    hurt = bytearray(one)
    hurt[len(one) // 2] ^= 0xFF
    found, gaps = ids(bytes(hurt) + gzip.compress(parts[0], mtime=0))
    assert found[-1] == 0 and found[:50] == list(range(50)) and gaps


def intact(data, parts):
    """Which of the records stand unharmed in the bytes or in a member of their own."""
    return [i for i, r in enumerate(parts) if r in data or gzip.compress(r, mtime=0) in data]


def test_salvage_looks_for_both_marks():
    parts = records()
    zipped = [gzip.compress(r, mtime=0) for r in parts]
    inner = gzip.compress(b"no archive" * 50)
    with_gzip = W.record("response", "http://z", 9, inner, hashlib.sha256(inner).hexdigest(), None)
    hurt_first = bytearray(b"".join([with_gzip, *parts]))  # a plain archive, its first byte hurt, gzip bytes in a payload
    hurt_first[0] ^= 1
    mixed = b"".join([*zipped[:3], *parts[3:]])  # members, then plain records
    hurt = bytearray(zipped[1])
    hurt[len(hurt) // 2] ^= 0xFF
    hurt_mixed = b"".join([zipped[0], bytes(hurt), *parts[2:4], *zipped[4:]])
    plain_hurt = bytearray(b"".join([parts[0], parts[1]]))
    plain_hurt[len(parts[0]) + 3] ^= 1
    plain_hurt = bytes(plain_hurt) + b"".join(zipped[2:])
    for data in (bytes(hurt_first), mixed, hurt_mixed, plain_hurt, b"WARC/1." * 300 + mixed, b"\x1f\x8b\x08" * 300 + mixed):
        assert ids(data)[0] == intact(data, parts), data[:30]


def test_salvage_takes_linear_time():
    import time

    for junk in (b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03", b"WARC/1.1\r\nContent-Length: 5\r\n\r\n"):
        began = time.perf_counter()
        assert ids(junk * ((1 << 18) // len(junk)) + records()[0])[0] == [0]
        assert time.perf_counter() - began < 4


def test_warc_query_over_awkward_pages_and_its_archives_damaged(spark, tmp_path):
    from rasterlab.llm import queries

    rows, df = pages(spark)
    rows = [(*r, 1) for r in rows] + [(50, "data:," + "x" * 100_000, "<p>long url</p>" * 20, 1), (None, "u", "a twin without an id " * 20, 1), (None, "u", "a twin without an id " * 20, 1)]
    spark.createDataFrame(rows, df.schema).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in queries.op8_warc(spark, str(tmp_path)).collect()), key=str)
    wanted = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = min((j for j, _, h, _ in rows if (h or "").encode() == data and j is not None), default=None)
        revisit = len(data) >= 100 and first is not None and first != i
        wanted.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(wanted, key=str)
    folder, names = W.archive_pages(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    archive = f"{folder}/{names.first().name}".removeprefix("file://")
    whole = open(archive, "rb").read()
    hurt = bytearray(whole)
    hurt[len(hurt) // 3] ^= 0xFF
    open(archive, "wb").write(bytes(hurt))
    out = W.read_archives(spark, folder, names)
    assert out.where("kind = 'gap'").count() > 0 and len(rows) > out.where("kind = 'record'").count() >= len(rows) - 2
