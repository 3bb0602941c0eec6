import time

import pytest

from tideline.llm.spam import Line, Usual, could_be_marked, figures, judged_parts, learn, marked_lines, part_figures, parts, promotional_documents, read_line, undisguise

D = "doc_id bigint, text string, lang string"


def doc(message="Fix typo", added=(), removed=(), head="commit " + "a" * 40 + "\nAuthor: X <x@y.example>\nDate:   now\n\n"):
    body = "".join(f"\n-{x}" for x in removed) + "".join(f"\n+{x}" for x in added)
    return f"{head}    {message}\n\ndiff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1 +1 @@{body}\n"


CITIES = "Aville Bton Cburg Dford Efield Fham Gmouth Hport".split()
SPAM = {
    "prose": ["Why slim tea? Because cheap slim tea beats any other slim tea, and best slim tea is slim tea you trust."] * 3,
    "keywords": ["buy garden hose cheap garden hose garden hose online garden hose sale"] * 3,
    "cities": [f"used tyres {c} | cheap used tyres {c}" for c in CITIES],
    "html": [f'<a href="http://{c}.example/1">discount phone case</a> |' for c in CITIES],
    "markdown": [f"- [coupon yoga mat](https://{c}.example/x)" for c in CITIES],
    "bbcode": [f"[url=http://{c}.example]buy slim tea[/url] [b]slim tea[/b]" for c in CITIES],
    "bare links": [f"{c.lower()}.example/go/{i}" for i, c in enumerate(CITIES)],
    "hashtags": ["#cheapyogamat #buyslimtea #bestkneebrace #salevapekit #onlinephonecase"] * 2,
    "tags": ["tags: retro velvet curtain; heavy duty kitchen cart; matte linen bowl; led cat fan; vintage oak tray; soft wool rug; xl dog bed"],
    "catalogue": [f"#{10000 + i} | {c} photo editor | summer | soft | only 3 left" for i, c in enumerate(CITIES)],
    "german": ["billig Matratze kaufen Matratze günstig Matratze Rabatt Matratze online"] * 3,
    "french": ["acheter coque de téléphone pas cher coque de téléphone promo coque de téléphone"] * 3,
    "disguised": ["b.u.y c0up0n ch​eap s.l.i.m. .t.e.a D15C0UN+ f.r.e.e..s.h.i.p.p.i.n.g 0nl1n3 hxxp://a[.]example/x"] * 3,
    "in comments": ["/* serial disk repair keygen disk repair crack disk repair torrent disk repair */"] * 3,
}
WORK = {
    "code": ["def coupon(sale_total, limit=16):", "    voucher_code.append((discount, price_list))", "    return review + sale"] * 4,
    "fixtures": ["ROWS = [", '    ("garden hose", "vintage", 38),', '    ("yoga mat", "slim fit", 11),', '    ("phone case", "retro", 42),', "]"],
    "csv": ["id,item,colour,site,qty", "0,crate,blue,freight,67", "1,spool,red,meter,21", "2,rivet,grey,tram,50"],
    "changelog": [f"* Reuse cache in reader ([#{i}](https://git.example/p/issues/{i}))" for i in range(8)],
    "lock file": ['"a-io": {', '  "version": "6.3.0",', '  "resolved": "https://pkg.example/a-io/-/a-io-4.tgz",', "},"] * 4,
    "project list": [f"- [{c.lower()}kit](https://{c}.example/core) - Reads a tenant without loading the tenant." for c in CITIES],
    "logs": [f"ssl_error retry_after={i} host=n{i}.internal.example url=https://n{i}.internal.example/timer status=503" for i in range(8)],
    "prose with links": [f"The cache is explained at https://{c}.example/a/b together with the reader." for c in CITIES],
    "translation": ['msgid "add shard"', 'msgstr "Fehler im coupon behoben"'] * 5,
}


#: Stuffed pages in languages no list knows, and in English with words of its own: subject, words put around it.
STUFFED = {
    "nl": ("goedkope matras", "kopen aanbieding korting bestellen voordelig uitverkoop"),
    "pl": ("opony zimowe", "tanio kup promocja sklep okazja rabat"),
    "ru": ("зимние шины", "купить дешево скидка заказать недорого распродажа"),
    "tr": ("kış lastiği", "ucuz satın indirim kampanya sipariş fırsat"),
    "sv": ("billiga däck", "köp rabatt erbjudande beställ rea fynda"),
    "en": ("mattress bargains", "affordable inexpensive deals markdowns savings lowcost"),
}


@pytest.fixture(scope="module")
def commits(spark):
    """Ordinary commits (and a few pages) to learn from; their ids are above a million here."""
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang")


def found(spark, commits, rows):
    """Which of the rows are found among the commits."""
    return {r.doc_id for r in promotional_documents(commits.unionByName(spark.createDataFrame(rows, D))).where("doc_id < 1000000").collect()}


def test_spam_is_found(spark, commits):
    rows, want = [], set()
    for k, lines in enumerate(SPAM.values()):
        i = 10 * k
        rows += [(i + 1, doc(added=lines), "en"), (i + 2, doc(added=[*lines, "x = 1"]), None), (i + 3, "\n".join(lines), "en"), (i + 4, doc(added=["ok = 1"], removed=lines), "en"), (i + 5, doc(added=[x + " " for x in lines], removed=lines), "en")]
        want |= {i + 1, i + 2, i + 3}
    assert found(spark, commits, rows) == want


def test_stuffed_pages_in_any_language(spark, commits):
    rows = []
    for k, (subject, around) in enumerate(STUFFED.values()):
        words = around.split()
        several = [f"{a} {subject} {b} {subject}" for a, b in zip(words, words[1:], strict=False)]
        # several lines; the same line six times; one long line; with a little work; as a page of its own
        for j, text in enumerate([doc(added=several), doc(added=[f"{subject} {around}"] * 6), doc(" ".join(several * 2)), doc(added=[*several, "x = 1"]), "\n".join(several)]):
            rows.append((10 * k + j, text, "en"))
    got = found(spark, commits, rows)
    assert len(got) >= 0.9 * len(rows), sorted({r[0] for r in rows} - got)


def test_very_short_pages(spark, commits):
    pages = ["buy cheap mattress sale now", "cheap replica watches best deals online", "goedkope matras kopen korting", "best essay help 24h cheap order", "ucuz lastik indirim kampanya", "tanie opony zimowe sklep okazja", "free casino bonus spins today", "order pills without prescription overnight", "hot singles meet tonight", "lose weight fast miracle tea"]
    got = found(spark, commits, [(i, p, "en") for i, p in enumerate(pages)])
    assert len(got) >= 9
    # a subject line of a commit isn't such a page, nor is a short text in a language nothing is known of
    assert not found(spark, commits, [(1, doc("Expose coupon price under load"), "en"), (2, "popraw licznik ramek dziennika", "pl"), (3, "Merge pull request #7341 from rasyev/feature/encoder-segment\n\nFlush shared shipping", "en")])


def test_work_is_not(spark, commits):
    rows = [(i, doc(added=lines), "en") for i, lines in enumerate(WORK.values())]
    rows += [(100, doc("review sale coupon in voucher"), "en"), (101, "Nightly snapshot 2024-05-01", "de"), (102, None, "en"), (103, "", None), (104, " \n\t", "en"), (None, doc(added=SPAM["keywords"]), "en")]
    rows += [(105, doc("Fix\n\n    [1] https://shop1.example/a\n    [2] https://shop2.example/b\n    [3] https://deal3.example/c"), "en")]
    prose = ["Zmieniono kolejność odczytu dziennika przed zapisem", "Poprawiono błąd licznika ramek po ponownym uruchomieniu węzła", "Usunięto zbędne kopiowanie bufora oraz dodano testy granic segmentu", "Nowy indeks skraca wyszukiwanie przesunięć"]
    rows += [(106, doc(added=prose), "pl"), (107, doc(added=[f"    opony_zimowe(opony_zimowe[{i}], opony_zimowe)" for i in range(12)]), "pl")]
    licence = ["// Licensed under the project licence, see LICENCE in the root directory.", "// Do not remove this notice."]
    rows += [(108, doc(added=licence * 15), "en"), (109, doc(added=[f"word{i % 40}" for i in range(90)]), "en")]
    assert found(spark, commits, rows) == set()


def test_empty_repeated_and_clashing(spark):
    assert promotional_documents(spark.createDataFrame([], D)).count() == 0
    df = spark.createDataFrame([(1, doc(added=SPAM["keywords"]), "en")] * 3, D).selectExpr("*", "1 AS part", "2 AS words", "3 AS kind", "4 AS promotional")
    assert [r.doc_id for r in promotional_documents(df).collect()] == [1]


def test_words_are_learned_from_the_messages(spark, commits):
    usual = learn(part_figures(commits))
    assert {"the", "in", "for"} <= usual.function and {"merge", "reader"} <= usual.common and not {"buy", "cheap", "mattress", "boho"} & usual.common
    assert 0.4 < usual.of["en"]["function"] < 0.8 and usual.terse("en") > usual.terse("und") * 0.9 and set(usual.of["en"]) == {"function", "top_word", "top_gram", "duplicates", "links", "separators"}
    judged = {r.part for r in judged_parts(commits).select("part").distinct().collect()}
    assert {"message", "added"} <= judged


def test_what_is_left_out_early_is_never_marked(spark, commits):
    usual = learn(part_figures(commits))
    for r in commits.where("doc_id < 1000400").collect():
        message, added, laid_out = parts(r.text or "")
        for name, raw in (("message" if laid_out else "page", message), ("added", added)):
            lines = [read_line(x) for x in raw]
            assert could_be_marked(lines) or not any(marked_lines(lines, r.lang or "und", name, usual))


def test_figures():
    f = figures([read_line(x) for x in ["Read the journal before the journal is cut"] * 2 + ["x_y = 1"]])
    assert f["duplicates"] == 0.5 and f["top_word"] == 0.25 and f["top_gram"] == 0.5 and f["links"] == 0
    line = read_line('<a href="http://a.example/' + "x" * 3000 + '">' + "cheap tea " * 300 + "</a>")
    assert line.links == 1 and line.anchored and line.host == "a.example" and len(line.words) == 600
    assert Line.unpacked(line.packed()) == line
    assert marked_lines([read_line("cheap garden hose garden hose garden hose")], "en", "message", Usual()) == ["stuffed"]


def test_undisguise():
    assert undisguise("f.r.e.e..s.h.i.p.p.i.n.g s.l.i.m. .t.e.a c0up0n wh3r3+0f1nd 24h 2024 hxxp://a[.]example") == "free shipping slim tea coupon wheretofind 24h 2024 http://a.example"


def test_parts():
    m, a, laid_out = parts(doc("One\n\n    Signed-off-by: A <a@b.example>", ["x", "++y", "kept"], ["kept "]).replace("\n", "\r\n"))
    assert (m, a, laid_out) == (["One"], ["x", "++y"], True) and parts("just a page") == (["just a page"], [], False)


@pytest.mark.parametrize("unit", ["a", " ", "a-", "a.b.", "<a ", "<a href=x ", "<a href=x>", "[url=x]", "1a", "\t", "#abcde ", "buy cheap ", "-", "x,", "http://", "(x+", "[x](y) ", "[x](y", "é.", '"content="', "labels = ", "2024-"])
def test_very_long_lines_take_linear_time(unit):
    text = unit * (100_000 // len(unit))
    began = time.time()
    for raw in parts(doc(text[:50_000], [text]))[:2]:
        lines = [read_line(x) for x in raw]
        marked_lines(lines, "en", "added", Usual())
    assert time.time() - began < 8
