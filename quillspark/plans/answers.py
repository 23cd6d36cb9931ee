"""Model answers, captions, splitters and evidence, over documents of several shapes and over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import captions as C
from ..functions import splitting as S
from ..operators import evidence as E
from .registry import inline, query, shaped, shaped_sql


def _tone(**changed) -> str:
    import json

    base = {"emocja": "radosny", "emocje_dodatkowe": [], "nacechowanie": "pozytywne", "intensywnosc": "niska", "rejestry": [], "uzasadnienie": "Bo {}."}
    return json.dumps(base | changed, ensure_ascii=False)


_TONES = [
    (_tone(), "radosny", None, "pozytywne", "niska", None, "Bo {}."),
    (_tone(emocja=" PODNIOSLY ", intensywnosc="srednia", rejestry=["obrazliwy"]), "podniosły", None, "pozytywne", "średnia", "obraźliwy", "Bo {}."),
    (_tone(emocja="entuzjastyczny"), None, None, None, None, None, None),
    (_tone(nacechowanie=None), None, None, None, None, None, None),
    (_tone(emocje_dodatkowe=["radosny", "smutny", "x", "smutny"], rejestry=["potoczny", "potoczny"]), "radosny", "smutny", "pozytywne", "niska", "potoczny", "Bo {}."),
    (_tone(emocje_dodatkowe=["gniewny", "smutny", "refleksyjny"], rejestry=["formalny", "wulgarny", "ironiczny"]), "radosny", "gniewny, smutny", "pozytywne", "niska", "formalny, wulgarny", "Bo {}."),
    ("```json\n" + _tone(uzasadnienie="  ") + "\n```", "radosny", None, "pozytywne", "niska", None, None),
    ("[1]", None, None, None, None, None, None),
    ("{broken", None, None, None, None, None, None),
    ("", None, None, None, None, None, None),
]


@query(shaped_sql(_TONES, "answer, emotion, secondary_emotions, sentiment, intensity, registers, evidence"))
def tones(t):
    return shaped(t, [r[:1] for r in _TONES], "answer string").withColumn("t", A.tone(F.col("answer"))).select("doc_id", "answer", "t.*")


_PERIODS = [
    (None, None, "after", "upadek muru berlińskiego", 1989, None, True), (None, None, "before", "Rozpad ZSRR", None, 1991, True), (None, None, "around", "wybuch I wojny światowej", 1909, 1919, True), (None, None, "exact", "wejście Polski do NATO", 1999, 1999, True),
    (1980, None, "after", "upadek muru berlińskiego", 1980, None, None), (None, 1985, "exact", "rozpad zsrr", None, 1985, None), (None, None, "between", "rozpad zsrr", None, None, None), (None, None, "after", "nieznane {}", None, None, False), (None, None, "after", None, None, None, None),
    (None, None, None, "rozpad zsrr", None, None, None), (None, None, "kiedyś", "rozpad zsrr", None, None, None), (None, None, "after", "", None, None, None),
]


@query(shaped_sql(_PERIODS, "first, last, relation, anchor, start, \"end\", known"))
def subject_periods(t):
    rows = shaped(t, [r[:4] for r in _PERIODS], "first int, last int, relation string, anchor string")
    return rows.withColumn("p", A.subject_period(F.col("first"), F.col("last"), F.col("relation"), F.col("anchor"))).select("doc_id", "first", "last", "relation", "anchor", "p.start", "p.end", "p.known")


_SAID = "ala ma kota a kot ma ale"
_REWRITES = [
    ("TEMAT", "t {}", "s {}", "Ala ma kota, a kot ma Alę.".replace("ę", "e"), _SAID, True, False), ("REKLAMA", "", "", _SAID, _SAID, True, False), ("INNE", "t {}", "s {}", _SAID, _SAID, False, False), ("TEMAT", None, "s", _SAID, _SAID, False, False), ("TEMAT", "t", None, _SAID, _SAID, False, False),
    ("TEMAT", "t {}", "s {}", "Koniec FRAGMENTU " + _SAID, _SAID, False, True), ("TEMAT", "t {}", "s {}", "ala ma kota", _SAID, False, True), ("TEMAT", "t {}", "s {}", "  ", _SAID, False, True), ("TEMAT", "t {}", "s {}", _SAID + " i jeszcze psa", _SAID, True, True), ("TEMAT", "t {}", "s {}", "xxx yy zzzz v www yy zzz", _SAID, True, True),
]


@query(shaped_sql(_REWRITES, "kind, topic, summary, rewritten, source, safe, doubtful"))
def rewrites(t):
    rows = shaped(t, [r[:5] for r in _REWRITES], "kind string, topic string, summary string, rewritten string, source string").drop("shape")
    safe = A.rewrite_is_safe(*map(F.col, rows.columns[1:]))
    return rows.select("*", safe.alias("safe"), A.rewrite_is_doubtful(F.col("rewritten"), F.col("source")).alias("doubtful"))


_HITS = [
    ("Al Fasher", "place", "El Fasher, Sudan", True), ("Shahed", "railway", "Shahed, {}, Iran", False), ("Kijów", "place", "Kyiv, Ukraine", False), ("Warszawa", "boundary", "warszawa, Polska", True), ("Łódź", "place", "Lodz, województwo łódzkie", True),
    ("Narva", None, "Narva, Estonia {}", False), ("Sahel", "natural", "", False), ("Sahel", "natural", None, False), ("Sahel", "shop", "Sahel", False), ("Morze Czarne", "water", "Kaukaz, Morze Czarne", True),
]


@query(shaped_sql(_HITS, "query, kind, display, plausible"))
def plausible_places(t):
    rows = shaped(t, [r[:3] for r in _HITS], "query string, kind string, display string")
    return rows.withColumn("plausible", A.plausible_place(F.col("query"), F.col("kind"), F.col("display"))).drop("shape")


_LONG = "To jest długi akapit artykułu {}, który nie jest podpisem. " * 4
_CAPTIONED = [
    (1, f"{_LONG}\n[img2: Prezydent Turcji]\nPrezydent  TURCJI\nKrótka linia {{}}\n{_LONG}", None, [(1, "image_marker"), (2, "image_description")]),
    (2, "[img1]\nMinister podczas wizyty\nFot. Jan / PAP\nTrzecia linia\nCzwarta linia", None, [(0, "image_marker"), (1, "image_credit"), (2, "agency"), (3, "image_credit")]),
    (3, "[img1: x]\n## Nagłówek\nLinia", None, [(0, "image_marker")]),
    (4, "[img5 broken\nLinia", None, [(0, "image_marker"), (0, "image_description")]),
    (5, "Źródło zdjęcia: Unsplash\nfoto: Ewa, domena publiczna\nCC BY-SA 4.0, Jan\nArchiwum prywatne\nZwykły tekst", None, [(0, "stock"), (1, "public_domain"), (2, "creative_commons"), (3, "own_or_private_archive")]),
    (6, "[img1: x]\n\n\nPo pustych liniach", None, [(0, "image_marker"), (3, "image_credit")]),
    (7, f"[img1: {_LONG.strip()}]\n{_LONG}\nDalej", None, [(0, "image_marker"), (1, "image_description")]),
    (8, f"[img1: x]\n{_LONG}\nDalej", None, [(0, "image_marker")]),
    (9, "Jan Nowak / Agencja Wyborcza.pl", "https://www.gazeta.pl/a", [(0, "own_or_private_archive")]),
    (10, "Jan Nowak / Agencja Wyborcza.pl", "https://www.onet.pl/a", [(0, "agency")]),
    (11, "", None, []),
    (12, None, None, []),
]
_CAPTION_ROWS = [(i, line, category) for i, _, _, found in _CAPTIONED for line, category in found]


@query(shaped_sql([(i - 1, line, category) for i, line, category in _CAPTION_ROWS], "line, category", len(_CAPTIONED)))
def caption_lines(t):
    rows = shaped(t, [r[:3] for r in _CAPTIONED], "id int, text string, url string")
    return rows.select("doc_id", F.explode(C.captions(F.col("text"), F.coalesce("url", F.lit("")))).alias("c")).select("doc_id", F.col("c.line_index").alias("line"), "c.category")


_BARE = [(i, "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in {line for line, _ in found})) for i, text, url, found in _CAPTIONED]


@query(shaped_sql([(i - 1, bare) for i, bare in _BARE], "bare", len(_CAPTIONED)))
def captions_removed(t):
    return shaped(t, [r[:2] for r in _CAPTIONED], "id int, text string").select("doc_id", C.without_captions(F.col("text")).alias("bare"))


_PARTS = [
    ("sentences", "Ala ma kota. Kot ma Alę! Co dalej?", 2, ["Ala ma", "kota", "Kot ma", "Alę", "Co dalej?"]),
    ("sentences", "jedno {} trzy", 5, ["jedno {} trzy"]),
    ("sentences", "  ", 5, []),
    ("paragraphs", "a b c\n\nd e\n\nf g\n\nh i j k l. m\n\nn", 4, ["a b c", "d e\nf g", "h i j k", "l", "m", "n"]),
    ("paragraphs", "a b\n\nc", 4, ["a b\n\nc"]),
    ("headings", "intro {}\n# A\none two\n## B\nx y z\n# C\nshort", 4, ["intro {}", "\n# A\none two", "## B x y", "z", "\n# C\nshort"]),
    ("headings", "a b c", 4, ["a b c"]),
    ("headings", "a b\n**bold** c d\n**next** e\n— **say** f", 4, ["a b", "\n**bold** c d", "\n**next** e", "\n— **say** f"]),
]


@query(shaped_sql([(k, how, text, n, part) for k, (how, text, _, parts) in enumerate(_PARTS) for n, part in enumerate(parts)], "how, text, position, part", len(_PARTS)))
def word_parts(t):
    rows = shaped(t, [r[:3] for r in _PARTS], "how string, text string, most int")
    part = lambda how, most, f: rows.where((F.col("how") == how) & (F.col("most") == most)).select("doc_id", "how", "text", F.posexplode(f(F.col("text"), most)).alias("position", "part"))
    return part("sentences", 2, S.by_sentences).union(part("sentences", 5, S.by_sentences)).union(part("paragraphs", 4, S.by_paragraphs)).union(part("headings", 4, S.by_headings))


_LINKS = [
    ("see https://{}.\ncom now", "see https://{}.com now"), ("https://a.pl/x\nhttps://b.pl/y", "https://a.pl/x\nhttps://b.pl/y"), ("https://a.pl/x\nhttp://b.pl", "https://a.pl/x\nhttp://b.pl"), ("https://a.pl/x\nDalej", "https://a.pl/x\nDalej"), ("https://a.pl/x\n Ślad", "https://a.pl/x\n Ślad"),
    ("https://a.pl/x\n\r\nfoo bar\nbaz", "https://a.pl/xfoo bar\nbaz"), ("(https://a.pl/x)\nfoo", "(https://a.pl/x)\nfoo"), ("no link {}\nhere", "no link {}\nhere"), ("https://a.\nb.\nc", "https://a.b.c"), ("x\nhttps://a.\nb\nKoniec\ntu", "x\nhttps://a.b\nKoniec\ntu"), ("", ""), (None, None),
]


@query(shaped_sql(_LINKS, "text, whole"))
def joined_links(t):
    return shaped(t, [r[:1] for r in _LINKS], "text string").withColumn("whole", S.whole_links(F.col("text"))).drop("shape")


_IMAGES = [("a ![{}](u1) b ![](u2) c ![z](u3)", "a [1] b  c [2]", "1|{}|u1,2|z|u3"), ("![](a)", "[1]", "1|Brak opisu|a"), ("![](a)![b](a)", "[1][2]", "1|Brak opisu|a,2|b|a"), ("none [x](u1)", "none [x](u1)", ""), ("![x](u2)", "", ""), ("", "", "")]


@query(shaped_sql(_IMAGES, "markdown, text, images"))
def image_numbers(t):
    rows = shaped(t, [r[:1] for r in _IMAGES], "markdown string").withColumn("n", S.numbered_images(F.col("markdown"), ("u2",)))
    return rows.select("doc_id", "markdown", "n.text", F.array_join(F.transform("n.images", lambda x: F.concat_ws("|", x["number"], x["alt"], x["url"])), ",").alias("images"))


_MAILS = [
    ('<html><head><title>t</title></head><body><h2>Hi &amp; bye</h2><p>One {}<br/>two <b>bold</b> <em>it</em></p><ul><li>x</li><li><a class="k" href="https://e.com">e</a></li></ul><!-- c --></body></html>', "## Hi & bye\n\nOne {}\ntwo **bold** *it*\n\n- x\n- e (https://e.com)"),
    ("<style>p{}</style>plain {} \ntext", "plain {}\ntext"), ("<P>a</P><DIV>b</DIV>", "a\n\nb"), ("<header>h</header><script>x<y</script>z", "h\nz"), ("a<br>b<br />c", "a\nb\nc"), ("<i>a</i> <strong >b</strong>", "*a* **b**"), ("", ""),
]


@query(shaped_sql(_MAILS, "html, text"))
def mail_texts(t):
    return shaped(t, [r[:1] for r in _MAILS], "html string").withColumn("text", S.mail_text(F.col("html"))).drop("shape")


_DATED = [("Spotkanie 5.04 i 12/11/2023, nie 32.01 ani 123.04 {}", 10, "5.04"), ("Spotkanie 5.04 i 12/11/2023, nie 32.01 ani 123.04 {}", 17, "12/11/2023"), ("1-02-99", 0, "1-02-99"), ("od 31.12 do 01.01 w {}", 3, "31.12"), ("od 31.12 do 01.01 w {}", 12, "01.01")]


_DATED_TEXTS = list(dict.fromkeys([r[0] for r in _DATED] + ["bez dat 13.13 {}", ""]))


@query(shaped_sql([(_DATED_TEXTS.index(r[0]), *r, r[0]) for r in _DATED], "text, start, date, around", len(_DATED_TEXTS)))
def dated_places(t):
    rows = shaped(t, [(x,) for x in _DATED_TEXTS], "text string")
    return rows.select("doc_id", "text", F.explode(S.dated_places(F.col("text"))).alias("d")).select("doc_id", "text", "d.start", "d.date", "d.around")


@query("SELECT user_id AS document_id, max_by(event_id, (value, -event_id)) AS fragment_id, max(value) AS similarity FROM events WHERE value IS NOT NULL GROUP BY user_id")
def best_fragments(t):
    return E.best_fragment(t("events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("fragment_id"), F.col("value").alias("similarity")))


@query("""
WITH topics AS (SELECT l_orderkey AS run, count(*) AS n, min('s' || l_suppkey) AS summary FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1 HAVING count(*) = 1)
SELECT o_custkey AS document_id, min_by(summary, run) AS summary FROM orders JOIN topics ON run = o_orderkey WHERE o_orderstatus <> 'F' AND o_custkey % 3 > 0 GROUP BY 1
""")
def single_topics(t):
    docs = t("customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 3 == 0, "x").when(F.col("c_custkey") % 3 == 1, "").alias("tags"))
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "superseded").otherwise("reviewed").alias("status"))
    chunks = t("lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "N", "TEMAT").otherwise("REKLAMA").alias("type"), F.concat(F.lit("s"), "l_suppkey").alias("summary"))
    return E.single_topic(docs, runs, chunks)


@query("SELECT page_id AS document_id, CASE WHEN page_id % 5 = 0 THEN 'note' ELSE 'webpage' END AS kind, CASE WHEN page_id % 5 > 0 AND page_id % 3 < 2 AND page_id % 2 = 0 AND html <> '' THEN html WHEN page_id % 3 = 1 THEN NULL WHEN page_id % 3 = 0 THEN '' ELSE 'old' END AS html FROM pages")
def html_filled(t):
    k = F.col("page_id")
    docs = t("pages").select(k.alias("document_id"), F.when(k % 5 == 0, "note").otherwise("webpage").alias("kind"), F.when(k % 3 == 0, "").when(k % 3 == 2, "old").alias("html"))
    return E.filled_html(docs, t("pages").where("page_id % 2 = 0").select(k.alias("document_id"), "html"))


_ASKED = ("nation_3", "NATION_12", "ation_1", "n_2", "zzz")


@query(f"""
WITH a AS (SELECT unnest([{', '.join(f"'{x}'" for x in _ASKED)}]) AS asked), x AS (SELECT asked, n_name AS name FROM a JOIN nation ON lower(asked) = lower(n_name))
SELECT * FROM x UNION ALL SELECT asked, n_name FROM a JOIN nation ON contains(lower(n_name), lower(asked)) WHERE asked NOT IN (SELECT asked FROM x)
""")
def countries_asked(t):
    return E.named_or_like(inline(t, [(x,) for x in _ASKED], "asked string"), t("nation").select(F.col("n_name").alias("name")))


_DAYS = [
    (["x", "Wczoraj, 12:00"], ["dziś"], [], "2024-03-01"), ([None, "nic {}"], ["Czytaj także\nwczoraj", "dziś"], [], "2024-03-02"), (["nic {}"], ["Czytaj także\nwczoraj"], ["3 godziny temu"], "2024-03-01"),
    (["nic {}"], [], ["3 godziny temu", "Czytaj także"], None), ([], [], [], None), (["nic {}"], [None], [None, "dziś"], "2024-03-02"), (["dziś", "wczoraj"], [], [], "2024-03-02"),
]


@query(shaped_sql([(r[3],) for r in _DAYS], "day"))
def published_days(t):
    rows = shaped(t, [r[:3] for r in _DAYS], "texts array<string>, chunks array<string>, removed array<string>")
    day = E.published_day(F.col("texts"), F.col("chunks"), F.col("removed"), F.lit("2024-03-02 02:00:00").cast("timestamp"), "(?i)czytaj także")
    return rows.select("doc_id", day.cast("string").alias("day"))


@query(r"""
WITH c AS (SELECT conv_id, turn, text, split_part(text, ' ', 1) AS first FROM conversations), n AS (SELECT DISTINCT conv_id, lower(regexp_extract(text, '[A-Za-z]+', 0)) AS name FROM conversations),
m AS (SELECT conv_id AS document_id, turn AS position, name, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_äöüßàâçéèêëîïôùûñáíúóæœªº]+'), lambda w: w = name))::BIGINT AS mentions FROM c JOIN n USING (conv_id) WHERE name <> '')
SELECT * FROM m WHERE mentions > 0
""")
def chapter_mentions(t):
    """Each conversation's turns as chapters, its names the first plain word of each turn."""
    turns = t("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("position"), "text")
    return E.mentions_by_chapter(turns, turns.select("document_id", F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("name")))
