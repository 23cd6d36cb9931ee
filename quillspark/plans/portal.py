"""Portal articles and photo credits, over documents of several shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import portal as P
from ..functions import site_lines as S
from ..operators.articles import clean_articles
from .registry import query, shaped, shaped_sql

_ARTICLES = [
    ("Title {}\nREKLAMA\n12\n---\n## Top 5 treści Premium [link3]\n**1** teaser\nshort\n**Pytanie?**\n## Zobacz [link4]\n## Wideo\n\n![x](y)\nshort again\nWięcej w Strefie Premium\nBody", "Title {}\n**Pytanie?**\nBody"),
    ("{}\nREKLAMA\n---\n12\nEnd", "{}\nEnd"),
    ("### Więcej pogłębionych treści\nskip\nWięcej w Strefie Premium\nafter {}", "after {}"),
    ("## Top 5 treści Premium [link3]\nskip\n" + "p" * 81 + "\nend {}", "p" * 81 + "\nend {}"),
    ("## Video\n![x](y)\nskip {}", ""),
    ("## Heading {}\nprose\n![x](y)", "## Heading {}\nprose\n![x](y)"),
    ("a\n\n\n\nb {}", "a\n\nb {}"),
    ("link[1]: http\npicture[2]: x\ntext {}", "text {}"),
    ("", ""),
    ("Audio generowane przez AI (x)\n## Zobacz [link4]\n**1** {}\n**Pytanie?**", "**1** {}\n**Pytanie?**"),
    ("  spaces {}  \nLubię to\n[ ]\nZwiń", "spaces {}"),
]


@query(shaped_sql([r[1:] for r in _ARTICLES], "body"))
def article_cleaning(t):
    return shaped(t, [r[:1] for r in _ARTICLES], "page string").select("doc_id", P.article_lines(F.col("page")).alias("body"))


_CREDITED = [
    ("Prose {}\nfot. Shutterstock\nA. Nowak / PAP\nplain\nFot. Jan\nMiasto (zdjęcie ilustracyjne)", [(1, "stock"), (2, "agency"), (4, "other"), (5, "illustrative")]),
    ("zdj. ilustracyjne Getty Images {}", [(0, "illustrative")]),
    ("EPA/{}", [(0, "agency")]),
    ("Forum {}", []),
    ("Źródło zdjęcia: {}", [(0, "other")]),
    ("fot. " + "x" * 130, []),
    ("**Fot.** Reuters", [(0, "agency")]),
    ("zdjęcie: {}\n\nautor zdjęcia Jan", [(0, "other"), (2, "other")]),
    ("", []),
    ("fotografia {}", []),
    ("Jan/Forum\nAdobe Stock", [(0, "agency"), (1, "stock")]),
]


@query(shaped_sql([(k, *c) for k, (_, found) in enumerate(_CREDITED) for c in found], "line_index, category", len(_CREDITED)))
def photo_credits(t):
    rows = shaped(t, [r[:1] for r in _CREDITED], "page string")
    return rows.select("doc_id", F.explode(P.credits(F.col("page"))).alias("c")).select("doc_id", "c.line_index", "c.category")


_SITES = [
    ("https://onet.pl/{}", "Top treści w Premium\n\n1 Tytuł [link3]\n12 Drugi [link14]\nTreść {}.\n#### Posłuchaj artykułu\nx1.75\n- x1 +\n5 min czytania\n17 marca 2026, 12:31\n[img0][img1]1,6 tys.\nPowiązane tematy: A\nOpracowanie: B\nKoniec", "Treść {}.\nKoniec"),
    ("https://www.fakt.pl/{}", "**PRZECZYTAJ CAŁY TEKST** [link2]\n**PRZECZYTAJ CAŁY {}\n**3** ### T [link1]\nA Więcej w Strefie Premium [link1]\n17 marca 2026\nTop treści w Premium\nZwykły {}\n1 Tytuł [link3]", "**PRZECZYTAJ CAŁY {}\n17 marca 2026\nZwykły {}\n1 Tytuł [link3]"),
    ("https://money.pl/{}", "Treść {}\nDziennikarz portalu.\n\njan@grupawp.pl o autorze\nŹródło artykułu: X\n\nW\nDalej\n12 komentarzy\n24 marca 2026, 12:26\ngospodarka rosja [link1] +1\n[img2: x] https://money.pl/b\n2 + 3\nNotowania", "Treść {}\n\nDalej\n2 + 3"),
    ("https://money.pl/{}", "Źródło artykułu: {}\nWu\nX\nA@GrupaWP.pl o autorze", "Wu"),
    ("https://wp.pl/{}", "Treść\nsztuczna inteligencja\n\npolska\n+3\nPREMIUM Zapisz się na newsletter!\nNewsy, wywiady, śledztwa i reportaże w Twojej skrzynce co tydzień - zawsze za darmo.\nZapisz mnie\nZapisz mnie\nJan, dziennikarz Wirtualnej Polski\n[" + "x" * 320 + ")\nzwykłe {}", "Treść\n\nZapisz mnie\nzwykłe {}"),
    ("https://o2.pl/{}", "Redakcja serwisu o2 {}\nmisja AI\nMisja AI\n+1\nPolska\n+2 {}", "misja AI\nPolska\n+2 {}"),
    ("https://bankier.pl/{}", "Źródło:\n\nPAP {}\ntematy\nropa\ngaz\n\nBankier.plGiełda\nNotowania Forum Portfel\n2026-02-25 08:10\nTreść\ntematy\n" + "t" * 70 + "\nad", "Treść\n" + "t" * 70),
    ("https://gazeta.pl/{}", "A\nCzytaj także: [link2]\n\nSUBSKRYPCJA\nkrótki {}\n[" + "v" * 120 + "\n" + "w" * 100 + "\nOtwórz galerię (12)\nPrzejdź na [link7]\nB", "A\n" + "w" * 100 + "\nB"),
    ("https://gazeta.pl/{}", "Czytaj również:\nkrótki {}", ""),
    ("https://interia.pl/{}", "11 minut temu\n2 godziny temu\nWczoraj, 22:30\nDziś, 09:15\nW skrócie\nW skrócie {}\nJutro, 09:15", "W skrócie {}\nJutro, 09:15"),
    ("https://ithardware.pl/{}", "Play\nPlayer {}\nad", "Player {}"),
    ("https://{}.example", "Play\nad\n+3", "Play\nad\n+3"),
    ("https://wp.pl/{}", "", ""),
    ("https://wp.pl/{}", None, None),
    (None, "Play {}", "Play {}"),
]


@query(shaped_sql([r[2:] for r in _SITES], "body"))
def portal_lines(t):
    return shaped(t, [r[:2] for r in _SITES], "url string, page string").select("doc_id", S.portal_lines(F.col("page"), F.col("url")).alias("body"))


_MENU = "\n".join(S.MENU)
_RAW = [
    ("https://onet.pl/{}", "\n* a\n* b\n- c\n* d\n* e\nLead {}\n* f", "Lead {}\n* f", None, None, None),
    ("https://onet.pl/{}", "* a {}\n* b\n- c\n* d\n* e\n* f", "* a {}\n* b\n- c\n* d\n* e\n* f", None, None, None),
    ("https://interia.pl/{}", _MENU + '\nTekst {}\nSuper\n\nHahaha\nSzok\nSmutny\nZły\n*Interia współpracuje z czołowymi redakcjami na świecie. Co tydzień "Gazeta {}", z którego pochodzi poniższy artykuł, to x.*\n\nDalej', "Tekst {}\n\nDalej", None, None, "Gazeta {}"),
    ("https://interia.pl/{}", "Polska\nPogoda {}\nInteria współpracuje z czołowymi redakcjami na świecie. Koniec", "Polska\nPogoda {}\nInteria współpracuje z czołowymi redakcjami na świecie. Koniec", None, None, None),
    ("https://x.pl/{}", "![Widok](https://e.com/a.jpg)\nfot. Jan / PAP\nWidok\nTekst {}", "[img0: Widok]\nTekst {}", None, "Widok|https://e.com/a.jpg|fot. Jan / PAP|agency", None),
    ("https://x.pl/{}", "![Widok na {}](https://e.com/a.jpg)\nJan Nowak\nwidok  na {}\nTekst", "[img0: Widok na {}]\nTekst", None, "Widok na {}|https://e.com/a.jpg|Jan Nowak|image_credit", None),
    ("https://x.pl/{}", 'Tekst ![](https://e.com/t) i ![z](https://e.com/{}.png) ![z](https://e.com/{}.png) [Link {}](https://e.com/b "t") oraz [tag](https://e.com/tag/x), [Dalej](https://e.com/c)', "Tekst i [img0: z] Link {} [link0] oraz tag, Dalej [link1]", "Link {}|https://e.com/b;Dalej|https://e.com/c", "z|https://e.com/{}.png||", None),
    ("https://x.pl/{}", "[![Mapa](m.png)](https://e.com)\npodpis {}\n[a](/tag/1)[b](/tag/2)\n[img9] x\n[![k](k.png) #### Karta](u)", "[img0: Mapa]\npodpis {}\nx", None, "Mapa|m.png|podpis {}|image_credit", None),
    ("https://x.pl/{}", "[## H](u) [" + "y" * 5 + "](https://e.com/" + "q" * 200 + ") [](v) A {} ![](a.svg)![m](onetmobilemainpage/emotion/1)![Misja AI](b.png)", "A {} [img0]", None, "|a.svg||", None),
    ("https://wp.pl/{}", "picture[1]:\"x\" A\xa0{}\nSkomentuj\nREKLAMA\n\n\n\nlink[2]: y\nB", "A {}\n\nB", None, None, None),
    ("https://x.pl/{}", None, "", None, None, None),
    (None, "", "", None, None, None),
]


@query(shaped_sql([r[2:] for r in _RAW], "body, links, images, origin"))
def articles_cleaned(t):
    """Markdown of pages of twelve shapes: text with numbered markers, links, pictures with captions, and the paper that a reprint names."""
    a = F.col("article")
    told = lambda c, *names: F.nullif(F.array_join(F.transform(c, lambda r: F.concat_ws("|", *[F.coalesce(r[n], F.lit("")) for n in names])), ";"), F.lit(""))
    return clean_articles(shaped(t, [r[:2] for r in _RAW], "url string, page string"), "page", "url").select("doc_id", a["text"].alias("body"), told(a["links"], "text", "url").alias("links"), told(a["images"], "alt", "url", "caption", "category").alias("images"), a["source"].alias("origin"))


_MARKDOWN = [
    ("Lead {}\n**Pogrubiona**\n## Tytuł\ntekst", "Lead {}\n\n**Pogrubiona**\n\n## Tytuł\ntekst"),
    ("**Pierwsza {}**\ntekst", "**Pierwsza {}**\ntekst"),
    ("a {}\n**CZYTAJ WIĘCEJ: x\n * **Zobacz również:** y\n * **Zobacz inne:** y\nb", "a {}\n\n\n * **Zobacz inne:** y\nb"),
    ("a\n\n reklama \n\nb {}\nreklama sama\nc\nreklama\n", "a\nb {}\nreklama sama\nc"),
    ("a\n* **Punkt {}** reszta\n  * link[12]: x\n* link[1]: x", "a\n reszta\n\n* link[1]: x"),
    ("  Dalszy ciąg materiału pod wideo  \nb {}", "\nb {}"),
    ("Kontynuuj czytanie od miejsca, w którym skończyłeś.\nx {}\n * Dużo czytania, a mało czasu? Sprawdź skrót artykułu  ", "\nx {}\n"),
    ("   * **Tekst publikujemy dzięki uprzejmości serwisu {}\n* **Tekst publikujemy dzięki uprzejmości serwisu {}", "\n* **Tekst publikujemy dzięki uprzejmości serwisu {}"),
    ("", ""),
    (None, None),
    ("x {}\n## Zobacz również\n**Zobacz także:** z", "x {}\n\n\n"),
]


@query(shaped_sql([r[1:] for r in _MARKDOWN], "body"))
def markdown_noise(t):
    return shaped(t, [r[:1] for r in _MARKDOWN], "page string").select("doc_id", S.without_markdown_noise(F.col("page")).alias("body"))
