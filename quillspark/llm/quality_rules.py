"""Line-first cleaning and the document verdict that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES, keeps_names, let, once, steps, with_columns, words_of

#: Characters of the symbol count, of the punctuation rule and of the navigation rule.
SYMBOLS = r"[#*$%&|<>]"
LOUD = r"[!?#*$%&|<>{}~^=_\\]"
SEPARATORS = r"[|»›•]"
#: Stock phrases of pages in English, German, French and Spanish, each from and to an ASCII letter, marked letters in both cases.
STOCK_PHRASES = (
    "cookie policy", "privacy policy", "terms of (use|service)", "all rights reserved", "enable javascript", "click here", "sign up", "log in", "subscribe now", "lorem ipsum",
    "datenschutzerkl[äÄ]rung", "cookie-richtlinie", "nutzungsbedingungen", "alle rechte vorbehalten", "javascript aktivieren", "hier klicken", "jetzt (anmelden|abonnieren|registrieren)", "impressum",
    "politique de cookies", "mentions l[éÉ]gales", "conditions d.utilisation", "tous droits r[éÉ]serv[éÉ]s", "activer javascript", "cliquez ici", "se connecter", "abonnez-vous",
    "pol[íÍ]tica de (cookies|privacidad)", "aviso legal", "t[éÉ]rminos (de uso|y condiciones)", "todos los derechos reservados", "activar javascript", "(haz|haga) clic", "iniciar sesi[óÓ]n", "suscr[íÍ]bete",
)
BOILERPLATE = rf"(?i)\b(({'|'.join(STOCK_PHRASES)})\b|politique de confidentialit)"

#: A stock phrase in a line of up to STOCK_WORDS words counts against it; a line of up to BUTTON_WORDS is little else; a neighbour of up to MENU_WORDS is part of a menu.
STOCK_WORDS, BUTTON_WORDS, MENU_WORDS = 25, 6, 4
#: How many lines at either end of a text are its header and footer.
EDGE_LINES = 2
SENTENCE_END = r"[.!?…:;)\"»”]\s*$"


def line_facts(line: Column) -> Column:
    """A line with its number of words, and whether the rules on its own characters fail it.

    Punctuation: 4 or more loud characters and over 0.3 a word. Navigation: 3 or more separators and over 0.2 a word.
    """
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    loud = F.regexp_count(line, F.lit(LOUD))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    return F.struct(line.alias("line"), n.alias("n"), (((loud >= 4) & (loud * 10 > n * 3)) | ((separators >= 3) & (separators * 5 > n))).alias("bad"))


def is_boilerplate(lines: Column, i: Column) -> Column:
    """Whether line i of the facts of a text is boilerplate: a stock phrase of one of four languages, and two points.

    A line of few words has two by itself. One point each: it stands at either end of the text; the line before or after it is one of a
    menu; it doesn't end like a sentence; it holds two stock phrases or more. So prose that mentions a phrase stays.
    """
    here = F.get(lines, i)
    menu = lambda k: F.coalesce(F.get(lines, k)["n"].between(1, MENU_WORDS), F.lit(False)).cast("int")
    edge = ((i < EDGE_LINES) | (i >= F.size(lines) - EDGE_LINES)).cast("int")
    points = (here["n"] <= BUTTON_WORDS).cast("int") * 2 + edge + F.greatest(menu(i - 1), menu(i + 1)) + (~here["line"].rlike(SENTENCE_END)).cast("int") + (F.regexp_count(here["line"], F.lit(BOILERPLATE)) >= 2).cast("int")
    return F.when((here["n"] <= STOCK_WORDS) & here["line"].rlike(BOILERPLATE), points >= 2).otherwise(False)


def clean_lines(lines: Column) -> Column:
    """The lines that fail no rule."""
    kept = lambda facts: F.filter(facts, lambda x, i: ~(x["bad"] | is_boilerplate(facts, i)))
    return F.transform(let(F.transform(lines, line_facts), kept), lambda x: x["line"])


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more. Windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(r: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(r, a)["h"] == F.get(r, b)["h"], F.lit(False))
            return F.filter(F.transform(r, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda p: p.isNotNull())

        return F.size(F.array_distinct(F.flatten(F.transform(let(ranked, repeated), lambda p: F.array(p, p + 1, p + 2)))))

    def of(w: Column) -> Column:
        hashes = F.transform(steps(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return let(words, of)


@keeps_names
def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_lost_percent: int = 50, text_col: str = "text") -> DataFrame:
    """Removes the lines that fail a rule, then judges each document by what is left. One pass over the rows, no shuffle.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (of the whole text), base_failed, kept (false if
    base_failed or if over max_lost_percent of the characters stood in removed lines) and clean_text (the lines that are
    left, joined by newlines), over input columns of these names. Null text counts as empty: no words, base_failed.
    Rows, ties and repeated rows are judged one by one; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != ""
    parts = once(docs, "__parts", F.struct(words_of(text).alias("words"), F.split(text, "\n").alias("lines")))
    words, lines = F.col("__parts.words"), F.col("__parts.lines")
    figures = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(F.filter(lines, has_word), lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeat_words(words).cast("long").alias("n_repeat_words"),
        F.array_join(clean_lines(lines), "\n").alias("clean_text"),
    )
    measured = once(parts, "__m", figures)
    m = F.col("__m")
    size = lambda t: F.length(F.regexp_replace(t, SPACES, ""))
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
    lost = 100 * (m["word_chars"] - size(m["clean_text"])) > max_lost_percent * m["word_chars"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text"]
    return with_columns(measured, ["__m", "__parts"], **{k: m[k] for k in names}, base_failed=failed, kept=~failed & ~lost)
