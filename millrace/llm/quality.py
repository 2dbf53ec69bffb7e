"""Line-first quality rules.

Every line is judged by rules of punctuation, navigation and boilerplate; lines that
fail are removed, and a document that loses too much of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import WORD, free, let, table

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A line may have symbols up to this share of its characters.
LINE_SYMBOLS = 0.05
#: A line with so many bars is navigation.
SEPARATORS = 3
#: A trail has so many steps at least, and so many words a step at most.
TRAIL_STEPS = 2
STEP_WORDS = 3
#: A line fails that has a phrase of boilerplate for every so many words.
PHRASE_WORDS = 40
#: A document is rejected that keeps less than this share of its words.
KEPT_SHARE = 0.5
#: A document of fewer words, or with more than this share of repeated words, fails the base rules.
MIN_WORDS = 50
REPEAT_PERCENT = 50

#: A line ends with one of these, or with a quotation; a lone » points onwards and ends nothing.
STOPS = ".!?:;…\"'”’)]"
ENDS = "(?:[.!?:;…\"'”’)\\]]|[.!?…][ \u00a0\u202f]?»|«[^»]*»)[ \t\n\\x0b\f\r]*$"
SHOUTING = r"(!!.*){3}"
#: What stands between the steps of a trail.
STEP = r"[ \t][|>»›→•·/][ \t]"
#: Lines that are a link and nothing else.
LABELS = [
    "home", "start", "next( page)?", "prev(ious)?( page)?", "back", "back to top", "(main )?menu", "search", "contact( us)?", "about( us)?", "site ?map", "register",
    "log ?out", "faq", "help", "print", "archives?", "accueil", "suivant", "pr[ée]c[ée]dent", "retour", "rechercher", "plan du site", "startseite", "weiter", "zur[üu]ck",
    "suche", "kontakt", "impressum", "datenschutz", "inicio", "siguiente", "anterior", "volver", "buscar", "contacto", "mapa del sitio",
]
LABEL = r"^[\s«»<>|‹›←→•·:.!–-]*(" + "|".join(LABELS) + r")[\s«»<>|‹›←→•·:.!–-]*$"
#: Phrases of boilerplate in English, German, French and Spanish.
PHRASES = [
    "all rights reserved", "privacy policy", "terms of (?:use|service)", "cookie", "enable javascript", "click here", "subscribe to", "sign up", "log ?in", "lorem ipsum",
    "read more", "share this", "powered by", "skip to content", "table of contents", "page [0-9]+ of [0-9]+", "copyright", r"\(c\) [0-9][0-9][0-9][0-9]",
    "alle rechte vorbehalten", "datenschutzerkl[äa]rung", "nutzungsbedingungen", "hier klicken", "jetzt anmelden", "weiterlesen", "mehr lesen", "mehr erfahren",
    "inhaltsverzeichnis", "seite [0-9]+ von [0-9]+", "zum inhalt springen", "javascript aktivieren", "newsletter abonnieren",
    "tous droits r[ée]serv[ée]s", "politique de confidentialit[ée]", "conditions d['’]utilisation", "cliquez ici", "lire la suite", "en savoir plus", "s['’]abonner",
    "activer javascript", "table des mati[èe]res", "page [0-9]+ sur [0-9]+", "aller au contenu", "mentions l[ée]gales",
    "todos los derechos reservados", "pol[íi]tica de privacidad", "t[ée]rminos de uso", "aviso legal", "haga clic aqu[íi]", "leer m[áa]s", "suscr[íi]b(?:ete|ase)",
    "activar javascript", "tabla de contenidos", "p[áa]gina [0-9]+ de [0-9]+", "saltar al contenido",
]
#: A phrase at the beginning of a word, by first letters, so that most words fail at once.
BOILERPLATE = "(?:^|[^a-z])(?:" + "|".join(f"{c}(?:{'|'.join(x[1:] for x in PHRASES if x[0] == c)})" if c.isalpha() else "|".join(x for x in PHRASES if x[0] == c) for c in sorted({x[0] for x in PHRASES})) + ")"


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Windows are compared by their 64-bit hashes. Where all differ, as in most texts, that
    is all; else they are sorted, and equal ones are neighbours.
    """

    def covered(p: Column) -> Column:
        own = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        both = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return let(F.sort_array(F.transform(both, lambda x: x["p"])), covered)

    def counted(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(placed), twice))

    def windows(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return let(F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), counted)

    return let(words, windows)


def _ends(line: Column) -> Column:
    """Whether a line matches ENDS, by its last character where that settles it."""
    last = lambda r: F.right(r, F.lit(1))
    return let(F.rtrim(line, F.lit(" \t\n\x0b\f\r")), lambda r: last(r).isin([*STOPS]) | ((last(r) == "»") & r.rlike(ENDS)))


def _navigates(line: Column) -> Column:
    """Whether a line is a trail, a row of bars or one link."""
    trail = let(F.regexp_count(line, F.lit(STEP)), lambda k: (k >= TRAIL_STEPS) & (F.regexp_count(line, F.lit(WORD)) - k <= STEP_WORDS * (k + 1)))
    bars = F.length(line) - F.length(_without(line, "|>")) >= SEPARATORS
    return (line.rlike(STEP) & trail) | bars


def line_passes(line: Column) -> Column:
    """Whether a line passes the rules of punctuation, navigation and boilerplate; one without a word does not."""
    symbols = F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))
    punctuation = _ends(line) & (symbols <= LINE_SYMBOLS * F.length(line)) & ~(F.contains(line, F.lit("!!")) & line.rlike(SHOUTING))
    phrases = lambda low: PHRASE_WORDS * F.regexp_count(low, F.lit(BOILERPLATE)) >= F.regexp_count(line, F.lit(WORD))
    told = let(F.lower(line), lambda low: ~low.rlike(LABEL) & ~(low.rlike(BOILERPLATE) & phrases(low)))
    return F.when(punctuation, F.when(~_navigates(line), told).otherwise(False)).otherwise(False)


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measures of each text, its ``clean_text`` (the lines that pass) and ``kept``.

    New columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, clean_text, kept_words (long), kept. A null text counts as empty:
    no words, base_failed, not kept; so does one of spaces only. A text of any length is
    judged whole, inside its row, in time that grows with its length. Windows of words
    tie by 64-bit hashes. Repeated rows stay and nothing is shuffled. Columns of ``df``
    named like a result are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "kept_words", "kept"]
    df = free(df, new)
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    long = lambda c: c.cast("long")

    def measured(lines: Column, words: Column, cleaned: Column) -> Column:
        n, repeated, kept = F.size(words), repeated_words(words), F.regexp_count(cleaned, F.lit(WORD))
        worded = F.filter(lines, lambda x: x.rlike(WORD))
        base = let(F.struct(n.alias("n"), repeated.alias("r"), kept.alias("k")), lambda m: F.struct(m.alias("m"), ((m["n"] < MIN_WORDS) | (m["r"] * 100 > m["n"] * REPEAT_PERCENT)).alias("failed")))
        return let(
            base,
            lambda b: F.struct(
                long(b["m"]["n"]).alias("n_words"),
                long(F.length(_without(value, " \t\n\x0b\f\r"))).alias("word_chars"),
                long(F.length(value) - F.length(_without(value, SYMBOLS))).alias("n_symbols"),
                let(worded, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
                b["m"]["r"].alias("n_repeat_words"),
                b["failed"].alias("base_failed"),
                cleaned.alias("clean_text"),
                long(b["m"]["k"]).alias("kept_words"),
                (~b["failed"] & (b["m"]["k"] >= KEPT_SHARE * b["m"]["n"])).alias("kept"),
            ),
        )

    passed = lambda lines: F.array_join(F.filter(lines, line_passes), "\n")
    results = let(F.split(value, "\n"), lambda lines: let(words_of(value), lambda w: let(passed(lines), lambda c: measured(lines, w, c))))
    # through a generator: a later filter on the results is not pushed below, where it would compute them again, and no column needs a name of its own
    return df.select("*", F.inline(F.array(results)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and the verdict on every document."""
    return clean(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")


_W = WORD.replace("\\", "\\")
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines
  FROM documents
), win AS (
  SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 2)
), twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r
), m AS (
  SELECT d.r, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(list_sum(list_transform(list_filter(lines, lambda x:
      regexp_matches(x, '{ENDS.replace("'", "''")}')
      AND length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) <= {LINE_SYMBOLS} * length(x)
      AND NOT regexp_matches(x, '{SHOUTING}')
      AND length(x) - length(regexp_replace(x, '[|>]', '', 'g')) < {SEPARATORS}
      AND NOT (len(regexp_extract_all(x, '{STEP}')) >= {TRAIL_STEPS}
        AND len(regexp_extract_all(x, '{_W}')) - len(regexp_extract_all(x, '{STEP}')) <= {STEP_WORDS} * (len(regexp_extract_all(x, '{STEP}')) + 1))
      AND NOT regexp_matches(lower(x), '{LABEL}')
      AND {PHRASE_WORDS} * len(regexp_extract_all(lower(x), '{BOILERPLATE.replace("'", "''")}')) < len(regexp_extract_all(x, '{_W}'))
    ), lambda x: len(regexp_extract_all(x, '{_W}')))), 0) AS kept_words
  FROM d LEFT JOIN rep ON rep.r = d.r
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_PERCENT} AS base_failed, CAST(kept_words AS BIGINT) AS kept_words,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_PERCENT}) AND kept_words >= {KEPT_SHARE} * n_words AS kept
FROM m
"""
