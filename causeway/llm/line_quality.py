"""Line-first cleaning: judge lines, drop those that fail, reject documents that lose too much.

A line with at least one word fails when one of these holds:

* punctuation: marks of ``#*$%&|<>`` make up over a tenth of its word characters, or ``!!`` follows
  at least half of its words, or it has under five words and no mark of sentence end;
* navigation: it has three separators ``|»›•·`` or more, or web addresses for at least half of its
  words, or up to six words that begin with a menu term of one of four languages;
* boilerplate: it has up to 25 words, among them ``©`` or a licence, copyright, cookie, legal or script
  notice of one of four languages.

Only Spark's own functions are used; a row is judged by itself, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import SPACE_CHARS, documents, fresh, words

SYMBOLS = "#*$%&|<>"
MAX_LOST_PERCENT = 50
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Menu terms at a line's start, and notices anywhere in a short line, by language; both are parameters.
NAVIGATION = {
    "en": "home|menu|skip to|back to|next|previous|log ?in|sign (in|up)|share|search|site ?map|contact us",
    "de": "startseite|zum inhalt|weiter zu|anmelden|abmelden|registrieren|suche|impressum|kontakt|teilen|nach oben",
    "fr": "accueil|aller au|retour|se connecter|connexion|inscription|rechercher|plan du site|partager|contactez-nous",
    "es": "inicio|ir al|volver a|iniciar sesi.n|registrarse|buscar|mapa del sitio|compartir|contacto",
}
BOILERPLATE = {
    "en": "all rights reserved|licen[sc]ed under|released under|terms of (use|service)|privacy policy|use of cookies|cookie policy|enable javascript|copyright|lorem ipsum|powered by",
    "de": "alle rechte vorbehalten|lizenziert unter|nutzungsbedingungen|datenschutzerkl.rung|verwendet cookies|allgemeine gesch.ftsbedingungen",
    "fr": "tous droits r.serv.s|sous licence|conditions d.utilisation|politique de confidentialit.|utilise des cookies|mentions l.gales",
    "es": "todos los derechos reservados|bajo licencia|condiciones de uso|t.rminos de uso|pol.tica de privacidad|utiliza cookies|aviso legal",
}
#: Marks that stand between menu entries in any language.
SEPARATORS = "|»›•·"
NAVIGATION_AT, BOILERPLATE_AT = r"(?i)^\W*({})\b", "(?i)(©|{})"
SENTENCE_END = r"[.!?…:;\"'”»)]\s*$"


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_failed", "n_words_left", "cleaned_text", "base_failed", "kept"]


def _chars_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACE_CHARS, ""))


def _times(line: Column, what: str) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit(what), F.lit("")))) / len(what)


def line_fails(line: Column, n: Column, navigation: dict[str, str] = NAVIGATION, boilerplate: dict[str, str] = BOILERPLATE) -> Column:
    """Whether a line with n words, at least one, fails one of the rules; the tables hold alternatives of a pattern by language."""
    punctuation = (
        (_chars_of(line, SYMBOLS) * 10 > _word_chars(line))
        | (_times(line, "!!") * 2 >= n)
        | ((n < 5) & ~line.rlike(SENTENCE_END))
    )
    links = F.greatest(_times(line, "://"), _times(line, "www.")) * 2 >= n
    menu = (n <= 6) & line.rlike(NAVIGATION_AT.format("|".join(navigation.values())))
    notice = (n <= 25) & line.rlike(BOILERPLATE_AT.format("|".join(boilerplate.values())))
    return punctuation | (_chars_of(line, SEPARATORS) >= 3) | links | menu | notice


def _window_keys(w: Column, n: Column) -> Column:
    """The sorted keys tell three-word windows that occur twice or more.

    A window becomes one long: its hash in the high part, its place in the low part. After sorting,
    equal windows are neighbours; the words themselves confirm each hit.
    """
    radix = F.floor(F.lit(4_000_000_000_000_000_000) / F.greatest(n, F.lit(1)))
    return F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
        lambda a, i: F.pmod(F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)), radix) * n + i,
    )


def clean_lines(
    docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT,
    navigation: dict[str, str] = NAVIGATION, boilerplate: dict[str, str] = BOILERPLATE,
) -> DataFrame:
    """docs with the verdict of line-first cleaning.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lines_failed,
    n_words_left (long), cleaned_text, base_failed and kept. Columns of docs with these names are
    replaced, others stay, whatever their names. A null or empty text has no words: all counts are 0,
    cleaned_text is empty, base_failed is true and kept false. Lines without a word stay in
    cleaned_text. Equal rows get equal verdicts; an empty table stays empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = docs.drop(*(x for x in RESULT if x != text))
    lines, w, ordered, left, full = fresh(docs.select("*", *[F.lit(0).alias(x) for x in RESULT if x not in docs.columns]), "lines", "w", "ordered", "left", "full")
    step = kept.withColumn(lines, F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("w"))))
    step = step.withColumn(w, F.flatten(F.col(f"{lines}.w"))).withColumn("n_words", F.size(w).cast("long"))
    n, all_words = F.col("n_words"), F.col(w)
    step = step.withColumn(ordered, F.sort_array(_window_keys(all_words, n)))
    s = F.col(ordered)

    def places(a: Column, b: Column) -> Column:
        same = a - F.pmod(a, n) == b - F.pmod(b, n)
        i, j = (F.pmod(x, n).cast("int") for x in (a, b))
        for k in range(3):
            same = same & (F.get(all_words, i + k) == F.get(all_words, j + k))
        return F.when(same, F.array(i, i + 1, i + 2, j, j + 1, j + 2))

    hits = F.filter(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), places), lambda x: x.isNotNull())
    step = step.withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten(hits))).cast("long"))
    step = step.withColumn(full, F.transform(F.filter(lines, lambda x: F.size(x["w"]) > 0), lambda x: x["line"]))
    sized = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.size(x["w"]).alias("n")))
    step = step.withColumn(left, F.filter(sized, lambda x: (x["n"] == 0) | ~line_fails(x["line"], x["n"], navigation, boilerplate)))
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    step = step.withColumns({
        "n_lines": F.size(full).cast("long"),
        "n_lines_failed": (F.size(lines) - F.size(left)).cast("long"),
        "n_words_left": F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x["n"]),
        "word_chars": _word_chars(t).cast("long"),
        "n_symbols": _chars_of(t, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
        "cleaned_text": F.array_join(F.col(f"{left}.line"), "\n"),
        "base_failed": failed,
    })
    lost = 100 * (n - F.col("n_words_left")) > max_lost_percent * n
    step = step.withColumn("kept", ~F.col("base_failed") & ~lost)
    return step.select(*[F.col(f"`{c}`") for c in kept.columns if c not in RESULT], *RESULT)


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clean_lines of all documents, without texts; see there for nulls, empty texts, repeated rows and empty tables."""
    return clean_lines(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_lines_failed", "n_words_left",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(ls) AS l FROM d)),
judged AS (
  SELECT doc_id, l, n, chars > 0 AS has_word,
         chars > 0 AND (
           len(regexp_extract_all(l, '[#*$%&|<>]')) * 10 > chars
           OR (length(l) - length(replace(l, '!!', ''))) / 2 * 2 >= n
           OR greatest((length(l) - length(replace(l, '://', ''))) / 3, (length(l) - length(replace(l, 'www.', ''))) / 4) * 2 >= n
           OR (n < 5 AND NOT regexp_matches(l, '[.!?…:;"''”»)]\s*$'))
           OR len(regexp_extract_all(l, '[|»›•·]')) >= 3
           OR (n <= 6 AND regexp_matches(l, '@navigation'))
           OR (n <= 25 AND regexp_matches(l, '@boilerplate'))
         ) AS fails
  FROM lines),
per AS (
  SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (fails) AS n_lines_failed,
         coalesce(sum(n) FILTER (NOT fails), 0)::BIGINT AS n_words_left,
         count(*) FILTER (has_word) - count(DISTINCT CASE WHEN has_word THEN l END) AS n_dup_lines
  FROM judged GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines, n_lines_failed, n_words_left
  FROM d JOIN per USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * (n_words - n_words_left) > 50 * n_words AS kept
FROM counted
""".replace("@navigation", NAVIGATION_AT.format("|".join(NAVIGATION.values()))).replace("@boilerplate", BOILERPLATE_AT.format("|".join(BOILERPLATE.values())))
