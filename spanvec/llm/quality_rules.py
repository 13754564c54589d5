"""Line-first cleaning, in DataFrame functions only.

Lines are judged one by one: by punctuation (a line must end as a sentence does
and must not be strewn with marks), as navigation (menus and lists of links) and
as boilerplate (notices and page furniture).  Lines that fail are removed; a
document that loses too many of its words goes.

Nothing is shuffled: every figure is worked out within the row, in time that
grows with the text's length (times its logarithm for repeated windows).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, session_ready, word_array

SYMBOLS = r"[#*$%&|<>]"
BLANK = " \t\x0b\f\r\n"
#: What a sentence may end in.
LINE_END = ".!?:;)]\"'”’»…。！？"
#: Marks of which prose has few.
MARKS = r"[!?#*$%&|<>~^=_@{}\\]"
MOST_MARKS = 0.3
SEPARATORS = r"[|»›·•>]"
#: Starts of menu lines and of page furniture, in English, German, French and Spanish.
MENU = (
    r"(?iu)^[^a-z0-9]*("
    r"home|about us|contact us|log ?in|sign (in|up|out)|register|menu|next|previous|read more|back to top|share|tweet|skip to content|search|site ?map|follow us|"
    r"startseite|[üÜ]ber uns|kontakt|anmelden|abmelden|registrieren|weiterlesen|zurück zur|nach oben|teilen|impressum|folgen sie uns|"
    r"accueil|[àÀ] propos|contactez-nous|connexion|déconnexion|s'inscrire|précédent|lire la suite|haut de page|partager|rechercher|plan du site|suivez-nous|"
    r"inicio|acerca de|contacto|iniciar sesión|cerrar sesión|registrarse|siguiente|leer más|volver arriba|compartir|buscar|mapa del sitio|síguenos"
    r")\b"
)
MENU_WORDS = 8
BOILERPLATE = (
    "lorem ipsum", "enable javascript", "uses cookies", "use cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "subscribe to", "newsletter", "click here", "powered by",
    "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "verwendet cookies", "hier klicken",
    "politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "utilise des cookies", "cliquez ici", "abonnez-vous",
    "política de privacidad", "condiciones de uso", "todos los derechos reservados", "utiliza cookies", "haga clic aquí", "suscríbase",
)
MIN_WORDS = 50
MOST_REPEATED = 50
MOST_LOST = 0.5


def _any(text: Column, phrases) -> Column:
    low = F.lower(text)
    return reduce(or_, (low.contains(p) for p in phrases))


def line_fails(line: Column, text: Column | None = None) -> Column:
    """True for a line with a word that breaks a rule; lines without a word never fail.

    text: columns (marks, separators, boilerplate) telling what the whole text
    has at all, so that lines of a text without any are not searched for it.
    """
    n = F.size(word_array(line))
    has = lambda k: F.lit(True) if text is None else text[k]
    end = F.substring(F.rtrim(line, F.lit(BLANK)), -1, 1)
    punctuation = ~F.lit(LINE_END).contains(end) | (has("marks") & (F.regexp_count(line, F.lit(MARKS)) > MOST_MARKS * n))
    navigation = (has("separators") & (F.regexp_count(line, F.lit(SEPARATORS)) * 4 >= n)) | (line.rlike(MENU) & (n <= MENU_WORDS))
    return (end != "") & (punctuation | navigation | (has("boilerplate") & _any(line, BOILERPLATE)))


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the array, the first time included.

    Windows are compared by a 64-bit hash (two different ones of a text with n
    windows agree with a chance of n^2 / 2^65).
    """

    def of(w):
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        found = let(F.sort_array(grams), lambda s: F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
        at = F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(F.size(F.array_distinct(at)))

    return let(words, of)


def clean(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) to one row for each row: figures of the text, clean_text, kept.

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_kept_words, base_failed, kept, clean_text).  Null and empty texts have no
    words, and fail.  Other columns are not read.
    """
    session_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words, text = word_array(F.col("text")), F.col("text")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))

    has = F.struct(text.rlike(MARKS).alias("marks"), text.rlike(SEPARATORS).alias("separators"), _any(text, BOILERPLATE).alias("boilerplate"))

    def of_lines(lines):
        full = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANK)) != "")
        dup = let(full, lambda f: F.size(f) - F.size(F.array_distinct(f)))
        judged = F.transform(lines, lambda x: F.struct(x.alias("x"), line_fails(x, F.col("has")).alias("fails")))
        lost = lambda j: F.aggregate(F.filter(j, lambda x: x["fails"]), F.lit(0), lambda n, x: n + F.size(word_array(x["x"])))
        left = lambda j: F.array_join(F.transform(F.filter(j, lambda x: ~x["fails"]), lambda x: x["x"]), "\n")
        return let(judged, lambda j: F.struct(dup.cast("long").alias("n_dup_lines"), lost(j).cast("long").alias("n_lost_words"), left(j).alias("clean_text")))

    rows = rows.withColumn("has", has)
    rows = rows.select("doc_id", counts.alias("w"), let(F.split(text, "\n", -1), of_lines).alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    rows = rows.select("doc_id", "w.*", "l.*", "n_symbols").withColumn("n_kept_words", F.col("n_words") - F.col("n_lost_words")).drop("n_lost_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_kept_words") >= (1 - MOST_LOST) * F.col("n_words")))
