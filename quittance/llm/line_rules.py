"""Line-first cleaning with DataFrame functions only.

Every line of a text is judged on its own:

* punctuation: more symbols or exclamation marks than its words bear, or a long line
  without any mark, inside or at its end;
* navigation: words parted by bars, bullets and arrows, a row of links, or a short line
  that breaks off in dots;
* boilerplate: a short line with a phrase of licences, cookies and the like, in English,
  German, French or Spanish.

Failing lines are removed; a document is rejected if the
removed lines held more than ``max_loss`` of its word characters, or if one of
two whole-text rules (too short, too repetitive) fails.

Cases: a null or empty text has no words, counts 0 everywhere and fails the base
rule.  Blank lines never fail and are kept as they are.  Ties and repeated rows
are judged row by row.  A very long text is one row, whose arrays of words and lines
are in memory.  An empty table gives an empty result.  Extra columns pass through;
helper columns avoid clashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance.llm.common import SPACE, fresh, let, words_of

#: Phrases of licence, cookie and rights lines, lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "alle rechte vorbehalten",
    "lizenziert unter",
    "nutzungsbedingungen",
    "datenschutzerklärung",
    "cookies akzeptieren",
    "javascript aktivieren",
    "newsletter abonnieren",
    "tous droits réservés",
    "sous licence",
    "conditions d'utilisation",
    "politique de confidentialité",
    "accepter les cookies",
    "activer javascript",
    "abonnez-vous à notre",
    "todos los derechos reservados",
    "bajo licencia",
    "términos de uso",
    "política de privacidad",
    "aceptar cookies",
    "habilitar javascript",
    "suscríbete a nuestro",
)
#: Symbols, exclamation marks, what parts entries of a menu (with and without a closing quote that is none), links, marks of sentences, a line broken off.
SYMBOLS = r"[#*$%&<>]+"
MARKS = r"[!?]+"
BARS = r"[|\x{2022}\x{203A}\x{00B7}\x{2192}\x{00BB}]+"
BARS_AMONG_QUOTES = r"[|\x{2022}\x{203A}\x{00B7}\x{2192}]+"
LINKS = r"https?://|\]\("
SENTENCE_MARKS = r"[.,;:!?\x{2026}\x{3002}\x{FF01}\x{FF1F}\x{3001}\x{FF0C}]"
BROKEN_OFF = r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"
#: A line without any of these passes all rules that count them.
ANY = r"[#*$%&<>!?|\x{2022}\x{203A}\x{00B7}\x{2192}\x{00BB}\x{2026}/(]|\.\.\."


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; the defaults are those of production."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_symbols_per_word: float = 0.5
    max_marks_per_word: float = 0.5
    max_separators_per_word: float = 0.25
    link_share: float = 0.3
    least_links: int = 2
    teaser_words: int = 12
    bare_words: int = 30
    boilerplate_words: int = 25
    max_loss: float = 0.5


def repeated_words(words: Column, window: int) -> Column:
    """Words that lie in a window-word run found twice or more in the array (first included).

    Runs are compared by 64-bit hash; positions of runs seen again are sorted and
    the union of the intervals they cover is summed.
    """

    def covered(spans: Column) -> Column:
        def again(s: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(spans, j)["h"] == s["h"], F.lit(False))
            return same(i - 1) | same(i + 1)

        starts = F.array_sort(F.transform(F.filter(spans, again), lambda s: s["p"]))
        return let(
            starts,
            lambda q: F.aggregate(
                F.transform(q, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(q, i + 1) - x, F.lit(window)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) <= window, 0).otherwise(
            let(
                hashes,
                lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
                    let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered)
                ),
            )
        )

    return let(words, count).cast("long")


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line that has words fails one of the three rules."""
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))

    def judged(n: Column) -> Column:
        chars = F.length(line)
        symbols = chars - F.length(_without(line, SYMBOLS))
        marks = chars - F.length(_without(line, MARKS))
        bars = chars - F.length(F.when(line.contains("\u00ab"), _without(line, BARS_AMONG_QUOTES)).otherwise(_without(line, BARS)))
        links = F.regexp_count(line, F.lit(LINKS))
        punctuation = (symbols > rules.max_symbols_per_word * n) | ((marks > rules.max_marks_per_word * n) & (n > 3))
        menu = (bars >= 1) & (bars > rules.max_separators_per_word * n)
        listed = (links >= rules.least_links) & (links >= rules.link_share * n)
        teaser = (n <= rules.teaser_words) & line.rlike(BROKEN_OFF)
        marked = F.when(line.rlike(ANY), punctuation | menu | listed | teaser).otherwise(False)
        bare = (n >= rules.bare_words) & ~line.rlike(SENTENCE_MARKS)
        boilerplate = (n <= rules.boilerplate_words) & F.lower(line).rlike("|".join(BOILERPLATE))
        return marked | bare | boilerplate

    return let(words, judged)


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, clean_text, lost_chars, base_failed, kept.

    Columns of docs with these names are replaced.
    """
    body, words, lines, judged = fresh(docs, "body_", "words_", "lines_", "judged_")
    t = F.coalesce(F.col(text), F.lit(""))
    full = docs.withColumn(body, t).withColumn(words, words_of(F.col(body)))
    full = full.withColumn(lines, F.split(F.col(body), "\n"))

    def judge(line: Column) -> Column:
        solid = F.length(_without(line, SPACE))
        return let(solid, lambda n: F.struct(line.alias("line"), n.alias("chars"), ((n > 0) & line_fails(line, rules)).alias("fails")))

    full = full.withColumn(judged, F.transform(F.col(lines), judge))
    lines_with_words = F.transform(F.filter(F.col(judged), lambda x: x["chars"] > 0), lambda x: x["line"])
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["chars"])
    full = (
        full.withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", total(F.col(judged)).cast("long"))
        .withColumn("n_symbols", (F.length(body) - F.length(_without(F.col(body), r"[#*$%&|<>]+"))).cast("long"))
        .withColumn("n_dup_lines", let(lines_with_words, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col(words), rules.window))
        .withColumn("clean_text", F.array_join(F.transform(F.filter(F.col(judged), lambda x: ~x["fails"]), lambda x: x["line"]), "\n"))
        .withColumn("lost_chars", total(F.filter(F.col(judged), lambda x: x["fails"])).cast("long"))
    )
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    full = full.withColumn("base_failed", base)
    full = full.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= rules.max_loss * F.col("word_chars")))
    return full.drop(body, words, lines, judged)


def quality_rules_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, failing lines of the others go; columns stay those of docs.

    Null and empty texts are rejected as too short, whatever their doc_id; repeated rows are
    judged alike; an empty table stays empty.
    """
    names = docs.columns
    (cleaned,) = fresh(docs, "cleaned_")
    # a filter would be pushed below the projection and judge every line twice; a generator judges once
    out = clean_lines(docs.select(*[F.col(c).alias(f"carried{k}_") for k, c in enumerate(names)], F.col("text").alias("text")))
    out = out.select(*[f"carried{k}_" for k in range(len(names))], F.explode(F.when(F.col("kept"), F.array("clean_text"))).alias(cleaned))
    kept = {c: F.col(f"carried{k}_") for k, c in enumerate(names)} | {"text": F.col(cleaned)}
    if "n_chars" in names:
        kept["n_chars"] = F.length(cleaned).cast(docs.schema["n_chars"].dataType)
    return out.select(*[kept[c].alias(c) for c in names])
