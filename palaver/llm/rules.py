"""Quality rules: a table of thresholds compiled into Spark projections, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed characters: white space, and what counts as a symbol.
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent short words of languages in Latin script, in lower case.
STOP_WORDS_BY_LANGUAGE = {
    "English": "a and for in is it of that the to with",
    "French": "de des du et la le les que un une",
    "German": "das der die ein mit und von zu",
    "Spanish": "el en los por que se y",
    "Italian": "che di il non per sono",
    "Portuguese": "com do da em não os para uma",
    "Dutch": "dat een het niet van voor",
    "Swedish, Danish and Norwegian": "att av det en er ett och og på som till til är",
    "Finnish": "ei ja joka on oli se",
    "Polish": "i jest na nie się w z że",
    "Czech and Slovak": "a je na se že ve si som",
    "Croatian, Serbian and Slovene": "i je na se u za da so",
    "Romanian": "cu este în pe și nu să",
    "Hungarian": "a az egy és hogy nem",
    "Turkish": "bir bu da de için ile ve",
    "Indonesian and Malay": "dan dengan di ini itu yang",
    "Vietnamese": "các có của cho không là một và",
    "Swahili": "kwa na ni wa ya za",
    "Catalan": "amb els és i per una",
}
STOP_WORDS = tuple(sorted({w for words in STOP_WORDS_BY_LANGUAGE.values() for w in words.split()}))
#: Fixed characters that may stand at either end of a word.
PUNCTUATION = ".,;:!?\"()[]{}<>*_-–—…«»“”„‘’¿¡"
#: A text in Latin script has fewer UTF-8 bytes than this for each 100 characters; in others most letters have two or three.
LATIN_BYTES = 150


@dataclass(frozen=True)
class Rule:
    """A text fails if ``measure`` times 100 is over ``most`` or under ``least`` times ``per``; sizes compare as they are."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


#: The base rules come first; the others make the verdict.
BASE_RULES = (Rule("few_words", "n_words", least=20), Rule("repeated_words", "n_repeat_words", "n_words", most=30))
RULES = (
    Rule("short_words", "word_chars", "n_words", least=180),
    Rule("long_words", "word_chars", "n_words", most=1800),
    Rule("symbols", "n_symbols", "n_words", most=30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
    Rule("stop_words", "n_stop_words", "n_latin_words", least=2),
)


def _fails(rule: Rule) -> Column:
    value = F.col(rule.measure)
    scale, base = (100, F.col(rule.per)) if rule.per else (1, F.lit(1))
    tests = []
    if rule.least is not None:
        tests.append(value * scale < F.lit(rule.least) * base)
    if rule.most is not None:
        tests.append(value * scale > F.lit(rule.most) * base)
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def _covered(positions: Column, width: int) -> Column:
    """How many of the numbers lie in [p, p + width) for some p of a rising array."""
    ends = F.transform(positions, lambda p, i: F.least(
        F.lit(width), F.when(i + 1 < F.size(positions), F.element_at(positions, (i + 2).cast("int")) - p).otherwise(F.lit(width))))
    return F.aggregate(ends, F.lit(0).cast("long"), lambda s, e: s + e)


def measure(documents: DataFrame, width: int = 8) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_latin_words and n_repeat_words.

    Stop words are compared in lower case and without punctuation at their ends. n_latin_words is n_words if the text is in
    Latin script, else 0: the list says nothing about other scripts, so the stop-word rule leaves their texts alone. A null text has no words and no lines. Windows are compared by 64-bit hashes inside a text; the sort by hash
    runs only for texts where a window occurs twice. Columns of these names give way.
    """
    own = ("_t", "_w", "_lines", "_h", "_grams", "_again", "_at")
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.translate(text, WHITE, " " * len(WHITE))
    words = F.filter(F.split(blank, " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    df = documents.drop(*own).withColumns({"_w": words, "_lines": lines})
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_w", lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION)).isin(*STOP_WORDS))).cast("long"),
        "n_latin_words": F.when(F.octet_length(text) * 100 < F.length(text) * LATIN_BYTES, F.size("_w")).otherwise(0).cast("long"),
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
    })
    last = F.size("_h") - width + 1
    gram = F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice("_h", i, width))))
    df = df.withColumn("_grams", F.coalesce(gram, F.array().cast("array<bigint>")))
    df = df.withColumn("_again", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    ranked = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("_at", F.when(F.col("_again"), ranked))
    same = F.filter(F.col("_at"), lambda x, i: (
        (i > 0) & (F.get("_at", i - 1)["g"] == x["g"])) | F.coalesce(F.get("_at", i + 1)["g"] == x["g"], F.lit(False)))
    df = df.withColumn("_at", F.array_sort(F.transform(same, lambda x: x["i"])))
    df = df.withColumn("n_repeat_words", F.when(F.col("_again"), _covered(F.col("_at"), width)).otherwise(F.lit(0).cast("long")))
    return df.drop(*own)


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures with ``base_failed``, ``kept`` and the names of the ``failed_rules``."""
    df = measure(documents)
    base = F.greatest(*[_fails(r) for r in BASE_RULES])
    named = F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in (*BASE_RULES, *rules)]))
    return df.withColumns({"base_failed": base, "failed_rules": named}).withColumn("kept", F.size("failed_rules") == 0)


#: The same measures for DuckDB; the verdict is made from the same table.
def rules_sql() -> str:
    def fails(rule: Rule) -> str:
        scale, base = ("100 * ", rule.per) if rule.per else ("", "1")
        parts = ([f"{scale}{rule.measure} < {rule.least} * {base}"] if rule.least is not None else []) + (
            [f"{scale}{rule.measure} > {rule.most} * {base}"] if rule.most is not None else [])
        return "(" + " OR ".join(parts) + ")"

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    white = r"[ \t\n\x0B\f\r]+"
    return rf"""WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{white}'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{white}', '', 'g') <> '') AS lines FROM t),
g AS (SELECT row_id, unnest(list_transform(range(1, len(words) - 6), lambda i: {{'i': i, 'g': md5(array_to_string(words[i:i+7], ' '))}}), recursive := true)
  FROM w WHERE len(words) >= 8),
k AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM g),
c AS (SELECT row_id, least(8, coalesce(lead(i) OVER (PARTITION BY row_id ORDER BY i) - i, 8)) AS part FROM k WHERE n > 1),
r AS (SELECT row_id, CAST(sum(part) AS BIGINT) AS n_repeat_words FROM c GROUP BY row_id),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{white}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(list_filter(words, lambda x: trim(lower(x), '{PUNCTUATION}') IN ({stop}))) AS n_stop_words,
  CASE WHEN strlen(text) * 100 < length(text) * {LATIN_BYTES} THEN len(words) ELSE 0 END AS n_latin_words, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (row_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {' OR '.join(map(fails, BASE_RULES))} AS base_failed,
  NOT ({' OR '.join(map(fails, (*BASE_RULES, *RULES)))}) AS kept FROM m"""
