"""URL verdicts: host and path rules, and for the rest a ratio of two character models, all in Spark expressions.

Accepted and rejected URLs (those a rule names) train one variable-order Markov model each. A context is
kept where its symbols make up at least 1 / ``SHARE`` of all symbols of a class, so both models together hold at most
``2 * (ORDER + 1) * SHARE`` strings, however large the corpus is; counts cover all URLs. The probability of
a symbol mixes the counts of every context it has, longest last: p_k = (n(ctx c) + ALPHA p_(k-1)) / (n(ctx) + ALPHA).

The log-likelihood difference of a URL is a sum over its symbols of one number that belongs to the longest
kept string ending there: D (the difference there), minus what the contexts of that string would have cost on the way
down, plus what the contexts that follow will cost. So scoring takes one lookup per symbol and no state.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palaver.session import durable

#: The longest context, the least share (1 / SHARE) of a kept string, and the weight of the shorter context.
ORDER = 5
SHARE = 1 << 15
ALPHA = 4
#: Differences are kept as whole millionths, thresholds as hundredths, at most 10 either way.
SCALE, STEP, FAR = 1_000_000, 10_000, 1000
_START, _END = "\x02", "\x03"
_WIDTH = ORDER + 1
#: URLs whose md5 starts with one of these calibrate the threshold; the others are counted.
_CALIBRATE = "0123"


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @classmethod
    def of(cls, text: str) -> UrlRule:
        """From a line such as ``block example.org/es/``."""
        verdict, place = text.split(" ", 1)
        host, _, path = place.partition("/")
        return cls(verdict, host.lower(), f"/{path}")

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased in A-Z; both empty for null and where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, null where none does; of equally long ones a blocking one."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def _windows(urls: DataFrame) -> DataFrame:
    """One row per symbol of a URL, the start and the end included: the last ``ORDER`` + 1 symbols up to it."""
    at = F.instr("url", "://")
    body = F.translate(F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise(F.col("url")), ascii_uppercase, ascii_lowercase)
    letters = F.filter(F.split(body, ""), lambda c: c != "")
    symbols = F.concat(F.array_repeat(F.lit(_START), _WIDTH), letters, F.array(F.lit(_END)))
    rows = urls.withColumn("symbols", symbols)
    spans = F.transform(F.sequence(F.lit(_WIDTH), F.size("symbols")),
                        lambda i: F.array_join(F.slice("symbols", i - ORDER, _WIDTH), ""))
    return rows.withColumn("window", F.explode(spans)).drop("symbols")


def _weights() -> str:
    """The number that belongs to a string, as SQL over a1, r1, ca1, cr1 .. of its endings; both engines read it."""
    after = f"cast({ALPHA} as double)"
    level = {side: f"({side}1 + {after} / 256) / (c{side}1 + {after})" for side in "ar"}
    cases = [f"ln({level['a']}) - ln({level['r']})"]
    for k in range(2, _WIDTH + 1):
        level = {side: f"({side}{k} + {after} * ({level[side]})) / (c{side}{k} + {after})" for side in "ar"}
        cases.append(f"ln({level['a']}) - ln({level['r']})")
    # the start is given, not predicted
    here = "CASE WHEN opening THEN cast(0 as double) " + " ".join(f"WHEN len = {k} THEN {c}" for k, c in enumerate(cases, 1)) + " END"
    down = " + ".join(["cast(0 as double)"] + [f"coalesce(ln(cr{k} + {after}) - ln(ca{k} + {after}), 0)" for k in range(2, _WIDTH + 1)])
    on = " + ".join(f"CASE WHEN len < {k} OR closing THEN cast(0 as double) ELSE ln(r{k} + {after}) - ln(a{k} + {after}) END" for k in range(1, ORDER + 1))
    return f"cast(floor(({here} - CASE WHEN opening THEN cast(0 as double) ELSE {down} END + ({on})) * {SCALE} + cast(0.5 as double)) as bigint)"


def _fit(urls: DataFrame) -> DataFrame:
    """gram -> v of every kept string, and the empty string for a symbol never seen.

    ``urls``: url, times, good (true: accepted, false: rejected).
    """
    counted = _windows(urls).groupBy("window").agg(
        F.sum(F.when(F.col("good"), F.col("times")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("good"), F.col("times")).otherwise(0)).alias("r"))
    endings = F.transform(F.sequence(F.lit(1), F.lit(_WIDTH)), lambda k: F.struct(k.alias("len"), F.right("window", k).alias("gram")))
    grams = durable(counted.select("a", "r", F.inline(endings)).groupBy("gram", "len").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    total = grams.where("len = 1").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("na"), F.coalesce(F.sum("r"), F.lit(0)).alias("nr")).first()
    na, nr = int(total["na"]), int(total["nr"])
    kept = grams.where((F.col("a") > 0) & (F.col("a") * SHARE >= na) | (F.col("r") > 0) & (F.col("r") * SHARE >= nr))
    before = kept.select(F.col("gram").alias("prefix"), F.col("a").alias("ca"), F.col("r").alias("cr"))
    based = (kept.withColumn("prefix", F.expr("left(gram, len - 1)")).join(before, "prefix", "left")
             .withColumns({"ca": F.coalesce("ca", F.lit(na)), "cr": F.coalesce("cr", F.lit(nr))}).drop("prefix"))
    ends = based.select(F.col("gram").alias("ending"), F.col("len").alias("k"), "a", "r", "ca", "cr")
    each = kept.select("gram", "len", F.explode(F.transform(F.sequence(F.lit(1), F.col("len")), lambda k: F.right("gram", k))).alias("ending"))
    wide = each.join(ends, "ending").groupBy("gram", "len").agg(
        *[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, _WIDTH + 1) for c in ("a", "r", "ca", "cr")])
    wide = wide.withColumns({"opening": F.expr(f"gram = repeat('{_START}', len)"), "closing": F.endswith("gram", F.lit(_END))})
    unseen = F.expr(f"cast(floor((ln({nr} + cast({ALPHA} as double)) - ln({na} + cast({ALPHA} as double))) * {SCALE} + cast(0.5 as double)) as bigint)")
    return durable(wide.select("gram", F.expr(_weights()).alias("v")).unionByName(
        urls.sparkSession.range(1).select(F.lit("").alias("gram"), unseen.alias("v"))))


def _score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """Per URL: symbols and total, the difference of the log-likelihoods in millionths."""
    rows = _windows(urls.select("url"))
    found = []
    for k in range(_WIDTH, -1, -1):  # at most 2 * (ORDER + 1) * SHARE + 1 strings
        part = model.select(F.col("gram").alias(f"gram{k}"), F.col("v").alias(f"v{k}")).where(F.length(f"gram{k}") == k)
        rows = rows.join(F.broadcast(part), F.right("window", F.lit(k)) == F.col(f"gram{k}"), "left") if k else rows
        found.append(F.col(f"v{k}"))
    unseen = model.where("gram = ''").first()["v"]
    return rows.groupBy("url").agg(F.count("*").alias("symbols"), F.sum(F.coalesce(*found[:-1], F.lit(unseen))).alias("total"))


def _bin() -> Column:
    return F.expr(f"cast(least(greatest(floor(total / (symbols * cast({STEP} as double))), -{FAR}), {FAR}) as int)")


def _threshold(scored: DataFrame) -> int:
    """The bin that best parts accepted from rejected URLs, both classes weighing the same; 0 without either.

    ``scored``: total, symbols, times, good. Of equally good places the lowest; between two bins the middle.
    """
    bins = scored.groupBy(_bin().alias("bin")).agg(
        F.sum(F.when(F.col("good"), F.col("times")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("good"), F.col("times")).otherwise(0)).alias("r"))
    ends = bins.agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.max("bin").alias("top")).first()
    if not ends["a"] or not ends["r"]:
        return 0
    above = bins.sparkSession.range(1).select((F.lit(ends["top"]) + 1).alias("bin"), F.lit(0).alias("a"), F.lit(0).alias("r"))
    order = Window.orderBy("bin")  # at most 2 * FAR + 2 rows
    gain = (F.coalesce(F.sum("r").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)") * F.lit(ends["a"])
            - F.coalesce(F.sum("a").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)") * F.lit(ends["r"]))
    places = bins.unionByName(above).select("bin", gain.alias("gain"), F.coalesce(F.lag("bin").over(order), F.col("bin")).alias("last"))
    best = places.orderBy(F.desc("gain"), "bin").first()
    return (best["bin"] + best["last"]) // 2


def judge_urls(pages: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """The pages with host, path, rule, score (difference of log-likelihoods a symbol) and verdict (allow or block).

    A rule decides where one fits; elsewhere the models do: allow from the calibrated threshold on. Every distinct URL is
    scored once. A null URL counts as the empty one, which has a start and an end; equal URLs get equal verdicts;
    repeated rows all stay and weigh in the counts; an empty table gives no rows. Without URLs of both kinds the threshold is 0,
    and without any labelled URL every score is 0. Very long URLs are rows of symbols like all others. Columns of the added
    names, ``url_key`` and ``times`` give way.
    """
    added = ("host", "path", "rule", "score", "verdict", "url_key", "times")
    pages = pages.drop(*added).withColumn("url_key", F.coalesce("url", F.lit("")))
    urls = pages.groupBy("url_key").agg(F.count("*").alias("times")).withColumnRenamed("url_key", "url")
    host, path = split_url(F.col("url"))
    urls = urls.withColumns({"host": host, "path": path})
    rule, ruled = match_rule(F.col("host"), F.col("path"), rules)
    urls = durable(urls.withColumns({"rule": rule, "ruled": ruled}))
    named = urls.where("ruled is not null").withColumn("good", F.col("ruled") == "allow")
    apart = F.substring(F.md5("url"), 1, 1).isin(*_CALIBRATE)
    model = _fit(named.where(~apart))
    held = named.where(apart)
    threshold = _threshold(_score(held, model).join(held.select("url", "times", "good"), "url"))
    scored = urls.select("url", "host", "path", "rule", "ruled").join(_score(urls, model), "url")
    scored = scored.select(F.col("url").alias("url_key"), "host", "path", "rule",
                           (F.col("total") / (F.col("symbols") * F.lit(float(SCALE)))).alias("score"),
                           F.coalesce("ruled", F.when(_bin() >= threshold, "allow").otherwise("block")).alias("verdict"))
    return pages.join(scored, "url_key").drop("url_key")


def urls_sql(rules: list[UrlRule]) -> str:
    """The same verdicts for DuckDB."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN " for r in ordered]
    text = "CASE " + " ".join(f"{f}'{r.text}'" for f, r in zip(fits, ordered)) + " END"
    verdict = "CASE " + " ".join(f"{f}'{r.verdict}'" for f, r in zip(fits, ordered)) + " END"
    pad, width = f"repeat(chr(2), {_WIDTH})", _WIDTH
    lower = f"translate({{}}, '{ascii_uppercase}', '{ascii_lowercase}')"
    columns = ", ".join(f"max(CASE WHEN k = {k} THEN e.{c} END) AS {c}{k}" for k in range(1, width + 1) for c in ("a", "r", "ca", "cr"))
    alpha = f"cast({ALPHA} as double)"
    return f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS sep FROM pages),
u AS (SELECT url, count(*) AS times, CASE WHEN any_value(sep) > 0 THEN substr(url, any_value(sep) + 3) ELSE '' END AS rest,
  {lower.format("CASE WHEN any_value(sep) > 0 THEN substr(url, any_value(sep) + 3) ELSE url END")} AS body FROM p GROUP BY url),
h AS (SELECT *, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS MATERIALIZED (SELECT *, {text} AS rule, {verdict} AS ruled, left(md5(url), 1) IN ('0', '1', '2', '3') AS apart FROM h),
w AS MATERIALIZED (SELECT url, times, ruled, apart, substr({pad} || body || chr(3), i, {width}) AS win
  FROM (SELECT *, unnest(range(1, length(body) + 3)) AS i FROM l)),
c AS (SELECT win, sum(CASE WHEN ruled = 'allow' THEN times ELSE 0 END) AS a, sum(CASE WHEN ruled <> 'allow' THEN times ELSE 0 END) AS r
  FROM w WHERE ruled IS NOT NULL AND NOT apart GROUP BY win),
g AS MATERIALIZED (SELECT right(win, k) AS gram, k AS len, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(r) AS DOUBLE) AS r
  FROM c, range(1, {width + 1}) t(k) GROUP BY ALL),
n AS (SELECT coalesce(sum(a), 0) AS na, coalesce(sum(r), 0) AS nr FROM g WHERE len = 1),
k AS MATERIALIZED (SELECT g.* FROM g, n WHERE a > 0 AND a * {SHARE} >= na OR r > 0 AND r * {SHARE} >= nr),
b AS (SELECT x.gram, x.len AS k, x.a, x.r, coalesce(y.a, na) AS ca, coalesce(y.r, nr) AS cr
  FROM k x LEFT JOIN k y ON y.gram = left(x.gram, x.len - 1) AND x.len > 1, n),
s AS (SELECT x.gram, x.len, x.gram = repeat(chr(2), CAST(x.len AS INT)) AS opening, ends_with(x.gram, chr(3)) AS closing, {columns}
  FROM (SELECT gram, len, unnest(range(1, len + 1)) AS j FROM k) x JOIN b e ON e.gram = right(x.gram, x.j) GROUP BY x.gram, x.len),
m AS MATERIALIZED (SELECT gram, len, {_weights()} AS v FROM s),
o AS (SELECT cast(floor((ln(nr + {alpha}) - ln(na + {alpha})) * {SCALE} + cast(0.5 as double)) as bigint) AS v FROM n),
d AS (SELECT win, arg_max(m.v, m.len) AS v FROM (SELECT DISTINCT win FROM w) q, range(1, {width + 1}) t(j)
  JOIN m ON m.gram = right(win, j) GROUP BY win),
z AS MATERIALIZED (SELECT url, count(*) AS symbols, CAST(sum(coalesce(d.v, o.v)) AS BIGINT) AS total FROM w LEFT JOIN d USING (win), o GROUP BY url),
y AS MATERIALIZED (SELECT l.*, total / (symbols * cast({SCALE} as double)) AS score,
  cast(least(greatest(floor(total / (symbols * cast({STEP} as double))), -{FAR}), {FAR}) as int) AS bin FROM l JOIN z USING (url)),
i AS (SELECT bin, sum(CASE WHEN ruled = 'allow' THEN times ELSE 0 END) AS a, sum(CASE WHEN ruled <> 'allow' THEN times ELSE 0 END) AS r
  FROM y WHERE ruled IS NOT NULL AND apart GROUP BY bin),
e AS (SELECT sum(a) AS ta, sum(r) AS tr, max(bin) AS top FROM i),
x AS (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin), bin) AS last,
  coalesce(sum(r) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * ta
  - coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * tr AS gain
  FROM (SELECT * FROM i UNION ALL SELECT top + 1, 0, 0 FROM e), e),
t AS (SELECT CASE WHEN coalesce(ta, 0) = 0 OR coalesce(tr, 0) = 0 THEN 0
  ELSE (SELECT floor((bin + last) / 2.0) FROM x ORDER BY gain DESC, bin LIMIT 1) END AS bar FROM e)
SELECT page_id, host, path, rule, score, coalesce(ruled, CASE WHEN bin >= bar THEN 'allow' ELSE 'block' END) AS verdict
FROM p JOIN y USING (url), t"""
