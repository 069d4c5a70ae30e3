"""URL verdicts against their SQL, whitening against an eigensolver, spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from palaver.llm.queries import QUERIES, SQL, URL_RULES
from palaver.llm.url_filter import UrlRule, judge_urls
from palaver.llm.variants import SuffixIndex, group_variants, near_in_shard, planted_words
from palaver.llm.whitening import fit_whitening, polar, spectrum, whiten

FOLDER = "/root/testdata/sf0.001"


def _url_rows(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string")


def _duck(df, sql):
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    return con.execute(sql).fetchall()


def _urls(n, seed=3):
    rng = random.Random(seed)
    hosts = ["a.org", "www.b.org", "example.org", "m.example.org", "shop.com", "casino.com", "x.net", "casino-win.net"]
    rows = []
    for i in range(n):
        path = rng.choice(["/en/", "/fr/", "/de/", "/es/"]) + str(rng.randrange(1, 3000))
        rows.append((i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{path}{rng.choice(['', '?a=1', '#top', '.html'])}"))
    return rows


ODD_URLS = [
    (None, None), (1, None), (2, ""), (3, "no scheme.org/x"), (4, "http://"), (5, "http://EXAMPLE.org/es/x?y://z"), (5, "http://EXAMPLE.org/es/x?y://z"),
    (6, "ftp://example.org"), (7, "http://notexample.org/es/1"), (8, "http://sub.example.org/en/19"), (9, "http://org/"), (10, "x://com/de/é✓"),
    (11, "http://a.org?b/c"), (12, "http://a.com/fr/\nnew"), (13, "http://long.net/" + "ab/" * 5000), (14, "http://É.org/X"),
]


@pytest.mark.parametrize("rows", [_urls(400) + [(1000 + (i or 0), u) for i, u in ODD_URLS], ODD_URLS, _urls(5), [], [(1, "http://a.net/"), (1, "http://a.net/")]])
def test_url_verdicts_equal_their_sql(spark, rows):
    df = _url_rows(spark, rows)
    got = judge_urls(df, URL_RULES).select("page_id", "host", "path", "rule", "score", "verdict").collect()
    key = lambda r: tuple((x is None, "" if x is None else x) for x in r)
    want = _duck(df, SQL["op11_url_verdicts"])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len(got) == len(rows)


def test_url_rules_and_columns(spark):
    df = spark.createDataFrame([(1, "http://A.example.org/en/17", "x", "y"), (2, "http://a.org", "x", "y"), (3, "http://a.example.org/en/2", "x", "y")],
                               "page_id bigint, url string, verdict string, extra string")
    got = {r["page_id"]: r for r in judge_urls(df, URL_RULES).collect()}
    assert [got[i]["rule"] for i in (1, 2, 3)] == ["example.org/en/1", None, "org/"]
    assert [got[i]["path"] for i in (1, 2, 3)] == ["/en/17", "", "/en/2"]
    assert got[1]["verdict"] == "block" and got[3]["verdict"] == "allow" and got[1]["extra"] == "y" and got[1]["host"] == "a.example.org"
    assert UrlRule.of("allow org/").text == "org/"


def _model_by_hand(counts, url, order, alpha):
    """Log-likelihood of a URL by the recursion itself, over the strings kept by either class."""
    keep, a_of = counts
    seq = "\x02" * (order + 1) + url + "\x03"
    total = 0.0
    for i in range(order + 1, len(seq)):
        p = None
        for k in range(0, order + 1):
            ctx, sym = seq[i - k:i], seq[i]
            if k and ctx not in keep:
                break
            n = a_of.get(ctx + sym, 0) if ctx + sym in keep else 0
            base = a_of[""] if not ctx else a_of.get(ctx, 0)
            p = (n + alpha * (1 / 256 if p is None else p)) / (base + alpha)
        total += math.log(p)
    return total


def test_url_scores_equal_the_models_by_hand(spark):
    from palaver.llm import url_filter as u
    rows = _urls(300, seed=9)
    got = {r["url"]: r for r in judge_urls(_url_rows(spark, rows), URL_RULES).collect()}
    import hashlib
    counts = {"allow": Counter(), "block": Counter()}
    for url, row in got.items():
        times = sum(x[1] == url for x in rows)
        if row["rule"] and hashlib.md5(url.encode()).hexdigest()[0] not in "0123":
            seq = "\x02" * (u.ORDER + 1) + url.split("://", 1)[1].lower() + "\x03"
            for i in range(u.ORDER, len(seq)):
                counts[row["verdict"]][""] += times
                for k in range(1, u.ORDER + 2):
                    counts[row["verdict"]][seq[i - k + 1:i + 1]] += times
    keep = {g for c in counts.values() for g in c if g and c[g] * u.SHARE >= c[""]}
    for url in list(got)[:60]:
        text = url.split("://", 1)[1].lower()
        difference = (_model_by_hand((keep, counts["allow"]), text, u.ORDER, u.ALPHA)
                      - _model_by_hand((keep, counts["block"]), text, u.ORDER, u.ALPHA)) / (len(text) + 2)
        assert abs(difference - got[url]["score"]) < 1e-5


def test_url_models_part_unlike_hosts(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice(['library', 'museum', 'school'])}{rng.randrange(50)}.org/en/{rng.randrange(9)}9") for i in range(300)]
    rows += [(1000 + i, f"http://{rng.choice(['casino', 'poker', 'betting'])}{rng.randrange(50)}.com/de/{rng.randrange(99)}") for i in range(300)]
    rows += [(2000, "http://museum77.net/en/29"), (2001, "http://poker77.net/de/31")]
    got = {r["page_id"]: r for r in judge_urls(_url_rows(spark, rows), URL_RULES).collect()}
    assert (got[2000]["rule"], got[2000]["verdict"], got[2001]["rule"], got[2001]["verdict"]) == (None, "allow", None, "block")


# --- whitening ---------------------------------------------------------------------------------------------------


def test_polar_and_spectrum_on_hard_matrices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 33, 64):
        for values in (rng.uniform(0.1, 5, n), np.logspace(0, -12, n), np.repeat([3.0, 1.0], n)[:n], np.zeros(n), np.ones(n), np.r_[1e6, np.full(n - 1, 1e-3)]):
            q = np.linalg.qr(rng.standard_normal((n, n)))[0]
            a = q @ np.diag(values) @ q.T
            a = (a + a.T) / 2
            e, v = spectrum(a)
            scale = max(np.abs(values).max(), 1e-300)
            assert np.abs(np.sort(values)[::-1] - e).max() <= 1e-13 * scale * n
            assert np.abs(v.T @ v - np.eye(n)).max() < 1e-13 * n
            assert np.abs(a @ v - v * e).max() <= 1e-13 * scale * n
    a = np.diag([2.0, -3.0, 0.5])
    assert np.abs(polar(a) - np.diag([1, -1, 1])).max() < 1e-14


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_whitening_equals_an_eigensolver(spark):
    rng = np.random.default_rng(5)
    data = (rng.standard_normal((500, 40)) @ rng.standard_normal((40, 40)) * 0.1 + 3).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(data)]
    rows += [(1000, None, 1), (1001, [None] * 40, 1), (1002, [float("nan")] * 40, 1), (1003, [float("inf")] + [0.0] * 39, 1), (1004, [], 0), (1005, [1.0], 0)]
    df = _vectors(spark, rows)
    got = whiten(df, fit_whitening(df)).toPandas()
    x = np.floor(data.astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    d = (n * x - s) / n
    v = d.T @ d / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:32], q[:, ::-1][:, :32]
    assert len(got) == 500 * 32 and set(got["n"]) == {500} and set(got["vec_id"]) == set(range(500))
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = d @ q / np.sqrt(e)
    sign = np.sign((table * want).sum(axis=0))
    assert np.abs(table - want * sign).max() < 1e-8
    dev = got.drop_duplicates("vec_id").set_index("vec_id")["deviation"].sort_index().tolist()
    assert dev == [sum(int(t) ** 2 for t in row) for row in (n * x - s)]
    share = got.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.abs(share / (e / np.trace(v)) - 1).max() < 1e-10
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10


def test_whitening_odd_tables(spark):
    assert whiten(_vectors(spark, []), fit_whitening(_vectors(spark, []))).collect() == []
    only_bad = _vectors(spark, [(1, None, 1), (2, [float("nan")], 1), (None, [], 1)])
    assert whiten(only_bad, fit_whitening(only_bad)).collect() == []
    same = _vectors(spark, [(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (None, [0.5, 0.25], None)])
    rows = whiten(same, fit_whitening(same)).collect()
    assert len(rows) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 3 for r in rows)
    flat = _vectors(spark, [(i, [float(i), float(i), 1.0], 1) for i in range(4)])  # rank one
    rows = whiten(flat, fit_whitening(flat)).collect()
    assert len(rows) == 12 and all((r["whitened"] is None) == (r["component"] > 1) for r in rows)
    assert max(abs(r["identity_error"]) for r in rows) < 1e-12
    extra = spark.createDataFrame([("a", [1.0, 2.0], 5, "z"), ("b", [2.0, 1.0], 5, "z")], "vec_id string, embedding array<double>, n int, vector string")
    assert [r["vec_id"] for r in whiten(extra, fit_whitening(extra)).where("component = 1").orderBy("vec_id").collect()] == ["a", "b"]
    far = _vectors(spark, [(1, [3e38], 1), (2, [-3e38], 1)])
    rows = whiten(far, fit_whitening(far)).collect()
    assert len(rows) == 2


# --- spelling variants -------------------------------------------------------------------------------------------


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def _brute(counts):
    out = {}
    near = {w: [u for u in counts if _one_edit(w, u)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda u: (-counts[u], u.encode("utf-32-be")), default=None)
        out[w] = (best if best and counts[best] >= 2 * n else None, n, len(near[w]))
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, counts[form] if form else None))
    return rows


def _random_words(seed, size, letters="abé", least=5, most=8):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))): rng.randint(3, 40) for _ in range(size)}


@pytest.mark.parametrize("shard", [1 << 18, 2000, 64])
def test_variants_equal_brute_force(spark, shard):
    counts = _random_words(1, 300) | _random_words(2, 80, "abcdefgh", 2, 12) | {"a" * 700: 9, "a" * 701: 30, "a" * 300 + "b" + "a" * 400: 3, "xy": 4, "y": 8}
    counts |= {"prefix" + w: n for w, n in _random_words(3, 120, "ab", 5, 7).items()}  # a half that many words share
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {tuple(r) for r in group_variants(df, shard).collect()}
    counts_long = {w: n for w, n in counts.items() if len(w) > 1}
    want = _brute(counts_long) | {("y", None, "y", 8, 0, None)}
    assert got == want


def test_variants_odd_tables(spark):
    df = spark.createDataFrame([("hello", 3, 1), ("hello", 4, 2), (None, 9, 3), ("hallo", 14, 4), ("", 5, 5)], "word string, n bigint, form int")
    got = {tuple(r) for r in group_variants(df).collect()}
    assert got == {("hello", "hallo", "hallo", 7, 1, 14), ("hallo", None, "hallo", 14, 1, None), ("", None, "", 5, 0, None)}
    assert group_variants(df.limit(0)).collect() == []


def test_suffix_order_and_counts():
    words = sorted(_random_words(7, 60, "abc", 1, 9))
    index = SuffixIndex(words, ["a", "b", "c"])
    text = "\0".join(words) + "\0"
    order = sorted(range(len(text)), key=lambda i: (text[i:text.index("\0", i) + 1], i))
    assert [" abc"[c] for c in index.bwt[:len(text)]] == [(text[i - 1] if text[i - 1] != "\0" else " ") for i in order]
    place = np.arange(len(text) + 1)
    full = index.counts(place)
    for s in range(4):
        want = np.concatenate([[0], np.cumsum(index.bwt[:len(text)] == s)])
        assert (full[:, s] == want).all() and (index.count(np.full(len(place), s), place) == want).all()


def test_either_half_is_searched():
    words = ["house", "horse", "mouse", "hose", "housed", "nouse"]
    front = {(a, b) for a, b, _ in ((["house"][s], words[w], o) for s, w, o in near_in_shard(words, ["house"], True))}
    back = {(a, b) for a, b, _ in ((["house"][s], words[w], o) for s, w, o in near_in_shard(words, ["house"], False))}
    assert {b for _, b in front} == {"horse", "hose"} and {b for _, b in back} == {"mouse", "nouse"}


def test_planted_words_by_hand(spark):
    rng = random.Random(2)
    base = ["Straße", "naïve", "HELLO", "word", "Élan", "école", "x" * 3000, "co×op÷x"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(30)) + rng.choice(["", "123abcde-fghij", "Ωmegaaa"])) for i in range(400)]
    rows += [(1, None), (None, "hello hello hello"), (2, "")]
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    want = {(w, n) for w, n in counts.items() if len(w) >= 5 and n >= 3}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in planted_words(df).collect()} == want


def test_variant_query_equals_brute_force_on_the_small_table(spark):
    counts = {r["word"]: r["n"] for r in planted_words(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    by_cut: dict = {}
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_cut.setdefault(key, []).append(w)
    near = {w: set() for w in counts}
    for group in by_cut.values():
        for a in group:
            near[a] |= {b for b in group if _one_edit(a, b)}
    got = {r["word"]: r for r in QUERIES["op13_spelling_variants"](spark, FOLDER).collect()}
    assert set(got) == set(counts)
    for w, row in got.items():
        best = min(near[w], key=lambda u: (-counts[u], u), default=None)
        form = best if best and counts[best] >= 2 * counts[w] else None
        assert (row["n"], row["n_near"], row["form"], row["form_n"]) == (counts[w], len(near[w]), form, counts[form] if form else None)
        assert row["root"] == (got[form]["root"] if form else w)
