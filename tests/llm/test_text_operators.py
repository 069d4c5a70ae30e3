"""The text operators on odd rows, and against the libraries and plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from palaver.llm import counts, language, mixing, near_text, near_vectors, pieces, privacy, quality, rules, toxicity
from palaver.llm.components import connected_components
from palaver.llm.planted import plant
from palaver.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string"
ODD = [(1, "the cat sat on the mat with a hat", "en", "a", 33, "x", "y"), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "x", None),
       (4, "the cat sat on the mat with a hat", "en", "b", 33, "x", "y"), (4, "the cat sat on the mat with a hat", "en", "b", 33, "x", "y"),
       (None, "no id here", "en", None, 10, "x", "y"), (5, "w " * 30000, "en", "a", 60000, "x", "y"), (6, " \n\t ", "fr", "c", 4, None, None),
       (7, "日本語 😀 <|endoftext|>  a\n b", "ja", "c", 24, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, 1), (4, 0, 1), (5, 0, 0), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")


def _empty(df):
    return df.limit(0)


def test_quality_and_toxicity_keep_every_row(odd, labels):
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        for docs, marks in ((odd, labels), (odd, _empty(labels)), (_empty(odd), labels)):
            rows = score(docs, fit(docs, marks)).collect()
            assert len(rows) == docs.count()
            assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)


def test_block_max_search_equals_a_full_scan():
    import numpy as np
    rng = np.random.default_rng(3)
    index = toxicity.BlockMaxIndex(np.arange(20, dtype=np.uint64), [str(i) for i in range(20)], rng.random(20) + 1, np.zeros(500), np.arange(500))
    rows = [np.sort(rng.choice(20, rng.integers(1, 6), replace=False)) for _ in range(500)]
    weights = [index.vector(r, rng.integers(1, 5, len(r)).astype(float)) for r in rows]
    index.build(rows, weights)
    dense = np.zeros((500, 20))
    for i, (r, w) in enumerate(zip(rows, weights)):
        dense[i, r] = w
    for _ in range(30):
        term = np.sort(rng.choice(20, 3, replace=False))
        weight = index.vector(term, np.ones(3))
        cosine = np.round(dense[:, term] @ weight, 12)
        want = sorted(((-c, i) for i, c in enumerate(cosine) if c > 0))[:7]
        got = index.search(term, weight, 7)
        assert [round(c, 9) for c, _ in got] == [round(-c, 9) for c, _ in want]


def test_toxicity_is_searched_over_all_words(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    # Toxic texts have nothing in common, so no word is marked; then a toxic word that is always behind the same one.
    rows = [(i, " ".join(rng.choices(vocabulary, k=40)), int(i % 9 == 0)) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    index = toxicity.fit_toxicity(docs, labels, modulus=1, rest=1)
    assert not index.names and len(index.labels) == 300
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, index).collect()}
    assert all(got[i]["predicted"] == toxic and got[i]["evidence"].startswith(f"; {i}:1.000") for i, _, toxic in rows)
    fixed = [(i, t + (" ".join(["", "you", "scumbag", rng.choice(vocabulary)]) if y else ""), y) for i, t, y in rows]
    docs = spark.createDataFrame(fixed, "doc_id bigint, text string, toxic int")
    index = toxicity.fit_toxicity(docs, labels, modulus=1, rest=1)
    assert "scumbag" in index.names
    new = spark.createDataFrame([(1, " ".join(rng.choices(vocabulary, k=40)) + " you scumbag"), (2, " ".join(rng.choices(vocabulary, k=40)))], "doc_id bigint, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(new, index).collect()} == {1: 1, 2: 0}


def test_language_field(spark, odd):
    en, fr = "the cat and the dog of this house with that man", "le chat et les chiens dans une maison avec des hommes"
    rows = [(i, " ".join(random.Random(i).choices((en if i % 2 else fr).split(), k=20)), "en" if i % 2 else "fr") for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit_language(train)
    got = {r["doc_id"]: r["lang_pred"] for r in language.detect_language(train, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 195
    mixed = language.detect_language(odd, model).collect()
    assert {r["lang_pred"] for r in mixed if not (r["text"] or "").strip()} == {"und"} and len(mixed) == len(ODD)
    assert {r["lang_pred"] for r in language.detect_language(odd, language.fit_language(_empty(train))).collect()} == {"und"}


def test_language_learns_all_languages_and_labels_words(spark):
    names = [f"l{i:02d}" for i in range(70)]
    rows = [(i * 3 + j, " ".join(random.Random(i).choices([chr(0x4E00 + 40 * i + k) * 3 for k in range(30)], k=20)), name)
            for i, name in enumerate(names) for j in range(3)]
    long = "zebra quagga okapi " * 2500
    rows.append((9000, long, "zz"))
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit_language(train, modulus=1, rest=1)
    assert model.languages == [*names, "zz"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.detect_language(train, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 0.95 * len(rows) and got[9000] == "zz"
    en, fr = "the cat and the dog of this house with that man", "le chat et les chiens dans une maison avec des hommes"
    train = spark.createDataFrame([(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(60)], "doc_id bigint, text string, lang string")
    mixed = spark.createDataFrame([(1, f"İé {en}. {fr}"), (2, None), (3, fr)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in language.detect_language(mixed, language.fit_language(train), spans=True).collect()}
    last = found[1]["lang_spans"][-1]
    assert found[1]["text"][last["start"]:last["end"]] == fr and last["lang"] == "fr" and 0.5 < last["posterior"] <= 1
    assert found[1]["lang_spans"][-2]["lang"] == "en" and found[2]["lang_spans"] == [] and [s["lang"] for s in found[3]["lang_spans"]] == ["fr"]


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np
    rng = np.random.default_rng(1)
    score, step, count = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([4, 0, 3])
    got, moves = language.forward_backward(score, step, count)
    want, expected = np.zeros((7, 3)), np.zeros((3, 3))
    for start, size in ((0, 4), (4, 3)):
        paths = list(itertools.product(range(3), repeat=size))
        weight = np.exp([sum(score[start + t, p[t]] for t in range(size)) + sum(step[a, b] for a, b in zip(p, p[1:])) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight):
            for t in range(size):
                want[start + t, p[t]] += w
            for a, b in zip(p, p[1:]):
                expected[a, b] += w
    assert np.allclose(got, want) and np.allclose(moves, expected)


def _plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and privacy.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a", "@", ".", "b.c", "1", "23", " ", "-", "+", "4539578763621486", "(", ")", "10.0.0.1", "x@y.z", "+1 (269) 555-3296", "é", "300.1.1.1"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert privacy.base_spans(text) == _plain_base(text), text


def test_privacy_finds_what_the_base_loses(spark, odd):
    texts = [f"word +1 (269) 555-{i:04d} and mail{i}@x{i}.org or 10.0.{i % 200}.7 card 4539578763621486 num 12345678901234{i:02d}" for i in range(80)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    model = privacy.fit_privacy(train)
    text = "call +1 (269) 555-3296 4539578763621486 now"
    base, every = model.spans(text)
    assert base == [] and {text[a:b] for a, _, b in every} == {"+1 (269) 555-3296", "4539578763621486"}
    assert privacy.redact(text, every) == "call [PHONE] [CARD] now"
    rows = privacy.find_privacy(odd, privacy.fit_privacy(_empty(odd)), redacted=True).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)


def test_privacy_proposes_phones_of_every_shape(spark):
    cases = {"+4915112345678": "2024-01-05", "+14155552671": "4539578763621486", "+33 1 23 45 67 89": "4111111111111111"}
    for phone, after in cases.items():
        text = f"{phone} {after}"
        assert privacy.base_spans(text)[:1] != [(0, 3, len(phone))] and (0, 3, len(phone)) in privacy.candidates(text)
    texts = [f"word {p} and {p[:-2]}{i:02d} num 12345678901234{i:02d} or 10.0.{i}.7 card 4539578763621486" for i in range(60) for p in cases]
    model = privacy.fit_privacy(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    for phone, after in cases.items():
        text = f"call {phone} {after} now"
        assert (5, 3, 5 + len(phone)) in model.spans(text)[1], text


def _prose(rng, n=60):
    return " ".join("".join(rng.choices("aeionrstlmdcu", k=rng.randint(2, 9))) + rng.choice(("", "", "", ".", ",")) for _ in range(n)) + f" {rng.randint(1, 40)}"


def test_plants_stand_where_they_are_said_to():
    rng = random.Random(5)
    for i in range(200):
        text = _prose(rng, rng.randint(0, 30)) if i else ""
        full, marks = plant(text, random.Random(i))
        cut = "".join(full[b:a] for (_, _, b, _), (a, _, _, _) in zip([(0, 0, 0, 0), *marks], [*marks, (len(full), 0, 0, 0)]))
        assert len(full) >= len(text) and len(cut) < len(full) and all(x[2] <= y[0] for x, y in zip(marks, marks[1:]))
        wanted = {(a, k, b) for a, k, b, personal in marks if personal}
        assert wanted <= set(privacy.candidates(full)), full
        rows = privacy.training_rows(text)
        assert rows == privacy.training_rows(text) and all(len(x) == privacy.FEATURES for x, _, _ in rows)
    assert len(privacy._stretch("abc" * 50, 40, 7**9)) == 40


def test_personal_data_beyond_the_base_is_found_by_format_and_context(spark):
    rng = random.Random(11)
    model = privacy.fit_privacy(spark.createDataFrame([(i, _prose(rng)) for i in range(1500)], "doc_id bigint, text string"))
    planted = found = wrong = 0
    for i in range(300):
        full, marks = plant(_prose(rng), random.Random(10**6 + i))
        base, every = model.spans(full)
        wanted, got = {(a, k, b) for a, k, b, personal in marks if personal} - set(base), set(every) - set(base)
        planted, found, wrong = planted + len(wanted), found + len(wanted & got), wrong + len(got - wanted)
    assert planted > 150 and found >= 0.9 * planted and wrong <= 0.03 * planted
    # The same digits are a phone or an order number by the words before them.
    def kinds(text):
        return [(k, text[a:b]) for a, k, b in model.spans(text)[1]]
    assert kinds("please call 415-555-2671 today") == [(3, "415-555-2671")] and kinds("see order 415-555-2671 today") == []
    assert kinds("write to jo.lee (at) example (dot) org. We") == [(0, "jo.lee (at) example (dot) org")]


def test_spans_are_chosen_as_by_comparing_all():
    rng = random.Random(9)
    for _ in range(300):
        spans = [(a, rng.randrange(4), a + rng.randint(1, 12)) for a in (rng.randrange(120) for _ in range(rng.randint(0, 25)))]
        taken, ordered = spans[:rng.randint(0, 5)], spans[5:]
        chosen = []
        for s in ordered:
            if all(s[2] <= a or b <= s[0] for a, _, b in taken + chosen):
                chosen.append(s)
        assert privacy.without_overlaps(taken, ordered) == chosen


def test_a_long_text_of_candidates_takes_seconds():
    import time
    text = "call +49 30 1234567, 192.168.0.7 and 4539 5787 6362 1486 or a.b@example.org (at) 030-123-4567 " * 8000
    model = privacy.PrivacyModel(privacy.Boosted(3.0), (0.5,) * 4)
    parts = []
    for size in (len(text) // 4, len(text)):
        start = time.time()
        base, every = model.spans(text[:size])
        parts.append(time.time() - start)
        assert len(every) >= len(base) > 0
    assert parts[1] < 8 * max(parts[0], 0.5)


def test_privacy_learns_from_any_ids(spark):
    texts = ["mail ann@example.org or call +49 (030) 123-4567 now", "ip 10.0.0.1 and +14155552671 2024-01-05", "nothing but 12 and 7"]
    for ids in ([4 * i for i in range(60)], [f"id-{i}" for i in range(60)]):
        df = spark.createDataFrame([(i, texts[k % 3]) for k, i in enumerate(ids)], "doc_id string, text string" if isinstance(ids[0], str) else "doc_id bigint, text string")
        assert privacy.fit_privacy(df).trees.trees


def test_rules_on_odd_rows(odd):
    rows = {r["doc_id"]: r for r in rules.judge(odd).where("doc_id is not null").collect()}
    assert rows[2]["n_words"] == 0 and rows[2]["base_failed"] and not rows[2]["kept"]
    assert rows[5]["n_words"] == 30000 and rows[5]["n_repeat_words"] == 30000
    assert rows[6]["n_words"] == 0 and rules.judge(_empty(odd)).count() == 0


def test_stop_words_in_capitals_and_other_languages(spark):
    texts = ["THE RIVER, THE HILL AND THE TOWN ARE OLD; IT IS SAID THAT A KING LIVED IN THE TOWN FOR YEARS.",
             "Il fiume non è lungo, ma per i mercanti che vivono di commercio sono molte le barche pronte ogni mattina presto.",
             "Старый город стоит у реки, где каждое утро торговцы ждут своих лодок, полных рыбы, хлеба, соли, тканей, масла, вина.",
             "blorp " + " ".join(f"qx{i}zt" for i in range(30))]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert [got[i]["kept"] for i in range(4)] == [not got[i]["base_failed"] for i in range(3)] + [False]
    assert got[3]["failed_rules"] == ["stop_words"] and got[2]["n_latin_words"] == 0 and got[0]["n_stop_words"] >= 9


def test_repeated_rows_are_compared_once(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:58] + ["x", "y"])
    rows = [(7, " ".join(base))] * 40 + [(3, near)] * 30 + [(3, "other words " * 1 + " ".join(f"v{i}" for i in range(40)))] * 2 + [(9, near)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    how = near_text.MinHash()
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_text.near_duplicates(docs, how).collect()}
    assert got == {(7, 3, False), (3, 3, True), (9, 3, False)} and near_text.near_duplicates(docs, how).count() == len(rows)
    ids = spark.createDataFrame([(7,), (3,)], "id bigint")
    sets = near_text.shingle_rows(docs, ids, how.width)
    stands = near_text.fingerprints(docs, how).selectExpr("doc_id as id", "set_key")
    assert sorted(r["id"] for r in near_text.standing_sets(sets, stands, ids).collect()) == [3, 3, 7]


def test_near_texts_against_brute_force(spark, odd):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = rng.choices(vocabulary, k=60)
        for _ in range(rng.choice([1, 2, 25])):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, rows[0][1].upper()) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for width, least in ((3, 85), (5, 80)):
        got = {r["doc_id"]: r["component_id"] for r in near_text.near_duplicates(docs, near_text.MinHash(width, least)).collect()}
        sets = {}
        for i, text in rows:
            w = text.lower().split()
            sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}
        parent = list(range(len(rows)))

        def find(x):
            return x if parent[x] == x else find(parent[x])

        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= least * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        assert got == {i: find(i) for i in range(len(rows))}
    rows = near_text.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["component_id"] == 1 and not by_id[4]["kept"] and by_id[2]["kept"] and by_id[6]["n_shingles"] == 0
    assert by_id[None]["kept"] and by_id[None]["component_id"] is None
    assert near_text.near_duplicates(_empty(odd)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_near_vectors_against_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 24))
    vectors = [b + rng.normal(size=24) * scale for b in base for scale in (0, 0.05, 0.1, 0.15, 0)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [1.0, None], 1), (903, [float("nan")] * 24, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, [], 0)]
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    good = rows[:150]
    unit = np.array([r[1] for r in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    assert [got[i]["n_links"] for i in range(150)] == linked.sum(1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 907))


def test_pieces_and_counts_equal_the_libraries(spark, odd):
    rng = random.Random(8)
    parts = ["a", "the", " ", "  ", "\n", "é", "😀", "1", "'s", "<|endoftext|>", ".", "▁", "\t", "日", "<0x0A>", " ", "ing"]
    texts = ["", " ", "x" * 3000, "ab  " * 900, *("".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(800))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    path = tokenizer_path("piece_bpe_32k.model")
    library = pieces.PieceModel(path).library
    for r in pieces.encode_pieces(docs, path, ids=True, decoded=True).collect():
        ids = library.encode(r["text"])
        assert r["ids"] == ids and r["decoded"] == library.decode(ids) and r["n_tokens"] == len(ids) and r["n_differing"] == 0
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = counts.load(path)
    for chunk in (65536, 40):
        for r in counts.count_tokens(docs, path, chunk=chunk, overlap=16).collect():
            assert r["n_tokens"] == len(tokenizer.encode(r["text"], add_special_tokens=False).ids)
    assert pieces.encode_pieces(odd, tokenizer_path("piece_bpe_32k.model")).count() == counts.count_tokens(odd, path).count() == len(ODD)


def test_short_and_long_words_are_merged_alike():
    model = pieces.PieceModel(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choices("abcdefghinorstuéß日.1", k=rng.randint(1, 31))) for _ in range(4000)] + ["▁▁▁the", "▁", "▁▁"]
    spelt = model.merge_all(words)
    for word, ids in zip(words, spelt):
        slow = [x for p in model.merge(word) for x in ([model.ids[p][0]] if p in model.ids else [model.bytes[b] for b in p.encode()])]
        assert ids == slow == model.library.encode("a" + word.replace("▁", " "))[1:]
    assert model.spell(["▁" + "x" * 50, "▁a"])[1] == model.merge_all(["▁a"])[0]


def test_a_differing_word_takes_the_library_result(monkeypatch):
    model = pieces.PieceModel(tokenizer_path("piece_bpe_32k.model"))
    wrong = model.spell(["▁other"])[0]
    spell = model.spell
    monkeypatch.setattr(model, "spell", lambda words: [wrong if w == "▁hello" else ids for w, ids in zip(words, spell(words))])
    memo = pieces.PieceMemo(model)
    memo.learn({"▁hello", "▁there", "▁▁x", "▁", "▁▁"})
    assert memo.differing == {"▁hello"} and memo.young["▁hello"][0] == ",".join(map(str, model.library.encode("hello")))
    assert memo.young["▁hello"][2] == " hello" and memo.young["▁there"][0] == ",".join(map(str, model.library.encode("there")))


def test_two_generations_keep_what_is_met_again(monkeypatch):
    monkeypatch.setattr(pieces, "GENERATION", 3)
    memo = pieces.PieceMemo(pieces.PieceModel(tokenizer_path("piece_bpe_32k.model")))
    for words in ({"▁a", "▁b", "▁c", "▁d"}, {"▁a", "▁e"}, {"▁a", "▁f", "▁g"}, {"▁h"}):
        memo.learn(words)
        assert words <= memo.young.keys()
    assert "▁a" in memo.old and "▁b" not in memo.old and "▁b" not in memo.young


def test_each_different_word_of_a_batch_is_looked_up_once(monkeypatch):
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    path, made = tokenizer_path("piece_bpe_32k.model"), {}
    monkeypatch.setattr(pieces, "map_texts", lambda documents, added, make, keep: made.update(make=make))
    pieces.encode_pieces(None, path, ids=True, decoded=True)
    texts = ["so it is " * 500, "", "it is  so", "so it is " * 500]
    run, memo = made["make"](), pieces.memo_of(path)
    memo.young = Counted(memo.young)
    got = run(texts)
    assert 0 < Counted.asked <= 6
    ids = [memo.model.library.encode(t) for t in texts]
    assert got["n_tokens"].to_pylist() == list(map(len, ids)) and got["ids"].to_pylist() == ids and got["decoded"] == texts
    assert got["ids_sha256"] == [hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids]
    assert got["decoded_sha256"] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    none = run(["", ""])
    assert none["n_tokens"].to_pylist() == [0, 0] and none["ids"].to_pylist() == [[], []] and none["decoded"] == ["", ""]


def test_words_of_many_texts_are_cut_before_runs_of_blanks():
    rng = random.Random(6)
    texts = ["", " ", "▁", "a", " a", "a  ", *("".join(rng.choices(["a", "é", "😀", " ", "▁", "\n", "\0", "日", "–"], k=rng.randint(0, 12))) for _ in range(400)), ""]
    words, ends = pieces.PieceModel.words(texts)
    every = words.to_pylist()
    assert len(set(words.dictionary.to_pylist())) == len(words.dictionary) and ends[-1] == len(every)
    for text, a, b in zip(texts, ends[:-1], ends[1:]):
        assert every[a:b] == (re.findall("▁+[^▁]*", ("▁" + text).replace(" ", "▁")) if text else [])


def test_pairs_are_found_by_their_hash():
    import numpy as np
    model = pieces.PieceModel(tokenizer_path("piece_bpe_32k.model"))
    one = {i: p for p, (i, _) in model.ids.items()}
    rng = np.random.default_rng(2)
    kept = np.flatnonzero(model.keys >= 0)
    assert kept.size < len(model.keys) / 2 and len(set(model.keys[kept].tolist())) == kept.size
    left, right = model.keys[kept] >> 26, model.keys[kept] & (1 << 26) - 1
    assert (model._look_up(left, right)[0] < pieces._NONE).all()
    left, right = np.append(left[:20000], -1), np.append(rng.permutation(right[:20000]), 5)
    places, joined = model._look_up(left.reshape(3, -1), right.reshape(3, -1))
    for a, b, place, i in zip(left.tolist(), right.tolist(), places.ravel().tolist(), joined.ravel().tolist()):
        a, b = (one.get(x, chr(x - pieces._LETTER) if x >= pieces._LETTER else None) for x in (a, b))
        known = model.ids.get(a + b) if a and b else None
        assert (place < pieces._NONE) == bool(known) and (not known or known[0] == i)


def test_mixing_on_odd_rows(odd):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    assert mixing.mix_sources(_empty(odd)).count() == 0
    assert sorted(map(str, mixing.mix_sources(odd).collect())) == sorted(map(str, rows))


def test_texts_searched_together_equal_a_full_scan():
    import numpy as np
    rng = np.random.default_rng(4)
    index = toxicity.BlockMaxIndex(np.arange(300, dtype=np.uint64), [], rng.random(300) + 1, np.zeros(1300), np.arange(1300))
    share = np.where(np.arange(300) < 8, 0.6, 0.01)  # a few terms are frequent
    rows = [np.flatnonzero(rng.random(300) < share) for _ in range(1300)]
    weights = [index.vector(r, rng.integers(1, 5, len(r))) for r in rows]
    index.build(rows, weights)
    assert sum(v.nbytes for v in vars(index).values() if hasattr(v, "nbytes")) < 14 * sum(map(len, rows)) + 20_000
    index.unfold()
    assert len(index.dense) == 8 and index.example.dtype == index.cut.dtype == np.int32 and len(index.example) == sum((r >= 8).sum() for r in rows)
    dense = np.zeros((1300, 300))
    for i, (r, w) in enumerate(zip(rows, weights)):
        dense[i, r] = w
    texts = [(t, index.vector(t, np.ones(len(t)))) for t in [np.flatnonzero(rng.random(300) < 0.05) for _ in range(90)] + [np.zeros(0, np.int64)]]
    for (term, weight), got in zip(texts, index.search_all(texts, 7)):
        cosine = np.round(dense[:, term] @ weight, 12)
        assert got == sorted(((c, i) for i, c in enumerate(cosine.tolist()) if c > 0), key=lambda x: (-x[0], x[1]))[:7] == index.search(term, weight, 7)
