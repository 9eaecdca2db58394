"""Nulls, blank and very long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import numpy as np
import pytest

from gridweave.llm import language, mixing, packing, pii, quality, rules, secret_scan, simhash, vectors, warc
from gridweave.llm.components import connected_components

WORDS = [a + b + c for a in ("ba", "to", "ri", "mel") for b in ("no", "sta", "lu", "ver") for c in ("", "n", "ki", "das")]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size int, row string, target string,"
    " fp long, component_id long, key string, node long, score string, kinds string, part int, rank int, copies int"
)
EXTRA = (7, "r", "t", 1, 2, "k", 3, "s", "x", 4, 5, 6)


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


LONG = prose(0, 60_000)
ROWS = [
    (1, prose(1, 300), "en", "a"),
    (2, prose(1, 300), "en", "a"),
    (2, prose(1, 300), "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n\r ", "fr", None),
    (6, LONG, "fr", "b"),
    (7, "x" * 200_000, "fr", "b"),
    (8, "a" * 30, None, "b"),
    (9, "1" * 100_000, "en", "b"),
    (10, "+" * 5000 + "@" * 5000 + "." * 5000, "en", "b"),
    (None, prose(2, 50), "fr", "b"),
    (None, None, None, None),
    (11, prose(3, 40), "en", "a"),
    (11, prose(4, 40), "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rules(odd, none):
    got = rules.judge(odd).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["kept"] and not by[1]["base_failed"]
    for i in (3, 4, 5, 7, 8):
        assert by[i]["base_failed"] and not by[i]["kept"]
    assert (by[3]["n_words"], by[7]["word_chars"], by[6]["n_words"]) == (0, 200_000, 60_000)
    assert rules.judge(none).collect() == []


def test_rule_order_does_not_change_verdicts(odd):
    a = rules.judge(odd).drop("rejected_by")
    b = rules.judge(odd, rules.RULES[::-1]).drop("rejected_by")
    assert rows_of(a) == rows_of(b)


def test_rules_are_measured_on_what_the_base_lets_pass(spark):
    plain = " ".join(f"word{i}" for i in range(30))
    texts = [plain] * 6 + ["# # #", "", None, "a b c d e " * 9] + [plain.upper()] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    watch = tuple(rules.Rule(n, lambda d, n=n: n in d.__dict__) for n in (*rules.COUNTS[1:], "n_distinct"))
    shares = {n: share for n, (_, share) in rules.measure(df, (*rules.RULES, *watch)).items()}
    assert shares["capitals"] == 2 / 8 and shares["symbols"] == 0
    assert all(shares[n] == 1 for n in rules.COUNTS[1:]) and shares["n_distinct"] == 0
    assert rules.measure(df.where("doc_id in (6, 7, 8, 9)")) == {}


def test_rules_by_rejections_per_cost():
    given = tuple(rules.Rule(n, lambda d: False) for n in "abcd")
    measured = {"a": (1.0, 0.5), "b": (0.1, 0.4), "c": (0.01, 0.0)}
    assert [r.name for r in rules.ordered(given, measured)] == ["b", "a", "c", "d"]
    asked = []
    watch = tuple(rules.Rule(n, lambda d, n=n: asked.append(n) or n == "b") for n in "abc")
    assert rules.first_rejection(rules.Document(b"x"), watch) == "b"
    assert asked == ["a", "b"]


@pytest.mark.parametrize("vocabulary", [2, 40, 100_000])
def test_repeated_words(vocabulary):
    rng = random.Random(vocabulary)
    for _ in range(30):
        words = [b"%d" % rng.randrange(vocabulary) for _ in range(rng.randrange(60))]
        words += words[5:20] if rng.random() < 0.5 else []
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        want = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert rules.repeated_words(words) == len(want)


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/é b\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (None, None, "y"), (2, None, "x"), (5, "u", "z" * 3_000_000)]
    df = spark.createDataFrame([(*p, "extra", 1) for p in pages], "page_id long, url string, html string, payload string, last int")
    got = warc.archive_pages(df, f"file://{tmp_path}")
    assert sorted(
        ((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got.collect()), key=repr
    ) == sorted(
        [
            (1, 1, "revisit", 2), (2, 1, "response", None), (2, 1, "response", None), (None, 1, "revisit", 2),
            (3, 0, "revisit", 4), (4, 0, "response", None), (None, 1, "response", None), (5, 3_000_000, "response", None),
        ],
        key=repr,
    )
    assert {bytes(r["payload"]) for r in got.collect() if r["payload"] is not None} == {b"x", b"", b"y", b"z" * 3_000_000}
    assert warc.archive_pages(df.limit(0)).collect() == []


def test_warc_threshold(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.classified(df, 3).selectExpr("page_id", "if(is_response, 'response', 'revisit') record_type").collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_warc_members_and_index(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], "page_id long, url string, html string").coalesce(2)
    streams = warc.write_archives(warc.classified(pages), f"file://{tmp_path}/s", archive_bytes=4000)
    assert streams.count() > 2
    whole = warc.normalize_archives(streams, f"file://{tmp_path}/m")
    for r in whole.collect():
        path, index = (r[c].removeprefix("file://") for c in ("path", "index"))
        raw = open(path, "rb").read()
        places = [tuple(map(int, line.split()[:2])) for line in open(index)]
        assert places[0][0] == 0 and sum(n for _, n in places) == len(raw) and len(places) == r["records"]
        for at, n in places:
            assert gzip.decompress(raw[at : at + n]).startswith(b"WARC/1.1\r\n")
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == len(places)


@pytest.mark.parametrize("members", [1, 3])
def test_inflating_in_parts(monkeypatch, members):
    import gzip
    import io

    monkeypatch.setattr(warc, "CHUNK", 100)
    whole = b"".join(b"%d" % i * 50 for i in range(300)) + b"0" * 100_000
    cut = len(whole) // members + 1
    packed = b"".join(gzip.compress(whole[i : i + cut]) for i in range(0, len(whole), cut))
    got = list(warc.inflated(io.BytesIO(packed)))
    assert b"".join(got) == whole and max(map(len, got)) <= 100 + 258


def test_warc_broken_archive():
    raw = warc.page_record(1, "u", b"abc", None, True).to_bytes()
    assert list(warc.split_records(iter([raw[:7], raw[7:], raw]))) == [raw, raw]
    with pytest.raises(ValueError):
        list(warc.split_records(iter([raw, raw[:-1]])))


def test_warc_cut_at_a_record(tmp_path):
    """A stream cut where its first record ends, and one that ends well but lacks a record."""
    import io
    import zlib

    one, two = (warc.page_record(i, "u", b"abc" * 100, None, True).to_bytes() for i in (1, 2))
    deflate = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    first = deflate.compress(one) + deflate.flush(zlib.Z_SYNC_FLUSH)
    whole = first + deflate.compress(two) + deflate.flush()
    assert list(warc.split_records(warc.inflated(io.BytesIO(whole)))) == [one, two]
    members = warc.deflated(one) + warc.deflated(two)
    assert list(warc.split_records(warc.inflated(io.BytesIO(members)))) == [one, two]
    assert list(warc.split_records(warc.inflated(io.BytesIO(b"")))) == []
    for cut in (first, whole[:-1], members[:-3], first[:20]):
        with pytest.raises(ValueError):
            list(warc.split_records(warc.inflated(io.BytesIO(cut))))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.deflated(one))
    assert warc._normalize(f"file://{path}", f"file://{tmp_path}/m", 1).num_rows == 1
    with pytest.raises(ValueError, match="1 records, not the 2"):
        warc._normalize(f"file://{path}", f"file://{tmp_path}/m", 2)


def test_quality(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1, 0, "x"), (2, 1, 0, "x"), (3, 0, 0, "x"), (6, 1, 1, "x"), (7, 0, 0, "x"), (8, 0, None, "x"), (8, 1, 0, "x"), (9, None, 0, "x"), (None, 1, 0, "x"), (99, 1, 0, "x"), (11, 1, 0, "x")],
        "doc_id long, quality int, toxic int, text string",
    )
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[1] == by[2] and by[3] == by[4] == by[5] and len(by[None]) == 2
    assert quality.classify(none, labels).collect() == []
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert len({r["score"] for r in quality.classify(odd, some).collect()}) == 1
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= len(ROWS)


def test_dual_descent_reaches_the_least_loss():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(40)]
    labels = np.where(rng.random(40) < 0.5, 1, -1)
    scale, cost = np.ones(quality.FEATURES), 0.5

    def loss(w, b):
        margins = np.array([w[r].sum() + b for r in rows]) * labels
        return (w @ w + b * b) / 2 + cost * np.maximum(0, 1 - margins).sum()

    w, b = quality.hinge_by_dual_descent(rows, labels, scale, cost, rounds=400)
    best = loss(w, b)
    for _ in range(300):
        step = rng.normal(size=12) * 0.05
        near = w.copy()
        near[:12] += step
        assert loss(near, b + rng.normal() * 0.05) >= best - 1e-4


def test_log_count_ratios():
    rows = [np.array([0, 1]), np.array([1]), np.array([2])]
    got = quality.log_count_ratios(rows, np.array([1, 1, -1]))
    assert got[1] > got[0] > got[3] > got[2]


def test_language(spark, odd, none):
    got = language.identify(odd).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i in (3, 4, 5, 9, 10):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[6]["lang_pred"] in ("en", "fr") and 0 < by[6]["score"] <= 1
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert language.identify(none).collect() == []
    assert {r["lang_pred"] for r in language.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_language_model_is_what_the_rows_say(spark, monkeypatch):
    rows = [(i, t, l) for i, (t, l) in enumerate([("abc abd", "x"), ("abc", "y"), ("qrs", "x"), (None, "y"), ("zzz", None), ("", "w"), ("é", "ü")] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    learned = docs.where(~language.is_held_out()).collect()
    names = sorted({r["lang"] for r in learned if r["lang"] and r["text"]})
    counts = np.full((language.FEATURES, len(names)), language.SMOOTHING)
    for r in learned:
        if r["lang"] and r["text"]:
            np.add.at(counts[:, names.index(r["lang"])], language.grams(r["text"].encode()), 1)
    model = language.fit(docs)
    assert model.languages == names
    assert np.array_equal(model.log_p, np.log(counts / counts.sum(0)).astype(np.float32))
    monkeypatch.setattr(language, "MOST_LANGUAGES", len(names) - 1)
    with pytest.raises(ValueError):
        language.fit(docs)


def test_language_letters():
    assert language.has_letter("é".encode()) and language.has_letter("ª".encode()) and language.has_letter("字".encode())
    assert not any(language.has_letter(t.encode()) for t in ("", "12 ½ ² _-!", "①")) and not language.has_letter(None)


def test_language_mixture():
    rng = random.Random(5)
    some = {
        "aa": [" ".join(rng.choices(["kato", "miru", "sane", "tolu"], k=60)) for _ in range(5)],
        "bb": [" ".join(rng.choices(["stref", "grund", "plock", "zwist"], k=60)) for _ in range(5)],
        "cc": [" ".join(rng.choices(["oiea", "uaio", "eeou", "aiue"], k=60)) for _ in range(5)],
    }
    counts = np.full((language.FEATURES, 3), language.SMOOTHING)
    for j, docs in enumerate(some.values()):
        for d in docs:
            np.add.at(counts[:, j], language.grams(d.encode()), 1)
    model = language.Model(list(some), np.log(counts / counts.sum(0)).astype(np.float32))
    mixed = some["aa"][0] + " " + " ".join(some["bb"][0].split()[:30])
    found = [np.unique(language.grams(t.encode()), return_counts=True) for t in (some["cc"][0], mixed)]
    parts = language.proportions(model, found)
    assert parts[0].tolist() == [0, 0, 1]
    assert parts[1][2] == 0 and 0.5 < parts[1][0] < 0.75 and abs(parts[1].sum() - 1) < 1e-9
    assert language.predict(model, [mixed.encode(), b"77", None])[1:] == [("und", 0.0)] * 2


def test_secrets(odd, none):
    got = secret_scan.report(odd).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[9]["spans"] == "hex:0:100000" and by[8]["spans"] == "hex:0:30"
    assert all(by[i]["spans"] == "" for i in (1, 3, 4, 5, 6, 7, 10))
    assert secret_scan.report(none).collect() == []


def test_secret_kinds(spark):
    texts = {
        "É token = 'abcdefghijkl'": "assign:2:23",
        "password=token: abcdefghijklmnop": "",
        "API_KEY: aaaaaaaaaaaa apikey=bbbbbbbbbbbb": "assign:0:21,assign:22:41",
        "PaSsWd=short secret=long.enough_1": "assign:13:33",
        "xAKIA" + "A" * 14: "access:1:19",
        "AKIA" + "A" * 13: "",
        "ghp_" + "g1" * 18: "github:0:40",
        "xoxb-1234567890": "slack:0:15",
        "-----BEGIN RSA PRIVATE KEY-----": "private_key:0:31",
        "sk_live_abcdefghijklmnop": "stripe:0:24",
        "token=" + "0123456789abcdef": "assign:0:22,hex:6:22",
        "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh": "jwt:0:34",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.report(df).collect()}
    assert got == dict(enumerate(texts.values()))


def test_many_matches_in_one_text(spark):
    one = "é 0123456789abcdef "
    df = spark.createDataFrame([(1, one * 3100)], "doc_id long, text string")
    want = ",".join(f"hex:{19 * i + 2}:{19 * i + 18}" for i in range(3100))
    assert secret_scan.report(df).first()["spans"] == want


def test_mixing(odd, none):
    got = mixing.copies(odd).collect()
    assert len(got) == len(ROWS)
    size = {s: sum(r["size"] for r in got if r["source"] == s) for s in ("a", "b", None)}
    target = {r["source"]: r["target"] for r in got}
    assert size[None] == 0 and target[None] == 0 and target["a"] == 3 * size["a"]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(r["copies"] == (3 if r["size"] else 0) for r in got if r["source"] == "a")
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    assert out.count() == sum(r["copies"] for r in got)
    assert rows_of(mixing.mix(odd)) == rows_of(out)
    assert mixing.copies(none).collect() == []
    assert mixing.mix(odd.where("text is null")).collect() == []


def test_mixing_hits_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 10)), f"s{min(9, int(rng.expovariate(0.5)))}") for i in range(3000)]
    rows = [(i, t[:20000], s) for i, t, s in rows]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        by.setdefault((r["source"], r["target"]), []).append(r["size"] * r["copies"])
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.05 * target + 50


def test_vectors(spark):
    e = [[1.0, 0.0], [1.0, 0.01], [1.0, 0.02], [0.0, 1.0]]
    rows = [
        (1, e[0], 1, 9), (2, e[1], 1, 9), (3, [2.0, 0.0], 1, 9), (4, e[3], 1, 9), (5, e[0], 2, 9), (6, e[0], None, 9),
        (7, None, 1, 9), (8, [0.0, 0.0], 1, 9), (9, [1.0, None], 1, 9), (10, [1.0, float("nan")], 1, 9), (11, [], 1, 9),
        (12, [1.0, 0.0, 0.0], 1, 9), (13, [float("inf"), 1.0], 1, 9), (None, e[0], 1, 9), (2, e[1], 1, 9),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in vectors.vector_components(df).collect() if r["vec_id"])
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)]
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *alone]
    assert vectors.vector_components(df.limit(0)).collect() == []


def test_vectors_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 5)
    monkeypatch.setattr(vectors, "LIST_VECTORS", 8)
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 20))
    x = np.array([centres[i % 6] + rng.normal(size=20) * rng.choice([0.02, 0.12, 0.16]) for i in range(90)])
    x[80] = x[3]
    label = [int(i) % 2 for i in rng.integers(0, 2, 90)]
    label[80] = label[3]
    df = spark.createDataFrame([(i, v.tolist(), label[i]) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == label) & ~np.eye(90, dtype=bool)
    root = list(range(90))
    for _ in range(90):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(90)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.vector_components(df).collect()}
    assert got == {i: (int(near[i].sum()), root[i]) for i in range(90)}
    assert near.sum() > 100 and len(set(root)) > 12


def test_one_of_two_lists_asks():
    lists = 9
    every = [np.arange(lists)] * lists
    asked = vectors.asked_lists(np.arange(lists), every)
    for a in range(lists):
        assert a in asked[a] and len(asked[a]) == 1 + lists // 2
        assert all((b in asked[a]) != (a in asked[b]) for b in range(lists) if b != a)


def test_probes_are_sufficient():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = vectors.train(x, 12)
    q = x + rng.normal(size=x.shape) * 0.02
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    cell, code, error = vectors.encode(model, x)
    radius = np.linalg.norm(q - x, axis=1).max()
    assert all(c in p for c, p in zip(cell, vectors.probes(model, q, radius), strict=True))
    for i in range(0, 400, 40):
        d = vectors.table_distances(model, cell[i], q[i : i + 1], code[i : i + 1])[0, 0]
        assert abs(d - np.linalg.norm(q[i] - x[i])) <= error[i] + 1e-4


def test_simhash(odd, none):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert (by[1], by[2], by[3], by[4], by[5], by[7]) == (1, 1, 3, 3, 3, 7)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert by[11] == 11
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == [-1, -1, 1, 3, 6, 7, 8, 9, 10, 11]
    assert simhash.simhash_components(none).collect() == [] and simhash.drop_near_duplicates(none).collect() == []


@pytest.mark.parametrize("part", [4096, 3])
def test_near_links_by_brute_force(spark, part):
    rng = random.Random(part)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {}
    for n in range(150):
        x = rng.choice(base)
        for bit in rng.sample(range(64), rng.randrange(7)):
            x ^= 1 << bit
        prints.setdefault(x, n)
    signed = [(n, simhash._signed(x)) for x, n in prints.items()]
    df = spark.createDataFrame(signed, "node long, fp long")
    keys = simhash.Near().keys(df.fp, 10_000)
    got = {r["node"]: r["root"] for r in connected_components(simhash.near_links(df, keys, 4, part)).collect()}
    root = {n: n for n in prints.values()}
    for _ in range(20):
        for x, n in prints.items():
            root[n] = min(root[m] for y, m in prints.items() if (x ^ y).bit_count() <= 4)
    assert {n: got.get(n, n) for n in root} == root


@pytest.mark.parametrize(("blocks", "distance"), [(5, 4), (6, 4), (7, 4), (4, 3)])
def test_masks_keep_close_pairs_together(blocks, distance):
    masks = simhash.block_masks(blocks, distance)
    rng = random.Random(blocks)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), distance):
            y ^= 1 << bit
        assert any(x & m == y & m for m in masks)


def test_block_count_grows_with_the_table():
    assert [simhash.block_count(10**k, 4) for k in (1, 5, 7, 9)] == [5, 5, 6, 7]


def test_no_column_clashes(odd):
    from pyspark.sql import functions as F

    clashing = odd.withColumns({"_gone": F.lit(1), "_again": F.lit(2), "_" * 30: F.lit(3), "doc_ID_": F.lit(4)})
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 3, 6, 7, 8, 9, 10, 11]


def test_one_of_each_component_stays(spark):
    """Survivors are the smallest ids of brute-force components by bits, and no other."""
    rng = random.Random(1)
    docs = []
    for n in range(60):
        words = [f"{rng.choice(WORDS)}{rng.randrange(99)}" for _ in range(400)]
        docs.append((3 * n, " ".join(words)))
        docs.append((3 * n + 1, " ".join(words)))
        for at in rng.sample(range(400), 1 + n % 6):
            words[at] = "changed"
        docs.append((3 * n + 2, " ".join(words)))
    prints = {i: simhash.fingerprint(t.encode()) for i, t in docs}
    root = {i: i for i in prints}
    for _ in range(20):
        for i in prints:
            root[i] = min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4)
    kept = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in prints if root[i] == i)
    assert len(set(root.values())) < 140


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(9, 3), (3, 9), (4, None), (None, 5)]])
def test_components(spark, links):
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            root |= {a: a, b: b}
    for _ in range(70):
        for a, b in links:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}


def test_random_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = list(range(300))
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in range(300)} == dict(enumerate(root))


def test_packing(odd, none):
    got = packing.pack_documents(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"]
    assert set(by) == {r[0] for r in ROWS}
    for i in (3, 4, 5):
        assert [(r["length"], r["doc_tokens"], r["ids"]) for r in by[i]] == [(1, 1, b"\2\0\0\0")]
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert packing.pack_documents(none).collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 4095, 4096, 4097, 12_345])
def test_cut(n):
    lengths = packing.cut(n)
    assert sum(lengths) == n and max(lengths) <= 4096 and lengths == sorted(lengths, reverse=True)
    assert all(x.bit_count() == 1 for x in lengths) and len({x for x in lengths if x < 4096}) == sum(x < 4096 for x in lengths)


def test_word_ids_are_the_tokenizers():
    import public_tokenizers

    table = packing.word_ids(public_tokenizers.path(packing.TOKENIZER))
    words = ["Hello,", "it's", "don't!", "É", "ÉCOLE...", "straße?!", "x1y2", "1.5", "...", "ﬁ", "Å", "Å", "İ", "<|endoftext|>", "foo<|endoftext|>bar", "漢字。", "a b", "Σς", "ΑΣ", "…", "a" * 500, "'s", "we'll.", "ab's", "|", "ß|", "ǅ"]
    for w in words * 2:
        assert table(w.encode()) == packing._packed(table.tokenizer.encode(w, add_special_tokens=False).ids), w


@pytest.mark.parametrize("sign", [".", ":", "?!"])
def test_letters_before_signs(sign):
    """Every letter below U+20000, some of which normalising takes apart."""
    import public_tokenizers

    table = packing.word_ids(public_tokenizers.path(packing.TOKENIZER))
    letters = [chr(c) for c in range(0x20000) if chr(c).isalpha()]
    words = [x + sign for x in letters] + [f"a{x}{sign}" for x in letters[::7]]
    want = table.tokenizer.encode_batch(words, add_special_tokens=False)
    assert [w for w, e in zip(words, want, strict=True) if table(w.encode()) != packing._packed(e.ids)] == []


def test_recent_keys_stay():
    asked = []
    table = packing.Recent(lambda k: asked.append(k) or k, 4)
    for i in range(200):
        assert table[b"often"] == b"often" and table[b"%d" % i] == b"%d" % i
    assert asked.count(b"often") == 1 and len(table) <= 4 and len(table.older) <= 4
    assert table[b"x" * 100] == table[b"x" * 100] and asked.count(b"x" * 100) == 2


def test_personal_data(odd, none):
    got = pii.personal_data(odd).collect()
    assert len(got) == len(ROWS) and all(r["n_spans"] == 0 for r in got)
    assert pii.personal_data(none).collect() == []
    out = pii.redact(odd)
    assert out.columns == odd.columns and rows_of(out) == rows_of(odd)


DISGUISED = [
    ("mail john.doe [at] example [dot] com now", "mail [EMAIL] now"),
    ("john.doe at example dot com.", "[EMAIL]."),
    ("an а@exаmple.com ok", "an [EMAIL] ok"),
    ("jo (at) mail.example.com", "[EMAIL]"),
    ("plus four one five five five five one two three four now", "[PHONE] now"),
    ("１２７.0.0.1", "[IP]"),
    ("four one one one one one one one one one one one one one one one", "[CARD]"),
    ("jo​hn@example.com", "[EMAIL]"),
    ("one two three, look at noon. dot by dot", "one two three, look at noon. dot by dot"),
    ("it is at home dot", "it is at home dot"),
    ("é +1 (017) 555-7713 and a@b.co", "é [PHONE] and [EMAIL]"),
]


@pytest.mark.parametrize(("text", "clean"), DISGUISED)
def test_disguises(text, clean):
    assert pii.redacted(text) == clean


def test_base_identifiers_by_brute_force():
    from tests.llm.test_queries import brute_identifiers

    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choices("a1.@+-( )2 ._%0é", k=rng.randrange(40)))
        base, every = pii.find_spans(text)
        assert base == brute_identifiers(text)
        assert set(base) <= set(every)


def test_redacted_length(spark):
    df = spark.createDataFrame([(1, "to a@b.co", 9), (2, None, None)], "doc_id long, text string, n_chars long")
    assert rows_of(pii.redact(df)) == [(1, "to [EMAIL]", 10), (2, None, None)]
